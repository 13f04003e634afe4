"""Secret scans: named patterns, and sliding-window entropy over candidate strings.

Candidates are runs of characters that keys are written with.  Over each run a
window slides; the counts of its characters, and with them the sum of c*log2(c),
change by one character in and one out, so each step costs the same whatever
the window.  Windows are judged by the character class of their characters,
since sixteen symbols cannot reach the entropy of sixty-four.  Hex digits are
judged in either case; letters alone and digits alone also have to be unlike
words, dates and numbers in groups.  Runs on an allow-list (placeholders,
identifiers that are no secrets, sequences) are let go, but nothing beside them.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.storage import bounded_batches
from scanloom.llm.text import id_and_text, row_batch, with_results

# The base patterns, with the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole, so shorter ones need not be matched first
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Least entropy, in bits a character over a window of 20, by the classes in the window.
#: 20 random hex digits have 3.3 on average, 20 random letters and digits 4.1; words have 3.2.
LEAST_BITS = {"digits": 2.6, "hex": 3.0, "lower": 3.2, "upper": 3.2, "single_case": 3.6, "mixed": 3.7}
# Hex digits of both cases with no other letter between them.
ANY_HEX = re.compile(r"[0-9A-Fa-f+/_=-]{20,}")
UPPER_HEX = re.compile(r"[A-F]")
#: What stands between the separators of a run, and words of one case or with a capital.
PIECE, WORD = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
DATE = re.compile(r"(?:19|20)\d\d[/_-]?(?:0[1-9]|1[0-2])[/_-]?(?:0[1-9]|[12]\d|3[01])")
#: Least digits, outside dates, of a window of digits alone.
LEAST_DIGITS = 16
#: Neighbouring letters that are common in European languages; a third of all pairs, and most of those in words.
PAIRS = frozenset(
    (
        "ab ac ad ag ah ai ak al am an ap ar as at au av ay ba be bi bl bo br bu ca ce ch ci ck cl co cr ct cu da de di do dr du ea ec ed ee ef eg ei el em en ep er es et eu ev ew ex ey "
        "fa fe ff fi fo fr fu ga ge gh gi gl go gr gu ha he hi ho hr ht ia ib ic id ie if ig ik il im in io ir is it iv ke ki la ld le li ll lo ls lt lu ly ma mb me mi mm mo mp mu na nc nd ne ng ni nk nn no ns nt nu "
        "ob oc od of ok ol om on oo op or os ot ou ov ow pa pe ph pi pl po pp pr pt pu qu ra rc rd re rg ri rk rm rn ro rr rs rt ru ry sa sc se sh si so sp ss st su ta te th ti to tr ts tt tu ty "
        "ua ub ud ue ug ui ul um un up ur us ut va ve vi vo wa we wh wi wo ya ye zu ds fl ks ms nf ps sy wr xp xt ym ys"
    ).split()
)
#: Most of a window's pairs that are common where its letters are random, and least pairs to tell by.
MOST_COMMON, LEAST_PAIRS = 0.6, 8
# Allow-list: strings that look random and are no secrets.  Whole runs, and parts of runs: each part is
# taken out, and what is left of the run is judged by itself.
ALLOWED_RUN = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(.)\1*|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")


def _going_on(symbols: str) -> str:
    """The symbols in order, as many as there are."""
    tail = ""
    for c in reversed(symbols):
        tail = f"(?:{c}{tail})?"
    return tail


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGESTS = "|".join(f"{name}-(?:[0-9a-fA-F]{{{n}}}(?![A-Za-z0-9+/])|[A-Za-z0-9+/]{{{-(-n * 2 // 3)}}}={{0,2}}(?![A-Za-z0-9+/=]))" for name, n in (("md5", 32), ("sha1", 40), ("sha256", 64), ("sha384", 96), ("sha512", 128)))
ALLOWED_PART = re.compile(
    rf"\A(?:{_DIGESTS})|(?i:example|sample|dummy|placeholder|changeme|redacted|x{{4,}}|your[_-]|"
    rf"abcdefgh{_going_on(_LETTERS[8:])}|(?:01234567|12345678)8?9?0?{_going_on(_LETTERS)})"
)
_CLASS = {**dict.fromkeys("0123456789", 1), **dict.fromkeys("abcdef", 2), **dict.fromkeys("ghijklmnopqrstuvwxyz", 4), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 8)}
ALONE = ("digits", "lower", "upper")
_XLOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]  # one comes in before one goes out


def character_class(digits: int, a_f: int, lower: int, upper: int) -> str:
    """The class of a window from its counts of digits, a-f, g-z and A-Z."""
    if not digits:
        # letters alone are words, unless their case is mixed throughout
        return "mixed" if upper >= 5 and a_f + lower >= 5 else "lower" if a_f + lower else "upper"
    if not (a_f or lower or upper):
        return "digits"
    if not (lower or upper):
        return "hex"
    return "mixed" if upper and (a_f or lower) else "single_case"


def plain(window: str, kind: str) -> bool:
    """Whether a window of letters alone looks like words, or one of digits alone like dates or numbers in groups."""
    if kind == "digits":
        return sum(map(str.isdigit, DATE.sub("", window))) < LEAST_DIGITS
    low = window.lower()
    pairs = [p for p in map("".join, zip(low, low[1:])) if p.isalpha()]
    return len(pairs) < LEAST_PAIRS or sum(p in PAIRS for p in pairs) > MOST_COMMON * len(pairs)


def random_windows(run: str) -> list[tuple[int, int]]:
    """Stretches of a run whose windows reach the entropy of their class, joined where they overlap."""
    counts: dict[str, int] = {}
    kinds = {0: 0, 1: 0, 2: 0, 4: 0, 8: 0}
    total, found = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _XLOG[n + 1] - _XLOG[n]
        kinds[_CLASS.get(c, 0)] += 1
        if i >= WINDOW:
            old = run[i - WINDOW]
            n = counts[old]
            counts[old] = n - 1
            total += _XLOG[n - 1] - _XLOG[n]
            kinds[_CLASS.get(old, 0)] -= 1
        if i < WINDOW - 1:
            continue
        kind, start = character_class(kinds[1], kinds[2], kinds[4], kinds[8]), i - WINDOW + 1
        if math.log2(WINDOW) - total / WINDOW >= LEAST_BITS[kind] and not (kind in ALONE and plain(run[start : i + 1], kind)):
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def holds_random(run: str) -> bool:
    """Whether any window of a run is random, hex digits in either case taken as the same sixteen."""
    if random_windows(run):
        return True
    return bool(UPPER_HEX.search(run)) and any(random_windows(m[0].lower()) for m in ANY_HEX.finditer(run))


def random_stretches(run: str) -> list[tuple[int, int]]:
    """As random_windows, hex digits in either case also taken as the same sixteen; overlapping ones are joined."""
    found = random_windows(run)
    if UPPER_HEX.search(run):
        found = sorted(found + [(m.start() + a, m.start() + b) for m in ANY_HEX.finditer(run) for a, b in random_windows(m[0].lower())])
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_like(piece: str) -> bool:
    """Whether a piece between separators is a word or a short number, which random text rarely is."""
    if len(piece) < 3:
        return False
    if piece.isdigit():
        return len(piece) <= 8
    low = piece.lower()
    pairs = [x + y for x, y in zip(low, low[1:])]
    return bool(WORD.fullmatch(piece)) and 2 * sum(p in PAIRS for p in pairs) >= len(pairs)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """The random stretches of candidate runs, from separator to separator.

    Windows reach into the words beside a key; such words are left out, and a
    stretch stays if the rest is random without its allowed parts.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if ALLOWED_RUN.fullmatch(run) or not (found := random_stretches(run)) or not holds_random(ALLOWED_PART.sub("", run)):
            continue
        pieces = [p.span() for p in PIECE.finditer(run)]
        last = 0
        for a, b in found:
            inside = [(x, y) for x, y in pieces if y > a and x < b and x >= last]
            for end in (0, -1):
                while len(inside) > 1 and word_like(run[slice(*inside[end])]):
                    rest = inside[1:] if end == 0 else inside[:-1]
                    if not holds_random(run[rest[0][0] : rest[-1][1]]):
                        break
                    inside = rest
            if inside and holds_random(ALLOWED_PART.sub("", run[inside[0][0] : inside[-1][1]])):
                # separators at the ends of the run belong to what stands there
                first, last = 0 if inside[0] == pieces[0] else inside[0][0], len(run) if inside[-1] == pieces[-1] else inside[-1][1]
                out.append((m.start() + first, m.start() + last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns that hold enough, sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for _, a, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """Finds secrets in whole texts.

    Returns a row per input row: doc_id, n_assign, n_access, n_hex long, base and
    spans string (``kind:start:end`` by start, then kind; characters, end
    exclusive; base patterns alone, and with the entropy spans), redacted string.
    A null text counts as empty and has no spans; its redacted text is null.
    Spans of one start stand in the order of their kinds, of one kind the shorter
    first; overlapping ones are redacted as one.  An entropy span is a random
    stretch, from separator to separator, and not the whole run of characters
    that it stands in.  Texts and runs of any length
    are scanned whole, windows move on by one character.  ``whole_rows`` adds the
    input row as a struct ``row``.  Repeated rows and null ids are kept; other
    columns are not read; an empty table gives none.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            every = [in_order(b + [("entropy", *s) for s in entropy_spans(t)]) if t else [] for t, b in zip(texts, base)]
            count = lambda kind: pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64())  # noqa: B023, E731
            yield row_batch(
                batch,
                ["n_assign", "n_access", "n_hex", "base", "spans", "redacted"],
                [
                    *map(count, KINDS[:3]),
                    pa.array(map(shown, base), pa.string()),
                    pa.array(map(shown, every), pa.string()),
                    pa.array([redacted(t, s) if s else t for t, s in zip(texts, every)], pa.string()),
                ],
            )

    kept = id_and_text(df, id_col, text_col, whole_rows)
    return kept.mapInArrow(run, with_results(kept, "n_assign long, n_access long, n_hex long, base string, spans string, redacted string"))


def with_digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(shown(spans).encode()).hexdigest()
