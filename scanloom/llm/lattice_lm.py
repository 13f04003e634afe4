"""Language-model scores: word counts, and the marginal probability over a subword lattice.

The subword vocabulary and its scores exist already (a sentencepiece file);
nothing of it is trained.  Its stored scores, normalised, weight the pieces, and
the probability of a word is the sum over all its segmentations, by a forward
recursion in logs.  Pieces do not cross white space, so a text's log probability
is the sum over its words and the end.

The training texts are learned as whole words: a token's probability is its share
of the training tokens, and for what those leave open the vocabulary's.  How much
that is, Good and Turing's estimate says: the tokens seen once among all.  If a
``corpus_share`` is given, one more arc stands beside the pieces instead: that
share of the mass, dealt by counts; 0 is the vocabulary alone.

Word counts are the corpus statistic: partial counts in each task, one shuffle.
Every distinct word of the corpus goes through its lattice once, in batches,
where the counts come together.  The most frequent words, up to a fixed number,
go to every worker with their logs; the others are joined by the word, and words
that many texts share (those of held-out texts alone have no count) are dealt
over tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.spread import spread_join
from scanloom.llm.storage import Stash, bounded_batches
from scanloom.llm.text import column_bytes, spaced_words

#: Words that every worker holds, at most.
HEAD_WORDS = 300_000
#: Words a task counts before it hands its counts on, and sends through the lattice at once.
PARTIAL_WORDS, LATTICE_WORDS = 400_000, 20_000
#: Of the vocabulary's mass, the shares of the bytes that spell other characters, and of the end.
BYTE_SHARE, END_SHARE = 0.01, 0.01
#: Stands for the end of a text; no word holds a line break.
END = "\n"
SPACE_MARK = "▁"
LN10 = math.log(10)
_CAPITAL = re.compile("[A-Z]")
_P, _MARK_BITS = np.uint64(0x9E3779B97F4A7C15), 22
#: Characters of words in one array.
_CELLS = 1 << 17


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each character."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """The characters of each text, filled up with zeros."""
    return np.frombuffer("".join([t.ljust(width, "\0") for t in texts]).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


@dataclass
class PieceModel:
    """Log probabilities of the pieces, of the bytes that spell other characters, and of the end."""

    logs: dict[str, float]
    bytes_: list[float]
    end: float
    #: sorted hashes of the pieces, their logs in that order, and bits of the hashes that occur
    hashes: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    marks: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        pieces = sorted(self.logs, key=len)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.zeros(len(pieces), np.uint64)
        lengths = np.array([*map(len, pieces)], np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            values = _values(_codes([pieces[i] for i in at], int(n)))
            for k in range(int(n)):
                hashes[at] = hashes[at] * _P + values[:, k]
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], np.array([self.logs[pieces[i]] for i in order])
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.marks = np.zeros(1 << _MARK_BITS, bool)
        self.marks[(self.hashes >> np.uint64(64 - _MARK_BITS)).astype(np.int64)] = True

    def other(self, char: str) -> float:
        return sum(self.bytes_[b] for b in char.encode())

    def word(self, word: str) -> float:
        """Log probability of a word: all paths through its lattice."""
        return float(self.words([word])[0])

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of many words; words of about one length go through the recursion together."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        order, out, first = np.argsort(lengths, kind="stable"), np.zeros(len(words)), 0
        while first < len(order):
            last = first + 1
            while last < len(order) and (last - first + 1) * lengths[order[last]] <= _CELLS and lengths[order[last]] <= lengths[order[first]] + 2:
                last += 1
            at = order[first:last]
            out[at] = self._recursion([SPACE_MARK + words[i] for i in at], lengths[at])
            first = last
        return out

    def _recursion(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """The forward recursion over the ends of pieces, for all texts at once."""
        count, width, most = len(texts), int(lengths.max()), self.longest
        codes = _codes(texts, width)
        values = _values(codes)
        # arcs[j, k]: the log of the piece of k + 1 characters that ends at j
        arcs = np.full((width + 1, most, count), -np.inf)
        hashed = np.zeros_like(values)
        for k in range(min(most, width)):
            hashed = hashed[:, : width - k] * _P + values[:, k:]
            rows, starts = np.nonzero(self.marks[(hashed >> np.uint64(64 - _MARK_BITS)).astype(np.int64)])
            found = hashed[rows, starts]
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            same = self.hashes[at] == found
            arcs[starts[same] + k + 1, k, rows[same]] = self.weights[at[same]]
        # characters that are no piece are spelled by their bytes
        rows, starts = np.nonzero(np.isneginf(arcs[1:, 0, :].T) & (np.arange(width) < lengths[:, None]))
        if len(rows):
            chars, which = np.unique(codes[rows, starts], return_inverse=True)
            arcs[starts + 1, 0, rows] = np.array([self.other(chr(c)) for c in chars])[which]
        forward = np.full((width + 1 + most, count), -np.inf)
        forward[most] = 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(1, width + 1):
                terms = forward[j : most + j][::-1] + arcs[j]
                top = terms.max(0)
                forward[most + j] = top + np.log(np.exp(terms - top).sum(0))
        return forward[most + lengths, np.arange(count)]

    def text(self, words: list[str]) -> float:
        """log10 of the probability of a whole text."""
        return (float(self.words(words).sum()) + self.end) / LN10


def existing_scores(path: str) -> tuple[dict[str, float], int]:
    """Pieces with the weights that their scores in the vocabulary give, and the number of byte pieces.

    The scores of this kind of vocabulary are negative ranks; a piece of rank r
    weighs 1 / (r + 10), near the law that word frequencies follow.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i)) and p.get_score(i) > -1e8]
    return {p.id_to_piece(i): 1 / (10 - p.get_score(i)) for i in plain}, sum(p.is_byte(i) for i in range(p.get_piece_size()))


def piece_model(path: str, corpus_share: float = 0.0) -> PieceModel:
    """The vocabulary's pieces weighted by its stored scores, normalised to what ``corpus_share`` leaves."""
    stored, n_bytes = existing_scores(path)
    # words hold no A-Z, so pieces with them are on no path
    stored = {k: w for k, w in stored.items() if not _CAPITAL.search(k)}
    mass, left = sum(stored.values()), math.log(1 - corpus_share)
    plain = left + math.log((1 - BYTE_SHARE - END_SHARE) / mass)
    return PieceModel({k: plain + math.log(w) for k, w in stored.items()}, [left + math.log(BYTE_SHARE / max(1, n_bytes))] * 256, left + math.log(END_SHARE))


def count_words(docs: DataFrame) -> DataFrame:
    """Words of all texts and the ends, with their counts in texts that are not held out: (word, n)."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text, held_out in zip(column_bytes(batch), batch.column("held_out").to_pylist()):
                words = spaced_words(text)
                words.append(END.encode())
                counts.update(dict.fromkeys(words, 0) if held_out else words)
                if len(counts) > PARTIAL_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("text", "held_out").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_lattice(counts: DataFrame, model) -> DataFrame:
    """(word, n, lattice): the log of each word's probability over all its segmentations."""

    def run(batches):
        pieces, held = model.value, []

        def out():
            words = [w for b in held for w in b.column("word").to_pylist()]
            logs = pieces.words(words)
            logs[[i for i, w in enumerate(words) if w == END]] = pieces.end
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.concat_arrays([b.column("n") for b in held]), pa.array(logs)], names=["word", "n", "lattice"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LATTICE_WORDS:
                yield out()
                held = []
        if held:
            yield out()

    return counts.mapInArrow(run, "word string, n long, lattice double")


def head_of(words: DataFrame, most: int) -> list:
    """The most frequent words, ``most`` of them at most: all words from some power of 2^(1/4) on."""
    level = F.floor(F.log2("n") * 4)
    sizes = {r["level"]: r["count"] for r in words.filter("n > 0").groupBy(level.alias("level")).count().collect()}
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    return words.filter("n > 0").filter(level >= least).collect() if least is not None else []


def seen_share(n: int, once: int) -> float:
    """Good and Turing's estimate of what known tokens have of all to come: n training tokens, of which ``once`` are there once."""
    return 1 - (once + 0.5) / (n + 1) if n else 0.0


def mixed_log(lattice: float, n: int, share: float, total: int) -> float:
    """Log of a token's probability: its lattice, weighted already, and the whole word's count."""
    return float(np.logaddexp(lattice, math.log(share * n / total))) if n and share else lattice


def score(
    df: DataFrame, held_out, pieces: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, corpus_share: float | None = None
) -> DataFrame:
    """Scores whole texts by word counts and by the subword lattice.

    held_out: a boolean Column of df; its rows (not those where it is null) are
    left out of the training texts.  ``corpus_share`` (below 1; 0 for the stored
    vocabulary alone) is what whole training words get as arcs beside the pieces;
    without it whole tokens are mixed by an estimate, see the module.
    Returns a row per input row: doc_id, held_out boolean, n_tokens, n_known,
    train_tokens long, base_score double (log10, add-0.1 over the distinct
    training tokens and one more), score double (log10).  A null or empty text
    is its end alone.  Without training texts no token is known.  Repeated rows
    and null ids are kept, and a repeated text counts as often as it stands
    there; words of equal count are all among the most frequent words or none
    of them.  Texts and words of any length are scored whole.  Other columns are
    not read; an empty table gives none.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "lm")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = piece_model(pieces, corpus_share or 0.0)
    words = stash.keep(with_lattice(count_words(docs), spark.sparkContext.broadcast(model)), "words")
    total, none = F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)
    n, v, once, ends = words.agg(total, F.count(F.when(F.col("n") > 0, 1)), F.count(F.when(F.col("n") == 1, 1)), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), none)).first()
    # an arc's share is in the pieces' own weights already
    share, rest = (seen_share(n, once), math.log(1 - seen_share(n, once))) if corpus_share is None else (corpus_share, 0.0)
    below = math.log10(n + 0.1 * (v + 1))
    head = head_of(words.filter(F.col("word") != END), head_words)
    logs = np.array([(math.log10(r["n"] + 0.1) - below, mixed_log(rest + r["lattice"], r["n"], share, n) / LN10) for r in head]).reshape(-1, 2)
    table = spark.sparkContext.broadcast(({r["word"].encode(): i for i, r in enumerate(head)}, logs))
    del head
    kind = docs.schema["doc_id"].dataType.simpleString()
    end_base, end_known, end_score = math.log10(ends + 0.1) - below, int(ends > 0), mixed_log(rest + model.end, ends, share, n) / LN10

    def run(batches):
        known, logs = table.value
        find = known.get
        for batch in batches:
            places, sizes, tails = [], [], []
            for text in column_bytes(batch):
                words = spaced_words(text)
                at = [find(w, -1) for w in words]
                places += at
                sizes.append(len(at))
                tails.append(Counter(w for w, i in zip(words, at) if i < 0) if -1 in at else {})
            at, owner = np.array(places, np.int64), np.repeat(np.arange(len(sizes)), sizes)
            at, owner = at[at >= 0], owner[at >= 0]
            total = lambda values: np.bincount(owner, values, len(sizes))  # noqa: B023, E731
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32)
            items = pa.StructArray.from_arrays(
                [pa.array([w for t in tails for w in t], pa.binary()).cast(pa.string()), pa.array([c for t in tails for c in t.values()], pa.int64())], names=["word", "tf"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "doc_id", "held_out")),
                    pa.array(np.array(sizes, np.int64) + 1),
                    pa.array(np.bincount(owner, minlength=len(sizes)) + end_known),
                    pa.array(total(logs[at, 0]) + end_base),
                    pa.array(total(logs[at, 1]) + end_score),
                    pa.ListArray.from_arrays(pa.array(offsets), items),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"],
            )

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:string,tf:long>>"
    scored = stash.keep(numbered.mapInArrow(run, schema), "scored")
    spelled, own = F.col("lattice") + rest, F.log(share * F.col("n") / F.lit(float(max(n, 1))))
    either = F.greatest(spelled, own) + F.log1p(F.exp(-F.abs(spelled - own)))
    rare = words.filter(F.col("word") != END).select(
        "word",
        (F.col("n") > 0).cast("long").alias("known"),
        (F.log10(F.col("n") + 0.1) - below).alias("base"),
        (F.when(F.col("n") > 0, either).otherwise(spelled) if share else spelled).alias("log"),
    )
    joined = spread_join(scored.select("row", F.inline("tail")), rare, ["word"]).groupBy("row").agg(
        F.sum(F.col("tf") * F.col("known")).alias("more_known"), F.sum(F.col("tf") * F.col("base")).alias("more_base"), (F.sum(F.col("tf") * F.col("log")) / LN10).alias("more_score")
    )
    more = lambda c, name, none: (F.col(c) + F.coalesce(name, F.lit(none))).alias(c)
    return scored.drop("tail").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", more("n_known", "more_known", 0), F.lit(n).cast("long").alias("train_tokens"), more("base_score", "more_base", 0.0), more("score", "more_score", 0.0)
    )
