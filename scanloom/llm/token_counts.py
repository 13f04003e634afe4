"""Token counts at every prefix of a text, by dynamic programming.

For a word of m symbols, ``last[i]`` is the last token of the encoding of the
first i symbols and ``count[i]`` its number of tokens.  A token ending at i is
the last one exactly when it may stand after ``last[j]``, j being its start:
a sequence is the BPE encoding of its text when every two neighbours are the
encoding of theirs.  So each prefix is extended from a shorter one and no
prefix is encoded again.  A text's prefixes add the counts of the words before.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm.bpe import NO_RANK, BoundedCache, NumberCache, WordBpe, byte_symbols, load
from scanloom.llm.storage import bounded_batches
from scanloom.llm.text import id_and_text


class PrefixCounter:
    """Exact counts at every prefix, for one vocabulary."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.made: dict[int, tuple[int, int, int]] = {}
        for pair, rank in bpe.rank.items():
            self.made.setdefault(bpe.merged[rank], (rank, pair >> 16, pair & 0xFFFF))
        inner = [(name, t) for name, t in bpe.vocab.items() if not name.endswith(bpe.end) or name == bpe.end]
        final = [(name[: -len(bpe.end)], t) for name, t in bpe.vocab.items() if name.endswith(bpe.end) and name != bpe.end]
        self.inner, self.final = dict(map(self.spelled, inner)), dict(map(self.spelled, final))
        self.longest = max(map(len, chain(self.inner, self.final)))
        self.follows = NumberCache(self.compatible, 160 << 20)
        self.cache = BoundedCache(self.word_counts, 32 << 20)
        self.words = BoundedCache(lambda w: self.finish(w.encode(), *self.states(w.encode())))
        self.chunks = BoundedCache(lambda c: sum(map(self.words.__getitem__, bpe.words(c))))

    @staticmethod
    def spelled(item: tuple[str, int]) -> tuple[bytes, int]:
        """A token under the bytes of its text."""
        return bytes(map(_byte_of().__getitem__, item[0])), item[1]

    def compatible(self, pair: int) -> bool:
        """Whether two tokens stay apart when their joint text is encoded.

        The later of the two merges that made them is undone step by step; a
        merge across the border that comes before it would have come first.
        """
        left, right = pair >> 16, pair & 0xFFFF
        rank, made, limit = self.bpe.rank.get, self.made.get, NO_RANK
        while True:
            # across the border the leftmost of equal ranks comes first, so a
            # merge on the left wins a tie and one on the right loses it
            if rank(left << 16 | right, NO_RANK) < limit:
                return False
            a, b = made(left, (-1, 0, 0)), made(right, (-1, 0, 0))
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def states(self, raw: bytes) -> tuple[list[int], list[int]]:
        """Counts and last tokens of the prefixes of a word that goes on after them."""
        count, last, follows, inner, longest = [0], [-1], self.follows, self.inner.get, self.longest
        for i in range(1, len(raw)):
            for j in range(max(0, i - longest), i):
                t = inner(raw[j:i])
                if t is not None and (not j or follows[last[j] << 16 | t]):
                    count.append(count[j] + 1)
                    last.append(t)
                    break
        return count, last

    def finish(self, raw: bytes, count: list[int], last: list[int]) -> int:
        """Tokens of a word that ends here, from the states before its end."""
        follows, final, i = self.follows, self.final.get, len(raw)
        for j in range(max(0, i - self.longest), i):
            t = final(raw[j:])
            if t is not None and (not j or follows[last[j] << 16 | t]):
                return count[j] + 1
        raise ValueError(raw)

    def word_counts(self, word: str) -> np.ndarray:
        """Tokens of the first 1, 2, ... characters of a word, each taken as a whole word."""
        raw = word.encode()
        count, last = self.states(raw)
        stops = accumulate(len(c.encode()) for c in word)
        return np.array([self.finish(raw[:i], count, last) for i in stops], np.int32)

    def total(self, text: str | None) -> int:
        """Tokens of the whole text: its last prefix."""
        if not text:
            return 0
        bpe, found = self.bpe, self.chunks.__getitem__
        return sum(1 if special else sum(map(found, bpe.pieces(bpe.normal(part)))) for special, part in bpe.segments(text))

    def prefixes(self, word: str) -> np.ndarray:
        """As word_counts; a cut contraction is cut into words anew."""
        if word[0] == "'" and word[1:].isalpha():
            return np.array([self.total(word[:k]) for k in range(1, len(word) + 1)])
        return self.cache[word]

    def cut(self, text: str, budget: int) -> int:
        """As PrefixTable.cut, looking into no other word than the one in which the budget ends.

        A prefix has at least a token more than the words before the one it
        ends in, so the longest one ends in, or just before, the last word that
        starts below the budget.
        """
        bpe = self.bpe
        if any(s in text for s in bpe.special):
            return self.table(text).cut(budget)
        normal, total, last = bpe.normal(text), 0, None
        for m in bpe.words.__self__.finditer(normal):
            if total >= budget:
                break
            last = m, total
            total += self.words[m[0]]
        else:
            if total <= budget:
                return len(normal)
            m = None
        if last is None:
            return m.start() if m else len(normal)
        word, before = last
        if total <= budget:
            return m.start()
        fits = np.flatnonzero(before + self.prefixes(word[0]) <= budget)
        return word.start() + (int(fits[-1]) + 1 if len(fits) else 0)

    def table(self, text: str | None) -> PrefixTable:
        return PrefixTable(self, text or "")


class PrefixTable:
    """Counts at every prefix of one text, in characters of the text as the vocabulary sees it
    (NFC and lower case; special strings as written)."""

    def __init__(self, counter: PrefixCounter, text: str):
        # before: the stretch of ordinary text without a space that a special string follows, and the tokens before it
        bpe, shown, sums, before = counter.bpe, [], 0, ("", 0)
        counts = [np.zeros(1, np.int64)]
        for special, part in bpe.segments(text):
            if special:
                # a cut special string is ordinary text, and goes with the stretch before it; nothing else is encoded again
                own = np.array([before[1] + counter.total(before[0] + part[:k]) for k in range(1, len(part))] + [sums + 1])
                sums, before = sums + 1, ("", sums + 1)
            else:
                part, start, done = bpe.normal(part), sums, 0
                own = np.zeros(len(part), np.int64)
                for m in bpe.words.__self__.finditer(part):
                    own[done : m.start()] = sums
                    own[m.start() : m.end()] = sums + counter.prefixes(m[0])
                    sums, done = int(own[m.end() - 1]), m.end()
                own[done:] = sums
                stretch = bpe.pieces(part)[-1:] if part and not part[-1].isspace() else []
                at = len(part) - len(stretch[0]) if stretch else len(part)
                before = (part[at:], int(own[at - 1]) if at else start)
            counts.append(own)
            shown.append(part)
        self.text, self.counts = "".join(shown), np.concatenate(counts)

    def at(self, length: int) -> int:
        """Tokens of the first ``length`` characters."""
        return int(self.counts[length])

    def cut(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    return {s: b for b, s in enumerate(byte_symbols())}


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(load(path))


def count_tokens(
    df: DataFrame, tokenizer: str, budget: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts the tokens of whole texts and finds where each would be cut.

    Returns a row per input row: doc_id, n_bytes long (UTF-8), n_tokens long,
    cut_chars long (characters of the longest prefix within ``budget`` tokens,
    of the text in the vocabulary's normal form; null where the whole text
    fits; of prefixes with equal counts the longest).  A null text counts as
    empty: 0 bytes, 0 tokens.  Texts of any length are counted whole.  Repeated
    rows and null ids are kept; other columns of the input are not read; an
    empty table gives none.

    Words are counted once and their counts added up along a text; the prefixes
    of a word are counted where a budget ends in it.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            totals = [count.total(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([count.cut(t, budget) if n > budget else None for t, n in zip(texts, totals)], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "cut_chars"],
            )

    kept = id_and_text(df, id_col, text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, cut_chars long")
