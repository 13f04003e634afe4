"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Per batch of texts: the suffix array by doubling, whose ranks at each length
2^k tell whether two stretches of that length are equal; LCP; the longest
previous factor of each position from both; and Lempel-Ziv blocks from that.  A
run that reaches over a block's border, or touches it, is found by extending
both ways from there, for each period that the lengths of the two blocks beside
it allow.  A run inside a block is a copy of one inside the block's earlier
occurrence, so runs are held in buckets by their start and copied.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.storage import bounded_batches
from scanloom.llm.text import column_bytes, id_and_text

#: A run repeats its period so many times at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: Words of the texts that are worked on together; a longer text is worked on alone.
BATCH_WORDS = 200_000


class Equal:
    """Tells how far stretches of a sequence agree, from ranks of all stretches of 2^k items.

    Items of different texts are different, so nothing goes on from one text to
    the next.  Ranks of a level take 4 bytes an item; there are as many levels as
    the longest repeated stretch has binary digits.
    """

    def __init__(self, items: np.ndarray):
        self.n = n = len(items)
        rank, step = self._first(items), 1
        self.levels = [rank]
        active = self._shared(rank)
        while len(active):
            after = np.where(active + step < n, rank[np.minimum(active + step, n - 1)] + 1, 0).astype(np.int64)
            key = rank[active].astype(np.int64) * (n + 2) + after
            order = np.argsort(key)
            active, key = active[order], key[order]
            old = rank[active]
            new_group, new_key = np.ones(len(key), bool), np.ones(len(key), bool)
            new_group[1:], new_key[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
            place = np.arange(len(key))
            first_of_group = np.maximum.accumulate(np.where(new_group, place, 0))
            first_of_key = np.maximum.accumulate(np.where(new_key, place, 0))
            rank = rank.copy()
            rank[active] = old + (first_of_key - first_of_group)
            self.levels.append(rank)
            step *= 2
            alone = new_key & np.append(new_key[1:], True)
            active = active[~alone]
        self.order = np.empty(n, np.int32)
        self.order[rank] = np.arange(n, dtype=np.int32)
        self.rank = rank

    @staticmethod
    def _first(items: np.ndarray) -> np.ndarray:
        """Ranks of single items: how many are smaller."""
        counts = np.bincount(items)
        return (np.cumsum(counts) - counts)[items].astype(np.int32)

    @staticmethod
    def _shared(rank: np.ndarray) -> np.ndarray:
        counts = np.bincount(rank, minlength=len(rank))
        return np.flatnonzero(counts[rank] > 1)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items agree from i on and from j on (i and j differ)."""
        i, j, n = i.astype(np.int64), j.astype(np.int64), self.n
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i + out, j + out
            same = (a < n) & (b < n)
            same &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
            out += same.astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items agree that end just before i and just before j."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i - out - (1 << k), j - out - (1 << k)
            same = (a >= 0) & (b >= 0)
            same &= rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)]
            out += same.astype(np.int64) << k
        return out


def previous_factors(equal: Equal) -> tuple[list[int], list[int]]:
    """Of each position, the longest stretch that also begins earlier, and where.

    Positions leave the suffix array from the last one of the text to the first;
    the neighbours that are left begin earlier, and the least LCP on the way to
    them is how far they agree.
    """
    n, order = equal.n, equal.order
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = equal.ahead(order[1:], order[:-1])
    lcp, rank, order = lcp.tolist(), equal.rank.tolist(), order.tolist()
    before, after = list(range(-1, n)), list(range(1, n + 2))
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        up, down, a, b = before[r], after[r], lcp[r], lcp[after[r]]
        if a >= b:
            length[i] = a
            if a:
                source[i] = order[up]
            lcp[down] = b
        else:
            length[i], source[i] = b, order[down]
            lcp[down] = a
        after[up], before[down] = down, up
    return length, source


def blocks_of(length: list[int]) -> np.ndarray:
    """Where Lempel-Ziv blocks begin, and the end of the sequence."""
    starts, i, n = [], 0, len(length)
    while i < n:
        starts.append(i)
        i += length[i] or 1
    return np.array([*starts, n], np.int64)


def find(items: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence of numbers, by start, then period.

    The numbers of a text stand in no other text of the sequence.
    """
    none = np.zeros(0, np.int64)
    equal = Equal(items) if len(items) else None
    if equal is None or len(equal.levels) == 1:
        return none, none, none
    length, source = previous_factors(equal)
    b = blocks_of(length)
    # A run that begins before border b, or there, and ends in the block from b to e begins
    # less than a period before c, where the block before b begins: that one would go on otherwise.
    # So its period, (times - 1)-fold, is less than e - c.
    c, e = np.append(0, b[:-1]), np.append(b[1:], b[-1])
    most = np.maximum(0, (e - c - 1) // (times - 1))
    at = np.repeat(b, most)
    period = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
    # the run holds the place one period before the last word before b, or b itself, each with the place a period later
    sides = [_extended(items, equal, place, period, times, least) for place in (at - period - 1, at)]
    start, end, period = _smallest_periods(*map(np.concatenate, zip(*sides)))
    if len(start):
        start, end, period = _copied(start, end, period, b.tolist(), [*source, 0], least)
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _extended(items: np.ndarray, equal: Equal, at: np.ndarray, period: np.ndarray, times: int, least: int) -> tuple[np.ndarray, ...]:
    """Start, end and period of the stretches that hold ``at`` and the place one period later, where they are long enough."""
    inside = (at >= 0) & (at + period < len(items))
    at, period = at[inside], period[inside]
    same = items[at] == items[at + period]
    at, period = at[same], period[same]
    start, end = at - equal.behind(at, at + period), at + period + equal.ahead(at, at + period)
    long_enough = end - start >= np.maximum(least, times * period)
    return start[long_enough], end[long_enough], period[long_enough]


def _smallest_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each stretch its smallest period; the others are multiples of it."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def _copied(start: np.ndarray, end: np.ndarray, period: np.ndarray, border: list[int], source: list[int], least: int) -> tuple[np.ndarray, ...]:
    """The runs at borders, and those inside of blocks: copies of runs inside of the blocks' earlier occurrences."""
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, j, p in zip(start.tolist(), end.tolist(), period.tolist()):
        buckets[i].append((j, p))
    first, copies = min(buckets), []
    for b, e in zip(border, border[1:]):
        back = b - source[b]
        if e - b < least + 2 or e - 1 - back <= first:
            continue
        for i in range(max(b + 1, first + back), e - least):
            for j, p in buckets.get(i - back, ()):
                if j + back < e:
                    buckets[i].append((j + back, p))
                    copies.append((i, j + back, p))
    more = np.array(copies, np.int64).reshape(-1, 3).T
    return tuple(np.concatenate(x) for x in zip((start, end, period), more))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, one text after the other with numbers of its own, and where each text begins."""
    items, bounds, used = [], [0], 0
    for words in texts:
        known: dict[bytes, int] = {}
        number = known.setdefault
        items.append(np.array([number(w, len(known)) for w in words], np.int64) + used)
        used += len(known)
        bounds.append(bounds[-1] + len(words))
    return np.concatenate(items) if items else np.zeros(0, np.int64), np.array(bounds, np.int64)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period."""
    kept, done = [], 0
    for first, last in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[done : max(done, first)]
        done = max(done, last)
    return b" ".join(kept + words[done:] if runs else words)


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """Finds the runs of words of whole texts.

    Words are cut at ASCII white space and numbered from 0.  A run is a stretch
    with smallest period p, of ``times`` periods (3 at least) and ``least`` words
    or more, that no neighbouring word extends; runs may overlap.  Returns a row
    per input row: doc_id, n_words long, runs array<struct<start long, length
    long, period long>> by start, then period, collapsed string (the words that
    stand in no run after its first period, with a space between two).  A null or
    empty text has no words, no runs and collapses to the empty text.  A text is
    worked on whole, in memory of some 4 bytes a word for each binary digit of its
    longest repeated stretch, and 150 bytes a word besides.  Repeated rows and
    null ids are kept; other columns are not read; an empty table gives none.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found")
    bounded_batches(df.sparkSession)

    def of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        items, bounds = numbered(texts)
        start, length, period = find(items, times, least)
        text = np.searchsorted(bounds, start, "right") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, run in zip(text.tolist(), zip((start - bounds[text]).tolist(), length.tolist(), period.tolist())):
            out[k].append(run)
        return out

    def run(batches):
        for batch in batches:
            texts = [t.split() if t else [] for t in column_bytes(batch)]
            ends = np.cumsum([len(t) for t in texts])
            found, first = [], 0
            while first < len(texts):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + BATCH_WORDS, "right")))
                found += of_texts(texts[first:last])
                first = last
            flat = [np.array(c, np.int64) for c in zip(*(r for runs in found for r in runs))] or [np.zeros(0, np.int64)] * 3
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(map(pa.array, flat)), ["start", "length", "period"]))
            kept = pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), runs, kept], names=["doc_id", "n_words", "runs", "collapsed"])

    kept = id_and_text(df, id_col, text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_digests(found: DataFrame) -> DataFrame:
    """Of each row the number of runs, the longest run (ties: least start, then period), and digests of all runs and of the collapsed text."""
    key = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), key.alias("best"), lines.alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.p").alias("period"),
        F.expr("1000L * best.length div best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
