"""Benchmark decontamination by a broadcast set of the benchmark's word windows.

The benchmark is read in blocks of bounded size.  A block's windows are sorted
hashes with the places where they stand, in arrays; documents are hashed window
by window in the same way, a bitmap and a search pick candidates, and the words
themselves confirm each.  A benchmark of one block (any usual one) takes one scan
and no shuffle.  Of more blocks one at a time is held and scanned for.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.storage import Stash, bounded_batches
from scanloom.llm.text import ALNUM_TABLE, id_and_text, row_batch, with_results
from scanloom.llm.word_hashes import NOT_ALNUM, WordHasher, runs

WINDOW = 13
#: Bytes of benchmark text in one broadcast block; beyond it there are more blocks.
BLOCK_BYTES = 16 << 20
_MARK_BITS = 22


class WindowSet:
    """The windows of some items, and where they occur in documents."""

    def __init__(self, items: list[tuple[object, bytes | None]]):
        texts = [text or b"" for _, text in items]
        #: ids as text; an item without an id is found but not named
        self.ids = [None if item_id is None else str(item_id) for item_id, _ in items]
        found = WordHasher(NOT_ALNUM).words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        self.data, self.words = found.data.tobytes(), found.hashes
        self.starts, self.ends, self.bounds = (a.astype(np.int32) for a in (found.starts, found.ends, found.bounds))
        counts = np.diff(found.bounds)
        #: by size: sorted hashes of the windows, the first word of each, and bits of the hashes that occur
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(counts[counts > 0], WINDOW)).tolist():
            if size == WINDOW:
                places = np.arange(len(self.words))
                places = places[places + size <= np.repeat(found.bounds[1:], counts)]
            else:
                places = found.bounds[:-1][counts == size]
            hashes, owners = runs(self.words, size)[places], self.items_at(places)
            order = np.lexsort((owners, hashes))
            hashes, owners, places = hashes[order], owners[order], places[order]
            # a window that an item repeats is held once
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))
            bits = np.zeros(1 << _MARK_BITS, bool)
            bits[_mark(hashes)] = True
            self.windows[size] = (hashes[new], places[new].astype(np.int32), np.packbits(bits))

    def items_at(self, places: np.ndarray) -> np.ndarray:
        """The numbers of the items in which these words stand."""
        return np.searchsorted(self.bounds, places, "right") - 1

    def held_words(self, place: int, size: int) -> list[bytes]:
        return [self.data[a:b].lower() for a, b in zip(self.starts[place : place + size].tolist(), self.ends[place : place + size].tolist())]


def _mark(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _MARK_BITS)).astype(np.int64)


class Finder:
    """Looks for a block's windows in columns of texts."""

    def __init__(self, held: WindowSet):
        self.held, self.hasher = held, WordHasher(NOT_ALNUM)
        self.bits = {size: np.unpackbits(packed).view(bool) for size, (_, _, packed) in held.windows.items()}

    def column(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, the stretches of hit words (end exclusive), and the sorted ids of the items."""
        out = []
        for _, found in self.hasher.column(texts):
            hits: dict[int, tuple[list, set]] = {}
            for size in self.held.windows:
                self._hits(found, size, hits)
            for k, n in enumerate(np.diff(found.bounds).tolist()):
                spans, items = hits.get(k, ((), ()))
                out.append((n, merge_spans(spans), sorted({self.held.ids[i] for i in items} - {None})))
        return out

    def _hits(self, found, size: int, hits: dict[int, tuple[list, set]]) -> None:
        """Adds the hits of windows of one size: text number -> stretches, item numbers."""
        held, (hashes, places, _) = self.held, self.held.windows[size]
        rolled = runs(found.hashes, size)
        at = np.flatnonzero(self.bits[size][_mark(rolled)])
        first = np.searchsorted(hashes, rolled[at])
        same = hashes[np.minimum(first, len(hashes) - 1)] == rolled[at]
        at, first = at[same], first[same]
        text = np.searchsorted(found.bounds, at, "right") - 1
        inside = at + size <= found.bounds[text + 1]
        at, first, text = at[inside], first[inside], text[inside]
        last = np.searchsorted(hashes, rolled[at], "right")
        for place, a, b, k in zip(at.tolist(), first.tolist(), last.tolist(), text.tolist()):
            own = places[a:b]
            own = own[(held.words[own[:, None] + np.arange(size)] == found.hashes[place : place + size]).all(1)]
            if len(own) and held.held_words(int(own[0]), size) == [found.data[x:y].tobytes().lower() for x, y in zip(found.starts[place : place + size], found.ends[place : place + size])]:
                spans, items = hits.setdefault(k, ([], set()))
                start = place - int(found.bounds[k])
                spans.append((start, start + size))
                items.update(held.items_at(own).tolist())


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (item id, text bytes) of bounded size each, streamed from the cluster."""
    items, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        text = row[1].encode() if row[1] else None
        if items and size + len(text or b"") > block_bytes:
            yield items
            items, size = [], 0
        items.append((row[0], text))
        size += len(text or b"")
    yield items


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    whole_rows: bool = False,
) -> DataFrame:
    """Marks the words of documents that lie in a window of the benchmark.

    Returns a row per input row: doc_id, n_words long, spans array of
    (start, stop) word positions, items array<string> (sorted), n_hit, n_items
    long, contaminated boolean.  A null or empty text has no words and is clean,
    as is every document when the benchmark is empty.  Items without words have
    no windows; repeated items count once by id; the windows of an item without
    an id hit, but it is in no list of items and not counted.  Overlapping
    stretches are joined.  A document of very many words is scanned whole.
    Repeated documents are kept row by row, and ``whole_rows`` adds them, with
    columns of any type, as a struct ``row``; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = id_and_text(docs, id_col, text_col, whole_rows)
    all_blocks = blocks(benchmark, item_id_col, item_text_col, block_bytes)
    first, second = next(all_blocks), next(all_blocks, None)
    if second is None:
        return kept.mapInArrow(_scan_block(spark.sparkContext.broadcast(WindowSet(first))), with_results(kept, FOUND))
    stash = Stash(spark, "windows")
    numbered = stash.keep(kept.withColumn("row_number", F.monotonically_increasing_id()), "documents")
    found = []
    for k, block in enumerate(chain([first, second], all_blocks)):
        held = spark.sparkContext.broadcast(WindowSet(block))
        hits = numbered.select("row_number", "text").mapInArrow(_hits_of_block(held), f"row_number long, {HITS}")
        # all rows once, for their number of words
        found.append(stash.keep(hits if k == 0 else hits.filter(F.size("spans") > 0), f"block-{k}"))
        held.destroy()
    merged = reduce(DataFrame.union, found).groupBy("row_number").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    rows = numbered.drop("text").join(merged, "row_number").drop("row_number")
    return rows.mapInArrow(_merged_hits, with_results(kept, FOUND))


HITS = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"
FOUND = f"{HITS}, n_hit long, n_items long, contaminated boolean"
Row = tuple[int, list[tuple[int, int]], list[str]]


def _hit_columns(rows: list[Row]) -> list[pa.Array]:
    return [
        pa.array([n for n, _, _ in rows], pa.int64()),
        pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans, _ in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        pa.array([items for _, _, items in rows], pa.list_(pa.string())),
    ]


def _found(batch: pa.RecordBatch, rows: list[Row]) -> pa.RecordBatch:
    hit = [sum(b - a for a, b in spans) for _, spans, _ in rows]
    judged = [pa.array(hit, pa.int64()), pa.array([len(items) for _, _, items in rows], pa.int64()), pa.array([h > 0 and 20 * h >= n for h, (n, _, _) in zip(hit, rows)], pa.bool_())]
    return row_batch(batch, ["n_words", "spans", "items", "n_hit", "n_items", "contaminated"], _hit_columns(rows) + judged)


def _scan_block(windows):
    def run(batches):
        finder = Finder(windows.value)
        for batch in batches:
            yield _found(batch, finder.column(batch.column("text")))

    return run


def _hits_of_block(windows):
    def run(batches):
        finder = Finder(windows.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row_number"), *_hit_columns(finder.column(batch.column("text")))], names=["row_number", "n_words", "spans", "items"])

    return run


def _merged_hits(batches):
    for batch in batches:
        rows = zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist())
        yield _found(batch, [(n, merge_spans([(s["start"], s["stop"]) for s in spans]), items) for n, spans, items in rows])


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text with the words of the spans, and what stands between them, cut out."""
    if not text or not spans:
        return text
    raw = text.encode()
    plain, bounds, at = raw.translate(ALNUM_TABLE), [], 0
    for w in plain.split():
        at = plain.index(w, at)
        bounds.append((at, at := at + len(w)))
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : bounds[a][0]])
        done = bounds[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def with_digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

