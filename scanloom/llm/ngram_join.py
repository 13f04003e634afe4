"""Jaccard join of word n-grams with a count-vector R-tree.

1. A scan gives each document the size and the digest of its shingle set, and
   finds the shingles that stand in many documents.
2. A linked pair shares one of the first n - ceil(0.8 n) + 1 shingles of either
   set, in any order that all sets use; here those of rare words come first and
   frequent shingles last.  Of the documents with such a shingle whose sizes can
   be linked, the first is the pivot, and the others join the pivot's block.  So every linked pair
   meets in a block, and texts that share no more than a common passage, or
   common words by chance, seldom do.
3. In a block, sets are points in an R-tree (see count_rtree): their shingles
   are hashed into groups, and the bound on the overlap picks candidates.  This
   is done on the points alone first, so that only sets with a candidate are
   fetched; then the sets themselves verify.  Only links that join two
   components go on.
4. A block too large for one task is first compared with its pivot, in the same
   way; then the sets that the pivot has not caught meet all the others, in parts.
5. Components of the links.

Equal sets stand as one node, numbered by the smallest id that has the set; where
that id stands on several rows, by a hash of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.llm.components import connected_components
from scanloom.llm.count_rtree import linked_with, packed_point, spanning_links, with_candidates
from scanloom.llm.spread import spread_join
from scanloom.llm.storage import Stash, bounded_batches
from scanloom.llm.word_hashes import WordHasher, mixed, runs

WORDS = 5
PART, WHOLE = 80, 100
#: Shingles that every worker knows as frequent, at most; the order of the others is by hash.
FREQUENT = 200_000
#: Words whose frequency every worker knows, at most; any other counts as rare.
FREQUENT_WORDS = 100_000
#: A task looks for frequent shingles among so many at once, and reports those of so many documents.
COUNTED_AT_ONCE, REPORTED_FROM = 4_000_000, 4
#: Uses of a word among so many shingles from which a task reports it.
WORDS_REPORTED_FROM = 16
#: Shingles in one part of a block (32 MB of hashes).
BLOCK_SHINGLES = 4_000_000
#: Ids that stand for no set of their own that every worker is told, at most; beyond it they are joined away.
SKIPPED_TOLD = 1 << 20
#: Bits of the bitmap of documents whose sets are fetched: for each of them, and at most (2 to this power, 8 MB); and how many it serves.
BITS_PER_ID, MARK_BITS, MARKED_MOST = 64, 26, 1 << 23


class Shingler:
    """Sets of hashed n-grams of whole texts, many texts at once."""

    def __init__(self, words: int = WORDS):
        self.words, self.hasher = words, WordHasher()
        #: hashes of the words seen, kept if this is a list
        self.seen: list[np.ndarray] | None = None
        #: sorted hashes of frequent words and their weights; with them sets come with weights
        self.common: tuple[np.ndarray, np.ndarray] | None = None

    def batch(self, column: pa.Array) -> list:
        """For each text the sorted distinct hashes; a shorter text has its whole sequence as one, no text none.

        With common words: for each text the hashes and the n-grams' weights,
        sums over their words, of which rare ones have none.
        """
        return [s for _, found in self.hasher.column(column) for s in self._sets(found.hashes, found.bounds)]

    def _sets(self, w: np.ndarray, at: np.ndarray) -> list:
        if self.seen is not None:
            self.seen.append(w)
        grams, heavy, totals = runs(w, self.words), None, None
        if self.common:
            heavy = _weights(w, *self.common)
            totals = np.convolve(heavy, np.ones(self.words, np.int64), "valid") if len(w) >= self.words else heavy
        out = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            many = j - i >= self.words
            own = grams[i : j - self.words + 1] if many else runs(w[i:j], j - i) if j > i else w[:0]
            if not self.common:
                own = np.sort(own)
                out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own)
                continue
            order = np.argsort(own)
            weigh = (totals[i : j - self.words + 1] if many else np.full(len(own), heavy[i:j].sum()))[order]
            own = own[order]
            new = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
            out.append((own[new], weigh[new]))
        return out


def _weights(keys: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of each key, 0 for those that are not known; ``known`` is sorted."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, weights[at], 0)


def prefix_size(n: int, part: int = PART, whole: int = WHOLE) -> int:
    """Of n tokens in a common order, how many must hold a shared one of any linked pair."""
    return n - -(-part * n // whole) + 1 if n else 0


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set, in two columns."""
    return np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed=k) for k in (1, 2)] for s in sets], np.uint64).reshape(-1, 2)


SCANNED = ["doc_id", "n", "h1", "h2", "point", "key", "word", "count"]


def _counted(gathered: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur ``least`` times or more, with their counts."""
    keys = np.concatenate(gathered) if gathered else np.zeros(0, np.uint64)
    keys.sort()
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(keys)))
    return keys[starts[counts >= least]], counts[counts >= least].astype(np.int64)


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """Per document its set's size, digest and point; and frequent shingles and words with counts (partial)."""

    def run(batches):
        shingler, gathered, held = Shingler(words), [], 0
        shingler.seen = []

        def frequent():
            for name, values, least in (("key", gathered, REPORTED_FROM), ("word", shingler.seen, WORDS_REPORTED_FROM)):
                keys, counts = _counted(values, least)
                columns = {name: _signed(keys), "count": pa.array(counts)}
                kinds = [pa.binary() if c == "point" else pa.int64() for c in SCANNED]
                yield pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(keys), k)) for c, k in zip(SCANNED, kinds)], names=SCANNED)

        for batch in batches:
            sets = shingler.batch(batch.column("text"))
            digests = _digests(sets)
            none = pa.nulls(len(sets), pa.int64())
            points = pa.array([packed_point(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed(digests[:, 0].copy()), _signed(digests[:, 1].copy()), points, none, none, none], names=SCANNED)
            gathered += sets
            held += sum(map(len, sets))
            if held >= COUNTED_AT_ONCE:
                yield from frequent()
                gathered, shingler.seen, held = [], [], 0
        yield from frequent()

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, point binary, key long, word long, count long")


def _frequent(scanned: DataFrame, column: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles or words, sorted, with their counts: the ``most`` most frequent at most."""
    counts = scanned.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.sum("count").alias("n"))
    level = F.floor(F.log2("n") * 4)
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.filter(level >= least).select("key", "n").toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order]


def _prefix_keys(docs: DataFrame, frequent, skipped, words: int, part: int, whole: int, wanted: bool) -> DataFrame:
    """(key, n, doc_id): the rarest shingles of each document; ``wanted`` picks the frequent or the other ones."""

    def run(batches):
        shingler, (common, counts, shingler_words) = Shingler(words), frequent.value
        shingler.common = shingler_words
        for batch in batches:
            if skipped:
                batch = batch.filter(pa.array(~_within(batch.column("doc_id").to_numpy(zero_copy_only=False), skipped.value)))
            if not batch.num_rows:
                continue
            out, owners = [], []
            for doc_id, (s, heavy) in zip(batch.column("doc_id").to_pylist(), shingler.batch(batch.column("text"))):
                rank = _weights(s, common, counts)
                first = np.lexsort((s, heavy, rank))[: prefix_size(len(s), part, whole)]
                chosen = s[first[(rank[first] > 0) == wanted]]
                out.append(chosen)
                owners.append((doc_id, len(s), len(chosen)))
            keys = np.concatenate(out) if out else np.zeros(0, np.uint64)
            spread = lambda values, kind: pa.array(np.repeat(np.array(values, kind), [k for _, _, k in owners]))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([_signed(keys), spread([n for _, n, _ in owners], np.int32), spread([i for i, _, _ in owners], np.int64)], names=["key", "n", "doc_id"])

    return docs.mapInArrow(run, "key long, n int, doc_id long")


def _within(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ids are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids


PAIRS = ["doc", "n", "pivot", "pivot_n"]


def _pivot_pairs(part: int, whole: int):
    """From rows sorted by key, size and document: each document with the first one of its run.

    A run ends with the key, and where the next size is too large for a link
    with any document before it.
    """

    def run(batches):
        last, size, pivot, found, held = None, 0, (0, 0), [], 0

        def out():
            pairs = np.concatenate(found, axis=1)
            pairs = pairs[:, np.lexsort(pairs)]
            new = np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(0))
            return pa.RecordBatch.from_arrays([pa.array(column[new]) for column in pairs], names=PAIRS)

        for batch in batches:
            keys, sizes, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "doc_id"))
            if not len(keys):
                continue
            sizes = sizes.astype(np.int64)
            before = np.append(size, sizes[:-1])
            starts = np.append(keys[0] != last, keys[1:] != keys[:-1]) | (part * sizes > whole * before)
            at = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
            pivots, pivot_sizes = np.where(at < 0, pivot[0], docs[at]), np.where(at < 0, pivot[1], sizes[at])
            last, size, pivot = keys[-1], sizes[-1], (pivots[-1], pivot_sizes[-1])
            other = docs != pivots
            if other.any():
                found.append(np.stack([docs[other], sizes[other], pivots[other], pivot_sizes[other]]))
                held += int(other.sum())
            if held > 500_000:
                yield out()
                found, held = [], 0
        if found:
            yield out()

    return run


def _marks(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte of a bitmap of ``size`` bytes (a power of 2) and the bit in it of each id."""
    at = (mixed(ids.view(np.uint64)) >> np.uint64(65 - (8 * size).bit_length())).astype(np.int64)
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def _is_marked(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    byte, bit = _marks(ids, len(bits))
    return (bits[byte] & bit) > 0


def _bitmap(ids: DataFrame, n: int) -> np.ndarray:
    """Bits of all ids, of which there are ``n``; its size is in proportion to them, up to a bound."""
    size = 1 << min(MARK_BITS, max(10, (BITS_PER_ID * n).bit_length())) >> 3

    def run(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            np.bitwise_or.at(bits, *_marks(batch.column(0).to_numpy(zero_copy_only=False), size))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size, np.uint8)
    for row in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int, marked_most: int) -> DataFrame:
    """(doc, tokens) of the documents wanted.

    Up to ``marked_most`` of them, each scan task is given a bitmap of their ids and
    hands on few others, so that texts stay where they are; beyond it texts are
    joined to the ids first.
    """
    marks, n = None, wanted.count()
    if n <= marked_most:
        marks = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, n))
    else:
        docs = docs.join(wanted, "doc_id", "left_semi")

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            if marks:
                batch = batch.filter(pa.array(_is_marked(marks.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingler.batch(batch.column("text"))], pa.binary())], names=["doc", "tokens"])

    found = docs.mapInArrow(run, "doc long, tokens binary")
    return found.join(wanted.withColumnRenamed("doc_id", "doc"), "doc", "left_semi")


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def jaccard_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    part: int = PART,
    whole: int = WHOLE,
    frequent_shingles: int = FREQUENT,
    frequent_words: int = FREQUENT_WORDS,
    block_shingles: int = BLOCK_SHINGLES,
    skipped_told: int = SKIPPED_TOLD,
    marked_most: int = MARKED_MOST,
) -> DataFrame:
    """Groups documents whose n-gram sets have a Jaccard similarity of part/whole or more, and their neighbours in turn.

    Ids are integers.  Returns a row per input row: doc_id, n_shingles long,
    component_id long (smallest id that links reach, the own one included).  A
    null, empty or wordless text has an empty set and is linked with nothing; a
    text of fewer words than ``words`` has its whole sequence as one, a very long
    one all of its shingles.  Rows with a null id are linked with nothing and
    have a null component.  Repeated rows are linked as equal sets are; of an id
    on rows with different texts each row has the links of its own text.  A
    similarity of exactly part/whole is a link.  Other columns are not read; an
    empty table gives none.

    ``skipped_told`` and ``marked_most`` bound what workers are told by
    broadcast; beyond them joins do the same.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = _grouped(docs, Stash(df.sparkSession, "ngram"), words, part, whole, frequent_shingles, frequent_words, block_shingles, skipped_told, marked_most)
    return found.select("doc_id", "n_shingles", "component_id")


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, part: int = PART, whole: int = WHOLE, marked_most: int = MARKED_MOST) -> DataFrame:
    """The rows of ``df`` without near copies: of each group of linked rows the one of smallest id stays.

    Groups are those of jaccard_groups.  Of several rows of the smallest id in a
    group the one of least text stays (any of those of equal text).  Rows
    without an id or without words are no copies and stay as they are.

    Only rows whose id is among those to be decided are shuffled: a scan passes
    all others on by a bitmap of these ids, as long as it serves them.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "copies")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stash.keep(_grouped(docs, stash, words, part, whole, FREQUENT, FREQUENT_WORDS, BLOCK_SHINGLES, SKIPPED_TOLD, marked_most), "grouped")
    named = found.filter("doc_id IS NOT NULL")
    ids = named.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") != F.col("component_id")).alias("copy"))
    touched = stash.keep(ids.filter("copy OR rows > 1").select("doc_id", (F.col("rows") > 1).alias("several")), "touched")
    n_touched = touched.count()
    marks = spark.sparkContext.broadcast(_bitmap(touched.select("doc_id"), n_touched)) if n_touched <= marked_most else None

    def marked(wanted: bool):
        def run(batches):
            for batch in batches:
                column = batch.column("doc_id")
                hit = column.is_valid().to_numpy(zero_copy_only=False)
                if marks:
                    hit = hit & _is_marked(marks.value, column.fill_null(0).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit == wanted))

        return run

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    untouched = rows.mapInArrow(marked(False), rows.schema)
    looked_at = rows.mapInArrow(marked(True), rows.schema).join(touched, "doc_id", "left")
    text = F.col("row").getField(text_col)
    kept = looked_at.filter("several IS NULL").select("doc_id", "row")
    if not touched.filter("several").isEmpty():
        keep = named.filter("n_shingles > 0 AND doc_id = component_id").select("doc_id", "h1", "h2", "component").distinct()

        def digested(batches):
            shingler = Shingler(words)
            for batch in batches:
                sets = shingler.batch(batch.column("text"))
                digests = _digests(sets)
                yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "row")), _signed(digests[:, 0].copy()), _signed(digests[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "row", "h1", "h2", "n"])

        again = looked_at.filter("several").select("doc_id", "row", text.alias("text"))
        schema = StructType([f for f in again.schema if f.name != "text"]).add("h1", "long").add("h2", "long").add("n", "long")
        again = again.mapInArrow(digested, schema)
        least = again.filter("n > 0").join(keep, ["doc_id", "h1", "h2"]).groupBy("doc_id", "component").agg(F.min_by("row", text).alias("row"))
        kept = kept.union(again.filter("n = 0").select("doc_id", "row")).union(least.select("doc_id", "row"))
    # a single row of a touched id is a copy
    return untouched.union(kept).select("row.*")


def _grouped(docs: DataFrame, stash: Stash, words: int, part: int, whole: int, frequent_shingles: int, frequent_words: int, block_shingles: int, skipped_told: int, marked_most: int) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, component, component_id) per row: the digest of its set, its component's node and smallest id."""
    spark = docs.sparkSession
    scanned = stash.keep(_scan(docs, words), "scan")
    known, uses = _frequent(scanned, "word", frequent_words)
    frequent = spark.sparkContext.broadcast((*_frequent(scanned, "key", frequent_shingles), (known, (4 * np.log2(uses)).astype(np.int64))))
    sized = scanned.filter(F.col("n").isNotNull()).select("doc_id", "n", "h1", "h2")
    held = sized.filter("n > 0 AND doc_id IS NOT NULL")

    # one node for each set; ids of several rows number none
    several = stash.keep(held.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    labels = held.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("label"))
    marked = labels.join(several.select(F.col("doc_id").alias("label"), F.lit(True).alias("shared")), "label", "left")
    nodes = marked.select("h1", "h2", "n", "label", F.when(F.col("shared"), F.xxhash64("h1", "h2", "n")).otherwise(F.col("label")).alias("node"))
    same = stash.keep(spread_join(held, nodes, ["h1", "h2", "n"]).select("doc_id", "h1", "h2", "node", "label", "n"), "same")
    named = _texts_of_nodes(docs, same, several, words)

    # rows that number no node are passed over; of equal sets one stands for all
    skipped = same.filter("doc_id <> node").select("doc_id").distinct()
    told, n_skipped = None, skipped.count()
    if n_skipped > skipped_told:
        named = named.join(skipped, "doc_id", "left_anti")
    elif n_skipped:
        told = spark.sparkContext.broadcast(np.sort(skipped.toArrow().column("doc_id").to_numpy()))

    # frequent keys are aggregated where they are; the others are sorted by key
    rare = _prefix_keys(named, frequent, told, words, part, whole, False)
    pairs = rare.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(_pivot_pairs(part, whole), "doc long, n long, pivot long, pivot_n long")
    common = _prefix_keys(named, frequent, told, words, part, whole, True)
    pivots = common.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("first")).select("key", F.col("first.doc_id").alias("pivot"), F.col("first.n").alias("pivot_n"))
    # no more keys than there are frequent shingles
    met = common.join(F.broadcast(pivots), "key").filter("doc_id <> pivot").select(F.col("doc_id").alias("doc"), "n", "pivot", "pivot_n")
    pairs = stash.keep(pairs.union(met).distinct(), "pairs")
    frequent.destroy()
    if told:
        told.destroy()
    members = pairs.select(F.col("pivot").alias("block"), "doc", "n").union(pairs.select("pivot", "pivot", "pivot_n")).distinct()
    members = stash.keep(members, "members")
    stash.drop("pairs")

    # the points are a small part of the sets; sets that no other point in their block comes near go no further
    sizes = members.groupBy("block").agg(F.sum("n").alias("tokens"))
    points = _points_of_nodes(scanned, same)
    small = members.join(sizes.filter(F.col("tokens") <= block_shingles).select("block"), "block").join(points.hint("merge"), "doc")
    near = stash.keep(small.groupBy("block").applyInArrow(lambda t: _near_points(t, part, whole), "block long, doc long"), "near")
    wide = members.join(sizes.filter(F.col("tokens") > block_shingles).select("block"), "block")
    wanted = near.select(F.col("doc").alias("doc_id")).union(wide.select("doc")).distinct()
    sets = stash.keep(_sets(named, wanted, words, marked_most), "sets")
    tasks = near.select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), "doc", F.lit(True).alias("indexed"), F.lit(True).alias("asks"))
    large = sizes.filter(F.col("tokens") > block_shingles)
    links = None
    if not large.isEmpty():
        starred = stash.keep(_compared_with_pivot(wide, sets, part, whole), "starred")
        links = starred.filter("linked AND doc <> block").select(F.col("block").alias("u"), F.col("doc").alias("v"))
        parts = starred.groupBy("block").agg(
            F.ceil(F.sum("n") / block_shingles).cast("int").alias("all_parts"),
            F.ceil(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("n"))), F.lit(0)) / block_shingles).cast("int").alias("left_parts"),
        ).filter("left_parts > 0")
        dealt = starred.join(parts, "block").withColumn("deal", F.xxhash64("doc"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        index_rows = dealt.withColumn("j", upto("left_parts")).select("block", F.expr("pmod(deal, all_parts)").cast("int").alias("i"), "j", "doc", F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
        ask_rows = dealt.filter(~F.col("linked")).withColumn("i", upto("all_parts")).select("block", "i", F.expr("pmod(deal, left_parts)").cast("int").alias("j"), "doc", F.lit(False).alias("indexed"), F.lit(True).alias("asks"))
        tasks = tasks.union(index_rows).union(ask_rows)

    def join_block(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        # a set that is indexed and asks in one part stands there once
        at: dict[int, int] = {}
        indexed, asks, tokens = [], [], []
        for doc, raw, a, b in zip(rows["doc"], rows["tokens"], rows["indexed"], rows["asks"]):
            k = at.setdefault(doc, len(at))
            if k == len(tokens):
                indexed.append(a)
                asks.append(b)
                tokens.append(_array(raw))
            else:
                indexed[k], asks[k] = indexed[k] or a, asks[k] or b
        ids = list(at)
        found = spanning_links(tokens, np.array(indexed), np.array(asks), part, whole)
        return pa.table({"u": pa.array([ids[a] for a, _ in found], pa.int64()), "v": pa.array([ids[b] for _, b in found], pa.int64())})

    joined = tasks.join(sets.hint("merge"), "doc").groupBy("block", "i", "j").applyInArrow(join_block, "u long, v long")
    links = stash.keep(joined if links is None else joined.union(links), "links")
    groups = connected_components(links, stash)
    for label in ("sets", "members", "near", "links"):
        stash.drop(label)
    # a component is named by the smallest id of its sets
    of_nodes = same.select("node", "label").distinct().join(groups, "node", "left").select("node", "label", F.coalesce("component", "node").alias("component"))
    of_nodes = stash.keep(of_nodes, "nodes")
    names = of_nodes.groupBy("component").agg(F.min("label").alias("component_id"))
    of_nodes = spread_join(of_nodes, names, ["component"]).select("node", "component", "component_id")
    found = spread_join(same, of_nodes, ["node"]).select("doc_id", "h1", "h2", F.col("n").alias("n_shingles"), "component", "component_id")
    rest = sized.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "h1", "h2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component"), F.col("doc_id").alias("component_id"))
    return found.union(rest)


def _texts_of_nodes(docs: DataFrame, same: DataFrame, several: DataFrame, words: int) -> DataFrame:
    """(doc_id, text): the rows with a text, and one row under its own number for each node numbered by a hash."""
    named = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if several.isEmpty():
        return named

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            sets = shingler.batch(batch.column("text"))
            digests = _digests(sets)
            yield pa.RecordBatch.from_arrays([_signed(digests[:, 0].copy()), _signed(digests[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()), batch.column("text")], names=["h1", "h2", "n", "text"])

    own = same.filter("node <> label").select("h1", "h2", "n", "node").distinct()
    rows = named.join(several, "doc_id", "left_semi").mapInArrow(run, "h1 long, h2 long, n long, text string").dropDuplicates(["h1", "h2", "n"])
    return named.union(rows.join(own, ["h1", "h2", "n"]).select(F.col("node").alias("doc_id"), "text"))


def _points_of_nodes(scanned: DataFrame, same: DataFrame) -> DataFrame:
    """(doc, point) of each node."""
    points = scanned.filter("n > 0").select("doc_id", "h1", "h2", "n", "point")
    plain = points.select(F.col("doc_id").alias("doc"), "point")
    own = same.filter("node <> label").select("h1", "h2", "n", "node").distinct()
    return plain if own.isEmpty() else plain.union(points.drop("doc_id").dropDuplicates(["h1", "h2", "n"]).join(own, ["h1", "h2", "n"]).select("node", "point"))


def _near_points(table: pa.Table, part: int, whole: int) -> pa.Table:
    """The rows of a block whose points have a candidate among the others."""
    docs, at = np.unique(table.column("doc").to_numpy(), return_index=True)
    rows = table.take(pa.array(at))
    found = with_candidates(rows.column("n").to_numpy(), rows.column("point").to_pylist(), part, whole)
    return rows.select(["block", "doc"]).filter(pa.array(found))


def _compared_with_pivot(members: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """(block, doc, n, linked): whether each set of a block is linked with the block's pivot, or is it."""

    def run(batches):
        for batch in batches:
            tokens, pivots = batch.column("tokens").to_pylist(), batch.column("pivot").to_pylist()
            linked, blocks = np.zeros(batch.num_rows, bool), batch.column("block").to_numpy()
            for block in np.unique(blocks):
                at = np.flatnonzero(blocks == block)
                linked[at] = linked_with([_array(tokens[i]) for i in at], _array(pivots[at[0]]), part, whole)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "doc", "n")), pa.array(linked)], names=["block", "doc", "n", "linked"])

    pivots = sets.select(F.col("doc").alias("block"), F.col("tokens").alias("pivot"))
    both = spread_join(members.join(sets.hint("merge"), "doc"), pivots, ["block"], counted=members).select("block", "doc", "n", "tokens", "pivot")
    return both.mapInArrow(run, "block long, doc long, n long, linked boolean")
