"""Hard negatives of anchors by a dual-tree search for inner products.

Vectors become whole numbers, so that scores are exact.  A tree of planes,
fitted on a bounded sample, deals all rows over leaves; a leaf's rows lie in
blocks, its anchors in groups, each with a ball tree of its own.  An interval
for the inner products of two balls prunes pairs of leaves on the driver (their
number is bounded by the sample) and pairs of nodes in tasks, for whole groups
of anchors at once; what is left of pairs of lowest nodes is scored exactly.
Anchors meet their own leaf first; the scores found there are the bounds that
prune the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.storage import Stash, bounded_batches

#: Vectors that the tree of planes is fitted on; rows of a block, anchors of a group; rows and anchors of lowest nodes.
SAMPLE, BLOCK_ROWS, GROUP_ROWS, NODE_ROWS, NODE_ANCHORS = 20_000, 4096, 1024, 128, 32
#: Sampled vectors for each leaf at least.
LEAF_SAMPLE = 8
#: Components of this size or more could give scores that are no long.
TOO_LARGE = 1 << 24
#: Above every score.
ANY = 1 << 62
_FOUND = "row long, slot int, other_id long, score long"


def quantized(df: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, anchor, vec): whole numbers in 4 bytes each, of the rows that take part."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("vec").to_pylist():
                a = np.floor(np.array(v, np.float64) * scale) if v is not None and None not in v else None
                fits = a is not None and np.isfinite(a).all() and (np.abs(a) < TOO_LARGE).all()
                out.append(a.astype("<i4").tobytes() if fits else None)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("vec_id", "label", "anchor")), pa.array(out, pa.binary())], names=["vec_id", "label", "anchor", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, label string, anchor boolean, vec binary").filter("vec IS NOT NULL")


def far_direction(x: np.ndarray) -> np.ndarray:
    """From the point farthest from the mean to the one farthest from it."""
    away = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    return x[((x - away) ** 2).sum(1).argmax()] - away


class Planes:
    """A balanced tree of planes over vectors of one dimension; its leaves have centres."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth, d = max(0, int(np.ceil(np.log2(max(1, min(leaves, len(sample) // LEAF_SAMPLE)))))), sample.shape[1]
        count = 1 << self.depth
        self.normals, self.offsets, self.centres = np.zeros((count, d)), np.zeros(count), np.zeros((count, d))
        parts = {1: sample}
        for node in range(1, count):
            x = parts.pop(node)
            normal = far_direction(x) if len(x) else np.zeros(d)
            along = x @ normal
            self.normals[node], self.offsets[node] = normal, np.median(along) if len(x) else 0.0
            right = along > self.offsets[node]
            parts[2 * node], parts[2 * node + 1] = x[~right], x[right]
        for node, x in parts.items():
            if len(x):
                self.centres[node - count] = x.mean(0)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((x * self.normals[node]).sum(1) > self.offsets[node])
        return node - (1 << self.depth)


def _placed(rows: DataFrame, trees) -> DataFrame:
    """Each row with a number of its own, its leaf and how far it is from the leaf's centre; a dimension that was not sampled is one leaf around zero."""

    def run(batches):
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            sizes = np.array([len(v) // 4 for v in vecs], np.int64)
            key, dist = sizes << 20, np.zeros(len(vecs))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.frombuffer(b"".join(vecs[i] for i in at), "<i4").reshape(len(at), d).astype(np.float64)
                tree = trees.value.get(int(d))
                if tree is not None:
                    leaf = tree.leaves(x)
                    key[at] += leaf
                    x = x - tree.centres[leaf]
                dist[at] = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(key), pa.array(dist)], names=[*batch.schema.names, "key", "dist"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, "vec_id long, label string, anchor boolean, vec binary, row long, key long, dist double")


def tree_order(x: np.ndarray, lowest: int) -> tuple[np.ndarray, int]:
    """An order of rows in which the nodes of a balanced ball tree are stretches of equal size, and the tree's depth."""
    order, depth = np.arange(len(x)), 0
    while len(x) > lowest << depth:
        bounds = halves(len(x), depth)
        for a, b in zip(bounds, bounds[1:]):
            part = x[order[a:b]]
            along = part @ far_direction(part)
            order[a:b] = order[a:b][np.argpartition(along, (b - a) // 2)]
        depth += 1
    return order, depth


def halves(n: int, depth: int) -> list[int]:
    """Borders of the nodes of a level."""
    bounds = [0, n]
    for _ in range(depth):
        bounds = [y for a, b in zip(bounds, bounds[1:]) for y in (a, a + (b - a) // 2)] + [n]
    return bounds


def _matrix(table: pa.Table) -> np.ndarray:
    vecs = table.column("vec").to_pylist()
    return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), len(vecs[0]) // 4)


_KINDS = {"label": pa.string(), "least": pa.list_(pa.int64()), "most": pa.list_(pa.int64())}


def _packed(table: pa.Table, own: list[str], lowest: int, columns: list[str]) -> pa.Table:
    """The rows of a block or group as one row, in the order of its tree."""
    x = _matrix(table)
    order, depth = tree_order(x.astype(np.float64), lowest)
    table = table.take(pa.array(order))
    out = {c: table.column(c)[:1] for c in own} | {"n": pa.array([len(x)]), "depth": pa.array([depth], pa.int32()), "matrix": pa.array([x[order].tobytes()], pa.binary())}
    return pa.table(out | {c: pa.array([table.column(c).to_pylist()], pa.list_(_KINDS.get(c, pa.int64()))) for c in columns})


def _block(table: pa.Table) -> pa.Table:
    return _packed(table, ["key", "part"], NODE_ROWS, ["row", "vec_id", "label"])


def _group(table: pa.Table) -> pa.Table:
    return _packed(table, ["key", "part"], NODE_ANCHORS, ["row", "label", "least", "most"])


class Balls:
    """Levels of a ball tree over rows in tree order."""

    def __init__(self, x: np.ndarray, depth: int):
        self.x, self.depth, self.levels = x, depth, []
        for level in range(depth + 1):
            bounds = np.array(halves(len(x), level))
            sizes = np.diff(bounds)
            centre = np.add.reduceat(x, bounds[:-1]) / sizes[:, None]
            away = x - np.repeat(centre, sizes, 0)
            radius = np.sqrt(np.maximum.reduceat((away * away).sum(1), bounds[:-1]))
            self.levels.append((bounds, centre, radius))


def intervals(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of balls, pair by pair, with room for rounding."""
    middle, na, nb = (a * b).sum(-1), np.sqrt((a * a).sum(-1)), np.sqrt((b * b).sum(-1))
    reach = na * rb + nb * ra + ra * rb
    room = 0.5 + 1e-9 * (na * nb + reach)
    return middle - reach - room, middle + reach + room


def node_pairs(anchors: Balls, rows: Balls, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lowest nodes whose interval meets what their anchors look for (from ``least`` to ``most`` of each anchor)."""
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(anchors.depth, rows.depth) + 1):
        la, lb = min(level, anchors.depth), min(level, rows.depth)
        if level and la == level:
            i, j = np.repeat(2 * i, 2) + np.tile([0, 1], len(i)), np.repeat(j, 2)
        if level and lb == level:
            i, j = np.repeat(i, 2), np.repeat(2 * j, 2) + np.tile([0, 1], len(j))
        (bounds, ca, ra), (_, cb, rb) = anchors.levels[la], rows.levels[lb]
        low, high = intervals(ca[i], ra[i], cb[j], rb[j])
        wanted = (high >= np.minimum.reduceat(least, bounds[:-1])[i]) & (low <= np.maximum.reduceat(most, bounds[:-1])[i])
        i, j = i[wanted], j[wanted]
    return i, j


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if largest < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _visits(tile: dict, same: bool, wanted: int):
    """What the anchors of a group find in a block: for each slot of an anchor the best rows within its bounds."""
    d = len(tile["matrix"]) // 4 // tile["n"]
    a = np.frombuffer(tile["g_matrix"], "<i4").reshape(tile["g_n"], d).astype(np.float64)
    b = np.frombuffer(tile["matrix"], "<i4").reshape(tile["n"], d).astype(np.float64)
    codes: dict[str, int] = {}
    la, lb = (np.array([codes.setdefault(x, len(codes)) for x in tile[c]]) for c in ("g_label", "label"))
    ids, rows, own = np.array(tile["vec_id"]), np.array(tile["row"]), tile["g_row"]
    least, most = tile["g_least"], tile["g_most"]
    slots = [[(low, high) for low, high in zip(*x) if low <= high] or [(ANY, -ANY)] for x in zip(least, most)]
    lowest, highest = np.array([min(x)[0] for x in slots]), np.array([max(high for _, high in x) for x in slots])
    anchors, block = Balls(a, tile["g_depth"]), Balls(b, tile["depth"])
    i, j = node_pairs(anchors, block, lowest, highest)
    ga, gb = anchors.levels[-1][0], block.levels[-1][0]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for node in np.unique(i):
        at = np.concatenate([np.arange(gb[k], gb[k + 1]) for k in j[i == node]])
        some = np.arange(ga[node], ga[node + 1])
        score = products(a[some], b[at])
        fits = (la[some][:, None] == lb[at][None, :]) == same
        fits &= (score >= lowest[some][:, None]) & (score <= highest[some][:, None])
        for k, anchor in enumerate(some.tolist()):
            found = np.flatnonzero(fits[k])
            if same:
                found = found[rows[at[found]] != own[anchor]]
            if not len(found):
                continue
            s, n = score[k, found], ids[at[found]]
            best = np.lexsort((n, -s))
            s, n = s[best], n[best]
            for slot, (low, high) in enumerate(zip(least[anchor], most[anchor])):
                first = int(np.searchsorted(-s, -high, "left"))
                last = min(first + wanted, int(np.searchsorted(-s, -low, "right")))
                for p in range(first, last):
                    yield own[anchor], slot, int(n[p]), int(s[p])


class Search:
    """Rows in blocks, and searches of anchors among them."""

    def __init__(self, rows: DataFrame, stash: Stash, sample: int, block_rows: int, group_rows: int):
        spark = rows.sparkSession
        self.spark, self.stash, self.runs, self.group_rows = spark, stash, 0, group_rows
        rows = stash.keep(rows, "rows")
        total = rows.count()
        share = int(min(1.0, sample / max(1, total)) * 1_000_000)
        drawn: dict[int, list[bytes]] = {}
        place = F.xxhash64(F.monotonically_increasing_id(), F.lit(5))  # not the id, which many rows may share
        for r in rows.select("vec").filter(F.pmod(place, F.lit(1_000_000)) < share).collect():
            drawn.setdefault(len(r["vec"]) // 4, []).append(bytes(r["vec"]))
        known = sum(map(len, drawn.values()))
        self.trees = {}
        for d, vecs in drawn.items():
            x = np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), d).astype(np.float64)
            self.trees[d] = Planes(x, int(np.ceil(total * len(vecs) / known / block_rows)))
        self.rows = stash.keep(_placed(rows, spark.sparkContext.broadcast(self.trees)), "placed")
        #: Of each leaf, how far its rows and its anchors reach, and how many there are: as many leaves as the sample allows.
        near = F.col("anchor").cast("int")
        self.leaves = self.rows.groupBy("key").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.sum(near).alias("anchors"), F.max(F.when(F.col("anchor"), F.col("dist"))).alias("anchor_radius")).collect()
        self.blocks = stash.keep(self._dealt(self.rows, "n", block_rows).groupBy("key", "part").applyInArrow(_block, "key long, part int, n long, depth int, matrix binary, row array<long>, vec_id array<long>, label array<string>"), "blocks")

    def _dealt(self, rows: DataFrame, count: str, most: int) -> DataFrame:
        """The rows of each leaf dealt over parts of about ``most`` rows."""
        parts = self.spark.createDataFrame([(r["key"], -(-r[count] // most) or 1) for r in self.leaves], "key long, parts int")
        return rows.join(F.broadcast(parts), "key").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")

    def _visit(self, anchors: DataFrame, pairs: list[tuple[int, int]], same: bool, wanted: int) -> DataFrame:
        """Rows (row, slot, other_id, score) that anchors find in the leaves that theirs are paired with."""
        self.runs += 1
        groups = self._dealt(anchors, "anchors", self.group_rows).groupBy("key", "part")
        groups = groups.applyInArrow(_group, "key long, part int, n long, depth int, matrix binary, row array<long>, label array<string>, least array<array<long>>, most array<array<long>>")
        groups = groups.select("key", *[F.col(c).alias(f"g_{c}") for c in ("n", "depth", "matrix", "row", "label", "least", "most")])
        pairs = self.spark.createDataFrame(pairs, "key long, other long")
        tiles = groups.join(F.broadcast(pairs), "key").drop("key").join(self.blocks.withColumnRenamed("key", "other"), "other").drop("other", "part")

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    found = list(zip(*_visits(batch.slice(k, 1).to_pylist()[0], same, wanted))) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())], names=["row", "slot", "other_id", "score"])

        return self.stash.keep(tiles.mapInArrow(run, _FOUND), f"found{self.runs}")

    def _pairs(self, anchors: DataFrame) -> list[tuple[int, int]]:
        """Other leaves that may hold what the anchors of a leaf still look for, by the intervals of the leaves' balls."""
        slots = F.zip_with("least", "most", lambda low, high: F.when(low <= high, F.struct(low.alias("low"), high.alias("high"))))
        open_slots = anchors.select("key", F.explode(slots).alias("s")).filter("s IS NOT NULL")
        bounds = {r["key"]: (r["low"], r["high"]) for r in open_slots.groupBy("key").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high")).collect()}
        of_dimension: dict[int, list] = {}
        for r in self.leaves:
            of_dimension.setdefault(r["key"] >> 20, []).append(r)
        pairs = []
        for d, leaves in of_dimension.items():
            tree = self.trees.get(d)
            keys = np.array([r["key"] for r in leaves])
            centres = tree.centres[keys & (1 << 20) - 1] if tree is not None else np.zeros((len(keys), d))
            radii = np.array([r["radius"] for r in leaves])
            for k, r in enumerate(leaves):
                if r["key"] not in bounds:
                    continue
                low, high = intervals(centres[k][None, :], r["anchor_radius"], centres, radii)
                least, most = bounds[r["key"]]
                pairs += [(r["key"], int(o)) for o in keys[(high >= least) & (low <= most)] if o != r["key"]]
        return pairs

    def best(self, anchors: DataFrame, same: bool, wanted: int) -> DataFrame:
        """For each slot of each anchor the ``wanted`` best rows within its bounds: row, slot, rank, other_id, score.

        Of ``anchors`` are read row, key, label, vec, least and most (arrays with
        an item for each slot).
        """
        order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "other_id")
        first = self._visit(anchors, [(r["key"], r["key"]) for r in self.leaves if r["anchors"]], same, wanted)
        kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == wanted)
        kth = kth.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        closer = F.transform("least", lambda low, slot: F.greatest(low, F.coalesce(F.col("kth")[slot], low)))
        anchors = self.stash.keep(anchors.join(kth, "row", "left").withColumn("least", closer).drop("kth"), f"anchors{self.runs}")
        pairs = self._pairs(anchors)
        found = first.union(self._visit(anchors, pairs, same, wanted)) if pairs else first
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def mine(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    sample: int = SAMPLE,
    block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Of each anchor the most similar rows of its label, and for each of them the hardest negatives.

    Components become floor(scale * x); a score is the inner product of two rows
    of one dimension.  An anchor's positives are the ``positives`` other rows of
    its label with the highest scores; for each, the ``negatives`` highest among
    the rows of other labels whose score is at least ``low_percent`` and at most
    ``high_percent`` of the positive's.  Equal scores go by the smaller id.
    Returns anchor_id, positive_id, rank int (from 1), negative_id,
    positive_score, negative_score (all others long); nothing for an anchor
    without positives or negatives, nor for positives of a score below 0.

    ``anchor`` is a condition on the input's columns.  All rows are candidates.
    Rows with a null id, label or vector, with a null or non-finite component,
    or with one of 2^24 or more when scaled take no part.  A repeated row is
    another row, also for its copy.  Rows of other dimensions are not compared;
    empty vectors have score 0 with each other.  Other columns are not read; an
    empty table gives none.

    The tree of leaves is fitted on ``sample`` rows; every row is in a leaf, and
    no leaf is passed over but by its interval, so the result is exact.
    """
    spark: SparkSession = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "negatives")
    search = Search(quantized(df, anchor, id_col, vector_col, label_col, scale), stash, sample, block_rows, group_rows)
    anchors = search.rows.filter("anchor").select("row", "key", "vec_id", "label", "vec")
    open_slot = anchors.withColumn("least", F.array(F.lit(-ANY))).withColumn("most", F.array(F.lit(ANY)))
    near = search.best(open_slot.drop("vec_id"), True, positives)
    near = stash.keep(near.select("row", (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole bounds, rounded inwards; a positive below 0 leaves none
    low, high = low_percent * F.col("positive_score") + 99, high_percent * F.col("positive_score")
    least, most = (F.round((x - F.pmod(x, F.lit(100))) / 100).cast("long") for x in (low, high))
    slots = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", least.alias("least"), most.alias("most")))).alias("slots"))
    bounded = anchors.drop("vec_id").join(slots, "row").select("row", "key", "label", "vec", F.col("slots.least").alias("least"), F.col("slots.most").alias("most"))
    hard = search.best(stash.keep(bounded, "bounded"), False, negatives)
    hard = hard.join(near, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return hard.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
