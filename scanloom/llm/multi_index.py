"""Near-duplicate vectors with an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook, and the grid of
both codebooks gives the cells.  A query visits cells in the order of the summed
squared distances of its halves to the codewords (multi-sequence traversal) and
stops after as many cells as the target recall takes, a number measured on
pairs at exactly the threshold.  All rows are indexed and all are queries; the
cosine in double precision decides each pair.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.components import connected_components
from scanloom.llm.spread import spread_join
from scanloom.llm.storage import Stash, bounded_batches

THRESHOLD = 0.98
TARGET_RECALL = 0.995
#: Vectors that codebooks and the length of the traversal are fitted on; more only for more than 2,500 codewords.
SAMPLE = 20_000
#: Pairs at the threshold that the traversal is measured on.
PROBES = 1000
#: Vectors in one part of a cell, and how many cells of several parts workers are told by broadcast.
CELL_ROWS, CELLS_TOLD = 2000, 100_000


def clean(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec): vec holds the components in bytes, null where the vector or the label can't be compared.

    The first byte says whether floats hold the components exactly, or doubles do.
    """

    def run(batches):
        for batch in batches:
            out = []
            for v, label in zip(batch.column("vec").to_pylist(), batch.column("label").to_pylist()):
                a = np.array(v, np.float64) + 0.0 if v and label is not None and None not in v else None
                out.append(packed(a) if a is not None and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "vec_id long, label string, vec binary")


def packed(a: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        short = a.astype(np.float32)
    return b"f" + short.tobytes() if (short == a).all() else b"d" + a.tobytes()


#: The number of components of a packed vector, as SQL.
DIMENSION = "CAST((length(vec) - 1) / CASE WHEN substring(vec, 1, 1) = X'66' THEN 4 ELSE 8 END AS INT)"


def unit(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).astype(np.float64)
    a = a / np.abs(a).max()
    return a / np.sqrt(a @ a)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Codewords of a codebook; starts from evenly spaced rows, so it gives the same in every run."""
    words = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        counts = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (words * words).sum(1) - 2 * x @ words.T)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // len(words))
    return np.concatenate([distances(x[i : i + step], words).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def codewords(rows: int) -> int:
    """Codewords of a half, so that a cell of the grid has about 16 rows at any number of rows."""
    return max(4, round((rows / 16) ** 0.5))


class MultiIndex:
    """Two codebooks for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, target: float):
        k = min(codewords(rows), max(4, len(sample) // 8))
        self.half = max(1, sample.shape[1] // 2)
        self.books = [k_means(sample[:, : self.half], k), k_means(sample[:, self.half :], k)]
        self.visits = 1
        self.visits = self.measure(sample, threshold, target)

    def _near(self, x: np.ndarray) -> list[np.ndarray]:
        return [distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._near(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def traverse(self, a: np.ndarray, b: np.ndarray, count: int) -> list[int]:
        """Multi-sequence traversal: the ``count`` cells of least summed distance, in order."""
        first, second = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b, width = a.tolist(), b.tolist(), len(second)
        heap, out = [(a[first[0]] + b[second[0]], 0, 0)], []
        while heap and len(out) < count:
            _, i, j = heapq.heappop(heap)
            out.append(first[i] * width + second[j])
            # each cell is reached once: along a row, and down the first column
            if j + 1 < width:
                heapq.heappush(heap, (a[first[i]] + b[second[j + 1]], i, j + 1))
            if not j and i + 1 < len(first):
                heapq.heappush(heap, (a[first[i + 1]] + b[second[0]], i + 1, 0))
        return out

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits; of a half no more codewords than cells are needed."""
        near, first = self._near(x), []
        for d in near:
            some = np.argpartition(d, min(self.visits, d.shape[1]) - 1, axis=1)[:, : self.visits]
            first.append(np.sort(some, axis=1))
        out, width = [], len(self.books[1])
        for a, b, i, j in zip(*near, *first):
            found = np.array(self.traverse(a[i], b[j], self.visits))
            out.append((i[found // len(j)] * width + j[found % len(j)]).tolist())
        return out

    def measure(self, sample: np.ndarray, threshold: float, target: float) -> int:
        """Cells to visit so that a share ``target`` of pairs at the threshold meet, from either side."""
        rng = np.random.default_rng(7)
        x = sample[rng.integers(0, len(sample), PROBES)]
        turn = rng.normal(size=x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        norm = np.sqrt((turn * turn).sum(1))[:, None]
        y = threshold * x + (1 - threshold**2) ** 0.5 * turn / np.maximum(norm, 1e-300)
        ranks = []
        for p, q in ((x, y), (y, x)):
            (a, b), goal = self._near(p), self._near(q)
            ga, gb = goal[0].argmin(1), goal[1].argmin(1)
            rows = np.arange(len(p))
            mine = a[rows, ga] + b[rows, gb]
            ranks.append([1 + int(np.searchsorted(np.sort(bb), m - av[av <= m], "left").sum()) for av, bb, m in zip(a, b, mine)])
        return int(np.quantile(np.minimum(*map(np.array, ranks)), target, method="higher"))


def _placed(rows: DataFrame, index) -> DataFrame:
    """Each vector with its space (label and dimension), its own cell, the cells that it visits, and a short code.

    The code has a byte for each component of the unit vector, and before them
    the step of these bytes and the length of what they leave out.
    """

    def run(batches):
        for batch in batches:
            vecs, labels, books = batch.column("vec").to_pylist(), batch.column("label").to_pylist(), index.value
            units = [unit(v) for v in vecs]
            dims, out = np.array([len(x) for x in units]), [None] * len(units)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array([units[i] for i in at])
                for i, v, home, seen in zip(at.tolist(), x, books[int(d)].cells(x).tolist(), books[int(d)].visited(x)):
                    out[i] = (f"{labels[i]}|{d}", home, list(dict.fromkeys([home, *seen])), code(v))
            columns = zip((pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()), zip(*out))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("node", "rows", "vec")), *(pa.array(c, t) for t, c in columns)], names=["node", "rows", "vec", "space", "home", "seen", "code"])

    return rows.select("node", "rows", "vec", "label").mapInArrow(run, "node long, rows long, vec binary, space string, home long, seen array<long>, code binary")


def code(v: np.ndarray) -> bytes:
    step = np.float32(np.abs(v).max() / 127)
    short = np.rint(v / step).clip(-127, 127).astype(np.int8)
    left = v - short.astype(np.float64) * step
    return np.array([step, np.nextafter(np.float32(np.sqrt(left @ left)), np.float32(2))], np.float32).tobytes() + short.tobytes()


def _with_candidates(table: pa.Table, threshold: float) -> pa.Table:
    """The rows of a cell, or of two parts of it, that may be linked with another one there, by the codes and what they leave out."""
    part, here = table.column("part").to_numpy(), table.column("home").to_numpy() == table.column("cell").to_numpy()
    raw = np.array([np.frombuffer(c, np.uint8) for c in table.column("code").to_pylist()])
    heads = raw[:, :8].copy().view(np.float32)
    x, e = raw[:, 8:].view(np.int8).astype(np.float32) * heads[:, :1], heads[:, 1]
    least = threshold - 1e-4 - 1e-6 * x.shape[1] - e
    one, some = table.column("a")[0].as_py() == table.column("b")[0].as_py(), np.zeros(len(e), bool)
    for start in range(0, len(e), 512):
        block = np.arange(start, min(start + 512, len(e)))
        # the cosine is at most the codes' product, and what each leaves out against the other
        close = x[block] @ x.T >= least[None, :] - (e[block] * (1 + e.max()))[:, None]
        close &= here[block][:, None] | here[None, :]
        close[np.arange(len(block)), block] = False
        if not one:
            close &= part[block][:, None] != part[None, :]
        some[block] = close.any(1)
    return table.select(["space", "cell", "a", "b", "part", "node"]).filter(pa.array(some))


def compare_cell(table: pa.Table, threshold: float) -> pa.Table:
    """Links of a cell, or of two parts of it: how many rows each vector is linked with here, and spanning links.

    A pair that meets in both vectors' cells counts in the lower one.  Vectors
    that only visit the cell are not compared with each other.
    """
    part, a, b = (table.column(c).to_numpy() for c in ("part", "a", "b"))
    cell, home = int(table.column("cell")[0].as_py()), table.column("home").to_numpy()
    ids, rows = table.column("node").to_numpy(), table.column("rows").to_numpy().astype(np.float64)
    seen, x = np.array(table.column("seen").to_pylist()), np.array([unit(v) for v in table.column("vec").to_pylist()])
    here = home == cell
    # of each row, and of each lower cell that a guest comes from: whether the row visits that cell
    homes, from_home = np.unique(home, return_inverse=True)
    visits = np.array([(seen == h).any(1) if h < cell else np.zeros(len(ids), bool) for h in homes]).T
    count, label, links = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    one = a[0] == b[0]
    for start in range(0, len(ids), 512):
        block = np.arange(start, min(start + 512, len(ids)))
        close = x[block] @ x.T >= threshold
        close &= here[block][:, None] | here[None, :]
        close[np.arange(len(block)), block] = False
        if not one:
            close &= part[block][:, None] != part[None, :]
        host, guest = here[block], ~here[block]
        close[host] &= here[None, :] | ~visits[block[host]][:, from_home]
        close[guest] &= ~here[None, :] | ~visits[:, from_home[block[guest]]].T
        count[block] = np.rint(close @ rows)
        for k in np.flatnonzero(close.any(1)):
            i, others = int(block[k]), np.flatnonzero(close[k])
            apart, first = np.unique(label[others], return_index=True)
            first = first[apart != label[i]]
            if len(first):
                links += [(i, int(j)) for j in others[first]]
                label[np.isin(label, apart)] = label[i]
    some = np.flatnonzero(count)
    none = [None] * len(links)
    return pa.table(
        {
            "node": pa.array([*ids[some].tolist(), *none], pa.int64()),
            "n": pa.array([*count[some].tolist(), *none], pa.int64()),
            "u": pa.array([None] * len(some) + [int(ids[i]) for i, _ in links], pa.int64()),
            "v": pa.array([None] * len(some) + [int(ids[j]) for _, j in links], pa.int64()),
        }
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    sample: int = SAMPLE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Links vectors of one label (not null) and dimension whose cosine is ``threshold`` or more.

    Codebooks are fitted on a sample for each dimension: ``sample`` vectors, or
    eight for each codeword where that is more (twice the square root of the
    number of vectors); every row is indexed and asks.  Returns a row per input
    row: vec_id, n_links long (other rows linked directly), component_id long
    (smallest vec_id that links reach, the own one included), kept boolean
    (vec_id = component_id).  Null, empty or zero vectors, those with a null or
    non-finite component, and rows with a null label or id are linked with
    nothing.  Equal vectors are compared once and counted by their rows; a
    repeated row is another row, with the same vec_id or not.  A cosine of exactly
    ``threshold`` is a link.  Other columns are not read; an empty table gives none.

    Codes of a byte a component go to all cells visited; whole vectors only to
    cells where the codes leave a link possible.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "vectors")
    usable = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(usable, F.unhex(F.sha2(F.concat(F.encode("label", "UTF-8"), F.lit(b"\x00"), F.col("vec")), 256)))
    rows = stash.keep(clean(df, id_col, vector_col, label_col).withColumn("key", key), "rows")
    known = rows.filter("key IS NOT NULL")
    reps = known.groupBy("key", "label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows"))
    # an id of several rows numbers no vector
    several = known.groupBy("vec_id").count().filter("count > 1").select(F.col("vec_id").alias("rep"), F.lit(True).alias("shared"))
    reps = reps.join(several, "rep", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("key")).otherwise(F.col("rep"))).drop("shared")
    reps = stash.keep(reps, "reps")
    sizes = {r["d"]: r["count"] for r in reps.groupBy(F.expr(DIMENSION).alias("d")).count().collect()}
    index = {}
    for d, n in sizes.items():
        wanted = max(sample, 8 * codewords(n))
        drawn = reps.filter(F.expr(DIMENSION) == d).filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1_000_000)) < min(1.0, wanted / n) * 1_000_000).select("key", "vec").collect()
        drawn = [unit(bytes(r["vec"])) for r in sorted(drawn, key=lambda r: bytes(r["key"]))] or [np.eye(1, d)[0]]
        index[d] = MultiIndex(np.array(drawn), n, threshold, target_recall)
    placed = stash.keep(_placed(reps, spark.sparkContext.broadcast(index)), "placed")
    # a cell of many rows is dealt into parts, and each two parts meet in a task of their own
    cells = placed.select("space", F.explode("seen").alias("cell"), "home", "node", "code")
    many = cells.groupBy("space", "cell").count().filter(F.col("count") > cell_rows).select("space", "cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts"))
    dealt = cells.join(F.broadcast(many), ["space", "cell"], "left") if many.count() <= CELLS_TOLD else cells.join(many, ["space", "cell"], "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("space", "cell", "home", "node", "code", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    near = met.groupBy("space", "cell", "a", "b").applyInArrow(lambda t: _with_candidates(t, threshold), "space string, cell long, a int, b int, part int, node long")
    near = stash.keep(near, "near").join(placed.select("node", "home", "rows", "vec", "seen").hint("merge"), "node")
    found = near.groupBy("space", "cell", "a", "b").applyInArrow(lambda t: compare_cell(t, threshold), "node long, n long, u long, v long")
    found = stash.keep(found, "found")
    counts = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(found.filter("u IS NOT NULL").select("u", "v"), stash)
    per_key = reps.join(counts, "node", "left").join(groups, "node", "left").select("key", "rep", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    per_key = stash.keep(per_key, "per_key")
    names = per_key.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_key = spread_join(per_key, names, ["component"]).select("key", "n_links", "component_id")
    out = spread_join(known.select("vec_id", "key"), per_key, ["key"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
