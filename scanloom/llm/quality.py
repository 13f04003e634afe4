"""Quality classifier: ordinal regression on graded ratings.

One vector of weights on hashed text features gives a text's position s on a
scale that ordered thresholds cut into grades (cumulative logits):
P(grade > k) = 1 / (1 + exp(t_k - s)), with t_0 < t_1 < ...  From these come
the expected grade and the probability of the top grades, by which texts are
selected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.bpe import BoundedCache
from scanloom.llm.storage import bounded_batches
from scanloom.llm.text import column_bytes, id_and_text, row_batch, with_results

BITS = 18
#: Bound of the training sample, in rated texts of each grade (in expectation).
SAMPLE = 4000
GRADES = 3
#: Share of the best-graded sample texts that the selection keeps, each judged by a fit without it.
KEEP_BEST = 0.995
#: Parts of the sample, each judged by a fit on the others; and how far below their quantile the cut is set.
FOLDS, MARGIN = 5, 0.9
#: Partitions over which the fits are dealt by a hash; with so many each gets one of its own.
FIT_PARTS = 48
#: Bytes of the words whose buckets a worker keeps.
WORDS_BYTES = 64 << 20
_SHAPE = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9"))
_EDGES = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def rating(quality: Column, toxic: Column) -> Column:
    """Grades from the labels: 0 toxic, 1 of low quality, 2 good; null where a label is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def _word_features(word: bytes) -> int:
    """Buckets of the bare word and of its shape (case, digits, punctuation), in one number."""
    shape = word
    for pattern, mark in _SHAPE:
        shape = pattern.sub(mark, shape)
    return crc32(b"w" + word.strip(_EDGES).lower()) >> 32 - BITS << BITS | crc32(b"s" + shape) >> 32 - BITS


class Features:
    """Sparse features of whole texts; keeps the buckets of words it has seen."""

    def __init__(self):
        self.words = BoundedCache(_word_features, WORDS_BYTES)

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        if not words:
            return np.zeros(1, np.int32), np.ones(1, np.float32)
        both = np.array([*map(self.words.__getitem__, words)], np.int64)
        bare = (both >> BITS).astype(np.int32)
        buckets, counts = np.unique(np.concatenate([bare, (both & (1 << BITS) - 1).astype(np.int32)]), return_counts=True)
        types = min(9, 10 * len(set(words)) // len(words)) + 10 * min(4, len(words).bit_length() // 3)
        twice = min(9, 10 * int((bare[1:] == bare[:-1]).sum()) // len(words))
        extra = [crc32(b"t%d" % types) >> 32 - BITS, crc32(b"r%d" % twice) >> 32 - BITS]
        return np.append(buckets, np.array(extra, np.int32)), np.append(np.sqrt(counts / len(words)), [0.3, 0.3]).astype(np.float32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def tail(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -60, 60)))


def fit(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 300, ridge: float = 2e-5, tolerance: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with a ridge, over the whole sample, by a quasi-Newton method of limited memory.

    rows, buckets, values: the sparse features.  Thresholds are the first one and
    the logs of the gaps, so they stay in order.  It ends when a step gains less
    than ``tolerance`` of the loss.
    """
    seen, at = np.unique(buckets, return_inverse=True)
    n, d, at = len(grades), len(seen), at.astype(np.int32)
    weight = (n / n_grades / np.maximum(1, np.bincount(grades, minlength=n_grades)))[grades] ** 0.5 / n
    inf = np.array([np.inf])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, shape = x[:d], x[d:]
        s = np.bincount(rows, values * w[at], n)
        edge = np.concatenate([-inf, _thresholds(shape), inf])
        lo, hi = (1 / (1 + np.exp(-np.clip(edge[grades + k] - s, -60, 60))) for k in (0, 1))
        p = np.maximum(hi - lo, 1e-12)
        d_lo, d_hi = lo * (1 - lo) / p * weight, hi * (1 - hi) / p * weight
        grad_w = np.bincount(at, values * (d_hi - d_lo)[rows], d) + ridge * w
        grad_t = np.bincount(grades, -d_hi, n_grades)[:-1] + np.bincount(grades, d_lo, n_grades)[1:]
        below = np.cumsum(grad_t[::-1])[::-1]
        return float(ridge / 2 * (w @ w) - (weight * np.log(p)).sum()), np.concatenate([grad_w, below[:1], below[1:] * np.exp(shape[1:])])

    x = np.concatenate([np.zeros(d), [-1.0], np.zeros(n_grades - 2)])
    now, gradient = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step = _descent(gradient, past)
        for _ in range(30):
            after, turned = loss(x + step)
            if after <= now + 1e-4 * (step @ gradient):
                break
            step = step / 2
        else:
            break
        if step @ (turned - gradient) > 1e-12:
            past = [*past, (step, turned - gradient)][-8:]
        gained, x, now, gradient = now - after, x + step, after, turned
        if gained <= tolerance * max(abs(now), 1e-3):
            break
    weights = np.zeros(1 << BITS, np.float32)
    weights[seen] = x[:d]
    return OrdinalModel(weights, _thresholds(x[d:]))


def _thresholds(shape: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([shape[:1], np.exp(shape[1:])]))


def _descent(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A direction downhill, with the curvature of the last steps."""
    out, shares = -gradient, []
    for s, y in reversed(past):
        shares.append((s @ out) / (s @ y))
        out = out - shares[-1] * y
    out = out * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, float(np.sqrt(gradient @ gradient))))
    for (s, y), share in zip(past, reversed(shares)):
        out = out + s * (share - (y @ out) / (s @ y))
    return out


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = GRADES, sample: int = SAMPLE, keep_best: float = KEEP_BEST) -> OrdinalModel:
    """Fits on rated texts: docs (doc_id, text), ratings (doc_id, grade).

    Of several ratings of an id the lowest counts; then the sample of rated ids
    is drawn by a hash of the id, ``sample`` of each grade in expectation.  Null
    grades and texts are left out, and of several texts of an id one is taken,
    the same in every run.  The least probability of the top grade that selects
    a text comes from the whole sample: each fold of FOLDS is judged by a fit on
    the others, and MARGIN of what ``keep_best`` of the top grade's texts reach
    there, one half at most, is the cut.  Where the sample has fewer than
    1 / (1 - keep_best) texts of the top grade, that is what all of them reach.
    Without rated texts every text gets the same position and is selected.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rated = ratings.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    share = F.lit(1.0)
    for grade, n in counts.items():
        share = F.when(F.col("grade") == grade, min(1.0, sample / n)).otherwise(share)
    drawn = rated.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    # at most the bound of the sample, whatever the table
    texts = docs.filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select("doc_id", "grade", "text")

    def run(batches):
        found = Features()
        for batch in batches:
            parts = [found.of(t) for t in column_bytes(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array([b.tobytes() for b, _ in parts], pa.binary()), pa.array([v.tobytes() for _, v in parts], pa.binary())],
                names=["doc_id", "grade", "b", "v"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    one = texts.mapInArrow(run, f"doc_id {kind}, grade int, b binary, v binary").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min(F.struct("b", "v")).alias("of"))

    def fold(key, table):
        """The tails of a fold's texts of the top grade; at FOLDS the model of all texts."""
        k = key[0].as_py()
        ids, b, v = (table.column(c).to_pylist() for c in ("doc_id", "b", "v"))
        order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), b[i]))
        rows, buckets, values = _flat([b[i] for i in order], [v[i] for i in order])
        grades = table.column("grade").to_numpy()[order]
        left = np.array([crc32(str(ids[i]).encode()) % FOLDS for i in order]) != k
        if not left.any() or (left.all() and k < FOLDS):
            return pa.table({c: pa.array([], kind) for c, kind in (("id", pa.int64()), ("tails", pa.binary()), ("weights", pa.binary()), ("thresholds", pa.binary()))})
        use, number = left[rows], (np.cumsum(left) - 1).astype(np.int32)
        model = fit(number[rows[use]], buckets[use], values[use], grades[left], n_grades)
        tails = model.tail(np.bincount(rows, values * model.weights[buckets], len(grades)))[~left & (grades == n_grades - 1), -1]
        whole = (model.weights, model.thresholds) if k == FOLDS else (np.zeros(0, np.float32), np.zeros(0))
        return pa.table([pa.array([k])] + [pa.array([a.tobytes()], pa.binary()) for a in (tails, *whole)], names=["id", "tails", "weights", "thresholds"])

    # each fit gets the sample, which is bounded, from the tasks that made it; the driver gets the fits
    dealt = one.select("doc_id", "grade", "of.*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)).cast("array<long>")).alias("fold"))
    fits = dealt.repartition(FIT_PARTS, "fold").groupBy("fold").applyInArrow(fold, "id long, tails binary, weights binary, thresholds binary").collect()
    if not fits:
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.arange(n_grades - 1, dtype=float) - 40.0, 0.0)
    (whole,) = (r for r in fits if r["id"] == FOLDS)
    tails = np.concatenate([np.frombuffer(r["tails"]) for r in fits])
    cut = float(np.quantile(tails, 1 - keep_best, method="lower")) * MARGIN if len(tails) else 0.5
    return OrdinalModel(np.frombuffer(whole["weights"], np.float32), np.frombuffer(whole["thresholds"]), min(0.5, cut))


def _flat(b: list[bytes], v: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buckets = [np.frombuffer(x, np.int32) for x in b]
    rows = np.repeat(np.arange(len(b), dtype=np.int32), [len(x) for x in buckets])
    return rows, np.concatenate(buckets), np.concatenate([np.frombuffer(x, np.float32) for x in v])


def score(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """Grades whole texts.

    Returns a row per input row: doc_id, position double, expected_grade double
    (0 to the top grade), tail_prob double (probability of the top grade),
    selected boolean (tail_prob at the model's cut or above it; ties are
    selected).  A null or empty text has no words, which is a feature of its
    own, and gets a grade as any other; a very long one is read whole, and what
    counts is how often a word stands in it for its length.  ``whole_rows`` adds
    the input row as a struct ``row``.  Repeated rows and null ids are kept;
    other columns are not read; an empty table gives none.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        found, model = Features(), held.value
        for batch in batches:
            parts = [found.of(t) for t in column_bytes(batch)]
            s = np.array([float((model.weights[b] * v).sum(dtype=np.float64)) for b, v in parts])
            tails = model.tail(s)
            yield row_batch(
                batch,
                ["position", "expected_grade", "tail_prob", "selected"],
                [pa.array(s), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= model.cut)],
            )

    kept = id_and_text(df, id_col, text_col, whole_rows)
    return kept.mapInArrow(run, with_results(kept, "position double, expected_grade double, tail_prob double, selected boolean"))
