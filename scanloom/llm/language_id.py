"""Language identification in two steps: family first, then the languages within it.

Texts are hashed byte trigrams, a vector of fixed length for a whole text of any
length.  Linear support vector machines (squared hinge) separate the families
one against one, and within each family its languages one against one; so the
close pairs have separators that were fitted on nothing but them.  Languages of
no named family are put together by their centroids.  Every separator is fitted
in a task of its own; the driver sees centroids and weights, no texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.storage import Stash, bounded_batches
from scanloom.llm.text import id_and_text

#: Hash buckets of the trigrams.
DIMENSIONS = 4096
#: Bounds of the training sample: texts of each language, and of all languages (in expectation a fifth more is drawn).
SAMPLE_PER_LANGUAGE, SAMPLE = 500, 30_000
#: Texts of a family that it is told from another one by.
SAMPLE_PER_FAMILY = 1000
#: Languages of a family without a name, about; languages whose counts workers are told by broadcast.
FAMILY_SIZE, COUNTS_TOLD = 12, 10_000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
}


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; length 1."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    with np.errstate(over="ignore"):
        codes = ((raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]) * np.uint32(2654435761)
    counts = np.bincount(codes >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(counts / len(codes)).astype(np.float32)


def sparse(x: np.ndarray) -> bytes:
    """The buckets that are not zero, and their values in half precision."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float16).tobytes()


def dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMENSIONS), np.float32)
    for x, raw in zip(out, rows):
        half = len(raw) // 2
        x[np.frombuffer(raw, np.uint16, half // 2)] = np.frombuffer(raw, np.float16, half // 2, half)
    return out


def families_of(centroids: dict[str, np.ndarray], size: int = FAMILY_SIZE) -> dict[str, list[str]]:
    """Languages by family: named ones, and groups of the others by nearest centroid, named by their first language."""
    own = {lang: name for name, langs in FAMILIES.items() for lang in langs}
    out: dict[str, list[str]] = {}
    for lang in sorted(centroids):
        if lang in own:
            out.setdefault(own[lang], []).append(lang)
    others = sorted(set(centroids) - set(own))
    if others:
        x = np.array([centroids[o] for o in others], np.float64)
        middle = [x[0]]
        while len(middle) < -(-len(others) // size):  # the next group begins at the language farthest from all
            middle.append(x[np.min([((x - m) ** 2).sum(1) for m in middle], axis=0).argmax()])
        for _ in range(10):
            near = np.array([((x - m) ** 2).sum(1) for m in middle]).argmin(0)
            middle = [x[near == k].mean(0) if (near == k).any() else m for k, m in enumerate(middle)]
        for k in sorted(set(near.tolist())):
            group = [o for o, n in zip(others, near.tolist()) if n == k]
            out[f"group of {group[0]}"] = group
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights and a bias of the squared-hinge separator of y = 1 from y = -1, by accelerated gradient steps."""
    w = np.zeros(x.shape[1] + 1, np.float64)
    ahead, rate, t = w.copy(), 1 / (4.0 + ridge), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1].astype(np.float32) + ahead[-1]))
        pull = (-2 / len(y)) * slack * y
        grad = np.append(x.T @ pull.astype(np.float32), pull.sum())
        grad[:-1] += ridge * ahead[:-1]
        new = ahead - rate * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass
class OneVersusOne:
    """Separators for each pair of names; a single name needs none."""

    names: list[str]
    weights: np.ndarray | None = None

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(len(self.names)), 2))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the winner of most pairs and the mean of its logistic margins; ties by that mean."""
        if len(self.names) < 2:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:-1].astype(np.float32) + self.weights[-1]
        chance = 1 / (1 + np.exp(-3 * margin))
        votes, sums = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margin[:, k] >= 0
            votes[:, b] += margin[:, k] < 0
            sums[:, a] += chance[:, k]
            sums[:, b] += 1 - chance[:, k]
        mean = sums / (len(self.names) - 1)
        best = np.argmax(votes + mean / 2, axis=1)
        return best, mean[np.arange(len(x)), best]


@dataclass
class LanguageModel:
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 for each text."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not known or not self.within:
            return langs, scores
        x = np.array([features(texts[i]) for i in known])
        kind, first = self.families.predict(x)
        for k, name in enumerate(self.families.names):
            rows = np.flatnonzero(kind == k)
            if len(rows):
                best, second = self.within[name].predict(x[rows])
                for r, b, s in zip(rows.tolist(), best.tolist(), second.tolist()):
                    langs[known[r]] = self.within[name].names[b]
                    scores[known[r]] = float(first[r]) * s
        return langs, scores


def _drawn(rows: DataFrame, per_language: int, texts: int) -> DataFrame:
    """A sample of the rows, bounded for each language and in all, by a hash of id and text."""
    counts = rows.groupBy("lang").count()
    told = counts.limit(COUNTS_TOLD + 1).collect()
    if len(told) <= COUNTS_TOLD:
        counts = F.broadcast(rows.sparkSession.createDataFrame(told, counts.schema))
    languages = len(told) if len(told) <= COUNTS_TOLD else counts.count()
    wanted = max(1, min(per_language, texts // max(1, languages)))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_000))
    return rows.join(counts, "lang").filter(place < F.least(F.lit(1.0), 1.2 * wanted / F.col("count")) * 1_000_000).select("doc_id", "lang", "text")


def _centroid(table: pa.Table) -> pa.Table:
    mean = dense(table.column("x").to_pylist()).mean(0)
    return pa.table({"lang": table.column("lang")[:1], "n": pa.array([len(table)]), "x": pa.array([mean.tobytes()], pa.binary())})


def _separator(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("x").to_pylist(), table.column("side").to_pylist()))
    w = fit_svm(dense([x for x, _ in rows]), np.array([float(side) for _, side in rows]))
    return pa.table({"fit": table.column("fit")[:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, texts: int = SAMPLE, per_family: int = SAMPLE_PER_FAMILY) -> LanguageModel:
    """Fits a model of all values of lang on (doc_id, text, lang), from a bounded sample.

    At most ``per_language`` texts of a language are drawn and ``texts`` in all,
    in expectation and but for a fifth more; at least one text in expectation of
    each language.  Rows are drawn by a hash of id and text, so the sample is the
    same in every run; repeated rows count once.  Rows without text or lang are
    left out.  Families are told apart by ``per_family`` texts of each.

    A language adds some twelve separators of 16 KB to the model, which goes to
    the driver and to all workers.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "languages")

    def run(batches):
        for batch in batches:
            x = [sparse(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])

    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = stash.keep(_drawn(rows, per_language, texts).mapInArrow(run, f"doc_id {kind}, lang string, x binary").distinct(), "sample")
    centres = {r["lang"]: (r["n"], np.frombuffer(r["x"], np.float32)) for r in sample.groupBy("lang").applyInArrow(_centroid, "lang string, n long, x binary").collect()}
    if not centres:
        return LanguageModel(OneVersusOne([]), {})
    families = families_of({lang: x for lang, (_, x) in centres.items()})
    names, sides = list(families), []
    # one fit for each two languages of a family, and for each two families; a side of a fit has some languages, each with a share of its texts
    within = [(a, b) for langs in families.values() for a, b in combinations(langs, 2)]
    for k, pair in enumerate(within):
        sides += [(k, lang, side, 1.0) for lang, side in zip(pair, (1, -1))]
    size = {name: sum(centres[lang][0] for lang in langs) for name, langs in families.items()}
    for k, pair in enumerate(combinations(names, 2), len(within)):
        sides += [(k, lang, side, per_family / size[name]) for name, side in zip(pair, (1, -1)) for lang in families[name]]
    weights = {}
    if sides:
        given = sample.join(F.broadcast(spark.createDataFrame(sides, "fit int, lang string, side int, share double")), "lang")
        given = given.filter(F.pmod(F.xxhash64("doc_id", "x", F.lit(11)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
        fitted = given.select("fit", "side", "x").groupBy("fit").applyInArrow(_separator, "fit int, w binary")
        weights = {r["fit"]: np.frombuffer(r["w"], np.float32) for r in fitted.collect()}
    stash.drop("sample")
    numbers = iter(range(len(weights)))
    take = lambda labels: OneVersusOne(labels, np.array([weights[next(numbers)] for _ in combinations(labels, 2)]).T if len(labels) > 1 else None)
    inside = {name: take(langs) for name, langs in families.items()}
    return LanguageModel(take(names), inside)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of whole texts.

    Returns a row per input row: doc_id, lang_pred string, score double.  A text
    that is null, empty or without a letter is ``und`` with score 0, as is every
    text when the model has seen no language.  A text of any length is read
    whole; of languages with equal votes the first by the margins, then by name,
    is taken.  Repeated rows and null ids are kept; other columns are not read;
    an empty table gives none.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kept = id_and_text(df, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
