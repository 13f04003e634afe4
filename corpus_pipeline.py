"""A training-corpus pipeline of five stages over ``documents``.

Quality classifier, n-gram Jaccard join, benchmark decontamination, secret scan,
and encoding.  Each stage takes the documents that the one before it kept, as
Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from scanloom.llm.queries import tokenizer_path
from scanloom.llm.storage import Stash, clear_tables, tables_held


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier selects; ratings come from ``labels``.

    A null or empty text is graded as any other; repeated rows are graded alike.
    Without ratings all documents stay; an empty table gives none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.score(docs, quality.train(docs, ratings), whole_rows=True).filter("selected").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies.

    Of repeated rows in a group one stays; rows of one id whose texts are not
    linked all stay, as do documents without an id or without words.  An empty
    table gives none.
    """
    return ngram_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages beyond the limit; all others stay as they are.

    Null and empty texts hold none; repeated rows are judged alike.  Without
    benchmark items all documents stay; an empty table gives none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.scan(docs, benchmark, whole_rows=True).filter(~F.col("contaminated")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; texts without one, null and empty ones stay as they are.

    All rows are kept, repeated ones too; an empty table gives none.
    """
    scanned = secret_scan.scan(docs, whole_rows=True)
    found = F.col("spans") != ""
    text = F.when(found, F.col("redacted")).otherwise(F.col("row.text"))
    own = {"text": text, "n_chars": F.when(found, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return scanned.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; a null or empty text has none.  Repeated rows and null ids are kept."""
    return bpe.encode_decode(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", grade),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("encode", encode),
]

#: The stages are no SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again.

    A stage's input, and what it wrote for itself, are removed when its output is
    written; so one copy of the documents stays, besides the one being written.
    """
    stash, before = Stash(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        held = tables_held(spark)
        docs = stash.keep(stage(spark, docs, sf_dir), name)
        clear_tables(spark, held)
        if before:
            stash.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
