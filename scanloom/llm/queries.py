"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, decontaminate, hard_negatives, language_id, lattice_lm, multi_index, ngram_join, periodic_runs, quality, secret_scan, token_counts, token_files, url_rules
from scanloom.llm.storage import Stash
from scanloom.llm.text import residue

#: Tokens above which a text is over the limit.
TOKEN_LIMIT = 2048
#: The token that ends each document in token files.
END_ID = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.score(docs, quality.train(docs, ratings))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = url_rules.judge_urls(pages, url_rules.SITE_RULES + url_rules.GENERAL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "word_rule")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.with_digest(secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs.filter(residue("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    predicted = language_id.identify(docs, model)
    return predicted.select("doc_id", F.coalesce(residue("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lattice_lm.score(docs, residue("doc_id", 10) == 0, tokenizer_path("piece_bpe_32k.model"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.with_digest(decontaminate.scan(docs, benchmark))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), TOKEN_LIMIT)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stash(spark, 'tokens').root}/files"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_files.write_tokens(token_files.encode_in_order(docs, tokenizer_path("byte_bpe_50k.json"), END_ID), path)
    return token_files.with_crc32(token_files.TokenFiles(spark, path).tokens())


def looped(doc_id: Column, text: Column) -> Column:
    """The text with a period from some word on, for a tenth of the ids."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
        return F.array_join(F.transform(places, lambda i: words[F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")]), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # an array of the one array, so that the words are cut once
    rewritten = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)))[0]
    return F.when(h % 10 == 0, rewritten).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    looping = docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.with_digests(periodic_runs.find_runs(looping))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_url_filters": op3_url_filters,
        "op4_secret_scans": op4_secret_scans,
        "op5_bpe_round_trip": op5_bpe_round_trip,
        "op6_language_id": op6_language_id,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_lm_scores": op8_lm_scores,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_token_counts": op10_token_counts,
        "op11_token_files": op11_token_files,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_hard_negatives": op13_hard_negatives,
    }


def _op3_sql() -> str:
    words = " ".join(f"WHEN regexp_matches(target, '{r.pattern}') THEN '{r.name}'" for r in sorted(url_rules.GENERAL_RULES, key=lambda r: (-r.rank, r.name)))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), judged AS (
  SELECT *, host || path AS target,
    CASE WHEN {fits('example.com', '/de/')} THEN 'example.com/de/' WHEN {fits('example.net', '/en/')} THEN 'example.net/en/'
         WHEN {fits('org', '/fr/')} THEN 'org/fr/' WHEN {fits('net', '/')} THEN 'net/' END AS rule FROM parts
), worded AS (SELECT *, CASE {words} END AS word_rule FROM judged)
SELECT page_id, host, path, rule, word_rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN word_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM worded"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": _op3_sql()}
