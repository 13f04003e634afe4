"""Token files against the tokenizers library: ids, places, encodings of columns, reads of parts."""

import functools
import glob
import random
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from scanloom.llm import bpe, token_files
from scanloom.llm import queries as llm

PATH = llm.tokenizer_path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "　", "a", "don't", "'s", "12", "!?", "é", "日本語", "\x1c", "\x85", "<|endoftext|>", "x", "\r\n", "😀", "word", " the", "   ", "Word's"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library(texts):
    t = tokenizer()
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def texts(n=300):
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return [None, "", " \n\t", "A" * 3000, "日本" * 2000, "one two  three " * 500, *made]


def table(spark, given):
    rows = [(i * 7 % 1009, t, "s", 1, "x") for i, t in enumerate(given)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, start int, ids string").repartition(7)


def test_chunks_equal_the_library():
    one = token_files.ChunkEncoder(PATH)
    given = texts(4000)
    assert [[*np.frombuffer(one.encode(t), "<u4"), 2] for t in given] == library(given)


def test_texts_of_words_apart_are_encoded_as_a_whole():
    """Those that come once are no entries of a cache; the ids are the library's."""
    one, rng = token_files.ChunkEncoder(PATH), random.Random(11)
    words = [*(p for p in PARTS if not p.isspace() and p[0] != " " and p not in one.special), "\x1d", "'ll", "x" * 256, "1" * 256]
    given = ["".join(rng.choice(words) + rng.choice(" \n\t\x85\u3000") for _ in range(rng.randrange(0, 40))) + rng.choice(["", "end"]) for _ in range(2000)]
    given = [rng.choice(["", " ", "\n"]) + t for t in given]
    assert [[*np.frombuffer(one.encode(t), "<u4"), 2] for t in given] == library(given)
    assert not one.plain and not one.spaced
    others = ["a  b", "a \n\nb", "a" * 257 + " b", " " * 300 + "x", "x" + " " * 300]
    assert not any(map(one.apart, others)) and [[*np.frombuffer(one.encode(t), "<u4"), 2] for t in others] == library(others)
    # linear in the text's length
    assert not one.apart("ab " * 500_000 + "  c") and not one.apart("a" * 1_000_000)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    given = texts()
    out = str(tmp_path_factory.mktemp("tokens") / "files")
    rows = table(spark, given)
    token_files.write_tokens(token_files.encode_in_order(rows, PATH, 2, shards=5), out, row_group_bytes=40_000, page_bytes=2_000, page_rows=20)
    want, start = {}, 0
    for i, t in sorted((r["doc_id"], r["text"]) for r in rows.collect()):
        (ids,) = library([t])
        want[i] = (start, ids)
        start += len(ids)
    return out, want, start


def test_order_places_and_ids(spark, written):
    out, want, total = written
    files = token_files.TokenFiles(spark, out)
    assert files.total == total and len(files.offsets) > 1
    assert {r["doc_id"]: (r["start"], r["ids"]) for r in files.tokens().collect()} == want
    assert {r["doc_id"]: (r["start"], r["n_tokens"]) for r in files.metadata().collect()} == {i: (s, len(x)) for i, (s, x) in want.items()}
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_files.with_crc32(files.tokens()).collect()}
    assert crc == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, (_, x) in want.items()}


@pytest.mark.parametrize("delta", [False, True])
def test_encodings_row_groups_and_indexes(spark, tmp_path, delta):
    token_files.write_tokens(token_files.encode_in_order(table(spark, texts(900)), PATH, 2, shards=1), f"{tmp_path}/t", delta=delta, row_group_bytes=10_000, page_bytes=2_000, page_rows=20)
    (name,) = glob.glob(f"{tmp_path}/t/*.parquet")
    meta = pq.ParquetFile(name).metadata
    assert meta.num_row_groups > 1
    columns = {c.path_in_schema: c for c in (meta.row_group(0).column(k) for k in range(meta.num_columns))}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["shard_start"].encodings
    ids = columns["ids.list.element"].encodings
    assert ("DELTA_BINARY_PACKED" in ids) == delta and ("RLE_DICTIONARY" in ids) != delta


def test_parts_are_read_without_the_rest(spark, written):
    out, want, total = written
    files = token_files.TokenFiles(spark, out)
    plan = files.metadata()._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    some = files.between(100, 130)
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: (r["start"], r["ids"]) for r in some.collect()} == {i: v for i, v in want.items() if 100 <= i <= 130}
    flat = [t for _, ids in sorted(want.values()) for t in ids]
    for start, length in ((0, 1), (5, 700), (total // 2, 2000), (total - 3, 50), (0, total), (total, 5)):
        pieces = sorted((r["start"], r["ids"]) for r in files.window(start, length).collect())
        assert [t for _, ids in pieces for t in ids] == flat[start : start + length]
        assert all(flat[s : s + len(ids)] == ids for s, ids in pieces)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "no id"), (None, None), (5, "twice"), (5, "twice"), (5, "other"), (1, "")] + [(9, "hot")] * 400
    given = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write_tokens(token_files.encode_in_order(given, PATH, 2, shards=5), f"{tmp_path}/t")
    found = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["start"], r["ids"]) for r in token_files.TokenFiles(spark, f"{tmp_path}/t").tokens().collect())
    assert [i for i, _, _ in found] == [-1, -1, 1, 5, 5, 5] + [9] * 400
    starts = [s for _, s, _ in found]
    assert starts == [0, *np.cumsum([len(x) for _, _, x in found])[:-1].tolist()]
    assert sorted(x for _, _, x in found) == sorted(library([t for _, t in rows]))
    token_files.write_tokens(token_files.encode_in_order(given.filter("false"), PATH, 2), f"{tmp_path}/none")
    nothing = token_files.TokenFiles(spark, f"{tmp_path}/none")
    assert nothing.total == 0 and nothing.tokens().count() == nothing.metadata().count() == token_files.with_crc32(nothing.window(0, 5).withColumn("n_tokens", llm.F.lit(1))).count() == 0


def test_caches_are_bounded_in_bytes():
    """Words of every length and script, and texts without spaces: what a cache holds, measured, stays near its limit."""
    limit = 4 << 20
    for letters, size in (("abcdefgh", 8), ("abcdefgh", 64), ("日本語文字化け界", 16), ("日本語文字化け界", 64), ("日本語文字化け界", 2000)):
        rng, encode = random.Random(size), token_files.encoder(PATH)
        made = bpe.BoundedCache(encode.chunk, limit)
        for _ in range(12_000):
            assert made["".join(rng.choice(letters) for _ in range(size))]
        held = [*made.items(), *made.old.items()]
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for k, v in held) <= 1.7 * limit
        assert (not held) == (size > bpe.LONGEST_KEPT)
