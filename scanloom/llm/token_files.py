"""Token ids of documents in Parquet files that can be read in parts.

Documents are put in ascending order of their ids over numbered shards, one file
or more each, and their token ids are a list column.  Ids of tokens are
dictionary-encoded, numbers that grow are delta-encoded; row groups and pages
have bounded sizes, and pages are indexed.  So metadata is read without any
token, and the tokens of some documents without the pages of others.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.bpe import SPACE, BoundedCache, byte_symbols
from scanloom.llm.storage import bounded_batches
from scanloom.llm.text import id_and_text

#: Bytes of a row group, bytes and rows of a page, and rows that a reader takes up at once.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS, READ_ROWS = 32 << 20, 256 << 10, 512, 256
#: Bytes of the cache of chunks, and characters of chunks that are encoded as ranks.
CHUNK_BYTES, SHORT = 256 << 20, 256
#: Marks that words are cut from.
MARKS = frozenset(".,;:!?")
# The tokenizer's pattern of words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which white space stands by single characters.
WORDS_APART = WORDS.replace(r"|\s+(?!\S)", "")
META = "doc_id", "shard", "shard_start", "n_tokens"


class Chunks(BoundedCache):
    """Token ids of chunks.  A mark after a letter and a line's end between two words are no part of what is kept:
    the pattern cuts there, so the chunk is put together from its words."""

    def __init__(self, compute, limit: int, within: Chunks | None = None):
        super().__init__(compute, limit)
        #: Of what follows a line's end: no space stands before it.
        self.within = self if within is None else within

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in MARKS and chunk[-2:-1].isalpha():
            return self[chunk[:-1]] + self.within[chunk[-1]]
        if "\n" in chunk and not chunk.isspace():
            first, *others = chunk.split()
            if chunk.split("\n") == [first, *others]:
                return self.within.ends.join([self[first], *map(self.within.__getitem__, others)])
        return super().__missing__(chunk)

    @cached_property
    def ends(self) -> bytes:
        return super().__missing__("\n")


class ChunkEncoder:
    """The library's encoding of whole texts.

    A text of short words between single characters of white space is encoded
    as a whole with the same vocabulary as ranks, which is several times faster;
    there the tokenizer's pattern needs no look ahead.  Others are put together
    from chunks that come again: a run without white space and the one space
    before it, or what is left of a run of white space; the pattern never
    crosses them.  The library encodes long chunks, texts with special strings,
    and all where ids are no ranks.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.library = lambda text: library.encode(text, add_special_tokens=False).ids
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in library.get_vocab(with_added_tokens=False).items()}
        with open(path, encoding="utf-8") as f:
            merges = [ranks[bytes(byte_of[c] for c in a + b)] for a, b in json.load(f)["model"]["merges"]]
        if merges == sorted(merges):
            self.short, self.whole = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (WORDS, WORDS_APART))
        else:
            self.short, self.whole = self.library, None
        self.apart = re.compile(f"[^{SPACE}]{{0,{SHORT}}}+(?:[{SPACE}][^{SPACE}]{{1,{SHORT}}}+)*+[{SPACE}]?").fullmatch
        # a space within a run of white space, other than the last one before a word
        self.inner_space = re.compile(f"(?<=[{SPACE}]) (?:[{SPACE}]|$(?!\n))").search
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.plain = Chunks(self.chunk, CHUNK_BYTES // 4)
        self.spaced = Chunks(lambda chunk: self.chunk(" " + chunk), CHUNK_BYTES, self.plain)

    def chunk(self, chunk: str) -> bytes:
        return array("I", (self.short if len(chunk) <= SHORT else self.library)(chunk)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.library(text)).tobytes()
        if self.whole and self.apart(text):
            return array("I", self.whole(text)).tobytes()
        if self.inner_space(text):
            return b"".join(map(self.plain.__getitem__, self.chunks(text)))
        first, *others = text.split(" ")
        return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, others))


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_in_order(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes whole texts in ascending order of ids, shard by shard.

    Returns a row per input row: doc_id, shard int (numbered in the order of
    ids), shard_start long (ids of the shard before this document), n_tokens
    long, ids array<int>, with ``end_id`` last.  A null or empty text is the
    end id alone.  Null ids come first; rows of one id stand side by side, in an
    order of their own.  Other columns are not read; an empty table gives none.

    One shuffle, of the texts; ids that many rows share are dealt over shards.
    Their number is ``shards``, or what the session's shuffles come to.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        encode, before = encoder(tokenizer).encode, 0
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            ids = [encode(t) + end for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            starts = pa.array(offsets[:-1] + before)
            before += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), starts, pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)],
                names=[*META, "ids"],
            )

    kept = id_and_text(df, id_col, text_col)
    # equal rows are told apart by their place, so that they need not lie in one shard
    kept = kept.withColumn("text_hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = "doc_id", "text_hash", "place"
    sharded = kept.repartitionByRange(*([shards] if shards else []), *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("shard"))
    kind = sharded.schema["doc_id"].dataType.simpleString()
    return sharded.mapInArrow(run, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids array<int>")


def write_tokens(
    encoded: DataFrame, path: str, delta: bool = False, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS
) -> None:
    """Writes what ``encode_in_order`` gives, in the format of this module.

    Token ids are dictionary-encoded, or delta-encoded with ``delta``; document
    ids, starts and counts are delta-encoded.  A row group ends at about
    ``row_group_bytes``, a page at about ``page_bytes`` or at ``page_rows`` rows;
    a document lies in one page, however long.
    """
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#shard": "true",
        "parquet.enable.dictionary#ids.list.element": str(not delta).lower(),
    }
    encoded.write.options(**options).parquet(path)


class TokenFiles:
    """Reads a folder that ``write_tokens`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        held = int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        # a batch holds all tokens of its rows
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", min(held, READ_ROWS))
        self.rows = spark.read.parquet(path)
        totals = self.rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).orderBy("shard").collect()
        starts = np.concatenate([[0], np.cumsum([r["total"] for r in totals])]).astype(np.int64).tolist()
        #: Tokens of all documents, and each shard with the place of its first token.
        self.total, self.offsets = starts[-1], [(r["shard"], at) for r, at in zip(totals, starts)]
        self.shards = spark.createDataFrame(self.offsets, "shard int, shard_offset long")

    def _placed(self, rows: DataFrame, *columns: str) -> DataFrame:
        start = (F.col("shard_offset") + F.col("shard_start")).alias("start")
        return rows.join(F.broadcast(self.shards), "shard").select("doc_id", start, "n_tokens", *columns)

    def metadata(self) -> DataFrame:
        """doc_id, start (tokens of all documents before this one) and n_tokens; token pages are not read."""
        return self._placed(self.rows.select(*META))

    def tokens(self) -> DataFrame:
        """The metadata, and the token ids of each document."""
        return self._placed(self.rows, "ids")

    def between(self, first: int, last: int) -> DataFrame:
        """Documents with ids from ``first`` to ``last``: row groups and pages of other ids are passed over."""
        return self._placed(self.rows.filter(F.col("doc_id").between(first, last)), "ids")

    def window(self, start: int, length: int) -> DataFrame:
        """The token ids at the places from ``start`` on, as pieces: doc_id, start of the piece, ids.

        Shards and places within the first and the last one are conditions on
        columns of the files, so that other row groups and pages are passed over.
        """
        end = start + length
        touched = [(s, at) for (s, at), stop in zip(self.offsets, [*(at for _, at in self.offsets[1:]), self.total]) if at < end and stop > start]
        if not touched:
            return self._placed(self.rows.filter("false"), "ids")
        (first, from_first), (last, from_last) = touched[0], touched[-1]
        rows = self.rows.filter(F.col("shard").between(first, last))
        rows = rows.filter((F.col("shard") > first) | (F.col("shard_start") + F.col("n_tokens") > start - from_first))
        rows = rows.filter((F.col("shard") < last) | (F.col("shard_start") < end - from_last))
        skipped = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
        kept = F.slice("ids", (skipped + 1).cast("int"), (F.least(F.col("start") + F.col("n_tokens"), F.lit(end)) - F.col("start") - skipped).cast("int"))
        return self._placed(rows, "ids").select("doc_id", (F.col("start") + skipped).alias("start"), kept.alias("ids"))


def with_crc32(tokens: DataFrame) -> DataFrame:
    """ids_crc32 long in the place of ids: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    bounded_batches(tokens.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(np.asarray(ids.values, np.dtype("<i4"))).cast("B")
            bounds = (np.asarray(ids.offsets) * 4).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
