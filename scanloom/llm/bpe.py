"""Byte-pair encoding and decoding with a public vocabulary.

A word is held as a contiguous array of parts with the merge rank of each
adjacent pair beside it.  The smallest rank is found by a scan, its boundary is
deleted, and the two ranks next to it are looked up again.  Results per word
are kept in a bounded cache, since words repeat.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.storage import bounded_batches
from scanloom.llm.text import id_and_text

#: Above this many parts a word is merged through a heap; repeated scans would be quadratic.
SCAN_LIMIT = 256
#: Bytes of a worker's cache, what an entry is taken to have of them for 16 characters, and characters of the longest word kept.
CACHE_BYTES, UNIT_BYTES, LONGEST_KEPT = 128 << 20, 320, 64
NO_RANK = 1 << 30

# White space as the tokenizer's regular expressions define it.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# White space to Python that the tokenizer keeps.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class BoundedCache(dict):
    """Values of words, computed on first use, in two generations of about ``limit`` bytes at most, both together.

    When the newer generation is full it becomes the older one; a word found
    there moves on, so that frequent words stay.  An entry counts UNIT_BYTES for
    each 16 characters of its word begun, since values grow with their words, and
    words of more than LONGEST_KEPT characters are never kept: text without
    spaces would fill the cache with whole sentences that do not come again.
    """

    def __init__(self, compute, limit: int = CACHE_BYTES):
        super().__init__()
        self.compute, self.most, self.old = compute, limit // 2 // UNIT_BYTES, {}
        self.room = self.most

    def __missing__(self, word):
        value = self.old.get(word, self)
        if value is self:
            value = self.compute(word)
        size = len(word)
        if size > LONGEST_KEPT:
            return value
        self.room -= 1 + (size >> 4)
        if self.room < 0:
            self.begin()
        self[word] = value
        return value

    def begin(self) -> None:
        self.old, self.room = self.copy(), self.most
        self.clear()


class NumberCache(BoundedCache):
    """The same for numbers."""

    def __missing__(self, number):
        value = self.old.get(number, self)
        if value is self:
            value = self.compute(number)
        self.room -= 1
        if self.room < 0:
            self.begin()
        self[number] = value
        return value


class WordBpe:
    """A tokenizer file of the ``tokenizers`` library: lower case, words by pattern, byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("[^\\s", f"[^{SPACE}")).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for a, b in model["merges"]:
            self.rank.setdefault(self.vocab[a] << 16 | self.vocab[b], len(self.merged))
            self.merged.append(self.vocab[a + b])
        self.cache = BoundedCache(self.word_ids)
        self.chunks = BoundedCache(lambda c: b"".join(map(self.cache.__getitem__, self.words(c))))

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character (no final-sigma rule)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, normal: str) -> list[str]:
        """The text cut where no word crosses: at white space that Python and the pattern agree on."""
        return normal.split() if not _SEPARATORS.search(normal) else [normal]

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text cut at special strings; the flag marks a special string."""
        if not any(s in text for s in self.special):
            yield False, text
            return
        for k, part in enumerate(self.specials(text)):
            if part:
                yield bool(k % 2), part

    def symbols(self, word: str) -> list[int]:
        """A token for each byte of a word, the last one with the end-of-word mark."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return parts

    def merge(self, parts: list[int]) -> list[int]:
        """Merges adjacent parts by rank, the leftmost of equal ranks first."""
        if len(parts) > SCAN_LIMIT:
            return self.merge_long(parts)
        find, merged = self.rank.get, self.merged
        ranks = [find(a << 16 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(parts[i - 1] << 16 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = find(parts[i] << 16 | parts[i + 1], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a very long word: linked parts and a heap of ranks."""
        n, find = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := find(parts[i] << 16 | parts[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or find(parts[i] << 16 | parts[j], NO_RANK) != r:
                continue  # one of the two parts has changed since
            parts[i], parts[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := find(parts[i] << 16 | parts[k], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := find(parts[h] << 16 | parts[i], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def word_ids(self, word: str) -> bytes:
        return array("I", self.merge(self.symbols(word))).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        found, out = self.chunks.__getitem__, []
        for special, part in self.segments(text):
            if special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(found, self.pieces(self.normal(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between two, as a file without a decoder decodes."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    Returns a row per input row: doc_id, n_tokens long, ids binary (little-endian
    unsigned 32-bit), decoded string.  A null or empty text has no ids and
    decodes to the empty text.  Texts of any length are encoded whole; of merges
    of equal rank the leftmost comes first, and words of more than SCAN_LIMIT
    parts take a heap in the place of the scan, with the same result.  Repeated
    rows and rows with a null id are kept; other columns of the input are not
    read; an empty table gives none.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([bpe.decode(i) for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    kept = id_and_text(df, id_col, text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The ids and the decoded text as lower-case hex SHA-256."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
