"""Words of a text, as bytes, in the forms that the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LETTERS_DIGITS_HIGH = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: Lower-cases A-Z; every other ASCII character that is no digit or letter becomes a space.
ALNUM_TABLE = bytes(
    c if c in _LETTERS_DIGITS_HIGH else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def spaced_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at the ASCII white space 0x20 and 0x09-0x0D."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(ALNUM_TABLE).split() if text else []


def column_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def id_and_text(df: DataFrame, id_col: str, text_col: str, whole_rows: bool = False) -> DataFrame:
    """The two columns that an operator needs, under fixed names, and the whole row as a struct if asked for."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if whole_rows else []
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *whole)


def with_results(kept: DataFrame, results: str) -> StructType:
    """The schema of an operator's rows: the id, the whole row if there, and the results."""
    own = [f for f in kept.schema if f.name in ("doc_id", "row")]
    return StructType([*own, *StructType.fromDDL(results)])


def row_batch(batch: pa.RecordBatch, names: list[str], results: list[pa.Array]) -> pa.RecordBatch:
    """The batch's ids, its whole rows if there, and the results under their names."""
    own = [n for n in ("doc_id", "row") if n in batch.schema.names]
    return pa.RecordBatch.from_arrays([*map(batch.column, own), *results], names=[*own, *names])


def residue(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
