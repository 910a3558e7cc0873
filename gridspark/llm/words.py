"""Words, folds and column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.columns import bind  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text between ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string")) % folds


def memo_key(word: bytes) -> int:
    """A 64-bit hash of a word that is the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class Memo(dict):
    """Remembers a function of words; emptied when it holds ``limit`` entries, so that its memory is bounded."""

    def __init__(self, function: Callable, limit: int = 400_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


def packed(kept: Sequence[str]) -> Column:
    """The columns that a job carries along as one column ``row``, where their names cannot clash with its own."""
    return F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`") for c in kept]).alias("row")


def unpacked(kept: Sequence[str]) -> list[Column]:
    """The columns of ``packed`` again."""
    return [F.col("row").getField(c).alias(c) for c in kept]


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    name = stem
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def picked(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash falls into a share of all hashes, however small the share."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2**64) - 2**63)


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row; columns that have no hash (maps) are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])
