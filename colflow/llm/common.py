"""Text rules and small helpers that the operators of this package share.

Rules common to all operators unless a docstring says otherwise: only the named
columns are read, so further columns of any name do no harm; rows are separate
documents even if their ids or texts repeat; a null id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z and nothing else
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(text: Column) -> Column:
    """``text`` with A-Z lower-cased; the fast path for all-ASCII texts."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a name inside higher-order
    functions, where a repeated expression would run again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of ``text``; none for null."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)), " ")
    return F.array_remove(split, "")


def run_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: bytes up to which the keys of a join are broadcast, after counting them
BROADCAST_BYTES = 32 << 20
#: bytes of a broadcast row besides its columns, as Spark's hashed relations hold it
ROW_BYTES = 64


def _matched(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    if keys.count() * (ROW_BYTES + 8 * len(names)) <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    same = [rows[n].eqNullSafe(keys[n]) for n in names]
    return rows.join(keys, same, how)


def rows_with(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The ``rows`` whose key is among ``keys``: a broadcast of the keys if they are
    counted to be few, else a join by shuffle. Null keys match."""
    return _matched(rows, keys, names, "left_semi")


def rows_without(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The ``rows`` whose key is not among ``keys``, in the same ways."""
    return _matched(rows, keys, names, "left_anti")


def named_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """``row``, the whole row of ``docs`` as a struct, and ``keys``: columns of any
    name of the caller's stay apart from those used inside. A table without
    columns is not a case: every operator reads one at least."""
    return docs.select(F.struct("*").alias("row"), *(value.alias(name) for name, value in keys.items()))


def document_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """``named_rows`` by id and hash of the text, which name a document's rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return named_rows(docs, doc_id=F.col("doc_id").cast("long"), text_key=F.xxhash64(text), **more)
