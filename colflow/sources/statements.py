"""Statement records: reading, fingerprints, fan-out of results, lineage sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colflow.functions.text import fingerprint, normalize_statement, text_key
from colflow.session import materialize

REQUEST = T.StructType(
    [
        T.StructField("statement_id", T.LongType()),
        T.StructField("sql", T.StringType()),
        T.StructField("connectionString", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("password", T.StringType()),
        T.StructField("schema", T.StringType()),
    ]
)

CORRUPT = "_unreadable"
#: an unreadable request is the client's error, as an invalid argument is
UNREADABLE = "java.lang.IllegalArgumentException"


def _trim(column: str) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def read_statements(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """``(statements, failures)`` from request records.

    ``statements(statement_id, sql, default_schema)``; connection fields are left in
    the file: no credential enters a table. A JSON line that is no such record is a
    failure: ``record`` (its SHA-256, as it may hold a credential), ``error_class`` and
    ``chain``, in the form in which failed statements are reported.
    """
    if fmt != "json":
        raw = spark.read.schema(REQUEST).format(fmt).load(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    else:
        schema = T.StructType([*REQUEST.fields, T.StructField(CORRUPT, T.StringType())])
        lines = spark.read.text(path).filter(F.trim("value") != "")
        parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        raw = lines.select(parsed.alias("request")).select("request.*")
    good = raw.filter(F.col(CORRUPT).isNull())
    statements = good.select("statement_id", _trim("sql").alias("sql"), _trim("schema").alias("default_schema"))
    failures = raw.filter(F.col(CORRUPT).isNotNull()).select(
        F.sha2(CORRUPT, 256).alias("record"),
        F.lit(UNREADABLE).alias("error_class"),
        F.array(F.lit("request body is not a readable record")).alias("chain"),
    )
    return statements, failures


def statement_fingerprint(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(statements with text_key, texts)``.

    Each statement gets the key of its text as written, which is cheap; only
    the distinct texts are normalised. The counts combine map-side, so one
    text holding most of the statements does not make a large task.
    """
    marked = statements.withColumn("default_schema", F.nullif("default_schema", F.lit(""))).withColumn(
        "text_key", text_key(F.col("sql"), F.col("default_schema"))
    )
    # the text is a grouping key, not min(text): that would sort every row
    raw = marked.groupBy("text_key", "sql", "default_schema").agg(F.count("*").alias("statements"))
    return marked, fingerprint_texts(raw)


def fingerprint_texts(raw: DataFrame) -> DataFrame:
    """``raw(text_key, sql, default_schema, statements)`` with the normalised
    text and its fingerprint."""
    return raw.withColumn("fingerprint", fingerprint(F.col("sql"), F.col("default_schema"))).withColumn(
        "sql", normalize_statement(F.col("sql"))
    )


def distinct_fingerprints(texts: DataFrame) -> DataFrame:
    """One row per fingerprint: what has to be analyzed."""
    return texts.groupBy("fingerprint", "sql", "default_schema").agg(F.sum("statements").alias("statements"))


# A text with more statements than this is spread over several join keys.
ROWS_PER_SALT = 1_000_000


def hot_texts(texts: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Texts of more statements than one join key takes, with their number of keys."""
    salts = F.ceil(F.col("statements") / rows_per_salt).cast("int")
    return materialize(texts.filter(F.col("statements") > rows_per_salt).select("text_key", salts.alias("salts")), "hot-texts")


def fan_out(
    statements: DataFrame, texts: DataFrame, results: DataFrame, rows_per_salt: int = ROWS_PER_SALT, hot: DataFrame | None = None
) -> DataFrame:
    """Results per fingerprint back to every statement with that fingerprint.

    ``statements(statement_id, text_key)`` may be large and skewed. Texts
    above the threshold get several join keys: their statements are spread by
    hash and their (few) results repeated for each key. The list of such texts
    is stored, so its size decides how it is joined: broadcast if small, else
    by shuffle, where adaptive execution splits the hot texts. A caller with several
    results passes it as ``hot``.
    """
    salts = F.ceil(F.col("statements") / rows_per_salt).cast("int")
    hot = hot_texts(texts, rows_per_salt) if hot is None else hot
    spread = (
        statements.select("statement_id", "text_key")
        .join(hot, "text_key", "left")
        .withColumn("salt", F.pmod(F.xxhash64("statement_id"), F.coalesce("salts", F.lit(1))).cast("int"))
        .drop("salts")
    )
    repeated = (
        texts.select("text_key", "fingerprint", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        .join(results, "fingerprint")
        .drop("fingerprint")
    )
    return spread.join(repeated, ["text_key", "salt"]).drop("text_key", "salt")


def write_lineage(origins: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """Persist the lineage edges of one ``run``, laid out by run and source schema.

    A run that is written again, or once more after it was killed, replaces what it
    wrote before: only the folder of its own name is overwritten. It is struck from
    the manifest first and entered last, so what a killed attempt leaves never counts.
    """
    manifest = origins.sparkSession.createDataFrame([(run,)], "run string").coalesce(1)
    entry = f"{path}/manifest/{_folder(run)}"
    manifest.limit(0).write.mode("overwrite").parquet(entry)
    origins.write.mode("overwrite").partitionBy("source_schema").format(fmt).save(f"{path}/edges/run={run}")
    manifest.write.mode("overwrite").parquet(entry)


def _folder(run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run):
        raise ValueError("a run's name has letters, digits, '_', '.' and '-' only")
    return run


def read_lineage(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The edges of all committed runs, with ``run``: what a run left half-way is not
    among them."""
    committed = spark.read.schema("run string").parquet(f"{path}/manifest/*").distinct()
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    edges = spark.read.schema(full).format(fmt).load(f"{path}/edges")
    return edges.join(committed, "run", "left_semi")
