"""Catalog of tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: schemas the database keeps for itself
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast"]
SYSTEM_PREFIX = "pg_"

CATALOG_SCHEMA = "schema STRING, table STRING, column STRING, ordinal INT, data_type STRING"

# fixed values: PostgreSQL type names and the Spark types they are read as
POSTGRES_TYPES = {
    "bigint": "BIGINT",
    "integer": "INT",
    "smallint": "SMALLINT",
    "text": "STRING",
    "character": "STRING",
    "character varying": "STRING",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp without time zone": "TIMESTAMP_NTZ",
    "timestamp with time zone": "TIMESTAMP",
    "double precision": "DOUBLE",
    "real": "FLOAT",
    "numeric": "DECIMAL(38,18)",
    "uuid": "STRING",
    "json": "STRING",
    "jsonb": "STRING",
    "bytea": "BINARY",
    "time without time zone": "STRING",
    "time with time zone": "STRING",
    "interval": "STRING",
}
# how a type without a counterpart is read: lineage needs the column, not its values
FALLBACK_TYPE = "STRING"
_SIZES = ["character_maximum_length", "numeric_precision", "numeric_scale"]


def filter_system_schemas(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~F.col(column).isin(SYSTEM_SCHEMAS) & ~F.col(column).startswith(SYSTEM_PREFIX))


def restrict_schemas(df: DataFrame, names: list[str] | None, column: str = "schema") -> DataFrame:
    """Only the named schemas; none named means all."""
    return df.filter(F.col(column).isin(names)) if names else df


def catalog_columns(information_schema: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Catalog from rows of ``information_schema.columns``.

    Named schemas are taken as asked for; otherwise every schema but the
    system's. Ordinals there start at 1, here at 0. Length, precision and scale
    become part of the type if the rows have them.
    """
    rows = restrict_schemas(information_schema, names, "table_schema")
    if not names:
        rows = filter_system_schemas(rows, "table_schema")
    return rows.select(
        F.col("table_schema").alias("schema"),
        F.col("table_name").alias("table"),
        F.col("column_name").alias("column"),
        (F.col("ordinal_position") - 1).cast("int").alias("ordinal"),
        _sized_type(rows).alias("data_type"),
    ).distinct()


def _sized_type(rows: DataFrame) -> Column:
    kind = F.col("data_type")
    if not set(_SIZES) <= set(rows.columns):
        return kind
    length, precision, scale = (F.col(c).cast("int") for c in _SIZES)
    numeric = F.concat(F.lit("numeric("), precision.cast("string"), F.lit(","), F.coalesce(scale, F.lit(0)).cast("string"), F.lit(")"))
    text = F.concat(kind, F.lit("("), length.cast("string"), F.lit(")"))
    return (
        F.when((kind == "numeric") & precision.between(1, 38), numeric)
        .when(kind.isin("character", "character varying") & length.isNotNull(), text)
        .otherwise(kind)
    )


def spark_type(data_type: str) -> str:
    """Spark's name for a type of the database or of Spark itself; what has no
    counterpart is read as text."""
    base, _, size = data_type.partition("(")
    if base in POSTGRES_TYPES:
        named = {"numeric": "DECIMAL", "character": "CHAR", "character varying": "VARCHAR"}
        return f"{named[base]}({size}" if size and base in named else POSTGRES_TYPES[base]
    try:
        T.DataType.fromDDL(f"c {data_type}")
    except Exception:
        return FALLBACK_TYPE
    return data_type


def read_information_schema(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """``information_schema.columns`` of a database, over JDBC; the filters of
    ``catalog_columns`` are pushed to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable="information_schema.columns", **options)
        .load()
        .select("table_schema", "table_name", "column_name", "ordinal_position", "data_type", *_SIZES)
    )


def catalog_of_tables(spark: SparkSession, schema: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog of loaded tables: their schemas only, no row is read."""
    rows = [
        (schema, name, field.name, i, field.dataType.simpleString())
        for name, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def register_catalog(spark: SparkSession, catalog: DataFrame, location: str) -> None:
    """Make catalog tables known to the session, empty, so that statements over
    them can be analyzed. The session catalog lives in the driver, so this
    passes the names of tables and columns through it, never rows."""
    tables: dict[tuple[str, str], list] = {}
    ordered = catalog.orderBy("schema", "table", "ordinal")
    for row in ordered.toLocalIterator():
        tables.setdefault((row.schema, row.table), []).append(row)

    def name(text: str) -> str:
        return "`" + text.replace("`", "``") + "`"

    for schema in {key[0] for key in tables}:
        place = f"{location}/{schema}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name(schema)} LOCATION '{place}'")
    for (schema, table), columns in tables.items():
        fields = ", ".join(
            f"{name(c.column)} {spark_type(c.data_type)}" for c in columns
        )
        # a table kept from before may have had other columns
        spark.sql(f"DROP TABLE IF EXISTS {name(schema)}.{name(table)}")
        spark.sql(f"CREATE TABLE {name(schema)}.{name(table)} ({fields}) USING parquet")
