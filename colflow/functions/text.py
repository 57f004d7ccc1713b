"""Text expressions: statement normalisation, row ids, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A statement is a sequence of runs: text without blanks (quoted parts whole),
# then blanks and comments. Possessive repeats: one pass, no backtracking.
_QUOTED = (
    r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
    r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
    r"|`[^`]*+`"
)
_COMMENT = r"--[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
_BLANKS = rf"(?:\s++|{_COMMENT})++"
_TEXT = rf"(?:[^\s'\"`/-]++|{_QUOTED}|(?!{_COMMENT})\S)++"
STATEMENT_RUN = rf"({_TEXT})(?:{_BLANKS})?+|{_BLANKS}"


def normalize_statement(sql: Column) -> Column:
    """Collapse blanks and comments outside quotes; case is kept."""
    spaced = F.regexp_replace(sql, STATEMENT_RUN, "$1 ")
    return F.regexp_replace(F.trim(spaced), r"[\s;]+$", "")


def text_key(sql: Column, default_schema: Column) -> Column:
    """Key of a statement exactly as written."""
    return F.sha2(F.concat_ws("\n", F.coalesce(default_schema, F.lit("")), sql), 256)


def fingerprint(sql: Column, default_schema: Column) -> Column:
    """Key of a statement whatever its layout."""
    return text_key(normalize_statement(sql), default_schema)


def sql_type(json_type: Column) -> Column:
    """Type names of Spark's schema JSON to the names SQL users write."""
    return (
        F.when(json_type == "long", "bigint")
        .when(json_type == "integer", "int")
        .when(json_type == "short", "smallint")
        .when(json_type == "byte", "tinyint")
        .otherwise(json_type)
    )


# fixed values: the prefixes of row ids
def source_row_id(schema: Column, table: Column, column: Column) -> Column:
    return F.concat(F.lit("src-"), F.concat_ws(".", schema, table, column))


def target_row_id(ordinal: Column, target: Column) -> Column:
    """With the position, for output names may repeat."""
    return F.concat(F.lit("tgt-"), ordinal.cast("string"), F.lit("-"), target)
