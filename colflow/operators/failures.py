"""Triage of statements that could not be analyzed."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: exceptions that mean bad SQL or bad input
CLIENT_ERRORS = [
    "SqlParseException", "ValidationException", "RelConversionException", "IllegalArgumentException",
    "HttpMessageNotReadableException", "ParseException", "AnalysisException", "ExtendedAnalysisException",
]
DATABASE_ERROR = "SQLException"
REASONS = {status.value: status.phrase for status in HTTPStatus}


def _simple_name(error_class: str = "error_class") -> Column:
    """Name without packages and without the classes it is nested in."""
    return F.substring_index(F.substring_index(error_class, ".", -1), "$", -1)


def classify_failures(failures: DataFrame) -> DataFrame:
    """Adds ``status``: 500 for the database's errors, 400 for the client's, each
    with their subclasses (``ancestors``, the superclasses' names); any other
    error keeps its own status (``own_status``) or is 500.

    Outside the database's errors, SQLSTATE class 42 is a syntax or naming error
    whatever the class.
    """
    own = F.col("own_status") if "own_status" in failures.columns else F.lit(None).cast("int")
    state = F.col("sqlstate") if "sqlstate" in failures.columns else F.lit(None).cast("string")
    above = F.col("ancestors") if "ancestors" in failures.columns else F.lit(None).cast("array<string>")
    classes = F.concat(F.array("error_class"), F.coalesce(above, F.array().cast("array<string>")))

    def is_one_of(names: list[str]) -> Column:
        return F.exists(classes, lambda c: F.substring_index(F.substring_index(c, ".", -1), "$", -1).isin(names))

    return failures.withColumn(
        "status",
        F.when(is_one_of([DATABASE_ERROR]), 500)
        .when(is_one_of(CLIENT_ERRORS) | F.coalesce(state.startswith("42"), F.lit(False)), 400)
        .otherwise(F.coalesce(own, F.lit(500))),
    )


def root_message(failures: DataFrame) -> DataFrame:
    """First message along the cause chain that is not blank, else the simple
    name of the error's class."""
    told = F.filter("chain", lambda m: m.isNotNull() & ~m.rlike(r"^\s*$"))
    return failures.withColumn("message", F.coalesce(F.get(told, F.lit(0)), _simple_name()))


def error_body(failures: DataFrame) -> DataFrame:
    shaped = root_message(classify_failures(failures))
    return shaped.select("statement_id", "status", "message", F.col("error_class").alias("exception"))


def error_text(bodies: DataFrame) -> DataFrame:
    """What a user is shown: the message if there is one, else the ``error`` that
    the reply names, else the status line."""
    reason = F.create_map(*[x for status, text in REASONS.items() for x in (F.lit(status), F.lit(text))])
    told = [F.when(F.col(c) != "", F.col(c)) for c in ("message", "error") if c in bodies.columns]
    detail = F.coalesce(*told)
    return bodies.select(
        "statement_id",
        F.concat(
            F.lit("HTTP "),
            F.col("status").cast("string"),
            F.coalesce(
                F.concat(F.lit(": "), detail),
                F.concat(F.lit(" "), F.coalesce(F.try_element_at(reason, F.col("status")), F.lit(""))),
            ),
        ).alias("text"),
    )


def quarantine_split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, failed)``: two filters over one table of results."""
    failed = F.col("error_class").isNotNull()
    return results.filter(~failed).drop("error_class", "chain", "ancestors"), results.filter(failed)
