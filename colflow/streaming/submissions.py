"""Lineage for a stream of statement submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from colflow.session import materialize
from colflow.sources.harvest import PlanStore
from colflow.sources.lineage import analyze_texts
from colflow.sources.statements import statement_fingerprint


def stream_lineage(
    submissions: DataFrame, path: str, failures_path: str, checkpoint: str, store: PlanStore, **settings: bool
) -> StreamingQuery:
    """Append the lineage edges of each submission as it arrives.

    ``submissions(statement_id, sql, default_schema)`` is a stream. Each batch
    takes the way of the batch operators: its distinct texts are fingerprinted,
    known ones come from the plan ``store``, new ones are analyzed and added to it,
    and the results go back to every submission, hot texts over several keys.
    What cannot be analyzed goes to ``failures_path``.

    A batch is written under its own number and overwrites what an interrupted
    attempt left, so a restarted query neither loses nor repeats one.
    """

    def process(batch: DataFrame, number: int) -> None:
        arrived, texts = statement_fingerprint(materialize(batch, "submissions"))
        lineage = analyze_texts(batch.sparkSession, texts, store=store, **settings).of(arrived)
        lineage.origins.write.mode("overwrite").parquet(f"{path}/batch={number}")
        lineage.failures.write.mode("overwrite").parquet(f"{failures_path}/batch={number}")

    return (
        submissions.select("statement_id", "sql", "default_schema")
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
