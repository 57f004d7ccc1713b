"""Only the rows that hold an item go, whatever ids they share."""

import brute
import pytest

from colflow.llm.decontaminate import drop_leaks

ITEM = "an item of the benchmark with ten words in it"


@pytest.mark.parametrize("clash", [False, True])
def test_rows_with_null_and_repeated_ids(spark, clash):
    leak = f"before {ITEM} after"
    clean = [(None, "clean without id"), (None, "clean without id"), (None, None), (None, ""), (1, "clean with a used id"), (1, None), (2, "clean")]
    leaks = [(None, leak), (1, leak), (1, leak), (3, leak)]
    docs = brute.table(spark, [(d, t, None, None, 0) for d, t in clean + leaks])
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    if clash:
        docs, benchmark = brute.with_clashes(docs), brute.with_clashes(benchmark)
    after = drop_leaks(docs, benchmark)
    assert after.columns == docs.columns
    assert brute.ordered(after.select("doc_id", "text").collect()) == brute.ordered(clean)
    assert drop_leaks(docs, benchmark.limit(0)).count() == docs.count()
