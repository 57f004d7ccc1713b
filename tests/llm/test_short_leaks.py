"""Documents that are a benchmark item with some words missing."""

import random

import brute
import pytest
from test_second import leak_table, normal

from colflow.llm.decontaminate import op6_decontamination, shingles, similarity


def best_windows(rows, items):
    """(-similarity, first word, words) by document and item; a text of fewer words
    than the item is its one window."""
    want = {}
    for doc_id, text, *_ in rows:
        ws = [w.encode() for w in normal(text)]
        for item_id, item in items:
            target = [w.encode() for w in normal(item)]
            n = min(len(target), len(ws))
            for at in range(len(ws) - n + 1 if n else 0):
                close = similarity(shingles(ws[at : at + n]), shingles(target))
                if close >= 0.8 and (-close, at) < want.get((doc_id, item_id), (0, 0))[:2]:
                    want[doc_id, item_id] = (-close, at, n)
    return want


@pytest.mark.parametrize("clash", [False, True])
def test_shortened_items(spark, clash):
    rng = random.Random(8)
    rows, items = leak_table(spark)
    long = [i for i in items if i[1] and len(normal(i[1])) >= 20]
    long.append((70, " ".join("w%d" % rng.randrange(500) for _ in range(59))))
    items.append(long[-1])
    short = []
    for item_id, item in long:
        ws = normal(item)
        short += [ws[:-k] for k in (1, 3, 12)] + [ws[k:] for k in (1, 3, 12)] + [ws[:9] + ws[10:], ws[:5], ws[:2]]
    rows += [(7000 + i, " ".join(ws), None, None, 0) for i, ws in enumerate(short)]
    docs, benchmark = brute.table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    if clash:
        docs, benchmark = brute.with_clashes(docs), brute.with_clashes(benchmark)
    got = op6_decontamination(spark, "", docs, benchmark).collect()
    want = best_windows(rows, items)
    assert {(r.doc_id, r.item_id): (-r.similarity, r.first_word, r.n_words) for r in got} == want
    # the first 56 of 59 words
    assert want[7000 + 9 * (len(long) - 1) + 1, 70][0] == -52 / 55
