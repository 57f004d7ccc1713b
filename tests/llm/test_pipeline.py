"""The pipeline against the plain versions of its stages, and the registered names."""

import brute
from test_jaccard import grouped
from test_second import normal

import corpus_pipeline
from colflow.llm.decontaminate import shingles, similarity
from colflow.llm.queries import ORACLES, QUERIES
from colflow.llm.quality import op1_quality


def leaking(text, items):
    ws = [w.encode() for w in normal(text)]
    own = shingles(ws).keys()
    for item in items:
        for at in range(len(ws) - len(item) + 1 if own & shingles(item).keys() else 0):
            if similarity(shingles(ws[at : at + len(item)]), shingles(item)) >= 0.8:
                return True
    return False


def test_pipeline(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = {r.doc_id for r in op1_quality(spark, sf_dir).collect() if r.kept}
    rows = [r for r in rows if r[0] in kept]
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.FOLD)
    count = {}
    for r in rows:
        for key in {strip(x) for x in r[1].split("\n")}:
            count[key] = count.get(key, 0) + 1
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if not strip(x) or count[strip(x)] < 10)) for r in rows]
    rows = [r for r, (d, _, c) in zip(rows, grouped(rows, 5, 80), strict=True) if d == c]
    items = [[w.encode() for w in normal(r.text)] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not leaking(r[1], items)]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: brute.sha(" ".join(map(str, lib.encode(r[1], add_special_tokens=False).ids))) for r in rows}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(want) < len(kept)


def test_stages_keep_the_columns_and_awkward_rows(spark, sf_dir):
    docs = brute.with_clashes(brute.table(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and after.count() <= docs.count()
        own = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "lang", "source", "n_chars", "text")]
        assert {tuple(r) for r in after.select(*own).distinct().collect()} <= {("x",) * len(own)}
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_oracles(spark, sf_dir, duck):
    from oracle import compare

    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, sf_dir), duck, sql) is None, name
