"""Sharding, line runs and BPE against plain versions."""

from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from colflow.llm.bpe import encode_documents, encoder, op2_bpe
from colflow.llm.line_runs import LineRuns, drop_frequent_lines, op3_line_dedup
from colflow.llm.sharding import assign_shards, jump_hash, op9_sharding


def test_jump_hash_known_values(spark):
    # published test values of the algorithm
    known = [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)]
    for key, n, shard in known:
        row = spark.range(key, key + 1).select(jump_hash(F.col("id"), n).alias("j")).first()
        assert (row.j.shard, row.j.grown) == (shard, brute.jump(key, n + 1))


@pytest.mark.parametrize("clash", [False, True])
def test_sharding(spark, clash):
    rows = brute.awkward()
    docs = brute.table(spark, rows)
    got = op9_sharding(spark, "", brute.with_clashes(docs) if clash else docs).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, brute.crc(r[1]), "key", brute.jump(r[0] or 0, 16), brute.jump(r[0] or 0, 17)) for r in rows]
    assert brute.ordered((*r[:5], r[6]) for r in got) == brute.ordered(want)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_keeps_all_columns_and_splits_a_hot_key(spark):
    rows = spark.range(0, 3000, 1, 6).selectExpr("id % 3 * 0 as k", "id as row", "'old' as shard")
    got = assign_shards(rows, "k", 5).collect()
    assert sorted(r.row for r in got) == list(range(3000)) and len({r.shard for r in got}) == 1
    assert sorted(r.slot for r in got) == list(range(3000))


def test_line_dedup(spark):
    rows = brute.awkward()
    docs = brute.table(spark, rows)
    want = brute.ordered(brute.line_dedup(rows))
    assert brute.ordered(op3_line_dedup(spark, "", docs).collect()) == want
    assert brute.ordered(op3_line_dedup(spark, "", brute.with_clashes(docs)).collect()) == want


def test_line_dedup_keeps_columns(spark):
    docs = brute.table(spark)
    got = drop_frequent_lines(docs, 2, 1)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "text", "n_lines", "n_dropped"]
    assert got.count() == docs.count()


def test_runs_do_not_depend_on_batches(spark):
    docs = brute.table(spark)
    one, many = (drop_frequent_lines(docs, 3, b).collect() for b in (1, 7))
    assert brute.ordered(one) == brute.ordered(many)


def test_runs_compact(spark):
    runs = LineRuns(spark, 2)
    for i in range(5):
        runs.add(spark.createDataFrame([(bytearray([i]),), (b"x",)], "line_key binary"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [bytes(r.line_key) for r in runs.frequent().collect()] == [b"x"]
    # once known as frequent, a key is not stored again
    assert {bytes(r.line_key): r.n_docs for r in runs.totals().collect()}[b"x"] < 5


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = brute.awkward() + [(7000, "naïve\x1cΣΑΣ a\x85b don't 'RE 1²x <|endoftext|", None, None, 0)]
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(lib.decode(ids, skip_special_tokens=False))))
    docs = brute.table(spark, rows)
    assert brute.ordered(op2_bpe(spark, "", docs).collect()) == brute.ordered(want)
    assert brute.ordered(op2_bpe(spark, "", brute.with_clashes(docs)).collect()) == brute.ordered(want)
    full = encode_documents(docs, path).collect()
    assert brute.ordered((r[0], len(r.ids), brute.sha(" ".join(map(str, r.ids))), brute.sha(r.decoded)) for r in full) == brute.ordered(want)


def test_bpe_of_real_texts(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids_sha256 for r in op2_bpe(spark, sf_dir).collect()}
    assert got == {r.doc_id: brute.sha(" ".join(map(str, lib.encode(r.text, add_special_tokens=False).ids))) for r in rows}


def test_encoder_memory_is_bounded():
    import public_tokenizers

    from colflow.llm import bpe

    enc = bpe.TrieEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for first in range(0, 1_000_000, 50_000):
        enc.learn({f"{i * 7919:x}" for i in range(first, first + 50_000)})
        held = sum(bpe.ENTRY + len(p) + len(ids) for p, ids in enc.young.items())
        assert held == enc.held <= bpe.MEMORY and len(enc.fits) <= bpe.PAIRS
        assert sum(bpe.ENTRY + len(p) + len(ids) for p, ids in enc.old.items()) <= bpe.MEMORY
    enc.forget()
    assert not enc.young and not enc.old and not enc.fits


def test_trie_walk_equals_merging():
    import public_tokenizers

    enc = encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["in", "inn", "inner", "innert", "th", "the", "then", "q" * 40, "ab" * 30, "x"]
    for word, ids in enc.encode_words(words).items():
        assert ids == [enc.ids[t] for t in enc.merge(enc.units(word + enc.end))]


@pytest.mark.parametrize("query", [op2_bpe, op3_line_dedup, op9_sharding])
def test_empty_table(spark, query):
    assert query(spark, "", spark.createDataFrame([], brute.SCHEMA)).collect() == []
