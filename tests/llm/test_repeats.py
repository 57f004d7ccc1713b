"""Recompression and subword lattices against plain versions."""

import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import brute
import numpy as np
import pytest

from colflow.llm import lattice
from colflow.llm.hashing import FOLDED, PLAIN, shingle_hashes, word_hashes
from colflow.llm.lattice import Lattice, op5_lm_score
from colflow.llm.recompress import WIDTH, Parsed, op4_substring_dedup


def long_rows():
    rng = random.Random(4)
    rows = brute.awkward()
    shared = [rng.choices("abcdefghij", k=n) for n in (49, 50, 51, 120)]
    for i in range(30):
        own = ["".join(rng.choices("abcdef", k=3)) for _ in range(rng.randint(0, 90))]
        at = rng.randint(0, len(own))
        own[at:at] = shared[i % 4]
        rows.append((10_000 + i % 25, rng.choice([" ", "\n\t"]).join(own), None, None, 0))
    rows += [(20_000, "w " * 300, None, None, 0), (20_001, "v " + "w " * 70 + "v", None, None, 0)]
    rows += [(20_002, "a b " * 200, None, None, 0), (20_003, "x " + "b a " * 60, None, None, 0)]
    return rows


def repeats(rows):
    first = {}
    for doc_id, text, *_ in rows:
        ws = brute.words(text)
        for i in range(len(ws) - WIDTH + 1):
            w = tuple(ws[i : i + WIDTH])
            if doc_id is not None:
                first[w] = min(doc_id, first.get(w, doc_id))
    out = []
    for doc_id, text, *_ in rows:
        ws = brute.words(text)
        gone = set()
        for i in range(len(ws) - WIDTH + 1 if doc_id is not None else 0):
            if first[tuple(ws[i : i + WIDTH])] < doc_id:
                gone.update(range(i, i + WIDTH))
        out.append((doc_id, len(ws), len(gone), brute.sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_substring_dedup(spark, clash):
    rows = long_rows()
    docs = brute.table(spark, rows)
    got = op4_substring_dedup(spark, "", brute.with_clashes(docs) if clash else docs).collect()
    want = repeats(rows)
    assert sum(r[2] > 0 for r in want) > 30
    assert brute.ordered(got) == brute.ordered(want)


def test_substring_dedup_of_real_texts(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert brute.ordered(op4_substring_dedup(spark, sf_dir).collect()) == brute.ordered(repeats(rows))


def test_substring_dedup_by_shuffled_ids(spark, monkeypatch):
    from colflow.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = long_rows()
    assert brute.ordered(op4_substring_dedup(spark, "", brute.table(spark, rows)).collect()) == brute.ordered(repeats(rows))


def test_windows_with_equal_words_have_equal_symbols():
    rng = random.Random(8)
    passage = [rng.choice("abcdefgh") for _ in range(400)]
    texts = [" ".join(rng.choices("xyzab", k=n) + passage + rng.choices("xyzab", k=30)).encode() for n in (0, 1, 17, 60)]
    words, begin = word_hashes(texts, PLAIN)
    doc, start, key, whole = Parsed(words, begin).windows()
    found = {}
    for d, s, k, w in zip(doc.tolist(), start.tolist(), key.tolist(), whole.tolist(), strict=True):
        text = b" ".join(texts[d].split()[s - begin[d] : s - begin[d] + WIDTH])
        assert found.setdefault(text, (k, w)) == (k, w)
    # most windows are represented by a symbol they share with their neighbours
    assert len(set(key.tolist())) < len(found) / 4


def test_hashes_depend_on_words_alone(monkeypatch):
    from colflow.llm import hashing

    texts = [b"One two  three", b"", b"three\none", "é " .encode() * 50, b"x" * 300 + b" y"]
    whole, begin = word_hashes(texts, FOLDED)
    assert begin.tolist() == [0, 3, 3, 5, 55, 57]
    assert whole[0] == whole[4] and whole[2] == whole[3] and len(set(whole.tolist())) == 6
    monkeypatch.setattr(hashing, "BLOCK", 16)
    again, _ = word_hashes(texts, FOLDED)
    assert (whole == again).all()
    assert len(shingle_hashes(whole[:3], 5)) == 0 and len(shingle_hashes(whole, 5)) == 53


# ---------------------------------------------------------------- language model


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def probability(pieces, logp, vocabulary, word):
    """Sum over all segmentations, one by one."""
    marked = "▁" + word

    @lru_cache(None)
    def after(i):
        if i == len(marked):
            return 1.0
        total = sum(math.exp(vocabulary[marked[i:j]]) * after(j) for j in range(i + 1, len(marked) + 1) if marked[i:j] in vocabulary)
        if marked[i] not in vocabulary:
            total += math.exp(sum(logp[pieces.bytes[b]] for b in marked[i].encode())) * after(i + 1)
        return total

    return after(0)


@pytest.mark.parametrize("clash", [False, True])
def test_scores(spark, path, clash, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = lattice._pieces(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    rows = brute.awkward()
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows}
    texts = [(r[0], brute.words((r[1] or "").translate(brute.FOLD))) for r in rows]
    counts, train = Counter(), 0
    for doc_id, ws in texts:
        if not held[doc_id]:
            counts.update(ws)
            train += 1
    n, v = counts.total() + train, len(counts) + 1
    # expectation step, edge by edge
    logp = np.log(pieces.prior)
    expected = lattice.PRIOR * pieces.prior
    vocabulary = {names[i]: logp[i] for i in pieces.ids}
    for word, c in {w: c for w, c in counts.items() if c}.items():
        one = Lattice(pieces, logp, [word])
        assert math.exp(one.forward()[0, -1]) == pytest.approx(probability(pieces, logp, vocabulary, word), rel=1e-9)
        expected += one.expected(np.array([float(c)]))
    expected[pieces.end] += train
    learned = np.log(expected / expected.sum())
    vocabulary = {names[i]: learned[i] for i in pieces.ids}
    single = {w: math.log10(probability(pieces, learned, vocabulary, w)) for _, ws in texts for w in ws}
    want = []
    for doc_id, ws in texts:
        base = [math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in ws), train]]
        score = [single[w] for w in ws] + [learned[pieces.end] / math.log(10)]
        want.append((doc_id, held[doc_id], len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, f"{math.fsum(base):.6g}", f"{math.fsum(score):.6g}"))
    if clash:
        monkeypatch.setattr(lattice, "HEAD", 20)
    docs = brute.table(spark, rows)
    got = op5_lm_score(spark, "", brute.with_clashes(docs) if clash else docs).collect()
    assert brute.ordered((*r[:5], f"{r.base_score:.6g}", f"{r.score:.6g}") for r in got) == brute.ordered(want)


def test_learning_improves_held_out_texts(spark, sf_dir, path, monkeypatch):
    learned = op5_lm_score(spark, sf_dir).filter("held_out").selectExpr("sum(score) s").first().s
    monkeypatch.setattr(lattice, "learn_pieces", lambda v, p, t: np.log(lattice._pieces(p).prior))
    prior = op5_lm_score(spark, sf_dir).filter("held_out").selectExpr("sum(score) s").first().s
    assert learned > prior


def test_lattice_of_a_long_word(path):
    pieces = lattice._pieces(path)
    long = Lattice(pieces, np.log(pieces.prior), ["日q" * 500])
    assert np.isfinite(long.forward()[0, -1])
    assert long.forward()[0, -1] == pytest.approx(long.backward()[0, 0], rel=1e-9)


@pytest.mark.parametrize("query", [op4_substring_dedup, op5_lm_score])
def test_empty_table(spark, query):
    assert query(spark, "", spark.createDataFrame([], brute.SCHEMA)).collect() == []
    nothing = brute.table(spark, [(1, None, None, None, 0), (None, "", None, None, 0)])
    assert query(spark, "", nothing).count() == 2
