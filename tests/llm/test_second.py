"""Quality rules, notices, decontamination and archives against plain versions."""

import math
import random
import zipfile
from collections import Counter, defaultdict

import brute
import pytest
import regex
from pyspark.sql import functions as F

from colflow.llm import quality, warc_zip
from colflow.llm.decontaminate import BLOCKS, RADIUS, HammingBlocks, op6_decontamination, shingles, similarity
from colflow.llm.notices import NOTICES, PHRASES, edits_allowed, fuzzy_places, op8_license_scan, scan_notices
from colflow.llm.quality import binomial_tail, op1_quality
from colflow.llm.warc_zip import op10_warc, payload_digest, plan_records, read_archives, write_archives


# ---------------------------------------------------------------- quality


def base_row(text):
    ws = brute.words(text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("clash", [False, True])
def test_base_rules(spark, clash):
    rows = brute.awkward()
    docs = brute.table(spark, rows)
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = op1_quality(spark, "", brute.with_clashes(docs) if clash else docs, labels).collect()
    assert brute.ordered(r[:7] for r in got) == brute.ordered((r[0], *base_row(r[1])) for r in rows)
    # four labels prove nothing, so only the base rules reject
    assert all(r.kept == (not r.base_failed) for r in got)


def test_repeated_words_both_ways(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=n)) for n in (0, 3, 4, 5, 60)] + [" ".join(rng.choices("abcdefgh", k=2000))]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_repeat_words for r in quality.with_features(brute.table(spark, rows)).collect()}
    assert got == {i: base_row(t)[4] for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (0, 500), (3, 500), (9, 1000), (20, 5000), (5, 100), (700, 100_000), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for k, n, p in df.collect():
        if k >= n * 0.01:
            assert p == 1.0
            continue
        terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99) for i in range(k + 1))
        assert p == pytest.approx(math.fsum(map(math.exp, terms)), rel=1e-6)


def test_cutoffs_hold_the_risk(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        good = rng.random() < 0.7
        symbols = rng.randint(0, 2) if good else rng.randint(10, 60)
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
        rows.append((i, " ".join(words) + "*" * symbols, "en" if i % 3 else "xx" if i % 2 else None, "s", 0))
        labels += [(i, int(good), 0)] * (1 + i % 2)
    docs = brute.table(spark, rows)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in op1_quality(spark, "", docs, labelled).collect()}
    good = [i for i, q, _ in labels if q]
    bad = [i for i, q, _ in labels if not q]
    assert sum(not kept[i] for i in good) <= len(good) * quality.RISK * len(quality.RULES)
    assert sum(not kept[i] for i in bad) > len(bad) / 2
    # with swapped labels every cutoff rejects good documents, so none is accepted
    swapped = labelled.withColumn("quality", 1 - F.col("quality"))
    assert all(r.kept for r in op1_quality(spark, "", docs, swapped).collect())


# ---------------------------------------------------------------- notices


def normal(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.FOLD))


def test_notices(spark):
    extra = ["CC-BY cc by", "Releasd under the MlT License!", "xx all rights resrved. General Public\tLicense", "cc by cc by", "all rights reserved" * 2]
    rows = brute.awkward() + [(8000 + i, t, None, None, 0) for i, t in enumerate(extra)]
    got = op8_license_scan(spark, "", brute.with_clashes(brute.table(spark, rows))).collect()
    want = []
    for doc_id, text, *_ in rows:
        ws = normal(text)
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        labels, best = {label for _, label in at}, float(bool(at))
        joined = " ".join(ws)
        for notice, label in NOTICES.items():
            for m in regex.finditer(f"(?b)(?:{notice}){{e<={edits_allowed(notice)}}}", joined):
                labels.add(label)
                best = max(best, 1 - sum(m.fuzzy_counts) / len(notice))
        starts = [i for i, _ in at]
        base = ",".join(sorted({label for _, label in at}))
        want.append((doc_id, len(ws), len(at), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), round(best, 9)))
    assert brute.ordered((*r[:7], round(r.score, 9)) for r in got) == brute.ordered(want)


def test_seeds_lose_no_notice():
    rng = random.Random(11)
    chosen = tuple(NOTICES.items())
    for notice, label in chosen:
        for _ in range(40):
            letters = list(notice)
            for _ in range(edits_allowed(notice)):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], ["x"], [letters[at], "y"]])
            text = f"some words before {''.join(letters)} and after"
            assert label in {p[0] for p in fuzzy_places(text, chosen)}, text


def test_spans(spark):
    docs = brute.table(spark, [(1, "a b, Relesed under the MIT license c", None, None, 0)])
    (place,) = scan_notices(docs).first().places
    assert (place.label, place.first_word, place.last_word, place.edits, place.exact) == ("mit", 2, 6, 1, False)


# ---------------------------------------------------------------- decontamination


def leak_table(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("aeiou", k=4)) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([3, 5, 8, 20, 40, 40, 58])]
    items += [(90, None), (91, ""), (92, " ... "), (4, items[4][1]), (None, "an item without id to find here")]
    rows = brute.awkward()
    for i in range(40):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        item = items[i % 7][1].split()
        if i % 3:
            item = item[: len(item) - i % 3 + 1]
        if i % 5 == 4:
            item[rng.randrange(len(item))] = "other"
        rows.append((5000 + i, " ".join([*words, *item, *rng.choices(vocab, k=9)]).upper() + ".", None, None, 0))
    rows.append((6000, "An item: without ID, to find here", None, None, 0))
    return rows, items


@pytest.mark.parametrize("clash", [False, True])
def test_leaks(spark, clash):
    rows, items = leak_table(spark)
    docs, benchmark = brute.table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    if clash:
        docs, benchmark = brute.with_clashes(docs), brute.with_clashes(benchmark)
    got = op6_decontamination(spark, "", docs, benchmark).collect()
    want = {}
    for doc_id, text, *_ in rows:
        ws = [w.encode() for w in normal(text)]
        for item_id, item in items:
            target = [w.encode() for w in normal(item)]
            weights = shingles(target)
            for at in range(len(ws) - len(target) + 1 if target else 0):
                close = similarity(shingles(ws[at : at + len(target)]), weights)
                if close >= 0.8 and (-close, at) < want.get((doc_id, item_id), (0, 0)):
                    want[doc_id, item_id] = (-close, at)
    assert {(r.doc_id, r.item_id): (-r.similarity, r.first_word) for r in got} == want
    assert any(-c < 1 for c, _ in want.values()) and len(want) > 30


def test_hamming_blocks_find_all_within_the_radius():
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(30)]
    asked = []
    for p in prints:
        for bit in rng.sample(range(64), rng.choice([0, BLOCKS, RADIUS, RADIUS + 1])):
            p ^= 1 << bit
        asked.append(p)
    import numpy as np

    got = {(q, i) for q, i, _ in HammingBlocks(prints).within(np.array(asked, np.uint64))}
    assert got == {(q, i) for q, a in enumerate(asked) for i, p in enumerate(prints) if (a ^ p).bit_count() <= RADIUS}


def test_leaks_in_passes_are_the_same(spark, monkeypatch):
    from colflow.llm import decontaminate

    rows, items = leak_table(spark)
    docs, benchmark = brute.table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    whole = op6_decontamination(spark, "", docs, benchmark).collect()
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)
    assert brute.ordered(op6_decontamination(spark, "", docs, benchmark).collect()) == brute.ordered(whole)


# ---------------------------------------------------------------- archives

PAGES = "page_id long, url string, html string"


def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}é</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u v\r\n w", ""), (102, "", "\r\n\r\nWARC/1.1\r\n\r\n"), (103, "z", "é" * 200_000)]
    return rows + [(59, "again", rows[59][2]), (None, "no id", rows[3][2]), (None, "alone", "only here"), (None, "alone", "only here")]


@pytest.mark.parametrize("clash", [False, True])
def test_archives(spark, clash):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = op10_warc(spark, "", brute.with_clashes(pages) if clash else pages).collect()
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        kept = max((p for p in groups[html or ""] if p is not None), default=None)
        refers = kept if len(groups[html or ""]) > 1 and page_id != kept else None
        want.append((page_id, len(payload), payload_digest(payload), "response" if refers is None else "revisit", refers))
    assert brute.ordered(r[:5] for r in got) == brute.ordered(want)


def test_archive_round_trip_in_small_archives(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    manifest = write_archives(plan_records(pages), archive_bytes=2000)
    assert manifest.count() > 4
    back = read_archives(manifest, payloads=True).filter("record_type = 'response'").collect()
    texts = {html or "" for _, _, html in rows}
    assert {bytes(r.payload).decode() for r in back} == texts
    for row in manifest.collect():
        with zipfile.ZipFile(row.path.removeprefix("file://")) as packed:
            assert packed.testzip() is None and packed.namelist() == [warc_zip.DATA, warc_zip.INDEX]


def test_directory_with_zip64(tmp_path, monkeypatch):
    names = [f"f{i}" for i in range(70_000)]  # more than the plain end record can count
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as packed:
        for name in names:
            packed.writestr(name, name)
        packed.comment = b"a comment"
    with open(path, "rb") as file:
        members = warc_zip.read_directory(file, path.stat().st_size)
        assert list(members) == names
        file.seek(warc_zip.member_start(file, members["f69999"]))
        assert file.read(6) == b"f69999"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # offsets and sizes in the ZIP64 field
    path = tmp_path / "far.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as packed:
        for i in range(5):
            packed.writestr(f"f{i}", bytes([i]) * 150)
    with open(path, "rb") as file:
        for i in range(5):
            member = warc_zip.read_directory(file, path.stat().st_size)[f"f{i}"]
            file.seek(warc_zip.member_start(file, member))
            assert file.read(member[2]) == bytes([i]) * 150


def test_damaged_archives_are_refused(tmp_path):
    path = tmp_path / "x.zip"
    path.write_bytes(b"not a zip file at all")
    with open(path, "rb") as file, pytest.raises(ValueError):
        warc_zip.read_directory(file, 21)
    record = warc_zip.make_record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        warc_zip.parse_record(record.replace(b"payload\r\n", b"paxload\r\n"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], brute.SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op1_quality(spark, "", docs, labels).collect() == []
    assert op1_quality(spark, "", brute.table(spark), labels).count() == len(brute.awkward())
    assert op8_license_scan(spark, "", docs).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert op6_decontamination(spark, "", brute.table(spark), items).collect() == []
    assert op6_decontamination(spark, "", docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    assert op10_warc(spark, "", spark.createDataFrame([], PAGES)).collect() == []
