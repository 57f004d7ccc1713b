"""The Jaccard join and its parts against all pairs."""

import random

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from colflow.llm import common, jaccard
from colflow.llm.components import components
from colflow.llm.jaccard import JaccardJoin, Sizes, drop_near_duplicates, op7_jaccard_join


def shingles(text, n):
    ws = brute.words((text or "").translate(brute.FOLD))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) or frozenset([tuple(ws)])


def grouped(rows, n, percent):
    """(doc_id, set size, component) by comparing all pairs."""
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(rows[i][0])
    return [(r[0], len(sets[i]), min((d for d in members[top(i)] if d is not None), default=None)) for i, r in enumerate(rows)]


def near_rows(seed=9):
    """Chains of copies around the threshold: neighbours link, ends do not."""
    rng = random.Random(seed)
    rows = brute.awkward()
    for g in range(8):
        text = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.choice([12, 30, 60, 150, 400]))]
        for i in range(25):
            rows.append((20_000 + rng.randrange(10_000) * 10 + g, " ".join(text), None, None, 0))
            for _ in range(rng.choice([1, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"new{i}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_components_of_near_copies(spark, words, percent):
    rows = near_rows(words)
    found = JaccardJoin(brute.with_clashes(brute.table(spark, rows)), words, percent).documents()
    got = found.select("doc_id", "n_shingles", "component_id").collect()
    want = grouped(rows, words, percent)
    assert len({r[2] for r in want}) < len(rows) - 50
    assert brute.ordered(got) == brute.ordered(want)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert brute.ordered(op7_jaccard_join(spark, sf_dir).collect()) == brute.ordered(grouped(rows, 3, 90))


def test_other_ways_give_the_same(spark, monkeypatch):
    rows = near_rows(1)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(jaccard, "PART_DOCS", 20)
    monkeypatch.setattr(jaccard, "GATHER", 2000)
    assert brute.ordered(op7_jaccard_join(spark, "", brute.table(spark, rows)).collect()) == brute.ordered(grouped(rows, 3, 90))


@pytest.mark.parametrize("percent", [90, 80])
def test_index_meets_every_pair_at_the_threshold(percent):
    rng = random.Random(percent)
    sizes = Sizes(percent)
    for _ in range(600):
        n = rng.choice([2, 5, 9, 10, 11, 20, 47, 100, 300])
        base = [rng.getrandbits(64) for _ in range(n)]
        other = set(base)
        # swap, add or remove as much as the threshold allows
        while True:
            step = set(other)
            kind = rng.random()
            if kind < 0.6 and step & set(base):
                step.remove(rng.choice(sorted(step & set(base))))
            if kind > 0.4:
                step.add(rng.getrandbits(64))
            if not step or 100 * len(step & set(base)) < percent * len(step | set(base)):
                break
            other = step
        if other == set(base):
            continue
        a, b = (np.array(sorted(x), np.uint64) for x in (base, other))
        signs = [{int(s) for part in jaccard._signatures(x, len(x), sizes) for s in part} for x in (a, b)]
        assert signs[0] & signs[1], (n, len(other))


@pytest.mark.parametrize("percent", [90, 80])
@pytest.mark.parametrize("bits", [64, 61, 56])
def test_index_meets_all_small_sets(percent, bits):
    """Sets of up to 12 shingles, also where hashes crowd into few segments: each set
    against each that links with it by leaving out or exchanging shingles."""
    rng = random.Random(percent + bits)
    sizes = Sizes(percent)
    for n in range(1, 13):
        for _ in range(40):
            base = {rng.getrandbits(bits) for _ in range(n)}
            spare = [rng.getrandbits(bits) for _ in range(3)]
            signs = lambda x: {int(s) for part in jaccard._signatures(np.array(sorted(x), np.uint64), len(x), sizes) for s in part}
            own = signs(base)
            for out in range(3):
                for extra in range(4):
                    other = set(rng.sample(sorted(base), max(n - out, 0))) | set(spare[:extra])
                    if other and other != base and 100 * len(other & base) >= percent * len(other | base):
                        assert own & signs(other), (n, out, extra)


def test_components_of_graphs(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (-5, 8), (8, -5)]
    rng.shuffle(edges)
    got = {r.node: r.low for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: low[x] for x in linked}


def test_one_of_each_group_stays(spark):
    rows = near_rows(2)
    docs = brute.with_clashes(brute.table(spark, rows))
    kept = drop_near_duplicates(docs)
    want = [r[0] for r, (d, _, c) in zip(rows, grouped(rows, 5, 80), strict=True) if c is None or d == c]
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_empty(spark):
    assert op7_jaccard_join(spark, "", spark.createDataFrame([], brute.SCHEMA)).collect() == []
    nothing = brute.table(spark, [(1, None, None, None, 0), (None, "", None, None, 0), (2, " ", None, None, 0)])
    assert brute.ordered(op7_jaccard_join(spark, "", nothing).collect()) == brute.ordered([(1, 0, 1), (None, 0, None), (2, 0, 2)])
    assert drop_near_duplicates(nothing).count() == 3


@pytest.mark.parametrize(("words", "percent", "few"), [(3, 90, 1), (5, 80, 1), (3, 90, 10_000)])
def test_short_and_long_lists_give_the_same(spark, monkeypatch, words, percent, few):
    """All lists by their hubs and centres, some, and all by their pairs."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = near_rows(words + 20)
    got = JaccardJoin(brute.table(spark, rows), words, percent).documents().select("doc_id", "n_shingles", "component_id").collect()
    assert brute.ordered(got) == brute.ordered(grouped(rows, words, percent))


def test_copies_with_changes_of_their_own_are_not_paired(spark, monkeypatch):
    """Copies of one text that differ too much to link: what they differ in from the
    one they are compared with is common to all of them, from their centre it is not."""
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(150)]
    rows = []
    for i in range(240):
        text = list(base)
        for at in rng.sample(range(150), 5):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text), None, None, 0))
    counts = {}

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    plain = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", counted)
    got = op7_jaccard_join(spark, "", brute.table(spark, rows)).collect()
    assert brute.ordered(got) == brute.ordered(grouped(rows, 3, 90))
    assert counts["met-blocks"] < 240 * 4 and counts["candidates"] < 240 * 4


def test_members_that_share_passages_are_not_paired(spark, monkeypatch):
    """Texts of one head and half of the same passages each: any two share some of what
    they differ in from their centre, too little to link; a few differ by a word only."""
    rng = random.Random(12)

    def some(n):
        return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]

    head, passages, rows = some(120), [some(12) for _ in range(24)], []
    for i in range(160):
        text = head + [w for p in rng.sample(passages, 12) for w in p] + some(20)
        rows.append((i, " ".join(text), None, None, 0))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join([*text[:-1], "last"]), None, None, 0))
    counts = {}

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    plain = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", counted)
    got = JaccardJoin(brute.table(spark, rows), 5, 80).documents().select("doc_id", "n_shingles", "component_id").collect()
    assert brute.ordered(got) == brute.ordered(grouped(rows, 5, 80))
    assert counts["entries"] > 160 and counts["met-blocks"] < 160 and counts["candidates"] < 160, counts


def test_sketches_lose_no_link():
    rng = random.Random(8)
    for n in (1, 20, 300, 3000):
        base = [rng.getrandbits(64) for _ in range(n)]
        other = base[n // 8 :] + [rng.getrandbits(64) for _ in range(n // 9)]
        sets = [np.array(sorted(x), np.uint64) for x in (base, other)]
        at = np.cumsum([0, *map(len, sets)])
        a, b = (np.frombuffer(x, np.uint8).astype(int) for x in jaccard._sketches(np.concatenate(sets), at))
        assert np.abs(a - b).sum() <= len(set(base) ^ set(other))


def test_components_of_stars_that_begin_at_the_smallest(spark):
    edges = [(1, 2), (1, 3), (3, 1), (9, 8)]
    got = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def sizes_of_tables(monkeypatch):
    """Rows of each table that the join writes, by name."""
    counts, plain = {}, jaccard.materialize

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    return counts


def test_members_with_enough_of_their_own_are_not_compared(spark, monkeypatch):
    """Texts of one head, each with a fourth of its own, stand in long lists and link with
    none; copies of a few of them do, and are all that is compared."""
    rng = random.Random(21)

    def some(n):
        return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]

    head, rows = some(150), []
    for i in range(200):
        text = head + some(50)
        rows.append((i, " ".join(text), None, None, 0))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join([*text[:-1], "last"]), None, None, 0))
    counts = sizes_of_tables(monkeypatch)
    got = JaccardJoin(brute.table(spark, rows), 5, 80).documents().select("doc_id", "n_shingles", "component_id").collect()
    assert brute.ordered(got) == brute.ordered(grouped(rows, 5, 80))
    assert counts["members"] > 160 and counts["pairs"] == 5, counts


def versions(seed=22, count=200):
    """Versions of one text that differ in places where only two words come up: none has
    a shingle to itself, few pairs link."""
    rng = random.Random(seed)
    words = [["".join(rng.choices("abcdefgh", k=5)) for _ in range(2)] for _ in range(300)]
    rows = []
    for i in range(count):
        text = [w[at % 5 == 2 and rng.random() < 0.3] for at, w in enumerate(words)]
        rows.append((i, " ".join(text), None, None, 0))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join([*text[:-1], "last"]), None, None, 0))
    return rows


def test_versions_are_compared_if_their_sketches_allow_it(spark, monkeypatch):
    rows, counts = versions(), sizes_of_tables(monkeypatch)
    got = JaccardJoin(brute.table(spark, rows), 5, 80).documents().select("doc_id", "n_shingles", "component_id").collect()
    assert brute.ordered(got) == brute.ordered(grouped(rows, 5, 80))
    assert counts["rare-lists"] > 200 and counts["pairs"] < 50, counts


@pytest.mark.parametrize(("few", "many"), [(1, 1), (1, 1024)])
def test_lists_of_versions_by_hubs_and_sketches_give_the_same(spark, monkeypatch, few, many):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 2000)
    rows = versions(few + many, 60) + near_rows(30)
    got = JaccardJoin(brute.table(spark, rows), 5, 80).documents().select("doc_id", "n_shingles", "component_id").collect()
    assert brute.ordered(got) == brute.ordered(grouped(rows, 5, 80))


@pytest.mark.parametrize("percent", [90, 80])
def test_rarest_shingles_meet_every_pair_at_the_threshold(percent):
    """Sets that share shingles widely: any two that link share one of their first."""
    rng = random.Random(percent)
    pool = [rng.getrandbits(64) for _ in range(60)]
    sets = [set(rng.sample(pool, rng.randrange(2, 40))) for _ in range(60)]
    for base in sets[:40]:
        other = set(base)
        for _ in range(rng.randrange(1, 5)):
            other ^= {rng.choice(pool)} if rng.random() < 0.7 else {rng.getrandbits(64)}
        sets.append(other or base)
    sizes = np.array([len(x) for x in sets])
    tokens = np.array([x for some in sets for x in sorted(some)], np.uint64)
    blocks = jaccard._blocks(tokens % np.uint64(4), (tokens >> np.uint64(32)).astype(np.uint32), np.repeat(np.arange(len(sets)), sizes))
    blocks = pa.table(blocks)
    shared = pa.concat_tables([jaccard._repeated(blocks.filter(pc.equal(blocks["part"], k))) for k in range(4)])
    first = jaccard._rarest(shared.append_column("size", pa.array(sizes[shared["node"].to_numpy()])), percent)
    met = set()
    for k in range(4):
        some = first.filter(pc.equal(first["part"], k))
        if some.num_rows:
            lists = jaccard._lists(some, 1 << 20)
            met |= set(zip(lists["u"].to_pylist(), lists["v"].to_pylist(), strict=True))
    linked = 0
    for v in range(len(sets)):
        for u in range(v):
            if sets[u] != sets[v] and 100 * len(sets[u] & sets[v]) >= percent * len(sets[u] | sets[v]):
                linked += 1
                assert (u, v) in met, (sizes[u], sizes[v])
    assert linked > 5
