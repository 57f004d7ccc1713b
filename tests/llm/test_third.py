"""Token alignment, conversation repair and secret scans against plain versions."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from colflow.llm import alignment, conversations, secrets
from colflow.llm.alignment import align_documents, op11_token_alignment
from colflow.llm.conversations import cheapest_edits, damage, find_edits, op12_conversation_repair, repaired_turns
from colflow.llm.secrets import find_all, op13_secret_scan, with_spans

# ---- alignment -------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers as P

    return alignment.Pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def groups_of(pair, text):
    """Groups of (A ids, B ids) by walking both ends; none where a side differs."""
    if not text:
        return []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return []
    found, own, other, end_a, end_b = [], [], [], 0, 0
    a, b = iter(a), iter(b)
    while end_a < len(raw) or end_b < len(raw):
        if end_a <= end_b:
            own.append(next(a))
            end_a += len(pair.bytes_a[own[-1]])
        else:
            other.append(next(b))
            end_b += len(pair.bytes_b[other[-1]])
        if end_a == end_b:
            found.append((own, other))
            own, other = [], []
    return found


def aligned(pair, rows):
    per_doc = [groups_of(pair, r[1]) for r in rows]
    links = [Counter(p for own, other in groups for p in itertools.product(own, other)) for groups in per_doc]
    count = Counter(p for pairs in links for p in pairs)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for r, groups, pairs in zip(rows, per_doc, links, strict=True):
        written = ";".join(",".join(map(str, own)) + "|" + ",".join(map(str, other)) for own, other in groups)
        yield (
            r[0], sum(len(own) for own, _ in groups), sum(len(other) for _, other in groups), len(groups), pairs.total(),
            sum(n for (a, b), n in pairs.items() if count[a, b] == best[a]), sum(n * count[p] for p, n in pairs.items()),
            brute.sha(written) if written else "",
        )


ODD = [
    (7100, "x▁y", None, None, 0), (7101, "  two  blanks \t\n\n end ", None, None, 0), (7102, "<s></s><unk><0x41><|endoftext|>", None, None, 0),
    (7103, "a\x00b\x7f é́ 日本語😀 naïve ﬁ", None, None, 0), (7104, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, None, None, 0),
    (7105, "".join(random.Random(3).choices("abcXYZ019+/", k=3000)), None, None, 0),
]


def test_alignment(spark, pair):
    rows = brute.awkward() + ODD
    want = brute.ordered(aligned(pair, rows))
    docs = brute.table(spark, rows)
    first = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert brute.ordered(op11_token_alignment(spark, "", docs).select(*first).collect()) == want
    assert brute.ordered(op11_token_alignment(spark, "", brute.with_clashes(docs)).select(*first).collect()) == want


def test_alignment_in_small_pieces(pair, monkeypatch):
    """Chunks, stretches of links and groups by distinct ids give the same pairs."""
    texts = [r[1] for r in brute.awkward() + ODD]
    want = Counter(p for t in texts for p in {x for own, other in groups_of(pair, t) for x in itertools.product(own, other)})
    for big, links in ((1 << 16, 1 << 21), (3, 5), (0, 64)):
        monkeypatch.setattr(alignment, "BIG", big)
        monkeypatch.setattr(alignment, "LINKS", links)
        keys = alignment._aligned(pair, texts)[1].of_documents()
        mask = (1 << pair.shift) - 1
        assert Counter((int(k) >> pair.shift, int(k) & mask) for k in keys) == want


def test_ranks_encode_as_the_file(pair):
    assert pair.fast is not None
    rng = random.Random(4)
    alphabet = ["a", "The", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "'s", "'ll", "12", "!?", "é́", "日", "\u200b", "_", "<|endoftext|>", "ÿ", "ǅ", "²", "½", "\u00ad", "ª"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    (ids_a, ids_b), (count_a, count_b) = pair.encode(texts)
    ends_a, ends_b = count_a.cumsum(), count_b.cumsum()
    for text, a, n, b, m in zip(texts, ends_a, count_a, ends_b, count_b, strict=True):
        if text:
            assert ids_a[a - n : a].tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids
            assert ids_b[b - m : b].tolist() == pair.b.encode(text)
        else:
            assert n == m == 0


def test_overlaps_are_the_tokens_that_share_a_byte(pair):
    a, b = alignment.token_frames(pair, [r[1] for r in brute.awkward()[:20] + ODD])
    found = alignment.overlaps(a, b)
    got = list(zip(found["i"], found["j"], strict=True))
    spans = [list(zip(f["start"], f["end"], strict=True)) for f in (a, b)]
    want, j = set(), 0
    for i, (start, end) in enumerate(spans[0]):
        while spans[1][j][1] <= start:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < end:
            want.add((i, k))
            k += 1
    assert len(got) == len(set(got)) and set(got) == want


def test_aligned_documents(spark, pair):
    import public_tokenizers as P

    rows = brute.awkward()[:30] + ODD + [(None, None, None, None, 0)]
    for r in align_documents(brute.table(spark, rows), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect():
        texts = [t for d, t, *_ in rows if d == r.doc_id]
        cut = lambda ids, ends: [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        got = list(zip(cut(r.a_ids, r.a_ends), cut(r.b_ids, r.b_ends), strict=True))
        assert got in [groups_of(pair, t) for t in texts]


# ---- conversations ---------------------------------------------------------


def damaged(rows):
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind != 0:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            for _ in range(2 if kind == 3 else 1):
                yield conv, turn, "user" if kind == 4 else role, text


def cheapest(rows):
    """(cost, audit, turns) by a search over (rows done, roles so far) in the order of
    cost, then audit."""
    start = (0, "", 0, "", ())
    heap, done = [start], set()
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        state = roles[-2:] if len(roles) > 1 else roles
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, turns
        legal = lambda r, roles=roles: re.fullmatch("s?(ua)*u?", roles + r) is not None
        for r, name in (("u", "user"), ("a", "assistant")):
            if legal(r):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r, (*turns, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, turns))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                if role and legal(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*turns, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if legal(r):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r, (*turns, f"{name}:{text}")))
    raise AssertionError


def repaired(rows):
    by_conv = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows):
        by_conv[conv].append((turn, role, text))
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = Counter(f for _, _, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, kept = cheapest(marked)
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, brute.sha("\n".join(kept))


def talks(seed=5):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "no", "", " \t", None, "What? ", "é́ 日本!", "again and again."]
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"turn {turn} of {conv}" + rng.choice([".", "!", "", "?\n"])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 3]), role, text))
    rows += [(None, t, "user", "no id.") for t in range(4)] + [(900, None, "user", "same.")] * 3 + [(901, 0, None, None)]
    rows += [(902, t, ("user", "assistant")[t % 2], "w " * 20_000 + ".") for t in range(3)]
    rows += [(c, 0, "user", "only.") for c in range(1000, 1040)]  # some lose their only row
    rng.shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string"


def test_conversation_repair(spark):
    rows = talks()
    table = spark.createDataFrame(rows, TALK).repartition(4)
    want = brute.ordered(repaired(rows))
    assert brute.ordered(op12_conversation_repair(spark, "", table).collect()) == want
    assert brute.ordered(op12_conversation_repair(spark, "", brute.with_clashes(table)).collect()) == want


def test_conversation_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert brute.ordered(op12_conversation_repair(spark, sf_dir).collect()) == brute.ordered(repaired(rows))


def test_repaired_turns(spark):
    rows = talks(8)
    damage_of = damage(spark.createDataFrame(rows, TALK))
    edits = find_edits(damage_of).cache()
    got = defaultdict(list)
    for r in sorted(repaired_turns(damage_of, edits).collect(), key=lambda r: (repr(r.conv_id), r.place)):
        assert r.place == len(got[r.conv_id])
        got[r.conv_id].append(f"{r.role}:{r.text}")
    assert {k: brute.sha("\n".join(v)) for k, v in got.items()} == {r[0]: r[-1] for r in repaired(rows) if r[-1] != brute.sha("")}


def test_cheapest_edits_of_all_short_conversations():
    kinds = [("system", 0), ("user", 1), ("assistant", 2), ("tool", 3)]
    choices = [(role, code | more, fault) for role, code in kinds for more, fault in ((0, None), (conversations.BAD, "blank"), (conversations.CUT, "truncated"))]
    for n in range(4):
        for rows in itertools.product(choices, repeat=n):
            cost, audit, _ = cheapest([(role, "t", fault) for role, _, fault in rows])
            assert cheapest_edits(bytes(code for _, code, _ in rows)) == (cost, audit), rows
    rng = random.Random(1)
    for n in (10, 30, 50):
        rows = rng.choices(choices, k=n)
        cost, audit, _ = cheapest([(role, "t", fault) for role, _, fault in rows])
        assert cheapest_edits(bytes(code for _, code, _ in rows)) == (cost, audit)


def test_empty_conversations(spark):
    assert op12_conversation_repair(spark, "", spark.createDataFrame([], TALK)).collect() == []


# ---- secrets ---------------------------------------------------------------

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def scanned(text):
    text = text or ""
    base = sorted(
        (m.start(), i, m.end()) for i, (pattern, group, least) in enumerate(BASE.values()) for m in pattern.finditer(text) if len(m.group(group)) >= least
    )
    hot = []
    for m in re.finditer(secrets.CANDIDATE, text):
        if any(re.search(p, m.group()) for p in secrets.ALLOWED):
            continue
        own, last = m.group(), None
        for i in range(len(own) - secrets.WINDOW + 1):
            window = own[i : i + secrets.WINDOW]
            bits = -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())
            upper, lower, digit = (any(c in x for c in window) for x in (secrets.ALPHABET[:26], secrets.ALPHABET[26:52], "0123456789"))
            if set(window) <= set("0123456789abcdef"):
                need = secrets.BITS["hex"] if lower and digit else None
            elif upper and lower:
                need = secrets.BITS["both cases and digits" if digit else "both cases"]
            else:
                need = secrets.BITS["one case and digits"] if digit and (upper or lower) else None
            if need is not None and bits >= need - 1e-9:
                start, end = m.start() + i, m.start() + i + secrets.WINDOW
                if last and last[1] >= start:
                    last[1] = end
                else:
                    last = [start, end]
                    hot.append(last)
    free = [(s, 3, e) for s, e in hot if not any(b < e and s < c for b, _, c in base)]
    names = [*BASE, "entropy"]
    write = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    counts = Counter(k for _, k, _ in base)
    return counts[0], counts[1], counts[2], brute.sha(write(base)), write(base + free)


def leaky():
    rng = random.Random(11)
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    rows = [(r[0], r[1]) for r in brute.awkward()]
    parts = [
        lambda: f"password: {some('abc123', rng.randint(1, 9))}", lambda: f"API_KEY='{some(secrets.ALPHABET, rng.randint(3, 40))}'",
        lambda: "secret: token = abcdef1", lambda: "Token==x=y=z", lambda: f"AKIA{some('ABC019', rng.randint(10, 30))}", lambda: "AKIAAKIA" + some("XYZ", 14),
        lambda: some("0123456789abcdef", rng.randint(10, 60)), lambda: some(secrets.ALPHABET, rng.randint(15, 80)), lambda: some("abcdefgh", 40),
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "src/main/java/Some9Class8With7Digits", lambda: "my_example_" + some(secrets.ALPHABET, 25),
        lambda: "é日😀", lambda: "plain words", lambda: "\n", lambda: "TOKEN\nsecret", lambda: some("abcdef", 50) + some("0123456789", 30),
    ]
    rows += [(5000 + i, " ".join(rng.choice(parts)() for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(6000, "token=abcdefg " * 3000), (6001, some(secrets.ALPHABET, 20_000)), (6002, "token=")]
    return rows


def test_secret_scan(spark):
    rows = leaky()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.ordered((d, *scanned(t)) for d, t in rows)
    assert sum("entropy" in r[-1] for r in want) > 20
    assert brute.ordered(op13_secret_scan(spark, "", docs).collect()) == want
    assert brute.ordered(op13_secret_scan(spark, "", brute.with_clashes(docs)).collect()) == want
    assert op13_secret_scan(spark, "", docs.limit(0)).collect() == []


def test_secret_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op13_secret_scan(spark, sf_dir).collect()
    assert brute.ordered(got) == brute.ordered((r.doc_id, *scanned(r.text)) for r in rows)


def test_spans_keep_columns_and_need_no_python(spark):
    docs = brute.with_clashes(brute.table(spark))
    found = with_spans(docs)
    assert found.columns == [*docs.columns, "base_spans", "entropy_spans"] and found.count() == docs.count()
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    assert len(with_spans(docs, allowed=[".*"]).filter("size(entropy_spans) > 0").take(1)) == 0


def test_places_of_matches(spark):
    texts = ["", "b", "ab", "aab aa", "é日a😀a", "a" * 500 + "b", "a b" * 300]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [[(x.start, x.end, x.value) for x in r.m] for r in frame.select(find_all(F.col("t"), "a+").alias("m")).collect()]
    assert got == [[(m.start(), m.end(), m.group()) for m in re.finditer("a+", t)] for t in texts]
