"""Small tables with awkward rows, and plain-Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def awkward(seed: int = 7) -> list[tuple]:
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows
    and ids, lines and passages that many texts share."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("aeiorstén", k=rng.randint(1, 7))) for _ in range(300)]

    def prose(n: int) -> list[str]:
        return [rng.choice(vocab).capitalize() if rng.random() < 0.1 else rng.choice(vocab) for _ in range(n)]

    rows = []
    passage = prose(70)
    for i in range(60):
        own = prose(rng.randint(3, 160))
        text = " ".join(own)
        if i % 4 == 0:
            text += "\n" + " ".join(passage) + "\nAll rights  Reserved.\n"
        if i % 3 == 0:
            text = "Share this page \n" + text + "\n\tSHARE THIS PAGE\n\n"
        rows.append((i * 3, text))
    base = prose(200)
    for i in range(12):  # near copies
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = "x" + str(i)
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000 + i, rows[0][1]) for i in range(5)]  # copies
    rows += [(3000, None), (3001, ""), (3002, " \t\n "), (3003, "one"), (3004, "one"), (3005, "ONE two")]
    rows += [(3006, "a b  c\x0bd\x0ce\rf"), (3007, "<|endoftext|> x<|startoftext|>y"), (3008, "É́ ΑΣ İstanbul 日本 😀")]
    rows += [(3009, " ".join(base * 30)), (3010, "w " * 3000), (3011, "\n" * 500 + "Share this page")]
    rows += [(0, rows[0][1]), (3, "another text of a used id"), (None, "a text without id " * 20), (None, None)]
    rows.append((9_000_000_000_000, "far id"))
    return [(d, t, rng.choice(["en", "fr", None]), "s", len(t or "")) for d, t in rows]


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def with_clashes(df):
    """The same rows with further columns under names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["keys", "pos", "batch", "part", "seq", "row", "shard", "slot", "n_words", "kept", "line_key", "sig", "hub", "size", "word", "ids", "score", "key"]
    names += ["_id", "_text_key", "_stratum", "_lines", "_gone", "_ends", "text_key", "stratum", "gone", "gone_id", "lines", "ends", "n_lines", "a.b"]
    return df.withColumns({n: F.lit("x") for n in names})


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


def line_dedup(rows, min_docs=10):
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    split = [(r[0], (r[1] or "").split("\n")) for r in rows]
    count = Counter(k for _, lines in split for k in {strip(x) for x in lines} if k)
    out = []
    for d, lines in split:
        kept = [x for x in lines if count[strip(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
