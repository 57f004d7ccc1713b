"""Removal of long repeated passages by recompression.

Every document is rewritten in rounds. The first names runs of one word, each
further round names pairs of neighbouring symbols, the left from one half and the
right from the other half of the alphabet, as a coin thrown for each symbol and
round decides. A name is a hash of what it stands for, so equal passages get the
same names in all documents without a dictionary: all rounds run where the text is
and only high-level symbols are shuffled.

What a symbol looks like depends on a stretch of words around it, its context. A
symbol whose context lies inside a window appears in every copy of that window. So
each window of ``WIDTH`` words is represented by one such symbol (that with the
smallest hash of its context); windows without one represent themselves. Spark
counts the symbols; only windows whose symbol stands in two documents can be
repeated. These are then verified by a hash of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import documents, rows_with
from colflow.llm.hashing import PLAIN, U, batches_of, mix, word_hashes
from colflow.session import materialize

WIDTH = 50
ROUNDS = 5


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of a polynomial hash; see ``_stretch``."""
    powers = np.full(len(values), base, np.uint64)
    if len(powers):
        powers[0] = 1
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * np.multiply.accumulate(powers), out=out[1:])
    return out


def _stretch(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from ``start`` to ``end``, wherever they stand."""
    down = np.full(len(sums), pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Parsed:
    """Symbols of a batch of documents after all rounds: first word, end and
    context (``low`` to ``high``) of each. Contexts that touch the rim of a document
    reach beyond it and so lie inside no window."""

    def __init__(self, words: np.ndarray, begin: np.ndarray):
        self.words, self.begin = words, begin
        n = len(words)
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        # runs of one word
        new = np.ones(n, bool)
        new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        end = np.append(first[1:], n)
        length = (end - first).astype(np.uint64)
        name = np.where(length > U(1), mix(words[first] + length * U(0x9E3779B97F4A7C15)), words[first])
        low, high, doc = first - 1, end + 1, doc[first]
        # pairs
        for r in range(ROUNDS):
            left = (mix(name ^ U(0xA0761D6478BD642F * (r + 1) & 0xFFFFFFFFFFFFFFFF)) & U(1)).astype(bool)
            together = np.zeros(len(name), bool)
            together[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
            second = np.zeros(len(name), bool)
            second[1:] = together[:-1]
            alone = ~together & ~second
            # a lone symbol also depends on the neighbour that it was not paired with
            after = np.append(np.where(doc[1:] == doc[:-1], high[1:], n + 2), n + 2)[: len(name)]
            before = np.concatenate(([-2], np.where(doc[1:] == doc[:-1], low[:-1], -2)))[: len(name)]
            rim = alone & left & (after == n + 2)
            after[rim] = self.begin[doc[rim] + 1] + 1
            rim = alone & ~left & (before == -2)
            before[rim] = self.begin[doc[rim]] - 1
            low, high = np.where(alone & ~left, before, low), np.where(alone & left, after, high)
            at = np.flatnonzero(together)
            name[at] = mix(mix(name[at]) + name[at + 1] + U(r + 1))
            high[at], end[at] = high[at + 1], end[at + 1]
            stay = ~second
            name, first, end, low, high, doc = (x[stay] for x in (name, first, end, low, high, doc))
        self.name, self.first, self.end, self.low, self.high, self.doc = name, first, end, low, high, doc

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: its document, first word, symbol (by the hash of the
        symbol's context) and the hash of its words."""
        sizes = np.maximum(np.diff(self.begin) - WIDTH + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        start = self.begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sums = _sums(self.words, BASES[0])
        whole = _stretch(sums, BASES[0], start, start + WIDTH)
        fits = (self.high - self.low <= WIDTH) & (self.low >= self.begin[self.doc]) & (self.high <= self.begin[self.doc + 1])
        low, high = self.low[fits], self.high[fits]
        key = _stretch(sums, BASES[0], low, high)
        # symbols inside a window are neighbours: low and high both go up
        a = np.searchsorted(low, start, side="left")
        b = np.searchsorted(high, start + WIDTH, side="right")
        out, inside = mix(whole ^ U(1)), a < b
        if inside.any():
            span = (b - a)[inside]
            level = np.log2(span).astype(np.int64)
            a, b = a[inside], b[inside]
            table, best = key, np.zeros(len(a), np.uint64)
            for k in range(int(level.max()) + 1):
                own = level == k
                best[own] = np.minimum(table[a[own]], table[b[own] - (1 << k)])
                step = 1 << k
                table = np.minimum(table, np.append(table[step:], np.full(min(step, len(table)), table[-1:]))[: len(table)])
            out[inside] = best
        return doc, start, out, whole


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in batches_of(batch.column("text").to_pylist()):
            words, begin = word_hashes(raws, PLAIN)
            parsed = Parsed(words, begin)
            doc, _, key, _ = parsed.windows()
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))[: len(doc)]
            doc, key = doc[new], key[new]
            split = [raw.translate(PLAIN).split() for raw in raws]
            sums = [_sums(words, base) for base in BASES]
            seq = [_stretch(s, base, begin[:-1], begin[1:]).view(np.int64) for s, base in zip(sums, BASES, strict=True)]
            part = batch.slice(first, len(raws))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "text_key": part.column("text_key"),
                    "n_words": np.diff(begin),
                    "seq_a": seq[0],
                    "seq_b": seq[1],
                    "whole_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in split],
                    "symbols": pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(doc, np.arange(len(raws) + 1)), pa.int32()), pa.array(key.view(np.int64))
                    ),
                }
            )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose symbol is among the document's shared ``symbols``."""
    for batch in batches:
        shared = batch.column("symbols")
        for first, raws in batches_of(batch.column("text").to_pylist()):
            words, begin = word_hashes(raws, PLAIN)
            doc, start, key, whole = Parsed(words, begin).windows()
            lists = shared.slice(first, len(raws))
            keys = lists.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(len(raws)), lists.value_lengths().to_numpy())
            # a symbol counts only in the document that it was sent with
            tag = mix(keys + owner.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            own = mix(key + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            hit = np.isin(own, tag)
            doc, start, key, whole = doc[hit], start[hit], key[hit], whole[hit]
            part = batch.slice(first, len(raws))
            ids, text = part.column("doc_id").to_numpy(), part.column("text_key").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "symbol": key.view(np.int64),
                    "whole": whole.view(np.int64),
                    "doc_id": ids[doc],
                    "text_key": text[doc],
                    "start": (start - begin[doc]).astype(np.int64),
                }
            )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, sizes = [], [], []
        for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
            words = (text.as_py() or "").encode().translate(PLAIN).split()
            at = np.asarray(starts.values.to_numpy(), np.int64)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + WIDTH, -1)
            covered = np.cumsum(change)[:-1] > 0
            sizes.append(len(words))
            removed.append(int(covered.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered)]).decode())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.string()),
            }
        )


def _text_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


class Repeats:
    """Repeated windows of ``docs``.

    Null and empty texts have no windows. A window is repeated if its words also
    start in a document with a smaller id; so rows of one id do not repeat each
    other, and rows without id neither repeat nor are repeated. ``rows`` has one row
    for each document row, ``copies`` names (by id and text) the rows whose whole
    text, of a window or more, is that of a smaller id: all their words are
    repeated, and no window of theirs is first anywhere, so only the smallest of
    equal texts goes on. ``starts`` has the repeated windows of the others.
    """

    def __init__(self, docs: DataFrame):
        self.texts = _text_rows(docs)
        kind = "doc_id long, text_key long, n_words long, seq_a long, seq_b long, whole_sha256 string, symbols array<long>"
        self.rows = materialize(self.texts.mapInArrow(_symbols, kind), "symbols")
        long = self.rows.filter(f"doc_id is not null and n_words >= {WIDTH}")
        pair = ["doc_id", "text_key"]
        firsts = long.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        firsts = materialize(firsts.filter("first < last").drop("last"), "equal-texts")
        copies = long.select(*pair, "seq_a", "seq_b").join(firsts, ["seq_a", "seq_b"]).filter("first < doc_id")
        self.copies = materialize(copies.select(*pair).distinct(), "copies")

        single = long.join(self.copies, pair, "left_anti").select(*pair, F.explode("symbols").alias("symbol"))
        shared = single.groupBy("symbol").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        shared = materialize(shared.filter("a < b").select("symbol"), "shared-symbols")
        wanted = single.join(shared, "symbol", "left_semi").groupBy(*pair).agg(F.collect_set("symbol").alias("symbols"))
        wanted = materialize(wanted, "candidates")
        near = rows_with(self.texts, wanted.select(*pair), pair).join(wanted, pair)
        kind = "symbol long, whole long, doc_id long, text_key long, start long"
        windows = materialize(near.mapInArrow(_candidates, kind), "windows")
        first = windows.groupBy("symbol", "whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        first = materialize(first.filter("first < last").drop("last"), "first-windows")
        again = windows.join(first, ["symbol", "whole"]).filter("first < doc_id")
        self.starts = materialize(again.groupBy(*pair).agg(F.collect_set("start").alias("starts")), "repeats")

    def kept_texts(self) -> DataFrame:
        """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words that stay,
        joined by one space, of the documents with repeated windows other than
        copies."""
        pair = ["doc_id", "text_key"]
        near = rows_with(self.texts, self.starts.select(*pair), pair).join(self.starts, pair)
        return near.mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    repeats = Repeats(documents(spark, sf_dir) if docs is None else docs)
    pair = ["doc_id", "text_key"]
    # every row is in one of three: copies, with repeated windows, without
    touched = repeats.copies.withColumn("copy", F.lit(True)).unionByName(repeats.starts.select(*pair, F.lit(False).alias("copy")))
    touched = touched.withColumnsRenamed({"doc_id": "t_id", "text_key": "t_key"})
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key"))
    plain = repeats.rows.drop("symbols", "seq_a", "seq_b").join(touched, same, "left").filter("copy is null or copy")
    gone = F.coalesce("copy", F.lit(False))
    return plain.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
    ).unionByName(
        repeats.kept_texts().select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    )
