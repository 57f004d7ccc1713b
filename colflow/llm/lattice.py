"""Language-model scores: the likelihood of a text over a lattice of subwords.

The model is a unigram over the pieces of an existing vocabulary. A word's
probability is the sum over all its segmentations into pieces, found by forward
recursion in log space; a text is its words and one end piece. The vocabulary's own
scores (ranks) are the prior; one round of expectation maximization over the word
counts of the training documents weights all segmentations and gives the pieces
their probabilities.

Spark counts the words of all documents. What depends on a word alone, its count
and likelihood, is computed once per distinct word. Documents then meet frequent
words, at most ``HEAD`` of them, in a broadcast table, and all others by a join.

Words are keyed by a 64-bit hash. Only the vocabulary, of fixed size, and the
``HEAD`` words pass through the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import documents
from colflow.llm.hashing import FOLDED, batches_of, mix, word_hashes
from colflow.session import materialize

#: words that are broadcast, 24 bytes each; the others are joined
HEAD = 1 << 18
#: distinct words a task counts before it hands them on
COUNTED = 300_000
#: weight of the vocabulary's own scores, in pieces
PRIOR = 1000.0

U = np.uint64
NONE = -math.inf


class Pieces:
    """The vocabulary: pieces by the hash of their characters, prior weights, the
    ids of the byte pieces and of the end."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        ranks, texts, ids = np.full(size, float(size)), [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ranks[i] = -model.get_score(i)
                texts.append(piece)
                ids.append(i)
        self.end = model.eos_id()
        weights = 1.0 / (ranks + 10.0)
        self.prior = weights / weights.sum()
        self.longest = max(map(len, texts))
        hashes = np.array([self._hash(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids)[order]

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h + ord(c) + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h], np.uint64))[0])

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words of equal length, one per row of ``codes``: by piece length, the
        piece at each place, or -1."""
        out, h = [], np.zeros(codes.shape, np.uint64)
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            h = (h[:, : codes.shape[1] - n + 1] + codes[:, n - 1 :] + U(1)) * U(0x9E3779B97F4A7C15)
            found = mix(h)
            slot = np.searchsorted(self.hashes, found)
            slot[slot == len(self.hashes)] = 0
            out.append(np.where(self.hashes[slot] == found, self.ids[slot], -1))
        return out


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Words of equal length with the log probability of every piece at every
    place; a character without a piece is spelled in bytes."""

    def __init__(self, pieces: Pieces, logp: np.ndarray, words: list[str]):
        marked = "".join("▁" + w for w in words)
        codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)
        self.pieces, self.n = pieces, codes.shape[1]
        self.ids = pieces.edges(codes)
        table = np.append(logp, NONE)
        self.logs = [table[i] for i in self.ids]
        self.rows, self.cols = np.nonzero(self.ids[0] < 0)
        self.spelled = [np.array(bytearray(chr(c).encode())) for c in codes[self.rows, self.cols].tolist()] if len(self.rows) else []
        if len(self.rows):
            self.logs[0][self.rows, self.cols] = [logp[pieces.bytes[b]].sum() for b in self.spelled]

    def forward(self) -> np.ndarray:
        """Log probability of each prefix, by its length; the last is the word's."""
        a = np.full((self.logs[0].shape[0], self.n + 1), NONE)
        a[:, 0] = 0.0
        for end in range(1, self.n + 1):
            lengths = range(1, min(end, len(self.logs)) + 1)
            a[:, end] = _log_sum([a[:, end - k] + self.logs[k - 1][:, end - k] for k in lengths])
        return a

    def backward(self) -> np.ndarray:
        b = np.full((self.logs[0].shape[0], self.n + 1), NONE)
        b[:, self.n] = 0.0
        for start in range(self.n - 1, -1, -1):
            lengths = range(1, min(self.n - start, len(self.logs)) + 1)
            b[:, start] = _log_sum([b[:, start + k] + self.logs[k - 1][:, start] for k in lengths])
        return b

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over words with these counts."""
        a, b = self.forward(), self.backward()
        weight = np.log(counts)[:, None] - a[:, -1:]
        out = np.zeros(len(self.pieces.prior))
        for k, (ids, logs) in enumerate(zip(self.ids, self.logs, strict=True), 1):
            used = np.exp(a[:, : self.n + 1 - k] + logs + b[:, k:] + weight)
            known = ids >= 0
            out += np.bincount(ids[known], weights=used[known], minlength=len(out))
            if k == 1:
                for spelled, amount in zip(self.spelled, used[self.rows, self.cols].tolist(), strict=True):
                    np.add.at(out, self.pieces.bytes[spelled], amount)
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stacked - safe).sum(axis=0))


def _by_length(words: list[str], cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Indices of words of equal length, in groups of bounded size."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, cells // (16 * (int(lengths[group[0]]) + 1))) if len(group) else 1
        for at in range(0, len(group), step):
            yield group[at : at + step]


# ---------------------------------------------------------------- Spark


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """``key``, ``word`` and ``c``, its count in training documents, for each word
    of all documents; ``docs`` has ``text`` and ``held_out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            keys = word_hashes(words, FOLDED)[0].view(np.int64)
            return pa.RecordBatch.from_pydict(
                {"key": keys, "word": pa.array([w.decode() for w in words]), "c": pa.array(list(counts.values()), pa.int64())}
            )

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().translate(FOLDED).split()
                if held:
                    counts.update(dict.fromkeys(words, 0))
                else:
                    counts.update(words)
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    parts = docs.select("text", "held_out").mapInArrow(run, "key long, word string, c long")
    return parts.groupBy("key").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def learn_pieces(vocabulary: DataFrame, path: str, texts: int) -> np.ndarray:
    """Log probabilities of the pieces from the counted words and the number of
    training texts; one row per piece comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        logp, total = np.log(pieces.prior), np.zeros(len(pieces.prior))
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            for group in _by_length(words):
                total += Lattice(pieces, logp, [words[i] for i in group]).expected(counts[group])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": used, "n": total[used]})

    found = vocabulary.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n double")
    pieces = _pieces(path)
    expected = PRIOR * pieces.prior
    for row in found.groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
        expected[row.piece] += row.n
    expected[pieces.end] += texts
    return np.log(expected / expected.sum())


def word_scores(vocabulary: DataFrame, path: str, logp: np.ndarray) -> DataFrame:
    """``key``, ``c`` and ``logw``, the log10 probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            words = batch.column("word").to_pylist()
            out = np.zeros(len(words))
            for group in _by_length(words):
                out[group] = Lattice(pieces, logp, [words[i] for i in group]).forward()[:, -1]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "c": batch.column("c"), "logw": out / math.log(10)})

    return vocabulary.mapInArrow(run, "key long, c long, logw double")


def _head(scored: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (sorted), counts and scores of the most frequent words: all whose count
    lies in the highest classes that together have at most ``HEAD`` words."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 4)
    sizes = sorted(((r.level, r.n) for r in scored.filter("c > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, total = None, 0
    for at, n in sizes:
        total += n
        if total > HEAD:
            break
        lowest = at
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    table = scored.filter("c > 0").filter(level >= lowest).toPandas().sort_values("key")
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["c"].to_numpy()[order].astype(float), table["logw"].to_numpy()[order]


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``.

    A null or empty text is its end alone. Rows are documents of their own even if
    they repeat; a null id is in training. Without training documents no token is
    known and the pieces keep their prior.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", is_held_out())
    counted = materialize(count_words(slim), "word-counts")
    texts = slim.filter(~F.col("held_out")).count()
    sums = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, distinct = (sums.n or 0) + texts, sums.v + (texts > 0)
    logp = learn_pieces(counted, path, texts)
    scored = materialize(word_scores(counted, path, logp), "word-scores")
    below = math.log10(tokens + 0.5 * (distinct + 1))
    head = spark.sparkContext.broadcast(_head(scored))
    end = (float(math.log10(texts + 0.5) - below), float(logp[_pieces(path).end] / math.log(10)), int(texts > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, logs = head.value
        base = np.append(np.log10(counts + 0.5) - below, 0.0)
        logs = np.append(logs, 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, raws in batches_of(texts):
                words, begin = word_hashes(raws, FOLDED)
                doc = np.repeat(np.arange(len(raws)), np.diff(begin))
                slot = np.searchsorted(keys, words)
                slot[slot == len(keys)] = 0
                known = keys[slot] == words if len(keys) else np.zeros(len(words), bool)
                slot[~known] = len(keys)
                total = lambda x, doc=doc, n=len(raws): np.bincount(doc, weights=x, minlength=n)
                rest_doc, rest = doc[~known], words[~known]
                order = np.lexsort((rest, rest_doc))
                rest_doc, rest = rest_doc[order], rest[order]
                new = np.concatenate(([True], (rest_doc[1:] != rest_doc[:-1]) | (rest[1:] != rest[:-1])))[: len(rest)]
                places = np.flatnonzero(new)
                ends = np.searchsorted(rest_doc[places], np.arange(len(raws) + 1))
                offsets = pa.array(ends, pa.int32())
                part = batch.slice(first, len(raws))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(row + np.arange(len(raws)), pa.int64()),
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "n_tokens": np.diff(begin) + 1,
                        "n_known": total(known).astype(np.int64) + end[2],
                        "base": total(base[slot]) + end[0],
                        "score": total(logs[slot]) + end[1],
                        "keys": pa.ListArray.from_arrays(offsets, pa.array(rest[places].view(np.int64))),
                        "uses": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(places, len(rest))), pa.int32())),
                    }
                )
                row += len(raws)

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, keys array<long>, uses array<int>"
    # stored, so that the row numbers stay as they are if tasks run again
    partial = materialize(slim.mapInArrow(run, kind), "head-scores")
    rest = partial.select("row", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("uses").alias("n"))))
    rare = rest.join(scored, "key").select(
        "row",
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("known"),
        (F.col("n") * (F.log10(F.col("c") + 0.5) - below)).alias("base"),
        (F.col("n") * F.col("logw")).alias("logw"),
    )
    sums = rare.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("more_base"), F.sum("logw").alias("more"))
    zero = F.lit(0.0)
    return partial.drop("keys", "uses").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return score_documents(documents(spark, sf_dir) if docs is None else docs, path)
