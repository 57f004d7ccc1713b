"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of a text are ranges of its bytes. For a batch of documents the tokens of
both sides are two pandas frames; ``merge_asof``, keyed by document, finds for each
token's start the token of the other side that covers it. The union of both
directions is the list of overlaps, and an overlap whose two ends are equal closes a
group: between two such ends the tokens of both sides stand for the same bytes.

All A-B pairs of a group are linked. How many documents link a pair of ids is counted
over the corpus without a row for each link: texts are aligned in chunks of bounded
size, a chunk's distinct pairs are dealt to parts by hash, each part sums them over
all chunks, and the sums go back to their chunks. The aligned tokens lie in a table
bucketed by chunk in between, so neither texts nor tokens are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import documents
from colflow.session import bucketed, materialize

#: bytes of text aligned at a time; a longer text is aligned by itself
BATCH = 1 << 20
#: bytes of text of a chunk, at which it is closed
CHUNK = 16 << 20
#: bytes of text for each part of the pairs
PART = 64 << 20
#: links expanded at a time
LINKS = 1 << 21
#: a group of more links than this is expanded by its distinct ids
BIG = 1 << 16

SIMPLE = re.compile("[\t-\r -~\u00a1-\u024f]*")


class Pair:
    """The two tokenizers: ids and bytes of a text's tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # fixed rule: printable Latin-1 bytes stand for themselves, the rest move up in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in plain} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in plain)}
        self.bytes_a = [bytes(byte[c] for c in self.a.id_to_token(i)) if all(c in byte for c in self.a.id_to_token(i)) else b"" for i in range(self.a.get_vocab_size())]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces]
        self.length_a, self.length_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.shift = (len(self.bytes_b) - 1).bit_length()
        self.bits = self.shift + (len(self.bytes_a) - 1).bit_length()
        self.kind = np.uint32 if self.bits <= 32 else np.uint64
        self.id_kind = np.uint16 if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else np.uint32

    @cached_property
    def written(self) -> list[str]:
        """Ids as they are written inside and at the end of a group's A and B part."""
        a, b = range(len(self.bytes_a)), range(len(self.bytes_b))
        return [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b]

    @cached_property
    def fast(self):
        """The same tokens of A by its ranks, several times as fast; None if the file's
        ids do not follow its merges."""
        import tiktoken

        spec = json.loads(self.a.to_str())["model"]
        merged = (m if isinstance(m, list) else m.split(" ") for m in spec["merges"])
        first = len(spec["vocab"]) - len(spec["merges"])
        if any(spec["vocab"][x + y] != first + n for n, (x, y) in enumerate(merged)):
            return None
        ranks = {self.bytes_a[i]: i for i in spec["vocab"].values()}
        # fixed value: the splitter's pattern
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(texts)
        # letters that all versions of the character tables class alike
        if self.fast is not None:
            for i, text in enumerate(texts):
                if len(text) < BATCH and SIMPLE.fullmatch(text):
                    out[i] = self.fast.encode_ordinary(" " + text)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.a.encode_batch([" " + texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts of both sides in sequence, and how many each text has: none
        for a null or empty one and one that a side does not give back byte by byte."""
        full = [t or "" for t in texts]
        side_a, side_b = self._ids_a(full), self.b.encode(full, num_threads=1)
        table_a, table_b = self.bytes_a, self.bytes_b
        for i, text in enumerate(full):
            raw = b" " + text.encode()
            if not text or not b"".join([table_a[x] for x in side_a[i]]) == raw == b"".join([table_b[x] for x in side_b[i]]):
                side_a[i], side_b[i] = [], []
        count = [np.array([len(x) for x in side], np.int64) for side in (side_a, side_b)]
        ids = [np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in zip((side_a, side_b), count, strict=True)]
        return ids, count


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def token_frame(ids: np.ndarray, count: np.ndarray, length: np.ndarray) -> pd.DataFrame:
    """``doc``, ``id``, ``start`` and ``end`` of the tokens of a batch; the texts lie
    one behind the other, so starts ascend over the whole batch."""
    end = np.cumsum(length[ids])
    columns = {"doc": np.repeat(np.arange(len(count)), count), "id": ids, "start": end - length[ids], "end": end}
    return pd.DataFrame(columns, copy=False)


def token_frames(tokens: Pair, texts: list[str | None]) -> tuple[pd.DataFrame, pd.DataFrame]:
    (ids_a, ids_b), (count_a, count_b) = tokens.encode(texts)
    return token_frame(ids_a, count_a, tokens.length_a), token_frame(ids_b, count_b, tokens.length_b)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``i`` and ``j``, rows of ``a`` and ``b`` that share a byte, with their ends."""
    covering = []
    for own, other in ((a, b), (b, a)):
        places = pd.DataFrame({"doc": other["doc"], "start": other["start"], "n": np.arange(len(other))}, copy=False)
        # a text has tokens on both sides or on none, so each start is covered
        covering.append(pd.merge_asof(own[["doc", "start"]], places, on="start", by="doc")["n"].to_numpy(np.int64))
    j_of_a, i_of_b = covering
    # a pair with equal starts is found from both sides
    only = np.flatnonzero(b["start"].to_numpy() != a["start"].to_numpy()[i_of_b])
    i = np.concatenate((np.arange(len(a)), i_of_b[only]))
    j = np.concatenate((j_of_a, only))
    ends = {"end_i": a["end"].to_numpy()[i], "end_j": b["end"].to_numpy()[j]}
    return pd.DataFrame({"i": i, "j": j, **ends, "doc": a["doc"].to_numpy()[i]}, copy=False)


def group_ends(found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The last tokens of each group on both sides, in order: overlaps of equal ends."""
    last = np.flatnonzero(found["end_i"].to_numpy() == found["end_j"].to_numpy())
    return np.sort(found["i"].to_numpy()[last]), np.sort(found["j"].to_numpy()[last])


class Links:
    """The links of a batch: ids of both sides, their groups, and each group's document.

    ``ends_a`` and ``ends_b`` are the last tokens of the groups, ``doc`` the document
    of each group."""

    def __init__(self, tokens: Pair, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, doc: np.ndarray):
        self.tokens, self.doc = tokens, doc
        self.n_a, self.n_b = (np.diff(e, prepend=-1) for e in (ends_a, ends_b))
        self.size = self.n_a * self.n_b
        big = self.size > BIG
        self.a = self._side(ids_a, self.n_a, big)
        self.b = self._side(ids_b, self.n_b, big)

    @staticmethod
    def _side(ids, count, big) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, groups and how often the id stands there; once for each token but in
        the ``big`` groups."""
        group = np.repeat(np.arange(len(count)), count)
        weight = np.ones(len(ids), np.int64)
        if big.any():
            many = big[group]
            code, times = np.unique((group[many].astype(np.uint64) << np.uint64(32)) | ids[many].astype(np.uint64), return_counts=True)
            ids = np.concatenate((ids[~many], (code & np.uint64(0xFFFFFFFF)).astype(ids.dtype)))
            group = np.concatenate((group[~many], (code >> np.uint64(32)).astype(group.dtype)))
            weight = np.concatenate((weight[~many], times))
            order = np.argsort(group, kind="stable")
            ids, group, weight = ids[order], group[order], weight[order]
        return ids, group, weight

    def expand(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document, key (both ids) and number of the links, ``LINKS`` or one token's
        at a time, in the order of the documents."""
        ids, group, weight = self.a
        ids_b, group_b, weight_b = self.b
        first = np.searchsorted(group_b, np.arange(len(self.doc) + 1))
        partners = np.diff(first)[group]
        before = np.concatenate(([0], np.cumsum(partners)))
        at, kind, shift = 0, self.tokens.kind, self.tokens.shift
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(before, before[at] + LINKS, side="right")) - 1)
            count = partners[at:stop]
            own = np.repeat(np.arange(at, stop), count)
            other = first[group[own]] + np.arange(len(own)) - np.repeat(before[at:stop] - before[at], count)
            key = (ids[own].astype(kind) << kind(shift)) | ids_b[other].astype(kind)
            yield self.doc[group[own]], key, weight[own] * weight_b[other]
            at = stop

    def of_documents(self) -> np.ndarray:
        """The key of each link that a document has, once for each document."""
        found, held = [], np.zeros(0, np.uint64)
        for doc, key, _ in self.expand():
            code = (doc.astype(np.uint64) << np.uint64(self.tokens.bits)) | key.astype(np.uint64)
            held = np.unique(np.concatenate((held, code)))
            # documents before the last of this stretch are complete
            done = np.searchsorted(held, np.uint64(int(doc[-1]) << self.tokens.bits))
            found.append(held[:done])
            held = held[done:]
        found.append(held)
        mask = np.uint64((1 << self.tokens.bits) - 1)
        return (np.concatenate(found) & mask).astype(self.tokens.kind)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None], int]]:
    """First row, texts and bytes of stretches of about ``BATCH`` bytes."""
    texts, group, size, first = batch.column("text").to_pylist(), [], 0, 0
    for i, text in enumerate(texts):
        own = len(text.encode()) if text else 0
        if group and size + own > BATCH:
            yield first, group, size
            group, size, first = [], 0, i
        group.append(text)
        size += own
    if group:
        yield first, group, size


def _aligned(tokens: Pair, texts: list[str | None]) -> tuple[dict[str, list], Links]:
    """Columns for each text, and the links of all."""
    a, b = token_frames(tokens, texts)
    found = overlaps(a, b)
    ends_a, ends_b = group_ends(found)
    ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
    doc = a["doc"].to_numpy()[ends_a]
    links = Links(tokens, ids_a, ids_b, ends_a, ends_b, doc)

    # the groups as they are written: of each the A tokens, then the B tokens
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[ends_a], last_b[ends_b] = True, True
    vocabulary_a, vocabulary_b = len(tokens.bytes_a), len(tokens.bytes_b)
    code = np.concatenate((ids_a + vocabulary_a * last_a, ids_b + 2 * vocabulary_a + vocabulary_b * last_b))
    place = np.concatenate((2 * np.repeat(np.arange(len(ends_a)), links.n_a), 2 * np.repeat(np.arange(len(ends_b)), links.n_b) + 1))
    code = code[np.argsort(place, kind="stable")].tolist()
    n = len(texts)
    per_doc = {
        "n_a": np.bincount(a["doc"], minlength=n),
        "n_b": np.bincount(b["doc"], minlength=n),
        "n_groups": np.bincount(doc, minlength=n),
        "n_links": np.bincount(doc, weights=links.size, minlength=n).astype(np.int64),
        "n_overlaps": np.bincount(found["doc"], minlength=n),
    }
    columns = {name: values.tolist() for name, values in per_doc.items()}
    both, at = (per_doc["n_a"] + per_doc["n_b"]).tolist(), 0
    columns["groups"] = []
    for count in both:
        columns["groups"].append("".join(map(tokens.written.__getitem__, code[at : at + count]))[:-1])
        at += count
    for name, ids, last, count in (("a", ids_a, last_a, columns["n_a"]), ("b", ids_b, last_b, columns["n_b"])):
        stops = np.cumsum(count)[:-1]
        columns[name] = [x.astype(tokens.id_kind).tobytes() for x in np.split(ids, stops)]
        columns[f"last_{name}"] = [np.packbits(x).tobytes() for x in np.split(last, stops)]
    return columns, links


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
TOKENS = ["a", "b", "last_a", "last_b"]
ROWS = (
    "chunk long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, "
    + ", ".join(f"{c} binary" for c in TOKENS) + ", part long, keys binary, counts binary"
)


def _align_rows(paths: tuple[str, str], parts: int):
    """A row for each document with its tokens, and for each chunk and part the
    distinct pairs with their numbers of documents."""
    schema = [f.split(" ")[0] for f in ROWS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in ROWS.split(", ")])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({c: columns.get(c, [None] * n) for c in schema}, schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair(*paths)
        chunk, held = TaskContext.get().partitionId() << 24, 0
        keys, counts = np.zeros(0, tokens.kind), np.zeros(0, np.int64)

        def closed() -> Iterator[pa.RecordBatch]:
            part = _part_of(keys, parts)
            order = np.argsort(part, kind="stable")
            own, first = np.unique(part[order], return_index=True)
            for p, k, c in zip(own.tolist(), np.split(keys[order], first[1:]), np.split(counts[order], first[1:]), strict=False):
                yield rows(chunk=[chunk], part=[p], keys=[k.tobytes()], counts=[c.astype(np.uint32).tobytes()])

        for batch in batches:
            for first, texts, size in _batches(batch):
                columns, links = _aligned(tokens, texts)
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in columns.pop("groups")]
                ids = batch.column("doc_id").slice(first, len(texts))
                yield rows(chunk=[chunk] * len(texts), doc_id=ids, groups_sha256=digest, **columns)
                both = np.concatenate((keys, links.of_documents()))
                weight = np.concatenate((counts, np.ones(len(both) - len(keys), np.int64)))
                keys, inverse = np.unique(both, return_inverse=True)
                counts = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64)
                held += size
                if held > CHUNK:
                    yield from closed()
                    chunk, held = chunk + 1, 0
                    keys, counts = keys[:0], counts[:0]
        yield from closed()

    return run


SUMS = "chunk long, part long, keys binary, sums binary, a binary, most binary"


def _sum_part(kind, shift: int):
    """Over all chunks the numbers of documents of one part's pairs, given back to
    each chunk, and the highest of each A id."""

    def run(table: pa.Table) -> pa.Table:
        per_chunk = [np.frombuffer(x.as_py(), kind) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
        keys, inverse = np.unique(np.concatenate(per_chunk), return_inverse=True)
        sums = np.bincount(inverse, weights=counts).astype(np.int64)
        a, first = np.unique(keys >> kind(shift), return_index=True)
        most = np.maximum.reduceat(sums, first)
        given = np.split(sums[inverse], np.cumsum([len(k) for k in per_chunk])[:-1])
        none, n = [None], len(per_chunk)
        return pa.table(
            {
                "chunk": pa.array(table.column("chunk").to_pylist() + none, pa.int64()),
                "part": pa.array(table.column("part").to_pylist() + none, pa.int64()),
                "keys": pa.array(table.column("keys").to_pylist() + none, pa.binary()),
                "sums": pa.array([s.tobytes() for s in given] + none, pa.binary()),
                "a": pa.array([None] * n + [a.astype(np.int64).tobytes()], pa.binary()),
                "most": pa.array([None] * n + [most.tobytes()], pa.binary()),
            }
        )

    return run


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, most in zip(batch.column("a"), batch.column("most"), strict=True):
            yield pa.RecordBatch.from_pydict({"a": np.frombuffer(a.as_py(), np.int64), "most": np.frombuffer(most.as_py(), np.int64)})


RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long"


def _score_chunk(paths: tuple[str, str], best: np.ndarray):
    """The documents of a chunk with what the sums of their links say."""

    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        tokens = pair(*paths)
        kept = {c: docs.column(c) for c in ["doc_id", *COUNTS, "groups_sha256"]}
        n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        if sums.num_rows:
            keys = np.concatenate([np.frombuffer(x.as_py(), tokens.kind) for x in sums.column("keys")])
            total = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in sums.column("sums")])
            order = np.argsort(keys)
            keys, total = keys[order], total[order]
            top = total == best[(keys >> tokens.kind(tokens.shift)).astype(np.int64)]
            rows, at = docs.select([*TOKENS, "n_a", "n_b"]), 0
            length = np.cumsum(docs.column("n_a").to_numpy() + docs.column("n_b").to_numpy())
            while at < docs.num_rows:
                # as many tokens at a time as a batch of texts may have
                stop = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + BATCH, side="right")))
                some = rows.slice(at, stop - at).to_pydict()
                ids = [np.frombuffer(b"".join(some[c]), tokens.id_kind) for c in ("a", "b")]
                last = [
                    np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(some[f"last_{c}"], some[f"n_{c}"], strict=True)])
                    for c in ("a", "b")
                ]
                ends = [np.flatnonzero(x) for x in last]
                doc = np.repeat(np.arange(at, stop), some["n_a"])[ends[0]]
                for own, key, weight in Links(tokens, *ids, *ends, doc).expand():
                    place = np.searchsorted(keys, key)
                    # links come in the order of their documents
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    count_sum[own[first]] += np.add.reduceat(weight * total[place], first)
                    n_best[own[first]] += np.add.reduceat(weight * top[place], first)
                at = stop
        return pa.table(kept | {"n_best": n_best, "count_sum": count_sum})

    return run


def _lists(values: np.ndarray, before: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(values, pa.int32()))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document row: ``doc_id``, ``a_ids`` and ``b_ids`` (the tokens of
    both sides), ``a_ends`` and ``b_ends`` (how many tokens of each side stand before
    each group's end). A text that is null, empty or not given back byte by byte by
    both sides has empty arrays. Repeated rows stay, null ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair(path_a, path_b)
        for batch in batches:
            for first, texts, _ in _batches(batch):
                a, b = token_frames(tokens, texts)
                ends = group_ends(overlaps(a, b))
                group = a["doc"].to_numpy()[ends[0]]
                rows = np.arange(len(texts) + 1)
                columns = {"doc_id": batch.column("doc_id").slice(first, len(texts))}
                for name, side, end in zip("ab", (a, b), ends, strict=True):
                    before = np.searchsorted(side["doc"], rows)
                    columns[f"{name}_ids"] = _lists(side["id"].to_numpy(), before)
                    columns[f"{name}_ends"] = _lists(end + 1 - before[group], np.searchsorted(group, rows))
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in ("doc_id", "a_ids", "b_ids", "a_ends", "b_ends")})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document row: ``doc_id``, numbers of tokens, groups, links and
    overlaps, ``groups_sha256``, ``n_best`` (links whose pair is the most frequent one
    of its A id, ties included) and ``count_sum`` (documents that have the pair, over
    all links). A text without tokens has zeros and an empty digest; repeated rows
    are documents of their own and count as such; an empty table stays empty."""
    tokens, paths = pair(path_a, path_b), (path_a, path_b)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // PART))
    rows = bucketed(slim.mapInArrow(_align_rows(paths, parts), ROWS), "aligned", ["chunk"], sort=False, dealt=True)
    pairs = rows.filter("keys is not null").select("chunk", "part", "keys", "counts")
    sums = materialize(pairs.groupBy("part").applyInArrow(_sum_part(tokens.kind, tokens.shift), SUMS), "pair-sums")
    # one row for each id of A's vocabulary at most
    most = sums.filter("chunk is null").select("a", "most").mapInArrow(_highest, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))
    best = np.zeros(len(tokens.bytes_a), np.int64)
    for row in most.collect():
        best[row.a] = row.most
    own = rows.filter("keys is null").drop("part", "keys", "counts").groupBy("chunk")
    given = sums.filter("chunk is not null").select("chunk", "keys", "sums").groupBy("chunk")
    return own.cogroup(given).applyInArrow(_score_chunk(paths, best), RESULT)


def op11_token_alignment(
    spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """Links between the tokens of two public tokenizers over all documents."""
    import public_tokenizers

    docs = documents(spark, sf_dir) if docs is None else docs
    found = link_counts(
        docs,
        path_a or public_tokenizers.path("byte_bpe_50k.json"),
        path_b or public_tokenizers.path("piece_bpe_32k.model"),
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    return found.select(*names)
