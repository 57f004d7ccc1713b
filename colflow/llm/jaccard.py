"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct shingles, hashed. Documents with equal sets are
one class. Two classes link if the similarity of their sets reaches the threshold.

Index lists by position. The hash order of the shingles is cut into positions, fixed
segments of the hash range. Linked sets of sizes a and b differ in at most
``k = (a + b) * (100 - percent) / (100 + percent)`` shingles, so of the first
segments that hold k + 1 non-empty ones at least one is equal in both. A list of the
index holds the sets with the same content at the same position. Sets of so few
shingles that they have no k + 1 non-empty segments stand in lists of single shingles
as well: those of their prefix, of which linked sets share one. How fine the
segments are depends on the larger set of a pair; sizes fall into blocks, and a set
goes only to the lists of the blocks where a partner may be: lists of other
positions and blocks are skipped as a whole.

A list of up to ``FEW`` members is answered by its pairs, of which sketches leave
those that may link: the counts of shingles by bucket differ in total by no more than
the sets do.

Members of longer lists are indexed again, by single shingles, those that the fewest of
these members have first. Linked sets share one of the first ``size - overlap + 1``,
``overlap`` being the least that a linked set shares. A set that has as many to itself
links with no other member, however many lists it stands in, and goes; the others stand
in lists of these first shingles that other members have too. Of those that are still
longer, up to ``MANY`` members, sketches leave the members that may link with another; if
these have few such partners, the pairs answer the list.

Answers from similar sets. The other lists are not expanded into pairs.
Their members are compared with one of them, the hub, that shares most lists with others. Lists that
are not of one component then are answered from what their members differ in from a
centre c, the shingles that more than half of a hub's members have. Let x lack r of
the centre's shingles and have a others, X be all these, t the threshold and
``d(x) = r + t a - (1 - t) |c|``. Two members link if and only if
``(1 + t) |X & Y| >= d(x) + d(y) + (1 - t) |c|``. So if they link and share nothing, both
link with the member b of the smallest d, which its numbers alone show. Else X and Y
share at least ``max(1, d(x), (d(x) + d(b) + (1 - t) |c|) / (1 + t))`` shingles, for
either of them, and an index over the differences, by prefix, finds all these links:
X in an order with the shingles that the fewest members have first, without its last
ones that cannot be the first shared. Shingles that only members of one component
have are left out before. Entries of such a list are skipped by blocks of one
component and one size of differences, and by position: what may still be shared
after it, and what the bitmaps of X and Y allow, must reach what the pair needs. Copies
with changes of their own share too little for that, so a group of n of them takes
about n comparisons.

Segments are matched by short hashes, which may only add candidates; every link is
verified on the whole sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colflow.llm.common import document_rows, documents, rows_with, rows_without
from colflow.llm.components import components
from colflow.llm.hashing import FOLDED, U, batches_of, mix, shingle_hashes, word_hashes
from colflow.session import materialize

#: documents for each part of the index
PART_DOCS = 4000
#: shingles for each part of the index of long lists' members
PART_SHINGLES = 1 << 19
#: texts that a task cuts into segments at a time, in bytes
GATHER = 24 << 20
#: members up to which a list is answered by its pairs
FEW = 16
#: members up to which those of a longer list are compared by their sketches
MANY = 1024
#: buckets of a set's sketch, a byte each
BUCKETS = 256
#: 64-bit maps of a set's differences, a power of two
MAPS = 4


class Sizes:
    """Blocks of set sizes, and how many segments they take."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = percent
        ratio = max(1.5, 100 / percent * 1.2)
        starts = [1]
        while starts[-1] < largest:
            starts.append(int(starts[-1] * ratio) + 1)
        self.starts = np.array(starts, np.int64)

    def differ(self, total):
        """Most shingles in which linked sets of ``total`` shingles together differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def block(self, size):
        return np.searchsorted(self.starts, size, side="right") - 1

    def segments(self, block: int) -> int:
        k = int(self.differ(2 * (self.starts[block + 1] - 1)))
        return k + 1 + max(8, k // 8)

    def partners(self, size: int) -> Iterator[tuple[int, int]]:
        """(block, k) of the blocks in which a set of ``size`` may meet a partner,
        with the most shingles they may differ in."""
        most = size * 100 // self.percent
        own = int(self.block(size))
        for block in range(own, int(self.block(most)) + 1):
            partner = min(most, int(self.starts[block + 1]) - 1)
            k = int(self.differ(size + max(partner, size)))
            # sets that may not differ are equal, and equal sets are one class
            if k:
                yield block, k


def shingle_sets(words: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, and where each document's begin."""
    hashes = shingle_hashes(words, n)
    sizes = np.diff(begin)
    count = np.maximum(sizes - n + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    at = begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    values = hashes[at]
    short = np.flatnonzero((sizes > 0) & (sizes < n))  # the whole sequence is one shingle
    if len(short):
        whole = [mix(shingle_hashes(words[begin[d] : begin[d + 1]], int(sizes[d])) + U(int(sizes[d]))) for d in short]
        doc, values = np.concatenate((doc, short)), np.concatenate((values, *whole))
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])))[: len(doc)]
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(len(sizes) + 1))


def _nodes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each document's whole set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ U(0xD6E8FEB86659FD93)), dtype=np.uint64)))
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _sketches(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """How many shingles of each document fall into each bucket, 255 at most."""
    out, bucket = [], (values & U(BUCKETS - 1)).astype(np.int64)
    for a in range(0, len(at) - 1, 1024):
        some = at[a : a + 1025]
        doc = np.repeat(np.arange(len(some) - 1), np.diff(some))
        counts = np.bincount(doc * BUCKETS + bucket[some[0] : some[-1]], minlength=(len(some) - 1) * BUCKETS)
        out += [row.tobytes() for row in np.minimum(counts, 255).astype(np.uint8).reshape(-1, BUCKETS)]
    return out


def _signatures(values: np.ndarray, size: int, sizes: Sizes) -> Iterator[np.ndarray]:
    """Hashes of the non-empty segments that a set is indexed by."""
    for block, k in sizes.partners(size):
        m = sizes.segments(block)
        segment = (values >> U(32)) * U(m) >> U(32)  # ascending, as the values are
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))[: k + 2]
        if len(first) <= k:
            # linked sets with too few segments between them have too few each, and
            # share one of the first shingles in hash order (prefix filter)
            prefix = size - -(-size * sizes.percent // 100) + 1
            yield mix(values[:prefix] + mix(np.array([~block], np.int64).view(np.uint64)))
        stop = first[k + 1] if len(first) > k + 1 else len(values)
        first = first[: k + 1]
        sums = np.add.reduceat(mix(values[:stop]), first)
        yield mix(sums + mix(segment[first] + U(block << 32)))


def _sets_of(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, raws in batches_of(batch.column("text").to_pylist()):
        values, at = shingle_sets(*word_hashes(raws, FOLDED), n)
        yield first, len(raws), values, at


def _class_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, values, at in _sets_of(batch, n):
                part = batch.slice(first, count)
                size = np.diff(at)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "text_key": part.column("text_key"),
                        "n_shingles": size,
                        "node": pa.array(_nodes(values, at), mask=size == 0),
                        "sketch": _sketches(values, at),
                    }
                )

    return run


#: blocks of an index: of a part, the short hashes, by node in order, and how many each node has
BLOCKS = "part long, signs binary, nodes binary, counts binary"
#: lists: ``u`` and ``v`` are a pair of a list of few members, ``u`` is a member of a longer one
LISTS = "list long, u long, v long"


def _blocks(part: np.ndarray, signs: np.ndarray, node: np.ndarray) -> dict[str, object]:
    """Columns of ``BLOCKS`` for entries whose nodes are together within a part."""
    order = np.argsort(part, kind="stable")
    part, signs, node = part[order], signs[order], node[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)])
    rows: dict[str, object] = {"part": part[cut].astype(np.int64)}
    signs_of, nodes_of, counts_of = [], [], []
    for a, b in zip(cut, [*cut[1:], len(part)], strict=False):
        own = node[a:b]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        signs_of.append(signs[a:b].tobytes())
        nodes_of.append(own[starts].tobytes())
        counts_of.append(np.diff(np.append(starts, len(own))).astype(np.uint32).tobytes())
    binary = {"signs": signs_of, "nodes": nodes_of, "counts": counts_of}
    return rows | {c: pa.array(x, pa.binary()) for c, x in binary.items()}


def _block_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Short hash and node of each entry of the blocks of one part."""
    signs = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("signs")])
    node = np.concatenate(
        [
            np.repeat(np.frombuffer(x.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32))
            for x, c in zip(table.column("nodes"), table.column("counts"), strict=True)
        ]
    )
    return signs, node


def _index_rows(n: int, parts: int, signatures: Callable[[np.ndarray, int], Iterator[np.ndarray]]):
    """Blocks of what ``signatures`` gives for each set and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray]] = []
        gathered = 0

        def out() -> pa.RecordBatch:
            signs = np.concatenate([s for _, s in found])
            node = np.repeat(np.array([x for x, _ in found], np.int64), [len(s) for _, s in found])
            short = (signs & U(0xFFFFFFFF)).astype(np.uint32)
            return pa.RecordBatch.from_pydict(_blocks((signs >> U(32)) % U(parts), short, node))

        for batch in batches:
            for _, _, values, at in _sets_of(batch, n):
                size, nodes = np.diff(at), _nodes(values, at)
                for d in np.flatnonzero(size).tolist():
                    for signs in signatures(values[at[d] : at[d + 1]], int(size[d])):
                        found.append((nodes[d], signs))
                gathered += 8 * len(values)
                if gathered > GATHER and found:
                    yield out()
                    found, gathered = [], 0
        if found:
            yield out()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """The entries of one part whose hash is not the only one: for each node its
    ``signs``, and ``counts``, how many entries have each."""
    signs, node = _block_entries(table)
    order = np.argsort(signs, kind="stable")
    signs, node = signs[order], node[order]
    first = np.flatnonzero(np.concatenate(([True], signs[1:] != signs[:-1])))
    count = np.diff(np.append(first, len(signs)))
    count = np.repeat(count, count)
    order = np.flatnonzero(count > 1)
    order = order[np.argsort(node[order], kind="stable")]
    signs, node, count = signs[order], node[order], count[order].astype(np.uint32)
    cut = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))[: len(node)])
    at = pa.py_buffer((4 * np.append(cut, len(node))).astype(np.int32))
    binary = [pa.Array.from_buffers(pa.binary(), len(cut), [None, at, pa.py_buffer(np.ascontiguousarray(x))]) for x in (signs, count)]
    part = np.full(len(cut), table.column("part")[0].as_py() if len(cut) else 0, np.int64)
    return pa.table({"part": part, "node": node[cut], "signs": binary[0], "counts": binary[1]})


def _rarest(table: pa.Table, percent: int) -> pa.Table:
    """Blocks of the first shingles of the nodes of ``table``, which has all rows of
    ``_repeated`` of a node, and its ``size``: those that the fewest have are first, those
    that no other has before all and left out."""
    nodes, size = table.column("node").to_numpy(), table.column("size").to_numpy()
    signs, count = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("signs", "counts"))
    each = pc.binary_length(table.column("signs")).to_numpy() // 4
    node, part, size = (np.repeat(x, each) for x in (nodes, table.column("part").to_numpy(), size))
    order = np.lexsort((signs, part, count, node))
    node, part, signs, size = node[order], part[order], signs[order], size[order]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))[: len(node)])
    repeated = np.diff(np.append(first, len(node)))
    # of the first ones that linked sets share one of, so many are not the set's alone
    alone = size[first] - repeated
    wanted = size[first] + (-size[first] * percent // 100) + 1 - alone
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (part[1:] != part[:-1]) | (signs[1:] != signs[:-1])))[: len(node)]
    rank = np.cumsum(new)
    rank -= np.repeat(rank[first] - 1, repeated)  # from 1 on
    keep = new & (rank <= np.repeat(wanted, repeated))
    return pa.table(_blocks(part[keep], signs[keep], node[keep]))


def _lists(table: pa.Table, most: int) -> pa.Table:
    """The lists of one part with two sets or more. Lists of ``most`` members come as
    their pairs ``u`` and ``v``, longer ones as members ``u``; lists with the same members are one,
    named by a hash of the members."""
    signs, node = _block_entries(table)
    order = np.lexsort((node, signs))
    signs, node = signs[order], node[order]
    new = np.concatenate(([True], (signs[1:] != signs[:-1]) | (node[1:] != node[:-1])))
    signs, node = signs[new], node[new]
    first = np.flatnonzero(np.concatenate(([True], signs[1:] != signs[:-1])))
    count = np.diff(np.append(first, len(signs)))
    name = mix(np.add.reduceat(mix(node.view(np.uint64)), first) + count.astype(np.uint64))
    _, chosen = np.unique(name, return_index=True)
    few, many = chosen[(count[chosen] > 1) & (count[chosen] <= most)], chosen[count[chosen] > max(most, 1)]
    pairs = [np.zeros((0, 2), np.int64)]
    for n in np.unique(count[few]).tolist():
        members = node[first[few[count[few] == n]][:, None] + np.arange(n)]  # ascending
        u, v = np.triu_indices(n, 1)
        pairs.append(np.stack((members[:, u].ravel(), members[:, v].ravel()), axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    at = np.repeat(first[many], count[many]) + np.arange(count[many].sum()) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
    no = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(at), pa.int64())
    return pa.table(
        {
            "list": pa.chunked_array([no[0], pa.array(np.repeat(name[many], count[many]).view(np.int64))]),
            "u": np.concatenate((pairs[:, 0], node[at])),
            "v": pa.chunked_array([pa.array(pairs[:, 1]), no[1]]),
        }
    )


def _near_members(table: pa.Table, percent: int, few: int, many: int) -> pa.Table:
    """What sketches leave of one list, a row for each member, as ``_lists`` gives it: the
    pairs that may link if a member has no more of them than in a list of ``few``, else
    the members that have one. A list of more than ``many`` stays as it is."""
    name, rows = table.column("list")[0].as_py(), table.num_rows
    node, size = table.column("u").to_numpy(), table.column("size").to_numpy().astype(np.int64)
    none = np.zeros(0, np.int64)
    u, v, near = [none], [none], np.full(rows, rows > many)
    order = np.argsort(size, kind="stable")
    size = size[order]
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(rows, BUCKETS)[order]
    # linked sets of ascending sizes end here
    ends = np.searchsorted(size, size * 100 // percent, side="right")
    found, sizes = 0, Sizes(percent)
    for i in range(0 if rows > many else rows):
        a, b = sketch[i], sketch[i + 1 : ends[i]]
        apart = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int32)
        with_i = i + 1 + np.flatnonzero(apart <= sizes.differ(size[i] + size[i + 1 : ends[i]]))
        near[order[with_i]] = True
        near[order[i]] |= len(with_i) > 0
        found += len(with_i)
        if found <= few * rows // 2:
            u.append(node[order[with_i]])
            v.append(np.full(len(with_i), node[order[i]]))
    if rows <= many and found <= few * rows // 2:
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.table({"list": pa.nulls(len(u), pa.int64()), "u": np.minimum(u, v), "v": np.maximum(u, v)})
    kept = node[near]
    return pa.table({"list": np.full(len(kept), name, np.int64), "u": kept, "v": pa.nulls(len(kept), pa.int64())})


def _set_rows(n: int):
    """``node`` and ``shingles`` of each text, once for each of its ``others``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, values, at in _sets_of(batch, n):
                others = batch.column("others").slice(first, count)
                each = np.diff(others.offsets.to_numpy())
                row = np.repeat(np.arange(count), each)
                sets = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_pydict(
                    {"node": _nodes(values, at)[row], "other": others.flatten(), "shingles": sets.take(row).cast(pa.list_(pa.int64()))}
                )

    return run


def _may_link(percent: int):
    """The pairs ``u``, ``v`` whose sketches do not differ by more than linked sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for batch in batches:
            rows = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(rows, BUCKETS) for c in ("a", "b"))
            apart = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
            total = batch.column("size_u").to_numpy().astype(np.int64) + batch.column("size_v").to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array(apart <= sizes.differ(total)))

    return run


class JaccardJoin:
    """Links of the documents of ``docs`` and their components.

    Null and empty texts have empty sets, which link with nothing; a text of fewer
    words than a shingle is one shingle. Rows are documents of their own even if
    they repeat; equal sets link. ``classes`` has one row per document row:
    ``doc_id``, ``text_key`` (hash of the text), ``n_shingles`` and ``node`` (the
    class; null for an empty set).
    """

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.words, self.percent = words, percent
        self.twice: DataFrame | None = None
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        kind = "doc_id long, text_key long, n_shingles long, node long, sketch binary"
        self.classes = materialize(self.texts.mapInArrow(_class_rows(words), kind), "classes")
        # one row stands for its class: the first by id and text
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
        firsts = self.classes.filter("node is not null").groupBy("node").agg(
            first.alias("f"), F.max("n_shingles").alias("size"), F.first("sketch").alias("sketch")
        )
        self.firsts = materialize(firsts.selectExpr("node", "size", "f.doc_id", "f.text_key", "sketch"), "class-rows")

    def index(self) -> DataFrame:
        """The lists of the index with two sets or more: ``u`` and ``v``, the pairs of
        those of few members, and ``list`` and ``u`` for the others."""
        rows = self.classes.filter("node is not null").select("doc_id", "text_key", "node")
        both = [rows["doc_id"].eqNullSafe(self.firsts["doc_id"]), rows["text_key"] == self.firsts["text_key"], rows["node"] == self.firsts["node"]]
        copies = materialize(rows.join(self.firsts, both, "left_anti").select("doc_id", "text_key").distinct(), "copies")
        single = rows_without(self.texts, copies, ["doc_id", "text_key"])
        parts = max(8, -(-self.firsts.count() // PART_DOCS))
        sizes = Sizes(self.percent)
        blocks = single.mapInArrow(_index_rows(self.words, parts, lambda values, size: _signatures(values, size, sizes)), BLOCKS)
        return materialize(self._listed(blocks), "lists")

    def _listed(self, blocks: DataFrame) -> DataFrame:
        most = FEW
        return blocks.groupBy("part").applyInArrow(lambda table: _lists(table, most), LISTS).distinct()

    def rare_index(self, members: DataFrame) -> DataFrame:
        """``index`` of the sets of ``members(node)`` among each other, by their rarest
        shingles. Every linked pair of them shares a list."""
        percent, names = self.percent, ["doc_id", "text_key"]
        members = materialize(self.firsts.join(members, "node").select("node", "size", *names), "members")
        shingles = members.agg(F.sum("size")).first()[0]
        if shingles is None:
            return self.firsts.sparkSession.createDataFrame([], LISTS)
        parts = max(8, -(-shingles // PART_SHINGLES))
        texts = self._once(rows_with(self.texts, members.select(*names), names))
        blocks = texts.mapInArrow(_index_rows(self.words, parts, lambda values, size: [mix(values)]), BLOCKS)
        shared = blocks.groupBy("part").applyInArrow(_repeated, "part long, node long, signs binary, counts binary")
        shared = materialize(shared, "entries").join(members.select("node", "size"), "node")
        dealt = shared.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)))
        rarest = dealt.applyInArrow(lambda table: _rarest(table, percent), BLOCKS)
        lists = materialize(self._listed(rarest), "rare-lists")
        few, many = FEW, MANY
        sketch = self.firsts.selectExpr("node as u", "size", "sketch")
        long = lists.filter("v is null").join(sketch, "u").select("list", "u", "size", "sketch")
        long = long.groupBy("list").applyInArrow(lambda table: _near_members(table, percent, few, many), LISTS)
        return lists.filter("v is not null").unionByName(materialize(long.distinct(), "met-blocks"))

    def _once(self, near: DataFrame) -> DataFrame:
        """``near``, rows of ``texts``: of rows that stand in the table more than once, one."""
        names = ["doc_id", "text_key"]
        if self.twice is None:
            self.twice = materialize(self.classes.groupBy(*names).count().filter("count > 1").select(*names), "repeated-rows")
        if self.twice.isEmpty():
            return near
        return rows_without(near, self.twice, names).unionByName(rows_with(near, self.twice, names).dropDuplicates(names))

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """``node``, ``other`` and ``shingles`` for ``wanted(node, others)``: the set of
        each node, once for each of the others. The texts wanted are shuffled, at any number
        of nodes; of rows that stand in the table more than once, one is taken."""
        names = ["doc_id", "text_key"]
        keys = materialize(self.firsts.join(wanted, "node").select(*names, "others"), "wanted")
        # the texts that are not wanted stay where they are if the keys are few
        near = rows_with(self.texts, keys.select(*names), names)
        sides = keys.withColumnsRenamed({n: f"own_{n}" for n in names}).hint("merge")
        near = near.join(sides, F.expr(" and ".join(f"{n} <=> own_{n}" for n in names)))
        near = self._once(near.select(*names, "text", "others"))
        return near.select("text", "others").mapInArrow(_set_rows(self.words), "node long, other long, shingles array<long>")

    def _beside(self, pairs: DataFrame) -> DataFrame:
        """``u``, ``v`` and both sets. One pass over the texts gives the sets of both
        sides; the copies of a set for its partners leave the task that reads its text."""
        sides = F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), "v"))
        wanted = pairs.select(F.inline(sides)).groupBy("node").agg(F.collect_set("v").alias("others"))
        sets = self._sets(wanted)
        a = sets.filter("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v"), F.col("shingles").alias("a"))
        b = sets.filter("node = other").select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        return a.join(b, "v")

    def _near_pairs(self, pairs: DataFrame) -> DataFrame:
        """The distinct ``pairs`` that may link by their sketches."""
        sketch = self.firsts.select("node", "size", "sketch")
        side = [sketch.withColumnsRenamed({"node": x, "size": f"size_{x}", "sketch": y}) for x, y in (("u", "a"), ("v", "b"))]
        return pairs.distinct().join(side[0], "u").join(side[1], "v").mapInArrow(_may_link(self.percent), "u long, v long")

    def _open_pairs(self, lists: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs ``u`` and hub ``v`` of the lists that may hold a link not found yet:
        lists of three members or more that are not of one component."""
        labelled = lists.withColumnRenamed("node", "u").join(found.withColumnRenamed("node", "u"), "u", "left")
        labelled = labelled.select("list", "u", F.coalesce("low", "u").alias("low"))
        state = labelled.groupBy("list").agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("low").alias("most"))
        unsettled = state.filter("n > 2 and least < most").select("list")
        return labelled.join(unsettled, "list", "left_semi").join(hubs, "list").filter("u <> v").select("u", "v").distinct()

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """For each of ``pairs(u, v, is_hub)`` whether they link, and if ``v`` is a hub
        its size and what ``u`` has besides (``foreign``) and lacks."""
        both = self._beside(pairs).select(
            "u",
            "v",
            F.size("b").alias("h"),
            F.sort_array(F.array_except("a", "b")).alias("foreign"),
            F.sort_array(F.array_except("b", "a")).alias("lacked"),
        )
        linked = 100 * (F.col("h") - F.size("lacked")) >= self.percent * (F.col("h") + F.size("foreign"))
        kept = [F.when(F.col("is_hub"), F.col(c)).alias(c) for c in ("foreign", "lacked")]
        return both.join(pairs, ["u", "v"]).select("u", "v", "is_hub", "h", linked.alias("linked"), *kept)

    def _centred(self, rows: DataFrame) -> DataFrame:
        """``rows(u, v, h, foreign, lacked)``, the hub's own among them, with the
        differences from the hub replaced by those from the centre of its members: the
        shingles that more than half of them have. ``h`` becomes the centre's size."""
        sides = [rows.select("v", F.explode(c).alias("e"), F.lit(own).alias("own")) for c, own in (("foreign", False), ("lacked", True))]
        counts = sides[0].unionByName(sides[1]).groupBy("v", "e", "own").agg(F.count("*").alias("n"))
        members = rows.groupBy("v").agg(F.count("*").alias("members"))
        changed = counts.join(members, "v").filter("2 * n > members").groupBy("v").agg(
            F.collect_list(F.expr("if(own, null, e)")).alias("gained"), F.collect_list(F.expr("if(own, e, null)")).alias("lost")
        )
        changed = materialize(changed, "centres")
        none = F.array().cast("array<long>")
        found = rows.join(changed, "v", "left").withColumns({c: F.coalesce(c, none) for c in ("gained", "lost")})
        foreign = F.concat(F.array_except("foreign", "gained"), F.array_except("lost", "lacked"))
        lacked = F.concat(F.array_except("lacked", "lost"), F.array_except("gained", "foreign"))
        return found.select(
            "u", "v", (F.col("h") + F.size("gained") - F.size("lost")).alias("h"),
            F.sort_array(foreign).alias("foreign"), F.sort_array(lacked).alias("lacked"),
        )

    def _differences(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """Rows of ``_centred`` with the sizes of the differences, the ``need`` of them that
        a partner shares, and ``low``, the component known so far. ``best`` is the
        member nearest to the centre if the two link whatever they share."""
        p = self.percent
        sized = rows.withColumns({"fa": F.size("foreign"), "la": F.size("lacked")})
        beyond = 100 * F.col("la") + p * F.col("fa") - (100 - p) * F.col("h")
        label = F.coalesce("low", "u").alias("low")
        known = sized.join(found.withColumnRenamed("node", "u"), "u", "left").select(*sized.columns, label, beyond.alias("beyond"))
        known = materialize(known, "centred")
        nearest = known.groupBy("v").agg(F.min(F.struct("beyond", "u", "low")).alias("b"))
        together = F.col("beyond") + F.col("b.beyond") + (100 - p) * F.col("h")
        need = F.greatest(F.lit(1), F.ceil(F.col("beyond") / 100), F.ceil(together / (100 + p))).cast("int")
        sure = together <= 0
        return known.join(nearest, "v").select(
            "u", "v", "h", "fa", "la", "foreign", "lacked", need.alias("need"),
            F.when(sure, F.col("b.low")).otherwise(F.col("low")).alias("low"), F.when(sure, F.col("b.u")).alias("best"),
        )

    def _entries(self, known: DataFrame) -> DataFrame:
        """The index over the differences of ``known``: an entry for each difference in a
        prefix that members of two components have. The order is by the number of members,
        the fewest first, and those of one component before all. ``left`` is how many
        may still be shared from an entry on, ``s`` how many at all, ``m0`` to ``m3`` a map of them."""
        each = known.select("v", "u", "low", F.explode(F.concat("foreign", "lacked")).alias("e"))
        # a difference is one row, sorted once; a key has half of a hub's members at most
        members, own = Window.partitionBy("v", "e"), Window.partitionBy("v", "u")
        counted = each.select(
            "v", "u", "e", F.min("low").over(members).alias("least"), F.max("low").over(members).alias("most"),
            F.count("*").over(members).alias("n"),
        )
        shared = counted.filter("least < most")
        bit = F.expr("shiftleft(1L, cast(e & 63 as int))")
        maps = [F.bit_or(F.when(F.expr(f"shiftright(e, 6) & {MAPS - 1} = {i}"), bit).otherwise(F.lit(0))).over(own).alias(f"m{i}") for i in range(MAPS)]
        left = F.row_number().over(own.orderBy(F.desc("n"), "e"))
        placed = shared.select("v", "u", "e", left.alias("left"), F.count("*").over(own).alias("s"), *maps)
        entry = placed.join(known.select("v", "u", "h", "fa", "la", "low", "need"), ["v", "u"]).filter("left >= need")
        return materialize(entry.drop("need"), "entries")

    def components(self) -> DataFrame:
        """``node`` and ``low``, the smallest node of its component, for the nodes
        that link with another."""
        p = self.percent
        index = self.index()
        rare = self.rare_index(index.filter("v is null").select(F.col("u").alias("node")).distinct())
        few = index.unionByName(rare).filter("v is not null").select("u", "v")
        few = materialize(self._near_pairs(few), "candidates").withColumn("is_hub", F.lit(False))
        lists = rare.filter("v is null").select("list", F.col("u").alias("node"))
        members = lists.groupBy("list").agg(F.count("*").alias("n"))
        ranked = lists.join(lists.join(members, "list").groupBy("node").agg(F.sum("n").alias("shared")), "node")
        hubs = ranked.groupBy("list").agg(F.max(F.struct("shared", "node")).alias("hub")).selectExpr("list", "hub.node as v")
        hubs = materialize(hubs, "hubs")
        beside = lists.withColumnRenamed("node", "u").join(hubs, "list").filter("u <> v").select("u", "v", F.lit(True).alias("is_hub"))
        pairs = materialize(few.unionByName(beside).groupBy("u", "v").agg(F.max("is_hub").alias("is_hub")), "pairs")
        compared = materialize(self._compared(pairs), "compared")
        edges = compared.filter("linked").select("u", "v")
        found = materialize(components(edges), "components")

        left_over = materialize(self._open_pairs(lists, hubs, found), "open-pairs")
        if left_over.isEmpty():
            return found
        member = compared.filter("is_hub").join(left_over, ["u", "v"], "left_semi").select("u", "v", "h", "foreign", "lacked")
        none = F.array().cast("array<long>")
        itself = member.groupBy("v").agg(F.max("h").alias("h")).select(F.col("v").alias("u"), "v", "h", none.alias("foreign"), none.alias("lacked"))
        known = materialize(self._differences(self._centred(member.unionByName(itself)), found), "differences")
        sure = known.filter("best <> u").select("u", F.col("best").alias("v"))
        entry = self._entries(known)
        # Entries of one list, component and size of the differences are a block; a
        # pair of blocks is skipped whole if nothing in it can share enough. A bit that
        # all maps of one have and none of the other stands for a difference not shared.
        must_share = 100 * (F.col("la") + F.col("la2")) + p * (F.col("fa") + F.col("fa2")) - (100 - p) * F.col("h")
        block = ["v", "e", "low", "fa", "la"]
        names = [f"m{i}" for i in range(MAPS)]
        both = [f"{m}_{way}" for m in names for way in ("and", "or")]
        maps = [F.expr(f"bit_{way}({m})").alias(f"{m}_{way}") for m in names for way in ("and", "or")]
        blocks = entry.groupBy(*block).agg(F.max("left").alias("left"), F.max("s").alias("s"), F.max("h").alias("h"), *maps)
        second = {c: f"{c}2" for c in ("u", "fa", "la", "low", "left", "s", *names, *both)}
        other = blocks.drop("h").withColumnsRenamed(second)

        def may_share(every: str, some: str):
            lost = [" - ".join(f"bit_count({m}{every}{x} & ~{m}{some}{y})" for m in names) for x, y in (("", "2"), ("2", ""))]
            most = [f"s - {lost[0]}", f"s2 - {lost[1]}"]
            return (100 + p) * F.least("left", "left2", *map(F.expr, most))

        meet = (F.col("low") < F.col("low2")) & (may_share("_and", "_or") >= must_share)
        met = materialize(blocks.join(other, ["v", "e"]).filter(meet).select(*block, "low2", "fa2", "la2"), "met-blocks")
        candidates = (
            met.join(entry, block)
            .join(entry.drop("h").withColumnsRenamed(second), ["v", "e", "low2", "fa2", "la2"])
            .filter(may_share("", "") >= must_share)
            .select("v", "u", "u2")
            .distinct()
        )
        candidates = materialize(candidates, "candidates")
        sides = known.select("v", "u", "h", "fa", "la", "foreign", "lacked")
        common = sum(F.size(F.array_intersect(c, f"{c}2")) for c in ("foreign", "lacked"))
        more = (
            candidates.join(sides, ["v", "u"])
            .join(sides.drop("h").withColumnsRenamed({c: f"{c}2" for c in ("u", "fa", "la", "foreign", "lacked")}), ["v", "u2"])
            .filter((100 + p) * common >= must_share)
            .select("u", F.col("u2").alias("v"))
        )
        more = materialize(sure.unionByName(more), "links")
        # links between components known so far join these; the nodes follow
        ends = more
        for end in ("u", "v"):
            ends = ends.join(found.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("low", end)).drop("low")
        joins = materialize(ends.filter("u <> v").distinct(), "joining-links")
        if joins.isEmpty():
            return found
        joined = components(joins).selectExpr("node as low", "low as lowest")
        alone = joined.selectExpr("low as node", "low").join(found, "node", "left_anti")
        every = found.unionByName(alone).join(joined, "low", "left")
        return materialize(every.select("node", F.coalesce("lowest", "low").alias("low")), "components")

    def documents(self) -> DataFrame:
        """One row per document row: ``doc_id``, ``text_key``, ``n_shingles`` and
        ``component_id``, the smallest id of its component (its own for a component
        without other ids; null if that has none)."""
        found = self.components()
        label = (
            self.firsts.join(found, "node", "left")
            .select("node", F.coalesce("low", "node").alias("low"), "doc_id")
        )
        lowest = materialize(label.groupBy("low").agg(F.min("doc_id").alias("component_id")), "component-ids")
        ids = materialize(label.select("node", "low").join(lowest, "low").select("node", "component_id"), "node-ids")
        joined = self.classes.join(ids, "node", "left")
        own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return joined.select("doc_id", "text_key", "n_shingles", own.alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are 90 per cent equal."""
    docs = documents(spark, sf_dir) if docs is None else docs
    return JaccardJoin(docs, 3, 90).documents().select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, all
    its columns kept. Rows that repeat its id are the same document and stay with it;
    rows without id go if their component has an id. Null and empty texts are
    linked with nothing and stay; an empty table stays empty."""
    names = ["doc_id", "text_key"]
    found = JaccardJoin(docs, words, percent).documents()
    gone = found.filter("component_id is not null and not (doc_id <=> component_id)").select(*names).distinct()
    return rows_without(document_rows(docs), materialize(gone, "near-duplicates"), names).select("row.*")
