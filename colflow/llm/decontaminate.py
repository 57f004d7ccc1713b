"""Benchmark decontamination by SimHash over item-sized windows.

For an item of n words the windows are all n consecutive words of a document; a
document of fewer words is one window as a whole. Each window and item has a 64-bit SimHash over its weighted 5-word shingles (the weight
is how often a shingle stands in it). The items' fingerprints are indexed in
blocks: with radius R and M blocks, two fingerprints within R differ in at most
R // M bits of some block, so looking every block up within that distance finds
all within the radius. The candidates are then verified: exact weighted Jaccard
similarity of the shingles themselves, as words.

A window without a shingle of an item has similarity 0 with it; so fingerprints
are only computed for windows that hold one, which loses nothing.

Documents pass through in batches of rows and nothing is shuffled. The items are
sent to the tasks in blocks of bounded size, one pass over the documents each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import document_rows, documents, rows_without
from colflow.llm.hashing import batches_of, mix, shingle_hashes, word_hashes
from colflow.llm.notices import WORD_TABLE
from colflow.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: of 64 bits; shingle sets of similarity 0.8 differ in 10 bits, with deviation 3
RADIUS = 24
BLOCKS = 8
#: bytes of item text sent to the tasks at a time, enforced item by item
ITEM_BYTES = 8 << 20

U = np.uint64


def shingles(words: list[bytes]) -> Counter:
    """Weighted shingles; fewer words than a shingle are one."""
    n = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: for each bit the majority over the shingles' scrambled hashes."""
    return int(_fingerprints(hashes, np.array([0]), len(hashes))[0])


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the ``width`` shingles from each of ``starts``."""
    raw = np.unpackbits(mix(hashes ^ U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(raw, axis=0, dtype=np.int32, out=sums[1:])
    ones = sums[starts + width] - sums[starts]
    return np.packbits(2 * ones > width, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class HammingBlocks:
    """Multi-index over fingerprints: a table per block from each value of the
    block to the items within ``RADIUS // BLOCKS`` bits of it."""

    def __init__(self, prints: list[int]):
        bits = 64 // BLOCKS
        self.prints = np.array(prints, np.uint64)
        flips = [sum(1 << b for b in bad) for d in range(RADIUS // BLOCKS + 1) for bad in combinations(range(bits), d)]
        self.tables: list[dict[int, list[int]]] = []
        for block in range(BLOCKS):
            table = defaultdict(list)
            for i, p in enumerate(prints):
                own = p >> (block * bits) & ((1 << bits) - 1)
                for flip in flips:
                    table[own ^ flip].append(i)
            self.tables.append(table)

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query, item, distance) of all pairs within the radius."""
        bits = 64 // BLOCKS
        for q, p in enumerate(prints.tolist()):
            near = set()
            for block, table in enumerate(self.tables):
                near.update(table.get(p >> (block * bits) & ((1 << bits) - 1), ()))
            for i in sorted(near):
                distance = (p ^ int(self.prints[i])).bit_count()
                if distance <= RADIUS:
                    yield q, i, distance


class Items:
    """The items of one block, by their number of words."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        by_size = defaultdict(list)
        for item_id, text in rows:
            words = (text or "").encode().translate(WORD_TABLE).split()
            if words:
                by_size[len(words)].append((item_id, words))
        self.sizes = {}
        owners = defaultdict(set)
        for size, items in by_size.items():
            width = min(SHINGLE, size)
            prints = []
            for _, words in items:
                hashes = shingle_hashes(word_hashes([b" ".join(words)], WORD_TABLE)[0], width)
                prints.append(fingerprint(hashes))
                for h in hashes.tolist():
                    owners[width, h].add(size)
            self.sizes[size] = ([i for i, _ in items], [shingles(w) for _, w in items], HammingBlocks(prints))
        # by shingle width: the shingles' hashes, sorted, and the item sizes that have them
        self.known = {}
        for width in {w for w, _ in owners}:
            hashes = np.array(sorted(h for w, h in owners if w == width), np.uint64)
            self.known[width] = (hashes, [sorted(owners[width, h]) for h in hashes.tolist()])

    def matches(self, raw: bytes, hits: dict[int, list[int]], hashes: dict[int, np.ndarray]) -> Iterator[tuple]:
        """(item_id, first_word, n_words, distance, similarity): the best window of
        each item in a text; ``hits`` has for each item size the places that share
        a shingle with such an item."""
        words = raw.translate(WORD_TABLE).split()
        for size, places in hits.items():
            width = min(SHINGLE, size)
            n = min(size, len(words))
            # of so few shingles not even all would be similar enough
            if (n - width + 1) / (size - width + 1) < SIMILARITY:
                continue
            last = len(words) - n
            starts = sorted({s for p in places for s in range(max(0, p - n + width), min(p, last) + 1)})
            if not starts:
                continue
            ids, weights, blocks = self.sizes[size]
            best: dict[int, tuple] = {}
            # neighbouring starts share their prefix sums
            first = 0
            for i in range(1, len(starts) + 1):
                if i < len(starts) and starts[i] - starts[i - 1] <= n and i - first < 4096:
                    continue
                group = np.array(starts[first:i])
                first = i
                base = group[0]
                stretch = hashes[width][base : group[-1] + n - width + 1]
                prints = _fingerprints(stretch, group - base, n - width + 1)
                windows: dict[int, Counter] = {}
                for q, item, distance in blocks.within(prints):
                    at = int(group[q])
                    if q not in windows:
                        windows[q] = shingles(words[at : at + n])
                    close = similarity(windows[q], weights[item])
                    if close >= SIMILARITY and (item not in best or (-close, at) < best[item][:2]):
                        best[item] = (-close, at, distance)
            for item, (close, at, distance) in best.items():
                yield ids[item], at, n, distance, -close


@lru_cache(maxsize=2)
def _items(rows: tuple[tuple[int, str | None], ...]) -> Items:
    return Items(list(rows))


def _find(rows: tuple[tuple[int, str | None], ...], keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(rows)
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            out = []
            for first, raws in batches_of(batch.column("text").to_pylist()):
                words, begin = word_hashes(raws, WORD_TABLE)
                found = defaultdict(lambda: defaultdict(list))
                by_width = {}
                for width, (known, sizes) in items.known.items():
                    hashes = by_width[width] = shingle_hashes(words, width)
                    if not len(hashes):
                        continue
                    slot = np.searchsorted(known, hashes)
                    slot[slot == len(known)] = 0
                    places = np.flatnonzero(known[slot] == hashes)
                    doc = np.searchsorted(begin, places, side="right") - 1
                    inside = places + width <= begin[doc + 1]
                    for p, d, s in zip(places[inside].tolist(), doc[inside].tolist(), slot[places[inside]].tolist(), strict=True):
                        for size in sizes[s]:
                            if min(SHINGLE, size) == width:
                                found[d][size].append(p - int(begin[d]))
                for d, hits in found.items():
                    own = {w: h[begin[d] : max(begin[d], begin[d + 1] - w + 1)] for w, h in by_width.items()}
                    out += [(*ids[first + d], *m) for m in items.matches(raws[d], hits, own)]
            names = [*keys, "item_id", "first_word", "n_words", "distance", "similarity"]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * (len(keys) + 3) + [pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


MATCH = "item_id long, first_word long, n_words long, distance int, similarity double"


def _leaks(rows: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """The best window of each item by ``keys`` of ``rows``, which are longs and name
    what is taken together."""
    spark = rows.sparkSession
    slim = rows.select(*keys, "text")
    match = ", ".join(f"{k} long" for k in keys) + ", " + MATCH
    items = benchmark.selectExpr("cast(item_id as long) as item_id", "text").distinct()
    block, size, passes = [], 0, []
    for row in items.toLocalIterator():
        cost = len((row.text or "").encode()) + 64
        if block and size + cost > ITEM_BYTES:
            # stored, so that no more than one block is held at a time
            passes.append(materialize(slim.mapInArrow(_find(tuple(block), keys), match), "leaks"))
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += cost
    if block:
        passes.append(slim.mapInArrow(_find(tuple(block), keys), match))
    if not passes:
        return spark.createDataFrame([], match)
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "first_word", "distance", "n_words"))
    found = reduce(DataFrame.unionByName, passes).groupBy(*keys, "item_id").agg(best.alias("best"))
    return found.selectExpr(
        *keys, "item_id", "best.first_word", "best.n_words", "best.distance", "-best.far as similarity"
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that a window of the document matches: the
    best window (the first of equal ones), its Hamming distance and similarity.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters.
    Items without words match nothing; items of fewer than five words are one
    shingle. A text of fewer words than an item is compared with it as a whole.
    Null and empty texts match nothing. Rows that repeat an id, of a
    document or of an item, are taken together: the best of them counts.
    """
    return _leaks(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), benchmark, ["doc_id"])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all their columns kept. A
    row is named by its id, which may be null, and a hash of its text: others with
    the same id stay. Null and empty texts hold no item and stay; an empty
    benchmark drops nothing."""
    names = ["doc_id", "text_key"]
    marked = document_rows(docs)
    gone = _leaks(marked.select(*names, F.col("row.text").cast("string").alias("text")), benchmark, names)
    return rows_without(marked, materialize(gone.select(*names).distinct(), "leaking"), names).select("row.*")


def op6_decontamination(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, benchmark: DataFrame | None = None) -> DataFrame:
    """Every (document, benchmark item) with a window of similarity 0.8 or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet") if benchmark is None else benchmark
    return find_leaks(documents(spark, sf_dir) if docs is None else docs, benchmark)
