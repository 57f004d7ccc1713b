"""Scan for licence phrases and, with small errors, for short licence notices.

A notice may stand with up to ``k`` character edits. Cut into ``k + 1`` pieces, it
leaves at least one piece untouched (pigeonhole), so an automaton over all pieces
finds every place that may hold it, and the regex library's bounded-error matching
verifies the neighbourhood of each and reports span and edits: the exact places
first, then between those found the places with one edit, and so on up to ``k``.
Rows pass in batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import documents

#: fixed values: phrases whose exact word sequence counts as a place, with labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: short notices in words (lower case, punctuation apart) and the label each adds
NOTICES = {
    "all rights reserved": "reserved",
    "copyright notice shall be included in all copies": "mit",
    "dedicated to the public domain": "public-domain",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released under the mit license": "mit",
    "under a creative commons attribution license": "cc-by",
}

# word characters: digits, letters (A-Z folded) and every byte of a non-ASCII character
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

PLACES = "array<struct<label:string,first_word:long,last_word:long,edits:int,exact:boolean,score:double>>"


def edits_allowed(notice: str) -> int:
    """One edit for each ten characters."""
    return len(notice) // 10


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``notice`` in ``edits + 1`` pieces of nearly equal length, with offsets."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def _machine(notices: tuple[tuple[str, str], ...]):
    """The automaton over all pieces, and each notice with its label, edits and
    patterns for 0, 1, ... edits."""
    import ahocorasick
    import regex

    found: dict[str, list[tuple[int, int]]] = {}
    rules = []
    for n, (notice, label) in enumerate(notices):
        k = edits_allowed(notice)
        patterns = [regex.compile(f"(?:{regex.escape(notice)}){{e<={e}}}") for e in range(k + 1)]
        rules.append((notice, label, k, patterns))
        for offset, piece in pieces(notice, k):
            found.setdefault(piece, []).append((n, offset))
    machine = ahocorasick.Automaton()
    for piece, owners in found.items():
        machine.add_word(piece, (len(piece), owners))
    machine.make_automaton()
    return machine, rules


def _matches(text: str, low: int, high: int, least: int, patterns: list) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) in a stretch of ``text``, the fewest edits first; each
    further edit is only granted to what lies between the matches found before."""
    if not patterns[-1].search(text, low, high):
        return
    gaps = [(low, high)]
    for pattern in patterns:
        rest = []
        for a, b in gaps:
            for m in pattern.finditer(text, a, b):
                yield m.start(), m.end(), sum(m.fuzzy_counts)
                rest.append((a, m.start()))
                a = m.end()
            rest.append((a, b))
        gaps = [(a, b) for a, b in rest if b - a >= least]


def fuzzy_places(text: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, edits, score) of every notice in ``text``, a text of
    words with single spaces; positions are characters. Places of one notice do
    not overlap: of overlapping ones that with the fewest edits counts, then the
    first."""
    machine, rules = _machine(notices)
    windows: dict[int, list[tuple[int, int]]] = {}
    for last, (length, owners) in machine.iter(text):
        for n, offset in owners:
            notice, _, k, _ = rules[n]
            start = last + 1 - length - offset
            windows.setdefault(n, []).append((max(0, start - k), min(len(text), start + len(notice) + 2 * k)))
    out = []
    for n, found in windows.items():
        notice, label, k, patterns = rules[n]
        spans: list[list[int]] = []
        for low, high in sorted(found):
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        for low, high in spans:
            for start, end, edits in _matches(text, low, high, len(notice) - k, patterns):
                out.append((label, start, end, edits, 1 - edits / len(notice)))
    return out


def _exact_places(text: str) -> list[tuple[str, int, int]]:
    """(label, start, end) of each phrase as a word sequence, overlaps included."""
    padded, out = f" {text} ", []
    for phrase, label in PHRASES.items():
        needle = f" {phrase} "
        at = padded.find(needle)
        while at >= 0:
            out.append((label, at, at + len(phrase)))
            at = padded.find(needle, at + 1)
    return out


def scan_notices(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, ``n_words`` and ``places``: label, first and last word (from 0),
    edits, whether the place is an exact phrase, and score (1 less the share of
    edited characters), in the order of the text.

    Null and empty texts have no words and no places; repeated rows stay.
    """
    chosen = tuple((NOTICES if notices is None else notices).items())

    def places(text: str) -> list[dict]:
        found = [(a, b, label, 0, True, 1.0) for label, a, b in _exact_places(text)]
        found += [(a, b, label, e, False, s) for label, a, b, e, s in fuzzy_places(text, chosen)]
        found.sort()
        out, word, at = [], 0, 0
        for a, b, label, e, exact, score in found:
            word, at = word + text.count(" ", at, a), a
            # a match may begin or end on the space beside a word
            first = word + (text[a : a + 1] == " ")
            last = word + text.count(" ", a, max(b - 1, a))
            out.append({"label": label, "first_word": first, "last_word": max(first, last), "edits": e, "exact": exact, "score": score})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]
                + [("edits", pa.int32()), ("exact", pa.bool_()), ("score", pa.float64())]
            )
        )
        for batch in batches:
            split = [(t or "").encode().translate(WORD_TABLE).split() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array([len(w) for w in split], pa.int64()),
                    "places": pa.array([places(b" ".join(w).decode()) for w in split], kind),
                }
            )

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return slim.mapInArrow(run, f"doc_id long, n_words long, places {PLACES}")


def op8_license_scan(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """One row per document: the exact phrases' places summed up, the labels of
    these and of the notices, and the best score of a place (0 without any)."""
    scanned = scan_notices(documents(spark, sf_dir) if docs is None else docs)
    exact = F.filter("places", lambda p: p["exact"])
    starts = F.transform(exact, lambda p: p["first_word"])

    def labels(places: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
        "places",
    )
