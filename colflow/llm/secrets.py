"""Secret scans with patterns and sliding-window Shannon entropy. DataFrame functions
only.

Patterns of known kinds give the base spans. Besides, strings of 20 or more characters
of keys and tokens are candidates. A window of 20 characters slides over each: counts
by character follow it, up by the one that enters and down by the one that leaves, and
with them the sum of ``c * log2(c)``, which is all the entropy needs. How high it must
be depends on the window's character classes, since hexadecimal digits alone can not
reach what mixed letters and digits do, and what is only letters of one case, or only
digits, is no secret at any entropy. Windows above their threshold that touch are one
span. Spans that overlap a base span, or whose candidate matches the allow list, go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import documents, let

#: kind: pattern, the group that has a least length, that length
PATTERNS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # a longer run begins where a shorter one does, so the least length may stand in the pattern
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ENTROPY = "entropy"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: bits a character that a window must reach, by its classes; log2(20) is the most
BITS = {"hex": 3.2, "one case and digits": 3.6, "both cases": 3.8, "both cases and digits": 3.6}
#: candidates that match one of these are no secrets: identifiers of the usual form,
#: words for what stands in a secret's place, paths and rulers
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|your[_-]?(key|token|secret)",
    r"^/?([A-Za-z0-9_.-]+/){3,}",
    r"^[A-Za-z]+([_-][A-Za-z]+)+$",
]

SPAN = "struct<start: int, end: int>"


def running_starts(lengths: Column) -> Column:
    """Sums of the ``lengths`` before each place. Appending to one array would copy it
    for each element, so sums run inside blocks of a square root, then over blocks."""

    def sums(values: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        return F.aggregate(
            values, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
        )

    def blocked(values: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")),
            lambda b: sums(F.slice(values, b * width + 1, width)),
        )
        return let(
            blocks,
            lambda done: let(
                sums(F.transform(done, lambda x: x["at"]))["starts"],
                lambda before: F.flatten(
                    F.transform(done, lambda x, i: F.transform(x["starts"], lambda s: s + F.get(before, i)))
                ),
            ),
        )

    return F.when(F.size(lengths) > 0, blocked(lengths)).otherwise(F.expr("cast(array() as array<int>)"))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of ``start``, ``end`` (code points,
    exclusive), ``value`` and ``part`` (a group of the pattern). Lengths of the
    matches and of what lies between give the places."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        between = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.char_length)
        length = F.transform(found, F.char_length)
        starts = running_starts(F.zip_with(between, length, lambda b, v: b + v))
        return F.transform(
            F.arrays_zip(starts.alias("at"), between.alias("gap"), found.alias("value"), parts.alias("part")),
            lambda m: F.struct(
                (m["at"] + m["gap"]).alias("start"),
                (m["at"] + m["gap"] + F.char_length(m["value"])).alias("end"),
                m["value"].alias("value"),
                m["part"].alias("part"),
            ),
        )

    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string, part: string>>)")
    return let(values, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _bits_needed(counts: Column) -> Column:
    """The threshold of a window by the classes in its ``counts``; null where no
    entropy makes a secret."""

    def some(characters: str) -> Column:
        places = [ALPHABET.index(c) + 1 for c in characters]
        return F.aggregate(F.slice(counts, places[0], len(places)), F.lit(0), lambda s, c: s + c) > 0

    upper, lower, digit = some(ALPHABET[:26]), some(ALPHABET[26:52]), some(ALPHABET[52:62])
    beyond_hex = some(ALPHABET[:26]) | some(ALPHABET[32:52]) | some(ALPHABET[62:])
    return (
        F.when(~beyond_hex, F.when(lower & digit, BITS["hex"]))
        .when(upper & lower, F.when(digit, BITS["both cases and digits"]).otherwise(BITS["both cases"]))
        .when(digit & (upper | lower), BITS["one case and digits"])
    )


def hot_windows(candidate: Column) -> Column:
    """Array of ``start`` and ``end`` in the ``candidate``: its windows of ``WINDOW``
    characters whose entropy reaches their classes' threshold, those that touch or
    overlap taken together."""
    # c * log2(c) for the counts that a window can have
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])

    def slide(at: Column) -> Column:
        """``at``: places of the candidate's characters in the alphabet."""

        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(at, i), F.when(i >= WINDOW, F.get(at, i - WINDOW)).otherwise(F.lit(-1))
            counts, total = state["counts"], state["total"]
            up, down = F.get(counts, enters), F.get(counts, leaves)
            # the one that leaves first; if both are the same nothing changes
            moved = F.when(
                enters != leaves,
                total + F.get(weight, up + 1) - F.get(weight, up)
                + F.when(leaves >= 0, F.get(weight, down - 1) - F.get(weight, down)).otherwise(0.0),
            ).otherwise(total)
            new = F.transform(counts, lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int"))
            return F.struct(new.alias("counts"), moved.alias("total"), state["spans"].alias("spans"), state["open"].alias("open"), i.alias("i"))

        def judged(state: Column) -> Column:
            end = state["i"] + 1
            bits = F.lit(math.log2(WINDOW)) - state["total"] / WINDOW
            hot = (end >= WINDOW) & F.coalesce(bits >= _bits_needed(state["counts"]), F.lit(False))
            own, last = F.struct((end - WINDOW).alias("start"), end.alias("end")), state["open"]
            joins = last["end"] >= own["start"]
            opened = F.when(hot, F.when(joins, F.struct(last["start"].alias("start"), end.alias("end"))).otherwise(own)).otherwise(last)
            closed = F.when(hot & ~joins & (last["end"] > 0), F.array_append(state["spans"], last)).otherwise(state["spans"])
            return F.struct(
                state["counts"].alias("counts"), state["total"].alias("total"), closed.alias("spans"), opened.alias("open"), state["i"].alias("i")
            )

        none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
            F.lit(0.0).alias("total"),
            F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"),
            none.alias("open"),
            F.lit(-1).alias("i"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(at) - 1),
            start,
            lambda state, i: let(step(state, i), judged),
            lambda state: F.when(state["open"]["end"] > 0, F.array_append(state["spans"], state["open"])).otherwise(state["spans"]),
        )

    characters = F.filter(F.split(candidate, "", -1), lambda c: c != "")
    return let(F.transform(characters, lambda c: F.instr(F.lit(ALPHABET), c) - 1), slide)


def with_spans(docs: DataFrame, text: str = "text", allowed: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``entropy_spans``, arrays of ``kind``, ``start``
    and ``end`` (code points, end exclusive) in order; columns of these names are
    replaced. Null and empty texts have none; rows are judged each."""
    names = [c for c in docs.columns if c.lower() not in ("base_spans", "entropy_spans")]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def kept(kind: str) -> Column:
        pattern, group, least = PATTERNS[kind]
        found = F.filter(find_all(F.col("text"), pattern, group), lambda m: F.char_length(m["part"]) >= least)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(place[kind]).alias("place"), m["end"].alias("end")))

    kinds = [*PATTERNS, ENTROPY]
    place = {kind: i for i, kind in enumerate(kinds)}
    allow = [F.lit(p) for p in (ALLOWED if allowed is None else allowed)]

    def is_allowed(value: Column) -> Column:
        matches = F.lit(False)
        for pattern in allow:
            matches = matches | F.regexp_like(value, pattern)
        return matches

    def entropic(candidates: Column) -> Column:
        spans = F.transform(
            F.filter(candidates, lambda m: ~is_allowed(m["value"])),
            lambda m: F.transform(
                hot_windows(m["value"]),
                lambda s: F.struct(
                    (m["start"] + s["start"]).alias("start"), F.lit(place[ENTROPY]).alias("place"), (m["start"] + s["end"]).alias("end")
                ),
            ),
        )
        return F.flatten(spans)

    def named(spans: Column) -> Column:
        names = F.array(*map(F.lit, kinds))
        return F.transform(spans, lambda s: F.struct(F.get(names, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = packed.withColumn("base", F.sort_array(F.concat(*(kept(kind) for kind in PATTERNS))))
    found = base.withColumn("found", entropic(find_all(F.col("text"), CANDIDATE)))
    free = F.filter(
        "found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    return found.select("row.*", named(F.col("base")).alias("base_spans"), named(free).alias("entropy_spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Secrets of all documents; null and empty texts have none."""
    docs = documents(spark, sf_dir) if docs is None else docs
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_spans(slim).select("doc_id", "base_spans", "entropy_spans")
    place = F.array(*map(F.lit, [*PATTERNS, ENTROPY]))
    ordered = F.transform(
        F.sort_array(
            F.transform(
                F.concat("base_spans", "entropy_spans"),
                lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end")),
            )
        ),
        lambda s: F.struct(F.element_at(place, s["place"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )

    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, PATTERNS),
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
        written(ordered).alias("spans"),
    )
