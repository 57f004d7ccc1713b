"""Quality rules whose cutoffs are chosen with a guarantee from labelled documents.

Each rule rejects documents whose share of something bad exceeds a cutoff. Within
each stratum (language) a rule walks its grid from the most lenient cutoff to the
strictest. A cutoff is accepted if the labelled good documents prove that it
rejects at most ``RISK`` of the good ones: the exact binomial probability of so few
false rejections, were the true rate ``RISK``, must not exceed the error level. The
walk ends at the first cutoff that fails, so a walk needs no correction for its
many cutoffs (fixed-sequence testing); the walks share the error level evenly
(Bonferroni), so with probability ``CONFIDENCE`` all accepted cutoffs hold, and a
stratum loses at most ``RISK`` times the number of rules of its good documents. A
stratum with too few labels proves nothing and rejects nothing.

The labelled documents only test cutoffs that were fixed before, so all of them are
the holdout. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import SPACE, document_rows, documents, let, rows_without, words
from colflow.session import materialize

#: share of a stratum's good documents that one rule may reject
RISK = 0.01
CONFIDENCE = 0.95
#: rules, each a share in per cent, and its cutoffs from lenient to strict
RULES = {
    "symbols": ("n_symbols", "word_chars", [50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1]),
    "dup_lines": ("n_dup_lines", "n_lines", [90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10, 5]),
    "repeats": ("n_repeat_words", "n_words", [50, 45, 40, 35, 30, 25, 20, 15, 10, 5]),
    "capitals": ("n_capitals", "word_chars", [90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10]),
}
# fixed values of the base rule
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: repeated windows up to which places are found by looking each window up among
#: them; with more, by sorting (the same places, another way)
LOOK_UP = 64


def repeated_words(ws: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more among ``ws``.

    Windows are compared by 64-bit hash within their text."""
    n = F.size(ws)

    def places(grams: Column) -> Column:
        last = F.size(grams) - 1

        def by_look_up(twice: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), last), lambda i: F.array_contains(twice, F.get(grams, i)))

        def by_sorting() -> Column:
            def shared(s: Column) -> Column:
                same = lambda i, j: F.get(s, i)["x"] == F.get(s, j)["x"]
                hit = F.filter(
                    F.sequence(F.lit(0), last),
                    lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
                )
                return F.sort_array(F.transform(hit, lambda i: F.get(s, i)["i"]))

            return let(F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), shared)

        def repeated(s: Column) -> Column:
            twice = F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1)))
            choose = lambda t: F.when(F.size(t) == 0, F.array().cast("array<int>")).when(
                F.size(t) <= LOOK_UP, by_look_up(t)
            ).otherwise(by_sorting())
            return let(twice, choose)

        return let(F.sort_array(grams), repeated)

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"))
        return F.aggregate(at, zero, step, lambda s: s["n"])

    def grams(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
        )

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    found = let(hashes, lambda h: let(grams(h), lambda g: covered(places(g))))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(found)


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``stratum`` and the counts that
    the rules use."""
    text = F.coalesce("text", F.lit(""))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        n = F.size(lines).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(SPACE)) != "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        let(words(F.col("text")), of_words).alias("w"),
        let(with_word, of_lines).alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    ).select("doc_id", "text_key", "stratum", "w.*", "l.*", "n_symbols", "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _exceeds(rule: str, cutoff: Column | int) -> Column:
    part, whole, _ = RULES[rule]
    return F.lit(100) * F.col(part) > cutoff * F.col(whole)


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(k: Column, n: Column, rate: float, terms: int = 400) -> Column:
    """P(X <= k) for X binomial(n, rate), for k below the mean; 1 otherwise.

    Sums from k downwards, where each term is a growing fraction of the one before.
    Beyond ``terms`` terms the rest is bounded by its geometric series, so the
    result is never too small."""
    k, n = k.cast("double"), n.cast("double")
    ratio = lambda i: i * (1 - rate) / ((n - i + 1) * rate)
    first = F.exp(
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    )
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int") - 1)

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * ratio(k - i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    left = F.greatest(k - terms, F.lit(0.0))
    rest = lambda s: F.when(left > 0, s["term"] * ratio(left) / (1 - ratio(left))).otherwise(0.0)
    total = F.when(k < 1, F.lit(1.0)).otherwise(F.aggregate(steps, zero, step, lambda s: s["sum"] + rest(s)))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(first * total)


def choose_cutoffs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per stratum with an accepted cutoff: that of each rule, or null.

    A document that any label row calls good is good; label rows without a
    document, without id or quality are left out. Documents that the base rule
    rejects are not the cutoffs' to reject and not counted."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("good")).filter("good = 1")
    holdout = features.filter(~base_failed()).join(good, "doc_id")
    def walked(rule: str, grid: list[int]) -> Column:
        cutoffs = F.array(*map(F.lit, grid))
        # a document is rejected from its first exceeded cutoff on
        spared = F.size(F.filter(cutoffs, lambda cutoff: ~_exceeds(rule, cutoff)))
        return F.struct(F.lit(rule).alias("rule"), spared.alias("spared"), cutoffs.alias("grid"))

    walks = F.array(*[walked(rule, grid) for rule, (_, _, grid) in RULES.items()])
    longest = max(len(grid) for _, _, grid in RULES.values())
    rejected = F.array(*[F.count_if(F.col("spared") <= i) for i in range(longest)]).alias("rejected")
    tests = materialize(
        holdout.select("stratum", F.inline(walks))
        .groupBy("stratum", "rule")
        .agg(F.count("*").alias("n"), F.first("grid").alias("grid"), rejected),
        "quality-tests",
    )
    # one walk for each stratum and rule
    level = (1 - CONFIDENCE) / max(1, tests.count())
    steps = tests.select("stratum", "rule", "n", "rejected", F.posexplode("grid").alias("i", "cutoff"))
    steps = steps.withColumn("ok", binomial_tail(F.get("rejected", F.col("i")), F.col("n"), RISK) <= level)
    ends = steps.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("i"))).alias("stop"))
    accepted = steps.join(ends, ["stratum", "rule"]).filter("stop is null or i < stop")
    cut = {rule: F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES}
    return accepted.groupBy("stratum").agg(*cut.values())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id``, the counts, ``base_failed`` and
    ``kept``. A null or empty text has no words and fails the base rule; a null
    language is a stratum of its own; repeated rows are judged each; a document
    row with a label counts each time it stands in the table."""
    features = materialize(with_features(docs), "quality-features")
    # stored: one row per stratum, whose size decides whether it is broadcast
    cutoffs = materialize(choose_cutoffs(features, labels), "quality-cutoffs")
    bad = F.lit(False)
    for rule in RULES:
        bad = bad | F.coalesce(_exceeds(rule, F.col(f"cut_{rule}")), F.lit(False))
    joined = features.join(cutoffs, "stratum", "left").withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, all their columns kept.

    A null or empty text is rejected, as it has too few words; a null language is a
    stratum of its own; a null id has no label but is judged. Rows that repeat id,
    text and language share their verdict. Empty tables stay empty, and without
    labels only the base rule rejects."""
    names = ["doc_id", "text_key", "stratum"]
    gone = materialize(judge(docs, labels).filter("not kept").select(*names).distinct(), "rejected")
    marked = document_rows(docs, stratum=F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return rows_without(marked, gone, names).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    docs = documents(spark, sf_dir) if docs is None else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if labels is None else labels
    judged = judge(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    """The query for another engine: windows as rows, the binomial sum term by term."""

    def over(rule: str, cutoff: str) -> str:
        part, whole, _ = RULES[rule]
        return f"100 * {part} > {cutoff} * {whole}"

    grids = [(rule, i, c) for rule, (_, _, grid) in RULES.items() for i, c in enumerate(grid)]
    tests = " union all ".join(
        f"select stratum, '{rule}' as rule, {i} as i, {c} as cutoff, count(*) as n, count_if({over(rule, str(c))}) as k from holdout group by stratum"
        for rule, i, c in grids
    )
    rejects = " or ".join(
        f"coalesce({over(rule, f'(select min(cutoff) from accepted a where a.stratum = f.stratum and a.rule = {chr(39)}{rule}{chr(39)})')}, false)"
        for rule in RULES
    )
    return f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (
  select rid, unnest(ws) as word, generate_subscripts(ws, 1) as pos
  from (select rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d)),
g as (
  select rid, pos, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as gram
  from w window o as (partition by rid order by pos)),
twice as (select rid, pos from g where gram is not null qualify count(*) over (partition by rid, gram) > 1),
covered as (
  select rid, count(distinct p) as n_repeat_words
  from (select rid, unnest([pos, pos + 1, pos + 2]) as p from twice) group by rid),
l as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
features as (
  select d.rid, cast(doc_id as bigint) as doc_id, stratum, coalesce(n_words, 0) as n_words,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
  from d left join (select rid, count(*) as n_words from w group by rid) using (rid)
  left join covered using (rid) left join l using (rid)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from features),
holdout as (
  select f.* from f join (select doc_id from labels group by doc_id having max(quality) = 1) using (doc_id) where not base_failed),
tests as ({tests}),
strata as (select count(*) as s from (select distinct stratum, rule from tests)),
passed as (
  select tests.*, case when k >= n * {RISK} then 1.0 else list_sum([
      exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))
      for i in range(0, cast(k as bigint) + 1)]) end <= {1 - CONFIDENCE} / greatest(s, 1) as ok
  from tests, strata),
accepted as (
  select * from passed p where ok and not exists (
    select 1 from passed q where q.stratum = p.stratum and q.rule = p.rule and q.i < p.i and not q.ok))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and not ({rejects}) as kept
from f"""
