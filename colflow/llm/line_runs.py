"""Line deduplication over levelled sorted runs of line hashes.

The state is a set of runs, each a table sorted by line key with the number of
documents that hold it. A batch of documents anti-joins the keys that the runs
already know as frequent and adds the rest as a run of its own; when a level has
``fan_in`` runs they are merged into one sorted run of the next level. All runs
are dealt by the same hash, so joins and merges shuffle no text, only keys.
DataFrame functions only.

Keys are the MD5 of the line, stripped of white space at both ends and with A-Z
lower-cased.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.llm.common import SPACE, document_rows, documents, fold
from colflow.session import materialize


def line_keys(text: Column) -> Column:
    """One key per line of ``text``; null for lines that strip to nothing."""

    def key(line: Column) -> Column:
        bare = F.trim(line, F.lit(SPACE))
        return F.when(bare != "", F.unhex(F.md5(bare)))

    return F.transform(F.split(fold(F.coalesce(text, F.lit(""))), "\n", -1), key)


class LineRuns:
    """Levelled sorted runs; ``min_docs`` is the number of documents that makes a
    line frequent."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 2):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _store(self, counts: DataFrame) -> DataFrame:
        # the aggregation has dealt the rows by key; only the order is added
        return materialize(counts.sortWithinPartitions("line_key"), "line-run")

    def totals(self) -> DataFrame | None:
        if not self.runs():
            return None
        merged = reduce(DataFrame.unionByName, self.runs())
        return merged.groupBy("line_key").agg(F.sum("n_docs").alias("n_docs"))

    def frequent(self) -> DataFrame | None:
        totals = self.totals()
        return None if totals is None else totals.filter(F.col("n_docs") >= self.min_docs).select("line_key")

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: ``line_key``, once for each document that holds it. Keys
        that are frequent already are settled and not stored again."""
        counts = keys.groupBy("line_key").agg(F.count("*").alias("n_docs"))
        known = self.frequent()
        if known is not None:
            counts = counts.join(known, "line_key", "left_anti")
        self.levels[0].append(self._store(counts))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = reduce(DataFrame.unionByName, self.levels[level])
        merged = merged.groupBy("line_key").agg(F.sum("n_docs").alias("n_docs"))
        self.levels[level] = []
        self.levels[level + 1].append(self._store(merged))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` freed of the lines whose key stands in ``min_docs``
    documents or more, and with ``n_lines`` and ``n_dropped`` (replaced if present).
    Without ``counts`` the columns are those of ``docs``, in their order.

    A null or empty text is one empty line and comes out empty; empty lines are
    never dropped. A line repeated in one document counts that document once and
    goes with all its places. Rows with the same id are documents of their own.
    The documents arrive in ``batches`` batches by a hash of id and text; their
    number changes the runs, not the result.
    """
    spark = docs.sparkSession
    # rows of one id and one text lose the same lines, so the pair names them
    named = document_rows(docs)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = materialize(
        named.select(
            "doc_id",
            "text_key",
            F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)).cast("int").alias("batch"),
            line_keys(text).alias("keys"),
        ),
        "line-keys",
    )
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        own = keyed.filter(F.col("batch") == batch)
        runs.add(own.select(F.explode(F.array_distinct("keys")).alias("line_key")).filter("line_key is not null"))
    frequent = materialize(runs.frequent(), "frequent-lines")
    places = keyed.select("doc_id", "text_key", F.posexplode("keys").alias("pos", "line_key")).filter("line_key is not null")
    hits = places.join(frequent, "line_key", "left_semi")
    gone = hits.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(
        F.sort_array(F.collect_set("pos")).alias("gone")
    )
    same = named["doc_id"].eqNullSafe(gone["gone_id"]) & (named["text_key"] == gone["gone_key"])

    # the stretches between dropped lines, so long texts stay linear
    def stretch(end: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("gone"), i - 1) + 1)
        return F.slice("lines", start + 1, end - start)

    kept = F.when(F.col("gone").isNull(), text).otherwise(
        F.array_join(F.flatten(F.transform(F.col("ends"), stretch)), "\n")
    )
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {next(c for c in docs.columns if c.lower() == "text"): kept}
    joined = (
        named.join(gone, same, "left")
        .select("row", "gone", F.split(text, "\n", -1).alias("lines"))
        .withColumn("ends", F.array_append("gone", F.size("lines")))
    )
    if not counts:
        return joined.select(*(value.alias(c) for c, value in own.items()))
    return joined.select(
        *(value.alias(c) for c, value in own.items() if c.lower() not in ("text", "n_lines", "n_dropped")),
        kept.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = documents(spark, sf_dir) if docs is None else docs
    kept = drop_frequent_lines(docs.select("doc_id", "text"))
    return kept.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def oracle_sql(min_docs: int = 10) -> str:
    """The query for another engine: lines as rows, grouped by their whole key."""
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (
  select rid, doc_id, line, pos, translate(trim(line, {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select rid, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos
        from (select rid, doc_id, string_split(text, chr(10)) as ls from d))),
often as (select key from l where key <> '' group by key having count(distinct rid) >= {min_docs}),
marked as (select l.*, l.key in (select key from often) as gone from l)
select cast(any_value(doc_id) as bigint) as doc_id, count(*) as n_lines, cast(count_if(gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by rid"""
