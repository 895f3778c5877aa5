"""Line dedup over levelled sorted runs of line hashes.

Lines long enough to count are hashed once (128 bits) into a written table, cut into batches of documents from the largest
doc_id down. Each batch is reduced to (line, number of documents, largest document) and merge-anti-joined with the runs
that stand: what they don't hold is fresh in the batch's own run, what they hold is a tally there. Runs are tables bucketed
and sorted by hash, so these joins move no run; when a level holds `fanout` runs, they are merged into one of the next
level and the old ones dropped. After the last batch one merge gives the lines to drop.

Defined results: a null or empty text is one empty line; rows of one doc_id are one document (each row keeps its own text);
a null doc_id is a document before all others; a line that repeats in a document counts once, but is dropped wherever it
stands; texts without \\n, very long lines and an empty table are no special cases. Other columns are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnwatch.llm.exprs import LOWER, UPPER, WHITE, ascii_lower, partitions
from tarnwatch.plans.freeze import freeze

FIRST = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


class Runs:
    """Sorted runs of (h1, h2, docs, top, fresh), in levels. A line is fresh in one run only; where it comes again it is a tally."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .format("parquet").saveAsTable(name))
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one, by merge joins of sorted buckets."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            both = out.join(self.spark.table(name).select("h1", "h2", *[F.col(c).alias(f"_{c}") for c in ("docs", "top", "fresh")]),
                            ["h1", "h2"], "full_outer")
            own, other = F.coalesce("fresh", F.lit(False)), F.coalesce("_fresh", F.lit(False))
            out = both.select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"),
                              F.when(own, F.col("top")).when(other, F.col("_top")).alias("top"), (own | other).alias("fresh"))
        return out

    def add(self, batch: DataFrame) -> None:
        """Lines that no run holds go into the new run as fresh, the others as tallies."""
        self._compact()
        for level in self.levels:
            for name in level:
                held = self.spark.table(name).where("fresh").select("h1", "h2", F.lit(True).alias("held"))
                batch = batch.join(held, ["h1", "h2"], "left").withColumn(
                    "seen", F.coalesce("seen", F.lit(False)) | F.coalesce("held", F.lit(False))).drop("held")
        self.levels[0].append(self._write(batch.select("h1", "h2", "docs", "top", (~F.col("seen")).alias("fresh"))))

    def _compact(self) -> None:
        """Merges full levels; in a merged run a line is fresh if it was in one of its runs, else still a tally."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(level)))
                for name in level:
                    self.spark.sql(f"DROP TABLE {name}")
                level.clear()

    def frequent(self, least: int) -> DataFrame:
        """(h1, h2, top) of the lines found in `least` documents; frees the runs."""
        names = [name for level in self.levels for name in level]
        out = freeze(self._merged(names).where(F.col("docs") >= least).select("h1", "h2", "top"), "frequent_lines")
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        return out


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """All columns of docs with `text` as it stays, and n_lines, n_dropped.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of `least_chars` characters
    found in `least_docs` documents lose their lines in all but the largest document that holds them.
    Columns of docs named n_lines or n_dropped give way to those; all others are kept, whatever their names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    aside = "_" * (1 + max(map(len, docs.columns)))
    own_names = {c: f"{aside}{k}" for k, c in enumerate(docs.columns) if c.lower() in ("_doc", "_row", "_gone", "_lines")}
    if own_names:
        kept = dedup_lines(docs.withColumnsRenamed(own_names), least_chars, least_docs, batches, fanout)
        return kept.withColumnsRenamed({v: k for k, v in own_names.items()})
    spark = docs.sparkSession
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    ids = [F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("_doc"), F.xxhash64("text").alias("_row")]
    cuts = docs.agg(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)),
                                        [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = sum([(F.col("_doc") < F.lit(cut)).cast("int") for cut in cuts or []], F.lit(0))
    key = line_key(F.col("_line"))
    found = (docs.select(*ids, F.posexplode(lines).alias("_pos", "_line"))
             .where(F.char_length("_line") >= least_chars)
             .select("_doc", "_row", "_pos", key.alias("_key")).where(F.char_length("_key") >= least_chars)
             .select("_doc", "_row", "_pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(7), "_key").alias("h2"),
                     batch.alias("_batch")))
    found = freeze(found, "lines")
    runs = Runs(spark, fanout)
    for k in range(batches):
        own = found.where(F.col("_batch") == k).select("h1", "h2", "_doc").distinct()
        runs.add(own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("_doc").alias("top"))
                 .withColumn("seen", F.lit(False)))
    drop = runs.frequent(least_docs)
    gone = (found.join(drop, ["h1", "h2"]).where("_doc <> top").groupBy("_doc", "_row").agg(
        F.collect_set("_pos").alias("_gone")))
    columns = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.withColumns({"_doc": ids[0], "_row": ids[1]}).join(gone.hint("shuffle_hash"), ["_doc", "_row"], "left")
    rows = rows.withColumn("_lines", lines)
    n = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda p: F.col("_lines")[p]), "\n"))
    return rows.select(*columns, kept.alias("text"), n.cast("long").alias("n_lines"),
                       F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))


LINES_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
