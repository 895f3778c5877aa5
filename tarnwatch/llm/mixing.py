"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Words are counted once per document. Targets of the sources follow from that in closed form; blocks of equal length are
then allocated to the sources by highest quotients (target / 1, / 3, / 5, ...), and the blocks of a source in the same way
to its shards, so every shard gets an integer quota. Inside a shard the documents form one stream of words in a seeded
order; its quota takes whole passes over the stream and then the leading blocks.

Defined results: a null text has 0 words; a null source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives no rows; a source without words has target and taken 0. The order is by hash of seed and
doc_id, so reruns and other partitionings take the same words. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwatch.plans.freeze import freeze

WORD = r"[^\x20\x09-\x0D]+"


def apportion(votes: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Quota of each row of `votes` (columns votes double, seats long, equal within `by`): Sainte-Lague's highest quotients.

    With n rows and V votes, the seats' divisor keeps V / divisor within n / 2 of the seats. So each row's quota is known
    up to about n * votes / V + 2 seats, and only these, 4 n rows in all, are ranked by quotient.
    Ties go to the earlier row in `order`. Rows without votes get none.
    """
    group = Window.partitionBy(*by)
    rows = (votes.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_sum", F.sum("votes").over(group))
            .withColumn("_rank", F.row_number().over(group.orderBy(*order))))
    share = F.col("votes") / F.col("_sum")
    sure = F.greatest(F.lit(0), F.ceil(share * (F.col("seats") - F.col("_n") / 2) - 0.5) - 1)
    most = F.floor(share * (F.col("seats") + F.col("_n") / 2) + 0.5) + 1
    rows = rows.withColumn("_sure", F.when(F.col("votes") > 0, sure).otherwise(0).cast("long"))
    rows = rows.withColumn("_most", F.when(F.col("votes") > 0, most).otherwise(0).cast("long"))
    rows = rows.withColumn("_left", F.col("seats") - F.sum("_sure").over(group))
    tried = F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    seats = rows.withColumn("_seat", F.explode_outer(tried))
    quotient = F.col("votes") / (2 * F.col("_seat") + 1)
    won = F.row_number().over(group.orderBy(quotient.desc_nulls_last(), "_rank", "_seat")) <= F.col("_left")
    return (seats.withColumn("_won", (won & F.col("_seat").isNotNull()).cast("long"))
            .groupBy(*by, "_rank").agg(
                *[F.first(c).alias(c) for c in votes.columns if c not in by],
                (F.first("_sure") + F.sum("_won")).alias("quota"))
            .drop("_rank"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds weight and target to (source, source_size): `share` of all words dealt by weight; a target stops at `most`
    times its source, and what is above goes to the others by weight until none is above.

    Sources in order of most * size / weight: those that stop are the first ones, and each is judged on what is left when
    all before it have stopped. The windows hold one row per source.
    """
    everything = Window.partitionBy()
    rows = sources.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    rows = rows.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_k") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * float(most))
    before = Window.orderBy(F.col("_cap") / F.col("weight"), "_k").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("_level", level)
    free = F.col("_cap") > F.col("weight") * F.col("_level")
    rows = rows.withColumn("_free", F.min(F.when(free, F.struct(
        (F.col("_cap") / F.col("weight")).alias("ratio"), F.col("_k").alias("k"), F.col("_level").alias("level")))).over(everything))
    stops = F.col("_free").isNull() | (
        F.struct((F.col("_cap") / F.col("weight")).alias("ratio"), F.col("_k").alias("k"))
        < F.struct(F.col("_free.ratio").alias("ratio"), F.col("_free.k").alias("k")))
    return rows.withColumn("target", F.when(stops, F.col("_cap")).otherwise(F.col("weight") * F.col("_free.level"))).drop(
        "_cap", "_level", "_free")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64,
        shard_docs: int = 4096, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shard, shard_quota (in blocks of `block` words).

    A source has one shard per `shard_docs` documents, so a hot source is dealt to many tasks. taken differs from the
    target by about half a block per source, and by less than a block in shards that are taken whole.
    """
    sized = freeze(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = freeze(targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")),
        weights, share, most), "targets")
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    quotas = apportion(sources.withColumn("seats", seats).withColumn("votes", F.col("target")).withColumn("_all", F.lit(1)),
                       ["_all"], [F.col("_k")])
    quotas = freeze(quotas.select(
        "source", "source_size", "target", F.col("quota").alias("seats"),
        F.ceil(F.col("_docs") / shard_docs).cast("long").alias("_shards")), "quotas")

    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = sized.withColumn("_draw", draw).join(
        quotas.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    shards = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("_words"), F.first("seats").alias("seats"))
    shards = apportion(shards.withColumn("votes", F.col("_words").cast("double")), ["source"], [F.col("shard")])
    shards = freeze(shards.select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "_words", F.col("quota").alias("shard_quota")), "shards")

    stream = Window.partitionBy("source", "shard").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    rows = rows.withColumn("_from", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    words = F.least(F.col("shard_quota") * block, F.floor(F.col("_words") * float(most))).cast("long")
    rows = rows.withColumn("_take", words).withColumn(
        "_passes", F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0).cast("long"))
    part = F.col("_take") - F.col("_passes") * F.col("_words")
    taken = F.col("_passes") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), part - F.col("_from")))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", "shard_quota")


def _seats_sql(name: str, rows: str, by: str, order: str, keep: str) -> str:
    over = f"OVER (PARTITION BY {by})"
    return f"""
{name}_a AS (SELECT *, count(*) {over} AS n_, sum(votes) {over} AS v_, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank_
  FROM {rows}),
{name}_b AS (SELECT *, CASE WHEN votes > 0 THEN CAST(greatest(0, ceil(votes / v_ * (seats - n_ / 2) - 0.5e0) - 1) AS BIGINT) ELSE 0 END AS sure_,
  CASE WHEN votes > 0 THEN CAST(floor(votes / v_ * (seats + n_ / 2) + 0.5e0) + 1 AS BIGINT) ELSE 0 END AS most_ FROM {name}_a),
{name}_c AS (SELECT *, seats - sum(sure_) {over} AS left_ FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(sure_, most_)) AS seat_ FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY votes / (2 * seat_ + 1) DESC, rank_, seat_) <= left_ AS won_ FROM {name}_d),
{name}_f AS (SELECT {by} AS by_, rank_, count(*) FILTER (won_) AS extra_ FROM {name}_e GROUP BY ALL),
{name} AS (SELECT {keep}, CAST(c.sure_ + coalesce(f.extra_, 0) AS BIGINT) AS quota FROM {name}_c c
  LEFT JOIN {name}_f f ON f.by_ IS NOT DISTINCT FROM c.{by} AND f.rank_ = c.rank_)"""


def mix_sql(documents: str = "documents", block: int = 64, shard_docs: int = 4096, seed: str = "mix") -> str:
    """The same allocation in DuckDB's SQL, for the weights 3, 1, 2, a share of 1.5 and at most 2 times."""
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM {documents}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s0),
s2 AS (SELECT *, [3e0, 1e0, 2e0][CAST((k - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 2e0 AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER w, 0e0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0e0)) AS level
  FROM s2 WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT cap / weight AS ratio, k, level FROM s3 WHERE cap > weight * level ORDER BY 1, 2 LIMIT 1),
s4 AS (SELECT s3.source, s3.source_size, s3.docs, s3.k, 1 AS one, CASE WHEN free.k IS NULL OR (s3.cap / s3.weight, s3.k) < (free.ratio, free.k)
    THEN s3.cap ELSE s3.weight * free.level END AS target FROM s3 LEFT JOIN free ON true),
s5 AS (SELECT *, target AS votes, CAST(round(sum(target) OVER () / {block}) AS BIGINT) AS seats FROM s4),
{_seats_sql("sources", "s5", "one", "k", "c.source, c.source_size, c.target, c.docs")},
dealt AS (SELECT d.*, q.source_size, q.target, q.quota,
    CAST('0x' || substr(draw, 1, 8) AS BIGINT) % CAST(ceil(q.docs / {shard_docs}) AS BIGINT) AS shard
  FROM sized d JOIN sources q ON d.source IS NOT DISTINCT FROM q.source),
t0 AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, sum(size) + 0e0 AS votes, any_value(quota) AS seats
  FROM dealt GROUP BY source, shard),
{_seats_sql("shards", "t0", "source", "shard", "c.source, c.shard, c.words")},
placed AS (SELECT d.*, t.words, t.quota AS shard_quota, least(t.quota * {block}, words * 2) AS take,
    coalesce(sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY draw, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM dealt d JOIN shards t ON d.source IS NOT DISTINCT FROM t.source AND d.shard = t.shard),
passes AS (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes FROM placed)
SELECT doc_id, size, source_size, target, CAST(passes * size + least(size, greatest(0, take - passes * words - start)) AS BIGINT) AS taken,
  shard, shard_quota FROM passes"""
