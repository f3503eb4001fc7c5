"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations alone.

Every document gets a virtual finish time: the tokens of its source up to and including it, in shuffled order,
divided by the source's weight. Taking documents in order of that time until the budget is spent serves the
sources in proportion to their weights; a source whose ``max_epochs`` passes are used up leaves its share to
the others, as water-filling does. Times are exact integers (tokens times lcm of the weights / weight).

The running total of a source is built in two levels: sums of ranges of its shuffled documents, then a
running total within a range; so a source that holds a third of all rows is spread over many tasks. The order
of all finish times is resolved by ranges as well: token sums per range, twice refined, find the range that
holds the cut, and only its rows are sorted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ranges of finish times per level of refinement.
RANGES = 4096


def size_of(text: str) -> Column:
    """Words of a text: runs of characters other than space and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """source, source_size -> weight and target, in code-point order of the sources, null last.

    A target is its weight's share of all sizes, at most max_epochs times the source's size; what is cut off is
    shared by weight among the rest until none is above. With the sources in order of size / weight, the share
    per weight is settled at the first source that it does not fill. One task orders the sources, a row each: they
    are to be thousands or millions, not as many as documents.
    """
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))].cast("long"))
    fill = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    steps = ranked.withColumn("level", level).withColumn("settled", F.col("level") * F.col("weight") <= cap)
    share = F.min(F.when(F.col("settled"), F.struct(cap / F.col("weight"), F.col("level")))).over(whole)["level"]
    return steps.select("source", "source_size", "weight", F.coalesce(F.least(share * F.col("weight"), cap.cast("double")), cap.cast("double")).alias("target"))


def _cut(times: DataFrame, budget: int, low: int, high: int):
    """Largest finish time (of rows finish, size, each with all of equal time) whose running total is within the budget."""
    while True:
        width = max(1, -(-(high - low) // RANGES))
        ranged = times.where((F.col("finish") > low) & (F.col("finish") <= high)).groupBy(F.floor((F.col("finish") - low - 1) / width).cast("long").alias("r")).agg(F.sum("size").alias("size"))
        total = ranged.withColumn("upto", F.sum("size").over(Window.orderBy("r")))  # RANGES rows at most
        over = total.where(F.col("upto") > budget).orderBy("r").first()
        if over is None:
            return high
        low, high, budget = low + over["r"] * width, min(high, low + (over["r"] + 1) * width), budget - (over["upto"] - over["size"])
        if width == 1:
            return low


def mixed(docs: DataFrame, weights: list[int] | None = None, max_epochs: int = 3, budget_share: float = 1.0, seed: int = 11, text: str = "text", id_col: str = "doc_id", source: str = "source", carry: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken per document; taken is a multiple of size, at most max_epochs.

    Null texts and texts without words have size 0 and are never taken. Null sources are one source, the last.
    Rows that repeat id and text share a place in the shuffled order and finish together. An empty table gives no rows; other columns are not read. The order depends on seed, id and text
    alone, so reruns agree whatever the partitioning.
    """
    spark = docs.sparkSession
    weights = weights or [1, 2, 3]
    base = common.saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit(""))).cast("binary")).alias("key"), *([carry] if carry else [])), "sizes")
    count = base.count()
    lcm = reduce(math.lcm, weights, 1)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = common.saved(source_targets(sizes, weights, max_epochs), "targets")
    totals = targets.agg(F.sum("source_size"), F.max(F.col("source_size") * max_epochs * (F.lit(lcm) / F.col("weight")).cast("long")), F.count("*")).first()
    budget, top = int((totals[0] or 0) * budget_share), int(totals[1] or 0)

    # Buckets of the shuffled order by the key's first hex digits: 20,000 rows each at most on average.
    digits = max(2, math.ceil(math.log(count / 20_000 + 1, 16)))
    dealt = base.withColumn("bucket", F.substring("key", 1, digits))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    starts = sums.withColumn("start", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held")).drop("held")
    inner = Window.partitionBy("source", "bucket").orderBy(F.struct("key", "doc_id"))
    upto = dealt.withColumn("upto", F.sum("size").over(inner))
    a, b, t = upto.alias("a"), starts.alias("b"), targets.alias("t")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))).join(t, F.col("a.source").eqNullSafe(F.col("t.source")))
    rate = (F.lit(lcm) / F.col("t.weight")).cast("long")
    timed = common.saved(
        joined.select(*([f"a.{carry}"] if carry else []), "a.doc_id", "a.source", "a.size", "t.source_size", "t.target", ((F.col("b.start") + F.col("a.upto")) * rate).alias("first"), (F.col("t.source_size") * rate).alias("round")), "finish"
    )
    passes = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    times = timed.where("size > 0").select("size", F.explode(passes).alias("pass"), "first", "round").select("size", (F.col("first") + F.col("pass") * F.col("round")).alias("finish"))
    cut = _cut(times, budget, 0, top)
    taken = sum(((F.col("first") + F.lit(k) * F.col("round")) <= cut).cast("long") for k in range(max_epochs))
    return timed.select(*([carry] if carry else []), "doc_id", "source", "size", "source_size", "target", (F.col("size") * taken).alias("taken"))


def repeated(docs: DataFrame, weights: list[int] | None = None, max_epochs: int = 3, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as the mix takes it.

    The finish times of a source need no text, so only the cut is looked up: by a digest of (id, source, text), nulls
    told from empty values, a row finds how many passes take it. Rows that repeat all three are taken equally often.
    Other columns may have any names.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    key, times, turn = (common.fresh(docs.columns, name) for name in ("_key", "_times", "_pass"))
    keyed = docs.withColumn(key, F.md5(F.concat(part(id_col), part(source), part(text)).cast("binary")))
    plan = mixed(keyed, weights, max_epochs, text=text, id_col=id_col, source=source, carry=key)
    taken = plan.where("taken > 0").select(key, (F.col("taken") / F.col("size")).cast("int").alias(times)).dropDuplicates([key])
    return keyed.join(taken, key).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents")).drop("source")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(concat_ws('|', '11', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
steps AS (SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT arg_min(level, cap / weight) AS share FROM steps WHERE level * weight <= cap),
t AS (SELECT source, source_size, weight, coalesce(least(share * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM steps, share),
f AS (SELECT d.*, t.source_size, t.target, (6 // t.weight) * t.source_size AS round,
    (6 // t.weight) * sum(size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) AS first FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
times AS (SELECT size, first + k * round AS finish FROM f, range(3) r(k) WHERE size > 0),
cut AS (SELECT coalesce(max(finish), 0) AS cut FROM (SELECT finish, sum(size) OVER (ORDER BY finish) AS upto FROM times) WHERE upto <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target,
       CAST(size * ((first <= cut)::INT + (first + round <= cut)::INT + (first + 2 * round <= cut)::INT) AS BIGINT) AS taken
FROM f, cut
"""
