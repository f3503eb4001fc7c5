"""Chat formatting after a collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time with more turns. Every turn gets a rolling hash of the
turns so far; a conversation is dropped if its last hash is a prefix hash of a longer one, or if an equal
conversation has a smaller id. Those that are left are rendered with a turn template.

Rolling hashes are running exclusive-ors of two 60-bit hashes of (position, role, text), so that a conversation
may be cut anywhere: turns are range-sorted over all tasks, each piece of a conversation is numbered and hashed
where it lies, and the pieces' totals, one row per piece, are carried over. No task needs all turns of one
conversation. Equal prefixes are collapsed before the anti-join, so a common opening is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns that are joined to one text at once; the texts of a longer conversation are joined in a second step.
TURNS = 256


def _hash(text, at: int):
    return F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("long")


def _content(role: str, text: str):
    """A string that differs for different (role, text), nulls included."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.md5(F.concat(part(role), part(text)).cast("binary"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, content -> also piece, pos (from 1) and a, b: the rolling hashes up to this turn."""
    spark = turns.sparkSession
    ranged = turns.repartitionByRange(common.partitions(spark, turns), "conv_id", "turn", "content").withColumn("piece", F.spark_partition_id())
    ranged = common.saved(ranged, "turns")  # the pieces are fixed from here on
    here = Window.partitionBy("piece", "conv_id").orderBy("turn", "content")
    local = ranged.withColumn("local", F.row_number().over(here))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    sizes = ranged.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    # Only conversations that go on from an earlier piece have a row here: fewer than there are pieces.
    starts = sizes.withColumn("start", F.sum("n").over(before)).where("start > 0").drop("n")
    join = lambda rows, more: rows.alias("r").join(F.broadcast(more.alias("m")), F.col("r.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("r.piece") == F.col("m.piece")), "left")
    placed = join(local, starts).select("r.*", (F.col("local") + F.coalesce("start", F.lit(0))).alias("pos")).drop("local")
    told = F.concat_ws("|", "pos", "content").cast("binary")
    placed = common.saved(placed.withColumn("a", _hash(told, 1)).withColumn("b", _hash(told, 16)), "placed")
    sums = placed.groupBy("conv_id", "piece").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    carried = sums.withColumn("ca", F.bit_xor("xa").over(before)).withColumn("cb", F.bit_xor("xb").over(before)).where(F.col("ca").isNotNull()).drop("xa", "xb")
    rolling = placed.withColumn("a", F.bit_xor("a").over(here)).withColumn("b", F.bit_xor("b").over(here))
    return join(rolling, carried).select(
        "r.conv_id", "r.turn", "r.content", "r.piece", "r.pos",
        F.col("r.a").bitwiseXOR(F.coalesce("ca", F.lit(0))).alias("a"), F.col("r.b").bitwiseXOR(F.coalesce("cb", F.lit(0))).alias("b"),
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n, copies of the conversations that no longer one starts with; of equal ones the smallest id."""
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("e")).select("conv_id", F.col("e.pos").alias("pos"), F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    one = ends.groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    x, y = rolled.alias("x"), ends.select("conv_id", F.col("pos").alias("n")).alias("y")
    # A proper prefix: a turn before the last one. lead() over pieces isn't needed, as ends tell each length.
    return one.join(_proper(x, y), ["pos", "a", "b"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def _proper(x: DataFrame, y: DataFrame) -> DataFrame:
    last = y.select(F.col("y.conv_id").alias("c"), F.col("n"))
    return x.join(last, F.col("x.conv_id").eqNullSafe(F.col("c")) & (F.col("x.pos") == F.col("n")), "left_anti").select("pos", "a", "b").distinct()


def chat_format(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, copies, text: a row for each maximal conversation, with its whole rendering.

    A turn is rendered as start + role + newline + text + end + newline. copies counts the equal conversations a row
    stands for. Turns are ordered by turn (null first), then by a hash of role and text. Rows that repeat
    conversation, turn, role and text are one turn. Null roles and texts render as empty but differ from empty ones.
    A null conv_id is one conversation, and stays only if no other is equal. An empty table gives no rows; other
    columns are not read. Parts of TURNS turns are rendered in tasks of their own, so what meets in one task is a
    conversation's text, which as one value has to fit in a task anyway (2 GB is Spark's limit for a string).
    """
    rows = conversations.select("conv_id", "turn", "role", "text", _content("role", "text").alias("content"))
    rolled = common.saved(numbered(rows.select("conv_id", "turn", "content").distinct()), "rolled")
    kept = common.saved(maximal(rolled), "maximal")
    # By (conversation, piece): a piece is at most a task's share of the sorted turns, however long the conversation.
    k = rolled.select("conv_id", "piece").distinct().alias("p").join(kept.alias("k"), F.col("p.conv_id").eqNullSafe(F.col("k.conv_id"))).select("p.conv_id", "p.piece", "n_turns", "copies").alias("k")
    r = rolled.alias("r")
    chosen = r.join(k, F.col("r.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("r.piece") == F.col("k.piece"))).select("r.conv_id", "r.turn", "r.content", "r.pos", "n_turns", "copies").alias("c")
    t = rows.alias("t")
    same = F.col("c.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("c.turn").eqNullSafe(F.col("t.turn")) & (F.col("c.content") == F.col("t.content"))
    said = F.concat(F.lit(start), F.coalesce("t.role", F.lit("")), F.lit("\n"), F.coalesce("t.text", F.lit("")), F.lit(end + "\n"))
    lines = chosen.join(t, same).select("c.conv_id", F.floor((F.col("pos") - 1) / TURNS).cast("long").alias("part"), "pos", "n_turns", "copies", said.alias("said"))
    parts = lines.groupBy("conv_id", "part", "n_turns", "copies").agg(F.sort_array(F.collect_set(F.struct("pos", "said"))).alias("lines")).withColumn("text", F.concat_ws("", F.col("lines.said"))).drop("lines")
    whole = parts.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts"))
    return whole.select("conv_id", F.col("n_turns").cast("long"), "copies", F.concat_ws("", F.col("parts.text")).alias("text"))


def op1_chat(spark, sf_dir: str) -> DataFrame:
    return chat_format(common.table(spark, sf_dir, "conversations"))


ORACLE = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text,
    md5(coalesce('=' || length(role) || ':' || role, '-') || coalesce('=' || length(text) || ':' || text, '-')) AS content FROM conversations),
c AS (SELECT conv_id, list(content ORDER BY turn NULLS FIRST, content) AS l,
             list('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) ORDER BY turn NULLS FIRST, content) AS said FROM rows GROUP BY conv_id),
one AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies, any_value(said) AS said FROM c GROUP BY l),
prefixes AS (SELECT DISTINCT l[:n] AS l FROM (SELECT l, unnest(range(1, len(l))) AS n FROM c)),
kept AS (SELECT * FROM one WHERE l NOT IN (SELECT l FROM prefixes))
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, copies, array_to_string(said, '') AS text FROM kept
"""
