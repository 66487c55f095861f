"""Merkle manifest of a table: a proof for every row against one root digest.

A row's fields make its leaf. Per group (a document's source) leaves ascend by the order column; every three
consecutive nodes become their digest, level by level, until one is left, the group's subroot. Subroots, ordered by
group, give the root the same way.

1. Places: rows are range-partitioned by (group, order, leaf) and numbered where they lie; counts per (partition, group)
   turn these numbers into places within the group, so a hot group is spread over many tasks.
2. Levels: places are cut into aligned blocks of ``3 ** levels`` rows. Inside a block, level ``l`` is a window over the
   block's rows with lag and lead columns of the fixed offsets ``3 ** l`` and ``2 * 3 ** l``. Masked by slot and
   run length they are the siblings of the node that begins at this row, and the row of a run's first child hashes the
   parent. All windows share one partitioning and order: one shuffle and one sort for all levels.
3. A running last value hands the siblings of every ancestor to the rows below it. The tops of the blocks are the rows of
   the next round, so a table of n rows takes about ``log(n) / (levels * log(3))`` rounds.

Defined cases: null fields are ``-``; a null group is a group of its own and comes first; null order values come
first; rows with equal order values go by leaf, and equal rows by any order, as their proofs are equally good; a
lone leaf is its group's subroot; an empty table gives no rows; texts of any length are one field; columns that are not fields
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.tables import stage, tasks

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one parent.
FAN = 3
#: Levels that are worked out in one block of ``FAN ** LEVELS`` rows.
LEVELS = 6


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 within the group by ``order``, and ``n``, the group's rows.

    Rows equal in everything are told apart by a random number, so that they may be spread too.
    """
    tied = rows.withColumn("_tie", F.rand(13))
    dealt = tied.repartitionByRange(tasks(rows.sparkSession), group, *order, "_tie").sortWithinPartitions(group, *order)
    placed = stage(dealt.drop("_tie").withColumn("_place", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    counts = placed.groupBy("_part", group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_count"))
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(
        "_part",
        group,
        (F.sum("_count").over(ahead) - F.col("_count") - F.col("_first")).alias("_shift"),
        F.sum("_count").over(Window.partitionBy(group)).alias("n"),
    )
    found = placed.join(starts, ["_part", group]).withColumn("pos", F.col("_place") + F.col("_shift"))
    return found.drop("_part", "_place", "_shift")


def _climbed(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` (group, block, pos, n, hash) with the siblings on the way to the block's top, and that top."""
    block = Window.partitionBy("group", "block").orderBy("pos")
    width = 1
    rows = rows.withColumn("_h", F.col("hash"))
    for level in range(levels):
        at, nodes = F.expr(f"pos div {width}"), F.expr(f"(n + {width - 1}) div {width}")
        slot = at % FAN
        run = F.least(F.lit(FAN), nodes - (at - slot))
        near = {f"_lag{k}": F.lag("_h", k * width).over(block) for k in (1, 2)}
        near |= {f"_lead{k}": F.lead("_h", k * width).over(block) for k in (1, 2)}
        rows = rows.withColumns(near)
        left = F.when(slot == 1, F.col("_lag1")).when(slot == 2, F.concat("_lag2", "_lag1")).otherwise("")
        right = (
            F.when((slot == 0) & (run == 3), F.concat("_lead1", "_lead2"))
            .when((slot + 1 < run) & (slot < 2), F.col("_lead1"))
            .otherwise("")
        )
        rows = rows.withColumn(
            f"_step{level}",
            F.when((F.col("pos") % width == 0) & (nodes > 1), F.struct(left.alias("left"), right.alias("right"))),
        )
        width *= FAN
        parent = F.when(nodes > 1, digest(F.col("_h"), F.col(f"_step{level}.right"))).otherwise(F.col("_h"))
        rows = rows.withColumn("_h", F.when(F.col("pos") % width == 0, parent)).drop(*near)
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"_step{level}", ignorenulls=True).over(so_far) for level in range(levels)]
    empty = F.array().cast("array<struct<left:string,right:string>>")
    rows = rows.withColumn("steps", F.array_compact(F.array(*steps)) if steps else empty)
    return rows.withColumnRenamed("_h", "top").drop(*[f"_step{level}" for level in range(levels)])


def proofs(rows: DataFrame, levels: int, crown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` (group, pos, n, hash, ...) with ``path``, the siblings up to the top, ``subroot`` and ``root``.

    ``crown`` carries one row per group (group, hash) on to the root; without it the group's top is the root.
    """
    largest = rows.agg(F.max("n")).first()[0] or 0
    depth = 0
    while FAN**depth < largest and depth < levels:
        depth += 1
    width = FAN**depth
    rows = rows.withColumn("block", F.expr(f"pos div {width}"))
    climbed = stage(_climbed(rows, depth), "merkle-climbed")
    tops = climbed.where(F.col("pos") % width == 0).select(
        "group", F.col("block").alias("pos"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("top").alias("hash")
    )
    if largest > width:
        above = proofs(tops, levels, crown)
    elif crown is None:
        empty = F.array().cast("array<struct<left:string,right:string>>")
        above = tops.select("*", empty.alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    else:
        ended = crown(tops.select("group", "hash")).select("group", "path", "root")
        above = tops.join(ended, "group").select(*tops.columns, "path", F.col("hash").alias("subroot"), "root")
    above = above.select("group", F.col("pos").alias("block"), F.col("path").alias("_above"), "subroot", "root")
    joined = climbed.drop("top").join(above, ["group", "block"])
    return joined.withColumn("path", F.concat("steps", "_above")).drop("block", "steps", "_above")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda at, step: digest(step["left"], at, step["right"]))


def manifest(
    docs: DataFrame,
    doc_id: str = "doc_id",
    group: str = "source",
    fields: Sequence[str] = FIELDS,
    received: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, ``path`` (left and right siblings per level), ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` and ``verified``.

    ``received`` names fields whose value has to be checked instead of the stored one; they are folded with the
    stored siblings, so ``verified`` tells the rows that arrived unchanged.
    """
    stored = {name: F.col(f"`{name}`") for name in fields}
    arrived = stored | (received or {})
    leaf = digest(*[encoded(v) for v in stored.values()])
    start = digest(*[encoded(v) for v in arrived.values()]) if received else leaf
    # A prefix keeps null apart from every text and lets it come first.
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), key.alias("group"), leaf.alias("hash"), start.alias("start"))

    def crown(subroots: DataFrame) -> DataFrame:
        ranked = numbered(subroots.withColumn("all", F.lit(0)), "all", ["group"])
        named = ranked.select(F.col("all").alias("group"), "pos", "n", "hash", F.col("group").alias("of"))
        return proofs(named, levels).drop("group").withColumnRenamed("of", "group")

    proven = proofs(numbered(rows, "group", ["id", "hash"]), levels, crown)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    told = proven.select(
        F.col("id").alias(doc_id),
        F.col("hash").alias("leaf"),
        "path",
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("start"), F.col("path")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
