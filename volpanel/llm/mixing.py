"""Temperature mixing: sources by exponentiated token shares, realised as budgeted block permutations.

Shares ``p`` of the sources' tokens become weights ``p ** a / sum(p ** a)``. The exponent ``a`` is a
multiple of 1 / ``STEPS`` in [0, 1]: the largest whose weights still have the target entropy (a
share of the logarithm of the number of sources), raised to the smallest that keeps every source within the
repetition limit. Both conditions are monotone in ``a``, so the exponent is found by bisection; every round
tries several exponents in one aggregation over the table of sources.

Each source may then spend ``floor(budget * weight)`` tokens. Its documents fall into blocks by a hash, about
``rows_per_block`` each. A pass over the source visits all blocks in an order of that pass, and the
documents of a block in an order of that pass. Whole passes take every document; the last pass stops before
its budget would be exceeded. Running sums go over blocks first and over the documents of one block then,
so no task holds a source.

Defined cases: a null source is a source of its own; null or empty text has one token, the end marker;
rows with equal ids are drawn separately and are interchangeable when also equal in tokens; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.tables import stage, word_tokens

STEPS = 10_000
PER_ROUND = 24


def temperature_weights(
    totals: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: int | None = None
) -> tuple[float, DataFrame]:
    """Exponent, and per source: tokens, docs, share, weight, quota.

    ``totals`` has ``source``, ``tokens``, ``docs``. The budget defaults to all tokens there are.
    """
    whole = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n_sources = whole["t"] or 0, whole["n"]
    budget = total if budget is None else budget
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))

    def measured(steps: list[int]) -> list[tuple[bool, bool]]:
        columns = []
        for k in steps:
            a = k / STEPS
            power = F.pow("share", F.lit(a))
            columns += [
                F.sum(power).alias(f"z{k}"),
                F.sum(power * F.log("share")).alias(f"s{k}"),
                F.max(power / F.col("tokens")).alias(f"r{k}"),
            ]
        row = shares.agg(*columns).first()
        found = []
        for k in steps:
            z, a = row[f"z{k}"], k / STEPS
            entropy = math.log(z) - a * row[f"s{k}"] / z
            flat = entropy_share is None or entropy >= entropy_share * math.log(n_sources) - 1e-12
            fits = max_repeats is None or budget * row[f"r{k}"] / z <= max_repeats + 1e-12
            found.append((flat, fits))
        return found

    def last(test) -> int:
        """Largest step that passes, given that step 0 does and that passing is monotone."""
        low, high = 0, STEPS + 1
        while high - low > 1:
            steps = sorted({low + (high - low) * i // PER_ROUND for i in range(1, PER_ROUND)} - {low, high})
            for k, ok in zip(steps, measured(steps)):
                if test(ok):
                    low = k
                else:
                    high = k
                    break
        return low

    step = STEPS
    if n_sources and entropy_share is not None:
        step = last(lambda ok: ok[0])
    elif n_sources and max_repeats is not None:
        step = 0
    if n_sources and max_repeats is not None and not measured([step])[0][1]:
        step = min(STEPS, last(lambda ok: not ok[1]) + 1)
    a = step / STEPS
    norm = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    weight = F.pow("share", F.lit(a)) / F.lit(norm)
    # The last digits of a sum depend on its order; they must not cost a whole share its last token.
    quota = F.floor(F.lit(float(budget)) * F.col("weight") * F.lit(1.0 + 1e-12))
    planned = shares.withColumn("weight", weight).withColumn("quota", quota)
    return a, planned


def temperature_mixture(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tokens: str | None = None,
    entropy_share: float | None = 0.95,
    max_repeats: float | None = 4.0,
    budget: int | None = None,
    rows_per_block: int = 1000,
    seed: int = 17,
    mark: Column | None = None,
) -> DataFrame:
    """One row per drawn document: doc_id, source, n_tokens, epoch, block_rank, slot, exponent.

    A ``mark`` that tells rows of one id apart is carried along as a further column.
    """
    n = F.col(tokens).cast("bigint") if tokens else word_tokens(F.col(text))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            n.alias("n_tokens"),
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("bigint").alias("spot"),
            *([] if mark is None else [mark.alias("mark")]),
        ),
        "mix-rows",
    )
    totals = stage(
        rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-totals"
    )
    exponent, planned = temperature_weights(totals, entropy_share, max_repeats, budget)

    # As many bits as bring a source's blocks to about rows_per_block documents.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / F.lit(float(rows_per_block))))).cast("int")
    plan = planned.select(
        F.col("source").alias("p_source"),
        F.expr("shiftleft(1L, 32)").alias("span"),
        F.least(bits, F.lit(24)).alias("bits"),
        F.expr("quota div tokens").alias("passes"),
        (F.col("quota") % F.col("tokens")).alias("rest"),
    )
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["p_source"]), "inner").withColumn(
        "block", F.floor(F.col("spot") * F.expr("shiftleft(1L, bits)") / F.col("span")).cast("bigint")
    )
    blocks = placed.groupBy("source", "block").agg(
        F.sum("n_tokens").alias("block_tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest")
    )
    visits = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", "block"))
    by_pass = Window.partitionBy("source", "epoch").orderBy(turn, "block")
    visits = (
        visits.withColumn("block_rank", F.row_number().over(by_pass))
        .withColumn("before", F.sum("block_tokens").over(by_pass) - F.col("block_tokens"))
        .withColumn("left", F.when(F.col("epoch") == F.col("passes"), F.col("rest") - F.col("before")))
        .where(F.col("left").isNull() | (F.col("left") > 0))
        .select(
            F.col("source").alias("v_source"), F.col("block").alias("v_block"), "epoch", "block_rank", "left"
        )
    )
    drawn = placed.join(
        visits, placed["source"].eqNullSafe(visits["v_source"]) & (placed["block"] == visits["v_block"])
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ties = ["n_tokens"] if mark is None else ["n_tokens", "mark"]
    in_block = Window.partitionBy("source", "epoch", "block").orderBy(order, *ties)
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        drawn.withColumn("slot", F.row_number().over(in_block))
        .withColumn("used", F.sum("n_tokens").over(upto))
        .where(F.col("left").isNull() | (F.col("used") <= F.col("left")))
        .select(
            "doc_id", "source", "n_tokens", "epoch", "block_rank", "slot", F.lit(exponent).alias("exponent"),
            *([] if mark is None else ["mark"]),
        )
    )


def draw(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """Rows of ``docs`` with all their columns, each as often as the mixture draws it.

    Rows that differ in any column are drawn as rows of their own, also where id, source and text are equal; rows equal in
    all columns are interchangeable, so one of them stands for all of their draws.
    """
    # Maps can't be hashed; their text can.
    columns = [(F.col(f"`{f.name}`"), "map<" in f.dataType.simpleString()) for f in docs.schema.fields]
    mark = F.xxhash64(*[F.to_json(F.struct(c)) if has_map else c for c, has_map in columns])
    drawn = temperature_mixture(docs, doc_id, source, text, mark=mark, **settings)
    times = stage(
        drawn.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark")).agg(
            F.count(F.lit(1)).alias("_times"), F.count(F.when(F.col("epoch") == 0, 1)).alias("_rows")
        ),
        "mix-times",
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(doc_id).alias("_row_id"), F.col(source).alias("_row_source"), mark.alias("_row_mark"))
    if not times.where("_rows > 1").isEmpty():
        rows = rows.dropDuplicates(["_row_id", "_row_source", "_row_mark"])
    met = rows.join(
        times,
        F.col("_row_id").eqNullSafe(F.col("_id"))
        & F.col("_row_source").eqNullSafe(F.col("_source"))
        & (F.col("_row_mark") == F.col("_mark")),
    )
    repeated = met.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return repeated.select(*[F.col(f"row.`{c}`") for c in docs.columns])
