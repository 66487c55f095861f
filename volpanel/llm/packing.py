"""Best-fit packing into bins of several permitted lengths.

Documents become pieces of at most the largest length. Pieces are dealt at random over shards of bounded size, and
each shard is packed alone, longest piece first: a piece goes into the open bin it leaves the least room in. If
none has room, a bin is opened whose length costs least per token it can be expected to hold, given
the pieces still to come. When all pieces are placed, every bin shrinks to the shortest permitted length
that holds its contents. Shards cost at most a few half-filled bins each, whatever the size of the corpus.

Defined cases: null or empty text has one token, the end marker; pieces of one length are taken in row order;
repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.tables import stage, word_tokens

LENGTHS = (256, 512, 1024, 2048, 4096)
SCHEMA = "doc_id bigint, piece int, n_tokens int, bin_id bigint, bin_length int, start int"


def sequence_cost(length: int) -> float:
    """Cost of training on one sequence: a fixed part, its tokens, and attention that grows with the square."""
    return 32.0 + length + length * length / 16384.0


def best_fit(
    sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, start in the bin, and final bin length for each size; no size exceeds the largest length."""
    lengths = sorted(lengths)
    costs = [cost(c) for c in lengths]
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    sorted_sizes = np.asarray(sizes, dtype=np.int64)[order]
    rising = (-sorted_sizes).tolist()
    upto = np.concatenate([[0], np.cumsum(sorted_sizes)]).tolist()
    total, count = upto[-1], len(order)
    by_room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    rooms = 0  # bit r is set if an open bin has room r
    used: list[int] = []
    bins, starts = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    for i, size in enumerate(sorted_sizes.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, best = 0, None
            for c, price in zip(lengths, costs):
                if c >= size:
                    # Pieces to come that fit beside this one: those of size c - size or less.
                    first = max(i + 1, bisect_left(rising, size - c))
                    expected = size + min(c - size, total - upto[first])
                    if best is None or price / expected < best:
                        room, best = c, price / expected
            chosen = len(used)
            used.append(0)
        bins[order[i]], starts[order[i]] = chosen, used[chosen]
        used[chosen] += size
        room -= size
        if room:
            by_room[room].append(chosen)
            rooms |= 1 << room
    shortest = np.asarray(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, dtype=np.int64)
    return bins, starts, shortest[bins] if used else shortest


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: str | None = None,
    lengths: Sequence[int] = LENGTHS,
    shard_tokens: int = 2_000_000,
    shard_pieces: int = 100_000,
) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bin_id, bin_length, start."""
    longest = max(lengths)
    n = F.col(tokens).cast("bigint") if tokens else word_tokens(F.col(text))
    sized = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), n.alias("n"))
    last = F.floor((F.col("n") - 1) / F.lit(longest))
    pieces = stage(
        sized.where("n > 0")
        .select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
        .select(
            "doc_id",
            F.col("piece").cast("int").alias("piece"),
            F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("n_tokens"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "pack-pieces",
    )
    size = pieces.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-(size["t"] or 0) // shard_tokens), -(-size["n"] // shard_pieces))

    def pack_shard(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("row", kind="stable")
        bins, starts, final = best_fit(shard["n_tokens"].to_numpy(), lengths)
        first = int(shard["shard"].iloc[0]) << 32
        return shard[["doc_id", "piece", "n_tokens"]].assign(bin_id=bins + first, bin_length=final, start=starts)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("bigint"))
    return dealt.groupBy("shard").applyInPandas(pack_shard, SCHEMA)
