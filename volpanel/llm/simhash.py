"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked when at most three bits differ.

A byte-position inverted index with count filtering, over distinct fingerprints:

1. Fingerprints within three bits share at least five of their eight bytes (``LEAST_BYTES``), the guaranteed minimum.
   A posting list is named by the bytes at four positions; ``position_sets`` are fourteen sets of four positions, one of
   which lies inside any five positions. So every pair that may link meets in a list, and by chance
   only one pair in 2 ** 32 meets in a given one.
2. A list longer than ``LIST_ROWS`` is split further: its free bits are dealt into four runs, and fingerprints within three bits
   agree on at least one of them. First that adds one byte position after another, then parts of bytes. Every split
   fixes a quarter of the free bits, so lists end below the limit after a fixed number of rounds, whatever the data:
   nothing is capped.
3. Inside a list the shared positional bytes of each pair are tallied; pairs that reach the minimum are
   verified by their differing bits. A list returns links that join its components, not all pairs.
4. Components of the links name every fingerprint, and so every document.

Defined cases: null, empty and blank texts have the fingerprint zero, which links like any other; with fewer than three
words the whole sequence is one shingle; repeated shingles count each time; texts of any length are hashed whole in blocks; rows with equal
fingerprints are one component; a null id is a row of its own kind and names a component only if all its ids are null; an empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.llm.components import connected_components
from volpanel.llm.tables import stage

#: Differing bits of a link, and the equal bytes of eight that it guarantees.
BITS, LEAST_BYTES = 3, 5
#: Fingerprints that are compared with each other in one list.
LIST_ROWS = 2048
#: A fingerprint of more than one row in so many is heavy; its rows are spread over ``SALTS`` tasks when they are joined.
HEAVY_SHARE, SALTS = 500, 64
#: Shingles that are tallied at a time.
BLOCK = 1 << 15
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is set when it is set in over half of the shingles' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    width = min(words, len(found))
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = [hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * totals > len(starts)).tolist())


def position_sets() -> list[tuple[int, ...]]:
    """Fourteen sets of four byte positions, one of them inside every five of the eight.

    Both halves, and each pair of one half with the pairs of the same matching in the other: three positions of a half hold
    a pair of each of the three matchings.
    """
    sets = [(0, 1, 2, 3), (4, 5, 6, 7)]
    for other in (1, 2, 3):
        rest = tuple(sorted({1, 2, 3} - {other}))
        for left in ((0, other), rest):
            for right in ((0, other), rest):
                sets.append((*left, *[4 + p for p in right]))
    return sets


def first_masks() -> list[int]:
    return [sum(0xFF << 8 * p for p in positions) for positions in position_sets()]


def finer_masks(mask: int) -> list[int]:
    """``mask`` with one of four runs of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    runs = [free[len(free) * k // (BITS + 1) : len(free) * (k + 1) // (BITS + 1)] for k in range(BITS + 1)]
    return sorted({mask | sum(1 << i for i in run) for run in runs if run})


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _lists(prints: DataFrame, masks: Column) -> DataFrame:
    """Postings (mask, value, print)."""
    entries = prints.withColumn("mask", F.explode(masks))
    return entries.select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("value"), "print")


def list_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of one list: pairs with enough equal bytes, then few enough differing bits."""
    n, links = len(prints), []
    apart = np.ones(n, dtype=bool)
    for i in range(n):
        # Breadth first over those not reached yet, so every member is compared with the rest once at most.
        if not apart[i]:
            continue
        apart[i] = False
        queue = [i]
        while queue:
            j = queue.pop()
            rest = np.flatnonzero(apart)
            if not len(rest):
                break
            differ = prints[rest] ^ prints[j]
            equal_bytes = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            enough = equal_bytes >= LEAST_BYTES
            near = rest[enough][np.bitwise_count(differ[enough]) <= BITS]
            apart[near] = False
            links += [(int(prints[j]), int(prints[k])) for k in near]
            queue += near.tolist()
    return links


def fingerprint_links(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) that join the components of the distinct fingerprints ``print``."""
    entries = _lists(prints, F.array(*[_literal(_signed(m)) for m in first_masks()]))
    found = []

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for members in batch.column(0):
                links += list_links(members.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    while True:
        sizes = entries.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("size"))
        sizes = stage(sizes.where("size > 1"), "simhash-lists")
        shared = entries.join(sizes, ["mask", "value"])
        short = shared.where(F.col("size") <= list_rows).groupBy("mask", "value").agg(F.collect_list("print").alias("prints"))
        found.append(stage(short.select("prints").mapInArrow(compared, "a bigint, b bigint"), "simhash-links"))
        if sizes.where(F.col("size") > list_rows).isEmpty():
            break
        # Masks come from a fixed family, so those of the long lists are few whatever the table.
        long = shared.where(F.col("size") > list_rows).select("print", F.col("mask").alias("coarse"))
        masks = [r["mask"] for r in sizes.where(F.col("size") > list_rows).select("mask").distinct().collect()]
        finer = {m: [_signed(f) for f in finer_masks(m % (1 << 64))] for m in masks}
        parts = F.create_map(*[c for m, fs in finer.items() for c in (_literal(m), F.array(*map(_literal, fs)))])
        entries = stage(_lists(long, parts[F.col("coarse")]).distinct(), "simhash-split")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return stage(links.distinct(), "simhash-pairs")


def _literal(value: int) -> Column:
    return F.lit(value).cast("bigint")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint of every row as a signed 64-bit number."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(value.as_py(), words)) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(hashed, f"doc_id {kind}, print bigint")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, list_rows: int = LIST_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    signed = stage(fingerprints(docs, doc_id, text, words), "simhash-prints")
    prints = stage(
        signed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-distinct"
    )
    links = fingerprint_links(prints.select("print"), list_rows)
    found = connected_components(links).withColumnRenamed("node", "print")
    named = prints.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = stage(named.join(least, "component").select("print", "rows", "component_id"), "simhash-labels")
    # Fewer than HEAVY_SHARE fingerprints can be heavy, whatever the table.
    total = prints.agg(F.sum("rows")).first()[0] or 0
    heavy = [r["print"] for r in labelled.where(F.col("rows") * HEAVY_SHARE > total).select("print").collect()]
    is_heavy = F.col("print").isin(heavy) if heavy else F.lit(False)
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(is_heavy, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    spread = labelled.select("print", "component_id", F.explode(salts).alias("salt"))
    rows = signed.withColumn("salt", salt).join(spread, ["print", "salt"])
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0")
    return rows.select(F.col("doc_id").alias(doc_id), hexed.alias("fingerprint"), "component_id")
