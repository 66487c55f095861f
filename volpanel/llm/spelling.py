"""Spelling variants: words one insertion, deletion or replacement apart, and the form each of them leads to.

A trie-node pair dictionary. The words are sorted once forwards and once reversed; a scan along each order numbers the
nodes of the trie and the reversed trie, so a word of length L has prefix nodes P(0..L) and suffix nodes S(0..L), whole numbers
that equal words' nodes share exactly. Pairs of nodes are the dictionary's keys:

- skipped position i: (P(i), S(i + 1)), the word without its code point i;
- inserted position i: (P(i), S(i)), the word itself with room for one more.

Two words that meet in skipped positions differ by one replacement, and by exactly one such key. A skipped position that
meets an inserted one is a deletion; a code point is only skipped for it at the end of a run of equal ones, so each pair
of words meets once here too. Words under a key differ in one code point, so a key holds no more words than the alphabet has letters,
and one more: no list grows with the table and no pair is written. Each key tells its words their number of
neighbours there and the best one; sums and maxima over keys end the job.

Numbers of nodes are (partition, place): words are range-partitioned, so a frequent beginning is spread over many
tasks. What the first word of a partition shares with the last one before it is settled from one row per partition.

Defined cases: null, empty and blank texts have no words; texts and words of any length are read whole, in time
linear in their length; repeated rows count each time; a null id counts as an empty one in the hash; ties between
forms go to the smaller word in code-point order; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.tables import stage, tasks

#: Maximal runs of letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One occurrence in so many loses a code point.
DAMAGE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Distinct words that a task counts before it hands them on.
COUNTED_AT_ONCE = 1 << 18
#: Node numbers that a task holds before it hands them on.
NODES_AT_ONCE = 1 << 18
#: Places of a partition's own nodes; the partition's number stands above.
PLACES = 40


def damaged(doc_id, run: str, damage: int | None = DAMAGE) -> str:
    """The run, without one code point if the hash of id and run says so."""
    if damage:
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % damage == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def ascii_lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, doc_id: str, text: str, least_length: int, least_count: int, damage: int | None) -> DataFrame:
    """(word, n) over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def told() -> pa.RecordBatch:
            arrays = [pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())]
            totals.clear()
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(RUN.findall(ascii_lowered(value.as_py() or "")))
                for run, n in runs.items():
                    word = damaged(doc, run, damage)
                    if len(word) >= least_length:
                        totals[word] += n
                if len(totals) >= COUNTED_AT_ONCE:
                    yield told()
        yield told()

    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = given.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def shared_length(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def trie_nodes(words: DataFrame, label: str) -> DataFrame:
    """``words`` (w, ...) with ``nodes``, the numbers of the trie nodes along ``w`` from the root (0), and ``rank``, ascending with ``w``."""
    ranged = words.repartitionByRange(tasks(words.sparkSession), "w").sortWithinPartitions("w")
    columns = [*words.columns, "part", "rank", "nodes"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path, place, row = "", [0], 1, 0
        for batch in batches:
            part = batch.column(batch.num_columns - 1)
            at, held, nodes, ranks = 0, 0, [], []
            for i, (value, number) in enumerate(zip(batch.column(0), part.to_pylist())):
                word = value.as_py()
                kept = shared_length(last, word)
                base = (number + 1 << PLACES) + place
                path = path[: kept + 1] + list(range(base, base + len(word) - kept))
                place, last = place + len(word) - kept, word
                nodes.append(path)
                ranks.append((number << PLACES) + row)
                row, held = row + 1, held + len(path)
                if held >= NODES_AT_ONCE or i + 1 == batch.num_rows:
                    arrays = [*batch.slice(at, len(nodes)).columns, pa.array(ranks, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, columns)
                    at, held, nodes, ranks = i + 1, 0, [], []

    kinds = [*[f"{c} {t}" for c, t in words.dtypes], "part int", "rank bigint", "nodes array<bigint>"]
    ordered = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(scan, ", ".join(kinds))
    local = stage(ordered, f"spelling-{label}")
    # What a word shares with the last one of the partitions before, it shares with its nodes too.
    tops = local.groupBy("part").agg(F.max(F.struct("w", "nodes")).alias("top")).collect()
    before: dict[int, tuple[str, list[int]]] = {}
    last, path = "", [0]
    for part, top in sorted((r["part"], r["top"]) for r in tops):
        before[part] = (last, path)
        kept = shared_length(last, top["w"])
        last, path = top["w"], path[: kept + 1] + top["nodes"][kept + 1 :]
    given = words.sparkSession.sparkContext.broadcast(before)
    width = len(words.columns)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for value, part, own in zip(batch.column(0), batch.column(width).to_pylist(), batch.column(width + 2)):
                start, known = given.value[part]
                kept = shared_length(start, value.as_py())
                nodes.append(known[: kept + 1] + own.as_py()[kept + 1 :])
            arrays = [*batch.columns[:width], batch.column(width + 1), pa.array(nodes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [c for c in columns if c != "part"])

    return local.mapInArrow(joined, ", ".join(k for k in kinds if k != "part int"))


#: What a key is to a word: a skipped position inside a run of equal code points, one at its end, an inserted position.
INSIDE, SKIPPED, INSERTED = 0, 1, 2


def dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (word, n) with their ``rank``, and their keys (p, s, rank, n, role)."""
    forward = trie_nodes(words.select(F.col("word").alias("w"), "n"), "forward")
    forward = stage(forward, "spelling-words")
    back = trie_nodes(forward.select(F.reverse("w").alias("w"), F.col("rank").alias("of")), "back")
    both = forward.join(back.select(F.col("of").alias("rank"), F.col("nodes").alias("back")), "rank")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps, ss, ranks, ns, roles = [], [], [], [], []

            def told() -> pa.RecordBatch:
                arrays = [pa.array(c, pa.int64()) for c in (ps, ss, ranks, ns)] + [pa.array(roles, pa.int32())]
                for column in (ps, ss, ranks, ns, roles):
                    column.clear()
                return pa.RecordBatch.from_arrays(arrays, ["p", "s", "rank", "n", "role"])

            for value, n, rank, path, tail in zip(*[batch.column(i) for i in range(5)]):
                word, path, tail = value.as_py(), path.as_py(), tail.as_py()[::-1]
                size = len(word)
                ps += path + path[:-1]
                ss += tail + tail[1:]
                ranks += [rank.as_py()] * (2 * size + 1)
                ns += [n.as_py()] * (2 * size + 1)
                roles += [INSERTED] * (size + 1)
                roles += [INSIDE if a == b else SKIPPED for a, b in zip(word, word[1:])] + [SKIPPED]
                if len(ps) >= NODES_AT_ONCE:
                    yield told()
            yield told()

    entries = both.select("w", "n", "rank", "nodes", "back").mapInArrow(keys, "p bigint, s bigint, rank bigint, n bigint, role int")
    return forward.select("rank", F.col("w").alias("word"), "n"), entries


def neighbours(entries: DataFrame) -> DataFrame:
    """(rank, n_near, best): every word's number of near words, and the best of them as (n, order), order being minus its rank."""
    member = F.struct("n", (-F.col("rank")).alias("order"), "role")
    held = entries.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("members"))
    met = held.where(F.size("members") > 1).select("members", F.explode("members").alias("m"))

    def meets(other):
        replaced = (F.col("m.role") != INSERTED) & (other["role"] != INSERTED) & (other["order"] != F.col("m.order"))
        resized = (F.col("m.role") == INSERTED) & (other["role"] == SKIPPED)
        return replaced | resized | ((F.col("m.role") == SKIPPED) & (other["role"] == INSERTED))

    told = met.select((-F.col("m.order")).alias("rank"), F.filter("members", meets).alias("near")).where(F.size("near") > 0)
    best = F.struct(F.col("near")[0]["n"].alias("n"), F.col("near")[0]["order"].alias("order"))
    counted = told.select("rank", F.size("near").cast("bigint").alias("k"), best.alias("best"))
    return counted.groupBy("rank").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def followed(steps: DataFrame) -> DataFrame:
    """(rank, last) for steps (rank, to): where they end, by pointer jumping; steps lead to words of larger n, so there is no circle."""
    reached = stage(steps.select("rank", F.col("to").alias("last")), "spelling-steps")
    while True:
        onward = reached.select(F.col("rank").alias("last"), F.col("last").alias("further"))
        jumped = reached.join(onward, "last", "left").select(
            "rank", F.coalesce("further", "last").alias("last"), F.col("further").isNotNull().alias("moved")
        )
        jumped = stage(jumped, "spelling-roots")
        reached = jumped.select("rank", "last")
        if jumped.where("moved").isEmpty():
            return reached


def variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damage: int | None = DAMAGE,
) -> DataFrame:
    """One row per word of at least ``least_length`` code points that occurs at least ``least_count`` times: word, form (near word of
    largest n, if that is at least twice its own), root (where forms lead), n, n_near, form_n.

    ``damage`` deletes a code point of one in so many (id, word) pairs, to plant variants; None leaves texts as they are.
    """
    words = stage(word_counts(docs, doc_id, text, least_length, least_count, damage), "spelling-counts")
    named, entries = dictionary(words)
    near = named.select("rank", "n").join(neighbours(entries), "rank")
    chosen = F.col("best.n") >= 2 * F.col("n")
    near = near.select(
        "rank",
        "n_near",
        F.when(chosen, -F.col("best.order")).alias("to"),
        F.when(chosen, F.col("best.n")).alias("form_n"),
    )
    near = stage(near, "spelling-near")
    roots = followed(near.where("to IS NOT NULL"))
    form = named.select(F.col("rank").alias("to"), F.col("word").alias("form"))
    last = named.select(F.col("rank").alias("last"), F.col("word").alias("root"))
    return (
        named.join(near, "rank", "left")
        .join(form, "to", "left")
        .join(roots, "rank", "left")
        .join(last, "last", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            "form_n",
        )
    )
