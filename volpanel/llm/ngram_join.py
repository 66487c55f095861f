"""Similarity join of documents on word shingles: grouped prefix join.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. Shingles have one global
order, the ones that many documents share last; two sets can only link if their prefixes in this order meet.

1. Equal sets are one node. Nodes with equal prefixes and size are one group, named by its smallest node, the pivot;
   joins run over groups. Prefix shingles under which no two groups have sizes near enough to link are left out.
2. Stars: every group, and every list of groups under one of the first few prefix shingles, is compared with its
   smallest member. This is linear and joins most near copies into components.
3. Hubs: under each prefix shingle, every group outside the most frequent component is compared with a few members
   of it, in rounds, until a round joins little. This is linear too and draws loosely linked clusters together.
4. The rest: all pairs of groups under a common prefix shingle that pass the size and position filters
   are expanded to their members, and every pair of members from different components is compared.

Pairs inside a component need no comparison, so components are exact while a group of thousands of near copies
costs a few comparisons per member. Every comparison is an exact count of common shingles.

The order comes from counts over all documents: shingles that recur within ``COUNTED_AT_ONCE`` of a task, summed, of which
at most the ``HOT`` most frequent are shared with the tasks. All others follow by hash; any order gives the same links.

Defined cases: null, empty or blank text has no shingles and links with nothing; with fewer words than a
shingle the whole sequence is one; equal rows are one node; a null id is a row of its own kind and never names a
component unless all its rows are null; an empty table gives no rows; extra columns are ignored; a very long text is
hashed in pieces that end between words, and is one set like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from volpanel.llm.components import connected_components
from volpanel.llm.shingles import fingerprint, shingle_set
from volpanel.llm.tables import SLOTS, Scratch, in_slots, likely, map_batches, slot_bitmap, slot_of, stage

#: Most shingles whose frequency is shared with every task: 16 bytes each.
HOT = 1 << 18
#: Shingles that are counted in one go, a bound on a task's memory.
COUNTED_AT_ONCE = 1 << 21
#: Rows that a task turns into sets at a time.
ROWS_AT_ONCE = 500
#: Prefix shingles of a group that are compared in stars.
STARS = 4
#: Members of the most frequent component that the others are compared with in a round, and rounds at most.
HUBS, HUB_ROUNDS = 2, 4
#: A round of hubs is the last one if it joins less than this share of the postings it looked at.
HUB_SHARE = 0.01
#: Postings of a shingle that are joined with all others of it in one task.
BLOCK = 512
#: Groups of one component under a shingle that make it a hub.
HUB_GROUPS = 8
#: Bits of a set's parity sketch, and of the folded one that travels with prefix shingles.
PARITY_BITS, FOLDED_BITS = 1024, 256


@dataclass(frozen=True)
class Join:
    """Words per shingle, and the threshold as a fraction of whole numbers."""

    words: int = 5
    num: int = 80
    den: int = 100

    def need(self, n):
        """Fewest shingles a set of ``n`` must share with any other to link."""
        return (self.num * n + self.den - 1) // self.den


def parity_sketch(found: np.ndarray) -> bytes:
    """Per slot, whether an odd number of shingles fall into it. Sketches differ in no more bits than sets in members."""
    slots = (found >> np.uint64(64 - 10)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=PARITY_BITS) & 1 == 1).tobytes()


def folded(sketch: bytes) -> list[int]:
    """The parity sketch on a quarter of the slots, as whole numbers of 64 bits."""
    parts = np.frombuffer(sketch, dtype=np.int64).reshape(PARITY_BITS // FOLDED_BITS, -1)
    return np.bitwise_xor.reduce(parts, axis=0).tolist()


def may_link(m: np.ndarray, n: np.ndarray, x: list[bytes], y: list[bytes], join: Join) -> np.ndarray:
    """Whether sets of sizes ``m`` and ``n`` with these sketches can differ in few enough members. Never false for a link."""
    left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
    differ = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return differ * (join.den + join.num) <= (m + n) * (join.den - join.num)


def frequent_shingles(docs: DataFrame, text: str, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """At most the ``HOT`` most frequent shingles and their counts, sorted by shingle.

    A histogram over levels of an eighth of a doubling tells the level from which on they are few enough.
    """

    def counts_of(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        more = counts > 1
        arrays = [pa.array(values[more].view(np.int64)), pa.array(counts[more].astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["shingle", "n"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, held = set(), [], 0
        for value in (v for batch in batches for v in batch.column(0)):
            found = shingle_set(value.as_py(), join.words)
            name = fingerprint(found)
            if len(found) and name not in seen:
                seen.add(name)
                sets.append(found)
                held += len(found)
            if held >= COUNTED_AT_ONCE:
                yield counts_of(sets)
                seen, sets, held = set(), [], 0
        if sets:
            yield counts_of(sets)

    counted = docs.select(text).mapInArrow(repeated, "shingle bigint, n bigint")
    scratch = Scratch(docs.sparkSession)
    counts = scratch.stage(counted.groupBy("shingle").agg(F.sum("n").alias("n")), "join-counts")
    level = F.floor(F.log2("n") * 8)
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect()
    held, least = 0, None
    for row in sorted(levels, reverse=True):
        held += row["c"]
        if held > HOT:
            break
        least = row["level"]
    top = counts.where(level >= F.lit(least)).toPandas() if least is not None else counts.limit(0).toPandas()
    scratch.drop()
    shingles = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], top["n"].to_numpy(dtype=np.int64)[order]


def _ordered(found: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare shingles first, by count and then hash."""
    if not len(hot):
        return found
    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
    weight = np.where(hot[at] == found, counts[at], 0)
    return found[np.lexsort((found, weight))]


def signatures(docs: DataFrame, doc_id: str, text: str, join: Join) -> DataFrame:
    """Per row, staged: doc_id, set size, node (name of the set), group (name of prefix and size), prefix."""
    hot, counts = frequent_shingles(docs, text, join)
    shared = docs.sparkSession.sparkContext.broadcast((hot, counts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            sizes, nodes, groups, prefixes, parities, folds = [], [], [], [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), join.words)
                n = len(found)
                sizes.append(n)
                if n:
                    prefix = _ordered(found, *shared.value)[: n - join.need(n) + 1]
                    nodes.append(fingerprint(found))
                    groups.append(fingerprint(np.append(prefix, np.uint64(n))))
                    prefixes.append(prefix.view(np.int64))
                    parities.append(parity_sketch(found))
                    folds.append(folded(parities[-1]))
                else:
                    for column in (nodes, groups, prefixes, parities, folds):
                        column.append(None)
            schema = schema or pa.schema(
                [
                    ("doc_id", batch.column(0).type),
                    ("n", pa.int64()),
                    ("node", pa.binary()),
                    ("prefix_name", pa.binary()),
                    ("parity", pa.binary()),
                    ("fold", pa.list_(pa.int64())),
                    ("prefix", pa.list_(pa.int64())),
                ]
            )
            arrays = [batch.column(0), pa.array(sizes, pa.int64())]
            arrays += [pa.array(column, pa.binary()) for column in (nodes, groups, parities)]
            arrays += [pa.array(column, pa.list_(pa.int64())) for column in (folds, prefixes)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    kind = docs.schema[doc_id].dataType.simpleString()
    signed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        sign, f"doc_id {kind}, n bigint, node binary, prefix_name binary, parity binary, fold array<bigint>, prefix array<bigint>"
    )
    signed = stage(signed, "join-signed")
    shared.destroy()
    return signed


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b), repeats included."""
    return pairs.select(F.col("a").alias("nid")).union(pairs.select("b"))


def _bit(place: Column) -> Column:
    """A word of 64 bits with the one at ``place``."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


class _Run:
    """One join: the tables of nodes and groups, and the components found so far.

    Nodes go by numbers (``nid``), groups by the number of their pivot (``gid``), components by that of their smallest node.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, join: Join):
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        self.join = join
        self.scratch = Scratch(docs.sparkSession)
        self.signed = signatures(docs, doc_id, text, join)
        columns = ("prefix_name", "n", "parity", "fold", "prefix")
        sets = self.signed.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in columns]
        )
        # Numbers are fixed by being written.
        self.known = self.scratch.stage(sets.withColumn("nid", F.monotonically_increasing_id()), "join-known")
        pivots = self.known.groupBy("prefix_name").agg(F.min("nid").alias("gid"))
        named = self.known.select("nid", "node", "n", "doc", "prefix_name").join(pivots, "prefix_name").drop("prefix_name")
        self.nodes = self.scratch.stage(named, "join-nodes")
        others = self.scratch.stage(self.nodes.where("nid <> gid").select("nid"), "join-others")
        # Wide rows need not move where few groups have several nodes.
        self.groups = self.known.join(others, "nid", "left_anti").select(F.col("nid").alias("gid"), "n", "fold", "prefix")
        self.components: DataFrame | None = None
        self.tested: DataFrame | None = None

    def labelled(self) -> DataFrame:
        """Nodes with the component they are in so far."""
        if self.components is None:
            return self.nodes.withColumn("component", F.col("nid"))
        found = self.components.select(F.col("node").alias("nid"), F.col("component").alias("_c"))
        return self.nodes.join(found, "nid", "left").withColumn("component", F.coalesce("_c", "nid")).drop("_c")

    def verify(self, pairs: DataFrame) -> int:
        """Compare pairs of nodes (a, b) with a < b that were not compared before, and join those that link.

        Returns the number of links between components that were apart.
        """
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        used = Scratch(self.docs.sparkSession)
        pairs = self.scratch.stage(self._likely_pairs(used.stage(pairs, "join-asked"), used), "join-pairs")
        if pairs.isEmpty():
            used.drop()
            return 0
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        ends = used.stage(self.nodes.join(_ends(pairs).distinct(), "nid").select("nid", "node", "doc"), "join-ends")
        ends = ends.select("nid", "node", "doc", slot_of(F.col("doc")).alias("slot"))
        shared = self.docs.sparkSession.sparkContext.broadcast(slot_bitmap(ends, "doc"))
        k = self.join.words

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = pa.array(in_slots(batch.column(1), shared.value))
                texts = batch.column(0).filter(hit)
                slots = batch.column(1).filter(hit)
                for at in range(0, len(texts), ROWS_AT_ONCE):
                    found = [shingle_set(value.as_py(), k) for value in texts.slice(at, ROWS_AT_ONCE)]
                    some = pa.array([len(s) > 0 for s in found], pa.bool_())
                    names = pa.array([fingerprint(s) for s in found], pa.binary())
                    arrays = [names, slots.slice(at, ROWS_AT_ONCE), pa.array([s.tobytes() for s in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["node", "slot", "shingles"]).filter(some)

        # One Python step per task: screen the texts and turn what is left into sets, which lie where they are read.
        have = self.docs.select("text", slot_of(F.col("doc_id")).alias("slot"))
        have = have.mapInArrow(sets, "node binary, slot bigint, shingles binary")
        have = used.stage(have, "join-sets")
        shared.destroy()
        # A copy that another node's slot let in has a slot of its own. Only equal ids, and null ones, can bring a set again.
        if not have.groupBy("node", "slot").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            have = used.stage(have.groupBy("node", "slot").agg(F.first("shingles").alias("shingles")), "join-sets")
        num, den = self.join.num, self.join.den

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                linked = []
                for x, y in zip(batch["left_set"], batch["right_set"]):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(den * common >= num * (len(x) + len(y) - common))
                yield batch.loc[linked, ["a", "b"]]

        # Names are found before the wide sets come in, so a set moves once for each end it is.
        met = pairs
        for end in ("a", "b"):
            met = met.join(ends.select(F.col("nid").alias(end), F.col("node").alias(f"{end}_node"), F.col("slot").alias(f"{end}_slot")), end)
        for end, side in (("a", "left"), ("b", "right")):
            of_end = have.select(F.col("node").alias(f"{end}_node"), F.col("slot").alias(f"{end}_slot"), F.col("shingles").alias(f"{side}_set"))
            met = met.join(of_end, [f"{end}_node", f"{end}_slot"])
        links = met.select("a", "b", "left_set", "right_set").mapInPandas(compare, "a bigint, b bigint")
        if self.components is not None:
            known = self.components
            for end in ("a", "b"):
                at = known.select(F.col("node").alias(end), F.col("component").alias("_c"))
                links = links.join(at, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        links = used.stage(links.where("a <> b"), "join-links")
        joined = links.count()
        if joined:
            merged = connected_components(links)
            if self.components is not None:
                moved = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
                old = self.components.join(moved, "component", "left").select(
                    "node", F.coalesce("_to", "component").alias("component")
                )
                merged = old.unionByName(merged.join(self.components.select("node"), "node", "left_anti"))
            self.components = self.scratch.stage(merged, "join-components")
        used.drop()
        return joined

    def _likely_pairs(self, pairs: DataFrame, used: Scratch) -> DataFrame:
        """Pairs whose sketches allow a link; nearly all others go without a look at their sets.

        Most nodes are in no pair, and a bitmap keeps their sketches out of the shuffle.
        """
        join = self.join
        shared = self.docs.sparkSession.sparkContext.broadcast(slot_bitmap(_ends(pairs), "nid"))
        sketches = used.stage(likely(self.known.select("nid", "n", "parity"), F.col("nid"), shared), "join-sketches")
        shared.destroy()
        for end, size, sketch in (("a", "m", "x"), ("b", "n", "y")):
            known = sketches.select(F.col("nid").alias(end), F.col("n").alias(size), F.col("parity").alias(sketch))
            pairs = pairs.join(known, end)

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    p = p[may_link(p["m"].to_numpy(), p["n"].to_numpy(), list(p["x"]), list(p["y"]), join)]
                yield p[["a", "b"]]

        return pairs.select("a", "b", "m", "n", "x", "y").mapInPandas(compare, "a bigint, b bigint")

    def stars(self, postings: DataFrame) -> None:
        """Every node with the pivot of its group; every group with the smallest one under each early shingle."""
        inside = self.nodes.where("nid <> gid").select(F.col("gid").alias("a"), F.col("nid").alias("b"))
        early = postings.where(F.col("pos") < STARS)
        first = early.groupBy("shingle").agg(F.min("gid").alias("top"))
        sizes = early.select("shingle", F.col("gid").alias("top"), F.col("n").alias("m"))
        first = first.join(sizes, ["shingle", "top"])
        across = (
            early.join(first, "shingle")
            .where((F.col("gid") != F.col("top")) & self._sizes(F.col("n"), F.col("m")))
            .select(F.col("top").alias("a"), F.col("gid").alias("b"))
        )
        self.verify(inside.unionByName(across))

    def _sizes(self, m, n):
        """Sizes that leave room for the threshold."""
        return F.lit(self.join.den) * F.least(m, n) >= F.lit(self.join.num) * F.greatest(m, n)

    def _reach(self) -> Column:
        """Size and position filter of a pair of postings: what can still be shared reaches the needed overlap."""
        left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        num, den = self.join.num, self.join.den
        # |x & y| >= num / (num + den) * (|x| + |y|); what stands before the first common shingle isn't shared.
        enough = F.lit(num + den) * left >= F.lit(num) * (F.col("x.n") + F.col("y.n"))
        return self._sizes(F.col("x.n"), F.col("y.n")) & enough

    def _close(self) -> Column:
        """Whether the folded sketches of two pivots allow a link; groups of several sets are settled member by member."""
        parts = range(FOLDED_BITS // 64)
        differ = sum((F.bit_count(F.col("x.fold")[i].bitwiseXOR(F.col("y.fold")[i])) for i in parts), F.lit(0))
        num, den = self.join.num, self.join.den
        few = differ * (num + den) <= (F.col("x.n") + F.col("y.n")) * (den - num)
        return few | (F.col("x.members") > 1) | (F.col("y.members") > 1)

    def _mixed(self, postings: DataFrame) -> DataFrame:
        """Postings of the shingles that stand under at least two components, with what is known of their groups.

        ``low`` is the smallest component in a group, ``torn`` tells that it has several, ``members`` counts its sets,
        ``listed`` the postings of the shingle.
        """
        spans = self.labelled().groupBy("gid").agg(
            F.min("component").alias("low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("members")
        )
        spans = self.scratch.stage(spans.select("gid", "low", (F.col("low") != F.col("_high")).alias("torn"), "members"), "join-spans")
        labelled = postings.select("shingle", "gid", "n", "pos").join(spans, "gid")
        mixed = labelled.groupBy("shingle").agg(
            F.min("low").alias("_l"), F.max("low").alias("_h"), F.max("torn").alias("_t"), F.count(F.lit(1)).alias("listed")
        )
        mixed = mixed.where("_t OR _l <> _h").select("shingle", "listed")
        return self.scratch.stage(labelled.join(mixed, "shingle"), "join-mixed")

    def hot(self, postings: DataFrame) -> DataFrame:
        """Postings of the shingles under which one component has many groups."""
        crowded = postings.groupBy("shingle", "low").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= HUB_GROUPS)
        return self.scratch.stage(postings.join(crowded.select("shingle").distinct(), "shingle", "left_semi"), "join-hot")

    def _band(self, n: Column) -> Column:
        """Sizes that leave room for the threshold are in the same band or in two next to each other, modulo 64."""
        width = np.log(max(self.join.den / self.join.num, 1.01)) * (1 + 1e-9)
        return F.pmod(F.floor(F.log(n) / F.lit(float(width))), F.lit(64)).cast("int")

    def postings(self) -> DataFrame:
        """Prefix shingles of groups, those that another group of a size near enough may share.

        Per shingle a word of 64 bits tells the bands with groups; a posting stays if a band next to its own has some,
        or if any band has several. Others could only meet sets of sizes that can't link.
        """
        bands = self.groups.select(self._band(F.col("n")).alias("band"), F.explode("prefix").alias("shingle"))
        one = _bit(F.col("band"))
        seen = bands.groupBy("shingle").agg(F.bit_or(one).alias("seen"), F.count(F.lit(1)).alias("c")).where("c > 1")
        following = F.shiftleft("seen", 1).bitwiseOR(F.shiftrightunsigned("seen", 63))
        near = seen.withColumn("several", F.col("c") > F.bit_count("seen")).withColumn("both", F.col("seen").bitwiseAND(following))
        alive = self.scratch.stage(near.where("several OR both <> 0").select("shingle", "seen", "several"), "join-alive")
        # Shingles are hashes, so their low bits are slots; a bitmap keeps most postings out of the join's shuffle.
        slot = F.col("shingle").bitwiseAND(F.lit(SLOTS - 1))
        shared = self.docs.sparkSession.sparkContext.broadcast(slot_bitmap(alive, "shingle", slot))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                shingles = lists.flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), sizes)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hit = in_slots(pa.array(shingles & (SLOTS - 1)), shared.value)
                gid, n = (batch.column(i).to_numpy()[row[hit]] for i in (0, 1))
                arrays = [pa.array(v) for v in (gid, n, pos[hit].astype(np.int32), shingles[hit])]
                yield pa.RecordBatch.from_arrays(arrays, ["gid", "n", "pos", "shingle"])

        entries = self.groups.select("gid", "n", "prefix").mapInArrow(listed, "gid bigint, n bigint, pos int, shingle bigint")
        band = self._band(F.col("n"))
        up, down = F.pmod(band + 1, F.lit(64)), F.pmod(band + 63, F.lit(64))
        beside = F.col("seen").bitwiseAND(_bit(up).bitwiseOR(_bit(down)))
        kept = entries.join(alive, "shingle").where(F.col("several") | (beside != 0)).select("gid", "n", "pos", "shingle")
        kept = self.scratch.stage(kept, "join-postings")
        shared.destroy()
        return kept

    def hubs(self, postings: DataFrame, number: int) -> bool:
        """One round against the most frequent component under each shingle; False if it joined little."""
        sizes = postings.groupBy("shingle", "low").agg(F.count(F.lit(1)).alias("c"))
        hub = sizes.groupBy("shingle").agg(F.max(F.struct("c", "low")).alias("top")).select("shingle", F.col("top.low").alias("hub"))
        marked = self.scratch.stage(postings.join(hub, "shingle"), "join-hubs")
        order = F.xxhash64("gid", F.lit(number))
        chosen = marked.where("low = hub").groupBy("shingle", F.pmod(order, F.lit(HUBS)).alias("part")).agg(
            F.min(F.struct(order.alias("o"), "gid", "n", "pos")).alias("r")
        )
        x = chosen.select("shingle", "r.gid", "r.n", "r.pos").alias("x")
        y = marked.where("low <> hub").alias("y")
        met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & self._reach())
        pairs = met.select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b"))
        return self.verify(pairs) > HUB_SHARE * marked.count()

    def rest(self, postings: DataFrame) -> None:
        """All pairs of members of different components in groups that pass the filters.

        A shingle's postings are dealt into blocks; each block meets all postings of the shingle in a task of its own.
        """
        # Both sides of the join read it, so it is made once.
        sketched = self.scratch.stage(postings.join(self.groups.select("gid", "fold"), "gid"), "join-sketched")
        blocks = F.ceil(F.col("listed") / BLOCK)
        x = sketched.withColumn("block", F.pmod(F.xxhash64("gid"), blocks)).alias("x")
        y = sketched.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).alias("y")
        apart = F.col("x.torn") | F.col("y.torn") | (F.col("x.low") != F.col("y.low"))
        met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.gid") < F.col("y.gid"))
        pairs = x.join(y, met & apart & self._reach() & self._close()).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h"))
        members = self.scratch.stage(self.labelled().select("gid", "nid", "component"), "join-members")
        torn = members.groupBy("gid").agg(F.min("component").alias("l"), F.max("component").alias("h_")).where("l <> h_")
        pairs = pairs.distinct().unionByName(torn.select(F.col("gid").alias("g"), F.col("gid").alias("h")))
        p = members.select(F.col("gid").alias("g"), F.col("nid").alias("p"), F.col("component").alias("c"))
        q = members.select(F.col("gid").alias("h"), F.col("nid").alias("q"), F.col("component").alias("d"))
        both = pairs.join(p, "g").join(q, ["h"]).where("c <> d")
        self.verify(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def similarity_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    run = _linked(docs, doc_id, text, join)
    named = run.labelled().select("node", "component", "doc")
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_node = stage(named.join(smallest, "component").select("node", "component_id"), "join-result")
    run.scratch.drop()
    rows = run.signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(by_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def _linked(docs: DataFrame, doc_id: str, text: str, join: Join) -> _Run:
    """The join with all its components found."""
    run = _Run(docs, doc_id, text, join)
    alive = run.postings()
    run.stars(alive)
    postings = run._mixed(alive)
    hot = run.hot(postings)
    for number in range(HUB_ROUNDS):
        if hot.isEmpty() or not run.hubs(hot, number):
            break
        hot = run._mixed(hot)
    run.rest(run._mixed(postings))
    return run


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """Rows of ``docs`` with all their columns: of each component the row with the smallest id.

    Rows without a shingle stay; of rows equal in id and shingles one stays, and a component without any id keeps one
    row. Only rows with an id of a component of several rows are shuffled.
    """
    run = _linked(docs, doc_id, text, join)
    labels = run.labelled().select("node", "component")
    decided = run.scratch.stage(run.signed.where("n > 0").select("doc_id", "node").join(labels, "node"), "join-decided")
    # Components go by a node, as ids can be null or come with several texts; null ids rank last.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "node"))
    chosen = decided.groupBy("component").agg(least.alias("keep"), F.count(F.lit(1)).alias("rows"))
    chosen = run.scratch.stage(chosen.where("rows > 1").select("component", "keep.id", F.col("keep.node").alias("keep_node")), "join-kept")
    torn = decided.join(chosen, "component")
    verdict = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("keep_node"))
    judged = stage(
        torn.groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).agg(F.max(verdict).alias("_stays")),
        "join-judged",
    )
    run.scratch.drop()
    bitmap = slot_bitmap(judged, "_id")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    alone = likely(docs, F.col(doc_id), shared, inside=False)
    at, k, names = docs.columns.index(text), join.words, [*docs.columns, "_row_node"]
    width = len(docs.columns)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_slots(batch.column(width), shared.value))).select(range(width))
            sets = [shingle_set(value.as_py(), k) for value in batch.column(at)]
            nodes = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names)

    schema = StructType([*docs.schema.fields, StructField("_row_node", BinaryType())])
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    slotted = docs.select(*[F.col(f"`{c}`") for c in docs.columns], slot_of(F.col(doc_id)).alias("_slot"))
    named = map_batches(slotted, name, schema).select(row, F.col(doc_id).alias("_row_id"), "_row_node")
    met = named.join(
        judged, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_node") == F.col("_node")), "left"
    ).where(F.col("_stays").isNull() | F.col("_stays"))
    same = Window.partitionBy("_row_id", "_row_node").orderBy("_stays")
    one = met.withColumn("_n", F.row_number().over(same)).where(F.col("_stays").isNull() | (F.col("_n") == 1))
    return alone.unionByName(one.select(*columns))
