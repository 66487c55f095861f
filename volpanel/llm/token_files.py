"""Token-id files: documents as ids, range-coded in independent blocks.

Documents are dealt to tasks by ranges of their id and sorted, tokenized, and closed with an end id. A segment holds
whole documents, about ``SEGMENT_UNITS`` units. What is coded are units: the ids of a word with the space before it, which
the segment lists once with their counts. Units are cut into blocks that are coded alone (``token_coder``) and have a
checksum each; the compressed list has one, too. Spark's own writer writes one segment per file, so files are committed atomically
to any shared store.

Layout of a segment, whole numbers little-endian: magic ``TIDS``, version (one byte), three zero bytes, task and number
within it, documents, blocks, units per block, different units (4 bytes each), units (8 bytes), length of the index (4
bytes); the index, compressed: ids and presence of ids of documents, their lengths in units, lengths and counts of the
different units, then payload length and CRC-32 of every block, then the ids of the different units; the payloads; a line
break. Task and number within it order the segments, so the reader finds every document's place by running sums, first
over tasks, then inside one.

Defined cases: null text is empty and has the end id alone; a null id sorts first; rows of one id are in the
order of a hash of their text; an empty table gives no rows; extra columns are ignored; a very long text is one document
like any other, and its segment may hold more units than that.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volpanel.llm import token_coder
from volpanel.llm.tables import stage, tasks
from volpanel.session import scratch_path

SEGMENT_UNITS = 1 << 21
#: Units that a worker remembers from one segment to the next, some 200 bytes each.
CACHED_UNITS = 1_200_000
#: New words that are tokenized as one text.
WORDS_AT_ONCE = 1000
HEAD = struct.Struct("<4sBxxxIIIIIIQI")
MAGIC, VERSION = b"TIDS", 2
DECODED = "task int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start``, ``start + 1``, ... of runs, one run after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and starts.max(initial=0) < 1 << 31 else np.int64
    return np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)


class _Numbers(dict):
    """Numbers of units of one kind; a new one takes the next number and waits for its ids."""

    def __init__(self, owner: Encoder):
        self.owner = owner
        self.waiting: list = []

    def __missing__(self, unit):
        number = self[unit] = self.owner.count
        self.owner.count += 1
        self.waiting.append(unit)
        return number


class Encoder:
    """Texts as numbers of units, with the ids of units remembered.

    A single space before a word always begins a new pre-token of a byte-level tokenizer, so words can be
    encoded apart, each with the space before it. Texts with other runs of white space around spaces, or that name a special
    token, are encoded whole, and each of their ids is a unit.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = re.compile(r" \s")
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id begins with a space, which byte-level vocabularies write as U+0120.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all units."""
        self.count = 0
        self.first, self.later, self.single = _Numbers(self), _Numbers(self), _Numbers(self)
        self.ids, self.lengths = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)

    def _tokens(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow a space, and how many are each word's.

        Many are encoded in one text, and told apart by the ids that begin with a space.
        """
        ids = self._tokens([" " + " ".join(words)])[0]
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) == len(words) and starts[0] == 0:
            return ids, np.diff(np.append(starts, len(ids)))
        alone = self._tokens([" " + w for w in words])
        return np.concatenate(alone), np.array([len(a) for a in alone])

    def units(self, text: str | None) -> np.ndarray:
        """Numbers of the units of a text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        if text[0] == " " or text[-1] == " " or self.runs.search(text) or any(s in text for s in self.special):
            return self.singles(self._tokens([text])[0])
        words = text.split(" ")
        found = np.empty(len(words), dtype=np.int32)
        found[0] = self.first[words[0]]
        found[1:] = np.fromiter(map(self.later.__getitem__, words[1:]), np.int32, len(words) - 1)
        return found

    def singles(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of units of one id each."""
        return np.fromiter(map(self.single.__getitem__, ids.tolist()), np.int32, len(ids))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of all units, and their ids one after the other."""
        kinds = (self.later, self.first, self.single)
        later, first, single = (kind.waiting for kind in kinds)
        if later or first or single:
            numbers = np.fromiter((kind[unit] for kind in kinds for unit in kind.waiting), np.int64)
            found = [self._words(later[at : at + WORDS_AT_ONCE]) for at in range(0, len(later), WORDS_AT_ONCE)]
            found += [(ids, np.array([len(ids)])) for ids in self._tokens(first)]
            found += [(np.array(single, dtype="<u4"), np.ones(len(single), dtype=np.int64))]
            ids, lengths = (np.concatenate(part) for part in zip(*found))
            order = np.argsort(numbers)
            ids = ids[spread((np.cumsum(lengths) - lengths)[order], lengths[order])]
            self.ids, self.lengths = np.append(self.ids, ids), np.append(self.lengths, lengths[order])
            for kind in kinds:
                kind.waiting = []
        return self.lengths, self.ids

    def forget(self, docs: list[np.ndarray]) -> None:
        """Count the uses of units by documents that are done; with too many units known, keep those used repeatedly."""
        uses = np.bincount(np.concatenate(docs), minlength=len(self.lengths))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        if len(uses) <= CACHED_UNITS:
            return
        kept = np.flatnonzero(uses > 1)
        if len(kept) > CACHED_UNITS // 2:
            self.clear()
            return
        number = np.full(len(uses), -1)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        for kind in (self.first, self.later, self.single):
            left = [(unit, number[old]) for unit, old in kind.items() if number[old] >= 0]
            kind.clear()
            kind.update(left)
        self.ids = self.ids[spread((np.cumsum(self.lengths) - self.lengths)[kept], self.lengths[kept])]
        self.lengths, self.uses, self.count = self.lengths[kept], uses[kept], len(kept)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as bytes, four a piece."""
        units = self.units(text)
        lengths, ids = self.table()
        return ids[spread((np.cumsum(lengths) - lengths)[units], lengths[units])].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One tokenizer per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_units(
    task: int, seq: int, doc_ids: list[int | None], docs: list[np.ndarray], lengths: np.ndarray, ids: np.ndarray
) -> bytes:
    """A segment of whole documents, given as numbers of units; ``lengths`` and ``ids`` tell what the units hold."""
    units = np.concatenate([np.zeros(0, dtype=np.int32), *docs])
    counts = np.bincount(units, minlength=len(lengths))
    used = np.flatnonzero(counts)
    used = used[np.argsort(-counts[used], kind="stable")]
    symbol = np.zeros(len(lengths), dtype=np.int64)
    symbol[used] = np.arange(len(used))
    ids = ids[spread((np.cumsum(lengths) - lengths)[used], lengths[used])].astype("<u4")
    counts, lengths, coded = counts[used], lengths[used], symbol[units]
    block = token_coder.block_size(len(coded))
    payloads = token_coder.encode(coded, block, token_coder.levels_for(len(used)), counts)
    columns = [([0 if d is None else d for d in doc_ids], "<i8"), ([d is not None for d in doc_ids], "u1")]
    columns += [([len(d) for d in docs], "<u4"), (lengths, "<u4"), (counts, "<u4")]
    columns += [([len(p) for p in payloads], "<u4"), (_sums(coded, block), "<u4"), (ids, "<u4")]
    index = zlib.compress(b"".join(np.asarray(values, dtype=kind).tobytes() for values, kind in columns), 1)
    head = HEAD.pack(MAGIC, VERSION, task, seq, len(docs), len(payloads), block, len(used), len(coded), len(index))
    return b"".join([head, index, *payloads])


def _sums(coded: np.ndarray, block: int) -> list[int]:
    """Checksum of every block's units."""
    data = coded.astype("<u4")
    return [zlib.crc32(data[at : at + block]) for at in range(0, len(data), block)]


def pack_segment(task: int, seq: int, doc_ids: list[int | None], bodies: list[bytes]) -> bytes:
    """A segment of whole documents; every body holds ids of four bytes, and each id is a unit."""
    ids, units = np.unique(np.frombuffer(b"".join(bodies), dtype="<u4"), return_inverse=True)
    docs = np.split(units, np.cumsum([len(b) // 4 for b in bodies])[:-1])
    return pack_units(task, seq, doc_ids, docs, np.ones(len(ids), dtype=np.int64), ids)


def unpack_segment(data: bytes) -> tuple[int, int, list[int | None], list[bytes]]:
    """Task, number within it, document ids and bodies of a segment; damaged blocks raise an error."""
    magic, version, task, seq, n_docs, n_blocks, block, n_used, n_coded, length = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("no segment of token ids")
    at = HEAD.size + length
    try:
        index = zlib.decompress(data[HEAD.size : at])
    except zlib.error as wrong:
        raise ValueError(f"the index of segment {task}/{seq} is damaged") from wrong
    widths = [8 * n_docs, n_docs, 4 * n_docs, 4 * n_used, 4 * n_used, 4 * n_blocks, 4 * n_blocks]
    cuts = np.cumsum([0, *widths]).tolist() + [len(index)]
    doc_ids, present, sizes, lengths, counts, payload, sums, ids = (
        np.frombuffer(index[a:b], dtype=kind)
        for a, b, kind in zip(cuts, cuts[1:], ("<i8", "u1", "<u4", "<u4", "<u4", "<u4", "<u4", "<u4"))
    )
    payloads = []
    for n in payload.tolist():
        payloads.append(data[at : at + n])
        at += n
    coded = token_coder.decode(payloads, n_coded, block, token_coder.levels_for(n_used), counts)
    for i, (found, expected) in enumerate(zip(_sums(coded, block), sums.tolist())):
        if found != expected:
            raise ValueError(f"block {i} of segment {task}/{seq} is damaged")
    lengths = lengths.astype(np.int64)
    sizes_of = lengths[coded]
    whole = ids[spread((np.cumsum(lengths) - lengths)[coded], sizes_of)]
    edges = np.concatenate([[0], np.cumsum(sizes_of)])
    ends = edges[np.cumsum(np.append(0, sizes), dtype=np.int64)].tolist()
    bodies = [whole[a:b].tobytes() for a, b in zip(ends, ends[1:])]
    return task, seq, [d if p else None for d, p in zip(doc_ids.tolist(), present.tolist())], bodies


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0
) -> None:
    """Write the ids of all documents below ``path`` in ascending order of their id."""
    end = np.array([end_id])
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = given.repartitionByRange(tasks(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, ids, docs, held = TaskContext.get().partitionId(), 0, [], [], 0
        coder = encoder(tokenizer)

        def close() -> pa.RecordBatch:
            packed = pack_units(task, seq, ids, docs, *coder.table())
            coder.forget(docs)
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["segment"])

        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                units = np.append(coder.units(value.as_py()), coder.singles(end))
                ids.append(doc.as_py())
                docs.append(units)
                held += len(units)
                if held >= SEGMENT_UNITS:
                    yield close()
                    seq, ids, docs, held = seq + 1, [], [], 0
        if ids:
            yield close()

    # The text writer puts a string's bytes as they are and a separator after each.
    (
        ordered.mapInArrow(segments, "segment binary")
        .select(F.col("segment").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if not data:
                    continue
                task, seq, doc_ids, bodies = unpack_segment(data)
                sizes = np.asarray([len(b) // 4 for b in bodies], dtype=np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "task": pa.array([task] * len(sizes), pa.int32()),
                        "seq": pa.array([seq] * len(sizes), pa.int32()),
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "within": pa.array(np.cumsum(sizes) - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids_crc32": pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                    }
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    docs = stage(files.mapInArrow(decoded, DECODED), "token-docs")
    parts = docs.groupBy("task", "seq").agg(F.sum("n_tokens").alias("n"))
    by_task = parts.groupBy("task").agg(F.sum("n").alias("n"))
    # One row per task of the writing job.
    first = by_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"))
    inside = F.sum("n").over(Window.partitionBy("task").orderBy("seq")) - F.col("n")
    base = parts.select("task", "seq", inside.alias("before")).join(first, "task")
    base = base.select("task", "seq", (F.col("first") + F.col("before")).alias("base"))
    return docs.join(base, ["task", "seq"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_token_files(docs, path, tokenizer, end_id=end_id)
    return read_token_files(docs.sparkSession, path)
