"""Token ids in files: canonical length-limited Huffman codes, blocks that are decoded on their own.

A dataset is a folder with three tables that Spark writes and reads wherever it can write:

``code``    one row per id that occurs: ``id, length``. Codes are canonical: by length, then id.
``blocks``  whole documents in ascending order of ``doc_id``: ``file, block, before, doc_ids, n_tokens, marks, payload``.
            ``before`` is the number of ids in earlier blocks of the file. ``payload`` holds the codes, first bit highest. ``marks`` are the bit offsets of every ``EVERY``-th id,
            so that a reader can decode all stretches between them at once.
``files``   one row per file: ``file, n_ids, start``, where ``start`` is the number of ids in the files before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm.common import map_texts, ship, stored
from gradeflow.llm.subwords import subwords

LONGEST = 16
EVERY = 256
BLOCK_IDS = 1 << 18


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The lengths of an optimal code without any above ``longest`` (package-merge); counts must be positive."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    kinds, packages = [], np.empty(0, np.int64)
    for _ in range(longest):
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        kinds.append(rank < n)
        both = both[rank][: len(rank) // 2 * 2]
        packages = both[::2] + both[1::2]
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    made = np.empty(n, np.int64)
    made[order] = lengths
    return made


class Code:
    """A canonical code: arrays to encode by id, tables to decode by the next bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(lengths.max(initial=1))
        # A code is the sum of what the codes before it take of the code space.
        spans = np.int64(1) << (self.bits - lengths)
        first = np.cumsum(spans) - spans
        size = int(ids.max(initial=0)) + 1
        self.word, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.word[ids], self.length[ids] = (first >> (self.bits - lengths)).astype(np.uint64), lengths
        total = int(spans.sum())
        self.symbol_at = np.zeros(1 << self.bits, np.uint32)
        self.length_at = np.ones(1 << self.bits, np.int64)
        self.symbol_at[:total], self.length_at[:total] = np.repeat(ids, spans), np.repeat(lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes in a row, and the bit offset of every ``EVERY``-th id."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        words = int(ends[-1] + 31) // 32 + 1 if len(ids) else 1
        # Each code lies in two neighbouring 32-bit words at most; codes don't overlap, so sums join them.
        shifted = self.word[ids] << (64 - lengths - begins % 32).astype(np.uint64)
        at = begins // 32
        made = np.bincount(at, shifted >> np.uint64(32), words) + np.bincount(at + 1, shifted & np.uint64(0xFFFFFFFF), words + 1)[:words]
        return made.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8 if len(ids) else 0], begins[::EVERY]

    def decode(self, payload: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block: one step decodes an id of every stretch between two marks."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        last, shift = len(windows) - 1, np.uint32(32 - self.bits)
        at, made = marks.astype(np.int64), np.empty((EVERY, len(marks)), np.uint32)
        for step in range(min(EVERY, n)):
            window = windows[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
            code = window >> shift
            made[step] = self.symbol_at[code]
            at += self.length_at[code]
        return made.T.ravel()[:n]


def token_ids(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, null as empty, and ``end``, as little-endian 16-bit numbers."""
    tail = np.array([end], "<u2").tobytes()

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        coder = subwords(tokenizer, drops_space=True, kind="<u2")
        ids = [made + tail for made in coder.encode_all([text or "" for text in rows.column("text").to_pylist()])]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, ids binary")


def global_counts(ids: DataFrame) -> DataFrame:
    """``id, n`` of all ids in a table of :func:`token_ids`; each task sends a row per id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary())
            _, starts, data = column.buffers()
            bounds = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
            if data is not None:
                total += np.bincount(np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view("<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    ship(ids.sparkSession)
    return ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "file int, block int, before long, doc_ids array<long>, n_tokens array<long>, marks array<long>, payload binary"


def write_ids(ids: DataFrame, folder: str, longest: int = LONGEST) -> None:
    """Write a table of :func:`token_ids` in ascending ``doc_id``, null first, rows of equal ids in the order of a hash of their bytes."""
    spark = ids.sparkSession
    # One row per id of the vocabulary, which has at most 65,536.
    counts = np.array([tuple(r) for r in global_counts(ids).collect()], np.int64).reshape(-1, 2)
    counts = counts[np.argsort(counts[:, 0])]
    lengths = code_lengths(counts[:, 1], longest)
    known = counts[:, 0].copy()
    spark.createDataFrame(list(zip(known.tolist(), lengths.tolist(), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{folder}/code")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, number = Code(known, lengths), TaskContext.get().partitionId(), 0
        docs, parts, size, before = [], [], 0, 0

        def block() -> pa.RecordBatch:
            payload, marks = code.encode(np.concatenate(parts))
            values = [file, number, before, docs, [len(p) for p in parts], marks.tolist(), payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(doc_id)
                parts.append(np.frombuffer(value.as_buffer(), "<u2"))
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    docs, parts, size, number, before = [], [], 0, number + 1, before + size
        if docs:
            yield block()

    ship(spark)
    # Ranges are sampled from numbers alone: rows of one id go by a hash of their bytes, so its order is the hash's, then the bytes'.
    ordered = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").drop("tie")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    made = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # One row per file, as many as the write had tasks.
    sums = made.groupBy("file").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).orderBy("file").collect()
    starts = np.cumsum([0, *(r["n"] for r in sums)]).tolist()
    rows = [(r["file"], r["n"], s) for r, s in zip(sums, starts, strict=False)]
    spark.createDataFrame(rows, "file int, n_ids long, start long").coalesce(1).write.parquet(f"{folder}/files")


@lru_cache(maxsize=2)
def _code(ids: bytes, lengths: bytes) -> Code:
    return Code(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64))


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, and its ``ids`` (32 bits each) if asked for.

    ``start`` counts the ids of all documents before; the CRC-32 is of the ids as little-endian 32-bit numbers.
    """
    rows = spark.read.parquet(f"{folder}/code").collect()  # one row per id of the vocabulary
    known = np.array([r["id"] for r in rows], np.int64).tobytes()
    lengths = np.array([r["length"] for r in rows], np.int64).tobytes()
    files = spark.read.parquet(f"{folder}/files").select("file", "start")  # one row per task of the write
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    placed = blocks.join(F.broadcast(files), "file").withColumn("start", F.col("start") + F.col("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(known, lengths)
        for batch in batches:
            for docs, sizes, marks, payload, start in zip(*(batch.column(c) for c in ("doc_ids", "n_tokens", "marks", "payload", "start")), strict=True):
                counts = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(counts)
                ids = code.decode(payload.as_py(), np.array(marks.as_py(), np.int64), int(ends[-1])).astype("<u4")
                each = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(docs.as_py(), pa.int64()), pa.array(ends - counts + start.as_py()), pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(each, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return placed.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """Encode ``docs`` with the tokenizer, write them to a new folder, and read them back.

    Null and empty texts have the single id ``end``. Rows that repeat a ``doc_id`` follow each other; a null ``doc_id``
    comes first. An empty table gives empty files. Other columns are ignored.
    """
    write_ids(stored(token_ids(docs, tokenizer, end), "ids"), folder)
    return read_ids(docs.sparkSession, folder, keep_ids)
