"""Best-fit packing of token sequences, planned on the histogram of their lengths.

There are at most ``capacity`` different lengths, so the plan is made on counts: bins that are filled alike
are one interval of bin numbers, and the lengths go from long to short into the tightest bins that still
hold them. The plan is a list of runs; a run says which ranks of a length go to which bins. Each piece then
finds its place by its rank within its length. Neither the histogram nor the plan grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import map_texts, stored
from gradeflow.llm.subwords import REMEMBERED, subwords

CAPACITY = 1024
END = 2
# So many rows are ranked at once; a length with more is ranked in parts.
RANKED_AT_ONCE = 100_000


def best_fit(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``length, first_rank, pieces, first_bin, per_bin, start`` for the ``(length, count)`` given.

    Pieces ``first_rank`` to ``first_rank + pieces - 1`` of a length go ``per_bin`` to a bin, from
    ``first_bin`` on, the first of each at ``start``. Lengths must be from 1 to ``capacity``.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left in a bin: intervals (first bin, bins)
    runs, bins = [], 0
    for length, count in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} isn't within 1 to {capacity}")
        rank = 0
        while rank < count:
            left = count - rank
            room = min((r for r in free if r >= length), default=0)
            if room:
                first, n = free[room].pop()
                if not free[room]:
                    del free[room]
            else:
                room = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            each = min(room // length, left)
            used = min(n, left // each)
            runs.append((length, rank, used * each, first, each, capacity - room))
            if room > each * length:
                free.setdefault(room - each * length, []).append((first, used))
            if n > used:
                free.setdefault(room, []).append((first + used, n - used))
            rank += used * each
    return runs


def place(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; they have a ``length`` of 1 to ``capacity``.

    ``order`` are columns that tell pieces apart; equal ones take places of equal length in any order.
    """
    counts = [(int(r["length"]), int(r["n"])) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]
    runs = best_fit(counts, capacity)
    spark = pieces.sparkSession
    parts = spark.createDataFrame([(c, -(-n // RANKED_AT_ONCE)) for c, n in counts], "length long, parts long")
    plan = spark.createDataFrame(runs, "length long, first_rank long, pieces long, first_bin long, per_bin long, start_at long")
    # Both tables have at most some thousand rows: their size follows from the capacity alone.
    split = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(*order), "parts")).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = split.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (
        split.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)))
        .join(shifts, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("before") - 1)
    )
    own = plan.withColumnRenamed("length", "plan_length")
    fits = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces"))
    nth = F.col("rank") - F.col("first_rank")
    return ranked.join(F.broadcast(own), fits).select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("start_at") + (nth % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` as little-endian 32-bit numbers.

    A document's ids are those of its text, null as empty, and ``end``. Longer ones are cut into pieces of
    ``capacity`` ids, the first of which may be shorter.
    """
    tail = np.array([end], "<u4").tobytes()

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        coder = subwords(tokenizer, drops_space=False, remembered=remembered)
        doc, piece, start, length, crc, kept = [], [], [], [], [], []
        last, ids = None, b""
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
            if text is None or text != last:  # copies that a mix takes follow each other
                last, ids = text, coder.encode(text or "") + tail
            n = len(ids) // 4
            at, size = 0, (n - 1) % capacity + 1
            k = 0
            while at < n:
                part = ids[4 * at : 4 * (at + size)]
                doc.append(doc_id)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    kept.append(part)
                at, size, k = at + size, capacity, k + 1
        columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of :func:`token_pieces` with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Null and empty texts are the single id ``end``. Rows that repeat a document are packed as often as they
    occur; null ids are kept. An empty table gives no rows. Other columns are ignored. ``remembered`` bounds the chunks that a
    worker keeps with their ids.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, end, keep_ids, remembered), "pieces")
    return place(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
