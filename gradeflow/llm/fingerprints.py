"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hash of each of its prefixes, as a polynomial of its code points modulo a
prime. The hash of any span follows from two entries, so two spans are compared in constant time, and the longest
common extension of two positions is found by binary search.

A fingerprint is the hash of the whole text and the least hashes of its 16-character spans. The share that
two fingerprints have among their common least hashes estimates the Jaccard similarity of the texts' spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import ship

PRIME = (1 << 31) - 1
# Two bases, so that equal hashes of unequal spans are as rare as with one prime of 62 bits.
BASES = (1_103_515_245, 1_664_525_013)
SPAN = 16
LEAST = 64
SLICES = 256
_P = np.uint64(PRIME)


def _modulo(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the Mersenne prime, for ``x`` below 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x == _P, np.uint64(0), x)


class _Powers:
    """Powers of a number modulo the prime; grows by doubling."""

    def __init__(self, base: int) -> None:
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), PRIME))
            self.known = np.concatenate((self.known, _modulo(self.known * step)))
        return self.known[:n]


_UP = tuple(_Powers(b) for b in BASES)
_DOWN = tuple(_Powers(pow(b, -1, PRIME)) for b in BASES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        codes = code_points(text).astype(np.uint64) + np.uint64(1)
        self.size = len(codes)
        self.prefix = []
        for up in _UP:
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum(_modulo(codes * up(self.size)), out=sums[1:])
            self.prefix.append(_modulo(sums))

    def spans(self, length: int, base: int = 0) -> np.ndarray:
        """The hash of every span of ``length`` characters."""
        sums, n = self.prefix[base], self.size - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return _modulo((sums[length:] + _P - sums[:n]) * _DOWN[base](n))

    def span(self, start: int, length: int) -> tuple[int, int]:
        """The hash of one span; with equal lengths, spans are equal if and only if (but for rare chance) these are."""
        return tuple(
            (int(sums[start + length]) - int(sums[start])) * int(down(start + 1)[start]) % PRIME
            for sums, down in zip(self.prefix, _DOWN, strict=True)
        )

    def whole(self) -> int:
        high, low = self.span(0, self.size)
        return high << 31 | low


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """How many characters from ``i`` in ``a`` on equal those from ``j`` in ``b`` on."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a.span(i, middle) == b.span(j, middle) else (low, middle - 1)
    return low


def least_spans(hashes: PrefixHashes) -> np.ndarray:
    """The ``LEAST`` least distinct 32-bit span hashes; of a text shorter than a span, that of the text."""
    if not hashes.size:
        return np.empty(0, np.uint32)
    found = hashes.spans(min(SPAN, hashes.size))
    spread = (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    few = spread[spread < np.uint64(min(1 << 32, (1 << 32) * 4 * LEAST // len(spread)))]
    least = np.unique(few)
    if len(least) < LEAST:
        least = np.unique(spread)
    return least[:LEAST].astype(np.uint32)


def fingerprint(text: str) -> str:
    """Equal texts have equal fingerprints."""
    return fingerprint_of(PrefixHashes(text))


def fingerprint_of(hashes: PrefixHashes) -> str:
    return f"{hashes.whole():016x}{least_spans(hashes).astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """From 0, nothing in common, to 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = ({f[k : k + 8] for k in range(16, len(f), 8)} for f in (a, b))
    least = sorted(x | y)[:LEAST]
    return sum(v in x and v in y for v in least) / len(least) if least else 1.0


def _half_replaced(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compared(rows: list[tuple], following: list[tuple]) -> pd.DataFrame:
    last: tuple[str, PrefixHashes, str] | None = None  # what follows a text is mostly the next row's own

    def of(text: str) -> tuple[str, PrefixHashes, str]:
        if last is not None and last[0] == text:
            return last
        hashes = PrefixHashes(text)
        return text, hashes, fingerprint_of(hashes)

    made = []
    for (doc_id, text), (_, other) in zip(rows, following, strict=True):
        edited = _half_replaced(text, other)
        _, hashes, own = of(text)
        changed = PrefixHashes(edited)
        print_changed = fingerprint_of(changed)
        last = of(other)
        made.append((
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, print_changed, likeness(own, print_changed), likeness(own, last[2]),
            common_extension(hashes, 0, changed, 0), common_extension(hashes, 0, last[1], 0),
        ))
    return pd.DataFrame(made, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def neighbour_fingerprints(docs: DataFrame, slices: int = 0) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document, and how many characters it begins with in common with both.

    Documents are taken in descending ``doc_id``, null ids last, equal ids by text, null texts as empty; after the
    last comes the first. The edited text has its last ``n // 2`` characters replaced by the first as many of the
    next document's. Other columns are ignored; an empty table gives no rows.

    The ids are cut into slices at ids that occur, at least ``SLICES`` and more as the session has more shuffle
    partitions. A slice is sorted on its own and needs one row of the slice below, its greatest, which is a copy of
    the row at the cut.
    """
    slices = slices or max(SLICES, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # About even cuts at ids that occur: at most ``slices`` numbers come to the driver.
    least, most, cuts = rows.agg(
        F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / slices for k in range(1, slices)], 100 * slices)
    ).first()
    cuts = sorted({*(cuts or [])} - {most})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # Slice k has the ids above cut k - 1 up to cut k; null ids are below all others.
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(_slice_of(F.col("doc_id"), cuts))
    at_cut = F.array_contains(bounds, F.col("doc_id"))
    # What follows the least row of slice k is the greatest of slice k - 1, so that goes to slice k as well.
    wrapped = F.col("doc_id") == F.lit(most) if most is not None else F.lit(True)
    places = F.array(
        F.struct(own.alias("slice"), F.lit(False).alias("copy")),
        F.when(at_cut, F.struct((own + 1).alias("slice"), F.lit(True).alias("copy"))),
        F.when(wrapped, F.struct(F.lit(0).alias("slice"), F.lit(True).alias("copy"))),
    )
    dealt = (
        rows.withColumn("place", F.explode(F.array_compact(places)))
        .select("place.slice", "place.copy", "doc_id", "text")
        .repartition("slice")
        .sortWithinPartitions("slice", "copy", F.col("doc_id").desc_nulls_last(), "text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            mine, after = [], []
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for piece, copy, doc_id, text in zip(batch["slice"], batch["copy"], ids, batch["text"], strict=True):
                if held is not None and held[0] == piece:
                    mine.append(held[1])
                    after.append((doc_id, text))
                held = None if copy else (piece, (doc_id, text))
            for at in range(0, len(mine), 2000):
                yield _compared(mine[at : at + 2000], after[at : at + 2000])

    ship(docs.sparkSession)
    return dealt.mapInPandas(run, SCHEMA)


def _slice_of(key, cuts: list[int]):
    """How many cuts are below the key, by halving: a chain of comparisons as deep as the number of cuts has bits."""

    def between(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key <= F.lit(cuts[middle]).cast("long"), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(cuts))
