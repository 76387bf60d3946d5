"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles, and 64 minwise tokens stand for the set. Each tree starts
with all sets at its root. A node picks one token position, sometimes two (1 / similarity on average), and
hands each set to the child named by its token there, so that similar sets are expected to stay together
once per level. Nodes small enough are compared exhaustively, others branch on. Independent trees raise the
recall: there are at least ``TREES``, and so many more that two sets at the least similarity share a compared node with a
probability of ``RECALL`` at the depth that the trees have reached (:func:`trees_for`). Nodes that ``DEPTH`` levels don't bring apart are compared exhaustively.

Large groups of near copies come apart slowly. So in each large node ``DRAWN`` sets are compared with all before it
branches, and sets that are already in one component need no further comparison: a node is done when all its sets are in
one, and when at most ``SMALL`` are outside its largest component, these are compared with everyone. A comparison gives
links that join components, one fewer than it joins, not all similar pairs. Two sets that were in such a node together
have been compared or joined; no other node compares them again.

Equal sets are one set from the start. All similarities are confirmed on full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import in_files, map_texts, ship, small_side, stored
from gradeflow.llm.components import stars
from gradeflow.llm.hashing import mixed, shingle_hashes, word_hashes, words_of

# At least so many trees, and the recall that further ones are added for where nodes are deep.
TREES = 13
RECALL = 0.99
TOKENS = 64
# A node with so many sets outside its largest component is compared exhaustively.
SMALL = 1024
# In a larger node so many sets, drawn by hash, are compared with all others before it branches.
DRAWN = 32
# Sets of a node are compared in slices of about so many, each with the few that are compared with all.
SLICE = 1024
# Large nodes go down two levels at once, those of more than STEP_SIZE sets STEPS levels.
STEP_SIZE, STEPS = 1024, 3
# Levels after which a node isn't branched any more but compared exhaustively: its sets then agree in most tokens.
DEPTH = 48
# First-level nodes of more sets aren't searched for close sketches: all their sets count as candidates. It bounds the search for each set.
SEARCHED = 4096
# Cells of the largest table of sets by shingles that a task makes; beyond it sets are compared one by one.
DENSE = 1 << 23
# Sets that a task compares, on average.
TASK_ROWS = 2000
# Trees that start in each round: what the first ones link needs no comparison in the later ones.
STARTED = (2, 5, 6)
SIGMAS = 6.3

_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, TOKENS), dtype=np.uint64)
_XOR, _MUL = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order; A to Z count as a to z."""
    found = words_of(data, offsets)
    hashes, bounds = shingle_hashes(word_hashes(data, found, lower=True), found.bounds, words)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def minwise(shingles: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The minwise tokens of a set that isn't empty, and two bits of each as two 64-bit numbers."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    tokens = mixed(least)
    bits = [int(np.packbits((tokens >> np.uint64(at)).astype(np.uint8) & 1).view(np.int64)[0]) for at in (40, 41)]
    return tokens.astype(np.uint32).view(np.int32), *bits


def _apart(one: Column, two: Column) -> Column:
    """In how many tokens two sketches differ, as far as two bits of each tell."""
    return F.bit_count(one["a"].bitwiseXOR(two["a"]).bitwiseOR(one["b"].bitwiseXOR(two["b"])))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, tokens, bits``; equal sets have equal set ids, empty ones have null."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        sets = shingle_sets(data, offsets, words)
        made = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), *minwise(s)) if len(s) else (None,) * 4 for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([x[0] for x in made], pa.binary()),
                pa.array([x[1] for x in made], pa.list_(pa.int32())),
                pa.StructArray.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (2, 3)], ["a", "b"]),
            ],
            ["doc_id", "n_shingles", "set_id", "tokens", "bits"],
        )

    schema = "doc_id long, n_shingles long, set_id binary, tokens array<int>, bits struct<a:long,b:long>"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def _children(node: Column, rate: float) -> Column:
    """The children that a set with ``tokens`` goes to: one, or two so often that ``rate`` is their mean."""
    at = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TOKENS)).cast("int")
    other = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TOKENS)).cast("int")
    chosen = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(10_000)) < round((rate - 1) * 10_000)
    child = lambda place: F.xxhash64(node, place, F.get("tokens", place))
    return F.when(chosen & (at != other), F.array(child(at), child(other))).otherwise(F.array(child(at)))


def _branches(large: DataFrame, reps: DataFrame, rate: float) -> DataFrame:
    """The rows of large nodes some levels further down. Their tokens travel with them from there on."""
    known = large.where("tokens is not null").select("id", "bits", "sets", "node", "tokens")
    # A set's tokens are fetched once, however many trees it has large nodes in.
    fresh = large.where("tokens is null").groupBy("id").agg(F.collect_list(F.struct("bits", "sets", "node")).alias("places"))
    fetched = fresh.join(reps.select("id", "tokens"), "id").withColumn("place", F.explode("places"))
    made = known.unionByName(fetched.select("id", "place.*", "tokens"))
    nodes = F.array("node")
    for step in range(STEPS):
        further = F.flatten(F.transform(nodes, lambda node: _children(node, rate)))
        nodes = further if step < 2 else F.when(F.col("sets") > STEP_SIZE, further).otherwise(nodes)
    made = made.withColumn("node", F.explode(nodes))
    return made.select("id", "bits", "node", "tokens")


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, shingles`` of the documents named: sorted 64-bit hashes as bytes."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        sets = [s.tobytes() for s in shingle_sets(data, offsets, words)]
        return pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return map_texts(wanted, work, "id long, shingles binary")


def trees_for(recall: float, least: float, depth: int) -> int:
    """So many trees that two sets of similarity ``least`` share a node at ``depth`` in one of them with probability ``recall``.

    In one tree that is the survival of a branching process: a node takes one position, or two so often that ``1 / least``
    is the mean, and each keeps the two sets together with probability ``least``.
    """
    kept, second = 1.0, 1 / least - 1
    for _ in range(depth):
        apart = 1 - least * kept
        kept = 1 - (1 - second) * apart - second * apart * apart
    return 1 if kept >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - kept))


def _roots(reps: DataFrame, first: int, end: int, rate: float) -> DataFrame:
    """``id, bits, tree, node, sets``: the sets at the first level of some trees and how many are in their node, without nodes that one set has alone."""
    starts = F.explode(F.array(*[F.lit(t).cast("long") for t in range(first, end)])).alias("tree")
    rows = reps.select("id", "bits", "tokens", starts).select("id", "bits", "tree", F.explode(_children(F.col("tree"), rate)).alias("node"))
    shared = rows.groupBy("node").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("sets")).where("least < most")
    return stored(rows.join(shared.select("node", "sets"), "node").select("id", "bits", "tree", "node", "sets"), "roots", round(rate * (end - first) * reps.count()))


def _inside(rows: DataFrame, exhaustive: bool) -> DataFrame:
    """Rows ``id, bits, part, done, node, tokens`` of the nodes of more than one part, with ``sets`` and ``outside``, how many sets
    are in the node and outside its largest part, and ``few``, whether the row is compared with all others.
    """
    parts = rows.groupBy("node", "part").agg(F.count("*").alias("n"))
    nodes = (
        parts.groupBy("node")
        .agg(F.sum("n").alias("sets"), F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("node", "sets", (F.col("sets") - F.col("top.n")).alias("outside"), F.col("top.part").alias("top"))
    )
    drawn = F.pmod(F.xxhash64("node", "id", F.lit(4)), F.col("outside")) < DRAWN
    few = (F.col("part") != F.col("top")) & (F.lit(exhaustive) | (F.col("outside") <= SMALL) | drawn)
    return stored(rows.join(nodes, "node").withColumn("few", few).drop("top"), "inside", rows.count())


def _meetings(inside: DataFrame, most_apart: int) -> DataFrame:
    """``node, slice, id, part, few``: whom to compare. The few of a node meet all others, slice by slice.

    A set is at home in one slice of its node; the few visit all others. Sets without a partner, by their sketches and the
    nodes they are done with, are left out of a slice. No slice has more than about ``SLICE`` sets and the few.
    """
    slices = F.ceil(F.col("sets") / SLICE)
    own = F.pmod(F.xxhash64("id", F.lit(5)), slices)
    at = F.when(F.col("few"), F.sequence(F.lit(0).cast("long"), slices - 1)).otherwise(F.array(own))
    there = inside.withColumn("slice", F.explode(at)).select("node", "slice", "id", "part", "done", "bits", "few", (F.col("slice") == own).alias("home"))
    close = (
        (F.col("one.node") == F.col("two.node"))
        & (F.col("one.slice") == F.col("two.slice"))
        & (F.col("one.part") != F.col("two.part"))
        & (F.col("one.few") | F.col("two.few"))
        & (F.col("one.home") | F.col("two.home"))
        & (_apart(F.col("one.bits"), F.col("two.bits")) <= most_apart)
        & ~F.coalesce(F.arrays_overlap("one.done", "two.done"), F.lit(False))
    )
    return there.alias("one").join(there.alias("two"), close, "left_semi").select("node", "slice", "id", "part", "few")


def _joined(few: list[tuple], others: list[tuple], numerator: int, denominator: int) -> Iterator[tuple[int, int]]:
    """Links that join all parts with similar sets, one of them among the few: from each part to the least that it is joined with."""
    rows = [*few, *others]
    sizes = np.array([len(r[2]) for r in rows])
    parts = np.array([r[1] for r in rows])
    _, place, times = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
    different, several = len(times), np.flatnonzero(times > 1)
    ends = np.cumsum(sizes)
    dense = len(several) * len(rows) <= DENSE
    if dense:  # what one set has alone isn't shared
        column = np.full(different, -1)
        column[several] = np.arange(len(several))
        column, held = column[place], np.zeros((len(rows), len(several)), np.float32)
        held[np.repeat(np.arange(len(rows)), sizes)[column >= 0], column[column >= 0]] = 1
        all_shared = (held[: len(few)] @ held.T).astype(np.int64)
    root: dict[int, int] = {}

    def find(part: int) -> int:
        while part in root:
            part = root[part]
        return part

    for i in range(len(few)):
        if dense:
            shared = all_shared[i]
        else:
            own = np.zeros(different, np.int32)
            own[place[ends[i] - sizes[i] : ends[i]]] = 1
            shared = np.add.reduceat(own[place], ends - sizes)
        enough = denominator * shared >= numerator * (sizes[i] + sizes - shared)
        for part in np.unique(parts[enough]).tolist():
            a, b = find(part), find(int(parts[i]))
            if a != b:
                root[max(a, b)] = min(a, b)
    for part in root:
        yield part, find(part)


def _compared(meetings: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links ``a, b`` of parts that have similar sets, by their full sets: in each slice as few as join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, few, others = None, [], []

        def links() -> pa.RecordBatch:
            found = list(_joined(few, others, numerator, denominator)) if few and len(few) + len(others) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c) for c in ("node", "slice", "few", "id", "part", "shingles")]
            for node, piece, is_few, doc, part, shingles in zip(*(c.to_pylist() for c in columns[:5]), columns[5], strict=True):
                if (node, piece) != key:
                    yield links()
                    key, few, others = (node, piece), [], []
                (few if is_few else others).append((doc, part, np.frombuffer(shingles.as_py(), np.uint64)))
        yield links()

    ship(sets.sparkSession)
    met = sets.join(small_side(meetings), "id")
    dealt = met.select("node", "slice", "few", "id", "part", "shingles").repartition("node", "slice").sortWithinPartitions("node", "slice", "few", "id")
    return in_files(dealt.mapInArrow(run, "a long, b long"), meetings.count(), TASK_ROWS)


def _close_roots(roots: DataFrame, most_apart: int) -> DataFrame:
    """The rows of :func:`_roots` whose set has a partner with a close sketch in their node; all rows of nodes of more than ``SEARCHED`` sets.

    What is left out could only be compared in vain, there and further down.
    """
    one, two = roots.where(F.col("sets") <= SEARCHED).alias("one"), roots.where(F.col("sets") <= SEARCHED).alias("two")
    close = (F.col("one.node") == F.col("two.node")) & (F.col("one.id") != F.col("two.id")) & (_apart(F.col("one.bits"), F.col("two.bits")) <= most_apart)
    return stored(one.join(two, close, "left_semi").union(roots.where(F.col("sets") > SEARCHED)).drop("sets"), "close", roots.count())


def _relabelled(labels: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """``id, label`` after links between labels, about ``rows`` at most: those of joined components become their least."""
    newer = stars(links, rows=rows).select(F.col("a").alias("label"), F.col("b").alias("newer"))
    if newer.isEmpty():
        return labels
    moved = labels.join(newer, "label", "left").select("id", F.coalesce("newer", "label").alias("label"))
    return stored(moved.union(newer.select("label", "newer")), "labels", labels.count() + newer.count())


def _compared_whole(inside: DataFrame, exhaustive: bool) -> DataFrame:
    """``id, at`` of the nodes whose sets have all met those of other parts. ``at`` has the bits too: an id may have several sets."""
    whole = inside if exhaustive else inside.where(F.col("outside") <= SMALL)
    return whole.select("id", F.struct("bits", "node").alias("at"))


def _placed(rows: DataFrame, labels: DataFrame, whole: DataFrame, about: int) -> DataFrame:
    """``rows``, ``about`` so many, with ``part``, the component of a set, and ``done``, the nodes of :func:`_compared_whole` that it was in."""
    known = labels.select("id", "label", F.lit(None).alias("at")).union(whole.select("id", F.lit(None), "at"))
    known = known.groupBy("id").agg(F.max("label").alias("label"), F.collect_set("at").alias("ats"))
    own = F.filter("ats", lambda at: at["bits"] == F.col("bits"))
    with_part = rows.join(known, "id", "left").withColumn("part", F.coalesce("label", "id"))
    return stored(with_part.withColumn("done", F.transform(own, lambda at: at["node"])).drop("label", "ats"), "placed", about)


def near_duplicates(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked whose sets of lower-cased (A to Z) ``words``-word shingles have a Jaccard
    similarity of at least ``numerator / denominator``, one half or more; fewer words make one shingle. ``component_id`` is the least
    ``doc_id`` that links lead to; ``kept`` marks that document. Null and empty texts are linked with nothing.
    Rows that repeat a ``doc_id`` are one document: what is similar to one of its texts is linked to it.
    A row without ``doc_id`` gets a null component and is kept. An empty table gives no rows. Texts of any length count whole; a comparison holds
    the sets of one slice. Other columns are ignored.
    """
    least = numerator / denominator
    agree = least + (1 - least) / 4  # other tokens agree in both bits once in four times
    most_apart = int(TOKENS * (1 - agree) + SIGMAS * (TOKENS * agree * (1 - agree)) ** 0.5)
    made = stored(sketches(docs, words), "sketches")
    # Equal sets are one; the least document stands for them.
    sets = made.where("set_id is not null and doc_id is not null")
    reps = stored(sets.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits")), "reps", made.count())
    labels = docs.sparkSession.range(0).select("id", F.col("id").alias("label"))
    whole = labels.select("id", F.lit(None).cast("struct<bits:struct<a:long,b:long>,node:long>").alias("at"))
    roots, shingles, known = None, None, None  # of the trees prepared so far, and the full sets of their candidates
    branching, level, started, prepared, needed, depth, deepest, about = None, 0, 0, 0, trees, 1, 1, 0
    while started < needed or branching is not None:
        exhaustive, rows = depth >= DEPTH, branching
        if started == prepared < needed:
            roots = _close_roots(_roots(reps, prepared, needed, 1 / least), most_apart)
            found = roots.select("id").distinct()
            found = stored(found if known is None else found.join(known, "id", "left_anti"), "candidates", roots.count())
            more = stored(_sets_of(docs, small_side(found), words), "sets")
            shingles, known, prepared = (more, found, needed) if known is None else (shingles.union(more), known.union(found), needed)
        if started < prepared and not exhaustive:
            end = min(prepared, started + STARTED[min(level, len(STARTED) - 1)])
            fresh = roots.where(F.col("tree").between(started, end - 1)).select("id", "bits", "node", F.lit(None).cast("array<int>").alias("tokens"))
            rows, started, about = fresh if rows is None else fresh.union(rows), end, about + fresh.count()
        inside = _inside(_placed(rows, labels, whole, about), exhaustive)
        meetings = stored(_meetings(inside, most_apart), "meetings", inside.count())
        met = meetings.count()
        if met:
            labels = _relabelled(labels, _compared(meetings, shingles, numerator, denominator), met)
        whole = whole.union(_compared_whole(inside, exhaustive))
        large = inside.where(F.col("outside") > SMALL)
        branching, level, about = None, level + 1, 0
        left = 0 if exhaustive else large.count()
        if left:
            branching, depth, about = _branches(large, reps, 1 / least), depth + STEPS, 2 * left
        else:
            depth = 1
        deepest = max(deepest, depth)
        if branching is None and started == prepared:
            needed = max(needed, trees_for(recall, least, deepest))
    of_set = reps.join(labels, "id", "left").select("set_id", F.coalesce("label", "id").alias("component_id"))
    return made.join(of_set, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component_id", "doc_id"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component, the one with the least ``doc_id``, and one row of each document.

    Of several rows of one ``doc_id`` the least by text, then by all columns, stays. Rows without ``doc_id`` stay.
    """
    gone = near_duplicates(docs, **how).where("not kept").select("doc_id")
    left = docs.join(small_side(stored(gone.distinct(), "gone")), "doc_id", "left_anti")
    several = stored(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is not null and rows > 1").select("doc_id"), "several")
    if several.isEmpty():
        return left.select(*docs.columns)
    few = small_side(several)
    rows = left.join(few, "doc_id", "left_semi").select("doc_id", F.struct(F.col("text"), F.to_json(F.struct(*docs.columns)).alias("all")).alias("order"), F.struct(*docs.columns).alias("row"))
    one_each = rows.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return left.join(few, "doc_id", "left_anti").select(*docs.columns).union(one_each)
