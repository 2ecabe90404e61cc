"""SimHash near-deduplication by a grid range-join on segment bit counts.

A 64-bit fingerprint is cut into segments and mapped to the vector of their bit counts. Flipping one
bit moves one count by one, so the Manhattan distance of two vectors is at most the Hamming distance of
the fingerprints: a range-join on the vectors within r finds every pair within r bits. The join is an
equi-join on grid points: of any two vectors within r there is a point within floor(r/2) of the one
and ceil(r/2) of the other, so each fingerprint is stored at the points of the small ball and looked up
at those of the large one. Pairs that meet are verified on the bits.

More segments make the grid finer and the balls larger; their number follows the number of distinct
fingerprints, which changes the cost only. Equal fingerprints are one. A task reports its links as the
edges of a spanning forest, so a group of copies never appears as all its pairs, and a point where very
many fingerprints meet is searched by flipping bits instead, at a cost linear in their number.

Null text counts as empty; texts without words have fingerprint zero and link like any other. Null
doc_ids are ignored in component_id (null if a component has no other). Repeated rows and ties get the
same answer. An empty table gives an empty table. Other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import UnionFind, connected_components, discard, in_few, kept_alone, materialize, small_batches, text_bytes
from .keep import keep_rows, row_key

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
PAIR_BLOCK = 1 << 20


def simhash(text: bytes, size: int = SHINGLE_WORDS, block: int = 1 << 15) -> int:
    """The signed 64-bit fingerprint of a text: bit i is set if it is in over half the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and white space as \x20\x09-\x0D
    if not words:
        return 0
    if len(words) <= size:
        return int(np.uint64(xxh64_intdigest(b" ".join(words), SEED)).view(np.int64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    hashes = np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[k : k + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, key (of the row for keep_rows) and fp, the signed fingerprint."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", row_key(text).alias("key"), text_bytes(text).alias("__text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_alone("simhash")
        for batch in batches:
            fp = pa.array([simhash(t.as_py(), size) for t in batch.column("__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), fp], names=["doc_id", "key", "fp"])

    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def segments_for(n: int) -> int:
    """The cheaper of 8 and 16 segments for n distinct fingerprints.

    8 cost 162 points each and, if they are random, some n / 500 comparisons, 16 cost 578 points and next to none.
    A point goes through a shuffle and costs about as much as 150 comparisons, so they are even at some 2^25.
    """
    return 8 if n < 1 << 25 else 16


def ball(dims: int, radius: int) -> np.ndarray:
    """All integer vectors within a Manhattan distance."""
    out = {(0,) * dims}
    for moved in range(1, radius + 1):
        for at in combinations(range(dims), moved):
            for steps in product(range(-radius, radius + 1), repeat=moved):
                if 0 not in steps and sum(map(abs, steps)) <= radius:
                    vector = [0] * dims
                    for k, step in zip(at, steps):
                        vector[k] = step
                    out.add(tuple(vector))
    return np.array(sorted(out), np.int64)


def grid_points(fp: np.ndarray, segments: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the grid points within radius of each fingerprint's count vector."""
    width = 64 // segments
    counts = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(fp), segments, width).sum(2, dtype=np.int64)
    bits = max(4, (width + 2 * RADIUS).bit_length())
    weights = np.int64(1) << (np.arange(segments, dtype=np.int64) * bits % 64)
    moves = ball(segments, radius)
    base = (counts + RADIUS).view(np.uint64) @ weights.view(np.uint64)
    keys = base[:, None] + (moves.view(np.uint64) @ weights.view(np.uint64))[None, :]
    inside = np.ones(keys.shape, bool)
    for s in range(segments):  # points outside the range of a count are on no shortest way between two vectors
        moved = np.flatnonzero(moves[:, s])
        at = counts[:, s, None] + moves[None, moved, s]
        inside[:, moved] &= (at >= 0) & (at <= width)
    row, at = np.nonzero(inside)
    return row, keys[row, at].view(np.int64)


def flips(radius: int) -> np.ndarray:
    """All masks of at most radius bits."""
    return np.array([sum(1 << b for b in at) for k in range(1, radius + 1) for at in combinations(range(64), k)], np.uint64)


def link_groups(point: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, links: UnionFind) -> None:
    """Join the linked fingerprints of all points: stored ones (side 0) against those looked up (side 1)."""
    order = np.lexsort((side, point))
    point, side, fp = point[order], side[order], fp[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(point)) + 1, [len(point)]])
    sizes, stored = np.diff(cuts), np.add.reduceat(1 - side, cuts[:-1]) if len(point) else np.empty(0, np.int64)
    pairs = stored * (sizes - stored)
    masks = flips(radius)
    large = pairs > (sizes + 1) * len(masks)
    for k in np.flatnonzero(large):
        lo, mid, hi = cuts[k], cuts[k] + stored[k], cuts[k + 1]
        here = np.sort(fp[lo:mid])
        for x in fp[mid:hi]:
            near = x ^ masks
            at = np.minimum(np.searchsorted(here, near), len(here) - 1)
            for y in near[here[at] == near]:
                links.union(int(x.view(np.int64)), int(y.view(np.int64)))
    groups = np.flatnonzero((pairs > 0) & ~large)
    looked = sizes[groups] - stored[groups]  # each looked-up row has its group's stored rows for partners
    group = np.repeat(groups, looked)
    rows = cuts[group] + stored[group] + np.arange(len(group)) - np.repeat(np.cumsum(looked) - looked, looked)
    total = np.cumsum(stored[group])
    done = 0
    while done < len(rows):
        base = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + PAIR_BLOCK, "right")))
        own, times = group[done:upto], stored[group[done:upto]]
        left = np.repeat(cuts[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        a, b = fp[left], np.repeat(fp[rows[done:upto]], times)
        near = (a < b) & (np.bitwise_count(a ^ b) <= radius)
        for x, y in np.unique(np.stack([a[near], b[near]], 1), axis=0).view(np.int64).tolist():
            links.union(x, y)
        done = upto


def near_components(prints: DataFrame, radius: int = RADIUS, segments: int | None = None, rows_per_task: int = 1 << 20) -> DataFrame:
    """fp, root of the linked fingerprints among the distinct ones of prints (fp); fingerprints without a link are left out."""
    distinct = materialize(prints.select("fp").distinct(), "distinct-fp")
    n = distinct.count()
    segments = segments or segments_for(n)
    small, large = radius // 2, radius - radius // 2
    per_row = len(ball(segments, small)) + len(ball(segments, large))
    tasks = max(1, math.ceil(n * per_row / rows_per_task))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for k in range(0, len(fp), 512):
                for side, reach in ((0, small), (1, large)):
                    row, keys = grid_points(fp[k : k + 512].view(np.uint64), segments, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), side, np.int8)), pa.array(fp[k : k + 512][row])], names=["point", "side", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("point").to_numpy(), b.column("side").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        links = UnionFind()
        if got:
            point, side, fp = (np.concatenate(x) for x in zip(*got))
            link_groups(point, side.astype(np.int64), fp.view(np.uint64), radius, links)
        edges = links.edges()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    points = distinct.repartition(tasks, "fp").mapInArrow(spread, "point long, side tinyint, fp long").repartition(tasks, "point")  # a fingerprint has hundreds of points
    linked = connected_components(points.mapInArrow(join, "a long, b long"), "simhash")
    discard(distinct)
    return linked.select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """One row per document: doc_id, key, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) and kept (the
    row with that doc_id, of several the one with the smallest key; where no row has a doc_id, the one with the smallest key)."""
    prints = materialize(fingerprints(docs, text, size), "fp")
    near = near_components(prints, radius, segments)
    lowest = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("low"))
    rows = prints.count()  # from the footers
    rooted = materialize(in_few(lowest.join(near, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), rows), "rooted")
    components = materialize(in_few(rooted.groupBy("root").agg(F.min("low").alias("first")), rows), "by-root")
    named = rooted.join(components, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
    named = materialize(in_few(named, rows), "named")
    discard(rooted, components)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("first_key"))
    return prints.join(named, "fp").select("doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each component, the one that simhash_groups keeps."""
    return keep_rows(docs, simhash_groups(docs, text, size, radius).select("doc_id", "key", "kept"), text)
