"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most `capacity` tokens. How many pieces have each length is a table of
at most `capacity` rows however large the corpus is, so the packing itself is planned on those counts:
for the longest length left, one, two or three lengths that fill the gap exactly are looked up among
the single, pair and triple sums and used as often as their counts allow; what has no exact complement
takes the longest length that fits, and is completed exactly if it then can be. Pieces get their
places by their rank within their length, which comes from counts by partition, not from a global sort.

Null text counts as empty; an empty document is one piece of its end token. Repeated rows and ties are
packed row by row. Null doc_ids are carried through. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordMemo, kept_alone, materialize, small_batches, text_bytes
from .words import chunk_ids, chunks_of, word_bpe_path

CAPACITY = 2048
END_ID = 0
BROADCAST_ROWS = 500_000


def _memo(path: str) -> WordMemo:
    return kept_alone(f"ids {path}", lambda: WordMemo(chunk_ids(path), bound=250_000))


def token_pieces(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and nth (the piece's number among those of its length in its partition); ids: binary, if asked for."""
    small_batches(docs.sparkSession)
    path = path or word_bpe_path()
    rows = docs.select("doc_id", text_bytes(text).alias("__text"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, met, part = _memo(path), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            words = [chunks_of(t) for t in batch.column("__text").to_pylist()]
            ids_of = memo.load(words)
            row, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
            for k, w in enumerate(words):
                ids = b"".join(map(ids_of, w)) + end
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    row.append(k)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    nth.append(met[n])
                    met[n] += 1
                    if with_ids:
                        kept.append(own)
            columns = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32())}
            columns |= {n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc))}
            columns |= {"part": pa.array([part] * len(row), pa.int32()), "nth": pa.array(nth, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    return rows.mapInArrow(cut, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)


class _Stock:
    """How many pieces of each length are left, with the sums that one, two or three of them make."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count
        self.index()

    def index(self) -> None:
        """Bit sets: the lengths in stock, the sums of two and of three. Stock only falls, so older sets miss no sum."""
        held, over = np.flatnonzero(self.n).tolist(), (1 << len(self.n)) - 1
        self.singles = sum(1 << k for k in held)
        self.pairs = self.triples = 0
        for k in held:
            self.pairs |= self.singles << k & over
        for k in held:
            self.triples |= self.pairs << k & over

    def pair(self, gap: int) -> tuple[int, int] | None:
        """The pair of that sum with the longest member."""
        have = self.n[: gap + 1] > 0
        both = np.flatnonzero(have & have[::-1])
        for a in both[both * 2 >= gap][::-1].tolist():
            if a * 2 != gap or self.n[a] >= 2:
                return a, gap - a
        return None

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """At most so many lengths (one, two or three) that sum to gap, by what is in stock."""
        if most and self.n[gap]:
            return (gap,)
        if most > 1 and self.pairs >> gap & 1 and (found := self.pair(gap)):
            return found
        if most < 3 or not self.triples >> gap & 1:
            return None
        for a in np.flatnonzero(self.n[:gap])[::-1].tolist():
            if a * 3 < gap:
                return None
            if self.pairs >> (gap - a) & 1:
                self.n[a] -= 1
                found = self.pair(gap - a)
                self.n[a] += 1
                if found:
                    return a, *found
        return None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths (longest first placed) and how many sequences take each.

    Planned with sums of up to three, two and one lengths and by best fit alone; the plan with the fewest sequences
    counts, the more exact one of equals.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda plan: sum(times for _, times in plan))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    stock, plan, used = _Stock(counts, capacity), [], 0
    for longest in range(capacity, 0, -1):
        while stock.n[longest]:
            pattern = [longest]
            stock.n[longest] -= 1
            gap = capacity - longest
            while gap:
                if fill := stock.exact(gap, most):
                    pattern += fill
                else:
                    fits = np.flatnonzero(stock.n[: gap + 1])
                    if not len(fits):
                        break
                    fill = (int(fits[-1]),)
                    pattern += fill
                for k in fill:
                    stock.n[k] -= 1
                gap -= sum(fill)
            for k in pattern:
                stock.n[k] += 1
            need = {k: pattern.count(k) for k in set(pattern)}
            times = min(int(stock.n[k]) // n for k, n in need.items())
            for k, n in need.items():
                stock.n[k] -= n * times
            plan.append((pattern, times))
            used += 1
            if used % 16 == 0:
                stock.index()
    return plan


def _places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of pieces."""
    runs, met, sequence = defaultdict(list), defaultdict(int), 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            runs[length].append((met[length], sequence, offset))
            met[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*r)) for length, r in runs.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of token_pieces."""
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan_packing(counts, capacity)))  # a few runs for each length, however many pieces
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases.hint("merge")  # partitions x lengths: grows with the input
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_alone("places")
        runs = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, sequences, offsets = runs[int(length[own[0]])]
                at = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = sequences[at] + rank[own] - first[at], offsets[at]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack_pieces(materialize(token_pieces(docs, text, path, capacity, with_ids), "pieces"), capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (binary) of the sequences of pack_documents(..., with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
