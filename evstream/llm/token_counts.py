"""Exact token counts at every prefix of a text.

A prefix's count is the count before its last white-space-delimited chunk plus the count of the part
of that chunk it holds; the second comes from PrefixCounter's recurrence. With the counts stored,
"how long is this cut", "where does a budget end" and "does it fit" are array look-ups.

Texts of over PIECE_BYTES are worked through in pieces, cut at white space.

Null text counts as empty (no tokens). Repeated rows are counted row by row. An empty table gives an
empty table. Only the columns named in keep are carried over, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordMemo, kept_alone, small_batches, text_bytes
from .words import PrefixCounter, chunks_of, last_count, word_bpe_path

PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _memo(path: str) -> WordMemo:
    return kept_alone(f"prefixes {path}", lambda: WordMemo(PrefixCounter(path).compute, bound=600_000))


def prefix_array(text: bytes, chunks: list[bytes], counts) -> np.ndarray:
    """Token counts of all character prefixes of text, the empty one first."""
    raw = np.frombuffer(text, np.uint8)
    raw = raw[(raw & 0xC0) != 0x80]  # the first byte of each character
    dark = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    place = np.concatenate([[0], np.cumsum(dark)])
    found = list(map(counts, chunks))
    try:
        inner = np.frombuffer(b"".join(found), np.uint8).astype(np.int32)
    except TypeError:  # some chunk's counts do not fit bytes
        inner = np.concatenate([np.frombuffer(c, np.uint8) if isinstance(c, bytes) else np.array(c, np.int32) for c in found])
    ends = place[1:][dark & ~np.append(dark[1:], False)]
    last = inner[ends - 1]
    out = np.zeros(len(inner) + 1, np.int32)
    out[1:] = inner + np.repeat(np.cumsum(last) - last, np.diff(ends, prepend=0))
    return out[place]  # after white space as before it


def pieces_of(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about size bytes that end before white space; a longer chunk without any is one piece."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def long_prefix_array(text: bytes, memo: WordMemo, size: int = PIECE_BYTES) -> np.ndarray:
    """As prefix_array, piece by piece: beside the text and the counts, four bytes a character, only a piece's arrays are held."""
    out = np.zeros(1 + sum(len(piece) - _count_inner(piece) for piece in pieces_of(text, size)), np.int32)
    at = 0
    for piece in pieces_of(text, size):
        words = chunks_of(piece)
        own = prefix_array(piece, words, memo.load([words]))
        np.add(own[1:], out[at], out=out[at + 1 : at + len(own)])
        at += len(own) - 1
    return out


def _count_inner(piece: bytes) -> int:
    """Bytes that go on with a character."""
    return int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) == 0x80))


def prefix_token_counts(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, prefixes: bool = True) -> DataFrame:
    """keep, n_bytes, n_tokens and, unless prefixes is false, prefix_tokens: array<int> of the counts at 0, 1, ... characters.

    The counts are the vocabulary library's, without added special tokens; special strings inside a
    text become their tokens.
    """
    small_batches(docs.sparkSession)
    path = path or word_bpe_path()
    rows = docs.select(*keep, text_bytes(text).alias("__text"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    fields = [f for f in rows.schema.fields if f.name != "__text"] + [T.StructField("n_tokens", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))] if prefixes else []))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            words = [chunks_of(t) if len(t) <= PIECE_BYTES else [] for t in texts]
            counts = memo.load(words)
            if not prefixes:
                totals = [sum(map(last_count, map(counts, w))) for w in words]
            else:
                arrays = [prefix_array(t, w, counts) if len(t) <= PIECE_BYTES else None for t, w in zip(texts, words)]
            for k in (k for k, t in enumerate(texts) if len(t) > PIECE_BYTES):
                if prefixes:
                    arrays[k] = long_prefix_array(texts[k], memo)
                else:
                    totals[k] = sum(sum(map(last_count, map(memo.load([w]), w))) for w in map(chunks_of, pieces_of(texts[k])))
            if not prefixes:
                new = [pa.array(totals, pa.int64())]
            else:
                new = [pa.array([a[-1] for a in arrays], pa.int64())]
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                new.append(pa.ListArray.from_arrays(offsets, arrays[0] if len(arrays) == 1 else np.concatenate([np.empty(0, np.int32), *arrays])))
            names = [f.name for f in fields[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, "n_tokens", *["prefix_tokens"] * prefixes])

    return rows.mapInArrow(count, schema)


def tokens_of_prefix(counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first n_chars characters (of all, where the text is shorter)."""
    return F.element_at(counts, F.least(F.size(counts), F.lit(n_chars) + 1).cast("int"))


def cut_for_budget(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix that has at most budget tokens. A longer prefix may have fewer tokens than a shorter one."""
    return F.size(counts) - 1 - F.greatest(F.lit(0), F.array_position(F.transform(F.reverse(counts), lambda n: n <= F.lit(budget)), F.lit(True)).cast("int") - 1)


def fits_budget(counts: Column, budget: Column | int) -> Column:
    return F.element_at(counts, -1) <= F.lit(budget)
