"""Fill-in-the-middle: a document's text is cut in three at unit borders and its pieces are put in another order.

A unit is a run of ASCII letters or any other single character. A text is stored as its maximal runs of one
character class (letters, others), each with its first character and the units before it. A run of letters is one
unit, a run of others as many as it has characters, so the character at which a unit begins is found by a binary
search for its run and one addition; units are never listed.

Where the cuts fall and which form a document takes come from a hash of its id (null: of nothing), so that a task run
again, or rows that repeat, give the same. Null text counts as empty. Empty texts, and texts that hold a sentinel, stay
plain. Very long texts are held once as characters and once as classes, with 17 bytes a run beside. Bytes that are no
UTF-8 count as a character each and come back as they were. An empty table gives an empty table. Only the columns named
in keep are carried over, so that others cannot clash. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_bytes

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(128, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


class ClassRuns:
    """The runs of a text: first character and units before each, and whether it is one of letters."""

    def __init__(self, text: str) -> None:
        classes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)  # one byte a character; what is not ASCII is no letter
        letter = _LETTER[classes]
        self.chars = len(classes)
        self.starts = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]])) if self.chars else np.zeros(0, np.int64)
        self.letters = letter[self.starts]
        ends = np.cumsum(np.where(self.letters, 1, np.diff(self.starts, append=self.chars)))
        self.units = int(ends[-1]) if self.chars else 0
        self.before = np.concatenate([[0], ends[:-1]]).astype(np.int64) if self.chars else ends

    def cut(self, unit: int) -> int:
        """The character before which unit (0 to units) begins."""
        if unit >= self.units:
            return self.chars
        run = int(np.searchsorted(self.before, unit, "right")) - 1
        return int(self.starts[run]) + (unit - int(self.before[run]))  # inside a run of letters the difference is 0


def draws(doc_id: str = "doc_id", seed: int = 1) -> Column:
    """Four numbers below 2^32 for each document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def rearrange(text: str, h: Sequence[int], fim_percent: int = 90, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """units, form, prefix_chars, middle_chars and output of one text."""
    runs = ClassRuns(text)
    n = runs.units
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = map(runs.cut, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    spm = h[3] % 100 < spm_percent
    return n, "spm" if spm else "psm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = ("doc_id",), seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """keep, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the rearranged text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, text_bytes(text).alias("__text"), draws(doc_id, seed).alias("__draws"))
    kept = rows.schema.fields[:-2]
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.BinaryType())]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.decode("utf-8", "surrogateescape") for t in batch.column("__text").to_pylist())
            made = [rearrange(t, h, fim_percent, spm_percent, sentinels) for t, h in zip(texts, batch.column("__draws").to_pylist())]
            columns = [list(c) for c in zip(*made)] or [[]] * 5
            columns[4] = [t.encode("utf-8", "surrogateescape") for t in columns[4]]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *map(pa.array, columns, types)], names=[f.name for f in (*kept, *new)])

    return rows.mapInArrow(run, T.StructType([*kept, *new])).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text from which an output was made: a form other than plain has every sentinel once. (No end of a sentinel may be the beginning of one.)"""
    p, s, m = (F.lit(x) for x in sentinels)
    between = lambda a, b: F.call_function("substring_index", F.call_function("substring_index", output, b, F.lit(1)), a, F.lit(-1))
    middle = F.call_function("substring_index", output, m, F.lit(-1))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
