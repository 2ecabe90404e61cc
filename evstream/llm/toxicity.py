"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams and itself; a text is the mean over its words of the
mean over their bags; a linear softmax of two classes sits on top. Embeddings and softmax are trained
jointly in numpy, so a misspelt word scores by the n-grams it shares with words seen in training.
Since everything up to the softmax is linear, scoring needs one number for each bucket: the embedding's
share in the difference of the two logits.

Training takes a bounded number of labelled rows (`max_rows` and `max_bytes`, those with the smallest hash of
doc_id, so that the choice depends on no order; a text that would pass the bound on bytes is left out whole); scoring takes every row and whole text. Null or empty text
gets the score of no evidence. Null labels and labels without a document are not learned from; repeated
labels count as often as they stand. Without any usable label every score is 0.5. Nothing but text
enters a score. Rows that repeat, or whose scores are equal, are scored alike. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordMemo, kept_alone, small_batches, spare, text_bytes

MAX_ROWS = 6000
MAX_BYTES = 64 << 20
MEMO_WORDS = 200_000
BUCKETS = 1 << 18
DIMENSIONS = 4
GRAMS = (3, 4, 5)
SCALE = 10.0
MODELS = 3
STEPS = 300
AVERAGED = 0.5  # the share of the last steps whose models are averaged
RATE = 0.1
FLOOR = 0.02  # added to the size of a gradient, so that noise in small ones is not made large
SHRINK = 4.0
COMMON = 0.005
BATCH = 200
THRESHOLD = 0.7
_EDGE = b".,;:!?\"'()[]{}<>-_*"


def word_buckets(chunk: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at its ends."""
    word = f"<{(chunk.strip(_EDGE) or chunk).decode(errors='replace').lower()}>"
    crc, mask = zlib.crc32, buckets - 1
    out = [crc(word.encode()) & mask]
    if word.isascii():
        raw = word.encode()
        return out + [crc(raw[k : k + n]) & mask for n in GRAMS for k in range(len(raw) - n + 1)]
    return out + [crc(word[k : k + n].encode()) & mask for n in GRAMS for k in range(len(word) - n + 1)]


def _bags(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, one after another, and how many each word has."""
    parts, sizes = [np.empty(0, np.int32)], np.zeros(len(words), np.int64)
    for k in range(0, len(words), 8192):
        bags = [word_buckets(w, buckets) for w in words[k : k + 8192]]
        sizes[k : k + len(bags)] = [len(b) for b in bags]
        parts.append(np.fromiter((b for bag in bags for b in bag), np.int32, int(sizes[k : k + len(bags)].sum())))
    return np.concatenate(parts), sizes


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of runs that begin at starts, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class SubwordModel:
    """gains: each bucket's share in logit 1 minus logit 0; bias: what an empty text gets."""

    gains: np.ndarray
    bias: float

    def word_gains(self, chunks: list[bytes], known=None) -> list[float]:
        out: list[float] = []
        for k in range(0, len(chunks), 8192):
            flat, sizes = _bags(chunks[k : k + 8192], len(self.gains))
            out += (np.add.reduceat(self.gains[flat], np.cumsum(sizes) - sizes) / sizes).tolist()
        return out

    def probabilities(self, words: list[list[bytes]], gain) -> np.ndarray:
        means = np.array([sum(map(gain, w)) / len(w) if w else 0.0 for w in words])
        return 1 / (1 + np.exp(-np.clip(self.bias + means, -500, 500)))


def train(texts: list[bytes], labels: list[int], seed: int = 7, buckets: int = BUCKETS) -> SubwordModel:
    """The mean of MODELS models, which differ in where they begin and in the order of the texts: less depends on either, or on the order of sums."""
    if not texts:
        return SubwordModel(np.zeros(buckets), 0.0)
    live, share, docs = _live_bags(texts, buckets)
    with ThreadPoolExecutor(MODELS) as pool:
        found = list(pool.map(lambda k: _descend(docs, share, np.asarray(labels, np.int64), np.random.default_rng(seed + k)), range(MODELS)))
    gains = np.zeros(buckets)
    gains[live] = np.mean([f[0] for f in found], 0)
    return SubwordModel(gains, float(np.mean([f[1] for f in found])))


def _descend(docs: list[tuple[np.ndarray, np.ndarray]], share: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Gains of the live buckets and bias. Embeddings (buckets x dimensions) and softmax at once: minibatch descent on the cross entropy,
    in steps by the mean and the size of each gradient so far.

    N-grams count by the inverse root of their share, and each step shrinks all embeddings by a fixed
    length: what does not keep earning its place in many texts goes to zero, so nothing is learned by heart.
    The models of the last steps are averaged.
    """
    epochs = -(-STEPS // -(-len(docs) // BATCH))
    lift = ((np.maximum(share, 1e-12) / len(docs)) ** -0.5).astype(np.float32)
    embed = rng.normal(0, 0.1, (len(share), DIMENSIONS)).astype(np.float32)
    top = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    base = np.log(np.maximum(np.bincount(target, minlength=2), 1) / len(target)).astype(np.float32)
    params = [embed, top, base]
    speed, size = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, total = 0, epochs * -(-len(docs) // BATCH)
    gains, bias, averaged = np.zeros(len(share)), 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            sizes = np.array([len(docs[r][0]) for r in rows])
            bucket, weight = (np.concatenate([docs[r][c] for r in rows]) for c in (0, 1))
            doc, lit = np.repeat(np.arange(len(rows)), sizes), sizes > 0
            mean = np.zeros((len(rows), DIMENSIONS), np.float32)
            if lit.any():
                mean[lit] = SCALE * np.add.reduceat((embed * lift[:, None])[bucket] * weight[:, None], (np.cumsum(sizes) - sizes)[lit])
            logits = mean @ top + base
            logits -= logits.max(1, keepdims=True)
            soft = np.exp(logits)
            soft /= soft.sum(1, keepdims=True)
            soft[np.arange(len(rows)), target[rows]] -= 1
            soft /= len(rows)
            back = SCALE * (soft @ top.T)
            by_bucket = np.stack([np.bincount(bucket, back[doc, d] * weight, len(share)) for d in range(DIMENSIONS)], 1) * lift[:, None]
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for param, pace, square, grad in zip(params, speed, size, (by_bucket, mean.T @ soft, soft.sum(0))):
                pace += 0.1 * (grad - pace)
                square += 0.01 * (grad * grad - square)
                param -= rate * (pace / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + FLOOR)
            norm = np.sqrt((embed**2).sum(1, keepdims=True)) + 1e-12
            embed *= np.maximum(0, 1 - rate * SHRINK / np.sqrt(len(docs)) / norm)
            if step > total * (1 - AVERAGED):
                gains += embed.astype(np.float64) @ (top[:, 1] - top[:, 0]).astype(np.float64)
                bias += float(base[1] - base[0])
                averaged += 1
    return SCALE * lift * gains / averaged, bias / averaged


def _live_bags(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The buckets that enough texts have, the sum of their weights, and by text its live buckets (by place) with their weights:
    the mean over the words of the mean over their bags gives each bucket of a text one weight."""
    numbers: dict[bytes, int] = {}
    docs = []
    for text in texts:
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in text.split()), np.int32)
        docs.append(tuple(x.astype(np.int32) for x in np.unique(words, return_counts=True)))
    flat, full = _bags(list(numbers), buckets)
    del numbers
    starts = np.cumsum(full) - full
    spread_over = np.zeros(buckets, np.int64)
    for words, _ in docs:
        spread_over[np.unique(flat[_spans(starts[words], full[words])])] += 1  # documents with each bucket: what only a few have could only be learned by heart
    known = spread_over >= max(2, round(COMMON * len(docs)))
    live = np.flatnonzero(known)
    kept = known[flat]
    lengths = np.add.reduceat(kept, starts, dtype=np.int64) if len(starts) else full  # of the bags without rare buckets
    flat = (np.cumsum(known) - 1).astype(np.int32)[flat[kept]]
    starts, share = np.cumsum(lengths) - lengths, np.zeros(len(live))
    for k, (words, times) in enumerate(docs):
        own, n = flat[_spans(starts[words], lengths[words])], lengths[words]
        place, at = np.unique(own, return_inverse=True)
        weight = np.bincount(at, np.repeat(times / max(1, times.sum()) / full[words], n), len(place))
        share[place] += weight
        docs[k] = place, weight.astype(np.float32)
    return live, share, docs


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> SubwordModel:
    """Train on labelled documents outside the held-out third: at most max_rows rows and max_bytes bytes of whole texts, which the driver holds meanwhile."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    chosen = F.broadcast(usable.orderBy(*order).limit(max_rows))  # max_rows pairs of numbers
    body = text_bytes(text)
    sized = docs.select("doc_id", body.alias("body")).join(chosen, "doc_id").select("doc_id", "label", F.xxhash64("body").alias("key"), F.octet_length("body").alias("size"))
    times: dict[tuple, list[int]] = {}
    held = 0
    for r in sized.orderBy(*order, "key").limit(max_rows).collect():
        if held + r["size"] <= max_bytes:
            held += r["size"]
            times.setdefault((r["doc_id"], r["key"]), []).append(r["label"])
    if not times:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame(list(times), T.StructType([T.StructField("of", docs.schema["doc_id"].dataType), T.StructField("key", T.LongType())]))
    rows = docs.select("doc_id", body.alias("text")).join(F.broadcast(wanted), (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("key")))
    texts = rows.groupBy("doc_id", "key").agg(F.first("text").alias("text")).collect()  # of at most max_bytes, since repeated rows are one
    got = sorted((r["doc_id"], y, bytes(r["text"])) for r in texts for y in times[r["doc_id"], r["key"]])
    return train([r[2] for r in got], [r[1] for r in got])


def _scores(batch: pa.RecordBatch, model: SubwordModel, memo: WordMemo, column: str = "__text") -> np.ndarray:
    words = [t.split() for t in batch.column(column).to_pylist()]
    return model.probabilities(words, memo.load(words))


def score(docs: DataFrame, model: SubwordModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score at or over the threshold)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each bucket
    rows = docs.select("doc_id", text_bytes(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_alone("toxicity")
        memo = WordMemo(shared.value.word_gains, MEMO_WORDS)
        for batch in batches:
            p = _scores(batch, shared.value, memo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: SubwordModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or over the threshold, all columns as they were."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body, names = spare(docs, "__text"), docs.columns
    rows = docs.withColumn(body, text_bytes(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_alone("toxicity")
        memo = WordMemo(shared.value.word_gains, MEMO_WORDS)
        for batch in batches:
            clean = pa.array(_scores(batch, shared.value, memo, body) < threshold)
            yield batch.select(names).filter(clean)

    return rows.mapInArrow(run, T.StructType(list(docs.schema.fields)))
