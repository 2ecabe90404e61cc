"""SentencePiece encoding and decoding by a max-plus scan.

The library's byte-pair models are taken as a path problem: a token sequence is the encoding of its
string exactly if every two neighbours are the encoding of theirs, so a step from one token to the next
weighs 0 if they agree and minus infinity if not (characters the vocabulary lacks are byte tokens and
agree with everything). The encoding is the best path.

Paths may be cut anywhere. The state at a cut is the last token that ended there or before, and how far
before. A chunk between two cuts turns a vector of states into another: a max-plus matrix. Giant texts are cut
every CHUNK_CHARS characters, whatever stands there. Every chunk's matrix is made by itself; the matrices of a
text are multiplied pairwise, level by level, up a balanced tree, since the product is associative; down the same
tree each product tells its two factors the state between them; then every chunk is backtraced by itself. No
token has a space after another character, so before such a space, and beside a character the vocabulary lacks,
the state is a single one: a chunk's matrix is the product of what stands before its first and after its last such
place, and the words between, whose encodings are remembered, do not enter it. A chunk without such a place has
its whole matrix made.

Texts up to CHUNK_CHARS are one chunk. Null text counts as empty, which has no tokens. Repeated rows and ties are
encoded row by row. An empty table gives an empty table. Other columns are never looked at. Decoding undoes the
escape of spaces, so a literal U+2581 comes back as a space, as the library has it.
"""

from __future__ import annotations

import pickle
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, kept_alone, materialize, small_batches, text_bytes
from .words import core_of

CHUNK_CHARS = 32_768
BROADCAST_ROWS = 200_000
SPACE = "▁"
START = (0, "")  # the state where nothing to the left matters
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

State = tuple[int, str]
Matrix = dict[State, dict[State, float]]


def piece_bpe_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes, self.texts = {}, {}, {}, []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.texts.append(b"")
            else:
                self.ids[piece] = k
                self.scores[piece] = model.get_score(k)
                self.texts.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        self.tails = {piece[k:] for piece in self.ids for k in range(len(piece))}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.names = {k.to_bytes(4, "little"): piece for piece, k in self.ids.items()} | {k.to_bytes(4, "little"): "" for k in self.bytes.values()}
        self.marks = {ord(ch): self.pack([ch]) for ch in ".,"}

    def merge(self, text: str) -> list[str]:
        """The encoding of a short string by the merge rule itself: the best-scored pair first, the left one of equals."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best, at = max((scores.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == -np.inf:
                break
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
        return symbols

    def agree(self, a: str, b: str) -> bool:
        """Whether the step from a to b weighs 0."""
        if (known := self.agreed.get((a, b))) is None:
            if len(self.agreed) > 500_000:
                self.agreed.clear()
            known = self.agreed[a, b] = a not in self.ids or b not in self.ids or self.merge(a + b) == [a, b]
        return known

    def grow(self, text: str, last: list[str]) -> None:
        """last[i]: the last token of the best path over text[:i]; extends what is there to the whole text."""
        ids, tails, agreed, agree = self.ids, self.tails, self.agreed, self.agree
        for i in range(len(last), len(text) + 1):
            if text[i - 1] not in ids:
                last.append(text[i - 1])
                continue
            for j in range(i - 1, -1, -1):
                t = text[j:i]
                if t not in tails:
                    raise ValueError(f"no path to {i} in {text!r}")
                if t in ids and (j == 0 or ((known := agreed.get((last[j], t))) or known is None and agree(last[j], t))):
                    last.append(t)
                    break

    def pack(self, tokens: list[str]) -> bytes:
        out: list[int] = []
        for t in tokens:
            if (k := self.ids.get(t)) is not None:
                out.append(k)
            else:
                out += [self.bytes[b] for b in t.encode()]
        return struct.pack(f"<{len(out)}I", *out)

    @staticmethod
    def trace(text: str, last: list[str]) -> list[str]:
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def compute(self, keys: list[bytes], known=None) -> list[bytes]:
        """Ids of segments, in sorted order so that neighbours share the work on their common start."""
        out: list = [b""] * len(keys)
        todo = []
        for n, key in enumerate(keys):
            core = core_of(key)
            if core is not key and known and (got := known(core)) and self.agree(self.names[got[-4:]], key[-1:].decode()):
                out[n] = got + self.marks[key[-1]]  # one step more from where the word's path ends
            else:
                todo.append((key[1:].decode() if key[:1] == b" " else SPACE + key.decode(), n))
        todo.sort()
        before, last = "", [""]
        for text, n in todo:
            same = 0
            for a, b in zip(before, text):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            self.grow(text, last)
            before = text
            out[n] = self.pack(self.trace(text, last))
        return out

    def matrix(self, text: str, left: str, opened: bool, closed: bool) -> Matrix:
        """The chunk's max-plus matrix. left: the characters before it that states can reach into; opened, closed: whether its cuts are free (a single state)."""
        if not (inner := self.inner(text, left, opened, closed)):
            return self._forward(text, left, opened, closed)[1]
        head, tail = {START: {START: 0.0}}, {START: {START: 0.0}}
        if not opened:
            head = self._forward(text[: inner[0]], left, False, True)[1]
        if not closed:
            tail = self._forward(text[inner[1] :], "", True, False)[1]
        return combine(head, tail)

    def free(self, whole: str, at: int) -> bool:
        """Whether a cut within a text is free: before a space after something else, or beside a character the vocabulary lacks."""
        before, after = whole[at - 1], whole[at]
        return after == SPACE != before or after not in self.ids or before not in self.ids

    def inner(self, text: str, left: str, opened: bool, closed: bool) -> tuple[int, int] | None:
        """The first and the last free cut of a chunk, its own ends included."""
        whole, lead = left[-1:] + text, len(left[-1:])
        first = 0 if opened else next((k - lead for k in range(1, len(whole)) if self.free(whole, k)), None)
        if first is None:
            return None
        return first, len(text) if closed else next((k - lead for k in range(len(whole) - 1, 0, -1) if self.free(whole, k)), 0)

    def _entries(self, left: str) -> list[State]:
        """All states a cut after left may have: a token, or a free cut, that ends k characters before it."""
        if (free := self.inner(left, "", False, False)) and free[1]:
            return list(self._forward(left[free[1] :], "", True, False)[1][START])
        out = [(k, "") for k in range(1, min(self.longest, len(left) + 1))]
        for k in range(min(self.longest, len(left) + 1)):
            end = len(left) - k
            out += [(k, left[j:end]) for j in range(max(0, end - self.longest), end) if left[j:end] in self.ids]
            if end and left[end - 1] not in self.ids:
                out.append((k, left[end - 1 : end]))
        return out

    def _forward(self, text: str, left: str, opened: bool, closed: bool, entry: State | None = None) -> tuple[dict, Matrix]:
        """Best weight to every (place, token) from every entry state, then the states at the end."""
        back = self.longest
        lead = "" if opened else left[-back:]
        whole, cut = lead + text, len(lead)
        nodes: list[dict[str, dict[State, float]]] = [{} for _ in range(len(whole) + 1)]
        for state in [START] if opened else self._entries(left):
            if (entry is None or state == entry) and cut - state[0] >= 0:
                nodes[cut - state[0]].setdefault(state[1], {})[state] = 0.0
        reached = [dict(n) for n in nodes]
        for i in range(cut + 1, len(whole) + 1):
            here: dict[str, dict[State, float]] = {}
            for j in range(i - 1, max(-1, i - 1 - back), -1):
                t = whole[j:i]
                if t not in self.ids and not (i - j == 1):
                    if t not in self.tails:
                        break
                    continue
                froms = nodes[j] if j > cut else reached[j]
                for before, weights in froms.items():
                    if before == "" or self.agree(before, t):
                        got = here.setdefault(t, {})
                        for state, w in weights.items():
                            if w > got.get(state, -np.inf):
                                got[state] = w
            nodes[i] = here
        out: Matrix = {}
        for k in range(1 if closed else back):
            i = len(whole) - k
            if i < 0:
                break
            for t, weights in (nodes[i] if i > cut else reached[i]).items():
                for state, w in weights.items():
                    to = START if closed else (k, t)
                    row = out.setdefault(state, {})
                    row[to] = max(w, row.get(to, -np.inf))
        return nodes, out

    def backtrace(self, text: str, left: str, opened: bool, closed: bool, entry: State, leave: State) -> list[str]:
        """The chunk's own tokens (those that end in it), given its entry and exit states."""
        nodes, _ = self._forward(text, left, opened, closed, entry)
        lead = 0 if opened else min(self.longest, len(left))
        whole = ("" if opened else left[-self.longest :]) + text
        i = len(whole) - leave[0]
        token = leave[1] if not closed else next(iter(nodes[len(whole)]), "")
        out = []
        while i > lead:
            out.append(token)
            i -= len(token)
            if i <= lead:
                break
            token = next(t for t in nodes[i] if self.agree(t, out[-1]))
        return out[::-1]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: the best way through both chunks."""
    out: Matrix = {}
    for start, middle in a.items():
        row: dict[State, float] = {}
        for via, w in middle.items():
            for end, v in b.get(via, {}).items():
                if w + v > row.get(end, -np.inf):
                    row[end] = w + v
        if row:
            out[start] = row
    return out


def _model(path: str) -> tuple[PieceModel, WordMemo]:
    def make() -> tuple[PieceModel, WordMemo]:
        model = PieceModel(path)
        return model, WordMemo(model.compute)

    return kept_alone(f"pieces {path}", make)


_MARK = SPACE.encode()


def segments(text: bytes) -> list[bytes]:
    """Keys of the parts of a text that no token crosses: a word stands for itself after a space, others are escaped after a blank."""
    if not text:
        return []
    if b"  " not in text and _MARK not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ")
    return escaped_segments(SPACE + text.decode().replace(" ", SPACE))


def escaped_segments(text: str) -> list[bytes]:
    return [s[1:].encode() if s[0] == SPACE and len(s) > 1 and s[1] != SPACE else b" " + s.encode() for s in _SEGMENT.findall(text)]


def middle_states(matrices: list[Matrix]) -> list[State]:
    """The states of the best path at all cuts, the ends included: products up a balanced tree, states down it."""
    levels = [matrices]
    while len(now := levels[-1]) > 1:
        levels.append([combine(*now[k : k + 2]) if k + 1 < len(now) else now[k] for k in range(0, len(now), 2)])
    states = [START, START]
    for level in levels[-2::-1]:
        below = [START]
        for k, (before, after) in enumerate(zip(states, states[1:])):
            if 2 * k + 1 < len(level):
                one, two = level[2 * k].get(before, {}), level[2 * k + 1]
                below.append(max((w + two[s][after], s) for s, w in one.items() if after in two.get(s, {}))[1])
            below.append(after)
        states = below
    return states


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """CRC-32 of byte strings put together, from theirs: a CRC is linear, so the first goes on over as many zeros as the next has bytes."""
    total = 0
    for crc, size in zip(crcs, sizes):
        zeros = bytes(size)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def decode_ids(ids: bytes, model: PieceModel) -> bytes:
    """The text of packed ids: pieces joined, without the space put before the first."""
    text = b"".join(map(model.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return text[1:] if text[:1] == b" " else text


def encode(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK_CHARS, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_chunks, n_ids, ids_crc32, round_trip (decoding gives the text, U+2581 as a space) and ids (packed, little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    path = path or piece_bpe_path()
    rows = docs.select("doc_id", text_bytes(text).alias("__text"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("__chars"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_chunks", "n_ids", "ids_crc32", "round_trip"] + ["ids"] * with_ids
    schema = f"doc_id {doc_type}, n_chunks int, n_ids long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids

    def digest(ids: bytes, raw: bytes, chunks: int, model: PieceModel) -> tuple:
        back = decode_ids(ids, model) == raw.replace(_MARK, b" ")
        return (chunks, len(ids) // 4, zlib.crc32(ids), back, ids)[: len(names)]

    def as_batch(doc_ids: pa.Array, values: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        columns = [pa.array([v[k] for v in values], kinds[k]) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([doc_ids, *columns], names=["doc_id", *names])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = _model(path)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            words = list(map(segments, texts))
            ids_of = memo.load(words)
            yield as_batch(batch.column("doc_id"), [digest(b"".join(map(ids_of, w)), t, 1, model) for w, t in zip(words, texts)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, back = TaskContext.get().partitionId() << 33, 2 * _model(path)[0].longest
        for batch in batches:
            for n, raw in enumerate(batch.column("__text").to_pylist()):
                whole = SPACE + raw.decode().replace(" ", SPACE)
                places = [*range(0, len(whole), chunk), len(whole)]
                parts = [(k, whole[max(0, a - back) : a], whole[a:b], a == 0, b == len(whole)) for k, (a, b) in enumerate(zip(places, places[1:]))]
                columns = [pa.array(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([n] * len(parts))), pa.array([row] * len(parts), pa.int64()), *columns], names=["doc_id", "row", "nth", "left", "part", "opened", "closed"])
                row += 1

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(path)
        for batch in batches:
            out = [pickle.dumps(model.matrix(part, left, opened, closed)) for left, part, opened, closed in zip(*(batch.column(c).to_pylist() for c in ("left", "part", "opened", "closed")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("nth"), pa.array(out, pa.binary())], names=["row", "nth", "matrix"])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")  # a text has at most 2 GB, so these are at most some 65,000 small matrices
        states = middle_states([pickle.loads(m) for m in table["matrix"].to_pylist()])
        return pa.table({"row": table["row"], "nth": table["nth"], "states": pa.array(map(pickle.dumps, zip(states, states[1:])), pa.binary())})

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = _model(path)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("left", "part", "opened", "closed", "states"))))
            inner = [model.inner(part, left, opened, closed) for left, part, opened, closed, _ in rows]
            keys = [escaped_segments(r[1][slice(*at)]) if at else [] for r, at in zip(rows, inner)]
            ids_of, out = memo.load(keys), []
            for own, at, (left, part, opened, closed, states) in zip(keys, inner, rows):
                entry, leave = pickle.loads(states)
                if at:
                    head = [] if opened else model.backtrace(part[: at[0]], left, False, True, entry, START)
                    tail = [] if closed else model.backtrace(part[at[1] :], "", True, False, START, leave)
                    ids = model.pack(head) + b"".join(map(ids_of, own)) + model.pack(tail)
                else:
                    ids = model.pack(model.backtrace(part, left, opened, closed, entry, leave))
                text = (left + part)[len(left) - entry[0] : len(left) + len(part) - leave[0]]  # what the chunk's tokens stand for
                same = b"".join(map(model.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())) == text.replace(SPACE, " ").encode()
                out.append((len(ids), zlib.crc32(ids), same, ids)[: len(names) - 1])
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            columns = [pa.array([o[k] for o in out], kinds[k]) for k in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "nth")), *columns], names=["doc_id", "row", "nth", "size", "crc", "same", "ids"][: 3 + len(columns)])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        sizes = table["size"].to_pylist()
        ids = [b"".join(table["ids"].to_pylist())] if with_ids else []
        value = (len(table), sum(sizes) // 4, joined_crc(table["crc"].to_pylist(), sizes), all(table["same"].to_pylist()), *ids)
        return pa.Table.from_batches([as_batch(table["doc_id"][:1].combine_chunks(), [value])])

    short = rows.where(F.col("__chars") <= chunk).select("doc_id", "__text").mapInArrow(plain, schema)
    parts = rows.where(F.col("__chars") > chunk).select("doc_id", "__text").mapInArrow(split, f"doc_id {doc_type}, row long, nth long, left string, part string, opened boolean, closed boolean")
    parts = materialize(parts.repartition("row", "nth"), "chunks")
    matrices = parts.drop("doc_id").mapInArrow(transfer, "row long, nth long, matrix binary")
    states = materialize(matrices.groupBy("row").applyInArrow(scan, "row long, nth long, states binary"), "states")
    states = F.broadcast(states) if states.count() <= BROADCAST_ROWS else states
    traced = parts.join(states, ["row", "nth"]).mapInArrow(backtrace, f"doc_id {doc_type}, row long, nth long, size long, crc long, same boolean" + ", ids binary" * with_ids)
    return short.unionByName(traced.groupBy("row").applyInArrow(join, schema))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (from encode) with text instead of ids."""
    path = path or piece_bpe_path()
    rows = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(path)
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, model).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
