"""Exact byte-pair encoding of white-space-delimited chunks for the word vocabulary.

The vocabulary's tokenizer never makes a token across white space, and neither its normaliser (NFC,
lower case) nor its special strings look across it. So the ids of a text are the ids of its chunks
in order, and a chunk's ids can be remembered.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_PLAIN = re.compile(r"([^\W\d_]*)([.,;:!?\"()]*)")
#: What the vocabulary's pre-tokenizer keeps together after an apostrophe.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = {b: ch for b, ch in _byte_letters().items() if b != ord(ch)}


def spelled(word: str) -> str:
    """A word with the letter that stands for each of its bytes."""
    return word.encode().decode("latin-1").translate(_LETTERS)


@lru_cache(maxsize=1)
def _second_letters() -> frozenset[str]:
    """Characters that canonical composition may join to the one before, and Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split(" ") for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


@lru_cache(maxsize=1 << 14)
def joins_left(ch: str) -> bool:
    """Whether normalising may move or join a character to what stands before it."""
    first = unicodedata.normalize("NFD", ch)[0]
    return bool(unicodedata.combining(ch) or unicodedata.combining(first) or first in _second_letters())


def word_bpe_path() -> str:
    return public_tokenizers.path(WORD_BPE)


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text, A-Z in lower case as the normaliser has them (special strings are matched before it, as they stand)."""
    return (text if b"<|" in text else text.lower()).split()


def core_of(chunk: bytes) -> bytes:
    """A chunk without one full stop or comma after an ASCII letter, which is a token of its own; else the chunk."""
    return chunk[:-1] if chunk[-1:] in (b".", b",") and chunk[-2:-1].isalpha() else chunk


def chunk_ids(path: str):
    """A function from chunks to their ids, packed as little-endian unsigned 32-bit numbers."""
    library = load_tokenizer(path)

    word = library.model.tokenize

    def encode(chunks: list[bytes]) -> list[bytes]:
        """Words of composed Latin letters need no more normalising and cutting than here; they go to the library's model. Others go through all of it."""
        out: list = [None] * len(chunks)
        rest = []
        for k, chunk in enumerate(chunks):
            text = chunk.decode()
            if text.isalpha() and len(low := text.lower()) == len(text) and max(low) < "\u0250":
                ids = [t.id for t in word(low if low.isascii() else spelled(low))]
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(k)
        for k in range(0, len(rest), 4096):
            got = library.encode_batch_fast([chunks[r].decode() for r in rest[k : k + 4096]], add_special_tokens=False)
            for r, encoding in zip(rest[k : k + 4096], got):
                ids = encoding.ids
                out[r] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    marks = dict(zip((44, 46), encode([b",", b"."])))

    def compute(chunks: list[bytes], known=lambda chunk: None) -> list[bytes]:
        cores = list(map(core_of, chunks))
        ids = {core: known(core) for core in cores}
        missing = [core for core, got in ids.items() if got is None]
        ids.update(zip(missing, encode(missing)))
        return [ids[core] if core is chunk else ids[core] + marks[chunk[-1]] for core, chunk in zip(cores, chunks)]

    return compute


class PrefixCounter:
    """Token counts at every character prefix of a chunk, by dynamic programming over prefixes.

    For byte-pair encoding a token sequence is the encoding of its string exactly if every two
    neighbours are the encoding of theirs. So each prefix has one last token: the one that starts
    where a shorter prefix ends and agrees with that prefix's last token. The tables hold that step
    for prefixes that go on inside the word (last, count) and for those that end there (shut; their
    last symbol carries the end-of-word mark). One pass gives the count of every prefix without
    encoding any. Words are taken in order, so what two neighbours share is computed once.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"]
        self.library = load_tokenizer(path)
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        made = {a + b for a, b in self.rank} | {t for t in model["vocab"] if len(t.removesuffix(self.end)) == 1}
        self.open = {t for t in made if not t.endswith(self.end)}
        self.shut = {t.removesuffix(self.end): t for t in made if t.endswith(self.end)}
        self.tails = {t[k:] for t in [*self.open, *self.shut] for k in range(len(t))}
        self.agree: dict[tuple[str, str], bool] = {}
        self.kinds: dict[str, str] = {}
        self.singles: dict[str, int] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """The encoding of a few symbols by the merge rules themselves."""
        rank = self.rank
        while len(symbols) > 1:
            best, at = min((rank.get(pair, 1 << 30), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 30:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _learn(self, a: str, b: str, mark: str) -> bool:
        if len(self.agree) > 500_000:
            self.agree.clear()
        known = self.agree[a, b + mark] = self.merge([*a, *b[:-1], b[-1] + mark]) == [a, b + mark]
        return known

    def grow(self, word: str, last: list[str], count: list[int], shut: list[int]) -> None:
        """Extend the tables from the prefixes they hold to the whole word."""
        opened, closed, tails, agree, end = self.open, self.shut, self.tails, self.agree, self.end
        for i in range(len(shut) + 1, len(word) + 1):
            for j in range(i - 1, -1, -1):
                t = word[j:i]
                if t not in tails:
                    break
                before = last[j]
                if len(last) == i and t in opened and (j == 0 or ((known := agree.get((before, t))) or known is None and self._learn(before, t, ""))):
                    last.append(t)
                    count.append(count[j] + 1)
                if len(shut) < i and (whole := closed.get(t)) and (j == 0 or ((known := agree.get((before, whole))) or known is None and self._learn(before, t, end))):
                    shut.append(count[j] + 1)
                if len(shut) == i < len(last):
                    break

    def piece(self, word: str) -> list[int]:
        """Counts at the prefixes of one spelled pre-token, each prefix taken as ending there."""
        self.grow(word, [""], [0], shut := [])
        return shut

    def compute(self, chunks: list[bytes], known=lambda chunk: None) -> list[bytes | list[int]]:
        """Counts at every character prefix of each chunk, from its first character to the whole."""
        out: list = [None] * len(chunks)
        todo = []
        for k, raw in enumerate(chunks):
            core = core_of(raw)
            if core is not raw and isinstance(got := known(core), bytes) and got[-1] < 255:
                out[k] = got + bytes([got[-1] + 1])
                continue
            text = raw.decode()
            if len(text) < 200 and (m := _PLAIN.fullmatch(text)) and (not m[1] or m[1].isalpha()):  # superscripts and fractions are numbers to the vocabulary
                low = m[1].lower()
                if low.isascii():
                    todo.append((low, k, low, m[2]))
                    continue
                if len(low) == len(m[1]) and max(low) < "\u0250":  # composed Latin letters: each is lowered by itself
                    todo.append((spelled(low), k, low, m[2]))
                    continue
            got = self.slow(text)
            out[k] = bytes(got) if max(got) < 256 else got
        todo.sort()
        before, last, count, shut = "", [""], [0], []
        for word, k, low, tail in todo:
            n = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                n += 1
            if n < len(before):
                del last[n + 1 :], count[n + 1 :], shut[n:]
            if n < len(word):
                self.grow(word, last, count, shut)
            before = word
            got = shut if word is low else [shut[at] for at in accumulate([-1, *(len(ch.encode()) for ch in low)]) if at >= 0]
            if tail:
                base = got[-1] if low else 0
                got = [*got, *(base + n for n in self.piece(tail))]
            out[k] = bytes(got) if len(word) + len(tail) < 256 else got  # no more tokens than symbols
        return out

    def slow(self, text: str) -> list[int]:
        """Chunks with marks, digits or special strings. A special string is a token, but its beginnings are ordinary text."""
        out: list[int] = []
        base, done = 0, 0
        for m in _SPECIAL.finditer(text):
            counts = self.ordinary(text[done : m.end() - 1])
            out += [base + n for n in counts]
            base += 1 + (counts[m.start() - done - 1] if m.start() > done else 0)
            out.append(base)
            done = m.end()
        return out + [base + n for n in self.ordinary(text[done:])]

    def ordinary(self, text: str) -> list[int]:
        """Counts at every prefix of text without special strings, in time linear in its length (but for long runs of combining
        marks, whose order may change with each mark)."""
        out, walk = [], _Walk(self)
        for forms in self.forms(text):
            before, marks = "", []
            for form in forms:
                same = len(before) if form.startswith(before) else next(n for n, (a, b) in enumerate(zip(before, form + "\0")) if a != b)
                if same < len(before):
                    walk.back(marks[same])
                    del marks[same:]
                for ch in form[same:]:
                    marks.append(walk.mark())
                    walk.step(ch)
                before = form
                out.append(walk.total())
        return out

    def forms(self, text: str) -> Iterator[Iterable[str]]:
        """For each part of text that normalising keeps apart from its neighbours: the normal forms of the part's prefixes."""
        if text.isascii():
            yield from zip(text.lower())
            return
        normal = self.library.normalizer.normalize_str
        starts = [k for k, ch in enumerate(text) if not k or not joins_left(ch)]
        parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
        if "".join(map(normal, parts)).replace(" ", "") != normal(text).replace(" ", ""):  # letters newer than Python's tables
            parts = [text]
        for part in parts:
            yield (normal(part),) if len(part) == 1 else (normal(part[:k]) for k in range(1, len(part) + 1))

    def kind(self, ch: str) -> str:
        """What the pre-tokenizer takes a character for: letter, number, other mark or space."""
        if (known := self.kinds.get(ch)) is None:
            cut = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
            known = self.kinds[ch] = "space" if not cut(ch) else "letter" if cut("a" + ch) == 1 else "mark" if cut("!" + ch) == 1 else "number"
        return known

    def alone(self, token: str) -> int:
        """Tokens of a pre-token that is a number or a contraction."""
        if (known := self.singles.get(token)) is None:
            known = self.singles[token] = self.piece(spelled(token))[-1]
        return known


class _Walk:
    """The pre-tokenizer's cuts and the counts of the pre-tokens so far, a character at a time.

    Runs of letters and runs of marks are pre-tokens, and so is every number. A mark run that begins with an
    apostrophe may turn out a contraction: held has what there is of it, and base stands before it.
    """

    LETTERS = 4096  # of a run that are kept: no token is as long as half of it

    def __init__(self, counter: PrefixCounter) -> None:
        self.counter, self.closed, self.base, self.held = counter, 0, 0, ""
        self.begin("")

    def begin(self, kind: str) -> None:
        self.kind, self.word, self.last, self.count, self.shut = kind, "", [""], [0], []

    def total(self) -> int:
        return self.closed + (self.shut[-1] if self.word else 0)

    def mark(self) -> tuple:
        return self.closed, self.base, self.held, self.kind, self.word, self.last, self.count, self.shut, len(self.shut)

    def back(self, mark: tuple) -> None:
        self.closed, self.base, self.held, self.kind, self.word, self.last, self.count, self.shut, n = mark
        del self.last[n + 1 :], self.count[n + 1 :], self.shut[n:]

    def close(self, kind: str) -> None:
        self.closed = self.total()
        self.begin(kind)

    def step(self, ch: str) -> None:
        held, self.held = self.held, ""
        if held and held + ch in CONTRACTIONS:
            self.closed = self.base + self.counter.alone(held + ch)
            self.begin("")
            return
        kind = self.counter.kind(ch)
        if held == "'" and any(c.startswith(held + ch) for c in CONTRACTIONS):
            self.held = held + ch
        if kind == "number" or kind == "space":
            self.close("")
            self.closed += self.counter.alone(ch) if kind == "number" else 0
            return
        if kind != self.kind:
            self.close(kind)
            if ch == "'":
                self.held, self.base = ch, self.closed
        if len(self.word) > self.LETTERS:
            n = self.LETTERS // 2
            self.word, self.last, self.count, self.shut = self.word[-n:], self.last[-n - 1 :], self.count[-n - 1 :], self.shut[-n:]
        self.word += spelled(ch)
        self.counter.grow(self.word, self.last, self.count, self.shut)


last_count = itemgetter(-1)
