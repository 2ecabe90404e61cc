"""Operators over documents against plain recomputations."""

import hashlib
import random
import re
import subprocess
import sys
import time
import tracemalloc
import unicodedata
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import LONG, ODD, no_documents, odd_documents
from evstream.llm import exact_dedup, licences, packing, sentencepieces, sharding, simhash, token_counts, words
from evstream.llm.common import UnionFind, WordMemo, connected_components

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))


@pytest.fixture(scope="module")
def rows(corpus):
    return [tuple(r) for r in corpus.select("doc_id", "text").collect()]


def test_token_counts(spark, corpus, rows):
    got = token_counts.prefix_token_counts(corpus, prefixes=False).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(i), len((t or "").encode()), len(ids(t))) for i, t in rows)
    assert token_counts.prefix_token_counts(no_documents(spark)).count() == 0


def test_every_prefix_has_its_count(spark):
    texts = ["", "don't stop, it's naïve", "É́a  x\n<|endoftext|>y", "'re 12 日本", "x" * 90 + "'s " + "a'" * 80 + "re"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_counts.prefix_token_counts(docs)
    for r in found.collect():
        assert r.prefix_tokens == [len(ids(texts[r.doc_id][:k])) for k in range(len(texts[r.doc_id]) + 1)]
    ask = found.select("doc_id", token_counts.tokens_of_prefix(F.col("prefix_tokens"), 9).alias("n"), token_counts.cut_for_budget(F.col("prefix_tokens"), 4).alias("cut"), token_counts.fits_budget(F.col("prefix_tokens"), 4).alias("fits"))
    for r in ask.collect():
        t = texts[r.doc_id]
        assert r.n == len(ids(t[:9])) and r.fits == (len(ids(t)) <= 4)
        assert r.cut == max(k for k in range(len(t) + 1) if len(ids(t[:k])) <= 4)


def prefix_counts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_tokens, r.prefix_tokens) for r in token_counts.prefix_token_counts(docs).collect()}


def test_superscripts_and_fractions_are_numbers(spark):
    texts = ["meters² miles³, kilometres²", "x¹y", "½", "one¼.", "a¾b²", "naïve ªº"]
    assert prefix_counts(spark, texts) == {k: (len(ids(t)), [len(ids(t[:n])) for n in range(len(t) + 1)]) for k, t in enumerate(texts)}


def test_a_chunk_may_have_over_255_tokens(spark):
    texts = ["þ" * 190, "a " + "ǿ" * 199 + ".", "ȿ" * 190 + "!!", "ɏ" * 128, "þ" * 127 + "."]
    assert len(ids(texts[0])) > 255
    assert prefix_counts(spark, texts) == {k: (len(ids(t)), [len(ids(t[:n])) for n in range(len(t) + 1)]) for k, t in enumerate(texts)}


def test_long_texts_are_counted_in_pieces(spark):
    memo = token_counts._memo(words.word_bpe_path())
    rng = random.Random(5)
    text = "".join(rng.choice(["don't", " ", "\n\t", "É́a", "x" * 40, "<|endoftext|>", "日本", "12", "。", " the"]) for _ in range(900))
    want = [len(ids(text[:k])) for k in range(len(text) + 1)]
    for size in (1, 7, 100, 10**6):
        assert b"".join(token_counts.pieces_of(text.encode(), size)) == text.encode()
        assert token_counts.long_prefix_array(text.encode(), memo, size).tolist() == want
    assert token_counts.long_prefix_array(b"", memo).tolist() == [0]
    long = "Longish words, 12 of them. " * 50_000 + "x" * 1000
    docs = spark.createDataFrame([(1, long), (2, None), (3, "a b"), (4, long)], "doc_id long, text string")
    for prefixes in (True, False):
        got = {r.doc_id: r.n_tokens for r in token_counts.prefix_token_counts(docs, prefixes=prefixes).drop("prefix_tokens").collect()}
        assert got == {1: len(ids(long)), 2: 0, 3: 2, 4: len(ids(long))} and len(long) > token_counts.PIECE_BYTES


def test_a_hundred_megabytes_take_less_than_eight_bytes_a_character():
    code = """
import resource
from evstream.llm import token_counts, words
memo = token_counts._memo(words.word_bpe_path())
text = b"several ordinary words, again and again; " * (100_000_000 // 41)
rss = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
token_counts.long_prefix_array(text[: 4 << 20], memo)
before = rss()
counts = token_counts.long_prefix_array(text, memo)
assert len(counts) == len(text) + 1 and counts[-1] == len(text) // 41 * counts[41], (len(counts), counts[-1])
print((rss() - before) / len(text))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2])
    assert done.returncode == 0 and float(done.stdout) < 8, done


def test_prefixes_of_odd_strings():
    rng, counter = random.Random(1), words.PrefixCounter(words.word_bpe_path())
    parts = list("abcrstvelmd''''!.,-_019éÉİßŁﬁ²½ªº日本語가각ΣςΩ😀") + ["\u0301", "\u0323", "\u1100", "\u1161", "\u11a8", "\u00a0", "\u3000", "\x85", "\u212b", "か", "\u3099", "\u0344", "\u09c7", "\u09be", "<|endoftext|>", "<|", "'re", "'S"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert counter.slow(text) == [len(ids(text[:k])) for k in range(1, len(text) + 1)], repr(text)


def test_long_texts_without_white_space_take_linear_time(spark):
    texts = [unicodedata.normalize("NFD", "がぎぐげご") * 10_000, unicodedata.normalize("NFD", "한국어텍스트") * 7000, "e\u0301" * 50_000, "ab1'c" * 20_000, "İ" * 100_000]
    counter = words.PrefixCounter(words.word_bpe_path())
    for text in texts:
        assert len(text) >= 99_000
        began = time.process_time()
        counts = counter.slow(text)
        assert time.process_time() - began < 4
        assert counts[-1] == len(ids(text))
        assert all(counts[k - 1] == len(ids(text[:k])) for k in (1, 2, 3, 4999, 5000, 5001))
    assert prefix_counts(spark, texts[:1])[0][0] == len(ids(texts[0]))


def test_long_chunks_are_not_remembered():
    memo = WordMemo(lambda chunks, known: map(len, chunks))
    counts = memo.load([[b"a" * 5000, b"bc"]])
    assert counts(b"a" * 5000) == 5000 and counts(b"bc") == 2 and list(memo.young) == [b"bc"]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits, owner_rows", [(48, 1 << 16), (48, 8), (4, 8)])  # four bits: most fingerprints collide
def test_exact_dedup(spark, corpus, rows, bits, owner_rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = sorted((str(i), str(keep[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_duplicates(corpus.repartition(3), bits=bits, owner_rows=owner_rows).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_whole_rows(spark):
    docs = odd_documents(spark)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(normal(r.text) for r in got.collect()) == sorted({normal(r[1]) for r in ODD})
    assert exact_dedup.drop_exact_duplicates(no_documents(spark)).count() == 0


def test_golomb_codes():
    rng = np.random.default_rng(0)
    for n, span in ((1, 1), (1, 1 << 48), (1000, 1 << 48), (1000, 1 << 10)):
        v = np.unique(rng.integers(0, span, n))
        k, unary, rest = exact_dedup.golomb_encode(v, span)
        assert (exact_dedup.golomb_decode(len(v), k, unary, rest).astype(np.int64) == v).all()
    k, unary, rest = exact_dedup.golomb_encode(v := np.unique(rng.integers(0, 1 << 48, 5000)), 1 << 48)
    assert len(unary) + len(rest) < 6 * len(v)


def test_packing(spark, corpus, rows):
    packed = packing.pack_documents(corpus, capacity=256, with_ids=True)
    got, seen, sequences = packed.collect(), defaultdict(int), defaultdict(list)
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append(ids(t) + [0])
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert any(own == w[r.start : r.start + r.length] for w in whole[r.doc_id]) and r.start == r.piece * 256
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    assert seen == {i: sum(map(len, w)) for i, w in whole.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.005 * sum(seen.values()) / 256 + 1
    assert packing.packed_sequences(packed).where(F.length("ids") != F.col("n_tokens") * 4).count() == 0
    assert packing.pack_documents(no_documents(spark)).count() == 0


def test_packing_is_the_same_without_broadcast(spark, corpus, monkeypatch):
    columns = ["doc_id", "piece", "length", "sequence_id", "offset", "ids_crc32"]
    own = lambda df: sorted(map(str, df.select(columns).collect()))
    pieces = packing.materialize(packing.token_pieces(corpus, capacity=256), "pieces")
    want = own(packing.pack_pieces(pieces, 256))
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    joined = packing.pack_pieces(pieces, 256)
    assert own(joined) == want and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_sums_of_three_lengths_are_found():
    stock = packing._Stock({50: 2, 17: 1, 13: 1, 3: 3}, 100)
    assert stock.exact(33) == (17, 13, 3) and stock.exact(9) == (3, 3, 3) and stock.exact(100) == (50, 50)
    assert stock.exact(12) is None and stock.exact(51) is None and stock.exact(33, 2) is None


def test_packing_plan_uses_each_piece_once():
    rng = np.random.default_rng(5)
    for top in (3, 40, 100):
        counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, top + 1, 500), return_counts=True))}
        plan, used = packing.plan_packing(counts, 100), defaultdict(int)
        for pattern, times in plan:
            assert sum(pattern) <= 100 and times > 0
            for k in pattern:
                used[k] += times
        assert used == counts
        assert sum(t for _, t in plan) <= 2 + -(-sum(k * v for k, v in counts.items()) // 100) or top == 100


def plain_simhash(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("segments", [None, 16])
def test_simhash(spark, corpus, rows, segments):
    fp = [plain_simhash(t) for _, t in rows]
    links = UnionFind()
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                links.union(a, b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[links.find(k)] = min(i, low.get(links.find(k), i))
    want = sorted((str(i), f"{fp[k]:016x}", str(low.get(links.find(k)))) for k, (i, _) in enumerate(rows))
    got = simhash.simhash_groups(corpus, segments=segments).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_simhash_kernel_finds_every_pair_and_large_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    masks = simhash.flips(3)
    fp = np.unique(np.concatenate([base, base[:40] ^ rng.choice(masks, 40), base[0] ^ masks[:2500], base[:20] ^ rng.choice(masks, 20) ^ rng.choice(masks, 20)]))
    want = UnionFind()
    for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))):
        want.union(int(fp[a].view(np.int64)), int(fp[b].view(np.int64)))
    for segments in (4, 8):
        got, parts = UnionFind(), [[], [], []]
        for side, reach in ((0, 1), (1, 2)):
            row, keys = simhash.grid_points(fp, segments, reach)
            for part, x in zip(parts, (keys, np.full(len(keys), side), fp[row])):
                part.append(x)
        simhash.link_groups(*(np.concatenate(p) for p in parts), 3, got)
        assert sorted(got.edges()) == sorted(want.edges())


def test_hot_points_are_searched_by_flipping_bits():
    masks = simhash.flips(1)
    fp = np.unique(np.arange(1 << 18, dtype=np.uint64))[:: 3][:70_000]
    got = UnionFind()
    both = np.concatenate([fp, fp[:100]])
    simhash.link_groups(np.zeros(len(both), np.int64), np.concatenate([np.zeros(len(fp), np.int64), np.ones(100, np.int64)]), both, 1, got)
    for x in fp[:100]:
        for y in x ^ masks:
            if y in fp:
                assert got.find(int(x)) == got.find(int(y))


def test_a_crowded_point_is_compared_in_blocks():
    """One point with 9,000,000 pairs: what is held is a block's, and the links are those of all pairs."""
    rng = np.random.default_rng(8)
    fp = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) & np.uint64(0x3F3F3F3F3F3F))
    fp[1::2] = fp[::2][: len(fp[1::2])] ^ np.uint64(5)  # every other one is near the one before
    fp = np.unique(fp)
    side = np.repeat([0, 1], len(fp))
    links = UnionFind()
    tracemalloc.start()
    simhash.link_groups(np.zeros(2 * len(fp), np.int64), side, np.concatenate([fp, fp]), 3, links)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = UnionFind()
    for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))):
        want.union(int(fp[a].view(np.int64)), int(fp[b].view(np.int64)))
    assert sorted(links.edges()) == sorted(want.edges()) and len(want.edges()) > 1000 and held < 100 << 20


def test_simhash_drop(spark):
    docs = odd_documents(spark)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(8) == 0 and kept.count(7) == 1 and kept.count(4) == 1 and kept.count(5) == 0 and kept.count(None) == 0  # rows without an id resemble ones with
    assert simhash.drop_near_duplicates(no_documents(spark)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 50)] + [(5, 5)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentencepiece(spark, corpus, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.piece_bpe_path())
    want = sorted((str(i), np.array(library.encode(t or ""), "<u4").tobytes()) for i, t in rows)
    for chunk in (sentencepieces.CHUNK_CHARS, 700):
        coded = sentencepieces.encode(corpus, chunk=chunk)
        got = coded.collect()
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
        assert all(r.round_trip and r.n_ids * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) for r in got)
        assert max(r.n_chunks for r in got) > 1
    back = sorted((str(r.doc_id), r.text) for r in sentencepieces.decode(coded).collect())
    assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert sentencepieces.encode(no_documents(spark)).count() == 0


def test_scan_at_any_cut_is_the_whole_encoding():
    model = sentencepieces.PieceModel(sentencepieces.piece_bpe_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.piece_bpe_path())
    rng = np.random.default_rng(2)
    for text in ("the quick brown foxes", "日本語テキスト😀" * 8, "x" * 90, "ab" * 50 + " " * 40 + "the" * 9, "internationalization" * 4):
        whole = "▁" + text.replace(" ", "▁")
        cuts = sorted(rng.choice(np.arange(1, len(whole)), 5, replace=False).tolist())
        places = [(0, True), *((c, False) for c in cuts), (len(whole), True)]
        parts = [(whole[max(0, a - 32) : a], whole[a:b], of, cf) for (a, of), (b, cf) in zip(places, places[1:])]
        matrices = [model.matrix(p, left, of, cf) for left, p, of, cf in parts]
        start = sentencepieces.START
        left = sentencepieces.combine(sentencepieces.combine(matrices[0], matrices[1]), matrices[2])
        right = sentencepieces.combine(matrices[0], sentencepieces.combine(matrices[1], matrices[2]))
        assert left == right  # the product is associative
        products = [{start: {start: 0.0}}]
        for m in matrices:
            products.append(sentencepieces.combine(products[-1], m))
        states = [start]
        for k in range(len(matrices) - 1, -1, -1):
            states.append(next(s for s in products[k][start] if states[-1] in matrices[k].get(s, {})))
        states.reverse()
        tokens = [t for k, (left, p, of, cf) in enumerate(parts) for t in model.backtrace(p, left, of, cf, states[k], states[k + 1])]
        assert np.frombuffer(model.pack(tokens), "<u4").tolist() == library.encode(text)


def test_states_down_a_tree_are_those_of_the_whole_encoding():
    model = sentencepieces.PieceModel(sentencepieces.piece_bpe_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.piece_bpe_path())
    for text in ("internationalization of the quick brown foxes " * 9, "日本語テキスト😀 words" * 20, "x" * 300, "ab" * 50 + " " * 40 + "the" * 9):
        whole = "▁" + text.replace(" ", "▁")
        for chunk in (1, 7, 50):
            places = [*range(0, len(whole), chunk), len(whole)]
            parts = [(whole[max(0, a - 32) : a], whole[a:b], a == 0, b == len(whole)) for a, b in zip(places, places[1:])]
            matrices = [model.matrix(p, left, *ends) for left, p, *ends in parts]
            states = sentencepieces.middle_states(matrices)
            assert chunk == 1 or any(len(row) > 1 for m in matrices for row in m.values())
            tokens = [t for (left, p, *ends), *own in zip(parts, states, states[1:]) for t in model.backtrace(p, left, *ends, *own)]
            assert np.frombuffer(model.pack(tokens), "<u4").tolist() == library.encode(text)


def test_joined_crc():
    parts = [b"", b"abc", b"x" * 70_000, b"", b"\0\0"]
    assert sentencepieces.joined_crc([zlib.crc32(p) for p in parts], list(map(len, parts))) == zlib.crc32(b"".join(parts))


def test_licences(spark):
    texts = {
        1: "Intro.\nReleased under the MIT License.\nBody.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "nothing here", 4: None, 5: "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.",
        6: "His driving license was renewed.\nThe general public came.", 7: "Licensed under the Foo Public License, version 9.", 8: "", 9: LONG + "\nReleased under the BSD License.",
    }
    docs = spark.createDataFrame(list(texts.items()) + [(1, texts[1]), (None, texts[2])], "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = licences.scan_licences(docs).collect()
    found = sorted((str(r.doc_id), ",".join(r.families), r.n_paragraphs) for r in got)
    assert found == sorted([("1", "MIT", 3), ("1", "MIT", 3), ("2", "GPL", 1), ("None", "GPL", 1), ("3", "", 1), ("4", "", 1), ("5", "Apache-2.0,CC-BY-NC", 2), ("6", "", 2), ("7", "unknown", 1), ("8", "", 1), ("9", "BSD", 2)])
    assert licences.scan_licences(no_documents(spark)).count() == 0


NOTICES = [  # of licences that no training text names
    "Licensed under the Common Development and Distribution License, version 1.1.", "Released under the PostgreSQL License.", "SPDX-License-Identifier: CDDL-1.0", "This work is licensed under the Open Data Commons Attribution License, version 1.0.",
    "Distributed under the terms of the Python Software Foundation License.", "Licensed under the Microsoft Public License.", "Distributed under the Academic Free License, version 3.0.", "This file is licensed under the Zope Public License, version 2.1.",
    "This software is released under the Ruby License.", "Use of this software is governed by the Business Source License.",
]
NO_NOTICES = [
    "The license of the pub was taken away.", "He gave permission to copy the notes.", "A public library was opened in the region.", "The software company was founded in 1998.", "Version 4 of the song was released.",
    "The work was distributed among the children.", "The terms of the contract were clear.", "The source of the river is in the hills.", "All copies of the book were sold.", "The foundation published a report.",
]


def test_notices_of_families_never_seen_are_unknown(spark):
    seen = {t for ts in licences.TEMPLATES.values() for t in ts} | {*licences.OTHERS, *licences.LOOK_ALIKES}
    assert not seen & {*NOTICES, *NO_NOTICES}
    gap, right = licences.reliability(licences.train(), [(t, True) for t in NOTICES] + [(t, False) for t in NO_NOTICES])
    assert right == 1.0 and gap < 0.1
    docs = spark.createDataFrame(list(enumerate([*NOTICES, *NO_NOTICES])), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan_licences(docs).collect()}
    assert [got[k] for k in range(len(got))] == [["unknown"]] * len(NOTICES) + [[]] * len(NO_NOTICES)


def test_tags_and_clauses_name_their_family(spark):
    texts = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ("\n".join(f"  {x}" for x in ts), f"// {ts[-1]}")]
    docs = spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan_licences(docs).collect()}
    assert all(f in got[k] for k, (f, _) in enumerate(texts))
    assert all(got[k] == [f] for k, (f, t) in enumerate(texts) if t.startswith("//"))


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
}


def test_wrapped_licences_are_named(spark):
    texts = [f"Intro.\n\n{t}\n\nBody." for t in WRAPPED.values()] + [t.replace(" ", "\n") for t in WRAPPED.values()]
    texts += ["/*\n" + "\n".join(f" * {line}" for line in t.split("\n")) + "\n */" for t in WRAPPED.values()]
    texts += [WRAPPED["BSD"].replace("\n", "\n\n"), "His driving license was renewed.\nThe general public came.\nThe software was released in version 3."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert [got[k].families for k in range(9)] == [[f] for f in WRAPPED] * 3
    assert "BSD" not in got[9].families and got[10].families == []  # a blank line ends a paragraph
    assert [(s.paragraph, s.length) for s in got[1].licences] == [(2, len(WRAPPED["BSD"]))]
    assert [s.paragraph for s in got[0].licences][-1] == 9 and all(r.n_paragraphs == texts[k].count("\n") + 1 for k, r in got.items())


def test_licence_sums_are_the_models(spark):
    model = licences.train()
    texts = [t for ts in licences.TEMPLATES.values() for t in ts] + licences.LOOK_ALIKES
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = [*model.families, "none"]
    for r in licences.scan_paragraphs(docs, model=model).collect():
        p = model.probabilities(texts[r.doc_id])
        assert abs(r.probability - p.max()) < 1e-6
        family = next(f for f, ts in [*licences.TEMPLATES.items(), (None, licences.LOOK_ALIKES)] if texts[r.doc_id] in ts)
        assert names[p.argmax()] == (family or "none") and r.family == family


def test_sharding(spark, corpus, rows):
    for limit in (40_000, 3000, 200_000):
        got = sharding.assign_shards(corpus, limit=limit).collect()
        assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in rows)
        shards = defaultdict(list)
        for r in got:
            shards[r.shard_id].append(r)
        bits = {i: f"{int(hashlib.md5(str('' if i is None else i).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
        sums = defaultdict(int)
        for i, t in rows:
            if len((t or "").encode()) <= limit:
                for d in range(61):
                    sums[bits[i][:d]] += len((t or "").encode())
        for name, own in shards.items():
            assert sum(r.n_bytes for r in own) <= limit or (len(own) == 1 and name.startswith("single"))
        for r in got:
            if r.shard_id.startswith("b"):
                assert r.shard_id[1:] == bits[r.doc_id][: r.depth] and sums[r.shard_id[1:]] <= limit
                assert r.depth == 0 or sums[bits[r.doc_id][: r.depth - 1]] > limit
    assert sharding.assign_shards(no_documents(spark)).count() == 0


def test_one_hot_key_is_dealt(spark):
    docs = spark.createDataFrame([(1, "x" * (k % 7 + 1)) for k in range(200)] + [(2, "y" * 10)], "doc_id long, text string")
    got = sharding.assign_shards(docs.repartition(3), limit=50).groupBy("shard_id").agg(F.sum("n_bytes").alias("n"))
    assert got.agg(F.max("n")).first()[0] <= 50 and got.agg(F.sum("n")).first()[0] == sum(k % 7 + 1 for k in range(200)) + 10


def test_write_shards(spark, tmp_path):
    docs = odd_documents(spark).drop("__key")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=100_000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_folders_of_a_hot_key_stay_within_the_limit(spark, tmp_path):
    rows = [(7, f"{k:04d}" * 25) for k in range(300)] + [(7, "same" * 25)] * 300 + [(k, "x" * 90) for k in range(100, 300)] + [(8, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard_id", F.lit("clash")).repartition(6)
    sharding.write_shards(docs, str(tmp_path / "out"), limit=4000)
    got = spark.read.parquet(str(tmp_path / "out"))
    sizes = got.groupBy("shard_id").agg(F.sum(F.length("text")).alias("bytes"), F.count("*").alias("n")).collect()
    assert sum(s["n"] for s in sizes) == len(rows) and sum(r.doc_id == 7 for r in got.select("doc_id").collect()) == 600
    assert all(s["bytes"] <= 4000 or s["n"] == 1 and s["bytes"] == 5000 for s in sizes)


def test_chunk_ids_are_the_librarys():
    text = "Don't “quote”, naïve É́a <|endoftext|> a.b. x. É. ʰa K Å ﬁ ß. 12.5 <|ENDOFTEXT|>"
    got = b"".join(words.chunk_ids(words.word_bpe_path())(words.chunks_of(text.encode())))
    assert np.frombuffer(got, "<u4").tolist() == ids(text)


def test_token_query_answers_from_prefixes(spark, monkeypatch):
    from evstream.llm import queries

    asked = []
    plain = token_counts.prefix_token_counts
    monkeypatch.setattr(token_counts, "prefix_token_counts", lambda *a, **k: asked.append(out := plain(*a, **k)) or out)
    got = queries.op1_token_counts(spark, "/root/testdata/sf0.001")
    assert ["prefix_tokens" in df.columns for df in asked] == [True]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(ids(r.text)), n > queries.TOKEN_LIMIT) for r in docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and sorted(map(tuple, got.collect())) == want


def test_a_worker_keeps_one_operators_memory():
    from evstream.llm.common import kept_alone

    first = kept_alone("one", lambda: [1])
    assert kept_alone("one", lambda: [2]) is first
    assert kept_alone("two", lambda: [3]) == [3] and kept_alone("one", lambda: [4]) == [4]
