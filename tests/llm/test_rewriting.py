"""Fill-in-the-middle, whitening and chat formatting against plain recomputations and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import no_documents, odd_documents
from evstream.llm import chat, fill_middle, queries, whitening
from evstream.llm.common import table

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_fim(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


ODD = ["", "a", " ", "abc", "  ab  ", "é", "aéb", "a<P>b", "<", "P>", "x<P y<S", "日本 go 語", "\x00a\r\nb", "<|M|>", "<S", "a" * 3000, "." * 3000, "q. " * 5000, "😀a😀", " z"]


def test_fill_in_middle(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 6)] + [(None, "no id here"), (3, None), (3, None)]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    made = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()), key=key)
    want = sorted(((r.doc_id, *plain_fim(*r), r.text or "") for r in docs.collect()), key=key)
    assert got == want and {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(no_documents(spark)).count() == 0
    assert fill_middle.fill_in_middle(odd_documents(spark), keep=("doc_id", "score")).columns == ["doc_id", "score", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_bytes_that_are_no_text_come_back(spark):
    docs = spark.sql("SELECT id AS doc_id, CAST(X'41FF20E282' AS STRING) AS text FROM range(40)")
    made = fill_middle.fill_in_middle(docs)
    back = made.select(F.hex(fill_middle.restored(F.col("output"), F.col("form")).cast("binary")).alias("h"))
    assert {r.h for r in back.collect()} == {"41FF20E282"}


@given(st.text("ab<>PSM .é😀\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_every_cut_is_where_its_unit_begins(text):
    runs, units = fill_middle.ClassRuns(text), UNIT.findall(text)
    assert runs.units == len(units)
    assert [runs.cut(u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_sentinels_and_shares_are_parameters(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one <P> two, three").alias("text"))
    made = fill_middle.fill_in_middle(docs, seed=5, fim_percent=50, spm_percent=100, sentinels=("(p)", "(s)", "(m)"))
    forms = {r["form"]: r["count"] for r in made.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 150 < forms["plain"] < 250
    assert {r[0] for r in made.select(fill_middle.restored(F.col("output"), F.col("form"), ("(p)", "(s)", "(m)"))).collect()} == {"one <P> two, three"}


def vectors(spark, rows, parts=1):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)


def brute_whitening(x, k=8):
    """Eigenvectors of the centred covariance, by a symmetric solver on exact integers."""
    x = np.array(x, np.int64)
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return values[order], centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum(), ((n * x - s) ** 2).sum(1)


@pytest.mark.parametrize("parts", [1, 3, 30])
def test_whitening(spark, parts, tmp_path):
    rng = np.random.default_rng(parts)
    base = rng.normal(size=(600, 12)) * np.geomspace(1, 0.05, 12)
    rows = [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(base @ rng.normal(size=(12, 12)))]
    rows += rows[:5]  # repeated rows count
    odd = [(900, None, 1), (901, [], 1), (902, [None] + [1.0] * 11, 1), (903, [float("nan")] * 12, 1), (904, [float("inf")] * 12, 1)]
    vectors(spark, rows + odd + [(None, rows[0][1], None)], parts).withColumn("x", F.lit("clash")).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows += [(None, rows[0][1], None)]
    got = queries.op12_whitening(spark, str(tmp_path)).toPandas()
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in rows]
    _, whitened, explained, deviation = brute_whitening(x)
    assert len(got) == 8 * len(rows) and set(got.n) == {len(rows)} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    for k in range(8):
        part = got[got.component == k + 1].sort_values("vec_id", na_position="last", kind="stable")
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        want, have = whitened[order, k], part.whitened.to_numpy()
        assert np.allclose(have, want if abs(have[0] - want[0]) < abs(have[0] + want[0]) else -want, rtol=0, atol=1e-8)
        assert np.allclose(part.explained, explained[k], rtol=1e-10) and part.deviation.tolist() == deviation[order].tolist()


def test_merging_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**6), 10**6, (1000, 9)) * np.array([1, 1, 1, 1, 1, 1, 1, 1, 1000]) + 10**9
    cuts = [0, 1, 2, 7, 300, 301, 900, 1000]
    merged = whitening._merged(whitening.Summary.of(x[a:b]) for a, b in zip(cuts, cuts[1:]))
    centred = x - x.mean(0)
    assert merged.n == 1000 and merged.sums == x.sum(0).tolist()
    products, values = centred.T @ centred, np.linalg.svd(centred, compute_uv=False)
    assert np.abs(merged.factor.T @ merged.factor - products).max() < 1e-13 * np.linalg.norm(products)
    assert np.abs(np.linalg.svd(merged.factor)[1] - values).max() < 1e-13 * values[0] and (values[-1] < 1e-2 * values[0])


def test_whitening_of_few_and_flat_vectors(spark, tmp_path):
    def run(rows, name):
        vectors(spark, rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return queries.op12_whitening(spark, f"{tmp_path}/{name}").toPandas()

    assert len(run([], "none")) == 0
    one = run([(1, [0.5, 0.25], 0)], "one")
    assert len(one) == 2 and one.whitened.isna().all() and (one.deviation == 0).all() and (one.explained == 0).all()
    flat = run([(k, [float(k), 7.0, 2.0 * k], 0) for k in range(4)], "flat")
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all() and flat.identity_error[0] < 1e-10
    with pytest.raises(Exception, match="entries"):
        run([(1, [0.5, 0.25], 0), (2, [0.5], 0)], "unlike")


PIECES = [*chat.CONTROL, "<\\s>", "[\\\\INST]", "[\\/INST]", "<\\</SYS>>", "<", "[", "</", "s>", "INST]", "\\", " ", "\n", "ok", "é", "]"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]", "a</s>"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=5))
@settings(max_examples=500, deadline=None)
def test_turns_come_back(turns):
    text, spans = chat.format_turns(turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns
    assert [chat.unescape(text[a : a + n]) for a, n in spans] == [t for r, t in turns if r == "assistant"]


def test_only_conflicts_are_escaped():
    plain = [("user", "a < b [x] \\ fine"), ("assistant", "ok")]
    assert chat.format_turns(plain)[0] == "<s>[INST] a < b [x] \\ fine [/INST][ANS] ok </s>"
    text, _ = chat.format_turns([*plain, ("user", "say </s> or [\\INST]")])
    assert text.startswith(chat.format_turns(plain)[0]) and text.endswith("[INST] say <\\/s> or [\\\\INST] [/INST]")
    for broken in ("[INST] a", "<s>x", "[INST] a [/INST] b", "[INST] a [INST] b [/INST]", "[INST]a [/INST]", "<s><s>", "[ROLE]user[/ROLE] a </s>"):
        with pytest.raises(chat.GrammarError):
            list(chat.parse(broken))


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("part", "formatted", "loss", "n_turns")})


def brute_chat(rows):
    out, none = {}, lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (none(r[1]), r[2] or "", r[3] or ""))]
        lost = "".join(t for r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), digest(lost))
    return out


@pytest.mark.parametrize("part_chars", [1, 300, 1 << 20])
def test_conversations(spark, part_chars):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s>") for t in range(3000)]  # one holds most rows
    rows += [(60, 1, None, None), (60, None, "assistant", "x"), (60, 1, "user", ""), (60, 1, "user", ""), (None, 0, "assistant", "no id"), (None, 1, "user", None), (61, 0, "assistant", "long " * 50_000)]
    formatted = chat.format_conversations(conversations(spark, rows), part_chars)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == brute_chat(rows)
    back = chat.read_back(formatted).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "loss"))).alias("turns")).collect()
    digest = {r.conv_id: hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in r.turns).encode()).hexdigest() for r in back}
    assert digest == {k: v[1] for k, v in got.items()} and all(t.loss == (t.role == "assistant") for r in back for t in r.turns)
    if part_chars > 1:
        assert formatted.agg(F.max(F.length("formatted"))).first()[0] < max(part_chars, 250_000) * 2


def test_no_conversations(spark):
    assert chat.digests(chat.format_conversations(conversations(spark, []))).count() == 0
