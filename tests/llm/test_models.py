"""Toxicity, embeddings, archives and the pipeline."""

import base64
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import no_documents, odd_documents
from evstream.llm import hnsw, queries, toxicity, warc
from evstream.llm.common import UnionFind, table

SF = "/root/testdata/sf0.01"


LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(table(spark, LARGE, "documents"), table(spark, LARGE, "labels"))


def test_held_out_accuracy(spark, model):
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    held = labels.where(toxicity.held_out()).select("doc_id", "toxic")
    scored = toxicity.score(docs.join(F.broadcast(held), "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in scored) / len(scored)
    wrong = sum(r.predicted == 1 and r.toxic == 0 for r in scored)
    assert hit > 0.97 and wrong <= 0.005 * len(scored)
    assert sum(r.predicted for r in scored if r.toxic) > 0.85 * sum(r.toxic for r in scored)
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in scored)


def test_training_hangs_on_no_order_of_sums(spark):
    """Batches whose texts stand in another order: the same steps but for rounding."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").where("toxic is not null")
    rows = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    texts, marks = [r.text.encode() for r in rows], [r.toxic for r in rows]

    class Backwards:
        def __init__(self, seed):
            self.rng = np.random.default_rng(seed)

        def normal(self, *a):
            return self.rng.normal(*a)

        def permutation(self, n):
            order = self.rng.permutation(n)
            return np.concatenate([order[k : k + toxicity.BATCH][::-1] for k in range(0, n, toxicity.BATCH)])

    live, share, bags = toxicity._live_bags(texts, toxicity.BUCKETS)
    one, two = (toxicity._descend(bags, share, np.array(marks), rng)[0] for rng in (np.random.default_rng(3), Backwards(3)))
    assert len(live) > 100 and np.corrcoef(one, two)[0, 1] > 0.99


def plain_score(text, model):
    """The mean over the words of the mean over their buckets, one bucket after another."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    total = 0.0
    for w in words:
        core = "<" + (w.strip(b".,;:!?\"'()[]{}<>-_*") or w).decode().lower() + ">"
        raw = core.encode() if core.isascii() else core
        parts = [core.encode(), *((raw[k : k + n] if core.isascii() else raw[k : k + n].encode()) for n in (3, 4, 5) for k in range(len(raw) - n + 1))]
        total += sum(float(model.gains[zlib.crc32(x) % len(model.gains)]) for x in parts) / len(parts)
    return 1 / (1 + np.exp(-(model.bias + (total / len(words) if words else 0.0))))


def test_scores_are_those_of_a_plain_loop(spark, model):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    want = sorted((str(r.doc_id), plain_score(r.text, model)) for r in docs.collect())
    got = sorted((str(r.doc_id), r.score, r.predicted) for r in toxicity.score(docs, model).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=0, atol=1e-9)
    assert all(g[2] == (g[1] >= 0.7) for g in got)


MEAN = "filthy wretched scoundrel vermin"


def made_documents(spark, n=900, seed=4):
    """Half of them toxic: one word in twenty is an insult, sometimes misspelt."""
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("aeiourstlnm"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for k in range(n):
        words = rng.choice(plain, 60).tolist()
        if k % 2:
            for at in rng.choice(60, 3, replace=False):
                word = str(rng.choice(MEAN.split()))
                words[at] = word + word[-1] if rng.random() < 0.3 else word
        rows.append((k, " ".join(words), k % 2))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_made_documents_are_told_apart_and_held_out_labels_change_nothing(spark):
    made = made_documents(spark)
    docs, labels = made.select("doc_id", "text"), made.select("doc_id", "toxic")
    own = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, own).where(toxicity.held_out()).collect()}
    assert len(scored) > 250 and sum(scored[k] == k % 2 for k in scored) > 0.97 * len(scored)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("toxic")}), flipped)
    assert again.bias == own.bias and (again.gains == own.gains).all()
    assert (toxicity.fit(docs.repartition(5), labels.repartition(3)).gains == own.gains).all()


def test_training_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    made = made_documents(spark, 200)
    docs, labels, seen = made.select("doc_id", "text").unionByName(made.select("doc_id", "text")), made.select("doc_id", "toxic"), []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(texts))
    toxicity.fit(docs, labels, max_rows=50)
    toxicity.fit(docs, labels, max_bytes=3000)
    assert len(seen[0]) == 50 and 2000 < sum(map(len, seen[1])) <= 3000


def test_misspelt_words_score_by_their_parts(model):
    seen = dict(zip(w := [b"disgusting", b"disgustingg", b"disgustin", b"and"], model.word_gains(w)))
    assert seen[b"disgusting"] > 0 and seen[b"disgustingg"] > 0.2 * seen[b"disgusting"] and seen[b"disgustin"] > 0.2 * seen[b"disgusting"]
    assert abs(seen[b"and"]) < 0.1 * seen[b"disgusting"]


def test_odd_documents_and_labels(spark, model):
    docs = odd_documents(spark)
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(no_documents(spark), model).count() == toxicity.drop_toxic(no_documents(spark), model).count() == 0
    labels = spark.createDataFrame([(2, None), (None, 1), (999, 1), (4, 2)], "doc_id long, toxic int")
    nothing = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    held = [r[0] for r in spark.range(50).select(toxicity.held_out("id")).collect()]
    assert held == [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(50)]


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        base = rng.normal(size=(40, 16))
        near = np.repeat(base[:10], 6, 0) + rng.normal(0, 0.03, (60, 16))
        rows += [(v.tolist(), label) for v in np.concatenate([base, near, near[:5]])]
    rows += [(rows[0][0], None), (None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0] * 15 + [float("inf")], 1), ([1.0, None] * 8, 1), ([1.0] * 8, 1), ([2.0] * 8, 1), ([-0.0] + [1.0] * 7, 2), ([0.0] + [1.0] * 7, 2)]
    return [(k, *r) for k, r in enumerate(rows)]


def plain_links(rows, threshold):
    unit = {}
    for k, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(np.array(v, np.float32), float)
            unit[k] = unit[k] / np.sqrt(unit[k] @ unit[k])
    label = {k: g for k, _, g in rows}
    return {(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold}


@pytest.mark.parametrize("shard, block", [(8192, 2048), (20, 12)])
def test_near_embeddings(spark, shard, block):
    rows = vectors()
    links = plain_links(rows, 0.98)
    forest = UnionFind()
    for a, b in links:
        forest.union(a, b)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit(1), "row": F.lit(2)})
    got = {r.vec_id: r for r in hnsw.near_duplicates(df, shard_rows=shard, block_rows=block).collect()}
    assert len(got) == len(rows) and links
    for k, *_ in rows:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (sum(a == k for a, _ in links), forest.find(k), forest.find(k) == k)
    assert hnsw.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_embeddings_of_any_magnitude_and_label(spark):
    base = np.random.default_rng(8).normal(size=(6, 8))
    rows = [(10 * k + j, (v * scale).tolist(), f"label {k % 2}") for k, v in enumerate(base) for j, scale in enumerate((1.0, 1e200, 1e-200, 1e-310))]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, 3, i // 10 * 10) for i, *_ in rows]


def test_a_dense_group_of_vectors_is_one_component(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=8) + rng.normal(0, 0.01, (400, 8))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = hnsw.near_duplicates(df, shard_rows=60, block_rows=50).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)}


def test_hnsw_recall():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x = np.concatenate([x, np.repeat(x[:20], 60, 0) + rng.normal(0, 0.02, (1200, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, truth = hnsw.Hnsw(x), x @ x.T >= 0.98
    found = hnsw.range_search(graph, x, 0.98, 48)
    hits = sum(int(truth[k][f].sum()) for k, f in enumerate(found))
    assert hits / truth.sum() > 0.999
    top, _ = graph.search(x[:500], 64)
    near = np.argsort(-(x[:500] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, top[:, :10])]) > 0.9


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, "http://b/3", ""), (4, None, None), (5, "http://b/5", "x" * 70_000), (None, "http://c", "<p>é</p>"), (None, "http://d", "alone"), (5, "http://b/5", "x" * 70_000), (6, "http://e", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"first": F.lit(1), "sha": F.lit("clash")})
    first = {"<p>é</p>": 1, "": 3, "x" * 70_000: 5, "alone": None, rows[-1][2]: 6}
    for compression in ("zstd", "gzip", "none"):
        got = warc.archive_pages(pages, compression=compression).collect()
        want = []
        for i, _, html in rows:
            raw, keep = (html or "").encode(), first[html or ""]
            again = keep is not None and i != keep
            want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", str(keep if again else None)))
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert warc.archive_pages(pages, min_revisit_bytes=1).where("page_id = 4 and record_type = 'response'").count() == 1
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("compression", ["zstd", "gzip", "none"])
def test_headers_hold_any_url(spark, tmp_path, compression):
    urls = ["http://a/\r\n\r\nboo", "http://a/\r\nWARC-Type: revisit", "\nx\r", "  padded  ", "tab\there", "", None, "http://a/%20é\x85\x00"]
    pages = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)], PAGES)
    warc.write_warc(warc.page_records(pages), path := f"file://{tmp_path}/w", compression)
    got = {r.record_id: r for r in warc.read_warc(spark, path).where("record_type <> 'warcinfo'").collect()}
    want = ["http://a/%0D%0A%0D%0Aboo", "http://a/%0D%0AWARC-Type: revisit", "%0Ax%0D", "%20%20padded%20%20", "tab%09here", "", None, "http://a/%20é\x85%00"]
    assert [got[f"urn:page:{k}"].target_uri for k in range(len(urls))] == want
    assert {(r.record_type, bytes(r.payload)) for r in got.values()} == {("response", f"page {k}".encode()) for k in range(len(urls))}
    assert warc.archive_pages(pages, compression=compression).count() == len(urls)


def test_headers_in_any_order_and_folded():
    block = b"HTTP/1.1 200 OK\r\n\r\nab"
    raw = b"WARC/1.1\r\nContent-Length: %d\r\nwarc-type: response\r\nWARC-Target-URI: http://a\r\n  /b\r\nWARC-Type: revisit\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    class File:
        def seek(self, at):
            self.at = at

        def read(self, n):
            return raw[self.at : self.at + n]

    (record,) = warc.records(warc._Window(File(), len(raw)), "none")
    assert record.headers["warc-type"] == "response" and record.headers["warc-target-uri"] == "http://a /b" and record.body() == block
    with pytest.raises(ValueError, match="no length"):
        raw = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"
        list(warc.records(warc._Window(File(), len(raw)), "none"))


@pytest.mark.parametrize("compression", ["zstd", "gzip", "none"])
def test_reading_by_headers_decodes_no_other_payload(spark, tmp_path, compression, monkeypatch):
    rows = [(k, f"http://h{k % 3}/{k}", f"page {k} " * 500) for k in range(30)]
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, PAGES)), path, compression)
    read = warc.read_warc(spark, path)
    assert read.count() == 30 + read.where("record_type = 'warcinfo'").count()
    some = read.where(F.col("target_uri").startswith("http://h1/") & (F.col("record_type") == "response"))
    assert sorted(r.payload.decode() for r in some.collect()) == sorted(h for _, u, h in rows if u.startswith("http://h1/"))
    assert warc.read_warc(spark, path, "headers").where("payload is not null or payload_bytes is not null").count() == 0
    reader, decoded = warc.WarcReader({"path": path}), []
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("position",), 1)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    monkeypatch.setattr(warc.WarcReader, "_decode", lambda *a: decoded.append(a))
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 0 and not decoded


def test_a_wrong_payload_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    records = warc.page_records(spark.createDataFrame([(1, "u", "abc")], PAGES)).withColumn("payload", F.lit("abd").cast("binary"))
    warc.write_warc(records, path, "none")
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, path).collect()


@pytest.mark.parametrize("compression", ["none", "gzip", "zstd"])
def test_a_cut_archive_is_an_error_that_names_it(spark, tmp_path, compression):
    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(k, f"u{k}", "".join(map(chr, rng.integers(40, 120, 150_000)))) for k in range(2)], PAGES)  # several blocks of zstd
    warc.write_warc(warc.page_records(pages.coalesce(1)), f"file://{tmp_path}/w", compression)
    (whole,) = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(warc.ENDINGS[compression])]
    raw = whole.read_bytes()
    starts = [r.position for r in warc.records(warc._Window(io.BytesIO(raw), len(raw)), compression)]
    assert len(starts) == 3
    for cut in [*range(len(raw) - 1, len(raw) - 40, -3), starts[2] + 70_000, *range(starts[2] + 1, starts[2] + 400, 13)]:
        short = raw[:cut]
        with pytest.raises(ValueError, match=f"a.warc: .*record at {starts[2]}"):
            for record in warc.records(warc._Window(io.BytesIO(short), len(short), "a.warc"), compression):
                record.body()
    whole.write_bytes(raw[: starts[2] + 70_000])
    for payload in ("full", "headers"):
        with pytest.raises(Exception, match=whole.name):
            warc.read_warc(spark, f"file://{tmp_path}/w", payload).collect()


def test_page_ids_of_any_type(spark):
    ids = ["a", "b c ", "urn:page:1", "é<>", " ", "", None]
    pages = spark.createDataFrame([(i, "u", "same") for i in ids] + [("zz", "u", "own")], PAGES.replace("page_id long", "page_id string"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(pages.withColumn("first", F.lit("clash"))).collect()}
    assert got == {i: ("response", None) if i in ("", "zz") else ("revisit", "") for i in [*ids, "zz"]}


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    first = {}
    for i in sorted(rows.keys() - toxic):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    left = sorted(first.values())
    from evstream.llm.simhash import simhash

    fp = np.array([simhash(rows[i].encode()) for i in left], np.int64).view(np.uint64)
    forest = UnionFind()
    for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))):
        forest.union(left[a], left[b])
    want = {i for i in left if forest.find(i) == i}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "packing"]


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls, repeated rows, near copies without an id, clashing columns: every stage keeps one of each group, and packing holds it once."""
    words = " ".join(f"word{k}" for k in range(400))
    more = [(None, words, "en", "a", 1), (None, words + " end", "en", "a", 1), (70, words + " stop", "en", "a", 1), (71, words + " stop", "en", "b", 1)]
    docs = odd_documents(spark)
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")  # nothing to learn from: every score is 0.5
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    texts = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    from evstream.llm.simhash import simhash

    left = list(texts.values())
    fp = np.array([simhash((t or "").encode()) for _, t in left], np.int64).view(np.uint64)
    forest = UnionFind()
    for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))):
        forest.union(int(a), int(b))
    want = [left[k][0] for k in range(len(left)) if forest.find(k) == k]
    assert sorted((r.doc_id for r in got if r.piece == 0), key=str) == sorted(want, key=str) and len(want) < len(left)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len({p[:2] for p in places}) == len(places)
    no_documents(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_and_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        columns = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want)), name
