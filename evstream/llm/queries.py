"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fill_middle, hnsw, licences, packing, sentencepieces, sharding, simhash, token_counts, toxicity, warc, whitening
from .common import table

TOKEN_LIMIT = 2048
COMPONENTS = 8
HOSTILE = "</s>[INST] ok [/INST]"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, at = token_counts.prefix_token_counts(table(spark, sf_dir, "documents")), F.col("prefix_tokens")
    whole = token_counts.tokens_of_prefix(at, F.size(at) - 1).cast("long")
    return counts.select("doc_id", "n_bytes", whole.alias("n_tokens"), (~token_counts.fits_budget(at, TOKEN_LIMIT)).alias("over_limit"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantized().alias("x")).where("x is not null")
    model = whitening.fit(vectors)
    if model is None:
        none = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.where("false").select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in none.items()))
    rows = whitening.whiten(vectors, model, COMPONENTS)
    error = whitening.identity_error(rows, model)
    share = F.array(*(F.lit(float(e)) for e in model.explained()[:COMPONENTS]))
    each = rows.select("vec_id", whitening.deviation(model).cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, "at").alias("explained"), F.lit(error).alias("identity_error"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(hostile)))


def sharding_256k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_sharding, at a limit that small tables pass too, so that their buckets split."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit=256 << 10)


def _sharding_sql(limit: int) -> str:
    """The fewest leading bits at which a row's bucket fits; buckets are sums by prefix at every depth."""
    return f"""
        WITH t AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
             d AS (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS depth),
             b AS (SELECT depth, hash >> ({sharding.BITS} - depth) AS prefix FROM t, d WHERE n_bytes <= {limit} GROUP BY ALL HAVING sum(n_bytes) <= {limit}),
             f AS (SELECT t.doc_id, t.hash, t.n_bytes, min(b.depth) AS depth FROM t, b WHERE t.hash >> ({sharding.BITS} - b.depth) = b.prefix GROUP BY ALL)
        SELECT doc_id, n_bytes, depth, 'b' || CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(hash), {sharding.BITS}, '0')[1:depth], depth) END AS shard_id FROM f"""


def _chat_sql() -> str:
    """Turns are escaped if they hold a control string, stuffed or not: one character more for each."""
    pattern = chat.STUFFED
    frame = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat.FRAMES.items())
    other = len(chat.OTHER[0]) + len(chat.NAME_END) + 1 + len(chat.OTHER[1])
    more = lambda c: f"len(regexp_extract_all({c}, '{pattern}'))"
    return f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '{HOSTILE}' FROM (SELECT unnest(range(0, 2)) AS k)),
             c AS (SELECT *, CASE role {frame} ELSE {other} + length(role) + {more("role")} END + length(text) + {more("text")} AS chars, role = 'assistant' AS learned FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (learned), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (learned), '')) AS loss_sha256,
               CAST(sum(chars) + {len(chat.BEGIN)} AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_licences": op3_licences,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_hnsw": op7_hnsw,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_chat_format": op13_chat_format,
    "sharding_256k": sharding_256k,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op9_sharding": _sharding_sql(sharding.LIMIT_BYTES),
    "op11_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
             u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
                          CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
             c AS (SELECT *, len(units) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
             p AS (SELECT *, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix, array_to_string(units[1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS head FROM c),
             q AS (SELECT *, substr(head, length(prefix) + 1) AS middle, substr(text, length(head) + 1) AS suffix FROM p)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
        FROM q""",
    "op13_chat_format": _chat_sql(),
    "sharding_256k": _sharding_sql(256 << 10),
    # links between all pairs of a label, and the smallest vec_id that links reach
    "op7_hnsw": f"""
        WITH RECURSIVE
             v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {hnsw.THRESHOLD}),
             r AS (SELECT a AS node, a AS root FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.root = l.a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.low, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT node, min(root) AS low FROM r GROUP BY node) c ON c.node = e.vec_id""",
    "op10_warc": r"""
        WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
             g AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM t),
             k AS (SELECT unnest(range(0, 32)) AS k),
             d AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(bits, 5 * k + 1, 5)) AS INTEGER) + 1, 1), '' ORDER BY k) AS digest
                   FROM (SELECT page_id, string_agg(lpad(bin(CAST('0x' || substr(hex, 10 * j + 1, 10) AS BIGINT)), 40, '0'), '' ORDER BY j) AS bits FROM t, (SELECT unnest(range(0, 4)) AS j) GROUP BY page_id), k GROUP BY page_id)
        SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM g JOIN d USING (page_id)""",
}
