"""The registered queries of the subpackage, and their SQL where it can express them."""

from __future__ import annotations

from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_path
from . import alignment, bpe, chat_tree, cross_polytope, decontaminate, jaccard_trie, kneser_ney, license_scan, mixing, suffix_dedup, toxicity, warc, whitening

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary(), decoded="decoded").select(
        "doc_id",
        bpe.token_count().alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op7_decontamination",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
w AS (
  SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS k FROM w),
p AS (
  SELECT doc_id, i, k, list_slice(ws, i, i + k - 1) AS win
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, sizes WHERE len(ws) >= k)
),
occ AS (SELECT p.doc_id, p.i, p.k, w.item_id FROM p JOIN w ON p.win = w.win),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY 1
),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op2_license_scan", license_scan.scan_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["times"].cast("string")))
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(each, ",").alias("licenses"),
        F.sha2(F.col("by_line").cast("binary"), 256).alias("sequence_sha256"),
    )


@query("op6_jaccard_trie")
def op6_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard_trie.jaccard_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "n_shingles", "component_id")


def fold(doc_id: str, of: int = 5):
    return F.crc32(F.col(doc_id).cast("string")) % of


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id") == 0
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, net, out="score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_kneser_ney")
def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = kneser_ney.score(table(spark, sf_dir, "documents"), fold("doc_id") != 1)
    return scored.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query(
    "op5_warc",
    """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages
),
g AS (SELECT payload_digest, max(page_id) AS origin FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id < origin AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < origin AND payload_bytes >= 1000 THEN origin END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN g USING (payload_digest)
""",
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


@query("op9_chat_tree")
def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], chats.schema)
    return chat_tree.digests(chat_tree.read_back(chat_tree.format_chats(chats.union(more))))


@query("op1_cross_polytope")
def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.lattice(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = whitening.fit(rows)
    shares = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    each = whitening.transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(model.centre.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query("op11_mixing")
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "source")


@cache
def two_tokenizers() -> alignment.Tokenizers:
    return alignment.Tokenizers.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), two_tokenizers())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
