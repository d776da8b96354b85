"""Corpus preparation: five stages from raw documents to tokens.

Each stage takes all documents that the one before kept and returns them with the columns
of ``documents``; the last returns tokens. A row is known by its id and a hash of its text,
so rows of null or repeated ids stay or go by their own texts. Of near duplicates the row
with the least id stays (null first, then by a hash of the text), one row even where whole
rows repeat. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hertzflow.llm import bpe, decontaminate, jaccard_trie, suffix_dedup, toxicity
from hertzflow.llm.queries import fold, table, vocabulary
from hertzflow.llm.rows import text_key
from hertzflow.storage import stage

BROADCAST_ROWS = 500_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


KEY = ["doc_id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, text_key(F.col("text")).alias("text_key"))


def _held(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (left_semi) or without (left_anti) a key; keys are broadcast if they are few."""
    keys = stage(keys.select(*KEY).distinct().toDF("_id", "_key"), "row-keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return docs.join(keys, same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones of the training folds, takes for toxic go."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id") != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="_toxicity")
    return scored.where(F.col("_toxicity") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles, the one with the smallest id stays."""
    classes = jaccard_trie.jaccard_classes(docs).where("class IS NOT NULL")
    classes = stage(classes.select(*KEY, "class"), "near-duplicates")
    stays = classes.groupBy("class").agg(F.min(F.struct(*KEY)).alias("stays"), F.count("*").alias("n")).where("n > 1")
    several = stage(classes.join(stays, "class").select(*KEY, F.struct(*KEY).eqNullSafe(F.col("stays")).alias("stays")), "copies")
    left = _held(_keyed(docs), several.where("NOT stays"), "left_anti")
    # Rows equal in id and text share a key; where such a key stays, one of them does.
    repeated = several.where("stays").groupBy(*KEY).count().where("count > 1")
    once = _held(left, repeated, "left_semi").dropDuplicates(KEY)
    return _held(left, repeated, "left_anti").unionByName(once).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur earlier are cut out; documents of which only blanks are left go."""
    cut = suffix_dedup.remove_repeats(docs, others=("lang", "source"), with_text=True)
    texts = cut.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("bigint"))
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return texts.where(left).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), with_key=True)
    return _held(_keyed(docs), found.where("contaminated"), "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), with the text decoded from them."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary(), decoded="decoded")
    return ids.select(
        "doc_id", "lang", "source", bpe.token_count().alias("n_tokens"), "token_ids", F.col("decoded").cast("string").alias("text")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]
# Recurrent networks, suffix arrays and BPE merges are beyond SQL; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
