"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item, or the whole item where it
is shorter. Its tokens are shingles of up to three words. An occurrence holds all of its
window's shingles, so one necessary token is enough as prefix: the one that the documents
hold most rarely. A first scan counts the benchmark's shingles in all documents, summed
before anything is shuffled, and a window without a shingle there is dropped. A second scan
joins the words to the prefix tokens alone, keeps places where the window fits between the
ends of the document (length and position), and compares word by word on the spot. Only
occurrences leave it, with one row per document for its number of words.

Tables of shingles and prefixes are broadcast if they have at most ``BROADCAST_ROWS`` rows and
``BROADCAST_BYTES`` of text; else places are found by a shuffle of keys and looked up in the
documents that have any. A frequent shingle leads a window only where all of its shingles
are as frequent, and such places are compared in the scan that finds them.

Null and empty texts have no words, and items without words have no windows. Where ids are
null or repeat, rows are numbered first (``rows.own_rows``), so rows of one doc_id have their
own hits, and rows equal in id and text equal ones. Other columns of the inputs are not looked at, so their names
cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .rows import ROW, own_rows, text_key

# Fixed value: what the contract takes for no word, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SHINGLE = 3


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """Splitting is several times cheaper than matching, which copies the text at each match."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, words) of each item's windows, repeated ones once."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("_all")).where(F.size("_all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_all") - window + 1))
    each = words.select("item_id", "_all", F.explode(starts).alias("_start"))
    return each.select("item_id", F.slice("_all", F.col("_start"), window).alias("words")).distinct()


def _keys(pos: Column, words: str, sizes: list[int]) -> Column:
    """Hashes of the shingles that begin at a word, one of each size; null beyond the last word."""
    parts = [F.get(words, pos + i) for i in range(max(sizes))]
    return F.array(*(F.when(pos + k <= F.size(words), F.xxhash64(*parts[:k])) for k in sizes))


def _small(table: DataFrame, text: str | None = None) -> bool:
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    n, taken = table.agg(F.count("*"), size).first()
    return n <= BROADCAST_ROWS and taken <= BROADCAST_BYTES


def _places(words: DataFrame, sizes: list[int], ends: bool = False) -> DataFrame:
    """One row (.., pos, _key) per shingle; ``ends`` adds one per document, with a null key, where pos is its size."""
    # The words stay a column of the document's row and are not copied to its places.
    last = F.size("_all") if ends else F.greatest(F.size("_all") - 1, F.lit(0))
    each = words.select("*", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    keys = _keys(F.col("pos"), "_all", sizes)
    if len(sizes) == 1:
        return each.withColumn("_key", F.get(keys, 0))
    nothing = F.array(F.lit(None).cast("bigint"))
    return each.withColumn("_key", F.explode(F.when(F.col("pos") < F.size("_all"), keys).otherwise(nothing)))


def occurrences(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Where windows occur, and which items hold them: (item_id, win).

    The first has (row, start, size, win) per occurrence and, with null in ``win``, one row
    per document with its number of words as ``size``. ``row`` is the document's number of
    ``own_rows``; ``start`` counts words from 0; ``win`` is a hash of the window's words.
    Rows are distinct unless documents repeat in id and text.
    """
    docs = docs if ROW in docs.columns else own_rows(docs, doc_id, text)
    texts = item_windows(items, item_id, text, window).withColumn("plain", F.array_join("words", " "))
    texts = stage(texts.withColumn("win", F.xxhash64("plain")), "windows")
    owners = texts.select("item_id", "win")
    wins = texts.select("win", "plain", "words").distinct().withColumn("size", F.size("words"))
    wins = wins.withColumn("width", F.least(F.lit(SHINGLE), F.col("size")))
    placed = wins.withColumn("offset", F.explode(F.expr("sequence(0, size - width)")))
    key = F.xxhash64(F.slice("words", F.col("offset") + 1, F.col("width")))
    placed = stage(placed.select("win", "plain", "size", "width", "offset", key.alias("_key")), "window-tokens")
    # At most SHINGLE rows.
    sizes = sorted(r.width for r in placed.select("width").distinct().collect())

    words = docs.select(F.col(ROW).alias("row"), words_of(F.col(text)).alias("_all"))
    ends = [F.lit(None).cast("int").alias("start"), F.size("_all").alias("size"), F.lit(None).cast("bigint").alias("win")]
    if not sizes:
        return words.select("row", *ends), owners

    tokens = placed.select("_key").distinct()
    found = _places(words, sizes).select("_key")
    if _small(tokens):
        counts = found.join(F.broadcast(tokens), "_key").groupBy("_key").count()
    else:
        counts = found.groupBy("_key").count().join(tokens, "_key", "left_semi")
    # A shingle that no document holds rules its window out, so the least count of the rest may lead.
    ranked = placed.join(counts, "_key", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    leads = ranked.groupBy("win", "plain", "size").agg(F.min(F.struct("count", "_key", "offset")).alias("lead"))
    leads = leads.where("lead.count > 0").select("win", "plain", "size", "lead._key", "lead.offset")
    leads = stage(leads, "window-prefixes")

    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n"))
    if _small(leads, "plain"):
        held = _places(words.withColumn("n", F.size("_all")), sizes, ends=True).join(F.broadcast(leads), "_key", "left")
        inside = F.slice("_all", F.greatest(start, F.lit(0)) + 1, F.col("size"))
        same = F.col("win").isNotNull() & fits & (F.array_join(inside, " ") == F.col("plain"))
        end = F.col("pos") == F.col("n")
        size = F.when(end, F.col("n")).otherwise(F.col("size"))
        return held.where(end | same).select("row", F.when(~end, start).alias("start"), size.alias("size"), "win"), owners

    # Rows of a shuffle must not carry the words of their document: places are found by
    # key alone and then looked up in the documents that have any.
    places = _places(words, sizes).select("row", "pos", "_key").join(leads.select("_key").distinct(), "_key", "left_semi")
    places = places.groupBy("row").agg(F.collect_set(F.struct("pos", "_key")).alias("_at"))
    again = words.join(places, "row").select("row", "_all", F.size("_all").alias("n"), F.explode("_at").alias("at"))
    left = F.greatest(F.col("at.pos") - (window - 1), F.lit(0))
    near = F.slice("_all", left + 1, 2 * window)
    again = again.select("row", "n", "at.pos", "at._key", left.alias("left"), near.alias("near"))
    held = again.join(leads, "_key").where(fits)
    inside = F.slice("near", F.greatest(start - F.col("left"), F.lit(0)) + 1, F.col("size"))
    held = held.where(F.array_join(inside, " ") == F.col("plain")).select("row", start.alias("start"), "size", "win")
    return held.unionByName(words.select("row", *ends)), owners


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 10,
    with_key: bool = False,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence), items (sorted ids as
    strings), contaminated; ``with_key`` adds text_key, which tells rows of one id apart."""
    docs = own_rows(docs.select(doc_id, text), doc_id, text)
    held, owners = occurrences(docs, items, doc_id, item_id, text, window)
    found = stage(held, "occurrences")
    held = found.where("win IS NOT NULL")
    # Overlapping occurrences count their words once.
    longest = held.groupBy("row", "start").agg(F.max("size").alias("size"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = end - F.greatest(F.col("start"), F.least(end, F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = longest.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    by_item = held.select("row", "win").distinct().join(owners, "win").select("row", "item_id").distinct()
    named = by_item.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(ROW).alias("row"),
        *([text_key(F.col(text)).alias("text_key")] if with_key else []),
    )
    # Rows equal in id and text share a row number and have equal sizes.
    lengths = found.where("win IS NULL").groupBy("row").agg(F.max("size").cast("bigint").alias("n_words"))
    joined = sizes.join(lengths, "row").join(hit.join(named, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), items_of.alias("items"), (n_hit > 0).alias("contaminated"), *(["text_key"] if with_key else [])
    )
