"""Benchmark decontamination by winnowing.

Words are hashed, neighbouring hashes are combined to hashes of ``GRAM`` words, and in every window of
``WINDOW - GRAM + 1`` of these the smallest is kept. A span of ``WINDOW`` words fills one such window, so text and item
keep the same fingerprint for every span they share: no shared span is missed. Fingerprints of texts and items are
joined; each hit is then extended to the span of words it stands for and verified word by word. Items of fewer than
``WINDOW`` words are compared as whole spans of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import doc_key, lower_ascii, stored

WINDOW = 10
GRAM = 4
#: Fingerprints of the items are broadcast up to this many rows (16 bytes each); beyond it the join is shuffled.
MOST_BROADCAST = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def _combine(values: Column, ahead: int, how) -> Column:
    """``how(v[i], v[i + ahead])`` for every i that has both."""
    left = F.size(values) - ahead
    return F.when(left > 0, F.zip_with(F.slice(values, F.lit(1), left), F.slice(values, F.lit(ahead + 1), left), how)).otherwise(F.array().cast("array<bigint>"))


def with_window_hashes(df: DataFrame, keep_words: bool = True) -> DataFrame:
    """Add ``marks`` to rows with ``words``: for each span of ``WINDOW`` words the smallest hash of its grams."""
    df = df.withColumn("marks", F.transform("words", lambda w: F.xxhash64(w)))
    df = df if keep_words else df.drop("words")
    for ahead in (1, 2):  # grams of two, then of four words
        df = df.withColumn("marks", _combine(F.col("marks"), ahead, lambda a, b: F.xxhash64(a, b)))
    for ahead in (1, 2, 3):  # smallest of two, four, seven grams
        df = df.withColumn("marks", _combine(F.col("marks"), ahead, lambda a, b: F.least(a, b)))
    return df


def _span(at: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(F.col("words"), at + 1, F.lit(size) if isinstance(size, int) else size), " ")


def item_spans(items: DataFrame) -> DataFrame:
    """``group, size, mark, span``: every span of the items, with its length in words and, for full ones, its mark.

    Items with the same words form one group, named by its smallest id as text.
    """
    long = F.size("words") >= WINDOW
    rows = with_window_hashes(items)
    # The outer form: for the plain one the optimizer would push a test of the array below all the steps that make it.
    full = rows.where(long).select("group", F.lit(WINDOW).alias("size"), F.posexplode_outer("marks").alias("at", "mark"), "words").where("mark is not null")
    full = full.select("group", "size", "mark", _span(F.col("at"), WINDOW).alias("span"))
    short = rows.where(~long).select("group", F.size("words").alias("size"), F.lit(None).cast("long").alias("mark"), F.array_join("words", " ").alias("span"))
    return full.unionByName(short).distinct()


def _grouped_items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), words("text").alias("words")).where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.collect_set(F.coalesce("id", F.lit("null"))).alias("ids")).select("words", "ids", F.xxhash64("words").alias("group"))


def contamination(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``k1, k2, doc_id, copies, n_words, n_hit, items`` per document (see ``doc_key``); ``items``: sorted ids as text.

    Repeated rows are one document with ``copies`` > 1. NULL and empty texts have no words and no hits; items without
    words hit nothing; a NULL item id is listed as ``null``. Empty tables give no hits.
    """
    items = stored(_grouped_items(benchmark))
    spans = stored(item_spans(items.select("words", "group")))
    marks = spans.where("mark is not null").select("mark").distinct()
    small = marks.count() <= most_broadcast
    sizes = sorted(r["size"] for r in spans.where("mark is null").select("size").distinct().collect())  # at most WINDOW - 1 numbers

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), words("text").alias("words"))
    marked = with_window_hashes(rows.select("doc_id", "k1", "k2", F.size("words").alias("n_words"), "words"), keep_words=False)
    # Each document also gives one row under its own key; it is kept for the word count whether or not anything hits.
    own = F.xxhash64("k1", "k2")
    each = F.array_append(F.array_distinct("marks"), own)
    sent = marked.select("doc_id", "k1", "k2", "n_words", F.explode(each).alias("mark"))
    sent = sent.withColumn("is_doc", F.col("mark") == F.xxhash64("k1", "k2"))
    wanted = marks.withColumn("hit", F.lit(True))
    met = sent.join(F.broadcast(wanted) if small else wanted, "mark", "left").where("is_doc or hit")
    met = stored(met.select("doc_id", "k1", "k2", "n_words", "mark", "is_doc", F.coalesce("hit", F.lit(False)).alias("hit")))
    every = met.where("is_doc").groupBy("k1", "k2").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))

    # Extend: the spans that stand behind a hit, verified by their words.
    hits = met.where("hit").groupBy("k1", "k2").agg(F.collect_set("mark").alias("found"))
    texts = docs.select(*doc_key(), "text").join(hits.hint("merge"), ["k1", "k2"])
    texts = with_window_hashes(texts.select("k1", "k2", "found", words("text").alias("words")))
    marked_places = F.arrays_zip(F.sequence(F.lit(0), F.size("marks") - 1).alias("at"), F.col("marks").alias("mark"))
    places = texts.select("k1", "k2", "words", F.explode(F.filter(marked_places, lambda x: F.array_contains("found", x["mark"]))).alias("x"))
    candidates = places.select("k1", "k2", F.col("x.at").alias("at"), F.lit(WINDOW).alias("size"), _span(F.col("x.at"), WINDOW).alias("span"))
    for size in sizes:
        # Whole spans of the short lengths that occur among the items; each is looked up by its words.
        some = rows.where(F.size("words") >= size)
        some = some.select("k1", "k2", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
        candidates = candidates.unionByName(some.select("k1", "k2", "at", F.lit(size).alias("size"), _span(F.col("at"), size).alias("span")))
    # One number as the key keeps the broadcast table compact; the words themselves decide.
    code = F.xxhash64("size", "span").alias("code")
    lookup = spans.select(code, F.col("span").alias("item_span"), "group")
    met_spans = candidates.distinct().withColumn("code", code).join(F.broadcast(lookup) if spans.count() <= most_broadcast // 10 else lookup, "code")
    verified = stored(met_spans.where("span = item_span").select("k1", "k2", "at", "size", "group"))

    covered = verified.groupBy("k1", "k2", "at").agg(F.max("size").alias("size")).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("runs"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, x: Column) -> Column:
        end = F.greatest(s["end"], x["at"] + x["size"])
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], x["at"])).alias("n"))

    hit_words = covered.select("k1", "k2", F.aggregate("runs", zero, add, lambda s: s["n"]).alias("n_hit"))
    named = verified.select("k1", "k2", "group").distinct().join(items.select("group", "ids"), "group")
    hit_items = named.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    found = hit_words.join(hit_items.hint("merge"), ["k1", "k2"])
    return every.join(found.hint("merge"), ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", "copies", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = contamination(docs, benchmark, **options)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that share no span with an item; all columns and repeated rows are kept."""
    found = contamination(docs, benchmark, **options).where("n_hit > 0").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    k1, k2 = doc_key()
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(found.hint("merge"), ["__k1", "__k2"], "left_anti").drop("__k1", "__k2")
