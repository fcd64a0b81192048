"""Personal data: exact patterns, and terms that disclose them by co-occurrence in the corpus.

Patterns give the protected entities. A term is judged by how much of an entity's information it gives away: with P
over documents, the disclosure of entity e by term t is PMI(t; e) / IC(e) = log(P(e | t) / P(e)) / -log P(e), which
is 1 when the term never occurs without the entity and 0 when it tells nothing. Terms are the words near an entity
whose co-occurrence is backed by several different texts. Above ``REMOVE`` a term is removed, above ``GENERALISE`` it
is replaced by its initial, wherever it occurs in a document that holds the entity. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirspan.llm.common import doc_key, stored

#: Words to either side of an entity that count as near it.
NEAR_WORDS = 5
#: Different texts in which a term must be near an entity before it is judged.
LEAST_TEXTS = 3
REMOVE = 0.9
GENERALISE = 0.75
LEAST_LETTERS = 3
#: Candidate terms are broadcast up to this many rows; beyond it all words are counted and joined.
MOST_BROADCAST = 100_000

#: The four patterns in their fixed order. Possessive repeats and the guards in front change no match; they keep the
#: search linear on long runs and free of recursion.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for the search to be worth while.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM_KINDS = ("remove", "generalise")


def _found(text: Column, pattern: str, kind: Column) -> Column:
    """Array of (kind, i, gap, value): the i-th match and the number of characters between it and the one before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value"))
    return F.transform(zipped, lambda x, i: F.struct(kind.alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["value"].alias("value")))


def _placed(rows: DataFrame) -> DataFrame:
    """Start and end of each match of ``rows`` (k1, k2, kind, i, gap, value); a repeated row of a document counts once."""
    rows = rows.dropDuplicates(["k1", "k2", "kind", "i"])
    upto = F.sum(F.col("gap") + F.length("value")).over(W.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", upto).withColumn("start", F.col("end") - F.length("value"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``k1, k2, kind, start, end, value`` of the patterns; ``kind`` is a number into ``KINDS``, places are code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,value:string>>")
    each = [F.when(text.rlike(HINTS[k]), _found(text, PATTERNS[k], F.lit(n))).otherwise(none) for n, k in enumerate(KINDS)]
    rows = docs.select(*doc_key(), F.explode(F.concat(*each)).alias("x")).select("k1", "k2", "x.*")
    digits = F.regexp_replace("value", "[^0-9]", "")
    size = F.length(digits)
    valid = (
        F.when(F.col("kind") == 1, F.col("value").rlike(IP_PARTS))
        .when(F.col("kind") == 2, size.between(14, 19) & F.call_function("luhn_check", digits))
        .when(F.col("kind") == 3, size.between(10, 15))
        .otherwise(True)
    )
    return _placed(rows).where(valid).select("k1", "k2", "kind", "start", "end", "value")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\p{{L}}{{{LEAST_LETTERS},}}+"), F.lit(0))


def _disclosure(with_both: Column, with_term: Column, with_entity: Column, total: Column) -> Column:
    """PMI of term and entity as a share of the entity's information, from counts of documents."""
    p_entity = with_entity / total
    return F.log(F.least(with_both / with_term, F.lit(1.0)) / p_entity) / -F.log(p_entity)


def disclosing_terms(docs: DataFrame, words: DataFrame, near: DataFrame, spans: DataFrame) -> DataFrame:
    """``entity, term, action``: the terms whose disclosure of an entity exceeds a threshold.

    ``near`` has (k1, k2, text_hash, term, entity) for words near entities, ``words`` all words of those documents.
    Counts are of documents, over all of them. Terms too common to qualify by the documents of ``words`` alone are
    left out before the corpus is counted; more documents could only lower their disclosure.
    """
    total = F.lit(docs.count())
    held = spans.groupBy("entity").agg(F.countDistinct("k1", "k2").alias("with_entity"))
    seen = words.groupBy("term").agg(F.countDistinct("k1", "k2").alias("seen"))
    together = near.groupBy("term", "entity").agg(F.countDistinct("k1", "k2").alias("both"), F.countDistinct("text_hash").alias("texts"))
    together = together.where(F.col("texts") >= LEAST_TEXTS).join(held, "entity").where(F.col("with_entity") < total).join(seen, "term")
    at_most = _disclosure(F.col("both"), F.col("seen"), F.col("with_entity"), total)
    candidates = stored(together.where(at_most >= GENERALISE).select("term", "entity", "both", "with_entity"))
    wanted = candidates.select("term").distinct()
    each = docs.select(F.explode(F.array_distinct(_terms(F.lower(F.coalesce("text", F.lit("")))))).alias("term"))
    if wanted.count() <= MOST_BROADCAST:
        counts = each.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    else:
        counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("with_term")).join(wanted, "term")
    share = _disclosure(F.col("both"), F.col("with_term"), F.col("with_entity"), total)
    action = F.when(share >= REMOVE, F.lit(0)).when(share >= GENERALISE, F.lit(1))
    return candidates.join(counts, "term").select("entity", "term", action.alias("action")).where("action is not null")


def find_spans(docs: DataFrame) -> DataFrame:
    """``k1, k2, kind, start, end, value`` of all spans: kinds 0 to 3 as in ``KINDS``, then 4 and 5 as in ``TERM_KINDS``.

    Term spans never overlap those of the patterns. A document is one id with one text (see ``doc_key``).
    """
    base = stored(base_spans(docs))
    spans = base.withColumn("entity", F.concat_ws(":", "kind", F.lower("value")))
    # Entities in fewer different documents than LEAST_TEXTS cannot be judged, so texts with no other are not opened.
    shared = spans.groupBy("entity").agg(F.countDistinct("k1", "k2").alias("n")).where(F.col("n") >= LEAST_TEXTS).select("entity")
    watched = stored(spans.join(shared, "entity").select("k1", "k2", "entity", "start", "end"))
    open_docs = docs.select(*doc_key(), "text", F.xxhash64("text").alias("text_hash")).join(watched.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    found = open_docs.select("k1", "k2", "text_hash", F.explode(_found(F.col("text"), rf"\p{{L}}{{{LEAST_LETTERS},}}+", F.lit(-1))).alias("x")).select("k1", "k2", "text_hash", "x.*")
    words = _placed(found).select("k1", "k2", "text_hash", "start", "end", F.col("value"), F.lower("value").alias("term"), F.lit(None).cast("string").alias("entity"))
    # Patterns and words of a document in one order: a word inside a pattern is left out, a near one meets the entity.
    marks = base.select("k1", "k2", "start", "end").withColumn("mark", F.lit(True))
    merged = words.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy("k1", "k2").orderBy("start", F.desc("mark"), "end")
    covered = F.max(F.when(F.col("mark"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    words = stored(merged.withColumn("covered", covered).where(~F.col("mark") & (F.coalesce("covered", F.lit(0)) <= F.col("start"))).drop("covered", "mark"))
    both = words.unionByName(watched, allowMissingColumns=True)
    window = W.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(-NEAR_WORDS, NEAR_WORDS)
    near = both.withColumn("entities", F.collect_set("entity").over(window)).where("term is not null")
    near = near.select("k1", "k2", "text_hash", "term", F.explode("entities").alias("entity"))
    flagged = disclosing_terms(docs, words, near, spans)
    inside = words.select("k1", "k2", "term", "start", "end", "value").join(flagged, "term").join(watched.select("k1", "k2", "entity").distinct(), ["k1", "k2", "entity"], "left_semi")
    terms = inside.groupBy("k1", "k2", "start", "end", "value").agg((F.min("action") + len(KINDS)).alias("kind"))
    return base.unionByName(terms)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    NULL and empty texts have no spans. Repeated rows each get their result; other columns are ignored.
    """
    names = F.array(*[F.lit(k) for k in KINDS + TERM_KINDS])
    text_of = F.concat_ws(":", F.get(names, F.col("kind")), "start", "end")
    spans = find_spans(docs).select("k1", "k2", "kind", F.struct("start", "kind", "end", text_of.alias("s")).alias("x"))
    counts = [F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    per_doc = spans.groupBy("k1", "k2").agg(*counts, F.array_sort(F.collect_list("x")).alias("all"))
    base = F.filter("all", lambda x: x["kind"] < len(KINDS))
    per_doc = per_doc.select("k1", "k2", *[f"n_{k}" for k in KINDS], F.array_join(base["s"], ",").alias("base"), F.array_join(F.col("all")["s"], ",").alias("spans"))
    rows = docs.select("doc_id", *doc_key()).join(per_doc, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with patterns replaced by labels, removed terms by nothing and generalised ones by their initial.

    Of overlapping spans the first is replaced and the others are dropped. All columns and repeated rows are kept.
    """
    replacement = F.get(F.array(*[F.lit(LABELS[k]) for k in KINDS], F.lit(""), F.concat(F.substring("value", 1, 1), F.lit("."))), F.col("kind"))
    spans = find_spans(docs).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", F.col("end").cast("int").alias("end"), replacement.alias("put")))).alias("__spans")
    )
    text = F.col("text")

    def put(state: Column, x: Column) -> Column:
        start = x["start"].cast("int")
        return F.when(start >= state["at"], F.struct(x["end"].alias("at"), F.concat(state["out"], F.substring(text, state["at"] + 1, start - state["at"]), x["put"]).alias("out"))).otherwise(
            F.struct(F.greatest(state["at"], x["end"]).alias("at"), state["out"].alias("out"))
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("__spans", zero, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    k1, k2 = doc_key()
    rows = docs.withColumns({"__k1": k1, "__k2": k2}).join(spans, ["__k1", "__k2"], "left")
    return rows.select(*[F.when(F.col("__spans").isNull(), text).otherwise(made).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
