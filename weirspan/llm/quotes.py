"""Quotation linking: quoted passages are joined to the messages they come from, and conversations are put in reply order.

A line's quote level is the number of ``>`` at its start. Runs of lines of one level are passages; they are normalised
(case and white space) and hashed, and so are the own words of every message: as a whole, by paragraph and by line. A
passage is linked to the earliest message that says it, in its own conversation if possible, else in the first other
one; if the whole passage is not found, its lines are tried. The link of the lowest level is the message's parent.
Numbers of conversations are no times, so parents across conversations can run in a circle; each circle is opened at
its weakest link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import cut_lineage, stored
from weirspan.llm.sharding import positions

_QUOTE = re.compile(r"\s*((?:>[ \t]?)+)(.*)", re.S)
#: Fixed words: a line with one of these and a colon at its end, right before a quote, introduces it.
_INTRODUCES = re.compile(r"(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)\b.*:\s*$")
#: Shorter lines and paragraphs are too common to stand for a message of another conversation.
LEAST_CHARS = 12

PARSED = "kind string, conv_id long, turn long, role string, body string, n_quotes int, max_level int, passage int, level int, part int, hash long, short int"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(normalised(text).encode("utf-8", "surrogatepass")), "big", signed=True)


def parse(text: str | None) -> tuple[str | None, list[tuple[int, list[str]]]]:
    """The message without quotes, and its passages as (level, lines). A text without quotes is returned as it is."""
    if not text or ">" not in text:
        return text, []
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = _QUOTE.fullmatch(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(m[2])
        else:
            while not last and own and (not own[-1].strip() or _INTRODUCES.search(own[-1])):
                if _INTRODUCES.search(own.pop()):
                    break
            passages.append((level, [m[2]]))
        last = level
    passages = [(level, lines) for level, lines in passages if normalised(" ".join(lines))]
    if last or len(own) < text.count("\n") + 1:
        return "\n".join(own).strip("\n"), passages
    return text, passages


def _short(part: str) -> int:
    return int(len(normalised(part)) < LEAST_CHARS)


def own_hashes(body: str | None) -> dict[int, int]:
    """Hashes under which a message can be quoted; those of short parts, marked 1, in its own conversation only."""
    if not body or not body.strip():
        return {}
    parts = [p for p in [*re.split(r"\n\s*\n", body), *body.split("\n")] if p.strip()]
    return {_hash(p): _short(p) for p in parts} | {_hash(body): 0}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in PARSED.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[k]) for n, k in fields])
    for batch in batches:
        rows = []
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            body, passages = parse(text)
            rows.append(("message", conv, turn, role, body, len(passages), max((p[0] for p in passages), default=0), None, None, None, None, None))
            rows += [("own", conv, turn, None, None, None, None, None, None, None, h, short) for h, short in own_hashes(body).items()]
            for i, (level, lines) in enumerate(passages):
                tried = ["\n".join(lines), *(x for x in lines if normalised(x) and len(lines) > 1)]
                rows += [("quote", conv, turn, None, None, None, None, i, level, k, _hash(x), _short(x) if k else 0) for k, x in enumerate(tried)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def passage_links(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, passage, level, from_conv, from_turn, far, in_part`` of every passage whose message was found.

    ``far`` is 1 if that message is in another conversation, ``in_part`` true if only a line of the passage was found.
    """
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quotes = parsed.where((F.col("kind") == "quote") & known).select("conv_id", "turn", "passage", "level", "part", "hash", "short").distinct()
    own = parsed.where((F.col("kind") == "own") & known)
    own = own.join(quotes.select("hash").distinct(), "hash", "left_semi")
    # Minima are combined before the shuffle, so a passage that a third of all messages share is one row a task.
    here = own.groupBy("hash", "conv_id").agg(F.min("turn").alias("here"), F.min(F.when(F.col("short") == 0, F.col("turn"))).alias("known"))
    # The first and the second conversation of each hash: a quoter in the first one takes the second.
    whole = here.where("known is not null").select("hash", F.struct("conv_id", F.col("known").alias("turn")).alias("at"))
    first = whole.groupBy("hash").agg(F.min("at").alias("first"))
    second = whole.join(first, "hash").where(F.col("at") > F.col("first")).groupBy("hash").agg(F.min("at").alias("second"))
    there = first.join(second, "hash", "left")
    met = quotes.join(here.drop("known"), ["hash", "conv_id"], "left").join(there, "hash", "left")
    inside = F.when(F.col("here") < F.col("turn"), F.struct(F.lit(0).alias("far"), F.col("conv_id").alias("conv"), F.col("here").alias("turn")))
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    outside = F.when((F.col("short") == 0) & other.isNotNull(), F.struct(F.lit(1).alias("far"), other["conv_id"].alias("conv"), other["turn"].alias("turn")))
    found = met.withColumn("source", F.coalesce(inside, outside)).where("source is not null")
    best = found.groupBy("conv_id", "turn", "passage", "level").agg(F.min(F.struct((F.col("part") > 0).alias("in_part"), "source.far", "part", "source")).alias("best"))
    return best.select("conv_id", "turn", "passage", "level", F.col("best.source.conv").alias("from_conv"), F.col("best.source.turn").alias("from_turn"), "best.far", "best.in_part")


def reply_chains(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, from_conv, from_turn, root_conv, root_turn, depth`` of every message that keeps its parent.

    ``parents`` holds one row per message: conv_id, turn, from_conv, from_turn, far, in_part, level. Every round doubles
    the steps taken, so a chain of n replies takes log2(n) rounds. Along the way the weakest link met is carried: the
    one to another conversation, by a part of a passage, of the deepest level, then of the largest conversation and
    turn. A message that meets its own link again as the weakest stands in a circle, and loses that link; the rounds
    start again without it. Circles of n links are found in log2(n) rounds.
    """
    links = cut_lineage(parents.select("conv_id", "turn", "from_conv", "from_turn", F.struct("far", "in_part", "level", "conv_id", "turn").alias("own")))
    while True:
        above = links.select(F.col("conv_id").alias("from_conv"), F.col("turn").alias("from_turn"), F.col("own").alias("met"))
        state = cut_lineage(links.join(above, ["from_conv", "from_turn"], "left").select(
            "conv_id", "turn", F.col("from_conv").alias("root_conv"), F.col("from_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"), "own", "met", F.col("met").isNotNull().alias("moved")
        ))
        closed = state.where("met = own")
        while closed.isEmpty() and not state.where("moved").isEmpty():
            upper = state.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"), F.col("depth").alias("more"), F.col("met").alias("up_met"))
            state = cut_lineage(state.join(upper, ["root_conv", "root_turn"], "left").select(
                "conv_id", "turn", F.coalesce("up_conv", "root_conv").alias("root_conv"), F.coalesce("up_turn", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "own", F.greatest("met", "up_met").alias("met"), F.col("up_conv").isNotNull().alias("moved"),
            ))
            closed = state.where("met = own")
        if closed.isEmpty():
            return links.drop("own").join(state.select("conv_id", "turn", "root_conv", "root_turn", F.col("depth").cast("int").alias("depth")), ["conv_id", "turn"])
        links = cut_lineage(links.join(closed.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message (conv_id, turn, role, text), in reply order and without its quotes.

    ``conversation`` is the conversation of the message at the root of the reply chain, ``position`` the gapless place
    in it: messages follow the root they answer, parents come before replies. ``depth`` is the length of the chain,
    ``parent_conv`` and ``parent_turn`` the message answered, ``n_quotes`` and ``n_linked`` the passages and those found.
    A NULL text stays NULL; a NULL conv_id is a conversation, but its messages are not linked, nor are those with a
    NULL turn. Of messages with one conv_id and turn all are kept, and linked alike; other columns are ignored. Texts
    of any length are read whole; an empty table gives an empty result. Own lines and paragraphs under ``LEAST_CHARS``
    characters are quoted within their conversation only, unless they are a whole message. A message that loses its
    parent because its reply chain ran in a circle is a root; its passages still count as found.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = stored(rows.mapInArrow(_parsed, PARSED))
    links = stored(passage_links(parsed))
    per_message = links.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).cast("int").alias("n_linked"), F.min(F.struct("level", "passage", "from_conv", "from_turn", "far", "in_part")).alias("first")
    )
    told = per_message.select("conv_id", "turn", "n_linked").join(reply_chains(per_message.select("conv_id", "turn", "first.*")), ["conv_id", "turn"], "left")
    body = parsed.where("kind = 'message'").select("conv_id", "turn", "role", F.col("body").alias("text"), "n_quotes", "max_level")
    joined = body.join(told, ["conv_id", "turn"], "left").select(
        F.coalesce("root_conv", "conv_id").alias("conversation"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "conv_id", "turn", "role", "text", F.col("from_conv").alias("parent_conv"), F.col("from_turn").alias("parent_turn"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "max_level",
    )
    # NULL conversations are numbered too; the number only serves as the group's name.
    named = joined.withColumn("__group", F.coalesce(F.concat(F.lit("c"), F.col("conversation").cast("string")), F.lit("")))
    named = named.withColumn("__tie", F.xxhash64("role", "text"))
    placed = positions(named, "__group", ["root_turn", "depth", "conv_id", "turn", "__tie"])
    return placed.select(
        "conversation", F.col("position").cast("long").alias("position"), "conv_id", "turn", "role", "text", "depth", "parent_conv", "parent_turn", "n_quotes", "n_linked", "max_level"
    )
