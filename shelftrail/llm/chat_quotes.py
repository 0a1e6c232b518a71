"""Chat formatting by quotation linking.

Messages quote what they answer, as lines behind one `>` per level. Each message is parsed into its own lines and its
quoted passages; a passage of level 1 is what the direct parent wrote itself. All passages and their paragraphs and lines
are normalised, hashed and joined to messages and the runs, paragraphs and lines of messages: a quote belongs to the latest
earlier message of its own conversation with those words. Words that its conversation has not said yet may be another's: a
quote of `FAR_WORDS` words or more that one other conversation alone has said, and earlier by (conv_id, turn), belongs to its
first message there; shorter or commoner words link no conversations. Of the matches of a
message the parent is the one of lowest level; then whole passages come before parts of them, the own conversation before
others, whole messages before parts, longer parts before shorter, and later passages before earlier. Following parents by
pointer doubling gives each message its thread and its depth, by which a conversation can be read in reply order, without
quotes.

All steps are equi-joins against one row per key, so a text that thousands of messages share or a conversation with a
third of all rows makes no more rows than there are messages. The latest earlier turn is looked up in chunks of
`CHUNK_TURNS` turns: a key's turns within a chunk are one short array, and each chunk knows the last turn before it.

Defined cases: a null or empty text is an empty message that nobody can quote; a quote that matches nothing leaves its
message a root, as does one whose only passages of level 1 have no words (the parent is an empty message); rows without conv_id or turn are left out; of repeated (conv_id, turn) rows all stay and share a place;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow
from ._common import hash_pair, materialise

#: A power of two: 2 ** CHUNK_BITS turns of one conversation are a chunk.
CHUNK_BITS = 10
CHUNK_TURNS = 1 << CHUNK_BITS
#: A quote may lead to another conversation from so many words on, if it is in one alone.
FAR_WORDS = 8
_MARKS = re.compile(r"^((?:> ?)+)(.*)$", re.S)


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text) in order."""
    own, passages = [], []
    last = 0
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(m[2])
        else:
            passages.append((level, [m[2]]))
        last = level
    return "\n".join(own), [(k, "\n".join(x)) for k, x in passages]


def parts(text: str) -> list[str]:
    """The paragraphs and lines of a text, each once and none equal to the text."""
    found = dict.fromkeys(p.strip() for p in [*re.split(r"\n\s*\n", text), *text.split("\n")])
    return [p for p in found if p and p != text.strip()]


def own_parts(text: str | None) -> list[str]:
    """What can be quoted of a message besides all of it: its own lines between two quotes, and their parts."""
    runs = [[]]
    for line in (text or "").split("\n"):
        if _MARKS.match(line):
            runs.append([])
        else:
            runs[-1].append(line)
    texts = ["\n".join(r).strip() for r in runs]
    found = dict.fromkeys(p for t in texts for p in (t, *parts(t)) if p)
    return list(found)


def quotes(passages: list[tuple[int, str]]) -> list[tuple[int, int, int, str]]:
    """(level, 1 for a part of a passage, place from the end, text) of what may be found; no deeper level behind an empty one."""
    first = [x for k, x in passages if k == 1]
    if first and not any(x.strip() for x in first):
        return []
    out = [(1, 0, 0, "\n".join(first))] if len(first) > 1 else []  # what a message with quotes in it wrote itself
    for i, (k, x) in enumerate(passages):
        out.append((k, 0, len(passages) - i, x))
        out += [(k, 1, len(passages) - i, p) for p in parts(x)]
    return out


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def _key(text: Column) -> Column:
    """Two 64-bit hashes of the normalised words, which are worked out once; null when there are none."""

    def hashed(words: Column) -> Column:
        a, b = hash_pair(words)
        return F.when(words != "", F.struct(a.alias("a"), b.alias("b")))

    return F.get(F.transform(F.array(normalised(text)), hashed), F.lit(0))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), own_parts, quoted (all that `quotes` gives), n_quotes, levels."""
    quote = pa.struct([("level", pa.int32()), ("piece", pa.int32()), ("back", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, 3):
            own, pieces, quoted, count, levels = [], [], [], [], []
            for t in b.column(3).to_pylist():
                text, passages = parse(t)
                own.append(text)
                pieces.append(own_parts(t))
                quoted.append([dict(zip(quote.names, q, strict=True)) for q in quotes(passages)])
                count.append(len(passages))
                levels.append(max((k for k, _ in passages), default=0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(own, pa.string()), pa.array(pieces, pa.list_(pa.string())), pa.array(quoted, pa.list_(quote)), pa.array(count, pa.int32()), pa.array(levels, pa.int32())],
                names=["conv_id", "turn", "role", "text", "own_parts", "quoted", "n_quotes", "levels"],
            )

    some = messages.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return map_arrow(some, run, "conv_id long, turn long, role string, text string, own_parts array<string>, quoted array<struct<level:int,piece:int,back:int,words:string>>, n_quotes int, levels int")


def earlier_turns(origin: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (conv_id, turn, quote_key, ...) with before0 and before1: the latest earlier turn of the conversation with
    that key, of whole messages and of parts, from `origin` (conv_id, turn, partial, quote_key)."""
    key, chunk = ["conv_id", "quote_key"], F.shiftright("turn", CHUNK_BITS).alias("chunk")
    turns = origin.groupBy(*key, chunk).agg(*[F.sort_array(F.collect_set(F.when(F.col("partial") == p, F.col("turn")))).alias(f"turns{p}") for p in (0, 1)])
    sought = asked.select(*key, chunk).distinct().join(turns, [*key, "chunk"], "full_outer")
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sought = sought.withColumns({f"last{p}": F.last(F.array_max(f"turns{p}"), ignorenulls=True).over(earlier) for p in (0, 1)})
    found = asked.withColumn("chunk", F.shiftright("turn", CHUNK_BITS)).join(sought, [*key, "chunk"], "left")

    def before(p: int) -> Column:
        return F.coalesce(F.array_max(F.filter(f"turns{p}", lambda t: t < F.col("turn"))), F.col(f"last{p}"))

    return found.select(*asked.columns, *[before(p).alias(f"before{p}") for p in (0, 1)])


def link_quotes(messages: DataFrame, far_words: int = FAR_WORDS) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_conv, parent_turn, thread_conv, thread_turn, depth, n_quotes, levels, text."""
    parsed = materialise(parsed_messages(messages), "messages")
    whole = parsed.select("conv_id", "turn", F.lit(0).alias("partial"), F.col("text").alias("words"))
    some = parsed.select("conv_id", "turn", F.lit(1).alias("partial"), F.explode("own_parts").alias("words"))
    # keys are written down once: all that follows reads 16 bytes for a text
    origin = materialise(whole.unionByName(some).select("conv_id", "turn", "partial", _key(F.col("words")).alias("quote_key")), "quotable").where("quote_key is not null")
    here = origin.groupBy("conv_id", "quote_key", "partial").agg(F.min("turn").alias("turn"))
    # whole messages before parts, in one row for each key that a single conversation has
    first = here.groupBy("quote_key").agg(
        F.min("conv_id").alias("least"), F.max("conv_id").alias("most"), *[F.min(F.when(F.col("partial") == p, F.struct("conv_id", "turn"))).alias(f"first{p}") for p in (0, 1)]
    )
    first = first.where("least = most").drop("least", "most")
    asked = parsed.select("conv_id", "turn", F.explode("quoted").alias("q")).select(
        "conv_id", "turn", "q.level", "q.piece", "q.back", F.length("q.words").alias("size"), _key(F.col("q.words")).alias("quote_key"),
        (F.size(F.split(normalised(F.col("q.words")), " ")) >= far_words).alias("telling"),
    )
    # a message's place; repeated rows share it
    asked = materialise(asked, "quoted").where("quote_key is not null").distinct()
    linked = earlier_turns(origin, asked).join(first, "quote_key", "left")
    place = F.struct("conv_id", "turn")

    def found(far: int, partial: int) -> Column:
        at = F.col(f"first{partial}") if far else F.struct("conv_id", F.col(f"before{partial}").alias("turn"))
        other = F.col("telling") & (F.col(f"first{partial}") < place) & (F.col(f"first{partial}.conv_id") != F.col("conv_id"))
        earlier = other if far else F.col(f"before{partial}").isNotNull()
        length = F.when(F.col("piece") == 1, -F.col("size")).otherwise(0)
        rank = F.struct("level", "piece", F.lit(far).alias("far"), F.lit(partial).alias("partial"), length.alias("length"), "back", at.alias("at"))
        return F.when(earlier, rank)

    best = F.coalesce(*[found(far, partial) for far in (0, 1) for partial in (0, 1)])
    links = linked.select("conv_id", "turn", best.alias("best")).groupBy("conv_id", "turn").agg(F.min("best").alias("best"))
    links = materialise(links.where("best is not null").select("conv_id", "turn", F.col("best.at").alias("parent")), "reply_links")

    # pointer doubling: `up` is an ancestor `depth` steps away. A message is settled when `up` is a root or settled itself
    # at its root, and takes no further part; parents come earlier, so this ends after log2 of the longest thread.
    moving = links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    settled = moving.limit(0)
    while True:
        known = moving.withColumn("at_root", F.lit(False)).unionByName(settled.withColumn("at_root", F.lit(True)))
        above = known.select(F.struct("conv_id", "turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), "at_root")
        ahead = moving.join(above, "up", "left")
        ahead = ahead.select(
            "conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("at_root", F.lit(True)).alias("done")
        )
        ahead = materialise(ahead, "replies")
        settled = settled.unionByName(ahead.where("done").drop("done"))
        moving = ahead.where("not done").drop("done")
        if moving.isEmpty():
            break
    jump = settled
    out = parsed.drop("own_parts", "quoted").join(links.join(jump.select("conv_id", "turn", "up", "depth"), ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("up.conv_id", "conv_id").alias("thread_conv"), F.coalesce("up.turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", "levels", "text",
    )


def with_quotes(messages: DataFrame) -> DataFrame:
    """Messages as mail programs send them: each behind a quote of the turn before, and in it of the turn before that."""
    some = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    by_turn = some.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def back(k: int) -> DataFrame:
        return by_turn.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"said{k}"))

    def quote(c: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(F.col(c), "\n", "\n" + mark))

    out = some.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.concat_ws("\n", F.when(F.col("said1").isNotNull(), quote("said2", "> > ")), quote("said1", "> "), "text").alias("text"))
