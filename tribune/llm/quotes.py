"""Chat formatting by quotation linking.

Messages are split into their own text and the passages they quote: runs of lines with the same number of leading '>' signs. A
passage is normalised (lower case, white space as single spaces) and hashed, with each of its paragraphs, lines and sentences, and so are the own text
of each message, each part of it between quotations, and their paragraphs, lines and sentences (so a part that was re-wrapped is found by
paragraph or sentence; a re-wrapped fragment that holds no whole sentence is not); the hash is joined within the conversation to the first message that has it. A message replies to the message it quotes, that of
the lowest quote level, then of the longest passage; without a link to an earlier message it replies to the turn before it.

The replies make a tree. A conversation is put in reply order: every message is followed by the replies to it in order of turns, each with all that
follows from it (depth first). The first reply to a message continues its branch and each further one opens a branch,
so the branches of a conversation make a tree of their own. Its order is that of an Euler tour, ranked by pointer jumping with two numbers a branch
whatever the depth; positions come from a range-partitioned sort. No conversation is ever gathered: a long one is sorted over many tasks.

Defined cases: null text is empty and quotes nothing; rows that share (conv_id, turn) are one node of the tree, each keeps its text, and
they follow each other in order of text; rows with a null conv_id or turn are kept, with null parent_turn and position; a passage said first in the same
or a later turn links nothing; a quoted line that attributes ("... wrote:") is dropped with the quotation; extra
columns are kept unless they bear the names of results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch
from .common import with_fields

_QUOTE = re.compile(r"\s{0,3}((?:>\s?)+)(.*)", re.S)
#: Words that end the line that attributes a quotation, fixed values.
_ATTRIBUTION = re.compile(r"(wrote|écrit|schrieb|escribió)\s*:\s*$")


#: Where a sentence ends: in scripts without spaces none follows.
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_PARAGRAPH = re.compile(r"\n\s*\n")


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, passage) of what is quoted in it."""
    own, passages, _ = _split(text)
    return own, passages


def _split(text: str) -> tuple[str, list[tuple[int, str]], list[str]]:
    """What split_quotes gives, and the parts of the own text between quotations."""
    own: list[str] = []
    breaks = [0]
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        found = _QUOTE.match(line)
        if not found:
            own.append(line)
            last = 0
            continue
        level = found[1].count(">")
        if last == 0 and own and _ATTRIBUTION.search(own[-1]):
            own.pop()
        if last == 0:
            breaks.append(len(own))
        if level != last:
            passages.append((level, []))
        passages[-1][1].append(found[2])
        last = level
    if not passages:
        return text, [], [text]
    parts = ["\n".join(own[a:b]) for a, b in zip(breaks, [*breaks[1:], len(own)], strict=True)]
    return "\n".join(own).strip("\n"), [(n, "\n".join(p)) for n, p in passages], parts


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(text: str) -> list[str]:
    """The text itself, its paragraphs, lines and sentences, normalised."""
    paragraphs = _PARAGRAPH.split(text)
    found = [text, *paragraphs, *text.split("\n"), *(x for p in [text, *paragraphs] for x in _SENTENCE.split(" ".join(p.split())))]
    return [p for p in dict.fromkeys(map(normalised, found)) if p]


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def parse(messages: DataFrame) -> DataFrame:
    """messages with own_text, said (hashes of own text, its parts and their pieces) and quoted (level, length and hash of each passage and its pieces)."""
    schema = with_fields(messages, ("own_text", "string"), ("said", "array<long>"), ("quoted", "array<struct<level:int,size:int,hash:long>>"))
    at, names = messages.columns.index("text"), schema.names
    quoted = pa.list_(pa.struct([("level", pa.int32()), ("size", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns, said, quotes = [], [], []
            for text in batch.column(at).to_pylist():
                own, passages, parts = _split(text or "")
                owns.append(own)
                said.append([_digest(p) for p in {p for x in {own, *parts} for p in pieces(x)}])
                whole = [(level, p) for level, passage in passages for p in pieces(passage)]
                quotes.append([{"level": n, "size": len(p), "hash": _digest(p)} for n, p in dict.fromkeys(whole)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owns, pa.string()), pa.array(said, pa.list_(pa.int64())), pa.array(quotes, quoted)], names=names)

    return messages.mapInArrow(run, schema)


def parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, quotes) of every node: quotes tells whether the parent is the message it quotes."""
    nodes = parsed.where("conv_id is not null and turn is not null")
    first = nodes.select("conv_id", "turn", F.explode("said").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    asked = nodes.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    linked = (
        asked.join(first, ["conv_id", "hash"])
        .where("origin < turn")
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct("level", (-F.col("size")).alias("size"), (-F.col("origin")).alias("origin"))).alias("best"))
        .select("conv_id", "turn", (-F.col("best.origin")).alias("quoted_turn"))
    )
    # the turn before, in two levels: within blocks of 1024 turns, then over the last turns of the blocks
    turns = nodes.select("conv_id", "turn").distinct().withColumn("turns_block", F.floor(F.col("turn") / 1024))
    blocks = turns.groupBy("conv_id", "turns_block").agg(F.max("turn").alias("last"))
    before_block = blocks.selectExpr("conv_id", "turns_block", "lag(last) over (partition by conv_id order by turns_block) as block_before")
    before = (
        turns.selectExpr("conv_id", "turn", "turns_block", "lag(turn) over (partition by conv_id, turns_block order by turn) as turn_before")
        .join(before_block, ["conv_id", "turns_block"])
        .select("conv_id", "turn", F.coalesce("turn_before", "block_before").alias("turn_before"))
    )
    return before.join(linked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("quoted_turn", "turn_before").alias("parent_turn"), F.col("quoted_turn").isNotNull().alias("quotes")
    )


def _jump(nodes: DataFrame, key: str, to: str) -> DataFrame:
    """Follow `to` (null at a root) to its end by doubling: adds the end as `head`. Rounds: the logarithm of the longest chain."""
    now = cut(nodes.select("conv_id", F.col(key).alias("n"), F.coalesce(to, key).alias("head")), "jump")
    while True:
        other = now.select("conv_id", F.col("n").alias("head"), F.col("head").alias("further"))
        then = cut(now.join(other, ["conv_id", "head"]).select("conv_id", "n", F.col("further").alias("head"), (F.col("further") != F.col("head")).alias("moved")), "jump")
        moved = then.where("moved").limit(1).count()
        drop_scratch(now)
        now = then.drop("moved")
        if not moved:
            return now


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `place`: consecutive numbers in the order of the columns given, by a sort over all tasks."""
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    slices = sorted_.groupBy(F.shiftright("place", 33).alias("_slice")).agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    offsets = slices.selectExpr("_slice", "_first", "sum(_n) over (order by _slice) - _n as _skip")  # a row per task
    placed = sorted_.withColumn("_slice", F.shiftright("place", 33)).join(F.broadcast(offsets), "_slice")
    return placed.withColumn("place", F.col("_skip") + F.col("place") - F.col("_first")).drop("_slice", "_skip", "_first")


def _branch_orders(branches: DataFrame) -> DataFrame:
    """(conv_id, head, rank) of branches: conv_id, head, above (head of the branch it leaves, null for the first) and leaves (the turn at which).

    In the tour a branch is entered, then the branches that leave it are toured, later points of leaving first and those of one point in order of turns,
    then it is left. rank counts the entries from a branch's to the end, by doubling; branches of one parent follow one another in a sort
    over all tasks, so that a branch with very many is no work of one task.
    """
    nested = branches.where("above is not null")
    if not nested.limit(1).count():
        return branches.select("conv_id", "head", F.lit(1).cast("long").alias("rank"))
    placed = cut(_numbered(nested.withColumn("later", -F.col("leaves")), "conv_id", "above", "later", "head").drop("later"), "siblings")
    following = placed.select("conv_id", "above", (F.col("place") - 1).alias("place"), F.col("head").alias("sibling"))
    firsts = placed.groupBy("conv_id", F.col("above").alias("head")).agg(F.min_by("head", "place").alias("child"))
    # arcs: entering (down) and leaving (up) a branch; each names the arc after it
    siblings = placed.join(following, ["conv_id", "above", "place"], "left").select("conv_id", "head", "sibling")
    known = branches.join(firsts, ["conv_id", "head"], "left").join(siblings, ["conv_id", "head"], "left")
    arc = lambda head, down: F.struct(F.col(head).alias("head"), F.lit(down).alias("down"))
    after_down = F.when(F.col("child").isNotNull(), arc("child", True)).otherwise(arc("head", False))
    after_up = F.when(F.col("sibling").isNotNull(), arc("sibling", True)).when(F.col("above").isNotNull(), arc("above", False))
    each = F.explode(F.array(F.struct(arc("head", True).alias("arc"), after_down.alias("next"), F.lit(1).cast("long").alias("rank")), F.struct(arc("head", False).alias("arc"), after_up.alias("next"), F.lit(0).cast("long").alias("rank"))))
    now = cut(known.select("conv_id", each.alias("a")).select("conv_id", "a.*"), "tour")
    while now.where("next is not null").limit(1).count():
        ahead = now.select("conv_id", F.col("arc").alias("next"), F.col("next").alias("further"), F.col("rank").alias("more"))
        then = cut(now.join(ahead, ["conv_id", "next"], "left").select("conv_id", "arc", F.col("further").alias("next"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), "tour")
        drop_scratch(now)
        now = then
    return now.where("arc.down").select("conv_id", "arc.head", "rank")


def format_chats(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with text without quotations, parent_turn, quotes and position in reply order from 0."""
    messages = messages.drop("parent_turn", "quotes", "position").withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    # the tree is made of the key columns alone; what else messages hold, whatever its name, only passes through the last join
    hashed = cut(parse(messages.select("conv_id", "turn", "text")).select("conv_id", "turn", "said", "quoted"), "hashes")
    tree = cut(parents(hashed), "tree")
    drop_scratch(hashed)
    # the first reply continues the branch of its parent
    continues = tree.where("parent_turn is not null").groupBy("conv_id", "parent_turn").agg(F.min("turn").alias("turn")).withColumn("continues", F.lit(True))
    marked = tree.join(continues, ["conv_id", "parent_turn", "turn"], "left")
    heads = _jump(marked.withColumn("on", F.when(F.col("continues"), F.col("parent_turn"))), "turn", "on")
    inside = cut(marked.join(heads.withColumnRenamed("n", "turn"), ["conv_id", "turn"]), "branches")
    above = inside.select("conv_id", F.col("turn").alias("leaves"), F.col("head").alias("above"))
    branches = inside.where("turn = head").select("conv_id", "head", F.col("parent_turn").alias("leaves")).join(above, ["conv_id", "leaves"], "left")
    keyed = inside.join(_branch_orders(cut(branches, "heads")), ["conv_id", "head"])
    keyed = cut(keyed.select("conv_id", "turn", "parent_turn", "quotes", (-F.col("rank")).alias("before")), "keyed")
    # position: place in a sort over all tasks, less that of the conversation's first message
    inner = {c: f"_chat_{k}" for k, c in enumerate(messages.columns) if c not in ("conv_id", "turn", "text")}
    own = parse(messages.withColumnsRenamed(inner)).drop("said", "quoted", "text")
    placed = _numbered(own.join(keyed, ["conv_id", "turn"], "left"), "conv_id", "before", "turn", "own_text")
    starts = placed.where("before is not null").groupBy("conv_id").agg(F.min("place").alias("start"))
    done = placed.join(starts, "conv_id", "left").withColumn("position", F.when(F.col("before").isNotNull(), F.col("place") - F.col("start")))
    columns = [F.col("own_text").alias(c) if c == "text" else F.col(inner.get(c, c)).alias(c) for c in messages.columns]
    return done.select(*columns, "parent_turn", F.coalesce("quotes", F.lit(False)).alias("quotes"), "position")
