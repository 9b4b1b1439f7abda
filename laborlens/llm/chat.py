"""Chat formatting by quotation linking.

A message's lines carry quote levels (the number of leading ``>`` signs).  Lines of
one level in a row are a passage.  Passages are normalised (lower case, white space
runs as one blank) and hashed; a quoted passage links to the latest earlier message of the
conversation whose own text, one of its paragraphs or one of its lines has that hash.  A message
replies to the message that its outermost linked quote comes from.  Conversations are returned in
reply order, each message under the one it answers, with its own text alone: quotes,
and the line that announces one, are left out.

The turns of a conversation are numbered without gaps first.  Links are found by an as-of join in two steps
(numbers in ranges of ``RANGE``), so that a passage
that a whole conversation repeats is split over tasks and never paired with itself.  The reply
order is a position: the tour that enters a message, then its replies, and leaves it, is ranked by
pointer doubling over rows of fixed size.  A conversation is rows in order, never one value, so
it may be of any length, and its reply chains may too.

Defined cases: a null or empty text is an empty body; rows without conversation or turn
are returned without links; a passage of nothing but white space links to nothing; of several
equally good sources the latest turn counts; repeated rows are each returned, with equal
results; if rows of one turn disagree, the turn's place follows the earliest parent; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from laborlens.llm.common import materialise
from laborlens.operators.quantiles import running_sums

RANGE = 256
MARK = re.compile(r"[ \t]*((?:>[ \t]?)*)(.*)", re.S)
ANNOUNCES = re.compile(r".{0,200}\b(wrote|schrieb|a écrit|escribió) ?:\s*", re.S)
PARSED = ("conv_id long, turn long, role string, body string, n_quotes int, uid long, "
          "own array<long>, quotes array<struct<level:int,seq:int,part:int,key:long>>")


def passages(text: str | None) -> list:
    """[level, lines] of each run of lines with one quote level."""
    out: list = []
    for line in (text or "").split("\n"):
        marks, rest = MARK.fullmatch(line.rstrip("\r")).groups()
        level = marks.count(">")
        if not rest.strip() and not level and out and out[-1][0]:
            out.append([0, [rest]])                    # a blank line ends a quote
        elif out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append([level, [rest]])
    return out


def key_of(text: str) -> int | None:
    """Signed 64-bit hash of a normalised passage; None if it is blank."""
    from xxhash import xxh64_intdigest
    flat = " ".join(text.lower().split())
    if not flat:
        return None
    h = xxh64_intdigest(flat.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def parts_of(lines: list) -> list:
    """(part, key) of a passage: whole (0), its paragraphs (1), its lines (2)."""
    whole = "\n".join(lines)
    found = [(0, key_of(whole))]
    found += [(1, key_of(p)) for p in re.split(r"\n[ \t]*\n", whole)]
    found += [(2, key_of(line)) for line in lines]
    best: dict = {}
    for part, key in found:
        if key is not None:
            best.setdefault(key, part)
    return [(part, key) for key, part in best.items()]


def parse(text: str | None) -> tuple:
    """(own text, number of quoted passages, own keys, quote keys) of a message."""
    runs = passages(text)
    own: list = []
    quotes: list = []
    for k, (level, lines) in enumerate(runs):
        if level:
            quotes += [{"level": level, "seq": k, "part": p, "key": h} for p, h in parts_of(lines)]
            continue
        if k + 1 < len(runs) and runs[k + 1][0] and lines and ANNOUNCES.fullmatch(lines[-1]):
            lines = lines[:-1]
        own.append("\n".join(lines))
    body = "\n".join(own).strip()
    keys = sorted({h for block in [body, *own] for _, h in parts_of(block.strip().split("\n"))})
    return body, sum(1 for level, _ in runs if level), keys, quotes


def parsed(messages: DataFrame) -> DataFrame:
    """The messages' parts; ``uid`` numbers the rows, so it holds once the result is written."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        uid = TaskContext.get().partitionId() << 33
        for pdf in batches:
            pdf["uid"] = range(uid, uid + len(pdf))
            uid += len(pdf)
            rows = [parse(t if isinstance(t, str) else None) for t in pdf["text"]]
            for k, name in enumerate(("body", "n_quotes", "own", "quotes")):
                pdf[name] = pd.Series([r[k] for r in rows], index=pdf.index, dtype=object)
            yield pdf.drop(columns="text")[[f.split()[0] for f in _names]]

    _names = ["conv_id", "turn", "role", "body", "n_quotes", "uid", "own", "quotes"]
    src = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                          F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Nullable integers stay integers in pandas only as objects; ids travel as text.
    kept = ["conv_id", "turn"]
    out = src.select(*[F.col(c).cast("string").alias(c) if c in kept else F.col(c) for c in src.columns]) \
        .mapInPandas(read, PARSED.replace("conv_id long, turn long", "conv_id string, turn string"))
    return out.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))


def numbered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, no): the turns of each conversation in order, without gaps, from 0.

    Turns may be far apart (times, say); ranges of ``RANGE`` numbers hold as many turns."""
    turns = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    rows = (turns.join(first, "conv_id").withColumn("_far", F.col("turn") - F.col("_first"))
            .select("conv_id", "turn", "_far", F.lit(1).cast("long").alias("one")))
    return running_sums(rows, ["conv_id"], "_far", ["one"]).select("conv_id", "turn", (F.col("cum_one") - 1).alias("no"))


def linked(messages: DataFrame) -> DataFrame:
    """(uid, seq, level, source): the latest earlier turn that each quoted passage comes from.

    ``messages``: the parsed rows.  Of a passage's parts the largest that is found counts.
    """
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = (known.select("conv_id", "turn", "uid", F.inline("quotes")).distinct()
              .select("conv_id", "turn", "uid", "level", "seq", "part", "key"))
    wanted = quoted.select("conv_id", "key").distinct()
    own = (known.select("conv_id", "turn", F.explode("own").alias("key")).distinct()
           .join(wanted, ["conv_id", "key"], "left_semi"))
    span = F.floor(F.col("turn") / RANGE)
    lasts = own.groupBy("conv_id", "key", span.alias("span")).agg(F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id", "key").orderBy("span").rowsBetween(
        Window.unboundedPreceding, -1)                            # one row per range of turns
    spans = (lasts.select("conv_id", "key", "span", "last")
             .union(quoted.select("conv_id", "key", span.alias("span"), F.lit(None).cast("long")).distinct())
             .groupBy("conv_id", "key", "span").agg(F.max("last").alias("last"))
             .withColumn("before", F.max("last").over(earlier)).select("conv_id", "key", "span", "before"))
    both = (own.select("conv_id", "key", "turn", F.col("turn").alias("own_turn"),
                       *[F.lit(None).cast(t).alias(n) for n, t in (
                           ("uid", "long"), ("level", "int"), ("seq", "int"), ("part", "int"))])
            .union(quoted.select("conv_id", "key", "turn", F.lit(None).cast("long"), "uid", "level", "seq", "part"))
            .withColumn("span", span))
    inside = Window.partitionBy("conv_id", "key", "span").orderBy("turn").rangeBetween(
        Window.unboundedPreceding, -1)                            # RANGE turns
    return (both.withColumn("near", F.max("own_turn").over(inside)).where(F.col("uid").isNotNull())
            .join(spans, ["conv_id", "key", "span"])
            .withColumn("source", F.coalesce("near", "before")).where(F.col("source").isNotNull())
            .groupBy("uid", "seq", "level")
            .agg(F.max_by("source", F.struct(-F.col("part"), F.col("source"))).alias("source")))


def tour(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, out, back, back_out): each message is entered and left (``out``), and the event
    before that in its conversation's tour; the first event has none.

    ``replies``: (conv_id, turn, parent), one row per turn, parent an earlier turn of it or null.
    """
    nodes = replies.select("conv_id", "turn", "parent", F.floor(F.col("turn") / RANGE).alias("span"))
    earlier = Window.partitionBy("conv_id", "parent").orderBy("span")             # one row per range of turns
    lasts = (nodes.groupBy("conv_id", "parent", "span").agg(F.max("turn").alias("last"))
             .select(F.col("conv_id").alias("c"), F.col("parent").alias("p"), F.col("span").alias("s"),
                     F.lag("last").over(earlier).alias("far")))
    inside = Window.partitionBy("conv_id", "parent", "span").orderBy("turn")      # RANGE turns
    enter = (nodes.withColumn("near", F.lag("turn").over(inside))
             .join(lasts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("parent").eqNullSafe(F.col("p"))
                   & F.col("span").eqNullSafe(F.col("s")))
             .withColumn("sibling", F.coalesce("near", "far"))
             .select("conv_id", "turn", F.lit(False).alias("out"), F.coalesce("sibling", "parent").alias("back"),
                     F.col("sibling").isNotNull().alias("back_out")))
    child = (nodes.where(F.col("parent").isNotNull())
             .groupBy("conv_id", F.col("parent").alias("turn")).agg(F.max("turn").alias("child")))
    leave = (nodes.select("conv_id", "turn").join(child, ["conv_id", "turn"], "left")
             .select("conv_id", "turn", F.lit(True).alias("out"), F.coalesce("child", "turn").alias("back"),
                     F.col("child").isNotNull().alias("back_out")))
    return enter.union(leave)


def places(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth, position) of each turn, by list ranking of the tour.

    A row holds what lies between its event and ``back``, exclusive: entered messages, entered less
    left ones, the last thread begun.  Each round doubles the distance.
    """
    tops = replies.select("conv_id", "turn", F.col("parent").isNull().alias("top"))
    now = materialise(tour(replies).join(tops, ["conv_id", "turn"]).select(
        "conv_id", "turn", "out", "back", "back_out", F.when(F.col("out"), 0).otherwise(1).cast("long").alias("entered"),
        F.when(F.col("out"), -1).otherwise(1).cast("long").alias("inside"),
        F.when(F.col("top") & ~F.col("out"), F.col("turn")).alias("root")), "tour")
    columns = now.columns
    while not now.where(F.col("back").isNotNull()).isEmpty():
        before = now.select("conv_id", F.col("turn").alias("back"), F.col("out").alias("back_out"),
                            *[F.col(c).alias(f"{c}_") for c in columns[3:]])
        further = (now.where(F.col("back").isNotNull()).join(before, ["conv_id", "back", "back_out"])
                   .select("conv_id", "turn", "out", F.col("back_").alias("back"), F.col("back_out_").alias("back_out"),
                           (F.col("entered") + F.col("entered_")).alias("entered"),
                           (F.col("inside") + F.col("inside_")).alias("inside"),
                           F.coalesce("root", "root_").alias("root")))
        now = materialise(now.where(F.col("back").isNull()).union(further), "tour")
    return now.where(~F.col("out")).select("conv_id", "turn", F.col("root").alias("root_turn"),
                                           (F.col("inside") - 1).alias("depth"),
                                           (F.col("entered") - 1).alias("position"))


def threads(messages: DataFrame) -> DataFrame:
    """Messages in reply order: (conv_id, turn, role, body, n_quotes, n_linked, parent_turn, root_turn, depth,
    position, formatted).  Sorting by (conv_id, position) gives the order; the result is sorted so."""
    rows = materialise(parsed(messages), "messages")
    numbers = materialise(numbered(rows), "numbers")
    dense = rows.join(numbers, ["conv_id", "turn"], "left")
    placed_rows = dense.where(F.col("no").isNotNull()).drop("turn").withColumnRenamed("no", "turn")
    links = materialise(linked(placed_rows), "links")
    parent = links.groupBy("uid").agg(
        F.min_by("source", F.struct("level", "seq")).alias("parent"), F.count(F.lit(1)).alias("n_linked"))
    replies = materialise(dense.join(parent, "uid", "left"), "replies")
    nodes = (replies.where(F.col("no").isNotNull()).groupBy("conv_id", F.col("no").alias("turn"))
             .agg(F.min("parent").alias("parent")))
    placed = places(materialise(nodes, "nodes")).withColumnsRenamed({"turn": "no", "root_turn": "root"})

    def turn_of(number: str, turn: str) -> DataFrame:
        return numbers.select("conv_id", F.col("no").alias(number), F.col("turn").alias(turn))

    whole = (replies.join(placed, ["conv_id", "no"], "left").join(turn_of("parent", "parent_turn"), ["conv_id", "parent"], "left")
             .join(turn_of("root", "root_turn"), ["conv_id", "root"], "left"))
    role = F.coalesce("role", F.lit("unknown"))
    return whole.select(
        "conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn",
        "root_turn", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), "position",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")).alias("formatted")) \
        .orderBy("conv_id", "position", "turn")
