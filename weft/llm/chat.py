"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that start with '>' marks quote at the level of their number of marks; consecutive lines of one level
are a passage.  Passages and their lines are normalised (lower case, white space runs to one space, trimmed)
and hashed, and so are whole messages, their paragraphs and lines without the quotes.  A quoted hash joins
the first message of the conversation that said it, if that came before.  A message answers the message that
its quotes of the lowest level name, whole passages before single lines, later messages before earlier ones.
Reply order puts a message behind the start of its thread: by thread_root, then turn.

Defined cases: null texts are empty; messages of null conversation or turn answer nothing and have no position; quotes of unknown
text are removed and link nothing; rows of one conversation and turn answer the same message; blank lines
around removed quotes are trimmed at the ends of the text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.exchange import checkpoint

MARKS = r"^\s*(>[\s>]*)"
TURNS = 1024


def _plain(x):  # noqa: ANN001, ANN202
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def _level(line):  # noqa: ANN001, ANN202
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _passages(lines):  # noqa: ANN001, ANN202
    """Consecutive lines of one level above 0, joined.  lines is a column; the work is linear in their number."""
    at = lambda i: F.get(lines, i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
    runs = F.filter(F.zip_with(starts, ends, lambda i, j: F.struct(i.alias("i"), j.alias("j"))), lambda r: at(r["i"]) > 0)
    return F.transform(runs, lambda r: F.struct(at(r["i"]).alias("level"), F.array_join(F.transform(F.slice(lines, r["i"] + 1, r["j"] - r["i"]), lambda x: x["body"]), "\n").alias("body")))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quoted (lines), reply_to, thread_root and position, per message.

    position counts a conversation's messages in reply order from 1: by thread_root, then turn; messages of one
    turn have the same.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    lines = F.transform(F.split("raw", "\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))
    quotes = F.col("raw").rlike(r"(?m)" + MARKS)
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    own = F.when(quotes, F.regexp_replace(own, r"^\n+|\n+\z", "")).otherwise(F.col("raw"))
    count = F.when(quotes, F.size(F.filter(lines, lambda x: x["level"] > 0))).otherwise(0)
    texts = rows.select("conv_id", "turn", "role", own.alias("text"), count.alias("n_quoted"))
    asking = rows.where(quotes & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    asked = asking.select("conv_id", "turn", lines.alias("lines")).select("conv_id", "turn", F.explode(_passages(F.col("lines"))).alias("p"))
    asked = asked.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("p.body").alias("body"))), F.transform(F.split("p.body", "\n"), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("body"))))).alias("k"))
    asked = checkpoint(asked.select("conv_id", "turn", "level", "k.kind", _plain(F.col("k.body")).alias("body")).where("body <> ''").select("conv_id", "turn", "level", "kind", F.sha2("body", 256).alias("hash")).distinct())
    said = texts.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n\s*\n"), F.split("text", "\n")))
    said = said.select("conv_id", "turn", F.explode(units).alias("body")).select("conv_id", "turn", _plain(F.col("body")).alias("body")).where("body <> ''")
    first = said.select("conv_id", F.sha2("body", 256).alias("hash"), F.col("turn").alias("said")).groupBy("conv_id", "hash").agg(F.min("said").alias("said"))
    found = asked.join(first, ["conv_id", "hash"]).where("said < turn")
    reply = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "kind", (-F.col("said")).alias("late"))).alias("b")).select("conv_id", "turn", (-F.col("b.late")).alias("reply_to"))
    reply = checkpoint(reply)
    out = texts.join(reply.join(_roots(reply), ["conv_id", "turn"], "left"), ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", "text", F.col("n_quoted").cast("int"), "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"))
    return _positions(out)


def _positions(messages: DataFrame) -> DataFrame:
    """messages with their place in reply order, 1 + the number of messages of the conversation before them.

    Messages are counted by thread and turn; threads are summed in blocks of TURNS roots, and turns of a thread
    in blocks of TURNS, so that a conversation of any length is many small windows.
    """
    block = F.floor(F.col("thread_root") / TURNS)
    turns = F.floor(F.col("turn") / TURNS)
    counts = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", block.alias("block"), "thread_root", turns.alias("turns"), "turn").agg(F.count("*").alias("n"))
    keys, total = ["conv_id", "block", "thread_root", "turns", "turn"], counts
    for depth in range(len(keys) - 1, 0, -1):
        # What comes before each key among those that share its upper keys.
        some = total.groupBy(*keys[: depth + 1]).agg(F.sum("n").alias("n")) if depth < len(keys) - 1 else total
        before = F.sum("n").over(Window.partitionBy(*keys[:depth]).orderBy(keys[depth]).rowsBetween(Window.unboundedPreceding, -1))
        level = some.select(*keys[: depth + 1], F.coalesce(before, F.lit(0)).alias(f"before{depth}"))
        counts = counts.join(level, keys[: depth + 1])
    place = (F.col("before1") + F.col("before2") + F.col("before3") + F.col("before4") + 1).alias("position")
    return messages.join(counts.select("conv_id", "turn", place), ["conv_id", "turn"], "left").select(*messages.columns, "position")


def _roots(reply: DataFrame) -> DataFrame:
    """The start of each answering message's thread: pointers double until none moves."""
    at = reply.select("conv_id", "turn", F.col("reply_to").alias("thread_root"))
    while at.take(1):
        up = at.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("higher"))
        at = checkpoint(at.join(up, ["conv_id", "thread_root"], "left"))
        moves = at.where("higher IS NOT NULL").take(1)
        at = at.select("conv_id", "turn", F.coalesce("higher", "thread_root").alias("thread_root"))
        if not moves:
            break
    return at


def conversations(messages: DataFrame, block: int = 256, **columns: str) -> DataFrame:
    """conv_id, part and its messages in reply order; a part holds the threads of block consecutive turns."""
    m = link_quotes(messages, **columns).withColumn("part", F.floor(F.col("thread_root") / block))
    return m.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("thread_root", "turn", "role", "text", "reply_to"))).alias("messages"))
