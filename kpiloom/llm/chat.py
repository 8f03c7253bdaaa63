"""Chat formatting in budgeted windows (DataFrame functions only).

A conversation's turns, in order, are written with a template; control strings
inside texts are escaped so that they can be read back.  Prefix sums of the turns' tokens
deal turns to windows: each turn belongs to one window as a new turn.  A window starts with the
conversation's system turn and a limited stretch of the turns before it, which are
repeated for context only: the loss covers the assistant texts among the new turns.

Scale: order and prefix sums are found in blocks that a range partitioning of all rows by
(conversation, turn) cuts, then across the blocks of a conversation, so a conversation with a third
of all rows is spread over many tasks.  Repeated turns are found by equi-joins
on (conversation, rank).  A window holds at most its budget of tokens, or one
longer turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, save

BUDGET = 512  # tokens of a window
HISTORY_TURNS, HISTORY_TOKENS = 2, 128  # repeated before the new turns, at most
LEAST_NEW = 64  # tokens for new turns, however long the system turn is
TURN_TOKENS = 4  # of the template

# The template.
OPEN, CLOSE, SYSTEM, ASSISTANT = "<|im_start|>", "<|im_end|>\n", "system", "assistant"


def escape(text: Column) -> Column:
    r"""A control string starts with ``<|``: every ``<``, backslashes, ``|`` gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def n_tokens(text: Column) -> Column:
    """Words, and the template's."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long") + TURN_TOKENS


def ranked(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with ``rank`` from 1 and ``before``, the tokens of the turns before (a system turn at rank 1 counts none).

    Ties in ``turn`` go by role, then text; null turns come first."""
    order = ["turn", "role", "text"]
    rows = turns.withColumn("tokens", n_tokens(F.col("text")))
    rows = save(rows.repartitionByRange("conv", *order).withColumn("block", F.spark_partition_id()), "chat-blocks")
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(inside).cast("long"))
    totals = rows.groupBy(F.col("conv").alias("c"), F.col("block").alias("b")).agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("c", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
                            F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("s0"))
    before = F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    rows = (rows.join(offsets, rows["conv"].eqNullSafe(offsets["c"]) & (rows["block"] == offsets["b"]))
            .withColumn("rank", F.col("rank") + F.col("n0")).withColumn("before", F.col("before") + F.col("s0"))
            .drop("block", "c", "b", "n0", "s0"))
    return save(rows, "chat-ranked")


def _dealt(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` with ``window`` and the system turn's tokens taken out of ``before``.

    The token line is cut at every ``room`` tokens; turns between two cuts share a window, a turn across a cut has its own."""
    first = rows.where((F.col("rank") == 1) & (F.col("role") == SYSTEM)).select(F.col("conv").alias("sc"), F.col("tokens").alias("system_tokens"))
    rows = rows.join(first, rows["conv"].eqNullSafe(first["sc"]), "left").drop("sc")
    system = F.coalesce("system_tokens", F.lit(0))
    room = F.greatest(F.lit(LEAST_NEW), F.lit(budget - HISTORY_TOKENS) - system)
    is_system = (F.col("rank") == 1) & (F.col("system_tokens").isNotNull())
    start = F.when(is_system, 0).otherwise(F.col("before") - system)
    end = F.when(is_system, 0).otherwise(start + F.col("tokens") - 1)
    rows = rows.withColumns({"before": start, "lo": F.floor(start / room), "hi": F.floor(end / room), "is_system": is_system})
    return rows.withColumn("window", 2 * F.col("lo") + (F.col("hi") > F.col("lo")).cast("long")).drop("lo", "hi", "system_tokens")


def _repeated(rows: DataFrame) -> DataFrame:
    """The system turn and the history of each window that starts after them, as rows of that window."""
    starts = rows.groupBy("conv", "window").agg(F.min(F.struct("rank", "before")).alias("s")).select(
        F.col("conv").alias("wc"), F.col("window").alias("w"), F.col("s.rank").alias("w_rank"), F.col("s.before").alias("w_before"))
    near = starts.withColumn("at", F.explode(F.sequence(F.col("w_rank") - HISTORY_TURNS, F.col("w_rank") - 1)))
    kept = rows.where(~F.col("is_system"))
    history = (kept.join(near, kept["conv"].eqNullSafe(near["wc"]) & (kept["rank"] == near["at"]))
               .where(F.col("w_before") - F.col("before") <= HISTORY_TOKENS))
    systems = rows.where("is_system")
    later = starts.where(F.col("w_rank") > 1)
    system = systems.join(later, systems["conv"].eqNullSafe(later["wc"]))
    columns = ["conv", F.col("w").alias("window"), "rank", "role", "text"]
    return history.select(*columns).union(system.select(*columns))


def format_windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(conv, window, first_rank, n_repeated, n_new, formatted, loss): one row for each window.

    ``loss`` is an array of (start, end) in code points of ``formatted``: the escaped assistant texts
    among the new turns.  Null texts and roles count as empty; a null
    conversation id is a conversation of its own; repeated rows are turns of
    their own; an empty table gives no rows; other columns are not read, whatever
    their names."""
    turns = conversations.select(F.col(quoted(conv_col)).alias("conv"), F.col(quoted(turn_col)).alias("turn"),
                                 F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("role"),
                                 F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    rows = _dealt(ranked(turns), budget)
    new = rows.select("conv", "window", "rank", "role", "text").withColumn("new", F.lit(True))
    members = new.union(_repeated(rows).withColumn("new", F.lit(False)))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    loss = F.col("new") & (F.col("role") == ASSISTANT)
    turn = F.struct("rank", "new", head.alias("head"), body.alias("body"), loss.alias("loss"))
    windows = members.select("conv", "window", turn.alias("t")).groupBy("conv", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    line = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))

    def advance(seen, t):
        start = seen["at"] + F.char_length(t["head"])
        span = F.struct(start.alias("start"), (start + F.char_length(t["body"])).alias("end"))
        return F.struct((seen["at"] + F.char_length(line(t))).alias("at"),
                        F.when(t["loss"], F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    new_turns = F.filter("ts", lambda t: t["new"])
    return windows.select(
        "conv", "window", new_turns[0]["rank"].alias("first_rank"),
        F.size(F.filter("ts", lambda t: ~t["new"])).alias("n_repeated"), F.size(new_turns).alias("n_new"),
        F.array_join(F.transform("ts", line), "").alias("formatted"),
        F.aggregate("ts", none, advance, lambda s: s["spans"]).alias("loss"))


def read_turns(formatted: Column, skip: Column) -> Column:
    """(role, text) of a window's turns after the first ``skip``, read back from its text."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), skip + 2, F.lit(1 << 30))

    def read(part):
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.char_length(role) + 2, F.char_length(part) - F.char_length(role) - 1 - len(CLOSE))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, read)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))
