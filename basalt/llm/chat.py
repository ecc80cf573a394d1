"""Chat formatting in budgeted windows, in DataFrame operations only.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens choose the spans: turns
are added while the window stays within its budget. Each later window repeats the system turn and a
limited history (the turns before it, up to a number of tokens); what is repeated is masked, so each
assistant text is under the loss mask once.

Template: `### role: text </turn>` and a line feed for each turn. Inside roles and texts, backslash,
`#` and `<` become `\\b`, `\\h` and `\\l` (in roles also `:`, as `\\c`), so no text holds a marker, and
replacing them back in the order l, h, c, b restores the text.

Defined results: null text and role are empty; turns stand in the order of turn (null first), then
role and text; repeated rows are turns of their own; a turn longer than the budget has a window
without history; a null conv_id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that the markers of a turn take.
TURN_TOKENS = 4
HEAD, MIDDLE, END = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a token for four bytes, and those of the markers."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + TURN_TOKENS


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, each with its tokens and the tokens up to it."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"seq": F.row_number().over(order), "tokens": tokens(F.col("text"))})
    rows = rows.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "tokens", "upto"))).alias("turns"))


def _windows(budget: int, history: int) -> Column:
    """array<struct<first, back, room>>: first new turn of each window, first repeated one (from 1)."""
    turns = F.col("turns")
    system = F.when(F.element_at(turns, 1)["role"] == "system", F.element_at(turns, 1)["tokens"]).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, t: Column) -> Column:
        first = F.size(acc) == 0
        open_ = F.try_element_at(acc, F.lit(-1))
        before = t["upto"] - t["tokens"]
        fits = t["upto"] - open_["base"] + open_["kept"] <= budget
        # the system turn is never part of the history
        room = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - system - t["tokens"]))
        back = F.size(F.filter(turns, lambda x: (before - x["upto"] + x["tokens"] > room) | ((x["seq"] == 1) & (x["role"] == "system")))) + 1
        back = F.least(back, t["seq"]).cast("int")
        base = F.element_at(turns, back)["upto"] - F.element_at(turns, back)["tokens"]
        new = F.struct(t["seq"].cast("int").alias("first"), back.alias("back"), base.alias("base"), system.alias("kept"))
        begin = F.struct(F.lit(1).alias("first"), F.lit(1).alias("back"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("kept"))
        return F.when(first, F.array(begin)).otherwise(F.when(fits, acc).otherwise(F.concat(acc, F.array(new))))

    none = F.array().cast("array<struct<first:int,back:int,base:bigint,kept:bigint>>")
    return F.aggregate(turns, none, step)


def format_conversations(conversations: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """conv_id, windows: array<struct<text, repeated, loss: array<struct<start, stop>>>>.

    `repeated` is the number of turns at the head that stand in an earlier window too; `loss` has
    spans of code points of `text`.
    """
    starts = _turns(conversations).withColumn("starts", _windows(budget, history))

    def window(w: Column, i: Column) -> Column:
        after = F.coalesce(F.try_element_at(F.col("starts"), i + 2)["first"], F.size("turns") + 1)
        system = F.when((w["back"] > 1) & (F.element_at("turns", 1)["role"] == "system"), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        shown = F.concat(system, F.slice("turns", w["back"], after - w["back"]))
        repeated = F.size(system) + w["first"] - w["back"]
        parts = F.transform(shown, lambda t: F.struct(
            F.concat(F.lit(HEAD), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"), ((t["role"] == "assistant") & (t["seq"] >= w["first"])).alias("loss")
        ))
        return F.struct(parts.alias("parts"), repeated.cast("int").alias("repeated"))

    def spans(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("loss"))

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["head"])
            stop = start + F.length(p["body"])
            span = F.struct(start.alias("start"), stop.alias("stop"))
            return F.struct((stop + len(END)).alias("at"), F.when(p["loss"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

        return F.aggregate(parts, zero, step)["loss"]

    cut = starts.select("conv_id", F.transform("starts", window).alias("cut"))
    return cut.select("conv_id", F.transform("cut", lambda w: F.struct(
        F.array_join(F.transform(w["parts"], lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"), w["repeated"].alias("repeated"), spans(w["parts"]).alias("loss")
    )).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (texts under the mask), formatted_chars: from the windows alone."""

    def turns(w: Column) -> Column:
        marked = F.split(w["text"], "</turn>\n", -1)
        own = F.slice(marked, w["repeated"] + 1, F.size(marked) - 1 - w["repeated"])
        return F.transform(own, lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, MIDDLE, 1), len(HEAD) + 1, 1 << 30)).alias("role"),
            unescape(F.substring(t, F.locate(MIDDLE, t) + len(MIDDLE), F.length(t) - F.locate(MIDDLE, t) - len(MIDDLE))).alias("text"),
        ))

    loss = lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], s["start"] + 1, s["stop"] - s["start"])))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform("windows", turns)).alias("turns"),
        F.flatten(F.transform("windows", loss)).alias("loss"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda n, w: n + F.length(w["text"])).alias("formatted_chars"),
    )


def digests(back: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )
