"""Chat formatting in budgeted windows, as one DataFrame plan.

Prefix sums of turn tokens put each turn into a span; a window is the system turn, the end of the span before (history),
and the span's own turns. Only assistant texts of the span's own turns are under the loss mask: what is repeated is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import WORD

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a turn's marks count for.
MARKS = 4


def escape(text: Column) -> Column:
    """Puts a backslash after < wherever \\...| follows, so no control string is left; unescape() takes it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("<|nl|>"))


def _read_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def format_chat(turns: DataFrame, budget: int = 1024, history: int = 128, tokens_col: str | None = None) -> DataFrame:
    """(conv_id, window, n_repeated, text, loss) for rows of (conv_id, turn, role, text).

    A turn's tokens are its words and MARKS, which are no model's tokens; tokens_col names a column of counts to take
    instead (null: 0). Spans start at multiples of half of what budget leaves beside history and the system turn, so a
    window keeps to the budget unless one turn alone exceeds that half; turns are never cut, and a system turn that leaves
    nothing stands before one turn at a time. Windows are half full at least where turns are short. History is the turns of the span before whose tokens together are at most `history`, repeated, as the system turn (a first
    turn with role system) is in every later window. n_repeated counts these turns at a window's start. loss has
    (start, end) in code points of text for each assistant text under the mask.

    Turns go by turn number, nulls last, then role and text; rows that repeat a turn are turns of their own. Null text
    and null role are empty; a null conv_id is one conversation. An empty table gives an empty result; other columns are
    not read. Turns meet by conversation, windows are put together one by one.
    """
    count = F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) + MARKS
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), count.cast("long").alias("__count"))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    t = t.withColumn("__n", F.row_number().over(by))
    t = t.withColumn("__system", (F.col("__n") == 1) & (F.col("role") == "system"))
    t = t.withColumn("__tokens", F.when(F.col("__system"), 0).otherwise(F.col("__count")).cast("long"))
    t = t.withColumn("__upto", F.sum("__tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("__head", F.max(F.when(F.col("__system"), F.col("text"))).over(Window.partitionBy("conv_id")))
    t = t.withColumn("__last", F.max("__n").over(Window.partitionBy("conv_id")))
    system = F.coalesce(F.max(F.when(F.col("__system"), F.col("__count"))).over(Window.partitionBy("conv_id")), F.lit(0))
    t = t.withColumn("__half", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - system) / 2)))
    t = t.withColumn("window", F.floor((F.col("__upto") - F.col("__tokens")) / F.col("__half")))
    span = Window.partitionBy("conv_id", "window")
    t = t.withColumn("__end", F.max("__upto").over(span)).withColumn("__more", F.max("__n").over(span) < F.col("__last"))
    again = F.col("__more") & ~F.col("__system") & (F.col("__end") - F.col("__upto") + F.col("__tokens") <= history)
    own = F.struct(F.col("window"), F.lit(False).alias("again"))
    later = F.struct(F.floor(F.col("__end") / F.col("__half")).alias("window"), F.lit(True).alias("again"))
    t = t.withColumn("__use", F.explode(F.when(again, F.array(own, later)).otherwise(F.array(own))))
    mark = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    turn = F.struct(F.col("__n").alias("n"), F.col("__use.again").alias("again"), mark.alias("mark"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"))
    w = t.groupBy("conv_id", F.col("__use.window").alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("__turns"), F.max("__head").alias("__head"))
    # The system turn stands in the first window anyway.
    first = F.col("__turns")[0]
    head = F.struct(F.lit(0).alias("n"), F.lit(True).alias("again"), F.lit(f"{START}system\n").alias("mark"), escape(F.col("__head")).alias("body"), F.lit(False).alias("target"))
    w = w.withColumn("__turns", F.when(F.col("__head").isNotNull() & (first["n"] > 1), F.concat(F.array(head), F.col("__turns"))).otherwise(F.col("__turns")))
    tail = f"{END}\n"
    w = w.withColumn("text", F.array_join(F.transform("__turns", lambda x: F.concat(x["mark"], x["body"], F.lit(tail))), ""))
    # Where each turn's text starts: a running sum over the turns of one window.
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["mark"])
        end = start + F.char_length(x["body"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(tail)).alias("at"), F.when(x["target"] & ~x["again"], F.concat(acc["loss"], one)).otherwise(acc["loss"]).alias("loss"))

    w = w.withColumn("loss", F.aggregate("__turns", zero, step)["loss"])
    return w.select("conv_id", F.col("window").cast("long").alias("window"), F.size(F.filter("__turns", lambda x: x["again"])).alias("n_repeated"), "text", "loss")


def read_chat(windows: DataFrame) -> DataFrame:
    """What formatted windows hold, from their text and mask alone: (conv_id, turns, targets, formatted_chars), with
    turns as array<struct<role, text>> without repetitions and targets as the unescaped texts under the mask."""
    parts = F.slice(F.split("text", r"<\|im_end\|>\n"), F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(F.split("text", r"<\|im_end\|>\n")) - 1 - F.col("n_repeated")))

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"^<\|im_start\|>([^\n]*)\n", 1)
        return F.struct(_read_role(role).alias("role"), unescape(F.substr(p, F.char_length(role) + len(START) + 2)).alias("text"))

    w = windows.select("conv_id", "window", F.char_length("text").cast("long").alias("__chars"), F.transform(parts, turn).alias("__turns"), F.transform("loss", lambda x: unescape(F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"]))).alias("__targets"))
    w = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "__turns", "__targets"))).alias("__w"), F.sum("__chars").alias("formatted_chars"))
    return w.select("conv_id", F.flatten(F.transform("__w", lambda x: x["__turns"])).alias("turns"), F.flatten(F.transform("__w", lambda x: x["__targets"])).alias("targets"), "formatted_chars")


def chat_digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted windows."""
    r = read_chat(windows)
    target = F.array_join("targets", "")
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"),
        "formatted_chars",
    )
