"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: the turns before it as context and
only its own text under the loss mask.  A conversation that does not end with
an assistant turn gets one more example without a target, so that its last
turns are in the output too.  A conversation is one row of the result of one
``groupBy`` (its digest is defined over the whole of it), so the unit of memory
is a conversation, not a role or source.

Each turn is ``<open> role <close> text <end>``.  In roles and texts a backslash
is doubled and the first character of each control string is replaced by a
backslash and a letter, so control strings occur in the output as marks only
and every text can be read back.

Defined results: null text and null role count as empty; turns sort by (turn,
role, text), null turns first, so ties and repeated rows have one order; a null
conversation id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.regexp_replace(c, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(c, r"\[(?=/?INST\])", r"\\b")


def unescaped(c: Column) -> Column:
    # runs of backslashes start with whole pairs, so cutting at pairs is exact
    plain = F.transform(F.split(c, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(plain, "\\")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             target_role: str = "assistant") -> DataFrame:
    """One row per example: conv, example (0-based place of its target),
    has_target, is_last, formatted, loss_start and loss_end (code points)."""
    rows = turns.select(F.col(conv).alias("_conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = whole.select(
        "_conv", "turns",
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(CLOSE))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("bodies"),
        F.size("turns").alias("n"))
    made = made.withColumn("pieces", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))))
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("turns"), i)["role"] == target_role)
    last = F.get(F.col("turns"), F.col("n") - 1)["role"] == target_role
    made = made.withColumn("example", F.explode(F.when(last, places).otherwise(F.concat(places, F.array("n")))))
    has = F.col("example") < F.col("n")
    context = F.concat(F.lit(BEGIN), F.array_join(F.slice("pieces", 1, F.col("example")), ""))
    made = made.select("_conv", "example", has.alias("has_target"), (F.col("example") >= F.col("n") - 1).alias("is_last"), context.alias("context"),
                       F.when(has, F.get("heads", "example")).otherwise("").alias("head"),
                       F.when(has, F.get("bodies", "example")).otherwise("").alias("body"))
    start = F.length("context") + F.length("head")
    return made.select(
        F.col("_conv").alias(conv), "example", "has_target", "is_last",
        F.concat("context", "head", "body", F.when(F.col("has_target"), F.lit(END)).otherwise("")).alias("formatted"),
        start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def read_back(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From the formatted examples: conv, turns (role, text), loss (the text
    under the mask, in order) and formatted_chars."""
    body = F.expr(f"substring(formatted, {len(BEGIN) + 1})")
    pieces = F.slice(F.split(body, END), 1, F.size(F.split(body, END)) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, CLOSE, 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
                        unescaped(F.substr(p, F.length(head) + F.lit(len(CLOSE) + 1))).alias("text"))

    parsed = made.select(
        conv, "example", "has_target", F.length("formatted").alias("chars"),
        F.when(F.col("is_last"), F.transform(pieces, turn)).alias("turns"),
        unescaped(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"))
    grouped = parsed.groupBy(conv).agg(
        F.max_by("turns", "example").alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("has_target"), F.struct("example", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"))
    return grouped.select(conv, "turns", F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
