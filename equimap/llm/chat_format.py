"""Chat formatting by prefix-target expansion.

A conversation gives one example for each assistant turn: all turns before it as context, then the reply, which alone is
trainable. Turns after the last reply, or all turns of a conversation without one, give one more example without a
trainable part, so nothing of the input is lost.

Template: each turn is `<s>[ROLE]role[INST]text[/INST]</s>`. Control strings inside a role or text get a backslash after
their first character (and one more where backslashes already stand there), which is undone by taking one away; texts
without control strings stay as they are.

Contexts are not repeated on the way: a turn is rendered once, and the examples of a conversation are slices of its turns.
A conversation's turns have to meet in one row, since each example contains all turns before it; the expansion is the
square of a conversation's length by its definition.

Cases: a null text or role is empty. Rows are ordered by turn (null first), then role, then text, so ties have one order;
repeated rows are turns of their own. A null conv_id is a conversation. An empty table gives no example. Other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, table

#: What marks turns; fixed values of the template.
OPEN, ROLE, BODY, END, CLOSE = "<s>", "[ROLE]", "[INST]", "[/INST]", "</s>"
_TAIL = r"(?=/?s>|/?INST\]|ROLE\])"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2")


def rendered(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """What stands before, in and after a turn's text."""
    return F.concat(F.lit(OPEN + ROLE), escaped(role), F.lit(BODY)), escaped(text), F.lit(END + CLOSE)


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turns (array of head, body, tail, target) in order."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    head, body, tail = rendered(r, t)
    one = F.struct(F.col(turn).alias("turn"), r.alias("role"), head.alias("head"), body.alias("body"), tail.alias("tail"))
    return rows.select(F.col(conv).alias("conv"), one.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def examples(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = TARGET) -> DataFrame:
    """conv, n (number of the example, from 1), formatted, mask_start, mask_end: the trainable code points."""
    turns = conversations(rows, conv, turn, role, text)
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"] == target)
    ends = F.when(F.size(replies) == 0, F.array(F.size("turns"))).when(F.element_at(replies, -1) < F.size("turns"), F.concat(replies, F.array(F.size("turns")))).otherwise(replies)
    whole = lambda x: F.concat(x["head"], x["body"], x["tail"])
    each = turns.select("conv", "turns", F.posexplode(ends).alias("k", "i"))
    last = F.element_at("turns", F.col("i"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("i") - 1), whole), "")
    out = each.select("conv", (F.col("k") + 1).alias("n"), before.alias("before"), last.alias("last"))
    trains = F.col("last.role") == target
    start = F.when(trains, F.length("before") + F.length("last.head")).otherwise(F.lit(0))
    end = F.when(trains, start + F.length("last.body")).otherwise(F.lit(0))
    return out.select("conv", "n", F.concat("before", whole(F.col("last"))).alias("formatted"), start.alias("mask_start"), end.alias("mask_end"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of an example's string."""
    turn = lambda x: F.struct(
        unescaped(F.split_part(x, F.lit(BODY), F.lit(1))).alias("role"),
        unescaped(F.substring(x, F.locate(BODY, x) + len(BODY), F.length(x))).alias("text"),
    )
    # every turn begins with OPEN + ROLE and ends with END + CLOSE, which stand nowhere else
    inner = F.split(F.substring(formatted, F.lit(len(OPEN + ROLE) + 1), F.length(formatted) - len(OPEN + ROLE) - len(END + CLOSE)), r"\[/INST\]</s><s>\[ROLE\]", -1)
    return F.transform(inner, turn)


def digests(found: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: turns, and all text under the loss masks."""
    masked = unescaped(F.substring("formatted", F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start")))
    rows = found.select(
        "conv", "n", F.length("formatted").alias("chars"), masked.alias("loss"),
        read_back(F.col("formatted")).alias("turns"),
    )
    per = rows.groupBy("conv").agg(
        F.max_by("turns", "n").alias("turns"),
        F.array_sort(F.collect_list(F.struct("n", "loss"))).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda x: x["loss"]), "")
    return per.select(
        "conv", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: The conversation that the contract adds.
PLANTED = (-7, "</s>[INST] ok [/INST]")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = narrow(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(PLANTED[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED[1]).alias("text"),
    )
    return digests(examples(rows.unionByName(more))).withColumnRenamed("conv", "conv_id")


#: The lengths follow from the template: 26 marking characters and the role for each turn, and a backslash for each control string.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                  length(role) + length(text) + 26
                  + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\]|ROLE\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|ROLE\])')) AS chars FROM c),
     e AS (SELECT conv_id, i FROM o WHERE role = 'assistant' OR i = n),
     f AS (SELECT e.conv_id, sum(o.chars) AS formatted_chars FROM e JOIN o ON e.conv_id = o.conv_id AND o.i <= e.i GROUP BY e.conv_id)
SELECT o.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o.i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY o.i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(max(formatted_chars) AS BIGINT) AS formatted_chars
FROM o JOIN f ON o.conv_id = f.conv_id GROUP BY o.conv_id
"""
