"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context and only that reply trainable.
Turns after the last reply (or a conversation without one) close with an example that has no target, so
that the output always holds every turn. The template is

    ### role: text</turn>

with a line feed after the mark. Inside roles and texts a backslash, ``<``, ``#`` and (roles only) ``:``
are written as a backslash and a letter, so no control string can occur in them, and reading back is exact.

Built-in expressions only. One shuffle brings the turns of a conversation together, which the contract's
hash over a whole conversation needs: the largest conversation must fit a task, as its last example does.
Turns are ordered by turn (null first), role and text, so that ties and repeated rows have one order.
Null texts and roles count as empty. Null conversation ids form one conversation. An empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, SEPARATOR = "### ", "</turn>\n", ": "
#: Character and the letter that stands for it after a backslash. The backslash is first.
ESCAPES = (("\\", "b"), ("<", "l"), ("#", "h"), (":", "c"))


def escape(text: Column, role: bool = False) -> Column:
    for char, letter in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column) -> Column:
    for char, letter in reversed(ESCAPES):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def expand(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 0), text, loss_start and loss_chars (code points in text; null without a target)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def head(t):
        return F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(SEPARATOR))

    parts = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target_role).alias("target"))).alias("p"),
    )
    made = parts.select(
        "conv_id", "p",
        F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))).alias("lines"),
        F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get(F.col("p"), i)["target"] | (i == F.size("p") - 1)).alias("at"),
    )
    rows = made.select("conv_id", "p", "lines", F.posexplode("at").alias("example", "i"))
    last = F.get(F.col("p"), F.col("i"))
    context = F.array_join(F.slice("lines", F.lit(1), F.col("i")), "")
    rows = rows.select("conv_id", "example", last.alias("last"), context.alias("context"))
    return rows.select(
        "conv_id", "example",
        F.concat("context", F.col("last.head"), F.col("last.body"), F.lit(CLOSE)).alias("text"),
        F.when(F.col("last.target"), F.length("context") + F.length("last.head")).alias("loss_start"),
        F.when(F.col("last.target"), F.length("last.body")).alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: the turns of the fullest text and all text under the masks."""
    reply = F.when(
        F.col("loss_start").isNotNull(), unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))
    )
    grouped = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "text"))["text"].alias("full"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", reply.alias("reply")))), lambda x: F.coalesce(x["reply"], F.lit(""))), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    lines = F.split("full", CLOSE, -1)
    turns = F.transform(
        F.slice(lines, F.lit(1), F.size(lines) - 1),
        lambda x: F.concat(
            unescape(F.substring(F.substring_index(x, SEPARATOR, 1), len(OPEN) + 1, 1 << 30)), F.lit("\n"),
            unescape(F.substring(x, F.length(F.substring_index(x, SEPARATOR, 1)) + 1 + len(SEPARATOR), F.length(x))), F.lit("\n"),
        ),
    )
    return grouped.select("conv_id", turns.alias("turns"), "loss", "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts look like the template's own marks."""
    spark: SparkSession = conversations.sparkSession
    text = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
