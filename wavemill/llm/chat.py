"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply is under the loss. Turns after the last reply go into one more example without a target. A turn
is written <|im_start|>role, a new line, the text, <|im_end|> and a new line. Control strings inside
texts are escaped by one more "!": "<|" becomes "<!|", "<!|" becomes "<!!|" and so on, so that no text
can end or open a turn and parsing is exact; new lines in roles are written \\n, backslashes doubled.

Conversations are grouped by id; a conversation's turns are one example's text, so they are the unit
that a task holds. Its turns are in order of turn, then role, then text, so ties and repeated rows
have a defined place; all rows count. Null texts and roles are empty, null turns come first, a null
conv_id is a conversation like any other. Roles other than "assistant" are context. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", "<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # from left to right, a doubled backslash is one backslash; what stands between those is a new line where it says \\n
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, text, and loss_start and loss_end, the code
    points of the text that are under the loss (both null for an example without a target)."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    thin = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = thin.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TARGET).alias("target"))).alias("turns"))
    convs = convs.withColumn("whole", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), ""))
    convs = convs.withColumn("sizes", F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END) + 1))
    each = convs.select("conv_id", "whole", "sizes", F.size("turns").alias("last"), F.posexplode("turns").alias("i", "t"))
    each = each.withColumn("before", F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), F.lit(0), lambda a, b: a + b))
    each = each.where("t.target or i + 1 = last")
    start = F.col("before") + F.length("t.head")
    place = F.when(F.col("t.target"), start), F.when(F.col("t.target"), start + F.length("t.body"))
    return each.select(
        "conv_id", F.col("i").alias("example"), (F.col("i") + 1).alias("n_turns"),
        F.substring("whole", F.lit(1), F.col("before") + F.element_at("sizes", F.col("i") + 1)).alias("text"),
        place[0].alias("loss_start"), place[1].alias("loss_end"),
    )


def parsed(text: Column) -> Column:
    """The turns of an example's text: array of (role, text), unescaped."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    role = F.transform(pieces, lambda x: F.struct(F.substring_index(x, "\n", 1).alias("role"), x.alias("x")))
    body = lambda p: F.substring(p["x"], F.length(p["role"]) + 2, F.length(p["x"]) - F.length(p["role"]) - 2 - len(END))
    return F.transform(role, lambda p: F.struct(unescape_role(p["role"]).alias("role"), unescape(body(p)).alias("text")))


def read_back(found: DataFrame) -> DataFrame:
    """What examples say about each conversation, from their texts and loss spans alone: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Every example is parsed; where its turns do not begin with
    all of the example's before, turns_sha256 is null."""
    loss = unescape(F.coalesce(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")), F.lit("")))
    one = found.select("conv_id", "example", F.length("text").cast("long").alias("n"), loss.alias("loss"), parsed(F.col("text")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = one.select("conv_id", "example", "n", "loss", F.size("turns").cast("long").alias("n_turns"), said.alias("said"))
    before = F.lag("said").over(Window.partitionBy("conv_id").orderBy("example"))
    one = one.withColumn("goes_on", F.startswith("said", F.coalesce(before, F.lit(""))))
    per = one.groupBy("conv_id").agg(
        F.max_by("said", "example").alias("said"), F.max("n_turns").alias("n_turns"), F.bool_and("goes_on").alias("goes_on"), F.sum("n").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    return per.select(
        "conv_id", "n_turns", F.when(F.col("goes_on"), F.sha2("said", 256)).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
    SELECT *, sum(12 + length(role) + 1 + length(regexp_replace(text, '<(!*)\|', '<!\1|', 'g')) + 11) OVER w AS so_far,
           row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
