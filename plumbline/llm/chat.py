r"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an ordered list of parts (kind, text, ref, units). A visitor flattens them: a text part becomes its escaped text,
an image, audio or document part a placeholder `<image>`, `<audio>`, `<document>`, and any other kind `<attachment>`; each
attachment is recorded with its turn, kind, reference and the tokens its placeholder stands for (units times TOKENS). A turn
is `<turn:ROLE>` content `</turn>` and a line feed. In texts and roles `\` is written `\b`, `<` as `\l` and `>` as `\g`, so no
text holds a control string and the way back is unique. The loss mask holds one span of code points per assistant turn.

Defined cases: a null text or null part list is empty, a null role is the empty role, a null turn number comes first, equal
turn numbers are ordered by role and content. Rows without conversation id form one conversation. A formatted conversation is
one string, so a conversation is as large as one row may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, table

PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
TOKENS = {"image": 256, "audio": 25, "document": 512}  # per image, second, page
END = "</turn>\n"


def escaped(text: Column) -> Column:
    for sign, written in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for sign, written in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(written), F.lit(sign))
    return text


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def _visit(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit("attachment"))
    mark = F.when(kind.isin(*TOKENS), kind).otherwise("attachment")
    return F.when(kind == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), mark, F.lit(">")))


def _tokens(part: Column) -> Column:
    rate = F.lit(1)
    for kind, n in TOKENS.items():
        rate = F.when(part["kind"] == kind, n).otherwise(rate)
    return (rate * F.coalesce(part["units"], F.lit(1))).cast("bigint")


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (their number), loss, attachments, expanded_tokens from rows conv_id, turn, role, parts.

    loss: for every turn its span (turn_start, start, end) in code points of `formatted`, null outside the mask; expanded_tokens:
    of all attachments.
    """
    content = F.array_join(F.transform(F.coalesce("parts", F.array().cast(PARTS)), _visit), "")
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"), content.alias("content"))
    head = F.concat(F.lit("<turn:"), escaped(F.col("role")), F.lit(">"))
    rows = rows.withColumn("piece", F.concat(head, F.col("content"), F.lit(END))).withColumn("size", F.length("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("from", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    start = F.col("from") + F.length(head)
    span = F.when(F.col("role") == "assistant", F.struct(F.col("from").alias("turn_start"), start.alias("start"), (start + F.length("content")).alias("end")))
    seen = F.transform(F.filter("parts", lambda p: ~p["kind"].eqNullSafe("text")),
                       lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    turns = rows.select("conv_id", F.struct("place", "piece", span.alias("loss"), seen.alias("attachments")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    attachments = F.flatten("t.attachments")
    return grouped.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.size("t").cast("bigint").alias("turns"), F.col("t.loss").alias("loss"),
                          attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss_texts, from `formatted` and `loss` alone; placeholders stay as they are."""
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    close = lambda p: F.instr(p, ">")  # noqa: E731  the first one ends the mark, as a role holds none
    role = lambda p: unescaped(F.substring(p, F.lit(len("<turn:") + 1), close(p) - len("<turn:") - 1))
    text = lambda p: unescaped(F.substring(p, close(p) + 1, F.length(p)))
    masked = F.filter(F.arrays_zip(F.col("pieces").alias("p"), F.col("loss").alias("l")), lambda x: x["l"].isNotNull())
    under = lambda x: F.substring(x["p"], (x["l"]["start"] - x["l"]["turn_start"] + 1).cast("int"), (x["l"]["end"] - x["l"]["start"]).cast("int"))
    return chats.withColumn("pieces", pieces).select(
        "conv_id", "formatted", F.transform("pieces", lambda p: F.struct(role(p).alias("role"), text(p).alias("text"))).alias("turns"),
        F.transform(masked, lambda x: unescaped(under(x))).alias("loss_texts"))


_LEN = r"length(replace(replace(replace({0},'\','\b'),'<','\l'),'>','\g'))"


@query(rf"""WITH m AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
UNION ALL SELECT -7, unnest([0,1]), unnest(['user','assistant']), '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10),'' ORDER BY turn NULLS FIRST,role,text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role='assistant'),0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text,'' ORDER BY turn NULLS FIRST,role,text) FILTER (role='assistant'),'')) AS loss_sha256,
sum(15 + {_LEN.format("role")} + {_LEN.format("text")})::BIGINT AS formatted_chars FROM m GROUP BY conv_id""")
def op6_chat(spark, d):
    """Every conversation, and one that quotes control strings, formatted and read back."""
    told = table(spark, d, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    quote = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = read_back(format_chats(told.union(quote).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
