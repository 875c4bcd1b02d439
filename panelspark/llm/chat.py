r"""Chat formatting: typed content parts flattened to one marked string per conversation.

A turn's content is a list of parts (type, text, ref, units). The visitor flattens
them in order: text parts are escaped and kept, every other part becomes a
placeholder `<|type:i|>` with its index among the conversation's attachments, whose
reference and expanded token count (units times TOKENS_PER_UNIT) are recorded. A
plain text column is a turn of one text part. Where a turn starts and how many attachments
stand before it are running sums over the conversation's turns, and turns are joined once.

Output of a turn: `<|role|>` + role + newline + content + `<|end|>`. Inside roles
and texts, `\` becomes `\e`, `<` becomes `\l` and `[` becomes `\b` (a newline in a
role `\n`), so that no control string of this or other templates can occur there;
undoing the three in the order l, b, e is exact, because in an escaped string each
backslash opens a code. The loss mask is a list of spans (start, length in code
points of the output) that cover the contents of the trained roles.

Defined results: a null text or part is empty, a null role is an empty role, null
turns come first, equal turns are ordered by role and text, rows of a null conv_id
form one conversation; an empty table gives an empty result. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,units:bigint>"
TURN, END = "<|role|>", "<|end|>"
#: Tokens that one unit of a part expands to: an image's units are patches, an audio's seconds, a document's pages.
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 600}


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\e"))
    out = F.replace(out, F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """The one part of a plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _visited(state: Column, part: Column, base: Column) -> Column:
    """The visitor: state (content, attachments) of a turn after one more part. base: attachments of the turns before."""
    kind = F.coalesce(part["type"], F.lit("text"))
    is_text, n = kind == "text", base + F.size(state["attachments"])
    per = F.lit(1).cast("long")
    for name, tokens in TOKENS_PER_UNIT.items():
        per = F.when(kind == name, F.lit(tokens).cast("long")).otherwise(per)
    marker = F.concat(F.lit("<|"), escape_role(kind), F.lit(":"), n.cast("string"), F.lit("|>"))
    entry = F.struct(n.alias("index"), kind.alias("type"), part["ref"].alias("ref"), (F.coalesce(part["units"], F.lit(0).cast("long")) * per).alias("tokens"))
    return F.struct(
        F.concat(state["content"], F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(marker)).alias("content"),
        F.when(is_text, state["attachments"]).otherwise(F.concat(state["attachments"], F.array(entry))).alias("attachments"),
    )


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments of every conversation. turns: conv_id, turn, role, parts (array of PART)."""
    # ties of turn are ordered by role and parts, so that they come out the same in every run
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, -1)
    each = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).alias("parts"))
    others = F.size(F.filter("parts", lambda p: F.coalesce(p["type"] != "text", F.lit(False))))
    each = each.withColumn("base", F.coalesce(F.sum(others).over(before), F.lit(0)).cast("int"))
    entry = "struct<index:int,type:string,ref:string,tokens:bigint>"
    start = F.struct(F.lit("").alias("content"), F.array().cast(f"array<{entry}>").alias("attachments"))
    body = F.aggregate("parts", start, lambda state, part: _visited(state, part, F.col("base")))
    each = each.select("conv_id", "turn", "role", "parts", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"), body.alias("body"))
    each = each.withColumn("piece", F.concat("head", "body.content", F.lit(END)))
    each = each.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    span = F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body.content").alias("length"))
    kept = F.struct("start", "piece", F.when(F.col("role").isin(*trained), span).alias("span"), F.col("body.attachments").alias("attachments"))
    convs = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return convs.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), placeholders kept as they stand."""
    pieces = F.filter(F.split(formatted, r"<\|role\|>"), lambda _, i: i > 0)

    def one(p: Column) -> Column:
        body = F.substring_index(p, END, 1)
        at = F.instr(body, "\n")
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
