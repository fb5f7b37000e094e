"""Chat formatting with typed content parts, in DataFrame functions only.

A message has a role and either a text or ordered parts (`array<struct<type,text,ref,units>>`). Parts are visited in
order: text is escaped and copied; an image, audio or document part becomes a numbered placeholder, its reference is
recorded, and it counts for as many tokens as its kind and units say. Template of a turn:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Escaping is reversible: a backslash is doubled and "<|" becomes "<\\|", so no control string can stand in a text; a line
break in a role, which would end the header, becomes the control string <|nl|>. `read_turns` gives the turns back.

Defined cases: null role or text is empty; turns sort by turn, then role and text (null turn first), so ties are in a
fixed order and repeated rows all stay; null conversation ids form one conversation; an empty table gives no rows; other
columns are ignored. A conversation is one value of the output, so its turns meet in one task by definition; each turn is
escaped before that, on the task that read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Tokens that one unit of a part stands for: image tiles, audio seconds, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def placeholder(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit("_"), number.cast("string"), F.lit("|>"))


def visit_parts(parts: Column) -> Column:
    """struct<text, attachments array<struct<number,type,ref,tokens>>, expanded_tokens>; text parts and unknown kinds give their text."""
    kinds = list(UNIT_TOKENS)
    zero = F.struct(F.lit("").alias("text"), F.expr("cast(array() as array<struct<number:int,type:string,ref:string,tokens:bigint>>)").alias("attachments"), F.lit(0).cast("bigint").alias("expanded_tokens"))

    def one(state: Column, part: Column) -> Column:
        number = F.size(state["attachments"]) + 1
        per = F.lit(0)
        for kind in kinds:
            per = F.when(part["type"] == kind, UNIT_TOKENS[kind]).otherwise(per)
        tokens = (per * F.coalesce(part["units"], F.lit(1))).cast("bigint")
        held = F.array(F.struct(number.cast("int").alias("number"), part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens")))
        media = F.coalesce(part["type"].isin(kinds), F.lit(False))
        return F.struct(
            F.concat(state["text"], F.when(media, placeholder(part["type"], number)).otherwise(escape(F.coalesce(part["text"], F.lit(""))))).alias("text"),
            F.when(media, F.concat(state["attachments"], held)).otherwise(state["attachments"]).alias("attachments"),
            (state["expanded_tokens"] + F.when(media, tokens).otherwise(F.lit(0))).cast("bigint").alias("expanded_tokens"),
        )

    return F.aggregate(F.coalesce(parts, F.lit(None).cast(PART), F.expr(f"cast(array() as {PART})")), zero, one)


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans array<struct<start,stop>> (code points of the formatted text that are learnt: the texts of roles in `learn`), attachments, expanded_tokens (of attachments)."""
    seen = F.struct(escape(F.coalesce(F.col(text), F.lit(""))).alias("text")) if parts is None else visit_parts(F.col(parts))
    name = F.coalesce(F.col(role), F.lit(""))
    one = messages.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.replace(escape(name), F.lit("\n"), F.lit(BREAK)).alias("_role"), name.alias("_name"), name.isin(*learn).alias("_learn"), seen.alias("_seen"))
    more = ["attachments", "expanded"] if parts else []
    one = one.select("_conv", "_turn", "_role", "_name", F.col("_seen.text").alias("text"), unescape(F.col("_seen.text")).alias("_said"), "_learn", *([F.col("_seen.attachments").alias("attachments"), F.col("_seen.expanded_tokens").alias("expanded")] if parts else []))
    head = lambda role: F.concat(F.lit(START), role, F.lit("\n"))
    # Where each turn starts is a running sum over the same partitioning that gathers the turns, so no step copies a growing list.
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_name", "_said", "_learn", *([F.to_json("attachments")] if parts else []))
    size = F.length(head(F.col("_role"))) + F.length("text") + len(END)
    one = one.withColumn("_size", size).withColumn("_at", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"))
    kept = one.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_at", "_role", "text", "_learn", *more))).alias("_m"))
    formatted = F.concat_ws("", F.transform("_m", lambda m: F.concat(head(m["_role"]), m["text"], F.lit(END))))
    start = lambda m: m["_at"] + F.length(head(m["_role"]))
    spans = F.transform(F.filter("_m", lambda m: m["_learn"]), lambda m: F.struct(start(m).cast("int").alias("start"), (start(m) + F.length(m["text"])).cast("int").alias("stop")))
    held = [F.flatten(F.transform("_m", lambda m: m["attachments"])).alias("attachments"), F.aggregate("_m", F.lit(0).cast("bigint"), lambda a, m: a + m["expanded"]).alias("expanded_tokens")] if parts else []
    return kept.select(F.col("_conv").alias(conv), F.size("_m").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"), *held)


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation (placeholders stay as text)."""
    body = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(body, F.lit(1), F.size(body) - 1)
    start = F.lit(len(START) + 1)

    def one(t: Column) -> Column:
        rest = F.substring(t, start, F.length(t))
        cut = F.instr(rest, "\n")
        role = F.replace(F.substring(rest, F.lit(1), cut - 1), F.lit(BREAK), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(rest, cut + 1, F.length(rest))).alias("text"))

    return F.transform(turns, one)


def learnt_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))))
