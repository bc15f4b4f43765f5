r"""Chat formatting in Spark expressions: turns sorted in an array, adjacent turns of one role merged, one string per conversation.

A block is HEAD, role, COLON, its texts with NEXT between them, END. In roles and texts, < and # and \ are written as
\l, \h and \b, and newlines in roles as \n; so none of them can form or break a control string, and reading back gives
exactly what was written. Merging and placing cost about as much as a conversation is long, also with very many turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, COLON, NEXT, END = "### ", ":\n", "<next>", "</turn>\n"
#: Pieces that are placed in one go: an array that grows by one item a step costs the square of its length.
CHUNK = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\h", "#"), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def blocks(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, blocks: array of (role, texts)) per conversation: rows by turn, then role and text; adjacent rows of a role are one block."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = chats.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    number = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: (i == 1) | (F.element_at("rows", i)["role"] != F.element_at("rows", F.greatest(i - 1, F.lit(1)))["role"]))
    rows = rows.withColumn("firsts", number)

    def block(first: Column, i: Column) -> Column:
        after = F.coalesce(F.try_element_at("firsts", i + 2), F.size("rows") + 1)
        return F.struct(F.element_at("rows", first)["role"].alias("role"), F.transform(F.slice("rows", first, after - first), lambda x: x["text"]).alias("texts"))

    return rows.select("conv_id", F.transform("firsts", block).alias("blocks"))


def _chunks(items: str) -> Column:
    """An array cut into arrays of CHUNK."""
    many = F.ceil(F.size(items) / CHUNK).cast("int")
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.slice(items, (i - 1) * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())


def format_chats(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss: array of (start, end)) per conversation; loss has the code points of each text of the role to learn.

    A null role or text counts as empty, null turns come first, repeated rows are turns of their own, rows with a null
    conv_id are one conversation. An empty table gives no rows; other columns aren't read. A conversation is one value
    of the result and so must fit in a task.
    """
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        head = piece(F.concat(F.lit(HEAD), F.replace(escape(b["role"]), F.lit("\n"), F.lit("\\n")), F.lit(COLON)), F.lit(False))
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), piece(escape(t), b["role"] == learn))))
        return F.concat(F.array(head), texts, F.array(piece(F.lit(END), F.lit(False))))

    def place(state: Column, p: Column) -> Column:
        end = state["at"] + F.length(p["s"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def placed(chunk: Column, base: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.coalesce(F.aggregate(chunk, F.struct(base.alias("at"), none.alias("spans")), place)["spans"], none)  # the last base has no chunk

    rows = blocks(chats, conv_id, turn, role, text).select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    rows = rows.select("conv_id", "pieces", _chunks("pieces").alias("chunks"))
    chars = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.length(p["s"])))
    rows = rows.withColumn("bases", F.aggregate(chars, F.array(F.lit(0)), lambda found, n: F.concat(found, F.array(F.element_at(found, -1) + n))))
    return rows.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), F.flatten(F.zip_with("chunks", "bases", placed)).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The array of (role, text) that a formatted string was made of."""
    parts = F.split(formatted, END)

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, f"^{HEAD}([^\n]*):\n", 1))
        body = F.regexp_replace(block, f"^{HEAD}[^\n]*:\n", "")
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turns))


def loss_text(formatted: Column, loss: str) -> Column:
    """What the loss mask in the column named covers, unescaped; the string is cut once for each chunk of spans, and the spans out of that."""

    def texts(chunk: Column) -> Column:
        start, end = chunk[0]["start"], F.element_at(chunk, -1)["end"]
        part = F.array(F.struct(F.substring(formatted, start + 1, end - start).alias("s"), start.alias("at")))
        return F.flatten(F.transform(part, lambda p: F.transform(chunk, lambda s: unescape(F.substring(p["s"], s["start"] - p["at"] + 1, s["end"] - s["start"])))))

    return F.array_join(F.flatten(F.transform(_chunks(loss), texts)), "")
