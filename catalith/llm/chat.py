r"""Chat formatting with typed content parts.

A message's content is an array of parts (type, text, ref, tokens). The visitor
turns text parts into escaped text and image, audio and document parts into
numbered placeholders, in order, and records each attachment's reference and the
tokens that it expands to. A turn is

    <|turn|>role<|says|>content<|done|>

Inside roles and texts each ``\`` is doubled and then each ``<|`` becomes
``<\|``, so that no text holds a control string and ``unescape`` gives the text
back. The loss mask lists, for each assistant turn, the number of its block and
where its content stands in that block.

Null roles and texts count as empty; rows with equal turn are ordered by role,
then content, and repeated rows are turns of their own. A null conv_id is a
conversation, too. Other columns are passed over; no rows give no rows. A
conversation is one string in its output row, so the longest has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: Tokens that a part expands to where it doesn't say so itself.
PART_TOKENS = {"image": 256, "audio": 128, "document": 1024}


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A content array of one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("tokens"),
        )
    )


def _default_tokens(kind: Column) -> Column:
    out = F.lit(0)
    for name, n in PART_TOKENS.items():
        out = F.when(kind == name, F.lit(n)).otherwise(out)
    return out


def visit_parts(content: Column) -> Column:
    """struct(text, attachments, expanded_tokens) of a content array.

    Placeholders are numbered within the message. Parts of an unknown type are
    placeholders too, so that nothing vanishes silently; signs other than ASCII
    letters, digits, - and _ in its name become _ there, so that none ends the placeholder.
    """
    parts = F.coalesce(content, F.array().cast("array<struct<type:string,text:string,ref:string,tokens:bigint>>"))
    pieces = F.transform(
        parts,
        lambda p, i: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), F.regexp_replace(F.coalesce(p["type"], F.lit("unknown")), "[^A-Za-z0-9_-]", "_"), F.lit(":"), i.cast("string"), F.lit("|>"))
        ),
    )
    others = F.filter(
        F.transform(
            parts,
            lambda p, i: F.struct(
                i.alias("part"),
                p["type"].alias("type"),
                p["ref"].alias("ref"),
                F.coalesce(p["tokens"], _default_tokens(p["type"])).cast("long").alias("tokens"),
            ),
        ),
        lambda a: F.coalesce(a["type"] != "text", F.lit(True)),
    )
    spent = F.aggregate(others, F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return F.struct(F.array_join(pieces, "").alias("text"), others.alias("attachments"), spent.alias("expanded_tokens"))


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) to one row a conversation.

    Columns: conv_id, formatted, loss (array of block number, start and end
    in the block; code points), attachments, expanded_tokens.
    """
    rows = messages.select(
        "conv_id",
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        visit_parts(F.col("content")).alias("said"),
    ).select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.col("role"),
            F.col("said.text").alias("text"),
            F.col("said.attachments").alias("attachments"),
            F.col("said.expanded_tokens").alias("expanded"),
        ).alias("m"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("_turns"))
    chats = chats.withColumn(
        "_blocks",
        F.transform(
            "_turns",
            lambda m: F.struct(
                F.concat(F.lit(TURN), escape(m["role"]), F.lit(SAYS), m["text"], F.lit(DONE)).alias("block"),
                (F.length(escape(m["role"])) + len(TURN) + len(SAYS)).alias("start"),
                (F.length(escape(m["role"])) + len(TURN) + len(SAYS) + F.length(m["text"])).alias("end"),
                (m["role"] == "assistant").alias("learn"),
            ),
        ),
    )
    return chats.select(
        "conv_id",
        F.array_join(F.transform("_blocks", lambda b: b["block"]), "").alias("formatted"),
        F.filter(
            F.transform(
                "_blocks",
                lambda b, i: F.struct(
                    i.alias("block"), b["start"].alias("start"), b["end"].alias("end"), b["learn"].alias("learn")
                ),
            ),
            lambda x: x["learn"],
        ).alias("loss"),
        F.flatten(
            F.transform(
                "_turns",
                lambda m, i: F.transform(
                    m["attachments"],
                    lambda a: F.struct(
                        i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")
                    ),
                ),
            )
        ).alias("attachments"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda n, m: n + m["expanded"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: the turns (role, text), and the texts under the loss mask."""
    blocks = formatted.withColumn("_blocks", F.filter(F.split("formatted", r"(?=<\|turn\|>)"), lambda b: b != ""))
    inner = blocks.withColumn(
        "_pairs",
        F.transform("_blocks", lambda b: F.split(F.substring(b, F.lit(len(TURN) + 1), F.length(b) - len(TURN + DONE)), r"<\|says\|>", 2)),
    )
    return inner.withColumn(
        "turns",
        F.transform(
            "_pairs",
            lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")),
        ),
    ).withColumn(
        "loss_texts",
        F.transform(
            "loss",
            lambda x: unescape(F.substring(F.get("_blocks", x["block"]), x["start"] + 1, x["end"] - x["start"])),
        ),
    )


def op5_chat(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    spark = conversations.sparkSession
    said = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(own)
    messages = rows.select("conv_id", "turn", "role", text_part(F.coalesce(F.col("text"), F.lit(""))).alias("content"))
    back = read_back(format_chats(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
