"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is ``### role:``, a line break, its body and ``</turn>`` with a line break. A visitor flattens the body's parts in order: text as
it is, image, audio and document parts as placeholders ``<|image:1|>``, numbered through the conversation, whose references and
expanded token counts are recorded beside. All control strings hold ``#`` or ``<``, so inside texts these, and the escape sign
itself, are written ``\\h``, ``\\l`` and ``\\b`` (and ``:`` in roles ``\\c``); no text can look like a control string, and reading it back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Tokens of a part that doesn't say how many it stands for.
EXPANDED = {"image": 256, "audio": 512, "document": 1024}
PARTS = "array<struct<type: string, text: string, ref: string, tokens: long>>"


def escaped(text: Column, codes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for sign, code in codes:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column, codes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Codes are undone in reverse, the escape sign's own last."""
    for sign, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def text_parts(text: str = "text") -> Column:
    """One text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("tokens")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _kind(part: Column) -> Column:
    """A type that isn't known counts as a document."""
    return F.when(part["type"].isin("image", "audio"), part["type"]).otherwise("document")


def format_chat(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, parts).

    formatted; turns, in order: (start, loss_start, loss_end) in characters of ``formatted`` (a loss span is empty for roles
    that aren't trained); attachments: (number, type, ref, tokens); n_tokens: words of texts and expanded tokens of parts.
    Turns go by turn (nulls first), role and parts. Null roles and texts are empty, null parts are none, a null part is left out, a null conv_id
    is a conversation of its own, and repeated rows are turns of their own. An empty table gives an empty one.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array()).cast(PARTS), lambda p: p.isNotNull())
    role = F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    rows = rows.withColumn("number", F.row_number().over(order))
    attached = F.size(F.filter("parts", lambda p: ~_is_text(p)))
    rows = rows.withColumn("earlier", F.coalesce(F.sum(attached).over(before), F.lit(0)))

    def place(part: Column, index: Column) -> Column:
        """Number of an attachment: those of earlier turns, and of this turn up to this part."""
        return F.col("earlier") + F.size(F.filter(F.slice(F.col("parts"), F.lit(1), index + 1), lambda p: ~_is_text(p)))

    def visit(part: Column, index: Column) -> Column:
        mark = F.concat(F.lit("<|"), _kind(part), F.lit(":"), place(part, index).cast("string"), F.lit("|>"))
        return F.when(_is_text(part), escaped(F.coalesce(part["text"], F.lit("")))).otherwise(mark)

    def tokens(part: Column) -> Column:
        default = F.lit(EXPANDED["document"])
        for kind in ("image", "audio"):
            default = F.when(part["type"] == kind, F.lit(EXPANDED[kind])).otherwise(default)
        return F.coalesce(part["tokens"], default.cast("long"))

    words = F.transform("parts", lambda p: F.when(_is_text(p), F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit(r"\S+")).cast("long")).otherwise(tokens(p)))
    references = F.transform("parts", lambda p, i: F.when(~_is_text(p), F.struct(place(p, i).cast("int").alias("number"), _kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens"))))
    rows = rows.withColumns({
        "head": F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE)),
        "body": F.array_join(F.transform("parts", visit), ""),
        "attachments": F.filter(references, lambda a: a.isNotNull()),
        "tokens": F.aggregate(words, F.lit(0).cast("long"), lambda a, n: a + n),
    })
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)).cast("long"))
    loss_start = F.col("start") + F.length("head")
    loss_end = F.when(F.col("role").isin(*trained), loss_start + F.length("body")).otherwise(loss_start)
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "piece", "start", loss_start.alias("loss_start"), loss_end.alias("loss_end"), "attachments"))).alias("all"),
        F.sum("tokens").alias("n_tokens"),
    )
    return whole.select(
        "conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.transform("all", lambda t: F.struct(t["start"].alias("start"), t["loss_start"].alias("loss_start"), t["loss_end"].alias("loss_end"))).alias("turns"),
        F.flatten(F.col("all.attachments")).alias("attachments"), "n_tokens",
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Adds to formatted conversations what is read back from them: ``read``, an array of (role, text), and ``loss``, the text under the mask.

    Placeholders stay in the texts. Each turn's loss span is cut from that turn's piece, so the work grows with the length only.
    """
    # The text after the last mark of an end is empty.
    pieces = F.split("formatted", CLOSE, -1)
    rows = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    head = F.length(F.lit(OPEN))
    turn = F.transform("pieces", lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, head + 1, F.length(p)), MIDDLE, 1), ROLE_ESCAPES).alias("role"),
        unescaped(F.substring(p, _after(p), F.length(p))).alias("text"),
    ))
    masked = F.zip_with("pieces", "turns", lambda p, t: unescaped(F.substring(p, (t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int"))))
    return rows.withColumn("read", turn).withColumn("loss", F.array_join(masked, "")).drop("pieces")


def _after(piece: Column) -> Column:
    """Place of the first character of the body."""
    return F.position(F.lit(MIDDLE), piece) + len(MIDDLE)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from what is read back."""
    rows = read_chat(formatted)
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
