"""Chat formatting over typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document.  A ``Visitor`` has one method for each kind; visiting
a turn flattens its parts, in order, into one body in which each attachment is a placeholder, and records for each
attachment its reference, its own spelling and the tokens it will take.  The k-th placeholder of a turn is its k-th
attachment.  A conversation is the turns' bodies between the template's marks:

    <|turn|>role<|says|>body<|end|>

Control strings inside texts are escaped reversibly: every ``<`` or ``[`` that begins one gets a backslash behind it, also
where backslashes are there already, so taking one away again gives the text back.  The loss mask is a list of spans in code
points of the formatted text, one for each assistant turn; ``read_back`` recovers turns and masked text from the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# What begins a control string: one of the template's marks, a placeholder, or a mark of a common chat template.
CONTROL = r"([<\[])(\\*)(\||/?(?:s|unk|pad)>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?(?:s|unk|pad)>|/?INST\])"
PLACEHOLDER = r"<\|(?:image|audio|document)\|>"

# File name endings by kind of attachment.
ENDINGS = {
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp"],
    "audio": ["wav", "mp3", "flac", "ogg", "m4a"],
    "document": ["pdf", "docx", "pptx", "xlsx", "odt"],
}


def markup(endings: list[str]) -> str:
    """Pattern of an attachment in a text, ``![words](reference.ending)``; no two matches overlap."""
    return r"!\[[^\[\]\n]*\]\(([^()\[\]\x00-\x20]+\.(" + "|".join(endings) + r"))\)"


MARKUP = markup([e for kind in ENDINGS.values() for e in kind])
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


# ---- parts -------------------------------------------------------------------------------------------

def text_parts(text: Column) -> Column:
    """A text's parts: its attachments in Markdown spelling, and the texts before, between and behind them.  Null gives one empty text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    null = F.lit(None)
    texts = F.transform(F.split(whole, F.lit(MARKUP), -1), lambda t: F.struct(
        F.lit("text").alias("kind"), t.alias("text"), null.alias("ref"), null.alias("width"), null.alias("height"), null.alias("seconds"), null.alias("pages")).cast(PART))
    spelt, refs, endings = (F.regexp_extract_all(whole, F.lit(MARKUP), F.lit(i)) for i in range(3))

    def kind(ending: Column) -> Column:
        out = F.lit("document")
        for name in ("audio", "image"):
            out = F.when(ending.isin(ENDINGS[name]), F.lit(name)).otherwise(out)
        return out
    found = F.transform(F.arrays_zip(spelt.alias("s"), refs.alias("r"), endings.alias("e")), lambda z: F.struct(
        kind(z["e"]).alias("kind"), z["s"].alias("text"), z["r"].alias("ref"), null.alias("width"), null.alias("height"), null.alias("seconds"), null.alias("pages")).cast(PART))
    both = F.flatten(F.transform(texts, lambda t, i: F.array_compact(F.array(t, F.get(found, i)))))
    return F.when(F.contains(whole, F.lit("](")), both).otherwise(F.slice(texts, 1, 1))


def json_parts(content: Column) -> Column:
    """Parts from a JSON list of objects {"type", "text", "url", "width", "height", "seconds", "pages"}; what is no such list is one text."""
    schema = "array<struct<type:string,text:string,url:string,width:int,height:int,seconds:double,pages:int>>"
    read = F.from_json(content, schema)
    typed = F.transform(F.array_compact(read), lambda p: F.struct(
        F.coalesce(p["type"], F.lit("text")).alias("kind"), p["text"].alias("text"), p["url"].alias("ref"), p["width"].alias("width"),
        p["height"].alias("height"), p["seconds"].alias("seconds"), p["pages"].alias("pages")).cast(PART))
    good = F.ltrim(content).startswith("[") & read.isNotNull() & F.forall(read, lambda p: p["type"].isNotNull())
    return F.when(good, typed).otherwise(text_parts(content))


class Visitor:
    """What becomes of each kind of part: (body, tokens).  Subclass it for other templates or token counts."""

    tile, tile_tokens = 512, 256           # pixels of an image tile's side, tokens of a tile
    second_tokens, page_tokens = 25, 1024  # tokens of a second of audio, of a document's page

    def text(self, body: Column) -> tuple[Column, Column]:
        """A run of text, unescaped: words count as tokens."""
        return escape(body), F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        across, down = (F.ceil(F.greatest(F.coalesce(part[c], F.lit(1)), F.lit(1)) / self.tile) for c in ("width", "height"))
        return F.lit("<|image|>"), across * down * self.tile_tokens

    def audio(self, part: Column) -> tuple[Column, Column]:
        seconds = F.coalesce(F.nanvl(part["seconds"], F.lit(1.0)), F.lit(1.0))
        return F.lit("<|audio|>"), F.greatest(F.ceil(seconds * self.second_tokens), F.lit(1).cast("long"))

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * F.lit(self.page_tokens).cast("long")

    def attachment(self, part: Column) -> Column:
        """The record of an attachment: kind, ref, source (its spelling in the text, if it has one), body, tokens."""
        body, tokens = F.lit(None).cast("string"), F.lit(None).cast("long")
        for kind in ("image", "audio", "document"):
            b, t = getattr(self, kind)(part)
            body, tokens = F.when(part["kind"] == kind, b).otherwise(body), F.when(part["kind"] == kind, t.cast("long")).otherwise(tokens)
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), part["text"].alias("source"), body.alias("body"), tokens.alias("tokens"))


def flatten_parts(df: DataFrame, parts: str, visitor: Visitor) -> DataFrame:
    """``df`` with body, attachments and tokens of each row's ``parts``.

    Texts that follow each other are joined before they are escaped, so no control string arises at their border.
    """
    attached = F.col("_parts")["kind"]
    no_parts = F.array().cast(f"array<{PART}>")
    rows = df.withColumn("_parts", F.array_compact(F.coalesce(F.col(parts), no_parts)))
    places = F.filter(F.transform(attached, lambda k, i: F.when(k.isin(list(ENDINGS)), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("_bounds", F.concat(F.array(F.lit(0)), places, F.array(F.size("_parts") + 1)))
    run = F.transform(F.sequence(F.lit(1), F.size("_bounds") - 1), lambda j: F.array_join(
        F.transform(F.slice("_parts", F.get("_bounds", j - 1) + 1, F.get("_bounds", j) - F.get("_bounds", j - 1) - 1), lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    rows = rows.withColumns({"_runs": run, "attachments": F.transform(F.filter("_parts", lambda p: p["kind"].isin(list(ENDINGS))), visitor.attachment)})
    body = F.array_join(F.transform("_runs", lambda t, i: F.concat(visitor.text(t)[0], F.coalesce(F.get("attachments", i)["body"], F.lit("")))), "")
    zero = F.lit(0).cast("long")
    tokens = F.aggregate(F.transform("_runs", lambda t: visitor.text(t)[1]), zero, lambda x, n: x + n) + F.aggregate("attachments", zero, lambda x, a: x + a["tokens"])
    return rows.withColumns({"body": body, "tokens": tokens}).drop("_parts", "_bounds", "_runs")


# ---- conversations -----------------------------------------------------------------------------------

def format_chats(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                 visitor: Visitor | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: <key>, formatted, turn_starts, loss_spans, attachments, tokens.

    ``parts`` is an array of part structs (see ``PART``).  Turns stand by ``turn`` (null first), turns of equal number by role
    and content; repeated rows are repeated turns.  A null role is empty, null or missing parts are an empty text, a part of
    unknown kind is its text.  A null key is a conversation of its own.  ``loss_spans`` has an entry for each turn, (start, end)
    in code points of ``formatted`` for the roles in ``learn`` and null for others; ``attachments`` has a list for each turn.
    Other columns of ``turns`` are not looked at.  A conversation is one row of the result, so it must fit in one.
    """
    name = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(F.col(key).cast("long").alias("_conv"), F.col(turn).cast("long").alias("_turn"), name.alias("_role"), F.col(parts).alias("_content"))
    rows = flatten_parts(rows, "_content", visitor or Visitor()).drop("_content")
    head = F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(SAYS))
    rows = rows.select("_conv", "_turn", "_role", "attachments", "tokens", F.length(head).cast("long").alias("_head"), F.length("body").cast("long").alias("_body"),
                       F.concat(head, "body", F.lit(END)).alias("_piece"))
    order = Window.partitionBy("_conv").orderBy(F.asc_nulls_first("_turn"), "_role", "_piece", "attachments")
    before = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumns({"_pos": F.row_number().over(order), "_start": before})
    mask = F.when(F.col("_role").isin(list(learn)), F.struct((F.col("_start") + F.col("_head")).alias("start"), (F.col("_start") + F.col("_head") + F.col("_body")).alias("end")))
    one = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.col("_piece").alias("piece"), F.col("_start").alias("start"), mask.alias("span"), "attachments", "tokens"))).alias("t"))
    return one.select(F.col("_conv").alias(key), F.array_join("t.piece", "").alias("formatted"), F.col("t.start").alias("turn_starts"), F.col("t.span").alias("loss_spans"),
                      F.col("t.attachments").alias("attachments"), F.aggregate("t.tokens", F.lit(0).cast("long"), lambda x, n: x + n).alias("tokens"))


def _restored(body: Column, attachments: Column) -> Column:
    """A body with its placeholders replaced by the attachments' spelling, unescaped."""
    runs = F.split(body, F.lit(PLACEHOLDER), -1)
    return F.array_join(F.transform(runs, lambda t, i: F.concat(unescape(t), F.coalesce(F.get(attachments, i)["source"], F.lit("")))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with turns (role, text) and loss_text, both recovered from ``formatted``, its mask and its attachments.

    Only the formatted text is cut: at the template's marks for turns, at the mask's spans for the text to learn from.
    """
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), F.lit(2), F.greatest(F.size("turn_starts"), F.lit(1)))

    def read(piece: Column, at: Column) -> Column:
        body = F.regexp_replace(F.substring_index(piece, SAYS, -1), F.lit(r"<\|end\|>$"), F.lit(""))
        return F.struct(unescape(F.substring_index(piece, SAYS, 1)).alias("role"), _restored(body, at).alias("text"))

    def learnt(z: Column) -> Column:
        start = z["span"]["start"] - z["start"] - len(TURN) + 1
        masked = F.substring(z["piece"], start.cast("int"), (z["span"]["end"] - z["span"]["start"]).cast("int"))
        return F.when(z["span"].isNull(), F.lit("")).otherwise(_restored(masked, z["at"]))
    cut = chats.withColumn("_cut", F.arrays_zip(pieces.alias("piece"), F.col("turn_starts").alias("start"), F.col("loss_spans").alias("span"), F.col("attachments").alias("at")))
    return cut.withColumns({"turns": F.transform("_cut", lambda z: read(z["piece"], z["at"])), "loss_text": F.array_join(F.transform("_cut", learnt), "")}).drop("_cut")
