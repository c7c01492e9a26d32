r"""Chat formatting with typed content parts (operator 13), DataFrame functions only.

A turn's content is an array of parts (PART): text, or an image, an audio clip or a document
with a reference and its measure. A visitor goes over the parts in order. Text is escaped
and written; every other part leaves the placeholder of its type, and the attachment is
recorded with its ordinal in the conversation, its reference and the tokens that the
placeholder stands for in the model's input:

* image: a token per PATCH x PATCH pixels, partial patches whole, and one per row of patches;
* audio: TOKENS_A_SECOND of each started second;
* document: TOKENS_A_PAGE of each page.

A part of any other type is refused where it is visited. A formatted turn is

    <s>[ROLE] role [/ROLE] content </s>

without the spaces shown. Control strings (CONTROLS: these marks, the placeholders and the
marks of other common templates) are escaped in roles, texts and references: one backslash is
put behind the first character of each, and one more where some stand there already. A control
string has its first character nowhere else, so none overlaps another one, none comes about
where texts and marks meet, and taking one backslash away restores each text.

:func:`format_turns` works turn by turn; :func:`assemble` puts the turns of a conversation
in order and moves the loss spans and attachments to their places in it; :func:`read_back`
restores roles, parts and the text under the loss mask from an assembled row alone. Loss spans
are code points, ends exclusive: the texts of the trained roles, without marks.

A conversation is one row, as a training sample is, and must fit in one (2 GB); the turns of
different conversations are dealt by a hash of the id, and nothing else is gathered. Turns
are ordered by turn (null first), then role, then text; repeated rows stand as often as they
are given. A null text is empty, a null role the empty role, null or empty parts no content;
a null id is a conversation of its own. An empty table gives nothing. Only the columns named
are read, so others clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace

# What opens and closes turns and roles, the placeholders, the marks of other templates.
TURN, ROLE, BODY, END = "<s>", "[ROLE]", "[/ROLE]", "</s>"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROLS = (TURN, END, ROLE, BODY, *PLACEHOLDERS.values(), "[INST]", "[/INST]", "[SYS]", "[/SYS]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: Pixels of a patch's side, tokens of a second and of a page.
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 16, 25, 800
#: Roles whose texts are learned.
TRAINED = ("assistant",)
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_ATTACHMENT = "array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>"
_SPAN = "array<struct<start:bigint,end:bigint>>"
#: An attachment in running text, as :func:`parts_of` finds it: ![caption](address).
INLINE = r"!\[[^\]\n]*\]\([^)\s]+\)"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\[]|/()" else c for c in text)


#: Group 1: the first character; 2: backslashes; 3: the rest of a control string.
_ALL = "([<\\[])(\\\\*)(" + "|".join(_quoted(c[1:]) for c in CONTROLS) + ")"
_ESCAPED = _ALL.replace("(\\\\*)", "\\\\(\\\\*)", 1)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ALL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """One part of type text."""
    return F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))


def parts_of(text: Column) -> Column:
    """The parts of a running text: its inline attachments (INLINE) by the ending of their address, and the text between.

    An address with another ending stays text. ``ref`` is the whole inline form, so nothing of the text is lost.
    """
    whole = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(whole, F.lit(INLINE), F.lit(0))
    between = F.split(whole, INLINE, -1)

    def kind(ref: Column) -> Column:
        last = F.lower(F.regexp_extract(ref, r"\.([A-Za-z0-9]+)\)$", 1))
        return F.when(last.isin("png", "jpg", "jpeg", "gif", "webp"), "image").when(last.isin("mp3", "wav", "ogg", "flac"), "audio").when(last.isin("pdf", "docx", "html", "txt"), "document").otherwise("text")

    def attached(ref: Column) -> Column:
        is_text = kind(ref) == "text"
        return F.struct(kind(ref).alias("type"), F.when(is_text, ref).alias("text"), F.when(~is_text, ref).alias("ref"), *(F.lit(None).cast(t).alias(name) for name, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))

    pairs = F.zip_with(between, found, lambda a, b: F.when(b.isNotNull(), F.array(text_part(a), attached(b))).otherwise(F.array(text_part(a))))
    return F.filter(F.flatten(pairs), lambda p: (p["type"] != "text") | (p["text"] != ""))


def tokens_of(part: Column) -> Column:
    """The tokens that a part's placeholder stands for; unknown measures count as one patch, second or page."""
    across, down = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH), F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    return (
        F.when(part["type"] == "image", across * down + down)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0))) * TOKENS_A_SECOND)
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * TOKENS_A_PAGE)
        .cast("long")
    )


def _visited(part: Column) -> Column:
    """What stands for a part in the formatted turn."""
    mark = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, placeholder in PLACEHOLDERS.items():
        mark = mark.when(part["type"] == kind, placeholder)
    return mark.otherwise(F.raise_error(F.concat(F.lit("no such type of part: "), F.coalesce(part["type"], F.lit("null")))))


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, turn, role, formatted, loss, attachments of each turn; places count from the turn's own start."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.withColumn("pieces", F.transform("parts", _visited)).withColumn("head", F.concat(F.lit(TURN + ROLE), escape(F.col("role")), F.lit(BODY)))
    others = F.transform(F.filter("parts", lambda p: p["type"] != "text"), lambda p, i: F.struct((i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))
    # where the pieces start and end; loss covers the text ones of trained roles
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))
    zipped = F.arrays_zip(F.col("pieces").alias("piece"), F.transform("parts", lambda p: p["type"] == "text").alias("text"))

    def step(held: Column, x: Column) -> Column:
        end = held["at"] + F.length(x["piece"])
        return F.struct(end.alias("at"), F.when(x["text"], F.array_append(held["spans"], F.struct(held["at"].alias("start"), end.alias("end")))).otherwise(held["spans"]).alias("spans"))

    spans = F.when(F.col("role").isin(*trained), F.aggregate(zipped, none, step, lambda held: held["spans"])).otherwise(F.array().cast(_SPAN))
    first = F.length("head").cast("long")
    loss = F.transform(spans, lambda s: F.struct((s["start"] + first).alias("start"), (s["end"] + first).alias("end")))
    return rows.select("conv_id", "turn", "role", F.concat(F.col("head"), F.array_join("pieces", ""), F.lit(END)).alias("formatted"), loss.alias("loss"), others.cast(_ATTACHMENT).alias("attachments"))


def assemble(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss, attachments, placeholder_tokens: one row per conversation, its turns in order."""
    each = F.struct("turn", "role", "formatted", "loss", "attachments")
    rows = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("turns"))
    none = F.struct(F.array().cast("array<struct<at:bigint,files:int>>").alias("places"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("files"))

    def step(held: Column, t: Column) -> Column:
        here = F.struct(held["at"].alias("at"), held["files"].alias("files"))
        return F.struct(F.array_append(held["places"], here).alias("places"), (held["at"] + F.length(t["formatted"])).alias("at"), (held["files"] + F.size(t["attachments"])).alias("files"))

    rows = rows.withColumn("places", F.aggregate("turns", none, step, lambda held: held["places"]))
    loss = F.flatten(F.zip_with("turns", "places", lambda t, at: F.transform(t["loss"], lambda s: F.struct((s["start"] + at["at"]).alias("start"), (s["end"] + at["at"]).alias("end")))))
    files = F.flatten(F.zip_with("turns", "places", lambda t, at: F.transform(t["attachments"], lambda f: F.struct((f["ordinal"] + at["files"]).alias("ordinal"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    rows = rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"), loss.alias("loss"), files.alias("attachments"))
    return rows.withColumn("placeholder_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda held, f: held + f["tokens"]))


def read_back(samples: DataFrame) -> DataFrame:
    """``samples`` with turns and learned, from an assembled row's text, mask and attachments alone.

    ``turns`` has the role and the parts (type, and held: text or reference) of each turn; ``learned``
    the texts under the mask, unescaped.
    """
    place = "|".join(map(_quoted, PLACEHOLDERS.values()))
    opened = F.split("formatted", TURN, -1)  # the first piece is what stands before the first turn: nothing
    body = F.transform(F.slice(opened, 2, F.size(opened)), lambda t: F.substring(t, F.lit(len(ROLE) + 1), F.length(t) - len(ROLE) - len(END)))
    role = lambda t: F.substring_index(t, BODY, 1)
    cut = F.transform(body, lambda t: F.struct(role(t).alias("role"), F.split(F.substring(t, F.length(role(t)) + len(BODY) + 1, F.length(t)), place, -1).alias("texts")))
    rows = samples.withColumn("_cut", cut)
    none = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("files"))

    def count(held: Column, t: Column) -> Column:
        return F.struct(F.array_append(held["before"], held["files"]).alias("before"), (held["files"] + F.size(t["texts"]) - 1).alias("files"))

    rows = rows.withColumn("_before", F.aggregate("_cut", none, count, lambda held: held["before"]))

    def parts(t: Column, before: Column) -> Column:
        texts = F.transform(t["texts"], lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("held")))
        files = F.transform(F.slice(F.col("attachments"), before + 1, F.size(t["texts"]) - 1), lambda f: F.struct(f["type"].alias("type"), f["ref"].alias("held")))
        each = F.flatten(F.zip_with(texts, files, lambda a, b: F.when(b.isNotNull(), F.array(a, b)).otherwise(F.array(a))))
        return F.filter(each, lambda p: (p["type"] != "text") | (p["held"] != ""))

    turns = F.zip_with("_cut", "_before", lambda t, n: F.struct(unescape(t["role"]).alias("role"), parts(t, n).alias("parts")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rows.withColumns({"turns": turns, "learned": learned}).drop("_cut", "_before")


def report(turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns`` (conv_id, turn, role, text): digests of what is read back from the formatted table.

    Inline attachments of a text are parts of their own, but for trained roles: what a model is to write is text.
    """
    text = F.coalesce("text", F.lit(""))
    parts = F.when(F.col("role").isin(*TRAINED), F.array(text_part(text))).otherwise(parts_of(text))
    made = format_turns(turns.select("conv_id", "turn", "role", parts.alias("parts")))
    back = read_back(Workspace(turns.sparkSession, "chat").table(assemble(made), "samples"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(F.transform(t["parts"], lambda p: p["held"]), ""), F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "placeholder_tokens")
