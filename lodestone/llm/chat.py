"""Chat formatting of typed content parts, with DataFrame functions only.

A message is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, any other
part becomes its kind's placeholder while its reference, place and expanded token count are recorded. A turn reads
``<|start|>role\\n...<|end|>\\n``. Escaping puts a backslash behind the first character of every control string in a text
(and doubles backslashes), so that no control string of the output stems from a text, and is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>\n"
#: Tokens that an attachment expands to unless its part says otherwise.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
#: Where a control string begins, after its first character: ``<|``, ``<s>``, ``</s>``, ``<<SYS>>``, ``[INST]`` and the closing ones.
_INSIDE = r"(?<=<)(?=\||/?s>|</?SYS>>)|(?<=\[)(?=/?INST\])"
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_INSIDE), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def visit(parts: Column, trained: Column) -> Column:
    """Flatten parts in order into struct(body, spans, attachments); positions count from the start of the body.

    ``spans`` are the escaped text parts under the loss mask; null parts and parts of unknown kind are left out.
    """
    known = [*EXPANDED]
    start = F.expr(
        "named_struct('body', '', 'spans', cast(array() as array<struct<start:bigint,size:bigint>>), "
        "'attachments', cast(array() as array<struct<start:bigint,kind:string,ref:string,tokens:bigint>>))"
    )
    tokens = F.create_map(*(F.lit(x) for pair in EXPANDED.items() for x in pair))

    def step(done: Column, part: Column) -> Column:
        at = F.length(done["body"]).cast("bigint")
        said = escape(F.coalesce(part["text"], F.lit("")))
        size = F.length(said).cast("bigint")
        holder = F.concat(F.lit("<|"), part["kind"], F.lit("|>"))
        span = F.struct(at.alias("start"), size.alias("size"))
        found = F.struct(at.alias("start"), part["kind"].alias("kind"), part["ref"].alias("ref"), F.coalesce(part["tokens"], tokens[part["kind"]].cast("bigint")).alias("tokens"))
        plain = part["kind"] == "text"
        return (
            F.when(plain, F.struct(F.concat(done["body"], said).alias("body"), F.when(trained & (size > 0), F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"), done["attachments"].alias("attachments")))
            .when(part["kind"].isin(known), F.struct(F.concat(done["body"], holder).alias("body"), done["spans"].alias("spans"), F.concat(done["attachments"], F.array(found)).alias("attachments")))
            .otherwise(done)
        )

    return F.aggregate(F.coalesce(parts, F.expr(f"cast(array() as array<{PART}>)")), start, step)


def format_chats(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans, attachments, expanded_tokens, n_turns of every conversation.

    ``messages`` has conv_id, turn, role and ``parts`` (an array of kind, text, ref, tokens; null: no parts). ``spans`` gives
    the places of the text under the loss mask in ``formatted``; ``attachments`` the references in order, with turn, place
    and expanded token count. Turns that tie are ordered by role, then content; a null turn comes first, a null role counts
    as empty, repeated rows are turns of their own, a null conv_id is a conversation. Texts are formatted whole, however long.
    Other columns are not read; an empty table gives an empty result.
    """
    role = F.coalesce("role", F.lit(""))
    trained = role == trained_role
    seen = messages.select("conv_id", "turn", role.alias("role"), visit(F.col("parts"), trained).alias("v"))
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    turns = seen.select("conv_id", "turn", "role", F.length(head).cast("bigint").alias("head"), F.concat(head, F.col("v.body"), F.lit(END)).alias("said"), "v.spans", "v.attachments")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    size = F.length("said").cast("bigint")
    placed = turns.withColumn("no", F.row_number().over(order)).withColumn("at", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.col("head"))
    placed = placed.select(
        "conv_id",
        F.struct(
            "no", "said",
            F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["size"].alias("size"))).alias("spans"),
            F.transform("attachments", lambda a: F.struct(F.col("turn").alias("turn"), (a["start"] + F.col("at")).alias("start"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
        ).alias("t"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join("t.said", "").alias("formatted"),
        F.flatten("t.spans").alias("spans"),
        F.flatten("t.attachments").alias("attachments"),
        F.aggregate(F.flatten("t.attachments"), F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
        F.size("t").cast("bigint").alias("n_turns"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), placeholders left out of the text."""
    def turn(said: Column) -> Column:
        role = F.substring_index(said, "\n", 1)
        body = F.substr(said, F.length(role) + 2, F.length(said) - F.length(role) - F.lit(1 + len(END)))
        holders = F.lit(r"<\|(?:" + "|".join(EXPANDED) + r")\|>")
        return F.struct(F.url_decode(role).alias("role"), unescape(F.regexp_replace(body, holders, F.lit(""))).alias("text"))

    said = F.split(formatted, START.replace("|", r"\|"))
    return F.transform(F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int")))), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text.

    With them n_attachments and expanded_tokens of the attachments that the visitor recorded.
    """
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = chats.select("conv_id", "formatted", "expanded_tokens", F.size("attachments").cast("bigint").alias("n_attachments"), turns.alias("turns"), loss_text(F.col("formatted"), F.col("spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_attachments",
        "expanded_tokens",
    )
