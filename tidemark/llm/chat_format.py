"""Chat formatting: typed content parts flattened to one training string, with DataFrame operations only.

A turn's content is a list of typed parts (text, image, audio, document). Visiting them in order, a text
is escaped and any other part becomes the placeholder of its type, recorded as an attachment with its
reference and the tokens that it expands to. Turns are marked `<|im_start|>role`, newline, content,
`<|im_end|>`, newline. Every control string begins with `<|`, which no escaped text holds:
a backslash is written `\\-`, the bar of `<|` and a bar that begins a part `\\|`, and a newline in a role `\\n`.
The loss mask lists the contents of assistant turns as (turn, base, start, end): code points in the whole
string, base being where the turn begins.

Defined results: a null text is empty, a null role too; a conversation without rows doesn't exist, so an
empty table gives no rows; turns are ordered by turn, then role and text as given, so ties and repeated rows have
one order; very long texts stay whole, and a conversation is one string, so one of more than 2 GB fails; a null conv_id is a conversation of its own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, let

START, END = "<|im_start|>", "<|im_end|>\n"
#: Placeholder of each type that isn't text; what has no type of these is a document.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a part expands to where it doesn't say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:long>>"


def escaped(text: Column) -> Column:
    inner = F.replace(F.replace(text, F.lit("\\"), F.lit("\\-")), F.lit("<|"), F.lit("<\\|"))
    return F.when(inner.startswith("|"), F.concat(F.lit("\\"), inner)).otherwise(inner)


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")), F.lit("\\-"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _by_type(kind: Column, values: dict, other) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(kind == k, F.lit(v))
    return out.otherwise(F.lit(other))


def formatted(turns: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, parts to rows conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens."""
    visit = lambda p: F.when(p.type == "text", escaped(F.coalesce(p.text, F.lit("")))).otherwise(_by_type(p.type, PLACEHOLDERS, PLACEHOLDERS["document"]))
    plain = lambda p: F.when(p.type == "text", F.coalesce(p.text, F.lit(""))).otherwise(F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    attached = F.transform(F.filter(F.col("parts"), lambda p: F.coalesce(p.type, F.lit("document")) != "text"), lambda p: F.struct(
        F.coalesce(p.type, F.lit("document")).alias("type"), p.ref.alias("ref"), F.coalesce(p.tokens, _by_type(p.type, DEFAULT_TOKENS, DEFAULT_TOKENS["document"]).cast("long")).alias("tokens")))
    rows = turns.select(
        "conv_id", F.col("turn").alias(f"{P}turn"), role.alias(f"{P}role"), attached.alias(f"{P}attached"),
        F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias(f"{P}head"),
        F.array_join(F.transform(F.col("parts"), plain), "").alias(f"{P}plain"), F.array_join(F.transform(F.col("parts"), visit), "").alias(f"{P}body"))
    rows = rows.select("*", F.concat(f"{P}head", f"{P}body", F.lit(END)).alias(f"{P}said"), F.char_length(f"{P}head").alias(f"{P}h"), F.char_length(f"{P}body").alias(f"{P}b"))
    w = Window.partitionBy("conv_id").orderBy(f"{P}turn", f"{P}role", f"{P}plain", f"{P}body")
    length = F.char_length(f"{P}said").cast("long")
    rows = rows.select("*", (F.row_number().over(w) - 1).alias(f"{P}n"), (F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - length).alias(f"{P}base"))
    span = F.when(F.col(f"{P}role") == "assistant", F.struct(
        F.col(f"{P}n").alias("turn"), F.col(f"{P}base").alias("base"), (F.col(f"{P}base") + F.col(f"{P}h")).alias("start"), (F.col(f"{P}base") + F.col(f"{P}h") + F.col(f"{P}b")).alias("end")))
    grouped = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct(F.col(f"{P}n"), F.col(f"{P}said"), F.col(f"{P}attached")))).alias(f"{P}all"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"))
    attachments = F.flatten(F.transform(F.col(f"{P}all"), lambda x: x[f"{P}attached"]))
    return grouped.select(
        "conv_id", "n_turns", F.array_join(F.transform(F.col(f"{P}all"), lambda x: x[f"{P}said"]), "").alias("formatted"), "loss_spans", attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("expanded_tokens"))


def parsed(output: DataFrame) -> DataFrame:
    """From formatted strings and loss masks alone: conv_id, turns (role and unescaped text) and loss, each masked text unescaped."""
    pieces = F.split(F.col("formatted"), r"(?<=<\|im_end\|>\n)")
    pieces = F.filter(pieces, lambda x: x != "")
    body_at = lambda x: F.locate("\n", x) + 1
    read = lambda x: F.struct(
        unescaped(F.substring(x, F.lit(len(START) + 1), body_at(x) - len(START) - 2)).alias("role"),
        unescaped(F.substring(x, body_at(x), F.char_length(x) - body_at(x) + 1 - len(END))).alias("text"))
    loss = let(pieces, lambda all_: F.transform(F.col("loss_spans"), lambda s: unescaped(F.substring(F.get(all_, s.turn), (s.start - s.base + 1).cast("int"), (s.end - s.start).cast("int")))))
    return output.select("conv_id", "formatted", F.transform(pieces, read).alias("turns"), loss.alias("loss"))


def digested(output: DataFrame) -> DataFrame:
    """Columns of the contract, read back from the output."""
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.col("loss"), "")
    return parsed(output).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
