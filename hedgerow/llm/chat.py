"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is under the loss
mask. A conversation whose last turn is not the assistant's (or that has none) gives one more example that holds all its
turns and trains nothing, so that the output holds every turn.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and texts a control string gets a
backslash after its first character, and a backslash becomes two; `unescape` takes both back, so any text, also one full
of control strings, survives. Everything is DataFrame and SQL work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

#: Control strings that may not appear in a formatted text: those of the template and of other common templates.
CONTROLS = (START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_HEADS = r"([<\[])(?=\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _HEADS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """Examples (conv_id, example, target_turn, formatted, loss_start, loss_end).

    `example` counts from 0 in each conversation; `loss_start` and `loss_end` are code points of `formatted`, end
    exclusive, and null in an example that trains nothing. `target_turn` is the place of its last turn, from 0.

    Null texts and roles are empty; a null turn comes first; turns of one number go by role, then text; repeated rows are
    turns of their own; rows with a null conversation form one. An empty table gives no rows; other columns are ignored.
    A conversation is one training text and has to fit a task; its rows are gathered by conversation in one shuffle.
    """
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    marked = turns.select(
        "conv_id",
        F.struct(
            F.col("row.turn").alias("turn"), F.col("row.role").alias("role"), F.col("row.text").alias("text"),
            F.concat(F.lit(START), escape(F.col("row.role")), F.lit(SEPARATOR), escape(F.col("row.text")), F.lit(END)).alias("shown"),
            F.length(escape(F.col("row.text"))).alias("size"),
        ).alias("row"),
    )
    gathered = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    last = F.size("turns") - 1
    targets = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (F.get(F.col("turns"), i)["role"] == target) | (i == last),
    )
    examples = gathered.select("conv_id", "turns", F.posexplode(targets).alias("example", "target_turn"))
    own = F.get(F.col("turns"), F.col("target_turn"))
    trains = own["role"] == target
    made = examples.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.col("target_turn").cast("long").alias("target_turn"),
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("target_turn") + 1), lambda t: t["shown"]), "").alias("formatted"),
        own["size"].cast("long").alias("size"), trains.alias("trains"),
    )
    end = F.length("formatted").cast("long") - len(END)
    return made.select(
        "conv_id", "example", "target_turn", "formatted",
        F.when(F.col("trains"), end - F.col("size")).alias("loss_start"), F.when(F.col("trains"), end).alias("loss_end"),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """What is under the loss mask, unescaped; null where nothing is."""
    return unescape(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEPARATOR, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, SEPARATOR) + len(SEPARATOR))).alias("text"),
        ),
    )
