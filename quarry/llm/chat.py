r"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted by turn; adjacent rows
of one role merge into one message, whose texts stay apart by ``<|turn|>``:

    <|start|>ROLE<|body|>TEXT(<|turn|>TEXT)*<|end|>

Control strings inside texts and roles are escaped: every ``\`` is doubled and a
``\`` is put behind the first character of any string in CONTROLS or of the form
``<|``. So no text can end its message or open another, and removing each ``\``
that stands before a character gives the text back.

The loss mask covers the texts of assistant messages, as spans of code points and
of UTF-8 bytes (a byte span is cut out without counting characters).

Null texts and roles are empty. Rows tie by (turn, role, text); repeated rows are
turns of their own; rows with a null conv_id form one conversation, null turns
come first. An empty table gives no conversation; other columns are ignored. One
output row holds a whole conversation, so its turns meet in one task; they are
collected map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.expr import let

# fixed values: control strings of common chat templates
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "[SYSTEM_PROMPT]",
            "[/SYSTEM_PROMPT]"]
START, BODY, TURN, END = "<|start|>", "<|body|>", "<|turn|>", "<|end|>"
LOSS_ROLE = "assistant"


def _behind_first() -> str:
    rest = "|".join([r"\|", *(c[1:].replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)])
    return rf"([<\[])(?={rest})"


def escape(text: Column) -> Column:
    """`text` with no control string in it."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _behind_first(), r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quote(mark: str) -> str:
    return mark.replace("|", r"\|")


def messages(rows: DataFrame) -> DataFrame:
    """(conv_id, messages): sorted turns, adjacent rows of one role merged, texts escaped."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def merge(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(t) - 1),
                         lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(first, lambda at: F.transform(at, lambda a, i: F.struct(
            F.get(t, a)["role"].alias("role"),
            F.transform(F.slice(t, a + 1, F.coalesce(F.get(at, i + 1), F.size(t)) - a), lambda x: escape(x["text"])).alias("texts"))))
    return turns.select("conv_id", let(F.col("turns"), merge).alias("messages"))


def render(messages_: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): `loss` has the spans under the loss mask."""
    def pieces(m: Column) -> Column:
        """Strings that make up the message; the ones at odd places are its texts."""
        head = F.concat(F.lit(START), escape(m["role"]), F.lit(BODY))
        marked = F.flatten(F.transform(m["texts"], lambda x, i: F.array(F.when(i == 0, head).otherwise(F.lit(TURN)), x)))
        return F.transform(F.concat(marked, F.array(F.lit(END))), lambda s, i: F.struct(
            s.alias("s"), ((i % 2 == 1) & (i < F.size(m["texts"]) * 2) & (m["role"] == LOSS_ROLE)).alias("loss")))

    def spans(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("byte"),
                        F.lit([]).cast("array<struct<start:bigint,length:bigint,byte:bigint,bytes:bigint>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            n, b = F.length(x["s"]).cast("long"), F.octet_length(x["s"]).cast("long")
            one = F.array(F.struct(acc["at"].alias("start"), n.alias("length"), acc["byte"].alias("byte"), b.alias("bytes")))
            return F.struct((acc["at"] + n).alias("at"), (acc["byte"] + b).alias("byte"),
                            F.when(x["loss"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))
        return F.aggregate(p, zero, step, lambda acc: acc["out"])
    both = let(F.flatten(F.transform("messages", pieces)), lambda p: F.struct(
        F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), spans(p).alias("loss")))
    return messages_.select("conv_id", both.alias("r")).select("conv_id", "r.formatted", "r.loss")


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss)."""
    return render(messages(rows))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts): roles and texts read back from the formatted string and its mask."""
    def message(m: Column) -> Column:
        def turns(parts: Column) -> Column:
            return F.transform(F.split(F.get(parts, F.lit(1)), _quote(TURN)), lambda x: F.struct(
                unescape(F.get(parts, F.lit(0))).alias("role"), unescape(x).alias("text")))
        return let(F.split(F.substring(m, F.lit(len(START) + 1), F.length(m)), _quote(BODY)), turns)
    whole = F.filter(F.split("formatted", _quote(END)), lambda m: m != "")
    raw = F.encode("formatted", "UTF-8")
    cut = let(raw, lambda b: F.transform("loss", lambda s: unescape(F.decode(
        F.substring(b, (s["byte"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))))
    return formatted.select("conv_id", F.flatten(F.transform(whole, message)).alias("turns"), cut.alias("loss_texts"), "formatted")
