r"""Quality rules, line first: every line is judged, failing lines go, and a
document that loses too much of its text goes with them.

A line fails as

* *navigation*: four or more segments cut by ``|``, ``»``, ``›`` or ``•`` that
  have three words or fewer on average;
* *boilerplate*: it names one of PHRASES and has at most 40 words;
* *punctuation*: 12 or more words without any sentence mark or comma, or
  four or more words and more than one symbol (``#*$%&|<>``) for every four of
  them, or eight or more words that have capitals and no small letters, if most
  letters have case at all. Marks are those of any script (MARKS); lines in scripts
  that need none (UNMARKED) do not fail for want of them.

Lines without a word never fail. The document figures are those of the whole
text: words are runs of ``[^\x20\x09-\x0D]``; a document fails the base rule
with under 20 words, or when more than 30 % of its words lie in eight-word
windows found twice or more. It is kept if it passes the base rule and its
passing lines hold at least half of its word characters.

A null text has no words and one empty line. Rows are judged each for itself,
so ties and repeated rows do not matter; null ids pass through.
Everything is Spark expressions on one row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.expr import WHITE_RUN, let, letters_left, words_of
from quarry.llm.store import carried, keyed_text, put_back

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_LEFT = 0.5
SYMBOLS = r"[^#*$%&|<>]+"
MARKS = ".!?…;:,。！？，、；：．｡､‥‼-‽।॥،؛؟۔։՜-՞׃܀-܊߸߹።-፨၊။។៕᠂᠃᠈᠉꓾꓿꘍-꘏꛳-꛷᭞᭟꧈꧉꩝-꩟᱾᱿⳹-⳻⳾"
UNMARKED = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
BARS = ["|", "»", "›", "•"]
PHRASES = ["all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
           "terms of service", "lorem ipsum", "enable javascript", "subscribe to our newsletter"]


def repeated_words(words: Column) -> Column:
    """Words in windows that the text holds twice or more.

    A window is first known by its hash; only a text in which two hashes are
    equal has its windows compared as strings.
    """
    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                              lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("s"), i.alias("at")))
        return let(F.sort_array(windows), lambda s: let(
            F.sort_array(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["s"] == x["s"]) | (F.get(s, i + 1)["s"] == x["s"])),
                                     lambda x: x["at"])), covered))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, s: F.struct(
            (a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n"), (s + WINDOW).alias("end")), lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(words))))


def possible(text: Column, n_symbols: Column) -> Column:
    """Rules that some line of the text can fail, found by plain searches of the whole text."""
    low = F.lower(text)
    return F.struct(
        F.array_contains(F.array(*[F.contains(text, F.lit(b)) for b in BARS]), True).alias("bars"),
        let(low, lambda t: F.array_contains(F.array(*[F.contains(t, F.lit(p)) for p in PHRASES]), True)).alias("phrases"),
        (n_symbols > 0).alias("symbols"))


def line_passes(line: Column, can: Column) -> Column:
    """Whether a line stays (see the module's text); `can` is what `possible` says of its text."""
    n_words = F.size(words_of(line))
    segments = F.size(F.split(line, "[" + "".join(BARS) + "]"))
    navigation = can["bars"] & line.rlike(f"^(?:[^{''.join(BARS)}]*+[{''.join(BARS)}]){{3}}") \
        & (n_words <= segments * 3 + segments - 1)
    boilerplate = can["phrases"] & F.lower(line).rlike("|".join(PHRASES)) & (n_words <= 40)
    symbols = can["symbols"] & (F.length(F.regexp_replace(line, SYMBOLS, "")) * 4 > n_words) & (n_words >= 4)
    bare = ~line.rlike(f"[{MARKS}{UNMARKED}]") & (n_words >= 12)
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n_words >= 8) \
        & (letters_left(line, r"[^\p{Lu}\p{Lt}]+") > letters_left(line, r"[^\p{Lo}\p{Lm}]+"))
    return ~(bare | shouting | navigation | boilerplate | symbols)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its figures, verdicts and the text of its passing lines."""
    t = F.col("text")
    rows = keyed_text(docs, key, text)
    counted = rows.select("doc_id", "text", letters_left(t, SYMBOLS).cast("long").alias("n_symbols"))
    base = counted.select(
        "doc_id", "n_symbols",
        let(words_of(t), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(F.split(t, "\n"), lambda lines: F.struct(
            let(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(possible(t, F.col("n_symbols")), lambda can: F.array_join(
                F.filter(lines, lambda x: line_passes(x, can)), "\n")).alias("clean_text"))).alias("l"))
    left = letters_left(F.col("l.clean_text"), WHITE_RUN).cast("long")
    judged = base.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
                         left.alias("left_chars"), "l.clean_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("left_chars") >= MIN_LEFT * F.col("word_chars")))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without rejected documents, their texts without failing lines; other columns stay.

    A column of lengths `n_chars`, where there is one, follows the text.
    """
    judged = measure(docs.select(carried(docs, text).alias("row"), F.col(f"`{text}`").alias("text")), "row", "text")
    instead = {text: F.col("clean_text")}
    if "n_chars" in docs.columns and text != "n_chars":
        instead["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    back = put_back(docs, "doc_id", **{text: instead[text]})
    return judged.filter("kept").select(*[instead[c].alias(c) if c in instead else b for c, b in zip(docs.columns, back)])
