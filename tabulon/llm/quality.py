"""Line-first cleaning, with built-in expressions only.

Each line is judged by itself: punctuation, navigation, shouting, boilerplate. Failing lines
are removed, and a document is rejected if what is left has too small a share of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"

#: Fixed phrases of notices, without the first letter, which may be a capital.
BOILERPLATE = (
    "ll rights reserved", "icensed under", "opyright (c)", "\u00a9", "erms of use", "erms of service", "rivacy policy",
    "rivacy Policy", "ookie policy", "ookie settings", "ccept cookies", "ubscribe to our", "ign up for", "lick here",
    "avaScript is", "avaScript must",
)


def _solid(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.array_join(F.split(text, WORD_BREAK), ""))


def _symbols(text: Column) -> Column:
    return F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0)


def _has_phrase(text: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | text.contains(phrase)
    return found


def _count(text: Column, one: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))


def _spaces(line: Column) -> Column:
    return _count(line, " ") + 1


def line_fails(line: Column) -> Column:
    """Whether a line is to be removed. Lines of white space only pass.

    punctuation  symbols are over a tenth of the characters, or there is no letter and no digit
    navigation   two bars or more, and one to every third word
    shouting     two "!!" or more, and one to every third word
    boilerplate  fixed phrases of notices
    """
    return (
        (line.rlike("[#*$%&|<>]") & (10 * _symbols(line) > F.length(line)))
        | (line.contains("|") & (_count(line, "|") >= 2) & (3 * _count(line, "|") >= _spaces(line)))
        | (line.contains("!!") & (_count(line, "!") >= 4) & (3 * _count(line, "!") >= 2 * _spaces(line)))
        | (~line.rlike("[\\p{L}\\p{N}]") & line.rlike("[^\\x20\\x09-\\x0D]"))
        | _has_phrase(line)
    )


def _may_fail(text: Column) -> Column:
    """False only for texts without a line that fails."""
    return (
        text.rlike("[#*$%&|<>]")
        | text.contains("!!")
        | text.rlike("(?:^|\\n)[^\\p{L}\\p{N}\\n]+(?:\\n|$)")
        | _has_phrase(text)
    )


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside 3-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash of their words. Only texts that repeat one get the sort.
    """
    none = F.array().cast("array<bigint>")
    df = df.withColumn(
        "windows",
        F.when(
            F.size("words") >= 3,
            F.slice(
                F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
                F.lit(1),
                F.greatest(F.size("words") - 2, F.lit(0)),
            ),
        ).otherwise(none),
    )
    kind = "array<struct<h: bigint, i: int>>"
    df = df.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast(kind)),
    )
    twice = F.filter(
        "ordered",
        lambda w, k: (w["h"] == F.get("ordered", k - 1)["h"]) | (w["h"] == F.get("ordered", k + 1)["h"]),
    )
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda w: w["i"])))
    steps = F.zip_with(
        "places",
        F.when(F.size("places") > 1, F.slice("places", F.lit(2), F.size("places"))).otherwise(F.array().cast("array<int>")),
        lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
    )
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", total).drop("windows", "ordered", "places")


def assess(docs: DataFrame, text_column: str = "text", max_lost: float = 0.5) -> DataFrame:
    """docs with quality columns in a struct column `quality`: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines_removed, clean_text, kept.

    A null text has no words and fails; rows are kept as they come. Columns of any name may be there
    beside; one named quality is replaced.
    """
    if not 0 <= max_lost <= 1:
        raise ValueError("max_lost is a share")
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"]).alias("row"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("t"),
    )
    inner = F.btrim("t", F.lit(BLANKS))
    df = df.withColumn("words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK)))
    df = _repeat_words(df)
    df = (
        df.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("chars", F.length(F.array_join("words", "")).cast("long"))
        .drop("words")
        .withColumn("lines", F.split("t", "\n"))
        .withColumn("suspect", _may_fail(F.col("t")))
    )
    df = df.withColumn(
        "left", F.when(F.col("suspect"), F.filter("lines", lambda line: ~line_fails(line))).otherwise(F.col("lines"))
    )
    df = df.withColumn("full", F.filter("lines", lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("clean", F.when(F.size("left") < F.size("lines"), F.array_join("left", "\n")).otherwise(F.col("t")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = (F.size("left") < F.size("lines")) & (_solid(F.col("clean")) < (1 - max_lost) * F.col("chars"))
    return df.select(
        "row.*",
        F.struct(
            "n_words",
            F.col("chars").alias("word_chars"),
            _symbols(F.col("t")).cast("long").alias("n_symbols"),
            (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            failed.alias("base_failed"),
            (F.size("lines") - F.size("left")).cast("long").alias("n_lines_removed"),
            F.col("clean").alias("clean_text"),
            # the partition number keeps a filter on the verdict above this projection: pushed below, it would
            # hold all of these expressions nested in each other
            (~failed & ~lost & (F.spark_partition_id() >= 0)).alias("kept"),
        ).alias("quality"),
    )
