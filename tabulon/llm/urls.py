"""URL verdicts by Bloom filter cascades, with built-in expressions only.

A rule is a key (host and path beginning). A URL's candidate keys are its host and the host's parents, each with
the beginnings of its path of the lengths that rules have. Exact membership of a candidate needs no join: a first
filter holds the listed keys; the second holds the keys of the corpus's whole universe of candidates that pass the
first by mistake; the third the listed keys that pass the second, and so on, until no mistake is left. A key is
listed if the first level that it doesn't pass is an even one. Filters are arrays of 64-bit words in the
expression; level 1 has BITS_PER_KEY bits for each rule, and each further level as many for each key it holds,
which are a small share of the level before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.plans.stage import stage

BITS_PER_KEY = 16
PROBES = 4
#: Words in all filters of one cascade, which travel in the plan; more rules than that need another method.
MOST_WORDS = 1 << 17


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.expr("substring(__u, locate('://', __u) + 3)"))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.expr("substring(__u, locate('://', __u) + 3)"))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that may fit, the longest host first."""
    labels = F.split(host, "\\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fits = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    paths = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def _place(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(bits)).cast("int")


def _passes(key: Column, level: int, words: list[int]) -> Column:
    table, bits = F.lit(words), 64 * len(words)
    out = F.lit(True)
    for probe in range(PROBES):
        at = _place(key, level, probe, bits)
        word = F.get(table, (at / 64).cast("int"))
        out = out & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return out


def _filter(keys: DataFrame, level: int) -> list[int]:
    """The 64-bit words of a filter over the column `key`."""
    bits = 64 * max(1, math.ceil(keys.count() * BITS_PER_KEY / 64))
    places = F.array(*[_place(F.col("key"), level, probe, bits) for probe in range(PROBES)])
    set_words = (
        keys.select(F.explode(places).alias("at"))
        .select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    if bits // 64 > MOST_WORDS:
        raise ValueError("too many rules for filters that travel in the plan")
    words = [0] * (bits // 64)
    for row in set_words.collect():  # at most MOST_WORDS
        words[row["word"]] = row["bits"]
    return words


def cascade(listed: DataFrame, universe: DataFrame) -> list[list[int]]:
    """Filters that tell the listed keys (column `key`) from all others of the universe (column `key`)."""
    ours = listed.select("key").where("key is not null").distinct()
    others = universe.select("key").join(F.broadcast(ours), "key", "left_anti").distinct()
    levels: list[list[int]] = []
    inside, outside = ours, others
    while not inside.isEmpty():
        words = _filter(inside, len(levels))
        if sum(map(len, levels)) + len(words) > MOST_WORDS:
            raise ValueError("too many rules for filters that travel in the plan")
        levels.append(words)
        # what passes by mistake is held by the next level, against what is inside now
        mistaken = stage(outside.where(_passes(F.col("key"), len(levels) - 1, words)))
        inside, outside = mistaken, inside
    return levels


def is_listed(key: Column, levels: list[list[int]]) -> Column:
    """Exact membership for keys of the universe that the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels) - 1, -1, -1):
        out = F.when(_passes(key, level, levels[level]), out).otherwise(F.lit(level % 2 == 1))
    return out


def judge(
    pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and verdict in a struct column `judged`.

    rules: host, path, verdict (allow or block); a key given twice must have one verdict. A rule fits its host and
    all hosts below, if the path starts with the rule's; of two of one length the one with the longer host wins.
    A URL that is null or without "://" has an empty host and path, fits no rule and gets the default, as does
    every URL that fits none. Rows are kept as they come; columns of any name may be there beside.
    """
    plain = rules.select(F.lower("host").alias("host"), "path", "verdict").where("host is not null and path is not null")
    lengths = [r[0] for r in plain.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    df = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__row"), F.col(f"`{url_column}`").alias("__u")
    )
    df = df.select(
        "__row", host_of(F.col("__u")).alias("host"), path_of(F.col("__u")).alias("path")
    ).withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = stage(df.select(F.explode("keys").alias("key")).distinct())
    keyed = plain.select(F.concat("host", "path").alias("key"), "verdict").distinct()
    block = cascade(keyed.where("verdict = 'block'"), universe.union(keyed.select("key")).distinct())
    allow = cascade(keyed.where("verdict = 'allow'"), universe.union(keyed.select("key")).distinct())
    fitting = F.filter(
        "keys", lambda k: is_listed(k, block) | is_listed(k, allow)
    )
    df = df.withColumn("fitting", fitting)
    longest = F.array_max(F.transform("fitting", lambda k, i: F.struct(F.length(k).alias("n"), (-i).alias("at"), k.alias("key"))))
    df = df.withColumn("rule", longest["key"])
    verdict = (
        F.when(F.col("rule").isNull(), default).when(is_listed(F.col("rule"), allow), "allow").otherwise("block")
    )
    return df.select("__row.*", F.struct("host", "path", "rule", verdict.alias("verdict")).alias("judged"))
