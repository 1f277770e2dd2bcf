"""Expressions that turn messy text into typed values. All are null-safe and never raise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# These lists define the results.
NULL_TOKENS = ("", "NULL", "N/A", "NA", "none", "None", "NaN", "null", "nan")
NULL_TOKENS_WIDE = (*NULL_TOKENS, "n/a", "nil", "undefined")
TRUE_WORDS = ("true", "yes", "1", "y", "on", "t", "enabled")
FALSE_WORDS = ("false", "no", "0", "n", "off", "f", "disabled")
TRUE_SHORT = ("true", "yes", "1", "y")
FALSE_SHORT = ("false", "no", "0", "n")
CURRENCY = "[,$€£¥₹₽₩฿₫]"
TIME_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)

#: What each part of a format takes, at least; texts of another shape aren't parsed, as a failed parse raises inside.
TIME_PARTS = {
    "yyyy": "[+-]?[0-9]{4,}", "MM": "(0[1-9]|1[0-2])", "dd": "(0[1-9]|[12][0-9]|3[01])", "HH": "([01][0-9]|2[0-3])",
    "mm": "[0-5][0-9]", "ss": "[0-5][0-9]", "SSSSSS": "[0-9]+", "'T'": "[Tt]", ".": "[.]",
}

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def null_if_token(c: Column, tokens=NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def parse_number(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_money(c: Column) -> Column:
    """A number with currency signs and thousands commas removed."""
    return parse_number(F.regexp_replace(F.trim(c), CURRENCY, ""))


def parse_boolean(c: Column, true=TRUE_WORDS, false=FALSE_WORDS) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*true), True).when(word.isin(*false), False)


def time_shape(form: str) -> str | None:
    """A pattern that every text of a time format fits; None if the format has parts beyond TIME_PARTS."""
    parts = [m[0] for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", form)]
    if any(p not in TIME_PARTS and p not in "-/: " for p in parts):
        return None
    return "^" + "".join(TIME_PARTS.get(p, p) for p in parts) + "$"


def parse_timestamp(c: Column, formats=TIME_FORMATS) -> Column:
    text = F.trim(c)
    shapes = [time_shape(form) for form in formats]
    tried = [F.try_to_timestamp(text, F.lit(form)) for form in formats]
    found = F.coalesce(*[t if s is None else F.when(text.rlike(s), t) for t, s in zip(tried, shapes)])
    dated = all(s and re.match("[yMd]+[-/][yMd]", form) for form, s in zip(formats, shapes))
    return F.when(text.rlike("^[+-]?[0-9]+[-/][+-]?[0-9]"), found) if dated else found


def contains_any(columns: list[Column], term: str) -> Column:
    """Case-insensitive search of a term in any of the columns; null counts as empty."""
    hits = [F.lower(F.coalesce(c, F.lit(""))).contains(term.lower()) for c in columns]
    return reduce(lambda a, b: a | b, hits)
