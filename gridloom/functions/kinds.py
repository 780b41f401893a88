"""Value kinds of printed cells, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import met

# The kind vocabulary, the currency marks, the patterns of printed values.
KINDS = ("text", "numeric", "symbol", "amount", "percent", "date", "other")
NUMBER_KINDS = ("numeric", "amount", "percent")
VALUE_KINDS = (*NUMBER_KINDS, "symbol", "date")
CURRENCY = "$€£¥₩₹฿"
PERCENT = r"^[-+(]?\s*\d[\d,]*\.?\d*\s*%\)?$"
DATE_DIGITS = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
DATE_WORDS = r"(?i)^\d{1,2}[-\s](jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*([-\s,]*\d{2,4})?$"
GROUPED = r"^\(?[-+]?\s*\d{1,3}(,\d{3})+(\.\d+)?\)?$"
PARENTHESES = r"^\(\s*[-+]?\d[\d,]*\.?\d*\s*\)$"
NUMERIC = r"^[-+]?\d+(\.\d+)?$"
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def norm(text: Column) -> Column:
    """White space of any script collapsed to single spaces, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    return F.lower(norm(text))


def kind_of(text: Column) -> Column:
    """The most specific kind of a printed value; blanks and nulls are 'other'."""
    s = norm(F.coalesce(text, F.lit("")))
    tests = (
        (s == "", "other"),
        (s.contains("%") & s.rlike(PERCENT), "percent"),
        (s.rlike(DATE_DIGITS) | s.rlike(DATE_WORDS), "date"),
        (s.rlike(f"[{CURRENCY}]") | s.rlike(GROUPED) | s.rlike(PARENTHESES), "amount"),
        (s.rlike(NUMERIC), "numeric"),
        ((F.length(s) == 1) | ((F.length(s) <= 2) & ~s.rlike(r"\d")), "symbol"),
    )
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit("text"))


#: White space of any script, as (?U)\\s has it, and the patterns above where only ASCII digits and letters count.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PERCENT, _DATE_DIGITS, _DATE_WORDS, _AMOUNT, _NUMERIC = (re.compile(p, re.ASCII) for p in (PERCENT, DATE_DIGITS, DATE_WORDS, f"[{CURRENCY}]|{GROUPED}|{PARENTHESES}", NUMERIC))
_MARKED = re.compile(f"[0-9{CURRENCY}]")


def kind_of_text(text: str) -> str:
    """kind_of() of one value, outside of the engine."""
    s = _SPACE.sub(" ", text).strip(" ")
    if not s:
        return "other"
    # Two short ways: no other pattern fits a bare number, and none but a currency mark fits a text without digits.
    if _NUMERIC.search(s):
        return "numeric"
    if not _MARKED.search(s):
        return "symbol" if len(s) <= 2 else "text"
    if "%" in s and _PERCENT.search(s):
        return "percent"
    if _DATE_DIGITS.search(s) or _DATE_WORDS.search(s):
        return "date"
    if _AMOUNT.search(s):
        return "amount"
    return "symbol" if len(s) == 1 or (len(s) == 2 and not re.search("[0-9]", s)) else "text"


def kinds_of(texts: pa.Array) -> np.ndarray:
    """Of each text the place of its kind in KINDS; equal texts are looked at once."""
    found = texts.fill_null("").dictionary_encode()
    return np.array([KINDS.index(kind_of_text(t)) for t in found.dictionary.to_pylist()], np.int8)[np.asarray(found.indices)]


def accepts(kind: Column, text: Column) -> Column:
    """Whether a column of a kind may hold a value; a blank fits everywhere."""
    seen = kind_of(text)
    fits = (
        F.when(kind.isin("text", "other"), True)
        .when(kind.isin(*NUMBER_KINDS), seen.isin(*NUMBER_KINDS))
        .when(kind == "symbol", seen == "symbol")
        .when(kind == "date", seen.isin("date", "numeric"))
        .otherwise(True)
    )
    return (norm(F.coalesce(text, F.lit(""))) == "") | fits


def number(text: Column) -> Column:
    """The value of a printed number: currency, grouping and a percent mark dropped, parentheses
    negative; null for anything else."""
    s = norm(text)
    negative = s.startswith("(") & s.endswith(")")
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, r"^[()]+|[()]+$", "")), f"[{CURRENCY},%]", ""))
    value = F.when(bare.rlike(FLOAT), bare.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def plurality(df: DataFrame, group: list[str], value: str, order: str, out: str) -> DataFrame:
    """(group, out): each group's most frequent value; of equals the one seen first by order."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(out))


def induced(df: DataFrame, group: list[str], text: str, order: str, out: str = "kind") -> DataFrame:
    """(group, out): the kind of a column by plurality over its non-blank values, 'other' if none."""
    values = df.where(norm(F.col(text)) != "").withColumn("_kind", kind_of(F.col(text)))
    found = plurality(values, group, "_kind", order, out)
    return met(df.select(*group).distinct(), found, group, "left").withColumn(out, F.coalesce(out, F.lit("other")))
