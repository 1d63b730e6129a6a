"""Text to number, text to date, and threshold labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import col

# Characters removed before parsing, the accepted number syntax, and the date
# formats tried in order of preference (month before day where both would fit).
FORMATTING = r"[$,%\s]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "M/d/yyyy",
    "d/M/yyyy",
    "M/d/yyyy HH:mm",
    "M/d/yyyy HH:mm:ss",
    "M-d-yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
)
TREND_THRESHOLD_PCT = 2.0


def plain_number(text: Column) -> Column:
    """Parse an undecorated number; anything else, ``1d`` and ``inf`` included, is NULL."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def text_to_number(text: Column) -> Column:
    """Strip currency signs, separators, percent signs and blanks, then parse."""
    return plain_number(F.regexp_replace(text.cast("string"), FORMATTING, ""))


# The text each format letter run stands for.
_LETTERS = {
    "yyyy": r"\d{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}",
    "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}",
    "SSSSSS": r"\d{6}", "SSS": r"\d{3}", "XXX": r"(Z|[+-]\d{2}:\d{2})", "'T'": "T",
}


def date_shape(fmt: str) -> str:
    """Regular expression of the texts a format can match."""
    runs = re.findall(r"'T'|y+|M+|d+|H+|m+|s+|S+|X+|.", fmt)
    return "^" + "".join(_LETTERS.get(run, re.escape(run)) for run in runs) + "$"


def text_to_timestamp(text: Column, fmt: str) -> Column:
    """Parse by one format; texts of another shape never reach the parser, whose failures cost."""
    t = F.trim(text)
    return F.when(t.rlike(date_shape(fmt)), F.try_to_timestamp(t, F.lit(fmt)))


def date_format_rates(df: DataFrame, columns: list[str]) -> dict[str, tuple[str | None, float]]:
    """For each text column, the single format that parses most values and its success rate.

    All formats of all columns are counted in one aggregate over the whole column.
    """
    if not columns:
        return {}
    counts = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    for i, c in enumerate(columns):
        counts += [
            F.count(text_to_timestamp(col(c), fmt)).alias(f"n{i}_{j}")
            for j, fmt in enumerate(DATE_FORMATS)
        ]
    row = df.agg(*counts).first()
    best: dict[str, tuple[str | None, float]] = {}
    for i, c in enumerate(columns):
        hits = [row[f"n{i}_{j}"] for j in range(len(DATE_FORMATS))]
        top = max(hits)
        fmt = DATE_FORMATS[hits.index(top)] if top else None
        best[c] = (fmt, top / row[f"n{i}"] if row[f"n{i}"] else 0.0)
    return best


def trend_label(pct: Column) -> Column:
    return (
        F.when(pct > TREND_THRESHOLD_PCT, "Upward / Growth Trend")
        .when(pct < -TREND_THRESHOLD_PCT, "Downward / Decline Trend")
        .otherwise("Stable / Sideways Trend")
    )


def percent(part: Column, whole: Column) -> Column:
    """Percentage to two places, 0 for an empty whole."""
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def currency_text(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))
