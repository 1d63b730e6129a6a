"""Expressions on texts shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def split_words(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: equal texts have equal keys. Null has a key of its own."""
    return F.struct(
        F.xxhash64(text, F.lit(1)).alias("hi"), F.xxhash64(F.lit(2), F.length(text), text).alias("lo")
    )


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row.

    A column that a lambda reads is otherwise merged into the lambda and computed for every element.
    Spark does not look through a generator, so the value is taken out of a one-element one.
    """
    held = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.select("*", held.alias("_pinned")).select(
        *df.columns, *[F.col("_pinned")[name].alias(name) for name in columns]
    )
