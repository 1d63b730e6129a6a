"""Quality rules: a log-likelihood ratio between trusted and raw n-grams, and plain counts.

Every text becomes a bag of hashed 1-grams and 2-grams. Two multinomials over the hash buckets are
fitted: one on trusted documents, one on the whole corpus. A document's score is the sum of the
log ratios of its n-grams, divided by their number, and every document is compared with a fixed
threshold. The ratios are whole numbers (``SCALE`` units), so that sums do not depend on the order
in which partitions are added up.

The trusted documents are labelled rows. Their number is bounded by ``trusted_rows``: the rows with
the smallest hashes of their ids are taken. Everything else reads all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import BLANKS, pinned, split_words

#: Buckets of the hashed n-grams. The table of ratios has this many rows whatever the corpus.
BUCKETS = 1 << 14
#: Labelled documents that the trusted multinomial is fitted on, at most.
TRUSTED_ROWS = 20_000
#: Units of a ratio.
SCALE = 1 << 20
#: Mean log ratio (nats per n-gram) from which a document is kept.
THRESHOLD = -0.1
#: Pseudo-count of every bucket in both multinomials.
PRIOR = 1.0
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``words`` and the counts ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    * ``word_chars``: code points in words; ``n_symbols``: characters of ``#*$%&|<>``;
    * ``n_dup_lines``: lines with a word that equal an earlier line;
    * ``n_repeat_words``: words inside a window of three words that the text has at least twice.

    A null text counts as empty: no words, all counts 0. Columns of ``docs`` with these names are replaced.
    """
    added = ["words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = docs.drop(*added)
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = pinned(base, words=split_words(F.col(text)), _lines=lines)
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    df = pinned(
        df,
        _hashes=F.expr(
            "slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0))"
        ),
    )
    # Only texts that have some window twice are looked at more closely. Sorted with their positions, equal neighbours
    # are windows found twice.
    df = pinned(
        df,
        _sorted=F.expr(
            "CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN CAST(array() AS ARRAY<STRUCT<h: BIGINT, i: INT>>)"
            " ELSE sort_array(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i))) END"
        ),
    )
    df = pinned(
        df,
        _found=F.expr(
            "array_sort(transform(filter(_sorted, (x, k) -> x.h <=> get(_sorted, k + 1).h OR x.h <=> get(_sorted, k - 1).h), x -> x.i))"
        ),
    )
    covered = F.expr("aggregate(transform(_found, (p, k) -> least(3L, coalesce(CAST(get(_found, k + 1) - p AS BIGINT), 3L))), 0L, (a, x) -> a + x)")
    return df.withColumn("n_repeat_words", covered).drop("_lines", "_hashes", "_sorted", "_found")


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _pairs(words: str) -> Column:
    """Each word with the one after it; the last word's is null."""
    return F.arrays_zip(F.col(words).alias("first"), F.expr(f"slice({words}, 2, greatest(size({words}), 1))").alias("second"))


def trusted_ids(labels: DataFrame, trusted_rows: int = TRUSTED_ROWS, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Ids of at most ``trusted_rows`` labelled good documents: those whose hashes are smallest."""
    good = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct()
    return good.orderBy(F.xxhash64(key), key).limit(trusted_rows)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row with ``ratios``: for each bucket the scaled log of trusted over raw probability.

    Without a trusted document every ratio is 0: such a model tells nothing.
    """
    marked = docs.select(key, text).join(F.broadcast(trusted.select(key, F.lit(1).alias("_trusted"))), key, "left")
    pairs = pinned(marked, words=split_words(F.col(text))).select("_trusted", F.inline(_pairs("words")))
    # Both n-grams of a position are counted by one aggregate of a fixed number of groups.
    grams = pairs.select(
        "_trusted",
        F.explode(F.array(_bucket(F.col("first")), F.when(F.col("second").isNotNull(), _bucket(F.col("first"), F.col("second"))))).alias("bucket"),
    ).where(F.col("bucket").isNotNull())
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("good"))
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").fillna(0, ["raw", "good"])
    totals = filled.agg(
        F.sum("raw").alias("all_raw"),
        F.sum("good").alias("all_good"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("counts"),
    )
    prior = F.lit(PRIOR)
    return totals.select(
        F.transform(
            "counts",
            lambda c: F.when(F.col("all_good") == 0, F.lit(0)).otherwise(
                F.round(
                    SCALE
                    * (
                        F.log((c["good"] + prior) / (F.col("all_good") + prior * BUCKETS))
                        - F.log((c["raw"] + prior) / (F.col("all_raw") + prior * BUCKETS))
                    )
                )
            ).cast("long"),
        ).alias("ratios")
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    threshold: float = THRESHOLD,
    trusted_rows: int = TRUSTED_ROWS,
    row: str | None = None,
) -> DataFrame:
    """Counts, log-likelihood score and verdict of every document.

    Returns ``key`` (and ``row``, a column that is carried along, if named), the counts of ``text_counts``, ``base_failed`` (fewer than 50 words, or more than half of
    them repeated), ``llr`` (mean log ratio in nats, 0 without words) and ``kept`` (not ``base_failed``, and
    ``llr`` at or above ``threshold``). Null texts fail as empty ones do; repeated rows are judged alike; a
    null key never is trusted; an empty table gives an empty result; other columns are not looked at.
    """
    ratios = bucket_ratios(docs, trusted_ids(labels, trusted_rows, key), text, key).scalar()
    carried = [key, row] if row else [key]
    counted = text_counts(docs.select(*carried, text), text)
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    numbered = counted.select(F.monotonically_increasing_id().alias("_number"), *carried, *stats, "words")
    words = numbered.select("_number", *carried, *stats, F.inline_outer(_pairs("words")))
    ratio = lambda *w: F.element_at(F.col("_ratios"), _bucket(*w) + 1)
    valued = words.withColumn("_ratios", ratios).select(
        "_number",
        *carried,
        *stats,
        (
            F.when(F.col("first").isNotNull(), ratio(F.col("first"))).otherwise(0)
            + F.when(F.col("second").isNotNull(), ratio(F.col("first"), F.col("second"))).otherwise(0)
        ).alias("_units"),
    )
    summed = valued.groupBy("_number", *carried, *stats).agg(F.sum("_units").alias("_units"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return summed.select(
        *carried,
        *stats,
        failed.alias("base_failed"),
        (F.col("_units") / (grams * SCALE)).alias("llr"),
        (~failed & (F.col("_units") >= F.round(F.lit(threshold) * SCALE * grams).cast("long"))).alias("kept"),
    )
