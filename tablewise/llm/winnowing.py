"""Document fingerprints by winnowing, as column expressions.

Every run of ``gram`` words of a text has a hash, the CRC-32 of the words joined by a space. Of every window of ``window``
consecutive hashes the smallest is chosen, of several the rightmost, and kept with its position. So the chosen hashes depend
on nothing but the words nearby, and two texts that share ``window + gram - 1`` words in a row share a hash, with positions that
tell where. What two texts have in front in common is winnowed once.

Hash and position are held in one whole number whose order is that of the choice: a smaller hash first, then the
later position. The smallest numbers of all windows come from comparing ever longer runs (1, 4, 16, ... hashes). A
long text is cut into stretches of windows that are handled one after the other, so that a row holds its words, a
stretch and the chosen hashes. (Runs of bytes instead of words were exact, too, and took six times the work.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .text import pinned, split_words

#: Words that are hashed together.
GRAM = 3
#: Hashes of which one is chosen.
WINDOW = 4
#: Windows of one stretch.
STRETCH = 1 << 15
#: The last position: positions take 31 bits, more than a value of Spark has bytes.
LAST = (1 << 31) - 1
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS_A_PARTITION = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _smallest(values: Column, window: int, size: int = 1) -> Column:
    """The smallest of ``window`` values from each place on, or of those that are left, given those of ``size``."""
    if size == window:
        return values
    wider = min(4 * size, window)
    steps = dict.fromkeys(min(j * size, wider - size) for j in (1, 2, 3))
    joined = F.transform(values, lambda v, i: F.least(v, *[F.get(values, i + d) for d in steps if d]))
    return _let(joined, lambda x: _smallest(x, window, wider))


def _merged(chosen: Column) -> Column:
    """Neighbouring windows that choose the same hash tell it once."""
    return F.filter(chosen, lambda v, i: ~v.eqNullSafe(F.get(chosen, i - 1)))


def windows_of(n_words: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Windows of a text of ``n_words`` words; a short text is one window."""
    return F.greatest(n_words - (gram + window - 2), F.lit(1))


def choose(words: Column, first: Column, count: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """What the ``count`` windows from word ``first`` on choose, packed, in the order of their positions. No words, none.

    A text of fewer words than ``gram`` is hashed whole; one of fewer hashes than ``window`` is one window.
    """
    if gram < 1 or window < 1:
        raise ValueError("runs and windows have at least one element")

    def stretch(at: Column) -> Column:
        start = first + at * STRETCH
        n = F.least(count - at * STRETCH, F.lit(STRETCH))
        part = F.slice(words, start + 1, n + (window + gram - 2))

        def packed(piece: Column, base: Column) -> Column:
            hashed = lambda i: F.shiftleft(F.crc32(F.array_join(F.slice(piece, i + 1, F.lit(gram)), " ").cast("binary")), 31) + (base - i)
            return F.transform(F.sequence(F.lit(0), F.greatest(F.size(piece) - gram, F.lit(0))), hashed)

        values = _let(part, lambda piece: _let(LAST - start, lambda base: packed(piece, base)))
        return _let(values, lambda x: _let(F.slice(_smallest(x, window), F.lit(1), n), _merged))

    last = F.floor((count - 1) / STRETCH).cast("int")
    every = _let(F.flatten(F.transform(F.sequence(F.lit(0), last), stretch)), _merged)
    return F.when((F.size(words) > 0) & (count > 0), every).otherwise(F.array().cast("array<bigint>"))


def winnow(words: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen hashes of all windows of a text, given its words; packed, in the order of their positions."""
    return choose(words, F.lit(0), windows_of(F.size(words), gram, window), gram, window)


def hashes(packed: Column) -> Column:
    """The distinct hashes of a packed fingerprint."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 31)))


def spans(packed: Column) -> Column:
    """A packed fingerprint as an array of ``(hash, position)``; positions count words from 0."""
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (LAST - x.bitwiseAND(LAST)).alias("position")))


def as_string(packed: Column) -> Column:
    """``hash:position`` by position, comma-joined; hashes as eight hex digits."""
    return F.array_join(F.transform(spans(packed), lambda s: F.format_string("%08x:%d", s["hash"], s["position"])), ",")


def likeness(left: Column, right: Column) -> Column:
    """Twice the shared hashes over all hashes of two sets (0 to 1); 1 for two empty ones."""
    both = F.size(left) + F.size(right)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(left, right)) / both)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``key, fingerprint`` of every row: the chosen ``(hash, position)`` by position.

    Null and empty texts have none; keys may be null or repeat; equal texts have equal fingerprints; an empty table
    gives an empty result; other columns are not looked at.
    """
    rows = pinned(docs.select(key, text), _words=split_words(F.col(text)))
    return pinned(rows, _packed=winnow(F.col("_words"), gram, window)).select(key, spans(F.col("_packed")).alias("fingerprint"))


def shared_spans(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``key, hash, left, right``: where two fingerprints (columns as of ``fingerprints``) of a pair chose the same hash.

    Each position of the left one meets the first on the right. Any ``window + gram - 1`` words that both texts hold show
    here. ``key`` tells pairs apart.
    """
    lefts = pairs.select(key, F.inline(left)).withColumnRenamed("position", "left")
    rights = pairs.select(key, F.inline(right)).groupBy(key, "hash").agg(F.min("position").alias("right"))
    return lefts.join(rights, [key, "hash"])


def _key(key: str) -> Column:
    """Descending keys, null ones last; rows of one key in the order of the table."""
    return F.struct(F.col(key).isNull().alias("none"), F.bitwise_not(F.col(key)).alias("key"), F.monotonically_increasing_id().alias("row"))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key, text`` and the next row's as ``_next``, by descending whole-number key; the last row's is the first's.

    ``made`` adds columns to a row's ``_text``, of which ``_next`` has them, too. Rows are dealt into buckets of neighbours, and the
    first of a bucket also goes to the one before it. ``docs`` is read twice and must give the same rows in the same
    partitions, as a stored table does.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(_key(key).alias("k")).repartitionByRange(BUCKETS_A_PARTITION * partitions, "k")
    starts = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min("k").alias("k"))
    # One row for each bucket.
    bounds = starts.agg(F.array_sort(F.collect_list("k")).alias("bounds"))
    dealt = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), _key(key).alias("_key")).join(F.broadcast(bounds))
    bucket = F.size(F.filter("bounds", lambda b: b <= F.col("_key"))) - 1
    dealt = pinned(dealt, _bucket=bucket)
    is_first = F.get("bounds", F.col("_bucket")) == F.col("_key")
    before = F.pmod(F.col("_bucket") - 1, F.size("bounds"))
    places = F.array(F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("extra")), F.when(is_first, F.struct(before.alias("at"), F.lit(True).alias("extra"))))
    rows = dealt.select(key, "_text", "_key", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("_place"))
    rows = rows.select(key, "_text", "_key", "_place.*").repartitionByRange(partitions, "at")
    own = rows.columns
    rows = made(rows) if made else rows
    added = [c for c in rows.columns if c not in own]
    following = F.lead(F.struct("_text", *added)).over(W.partitionBy("at").orderBy("extra", "_key"))
    return rows.withColumn("_next", following).where(~F.col("extra")).select(key, F.col("_text").alias(text), *added, "_next")


def edited_likeness(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row.

    The edited text has the last ``floor(n_chars / 2)`` characters replaced by the first as many, or all, of the next
    row's text, by descending whole-number key; after the last row comes the first. Returns ``key, n_chars, edited, packed,
    edited_packed`` (texts and packed fingerprints), ``near_edited`` and ``near_next`` (likeness, 0 to 1).

    Null texts are empty. Rows of one key follow each other in the order of the table, those of a null key come last; a
    single row is its own next one; an empty table gives an empty result; other columns are not looked at.
    """
    half = lambda x: F.floor(F.char_length(x) / 2).cast("int")
    head = lambda x: F.substring(x, F.lit(1), F.char_length(x) - half(x))
    both = lambda a, b: _let(F.concat(a, b), _merged)
    after = lambda words, n: choose(words, n, windows_of(F.size(words), gram, window) - n, gram, window)

    def winnowed(rows: DataFrame) -> DataFrame:
        # Windows of the head's words, but its last one, which the cut may change, are those of the edited text, too.
        whole = F.size(split_words(head(F.col("_text")))) - 1
        rows = pinned(rows, _words=split_words(F.col("_text")), _inside=F.greatest(whole - (gram + window - 2), F.lit(0)))
        words, inside = F.col("_words"), F.col("_inside")
        return pinned(rows, _kept=choose(words, F.lit(0), inside, gram, window), _rest=after(words, inside)).drop("_words")

    rows = with_next(docs.select(key, text), text, key, winnowed)
    edited = F.concat(head(F.col(text)), F.substring(F.col("_next._text"), F.lit(1), half(F.col(text))))
    rows = pinned(rows, n_chars=F.char_length(F.col(text)).cast("long"), edited=edited, _packed=both(F.col("_kept"), F.col("_rest")))
    rows = pinned(rows, _words=split_words(F.col("edited")))
    rows = pinned(rows, edited_packed=both(F.col("_kept"), after(F.col("_words"), F.col("_inside"))), _hashes=hashes(F.col("_packed")))
    return rows.select(
        key,
        "n_chars",
        "edited",
        F.col("_packed").alias("packed"),
        "edited_packed",
        likeness(F.col("_hashes"), hashes(F.col("edited_packed"))).alias("near_edited"),
        likeness(F.col("_hashes"), hashes(F.concat("_next._kept", "_next._rest"))).alias("near_next"),
    )
