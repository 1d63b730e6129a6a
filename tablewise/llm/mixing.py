"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` documents in an order given by a hash. A source of weight w
(a whole number of blocks out of ``PERIOD``) is due w / PERIOD blocks a slot: its k-th block is released at
floor((k - 1) * PERIOD / w) and due by ceil(k * PERIOD / w). Each slot takes, of the blocks released, the one with the
earliest deadline. With weights that add up to the period every block meets its window, so at no slot a source
is a whole block ahead of or behind its share.

After a period all sources are exactly at their shares and the pattern starts again. So the schedule is that of one
period, whatever the number of documents: it is built by an aggregate over its slots, and each block finds its
slot by its number modulo the source's blocks a period. Slots of sources that have run out are left out, which
keeps the others' proportions. Positions follow from the numbers of rows by arithmetic: no global sort, no
window over a source or over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.staging import stage_table

#: Slots after which the schedule repeats: the resolution of weights.
PERIOD = 1_000
#: Documents of a block.
BLOCK_ROWS = 8
#: Weights follow the sources' sizes to this power, if none are given: 1 is proportional, 0 is uniform.
TEMPERATURE = 0.7
#: Rows that one window orders, about.
WINDOW_ROWS = 20_000


def source_weights(docs: DataFrame, source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """``(source, weight)`` by the number of rows of each source; the null source is one of them."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("source", F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("weight"))


def period_shares(sizes: DataFrame, weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """``(source, n, number, share, period)`` for ``sizes (source, n)``: whole blocks a period by largest remainders.

    Every source has at least one block, also one without weight or with none above 0; weights count in millionths. The
    period is lengthened where there are more than half as many sources as slots. Sources are numbered by name.
    The windows see one row a source.
    """
    every = W.partitionBy(F.lit(0))
    known = weights.select(F.col("source").alias("_source"), F.greatest(F.round(F.col("weight") * 1e6), F.lit(0)).cast("decimal(20,0)").alias("weight"))
    sized = (
        sizes.join(known, sizes["source"].eqNullSafe(known["_source"]), "left")
        .select("source", "n", F.coalesce("weight", F.lit(0).cast("decimal(20,0)")).alias("weight"))
        .withColumn("_sources", F.count(F.lit(1)).over(every))
        .withColumn("period", F.greatest(F.lit(period).cast("long"), 2 * F.col("_sources")))
        .withColumn("_rest", F.col("period") - F.col("_sources"))
        .withColumn("_sum", F.greatest(F.sum("weight").over(every), F.lit(1).cast("decimal(20,0)")))
    )
    dealt = sized.withColumn("_floor", F.expr("CAST((_rest * weight) div _sum AS BIGINT)")).withColumn("_left", F.expr("(_rest * weight) % _sum"))
    order = every.orderBy(F.desc("_left"), F.asc_nulls_first("source"))
    extra = (F.row_number().over(order) <= F.col("_rest") - F.sum("_floor").over(every)).cast("long")
    number = F.row_number().over(every.orderBy(F.asc_nulls_first("source"))) - 1
    return dealt.select("source", "n", number.cast("int").alias("number"), (1 + F.col("_floor") + extra).alias("share"), "period")


def period_schedule(shares: DataFrame) -> DataFrame:
    """``(number, turn, slot, release, deadline, before)``: where each source's blocks (turns from 0) stand in one period.

    An aggregate over the slots of the period takes the released block with the earliest deadline; ties go to the lower
    number. ``before`` has, for each source, its blocks in earlier slots of the period.
    """
    one = shares.agg(
        F.sort_array(F.collect_list(F.struct("number", "share"))).alias("s"), F.max("period").alias("period")
    )
    # For each source that has a block released: when it is due, and the source.
    ready = """transform(
        filter(s, x -> a.had[x.number] < x.share AND (a.had[x.number] * period) div x.share <= t),
        x -> named_struct('due', ((a.had[x.number] + 1) * period + x.share - 1) div x.share, 'number', x.number))"""
    slots = one.selectExpr(
        "s",
        "period",
        f"""explode(aggregate(
            sequence(0L, period - 1),
            named_struct('had', transform(s, x -> 0L), 'log', CAST(array() AS ARRAY<STRUCT<slot: BIGINT, number: INT, before: ARRAY<BIGINT>>>)),
            (a, t) -> transform(array(array_min({ready}).number), n -> named_struct(
                'had', transform(a.had, (h, i) -> IF(i = n, h + 1, h)),
                'log', a.log || array(named_struct('slot', t, 'number', n, 'before', a.had))))[0],
            a -> a.log)) AS one""",
    )
    return slots.selectExpr(
        "one.number AS number",
        "one.before[one.number] AS turn",
        "one.slot AS slot",
        "(one.before[one.number] * period) div s[one.number].share AS release",
        "((one.before[one.number] + 1) * period + s[one.number].share - 1) div s[one.number].share AS deadline",
        "one.before AS before",
    )


def shuffle_number(docs: DataFrame, key: str) -> Column:
    """A number below 2^32 that puts the rows in a mixed order: from a whole-number key by a multiplicative hash."""
    if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        mixed = F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(1 << 31)) * F.lit(2654435761)
    else:
        mixed = F.xxhash64(key)
    return F.pmod(mixed, F.lit(1 << 32))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    source: str = "source",
    key: str = "doc_id",
    period: int = PERIOD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``key, source, block, slot, release, deadline, position`` of every row.

    ``weights (source, weight)`` are the target weights (none: sizes to the power ``TEMPERATURE``). ``block`` counts a source's
    blocks from 0; a block's slot lies in [release, deadline); ``position`` orders all rows without gaps. No row is left
    out or repeated: when a source has run out, the others go on in their proportions. The null source is a
    source; null keys come first in their source, equal keys in any order; an empty table gives an empty
    result; other columns are not looked at.
    """
    rows = stage_table(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), shuffle_number(docs, key).alias("mix")))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weights = source_weights(rows, "source")
    shares = stage_table(period_shares(sizes, weights, period))
    plan = stage_table(period_schedule(shares))
    # Rank in the source, in parts by ranges of the number, so that no window holds a whole source.
    total = rows.count()
    parts = max(1, -(-total // WINDOW_ROWS))
    part = F.floor(F.col("mix") * parts / (1 << 32)).cast("int")
    numbered = rows.join(shares, rows["source"].eqNullSafe(shares["source"])).select(
        "id", rows["source"], "mix", "n", "number", "share", "period", part.alias("part")
    )
    counts = numbered.groupBy("number", "part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("number").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("number", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("number", "part").orderBy("mix", "id")) - 1
    ranked = (
        numbered.withColumn("_inside", inside)
        .join(starts, ["number", "part"])
        .withColumn("rank", F.col("_start") + F.col("_inside"))
        .withColumn("block", F.expr(f"rank div {block_rows}L"))
        .withColumn("turn", F.expr("block % share"))
        .withColumn("round", F.expr("block div share"))
    )
    # Rows in earlier slots: of each source all its blocks there, as far as it has rows.
    totals = shares.agg(F.sort_array(F.collect_list(F.struct("number", "n", "share"))).alias("t"))
    placed = ranked.join(plan, ["number", "turn"]).withColumn("_t", totals.scalar())
    earlier_rows = F.expr(
        f"aggregate(_t, 0L, (a, x) -> a + least(x.n, {block_rows}L * (round * x.share + before[x.number])))"
    )
    begin = F.col("round") * F.col("period")
    return placed.select(
        F.col("id").alias(key),
        F.col("source").alias(source),
        "block",
        (begin + F.col("slot")).alias("slot"),
        (begin + F.col("release")).alias("release"),
        (begin + F.col("deadline")).alias("deadline"),
        (earlier_rows + F.expr(f"rank % {block_rows}L")).alias("position"),
    )
