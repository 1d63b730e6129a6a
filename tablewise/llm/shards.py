"""Sharding by balanced label propagation.

Documents with equal texts are linked. Starting from a hash of the ids, rounds move linked documents to the
shard where most of their neighbours are, under capacity quotas, until the shards hold as few cut links as
the quotas allow. Documents without links fill the shards up to sizes that differ by one row at most.

Members of a group are interchangeable, so a round works on one row a group: how many members each shard
holds. A group of any size is one such row. A round's quotas come from the demand for each shard by size of
the neighbourhood (a table of fixed size); where a shard can't take all, the larger neighbourhoods go first and
the level that just does not fit moves in part. Only at the end documents get their shards: those of a group
that is split, by their rank in the group, counted in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.staging import stage_table
from .text import pinned, text_key

SHARDS = 16
#: Rounds of propagation at most; each stops being useful once hardly any document moves.
ROUNDS = 6
#: Levels of neighbourhood sizes: powers of two.
LEVELS = 40
#: Rows that one window orders, about.
WINDOW_ROWS = 20_000


def quotas(demand: list[list[int]], leaving: list[int], held: list[int], room: int) -> list[list[float]]:
    """The share of each (shard, level) of demand that may move in, so that no shard holds more than ``room``.

    What leaves a shard makes room only as far as it is let in elsewhere, so shares are lowered until they fit.
    """
    shards = range(len(demand))
    share = [[1.0] * LEVELS for _ in shards]
    for _ in range(50):
        moved = [sum(d * f for d, f in zip(demand[t], share[t], strict=True)) for t in shards]
        wanted = sum(map(sum, demand))
        out = [leaving[s] * (sum(moved) / wanted if wanted else 0) for s in shards]
        fits = True
        for t in shards:
            free = max(0.0, room - held[t] + out[t])
            if moved[t] > free + 0.5:
                fits = False
                for level in reversed(range(LEVELS)):
                    share[t][level] = min(share[t][level], free / demand[t][level]) if demand[t][level] else 1.0
                    free = max(0.0, free - demand[t][level] * share[t][level])
        if fits:
            break
    return share


def propagate(groups: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``groups (hi, lo, counts)`` with members moved towards each other, at most ``total / shards`` of them in a shard.

    A group aims at the open shard where most of its members are, or at as many as it needs; members in other open shards
    want to go there. A full shard is closed: nothing moves in, and those leave it that have as many neighbours elsewhere.
    """
    room = -(-total // shards)
    open_shards = list(range(shards))
    for _ in range(rounds):
        closed = F.array(*[F.lit(s not in open_shards) for s in range(shards)])
        # Equal numbers of members are told apart by a hash of the group, so that small groups spread.
        ranked = F.array(*[F.struct(F.get("counts", F.lit(s)).alias("n"), F.xxhash64("hi", F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in open_shards])
        needed = F.greatest(F.ceil(F.aggregate(ranked, F.lit(0).cast("long"), lambda a, x: a + x["n"]) / room), F.lit(1)).cast("int")
        best = F.transform(F.sort_array(ranked, asc=False), lambda x: x["s"])
        aimed = pinned(groups.select("hi", "lo", "counts"), _aims=F.slice(best, 1, F.least(needed, F.lit(len(open_shards)))))
        aimed = pinned(
            aimed,
            _closed=closed,
            _to=F.expr(f"transform(sequence(0, {shards - 1}), s -> get(_aims, s % size(_aims)))"),
            _level=F.expr(f"transform(sequence(0, {shards - 1}), s -> CAST(floor(log2(counts[get(_aims, s % size(_aims))] + 1)) AS INT))"),
        )
        stays = "array_contains(_aims, s) OR (_closed[s] AND counts[s] > counts[_to[s]])"
        cells = aimed.select("counts", "_aims", "_closed", "_to", "_level", F.posexplode("counts").alias("s", "n")).where("n > 0")
        state = cells.groupBy("s", F.expr(f"IF({stays}, -1, _to[s])").alias("to"), F.expr("_level[s]").alias("level")).agg(F.sum("n").alias("n"))
        demand = [[0] * LEVELS for _ in range(shards)]
        leaving, held = [0] * shards, [0] * shards
        for r in state.collect():  # at most shards * (shards + 1) * LEVELS rows
            held[r.s] += r.n
            if r.to >= 0:
                demand[r.to][r.level] += r.n
                leaving[r.s] += r.n
        if not sum(leaving):
            break
        allowed = F.array(*[F.lit(x) for row in quotas(demand, leaving, held, room) for x in row])
        moved = pinned(
            pinned(aimed, _allowed=allowed),
            _moved=F.expr(
                f"transform(counts, (c, s) -> IF({stays}, 0L, least(c, CAST(floor(c * _allowed[_to[s] * {LEVELS} + _level[s]]"
                " + pmod(xxhash64(lo, s), 1048576) / 1048576D) AS BIGINT))))"
            ),
        )
        counts = F.expr(
            "transform(counts, (c, t) -> c - _moved[t] + aggregate(transform(_moved, (m, s) -> IF(_to[s] = t, m, 0L)), 0L, (a, x) -> a + x))"
        )
        groups = stage_table(moved.select("hi", "lo", counts.alias("counts")))
        sizes = groups.agg(*[F.sum(F.get("counts", F.lit(s))).alias(f"s{s}") for s in range(shards)]).first()
        open_shards = [s for s in range(shards) if sizes[f"s{s}"] < room - room // 200 - 1]
        if not open_shards:
            break
    return groups


def cut_links(placed: DataFrame, group: list[str], shard: str = "shard") -> DataFrame:
    """``(links, cut)``: pairs of rows in the same group, and those whose shards differ."""
    cells = placed.groupBy(*group, shard).agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    links = F.col("n") * (F.col("n") - 1) / 2
    return groups.agg(F.sum(links).cast("long").alias("links"), F.sum(links - F.col("inside")).cast("long").alias("cut"))


def ranked_in_parts(df: DataFrame, group: list[str], parts: Column, order: list[str], name: str) -> DataFrame:
    """Add the rank (from 0) of each row in its group, counted in parts by the hash of the order columns.

    No window holds a whole group: a part has its own, and the sizes of the parts are added up.
    """
    dealt = stage_table(df.withColumn("_part", F.pmod(F.xxhash64(*order), parts)))
    sizes = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    ranked = dealt.withColumn("_inside", inside).join(offsets, [*group, "_part"])
    return ranked.withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_part", "_inside", "_before")


def slots_in_order(placed: DataFrame, position: str, shard: str = "shard") -> DataFrame:
    """Add ``slot``: the rank (from 0) of each row in its shard by ``position``, which numbers all rows from 0 without gaps.

    Ranks are counted in ranges of positions, so that no window holds a whole shard.
    """
    total = placed.count()
    width = max(1, min(SHARDS * WINDOW_ROWS, -(-total // SHARDS)))
    ranged = stage_table(placed.withColumn("_range", F.expr(f"`{position}` div {width}L")))
    sizes = ranged.groupBy(shard, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(shard, "_range").orderBy(position))
    ranked = ranged.withColumn("_inside", inside).join(offsets, [shard, "_range"])
    return ranked.withColumn("slot", (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_range", "_inside", "_before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    The law is ``rows``: shard sizes differ by one row at most. ``slot`` counts from 0 without gaps in each shard; ``size``
    is the text's bytes plus 1, ``text_crc32`` its checksum (null: 1 and 0). Null texts are linked to each other like
    any equal texts; keys may be null or repeat; an empty table gives an empty result; other columns are not
    looked at.
    """
    same = text_key(F.col(text))
    rows = stage_table(
        docs.select(
            F.col(key).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("crc"),
            same["hi"].alias("hi"),
            same["lo"].alias("lo"),
        )
    )
    first = F.pmod(F.xxhash64("id", "lo"), F.lit(shards)).cast("int")
    count = lambda s: F.count(F.when(F.col("first") == s, 1))
    groups = stage_table(
        rows.withColumn("first", first)
        .groupBy("hi", "lo")
        .agg(F.array(*[count(s) for s in range(shards)]).alias("counts"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    total = rows.count()
    groups = propagate(groups, total, shards, rounds)
    cells = groups.select(
        "hi",
        "lo",
        F.filter(F.transform("counts", lambda c, s: F.struct(c.alias("n"), s.alias("shard"))), lambda c: c["n"] > 0).alias("cells"),
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("members"),
    )
    joined = rows.join(cells, ["hi", "lo"], "left")
    single, whole = F.col("cells").isNull(), F.size("cells") == 1
    plain = joined.where(single | whole).select(
        "id", "size", "crc", "hi", "lo", F.when(single, first).otherwise(F.get("cells", F.lit(0))["shard"]).alias("shard"), single.alias("alone")
    )
    split = joined.where(~single & ~whole)
    parts = F.ceil(F.col("members") / WINDOW_ROWS).cast("long")
    order = ["id", "size"]
    in_group = ranked_in_parts(split, ["hi", "lo"], parts, order, "rank").withColumn("rank", F.col("rank").cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).alias("shard"))
    walk = F.aggregate(
        "cells",
        start,
        lambda a, c: F.when(a["end"] > F.col("rank"), a).otherwise(
            F.struct((a["end"] + c["n"]).alias("end"), c["shard"].alias("shard"))
        ),
    )
    dealt = in_group.select("id", "size", "crc", "hi", "lo", walk["shard"].alias("shard"), F.lit(False).alias("alone"))
    placed = stage_table(plain.unionAll(dealt))
    # Rank in the shard: linked rows first, so that rows without links make up for unequal sizes.
    parts = F.lit(max(1, -(-total // (shards * WINDOW_ROWS)))).cast("long") * 2
    keyed = placed.withColumn("_late", F.col("alone").cast("int"))
    ranked = ranked_in_parts(keyed, ["shard", "_late"], parts, ["id", "hi", "lo"], "rank")
    sizes = {(r["shard"], r["_late"]): r["n"] for r in keyed.groupBy("shard", "_late").agg(F.count(F.lit(1)).alias("n")).collect()}
    linked = [sizes.get((s, 0), 0) for s in range(shards)]
    held = [sizes.get((s, 0), 0) + sizes.get((s, 1), 0) for s in range(shards)]
    wanted = [total // shards + (s < total % shards) for s in range(shards)]
    at = lambda values, s: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), s + 1)
    shard = F.col("shard")
    place = F.col("rank") + F.when(F.col("_late") == 1, at(linked, shard)).otherwise(0)
    over = [max(0, h - w) for h, w in zip(held, wanted, strict=True)]
    before_over = [sum(over[:s]) for s in range(shards)]
    lacking = [max(0, w - h) for h, w in zip(held, wanted, strict=True)]
    ends = [sum(lacking[: s + 1]) for s in range(shards)]
    number = place - at(wanted, shard) + at(before_over, shard)  # among all rows that have to move on
    moved_to = sum((F.when(number >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    numbered = ranked.withColumns({"_place": place, "_number": number, "_new": moved_to, "_stays": place < at(wanted, shard)})
    slot = F.when(F.col("_stays"), F.col("_place")).otherwise(
        at(held, F.col("_new")) + F.col("_number") - at([0, *ends[:-1]], F.col("_new"))
    )
    return numbered.select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.when(F.col("_stays"), shard).otherwise(F.col("_new")).cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
