"""Phrase collocations from suffix subtrees, built group by group of word prefixes.

The corpus is read as one string of words. Its suffix tree, cut off at ``max_words`` words, holds the count of every
phrase, but not in one task's memory. So it is partitioned vertically:

1. texts are coded in blocks: each block has its own vocabulary, and the blocks' counts give every word's frequency.
   Words below ``min_count`` end a suffix, as no phrase that holds one is frequent enough; the others get a number;
2. prefixes: the words' counts are cut, in the order of their numbers, into ranges of at most ``GROUP_SUFFIXES``
   suffixes. A word that fills a range alone is extended by its next word, counted and cut again, and so on. What
   comes out is a sorted list of boundary prefixes, one for about half a group's suffixes;
3. subtrees: a block sorts its suffixes, adds up equal ones and sends each group its part. A group's sorted
   leaves are its subtree: leaves that agree on their first d words lie together, and their total is the phrase's count.

Groups know nothing of each other. The counts of extended prefixes, whose suffixes lie in several groups, are known from step 2.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lookup import attach
from ..functions.staging import stage_table

#: About how many characters of one language make a block.
BLOCK_CHARS = 4_000_000
#: Suffixes that one group's subtree may be built from, before equal ones are added up.
GROUP_SUFFIXES = 2_000_000
#: Texts without a language count as this one.
NO_LANG = "und"
#: Numbers in one slice, within which counts are accumulated.
SLICE = 1 << 16

_END = b"\xff"  # in no UTF-8 text
#: A-Z become lower case; ``.,;:!?`` and line ends part pieces (fixed values).
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + 10 * _END)
_CODEC = "zstd"


def _squeezed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.astype(np.int32).tobytes(), _CODEC, asbytes=True)


def _unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 4 * n, _CODEC, asbytes=True), np.int32)


_BLOCKS = "block long, lang string, n_words long, words array<string>, counts array<bigint>, codes binary"
_BLOCKS_ARROW = pa.schema(
    [("block", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())]
)


def _coded(block: int, lang: str, texts: list[str]) -> pa.RecordBatch:
    """One block: its distinct words, their counts, and the words' places in that list (-1 between pieces)."""
    data = _END.join(t.encode() for t in texts).translate(_TABLE).replace(_END, b" " + _END + b" ")
    # The end stands first and last, so that it is number 0 and any block has it.
    encoded = pa.array([_END, *data.split(), _END], pa.binary()).dictionary_encode()
    codes = encoded.indices.to_numpy() - 1
    counts = np.bincount(codes[codes >= 0], minlength=len(encoded.dictionary) - 1)
    words = encoded.dictionary[1:].cast(pa.string())
    columns = [
        [block], [lang], [int(counts.sum())],
        pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(counts)], pa.array(counts, pa.int64())),
        [_squeezed(codes)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)


def _code_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[str]] = defaultdict(list)
    chars: dict[str, int] = defaultdict(int)
    block, every = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held[lang].append(text.as_py())
            chars[lang] += len(held[lang][-1])
            every += len(held[lang][-1])
            # The fullest language goes when it is full, or when all together are too many.
            if chars[lang] >= BLOCK_CHARS or every >= 4 * BLOCK_CHARS:
                full = max(chars, key=chars.get)
                yield _coded(block, full, held.pop(full))
                block, every = block + 1, every - chars.pop(full)
    for lang, texts in held.items():
        yield _coded(block, lang, texts)
        block += 1


def code_blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Blocks of texts of one language, with the block's vocabulary."""
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    return stage_table(read.where("text <> ''").mapInArrow(_code_texts, _BLOCKS))


def frequent_words(blocks: DataFrame, min_count: int) -> DataFrame:
    """``(lang, word, id, f, held)``: words with at least ``min_count`` occurrences, numbered from 0 without gaps.

    ``f`` counts occurrences, ``held`` the blocks that hold the word.
    """
    each = blocks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("count"))))
    found = each.groupBy("lang", "word").agg(F.sum("count").alias("f"), F.count(F.lit(1)).alias("held")).where(F.col("f") >= min_count)
    number = F.monotonically_increasing_id()
    placed = stage_table(found.select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND((1 << 33) - 1).alias("_row")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # One row for each partition of the table.
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return stage_table(placed.join(F.broadcast(offsets), "_part").select("lang", "word", (F.col("_before") + F.col("_row")).cast("int").alias("id"), "f", "held"))


def _renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, codes, size, found in zip(*(batch.column(i) for i in range(4)), strict=True):
            # The last place of the list answers the code -1.
            ids = np.full(size.as_py() + 1, -1, np.int32)
            packed = found.values.to_numpy() if found.is_valid else np.empty(0, np.int64)
            ids[packed >> 32] = packed & 0xFFFFFFFF
            yield pa.RecordBatch.from_pydict({"block": [block.as_py()], "ids": [_squeezed(ids[_unsqueezed(codes.as_py())])]})


def number_blocks(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``(block, ids)``: the blocks' words by their numbers in ``words``; -1 for others and between pieces."""
    each = blocks.select("block", "lang", F.posexplode("words").alias("local", "word"))
    total = words.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    found = attach(each, words, ["lang", "word"], "held", total)
    packed = F.shiftleft(F.col("local").cast("long"), 32).bitwiseOR(F.col("id").cast("long"))
    answers = found.groupBy("block").agg(F.collect_list(packed).alias("found"))
    joined = blocks.select("block", "codes", F.size("words").alias("size")).join(answers, "block", "left")
    return stage_table(joined.select("block", "codes", "size", "found").mapInArrow(_renumber, "block long, ids binary"))


def _suffixes(ids: np.ndarray, depth: int) -> np.ndarray:
    """A column for each of the first ``depth`` words of every suffix of two words or more; -1 beyond its end."""
    padded = np.concatenate([ids, np.full(depth, -1, np.int32)])
    at = np.flatnonzero((padded[:-1] >= 0) & (padded[1:] >= 0))
    columns = np.empty((depth, len(at)), np.int32)
    open_ = np.ones(len(at), bool)
    for d in range(depth):
        value = padded[at + d]
        open_ &= value >= 0
        columns[d] = np.where(open_, value, -1)
    return columns


def _in_order(columns: np.ndarray) -> np.ndarray:
    """The order of suffixes, word by word; two words share a key."""
    keys = []
    for d in range(0, len(columns), 2):
        key = (columns[d] + np.int64(1)) << 32
        keys.append(key | (columns[d + 1] + np.int64(1)) if d + 1 < len(columns) else key)
    return np.lexsort(keys[::-1])


def _added(columns: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes with equal ones added up."""
    order = _in_order(columns)
    columns = columns[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    if counts is None:
        return columns[:, starts], np.diff(starts, append=len(order))
    return columns[:, starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def _as_text(columns: np.ndarray) -> np.ndarray:
    """Suffixes as byte strings in the same order."""
    return np.ascontiguousarray((columns + 1).astype(">u4").T).view(f"S{4 * len(columns)}").ravel()


def _count_children(prefixes: np.ndarray):
    """Counts of the words after each of the prefixes (a column each), block by block."""
    depth = len(prefixes)
    known = _as_text(prefixes)
    schema = pa.schema([("prefix", pa.int32()), ("next", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                columns = _suffixes(_unsqueezed(data.as_py()), depth + 1)
                columns = columns[:, (columns[depth] >= 0) & np.isin(columns[0], prefixes[0])]
                text = _as_text(columns[:depth])
                at = np.searchsorted(known, text)
                hit = known[np.minimum(at, len(known) - 1)] == text
                if hit.any():
                    found, n = _added(np.stack([at[hit].astype(np.int32), columns[depth][hit]]))
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(n, pa.int64())], schema=schema)

    return count


def _cuts(children: DataFrame, limit: int) -> DataFrame:
    """``(prefix, next)``: where ranges of at most ``limit`` suffixes and a child begin, and every child of more."""
    sliced = children.withColumn("_slice", F.floor(F.col("next") / SLICE))
    totals = sliced.groupBy("prefix", "_slice").agg(F.sum("n").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("prefix").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("prefix", "_slice", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.sum("n").over(W.partitionBy("prefix", "_slice").orderBy("next").rowsBetween(W.unboundedPreceding, -1))
    placed = sliced.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, ["prefix", "_slice"])
    of_range = placed.groupBy("prefix", F.floor((F.col("_before") + F.col("_inside")) / limit)).agg(F.min("next").alias("next"))
    return of_range.select("prefix", "next").unionAll(children.where(F.col("n") > limit).select("prefix", "next"))


def partition_prefixes(numbered: DataFrame, words: DataFrame, depth: int, limit: int) -> tuple[np.ndarray, dict[tuple, int]]:
    """Boundary prefixes in order (a column each), and the counts of the prefixes that were extended.

    Both have about one entry for ``limit`` suffixes of the corpus; this is all that the driver sees of it.
    """
    bounds: set[tuple] = {()}
    extended: dict[tuple, int] = {}
    heavy: list[tuple] = [()]
    children = words.select(F.lit(0).alias("prefix"), F.col("id").alias("next"), F.col("f").alias("n"))
    for d in range(depth):
        if d:
            prefixes = np.array(heavy, np.int32).T
            counted = numbered.select("ids").mapInArrow(_count_children(prefixes), "prefix int, next int, n long")
            children = stage_table(counted.groupBy("prefix", "next").agg(F.sum("n").alias("n")))
        bounds |= {(*heavy[r.prefix], r.next) for r in _cuts(children, limit).toLocalIterator()}
        if d + 1 == depth:
            break
        large = {(*heavy[r.prefix], r.next): r.n for r in children.where(F.col("n") > limit).toLocalIterator()}
        extended |= large
        heavy = sorted(large)
        if not heavy:
            break
    padded = np.array([b + (-1,) * (depth - len(b)) for b in sorted(bounds)], np.int32)
    return padded.reshape(-1, depth).T, extended


def _send_suffixes(bounds: np.ndarray):
    keys = _as_text(bounds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                columns, counts = _added(_suffixes(_unsqueezed(data.as_py()), len(bounds)))
                cuts = [*np.searchsorted(_as_text(columns), keys).tolist(), len(counts)]
                groups = [g for g in range(len(keys)) if cuts[g] < cuts[g + 1]]
                packed = [_squeezed(np.vstack([columns[:, cuts[g] : cuts[g + 1]], counts[None, cuts[g] : cuts[g + 1]]]).ravel()) for g in groups]
                yield pa.RecordBatch.from_pydict({"group": pa.array(groups, pa.int32()), "packed": pa.array(packed, pa.binary())})

    return send


def _subtree(parts: list[bytes], depth: int, min_count: int) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Phrases of a group with their counts, depth by depth: leaves that share a prefix stand together."""
    tables = [_unsqueezed(p).reshape(depth + 1, -1) for p in parts]
    leaves, counts = _added(np.hstack([t[:depth] for t in tables]), np.hstack([t[depth] for t in tables]).astype(np.int64))
    new = np.ones(leaves.shape[1], bool)
    new[1:] = leaves[0, 1:] != leaves[0, :-1]
    for d in range(1, depth):
        new[1:] |= leaves[d, 1:] != leaves[d, :-1]
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(counts, starts)
        good = (totals >= min_count) & (leaves[d, starts] >= 0)
        yield leaves[: d + 1, starts[good]].T.tolist(), totals[good].tolist()


def _read_subtrees(depth: int, min_count: int, extended: set[tuple]):
    schema = pa.schema([("words", pa.list_(pa.int32())), ("a", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def phrases(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
            for words, totals in _subtree(parts, depth, min_count):
                own = [i for i, w in enumerate(words) if tuple(w) not in extended]
                for at in range(0, len(own), 10_000):
                    some = own[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({"words": [words[i] for i in some], "a": [totals[i] for i in some]}, schema=schema)

        current, parts = None, []
        for batch in batches:
            for group, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if group != current and parts:
                    yield from phrases(parts)
                    parts = []
                current = group
                parts.append(packed.as_py())
        if parts:
            yield from phrases(parts)

    return read


def frequent_phrases(numbered: DataFrame, words: DataFrame, max_words: int, min_count: int, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``(words, a)``: every run of one to ``max_words`` word numbers with at least ``min_count`` occurrences in pieces."""
    bounds, extended = partition_prefixes(numbered, words, max_words, max(1, group_suffixes // 2))
    sent = numbered.select("ids").mapInArrow(_send_suffixes(bounds), "group int, packed binary")
    grouped = sent.repartition("group").sortWithinPartitions("group")
    spark = numbered.sparkSession
    longer = grouped.mapInArrow(_read_subtrees(max_words, min_count, set(extended)), "words array<int>, a long")
    known = [(list(p), n) for p, n in extended.items() if len(p) > 1]
    single = words.select(F.array("id").alias("words"), F.col("f").alias("a"))
    return stage_table(longer.unionAll(spark.createDataFrame(known, "words array<int>, a long")).unionAll(single))


def _whole(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _resolved(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``(words, a, lang, phrase)`` of phrases of two words or more."""
    each = phrases.select("words", "a", F.posexplode("words").alias("_at", "id"))
    uses = each.groupBy("id").agg(F.count(F.lit(1)).alias("_uses"))
    table = words.select("id", "lang", "word").join(uses, "id")
    total = phrases.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    found = attach(each, table, ["id"], "_uses", total)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"])
    return found.groupBy("words").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.array_join(in_order, " ").alias("phrase"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 5,
    min_count: int = 100,
    top: int = 2_000,
    contained_percent: int = 100,
    group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase is 2 to ``max_words`` words of a piece, ``a`` its occurrences. Cut after any of its words, the parts have
    ``l`` and ``r`` occurrences; the cut of the lowest ``floor(1000 a n / (l r))`` counts, of several the first, ``n``
    being the language's words. Phrases inside a longer one that has at least ``contained_percent`` of their occurrences go.
    Order: score and ``a`` descending, then the phrase's bytes.

    Null and empty texts have no words, a null language is ``und``; repeated rows count each time; an empty
    table, or one without frequent phrases, gives an empty result; other columns are not looked at.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have at least two words and one occurrence")
    blocks = code_blocks(docs, text, lang)
    words = frequent_words(blocks, min_count)
    nodes = frequent_phrases(number_blocks(blocks, words), words, max_words, min_count, group_suffixes)
    candidates = nodes.where(F.size("words") > 1)
    named = _resolved(candidates, words)

    # Longer phrases tell all that lie in them how often they occur.
    size = F.size("words")
    inner = candidates.where(size > 2).select(
        F.col("a").alias("_outer"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("_n")
    ).select("_outer", "words", "_n", F.explode(F.sequence(F.lit(1), size - F.col("_n") + 1)).alias("_from"))
    most = inner.groupBy(F.slice("words", F.col("_from"), F.col("_n")).alias("words")).agg(F.max("_outer").alias("_outer"))
    kept = named.join(most, "words", "left").where(~F.coalesce(100 * F.col("_outer") >= contained_percent * F.col("a"), F.lit(False)))
    kept = stage_table(kept.drop("_outer"))

    cuts = kept.select("words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "words", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size).alias("right")
    )
    parts = cuts.select(F.explode(F.array("left", "right")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("uses"))
    table = stage_table(nodes.select(F.col("words").alias("part"), "a").join(parts, "part"))
    total = table.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    lefts = table.select(F.col("part").alias("left"), F.col("a").alias("l"), "uses")
    rights = table.select(F.col("part").alias("right"), F.col("a").alias("r"), "uses")
    with_l = attach(cuts, lefts, ["left"], "uses", total).drop("uses")
    counted = attach(with_l, rights, ["right"], "uses", total).select("words", "k", "l", "r")
    of_phrase = counted.groupBy("words").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    sizes = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    rows = kept.join(of_phrase, "words").join(sizes, "lang")
    # Exact products of up to 38 digits.
    score = lambda c: F.call_function("div", _whole(1000 * F.col("a")) * _whole(F.col("n")), _whole(c["l"]) * _whole(c["r"]))
    lowest = F.array_min(F.transform("cuts", lambda c: F.struct(score(c).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    scored = rows.select("lang", "phrase", "a", "n", lowest.alias("_cut")).select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", first).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
