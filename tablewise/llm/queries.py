"""The registered queries on text corpora, and the SQL that checks those which SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, decontaminate, mixing, ngram_lm, pages, quality, resampling, secret_scan, shards, simhash, substrings, token_count, winnowing

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's vocabulary: in the folder TOKENIZER_DIR, else in the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


@query("op4_language_model")
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Words of an item stand in windows of ten; a shorter item is one window. Near windows (all terms but one of ten at most a
#: word off their places) have one of their two rarest terms.
_OP7 = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
place AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d),
dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM place JOIN lengths ON s + n - 1 <= len(w)),
hit AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (n, t)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
item AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY r),
win AS (SELECT DISTINCT n, t, string_split(t, ' ') AS v FROM iw),
term AS (SELECT n, t, v, o, v[o] AS x FROM (SELECT n, t, v, unnest(range(1, n + 1)) AS o FROM win)),
word_at AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
frequency AS (SELECT x, count(*) AS f FROM word_at GROUP BY x),
seed AS (
  SELECT n, t, v, o, x FROM term LEFT JOIN frequency USING (x)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(f, 0), o) <= 2),
start AS (SELECT DISTINCT r, n, t, v, p - o + k AS s FROM (SELECT r, n, t, v, p, o, unnest([-1, 0, 1]) AS k FROM word_at JOIN seed USING (x))),
near AS (
  SELECT DISTINCT r, t FROM start JOIN d USING (r)
  WHERE len(list_filter(range(1, n + 1), lambda j: list_contains(w[greatest(s + j - 1, 1) : greatest(s + j + 1, 0)], v[j]))) >= n - (n // 10)),
near_item AS (
  SELECT r, count(*) AS n_near_items, string_agg(k, ',' ORDER BY k) AS near_ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM near JOIN iw USING (t) EXCEPT SELECT r, CAST(item_id AS VARCHAR) FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items, coalesce(near_ids, '') AS near_ids
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r) LEFT JOIN near_item USING (r)
"""


@query("op6_main_texts")
def op6_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


@query("op7_decontaminate", _OP7)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
        F.concat_ws(",", "near_items").alias("near_ids"),
    )


_OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
at35 AS (
  SELECT r, s, array_to_string(w[s : s + 34], ' ') AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT t FROM at35 GROUP BY t HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(s, s + 35)) AS p FROM at35 SEMI JOIN again USING (t)) GROUP BY r),
kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) k
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(ps) AS p FROM gone) g WHERE g.r = k.r AND g.p = k.p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query("op10_remove_repeated", _OP10)
def op10_remove_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents"))


@query("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


#: The schedule of one period is a recursion over its slots; due dates and sources are packed into one number.
_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, (doc_id % 2147483648 * 2654435761) % 4294967296 AS mix FROM documents),
sizes AS (SELECT source, count(*) AS n, CAST(round(pow(CAST(count(*) AS DOUBLE), 0.7) * 1e6) AS HUGEINT) AS w FROM d GROUP BY source),
p AS (SELECT greatest(1000, 2 * count(*)) AS period, greatest(1000, 2 * count(*)) - count(*) AS rest, sum(w) AS total FROM sizes),
cut AS (SELECT source, n, period, rest, (rest * w) // total AS f, (rest * w) % total AS l FROM sizes, p),
shares AS (
  SELECT source, n, CAST(period AS BIGINT) AS period, row_number() OVER (ORDER BY source) AS number,
    CAST(1 + f + CASE WHEN row_number() OVER (ORDER BY l DESC, source) <= rest - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share
  FROM cut),
lists AS (SELECT list(share ORDER BY number) AS s, list(n ORDER BY number) AS ns, max(period) AS period, count(*) AS m FROM shares),
steps AS (
  SELECT 0 AS t, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS had, CAST(NULL AS BIGINT) AS number, CAST(NULL AS BIGINT[]) AS before FROM lists
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, i: CASE WHEN i = k THEN h + 1 ELSE h END), k, had
  FROM (
    SELECT t, had, list_min(list_transform(
        list_filter(range(1, m + 1), lambda i: had[i] < s[i] AND (had[i] * period) // s[i] <= t),
        lambda i: ((had[i] + 1) * period + s[i] - 1) // s[i] * 1000000 + i)) % 1000000 AS k
    FROM steps, lists WHERE t < period)),
plan AS (SELECT number, t - 1 AS slot, before[number] AS turn, before FROM steps WHERE t > 0),
ranked AS (
  SELECT doc_id, source, number, share, period, row_number() OVER (PARTITION BY source ORDER BY mix, doc_id) - 1 AS rank
  FROM d JOIN shares USING (source)),
blocks AS (SELECT *, rank // 8 AS block, rank // 8 % share AS turn, rank // 8 // share AS round FROM ranked)
SELECT doc_id, source, block, CAST(round * b.period + slot AS BIGINT) AS slot,
  CAST(round * b.period + (turn * b.period) // share AS BIGINT) AS release,
  CAST(round * b.period + ((turn + 1) * b.period + share - 1) // share AS BIGINT) AS deadline,
  CAST(list_sum(list_transform(range(1, m + 1), lambda i: least(ns[i], 8 * (round * s[i] + before[i])))) + rank % 8 AS BIGINT) AS position
FROM blocks b JOIN plan USING (number, turn), lists
"""


@query("op9_mix_sources", _OP9)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


#: Phrases are told apart as words joined by spaces, which no word holds.
_OP11 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w), (SELECT unnest(range(1, 6)) AS k)
  WHERE s + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
inner_ AS (
  SELECT lang, array_to_string(v[i : i + m - 1], ' ') AS phrase, max(a) AS outer_a
  FROM (SELECT lang, a, v, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE NOT coalesce(100 * outer_a >= 100 * a, false)),
cut AS (
  SELECT k.lang, k.phrase, k.a, j, n, x.a AS l, y.a AS r, CAST((1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) k JOIN total USING (lang)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(v[1 : j], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(v[j + 1 :], ' ')),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


@query("op11_collocations", _OP11)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: CRC-32 goes through a table of 256 entries, byte by byte.
_OP12 = r"""
WITH crc_table AS (
  SELECT list(list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
dt AS (SELECT r, unnest(w) AS x FROM d),
bt AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x
  FROM benchmark),
vocabulary AS (
  SELECT x, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS UBIGINT)) AS bytes
  FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dt UNION SELECT x FROM bt))),
hashed AS (
  SELECT x, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS BIGINT) AS bucket
  FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dt JOIN hashed USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bt JOIN hashed USING (x) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dt) AS all_s, (SELECT count(*) FROM bt) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
weights AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dt JOIN hashed USING (x) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1 : 8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS may FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * may // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (r)
"""


@query("op12_target_resampling", _OP12)
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Hashes are CRC-32s of three words through a table of 256 entries; a window has four of them.
_OP13 = r"""
WITH crc_table AS (
  SELECT list(list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS total FROM documents),
e AS (
  SELECT a.r, a.doc_id, a.text, length(a.text) AS n, b.r AS next,
    a.text[1 : length(a.text) - length(a.text) // 2] || b.text[1 : length(a.text) // 2] AS edited
  FROM d a JOIN d b ON b.r = a.r % a.total + 1),
sides AS (SELECT r, 0 AS side, text FROM e UNION ALL SELECT r, 1, edited FROM e),
words AS (SELECT r, side, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM sides),
runs AS (
  SELECT r, side, m, p, array_to_string(w[p + 1 : p + 3], ' ') AS run
  FROM (SELECT r, side, w, greatest(len(w) - 2, 1) AS m, unnest(range(greatest(len(w) - 2, 1))) AS p FROM words WHERE len(w) > 0)),
vocabulary AS (
  SELECT run, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS UBIGINT)) AS bytes
  FROM (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM runs))),
hashed AS (
  SELECT run, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS BIGINT) AS h
  FROM vocabulary, crc_table),
packed AS (SELECT r, side, p, m, h * 2147483648 + 2147483647 - p AS v FROM runs JOIN hashed USING (run)),
chosen AS (
  SELECT DISTINCT r, side, v FROM (
    SELECT r, side, p, m, min(v) OVER (PARTITION BY r, side ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM packed)
  WHERE p >= least(3, m - 1)),
f AS (
  SELECT r, side, string_agg(format('{:08x}:{}', v >> 31, 2147483647 - (v & 2147483647)), ',' ORDER BY v & 2147483647 DESC) AS s, list(DISTINCT v >> 31) AS h
  FROM chosen GROUP BY r, side)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, coalesce(x.s, '') AS fingerprint, coalesce(y.s, '') AS edited_fingerprint,
  CASE WHEN x.h IS NULL AND y.h IS NULL THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(coalesce(x.h, []), coalesce(y.h, []))) / (coalesce(len(x.h), 0) + coalesce(len(y.h), 0)) END AS near_edited,
  CASE WHEN x.h IS NULL AND z.h IS NULL THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(coalesce(x.h, []), coalesce(z.h, []))) / (coalesce(len(x.h), 0) + coalesce(len(z.h), 0)) END AS near_next
FROM e LEFT JOIN f x ON x.r = e.r AND x.side = 0 LEFT JOIN f y ON y.r = e.r AND y.side = 1 LEFT JOIN f z ON z.r = e.next AND z.side = 0
"""


@query("op13_fingerprints", _OP13)
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.edited_likeness(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.as_string(F.col("packed")).alias("fingerprint"),
        winnowing.as_string(F.col("edited_packed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
