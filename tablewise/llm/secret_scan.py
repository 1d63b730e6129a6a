"""Secret scan with linking of credentials that come in several parts.

Three plain patterns always count (``assign``, ``access``, ``hex``). On their own, a user name, a random
looking string or an address are no finding. The scan lists such weak parts too and joins them by
interval: within one scope (a paragraph) a weak part is reported only when a part that completes it
stands at most ``REACH`` code points away: a secret for an identifier or an endpoint, an identifier or an
endpoint for a secret. Plain findings count as parts as well: ``access`` as an identifier, ``assign`` and
``hex`` as secrets. A URL and what stands inside it (connection strings, signed URLs) are parts of their own.

The parts are few. Finding them is one pass over the texts; the join is a window over each scope that
knows the nearest part of every role on either side, so no pairs are made.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.staging import stage_table

#: Code points between a weak part and the one that completes it, at most.
REACH = 300
#: Kinds in the order in which spans with the same start are listed; the first three are plain findings.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: What each role needs nearby.
COMPLETES = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
ROLES = {"assign": "secret", "hex": "secret", "access": "identifier", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A random looking string: so many characters with lower and upper case and digits.
MIN_SECRET = 16

# Plain patterns (fixed values).
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
# Weak parts.
_NAMED = re.compile(r"""\b(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", re.IGNORECASE | re.ASCII)
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{4,}")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_SECRET)
# One within a URL, up to its query.
_SEGMENT = re.compile(r"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{%d,}={0,2}" % MIN_SECRET)
# A scheme begins with the first letter of its run; runs are looked at once, from their start.
_ADDRESS = re.compile(r"""(?<![a-z0-9+.-])[0-9+.-]*([a-z][a-z0-9+.-]*)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?""", re.ASCII)
_PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def plain_spans(text: str) -> list[Span]:
    """Findings that count by themselves, by start, then kind: each kind leftmost and without overlap."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _is_random(value: str) -> bool:
    return any(c.isdigit() for c in value) and value.lower() != value != value.upper()


def weak_parts(text: str, plain: list[Span]) -> list[Span]:
    """Parts that need another one, by start.

    A string has one role: an identifier or secret that overlaps another one or a plain finding is left out, and so is
    one in a named address. What stands inside a URL after its scheme (user and password, path segments, query values)
    is a part beside the URL itself.
    """
    named = [("identifier", *m.span(1)) for m in _NAMED.finditer(text)]
    named += [("identifier", *m.span()) for m in _ISSUED.finditer(text)]
    taken = [(s, e) for _, s, e in plain]
    hosts, urls = [], []  # urls: start, end of the scheme, start of the query, end
    for m in _ADDRESS.finditer(text):
        start, end = m.span()
        if m[1]:
            start, scheme = m.start(1), m.end(1) + 3
            query = min((at for at in (text.find("?", start, end), text.find("#", start, end)) if at >= 0), default=end)
            urls.append((start, scheme, query, end))
        else:
            hosts.append((start, end))
    found = [("secret", *m.span()) for m in _RANDOM.finditer(text) if _is_random(m[0])]
    if urls:
        # Up to its query a URL's words end at slashes; a match that begins there may have run over several.
        begins = [u[0] for u in urls]
        at = lambda start: urls[max(bisect_right(begins, start) - 1, 0)]
        found = [x for x in found if not at(x[1])[0] <= x[1] < at(x[1])[2]]
        for _, scheme, query, _ in urls:
            found += [("secret", *m.span()) for m in _SEGMENT.finditer(text, scheme, query) if _is_random(m[0])]
        named = [x for x in named if not at(x[1])[0] <= x[1] < at(x[1])[1]]
    hosts = _apart([("endpoint", *x) for x in hosts], taken)
    inside = _apart(sorted({*named, *found}, key=lambda s: (s[1], -s[2], s[0])), taken + [(s, e) for _, s, e in hosts])
    return sorted([*inside, *hosts, *(("endpoint", u[0], u[3]) for u in urls)], key=lambda s: (s[1], KINDS.index(s[0])))


def _apart(parts: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Of ``parts``, by start, those that overlap neither an earlier one nor a span of ``taken``, by start."""
    taken = sorted(taken)
    free, at, last = [], 0, 0
    for kind, start, end in parts:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= last and not (at < len(taken) and taken[at][0] < end):
            free.append((kind, start, end))
            last = end
    return free


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])
_SPAN_SQL = "array<struct<start:int,rank:int,end:int,scope:int>>"


def _scan(id_type: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        schema = pa.schema(
            [("row", pa.int64()), ("id", id_type), ("digest", pa.string()), ("plain", pa.list_(_SPAN)), ("weak", pa.list_(_SPAN))]
        )
        for batch in batches:
            out = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py() or ""
                plain = plain_spans(text)
                weak = weak_parts(text, plain)
                if len({ROLES[k] for k, _, _ in plain + weak}) < 2:
                    weak = []
                ends = [m.start() for m in _PARAGRAPH.finditer(text)] if weak else []
                line = ",".join(f"{k}:{s}:{e}" for k, s, e in plain)
                spans = [[], []]
                for to, parts in zip(spans, (plain, weak), strict=True):
                    scope = 0
                    for kind, start, end in parts:
                        while scope < len(ends) and ends[scope] < start:
                            scope += 1
                        to.append({"start": start, "rank": KINDS.index(kind), "end": end, "scope": scope})
                out.append({"row": row, "id": key.as_py(), "digest": hashlib.sha256(line.encode()).hexdigest(), "plain": spans[0], "weak": spans[1]})
                row += 1
            yield pa.RecordBatch.from_pylist(out, schema)

    return scan


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows of ``parts (row, scope, rank, start, end)`` that a completing part stands near, in the same scope."""
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])]), F.col("rank"))
    scope = W.partitionBy("row", "scope")
    before = scope.orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1)
    after = scope.orderBy(F.desc("start"), F.desc("rank")).rowsBetween(W.unboundedPreceding, -1)
    held = parts.withColumn("_role", role)
    names = sorted(COMPLETES)
    for name in names:
        mine = F.col("_role") == name
        held = held.withColumn(f"_end_{name}", F.max(F.when(mine, F.col("end"))).over(before))
        held = held.withColumn(f"_start_{name}", F.min(F.when(mine, F.col("start"))).over(after))

    def near(name: str) -> Column:
        back = F.col("start") - F.col(f"_end_{name}") <= reach
        return F.coalesce(back, F.lit(False)) | F.coalesce(F.col(f"_start_{name}") - F.col("end") <= reach, F.lit(False))

    complete = F.lit(False)
    for name, needs in COMPLETES.items():
        some = F.lit(False)
        for need in needs:
            some = some | near(need)
        complete = complete | ((F.col("_role") == name) & some)
    return held.where(complete).select(parts.columns)


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` of every row.

    ``spans`` lists all findings as kind:start:end (code points, end exclusive) by start, then kind, comma-joined;
    ``base_sha256`` is the digest of the plain ones joined likewise; ``n_linked`` counts the others. Null and
    empty texts have none; keys may be null or repeat; an empty table gives an empty result; other columns
    are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    row = f"row long, id {kind.simpleString()}, digest string, plain {_SPAN_SQL}, weak {_SPAN_SQL}"
    found = stage_table(docs.select(F.col(key).alias("id"), text).mapInArrow(_scan(to_arrow_type(kind)), row))
    parts = found.where(F.size("weak") > 0).select("row", F.inline(F.concat("plain", "weak")))
    linked = (
        linked_parts(parts, reach)
        .where(F.col("rank") > 2)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "rank", "end", "scope")).alias("linked"))
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("plain", F.coalesce("linked", F.array().cast(_SPAN_SQL))))
    count = lambda rank: F.size(F.filter("plain", lambda s: s["rank"] == rank)).cast("long")
    return found.join(linked, "row", "left").select(
        F.col("id").alias(key),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.col("digest").alias("base_sha256"),
        F.array_join(
            F.transform(every, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ","
        ).alias("spans"),
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
    )
