"""Main text of web pages by template deduction on equivalence classes of tokens.

1. Each page becomes tokens: its elements, told apart by the path of elements above them (names and classes, without numbers
   that are a page's own), and its runs of text under their paths.
2. Over the pages of a host, a token's occurrence vector says which pages hold it. Tokens with the same vector form an
   equivalence class. A class of an element and texts that two or more different pages hold is valid, whatever other
   pages of the host hold: two layouts have two classes. Paths nest the classes into the host's template.
3. A place of the template whose texts all are in the class of its element is filled by the template. A place with any
   other text is a slot, and all its texts are the page's own, also those that two pages share.
4. The page's text is what fills the slots inside the article (or, without one, the slots outside menus and the like). What
   the HTML standard keeps out of an article (menus, forms, scripts ...) is no candidate; adverts and readers' comments
   are told by their names, as their texts fill slots, too.

Vectors are compared by sums of hashes, so a host of any size is aggregated in parts and its pages are never gathered.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.staging import stage_table

#: Parts in which the pages of a host meet its template, of which each part gets a copy.
PARTS = 64
#: Places of templates (a host's 32 characters and a number) that are broadcast at most; more are joined in parts of hosts.
PLACES_AT_ONCE = 200_000

# Markup that is no article (fixed values of the HTML standard, and usual names where there is no article).
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
)
NO_ARTICLE = ("nav", "header", "footer", "aside", "form", "head", "button", "select", "option", "label", "fieldset", "dialog", "menu", "template", "svg", "object", "canvas", "audio", "video", *RAW)
ARTICLE = ("article", "main")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar")
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|paywall|menu|nav|navbar|"
    r"navigation|breadcrumbs?|side-?bar|related|recommended|share|sharing|social|comments?|comment-?list|respond|replies|disqus|footer|"
    r"popup|modal|login|sign-?up|widget|skip-?link)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names that say so outside an article only: inside, they hold its heading.
PAGE_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.IGNORECASE)
#: Whole classes and ids of what an article may hold of others: adverts and readers' comments.
INSIDE_NAMES = {"ad", "ads", "advert", "advertisement", "adsense", "sponsored", "comments", "comment-list", "commentlist", "respond", "disqus_thread"}
# Elements that end an open one of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# Quotes hold a value behind "=" only. The group never gives back, so that a tag is read once.
_LEX = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*))>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


# Numbers in classes and ids that may be a page's own: "post-17", but not "x1" among classes.
_OWN_NUMBER = {"class": re.compile(r"(?<=[_-])[0-9]+"), "id": re.compile(r"[0-9]+")}


def _attributes(text: str) -> dict[str, str]:
    if not text.strip("/ \t\n\r\f"):
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _kind(name: str, values: dict[str, str]) -> str:
    """What tells an element from its siblings: its name, classes and id, without numbers of the page's own."""
    if name in ("html", "body", *ARTICLE):
        return name
    classes = sorted({_OWN_NUMBER["class"].sub("#", x) for x in values.get("class", "").split()})
    return " ".join([name, *classes, _OWN_NUMBER["id"].sub("#", values.get("id", ""))])


def _is_apart(name: str, values: dict[str, str], in_article: bool) -> bool:
    """Whether an element and all below it is no article by its own markup."""
    if name == "header" and in_article:
        return False
    if name in NO_ARTICLE:
        return True
    if not values or name in ("html", "body", *ARTICLE):
        return False
    if values.get("role", "").lower() in ROLES or "hidden" in values:
        return True
    named = [values.get(k, "") for k in ("class", "id")]
    if in_article:
        return not INSIDE_NAMES.isdisjoint(" ".join(named).lower().split())
    return any(NAMES.search(x) or PAGE_NAMES.search(x) for x in named)


def page_tokens(html: str) -> tuple[list[tuple[int, int, bool]], list[tuple[str, int, bool, bool]]]:
    """Tokens of a page in order, and its candidate runs of text.

    Tokens are ``(token, place, is text)``, hashes of what stands under which path: an element is its own place, a text
    stands at the one around it. Runs are ``(text, place, in an article, plain)``, plain being what no element with a
    class or id sets off from the rest of its article.
    """
    # An open element: name, token, whether it or one around it is apart, lies in an article, is set off there.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    tokens: list[tuple[int, int, bool]] = []
    runs: list[tuple[str, int, bool, bool]] = []
    held: list[str] = []

    def close() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            level = next(x for x in reversed(stack) if x[0] not in INLINE)
            token = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), level[1]) >> 1
            tokens.append((token, level[1], True))
            if not stack[-1][2]:
                runs.append((text, level[1], level[3], level[3] and not level[4]))

    at, last, opened = 0, html.rfind(">"), Counter()
    while match := _LEX.match(html, at) if at <= last else None:
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            if not match[0].startswith(("<!", "<?")):
                held.append(entities.unescape(match[0]))
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if match[1]:
            if opened[name]:
                if name in INLINE:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name or stack[i][0] not in INLINE:
                            break
                    if stack[i][0] == name:
                        del stack[i]
                        opened[name] -= 1
                else:
                    while close() != name:
                        pass
            continue
        if name not in INLINE:
            while stack[-1][0] in INLINE:  # left open: formatting says nothing about blocks
                close()
            if stack[-1][0] in CLOSES.get(name, ()) or (stack[-1][0] == "p" and name not in VOID):
                close()
        parent = stack[-1]
        values = _attributes(match[3])
        token = xxhash.xxh64_intdigest(f"<{_kind(name, values)}>", parent[1]) >> 1
        if name not in INLINE:
            tokens.append((token, token, False))
        if name in VOID or match[3].endswith("/"):
            continue
        opens = name in ARTICLE and not parent[2]
        in_article = parent[3] or opens
        set_off = not opens and (parent[4] or "class" in values or "id" in values)
        stack.append((name, token, parent[2] or _is_apart(name, values, in_article), in_article, set_off))
        opened[name] += 1
        if name in RAW:
            end = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
            at = end.start() if end else len(html)
    # Behind the last ">" there is text, or a comment left open.
    rest = html[max(at, 0) :]
    held.append(entities.unescape(rest[: rest.find("<!--")] if "<!--" in rest else rest))
    flush()
    return tokens, runs


_TOKENS = pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int64()), ("is_text", pa.bool_())]))
_RUNS = pa.list_(pa.struct([("text", pa.string()), ("place", pa.int64()), ("main", pa.bool_()), ("plain", pa.bool_())]))


def _parse(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("url", pa.string()), ("page", pa.int64()), ("tokens", _TOKENS), ("runs", _RUNS)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for row in batch.slice(at, 200).to_pylist():
                    html = row["html"] or ""
                    tokens, runs = page_tokens(html)
                    out.append(
                        {
                            "id": row["id"],
                            "url": row["url"],
                            "page": xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass")) >> 1,
                            "tokens": [{"token": t, "place": p, "is_text": x} for t, p, x in dict.fromkeys(tokens)],
                            "runs": [{"text": t, "place": k, "main": m, "plain": q} for t, k, m, q in runs],
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema)

    return parse


def parsed_pages(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``(id, url, page, tokens, runs, host)``; ``page`` stands for the whole html, ``host`` for the url's host (null: an empty one)."""
    kind = pages.schema[key].dataType
    parsed = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(
        _parse(to_arrow_type(kind)),
        f"id {kind.simpleString()}, url string, page long, tokens array<struct<token:long,place:long,is_text:boolean>>, "
        "runs array<struct<text:string,place:long,main:boolean,plain:boolean>>",
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))
    return parsed.withColumn("host", F.md5(host))


def host_templates(parsed: DataFrame) -> DataFrame:
    """``(host, place, class, filled)``: the places that two or more different pages of a host hold.

    ``class`` is the element's equivalence class; ``filled`` says that all texts of the place are in it, too.
    """
    each = parsed.select("host", "page", F.inline("tokens"))
    # Equal sums of two 31-bit hashes of the pages that hold a token: equal vectors.
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "page"), F.lit((1 << 31) - 1)))
    vectors = each.groupBy("host", "place", "token", "is_text").agg(
        part(1).alias("v1"), part(2).alias("v2"), F.count(F.lit(1)).alias("support"), (F.min("page") < F.max("page")).alias("shared")
    )
    vector = F.struct("v1", "v2", "support")
    text = F.when(F.col("is_text"), vector)
    places = vectors.groupBy("host", "place").agg(
        F.max(F.when(~F.col("is_text"), vector)).alias("own"),
        F.bool_or(~F.col("is_text") & F.col("shared")).alias("shared"),
        F.min(text).alias("_low"),
        F.max(text).alias("_high"),
    )
    filled = (F.col("_low") == F.col("own")) & (F.col("_high") == F.col("own"))
    return places.where("shared").select("host", "place", F.xxhash64("own").alias("class"), F.coalesce(filled, F.lit(False)).alias("filled"))


def main_texts(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``key, url, text, n_chars`` of every row: the article's blocks in order, joined by an empty line.

    Inside an article only places that a class or id sets off can belong to the template: plain headings and paragraphs are
    the article. Where the template fills all that a page has (copies of one page), nothing is left to tell them by, and all
    candidates stay. Null or empty html has the empty text; a null url has no host, and such pages share one template; keys
    may be null or repeat; the page of a host with no other page has no template and keeps all candidates; an
    empty table gives an empty result; other columns are not looked at.
    """
    parsed = stage_table(parsed_pages(pages, html, url, key))
    filled = stage_table(host_templates(parsed).where("filled").select("host", "place"))
    template = filled.groupBy("host").agg(F.collect_set("place").alias("template"))
    part = F.pmod(F.xxhash64("page", "id"), F.lit(PARTS)).cast("int")
    article = F.filter("runs", lambda r: r["main"])
    candidates = F.when(F.size(article) > 0, article).otherwise(F.col("runs"))
    rows = parsed.select("id", "url", "host", candidates.alias("_runs"), part.alias("_part"))
    if filled.count() <= PLACES_AT_ONCE:
        rows = rows.join(F.broadcast(template), "host", "left")
    else:
        copies = template.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = rows.join(copies, ["host", "_part"], "left")
    slots = F.filter("_runs", lambda r: r["plain"] | F.coalesce(~F.array_contains("template", r["place"]), F.lit(True)))
    kept = F.when(F.size(slots) > 0, slots).otherwise(F.col("_runs"))
    return rows.select(
        F.col("id").alias(key), F.col("url").alias(url), F.array_join(F.transform(kept, lambda r: r["text"]), "\n\n").alias("text")
    ).withColumn("n_chars", F.char_length("text").cast("long"))
