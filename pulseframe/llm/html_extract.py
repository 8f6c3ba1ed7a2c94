"""Main text of web pages by differencing pages of near URLs, and by the markup's own regions.

Pages are sorted by host and URL path over range partitions; a page's partners are the nearest pages before and after
it in that order, on the same host, whose open lines are others than its own. Where a range ends, the pages that stand
there come from the ranges beside it. Lines (one for each block) are aligned by longest common subsequence and shared lines go, for those
lines whose region the markup leaves open. Lines in regions that say what they are (menus, headers, footers, asides,
forms, adverts, notices, comments) always go, and lines of an article or main element always stay: copies of an
article under near URLs share its lines too, and chrome that differs on each page shares none.

Defined cases: null html is empty and gives an empty text; a null or malformed url counts as an empty host; repeated
rows are extracted alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import map_batches, map_groups, staged, table

# fixed values: elements of HTML
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form menu dialog button select input label search fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id, between other characters than letters, that name a region beside the article.
CHROME_WORD = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|footer|sidebar|side|related|share|sharing|social|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|replies|disqus|widget|pagination|pager|toolbar|masthead|skip)(?:$|[^a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")

#: Bytes of html in one range of neighbours, about.
RANGE_BYTES = 8e6
#: Most ranges: the driver holds 20 keys for each while it cuts. Beyond so many, ranges grow; a task streams its range.
MOST_RANGES = 50_000
#: What a region says of its lines.
OPEN, MAIN, BESIDE = 0, 1, 2


def region(name: str, attributes: str, within: int) -> int:
    """Of an element's content, given the region around it."""
    if within == BESIDE:
        return BESIDE
    if within == MAIN and name in ("header", "label", "button", "select", "input"):
        return MAIN if name == "header" else BESIDE
    if name in CHROME:
        return BESIDE
    if attributes:
        for m in MARKS.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return BESIDE
            if key == "role" and value in CHROME_ROLES:
                return BESIDE
            if key == "role" and value in ("main", "article"):
                return MAIN
            if key in ("class", "id") and name not in ("html", "body", "article", "main") and CHROME_WORD.search(value):
                return BESIDE
    return MAIN if name in ("article", "main") else within


def lines(page: str | None) -> list[tuple[int, str]]:
    """(region, text) of each block with text, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    now, text, page, at = OPEN, [], page or "", 0

    def flush() -> None:
        if text:
            line = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((now, line))

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            if m[4]:
                text.append(m[4])
            continue
        name = m[2].lower()
        if not m[1] and name in RAW:
            if not m[3].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                # its content is not markup; a head also ends where the body begins
                end = re.compile(rf"</{name}\b[^>]*>?" + (r"|(?=<body\b)" if name == "head" else ""), re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS or name in CHROME:
            flush()
        if m[1]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                now = stack[-1][1] if stack else OPEN
        elif name not in VOID:
            after = region(name, m[3], now)
            if after != now:
                flush()
            # a paragraph ends an open one, an item an open one: their end tags may be left out
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
            stack.append((name, after))
            now = after
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indices in a of a longest common subsequence of a and b.

    Bit-parallel: after each line of b, a number has a 0 at every place of a where the longest subsequence so far grows.
    Numbers are kept at every step-th line only and made again on the way back, so that long pages need little memory.
    """
    known = set(b)
    keep = [i for i, x in enumerate(a) if x in known]
    seen = set(a)
    right = [x for x in b if x in seen]
    at: dict[str, list[int]] = {}
    for i, k in enumerate(keep):
        at.setdefault(a[k], []).append(i)
    masks = {x: sum(1 << i for i in places) if len(places) < 64 else int.from_bytes(np.packbits(np.bincount(places, minlength=len(keep)).astype(bool), bitorder="little").tobytes(), "little") for x, places in at.items()}
    every = (1 << len(keep)) - 1

    def states(start: int, lines: list[str]) -> list[int]:
        out = [start]
        for x in lines:
            u = out[-1] & masks[x]
            out.append(((out[-1] + u) | (out[-1] - u)) & every)
        return out

    step = max(1, math.isqrt(len(right)))
    marks = [every]
    for j in range(0, len(right), step):
        marks.append(states(marks[-1], right[j : j + step])[-1])
    out, i, j, rows, low = set(), len(keep), len(right), [], len(right)
    while i and j:
        if j <= low:
            low = (j - 1) // step * step
            rows = states(marks[low // step], right[low:j])
        if rows[j - low] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if rows[j - low] >> (i - 1) & 1 or not j:
                i -= 1
                out.add(keep[i])
    return out


def open_lines(own: list[tuple[int, str]]) -> list[str]:
    return [line for kind, line in own if kind == OPEN]


def main_text(own: list[tuple[int, str]], partners: list[list[str]]) -> str:
    """Lines of the main region and the open lines that no partner shares, joined by one space. partners: their open lines."""
    open_at = [i for i, (kind, _) in enumerate(own) if kind == OPEN]
    mine = open_lines(own)
    gone: set[int] = set()
    for theirs in partners:
        if theirs and theirs != mine:  # a copy of the page says nothing about it
            gone |= {open_at[i] for i in shared(mine, theirs)}
    return " ".join(line for i, (kind, line) in enumerate(own) if kind != BESIDE and i not in gone)


def edge_pages(light: DataFrame) -> DataFrame:
    """range, host, path, place of the pages of other ranges that are partners in a range: at most two on each side of it.

    light: range, host, path, place, mark (a digest of the open lines) of pages with open lines. A host comes down to
    a row for each range that it lies in before its ranges meet in one task.
    """
    at, by = F.struct("path", "place", "mark"), ["range", "host"]
    ends = light.groupBy(*by).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    inner = light.join(ends, by).groupBy(*by).agg(F.min(F.when(F.col("mark") != F.col("first.mark"), at)).alias("second"), F.max(F.when(F.col("mark") != F.col("last.mark"), at)).alias("prior"))
    ends = ends.join(inner, by)
    sides = [F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("first", "second", "last", "prior") for f in ("path", "place", "mark")]

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        rows = rows.sort_values("range")
        for order, near, far in ((rows, "last", "prior"), (rows[::-1], "first", "second")):
            one = two = None  # the nearest page so far, and the nearest with other open lines
            for r in order.to_dict("records"):
                found += [(r["range"], r["host"], p[0], p[1]) for p in (one, two) if p]
                at_end, other = (tuple(r[f"{c}_{f}"] for f in ("path", "place", "mark")) for c in (near, far))
                if isinstance(other[0], str):
                    two = other
                elif one and one[2] != at_end[2]:
                    two = one
                one = at_end
        return pd.DataFrame(found, columns=["range", "host", "path", "place"]).astype({"range": "int64"})

    # decimal text keeps whole numbers whole where a column has nulls
    texts = [c.cast("string") for c in (F.col(f"{x}_{f}") for x in ("first", "second", "last", "prior") for f in ("path", "place", "mark"))]
    flat = ends.select(*by, *sides)
    flat = flat.select(*by, *[t.alias(n) for t, n in zip(texts, flat.columns[2:], strict=True)])
    out = map_groups(flat, ["host"], carry, "range long, host string, path string, place string")
    return out.select("range", "host", "path", F.col("place").cast("long").alias("place")).distinct()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("place", F.coalesce("page_id", F.lit(-1).cast("long")))
    size, count = rows.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    ranges, order = min(MOST_RANGES, int((size or 0) // RANGE_BYTES) + 1), ["host", "path", "place"]
    every = max(1, count // (ranges * 20))
    keys = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("place", "url"), F.lit(every)) == 0).select(*order).collect()] if ranges > 1 else []
    keys.sort()
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    ship(pages.sparkSession)

    @F.pandas_udf("long")
    def range_of(hosts: pd.Series, paths: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in zip(hosts, paths, places, strict=True)], dtype="int64")

    rows = rows.withColumn("range", range_of(*order) if cuts else F.lit(0).cast("long")).withColumn("edge", F.lit(False))
    names = ["page_id", "url", "html", "host", "path", "place", "range", "edge"]
    near = rows.select(*names)

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for page in b.column(4).to_pylist():
                mine = open_lines(lines(page))
                marks.append(int.from_bytes(hashlib.blake2b("\n".join(mine).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if mine else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(marks, pa.int64())], ["range", "host", "path", "place", "mark"])

    if cuts:
        marked = map_batches(rows.select("range", "host", "path", "place", "html"), light, "range long, host string, path string, place long, mark long").where("mark is not null")
        edges = staged(edge_pages(staged(marked, "open-pages")), "edge-pages")
        if not edges.isEmpty():
            beside = rows.drop("range", "edge").join(edges, order).withColumn("edge", F.lit(True))
            near = near.union(beside.select(*names))
    near = near.repartitionById(len(cuts) + 1, F.col("range").cast("int")).sortWithinPartitions("range", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, now, held, found = None, None, None, [], []  # held: pages whose open lines are now

        def settle(after: list[str] | None) -> None:
            found.extend((page_id, url, main_text(own, [x for x in (before, after) if x])) for page_id, url, own in held)
            held.clear()

        def out():
            ids, urls, texts = zip(*found, strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        for b in batches:
            for page_id, url, page, place, edge in zip(*(b.column(i).to_pylist() for i in range(3)), zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True), b.column(5).to_pylist(), strict=True):
                own = lines(page)
                mine = open_lines(own)
                if place != at:
                    settle(None)
                    at, before, now = place, None, None
                if not mine:
                    if not edge:
                        found.append((page_id, url, main_text(own, [])))
                    continue
                if mine != now:
                    settle(mine)
                    before, now = now, mine
                if not edge:
                    held.append((page_id, url, own))
            if found:
                yield out()
        settle(None)
        if found:
            yield out()

    done = map_batches(near.select("page_id", "url", "html", "host", "range", "edge"), run, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op5_near_url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
