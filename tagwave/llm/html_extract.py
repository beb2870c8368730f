"""Main text of web pages by nearest-URL page differencing (operator 1).

1. *Lines.* A page's markup is read into text lines (one per block element or line break), leaving out scripts,
   styles, comments, menus, headers, footers, sidebars, forms, and elements whose class, id or
   role names page furniture (adverts, notices, reader comments ..). Character references are
   decoded; white space becomes single spaces.
2. *Pairs.* Pages are ranked by URL path within their host by a distributed ordered scan, so a host with a third of
   all pages lies in no single task. The partner is the neighbour in that order with the longer
   common path.
3. *Differencing.* The two pages' lines are aligned by longest common subsequence and the shared
   lines deleted. A neighbour that shares ``COPY`` or more of the page's text is a copy of the page, not a
   page of the same template; then the other neighbour is the partner, or else nothing is deleted.
4. *Arbitration.* Every page is differenced. Where it declares its article (``article``, else ``main``) and differencing
   leaves text in it, the declared lines are the text: paragraphs that two articles share are content. A declared article that the
   pages before and after have whole, though they are no copies of the page, is furniture; then differencing alone decides.

Null html gives an empty text; a null URL has the empty host and path. Broken markup (open or
crossed elements, cut pages) is read as far as it goes: an element left out ends with its end tag, with the element around it, where
HTML lets its end tag be missing, or where an article opens. Equal URLs are ordered by a hash of the
row; repeated rows give equal texts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import ordered_scan
from .common import written

COPY = 0.8
LCS_BITS = 2**28  # rows kept of one alignment: 32 MB

#: fixed values: elements of HTML without readable text, of page furniture, and inside a line
_RAW = frozenset("script style noscript template svg math iframe object textarea select title head".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog button".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: words in class, id or role that name page furniture
_HINTS = frozenset("ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments "
                   "consent cookie cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation "
                   "newsletter notice notices pager pagination popup promo promoted promotion related reply replies "
                   "search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget "
                   "complementary contentinfo".split())

#: fixed values: a start tag ends the nearest open element of the first set, unless one of the second lies between
_P = (frozenset(["p"]), frozenset("table td th caption button".split()))
_LISTS = frozenset("ul ol menu dl table td th caption button article section main aside nav header footer blockquote".split())
_ENDS = {name: [_P] for name in "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 "
         "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
_ENDS |= {"li": [(frozenset(["li"]), _LISTS), _P], "tr": [(frozenset(["tr"]), frozenset(["table"]))]}
_ENDS |= dict.fromkeys(("dt", "dd"), [(frozenset(["dt", "dd"]), _LISTS), _P])
_ENDS |= dict.fromkeys(("td", "th"), [(frozenset(["td", "th"]), frozenset(["tr", "table"]))])
_ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), [(frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))])
_TABLE = frozenset("tr td th tbody thead tfoot caption".split())
_CELLS = frozenset("table td th caption".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _nearest(names: list[str], targets: frozenset[str], barrier: frozenset[str]) -> int:
    """Place of the last of ``names`` in ``targets`` with none of ``barrier`` after it, else their number."""
    for i in range(len(names) - 1, -1, -1):
        if names[i] in targets:
            return i
        if names[i] in barrier:
            break
    return len(names)


def _cut(names: list[str], name: str, opens: bool) -> int:
    """How many of the open elements stay open at a tag: end tags may be optional, missing or stray."""
    if opens:
        return min((_nearest(names, *rule) for rule in _ENDS.get(name, ())), default=len(names))
    if name not in names:
        return len(names)
    if name in _INLINE:
        i = len(names) - 1
        while names[i] != name and names[i] in _INLINE:
            i -= 1
        return i if names[i] == name else len(names)
    barrier = frozenset() if name in ("table", "body", "html") else frozenset(["table"]) if name in _TABLE else _CELLS
    return _nearest(names, frozenset([name]), barrier)


def _closed_later(page: str, at: int, name: str, depth: int) -> bool:
    """Whether the rest of the page has the end tags of ``depth`` open elements of a name."""
    tags = re.findall(rf"<(/?){re.escape(name)}(?=[\s/>])", page[at:], re.I)
    return sum(1 if t else -1 for t in tags) >= depth


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(line, zone) in page order; zone 2: in a declared article, 1: in ``main``, 0: elsewhere.
    Lines of page furniture are left out."""
    page = page or ""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    depth = {"article": 0, "main": 0}
    names: list[str] = []  # open elements
    skip, base, at = "", 0, 0  # base: the skipped element's place among them

    def close() -> None:
        line = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if line:
            out.append((line, 2 if depth["article"] else 1 if depth["main"] else 0))

    end = len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            if not skip:
                words.append(page[at:])
            break
        if not skip:
            words.append(page[at:tag.start()])
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        opens = not tag.group(1)
        kept = _cut(names, name, opens)
        if skip and kept <= base:
            own = not opens and kept == base
            skip = ""
            if own:
                del names[kept:]
                continue
        if skip and opens and name in depth and not depth["article"]:
            # an article opens: the furniture before it was never closed, unless it holds more articles after the page's own
            if skip in _FURNITURE or not any(zone for _, zone in out) or not _closed_later(
                    page, at, skip, names[base:].count(skip)):
                skip = ""
        del names[kept:]
        if opens and name not in _VOID and name not in _RAW:
            names.append(name)
        if skip:
            if opens and name in _RAW:
                found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = found.start() if found else end
            continue
        if name not in _INLINE:
            close()
        if opens and name in _RAW and not (name == "head" or tag.group(3).rstrip().endswith("/")):
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if name in depth:
            depth[name] = max(0, depth[name] + (1 if opens else -1))
        if opens and name not in _VOID and name not in ("html", "body", "head"):
            inside = depth["article"] - (name == "article") > 0
            furniture = name in _FURNITURE and not (name == "header" and inside)
            if not furniture and "=" in tag.group(3):
                named = " ".join("".join(m) for m in _NAMES.findall(tag.group(3))).lower()
                hints = _HINTS.intersection(_SPLIT.split(named))
                furniture = bool(hints - {"header"} if inside else hints)
            if furniture:
                if name in depth:
                    depth[name] -= 1
                skip, base = name, len(names) - 1
    close()
    return out


def shared_lines(page: list[int], other: list[int]) -> list[bool]:
    """Which lines of ``page`` lie on a longest common subsequence with ``other``; lines that only one of them has play no part."""
    both = set(page) & set(other)
    out, at = [False] * len(page), [i for i, x in enumerate(page) if x in both]
    for i, s in zip(at, _aligned([page[i] for i in at], [x for x in other if x in both])):
        out[i] = s
    return out


def _prefix_lengths(page: list[int], other: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``page`` with each prefix of ``other``."""
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | (1 << j)
    full = v = (1 << len(other)) - 1
    for x in page:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(other)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(page: list[int], other: list[int]) -> list[bool]:
    """``shared_lines`` by bit-parallel rows (one bit per line of ``other``) that are kept to walk the alignment back;
    above ``LCS_BITS`` of them, ``page`` is halved and ``other`` cut where both halves' alignments are longest together."""
    if len(page) > 1 and len(page) * len(other) > LCS_BITS:
        half = len(page) // 2
        cut = int(np.argmax(_prefix_lengths(page[:half], other) + _prefix_lengths(page[half:][::-1], other[::-1])[::-1]))
        return _aligned(page[:half], other[:cut]) + _aligned(page[half:], other[cut:])
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(other)) - 1
    rows, v = [], full
    for x in page:
        rows.append(v)
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    rows.append(v)
    out, j = [False] * len(page), len(other)
    length = lambda row, j: j - (row & ((1 << j) - 1)).bit_count()  # noqa: E731  of the LCS with other[:j]
    for i in range(len(page) - 1, -1, -1):
        while j and length(rows[i + 1], j - 1) == length(rows[i + 1], j):
            j -= 1
        if j and length(rows[i], j) < length(rows[i + 1], j):
            out[i] = True
            j -= 1
    return out


def difference(sizes: list[int], hashes: list[int], inside: list[bool], partners: list[list[int]]) -> tuple[bool, list[bool]]:
    """Whether the declared lines (``inside``) stand, and which lines are not shared with the first partner that is no copy
    of the page. ``sizes`` are the lines' lengths."""
    total, shared = sum(sizes), []
    for other in partners:
        marks = shared_lines(hashes, other)
        if sum(n for n, s in zip(sizes, marks) if s) < COPY * total:
            shared.append(marks)
            if not any(inside) or not all(s for s, x in zip(marks, inside) if x):
                break  # the declared lines stand: no need for the other side
    # one neighbour with the same article may be a repost; two are a template
    declared = any(inside) and not (len(shared) > 1 and all(s for m in shared for s, x in zip(m, inside) if x))
    return declared, [not s for s in shared[0]] if shared else [True] * len(sizes)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    page, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    address = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    given = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"),
                         F.xxhash64(F.col(id_col).cast("string"), url, page).alias("key"),
                         F.lower(F.regexp_extract(address, "^([^/?#]*)", 1)).alias("host"),
                         F.regexp_extract(address, "^[^/?#]*([^#]*)", 1).alias("path"), page.alias("html"))

    def read(batches):
        for batch in batches:
            texts, all_lines, all_hashes, all_sizes, all_inside = [], [], [], [], []
            for source in batch.column(5):
                found = page_lines(source.as_py())
                top = max((zone for _, zone in found), default=0)
                texts.append(" ".join(x for x, zone in found if zone == top) if top or not found else None)
                all_lines.append([x for x, zone in found if not top or zone != top])
                all_hashes.append([xxhash.xxh64_intdigest(x) - 2**63 for x, _ in found])
                all_sizes.append([len(x) for x, _ in found])
                all_inside.append([top > 0 and zone == top for _, zone in found])
            yield pa.record_batch([*batch.columns[:5], pa.array(texts, pa.string()), pa.array(all_lines, pa.list_(pa.string())),
                                   pa.array(all_hashes, pa.list_(pa.int64())), pa.array(all_sizes, pa.list_(pa.int32())),
                                   pa.array(all_inside, pa.list_(pa.bool_()))],
                                  names=[*batch.schema.names[:5], "text", "lines", "hashes", "sizes", "inside"])

    parsed = written(given.mapInArrow(read, "page_id bigint, url string, key bigint, host string, path string, "
                                            "text string, lines array<string>, hashes array<bigint>, sizes array<int>, "
                                            "inside array<boolean>"), "pages")
    # place of each page in its host's path order, then the pages before and after it
    order = [F.col("path"), F.col("key")]
    distinct = parsed.select("key", "host", "path").distinct()
    ranked = written(ordered_scan(distinct, order, ["host"], rank="place"), "places")
    near = parsed.select("key", "hashes", "sizes", "inside").dropDuplicates(["key"]).join(ranked, "key")
    before = near.select("host", (F.col("place") + 1).alias("place"), F.col("path").alias("path_b"), F.col("hashes").alias("b"))
    after = near.select("host", (F.col("place") - 1).alias("place"), F.col("path").alias("path_a"), F.col("hashes").alias("a"))
    paired = (near.join(before, ["host", "place"], "left").join(after, ["host", "place"], "left")
              .select("key", "path", "hashes", "sizes", "inside", "path_b", "b", "path_a", "a"))

    def judge(batches):
        for batch in batches:
            keys, kept = [], []
            for r in batch.to_pylist():
                sides = [(r["path_b"], r["b"]), (r["path_a"], r["a"])]
                sides = sorted((x for x in sides if x[1] is not None), key=lambda x: -_common(r["path"], x[0]))
                declared, own = difference(r["sizes"], r["hashes"], r["inside"], [x[1] for x in sides])
                if not declared:  # the places among the lines that are stored
                    keys.append(r["key"])
                    kept.append([o for o, x in zip(own, r["inside"]) if not x])
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(kept, pa.list_(pa.bool_()))], names=["key", "kept"])

    # pages whose declared lines stand have their text already: only the others' lines travel
    judged = written(paired.mapInArrow(judge, "key bigint, kept array<boolean>"), "differences")
    own = F.array_join(F.filter("lines", lambda _, i: F.get("kept", i)), " ")
    return (parsed.join(judged, "key", "left")
            .select("page_id", "url", F.when(F.col("kept").isNull(), F.col("text")).otherwise(own).alias("text"))
            .withColumn("n_chars", F.length("text").cast("bigint")))
