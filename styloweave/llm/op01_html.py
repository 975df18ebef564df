"""Main text of pages: differencing against the page of nearest URL, within the page's own marks.

Pages of a host are ordered by URL path; each is paired with the neighbour that shares the longer
path prefix. Their text lines (blocks) are aligned by longest common subsequence, and lines that
both have are template and deleted. What a page marks itself decides first: blocks of navigation,
forms, comments and the like never are text, and blocks of an `article` (or, on a page without one,
of `main`) always are, as copies of an article and shared passages are not template. Differencing
decides for the rest: all of a page that marks no main part, and on a page with an article the rest
of `main`, or without `main` what lies around the article, if the neighbour shares some line and so
its template. A page whose lines all recur in its neighbour, or whose articles do, is a copy of it;
then nothing is deleted.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.ordering import with_neighbours
from styloweave.llm.storage import stored

RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in
       "script style noscript template iframe svg math object textarea title select".split()}
SELF_CLOSING = frozenset(("svg", "math"))
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_TO_VALUE = re.compile(r"[^>=]*+")
_BLANKS = re.compile(r"\s*+")
_BARE = re.compile(r"[^\s>]*+")
ATTRIBUTE = re.compile(r"([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
BLOCK = frozenset("html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
                  "section article main nav header footer aside form fieldset legend figure figcaption blockquote pre "
                  "address hr details summary dialog menu option center".split())
HELD = BLOCK - frozenset("hr option".split()) | {"button", "label", "span", "a", "ins"}
#: Elements that end where the next block begins, closed or not.
BRIEF = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())
ASIDE_TAGS = frozenset("head nav footer aside form menu dialog button label".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                        "menubar toolbar".split())
ASIDE_WORDS = frozenset("nav navbar navigation menu masthead footer sidebar breadcrumb breadcrumbs ad ads advert "
                        "adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies "
                        "consent gdpr notice popup modal newsletter subscribe subscription signup login alert "
                        "notices overlay topbar subnav reply responses discussion search comment comments disqus replies respond share sharing social related widget toolbar "
                        "pagination pager".split())
ASIDE_STEMS = ("advert", "breadcrumb", "comment", "consent", "cookie", "disqus", "footer", "masthead", "navbar",
               "newsletter", "pagina", "popup", "promo", "recommend", "sidebar", "sponsor", "subscri")
#: Words that inside an article as often name a part of its text.
DOUBTFUL_WORDS = frozenset("consent discussion reply responses search subscription".split())
#: Elements that hold comments by their id; ids of others come from headings.
LIST_TAGS = frozenset("div ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = frozenset(("header", "banner"))
COMMENT_WORDS = frozenset(("comment", "comments", "reply", "replies"))


def _tag_end(source: str, at: int, last: int) -> int:
    """Index of the `>` that closes a tag whose attributes begin at `at`; the last one of the page is at `last`.

    Quotes count only around a value. A quote that is never closed counts as an ordinary character.
    """
    while True:
        at = _TO_VALUE.match(source, at).end()
        if source[at] == ">":
            return at
        at = _BLANKS.match(source, at + 1).end()
        if source[at] in "\"'":
            close = source.find(source[at], at + 1)
            at = close + 1 if 0 <= close < last else at + 1
        else:
            at = _BARE.match(source, at).end()


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, `/` of a closing tag, lower-case name, attributes) of the markup; no name: comments and the like.

    Elements without text of the page (scripts, styles, drawings) are one piece up to their closing tag, or to the page's end.
    Each step begins where the last one ended, and what can't be closed any more ends the scan, so it is
    linear in the page, cut-off pages included.
    """
    at, last = 0, source.rfind(">")
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            close = source.find("-->", start + 4)
            at = close + 3 if close >= 0 else len(source)
            yield start, at, "", "", ""
            continue
        if start > last:        # no tag can end; only a comment may still begin
            at = source.find("<!--", start)
            if at < 0:
                return
            continue
        follows = source[start + 1]
        if follows in "!?":
            at = source.find(">", start) + 1
            yield start, at, "", "", ""
            continue
        closing = "/" if follows == "/" else ""
        name = NAME.match(source, start + 1 + len(closing))
        if not name:
            at = start + 1
            continue
        end = _tag_end(source, name.end(), last)
        tag, attributes, at = name[0].lower(), source[name.end():end], end + 1
        if not closing and tag in RAW:
            if not (tag in SELF_CLOSING and attributes.endswith("/")):
                close = RAW[tag].search(source, at)
                at = close.end() if close else len(source)
            yield start, at, "", "", ""
        else:
            yield start, at, closing, tag, attributes


def _mark(tag: str, attributes: str, in_main: bool) -> str:
    """What an element marks itself as: aside, or inside a main part doubt, or nothing.

    Inside a main part ids (made from headings) and stems raise doubt only, and the neighbouring page decides.
    """
    if tag in ASIDE_TAGS or tag == "header" and not in_main:
        return "aside"
    if not attributes.strip():
        return ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" \
            or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "aside"
    if set(found.get("role", "").lower().split()) & ASIDE_ROLES:
        return "aside"
    if tag in ("html", "body", "main"):
        return ""
    classes, ids = (set(re.split(r"[^a-z0-9]+", found.get(k, "").lower())) for k in ("class", "id"))
    words = classes | ids
    if tag == "article":
        return "aside" if words & COMMENT_WORDS else ""
    named = words & ASIDE_WORDS or any(w.startswith(ASIDE_STEMS) and w != "commentary" for w in words)
    if not in_main:
        return "aside" if named or words & HEADER_WORDS else ""
    name = re.split(r"[^a-z0-9]+", found.get("id", "").lower())
    if classes & (ASIDE_WORDS - DOUBTFUL_WORDS) or tag not in HEADINGS and name[0] in COMMENT_WORDS \
            and len(name) <= 1 + (tag in LIST_TAGS):
        return "aside"
    return "doubt" if named else ""


def page_blocks(text: str | None) -> list[tuple[str, str]]:
    """(text, zone) of each text block; zone is aside, doubt, article, main or open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = [("", "open")]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                out.append((joined, stack[-1][1]))
            parts.clear()

    at, source, depth = 0, text or "", Counter()
    for start, end, closing, tag, attributes in tags(source):
        if start > at:
            parts.append(html.unescape(source[at:start]))
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag not in HELD or attributes.endswith("/"):
            continue
        if not closing and tag in BLOCK and len(stack) > 1 and stack[-1][0] in BRIEF:
            depth[stack.pop()[0]] -= 1
        zone = stack[-1][1]
        if closing:
            if depth[tag] > 0:      # else nothing is open that it could close
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if any(z != stack[i - 1][1] for _, z in stack[i:]):
                    flush()
                depth.subtract(t for t, _ in stack[i:])
                del stack[i:]
            continue
        if zone != "aside":
            mark = _mark(tag, attributes, zone in ("article", "main", "doubt"))
            if mark:
                flush()
                zone = mark
            elif tag == "article":
                zone = "article"
            elif (tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes)) and zone == "open":
                zone = "main"
        stack.append((tag, zone))
        depth[tag] += 1
    parts.append(html.unescape(source[at:]))
    flush()
    return out


def common_lines(a: list, b: list) -> np.ndarray:
    """Which lines of `a` lie in a longest common subsequence with `b` (in memory linear in both)."""
    kept = np.zeros(len(a), bool)
    _align(a, b, 0, kept)
    return kept


def _rows(a: list, b: list) -> list[int]:
    """Bit rows of the LCS table of `a` over `b`: bit j of row i is 0 where the length grows at j."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, [full]
    for line in a:
        met = row & places.get(line, 0)
        row = ((row + met) | (row - met)) & full
        out.append(row)
    return out


def _lengths(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _align(a: list, b: list, base: int, kept: np.ndarray) -> None:
    if not a or not b:
        return
    if len(a) * len(b) > 1 << 26 and len(a) > 1:
        half = len(a) // 2
        front = _lengths(_rows(a[:half], b)[-1], len(b))
        back = _lengths(_rows(a[half:][::-1], b[::-1])[-1], len(b))[::-1]
        cut = int(np.argmax(front + back))
        _align(a[:half], b[:cut], base, kept)
        _align(a[half:], b[cut:], base + half, kept)
        return
    rows, j = _rows(a, b), len(b)
    for i in range(len(a), 0, -1):
        # move left while the length stays, then take line i where row i has the step and row i - 1 not
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if j and rows[i - 1] >> (j - 1) & 1 and a[i - 1] == b[j - 1]:
            kept[base + i - 1] = True
            j -= 1


def outline(blocks: list[tuple[str, str]]) -> list[int]:
    """Hashes of the lines outside articles, and last one hash of all article text, if there is any."""
    lines = [line_hash(t) for t, z in blocks if z != "article"]
    own = "\n".join(t for t, z in blocks if z == "article")
    return [*lines, line_hash("article\n" + own)] if lines and own else lines


def main_text(blocks: list[tuple[str, str]], neighbour: list[int] | None) -> str:
    """Join the blocks that are text, given the outline of the neighbouring page."""
    zones = {z for _, z in blocks}
    lines = [i for i, (_, z) in enumerate(blocks) if z != "article"]
    shared: set[int] = set()
    if neighbour is not None and lines:
        own = outline(blocks)
        hit = common_lines(own[:len(lines)], list(neighbour))
        shared = {i for i, h in zip(lines, hit) if h}
        if "article" in zones and own[-1] in neighbour:  # a copy of its neighbour
            shared = set()
    if "article" in zones or "doubt" in zones and "main" not in zones:
        rest = "main" if "main" in zones else "open" if shared else ""
        return " ".join(t for i, (t, z) in enumerate(blocks) if z == "article" or z in (rest, "doubt") and i not in shared)
    if "main" in zones:
        return " ".join(t for i, (t, z) in enumerate(blocks) if z == "main" or z == "doubt" and i not in shared)
    own = [i for i, (_, z) in enumerate(blocks) if z == "open"]
    if shared.issuperset(own):  # a copy of its neighbour
        shared = set()
    return " ".join(blocks[i][0] for i in own if i not in shared)


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) >> 1


def _outlines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines outside an article, as hashes, and the parts of the URL."""
    for frame in frames:
        parts = [re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)", u or "").groups()
                 for u in frame["url"]]
        yield pd.DataFrame({
            "page_key": frame["page_key"], "host": [h.lower() for h, _ in parts], "path": [p for _, p in parts],
            "lines": [outline(page_blocks(x)) for x in frame["html"]]})


def _nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The neighbour of the same host whose path shares the longer prefix."""
    def score(host, path, other_host, other_path) -> int:
        if other_host is None or other_host != host:
            return -1
        n = 0
        for x, y in zip(path, other_path):
            if x != y:
                break
            n += 1
        return n

    for f in frames:
        picked = []
        for r in f.itertuples():
            before = score(r.host, r.path, r.prev_host, r.prev_path)
            after = score(r.host, r.path, r.next_host, r.next_path)
            if max(before, after) >= 0:
                picked.append((r.page_key, r.prev_page_key if before >= after else r.next_page_key))
        yield pd.DataFrame(picked, columns=["page_key", "other"])


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts = [main_text(page_blocks(x), n) for x, n in zip(f["html"], f["lines"])]
        yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": texts,
                            "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars.

    Null or empty html gives an empty text. A null URL is a page of the host ''. A page alone on
    its host (or with no other page that has lines) is not differenced. Repeated rows give equal results. Other columns are not carried.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html")) \
        .withColumn("page_key", F.xxhash64("page_id", "url", "html").cast("string"))
    outlines = rows.select("page_key", "url", "html").mapInPandas(
        _outlines, "page_key string, host string, path string, lines array<long>").dropDuplicates(["page_key"])
    outlines = stored(outlines)
    placed = with_neighbours(outlines.where(F.size("lines") > 0).select("host", "path", "page_key"), ["host", "path", "page_key"],
                             ["host", "path", "page_key"])
    pairs = placed.mapInPandas(_nearest, "page_key string, other string")
    lines = pairs.join(outlines.select(F.col("page_key").alias("other"), "lines"), "other").select("page_key", "lines")
    return rows.join(lines, "page_key", "left").select("page_id", "url", "html", "lines") \
        .mapInPandas(_texts, "page_id long, url string, text string, n_chars long")
