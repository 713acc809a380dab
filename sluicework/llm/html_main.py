"""Main text of web pages: marked blocks, without what the pages of a host have in common.

1. A page becomes blocks of text in page order. Scripts, styles and other non-text, and whatever stands in
   navigation, page headers and footers, sidebars, forms, adverts, notices and reader comments (by
   element, role, class or id) is not part of any block. If the page marks its content (article, main,
   role=main, itemprop=articleBody), the blocks inside are its stream, else all blocks are.
2. The streams of all pages of a host, marked or not, are searched for strings of `LENGTH` words, and for whole
   blocks of any length, that stand on several distinct pages. A string of more words is a union of those of
   `LENGTH`, so suffixes in order of their first `LENGTH` words tell all that is covered.
3. Words covered by a string or block on at least `PAGES[marked]` distinct pages and `SHARE[marked]` of the host's distinct
   pages are removed; the other runs are kept. A mark is a near veto: an article is cut only where the
   greater part of a host's articles has the same words, as a promotion inside the article has.

Pages count as one if the least hash of their strings is the same, as it is for equal streams and with high
probability for nearly equal ones: copies and versions of an article don't make it boilerplate.

Suffixes are not all spread. Of each `LENGTH` words the four with the least hash are an anchor, the same one wherever the
string stands. Anchors are counted first; only strings with an anchor that is frequent enough are counted then,
which loses none. Counts are two-level aggregates with partial sums, so a footer on all pages of a very large host
needs no large group. A host's list of frequent strings is bounded by the mean length of its pages over the share.
Hosts and strings are known by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import text_of, written
from .language_id import parts

#: Words that a repeated string must have, and words of an anchor.
LENGTH, ANCHOR = 24, 4
#: By whether the page marks its content: distinct pages that must have a string, and their share of the host's distinct pages.
PAGES = {False: 3, True: 5}
SHARE = {False: 0.05, True: 0.5}

_ITEM = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content is no text of the page, up to their end tag.
_RAW = frozenset("script style title textarea noscript template iframe svg math object video audio canvas select xmp noembed noframes".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "tfoot thead tr ul".split())
#: Elements that can hold a zone; the others nest too irregularly in real pages to be followed.
_NESTS = frozenset(
    "address article aside blockquote body button details dialog dl div fieldset figure footer form header main menu nav ol "
    "search section span table ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OUT = frozenset("nav footer aside form menu dialog button search head".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Whole class or id tokens; a part of one, as in no-sidebar or has-banner, says something about a layout.
_OUT_NAMES = re.compile(
    r"(?:^|\s)(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|(?:site|page)-(?:header|footer|nav)|masthead|"
    r"ads?|adverts?|advertisement|ad-(?:slot|box|banner|unit|container|wrapper)|sponsor(?:ed)?|promo|banner|cookies?|cookie-(?:banner|notice|consent|bar)|consent|gdpr|"
    r"notice|alert|newsletter|newsletter-signup|subscribe|popup|pop-up|modal|overlay|share|sharing|share-(?:buttons|bar|links)|social|"
    r"social-(?:share|links|media)|related|related-(?:posts|articles|links)|recommended|comments?|comment-?(?:list|form|section)|comments-(?:area|section|list)|disqus|disqus_thread|"
    r"replies|reply|login|login-form|signup|signup-form|search-?form|search-box|widget|toolbar|pagination|pager|skip-?link|main-menu|nav-menu|nav-bar|main-nav|"
    r"side-?nav)(?:$|\s)", re.I)


_MARK = re.compile(r"<article\b|<main\b|\brole\s*=\s*[\"']?main\b|articlebody", re.I)
#: Names of zones whose articles are not those of the page.
_OTHERS = re.compile(r"(?:^|[-_\s])(?:comments?|comment-?\w+|disqus|repl(?:y|ies)|related|recommended|sidebar|side-?bar|promo|ads?|adverts?|advertisement|sponsor(?:ed)?|widget)(?:$|[-_\s])", re.I)


def _zone(tag: str, attributes: str, inside: bool) -> str:
    """What an element begins: "out", "never" (out, and so is every article in it), "main", "article" or nothing."""
    if not attributes.strip():
        pairs = {}
    else:
        pairs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = pairs.get("role", "").lower()
    names = f"{pairs.get('class', '')} {pairs.get('id', '')}"
    if tag in _OUT - {"form"} or role in _OUT_ROLES - {"form"}:
        return "never"
    if tag not in ("body", "article", "main") and _OUT_NAMES.search(names):
        return "never" if _OTHERS.search(names) else "out"
    if tag == "form" or role == "form" or (tag == "header" and not inside):
        return "out"
    if tag == "article" or pairs.get("itemprop", "").lower() == "articlebody":
        return "article"
    return "main" if tag == "main" or role == "main" else ""


def blocks_of(html: str) -> tuple[list[str], bool]:
    """(blocks of text in page order, whether the page marks them as its content).

    Blocks inside an article if there is one, else inside a main element, else all that no zone excludes. An article or
    a main element counts in an excluded zone too if the page has none outside, as a whole page may stand in one form.
    """
    found, marked = _blocks(html, False)
    if not any(marked.values()) and _MARK.search(html):
        inner, within = _blocks(html, True)
        if any(inner[kind] for kind in within if within[kind]):
            found, marked = inner, within
    for kind in ("article", "main"):
        if marked[kind] and (found[kind] or kind == "main" or not found["main"]):
            return found[kind], True
    return found[""], False


def _blocks(html: str, reopened: bool) -> tuple[dict[str, list[str]], dict[str, bool]]:
    """(blocks by zone, zones there are); `reopened`: a wrapper out of the text ends where an article or main begins."""
    found: dict[str, list[str]] = {"article": [], "main": [], "": []}
    marked = {"article": False, "main": False}
    stack: list[list[str]] = []
    tags, zones = Counter(), Counter()  # of the open elements
    outs: list[list[str]] = []  # open elements that are out, but not for good
    unclosed: set[str] = set()
    text: list[str] = []
    at = 0
    level = ""

    def close() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                found[""].append(block)
                if level:
                    found["main"].append(block)
                    if level == "article":
                        found["article"].append(block)

    while True:
        m = _ITEM.search(html, at)
        out = zones["out"] + zones["never"]
        if not out:
            piece = html[at:m.start() if m else len(html)]
            if piece:
                text.append(unescape(piece) if "&" in piece else piece)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = bool(m[1] or m[4])
        if tag in _RAW and not ends:
            stop = None if tag in unclosed else _RAW_ENDS[tag].search(html, at)
            if stop is not None:
                at = html.find(">", stop.start()) + 1 or len(html)
            elif tag in ("script", "style", "textarea", "title"):
                at = len(html)
            else:
                unclosed.add(tag)
            if not out:
                text.append(" ")
            continue
        if tag in _BLOCK:
            close()
        elif not out and (tag == "br" or tag in ("td", "th")):
            text.append(" ")
        if tag not in _NESTS and tag != "head":
            continue
        if not ends:
            zone = _zone(tag, m[3] or m[6] or "", bool(level))
            if zone in ("out", "never") and tag == "span":
                close()
            if reopened and out and zone in marked and not zones["never"]:
                while outs:
                    outs.pop()[1] = ""
                zones["out"] = 0
            stack.append([tag, zone])
            tags[tag] += 1
            zones[zone] += 1
            if zone == "out":
                outs.append(stack[-1])
            if zone in marked and not zones["out"] + zones["never"]:
                marked[zone] = True
                level = "article" if zones["article"] else "main"
        elif tags[tag]:
            while True:
                element = stack.pop()
                tags[element[0]] -= 1
                zones[element[1]] -= 1
                if element[1] == "out":
                    outs.pop()
                if element[0] == tag:
                    break
            level = "article" if zones["article"] else "main" if zones["main"] else ""
    close()
    return found, marked


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _words(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all blocks, place of each block's first word and the end); a block's last word is hashed as such."""
    hashes: list[int] = []
    starts = [0]
    for block in blocks:
        words = block.split()
        words[-1] += "\n"
        hashes += [xxhash.xxh3_64_intdigest(w) for w in words]
        starts.append(len(hashes))
    return np.array(hashes, np.uint64), np.array(starts, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _strings(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words that begin at each place."""
    n = max(0, len(words) - length + 1)
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total = total * np.uint64(0x100000001B3) + words[k:k + n]
    return _mixed(total)


def _anchors(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the anchors, hash at every place): the least of every `length` words, ties included."""
    hashes = _strings(words, ANCHOR)
    span = length - ANCHOR + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64), hashes
    least = np.lib.stride_tricks.sliding_window_view(hashes, span).min(axis=1)
    low = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    # a place is an anchor if the greatest of the least values of the windows around it is its own
    return np.flatnonzero(hashes == np.lib.stride_tricks.sliding_window_view(low, span).max(axis=1)), hashes


def _short_blocks(words: np.ndarray, starts: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
    """Places of the blocks of fewer than `length` words by their hash; longer ones are strings themselves."""
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a < length:
            found.setdefault(int(_strings(words[a:b], b - a)[0]) | 1, []).append((a, b))  # odd; anchors are kept even
    return found


def _class_of(words: np.ndarray) -> int:
    """What pages count as one by: the least hash of four words, or of all if there are fewer."""
    return int(_strings(words, min(ANCHOR, len(words))).min()) if len(words) else 0


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64), pa.int64())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in parts(batch.column(2)):
            part = batch.slice(a, b - a)
            blocks, marked = zip(*map(blocks_of, part.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), _signed([xxhash.xxh3_64_intdigest(host_of(u)) for u in part.column(1).to_pylist()]),
                _signed([_class_of(_words(x)[0]) for x in blocks]), pa.array(marked, pa.bool_()), pa.array(blocks, pa.list_(pa.string()))],
                ["page_id", "url", "host", "class", "marked", "blocks"])


def _spread(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(found) for _, _, found in rows]
    found = np.concatenate([f for _, _, f in rows] or [np.zeros(0, np.uint64)])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array([r[k] for r in rows], np.int64), sizes)) for k in (0, 1)] + [_signed(found)], ["host", "class", "string"])


def _anchors_and_blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every anchor and short block of a page once."""
        for batch in batches:
            rows = []
            for host, kind, blocks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words, starts = _words(blocks)
                places, hashes = _anchors(words, length)
                short = np.fromiter(_short_blocks(words, starts, length), np.uint64)
                rows.append((host, kind, np.unique(np.concatenate([hashes[places] & ~np.uint64(1), short]))))
            yield _spread(rows)
    return run


def _candidates(words: np.ndarray, frequent: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the strings of `length` words that have a frequent anchor."""
    places, hashes = _anchors(words, length)
    places = places[np.isin(hashes[places] & ~np.uint64(1), frequent)]
    near = np.zeros(max(0, len(words) - length + 1) + 1, np.int64)
    np.add.at(near, np.maximum(places - (length - ANCHOR), 0), 1)
    np.add.at(near, np.minimum(places + 1, len(near) - 1), -1)
    at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    return at, _strings(words, length)[at]


def _unsigned(values: list[int] | None) -> np.ndarray:
    return np.array(values or [], np.int64).view(np.uint64)


def _frequent_strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, kind, blocks, frequent in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows.append((host, kind, np.unique(_candidates(_words(blocks)[0], _unsigned(frequent), length)[1])))
            yield _spread(rows)
    return run


def kept_blocks(blocks: list[str], short: np.ndarray, strings: np.ndarray, length: int = LENGTH) -> list[str]:
    """The blocks without the short blocks and the strings whose hashes are given."""
    words, starts = _words(blocks)
    gone = np.zeros(len(words), bool)
    known = set(short.tolist())
    for value, places in _short_blocks(words, starts, length).items():
        if value in known:
            for a, b in places:
                gone[a:b] = True
    for p in np.flatnonzero(np.isin(_strings(words, length), strings)):
        gone[p:p + length] = True
    kept = []
    for k, block in enumerate(blocks):
        lost = gone[starts[k]:starts[k + 1]]
        if not lost.any():
            kept.append(block)
        elif not lost.all():
            kept.append(" ".join(w for w, g in zip(block.split(), lost) if not g))
    return kept


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, short, strings in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                texts.append("\n".join(kept_blocks(blocks, _unsigned(short), _unsigned(strings), length) if short or strings else blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])
    return run


def _frequent(rows: DataFrame, hosts: DataFrame, pages: dict[bool, int], share: dict[bool, float]) -> DataFrame:
    """(host, plain, veto): strings frequent enough to go from unmarked and from marked pages of the host."""
    counted = rows.dropDuplicates(["host", "class", "string"]).groupBy("host", "string").agg(F.count(F.lit(1)).alias("n"))
    enough = {m: (F.col("n") >= pages[m]) & (F.col("n") >= share[m] * F.col("pages")) for m in (False, True)}
    return counted.where(F.col("n") >= min(pages.values())).join(hosts, "host").where(enough[False] | enough[True]).groupBy("host").agg(
        F.collect_list(F.when(enough[False], F.col("string"))).alias("plain"), F.collect_list(F.when(enough[True], F.col("string"))).alias("veto"))


def main_text(pages: DataFrame, length: int = LENGTH, min_pages: dict[bool, int] = PAGES, min_share: dict[bool, float] = SHARE,
              page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every row of `pages`.

    A null html counts as empty and has an empty text. Pages whose url is null or has no :// share the
    empty host. Repeated rows get repeated results; other columns may have any name.

    Returns page_id, url, text (blocks joined by line feeds), n_chars (code points).
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_of(html).alias("html"))
    parsed = written(rows.mapInArrow(_parsed, "page_id long, url string, host long, class long, marked boolean, blocks array<string>"), compression="zstd")
    spread = "host long, class long, string long"
    streams = parsed.where(F.size("blocks") > 0)
    hosts = streams.select("host", "class").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min(min_pages.values()))
    # written, so that their size is known when they meet the pages: Spark broadcasts them only below its limit
    first = written(_frequent(streams.select("host", "class", "blocks").mapInArrow(_anchors_and_blocks(length), spread), hosts, min_pages, min_share))
    anchors = first.select("host", F.array_union("plain", "veto").alias("anchors"))
    strings = streams.join(anchors, "host").select("host", "class", "blocks", "anchors").mapInArrow(_frequent_strings(length), spread)
    second = _frequent(strings, hosts, min_pages, min_share)
    both = written(first.toDF("host", "plain_blocks", "veto_blocks").join(second.toDF("host", "plain_strings", "veto_strings"), "host", "left"))
    found = parsed.join(both, "host", "left").select(
        "page_id", "url", "blocks", *[F.when(F.col("marked"), F.col(f"veto_{k}")).otherwise(F.col(f"plain_{k}")).alias(k) for k in ("blocks", "strings")])
    return found.toDF("page_id", "url", "texts", "short", "strings").mapInArrow(_kept(length), "page_id long, url string, text string").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
