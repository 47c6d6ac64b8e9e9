"""Main text of web pages by site style trees."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import stored, table

# Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
NO_CONTENT = frozenset("audio button canvas datalist dialog embed footer form head iframe input map math menu meter nav noscript object optgroup option progress script select style svg template textarea title video aside".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
NOISE_WORDS = frozenset("ad ads adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline-share captcha consent cookie cookies dfp flash footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup promo promotion promoted recommended recommendations recommendation related search share sharebar sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription taboola teaser toolbar topbar widget widgets".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
#: Words that say where or in what form something stands; a name of these and noise words names noise.
PLACE_WORDS = frozenset("area bar bars block bottom box column container content desktop element fixed float floating global group inline inner item items lg left link links list main middle mobile module outer page panel primary region right row secondary section site slot sm space sticky strip text tools top unit units view wrap wrapper xs zone".split())
CLOSES_P = BLOCK - {"caption", "optgroup", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "head", "body", "html", "title"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "body": {"html"}}

RAW_TEXT = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("iframe", "script", "style", "textarea", "title")}
NAME = re.compile(r"/?[a-z][^\s/>]*", re.I)
COMMENT_END = re.compile(r"--!?>")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements that are skipped with all they hold, if they are closed.
SKIPPED = frozenset("math noscript select svg template".split())
# Elements that end svg and math, but for those in a place for HTML.
BREAKOUT = "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var address article aside footer form header html main nav section td th tr".split()
HTML_INSIDE = "foreignobject desc title annotation-xml mi mo mn ms mtext".split()


def _tags(names: list[str]) -> re.Pattern:
    return re.compile(rf"<!--(?:.*?-->|.*\Z)|<(/?)({'|'.join(names)})(?=[\s/>])[^>]*+>", re.S | re.I)


_ENDS = {t: _tags([t, *BREAKOUT, *HTML_INSIDE] if t in ("math", "svg") else [t]) for t in SKIPPED}
NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element in the style tree: its children's tags, what it says, and how much of that is links."""

    __slots__ = ("path", "children", "content", "linked", "plain")

    def __init__(self, path: str):
        self.path, self.content, self.linked, self.plain = path, 0, 0, 0
        self.children: list[str] = []


def name_kind(names: str) -> str:
    """``noise``, ``comments`` or nothing, from the words in class and id names.

    A name is noise if all its words are noise or say only where it stands: ``search-box`` is, ``search-algorithms`` is not.
    """
    found = ""
    for name in names.split():
        words = {w.lower() for w in NAME_PARTS.split(name) if w and not w.isdigit()}
        if words & COMMENT_WORDS and words <= COMMENT_WORDS | NOISE_WORDS | PLACE_WORDS:
            return "comments"
        if words & NOISE_WORDS and words <= NOISE_WORDS | PLACE_WORDS:
            found = "noise"
    return found


_KINDS: dict[tuple[str, str], tuple[str, str, bool, bool]] = {}


def element_kind(tag: str, attributes: str) -> tuple[str, str, bool, bool]:
    """Kind by names, name for the path, whether rules of HTML call it no content, and whether it holds the article."""
    key = tag, attributes
    if key not in _KINDS:
        if len(_KINDS) > 50_000:
            _KINDS.clear()
        found = {m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        style = found.get("style", "").replace(" ", "").lower()
        unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        holds = role in ("main", "article") or "articleBody" in found.get("itemprop", "")
        path = re.sub(r"\d+", "", f"{tag}.{'.'.join(sorted(found.get('class', '').split()))}#{found.get('id', '')}")
        kind = "" if tag in ("html", "body", "main") else name_kind(names)
        _KINDS[key] = kind, path, tag in NO_CONTENT or role in ROLES or unseen, holds
    return _KINDS[key]


def skip(page: str, tag: str, at: int, last_end: int) -> int | None:
    """Where what follows the start tag of a skipped element goes on, or None if nothing ends it.

    Nested elements are counted, and HTML inside svg and math ends them, as in browsers. A select that starts before
    another ended has no end; of nested elements with too few end tags, the last end tag counts. ``last_end`` is the place
    after the page's last ``>``.
    """
    depth, html_depth, end = 1, 0, None
    for m in _ENDS[tag].finditer(page, at, max(at, last_end)):
        if m[2] is None:
            continue
        name = m[2].lower()
        empty = page[m.end() - 2] == "/"
        if name == tag:
            if m[1]:
                depth, end = depth - 1, m.end()
                if not depth or tag in ("noscript", "select"):
                    return end
            elif tag == "select":
                return None
            elif tag == "template" or not empty:
                depth += 1
        elif name in HTML_INSIDE:
            html_depth = max(0, html_depth + (-1 if m[1] else not empty))
        elif not html_depth:
            return m.start()
    return end


def tokens(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """``start, end, tag, attributes, closing`` of the page's markup in order; comments and the like have no tag.

    A tag ends at the first ``>`` outside quotes. Once a tag has no such end, quotes count no more, and what comes after the
    last ``>`` is text, so every character is looked at a bounded number of times. Elements of raw text, and those that
    are skipped and closed, are one token with all they hold.
    """
    last_end, quotes, endless, at = page.rfind(">") + 1, True, set(), 0
    while 0 <= (start := page.find("<", at)) < last_end:
        kind = page[start + 1 : start + 2]
        if kind in ("!", "?"):
            if page.startswith("<!--", start):
                close = COMMENT_END.search(page, start + 4)
                short = 5 if page.startswith(">", start + 4) else 6 if page.startswith("->", start + 4) else 0
                end = start + short if short else close.end() if close else len(page)
            else:
                end = page.index(">", start) + 1
            yield start, end, "", "", False
            at = end
            continue
        name = NAME.match(page, start + 1)
        if not name:
            if kind == "/":  # an end without a name is a comment
                at = page.index(">", start) + 1
                yield start, at, "", "", False
                continue
            at = start + 1
            continue
        place = name.end()
        end = page.index(">", place) + 1
        if quotes and page[start + 1] != "/" and STOP.search(page, place, end)[0] != ">":
            end = 0
        while quotes and not end:
            stop = STOP.search(page, place)
            if not stop:
                quotes = False
            elif stop[0] == ">":
                end = stop.end()
            else:
                place = page.find(stop[0], stop.end()) + 1
                quotes = place > 0
        end = end or page.index(">", start) + 1
        tag, attributes = name[0].lower(), page[name.end() : end - 1]
        if tag[0] == "/":
            yield start, end, tag[1:], "", True
        elif tag in RAW_TEXT:
            close = RAW_TEXT[tag].search(page, end)
            end = page.find(">", close.end()) + 1 or len(page) if close else len(page)
            yield start, end, tag, "", False
        elif tag in SKIPPED:
            if tag not in endless and not (tag in ("math", "svg") and attributes.endswith("/")):
                past = skip(page, tag, end, last_end)
                if past is None and tag != "select":
                    endless.add(tag)
                end = past or end
            yield start, end, "", "", False
        else:
            yield start, end, tag, attributes, False
        at = end


NOISE, SOFT, LEVEL = 1, 2, 2


def walk(page: str, low: frozenset[int] = frozenset(), host: str = "", marks: bool = True) -> tuple[list[tuple[str, int, bool]], dict[str, list]]:
    """The page's blocks as (text, level, all links) and its element nodes as path: [children, content, linked, plain].

    ``level`` is -1 for what is not content, 2 inside an article, 1 inside another main element, else 0. ``low`` holds
    the site's style-tree nodes of low importance. Without ``marks``, what elements, roles and
    names say of content is not heard. Open elements are two
    lists and, for each tag, the places of those open, so depth costs little space and no search.
    """
    tags, flags, tree = [""], [0], [Node("")]
    where: dict[str, list[int]] = {}
    block_at, solid_at = [0], [0]
    found, blocks = {}, []
    piece: list[str] = []
    linked = plain = last = 0

    def say(text: str) -> None:
        nonlocal linked, plain
        if flags[-1] & NOISE <= flags[block_at[-1]] & NOISE:  # else it is in an inline element that is no content
            piece.append(text)
        bare = text.strip()
        if bare:
            node = tree[-1]
            node.content = zlib.crc32(bare.encode("utf-8", "replace"), node.content)
            if where.get("a"):
                linked += len(bare)
                node.linked += len(bare)
            else:
                plain += len(bare)
                node.plain += len(bare)

    def flush() -> None:
        nonlocal linked, plain
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                top = flags[-1]
                blocks.append((text, -1 if top & NOISE else top >> LEVEL, linked > 4 * plain))
            piece.clear()
        linked = plain = 0

    def leave() -> None:
        tag = tags.pop()
        flags.pop()
        if tag:
            where[tag].pop()
            if tag in BLOCK:
                block_at.pop()
                if tag != "p":
                    solid_at.pop()
        node = tree.pop()
        up = tree[-1]
        up.children.append(tag)
        up.content = zlib.crc32(node.content.to_bytes(4, "big"), up.content)
        up.linked += node.linked
        up.plain += node.plain
        if tag in BLOCK:
            seen = found.setdefault(node.path, [0, 0, 0, 0])
            seen[0] = zlib.crc32(" ".join(node.children).encode(), seen[0])
            seen[1] = zlib.crc32(node.content.to_bytes(4, "big"), seen[1])
            seen[2] += node.linked
            seen[3] += node.plain

    def enter(tag: str, attributes: str) -> None:
        kind, name, ruled, holds = element_kind(tag, attributes)
        up = flags[-1]
        upper = up >> LEVEL
        level = max(upper, 2 if tag == "article" or holds else 1 if tag == "main" else 0)
        if not marks:
            kind, ruled, level = "", tag == "head", 0
        noise, soft = up & NOISE, up & SOFT
        if noise and soft and level > upper and kind != "comments":
            noise = soft = 0
        own = kind == "comments" or ruled or (tag == "header" and marks or kind == "noise") and not (tag in ("article", "h1", "h2") or upper and ("header" in name.lower() and kind != "comments" and tag in ("header", "div", "hgroup")))
        path = f"{tree[-1].path}>{name}"
        if len(path) > 400:
            path = xxhash.xxh64_hexdigest(path)
        if not own and low and tag in BLOCK and (not upper or (tag in ("div", "section", "ul", "table") and not name.endswith(".#"))):
            own = tag not in ("article", "main", "body", "html") and xxhash.xxh64_intdigest(host + path) in low
        tree.append(Node(path))
        if own and not noise:
            noise, soft = NOISE, SOFT if kind == "noise" and not ruled else 0
        where.setdefault(tag, []).append(len(tags))
        if tag in BLOCK:
            block_at.append(len(tags))
            if tag != "p":
                solid_at.append(len(tags))
        tags.append(tag)
        flags.append(noise | soft | level << LEVEL)

    def shut(i: int) -> None:
        while len(tags) > i:
            leave()

    for start, end, tag, attributes, closing in tokens(page):
        if start > last:
            say(page[last:start])
        last = end
        if not tag:
            continue
        if tag in RAW_TEXT:
            if tag == "title":
                flush()
        elif tag == "br":
            piece.append(" ")
        elif closing:
            if tag in BLOCK:
                flush()
            if where.get(tag):
                i = where[tag][-1]
                if tag in BLOCK or block_at[-1] < i:
                    shut(i)
                else:  # the element ends, but not the blocks that it holds
                    where[tag].pop()
                    tags[i] = ""
        else:
            if tag in BLOCK:
                flush()
                while tag not in ("option", "optgroup") and tags[-1] in ("option", "optgroup"):
                    leave()
                if tag in CLOSES:
                    bound = max((where[t][-1] for t in SCOPE.get(tag, ()) if where.get(t)), default=0)
                    inside = [where[t][bisect_right(where[t], bound)] for t in (*CLOSES[tag], *(["p"] if tag in CLOSES_P else [])) if where.get(t) and where[t][-1] > bound]
                    if inside:
                        shut(min(inside))
                elif tag in CLOSES_P and where.get("p") and where["p"][-1] > solid_at[-1]:
                    shut(where["p"][-1])
            elif tag == "a" and where.get("a"):
                tags[where["a"].pop()] = ""
            if tag not in VOID:
                enter(tag, attributes)
    if last < len(page):
        say(page[last:])
        plain += 1
    flush()
    shut(1)
    return blocks, found


def main_text(page: str, low: frozenset[int] = frozenset(), host: str = "", marks: bool = True) -> str:
    """Blocks of the article if the page marks one, else of its main element, else all but blocks of links.

    An article that holds less than half of what is no block of links (a teaser beside the story, a card under an
    introduction) is not all of the page's content: then blocks around it stay too.
    """
    blocks, _ = walk(page, low, host, marks)
    sizes = [0, 0, 0]
    for text, level, links in blocks:
        if level >= 0 and not links:
            sizes[level] += len(text)
    best = max((level for _, level, _ in blocks), default=-1)
    if best == 2 and 2 * sizes[2] < sum(sizes):
        best = 1 if sizes[1] else 0
    return "\n\n".join(text for text, level, links in blocks if level >= best and level >= 0 and (level or not links))


def style_nodes(pages: DataFrame) -> DataFrame:
    """``host, node, style, content, links`` of every element node of every page (``host, html``).

    ``links`` is whether four fifths of the node's text are links; null if it has no text.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                hosts, rows = [], []
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for path, (style, content, linked, plain) in walk(page)[1].items():
                        hosts.append(host)
                        node = xxhash.xxh64_intdigest(host + path)
                        rows.append((node - (1 << 64) if node >> 63 else node, style, content, linked > 4 * plain if linked + plain else None))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *columns], names=["host", "node", "style", "content", "links"])

    return pages.where("html is not null").select("host", "html").mapInArrow(compute, "host string, node long, style long, content long, links boolean")


def low_importance(nodes: DataFrame, threshold: float = 0.3, least_pages: int = 8, weight: float = 0.9, most_links: float = 0.9) -> DataFrame:
    """``host, node`` of the site style tree's nodes whose importance is below ``threshold``.

    A node's presentation importance is the entropy of its child sequences over the site's m pages that have it, in
    base m; its content importance that of its contents; importance weighs the second by ``weight``. What a node says is
    also looked at as a kind: where it is links on at least ``most_links`` of the pages on which it says anything, all its
    contents are of one kind and have no entropy, so menus that differ from page to page are low too. Equal values are
    counted before they meet, so a site with most of the pages is spread over tasks.
    """
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("value")) for k, c in enumerate(("style", "content", "links")))))
    counts = nodes.select("host", "node", kinds.alias("k")).groupBy("host", "node", "k.kind", "k.value").count()
    logs = F.col("count") * F.log("count")
    of = lambda k, what: F.sum(F.when(F.col("kind") == k, what))
    linked = F.sum(F.when((F.col("kind") == 2) & (F.col("value") == 1), F.col("count")))
    saying = F.sum(F.when((F.col("kind") == 2) & F.col("value").isNotNull(), F.col("count")))
    trees = counts.groupBy("host", "node").agg(of(1, F.col("count")).alias("m"), of(0, logs).alias("log0"), of(1, logs).alias("log1"), linked.alias("linked"), saying.alias("saying"))
    trees = trees.where(F.col("m") >= least_pages)
    style, content = (1 - F.col(f"log{k}") / (F.col("m") * F.log("m")) for k in (0, 1))
    content = F.when(F.col("linked") >= most_links * F.greatest("saying", F.lit(least_pages)), 0.0).otherwise(content)
    return trees.where((1 - weight) * style + weight * content < threshold).select("host", "node")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.3, least_pages: int = 8, most_broadcast: int = 200_000, marks: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the main text without boilerplate.

    Pages of one host (of the url; null is a host of its own) merge into a style tree. Branches of low importance, which
    repeat over the site in presentation and content, are cut from each page, beside what HTML itself or a name marks
    as no content (navigation, adverts, forms, comments and so on). An article's own paragraphs are never cut for
    being repeated, so copies of an article keep it. Sites with fewer than ``least_pages`` have only the second rule;
    without ``marks`` the tree decides alone. Depth and length of a page are not bounded; time is linear in its length.
    Null and empty pages, and pages without content, have an empty text. Repeated rows are pages each; no rows, no
    result; other columns are not read. Low nodes are joined by host: broadcast if there are at most
    ``most_broadcast``, else by a shuffle.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    low = stored(low_importance(style_nodes(rows), threshold, least_pages), "style-low")
    by_host = low.groupBy("host").agg(F.collect_list("node").alias("low"))
    if low.limit(most_broadcast + 1).count() <= most_broadcast:
        by_host = F.broadcast(by_host)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites: dict[str, frozenset[int]] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = []
                for at, (page, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if host not in sites:
                        if len(sites) > 1000:
                            sites.clear()
                        sites[host] = frozenset(x % (1 << 64) for x in part.column(4)[at].as_py() or ())
                    texts.append(main_text(page or "", sites[host], host, marks))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    joined = rows.join(by_host, "host", "left").select("page_id", "url", "html", "host", "low")
    return joined.mapInArrow(compute, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
