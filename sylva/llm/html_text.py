"""Main text of web pages: site templates are found by hashing element subtrees and counting them for each host in Spark.

A first pass over the pages hashes element subtrees, in two ways: whole, and by shape, which is the path of tags and marks
to the element and those inside it, without text and with neighbours of one shape taken as one. Spark counts for each host
the different pages of each hash. What recurs whole in many pages is a template; a shape that recurs in many pages, once a
page, is one if
little of the pages' text is in it and most in their articles. The second pass deletes the templates. Lists of element names and of words in classes
decide only on what the counts leave open: elements whose shape is rare on the host, and hosts of few pages, of which
moreover only the article is taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.url_filter import host_and_path
from sylva.runtime import materialize, ship_package

#: So many different pages of a host tell templates; subtrees in as many are judged by their counts.
MIN_PAGES = 5
#: Where articles hold at least the second part of a host's text, a shape that recurs once a page outside of them is a
#: template with at most the first part of its pages' text. A shape with more than the second part is main text.
TEMPLATE_SHARE, MAIN_SHARE = 0.25, 0.5
#: Up to so many judged subtrees (about 100 bytes each) are broadcast, by host; beyond, pages are joined to their own.
BROADCAST_ROWS = 500_000

# Fixed values of HTML: elements without content or end tag; of raw text; that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
SCOPE = frozenset("article aside body button div dialog fieldset figure footer form header html li main nav section table td th blockquote".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are never text to read.
NEVER = frozenset("script style noscript template textarea head title button select iframe object svg math canvas".split())
#: Elements that by their name are no main text, where a host's pages don't tell.
LISTED = frozenset("nav header footer aside form menu dialog".split())
#: Words in a class, id or role that mark an element as no main text, where a host's pages don't tell.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead footer header share sharing social related recommended widget comment comments reply replies respond disqus skip".split())
#: Elements of running text, which are templates only if they have a class, id or role.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tr td th figure figcaption b i em strong a span code br hr img sup sub small u".split())
KEPT = frozenset("html body article main".split())


_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_MARK = re.compile(r"[a-z]+")


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): "text" with the text as rest, "open" and "close" with a tag's name and its attributes as text.

    Every character is looked at a bounded number of times, however broken the page is: that no ``>`` and no such quote
    follows is told by their last places, and once quotes have run over all that is left, quotes no longer count.
    """
    at, n = 0, len(html)
    last = {c: html.rfind(c) for c in ">\"'"}
    quotes = True

    def tag_end(k: int) -> int:
        nonlocal quotes
        start = k
        while quotes and (m := _STOP.search(html, k)):
            if m[0] == ">":
                return m.start()
            k = html.find(m[0], m.end()) + 1 if last[m[0]] > m.start() else m.end()
        quotes = False
        return html.find(">", start)

    raw = None
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last[">"]:  # the rest has no tag; an open comment hides it
            lt = html.find("<!--", at)
            yield "text", "", html[at : lt if lt >= 0 else n]
            return
        if lt > at:
            yield "text", "", html[at:lt]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
        elif m := _NAME.match(html, lt):
            end, tag = tag_end(m.end()), m[1].lower()
            rest, at = html[m.end() : end], end + 1
            if html[lt + 1] == "/":
                yield "close", tag, ""
                continue
            yield "open", tag, rest
            if tag in RAW and not rest.endswith("/"):
                raw = _end_of(tag).search(html, at)
                yield "close", tag, ""
                at = html.find(">", raw.end()) + 1 if raw and raw.end() <= last[">"] else n
        elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
            at = html.find(">", lt) + 1
        else:
            yield "text", "", "<"
            at = lt + 1


@dataclass(frozen=True)
class Judged:
    """Of a host: the hashes of its templates, and of shapes that are main text."""

    templates: frozenset[int]
    main: frozenset[int]


@dataclass
class Page:
    """text: the main text; found: hash of each subtree that could be a template to (by shape, times, characters in it);
    chars, main_chars: characters of text in all, and in article or main elements."""

    text: str = ""
    found: dict[int, tuple[bool, int, int]] = field(default_factory=dict)
    chars: int = 0
    main_chars: int = 0


class _Element:
    __slots__ = ("tag", "never", "listed", "marked", "start", "parts", "shapes", "path", "kept", "chars", "outside")

    def __init__(self, tag: str, never: bool, listed: bool, marks: list[str], start: int, path: int, outside: bool):
        self.tag, self.never, self.listed, self.marked, self.start, self.path, self.outside = tag, never, listed, bool(marks), start, path, outside
        self.parts, self.shapes, self.kept, self.chars = [tag, *marks], [], tag in KEPT, 0


def parse(html: str, judged: Judged | None = None) -> Page:
    """A page's main text, and its subtrees. ``judged``: what the host's counts tell; None where there are too few pages."""
    out: list[str] = []  # pieces of text so far; a deleted subtree takes its own away again
    spans: dict[str, list[list[int]]] = {"article": [], "main": []}
    begun: dict[str, list[list[int]]] = {"article": [], "main": []}
    page = Page()
    stack = [_Element("", False, False, [], 0, 0, True)]
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    scopes: list[int] = []
    inside = 0  # article or main elements that are open

    def close() -> None:
        nonlocal inside
        e = stack.pop()
        places[e.tag].pop()
        if e.tag in SCOPE:
            scopes.pop()
        if e.tag in spans:
            inside -= 1
            begun[e.tag].pop()[1] = len(out)
            page.main_chars += e.chars if e.outside and not e.never else 0
        whole, shape = _digest("whole", *e.parts), _digest("shape", e.tag, *map(str, e.shapes))
        up = stack[-1]
        up.parts.append(str(whole))
        if not up.shapes or up.shapes[-1] != shape:
            up.shapes.append(shape)
        up.kept |= e.kept
        up.chars += e.chars
        placed = _digest("placed", str(e.path), str(shape))
        able = not e.never and not e.kept
        if able and (e.marked or e.tag not in PROSE):
            _, times, chars = page.found.get(whole, (False, 0, 0))
            page.found[whole] = False, times + 1, chars + e.chars
        else:
            whole = 0
        if able and e.outside and e.tag not in PROSE:
            _, times, chars = page.found.get(placed, (True, 0, 0))
            page.found[placed] = True, times + 1, chars + e.chars
        else:
            placed = 0
        if judged is None:
            drop = e.listed
        else:
            drop = whole in judged.templates or placed in judged.templates or e.listed and placed not in judged.main
        if e.never or drop:
            del out[e.start :]
            for s in spans.values():
                while s and s[-1][0] >= e.start:
                    s.pop()
        if e.tag in BLOCK:
            out.append(" ")

    def close_to(k: int) -> None:
        while len(stack) > k:
            close()

    for kind, tag, rest in tokens(html):
        if kind == "text":
            piece = unescape(rest) if "&" in rest else rest
            if piece:
                out.append(piece)
                line = " ".join(piece.split())
                stack[-1].parts.append(line)
                if not stack[-1].never:
                    stack[-1].chars += len(line)
        elif kind == "close":
            if places.get(tag):
                close_to(places[tag][-1])
        elif tag in VOID:
            if tag in BLOCK:
                out.append(" ")
        else:
            ends = (*CLOSES.get(tag, ()), "p") if tag in BLOCK else CLOSES.get(tag, ())
            open_ = [places[x][-1] for x in ends if places.get(x)]
            # up to the innermost scope; one of the elements to close may be that scope itself
            if open_ and max(open_) >= (scopes[-1] if scopes else 0):
                close_to(max(open_))
            named = [(a.lower(), "".join(v)) for a, *v in _ATTR.findall(rest)] if "=" in rest else []
            words = {w for _, v in named for w in _MARK.findall(v.lower())} if named else set()
            listed = tag in LISTED or tag not in KEPT and not words.isdisjoint(MARKS) or tag == "article" and not words.isdisjoint(("comment", "comments", "reply"))
            marks = [f"{a}={v}" for a, v in named]
            if tag in BLOCK:
                out.append(" ")
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append(_Element(tag, tag in NEVER or stack[-1].never, listed, marks, len(out), _digest(str(stack[-1].path), tag, *marks), inside == 0))
            if tag in spans:
                inside += 1
                begun[tag].append([len(out), 0])
                if not listed:
                    spans[tag].append(begun[tag][-1])
    close_to(1)
    page.chars = stack[0].chars
    pieces = out
    best = spans["article"] or spans["main"]
    if judged is None and best:
        pieces, upto = [], 0
        for a, b in sorted(map(tuple, best)):
            pieces += [*out[max(a, upto) : b], " "]
            upto = max(upto, b)
    page.text = " ".join("".join(pieces).split())
    return page


_SUBTREES = "host string, html_key long, page long, subtree long, shape boolean, times int, chars long, page_chars long"


def subtrees(pages: DataFrame) -> DataFrame:
    """A row for each page (host, html, html_key), with subtree 0, and for each different hash of its subtrees.

    ``page`` is a hash of the main text as far as the lists tell it: pages of equal text are one page.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                p = parse(batch.column("html")[i].as_py())
                own = batch.column("host")[i].as_py(), batch.column("html_key")[i].as_py(), _digest(p.text)
                rows.append((*own, 0, False, 1, p.main_chars, p.chars))
                rows += [(*own, h, *x, p.chars) for h, x in p.found.items() if h]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "html_key", "page", "subtree", "shape", "times", "chars", "page_chars"])

    return pages.select("host", "html_key", "html").mapInArrow(hashes, _SUBTREES)


def judge_subtrees(found: DataFrame, min_pages: int = MIN_PAGES, template_share: float = TEMPLATE_SHARE, main_share: float = MAIN_SHARE) -> DataFrame:
    """host, subtree, template of what the counts tell: templates (true), shapes of main text (false), and subtree 0 for each
    host of enough pages (false)."""
    # copies of a page count once; then pages of a host are counted by partial sums, so that a hot host is no burden
    once = found.groupBy("host", "subtree", "page").agg(F.max("shape").alias("shape"), F.max("times").alias("times"), F.max("chars").alias("chars"), F.max("page_chars").alias("page_chars"))
    counts = once.groupBy("host", "subtree").agg(F.max("shape").alias("shape"), F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum("chars").alias("chars"), F.sum("page_chars").alias("page_chars"))
    share, single = F.col("chars") / F.greatest("page_chars", F.lit(1)), F.col("times") <= 1.1 * F.col("pages")
    counts = materialize(counts.filter(F.col("pages") >= min_pages).select("host", "subtree", "shape", share.alias("share"), single.alias("single")), "html-counts")
    hosts = counts.filter("subtree = 0").select("host", F.col("share").alias("articles"))
    template = F.when(F.col("shape"), F.col("single") & (F.col("share") <= template_share) & (F.col("articles") >= MAIN_SHARE)).otherwise((F.col("subtree") != 0) & F.lit(template_share > 0))
    told = F.col("template") | (F.col("subtree") == 0) | F.col("shape") & (F.col("share") > main_share)
    return counts.join(hosts, "host").withColumn("template", template).filter(told).select("host", "subtree", "template")


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, template_share: float = TEMPLATE_SHARE, main_share: float = MAIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Of a host of at least ``min_pages`` different pages the text is what is left without its templates; of others that of the
    page's article elements (else main elements, else the body) without listed elements. Character references are decoded,
    white space inside a block is one space, blocks are joined by one. Null or empty html: empty text. A url without host
    belongs to host ''. Rows may repeat; each gives a row. Whole pages are read, in time linear in their length, and one page
    is held at a time. Other columns of the input are not looked at. ``template_share`` of 0: nothing is a template;
    ``main_share`` of -1: all other shapes that recur are main text.
    """
    spark = pages.sparkSession
    ship_package(spark)
    host, _ = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("html_key", F.xxhash64("html"))
    found = materialize(subtrees(rows), "html-subtrees")
    judged = materialize(judge_subtrees(found, min_pages, template_share, main_share), "html-judged")
    if judged.count() <= BROADCAST_ROWS:
        by_host: dict[str, tuple[set[int], set[int]]] = {}
        for r in judged.toLocalIterator():  # BROADCAST_ROWS bounds it
            by_host.setdefault(r.host, (set(), set()))[0 if r.template else 1].add(r.subtree)
        shared = spark.sparkContext.broadcast({h: Judged(frozenset(t), frozenset(m)) for h, (t, m) in by_host.items()})

        @F.arrow_udf("string")
        def main_text(html: pa.Array, host: pa.Array) -> pa.Array:
            return pa.array([parse(h.as_py(), shared.value.get(x.as_py())).text for h, x in zip(html, host, strict=True)], pa.string())

        # the UDF's result is used twice: without this mark the planner may compute it for each use
        out = rows.select("page_id", "url", main_text.asNondeterministic()("html", "host").alias("text"))
    else:
        own = found.join(judged, ["host", "subtree"]).groupBy("host", "html_key").agg(
            F.collect_set(F.when(F.col("template"), F.col("subtree"))).alias("templates"), F.collect_set(F.when(~F.col("template"), F.col("subtree"))).alias("main")
        )

        @F.arrow_udf("string")
        def own_text(html: pa.Array, templates: pa.Array, main: pa.Array) -> pa.Array:
            told = [None if t.as_py() is None else Judged(frozenset(t.as_py()), frozenset(m.as_py())) for t, m in zip(templates, main, strict=True)]
            return pa.array([parse(h.as_py(), j).text for h, j in zip(html, told, strict=True)], pa.string())

        out = rows.join(own, ["host", "html_key"], "left").select("page_id", "url", own_text.asNondeterministic()("html", "templates", "main").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
