"""Main-text extraction by equivalence-class template deduction.

1. Every page gives its tokens: each structural element by its path of tags and classes, each text by its path and
   wording, in the article or not, with the number of times it occurs on the page. Pages of a host with the same texts in
   the article are one page here, so that copies of a page don't make its text a template.
2. Over all pages of a host, tokens with the same occurrence vector (the same count on the same pages) form a class. A
   class is found by the exclusive or of hashes of (page, count), so vectors are aggregated before the shuffle and a host
   with a third of all pages is no hot group. Classes that occur on at least half of the host's pages, three at least, can
   be valid. The one that occurs once on every page is the template's frame.
3. A second scan checks order and nesting. A frame token is valid if the same frame token precedes it on every page; a
   token of another class if it always lies in one slot of the frame. A class is cut by slots, a host whose frame has
   fewer than three valid tokens has no template.
4. Texts that are template tokens are the template's own wording, on every page. What remains are its slots. The main text
   is what the slots of the article (or `main`) hold, less menus, notices, adverts, forms and comments by their tags and
   class names; a page without one gives all slots but link lists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import materialise

#: Elements whose content up to their end tag is not text. Of the first kind an end tag may be missing, and the rest of the
#: page is theirs; the others are then only tags.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_CLOSED = frozenset("svg math select button object canvas audio video".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: A tag's rest: quotes count only as attribute values, an unclosed one is a character like others.
_QUOTED = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements kept on the stack: those that give a text its place. Others only end a block.
_PLACES = frozenset("html head body main article section div nav aside header footer form ul ol dl table menu figure details dialog fieldset center blockquote".split())
_DROPPED = frozenset("head nav aside footer form menu dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of class names and ids that mark a part as not the main text; fixed values.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "header hidden masthead menu menus modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion recommended related "
    "replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription teaser toc toolbar widget widgets".split()
)
#: Words that may stand beside a mark in a class name without making it the name of a topic; fixed values.
_NEUTRAL = frozenset(
    "area bar block body bottom box center container content desktop field form global group holder home inner item items left link links list main "
    "mobile module outer page panel post primary right root row secondary section site slot space sticky text top unit wrap wrapper zone".split()
)
_MARK_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _is_mark(name: str) -> bool:
    """Whether a class name or id marks its part: a mark word with nothing but mark, neutral or numbering words beside it.

    `ad-box` and `site-footer` do; `related-work` and `social-history` name a topic and don't.
    """
    words = [w.lower() for w in _MARK_WORD.findall(name)]
    return any(w in _MARKS for w in words) and all(w in _MARKS or w in _NEUTRAL or len(w) < 3 for w in words)


def _kind(tag: str, attributes: str) -> tuple[str, bool]:
    """(name of the place, whether it is apart from the main text) of an element."""
    name, apart = tag, tag in _DROPPED
    for a in _ATTR.finditer(attributes) if attributes and attributes != "/" else ():
        what, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if what in ("class", "id"):
            name += ("." if what == "class" else "#") + " ".join(value.split())
            apart = apart or any(map(_is_mark, value.split()))
        elif what == "role":
            apart = apart or value.strip().lower() in _ROLES
        elif what == "hidden" or (what == "aria-hidden" and value.strip().lower() == "true"):
            apart = True
        elif what == "style":
            apart = apart or "display:none" in value.replace(" ", "").lower()
    return name, apart


def scan(page: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """(text, tag, whether it is an end tag, attributes) of a page, in time linear in its length.

    Comments, declarations and the content of elements without text are left out. What is behind the last `>` is text. If a
    tag runs to the end of the page by its quotes, quotes are no longer looked at.
    """
    at, end, quotes, ends = 0, page.rfind(">") + 1, True, {}
    lower = page.lower() if "</" in page else page
    if len(lower) != len(page):
        lower = page
    while at < end:
        lt = page.find("<", at, end)
        if lt < 0:
            break
        if lt > at:
            yield page[at:lt], "", False, ""
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            if stop < 0:
                return
            at = stop + 3
            continue
        name = _NAME.match(page, lt + 1)
        if name is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1 or end
            else:
                yield "<", "", False, ""
                at = lt + 1
            continue
        rest = _QUOTED.match(page, name.end()) if quotes else None
        quotes = rest is not None
        stop = rest.end() if rest else page.find(">", name.end()) + 1
        if not stop:
            break
        at, tag = stop, name[2].lower()
        if not name[1] and (tag in _RAW or tag in _CLOSED):
            if ends.get(tag, 0) >= 0 and ends.get(tag, 0) < at:
                ends[tag] = lower.find(f"</{tag}", at)
            if ends[tag] >= 0:
                at = page.find(">", ends[tag]) + 1 or len(page)
                continue
            if tag in _RAW:
                return
        yield None, tag, bool(name[1]), page[name.end() : stop - 1]
    if at < len(page):
        yield page[max(at, 0) :], "", False, ""


def blocks(page: str) -> Iterator[tuple[int, str, bool, bool, bool, float]]:
    """(path, text, in the article, apart, heading, share of link text) of each block of a page, and of each place ('', path) opened.

    A place that opens comes as a block without text. Character references are decoded and white space is one space. A path
    is a 64-bit hash of the places around, so that deep nesting costs no more than flat; an end tag that closes nothing is
    known by a count of open ones.
    """
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]  # tag, path, article, apart, header
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, anchor, heading = 0, 0, False

    def close() -> Iterator[tuple[int, str, bool, bool, bool, float]]:
        nonlocal linked, parts
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                _, path, article, apart, header = stack[-1]
                yield path, text, article, apart or (header and not heading), heading, min(1.0, linked / max(1, len(raw)))
            parts, linked = [], 0

    for text, tag, ends, attributes in scan(page):
        if text is not None:
            parts.append(text)
            if anchor:
                linked += len(text)
            continue
        if tag in _INLINE:
            if tag == "a":
                anchor = 0 if ends else 1
            elif tag in ("br", "wbr", "img"):
                parts.append(" ")
            continue
        yield from close()
        if tag in _HEADING:
            heading = not ends
        if tag in _VOID or tag not in _PLACES:
            continue
        if ends:
            if open_[tag]:
                while True:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if gone == tag:
                        break
                anchor, heading = 0, False
            continue
        name, apart = _kind(tag, attributes)
        _, path, article, above, header = stack[-1]
        if tag == "body":
            apart, above = False, False
            del stack[1:]
            open_.clear()
            path = 0
        inside = article or tag in ("article", "main")
        header = header or (tag == "header" and not inside)
        apart = above or (apart and not (tag in ("article", "main") and not article)) or (tag == "header" and not inside)
        stack.append((tag, xxhash.xxh3_64_intdigest(f"{path}>{name}"), inside, apart, header or tag == "header"))
        open_[tag] += 1
        yield stack[-1][1], "", inside, apart, False, 0.0
    yield from close()


def _token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") - 2**63


#: The token of a page itself; its support is the number of a host's pages.
_PAGE = 0
MIN_SUPPORT = 3
MIN_FRAME = 3


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, times) of every page with text: the page itself, its places and its texts.

    page is a hash of the article's texts, or without an article of all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(blocks(html or ""))
                texts = [text for _, text, article, *_ in found if text and article] or [text for _, text, *_ in found if text]
                if not texts:
                    continue
                page = _token(0, "\n".join(texts))
                seen = Counter(_token(path, text) for path, text, *_ in found)
                seen[_PAGE] = 1
                rows += [(host, page, token, times) for token, times in seen.items()]
                if len(rows) > 20_000:
                    yield _batch(rows, (pa.string(), pa.int64(), pa.int64(), pa.int32()), ["host", "page", "token", "times"])
                    rows = []
            if rows:
                yield _batch(rows, (pa.string(), pa.int64(), pa.int64(), pa.int32()), ["host", "page", "token", "times"])

    found = pages.select("host", "html").mapInArrow(run, "host string, page long, token long, times int")
    return found.groupBy("host", "page", "token").agg(F.max("times").alias("times"))


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def template_classes(tokens: DataFrame) -> DataFrame:
    """(host, level, support, vector, tokens): the frequent classes of each host, level 0 the frame, 1 repeated, 2 optional.

    The tokens of a host's frequent classes are at most twice those of its average page.
    """
    vectors = tokens.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.max("times").alias("most")
    )
    frequent = materialise(vectors.where(F.col("support") >= MIN_SUPPORT), "vectors")
    hosts = frequent.where(F.col("token") == _PAGE).select("host", F.col("support").alias("pages"))
    valid = frequent.where(F.col("token") != _PAGE).join(hosts, "host").where("support * 2 >= pages")
    level = F.when(F.col("support") < F.col("pages"), 2).when(F.col("most") > 1, 1).otherwise(0)
    return valid.withColumn("level", level).groupBy("host", "level", "support", "vector").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def _by_host(pages: DataFrame, lists: DataFrame, names: tuple[str, ...], each, columns: tuple[str, ...], schema: str) -> DataFrame:
    """each(part, sets) over runs of pages, sets being for each page its host's token lists `names` as sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[int], ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = []
                for host, *found in zip(part.column("host").to_pylist(), *(part.column(n) for n in names), strict=True):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = tuple(frozenset(f.as_py() or ()) for f in found)
                    sets.append(known[host])
                yield from each(part, sets)

    return pages.join(lists, "host", "left").select(*columns, *names).mapInArrow(run, schema)


def valid_tokens(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, level, vector, slot, tokens): classes whose tokens keep the frame's order or lie in one slot of it."""
    listed = classes.select("host", "level", F.explode("tokens").alias("token"), "vector")
    inner = F.collect_list(F.when(F.col("level") > 0, F.col("token")))
    lists = listed.groupBy("host").agg(F.collect_list(F.when(F.col("level") == 0, F.col("token"))).alias("frame"), inner.alias("inner"))

    def each(part: pa.RecordBatch, sets: list[tuple[frozenset[int], ...]]) -> Iterator[pa.RecordBatch]:
        places = set()
        for host, html, (frame, inner) in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), sets, strict=True):
            slot = _PAGE
            for path, text, *_ in blocks(html or "") if frame else ():
                token = _token(path, text)
                if token in frame:
                    places.add((host, token, slot))
                    slot = token
                elif token in inner:
                    places.add((host, token, slot))
        if places:
            yield _batch(list(places), (pa.string(), pa.int64(), pa.int64()), ["host", "token", "slot"])

    found = _by_host(pages, lists, ("frame", "inner"), each, ("host", "html"), "host string, token long, slot long")
    nested = found.groupBy("host", "token").agg(F.min("slot").alias("slot"), F.max("slot").alias("last")).where("slot = last").drop("last")
    kept = listed.join(nested, ["host", "token"]).withColumn("slot", F.when(F.col("level") > 0, F.col("slot")))
    return kept.groupBy("host", "level", "vector", "slot").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def extract(html: str | None, template: frozenset[int]) -> str:
    """Main text of a page, its blocks joined by two line ends; empty if there is none.

    A page all of whose main text is the host's template wording keeps it.
    """
    found = [b for b in blocks(html or "") if b[1]]
    has_article = any(article and not apart for _, _, article, apart, _, _ in found)
    whole, out = [], []
    for path, text, article, apart, heading, links in found:
        if apart or (has_article and not article) or (not has_article and links > 0.6 and not heading):
            continue
        whole.append(text)
        if _token(path, text) not in template:
            out.append(text)
    return "\n\n".join(out or (whole if has_article else out))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars).

    Null html gives an empty text. A null or malformed url is a host of its own kind, the empty one. Rows that repeat a
    page_id are pages of their own; other columns are ignored; an empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    classes = materialise(template_classes(page_tokens(rows)), "classes")
    valid = materialise(valid_tokens(rows, classes), "nested")
    framed = valid.where("level = 0").groupBy("host").agg(F.sum(F.size("tokens")).alias("n")).where(F.col("n") >= MIN_FRAME).select("host")
    templates = valid.join(framed, "host", "left_semi").groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))
    templates = materialise(templates, "templates")

    def each(part: pa.RecordBatch, sets: list[tuple[frozenset[int], ...]]) -> Iterator[pa.RecordBatch]:
        texts = [extract(html, template) for html, (template,) in zip(part.column("html").to_pylist(), sets, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return _by_host(rows, templates, ("template",), each, ("page_id", "url", "html", "host"), "page_id long, url string, text string, n_chars long")
