"""Main text of web pages, with site template removal.

Every element subtree outside a page's article and every container inside one is hashed; Spark counts each hash
per host over all its pages, and subtrees that recur on many pages of their host are deleted. Outside articles, what
is no article by its tag, role or names (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) goes as well; inside, by its tag, role or names of reader comments, and containers of such a class
where the class recurs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, settle, written

#: A subtree is template if it is on at least so many pages of its host with different texts (inside articles: in
#: so many different articles), and either on this share of them or of at least LONG words.
PAGES, SHARE, LONG = 10, 0.2, 5
#: Template hashes up to which they are broadcast; beyond, they are joined by host, with each host SALTS times.
BROADCAST, SALTS = 200_000, 32

#: HTML elements by what they do.
RAW = ["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCK = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
GONE = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "search", *RAW]
GONE_ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar"]
GONE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebar\w*|aside|footer|site-?header|masthead|cookies?|consent|gdpr|notices?|banner|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|respond|disqus\w*|reader-?comments?|form)(?:$|[\s_-])"
)
#: A class inside an article is listed if it is one of these names, alone or as what such a thing is made of.
PARTS = "area|articles?|banner|bar|block|box|buttons?|container|form|icons?|links?|list|notice|panel|popup|posts?|section|signup|slot|tools?|unit|widget|wrap|wrapper"
IN_ARTICLE = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promos?|promotion|nav|navigation|menus?|breadcrumbs?|sidebar|footer|cookies?|consent|gdpr|notices?|banner|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend(?:ed|ations?)|form)(?:[_-](?:" + PARTS + r"))*(?:$|\s)"
)
#: Names of reader comments, which differ from page to page; those of a container inside an article.
COMMENTS = re.compile(r"(?:^|\s)(?:comments?|respond|disqus\w*|reader-?comments?)(?:$|\s)")
CONTAINERS = ["aside", "details", "div", "dl", "figure", "header", "ol", "section", "table", "ul"]
#: Elements whose text is read inside an article, where a header is the article's own unless it recurs.
READ = ["header", "noscript", "svg", "math", "object"]
#: An element that is closed when one of these starts in it.
CLOSES = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
_BLOCK, _VOID, _GONE, _RAW = frozenset(BLOCK), frozenset(VOID), frozenset(GONE), frozenset(RAW)
_CONTAINERS, _READ = frozenset(CONTAINERS), frozenset(READ)
_ROOTS = ("article", "main")


class _Element:
    __slots__ = ("attributes", "gone", "inside", "main", "named", "parts", "tag")

    def __init__(self, tag: str, attributes: str, inside: bool):
        self.tag, self.attributes, self.inside, self.main = tag, attributes, inside, tag in _ROOTS
        #: inside: whether it is in an article or main part. There, the listed class waits for its recurrence.
        self.gone, self.named = _in_article(tag, attributes) if inside else (_boilerplate(tag, attributes), "")
        #: Texts, and the elements inside, in order.
        self.parts: list = []


def _attributes(told: str) -> Iterator[tuple[str, str]]:
    """(name, value) of the attributes that tell what an element is, in lower case."""
    for m in _ATTRIBUTE.finditer(told):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role", "hidden") or (name == "aria-hidden" and value == "true"):
            yield name, value


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in _GONE:
        return True
    if not attributes or tag in _ROOTS or tag in ("body", "html"):
        return False
    for name, value in _attributes(attributes):
        if name.endswith("hidden"):
            return True
        if value in GONE_ROLES if name == "role" else GONE_NAMES.search(value):
            return True
    return False


def _in_article(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element inside an article is boilerplate, and the listed class of a container."""
    if tag in _GONE and tag not in _READ:
        return True, ""
    named = ""
    if not attributes or tag in _ROOTS or tag in ("body", "html"):
        return False, named
    for name, value in _attributes(attributes):
        if name.endswith("hidden"):
            return True, ""
        if tag not in _CONTAINERS:
            continue
        if value in GONE_ROLES if name == "role" else COMMENTS.search(value):
            return True, ""
        if name == "class" and IN_ARTICLE.search(value):
            named = value
    return False, named


def parse(page: str) -> _Element:
    """The element tree. Unclosed elements end with what holds them; end tags of nothing open are ignored."""
    top = _Element("", "", False)
    stack, at, n = [top], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _ROOTS and tag not in ("body", "html"):
                    break  # a stray end tag doesn't end the article around it
            continue
        attributes = m[3] or m[6] or ""
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        for other in CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == other:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", *_ROOTS):
                    break
        element = _Element(tag, attributes, stack[-1].main or stack[-1].inside)
        stack[-1].parts.append(element)
        if tag in _RAW and not (element.inside and tag in _READ):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID and not (attributes.endswith("/") and tag not in _BLOCK):
            stack.append(element)
    return top


def _flat(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\1".join(parts)) - (1 << 63) or 1


def _texts(e: _Element) -> str:
    """All text of an element, for telling articles and pages apart."""
    found, walk = [], [e]
    while walk:
        x = walk.pop()
        if isinstance(x, str):
            found += x.split()
        else:
            walk.extend(reversed(x.parts))
    return " ".join(found)


def subtrees(top: _Element) -> tuple[list[tuple[int, _Element, _Element, int]], dict[int, _Element], dict[int, int]]:
    """(hash, element, where, words) of each element with text that holds no article, parents first; and, by id, the
    element around each one and the words of each one.

    The hash is of tag, attributes and content; inside an article (`where`; else it is the page) only containers
    count, and those of a listed class once more by that class alone.
    """
    # Children before parents, without recursion: pages may nest deeply.
    order, walk, around, where = [], [top], {}, {id(top): top}
    while walk:
        e = walk.pop()
        order.append(e)
        for p in e.parts:
            if isinstance(p, _Element) and (p.parts or p.tag not in _RAW):
                around[id(p)], where[id(p)] = e, e if e.main else where[id(e)]
                walk.append(p)
    hashes: dict[int, int] = {}
    words: dict[int, int] = {}
    holds: set[int] = set()
    for e in reversed(order):
        told, n = [e.tag, e.attributes], 0
        for p in e.parts:
            if isinstance(p, str):
                if t := _flat(p):
                    told.append(t)
                    n += t.count(" ") + 1
            elif id(p) in hashes:
                told.append(f"\0{hashes[id(p)]}")
                n += words[id(p)]
                if p.main or id(p) in holds:
                    holds.add(id(e))
        hashes[id(e)], words[id(e)] = _digest(*told), n
    found = []
    for e in order:
        if words[id(e)] and not e.main and id(e) not in holds and e.tag not in ("", "html", "body") and (not e.inside or e.tag in _CONTAINERS):
            found.append((hashes[id(e)], e, where[id(e)], words[id(e)]))
            if e.named:
                found.append((_digest("\0class", e.tag, e.named), e, where[id(e)], LONG))
    return found, around, words


def counted(top: _Element) -> set[tuple[int, int, bool]]:
    """(hash, text it stands in, whether it is long) of each subtree; hash 0 for the page itself."""
    found = subtrees(top)[0]
    text = {id(e): _digest(_texts(e)) for e in {id(e): e for e in [top, *(w for _, _, w, _ in found)]}.values()}
    return {(0, text[id(top)], False), *((h, text[id(w)], n >= LONG) for h, _, w, n in found)}


def main_text(top: _Element, template: set[int] | None = None) -> str:
    """The blocks of the articles, else of the main parts, else of the page, without boilerplate and template."""
    if template:
        found, around, words = subtrees(top)
        gone = {id(e): e for h, e, _, _ in found if h in template}
        named = {id(e) for h, e, _, _ in found if e.named and h == _digest("\0class", e.tag, e.named) and h in template}
        # An article of which recurring containers are more than half is a copy of others, and keeps them.
        inside: dict[int, list[_Element]] = {}
        for e, w in {id(e): (e, w) for _, e, w, _ in found if id(e) in gone and e.inside and id(e) not in named}.values():
            a = around[id(e)]
            while a is not w and id(a) not in gone:
                a = around[id(a)]
            if a is w:
                inside.setdefault(id(w), []).append(e)
        copies = {k for k, own in inside.items() if 2 * sum(words[id(e)] for e in own) > words[k]}
        for _, e, w, _ in found:
            if id(e) in gone and (id(w) not in copies or id(e) in named):
                e.parts = []
    roots = _roots(top, "article") or _roots(top, "main") or _roots(top, "article", True) or _roots(top, "main", True) or [top]
    blocks = _blocks(roots, False)
    # A page that is boilerplate by the names of its outer elements alone is read by its tags.
    return "\n\n".join(blocks or _blocks(roots, True))


def _blocks(roots: list[_Element], by_tag: bool) -> list[str]:
    """The texts of the blocks of the elements, without boilerplate; by_tag: names don't count."""
    blocks: list[str] = []
    for root in roots:
        run: list[str] = []

        def end(run: list[str] = run) -> None:
            if t := _flat("".join(run)):
                blocks.append(t)
            run.clear()

        walk: list = [root]
        while walk:
            e = walk.pop()
            if isinstance(e, str):
                run.append(e)
            elif e is None:
                end()
            elif (e.tag in _GONE and not (e.inside and e.tag in _READ)) if by_tag else e.gone and e is not root:
                if e.tag in _BLOCK:
                    end()
            elif e.tag == "br":
                run.append("\n")
            else:
                if e.tag in _BLOCK:
                    end()
                    walk.append(None)
                walk.extend(reversed(e.parts))
        end()
    return blocks


def _roots(top: _Element, tag: str, by_tag: bool = False) -> list[_Element]:
    """The outermost elements of a tag, in page order, outside boilerplate; by_tag: names don't count."""
    found, walk = [], [top]
    while walk:
        e = walk.pop()
        if e.tag == tag:
            found.append(e)
        elif not (e.tag in _GONE if by_tag else e.gone):
            walk += [p for p in reversed(e.parts) if isinstance(p, _Element)]
    return found


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame, markup: str = "html", url: str = "url", least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, hashes): the subtrees that recur on at least `least` pages of different texts, and on this share of
    the pages of a host or with LONG words."""
    schema = "host string, seen array<struct<hash: long, place: long, long: boolean>>"
    one = pa.struct([("hash", pa.int64()), ("place", pa.int64()), ("long", pa.bool_())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            own = [[{"hash": h, "place": w, "long": n} for h, w, n in sorted(counted(parse(x.as_py() or "")))] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(one))], ["host", "seen"])

    seen = pages.select(host(F.col(url)).alias("host"), F.col(markup).alias("html")).mapInArrow(hashed, schema)
    # Hash 0 counts the pages of the host. A page, or article, that is there again counts once.
    seen = seen.select("host", F.inline("seen")).distinct()
    counts = written(seen.groupBy("host", "hash").agg(F.count("*").alias("count"), F.max("long").alias("long")).filter(f"hash = 0 OR count >= {least}"), "subtrees")
    totals = counts.filter("hash = 0").select("host", F.col("count").alias("pages"))
    often = counts.filter("hash != 0").join(totals, "host").filter(F.col("long") | (F.col("count") >= F.col("pages") * share))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, markup: str = "html", url: str = "url", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (all but the markup) and the main text.

    Null and empty markup gives an empty text. Paragraphs in an article stay even where they recur on their host.
    Pages without a host count as one host. Repeated rows are extracted alike. An empty table gives no rows; a column
    named like the text column is replaced.
    """
    keep = [c for c in pages.columns if c != markup] if keep is None else keep
    keep = [c for c in keep if c != text]
    found = written(templates(pages, markup, url), "templates")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), host(F.col(url)).alias("host"), F.col(markup).alias("html"))
    if found.select(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0] <= BROADCAST:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        rows = rows.withColumn("salt", bucket(SALTS, F.col("html")))
        rows = rows.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    rows = rows.select("row", "html", "hashes")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField(text, T.StringType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            known: dict[bytes, set[int]] = {}
            texts = []
            for page, hashes in zip(batch.column(1), batch.column(2), strict=True):
                own = hashes.values.to_numpy() if hashes.is_valid else np.empty(0, dtype=np.int64)
                key = own.tobytes()
                if key not in known:
                    known[key] = set(own.tolist())
                texts.append(main_text(parse(page.as_py() or ""), known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(extracted, schema).select("row.*", text)
