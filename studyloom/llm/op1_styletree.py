"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element paths.  A path has a
presentation importance, the entropy of its pages' styles (the sequence of
child elements), and a content importance, one less the mean entropy of its
texts over pages: what every page repeats tells nothing.  Both combine from
the leaves up, as in the published method: an element's importance is
(1 - g^l) of its own entropy and g^l of its parts' mean, g = 0.9 and l the
number of its styles.  The fewer pages tell of a path, the nearer is its
importance to 1.  A branch of a page whose importance on its host is low
goes.  Elements that announce themselves as furniture (nav, footer, forms,
class names such as "sidebar" or "comments") have importance 0 from the
start, and elements that announce the article outweigh what lies outside.

Entropies are counts by (host, path, feature), partially aggregated before
the shuffle, so a host with a third of all pages has small groups.  Pages are
parsed twice; their html moves once, by page, when the short list of path
importances is joined back.

Null or empty html gives an empty text; a null or odd url belongs to the
host "".  Broken markup is read as far as it goes: an unclosed tag ends where
a browser would end it, an unclosed script runs to the end.  A page whose
branches would all go keeps those that do not announce themselves as
furniture.  Repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .shared import written

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr "
    "math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mfenced mpadded mtable mtr mtd semantics annotation annotation-xml".split()
)
FURNITURE_TAGS = frozenset("head nav aside footer form button select input textarea object canvas audio video dialog menu datalist fieldset optgroup option script style noscript iframe template svg annotation annotation-xml".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in class names and ids that announce furniture, and those that announce the article.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup signin login register search share sharing sharebar social related recommended "
    "recommendations comments comment commentlist respond disqus reply replies pagination pager toolbar copyright disclaimer trending popular paywall alert teaser teasers".split()
)
HEADER_WORDS = frozenset("header head hero topnav".split())
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())

_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_P_STAYS = INLINE | {"p", "option", "optgroup", "li", "dt", "dd", "tr", "td", "th", "caption"} - {"p"}
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|<[!?/][^>]*+>?", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"\d+")


#: Elements below an article whose names may announce furniture.
CONTAINERS = frozenset("div section ul ol dl table aside header center fieldset figure details article".split())
#: Branches of less importance go.
LEAST_IMPORTANCE = 0.15


@dataclass(slots=True)
class Node:
    tag: str
    label: str  # classes and id without numbers, part of the style
    parent: int
    path: int
    words: frozenset = frozenset()
    role: str = ""
    hidden: bool = False
    body: bool = False  # itemprop says that this is the article's body
    styles: list = field(default_factory=list)


@dataclass(slots=True)
class Page:
    nodes: list
    texts: list  # (segment, node, text): texts of one segment are one block


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) - (1 << 63)


def parse(source: str) -> Page:
    """The elements and texts of a page, in page order; parents come before their children."""
    nodes = [Node("#root", "", -1, _key("#root"))]
    texts: list[tuple[int, int, str]] = []
    stack, segment, at = [0], 0, 0
    opened: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack each name is open, so that no tag has to search it
    blocks = [0]  # where in the stack elements are that are not inline

    def text(raw: str) -> None:
        if raw:
            texts.append((segment, stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def pop_to(index: int) -> None:
        nonlocal segment
        while len(stack) > index:
            tag = nodes[stack.pop()].tag
            opened[tag].pop()
            if tag not in INLINE:
                blocks.pop()
                segment += 1

    def innermost(names: set[str]) -> int:
        return max((opened[n][-1] for n in names if opened[n]), default=0)

    while at < len(source):
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "br":
                texts.append((segment, stack[-1], " "))
            if opened[name] and not (name in INLINE and blocks[-1] > opened[name][-1]):
                pop_to(opened[name][-1])
            continue
        if name == "br":
            texts.append((segment, stack[-1], " "))
            continue
        if name in VOID:
            segment += name == "hr"
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            segment += name not in INLINE and name not in {"script", "style", "noscript", "template"}
            continue
        if name not in _P_STAYS and blocks[-1] and nodes[stack[blocks[-1]]].tag == "p":
            pop_to(blocks[-1])
        if name in _CLOSES:
            while (i := innermost(_CLOSES[name])) > innermost(_SCOPE[name]):
                pop_to(i)
                if name not in {"tr", "tbody", "tfoot", "thead"}:
                    break
        label, words, role, hidden, main = "", frozenset(), "", False, False
        given = m[3]
        if given and not given.isspace():
            attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in reversed(list(_ATTR.finditer(given)))}
            named = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            if named:
                label = _NUMBER.sub("", named)
                words = frozenset(w.lower() for w in _WORDS.findall(named))
            role = attrs.get("role", "").lower()
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
            main = attrs.get("itemprop", "").lower() == "articlebody"
        parent = stack[-1]
        style = f"{name}.{label}" if label else name
        own = nodes[parent].styles
        if not own or own[-1] != style:
            own.append(style)
        nodes.append(Node(name, label, parent, _key(nodes[parent].path, style), words, role, hidden, main))
        opened[name].append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
            segment += 1
        stack.append(len(nodes) - 1)
    return Page(nodes, texts)


def features(page: Page) -> set[tuple[int, int, int]]:
    """(path, kind, feature) of a page: kind 0 a style of the element, kind 1 a text in it."""
    styles, out = defaultdict(set), set()
    for n in page.nodes:
        styles[n.path].add(_key(*n.styles))
    for path, found in styles.items():
        out.add((path, 0, _key(*sorted(found))))
    for _, node, text in page.texts:
        own = " ".join(text.split())
        if own:
            out.add((page.nodes[node].path, 1, _key(own)))
    return out


def furniture(n: Node, inside: bool) -> bool:
    """Whether an element announces itself as no part of the article; inside: below an article element."""
    if n.tag in FURNITURE_TAGS or n.role in FURNITURE_ROLES or n.hidden:
        return True
    if n.tag in {"#root", "html", "body", "main"} or n.role == "main":
        return False
    if not inside and (n.tag == "header" or n.words & HEADER_WORDS and not n.words & ARTICLE_WORDS):
        return True
    if inside and n.tag not in CONTAINERS:
        return False  # a heading's id is made of its words, and so are a paragraph's classes at times
    return bool(n.words & FURNITURE_WORDS)


def sure(importance: float, pages: int) -> float:
    """An importance drawn towards 1 by what few pages cannot tell: one page tells nothing, two three quarters."""
    return 1 - (1 - importance) * (1 - 1 / pages**2)


def extract(page: Page, known: dict[int, tuple[int, float, float, int]], least_importance: float = LEAST_IMPORTANCE) -> str:
    """The main text of a page; known has (pages, presentation, content, styles) for paths of its host."""
    nodes = page.nodes
    n = len(nodes)
    size, own_text, link = [0] * n, [False] * n, [0] * n
    for _, i, t in page.texts:
        chars = len(t) - t.count(" ")
        if chars and not t.isspace():
            size[i] += chars
            own_text[i] = True
    for i in range(n):
        if nodes[i].tag == "a":
            link[i] = size[i]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        link[p] += size[i] if nodes[i].tag == "a" else link[i]

    articles = {"article"}
    inside, gone = [False] * n, [False] * n
    holds = [False] * n  # what may be the article lies below
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        named = x.tag in {"div", "section", "td"} and bool(x.words & ARTICLE_WORDS) and 3 * size[i] >= size[0]
        if holds[i] or ((x.tag in articles or x.tag == "main" or x.body or named) and not x.words & FURNITURE_WORDS):
            holds[x.parent] = True
    article = [0] * n  # the outermost article element that a node lies in
    for i in range(1, n):
        x, p = nodes[i], nodes[i].parent
        inside[i] = inside[p] or x.tag in articles or x.body
        article[i] = article[p] or (i if inside[i] else 0)
        # a wrapper of most of the page is no furniture, whatever its name, and neither is a form around all of it
        wraps = holds[i] and not inside[i] and 2 * size[i] >= size[0] and x.tag not in FURNITURE_TAGS - {"form"}
        # nor is, in an article, what names itself its content and holds a third of it
        wraps = wraps or bool(article[p] and x.words & ARTICLE_WORDS) and 3 * size[i] >= size[article[p]] and x.tag in CONTAINERS - {"aside"} and not x.hidden and x.role not in FURNITURE_ROLES
        announced = furniture(x, inside[i]) and not wraps
        gone[i] = gone[p] or announced

    def roots(test) -> list[int]:
        found = []
        for i in range(1, n):
            if test(nodes[i]) and not gone[i] and size[i]:
                p = nodes[i].parent
                while p > 0 and p not in chosen:
                    p = nodes[p].parent
                if p <= 0:
                    found.append(i)
                    chosen.add(i)
        return found

    chosen: set[int] = set()
    top = roots(lambda x: x.tag == "article")
    firm = bool(top)
    if not top:
        chosen = set()
        top = roots(lambda x: x.body or x.tag == "main" or x.role == "main")
        firm = bool(top)
    if not top:
        chosen = set()
        top = [i for i in roots(lambda x: x.tag in {"div", "section", "td"} and bool(x.words & ARTICLE_WORDS)) if 2 * size[i] >= size[0] - sum(size[j] for j in range(1, n) if gone[j] and not gone[nodes[j].parent])]
    within = [False] * n
    starts = set(top) or {0}
    for i in range(n):
        within[i] = i in starts or (i > 0 and within[nodes[i].parent])

    # importance from the leaves up
    parts: list[list[float]] = [[] for _ in range(n)]
    importance = [1.0] * n
    for i in range(n - 1, -1, -1):
        pages, presentation, content, styles = known.get(nodes[i].path, (1, 1.0, 1.0, 1))
        if own_text[i]:
            parts[i].append(content)
        g = 0.9**styles
        own = content if not nodes[i].styles and own_text[i] else (1 - g) * presentation + g * (sum(parts[i]) / len(parts[i]) if parts[i] else presentation)
        importance[i] = sure(own, pages)
        if i:
            parts[nodes[i].parent].append(importance[i])

    whole = sum(size[i] for i in starts)
    low = [False] * n
    for i in range(1, n):
        x = nodes[i]
        low[i] = low[x.parent]
        if within[i] and i not in starts and not low[i] and x.tag not in INLINE:
            weak = importance[i] < least_importance
            if firm:  # in an article element only a side branch can be low
                weak = weak and x.tag in {"div", "section", "ul", "ol", "table", "dl", "header"} and 2 * size[i] < whole
            else:
                links = x.tag in {"div", "section", "ul", "ol", "table"} and size[i] > 0 and link[i] > 0.7 * size[i]
                weak = weak or (links and 2 * size[i] < whole)
            low[i] = weak

    def joined(skip_low: bool) -> str:
        blocks: dict[int, list[str]] = {}
        for segment, i, t in page.texts:
            if within[i] and not gone[i] and not (skip_low and low[i]):
                blocks.setdefault(segment, []).append(t)
        found = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(b for b in found if b)

    return joined(True) or joined(False)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def site_of(host: str, path: int) -> int:
    """One number for a path on a host."""
    return _key(host, path)


def importances(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, url, html): (site, pages, presentation, content, styles), and the sites (id, site) of every page.

    A site is a path on a host, see site_of; the last bit of a feature tells
    styles (0) from texts (1).  So what is shuffled is three numbers a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "html", 1 << 20):
            rows: list[tuple] = []
            for key, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host_of(url)
                rows += [(key, site_of(host, path), f & ~1 | kind) for path, kind, f in sorted(features(parse(source or "")))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [batch.schema.types[0], pa.int64(), pa.int64()], strict=True)], names=["id", "site", "feature"])

    kind = pages.schema["id"].dataType.simpleString()
    found = written(pages.mapInArrow(run, f"id {kind}, site long, feature long"), "page-features")
    counts = found.groupBy("site", "feature").agg(F.count("*").alias("c"))
    style, text = F.col("feature") % 2 == 0, F.col("feature") % 2 != 0
    sums = counts.groupBy("site").agg(
        F.sum(F.when(style, F.col("c"))).alias("pages"),
        F.sum(F.when(style, F.col("c") * F.log("c"))).alias("clogc"),
        F.count(F.when(style, 1)).alias("styles"),
        F.avg(F.when(text, F.log("c"))).alias("text_log"),
    )
    m = F.log("pages")
    presentation = F.when(F.col("pages") > 1, (m - F.col("clogc") / F.col("pages")) / m).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.least(F.lit(1.0), F.coalesce("text_log", F.lit(0.0)) / m)).otherwise(1.0)
    model = sums.select("site", F.col("pages").cast("long").alias("pages"), presentation.alias("presentation"), content.alias("content"), "styles")
    return model, found.where(style).select("id", "site")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """(id, url, host, text) for each page."""
    plain = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = plain.withColumn("id", F.xxhash64("page", "url", "html"))
    model, paths = importances(keyed.select("id", "url", "html"))
    # a page's own paths with what its host says of them; rows repeated in the input repeat here and are merged
    # written, so that the join reads a plain table: Spark can then broadcast it if it is small, or split a hot site's pages
    telling = written(model.where("pages > 1"), "site-importances")  # a path of one page has importance 1
    lists = paths.join(telling, "site").groupBy("id").agg(F.collect_set(F.struct("site", "pages", "presentation", "content", "styles")).alias("known"))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "html", 1 << 20):
            hosts, out = [], []
            for url, source, known in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                table = {k["site"]: (k["pages"], k["presentation"], k["content"], k["styles"]) for k in known or ()}
                host = host_of(url)
                hosts.append(host)
                page = parse(source or "")
                known = {n.path: table[x] for n in page.nodes if (x := site_of(host, n.path)) in table} if table else {}
                out.append(extract(page, known, least_importance))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(out, pa.string())], names=["page", "url", "host", "text"])

    return keyed.join(lists, "id", "left").select("page", "url", "html", "known").mapInArrow(run, f"page {kind}, url string, host string, text string")


def op1_styletree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("page").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
