"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same chain of tags, classes
and ids from the root are one style node. Over the host's pages a node has a
distribution of presentations (the sequence of its children's styles), whose entropy over the
logarithm of the number of pages is near 0 for a fixed frame and 1 for what no two pages
share, and a distribution of contents, its own words and links, with an entropy of its own. Words
that every page repeats tell nothing: a node's information is its words times the entropy of its contents, and a
branch's is the sum over its nodes.

A node's importance is made of its own presentations and of the part of a page's information that is in its
branch; the more presentations it has, the more they count. Nodes of low importance beside the running text are removed
from each page, and inside it those that are repeated whole; so are branches whose markup says what
they are (navigation, notices, adverts, forms, comments), which is all there is to go by on
hosts of few pages. What is left of the article is the text.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.llm.common import free_name, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A style node of fewer different pages says nothing about repetition.
MIN_PAGES = 5
MIN_IMPORTANCE = 0.3
#: How much less the contents count with every presentation a node has.
DAMPING = 0.9
#: Pages whose places in the tree are counted together before they are sent.
COUNTED_PAGES = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
#: Elements that are never part of the text.
NOISE_TAGS = frozenset(
    "head script style noscript template nav aside footer form button select textarea iframe object svg canvas menu "
    "dialog audio video".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that name what a branch is.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar comment comments disqus reply replies respond share sharing social related "
    "recommended widget toolbar pagination pager login signup".split())
#: Page headers are noise; the header of an article holds its title.
HEADER_WORDS = frozenset(["header", "masthead"])
#: First and last words of a name that tells of a state or of what is not there
#: (no-sidebar, comments-open), not of what the branch is.
STATE_FIRST = frozenset("no not without with has".split())
STATE_LAST = frozenset("open opened closed enabled disabled off".split())
#: How much of an element's classes and ids names noise.
PARTLY, WHOLLY = 1, 2
#: Elements that hold running text are not judged by how often they are repeated.
TEXT_TAGS = frozenset("html body main article p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th".split())
#: Elements that a running text is made of.
RUNNING_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th".split())
#: Elements whose contents are not shown.
UNSEEN_TAGS = frozenset("head script style template noscript".split())
_CLOSES = {  # a start tag ends the open element of the first set, up to the second
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("children", "content", "link", "named", "names", "nested", "noise", "parent", "style", "tag", "within")

    def __init__(self, tag: str, names: str, noise: bool, parent: Node | None):
        self.tag, self.names, self.noise, self.parent = tag, names, noise, parent
        self.children: list[Node | str] = []
        self.style = self.content = self.named = 0
        self.link = ""
        self.within = bool(parent) and (parent.within or parent.tag in ("article", "main"))
        self.nested = bool(parent) and (parent.nested or parent.tag == "article")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", "", False, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self._open((tag,), ()):
            return
        if tag in BLOCK:
            self._close_paragraph()
        if tag in _CLOSES and (old := self._open(*_CLOSES[tag])):
            self.at = old.parent
        given = {k: v or "" for k, v in attrs}
        node = Node(tag, f"{given.get('class', '')} {given.get('id', '')}".strip(), False, self.at)
        node.noise = _is_noise(node, given)
        node.named = 0 if node.noise else _named_noise(node)
        node.link = given.get("href", "") if tag == "a" else ""
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "script", "style", "a", "b", "i", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            # The end of an inline element does not end the blocks around or inside it,
            # but what is never text ends where its tag does.
            if tag not in BLOCK and tag not in NOISE_TAGS and node.tag in BLOCK:
                return
            node = node.parent
        if node.parent and tag not in ("html", "body"):
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _open(self, tags, until) -> Node | None:
        node, found = self.at, None
        while node.parent and node.tag not in until:
            if node.tag in tags:
                found = node  # the outermost, so that td and tr both end
            node = node.parent
        return found

    def _close_paragraph(self):
        node = self.at
        while node.parent and node.tag not in BLOCK:
            node = node.parent
        if node.tag == "p":
            self.at = node.parent


def _is_noise(node: Node, given: dict[str, str]) -> bool:
    tag = node.tag
    if tag in NOISE_TAGS or "hidden" in given or given.get("aria-hidden") == "true":
        return True
    if "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "header" and not node.within:
        return True
    return given.get("role", "").lower() in NOISE_ROLES


def _named_noise(node: Node) -> int:
    """Whether no, some or all of the element's classes and ids name noise."""
    if node.tag in ("html", "body", "main"):
        return 0
    header = not node.within and node.tag not in ("article", "h1")
    noisy, clean = False, False
    for name in node.names.split():
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        state = len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST)
        if not state and any(w in NOISE_WORDS or (header and w in HEADER_WORDS) for w in words):
            noisy = True
        elif words:
            clean = True
    return (PARTLY if clean else WHOLLY) if noisy else 0


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _in_order(root: Node) -> list[Node]:
    """Every element, parents first."""
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        out.append(node)
        open_ += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest(repr(parts)) >> 1


def annotate(root: Node, host: str) -> list[Node]:
    """Give every element its style (where it is in the tree) and content hashes."""
    nodes = _in_order(root)
    for node in nodes:
        names = re.sub("[0-9]+", "0", " ".join(sorted(node.names.split())))
        node.style = _hash(node.parent.style if node.parent else host, node.tag, names)
    for node in reversed(nodes):
        node.content = _hash(*[c.content if isinstance(c, Node) else " ".join(c.split()) for c in node.children])
    return nodes


def _holds_article(nodes: list[Node]) -> set[int]:
    """Ids of the elements that hold an article or main element; they are not noise."""
    out = set()
    for node in nodes:
        if node.tag in ("article", "main") and not node.noise and not node.named:
            up = node.parent
            while up and id(up) not in out:
                out.add(id(up))
                up = up.parent
    return out


def main_text(root: Node, nodes: list[Node], low: frozenset[int]) -> str:
    """The text of the article without noise and without branches of low importance.

    Names alone do not remove an article, unless it lies in another one or all its
    names are noise, nor a partly named branch with most of the page's important text.
    If names would leave no text at all, no article and no such branch goes by name.
    """
    keep = _holds_article(nodes)
    bad = {
        id(n) for n in nodes
        if (n.noise and (n.tag in NOISE_TAGS or id(n) not in keep))
        or (n.style in low and n.tag not in TEXT_TAGS and id(n) not in keep)
    }
    named = [n for n in nodes if n.named and id(n) not in bad and id(n) not in keep]
    if not named:
        return _article(root, nodes, bad)
    sizes = _sizes(nodes, bad)
    large = {id(n) for n in named if 2 * sizes[id(n)] > sizes[id(root)]}
    articles = {id(n) for n in named if n.tag == "article"}
    stay = {
        id(n) for n in named
        if (id(n) in articles and not n.nested and (n.named == PARTLY or id(n) in large))
        or (id(n) not in articles and n.named == PARTLY and id(n) in large)
    }
    for n in named:  # a branch around the page's article
        if n.named == PARTLY and not n.nested and id(n) in articles & large:
            up = n.parent
            while up and not (up.tag == "article" and up.named):
                stay.add(id(up))
                up = up.parent
    by_name = {id(n) for n in named}
    return _article(root, nodes, bad | (by_name - stay)) or _article(root, nodes, bad | (by_name - large - articles))


def _sizes(nodes: list[Node], bad: set[int]) -> dict[int, int]:
    """Characters of text, without white space, in every element and not in a bad one."""
    sizes: dict[int, int] = {}
    for node in reversed(nodes):  # children come first
        sizes[id(node)] = 0 if id(node) in bad else sum(
            sizes[id(c)] if isinstance(c, Node) else sum(map(len, c.split())) for c in node.children)
    return sizes


def _article(root: Node, nodes: list[Node], bad: set[int]) -> str:
    tops = _outermost(nodes, "article", bad) or _outermost(nodes, "main", bad)
    text = "\n".join(t for t in (_blocks(n, bad) for n in tops) if t)
    return text or _blocks(root, bad)


def _outermost(nodes: list[Node], tag: str, bad: set[int]) -> list[Node]:
    gone: set[int] = set()
    out = []
    for node in nodes:  # parents come first
        if node.parent and (id(node.parent) in gone):
            gone.add(id(node))
        elif id(node) in bad:
            gone.add(id(node))
        elif node.tag == tag:
            out.append(node)
            gone.add(id(node))
    return out


def _blocks(root: Node, bad: set[int]) -> str:
    """White space inside a block becomes one space; blocks are joined by line feeds."""
    out: list[str] = []
    line: list[str] = []

    def end_block():
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    open_: list[Node | str | None] = [root]
    while open_:
        x = open_.pop()
        if x is None:
            end_block()
        elif isinstance(x, str):
            line.append(x)
        elif id(x) in bad:
            if x.tag in BLOCK:
                end_block()
        else:
            if x.tag == "br":
                line.append(" ")
            if x.tag in BLOCK:
                end_block()
                open_.append(None)
            open_ += reversed(x.children)
    end_block()
    return "\n".join(out)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _own(nodes: list[Node]) -> dict[int, list[str]]:
    """The words and links of each block, by the block's style, inline elements included."""
    out: dict[int, list[str]] = {}
    block: dict[int, Node | None] = {}  # the block an element's text is in; None where it is not shown
    for node in nodes:  # parents come first
        around = block[id(node.parent)] if node.parent else node
        at = block[id(node)] = None if around is None or node.tag in UNSEEN_TAGS else node if node.tag in BLOCK else around
        if at is None:
            continue
        found = out.setdefault(at.style, [])
        for c in node.children:
            if isinstance(c, str):
                found += c.split()
        if node.link:
            found.append(node.link)
    return out


def _chain(node: Node) -> list[int]:
    """The styles of a block and of the blocks around it, outermost first."""
    out, at = [], node
    while at:
        if at.tag in BLOCK:
            out.append(at.style)
        at = at.parent
    return out[::-1]


#: Rows of the first pass: a node of a page, and pages with a node.
_NODE, _PLACE = range(2)


def _observed(pages: DataFrame) -> DataFrame:
    """All that the style trees are made of, from one pass over the pages."""
    def look(batches):
        for batch in batches:
            hosts, htmls = batch.column("host"), batch.column("html")
            for first in range(0, batch.num_rows, COUNTED_PAGES):
                rows: list[tuple] = []
                places: dict[tuple, list[int]] = {}
                for i in range(first, min(batch.num_rows, first + COUNTED_PAGES)):
                    host, root = hosts[i].as_py(), parse(htmls[i].as_py())
                    nodes = annotate(root, host)
                    own = _own(nodes)
                    merged: dict[int, list[Node]] = {}
                    for n in nodes:
                        if n.tag in BLOCK:
                            merged.setdefault(n.style, []).append(n)
                    for style, same in merged.items():
                        shape = _hash(*[c.style for n in same for c in n.children if isinstance(c, Node)])
                        words = own.get(style, [])
                        rows.append((
                            _NODE, host, style, _hash(*[n.content for n in same]), shape, root.content,
                            xxhash.xxh64_intdigest(" ".join(words)) >> 1, len(words), None))
                        place = (host, style, int(same[0].tag in RUNNING_TAGS))
                        if place not in places:
                            places[place] = _chain(same[0])
                rows += [(_PLACE, *p, None, None, None, None, chain) for p, chain in places.items()]
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                kinds = (pa.int8(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    ["kind", "host", "style", "content", "shape", "page", "own", "words", "chain"])

    return pages.where("host <> ''").select("host", "html").mapInArrow(
        look, "kind byte, host string, style long, content long, shape long, page long, own long, words long, chain array<long>")


def low_importance(pages: DataFrame) -> DataFrame:
    """``host, styles``: per host the style nodes that are removed.

    Every block element of every page is in its host's tree. A host's style tree counts each
    different page once, however often it is copied.
    """
    raw = written(_observed(pages), "observed")
    n = F.count(F.lit(1))
    # Counts of whole contents, presentations and own contents of each style node, in one pass.
    seen = raw.where(F.col("kind") == _NODE).select("host", "style", "content", "shape", "page", "own", "words").distinct()
    counted = seen.select("host", "style", "words", F.inline(F.array(*[
        F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in ("content", "shape", "own")
    ]))).groupBy("host", "style", "of", "value").agg(n.alias("n"), F.sum("words").alias("words"))
    entropy = counted.groupBy("host", "style", "of").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), n.alias("kinds"), F.sum("words").alias("words")
    ).where(F.col("m") >= MIN_PAGES).withColumn("h", (F.log("m") - F.col("s") / F.col("m")) / F.log("m"))

    def of(what: str, column: str) -> Column:
        return F.max(F.when(F.col("of") == what, F.col(column)))

    nodes = entropy.groupBy("host", "style").agg(
        F.max("m").alias("m"), F.max(F.when(F.col("of") != "own", F.col("h"))).alias("repeated"),
        of("shape", "h").alias("presentation"), of("shape", "kinds").alias("kinds"), (of("own", "h") * of("own", "words")).alias("own"))

    # The information of each block's own words, and of its whole branch.
    places = raw.where(F.col("kind") == _PLACE).groupBy("host", "style").agg(F.max("content").alias("running"), F.min("chain").alias("chain"))
    tree = written(places.join(nodes, ["host", "style"]), "tree")
    branch = tree.select("host", F.explode("chain").alias("style"), "own").groupBy("host", "style").agg(F.sum("own").alias("info"))
    branch = written(tree.join(branch, ["host", "style"]).withColumn("parent", F.try_element_at("chain", F.lit(-2))), "branches")
    whole = branch.groupBy("host").agg(F.max("info").alias("whole"), F.max("m").alias("pages"))
    # Running text is where most of a branch's information is in its own words and its paragraphs.
    text = branch.where("running = 1").groupBy("host", F.col("parent").alias("style")).agg(F.sum("info").alias("text"))
    running = branch.join(text, ["host", "style"], "left").where(
        2 * (F.coalesce("text", F.lit(0.0)) + F.col("own")) >= F.col("info")).select("host", F.col("style").alias("around"), F.lit(1).alias("inside"))
    above = branch.select("host", "style", F.explode(F.slice("chain", 1, F.size("chain") - 1)).alias("around"))
    inside = above.join(running, ["host", "around"]).groupBy("host", "style").agg(F.max("inside").alias("inside"))

    judged = branch.join(whole, "host").join(inside, ["host", "style"], "left")
    # Without any information on the host nothing can be told by it.
    share = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("info") / F.col("m"), F.col("whole") / F.col("pages"))), F.lit(1.0))
    damped = F.pow(F.lit(DAMPING), F.col("kinds"))
    importance = (1 - damped) * F.col("presentation") + damped * share
    low = judged.where(
        F.when(F.col("inside").isNull(), importance < MIN_IMPORTANCE).otherwise(False) | (F.col("repeated") < MIN_IMPORTANCE))
    return low.groupBy("host").agg(F.collect_set("style").alias("styles"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` (replaced if there is one).

    NULL and empty pages have an empty text; a page without a host is judged by its
    markup alone. White space is what Unicode calls so, character references included.
    """
    rest = [c for c in pages.columns if c not in (html, "text")]
    # Names of ours that no column of the pages has.
    host_, html_ = (free_name(pages, c) for c in ("_host", "_html"))
    hosted = pages.withColumns({host_: host_of(F.col(url)), html_: F.col(html)})
    low = written(low_importance(hosted.select(F.col(host_).alias("host"), F.col(html_).alias("html"))), "styles")
    low_host, low_styles = (free_name(pages, c) for c in ("_low_host", "_low"))
    low = low.withColumnsRenamed({"host": low_host, "styles": low_styles})

    @F.arrow_udf("string")
    def text(htmls: pa.Array, hosts: pa.Array, styles: pa.Array) -> pa.Array:
        out = []
        for h, name, s in zip(htmls, hosts, styles, strict=True):
            root = parse(h.as_py())
            nodes = annotate(root, name.as_py())
            out.append(main_text(root, nodes, frozenset(s.as_py() or ())))
        return pa.array(out, pa.string())

    joined = hosted.join(low, hosted[host_] == low[low_host], "left")
    return joined.select(*rest, text(html_, host_, low_styles).alias("text"))
