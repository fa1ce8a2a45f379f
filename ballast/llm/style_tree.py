"""Main text of web pages by site style trees.

The DOMs of all pages of a host are merged into one style tree (Yi, Liu and Li 2003): its nodes are paths of block elements with their classes, and each node counts
which child sequences (presentation styles) and which texts it has on how many pages. The importance of a node is the entropy of these
counts: a node that looks and reads alike on every page is template, one that varies is content. Branches of low importance are removed from
each page.

The tree is never built in one place: its counts are groups (host, node, style or text), summed on Spark, and a page needs
only the importance of its own paths. Markup that names itself (navigation, footers, adverts, comments, by tag, role or class) goes
whatever its entropy, as adverts vary too; it is not counted. Inline markup is part of its block's text: outside of an article it goes if a part of its class, id
or role names it, inside only if a whole one does (``ad``, not ``share-price``). An ``article`` or ``main`` element is a prior: everything else inside of it starts at importance 1, and
what stands outside of it on the same page at 0. The prior weighs as much as ``PRIOR_PAGES`` pages against the entropy over the differing pages that have the
node. So a branch inside goes if many differing pages repeat it, one outside stays if it varies over many of them, and
a text that copies of one page repeat is kept.

An undecided node on a page without a main element starts at 1 as well, at the weight of ``UNDECIDED_PAGES`` pages: one that never varies goes from four pages
on. The weights grow with the pages; there is no number of pages at which the rule is another one.

Defined results: a null html is an empty page with an empty text; pages without a usable URL share the empty host. A node on a single
page has nothing to be compared with and keeps its prior. Only ``br`` and ``hr`` end a block among the elements without content. Broken markup is read as far as it goes:
an unclosed element ends with its parent, an unclosed comment, script or style at the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import at_most
from ballast.plans.scratch import materialize

LEAST_IMPORTANCE = 0.3
#: What a branch beside a main element needs to stay.
BESIDE_IMPORTANCE = 0.7
PRIOR_PAGES = 5
UNDECIDED_PAGES = 1.5
#: Weight of a node's presentation against that of its text.
DAMPING = 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PARTS = re.compile(r"[^a-z]+")

# Elements by their meaning in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "hr"))
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("head nav footer aside form button select option optgroup datalist fieldset menu dialog svg canvas object audio video map".split()) | RAW
MAIN = frozenset(("article", "main"))
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in classes, ids and roles that name what is not the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner banners sidebar sidebars nav navbar navigation menu menus menubar breadcrumb breadcrumbs "
    "footer masthead toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies respond share sharing social "
    "related recommended widget widgets pagination pager skip complementary contentinfo search searchbox alert dialog form".split()
)
HEADER = frozenset(("header", "topbar"))
#: First letters of nodes that names decide on. The first ones are never kept.
NAMED_OUT, NAMED_IN = "-", "+"
#: And of undecided nodes on a page with a main element.
BESIDE = "~"


@dataclass
class Block:
    """Text of one block in page order, with the path of its element, and whether names decide on it (0, 1) or not (-1)."""

    path: str
    decided: int
    text: str

    @property
    def node(self) -> str:
        return f"{(NAMED_OUT, NAMED_IN, '?')[self.decided]}{self.path}"


@dataclass
class Page:
    blocks: list[Block]
    styles: dict[str, list[str]]  # path -> child tags of its elements on this page, in order
    has_main: bool

    def node(self, b: Block) -> str:
        """The node of a block, which is another one beside a main element."""
        return f"{BESIDE}{b.path}" if self.has_main and b.decided < 0 else b.node


def attributes(raw: str) -> tuple[str, frozenset[str], frozenset[str]]:
    """The classes as they enter a path, the words in class, id and role, and their whole values."""
    if "=" not in raw:
        return "", frozenset(), frozenset()
    classes, parts, wholes = "", set(), set()
    for name, x, y, z in ATTRIBUTE.findall(raw):
        value = (x or y or z).lower()
        if name.lower() == "class":
            classes = ".".join(sorted(set(value.split())))
        parts.update(NAME_PARTS.split(value))
        wholes.update(value.split())
    return classes, frozenset(parts), frozenset(wholes)


def decoded(text: str) -> str:
    """Character references end with the piece of text that they begin in."""
    return entities.unescape(text) if "&" in text else text


def parse(page: str) -> Page:
    """Read a page in one pass. Only block elements make nodes; inline markup disappears from the text."""
    stack: list[tuple[str, str, int]] = [("", "", -1)]  # tag, path, decided
    blocks: list[Block] = []
    styles: dict[str, list[str]] = {}
    text: list[str] = []
    has_main, at = False, 0

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append(Block(stack[-1][1], stack[-1][2], joined))
            text.clear()

    def close(n: int) -> None:
        flush()
        del stack[n:]

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(decoded(page[at:]))
            break
        if m.start() > at:
            text.append(decoded(page[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE and all(x[0] != tag for x in stack):
                continue
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == tag:
                    close(n)
                    break
            else:
                flush()
            continue
        if tag in INLINE and tag not in VOID:
            _, parts, wholes = attributes(m[3])
            if not (wholes if stack[-1][2] == 1 else parts) & NAMED:
                continue
            # Named inline markup (an advert in a span) ends with its own tag; it is rare, so it becomes a block.
        if tag in VOID:
            if tag in BREAKS:
                flush()
            continue
        if tag in RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag not in HEAD_ONLY and len(stack) > 1 and stack[-1][0] == "head":
            close(len(stack) - 1)
        if tag in ENDS_PARAGRAPH:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == "p":
                    close(n)
                    break
                if stack[n][0] not in INLINE:
                    break
        if tag in CLOSED_BY_SIBLING:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] in SCOPE[tag]:
                    break
                if stack[n][0] in CLOSED_BY_SIBLING[tag]:
                    close(n)
                    break
        flush()
        classes, parts, _ = attributes(m[3])
        _, path, decided = stack[-1]
        styles.setdefault(path, []).append(tag)
        inside = decided == 1
        if decided != 0:
            if tag in BOILERPLATE or parts & NAMED and tag not in ("html", "body") and tag not in MAIN or not inside and (tag == "header" or parts & HEADER and tag not in ("html", "body")):
                decided = 0
            elif tag in MAIN or "main" in parts and "role" in m[3].lower():
                decided, has_main = 1, True
        stack.append((tag, f"{path}/{tag}{'.' + classes if classes else ''}", decided))
    close(1)
    return Page(blocks, styles, has_main)


def host_of(url: str | None) -> str:
    """The host in lower case, without user and port; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\\]*)", url or "")
    return re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower() if m else ""


def short(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, n): on how many pages a node has a presentation style (kind 0) or a text (kind 1), and, where
    there is a prior, on how many with the same text as a whole it stands (kind 2).

    A node is a path with what names decide on it; what they drop isn't counted. Summed within each batch before they leave the task, and over all
    batches by Spark.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, str, int, int], int] = {}
            for url, page in zip(batch["url"], batch["html"], strict=True):
                if not isinstance(page, str) or not page:
                    continue
                host, read = host_of(url), parse(page)
                texts: dict[str, list[str]] = {}
                whole = short("\n".join(b.text for b in read.blocks if b.decided)) if read.has_main else 0
                for b in read.blocks:
                    if not b.decided:
                        continue
                    name = read.node(b)
                    texts.setdefault(name, []).append(b.text)
                    if b.path in read.styles:
                        texts.setdefault(f"{name}\0", read.styles[b.path])
                for name in texts:
                    if name[0] in (NAMED_IN, BESIDE) and name[-1] != "\0":
                        key = (host, name, 2, whole)
                        counts[key] = counts.get(key, 0) + 1
                for node, found in texts.items():
                    key = (host, node.rstrip("\0"), int(node[-1] != "\0"), short("\n".join(found)))
                    counts[key] = counts.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["host", "node", "kind", "value", "n"])

    made = pages.select("url", "html").mapInPandas(run, "host string, node string, kind int, value long, n long")
    return made.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """(host, node, importance): the mean of the entropies of a node's texts and styles, each over the log of the number of pages that have the
    node, and weighed with the prior. Pages count once if there is a main element to copy."""
    total = counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nlog"), F.count("*").alias("values"))
    # - sum p log p with p = n / m is log m - (sum n log n) / m. A single page has an entropy of 0 over a log of 0.
    entropy = F.when(F.col("m") > 1, (F.log2("m") - F.col("nlog") / F.col("m")) / F.log2("m")).otherwise(1.0)
    pick = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    nodes = total.groupBy("host", "node").agg(
        pick(0, entropy).alias("style"), pick(1, entropy).alias("content"), pick(1, F.col("m")).alias("pages"), pick(2, F.col("values")).alias("differing")
    )
    mixed = F.coalesce((1 - DAMPING) * F.col("content") + DAMPING * F.col("style"), "content")
    named = F.substring("node", 1, 1)
    prior = F.when(named == BESIDE, 0.0).otherwise(1.0)
    weight = F.when(named.isin(NAMED_IN, BESIDE), F.lit(float(PRIOR_PAGES))).otherwise(UNDECIDED_PAGES)
    pages = F.coalesce("differing", "pages")
    return nodes.select("host", "node", ((weight * prior + pages * mixed) / (weight + pages)).alias("importance"))


def low_nodes(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, low): the nodes of each host that are not important enough, and those beside main elements that are, sorted."""
    beside = F.substring("node", 1, 1) == BESIDE
    low = importance(style_counts(pages)).where(F.when(beside, F.col("importance") >= BESIDE_IMPORTANCE).otherwise(F.col("importance") < least))
    return low.groupBy("host").agg(F.array_sort(F.collect_set("node")).alias("low"))


def text_of(page: str, low: frozenset[str]) -> str:
    """The text of the branches that no name drops and that are left; beside a main element those that ``low`` lists stay."""
    read = parse(page)
    named = ((b, read.node(b)) for b in read.blocks if b.decided)
    return " ".join(b.text for b, node in named if (node in low) == (node[0] == BESIDE))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")
    low = materialize(low_nodes(rows), "low")

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: host_of(u if isinstance(u, str) else None))

    @F.pandas_udf("string")
    def extract(pages: pd.Series, low: pd.Series) -> pd.Series:
        known: dict[tuple, frozenset[str]] = {}
        out = []
        for page, paths in zip(pages, low, strict=True):
            key = () if paths is None else tuple(paths)
            out.append(text_of(page, known.setdefault(key, frozenset(key))) if isinstance(page, str) else "")
        return pd.Series(out, dtype=object)

    none = low.limit(1).count() == 0
    if none:
        found = rows.withColumn("low", F.lit(None).cast("array<string>"))
    else:
        found = rows.withColumn("host", host("url")).join(at_most(low), "host", "left")
    found = found.select("page_id", "url", extract("html", "low").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
