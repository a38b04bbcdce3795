"""The main text of web pages by site style trees.

Every page becomes a tree of its block elements. Trees of one host are merged: an element
is known by its path of tags and names from the root. For each merged element two entropies
over its m pages tell how much it varies: that of its sequences of children (presentation),
and those of its texts (content; a text on one page only counts fully, one that is on all
pages counts nothing). The composite importance of an element mixes its own with that of the
elements below it; branches of low importance are the site's frame and are removed from each
page.

Names bound the importance, as a host with few pages tells little: elements that say they are
navigation, header, advert or the like have none, and what stands in an article or main
element keeps full importance. The tree decides all others. Where it would leave a page
nothing at all, as on a host of copies, the page keeps its elements without such names.

All counts are sums over (host, element) or (host, element, text), so a host with a third of
all pages is as spread as any other.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stage

THRESHOLD = 0.3
DECAY = 0.9
DEEPEST = 32  # elements below count as part of their ancestor at this depth
SPREAD = 32  # copies of the verdict on an element of many pages
MANY = 1000

# Elements of HTML and usual names of page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody td tfoot th"
    " thead tr ul".split()
)
CONTENT = {"article", "main"}
FRAME = set(
    "head nav footer aside menu form script style textarea title noscript iframe xmp noembed noframes template button select"
    " option optgroup datalist dialog input label svg math canvas object video audio map search".split()
)
FRAME_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
FRAME_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice"
    " notices notification pagination pager popup promo promotion related replies respond share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# An open p ends where a block begins; these end their like.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
# Ends are not looked for beyond these.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, **dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), {"table"})}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)", re.S)
DIGITS, NAME = re.compile(r"\d+"), re.compile(r"[a-z]+")
TEXT = "\n#"  # the child that stands for an element's own text
OPEN, NAMED, CONTAINED = 0, 1, 2  # kinds of blocks: the tree decides; a frame's name; in an article or main element


@dataclass
class Element:
    """An element on the stack of open ones; an inline one lies in the node of its block."""

    tag: str
    node: Node
    named: bool  # it or one around it has a frame's name
    content: bool  # it is in an article or main element


@dataclass
class Node:
    """All elements of a page with one path of tags and names."""

    key: str
    above: Node | None
    depth: int
    children: list[Node] = field(default_factory=list)


def frame_named(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is by its name no content, and its class and id without digits."""
    frame = tag in FRAME or (tag == "header" and not inside)
    names = ""
    if attributes.strip():
        for name, a, b, c, alone in ATTRIBUTE.findall(attributes):
            name, value = (name or alone).lower(), entities.unescape(a or b or c).lower()
            if name in ("class", "id"):
                names += ("." if name == "class" else "#") + DIGITS.sub("0", " ".join(value.split()))
                # "post-header" is part of an article, "header" of a site
                words = set(NAME.findall(value))
                frame = frame or bool((words - {"header"} if inside else words) & FRAME_NAMES)
            elif name == "role":
                frame = frame or value.strip() in FRAME_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.strip() == "true"):
                frame = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                frame = True
    return frame and tag not in ("html", "body", *CONTENT), names


class Page:
    """The block elements of a page by path, and its text blocks (node, kind, text) in page order."""

    def __init__(self, html: str) -> None:
        self.nodes: dict[str, Node] = {}
        self.blocks: list[tuple[Node, int, str]] = []
        self.text: list[str] = []
        self.stack = [Element("html", self._node("html", None), False, False)]
        self._read(html)
        self._flush()

    def _node(self, key: str, above: Node | None) -> Node:
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = Node(key, above, above.depth + 1 if above else 0)
        if above:
            above.children.append(node)
        return node

    def _open(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        frame, names = frame_named(tag, attributes, above.content)
        named = above.named or frame
        node = above.node
        if tag in BLOCKS and node.depth < DEEPEST:
            node = self._node(f"{node.key}/{tag}{names}", node)
        self.stack.append(Element(tag, node, named, (above.content or tag in CONTENT) and not named))

    def _block(self) -> Element:
        return next(e for e in reversed(self.stack) if e.tag in BLOCKS)

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            block = self._block()
            kind = NAMED if block.named else CONTAINED if block.content else OPEN
            self.blocks.append((self._node(block.node.key + TEXT, block.node), kind, text))

    def _close(self, tags: set[str], scope: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``scope`` lies inside it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                if any(e.tag in BLOCKS for e in self.stack[i:]):
                    self._flush()
                del self.stack[i:]
                return
            if self.stack[i].tag in scope:
                return

    def _add(self, text: str) -> None:
        # An inline element with a frame's name is left out of its block.
        if text and (not self.stack[-1].named or self._block().named):
            self.text.append(entities.unescape(text))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            found = TOKEN.search(html, at)
            self._add(html[at : found.start() if found else n])
            if not found:
                return
            at = found.end()
            slash, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3)
            if not tag or tag in ("html", "head", "body"):
                continue
            if slash and tag != "br":
                self._close({tag}, SCOPE.get(tag, set()) if tag in BLOCKS else BLOCKS)
            elif tag in RAW:
                # What they hold is no markup, and no text of the page.
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            else:
                if tag in BLOCKS:
                    self._close({"p"}, {"table", "td", "th", "button"})
                    self._flush()
                if tag in ENDS:
                    self._close(ENDS[tag], SCOPE.get(tag, set()))
                if tag == "br":
                    self._add(" ")
                elif tag not in VOID and (tag in BLOCKS or not attributes.rstrip().endswith("/")):
                    self._open(tag, attributes)


def _hash(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


def _shares(page: Page, hashes: dict[str, int]) -> list[dict]:
    """The page's nodes: their style, and their share of the children of the node above."""
    share: dict[str, float] = {}
    for node in page.nodes.values():
        for child in node.children:
            share[child.key] = share.get(child.key, 0.0) + 1 / len(node.children)
    rows = []
    for node in page.nodes.values():
        above, around = node.above, []
        while above:
            around.append(hashes[above.key])
            above = above.above
        style = None if node.key.endswith(TEXT) else _hash(" ".join(str(hashes[c.key]) for c in node.children))
        rows.append({"node": hashes[node.key], "style": style, "share": share.get(node.key, 0.0), "around": around})
    return rows


NODES = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("share", pa.float64()), ("around", pa.list_(pa.int64()))]))
BLOCK_LIST = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]))
PARSED = (
    "uid long, page_id long, url string, host string,"
    " nodes array<struct<node: long, style: long, share: double, around: array<long>>>,"
    " blocks array<struct<node: long, kind: int, text: string>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page with its nodes and text blocks; ``host`` is null where the url has none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, blocks = [], []
            for html in batch.column(4):
                page = Page(html.as_py() or "")
                hashes = {key: _hash(key) for key in page.nodes}
                nodes.append(_shares(page, hashes))
                blocks.append([{"node": hashes[n.key], "kind": k, "text": t} for n, k, t in page.blocks])
            columns = [*batch.columns[:4], pa.array(nodes, NODES), pa.array(blocks, BLOCK_LIST)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "page_id", "url", "host", "nodes", "blocks"])

    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.when(host != "", host).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    return stage(by_bytes(rows).mapInArrow(parse, PARSED), "parsed")


def _spread(weighted: str, total: str) -> Column:
    """Entropy of parts n of a total from the sum of n * ln(n)."""
    return F.log(total) - F.col(weighted) / F.col(total)


def importance(trees: DataFrame) -> DataFrame:
    """(host, node, m, around, importance) of the merged elements; 0 is the frame, 1 the content."""
    hosts = trees.filter("host is not null")
    each = hosts.select("host", F.inline("nodes"))
    styles = each.groupBy("host", "node", "style").agg(
        F.count("*").alias("n"), F.sum("share").alias("w"), F.first("around").alias("around")
    )
    elements = styles.groupBy("host", "node").agg(
        F.sum("n").alias("m"),
        F.count("style").alias("l"),
        F.sum(F.expr("n * ln(n)")).alias("s"),
        F.sum("w").alias("w"),
        F.first("around").alias("around"),
    )
    # A text counts once for each time that it stands in a page.
    texts = (
        hosts.select("uid", "host", F.inline("blocks"))
        .groupBy("uid", "host", "node", F.xxhash64("text").alias("feature"))
        .agg(F.count("*").alias("c"))
        .groupBy("host", "node", "feature")
        .agg(F.sum("c").alias("total"), F.sum(F.expr("c * ln(c)")).alias("s"))
        .groupBy("host", "node")
        .agg(F.avg(_spread("s", "total")).alias("spread"))
    )
    alone = F.col("m") == 1
    content = F.when(alone, 1.0).otherwise(1 - F.col("spread") / F.log("m"))
    presentation = F.when(alone, 1.0).otherwise(_spread("s", "m") / F.log("m"))
    below = F.pow(F.lit(DECAY), F.col("l"))
    # Of an element's importance what is its own, and what it takes of each child's.
    known = elements.join(texts, ["host", "node"], "left").select(
        "host",
        "node",
        "m",
        "w",
        "around",
        F.when(F.col("spread").isNotNull(), content).otherwise((1 - below) * presentation).alias("own"),
        (below / F.col("m")).alias("taken"),
    )
    known = stage(known, "elements")
    # Each element hands its own importance to all elements around it, the nearest first.
    steps = (
        known.select("host", F.col("node").alias("of"), "own", "w", F.posexplode("around").alias("at", "node"))
        .join(known.select("host", "node", "taken", F.col("w").alias("next_w")), ["host", "node"])
        .groupBy("host", "of", "own", "w")
        .agg(F.sort_array(F.collect_list(F.struct("at", "node", "taken", "next_w"))).alias("way"))
    )
    part = (
        "aggregate(slice(way, 1, i + 1), named_struct('p', own, 'w', w),"
        " (a, x) -> named_struct('p', a.p * a.w * x.taken, 'w', x.next_w)).p"
    )
    handed = steps.select(
        "host", F.inline(F.expr(f"transform(way, (x, i) -> named_struct('node', x.node, 'part', {part}))"))
    )
    sums = handed.unionByName(known.select("host", "node", F.col("own").alias("part")))
    sums = sums.groupBy("host", "node").agg(F.sum("part").alias("importance"))
    return known.select("host", "node", "m", "around").join(sums, ["host", "node"])


def frame_elements(trees: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, node, m) of the elements that are, with all below them, of low importance."""
    found = importance(trees)
    lines = found.select("host", "m", "importance", "node", F.explode(F.concat(F.array("node"), "around")).alias("of"))
    return (
        lines.groupBy("host", F.col("of").alias("node"))
        .agg(F.max("importance").alias("most"), F.max(F.expr("if(node = of, m, null)")).alias("m"))
        .filter(F.col("most") < threshold)
        .drop("most")
    )


def main_text(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each row of ``pages``, blocks joined by blank lines.

    White space in a block (by Unicode) becomes one space, character references are decoded.
    A null or empty html has an empty text; a page without a host in its url is not merged
    with others. Repeated rows, null ids and equal ids each keep their row, a repeated page
    counts as often in its host's tree; markup may be broken or cut off anywhere. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    trees = parsed(pages)
    undecided = trees.filter(F.expr(f"host is not null and exists(blocks, b -> b.kind = {OPEN})"))
    many = F.expr(f"if(m >= {MANY}, sequence(1, {SPREAD}), array(0))")
    frame = frame_elements(trees, threshold).select("host", "node", F.explode(many).alias("salt"))
    asked = undecided.select(
        "uid",
        "host",
        F.explode(F.expr(f"array_distinct(filter(blocks, b -> b.kind = {OPEN}).node)")).alias("node"),
    ).withColumn("salt", F.explode(F.array(F.lit(0), F.pmod(F.hash("uid"), F.lit(SPREAD)) + 1)))
    removed = asked.join(frame, ["host", "node", "salt"]).groupBy("uid").agg(F.collect_set("node").alias("removed"))
    decided = trees.filter(F.expr(f"host is null or not exists(blocks, b -> b.kind = {OPEN})"))
    rows = decided.withColumn("removed", F.expr("cast(array() as array<long>)")).unionByName(
        undecided.join(removed, "uid", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))
    )
    unnamed = F.expr(f"filter(blocks, b -> b.kind <> {NAMED})")
    kept = F.expr(f"filter(unnamed, b -> b.kind = {CONTAINED} or not array_contains(removed, b.node))")
    chosen = rows.withColumn("unnamed", unnamed).withColumn("kept", kept)
    text = F.expr("array_join(if(size(kept) = 0, unnamed, kept).text, '\n\n')")
    return chosen.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
