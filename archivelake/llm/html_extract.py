"""Main text of web pages by site style trees.

A page's DOM is merged with those of its host: a style node is the path of tags and classes from the root. Its content
importance is that of its text blocks: 1 - H, where H is the entropy of the block's appearances over the node's pages to
the base of their number (a block in each page: importance 0; in one alone: 1). Its presentation importance is the entropy
of the children's tag sequences seen under it. An element's composite importance joins both, the content of all below it
weighing ``GAMMA`` ** (kinds of children) as in the style-tree model. Branches whose importance is below ``LOW`` are removed
from each page, within an article or main part as well, paragraphs included; only the page's own landmarks (html, body,
article, main) and headings outside such a branch stay. What no host's statistics can show (a host of few pages, boxes that
say something else on each page) is decided by the elements' roles: navigation, header, footer, aside, form, dialog, script,
style and boxes that class, id or role name as such. If a page marks articles or a main part, its text is what remains in
those. A form or a box named for the page's layout that holds the article, main part or first heading is a wrapper and no
noise. Inline elements are never branches.

Two passes over the pages: the first emits, pre-aggregated in each batch, hashed (host, node, block) counts, whose sums do
not depend on how a host's pages are dealt; the second reads each host's list of removed nodes. Pages are never grouped by
host, so a hot host is spread like any other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LOW, GAMMA, FEWEST = 0.3, 0.9, 4
#: Low nodes of all hosts that are sent to every executor at the utmost.
BROADCAST_NODES = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never text.
SILENT = frozenset("audio button canvas datalist embed form head iframe input math meter noembed noframes noscript object progress script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The site's frame; within a main part, a header that holds a heading is the article's own.
FRAME = frozenset("aside dialog footer header menu nav search".split())
#: What a class, id or role says of a box that is not content.
NOISE = re.compile(
    r"(.+[-_])?(ads?|adverts?|advertisements?|advertorial|adbox|banners?|breadcrumbs?|byline-share|comments?|comment-?(list|section|form|area)|disqus|complementary|consent|contentinfo|cookies?|cookie-?(bar|notice|banner)|disclaimer|footer|footnav|gdpr|header|hidden|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pagination|pager|popup|promos?|promotion|reader-?comments|related|replies|respond|rail|search|share|sharing|sidebars?|side-?bar|signup|skip-?link|social|sponsor(ed|s)?|subscribe|subscription|tags|teasers?|toolbar|topbar|tracking|widgets?)",
    re.I,
)
#: What may follow such a word in a name without a change of its meaning: share-buttons, but not social-science.
PART = re.compile(r"(area|articles?|bar|block|body|bottom|box|btn|buttons?|col|column|container|content|desktop|entries|fixed|form|group|icons?|inner|items?|left|links?|list|main|media|mobile|nav|next|outer|panel|placeholder|posts?|previous|primary|recent|right|row|secondary|section|slot|sticky|stories|text|title|toggle|top|unit|wrap|wrapper|[\dx]+)", re.I)
#: Names of a state of the page, such as has-sidebar and no-header, say nothing of the box.
STATE = re.compile(r"(has|no|not|with|without|is|hide|show|supports?)[-_]", re.I)
#: Kinds of noise: a name of headers, any other name, an attribute that hides.
HEADER, NAMED, HIDDEN = 1, 2, 3
#: Names that themes also give to what lies around the whole page; such a box with the article, main part or h1 is a wrapper.
LAYOUT = re.compile(r"(^|[-_])(sidebars?|side-?bar|nav|navbar|header|footer|banner|menu|overlay|widgets?|toolbar|topbar|hidden|ads?|tags|cookies?|search|social)($|[-_])", re.I)
CONTENT = re.compile(r"(^|[-_\s])(article|content|main|post|entry|story)($|[-_\s])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: An opening tag ends open elements of these names, up to one of the bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BEFORE_P = BLOCK - {"body", "html", "td", "th", "tr", "li", "dd", "dt", "tbody", "thead", "tfoot", "option", "optgroup", "caption"}


#: Levels of style nodes. What is nested deeper belongs to the node of that level: its text counts there and goes or stays with it.
LEVELS = 64


def noise_of(words: str) -> int:
    """HEADER, NAMED or 0: whether one of the words of class, id and role names a box that is not content."""
    found = 0
    for word in words.split():
        if STATE.match(word):
            continue
        while word:
            if NOISE.fullmatch(word):
                if not re.search(r"(^|[-_])header$", word, re.I):
                    return NAMED
                found = HEADER
                break
            at = max(word.rfind("-"), word.rfind("_"))
            word = word[:at] if at > 0 and PART.fullmatch(word, at + 1) or at == len(word) - 1 else ""
    return found


class Node:
    """An element. Block elements are style nodes of their own, down to LEVELS; others belong to that of their parent."""

    __slots__ = ("tag", "mark", "parent", "children", "noise", "layout", "key", "level", "own")

    def __init__(self, tag: str, mark: str, parent: Node | None, noise: int, layout: bool = False):
        self.tag, self.mark, self.parent, self.noise, self.layout, self.children = tag, mark, parent, noise, layout, []
        self.own = parent is None or tag in BLOCK and parent.level < LEVELS
        self.level = parent.level + self.own if parent else 0
        self.key = hashed(f"{parent.key}/{mark}" if parent else mark) if self.own else parent.key


def parse(page: str) -> Node:
    """The DOM of a page, as tolerant as a browser for the usual faults: missing end tags, stray ones, cut-off pages."""
    root = Node("html", "html", None, 0)
    at, here, end = 0, root, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at, tag = m.end(), m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                here.children.append(text)
            continue
        tag = tag.lower()
        if m.group(1):
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if tag == "p" and node is None:
                continue
            if node is not None and node.parent is not None:
                if tag in BLOCK or not any(x in BLOCK for x in _between(here, node)):
                    here = node.parent
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in _up(here)) and (tag == "body" or here is root):
            continue
        said = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
        if tag in _BEFORE_P:
            for x in _up(here):
                if x.tag == "p":
                    here = x.parent
                    break
                if x.tag in BLOCK and x.tag != "p":
                    break
        if tag in _CLOSES:
            names, bounds = _CLOSES[tag]
            last = None
            for x in _up(here):
                if x.tag in bounds:
                    break
                if x.tag in names:
                    last = x
            if last is not None:
                here = last.parent
        words = " ".join(said.get(k, "") for k in ("class", "id", "role"))
        noise = 0
        if tag not in ("html", "body", "main"):
            noise = HIDDEN if "hidden" in said and not said["hidden"] or said.get("aria-hidden") == "true" else 0 if tag in HEADINGS or CONTENT.search(said.get("role", "")) else noise_of(words)
        node = Node(tag, tag + "." + ".".join(sorted(said.get("class", "").split())) if said.get("class") else tag, here, noise, noise == NAMED and bool(LAYOUT.search(words.replace(" ", "-"))))
        here.children.append(node)
        if tag in VOID or m.group(3).rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "noembed", "xmp"):
            close = re.compile(rf"</{tag}\b[^>]*(>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        here = node
    _unwrap(root)
    return root


def _unwrap(root: Node) -> None:
    """Clears the marks of forms and layout boxes that hold the article, the main part or an h1: wrappers of the whole page."""
    for node in walk(root):
        landmark = node.tag in ("article", "main") and not node.noise or node.tag == "h1"
        if landmark and not any(x.noise == NAMED and not x.layout for x in _up(node.parent)):
            for x in _up(node.parent):
                if x.tag == "form":
                    x.tag = "div"
                elif x.noise == NAMED and x.tag not in FRAME:
                    x.noise = 0


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _between(node: Node, top: Node) -> Iterator[str]:
    while node is not top:
        yield node.tag
        node = node.parent


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))


def blocks(tops: list[Node], dropped) -> list[str]:
    """The text blocks below tops in page order, white space folded, without silent and dropped branches."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            out.append(text)

    for top in tops:
        stack: list = [(top, False)]
        while stack:
            item, closing = stack.pop()
            if isinstance(item, str):
                part.append(item)
            elif closing:
                flush()
            elif item.tag == "br":
                part.append(" ")
            elif item.tag not in SILENT and (item is top or not dropped(item)):
                if item.tag in BLOCK:
                    flush()
                    stack.append((item, True))
                stack.extend((x, False) for x in reversed(item.children))
        flush()
    return out


def mains(root: Node, least: int = HEADER) -> list[Node]:
    """The page's outermost articles; else its main parts; else its root. Those in or with noise of kind least or above don't
    count."""
    for names in (("article",), ("main",)):
        found = []
        for node in walk(root):
            if node.tag in names:
                ups = list(_up(node.parent))
                if not any(x.noise >= least or x.tag in FRAME or x.tag in SILENT or x.tag in names for x in ups) and node.noise < least:
                    found.append(node)
        if found:
            return found
    return [root]


def extract(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the hashed style nodes of low importance of its host."""
    root = parse(page or "")
    text = _text(mains(root), root, low)
    # a box around the whole page is no noise, whatever its name
    return text or _text(mains(root, HIDDEN), root, low)


def _text(tops: list[Node], root: Node, low: frozenset[int]) -> str:
    whole = tops == [root]

    def headed(node: Node) -> bool:
        return not whole and (node.tag == "header" or node.noise == HEADER) and any(x.tag in HEADINGS for x in walk(node))

    def dropped(node: Node) -> bool:
        if node.noise == HIDDEN or node.tag in FRAME and node.tag != "header":
            return True
        if (node.noise or node.tag == "header") and not headed(node):
            return True
        # a heading by itself may well be the same on each page of a site; in a branch that is, it goes with it
        return node.own and node.key in low and node.tag not in ("html", "body", "article", "main") and node.tag not in HEADINGS

    return "\n".join(blocks(tops, dropped))


def hashed(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url) -> Column:
    """The host of a URL in lower case, without user and port; '' for none (such pages share no style tree)."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][A-Za-z0-9_+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def direct(node: Node) -> tuple[list[str], list[str]]:
    """The texts of a style node outside the nodes below it, and these nodes' marks."""
    texts, marks, stack = [], [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            texts.append(x)
        elif x.own:
            marks.append(x.mark)
        elif x.tag not in SILENT:
            stack.extend(reversed(x.children))
    return texts, marks


def style_counts(pages: DataFrame) -> DataFrame:
    """host, node, parent, kind, feature, pages: on how many different pages of the host a style node has a feature. Kinds: 0
    the node itself, 1 a text block directly in it, 2 a sequence of children's tags. Each of c copies of a page (the same html on
    one host) weighs 1 / c."""
    pages = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).filter("host <> ''").withColumn("mark", F.xxhash64("html"))
    copies = common.stored(pages.groupBy("host", "mark").agg(F.count("*").alias("copies")).filter("copies > 1"), "page-copies")
    pages = pages.join(common.joinable(copies), ["host", "mark"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, page, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                page = page.as_py()
                seen = set()
                for node in walk(parse(page)):
                    if node.tag in SILENT or not node.own:
                        continue
                    key, up = node.key, node.parent.key if node.parent else 0
                    texts, marks = direct(node)
                    text = " ".join("".join(texts).split())
                    seen.add((host, key, up, 0, 0))
                    if text:
                        seen.add((host, key, up, 1, hashed(text)))
                    seen.add((host, key, up, 2, hashed(" ".join(marks))))
                if copies == 1:
                    found.update(seen)
                else:
                    for x in seen:
                        found[x] += 1 / copies
            rows = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(rows[i], pa.int64()) for i in (1, 2, 3, 4)), pa.array(list(map(float, found.values())), pa.float64())], ["host", "node", "parent", "kind", "feature", "pages"])

    rows = pages.mapInArrow(run, "host string, node long, parent long, kind long, feature long, pages double")
    # shares of copies add up to whole numbers, but for rounding
    return rows.groupBy("host", "node", "parent", "kind", "feature").agg(F.round(F.sum("pages")).cast("long").alias("pages"))


def low_nodes(counts: DataFrame, low: float = LOW, gamma: float = GAMMA, fewest: int = FEWEST) -> DataFrame:
    """host and low: the hashes of its style nodes of composite importance below low, of those on fewest pages or more."""
    counts = common.stored(counts, "style-counts")
    on = ["host", "node"]
    # sums of logarithms are enough, so a node's many blocks are pre-aggregated and never meet its page count in a join:
    # sum(1 - ln c / ln m) = n - sum(ln c) / ln m, and -sum(c / m * ln(c / m)) = sum(c) / m * ln m - sum(c * ln c) / m
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    c = F.col("pages")
    own = counts.groupBy(*on).agg(
        F.max("parent").alias("parent"), of(0, c).alias("m"), F.coalesce(of(1, F.lit(1)), F.lit(0)).alias("n"), F.coalesce(of(1, F.log(c)), F.lit(0.0)).alias("logs"),
        of(2, F.lit(1)).alias("kinds"), of(2, c).alias("seen"), of(2, c * F.log(c)).alias("turns"),
    )
    m, enough = F.col("m"), F.col("m") > 1
    below = F.when(enough, F.col("n") - F.col("logs") / F.log(m)).otherwise(F.col("n").cast("double"))
    shown = F.when(enough, (F.col("seen") / m * F.log(m) - F.col("turns") / m) / F.log(m)).otherwise(1.0)
    state = common.stored(own.select(*on, "parent", "m", "n", below.alias("below"), shown.alias("shown"), "kinds"), "style-nodes")
    nodes = state.select("host", "node", "parent")
    # sums of content importance climb to the ancestors, one level a round
    rising, total = state.select("host", "parent", "below", "n").filter("n > 0 and parent <> 0"), state.select("host", "node", "below", "n")
    while True:  # LEVELS rounds at most
        rising = common.stored(rising.groupBy("host", F.col("parent").alias("node")).agg(F.sum("below").alias("below"), F.sum("n").alias("n")), "style-rise")
        if rising.isEmpty():
            break
        total = total.unionByName(rising)
        rising = rising.join(nodes.select("host", "node", "parent"), on).filter("parent <> 0").select("host", "parent", "below", "n")
    total = total.groupBy(*on).agg(F.sum("below").alias("below"), F.sum("n").alias("n"))
    joined = total.join(state.select("host", "node", "m", "shown", "kinds"), on)
    weight = F.pow(F.lit(gamma), F.col("kinds").cast("double"))
    composite = (1 - weight) * F.least(F.col("shown"), F.lit(1.0)) + weight * F.col("below") / F.col("n")
    chosen = joined.filter((F.col("n") > 0) & (F.col("m") >= fewest) & (composite < low))
    return chosen.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    A null or empty page has the text ''; pages without a host have no style tree and are judged by roles alone. Repeated
    rows each have a row, but copies of a page are no evidence of what its host's pages share; other columns are left out.
    An empty table gives no rows. Ties don't arise: a node of exactly the importance LOW stays.
    """
    low = common.stored(low_nodes(style_counts(pages)), "style-low")
    # the broadcast is bounded by the nodes in it, 8 bytes each; beyond that pages are joined by host, whose skew Spark splits
    nodes = low.agg(F.coalesce(F.sum(F.size("low") + 1), F.lit(0))).first()[0]
    low = F.broadcast(low) if nodes <= BROADCAST_NODES else low
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host")).join(low, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in common.pieces(batches):
            texts = []
            for page, nodes in zip(batch.column(2), batch.column(3)):
                nodes = tuple(nodes.as_py() or ())
                if nodes not in memo:
                    if len(memo) > 200:
                        memo.clear()
                    memo[nodes] = frozenset(nodes)
                texts.append(extract(page.as_py(), memo[nodes]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages; nulls, repeated rows, long and deep pages as in ``main_text``."""
    return main_text(common.table(spark, sf_dir, "pages"))
