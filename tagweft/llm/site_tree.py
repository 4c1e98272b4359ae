"""HTML extraction with site style trees.

The pages of a host are merged into one style tree: a node is a block element's path
of tags and classes, and like siblings are one node. Each page adds, per node, its
presentation (the row of child elements) and its content (the terms of the text that
is its own, inline elements included). Over the ``m`` pages that have a node:

* its presentation's importance is the entropy of its presentations, to base ``m``;
* its content's importance is one less the mean entropy of its terms, each over the
  pages in proportion to the term's counts there: terms that all pages spread say
  nothing, terms of one page say all;
* its composite importance is ``1 - decay**l`` times the former, for ``l``
  presentations, and ``decay**l`` times the mean of its content's and its children's
  composite importance, weighted by the pages that have them. What fewer than
  ``Settings.pages`` pages share differs, and counts as important in full.

A branch that at least ``Settings.pages`` distinct pages have, and in which this node and
all below are under ``Settings.least``, is site furniture, and is removed; children that
are not shared keep it if that share of its pages has one. Elements
more than ``Settings.levels`` deep are no nodes; their text is the content of the node
above them.

A second rule stands beside the tree: elements that HTML or their class, id or role
declare to be menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments are no text on any page. They are nodes of the tree like
others. A page with ``article`` or ``main`` elements is read inside those; paragraphs,
headings and list items there are never judged, and count as important, so that an
article copied all over a host keeps its text.

A block is the text between the bounds of block elements; references are decoded,
white space becomes one space. Null, empty and broken html, of any length and nesting,
give what text there is, or an empty text; a page without a host shares the tree of
all such. Repeated pages of a host count once in the tree, and are each extracted. An
empty table gives an empty one; other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, private, stored


@dataclass(frozen=True)
class Settings:
    """``tree`` and ``declarations`` turn either rule off, to measure the other."""

    pages: int = 8
    least: float = 0.25
    decay: float = 0.9
    levels: int = 64
    broadcast_rows: int = 500_000
    tree: bool = True
    declarations: bool = True


# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button title".split())
FURNITURE = frozenset("nav menu aside footer form dialog".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
LABELS = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|banners?|promo(?:tion)?s?|sponsor(?:ed)?s?|nav(?:bar|igation)?|menus?|breadcrumbs?|footers?|masthead|topbar|side-?bars?|widgets?|cookies?(?:-?(?:bar|banner|notice|consent))?|consent|notices?|gdpr|popups?|modals?|overlay|newsletters?|subscribe|signup|log-?in|share|sharing|social|related|recommended|comments?(?:-?(?:list|section|area|form))?|commentlist|replies|disqus|respond|pagination|pager|tags|skip-?link|copyright|legal|toolbar)(?=$|[\s_-])", re.I)
# Which open elements a start tag ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table body article main section div td th aside nav footer header form".split())


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    label: str = ""
    role: str = ""
    inside: list = field(default_factory=list)  # nodes and strings
    name: str = ""  # tag and classes, as the tree merges them
    headed: bool = False  # whether a main heading is in it

    def children(self) -> list[Node]:
        return [x for x in self.inside if isinstance(x, Node)]


class _Reader(HTMLParser):
    """Builds elements leniently: void elements, implied ends, and stray end tags are allowed for.

    ``near`` has, for each open element, where the open elements lie that a later start
    tag may end, so no tag looks through all that is open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", name="html")
        self.open = [self.root]
        self.near: list[dict[str, int]] = [{}]
        self.places: dict[str, list[int]] = defaultdict(list)  # of each open tag, but the root
        self.blocks: list[int] = []

    def _push(self, node: Node) -> None:
        at, tag, above = len(self.open), node.tag, self.near[-1]
        if tag in SCOPES and above:
            above = {k: v for k, v in above.items() if k != "p" and tag in ENDS.get(k, ())}
        if tag == "p" or tag in ENDS:
            above = above | {tag: at}
        self.open.append(node)
        self.near.append(above)
        self.places[tag].append(at)
        if tag in BLOCK:
            self.blocks.append(at)

    def _cut(self, at: int) -> None:
        for node in reversed(self.open[at:]):
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.open[at:], self.near[at:]

    def _shut(self, tags: tuple[str, ...]) -> None:
        at = max((self.near[-1].get(t, 0) for t in tags), default=0)
        if at:
            self._cut(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._shut(("p",))
        if tag in ENDS:
            self._shut(ENDS[tag])
        got = {k: v or "" for k, v in attrs}
        label = f"{got.get('class', '')} {got.get('id', '')}".strip()
        kinds = sorted({re.sub(r"\d+", "#", c) for c in got.get("class", "").split()})
        hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
        node = Node(tag, label, "hidden" if hidden else got.get("role", "").lower(), name=".".join([tag, *kinds]))
        self.open[-1].inside.append(node)
        if tag in ("h1", "h2", "h3"):
            for above in reversed(self.open):
                if above.headed:
                    break
                above.headed = True
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "script"):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = self.places[tag][-1] if self.places[tag] else 0
        # an inline end tag does not end a block
        if at and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self._cut(at)

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def parse(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def labelled(node: Node) -> bool:
    return bool(node.label) and bool(LABELS.search(node.label))


def declared(node: Node, in_article: bool) -> bool:
    """Whether the element itself says that it is not part of the text."""
    if node.tag in HIDDEN or node.tag in FURNITURE or node.role in ROLES or node.role == "hidden":
        return True
    if node.tag == "header":
        return not (in_article and node.headed)
    return node.tag not in ("html", "body", "article", "main") and labelled(node)


def outermost(node: Node, tags: tuple[str, ...], in_article: bool) -> list[Node]:
    """The outermost elements below ``node`` with these tags that say nothing against being text."""
    found: list[Node] = []
    todo = node.children()[::-1]
    while todo:
        c = todo.pop()
        if declared(c, in_article) and c.tag != "article":
            continue
        if c.tag in tags and not labelled(c):
            found.append(c)
        elif not (in_article and c.tag == "article"):  # a labelled one there is a comment
            todo += c.children()[::-1]
    return found


def scopes(root: Node) -> list[Node]:
    """The outermost article and main elements that hold text, or the whole page."""
    found = outermost(root, ("article", "main"), False)
    inner = [a for m in found if m.tag == "main" for a in outermost(m, ("article",), True)]
    if inner:
        return [n for n in found if n.tag == "article"] + inner
    return found or [root]


def path_of(parent: int, name: str) -> int:
    """A node's number, from its parent's."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), seed=parent & (1 << 64) - 1) - (1 << 63)


ROOT = path_of(0, "html")


def outline(root: Node, levels: int) -> Iterator[tuple[Node, int, tuple[int, ...], list[Node], int]]:
    """(element, path, paths above, child elements that are nodes, number of protected kinds of children) of each element that the tree judges."""
    todo = [(root, ROOT, (), False)]
    while todo:
        node, path, above, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        blocks = [c for c in node.children() if c.tag in BLOCK] if len(above) < levels else []
        guarded = {c.name for c in blocks if inside and c.tag in TEXT_TAGS}
        own = [c for c in blocks if not (inside and c.tag in TEXT_TAGS)]
        yield node, path, above, own, len(guarded)
        todo += [(c, path_of(path, c.name), (*above, path), inside) for c in own]


def own_text(node: Node, levels_left: bool) -> str:
    """The text of an element and the inline elements in it; that of all in it at the last level."""
    parts: list[str] = []
    todo: list = [x for x in node.inside if isinstance(x, str) or not levels_left or x.tag not in BLOCK][::-1]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            parts.append(now)
        elif now.tag not in HIDDEN:
            todo += [x for x in now.inside if isinstance(x, str) or not levels_left or x.tag not in BLOCK][::-1]
    return "".join(parts)


def style_rows(root: Node, levels: int) -> dict[int, tuple]:
    """Of each node of a page: paths above, presentation, number of kinds of children, and terms with counts."""
    merged: dict[int, tuple] = {}
    for node, path, above, own, guarded in outline(root, levels):
        _, looks, kinds, kept, terms = merged.setdefault(path, (above, [], set(), [0], Counter()))
        looks.append(" ".join(c.name for c in node.children()))
        kinds.update(c.name for c in own)
        kept[0] = max(kept[0], guarded)
        if node.tag not in HIDDEN:
            terms.update(own_text(node, len(above) < levels).split())
    return {path: (above, "|".join(looks), len(kinds) + kept[0], terms) for path, (above, looks, kinds, kept, terms) in merged.items()}


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def counted(pages: DataFrame, settings: Settings) -> DataFrame:
    """What all pages add to the trees: (host, path, kind, key, a, b, c, above).

    Of kind 0 is a row a presentation: pages, kinds of children, pages with text of the
    node's own; of kind 1 a row a term: its count, and the sum of count times log of
    count over pages. A page that occurs n times counts as an nth each time. Rows are
    added up in each batch, and on the map side, before they are sent.
    """
    s = settings
    own = pages.select(host(F.col("url")).alias("host"), "html", F.xxhash64("html").alias("page"))
    again = stored(own.groupBy("host", "page").agg(F.count("*").alias("n")).where("n > 1"), "site-repeats")
    own = own.join(bounded(again), ["host", "page"], "left").select("host", "html", (1 / F.coalesce("n", F.lit(1))).alias("weight"))

    def looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["host", "path", "kind", "key", "a", "b", "c", "above"]
        for batch in batches:
            seen: dict[tuple, list] = {}
            for name, html, weight in zip(batch.host, batch.html, batch.weight):
                for path, (above, look, kinds, terms) in style_rows(parse(html), s.levels).items():
                    row = seen.setdefault((name, path, 0, hashed(look)), [0.0, 0.0, 0.0, above])
                    row[0], row[1], row[2] = row[0] + weight, row[1] + weight * kinds, row[2] + (weight if terms else 0)
                    for term, n in terms.items():
                        row = seen.setdefault((name, path, 1, hashed(term)), [0.0, 0.0, 0.0, None])
                        row[0], row[1] = row[0] + weight * n, row[1] + weight * n * math.log(n)
                if len(seen) > 100_000:
                    yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=columns)
                    seen = {}
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=columns)

    rows = own.mapInPandas(looks, "host string, path long, kind int, key long, a double, b double, c double, above array<long>")
    total = rows.groupBy("host", "path", "kind", "key").agg(*[F.sum(x).alias(x) for x in "abc"], F.max("above").alias("above"))
    return stored(total, "site-looks")


def importance(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, path, pages, importance, most) of every node that ``settings.pages`` distinct pages of a host share.

    ``most`` is the largest importance in its branch, children that are not shared
    counting by the share of pages that have them.
    A node's composite importance is a sum over the nodes below it and itself, each
    times the steps between; so it takes a join and no loop over levels.
    """
    s = settings
    seen = counted(pages, s)
    looks = seen.where("kind = 0").groupBy("host", "path").agg(F.sum("a").alias("m"), F.count("*").alias("l"), F.sum(F.col("a") * F.log("a")).alias("spread"), F.sum("b").alias("kinds"), F.sum("c").alias("texts"), F.max("above").alias("above"))
    looks = looks.where(F.col("m") > s.pages - 0.5)
    base = F.log(F.greatest("m", F.lit(2.0)))
    looks = looks.withColumns({"base": base, "look": F.greatest((F.log("m") - F.col("spread") / F.col("m")) / base, F.lit(0.0))})
    terms = seen.where("kind = 1").select("host", "path", (F.log("a") - F.col("b") / F.col("a")).alias("entropy"))
    spread = terms.groupBy("host", "path").agg(F.avg("entropy").alias("entropy"))
    nodes = looks.join(spread, ["host", "path"], "left").withColumn("content", F.coalesce(1 - F.least(F.col("entropy") / F.col("base"), F.lit(1.0)), F.lit(0.0)))
    nodes = stored(nodes.withColumn("parent", F.try_element_at("above", F.lit(-1))).drop("base", "entropy", "spread"), "site-nodes")
    shared = nodes.groupBy("host", F.col("parent").alias("path")).agg(F.sum("m").alias("shared"))
    held = F.col("kinds") + F.col("texts")
    left = F.pow(F.lit(s.decay), F.col("l"))
    rest = F.col("texts") * F.col("content") + F.greatest(F.col("kinds") - F.coalesce("shared", F.lit(0.0)), F.lit(0.0))
    nodes = nodes.join(shared, ["host", "path"], "left").withColumns({"own": (1 - left) * F.col("look") + F.when(held > 0, left * rest / held).otherwise(0.0), "give": F.when(held > 0, left / held).otherwise(0.0), "apart": F.greatest(F.col("kinds") - F.coalesce("shared", F.lit(0.0)), F.lit(0.0)) / F.col("m")})
    nodes = stored(nodes, "site-own")
    up = nodes.select("host", F.col("path").alias("parent"), "give")
    steps = nodes.where("parent IS NOT NULL").select("host", "path", "parent", "m").join(up, ["host", "parent"]).select("host", "path", (F.col("give") * F.col("m")).alias("step"))
    chain = nodes.select("host", "path", "own", F.posexplode(F.concat("above", F.array("path"))).alias("level", "on"))
    chain = chain.join(steps.withColumnRenamed("path", "on"), ["host", "on"], "left")
    chain = chain.groupBy("host", "path").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("level", "on", F.coalesce("step", F.lit(1.0)).alias("step")))).alias("on"))
    given = F.transform("on", lambda x: F.struct(x["on"].alias("path"), (F.col("own") * F.aggregate(F.filter("on", lambda y: y["level"] > x["level"]), F.lit(1.0), lambda p, y: p * y["step"])).alias("value")))
    sums = chain.select("host", F.explode(given).alias("x")).groupBy("host", F.col("x.path").alias("path")).agg(F.sum("x.value").alias("importance"))
    valued = stored(nodes.select("host", "path", "above", F.round("m").cast("long").alias("pages"), "apart").join(sums, ["host", "path"]), "site-importance")
    own = F.greatest("importance", F.least("apart", F.lit(1.0)))
    most = valued.select("host", F.explode(F.concat("above", F.array("path"))).alias("path"), own.alias("own")).groupBy("host", "path").agg(F.max("own").alias("most"))
    return valued.select("host", "path", "pages", "importance").join(most, ["host", "path"])


def furniture(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, paths): the paths of each host in whose branches all importance is too low."""
    low = importance(pages, settings).where(F.col("most") < settings.least)
    return low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def blocks(root: Node, low: frozenset[int], settings: Settings = Settings()) -> list[str]:
    """The text blocks that stay, in page order."""
    kept = scopes(root) if settings.declarations else [root]
    whole = kept == [root]
    gone = {id(node) for node, path, *_ in outline(root, settings.levels) if path in low} if low else set()
    scope = {id(k) for k in kept}
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    todo: list = list(reversed(kept))
    while todo:
        node = todo.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            now.append(node)
        elif node.tag == "br":
            now.append(" ")
        else:
            if id(node) not in scope and (id(node) in gone or (declared(node, not whole) if settings.declarations else node.tag in HIDDEN)):
                end()
                continue
            if node.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(node.inside)
    end()
    return out


def extracted(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, text) for every page.

    Hosts' low paths are joined to the pages; they are broadcast only if there are
    ``broadcast_rows`` of them or fewer.
    """
    s = settings
    own_host, own_paths = private(pages, "host", "paths")
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias(own_host))
    if s.tree:
        low = stored(furniture(pages, s), "site-furniture")
        few = (low.agg(F.sum(F.size("paths"))).first()[0] or 0) <= s.broadcast_rows
        low = low.toDF(own_host, own_paths)
        both = own.join(F.broadcast(low) if few else low, own_host, "left").select("page_id", "url", "html", F.col(own_paths).alias("paths"))
    else:
        both = own.select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("paths"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = ["\n".join(blocks(parse(html), frozenset(paths if paths is not None else ()), s)) for html, paths in zip(batch.html, batch.paths)]
            yield batch[["page_id", "url"]].assign(text=text)

    return both.mapInPandas(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
