"""Main text of web pages by wrapper induction over the pages of a host.

Every page is parsed once into a skeleton of its DOM tree, in which like siblings are one
repeated node, and the text blocks that may be content.  The skeleton that most pages of a
host share is the host's reference; every other one is aligned with it by simple tree
matching, so that a block has the same slot on every page.  A slot's text that most
different pages of the host repeat is template; the varying texts are content.  Elements
that HTML itself or whole class names declare as furniture are no candidates; a furniture
word inside another class name is a hint, under which blocks of links go and others are left
to induction.  Where a page marks its article, only blocks inside it are candidates; an
article inside furniture is a teaser and marks nothing.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, written
from .url_filters import host_and_path

#: A slot's text is template if this share of the host's different pages repeats it, and
#: at least so many of them.
TEMPLATE_SHARE = 0.7
TEMPLATE_PAGES = 4
#: Outside article and main, a list entry, a run of links or a block under a weak hint is
#: navigation if this share of its text is linked.
LINKED = 0.8
#: Places among like siblings that a skeleton tells apart.
PLACES = 32

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg object select canvas video audio".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINER = frozenset("article aside body div dl fieldset figure footer form header main nav ol section table ul".split())
#: A start tag of the first group closes an open element of the second, unless a third is nearer.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
SCOPES = ("article", "aside", "body", "div", "td", "th", "li", "section", "table", "html", "main", "blockquote", "form", "header", "footer", "nav")
FURNITURE_TAGS = frozenset("nav aside footer form button menu dialog label head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
TALK = frozenset("comment comments commentlist reply replies respond disqus discussion related recommended recommendations".split())
FURNITURE = TALK | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar aside rail widget widgets nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs crumbs pagination pager masthead topbar toolbar header footer share sharing social login search copyright legal hidden".split()
)
OF_ARTICLE = frozenset("article entry post story content page".split())
#: Words that beside a furniture word leave a class name one of furniture.
NEUTRAL = OF_ARTICLE | frozenset(
    "site main the js is blog area list item box wrap wrapper container block section inner outer top bottom left right primary secondary "
    "global bar column module panel group holder text link links icon icons button buttons row region slot unit title heading".split()
)


@lru_cache(maxsize=1 << 14)
def hint(names: str) -> str:
    """What class names or an id say of an element: "", "weak", "class", "talk" or "header".

    A name counts as furniture if all its words are furniture or neutral and one is
    furniture: ``sidebar``, ``cookie-notice``, ``post-comments``.  A furniture word among
    others (``with-sidebar``, ``comments-open``), or beside a name that is wholly of the
    article, is a weak hint only.
    """
    weak, strong, own = False, set(), False
    for name in names.split():
        words = WORD.findall(name)
        hit = FURNITURE.intersection(words)
        if hit and all(w in FURNITURE or w in NEUTRAL for w in words):
            strong |= {"header*"} if hit == {"header"} and OF_ARTICLE.intersection(words) else hit
        elif hit:
            weak = True
        elif words and all(w in OF_ARTICLE for w in words):
            own = True
    if strong == {"header*"} or (strong == {"header"} and own):
        return "header"
    strong.discard("header*")
    if strong and not own:
        return "talk" if strong & TALK else "header" if strong == {"header"} else "class"
    return "weak" if strong or weak else ""


class Page:
    """Skeleton and candidate blocks of one page."""

    def __init__(self, source: str):
        self.labels: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.children: list[dict[tuple[str, int], int]] = [{}]
        self.blocks: list[tuple[int, int, str]] = []
        self._text: list[str] = []
        self._linked = self._links = 0
        self._parse(source)

    def shape(self) -> str:
        return "\n".join(f"{p} {l}" for p, l in zip(self.parents, self.labels))

    def candidates(self) -> list[tuple[int, str]]:
        """Blocks of the innermost kind of region that the page marks: article, main, any."""
        top = max((level for _, level, _ in self.blocks), default=0)
        return [(n, t) for n, level, t in self.blocks if level == top]

    def _flush(self, node: int, level: int, skipped: bool, listed: bool) -> None:
        if self._text:
            raw = "".join(self._text)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            menu = not level and (listed or self._links > 1) and self._linked >= LINKED * len(text)
            if text and not skipped and not menu:
                self.blocks.append((node, level, text))
            self._text = []
        self._linked = self._links = 0

    def _parse(self, source: str) -> None:
        # One entry per open element: tag, node, level of its region, why it is skipped
        # ("" if not), whether inside a link, and the counts of its children by label.
        stack: list[tuple[str, int, int, str, bool, dict[str, int]]] = [("#", 0, 0, "", False, {})]
        block = [(0, 0, False, False)]  # the nearest block element of each open one
        at, size, match = 0, len(source), TOKEN.search
        low = source.lower() if "<" in source else source
        while at < size:
            m = match(source, at)
            end = m.start() if m else size
            if end > at:
                self._add(source[at:end], stack[-1])
            if not m:
                break
            at = m.end()
            close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._add(m[0][9:-3], stack[-1])
                continue
            tag = name.lower()
            if close:
                self._end(tag, stack, block)
                continue
            if tag in VOID:
                if tag in ("br", "hr", "wbr", "img"):
                    if tag == "hr":
                        self._flush(*block[-1])
                    elif tag == "br":
                        self._text.append(" ")
                continue
            if tag in BLOCK:
                self._shut(("p",), SCOPES, stack, block)
                if tag in CLOSES:
                    self._shut(*CLOSES[tag], stack, block)
                self._flush(*block[-1])
            self._start(tag, rest or "", stack, block)
            if tag in RAW:
                found = low.find("</" + tag, at)
                at = size if found < 0 else found
        self._flush(*block[-1])

    def _add(self, text: str, top: tuple) -> None:
        if not top[3]:
            self._text.append(text)
            if top[4]:
                self._linked += len(text.strip())

    def _start(self, tag: str, rest: str, stack: list, block: list) -> None:
        _, parent, level, why, link, seen = stack[-1]
        told = role = ""
        label = tag
        if rest and not rest.isspace() and rest != "/":
            for name, a, b, c in ATTRIBUTE.findall(rest):
                value = a or b or c
                name = name.lower()
                if name in ("class", "id"):
                    value = value.lower()
                    found = WORD.findall(value)
                    told += " " + value
                    label += "." + "-".join(found) if found else ""
                elif name == "role":
                    role = value.lower()
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                    why = why or "hidden"
        place = seen.get(label, 0)
        seen[label] = place + 1
        place = min(place, PLACES - 1) if tag in CONTAINER and label == tag else 0
        kids = self.children[parent]
        node = kids.get((label, place))
        if node is None:
            node = kids[label, place] = len(self.labels)
            self.labels.append(label)
            self.parents.append(parent)
            self.children.append({})
        region = 2 if tag == "article" or "articlebody" in rest.lower() else 1 if tag == "main" or role == "main" else 0
        told = hint(told) if told else ""
        weak = told == "weak"
        if tag in RAW:
            why = why or "raw"
        elif region and told != "talk" and why in ("", "form"):
            why = ""
            level = max(level, region)
        elif not why and tag not in ("html", "body"):
            if tag in FURNITURE_TAGS:
                why = "form" if tag == "form" else "tag"
            elif tag == "header" and not level:
                why = "tag"
            elif role in FURNITURE_ROLES:
                why = "tag"
            elif told == "header":
                why = "" if level or OF_ARTICLE.intersection(WORD.findall(label)) else "class"
            elif told and not weak:
                why = told
        if tag == "a":
            self._links += 1
        stack.append((tag, node, level, why, link or tag == "a", {}))
        listed = weak or block[-1][3] or tag in ("li", "td", "dd", "dt")
        block.append((node, level, bool(why), listed) if tag in BLOCK else block[-1])

    def _end(self, tag: str, stack: list, block: list) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                self._pop(i, stack, block)
                return
            if tag not in BLOCK and stack[i][0] in BLOCK:
                return

    def _shut(self, tags: tuple, scopes: tuple, stack: list, block: list) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                self._pop(i, stack, block)
                return
            if stack[i][0] in scopes:
                return

    def _pop(self, i: int, stack: list, block: list) -> None:
        if any(x[0] in BLOCK for x in stack[i:]):
            self._flush(*block[-1])
        del stack[i:], block[i:]


def tree(shape: str) -> tuple[list[str], list[list[int]]]:
    labels, children = [], []
    for i, line in enumerate(shape.split("\n")):
        parent, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        if i:
            children[int(parent)].append(i)
    return labels, children


def tree_match(a: str, b: str) -> list[int]:
    """Simple tree matching of two skeletons: for each node of a its node of b, or -1.

    The largest set of pairs that keeps labels, ancestors and the order of siblings.
    """
    la, ca = tree(a)
    lb, cb = tree(b)
    # Pairs of like nodes that may meet, parents before children: the reverse order is
    # bottom-up, so that the depth of a page costs no stack.
    meet = [(0, 0)]
    for x, y in meet:
        meet += [(i, j) for i in ca[x] for j in cb[y] if la[i] == lb[j]]
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def size(x: int, y: int) -> int:
        return memo[x, y][0] if (x, y) in memo else 0

    for x, y in reversed(meet):
        p, q = ca[x], cb[y]
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p)):
            for j in range(len(q)):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(p[i], q[j]))
        memo[x, y] = (m[-1][-1] + 1, m)

    out = [-1] * len(la)
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        m, i, j = memo[x, y][1], len(ca[x]), len(cb[y])
        while i and j:
            s = size(ca[x][i - 1], cb[y][j - 1])
            if s and m[i][j] == m[i - 1][j - 1] + s:
                todo.append((ca[x][i - 1], cb[y][j - 1]))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def slots(shape: str, reference: str) -> list[int]:
    """A number per node: its node of the reference, or a negative one of its own path."""
    out = [0]
    aligned = tree_match(shape, reference) if shape != reference else None
    paths = [""]
    for i, line in enumerate(shape.split("\n")):
        if i:
            parent, _, label = line.partition(" ")
            paths.append(f"{paths[int(parent)]}/{label}")
            to = i if aligned is None else aligned[i]
            out.append(to if to >= 0 else -1 - (xxhash.xxh64_intdigest(paths[i]) >> 1))
    return out


BLOCKS = "array<struct<node:int,text:string>>"


def parse_pages(df: DataFrame, markup: str = "html") -> DataFrame:
    """Replace the markup by _shape, _key (digest of the longest block) and _blocks."""
    keep = [c for c in df.columns if c != markup]
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{markup}`").alias("_html"))
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, keys, blocks = [], [], []
            for source in b.column(len(keep)):
                page = Page(source.as_py() or "")
                found = page.candidates()
                shapes.append(page.shape())
                keys.append(xxhash.xxh64_intdigest(max((t for _, t in found), key=len, default="")) - (1 << 63))
                blocks.append([{"node": n, "text": t} for n, t in found])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(shapes, pa.string()), pa.array(keys, pa.int64()), pa.array(blocks, kind)], names=[*keep, "_shape", "_key", "_blocks"])

    schema = d.drop("_html").withColumns({"_shape": F.lit(""), "_key": F.lit(0).cast("long"), "_blocks": F.array().cast(BLOCKS)}).schema
    return d.mapInArrow(run, schema)


def align(shapes: DataFrame) -> DataFrame:
    """Slots of every (host, shape) against the host's most common shape."""
    reference = shapes.groupBy("_host").agg(F.max_by("_shape", F.struct("n", "_shape")).alias("_ref"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [slots(s, r) for s, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out, pa.list_(pa.int64()))], names=["_h", "_sid", "_slots"])

    pairs = shapes.join(reference, "_host").select("_host", "_shape", "_ref", F.xxhash64("_shape").alias("_sid"))
    return pairs.mapInArrow(run, "_h string, _sid long, _slots array<long>")


@apart("url", "markup")
def extract_text(df: DataFrame, url: str = "url", markup: str = "html", share: float = TEMPLATE_SHARE, pages: int = TEMPLATE_PAGES) -> DataFrame:
    """Add text and n_chars (code points) to every page; the markup is replaced.

    Blocks have one space for each run of white space inside and two line feeds between
    them.  Pages are different if their longest blocks differ, so that copies of one page
    cannot make its article a template.  NULL, empty and text-free markup give an empty
    text; pages without host form one host; repeated rows stay repeated; other columns pass
    through, input columns named like an output are replaced.  The markup is parsed once;
    only counts of blocks and one row per (host, skeleton) are shuffled, besides the pages
    themselves where the table of skeletons is too large to broadcast.  A host's template
    texts are one row: each is on ``share`` of its pages, so they number at most the mean
    blocks of a page by ``share``.
    """
    keep = [c for c in df.columns if c != markup and c.lower() not in ("text", "n_chars")]
    host, _ = host_and_path(F.col(f"`{url}`"))
    d = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("_host"), F.col(f"`{markup}`").alias("_html"))
    parsed = written(parse_pages(d, "_html"), "html-blocks")

    shapes = parsed.groupBy("_host", "_shape").agg(F.count("*").alias("n"))
    aligned = written(align(shapes), "html-slots")
    placed = parsed.select("_host", "_key", F.xxhash64("_shape").alias("_s"), "_blocks")
    placed = placed.join(aligned, (F.col("_host") == F.col("_h")) & (F.col("_s") == F.col("_sid")))
    texts = placed.select("_host", "_key", F.explode(F.expr("transform(_blocks, b -> xxhash64(_slots[b.node], b.text))")).alias("_t"))
    seen = texts.distinct().groupBy("_host", "_t").agg(F.count("*").alias("c")).filter(F.col("c") >= pages)
    total = parsed.select("_host", "_key").distinct().groupBy("_host").agg(F.count("*").alias("n"))
    constant = seen.join(total, "_host").filter(F.col("c") >= share * F.col("n"))
    dead = constant.groupBy("_host").agg(F.collect_set("_t").alias("_dead")).withColumnRenamed("_host", "_dh")
    rules = written(aligned.join(dead, F.col("_h") == F.col("_dh"), "left").drop("_dh"), "html-rules")

    d = parsed.withColumn("_s", F.xxhash64("_shape")).join(rules, (F.col("_host") == F.col("_h")) & (F.col("_s") == F.col("_sid")), "left")
    live = F.expr("filter(_blocks, b -> not coalesce(array_contains(_dead, xxhash64(_slots[b.node], b.text)), false))")
    d = d.select(*[F.col(f"`{c}`") for c in keep], F.array_join(F.transform(live, lambda b: b["text"]), "\n\n").alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("long"))
