"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged by node path (tags with their classes, ids and roles from the root). A node's importance
joins the entropy of its presentation (the kinds of its children over the pages) with that of its content, all texts below it: a
text of one page alone says most, one that REPEATED pages or more have says nothing. Branches that hold no node of importance go
from each page.
Templates are shared by sites too, so the tree merged over all hosts counts beside a host's own, the more the fewer pages it has.

Tags, roles and class names that mark menus, headers, footers, sidebars, notices and adverts only raise the importance that such a
branch needs; they decide alone where no tree has pages enough. Forms, scripts, styles and the like, hidden elements and
readers' comments, which are each page's own, always go. Pages with equal text count once, so copies do not make an article look
like a template.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, written

#: Composite importance below which a branch goes; the same of one that its tag or name marks, and of text outside the article of a
#: page that has one.
LOW, MARKED, OUTSIDE = 0.5, 0.9, 0.8
#: Weight of content in importance, and pages at which a text says nothing.
CONTENT, REPEATED = 0.9, 4
#: Pages of its host that a path needs to be judged; pages of its host or of all hosts to keep it against its mark; and how many of
#: a host's pages the tree of all hosts weighs.
LEAST_PAGES, LEAST_OF_ALL, PRIOR = 5, 100, 50
#: Elements nested deeper become siblings, as in browsers. Paths that a task remembers to describe each once.
DEPTH, SEEN = 512, 1 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_SPLIT, _CAMEL = re.compile(r"[^a-z0-9]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_LAYOUT = re.compile(r"(?:has|with|no|without)[-_]")

#: Elements whose content is text, not markup.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset(
    "script style noscript template iframe head title form button select option textarea dialog svg math object embed canvas audio video map xmp noembed noframes input label fieldset".split()
)
COMMENTS = frozenset("comment comments respond reply replies disqus".split())
MARKS = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist".split())
NAMES = COMMENTS | frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login signin discussion share sharing social breadcrumb breadcrumbs pagination pager related recommended widget toolbar search form skip paywall disclaimer".split()
)
#: Elements without a style that can be judged templates inside an article, whose other unstyled parts share their paths.
CONTAINERS = frozenset("div section ul ol dl table details figure".split())
HEADERS = frozenset(("header", "masthead"))
#: What the start of an element closes: open elements up to the first of these, within the bounds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
_P_BOUND = frozenset("article section div main body td th li blockquote table form aside nav header footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    __slots__ = ("tag", "path", "flags", "dropped", "article", "main", "named", "header", "kids")

    def __init__(self, tag, path, flags, dropped, article, main, named, header):
        self.tag, self.path, self.flags, self.dropped, self.article, self.main, self.named, self.header = tag, path, flags, dropped, article, main, named, header
        self.kids: list[str] = []


#: Flags of a path: its tag or name marks it, it lies in an article or main part.
IS_MARKED, IS_INSIDE = 1, 2


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def _style(a: dict[str, str]) -> str:
    return " ".join(a[k].lower() for k in ("class", "id", "role") if a.get(k))


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")


def _names(a: dict[str, str]) -> set[str]:
    """The words of class and id, without those that say what a layout has or lacks ('with-sidebar')."""
    parts = [t for k in ("class", "id") for t in a.get(k, "").split() if not _LAYOUT.match(t.lower())]
    return {w for t in parts for w in _SPLIT.split(_CAMEL.sub("-", t).lower())}


class Page:
    """The parsed page: ``blocks`` of (text, in article, in main, path), and for the tree ``features`` (path, text), ``kinds`` of
    children by path, and ``chains``: paths from the root and flags by path, without those in ``known``.

    ``low`` are the paths of branches that go, ``cleared`` those of marked ones that stay, ``shown`` those of text that stays
    outside the article of a page that has one.
    """

    def __init__(self, html: str, low: frozenset[int] = frozenset(), cleared: frozenset[int] = frozenset(), shown: frozenset[int] = frozenset(), tree: bool = False, known: set[int] | None = None):
        self.blocks: list[tuple[str, bool, bool, int]] = []
        self.features: set[tuple[int, int]] = set()
        self.kinds: dict[int, list[str]] = {}
        self.chains: dict[int, tuple[list[int], int]] = {}
        self.low, self.cleared, self.shown, self.tree, self.known = low, cleared, shown, tree, known if known is not None else set()
        self.stack = [Node("#", 0, 0, False, False, False, False, False)]
        self.text: list[str] = []
        self._parse(html)

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", entities.unescape("".join(self.text))).strip()
            self.text = []
            if text:
                top = self._of
                self.blocks.append((text, top.article, top.main, top.path))

    def _add(self, raw: str) -> None:
        top = self.stack[-1]
        if self.tree and len(self.stack) > 1 and not raw.isspace():
            self.features.add((top.path, xxhash.xxh64_intdigest(raw.strip().encode("utf-8", "surrogatepass")) >> 1))
        if not top.dropped and not (top.header and not any(n.tag in HEADINGS for n in self.stack)):
            if not self.text:
                self._of = top
            self.text.append(raw)

    def _close(self, depth: int) -> None:
        for node in self.stack[depth:]:
            if node.tag in BLOCKS:
                self._flush()
            if self.tree:
                runs = [k for i, k in enumerate(node.kids) if i == 0 or k != node.kids[i - 1]]
                self.kinds.setdefault(node.path, []).append(" ".join(runs))
                if node.path not in self.known:
                    self.known.add(node.path)
                    self.chains[node.path] = [n.path for n in self.stack[1 : self.stack.index(node) + 1]], node.flags
        del self.stack[depth:]

    def _open(self, tag: str, rest: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if tag in CLOSES:
                if t in BOUNDS[tag]:
                    break
                if t in CLOSES[tag]:
                    # the outermost of nested ones that it closes
                    self._close(i)
                    if tag != "tr" or t == "tr":
                        break
            elif tag in BLOCKS and t == "p":
                self._close(i)
                break
            elif t in _P_BOUND:
                break
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.text.append(" ") if self.text else None
        if tag in VOID:
            self.stack[-1].kids.append(tag)
            return
        if len(self.stack) > DEPTH:
            self._close(DEPTH)
        up, a = self.stack[-1], _attributes(rest)
        style = _style(a)
        kind = f"{tag}.{style}" if style else tag
        up.kids.append(kind)
        path = xxhash.xxh64_intdigest(f"{up.path}/{kind}".encode("utf-8", "surrogatepass")) >> 1
        article = up.article or tag == "article"
        main = up.main or tag == "main" or a.get("role", "").lower() == "main"
        named = (up.named or bool(style)) and (up.article or up.main)
        inside = up.article or up.main
        names = _names(a)
        # the header of an article: its headings stay
        heads = inside and (tag == "header" or not HEADERS.isdisjoint(names)) and NAMES.isdisjoint(names - HEADERS)
        header = up.header or (heads and tag not in HEADINGS)
        outer = tag in ("article", "main") and not inside
        marked = not outer and not heads and tag not in ("html", "body") and (tag in MARKS or (tag == "header" and not inside) or a.get("role", "").lower() in ROLES or not NAMES.isdisjoint(names))
        gone = not outer and (tag in DROPPED or _hidden(a) or not COMMENTS.isdisjoint(names))
        # inside an article most unstyled parts share their paths with its text
        judged = tag not in ("html", "body", "article", "main") and tag not in HEADINGS and (bool(style) or (tag in CONTAINERS if inside else tag in BLOCKS) or named)
        dropped = up.dropped or gone or (marked and path not in self.cleared) or (judged and path in self.low)
        flags = IS_MARKED * bool(marked or up.flags & IS_MARKED) | IS_INSIDE * bool(article or main)
        self.stack.append(Node(tag, path, flags, dropped, article, main, named, header))

    def _end(self, tag: str) -> None:
        if tag == "br":
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                return
            if tag not in BLOCKS and self.stack[i].tag in BLOCKS:
                break
        if tag in BLOCKS:
            self._flush()

    def _parse(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag, rest = tag.lower(), m[3] if m[2] else m[6]
            if m[1] or m[4]:
                self._end(tag)
                continue
            self._open(tag, rest)
            if tag in RAW and not rest.endswith("/"):
                close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(html, at)
                self._end(tag)
                at = close.end() if close else n
            elif rest.endswith("/") and tag not in BLOCKS and tag not in VOID:
                self._end(tag)
        if at < n:
            self._add(html[at:])
        self._close(1)
        self._flush()

    def main_text(self) -> str:
        """The blocks of the articles and the main part, and other ``shown`` ones; all that is left where there is neither."""
        kept = self.blocks
        if any(article or main for _, article, main, _ in kept):
            kept = [b for b in kept if b[1] or b[2] or b[3] in self.shown]
        return "\n".join(b[0] for b in kept)


def host_of(url) -> str:
    """The column of the host of a URL column; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees: host (null: that of all hosts), path, chain (paths from the root to it), flags, direct (texts right in the
    node), pages (with different text), presentation, content and importance (0 to 1) of each node.

    A page counts once for each text of its own. A node of one page has presentation 1, one without texts content 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("mark", pa.int64()), ("body", pa.int64()), ("chain", pa.list_(pa.int64()))])
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                if len(known) > SEEN:
                    known.clear()
                rows: list[tuple] = []
                for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    p = Page(text or "", tree=True, known=known)
                    body = xxhash.xxh64_intdigest(p.main_text().encode("utf-8", "surrogatepass")) >> 1
                    rows += [(host, path, 0, mark, body, None) for path, mark in p.features]
                    rows += [(host, path, 1, xxhash.xxh64_intdigest("|".join(k).encode("utf-8", "surrogatepass")) >> 1, body, None) for path, k in p.kinds.items()]
                    rows += [(None, path, 2, flags, 0, chain) for path, (chain, flags) in p.chains.items()]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    marks = written(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path long, kind int, mark long, body long, chain array<long>"), "html-marks")
    chains = marks.filter("kind = 2").select("path", F.col("mark").cast("int").alias("flags"), "chain").dropDuplicates(["path"])
    per_host = marks.filter("kind < 2").select("host", "path", "kind", "mark", "body").distinct().groupBy("host", "path", "kind", "mark").agg(F.count("*").alias("n"))
    per_all = per_host.groupBy("path", "kind", "mark").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("host"), "path", "kind", "mark", "n")

    def sums(per: DataFrame) -> DataFrame:
        """Pages and their sum of n ln n by kinds of children; texts on pages, and those times what they do not say."""
        repeated = F.least(F.lit(1.0), F.log("n") / math.log(REPEATED))
        return per.groupBy("host", "path").agg(
            F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("pages"),
            F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("s"),
            F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("texts"),
            F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n") * repeated)), F.lit(0.0)).alias("t"),
        )

    # a row for each path of each host from here on
    own = written(sums(per_host).unionByName(sums(per_all)).join(chains, "path"), "html-nodes")
    below = own.filter("texts > 0").select("host", F.explode("chain").alias("path"), "texts", "t").groupBy("host", "path").agg(F.sum("texts").alias("all_texts"), F.sum("t").alias("all_t"))
    below = below.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "all_texts", "all_t")
    nodes = own.join(below, own["host"].eqNullSafe(below["b_host"]) & (own["path"] == below["b_path"]), "left")
    ln = F.log("pages")
    presentation = F.when(F.col("pages") <= 1, 1.0).otherwise((F.col("pages") * ln - F.col("s")) / (F.col("pages") * ln))
    content = F.when(F.col("all_texts") > 0, 1 - F.col("all_t") / F.col("all_texts")).otherwise(0.0)
    out = nodes.select("host", "path", "chain", "flags", (F.col("texts") > 0).alias("direct"), "pages", presentation.alias("presentation"), content.alias("content"))
    return out.withColumn("importance", (1 - CONTENT) * F.col("presentation") + CONTENT * F.col("content"))


def judge(tree: DataFrame, low: float = LOW, marked: float = MARKED, outside: float = OUTSIDE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and the paths of its branches that go (``low``), of marked ones that stay (``cleared``), and of text outside of articles
    that stays (``shown``)."""
    every = tree.filter("host is null").select(F.col("path").alias("a_path"), F.col("pages").alias("a_pages"), F.col("importance").alias("a_importance"))
    nodes = tree.filter("host is not null").join(every, F.col("path") == F.col("a_path"))
    weight = F.when(F.col("a_pages") >= LEAST_OF_ALL, PRIOR).otherwise(0)
    judged = (F.col("pages") >= least_pages) | (weight > 0)
    value = F.when(judged, (F.col("pages") * F.col("importance") + weight * F.col("a_importance")) / (F.col("pages") + weight)).otherwise(F.col("importance"))
    # on few pages most texts are a page's own by chance, which clears nothing of its mark
    sure = (F.col("pages") >= LEAST_OF_ALL) | (weight > 0)
    nodes = nodes.select("host", "path", "chain", "flags", "direct", judged.alias("judged"), sure.alias("sure"), value.alias("value"))
    # the most important node of each branch, whether judged or not
    best = nodes.select("host", F.explode("chain").alias("path"), "value").groupBy("host", "path").agg(F.max("value").alias("best"))
    nodes = nodes.filter("judged").join(best, ["host", "path"])
    is_marked, inside = F.col("flags").bitwiseAND(IS_MARKED) > 0, F.col("flags").bitwiseAND(IS_INSIDE) > 0
    goes = F.when(is_marked, ~F.col("sure") | (F.col("value") < marked)).otherwise(F.col("best") < low)
    said = {"low": goes, "cleared": is_marked & ~goes, "shown": F.col("sure") & ~inside & F.col("direct") & ~goes & (is_marked | (F.col("value") >= outside))}
    return nodes.groupBy("host").agg(*(F.collect_list(F.when(when, F.col("path"))).alias(name) for name, when in said.items()))


def main_texts(pages: DataFrame, low: float = LOW, marked: float = MARKED, outside: float = OUTSIDE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text of each row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text; a null URL is a host of its own, ''. Broken markup is read leniently: open elements
    close where HTML says so, unknown references stay as they are. Repeated rows repeat. Extra columns are ignored.
    """
    # written, so that its size decides whether it is broadcast; beyond that the join shuffles and skewed hosts are split
    judged = written(judge(style_tree(bounded(pages)), low, marked, outside, least_pages), "html-judged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = (b.column(c).to_pylist() for c in ("low", "cleared", "shown"))
            texts = [Page(text or "", *(frozenset(x or ()) for x in paths)).main_text() for text, *paths in zip(b.column("html").to_pylist(), *said)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host")).join(judged, "host", "left")
    return rows.mapInArrow(run, "page_id long, url string, text string")
