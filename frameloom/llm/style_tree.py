"""Main text of web pages by a site style tree.

Pages of one host are merged by the paths of their elements. Each node of the merged tree has an importance from two
entropies over the host's pages: of its presentation (the child tags it is laid out with) and of its content. Branches
of low importance are removed from each page; what the markup itself says is furniture is removed everywhere.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow, materialize, slices

#: Elements by what they are.
RAW = frozenset("script style title textarea noscript template iframe svg math object xmp noembed".split())
FURNITURE = frozenset("nav header footer aside form button select dialog menu figure head option label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK = frozenset("div h1 h2 h3 ul ol table section article main nav footer aside header form".split())
MAIN = frozenset(("article", "main"))
#: Open elements that a new one closes, if only inline elements and paragraphs stand between.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Words of class names, ids and roles. One of NAMED alone, or a few of them with PLACES, names furniture,
#: unless the name says that something has it or is without it (ABOUT). On paragraphs and smaller elements the words of
#: TALK name nothing: readers' comments come in containers.
NAMED = frozenset("advert advertisement adverts advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus gdpr navbar newsletter popup sidebar sponsored ad ads banner consent footer header menu modal nav navigation notice notices pagination promo promoted promotion recommended related replies share sharing social sponsor subscribe subscription toolbar widget".split())
PLACES = frozenset("area bar block bottom box buttons container global inner item items left line link links list main outer page panel posts primary right secondary reader readers section side signup site slot sticky overlay thread top user users wrap wrapper".split())
ABOUT = frozenset("has have with without no not is hide show".split())
SMALL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
TALK = frozenset("comment comments commentlist disqus replies".split())
_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_EACH = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_333_333


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


class Node:
    """An open or closed element. key names its whole path; low_any and low_main: it or an element above is of low
    importance, anywhere or below an article; root: the outermost element above that is furniture."""

    __slots__ = ("tag", "key", "up", "root", "main", "low_any", "low_main", "style", "parts")

    def __init__(self, tag, key, up, root, main, low_any, low_main):
        self.tag, self.key, self.up, self.root, self.main, self.low_any, self.low_main = tag, key, up, root, main, low_any, low_main
        self.style: dict[str, None] = {}
        self.parts: list = []

    @property
    def removed(self) -> bool:
        return self.root is not None


def names_furniture(tag: str, tokens: list[str], inside: bool) -> bool:
    """Whether one of an element's class names, ids or roles says that it is furniture. Of articles only those of
    readers' comments are; a header inside an article isn't."""
    for token in tokens:
        words = _WORDS.findall(token)
        if not words or words[0] in ABOUT or inside and "header" in words:
            continue
        if tag in MAIN:
            if len(words) == 1 and words[0] in TALK:
                return True
        elif tag in SMALL and all(w in TALK for w in words):
            continue
        elif any(w in NAMED for w in words) and all(w in NAMED or w in PLACES for w in words):
            return True
    return False


def is_hidden(attributes: str) -> bool:
    """An element with the attribute hidden, aria-hidden true, or a style of display none; what other attributes say is
    text."""
    for m in _EACH.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _tag_end(page: str, at: int, absent: set[str]) -> int:
    """Where a tag's closing bracket stands, beyond quoted values; -1 if it is cut off. absent: quotes that are known
    not to come any more, so that no page is read to its end more than once for each."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        quote, at = m[1], m.end()
        if quote is None:
            return m.start()
        if quote not in absent:
            end = page.find(quote, at)
            if end < 0:
                absent.add(quote)
            else:
                at = end + 1


def parse(page: str, low: frozenset[int] | set[int] = frozenset()) -> tuple[list[tuple[Node, str | None]], list[Node]]:
    """Text runs in order, each with its element (a run of None ends a block), and all elements.

    Lenient: an end tag closes up to its own element if that is open; paragraphs, items and cells close each other; an
    article or main inside furniture that was never closed stands on its own; a tag, comment or raw element that is cut
    off ends the page. Time and memory are linear in the page's length, however deep it nests.
    """
    top = Node("", 0, None, None, False, False, False)
    stack, nodes, runs, at, size, absent = [top], [top], [], 0, len(page), set()
    places: dict[str, list[int]] = {}  # of each tag's open elements on the stack
    mains: list[int] = [0]
    last_end: dict[str, int] = {}

    def text(lo: int, hi: int):
        if lo < hi:
            node = stack[-1]
            own = entities.unescape(page[lo:hi])
            runs.append((node, own))
            if own := own.strip():
                node.parts.append(_digest(own.encode("utf-8", "surrogatepass")))

    def cut(to: int):
        while len(stack) > to:
            node = stack.pop()
            places[node.tag].pop()
            if node.tag in MAIN:
                mains.pop()

    def never_closed(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_end[tag] < at

    while at < size:
        m = _OPEN.search(page, at)
        if m is None:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        if m[5] is None:
            end = page.find("-->", max(m.start() + 2, at - 2)) + 3 if m[1] else page.find("]]>", at) + 3 if m[2] else 0
            if end < 3 and not m[1]:
                end = page.find(">", at) + 1
            runs.append((stack[-1], None))
            at = end if end > 2 else size
            continue
        close, tag = m[4], m[5].lower()
        end = _tag_end(page, at, absent)
        attributes, at = page[at : end if end >= 0 else size], end + 1 if end >= 0 else size
        if end < 0:
            break
        if tag not in INLINE:
            runs.append((stack[-1], None))
        if close:
            own = places.get(tag)
            # a stray end tag doesn't close the article around it
            if own and (own[-1] >= mains[-1] or tag in ("html", "body")):
                cut(own[-1])
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            at = found.end() if found else size
            continue
        if tag in VOID or attributes.endswith("/") and tag not in INLINE:
            continue
        if closes := CLOSES.get(tag):
            if any(places.get(c) for c in closes):
                k = to = len(stack)
                while k > 1 and (stack[k - 1].tag in closes or stack[k - 1].tag in INLINE or stack[k - 1].tag == "p"):
                    k -= 1
                    if stack[k].tag in closes:
                        to = k
                cut(to)
        elif tag in BLOCK and stack[-1].tag == "p":
            cut(len(stack) - 1)
        root = stack[-1].root
        if tag in MAIN and root is not None and root.tag in ("nav", "header", "head", "footer", "div", "ul", "p") and never_closed(root.tag):
            cut(next(k for k in places[root.tag] if stack[k] is root))
        up = stack[-1]
        tokens, hidden = [], False
        if attributes:
            tokens = sorted({t for a in _ATTR.finditer(attributes) for t in (a[2] or a[3] or a[4] or "").lower().split()})
            hidden = _MAY_HIDE.search(attributes) is not None and is_hidden(attributes)
        furniture = False
        if tag not in ("html", "body"):
            furniture = hidden or tag in FURNITURE and not (tag in ("header", "figure") and up.main) or names_furniture(tag, tokens, up.main)
        mark = ".".join([tag, *("".join(c for c in t if not c.isdigit()) for t in tokens)])
        key = _digest(b"%d/" % up.key + mark.encode("utf-8", "surrogatepass"))
        is_low = key in low
        node = Node(tag, key, up, up.root, up.main or tag in MAIN, up.low_any or is_low, up.low_main or is_low and up.main and tag not in MAIN)
        if furniture and node.root is None:
            node.root = node
        up.style[mark] = None
        up.parts.append(node)
        places.setdefault(tag, []).append(len(stack))
        if tag in MAIN:
            mains.append(len(stack))
        stack.append(node)
        nodes.append(node)
    return runs, nodes


def extract(page: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's blocks in order, without furniture and without branches whose key is in low.

    A page with an article or main element that holds text gives that text alone. There the elements down to and with
    the article are never low, and a block goes when all its text lies in low branches, so that a sentence keeps its
    inline elements; an article of nothing but low branches stays whole. Without such an element every low branch goes.
    """
    runs, nodes = parse(page or "", low)
    has_main = any(n.main and not n.removed and t and t.strip() for n, t in runs)
    blocks, own = [], []  # blocks as (text, whether all of it is low)
    for node, t in (*runs, (nodes[0], None)):
        if t is None:
            if own:
                if text := _BLANK.sub(" ", "".join([x for x, _ in own])).strip():
                    blocks.append((text, all(is_low for x, is_low in own if x.strip())))
                own = []
            continue
        if node.removed or has_main and not node.main:
            continue
        is_low = node.low_main if has_main else node.low_any
        if has_main or not is_low:
            own.append((t, is_low))
    return " ".join([x for x, is_low in blocks if not is_low] or [x for x, _ in blocks])


def branches(page: str | None) -> list[tuple[int, str, int, int]]:
    """(key, last tag, presentation hash, content hash) of the page's elements with text; those of one path are taken
    together. Content is the texts in order, whatever the elements between them; equal contents have equal hashes."""
    _, nodes = parse(page or "")
    sums: dict[int, tuple[int, int]] = {}  # polynomial hash and number of the texts below a node
    for node in reversed(nodes):  # elements stand behind the one they are in
        h = n = 0
        for part in node.parts:
            ph, pn = sums.pop(id(part)) if isinstance(part, Node) else (part % _PRIME + 1, 1)
            if pn:
                h, n = (h * pow(_BASE, pn, _PRIME) + ph) % _PRIME, n + pn
        sums[id(node)] = h, n
        node.parts = (h, n)
    found: dict[int, list] = {}
    for node in nodes[1:]:
        h, n = node.parts
        entry = found.setdefault(node.key, [node.tag, {}, 0, 0])
        entry[1][",".join(node.style)] = None
        entry[2], entry[3] = (entry[2] * pow(_BASE, n, _PRIME) + h) % _PRIME, entry[3] + n
    return [(key, tag, _digest("\x1f".join(styles).encode("utf-8", "surrogatepass")), h) for key, (tag, styles, h, n) in found.items() if n]


def site_style_tree(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, node, tag, pages, presentation, content, importance): the merged tree of each host.

    Entropies are of the host's distinct (presentation, content) pairs at a node, so that copies of one page count
    once, divided by the logarithm of the pages; importance is the larger. Pages are parsed once, and counted exactly:
    a page's row at a node is first made distinct, dealt by all of them, so a host's or a node's many rows spread. A null
    host is the empty one; no pages, no nodes.
    """
    schema = pa.schema([("host", pa.string()), ("node", pa.int64()), ("tag", pa.string()), ("style", pa.int64()), ("content", pa.int64()), ("page", pa.int64())])

    def run(batches):
        for b in slices(batches, "html"):
            out = []
            for h, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = _digest((page or "").encode("utf-8", "surrogatepass"))
                out += [(h, *x, own) for x in branches(page)]
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    rows = map_arrow(pages.selectExpr(f"coalesce(`{host}`, '') AS host", f"`{html}` AS html"), run, "host string, node long, tag string, style long, content long, page long")
    own = ["host", "node"]
    nodes = materialize(rows.distinct().groupBy(*own, "style", "content").agg(F.count("*").alias("n"), F.min("tag").alias("tag")), "nodes")
    styles = nodes.groupBy(*own, "style").agg(F.sum("n").alias("n")).groupBy(*own).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    contents = nodes.groupBy(*own).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("c"), F.min("tag").alias("tag"))
    # -sum(n/t ln(n/t)) = ln t - sum(n ln n) / t
    share = lambda s, t: F.when(F.col(t) > 1, (F.log(t) - F.col(s) / F.col(t)) / F.log(t)).otherwise(F.lit(1.0))
    tree = contents.join(styles, own).select(*own, "tag", "pages", share("s", "t").alias("presentation"), share("c", "pages").alias("content"))
    return tree.withColumn("importance", F.greatest("presentation", "content"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = 0.3, least_pages: int = 8, broadcast_nodes: int = 200_000, salts: int = 64) -> DataFrame:
    """(id_col, url_col, text, n_chars) of each page.

    A branch is removed when its importance on its host, over at least least_pages distinct pages, is below
    least_importance; hosts with fewer pages rely on the markup. Low branches are paths of templates: while there are at
    most broadcast_nodes (counted first) every worker gets them and no page is moved. Beyond that, pages and salted
    copies of their host's branches are dealt by host and salt and read as a stream, a host at a time. Edge cases: a
    null html is empty and gives the empty text; pages without a host are one host of their own; cut-off and ill-nested
    markup is read leniently, in linear time; repeated ids are extracted row by row; other columns are ignored; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    p = p.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    low = site_style_tree(p).where((F.col("pages") >= least_pages) & (F.col("importance") < least_importance)).select("host", "node")
    low = materialize(low, "low")
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    ddl = "id long, url string, text string, n_chars long"

    def rows_of(b, low_of):
        texts = [extract(h, low_of(host)) for h, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True)]
        return batch_of(schema, b.column("id"), b.column("url"), texts, [len(t) for t in texts])

    if low.count() <= broadcast_nodes:
        found: dict[str, set[int]] = {}
        for r in low.collect():  # broadcast_nodes numbers at most
            found.setdefault(r["host"], set()).add(r["node"])
        sent = spark.sparkContext.broadcast(found)

        def run(batches):
            known = sent.value
            for b in slices(batches, "html"):
                yield rows_of(b, lambda host: known.get(host, frozenset()))

        out = map_arrow(p, run, ddl)
    else:
        dealt = p.withColumn("node", F.lit(None).cast("long")).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
        copies = low.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "node", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        stream = dealt.unionByName(copies).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("node").asc_nulls_last())

        def run_stream(batches):
            own, nodes = None, set()
            for b in slices(batches, "html"):
                host, salt, node = (b.column(c).to_pylist() for c in ("host", "salt", "node"))
                is_page, lows = [n is None for n in node], []
                for h, s, n in zip(host, salt, node, strict=True):
                    if (h, s) != own:
                        own, nodes = (h, s), set()
                    if n is None:
                        lows.append(nodes)
                    else:
                        nodes.add(n)
                if lows:
                    each = iter(lows)
                    yield rows_of(b.filter(pa.array(is_page)), lambda _, each=each: next(each))

        out = map_arrow(stream, run_stream, ddl)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
