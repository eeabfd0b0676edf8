"""4. Main text of web pages, with site templates removed.

A page is parsed into a tree of elements. The hash of every element's subtree (tags, classes and text) that can be template is
counted per host. Outside an article that is every block, counted over distinct pages. What an article says is not
template however often it is copied, so inside one it is only a box (a list, a division, a table, a section) that holds less
than half of the article's text, counted over distinct articles: a box in many different articles is the site's. A
subtree with a count of at least `min_pages` and of log2 of the host's pages is template and is deleted; the bar grows so
slowly that a section's menu is found on a host of millions of pages as on a small one.
Besides, elements that declare what they are (nav, footer, aside, form, script, an advert's class, ...) are deleted; that
covers pages of hosts too small to count. A subtree is known by 64 bits: a wrong deletion takes a hash equal to one of the
few templates of its own host.

The text is that of the article element, or main, or else the body: blocks in page order, white space within a block as one
space, blocks joined by one newline. br is white space within its block, as it is no block in HTML. Character references are
decoded once, as HTML does.

Null or empty html gives an empty text; a null url or one without a host is a host of its own; rows repeat as they do in the
input, rows of equal html are one page of a host; other columns are passed over. Long pages and stray tags take time in
proportion to their length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import may_hold, membership, salted_join, saved

MIN_PAGES = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
#: Elements that are never main text.
DROPPED = frozenset("script style noscript template iframe noembed noframes xmp object embed applet svg math canvas audio video map head title nav footer aside form button select option datalist input textarea label fieldset dialog menu".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that can be a box of the site's within an article.
BOXES = frozenset("ul ol div section table dl details figure".split())
#: A start tag of these ends an open p.
ENDS_P = BLOCKS - {"td", "th", "tr", "caption", "tbody", "thead", "tfoot", "html", "body", "option", "optgroup", "legend"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Text-level elements, closed when the block around them ends.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class or id that name a part other than the article.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adbox|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|signup|sidebar|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|respond|disqus|replies|share|sharing|social|related|recommended|recommendations|popup|modal|overlay|masthead|site-header|site-footer|page-header|page-footer|topbar|toolbar|footer|pagination|pager|widget|skip-link)(?=$|[\s_-])", re.I)

_tag = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_attr = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_space = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "role", "kids", "parent", "digest")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.name = self.role = ""
        self.digest = b""
        if attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "CLASS" in attrs or "ID" in attrs or "ROLE" in attrs):
            for k, a, b, c in _attr.findall(attrs):
                k = k.lower()
                if k == "class" or k == "id":
                    self.name = f"{self.name} {entities.unescape(a or b or c)}".strip()
                elif k == "role":
                    self.role = (a or b or c).strip().lower()


def parse(source: str) -> Node:
    """The page's tree: kids are nodes and strings. Tags that a page leaves open end where HTML ends them."""
    root = Node("#root")
    at, here = 0, root
    open_: Counter[str] = Counter()  # elements that are open, by tag: a stray end tag ends nothing

    def close(x: Node) -> Node:
        """x and all that is open in it end; where the page goes on."""
        y = here
        while y is not x.parent:
            open_[y.tag] -= 1
            y = y.parent
        return y

    n = len(source)
    while at < n:
        m = _tag.search(source, at)
        if not m:
            here.kids.append(source[at:])
            break
        if m.start() > at:
            here.kids.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            x = here if open_[tag] else root
            while x is not root and x.tag != tag:
                if tag in INLINE and x.tag in BLOCKS and x.tag != "p":
                    x = root  # a stray end tag of running text does not end a block
                    break
                x = x.parent
            if x is not root:
                here = close(x)
            elif tag == "p":
                here.kids.append(Node("p", "", here))
            continue
        if tag in ENDS_P and open_["p"]:
            x = here
            while x is not root and (x.tag in INLINE):
                x = x.parent
            if x.tag == "p":
                here = close(x)
        if tag in CLOSES and any(open_[k] for k in CLOSES[tag]):
            x, stop, last = here, SCOPE.get(tag, ()), None
            while x is not root and x.tag not in stop:
                if x.tag in CLOSES[tag]:
                    last = x
                x = x.parent
            here = close(last) if last else here
        node = Node(tag, m[3], here)
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|$", re.I).search(source, at)
            if end.start() > at:
                node.kids.append(source[at : end.start()])
            at = max(end.end(), at)
        elif tag not in VOID and not (tag in ("svg", "math") and m[3].endswith("/")):  # the slash of others means nothing
            here = node
            open_[tag] += 1
    return root


def _nodes(root: Node):
    """Nodes in page order, parents first; no recursion, as pages nest deeply."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(k for k in reversed(x.kids) if type(k) is Node)


def container(root: Node) -> list[Node]:
    """The nodes whose text is the main text: outermost articles, else main, else the body or the page."""
    found: list[Node] = []
    for tags in (("article",), ("main",)):
        todo = [root]
        while todo:
            x = todo.pop()
            if x is not root and (x.tag in tags or (tags == ("main",) and x.role == "main")):
                if not unwanted(x, False):
                    found.append(x)
                continue
            if x is root or not unwanted(x, False):
                todo.extend(k for k in reversed(x.kids) if type(k) is Node)
        if found:
            return found
    return [next((x for x in _nodes(root) if x.tag == "body"), root)]


def unwanted(x: Node, inside: bool) -> bool:
    """Whether an element says that it is no main text; inside an article a header is the article's own."""
    return x.tag in DROPPED or (x.tag == "header" and not inside) or x.role in ROLES or (x.name and x.tag not in ("html", "body", "main") and bool(NAMED.search(x.name)))


def digests(root: Node) -> None:
    """Sets the hash of each node's subtree, children before parents."""
    for x in reversed(list(_nodes(root))):
        h = hashlib.blake2b(f"{x.tag}\x1f{x.name}\x1f{x.role}".encode("utf-8", "replace"), digest_size=16)
        for k in x.kids:
            h.update(b"\x1e" + (k.digest if type(k) is Node else _space.sub(" ", k).strip().encode("utf-8", "replace")))
        x.digest = h.digest()


def _sizes(root: Node) -> dict[int, int]:
    """Characters of text in each node's subtree, by the node's identity."""
    out: dict[int, int] = {}
    for x in reversed(list(_nodes(root))):
        out[id(x)] = sum(out[id(k)] if type(k) is Node else len(k.strip()) for k in x.kids)
    return out


def candidates(root: Node) -> set[tuple[int, int]]:
    """Hashes of the subtrees that can be template, each with 0, or the hash of the article that it stands in."""
    named = any(x.tag in ("article", "main") or x.role == "main" for x in _nodes(root))
    inner = {id(x) for x in container(root)} if named else set()
    size = _sizes(root)
    out: set[tuple[int, int]] = set()
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        x, article = todo.pop()
        article = x if id(x) in inner else article
        for k in x.kids:
            if type(k) is Node:
                todo.append((k, article))
        if x is root or x.tag in ("html", "body", "head", "article", "main") or x.tag not in BLOCKS or id(x) in inner:
            continue
        if article is None:
            out.add((_number(x), 0))
        elif x.tag in BOXES and 2 * size[id(x)] < size[id(article)]:
            out.add((_number(x), _number(article)))
    return out


def read_nodes(root: Node) -> set[int]:
    """Hashes of the blocks that `main_text` comes to: only a template among them changes a page's text."""
    out: set[int] = set()
    for top in container(root):
        inside = top.tag in ("article", "main") or top.role == "main"
        todo = [k for k in top.kids if type(k) is Node]
        while todo:
            x = todo.pop()
            if not unwanted(x, inside):
                if x.tag in BLOCKS:
                    out.add(_number(x))
                todo.extend(k for k in x.kids if type(k) is Node)
    return out


def _number(x: Node) -> int:
    return int.from_bytes(x.digest[:8], "big", signed=True)


def main_text(root: Node, template: set[int]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            t = _space.sub(" ", entities.unescape("".join(line))).strip()
            line.clear()
            if t:
                blocks.append(t)

    for top in container(root):
        inside = top.tag in ("article", "main") or top.role == "main"
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif type(x) is str:
                line.append(x)
            elif x.tag == "br":
                line.append("\n")
            else:
                if x is not top and (unwanted(x, inside) or (template and x.digest and _number(x) in template) or (x.tag == "article" and inside and x.name and NAMED.search(x.name))):
                    end() if x.tag in BLOCKS else None
                    continue
                if x.tag in BLOCKS:
                    end()
                    todo.append(None)
                todo.extend(reversed(x.kids))
        end()
    return "\n".join(blocks)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.md5(F.coalesce("html", F.lit(""))).alias("mark"))
    kind = pa.list_(pa.struct([("sub", pa.int64()), ("of", pa.int64()), ("read", pa.bool_())]))

    def hashed(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out = []
                for t in part.column("html").to_pylist():
                    root = parse(t or "")
                    digests(root)
                    read = read_nodes(root)
                    out.append([{"sub": x, "of": y, "read": x in read} for x, y in sorted(candidates(root))])
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("mark"), pa.array(out, kind)], names=["host", "mark", "subs"])

    subs = saved(rows.select("host", "html", "mark").mapInArrow(hashed, "host string, mark string, subs array<struct<sub: long, of: long, read: boolean>>"), "subtrees", "zstd")
    distinct = subs.dropDuplicates(["host", "mark"])
    bar = distinct.groupBy("host").agg(F.greatest(F.ceil(F.log2(F.count("*"))), F.lit(min_pages)).alias("bar"))
    found = distinct.select("host", "mark", F.explode("subs").alias("x")).select("host", "x.sub", F.when(F.col("x.of") == 0, F.xxhash64("mark")).otherwise(F.col("x.of")).alias("of")).distinct()
    often = found.groupBy("host", "sub").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    template = often.join(bar, "host").where("n >= bar").select("host", "sub")
    read = distinct.select("host", "mark", F.explode(F.filter("subs", lambda x: x["read"])).alias("x")).select("host", "mark", "x.sub").distinct()
    per_page = salted_join(read, template, ["host", "sub"], "inner", F.xxhash64("mark"))
    per_page = saved(per_page.groupBy("host", "mark").agg(F.collect_set("sub").alias("template")), "templates", "zstd")
    # pages that read no template are never shuffled; a filter of bounded size tells them apart and errs on the other side only
    bits = pages.sparkSession.sparkContext.broadcast(membership(per_page.select(F.xxhash64("host", "mark")).distinct()))
    marked = rows.withColumn("x", F.xxhash64("host", "mark"))

    def sorted_out(shuffled: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(may_hold(bits.value, b.column("x").to_numpy()) == shuffled))

        return marked.mapInArrow(run, marked.schema).drop("x")

    none = F.lit(None).cast("array<long>").alias("template")
    joined = salted_join(sorted_out(True), per_page, ["host", "mark"], "left", F.xxhash64("page_id"), 4).select("page_id", "url", "html", "template")
    joined = sorted_out(False).select("page_id", "url", "html", none).union(joined)

    def texts(batches):
        for b in batches:
            out = []
            for t, cut in zip(b.column("html").to_pylist(), b.column("template").to_pylist()):
                root = parse(t or "")
                if cut:
                    digests(root)
                out.append(main_text(root, set(cut or ())))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
