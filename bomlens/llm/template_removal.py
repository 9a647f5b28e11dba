"""Site template removal: subtrees that stand on many pages of a host are its template, the rest is the main text.

Every page is parsed into elements, and each block element is hashed with its names and all that is below it. Spark counts for each
host on how many different pages a hash stands, and how much of those pages' text it is. Subtrees that recur are deleted wherever they stand;
short blocks of running text (paragraphs, headings, items) only if most pages of the host hold them, and never inside an article, since
articles quote and repeat each other. Text that stands on few pages is never deleted for where it stands.

Lists of tags and names come second, for what never is article text though it differs from page to page: forms, scripts, menus, adverts, comments.
One rule serves all hosts: one of few pages has few recurring subtrees. On most pages these lists alone give the article, for what isn't the
article is marked as such; README has the figures.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: A subtree is template if it stands on this many different pages of a host at least, and on half the root of the host's different
#: pages at least; a block of running text must stand on half of the pages.
LEAST_PAGES = 3
#: At most so many hosts are split over tasks.
LARGE = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas".split())
#: Elements that are no article text wherever they stand.
NEVER = frozenset("nav aside form button select option datalist fieldset label dialog menu head script style textarea title noscript template iframe svg math object canvas audio video".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th ul caption".split())
#: Blocks of running text.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt dl ul ol table tbody thead tfoot tr td th figcaption figure caption".split())
#: An open p ends before these; an open li, dt, dd, tr, td or th ends before its like.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "li", "dt", "dd", "caption", "tbody", "thead", "tfoot"}
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
#: Words in class, id or role that mark other things than the article.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|consent|disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|alert|outbrain|pagination|pager|popup|promo\w*|recommend\w*|related|replies|reply|respond|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|subscription|taboola|toolbar|topbar|widgets?|contentinfo|complementary|search)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "key", "size")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children, self.key, self.size = tag, attrs, [], 0, 0


def parse(source: str) -> Node:
    """A tree of elements and strings; tags that are missing or cross are mended, nothing is dropped."""
    root = Node("#root", "")
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        close, tag = m.group(1), m.group(2)
        if close:
            close = close.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == close:
                    del stack[i:]
                    break
                if close not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag doesn't end a block
        elif tag:
            tag = tag.lower()
            like = LIKE.get(tag)
            if like:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in like:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE[tag]:
                        break
            elif tag in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK:
                        break
            node = Node(tag, m.group(3) or "")
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                if not (m.group(3) or "").endswith("/") or tag not in ("svg", "math"):
                    node.children.append(source[at : end.start() if end else n])
                    at = end.end() if end else n
            elif tag not in VOID:
                stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(node.attrs)}


def names(node: Node) -> str:
    """Id, class and role of an element, with digits left out."""
    if not node.attrs:
        return ""
    a = attributes(node)
    return re.sub(r"\d+", "", f"{a.get('id', '')} {a.get('class', '')} {a.get('role', '')}")


def marked(node: Node) -> str:
    """'skip', 'article' or ''."""
    if node.tag in NEVER:
        return "skip"
    if node.tag in ("header", "footer"):
        return "skip"
    a = attributes(node) if node.attrs else {}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return "skip"
    if a and node.tag in BLOCK and node.tag not in ("html", "body", "main") and MARKS.search(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"):
        return "skip"
    return "article" if node.tag in ("article", "main") or a.get("itemprop") == "articleBody" or a.get("role") == "main" else ""


def settle(root: Node) -> None:
    """Hashes and text sizes of all elements, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        h = xxhash.xxh3_64(f"{node.tag} {names(node)}>")
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    h.update(text)
                    node.size += 0 if node.tag in RAW else len(text)
            else:
                h.update(c.key.to_bytes(8, "little"))
                node.size += c.size
        node.key = h.intdigest()


def blocks(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in BLOCK and node.tag not in ("html", "body"):
            out.append(node)
        if node.tag not in RAW:
            todo += [c for c in node.children if isinstance(c, Node)]
    return out


def articles(root: Node) -> list[Node]:
    """The outermost elements that are marked as articles, in page order."""
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        mark = marked(node) if node is not root else ""
        if mark == "article" and node.size:
            found.append(node)
        elif mark != "skip":
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset(), lists: bool = True) -> str:
    """The page's blocks of text without template subtrees and skipped elements. ``lists`` off leaves the deletion to the template alone."""
    lines: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            lines.append(text)
        now.clear()

    todo: list = [(root, False, False)]
    while todo:
        node, leaving, inside = todo.pop()
        if leaving:
            end()
            continue
        if isinstance(node, str):
            now.append(node)
            continue
        if node.tag in ("br", "hr"):
            if node.tag == "hr":
                end()
            else:
                now.append(" ")
            continue
        if node is not root:
            if node.tag in BLOCK and node.key in template and not (inside and node.tag in PLAIN):
                continue
            mark = marked(node)
            inside = inside or mark == "article"
            if mark == "skip" and (lists or node.tag in RAW or node.tag == "head"):
                if node.tag != "header":
                    continue
                heads = [c for c in blocks(node) if c.tag in ("h1", "h2")]
                if not heads:
                    continue
                if not inside:  # a page's title stands in its header; what else does is none of the article
                    todo += [(c, False, False) for c in heads]
                    continue
        if node.tag in BLOCK:
            end()
            todo.append((node, True, inside))
        todo += [(c, False, inside) for c in reversed(node.children)]
    end()
    return "\n".join(lines)


def host(url):
    """The host of a URL in lower case; null and odd URLs have the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hashes(pages: DataFrame) -> DataFrame:
    """For each page a fingerprint of its article, its text's size, and its blocks: hash, size, whether of running text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, totals, found = [], [], []
            for source in b.column(1).to_pylist():
                root = parse(source)
                settle(root)
                found.append({x.key: (x.size, x.tag in PLAIN) for x in blocks(root) if x.size})
                tops = articles(root)
                prints.append(xxhash.xxh3_64_intdigest(b"".join(c.key.to_bytes(8, "little") for c in tops or [root])))
                totals.append(root.size)
            signed = lambda v: pa.array(np.array(list(v), np.uint64).view(np.int64), pa.int64())
            offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            sizes, plain = (pa.array([v[i] for at in found for v in at.values()], t) for i, t in ((0, pa.int64()), (1, pa.bool_())))
            flat = pa.StructArray.from_arrays([signed(k for at in found for k in at), sizes, plain], names=["key", "size", "plain"])
            yield pa.RecordBatch.from_arrays([b.column(0), signed(prints), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["host", "print", "total", "found"])

    return pages.mapInArrow(run, "host string, print long, total long, found array<struct<key: long, size: long, plain: boolean>>")


def templates(hashed: DataFrame) -> DataFrame:
    """``hashed``: rows of ``_hashes``. Returns host, template: the hashes of the host's recurring subtrees. Copies of one article count once, so a page
    that is served under many addresses is not its own template; nor is a subtree that holds most of its pages' text. At most some multiple of
    the root of a host's pages recurs often enough, so a host's row stays short."""
    seen = hashed.select("host", "print", "total", F.explode("found").alias("f"))
    seen = seen.groupBy("host", "print", "f.key").agg(F.max("total").alias("total"), F.max("f.size").alias("size"), F.min("f.plain").alias("plain"))
    sizes = hashed.filter(F.size("found") > 0).select("host", "print").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("total").alias("total"), F.min("plain").alias("plain")).filter(F.col("n") >= LEAST_PAGES)
    often = F.when(F.col("plain"), 2 * F.col("n") >= F.col("pages")).otherwise(2 * F.col("n") >= F.sqrt("pages"))
    recurring = counts.filter(2 * F.col("size") < F.col("total")).join(sizes, "host").filter(often)
    return recurring.groupBy("host").agg(F.collect_list("key").alias("template"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, url and main text. Null or empty html gives the empty text; pages with a null url form
    one host; repeated rows are extracted alike; other columns are ignored; no rows give no rows."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    # On local disks each file that is written costs the executor a process of its own (chmod), which is as large as the executor until it
    # has begun. So hashes are written where the pages are read, not by shuffle partition, and hosts in one table.
    hashed = written(_hashes(rows.select("host", "html")), "subtrees")
    of = written(hashed.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(templates(hashed), "host", "left"), "templates")
    discard(hashed)
    # Hosts with many pages are split: those with more than a hundred-thousandth of all, so there are no more than LARGE of them.
    bar, salts = max(1000, (of.agg(F.sum("n")).first()[0] or 0) // LARGE), 64
    large = F.broadcast(of.filter(F.col("n") > bar).select("host", F.lit(True).alias("large")))
    copies = F.when(F.col("large"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    found = of.filter(F.col("template").isNotNull()).join(large, "host", "left").select("host", "template", F.explode(copies).alias("salt"))
    salted = rows.join(large, "host", "left").withColumn("salt", F.when(F.col("large"), F.pmod(F.xxhash64("url", "page_id"), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    joined = salted.join(found, ["host", "salt"], "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lambda x: set(x.values.to_numpy().view(np.uint64).tolist()) if x.is_valid else frozenset()
        for b in batches:
            out = []
            for source, found in zip(b.column(2).to_pylist(), b.column(3)):
                root = parse(source)
                settle(root)
                out.append(main_text(root, keys(found)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")


def op4_template_removal(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; see ``extract`` for nulls, ties and odd rows."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
