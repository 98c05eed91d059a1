"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a tree of block elements; inline markup joins the text around it, missing end tags
are supplied. Its *shape* keeps elements and places of text: neighbours with the same form
are one repeated group. The shapes of a host are aligned one after the other. Where two
differ, what only one has becomes an optional group, what follows itself a repeated group,
and text a slot; the result is the host's wrapper. Pages are read along their wrapper, and
the slots below its main element, the one that holds most text over all pages of the host,
are the main text.

Shapes are counted before they meet, so a host costs its different shapes, not its pages.
Hosts with many shapes are aligned in buckets first, and the buckets' wrappers after that.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

SHAPES = 64  # shapes or wrappers that are aligned in one task
GROUP = 4  # elements of a repeated group at most

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^<]*\Z",
    re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)

# Fixed values of the language: elements by how they are read.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSED_BY = {  # an open element that ends where one of these begins
    "p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer",
          "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p",
          "pre", "section", "table", "ul"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}
# Elements and names of classes that are no main text.
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select",
         "fieldset", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video"}
ASIDE_NAMES = re.compile(
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|ads?"
    r"|adverts?|advertisement|advertising|sponsor|sponsored|promo|banner|cookies?|consent|notice"
    r"|notification|alert|newsletter|subscribe|signup|login|social|share|sharing|related"
    r"|recommended|comments?|commentlist|disqus|replies|reply|respond|popup|modal|toolbar"
    r"|pagination|pager|search|contentinfo|complementary)")
MAIN = {"article", "main"}

Node = list  # [symbol, children]; a child is a node or a text
Item = list  # of a wrapper: [symbol, quantifier, items]; "#" is a text slot, "()" a group


def is_aside(tag: str, names: str) -> bool:
    if tag in ASIDE:
        return True
    words = names.lower().split()
    if tag in MAIN or tag in ("body", "html"):  # only what says plainly that it is something else
        return tag in MAIN and any(re.fullmatch(r"comments?|reply|replies", w) for w in words)
    return any(ASIDE_NAMES.fullmatch(part) for w in words for part in (w, *re.split(r"[-_]+", w)))


def parse(page: str) -> Node:
    """The tree of block elements. Asides stay as elements without content, marked ``!``."""
    root: Node = ["", []]
    stack: list[tuple[str, Node]] = [("", root)]
    muted = 0  # depth in the stack from which everything is aside
    at = 0
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if not muted and text.strip():
                stack[-1][1][1].append(text)

    def close(depth: int) -> None:
        nonlocal muted
        flush()
        del stack[depth:]
        if muted >= len(stack):
            muted = 0

    while True:
        token = TOKEN.search(page, at)
        if token is None:
            pieces.append(entities.unescape(page[at:]))
            break
        if token.start() > at:
            pieces.append(entities.unescape(page[at:token.start()]))
        at = token.end()
        tag = token[2].lower() if token[2] else None
        if tag is None:
            continue
        if token[1]:
            if tag in INLINE and not any(t == tag for t, _ in stack[-1:]):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        names = " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(token[3])) if token[3] else ""
        if tag in RAW:
            flush()
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(page, at)
            at = end.end()
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        aside = is_aside(tag, names)
        if tag in INLINE and not (aside and names):
            continue
        flush()
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if tag in VOID:
            continue
        symbol = tag + (("." + re.sub(r"\d+", "0", ".".join(names.split()))) if names else "")
        node: Node = [("!" if aside else "") + symbol, []]
        if not muted:
            stack[-1][1][1].append(node)
        stack.append((tag, node))
        if aside and not muted:
            muted = len(stack) - 1
    flush()
    return root


# ---- wrappers --------------------------------------------------------------------------

def looser(a: str, b: str) -> str:
    """The quantifier that allows what either allows."""
    many = any(q in ("+", "*") for q in (a, b))
    none = any(q in ("?", "*") for q in (a, b))
    return "*" if many and none else "+" if many else "?" if none else ""


def merged(a: Item, b: Item, quantifier: str | None = None) -> Item:
    return [a[0], looser(a[1], b[1]) if quantifier is None else quantifier, align(a[2], b[2])]


def repeated(items: list[Item]) -> list[Item]:
    """Neighbours of the same form become one repeated group."""
    for size in range(1, GROUP + 1):
        out: list[Item] = []
        i = 0
        while i < len(items):
            block = items[i:i + size]
            names = [x[0] for x in block]
            stop = i + size
            while [x[0] for x in items[stop:stop + size]] == names and (size == 1 or "#" not in names):
                block = [merged(x, y) for x, y in zip(block, items[stop:stop + size])]
                stop += size
            if stop > i + size and size == 1:
                block[0][1] = "" if block[0][0] == "#" else looser(block[0][1], "+")
                out += block
            elif stop > i + size:
                out.append(["()", "+", block])
            else:
                out.append(items[i])
                stop = i + 1
            i = stop
        items = out
    return items


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """One list of items that describes whatever either describes."""
    if a == b:
        return a
    key = lambda x: x[0] if x[0] != "()" else "()" + "".join(y[0] for y in x[2])
    out: list[Item] = []
    matcher = SequenceMatcher(None, [key(x) for x in a], [key(x) for x in b], autojunk=False)
    for kind, i, j, k, m in matcher.get_opcodes():
        if kind == "equal":
            out += [merged(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[x[0], looser(x[1], "?"), x[2]] for x in a[i:j] + b[k:m]]
    return repeated(out)


def shape(node: Node) -> list[Item]:
    return repeated([["#", "", []] if isinstance(x, str) else [x[0], "", shape(x)] for x in node[1]])


def expression(items: list[Item]) -> str:
    """The wrapper as a regular expression over elements and text slots."""
    out = []
    for symbol, quantifier, inner in items:
        body = "#" if symbol == "#" else expression(inner) if symbol == "()" else (
            f"<{symbol}>{expression(inner)}</{symbol.split('.')[0]}>")
        out.append(f"({body}){quantifier}" if quantifier else body)
    return "".join(out)


def _covers(items: list[Item], node: Node) -> bool:
    """Whether the wrapper describes the children of a node, each element by itself."""
    flat: dict[str, Item] = {}

    def collect(some: list[Item]) -> None:
        for x in some:
            collect(x[2]) if x[0] == "()" else flat.setdefault(x[0], x)

    collect(items)
    return all(("#" if isinstance(x, str) else x[0]) in flat and (
        isinstance(x, str) or _covers(flat[x[0]][2], x)) for x in node[1])


# ---- main element ----------------------------------------------------------------------

def masses(node: Node, path: str = "", out: dict[str, int] | None = None) -> dict[str, int]:
    """Characters of text by element: of its own slots and of the blocks right below it."""
    out = {} if out is None else out
    for child in node[1]:
        if isinstance(child, str):
            above = path.rpartition("/")[0]
            out[path] = out.get(path, 0) + len(child)
            out[above] = out.get(above, 0) + len(child)
        elif not child[0].startswith("!"):
            masses(child, f"{path}/{child[0]}", out)
    return out


def tag_of(symbol: str) -> str:
    return symbol.partition(".")[0]


def main_path(total: dict[str, int]) -> str:
    """The path of the main element: an article or main element if there is one, else what
    holds most text right below it."""
    marked: dict[str, int] = {}
    for path, n in total.items():
        parts = path.split("/")
        for i, part in enumerate(parts):
            if tag_of(part) in MAIN:
                at = "/".join(parts[:i + 1])
                marked[at] = marked.get(at, 0) + n
                break
    if marked:
        return max(sorted(marked), key=lambda p: (tag_of(p.rpartition("/")[2]) == "article", marked[p]))
    return max(sorted(total), key=lambda p: total[p]) if total else ""


def texts(node: Node) -> Iterator[str]:
    for child in node[1]:
        if isinstance(child, str):
            yield child
        elif not child[0].startswith("!"):
            yield from texts(child)


def below(node: Node, path: list[str]) -> Iterator[Node]:
    if not path:
        yield node
    else:
        for child in node[1]:
            if not isinstance(child, str) and child[0] == path[0]:
                yield from below(child, path[1:])


def main_text(page: str, wrapper: list[Item] | None, main: str | None) -> str:
    """Text of the main element. A page that its wrapper does not describe, or that has no
    text there, is read by its own main element."""
    tree = parse(page)
    found: list[str] = []
    if wrapper is not None and main and _covers(wrapper, tree):
        found = [t for node in below(tree, main.split("/")[1:]) for t in texts(node)]
    if not found:
        own = main_path(masses(tree))
        found = [t for node in below(tree, own.split("/")[1:]) for t in texts(node)]
    return " ".join(" ".join(found).split())


# ---- jobs ------------------------------------------------------------------------------

def host(url: Column) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, wrapper, main, pattern)``: the wrapper as JSON, the path of its main element
    and the wrapper as a regular expression."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, paths = [], []
            for page in batch.column(1).to_pylist():
                tree = parse(page)
                shapes.append(json.dumps(shape(tree), separators=(",", ":"), ensure_ascii=False))
                paths.append(list(masses(tree).items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shapes, pa.string()),
                 pa.array(paths, pa.map_(pa.string(), pa.int64()))], ["host", "shape", "mass"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        whole: list[Item] | None = None
        for text in sorted(group["shape"]):
            one = json.loads(text)
            whole = one if whole is None else align(whole, one)
        return pd.DataFrame({"host": group["host"].iloc[:1], "shape": [json.dumps(
            whole, separators=(",", ":"), ensure_ascii=False)]})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main = [main_path(dict(m or [])) for m in batch.column(2).to_pylist()]
            patterns = [expression(json.loads(w)) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(main, pa.string()), pa.array(patterns, pa.string())],
                ["host", "wrapper", "main", "pattern"])

    seen = common.checkpoint(pages.select(
        host(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).mapInArrow(look, "host string, shape string, mass map<string,bigint>"))
    level = seen.select("host", "shape").distinct()
    while True:
        # Buckets of a bounded number of shapes, until each host is one.
        size = Window.partitionBy("host")
        sized = level.withColumn("buckets", F.ceil(F.count("*").over(size) / SHAPES)).withColumn(
            "bucket", F.pmod(F.xxhash64("shape"), F.col("buckets")))
        more = not sized.filter("buckets > 1").isEmpty()
        level = common.checkpoint(sized.select("host", "bucket", "shape").groupBy("host", "bucket").applyInPandas(
            together, "host string, shape string"))
        if not more:
            break
        level = level.distinct()
    mass = seen.select("host", F.explode("mass").alias("path", "n")).groupBy("host", "path").agg(
        F.sum("n").alias("n")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "n"))).alias("mass"))
    return level.join(mass, "host", "left").select("host", "shape", "mass").mapInArrow(
        choose, "host string, wrapper string, main string, pattern string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``.

    NULL html is empty; a page without main text gives an empty text. Pages whose URL is NULL
    or has no host are read as of one host. Repeated rows and NULL ids stay; other columns
    are ignored; an empty table gives no rows. Hosts' wrappers are written first, so that
    their true size decides whether Spark broadcasts them.
    """
    spark = pages.sparkSession
    path = common.shared_dir(spark, "wrappers")
    made = wrappers(pages, url_col, html_col)
    made.write.parquet(path)
    known = spark.read.schema(made.schema).parquet(path).select("host", "wrapper", "main")
    rows = pages.select(
        F.col(id_col), F.col(url_col), host(F.col(url_col).cast("string")).alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list[Item]] = {}
        for batch in batches:
            out = []
            for page, wrapper, main in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if wrapper is not None and wrapper not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[wrapper] = json.loads(wrapper)
                out.append(main_text(page, parsed.get(wrapper), main))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.join(known, "host", "left").select(
        id_col, url_col, "html", "wrapper", "main").mapInArrow(run, StructType([
            StructField(id_col, pages.schema[id_col].dataType),
            StructField(url_col, pages.schema[url_col].dataType),
            StructField("text", StringType()), StructField("n_chars", LongType())]))
