"""Main text of web pages by wrappers inferred from pages of the same host.

A page is read as a tree of token streams. The wrapper of a host is a union-free regular
expression over such streams: the distinct shapes of all its pages are aligned one after
another; equal siblings in a row become a repeated group, what one page lacks becomes optional.
How many pages say a text in a group is counted: texts that differ become slots and texts that
agree stay template. The wrapper names the part of the page that holds the article and the
template texts in it; the slots of that part are the text.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.url_filters import parts
from tablescout.session import cut

BUCKETS = 256  # shares of a host's shapes that are aligned apart before the whole
TEMPLATE_PAGES = 3  # pages that must agree on a text, and differ elsewhere, to make it template

# fixed values: element names of the HTML standard by their role here
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea input label fieldset menu dialog map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {  # an open element that a new one ends, unless the second name stands between
    "p": (BLOCK, ()), "li": (frozenset(["li"]), ("ul", "ol")), "dt": (frozenset(["dt", "dd"]), ("dl",)), "dd": (frozenset(["dt", "dd"]), ("dl",)),
    "tr": (frozenset(["tr"]), ("table",)), "td": (frozenset(["td", "th", "tr"]), ("table",)), "th": (frozenset(["td", "th", "tr"]), ("table",)),
    "option": (frozenset(["option"]), ("select",)),
}
# fixed values: words in class, id or role that mark what is no article
MARKS = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie "
    "cookies disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup popover promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar topbar warning widget widgets disclaimer".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<|[^<]+",
                    re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


class Node:
    __slots__ = ("name", "key", "skip", "children")

    def __init__(self, name: str, key: str, skip: bool):
        self.name, self.key, self.skip, self.children = name, key, skip, []


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def _node(tag: str, name: str) -> Node:
    marks, skip = [], name in SKIPPED
    if " " in tag or "\n" in tag or "\t" in tag:
        for kind, a, b, c in _MARK.findall(tag):
            kind, value = kind.lower(), html.unescape(a or b or c)
            if kind == "hidden" or kind == "aria-hidden" and value == "true":
                skip = True
            elif kind in ("class", "id", "role"):
                words = _words(value)
                skip = skip or (name not in ("body", "html", "main", "article") or "comment" in words or "comments" in words) and not MARKS.isdisjoint(words)
                if kind != "id":
                    marks += words
    return Node(name, ".".join([name, *sorted(set(marks))]), skip)


def parse(page: str) -> Node:
    """The page as a tree; unclosed and stray tags are resolved as browsers do for text."""
    root = Node("", "", False)
    open_ = [root]
    for m in _TOKEN.finditer(page):
        token = m.group()
        if token[0] != "<" or token == "<":
            open_[-1].children.append(token)
            continue
        if m.group(1) or token[1] in "!?":
            if m.group(1):
                open_[-1].children.append(" ")
            continue
        name = _NAME.match(token).group(1).lower()
        if token[1] == "/":
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    # an inline end tag does not end a block opened inside it
                    if name in BLOCK or not any(x.name in BLOCK for x in open_[i + 1:]):
                        del open_[i:]
                    break
            continue
        for i in range(len(open_) - 1, 0, -1):
            ends, fence = CLOSED_BY.get(open_[i].name, ((), ()))
            if name in ends:
                del open_[i:]
                break
            if open_[i].name in fence or open_[i].name in BLOCK and open_[i].name not in CLOSED_BY:
                break
        node = _node(token, name)
        open_[-1].children.append(node)
        if name not in VOID and not token.endswith("/>"):
            open_.append(node)
    return root


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


def digest(text: str) -> int:
    """64 bits that stand for a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Pattern:
    """One group of a wrapper: an element with its inner groups and, for one page, its texts."""

    __slots__ = ("key", "repeated", "optional", "inner", "texts")

    def __init__(self, key: str, repeated: bool = False, optional: bool = False):
        self.key, self.repeated, self.optional, self.inner, self.texts = key, repeated, optional, [], set()


def generalise(node: Node) -> Pattern:
    """A page as a pattern: equal neighbours in a row become one repeated group."""
    out = Pattern(node.key)
    for child in node.children:
        if isinstance(child, str):
            text = squeeze(child)
            if text:
                out.texts.add(text)
            continue
        if child.skip:
            continue
        own = generalise(child)
        if out.inner and out.inner[-1].key == own.key:
            out.inner[-1] = merge(out.inner[-1], own)
            out.inner[-1].repeated = True
        else:
            out.inner.append(own)
    return out


def merge(a: Pattern, b: Pattern) -> Pattern:
    """The least union-free pattern of both: what one side lacks becomes optional."""
    out = Pattern(a.key, a.repeated or b.repeated, a.optional or b.optional)
    out.texts = a.texts | b.texts
    # longest common subsequence of the group keys
    n, m = len(a.inner), len(b.inner)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a.inner[i].key == b.inner[j].key else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a.inner[i].key == b.inner[j].key:
            out.inner.append(merge(a.inner[i], b.inner[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.inner.append(a.inner[i])
            out.inner[-1].optional, i = True, i + 1
        else:
            out.inner.append(b.inner[j])
            out.inner[-1].optional, j = True, j + 1
    # groups that came to stand side by side with one key are one repeated group
    folded = []
    for group in out.inner:
        if folded and folded[-1].key == group.key:
            folded[-1] = merge(folded[-1], group)
            folded[-1].repeated = True
        else:
            folded.append(group)
    out.inner = folded
    return out


def _written(pattern: Pattern) -> str:
    """A pattern without its texts: depth, key and marks of its groups, in page order."""
    flat: list = []

    def visit(at: Pattern, depth: int):
        flat.append((depth, at.key, at.repeated + 2 * at.optional))
        for group in at.inner:
            visit(group, depth + 1)

    visit(pattern, 0)
    return json.dumps(flat)


def _read(shape: str) -> Pattern:
    way: list[Pattern] = []
    for depth, key, marks in json.loads(shape):
        group = Pattern(key, bool(marks & 1), bool(marks & 2))
        del way[depth:]
        if way:
            way[-1].inner.append(group)
        way.append(group)
    return way[0]


def _aligned(shapes: list[str]) -> Pattern:
    """The pattern of all shapes, aligned in their order."""
    whole = _read(shapes[0])
    for shape in shapes[1:]:
        whole = merge(whole, _read(shape))
    return whole


def _groups(pattern: Pattern, path: tuple = ()) -> Iterator[tuple[tuple, Pattern]]:
    """Path and group, the whole first."""
    yield path, pattern
    for group in pattern.inner:
        yield from _groups(group, (*path, group.key))


def _of(path: tuple) -> int:
    return digest("\n".join(path))


def learned(page: str) -> tuple[int, str, list[int], list[dict]]:
    """What a page teaches: its whole text and its shape, its groups, the texts of each of them with their length."""
    tree = parse(page)
    pattern = generalise(tree)
    texts: dict[int, set] = {}
    for path, group in _groups(pattern):
        texts.setdefault(_of(path), set()).update(group.texts)
    return (digest("\n".join(blocks(tree, frozenset()))), _written(pattern), list(texts),
            [{"path": p, "text": digest(t), "size": len(t)} for p, own in texts.items() for t in sorted(own)])


def _article(pattern: Pattern, path: tuple = ()) -> tuple | None:
    """Path of the group that is the article by its name, the outermost one."""
    for group in pattern.inner:
        name = group.key.split(".")[0]
        here = (*path, group.key)
        if name in ("article", "main") or "main" in group.key.split(".")[1:]:
            deeper = _article(group, here) if name != "article" else None
            return deeper or here
        found = _article(group, here)
        if found:
            return found
    return None


def _heaviest(pattern: Pattern, own: dict[int, int]) -> tuple:
    """Path of the smallest group that holds nearly all slot text, without that in links.

    ``own``: characters of the slots of each group itself.
    """
    mass: Counter = Counter()
    for at in {p for p, _ in _groups(pattern)}:
        if not any(key.split(".")[0] == "a" for key in at):
            for k in range(len(at) + 1):
                mass[at[:k]] += own.get(_of(at), 0)
    path, total = (), mass[()]
    while True:
        heavy = [g for g in pattern.inner if mass[(*path, g.key)] >= 0.8 * total and g.key.split(".")[0] in BLOCK and not g.repeated]
        if not total or not heavy or heavy[0].key.split(".")[0] in ("p", *HEADINGS):
            return path
        pattern = heavy[0]
        path = (*path, pattern.key)


def _rule(whole: Pattern, sizes: dict[int, int], template: list[dict]) -> str:
    """The wrapper as JSON: the article's path and the template texts in it.

    ``sizes``: characters of the different texts of each group; ``template``: path, text and
    size of those that stand in more than half of the pages that have the group.
    """
    slots = Counter(sizes)
    for t in template:
        slots[t["path"]] -= t["size"]
    path = _article(whole) or _heaviest(whole, slots)
    inside = {_of(p) for p, _ in _groups(whole) if p[:len(path)] == path}
    return json.dumps({"path": list(path), "template": sorted({t["text"] for t in template if t["path"] in inside})})


def wrapper(pages: list[str]) -> str:
    """The wrapper of a few pages of one host, as ``main_text`` learns it from all of them."""
    once = {said: rest for said, *rest in map(learned, pages)}.values()  # copies agree on everything and teach no template
    if not once:
        return json.dumps({"path": [], "template": []})
    have = Counter(p for _, paths, _ in once for p in paths)
    said = Counter((t["path"], t["text"], t["size"]) for _, _, texts in once for t in texts)
    sizes: Counter = Counter()
    for path, _, size in said:
        sizes[path] += size
    template = [{"path": p, "text": t, "size": size} for (p, t, size), n in said.items() if n >= TEMPLATE_PAGES and 2 * n > have[p]]
    return _rule(_aligned(list(dict.fromkeys(shape for shape, _, _ in once))), sizes, template)


def blocks(node: Node, template: frozenset) -> list[str]:
    """Texts of the blocks under a node, in page order, without what is no article.

    Of a header inside an article only the headings count, elsewhere nothing does.
    """
    out, run = [], []
    article = node.name in ("article", "main")

    def flush():
        text = " ".join("".join(run).split())
        if text and not (template and digest(text) in template):
            out.append(text)
        run.clear()

    def visit(at: Node, headings_only: bool, article: bool):
        for child in at.children:
            if isinstance(child, str):
                if not headings_only:
                    run.append(html.unescape(child))
                continue
            if child.skip or child.name == "header" and not article:
                if child.name in BLOCK:
                    flush()
                continue
            if child.name == "br":
                run.append(" ")
                continue
            only = (headings_only or child.name == "header") and child.name not in HEADINGS
            inside = article or child.name in ("article", "main")
            if child.name in BLOCK:
                flush()
                visit(child, only, inside)
                flush()
            else:
                visit(child, only, inside)

    visit(node, False, article)
    flush()
    return out


def _reach(node: Node, path: list[str]) -> list[Node]:
    """Nodes at a wrapper path; groups on the way may repeat or have optional wrapping."""
    if not path:
        return [node]
    found = []
    for child in node.children:
        if isinstance(child, Node) and not child.skip and child.key == path[0]:
            found += _reach(child, path[1:])
    return found


def _named(node: Node) -> list[Node]:
    """Outermost articles or mains of a page that its wrapper does not fit."""
    found = []
    for child in node.children:
        if isinstance(child, Node) and not child.skip:
            found += [child] if child.name in ("article", "main") else _named(child)
    return found


def extract(page: str, wrapper_json: str | None) -> str:
    """The main text: blocks joined by one line feed."""
    tree = parse(page)
    rule = json.loads(wrapper_json) if wrapper_json else {"path": [], "template": []}
    template = frozenset(rule["template"])
    roots = (_reach(tree, rule["path"]) if rule["path"] else []) or _named(tree) or [tree]
    return "\n".join(t for root in roots for t in blocks(root, template))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.int64()), ("size", pa.int32())]))
    for batch in batches:
        said, shape, paths, own = zip(*map(learned, batch.column("html").to_pylist())) if batch.num_rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("place"), pa.array(said, pa.int64()), pa.array(shape, pa.string()),
             pa.array(paths, pa.list_(pa.int64())), pa.array(own, texts)], names=["host", "place", "said", "shape", "paths", "texts"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("shapes").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array([x[0]["place"] for x in lists], pa.int64()),
             pa.array([_written(_aligned([e["shape"] for e in x])) for x in lists], pa.string())], names=["host", "place", "shape"])


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = [_rule(_read(s), {e["path"]: e["size"] for e in sizes or ()}, template or []) for s, sizes, template in zip(
            *(batch.column(c).to_pylist() for c in ("shape", "sizes", "template")))]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rules, pa.string())], names=["host", "wrapper"])


def _wrappers(rows: DataFrame) -> DataFrame:
    """host, wrapper: learned from every page; copies agree on everything and teach no template."""
    pages = rows.filter("html <> ''").select("host", F.xxhash64("url", "html").alias("place"), "html").mapInArrow(
        _learned, "host string, place long, said long, shape string, paths array<long>, texts array<struct<path:long,text:long,size:int>>")
    once = cut(pages.groupBy("host", "said").agg(F.min(F.struct("place", "shape", "paths", "texts")).alias("p")).select("host", "p.*"), "learned")

    def in_order(shapes, *by):  # by the hash of the first page that has a shape
        return shapes.groupBy("host", *by).agg(F.array_sort(F.collect_list(F.struct("place", "shape"))).alias("shapes")).mapInArrow(
            _joined, "host string, place long, shape string")

    shapes = once.groupBy("host", "shape").agg(F.min("place").alias("place")).withColumn("bucket", F.pmod(F.xxhash64("shape"), F.lit(BUCKETS)))
    whole = in_order(in_order(shapes, "bucket"))
    have = once.select("host", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    said = cut(once.select("host", F.inline("texts")).groupBy("host", "path", "text").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), "said")
    sizes = said.groupBy("host", "path").agg(F.sum("size").alias("size"))
    template = said.filter(F.col("n") >= TEMPLATE_PAGES).join(have, ["host", "path"]).filter(F.col("n") * 2 > F.col("pages"))
    return whole.join(sizes.groupBy("host").agg(F.collect_list(F.struct("path", "size")).alias("sizes")), "host", "left").join(
        template.groupBy("host").agg(F.collect_list(F.struct("path", "text", "size")).alias("template")), "host", "left").select(
        "host", "shape", "sizes", "template").mapInArrow(_rules, "host string, wrapper string")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p, w) if p else "" for p, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of ``pages``.

    All pages of a host make its wrapper: each distinct shape is aligned, each text of a group
    is counted over the pages that have the group, as rows per host, group and text, so a host
    may hold any share of all rows.
    White space inside a block is one space, blocks are joined by one line feed, character
    references are decoded; ``n_chars`` counts code points.

    A null or empty html, or one without article text, gives an empty text. A null URL
    belongs to the empty host. A page that its wrapper does not fit is read by its own
    article or main element, else as a whole. Null ids and repeated rows keep their rows;
    other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", parts(F.col("url"))[0])
    wrappers = cut(_wrappers(rows), "wrappers")
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")
