"""Main-text extraction with site template removal.

Pages are parsed into element subtrees, which are hashed and counted per host in Spark; those that
recur on many pages of their host are a template of the site and are deleted. Copies of a page or
article count as one page. Text blocks inside an article or main element stay, as an article may
repeat a passage; there only whole containers that recur go.

The markup decides where a count can't, as menus, adverts and comments differ from page to page:
elements that are never text of an article go (script, nav, form, aside and so on), and so do those
whose class, id or role says so in whole names ("ad", "comment-list"). A name that only holds such a
word ("search-results", "form-factor"), or one that articles use for text as well ("menu", "widget"), is a
hint: its subtree goes only if it recurs on a second page of the host. What wraps the text is no part of
a site's frame, whatever it is called (see `settle`).
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

from .common import Scratch

# Fixed values of HTML: elements without an end tag, with raw text, and that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body dd dt head html legend li noscript optgroup option summary tbody td tfoot th thead tr".split())
# An open element that a new start tag ends, up to the nearest of its containers.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
# Elements and marks (of class, id and role) that are no part of an article.
OUT = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video map dialog menu search title noembed noframes option".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsors menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside complementary "
    "header masthead footer contentinfo cookie cookies consent notice notices notification alert disclaimer gdpr popup modal overlay form login signup subscribe subscription newsletter search comment comments "
    "respond reply replies disqus discussion related recommended recommendations share sharing social pagination pager toolbar widget widgets skip".split()
)
# Marks that are hints only inside an article.
WEAK = frozenset("menu menubar widget widgets toolbar discussion form search".split())
# Elements among OUT that hold no text of a page, whatever is in them.
HARD = frozenset("head script style noscript template select textarea input iframe object embed svg canvas audio video map title noembed noframes option button".split())
# Words that may stand beside a mark in a name without making it another thing.
BESIDE = frozenset(
    "area bar bars block blocks body bottom box buttons column container content cta inline inner items left links list main module outer page panel post posts primary reader right section site slot stories text thread "
    "this title tools top unit user wrap wrapper".split()
)
# Elements that hold an article's own text, whatever their names say.
TEXT = frozenset("p blockquote pre table figure h1 h2 h3 h4 h5 h6 li dl dd dt td th tr tbody hr img a b i em strong span code q cite sub sup small br".split())
# Marks that an article element itself can have; and names that tell what stands beside an element.
OTHER_ARTICLES = frozenset("ad ads advert advertisement promo sponsored comment comments reply replies related recommended".split())
LAYOUT = re.compile(r"\b(?:has|with|without|no)[-_][\w-]+|\bsidebar[-_](?:left|right|none|layout)\b")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# An attribute's value is quoted or runs to the next space or >; quotes elsewhere are plain characters.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMES = re.compile(r"[a-z0-9]+")
#: A slash that ends an unquoted value is part of it; a tag that the page's end cuts off is no text.
UNQUOTED, CUT_TAG = re.compile(r"=\s*[^\s\"'>][^\s>]*/\Z"), re.compile(r"</?[A-Za-z]")
SPACE = re.compile(r"[ \t\n\r\f]+")
HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
CONTAINERS = frozenset("div section ul ol dl table figure blockquote details center address header hgroup fieldset".split())


class Node:
    """An element: its name, children (nodes and texts), and whether the markup rules it out or hints so."""

    __slots__ = ("name", "kids", "out", "hint", "hash", "main", "named")

    def __init__(self, name: str, out: bool = False, main: bool = False, hint: bool = False, named: bool = False):
        self.name, self.kids, self.out, self.hash, self.main, self.hint, self.named = name, [], out, 0, main, hint, named


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _judged(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is ruled out, whether its names hint at it, and whether names ruled it out."""
    if name in OUT or name == "header" and not in_article:
        return True, False, False
    if not attributes.strip() or name in ("html", "body"):
        return False, False, False
    got = _attributes(attributes)
    if "hidden" in got or got.get("aria-hidden") == "true" or HIDDEN.search(got.get("style", "")):
        return True, False, False
    if in_article and name in TEXT:
        return False, False, False
    given = LAYOUT.sub(" ", " ".join((got.get("class", ""), got.get("id", ""), got.get("role", ""))).lower())
    article = name in ("article", "main")
    marks = OTHER_ARTICLES if article else MARKS - {"header", "masthead"} if in_article else MARKS
    hint = False
    for one in given.split():
        parts = [w for w in (x.rstrip("0123456789") for x in NAMES.findall(one)) if w.isalpha()]
        if found := marks.intersection(parts):
            if marks.union(BESIDE).issuperset(parts) and not (in_article and found <= WEAK):
                return True, False, True
            hint = not article
    return False, hint, False


def _text(node: Node, ruled: bool = False) -> int:
    """Characters of text below a node; without `ruled`, those of elements that are not ruled out."""
    n, work = 0, [node]
    while work:
        for k in work.pop().kids:
            if isinstance(k, str):
                n += len(k.strip())
            elif not k.out or ruled and k.name not in HARD:
                work.append(k)
    return n


def settle(root: Node) -> None:
    """Takes back what was ruled out wrongly, as it wraps the page's text.

    If all article and main elements lie in ruled-out ones and hold more text than the rest of the page, what
    they lie in stays. A page without an article stays when it lies in a form as a whole: a form with more
    text than stands beside it. And names alone never empty a page.
    """
    if _has_main(root):
        return
    mains, forms, named, work = [], [], [], [(root, [])]
    while work:
        n, above = work.pop()
        if n.out and n.name in HARD:
            continue
        if n.main and not n.out:
            mains.append((n, above))
            continue
        if n.out:
            above = [*above, n]
            if n.name == "form" and len(above) == 1:
                forms.append(n)
            if n.named:
                named.append(n)
        work.extend((k, above) for k in reversed(n.kids) if isinstance(k, Node))
    kept = _text(root)
    if mains and sum(_text(m) for m, _ in mains) > kept:
        for _, above in mains:
            for n in above:
                n.out = False
        return
    for n in forms:
        if _text(n) > kept:
            n.out = False
    if not _text(root):
        for n in named:
            n.out = False


def parse(page: str) -> Node:
    """The page's tree. End tags that open nothing are dropped; what is left open ends with the page."""
    root = Node("#root")
    stack, articles, at = [root], 0, 0

    def pop_to(i: int) -> None:
        nonlocal articles
        articles -= sum(n.name in ("article", "main") for n in stack[i:])
        del stack[i:]

    scan, end = TOKEN.search, len(page)
    while at < end:
        m = scan(page, at)
        if not m:
            cut = CUT_TAG.search(page, at)
            stack[-1].kids.append(page[at : cut.start()] if cut else page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    pop_to(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        if name in ENDED_BY:
            ends, stop = ENDED_BY[name]
            cut = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in stop:
                    break
                if stack[i].name in ends:
                    cut = i
            if cut:
                pop_to(cut)
        out, hint, named = _judged(name, m[3], articles > 0)
        node = Node(name, out, name in ("article", "main"), hint, named)
        stack[-1].kids.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            if not node.out:
                node.kids.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif name not in VOID and not (m[3].endswith("/") and not UNQUOTED.search(m[3])):
            articles += node.main
            stack.append(node)
    settle(root)
    return root


def hash_subtrees(node: Node, within: bool = False, found: list | None = None) -> list[tuple[int, bool]]:
    """Hashes of all block subtrees that are not ruled out, with whether a name hints that they are no text."""
    found = [] if found is None else found
    work = [(node, within, False)]
    while work:  # no recursion: pages can nest deeply
        n, inside, done = work.pop()
        if not done:
            work.append((n, inside, True))
            work.extend((k, inside or k.main, False) for k in n.kids if isinstance(k, Node) and not k.out)
            continue
        h = xxhash.xxh64(n.name + "?" * n.hint)
        for k in n.kids:
            if isinstance(k, str):
                if text := SPACE.sub(" ", k).strip(" "):
                    h.update(b"t" + text.encode("utf-8", "surrogatepass") + b"\0")
            elif not k.out:
                h.update(b"n" + k.hash.to_bytes(8, "little"))
        n.hash = h.intdigest()
        if n.name in BLOCKS and n.name not in ("html", "body") and not n.main:
            found.append((n.hash, n.hint))
    return found


def content_hash(root: Node) -> int:
    """Hash of a hashed page's article and main elements, else of the whole page; copies share it."""
    h, found, work = xxhash.xxh64(), False, [root]
    while work:
        n = work.pop()
        if n.main:
            h.update(n.hash.to_bytes(8, "little"))
            found = True
        else:
            work.extend(k for k in reversed(n.kids) if isinstance(k, Node) and not k.out)
    return h.intdigest() if found else root.hash


def blocks(root: Node, template: frozenset[int] | set[int]) -> list[str]:
    """Texts of blocks in page order, without what is ruled out or a template."""
    article = _has_main(root)
    out, parts = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    work: list = [(root, False)]
    while work:
        item, inside = work.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            if inside or not article:
                parts.append(item)
        elif not item.out:
            inside = inside or item.main
            if item.hash in template and not item.main and (not inside or item.name in CONTAINERS) and item.name in BLOCKS:
                end()
                continue
            if item.name in BLOCKS:
                end()
                work.append((None, inside))
            elif item.name == "br":
                parts.append(" ")
            work.extend((k, inside) for k in reversed(item.kids))
    end()
    return out


def _has_main(root: Node) -> bool:
    work = [root]
    while work:
        n = work.pop()
        if n.main:
            return True
        work.extend(k for k in n.kids if isinstance(k, Node) and not k.out)
    return False


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 8, min_share: float = 0.1, min_many: int = 100,
    max_shared: int = 200_000,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A subtree is a template if it recurs on at least `min_pages` pages of its host that are the share
    `min_share` of them or `min_many` by number, and if a name hints at it on two pages; pages whose
    URL has no host share one. So a host of fewer than `min_pages` pages has no templates but those
    that names hint at. Rows of a host with the same
    article and main elements, or the same page where there are none, count as one page. If a page
    has an article or main element, only its text is taken. Null and empty pages have an empty text,
    null ids and URLs stay null. Very long and deep pages are parsed whole, without recursion.
    Repeated rows are extracted one by one. Extra columns are not read; an empty table gives none.

    The templates go to every task if they are at most `max_shared`; beyond that each page gets its
    own by joins on host and hash.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    scratch = Scratch(pages.sparkSession, "templates")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, int, bool]] = set()

        def emit() -> pa.RecordBatch:
            keys = list(seen)
            signed = lambda i: pa.array(np.array([k[i] for k in keys], np.uint64).view(np.int64))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), signed(1), signed(2), pa.array([k[3] for k in keys], pa.bool_())], ["host", "content", "hash", "hint"])

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, root = host_of(url), parse(page or "")
                found = hash_subtrees(root)
                content = content_hash(root)
                seen.add((host, content, 0, False))  # pages of the host
                seen.update((host, content, *f) for f in found)
                if len(seen) > 200_000:
                    yield emit()
        yield emit()

    counts = src.select("url", "html").mapInArrow(count, "host string, content long, hash long, hint boolean").groupBy("host", "hash", "hint").agg(F.count_distinct("content").alias("n"))
    counts = scratch.stage(counts.filter((F.col("hash") == 0) | (F.col("n") >= F.when(F.col("hint"), 2).otherwise(min_pages))), "counts")
    size = counts.filter("hash = 0").select("host", F.col("n").alias("pages"))
    recurs = F.col("hint") | (F.col("n") >= F.least(F.lit(min_share) * F.col("pages"), F.lit(min_many)))
    template = counts.filter("hash <> 0").join(size, "host").filter(recurs).select("host", "hash")
    wanted = template.limit(max_shared + 1).collect()
    known: dict[str, set[int]] | None = None
    if len(wanted) <= max_shared:
        known = {}
        for r in wanted:
            known.setdefault(r["host"], set()).add(r["hash"] & ((1 << 64) - 1))
        rows = src.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        rows = _with_templates(src, template)
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, urls, pages_, own = (batch.slice(at, 500).column(i) for i in range(4))
                texts = []
                for url, page, extra in zip(urls.to_pylist(), pages_.to_pylist(), own.to_pylist(), strict=True):
                    drop = known.get(host_of(url), frozenset()) if known is not None else {h & ((1 << 64) - 1) for h in extra or ()}
                    root = parse(page or "")
                    if drop:
                        hash_subtrees(root)
                    texts.append("\n".join(blocks(root, drop)))
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def _with_templates(src: DataFrame, template: DataFrame) -> DataFrame:
    """The pages, each with the templates among its own subtrees."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host_of(u), page or "", u) for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            keys = [{h for h, _ in hash_subtrees(parse(page))} for _, page, _ in rows]
            flat = [(host, url, xxhash.xxh64_intdigest(page), h) for (host, page, url), found in zip(rows, keys, strict=True) for h in found]
            for at in range(0, len(flat), 50_000):
                part = flat[at : at + 50_000]
                signed = lambda i: pa.array(np.array([x[i] for x in part], np.uint64).view(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.string()), signed(2), signed(3)], ["host", "url", "page", "hash"])

    mine = src.select("url", "html").mapInArrow(own, "host string, url string, page long, hash long").distinct()
    mine = mine.join(template, ["host", "hash"]).groupBy("url", "page").agg(F.collect_set("hash").alias("own"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pa.array(np.array([xxhash.xxh64_intdigest(p or "") for p in batch.column(2).to_pylist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, key], ["page_id", "url", "html", "page"])

    left = src.mapInArrow(keyed, "page_id long, url string, html string, page long").alias("a")
    return left.join(mine.alias("b"), F.col("a.url").eqNullSafe(F.col("b.url")) & (F.col("a.page") == F.col("b.page")), "left").select("page_id", "a.url", "html", "own")
