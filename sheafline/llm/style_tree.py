"""Main text of pages by a site style tree.

The DOMs of a host's pages are merged by tag path and class. A node's importance has two parts, both
entropies with the number of pages that have the node as the base of the logarithm: how much its
presentation (the sequence of its children) varies between pages, and how little its contents are
spread over pages: a content that stands on one page has entropy 0, one that stands on all has 1.
Generic branches of low importance are removed from every page, unless they hold most of it. The same
entropy is taken of every single content, by its node and text: a block of any element, paragraphs and
headings of the article included, that stands on nearly all distinct pages with its node is removed.

Some branches say themselves what they are: navigation, footers, forms, adverts, comments and the
like are recognised by tag, role or class name and count as presentation of no importance, which is
all there is to go by on hosts with few pages. A branch that is only named so by a class, an id, <form>
or <header> stays if it holds most of the page, which is then judged by what is marked inside it. Pages with equal text count once in the tree, so
copies of an article do not make it look like a template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import materialize, ship_package

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe svg math object canvas audio video textarea title nav footer aside "
    "form button select option optgroup datalist dialog menu search".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"},
}
SCOPES = frozenset("table td th ul ol dl article section div aside nav main body html".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split()
)
#: Text in these is not prose; a form with mostly such text or one field in so many characters is a form.
CONTROLS = frozenset("a button label legend option select".split())
FIELDS = frozenset("input select textarea button".split())
FIELD_CHARS = 40
#: Words of class names and ids that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar pagination pager "
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing related recommended recommendations comment comments disqus reply replies respond widget "
    "widgets copyright disclaimer search form".split()
)
#: Only these are removed as a branch for their importance: the branch of a text element has the unique
#: contents of its neighbours with the same path. Its repeated contents are removed one by one.
GENERIC = frozenset("div section span ul ol dl table header figure details center".split())

LEAST_IMPORTANCE, LEAST_PAGES, CONTENT_PART = 0.2, 8, 0.9

_TOKEN = re.compile(
    # a tag that never closes ends where the next one starts, so no text is scanned from every "<" to its end
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/<>]*+(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>", re.DOTALL
)
_CUT_TAG = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MARK_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Node:
    """An element of a page."""

    tag: str
    sign: str
    parent: int
    key: int
    dropped: bool = False
    named: bool = False  # dropped by a name, <form> or <header> alone
    marked: bool = False  # has a word of MARKS
    main: bool = False
    children: list[str] = field(default_factory=list)
    chars: int = 0
    control_chars: int = 0
    fields: int = 0
    block: int = 0  # the element itself or the block element around it


@dataclass(slots=True)
class Block:
    """White-space-normalised text between two block borders; ``owner`` is its block element and
    ``pieces`` the (element, text) runs it is made of."""

    owner: int
    pieces: list[tuple[int, str]]

    def text(self, gone: set[int] | None = None) -> str:
        runs = self.pieces if gone is None else [p for p in self.pieces if p[0] not in gone]
        return " ".join("".join(t for _, t in runs).split())


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) >> 1


def parse(page: str | None) -> tuple[list[Node], list[Block]]:
    """Elements (the first is the root) and blocks of a page; unclosed and cut tags are tolerated."""
    page = page or ""
    nodes = [Node("#root", "#root", -1, 0)]
    stack = [0]
    blocks: list[Block] = []
    run: list[tuple[int, str]] = []

    opened: Counter[str] = Counter()  # elements of the stack by tag

    def flush() -> None:
        if run:
            if any(not t.isspace() for _, t in run):
                blocks.append(Block(nodes[stack[-1]].block, run[:]))
            run.clear()

    def text(raw: str) -> None:
        if raw:
            run.append((stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def close(names: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        if not any(opened[n] for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in names:
                if any(nodes[k].tag in BLOCKS for k in stack[depth:]):
                    flush()
                opened.subtract(nodes[k].tag for k in stack[depth:])
                del stack[depth:]
                return
            if tag in scopes:
                return

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if not found:
            rest = page[at:]
            cut = _CUT_TAG.search(rest)
            text(rest[: cut.start()] if cut else rest)
            break
        text(page[at : found.start()])
        token, at = found.group(), found.end()
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag == "br":
                text(" ")
            elif tag not in VOID:
                close({tag}, frozenset())
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            if nodes[stack[-1]].tag != "#root":
                close({"p"}, frozenset({"table", "td", "th", "button"}))
            flush()
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag])
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(token, len(tag) + 1)}
        classes = " ".join(sorted(set(values.get("class", "").split())))
        sign = f"{tag}.{classes}"
        parent = nodes[stack[-1]]
        node = Node(tag, sign, stack[-1], _hash(parent.key, sign))
        parent.children.append(sign)
        words = {w.lower() for w in _MARK_WORD.findall(f"{values.get('class', '')} {values.get('id', '')}")}
        node.marked = tag not in ("html", "body", "main") and not words.isdisjoint(MARKS)
        role = values.get("role", "").lower()
        node.main = tag in ("article", "main") or role == "main" or parent.main
        node.dropped = (
            (tag in DROPPED and tag != "form")
            or role in DROPPED_ROLES
            or values.get("aria-hidden", "").lower() == "true"
            or bool(_HIDDEN.search(values.get("style", "")))
            or "hidden" in values
        )
        if not node.dropped:
            node.dropped = node.named = (
                tag == "form"
                or node.marked
                or ((tag == "header" or "header" in words) and not parent.main)
            )
        if node.dropped and (tag == "article" or role == "main"):
            node.main = parent.main
        node.fields = int(tag in FIELDS and values.get("type", "").lower() != "hidden")
        node.block = len(nodes) if tag in BLOCKS else parent.block
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in VOID and not (token.endswith("/>") and tag not in BLOCKS):
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    flush()
    for block in blocks:
        for element, piece in block.pieces:
            nodes[element].chars += len(piece)
    for node in reversed(nodes):  # an element comes after the one around it
        if node.tag in CONTROLS:
            node.control_chars = node.chars
        if node.parent >= 0:
            nodes[node.parent].chars += node.chars
            nodes[node.parent].control_chars += node.control_chars
    # fields count for the form around them
    forms: list[int] = []
    for k, node in enumerate(nodes):
        inner = node.parent if node.parent < 0 else forms[node.parent]
        forms.append(k if node.tag == "form" else inner)
        if node.fields and inner >= 0 and inner != k:
            nodes[inner].fields += node.fields
    for node in nodes:
        if node.tag == "form" and node.named and not node.marked:
            prose = node.chars - node.control_chars
            node.dropped = node.named = (
                4 * node.chars <= nodes[0].chars or 2 * prose <= node.chars or prose < FIELD_CHARS * node.fields
            )
    return nodes, blocks


def removed(nodes: list[Node], low: frozenset[int] = frozenset()) -> set[int]:
    """Elements whose branch is not part of the article; ``low`` are keys of low importance.

    A marked branch that holds most of the page's text and its article stays. One that is only named
    as something else also stays on a page without an article, unless it is mostly links and controls.
    An article inside a marked branch that does not hold most of the text is none.
    """
    half = nodes[0].chars / 2
    holds, inside = [False] * len(nodes), [False] * len(nodes)
    for k, node in enumerate(nodes[1:], 1):
        inside[k] = inside[node.parent] or (node.dropped and node.chars <= half)
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag in ("article", "main") and not nodes[k].dropped and not inside[k] and nodes[k].chars:
            holds[k] = True
        if holds[k]:
            holds[nodes[k].parent] = True
    gone: set[int] = set()
    for k, node in enumerate(nodes[1:], 1):
        prose = node.named and not holds[0] and 2 * node.control_chars <= node.chars
        marked = node.dropped and not (node.chars > half and (holds[k] or prose))
        template = node.key in low and node.tag in GENERIC and node.chars <= half
        if marked or template or node.parent in gone:
            gone.add(k)
    return gone


def content_key(nodes: list[Node], block: Block) -> int:
    """A block's content in the style tree: its text under its node's path."""
    return _hash(nodes[block.owner].key, block.text())


def main_text(
    page: str | None,
    low: frozenset[int] = frozenset(),
    repeated: frozenset[int] = frozenset(),
) -> str:
    """The article's blocks, one per line; the blocks of <article> or <main> if they have text.

    Blocks whose :func:`content_key` is in ``repeated`` are left out, unless they are most of the text:
    the page is then a near copy of others (a mirror, a press release, a version), at any number of
    pages of the host.
    """
    nodes, blocks = parse(page)
    gone = removed(nodes, low)
    kept = [(nodes[b.owner].main, t, b) for b in blocks if b.owner not in gone and (t := b.text(gone))]
    if any(main for main, _, _ in kept):
        kept = [x for x in kept if x[0]]
    if repeated:
        own = [x for x in kept if content_key(nodes, x[2]) not in repeated]
        chars = sum(len(t) for _, t, _ in own)
        if 2 * chars >= sum(len(t) for _, t, _ in kept):
            kept = own
    return "\n".join(t for _, t, _ in kept)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page adds to its host's tree: its nodes, their presentations and their contents."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            hosts, kinds, keys, values, pages, above = [], [], [], [], [], []
            part = batch.slice(start, 256)
            for url, page in zip(part.column(0), part.column(1)):
                host = host_of(url.as_py())
                nodes, blocks = parse(page.as_py())
                gone = removed(nodes)
                digest = _hash("\n".join(b.text(gone) for b in blocks if b.owner not in gone))
                rows: dict[tuple, list[int] | None] = {}
                for node in nodes:
                    if node.tag in BLOCKS:
                        rows["style", node.key, _hash(*dict.fromkeys(node.children))] = None
                rows["node", 0, 0] = None  # counts the host's pages
                for block in blocks:
                    t, chain, k = block.text(), [], block.owner
                    while k > 0:
                        if nodes[k].tag in BLOCKS:
                            chain.append(nodes[k].key)
                        k = nodes[k].parent
                    if t:
                        rows["node", nodes[block.owner].key, 0] = None
                        rows["text", nodes[block.owner].key, content_key(nodes, block)] = chain
                for (kind, key, value), chain in rows.items():
                    hosts.append(host)
                    kinds.append(kind)
                    keys.append(key)
                    values.append(value)
                    pages.append(digest)
                    above.append(chain)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hosts, pa.string()),
                    pa.array(kinds, pa.string()),
                    pa.array(keys, pa.int64()),
                    pa.array(values, pa.int64()),
                    pa.array(pages, pa.int64()),
                    pa.array(above, pa.list_(pa.int64())),
                ],
                names=["host", "kind", "key", "value", "page", "above"],
            )


def counted_facts(pages: DataFrame) -> DataFrame:
    """host, kind, key, value, n, above: on how many distinct page texts of the host a node has a
    presentation, a content, or (kind node) any content; written.

    Grouped by (host, node, value), so a host that holds most pages is spread over all tasks.
    """
    ship_package(pages.sparkSession)
    facts = pages.select("url", "html").mapInArrow(
        _facts, "host string, kind string, key long, value long, page long, above array<long>"
    )
    return materialize(
        facts.groupBy("host", "kind", "key", "value", "page")
        .agg(F.first("above").alias("above"))
        .groupBy("host", "kind", "key", "value")
        .agg(F.count("*").alias("n"), F.first("above").alias("above"))
    )


def importance(counted: DataFrame) -> DataFrame:
    """host, key, pages, importance of the block elements of every host's style tree.

    A leaf's contents count for all block elements above it.
    """
    log_n = F.log(F.col("n").cast("double"))
    styles = counted.filter("kind = 'style'").groupBy("host", "key").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * log_n).alias("n_log_n")
    )
    # entropy with base m of shares n / sum(n)
    total = F.col("pages").cast("double")
    base = F.log(F.greatest(total, F.lit(2.0)))
    styles = styles.withColumn("presentation", (F.log(total) - F.col("n_log_n") / total) / base)
    contents = (
        counted.filter("kind = 'text'")
        .groupBy("host", "key")
        .agg(F.count("*").alias("features"), F.sum(log_n).alias("spread"), F.first("above").alias("above"))
        .select("host", F.explode("above").alias("key"), "features", "spread")
        .groupBy("host", "key")
        .agg(F.sum("features").alias("features"), F.sum("spread").alias("spread"))
    )
    content = 1 - F.col("spread") / F.col("features") / base
    return styles.join(contents, ["host", "key"]).select(
        "host",
        "key",
        "pages",
        (CONTENT_PART * content + (1 - CONTENT_PART) * F.col("presentation")).alias("importance"),
    )


def repeated_contents(counted: DataFrame) -> DataFrame:
    """host, content, host_pages of the contents of low importance.

    A content on n of the m distinct pages that have its node has importance 1 - log n / log m. It is
    low on two pages of two, six of eight, 40 of 100. At least the square root of the host's pages
    must have it, so a node of few pages of a large host is no template.
    """
    pages = materialize(counted.filter("kind = 'node'").select("host", "key", F.col("n").alias("pages")))
    whole = materialize(pages.filter("key = 0").select("host", F.col("pages").alias("host_pages")))
    low = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("pages").cast("double")) < LEAST_IMPORTANCE
    return (
        counted.filter("kind = 'text' and n > 1")
        .join(pages, ["host", "key"])
        .filter(low)
        .join(whole, "host")
        .filter(F.col("n") >= F.sqrt("host_pages"))
        .select("host", F.col("value").alias("content"), "host_pages")
    )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets: dict[str | None, tuple[frozenset[int], frozenset[int]]] = {}  # a host's lists are read once
            texts = []
            for host, page, low, repeated in zip(*(part.column(c) for c in range(2, 6))):
                if (name := host.as_py()) not in sets:
                    sets[name] = frozenset(low.as_py() or ()), frozenset(repeated.as_py() or ())
                texts.append(main_text(page.as_py(), *sets[name]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages`` (page_id, url, html).

    Null html is empty and has an empty text; pages without a host in the url are one host. Other
    columns are not read, an empty table gives an empty result. The nodes and the contents to remove
    are one short list each per host, joined by their written size.
    """
    counted = counted_facts(pages)
    low = (
        importance(counted)
        .filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("key")).alias("low"))
    )
    repeated = repeated_contents(counted).groupBy("host").agg(
        F.sort_array(F.collect_list("content")).alias("repeated")
    )
    lists = materialize(low.join(repeated, "host", "full"))

    @F.pandas_udf("string")
    def host(urls):
        return urls.map(host_of)

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return (
        plain.withColumn("host", host("url"))
        .join(lists, "host", "left")
        .select("page_id", "url", "host", "html", "low", "repeated")
        .mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
    )
