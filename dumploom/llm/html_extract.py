"""Main-text extraction by consensus host paths.

Pages of one host share templates. Each page looks for the container with the most text that is
neither furniture (menus, adverts, comments) nor links, an article counting half more, goes inwards
while nothing but furniture and links stays outside, and votes for the generalised tag-class path
of what it finds: tags with their classes, numbers in classes made alike. A word in a class marks
furniture only where the element holds at most half of the page's prose. Pages also name the text at each
of their paths; where most of a host's different pages that have a path say the same there, three at least, its text
is the template's and is left out, unless it is over half of a page's. Spark sums the votes of
a host; every page is then read again, where it stands, and its text is taken from the elements at the
winning path, or from its own best container where it has none there. Headings and paragraphs that stand beside
such an element, in a container inside the body, are taken with it.

Edge cases: null or empty html gives an empty text of 0 characters; a null or relative url has
no host, and such a page uses its own best container; unclosed and cut-off markup is read as far
as it goes; character references are decoded once; repeated rows each get a row; very long pages are
read whole, one at a time; no rows: none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import arrow_map, materialize, schema_of

#: Elements whose text is never part of an article.
FURNITURE = frozenset("nav footer aside form button select option textarea label dialog menu head title noscript template iframe object svg canvas audio video".split())
#: Elements whose content is not markup.
RAW = frozenset("script style".split())
#: Words that, in a class, id or role, mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer comment comments respond disqus discussion notice notices notification cookie cookies consent gdpr alert popup modal overlay "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager tags skip complementary contentinfo".split()
)
#: With one of these words beside it, "header" means an article's own.
OWN = frozenset("entry post article story".split())
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption pre figure figcaption header hgroup address hr details summary fieldset".split()
) | FURNITURE
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Start tags that close an open element of the same kind.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
ARTICLES = frozenset(("article", "main"))

MOST_BROADCAST = 16 << 20  # characters of hosts' paths that are broadcast
REPEATED = 3  # different pages of a host that say the same at a path, at least
SALTS = 16  # tasks over which a host's pages are dealt where there are more

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Node:
    tag: str
    path: str
    parent: Node | None
    furniture: bool  # by its tag, or an outer one's; after parsing, by class too
    marked: bool = False  # as furniture, by a word in class, id or role
    prose: int = 0  # characters under it in blocks that are not mostly links, marked elements' too
    good: int = 0  # characters under it in blocks that are not mostly links
    links: int = 0  # characters under it in blocks that are; furniture counts in neither
    loose: int = 0  # of ``good``, what is in no container inside it
    text: int = 0  # ``good`` without lists of links
    children: list[Node] = field(default_factory=list)


def _names(attributes: str) -> tuple[list[str], bool]:
    """The classes, numbers generalised, and whether class, id or role mark furniture."""
    classes, marked = [], False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        words = set(re.split(r"[^a-z]+", value))
        marked |= not MARKS.isdisjoint(words - {"header"} if words & OWN else words)
        if m[1].lower() == "class":
            classes += [re.sub(r"\d+", "#", x) for x in value.split()]
    return sorted(set(classes)), marked


def parse(html: str):
    """(nodes in page order, the first stands for the page, blocks): a block is its node and its text, white space made single."""
    root = Node("", "", None, False)
    stack, nodes, blocks, prose, text, at, links = [root], [root], [], [], [], 0, 0

    def flush():
        if text:
            line = " ".join(unescape("".join(t for t, _ in text)).split())
            if line:
                linked = sum(len(t) for t, is_link in text if is_link)
                blocks.append((stack[-1], line))
                prose.append(2 * linked < len(line))
            text.clear()

    for m in iter(lambda: _TAG.search(html, at), None):
        if m.start() > at:
            text.append((html[at : m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            text.append((" ", False))
        if tag not in BLOCKS:
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if stack[-1].tag == "p":  # a paragraph holds no other block
            stack.pop()
        if stack[-1].tag in SELF_CLOSING.get(tag, ()):
            stack.pop()
        if tag in VOID:
            continue
        classes, marked = _names(m[3] or "")
        up = stack[-1]
        header = tag == "header" and not any(n.tag in ARTICLES for n in stack) and not any(OWN.intersection(re.split("[^a-z]+", c)) for c in classes)
        node = Node(tag, f"{up.path}/{'.'.join([tag, *classes])}", up, up.furniture or tag in FURNITURE or header, marked and tag not in ("html", "body", *ARTICLES))
        up.children.append(node)
        nodes.append(node)
        stack.append(node)
    if at < len(html):
        text.append((html[at:], links > 0))
    flush()
    _weigh(nodes, blocks, prose)
    return nodes, blocks


def _weigh(nodes: list[Node], blocks: list[tuple[Node, str]], prose: list[bool]) -> None:
    """Decide what is furniture, and sum up what the nodes hold."""
    for (node, line), good in zip(blocks, prose, strict=True):
        while good and node is not None and not node.furniture:
            node.prose += len(line)
            node = node.parent
    for node in nodes[1:]:  # outer ones first
        node.furniture |= node.parent.furniture or (node.marked and 2 * node.prose <= nodes[0].prose)
    for (node, line), good in zip(blocks, prose, strict=True):
        if good and not node.furniture:
            _container(node).loose += len(line)
        while node is not None and not node.furniture:
            node.good += len(line) if good else 0
            node.links += 0 if good else len(line)
            node = node.parent


def _container(node: Node) -> Node:
    """The innermost container around ``node`` or itself, at last the page."""
    while node.parent is not None and node.tag not in CONTAINERS:
        node = node.parent
    return node


def _whole(node: Node) -> Node:
    """``node``, or a container around it, inside the body, in which headings and paragraphs stand beside it."""
    around = node
    while around.parent is not None:
        around = _container(around.parent)
        if around.tag in ("", "html", "body") or around.furniture:
            break
        if around.loose:
            node = around
    return node


def _lists_links(node: Node, good: int) -> bool:
    """Whether it is mostly links and holds less than a tenth of the page's ``good``."""
    return node.tag in CONTAINERS and node.links > node.good and node.good < 0.1 * good


def best_container(nodes: list[Node]) -> Node:
    """The container of most text; then inwards, while all of it is in one child."""
    for n in reversed(nodes):  # children first
        held = [c for c in n.children if not c.furniture]
        n.text = n.good - sum(c.good if _lists_links(c, nodes[0].good) else c.good - c.text for c in held)
    fit = [n for n in nodes if (n.tag in CONTAINERS or n.parent is None) and not n.furniture]
    top = at = _whole(max(fit, key=lambda n: n.text * (1.5 if n.tag in ARTICLES else 1.0)))
    while at := next((c for c in at.children if 0 < c.text == at.text and not c.furniture), None):
        top = at if at.tag in CONTAINERS else top
    return top


def extract(html: str, path: str | None, repeated: list[str] | None = None) -> str:
    """The blocks under the elements at ``path``, or under the page's best container, one a line; without those at ``repeated`` paths, if these hold at most half."""
    nodes, blocks = parse(html)
    inside = {id(_whole(n)) for n in nodes if n.path == path and not n.furniture} if path else set()
    if not inside:
        inside = {id(best_container(nodes))}

    def under(node: Node | None) -> bool:
        while node is not None:
            if id(node) in inside:
                return True
            node = node.parent
        return False

    taken = [(node.path, line) for node, line in blocks if not node.furniture and under(node)]
    template, held, size = set(repeated or ()), defaultdict(int), sum(len(line) for _, line in taken)
    for at, line in taken:
        held[at] += len(line)
    return "\n".join(line for at, line in taken if at not in template or 2 * held[at] > size)


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _digest(lines: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(lines).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _votes(batches):
    """A row for a page's best path, with its vote, and one for each path that has text, with digests of that text and of the page's."""
    for batch in batches:
        out = {k: [] for k in ("host", "path", "vote", "said", "page")}

        def add(*row, out=out):
            for name, v in zip(out, row, strict=True):
                out[name].append(v)

        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host and html:
                nodes, blocks = parse(html)
                best = best_container(nodes)
                if best.good:
                    add(host, best.path, min(1.0, best.good / 500), None, None)
                    at = defaultdict(list)
                    for node, line in blocks:
                        if not node.furniture:
                            at[node.path].append(line)
                    page = _digest([line for lines in at.values() for line in lines])
                    for path, lines in at.items():
                        add(host, path, None, _digest(lines), page)
        yield out


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, the path that its pages' votes favour, and the paths whose text is the template's.

    Longer articles weigh more, ties go to the first path. Copies of a page count once for what is repeated, so that they make nothing the template's.
    """
    cast = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html"))
    rows = arrow_map(cast, _votes, "host string, path string, vote double, said long, page long")
    pages_of = rows.groupBy("host", "path", "said", "page").agg(F.sum("vote").alias("votes"))
    texts = pages_of.groupBy("host", "path", "said").agg(F.sum("votes").alias("votes"), F.count("page").alias("pages"))
    paths = texts.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.max("pages").alias("same"), F.sum("pages").alias("pages"))
    order = F.when(F.col("votes").isNotNull(), F.struct(F.round("votes", 6), F.hash("path"), F.col("path")))
    repeated = F.when((F.col("same") >= REPEATED) & (2 * F.col("same") > F.col("pages")), F.col("path"))
    return paths.groupBy("host").agg(F.max_by("path", order).alias("path"), F.collect_list(repeated).alias("repeated"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, one row a page."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host().alias("host"))
    paths = materialize(winning_paths(pages), "host-paths")
    size = paths.agg(F.sum(F.length("host") + F.length("path") + F.length(F.concat_ws(" ", "repeated")))).first()[0] or 0
    if size <= MOST_BROADCAST:  # pages stay where they are
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:  # the pages of a host are dealt over several tasks
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(paths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "_salt"], "left")
    joined = joined.select("page_id", "url", "html", "path", "repeated")

    def run(batches):
        for batch in batches:
            texts = [extract(h, p, r) if h else "" for h, p, r in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "repeated")), strict=True)]
            yield {c: batch.column(c) for c in ("page_id", "url", "path")} | {"text": texts, "n_chars": [len(t) for t in texts]}

    kind = schema_of(joined, ["page_id", "url"], "text string, n_chars long, path string")
    return arrow_map(joined, run, kind)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
