"""Main text of HTML pages by site style trees.

The pages of a host are merged into one style tree before any name is looked at. Its nodes are the block
elements, each known by its path from the root (tag, classes, id). A node has, over the pages m that have it,

* presentations: the sequence of its children, p_i the share of the pages with the i-th one. Its presentation
  importance is their entropy in bits: 0 for a template, more the freer the form;
* contents: the whole text of its branch, so what its descendants hold is passed up. Their entropy by log m is
  the content importance: 1 if each page says something else, 0 if all say the same;
* share: the part of the page's characters that its branch holds, on average.

Estimates are drawn to importance 1 by ``PRIOR`` pages, so that few pages decide little. A branch is cut from each page

* wherever it stands, if its content importance is under ``LEAST``: all pages repeat it;
* if content importance times share is under ``LEAST`` and each node above is a template. What lies within a node of
  ``FREE_FORM`` bits or more is written text, whose short parts (a heading, a caption) are not slots of a template.

A text goes by itself if ``NEARLY_ALL`` of its node's pages repeat it, one page more than there are taken to lack it.
Pages whose longest texts, ``BULK`` of their characters together, are equal count as one, so copies of a page make
nothing repeated.

Entropy can't tell readers' comments from an article, and hosts of a few pages decide nothing. So names (tag, role,
class, id) come second: from what the tree leaves, elements go that say menu, header, footer, sidebar, notice, advert,
form or comments; where only a part of a name does, a main in the element stands, and so does an article with most of
the page's text. An element that says article or main is no slot of a template, and what stands outside of it on a page
that has one is not the article. With ``by_name`` false the tree decides alone.

Plan: one pass parses pages and emits the hashes of their nodes and texts, of which one list for each distinct page is
kept and counted with partial aggregation; the decisions, 9 bytes a node, go to the tasks if there are at most
``DECISIONS``, and a second pass cuts the pages. With more, the nodes of the pages are joined with their decisions
(salted), and each page gets its own as a list. No host is ever gathered in a task.

Defined cases: null html is the empty page, whose text is empty; a page without url or host belongs to the host "" ;
ids may be null or repeated (one result row per row, repeated rows too); texts that tie in length count in order of
their hash; pages of any length and depth are read whole, with memory in proportion to their length; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, shared_dir

#: Decisions up to which they are sent to every task (9 bytes each), and salts of their join beyond it.
DECISIONS, SALTS = 1_000_000, 16
#: Importance under which a branch is cut, and the pages of importance 1 that each node is taken to have besides its own.
LEAST, PRIOR = 0.08, 0.5
#: Bits of presentation from which a node is written text and no template.
FREE_FORM = 2.0
#: Share of its node's pages from which a text is repeated on nearly all of them.
NEARLY_ALL = 0.9
#: Part of a page's characters whose texts make it the same page as another one.
BULK = 0.9
#: What is decided of a node or text: its branch is repeated, it is a slot of little content, it has free form; the text is repeated.
REPEATED, SLOT, FREE, TEXT = 1, 2, 4, 8

# Elements by kind, and words in role, class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu search fieldset label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status tablist".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice "
    "notices notification notifications alert alerts popup modal overlay sidebar sidenav rail widget widgets related recommended recommendations "
    "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar comment comments "
    "respond discussion disqus replies reply share sharing social subscribe subscription newsletter signup login searchbox toolbar skiplink "
    "copyright disclaimer outbrain taboola".split()
)
NEGATIONS = frozenset("no has with without not".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_ROLES = frozenset("main article".split())
MAIN_WORDS = frozenset(
    "article content main maincontent main-content content-main post post-content post-body entry entry-content story story-body article-body article-content articlebody".split()
)

_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def _hash(data: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"), seed)


def _pair(a: int, b: int) -> int:
    """A signed 64-bit key of two hashes."""
    return _signed(xxhash.xxh64_intdigest((a & _MASK).to_bytes(8, "little") + (b & _MASK).to_bytes(8, "little")))


def _signed(value: int) -> int:
    value &= _MASK
    return value - (1 << 64) if value >> 63 else value


class _Node:
    """An element. Blocks are nodes of the tree: path (hash), style (hash of its children), and the blocks first to last."""

    __slots__ = ("dropped", "first", "heading", "hint", "holder", "last", "main", "out", "part", "path", "place", "soft", "style", "tag", "up", "weak")

    def __init__(self, tag: str, above: _Node | None, attributes: str, by_name: bool):
        self.tag, self.style, self.place, self.first, self.last = tag, 1, -1, 0, -1
        found = {}
        if len(attributes) > 1 and "=" in attributes or " hidden" in attributes.lower():
            for name, *values in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), next((v for v in values if v), ""))
        classes, ident, role = found.get("class", ""), found.get("id", ""), found.get("role", "").lower()
        key = tag
        if classes:
            key += "." + ".".join(sorted(_DIGITS.sub("", c) for c in classes.split()))
        if ident:
            key += "#" + _DIGITS.sub("", ident)
        self.path = _hash(key, above.path if above else 0)
        self.holder = self if above is None or tag in BLOCK else above.holder
        self.up = above.holder if above else None
        if above and above.holder is above:
            above.style = (above.style * _STEP + self.path) & _MASK
        self.dropped = above.dropped if above else False
        self.out = above.out if above else False  # within an inline element that is dropped
        self.part = above.part if above else False  # within an element that a part of its class or id drops
        self.weak = above.weak if above else False  # within an <article> that would lift such a drop
        self.main = above.main if above else False  # within <article> or <main>
        self.hint = above.hint if above else False  # within an element whose class or id says so
        self.soft = above.soft if above else False  # within a header of the article: headings only
        self.heading = (above.heading if above else False) or tag in HEADINGS
        if not by_name or self.dropped or tag in ("html", "body"):
            return
        tokens = f"{classes} {ident}".split()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").lower().replace(" ", "")
        says = says_noise(tokens, tag) if tag != "main" else 0
        if tag in NOISE_TAGS or role in NOISE_ROLES or hidden or says == WHOLE:
            self.dropped = True
            self.out = self.out or self.holder is not self
        elif says == PART and role not in MAIN_ROLES:
            self.part, self.weak = True, False
        elif tag == "header":
            self.dropped = not (self.main or self.hint)
            self.soft = True
        elif tag in MAIN_TAGS or role in MAIN_ROLES:
            # A layout's wrapper is named for the sidebar beside the article: a main in it stands, an article may.
            self.weak = (self.part or self.weak) and tag != "main" and role != "main"
            self.main, self.part = True, False
        elif tag in ("div", "section", "td") and any(t.lower() in MAIN_WORDS for t in tokens):
            self.hint = True


#: How a class or id names noise: by one of its parts, or as it is.
PART, WHOLE = 1, 2


def says_noise(tokens: list[str], tag: str) -> int:
    """Whether a class or id names a part of the page that is not its article (0, PART or WHOLE); a heading may be called header."""
    says = 0
    for token in tokens:
        if tag in HEADINGS and token.lower() == "header":
            continue
        if token.lower() in NOISE_WORDS:
            return WHOLE
        if tag not in MAIN_TAGS:
            parts = [p.lower() for p in _PART.split(token)]
            parts = parts[: next((i for i, p in enumerate(parts) if p in NEGATIONS), len(parts))]  # what it has is not what it is
            if any(p in NOISE_WORDS for p in parts) and not any(p in MAIN_WORDS for p in parts[:1]):
                says = PART
            if len(parts) > 1 and parts[0] in MAIN_WORDS and any(p in NOISE_WORDS - {"header"} for p in parts[1:]):
                says = PART
    return says


class Block:
    """One block of text and its node."""

    __slots__ = ("dropped", "main", "node", "text", "weak")

    def __init__(self, node: _Node, text: str):
        self.node, self.text = node, text
        self.dropped = node.dropped or node.part or (node.soft and not node.heading)
        self.main, self.weak = node.main, node.weak


def parse(page: str | None, by_name: bool = True) -> tuple[list[_Node], list[Block]]:
    """The nodes of a page and its blocks in order, text decoded and white space in it made one space."""
    page = page or ""
    root = _Node("html", None, "", by_name)
    root.place = 0
    stack, nodes, blocks = [root], [root], []
    there: Counter[str] = Counter()  # open elements by tag
    pieces: list[str] = []
    holder = root

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(holder, text))
            pieces.clear()

    def add(raw: str) -> None:
        nonlocal holder
        if stack[-1].out:
            return
        if not pieces:
            if not raw.strip():
                return
            holder = stack[-1].holder
        pieces.append(html_lib.unescape(raw) if "&" in raw else raw)

    def close(at: int) -> None:
        """Ends the elements of the stack from place at on."""
        for n in stack[at:]:
            n.last = len(blocks)
            there[n.tag] -= 1
        del stack[at:]

    at, size = 0, len(page)
    search = _TAG.search
    while at < size:
        m = search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue  # comment, doctype, CDATA
        name = name.lower()
        if m[1]:
            if name == "br":
                pieces and pieces.append(" ")
                continue
            if name in BLOCK:
                flush()
            if name not in VOID and there[name]:
                i = len(stack) - 1
                while stack[i].tag != name:
                    i -= 1
                close(i)
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                flush()
            elif pieces:
                pieces.append(" ")
            continue
        if name in VOID or name == "html":
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if name in ("svg", "math") and m[3].rstrip(">").endswith("/"):
                continue
            at = end.end() if end else size
            continue
        if name in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
            if name in CLOSED_BY:
                closed, bounds = CLOSED_BY[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closed:
                        close(i)
                        break
                    if stack[i].tag in bounds:
                        break
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
        node = _Node(name, stack[-1], m[3], by_name)
        node.first = len(blocks)
        if name in BLOCK:
            node.place = len(nodes)
            nodes.append(node)
        if not m[3].endswith("/>") or name in BLOCK or name == "a":
            stack.append(node)
            there[name] += 1
    flush()
    there["html"] += 1
    close(0)
    return nodes, blocks


def standing(blocks: list[Block]) -> list[Block]:
    """Blocks that may be the article by their names: without noise elements, and of the page's article if it has one.

    An <article> within an element that is dropped by a part of its name counts if it has most of the text.
    """
    left = [b for b in blocks if not b.dropped]
    weak = [b for b in left if b.weak]
    if weak:
        rest = standing([b for b in left if not b.weak])
        if sum(len(b.text) for b in weak) <= sum(len(b.text) for b in rest):
            return rest
    return [b for b in left if b.main] or left


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


def _key(*parts: str) -> int:
    value = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


class Tree:
    """The nodes and texts of one page as its host's style tree knows them."""

    def __init__(self, host: int, nodes: list[_Node], blocks: list[Block]):
        self.names = [_pair(host, n.path) for n in nodes]
        lengths = [len(b.text) for b in blocks]
        hashes = [_hash(b.text) for b in blocks]
        self.size = sum(lengths)
        self.texts = [_pair(self.names[b.node.place], h) for b, h in zip(blocks, hashes, strict=True)]
        # Sums and hashes of the blocks before each one give those of any branch, which is a run of blocks.
        chars, runs = [0], [0]
        for length, text in zip(lengths, hashes, strict=True):
            chars.append(chars[-1] + length)
            runs.append((runs[-1] * _STEP + text) & _MASK)
        merged: dict[int, list] = {}
        for name, n in zip(self.names, nodes, strict=True):
            if n.last > n.first:
                seen = merged.setdefault(name, [set(), [], 0])
                seen[0].add(n.style)
                seen[1].append((runs[n.last] - runs[n.first] * pow(_STEP, n.last - n.first, 1 << 64)) & _MASK)
                seen[2] += chars[n.last] - chars[n.first]
        self.rows = [(name, _digest(sorted(styles)), _digest(contents), mass) for name, (styles, contents, mass) in sorted(merged.items())]
        held, bulk = 0, []
        for length, text in sorted(zip(lengths, hashes, strict=True), key=lambda x: (-x[0], x[1])):
            if held >= BULK * self.size:
                break
            held += length
            bulk.append(text)
        self.page = _digest(sorted(bulk))


def _digest(parts: list[int]) -> int:
    return _signed(xxhash.xxh64_intdigest(np.array(parts, dtype=np.uint64).tobytes()))


_PAGE = "host bigint, page bigint, size bigint, nodes array<struct<node: bigint, style: bigint, content: bigint, mass: bigint>>, texts array<struct<node: bigint, what: bigint>>"
_NODE_FIELDS, _TEXT_FIELDS = ("node", "style", "content", "mass"), ("node", "what")


def _lists(rows: list[list[tuple]], fields: tuple[str, ...]) -> pa.ListArray:
    flat = list(zip(*(x for row in rows for x in row), strict=True)) or [[]] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]), pa.int32()), structs)


def _stats(batches: Iterator[pa.RecordBatch], by_name: bool) -> Iterator[pa.RecordBatch]:
    """host, page, size, nodes and texts of each page that has text."""
    for batch in batches:
        hosts, digests, sizes, nodes, texts = [], [], [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = _hash(host_of(url))
            elements, blocks = parse(page, by_name)
            tree = Tree(host, elements, blocks)
            hosts.append(_signed(host))
            digests.append(tree.page)
            sizes.append(tree.size)
            nodes.append(tree.rows)
            texts.append(sorted({(tree.names[b.node.place], t) for b, t in zip(blocks, tree.texts, strict=True)}))
        columns = [*(pa.array(c, pa.int64()) for c in (hosts, digests, sizes)), _lists(nodes, _NODE_FIELDS), _lists(texts, _TEXT_FIELDS)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "size", "nodes", "texts"])


def _counts(pages: DataFrame, by_name: bool) -> DataFrame:
    """c distinct pages of each (node, kind, what): kind 0 a text, 1 a presentation, 2 a content; materialized.

    mass and size (kind 1): characters of the branch, and of the whole page, over these pages.
    """
    parsed = pages.select("url", "html").mapInArrow(lambda batches: _stats(batches, by_name), _PAGE)
    distinct = parsed.groupBy("host", "page").agg(F.min(F.struct("size", "nodes", "texts")).alias("one")).select("one.*")
    zero = F.lit(0).cast("bigint")

    def row(node, kind: int, what, mass=zero, size=zero):
        return F.struct(node.alias("node"), F.lit(kind).alias("kind"), what.alias("what"), mass.alias("mass"), size.alias("size"))

    rows = F.concat(
        F.transform("texts", lambda t: row(t["node"], 0, t["what"])),
        F.transform("nodes", lambda n: row(n["node"], 1, n["style"], n["mass"], F.col("size"))),
        F.transform("nodes", lambda n: row(n["node"], 2, n["content"])),
    )
    counts = distinct.select(F.inline(rows)).groupBy("node", "kind", "what").agg(F.count("*").alias("c"), F.sum("mass").alias("mass"), F.sum("size").alias("size"))
    return materialize(counts, merge=True)


def _importances(counts: DataFrame) -> DataFrame:
    def entropy(kind: int):
        c = F.when(F.col("kind") == kind, F.col("c"))
        return F.greatest(F.lit(0.0), F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c))

    m = F.sum(F.when(F.col("kind") == 1, F.col("c")))
    content = F.when(m == 1, 1.0).otherwise(entropy(2) / F.log(m))
    return counts.where("kind > 0").groupBy("node").agg(
        m.alias("pages"), (entropy(1) / F.log(F.lit(2.0))).alias("presentation"), content.alias("content"), (F.sum("mass") / F.sum("size")).alias("share")
    )


def importances(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """node (key of host and path), pages, presentation, content, share of each node of the hosts' style trees."""
    return _importances(_counts(pages, by_name))


def decisions(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """key and what is decided of it (REPEATED, SLOT and FREE of nodes, TEXT of texts); materialized.

    by_name changes nothing of the tree, but for the text of inline elements that names drop.
    """
    counts = _counts(pages, by_name)
    nodes = _importances(counts)

    def little(importance):
        return (F.col("pages") * importance + PRIOR) / (F.col("pages") + PRIOR) < LEAST

    flags = (
        F.when(little(F.col("content")), REPEATED).otherwise(0)
        + F.when(little(F.col("content") * F.col("share")), SLOT).otherwise(0)
        + F.when(F.col("presentation") >= FREE_FORM, FREE).otherwise(0)
    )
    # A text on c of m pages is decided on if c >= NEARLY_ALL * (m + 1), and m is not less than c.
    often = counts.where((F.col("kind") == 0) & (F.col("c") >= NEARLY_ALL * (F.col("c") + 1)))
    texts = often.join(nodes.select("node", "pages"), "node").where(F.col("c") >= NEARLY_ALL * (F.col("pages") + 1)).select(F.col("what").alias("key"), F.lit(TEXT).alias("flags"))
    decided = nodes.select(F.col("node").alias("key"), flags.alias("flags")).where("flags > 0").unionByName(texts)
    return materialize(decided.select("key", F.col("flags").cast("tinyint").alias("flags")), merge=True)


def cut(nodes: list[_Node], blocks: list[Block], tree: Tree, decided) -> list[Block]:
    """The blocks of a page that the style tree leaves; decided: what is decided of a key, 0 for nothing."""
    gone, free = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        flags = decided(tree.names[i])
        above = n.up.place if n.up is not None else None
        within = above is not None and free[above]
        gone[i] = (above is not None and gone[above]) or bool(flags & REPEATED) or (bool(flags & SLOT) and not within and not n.main)
        free[i] = within or n.main or bool(flags & FREE)
    return [b for b, text in zip(blocks, tree.texts, strict=True) if not gone[b.node.place] and not decided(text) & TEXT]


class _Decided:
    """Decisions by key: a sorted array that all pages share, or the list that came with a page."""

    def __init__(self, keys: np.ndarray, flags: np.ndarray):
        self.known = dict(zip(keys.tolist(), flags.tolist(), strict=True))

    def __call__(self, key: int) -> int:
        return self.known.get(key, 0)


def _extract(batches: Iterator[pa.RecordBatch], shared: tuple[np.ndarray, np.ndarray] | None, by_name: bool) -> Iterator[pa.RecordBatch]:
    """page_id, url, text of each page; shared: keys and flags of all decisions, else each page has its own as found."""
    decided = _Decided(*shared) if shared else None
    for batch in batches:
        texts = []
        own = batch.column("found").to_pylist() if shared is None else [None] * batch.num_rows
        for url, page, found in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), own, strict=True):
            nodes, blocks = parse(page, by_name)
            known = decided or (lambda key, of={f["key"]: f["flags"] for f in found or ()}: of.get(key, 0))
            left = cut(nodes, blocks, Tree(_hash(host_of(url)), nodes, blocks), known)
            texts.append("\n".join(b.text for b in standing(left)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _keys(batches: Iterator[pa.RecordBatch], by_name: bool) -> Iterator[pa.RecordBatch]:
    """ref and key of each node and text of each page."""
    for batch in batches:
        refs, keys = [], []
        for ref, url, page in zip(batch.column("ref").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            nodes, blocks = parse(page, by_name)
            tree = Tree(_hash(host_of(url)), nodes, blocks)
            found = {*tree.names, *tree.texts}
            refs += [ref] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(keys, pa.int64())], names=["ref", "key"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = DECISIONS, by_name: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), "url", F.col(html_col).cast("string").alias("html"))
    decided = decisions(rows, by_name)
    ddl = "page_id bigint, url string, text string"
    if decided.count() <= limit:
        found = decided.toPandas()
        shared = found["key"].to_numpy(dtype=np.int64), found["flags"].to_numpy(dtype=np.int8)
        texts = rows.mapInArrow(lambda batches: _extract(batches, shared, by_name), ddl)
    else:
        path = shared_dir(pages.sparkSession) + "/pages"
        # What is written fixes the ordinal of each row for both scans.
        rows.withColumn("ref", F.monotonically_increasing_id()).write.parquet(path)
        rows = pages.sparkSession.read.parquet(path)
        salted = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = rows.select("ref", "url", "html").mapInArrow(lambda batches: _keys(batches, by_name), "ref bigint, key bigint")
        met = keys.withColumn("salt", F.pmod(F.xxhash64("ref"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
        lists = met.groupBy("ref").agg(F.collect_list(F.struct("key", "flags")).alias("found"))
        texts = rows.join(lists, "ref", "left").select("page_id", "url", "html", "found").mapInArrow(lambda batches: _extract(batches, None, by_name), ddl)
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
