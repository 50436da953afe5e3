"""Main text of web pages by site template removal: element subtrees that recur across a host's pages are deleted.

Every place of a page (a block element that is a container or carries a class or id) has a slot, its path of tags, classes
and ids, and a subtree hash, its tags and text. Spark counts for each host how many different articles (title and first
heading) a subtree stands beside, so copies of one article count once. A subtree that stands beside LEAST articles recurs; a
slot is a template's if SHARE of what it holds recurs, and there recurring subtrees go. Inside the article only slots that
no page fills twice are judged: a place that is filled again and again is a list of paragraphs, whose lines may recur.
Small hosts have nothing to count, so elements that say what they are (menus, footers, adverts, forms, comments and so on)
go as well, unless they hold the article. Of what is left, the article elements are the text where there are any.

Blocks are block-level runs of text: references decoded, white space one space, trimmed; joined by line feeds. A null or
empty page has an empty text. Pages whose url has no host share no templates. Repeated pages and keys are rows of their own.
Columns of the table come back in the struct `page`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import slices, written

#: Different articles beside which a subtree stands to be recurring.
LEAST = 3
#: Share of a slot's subtrees that must recur for the slot to be a template's.
SHARE = 0.5
#: Open elements; what is nested deeper stands beside its parent, as in browsers. No text is lost by it.
DEEPEST = 512

# fixed values: element names of HTML and usual names of page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas math title textarea select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Blocks that are a text rather than a container: places only if they have a class or id.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption blockquote pre legend summary option".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
FURNITURE = frozenset("head nav aside footer form menu dialog search button".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promoted promotion recommended recommendations related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget widgets".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    slot: int
    place: bool  #: counted as a place of the template
    furniture: bool
    parent: int
    subtree: int = 0  #: hash of its tag, and of texts and subtrees in it
    size: int = 0  #: characters of text


@dataclass
class Block:
    text: str
    node: int


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    title: str = ""
    heading: str = ""

    def above(self, k: int) -> list[int]:
        out = []
        while k >= 0:
            out.append(k)
            k = self.nodes[k].parent
        return out


def _hash(*parts: str) -> int:
    """64 signed bits of the parts."""
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass"))
        h.update(b"\0")
    return int.from_bytes(h.digest(), "little", signed=True)


def parse(html: str) -> Page:
    """Block elements, their text and the texts between them, of HTML with any omitted or misplaced tags."""
    page = Page()
    nodes = page.nodes
    open_: list[tuple[str, int]] = []  # tag, and its node or -1 for an inline element
    hashes: list = []  # of the open nodes
    buffer: list[str] = []

    def at() -> int:
        return next((k for _, k in reversed(open_) if k >= 0), -1)

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            k = at()
            page.blocks.append(Block(text, k))
            if hashes:
                hashes[-1].update(f"t{text}\0".encode("utf-8", "surrogatepass"))
                nodes[k].size += len(text)
            if not page.heading and any(tag == "h1" for tag, _ in open_):
                page.heading = text

    def close(to: int) -> None:
        """Ends the open elements from number `to` on."""
        if any(k >= 0 for _, k in open_[to:]):
            flush()
        for _, k in reversed(open_[to:]):
            if k >= 0:
                done = hashes.pop().digest()
                nodes[k].subtree = int.from_bytes(done, "little", signed=True)
                if hashes:
                    hashes[-1].update(b"s" + done)
                    nodes[nodes[k].parent].size += nodes[k].size
        del open_[to:]

    place, n = 0, len(html)
    while place < n:
        m = _TOKEN.search(html, place)
        if m is None:
            buffer.append(references.unescape(html[place:]))
            break
        if m.start() > place:
            buffer.append(references.unescape(html[place : m.start()]))
        place = m.end()
        if m[1]:
            tag = m[1].lower()
            found = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), None)
            if found is None:
                if tag in BLOCK:
                    flush()
            elif tag in BLOCK:
                close(found)
            elif any(k >= 0 for _, k in open_[found + 1 :]):
                del open_[found]  # an inline end across a block's border
            else:
                close(found)
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, place)
                inner = html[place : end.start() if end else n]
                place = end.end() if end else n
                if tag == "title" and not page.title:
                    page.title = " ".join(references.unescape(inner).split())
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in VOID:
                if tag in BLOCK:
                    flush()
                continue
            if tag not in BLOCK:
                named = _attributes(m[3]) if m[3].strip() else {}
                if not _furniture(tag, named):
                    if len(open_) < DEEPEST:
                        open_.append((tag, -1))
                    continue
                named_block = True
            else:
                named_block, named = False, _attributes(m[3]) if m[3].strip() else {}
            flush()
            if not named_block:
                p = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == "p"), None)
                if p is not None:
                    close(p)
                closes, scope = CLOSES.get(tag, ((), ()))
                k = len(open_) - 1
                last = None
                while closes and k >= 0 and open_[k][0] not in scope:
                    last = k if open_[k][0] in closes else last
                    k -= 1
                if last is not None:
                    close(last)
            if len(open_) >= DEEPEST:
                close(DEEPEST - 1)
            parent = at()
            mark = f"{tag}#{named.get('id', '')}.{' '.join(sorted(named.get('class', '').split()))}"
            slot = _hash(str(nodes[parent].slot) if parent >= 0 else "", mark)
            counted = tag not in ("html", "body", "head") and (tag not in LEAF or "class" in named or "id" in named)
            nodes.append(Node(tag, slot, counted, _furniture(tag, named), parent))
            hashes.append(hashlib.blake2b(tag.encode("utf-8", "surrogatepass"), digest_size=8))
            open_.append((tag, len(nodes) - 1))
    flush()
    close(0)
    return page


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _furniture(tag: str, named: dict[str, str]) -> bool:
    if tag in FURNITURE or named.get("role", "").lower() in FURNITURE_ROLES:
        return True
    return any(m[0].lower() in FURNITURE_NAMES for m in _NAME.finditer(f"{named.get('class', '')} {named.get('id', '')}"))


def core(page: Page) -> int:
    """The element that holds the article: the article, else main, of most text; else the first heading; -1 if none is there."""
    for tag in ("article", "main"):
        found = [k for k, node in enumerate(page.nodes) if node.tag == tag and not node.furniture and not (node.parent >= 0 and page.nodes[node.parent].furniture)]
        if found:
            return max(found, key=lambda k: page.nodes[k].size)
    return next((k for k, node in enumerate(page.nodes) if node.tag == "h1"), -1)


def places(page: Page) -> list[tuple[int, int, int, bool]]:
    """(index, slot, subtree, inside the article) of the places that neither are nor hold the article."""
    centre = core(page)
    holds = set(page.above(centre)) if centre >= 0 else set()
    inside: list[bool] = []
    out = []
    for k, node in enumerate(page.nodes):
        inside.append(k == centre or (node.parent >= 0 and inside[node.parent]))
        if node.place and node.size and k not in holds:
            out.append((k, node.slot, node.subtree, inside[k]))
    return out


def identity(page: Page) -> int:
    """What tells a page's article from others: its title and first heading, else all of its text."""
    return _hash(page.title, page.heading) if page.title or page.heading else _hash(*(b.text for b in page.blocks))


def texts(page: Page, furniture: bool) -> list[tuple[str, list[int], bool]]:
    """(text, places above, in an article) of consecutive blocks that share them, in page order.

    With `furniture`, blocks whose elements say that they are furniture are left out: they go whatever is counted.
    """
    centre = core(page)
    holds = set(page.above(centre)) if centre >= 0 else set()
    region = page.nodes[centre].tag if centre >= 0 and page.nodes[centre].tag in ("article", "main") else None
    out = []
    for b in page.blocks:
        above = page.above(b.node)
        free = [k for k in above if k not in holds]
        in_article = any(page.nodes[k].tag == region for k in above) if region else False
        # a header outside of the article is the site's
        if furniture and any(page.nodes[k].furniture or (page.nodes[k].tag == "header" and not in_article) for k in free):
            continue
        here = ([k for k in free if page.nodes[k].place], in_article)
        if out and out[-1][1:] == here:
            out[-1] = (f"{out[-1][0]}\n{b.text}", *here)
        else:
            out.append((b.text, *here))
    return out


def _keyed(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(page, host, html, k1, k2): the columns as a struct, and a key that pages of the same address and content share."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    whole = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (url, html)]
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    return pages.select(F.struct(*others).alias("page"), host.alias("host"), whole[1].alias("html"), F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2"))


_NODES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("host", pa.string()), ("slot", pa.int64()), ("subtree", pa.int64()), ("inside", pa.bool_()), ("index", pa.int32()), ("article", pa.int64()), ("again", pa.bool_())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for host, html, k1, k2 in zip(*[c.to_pylist() for c in part.columns], strict=True):
                page = parse(html)
                article, found, filled = identity(page), places(page), {}
                for _, slot, _, _ in found:
                    filled[slot] = filled.get(slot, 0) + 1
                rows += [(k1, k2, host, slot, subtree, inside, k, article, filled[slot] > 1) for k, slot, subtree, inside in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)


def recurring(nodes: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, slot, subtree, inside) of the subtrees that are a host's template."""
    key = ["host", "slot", "inside"]
    each = nodes.groupBy(*key, "subtree", "article").agg(F.max("again").alias("again"))
    beside = each.groupBy(*key, "subtree").agg(F.count("*").alias("articles"), F.max("again").alias("again"))
    many = F.col("articles") >= least
    slots = beside.groupBy(*key).agg(F.sum("articles").alias("all"), F.sum(F.when(many, F.col("articles")).otherwise(0)).alias("recur"), F.max("again").alias("again"))
    judged = slots.where(F.col("recur") >= F.lit(share) * F.col("all")).where(~F.col("inside") | ~F.col("again")).select(*key)
    return beside.where(many).join(judged, key, "left_semi").select(*key, "subtree")


def extract(pages: DataFrame, url: str = "url", html: str = "html", least: int = LEAST, share: float = SHARE, furniture: bool = True) -> DataFrame:
    """(page, text): the columns of each page but its HTML, and its main text.

    Without `furniture` only counts decide what goes.
    """
    rows = _keyed(pages, url, html)
    shape = "k1 long, k2 long, host string, slot long, subtree long, inside boolean, index int, article long, again boolean"
    nodes = written(rows.where(F.col("host") != "").select("host", "html", "k1", "k2").mapInArrow(_nodes, shape))
    found = written(recurring(nodes, least, share))
    dead = nodes.join(found, ["host", "slot", "inside", "subtree"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("index").alias("dead"))
    kind = rows.schema["page"].dataType.simpleString()
    blocks = "array<struct<text:string,above:array<int>,main:boolean>>"
    struct = pa.struct([("text", pa.string()), ("above", pa.list_(pa.int32())), ("main", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                said = [[dict(zip(("text", "above", "main"), b, strict=True)) for b in texts(parse(h), furniture)] for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page"), part.column("k1"), part.column("k2"), pa.array(said, pa.list_(struct))], names=["page", "k1", "k2", "blocks"])

    parsed = rows.select("page", "html", "k1", "k2").mapInArrow(run, f"page {kind}, k1 long, k2 long, blocks {blocks}")
    joined = parsed.join(dead, ["k1", "k2"], "left")
    gone = F.coalesce(F.col("dead"), F.array().cast("array<int>"))
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["above"], gone))
    main = F.filter(F.col("left"), lambda b: b["main"])
    chosen = F.when(F.size(main) > 0, main).otherwise(F.col("left")) if furniture else F.col("left")
    return joined.select("page", left.alias("left")).select("page", F.array_join(F.transform(chosen, lambda b: b["text"]), "\n").alias("text"))
