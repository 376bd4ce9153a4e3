"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its structural elements, named by their path, and its text blocks, named by a hash of path and text.
Over the pages of one host that are built alike, a layout, each token has an occurrence vector, its count on every page. Tokens with equal vectors are
an equivalence class; vectors are compared by sums of hashes of (page, count), which Spark adds up map-side, so no
page set is ever gathered. The elements that occur once on nearly every page are the template's frame; classes with other
vectors are nested in the frame's element that holds all their tokens, else they are invalid and say nothing. What the
classes hold makes the slots: slots of links, of the same text everywhere, and text tokens of the frame are
boilerplate, and the deepest frame element with nearly all of the varying text is the host's main region.

A page is then read slot by slot: what its host's template drops goes from every page, and its main region holds for every
page. The page's own markup (article, main) confirms that, and decides where a host has no template: hosts with few pages, and pages
of which the template leaves nothing, as copies of one page are. Navigation, forms, adverts, comments and so on always go.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facadelake.llm.common import pieces, written

LEAST_PAGES = 4  # of a layout, for a template
LAYOUTS = 16  # of a host, its largest ones, with a template of their own; the host's other pages share one
FRAME_SHARE = 0.9  # an element that occurs once on this share of a layout's pages is of its frame
FRAME_TEXT_SHARE = 0.9  # a text block on this share of all pages is the template's
SAME_TEXT = 0.05  # different texts per page of a slot, at most, for boilerplate
LINK_SHARE = 0.6  # characters in links
MAIN_SHARE = 0.8  # of the varying text, in the main region

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set(
    "script style noscript template iframe object embed svg canvas head title nav footer aside form button select option textarea input fieldset legend dialog menu audio video map".split()
)
# Elements whose end tag may be missing: each is ended by the next of its group, p by any block.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
CONTAINERS = set("ul ol dl table tbody thead tfoot div section article main body blockquote".split())
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article articlebody article-body article-content article-text entry-content post-content post-body story story-body main-content body-text".split())
# Words in class, id or role names of what isn't the article.
NOISE_WORDS = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs
    sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup
    comment comments disqus reply replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager
    login search skip copyright legal disclaimer contentinfo complementary dialog alert form tags""".split()
)
PREFIXED = ("has-", "with-", "no-", "is-", "not-")

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|iframe|noscript|noframes|noembed|xmp|template|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z!?/][^>]*(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


@dataclass
class Block:
    """A stretch of text without a block boundary."""

    path: str
    text: str
    links: int  # characters in links
    noise: bool
    main: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: dict[str, int] = field(default_factory=lambda: defaultdict(int))  # path: count


def _meaning(tag: str, attributes: str, in_main: bool) -> tuple[str, bool, bool]:
    """Name of an element in paths, whether it is noise, whether a main region."""
    if not attributes.strip():
        names: dict[str, str] = {}
    else:
        names = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    tokens = " ".join(names.get(k, "") for k in ("class", "id", "role", "itemprop")).replace("_", "-").split()
    name = ".".join([tag, *sorted(set(re.sub(r"\d+", "", t) for t in tokens))])
    main = tag in MAIN_TAGS or any(t in MAIN_WORDS for t in tokens) or names.get("role") == "main"
    if tag in DROPPED or "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", names.get("style", "")):
        return name, True, False
    if tag == "header" and not in_main:
        return name, True, False
    if tag in ("html", "body", "article", "main") or main:
        return name, False, main
    noise = any(not t.startswith(PREFIXED) and (t in NOISE_WORDS or any(part in NOISE_WORDS for part in t.split("-")) or (t.endswith("header") and not in_main)) for t in tokens)
    return name, noise, False


def parse(source: str) -> Page:
    """Blocks in page order and element counts of a page, however broken its markup is."""
    page = Page()
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, noise, main
    parts: list[str] = []
    links, link_depth = 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, path, noise, main = stack[-1] if stack else ("", "", False, False)
            page.blocks.append(Block(path, text, min(links, len(text)), noise, main))
        parts.clear()
        links = 0

    def pop_to(index: int) -> None:
        del stack[index:]

    at = 0
    for m in MARKUP.finditer(source):
        if m.start() > at:
            piece = source[at : m.start()]
            parts.append(piece)
            if link_depth:
                links += len(piece)
        at = m.end()
        if not m["tag"]:
            if m["raw"]:
                parts.append(" ")
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "a":
                link_depth = 0 if m["close"] else 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        link_depth = 0
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if tag == "body":
            pop_to(next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)))
        ends = ENDED_BY.get(tag, set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends or stack[i][0] == "p":
                pop_to(i)
                break
            if stack[i][0] in CONTAINERS:
                break
        above = stack[-1] if stack else ("", "", False, False)
        name, noise, main = _meaning(tag, m["attributes"], above[3])
        path = f"{above[1]}>{name}"
        page.elements[path] += 1
        if tag not in VOID and not m["attributes"].endswith("/"):
            stack.append((tag, path, above[2] or noise, above[3] or main))
    if at < len(source):
        parts.append(source[at:])
    flush()
    return page


def text_token(block: Block) -> str:
    return xxhash.xxh64_hexdigest(f"{block.path}|{block.text}".encode())


def layout_of(page: Page) -> int:
    """Hash of the names of the elements right below the body and above: pages that share them are built alike."""
    top = (path for path in page.elements if path.count(">") <= (3 if path.startswith(">html") else 1))
    return xxhash.xxh64_intdigest("|".join(sorted(top)).encode()) >> 1 | 1  # never 0


def host_of(url: str = "url") -> Column:
    """The host in lower case; pages without one are a host of their own address."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("")), F.col(url), F.lit(""))


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(host, layout, token, kind, n, h1, h2, chars, links, text)``: a row per page and token. ``kind`` is E for elements, T for text blocks, and
    S for the blocks right below an element together, with their characters, those in links and a hash of their text; ``h1``, ``h2``
    are hashes of page and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            out: list[tuple] = []
            for key, host, source in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html"))):
                page = parse(source or "")
                layout = layout_of(page)
                slots: dict[str, list[Block]] = defaultdict(list)
                rows = [("E", path, n, 0, 0, 0) for path, n in page.elements.items()]
                texts: dict[str, int] = defaultdict(int)
                for b in page.blocks:
                    if not b.noise:
                        slots[b.path].append(b)
                        texts[text_token(b)] += 1
                rows += [("T", token, n, 0, 0, 0) for token, n in texts.items()]
                for path, own in slots.items():
                    whole = xxhash.xxh64_intdigest("\n".join(b.text for b in own).encode()) >> 1
                    rows.append(("S", path, len(own), sum(len(b.text) for b in own), sum(b.links for b in own), whole))
                for kind, token, n, chars, links, text in rows:
                    h = xxhash.xxh128_intdigest(f"{key}:{n}".encode())
                    out.append((host, layout, token, kind, n, h & 0x7FFFFFFF, (h >> 40) & 0x7FFFFFFF, chars, links, text))
            columns = list(zip(*out)) if out else [[] for _ in range(10)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["host", "layout", "token", "kind", "n", "h1", "h2", "chars", "links", "text"])

    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("key"), host_of().alias("host"), "html").where("html IS NOT NULL")
    return rows.mapInArrow(run, "host string, layout long, token string, kind string, n long, h1 long, h2 long, chars long, links long, text long")


def layout_sizes(pages: DataFrame) -> DataFrame:
    """``(host, layout, pages)``: pages of every layout; pages without elements and text, as empty ones, don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [(host, layout_of(page)) for host, page in zip(batch.column("host").to_pylist(), map(parse, batch.column("html").to_pylist())) if page.elements or page.blocks]
            yield pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["host", "layout"])

    rows = pages.select(host_of().alias("host"), "html").where("html IS NOT NULL").mapInArrow(run, "host string, layout long")
    return rows.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, layout, pages, main, drop)``: path of the main region (null if it isn't clear) and the boilerplate tokens of every layout with
    enough pages. A host's layouts beyond the ``LAYOUTS`` largest, and those with few pages, are taken together as its layout 0.

    A layout is one row of a bounded number of tokens: text blocks on nearly all of its pages, other tokens on a tenth or more.
    """
    sizes = written(layout_sizes(pages), "layouts")
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.col("pages").desc(), "layout"))
    large = sizes.where(F.col("pages") >= LEAST_PAGES).withColumn("_place", place).where(F.col("_place") <= LAYOUTS).drop("_place")
    rest = sizes.join(large, ["host", "layout"], "left_anti").groupBy("host").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    counts = written(large.unionByName(rest.withColumn("layout", F.lit(0).cast("long"))), "templates")
    enough = F.least(F.ceil(F.col("pages") / 2), F.greatest(F.lit(LEAST_PAGES), F.col("pages") / 10))
    often = F.when(F.col("kind") == "T", F.col("on") >= FRAME_TEXT_SHARE * F.col("pages")).otherwise(F.col("on") >= enough)
    tokens = page_tokens(pages).groupBy("host", "layout", "kind", "token").agg(
        F.count(F.lit(1)).alias("on"), F.count_if(F.col("n") == 1).alias("once"), F.sum("h1").alias("v1"), F.sum("h2").alias("v2"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.approx_count_distinct("text", 0.02).alias("texts"), F.min("text").alias("lo"), F.max("text").alias("hi"),
    )
    # Tokens of a layout with its own template are complete here; those of the others are added up to one.
    own = counts.where("layout <> 0").withColumnRenamed("pages", "own_pages")
    placed = tokens.join(own, ["host", "layout"], "left").withColumn("pages", F.col("own_pages")).where(F.col("pages").isNull() | often).drop("pages")
    placed = placed.withColumn("layout", F.when(F.col("own_pages").isNull(), F.lit(0)).otherwise(F.col("layout")).cast("long"))
    summed = placed.groupBy("host", "layout", "kind", "token").agg(
        *(F.sum(c).alias(c) for c in ("on", "once", "v1", "v2", "chars", "links")), F.when(F.min("lo") == F.max("hi"), 1).otherwise(F.sum("texts")).cast("long").alias("texts")
    )
    per_layout = summed.join(counts, ["host", "layout"]).where(often).groupBy("host", "layout").agg(
        F.first("pages").alias("pages"), F.collect_list(F.struct("kind", "token", "on", "once", "v1", "v2", "chars", "links", "texts")).alias("tokens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mains, drops = [], []
            for n, found in zip(*(batch.column(c).to_pylist() for c in ("pages", "tokens"))):
                main, drop = deduce(n, found)
                mains.append(main), drops.append(sorted(drop))
            own = [batch.column(c) for c in ("host", "layout", "pages")]
            yield pa.record_batch([*own, pa.array(mains, pa.string()), pa.array(drops, pa.list_(pa.string()))], ["host", "layout", "pages", "main", "drop"])

    return per_layout.select("host", "layout", "pages", "tokens").mapInArrow(run, "host string, layout long, pages long, main string, drop array<string>")


def deduce(pages: int, tokens: list[dict]) -> tuple[str | None, set[str]]:
    """Main region and boilerplate of one layout from its frequent tokens."""
    elements = {t["token"]: t for t in tokens if t["kind"] == "E"}
    slots = [t for t in tokens if t["kind"] == "S"]
    frame = {path for path, t in elements.items() if t["once"] >= FRAME_SHARE * pages}
    classes: dict[tuple, list[str]] = defaultdict(list)
    for path, t in elements.items():
        if path not in frame:
            classes[(t["on"], t["v1"], t["v2"])].append(path)

    def parent(path: str) -> str:
        """The frame element that holds a path."""
        while path and path not in frame:
            path = path.rpartition(">")[0]
        return path

    # A class is valid if one frame element holds all its tokens; its tokens then make one slot with what they hold.
    slot_of: dict[str, tuple] = {}
    for number, (_, paths) in enumerate(sorted(classes.items())):
        homes = {parent(p) for p in paths}
        if len(homes) == 1:
            slot_of |= {p: (next(iter(homes)), number) for p in paths}
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for s in slots:
        own = sums[slot_of.get(s["token"], (s["token"], -1))]
        own[0] += s["chars"]
        own[1] += s["links"]
    drop = {t["token"] for t in tokens if t["kind"] == "T" and t["on"] >= FRAME_TEXT_SHARE * pages and t["once"] >= FRAME_TEXT_SHARE * pages}
    varying: list[tuple[str, int]] = []
    for s in slots:
        chars, links = sums[slot_of.get(s["token"], (s["token"], -1))]
        same = s["on"] >= FRAME_SHARE * pages and s["texts"] <= max(1, SAME_TEXT * pages)
        if links > LINK_SHARE * chars or same:
            drop.add(s["token"])
        else:
            varying.append((s["token"], s["chars"]))
    total = sum(n for _, n in varying)
    main = None
    for path in sorted(frame, key=lambda p: p.count(">")):
        if total and sum(n for p, n in varying if p == path or p.startswith(path + ">")) >= MAIN_SHARE * total:
            main = path
    return main, drop


def main_text(source: str, main: str | None = None, drop: set[str] | frozenset[str] = frozenset()) -> str:
    """Text of a page's article: its blocks, joined by blank lines."""
    return _main_text(parse(source), main, drop)


def _main_text(page: Page, main: str | None, drop: set[str] | frozenset[str]) -> str:
    blocks = [b for b in page.blocks if not b.noise]
    inside = [b for b in blocks if b.main]
    kept = [b for b in blocks if b.path not in drop and text_token(b) not in drop]
    region = [b for b in kept if b.path == main or b.path.startswith(main + ">")] if main is not None else []
    kept = region or kept
    confirmed = [b for b in kept if b.main]
    if confirmed:  # the page's own markup says the same
        kept = confirmed
    elif inside and not region:  # no template that leaves anything, as for copies of one page
        kept = inside
    elif not region:
        kept = [b for b in kept if b.links <= LINK_SHARE * len(b.text)]
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every row of ``pages (page_id, url, html)``.

    Null and empty pages have empty text. Repeated rows each give a row. A page without a host in its address is a host of its
    own. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = []
            for source, dealt in zip(*(batch.column(c).to_pylist() for c in ("html", "dealt"))):
                page = parse(source or "")
                # A layout without a template is read by that of the small ones, or else of the host's largest.
                by = {t["layout"]: t for t in dealt or ()}
                own = by.get(layout_of(page)) or by.get(0) or max(by.values(), key=lambda t: (t["pages"], t["layout"]), default=None)
                texts.append(_main_text(page, own["main"], frozenset(own["drop"])) if own else _main_text(page, None, frozenset()))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    dealt = templates(pages).groupBy("host").agg(F.collect_list(F.struct("layout", "pages", "main", "drop")).alias("dealt"))
    return rows.join(dealt, "host", "left").select("page_id", "url", "html", "dealt").mapInArrow(run, "page_id long, url string, text string")
