"""Main text of web pages, with subtrees removed that recur across a site."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, join_small, stash, table
from .words import in_slices

#: A subtree is a template of a host where it recurs on this share of the host's pages (and so many of them at least), and
#: of every host where pages of so many hosts have it, which is all that a host of few pages can go by. Pages count once
#: for all that have the same text besides the subtree, so copies of a page make no template of its story.
SHARE, LEAST_PAGES, LEAST_HOSTS = 0.05, 3, 3

#: Fixed values of HTML: elements without an end tag, elements inside a line, and elements whose content is no markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|textarea|title|xmp|iframe|noframes|noembed"
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements up to which an end tag or CLOSES looks for an open element.
SCOPES = set("article main section div table ul ol dl body html nav aside form header footer blockquote".split())

#: Elements of main text, and in them of prose, which is no template however often it recurs.
MAIN = {"article", "main"}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption caption".split())
#: Elements that never hold main text, and those that don't outside of an article.
NEVER = set("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas dialog menu xmp noframes noembed".split())
OUTSIDE = {"header"}
#: Class, id or role names that mark what isn't main text: alone, or joined to each other and to PLACES by - or _.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer menu nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
PLACES = set("site top bottom left right global primary secondary list section area box bar block wrapper container inner outer".split())
#: Elements whose names say nothing of what isn't main text, as they hold the page or are its story.
UNMARKED = {"html", "body", "main", "article"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_JOINT = re.compile(r"[-_]+")


def _marks(name: str) -> bool:
    """Whether a whole class, id or role name is a mark, such as ad, site-footer or nav_menu, but not share-price."""
    parts = set(filter(None, _JOINT.split(name)))
    return bool(parts & MARKS) and parts <= MARKS | PLACES


@dataclass
class Page:
    """Elements by number (the root is 0), each with its parent, and text in page order."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    marked: list[bool] = field(default_factory=lambda: [False])
    spans: list[list[int]] = field(default_factory=lambda: [[0, 0]])
    texts: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    page, stack, at = Page(), [0], 0

    def close(until: int) -> None:
        while len(stack) > until:
            page.spans[stack.pop()][1] = at

    for token in _TOKEN.finditer(html):
        if token.start() > at:
            page.texts.append((stack[-1], html[at : token.start()]))
        at = token.start()
        raw, slash, name, attributes = token.groups()
        if name is None:
            at = token.end()
            if raw and raw.lower() not in INLINE:
                page.texts.append((stack[-1], " "))
            continue
        name = name.lower()
        block = name not in INLINE
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tags[stack[depth]] == name:
                    at = token.end()
                    close(depth)
                    break
                if page.tags[stack[depth]] in SCOPES and name not in SCOPES:
                    break
        else:
            ends = CLOSES.get(name, {"p"} if block and name not in VOID else set())
            for depth in range(len(stack) - 1, 0, -1):
                if page.tags[stack[depth]] in ends:
                    close(depth)
                    break
                if page.tags[stack[depth]] in SCOPES:
                    break
            if name not in VOID:
                names = " ".join(part for found in _NAMED.findall(attributes) for part in found).lower().split()
                page.tags.append(name)
                page.parents.append(stack[-1])
                page.marked.append(name not in UNMARKED and any(map(_marks, names)))
                page.spans.append([token.start(), 0])
                if not attributes.endswith("/") or name in INLINE or name in SCOPES:
                    stack.append(len(page.tags) - 1)
        at = token.end()
        if block:
            page.texts.append((stack[-1], " "))
    if at < len(html):
        page.texts.append((stack[-1], html[at:]))
    at = len(html)
    close(0)
    return page


def _inside(page: Page, inside: set[str]) -> list[bool]:
    found = [False]
    for e in range(1, len(page.tags)):
        found.append(found[page.parents[e]] or page.tags[e] in inside)
    return found


@dataclass
class Sizes:
    """By element: characters of text below it, those of articles, those in links; whether it holds an article; and the sum of
    hashes of its texts."""

    all: list[int]
    main: list[int]
    links: list[int]
    holds: list[bool]
    digest: list[int]


def measure(page: Page, own: list[bool]) -> Sizes:
    """Text in NEVER elements counts for those only, not for what they are in."""
    n = len(page.tags)
    sizes = Sizes([0] * n, [0] * n, [0] * n, [False] * n, [0] * n)
    for e, text in page.texts:
        if bare := " ".join(text.split()):
            sizes.all[e] += len(bare)
            sizes.main[e] += len(bare) if own[e] else 0
            sizes.digest[e] += int.from_bytes(blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    for e in range(n - 1, 0, -1):
        up, tag = page.parents[e], page.tags[e]
        sizes.digest[up] += sizes.digest[e]
        sizes.holds[up] = sizes.holds[up] or sizes.holds[e] or tag in MAIN
        if tag not in NEVER:
            sizes.all[up] += sizes.all[e]
            sizes.main[up] += sizes.main[e]
            sizes.links[up] += sizes.all[e] if tag == "a" else sizes.links[e]
    return sizes


def subtrees(html: str, page: Page, own: list[bool], sizes: Sizes) -> list[int]:
    """A signed 64-bit hash of the markup of each element; 0 for what can't be a template: the root, elements inside a line,
    an article and what holds it, in an article prose and whatever has more than half of its text, and on a page without
    an article whatever has more than half of the page's."""
    hashes = [0]
    for e in range(1, len(page.tags)):
        tag = page.tags[e]
        whole, most = (sizes.main[0], sizes.main[e]) if own[e] else (sizes.all[0] if not sizes.holds[0] else 0, sizes.all[e])
        story = tag not in NEVER and (2 * most > whole > 0 or (own[e] and tag in PROSE))
        if sizes.holds[e] or tag in INLINE or tag in MAIN or tag in ("html", "body", "head") or story:
            hashes.append(0)
        else:
            start, end = page.spans[e]
            digest = blake2b(html[start:end].encode("utf-8", "surrogatepass"), digest_size=8).digest()
            hashes.append(int.from_bytes(digest, "little", signed=True))
    return hashes


def subtree_hashes(html: str) -> dict[int, int]:
    """The hashes of a page's subtrees that may be templates, each with a signed 64-bit digest of the page's texts outside of
    it; 0 with that of all its texts."""
    page = parse(html)
    own = _inside(page, MAIN)
    sizes = measure(page, own)
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    out = {h: signed(sizes.digest[0] - sizes.digest[e]) for e, h in enumerate(subtrees(html, page, own, sizes)) if h}
    return out | {0: signed(sizes.digest[0])}


def main_text(html: str, templates: frozenset[int] = frozenset()) -> str:
    """What is left of the page without templates and marked elements: the text of its articles where they have any, else
    all of its body. A mark on an element that has most of a page's articles, or of its text if there is none, is a
    name only. Where a page has nothing but templates, they are its text but for those that are mostly links."""
    page = parse(html)
    own = _inside(page, MAIN)
    sizes = measure(page, own)
    hashes = subtrees(html, page, own, sizes) if templates else [0] * len(page.tags)
    of = sizes.main if sizes.main[0] else sizes.all
    junk, cut, menu = [False], [False], [False]
    for e in range(1, len(page.tags)):
        parent, tag = page.parents[e], page.tags[e]
        known = hashes[e] != 0 and hashes[e] in templates
        cut.append(cut[parent] or known)
        menu.append(menu[parent] or (known and 2 * sizes.links[e] >= sizes.all[e]))
        marked = page.marked[e] and not 2 * of[e] > of[0]
        junk.append(junk[parent] or tag in NEVER or marked or (tag in OUTSIDE and not own[e]))

    def joined(without: list[bool]) -> str:
        left = [(own[e], text) for e, text in page.texts if not junk[e] and not without[e]]
        has_main = any(o and text.strip() for o, text in left)
        return " ".join(unescape("".join(text for o, text in left if o or not has_main)).split())

    return joined(cut) or joined(menu)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _hash_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "html"):
        hosts, hashes, rests = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = subtree_hashes(html)  # 0 counts the pages
            hosts += [host] * len(own)
            hashes += own.keys()
            rests += own.values()
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(rests, pa.int64())], ["host", "hash", "rest"])


def templates(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES, least_hosts: int = LEAST_HOSTS) -> DataFrame:
    """host and the hashes of its templates, for every host of ``pages`` (host, html). Counts are of pages that have a subtree
    and differ in the rest of their text, whatever they repeat. As a template is on a share of a host's pages, a host has
    at most 1 / share times as many of its own as a page has elements; what recurs across hosts counts where the host
    has it."""
    found = stash(pages.mapInArrow(_hash_rows, "host string, hash long, rest long").distinct())
    counts = stash(found.groupBy("host", "hash").agg(F.count("*").alias("n")))
    n_pages = counts.filter("hash = 0").select("host", F.col("n").alias("n_pages"))
    subtrees = counts.filter(F.col("hash") != 0)
    rests = found.filter("hash <> 0").select("hash", "rest").distinct().groupBy("hash").agg(F.count("*").alias("n_rests")).filter(F.col("n_rests") >= least_hosts)
    across = subtrees.groupBy("hash").agg(F.count("*").alias("n_hosts")).filter(F.col("n_hosts") >= least_hosts).join(rests, "hash")
    own = subtrees.join(n_pages, "host").filter((F.col("n") >= least_pages) & (F.col("n") >= share * F.col("n_pages"))).select("host", "hash")
    both = own.unionByName(subtrees.join(across, "hash").select("host", "hash")).distinct()
    return both.groupBy("host").agg(F.collect_list("hash").alias("templates"))


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_host: dict[str, frozenset[int]] = {}
    for batch in in_slices(batches, "html"):
        texts = []
        lists = batch.column("templates")
        for at, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if host not in of_host:
                of_host = {} if len(of_host) > 1000 else of_host
                of_host[host] = frozenset(lists[at].as_py() or ())
            texts.append(main_text(html, of_host[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html). A null html is an empty page; a null url or one
    without a host belongs to the host of no name. Character references are decoded, white space is one space, blocks
    are joined by a space. Rows with equal or null ids each have their row; no rows give none. Other columns of ``pages``
    are ignored.

    Subtrees are hashed where a page is read and counted by host; only hashes are shuffled. Html stays where it is while
    templates have at most ``most_broadcast`` bytes; beyond that it is shuffled once, with a host dealt to SALTS tasks."""
    host = host_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    known = stash(templates(rows.select("host", "html")))
    size = known.agg(F.coalesce(F.sum(8 * F.size("templates") + F.length("host") + 40), F.lit(0)).alias("n")).first()["n"]
    id_type = pages.schema["page_id"].dataType.simpleString()
    joined = join_small(rows, known, "host", size, ["page_id", "url"], most=most_broadcast)
    return joined.mapInArrow(_extracted, f"page_id {id_type}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
