"""Main text of web pages by consensus paths per host (operator 9).

1. Every page is parsed into blocks of text inside containers. Containers are scored by the
   text they hold, less links, a share of it passing to the containers around them.
2. Each page votes on generalised paths (tags with classes, digits masked); Spark adds up the votes
   per host and path, and the path with most votes wins its host.
3. Every page is read again and gives the blocks under its host's winning path. A page without
   that path uses its own best one.

Names make noise by evidence: a whole name such as ``sidebar`` does, a name that merely has such a word in it (or a form) does
not where the element holds half of the page's text. Time and memory grow with the page, however deep its elements lie.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Set
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import explode_slices, fresh, map_slices, table
from tripleloom.session import cut_lineage

SALTS = 32
PASSED_ON = 0.75
VOTE_UNITS = 1_000_000

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body div main section td".split())
# An opening tag ends these open elements, down to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
NOISE_TAGS = frozenset(
    "nav header footer aside form noscript template object svg canvas button select dialog menu datalist head search".split()
) | RAW
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner "
    "sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments commentlist disqus reply replies respond discussion widget widgets toolbar "
    "pager pagination hidden skip outbrain taboola paywall".split()
)
# Also names of an article's own parts, its headings above all.
GENERIC_NAMES = frozenset(
    "discussion related recommended recommendations share sharing social notice notices reply replies respond alert promotion".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Never an article's wrapper, whatever else the name says.
READERS_NAMES = frozenset("comment comments commentlist disqus reply replies cookie cookies consent gdpr".split())
WEAK, STRONG, READERS = 1, 2, 3
MOST = 0.5  # of a page's text, which no noise holds by a part of its name
BESIDE = 0.25  # of the winner's text, for containers beside it under one title
SHOWN_PATH = 400  # characters; longer paths begin with a digest
MAIN_NAMES = frozenset("content article post entry story main text body".split())

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*$)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    step: str
    noise: bool
    by_name: int = 0  # noise by its names alone: 0 no, or one of the marks below


@dataclass
class Page:
    """Elements in page order (0 is the body) and blocks as (element, text, characters inside links)."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def words_of(names: str) -> set[str]:
    return {p.lower() for p in PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names))}


def describe(tag: str, attributes: str, around: Set[str] = frozenset()) -> tuple[str, bool, int]:
    """An element's generalised step, whether it is noise, and how its names alone say so.

    ``around`` are the tags it lies in. Ids of headings are titles, and so are those of inline elements in an
    article; generic words there and on an article's sections do not make noise.
    """
    if not attributes.strip(" /\n\t"):
        return tag, tag in NOISE_TAGS, WEAK if tag == "form" else 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split()})
    step = ".".join([tag, *classes])
    style = found.get("style", "").replace(" ", "").lower()
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
    role = found.get("role", "").lower()
    if tag == "form" and not unseen and not role:
        return step, True, WEAK
    if tag in NOISE_TAGS or unseen or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"):
        return step, True, 0
    if tag in ("html", "body", "main", "article") and not words_of(found.get("class", "")) & {"comment", "reply", "ad", "advert"}:
        return step, False, 0
    within = bool(around & {"article", "main"})
    title = tag in HEADINGS or bool(around & HEADINGS) or (within and tag not in BLOCKS)
    said = found.get("class", "") if title else f"{found.get('class', '')} {found.get('id', '')}"
    names = words_of(said) & NOISE_NAMES
    if title or (within and tag == "section"):
        names -= GENERIC_NAMES
    if not names:
        return step, False, 0
    if names & READERS_NAMES:
        return step, True, READERS
    whole = {x.strip("-_0123456789") for x in said.lower().split()}
    return step, True, STRONG if whole & names else WEAK


class Around(Set):
    """The tags of the open elements."""

    def __init__(self, tags: Counter):
        self.tags = tags

    def __contains__(self, tag: object) -> bool:
        return self.tags[tag] > 0

    def __iter__(self) -> Iterator[str]:
        return (t for t, n in self.tags.items() if n)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    @classmethod
    def _from_iterable(cls, tags) -> frozenset:
        return frozenset(tags)


def parse(source: str, lenient: bool = False) -> Page:
    """Elements and blocks of a page; unclosed, crossing and stray tags are taken as browsers take them, in the main.

    ``lenient`` ignores noise by name, but for readers' comments and consent.
    """
    page = Page([Node("body", -1, "", False)])
    open_: list[int] = [0]
    tags: Counter = Counter(["body"])
    around = Around(tags)
    last_end = source.rfind(">")
    buffer: list[tuple[int, str, bool]] = []
    drafts: list[tuple[int, list[tuple[int, str, bool]]]] = []
    nodes = page.nodes

    def flush() -> None:
        if buffer:
            drafts.append((open_[-1], buffer.copy()))
        buffer.clear()

    def write(raw: str) -> None:
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            buffer.append((open_[-1], raw, any(nodes[i].tag == "a" for i in open_[-4:])))

    def close_to(depth: int) -> None:
        if any(nodes[i].tag in BLOCKS for i in open_[depth:]):
            flush()
        if any(nodes[i].tag in ("td", "th") for i in open_[depth:]):
            buffer.append((0, " ", False))
        tags.subtract(nodes[i].tag for i in open_[depth:])
        del open_[depth:]

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0 or (start > last_end and not source.startswith("<!--", start)):
            write(source[at:])
            break
        tag = TAG.match(source, start)
        if tag is None:
            write(source[at : start + 1])
            at = start + 1
            continue
        write(source[at:start])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            depth = next((d for d in range(len(open_) - 1, 0, -1) if nodes[open_[d]].tag == name), 0) if tags[name] else 0
            if depth:
                close_to(depth)
            elif name == "p":
                flush()  # browsers make an empty paragraph of it
            continue
        if name in ("html", "body"):
            continue
        attributes = tag[3] if tag[2] else tag[6]
        if name == "br":
            buffer.append((0, " ", False))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
            closing = source.find(">", end.start()) if end else -1
            at = closing + 1 if closing >= 0 else size
            continue
        if name in BLOCKS and tags["p"]:
            for d in range(len(open_) - 1, 0, -1):
                tag_at = nodes[open_[d]].tag
                if tag_at == "p":
                    close_to(d)
                if tag_at in ("p", "table", "td", "div", "section", "article") or tag_at in NOISE_TAGS:
                    break
        if name in ENDS:
            ended, within = ENDS[name]
            for d in range(len(open_) - 1, 0, -1) if any(tags[t] for t in ended) else ():
                if nodes[open_[d]].tag in within:
                    break
                if nodes[open_[d]].tag in ended:
                    close_to(d)
                    if name != "tr" and name != "tbody":
                        break
        if name in BLOCKS:
            flush()
        elif name in ("td", "th"):
            buffer.append((0, " ", False))
        if name in VOID:
            continue
        step, noise, by_name = describe(name, attributes, around)
        nodes.append(Node(name, open_[-1], step, noise, by_name))
        # Inline elements do not make blocks: what is drawn inside them belongs to the block around.
        open_.append(len(nodes) - 1)
        tags[name] += 1
    flush()
    settle(page, drafts, lenient)
    # What is noise is known only now: its text is left out, and a block that ended inside it belongs around it.
    for at, pieces in drafts:
        kept = [(raw, link) for i, raw, link in pieces if not nodes[i].noise]
        text = " ".join("".join(raw for raw, _ in kept).split())
        if text:
            while nodes[at].noise:
                at = nodes[at].parent
            page.blocks.append((at, text, sum(len(raw.strip()) for raw, link in kept if link)))
    return page


def under(nodes: list[Node], own: list[int]) -> list[int]:
    """Sums of a number per element over all that lies inside."""
    out = own.copy()
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] += out[i]
    return out


def settle(page: Page, drafts: list[tuple[int, list[tuple[int, str, bool]]]], lenient: bool) -> None:
    """Spreads noise to all that lies inside, but for headings in the header of an article.

    Elements that are noise only by name are not if they hold the article itself, or, by a part of the name, ``MOST`` of the text.
    """
    nodes = page.nodes
    holds = set()
    for node in nodes:
        if node.tag in ("article", "main", "h1"):
            p = node.parent
            while p >= 0 and p not in holds:
                holds.add(p)
                p = nodes[p].parent
    for i, node in enumerate(nodes):
        if node.by_name and (i in holds or (lenient and node.by_name != READERS)):
            node.noise = False
    if any(node.noise and node.by_name == WEAK for node in nodes):
        sure = [False] * len(nodes)
        for i, node in enumerate(nodes):
            sure[i] = (node.noise and node.by_name != WEAK) or (node.parent >= 0 and sure[node.parent])
        own = [0] * len(nodes)
        for _, pieces in drafts:
            for i, raw, link in pieces:
                if not link and not sure[i]:
                    own[i] += len(raw.strip())
        text = under(nodes, own)
        for i, node in enumerate(nodes):
            if node.by_name == WEAK and text[0] and text[i] >= MOST * text[0]:
                node.noise = False
    within = [False] * len(nodes)
    titled = [False] * len(nodes)  # noise only because of an article's header around
    for i, node in enumerate(nodes):
        p = node.parent
        within[i] = node.tag in ("article", "main") or (p >= 0 and within[p])
        if p >= 0 and nodes[p].noise:
            if titled[p] and not node.noise:
                titled[i] = True
                node.noise = node.tag not in HEADINGS
            else:
                node.noise = True
        elif node.noise and node.tag == "header" and within[i] and not node.by_name:
            titled[i] = True


def paths(page: Page) -> list[str]:
    """The generalised path of every element, through its containers only."""
    out = [""] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        if i:
            before = out[node.parent]
            if node.tag in CONTAINERS:
                if len(before) > SHOWN_PATH:
                    before = "~" + hashlib.md5(before.encode()).hexdigest()
                before = f"{before}>{node.step}"
            out[i] = before
    return out


def path_scores(page: Page) -> dict[str, float]:
    """Score of every generalised path of a page."""
    nodes = page.nodes
    mass = [0.0] * len(nodes)
    for i, text, linked in page.blocks:
        if not nodes[i].noise:
            mass[i] += max(len(text) - 1.2 * linked, 0.0) + 1
    names = paths(page)
    scores: dict[str, float] = defaultdict(float)
    for at in range(len(nodes) - 1, -1, -1):
        if not mass[at]:
            continue
        node = nodes[at]
        passed = mass[at]
        if node.tag in CONTAINERS:
            bonus = 1.5 if node.tag in ("article", "main") else 0.6 if at == 0 else 1.0
            if at and bonus == 1.0 and words_of(node.step) & MAIN_NAMES:
                bonus = 1.3
            scores[names[at]] += mass[at] * bonus
            passed *= PASSED_ON
        if at:
            mass[node.parent] += passed
    return dict(scores)


def best_path(scores: dict[str, float]) -> str | None:
    return min(scores, key=lambda p: (-scores[p], p)) if scores else None


def text_under(page: Page, path: str | None) -> str | None:
    """Blocks inside containers of a path, in page order; None if the page has no such container.

    A container inside an article or main stands for the nearest of these. Where it holds no ``h1``, but
    something around it has one before it, the blocks from there on to the container are taken too, and so are the
    containers behind such a title beside the winner that hold a good share of text.
    """
    names, nodes = paths(page), page.nodes
    spots = [i for i, node in enumerate(nodes) if node.tag in CONTAINERS and names[i] == path]
    if not spots:
        return None
    chosen = {widened(page, i) for i in spots if not nodes[i].noise}
    inside = within(nodes, chosen)
    first = title_before(page, min(chosen), inside) if chosen else None
    if first is not None and (more := beside(page, chosen, first)):
        chosen |= more
        inside = within(nodes, chosen)
    lead = range(0) if first is None else range(first, min(chosen))
    # A block of the element around both lies between them if it comes after the title's block and before the container's.
    own = [k for k, (i, _, _) in enumerate(page.blocks) if inside[i]]
    start = next((k for k, (i, _, _) in enumerate(page.blocks) if i in lead), len(page.blocks))
    between = range(start, own[0] if own else start)
    return "\n".join(t for k, (i, t, _) in enumerate(page.blocks) if (inside[i] or k in between) and not nodes[i].noise)


def within(nodes: list[Node], chosen: set[int]) -> list[bool]:
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside[i] = i in chosen or (node.parent >= 0 and inside[node.parent])
    return inside


def beside(page: Page, chosen: set[int], title: int) -> set[int]:
    """Containers behind a title, with the winner's parent and the title's, that hold much text and few links."""
    nodes = page.nodes
    parent = nodes[title].parent
    if all(nodes[i].parent != parent for i in chosen):
        return set()
    own, linked = [0] * len(nodes), [0] * len(nodes)
    for i, text, link in page.blocks:
        if not nodes[i].noise:
            own[i] += len(text)
            linked[i] += link
    own, linked = under(nodes, own), under(nodes, linked)
    least = BESIDE * max(own[i] for i in chosen)
    return {
        i for i, node in enumerate(nodes)
        if i > title and node.parent == parent and node.tag in CONTAINERS and not node.noise and own[i] >= least and 3 * linked[i] <= own[i]
    }


def widened(page: Page, i: int) -> int:
    """The nearest article or main that is or holds an element, else the element."""
    at = i
    while at > 0:
        if page.nodes[at].tag in ("article", "main"):
            return at
        at = page.nodes[at].parent
    return i


def title_before(page: Page, container: int, inside: list[bool]) -> int | None:
    """The last ``h1`` before a container that has none, under the nearest element around that has one.

    Directly in the body only an ``h1`` beside the container counts: others may be the site's name.
    """
    nodes = page.nodes
    titles = [i for i, node in enumerate(nodes) if node.tag == "h1" and not node.noise]
    if any(inside[i] for i in titles):
        return None
    around = nodes[container].parent
    while around >= 0:
        for i in reversed([i for i in titles if i < container]):
            at = nodes[i].parent
            while around and at > around:
                at = nodes[at].parent
            if at == around:
                return i
        around = nodes[around].parent
    return None


def main_text(source: str, path: str | None) -> str:
    """A page's text under its host's path, or under its own best path where that gives nothing.

    If noise leaves no text at all, the page is read again without noise by name.
    """
    page = parse(source)
    text = (text_under(page, path) if path is not None else None) or text_under(page, best_path(path_scores(page)))
    if not text and any(node.noise and node.by_name for node in page.nodes):
        page = parse(source, lenient=True)
        text = text_under(page, best_path(path_scores(page)))
    return text or ""


def host_of(url: str) -> Column:
    """Host of a URL, in small letters; empty for null or other texts."""
    found = F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``voted_host``, ``voted_path``: the path with most votes of every host, the smallest of equal ones.

    A page gives its paths shares of one vote by their scores, in whole units, so sums do not depend on order.
    Votes are added up inside each slice before they are shuffled.
    """

    def make() -> Callable[..., list[list]]:
        def work(hosts: list[str], sources: list[str | None]) -> list[list]:
            votes: dict[tuple[str, str], int] = defaultdict(int)
            for h, s in zip(hosts, sources):
                scores = path_scores(parse(s or ""))
                total = sum(scores.values())
                for p, v in scores.items():
                    votes[h, p] += round(VOTE_UNITS * v / total)
            return [list(c) for c in zip(*[(h, p, v) for (h, p), v in votes.items()])] or [[]] * 3

        return work

    (host,) = fresh(pages, "host")
    read = pages.select(host_of(url).alias(host), F.col(f"`{source}`"))
    votes = explode_slices(read, [host, source], make, "voted_host string, path string, votes bigint")
    total = votes.groupBy("voted_host", "path").agg(F.sum("votes").alias("votes"))
    return total.groupBy("voted_host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("voted_path"))


def extract_main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", keep: list[str] | None = None, name: str = "main_text"
) -> DataFrame:
    """``keep`` (all columns by default) and the main text of every page, empty if there is none.

    Null and empty pages have an empty text; very long and very deep ones are read whole. Pages of a null or odd address share a host. Repeated rows are
    extracted alike; an empty table gives none. The hosts' paths are a written table of one row a host, which
    the planner broadcasts below its limit; beyond, it is joined on host and a salt, so that a large host is spread.
    """
    keep = pages.columns if keep is None else keep
    won = cut_lineage(host_paths(pages, url, source), "paths")
    host, salt = fresh(pages, "host", "salt")
    at, way, part = fresh(pages, "voted_host", "voted_path", "voted_salt")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = won.select(F.col("voted_host").alias(at), F.col("voted_path").alias(way), parts.alias(part))
    spread = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{url}`")), F.lit(SALTS)).cast("int")
    columns = list(dict.fromkeys([*keep, source]))
    left = pages.select(*[F.col(f"`{c}`") for c in columns], host_of(url).alias(host), spread.alias(salt))
    joined = left.join(salted, (left[host] == salted[at]) & (left[salt] == salted[part]), "left")

    def make() -> Callable[..., list[list]]:
        return lambda sources, ways: [[main_text(s or "", w) for s, w in zip(sources, ways)]]

    return map_slices(joined, [source, way], make, f"`{name}` string", keep)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all pages."""
    found = extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
