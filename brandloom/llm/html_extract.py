"""Main text of web pages by host consensus.

First every page scores its containers by the prose in them, an article's
never below what stands inside it, and votes for the paths of all of them: the
tags with generalised classes from the root down, as one 64-bit hash. The votes
are summed for each host, and the path with most votes is the host's. Then every
page is read again and gives the text under its host's path; a page without
such a container, or a host without a vote, falls back to its own best one.

Elements that are never the article are told by their tags, roles and class
words, but a wrapper only by its words together with what it holds: see
`_settle`. Every step over a page takes time in proportion to its length.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import slices, stage, tune

#: What a container keeps of a child's score.
UPWARD = 0.8

# Elements of HTML.
CONTAINERS = frozenset("html body div article section main".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside blockquote caption center dd details dialog dir dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li menu nav ol option p pre "
    "search summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
EMBEDDED = frozenset("noscript template svg math object canvas audio video select".split())
DROPPED = frozenset("head nav footer aside form menu dialog button fieldset search label datalist".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words in class names and ids of what is not the article.
ASIDE = frozenset(
    "ad adbox ads adsbygoogle adslot adunit advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond related recommended "
    "share sharing social newsletter subscribe subscription signup login pagination pager widget widgets skip banner".split()
)
HEADS = frozenset("header head".split())
NOT_SO = frozenset("has with no without non".split())
OWN = frozenset("article post entry story".split())
ARTICLE = frozenset("article content post entry story main body text".split())
#: Words of what readers wrote: it may be longer than the article, and marked up like one.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words of what lies over a page: only the article's own tag inside tells it for a wrapper.
OVERLAYS = frozenset("cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login".split())
#: A wrapper has to hold this many times as much prose as the page has elsewhere, and
#: this many times as much as what is named as the article elsewhere.
WRAPS, OUTWEIGHS = 2, 10

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s>/][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?""")
_GAP = re.compile(r"[\s/]*+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"\d+")
_MASK = (1 << 64) - 1


class Block(NamedTuple):
    container: int
    text: str
    linked: int  # characters inside links


class Container(NamedTuple):
    parent: int
    path: int  # hash of the steps from the root
    step: str  # the tag and its generalised classes
    article: bool  # tagged as the article
    hint: bool  # its tag, classes or id speak of the article
    weak: frozenset[str] | None  # the words that make it an aside, if it is one by words alone


class Page(NamedTuple):
    containers: list[Container]
    blocks: list[Block]
    left_out: list[bool]  # containers that are not the article, or lie in such a one


@functools.lru_cache(1 << 14)
def _step_hash(step: str) -> int:
    return int.from_bytes(hashlib.blake2b(step.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _extend(path: int, step: str) -> int:
    """The hash of a path with one more step, signed."""
    x = ((path ^ _step_hash(step)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def path_hash(steps: list[str]) -> int:
    return functools.reduce(_extend, steps, 0)


@functools.lru_cache(1 << 14)
def _words_of(name: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _WORDS.findall(name))


def _strong_aside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Left out by its tag, role or style."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    return attributes.get("role", "").lower() in ROLES


def _aside_words(tag: str, attributes: dict[str, str], in_article: bool) -> frozenset[str]:
    """Words of its classes and id that speak of something beside the article."""
    if tag in ("html", "body", "main", "article"):
        return frozenset()
    out: frozenset[str] = frozenset()
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        words = _words_of(name)
        if not words & NOT_SO:
            out |= words & ASIDE
            if not in_article:
                out |= words & HEADS
    return out


def _is_article(tag: str, attributes: dict[str, str]) -> bool:
    return tag in ("article", "main") or tag in CONTAINERS and any(_words_of(c) & OWN for c in attributes.get("class", "").split())


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted({_NUMBER.sub("#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([tag, *names])


class _Tags:
    """The tags of a page, in one pass: what can't be found once is not sought again."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.cdata = source.rfind("]]>")
        self.runaway = False  # a quote was never closed: from there on, a tag ends at the first >
        self.closes: dict[str, list[tuple[int, int]]] = {}

    def close_of(self, tag: str, at: int) -> int | None:
        """What follows the next end tag of `tag`."""
        if tag not in self.closes:
            self.closes[tag] = [m.span() for m in re.finditer(rf"</{tag}(?![a-zA-Z0-9:-])[^>]*+>", self.source, re.I)] if self.last >= 0 else []
        k = bisect.bisect_left(self.closes[tag], (at, 0))
        return self.closes[tag][k][1] if k < len(self.closes[tag]) else None

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from `at` on, whether the tag closes itself, and what follows its >."""
        source, out, begin = self.source, {}, at
        if not self.runaway:
            while True:
                m = _GAP.match(source, at)
                end = m.end()
                if source.startswith(">", end):
                    return out, source[end - 1] == "/" and end > begin, end + 1
                a = _ATTRIBUTE.match(source, at)
                if a is None or a.end() > self.last:
                    self.runaway = True
                    break
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
                at = a.end()
                if value is None and source.startswith("=", at):  # a quote that is never closed
                    self.runaway = True
                    break
                out.setdefault(a[1].lower(), html.unescape(value) if value else "")
        end = source.find(">", begin)
        given = source[begin:end]
        for a in _ATTRIBUTE.finditer(given):
            value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
            out.setdefault(a[1].lower(), html.unescape(value) if value else "")
        return out, given.endswith("/"), end + 1


def parse(source: str) -> Page:
    """Containers and text blocks of a page, and which containers are left out.

    Tags may be unclosed, misnested, unquoted or cut off: an end tag closes
    what stands open inside its element and is ignored if that isn't open. A
    script or style that is never closed goes to the page's end; of any other
    raw or embedded element that isn't closed, only the tag is passed over.
    """
    containers = [Container(-1, 0, "", False, False, None)]
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, container, whether it is left out, or an article
    opened: dict[str, int] = {}
    here, left_out, articles, link = 0, 0, 0, 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(here, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def push(tag: str, container: int, out: bool, article: bool) -> None:
        nonlocal here, left_out, articles
        stack.append((tag, container, out, article))
        opened[tag] = opened.get(tag, 0) + 1
        here, left_out, articles = container, left_out + out, articles + article

    def pop() -> None:
        nonlocal here, left_out, articles
        tag, _, out, article = stack.pop()
        opened[tag] -= 1
        left_out -= out
        articles -= article
        here = stack[-1][1] if stack else 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not left_out:
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))

    tags, at, n = _Tags(source), 0, len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0 or start > tags.last and not source.startswith("<!--", start):
            add(source[at:])
            break
        add(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if source.startswith("<![CDATA[", start) and start < tags.cdata:
            end = source.find("]]>", start)
            add(html.escape(source[start + 9 : end]))
            at = end + 3
            continue
        if source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
            continue
        closing = source.startswith("/", start + 1)
        name = _NAME.match(source, start + 1 + closing)
        if not name:
            add("<")
            at = start + 1
            continue
        tag = name[0].lower()
        if closing:
            at = source.find(">", name.end()) + 1
            if tag == "a":
                link = max(0, link - 1)
            if tag in BLOCKS and not left_out:
                flush()
            if opened.get(tag):
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        attributes, empty, at = tags.attributes(name.end())
        if tag in RAW:
            if not empty:
                end = tags.close_of(tag, at)
                at = end if end is not None else n if tag in ("script", "style") else at
            add(" ")
            continue
        if tag in VOID:
            if not left_out:
                if tag in BLOCKS:
                    flush()
                else:
                    parts.append(" " if tag in ("br", "wbr") else "")
            continue
        if tag == "a":
            link = 1  # links don't nest
        if tag in BLOCKS:
            if not left_out:
                flush()
            # what this tag ends without saying so: a left-out paragraph, a sibling, an open head
            while stack and ((stack[-1][0] == "p" and tag not in ("html", "body")) or stack[-1][0] in SIBLINGS.get(tag, ()) or (stack[-1][0] == "head" and tag == "body")):
                pop()
        if tag in EMBEDDED:
            if not empty and tags.close_of(tag, at) is not None:
                add(" ")
                push(tag, here, True, False)
            continue
        words = _aside_words(tag, attributes, articles > 0)
        strong = _strong_aside(tag, attributes, articles > 0)
        if (strong or words) and tag != "form" and (strong or tag not in CONTAINERS):
            if not left_out:
                flush()
            if not empty:
                push(tag, here, True, False)
        elif tag in CONTAINERS or tag == "form":
            article = _is_article(tag, attributes)
            container = here
            if not left_out:
                hint = article or any(_words_of(x) & ARTICLE and not _words_of(x) & ASIDE for x in [*attributes.get("class", "").split(), attributes.get("id", "")])
                step = _step(tag, attributes)
                weak = words or (frozenset([tag]) if tag == "form" else None)
                containers.append(Container(here, _extend(containers[here].path, step), step, article and tag not in ("html", "body"), hint and tag not in ("html", "body"), weak or None))
                container = len(containers) - 1
            push(tag, container, False, article)
    flush()
    return Page(containers, blocks, _settle(containers, blocks))


def _settle(containers: list[Container], blocks: list[Block]) -> list[bool]:
    """Which containers are left out: asides by their words, unless they wrap the article.

    The asides are taken largest first. One wraps the article if something in
    it, not itself an aside, is tagged or named as one, and if it holds WRAPS
    times as much prose as all that is in the page already; readers' comments
    never do, and none does where prose stands under the article's own tag
    elsewhere. The asides inside a wrapper are then judged in turn.
    """
    n = len(containers)
    if not any(c.weak for c in containers):
        return [False] * n
    own = [0] * n
    for b in blocks:
        own[b.container] += len(b.text) - b.linked
    plain, whole = own[:], own[:]  # without and with the asides inside
    tagged, hinted = [c.article for c in containers], [c.hint for c in containers]
    inside: list[list[int]] = [[] for _ in range(n)]  # the outermost asides in each, by their enclosing aside
    owner = [0] * n
    for k in range(1, n):
        c = containers[k]
        owner[k] = k if c.weak else owner[c.parent]
        if c.weak:
            inside[owner[c.parent]].append(k)
    for k in range(n - 1, 0, -1):
        up, weak = containers[k].parent, containers[k].weak
        if not weak:
            plain[up] += plain[k]
        if not (weak and weak & READERS):
            whole[up] += whole[k]
            tagged[up] |= tagged[k]
            hinted[up] |= hinted[k]
    own_parts: list[list[int]] = [[] for _ in range(n)]  # tagged or named containers by their enclosing aside
    for k, c in enumerate(containers):
        if (c.article or c.hint) and plain[k]:
            own_parts[owner[k]].append(k)
    named, there = 0, False  # prose under what is named as the article, and whether any is under its own tag

    def admit(k: int) -> None:
        nonlocal named, there
        for x in own_parts[k]:
            named = max(named, plain[x])
            there |= containers[x].article and plain[x] >= 25

    admit(0)
    kept, prose = {0}, plain[0]
    heap = [(-whole[k], k) for k in inside[0]]
    heapq.heapify(heap)
    while heap:
        _, k = heapq.heappop(heap)
        weak = containers[k].weak
        if there or weak & READERS or whole[k] < max(WRAPS * prose, OUTWEIGHS * named) or not (tagged[k] if weak & OVERLAYS else hinted[k]) or not whole[k]:
            continue
        kept.add(k)
        admit(k)
        prose += plain[k]
        for x in inside[k]:
            heapq.heappush(heap, (-whole[x], x))
    return [owner[k] not in kept for k in range(n)] if len(kept) > 1 or inside[0] else [False] * n


def _own_tag(step: str) -> tuple[str, bool]:
    tag, _, names = step.partition(".")
    return tag, bool(_words_of(names) & ARTICLE)


def scores(page: Page) -> list[float]:
    """How much each container looks like the article: prose in it and below it.

    One that is tagged as the article scores no less than any container inside
    it, however long that is, so its heading and lead stay with the rest. A
    container that is left out scores nothing.
    """
    n = len(page.containers)
    prose, linked, total = [0.0] * n, [0] * n, [0] * n
    for b in page.blocks:
        if page.left_out[b.container]:
            continue
        own = len(b.text) - b.linked
        prose[b.container] += own * (1.0 if own >= 25 else 0.25) + 10 * sum(map(b.text.count, ",.;"))
        linked[b.container] += b.linked
        total[b.container] += len(b.text)
    out = prose[:]
    for k in range(n - 1, 0, -1):  # children come after their parents
        up = page.containers[k].parent
        out[up] += UPWARD * out[k]
        linked[up] += linked[k]
        total[up] += total[k]
    for k, c in enumerate(page.containers):
        tag, named = _own_tag(c.step)
        out[k] *= 1 - linked[k] / max(total[k], 1)
        if tag in ("article", "main"):
            out[k] *= 1.5
        elif tag in ("", "html", "body"):
            out[k] *= 0.7
        elif named:
            out[k] *= 1.25
    below = [0.0] * n
    for k in range(n - 1, 0, -1):
        c = page.containers[k]
        if c.article:
            out[k] = max(out[k], below[k])
        below[c.parent] = max(below[c.parent], below[k], out[k])
    return out


def votes(page: Page) -> list[tuple[int, int, int]]:
    """(path, depth, share) of each of the page's paths: its score in thousandths of the best."""
    best: dict[int, tuple[float, int]] = {}
    depth = [0] * len(page.containers)
    for k, (c, s) in enumerate(zip(page.containers, scores(page), strict=True)):
        depth[k] = depth[c.parent] + 1 if k else 0
        if s > 0 and (c.path not in best or s > best[c.path][0]):
            best[c.path] = s, depth[k]
    most = max((s for s, _ in best.values()), default=1.0)
    return [(path, d, int(1000 * s / most)) for path, (s, d) in best.items()]


def steps_to(page: Page, path: int) -> str:
    """The readable form of a path that the page has."""
    k = next(i for i, c in enumerate(page.containers) if c.path == path)
    out = []
    while k > 0:
        out.append(page.containers[k].step)
        k = page.containers[k].parent
    return "".join(f"/{x}" for x in reversed(out))


def text_under(page: Page, path: int | None) -> tuple[str, str | None]:
    """The text under a path's containers, and the path that was used in the end."""
    inside = [c.path == path and not out for c, out in zip(page.containers, page.left_out, strict=True)]
    if path is None or not any(inside):
        own = votes(page)
        if not own:
            return "", None
        path = max(own, key=lambda x: (x[2], -x[1], x[0]))[0]
        inside = [c.path == path and not out for c, out in zip(page.containers, page.left_out, strict=True)]
    for k in range(1, len(inside)):
        inside[k] = (inside[k] or inside[page.containers[k].parent]) and not page.left_out[k]
    return "\n\n".join(b.text for b in page.blocks if inside[b.container]), steps_to(page, path)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "html"):
            count: dict[tuple[str, int, int], int] = {}
            for host, source in zip(part.column("host").to_pylist(), texts.to_pylist(), strict=True):
                for path, depth, share in votes(parse(source)):
                    count[host, path, depth] = count.get((host, path, depth), 0) + share
            host, path, depth = zip(*count, strict=True) if count else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(depth, pa.int32()), pa.array(list(count.values()), pa.int64())], ["host", "path", "depth", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "html"):
            found = [text_under(parse(s), p) for s, p in zip(texts.to_pylist(), part.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())],
                ["page_id", "url", "text", "n_chars", "path"],
            )


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes among each host's pages (url, html), of equal ones the outer."""
    tune(pages.sparkSession)
    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path long, depth int, votes long")
    counted = cast.groupBy("host", "path", "depth").agg(F.sum("votes").alias("votes"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", -F.col("depth"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every row of pages (page_id, url, html).

    Null, empty and textless html gives an empty text and a null path. Pages
    with a null url, or one without a host, form one host of their own. Paths
    with equal votes go by depth, the outer first, then by hash. A page of any
    length and depth is read whole, in time and memory in proportion to it.
    Repeated rows are each extracted; an empty table gives no rows. The host
    table is joined as Spark sees fit by its size: broadcast while small, else
    by a shuffle in which a host with very many pages is split.
    """
    tune(pages.sparkSession)
    winners = stage(host_paths(pages), "host-paths")
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    return mine.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
