"""Extraction against a plain, recursive reading of well-formed pages, and hostile pages."""

import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from brandloom.llm import html_extract
from brandloom.llm.common import read

PROSE = "Some long prose, with commas, and words enough to be an article. "
SKIPPED = {"script", "style", "nav", "footer", "aside", "form", "head", "title"}
VOID = {"br", "meta", "hr", "img"}
INLINE = {"b", "a", "i", "span", "em"}
CONTAINERS = {"html", "body", "div", "section", "article", "main"}


class Tree(HTMLParser):
    """Nested [tag, class, children]; a child is a node or a text."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["", "", []]
        self.open = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.open[-1][2].append(" ")
            return
        if tag in ("p", "div") and any(n[0] == "p" for n in self.open):  # a paragraph ends where the next begins
            while self.open.pop()[0] != "p":
                pass
        node = [tag, dict(attrs).get("class") or "", []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def blocks_of(node, path, out, link=False):
    """(path, text, characters in links) of every block, in order; what is open is the last."""
    for child in node[2]:
        if isinstance(child, str):
            out[-1][1] += child
            out[-1][2] += len(" ".join(child.split())) if link else 0
        elif child[0] in SKIPPED or child[1] == "ad":
            out[-1][1] += " " if child[0] in ("script", "style", "title") else ""
            if child[0] not in ("script", "style", "title"):
                out.append([path, "", 0])
        elif child[0] in INLINE:
            blocks_of(child, path, out, link or child[0] == "a")
        else:
            inner = path + ((child[0] + "".join("." + c for c in sorted(child[1].split())),) if child[0] in CONTAINERS else ())
            out.append([inner, "", 0])
            blocks_of(child, inner, out, link)
            out.append([path, "", 0])


def read_page(source):
    out = [[(), "", 0]]
    blocks_of(Tree(source).root, (), out)
    return [(p, " ".join(t.split()), n) for p, t, n in out if t.split()], {p for p, _, _ in out}


def value(blocks, path):
    """A container's score, straight from its definition."""
    def raw(p):
        own = sum((len(t) - n) * (1.0 if len(t) - n >= 25 else 0.25) + 10 * sum(map(t.count, ",.;")) for q, t, n in blocks if q == p)
        return own + 0.8 * sum(raw(c) for c in {q[: len(p) + 1] for q, _, _ in blocks if len(q) > len(p) and q[: len(p)] == p})

    below = [(t, n) for q, t, n in blocks if q[: len(path)] == path]
    out = raw(path) * (1 - sum(n for _, n in below) / max(sum(len(t) for t, _ in below), 1))
    tag = path[-1].split(".")[0] if path else ""
    out *= 1.5 if tag in ("article", "main") else 0.7 if tag in ("", "html", "body") else 1.25 if any(c in ("content", "post", "story", "entry") for c in path[-1].split(".")[1:]) else 1.0
    if tag in ("article", "main") or any(c in ("post", "story", "entry") for c in (path[-1].split(".")[1:] if path else ())):
        out = max([out, *(value(blocks, c) for c in {q[: len(path) + 1] for q, _, _ in blocks if len(q) > len(path) and q[: len(path)] == path})])
    return out


def plain_extract(rows):
    pages = {i: read_page(source or "") for i, _, source in rows}
    host = {i: (url or "").partition("://")[2].split("/")[0].split(":")[0].lower() for i, url, _ in rows}
    votes, own = Counter(), {}
    for i, (blocks, _) in pages.items():
        paths = {q[:k] for q, _, _ in blocks for k in range(len(q) + 1)}
        scored = {p: value(blocks, p) for p in paths}
        scored = {p: s for p, s in scored.items() if s > 0}
        most = max(scored.values(), default=1)
        for p, s in scored.items():
            votes[host[i], p] += int(1000 * s / most)
        own[i] = max(scored, key=lambda p: (int(1000 * scored[p] / most), -len(p)), default=None)
    out = {}
    for i, (blocks, there) in pages.items():
        mine = [(n, -len(p), p) for (h, p), n in votes.items() if h == host[i]]
        best = max(mine)[2] if mine else None
        if best not in there:
            best = own[i]
        out[i] = "\n\n".join(t for q, t, _ in blocks if best is not None and q[: len(best)] == best)
    return out


def generated(seed):
    r = random.Random(seed)
    choices = [*"one two three, four five. six seven; eight &amp; nine&nbsp;ten <b>bold</b> <i>it</i>".split(" "), "<a href='/x'>a link</a>"]
    word = lambda: r.choice(choices)
    para = lambda: "<p>" + " ".join(word() for _ in range(r.randint(1, 60))) + "</p>"
    rows = []
    for i in range(60):
        wrap = ["<article><h1>Head</h1>%s</article>", "<div class='post'><h2>Head</h2><div class='content'>%s</div></div>", "<main><div class=x>%s</div></main>", "<div class='story a1'>%s</div>"][i % 4]
        noise = "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy, now, all.</div><section><p>%s</p></section><footer>End</footer>" % " ".join(word() for _ in range(r.randint(1, 30)))
        body = "".join(para() for _ in range(r.randint(0, 8)))
        rows.append((i, f"https://h{i % 4}.example/{i}", f"<html><head><title>T</title></head><body>{noise}{wrap % body}</body></html>".replace("a1", "a")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_reading(spark, seed):
    rows = generated(seed)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == plain_extract(rows)


def test_the_table_against_a_plain_reading(spark):
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == plain_extract(rows)


def text(source):
    return html_extract.text_under(html_extract.parse(source), None)[0]


@pytest.mark.parametrize(
    "source",
    [
        "<div class='layout right-sidebar'><article><p>%s</article></div><footer>x</footer>",
        "<div class='wrap has-nav widget'><div class='social-layout'><main><p>%s</main></div></div>",
        "<div class='page-banner-layout'><div id=content><p>%s</div></div><div class=sidebar><p>Other posts.</div>",
        "<form id=aspnet><div class=content><p>%s</div></form>",
        "<div class='modal-page'><article><p>%s</article></div>",
        "<article><p>%s</article><div class=comments><article class=comment><p>" + PROSE * 9 + "</article></div>",
        "<article><p>%s</article><div class='cookie-notice'><div class=text><p>" + PROSE * 9 + "</div></div>",
        "<article><p>%s</article><div class='sidebar'><div class=post><p>" + PROSE + "</div></div>",
        "<article><p>%s</article><div class='sidebar'><article><p>" + PROSE * 40 + "</article></div>",
        "<div class=x><p>%s</div><div class='sidebar-content'><p>" + PROSE * 40 + "</div>",
        "<div class=content><p>%s</div><div class=widget><div class=text><p>" + PROSE * 20 + "</div></div>",
        "<div class='content right-sidebar'><p>%s</div>",
    ],
)
def test_wrappers_are_judged_by_what_they_hold(source):
    assert text(source % (PROSE * 4)) == (PROSE * 4).strip()


@pytest.mark.parametrize("tag", "video audio svg object canvas iframe select template noscript math textarea title".split())
def test_unclosed_elements_swallow_nothing(tag):
    assert text(f"<body><{tag} class=x><p>{PROSE}</p></body>") == PROSE.strip()
    assert text(f"<body><p>{PROSE}</p><{tag}>gone</{tag} ><p>{PROSE}</p>") == f"{PROSE.strip()}\n\n{PROSE.strip()}"


HOSTILE = {
    "deep": "<div class='a b'>" * 50_000 + PROSE,
    "quotes": "<a \"" * 250_000 + ">",
    "no end": "<a \"" * 250_000,
    "runaway": "<a x=\"><a y\" " * 80_000,
    "sections": "<![CDATA[" * 110_000 + ">",
    "open": "<video>" * 140_000,
    "strays": "<div><p>" * 60_000 + "</x></b>" * 60_000,
    "asides": "<div class=sidebar>" * 50_000 + PROSE,
    "titles": "<title>" * 140_000,
    "attributes": "<a " + "b " * 400_000 + ">",
    "spaces": "<a" + " " * 500_000 + "=" + " " * 400_000 + ">",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_seconds(name):
    began = time.process_time()
    text(HOSTILE[name])
    assert time.process_time() - began < 8


def test_paths_that_are_never_written_out(spark):
    rows = [(i, "http://h/", "<div class='a-long-class-name'>" * 4000 + PROSE) for i in range(50)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == PROSE.strip() for r in got) and len(got) == 50


def test_clashing_columns(spark):
    rows = [(1, "http://h/", f"<article>{PROSE}", "mine", "other", "h")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, path string, host string")).first()
    assert got["text"] == PROSE.strip()
