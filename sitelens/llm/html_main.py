"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is read into a tree of elements.  Every element is described by its own
and its subtree's text, link and tag densities, tokens of its tag and
attributes, its depth, and how it compares with its siblings.  Boosted trees
score how likely an element belongs to the article.  Decoding chooses, for the
whole tree at once, which elements are main: a main region begins at some
element and holds its whole subtree except parts that are cut out, and nothing
below a cut can be main again, so ancestors and descendants never contradict.

The trees are fitted on a bounded sample of the pages at hand.  Their labels
come from the markup itself (``article`` and ``main`` against ``nav``,
``footer`` and the like); each page is also learned in varied forms, with the
telling tags replaced by plain ones and further menus, notices, forms and
reader comments put in, so that the scores do not hang on one template.

Defined cases: a null or empty html gives an empty text; unclosed and stray
tags are closed or skipped as browsers do; scripts, styles and other raw
elements never give text; repeated rows and null ids are read one by one; with
no page to learn from, built-in examples are used; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C
from sitelens.llm.boosting import BoostedTrees

#: Pages the trees are learned from.
SAMPLE = 300
#: Cost of beginning a main region, and of cutting a part out of one, in characters of evidence.
BEGIN, CUT = 30.0, 8.0
CHUNK_PAGES = 256

# Fixed values of HTML: element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg select".split())
#: Where an svg without an end ends in browsers: at the first of these.
BREAKOUT = re.compile(r"<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var)(?=[\s/>])", re.I)
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
            "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio canvas button".split())
#: What an opening tag closes, if that is the nearest of its kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"thead"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"},
          "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
# Tokens of tag names, classes, ids and roles.
TOKENS = {
    "main": "article main content post entry story body text blog page",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs toolbar tabs pagination pager skip",
    "edge": "header footer masthead topbar bottom top foot head copyright contentinfo",
    "side": "aside sidebar side widget related recommended complementary teaser more trending popular tags",
    "advert": "ad ads advert advertisement adsense banner promo sponsor sponsored",
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay dialog newsletter subscribe",
    "form": "form search login signup input button",
    "comment": "comment comments reply replies respond discussion disqus thread",
    "share": "share sharing social follow like tweet",
}
GROUPS = list(TOKENS)
TOKEN_GROUP = {t: i for i, g in enumerate(GROUPS) for t in TOKENS[g].split()}
TAG_KINDS = {t: i for i, ts in enumerate(("div section", "article main", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu", "a", "nav header footer aside",
                                          "form button input label fieldset", "table tbody tr td th")) for t in ts.split()}
KINDS = 10

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Page:
    """Elements in page order: ``parent``, ``tag``, ``mask`` (token groups), and the stream of texts and breaks."""

    def __init__(self, source: str):
        self.parent, self.tag, self.mask, self.depth, self.end = [-1], ["#root"], [0], [0], [0]
        self.stream: list[tuple[int, str | None]] = []  # (element, text), or (element, None) for a break
        self._read(source)

    def _open(self, stack: list[int], tag: str, attributes: str) -> int:
        mask = 0
        words = [tag]
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                words += re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower())
        for w in words:
            if w in TOKEN_GROUP:
                mask |= 1 << TOKEN_GROUP[w]
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.mask.append(mask)
        self.depth.append(len(stack))
        self.end.append(0)
        return len(self.tag) - 1

    def _close(self, stack: list[int], until: int) -> None:
        while len(stack) > until:
            i = stack.pop()
            self.end[i] = len(self.tag)
            if self.tag[i] in BLOCK:
                self.stream.append((i, None))

    def _read(self, s: str) -> None:
        stack, at, n = [0], 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.stream.append((stack[-1], entities.unescape(s[at:lt])))
            if lt >= n:
                break
            if s.startswith("<!--", lt):
                close = s.find("-->", lt + 4)
                at = n if close < 0 else close + 3
                continue
            if s[lt + 1:lt + 2] in ("!", "?"):
                close = s.find(">", lt)
                at = n if close < 0 else close + 1
                continue
            m = _TAG.match(s, lt)
            if not m:  # no tag: a lone sign is text
                self.stream.append((stack[-1], "<"))
                at = lt + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        self._close(stack, k)
                        break
                continue
            if tag in BLOCK and tag != "br":
                self._imply(stack, tag)
                self.stream.append((stack[-1], None))
            if tag in VOID:
                if tag in BLOCK:
                    self.stream.append((stack[-1], None))
                i = self._open(stack, tag, "")
                self.end[i] = len(self.tag)
                continue
            i = self._open(stack, tag, m[3])
            if tag in ("svg", "math") and re.search(r"(?:^|[\s\"'])/$|^[^=]*/$", m[3]):  # an unquoted value takes the slash
                self.end[i] = len(self.tag)
                continue
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(s, at)
                if close:
                    at = s.find(">", close.end()) + 1 or n
                else:
                    out = BREAKOUT.search(s, at) if tag == "svg" else None
                    at = out.start() if out else n
                self.end[i] = len(self.tag)
                continue
            if not m[3].endswith("/") or tag in BLOCK:
                stack.append(i)
            else:
                self.end[i] = len(self.tag)
        self._close(stack, 1)
        self.end[0] = len(self.tag)

    def _imply(self, stack: list[int], tag: str) -> None:
        """Close what the opening of a block ends: an open paragraph, or a neighbour of its kind."""
        closes, scope = CLOSES.get(tag, set()), SCOPES.get(tag, set())
        for k in range(len(stack) - 1, 0, -1):
            open_ = self.tag[stack[k]]
            if open_ in closes or (open_ == "p" and tag != "button"):
                self._close(stack, k)
                break
            if open_ in scope or open_ in BLOCK:
                break


def _sums(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over each element's subtree (elements are in page order)."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[end] - total[np.arange(len(values))]


def describe(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all elements of some pages, the characters of each one's own text, and where each page begins."""
    sizes = np.array([len(p.tag) for p in pages])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    shift = np.repeat(begin[:-1], sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages])
    root = parent < 0
    parent = np.where(root, np.arange(len(parent)), parent + shift)
    end = np.concatenate([np.array(p.end) for p in pages]) + shift
    depth = np.concatenate([np.array(p.depth) for p in pages])
    mask = np.concatenate([np.array(p.mask) for p in pages])
    kind = np.array([TAG_KINDS.get(t, KINDS - 1) for p in pages for t in p.tag])
    n = len(parent)
    chars, words, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for p, b in zip(pages, begin):
        for i, text in p.stream:
            if text is not None:
                parts = text.split()
                if parts:
                    k = b + i
                    chars[k] += sum(map(len, parts)) + len(parts) - 1
                    words[k] += len(parts)
                    stops[k] += text.count(".") + text.count(",") + text.count(";")
    linked = np.zeros(n, bool)
    above = np.zeros(n, np.int64)  # token groups of all ancestors
    is_link = np.array([t == "a" for p in pages for t in p.tag])
    for d in range(1, depth.max() + 1 if n else 0):
        at = np.flatnonzero(depth == d)
        linked[at] = linked[parent[at]] | is_link[at]
        above[at] = above[parent[at]] | mask[parent[at]]
    tags = _sums(np.ones(n), end)
    t_chars, t_words, t_stops = _sums(chars, end), _sums(words, end), _sums(stops, end)
    t_link = _sums(np.where(linked, chars, 0), end)
    t_par = _sums((kind == 2) * 1.0, end)
    t_long = _sums((chars > 80) * 1.0, end)
    page_chars = np.maximum(t_chars[np.repeat(begin[:-1], sizes)], 1)
    kids = np.bincount(parent[~root], minlength=n)
    same = parent * KINDS + kind
    alike = np.bincount(same, minlength=n * KINDS)[same]
    place = np.arange(n) - shift
    sibling_chars = np.bincount(parent[~root], weights=t_chars[~root], minlength=n)
    columns = [
        np.log1p(t_chars), np.log1p(chars), t_chars / page_chars, t_chars / tags, t_link / np.maximum(t_chars, 1), t_stops / np.maximum(t_words, 1),
        t_words / tags, t_par / tags, t_long / tags, t_chars / np.maximum(t_words, 1), depth, kids, kids[parent], alike / np.maximum(kids[parent], 1),
        t_chars / np.maximum(sibling_chars[parent], 1), place / np.maximum(np.repeat(sizes, sizes), 1), t_chars[parent] / page_chars, (t_link / np.maximum(t_chars, 1))[parent],
        *[(kind == k) * 1.0 for k in range(KINDS - 1)], *[(kind[parent] == k) * 1.0 for k in range(KINDS - 1)],
        *[((mask >> g) & 1) * 1.0 for g in range(len(GROUPS))], *[((above >> g) & 1) * 1.0 for g in range(len(GROUPS))],
    ]
    return np.stack(columns, axis=1), chars, begin


def decode(page: Page, score: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Which elements are main: the choice of regions and cuts with the largest sum of score x characters."""
    n = len(page.tag)
    parent = page.parent
    inside, outside = (score * (chars + 1)).tolist(), [0.0] * n
    for i in range(n - 1, 0, -1):  # children before parents
        p = parent[i]
        inside[p] += max(inside[i], -CUT)
        outside[p] += max(outside[i], inside[i] - BEGIN)
    main = np.zeros(n, bool)
    cut = np.zeros(n, bool)
    main[0] = inside[0] - BEGIN > outside[0]
    for i in range(1, n):
        p = parent[i]
        if main[p]:
            main[i] = inside[i] >= -CUT
            cut[i] = not main[i]
        elif cut[p]:
            cut[i] = True
        else:
            main[i] = inside[i] - BEGIN > outside[i]
    return main


def main_text(page: Page, main: np.ndarray) -> str:
    return " ".join("".join(" " if text is None else text for i, text in page.stream if text is None or main[i]).split())


def extract(sources: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each source."""
    out = []
    for a in range(0, len(sources), CHUNK_PAGES):
        pages = [Page(s) for s in sources[a:a + CHUNK_PAGES]]
        x, chars, begin = describe(pages)
        score = np.clip(model.score(x), -6, 6)
        out += [main_text(p, decode(p, score[b:e], chars[b:e])) for p, b, e in zip(pages, begin[:-1], begin[1:])]
    return out


def _labels(page: Page) -> np.ndarray:
    """1 for elements of an article, from the markup's own words."""
    bad = sum(1 << GROUPS.index(g) for g in GROUPS if g != "main")
    out = np.zeros(len(page.tag), bool)
    for i in range(1, len(page.tag)):
        own = page.tag[i] in ("article", "main") or page.mask[i] & 1 and not page.mask[i] & bad and page.tag[i] in ("div", "section", "td")
        out[i] = (out[page.parent[i]] or own) and not (page.mask[i] & bad) and page.tag[i] not in RAW
    return out


# Built-in boilerplate for varied training pages; "{}" takes words of the page at hand.
EXTRAS_BEFORE = ['<header class="{h}"><a href="/">{w}</a><p>{w}</p></header>', '<div class="cookie-notice"><p>{w} {w}</p><button>OK</button></div>',
                 '<div id="menu"><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li></ul></div>', '<form action="/s"><label>{w}</label><input name="q"><button>{w}</button></form>']
EXTRAS_INSIDE = ['<div class="ad">{w} {w}</div>', '<aside class="related"><h3>{w}</h3><ul><li><a href="/x">{w}</a></li></ul></aside>', '<div class="share"><a href="#">{w}</a> <a href="#">{w}</a></div>',
                 '<form class="newsletter"><p>{w}</p><input type="email"></form>', '<section class="comments"><h3>{w}</h3><div class="comment"><b>{w}</b><p>{w} {w} {w}</p></div></section>']
EXTRAS_AFTER = ['<section id="comments"><h2>{w}</h2><div class="comment"><p>{w} {w} {w}</p></div><div class="comment"><p>{w} {w}</p></div></section>',
                '<div class="sidebar"><h3>{w}</h3><p>{w} {w}</p><ul><li><a href="/y">{w}</a></li></ul></div>', '<aside><p>{w} {w}</p></aside>', '<div class="footer"><p>{w}</p><a href="/z">{w}</a></div>']
MAINS = ['article', 'main', 'div class="content"', 'div class="post-body"', 'section class="story"', 'div id="main-content"', 'div class="entry"']


def training_pages(sources: list[str], seed: int = 8) -> list[str]:
    """The sources and, of each, a form with other main tags and further boilerplate, drawn by a fixed seed."""
    rng = np.random.default_rng(seed)
    out = []
    for source in sources:
        out.append(source)
        found = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)
        if not found:
            continue
        body = found[1]
        words = re.findall(r"[^\s<>&]+", re.sub(r"<[^>]*>", " ", body))[:4000] or ["text"]

        def some() -> str:
            k, size = int(rng.integers(len(words))), int(rng.choice([2, 6, 20, 60]))
            return " ".join(words[k:k + size])

        def fill(block: str) -> str:
            return re.sub(r"\{w\}", lambda _: some(), block).replace("{h}", str(rng.choice(["header", "site-header", "top"])))

        paragraphs = re.split(r"(?=<p>)", body)
        for _ in range(int(rng.integers(0, 3))):
            paragraphs.insert(int(rng.integers(1, len(paragraphs) + 1)), fill(str(rng.choice(EXTRAS_INSIDE))))
        main = str(rng.choice(MAINS))
        middle = f"<{main}>{''.join(paragraphs)}</{main.split()[0]}>"
        if rng.random() < 0.3:
            middle = f"<div class=\"wrap\"><div>{middle}</div></div>"
        before = "".join(fill(x) for x in EXTRAS_BEFORE if rng.random() < 0.5)
        after = "".join(fill(x) for x in EXTRAS_AFTER if rng.random() < 0.5)
        head, tail = source[:found.start()], source[found.end():]
        if rng.random() < 0.3:
            head = head.replace("<nav>", '<div class="nav">').replace("</nav>", "</div>")
            tail = tail.replace("<footer>", '<div class="foot">').replace("</footer>", "</div>")
        out.append(head + before + middle + after + tail)
    return out


EXAMPLES = ["<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></nav><article><h1>On rivers</h1><p>" + "Water runs down, and slowly, the valley forms. " * k
            + "</p><p>" + "The banks grow wide, and trees stand there. " * (2 * k) + "</p></article><footer>All rights reserved</footer></body></html>" for k in (1, 2, 4, 9, 20)]


def learn(sources: list[str]) -> BoostedTrees:
    """Trees fitted on the sources (and their varied forms); every page has the same weight."""
    if not any("<article" in s for s in sources):
        sources = [*sources, *EXAMPLES]
    pages = [Page(s) for s in training_pages(sources)]
    x, chars, begin = describe(pages)
    y = np.concatenate([_labels(p) for p in pages])
    weight = np.concatenate([np.full(e - b, 30.0 / (e - b)) for b, e in zip(begin[:-1], begin[1:])])
    return BoostedTrees().fit(x, y.astype(float), weight)


def fit(pages: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """Trees learned from at most ``sample`` pages, chosen by a hash of their html."""
    chosen = C.hashed_sample(pages.where("html is not null").select("html"), F.col("html"), sample).collect()
    return learn(sorted(r["html"] for r in chosen))


def main_texts(pages: DataFrame, model: BoostedTrees) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row."""
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = extract([h or "" for h in batch.column(2).to_pylist()], model)
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return C.map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = C.read_table(spark, sf_dir, "pages")
    return main_texts(pages, fit(pages))
