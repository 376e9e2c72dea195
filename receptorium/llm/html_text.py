"""Main text of web pages: flat text blocks with word count and link density of neighbours, and a decision tree.

A page is cut at block-level tags into flat blocks. Each block has its word count and link density, those of the blocks before
and after it, and counts of what it stands in: page parts that by name hold no article (navigation, footers, adverts, forms,
comments and the like), and articles. A small labelled table of page pieces trains the tree that tells text from the rest.

Defined cases: null and empty html give an empty text; unclosed, stray and cut-off tags are allowed everywhere; equal blocks
are kept as often as they occur; repeated rows are judged one by one; other columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from receptorium.llm.shared import prepared, tidy


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "head", "object", "canvas"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span",
           "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "header", "button", "select", "dialog", "fieldset", "label"}
_ARTICLE = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXTUAL = {"p", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote", "pre", "summary"}
_PART = (r"(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|widgets?|footer|(?:site|page)-?header|masthead|"
         r"topbar|comments?|respond|replies|disqus|cookies?|consent|notice|gdpr|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|popular|tags?|pagination|pager|"
         r"search|popup|modal|overlay|disclaimer|copyright|complementary|contentinfo|alertdialog|alert)")
# A whole class or id names a part: nothing but part words, and words that say which or what of it ("main-menu", "share-buttons-2", not "has-sidebar").
_HINT = re.compile(rf"(?:(?:site|page|main|post|entry|article|top|bottom|global|primary|secondary)[-_]+)*{_PART}(?:[-_]+(?:{_PART}|posts?|articles?|stories|items?|links?|lists?|area|"
                   r"box|wrap(?:per)?|container|section|block|bar|buttons?|icons?|form|thread|slot|unit|primary|secondary|\d+))*")
# Words that make a part of what is named after them, wherever they stand in the name ("reader-comments", "comment-body", "sponsored-content").
_STRONG = frozenset(("comment", "comments", "commentary", "sponsor", "sponsors", "sponsored", "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising",
                     "promo", "disqus", "newsletter", "cookie", "cookies"))
_ABOUT = frozenset(("has", "have", "no", "not", "without", "with", "show", "hide", "enable", "disable", "allow", "js", "is", "tag", "category", "format", "type"))
_OWN_TEXT = frozenset(("post", "content", "article", "entry", "story", "main", "body", "text", "hentry", "page"))
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)


def attributes_of(markup: str) -> dict[str, str]:
    """Lower-case attribute names and their values; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(markup):
        found.setdefault(m[1].lower(), entities.unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")))
    return found


def _is_hidden(own: dict[str, str]) -> bool:
    return own.get("hidden", "false").strip().lower() != "false" or own.get("aria-hidden", "").strip().lower() == "true" or bool(_NONE.search(own.get("style", "")))


def _is_part(own: dict[str, str], with_id: bool) -> bool:
    """Whether a whole class, id or role, or the label as a whole, names a part that holds no article."""
    names = f"{own.get('class', '')} {own.get('role', '')} {own.get('id', '') if with_id else ''}".lower().split()
    for words in (re.split("[-_]+", n) for n in names):
        if words[0] not in _ABOUT and not _STRONG.isdisjoint(words):
            return True
    if not _OWN_TEXT.isdisjoint(names):  # beside the name of a text the weaker words tell what the text is about or has
        return False
    return any(_HINT.fullmatch(n) for n in [*names, "-".join(own.get("aria-label", "").lower().split())])


@dataclass(eq=False)
class _Open:
    """An open element. ``part``: it counts as a part without article; ``hinted``: only its names say so; ``first``: the number of
    blocks found before it."""

    tag: str
    part: bool
    hinted: bool
    article: bool
    link: bool
    first: int
    last: int = -1


def blocks(page: str) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(text, words, words inside links, page parts without article around it, articles around it, kind) of every flat block."""
    held: list[str] = []
    linked: list[str] = []
    open_: list[_Open] = []
    found: list[tuple[str, int, int, int, int]] = []
    parts: list[_Open] = []  # all elements that are parts, with the blocks they hold
    many: Counter[str] = Counter()  # open elements by tag
    unclosed: set[str] = set()  # raw tags that no end tag follows
    around_first: list[_Open] = []  # hinted elements around the first article
    article = link = at = kind = 0
    seen = over = False  # an article has begun; an <article> has ended

    def flush() -> None:
        text = entities.unescape("".join(held)).split()
        inside = len(entities.unescape(" ".join(linked)).split())
        held.clear()
        linked.clear()
        if text:
            found.append((" ".join(text), len(text), min(inside, len(text)), article, kind))

    def say(piece: str) -> None:
        if piece:
            held.append(piece)
            if link:
                linked.append(piece)

    end = len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            say(page[at:])
            break
        say(page[at:mark])
        token = _TOKEN.match(page, mark)
        if token is None:  # a bare less-than sign
            say("<")
            at = mark + 1
            continue
        at = token.end()
        if token[3] is None:
            say(token[1] or "")
            continue
        tag, closing, attributes = token[3].lower(), bool(token[2]), token[4]
        if tag in _RAW and not closing:
            if tag == "head":
                continue
            if not attributes.endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close is None:
                    unclosed.add(tag)
                if close:
                    at = close.end()
                elif tag == "script":
                    at = end
                elif tag == "style":  # its rules hold no tag
                    mark = page.find("<", at)
                    at = mark if mark >= 0 else end
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag not in _INLINE:
            kind = 0 if closing else 2 if tag in _HEADINGS else int(tag in _TEXTUAL)
        if not closing:
            own = attributes_of(attributes) if attributes.strip() else {}
            is_article = tag in _ARTICLE or own.get("role", "").strip().lower() == "main"
            off = tag in _ASIDE and not (tag == "header" and article)
            hinted = False
            if own and tag not in ("body", "html"):
                off = off or _is_hidden(own)
                # inside an article the ids of sections are the slugs of their headings
                slug = tag == "section" and article and not (over and not many["article"])
                hinted = not (off or is_article or tag in _HEADINGS or tag in _INLINE) and _is_part(own, not slug)
            if is_article and not seen:
                seen, around_first = True, [e for e in open_ if e.hinted]
            if tag == "a" or off or hinted or is_article or tag not in _INLINE:
                if tag not in ("p", "li", "br", "dt", "dd", "option", "tr", "td", "th") or off or hinted:
                    open_.append(_Open(tag, off or hinted, hinted, is_article, tag == "a", len(found)))
                    many[tag] += 1
                    if off or hinted:
                        parts.append(open_[-1])
                    article, link = article + is_article, link + (tag == "a")
        elif many[tag]:
            while True:
                gone = open_.pop()
                gone.last = len(found)
                many[gone.tag] -= 1
                over = over or gone.tag == "article"
                article, link = article - gone.article, link - gone.link
                if gone.tag == tag:
                    break
    flush()

    def held_by(elements: list[_Open]) -> np.ndarray:
        """How many of the elements each block stands in."""
        step = np.zeros(len(found) + 1, np.int64)
        for e in elements:
            step[e.first] += 1
            step[e.last if e.last >= 0 else len(found)] -= 1
        return np.cumsum(step)[:-1]

    inner = held_by(parts)
    if around_first:  # names don't make a part of what holds the article; teasers in a part are shorter than the page's own text
        outer = held_by(around_first)
        words = np.array([f[1] for f in found], np.int64)
        inside = words[np.array([f[3] > 0 for f in found], bool) & (inner == outer)].sum()
        if inside > words[inner == 0].sum():
            inner = inner - outer
    for (text, n, inside, articles, kind), within in zip(found, inner.tolist(), strict=True):
        yield text, n, inside, within, articles, kind


def features(flat: list[tuple[str, int, int, int, int, int]]) -> np.ndarray:
    """Per block: words and link density of the block before, of it and of the block after, parts and articles around it,
    whether the page has an article outside parts, its kind (heading 2, paragraph, item or cell 1, other 0), and the words of
    the longest block of unlinked text outside parts anywhere before and after it."""
    table = np.zeros((len(flat), 12))
    words = np.array([b[1] for b in flat], float)
    density = np.array([b[2] for b in flat], float) / np.maximum(words, 1)
    table[1:, 0], table[1:, 1] = words[:-1], density[:-1]
    table[:, 2], table[:, 3] = words, density
    table[:-1, 4], table[:-1, 5] = words[1:], density[1:]
    table[:, 6], table[:, 7] = [b[3] for b in flat], [b[4] for b in flat]
    table[:, 8] = ((table[:, 7] > 0) & (table[:, 6] == 0)).any()
    table[:, 9] = [b[5] for b in flat]
    plain = np.where((table[:, 6] == 0) & (density < 0.5), words, 0)
    table[1:, 10] = np.maximum.accumulate(plain)[:-1]
    table[:-1, 11] = np.maximum.accumulate(plain[::-1])[::-1][1:]
    return table


# A small table of page pieces labelled by hand: (where it stands, markup, is text). W stands for some words, L for a link of
# one to three words; "out" pieces surround the article, "in" pieces are inside it.
PIECES = (
    ("out", "<nav><ul><li>L</li><li>L</li><li>L</li></ul></nav>", 0), ("out", "<header><h2>W</h2><p>W</p></header>", 0), ("out", "<footer>W</footer>", 0),
    ("out", "<footer><p>W</p><p>L</p></footer>", 0), ("out", '<div class="ad">W</div>', 0), ("out", '<div class="sidebar"><h3>W</h3><p>W</p></div>', 0),
    ("out", '<div id="cookie-notice">W</div>', 0), ("out", "<form><p>W</p></form>", 0), ("out", '<section class="comments"><p>W</p><p>W</p></section>', 0),
    ("out", "<aside><p>W</p></aside>", 0), ("out", "<div>L</div><div>L</div>", 0), ("out", "<ul><li>L</li><li>L</li></ul>", 0), ("out", "<p>L L L</p>", 0), ("out", "<div>W</div>", 0), ("out", "<p>W L</p>", 0),
    ("in", "<h1>W</h1>", 1), ("in", "<h2>W</h2>", 1), ("in", "<p>W</p>", 1), ("in", "<p>W</p><p>W</p>", 1), ("in", "<p>W L W</p>", 1), ("in", "<p><b>W</b></p>", 1),
    ("in", "<blockquote>W</blockquote>", 1), ("in", "<ul><li>W</li><li>W</li></ul>", 1), ("in", "<p>W<br>W</p>", 1), ("in", "<table><tr><td>W</td><td>W</td></tr></table>", 1),
    ("in", "<div>W</div>", 1), ("in", "<p>W L W L W</p>", 1), ("in", "<h2>W</h2><p>W L</p>", 1), ("in", "<ul><li>W</li><li>W L</li><li>W</li><li>W</li></ul>", 1), ("in", "<h3>W</h3><p>W</p>", 1),
    ("in", "<table><tr><th>W</th><th>W</th></tr><tr><td>W</td><td>L</td></tr></table>", 1), ("in", "<dl><dt>W</dt><dd>W</dd></dl>", 1),
    ("in", '<div class="share">L L</div>', 0), ("in", '<div class="advert">W</div>', 0), ("in", '<ul class="related"><li>L</li><li>L</li></ul>', 0),
    ("in", '<aside class="promo">W</aside>', 0), ("in", "<form><label>W</label></form>", 0),
)
FRAMES = ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>')


def labelled_blocks(pages: int = 900, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages put together from the labelled pieces."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for n in range(pages):
        frame = FRAMES[n % len(FRAMES)]

        def fill(piece: tuple[str, str, int], longest: int) -> str:
            sign = "t" if piece[2] else "o"
            some = lambda least, most: " ".join([sign * 3] * int(rng.integers(least, most + 1)))
            return re.sub("[WL]", lambda m: some(1, longest) if m[0] == "W" else f"<a href=x>{some(1, 3)}</a>", piece[1])

        outside, inside = ([p for p in PIECES if p[0] == where] for where in ("out", "in"))
        pick = lambda pieces, most: [pieces[i] for i in rng.integers(0, len(pieces), int(rng.integers(0, most + 1)))]
        body = "".join(fill(p, int(rng.choice([3, 12, 80]))) for p in pick(inside, 8))
        page = "".join(fill(p, 14) for p in pick(outside, 3)) + frame.format(body) + "".join(fill(p, 14) for p in pick(outside, 3))
        flat = list(blocks(page))
        if not flat:
            continue
        rows.append(features(flat))
        labels += ["t" in b[0] for b in flat]
    return np.concatenate(rows), np.array(labels, int)


class Tree:
    """A classification tree by Gini impurity; leaves hold the majority (ties: not text)."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12):
        self.column = None
        self.text = bool(labels.sum() * 2 > len(labels))
        if not depth or labels.min() == labels.max():
            return
        best = (len(labels) * _gini(labels) - 1e-9, None, None)
        for c in range(rows.shape[1]):
            values = np.unique(rows[:, c])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, c] <= cut
                cost = low.sum() * _gini(labels[low]) + (~low).sum() * _gini(labels[~low])
                if cost < best[0] - 1e-12:
                    best = (cost, c, cut)
        if best[1] is not None:
            _, self.column, self.cut = best
            low = rows[:, self.column] <= self.cut
            self.low, self.high = Tree(rows[low], labels[low], depth - 1), Tree(rows[~low], labels[~low], depth - 1)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.column is None:
            return np.full(len(rows), self.text)
        low = rows[:, self.column] <= self.cut
        out = np.empty(len(rows), bool)
        out[low], out[~low] = self.low.predict(rows[low]), self.high.predict(rows[~low])
        return out


def _gini(labels: np.ndarray) -> float:
    p = labels.mean()
    return 2 * p * (1 - p)


def trained() -> Tree:
    return Tree(*labelled_blocks())


def main_text(page: str | None, tree: Tree) -> str:
    flat = list(blocks(page or ""))
    keep = tree.predict(features(flat)) if flat else np.zeros(0, bool)
    if not keep.any():  # a page that marks no text at all: what is no part and no list of links
        keep = np.array([not b[3] and 2 * b[2] < b[1] for b in flat], bool)
    return " ".join(b[0] for b, k in zip(flat, keep, strict=True) if k)


def _extractor(tree: Tree):
    def extract(batches):
        for batch in batches:
            text = []
            for page in batch.column("html"):
                text.append(main_text(page.as_py(), tree))
            names = ["page_id", "url"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=[*names, "text", "n_chars"])
    return extract


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    prepared(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(tidy(_extractor(tree or trained())), f"page_id {kind}, url string, text string, n_chars long")
