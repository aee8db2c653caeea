"""Main text of web pages by tree scoring.

A page becomes a tolerant tree of its tags.  Paragraph-like blocks give points
for their length and commas to their ancestors, halved at each level; a
container's points are discounted by the share of its text that stands in
links.  The best container is kept.  Where it stands in an article (or else in a
main element), that element is the article and is kept whole; otherwise its
siblings that score well or are link-poor prose are kept with it.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are left
out before scoring: by their tag, by class, id or role, and when hidden.  Inside
a known article only whole class, id or role words count as marks, and words
that articles use for their own parts (tags, search, related) only where the
part is mostly links; a header there keeps its headings and text.

One narrow map over the pages: no shuffle, one page in memory at a time.

Defined results: null or empty html gives an empty text; a page without any
prose gives an empty text; of containers with equal scores the first in page
order is the best.  Broken markup: a block opens by closing an open paragraph
and leaves an unclosed drawing, formula or list of options; an end tag closes
what is open inside it, stray end tags do nothing; a script, style, title or
text area without an end takes the rest of the page, an iframe, noscript or
template without one is ignored; an unfinished tag at the end is dropped.  Time is
linear in the page.  Rows are independent, also repeated ones; other columns are
not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
#: Of these the rest of the page is the content when they are not closed.
TO_END = frozenset("script style textarea title".split())
#: Elements that a block ends when it opens inside them.
LEFT_BY_BLOCKS = ("svg", "math", "select")
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot body html legend summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
DROPPED = frozenset("nav header footer aside form button head menu dialog search fieldset label svg select datalist".split())
#: Words in class, id or role that mark a part as no article text, and those that mark it as one.
AGAINST = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promos?|recommended|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|tags?|teaser|toolbar|widget|complementary|contentinfo|alert|search)(?:$|[\s_-])", re.I)
#: Whole words that mark a part of a known article as none of it; and those that do so only for a part of links.
INSIDE = re.compile(r"(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|comments-area|consent|cookies?|cookie-(?:banner|notice|consent)|disqus|footer|gdpr|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promos?|share|sharing|share-buttons|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|alert)", re.I)
LINKS = re.compile(r"(?:recommended|related|related-\w+|replies|respond|search|tags?|teaser)", re.I)
FOR = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|\"|')*?)(/?)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "marks", "hidden", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, marks: str = "", hidden: bool = False):
        self.tag, self.parent, self.marks, self.hidden = tag, parent, marks, hidden
        self.parts: list = []
        self.score = 0.0
        self.chars = self.linked = 0


def _attributes(written: str) -> tuple[str, bool]:
    """(class, id and role as one string, whether the element is hidden)."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(written):
        found.setdefault(name.lower(), references.unescape(a or b or c))
    style = found.get("style", "").lower().replace(" ", "")
    hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return " ".join(found[k] for k in ("class", "id", "role") if found.get(k)), hidden


class _Open:
    """The node that is open, and how many of each tag are, so that a tag that is not open is never looked for."""

    def __init__(self, root: Node):
        self.node = root
        self.count: dict[str, int] = {}

    def enter(self, node: Node) -> None:
        self.node = node
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def leave(self, node: Node) -> None:
        """Closes ``node`` and all that is open inside."""
        while self.node is not node:
            self.count[self.node.tag] -= 1
            self.node = self.node.parent
        self.count[node.tag] -= 1
        self.node = node.parent

    def innermost(self, tags: tuple[str, ...], walls: frozenset[str] | tuple[str, ...] = ()) -> Node | None:
        """The innermost open element of these tags, unless one of the walls stands in between."""
        if not any(self.count.get(t) for t in tags):
            return None
        up = self.node
        while up.parent is not None and up.tag not in tags and up.tag not in walls:
            up = up.parent
        return up if up.parent is not None and up.tag in tags else None


def parse(html: str) -> Node:
    root = Node("html", None)
    opened = _Open(root)
    at, end, unclosed = 0, len(html), set()
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            opened.node.parts.append(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            opened.node.parts.append(m[1])
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                opened.node.parts.append(" ")
            elif tag not in ("html", "body") and (up := opened.innermost((tag,))):
                opened.leave(up)
        elif m[3]:
            if not m[6]:
                break  # cut off within the tag
            tag = m[3].lower()
            if tag == "html":
                continue
            if tag in RAW:
                if m[5] or tag in unclosed:
                    continue
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                if close:
                    at = close.end()
                elif tag in TO_END:
                    at = end
                else:
                    unclosed.add(tag)
                continue
            if tag in VOID:
                opened.node.parts.append(" ")
                continue
            if tag in BLOCK:
                if up := opened.innermost(LEFT_BY_BLOCKS, BLOCK):
                    opened.leave(up)
            if tag in CLOSES_P and (up := opened.innermost(("p",), BLOCK - {"p"})):
                opened.leave(up)
            if tag in SAME and (up := opened.innermost(SAME[tag], ("ul", "ol", "dl", "table"))):
                opened.leave(up)
                if tag == "tr" and opened.node.tag == "tr":
                    opened.leave(opened.node)
            marks, hidden = _attributes(m[4]) if m[4] else ("", False)
            child = Node(tag, opened.node, marks, hidden)
            opened.node.parts.append(child)
            if not m[5] or tag not in ("svg", "math", "path", "use"):
                opened.enter(child)
    if at < end and not (tail := html[at:]).startswith("<"):
        opened.node.parts.append(tail)
    return root


def _dropped(n: Node, inside: bool) -> bool:
    """Whether the element's tag says that it is no article text; ``inside`` a known article a header is one."""
    return n.hidden or n.tag in DROPPED and not (inside and n.tag == "header")


def _marked(n: Node, inside: bool) -> bool:
    if not n.marks or n.tag in ("article", "main", "body"):
        return False
    if not inside:
        return bool(AGAINST.search(n.marks))
    words = n.marks.split()
    return any(INSIDE.fullmatch(w) for w in words) or n.linked > 0.5 * max(1, n.chars) and any(LINKS.fullmatch(w) for w in words)


def _count(order: list[Node]) -> None:
    for n in reversed(order):
        n.chars = sum(len(p.strip()) if isinstance(p, str) else p.chars for p in n.parts)
        n.linked = n.chars if n.tag == "a" else sum(p.linked for p in n.parts if not isinstance(p, str))


def _prune_and_count(root: Node) -> list[Node]:
    """Drops what is no article text and counts characters; nodes in page order.

    Marks do not drop a part that holds the page's article or most of its text
    (a layout named after its sidebar).  No recursion: depth is the page's choice.
    """
    order, stack, held = [], [(root, False)], {}
    while stack:
        n, inside = stack.pop()
        order.append(n)
        inside = inside or n.tag in ("article", "main")
        n.parts = [p for p in n.parts if isinstance(p, str) or not _dropped(p, inside)]
        stack += [(p, inside) for p in reversed(n.parts) if not isinstance(p, str)]
    _count(order)
    for n in reversed(order):
        held[n] = n.tag in ("article", "main") or any(held[p] for p in n.parts if not isinstance(p, str))
    most = root.chars / 2
    kept, stack = [], [(root, False)]
    while stack:
        n, inside = stack.pop()
        kept.append(n)
        inside = inside or n.tag in ("article", "main")
        n.parts = [p for p in n.parts if isinstance(p, str) or held[p] and not inside or p.chars > most and not held[root] or not _marked(p, inside)]
        stack += [(p, inside) for p in reversed(n.parts) if not isinstance(p, str)]
    _count(kept)
    return kept


def _inline_text(n: Node) -> str:
    """Text that stands in this block itself, without that of blocks inside."""
    out, stack = [], list(reversed(n.parts))
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag not in BLOCK:
            stack += reversed(p.parts)
    return "".join(out)


ARTICLE_BONUS = 5


def _score(order: list[Node]) -> None:
    for n in order:
        if n.tag not in PARAGRAPH:
            continue
        text = _SPACE.sub(" ", _inline_text(n)).strip()
        if not text or n.linked > 0.5 * max(1, n.chars):
            continue
        points = (1 if len(text) >= 25 else 0.2) + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up, share = (n.parent if n.tag == "p" or n.tag[0] == "h" or n.tag in ("li", "dd", "td", "pre", "blockquote") else n), 1.0
        while up is not None and share > 0.1:
            up.score += points * share
            share *= 0.5
            up = up.parent
    for n in order:
        if n.score:
            if n.tag in ("article", "main") or FOR.search(n.marks):
                n.score = n.score * 1.25 + ARTICLE_BONUS
            n.score *= 1 - n.linked / max(1, n.chars)


def _blocks(n: Node) -> list[str]:
    """The blocks' texts in page order: white space to one space, trimmed, empty ones left out."""
    out, line = [], []
    stack = [(n, False)]

    def flush() -> None:
        if text := _SPACE.sub(" ", references.unescape("".join(line)).replace("\xa0", " ")).strip():
            out.append(text)
        line.clear()

    while stack:
        p, done = stack.pop()
        if isinstance(p, str):
            line.append(p)
        elif done:
            flush()
        elif p.tag in BLOCK:
            flush()
            stack.append((p, True))
            stack += [(x, False) for x in reversed(p.parts)]
        else:
            stack += [(x, False) for x in reversed(p.parts)]
    flush()
    return out


def _known(best: Node) -> Node | None:
    """The outermost article that holds the best container, or else the innermost main element."""
    articles, main, up = [], None, best
    while up is not None:
        if up.tag == "article":
            articles.append(up)
        elif up.tag == "main" and main is None:
            main = up
        up = up.parent
    return articles[-1] if articles else main


def _with_siblings(known: Node) -> list[Node]:
    """An article with its sibling articles that score like prose: an article told in several elements.  Others, such as teasers, stay out."""
    if known.tag != "article" or known.parent is None:
        return [known]
    least = ARTICLE_BONUS + max(3.0, 0.2 * (known.score - ARTICLE_BONUS))  # every article has the bonus
    beside = lambda p: not isinstance(p, str) and p.tag == "article" and p.score >= least and p.linked < 0.25 * max(1, p.chars)
    return [p for p in known.parent.parts if p is known or beside(p)]


def main_text(html: str) -> str:
    order = _prune_and_count(parse(html))
    _score(order)
    best = max(order, key=lambda n: n.score)
    if best.score <= 0:
        # no prose to score: an article of a few words is one all the same
        best = max((n for n in order if n.tag in ("article", "main")), key=lambda n: n.chars, default=None)
        if best is None or best.linked > 0.5 * max(1, best.chars):
            return ""
    if (known := _known(best)) is not None:
        return "\n".join(line for n in _with_siblings(known) for line in _blocks(n))
    kept, parent = [best], best.parent
    if parent is not None:
        threshold = max(3.0, 0.2 * best.score)
        kept = []
        for p in parent.parts:
            if isinstance(p, str):
                continue
            if p is best or p.score >= threshold:
                kept.append(p)
            elif p.tag in ("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure", "section") or re.fullmatch(r"h[1-6]", p.tag):
                density = p.linked / max(1, p.chars)
                if p.chars and density < 0.25:
                    kept.append(p)
    return "\n".join(line for n in kept for line in _blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


#: For pages whose article is one <article> of paragraphs and headings, as those of the test tables are.
ORACLE_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda s:
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a
), t AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda s: s <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
