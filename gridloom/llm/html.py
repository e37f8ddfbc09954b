"""Main text of web pages by composite text density.

A page is parsed into a tree, leniently.  Every node gets its characters C, tags T, link characters LC and link tags LT; its
composite density is C / T, adjusted by the logarithm of (C / LC) (T / LT) to a base that grows with the share of
links.  The node whose children's densities have the largest sum is the main text's subtree; the lowest density on its path up to
the body is the threshold for its relatives: a sibling of the path whose own density reaches it, with few links, belongs
to the text too.

What is no main text by its nature (scripts, menus, headers, footers, sidebars, forms, notices, adverts, comments) is left
out: at once where an element, a role or an attribute says so; by class or id, only where a name consists of nothing but
such words, or where the element's density is low (mostly links, or few characters a tag).  Where the densest subtree lies in an article
or main element, that whole element is the text.
Text is kept whole otherwise: references are decoded, white space within a block becomes one
space, blocks are joined by one space.  Defined cases: null or empty html, or a page without text, gives an empty text; each row gives
one row; extra columns are ignored.  No recursion: nesting may be of any depth, and time is linear in the page.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table caption tbody td tfoot th thead tr ul title noscript".split())
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "html", "head", "body", "title"}
_P_SCOPE = {"table", "td", "th", "caption", "button", "object", "html"}
#: What an element's start closes, and where the search for it stops.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_NEVER = set("head script style noscript template title textarea nav header footer aside form button select input iframe object embed svg canvas dialog menu audio video datalist".split())
_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
THIN = 20  # characters a tag, below which an element with others in it is no prose
_KEPT = {"html", "body", "article", "main"}  # never left out by class
#: Words of class and id names that tell what is no main text.
_NAMES = re.compile(
    r"ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay"
    r"|newsletter|subscri\w*|signup|login|search|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|reply|replies|widget|pager|pagination|toolbar|skip",
    re.I,
)
#: Words that may stand beside them and say nothing else.
_PLAIN = re.compile(r"\d+|area|bar|block|bottom|box|btn|button|container|content|group|head|holder|inner|item|left|link|links|list|main|outer|page|panel|posts?|right|row|section|side|site|slot|thread|title|top|unit|user|wrap|wrapper|x+s|sm|md|lg", re.I)
_SCOPES = [({"p"}, _P_SCOPE), *_IMPLIED.values()]
_SCOPE_OF = {name: next(i for i, s in enumerate(_SCOPES) if s is v) for name, v in _IMPLIED.items()}
_TOUCHED = set().union(*(names | stops for names, stops in _SCOPES))


def _named(attributes: dict[str, str]) -> int:
    """2: a class or id consists of words for what is no main text; 1: one has such a word; 0: none."""
    found = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        hits = sum(bool(_NAMES.fullmatch(w)) for w in words) + ("side" in words and "bar" in words)
        if hits:
            found = max(found, 2 if all(_NAMES.fullmatch(w) or _PLAIN.fullmatch(w) for w in words) else 1)
    return found


class _Page:
    def __init__(self, html: str):
        self.tag, self.parent, self.out = ["#root"], [-1], [False]
        self.soft: list[tuple[int, int]] = []  # to be left out by class or id, and how surely
        self.pieces: list[tuple[int, str | None]] = []  # text by node; None: a block ends
        self.parse(html)

    def parse(self, html: str) -> None:
        stack, at = [0], 0
        opened: dict[str, list[int]] = {}  # places on the stack by tag
        # For each place on the stack, the innermost element that each implied end would close there (0: none in scope).
        inner = [(0,) * len(_SCOPES)]

        def close_to(i: int) -> None:
            for node in stack[i:]:
                opened[self.tag[node]].pop()
            del stack[i:], inner[i:]

        def push(node: int, name: str) -> None:
            opened.setdefault(name, []).append(len(stack))
            now = inner[-1]
            if name in _TOUCHED:
                now = tuple(len(stack) if name in names else 0 if name in stops else old for old, (names, stops) in zip(now, _SCOPES))
            stack.append(node)
            inner.append(now)

        while True:
            m = _TOKEN.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                self.pieces.append((stack[-1], unescape(text) if "&" in text else text))
            if not m:
                return
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if name in _BLOCK:
                self.pieces.append((stack[-1], None))
            if m[1]:
                if opened.get(name):
                    close_to(opened[name][-1])
                continue
            if name in _CLOSES_P and inner[-1][0]:
                close_to(inner[-1][0])
            if name in _SCOPE_OF and inner[-1][_SCOPE_OF[name]]:
                close_to(inner[-1][_SCOPE_OF[name]])
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.out.append(name in _NEVER or bool(m[3]) and self.left_out(name, m[3], node))
            if name in _RAW:
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
            elif name not in _VOID and (name in _BLOCK or not m[3].endswith("/")):  # "/>" means nothing on elements that aren't void
                push(node, name)

    def left_out(self, name: str, attributes: str, node: int) -> bool:
        found = {}
        for k, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), unescape(a or b or c))
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return name not in ("html", "body")
        if found.get("role", "").lower() in _ROLES and name not in _KEPT:
            return True
        if name not in _KEPT and (sure := _named(found)):
            self.soft.append((node, sure))
        return False

    def text(self) -> str:
        n = len(self.tag)
        own = [0] * n
        for node, piece in self.pieces:
            if piece is not None:
                own[node] += len(piece.strip())
        if self.soft:
            self.leave_out_soft(own)
        for i in range(1, n):
            self.out[i] = self.out[i] or self.out[self.parent[i]]
        # Formatting is no structure: runs within a block count as the block's (or link's) own text.
        solid = [i == 0 or t == "a" or t in _BLOCK and t not in ("br", "hr") for i, t in enumerate(self.tag)]
        home, chars = list(range(n)), [0] * n
        for i in range(1, n):
            home[i] = i if solid[i] else home[self.parent[i]]
        for i in range(n):
            chars[home[i]] += 0 if self.out[i] else own[i]
        direct = chars[:]
        tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if self.out[i] or not solid[i]:
                continue
            p = home[self.parent[i]]
            if self.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        if not chars[0]:
            return ""
        ratio = link_chars[body] / max(1, chars[body])

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            base = 1 + math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
            return c / max(1, t) * math.log(math.e - 1 + max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)

        dens = [density(chars[i], tags[i], link_chars[i], link_tags[i]) if solid[i] and not self.out[i] else 0.0 for i in range(n)]
        # A node's own text counts as a child of it.
        total = [density(direct[i], 1, 0, 0) if solid[i] and not self.out[i] else 0.0 for i in range(n)]
        for i in range(n - 1, 0, -1):
            if solid[i]:
                total[home[self.parent[i]]] += dens[i]
        best = max((i for i in range(n) if solid[i] and not self.out[i]), key=lambda i: (total[i], -i))
        while self.tag[best] == "a":
            best = home[self.parent[best]]
        up = best
        while up > 0 and self.tag[up] not in ("article", "main"):
            up = self.parent[up]
        best = up if up > 0 else best
        path, i = [best], best
        while i != body and self.parent[i] >= 0:
            i = self.parent[i]
            path.append(i)
        least = min((dens[i] for i in path if dens[i] > 0), default=0.0)
        on_path, chosen = set(path), [False] * n
        for i in range(n):
            if i == best or i and chosen[self.parent[i]]:
                chosen[i] = True
            elif i and self.parent[i] in on_path and i not in on_path and self.tag[i] in _BLOCK and dens[i] >= least > 0 and link_chars[i] * 3 < chars[i]:
                chosen[i] = True
        parts = []
        for node, piece in self.pieces:
            if piece is None:
                parts.append(" ")
            elif chosen[node] and not self.out[node]:
                parts.append(piece)
        return " ".join("".join(parts).split())


    def leave_out_soft(self, own: list[int]) -> None:
        """By class and id: what names alone can't tell, density does.

        Elements that hold the article, or most of the text of a page without one, stay whatever their names.
        """
        n = len(self.tag)
        gone = self.out[:]
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
        chars, tags, links = [0 if g else c for c, g in zip(own, gone)], [1] * n, [0] * n
        holds = [t in ("article", "main") for t in self.tag]
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "a":
                links[i] = chars[i]
            p = self.parent[i]
            chars[p], tags[p], links[p], holds[p] = chars[p] + chars[i], tags[p] + tags[i], links[p] + links[i], holds[p] or holds[i]
        for i, sure in self.soft:
            thin = 3 * links[i] >= chars[i] or tags[i] > 1 and chars[i] < THIN * tags[i]
            if not holds[i] and (sure == 2 or thin) and (holds[0] or chars[i] <= (0.9 if sure == 2 else 0.5) * chars[0]):
                self.out[i] = True


def main_text(html: str | None) -> str:
    return _Page(html).text() if html else ""


def _extract(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, schema(page_id="long", url="string", text="string", n_chars="long"))
