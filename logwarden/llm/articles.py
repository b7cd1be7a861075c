"""Main text of web pages by tree scoring.

The page is read into a tree (forgiving: missing end tags are implied, stray ones ignored). Boilerplate by element, role,
class or id is set aside. Each block of text passes points for itself, its length and its commas to its container, and
less to the ancestors above; an element's points are cut by its share of link text. The best container is kept (an
``article`` or ``main`` around it, if there is one), with those of its siblings that score well or read like prose.

Inside a block, white space (``br`` too) becomes one space; blocks are joined in page order by one line feed. Null and
empty pages give an empty text. Rows are independent of each other, so repeated rows repeat their result; a very long
page needs memory in proportion to itself. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMAS = re.compile("[,،、，]")

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr br img picture".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary address".split())
BOILERPLATE = frozenset(
    "script style noscript template svg iframe object form nav header footer aside button select option textarea input dialog menu head title "
    "canvas audio video map fieldset xmp noembed noframes applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion sidebar rail widget widgets nav "
    "navbar navigation menu menus breadcrumb breadcrumbs crumbs header masthead topbar footer cookie cookies consent gdpr notice notices alert popup modal "
    "overlay lightbox newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments "
    "disqus reply replies respond discussion pagination pager toolbar search skip form aside outbrain taboola paywall".split())
NEGATIONS = frozenset("with has no without non".split())
#: tags that end an open paragraph, and open elements that a new one of the same group ends
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre section table ul".split())
GROUPS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
          "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}


def _bad(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its tag or role, and by its class or id."""
    if tag in BOILERPLATE:
        return True, False
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True, False
    named = f"{found.get('class', '')} {found.get('id', '')}"
    for name in named.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in BAD_WORDS and (not i or words[i - 1] not in NEGATIONS) for i, w in enumerate(words)):
            return False, True
    return False, False


class _Tree:
    def __init__(self):
        self.tag, self.parent, self.sure, self.named = ["#"], [-1], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.links = 0

    def add(self, tag: str, parent: int, attributes: str) -> int:
        sure, named = _bad(tag, attributes)
        self.tag.append(tag), self.parent.append(parent), self.sure.append(sure), self.named.append(named)
        return len(self.tag) - 1


def _parsed(page: str) -> _Tree:
    tree, stack, pieces, at, link_depth = _Tree(), [0], [], 0, 0

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join(p for p, _ in pieces)).strip()
            if text:
                owner = next(i for i in reversed(stack) if tree.tag[i] not in INLINE)
                tree.blocks.append((owner, text, min(len(text), sum(len(_SPACE.sub(" ", p).strip()) for p, linked in pieces if linked))))
            pieces.clear()

    def leave(index: int) -> None:
        """Closes the element at this place of the stack and all in it."""
        nonlocal link_depth
        if any(tree.tag[i] not in INLINE for i in stack[index:]):
            flush()
        link_depth -= sum(tree.tag[i] == "a" for i in stack[index:])
        del stack[index:]

    def find(tags, stops) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if tree.tag[stack[k]] in tags:
                return k
            if tree.tag[stack[k]] in stops:
                return 0
        return 0

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        end = found.start() if found else size
        if end > at:
            pieces.append((entities.unescape(page[at:end]), link_depth > 0))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                pieces.append((found[0][9:].removesuffix("]]>"), link_depth > 0))
            continue
        if found[1]:
            if tag == "br":
                pieces.append((" ", False))
            elif k := find({tag}, () if tag not in INLINE else {"td", "th", "table", "p", "div", "li", "article", "section", "body"}):
                leave(k)
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag in VOID:
            if tag not in INLINE and tag != "input":
                flush()
            continue
        if tag in ENDS_P and (k := find({"p"}, {"td", "th", "table", "button", "object"})):
            leave(k)
        if tag in GROUPS:
            ends, stops = GROUPS[tag]
            while k := find(ends, stops):
                leave(k)
        if tag == "a" and link_depth and (k := find({"a"}, {"td", "table"})):
            leave(k)
        if tag not in INLINE:
            flush()
        if tag in ("html", "body") and tag in (tree.tag[i] for i in stack):
            continue
        node = tree.add(tag, stack[-1], found[3] or "")
        if (found[3] or "").endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag == "a":
            link_depth += 1
        stack.append(node)
    flush()
    return tree


def main_text(page: str | None) -> str:
    """The article of one page, empty if there is none."""
    if not page:
        return ""
    tree = _parsed(page)
    n = len(tree.tag)
    holds = [False] * n  # an article or main element, or its heading, is inside
    for i in range(n):
        if tree.tag[i] in ("article", "main", "h1") and not tree.sure[i] and not tree.named[i]:
            k = i
            while k >= 0 and not holds[k]:
                if tree.sure[k] and tree.tag[i] == "h1":
                    break
                holds[k] = True
                k = tree.parent[k]
    gone = [False] * n
    for i in range(1, n):
        bad = tree.sure[i] and not (holds[i] and tree.tag[i] in ("form", "header", "aside")) or tree.named[i] and tree.tag[i] not in ("html", "body") and not holds[i]
        gone[i] = gone[tree.parent[i]] or bad
    blocks = [b for b in tree.blocks if not gone[b[0]]]
    if not blocks:
        return ""
    points, text, linked = [0.0] * n, [0] * n, [0] * n
    for node, words, in_links in blocks:
        share = 1 + len(_COMMAS.findall(words)) + min(len(words) / 100, 3)
        share *= 1 - in_links / len(words)
        k, level = (tree.parent[node] if tree.tag[node] in PARAGRAPHS else node), 0
        while k >= 0:
            points[k] += share / (1, 2, 6, 9, 12)[min(level, 4)]
            k, level = tree.parent[k], level + 1
        k = node
        while k >= 0:
            text[k] += len(words)
            linked[k] += in_links
            k = tree.parent[k]
    score = [p * (1 - link / max(1, t)) for p, link, t in zip(points, linked, text)]
    best = max(range(n), key=lambda i: (score[i], -i))
    k = best
    while k > 0:
        if tree.tag[k] in ("article", "main"):
            best = k
            break
        k = tree.parent[k]
    keep = {best}
    for i in range(n):
        if i != best and tree.parent[i] == tree.parent[best] and text[i] and not gone[i] and tree.tag[best] not in ("html", "body"):
            dense = linked[i] / text[i]
            prose = tree.tag[i] in PARAGRAPHS and dense < 0.25
            if score[i] >= max(1.0, 0.2 * score[best]) and dense < 0.5 or prose and tree.tag[best] != "article":
                keep.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in keep or i > 0 and inside[tree.parent[i]]
    return "\n".join(words for node, words, _ in blocks if inside[node])


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with ``text`` and ``n_chars`` (its code points). Other columns are left out."""
    kept = pages.select(*keep, html_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, f"{kinds}, text string, n_chars long")
