"""Main text of web pages by wrapper induction.

Pages of one host share templates.  The layout of a page is the tree of its containers:
without running text and inline elements, without what a boilerplate role claims, runs of
like siblings folded.  The layout that most pages of a host have is the host's reference
tree; every other layout of the host is aligned with it by simple tree matching (the
largest set of pairs of equal containers that keeps parents and order).  A container
without a partner keeps its place below its nearest ancestor that has one, so containers
that the reference lacks are still compared among the layouts that have them.

From all pages of a host the least and greatest hash of every aligned container's own
text is gathered, combined on the map side, with its words, those of them in links, whether it
has headings, and how many different texts it shows on how many pages.  The text of a container is all
that lies in it outside other containers, so a paragraph that several articles share is part of a varying text.

- A container whose text is the same on all pages that have it, at least ``SUPPORT`` different
  ones or inside an article ``SUPPORT_INSIDE``, is template and goes; so do, outside articles, those
  whose words are mostly links, and those that show few texts again and again.
- The others vary.  The slot of a layout is the one with most words a page, widened to the container around it
  while that has words of its own that vary, or a heading beside it.  If the slot holds ``DOMINANT``
  times the words of all that varies outside it, and ``SLOT_WORDS`` a page, it alone is content: menus, adverts
  and imprints that differ from page to page go by their place in the aligned trees, whatever they are called.

Tags, roles, class names and ids decide where alignment does not: on hosts and layouts without such a
slot, and inside it.  Elements that one of these marks as menu, header, footer, sidebar, notice, advert, form,
script, style or reader comment go; inside articles only whole class names count,
and running text is never marked.  There, where a page has articles, content is what they hold;
else what mains hold; else all that is left.  A page whose containers are all template keeps them.

Different pages are counted with a bitmap of 64 places, which may take few pages for fewer
and never for more.  No task holds a host's pages or layouts together.

Defined cases: null or empty html gives the empty text; a null URL belongs to a host
of its own (no wrapper); repeated rows give repeated results; broken markup is read as far
as it goes; nesting of any depth is walked without recursion.  Extra columns pass through
``extract`` unless named like its results.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Different pages that have to agree on a container's text: outside articles and mains, and inside.
SUPPORT, SUPPORT_INSIDE = 2, 3
#: Words a page that make a slot, and how many times the words that vary outside it; pages that show when texts come again.
SLOT_WORDS, DOMINANT, RECURRING = 25, 4, 8
#: Bound of the wrappers sent to every task.
BROADCAST_BYTES = 32 << 20

# Element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADS = ("h1", "h2", "h3")
DROPPED = set("head nav header footer aside form script style noscript template iframe button select textarea input svg object canvas dialog menu title".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended comment comments disqus reply replies respond footer masthead toolbar pagination pager skip widget".split())

# Class names and ids that are boilerplate inside an article too.
INSIDE = set("ad ads advert adverts advertisement advertising sponsored comments comment-list commentlist comments-area comment-section reader-comments user-comments disqus_thread replies cookie-notice cookie-banner newsletter newsletter-signup share-buttons social-share related-posts related-articles breadcrumbs pagination".split())

#: Running text and inline elements, which are never containers.
FLOW = VOID | set("p li ul ol dl dt dd table tbody thead tfoot tr td th caption h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption address details summary b i em strong span a u small sup sub code font label time mark q cite abbr".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\s(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "marked", "children", "style", "inner")

    def __init__(self, tag: str, marked: bool = False, style: str = "", inner: bool = False):
        self.tag, self.marked, self.style, self.inner, self.children = tag, marked, style, inner or tag in ("article", "main"), []


def _marks(tag: str, text: str, inner: bool) -> tuple[bool, str]:
    """Whether tag or attributes name a boilerplate role; and the class as part of the node's identity."""
    marked, style = tag in DROPPED, ""
    if tag == "header" and inner:  # an article's own head: its title and lead
        marked = False
    if len(text) > len(tag) + 2:
        for name, value in _ATTR.findall(text):
            name, value = name.lower(), entities.unescape(value.strip("\"'")).lower()
            if name in ("class", "id"):
                if tag not in ("body", "html", "article", "main"):
                    marked |= tag not in FLOW and bool(INSIDE & set(value.split())) if inner else bool(WORDS & set(_WORD.findall(value)))
                style = value if name == "class" else style
            elif name == "role":
                marked |= value in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                marked = True
    return marked, style


class _Open:
    """Open elements, and the places of each tag among them, so that the nearest of some tags is found at once."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags, stops) -> None:
        """Close the nearest open one of ``tags`` and all inside it, unless one of ``stops`` is nearer."""
        at = self.nearest(tags)
        if at and at >= self.nearest(stops):
            for node in self.stack[at:]:
                self.places[node.tag].pop()
            del self.stack[at:]


_STOPS_P = BLOCK | {"td", "th", "button"}
_SECTIONS = ("article", "table", "body", "main")
_CLOSE_ALL = ("body", "html", "main", "article", "div", "section", "table")


def parse(text: str) -> Node:
    """A tree of the page; unclosed and misplaced tags are repaired the usual way, in time that follows the text."""
    root = Node("#root")
    open_, at, n = _Open(root), 0, len(text)
    stack = open_.stack
    while at < n:
        m = _TOKEN.match(text, at)
        token = m.group()
        at = m.end()
        if token[0] != "<" or len(token) == 1:
            stack[-1].children.append(token)
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                stack[-1].children.append(token[9:-3].replace("&", "&amp;"))
            continue
        name = _NAME.match(token)
        if not name:
            stack[-1].children.append(token)
            continue
        tag = name.group(1).lower()
        if token[1] == "/":
            open_.close((tag,), () if tag in _CLOSE_ALL else _SECTIONS)
            continue
        if tag in CLOSES_P:
            open_.close(("p",), _STOPS_P)
        closes, stops = CLOSES.get(tag, ((), ()))
        if closes:
            open_.close(closes, stops)
        inner = stack[-1].inner
        node = Node(tag, *_marks(tag, token, inner), inner)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else n])
            at = text.find(">", end.start()) + 1 or n if end else n
            continue
        if not token.endswith("/>") or tag in BLOCK:
            open_.push(node)
    return root


@lru_cache(1 << 16)
def _symbol(tag: str, style: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tag}.{style}".encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _below(key: int, symbol: int, nth: int) -> int:
    """The key of a container: that of its parent, its own tag and class, and its place among like ones."""
    return _hash(b"%d %d %d" % (key, symbol, nth))


class Box:
    """An unmarked container, like siblings that follow each other taken together; ``real`` are its nodes."""

    __slots__ = ("real", "symbol", "nth", "depth", "key", "kids")

    def __init__(self, real: list[Node], above: Box | None = None, symbol: int = 0, nth: int = 0):
        self.real, self.symbol, self.nth, self.kids = real, symbol, nth, []
        self.depth, self.key = (above.depth + 1, _below(above.key, symbol, nth)) if above else (0, 0)

    def said(self) -> tuple[str, int, bool]:
        """Unmarked text outside the boxes below this one, with single spaces; its words inside links; whether it has headings."""
        inner, out, linked, heads = {id(n) for kid in self.kids for n in kid.real}, [], [], False
        stack: list = [(x, False) for x in reversed(self.real)]
        while stack:
            x, link = stack.pop()
            if isinstance(x, str):
                out.append(x)
                if link:
                    linked.append(x)
            else:
                heads |= x.tag in HEADS
                link |= x.tag == "a"
                stack.extend((c, link) for c in reversed(x.children) if isinstance(c, str) or not c.marked and id(c) not in inner)
        return " ".join("".join(out).split()), len(" ".join(linked).split()), heads


def boxes(root: Node) -> list[Box]:
    """The containers of a page in order, the page itself first."""
    out, stack = [], [Box([root])]
    while stack:
        box = stack.pop()
        out.append(box)
        kids = [c for node in box.real for c in node.children if not isinstance(c, str) and not c.marked and c.tag not in FLOW]
        if len(box.real) > 1:  # a run: like children of all its members together
            kids.sort(key=lambda c: (c.tag, c.style))
        seen: dict[int, int] = {}
        last = None
        for c in kids:
            symbol = _symbol(c.tag, c.style)
            if symbol == last:
                box.kids[-1].real.append(c)
            else:
                seen[symbol] = seen.get(symbol, 0) + 1
                box.kids.append(Box([c], box, symbol, seen[symbol]))
                last = symbol
        stack.extend(reversed(box.kids))
    return out


def packed(found: list[Box]) -> bytes:
    """The tree of containers: depth, symbol and place of each in order."""
    return np.array([(b.depth, b.symbol, b.nth) for b in found], "<u4").tobytes()


# ------------------------------------------------------- simple tree matching


class Tree:
    """A packed tree of containers: keys, symbols, places and children by number in order."""

    def __init__(self, data: bytes):
        depth, self.symbol, self.nth = (x.tolist() for x in np.frombuffer(data, "<u4").reshape(-1, 3).T)
        n = len(depth)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.above, self.key, path = [-1] * n, [0] * n, []
        for i in range(n):
            del path[depth[i] :]
            if path:
                self.above[i] = path[-1]
                self.kids[path[-1]].append(i)
                self.key[i] = _below(self.key[path[-1]], self.symbol[i], self.nth[i])
            path.append(i)


class Matching:
    """Simple tree matching of two trees; equal subtrees are told by number and matched at once."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.number, self.size, self.known = a, b, {}, [], {}
        self.symbol: list[int] = []
        self.kids: list[tuple[int, ...]] = []
        self.of_a, self.of_b = self._shapes(a), self._shapes(b)

    def _shapes(self, t: Tree) -> list[int]:
        out = [0] * len(t.symbol)
        for i in range(len(out) - 1, -1, -1):
            kids = tuple(out[k] for k in t.kids[i])
            shape = t.symbol[i], kids
            if shape not in self.number:
                self.number[shape] = len(self.size)
                self.size.append(1 + sum(self.size[k] for k in kids))
                self.symbol.append(t.symbol[i]), self.kids.append(kids)
            out[i] = self.number[shape]
        return out

    @staticmethod
    def _trim(x, y) -> tuple[int, int]:
        """Equal subtrees at the beginning and at the end of two rows of children."""
        n = min(len(x), len(y))
        lo = next((i for i in range(n) if x[i] != y[i]), n)
        hi = next((i for i in range(n - lo) if x[-1 - i] != y[-1 - i]), n - lo)
        return lo, hi

    def weight(self, x: int, y: int) -> int:
        """Pairs in the largest matching of two subtrees whose roots are matched; 0 for unlike roots."""
        if x == y:
            return self.size[x]
        if self.symbol[x] != self.symbol[y]:
            return 0
        todo = [(x, y)]
        while todo:
            p, q = todo[-1]
            if (p, q) in self.known:
                todo.pop()
                continue
            xs, ys = self.kids[p], self.kids[q]
            lo, hi = self._trim(xs, ys)
            xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
            need = {(i, j) for i in set(xs) for j in set(ys) if i != j and self.symbol[i] == self.symbol[j] and (i, j) not in self.known}
            if need:
                todo.extend(need)
                continue
            todo.pop()
            same = self.kids[p][:lo] + self.kids[p][len(self.kids[p]) - hi :]
            self.known[p, q] = 1 + sum(self.size[k] for k in same) + self._rows(xs, ys)[0]
        return self.known[x, y]

    def _rows(self, xs, ys) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
        """The order-keeping assignment of children: its weight, and where leaving out a child of either side loses nothing."""
        if not xs or not ys:
            return 0, [], []
        kinds = {j: k for k, j in enumerate(dict.fromkeys(ys))}
        column = np.array([kinds[j] for j in ys])
        gain: dict[int, np.ndarray] = {}
        best, ups, lefts = np.zeros(len(ys) + 1, np.int64), [], []
        for i in xs:
            if i not in gain:
                gain[i] = np.array([self.size[i] if i == j else self.known.get((i, j), 0) if self.symbol[i] == self.symbol[j] else 0 for j in kinds])[column]
            new = np.maximum.accumulate(np.maximum(best, np.concatenate([[0], best[:-1] + gain[i]])))
            ups.append(np.packbits(new[1:] == best[1:])), lefts.append(np.packbits(new[1:] == new[:-1]))
            best = new
        return int(best[-1]), ups, lefts

    def pairs(self) -> dict[int, int]:
        """Node of the second tree -> its partner in the first."""
        out: dict[int, int] = {}
        if self.symbol[self.of_a[0]] != self.symbol[self.of_b[0]]:
            return out
        self.weight(self.of_a[0], self.of_b[0])
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            out[j] = i
            xs, ys = self.a.kids[i], self.b.kids[j]
            sx, sy = [self.of_a[k] for k in xs], [self.of_b[k] for k in ys]
            lo, hi = self._trim(sx, sy)
            todo += zip(xs[:lo], ys[:lo], strict=True)
            todo += zip(xs[len(xs) - hi :], ys[len(ys) - hi :], strict=True)
            sx, sy = sx[lo : len(sx) - hi], sy[lo : len(sy) - hi]
            _, ups, lefts = self._rows(sx, sy)
            p, q = len(sx), len(sy)
            while p and q and ups:
                bit = lambda row, at: row[at >> 3] >> (7 - (at & 7)) & 1
                if bit(ups[p - 1], q - 1):
                    p -= 1
                elif bit(lefts[p - 1], q - 1):
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    todo.append((xs[lo + p], ys[lo + q]))
        return out


def aligned(reference: bytes, layout: bytes) -> tuple[list[int], list[int]]:
    """(key of every container of a layout, key of what it is aligned with)."""
    a, b = Tree(reference), Tree(layout)
    if reference == layout:
        return b.key, b.key
    pairs = Matching(a, b).pairs()
    keys: list[int] = []
    for j in range(len(b.key)):
        keys.append(a.key[pairs[j]] if j in pairs else _below(keys[b.above[j]], b.symbol[j], b.nth[j]) if j else 0)
    return b.key, keys


# ------------------------------------------------------------------- wrappers


class Stats:
    """What the pages of a host have in a container; adds up in any order."""

    __slots__ = ("low", "high", "places", "inner", "words", "linked", "heads", "shown", "n")

    def __init__(self, low: int, high: int, places: int = 0, inner: bool = False, words: int = 0, linked: int = 0, heads: bool = False, shown: int = 0, n: int = 0):
        self.low, self.high, self.places, self.inner, self.words, self.linked, self.heads, self.shown, self.n = low, high, places, inner, words, linked, heads, shown, n

    def values(self) -> tuple:
        return self.low, self.high, self.places, self.inner, self.words, self.linked, self.heads, self.shown, self.n

    def add(self, other: Stats) -> None:
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.places |= other.places
        self.shown |= other.shown
        self.heads |= other.heads
        self.words, self.linked, self.n = self.words + other.words, self.linked + other.linked, self.n + other.n

    def goes(self) -> bool:
        """Constant, or outside articles a list of links or one of few texts that come again."""
        pages = self.places.bit_count()
        if self.low == self.high:
            return pages >= (SUPPORT_INSIDE if self.inner else SUPPORT)
        return not self.inner and (2 * self.linked > self.words or pages >= RECURRING and 2 * self.shown.bit_count() <= pages)


def _tally(pages: Iterable[tuple[str, str]]) -> Iterator[tuple[dict, dict]]:
    """({(host, layout): [packed tree, pages]}, {(host, layout, key): stats}), some at a time."""
    trees: dict[tuple[str, int], list] = {}
    seen: dict[tuple[str, int, int], Stats] = {}
    for name, page in pages:
        found = boxes(parse(page))
        tree = packed(found)
        kind = _hash(tree)
        said = [(box.key, *box.said(), box.real[0].inner) for box in found]
        place = 1 << (_hash("\x1f".join(x[1] for x in said).encode("utf-8", "surrogatepass")) & 63)
        trees.setdefault((name, kind), [tree, 0])[1] += 1
        for key, text, linked, heads, inner in said:
            if text:
                h = _hash(text.encode("utf-8", "surrogatepass"))
                own = Stats(h, h, place, inner, text.count(" ") + 1, linked, heads, 1 << (h & 63), 1)
                have = seen.setdefault((name, kind, key), own)
                if have is not own:
                    have.add(own)
        if len(seen) > 100_000:
            yield trees, seen
            trees, seen = {}, {}
    yield trees, seen


def slot(data: bytes, stats: dict[int, Stats]) -> tuple[set[int], int | None]:
    """(keys of what goes, key of the slot or None) of a layout, from the stats of the containers its own are aligned with."""
    tree = Tree(data)
    gone = {key for key, s in stats.items() if s.goes()}
    words = [stats[k].words / stats[k].n if k in stats and k not in gone else 0.0 for k in tree.key]
    heads = [k in stats and k not in gone and stats[k].heads for k in tree.key]
    inside, head_inside = words[:], heads[:]
    for i in range(len(words) - 1, 0, -1):
        inside[tree.above[i]] += inside[i]
        head_inside[tree.above[i]] |= head_inside[i]
    at = max(range(len(words)), key=lambda i: words[i])
    while at and tree.above[at] >= 0:
        above = tree.above[at]
        if not words[above] and not any(head_inside[k] for k in tree.kids[above] if k != at):
            break
        at = above
    clear = inside[at] >= SLOT_WORDS and inside[at] >= DOMINANT * (inside[0] - inside[at])
    return gone, tree.key[at] if at and clear else None


Wrapper = tuple[set[int], int | None]


def induce(pages: list[str]) -> dict[int, Wrapper]:
    """The wrapper of one host whose pages are at hand, {layout: (keys of what goes, key of the slot)}; as ``wrappers``."""
    trees: dict[int, list] = {}
    seen: dict[tuple[int, int], Stats] = {}
    for kinds, part in _tally(("", p) for p in pages if p):
        for (_, kind), (tree, n) in kinds.items():
            trees.setdefault(kind, [tree, 0])[1] += n
        for (_, kind, key), have in part.items():
            seen.setdefault((kind, key), Stats(have.low, have.high, inner=have.inner)).add(have)
    if not trees:
        return {}
    reference = trees[max(trees, key=lambda k: (trees[k][1], k))][0]
    place = {kind: dict(zip(*aligned(reference, tree), strict=True)) for kind, (tree, _) in trees.items()}
    whole: dict[int, Stats] = {}
    for (kind, key), have in seen.items():
        total = whole.setdefault(place[kind][key], Stats(have.low, have.high))
        total.add(have)
        total.inner |= have.inner
    own: dict[int, dict[int, Stats]] = {}
    for kind, key in seen:
        own.setdefault(kind, {})[key] = whole[place[kind][key]]
    many = _pages(whole.values()) >= SUPPORT
    out = {kind: slot(trees[kind][0], stats) if many else (set(), None) for kind, stats in own.items()}
    return {kind: found for kind, found in out.items() if found[0] or found[1] is not None}


def _pages(stats: Iterable[Stats]) -> int:
    places = 0
    for s in stats:
        places |= s.places
    return places.bit_count()


def _articles(root: Node, tags: tuple[str, ...] = ("article", "main", "body")) -> list[Node]:
    """By roles alone: outermost articles, else mains, else bodies, else the page."""
    for tag in tags:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                found.append(node)
            elif not node.marked:
                stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
        if found:
            return found
    return [root]


def blocks(nodes: list[Node], kept: dict[int, bool] | None = None) -> list[str]:
    """Lines of text below the nodes; ``kept`` says of containers whether their own text stays."""
    kept = kept or {}
    out: list[str] = []
    now: list[str] = []

    def flush():
        if now:
            line = " ".join(entities.unescape("".join(now)).split())
            if line:
                out.append(line)
            now.clear()

    for node in nodes:
        stack: list = [(node, True)]
        while stack:
            x, keep = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                if keep:
                    now.append(x)
            elif x.tag == "br":
                now.append(" ")
            elif not x.marked or x is node and x.tag not in DROPPED:
                keep = kept.get(id(x), keep)
                if x.tag in BLOCK:
                    flush()
                    stack.append((None, keep))
                elif x.tag in ("td", "th"):
                    stack.append((" ", keep))
                stack.extend((c, keep) for c in reversed(x.children))
        flush()
    return out


def main_text(page: str | None, wrapper: dict[int, Wrapper] | None = None) -> str:
    """The main text of one page by its host's wrapper, or by roles alone."""
    if not page:
        return ""
    root = parse(page)
    found = boxes(root) if wrapper else []
    gone, key = (wrapper or {}).get(_hash(packed(found)), (set(), None)) if found else (set(), None)
    held = next((box for box in found if box.key == key), None) if key is not None else None
    if held is None or held.real[0].tag in ("body", "html"):
        nodes = _articles(root)
    else:
        nodes = held.real
        if not held.real[0].inner:  # the slot lies around an article: what that holds
            nodes = [x for node in nodes for x in _articles(node, ("article", "main"))] or nodes
    kept = {id(n): box.key not in gone for box in found for n in box.real} if gone else {}
    return "\n\n".join(kept and blocks(nodes, kept) or blocks(nodes))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


_STATS = "low long, high long, places long, inner boolean, words long, linked long, heads boolean, shown long, pages long"
_SEEN = f"host string, layout long, tree binary, n long, key long, {_STATS}"
def _added_up() -> list[Column]:
    """How stats of the same container add up."""
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("places").alias("places"), F.bool_or("inner").alias("inner"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.bool_or("heads").alias("heads"), F.bit_or("shown").alias("shown"), F.sum("pages").alias("pages")]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = ((r["host"], r["html"]) for big in batches for lo in range(0, big.num_rows, 256) for r in big.slice(lo, 256).to_pylist())
    for trees, seen in _tally(pages):
        rows = [(h, k, tree, n, *[None] * 10) for (h, k), (tree, n) in trees.items()]
        rows += [(h, k, None, None, key, s.low, s.high, _signed(s.places), s.inner, s.words, s.linked, s.heads, _signed(s.shown), s.n) for (h, k, key), s in seen.items()]
        if rows:
            names, kinds = zip(*[c.split() for c in _SEEN.split(", ")], strict=True)
            arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes and the slot of every layout, from its tree and the stats of its containers."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            stats = {x["key"]: Stats(x["low"], x["high"], x["places"] & _ALL, x["inner"], x["words"], x["linked"], x["heads"], x["shown"] & _ALL, x["pages"]) for x in r["stats"]}
            gone, key = slot(r["tree"], stats)
            if gone or key is not None:
                out.append((r["host"], r["layout"], sorted(gone), key))
        if out:
            types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["host", "layout", "keys", "slot"])


_ALL = (1 << 64) - 1


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            keys, partners = aligned(r["reference"], r["tree"])
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([r["host"]] * n, pa.string()), pa.array([r["layout"]] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(partners, pa.int64())], ["host", "layout", "key", "partner"])


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, layout, keys of what goes, key of the slot) of every layout of hosts with several different pages."""
    rows = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> '' AND html <> ''")
    seen = rows.mapInArrow(_count, _SEEN)
    # a null key marks the row of the layout itself; its tree is the same in all tasks
    nodes = seen.groupBy("host", "layout", "key").agg(F.first("tree", True).alias("tree"), F.sum("n").alias("n"), *_added_up())
    nodes = C.materialize(nodes, "nodes")
    layouts = nodes.where("key IS NULL").select("host", "layout", "tree", "n")
    most = layouts.groupBy("host").agg(F.max(F.struct("n", "layout")).alias("m")).select("host", F.col("m.layout").alias("layout"))
    reference = C.materialize(layouts.select("host", "layout", F.col("tree").alias("reference")).join(most, ["host", "layout"]).drop("layout"), "references")
    size = reference.agg(F.coalesce(F.sum(F.octet_length("reference") + F.octet_length("host") + 64), F.lit(0)).alias("n")).first().n
    side = F.broadcast(reference) if size <= BROADCAST_BYTES else reference
    place = layouts.select("host", "layout", "tree").join(side, "host").mapInArrow(_align, "host string, layout long, key long, partner long")
    said = C.materialize(nodes.where("key IS NOT NULL").drop("tree", "n").join(place, ["host", "layout", "key"]), "aligned")
    several = said.groupBy("host").agg(F.bit_count(F.bit_or("places")).alias("k")).where(f"k >= {SUPPORT}").select("host")
    whole = said.groupBy("host", "partner").agg(*_added_up()).join(several, "host")
    whole = C.one_side(whole, said.count(), 120, "whole", BROADCAST_BYTES)
    stats = said.select("host", "layout", "key", "partner").join(whole, ["host", "partner"])
    names = [c.split()[0] for c in _STATS.split(", ")]
    # the containers of one layout together, as one page has them
    by_layout = stats.groupBy("host", "layout").agg(F.collect_list(F.struct("key", *names)).alias("stats"))
    out = layouts.select("host", "layout", "tree").join(by_layout, ["host", "layout"]).select("host", "layout", "tree", "stats")
    out = C.materialize(out.mapInArrow(_slots, "host string, layout long, keys array<long>, slot long"), "wrappers")
    C.drop(nodes, reference, said)
    return out


ADDED = ("_host", "_layout", "_keys", "_slot")


def _layouts(batches: Iterator[pa.RecordBatch], html: str) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 256):
            batch = big.slice(lo, 256)
            kinds = [_hash(packed(boxes(parse(p)))) if p and h else None for p, h in zip(batch.column(html).to_pylist(), batch.column("_host").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.int64())], [*batch.schema.names, "_layout"])


def _extract(batches: Iterator[pa.RecordBatch], html: str, known) -> Iterator[pa.RecordBatch]:
    """Texts by the wrappers of all hosts at hand, or by those joined to the rows."""
    for big in batches:
        for lo in range(0, big.num_rows, 256):
            batch = big.slice(lo, 256)
            pages = batch.column(html).to_pylist()
            if known is not None:
                mine = [known.value.get(h) for h in batch.column("_host").to_pylist()]
            else:
                mine = [{k: (set(x), at)} if x is not None else None for k, x, at in zip(*[batch.column(c).to_pylist() for c in ADDED[1:]], strict=True)]
            texts = [main_text(page, wrapper) for page, wrapper in zip(pages, mine, strict=True)]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (*ADDED, html)]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*[n for n, _ in rest], "text", "n_chars"])


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The rows of ``pages`` with text and n_chars in place of the html.

    Wrappers of a checked size go to all tasks, which then read every page once; larger ones
    are joined to the pages by host and layout.
    """
    spark = pages.sparkSession
    C.narrow_batches(spark)
    found = wrappers(pages, url, html)
    size = found.agg(F.coalesce(F.sum(F.size("keys") * 40 + F.octet_length("host") + 200), F.lit(0)).alias("n")).first().n
    rows = pages.drop(*[c for c in ("text", "n_chars") if c != html]).withColumn("_host", host(F.col(url)))
    fields = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    known = None
    if size <= BROADCAST_BYTES:
        table: dict[str, dict[int, Wrapper]] = {}
        for r in found.collect():
            table.setdefault(r.host, {})[r.layout] = set(r["keys"]), r.slot
        known = spark.sparkContext.broadcast(table)
    else:
        side = found.select(F.col("host").alias("_host"), F.col("layout").alias("_layout"), F.col("keys").alias("_keys"), F.col("slot").alias("_slot"))
        rows = rows.mapInArrow(lambda it: _layouts(it, html), fields(rows) + ", _layout long").join(side, ["_host", "_layout"], "left")
    schema = ", ".join([fields(rows.drop(*ADDED, html)), "text string", "n_chars long"]).removeprefix(", ")
    return rows.mapInArrow(lambda it: _extract(it, html, known), schema)


def op6_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
