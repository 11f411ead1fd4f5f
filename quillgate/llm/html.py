"""Operator 8: main text of web pages by wrappers inferred as union-free regular expressions.

A page is a stream of tags and texts.  Streams of one host are aligned one after another: where they agree the
wrapper keeps the token; where two texts differ it gets a text slot; tags that one side lacks become an optional
group; runs of like siblings fold into a repeated group.  There are no unions, so the order of alignment only
matters in odd cases, and partial wrappers of many tasks align into one as pages do.

The wrapper finds the article.  Each of its nodes knows how much text outside links it holds that varies from page
to page (slots), and how much is the same on all.  A page is matched with the wrapper from the root on, and the way
leads into the group that draws most of the varying text to itself, until none does or the group is an article.
What the page has there is its main text, less elements that their tag or a plain name marks as furniture; where such a
name is no proof, the wrapper decides.  A text is never dropped for being short, long, deep or a small part, and a name that
only holds a word of furniture (`notice-of-intent`) says nothing.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, look_up, prepare

# Elements by what they mean for a text's flow.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary"
    " table tbody td tfoot th thead tr ul caption option optgroup select".split()
)
DROPPED = frozenset(
    "head nav footer aside form button select option menu dialog search svg canvas object audio video map datalist"
    " script style textarea title noscript template iframe xmp noembed noframes".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary"}
# An element that starts closes these open ones, up to the given ancestors.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
# Words of class names, ids and roles that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside complementary footer contentinfo cookie cookies consent gdpr notice notices"
    " alert banner popup modal overlay dialog newsletter subscribe subscription signup login register search share"
    " sharing social related recommended recommendations comment comments disqus respond reply replies discussion"
    " widget pagination pager toolbar skip form masthead topbar".split()
)
# Words that say nothing beside these: a name of both kinds only is plain.
NEUTRAL = frozenset(
    "list section area box block wrapper wrap container inner outer content body item items main top bottom left right user reader readers page site thread count post unit slot group panel bar holder row col column".split()
)
#: Of the words of furniture, those whose plain names suffice; all others need evidence inside the article.
PROSE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments disqus respond sidebar aside"
    " complementary footer contentinfo newsletter".split()
)
MAIN_TAGS = ("article", "main")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^<>]*>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")

#: Characters of a constant that a wrapper shows; what is constant is told by digests of whole texts.
SHOWN = 40
#: Share of a container's varying text that draws the search into a group; weight of marked articles in it.
DOMINANT, MARKED = 0.7, 4.0
#: A container with a plain name of furniture goes if this share of its text lies in links.
LINKED = 0.5
#: Pairs of siblings that are compared at once; of longer lists, windows of this many siblings follow each other.
PAIRS, SPAN = 250_000, 400
#: Hosts whose wrappers a task holds at a time.
HOSTS_HELD = 512


def deep(f):
    """Let a recursive generator function call itself (`x = yield call`) to any depth: the calls wait on a list."""

    @wraps(f)
    def run(*args):
        calls, value = [f(*args)], None
        while calls:
            try:
                calls.append(calls[-1].send(value))
                value = None
            except StopIteration as done:
                calls.pop()
                value = done.value
        return value

    run.call = f
    return run


class Node:
    """An element: tag, label (tag and names), children (elements and texts).  On a wrapper also its mark, the pages
    that it was aligned from, and digests of up to two distinct ones, so that it is known whether there are two.
    `words` are those of furniture among a page's class, role and itemprop; ids are left out, as they often name a section's topic."""

    __slots__ = ("tag", "label", "kids", "mark", "chars", "links", "seen", "pages", "words")

    def __init__(self, tag: str, label: str, mark: str = "", seen: tuple[int, ...] = (), words: frozenset = frozenset(), pages: int = 1):
        self.tag, self.label, self.kids, self.mark, self.chars, self.links = tag, label, [], mark, 0, 0
        self.seen, self.words, self.pages = seen, words, pages


class Text:
    """A block's text; as part of a wrapper None stands for a slot, else `text` is the start of a constant, `digest`
    stands for the texts of a page there, and `varies` tells that they differ between pages, not only between siblings."""

    __slots__ = ("text", "mark", "chars", "links", "digest", "varies")

    def __init__(self, text: str | None, chars: int, links: int, mark: str = "", digest: int = 0, varies: bool = False):
        self.text, self.chars, self.links, self.mark, self.digest, self.varies = text, chars, links, mark, digest, varies


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


@lru_cache(20_000)
def _label(tag: str, attributes: str) -> tuple[str, frozenset]:
    """The element's name in wrappers, and its words of furniture.  The name has the tag and each of its names, numbers as
    #, so that numbered siblings are alike; ids are marked, as they often name a section's topic."""
    names = [(m[1].lower(), next(x for x in m.groups()[1:] if x is not None).lower()) for m in _NAMED.finditer(attributes)] if attributes else []
    tokens = {("@" if kind == "id" else "") + re.sub(r"[^a-z#]+", "-", re.sub(r"[0-9]+", "#", w)).strip("-") for kind, n in names for w in n.split()}
    label = ".".join([tag, *sorted(tokens - {"", "@"})])
    return label, furniture_words(label)


def parse(page: str | None) -> Node:
    """A balanced tree of block elements.  Inline elements only lend their text; `br` is a space; comments and
    raw elements vanish.  Elements left open end where their parents do."""
    root = Node("", "")
    stack: list[Node] = [root]
    opened: Counter = Counter()
    buffer: list[str] = []
    in_link, linked = 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                stack[-1].kids.append(Text(text, len(text), min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        chunk = page[at : m.start() if m else end]
        if chunk:
            buffer.append(chunk)
            if in_link:
                linked += len(chunk)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == "p" and not opened["p"]:
                flush()
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        flush()
                        close(i)
                        break
            continue
        if tag in RAW:
            over = _closing(tag).search(page, at)
            at = over.end() if over else end
            continue
        if tag == "a":
            in_link += 1
        elif tag == "br":
            buffer.append(" ")
        elif tag in BLOCK or tag in DROPPED:
            flush()
            in_link = 0
            if tag in CLOSES_P and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in ("table", "td", "th", "div", "article"):
                        break
            if tag in CLOSES:
                closed, until = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in closed) else ():
                    if stack[i].tag in until:
                        break
                    if stack[i].tag in closed:
                        close(i)
                        break
            if tag not in VOID and not (m[3] or "").endswith("/"):
                label, words = _label(tag, m[3] or "")
                node = Node(tag, label, words=words)
                stack[-1].kids.append(node)
                stack.append(node)
                opened[tag] += 1
    flush()
    return root


@lru_cache(32)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[^>]*>", re.I)


def barred(node: Node) -> bool:
    """Do the element's tag or names say by themselves that it is no part of an article?"""
    if node.tag in DROPPED:
        return True
    if node.tag in ("html", "body", "main", "") or node.tag in HEADINGS:
        return False
    words = node.words or furniture_words(node.label)
    if node.tag == "article":
        return bool(words & {"comment", "comments", "reply", "ad", "ads", "sponsored", "related", "promo"})
    return bool(words & PROSE)


@lru_cache(20_000)
def furniture_words(label: str) -> frozenset:
    """Words of furniture in the plain ones of an element's classes, roles and itemprops: those made of nothing else."""
    split = [t.split("-") for t in label.split(".")[1:] if not t.startswith("@")]
    return frozenset(w for parts in split if all(w in FURNITURE or w in NEUTRAL for w in parts) for w in parts) & FURNITURE


def semantic(node: Node) -> bool:
    """Does the element's tag or name say that it is the article?"""
    if node.tag in MAIN_TAGS:
        return not barred(node)
    return node.tag in ("div", "section") and bool({"articlebody", "main"} & set(re.split(r"[.@-]", node.label)[1:]))


# wrappers ------------------------------------------------------------------------------------------------------


def _digest(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=6).digest())


def content(root: Node) -> int:
    """A digest of the page's texts outside furniture: pages that differ only in furniture are one page."""
    texts, queue = [], [root]
    while queue:
        k = queue.pop()
        if isinstance(k, Text):
            texts.append(k.text)
        elif not barred(k):
            queue += reversed(k.kids)
    return _digest(*texts)


@deep
def generalise(node: Node | Text, page: int | None = None) -> Node | Text:
    """A page's tree as a wrapper of that page alone: runs of like siblings fold into repeated groups."""
    if isinstance(node, Text):
        return Text(node.text[:SHOWN], node.chars, node.links, digest=_digest(node.text))
    page = content(node) if page is None else page
    out = Node(node.tag, node.label, seen=(page,))
    kids = []
    for k in node.kids:
        kids.append((yield generalise.call(k, page)))
    out.kids = yield fold.call(kids)
    out.chars, out.links = sum(k.chars for k in out.kids), sum(k.links for k in out.kids)
    return out


def _name(k: Node | Text) -> str:
    return "#" if isinstance(k, Text) else k.label


def _shape(k: Node | Text) -> tuple:
    """Siblings fold if they are alike one level down too: an article between a menu and a footer is no repeated group."""
    if isinstance(k, Text):
        return ("#",)
    inner = {_name(x) for x in k.kids}
    return (k.label, *sorted(inner)) if inner - {"#"} and k.tag not in TEXTUAL else (k.label,)


@deep
def fold(kids: list) -> list:
    """Replace squares, of up to three siblings each, by repeated groups."""
    for width in (1, 2, 3):
        names, out, i = [_shape(k) for k in kids], [], 0
        while i < len(kids):
            j = i + width
            unit = names[i:j]
            while len(unit) == width and names[j : j + width] == unit and (width > 1 or unit != [("#",)]):
                j += width
            if j > i + width:
                merged = kids[i : i + width]
                for k in range(i + width, j, width):
                    for n in range(width):
                        merged[n] = yield align.call(merged[n], kids[k + n], True)
                for m in merged:
                    m.mark = "+"
                out += merged
                i = j
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def _mark(a: str, b: str) -> str:
    """Optional and repeated marks join: ? for optional, + for repeated, * for both."""
    both = {a, b}
    optional, repeated = bool(both & {"?", "*"}), bool(both & {"+", "*"})
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


@deep
def align(a, b, siblings: bool = False):
    """One wrapper for what either covers; a and b have the same name.  `siblings`: both stand on the same pages."""
    if isinstance(a, Text):
        differ = a.digest != b.digest
        digest = a.digest if not differ else _digest(a.digest, b.digest) if siblings else min(a.digest, b.digest)
        varies = a.varies or b.varies or (differ and not siblings)
        return Text(None if differ or a.text != b.text else a.text, a.chars + b.chars, a.links + b.links, _mark(a.mark, b.mark), digest, varies)
    seen = a.seen if a.seen == b.seen else tuple(sorted({*a.seen, *b.seen})[:2])
    out = Node(a.tag, a.label, _mark(a.mark, b.mark), seen, pages=max(a.pages, b.pages) if siblings else a.pages + b.pages)
    out.kids = yield _align_lists.call(a.kids, b.kids, siblings)
    out.chars, out.links = a.chars + b.chars, a.links + b.links
    return out


def _optional(k):
    k.mark = _mark(k.mark, "?")
    return k


@deep
def _align_lists(a: list, b: list, siblings: bool = False) -> list:
    """Align two lists of siblings.  On a mismatch what only one side has before the next agreement is optional."""
    names_a, names_b = [_name(k) for k in a], [_name(k) for k in b]
    if names_a == names_b:
        out = []
        for x, y in zip(a, b):
            out.append((yield align.call(x, y, siblings)))
        return out
    common = _agreements(names_a, names_b)
    out, i, j = [], 0, 0
    for x, y in [*common, (len(a), len(b))]:
        out += [_optional(k) for k in a[i:x]] + [_optional(k) for k in b[j:y]]
        if x < len(a):
            out.append((yield align.call(a[x], b[y], siblings)))
        i, j = x + 1, y + 1
    return (yield fold.call(out))


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two short lists, as index pairs."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of the first index a longest run in which the second one rises too."""
    ends: list[int] = []  # at k the last pair of the best run of k + 1
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j, key=lambda e: pairs[e][1])
        before[n] = ends[k - 1] if k else -1
        ends[k : k + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _agreements(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A common subsequence of names, as index pairs: equal ends first, then names that both sides have once as anchors,
    and between these a longest one.  Of long stretches without an anchor windows follow each other, so that time and
    memory grow with the siblings, not with their square; names that one side lacks cost nothing."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    inner_a, inner_b = Counter(a[lead : len(a) - tail]), Counter(b[lead : len(b) - tail])
    ia = [i for i in range(lead, len(a) - tail) if a[i] in inner_b]
    ib = [j for j in range(lead, len(b) - tail) if b[j] in inner_a]
    met = []
    if len(ia) * len(ib) <= PAIRS:
        met = [(ia[x], ib[y]) for x, y in _longest([a[i] for i in ia], [b[j] for j in ib])]
    else:
        once = {b[j]: j for j in ib if inner_b[b[j]] == 1}
        anchors = _rising([(i, once[a[i]]) for i in ia if inner_a[a[i]] == 1 and a[i] in once])
        x = y = 0
        for i, j in [*anchors, (len(a), len(b))]:
            upto_x, upto_y = bisect_left(ia, i), bisect_left(ib, j)
            met += [(ia[x + p], ib[y + q]) for p, q in _windows([a[k] for k in ia[x:upto_x]], [b[k] for k in ib[y:upto_y]])]
            if i < len(a):
                met.append((i, j))
            x, y = upto_x + 1, upto_y + 1
    return [(k, k) for k in range(lead)] + met + ends


def _windows(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A common subsequence of lists of any length: that of a window of each, of which the first half stands, and on."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        found = _longest(a[i : i + SPAN], b[j : j + SPAN])
        last = i + SPAN >= len(a) and j + SPAN >= len(b)
        kept = found if last else found[: max(1, len(found) // 2)]
        out += [(i + x, j + y) for x, y in kept]
        if last:
            break
        x, y = kept[-1] if kept else (SPAN // 2 - 1, SPAN // 2 - 1)
        i, j = i + x + 1, j + y + 1
    return out


def dump(node, pages: int) -> str:
    """Elements and texts in page order, elements with the number of their children; flat, so that depth is no matter."""
    out, queue = [], [node]
    while queue:
        k = queue.pop()
        if isinstance(k, Text):
            out.append(["#", k.mark, k.chars, k.links, k.text, k.digest, k.varies])
        else:
            out.append([k.label, k.mark, k.chars, k.links, len(k.kids), k.seen, k.pages])
            queue += reversed(k.kids)
    return json.dumps([pages, out], ensure_ascii=False)


def load(text: str) -> tuple[int, Node]:
    pages, packed = json.loads(text)
    top = Node("", "")
    lacking = [[top, 1]]
    for p in packed:
        while not lacking[-1][1]:
            lacking.pop()
        lacking[-1][1] -= 1
        if p[0] == "#":
            lacking[-1][0].kids.append(Text(p[4], p[2], p[3], p[1], p[5], p[6]))
            continue
        node = Node(p[0].split(".")[0], p[0], p[1], tuple(p[5]), pages=p[6])
        node.chars, node.links = p[2], p[3]
        lacking[-1][0].kids.append(node)
        lacking.append([node, p[4]])
    return pages, top.kids[0]


@deep
def expression(node) -> str:
    """The wrapper as a readable union-free regular expression."""
    if isinstance(node, Text):
        own = "#TEXT" if node.text is None else node.text
    else:
        inner = ""
        for k in node.kids:
            inner += yield expression.call(k)
        own = f"<{node.label}>{inner}</{node.tag}>"
    return f"({own}){node.mark}" if node.mark else own


# extraction ----------------------------------------------------------------------------------------------------


class Wrapper:
    """A host's (or one page's) wrapper, with the evidence of each of its nodes: characters outside links and furniture
    that vary between its pages, and all of them.  What only one distinct page has counts as varying."""

    def __init__(self, root: Node):
        self.root = root
        self.fresh: dict[int, float] = {}
        self.whole: dict[int, float] = {}
        self.marked: set[int] = set()  # nodes that hold an article by its tag or name
        self.headed: set[int] = set()  # nodes that hold a top heading that varies
        queue: list[tuple] = [(root, False)]
        while queue:
            k, after = queue.pop()
            if not after:
                queue.append((k, True))
                queue += [(x, False) for x in k.kids if isinstance(x, Node) and not barred(x)]
                continue
            fresh = whole = 0.0
            for x in k.kids:
                if isinstance(x, Text):
                    own = x.chars - x.links
                    fresh, whole = fresh + own * (x.varies or len(k.seen) < 2), whole + own
                else:
                    fresh, whole = fresh + self.fresh.get(id(x), 0.0), whole + self.whole.get(id(x), 0.0)
            inner = [id(x) for x in k.kids if isinstance(x, Node) and id(x) in self.fresh]
            if semantic(k) or any(x in self.marked for x in inner):
                self.marked.add(id(k))
            if k.tag != "header" and (any(x in self.headed for x in inner) or (k.tag == "h1" and any(isinstance(x, Text) and x.varies for x in k.kids))):
                self.headed.add(id(k))
            weight = MARKED if semantic(k) else 1.0
            self.fresh[id(k)], self.whole[id(k)] = weight * fresh, weight * whole
        # Where pages are near copies most of their text is the same, and being the same tells little.
        total = self.whole.get(id(root), 0.0)
        self.trust = self.fresh.get(id(root), 0.0) / total if total else 0.0

    def evidence(self, k: Node) -> float:
        """Per page that has the node."""
        fresh, whole = self.fresh.get(id(k), 0.0), self.whole.get(id(k), 0.0)
        return (fresh + (1 - self.trust) * (whole - fresh)) / max(k.pages, 1)

    def constant(self, k: Node) -> bool:
        """Is all text of the node the same on two distinct pages or more, on a host whose pages differ?"""
        return self.trust > 0.5 and len(k.seen) > 1 and self.whole.get(id(k), 0.0) > 0 and not self.fresh.get(id(k), 0.0)


def _matches(kids: list, own: list) -> list:
    """For each child of a page's element the wrapper's child that stands for it, or None: a longest common
    subsequence, in which a repeated group may stand for many.  Like shapes count double."""
    names, of = [_name(k) for k in kids], [_name(w) for w in own]
    place: dict[str, list[int]] = {}
    for j, name in enumerate(of):
        place.setdefault(name, []).append(j)
    if all(len(place.get(n, ())) <= 1 for n in set(names)):
        return [own[place[n][0]] if n in place else None for n in names]
    # Neither side's strangers take part; they have no match.
    known = set(names)
    mine, theirs = [i for i, n in enumerate(names) if n in place], [j for j, n in enumerate(of) if n in known]
    codes: dict = {}
    number = lambda values: np.array([codes.setdefault(v, len(codes)) for v in values], np.int64)
    a, b = number([("n", names[i]) for i in mine]), number([("n", of[j]) for j in theirs])
    x, y = number([("s", _shape(kids[i])) for i in mine]), number([("s", _shape(own[j])) for j in theirs])
    again = np.array([own[j].mark in ("+", "*") for j in theirs])
    out: list = [None] * len(kids)
    i = j = 0
    while i < len(a):
        # Long lists are matched window by window: the first half of one stands, and the next begins where it ends.
        whole = (len(a) - i) * (len(b) - j) <= PAIRS
        p, q = (len(a), len(b)) if whole else (min(i + SPAN, len(a)), min(j + 2 * SPAN, len(b)))
        found = _matched(a[i:p], b[j:q], x[i:p], y[j:q], again[j:q])
        upto = p if whole or p == len(a) else i + SPAN // 2
        for k, m in enumerate(found[: upto - i]):
            if m >= 0:
                out[mine[i + k]] = own[theirs[j + m]]
        met = [m for m in found[: upto - i] if m >= 0]
        i, j = upto, j + (met[-1] + (not again[j + met[-1]]) if met else 0)
    return out


def _matched(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, again: np.ndarray) -> list[int]:
    """For each of a the place in b that it takes, or -1."""
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        score = (b == a[i]) * (1 + (y == x[i]))
        take = np.where(score > 0, score + np.where(again, best[i + 1, :-1], best[i + 1, 1:]), 0)
        row = np.maximum(take, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, j = [], 0
    for i in range(n):
        if best[i, j] == best[i + 1, j]:  # no better with this child
            out.append(-1)
            continue
        while best[i, j] == best[i, j + 1]:
            j += 1
        out.append(j)
        j += not again[j]
    return out


def locate(root: Node, w: Wrapper) -> list[tuple[Node, Node | None]]:
    """The page's elements that hold its article, with the wrapper's nodes for them."""
    level: list[tuple[Node, Node | None]] = [(root, w.root)]
    while True:
        node = level[0][1]
        if node is None or semantic(node):
            return level
        groups: dict[int, tuple[Node, list]] = {}
        total, heads = 0.0, set()
        for element, own in level:
            for k, match in zip(element.kids, _matches(element.kids, own.kids if own is not None else [])):
                if isinstance(k, Text) or barred(k):
                    continue
                if match is None or k.tag in TEXTUAL:
                    total += _size(k) / len(level) if match is None else w.evidence(match)
                    heads.add(0)
                    continue
                groups.setdefault(id(match), (match, []))[1].append((k, match))
        for key, (match, _) in groups.items():
            total += w.evidence(match)
            if key in w.headed:
                heads.add(key)
        texts = [x for x in node.kids if isinstance(x, Text)]
        total += sum((x.chars - x.links) * (x.varies or len(node.seen) < 2) for x in texts) / max(node.pages, 1)
        best = max(groups.values(), key=lambda g: w.evidence(g[0]), default=None)
        if best is None or not total or w.evidence(best[0]) < DOMINANT * total:
            return level
        # The page's title may stand beside the body; 0 stands for titles and paragraphs of the container itself.
        if id(best[0]) not in w.marked and heads - {id(best[0])}:
            return level
        level = best[1]


def _size(node: Node) -> int:
    """Characters outside links and furniture."""
    total, queue = 0, [node]
    while queue:
        k = queue.pop()
        if isinstance(k, Text):
            total += k.chars - k.links
        elif not barred(k):
            queue += k.kids
    return total


def dropped(k: Node, match: Node | None, w: Wrapper, inside: bool) -> bool:
    """Is an element of the place that was found furniture?  `inside`: that is an article by its tag or name.  Plain names
    that are no proof decide only with evidence: the wrapper shows the same text on two distinct pages, or it is mostly
    links.  Headings and paragraphs stay, and so does whatever else an article holds."""
    if barred(k):
        return True
    if k.tag in HEADINGS or k.tag in ("html", "body", "main", "article"):
        return False
    same = match is not None and w.constant(match)
    if not inside and k.tag == "header" and same:
        return True
    if k.words:
        chars, links, queue = 0, 0, [k]
        while queue:
            x = queue.pop()
            if isinstance(x, Text):
                chars, links = chars + x.chars, links + x.links
            else:
                queue += x.kids
        return same or links >= LINKED * chars
    return not inside and same and k.tag not in TEXTUAL


def _texts(places: list, w: Wrapper) -> Iterator[str]:
    """Texts of the article in page order."""
    for node, own in places:
        inside = semantic(node)
        walks = [(iter(zip(node.kids, _matches(node.kids, own.kids if own is not None else []))), inside)]
        while walks:
            kids, inside = walks.pop()
            for k, match in kids:
                if isinstance(k, Text):
                    yield k.text
                elif not dropped(k, match, w, inside):
                    walks.append((kids, inside))
                    walks.append((iter(zip(k.kids, _matches(k.kids, match.kids if match is not None else []))), inside or semantic(k)))
                    break


@lru_cache(2_000)
def wrapper_of(text: str) -> Wrapper:
    return Wrapper(load(text)[1])


def extract(page: str | None, wrapper: str | None = None) -> str:
    """The main text: blocks in page order, joined by an empty line.  Without a wrapper the page is its own."""
    if not page:
        return ""
    root = parse(page)
    w = wrapper_of(wrapper) if wrapper else Wrapper(generalise(root))
    return "\n\n".join(_texts(locate(root, w), w))


def wrappers(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): each host's wrapper from all of its pages.  Tasks align the pages that they read, so a
    host with very many pages reaches the second alignment as one wrapper from each task, and that is done in
    two steps.  Pages without a host or without html give none."""
    prepare(df.sparkSession)
    rows = df.select(df[url].cast("string").alias("url"), df[page].cast("string").alias("html")).filter("html is not null")

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, Node]] = {}
        done: set[tuple[str, bytes]] = set()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([dump(n, c) for c, n in held.values()], pa.string())], names=["host", "wrapper"])

        for b in batches:
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (host := host_of(u)) is None:
                    continue
                page = (host, hashlib.blake2b(h.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if page in done:  # copies weigh nothing
                    continue
                done.add(page)
                one = generalise(parse(h))
                held[host] = (held[host][0] + 1, align(held[host][1], one)) if host in held else (1, one)
                if len(held) > HOSTS_HELD:
                    yield out()
                    held.clear()
                    done.clear()
        if held:
            yield out()

    def join(t: pa.Table) -> pa.Table:
        pages, whole = 0, None
        for text in sorted(t["wrapper"].to_pylist()):
            n, node = load(text)
            pages, whole = pages + n, node if whole is None else align(whole, node)
        return pa.table({"host": [t["host"][0].as_py()], "wrapper": [dump(whole, pages)]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    schema = "host string, wrapper string"
    parts = rows.mapInArrow(partly, schema).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    return parts.groupBy("host", "part").applyInArrow(join, schema).groupBy("host").applyInArrow(join, schema)


def main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row for each row of df: page_id, url, text, n_chars.

    A null or empty page has an empty text.  Whole pages are read and nothing of the article is capped; repeated
    rows give equal rows.  A page without a host is its own wrapper.  An empty table gives no rows.
    """
    rows = df.select(df[page_id].alias("page_id"), df[url].cast("string").alias("url"), df[page].cast("string").alias("html"))
    known = cut(wrappers(rows))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    joined = look_up(rows.withColumn("host", host), known, ["host"], known.count())
    packed = joined.select("page_id", "url", "wrapper", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, w) for w, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            n = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = packed.schema["page_id"].dataType.simpleString()
    return packed.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
