"""Main text of web pages by wrapper induction: the pages of a host are aligned by simple tree matching."""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import ready, table, written
from gradeloom.llm.url_filter import split_url

#: Templates of all hosts together are broadcast up to this size; larger ones are joined by host.
MAX_BROADCAST = 48 << 20
#: Counts of texts that a task holds before it hands them on.
MAX_COUNTS = 200_000
#: A template has nodes for so many levels of block elements; what is deeper belongs to the element at this level.
LEVELS = 100
#: Of an element with more children than this, all of one signature are folded into one.
MAX_SIBLINGS = 48
#: A template of more nodes than this gives up those that the fewest pages have.
MAX_NODES = 4000
#: Share of a page's varying prose that an element holds for the content to be sought inside it; with an article or main tag.
WITHIN, WITHIN_MARKED = 2 / 3, 1 / 4
#: An element that is named like a menu or an advert is content all the same if it holds this share of its pages' prose.
OVERRULES = 4 / 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "caption", "legend"}
#: An opening tag ends the nearest open one of these, but not beyond the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
UNSEEN = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title datalist noembed noframes xmp textarea".split())
CHROME = frozenset("nav footer aside form button select input label fieldset dialog menu".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption address table tbody thead tfoot tr caption hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist tooltip".split())
HINTS = frozenset("nav navbar menu footer sidebar ad ads adv promo banner gdpr consent notice popup modal overlay signup login respond reply replies disqus share sharing social related toolbar search hidden skip copyright alert toast widget masthead header pager outbrain taboola teaser".split())
STEMS = ("comment", "advert", "sponsor", "cookie", "newsletter", "subscri", "recommend", "breadcrumb", "paginat", "navig", "promo")
KEEPS = frozenset("has with no without content wrapper layout container body".split())
TITLES = frozenset("article post entry story headline title".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "place", "tag")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent, self.place = tag, attrs, [], parent, None


def parse(source: str) -> Node:
    """The element tree of a page; open elements end as the HTML standard implies, text is not yet decoded."""
    root = Node("#root")
    stack = [root]
    opened: Counter[str] = Counter()

    def cut(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def end(tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        if any(opened[t] > 0 for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    cut(k)
                    return
                if stack[k].tag in barrier:
                    return

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            stack[-1].children.append(source[at:])
            break
        if found.start() > at:
            stack[-1].children.append(source[at:found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1] or found[4]:  # an end tag
            if opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK and tag not in ("td", "th", "table"):
                        break
            continue
        attrs = found[3] or found[6] or ""
        if tag in CLOSES_P or tag == "p":
            end({"p"}, BLOCK - {"p"})
        if tag in ENDS:
            end(*ENDS[tag])
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = close.end() if close else size
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


@lru_cache(4096)
def hints(attrs: str) -> tuple[str, frozenset[str], bool]:
    """(first class names without digits, all parts of class, id and role, whether it is hidden)."""
    kind, parts, hidden = "", set(), False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            kind = re.sub(r"\d+", "", " ".join(value.split()[:2]))
        if name in ("class", "id"):
            parts |= {x.lower() for x in _PART.findall(value)}
        elif name == "role":
            parts |= {f"role={x}" for x in value.lower().split()}
        elif name == "itemprop":
            parts |= {f"itemprop={value.lower()}"}
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return kind, frozenset(parts), hidden


@lru_cache(8192)
def kind(tag: str, attrs: str) -> str:
    """"unseen" (never shown), "chrome" (by tag or role), "named" (by class or id), "marked" (as the article) or "" """
    if tag in UNSEEN:
        return "unseen"
    kinds, parts, hidden = hints(attrs) if attrs and tag not in ("html", "body") else ("", frozenset(), False)
    if hidden:
        return "unseen"
    if tag in CHROME or any(f"role={r}" in parts for r in ROLES):
        return "chrome"
    marked = tag in ("article", "main") or "itemprop=articlebody" in parts or "role=main" in parts
    if marked or tag in ("p", "h1"):
        said = {x for x in parts if x.startswith(("comment", "advert", "cookie", "sponsor")) or x in ("ad", "ads", "notice", "alert", "teaser", "related")}
    else:
        said = {x for x in parts if x in HINTS or x.startswith(STEMS)}
        if said == {"header"} and parts & TITLES or said <= {"sidebar", "header", "footer", "nav", "menu"} and parts & KEEPS:
            said = set()
    return "named" if said else "marked" if marked else ""


@dataclass(slots=True)
class Block:
    text: str
    owner: Node
    linked: int  # characters inside links
    chrome: bool  # below a menu, a footer, a form and the like
    named: Node | None  # the outermost element above it that is named like one


def blocks(root: Node) -> list[Block]:
    """Every block of text that is shown, in page order. Inline elements that are chrome, or named so, count as a blank."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0

    def flush(owner: Node, chrome: bool, named: Node | None) -> None:
        nonlocal linked
        if pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                out.append(Block(text, owner, min(linked, len(text)), chrome, named))
            pieces.clear()
        linked = 0

    stack = [(iter(root.children), root, root, False, False, False, None)]  # children, element, block element, in a link, in the article, chrome, named
    while stack:
        children, node, owner, link, inside, chrome, named = stack[-1]
        for child in children:
            if isinstance(child, str):
                pieces.append(child)
                linked += len(child.strip()) if link else 0
                continue
            what, block = kind(child.tag, child.attrs), child.tag in BLOCK
            if child.tag == "br" or what and what != "marked" and not block:
                pieces.append(" ")
            elif what == "unseen":
                flush(owner, chrome, named)
            elif block:
                flush(owner, chrome, named)
                own = chrome or what == "chrome" or child.tag == "header" and not inside
                stack.append((iter(child.children), child, child, link, inside or what == "marked", own, named or (child if what == "named" else None)))
                break
            else:
                if child.tag in ("td", "th"):
                    pieces.append(" ")
                stack.append((iter(child.children), child, owner, link or child.tag == "a", inside, chrome, named))
                break
        else:
            stack.pop()
            if node is owner:
                flush(owner, chrome, named)
            elif node.tag in ("td", "th"):
                pieces.append(" ")
    return out


# -- templates -------------------------------------------------------------------------------------
# A shape is (signature, (shapes of the children)), with neighbours of one shape, or paragraphs, items and
# rows of one signature, folded into one list node. A template is (shape, pages that have each node, by preorder place). Texts and prose are counted
# at its nodes in a second pass over the pages.


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)  # a long


def skeleton(root: Node) -> tuple[tuple, list[int]]:
    """(shape, parents by preorder place) of the page's block elements but chrome; each element gets its place."""
    parents: list[int] = []

    def build(node: Node, level: int) -> list:
        """[signature, children, elements, shape]: like neighbours are one child."""
        down: list[list] = []
        for child in _inner(node) if level < LEVELS else ():
            own = build(child, level + 1)
            if down and down[-1][0] == own[0] and (child.tag in LEAVES or down[-1][3] == own[3]):
                absorb(down[-1], own)
            else:
                down.append(own)
        if len(down) > MAX_SIBLINGS:
            down = together(down)
        sign = _signature(node)
        return [sign, down, [node], (sign, tuple([x[3] for x in down]))]

    def together(down: list[list]) -> list[list]:
        first: dict[str, list] = {}
        for own in down:
            if own[0] in first:
                absorb(first[own[0]], own)
            else:
                first[own[0]] = own
        return list(first.values())

    def absorb(into: list, own: list) -> None:
        into[2] += own[2]
        if into[3] == own[3]:
            for x, y in zip(into[1], own[1], strict=True):
                absorb(x, y)
        else:
            into[1] = together(into[1] + own[1])
            into[3] = (into[0], tuple([x[3] for x in into[1]]))

    def number(own: list, parent: int) -> None:
        place = len(parents)
        parents.append(parent)
        for node in own[2]:
            node.place = place
        for x in own[1]:
            number(x, place)

    made = build(root, 0)
    number(made, -1)
    return made[3], parents


def _signature(node: Node) -> str:
    """Tag, first class names without digits, and a mark of what the element is by its name."""
    what = kind(node.tag, node.attrs)
    said = hints(node.attrs)[0] if node.attrs else ""
    return f"{node.tag}.{said}{'!' if what == 'named' else '*' if what == 'marked' else ''}"


def _inner(node: Node) -> Iterator[Node]:
    """The nearest block elements below, but chrome and what isn't shown."""
    stack = [iter(node.children)]
    while stack:
        for child in stack[-1]:
            if not isinstance(child, str) and (what := kind(child.tag, child.attrs)) not in ("unseen", "chrome"):
                if child.tag in BLOCK:
                    yield child
                elif child.children and what != "named":
                    stack.append(iter(child.children))
                    break
        else:
            stack.pop()


def _place(node: Node) -> int:
    """The place of the element, or of the nearest one above it that has one."""
    at = node
    while at.place is None:
        at = at.parent
    while node is not at:
        node.place, node = at.place, node.parent
    return at.place


@lru_cache(8192)
def matching(a: tuple, b: tuple) -> int:
    """Simple tree matching: the most nodes that two trees can share in order, from equal roots on."""
    if a[0] != b[0]:
        return 0
    return 1 + _grid(a[1], b[1])[-1][-1]


def _grid(a: tuple, b: tuple) -> list[list[int]]:
    grid = [[0] * (len(b) + 1)]
    for x in a:
        above, row = grid[-1], [0]
        for j, y in enumerate(b):
            row.append(max(above[j + 1], row[j], above[j] + matching(x, y)))
        grid.append(row)
    return grid


@lru_cache(8192)
def _size(shape: tuple) -> int:
    return 1 + sum(map(_size, shape[1]))


@lru_cache(2048)
def union(a: tuple, b: tuple) -> tuple[tuple, tuple, tuple]:
    """(the aligned tree of both, places of a's nodes in it, places of b's nodes)."""
    in_a, in_b, count = [0] * _size(a), [0] * _size(b), 0

    def copy(shape: tuple, at: int, into: list[int]) -> tuple:
        nonlocal count
        into[at] = count
        count += 1
        below, made = at + 1, []
        for x in shape[1]:
            made.append(copy(x, below, into))
            below += _size(x)
        return (shape[0], tuple(made))

    def both(x: tuple, i: int, y: tuple, j: int) -> tuple:
        nonlocal count
        in_a[i] = in_b[j] = count
        count += 1
        grid = _grid(x[1], y[1])
        p, q, steps = len(x[1]), len(y[1]), []
        while p or q:
            if p and q and (m := matching(x[1][p - 1], y[1][q - 1])) and grid[p][q] == grid[p - 1][q - 1] + m:
                p, q = p - 1, q - 1
                steps.append((p, q))
            elif p and grid[p][q] == grid[p - 1][q]:
                p -= 1
                steps.append((p, None))
            else:
                q -= 1
                steps.append((None, q))
        begin_x, begin_y = [i + 1], [j + 1]
        for s in x[1]:
            begin_x.append(begin_x[-1] + _size(s))
        for s in y[1]:
            begin_y.append(begin_y[-1] + _size(s))
        made = []
        for p, q in reversed(steps):
            if p is None:
                made.append(copy(y[1][q], begin_y[q], in_b))
            elif q is None:
                made.append(copy(x[1][p], begin_x[p], in_a))
            else:
                made.append(both(x[1][p], begin_x[p], y[1][q], begin_y[q]))
        return (x[0], tuple(made))

    made = both(a, 0, b, 0)
    return made, tuple(in_a), tuple(in_b)


def merged(a: tuple | None, b: tuple) -> tuple:
    """Two templates aligned and added up; beyond ``MAX_NODES`` nodes those of the fewest pages go."""
    if a is None:
        return b
    if a[0] == b[0]:
        return a[0], tuple(x + y for x, y in zip(a[1], b[1], strict=True))
    shape, in_a, in_b = union(a[0], b[0])
    pages = [0] * _size(shape)
    for own, into in ((a[1], in_a), (b[1], in_b)):
        for n, k in zip(own, into, strict=True):
            pages[k] += n
    return (shape, tuple(pages)) if len(pages) <= MAX_NODES else _pruned(shape, pages)


def _pruned(shape: tuple, pages: list[int]) -> tuple:
    """The template without nodes of few pages: half of ``MAX_NODES`` stay, or those above them if as many pages have more."""
    least = sorted(pages, reverse=True)[MAX_NODES // 2]
    kept: list[int] = []

    def cut(at: tuple, place: int) -> tuple:
        kept.append(pages[place])
        below, made = place + 1, []
        for x in at[1]:
            if pages[below] > least:
                made.append(cut(x, below))
            below += _size(x)
        return (at[0], tuple(made))

    return cut(shape, 0), tuple(kept)


def page_template(root: Node) -> tuple:
    shape, parents = skeleton(root)
    return shape, (1,) * len(parents)


def aligned(template: tuple, shape: tuple) -> dict[int, int]:
    """Place in the template by place in a page's shape, for the nodes that both have."""
    if shape == template[0]:
        return {k: k for k in range(_size(shape))}
    _, own, into = union(template[0], shape)
    known = {u: k for k, u in enumerate(own)}
    return {p: known[u] for p, u in enumerate(into) if u in known}


# -- wrappers: what each node of a host's template is ------------------------------------------------


def page_counts(found: list[Block], into: dict[int, int], parents: list[int]) -> tuple[dict[int, list[int]], dict[tuple[int, int], int]]:
    """By template node of a page: [1, characters outside links, in links, of the whole page outside links and named elements];
    by node and text hash: the text's length."""
    total = sum(len(b.text) - b.linked for b in found if not b.chrome and b.named is None)
    nodes = {k: [1, 0, 0, total] for k in into.values()}
    texts: dict[tuple[int, int], int] = {}
    for b in found:
        if not b.chrome:
            place = _place(b.owner)
            if place in into:
                texts[into[place], digest(b.text)] = len(b.text)
            while place not in into:
                place = parents[place]  # the root is in every template
            own = nodes[into[place]]
            own[1] += len(b.text) - b.linked
            own[2] += b.linked
    return nodes, texts


@dataclass(frozen=True)
class Wrapper:
    shape: tuple
    fixed: list[set[int]]  # texts that are constant at each node
    content: list[bool]  # whether a node is inside the content
    root: list[str]  # "": not the content's outermost element, else "root" or "marked"
    named: frozenset[int]  # named elements that are content all the same


def induce(shape: tuple, counts: Iterable[tuple[int, int | None, int, int, int, int]], share: float, least: int) -> Wrapper:
    """What the nodes of a template are, by what all of the host's pages have there.

    ``counts``: (node, None, pages, prose, linked, total) sums of ``page_counts``, and (node, text hash, pages,
    characters, 0, 0). A text that ``share`` of the pages with a node have there, of ``least`` pages or more, is constant.
    The rest varies. The content is the innermost container that holds ``WITHIN`` of its pages' varying prose,
    ``WITHIN_MARKED`` if it is tagged as the article, which isn't searched further.
    """
    size = _size(shape)
    fixed: list[set[int]] = [set() for _ in range(size)]
    pages, prose, linked, total = ([0.0] * size for _ in range(4))
    texts = []
    for node, text, n, a, b, c in counts:
        if text is None:
            pages[node], prose[node], linked[node], total[node] = n, a, b, c
        else:
            texts.append((node, text, n, a))
    constant = 0
    for node, text, n, chars in texts:
        if pages[node] >= least and n >= share * pages[node]:
            fixed[node].add(text)
            prose[node] -= min(chars, prose[node])
            constant += chars
    each = constant / max(1, pages[0])  # constant characters of a page
    content, root, named = [False] * size, [""] * size, set()

    def sums(at: tuple, place: int) -> tuple[float, float, float, int]:
        """(varying prose, linked characters, of named elements that aren't content, end of the places) below."""
        a, b, place_ = prose[place], linked[place], place + 1
        for x in at[1]:
            more, links, place_ = below(x, place_)
            a, b = a + more, b + links
        whole[place] = (a, b)
        return a, b, place_

    def below(at: tuple, place: int) -> tuple[float, float, int]:
        a, b, end = sums(at, place)
        if at[0].endswith("!"):
            if a <= b or a < OVERRULES * (a + max(0.0, total[place] - each * pages[place])):
                return 0.0, 0.0, end
            named.add(place)
            extra[place] = a
        return a, b, end

    def seek(at: tuple, place: int, more: float) -> bool:
        """Marks the content's outermost elements at or below this one; False if it holds too little."""
        tag, mark = at[0].split(".")[0], at[0][-1]
        if mark == "!" and place not in named:
            return False
        more += extra.get(place, 0.0)  # the total is without named elements
        of = max(0.0, total[place] - each * pages[place]) + more
        enough = whole[place][0] >= (WITHIN_MARKED if mark == "*" else WITHIN) * of and whole[place][0] >= whole[place][1]
        if place and (tag in LEAVES or not enough or not whole[place][0]):
            return False
        inner, place_ = False, place + 1
        if mark != "*":
            for x in at[1]:
                inner |= seek(x, place_, more)
                place_ += _size(x)
        if not inner:
            root[place] = "marked" if mark == "*" else "root"
            fill(at, place, mark == "*")
        return True

    def fill(at: tuple, place: int, marked: bool) -> None:
        if at[0].endswith("!") and place not in named:
            return
        content[place] = marked or not linked[place] or prose[place] >= linked[place]
        below_ = place + 1
        for x in at[1]:
            fill(x, below_, marked)
            below_ += _size(x)

    whole: list[tuple[float, float]] = [(0.0, 0.0)] * size
    extra: dict[int, float] = {}
    below(shape, 0)
    seek(shape, 0, 0.0)
    return Wrapper(shape, fixed, content, root, frozenset(named))


def own_wrapper(found: list[Block], shape: tuple, parents: list[int]) -> Wrapper:
    """The wrapper of a page that stands alone."""
    nodes, _ = page_counts(found, {k: k for k in range(len(parents))}, parents)
    return induce(shape, [(k, None, *x) for k, x in nodes.items()], 1.0, 2)


# -- pages -----------------------------------------------------------------------------------------


def main_text(source: str | None, wrapper: Wrapper | None = None) -> str:
    """The content's blocks joined by one line feed.

    ``wrapper``: of the page's host; without it, or if it has no content node that the page has too, of the page
    alone. Constant blocks go, unless most of an element tagged as the article is constant, as when pages
    of a host hold copies of one article. A heading of the first level outside the content stays if the content has none.
    """
    if not source:
        return ""
    top = parse(source)
    found = blocks(top)
    shape, parents = skeleton(top)
    into: dict[int, int] = {}
    if wrapper is not None:
        into = aligned((wrapper.shape,), shape)
    if wrapper is None or not any(wrapper.root[k] for k in into.values()):
        wrapper, into = own_wrapper(found, shape, parents), {k: k for k in range(len(parents))}
    marked = any(wrapper.root[k] == "marked" for k in into.values())

    def at(node: Node) -> tuple[int, bool]:
        """(template node of the element or of the nearest one above that it has, whether that is the element's own)."""
        place = _place(node)
        if place in into:
            return into[place], True
        while place not in into:
            place = parents[place]
        return into[place], False

    kept: list[tuple[Block, bool]] = []
    heads: list[Block] = []
    for b in found:
        if b.chrome or b.named is not None and at(b.named)[0] not in wrapper.named:
            continue
        node, own = at(b.owner)
        constant = own and digest(b.text) in wrapper.fixed[node]
        if wrapper.content[node]:
            kept.append((b, constant))
        elif b.owner.tag == "h1" and not constant and not marked:
            heads.append(b)
    if marked and 2 * sum(len(b.text) for b, constant in kept if constant) > sum(len(b.text) for b, _ in kept):
        kept = [(b, False) for b, _ in kept]
    if any(b.owner.tag == "h1" for b, _ in kept):
        heads = []
    stay = {id(b) for b, constant in kept if not constant} | {id(b) for b in heads}
    return "\n".join(b.text for b in found if id(b) in stay)


def _templates(pages: DataFrame) -> DataFrame:
    """(host, template): all pages of a host aligned; first inside each task, then by host and task group, then by host."""

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple] = {}
        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                if text := source.as_py():
                    h = host.as_py()
                    own[h] = merged(own.get(h), page_template(parse(text)))
            if len(own) > 5000:  # keep memory bounded however many hosts there are
                yield out(own)
                own = {}
        yield out(own)

    def out(own: dict[str, tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([pickle.dumps(x) for x in own.values()], pa.binary())], names=["host", "template"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in sorted(group["template"]):
            total = merged(total, pickle.loads(x))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [pickle.dumps(total)]})

    part = pages.select("host", "_html").mapInArrow(merging, "host string, template binary").withColumn("_group", F.spark_partition_id() % 64)
    part = part.groupBy("host", "_group").applyInPandas(lambda g: added(g), "host string, template binary")
    return part.groupBy("host").applyInPandas(lambda g: added(g), "host string, template binary")


def _counts(pages: DataFrame, held: Broadcast | None, share: float, least: int) -> DataFrame:
    """(host, counts): for ``induce``, the sums of every node of the host's template and the exact counts of the texts that are constant there."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, tuple] = {}
        seen: dict[tuple, list[int]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                if not (source := batch.column(1)[k].as_py()):
                    continue
                host = batch.column(0)[k].as_py()
                if host not in read:
                    if len(read) > 5000:
                        read.clear()
                    read[host] = pickle.loads(held.value[host] if held is not None else batch.column(2)[k].as_py())
                top = parse(source)
                shape, parents = skeleton(top)
                nodes, texts = page_counts(blocks(top), aligned(read[host], shape), parents)
                for node, own in nodes.items():
                    sums = seen.setdefault((host, node, None), [0, 0, 0, 0])
                    for j, x in enumerate(own):
                        sums[j] += x
                for (node, text), size in texts.items():
                    sums = seen.setdefault((host, node, text), [0, 0, 0, 0])
                    sums[0] += 1
                    sums[1] += size
                if len(seen) > MAX_COUNTS:
                    yield out(seen)
                    seen = {}
        yield out(seen)

    def out(seen: dict[tuple, list[int]]) -> pa.RecordBatch:
        columns = [*(zip(*seen, strict=True) if seen else ((), (), ())), *(zip(*seen.values(), strict=True) if seen else ((), (), (), ()))]
        kinds = (pa.string(), pa.int32(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["host", "node", "text", "n", "a", "b", "c"])

    found = pages.select("host", "_html", *(["template"] if held is None else [])).mapInArrow(counted, "host string, node int, text long, n long, a long, b long, c long")
    sums = [F.sum(x).alias(x) for x in ("n", "a", "b", "c")]
    found = written(found.groupBy("host", "node", "text").agg(*sums).where(F.col("text").isNull() | (F.col("n") >= least * share)), "text-counts")
    nodes = found.where("text IS NULL")
    of = nodes.where(F.col("n") >= least).select("host", "node", F.col("n").alias("_of"))
    met = found.where("text IS NOT NULL").join(of, ["host", "node"]).where(F.col("n") >= F.lit(float(share)) * F.col("_of")).drop("_of")
    return nodes.unionByName(met).groupBy("host").agg(F.collect_list(F.struct("node", "text", "n", "a", "b", "c")).alias("counts"))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html", share: float = 0.9, least: int = 3, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """For every row: key, url, text and n_chars (long, code points).

    Pages of one host (see ``split_url``) are aligned by simple tree matching into one template; a text
    that at least ``share`` of a host's pages have at a node, of ``least`` pages or more, is constant and goes.
    Of the varying slots those are content that lie in the innermost element that holds most prose over all
    of the host's pages (see ``induce``).
    A null or empty page has the empty text. A null URL and one without host share the empty host.
    Repeated rows are extracted alike; an empty table gives none; other columns are ignored. Templates
    up to ``max_broadcast`` bytes in all are broadcast, larger ones joined by host.
    """
    spark = pages.sparkSession
    ready(spark)
    pages = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), split_url(url)[0].alias("host"), F.col(f"`{source}`").cast("string").alias("_html"))
    templates = written(_templates(pages), "templates")
    size = templates.agg(F.coalesce(F.sum(F.length("template") + F.length("host") + 100), F.lit(0))).first()[0]
    held = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in templates.collect()}) if size <= max_broadcast else None
    counts = written(_counts(pages if held is not None else pages.join(templates, "host"), held, share, least), "constants")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"`{key}` {kinds['_key']}, `{url}` string, text string, n_chars long"

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {} if both is None else both.value
        read: dict[str, tuple | None] = {}
        for batch in batches:
            texts = []
            for k in range(batch.num_rows):
                host = batch.column(2)[k].as_py()
                if host not in read:
                    if len(read) > 5000:
                        read.clear()
                    packed, own = known.get(host, (None, None)) if both is not None else (batch.column(c)[k].as_py() for c in (4, 5))
                    read[host] = induce(pickle.loads(packed)[0], (tuple(x.values()) if isinstance(x, dict) else x for x in own or ()), share, least) if packed else None
                texts.append(main_text(batch.column(3)[k].as_py(), read[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    size += counts.agg(F.coalesce(F.sum(F.size("counts") * 48), F.lit(0))).first()[0]
    templates = templates.join(counts, "host", "left")
    if size <= max_broadcast:
        both = spark.sparkContext.broadcast({r[0]: (bytes(r[1]), [tuple(x) for x in r[2] or ()]) for r in templates.collect()})
    else:
        both = None
        pages = pages.join(templates, "host", "left").select("_key", "_url", "host", "_html", "template", "counts")
    return pages.mapInArrow(extracted, schema)


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
