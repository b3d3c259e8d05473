"""Main text of web pages by wrapper induction.

The pages of a host are folded into one wrapper: their trees of block elements are aligned by simple tree matching
(the largest order-preserving matching of children with equal labels) and each node counts its pages and how many of them have which text of its own. Pages whose trees match too little
are another layout and get a tree of their own. A text that a node has on enough pages and on most pages of a layout, or
of the host, is template; all other nodes are slots and hold content. Pages with equal content count once, so copies do
not make a text look like template; pages without content do not count.

A label is an element's tag, class and id (digits of an id do not count). Siblings of one label are told apart by their
place, counted from the first and from the last, so they stay slots of their own even where their number varies. Only
paragraphs of one parent, and what lies more than EDGE siblings of its label from both ends, are one repeated slot.

From the slots the text of navigation, page headers, footers, asides, forms, adverts, notices, comments, scripts and
styles is left out, as told by elements, roles, and words of class and id. A word that is only part of a class or id
(has-sidebar) does not set aside an element with most of the page's characters or with its first h1 (on pages without
h1, its longest article or main). If article elements, else main elements, else both together hold at least half of the
words or characters that are left, only that part counts. Character references are decoded, white space inside a block
becomes one space, blocks follow each other in page order with one line feed between them.

The pages' bare trees (labels and signatures, no texts) are dealt by host and content, folded inside each task, then per
host in two steps, so a host with any number of pages is spread over all tasks and each sends a few small trees. The
constants meet the pages in a join; Spark broadcasts them if their table is small, and otherwise joins by host.

Null or empty html gives an empty text. Pages without a url share one wrapper. Repeated rows are all returned; an empty
table gives an empty result. Only the id, url and html columns are read, so other columns may have any names. A heading
inside an article is never template. Trees are kept to 200 levels; deeper elements count to the one at that level.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.llm.common import written
from dayzero.llm.url_rules import host_of

MIN_PAGES = 5
#: Part of a layout's pages on which a node must have the same text to be template.
TEMPLATE_SHARE = 0.8
#: Part of the nodes of two trees that must match for one layout.
LIKE = 0.6
#: Layouts of a host that are told apart; beyond, the two with the fewest pages become one.
LAYOUTS = 32
#: Texts that a node counts, by Misra and Gries: a text of most pages is never lost.
TEXTS = 8
MAX_DEPTH = 200
#: Children of a wrapper node beyond which siblings of one label are one slot wherever they stand.
WIDE = 64
#: Pages of a wrapper from which on its rare nodes are left out: those on fewer than one of RARE pages.
MANY, RARE = 200, 50
#: Siblings of one label that keep a place of their own, from the first on and from the last back.
EDGE = 8
#: Contents that a task remembers, so that it passes most copies on once.
HELD_CONTENTS = 100_000
SALTS = 32

#: A tag begins here, one that opens an element ends here, and the others.
TAG_START = re.compile(r"<[a-zA-Z!?/]")
OPENING = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
UNENDED = re.compile(r"""<([a-zA-Z][^\s/>]*+)(?:[^>"']|"[^"]*+"|'[^']*+')*+""")
NAME = re.compile(r"<([a-zA-Z][^\s/>]*+)")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?", re.DOTALL)
#: Tags with a quote that is never closed, beyond which a page's tags end at the first >, whatever is quoted.
BROKEN = 20
#: Open elements beyond which further ones are not kept apart.
DEEPEST = 512
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td template tfoot th thead tr ul".split()
)
IN_HEAD = set("base basefont bgsound link meta title script style noscript template noframes head html".split())
KEEPS_P = set("dd dt li option optgroup tr td th thead tbody tfoot caption summary legend body html head select template".split())
#: A start tag ends these open elements, searched up to the named bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
PARAGRAPH = re.compile(r"p(?![^.#])")
P_BOUNDS = {"button", "table", "td", "th", "caption", "template", "object"}

# What is no main text: elements, roles, and words of class and id.
ASIDE_TAGS = set("nav footer aside form head template dialog menu button select label fieldset svg canvas audio video object".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "breadcrumb breadcrumbs menu menus nav navbar navigation sidebar sidenav rail widget widgets toolbar masthead footer "
    "comment comments commentlist disqus respond reply replies discussion related recommended recommendations "
    "pagination pager".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


NO, PARTLY, YES = 0, 1, 2


def _is_aside(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is set aside; PARTLY if only a part of a class or id says so."""
    if tag in ASIDE_TAGS or (tag == "header" and not in_article):
        return YES
    if "=" not in attributes or tag in ("body", "html", "article", "main"):
        return NO
    found = NO
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "role" and value.strip().lower() in ASIDE_ROLES:
            return YES
        if name in ("class", "id"):
            for item in value.split():
                words = {w.lower() for w in TOKEN.findall(item)}
                if "header" in words and (len(words) == 1 or words & {"site", "page"}) and not in_article:
                    return YES
                if words & ASIDE_WORDS:
                    if len(words) == 1:
                        return YES
                    found = PARTLY
    return found


def _label(tag: str, attributes: str) -> str:
    kind = name = ""
    if "=" in attributes:
        for n, a, b, c in ATTRIBUTE.findall(attributes):
            if n.lower() == "class":
                kind = kind or a or b or c
            elif n.lower() == "id":
                name = name or DIGITS.sub("0", a or b or c)
    return sys.intern(tag + (f".{kind}" if kind else "") + (f"#{name}" if name else ""))


def _sig(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big") + 1 if text else 0


@dataclass(slots=True)
class Node:
    """A block element: label, children, number of pages, and on how many of them its own text has which signature.

    every: on all pages; repeated: stands for a run of like siblings; path: labels from the root, of a page's node.
    """

    label: str
    children: list[Node] = field(default_factory=list)
    every: bool = True
    repeated: bool = False
    pages: int = 1
    sigs: dict[int, int] = field(default_factory=dict)
    path: int = 0


@dataclass(slots=True, eq=False)
class Part:
    """An element that may be set aside, or an article or main: those of the former around it, and its characters."""

    around: tuple[Part, ...] = ()
    chars: int = 0


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    region: int  # 2 inside an article, plus 1 inside main
    aside: bool
    heading: bool
    parts: tuple[Part, ...] = ()
    story: Part | None = None


@dataclass(slots=True)
class _Open:
    tag: str
    node: Node
    aside: bool
    region: int
    block: bool
    parts: tuple[Part, ...] = ()
    story: Part | None = None


@dataclass(slots=True)
class _Tags:
    """The tags of a page, found in one pass.

    A tag that holds an unclosed quote ends at the first > after it, one that never ends is dropped with what follows it,
    so no markup is left in the text.
    """

    page: str
    last: int
    broken: int = 0

    def next(self, at: int) -> tuple[int, int, str | None, str | None, str] | None:
        """Start and end of the first tag from a place on, the element that it closes or opens, and its attributes."""
        page = self.page
        while found := TAG_START.search(page, at):
            start = found.start()
            if not page[start + 1].isalpha():
                other = OTHER.match(page, start)
                if other:
                    return start, other.end(), other.group(1), None, ""
                at = start + 2
                continue
            if start > self.last:
                return start, len(page), None, None, ""
            tag = OPENING.match(page, start) if self.broken < BROKEN else None
            if tag:
                return start, tag.end(), None, tag.group(1), tag.group(2)
            self.broken += 1
            if self.broken > BROKEN:
                tag = NAME.match(page, start)
                end = page.find(">", tag.end())
            else:
                tag = UNENDED.match(page, start)
                end = page.find(">", tag.end() if tag.end() < len(page) else tag.end(1))
            if end < 0:
                return start, len(page), None, None, ""
            return start, end + 1, None, tag.group(1), page[tag.end(1) : end]
        return None


def parse(page: str | None) -> tuple[Node, list[Block]]:
    """The tree of block elements and the blocks of text, in page order. Texts are not yet signed."""
    root = Node("#page")
    stack = [_Open("#page", root, False, 0, True)]
    blocks: list[Block] = []
    pending: list[str] = []
    title: tuple[Part, ...] | None = None
    stories: list[Part] = []

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                # An inline element may be set aside too; it shares the node of the block around it.
                top = stack[-1]
                blocks.append(Block(text, top.node, top.region, top.aside, any(o.tag in HEADINGS for o in stack[-2:]), top.parts, top.story))

    def close(index: int) -> None:
        aside, parts = stack[index - 1].aside, stack[index - 1].parts
        if any(o.block or o.aside != aside or o.parts != parts for o in stack[index:]):
            flush()
        del stack[index:]

    page = page or ""
    in_head = False
    at = 0
    end = len(page)
    tags = _Tags(page, page.rfind(">"))
    while at < end:
        found = tags.next(at)
        stop = found[0] if found else end
        if stop > at:
            piece = page[at:stop]
            pending.append(entities.unescape(piece) if "&" in piece else piece)
        if not found:
            break
        _, at, closing, opening, attributes = found
        if closing:
            tag = closing.lower()
            if tag in ("body", "html"):
                continue
            if tag == "br":
                pending.append(" ")
                continue
            inline = tag not in BLOCK
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if inline and stack[i].block:
                    break
        elif opening:
            tag = opening.lower()
            if tag == "br" or tag == "wbr":
                pending.append(" " if tag == "br" else "")
                continue
            if tag in RAW:
                over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                at = over.end() if over else end
                continue
            if in_head and tag not in IN_HEAD:
                in_head = False
                if any(o.tag == "head" for o in stack):
                    close(next(i for i, o in enumerate(stack) if o.tag == "head"))
            elif tag == "head":
                in_head = True
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            block = tag in BLOCK
            if block:
                flush()
                if tag not in KEEPS_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p":
                            close(i)
                            break
                        if stack[i].tag in P_BOUNDS:
                            break
                if tag in ENDS:
                    ended, bounds = ENDS[tag]
                    lowest = None
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in ended:
                            lowest = i
                        elif stack[i].tag in bounds:
                            break
                    if lowest is not None:
                        close(lowest)
            if attributes.endswith("/") and not block or len(stack) > DEEPEST:
                continue
            top = stack[-1]
            region = top.region | (2 if tag == "article" else 1 if tag == "main" or "articleBody" in attributes else 0)
            told = _is_aside(tag, attributes, top.region >= 2) if attributes or tag in ASIDE_TAGS or tag == "header" else NO
            aside = top.aside or told == YES
            parts, story = top.parts, top.story
            if told == PARTLY and not aside:
                parts = (*parts, Part())
            if aside != top.aside or parts != top.parts:
                flush()
            if tag in ("article", "main") and not aside:
                story = Part(parts)
                stories.append(story)
            elif tag == "h1" and not aside and title is None:
                title = parts
            node = top.node
            if block and len(stack) <= MAX_DEPTH:
                node = Node(_label(tag, attributes))
                top.node.children.append(node)
            stack.append(_Open(tag, node, aside, region, block, parts, story))
    flush()
    _set_aside(blocks, title, stories)
    _place(root, hash_path(0, "#page"))
    return root, blocks


def _set_aside(blocks: list[Block], title: tuple[Part, ...] | None, stories: list[Part]) -> None:
    """Decide on the parts that may be set aside: not those with most of the text, or the title, or else the longest story."""
    if not any(b.parts for b in blocks):
        return
    total = 0
    for b in blocks:
        if not b.aside:
            total += len(b.text)
            for part in b.parts:
                part.chars += len(b.text)
            if b.story:
                b.story.chars += len(b.text)
    holders = title if title is not None else max(stories, key=lambda s: s.chars).around if stories else ()
    for b in blocks:
        b.aside = b.aside or any(part not in holders and 2 * part.chars <= total for part in b.parts)


def _place(node: Node, path: int) -> None:
    """Paths of the tree's nodes; siblings of one label get their place into the label."""
    node.path = path
    of_label = Counter(c.label for c in node.children)
    nth: Counter[str] = Counter()
    for child in node.children:
        label, n = child.label, of_label[child.label]
        if n > 1 and PARAGRAPH.match(label) is None:
            i = nth[label]
            nth[label] += 1
            # The first one has the same label as an only one.
            if i and i < min(EDGE, (n + 1) // 2):
                child.label = sys.intern(f"{label}@{i + 1}")
            elif i:
                child.label = sys.intern(f"{label}@-{n - i}" if n - i <= EDGE else f"{label}@")
        _place(child, hash_path(path, child.label))


@lru_cache(maxsize=100_000)
def hash_path(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{label}".encode("utf-8", "replace"), digest_size=7).digest(), "big")


def collapse(node: Node) -> Node:
    """The tree with siblings of equal label and place folded into one repeated slot."""
    node.children = _folded([collapse(child) for child in node.children])
    return node


def _narrow(children: list[Node]) -> list[Node]:
    return children if len(children) <= WIDE else _folded(children)


def _folded(children: list[Node]) -> list[Node]:
    by_label: dict[str, Node] = {}
    for child in children:
        known = by_label.get(child.label)
        by_label[child.label] = merge(known, child, run=True) if known else child
    return list(by_label.values())


def match_size(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> int:
    """Nodes in the largest simple matching of two trees: roots of equal label, children in order."""
    if a.label != b.label:
        return 0
    known = sizes.get((id(a), id(b)))
    if known is None:
        if _aligned(a, b):
            known = 1 + sum(match_size(x, y, sizes) for x, y in zip(a.children, b.children, strict=True))
        else:
            known = 1 + _table(a, b, sizes)[-1][-1]
        sizes[id(a), id(b)] = known
    return known


def _aligned(a: Node, b: Node) -> bool:
    """Children with the same labels in the same order, each once: the largest matching is plain."""
    labels = [c.label for c in a.children]
    return labels == [c.label for c in b.children] and len(set(labels)) == len(labels)


def _table(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> list[list[int]]:
    table = [[0] * (len(b.children) + 1)]
    for x in a.children:
        row, before = [0], table[-1]
        for j, y in enumerate(b.children):
            row.append(max(before[j + 1], row[j], before[j] + match_size(x, y, sizes)))
        table.append(row)
    return table


def merge(a: Node, b: Node, run: bool = False, sizes: dict | None = None) -> Node:
    """One wrapper for both trees, whose roots have equal labels; run: they are siblings of one page."""
    sizes = {} if sizes is None else sizes
    out: list[Node] = []
    i, j = len(a.children), len(b.children)
    if _aligned(a, b):
        out = [merge(x, y, run, sizes) for x, y in zip(reversed(a.children), reversed(b.children), strict=True)]
        i = j = 0
    else:
        table = _table(a, b, sizes)
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (size := match_size(a.children[i - 1], b.children[j - 1], sizes)) and size:
            i, j = i - 1, j - 1
            out.append(merge(a.children[i], b.children[j], run, sizes))
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            out.append(_optional(a.children[i]))
        else:
            j -= 1
            out.append(_optional(b.children[j]))
    children: list[Node] = []
    for child in reversed(out):
        if children and children[-1].label == child.label:
            children[-1] = merge(children[-1], child, run=True)
        else:
            children.append(child)
    pages = max(a.pages, b.pages) if run else a.pages + b.pages
    return Node(
        a.label,
        _frequent(_narrow(children), pages),
        a.every and b.every,
        run or a.repeated or b.repeated,
        pages,
        {} if run or a.repeated or b.repeated else _summed(a.sigs, b.sigs),
    )


def _optional(node: Node) -> Node:
    return Node(node.label, node.children, False, node.repeated, node.pages, node.sigs)


def _frequent(children: list[Node], pages: int) -> list[Node]:
    """children without the rare ones, which would pile up where labels differ from page to page."""
    if pages < MANY:
        return children
    return [c for c in children if c.pages * RARE >= pages]


def _summed(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    if len(a) == 1 and a.keys() == b.keys():
        return {sig: n + b[sig] for sig, n in a.items()}
    both = Counter(a)
    both.update(b)
    if len(both) <= TEXTS:
        return dict(both)
    less = sorted(both.values(), reverse=True)[TEXTS]
    return {sig: n - less for sig, n in both.items() if n > less}


def page_wrapper(root: Node, blocks: list[Block]) -> list[Node]:
    """A page's own wrapper: a single layout."""
    own: dict[int, list[Block]] = {}
    for b in blocks:
        own.setdefault(id(b.node), []).append(b)
    for parts in own.values():
        parts[0].node.sigs = {_sig("\n".join(b.text for b in parts)): 1}
    return [collapse(root)]


def page_content(blocks: list[Block]) -> int:
    """Signature of a page's content, 0 if it has none."""
    return _sig("\n".join(b.text for b in blocks if not b.aside))


def _core(node: Node, pages: int) -> int:
    """Nodes on at least half of the pages."""
    return 1 + sum(_core(c, pages) for c in node.children if 2 * c.pages >= pages)


def _likeness(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> float:
    return 2 * match_size(a, b, sizes) / (_core(a, a.pages) + _core(b, b.pages))


def join_wrappers(a: list[Node], b: list[Node]) -> list[Node]:
    """Wrapper of both: each layout of b joins the first of a that is like it, or else comes after them."""
    out = list(a)
    for own in b:
        for i, known in enumerate(out):
            sizes: dict[tuple[int, int], int] = {}
            if _likeness(known, own, sizes) >= LIKE:
                out[i] = merge(known, own, sizes=sizes)
                break
        else:
            out.append(own)
        out.sort(key=lambda layout: -layout.pages)
        if len(out) > LAYOUTS:
            out[-2:] = [merge(out[-2], out[-1])]
    return out


def constants(wrapper: list[Node]) -> list[tuple[int, int]]:
    """(path, signature) of the template's texts: of each layout, and of all layouts together."""
    found: set[tuple[int, int]] = set()
    whole = wrapper[0]
    for layout in wrapper[1:]:
        whole = merge(whole, layout)
    for root in [whole, *wrapper[: len(wrapper) if len(wrapper) > 1 else 0]]:
        enough = max(MIN_PAGES, TEMPLATE_SHARE * root.pages)
        todo = [(root, hash_path(0, "#page"))]
        while todo:
            node, path = todo.pop()
            if node.repeated or node.pages < enough:
                continue
            found |= {(path, sig) for sig, n in node.sigs.items() if n >= enough}
            todo += [(c, hash_path(path, c.label)) for c in node.children]
    return sorted(found)


def _packed(node: Node) -> tuple:
    return node.label, [_packed(c) for c in node.children], node.every, node.repeated, node.pages, node.sigs


def _unpacked(label: str, children: list, *rest) -> Node:
    return Node(label, [_unpacked(*c) for c in children], *rest)


def to_bytes(wrapper: list[Node]) -> bytes:
    return pickle.dumps([_packed(layout) for layout in wrapper], pickle.HIGHEST_PROTOCOL)


def from_bytes(blob: bytes) -> list[Node]:
    return [_unpacked(*layout) for layout in pickle.loads(blob)]


def main_text(blocks: list[Block], template: set[tuple[int, int]]) -> str:
    own: dict[int, list[str]] = {}
    if template:
        for b in blocks:
            own.setdefault(b.node.path, []).append(b.text)
        paths = {p for p, texts in own.items() if (p, _sig("\n".join(texts))) in template}
    else:
        paths = set()
    kept = [b for b in blocks if not b.aside and (b.node.path not in paths or (b.heading and b.region >= 2))]
    for region in (2, 1, 3):
        part = [b for b in kept if b.region & region]
        if _most(part, kept):
            kept = part
            break
    return "\n".join(b.text for b in kept)


def _most(part: list[Block], whole: list[Block]) -> bool:
    """Whether a part has at least half of the words, or of the characters of languages without blanks."""
    if not part or len(part) == len(whole):
        return bool(part)
    return any(2 * sum(map(size, part)) >= sum(map(size, whole)) for size in (lambda b: len(b.text.split()), lambda b: len(b.text)))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and constants (pickled (path, signature) pairs) of every host with template text."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str | None, int]] = set()
        for batch in batches:
            rows: dict[str, list] = {"host": [], "content": [], "wrapper": []}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root, blocks = parse(page)
                content = page_content(blocks)
                if not content or (host, content) in seen:
                    continue
                if len(seen) >= HELD_CONTENTS:
                    seen.clear()
                seen.add((host, content))
                rows["host"].append(host)
                rows["content"].append(content)
                rows["wrapper"].append(to_bytes(page_wrapper(root, blocks)))
            yield pa.RecordBatch.from_pydict(
                rows, schema=pa.schema([("host", pa.string()), ("content", pa.int64()), ("wrapper", pa.binary())])
            )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by host and content."""
        schema = pa.schema([("host", pa.string()), ("wrapper", pa.binary())])
        last, held = None, None
        for batch in batches:
            done: dict[str, list] = {"host": [], "wrapper": []}
            for host, content, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and last == (host, content):
                    continue
                if held is not None and last[0] != host:
                    done["host"].append(last[0])
                    done["wrapper"].append(to_bytes(held))
                    held = None
                last = host, content
                held = from_bytes(blob) if held is None else join_wrappers(held, from_bytes(blob))
            yield pa.RecordBatch.from_pydict(done, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"host": [last[0]], "wrapper": [to_bytes(held)]}, schema=schema)

    def joined(wrappers: list[bytes]) -> list[Node]:
        out: list[Node] = []
        for blob in sorted(wrappers):
            out = join_wrappers(out, from_bytes(blob))
        return out

    def part(key, rows):
        import pandas as pd

        return pd.DataFrame({"host": [key[0]], "wrapper": [to_bytes(joined(list(rows["wrapper"])))]})

    def whole(key, rows):
        import pandas as pd

        found = constants(joined(list(rows["wrapper"])))
        return pd.DataFrame({"host": [key[0]], "constants": [pickle.dumps(found) if found else None]})

    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts = read.mapInArrow(trees, "host string, content long, wrapper binary").repartition("host", "content")
    parts = parts.sortWithinPartitions("host", "content", "wrapper").mapInArrow(fold, "host string, wrapper binary")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    parts = parts.groupBy("host", "salt").applyInPandas(part, "host string, wrapper binary")
    return parts.groupBy("host").applyInPandas(whole, "host string, constants binary").where("constants is not null")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id, url, text and n_chars of every row."""
    known = written(induce(pages, url_col, html_col).withColumnRenamed("host", "w_host"), "wrappers")
    read = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    joined = read.join(known, F.col("host") == F.col("w_host"), "left").select("id", "url", "html", "constants")
    id_type = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(main_text(parse(page)[1], set(pickle.loads(found)) if found else set()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_col, "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, f"`{id_col}` {id_type}, url string, text string, n_chars long")
