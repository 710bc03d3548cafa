"""Main text of web pages by wrapper induction.

Pages become trees of their block elements; siblings of one kind that follow
one another (paragraphs, list items) count as one slot. The trees of a host's
pages are aligned by simple tree matching and folded into the host's template,
which keeps for each node the number of pages, whether its text was the same on
all of them, how much text and link text it held, and on how many pages its
element or name spoke of furniture. Constant nodes are template; varying ones
are slots. The smallest node that covers all varying text but furniture is the
host's content; a page's own content is the node aligned with it.

Names are evidence, never a verdict of their own: the template overrules them
where a named part holds the host's text (a form around the page) or a varying
headline. Whether a node is constant is told by one rule at every number of
pages: the lower end of a 95 % confidence interval of its share of pages.

A template keeps the children and members that stand on a fair share of pages,
by mergeable Misra-Gries counts: none that stands on more than a quarter of the
pages (an eighth, for members) is ever let go. What the template does not know
stays in a page's text.

Templates are folded within each task first, so a host of any size shuffles a
few small templates and no pages.

Defined cases: a null or empty page has an empty text; a page of which nothing
but furniture is found has an empty text; a page without a host forms a host
of its own name; repeated rows are judged singly; markup that is cut off is
closed at its end; elements more than DEEPEST levels down are blocks of the
element above them; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import sliced, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[/a-zA-Z][^>]*+\Z",
    re.S,
)
#: Elements whose content is no text of the page (fixed values); those in the first list run to the end if they are not closed.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
SKIPPED = RAW | frozenset("noscript template svg select button object video audio canvas datalist".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Block elements (fixed values); all others are running text.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new block of the given kind ends (fixed values).
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th")}
#: Where the search for an element to end stops.
SCOPE = frozenset("html body article section div table ul ol dl form aside nav main header footer td th".split())
#: Elements, roles and words in names of parts that are no article: plain ones, and ones that the template may overrule (fixed values).
PLAIN_ELEMENTS = frozenset("nav aside footer menu dialog".split())
DOUBTFUL_ELEMENTS = frozenset("form search header".split())
PLAIN_ROLES = frozenset("navigation complementary contentinfo dialog alert alertdialog menu menubar toolbar".split())
DOUBTFUL_ROLES = frozenset("banner search form".split())
PLAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "comment comments commentlist disqus cookie cookies consent gdpr newsletter subscribe share sharing sidebar footer".split()
)
DOUBTFUL_WORDS = frozenset(
    "banner promo promotion promoted rail widget menu header masthead topbar toolbar respond reply replies notice notices alert popup modal overlay "
    "subscription signup login search social related recommended trending popular tags skip copyright legal disclaimer hidden".split()
)
#: Words that may stand beside those in a name without giving it another sense (fixed values).
NEUTRAL_WORDS = frozenset(
    "box block wrap wrapper container area section list item items bar inner outer site page top bottom left right links link posts post articles article stories "
    "story entry blog row col column module panel region global primary secondary js button buttons icon icons form title message slot unit google policy zone holder "
    "main group content body text".split()
)
#: Elements that a doubtful word is evidence for; a paragraph or headline is none (fixed values).
CONTAINERS = frozenset("div section ul ol dl table aside form header footer details center fieldset td".split())
#: Least sure share of pages on which a node has the same text to count as constant: outside the content, and within it.
SURE_OUTSIDE, SURE_WITHIN = 0.7, 0.83
#: Varying text of less than this share of the constant text says that a host's pages are copies.
FEW_VARYING = 0.05
#: A doubtful part is no furniture if less than this share of the running text stands outside of it.
LEAST_OUTSIDE = 0.2
#: A list of links is a menu outside the content if so much of it is link text, in links of so few characters.
MENU_SHARE, MENU_LINK, MENU_LINKS = 0.8, 20, 3
#: Levels of elements that become nodes of their own.
DEEPEST = 100
#: Cells of the alignment that are kept for walking back; larger alignments are halved first.
CELLS = 4_000_000
PLAIN, DOUBTFUL = 2, 1


class Node:
    __slots__ = ("tag", "key", "bad", "parts", "links", "anchors", "chars", "crc", "title", "groups", "kids")

    def __init__(self, tag: str, key: str, bad: int):
        self.tag, self.key, self.bad = tag, key, bad
        self.parts: list = []  # texts, nodes, and None where a block ends, in page order
        self.links = self.anchors = self.chars = self.crc = 0
        self.title = {"h1": 2, "h2": 1}.get(tag, 0)


def named(tag: str, attributes: str) -> tuple[str, int]:
    """The node's kind (element and class names without digits) and how surely it is furniture by element and name."""
    names, bad = [], PLAIN if tag in PLAIN_ELEMENTS else DOUBTFUL if tag in DOUBTFUL_ELEMENTS else 0
    if attributes and len(attributes) > 3:
        for m in ATTRIBUTE.finditer(attributes):
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if what == "role":
                value = value.lower()
                bad = max(bad, PLAIN if value in PLAIN_ROLES else DOUBTFUL if value in DOUBTFUL_ROLES else 0)
            elif what == "hidden" or (what == "aria-hidden" and value.lower() == "true"):
                bad = PLAIN
            elif what == "style":
                bad = PLAIN if "display:none" in value.lower().replace(" ", "") else bad
            else:
                for name in value.split():
                    bad = max(bad, evidence(tag, name))
                    if what == "class" and not any(c.isdigit() for c in name):
                        names.append(name.lower())
    return tag + "".join(f".{x}" for x in sorted(names)[:3]), bad


def evidence(tag: str, name: str) -> int:
    """What a class name or id says: all its words must be words of furniture or neutral ones."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    found = 0
    for w in words:
        if w in PLAIN_WORDS:
            found = PLAIN
        elif w in DOUBTFUL_WORDS:
            found = max(found, DOUBTFUL)
        elif w not in NEUTRAL_WORDS:
            return 0
    return found if found == PLAIN or tag in CONTAINERS else 0


def parse(html: str) -> Node:
    """The tree of block elements."""
    root = Node("html", "html", 0)
    tags, nodes = ["html"], [root]
    at, link, size, unclosed = 0, 0, len(html), set()
    token, closing = TOKEN.search, {}

    def put(text: str) -> None:
        text = unescape(text) if "&" in text else text
        here = nodes[-1]
        here.parts.append(text)
        n = len(text.strip())
        here.chars += n
        if link:
            here.links += n

    def close(i: int) -> None:
        """Ends the element at place i of the stack, and those within it."""
        for tag, node in zip(tags[i:], nodes[i:]):
            if node is nodes[i - 1] or node.tag != tag:
                nodes[i - 1].parts.append(None)
        del tags[i:], nodes[i:]

    while at < size and (m := token(html, at)):
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if tag not in BLOCKS:
            if tag in SKIPPED and not ends and tag not in unclosed:
                found = closing.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I)).search(html, at)
                if found:
                    at = found.end()
                elif tag in RAW:
                    break
                else:
                    unclosed.add(tag)
            elif tag == "a":
                link = 0 if ends else 1
                nodes[-1].anchors += link
            elif tag in ("br", "img", "wbr"):
                nodes[-1].parts.append(" ")
            continue
        link = 0
        if ends:
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] == tag:
                    close(i)
                    break
            continue
        if tag in ("html", "body"):
            continue
        # an open paragraph ends where a block begins, and a list item where the next one does
        for i in range(len(tags) - 1, 0, -1):
            if tags[i] == "p":
                close(i)
                break
            if tags[i] in SCOPE:
                break
        if tag in ENDS:
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in ENDS[tag]:
                    close(i)
                    break
                if tags[i] in SCOPE and tags[i] not in ("td", "th"):
                    break
        key, bad = named(tag, m[3] or m[6])
        if len(tags) >= DEEPEST and (not bad or nodes[-1].bad):
            nodes[-1].parts.append(None)
            node = nodes[-1]
        else:
            node = Node(tag, key, bad)
            nodes[-1].parts.append(node)
        if tag != "hr":
            tags.append(tag)
            nodes.append(node)
    else:
        if at < size:
            put(html[at:])
    return root


def runs(parts: list) -> list[list[Node]]:
    """Children in slots: followers of one kind share a slot."""
    out: list[list[Node]] = []
    for part in parts:
        if isinstance(part, Node):
            if out and out[-1][0].key == part.key:
                out[-1].append(part)
            else:
                out.append([part])
    return out


# A template node is a list with these places. Members are the checksums of a slot's single elements.
(KEY, PAGES, SAME, CHARS, LINKS, ANCHORS, KIDS, SURELY, MAYBE, TITLE, MEMBERS, SEEN, LOST, WIDTH, COUNT) = range(15)
# kind; pages; checksum of the text, None if it varied; characters; those in links; links; children; pages on which the node was plainly or
# perhaps furniture; whether a headline is within (2: h1, 1: h2); counts of members; members met in all; how much a member's count may be short; children met
# in all; the count that decides whether the node itself is kept


def summed(node: Node) -> None:
    """Adds up lengths and the checksum of the text from the leaves, and finds the slots of every node."""
    crc = 0
    for part in node.parts:
        if isinstance(part, str):
            if text := " ".join(part.split()):
                crc = zlib.crc32(text.encode("utf-8", "replace"), crc)
        elif part is not None:
            summed(part)
            node.chars += part.chars
            node.links += part.links
            node.anchors += part.anchors
            node.title = max(node.title, part.title)
            crc = zlib.crc32(part.crc.to_bytes(4, "little"), crc)
    node.crc = crc
    node.groups = runs(node.parts)
    node.kids = [slot(g) for g in node.groups]


def slot(group: list[Node]) -> list:
    """The template of one page's slot."""
    crc = group[0].crc
    for node in group[1:]:
        crc = zlib.crc32(node.crc.to_bytes(4, "little"), crc)
    kids: list = []
    for node in group:
        kids = joined(kids, node.kids, False) if kids and node.kids else kids or node.kids
    surely, maybe = all(n.bad == PLAIN for n in group), all(n.bad for n in group)
    members = {n.crc: 1 for n in group}
    return [group[0].key, 1, crc, sum(n.chars for n in group), sum(n.links for n in group), sum(n.anchors for n in group), kids, int(surely), int(maybe),
            max(n.title for n in group), members, len(members), 0, len(kids), 1]


def matched(a: list, b: list, known: dict | None = None) -> int:
    """Simple tree matching: the number of pairs in the largest matching that keeps kinds, order and depth."""
    if a[KEY] != b[KEY]:
        return 0
    if not a[KIDS] or not b[KIDS]:
        return 1
    known = {} if known is None else known
    at = (shape(a, known), shape(b, known))
    if at not in known:
        known[at] = 1 + sum(matched(x, y, known) for x, y in pairs(a[KIDS], b[KIDS], known) if x and y)
    return known[at]


def shape(node: list, known: dict) -> int:
    """A hash of the kinds in and under a node; nodes of one shape match alike."""
    if not node[KIDS]:
        return hash(node[KEY])
    if id(node) not in known:
        known[id(node)] = hash((node[KEY], *[shape(c, known) for c in node[KIDS]]))
    return known[id(node)]


def gains(xs: list, ys: list, known: dict):
    """For each x the gain of pairing it with each y, as one row at a time; nodes of one shape share a row."""
    same_kind: dict[str, list[int]] = {}
    with_kids: dict[str, dict[int, list[int]]] = {}
    for j, y in enumerate(ys):
        same_kind.setdefault(y[KEY], []).append(j)
        if y[KIDS]:
            with_kids.setdefault(y[KEY], {}).setdefault(shape(y, known), []).append(j)
    rows: dict[int, np.ndarray] = {}

    def row(x: list) -> np.ndarray:
        at = shape(x, known)
        if at not in rows:
            out = rows[at] = np.zeros(len(ys), np.int32)
            out[same_kind.get(x[KEY], [])] = 1
            if x[KIDS]:
                for places in with_kids.get(x[KEY], {}).values():
                    out[places] = matched(x, ys[places[0]], known)
        return rows[at]

    return row


def pairs(xs: list, ys: list, known: dict | None = None) -> list[tuple]:
    """The aligned children (x, y), either None where one has no partner, in an order that keeps both."""
    if len(xs) == len(ys) and all(x[KEY] == y[KEY] for x, y in zip(xs, ys)):
        # one by one is the best there is, if no kind repeats or a repeated one weighs the same everywhere
        if len({x[KEY] for x in xs}) == len(xs) or not any(x[KIDS] and y[KIDS] for x, y in zip(xs, ys)):
            return list(zip(xs, ys))
    if not xs or not ys:
        return [(x, None) for x in xs] + [(None, y) for y in ys]
    known = {} if known is None else known
    row = gains(xs, ys, known)
    n, m = len(xs), len(ys)
    if n * m > CELLS and n > 1:
        # Hirschberg: the best place to cut ys, so that the halves of xs meet theirs
        half = n // 2
        down = last_row([row(x) for x in xs[:half]], m)
        up = last_row([row(x)[::-1] for x in xs[half:][::-1]], m)[::-1]
        cut = int((down + up).argmax())
        return pairs(xs[:half], ys[:cut], known) + pairs(xs[half:], ys[cut:], known)
    best = np.zeros((n + 1, m + 1), np.int32)
    rows = [row(x) for x in xs]
    for i in range(n - 1, -1, -1):
        take = np.maximum(best[i + 1, :m], np.where(rows[i] > 0, rows[i] + best[i + 1, 1:], 0))
        best[i, :m] = np.maximum.accumulate(take[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if rows[i][j] and best[i, j] == rows[i][j] + best[i + 1, j + 1]:
            out.append((xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i + 1, j]:
            out.append((xs[i], None))
            i += 1
        else:
            out.append((None, ys[j]))
            j += 1
    return out + [(x, None) for x in xs[i:]] + [(None, y) for y in ys[j:]]


def last_row(rows: list[np.ndarray], m: int) -> np.ndarray:
    """Best gain of all rows with the first j columns, for each j."""
    best = np.zeros(m + 1, np.int32)
    for row in rows:
        take = np.maximum(best[1:], np.where(row > 0, row + best[:-1], 0))
        best = np.concatenate([best[:1], np.maximum.accumulate(take)])
    return best


def joined(xs: list, ys: list, pages: bool = True, most: float | None = None) -> list:
    """Aligned children folded; of more than `most`, those with the greatest Misra-Gries counts."""
    out = [fold(x, y, pages) if x and y else x or y for x, y in pairs(xs, ys)]
    if most is not None and len(out) > 2 * most:
        lost = sorted((c[COUNT] for c in out), reverse=True)[int(most)]
        out = [[*c[:COUNT], c[COUNT] - lost] for c in out if c[COUNT] > lost]
    return out


def fold(a: list, b: list, pages: bool = True) -> list:
    """Two aligned template nodes as one; pages: they come from different pages."""
    if not pages:
        return [a[KEY], 1, a[SAME] if a[SAME] == b[SAME] else None, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[ANCHORS] + b[ANCHORS],
                joined(a[KIDS], b[KIDS], False), a[SURELY] & b[SURELY], a[MAYBE] & b[MAYBE], max(a[TITLE], b[TITLE]), a[MEMBERS] | b[MEMBERS],
                len(a[MEMBERS] | b[MEMBERS]), 0, a[WIDTH] + b[WIDTH], 1]
    n, seen, width = a[PAGES] + b[PAGES], a[SEEN] + b[SEEN], a[WIDTH] + b[WIDTH]
    members, lost = dict(a[MEMBERS]), a[LOST] + b[LOST]
    for crc, c in b[MEMBERS].items():
        members[crc] = members.get(crc, 0) + c
    most = 32 + 8 * seen // n
    if len(members) > 2 * most:
        least = sorted(members.values(), reverse=True)[most]
        members = {crc: c - least for crc, c in members.items() if c > least}
        lost += least
    kids = joined(a[KIDS], b[KIDS], True, 64 + 4 * width / n)
    same = a[SAME] if a[SAME] == b[SAME] else None
    return [a[KEY], n, same, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[ANCHORS] + b[ANCHORS], kids, a[SURELY] + b[SURELY], a[MAYBE] + b[MAYBE],
            max(a[TITLE], b[TITLE]), members, seen, lost, width, a[COUNT] + b[COUNT]]


def sure_share(count: int, pages: int) -> float:
    """Lower end of the 95 % Wilson interval of count in pages."""
    z2 = 3.8416
    p = min(1.0, count / pages)
    return (p + z2 / (2 * pages) - (z2 * (p * (1 - p) / pages + z2 / (4 * pages * pages))) ** 0.5) / (1 + z2 / pages)


def constant(node: list, level: float = SURE_OUTSIDE) -> bool:
    return node[SAME] is not None and sure_share(node[PAGES], node[PAGES]) >= level


def is_menu(links: int, anchors: int, chars: int) -> bool:
    return anchors >= MENU_LINKS and links > MENU_SHARE * chars and links <= MENU_LINK * anchors


def titled(kind: str, title: int) -> bool:
    """Whether a part holds a headline: any with an h1, a header with an h2 too."""
    return title == 2 or (title == 1 and kind.split(".")[0] == "header")


def furniture(node: list) -> int:
    """What the host's pages say of a node by its element and name."""
    if 2 * node[SURELY] > node[PAGES]:
        return PLAIN
    headline = titled(node[KEY], node[TITLE]) and node[SAME] is None  # one that varies makes the node a part of the article
    return DOUBTFUL if 2 * node[MAYBE] > node[PAGES] and not headline else 0


def mass(node: list, constants: bool) -> int:
    """Characters that are no furniture; constants: also those of constant nodes."""
    if furniture(node) or is_menu(node[LINKS], node[ANCHORS], node[CHARS]) or (not constants and constant(node)):
        return 0
    own = node[CHARS] - sum(c[CHARS] for c in node[KIDS])
    return max(0, own) + sum(mass(c, constants) for c in node[KIDS])


def prose(node: list) -> int:
    return max(0, node[CHARS] - node[LINKS])


def settled(root: list) -> list:
    """The template without doubts about parts that hold nearly all of the host's running text."""

    def doubtful(node: list, out: list) -> None:
        if (grade := furniture(node)) == DOUBTFUL:
            out.append(node)
        elif not grade:
            for c in node[KIDS]:
                doubtful(c, out)

    def outside(node: list) -> int:
        if furniture(node):
            return 0
        return max(0, prose(node) - sum(prose(c) for c in node[KIDS])) + sum(outside(c) for c in node[KIDS])

    while True:
        found: list = []
        doubtful(root, found)
        largest = max(found, key=prose, default=None)
        if largest is None or not prose(largest) or outside(root) >= LEAST_OUTSIDE * (outside(root) + prose(largest)):
            return root
        largest[MAYBE] = 0


def of_copies(root: list) -> bool:
    """Whether next to nothing but constant text stands on a host's pages: they are copies, and constant text is theirs."""
    varying = mass(root, False)
    return FEW_VARYING * (mass(root, True) - varying) > varying


def content_of(root: list, constants: bool) -> list[int]:
    """Path (child numbers) from the root to the smallest node that covers all text but furniture and (unless constants) constant text."""
    path: list[int] = []
    while True:
        held = [i for i, c in enumerate(root[KIDS]) if mass(c, constants)]
        if len(held) != 1 or root[CHARS] > sum(c[CHARS] for c in root[KIDS]):
            return path
        kind = root[KIDS][held[0]][KEY].split(".")[0]
        if kind not in ("article", "main", "section", "div", "form", "center", "table", "tbody", "tr", "td", "body"):
            return path
        path.append(held[0])
        root = root[KIDS][held[0]]
        if kind == "article":
            return path


def beside(known: list | None, own: list, constants: bool) -> bool:
    """Whether a page's slot may stay outside its content: it is furniture, or the template's constant text."""
    if not mass(own, constants):
        return True
    return known is not None and not mass(known, constants) and known[SAME] in (None, own[SAME])


def blocks(node: Node, known: list | None, within: bool, drop_constant: bool, trust: bool, out: list[str]) -> None:
    """The texts of the node's blocks, in page order, without furniture and constant parts. trust: known comes from other pages too."""
    running: list[str] = []

    def end() -> None:
        if text := " ".join("".join(running).split()):
            out.append(text)
        running.clear()

    slots: dict[int, tuple] = {}
    if known:
        numbers = {id(kid): k for k, kid in enumerate(node.kids)}
        for x, y in pairs(known[KIDS], node.kids):
            if y is not None:
                slots |= {id(n): (x, y) for n in node.groups[numbers[id(y)]]}
    level = SURE_WITHIN if within else SURE_OUTSIDE
    for part in node.parts:
        if isinstance(part, str):
            running.append(part)
            continue
        end()
        if part is None:
            continue
        x, y = slots.get(id(part), (None, None))
        if part.bad == PLAIN or (x is not None and furniture(x) == PLAIN):
            continue
        if part.bad == DOUBTFUL and not (within and titled(part.key, part.title)):
            if x is None:  # the template doesn't know it: the name decides, unless it holds nearly all of what is around it
                if part.chars - part.links < (1 - LEAST_OUTSIDE) * (node.chars - node.links) and not titled(part.key, part.title):
                    continue
            elif furniture(x) or (2 * x[MAYBE] > x[PAGES] and x[SAME] is not None and trust):
                continue
        if not within and part.tag in ("ul", "ol", "div", "table") and is_menu(part.links, part.anchors, part.chars):
            continue
        if x and drop_constant and part.chars:
            same = x[PAGES] if x[SAME] is not None and y[SAME] == x[SAME] else 0
            if part.crc in x[MEMBERS]:
                same = max(same, min(x[PAGES], x[MEMBERS][part.crc] + x[LOST]))
            if sure_share(same, x[PAGES]) >= level:
                continue
        blocks(part, x, within, drop_constant, trust, out)
    end()


def extract(html: str | None, template: list | None) -> str:
    """The page's article as blocks joined by line ends. template: a settled one."""
    if not html:
        return ""
    root = parse(html)
    summed(root)
    node, within = root, False
    trust = bool(template) and template[PAGES] > 1
    base = template if trust else settled(slot([root]))
    whole_base = base
    constants = of_copies(base)
    for step in content_of(base, constants):
        target = base[KIDS][step]
        found, whole = None, True
        for x, y in pairs(base[KIDS], node.kids):
            if x is target and y is not None:
                found = node.groups[next(i for i, k in enumerate(node.kids) if k is y)]
            elif y is not None:
                whole = whole and beside(x, y, constants)
        if not found or len(found) > 1 or not whole:
            break
        node, base, within = found[0], target, True
    drop = trust and not constants and not (within and base[SAME] is not None)
    out: list[str] = []
    blocks(node, base, within, drop, trust, out)
    if not out and node is not root:
        blocks(root, whole_base, False, trust, trust, out)
    return "\n".join(out)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Templates that a task holds at a time.
HELD = 2000


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def folded(pages: DataFrame) -> DataFrame:
    """(host, template): a task's pages of each host folded into one template, or several if it meets very many hosts."""

    def rows(known: dict[str, list]) -> pa.RecordBatch:
        hosts = sorted(known)
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array([pickle.dumps(known[h]) for h in hosts], pa.binary())], ["host", "template"]
        )

    def run(batches):
        known: dict[str, list] = {}
        for batch in batches:
            for part in sliced(batch, "html"):
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    if html:
                        root = parse(html)
                        summed(root)
                        new = slot([root])
                        known[host] = fold(known[host], new) if host in known else new
            if len(known) > HELD:
                yield rows(known)
                known = {}
        yield rows(known)

    return pages.select("host", "html").mapInArrow(run, "host string, template binary")


def refolded(parts: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """Templates of equal keys folded into one; a group holds one small template per task."""

    def run(table: pa.Table) -> pa.Table:
        whole = None
        for raw in sorted(table.column("template").to_pylist()):
            part = pickle.loads(raw)
            whole = part if whole is None else fold(whole, part)
        whole = settled(whole) if last else whole
        return pa.table({"host": table.column("host").slice(0, 1), "template": pa.array([pickle.dumps(whole)], pa.binary())})

    return parts.groupBy(*keys).applyInArrow(run, "host string, template binary")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) over all pages: folded by task, by task group and host, then by host."""
    parts = folded(pages).withColumn("part", F.pmod(F.xxhash64("template"), F.lit(32)))
    return refolded(refolded(parts, ["host", "part"]), ["host"], last=True)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = with_host(pages)
    made, _ = stored(templates(rows), "templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        known: dict[bytes, list] = {}
        for batch in batches:
            for part in sliced(batch, "html", "template"):
                out = []
                for html, raw in zip(part.column("html").to_pylist(), part.column("template").to_pylist()):
                    if raw is not None and raw not in known:
                        if len(known) > 200:
                            known.clear()
                        known[raw] = pickle.loads(raw)
                    out.append(extract(html, known[raw] if raw is not None else None))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    joined_rows = rows.join(made, "host", "left").select("page_id", "url", "html", "template")
    return joined_rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
