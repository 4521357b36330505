"""Small DOM helper: a page's block elements with their text blocks, and simple tree matching."""
from __future__ import annotations

import re
from html import unescape

from xxhash import xxh64_intdigest

#: Fixed values of HTML: elements without end tag, elements whose text is no markup, elements that
#: start a block, blocks that a new one of their kind closes, and where such closing stops.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset((
    "html head body article section main nav aside header footer address h1 h2 h3 h4 h5 h6 hgroup p pre "
    "blockquote ol ul menu li dl dt dd figure figcaption div table caption thead tbody tfoot tr td th "
    "form fieldset legend details summary dialog search center hr noscript template").split())
CLOSES_P = BLOCK - {"html", "head", "body", "noscript", "template"}
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
             "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPE = frozenset("ul ol menu dl table select article section main div body html td th".split())

#: What is no part of an article: elements, roles, and words of classes and ids.
OUTSIDE_TAGS = frozenset(("head noscript template nav footer aside menu dialog search select button object svg "
                          "canvas audio video").split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog "
                          "menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "newsletter subscribe signup login search searchbox menu menus nav navbar navigation breadcrumb "
    "breadcrumbs pager pagination sidebar aside widget widgets related recommended recommendations share "
    "sharing social comment comments disqus respond footer masthead toolbar skip copyright").split())
MAX_DEPTH = 200               # deeper elements only pass their text on to the one at this depth
MANY_CHILDREN = 64            # from so many children on, those with one label are matched as one

# A quote counts only after "=", and what was matched is never tried anew: time is linear.
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>"""
                    r"""|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=\"'/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element. ``items`` are child nodes and (text, characters in links) blocks in page
    order; ``outside`` marks parts that are no article, ``weak`` why this is only likely ("tag",
    "word")."""
    __slots__ = ("tag", "label", "outside", "weak", "region", "items", "group")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.label, self.items, self.group = tag, tag, [], None
        self.outside, self.weak, self.region = tag in OUTSIDE_TAGS, "", tag in ("article", "main")
        if tag in ("form", "header"):
            self.outside, self.weak = True, "tag"
        if raw and not raw.isspace():
            self._read(raw)

    def _read(self, raw: str) -> None:
        at = {}
        for name, a, b, c in _ATTRIBUTE.findall(raw):
            at.setdefault(name.lower(), unescape(a or b or c).lower())
        names, role = at.get("class", ""), at.get("role")
        self.label = " ".join([self.tag, *sorted(set(_WORD.findall(names)))])
        self.region |= role in ("main", "article") or at.get("itemprop") == "articlebody"
        if role in OUTSIDE_ROLES or "hidden" in at or at.get("aria-hidden") == "true" or \
                "display:none" in at.get("style", "").replace(" ", ""):
            self.outside, self.weak = True, ""
        elif (self.weak or not self.outside) and self.tag not in ("html", "body", "main"):
            words = names.split() if self.region else _WORD.findall(names + " " + at.get("id", ""))
            if not OUTSIDE_WORDS.isdisjoint(words):
                self.outside, self.weak = True, "word"

    def children(self):
        return [c for c in self.items if isinstance(c, Node)]


def parse(html: str) -> Node:
    """The tree of a page's block elements; inline elements pass their text on to their block.

    Character references are decoded and white space is made single. Unclosed and misnested
    elements end where an element starts or ends that they cannot hold.
    """
    root = Node("#root")
    stack, pieces = [root], []
    links = linked = at = 0
    skip, skipped = None, []                 # an inline element left out, and blocks open in it
    last = html.rfind(">") + 1

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                stack[-1].items.append((text, linked))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and skip is None:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            linked += len(text.strip()) if links else 0

    def close(tags) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in SCOPE:
                return

    while at < last:
        token = _TOKEN.search(html, at, last)
        if token is None:
            break
        add(html[at:token.start()])
        at = token.end()
        if token.group(2) is None:
            continue
        tag, ends = token.group(2).lower(), bool(token.group(1))
        if skip is not None:
            if not ends and tag not in VOID and (tag in BLOCK or tag == skip):
                skipped.append(tag)
            elif ends and tag in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(tag):]
            elif ends and (tag == skip or (tag in BLOCK and any(n.tag == tag for n in stack))):
                was, skip = skip, None
                if tag == was:
                    continue
            if skip is not None:
                if not ends and tag in RAW:
                    stop = _RAW_END[tag].search(html, at)
                    at = stop.start() if stop else len(html)
                continue
        if ends:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                end_block()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        links = 0
                        break
        elif tag == "br":
            pieces.append(" ")
        elif tag in RAW:
            stop = _RAW_END[tag].search(html, at)
            at = stop.start() if stop else len(html)
        elif tag in BLOCK:
            end_block()
            links = 0
            if tag in CLOSES_P:
                close(("p",))
            if tag in SAME_KIND:
                close(SAME_KIND[tag])
            if tag in HEADINGS:
                close(HEADINGS)
            if len(stack) < MAX_DEPTH:
                node = Node(tag, token.group(3))
                stack[-1].items.append(node)
                if tag not in VOID:
                    stack.append(node)
        elif tag not in VOID:
            raw = token.group(3)
            if tag in OUTSIDE_TAGS or ("=" in raw or "hidden" in raw) and Node(tag, raw).outside:
                skip, skipped = tag, []
            elif tag == "a":
                links += 1
    add(html[at:])
    end_block()
    return root


def _reach(node: Node, wanted, mark: bool) -> bool:
    """Whether a wanted node stands below; with ``mark`` through parts that are only likely to be
    outside, which are then kept."""
    hit = False
    for c in node.children():
        if c.outside and not (mark and c.weak):
            continue
        if _reach(c, wanted, mark) or (wanted(c) and not c.outside):
            hit = True
            if mark:
                c.outside = False
    return hit


def _regions(node: Node, found: list) -> None:
    for c in node.children():
        if c.region and not c.outside:
            found.append(c)
        elif not c.outside:
            _regions(c, found)


def _settle_region(node: Node, in_article: bool) -> None:
    for c in node.children():
        if c.tag == "header" and c.weak == "tag":
            c.outside = False
        elif c.tag == "article" and in_article:
            c.outside = True
        _settle_region(c, in_article or c.tag == "article")


def _has_text(node: Node) -> bool:
    return any(not i.outside and _has_text(i) if isinstance(i, Node) else True for i in node.items)


def settle(root: Node) -> list[Node]:
    """Decide which parts are left out; returns the outermost article regions that hold text.

    A part that is only likely to be outside is kept where every region, or without regions every
    first-level heading, of the page stands in such parts. A header in a region belongs to it;
    an article in another one is a reader's comment.
    """
    for wanted in (lambda n: n.region, lambda n: n.tag == "h1"):
        if _reach(root, wanted, False) or _reach(root, wanted, True):
            break
    found: list[Node] = []
    _regions(root, found)
    for region in found:
        _settle_region(region, region.tag == "article")
    return [r for r in found if _has_text(r)]


def blocks(node: Node):
    """(text, characters in links, node) of the kept blocks below ``node`` in page order."""
    for i in node.items:
        if not isinstance(i, Node):
            yield i[0], i[1], node
        elif not i.outside:
            yield from blocks(i)


class Group:
    """Neighbouring elements of one label: the texts that stand directly in them (by hash), and the
    groups below. In a wrapper ``at`` numbers the groups in page order."""
    __slots__ = ("label", "texts", "children", "constant", "at")

    def __init__(self, label: str, texts, children: list):
        self.label, self.texts, self.children, self.constant, self.at = label, texts, children, frozenset(), 0

    def to_list(self) -> list:
        return [self.label, list(self.texts), [c.to_list() for c in self.children]]

    def labels(self) -> list:
        return [self.label, [], [c.labels() for c in self.children]]

    @staticmethod
    def of_list(data: list) -> Group:
        return Group(data[0], data[1], [Group.of_list(c) for c in data[2]])

    def numbered(self, start: int = 0) -> int:
        """Number the groups from ``start``; returns the number after the last."""
        self.at, n = start, start + 1
        for c in self.children:
            n = c.numbered(n)
        return n


def text_hash(text: str) -> str:
    return f"{xxh64_intdigest(text.encode('utf-8', 'surrogatepass')):x}"


def grouped(nodes: list[Node]) -> Group:
    """The tree that is matched, without the parts left out: repeated neighbours (paragraphs, list
    items, rows) are one group, so its size follows the layout and not the length of a page."""
    group, runs, last = Group(nodes[0].label, {}, []), [], None
    for n in nodes:
        n.group = group
        for i in n.items:
            if not isinstance(i, Node):
                group.texts[text_hash(i[0])] = 1
            elif not i.outside:
                if last != i.label:
                    runs.append([])
                    last = i.label
                runs[-1].append(i)
    if len(runs) > MANY_CHILDREN:
        by_label: dict = {}
        for r in runs:
            by_label.setdefault(r[0].label, []).extend(r)
        runs = list(by_label.values())
    group.children = [grouped(r) for r in runs]
    return group


def _matching(a: Group, b: Group, memo: dict) -> int:
    """Simple tree matching: size of the largest order-preserving matching of two trees whose
    roots match; ``memo`` keeps the table of each pair of nodes."""
    table = [[0] * (len(b.children) + 1)]
    for x in a.children:
        above, row = table[-1], [0]
        for j, y in enumerate(b.children):
            both = above[j] + _matching(x, y, memo) if x.label == y.label else 0
            row.append(max(row[j], above[j + 1], both))
        table.append(row)
    memo[id(a), id(b)] = table
    return table[-1][-1] + 1


def _aligned(a: Group, b: Group, memo: dict) -> list[tuple[int, int]]:
    table, i, j, out = memo[id(a), id(b)], len(a.children), len(b.children), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def absorb(wrapper: Group, page: Group, memo: dict | None = None) -> None:
    """Align a page, or another wrapper, with the wrapper and insert its further nodes."""
    if memo is None:
        _matching(wrapper, page, memo := {})
    pairs, merged, i, j = _aligned(wrapper, page, memo), [], 0, 0
    for x, y in [*pairs, (len(wrapper.children), len(page.children))]:
        merged += wrapper.children[i:x] + page.children[j:y]
        if x < len(wrapper.children) and y < len(page.children):
            absorb(wrapper.children[x], page.children[y], memo)
            merged.append(wrapper.children[x])
        i, j = x + 1, y + 1
    wrapper.children = merged


def aligned(wrapper: Group, page: Group, memo: dict | None = None):
    """The pairs of nodes of a wrapper and a page whose roots have one label."""
    if memo is None:
        _matching(wrapper, page, memo := {})
    yield wrapper, page
    for x, y in _aligned(wrapper, page, memo):
        yield from aligned(wrapper.children[x], page.children[y], memo)


def mark_constant(wrapper: Group, page: Group) -> None:
    """Align a page with the wrapper and note at its nodes which texts are the template's."""
    for w, p in aligned(wrapper, page):
        p.constant = frozenset(w.texts)


def put_texts(wrapper: Group, marks) -> None:
    """Give each node of a numbered wrapper the texts that ``marks`` (number -> texts) has for it."""
    wrapper.texts = marks.get(wrapper.at, [])
    for c in wrapper.children:
        put_texts(c, marks)
