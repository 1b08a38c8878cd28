"""A page as a tree of block nodes with their features and their text."""

from __future__ import annotations

import html
import math
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-keep)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPLIT_NAME = re.compile(r"[^a-z0-9]+")

# How HTML classes its elements
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noframes xmp".split())
UNSEEN = set("select template svg annotation annotation-xml".split())  # fields, drawings and sources; nothing if never closed
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr br math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom"
    " menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": set()}

TAG_GROUPS = {
    name: i
    for i, names in enumerate(
        "p|h1 h2 h3 h4 h5 h6|li dt dd|ul ol dl menu|div center|section|article|main|nav|header hgroup|footer|aside"
        "|form fieldset button input legend|table tbody thead tfoot tr td th|blockquote pre figure figcaption|html body".split("|"),
        1,
    )
    for name in names.split()
}
GROUPS = max(TAG_GROUPS.values()) + 1
AWAY = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom copyright sidebar side aside"
    " widget related recommended share social ad ads advert advertisement adsense promo promoted sponsor sponsored banner"
    " cookie cookies consent notice alert popup modal newsletter subscribe signup login form search comment comments"
    " respond reply replies discussion disqus pagination pager tags meta toolbar contentinfo complementary"
    " dialog".split()
)
TOWARDS = set("article content main post body entry story text page blog prose".split())


class Node:
    __slots__ = (
        "attrs", "away", "children", "depth", "group", "index", "keep", "links", "marks", "order", "parent", "paragraphs",
        "size", "tag", "text", "towards", "upper",
    )

    def __init__(self, tag: str, parent: "Node | None", index: int, attrs: str):
        self.tag, self.parent, self.index = tag, parent, index
        self.group = TAG_GROUPS.get(tag, 0)
        self.depth = parent.depth + 1 if parent else 0
        self.order = len(parent.children) if parent else 0
        self.children: list[Node] = []
        self.text = self.links = self.marks = self.upper = self.paragraphs = 0  # of the whole subtree in the end
        self.size = 1
        self.keep: str | None = None
        self.away = self.towards = 0
        if parent:
            parent.children.append(self)
        if attrs:
            for name, value in ATTRIBUTE.findall(attrs):
                value = value.strip("\"'")
                if name.lower() == "data-keep":
                    self.keep = value
                else:
                    tokens = set(SPLIT_NAME.split(value.lower()))
                    self.away += len(tokens & AWAY)
                    self.towards += len(tokens & TOWARDS)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Block nodes in page order, and text pieces as (node, text); a text of None is a break inside the block.

    Scripts, styles, fields and comments leave nothing. A tag cut off by the end of the
    page is dropped, elements left open end with their parent. A slash before the end of
    a tag closes nothing. The time is linear in the page, however deep it is nested.
    """
    root = Node("html", None, 0, "")
    nodes, pieces = [root], []
    stack = [root]
    at, in_link = 0, False

    open_at: dict[str, list[int]] = {}  # places in the stack, by tag

    def pop_to(tag: str, fence: set[str]) -> None:
        places = open_at.get(tag)
        if not places or any(open_at.get(other, places)[-1:] > places[-1:] for other in fence):
            return
        bottom = places[-1]
        while len(stack) > bottom:
            open_at[stack.pop().tag].pop()

    def say(text: str) -> None:
        top = stack[-1]
        pieces.append((top.index, text))
        size = len(text.strip())
        top.text += size
        if in_link:
            top.links += size
        top.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    lowered = None
    ended: set[str] = set()  # tags that are not closed any more
    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            say(html.unescape(page[at:]))
            break
        if found.start() > at:
            say(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["close"]:
            if tag == "a":
                in_link = False
            elif tag not in INLINE and tag not in ("html", "body"):
                pop_to(tag, set())
            continue
        if tag in RAW or tag in UNSEEN:
            lowered = page.lower() if lowered is None else lowered
            end = -1 if tag in ended else lowered.find("</" + tag, at) if len(lowered) == len(page) else -2
            if end == -2:
                later = re.compile("</" + re.escape(tag), re.I).search(page, at)
                end = later.start() if later else -1
            if end >= 0:
                at = end
            elif tag in RAW:
                at = len(page)
            else:
                ended.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = True
            elif tag == "br":
                pieces.append((stack[-1].index, None))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            pop_to("p", {"td", "th", "table", "button", "li"} if tag != "p" else {"td", "th", "table", "button"})
        if tag in CLOSED_BY_SAME:
            pop_to(tag, CLOSED_BY_SAME[tag])
        node = Node(tag, stack[-1], len(nodes), found["attrs"])
        nodes.append(node)
        if tag == "p":
            node.paragraphs = 1
        if tag not in VOID:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
    for node in reversed(nodes):
        if node.parent is not None:
            up = node.parent
            up.text += node.text
            up.links += node.links
            up.marks += node.marks
            up.size += node.size
            up.paragraphs += node.paragraphs
    return nodes, pieces


def features(nodes: list[Node]) -> list[list[float]]:
    """Features of each node: tag, names, subtree density, depth, siblings, and what lies above it."""
    total = nodes[0].text + 1
    above: list[tuple[int, int, int, int, int]] = []  # away, towards, tag seen: frame, content, list or form
    out = []
    for node in nodes:
        up = node.parent
        a, t, frame, content, listed = above[up.index] if up else (0, 0, 0, 0, 0)
        siblings = len(up.children) if up else 1
        around = (up.text - node.text) / max(siblings - 1, 1) if up else 0
        text = node.text
        out.append(
            [
                node.group,
                up.group if up else 0,
                node.away,
                node.towards,
                a,
                t,
                frame,
                content,
                listed,
                node.depth,
                node.order,
                node.order / siblings,
                siblings,
                len(node.children),
                node.size,
                math.log1p(text),
                text / total,
                node.links / (text + 1),
                text / node.size,
                node.marks / (text + 1),
                node.paragraphs,
                math.log1p(around),
                text / (up.text + 1) if up else 1,
                up.links / (up.text + 1) if up else 0,
                up.paragraphs if up else 0,
                node.index / len(nodes),
            ]
        )
        above.append(
            (
                a + node.away,
                t + node.towards,
                frame + (node.tag in ("nav", "header", "footer", "aside", "form")),
                content + (node.tag in ("article", "main")),
                listed + (node.tag in ("ul", "ol", "form", "table")),
            )
        )
    return out


def decode(nodes: list[Node], scores: list[float], opening: float = 1.0) -> list[bool]:
    """Best labels that agree along every path: outside, then in the article, then dropped from it for good.

    ``scores`` are log odds of being article. A node in the article below one that is not
    opens a region, which costs ``opening``; a node below a dropped one is dropped.
    """
    n = len(nodes)
    inside = [0.0] * n  # best total of the subtree if the node is article
    outside = [0.0] * n  # if it is not, with regions below allowed
    dropped = [0.0] * n  # if all of it is out
    for i in range(n - 1, -1, -1):
        yes = -math.log1p(math.exp(-max(min(scores[i], 30.0), -30.0)))
        no = yes - max(min(scores[i], 30.0), -30.0)
        inside[i] += yes
        outside[i] += no
        dropped[i] += no
        if i:
            up = nodes[i].parent.index
            inside[up] += max(inside[i], dropped[i])
            outside[up] += max(outside[i], inside[i] - opening)
            dropped[up] += dropped[i]
    state = [""] * n
    state[0] = "in" if inside[0] - opening > outside[0] else "out"
    for i in range(1, n):
        up = state[nodes[i].parent.index]
        if up == "in":
            state[i] = "in" if inside[i] >= dropped[i] else "drop"
        elif up == "out":
            state[i] = "in" if inside[i] - opening > outside[i] else "out"
        else:
            state[i] = "drop"
    return [s == "in" for s in state]


def block_text(pieces: list[tuple[int, str | None]], kept: list[bool]) -> str:
    """Text of the kept nodes: a block's own white space becomes one space, blocks join by one space."""
    blocks: list[list[str]] = []
    last = -1
    for node, text in pieces:
        if kept[node]:
            said = " " if text is None else text
            if node == last:
                blocks[-1].append(said)
            else:
                blocks.append([said])
        last = node
    said = (" ".join("".join(block).split()) for block in blocks)
    return " ".join(block for block in said if block)
