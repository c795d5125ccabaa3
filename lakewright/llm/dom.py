"""Pages as small trees of blocks, for wrapper induction.

A tree has block elements and text slots only: inline elements are part of the text round them. Tags that a
page leaves open are closed as browsers do; a tree is at most DEEPEST levels deep (what lies deeper joins the
last level, so no text is lost).
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b
from zlib import crc32

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)", re.I)
WORD = re.compile(r"[a-z]+")

# Element names, and words of class, id and role that name a part of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head script style noscript template title textarea select option optgroup button form fieldset input object embed applet iframe noembed noframes canvas svg math audio video map nav footer aside menu dialog".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
HOLDS_P = frozenset("td th caption table button object html".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies dialog disclaimer discussion disqus "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related respond replies reply search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary".split()
)
HEAD_WORDS = frozenset(["header"])
MAIN_WORDS = frozenset("article articlebody content contents entry main maincontent post postbody story".split())
DEEPEST, WIDEST = 96, 64


class Node:
    """An element (key: its tag and a mark of its first class) or, with the empty key, a text slot."""

    __slots__ = ("key", "tag", "role", "kids", "text", "linked")

    def __init__(self, key: str, tag: str = "", role: str = ""):
        self.key, self.tag, self.role, self.kids, self.text, self.linked = key, tag, role, [], "", 0


def _role(tag: str, attributes: str) -> tuple[str, str]:
    """Role and a mark of the first class, without digits, in one byte.

    x, y: no content, by its tag or by its words; h: a head; a: an article; m: main; c: content by its words.
    """
    role = {"article": "a", "main": "m", "header": "h"}.get(tag, "x" if tag in NO_TEXT else "")
    mark = ""
    if attributes and "=" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            words = set(WORD.findall(value))
            if tag not in ("body", "html") and role not in ("x", "y"):
                if words & HEAD_WORDS:
                    role = role or "h"
                elif words & ASIDE_WORDS:
                    role = "y"
                elif not role and words & MAIN_WORDS:
                    role = "c"
            if name.lower() == "class" and value:
                mark = f".{crc32(''.join(c for c in value.split()[0] if not c.isdigit()).encode()) & 0xFF:02x}" if value.split() else ""
    return role, mark


def parse(page: str) -> Node:
    """The tree of a page; script and style, comments and markup are gone, character references decoded."""
    root = Node("html", "html")
    stack, links = [root], 0
    pending: list[str] = []
    linked = 0
    inline: list[str] = []

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                slot = Node("")
                slot.text, slot.linked = text, min(linked, len(text))
                stack[-1].kids.append(slot)
            pending.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal links
        flush()
        del stack[depth:]
        inline.clear()
        links = 0

    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            text = html.unescape(text) if "&" in text else text
            pending.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
            elif tag == "a":
                links = 0 if found[1] else 1
            continue
        if found[1]:
            if tag not in ("html", "body"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close_to(depth)
                        break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else n
            if end is None or (close := page.find(">", at)) < 0:
                at = n
            else:
                at = close + 1
            continue
        if tag in ("html", "body") and len(stack) > 1 and tag != "body":
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in HOLDS_P:
                    break
        if tag == "body":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "head":
                    close_to(depth)
                    break
        ends, within = CLOSES.get(tag, ((), ()))
        if ends:
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in within:
                    break
                if stack[depth].tag in ends:
                    lowest = depth
            if lowest:
                close_to(lowest)
        flush()
        links = 0
        if tag in VOID:
            continue
        role, mark = _role(tag, found[3])
        node = Node(tag + mark, tag, role)
        stack[-1].kids.append(node)
        if len(stack) < DEEPEST:
            stack.append(node)
    flush()
    return root


class Slot:
    """A node of a wrapper: how many pages have it, how much text, how much of that in links, and its text as long as that is one."""

    __slots__ = ("key", "role", "pages", "chars", "linked", "mark", "kids")

    def __init__(self, key: str, role: str, pages: int, chars: int = 0, linked: int = 0, mark: str = "", kids: list | None = None):
        self.key, self.role, self.pages, self.chars, self.linked, self.mark, self.kids = key, role, pages, chars, linked, mark, kids if kids is not None else []

    def packed(self) -> list:
        return [self.key, self.role, self.pages, self.chars, self.linked, self.mark, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Slot:
        return Slot(*x[:6], [Slot.unpacked(k) for k in x[6]])


def runs(kids: list) -> list[list]:
    """Neighbours of one key are one run; in a list of more than WIDEST runs all of one key are."""
    out: list[list] = []
    for k in kids:
        if out and out[-1][0].key == k.key and out[-1][0].role == k.role:
            out[-1].append(k)
        else:
            out.append([k])
    if len(out) > WIDEST:
        by_key: dict[tuple, list] = {}
        for run in out:
            by_key.setdefault((run[0].key, run[0].role), []).extend(run)
        out = list(by_key.values())
    return out


def matched(a, b) -> int:
    """Simple tree matching: how many nodes of two trees an alignment in order pairs."""
    if a.key != b.key or a.role != b.role:
        return 0
    if not a.kids or not b.kids:
        return 1
    last = [0] * (len(b.kids) + 1)
    for x in a.kids:
        row = [0]
        for j, y in enumerate(b.kids):
            w = matched(x, y)
            row.append(max(last[j + 1], row[j], last[j] + w if w else 0))
        last = row
    return 1 + last[-1]


def aligned(a: list, b: list) -> list[tuple]:
    """Pairs of two lists of nodes, in order, that match best; None where one list has no counterpart."""
    if len(a) == len(b) and all(x.key == y.key and x.role == y.role for x, y in zip(a, b, strict=True)):
        return list(zip(a, b, strict=True))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = [[matched(x, y) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + gain[i][j] if gain[i][j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if gain[i][j] and best[i][j] == best[i + 1][j + 1] + gain[i][j]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out + [(x, None) for x in a[i:]] + [(None, y) for y in b[j:]]


def merged(a: Slot, b: Slot, same_page: bool = False) -> Slot:
    """The wrapper that two wrappers with one root have in common, with the slots that only one of them has."""
    mark = a.mark if a.mark == b.mark else "*"
    kids = a.kids if not b.kids else b.kids if not a.kids else [x and y and merged(x, y, same_page) or x or y for x, y in aligned(a.kids, b.kids)]
    if len(kids) > WIDEST:
        kids = [_folded(r, same_page) for r in runs(kids)]
    return Slot(a.key, a.role, max(a.pages, b.pages) if same_page else a.pages + b.pages, a.chars + b.chars, a.linked + b.linked, mark, kids)


def _folded(run: list[Slot], same_page: bool) -> Slot:
    out = run[0]
    for s in run[1:]:
        out = merged(out, s, same_page)
    return out


def wrapper(node: Node) -> Slot:
    """A page as the wrapper of itself."""
    if not node.key:
        return Slot("", "", 1, len(node.text), node.linked, blake2b(node.text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())
    return Slot(node.key, node.role, 1, kids=[_folded([wrapper(k) for k in run], True) for run in runs(node.kids)])
