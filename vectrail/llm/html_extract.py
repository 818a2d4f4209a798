"""Layout-aware rendering of HTML to plain text.

A forgiving tree builder adds the tags that HTML leaves implied, visibility
rules drop what a browser would not show, and the renderer lays the rest out:
blank lines between blocks, markers and indentation for lists, padded columns
for tables, preformatted text as written.

Visibility follows the cascade of ``display`` and ``visibility``: the page's
style sheets by importance, specificity and order, inline styles over them, the
``hidden`` attribute beneath. Media rules are those of a screen 1280 pixels
wide. External style sheets and scripts are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements nested deeper are laid out as plain blocks; what is visible stays so, and what is hidden too.
LAYOUT_DEPTH = 120
SCREEN_WIDTH = 1280

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)([^>]*)>?")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_PART = re.compile(r"""\s*([>+~])\s*|\s+|(\*|[a-zA-Z][\w-]*)|([.#])((?:[\w-]|[^\x00-\x7f]|\\.)+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*[is]?\s*)?\]|(:root)\b""")
_LENGTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)\s*(px|em|rem)\s*\)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
BLOCK_DISPLAY = frozenset("block flex grid flow-root list-item table table-row table-caption table-row-group table-header-group table-footer-group".split())
INLINE_DISPLAY = frozenset("inline inline-block inline-flex inline-grid contents".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist rp param source track map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = HEADINGS | frozenset("p ul ol dl table blockquote pre figure hr menu dir fieldset".split())
BLOCKS = SPACED | frozenset("html body div section article aside nav header footer main address center form li dt dd tr td th thead tbody tfoot caption figcaption details summary legend hgroup search dialog option optgroup select xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary table ul li dd dt xmp".split()) | HEADINGS
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: start tag -> (open elements that it ends, elements beyond which it doesn't look)
IMPLIED_END = {
    "li": ({"li"}, LISTS | {"table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "a": ({"a"}, {"table", "td", "th", "li", "p", "div"}),
    "body": ({"head"}, set()),
}
HEAD_ONLY = frozenset("title meta link base style script noscript template head html".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []  # type: ignore[var-annotated]

    def get(self, name: str) -> str | None:
        """Value of an attribute, '' if it has none, None if absent."""
        if not self.attrs or name not in self.attrs.lower():
            return None
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind in text, open, close."""
    at, end, lower = 0, len(html), None
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        nxt = html[lt + 1 : lt + 2]
        if nxt and nxt in "!?":
            stop = html.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if m is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW or name in RCDATA:
            lower = html.lower() if lower is None else lower
            if len(lower) != end:  # a character whose lower case is longer
                lower = re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            stop = lower.find(f"</{name}", at)
            stop = end if stop < 0 else stop
            if stop > at:
                yield "text" if name in RCDATA else "raw", html[at:stop], ""
            at = stop


def build(html: str) -> Node:
    """The element tree, with implied tags in place, however deep."""
    root = Node("html")
    stack = [root]
    opened: dict[str, int] = {}
    seen_body = False

    def pop_to(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for node in stack[i:]:
                    opened[node.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def push(tag: str, attrs: str = "") -> None:
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1

    scope = frozenset(("table", "td", "th", "caption", "button", "template"))
    for kind, name, attrs in tokens(html):
        if kind != "open" and kind != "close":
            if not seen_body and stack[-1].tag == "head" and name.strip():
                pop_to({"head"}, set())
                seen_body = True
            if stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not name.strip():
                continue
            stack[-1].children.append(name if kind == "raw" else unescape(name) if "&" in name else name)
            continue
        if kind == "open":
            if name == "html":
                root.attrs = root.attrs or attrs
                continue
            if name == "body":
                pop_to({"head"}, set())
                if seen_body:
                    continue
                seen_body = True
            elif name not in HEAD_ONLY and not seen_body:
                pop_to({"head"}, set())
                seen_body = True
            if name in CLOSES_P:
                pop_to({"p"}, scope)
                if name in HEADINGS and stack[-1].tag in HEADINGS:
                    opened[stack.pop().tag] -= 1
            if name in IMPLIED_END:
                ends, beyond = IMPLIED_END[name]
                while True:
                    depth = len(stack)
                    pop_to(ends, beyond)
                    if len(stack) == depth:
                        break
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr")
            push(name, attrs)
        elif name == "br":
            push("br")
        elif name in ("html", "body", "head") or name in VOID:
            if name == "head":
                pop_to({"head"}, set())
        elif name == "p" and not opened.get("p"):
            stack[-1].children.append(Node("p", "", stack[-1]))
        elif name in HEADINGS:
            pop_to(HEADINGS, scope)
        else:
            pop_to({name}, frozenset() if name in scope else frozenset(("table", "td", "th")) if name not in ("tr", "tbody", "thead", "tfoot") else frozenset(("table",)))
    return root


def _screen(query: str) -> bool:
    """Whether a media query list holds on the screen that pages are laid out for."""
    for one in query.lower().split(","):
        words = one.strip()
        negated = words.startswith("not ")
        words = re.sub(r"^(?:not|only)\s+", "", words)
        kind = re.match(r"[a-z-]+", words)
        holds = kind is None or kind[0] in ("all", "screen", "and")
        for feature in re.findall(r"\([^)]*\)", words):
            m = _LENGTH.match(feature)
            if m:
                width = float(m[2]) * (1 if m[3] == "px" else 16)
                holds = holds and (SCREEN_WIDTH >= width if m[1] == "min" else SCREEN_WIDTH <= width)
            else:
                holds = holds and re.sub(r"\s", "", feature) in ("(orientation:landscape)", "(hover:hover)", "(hover)", "(pointer:fine)", "(color)", "(prefers-color-scheme:light)", "(prefers-reduced-motion:no-preference)")
        if holds != negated:
            return True
    return not query.strip()


def _declared(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the declarations that matter here."""
    out = []
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in ("display", "visibility"):
            bare = re.sub(r"\s*!\s*important$", "", value)
            if re.fullmatch(r"[a-z-]+(?: [a-z-]+)*", bare):
                out.append((name, bare.split()[-1] if name == "display" else bare, bare != value))
    return out


Compound = tuple[str, frozenset[str], frozenset[str], tuple[tuple[str, str, str], ...]]


def _selector(text: str) -> tuple[list[Compound], list[str], tuple[int, int, int]] | None:
    """(compounds, what joins each to the one before, specificity); None for selectors that state or structure decides."""
    compounds: list[list] = []
    joins: list[str] = []
    fresh, join, at, text = True, " ", 0, text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or m.end() == at:
            return None
        at = m.end()
        if m[1] or not m[0].strip():
            if fresh:
                return None
            fresh, join = True, m[1] or " "
            continue
        if fresh:
            if compounds:
                joins.append(join)
            compounds.append(["", set(), set(), []])
            fresh = False
        c = compounds[-1]
        if m[2]:
            c[0] = "" if m[2] == "*" else m[2].lower()
        elif m[3]:
            c[1 if m[3] == "#" else 2].add(re.sub(r"\\(.)", r"\1", m[4]))
        elif m[5]:
            c[3].append((m[5].lower(), m[6] or "", (m[7] or "").strip("\"'")))
        else:
            c[0] = "html"
    if fresh:
        return None
    made = [(t, frozenset(i), frozenset(k), tuple(a)) for t, i, k, a in compounds]
    return made, joins, (sum(len(c[1]) for c in made), sum(len(c[2]) + len(c[3]) for c in made), sum(bool(c[0]) for c in made))


def _has(value: str | None, test: str, wanted: str) -> bool:
    if value is None or not test:
        return value is not None
    if test == "~=":
        return wanted in value.split()
    if test == "|=":
        return value == wanted or value.startswith(wanted + "-")
    if test == "=":
        return value == wanted
    return bool(wanted) and (value.startswith(wanted) if test == "^=" else value.endswith(wanted) if test == "$=" else wanted in value)


def _fits(node: Node, c: Compound) -> bool:
    tag, ids, classes, attrs = c
    return (
        (not tag or tag == node.tag)
        and (not ids or ids == {node.get("id")})
        and (not classes or classes <= set((node.get("class") or "").split()))
        and all(_has(node.get(n), t, w) for n, t, w in attrs)
    )


def _before(node: Node) -> list[Node]:
    """Elder siblings, nearest first."""
    siblings = [x for x in (node.parent.children if node.parent else ()) if isinstance(x, Node)]
    at = next(i for i, x in enumerate(siblings) if x is node) if siblings else 0
    return siblings[:at][::-1]


def _matches(node: Node, compounds: list[Compound], joins: list[str], k: int) -> bool:
    if not _fits(node, compounds[k]):
        return False
    if not k:
        return True
    join = joins[k - 1]
    if join in "+~":
        return any(_matches(x, compounds, joins, k - 1) for x in (_before(node)[:1] if join == "+" else _before(node)))
    up = node.parent
    while up is not None:
        if _matches(up, compounds, joins, k - 1):
            return True
        up = None if join == ">" else up.parent
    return False


class Styles:
    """What the page's style sheets say of ``display`` and ``visibility``."""

    __slots__ = ("count", "rules")

    def __init__(self, root: Node) -> None:
        #: by the tag, id or class that the last compound asks for
        self.rules: dict[str, list[tuple]] = {}
        self.count = 0
        pending = [root]
        while pending:
            node = pending.pop()
            for child in reversed(node.children):
                if isinstance(child, Node) and child.tag not in ("script", "template"):
                    pending.append(child)
            if node.tag == "style" and _screen(node.get("media") or ""):
                self._sheet(_COMMENT.sub(" ", "".join(c for c in node.children if isinstance(c, str))))

    def _sheet(self, sheet: str) -> None:
        """Rules in the order of the sheet; at-rules that hold are entered, others left out."""
        at, start, closing = 0, 0, []
        for m in re.finditer(r"""[{};]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", sheet):
            if m.start() < at or m[0][0] in "\"'":
                continue
            if m[0] == ";":
                start = m.end()
            elif m[0] == "}":
                if closing:
                    closing.pop()
                start = m.end()
            else:
                head = sheet[start : m.start()].strip()
                name = re.match(r"@([\w-]+)", head)
                if name and name[1].lower() in ("media", "supports", "layer", "container", "scope") and (name[1].lower() != "media" or _screen(head[6:])):
                    closing.append(head)
                    start = m.end()
                    continue
                end = self._end(sheet, m.end())
                if not name:
                    self._rule(head, sheet[m.end() : end])
                at = start = end + 1

    @staticmethod
    def _end(sheet: str, at: int) -> int:
        depth = 1
        for m in re.compile(r"[{}]").finditer(sheet, at):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.start()
        return len(sheet)

    def _rule(self, head: str, body: str) -> None:
        said = _declared(body)
        if not said:
            return
        for one in re.split(r",(?![^\[(]*[\])])", head):
            parsed = _selector(one)
            if parsed is None:
                continue
            self.count += 1
            compounds, joins, weight = parsed
            tag, ids, classes, _ = compounds[-1]
            key = "#" + next(iter(ids)) if ids else "." + next(iter(classes)) if classes else tag or "*"
            self.rules.setdefault(key, []).append((weight, self.count, compounds, joins, said))

    def of(self, node: Node) -> tuple[str, str]:
        """(display, visibility) that the cascade gives an element; '' where nothing is said."""
        best: dict[str, tuple[tuple, str]] = {}

        def say(name: str, rank: tuple, value: str) -> None:
            if name not in best or rank >= best[name][0]:
                best[name] = (rank, value)

        if self.rules:
            keys = ["*", node.tag]
            if node.attrs:
                keys += ["#" + (node.get("id") or "")] + ["." + c for c in (node.get("class") or "").split()]
            for key in keys:
                for weight, order, compounds, joins, said in self.rules.get(key, ()):
                    if _matches(node, compounds, joins, len(compounds) - 1):
                        for name, value, important in said:
                            say(name, (important, False, weight, order), value)
        if node.attrs:
            for name, value, important in _declared(node.get("style") or ""):
                say(name, (important, True, (0, 0, 0), 0), value)
            if "display" not in best and ((hide := node.get("hidden")) is not None and hide.lower() != "until-found"):
                return "none", ""
        return tuple(best[n][1] if n in best else "" for n in ("display", "visibility"))  # type: ignore[return-value]


def _seen(node: Node, styles: Styles, seen: bool) -> tuple[bool, bool, str]:
    """(whether the element takes part in the layout, whether its text is visible, its display)."""
    if node.tag in UNSEEN:
        return False, False, "none"
    if not node.attrs and not styles.rules:
        return node.tag != "dialog", seen, ""
    display, visibility = styles.of(node)
    if display == "none" or (node.tag == "dialog" and not display and node.get("open") is None):
        return False, False, "none"
    if visibility in ("hidden", "collapse"):
        seen = False
    elif visibility in ("visible", "initial"):
        seen = True
    return True, seen, display


class Flow:
    """Lines of a block being laid out."""

    __slots__ = ("inline", "lines", "margin", "started")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.margin, self.started = 0, False

    def _space(self) -> None:
        if self.started:
            self.lines.extend([""] * self.margin)
        self.margin, self.started = 0, True

    def flush(self) -> None:
        if not self.inline:
            return
        run = _SPACE.sub(" ", "".join(self.inline))
        self.inline = []
        rows = [x.strip(" ") for x in run.split("\x01")]
        if not rows[-1]:
            rows.pop()
        if rows:
            self._space()
            self.lines.extend(rows)

    def add(self, lines: list[str]) -> None:
        self.flush()
        if lines:
            self._space()
            self.lines.extend(lines)

    def gap(self, n: int) -> None:
        self.flush()
        self.margin = max(self.margin, n)


def _walk(node: Node, flow: Flow, styles: Styles, seen: bool, depth: int = 0) -> None:
    if depth > LAYOUT_DEPTH:
        _plain(node, flow, styles, seen)
        return
    for child in node.children:
        if isinstance(child, str):
            if seen:
                flow.inline.append(child)
            continue
        tag = child.tag
        if tag == "br":
            flow.inline.append("\x01")
            continue
        there, visible, display = _seen(child, styles, seen)
        if not there:
            continue
        if tag == "input":
            flow.inline.append(_entry(child) if visible else "")
            continue
        block = display in BLOCK_DISPLAY or (tag in BLOCKS and display not in INLINE_DISPLAY)
        if not block:
            if tag == "q" and visible:
                flow.inline.append('"')
                _walk(child, flow, styles, visible, depth + 1)
                flow.inline.append('"')
            elif tag == "svg":
                _drawing(child, flow, styles, visible, depth + 1)
            elif tag in ("pre", "xmp"):
                flow.inline.append(" ".join(_preformatted(child, styles, visible)))
            elif tag == "select":
                flow.inline.append(" ".join(_selected(child, styles, visible)))
            else:
                _walk(child, flow, styles, visible, depth + 1)
            continue
        space = 1 if tag in SPACED and not (tag in LISTS and node.tag == "li") else 0
        flow.gap(space)
        if tag in ("pre", "xmp"):
            flow.add(_preformatted(child, styles, visible))
        elif tag in LISTS:
            flow.add(_list(child, styles, visible, depth + 1))
        elif tag == "table":
            flow.add(_table(child, styles, visible, depth + 1))
        elif tag == "blockquote" or tag == "dd":
            flow.add(_indented(child, styles, visible, depth + 1))
        elif tag == "li":
            flow.add(_item(child, "- ", styles, visible, depth + 1))
        elif tag == "select":
            flow.add(_selected(child, styles, visible))
        elif tag == "svg":
            _drawing(child, flow, styles, visible, depth + 1)
        elif tag == "details" and child.get("open") is None:
            summary = Node("div", "", child)
            summary.children = [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]
            _walk(summary, flow, styles, visible, depth + 1)
        elif tag != "hr":
            _walk(child, flow, styles, visible, depth + 1)
        flow.gap(space)


def _entry(node: Node) -> str:
    """What an input shows."""
    kind = (node.get("type") or "text").lower()
    return node.get("value") or "" if kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") else ""


def _plain(node: Node, flow: Flow, styles: Styles, seen: bool) -> None:
    """The visible text below ``node`` in order, with a line for each block: what _walk does without recursion, lists, tables and quotes."""
    pending: list[tuple[Node | str | None, bool]] = [(c, seen) for c in reversed(node.children)]
    while pending:
        x, visible = pending.pop()
        if x is None:
            flow.gap(0)
        elif isinstance(x, str):
            if visible:
                flow.inline.append(x)
        elif x.tag == "br":
            flow.inline.append("\x01")
        else:
            there, shown, display = _seen(x, styles, visible)
            if not there:
                continue
            if x.tag == "input":
                flow.inline.append(_entry(x) if shown else "")
                continue
            children = x.children
            if x.tag == "details" and x.get("open") is None:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if x.tag == "svg":
                children = [c for c in children if isinstance(c, Node)]
            if x.tag == "select":
                flow.add(_selected(x, styles, shown))
                continue
            if display in BLOCK_DISPLAY or (x.tag in BLOCKS and display not in INLINE_DISPLAY):
                flow.gap(0)
                pending.append((None, False))
            pending.extend((c, shown) for c in reversed(children))


def _drawing(node: Node, flow: Flow, styles: Styles, seen: bool, depth: int) -> None:
    """The words of a drawing: those inside its text elements."""
    pending: list[tuple[Node, bool]] = [(c, seen) for c in reversed(node.children) if isinstance(c, Node)]
    while pending:
        x, visible = pending.pop()
        there, shown, _ = _seen(x, styles, visible)
        if not there or x.tag in ("defs", "symbol", "desc", "metadata", "clippath", "mask", "pattern", "marker"):
            continue
        if x.tag in ("text", "foreignobject"):
            flow.inline.append(" ")
            _walk(x, flow, styles, shown, depth)
            flow.inline.append(" ")
        else:
            pending.extend((c, shown) for c in reversed(x.children) if isinstance(c, Node))


def _lines(node: Node, styles: Styles, seen: bool, depth: int = 0) -> list[str]:
    flow = Flow()
    _walk(node, flow, styles, seen, depth)
    flow.flush()
    return flow.lines


def _alone(child: Node | str, styles: Styles, seen: bool, depth: int) -> list[str]:
    """Lines of one child, its own visibility applied."""
    holder = Node("div")
    holder.children = [child]
    return _lines(holder, styles, seen, depth)


def _indented(node: Node, styles: Styles, seen: bool, depth: int) -> list[str]:
    return [f"  {x}" if x else x for x in _lines(node, styles, seen, depth)]


def _item(node: Node, marker: str, styles: Styles, seen: bool, depth: int) -> list[str]:
    lines = _lines(node, styles, seen, depth)
    pad = " " * len(marker)
    return [(marker if i == 0 else pad) + x if x or i == 0 else x for i, x in enumerate(lines)]


def _number(text: str | None, otherwise: int) -> int:
    try:
        return int((text or "").strip()[:9])
    except ValueError:
        return otherwise


def _list(node: Node, styles: Styles, seen: bool, depth: int) -> list[str]:
    flow, ordered = Flow(), node.tag == "ol"
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    down = ordered and node.get("reversed") is not None
    n = _number(node.get("start"), items if down else 1)
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            n = _number(child.get("value"), n) if ordered else n
            there, visible, _ = _seen(child, styles, seen)
            shown = _item(child, f"{n}. " if ordered else "- ", styles, visible, depth) if there else []
            flow.add(shown)
            if shown:
                n += -1 if down else 1
        else:
            flow.add([f"  {x}" if x else x for x in _alone(child, styles, seen, depth)])
    flow.flush()
    return flow.lines


def _selected(node: Node, styles: Styles, seen: bool) -> list[str]:
    options, pending = [], [(c, seen) for c in reversed(node.children) if isinstance(c, Node)]
    while pending:
        x, visible = pending.pop()
        there, shown, _ = _seen(x, styles, visible)
        if not there:
            continue
        if x.tag == "option":
            options.append((x, shown))
        else:
            pending.extend((c, shown) for c in reversed(x.children) if isinstance(c, Node))
    chosen = [o for o in options if o[0].get("selected") is not None] or options[:1]
    return [x for o, shown in chosen if (x := _SPACE.sub(" ", _text(o, styles, shown)).strip(" "))]


def _text(node: Node, styles: Styles, seen: bool) -> str:
    """All visible text below ``node`` as it is written."""
    out, pending = [], [(c, seen) for c in reversed(node.children)]
    while pending:
        x, visible = pending.pop()
        if isinstance(x, str):
            if visible:
                out.append(x)
        elif x.tag == "br":
            out.append("\n")
        else:
            there, shown, display = _seen(x, styles, visible)
            if there:
                if display in BLOCK_DISPLAY or (x.tag in BLOCKS and display not in INLINE_DISPLAY):
                    if out and not out[-1].endswith("\n"):
                        out.append("\n")
                    pending.append(("\n", True))
                pending.extend((c, shown) for c in reversed(x.children))
    return "".join(out)


def _preformatted(node: Node, styles: Styles, seen: bool) -> list[str]:
    text = _text(node, styles, seen).replace("\r\n", "\n").replace("\r", "\n")
    lines = (text[1:] if text.startswith("\n") else text).split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    return [x.rstrip() for x in lines]


def _table(node: Node, styles: Styles, seen: bool, depth: int) -> list[str]:
    rows: list[list[tuple[list[str], int]]] = []
    before = Flow()
    held: dict[int, int] = {}

    def section(part: Node, visible: bool, level: int) -> None:
        for child in part.children:
            if isinstance(child, str):
                if visible and child.strip():
                    before.inline.append(child)
                continue
            if child.tag in ("thead", "tbody", "tfoot", "colgroup", "tr") and level < LAYOUT_DEPTH:
                there, shown, _ = _seen(child, styles, visible)
                if there and child.tag == "tr":
                    row(child, shown)
                elif there:
                    section(child, shown, level + 1)
            else:  # the caption, and content that doesn't belong in a table, come first
                before.add(_alone(child, styles, visible, depth))

    def row(tr: Node, visible: bool) -> None:
        cells: list[tuple[list[str], int]] = []
        at = 0

        def skip() -> None:
            nonlocal at
            while held.get(at, 0):
                held[at] -= 1
                cells.append(([], 1))
                at += 1

        for child in tr.children:
            if isinstance(child, str):
                if visible and child.strip():
                    before.inline.append(child)
                continue
            if child.tag not in ("td", "th"):
                before.add(_alone(child, styles, visible, depth))
                continue
            there, shown, _ = _seen(child, styles, visible)
            if not there:
                continue
            skip()
            span = min(max(1, _number(child.get("colspan"), 1)), 1000)
            down = min(max(1, _number(child.get("rowspan"), 1)), 65534)
            cells.append((_lines(child, styles, shown, depth), span))
            for c in range(at, at + span):
                if down > 1:
                    held[c] = down - 1
            at += span
        skip()
        rows.append(cells)

    section(node, seen, depth)
    before.flush()
    widths: dict[int, int] = {}
    room = lambda at, span: sum(widths.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
    for wide in (False, True):  # a cell over several columns widens the last of them by what it lacks
        for cells in rows:
            at = 0
            for lines, span in cells:
                if (span > 1) == wide:
                    lack = max(map(len, lines), default=0) - room(at, span)
                    if lack > 0:
                        widths[at + span - 1] = widths.get(at + span - 1, 0) + lack
                at += span
    out = list(before.lines)
    for cells in rows:
        height = max((len(lines) for lines, _ in cells), default=0)
        for i in range(height):
            parts, at = [], 0
            for lines, span in cells:
                parts.append((lines[i] if i < len(lines) else "").ljust(room(at, span)))
                at += span
            if any(x.strip() for x in parts):
                out.append(" | ".join(parts).rstrip(" "))
    return out


def render(html: str | None) -> str | None:
    """Visible text of a page; None for None."""
    if html is None:
        return None
    root = build(html.replace("\x00", "").replace("\x01", ""))
    return "\n".join(x.replace("\xa0", " ").rstrip(" ") for x in _lines(root, Styles(root), True)).strip("\n")


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: ``page_id`` and ``text``.

    A null page gives null and an empty one ''. Anything is accepted as HTML:
    text without tags is a paragraph, tags that never end run to the end of the
    page, and elements nested more than LAYOUT_DEPTH deep are plain blocks.
    Pages are rendered whole, whatever their length. Repeated rows give
    repeated rows; a null id is an id; extra columns are not read, whatever
    their names; an empty table gives an empty result. Rows stay where they
    are: nothing is shuffled.
    """

    @F.pandas_udf("string")
    def text_of(batch: pd.Series) -> pd.Series:
        return batch.map(render, na_action="ignore")

    return pages.select(F.col(page_id).alias(page_id), text_of(F.col(html)).alias("text"))
