"""Problem 2: HTML, Markdown, wiki and LaTeX markup becomes clean text with its structure kept.

HTML is read into a tree. Every node has a composite text density: characters per tag, weighed down where they stand in
links (the logarithm's base, in its usual form ``ln(...)``, is 1 for a page without links; 1 is added to keep it
defined). A node's density sum is that of its children; the node of the largest sum is the content's subtree, and the
least density on its path to the body is the threshold under which other blocks are boilerplate. Headings, lists, tables
and code outside the subtree stay unless links make up most of them. Bare text counts as a node of its own, so a
fragment without page frame loses nothing.

Code and formulas are set aside first, so nothing inside them is taken for markup. LaTeX, wiki and Markdown follow on the
lines that remain. The result is the text and its blocks in order. A record holds markup if the conversion met a piece
of it; signs of ordinary prose (``p < 0.05``, ``$12``, ``R&D``, ``10^3``) are none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.session import table

#: Elements by their part in a text. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input button select".split())
DROPPED = frozenset("script style noscript template nav footer aside iframe object embed form svg head ref references".split())
VOID = frozenset("br img hr input meta link wbr area base col embed param source track".split())
STRUCTURAL = frozenset("h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre math blockquote figure figcaption".split())
FORMULAS = "equation align gather multline eqnarray displaymath math alignat flalign"
#: LaTeX commands outside formulas and the characters they print. Fixed values.
SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "kappa": "κ", "lambda": "λ", "mu": "µ",
    "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ",
    "Theta": "Θ", "Lambda": "Λ", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω", "pm": "±", "times": "×", "cdot": "·", "leq": "≤", "geq": "≥", "approx": "≈",
    "degree": "°", "ldots": "…", "dots": "…", "to": "→", "rightarrow": "→", "infty": "∞", "circ": "°", "neq": "≠", "textmu": "µ", "ss": "ß", "o": "ø", "ae": "æ",
}

# private-use characters stand for what is already understood: set-aside pieces, headings, items, rows, cells, quotes
_HELD, _END, _HEAD, _ITEM, _ROW, _CELL, _QUOTE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006"
_OURS = re.compile("[\ue000-\ue006]")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>]*)?/?>|<!(?:--|DOCTYPE\b|\[CDATA\[)|<\?xml\b")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<pre\b[^>]*>(.*?)(?:</pre\s*>|\Z)", re.I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?\n?(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
# what lies between a pair holds no second opening, so a missing end costs no more than the way to the next opening
_DISPLAY = re.compile(
    r"\$\$((?:(?!\$\$).)+)\$\$|\\\[((?:(?!\\[\[\]]).)+)\\\]|\\begin\{(" + "|".join(FORMULAS.split()) + r")\*?\}((?:(?!\\(?:begin|end)\{\3).)*)\\end\{\3\*?\}", re.S
)
_MATH = re.compile(r"\\\(((?:(?!\\[()]).)+)\\\)|\$([^\s$0-9][^$\n]*)\$|\$([^$\n]*[\\^_{}][^$\n]*)\$")
_CODE = re.compile(r"`([^`\n]+)`")
_SECTION = re.compile(r"\\(part|chapter|(?:sub){0,2}section|paragraph)\*?\s*(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TABULAR = re.compile(r"\\begin\{(tabular[x*]?|array|longtable)\}(?:\[[^\]]*\])?(?:\{[^{}]*\})*((?:(?!\\(?:begin|end)\{\1).)*)\\end\{\1\}", re.S)
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{((?:[^{}\n]|\{[^{}\n]*\})*)\}")
_BARE = re.compile(r"\\([A-Za-z]+)\*?[ \t]?|\\([\[\](){}%&$#_~^\\,; ])")
_WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)^\|\}[ \t]*$", re.M | re.S)
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]*)(?:\|([^\[\]\n]*))?\]\]")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_LINK = re.compile(r"(!?)\[([^\]\[\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)")
_BOLD = re.compile(r"(\*\*|~~)(?=\S)((?:(?!\1).)+)(?<=\S)\1|(?<!\w)(__)(?=\S)((?:(?!__).)+)(?<=\S)\3(?!\w)", re.S)
_SLANT = re.compile(r"(?<![\w*])\*([^\s*](?:[^*\n]*[^\s*])?)\*|(?<![\w_])_([^\s_](?:[^_\n]*[^\s_])?)_(?!\w)")
_TICKS = re.compile(r"'{2,5}(.+?)'{2,5}")
_RULE = re.compile(r"^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$")
_DIVIDER = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|[ \t:|-]*$")


class Node:
    """An element or, with tag ``#``, a run of bare and inline content; ``parts`` are strings and nodes."""

    __slots__ = ("tag", "parts", "up", "chars", "tags", "linked", "links", "density")

    def __init__(self, tag: str, up: Node | None = None) -> None:
        self.tag, self.up, self.parts = tag, up, []
        self.chars = self.tags = self.linked = self.links = 0
        self.density = 0.0


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = self.at = Node("body")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag not in INLINE:
            # an open paragraph or item ends where the next block begins
            while self.at.tag in ("p", *INLINE) or (self.at.tag == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option")):
                self.at = self.at.up or self.root
        if tag == "img":
            self.at.parts.append(dict(attrs).get("alt") or "")
            return
        node = Node(tag, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.up
        if node is not self.root:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)

    def handle_entityref(self, name: str) -> None:
        self.at.parts.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.at.parts.append(f"&#{name};")


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _in_order(root: Node) -> list[Node]:
    """Elements, parents before children; bare runs inside blocks are gathered into ``#`` nodes on the way."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        found.append(node)
        if node.tag not in INLINE and node.tag != "#":
            parts: list = []
            for p in node.parts:
                if isinstance(p, Node) and p.tag not in INLINE:
                    parts.append(p)
                elif parts and isinstance(parts[-1], Node) and parts[-1].tag == "#":
                    parts[-1].parts.append(p)
                else:
                    run = Node("#", node)
                    run.parts.append(p)
                    parts.append(run)
            node.parts = parts
        waiting += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return found


def densities(root: Node) -> tuple[list[Node], Node, float]:
    """All nodes with their densities, the node of the largest density sum, and the threshold of its path to the body."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        below = [p for p in node.parts if isinstance(p, Node) and p.tag not in DROPPED]
        node.chars = own + sum(p.chars for p in below)
        node.tags = sum(p.tags + (p.tag != "#") for p in below)
        node.linked = node.chars if node.tag == "a" else sum(p.linked for p in below)
        node.links = sum(p.links + (p.tag == "a") for p in below)
    share = root.linked / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = (max(x, 1) for x in (node.chars, node.tags, node.linked, node.links))
        base = 1 + math.log(c / max(node.chars - node.linked, 1) * node.linked + share * c + math.e)
        node.density = node.chars / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base)
    best = max(nodes, key=lambda n: sum(p.density for p in n.parts if isinstance(p, Node)))
    least, at = best.density, best
    while at is not None:
        least, at = min(least, at.density), at.up
    return nodes, best, least


def _boilerplate(root: Node) -> set[int]:
    """Nodes (by id) that are no content."""
    nodes, best, least = densities(root)
    kept = {id(best)}
    at = best
    while at is not None:
        kept.add(id(at))
        at = at.up
    gone: set[int] = set()
    for node in nodes:
        up = node.up
        if node.tag in DROPPED or (up is not None and id(up) in gone):
            gone.add(id(node))
            continue
        if up is not None and id(up) in kept and up is best:
            kept.add(id(node))
        if node.tag in INLINE or id(node) in kept and node is not best and not node.links:
            continue
        heavy = node.links >= 2 and node.linked > 0.6 * max(node.chars, 1)
        outside = id(node) not in kept and not any(id(a) == id(best) for a in _path(node))
        if heavy and node is not root or outside and node.density < least and node.tag not in STRUCTURAL and node.tag != "#" and node.links:
            gone.add(id(node))
    return gone


def _path(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.up


def _flat(node: Node) -> str:
    """The text of inline content."""
    out, waiting = [], [node]
    while waiting:
        p = waiting.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag == "br":
            out.append("\n")
        elif p.tag not in DROPPED:
            waiting += reversed(p.parts)
    return "".join(out)


def lines_of(root: Node, gone: set[int]) -> str:
    """The tree without the nodes ``gone`` (by id) as text lines, structure marked by our own characters."""
    out: list[str] = []
    waiting: list = [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if id(node) in gone:
            continue
        one = " ".join
        if node.tag == "#":
            out.append(_flat(node))
        elif re.fullmatch(r"h[1-6]", node.tag):
            out.append(f"\n\n{_HEAD}{node.tag[1]}{one(_flat(node).split())}\n\n")
        elif node.tag == "tr":
            cells = [one(_flat(c).split()) for c in node.parts if isinstance(c, Node) and c.tag != "#"]
            out.append(f"\n{_ROW}{_CELL.join(cells)}\n")
        elif node.tag in ("li", "dt", "dd"):
            depth = sum(a.tag in ("ul", "ol", "dl") for a in _path(node))
            inner = [p for p in node.parts if isinstance(p, Node) and p.tag in ("ul", "ol", "dl", "table", "pre")]
            said = one("".join(_flat(p) if isinstance(p, Node) else p for p in node.parts if p not in inner).split())
            out.append(f"\n{_ITEM}{min(max(depth, 1), 9)}{said}\n")
            waiting += reversed(inner)
        elif node.tag == "hr":
            out.append("\n\n")
        elif node.tag in INLINE:
            out.append(_flat(node))
        else:
            waiting += ["\n\n" if node.tag != "body" else "", *reversed(node.parts), "\n\n" if node.tag != "body" else ""]
    return "".join(out)


class _Converter:
    def __init__(self, text: str) -> None:
        self.kinds: set[str] = set()
        self.held: list[tuple[str, str]] = []
        self.text = _OURS.sub("", text) if any("\ue000" <= c <= "\ue006" for c in text) else text

    def hold(self, kind: str, what: str) -> str:
        self.held.append((kind, what))
        mark = f"{_HELD}{len(self.held) - 1}{_END}"
        return f"\n\n{mark}\n\n" if kind in ("code", "formula") else mark

    def sub(self, kind: str, pattern: re.Pattern, to) -> None:  # noqa: ANN001
        self.text, n = pattern.subn(to, self.text)
        if n:
            self.kinds.add(kind)

    def set_aside(self) -> None:
        if "```" in self.text or "~~~" in self.text:
            self.sub("markdown", _FENCE, lambda m: self.hold("code", m.group(2).rstrip("\n")))
        if "<" in self.text:
            self.sub("html", _PRE, lambda m: self.hold("code", unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", m.group(1))).strip("\n")))
        if "\\" in self.text or "$" in self.text:
            self.sub("latex", _VERBATIM, lambda m: self.hold("code", m.group(2).rstrip("\n")))
            self.sub("latex", _DISPLAY, lambda m: self.hold("formula", next(g for g in (m.group(1), m.group(2), m.group(4)) if g is not None).strip()))
            self.sub("latex", _MATH, lambda m: self.hold("math", next(g for g in m.groups() if g is not None).strip()))
        if "`" in self.text:
            self.sub("markdown", _CODE, lambda m: self.hold("word", m.group(1)))

    def html(self) -> None:
        if "<" in self.text and _TAG.search(self.text):
            self.kinds.add("html")
            root = parse(self.text)
            self.text = lines_of(root, _boilerplate(root))
            if not self.text.strip():  # nothing but links
                self.text = lines_of(root, {id(n) for n in _in_order(root) if n.tag in DROPPED})
        if "&" in self.text:
            self.sub("html", _ENTITY, lambda m: unescape(m.group()))

    def latex(self) -> None:
        if "\\" not in self.text:
            return

        def heading(m: re.Match) -> str:
            level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}[m.group(1)]
            return f"\n\n{_HEAD}{level}{m.group(2)}\n\n"

        def rows(m: re.Match) -> str:
            body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", m.group(2))
            lines = [re.split(r"(?<!\\)&", r) for r in re.split(r"\\\\", body) if r.strip()]
            return "\n" + "".join(f"{_ROW}{_CELL.join(' '.join(c.split()) for c in r)}\n" for r in lines)

        def command(m: re.Match) -> str:
            name, inner = m.groups()
            if name in ("begin", "end", "label", "index", "vspace", "hspace", "bibliographystyle", "documentclass", "usepackage", "includegraphics"):
                return "\n" if name in ("begin", "end") else ""
            return f" [{inner}]" if name.lower().startswith(("cite", "parencite")) else inner

        self.sub("latex", _TABULAR, rows)
        self.sub("latex", _SECTION, heading)
        self.sub("latex", re.compile(r"~?(?=\\(?:cite|ref|eqref|pageref))"), "")
        while True:
            before = self.text
            self.sub("latex", _COMMAND, command)
            if self.text == before:
                break
        self.sub("latex", re.compile(r"[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*"), f"\n{_ITEM}1")
        self.sub("latex", _BARE, lambda m: SIGNS.get(m.group(1), "") if m.group(1) else {"\\": "\n", ",": " ", ";": " "}.get(m.group(2), m.group(2)))

    def wiki(self) -> None:
        if "{|" in self.text:

            def rows(m: re.Match) -> str:
                out: list[list[str]] = [[]]
                for line in m.group(1).split("\n"):
                    if line.startswith("|-"):
                        out.append([])
                    elif line.startswith("|+"):
                        continue
                    elif line[:1] in "|!" and line:
                        out[-1] += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
                return "\n" + "".join(f"{_ROW}{_CELL.join(r)}\n" for r in out if r)

            self.sub("wiki", _WIKI_TABLE, rows)
        if "{{" in self.text or "}}" in self.text:
            while _TEMPLATE.search(self.text):
                self.sub("wiki", _TEMPLATE, "")
            self.sub("wiki", re.compile(r"\{\{|\}\}"), "")
        if "{|" in self.text or "|}" in self.text:
            self.sub("wiki", re.compile(r"\{\||\|\}"), "")
        if "[[" in self.text or "]]" in self.text:

            def link(m: re.Match) -> str:
                target, shown = m.groups()
                if re.match(r"\s*(?:category|file|image|datei|bild|kategorie|fichier|catégorie)\s*:", target, re.I):
                    return ""
                return shown if shown is not None else target

            self.sub("wiki", _WIKI_LINK, link)
            self.sub("wiki", re.compile(r"\[\[|\]\]"), "")
        if "''" in self.text:
            self.sub("wiki", _TICKS, lambda m: m.group(1))
            self.sub("wiki", re.compile(r"'{2,}"), "")

    def markdown(self) -> None:
        if "](" in self.text:
            self.sub("markdown", _LINK, lambda m: m.group(2))
        if "**" in self.text or "__" in self.text or "~~" in self.text:
            self.sub("markdown", _BOLD, lambda m: m.group(2) or m.group(4))
            self.sub("markdown", re.compile(r"\*\*(?=\S)|~~(?=\S)|(?<=\S)\*\*"), "")
        if "*" in self.text or "_" in self.text:
            self.sub("markdown", _SLANT, lambda m: m.group(1) or m.group(2))

    def blocks(self) -> list[tuple[str, int, str]]:
        """(kind, level, text) of each block: heading, item, row, code, formula, quote or text."""
        out: list[tuple[str, int, str]] = []
        open_ = False
        lines = self.text.split("\n")
        for at, raw in enumerate(lines):
            line = raw.strip()
            if not line:
                open_ = False
                continue
            kind, level, said = self.line(raw, line, lines, at)
            if kind == "rule":
                open_ = False
                continue
            if kind == "text" and open_ and out and out[-1][0] in ("text", "quote"):
                out[-1] = (out[-1][0], out[-1][1], f"{out[-1][2]}\n{said}")
            else:
                out.append((kind, level, said))
            open_ = kind in ("text", "quote")
        done = []
        for kind, level, said in out:
            alone = re.fullmatch(f"{_HELD}(\\d+){_END}", said)
            if alone and self.held[int(alone.group(1))][0] in ("code", "formula"):
                done.append((self.held[int(alone.group(1))][0], 0, self.held[int(alone.group(1))][1]))
            else:
                while _HELD in said:
                    said = re.sub(f"{_HELD}(\\d+){_END}", lambda m: self.held[int(m.group(1))][1], said)
                done.append((kind, level, said.replace(_CELL, "\t")))
        return done

    def line(self, raw: str, line: str, lines: list[str], at: int) -> tuple[str, int, str]:
        lead = line[0]
        if lead == _HEAD:
            return "heading", int(line[1]), line[2:].strip()
        if lead == _ITEM:
            return "item", int(line[1]), line[2:].strip()
        if lead == _ROW:
            return "row", 0, line[1:]
        if lead == "#" and (m := re.match(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?$", raw.rstrip())):
            self.kinds.add("markdown")
            return "heading", len(m.group(1)), m.group(2)
        if lead == "=" and (m := re.match(r"^(={1,6})([^=].*?)(={1,6})$", line)):
            self.kinds.add("wiki")
            return "heading", min(len(m.group(1)), len(m.group(3))), m.group(2).strip()
        if _RULE.match(raw):
            self.kinds.add("markdown")
            return "rule", 0, ""
        if "|" in line and (_DIVIDER.match(line) or (lead == "|" and line[-1] == "|" and len(line) > 1)):
            self.kinds.add("markdown")
            return ("rule", 0, "") if _DIVIDER.match(line) else ("row", 0, _CELL.join(c.strip() for c in line.strip("|").split("|")))
        if lead == ">" and (m := re.match(r"^>+[ \t]?(\S.*)$", line)):
            self.kinds.add("markdown")
            return "quote", 0, m.group(1)
        if m := re.match(r"^([ \t]*)[-*+][ \t]+(\S.*)$", raw):
            self.kinds.add("markdown")
            return "item", 1 + min(len(m.group(1).expandtabs(4)) // 2, 8), m.group(2).rstrip()
        if lead in "*#:;" and (m := re.match(r"^([*#:;]+)[ \t]*(\S.*)$", line)) and any(lines[k][:1] and lines[k][:1] in "*#:;" for k in (at - 1, at + 1) if 0 <= k < len(lines)):
            self.kinds.add("wiki")
            return "item", len(m.group(1)), m.group(2)
        if lead.isdigit() and (m := re.match(r"^(\d{1,3})[.)][ \t]+(\S.*)$", line)):
            n = int(m.group(1))
            beside = [re.match(r"^\s*(\d{1,3})[.)][ \t]+\S", lines[k]) for k in (at - 1, at + 1) if 0 <= k < len(lines)]
            if any(b and abs(int(b.group(1)) - n) == 1 for b in beside):
                self.kinds.add("markdown")
                return "item", 1, f"{n}. {m.group(2)}"
        return "text", 0, line


_ANY = re.compile(r"[<&\\`*\[{|$~#_]|''|^[ \t]*(?:[-+>:;=]|\d{1,3}[.)][ \t])", re.M)


def convert(text: str | None) -> tuple[str | None, list[str], list[tuple[str, int, str]]]:
    """(clean text, kinds of markup met, blocks) of one text; null gives null without blocks."""
    if text is None:
        return None, [], []
    c = _Converter(text)
    if _ANY.search(text):
        c.set_aside()
        c.html()
        c.latex()
        c.wiki()
        c.markdown()
    found = c.blocks()
    if not c.kinds:
        return text, [], found
    shown: list[str] = []
    for k, (kind, _, said) in enumerate(found):
        close = k and kind == found[k - 1][0] and kind in ("item", "row")
        bullet = "• " if kind == "item" and not re.match(r"\d{1,3}\. ", said) else ""
        shown.append(("" if not k else "\n" if close else "\n\n") + bullet + said)
    return "".join(shown), sorted(c.kinds), found


_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int64()), ("text", pa.string())]))


def clean_markup(records: DataFrame, keys: list[str], text: str, with_text: bool = True) -> DataFrame:
    """keys, kinds (of html, latex, markdown, wiki; empty without markup), and if wanted clean and blocks.

    clean: the text without markup, blocks set off by blank lines, items and table rows by line ends, cells by tabs; a text
    without markup is unchanged. blocks: (kind, level, text) in order; kind is heading, text, item, row, code, formula or
    quote. Null texts give null, no kinds and no blocks; empty ones stay empty. Repeated rows are converted each; columns
    other than ``keys`` and ``text`` are ignored; an empty table gives no rows. Keys come back as strings.
    """
    source = records.select(*(F.col(k).cast("string") for k in keys), F.col(text).cast("string").alias("__text"))
    n = len(keys)
    schema = ", ".join([*(f"`{k}` string" for k in keys), "kinds array<string>"])
    if with_text:
        schema += ", clean string, blocks array<struct<kind:string,level:bigint,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [convert(t) for t in batch.column(n).to_pylist()]
            columns = [*batch.columns[:n], pa.array([k for _, k, _ in done], pa.list_(pa.string()))]
            names = [*keys, "kinds"]
            if with_text:
                columns += [pa.array([t for t, _, _ in done], pa.string()), pa.array([[dict(zip(("kind", "level", "text"), b)) for b in bs] for _, _, bs in done], _BLOCKS)]
                names += ["clean", "blocks"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    """All texts of problem 2: src, rec_id, text."""
    chunks = table(spark, root, "chunks").select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("rec_id"), "text")
    extracts = table(spark, root, "extracts").select(F.lit("extract").alias("src"), F.col("paper_id").alias("rec_id"), F.col("markdown").alias("text"))
    return chunks.unionByName(extracts)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks and extracts in which the conversion met markup."""
    met = clean_markup(p2_records(spark, root), ["src", "rec_id"], "text", with_text=False)
    return met.where(F.size("kinds") > 0).select("src", "rec_id").distinct()


def p2_texts(spark: SparkSession, root: str) -> DataFrame:
    """The clean text and the kinds of markup of every record, each once."""
    return clean_markup(p2_records(spark, root), ["src", "rec_id"], "text").select("src", "rec_id", F.array_join("kinds", ",").alias("kinds"), "clean").distinct()


#: The kinds of markup as one regular expression each: a plain statement of what p2_found must find, for its check only.
_SQL_KINDS = (
    r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>]*)?/?>|<!(?:--|DOCTYPE\b|\[CDATA\[)|<\?xml\b", r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});",
    r"(?m)^ {0,3}#{1,6}[ \t]+\S|^={1,6}[^=\n].*={1,6}[ \t]*$", r"\*\*\S|\*[^\s*](?:[^*\n]*[^\s*])?\*|(?:^|\W)__?[^\s_](?:[^_\n]*[^\s_])?__?(?:\W|$)|~~\S|''",
    r"!?\[[^\]\[\n]*\]\((?:[^()\n]|\([^()\n]*\))*\)|\[\[|\]\]", r"`[^`\n]+`|(?m)^(?:```|~~~)", r"(?m)^[ \t]*[-*+][ \t]+\S|^[*#:;]+[ \t]*\S.*\n[*#:;]+[ \t]*\S",
    r"(?m)^[ \t]*1[.)][ \t]+\S.*\n[ \t]*2[.)][ \t]+\S", r"(?m)^>[ \t]?\S", r"(?m)^\|.*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|", r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$",
    r"\{\{|\}\}|\{\||\|\}", r"\\[A-Za-z]+|\\[\[\](){}%&$#_~^\\,;]|\$\$|\$[^\s$0-9][^$\n]*\$|\$[^$\n]*[\\^_{}][^$\n]*\$",
)


def p2_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    marked = " OR ".join(f"regexp_matches(text, {quoted(p)})" for p in _SQL_KINDS)
    return f"SELECT DISTINCT src, rec_id FROM (SELECT 'chunk' AS src, chunk_id AS rec_id, text FROM chunks UNION ALL SELECT 'extract', paper_id, markdown FROM extracts) WHERE {marked}"
