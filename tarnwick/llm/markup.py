"""Markup residue in texts: labelled by minimum cut, converted to clean text.

Nodes.  Patterns of HTML, Markdown, wiki and LaTeX give candidate spans; what is left
between blank lines and block elements gives text blocks.  Comparisons, paths, amounts,
model tokens, bracketed numbers and plain bullets match no pattern.

Costs.  Two logistic classifiers give the log-odds that a span is markup, and not what
only looks like it (``__init__``, a type parameter, a numbered line), and that a block is
page furniture (navigation, notices), and not content.  They are fitted on ``LABELLED``
composed texts (:mod:`tarnwick.llm.markup_labels`), once per driver process; the workers
get the weights.

Labelling.  The log-odds become capacities to the terminals.  Smoothness edges join spans
that are near in the text and in the document tree (open and close tags, parents, fences,
environments, rows of one table or list), and blocks that follow each other or have the
same parent element.  The minimum cut separates residue from content: a weak node follows
its surroundings, a strong one decides alone.

Conversion.  Residue spans are replaced by what they stand for; headings, lists, code,
tables and formulas stay as blocks of that kind, scripts, comments, preambles and page
furniture go.

Every scan is linear in the text, also where elements, fences or formulas are never closed.

Defined results: null texts stay null, without blocks; empty and blank texts have
none; the stated media type is not read; repeated rows are converted each; a text
without residue comes out as it was; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import html
import html.entities
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.markup_labels import LABELLED, texts
from tarnwick.llm.mincut import Edge, cut

# Element names of HTML and common wiki extensions.
TAGS = (
    "a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite "
    "code col colgroup dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math "
    "meta nav noscript nowiki object ol optgroup option p param picture pre q ref rp rt ruby s samp script section select "
    "small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead title tr "
    "track tt u ul var video wbr"
).split()
VOID = set("base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form head header html main nav ol p pre section table tbody tfoot thead title ul".split())
# Element names that stand for nothing else in angle brackets, so one that is never closed is still a tag.
CERTAIN = set("abbr acronym bdi bdo blockquote colgroup dd dfn div dl dt em fieldset figcaption frameset h1 h2 h3 h4 h5 h6 html iframe kbd li noscript nowiki ol optgroup pre rp rt ruby samp strike strong sub sup svg tbody td textarea tfoot th thead tr tt ul".split())
# Python's double-underscore names, which are identifiers and no bold text.
DUNDER = set("abs add all and annotations bool bytes call class contains copy del delattr delitem dict dir doc enter eq exit file float format ge get getattr getitem gt hash iadd import index init int invert iter le len lt main missing mod module mul name ne neg new next or path pos pow qualname radd reduce repr reversed rmul round set setattr setitem sizeof slots str sub truediv version xor".split())

#: Kinds of spans.
KINDS = (
    "tag bare open element comment entity escaped atx setext fence tick bold under dunder em strike link image foot mdtable pipe task dash num quote rule "
    "wikilink template wikihead apostrophes wikitable command math escape emu auto refdef reflink external"
).split()
#: Smoothness: adjacency at distance 0 and its range in characters; tree edges of spans; neighbours and siblings of blocks.
NEAR, REACH, PARENT, PAIR, ROW, NEXT, SIBLING = 0.8, 60.0, 0.8, 4.0, 1.0, 0.6, 0.4

_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))
_ATTR = r"(?:\s+[A-Za-z_:@-][\w:.-]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*"
_TAG = re.compile(rf"<(/?)({_NAMES})({_ATTR})\s*(/?)>", re.I)
_ESCAPED = re.compile(rf"&(?:amp;)?lt;/?(?:{_NAMES})(?:(?!&(?:amp;)?[lg]t;)[^<>\n])*&(?:amp;)?gt;", re.I)
_ELEMENT = re.compile(r"<(script|style)\b[^<>]*>", re.I)
_ELEMENT_END = re.compile(r"</(script|style)\s*>", re.I)
_COMMENT = re.compile(r"<!--|<!doctype[^<>]*>|<!\[CDATA\[|\]\]>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ENTITIES = {n for n in html.entities.html5 if n.endswith(";")}
_ATX = re.compile(r"^( {0,3})(#{1,6})[ \t]+(?=\S)", re.M)
_SETEXT = re.compile(r"\n((?:={3,}|-{3,})[ \t]*)(?=\r?(?:\n|\Z))")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*$", re.M)
_TICKS = re.compile(r"`+|\n")
_BOLD = re.compile(r"(\*\*)(?=\S)[^*\n]+?(?<=\S)(\*\*)")
_UNDER = re.compile(r"(?<!\w)(__)(?=\S)([^_\n]+?)(?<=\S)(__)(?!\w)")
_EM = re.compile(r"(?<![\w*])(\*)(?=[^\s*])[^*\n]+?(?<=[^\s*])(\*)(?![\w*])")
_STRIKE = re.compile(r"(~~)(?=\S)[^~\n]+?(?<=\S)(~~)")
_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
_EMU = re.compile(r"(?<![\w/\\.@-])(_)(?=[^\s_])[^_\n]+?(?<=[^\s_])(_)(?![\w/\\@-])")
_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>", re.I)
_REFDEF = re.compile(r"^ {0,3}\[([^\[\]\n^][^\[\]\n]*)\]:[ \t]+(?:<[^<>\n]*>|(?:[a-z][a-z0-9+.-]*:|[/#.]|www\.)\S*)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*\r?$", re.I | re.M)
_REFLINK = re.compile(r"\[([^\[\]\n]+)\] ?\[([^\[\]\n]*)\]")
_EXTERNAL = re.compile(r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+(?:[ \t]+([^\[\]\n]+))?\](?!\()", re.I)
_FOOT = re.compile(r"\[\^([^\[\]\s]+)\](:?)")
_MDTABLE = re.compile(r"^\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*\r?$", re.M)
_PIPE = re.compile(r"^\|(?![-}|+])[^\n]*\|[ \t]*\r?$", re.M)
_LIST = re.compile(r"^([ \t]*)([-+*])[ \t]+(\[[ xX]\][ \t]+)?(?=\S)", re.M)
_NUM = re.compile(r"^[ \t]*\d+[.)][ \t]+(?=\S)", re.M)
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=[^\s=])", re.M)
_RULE = re.compile(r"^(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})\r?$", re.M)
_WIKILINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_TEMPLATE = re.compile(r"\{\{([^{}]+)\}\}|\{\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}\}")
_WIKIHEAD = re.compile(r"(={2,6})([^=\n]+)(={2,6})")
_APOS = re.compile(r"('{2,5})(?=[^\s'])([^'\n]+?(?:'[^'\n]+?)*)('{2,5})(?!')")
_WIKITABLE = re.compile(r"^(?:\{\|[^\n]*|\|\}[^\n]*|\|-[^\n|]*)$", re.M)
_WIKIROW = re.compile(r"^[|!](?![-}+])[^\n]*(?:\|\||!!)[^\n]*$", re.M)
_VERBATIM = re.compile(r"\\(begin|end)\{(verbatim|lstlisting|minted|equation|align|math|displaymath|gather)(\*?)\}")
_TABULAR = re.compile(r"\\(begin|end)\{(tabular|array)()\}")
_MATH = re.compile(r"\$\$|\\[\[(]|\$")
_DOLLARS = re.compile(r"(?<![\w$\\])\$(?=\S)([^$\n]+)(?<=\S)\$(?![\d\w])")
_COMMAND = re.compile(r"\\([A-Za-z]+)(\*?)((?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*)")
_NO_COMMAND = re.compile(r"[A-Za-z]:\\[^\s]*|\\\\[\w.]+\\[^\s]*")
# LaTeX commands without an argument that mark structure.
_BARE_COMMANDS = set("item maketitle tableofcontents hline toprule midrule bottomrule par newpage clearpage noindent centering ldots dots textbackslash LaTeX TeX newline linebreak appendix bibliography alpha beta gamma delta epsilon lambda mu sigma theta omega sum prod int frac sqrt cdot times leq geq neq approx infty partial log exp sin cos".split())
_ESCAPE = re.compile(r"\\\\(?=[ \t]*\r?$)|\\[%&#_{}$](?!\w*\\)", re.M)


#: Line starts at which a line pattern can match at all; a literal first character lets the search skip ahead.
_LINE = re.compile(r"\n(?=[ \t]*([#>|=~`!{*+\-_:\d]))")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    value: str
    tie: str  # spans with the same tie are rows of one structure


class Cover:
    """Whether places lie in any of some regions, which may overlap; what is added counts from the next sealing on."""

    def __init__(self, regions: list[tuple[int, int]] = ()):
        self.regions = list(regions)
        self.seal()

    def add(self, start: int, end: int) -> None:
        self.regions.append((start, end))

    def seal(self) -> None:
        self.regions.sort()
        self.begins = [a for a, _ in self.regions]
        self.reach = list(accumulate((b for _, b in self.regions), max))

    def free(self, at: int) -> bool:
        i = bisect_right(self.begins, at) - 1
        return i < 0 or self.reach[i] <= at


def _elements(text: str) -> Iterator[tuple[int, int]]:
    """Scripts and style sheets from their opening to the next closing tag of the same name."""
    ends: dict[str, list[re.Match]] = {}
    for m in _ELEMENT_END.finditer(text):
        ends.setdefault(m[1].lower(), []).append(m)
    begins = {name: [m.start() for m in found] for name, found in ends.items()}
    at = 0
    for m in _ELEMENT.finditer(text):
        name = m[1].lower()
        i = bisect_right(begins.get(name, ()), m.end() - 1)
        if m.start() >= at and i < len(ends.get(name, ())):
            at = ends[name][i].end()
            yield m.start(), at


def _comments(text: str) -> Iterator[tuple[int, int]]:
    at, open_ = 0, True
    for m in _COMMENT.finditer(text):
        if m.start() < at:
            continue
        if m[0] != "<!--":
            yield m.span()
        elif open_:
            end = text.find("-->", m.end())
            open_ = end >= 0  # no later comment ends either
            if open_:
                at = end + 3
                yield m.start(), at


def _environments(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, int, int, str]]:
    """begin, inner begin, inner end, end and name from each opening to the next closing of the same name, not within another."""
    found = list(pattern.finditer(text))
    ends: dict[tuple[str, str], list[re.Match]] = {}
    for m in found:
        if m[1] == "end":
            ends.setdefault((m[2], m[3]), []).append(m)
    begins = {name: [m.start() for m in own] for name, own in ends.items()}
    at = 0
    for m in found:
        if m[1] == "begin" and m.start() >= at:
            own = ends.get((m[2], m[3]), ())
            i = bisect_right(begins.get((m[2], m[3]), ()), m.end() - 1)
            if i < len(own):
                at = own[i].end()
                yield m.start(), m.end(), own[i].start(), at, m[2]


def _formulas(text: str) -> Iterator[tuple[int, int, str, str]]:
    """begin, end, inline or formula, and the body of formulas between dollars or escaped brackets."""
    at = 0
    none = {"$$": len(text), "\\]": len(text), "\\)": len(text)}  # from where on the closing mark does not come
    for m in _MATH.finditer(text):
        begin, mark = m.span()[0], m[0]
        if begin < at:
            continue
        if mark == "$":
            if d := _DOLLARS.match(text, begin):
                body = d[1]
                if len(body) == 1 and body.isascii() and body.isalpha() or any(c in body for c in "\\^_{="):
                    at = d.end()
                    if not re.match(r"\$\d[\d.,]*\s", d[0]):
                        yield begin, at, "inline", body.strip()
            continue
        close = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}[mark]
        if begin >= none[close]:
            continue
        end = text.find(close, begin + 3)
        if end < 0:
            none[close] = min(none[close], begin)
        elif mark != "\\(" or "\n" not in text[begin:end]:
            at = end + 2
            yield begin, at, "inline" if mark == "\\(" else "formula", text[begin + 2 : end].strip()


def _ticks(text: str) -> Iterator[tuple[int, int, int]]:
    """begin, end and length of the marks of code in a line: a run of backticks to the next run of the same length."""
    for line, runs in groupby(((m.start(), m.end()) for m in _TICKS.finditer(text)), key=lambda r: text[r[0]] == "\n"):
        if line:
            continue
        own = list(runs)
        later: dict[int, list[int]] = {}
        for i in range(len(own) - 1, -1, -1):
            later.setdefault(own[i][1] - own[i][0], []).append(i)
        i = 0
        while i < len(own):
            n = own[i][1] - own[i][0]
            while later[n] and later[n][-1] <= i:
                later[n].pop()
            if later[n]:
                j = later[n][-1]
                yield own[i][0], own[j][1], n
                i = j
            i += 1


def candidates(text: str) -> list[Span]:
    """Candidate spans in order; spans inside code, scripts and formulas are left out."""
    out: list[Span] = []
    shut = Cover()  # what is taken whole
    free = shut.free

    def add(start: int, end: int, kind: str, value: str = "", tie: str = "") -> None:
        out.append(Span(start, end, kind, value, tie))

    if "<" in text:
        for a, b in _elements(text):
            add(a, b, "element")
            shut.add(a, b)
        shut.seal()
        for a, b in _comments(text):
            if free(a):
                add(a, b, "comment")
                shut.add(a, b)
        shut.seal()
    if "```" in text or "~~~" in text:
        opened: re.Match | None = None
        for m in _FENCE.finditer(text):
            if not free(m.start()):
                continue
            if opened is None:
                opened = m
            elif m[1][0] == opened[1][0] and len(m[1]) >= len(opened[1]) and m[0].strip() == m[1]:
                add(opened.start(), opened.end(), "fence", "open", f"f{opened.start()}")
                add(m.start(), m.end(), "fence", "close", f"f{opened.start()}")
                shut.add(opened.end(), m.start())
                opened = None
        if opened is not None:
            add(opened.start(), opened.end(), "fence", "open")
            shut.add(opened.end(), len(text))
        shut.seal()
    if "\\begin{" in text:
        for a, u, v, b, name in _environments(_VERBATIM, text):
            if free(a):
                kind = "code" if name in ("verbatim", "lstlisting", "minted") else "formula"
                body = text[u:v].strip("\r\n")
                add(a, b, "math", f"{kind}:{body}")
                shut.add(a, b)
        shut.seal()
    if "$" in text or "\\[" in text or "\\(" in text:
        for a, b, how, body in _formulas(text):
            if free(a):
                add(a, b, "math", f"{how}:{body}")
                shut.add(a, b)
        shut.seal()
    if "{{" in text:
        for m in _TEMPLATE.finditer(text):
            if free(m.start()):
                add(m.start(), m.end(), "template", m[1] or m[2])
                shut.add(*m.span())
        shut.seal()
    if "`" in text:
        for a, b, n in _ticks(text):
            if free(a):
                add(a, a + n, "tick", "", f"k{a}")
                add(b - n, b, "tick", "", f"k{a}")
                shut.add(a, b)
        shut.seal()

    def pair(pattern: re.Pattern, kind: str) -> None:
        for m in pattern.finditer(text):
            if free(m.start()):
                n, z = len(m[1]), len(m[m.lastindex])
                add(m.start(), m.start() + n, kind, "", f"{kind}{m.start()}")
                add(m.end() - z, m.end(), kind, "", f"{kind}{m.start()}")

    if "<" in text:
        found = list(_TAG.finditer(text))
        closes = {m[2].lower() for m in found if m[1]}
        at, fresh = 0, True
        for m in found:
            gap = text[at : m.start()]
            line = max(gap.rfind("\n"), gap.rfind("\r"))
            fresh = (fresh or line >= 0) and not gap[line + 1 :].strip()  # only blanks and tags before it in its line
            at = m.end()
            if free(m.start()):
                name = m[2].lower()
                plain = not m[1] and not m[3] and name not in VOID and name not in closes
                sure = name in CERTAIN or (name in BLOCK and fresh)
                add(m.start(), m.end(), "tag" if not plain else "open" if sure else "bare", m[0])
    if "&" in text:
        gone = Cover()
        for m in _ESCAPED.finditer(text):
            if free(m.start()):
                add(m.start(), m.end(), "escaped", html.unescape(html.unescape(m[0])))
                gone.add(*m.span())
        gone.seal()
        for m in _ENTITY.finditer(text):
            if (m[0][1] == "#" or m[0][1:] in _ENTITIES) and free(m.start()) and gone.free(m.start()):
                add(m.start(), m.end(), "entity", html.unescape(m[0]))
    if "===" in text or "---" in text:
        under = set()
        for m in _SETEXT.finditer(text):
            first = text.rfind("\n", 0, m.start()) + 1
            line = text[first : m.start()].rstrip("\r")
            if line.strip() and line[0] not in "#> \t|" and "|" not in line and free(m.start(1)) and not _WIKIHEAD.fullmatch(line.rstrip(" \t")):
                add(first, first, "setext", "head", f"s{first}")
                add(m.start(1), m.end(1), "setext", "line", f"s{first}")
                under.add(m.start(1))
    else:
        under = set()
    if "*" in text:
        pair(_BOLD, "bold")
        pair(_EM, "em")
    if "__" in text:
        for m in _UNDER.finditer(text):
            if free(m.start()):
                kind = "dunder" if m[2] in DUNDER else "under"
                add(m.start(), m.start() + 2, kind, "", f"u{m.start()}")
                add(m.end() - 2, m.end(), kind, "", f"u{m.start()}")
    if "~~" in text:
        pair(_STRIKE, "strike")
    if "](" in text:
        for m in _LINK.finditer(text):
            if free(m.start()):
                add(m.start(), m.start(2), "image" if m[1] else "link", "", f"l{m.start()}")
                add(m.end(2), m.end(), "image" if m[1] else "link", "", f"l{m.start()}")
    if "_" in text:
        for m in _EMU.finditer(text):
            if free(m.start()):
                kind = "dunder" if re.search(r"[=(){};<>\[\]]", m[0]) else "emu"  # code between two identifiers
                add(m.start(), m.start() + 1, kind, "", f"e{m.start()}")
                add(m.end() - 1, m.end(), kind, "", f"e{m.start()}")
    if "<" in text and (":" in text or "@" in text):
        for m in _AUTO.finditer(text):
            if free(m.start()):
                add(m.start(), m.start(1), "auto", "", f"a{m.start()}")
                add(m.end(1), m.end(), "auto", "", f"a{m.start()}")
    if "]:" in text:
        named = set()
        for m in _REFDEF.finditer(text):
            if free(m.start()):
                add(m.start(), m.end(), "refdef")
                named.add(" ".join(m[1].lower().split()))
        for m in _REFLINK.finditer(text) if named else ():  # only names that the text defines
            if free(m.start()) and " ".join((m[2] or m[1]).lower().split()) in named:
                add(m.start(), m.start(1), "reflink", "", f"r{m.start()}")
                add(m.end(1), m.end(), "reflink", "", f"r{m.start()}")
    if "://" in text and "[" in text:
        for m in _EXTERNAL.finditer(text):
            if free(m.start()):
                add(m.start(), m.end(), "external", m[1] or "")
    if "[^" in text:
        for m in _FOOT.finditer(text):
            if free(m.start()):
                add(m.start(), m.end(), "foot", f"[{m[1]}]")
    lead = text[: len(text) - len(text.lstrip(" \t")) + 1][-1:]
    for at, first in chain(((0, lead),), ((m.end(), m[1]) for m in _LINE.finditer(text))):
        if not free(at):
            continue
        if first == "#":
            if m := _ATX.match(text, at):
                add(at, m.end(), "atx", str(len(m[2])))
        elif first == "=":
            end = text.find("\n", at)
            line = text[at : len(text) if end < 0 else end].rstrip(" \t\r")
            if (m := _WIKIHEAD.fullmatch(line)) and m[1] == m[3] and m[2].strip(" \t"):
                add(at, at + len(line), "wikihead", m[2].strip(" \t"))
        elif first == ">":
            if m := _QUOTE.match(text, at):
                add(at, m.end(), "quote", "", "quote")
        elif first.isdigit():
            if m := _NUM.match(text, at):
                add(at, m.end(), "num", "", "list")
        elif first and first in "|!{:-":
            if first != "!" and (m := _MDTABLE.match(text, at)):
                add(at, m.end(), "mdtable", "", "table")
            elif m := _WIKITABLE.match(text, at):
                add(at, m.end(), "wikitable", "", "table")
            elif m := _WIKIROW.match(text, at):
                add(at, m.end(), "wikitable", "\t".join(c.strip() for c in re.split(r"\|\||!!", m[0][1:])), "table")
            elif m := _PIPE.match(text, at):
                add(at, m.end(), "pipe", "\t".join(c.strip() for c in m[0].strip().strip("|").split("|")), "table")
        if first and first in "-*_+":
            if at not in under and (m := _RULE.match(text, at)):
                add(at, m.end(), "rule")
            elif at not in under and (m := _LIST.match(text, at)):
                add(at, m.end(), "task" if m[3] else "dash", m[3] or "", "list")
    if "[[" in text:
        for m in _WIKILINK.finditer(text):
            if free(m.start()):
                add(m.start(), m.end(), "wikilink", m[1])
    if "''" in text:
        pair(_APOS, "apostrophes")
    if "\\" in text:
        paths = Cover([m.span() for m in _NO_COMMAND.finditer(text)])
        for m in _COMMAND.finditer(text):
            begin = m.start()
            if free(begin) and (m[3] or m[1] in _BARE_COMMANDS) and paths.free(begin):
                tie = f"env{m[3]}" if m[1] in ("begin", "end") else "list" if m[1] == "item" else ""
                add(begin - (text[begin - 1 : begin] == "~"), m.end(), "command", f"{m[1]}\0{m[3]}", tie)
        tabular = [(a, b) for a, _, _, b, _ in _environments(_TABULAR, text)]
        inside = Cover(tabular)
        for m in _ESCAPE.finditer(text):
            if free(m.start()) and paths.free(m.start()):
                add(m.start(), m.end(), "escape", "\n" if m[0] == "\\\\" and inside.free(m.start()) else "" if m[0] == "\\\\" else m[0][1])
        for a, b in tabular:
            for m in re.finditer(r"[ \t]*&[ \t]*", text[a:b]):
                add(a + m.start(), a + m.end(), "escape", "\t", "table")
    out.sort(key=lambda s: (s.start, -s.end))
    kept: list[Span] = []
    for s in out:  # of overlapping spans the first, then the longest, stays
        if not kept or s.start >= kept[-1].end or s.start == s.end:
            kept.append(s)
    return kept


def edges(spans: list[Span]) -> list[Edge]:
    """Smoothness between spans: adjacency, pairs, rows, and the tree of tags."""
    out = []
    for i in range(1, len(spans)):
        gap = max(0, spans[i].start - spans[i - 1].end)
        if gap < 4 * REACH:
            out.append((i - 1, i, NEAR * math.exp(-gap / REACH)))
    last: dict[str, int] = {}
    for i, s in enumerate(spans):
        if s.tie:
            if s.tie in last:
                out.append((last[s.tie], i, ROW if s.tie in ("table", "list", "quote") else PAIR))
            last[s.tie] = i
    for i, parent, opening in _tree(spans):
        if opening is not None:
            out.append((opening, i, PAIR))
        elif parent is not None:
            out.append((parent, i, PARENT))
    return out


def _tree(spans: list[Span]) -> Iterator[tuple[int, int | None, int | None]]:
    """For each tag: its number, the open element it lies in, and, if it closes one, that one's opening tag."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of each name in the stack
    for i, s in enumerate(spans):
        if s.kind not in ("tag", "bare", "open"):
            continue
        m = _TAG.match(s.value)
        name = m[2].lower()
        if m[1]:
            if not places.get(name):
                yield i, None, None
                continue
            at = places[name][-1]
            yield i, None, stack[at][1]
            for gone, _ in stack[at:]:
                places[gone].pop()
            del stack[at:]
        else:
            yield i, stack[-1][1] if stack else None, None
            if name not in VOID and not m[4]:
                places.setdefault(name, []).append(len(stack))
                stack.append((name, i))


HTML = {"tag", "bare", "open", "element", "comment", "entity", "escaped"}
WIKI = {"wikilink", "template", "wikihead", "apostrophes", "wikitable", "external"}
LATEX = {"command", "math", "escape"}
FEATURES = [*KINDS, "one", "in_word", "line_start", "company", "code", "attributes", "letter", "amount"]
_CODE = set("=(){};")
_NAMED = {"under", "emu", "dunder", "bare"}  #: kinds that identifiers and type parameters look like


def _family(kind: str) -> str:
    return "html" if kind in HTML else "wiki" if kind in WIKI else "latex" if kind in LATEX else "markdown"


def span_features(text: str, spans: list[Span]) -> np.ndarray:
    """One row per span: its kind, and what surrounds it."""
    x = np.zeros((len(spans), len(FEATURES)))
    sure = Counter(_family(s.kind) for s in spans if s.kind not in ("bare", "num", "dunder"))
    for row, s in zip(x, spans):
        row[_PLACE[s.kind]] = 1.0
        before, after = text[s.start - 1 : s.start], text[s.end : s.end + 1]
        own = sure[_family(s.kind)] - (s.kind not in ("bare", "num", "dunder"))
        row[_FIRST:] = (
            1.0,
            s.kind in _NAMED and bool(before) and (before.isalnum() or before == "_"),
            s.kind in _NAMED and before in ("", "\n"),
            min(own, 4) / 4,
            s.kind in _NAMED and ((before != "" and before in _CODE) or (after != "" and after in _CODE)),
            s.kind in HTML and "=" in s.value,
            s.kind == "bare" and len(s.value) == 3,
            s.kind == "num" and len(text[s.start : s.end].strip(" \t.)")) > 2,
        )
    return x


_PLACE = {k: i for i, k in enumerate(KINDS)}
_FIRST = len(KINDS)


class Block(NamedTuple):
    start: int
    end: int
    parent: int  # number of the opening tag of the element it lies in; -1: none
    furnished: bool  # within an element for page furniture


_BLANK = re.compile(r"\n[ \t]*\r?(?=\n)")
_WORD = re.compile(r"\w+")
# Words of page furniture in English, and marks that part its entries.
FURNITURE = set("home menu about contact login log sign register subscribe newsletter cookie cookies privacy terms policy imprint copyright rights reserved share tweet print follow rss previous next back top skip main search sitemap advertisement accept settings posted comment comments support products free email social related read".split())
BLOCK_FEATURES = ["one", "words", "stop", "marks", "furniture", "all_furniture", "sign", "element", "commas", "tabs"]


def blocks(text: str, spans: list[Span]) -> list[Block]:
    """What lies between blank lines and block elements, scripts and comments, in order."""
    cuts = [(m.start(), m.end()) for m in _BLANK.finditer(text)]
    inner: dict[int, int] = {}
    parents: dict[int, int] = {}
    for i, parent, opening in _tree(spans):
        up = parents.get(opening, -1) if opening is not None else i
        parents[i] = parent if parent is not None else -1
        inner[i] = up
    tags = [(s.start, s.end, i) for i, s in enumerate(spans) if s.kind in ("element", "comment") or (s.kind in ("tag", "bare", "open") and _TAG.match(s.value)[2].lower() in BLOCK)]
    outer = _furnished(spans)
    out: list[Block] = []
    at, parent = 0, -1
    for a, b, i in sorted([*((a, b, -1) for a, b in cuts), *tags, (len(text), len(text), -1)]):
        if a > at and text[at:a].strip():
            out.append(Block(at, a, parent, parent in outer))
        at = max(at, b)
        if i >= 0:
            parent = inner.get(i, parent)
    return out


def _furnished(spans: list[Span]) -> set[int]:
    """Opening tags of navigation, headers, footers, asides, forms and buttons, and of elements within them."""
    out: set[int] = set()
    for i, parent, opening in _tree(spans):
        if opening is None and (parent in out or re.match(r"<(?:nav|footer|header|aside|form|button|menu)\b", spans[i].value, re.I)):
            out.add(i)
    return out


def block_features(text: str, found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(BLOCK_FEATURES)))
    for row, b in zip(x, found):
        body = text[b.start : b.end]
        words = [w.lower() for w in _WORD.findall(body)]
        n = max(1, len(words))
        known = sum(w in FURNITURE for w in words)
        end = body.rstrip()[-1:]
        row[:] = (
            1.0,
            min(math.log1p(len(words)), 5.0) / 5.0,
            end in ".?!:" and len(words) > 5,
            min(sum(map(body.count, ("|", "·", "»", "/"))), 6) / 6 if known else 0.0,
            known / n,
            known >= 2 and known / n >= 0.4,
            "©" in body or "all rights reserved" in body.lower(),
            b.furnished,
            min(body.count(","), 4) / 4,
            "\t" in body or "\n" in body.strip(),
        )
    return x


class Model(NamedTuple):
    """Weights of the two classifiers."""

    span: np.ndarray
    block: np.ndarray


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_nodes(labelled: list[tuple[str, list[tuple[int, int]], list[tuple[int, int]]]]) -> Iterator[tuple[str, list[Span], list[bool], list[Block], list[bool]]]:
    """Texts with their nodes and the true labels of those: a node is residue if most of it lies in a place that is."""
    for text, marked, furnished in labelled:
        spans = candidates(text)
        found = blocks(text, spans)

        def inside(a: int, b: int, places: list[tuple[int, int]]) -> bool:
            return 2 * sum(max(0, min(b, z) - max(a, u)) for u, z in places) > b - a or (a == b and any(u <= a <= z for u, z in places))

        yield text, spans, [inside(s.start, s.end, marked) for s in spans], found, [inside(b.start, b.end, furnished) for b in found]


@lru_cache(maxsize=4)
def fit(n: int = LABELLED, seed: int = 1) -> Model:
    """The classifiers, fitted on ``n`` labelled texts."""
    x, y, u, v = [], [], [], []
    for text, spans, marked, found, furnished in labelled_nodes(texts(n, seed)):
        x.append(span_features(text, spans))
        y += marked
        u.append(block_features(text, found))
        v += furnished
    return Model(_logistic(np.concatenate(x), np.array(y, float)), _logistic(np.concatenate(u), np.array(v, float)))


def block_edges(found: list[Block]) -> list[Edge]:
    """Smoothness between blocks: neighbours, and the last before with the same parent element."""
    out = [(i - 1, i, NEXT) for i in range(1, len(found))]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent >= 0:
            if last.get(b.parent, i - 1) != i - 1:
                out.append((last[b.parent], i, SIBLING))
            last[b.parent] = i
    return out


def label(text: str, spans: list[Span], model: Model) -> list[bool]:
    """True for markup: the minimum cut over all spans."""
    return cut((span_features(text, spans) @ model.span).tolist(), edges(spans)) if spans else []


def label_blocks(text: str, found: list[Block], model: Model) -> list[bool]:
    """True for page furniture: the minimum cut over all blocks."""
    return cut((block_features(text, found) @ model.block).tolist(), block_edges(found)) if found else []


def residue(text: str, model: Model | None = None) -> list[Span]:
    spans = candidates(text)
    return [s for s, r in zip(spans, label(text, spans, model or fit())) if r] if spans else []


def furniture(text: str, spans: list[Span], model: Model | None = None) -> list[tuple[int, int]]:
    """Places of page furniture."""
    found = blocks(text, spans)
    return [(b.start, b.end) for b, r in zip(found, label_blocks(text, found, model or fit())) if r]


HEADS = {"part", "chapter", "section", "subsection", "subsubsection", "paragraph", "title"}
DROPPED = set("documentclass usepackage cite citep citet ref eqref label pageref begin end maketitle tableofcontents hline toprule midrule bottomrule newpage clearpage noindent centering bibliography bibliographystyle includegraphics input include vspace hspace appendix author date".split())
_ARG = re.compile(r"\{([^{}\n]*)\}")


def clean(text: str, spans: list[Span] | None = None, gone: list[tuple[int, int]] | None = None) -> list[tuple[str, str]]:
    """Blocks (kind, text) of the text without its residue: heading, list, code, table, formula or text."""
    spans = residue(text) if spans is None else spans
    gone = furniture(text, spans) if gone is None else gone
    if not spans and not gone:
        return [("text", text)] if text.strip() else []
    # Spans inside furniture go with it.
    within = Cover(gone)
    spans = sorted([*(s for s in spans if within.free(s.start)), *(Span(a, b, "gone", "", "") for a, b in gone)], key=lambda s: (s.start, s.end))
    mark = (c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE))) if c not in text)
    head, code, shut, form, row = (next(mark) for _ in range(5))
    wiki = sum(s.kind in ("wikilink", "template", "wikihead", "wikitable", "apostrophes") for s in spans)
    other = sum(s.kind in ("fence", "link", "mdtable", "bold", "under", "strike") or (s.kind == "atx" and s.value != "1") for s in spans)
    out: list[str] = []
    at = 0
    ordered: list[int] = []
    cells = False
    for s in spans:
        if s.start < at:
            continue
        out.append(text[at : s.start])
        at = s.end
        kind, v = s.kind, s.value
        if kind in ("tag", "bare", "open"):
            m = _TAG.match(v)
            name, closing = m[2].lower(), bool(m[1])
            if name[0] == "h" and name[1:].isdigit() or name == "title":
                out.append("\n\n" if closing else f"\n\n{head}")
            elif name == "pre":
                out.append(f"{shut}\n\n" if closing else f"\n\n{code}")
            elif name == "li":
                if not closing:
                    if ordered and ordered[-1] >= 0:
                        ordered[-1] += 1
                        out.append(f"\n{ordered[-1]}. ")
                    else:
                        out.append("\n• ")
            elif name in ("ul", "ol"):
                if closing:
                    del ordered[-1:]
                else:
                    ordered.append(0 if name == "ol" else -1)
                out.append("\n\n")
            elif name == "tr":
                cells = False
                out.append("\n" if closing else row)
            elif name in ("td", "th"):
                if not closing:
                    out.append("\t" if cells else "")
                    cells = True
            elif name in ("br", "hr"):
                out.append("\n")
            elif name == "img":
                alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", v)
                out.append((alt[1] or alt[2] or "") if alt else "")
            elif name == "sup":
                out.append("" if closing else "^")
            elif name == "sub":
                out.append("" if closing else "_")
            elif name in BLOCK:
                out.append("\n\n")
        elif kind == "entity":
            out.append(" " if v == "\xa0" else v)
        elif kind == "atx":
            out.append("1. " if v == "1" and wiki > other else head)
        elif kind == "setext":
            out.append(head if v == "head" else "\n")
        elif kind == "fence":
            out.append(f"\n\n{code}" if v == "open" else f"{shut}\n\n")
            at += text[at : at + 1] == "\n" and v == "open"
        elif kind in ("dash", "task"):
            out.append("☑ " if v[:2].lower() == "[x" else "☐ " if v else "• ")
        elif kind == "num":
            out.append(text[s.start : s.end])
        elif kind == "foot":
            out.append(v + (" " if text[s.end - 1] == ":" else ""))
        elif kind == "pipe" or (kind == "wikitable" and v):
            out.append(row + v)
        elif kind == "wikilink":
            parts = v.split("|")
            name = parts[0].partition(":")[0].strip().lower()
            out.append("" if name == "category" else "" if name in ("file", "image") and len(parts) == 1 else parts[-1])
        elif kind == "template":
            name, _, rest = v.partition("|")
            out.append(rest if name.strip().lower() in ("math", "lang", "nowrap", "code", "em", "strong") else "")
        elif kind == "wikihead":
            out.append(head + v)
        elif kind == "math":
            how, _, body = v.partition(":")
            out.append(body if how == "inline" else f"\n\n{code if how == 'code' else form}{body}{shut}\n\n")
        elif kind == "command":
            name, _, args = v.partition("\0")
            inner = _ARG.findall(args)
            if name in HEADS:
                out.append(f"\n\n{head}{inner[-1] if inner else ''}\n\n")
            elif name == "item":
                out.append("•")
            elif name == "footnote":
                out.append(f" ({inner[-1] if inner else ''})")
            elif name in ("ldots", "dots"):
                out.append("…")
            elif name not in DROPPED:
                out.append(inner[-1] if inner else name)
        elif kind == "external":
            out.append(v)
        elif kind == "escape":
            out.append(v + row if v == "\t" else v)
    out.append(text[at:])
    return _blocks("".join(out), head, code, shut, form, row, wiki > other)


def _blocks(text: str, head: str, code: str, shut: str, form: str, row: str, wiki: bool) -> list[tuple[str, str]]:
    blocks: list[tuple[str, str]] = []
    for part in re.split(f"([{code}{form}][^{shut}]*{shut}?)", text):
        if part[:1] in (code, form):
            body = part[1:].removesuffix(shut)
            body = (html.unescape(re.sub(rf"</?(?:{_NAMES}){_ATTR}\s*/?>", "", body, flags=re.I)) if "<code" in body else body).strip("\r\n")
            if body.strip():
                blocks.append(("code" if part[0] == code else "formula", body))
            continue
        every = [x.rstrip("\r").rstrip(" \t") for x in part.replace(shut, "").split("\n")]
        for full, own in groupby(every, key=lambda x: bool(x.strip())):
            lines = list(own) if full else []
            i = 0
            while i < len(lines):
                line = lines[i].lstrip(" ")
                kind = "heading" if head in line else "table" if row in line else "list" if re.match(r"[ \t]*(?:[•☐☑]|\d{1,3}\.) ", line) else "text"
                j = i + 1
                while j < len(lines) and kind != "heading" and head not in lines[j] and (row in lines[j]) == (kind == "table") and (bool(re.match(r"[ \t]*(?:[•☐☑]|\d{1,3}\.) ", lines[j])) == (kind == "list")):
                    j += 1
                body = "\n".join(lines[i:j]).replace(head, "").replace(row, "").strip("\n")
                if kind == "text" and wiki and all(x[0] == " " for x in lines[i:j]):
                    kind, body = "code", re.sub(r"^ ", "", body, flags=re.M)
                elif kind != "code":
                    body = body.strip(" ")
                if body and kind in ("list", "table") and blocks and blocks[-1][0] == kind:
                    blocks[-1] = (kind, blocks[-1][1] + "\n" + body)
                elif body:
                    blocks.append((kind, body))
                i = j
    return blocks


def plain(blocks: list[tuple[str, str]]) -> str:
    return "\n\n".join(b for _, b in blocks)


def labelled(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and the number of residue spans of every text."""
    src = df.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([src.schema["__id"], T.StructField("__n", T.IntegerType())])
    model = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(residue(t, model)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=schema.names)

    return src.mapInArrow(run, schema).select(F.col("__id").alias(doc_id), F.col("__n").alias("n_residue"))


def cleaned(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, the clean text, its blocks and the number of residue spans."""
    src = df.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    block = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([src.schema["__id"], T.StructField("__clean", T.StringType()), T.StructField("__blocks", block), T.StructField("__n", T.IntegerType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    model = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: list[tuple[str | None, list[dict], int]] = []
            for t in b.column(1).to_pylist():
                spans = residue(t, model) if t else []
                gone = furniture(t, spans, model) if t else []
                made = clean(t, spans, gone) if t else []
                done.append((plain(made) if spans or gone else t, [{"kind": k, "text": x} for k, x in made], len(spans)))
            text_, blocks_, n = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_, pa.string()), pa.array(blocks_, kind), pa.array(n, pa.int32())], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(F.col("__id").alias(doc_id), F.col("__clean").alias("clean"), F.col("__blocks").alias("blocks"), F.col("__n").alias("n_residue"))
