"""Markdown to HTML, on the Python side: what the segmenter needs of it.

Blocks: headings (both kinds), paragraphs, nested lists (tight and loose), quotes, fenced and
indented code, rules, link definitions. The web dialect escapes raw HTML and knows pipe
tables and strike-through; the desktop dialect passes HTML through and knows front matter,
footnotes, definition lists, task lists, heading attributes and bracket-delimited notation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*\Z")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\Z")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*)\Z")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(?=\S)|[ \t]*\Z)")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^)]*\)))?[ \t]*\Z""")
TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
HTML_START = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|/?[A-Za-z][A-Za-z0-9-]*(?:\s|/?>|\Z))")
NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)\Z")
ATTRIBUTES = re.compile(r"[ \t]*\{[ \t]*[#.][^{}]*\}[ \t]*\Z")
BLANK = re.compile(r"[ \t]*\Z")


def escaped(s: str) -> str:
    s = re.sub(r"&(?!(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)", "&amp;", s)
    return s.replace("<", "&lt;").replace(">", "&gt;")


def indent(line: str) -> int:
    wide = line[: len(line) - len(line.lstrip(" \t"))].expandtabs(4)
    return len(wide)


def stripped_to(line: str, columns: int) -> str:
    """line without its first columns of white space."""
    lead = line[: len(line) - len(line.lstrip(" \t"))].expandtabs(4)
    return lead[columns:] + line.lstrip(" \t")


@dataclass
class _Run:
    """A run of emphasis marks among inline pieces."""

    mark: str
    count: int
    opens: bool
    closes: bool
    at: int
    whole: int = 0


@dataclass
class Renderer:
    dialect: str = "web"
    links: set = field(default_factory=set)
    notes: dict = field(default_factory=dict)
    known: set = field(default_factory=set)
    cited: list = field(default_factory=list)

    def render(self, text: str) -> str:
        lines = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "\ufffd").split("\n")
        if self.desktop and lines[0].rstrip() == "---" and "---" in (x.rstrip() for x in lines[1:]):
            lines = lines[[x.rstrip() for x in lines].index("---", 1) + 1 :]
        for line in lines:  # links may be defined after their use
            self.definition([line], 0)
        if self.desktop:
            self.known = {m[1] for m in map(NOTE.match, lines) if m}
        body = self.blocks(lines)
        if self.cited:
            back = " <a>\u21a9\ufe0e</a></p>"
            items = "".join(f"<li>{re.sub('</p>$', back, self.notes[name])}</li>\n" for name in self.cited if name in self.notes)
            body += f'\n<section class="footnotes">\n<ol>\n{items}</ol>\n</section>\n'
        return body

    @property
    def desktop(self) -> bool:
        return self.dialect == "desktop"

    # ---- blocks ----

    def interrupts(self, line: str) -> bool:
        """Whether line ends a paragraph before it."""
        m = ITEM.match(line)
        listed = m and line[m.end() :].strip() and (m[2] in "-+*" or m[2][:-1] == "1")
        return bool(indent(line) < 4 and (ATX.match(line) or RULE.match(line) or FENCE.match(line) or line.lstrip().startswith(">") or listed or (self.desktop and HTML_START.match(line))))

    def blocks(self, lines: list[str], tight: bool = False) -> str:
        out, i = [], 0
        while i < len(lines):
            line = lines[i]
            if BLANK.match(line):
                i += 1
                continue
            for read in (self.code, self.fence, self.quote, self.rule, self.listing, self.heading, self.table, self.html, self.notation, self.note, self.definition):
                if (found := read(lines, i)) is not None:
                    html, i = found
                    out.append(html)
                    break
            else:
                html, i = self.paragraph(lines, i, tight)
                out.append(html)
        return "\n".join(x for x in out if x)

    def code(self, lines, i):
        if indent(lines[i]) < 4:
            return None
        j = i
        while j < len(lines) and (BLANK.match(lines[j]) or indent(lines[j]) >= 4):
            j += 1
        body = "\n".join(stripped_to(x, 4) for x in lines[i:j]).rstrip("\n")
        return f"<pre><code>{escaped(body)}\n</code></pre>", j

    def fence(self, lines, i):
        m = FENCE.match(lines[i])
        if not m or (m[2][0] == "`" and "`" in m[3]):
            return None
        j = i + 1
        while j < len(lines) and not re.match(rf" {{0,3}}{m[2][0]}{{{len(m[2])},}}[ \t]*\Z", lines[j]):
            j += 1
        body = "\n".join(x[min(len(m[1]), len(x) - len(x.lstrip(" "))) :] for x in lines[i + 1 : j])
        return f"<pre><code>{escaped(body)}\n</code></pre>", j + 1

    def quote(self, lines, i):
        if not re.match(r" {0,3}>", lines[i]):
            return None
        inner, j = [], i
        while j < len(lines):
            if m := re.match(r" {0,3}> ?", lines[j]):
                inner.append(lines[j][m.end() :])
            elif BLANK.match(lines[j]) or self.interrupts(lines[j]) or not inner[-1].strip():
                break
            else:
                inner.append(lines[j])
            j += 1
        return f"<blockquote>\n{self.blocks(inner)}\n</blockquote>", j

    def rule(self, lines, i):
        return ("<hr>", i + 1) if RULE.match(lines[i]) else None

    def heading(self, lines, i):
        m = ATX.match(lines[i])
        if not m:
            return None
        text = m[2] or ""
        if self.desktop:
            text = ATTRIBUTES.sub("", text)
        return f"<h{len(m[1])}>{self.inline(text.strip())}</h{len(m[1])}>", i + 1

    def listing(self, lines, i):
        m = ITEM.match(lines[i])
        if not m:
            return None
        kind = m[2][-1]
        items, loose, j = [], False, i
        while j < len(lines):
            m = ITEM.match(lines[j])
            if not m or m[2][-1] != kind or RULE.match(lines[j]):
                break
            pad = len(m[3].expandtabs(4)) if m[3] else 1
            width = len(m[1]) + len(m[2]) + (pad if pad <= 4 else 1)
            item = [" " * (pad - 1 if pad > 4 else 0) + lines[j][m.end() :]]
            j, gap = j + 1, False
            while j < len(lines):
                if BLANK.match(lines[j]):
                    if len(item) == 1 and not item[0].strip():
                        break  # an item starts with at most one blank line
                    gap = True
                    item.append("")
                elif indent(lines[j]) >= width:
                    loose |= gap
                    gap = False
                    item.append(stripped_to(lines[j], width))
                elif gap or self.interrupts(lines[j]) or ITEM.match(lines[j]):
                    break
                else:
                    item.append(lines[j])  # a paragraph goes on
                j += 1
            after = j
            while after < len(lines) and BLANK.match(lines[after]):
                after += 1
            again = ITEM.match(lines[after]) if after < len(lines) else None
            loose |= bool((gap or after > j) and again and again[2][-1] == kind)
            items.append(item)
            j = after
        inner = []
        for item in items:
            if self.desktop:
                item[0] = re.sub(r"^\[[ xX]\][ \t]+", "", item[0])
            inner.append(f"<li>{self.blocks(item, tight=not loose)}</li>")
        tag = "ul" if kind in "-+*" else "ol"
        return f"<{tag}>\n" + "\n".join(inner) + f"\n</{tag}>", j

    def table(self, lines, i):
        if self.desktop or i + 1 >= len(lines) or "|" not in lines[i] or not TABLE_RULE.match(lines[i + 1]):
            return None
        cells = lambda x: [c.strip() for c in re.split(r"(?<!\\)\|", x.strip().removeprefix("|").removesuffix("|"))]
        if len(cells(lines[i])) != len(cells(lines[i + 1])):
            return None
        j = i + 2
        while j < len(lines) and not BLANK.match(lines[j]) and not self.interrupts(lines[j]):
            j += 1
        rows = "".join("<tr>" + "".join(f"<td>{self.inline(c)}</td>" for c in cells(x)) + "</tr>" for x in (lines[i], *lines[i + 2 : j]))
        return f"<table>{rows}</table>", j

    def html(self, lines, i):
        if not self.desktop or not HTML_START.match(lines[i]):
            return None
        j = i
        while j < len(lines) and not BLANK.match(lines[j]):
            j += 1
        return "\n".join(lines[i:j]), j

    def notation(self, lines, i):
        if not self.desktop or not lines[i].lstrip().startswith("\\["):
            return None
        for j in range(i, len(lines)):
            if lines[j].rstrip().endswith("\\]"):
                inner = "\n".join(lines[i : j + 1]).strip()[2:-2]
                return f"<section>\n<eqn>{escaped(inner)}</eqn>\n</section>", j + 1
        return None

    def note(self, lines, i):
        m = NOTE.match(lines[i]) if self.desktop else None
        if not m:
            return None
        body, j = [m[2]], i + 1
        while j < len(lines) and (indent(lines[j]) >= 4 or (BLANK.match(lines[j]) and j + 1 < len(lines) and indent(lines[j + 1]) >= 4)):
            body.append(stripped_to(lines[j], 4))
            j += 1
        self.notes[m[1]] = self.blocks(body)
        return "", j

    def definition(self, lines, i):
        m = DEFINITION.match(lines[i])
        if not m:
            return None
        self.links.add(" ".join(m[1].lower().split()))
        return "", i + 1

    def paragraph(self, lines, i, tight):
        part, j = [lines[i].lstrip()], i + 1
        while j < len(lines) and not BLANK.match(lines[j]):
            if m := SETEXT.match(lines[j]):
                level = 1 if m[1][0] == "=" else 2
                return f"<h{level}>{self.inline(chr(10).join(part).strip())}</h{level}>", j + 1
            if self.interrupts(lines[j]) or (self.desktop and lines[j].lstrip().startswith("\\[")):
                break
            if self.desktop and re.match(r" {0,3}[:~][ \t]", lines[j]):
                return self.definitions(part, lines, j)
            part.append(lines[j].lstrip())
            j += 1
        html = self.inline("\n".join(part).rstrip())
        return (html if tight else f"<p>{html}</p>"), j

    def definitions(self, terms, lines, j):
        out = "".join(f"<dt>{self.inline(t)}</dt>" for t in terms)
        while j < len(lines) and (m := re.match(r" {0,3}[:~][ \t]+", lines[j])):
            out += f"<dd>{self.inline(lines[j][m.end() :])}</dd>"
            j += 1
        return f"<dl>{out}</dl>", j

    # ---- inline ----

    TOKEN = re.compile(
        r"(?P<notation>\\\((?:.+?)\\\))|(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)\n)|(?P<ticks>`+)|(?P<auto><(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>)"
        r"|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)|(?P<ref>\[\^[^\]\s]+\])|(?P<image>!\[)|(?P<open>\[)|(?P<close>\])|(?P<marks>\*+|_+|~~)", re.S,
    )

    def inline(self, text: str) -> str:
        pieces: list[str] = []
        runs: list[_Run] = []
        brackets: list[tuple[int, bool, int]] = []
        at = 0
        while m := self.TOKEN.search(text, at):
            pieces.append(escaped(text[at : m.start()].replace(" \n", "\n")))
            kind, at = m.lastgroup, m.end()
            if kind == "notation" and self.desktop:
                pieces.append(f"<eq>{escaped(m[0][2:-2])}</eq>")
            elif kind == "notation":
                pieces.append("(")
                at = m.start() + 2
            elif kind == "escape":
                pieces.append(escaped(m[0][1]) if m[0][1] != "&" else "&amp;")
            elif kind == "hard":
                pieces.append("<br>\n")
            elif kind == "ticks":
                end = re.compile(rf"(?<!`){m[0]}(?!`)").search(text, at)
                if end:
                    code = text[at : end.start()].replace("\n", " ")
                    code = code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code
                    pieces.append(f"<code>{code.replace('&', '&amp;').replace('<', '&lt;')}</code>")
                    at = end.end()
                else:
                    pieces.append(m[0])
            elif kind == "auto":
                pieces.append(f"<a>{escaped(m[0][1:-1])}</a>")
            elif kind == "tag":
                pieces.append(m[0] if self.desktop else escaped(m[0]))
            elif kind == "ref" and m[0][2:-1] in self.known:
                if m[0][2:-1] not in self.cited:
                    self.cited.append(m[0][2:-1])
                pieces.append(f"<sup><a>[{self.cited.index(m[0][2:-1]) + 1}]</a></sup>")
            elif kind in ("image", "open", "ref"):
                if kind == "ref":
                    at = m.start() + 1
                brackets.append((len(pieces), kind == "image", at))
                pieces.append("![" if kind == "image" else "[")
            elif kind == "close":
                at = self.bracket(text, m.start(), at, pieces, brackets, runs)
            else:
                before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
                left = not after.isspace() and (not self.punctuation(after) or before.isspace() or self.punctuation(before))
                right = not before.isspace() and (not self.punctuation(before) or after.isspace() or self.punctuation(after))
                word = m[0][0] == "_"
                if m[0] == "~~" and self.desktop:
                    pieces.append("~~")
                    continue
                opens, closes = left and (not word or not right or self.punctuation(before)), right and (not word or not left or self.punctuation(after))
                runs.append(_Run(m[0][0], len(m[0]), opens, closes, len(pieces), len(m[0])))
                pieces.append(m[0])
        pieces.append(escaped(text[at:].replace(" \n", "\n")))
        self.emphasis(pieces, runs)
        return "".join(pieces)

    @staticmethod
    def punctuation(c: str) -> bool:
        return bool(c) and not c.isalnum() and not c.isspace()

    def bracket(self, text, start, at, pieces, brackets, runs) -> int:
        """Ends a link or an image where one was opened; returns where to go on."""
        if not brackets:
            pieces.append("]")
            return at
        opened, image, begin = brackets.pop()
        m = re.compile(r"""\(\s*(?:<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)""").match(text, at)
        if m is None:
            label = re.compile(r"\[([^\[\]]*)\]").match(text, at)
            name = " ".join(((label[1] if label else "") or text[begin:start]).lower().split())
            if name not in self.links:
                pieces.append("]")
                return at
            m = label
        inside = [r for r in runs if r.at > opened]
        del runs[len(runs) - len(inside) :]
        self.emphasis(pieces, inside)
        if image:  # the description is an attribute
            del pieces[opened:]
            pieces.append("<img>")
        else:
            pieces[opened] = "<a>"
            pieces.append("</a>")
        return m.end() if m else at

    @staticmethod
    def emphasis(pieces: list[str], runs: list[_Run]) -> None:
        """Pairs the marks: each closing run with the nearest run that can open it."""
        ends: dict[int, list[str]] = {}
        starts: dict[int, list[str]] = {}
        left = list(runs)
        i = 0
        while i < len(left):
            closer = left[i]
            if not closer.closes or not closer.count:
                i += 1
                continue
            for k in range(i - 1, -1, -1):
                opener = left[k]
                odd = (opener.closes or closer.opens) and (opener.whole + closer.whole) % 3 == 0 and (opener.whole % 3 or closer.whole % 3)
                if opener.opens and opener.count and opener.mark == closer.mark and (closer.mark == "~" or not odd):
                    break
            else:
                i += 1
                continue
            n = 2 if closer.mark == "~" or (opener.count >= 2 and closer.count >= 2) else 1
            tag = "s" if closer.mark == "~" else "strong" if n == 2 else "em"
            starts.setdefault(opener.at, []).append(f"<{tag}>")
            ends.setdefault(closer.at, []).append(f"</{tag}>")
            opener.count -= n
            closer.count -= n
            del left[k + 1 : i]
            i = k + 1 if opener.count else k
            if not opener.count:
                left.remove(opener)
            if not closer.count:
                left.remove(closer)
        for r in runs:
            pieces[r.at] = "".join(ends.get(r.at, [])) + r.mark * r.count + "".join(reversed(starts.get(r.at, [])))


def to_html(text: str, dialect: str = "web") -> str:
    return Renderer(dialect).render(text)
