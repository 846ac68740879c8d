"""Page layout: positioned glyph runs to text, page by page.

A page is small, so one row holds it whole; pages spread over the cluster.
Geometry follows the usual text-space convention: y grows upwards. The steps: runs are
grouped into lines; small runs go to the line that they hang on; each line becomes text
with its notation between \\( and \\); lines become paragraphs and headings; what can't be
put into a reading order lowers the page's confidence.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.batches import map_rows

# Thresholds of the layout, as multiples of the body size unless named otherwise.
LINE_TOLERANCE, LEAST_TOLERANCE = 0.52, 2.5
FULL_SIZE, SCRIPT_SIZE, SCRIPT_BELOW, SCRIPT_ABOVE = 0.9, 0.78, -0.6, 1.05
FRACTION_OVERLAP, FRACTION_LOW, FRACTION_HIGH = 0.5, 0.25, 1.4
LEVEL_ONE, LEVEL_TWO, SPACE_GAP = 0.82, 0.55, 0.15
STACK_GAP, USUAL_GAP, MOST_GAP = 0.85, 1.2, 3
BREAK_GAP, INDENT, LONG_LINE, SIZE_CHANGE = 1.45, 0.8, 4, 0.2
HEADING_SIZE, TITLE_SIZE, EDGE = 1.14, 1.2, 1.6
HEADING_LENGTH, NUMBERED_LENGTH, HEAD_LENGTH, HEADING_LINES, DIGITS_ALONE = 120, 90, 70, 3, 12
ROUTE_CONFIDENCE, DEFAULT_BODY = 0.6, 10.0

# Symbols as commands.
SYMBOLS = {
    "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "≡": "\\equiv",
    "≅": "\\cong", "∼": "\\sim", "∝": "\\propto", "±": "\\pm", "∓": "\\pm",
    "×": "\\times", "÷": "\\div", "⋅": "\\cdot", "·": "\\cdot", "∘": "\\circ",
    "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "√": "\\sqrt", "∞": "\\infty",
    "∂": "\\partial", "∇": "\\nabla", "∈": "\\in", "∉": "\\notin", "∋": "\\ni",
    "⊂": "\\subset", "⊆": "\\subseteq", "⊃": "\\superset", "∪": "\\cup",
    "∩": "\\cap", "∖": "\\setminus", "∅": "\\emptyset", "∀": "\\forall",
    "∃": "\\exists", "¬": "\\neg", "∧": "\\wedge", "∨": "\\vee",
    "→": "\\rightarrow", "←": "\\leftarrow", "↦": "\\mapsto", "⇒": "\\Rightarrow",
    "⇐": "\\Leftarrow", "⇔": "\\Leftrightarrow", "⟨": "\\langle", "⟩": "\\rangle",
    "⊕": "\\oplus", "⊗": "\\otimes", "⊙": "\\odot", "⋊": "\\rtimes", "⋉": "\\ltimes",
    "′": "^{\\prime}", "−": "-", "∗": "*", "∣": "\\mid", "∥": "\\|",
    "ℝ": "\\mathbb{R}", "ℤ": "\\mathbb{Z}", "ℕ": "\\mathbb{N}", "ℚ": "\\mathbb{Q}",
    "ℂ": "\\mathbb{C}", "ℍ": "\\mathbb{H}", "ℓ": "l", "ℵ": "\\aleph",
}
# Greek letters as commands.
GREEK = {
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\epsilon",
    "ϵ": "\\epsilon", "ζ": "\\zeta", "η": "\\eta", "θ": "\\theta", "ϑ": "\\theta",
    "ι": "\\iota", "κ": "\\kappa", "λ": "\\lambda", "μ": "\\mu", "ν": "\\nu",
    "ξ": "\\xi", "π": "\\pi", "ρ": "\\rho", "σ": "\\sigma", "ς": "\\sigma",
    "τ": "\\tau", "υ": "\\upsilon", "φ": "\\phi", "ϕ": "\\phi", "χ": "\\chi",
    "ψ": "\\psi", "ω": "\\omega", "Γ": "\\Gamma", "Δ": "\\Delta", "Θ": "\\Theta",
    "Λ": "\\Lambda", "Ξ": "\\Xi", "Π": "\\Pi", "Σ": "\\Sigma", "Φ": "\\Phi",
    "Ψ": "\\Psi", "Ω": "\\Omega",
}
# Ranges of mathematical characters (operators, arrows, more operators, letters, letter-like, Greek, primes).
MATH_RANGES = ((0x2200, 0x22FF), (0x2190, 0x21FF), (0x27C0, 0x27EF), (0x2A00, 0x2AFF), (0x1D400, 0x1D7FF), (0x2100, 0x214F), (0x0370, 0x03FF), (0x2032, 0x2037))
# Fonts of notation, and those whose letters are variables of their own.
MATH_FONT = re.compile(r"CMMI|CMSY|CMEX|CMBSY|MSAM|MSBM|EUSM|RSFS|Math|Symbol", re.I)
VARIABLE_FONT = re.compile(r"CMMI|MI\d|[rt]?txmi|Math-?Italic|MathItalic", re.I)
# Proof boxes and bullets that aren't read.
NOISE = "□∎■◻▪"
SLASH = "\u0338"
SECTION_WORD = re.compile(r"(?:references|bibliography|acknowledge?ments?)\s*\.?\s*", re.I)
NUMBERED = re.compile(r"\d+(\.\d+)*\.?\s+[A-Z][A-Za-z]")
CAPITALS = re.compile(r"[A-Z0-9 .,'’\-–—:]+")
SHORT = re.compile(r"[A-Za-z0-9]{1,4}")


@dataclass(slots=True)
class Run:
    """A run of glyphs; latex is set for what was put together here."""

    text: str
    x: float
    y: float
    size: float
    width: float
    font: str
    latex: str = ""

    @property
    def end(self) -> float:
        return self.x + self.width

    @property
    def solid(self) -> bool:
        return bool(re.search("[A-Za-z0-9]", self.text))


@dataclass(slots=True)
class Line:
    y: float
    size: float
    runs: list[Run]

    def arrange(self) -> None:
        self.runs.sort(key=lambda r: r.x)


@dataclass(slots=True)
class Row:
    """A line as text, with its counts of characters."""

    text: str
    math: int
    total: int
    unknown: int
    y: float = 0.0
    size: float = 0.0
    left: float = 0.0
    right: float = 0.0


@dataclass(slots=True)
class Paragraph:
    rows: list[Row]
    size: float
    section: bool = False


@dataclass(slots=True)
class Piece:
    """Part of a line with one script level: 0 for full size, 1 and 2 for scripts."""

    text: str
    math: bool
    level: int
    y: float
    space: bool


def folded(code: int) -> str:
    """The plain letter or digit of a mathematical alphanumeric character, or nothing."""
    if 0x1D7CE <= code <= 0x1D7FF:
        return str((code - 0x1D7CE) % 10)
    if 0x1D400 <= code < 0x1D7CE:
        place = (code - 0x1D400) % 52
        return chr(65 + place) if place < 26 else chr(71 + place)
    return ""


def is_math(code: int) -> bool:
    return any(a <= code <= b for a, b in MATH_RANGES)


def glyph_map(text: str) -> str:
    """Combining slashes joined to what they strike out; other slashes, proof boxes and bullets removed."""
    if text.isascii():
        return text
    for plain, struck in (("=", "≠"), ("∈", "∉")):
        text = re.sub(rf"{SLASH}\s*{plain}|{plain}\s*{SLASH}", struck, text)
    return re.sub(f"[{SLASH}{NOISE}]", "", text)


def upright(items: Iterable[dict]) -> list[Run]:
    """Runs with text that aren't turned, of items (str, transform, width, font)."""
    out = []
    for i in items:
        if not i["transform"] or len(i["transform"]) != 6 or None in i["transform"]:
            continue  # without a place
        a, b, c, d, x, y = i["transform"]
        if i["str"] and i["str"].strip() and a > 0 and abs(b) < 0.05 * abs(a) + 0.01:
            out.append(Run(i["str"], x, y, math.hypot(c, d), i["width"] or 0.0, i.get("font") or ""))
    return out


def body_size(runs: list[Run]) -> float:
    """The size (to a half) with the most characters, the first seen of equals."""
    weight: dict[float, int] = defaultdict(int)
    for r in runs:
        if size := math.floor(r.size * 2 + 0.5) / 2:
            weight[size] += len(r.text)
    return max(weight, key=weight.get) if weight else DEFAULT_BODY


def group_lines(runs: list[Run], body: float) -> list[Line]:
    """Lines from the top down. A run joins the first line whose first run is near; then each line gets the place and size of its weightiest run."""
    near = max(LEAST_TOLERANCE, LINE_TOLERANCE * body)
    lines: list[Line] = []
    for r in sorted(runs, key=lambda r: (-r.y, r.x)):
        home = next((x for x in lines if abs(x.y - r.y) < near), None)
        if home is None:
            lines.append(Line(r.y, r.size, [r]))
        else:
            home.runs.append(r)
    for line in lines:
        line.arrange()
        main = max(line.runs, key=lambda r: len(r.text.strip()) * r.size)
        line.y, line.size = main.y, main.size
    return lines


def attach_scripts(lines: list[Line], body: float) -> list[Line]:
    """Small runs that hang on no full-size text of their own line go to the nearest line that has some."""
    anchors = [x for x in lines if x.size >= FULL_SIZE * body and any(r.size >= FULL_SIZE * body and r.solid for r in x.runs)]
    own = {id(x) for x in anchors}

    def hangs(r: Run, line: Line) -> bool:
        return SCRIPT_BELOW * body <= r.y - line.y <= SCRIPT_ABOVE * body

    def reaches(r: Run, line: Line) -> bool:
        return line.runs[0].x - body <= r.x <= line.runs[-1].end + body

    for line in lines:
        stay = []
        for r in reversed(list(line.runs)):
            if r.size <= SCRIPT_SIZE * body and not (id(line) in own and hangs(r, line)):
                others = [a for a in anchors if a is not line and hangs(r, a) and reaches(r, a)]
                if others:
                    min(others, key=lambda a: abs(r.y - a.y)).runs.append(r)
                    continue
            stay.append(r)
        line.runs[:] = reversed(stay)
    for line in lines:
        line.arrange()
    return [x for x in lines if x.runs]


def fuse_fractions(runs: list[Run], line: Line) -> list[Run]:
    """Two short small runs one above the other become one run on the line."""
    left, out = list(runs), []
    while left:
        a = left.pop(0)
        if a.size <= SCRIPT_SIZE * line.size and not a.latex:
            for b in left:
                if not b.latex and b.size <= SCRIPT_SIZE * line.size and _stacked(a, b, line.size):
                    top, low = (a, b) if a.y > b.y else (b, a)
                    num, den = top.text.strip(), low.text.strip()
                    left.remove(b)
                    a = Run(f"{num}/{den}", min(a.x, b.x), line.y, line.size, max(a.width or a.size, b.width or b.size), a.font, f" \\frac{{{num}}}{{{den}}} ")
                    break
        out.append(a)
    return out


def _stacked(a: Run, b: Run, size: float) -> bool:
    wide, other = a.width or a.size, b.width or b.size
    shared = min(a.x + wide, b.x + other) - max(a.x, b.x)
    rise = abs(a.y - b.y)
    short = SHORT.fullmatch(a.text.strip()) and SHORT.fullmatch(b.text.strip())
    return bool(short and shared >= FRACTION_OVERLAP * min(wide, other) and FRACTION_LOW * size <= rise <= FRACTION_HIGH * size)


def spelled(raw: str, font: str) -> tuple[str, bool, int, int, int]:
    """text, whether it is notation, and how many characters are, are there, and aren't known."""
    notation, variables = bool(MATH_FONT.search(font)), bool(VARIABLE_FONT.search(font))
    if raw.isascii() and not variables:
        return raw, notation, len(raw) * notation, len(raw), 0
    out, counted, unknown, found = [], 0, 0, notation
    for c in raw:
        command, plain = SYMBOLS.get(c) or GREEK.get(c), folded(ord(c))
        letter = c if variables and re.match("[A-Za-z]", c) else ""
        if command:
            out.append(f" {command} ")
        elif letter or plain:
            out.append((letter or plain) + (" " if (letter or plain).isalpha() else ""))
        elif is_math(ord(c)) or c == "\ufffd":
            out.append(" ")
            unknown += 1
        else:
            out.append(c)
            counted += notation
            continue
        counted += 1
        found = found or not letter
    return "".join(out), found, counted, len(raw), unknown


@dataclass
class Writer:
    """Puts the pieces of a line together: opens and closes notation and its scripts."""

    base: float
    out: str = ""
    inside: bool = False
    heights: list[float] = field(default_factory=list)
    depth: int = 0

    def __post_init__(self):
        self.heights = [self.base]

    def close_scripts(self, level: int) -> None:
        self.out += "}" * max(0, self.depth - level)
        self.depth = min(self.depth, level)

    def close(self) -> None:
        self.close_scripts(0)
        if self.inside:
            self.out = self.out.rstrip() + "\\)"
            self.inside = False

    def add(self, p: Piece) -> None:
        if p.level:
            self.script(p)
            return
        self.close_scripts(0)
        if p.math and not self.inside:
            self.out += " \\(" if self.out and not self.out[-1].isspace() else "\\("
            self.inside = True
        elif self.inside and not p.math:
            self.close()
            self.out += " "
        elif p.space:
            self.out += " "
        self.out += p.text
        self.heights = [p.y]

    def script(self, p: Piece) -> None:
        text = p.text.strip()
        if not text:
            return
        if not self.inside and not self.depth:
            bare = self.out.rstrip()
            if re.fullmatch(r"\d{1,3}", text) and not p.math and p.y > self.heights[0] and re.search(r"[a-zA-Z.,;:)\]!?'’”]\Z", bare):
                self.out = bare + text  # the mark of a footnote
                return
            if bare.endswith("\\)"):
                self.out = bare[:-2]  # goes on with the notation just closed
            else:
                word = re.search(r"[^\s\\(){}]+\Z", bare)
                self.out = (self.out[: word.start()] if word else self.out) + "\\(" + (word[0] if word else "")
            self.inside = True
        self.close_scripts(p.level)
        while self.depth < p.level:
            below = self.heights[self.depth] if self.depth < len(self.heights) else self.base
            self.out += "^{" if p.y > below else "_{"
            self.depth += 1
        if p.space and not re.search(r"[{\s]\Z", self.out):
            self.out += " "
        self.out += text
        self.heights = [*(self.heights + [self.base] * p.level)[: p.level], p.y]


# What the fonts draw as two glyphs, put together again; a root gets its operand in braces.
REPAIRS = [
    (re.compile(r"7\s*\\\(\s*\\rightarrow"), r"\\(\\mapsto"), (re.compile(r"7\s*\\rightarrow"), r"\\mapsto"),
    (re.compile(r"\\sim\s*\\\)\s*="), r"\\cong\\)"), (re.compile(r"\\sim\s*="), r"\\cong"), (re.compile(r"\\sqrt\s+(\d+|[a-zA-Z])"), r"\\sqrt{\1}"),
]


def line_text(line: Line, fonts: dict[str, str]) -> Row:
    runs: list[Run] = []
    for r in line.runs:  # a slash on its own belongs to the run after it
        if runs and runs[-1].text.strip() == SLASH:
            slash = runs.pop()
            r = replace(r, text=SLASH + r.text, x=slash.x, y=slash.y, size=slash.size)
        runs.append(r)
    pieces, end = [], None
    math_, total, unknown = 0, 0, 0
    for r in fuse_fractions(runs, line):
        raw = glyph_map(r.text)
        if not raw.strip():
            continue
        level = 0 if r.size >= LEVEL_ONE * line.size else 1 if r.size >= LEVEL_TWO * line.size else 2
        space, end = end is not None and r.x - end > SPACE_GAP * r.size, r.end
        if r.latex:
            text, notation, level, counts = r.latex, True, 0, (len(r.text), len(r.text), 0)
        else:
            text, notation, *counts = spelled(raw, fonts.get(r.font, ""))
        math_, total, unknown = math_ + counts[0], total + counts[1], unknown + counts[2]
        if text.strip():
            pieces.append(Piece(text, notation, level, r.y, space))
    writer = Writer(line.y)
    for p in pieces:
        writer.add(p)
    writer.close()
    out = writer.out
    for pattern, repaired in REPAIRS:
        out = pattern.sub(repaired, out)
    return Row(re.sub(r"\s+", " ", out).strip(), math_, total, unknown, line.y, line.size, line.runs[0].x, line.runs[-1].end)


def readable(text: str) -> bool:
    """Whether a line has letters, or many digits, besides its commands."""
    bare = re.sub(r"[\\(){}^_]", "", re.sub(r"\\[a-zA-Z]+", "", text))
    return bool(re.search("[A-Za-z]", bare) or (re.search("[0-9]", bare) and len(re.sub(r"\s", "", bare)) >= DIGITS_ALONE))


def running_head(row: Row, edge: float, body: float, page_no: int) -> bool:
    if abs(row.y - edge) > EDGE * body:
        return False
    if re.fullmatch(r"\d{1,4}", row.text):
        return True
    plain = page_no > 1 and len(row.text) < HEAD_LENGTH and not re.search(r"[.?!:]\Z", row.text)
    return bool(plain and (CAPITALS.fullmatch(row.text) or re.match(r"\d+\s", row.text) or re.search(r"\s\d+\Z", row.text)))


def paragraphs(rows: list[Row], body: float) -> list[Paragraph]:
    gaps = sorted(g for a, b in zip(rows, rows[1:]) if 0 < (g := a.y - b.y) < MOST_GAP * body)  # noqa: B905
    usual = gaps[len(gaps) // 2] if gaps else USUAL_GAP * body
    out: list[Paragraph] = []
    for k, row in enumerate(rows):
        section = bool(SECTION_WORD.fullmatch(row.text))
        starts = section or not out or out[-1].section
        if not starts:
            last = rows[k - 1]
            indented = row.left - last.left > INDENT * body and last.right - last.left > LONG_LINE * body
            starts = last.y - row.y > BREAK_GAP * usual or indented or abs(row.size - last.size) > SIZE_CHANGE * body
        if starts:
            out.append(Paragraph([row], row.size, section))
        else:
            out[-1].rows.append(row)
    return out


def block_text(p: Paragraph, body: float) -> str:
    text = ""
    for row in p.rows:
        text = text[:-1] + row.text if text.endswith("-") else f"{text} {row.text}" if text else row.text
    text = re.sub(r"\\\)\s*\\\(", " ", text)
    large = p.size >= HEADING_SIZE * body and len(p.rows) <= HEADING_LINES and len(text) < HEADING_LENGTH and not re.search(r"\.\s", text)
    numbered = len(p.rows) == 1 and len(text) < NUMBERED_LENGTH and NUMBERED.match(text)
    return f"## {text}" if large or numbered or p.section else text


NOTHING = {"mmd": "", "confidence": 0.0, "math_ratio": 0.0, "has_text": False}


def extract_page(items: Iterable[dict], fonts: dict[str, str] | None = None, page_no: int = 1) -> dict:
    """mmd, confidence, math_ratio, has_text of a page's items (str, transform, width, font)."""
    runs = upright(items)
    body = body_size(runs)
    orphans, lines, rows = 0, [], []
    for line in attach_scripts(group_lines(runs, body), body):
        if any(r.size >= FULL_SIZE * line.size and r.solid for r in line.runs):
            lines.append(line)
        else:
            orphans += sum(len(r.text.strip()) for r in line.runs)
    for line in lines:
        row = line_text(line, fonts or {})
        if row.text and readable(row.text):
            rows.append(row)
        elif row.text:
            orphans += row.total
    if not rows:
        return dict(NOTHING)
    stacked = sum(min(a.total, b.total) for a, b in zip(rows, rows[1:]) if 0 < a.y - b.y < STACK_GAP * min(a.size, b.size) and min(a.right, b.right) > max(a.left, b.left))  # noqa: B905
    first, last = rows[0], rows[-1]
    kept = [r for r in rows if not ((r is first and running_head(r, lines[0].y, body, page_no)) or (r is last and running_head(r, lines[-1].y, body, page_no)))]
    found = paragraphs(kept, body)
    blocks = [block_text(p, body) for p in found]
    largest = max((p.size for p in found), default=0.0)
    if page_no == 1 and largest > TITLE_SIZE * body:
        k = next(i for i, p in enumerate(found) if p.size == largest)
        blocks[k] = "# " + re.sub(r"^#+\s*", "", blocks[k])
    total, unknown, math_ = (sum(getattr(r, c) for r in rows) for c in ("total", "unknown", "math"))
    some = max(1, total)
    score = 1 - min(0.7, 4 * stacked / some) - min(0.4, 30 * unknown / some) - min(0.3, 4 * orphans / max(1, total + orphans))
    return {"mmd": "\n\n".join(blocks), "confidence": max(0.0, score), "math_ratio": math_ / total if total else 0.0, "has_text": True}


def extract_pages(glyphs: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """doc_id, page_no, mmd, confidence, math_ratio, has_text of glyphs(doc_id, page_no, item_no, str, transform, width, font)."""
    named = glyphs.join(fonts, "font", "left") if fonts is not None else glyphs.withColumn("ps_name", F.col("font"))

    def one(doc_id, page_no, items):
        names = {i["font"]: i["ps_name"] for i in items if i["ps_name"] is not None}
        page = extract_page(items, names, page_no)
        return [(doc_id, page_no, page["mmd"], page["confidence"], page["math_ratio"], page["has_text"])]

    item = F.struct("item_no", "str", F.col("transform").cast("array<double>").alias("transform"), F.col("width").cast("double").alias("width"), F.col("font").cast("string").alias("font"), F.col("ps_name").cast("string").alias("ps_name"))
    pages = named.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    fields = [("doc_id", pa.int64(), "long"), ("page_no", pa.int32(), "int"), ("mmd", pa.string(), "string"), ("confidence", pa.float64(), "double"), ("math_ratio", pa.float64(), "double"), ("has_text", pa.bool_(), "boolean")]
    return map_rows(pages, one, fields)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_no, item_no, str, transform, width, font of JSON lines {doc_id, page_no, items: [{str, transform, width, fontName}]}."""
    schema = "doc_id long, page_no int, items array<struct<str:string,transform:array<double>,width:double,fontName:string>>"
    items = spark.read.schema(schema).json(path).select("doc_id", "page_no", F.posexplode("items").alias("item_no", "i"))
    return items.select("doc_id", "page_no", "item_no", "i.str", "i.transform", "i.width", F.col("i.fontName").alias("font"))


def route(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages whose text layer serves, pages that need recognition)."""
    fine = F.col("has_text") & (F.col("confidence") >= ROUTE_CONFIDENCE)
    return pages.filter(fine), pages.filter(~fine)


def confidence(stacked, unknown, orphans, total):
    """The confidence of a page as a column expression."""
    whole = F.greatest(total, F.lit(1))
    score = F.lit(1.0) - F.least(F.lit(0.7), 4 * stacked / whole) - F.least(F.lit(0.4), 30 * unknown / whole) - F.least(F.lit(0.3), 4 * orphans / F.greatest(total + orphans, F.lit(1)))
    return F.greatest(F.lit(0.0), score)
