"""Ordered rewrite rules for prose and for mathematical notation.

A rule is (pattern, replacement); the order is part of the meaning. Prose rules run
either as a chain of JVM expressions, each group behind a cheap test for the characters
without which none of its rules can match, or, where a text is in Python anyway, as the
same rules there. Math rules run in a vectorised function, as nested fractions and roots
need a loop until nothing changes.

Patterns are written with \\s, \\w, \\d and \\b in the meaning that their dialect gives them:
the web dialect knows ASCII letters and digits and its own list of white space, the
desktop dialect goes by Unicode.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the web dialect takes for white space, as the inside of a character class.
SPACE = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Trigger of rules for the end of a text: it ends in a digit.
DIGIT_LAST = "0-9$"

# The prose rules, as (what a text must hold for them, pattern, replacement) in order.
PROSE = [
    (".", r"i\.e\.", "that is"),
    (".", r"e\.g\.", "for example"),
    (".", r"e\. g\.", "for example"),
    (".", r"i\.i\.d\.?", "independent and identically distributed"),
    ("", r"\b[iI][iI][dD]\b", "independent and identically distributed"),
    (".", r"Eq\.", "Equation"),
    (".", r"eq\.", "equation"),
    (".", r"Fig\.", "Figure"),
    (".", r"fig\.", "figure"),
    (".", r"Sec\.", "Section"),
    (".", r"sec\.", "section"),
    (".", r"Tab\.", "Table"),
    (".", r"tab\.", "table"),
    (".", r"Thm\.", "Theorem"),
    (".", r"thm\.", "theorem"),
    (".", r"vs\.", "versus"),
    (".", r"w\.r\.t\.", "with respect to"),
    (".", r"w\.r\.t", "with respect to"),
    (".", r"w\.l\.o\.g\.", "without loss of generality"),
    ("(", r"\((.*?)\)-th", "$1-th"),
    (DIGIT_LAST, r"(\w+)\.(\d+)$", "$1"),
    ("#", r"#+\s+(\d+(\.\d+)*)\s+", "<s>$1</s>"),
    (".", r" et al\.", " et al"),
    ("<", r'<break time="0\.5s"></break>', '<break time="0.5s"/>'),
    ("[", r"\s*\[[0-9,\-, ]+(, pp\. [0-9,\-]+|, p\.\d+f?f?\.?)?\]", ""),
    ("[", r"\s*\[[A-Z][A-Za-z]{0,7}\d{2,4}[a-z]?(?:,\s*(?:[A-Z][A-Za-z]{0,7}\d{2,4}[a-z]?|[^\[\]]{0,30}))*\]", ""),
    ("(", r"\s*\(\d+(?:(?:,\s+|\s*[-–]\s*)\d+)+(, pp\. [0-9,\-]+|, p\.\d+f?f?\.?)?\)", ""),
    ("[", r"\s*\[[^\]]*, \d{4}(?:, [^\]]*, \d{4})*\]", ""),
    ("(", r"\s*\([^)]*, \d{4}(?:[;,] [^)]*, \d{4}[a-zA-Z]*?)*\)", ""),
    ("et al.", r"\s*(\b\w+\s+et al\.) (\[\d{4}\]|\(\d{4}\))", "$1"),
    ("http", r"\s*https?://[\w/:%#$&?()~.=+\-]*[\w\d_\-]", ""),
    ("(", r"\s*\(\s*\)", ""),
    ("[", r"\s*\[\s*\]", ""),
    ("\n", r"\n", ""),
]
# What the desktop dialect has in place of the rules with the same number.
PROSE_DESKTOP = {
    22: (" et al", r" et al.", " et al"),
    24: ("[", r"\s*\[[0-9,, ]+(, pp\. [0-9,\-]+|, p\.\d+[f]?[f]?\.?)?\]", ""),
    26: ("(", r"\s*\([0-9]+(?:[,, ]+[0-9]+)+(, pp\. [0-9,\-]+|, p\.\d+[f]?[f]?\.?)?\)", ""),
}

# The math rules of both dialects, in order; a table of names stands for the commands "\name".
NORM_DOT = [(r"\\lVert\\cdot\\rVert", "norm")]
SUPERSCRIPTS = [
    (r"\^\{-1\}", "inverse"), (r"\^\{\\circ\}", "degrees"), (r"\^\{2\}", "squared"), (r"\^2", "squared"), (r"\^\{3\}", "cubed"), (r"\^3", "cubed"),
    (r"\^\{T\}", "transpose"), (r"\^\{\\prime\}", "prime"), (r"\^\{\*\}", "star"), (r"\^\{n\}", "to the n"), (r"\^\{[+]\}", " "), (r"\^\{([^}]+)\}", r"to the \1"),
]
FRACTIONS = [(r"\\[td]?frac\{([^}]+)\}\{([^}]+)\}", r"\1 over \2"), (r"\\[td]?frac", "over")]
ARITHMETIC = [(r"\+", "plus"), (r"-", "minus"), (r"\*", "multiplied by"), (r"/", "divided by")]
ROOTS = [(r"\\sqrt\{([^}]+)\}", r"square root of \1"), (r"\\sqrt\[3\]\{([^}]+)\}", r"cube root of \1"), (r"\\sqrt\[(\d+)\]\{([^}]+)\}", r"\1-th root of \2")]
# the desktop dialect says a control character in place of the operand of square and cube roots
ROOTS_DESKTOP = [(ROOTS[0][0], "square root of \x01"), (ROOTS[1][0], "cube root of \x01"), ROOTS[2]]
LOGS = [
    (r"\\log_\{([^}]+)\}", r"log base \1 of"), (r"\\log_(\w)", r"log base \1 of"), (r"\blog_\{([^}]+)\}", r"log base \1 of"),
    (r"\\ln", "natural log of"), (r"\\log", "log of"), (r"\\exp", "e to the"),
]
MODULAR = [(r"\\pmod\{([^}]+)\}", r"mod \1"), (r"\\bmod", "mod"), (r"\\mod", "mod"), (r"\\equiv", "is congruent to")]
CALCULUS = {"int": "integral", "prod": "product over", "sum": "summation over", "lim": "limit", "infty": "infinity"}
COMPARISON = [
    (r"\\pm", "plus or minus"), (r"\\times", "times"), (r"\\div", "divided by"), (r"\\cdot", "times"), (r"\\leq", "less than or equal to"),
    (r"\\geq", "greater than or equal to"), (r">", "greater"), (r"<", "less than"), (r"\\neq", "not equal to"), (r"\\approx", "approximately"),
]
RELATIONS_WEB = {"cong": "is isomorphic to", "rtimes": "semidirect product with", "ltimes": "semidirect product with"}
RELATIONS = {"sim": "distributed as", "propto": "proportional to", "odot": "element-wise", "otimes": "tensor product", "oplus": "direct sum"}
LOGIC = {
    "forall": "for all", "ni": "such that", "exists": "there exists", "leftarrow": "gets", "gets": "gets", "rightarrow": "goes to", "Rightarrow": "implies",
    "Leftarrow": "is implied by", "Leftrightarrow": "if and only if", "mapsto": "maps to", "to": "to",
}
NOT_IN_WEB = [(r"\\not\s*\\in", "is not in")]
IN = {"in": "in"}
CAPITALS = ["Gamma", "Delta", "Theta", "Lambda", "Sigma", "Phi", "Psi", "Omega"]
GREEK = {
    "alpha": "alpha", "beta": "beta", "gamma": "gamma", "delta": "delta", "epsilon": "epsilon", "zeta": "zeta", "eta": "eta", "theta": "theta", "iota": "iota",
    "kappa": "kappa", "lambda": "lambda", "mu": "mu", "nu": "nu", "xi": "ksi", "pi": "pi", "rho": "rho", "sigma": "sigma", "tau": "tau", "upsilon": "upsilon", "phi": "phi",
}
TRIG = {"sin": "sine", "cos": "cosine", "tan": "tangent", "cot": "cotangent", "arcsin": "arcsine", "arccos": "arccosine", "arctan": "arctangent"}
SETS = {
    "emptyset": "empty set", "subseteq": "is a subset of or equal to", "superset": "superset", "cup": "union", "cap": "intersection",
    "notin": "is not an element of", "subset": "subset", "setminus": "set minus",
}
SUPPORT = [(r"\\operatorname\{supp\}", "support of")]
DECORATIONS = [
    (r"\\mathbb\{E\}", "expectation"), (r"\\hat\{([^}]+)\}", r"\1 hat"), (r"\\bar\{([^}]+)\}", r"\1 bar"), (r"\\tilde\{([^}]+)\}", r"\1 tilde"),
    (r"\\dot\{([^}]+)\}", r"\1 dot"), (r"\\ddot\{([^}]+)\}", r"\1 double dot"), (r"\\mathcal\{([^}]+)\}", r"\1"), (r"\\mathbb\{([^}]+)\}", r"\1"),
    (r"\\mathbf\{([^}]+)\}", r"\1"), (r"\\lVert", "norm of"), (r"\\rVert", ""), (r"\\langle", ""), (r"\\rangle", ""), (r"\\dots", ""), (r"\\ldots", ""), (r"\\mid", ""),
]
VECTOR = [(r"\\nabla", "gradient of"), (r"\\partial", "partial"), (r"\\operatorname\{([^}]+)\}", r"\1")]
LAYOUT = [
    (r"\\text\{([^}]*)\}", r"\1"), (r"\\textrm\{([^}]*)\}", r"\1"), (r"\\mathrm\{([^}]*)\}", r"\1"), (r"\\tag\{[^}]*\}", ""), (r"\\tag\s*\d+", ""), (r"\\boxed\{([^}]*)\}", r"\1"),
    (r"\\quad", " "), (r"\\qquad", " "), (r"\\,", " "), (r"\\;", " "), (r"\\!", ""), (r"\\begin\{[^}]*\}", ""), (r"\\end\{[^}]*\}", ""),
    (r"\\underbrace\{([^}]*)\}", r"\1"), (r"\\overbrace\{([^}]*)\}", r"\1"), (r"\\overline\{([^}]*)\}", r"\1 bar"),
]
STRIP = [
    (r"\\[Bb]ig[gl]?", ""), (r"\\[Bb]ig[gr]?", ""), (r"\\boldsymbol", ""), (r"\\left(?!arrow)", ""), (r"\\right(?!arrow)", ""),
    (r"\^", ""), (r"\|", ""), (r"\\", ""), (r"_", ""), (r"\{", ""), (r"\}", ""),
]
# The web dialect's rules for nested fractions and roots, applied until nothing changes.
NESTED = [
    (r"\\[td]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\1 over \2"), (r"\\sqrt\s*\[3\]\s*\{([^{}]*)\}", r"cube root of \1"),
    (r"\\sqrt\s*\[(\d+)\]\s*\{([^{}]*)\}", r"\1-th root of \2"), (r"\\sqrt\s*\{([^{}]*)\}", r"square root of \1"),
]

#: Display and inline delimiters in the order of the passes; the desktop dialect knows the first two only.
DELIMITERS = [r"\\\[([\s\S]*?)\\\]", r"\\\(([\s\S]*?)\\\)", r"\$\$([\s\S]*?)\$\$", r"\$([^$\n]+?)\$"]


def _commands(names) -> list[tuple[str, str]]:
    return [(r"\\" + k, v) for k, v in (names.items() if isinstance(names, dict) else ((n, n) for n in names))]


def math_rules(dialect: str = "web") -> list[tuple[str, str]]:
    """The ordered rules; the order of the groups is part of the meaning (short commands match the start of longer ones)."""
    web = dialect == "web"
    return [
        *NORM_DOT, *SUPERSCRIPTS, *FRACTIONS, *ARITHMETIC, *(ROOTS if web else ROOTS_DESKTOP), *LOGS, *MODULAR, *_commands(CALCULUS), *COMPARISON,
        *(_commands(RELATIONS_WEB) if web else []), *_commands(RELATIONS), *_commands(LOGIC), *(NOT_IN_WEB if web else []), *_commands(IN),
        *_commands(CAPITALS), *_commands(GREEK), *_commands(TRIG), *_commands(SETS), *SUPPORT, *DECORATIONS, *VECTOR, *LAYOUT, *STRIP,
    ]


# ---- patterns of one notation for two engines ----

_WEB = {"s": SPACE, "w": "A-Za-z0-9_", "d": "0-9"}
#: A word's edge, before and after it: \\b stands beside a word character in all patterns.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def translated(pattern: str, dialect: str, end: str) -> str:
    """pattern with the classes of its dialect spelled out (web), and $ as the very end of the text."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        pair = pattern[i : i + 2]
        if c == "\\" and dialect == "web" and pair[1] in _WEB:
            out.append(_WEB[pair[1]] if inside else f"[{_WEB[pair[1]]}]")
        elif c == "\\" and dialect == "web" and pair[1] == "b" and not inside:
            out.append(_BEFORE if re.match(r"[A-Za-z(\[]|\\w", pattern[i + 2 :]) else _AFTER)
        elif c == "\\":
            out.append(pair)
        else:
            inside = (inside or c == "[") and c != "]"
            if c == "$" and not inside and i == len(pattern) - 1:
                c = end
            elif c == "." and not inside and dialect == "web":
                c = "[^\\n\\r\u2028\u2029]"
            out.append(c)
            i += 1
            continue
        i += 2
    return "".join(out)


@lru_cache(maxsize=1024)
def compiled(pattern: str, dialect: str = "web") -> re.Pattern:
    """For Python."""
    pattern = pattern.replace(r"[\s\S]", "[\x00-\U0010ffff]")
    return re.compile(translated(pattern, dialect, r"\Z"))


def java(pattern: str, dialect: str = "web") -> str:
    """For the JVM."""
    return ("(?d)" if dialect == "web" else "(?dU)") + translated(pattern, dialect, r"\z")


# ---- notation ----

_LITERAL = re.compile(r"(?:[^\\^$.|?*+()\[\]{}]|\\[^A-Za-z0-9])+\Z")
_HEAD = re.compile(r"(?:[A-Za-z_]|\\[^A-Za-z0-9])+")


def _step(pattern: str, replacement: str, dialect: str):
    """A rule as a function: plain replacement for literal patterns, else the pattern behind a search for the characters it starts with."""
    spoken = f" {replacement} "
    if _LITERAL.match(pattern):
        literal = re.sub(r"\\(.)", r"\1", pattern)
        return lambda s: s.replace(literal, spoken)
    sub, head = compiled(pattern, dialect).sub, _HEAD.match(pattern)
    start = re.sub(r"\\(.)", r"\1", head[0]) if head else ""
    if head and pattern[head.end() : head.end() + 1] in ("?", "*", "{"):  # the last character may be missing
        start = start[:-1]
    return lambda s: sub(spoken, s) if start in s else s


@lru_cache(maxsize=64)
def _speaker(dialect: str, extra: tuple) -> list:
    return [_step(p, r, dialect) for p, r in (*extra, *math_rules(dialect))]


def speak_math(latex: str, dialect: str = "web", extra: tuple = ()) -> str:
    """The spoken form of one expression. ``extra`` rules run before the rest."""
    if dialect == "web" and ("frac" in latex or "sqrt" in latex):  # innermost first, until nothing changes
        before = None
        while before != latex:
            before = latex
            for pattern, replacement in NESTED:
                latex = compiled(pattern, dialect).sub(f" {replacement} ", latex)
    for step in _speaker(dialect, tuple(extra)):
        latex = step(latex)
    return collapse(latex, dialect)


def collapse(text: str, dialect: str = "web") -> str:
    """White space as the dialect knows it to single spaces, none at the ends."""
    return compiled(r"\s+", dialect).sub(" ", text).strip(" ")


def speak_spans(text: str, dialect: str = "web") -> str:
    """text with each math span replaced by its spoken form between spaces."""
    for pattern in DELIMITERS[: 4 if dialect == "web" else 2]:
        text = compiled(pattern, dialect).sub(lambda m: f" {speak_math(m[1], dialect)} ", text)
    return text


def math_column(c: Column, dialect: str = "web") -> Column:
    """speak_math as a vectorised function; nulls stay null."""

    @F.pandas_udf(T.StringType())
    def spoken(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else speak_math(x, dialect))

    return spoken(c)


def spans_column(c: Column, dialect: str = "web") -> Column:
    """speak_spans, run only on rows that hold a delimiter."""

    @F.pandas_udf(T.StringType())
    def spoken(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or ("\\" not in x and "$" not in x) else speak_spans(x, dialect))

    return spoken(c)


# ---- prose ----


def prose_rules(dialect: str = "web", extra: tuple = ()) -> list[tuple[str, str, str]]:
    rules = [PROSE_DESKTOP.get(i, r) if dialect == "desktop" else r for i, r in enumerate(PROSE)]
    return [*rules, *(("", p, r) for p, r in extra)]


def prose(c: Column, dialect: str = "web", extra: tuple = ()) -> Column:
    """The prose rules in order, after deleting asterisks. Runs of rules with one trigger share one test."""
    out = F.replace(c, F.lit("*"), F.lit(""))
    for trigger, group in groupby(prose_rules(dialect, extra), key=lambda r: r[0]):
        chain = _chain([(p, r) for _, p, r in group], dialect)
        out = _guarded(out, trigger, chain) if trigger else chain(out)
    return out


def literal(pattern: str) -> str | None:
    """The text that a pattern without any operator stands for."""
    return re.sub(r"\\(.)", r"\1", pattern) if _LITERAL.match(pattern) else None


def _chain(rules: list[tuple[str, str]], dialect: str):
    def one(c: Column, rule: tuple[str, str]) -> Column:
        plain = literal(rule[0])
        return F.regexp_replace(c, java(rule[0], dialect), rule[1]) if plain is None else F.replace(c, F.lit(plain), F.lit(rule[1]))

    return lambda c: reduce(one, rules, c)


def _guarded(c: Column, trigger: str, chain) -> Column:
    """chain(c) where c holds the trigger. c is named three times, so it is bound first: nested groups would triple the plan each."""
    fires = (lambda x: x.rlike(r"(?U)\d\z")) if trigger == DIGIT_LAST else (lambda x: x.contains(trigger))
    return F.transform(F.array(c), lambda x: F.when(fires(x), chain(x)).otherwise(x))[0]


@lru_cache(maxsize=64)
def _writer(dialect: str, extra: tuple) -> list:
    return [(t, literal(p), compiled(p, dialect).sub, re.sub(r"\$(\d)", r"\\\1", r)) for t, p, r in prose_rules(dialect, extra)]


def prose_text(text: str, dialect: str = "web", extra: tuple = ()) -> str:
    """prose() on a Python text."""
    text = text.replace("*", "")
    for trigger, plain, sub, replacement in _writer(dialect, tuple(extra)):
        if text[-1:].isdigit() if trigger == DIGIT_LAST else trigger in text:
            text = sub(replacement, text) if plain is None else text.replace(plain, replacement)
    return text
