"""The rewriting rules and their results once more, for the SQL side: stated apart from the engine's tables.

Prose is restated as patterns of the other engine (RE2); notation as pairs of an expression
and the spoken form expected of it, written by hand.
"""

from __future__ import annotations

#: White space as the web dialect has it.
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# The prose rules in order.
PROSE = [
    (r"\*", ""), (r"i\.e\.", "that is"), (r"e\.g\.", "for example"), (r"e\. g\.", "for example"),
    (r"i\.i\.d\.?", "independent and identically distributed"), (r"\b[iI][iI][dD]\b", "independent and identically distributed"),
    (r"Eq\.", "Equation"), (r"eq\.", "equation"), (r"Fig\.", "Figure"), (r"fig\.", "figure"), (r"Sec\.", "Section"), (r"sec\.", "section"),
    (r"Tab\.", "Table"), (r"tab\.", "table"), (r"Thm\.", "Theorem"), (r"thm\.", "theorem"), (r"vs\.", "versus"),
    (r"w\.r\.t\.", "with respect to"), (r"w\.r\.t", "with respect to"), (r"w\.l\.o\.g\.", "without loss of generality"),
    (r"\((.*?)\)-th", r"\1-th"), (r"(\w+)\.(\d+)$", r"\1"), (r"#+~+(\d+(?:\.\d+)*)~+", r"<s>\1</s>"), (r" et al\.", " et al"),
    (r'<break time="0\.5s"></break>', '<break time="0.5s"/>'), (r"~*\[[0-9, -]+(?:, pp\. [0-9,-]+|, p\.\d+f?f?\.?)?\]", ""),
    (r"~*\[[A-Z][A-Za-z]{0,7}\d{2,4}[a-z]?(?:,~*(?:[A-Z][A-Za-z]{0,7}\d{2,4}[a-z]?|[^\[\]]{0,30}))*\]", ""),
    (r"~*\(\d+(?:(?:,~+|~*[-–]~*)\d+)+(?:, pp\. [0-9,-]+|, p\.\d+f?f?\.?)?\)", ""), (r"~*\[[^\]]*, \d{4}(?:, [^\]]*, \d{4})*\]", ""),
    (r"~*\([^)]*, \d{4}(?:[;,] [^)]*, \d{4}[a-zA-Z]*?)*\)", ""), (r"~*(\b\w+~+et al\.) (?:\[\d{4}\]|\(\d{4}\))", r"\1"),
    (r"~*https?://[\w/:%#$&?()~.=+-]*[\w-]".replace("()~.", "()\\x7e."), ""), (r"~*\(~*\)", ""), (r"~*\[~*\]", ""), (r"\n", ""),
]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prose_sql(column: str) -> str:
    out = column
    for pattern, replacement in PROSE:
        out = f"regexp_replace({out}, {quoted(pattern.replace('~', SPACE))}, {quoted(replacement)}, 'g')"
    return out


#: Clauses that give the prose rules work, and what the rules make of them at the end of a text.
CLAUSES = [
    (" see Fig. 3 vs. Eq. 2, e.g. [1, 2] i.i.d. data here", " see Figure 3 versus Equation 2, for example independent and identically distributed data here"),
    (" as shown (Smith et al., 2020) w.r.t. x [Bau69].", " as shown with respect to x."),
    (" at https://example.com/a?b=c. and () or [] (1, 2) x", " at. and or x"),
    (" the (k+1)-th seq. of tab. 4, i.e. w.l.o.g. word.12", " the k+1-th sequation of table 4, that is without loss of generality word"),
    (" ## 1.2 Title * bold * iid [Doe, 1999] y", " <s>1.2</s>Title  bold  independent and identically distributed y"),
    (" BG(1,2) (3 - 5) [NB22a, Section 3] [7-9, pp. 3-4] z", " BG(1,2) z"),
    (' <break time="0.5s"></break> sec. 1 Sec. 2 thm. 3 Thm. 4 fig. 5 eq. 6 Tab. 7 w', ' <break time="0.5s"/> section 1 Section 2 theorem 3 Theorem 4 figure 5 equation 6 Table 7 w'),
    (" (Roe, 1998; Poe, 1999b) e. g. w.r.t y by X et al. (2020) and all", " for example with respect to y by X et al (2020) and all"),
    (" plain", " plain"),
]


def case_sql(column: str, values: list[str]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


#: Expressions and their spoken forms; @n and @k stand for numbers.
NOTATION = [
    (r"\frac{@n}{\sqrt{x_@k}}", "@n over square root of x @k"),
    (r"x^2 + y^{a@n} \leq \alpha", "x squared plus y to the a@n less than or equal to alpha"),
    (r"\sum_{i=1}^n \log_7 \hat{y}", "summation over i=1 n log base 7 of y hat"),
    (r"\forall x \in \mathbb{R}, \lVert x \rVert \geq @n", "for all x in R , norm of x greater than or equal to @n"),
    (r"\left( a \rightarrow b \right) \cdots @k", "( a goes to b ) times s @k"),
    (r"\nabla f \cdot \text{per-unit} @n", "gradient of f times per minus unit @n"),
    (r"A \cup B \subseteq C_{@n}", "A union B is a subset of or equal to C @n"),
    (r"\sin \theta \times \sqrt[3]{@n} \pmod{@k}", "sine theta times cube root of @n mod @k"),
    (r"G \cong H \rtimes K, x \not\in @n", "G is isomorphic to H semidirect product with K, x is not in @n"),
    (r"A^{-1} B^{T} C^{\circ} N \ltimes M", "A inverse B transpose C degrees N semidirect product with M"),
    (r"x \notin A \subset B \superset C \setminus \emptyset", "x is not an element of A subset B superset C set minus empty set"),
    (r"\arcsin x \arccos y \arctan z \cot w \tan v \cos u", "arcsine x arccosine y arctangent z cotangent w tangent v cosine u"),
    (r"a \Leftarrow b \Leftrightarrow c \Rightarrow d \leftarrow e \gets f", "a is implied by b if and only if c implies d gets e gets f"),
    (r"f : A \to B, x \mapsto y, \exists z \ni w", "f : A to B, x maps to y, there exists z such that w"),
    (r"\lim_{n \to \infty} \int f \prod g", "limit n to infinity integral f product over g"),
    (r"5 \equiv 2 \bmod 3 \mod 4", "5 is congruent to 2 mod 3 mod 4"),
    (r"a \pm b \div c \neq d \approx e", "a plus or minus b divided by c not equal to d approximately e"),
    (r"X \sim N \propto Y \odot Z \otimes V \oplus W", "X distributed as N proportional to Y element-wise Z tensor product V direct sum W"),
    (r"\Gamma \Delta \Theta \Lambda \Sigma \Phi \Psi \Omega", "Gamma Delta Theta Lambda Sigma Phi Psi Omega"),
    (r"\alpha \beta \gamma \delta \epsilon \zeta \eta \theta \iota \kappa", "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (r"\lambda \mu \nu \xi \pi \rho \sigma \tau \upsilon \phi \chi \omega \varepsilon", "lambda mu nu ksi pi rho sigma tau upsilon phi chi omega varepsilon"),
    (r"\bar{x} \tilde{y} \dot{z} \ddot{w} \overline{AB}", "x bar y tilde z dot w double dot AB bar"),
    (r"\mathcal{F} \mathbb{E} \mathbf{v} \operatorname{supp} \operatorname{rank}", "F expectation v support of rank"),
    (r"\langle x, y \rangle \mid z \dots \ldots w", "x, y z w"),
    (r"\begin{array}{cc} a & b \\ c & d \end{array}", "cc a & b c & d"),
    (r"x = 1 \tag{@n} \boxed{y} \quad z \, w \; v \! u \tag 3", "x = 1 y z w v u"),
    (r"\bigl( x \bigr) \Big| y \boldsymbol z", "( x r) y z"),
    (r"\underbrace{a+b}_{n} \overbrace{c} \mathrm{d} \textrm{e}", "a plus b n c d e"),
    (r"2 > 1 < 3 * 4 / 5 - @n", "2 greater 1 less than 3 multiplied by 4 divided by 5 minus @n"),
    (r"x^3 y^{3} z^2 w^{2} v^{n} u^{*} t^{\prime} s^{+}", "x cubed y cubed z squared w squared v to the n u star t prime s"),
    (r"\ln x \log y \exp z \log_{10} w log_{b} v", "natural log of x log of y e to the z log base 10 of w log base b of v"),
    (r"\frac{a}{\frac{b}{c}}", "a over b over c"),
    (r"\sqrt[1@n]{x}", "1@n minus th root of x"),
    (r"e^{i\pi} = -1", "e to the i pi = minus 1"),
    (r"\partial f \cap g \cup h \simeq \leqslant", "partial f intersection g union h distributed as eq less than or equal to slant"),
    (r"\lVert\cdot\rVert x^23 \top \sinh", "norm x squared 3 to p sine h"),
]
#: Where the desktop dialect says something else.
NOTATION_DESKTOP = [
    (r"\sqrt{@n} + 1", "square root of \x01 plus 1"),
    (r"\sqrt[3]{x} \sqrt[1@n]{x}", "cube root of \x01 1@n-th root of x"),
    (r"\frac{a}{\frac{b}{c}}", "a over over b c"),
    (r"G \cong H \rtimes K", "G cong H rtimes K"),
    (r"x \not\in @n", "x not in @n"),
    (r"\frac{@n}{b} \leq x^{T}", "@n over b less than or equal to x transpose"),
]
CLAUSES_DESKTOP = [
    (" x [1-3] y (1,2) z", " x [1-3] y z"), (" by A et al, and B et al. too", " by A et al and B et al too"), (" [1, 2] (3, 4) as Fig. 1", " as Figure 1"), (" plain", " plain"),
]
#: Texts with notation in them.
SPANS = [
    (r"let $x \leq @n$ hold", "let  x less than or equal to @n  hold"),
    (r"so \(a^2\) and \[b + c\] end", "so  a squared  and  b plus c  end"),
    (r"$$\frac{1}{2}$$ of it costs 5$", " 1 over 2  of it costs 5$"),
    ("none at all", "none at all"),
]


def filled(values: list[str], n: str, k: str, number: str = "CAST({} AS VARCHAR)") -> list[str]:
    """SQL expressions for texts with @n and @k."""
    return [f"replace(replace({quoted(v)}, '@n', {number.format(n)}), '@k', {number.format(k)})" for v in values]


def choice(column: str, expressions: list[str]) -> str:
    return f"CASE {column} % {len(expressions)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(expressions)) + " END"
