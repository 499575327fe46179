"""Formulas in pages: delimiters, fences on lines of their own, signs that formulas can't show, quotes that are formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions.text import let

#: Spans without prose: fences, code, string props and list props.
LITERALS = r"```[\s\S]*?```|`[^`\n]*`|=\{\"(?:[^\"\\]|\\.)*\"\}|=\{\[[\s\S]*?\]\}"
SPAN = r"\$\$[\s\S]*?\$\$|\$[^$\n]+\$"
#: A line break of a formula, cut in two by a fence that was put between it and its width.
CUT_BREAK = r"\\{2,}[ \t]*\n[ \t]*\n?[ \t]*\$\$[ \t]*\n[ \t]*(\d+(?:\.\d+)?\s*(?:pt|em|ex|mu|mm|cm|in))\][ \t]*\n"
#: Commands that tell a formula, as do grouped exponents and indices.
COMMANDS = [
    "d?frac", "tfrac", "sum", "prod", "int", "oint", "sqrt", "ln", "log", "lim", "sin", "cos", "tan", "cot", "sec", "csc", "left", "right", "dots", "cdots", "ldots", "vdots", "ddots", "rightarrow", "leftarrow", "to",
    "mapsto", "infty", "partial", "nabla", "cdot", "times", "div", "pm", "mp", "leq", "geq", "neq", "approx", "equiv", "sim", "propto", "forall", "exists", "in", "notin", "subset", "cup", "cap", "alpha", "beta", "gamma",
    "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "vartheta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho", "sigma", "tau", "phi", "varphi", "chi", "psi", "omega", "Gamma", "Delta", "Theta",
    "Lambda", "Sigma", "Phi", "Psi", "Omega", "mathbb", "mathcal", "mathrm", "mathbf", "operatorname", "begin", "end",
]
SIGNAL = rf"\\(?:{'|'.join(COMMANDS)})\b|[_^]\{{"
LABEL = r"^(.{1,80}?[:：])\s*(\S[\s\S]*)$"
MARKS = r"[.,;:!?。，；：！？]+$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def shown_signs(span: Column) -> Column:
    """A formula with plain digits for circled ones, single backslashes before commands, no bar that a table would cut at."""
    plain = F.translate(span, "①②③④⑤⑥⑦⑧⑨", "123456789")
    single = F.regexp_replace(F.replace(plain, F.lit("⑩"), F.lit("10")), r"\\\\(?=[A-Za-z ])", r"\\")
    bars = F.regexp_replace(single, r"\\(left|right|bigl|bigr|Bigl|Bigr|big|Big)\|", r"\\$1\\vert")

    def theta(found: Column) -> Column:
        parts = F.split(F.regexp_extract(found, r"\{([^{}]*)\}", 1), "θ", -1)
        return F.array_join(F.transform(parts, lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("\\text{"), p, F.lit("}")))), "\\theta")

    return M.replaced(bars, r"\\text\{[^{}]*θ[^{}]*\}", theta)


def own_lines(part: Column) -> Column:
    """Formulas over several lines with both fences on lines of their own; a part with an odd number of fences as it is."""

    def woven(cut: Column) -> Column:
        n = F.size(cut)
        at = lambda i: F.coalesce(F.get(cut, i), F.lit(""))

        def moved(i: Column) -> Column:
            """Whether piece i is a formula over several lines with a fence that shares its line."""
            inner, before, after = at(i), at(i - 1), at(i + 1)
            begins = before.endswith("\n") | ((before == "") & (i == 1))
            ends = after.startswith("\n") | ((after == "") & (i == n - 2))
            return (i % 2 == 1) & F.contains(inner, F.lit("\n")) & ~(begins & inner.startswith("\n") & inner.rlike(r"\n[ \t]*\z") & ends)

        def piece(text: Column, i: Column) -> Column:
            inside = F.when(moved(i), F.concat(F.lit("\n\n$$\n"), _stripped(text), F.lit("\n$$\n\n"))).otherwise(F.concat(F.lit("$$"), text, F.lit("$$")))
            return F.when(i % 2 == 1, inside).when(moved(i + 1), F.regexp_replace(text, r"[ \t]+\z", "")).otherwise(text)

        return F.when((n > 1) & (n % 2 == 1), F.array_join(F.transform(cut, piece), ""))

    return let(part, lambda p: F.coalesce(let(F.split(p, r"\$\$", -1), woven), p))


def normalised(text: Column | str) -> Column:
    """A page whose formulas can be read: dollar delimiters, whole line breaks, plain signs, fences on lines of their own.

    What stands in code, in string props and in list props stays as it is.
    """
    text = F.col(text) if isinstance(text, str) else text

    def read(given: Column) -> Column:
        whole = F.regexp_replace(M.dollar_delimiters(given), CUT_BREAK, r"\\\\[$1]" + "\n")
        plain = M.outside(whole, LITERALS, lambda part: M.replaced(part, SPAN, shown_signs))
        return F.when(given.isNotNull(), M.outside(plain, LITERALS, own_lines))

    return let(text, read)


def is_formula(text: Column) -> Column:
    """Whether a text is a formula without words: no two letters are left beside its commands and signs."""

    def told(bare: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\\[a-zA-Z]+", " "), r"\\[^a-zA-Z]", " "), r"[{}\[\]()|^_=+\-*/<>~!?.,;:'\"`&%]|\d+", " ")
        return bare.rlike(SIGNAL) & ~F.exists(F.split(rest, r"(?U)\s+"), lambda w: w.rlike(r"^\p{L}{2,}$"))

    return let(_stripped(text), told)


def _dollars(text: Column) -> Column:
    """(shown, any): a formula between dollars with the marks behind it, and whether anything but marks is left of it."""

    def parts(body: Column, marks: Column) -> Column:
        return F.struct(F.concat(F.lit("$"), body, F.lit("$"), marks).alias("shown"), (body != "").alias("any"))

    def read(given: Column, marks: Column) -> Column:
        body = F.when(marks == "", given).otherwise(F.regexp_replace(F.substring(given, F.lit(1), F.length(given) - F.length(marks)), r"(?U)\s+$", ""))
        return let(body, lambda b: parts(b, marks))

    return let(text, lambda given: let(F.regexp_extract(given, f"({MARKS})", 1), lambda marks: read(given, marks)))


def quote_formulas(quote: Column) -> Column:
    """A quote that is a formula, or is one behind a label, with dollars around it; any other as it is, but normalised."""

    def behind(text: Column) -> Column:
        label, rest = F.regexp_extract(text, LABEL, 1), F.regexp_extract(text, LABEL, 2)
        formula = let(rest, lambda r: F.when(is_formula(r), _dollars(_stripped(r))))
        return F.when(text.rlike(LABEL), let(formula, lambda d: F.when(d["any"], F.concat(label, F.lit(" "), d["shown"]))))

    def whole(text: Column) -> Column:
        own = let(_dollars(text), lambda d: F.when(d["any"], d["shown"]).otherwise(text))
        plain = (text == "") | text.rlike(SPAN) | ~text.rlike(SIGNAL)
        return F.when(plain, text).when(is_formula(text), own).otherwise(F.coalesce(behind(text), text))

    return let(normalised(_stripped(quote)), whole)
