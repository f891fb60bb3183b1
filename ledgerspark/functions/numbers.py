"""Number expressions (F-20 to F-30, A-09). Three parsers with three behaviours, kept apart on purpose."""

from __future__ import annotations

import ast
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.text import normalize_whitespace, once

# Standard tax rates.
TAX_RATES = [0.0, 0.05, 0.06, 0.07, 0.077, 0.08, 0.081, 0.10, 0.12, 0.13, 0.14, 0.15, 0.18, 0.19, 0.20, 0.21, 0.22, 0.23, 0.24, 0.25, 0.27]
# Rates that stand for themselves without a percent sign.
DIRECT_RATES = [0.0, 0.05, 0.07, 0.08, 0.10, 0.12, 0.15, 0.18, 0.19, 0.20, 0.21, 0.22, 0.23, 0.24, 0.25, 0.27]


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def parse_numeric(value: Column) -> Column:
    """F-20: a number in European or American spelling, as double rounded to 4 places; null where there is none.

    The last of two kinds of separators is the decimal one; a single comma is always decimal, several
    commas or dots are thousands unless the last group of dots has one or two digits.
    """
    # each step is computed once a row: the spelling decides which of a few plain forms is cast
    bare = F.regexp_replace(normalize_whitespace(value), r"^[A-Za-z$€£¥\s:]+(\.\s*)?", "")
    digits = F.trim(F.regexp_replace(bare, r"[^\d.,\-\s]", ""))
    joined = F.regexp_replace(F.regexp_replace(digits, r"\.,|,\.", ","), r"(?<=\d)\s+(?=\d)", "")
    led = F.regexp_replace(joined, r"^(-?)([.,])", "$10$2")
    return once(led, _plain_number)


def _plain_number(led: Column) -> Column:
    def form(n: Column) -> Column:
        commas, dots = n["commas"], n["dots"]
        plain = (
            F.when((commas > 0) & (dots > 0), F.when(led.rlike(r"\.[^,]*$"), F.translate(led, ",", "")).otherwise(F.translate(led, ",.", ".")))
            .when(commas == 1, F.translate(led, ",", "."))
            .when(commas > 1, F.translate(led, ",", ""))
            .when((dots > 1) & led.rlike(r"\.[^.]{1,2}$"), F.regexp_replace(led, r"\.(?=.*\.)", ""))
            .when(dots > 1, F.translate(led, ".", ""))
            .otherwise(led)
        )
        return F.round(plain.try_cast("double"), 4)

    counts = F.struct(_occurrences(led, ",").alias("commas"), _occurrences(led, ".").alias("dots"))
    return F.when(~led.isin("", "-"), once(counts, form))


def normalize_amount(value: Column) -> Column:
    """F-21: a plain number as text; whole numbers keep two places only where they were written."""
    raw = F.trim(value)

    def written(n: Column) -> Column:
        whole, two = F.format_string("%d", n.cast("long")), F.format_string("%.2f", n)
        return F.when(n.isNull(), F.lit(None)).when(raw.rlike(r"[.,]00$"), two).when((n == F.floor(n)) & ~raw.rlike(r"[.,]0$"), whole).otherwise(two)

    return once(parse_numeric(value), written)


def stored_decimal(value: Column) -> Column:
    """F-22: digits, points and signs only, half-even to 2 places; what this makes of ``1.394,67`` is 1.39."""
    return F.bround(F.regexp_replace(value, r"[^0-9.\-]", "").try_cast("decimal(38,10)"), 2).cast("decimal(15,2)")


def strict_decimal(value: Column) -> Column:
    """F-23: commas and percent signs go, the rest must be a number."""
    return F.regexp_replace(F.trim(value), "[,%]", "").try_cast("decimal(38,10)")


def tax_rate(value: Column, net: Column | None = None, gross: Column | None = None) -> Column:
    """F-25: a rate as fraction: a percentage, a standard rate, or what net and gross imply if the digits agree."""
    def rate(x: Column) -> Column:
        raw, n = x["raw"], x["n"]
        out = F.when(raw == "", F.lit(None).cast("double")).when(F.contains(raw, F.lit("%")) & n.isNotNull(), F.round(F.when(n > 1, n / 100).otherwise(n), 4))
        out = out.when(n.isin(DIRECT_RATES), n).when(n.isin([r * 100 for r in DIRECT_RATES]), F.round(n / 100, 4))
        if net is None or gross is None:
            return out
        implied = (gross - net) / net
        nearest = F.array_min(F.array(*[F.struct(F.abs(F.lit(r) - implied).alias("off"), F.lit(r).alias("rate")) for r in TAX_RATES]))
        implies = once(nearest, lambda t: F.when((t["off"] <= 0.005) & raw.startswith(F.round(t["rate"] * 100).cast("int").cast("string")), t["rate"]))
        return out.when((net > 0) & (gross >= net), implies)

    raw = normalize_whitespace(value)
    # a percent sign is no part of a number, so that one reading serves both spellings
    return once(F.struct(raw.alias("raw"), parse_numeric(F.replace(raw, F.lit("%"), F.lit(""))).alias("n")), rate)


def percentage(value: Column) -> Column:
    """F-28: "2%", 2 and 0.02 all mean two percent; bare fractions count as such up to 0.20."""
    n = F.replace(F.trim(value), F.lit("%"), F.lit("")).try_cast("decimal(18,6)")
    return F.when(~F.contains(value, F.lit("%")) & (n > 0) & (n <= 0.20), n * 100).otherwise(n)


def discount(gross: Column, percent: Column) -> Column:
    """F-27: half-up to 2 places."""
    return F.round(gross.cast("decimal(18,4)") * percent.cast("decimal(9,6)") / 100, 2).cast("decimal(18,2)")


def within(a: Column, b: Column, tolerance: float) -> Column:
    """F-30: absolute tolerance; null if either is missing."""
    return F.abs(a - b) <= F.lit(tolerance)


def evaluate(expression: str) -> str:
    """F-26: ``+ - * / ( )`` over decimals, half-up to 2 places; anything else raises ValueError."""

    def walk(node: ast.AST) -> Decimal:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return Decimal(str(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return walk(node.operand) if isinstance(node.op, ast.UAdd) else -walk(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div() if b:
                    return a / b
        raise ValueError(f"not an arithmetic expression: {expression!r}")

    try:
        return str(walk(ast.parse(expression, mode="eval")).quantize(Decimal("0.01"), ROUND_HALF_UP))
    except SyntaxError as e:
        raise ValueError(f"not an arithmetic expression: {expression!r}") from e


def evaluate_column(text: Column) -> Column:
    """F-26 for a column: sums of products over plain numbers (no brackets, which ``evaluate`` takes), half-up to 2 places; null for anything else.

    A text is cut into signed terms, a term into factors; a division by zero gives null.
    """
    bare = F.regexp_replace(text, r"\s+", "")
    number = r"\d+(?:\.\d+)?"
    shaped = bare.rlike(rf"^[+-]?{number}(?:[*/][+-]?{number}|[+-]{number})*$")
    terms = F.regexp_extract_all(bare, F.lit(rf"[+-]?{number}(?:[*/][+-]?{number})*"), F.lit(0))

    def product(term: Column) -> Column:
        parts = F.regexp_extract_all(term, F.lit(rf"[*/]?[+-]?{number}"), F.lit(0))
        value = lambda p: F.regexp_replace(p, "^[*/]", "").try_cast("double")
        return F.aggregate(parts, F.lit(1.0), lambda s, p: F.when(p.startswith("/"), F.try_divide(s, value(p))).otherwise(s * value(p)))

    total = F.aggregate(F.transform(terms, product), F.lit(0.0), lambda s, v: s + v)
    return F.when(shaped, F.round(total.cast("decimal(28,10)"), 2).cast("decimal(28,2)"))
