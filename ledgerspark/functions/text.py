"""Text expressions (F-01 to F-14). Every function maps columns to columns; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit-of-measure spellings and their canonical forms.
UNITS = {
    "pcs": "pcs", "pc": "pcs", "piece": "pcs", "pieces": "pcs", "each": "each", "ea": "each", "stk": "pcs", "stk.": "pcs",
    "kg": "kg", "kgs": "kg", "g": "g", "m": "m", "mtr": "m", "hrs": "hours", "hr": "hours", "hours": "hours",
    "box": "box", "boxes": "box", "set": "set", "sets": "set",
}
# Currency spellings in the order in which they are tried as substrings.
CURRENCIES = {
    "$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "usd": "USD", "eur": "EUR",
    "gbp": "GBP", "jpy": "JPY", "¥": "JPY", "c$": "CAD", "cad": "CAD", "a$": "AUD", "aud": "AUD", "chf": "CHF",
}
# Currencies that validation recognises.
RECOGNISED_CURRENCIES = [
    "USD", "EUR", "GBP", "INR", "CAD", "AUD", "JPY", "CHF", "SGD", "CNY", "SEK", "NZD", "HKD", "NOK", "KRW", "MXN", "BRL", "ZAR",
    "AED", "SAR", "DKK", "PLN", "THB", "IDR", "HUF", "CZK", "ILS", "CLP", "PHP", "TRY", "TWD", "MYR",
    "$", "€", "£", "₹", "¥", "₩", "₪", "฿", "R$", "KR",
]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A CASE over a fixed table."""
    items = iter(table.items())
    k, v = next(items)
    out = F.when(key == k, v)
    for k, v in items:
        out = out.when(key == k, v)
    return out if default is None else out.otherwise(default)


def normalize_whitespace(text: Column) -> Column:
    """F-01: no-break spaces become spaces, runs collapse, ends are trimmed; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.translate(text, "  ", "  "), r"(?U)\s+", " ")), F.lit(""))


def normalize_unit(unit: Column) -> Column:
    """F-05: canonical unit, unknown ones in lower case."""
    clean = F.lower(normalize_whitespace(unit))
    return F.when(clean != "", lookup(clean, UNITS, clean))


def normalize_currency(value: Column) -> Column:
    """F-06: exact spelling, then the first spelling contained, then any three letters."""
    clean = F.trim(value)
    low = F.lower(clean)
    out = lookup(low, CURRENCIES)
    for symbol, code in CURRENCIES.items():
        out = out.when(F.contains(low, F.lit(symbol)), code)
    out = out.when(clean.rlike(r"^(?U)\p{L}{3}$"), F.upper(clean))
    return F.when(F.length(value) > 0, out)


def recognised_currency(value: Column) -> Column:
    """F-07."""
    return F.upper(F.trim(value)).isin(RECOGNISED_CURRENCIES)


def clean_code(value: Column) -> Column:
    """F-09: trailing punctuation goes."""
    return F.regexp_replace(F.trim(value), r"[.,;:]+$", "")


def contains_term(text: Column, term: str, lowered: bool = False) -> Column:
    """F-03: terms of up to three letters need word boundaries, longer ones may stand anywhere; ``lowered``: the text is in lower case."""
    low, term = text if lowered else F.lower(text), term.lower()
    if len(term) <= 3:
        return F.contains(low, F.lit(term)) & low.rlike(r"\b" + _quoted(term) + r"\b")
    return F.contains(low, F.lit(term))


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def some_word(words: Iterable[str]) -> str:
    """A pattern that finds whether a text holds any of the words, anywhere: those that hold another are left out, the others share their first letters."""
    kept: list[str] = []
    for w in sorted(set(words), key=len):
        if not any(k in w for k in kept):
            kept.append(w)
    letters = sorted({w[0] for w in kept})
    return "|".join(_quoted(c) + "(?:" + "|".join(_quoted(w[1:]) for w in sorted(kept) if w[0] == c) + ")" for c in letters)


def word_set(text: Column) -> Column:
    """F-13: distinct lower-case words of letters, digits and apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)))


def snippet(text: Column, size: int = 300) -> Column:
    """F-14."""
    return F.substring(F.trim(text), 1, size)


def like(column: Column, fragment: str) -> Column:
    """P-01: case-insensitive substring; ``%`` and ``_`` in the fragment act as wildcards."""
    return F.ilike(column, F.lit(f"%{fragment}%"))
