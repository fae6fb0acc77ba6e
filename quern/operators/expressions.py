"""Equality of mathematical answers as exact rational functions.

An answer is read into a quotient of two polynomials with rational coefficients, so ``1/2 + x`` and ``(2x+1)/2`` are equal
whatever form they have, without rounding. Reading is a small helper that runs on batches of pairs; what it can't read
(functions, roots, relations, sizes past the limits) has no value, and only the text can then make it equal.
"""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.answers import math_equal

MAX_CHARS, MAX_TERMS, MAX_POWER = 500, 400, 40
PART = re.compile(r"\s*(?:(\d+\.\d*|\.\d+|\d+)|(\*\*|[-+*/^()])|([a-zA-Z]))")

Monomial = tuple[tuple[str, int], ...]
Polynomial = dict[Monomial, Fraction]
ONE: Polynomial = {(): Fraction(1)}


class Unreadable(Exception):
    """The text is no expression that this module reads."""


def _add(a: Polynomial, b: Polynomial, sign: int = 1) -> Polynomial:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return {m: c for m, c in out.items() if c}


def _times(a: Polynomial, b: Polynomial) -> Polynomial:
    if len(a) * len(b) > MAX_TERMS * 50:
        raise Unreadable
    out: Polynomial = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            for v, e in n:
                powers[v] = powers.get(v, 0) + e
            key = tuple(sorted(powers.items()))
            out[key] = out.get(key, Fraction(0)) + c * d
    out = {m: c for m, c in out.items() if c}
    if len(out) > MAX_TERMS or any(abs(c.numerator).bit_length() + c.denominator.bit_length() > 4000 for c in out.values()):
        raise Unreadable
    return out


class Quotient:
    """``top`` over ``bottom``; the bottom is never the zero polynomial."""

    def __init__(self, top: Polynomial, bottom: Polynomial = ONE):
        if not bottom:
            raise Unreadable
        self.top, self.bottom = top, bottom

    def __add__(self, other: Quotient) -> Quotient:
        return Quotient(_add(_times(self.top, other.bottom), _times(other.top, self.bottom)), _times(self.bottom, other.bottom))

    def __mul__(self, other: Quotient) -> Quotient:
        return Quotient(_times(self.top, other.top), _times(self.bottom, other.bottom))

    def __truediv__(self, other: Quotient) -> Quotient:
        return Quotient(_times(self.top, other.bottom), _times(self.bottom, other.top))

    def power(self, other: Quotient) -> Quotient:
        """Whole powers only; a negative one turns the quotient over."""
        if other.bottom.keys() - {()} or other.top.keys() - {()}:
            raise Unreadable
        n = other.top.get((), Fraction(0)) / other.bottom[()]
        if n.denominator != 1 or abs(n) > MAX_POWER:
            raise Unreadable
        base, out = (self if n >= 0 else Quotient(ONE) / self), Quotient(ONE)
        for _ in range(abs(int(n))):
            out = out * base
        return out

    def same(self, other: Quotient) -> bool:
        return not _add(_times(self.top, other.bottom), _times(other.top, self.bottom), -1)


def tidy(text: str) -> str:
    """Without dollar signs, thousands commas and spacing commands; fractions, products and brackets in plain signs."""
    t = text.strip().strip("$").strip().replace("−", "-")
    t = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", t)
    t = re.sub(r"\\(?:left|right|,|;|!)", "", t).replace("\\cdot", "*").replace("\\times", "*")
    return re.sub(r"\\[dt]?frac\s*", "\\\\frac", t)


def _spelled(t: str) -> str:
    """``\\frac{a}{b}`` as a quotient and braces as brackets, from the inside out."""
    inner = re.compile(r"\\frac\{([^{}\\]*)\}\{([^{}\\]*)\}|(?<!\})\{([^{}\\]*)\}(?!\{)")
    for _ in range(60):
        new = inner.sub(lambda m: f"(({m[1]})/({m[2]}))" if m[3] is None else f"({m[3]})", t, count=1)
        if new == t:
            return t
        t = new
    raise Unreadable


def parse(text: str) -> Quotient:
    """The quotient that a text stands for; products may go without a sign, as in ``2x(y+1)``."""
    t = _spelled(tidy(text))
    if not t or len(t) > MAX_CHARS:
        raise Unreadable
    parts: list[tuple[str, str]] = []
    at = 0
    while at < len(t.rstrip()):
        m = PART.match(t, at)
        if not m:
            raise Unreadable
        kind = "number" if m[1] else "sign" if m[2] else "name"
        parts.append((kind, "^" if m[2] == "**" else m[1] or m[2] or m[3]))
        at = m.end()
    if sum(p == ("sign", "(") for p in parts) > 100 or any(a[0] == b[0] == "number" for a, b in zip(parts, parts[1:], strict=False)):
        raise Unreadable
    # two letters in a row could be a function's name, not a product
    if any(a[0] == b[0] == "name" for a, b in zip(parts, parts[1:], strict=False)):
        raise Unreadable
    place = 0

    def peek() -> tuple[str, str]:
        return parts[place] if place < len(parts) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return parts[place - 1]

    def total() -> Quotient:
        out = product()
        while peek() in (("sign", "+"), ("sign", "-")):
            minus = take()[1] == "-"
            term = product()
            out = out + (Quotient({(): Fraction(-1)}) * term if minus else term)
        return out

    def product() -> Quotient:
        out = signed()
        while True:
            if peek() == ("sign", "*"):
                take()
                out = out * signed()
            elif peek() == ("sign", "/"):
                take()
                out = out / signed()
            elif peek()[0] in ("number", "name") or peek() == ("sign", "("):
                out = out * raised()
            else:
                return out

    def signed() -> Quotient:
        minus = False
        while peek() in (("sign", "-"), ("sign", "+")):
            minus ^= take()[1] == "-"
        value = raised()
        return Quotient({(): Fraction(-1)}) * value if minus else value

    def raised() -> Quotient:
        base = atom()
        if peek() == ("sign", "^"):
            take()
            return base.power(signed())
        return base

    def atom() -> Quotient:
        if peek()[0] == "end":
            raise Unreadable
        kind, sign = take()
        if kind == "number":
            value = Fraction(sign if not sign.endswith(".") else sign[:-1])
            return Quotient({(): value} if value else {})
        if kind == "name":
            return Quotient({((sign, 1),): Fraction(1)})
        if sign != "(":
            raise Unreadable
        out = total()
        if peek() != ("sign", ")"):
            raise Unreadable
        take()
        return out

    out = total()
    if place != len(parts):
        raise Unreadable
    return out


def equal(a: str | None, b: str | None) -> bool:
    """Whether both texts can be read and stand for the same rational function."""
    if a is None or b is None:
        return False
    try:
        return parse(a).same(parse(b))
    except (Unreadable, ZeroDivisionError, RecursionError):
        return False


def expressions_equal(a: Column, b: Column) -> Column:
    """``equal`` on columns; null counts as unequal."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([equal(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return run(a, b)


def same_value(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal texts, numbers within the tolerance, or equal expressions."""
    return math_equal(a, b, tolerance) | expressions_equal(a, b)
