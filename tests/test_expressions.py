"""Equality of expressions: tables of pairs, random polynomials against evaluation, limits."""

import random
from fractions import Fraction

import pytest

from quern.operators import expressions as E

EQUAL = [("1/2 + x", "(2x+1)/2"), ("\\frac{1}{2}", "0.5"), ("(x+1)^2", "x^2+2x+1"), ("-x^2", "-(x*x)"), ("2(x+y)", "2x + 2y"), ("$1,000$", "1000"), ("x**3/x", "x^2"), ("\\frac{x+1}{2}\\cdot 4", "2x+2"),
         ("(x^2-1)/(x-1)", "x+1"), ("2^{-1}", "1/2"), ("\\dfrac{\\frac{1}{2}}{3}", "1/6"), ("1--1", "2"), ("x/2/3", "x/6"), ("0x", "0"), ("3.", "3"), ("\\left(a+b\\right)c", "ac+bc".replace("ac", "a*c").replace("bc", "b*c"))]
UNEQUAL = [("x", "y"), ("1/3", "0.3333"), ("x^2", "2x"), ("(x+1)^2", "x^2+1"), ("1/0", "1/0"), ("sin(x)", "sin(x)"), ("x=1", "x=1"), ("", ""), ("2 3", "6"), ("x^y", "x^y"), ("(", "("), ("x^999", "x^999"), ("1/(x-x)", "1"), ("\\sqrt{2}", "\\sqrt{2}"), (None, "1")]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert E.equal(a, b) and E.equal(b, a)


@pytest.mark.parametrize(("a", "b"), UNEQUAL)
def test_unequal_or_unreadable(a, b):
    assert not E.equal(a, b)


def grown(rng, depth):
    """A random expression as text and as a function of x and y."""
    if depth == 0 or rng.random() < 0.2:
        n = rng.randrange(1, 6)
        return rng.choice([("x", lambda x, y: x), ("y", lambda x, y: y), (str(n), lambda x, y: Fraction(n))])
    (a, f), (b, g) = grown(rng, depth - 1), grown(rng, depth - 1)
    kind = rng.randrange(4)
    if kind == 0:
        return f"({a})+({b})", lambda x, y: f(x, y) + g(x, y)
    if kind == 1:
        return f"({a}) - ({b})", lambda x, y: f(x, y) - g(x, y)
    if kind == 2:
        return f"({a})({b})", lambda x, y: f(x, y) * g(x, y)
    return f"({a})^2", lambda x, y: f(x, y) ** 2


def test_random_polynomials_against_evaluation():
    rng = random.Random(4)
    made = [grown(rng, 3) for _ in range(120)]
    points = [(Fraction(rng.randrange(-50, 50), 7), Fraction(rng.randrange(-50, 50), 3)) for _ in range(30)]
    values = [[f(x, y) for x, y in points] for _, f in made]
    for i in range(0, 120):
        for j in range(max(0, i - 12), i + 1):
            assert E.equal(made[i][0], made[j][0]) == (values[i] == values[j]), (made[i][0], made[j][0])


def test_limits_end_quickly():
    for text in ("(" * 5000 + "x" + ")" * 5000, "(a+b+c+d+e+f+g+h)^40", "9^40^40", "{" * 300, "\\frac{" * 200, "((((x^40)^40)^40)^40)^40"):
        E.equal(text, text)


def test_columns(spark):
    rows = [(a, b, True) for a, b in EQUAL] + [(a, b, False) for a, b in UNEQUAL if a not in ("sin(x)", "x=1", "(", "x^y", "x^999", "\\sqrt{2}", "1/0", "")] + [("sin(x)", "sin(x)", True), (None, None, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(E.same_value(E.F.col("a"), E.F.col("b")) != E.F.col("want")).collect() == []
