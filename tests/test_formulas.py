"""Formulas: one label for equal arithmetic, the text tier for all that isn't understood."""

import random
from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from verdance.functions import formulas


def labels(spark, texts, strict=False):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r["a"] for r in df.select("i", formulas.label(F.col("x"), strict).alias("a")).orderBy("i").collect()]


def test_equal_spellings_get_one_label(spark):
    same = [
        ["1/2", "\\frac{1}{2}", "0.5", ".50", "\\[ \\frac{2}{4} \\]", "2^{-1}", "1-\\frac{1}{2}", "--1/2", "+0.5"],
        ["2x+x", "3x", "x*3", "x\\cdot 3", "(1+2)x", "6x^2/(2x)", "x+x+x"],
        ["x=1/2", "x = \\frac{1}{2}", "x=0.5"],
        ["\\frac{11}{4} \\log |x+1| + C", "\\frac{11}{4} \\log|{x+1}| + C"],
        ["x^2-1", "(x+1)(x-1)", "-1+x^{2}"], ["-9", "-3^2"], ["9", "(-3)^2"], ["\\frac{\\frac{1}{2}}{3}", "1/6"], ["x\\sqrt{4/2}", "\\sqrt{2}x"], ["0", "x-x", "0x"], ["2^3^0", "2"],
    ]
    got = labels(spark, [x for group in same for x in group])
    at, seen = 0, set()
    for group in same:
        mine = set(got[at : at + len(group)])
        assert len(mine) == 1 and all(x.startswith("sympy:") for x in mine), (group, mine)
        assert not mine & seen
        seen |= mine
        at += len(group)


def test_text_tier(spark):
    texts = ["1/0", "the area is 3", "40^\\circ 20'", "(1", "1)", "1+", "a b c d e", "1=1", "9" * 20, "\\frac12", "\\sin 2x", "x|", "\\unknown{2}", "hence, the required number of words is 24", "this can be simplified to (zx-y)^2", "Let rate = R percent and time = R years. Then the equation holds.", "x" * 301, "9876543210*9876543210", "{1", "1}"]
    got = labels(spark, texts)
    assert all(x.startswith("text:") for x in got), got
    assert labels(spark, ["", None, "\\[ \\]"]) == ["<PARSE_FAILURE>"] * 3
    assert labels(spark, ["hence", "x=3"]) == ["sympy:c*e^2*h*n", "sympy:eq(x, 3)"] and labels(spark, ["hence", "x=3"], strict=True) == ["text:hence", "sympy:eq(x, 3)"]


def test_arithmetic_against_fractions(spark):
    """Random expressions worked out by Python's own fractions."""
    rng = random.Random(2)

    def made(depth):
        if not depth or rng.random() < 0.2:
            n = rng.randint(0, 9)
            return (str(n), Fraction(n)) if rng.random() < 0.7 else (f"{n}.5", Fraction(2 * n + 1, 2))
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        op = rng.choice("+-*/fn")
        if op == "n":
            return f"(-({a}))", -x
        if op in "/f" and y == 0:
            op = "+"
        value = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "f": lambda: x / y}[op]()
        return (f"\\frac{{{a}}}{{{b}}}" if op == "f" else f"({a}){op}({b})"), value

    cases = [made(3) for _ in range(60)]
    got = labels(spark, [t for t, _ in cases])
    assert got == [f"sympy:{v}" for _, v in cases]


@pytest.mark.parametrize("strict", [False, True])
def test_whole_fields(spark, strict):
    """From a field to a label, each different field once; both sides alike."""
    df = spark.createDataFrame([(1, "so $x = \\frac{2}{4}$"), (2, "$x=0.5$"), (3, None), (4, "Option B is right"), (5, "$x=0.5$")], "i int, field string")
    got = {r["i"]: r["label"] for r in formulas.with_label(df, "field", "label", strict).collect()}
    assert got == {1: "sympy:eq(x, 1/2)", 2: "sympy:eq(x, 1/2)", 3: "<parse_failure>", 4: "text:option b", 5: "sympy:eq(x, 1/2)"}
