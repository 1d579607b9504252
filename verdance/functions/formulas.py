r"""Formulas as column expressions: a normal form in which equal arithmetic gets one label.

A cleaned answer becomes tokens; LaTeX fractions and braces become parentheses; products that are only implied and signs become
operators; one fold over the tokens (a stack of operators, a list of output) puts them in postfix order, and a second fold
(a stack of values) works that out. A value is a sum of terms: a fraction in lowest terms times powers of symbols; so
1/2, \frac{1}{2} and 0.5 are one value, as are 2x + x and 3x. What has no such form (roots, functions, sums below a bar, powers that
aren't small whole numbers) is a symbol named by its own parts' normal forms. No step leaves SQL functions.

Anything that isn't understood to its end gives null, and so the text tier: other characters or commands, parentheses that
don't close, a missing operand, division by zero, numbers beyond 64 bits, values of over TERMS terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# The format's guards, its functions and its plain names of commands.
MAX_LENGTH = 300
MAX_SYMBOLS = 4
WORD = r"(?<![\\A-Za-z])[A-Za-z]{3,}"
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp", "sqrt")
COMMANDS = {"times": "*", "cdot": "*", "div": "/", "pi": "pi", "theta": "theta", "alpha": "alpha", "beta": "beta", "lambda": "lambda", "mu": "mu", "infty": "oo"}
TOKENS = r"\d+(?:\.\d+)?|\.\d+|\\[a-z]+|[a-z]|[-+*/^=(){}|]"

TERMS, MOST_POWER = 64, 9
_MONO = "array<struct<v: string, e: bigint>>"
_TERM = f"struct<m: {_MONO}, n: bigint, d: bigint>"
_SUM = f"array<{_TERM}>"
_PRECEDENCE = {"=": 0, "+": 1, "-": 1, "*": 2, "/": 2, "~": 3, "^": 4}


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last(stack: Column, back: int = 1) -> Column:
    return F.get(stack, F.size(stack) - back)


# ---- fractions, terms, sums ----


def _gcd(a: Column, b: Column) -> Column:
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["a"])  # 64-bit numbers take at most 90 steps


def _term(m: Column, n: Column, d: Column) -> Column:
    """In lowest terms, the sign above."""
    whole = lambda x, g: F.call_function("div", x, F.greatest(g, F.lit(1)))
    made = lambda g: F.struct(m.alias("m"), (whole(n, g) * F.signum(d).cast("bigint")).alias("n"), whole(F.abs(d), g).alias("d"))
    return F.when(n.isNotNull() & (d == 1), F.struct(m.alias("m"), n.alias("n"), d.alias("d"))).when(n.isNotNull() & d.isNotNull() & (d != 0), _let(_gcd(n, d), made))


def _number(digits: Column) -> Column:
    """Decimals as fractions."""
    places = F.length(F.regexp_extract(digits, r"\.(\d*)", 1))
    plain = F.regexp_replace(digits, r"\.", "")
    ok = (F.length(plain) <= 17) & (places <= 17)
    return F.when(ok, F.array(_term(F.array().cast(_MONO), plain.cast("bigint"), F.rpad(F.lit("1"), places + 1, "0").cast("bigint"))))


def _symbol(name: Column) -> Column:
    return F.array(F.struct(F.array(F.struct(name.alias("v"), F.lit(1).cast("bigint").alias("e"))).alias("m"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d")))


def _product(parts: Column) -> Column:
    """A product's symbols, each once, in order, with their powers."""
    power = lambda v: F.aggregate(F.filter(parts, lambda p: p["v"] == v), F.lit(0).cast("bigint"), lambda s, p: s + p["e"])
    names = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["v"])))
    return F.filter(F.transform(names, lambda v: F.struct(v.alias("v"), power(v).alias("e"))), lambda p: p["e"] != 0)


def _whole(terms: Column) -> Column:
    """Like terms together, none that is zero; null if a number got too large."""
    plus = lambda s, t: _term(s["m"], F.try_add(F.try_multiply(s["n"], t["d"]), F.try_multiply(t["n"], s["d"])), F.try_multiply(s["d"], t["d"]))
    none = lambda m: F.struct(m.alias("m"), F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d"))
    total = lambda m: F.aggregate(F.filter(terms, lambda t: t["m"] == m), none(m), plus)
    sums = F.transform(F.array_distinct(F.transform(terms, lambda t: t["m"])), total)
    sound = F.forall(terms, lambda t: t.isNotNull() & t["n"].isNotNull()) & (F.size(terms) <= TERMS)
    return _let(F.when(sound, sums), lambda x: F.when(F.forall(x, lambda t: t["n"].isNotNull()), F.filter(x, lambda t: t["n"] != 0)))


def _add(a: Column, b: Column) -> Column:
    return _whole(F.concat(a, b))


def _negative(a: Column) -> Column:
    return F.transform(a, lambda t: t.withField("n", F.negative(t["n"])))


def _times(a: Column, b: Column) -> Column:
    of = lambda x, y: _term(_product(F.concat(x["m"], y["m"])), F.try_multiply(x["n"], y["n"]), F.try_multiply(x["d"], y["d"]))
    return _whole(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: of(x, y)))))


def _inverse(a: Column) -> Column:
    one = F.get(a, F.lit(0))
    turned = _term(F.transform(one["m"], lambda p: F.struct(p["v"].alias("v"), F.negative(p["e"]).alias("e"))), one["d"], one["n"])
    below = F.array(F.struct(F.array(F.struct(F.concat(F.lit("("), shown(a), F.lit(")")).alias("v"), F.lit(-1).cast("bigint").alias("e"))).alias("m"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d")))
    return F.when(F.size(a) == 1, F.array(turned)).when(F.size(a) > 1, below)


def _power(a: Column, b: Column) -> Column:
    k = F.when(F.size(b) == 0, F.lit(0).cast("bigint")).when((F.size(b) == 1) & (F.size(F.get(b, F.lit(0))["m"]) == 0) & (F.get(b, F.lit(0))["d"] == 1), F.get(b, F.lit(0))["n"])
    one = F.array(F.struct(F.array().cast(_MONO).alias("m"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d")))
    steps = F.when(k == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), F.abs(k)))
    raised = _let(F.aggregate(steps, one, lambda s, _: _times(s, a)), lambda x: F.when(k < 0, _inverse(x)).otherwise(x))
    named = _symbol(F.concat(F.lit("("), shown(a), F.lit(")^("), shown(b), F.lit(")")))
    return F.when((k == 0) & (F.size(a) == 0), None).when(F.abs(k) <= MOST_POWER, raised).otherwise(named)


def shown(a: Column) -> Column:
    """A sum's text: its terms in order of their symbols, numbers first."""
    power = lambda p: F.when(p["e"] == 1, p["v"]).otherwise(F.concat(p["v"], F.lit("^"), p["e"].cast("string")))
    symbols = lambda t: F.array_join(F.transform(t["m"], power), "*")
    number = lambda t: F.concat(t["n"].cast("string"), F.when(t["d"] != 1, F.concat(F.lit("/"), t["d"].cast("string"))).otherwise(""))
    term = lambda t: F.when(F.size(t["m"]) == 0, number(t)).when((t["n"] == 1) & (t["d"] == 1), symbols(t)).when((t["n"] == -1) & (t["d"] == 1), F.concat(F.lit("-"), symbols(t))).otherwise(F.concat(number(t), F.lit("*"), symbols(t)))
    ordered = F.array_sort(F.transform(a, lambda t: F.struct(symbols(t).alias("s"), term(t).alias("t"))))
    return F.when(F.size(a) == 0, "0").otherwise(F.array_join(F.transform(ordered, lambda x: x["t"]), " + "))


# ---- from text to postfix ----


def _plain(token: Column) -> Column:
    """A command's plain name: an operator, a symbol or a function (with @ before it); null if it isn't known."""
    name = F.substring(token, 2, 100)
    known = F.coalesce(*(F.when(name == k, v) for k, v in COMMANDS.items()), *(F.when(name == f, f"@{f}") for f in FUNCTIONS))
    return F.when(token.startswith("\\"), known).otherwise(token)


def _bracketed(tokens: Column) -> Column:
    r"""Braces as parentheses, bars as calls of abs, \frac{a}{b} as ((a)/(b)). Null tokens stand for what can't be read."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("open"), F.lit("").alias("next"))

    def step(s, t):
        kind, before = _last(s["open"]), _last(s["out"])
        starts = before.isNull() | before.isin("(", *_PRECEDENCE) | before.startswith("@")  # where a value may begin
        put = lambda *x: F.concat(s["out"], F.array(*(F.lit(i) if isinstance(i, str) or i is None else i for i in x)).cast("array<string>"))
        state = lambda out, open_, then: F.struct(out.alias("out"), open_.alias("open"), F.lit(then).alias("next"))
        shut = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        return (
            F.when((s["next"] != "") & (t != "{"), state(put(None), s["open"], "")).when(t == "\\frac", state(put("("), s["open"], "above"))
            .when(t == "{", F.struct(put("(").alias("out"), F.array_append(s["open"], F.when(s["next"] == "", "plain").otherwise(s["next"])).alias("open"), F.lit("").alias("next")))
            .when((t == "}") & (kind == "above"), state(put(")", "/"), shut, "below")).when((t == "}") & (kind == "below"), state(put(")", ")"), shut, "")).when((t == "}") & (kind == "plain"), state(put(")"), shut, ""))
            .when((t == "|") & (kind == "bar") & ~starts, state(put(")"), shut, "")).when((t == "|") & starts, F.struct(put("@abs", "(").alias("out"), F.array_append(s["open"], F.lit("bar")).alias("open"), F.lit("").alias("next")))
            .when(t.isin("}", "|"), state(put(None), s["open"], "")).otherwise(F.struct(F.array_append(s["out"], _plain(t)).alias("out"), s["open"].alias("open"), s["next"].alias("next")))
        )

    return F.aggregate(tokens, start, step, lambda s: F.when((F.size(s["open"]) == 0) & (s["next"] == "") & F.forall(s["out"], lambda x: x.isNotNull()), s["out"]))


def _operators(tokens: Column) -> Column:
    """Signs as ~ (a plus before a value goes), and * where a product is only implied."""
    is_op = lambda t: t.isin(*_PRECEDENCE)

    def at(t, i):
        before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
        opens = before.isNull() | (before == "(") | is_op(before)
        implied = ~opens & ~before.startswith("@") & ((t == "(") | ~(is_op(t) | (t == ")")))
        # a function's argument stands in parentheses, or alone
        unread = before.startswith("@") & ~((t == "(") | (t.startswith("@"))) & (is_op(t) | (after.isNotNull() & ~after.isin("+", "-", "=", ")")))
        return F.when(unread, F.array(F.lit(None).cast("string"))).when((t == "-") & opens, F.array(F.lit("~"))).when((t == "+") & opens, F.array().cast("array<string>")).when(implied, F.array(F.lit("*"), t)).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, at))


def _postfix(tokens: Column) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("ops"), F.lit(True).alias("ok"))
    rank = lambda t: F.coalesce(*(F.when(t == k, v) for k, v in _PRECEDENCE.items()), F.lit(9))  # noqa: E731  functions bind closest

    def step(s, t):
        ops = s["ops"]
        place = lambda stops: F.coalesce(F.array_max(F.transform(ops, lambda x, i: F.when(stops(x), i + 1).otherwise(0))), F.lit(0))
        popped = lambda k: F.reverse(F.slice(ops, k + 1, F.size(ops)))
        state = lambda out, left, ok=True: F.struct(out.alias("out"), left.alias("ops"), (s["ok"] & F.lit(ok)).alias("ok"))
        opener = place(lambda x: x == "(")
        behind = F.slice(ops, 1, F.greatest(opener - 1, F.lit(0)))
        called = _last(behind).startswith("@")
        closed = F.struct(
            F.concat(s["out"], popped(opener), F.when(called, F.array(_last(behind))).otherwise(F.array().cast("array<string>"))).alias("out"),
            F.when(called, F.slice(behind, 1, F.greatest(F.size(behind) - 1, F.lit(0)))).otherwise(behind).alias("ops"), (s["ok"] & (opener > 0)).alias("ok"),
        )
        binds = place(lambda x: (x == "(") | (rank(x) < rank(t)) | ((t == "^") & (x == "^")))
        # a sign follows an operator and takes nothing off the stack
        return (
            F.when(t == ")", closed).when((t == "(") | t.startswith("@") | (t == "~"), state(s["out"], F.array_append(ops, t)))
            .when(t.isin(*_PRECEDENCE), state(F.concat(s["out"], popped(binds)), F.array_append(F.slice(ops, 1, binds), t))).otherwise(state(F.array_append(s["out"], t), ops))
        )

    sound = F.when(F.forall(tokens, lambda t: t.isNotNull()), tokens)
    return F.aggregate(sound, start, step, lambda s: F.when(s["ok"] & ~F.array_contains(s["ops"], "("), F.concat(s["out"], F.reverse(s["ops"]))))


def _worked_out(postfix: Column) -> Column:
    """The value, or null."""

    def step(s, t):
        two, one = _last(s, 2), _last(s)
        drop = lambda n: F.slice(s, 1, F.greatest(F.size(s) - n, F.lit(0)))
        apply = F.when(t == "+", _add(two, one)).when(t == "-", _add(two, _negative(one))).when(t == "*", _times(two, one)).when(t == "/", _let(_inverse(one), lambda x: _times(two, x))).when(t == "^", _power(two, one))
        apply = apply.when(t == "=", _symbol(F.concat(F.lit("eq("), shown(two), F.lit(", "), shown(one), F.lit(")"))))
        alone = F.when(t == "~", _negative(one)).otherwise(_symbol(F.concat(F.substring(t, 2, 20), F.lit("("), shown(one), F.lit(")"))))
        value = F.when(t.rlike(r"^[\d.]"), _number(t)).otherwise(_symbol(t))
        binary = t.isin("+", "-", "*", "/", "^", "=")
        return F.when(binary, F.array_append(drop(2), F.when(F.size(s) >= 2, apply))).when((t == "~") | t.startswith("@"), F.array_append(drop(1), F.when(F.size(s) >= 1, alone))).otherwise(F.array_append(s, value))

    return F.aggregate(postfix, F.array().cast(f"array<{_SUM}>"), step, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))))


def value(cleaned: Column) -> Column:
    """The normal form of a cleaned answer as text, or null."""
    tokens = F.regexp_extract_all(cleaned, F.lit(TOKENS), F.lit(0))
    read = F.when((F.array_join(tokens, "") == F.regexp_replace(cleaned, r"\s+", "")) & (F.size(tokens) > 0), tokens)
    return _let(_let(_let(_let(_bracketed(read), _operators), _postfix), _worked_out), shown)


def label(answer: Column, strict: bool = False) -> Column:
    """Tier and canonical form of a final answer: `sympy:` and its normal form, else `text:` and the cleaned text; a failed parse is the sentinel.

    Text, not a formula: over MAX_LENGTH characters, more than MAX_SYMBOLS different letters, a relation between numbers; and
    under `strict` any word of three letters, or an equals sign that the form has lost.
    """

    def tier(c):
        letters = F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, r"\\[a-z]+", " "), F.lit("[a-z]"), F.lit(0)))
        formula = (F.length(c) <= MAX_LENGTH) & (F.size(letters) <= MAX_SYMBOLS) & ~(c.contains("=") & (F.size(letters) == 0) & ~c.rlike(r"\\[a-z]+"))
        if strict:
            formula = formula & ~c.rlike(WORD)
        found = F.when(formula, value(c))
        if strict:
            found = F.when(~c.contains("=") | found.startswith("eq("), found)
        return F.coalesce(F.concat(F.lit("sympy:"), found), F.concat(F.lit("text:"), c))

    clean = F.nullif(T.structural_clean(answer), F.lit(""))
    return F.coalesce(_let(clean, lambda c: F.when(c.isNotNull(), tier(c))), F.lit(T.SENTINEL))


def with_label(df: DataFrame, field: str, name: str, strict: bool = False) -> DataFrame:
    """df with the label of a field: different fields are labelled once each."""
    found = df.select(F.col(field).alias("_f")).filter("_f is not null").distinct().withColumn(name, answer_label(F.col("_f"), strict))
    return df.join(found, F.col(field) == F.col("_f"), "left").drop("_f").withColumn(name, F.coalesce(name, F.lit(T.SENTINEL.lower())))


def answer_label(field: Column, strict: bool = False) -> Column:
    """From a whole answer field to its label, both sides of a comparison alike."""
    return T.normalize(label(T.extract_final(field), strict))
