"""Scans that need a stack, as Arrow-batched functions of columns: no regular expression can count braces."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from . import formulas
from . import text as T
from .likeness import ratios

_OPENERS, _CLOSERS = "{[(", "}])"
SPAN_MACROS = ("textcolor", "text", "mathrm", "mathbf", "textbf", "mbox", "operatorname")  # fixed value: macros that a span sheds
#: What a span's spacing macros and operators become, in this order.
SPAN_RULES = (
    (r"\\(?:,|;|:|!|quad|qquad|ensuremath|displaystyle|left|right|bigl|bigr|hspace\{[^}]*\})", " "),
    (r"\\times|\\cdot", "*"),
    (r"\\div", "/"),
    (r"\\([{}])", "$1"),
)


def _closing(s: str, at: int) -> int:
    """Place after the brace that closes the one at `at`; -1 if there is none."""
    depth = 0
    for m in re.compile("[{}]").finditer(s, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return -1


def unwrap(s: str, macro: str) -> str:
    """Each \\macro{..}{..} becomes its last argument; names that go on, no argument, or braces left open: unchanged."""
    out, at = [], 0
    for m in re.finditer(re.escape("\\" + macro) + r"(?![^\W\d_]|\*)", s):
        if m.start() < at:
            continue
        end, last = m.end(), None
        while end < len(s) and s[end] == "{":
            close = _closing(s, end)
            if close < 0:
                last = None
                break
            last, end = s[end + 1 : close - 1], close
        if last is not None:
            out += [s[at : m.start()], last]
            at = end
    return "".join(out) + s[at:]


def red(s: str) -> list[str]:
    found = []
    for m in re.finditer(r"\\textcolor\s*\{\s*red\s*\}\s*\{", s):
        close = _closing(s, m.end() - 1)
        found.append(s[m.end() : close - 1 if close > 0 else len(s) - 1])
    return found


def top_level_terms(s: str) -> list[str]:
    """Pieces between equals signs outside of brackets; <=, >=, != and == don't count."""
    cuts, depth = [-1], 0
    for i, ch in enumerate(s):
        if ch in _OPENERS:
            depth += 1
        elif ch in _CLOSERS:
            depth = max(0, depth - 1)
        elif ch == "=" and not depth and s[i - 1 : i] not in ("<", ">", "!", "=") and s[i + 1 : i + 2] != "=":
            cuts.append(i)
    return [s[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True)]


def last_term(s: str) -> str:
    return next((t.strip() for t in reversed(top_level_terms(s)) if t.strip()), s)


@pandas_udf(ArrayType(StringType()))
def _red(s: pd.Series) -> pd.Series:
    return pd.Series([[] if x is None else red(x) for x in s], dtype=object)


@pandas_udf(StringType())
def _shed(s: pd.Series) -> pd.Series:
    """Each text without the macros around its spans, in the fixed order; only texts with a backslash are scanned."""
    return pd.Series([x if x is None or "\\" not in x else reduce(unwrap, SPAN_MACROS, x) for x in s], dtype=object)


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()))


def unwrap_macro(c: Column, macro: str) -> Column:
    """`unwrap` in SQL functions, so that a branch that isn't taken costs nothing; rows without the macro skip it."""
    return T.let(c, lambda x: F.when(x.contains("\\" + macro), _unwrapped(x, macro)).otherwise(x))


#: Marks that stand for braces or cuts while a text is worked on; a text's own are told apart by what follows them.
_LEFT, _RIGHT = "\ufdd0", "\ufdd1"


def _unwrapped(c: Column, macro: str) -> Column:
    """Braces are paired from the inside out, a round for each level: a pair is marked by its round, and within it are only smaller rounds, so a pattern finds the end of an argument."""
    deeper = lambda at, b: T.let(F.when(b == "{", at["now"] + 1).otherwise(F.greatest(at["now"] - 1, F.lit(0))), lambda now: F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most")))
    levels = F.aggregate(F.regexp_extract_all(c, F.lit("[{}]"), F.lit(0)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper, lambda at: at["most"])
    pair = lambda x, n: F.regexp_replace(x, F.lit(r"\{([^{}]*)\}"), F.concat(F.lit(_LEFT), n.cast("string"), F.lit(f";$1{_RIGHT}"), n.cast("string"), F.lit(";")))
    paired = F.aggregate(F.sequence(F.lit(0), levels), F.regexp_replace(c, f"([{_LEFT}{_RIGHT}])", "$1!"), pair)
    macros = rf"(?s)\\{macro}(?![\p{{L}}\p{{Nl}}\p{{No}}*])(?:{_LEFT}(\d+);(.*?){_RIGHT}\1;)++(?!\{{)"
    back = ((macros, "$2"), (rf"{_LEFT}\d+;", "{"), (rf"{_RIGHT}\d+;", "}"), (f"([{_LEFT}{_RIGHT}])!", "$1"))
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), back, paired)


def red_spans(c: Column) -> Column:
    return _red(c)


def final_term(c: Column) -> Column:
    """`last_term` in SQL functions: a fold over what lies between brackets and cuts."""
    return T.let(c, lambda x: F.when(x.contains("="), _last(x)).otherwise(x))


#: Fixed value: Unicode's white space.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _last(c: Column) -> Column:
    own = F.regexp_replace(F.regexp_replace(c, _RIGHT, f"{_RIGHT}1"), _LEFT, f"{_RIGHT}0")
    marked = F.regexp_replace(own, r"(?<![<>!=])=(?!=)", _LEFT)
    said = lambda x: T.let(F.regexp_replace(x, rf"\A{_BLANK}|{_BLANK}\z", ""), lambda t: F.when(t != "", t))
    to = lambda depth, term, found: F.struct(depth.alias("depth"), term.alias("term"), found.alias("found"))

    def step(at, x):
        more = F.concat(at["term"], x)
        closing, cut = x.isin("}", "]", ")"), (x == _LEFT) & (at["depth"] == 0)
        return (
            F.when(cut, to(at["depth"], F.lit(""), F.coalesce(said(at["term"]), at["found"]))).when(x.isin("{", "[", "("), to(at["depth"] + 1, more, at["found"]))
            .otherwise(to(F.when(closing, F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"]), more, at["found"]))
        )

    pieces = F.regexp_extract_all(marked, F.lit(rf"[{{}}\[\]()]|{_LEFT}|[^{{}}\[\](){_LEFT}]+"), F.lit(0))
    found = F.aggregate(pieces, to(F.lit(0), F.lit(""), F.lit(None).cast("string")), step, lambda at: F.coalesce(said(at["term"]), at["found"]))
    plain = reduce(lambda x, rule: F.regexp_replace(x, *rule), ((_LEFT, "="), (f"{_RIGHT}0", _LEFT), (f"{_RIGHT}1", _RIGHT)), found)
    return F.coalesce(plain, c)


def normalize_span(c: Column) -> Column:
    """A span's form for comparison: macros shed by one scan, then expressions: spacing, spellings of operators, one blank after a macro's name and none around operators, lower case. Null: empty."""
    plain = reduce(lambda x, rule: F.regexp_replace(x, *rule), SPAN_RULES, _shed(c))
    named = F.regexp_replace(plain, r"(\\[a-zA-Z]+)\s*", "$1 ")
    one_line = T.strip(F.regexp_replace(F.regexp_replace(F.replace(named, F.lit("$"), F.lit("")), r"\\\\", " "), r"[ \t\n\r]+", " "))
    tight = F.regexp_replace(F.regexp_replace(one_line, r"[.;,]+\z", ""), r"\s*([=+\-*/,])\s*", "$1")
    return F.coalesce(T.strip(F.lower(tight)), F.lit(""))


def similarity(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def answer_span(c: Column) -> Column:
    return T.extract_final(unwrap_macro(unwrap_macro(c, "textcolor"), "text"), keep_decimals=True)


def ruled(final: Column, rule: str = "strict_v1") -> Column:
    """The label of an extracted answer (by `extract_final` for strict_v1, else by `answer_span`); an unknown rule is an error."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    fixed = T.normalize(T.canonical(final))
    if rule in ("strict_v1", "fixed_v2"):
        return fixed
    loose = T.let(fixed, _loose)
    return loose if rule == "relaxed_v3" else T.let(loose, lambda x: F.when(x == T.SENTINEL.lower(), x).otherwise(final_term(x)))


def _loose(fixed: Column) -> Column:
    return F.when(fixed == T.SENTINEL.lower(), fixed).otherwise(T.cosmetic(fixed))


def label(c: Column, rule: str = "strict_v1") -> Column:
    """A label by one of four versioned rules; an unknown one is an error."""
    return ruled(T.extract_final(c) if rule == "strict_v1" else answer_span(c), rule)


def labels(c: Column) -> Column:
    """All four rules' labels of a field, as a struct: two extractions serve them, as the last three share one."""
    both = lambda fixed, loose: F.struct(label(c).alias("strict_v1"), fixed.alias("fixed_v2"), loose.alias("relaxed_v3"), final_term(loose).alias("final_term_v4"))
    return T.let(ruled(answer_span(c), "fixed_v2"), lambda fixed: T.let(_loose(fixed), lambda loose: both(fixed, loose)))


RULES = ("strict_v1", "fixed_v2", "relaxed_v3", "final_term_v4")


def with_labels(df: DataFrame, field: str) -> DataFrame:
    """df with a column for each rule's label of the field: two extractions serve the four rules, as the last three share one. `unpivot` makes rows of them."""
    out = with_label(with_label(df, field, "strict_v1"), field, "fixed_v2", "fixed_v2")
    out = out.withColumn("relaxed_v3", F.when(F.col("fixed_v2") == T.SENTINEL.lower(), F.col("fixed_v2")).otherwise(T.cosmetic(F.col("fixed_v2"))))
    return out.withColumn("final_term_v4", final_term(F.col("relaxed_v3")))


def with_label(df: DataFrame, field: str, name: str, rule: str = "strict_v1") -> DataFrame:
    """df with a label of the field, like `label`, in steps: each step's column is computed once, however often the next one uses it. parsed_v1 is strict_v1 with its tier of formulas."""
    if rule == "parsed_v1":
        return formulas.with_label(df, field, name)
    fixed = rule != "strict_v1"
    source = unwrap_macro(unwrap_macro(F.col(field), "textcolor"), "text") if fixed else F.col(field)
    out = df.withColumn("_text", T.strip(source)).withColumn("_final", T.extract_final(F.col("_text"), keep_decimals=fixed)).withColumn("_clean", T.structural_clean(F.col("_final")))
    cleaned = F.coalesce(F.concat(F.lit("text:"), F.nullif("_clean", F.lit(""))), F.lit(T.SENTINEL))
    out = out.withColumn("_label", T.normalize(cleaned))
    if rule in ("relaxed_v3", "final_term_v4"):
        out = out.withColumn("_loose", F.when(F.col("_label") == T.SENTINEL.lower(), F.col("_label")).otherwise(T.cosmetic(F.col("_label"))))
        out = out.withColumn("_label", final_term(F.col("_loose")) if rule == "final_term_v4" else F.col("_loose")).drop("_loose")
    elif rule not in ("strict_v1", "fixed_v2"):
        raise ValueError(f"unknown rule {rule!r}")
    return out.withColumnRenamed("_label", name).drop("_text", "_final", "_clean")


def ablated_label(c: Column, unwrapped: bool = False, keep_decimals: bool = False) -> Column:
    """strict_v1 with some of fixed_v2's repairs."""
    text = unwrap_macro(unwrap_macro(c, "textcolor"), "text") if unwrapped else c
    return T.normalize(T.canonical(T.extract_final(text, keep_decimals)))
