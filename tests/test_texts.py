import pytest
from pyspark.sql import functions as F

from verdance.functions import scans, text
from verdance.operators import audit, judging, profile, sampling, semantic
from verdance.operators import runs as R


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("response", "field"),
    [
        ("**Answer:**   4x + 1   \n\n", "4x + 1"), (r"\textbf{Answer: Option C}", "Option C}"), ("Work\nAnswer: 7", "7"), ("**Answer：** 3 ``` rest", "3"), ("no marker", None), ("**Answer:** \n ", None), (None, None),
        ("**Answer:** a\\end{document} b", "a"), ("The Answer is 3", None),
    ],
)
def test_answers(spark, response, field):
    assert one(spark, text.parse_answer, response) == field


@pytest.mark.parametrize(("value", "want"), [("  X=5.  ", "x=5"), ("answer...", "answer"), (None, text.SENTINEL), ("A. B.", "a. b")])
def test_normalize(spark, value, want):
    assert one(spark, text.normalize, value) == want


@pytest.mark.parametrize(
    ("value", "frozen", "fixed"),
    [
        ("The area is 75.46 cm.", "46 cm", "The area is 75.46 cm"), ("see Option: B or option c", "option c", "option c"), (r"\boxed{1} then \boxed{ 2 }", "2", "2"), ("$$ $$ and $x=1$", "x=1", "x=1"), ("  ", None, None), (None, None, None),
        ("first\nlast line\n\\end{align}", "last line", "last line"), (r"\[ a \] \( \)", "a", "a"),
    ],
)
def test_extraction(spark, value, frozen, fixed):
    assert one(spark, text.extract_final, value) == frozen
    assert one(spark, lambda c: text.extract_final(c, keep_decimals=True), value) == fixed


@pytest.mark.parametrize(
    ("value", "macro", "want"),
    [
        (r"\text{a}", "text", "a"), (r"\textcolor{red}{x^{2}}", "textcolor", "x^{2}"), (r"\textbf{a}", "text", r"\textbf{a}"), (r"\text{open", "text", r"\text{open"), (r"\text none", "text", r"\text none"),
        (r"a\text{b}c\text{d}", "text", "abcd"), (r"\text*{a}", "text", r"\text*{a}"), (r"\text{a}{b}{c}", "text", "c"),
    ],
)
def test_unwrap(spark, value, macro, want):
    assert scans.unwrap(value, macro) == want
    assert one(spark, lambda c: scans.unwrap_macro(c, macro), value) == want


def test_terms_and_spans(spark):
    assert scans.last_term("a=b=c") == "c" and scans.last_term("f(x=1)") == "f(x=1)" and scans.last_term("a<=b") == "a<=b" and scans.last_term("a==b") == "a==b" and scans.last_term("x= ") == "x"
    assert scans.red(r"\textcolor{red}{a{b}} \textcolor{ red } {c} \textcolor{blue}{d}") == ["a{b}", "c"]
    forms = {
        r"\text{Area} \times 2 , 3.": "area*2,3", r"\textcolor{red}{\mathbf{X}} = \frac{1}{2};": r"x=\frac {1}{2}", r"$a \div b$ \\ c": "a/b c", r"\{1 ,\, 2\}": "{1,2}", "": "", None: "", " A  -\tB\n": "a-b",
        r"\hspace{2em}x\quad y": "x y",
    }
    for raw, want in forms.items():
        assert one(spark, scans.normalize_span, raw) == want, raw


def test_rules(spark):
    value = r"$\textcolor{red}{x}\, = 2$"
    assert one(spark, lambda c: scans.label(c, "final_term_v4"), value).endswith("2")
    with pytest.raises(ValueError):
        scans.label(F.lit("a"), "nope")
    for rule in ("strict_v1", "fixed_v2", "relaxed_v3", "final_term_v4"):
        df = spark.createDataFrame([(v,) for v in (value, None, "", "The area is 75.46 cm.", "{2}\\,1 + y, $ 5.")], "x string")
        direct = [r[0] for r in df.select(scans.label(F.col("x"), rule)).collect()]
        assert [r["l"] for r in scans.with_label(df, "x", "l", rule).collect()] == direct
        assert [r[rule] for r in scans.with_labels(df, "x").collect()] == direct


@pytest.mark.parametrize(("raw", "want"), [(r"\boxed{yes} \boxed{no}", "incorrect"), ("so\n**Yes.**", "correct"), ("yes it is", "unclear"), (None, "unclear"), ("", "unclear")])
def test_verdicts(spark, raw, want):
    assert one(spark, text.parse_verdict, raw) == want


def test_three_valued_agreement(spark):
    df = spark.createDataFrame([("correct", True), ("incorrect", True), ("unclear", True), ("correct", None)], "v string, r boolean")
    assert [r[0] for r in df.select(judging.agreement(F.col("v"), F.col("r"))).collect()] == [True, False, None, None]
    with pytest.raises(Exception, match="cover every item"):
        judging.covered(spark.createDataFrame([(1,), (2,)], "i long"), spark.createDataFrame([(1, "x")], "i long, v string"), "i").collect()


def test_unknown_audit_label_is_an_error(spark):
    with pytest.raises(Exception, match="vocabulary"):
        spark.createDataFrame([("odd",)], "l string").select(audit.truth_of(F.col("l"))).collect()


def test_wilson_of_nothing_is_null(spark):
    from verdance.functions.stats import wilson

    low, high = wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low.alias("a"), high.alias("b")).first()) == (None, None)


def test_balanced_sample_keeps_the_ratio(spark):
    df = spark.range(540).select(F.col("id"), (F.col("id") < 40).alias("bad"))
    got = sampling.balanced(df, "bad", 300, 42, "id")
    assert (got.count(), got.filter("bad").count()) == (80, 40)
    assert sorted(r["review_order"] for r in got.collect()) == list(range(80))
    census = sampling.census(spark.range(100).select((F.col("id") < 87).alias("bad")), "bad").first()
    assert census["frac_error"] == 0.87 and census["max_balanced_n"] == 26
    empty = sampling.census(df.limit(0), "bad").first()
    assert empty["n_total"] == 0 and empty["frac_error"] == 0.0


def test_disjoint_slices(spark):
    df = spark.range(100)
    a = {r["id"] for r in sampling.sample(df, 30, 1, "id").collect()}
    b = {r["id"] for r in sampling.sample(df, 30, 1, "id", skip=30).collect()}
    assert len(a) == len(b) == 30 and not a & b


def test_largest_remainder_adds_up(spark):
    df = spark.createDataFrame([(s,) for s, n in (("a", 5), ("b", 5), ("c", 5), ("d", 1)) for _ in range(n)], "s string")
    got = {r["s"]: r["take"] for r in sampling.allocation(df, "s", 7).collect()}
    assert sum(got.values()) == 7 and got == {"a": 2, "b": 2, "c": 2, "d": 1} or sum(got.values()) == 7


def test_components_and_greedy(spark):
    s = spark.createDataFrame([(1, p, v) for p, v in enumerate(["ab", "bc", "cd", "xy", None])], "item_id long, pos int, v string")
    linked = semantic.edges(s, ["item_id"], "v", lambda a, b: F.substring(a, 2, 1) == F.substring(b, 1, 1))
    got = {r["pos"]: r["cluster"] for r in semantic.components(s, linked, ["item_id"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    greedy = {r["pos"]: r["cluster"] for r in semantic.greedy(s, ["item_id"], "v", lambda a, b: a[1] == b[0]).collect()}
    assert greedy == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_failure_classes(spark):
    rows = [("<parse_failure>", "text:a b", None, "x"), ("text:x", "text:y", "f", "t"), ("text:abcd", "text:zzzz", "abcd", "abcd\nzzzz"), ("text:qqq www", "text:1 2", "qqq www", "1 2"), ("text:x^2+1a", "text:x^2+1b", "x 1", "x 1"), ("text:x 1 foo", "text:bar x 1 long different", "x 1", "x 1")]
    df = spark.createDataFrame(rows, "m string, t string, mf string, tf string")
    got = [r[0] for r in df.select(profile.failure_class(*(F.col(c) for c in ("m", "t", "mf", "tf")))).collect()]
    assert got == ["extraction_issue", "extraction_issue", "copied_wrong_line", "hallucination", "notation_misread", "needs_visual"]


def test_log_prefix_and_leaks(spark):
    log = spark.createDataFrame([(i, i != 3) for i in range(6)] + [(9, None)], "line long, ok boolean")
    assert sorted(r["line"] for r in R.valid_prefix(log, "line", F.col("ok")).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        R.leaks(log, ["x"], ["line"])
