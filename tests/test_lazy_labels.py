"""Labels in SQL functions, looked up where common: against the scans in Python, and without Python in the plans."""

import math
import random

from pyspark.sql import functions as F

from tests.test_findings_r03 import poll
from verdance.functions import scans, text
from verdance.operators import cases, profile, votes

PIECES = ["\\text", "\\textcolor", "{", "}", "{", "}", "a", "b2", "*", "=", "==", "<=", "(", ")", "[", "]", " ", "\n", " ", "﷐", "﷑", "1;", "!", "²", "é", "_", "0", "$1", "\\", "red"]


def test_scans_in_sql_are_those_in_python(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 24))) for _ in range(5_000)] + [None, "", "\\text{a \\text{b}", "\\text{" * 100 + "}" * 100, "=" + "x" * 20_000 + "= "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", *(scans.unwrap_macro(F.col("t"), m).alias(m) for m in ("text", "textcolor")), scans.final_term(F.col("t")).alias("last")).collect()
    for t, plain, black, last in got:
        want = (None,) * 3 if t is None else (scans.unwrap(t, "text"), scans.unwrap(t, "textcolor"), scans.last_term(t) if "=" in t else t)
        assert (plain, black, last) == want


def test_values_that_are_known_are_not_worked_out_again(spark, monkeypatch):
    """rows of a common value all get what was made for it once."""
    rows = spark.range(640).select((F.col("id") % 320).alias("item_id"), (F.col("id") % 4).cast("string").alias("v")).repartition(3)
    label = lambda c: F.struct(text.normalize(c).alias("label"), F.when(F.rand() >= 0, F.monotonically_increasing_id()).alias("made"))
    got = votes.looked_up(rows, "v", label, ["item_id"]).select("v", "_told.*").collect()
    assert len(got) == 640 and len({r["made"] for r in got}) == 4 and all(r["label"] == r["v"] for r in got)


def test_no_python_for_labels(spark):
    """F9, F11 to F13, F15, F19, F22: only likenesses are scanned in Python; an item's rows are read once, and for each lookup."""
    samples, truths = poll(spark)
    for df in (profile.majorities(samples, truths, ["item_id"]), profile.always_wrong(samples, truths, ["item_id"]), votes.score_rules(samples, truths, ["item_id"]), cases.label_views(samples, truths, ["item_id"], "final_term_v4"), cases.trace(samples, truths, ["item_id"], "fixed_v2")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan and plan.count("Range (0, 400") <= 4


def test_tally_counts_like_a_brute_force(spark):
    r = random.Random(2)
    items = [[(r.choice([None, "a", "b", "c", "d"]), p, r.randint(1, 3), f"m{p}") for p in range(r.randint(1, 9))] for _ in range(400)]
    df = spark.createDataFrame([(i, *row) for i, rows in enumerate(items) for row in rows], "i int, label string, pos long, n long, made string")
    t = df.groupBy("i").agg(votes.tally(F.collect_list(votes.ballot(F.col("label"), F.col("pos"), F.col("n"), F.col("made")))).alias("t"))
    for row in t.select("i", "t.*", votes.entropy(F.col("t")).alias("h")).collect():
        runs = {}
        for label, pos, n, made in items[row["i"]]:
            runs.setdefault(label, [0, pos, made])[0] += n
        total = sum(n for n, *_ in runs.values())
        label, (n, first, made) = max(runs.items(), key=lambda kv: (kv[1][0], -kv[1][1]))
        assert (row["k"], row["n_distinct"], row["best"]["label"], row["best"]["n"], -row["best"]["early"], row["best"]["made"]) == (total, len(runs), label, n, first, made)
        assert sorted(row["sizes"]) == sorted(x for x, *_ in runs.values()) and abs(row["h"] - sum(-x / total * math.log(x / total) for x, *_ in runs.values())) < 1e-9
