"""Judges: running one, gates, agreement with rules, with people and with each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import dbl, kappa, ratio
from .backends import called


def judge(items: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], prompt: str, key: str, batch: int = 64, done: DataFrame | None = None) -> DataFrame:
    """(key, raw_output, error): a judge's model, built once a worker and called with batches of prompts; see `backends.called`."""
    return called(items, [key], [prompt], make, "raw_output", "string", batch, done)


def gate(judged: DataFrame, key: str, probes: list) -> DataFrame:
    """Passed only if every probe is judged incorrect; a missing probe fails."""
    hit = F.col(key).isin(probes)
    return judged.agg(F.count_if(hit).alias("n_probes"), (F.count_if(hit & (F.col("verdict") == "incorrect")) == len(probes)).alias("passed"))


def agreement(verdict: Column, rule: Column) -> Column:
    """Three-valued: null where either side can't decide."""
    return F.when(verdict.isin("correct", "incorrect") & rule.isNotNull(), (verdict == "correct") == rule)


def diagnostics(judged: DataFrame, rules: list[str], human: str | None = None, flag: str | None = None) -> DataFrame:
    """Counts, both accuracy conventions, each rule's 2 x 2 with the judge, how often it says yes to either truth (flag: has an error), and agreement with people per class and overall (which says little where one class is rare)."""
    v = F.col("verdict")
    right, wrong, unclear = (F.count_if(v == x) for x in ("correct", "incorrect", "unclear"))
    n = F.count("*")
    aggs = [n.alias("n"), right.alias("n_correct"), wrong.alias("n_incorrect"), unclear.alias("n_unclear"), ratio(unclear, n).alias("unclear_rate"), ratio(right, right + wrong).alias("accuracy_excluding_unclear"), ratio(right, n).alias("accuracy_unclear_as_wrong")]
    said = v == "correct"
    for r in rules:
        aggs += [F.count_if(said != F.col(r)).alias(f"disagree_{r}"), F.count_if(said & ~F.col(r)).alias(f"judge_yes_{r}_no"), F.count_if(~said & F.col(r)).alias(f"judge_no_{r}_yes")]
    if flag:
        for name, side in (("has_error", F.col(flag)), ("clean", ~F.col(flag))):
            aggs += [F.count_if(side).alias(f"{name}_n"), ratio(F.count_if(side & said), F.count_if(side)).alias(f"{name}_correct_rate")]
    if human:
        h = F.col(human)
        aggs += [F.count(h).alias("human_n"), F.count_if((h == "wrong") & said).alias("human_false_pass"), F.count_if((h == "correct") & (v == "incorrect")).alias("human_false_fail"), ratio(F.count_if((h == "correct") & said), F.count_if(h == "correct")).alias("agrees_on_correct"), ratio(F.count_if((h == "wrong") & (v == "incorrect")), F.count_if(h == "wrong")).alias("agrees_on_wrong")]
        aggs.append(ratio(F.count_if(((h == "correct") & said) | ((h == "wrong") & (v == "incorrect"))), F.count(h)).alias("agrees_overall"))
    return judged.agg(*aggs)


def covered(run: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """run joined with a judge's rows; an item that it lacks is an error."""
    joined = run.join(judged.withColumn("_there", F.lit(True)), key, "left")
    return joined.filter(F.when(F.col("_there"), True).otherwise(F.raise_error(F.lit("a judge must cover every item")).cast("boolean"))).drop("_there")


def judge_kappa(both: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Agreement of two judges where both decide, chance agreement, and Cohen's kappa."""
    ok = F.col(a).isin("correct", "incorrect") & F.col(b).isin("correct", "incorrect")
    pa, pb = F.avg(F.when(ok, dbl(F.col(a) == "correct"))), F.avg(F.when(ok, dbl(F.col(b) == "correct")))
    same = F.avg(F.when(ok, dbl(F.col(a) == F.col(b))))
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_both_determinate"), F.count_if(ok & (F.col(a) == F.col(b))).alias("n_agree"), same.alias("rate"), (pa * pb + (1 - pa) * (1 - pb)).alias("chance_rate"))
    return out.withColumn("kappa", kappa(F.col("rate"), F.col("chance_rate")))


def output_report(texts: DataFrame, status: Column) -> DataFrame:
    """status, n, share of a run's outputs."""
    counts = texts.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("status", "n", ratio(F.col("n"), F.col("_all")).alias("share"))


def open_frame(run: DataFrame, judges: dict[str, DataFrame], key: str, rules: list[str], invented_by: str | None = None) -> DataFrame:
    """run (key, question, truth, answer, rules, ...) with every judge's verdict, raw output, parse failure and three-valued agreements.

    judges: frames of (key, raw_output, verdict); each must cover every item. invented_by: the judge whose numbers are
    looked up in the question, the truth and the answer.
    """
    out = run
    for name, judged in judges.items():
        out = covered(out, judged.select(key, F.coalesce("raw_output", F.lit("")).alias(f"{name}_raw_output"), F.col("verdict").alias(f"{name}_verdict")), key)
        v = F.col(f"{name}_verdict")
        out = out.withColumns({f"{name}_parse_failed": v == "unclear", f"{name}_looks_like_solving": text.looks_like_solving(F.col(f"{name}_raw_output")), **{f"{name}_agrees_{r}": agreement(v, F.col(r)) for r in rules}})
    both = [F.col(f"{n}_verdict") for n in judges]
    if len(both) == 2:
        decided = both[0].isin("correct", "incorrect") & both[1].isin("correct", "incorrect")
        out = out.withColumn("judges_agree", F.when(decided, both[0] == both[1]))
    if invented_by:
        said, source = text.numeric_surface(F.col(f"{invented_by}_raw_output")), text.numeric_surface(*(F.col(c) for c in ("question", "truth", "answer")))
        out = out.withColumn("_said", said).withColumn("_source", source)
        tokens = F.array_join(text.invented_tokens(F.col("_said"), F.col("_source")), "; ")
        out = out.withColumn(f"{invented_by}_invented_tokens", tokens).drop("_said", "_source").withColumn(f"{invented_by}_invented_reference", F.col(f"{invented_by}_invented_tokens") != "")
    return out
