"""Queries: votes, ranking, deferral, resampling, null models, grids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.stats import dbl, hash_key
from ..operators import deferral, nullmodel, ranking, runs, sheets, votes
from ..sources.tables import event_run, event_votes, labelled, table
from .registry import query
from .sql import EV, LB, auroc, curve, hash_key as sql_key, uniform

# ---- votes ----


@query("vote_entropy", f"with {EV} select item_id, k, n_distinct, entropy from vt", "entropy")
def _(s, d):
    return votes.votes(event_votes(s, d)[0], ["item_id"]).select("item_id", "k", "n_distinct", "entropy")


@query("vote_majority", f"with {EV} select item_id, majority, majority_count from vt")
def _(s, d):
    return votes.votes(event_votes(s, d)[0], ["item_id"]).select("item_id", "majority", "majority_count")


@query("vote_baselines", f"with {EV} select item_id, n_distinct, majority_fraction, majority_margin from vt", "majority_fraction majority_margin")
def _(s, d):
    return votes.votes(event_votes(s, d)[0], ["item_id"]).select("item_id", "n_distinct", "majority_fraction", "majority_margin")


@query("array_entropy", f"with {EV} select item_id, abs(round(entropy, 9)) entropy from vt", "entropy")
def _(s, d):
    arrays = event_votes(s, d)[0].groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("a"))
    return arrays.select("item_id", stats.labels_entropy(F.col("a.label")).alias("entropy"))


@query("vote_auroc", f"with {EV}, x as ({auroc('run', 'entropy', 'correct')}) select *, (select count(distinct entropy) from run) n_levels from x", "auroc")
def _(s, d):
    run = event_run(s, d)
    return ranking.auroc(run, "entropy", "correct", few=True).join(F.broadcast(run.agg(F.count_distinct("entropy").alias("n_levels"))))


@query("k5_distinct", f"with {EV} select item_id, n_distinct::int n_distinct from vt where k = 5")
def _(s, d):
    run = votes.votes(event_votes(s, d)[0], ["item_id"]).filter("k = 5")
    return run.select("item_id", stats.k5_distinct(F.col("entropy")).alias("n_distinct"))


@query("accuracy_by_distinct", f"with {EV} select n_distinct, count(*) n, avg(correct::int) accuracy from run group by 1", "accuracy")
def _(s, d):
    return ranking.accuracy_by_distinct(event_run(s, d), "n_distinct", "correct")


# ---- ranking ----


@query("auroc", f"with {LB} {auroc('lb', 'score', 'correct')}", "auroc")
def _(s, d):
    return ranking.auroc(labelled(s, d), "score", "correct")


@query("auroc_by_lang", f"with {LB} {auroc('lb', 'score', 'correct', 'lang')}", "auroc")
def _(s, d):
    return ranking.auroc(labelled(s, d), "score", "correct", ["lang"])


@query("average_ranks", f"with {LB} select item_id, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double avg_rank from lb", "avg_rank")
def _(s, d):
    return ranking.average_ranks(labelled(s, d), "n_chars").select("item_id", "avg_rank")


_STRATA = f"select true pooled, null::varchar stratum, * from ({auroc('lb', 'score', 'correct')}) union all by name select false pooled, lang stratum, * exclude (lang) from ({auroc('lb', 'score', 'correct', 'lang')}) where lang is not null"


@query("auroc_strata", f"with {LB} {_STRATA}", "auroc")
def _(s, d):
    return ranking.strata(labelled(s, d), "score", "correct", "lang")


@query(
    "auroc_strata_flags",
    f"with {LB}, x as ({_STRATA}) select count(auroc) filter (not pooled) n_strata, coalesce(count(auroc) filter (not pooled) > 1 and max(auroc) filter (not pooled) > 0.5 and min(auroc) filter (not pooled) < 0.5, false) sign_reversal, coalesce(max(auroc) filter (pooled) < max(auroc) filter (not pooled) - 0.05, false) pooled_understates from x",
)
def _(s, d):
    return ranking.strata_flags(ranking.strata(labelled(s, d), "score", "correct", "lang"))


_MAX = math.log(5)
_CUT = f"select unnest(list_filter(['full', case when fails = 0 then 'excl_parse_failures' end, case when abs(h - {_MAX}) > 1e-8 + 1e-5 * {_MAX} then 'excl_max_entropy' end, case when fails = 0 and abs(h - {_MAX}) > 1e-8 + 1e-5 * {_MAX} then 'excl_both' end], lambda x: x is not null)) cut, * from lb"


@query("auroc_cuts", f"with {LB}, ct as ({_CUT}) {auroc('ct', 'h', 'correct', 'cut')}", "auroc")
def _(s, d):
    return ranking.auroc(ranking.with_cuts(labelled(s, d), "h", "fails", _MAX), "h", "correct", ["cut"], few=True)


@query(
    "weighted_auroc",
    f"""with {LB}, w as (select h, correct, 1 + n_chars % 3 w from lb), b as (select h, sum(w) w from w where not correct group by 1), g as (select h, sum(w) w from w where correct group by 1)
select sum(b.w * g.w * case when b.h > g.h then 1.0 when b.h = g.h then 0.5 else 0.0 end) / nullif((select sum(w) from b) * (select sum(w) from g), 0)::double auroc from b, g""",
    "auroc",
)
def _(s, d):
    return ranking.auroc(labelled(s, d).withColumn("w", 1 + F.col("n_chars") % 3), "h", "correct", weight="w", few=True).select("auroc")


@query("spearman", f"with {LB}, r as (select rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double a, rank() over (order by h) + (count(*) over (partition by h) - 1) / 2.0::double b from lb) select count(*) n_items, corr(a, b) spearman from r", "spearman")
def _(s, d):
    return ranking.spearman(labelled(s, d), "n_chars", "h")


@query("class_baseline", f"with {LB} select count(*) n, avg(correct::int) frac_positive, avg(correct::int) >= 0.5 majority_label, greatest(avg(correct::int), 1 - avg(correct::int)) baseline_accuracy from lb", "frac_positive baseline_accuracy")
def _(s, d):
    return ranking.class_baseline(labelled(s, d), "correct")


@query(
    "capability",
    f"with {LB}, g as (select unnest(['all', lang]) part, correct, toxic from lb), a as (select part, count(*) n_items, avg(correct::int) accuracy, greatest(avg(toxic::int), 1 - avg(toxic::int)) baseline_accuracy from (select part, case when part = 'all' then correct else correct = toxic end correct, toxic from g) group by 1) "
    "select *, accuracy - baseline_accuracy margin_over_baseline, case when accuracy >= 0.65 then 'capable' when accuracy < 0.55 then 'at_chance' else 'marginal' end verdict, 0.65::double threshold_capable, 0.55::double threshold_chance, accuracy >= 0.65 entropy_result_meaningful from a",
    "accuracy baseline_accuracy margin_over_baseline",
)
def _(s, d):
    """All items, and in each language whether its quality is taken for its toxicity."""
    part = F.explode(F.array(F.struct(F.lit("all").alias("part"), F.col("correct").alias("ok")), F.struct(F.col("lang").alias("part"), (F.col("correct") == F.col("toxic")).alias("ok"))))
    return ranking.capability(labelled(s, d).select(part.alias("p"), "toxic").select("p.part", "p.ok", "toxic"), "ok", "toxic", ["part"])


_SCALE_REPS = 40
_SCALED = f"""ov as (select o_orderkey k, ((o_orderkey // 32) % 6)::int g, o_orderstatus = 'F' e, o_custkey % 3 <> 0 ok, (o_orderkey * 7919 % 1000) / 1000.0::double base, [0.0, 0.25, 1.0, -0.5, 0.06, 0.4][((o_orderkey // 32) % 6 + 1)::int]::double pull from orders where (o_orderkey // 32) % 6 <> 5 or o_orderkey % 1024 < 40),
om as (select k, g, ok, unnest(list_filter(['perception', case when e then 'perception_error_stratum' end, 'reasoning_pooled', case when e then 'reasoning_error_stratum' else 'reasoning_clean_stratum' end], lambda m: m is not null and not (g = 4 and (m like 'perception%' or k % 2 = 1)))) measure, base + case when ok then 0 else pull end s from ov),
ow as (select *, len(list_filter({ranking.POISSON}, lambda t: t <= {uniform('0', 'rep', 'k')})) weight from om, (select unnest(range({_SCALE_REPS})) rep)), os as (select g, measure, rep, s, sum(weight) filter (not ok) e, sum(weight) filter (ok) c from ow where weight > 0 group by all),
oc as (select *, coalesce(e, 0) e0, coalesce(c, 0) c0, sum(coalesce(c, 0)) over (partition by g, measure, rep order by s) cum from os), oa as (select g, measure, rep, sum(e0 * (cum - c0 / 2.0::double)) / nullif(sum(e0) * sum(c0), 0)::double a from oc group by all), oi as (select g, measure, quantile_cont(a, 0.025::double) lo, quantile_cont(a, 0.975::double) hi from oa group by all),
op as ({auroc('om', 's', 'ok', 'g, measure')}), mt as (select op.*, lo, hi, coalesce(lo > 0.5, false) ex, least(n_error, n_correct) < 30 few from op join oi using (g, measure)),
hy as (select unnest(['perception_pooled_not_comparable', 'perception', 'reasoning_pooled', 'reasoning_stratified', 'clean_stratum_inversion']) hypothesis, unnest(['perception', 'perception_error_stratum', 'reasoning_pooled', 'reasoning_error_stratum', 'reasoning_clean_stratum']) measure)"""


@query(
    "scaleup_hypotheses",
    f"with {_SCALED} select gs.g, hy.hypothesis, hy.measure, case when mt.n_error is null or (hypothesis = 'clean_stratum_inversion' and auroc is null) then 'not_measured' when few then 'inconclusive_underpowered' when hypothesis in ('perception', 'perception_pooled_not_comparable') then case when lo >= 0.65 then 'replicated' when ex then 'weaker_than_pilot' else 'failed_to_replicate' end "
    "when hypothesis = 'reasoning_pooled' then case when lo >= 0.55 then 'signal_confirmed' else 'no_signal' end when hypothesis = 'reasoning_stratified' then case when auroc >= 0.7 and ex then 'confirmed' else 'not_confirmed' end else case when auroc < 0.5 then 'confirmed' else 'not_confirmed' end end verdict from (select distinct g from om) gs cross join hy left join mt on mt.g = gs.g and mt.measure = hy.measure",
)
def _(s, d):
    """Five registered hypotheses for six runs, fed by intervals of hashed replicates."""
    return ranking.judged(_scaled_intervals(s, d), ["g"])


@query(
    "interval_verdicts",
    f"with {_SCALED} select g, measure, case when few then 'inconclusive_underpowered' when hi < 0.5 then 'confirmed_inverted' when not ex then 'no_signal' when auroc >= 0.7 then 'confirmed' else 'resolved_below_threshold' end stratum_verdict, case when few then 'inconclusive_underpowered' when auroc >= 0.7 and ex then 'passes_screen' else 'does_not_pass' end screen_verdict from mt",
)
def _(s, d):
    """Verdicts on strata and screens from resampled intervals, not from a margin: each of them occurs."""
    n, a = (F.col("n_error"), F.col("n_correct")), F.col("auroc")
    x = _scaled_intervals(s, d)
    return x.select("g", "measure", ranking.stratum_verdict(F.col("n_items"), *n, a, F.col("ci_high"), F.col("excludes_chance")).alias("stratum_verdict"), sheets.screen_verdict(*n, a, F.col("excludes_chance")).alias("screen_verdict"))


def _scaled_intervals(s, d):
    k = F.col("o_orderkey")
    g = F.floor(k / 32) % 6
    ok = F.col("o_custkey") % 3 != 0
    pull = F.element_at(F.array(*(F.lit(x) for x in (0.0, 0.25, 1.0, -0.5, 0.06, 0.4))), (g + 1).cast("int"))
    score = (k * 7919 % 1000) / 1000.0 + F.when(ok, 0.0).otherwise(pull)
    stratum = F.when(F.col("o_orderstatus") == "F", "reasoning_error_stratum").otherwise("reasoning_clean_stratum")
    measure = F.array_compact(F.array(F.lit("perception"), F.when(F.col("o_orderstatus") == "F", "perception_error_stratum"), F.lit("reasoning_pooled"), stratum))
    kept = F.filter(measure, lambda m: ~((g == 4) & (m.startswith("perception") | (k % 2 == 1))))
    items = table(s, d, "orders").filter((g != 5) | (k % 1024 < 40)).select(k.alias("k"), g.cast("int").alias("g"), ok.alias("ok"), score.alias("s"), kept.alias("measures"))
    each = lambda df: df.withColumn("measure", F.explode("measures"))
    by, cell = ["g", "measure"], ["g", "measures", "ok", "s"]
    runs_ = each(items.groupBy(*cell).agg(F.count("*").alias("n")))
    drawn = ranking.auroc(each(ranking.hashed_cells(items, "k", cell, _SCALE_REPS)), "s", "ok", [*by, "rep"], weight="weight", few=True)  # the scores have 1,000 levels a verdict
    return ranking.with_interval(ranking.auroc(runs_, "s", "ok", by, weight="n", few=True), drawn, by)


@query("collapse_check", f"with {LB} select count(*) n_items, avg((correct = not toxic)::int) agreement, coalesce(avg((correct = not toxic)::int) >= 0.95 or avg((correct = not toxic)::int) <= 0.05, false) degenerate from lb", "agreement")
def _(s, d):
    return ranking.collapse_check(labelled(s, d).withColumn("p", ~F.col("toxic")), "correct", "p")


@query("zero_anchor", f"with {LB} select count(*) n_items, count(*) filter (abs(h) > 1e-6) n_nonzero, (count(*) filter (abs(h) > 1e-6)) / count(*)::double frac_nonzero, max(h) max_value, count(*) filter (abs(h) > 1e-6) = 0 passed from lb", "frac_nonzero max_value")
def _(s, d):
    return ranking.zero_anchor(labelled(s, d), "h")


@query("parse_failure_rate", f"with {LB} select sum(fails)::bigint n_failed_samples, count(*) * 5 n_total_samples, sum(fails) / (count(*) * 5)::double frac_failed, count(*) filter (fails >= 5) n_items_all_failed from lb", "frac_failed")
def _(s, d):
    return ranking.failure_rate(labelled(s, d), "fails")


@query("by_correctness", f"with {LB} select correct, count(*) n, avg(h) mean, median(h) median from lb group by 1", "mean median")
def _(s, d):
    return ranking.by_correctness(labelled(s, d), "h", "correct")


_VERDICT = "case when n_items = 0 then 'not_measured' when least(n_error, n_correct) < 30 then 'inconclusive_underpowered' when {hi} < 0.5 then 'confirmed_inverted' when not {lo} > 0.5 then 'no_signal' when auroc >= 0.7 then 'confirmed' else 'resolved_below_threshold' end"
# the reported interval here is a fixed margin around the estimate: the verdict's order of tests is what is checked
@query("stratum_verdict", f"with {LB}, x as ({auroc('lb', 'score', 'correct', 'lang')}) select lang, auroc, {_VERDICT.format(hi='auroc + 0.05', lo='auroc - 0.05')} verdict from x", "auroc")
def _(s, d):
    x = ranking.auroc(labelled(s, d), "score", "correct", ["lang"])
    a = F.col("auroc")
    return x.select("lang", "auroc", ranking.stratum_verdict(F.col("n_items"), F.col("n_error"), F.col("n_correct"), a, a + 0.05, a - 0.05 > 0.5).alias("verdict"))


REPS = 10_000  # the reference's


def _by_lang(s, d):
    run = labelled(s, d)
    return ranking.with_interval(ranking.auroc(run, "score", "correct", ["lang"]), ranking.bootstrap_ranges(run, "score", "correct", REPS, ["lang"]), ["lang"])


@query("stratum_verdict_bootstrap")
def _(s, d):
    return _by_lang(s, d).withColumn("verdict", ranking.stratum_verdict(F.col("n_items"), F.col("n_error"), F.col("n_correct"), F.col("auroc"), F.col("ci_high"), F.col("excludes_chance")))


@query("scaleup_verdict_bootstrap")
def _(s, d):
    return _by_lang(s, d).withColumn("verdict", ranking.scaleup_verdict(F.col("n_error"), F.col("n_correct"), F.col("ci_low"), F.col("excludes_chance"), 0.55))


@query("auroc_strata_interval")
def _(s, d):
    run, by = ranking.with_strata(labelled(s, d), "score", "correct", "lang"), ["pooled", "stratum"]
    return ranking.with_interval(ranking.auroc(run, "score", "correct", by), ranking.bootstrap_ranges(run, "score", "correct", REPS, by), by)


@query("auroc_cuts_interval")
def _(s, d):
    return ranking.cuts_interval(labelled(s, d), "h", "correct", "fails", _MAX, REPS)


@query("weighted_auroc_interval")
def _(s, d):
    run = labelled(s, d).withColumn("w", 1 + F.col("n_chars") % 3)  # a sampling stratum's items have one weight, so its weight names it
    per = ranking.bootstrap_cells(run, "h", "correct", 4_000, weight="w", within="w")
    return ranking.with_interval(ranking.auroc(run, "h", "correct", weight="w", few=True).select("auroc"), per)


# ---- resampling ----

_BOOT = f"""bx as (select item_id, score, h, correct, row_number() over (order by item_id) - 1 idx from lb), bn as (select count(*) n from bx),
dr as (select r.rep, {uniform('0', 'r.rep', 'b.idx')} % bn.n pick from bx b, bn, (select unnest(range(40)) rep) r), rp as (select rep, b.score, b.h, b.correct from dr join bx b on b.idx = dr.pick)"""


@query("bootstrap_auroc_hash", f"with {LB}, {_BOOT}, pr as ({auroc('rp', 'score', 'correct', 'rep')}), pt as ({auroc('lb', 'score', 'correct')}) select pt.*, count(pr.auroc) n_boot_valid, quantile_cont(pr.auroc, 0.025::double) ci_low, quantile_cont(pr.auroc, 0.975::double) ci_high, coalesce(quantile_cont(pr.auroc, 0.025::double) > 0.5, false) excludes_chance from pr, pt group by all", "auroc ci_low ci_high")
def _(s, d):
    return ranking.bootstrap(labelled(s, d), "item_id", "score", "correct", 40)


@query(
    "paired_auroc_diff_hash",
    f"with {LB}, {_BOOT}, a as ({auroc('rp', 'score', 'correct', 'rep')}), b as ({auroc('rp', 'h', 'correct', 'rep')}), x as (select a.auroc - b.auroc dx from a join b using (rep)), pa as ({auroc('lb', 'score', 'correct')}), pb as ({auroc('lb', 'h', 'correct')}) "
    "select pa.n_items, pa.auroc - pb.auroc difference, quantile_cont(dx, 0.025::double) ci_low, quantile_cont(dx, 0.975::double) ci_high, count(dx) n_boot_valid, coalesce(quantile_cont(dx, 0.025::double) > 0 or quantile_cont(dx, 0.975::double) < 0, false) difference_excludes_zero from x, pa, pb group by all",
    "difference ci_low ci_high",
)
def _(s, d):
    return ranking.bootstrap_difference(labelled(s, d), "item_id", ("score", "correct"), ("h", "correct"), 40)


@query("bootstrap_auroc_full")
def _(s, d):
    return ranking.with_interval(ranking.auroc(labelled(s, d), "score", "correct"), ranking.bootstrap_ranges(labelled(s, d), "score", "correct", REPS))


@query("paired_auroc_diff_full")
def _(s, d):
    return ranking.difference_ranges(labelled(s, d), ("score", "correct"), ("h", "correct"), REPS)


@query("bootstrap_auroc_levels")
def _(s, d):
    run = labelled(s, d)
    per = ranking.bootstrap_levels(ranking.levels(run, "h", "correct"), 10_000)
    return ranking.auroc(run, "h", "correct", few=True).join(F.broadcast(ranking.interval(per, "auroc")))


@query(
    "k_resample_join",
    f"with {EV}, k3 as (select item_id, abs(round(ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double, 12)) e3, (list(label order by n desc, f))[1] m3 from (select item_id, label, count(*) n, min(pos) f from sm where pos < 3 group by all) group by 1) "
    "select item_id, e3 entropy, m3 = truth correct, entropy entropy_resample, correct correct_resample from run join k3 using (item_id)",
    "entropy entropy_resample",
)
def _(s, d):
    samples, truths = event_votes(s, d)
    base = votes.votes(samples.filter("pos < 3"), ["item_id"]).join(truths, "item_id").select("item_id", "entropy", (F.col("majority") == F.col("truth")).alias("correct"))
    return runs.join_resample(base, event_run(s, d).select("item_id", "entropy", "correct"), ["item_id"])


@query(
    "k_comparison",
    f"""with {EV}, k3 as (select item_id, abs(round(ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double, 12)) e3, (list(label order by n desc, f))[1] m3 from (select item_id, label, count(*) n, min(pos) f from sm where pos < 3 group by all) group by 1),
j as (select item_id, e3, m3 = truth c3, entropy e5, correct c5 from run join k3 using (item_id)), a as ({auroc('j', 'e3', 'c3')}), b as ({auroc('j', 'e5', 'c5')}), f as (select count(distinct round(e3, 6)) n_distinct_base, count(distinct round(e5, 6)) n_distinct_new, avg((round(e3, 6) = {round(math.log(3), 6)}::double)::int) frac_max_base,
 avg((round(e5, 6) = {round(math.log(5), 6)}::double)::int) frac_max_new, median(e5) filter (c5) median_correct_new, median(e5) filter (not c5) median_incorrect_new, avg((c3 <> c5)::int) flip_rate, count(*) filter (not c5) n_incorrect_new from j)
select f.*, a.auroc auroc_base, b.auroc auroc_new, case when n_incorrect_new < 15 then 'inconclusive_underpowered' when b.auroc >= 0.72 and median_incorrect_new > median_correct_new then 'confirmed_sharper' when b.auroc >= 0.55 then 'confirmed_modest' else 'null_at_k5_was_noise' end verdict from f, a, b""",
    "frac_max_base frac_max_new median_correct_new median_incorrect_new flip_rate auroc_base auroc_new",
)
def _(s, d):
    samples, truths = event_votes(s, d)
    base = votes.votes(samples.filter("pos < 3"), ["item_id"]).join(truths, "item_id").select("item_id", F.col("entropy").alias("e3"), (F.col("majority") == F.col("truth")).alias("c3"))
    joined = base.join(event_run(s, d).select("item_id", F.col("entropy").alias("e5"), F.col("correct").alias("c5")), "item_id")
    out = runs.k_comparison(joined, ("e3", "c3"), ("e5", "c5"), 3, 5)
    return out.withColumn("verdict", ranking.resample_verdict(F.col("n_incorrect_new"), F.col("auroc_new"), F.col("median_incorrect_new"), F.col("median_correct_new")))


# ---- deferral ----

_CURVE = curve("lb", "h", "correct")
_COMPAT = """cl as (select distinct round_even(h, 6) threshold from lb), ck as (select threshold, (select count(*) from lb where h <= threshold + 1e-9) n_kept, (select count(*) from lb where not correct and h <= threshold + 1e-9) n_errors_kept, (select count(*) from lb) n_items, (select count(*) from lb where not correct) n_errors from cl)"""


@query("risk_coverage_exact", f"with {LB} {_CURVE}", "threshold coverage risk_kept")
def _(s, d):
    return deferral.curve(labelled(s, d), "h", "correct", few=True)


@query("risk_coverage_compat", f"with {EV}, lb as (select entropy h, correct from run), {_COMPAT} select *, n_kept / n_items::double coverage, n_errors_kept / n_kept::double risk_kept from ck where n_kept > 0", "threshold coverage risk_kept")
def _(s, d):
    return deferral.curve(event_run(s, d), "entropy", "correct", compat=True, few=True)


_AREA = """select max(n_items) n_items, count(*) n_operating_points, sum(st * risk_kept) aurc, (max(n_errors) / max(n_items)::double) baseline_aurc, max(n_errors) / max(n_items)::double - sum(st * risk_kept) improvement,
 max(o) oracle_aurc, sum(st * risk_kept) - max(o) e_aurc, sum(st * greatest(0, n_kept - (n_items - n_errors)) / n_kept::double) oracle_aurc_on_grid, sum(st * risk_kept) - sum(st * greatest(0, n_kept - (n_items - n_errors)) / n_kept::double) e_aurc_on_grid
 from (select *, coverage - lag(coverage, 1, 0.0::double) over (order by threshold) st, n_errors / n_items::double + (1 - n_errors / n_items::double) * ln(1 - n_errors / n_items::double) o from cv)"""
_AREA_COLS = "aurc baseline_aurc improvement oracle_aurc e_aurc oracle_aurc_on_grid e_aurc_on_grid"


@query("aurc", f"with {LB}, cv as ({_CURVE}) {_AREA}", _AREA_COLS)
def _(s, d):
    return deferral.aurc(deferral.curve(labelled(s, d), "h", "correct", few=True), few=True)


@query("aurc_lengths", f"with {LB}, cv as ({curve('lb', 'score', 'correct')}) {_AREA}", _AREA_COLS)
def _(s, d):
    """Of a score with any number of values: no task sees all of them."""
    return deferral.aurc(deferral.curve(labelled(s, d), "score", "correct"))


@query("oracle_aurc", "select r, case when r = 0 then 0.0 when r = 1 then 1.0 else r + (1 - r) * ln(1 - r) end oracle_aurc from (select (c_custkey % 101) / 100.0::double r from customer group by 1)", "r oracle_aurc")
def _(s, d):
    rates = table(s, d, "customer").select(((F.col("c_custkey") % 101) / F.lit(100.0)).alias("r")).distinct()
    return rates.select("r", stats.oracle_aurc(F.col("r")).alias("oracle_aurc"))


@query(
    "coverage_at_risk",
    f"with {LB}, cv as ({_CURVE}), t as (select unnest([0.05, 0.12, 0.15, 0.5]::double[]) target_risk), b as (select target_risk, arg_max(struct_pack(c := coverage, n := n_kept, t := threshold, r := risk_kept), coverage) b from t join cv on risk_kept <= target_risk + 1e-12 group by 1) select target_risk, b is not null achievable, coalesce(b.c, 0) coverage, coalesce(b.n, 0) n_kept, b.t threshold, b.r risk_kept from t left join b using (target_risk)",
    "target_risk coverage threshold risk_kept",
)
def _(s, d):
    return deferral.coverage_at_risk(deferral.curve(labelled(s, d), "h", "correct", few=True), [0.05, 0.12, 0.15, 0.5])


@query(
    "conformal_threshold",
    f"with {LB}, cv as ({_CURVE}), t as (select unnest([0.1, 0.2, 0.3]::double[]) target_risk), b as (select target_risk, arg_max(struct_pack(t := threshold, c := coverage, r := risk_kept), threshold) b from t join cv on risk_kept + sqrt(ln(10::double) / (2 * n_kept)) <= target_risk group by 1) select target_risk, b is not null achievable, b.t threshold, coalesce(b.c, 0) cal_coverage, b.r cal_risk from t left join b using (target_risk)",
    "target_risk threshold cal_coverage cal_risk",
)
def _(s, d):
    return deferral.conformal(deferral.curve(labelled(s, d), "h", "correct", few=True), [0.1, 0.2, 0.3])


_SPLIT = f"""hv as (select rep, h, correct, row_number() over (partition by rep order by {sql_key('split', "rep || '|' || item_id")}, item_id) <= round_even(count(*) over (partition by rep) * 0.5, 0) cal from lb, (select unnest(range(20)) rep)),
cc as (select rep, h threshold, sum(sum(1)) over o n, sum(count(*) filter (not correct)) over o b from hv where cal group by rep, h window o as (partition by rep order by h)),
tg as (select unnest([0.2, 0.3]::double[]) target_risk), ft as (select rep, target_risk, max(threshold) threshold from cc, tg where b / n::double + sqrt(ln(10::double) / (2 * n)) <= target_risk group by all),
mt as (select r.rep, tg.target_risk, ft.threshold, count(*) n, count(*) filter (h <= ft.threshold + 1e-9) kept, count(*) filter (not correct and h <= ft.threshold + 1e-9) bad from (select distinct rep from hv) r cross join tg left join ft on ft.rep = r.rep and ft.target_risk = tg.target_risk join hv on hv.rep = r.rep and not cal group by all)"""


@query(
    "conformal_splits",
    f"with {LB}, {_SPLIT} select target_risk, count(*) filter (kept > 0) n_valid, count(*) filter (not coalesce(kept > 0, false)) n_unachievable, avg(kept / n::double) filter (kept > 0) mean_coverage, avg(bad / kept::double) filter (kept > 0) mean_test_risk, avg((bad / kept::double > target_risk)::int) filter (kept > 0) violation_rate from mt group by 1",
    "target_risk mean_coverage mean_test_risk violation_rate",
)
def _(s, d):
    order = hash_key("split", F.concat_ws("|", "rep", "item_id"))
    return deferral.conformal_splits(labelled(s, d), "item_id", "h", "correct", [0.2, 0.3], 20, order)


@query("conformal_splits_full")
def _(s, d):
    return deferral.conformal_draws(labelled(s, d), "h", "correct", [0.2, 0.3], 1_000)


# ---- null models and grids ----

_GRID = "g as (select t.c truth_condition, p.p, k.k from (select unnest(['y=1', 'y=0']) c) t, (select unnest([0.5, 0.65, 0.8, 0.843, 0.9]::double[]) p) p, (select unnest([3, 5, 15]::int[]) k) k)"
_P, _K = [0.5, 0.65, 0.8, 0.843, 0.9], [3, 5, 15]


@query(
    "exact_null_auroc",
    f"""with {_GRID}, v as (select g.*, s, factorial(k)::double / (factorial(s::int)::double * factorial((k - s)::int)::double) * pow(p, s) * pow(1 - p, k - s) w, least(s, k - s) m, (2 * s > k) = (truth_condition = 'y=1') ok from g, unnest(range(k + 1)) r(s))
select truth_condition, p, k, sum(a.w * b.w * case when a.m > b.m then 1.0 when a.m = b.m then 0.5 else 0.0 end) / nullif((sum(a.w * b.w)), 0) auroc_exact from v a join v b using (truth_condition, p, k) where not a.ok and b.ok group by all""",
    "p auroc_exact",
)
def _(s, d):
    return nullmodel.exact_auroc(nullmodel.cells(s, ["y=1", "y=0"], _P, _K))


@query("null_cell_seeds", f"with {_GRID} select truth_condition, p, k, ('0x' || sha256('20260814|' || truth_condition || '|' || printf('%.4f', p) || '|' || k)[1:8])::bigint seed from g", "p")
def _(s, d):
    return nullmodel.cells(s, ["y=1", "y=0"], _P, _K).withColumn("seed", nullmodel.cell_seed(20260814, F.col("truth_condition"), F.col("p"), F.col("k")))


_FULL_P, _FULL_K = [round(0.05 * i, 2) for i in range(1, 20)], [3, 5, 7, 9, 15]  # the reference's grid: 285 cells


@query("null_simulation")
def _(s, d):
    return nullmodel.null_grid(s, nullmodel.CONDITIONS, _FULL_P, _FULL_K, 650, 2_000, 20260814)


@query("bias_only_null")
def _(s, d):
    return nullmodel.bias_only(s, 300, 0.8, 5, 2_000, 0)


# every 13th item's correctness is stored wrongly
@query("vote_collapse", "select y truth, count(*) n_items, count(*) filter (bad) n_broken, count(distinct m) n_entropy_levels from (select (c_custkey // 6) % 2 y, c_custkey % 13 = 0 bad, least(c_custkey % 6, 5 - c_custkey % 6) m from customer) group by 1")
def _(s, d):
    c = F.col("c_custkey")
    said, y = 2 * (c % 6) > 5, F.floor(c / 6) % 2
    rows = table(s, d, "customer").select((c % 6).alias("votes"), y.alias("y"), ((said == (y == 1)) != (c % 13 == 0)).alias("correct"))
    return nullmodel.collapse(rows, "votes", "y", "correct", 5)


@query("binary_entropy", "select p, case when p <= 0 or p >= 1 then 0.0 else -(p * ln(p) + (1 - p) * ln(1 - p)) end h from (select distinct (p_size % 51) / 50.0::double p from part)", "p h")
def _(s, d):
    return table(s, d, "part").select(((F.col("p_size") % 51) / F.lit(50.0)).alias("p")).distinct().select("p", stats.binary_entropy(F.col("p")).alias("h"))


_NEST = f"nb as (select ev.*, count(*) over (partition by item_id) c from ev where pos < 10), nk as (select item_id, label, pos, k temperature_k from nb, (select unnest([3, 5, 10]) k) where pos < k and c >= k)"
_NVOTE = "nc as (select item_id, temperature_k k, label, count(*) n, min(pos) f from nk group by all), nv as (select item_id, k, abs(round(ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double, 12)) entropy, (list(label order by n desc, f))[1] majority from nc group by all)"
_NGRID = f"{_NEST}, {_NVOTE}, tt as (select item_id, label truth from ev where pos = 10), gr as (select item_id, (item_id % 2)::double temperature, k, entropy, majority = truth correct, (majority = 'view')::int fails from nv join tt using (item_id))"


def _nested(s, d):
    samples, truths = event_votes(s, d, 10)
    scored = votes.votes(runs_nested(samples), ["item_id", "k_prefix"]).join(truths, "item_id")
    return scored.select("item_id", dbl(F.col("item_id") % 2).alias("temperature"), F.col("k_prefix").alias("k"), "entropy", (F.col("majority") == F.col("truth")).alias("correct"), (F.col("majority") == "view").cast("int").alias("fails"))


def runs_nested(samples):
    return votes.nested(samples, ["item_id"], (3, 5, 10))


@query("nested_prefix", f"with {EV}, {_NEST}, {_NVOTE} select * from nv", "entropy")
def _(s, d):
    out = votes.votes(runs_nested(event_votes(s, d, 10)[0]), ["item_id", "k_prefix"])
    return out.select("item_id", F.col("k_prefix").alias("k"), "entropy", "majority")


_GSUM = f"""select temperature, k, count(*) n_items, count(*) filter (not correct) n_error, count(*) filter (correct) n_correct, avg(correct::int) accuracy, count(distinct round(entropy, 12)) n_entropy_values, sum(fails) / (count(*) * k)::double parse_failure_rate, any_value(a.auroc) auroc, any_value(ar.aurc) aurc, any_value(ar.base) random_aurc
from gr join ({auroc('gr', 'entropy', 'correct', 'temperature, k')}) a using (temperature, k) join (select temperature, k, sum((coverage - lag) * risk) aurc, max(base) base from (select *, lag(coverage, 1, 0.0::double) over (partition by temperature, k order by s) lag from (select temperature, k, s, sum(n) over o / (sum(n) over (partition by temperature, k))::double coverage, sum(b) over o / (sum(n) over o)::double risk, sum(b) over (partition by temperature, k) / (sum(n) over (partition by temperature, k))::double base
 from (select temperature, k, round(entropy, 12) s, count(*) n, count(*) filter (not correct) b from gr group by all) window o as (partition by temperature, k order by s))) group by all) ar using (temperature, k) group by temperature, k"""


@query("grid_summary", f"with {EV}, {_NGRID} {_GSUM}", "temperature accuracy parse_failure_rate auroc aurc random_aurc")
def _(s, d):
    return runs.grid_summary(_nested(s, d), "entropy", "correct", "fails")


@query("grid_summary_interval")
def _(s, d):
    return runs.grid_metrics(_nested(s, d), "entropy", "correct", "fails", REPS)


@query("grid_problems", f"with {EV}, {_NGRID}, w as (select t.t temperature, k.k from (select unnest([0.0, 1.0]::double[]) t) t, (select unnest([3, 5, 7]) k) k), p as (select temperature, k, count(*) n from gr group by all) select coalesce(p.temperature, w.temperature) temperature, coalesce(p.k, w.k)::int k, case when p.k is null then 'missing_condition' when w.k is null then 'unexpected_condition' else 'incomplete_condition' end problem from p full join w on p.temperature = w.temperature and p.k = w.k where p.k is null or w.k is null or n <> 75", "temperature")
def _(s, d):
    return runs.grid_problems(_nested(s, d), [0.0, 1.0], [3, 5, 7], 75)


@query("reviewer_gate", f"with {EV}, {_NGRID}, g2 as (select temperature, k, count(*) n, least(count(*) filter (correct), count(*) filter (not correct)) m from gr group by all) select count(*) = 6 and bool_and(n = 75) complete, bool_and(m >= 30) minority_at_least, count(*) = 6 and bool_and(n = 75) and bool_and(m >= 30) eligible from g2")
def _(s, d):
    return runs.reviewer_gate(runs.grid_summary(_nested(s, d), "entropy", "correct", "fails"), 6, 75)


@query("nested_cell_seeds", "select c_custkey item_id, (c_custkey % 3)::double temperature, ('0x' || sha256('20260815|' || printf('%.6f', (c_custkey % 3)::double) || '|' || c_custkey)[1:8])::bigint seed from customer", "temperature")
def _(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("item_id"), dbl(F.col("c_custkey") % 3).alias("temperature"))
    return rows.withColumn("seed", nullmodel.nested_seed(20260815, F.col("temperature"), F.col("item_id")))


@query("normalize", r"select conv_id, turn, coalesce(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\.+$', ''), '<PARSE_FAILURE>') label from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("label"))


_SCALE = "case when least(n_error, n_correct) < 30 then 'inconclusive_underpowered' when auroc - 0.05 >= 0.55 then 'replicated' when auroc - 0.05 > 0.5 then 'weaker_than_pilot' else 'failed_to_replicate' end"


@query("scaleup_verdict", f"with {LB}, x as ({auroc('lb', 'score', 'correct', 'lang')}) select lang, {_SCALE} verdict from x")
def _(s, d):
    x = ranking.auroc(labelled(s, d), "score", "correct", ["lang"])
    low = F.col("auroc") - 0.05
    return x.select("lang", ranking.scaleup_verdict(F.col("n_error"), F.col("n_correct"), low, low > 0.5, 0.55).alias("verdict"))


@query(
    "entropy_distribution",
    f"with {EV}, c as (select round(entropy, 3) entropy, count(*) n from run group by 1) select entropy, n, (select count(*) from c) n_distinct_values, (select max(n) from c) / (select sum(n) from c)::double largest_share, (select max(n) from c) / (select sum(n) from c)::double >= 0.6 is_degenerate from c",
    "entropy largest_share",
)
def _(s, d):
    return ranking.distribution(event_run(s, d), "entropy")
