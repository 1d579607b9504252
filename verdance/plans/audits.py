"""Queries: sampling, audits, profiles, snapshots, provenance, relational forms, semantic clusters."""

from __future__ import annotations



from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import dbl, hash_key, ratio, wilson
from ..operators import audit, cases, profile, ranking, runs, sampling, semantic
from ..sources.places import read_lines, read_rows, write_lines
from ..sources.scratch import scratch_path
from ..sources.tables import SAMPLE_LOG, event_run, event_votes, labelled, table
from .registry import query
from .sql import EV, LB, auroc, hash_key as sql_key

# ---- sampling ----


@query("census", f"with {LB} select count(*) n_total, count(*) filter (toxic) n_error, count(*) filter (not toxic) n_clean, avg(toxic::int) frac_error, 2 * least(count(*) filter (toxic), count(*) filter (not toxic)) max_balanced_n from lb", "frac_error")
def _(s, d):
    return sampling.census(labelled(s, d), "toxic")


@query("uniform_sample", f"select doc_id from documents order by {sql_key('42', 'doc_id')}, doc_id limit 25")
def _(s, d):
    return sampling.sample(table(s, d, "documents"), 25, 42, "doc_id").select("doc_id")


@query("disjoint_extension", f"with {LB} select item_id from lb where toxic order by {sql_key('42', 'item_id')}, item_id limit 20 offset 10")
def _(s, d):
    return sampling.sample(labelled(s, d).filter("toxic"), 20, 42, "item_id", skip=10).select("item_id")


def _balanced_sql(n: int, frac: float) -> str:
    return f"""with {LB}, c as (select least(1.0::double, count(*) filter (toxic) / round_even({n} * {frac}, 0), count(*) filter (not toxic) / ({n} - round_even({n} * {frac}, 0))) sc from lb), r as (select item_id, toxic, row_number() over (partition by toxic order by {sql_key('7', 'item_id')}, item_id) rn from lb),
t as (select item_id, toxic from r, c where rn <= floor(case when toxic then round_even({n} * {frac}, 0) else {n} - round_even({n} * {frac}, 0) end * sc)) select item_id, toxic, (row_number() over (order by {sql_key('7-shuffle', 'item_id')}, item_id) - 1)::int review_order from t"""


@query("balanced_sample", _balanced_sql(40, 0.5))
def _(s, d):
    return sampling.balanced(labelled(s, d), "toxic", 40, 7, "item_id").select("item_id", "toxic", "review_order")


@query("balanced_short_pool", _balanced_sql(300, 0.5))
def _(s, d):
    return sampling.balanced(labelled(s, d), "toxic", 300, 7, "item_id").select("item_id", "toxic", "review_order")


@query("pooled_union_sample", f"with p as (select 'c' || c_custkey k, c_acctbal v, 'customer' study_level from customer union all select 's' || s_suppkey, s_acctbal, 'supplier' from supplier) select k, study_level, v from p order by {sql_key('42', 'k')}, k limit 50", "v")
def _(s, d):
    parts = {"customer": table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "supplier": table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))}
    return sampling.sample(sampling.pooled(parts, "study_level"), 50, 42, "k").select("k", "study_level", "v")


@query("pooled_continuation", f"with p as (select 'c' || c_custkey k, c_acctbal v, 'customer' study_level from customer union all select 's' || s_suppkey, s_acctbal, 'supplier' from supplier) select k, study_level, v from p order by {sql_key('42', 'k')}, k limit 40 offset 50", "v")
def _(s, d):
    """What follows pooled_union_sample in the same order: no row is in both."""
    parts = {"customer": table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "supplier": table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))}
    return sampling.sample(sampling.pooled(parts, "study_level"), 40, 42, "k", skip=50).select("k", "study_level", "v")


@query(
    "sample_vs_corpus",
    f"""with {LB}, b as (select lb.*, text from lb join documents d on d.doc_id = item_id), s as (select * from b order by {sql_key('42', 'item_id')}, item_id limit 60), f as (select 'n' field, (select count(*) from b)::double corpus, (select count(*) from s)::double sample
 union all select 'frac_toxic', (select avg(toxic::int) from b), (select avg(toxic::int) from s) union all select 'frac_correct', (select avg(correct::int) from b), (select avg(correct::int) from s) union all select 'median_len_text', (select median(len(text))::double from b), (select median(len(text))::double from s))
select field, corpus, sample, case when field <> 'n' then sample - corpus end delta from f""",
    "corpus sample delta",
)
def _(s, d):
    both = labelled(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return sampling.compare(sampling.sample(both, 60, 42, "item_id"), both, ["toxic", "correct"], ["text"])


@query("round_robin_examples", f"with {LB}, r as (select *, row_number() over (partition by toxic, correct, lang order by {sql_key('9', 'item_id')}, item_id) t from lb), p as (select *, row_number() over (partition by toxic, correct order by t, {sql_key('9', 'lang')}, {sql_key('9', 'item_id')}, item_id) q from r where t <= 6) select item_id, toxic, correct, lang from p where q <= 6")
def _(s, d):
    order = [hash_key(9, F.col("item_id")), F.col("item_id")]
    return sampling.round_robin(labelled(s, d), ["toxic", "correct"], "lang", 6, order, hash_key(9, F.col("lang"))).select("item_id", "toxic", "correct", "lang")


@query("priority_sample", f"with {LB}, p as (select *, row_number() over (partition by toxic order by case when item_id % 50 = 3 then 0 when not correct then 1 when fails = 1 then 2 else 3 end, {sql_key('5', 'item_id')}, item_id) q from lb) select item_id, toxic from p where q <= case when toxic then 8 else 4 end")
def _(s, d):
    tier = F.when(F.col("item_id") % 50 == 3, 0).when(~F.col("correct"), 1).when(F.col("fails") == 1, 2).otherwise(3)
    return sampling.priority(labelled(s, d), ["toxic"], F.when(F.col("toxic"), 8).otherwise(4), tier, [hash_key(5, F.col("item_id")), F.col("item_id")]).select("item_id", "toxic")


_STRATUM = "case when correct then 'right' else 'wrong' end || '|' || case when h <= 0 then 'H=0' when h < 0.7 then 'H_low' when h < 1.4 then 'H_mid' else 'H_high' end || '|' || lang"


@query(
    "review_queue",
    f"""with {LB}, i as (select item_id, {_STRATUM} stratum, item_id in (3, 11) ch from lb), z as (select stratum, count(*) n from i where not ch group by 1), w as (select stratum, n, floor(n / (select sum(n) from z)::double * 90.0) b, round(n / (select sum(n) from z)::double * 90.0 - floor(n / (select sum(n) from z)::double * 90.0), 12) r from z),
t as (select stratum, n, b + (row_number() over (order by r desc, stratum) <= 90 - (select sum(b) from w))::int take from w), k as (select i.*, t.n, t.take, row_number() over (partition by i.stratum, ch order by {sql_key('20260814', 'item_id')}, item_id) q, row_number() over (order by {sql_key('20260814-review', 'item_id')}, item_id) - 1 o from i left join t on t.stratum = i.stratum),
f as (select *, case when ch then 'challenge' when q <= take then 'core' else 'extension' end queue from k) select item_id, stratum, queue, case when queue = 'core' then round(take / n::double, 6) end selection_prob, o::int review_order, printf('R%04d', o) review_id from f""",
    "selection_prob",
)
def _(s, d):
    stratum = F.concat_ws("|", F.when(F.col("correct"), "right").otherwise("wrong"), sampling.entropy_bin(F.col("h")), "lang")
    return sampling.queue(labelled(s, d).select("item_id", stratum.alias("stratum")), "item_id", "stratum", 90, 20260814, [3, 11])


@query("allocation", "with z as (select o_orderpriority stratum, count(*) size from orders group by 1), w as (select *, floor(size / (select sum(size) from z)::double * 17.0) b, round(size / (select sum(size) from z)::double * 17.0 - floor(size / (select sum(size) from z)::double * 17.0), 12) r from z) select stratum, size, (b + (row_number() over (order by r desc, stratum) <= 17 - (select sum(b) from w))::int)::bigint take from w")
def _(s, d):
    return sampling.allocation(table(s, d, "orders").withColumnRenamed("o_orderpriority", "stratum"), "stratum", 17)


# ---- audits ----

_LABELS = ["true_correct", "true_wrong", "notation_misread", "copied_wrong_line", "hallucination", "extraction_issue", "needs_visual"]
_LAB = "['" + "', '".join(_LABELS) + "']"
_AU = f"""au as (select c_custkey item, 'census' audit_set, {_LAB}[(c_custkey % 7 + 1)::int] final_label, c_name note from customer where c_custkey % 3 = 0 union all select c_custkey, 'spot', {_LAB}[((c_custkey * 3 + 1) % 7 + 1)::int], c_name from customer where c_custkey % 5 = 0
 union all select c_custkey, 'high', {_LAB}[(c_custkey * 5 % 7 + 1)::int], c_name from customer where c_custkey % 7 = 0), al as (select *, case when final_label = 'true_correct' then 'correct' when final_label in ('extraction_issue', 'needs_visual') then 'indeterminate' else 'wrong' end truth from au),
ru as (select c_custkey item, c_custkey % 4 = 0 correct, c_custkey % 3 = 0 v2, c_custkey % 11 = 0 majority_failed, (c_custkey % 8)::double h from customer)"""


def _audits(s, d):
    c = F.col("c_custkey")
    pick = lambda m: F.element_at(F.array(*(F.lit(x) for x in _LABELS)), (m % 7 + 1).cast("int"))
    rows = table(s, d, "customer").select(c.alias("item"), F.col("c_name").alias("note"))
    i = F.col("item")
    sets = {"census": rows.filter(i % 3 == 0).withColumn("final_label", pick(i)), "spot": rows.filter(i % 5 == 0).withColumn("final_label", pick(i * 3 + 1)), "high": rows.filter(i % 7 == 0).withColumn("final_label", pick(i * 5))}
    run = rows.select("item", (i % 4 == 0).alias("correct"), (i % 3 == 0).alias("v2"), (i % 11 == 0).alias("majority_failed"), dbl(i % 8).alias("h"))
    return audit.union(sets), run


def _one(s, d, name):
    return _audits(s, d)[0].filter(F.col("audit_set") == name)


@query("audit_union", f"with {_AU} select item, audit_set, final_label, note, truth from al")
def _(s, d):
    return _audits(s, d)[0]


@query("audit_invariants", f"with {_AU}, p as (select item, count(*) n, count(distinct truth) filter (truth <> 'indeterminate') k from al group by 1) select sum(n)::bigint n_rows, count(*) n_unique_items, (sum(n) - count(*))::bigint n_overlap_rows, count(*) filter (n > 1) n_items_coded_twice, count(*) filter (k > 1) n_hard_contradictions from p")
def _(s, d):
    return audit.invariants(_audits(s, d)[0])


_PAIRS = "pp as (select a.item, a.audit_set set_a, b.audit_set set_b, a.final_label label_a, b.final_label label_b, a.note note_a, b.note note_b, case when a.truth <> 'indeterminate' and b.truth <> 'indeterminate' and a.truth <> b.truth then 'hard' when a.final_label <> b.final_label then 'soft' else 'none' end difference from al a join al b on a.item = b.item and a.audit_set < b.audit_set)"


@query("audit_overlap", f"with {_AU}, {_PAIRS} select set_a, set_b, count(*) n_shared, count(*) filter (difference = 'hard') n_hard, count(*) filter (difference = 'soft') n_soft from pp group by all")
def _(s, d):
    return audit.overlaps(_audits(s, d)[0])


@query("contradiction_sheet", f"with {_AU}, {_PAIRS} select item, set_a, label_a, note_a, set_b, label_b, note_b, '' adjudicated_label from pp where difference = 'hard'")
def _(s, d):
    return audit.pairs(_audits(s, d)[0]).filter("difference = 'hard'").select("item", "set_a", "label_a", "note_a", "set_b", "label_b", "note_b", F.lit("").alias("adjudicated_label")).orderBy("item")


@query("audit_precedence", f"with {_AU}, r as (select *, row_number() over (partition by item order by case audit_set when 'high' then 0 when 'spot' then 1 else 2 end) k from al) select item, audit_set, final_label, truth from r where k = 1")
def _(s, d):
    return audit.precedence(_audits(s, d)[0], ["high", "spot", "census"]).select("item", "audit_set", "final_label", "truth")


@query(
    "set_diagnostics",
    f"with {_AU}, j as (select al.*, correct v1, v2 from al left join ru using (item)) select audit_set, count(*) n, count(*) filter (truth <> 'indeterminate') n_determinate, count(*) filter (truth = 'indeterminate') n_indeterminate, count(*) filter (final_label = 'extraction_issue') extraction_issue, count(distinct truth) filter (truth <> 'indeterminate') < 2 truth_one_directional, "
    + ", ".join(f"count(*) filter (truth <> 'indeterminate' and {r} = (truth = 'correct')) {r}_agree, count(*) filter (truth = 'wrong' and {r}) {r}_false_pass, count(*) filter (truth = 'correct' and not {r}) {r}_false_fail, false {r}_tautological, (count(*) filter (truth <> 'indeterminate' and {r} = (truth = 'correct'))) / (count(*) filter (truth <> 'indeterminate'))::double {r}_agreement" for r in ("v1", "v2"))
    + ", (count(*) filter (final_label = 'extraction_issue')) / count(*)::double extraction_issue_rate from j group by 1",
    "v1_agreement v2_agreement extraction_issue_rate",
)
def _(s, d):
    long, run = _audits(s, d)
    return audit.set_diagnostics(long, run.select("item", F.col("correct").alias("v1"), "v2"), ["v1", "v2"])


_HV = "case when final_label in ('notation_misread', 'copied_wrong_line', 'hallucination') then false when final_label = 'true_correct' then true when final_label = 'needs_visual' or majority_failed then null else true end"
_CZ = f"cz as (select ru.*, final_label, {_HV} hv from ru left join (select * from au where audit_set = 'census' and final_label <> 'true_wrong') a using (item))"


def _census(s, d):
    return _one(s, d, "census").filter("final_label <> 'true_wrong'"), _audits(s, d)[1]


@query("human_verdicts", f"with {_AU}, {_CZ} select item, hv verdict from cz where final_label is not null")
def _(s, d):
    labels, run = _census(s, d)
    return run.join(labels, "item").select("item", audit.human_verdict(F.col("final_label"), F.col("majority_failed")).alias("verdict"))


@query("apply_correction", f"with {_AU}, {_CZ} select item, final_label is not null was_audited, case when final_label is not null then coalesce(hv, true) else correct end corrected_correct from cz")
def _(s, d):
    labels, run = _census(s, d)
    return audit.corrected(run, labels, True).select("item", "was_audited", "corrected_correct")


_BOUNDS = "select count(*) n, count(*) filter (correct) baseline_correct, avg(correct::int) baseline_accuracy, count(*) filter (case when final_label is not null then coalesce(hv, false) else correct end) corrected_correct_low, count(*) filter (case when final_label is not null then coalesce(hv, true) else correct end) corrected_correct_high, avg((case when final_label is not null then coalesce(hv, false) else correct end)::int) corrected_accuracy_low, avg((case when final_label is not null then coalesce(hv, true) else correct end)::int) corrected_accuracy_high from cz"


@query("corrected_bounds", f"with {_AU}, {_CZ} {_BOUNDS}", "baseline_accuracy corrected_accuracy_low corrected_accuracy_high")
def _(s, d):
    labels, run = _census(s, d)
    return audit.accuracy_bounds(run, labels)


def _w(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / {n}::double)", "1.96"
    centre, half, den = f"({p} + {z} * {z} / (2 * {n}))", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))", f"(1 + {z} * {z} / {n})"
    return f"greatest(0.0, ({centre} - {half}) / {den})", f"least(1.0, ({centre} + {half}) / {den})"


@query("wilson", f"select k, n, {_w('k', 'n')[0]} ci_low, {_w('k', 'n')[1]} ci_high from (select n_nationkey k, n_nationkey + 1 + n_regionkey n from nation)", "ci_low ci_high")
def _(s, d):
    rows = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 1 + F.col("n_regionkey")).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.select("k", "n", low.alias("ci_low"), high.alias("ci_high"))


_FP = f"fp as (select count(*) n_sampled, count(*) filter (final_label = 'extraction_issue') n_false_pass, count(*) filter (final_label = 'true_correct') n_true_correct from au where audit_set = 'spot'), fq as (select *, n_sampled - n_false_pass - n_true_correct n_undecided, n_false_pass / n_sampled::double false_pass_rate, {_w('n_false_pass', 'n_sampled')[0]} ci_low, {_w('n_false_pass', 'n_sampled')[1]} ci_high, n_true_correct / n_sampled::double true_correct_rate, {_w('n_true_correct', 'n_sampled')[0]} tc_low, {_w('n_true_correct', 'n_sampled')[1]} tc_high from fp)"


@query("false_pass_rate", f"with {_AU}, {_FP} select * from fq", "false_pass_rate ci_low ci_high true_correct_rate tc_low tc_high")
def _(s, d):
    return audit.false_passes(_one(s, d, "spot"))


@query("two_sided_bounds", f"with {_AU}, {_CZ}, {_FP}, b as ({_BOUNDS}) select n, baseline_accuracy, false_pass_rate, corrected_correct_low - baseline_correct recovered_low, corrected_correct_high - baseline_correct recovered_high, (baseline_correct * true_correct_rate + corrected_correct_low - baseline_correct) / n accuracy_point, (baseline_correct * tc_low + corrected_correct_low - baseline_correct) / n accuracy_low, (baseline_correct * tc_high + corrected_correct_high - baseline_correct) / n accuracy_high from b, fq", "baseline_accuracy false_pass_rate accuracy_point accuracy_low accuracy_high")
def _(s, d):
    labels, run = _census(s, d)
    return audit.two_sided_bounds(run, labels, _one(s, d, "spot"))


@query("deferral_precision", f"with {_AU}, {_CZ}, x as (select * from cz where final_label is not null), t as (select quantile_cont(h, 0.7::double) threshold from x) select threshold, count(*) filter (h >= threshold) n_flagged, count(*) filter (h >= threshold and not hv) n_real_error, count(*) filter (h >= threshold and hv) n_scoring_failure, count(*) filter (h >= threshold and hv is null) n_unknown, (count(*) filter (h >= threshold and not hv)) / nullif(count(*) filter (h >= threshold and hv is not null), 0)::double precision_real_error, (count(*) filter (not hv)) / count(*)::double base_rate_real_error from x, t group by threshold", "threshold precision_real_error base_rate_real_error")
def _(s, d):
    labels, run = _census(s, d)
    return audit.deferral_precision(run, labels, "h", quantile=0.7)


@query("weighted_labels", f"with {_AU}, {_CZ}, w as (select item, h, coalesce(hv, false) corrected_correct, 'wrong_side' side, 1.0::double weight from cz where final_label is not null union all select ru.item, h, case final_label when 'true_correct' then true else false end, 'correct_side', (select count(*) from ru where correct) / (select count(*) from au where audit_set = 'spot')::double from ru join au using (item) where audit_set = 'spot') select * from w", "h weight")
def _(s, d):
    labels, run = _census(s, d)
    return audit.weighted_labels(run, labels, _one(s, d, "spot"), False).select("item", "h", "corrected_correct", "side", "weight")


@query("spot_check_extension", f"with {_AU}, p as (select item from ru where correct and item not in (select item from au where audit_set = 'spot')) select item, '' final_label from (select * from p order by {sql_key('20260812', 'item')}, item limit 60)")
def _(s, d):
    right = _audits(s, d)[1].filter("correct")
    first = _one(s, d, "spot").select("item").join(right.select("item"), "item", "left_semi")
    return sampling.extension(right, first, "item", 60, 20260812).select("item", F.lit("").alias("final_label"))


_CF = "case when final_label = 'true_correct' then case when correct then 'TP' else 'FN' end when final_label in ('notation_misread', 'copied_wrong_line', 'true_wrong', 'hallucination') then case when correct then 'FP' else 'TN' end when final_label = 'extraction_issue' then case when correct then 'FP' else 'INDETERMINATE' end else 'NEEDS_VISUAL' end"


@query("confusion_cells", f"with {_AU} select {_CF} cell, final_label, count(*) n from au join ru using (item) group by all")
def _(s, d):
    long, run = _audits(s, d)
    cells = long.join(run, "item").select(audit.confusion(F.col("correct"), F.col("final_label")).alias("cell"), "final_label")
    return cells.groupBy("cell", "final_label").agg(F.count("*").alias("n"))


_CELL = "case final_label when 'true_correct' then case when correct then 'TP' else 'FN' end when 'needs_visual' then 'NEEDS_VISUAL' when 'extraction_issue' then case when correct then 'FP' else 'INDETERMINATE' end else case when correct then 'FP' else 'TN' end end"


# the verdict of every 13th item is turned after its cell was given, and every 17th has a cell that there isn't
@query("confusion_violations", f"with {_AU}, ce as (select au.item, audit_set, case when au.item % 17 = 0 then 'ELSE' else {_CELL} end cell, correct <> (au.item % 13 = 0) correct from au join ru on ru.item = au.item) select item, audit_set from ce where cell = 'ELSE' or (cell in ('TP', 'FP') and not correct) or (cell in ('FN', 'TN', 'INDETERMINATE') and correct)")
def _(s, d):
    long, run = _audits(s, d)
    cells = long.join(run, "item").withColumn("cell", audit.confusion(F.col("correct"), F.col("final_label")))
    turned = cells.withColumns({"cell": F.when(F.col("item") % 17 == 0, "ELSE").otherwise(F.col("cell")), "correct": F.col("correct") != (F.col("item") % 13 == 0)})
    return audit.confusion_violations(turned, "cell", "correct").select("item", "audit_set")


# every cell and every reason for a note, in turn
_CELLS = ("FP", "FN", "TN", "INDETERMINATE", "NEEDS_VISUAL", "TP")
_HUMANS = ("notation_misread", "copied_wrong_line", "true_wrong", "hallucination")
_SPANS = (("a long span.", "a long span"), ("a\\, b c", "a b c"), ("abcd", "\\textcolor{red}{abcd}"), (" ab ", "abcd"), ("x +  1", "y + 1"), (None, None))
_LABELS_OF = (("text:xy z", "sympy:x"), ("text:x", "text:x"), ("text:abc", "text:abc"), ("text:a", "text:b"), (None, "text:b"))


def _sql_list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


@query(
    "confusion_note_kinds",
    f"""with i as (select c_custkey k, {_sql_list(_CELLS)}[(c_custkey % 6 + 1)::int] cell, {_sql_list(_HUMANS)}[(c_custkey // 6 % 4 + 1)::int] human, {_sql_list(x for x, _ in _SPANS)}[(c_custkey // 6 % 6 + 1)::int] ms, {_sql_list(x for _, x in _SPANS)}[(c_custkey // 6 % 6 + 1)::int] ts, {_sql_list(x for x, _ in _LABELS_OF)}[(c_custkey // 6 % 5 + 1)::int] ml, {_sql_list(x for _, x in _LABELS_OF)}[(c_custkey // 6 % 5 + 1)::int] tl, c_custkey // 6 % 2 = 0 ok from customer),
n as (select *, trim(regexp_replace(coalesce(ms, ''), '\\s+', ' ', 'g')) sm, trim(regexp_replace(coalesce(ts, ''), '\\s+', ' ', 'g')) st from i)
select k, case when cell = 'FP' and ml = tl and len(split_part(ml, ':', 2)) <= 2 then 'both labels collapse to one symbol; the match is vacuous' when cell = 'FP' and len(trim(coalesce(ms, ''))) <= 3 then 'the extractor picked a 1-3 character span; a match is cheap' when cell = 'FP' then 'scored correct on a span that is not the page''s answer'
when cell = 'FN' and ml like 'text:%' and tl like 'sympy:%' then 'model answered in prose, truth collapsed to a bare symbol, so the two never compare' when cell = 'FN' and contains(st, '\\textcolor') then 'the truth span still carries LaTeX colour markup the model had no way to reproduce'
when cell = 'FN' and rtrim(sm, '.,;') = rtrim(st, '.,;') and sm <> st then 'spans differ only by trailing punctuation' when cell = 'FN' and replace(replace(sm, '\\,', ''), ' ', '') = replace(replace(st, '\\,', ''), ' ', '') then 'spans differ only by LaTeX spacing' when cell = 'FN' then 'the page''s answer is right; the label comparison is what failed'
when cell = 'TN' then case human when 'notation_misread' then 'genuine misread of the handwriting' when 'copied_wrong_line' then 'copied a different line of the page' when 'true_wrong' then 'model answer is wrong on the page''s own terms' else 'human confirms the model was wrong' end
when cell = 'INDETERMINATE' then 'verdict unearned; what the model actually answered is unknown' when cell = 'NEEDS_VISUAL' then 'scorer ' || case when ok then 'passed' else 'failed' end || ' it, but the coder could not read the page: correctness is unknown either way' else 'human confirms the model was correct' end note from n""",
)
def _(s, d):
    k, turn = F.col("c_custkey"), F.floor(F.col("c_custkey") / 6)
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (n % len(values) + 1).cast("int"))
    both = lambda pairs: [pick([p[side] for p in pairs], turn) for side in (0, 1)]
    note = profile.confusion_note(pick(_CELLS, k), pick(_HUMANS, turn), *both(_LABELS_OF), *both(_SPANS), turn % 2 == 0)
    return table(s, d, "customer").select(k.alias("k"), note.alias("note"))


@query("confusion_notes")
def _(s, d):
    long, run = _audits(s, d)
    x = long.join(run, "item").withColumn("cell", audit.confusion(F.col("correct"), F.col("final_label")))
    span = F.concat(F.lit("a\\, b"), (F.col("item") % 3).cast("string"))
    note = profile.confusion_note(F.col("cell"), F.col("final_label"), F.lit("text:x1"), F.lit("text:x1y"), span, F.lit("ab1."), F.col("correct"))
    return x.groupBy("cell", note.alias("note")).agg(F.count("*").alias("n"))


@query(
    "group_metrics",
    f"""with {LB}, p as (select lang, correct v1, not toxic v2, h entropy, fails = 1 parse_failed, h >= 1.6 max_entropy, n_chars % 40 truth_span_len, case item_id % 4 when 0 then 'extraction_issue' when 1 then 'true_correct' end human_label, case item_id % 4 when 1 then 'correct' when 2 then 'wrong' end human_truth from lb), a as ({auroc('p', 'entropy', 'v1', 'lang')})
select lang as "group", count(*) n, avg(v1::int) v1_accuracy, avg(v2::int) v2_accuracy, avg(entropy) mean_entropy, median(entropy) median_entropy, avg(parse_failed::int) parse_failure_rate, avg(max_entropy::int) max_entropy_rate, median(truth_span_len)::double median_truth_span_len, count(human_label) n_human_labelled, (count(*) filter (human_label = 'extraction_issue')) / nullif(count(human_label), 0)::double extraction_issue_rate, count(human_truth) n_human_determinate,
 count(*) filter (human_truth = 'wrong' and v1) false_pass_v1, count(*) filter (human_truth = 'wrong' and v2) false_pass_v2, count(*) filter (human_truth = 'correct' and not v1) false_fail_v1, count(*) filter (human_truth = 'correct' and not v2) false_fail_v2, count(*) / (select count(*) from p)::double share,
 case when least(count(*) filter (v1), count(*) filter (not v1)) < 30 then 'underpowered_minority_' || least(count(*) filter (v1), count(*) filter (not v1)) else 'measured' end auroc_status, case when least(count(*) filter (v1), count(*) filter (not v1)) >= 30 then any_value(a.auroc) end auroc from p join a using (lang) group by lang""",
    "v1_accuracy v2_accuracy mean_entropy median_entropy parse_failure_rate max_entropy_rate median_truth_span_len extraction_issue_rate share auroc",
)
def _(s, d):
    return profile.group_metrics(_profile(s, d), "lang", "v1")


@query("group_metrics_interval")
def _(s, d):
    """With each group's interval of 10,000 draws."""
    return profile.group_metrics_interval(_profile(s, d), "lang", "v1", 10_000)


def _profile(s, d):
    m = F.col("item_id") % 4
    return labelled(s, d).select("lang", F.col("correct").alias("v1"), (~F.col("toxic")).alias("v2"), F.col("h").alias("entropy"), (F.col("fails") == 1).alias("parse_failed"), (F.col("h") >= 1.6).alias("max_entropy"), (F.col("n_chars") % 40).alias("truth_span_len"), F.when(m == 0, "extraction_issue").when(m == 1, "true_correct").alias("human_label"), F.when(m == 1, "correct").when(m == 2, "wrong").alias("human_truth"))


@query("membership_sensitivity", f"with {LB}, f as (select correct, item_id % 3 = 0 fl, item_id % 6 = 0 wk, item_id % 7 = 1 and item_id % 3 <> 0 ms from lb), x as (select count(*) filter (fl) n_flagged, count(*) filter (fl and wk) n_weak, count(*) filter (ms) n_missed, avg(correct::int) filter (fl) as_reported, avg(correct::int) filter (fl and not wk) drop_weak, avg(correct::int) filter ((fl and not wk) or ms) drop_weak_add_missed from f) select *, least(as_reported, drop_weak, drop_weak_add_missed) range_low, greatest(as_reported, drop_weak, drop_weak_add_missed) range_high from x", "as_reported drop_weak drop_weak_add_missed range_low range_high")
def _(s, d):
    i = F.col("item_id")
    rows = labelled(s, d).select("correct", (i % 3 == 0).alias("fl"), (i % 6 == 0).alias("wk"), ((i % 7 == 1) & (i % 3 != 0)).alias("ms"))
    return profile.membership_sensitivity(rows, "correct", "fl", "wk", "ms")


@query(
    "audit_sample",
    f"""with {LB}, w as (select item_id, h, case item_id % 3 when 0 then 'extraction_issue' when 1 then 'needs_visual' else 'hallucination' end l from lb where not correct), m as (select *, unnest(list_filter([case when h < 1e-9 then 0 end, case when h > 1.609438 - 1e-9 then 1 end, case when h >= 1e-9 and h < 0.7 then 2 end, case when l = 'extraction_issue' then 3 end, case when l = 'needs_visual' then 4 end], lambda x: x is not null)) st from w),
r as (select *, row_number() over (partition by st order by {sql_key('0', 'item_id')}, item_id) q from m), k as (select *, row_number() over (partition by item_id order by st) z from r where q <= 6) select item_id, ['unanimous_wrong', 'max_entropy_wrong', 'low_entropy_wrong', 'likely_scoring_artifact', 'needs_visual'][st + 1] stratum from k where z = 1""",
)
def _(s, d):
    m = F.col("item_id") % 3
    wrong = labelled(s, d).filter(~F.col("correct")).withColumn("l", F.when(m == 0, "extraction_issue").when(m == 1, "needs_visual").otherwise("hallucination"))
    return profile.audit_sample(wrong, "item_id", "h", "l", 6, 0, 1.609438).select("item_id", "stratum")


@query("paged_sheet", f"with {LB}, n as (select item_id, lang, row_number() over (partition by lang order by h desc, item_id) - 1 n from lb) select item_id, lang, (n // 9 + 1)::int page, (n % 9 + 1)::int cell from n")
def _(s, d):
    return runs.paged(labelled(s, d), "lang", -F.col("h"), "item_id", 9).select("item_id", "lang", "page", "cell")


# ---- snapshots, cases, provenance ----

_SNAP = "select count(*)::double n_items, avg(correct::int) accuracy, avg(toxic::int) toxicity, avg(h) mean_entropy from lb"


@query("snapshot_long", f"with {LB}, x as ({_SNAP}) select 'n_items' as key, n_items as value from x union all select 'accuracy', accuracy from x union all select 'toxicity', toxicity from x union all select 'mean_entropy', mean_entropy from x", "value")
def _(s, d):
    return runs.long_form(labelled(s, d).agg(F.count("*").alias("n_items"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg(F.col("toxic").cast("int")).alias("toxicity"), F.avg("h").alias("mean_entropy"), F.lit("x").alias("label"), F.lit(True).alias("flag")))


@query(
    "snapshot_diff",
    "with o as (select c_custkey::varchar k, c_acctbal v from customer where c_custkey % 5 <> 1), n as (select c_custkey::varchar k, c_acctbal + case when c_custkey % 3 = 0 then 1.5 else 1e-8 end v from customer where c_custkey % 7 <> 2), j as (select coalesce(o.k, n.k) as key, o.v as old, n.v as new, o.k ok, n.k nk from o full join n on o.k = n.k) "
    "select key, old, new, new - old delta, case when ok is null then 'added' when nk is null then 'removed' else 'changed' end change, key in ('3', '6') is_headline from j where ok is null or nk is null or abs(new - old) > 1e-6",
    "old new delta",
)
def _(s, d):
    c = F.col("c_custkey")
    rows = table(s, d, "customer")
    old = rows.filter(c % 5 != 1).select(c.cast("string").alias("key"), F.col("c_acctbal").alias("value"))
    new = rows.filter(c % 7 != 2).select(c.cast("string").alias("key"), (F.col("c_acctbal") + F.when(c % 3 == 0, 1.5).otherwise(1e-8)).alias("value"))
    return runs.diff(old, new, headline=["3", "6"])


@query("flatten_json", "select 'a' as key, sum(p_size)::double as value from part union all select 'b.c', count(*)::double from part union all select 'b.d.e', 2.5 union all select 'z' || repeat('.z', 11), 7.0", "value")
def _(s, d):
    doc = F.to_json(F.struct(F.col("t").alias("a"), F.struct(F.col("n").alias("c"), F.struct(F.lit(2.5).alias("e"), F.lit(True).alias("flag")).alias("d")).alias("b"), F.lit("x").alias("label"), F.from_json(F.lit('{"z":' * 11 + "7" + "}" * 11), "struct<z:" * 11 + "int" + ">" * 11).alias("z")))
    row = table(s, d, "part").agg(F.sum("p_size").alias("t"), F.count("*").alias("n")).select(doc.alias("j"))
    return runs.flatten_json(row, "j")


@query("case_topk", f"with {LB} select item_id, score from lb where correct order by score desc, item_id limit 12", "score")
def _(s, d):
    return runs.top_cases(labelled(s, d), "correct", True, "score", "item_id", 12).select("item_id", "score")


_HASH = "sha256(coalesce({a}, '') || chr(31) || coalesce({b}, '') || chr(31) || coalesce({c}::varchar, ''))"


@query("content_hash", f"select doc_id, {_HASH.format(a='text', b='lang', c='n_chars')} content_sha256 from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.content_hash(F.col("text"), F.col("lang"), F.col("n_chars")).alias("content_sha256"))


@query("public_manifest", f"with {_AU}, b as (select item, string_agg(distinct audit_set, '|' order by audit_set) a from au group by 1) select c_custkey, c_mktsegment, sha256(c_name) name_sha256, a is not null in_audit_union, coalesce(a, '') audit_sources from customer left join b on item = c_custkey")
def _(s, d):
    return runs.public_view(table(s, d, "customer"), ["c_custkey", "c_mktsegment"], {"name_sha256": F.sha2(F.coalesce("c_name", F.lit("")), 256)}, _audits(s, d)[0], "c_custkey")


@query("manifest_leaks", "select '00001' as pattern, count(*) n_rows from customer where contains(c_name, '00001') or contains(c_mktsegment, '00001') having count(*) > 0 union all select 'BUILD', count(*) from customer where contains(c_name, 'BUILD') or contains(c_mktsegment, 'BUILD') having count(*) > 0")
def _(s, d):
    rows = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return runs.leaks(rows, ["00001", "BUILD", "hf_", "/Users/"], ["c_custkey", "c_name", "c_mktsegment"])


@query("alignment", "select count(*) filter (p_partkey % 100 <> 7) n_aligned, count(*) n_expected, count(*) n_got, false verified from part")
def _(s, d):
    rows = table(s, d, "part")
    other = rows.withColumn("p_name", F.when(F.col("p_partkey") % 100 == 7, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return runs.aligned(other, rows, "p_partkey", ["p_name", "p_brand", "p_size"])


@query("log_prefix_repair", "with b as (select user_id, min(event_id) bad from events where event_id % 83 = 5 group by 1) select e.user_id, e.event_id from events e left join b using (user_id) where bad is null or event_id < bad")
def _(s, d):
    return runs.valid_prefix(table(s, d, "events"), "event_id", F.col("event_id") % 83 != 5, "user_id").select("user_id", "event_id")


# one log an event type, of one JSON entry an event; the damages of an append log at some events, and blank lines after others
_DAMAGES = [(997, 500, "truncated JSON"), (991, 600, "duplicate or gap"), (983, 700, "different source text"), (977, 400, "samples")]
_LOGS = """e as (select event_id, event_type log, row_number() over w - 1 entry, coalesce(sum((event_id % 50 = 0)::int) over (w rows between unbounded preceding and 1 preceding), 0) blanks from events window w as (partition by event_type order by event_id)),
d as (select *, (entry + blanks)::bigint line, case {cases} end damage from e), b as (select log, count(*) n_entries, min(entry) filter (damage is not null) bad, arg_min(line, entry) filter (damage is not null) line, arg_min(damage, entry) filter (damage is not null) damage from d group by log)""".format(
    cases=" ".join(f"when event_id % {m} = {r} then '{name}'" for m, r, name in _DAMAGES)
)


def _event_logs(s, d):
    """Entries of the events' logs, read back from files in their physical order, with each entry parsed in e and the hash that it should have."""
    e = F.col("event_id")
    hit = lambda i: e % _DAMAGES[i][0] == _DAMAGES[i][1]
    rows = runs.places(table(s, d, "events").select("event_id", "event_type", "props"), ["event_type"], F.lit(0), "event_id")
    content = text.content_hash(F.col("props"), e)
    entry = F.to_json(F.struct((F.col("place") + hit(1).cast("int")).alias("item_id"), e.alias("seed"), F.when(hit(2), "0").otherwise(content).alias("content_sha256"), F.transform(F.sequence(F.lit(1), F.when(hit(3), 3).otherwise(4)), lambda k: k.cast("string")).alias("raw_samples")))
    line = F.when(hit(0), F.left(entry, F.lit(20))).otherwise(entry)
    path = scratch_path(s, "event-logs")
    write_lines(rows.select("event_type", "place", F.when(e % 50 == 0, F.concat(line, F.lit("\n "))).otherwise(line).alias("line")), path, "line", ["place"], "event_type")
    parsed = read_lines(s, path, folders=True).withColumn("e", F.from_json("value", f"{SAMPLE_LOG}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}))
    known = table(s, d, "events").select(e.alias("_seed"), content.alias("_hash"))
    return parsed.withColumn("log", F.regexp_extract("log", "event_type=([^/]*)$", 1)).join(known, F.col("e.seed") == F.col("_seed"), "left")


def _log_checks():
    return {"truncated JSON": F.col("e._corrupt").isNull(), "duplicate or gap": F.col("e.item_id") == F.col("entry"), "different source text": F.col("e.content_sha256") == F.col("_hash"), "samples": F.size("e.raw_samples") == 4}


@query("log_file_repair", f"with {_LOGS} select d.log, d.line, d.entry, d.event_id from d join b using (log) where b.bad is null or d.entry < b.bad")
def _(s, d):
    return runs.log_prefix(_event_logs(s, d), _log_checks()).select("log", "line", "entry", F.col("e.seed").alias("event_id"))


@query("log_file_damage", f"with {_LOGS} select log, n_entries, coalesce(bad, n_entries) n_kept, line, damage from b")
def _(s, d):
    return runs.log_damage(_event_logs(s, d), _log_checks())


# labels as the source: its rows are numbered as they lie in their files
_SOURCE = f"src as (select doc_id, toxic = 1 toxic, quality, row_number() over () - 1 source_row_index from labels), c as (select least(1.0::double, count(*) filter (toxic) / 10.0, count(*) filter (not toxic) / 10.0) sc from src), r as (select *, row_number() over (partition by toxic order by {sql_key('7', 'doc_id')}, doc_id) rn from src), t as (select doc_id, toxic, quality, source_row_index from r, c where rn <= floor(10.0 * sc))"


def _source(s, d):
    return read_rows(s, f"{d}/labels.parquet").withColumn("toxic", F.col("toxic") == 1)


@query("balanced_source_rows", f"with {_SOURCE} select doc_id, toxic, source_row_index, (row_number() over (order by {sql_key('7-shuffle', 'doc_id')}, doc_id) - 1)::int review_order from t")
def _(s, d):
    return sampling.balanced(_source(s, d), "toxic", 20, 7, "doc_id").select("doc_id", "toxic", "source_row_index", "review_order")


@query("source_alignment", f"with {_SOURCE} select case when count(*) filter (doc_id % 3 = 1) = 0 and count(*) > 0 then 'VERIFIED' else 'FAILED' end alignment_status, count(*) filter (doc_id % 3 <> 1) n_aligned, count(*) n_expected from t")
def _(s, d):
    """Rows of a sample whose ids don't leave 1 over by 3 are where they say that they are; the others were altered."""
    run = sampling.balanced(_source(s, d), "toxic", 20, 7, "doc_id").withColumn("quality", F.when(F.col("doc_id") % 3 == 1, F.col("quality") + 1).otherwise(F.col("quality")))
    return runs.source_alignment(run, _source(s, d), "source_row_index", ["doc_id", "quality"])


def _manifests(s, d):
    hashed = {"name_sha256": F.sha2(F.coalesce("c_name", F.lit("")), 256)}
    return *runs.manifests(table(s, d, "customer"), "c_custkey", ["c_mktsegment"], hashed, ["c_name", "c_acctbal"], _audits(s, d)[0]), hashed


@query("private_manifest", "select c_custkey, c_name, c_acctbal from customer", "c_acctbal")
def _(s, d):
    return _manifests(s, d)[1]


@query("manifest_agreement", "select count(*) n_public, count(*) filter (c_custkey % 50 <> 9) n_private, count(*) filter (c_custkey % 50 <> 9 and c_custkey % 100 <> 7) n_agree, false verified from customer")
def _(s, d):
    """A private view that lacks some items and has other texts for others."""
    public, private, hashed = _manifests(s, d)
    other = private.filter(F.col("c_custkey") % 50 != 9).withColumn("c_name", F.when(F.col("c_custkey") % 100 == 7, "else").otherwise(F.col("c_name")))
    return runs.manifests_agree(public, other, "c_custkey", hashed)


@query(
    "sheet_problems",
    "select 'confidence' problem, 'unsure' as value from customer where c_custkey % 50 = 3 having count(*) > 0 union all select distinct 'unknown_id', (c_custkey + 100000)::varchar from customer where c_custkey % 400 = 9 union all select 'duplicate_id', c_custkey::varchar from customer where c_custkey % 300 = 4",
)
def _(s, d):
    c = F.col("c_custkey")
    rows = table(s, d, "customer").select(F.when(c % 400 == 9, c + 100000).otherwise(c).alias("id"), F.when(c % 50 == 3, "unsure").when(c % 2 == 0, " high ").otherwise("").alias("confidence"))
    twice = rows.unionByName(rows.filter(F.col("id") % 300 == 4))
    # ids that the sheet gets wrong are of no item, also where there are so many customers that one has the wrong number
    known = table(s, d, "customer").filter(c % 400 != 9).select(c.alias("id"))
    return runs.vocabulary_problems(twice, "id", known, {"confidence": ["high", "medium", "low"]})


@query(
    "sheet_report",
    "with r as (select case when c_custkey % 400 = 9 then c_custkey + 100000 else c_custkey end id, case when c_custkey % 50 = 3 then 'unsure' when c_custkey % 2 = 0 then ' high ' else '' end confidence from customer), t as (select * from r union all select * from r where id % 300 = 4), g as (select id, count(*) n from t group by 1) "
    "select (select count(*) from t) n_rows, (select count(*) from t where trim(confidence) <> '') n_answered, (select count(*) from g where n > 1) n_duplicate_ids, (select count(*) from g where id not in (select c_custkey from customer)) n_unknown_ids, (select count(*) from t where confidence = 'unsure') n_bad_confidence, false ok",
)
def _(s, d):
    c = F.col("c_custkey")
    rows = table(s, d, "customer").select(F.when(c % 400 == 9, c + 100000).otherwise(c).alias("id"), F.when(c % 50 == 3, "unsure").when(c % 2 == 0, " high ").otherwise("").alias("confidence"))
    return runs.sheet_report(rows.unionByName(rows.filter(F.col("id") % 300 == 4)), "id", table(s, d, "customer").select(c.alias("id")), {"confidence": ["high", "medium", "low"]}, "confidence")


_RANKED = "select '{c}' category, item_id, h from (select item_id, h from lb where {w} order by h {o}, item_id limit 6)"


@query(
    "case_selection",
    f"with {LB} " + " union all ".join(_RANKED.format(c=c, w=w, o=o) for c, w, o in (("low_entropy_correct", "correct", "asc"), ("high_entropy_wrong", "not correct", "desc"), ("high_entropy_correct", "correct", "desc"), ("low_entropy_wrong", "not correct", "asc"), ("confidently_wrong_grading", "not correct", "asc")))
    + " union all select 'max_entropy_degenerate', item_id, h from (select * from lb where h > 1.6 and not correct order by item_id limit 6) union all select 'non_engagement_says_error', item_id, h from (select * from lb where fails = 1 order by item_id limit 6)",
    "h",
)
def _(s, d):
    """Six cases of every category, the text-defined one by a predicate."""
    from functools import reduce

    x = labelled(s, d).withColumn("h", F.when(F.col("h") > 1.6, F.log(F.lit(5.0))).otherwise(F.col("h")))
    picked = [cases.select(x, c, "h", "correct", "item_id", 6).withColumn("category", F.lit(c)) for c in (*cases.SELECTED, "max_entropy_degenerate")]
    picked.append(cases.select(x, "non_engagement_says_error", "h", "correct", "item_id", 6, predicate=F.col("fails") == 1).withColumn("category", F.lit("non_engagement_says_error")))
    return reduce(lambda a, b: a.unionByName(b), picked).select("category", "item_id", F.round("h", 6).alias("h"))


@query("blank_answers", "select c_custkey item, c_custkey % 6 in (0, 1) blank from customer")
def _(s, d):
    c = F.col("c_custkey")
    rows = table(s, d, "customer").select(c.alias("item"), F.when(c % 2 == 0, " ").when(c % 6 != 1, "x").alias("a"), F.when(c % 3 != 0, F.when(c % 6 != 1, 1)).alias("b"))
    return rows.select("item", sampling.is_blank(["a", "b"]).alias("blank"))


@query("truth_words", "select c_custkey item, c_custkey % 6 in (0, 1, 2) truth from customer")
def _(s, d):
    c = F.col("c_custkey")
    word = F.when(c % 6 == 0, " True ").when(c % 6 == 1, "1").when(c % 6 == 2, "YES").when(c % 6 == 3, "False").when(c % 6 == 4, "")
    return table(s, d, "customer").select(c.alias("item"), text.as_bool(word).alias("truth"))


# ---- semantic clusters ----

_CH = "ch as (select vec_id // 5 item_id, vec_id % 5 pos, embedding e, label from embeddings)"
_CC = f"{_CH}, ed as (select a.item_id, a.pos i, b.pos j from ch a join ch b on a.item_id = b.item_id and a.pos < b.pos where list_cosine_similarity(a.e::double[], b.e::double[]) >= 0.1), bi as (select item_id, i, j from ed union all select item_id, j, i from ed union all select item_id, pos, pos from ch)"


@query("cosine_clusters", f"with recursive {_CC}, rc as (select item_id, pos, pos root from ch union select bi.item_id, bi.j, rc.root from rc join bi on bi.item_id = rc.item_id and bi.i = rc.pos) select item_id, pos, min(root) as cluster from rc group by all")
def _(s, d):
    rows = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("item_id"), (F.col("vec_id") % 5).alias("pos"), "embedding")
    return semantic.embedding_clusters(rows, ["item_id"], "embedding", 0.1).select("item_id", F.col("pos").cast("long").alias("pos"), F.col("cluster").cast("long").alias("cluster"))


@query("greedy_clusters", f"with {EV} select item_id, pos, min(pos) over (partition by item_id, left(label, 1)) as cluster from sm")
def _(s, d):
    return semantic.greedy(event_votes(s, d)[0], ["item_id"], "label", lambda a, b: a[0] == b[0])


@query("inference_edges", "select event_id, event_id % 3 = 1 and event_id % 2 = 1 linked from events")
def _(s, d):
    one = lambda m: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.when(k == m, 0.9).otherwise(0.05))
    e = F.col("event_id")
    return table(s, d, "events").select("event_id", semantic.agreed(one(e % 3), one(F.when(e % 2 == 1, 1).otherwise(2))).alias("linked"))


@query("comparable_samples", r"select conv_id, turn, coalesce(len(regexp_replace(text, '\s+', '', 'g')) > 0, false) comparable from conversations")
def _(s, d):
    return semantic.comparable(table(s, d, "conversations")).select("conv_id", "turn", "comparable")


@query("disagreement_queue", f"with {LB} select item_id, case when not toxic then 'string_wrong_mv_right' else 'string_right_mv_wrong' end direction from lb where correct = toxic")
def _(s, d):
    x = labelled(s, d).filter(F.col("correct") != ~F.col("toxic"))
    return x.select("item_id", F.when(~F.col("toxic"), "string_wrong_mv_right").otherwise("string_right_mv_wrong").alias("direction"))


# ---- relational forms ----


@query("pivot_counts", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') \"F\", count(*) filter (o_orderstatus = 'O') \"O\", count(*) filter (o_orderstatus = 'P') \"P\" from orders group by 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("value_shares", "select event_type, count(*) n, count(*) / (select count(*) from events)::double share from events group by 1", "share")
def _(s, d):
    counts = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("event_type", "n", ratio(F.col("n"), F.col("all")).alias("share"))


@query("keep_first", "select doc_id, text, lang, source, n_chars from (select *, row_number() over (partition by text, lang order by doc_id) n from documents) where n = 1")
def _(s, d):
    return runs.keep_first(table(s, d, "documents"), ["text", "lang"], "doc_id")


@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("keys_disjoint", "select (select count(distinct c_custkey) from customer where c_custkey in (select o_custkey from orders)) n_shared, (select count(*) from customer where c_custkey not in (select o_custkey from orders)) n_only_left")
def _(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    shared = c.join(o, "c_custkey", "left_semi").agg(F.count_distinct("c_custkey").alias("n_shared"))
    return shared.join(F.broadcast(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("n_only_left"))))


@query("append_samples", f"with {EV} select item_id, string_agg(label, ',' order by pos) samples, string_agg(label, ',' order by pos) filter (pos < 3) prefix from ev where pos < 10 group by 1")
def _(s, d):
    samples, _truth = event_votes(s, d, 10)
    both = samples.groupBy("item_id").agg(*(F.sort_array(F.collect_list(F.when(c, F.struct("pos", "label")))).alias(n) for n, c in (("a", F.col("pos") < 5), ("b", F.col("pos") >= 5))))
    whole = F.concat("a.label", "b.label")
    return both.select("item_id", F.array_join(whole, ",").alias("samples"), F.array_join(F.slice(whole, 1, 3), ",").alias("prefix"))


@query("label_conflicts", f"with {EV} select a.item_id, count(*) n_pairs from sm a join sm b on a.item_id = b.item_id and a.pos < b.pos where a.label = b.label and a.pos % 2 <> b.pos % 2 group by 1")
def _(s, d):
    samples = event_votes(s, d)[0]
    linked = semantic.edges(samples.withColumn("v", F.struct("label", (F.col("pos") % 2).alias("p"))), ["item_id"], "v", lambda a, b: (a["label"] == b["label"]) & (a["p"] != b["p"]))
    return linked.groupBy("item_id").agg(F.count("*").alias("n_pairs"))


@query("percentiles", "select l_returnflag, quantile_cont(l_extendedprice, 0.025::double) low, median(l_extendedprice) mid, quantile_cont(l_extendedprice, 0.975::double) high from lineitem group by 1", "low mid high")
def _(s, d):
    return ranking.quantiles(table(s, d, "lineitem"), "l_extendedprice", {"low": 0.025, "mid": 0.5, "high": 0.975}, ["l_returnflag"])


@query("poststratified", f"with {LB}, c as (select lang, count(*) / (select count(*) from documents)::double f from documents group by 1), a as (select lang, avg(correct::int) a from lb group by 1) select sum(f * a) accuracy from c join a using (lang)", "accuracy")
def _(s, d):
    docs = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    share = docs.join(F.broadcast(docs.agg(F.sum("n").alias("all")))).select("lang", ratio(F.col("n"), F.col("all")).alias("f"))
    rates = labelled(s, d).groupBy("lang").agg(F.avg(F.col("correct").cast("int")).alias("a"))
    return share.join(rates, "lang").agg(F.sum(F.col("f") * F.col("a")).alias("accuracy"))


@query("phrase_rates", "select lang, avg(regexp_matches(lower(text), 'licen[sc]e|copyright')::int) rate, count(*) n from documents group by 1", "rate")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.avg(F.lower("text").rlike("licen[sc]e|copyright").cast("int")).alias("rate"), F.count("*").alias("n"))


@query("mean_confidence", "select user_id, -avg(value) neg_mean from events group by 1", "neg_mean")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg((-F.avg("value")).alias("neg_mean"))


@query("homogeneous_flags", "select o_orderpriority, count(distinct o_orderstatus) n_values, count(distinct o_orderstatus) = 1 homogeneous from orders group by 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("n_values"), (F.count_distinct("o_orderstatus") == 1).alias("homogeneous"))


@query("majority_guard", f"with {EV} select item_id, count(*) filter (label = 'view') > count(*) / 2.0 by_count, (list(label order by n desc, f))[1] = 'view' by_majority from sm join (select item_id, label, n, f from cn) using (item_id, label) group by 1")
def _(s, d):
    samples = event_votes(s, d)[0]
    counts = samples.groupBy("item_id").agg((F.count_if(F.col("label") == "view") > F.count("*") / 2.0).alias("by_count"))
    return counts.join(event_run(s, d).select("item_id", (F.col("majority") == "view").alias("by_majority")), "item_id")





@query(
    "queue_summary",
    f"with {LB}, i as (select item_id in (3, 11) ch from lb) select * from (select 'challenge' queue, count(*) filter (ch) n, true disjoint from i union all select 'core', least(90, count(*) filter (not ch)), true from i union all select 'extension', count(*) filter (not ch) - 90, true from i) where n > 0",
)
def _(s, d):
    stratum = F.concat_ws("|", sampling.entropy_bin(F.col("h")), "lang")
    queue = sampling.queue(labelled(s, d).select("item_id", stratum.alias("stratum")), "item_id", "stratum", 90, 20260814, [3, 11])
    return sampling.queue_counts(queue, "item_id")


@query("blank_template", f"with {LB} select printf('R%04d', row_number() over (order by {sql_key('20260814-review', 'item_id')}, item_id) - 1) review_id, 'v1' protocol_version, '' model_correctness, '' confidence, '' evidence_note, true all_blank from lb")
def _(s, d):
    queue = sampling.queue(labelled(s, d).select("item_id", F.col("lang").alias("stratum")), "item_id", "stratum", 90, 20260814)
    fields = ["model_correctness", "confidence", "evidence_note"]
    return sampling.template(queue, "v1", fields).withColumn("all_blank", sampling.is_blank(fields))


@query(
    "tile_notes",
    f"with {LB} select item_id, case when not correct and n_chars % 4 = 0 then 'prose conclusion; strict matching cannot score a sentence' when not correct and n_chars % 9 <= 2 then 'tiny truth span; a coincidental match or miss is cheap here' when h > 1.6 then 'all five samples differ; entropy at its ceiling' when fails = 1 then 'at least one sample failed to parse' when correct <> (not toxic) then 'the two rules disagree on this item' when correct then 'scored correct by both rules' else 'scored wrong; span and label shown for comparison' end note from lb",
)
def _(s, d):
    x = labelled(s, d)
    kind = F.when(F.col("n_chars") % 4 == 0, "text_conclusion").otherwise("numeric")
    span = F.repeat(F.lit("x"), (F.col("n_chars") % 9 + 1).cast("int"))
    return x.select("item_id", profile.tile_note(F.lit("text:abc"), F.lit("text:abd"), span, kind, F.col("correct"), ~F.col("toxic"), F.col("h") > 1.6, F.col("fails") == 1).alias("note"))
