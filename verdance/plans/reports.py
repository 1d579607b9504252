"""Queries: sheets for people, span scoring of a run, judges' diagnostics, guards, whole-run snapshots."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cases, judging, ranking, runs, semantic, sheets, snapshots, votes
from ..sources.tables import event_votes, labelled, responses, table
from .audits import _AU, _LABELS, _audits
from .registry import query
from .sql import EV, LB, RS, SC, auroc, curve, extract_final, normal_span, tier, hash_key as sql_key
from .texts import _FLAG_NAMES, _FLAGS, _TYPE, RULE_LABELS, RULE_VERDICTS

_SCORED = f"with {RS}, {SC}, {RULE_LABELS}, {RULE_VERDICTS}"
KEYS = ["item_id"]


def _spans(s, d):
    return sheets.span_scores(*responses(s, d), KEYS)


# ---- strict_v2 over a run ----


_PAREN = r"(?i)\(\s*[a-d]\s*\)[^\n]{0,60}\(\s*[b-e]\s*\)"  # fixed value of the rule
_ANY = " or ".join(_FLAG_NAMES)
#: From the responses to the verdicts: spans and labels of both sides, flags a side, then an item. v2 has a row an item.
_V2 = rf"""with {RS}, {SC}, sp as (select *, case when fin is null then '<PARSE_FAILURE>' else {normal_span("fin")} end nm from (select item_id, pos, field, {extract_final("field")} fin, {tier("field")} tier from pr)),
mc as (select item_id, nm, count(*) n, min(pos) f from sp group by all), mv as (select item_id, abs(round(ln(sum(n)::double) - sum(n * ln(n::double)) / sum(n)::double, 12)) span_entropy, (list(nm order by n desc, f))[1] model_span_norm from mc group by 1),
md as (select item_id, span_entropy, model_span_norm, arg_min(struct_pack(s := fin, l := lab, t := tier), pos) m from sp join mv using (item_id) join (select item_id, pos, lab from sl) using (item_id, pos) where nm = model_span_norm group by all),
tt as (select item_id, question, truth, has_error, truth_span, {normal_span("truth_span")} truth_span_norm, {tier("truth")} truth_tier from (select *, {extract_final("truth")} truth_span from od)),
it as (select sc.item_id, sc.entropy, span_entropy, question, tt.has_error, m.s model_span, m.l model_label, m.t model_tier, truth, truth_span, sc.truth_label, truth_tier, model_span_norm, truth_span_norm, sc.correct correct_v1, sc.n_parse_failures,
  model_span_norm = truth_span_norm and truth_span_norm <> '' correct_v2, regexp_matches(concat_ws(' ', question, truth_span, truth), '(?i)\boption\b') or regexp_matches(concat_ws(' ', question, truth_span, truth), '{_PAREN}') is_mcq from sc join md using (item_id) join tt using (item_id)),
fx as (select item_id, is_mcq, 'm' side, coalesce(model_span, '') span, {normal_span("model_span")} bare, coalesce(regexp_replace(model_label, '^[^:]*:', ''), '') payload from it union all select item_id, is_mcq, 't', coalesce(truth_span, ''), truth_span_norm, coalesce(regexp_replace(truth_label, '^[^:]*:', ''), '') from it),
{_FLAGS}, fe as (select item_id, {", ".join(f"bool_or({f}) {f}" for f in _FLAG_NAMES)} from fm group by 1),
v2 as (select *, correct_v1 <> correct_v2 rules_disagree from it join fe using (item_id)),
rk as (select *, case when rules_disagree or tiny_suspicious_non_mcq or multi_answer_collapse or sympy_partial_parse_risk or sympy_malformed_derivative then 'high' when multi_value_answer or set_answer or system_answer or derivative_equation or text_conclusion then 'medium' else 'low' end priority from v2 where rules_disagree or {_ANY})"""
_SIDE = "model_span, model_label, model_tier, truth_span, truth_label, truth_tier, model_span_norm, truth_span_norm"


@query("span_scores", f"{_V2} select item_id, entropy, span_entropy, {_SIDE}, correct_v1, correct_v2, is_mcq, {', '.join(_FLAG_NAMES)} from v2", "entropy span_entropy")
def _(s, d):
    return _spans(s, d).drop("question", "truth_field")


@query("span_verdicts", f"{_SCORED} select sc.item_id, sc.entropy, sc.correct correct_v1 from sc", "entropy")
def _(s, d):
    return _spans(s, d).select("item_id", "entropy", "correct_v1")


@query(
    "accuracy_summary",
    f"{_V2} select count(*) n, count(*) filter (correct_v1) v1_correct, avg(correct_v1::int) v1_accuracy, count(*) filter (correct_v2) v2_correct, avg(correct_v2::int) v2_accuracy, count(*) filter (rules_disagree) n_disagree, count(*) filter (correct_v1 and not correct_v2) v1_only_correct, count(*) filter (correct_v2 and not correct_v1) v2_only_correct, "
    f"{', '.join(f'count(*) filter ({f}) n_{f}' for f in _FLAG_NAMES)} from v2",
    "v1_accuracy v2_accuracy",
)
def _(s, d):
    return sheets.accuracy_summary(_spans(s, d))


@query("risk_sheet_run", f"{_V2} select item_id, rules_disagree, priority, '' final_label, '' confidence, '' note from rk")
def _(s, d):
    return sheets.risk_sheet(_spans(s, d), "item_id").select("item_id", "rules_disagree", "priority", "final_label", "confidence", "note")


@query("audit_sheet", f"{_V2} select item_id, printf('images/item%03d.png', item_id) image_path, priority, model_span span_m_disp, truth_span span_t_disp, model_label label_m, truth_label label_t, correct_v1 strict_v1_correct, correct_v2 strict_v2_correct, rules_disagree, {', '.join(_FLAG_NAMES)}, '' final_label, '' confidence, '' note from rk where priority = 'high'")
def _(s, d):
    return sheets.audit_sheet(sheets.risk_sheet(_spans(s, d), "item_id"), "item_id")


_EITHER = "case when mcq_option or tiny_valid_mcq then 'mcq_option' when set_answer then 'set_answer' when system_answer then 'system_answer' when derivative_equation then 'derivative_equation' when multi_value_answer then 'multi_value' when text_conclusion then 'text_conclusion' else 'numeric_or_expression' end"


@query(
    "item_profile",
    f"{_V2}, ty as (select item_id, {_TYPE} answer_type from fm where side = 't') select item_id, has_error, correct_v1 strict_v1_correct, correct_v2 strict_v2_correct, answer_type, case when is_mcq then 'mcq' else 'free_response' end question_type_if_available, entropy, n_parse_failures > 0 parse_failed, entropy >= max(entropy) over () - 1e-9 max_entropy, "
    "model_span span_m_disp, truth_span span_t_disp, model_label label_m, truth_label label_t, '' human_label_if_available, '' human_truth_if_available, '' extraction_status_if_available, '' error_location_if_available, '' error_type_if_available, '' image_path_if_available, 0 n_red_spans, '' red_spans_approx_only, "
    f"{_EITHER} answer_type_either_side, len(coalesce(truth_span, ''))::int truth_span_len, len(coalesce(model_span, ''))::int model_span_len from v2 join ty using (item_id)",
    "entropy",
)
def _(s, d):
    samples, orders = responses(s, d)
    return sheets.item_profile(orders, sheets.span_scores(samples, orders, KEYS, full=True), "item_id")


_NAMED = ", ".join(f"case when {f} then '{f}' end" for f in _FLAG_NAMES[:8])


@query(
    "choice_review",
    rf"{_V2}, tg as (select *, concat_ws(',', case when regexp_matches(question, '(?i)\boption\b') then 'question' end, case when regexp_matches(truth_span, '(?i)\boption\b') then 'truth_span' end, case when regexp_matches(truth, '(?i)\boption\b') then 'answer_field' end) option_word_in, regexp_matches(question, '\\begin\{{enumerate\}}|\\item\b') ql, "
    rf"left(regexp_extract(concat_ws(' ', coalesce(question, ''), coalesce(truth_span, ''), coalesce(truth, '')), '{_PAREN}'), 60) pl from v2), pg as (select *, case when option_word_in <> '' and ql then 'option_word_and_choice_list' when option_word_in <> '' then 'option_word_only' when ql then 'choice_list_only' when pl <> '' then 'paren_letters_only' else 'not_flagged' end presort from tg), "
    "ch as (select *, case when is_mcq then 'flagged_mcq_like' else 'candidate_missed' end mcq_group, list_position(['option_word_and_choice_list', 'option_word_only', 'choice_list_only', 'paren_letters_only'], presort) o from pg where is_mcq or presort = 'choice_list_only'), nb as (select *, row_number() over (partition by mcq_group order by o, item_id) - 1 n from ch) "
    "select item_id, mcq_group, presort, is_mcq heuristic_mcq_like, '' confirmed_mcq, '' reviewer_note, has_error, correct_v1 strict_v1_correct, correct_v2 strict_v2_correct, entropy, model_span span_m_disp, truth_span span_t_disp, model_label label_m, truth_label label_t, model_tier, truth_tier, "
    f"concat_ws(',', {_NAMED}) flags, option_word_in, is_mcq and option_word_in = '' flagged_by_weak_trigger_only, ql question_has_choice_list, pl paren_letters_match, left(question, 160) question_head, "
    "case when mcq_group = 'flagged_mcq_like' then 'mcq_flagged' else 'mcq_candidate_missed' end || '_p' || (n // 9 + 1) || '.png' contact_sheet_file, (n % 9 + 1)::int contact_sheet_cell from nb",
    "entropy",
)
def _(s, d):
    return sheets.choice_review(_spans(s, d), responses(s, d)[1], "item_id")


# ---- audits ----


@query("spot_check", f"{_SCORED} select item_id item, entropy, category = 'false_pass_removed' known_false_pass, '' final_label, '' confidence, '' note from cat4 where v1 order by {sql_key('20260811', 'item_id')}, item_id limit 40", "entropy")
def _(s, d):
    return sheets.spot_check(votes.classified(*responses(s, d), KEYS, 5), "item_id", 40, 20260811)


@query("unrecoverable_items", f"{_SCORED} select item_id item from votes4 where rule = 'strict_v1' and label = '<parse_failure>' and item_id % 7 = 5")
def _(s, d):
    samples, orders = responses(s, d)
    labels = F.element_at(F.array(*(F.lit(x) for x in _LABELS)), (F.col("item_id") % 7 + 1).cast("int"))
    return sheets.unrecoverable(votes.classified(samples, orders, KEYS, 5), orders.select(F.col("item_id").alias("item"), labels.alias("final_label")), "item_id")


@query("majority_answer", f"{_SCORED} select l.item_id, coalesce(arg_min(struct_pack(f := l.field), l.pos).f, '') answer from sl l join sv using (item_id) where l.lab = sv.majority group by 1")
def _(s, d):
    return sheets.majority_field(responses(s, d)[0], KEYS)


_CELL = "case final_label when 'true_correct' then case when correct then 'TP' else 'FN' end when 'needs_visual' then 'NEEDS_VISUAL' when 'extraction_issue' then case when correct then 'FP' else 'INDETERMINATE' end else case when correct then 'FP' else 'TN' end end"


@query(
    "confusion_examples",
    f"with {_AU}, ce as (select au.item, {_CELL} cell, final_label, repeat('x', (au.item % 6)::int) sp, list_position(case {_CELL} when 'TP' then [30, 15] when 'FP' then [12] else []::int[] end, au.item) ask from au join ru on ru.item = au.item where audit_set = 'census' and au.item not in (7, 9)), cf as (select *, ask is not null and ask > 0 fst from ce), sz as (select cell, final_label, count(*) z from cf where not fst group by all), "
    f"t as (select *, case when fst then 0 else row_number() over (partition by cell, fst, final_label order by cell = 'TP' and len(sp) < 4, {sql_key('7', 'item')}, item) end tn from cf left join sz using (cell, final_label)), "
    "p as (select *, row_number() over (partition by cell order by tn, case when fst then ask else 0 end, coalesce(z, 0), final_label, item) pl from t where tn <= 6), q as (select *, row_number() over (partition by cell order by case when fst then ask else 1000 end, item) - 1 n from p where pl <= 6) "
    "select item, cell, final_label, sp, 'confusion_' || cell || '_p' || (n // 4 + 1) || '.png' contact_sheet_file, (n % 4 + 1)::int contact_sheet_cell from q",
)
def _(s, d):
    from ..operators import audit

    sets, run = _audits(s, d)
    x = sets.filter("audit_set = 'census'").join(run, "item").withColumn("cell", audit.confusion(F.col("correct"), F.col("final_label"))).withColumn("sp", F.repeat(F.lit("x"), (F.col("item") % 6).cast("int")))
    return sheets.confusion_examples(x.select("item", "cell", "final_label", "sp"), "item", "cell", "final_label", "sp", 6, 7, {"TP": [30, 15], "FP": [12]}, 4, [7, 9])


@query(
    "judge_sample",
    "with x as (select c_custkey item, c_custkey % 2 = 0 e, ['derivative', 'mcq', 'numeric_or_algebra', 'set'][(c_custkey % 4 + 1)::int] shape, c_custkey % 3 = 0 lb, c_custkey in (5, 8) forced from customer), "
    f"t as (select *, case when forced then 0 else row_number() over (partition by e, forced, shape order by (not lb)::int, {sql_key('3', 'item')}, item) end tn from x), p as (select *, row_number() over (partition by e order by tn, list_position(['derivative', 'mcq', 'multi_value', 'set', 'system', 'text_conclusion', 'numeric_or_algebra'], shape), item) pl from t where tn <= 20) select item, e, shape, forced from p where pl <= 20",
)
def _(s, d):
    c = F.col("c_custkey")
    shape = F.element_at(F.array(*(F.lit(x) for x in ("derivative", "mcq", "numeric_or_algebra", "set"))), (c % 4 + 1).cast("int"))
    rows = table(s, d, "customer").select(c.alias("item"), (c % 2 == 0).alias("e"), shape.alias("shape"), (c % 3 == 0).alias("lb"))
    return sheets.judge_sample(rows, "item", "e", "shape", "lb", 20, 3, [5, 8]).select("item", "e", "shape", "forced")


@query("kept_answers", "select c_custkey item, c_name title, case when c_custkey % 5 = 0 then 'yes' else '' end confirmed, case when c_custkey % 4 = 0 then 'n' || c_custkey else '' end remark from customer")
def _(s, d):
    c = F.col("c_custkey")
    new = table(s, d, "customer").select(c.alias("item"), F.col("c_name").alias("title"), F.lit("").alias("confirmed"), F.lit("").alias("remark"))
    old = table(s, d, "customer").filter((c % 5 == 0) | (c % 4 == 0)).select(c.alias("item"), F.when(c % 5 == 0, "yes").alias("confirmed"), F.when(c % 4 == 0, F.concat(F.lit("n"), c.cast("string"))).alias("remark"))
    return sheets.keep_answers(new, old, "item", ["confirmed", "remark"], "confirmed")


# ---- texts ----


@query(
    "difference_views",
    "with n as (select n_nationkey k, n_name || ' of the region' a, case n_nationkey % 4 when 0 then n_name || ' of the region' when 1 then n_name when 2 then n_name || ' of the region and more' else replace(n_name, 'A', '#') || ' of the region' end b from nation), "
    "p as (select *, coalesce((list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]))[1] - 1, least(len(a), len(b))) i from n where a <> b) "
    "select k, i::int as at, case when len(a) > i then substr(a, i + 1, 1) else '<end>' end model, case when len(b) > i then substr(b, i + 1, 1) else '<end>' end truth, substr(a, greatest(0, i - 15) + 1, i + 15 - greatest(0, i - 15)) around_model, substr(b, greatest(0, i - 15) + 1, i + 15 - greatest(0, i - 15)) around_truth, "
    "case when i >= least(len(a), len(b)) then case when len(a) > len(b) then 'model is longer; the other ends here' else 'truth is longer; the other ends here' end end note from p",
)
def _(s, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    a = F.concat(name, F.lit(" of the region"))
    b = F.when(k % 4 == 0, a).when(k % 4 == 1, name).when(k % 4 == 2, F.concat(a, F.lit(" and more"))).otherwise(F.concat(F.replace(name, F.lit("A"), F.lit("#")), F.lit(" of the region")))
    x = table(s, d, "nation").select(k.alias("k"), sheets.difference_view(a, b).alias("v")).filter("v is not null")
    return x.select("k", F.col("v.index").alias("at"), "v.model", "v.truth", F.col("v.context_model").alias("around_model"), F.col("v.context_truth").alias("around_truth"), "v.note")


@query("stored_samples", "select event_id, event_id % 2 first_digit, (event_id % 3 = 0)::int second_digit, 'a' || event_id answer from events")
def _(s, d):
    e = F.col("event_id")
    graded = F.concat(F.lit("['**Error:** "), (e % 2).cast("string"), F.lit("', '**Error:** "), F.when(e % 3 == 0, "1").otherwise("0"), F.lit("']"))
    read = F.to_json(F.array(F.concat(F.lit("**Answer:** a"), e.cast("string"))))
    x = table(s, d, "events").select("event_id", sheets.grading_samples(graded, "grading").alias("g"), sheets.grading_samples(read, "transcription").alias("t"))
    return x.select("event_id", F.col("g")[0].alias("first_digit"), F.col("g")[1].alias("second_digit"), F.col("t")[0].alias("answer"))


@query("case_index")
def _(s, d):
    samples, orders = responses(s, d)
    return sheets.case_index(cases.bundles(cases.trace(samples, orders, KEYS).filter("correct and entropy > 1"), "high_entropy_correct", "run", "a note"), "item_id")


# ---- clusters ----


def _entailed(s, d):
    """Samples clustered by a stub of an inference model: two entail each other if they have one label."""
    samples = event_votes(s, d)[0]
    linked = semantic.model_edges(samples, KEYS, "label", lambda: lambda pairs: [[0.1, 0.8, 0.1] if a == b else [0.8, 0.1, 0.1] for a, b in pairs])
    return samples, semantic.components(samples, linked, KEYS)


@query("inference_labels", f"with {EV} select item_id, pos, (min(pos) over (partition by item_id, label))::int as cluster from sm")
def _(s, d):
    return _entailed(s, d)[1].select("item_id", "pos", "cluster")


@query("cluster_scores", f"with {EV} select item_id, n_distinct n_clusters, entropy, majority_count, coalesce(majority = truth, false) correct from vt join tr using (item_id)", "entropy")
def _(s, d):
    samples, clusters = _entailed(s, d)
    truths = event_votes(s, d)[1]
    rows = clusters.join(samples.select("item_id", F.col("pos").cast("int").alias("pos"), "label"), ["item_id", "pos"]).join(truths, KEYS)
    return sheets.scored_clusters(rows, KEYS, F.col("label") == F.col("truth"))


@query("scorer_disagreements", f"with {LB} select item_id, case when not toxic then 'string_wrong_mv_right' else 'string_right_mv_wrong' end direction from lb where correct = toxic")
def _(s, d):
    x = labelled(s, d)
    return sheets.disagreements(x.select("item_id", "correct"), x.select("item_id", (~F.col("toxic")).alias("correct")), KEYS)


# ---- judges ----


@query(
    "open_diagnostics",
    "with r as (select c_custkey k, c_custkey % 2 = 0 v1, c_custkey % 3 = 0 v2, c_custkey % 7 < 3 e, case c_custkey % 4 when 0 then 'correct' when 1 then 'unclear' else 'incorrect' end a, case c_custkey % 5 when 0 then 'unclear' when 1 then 'incorrect' else 'correct' end b from customer), "
    "l as (select st.s stratum, pr.p from r, lateral (select unnest(['all', case when e then 'has_error' else 'clean' end]) s) st, lateral (select unnest([['a', 'v1', a, v1::varchar], ['a', 'v2', a, v2::varchar], ['b', 'v1', b, v1::varchar], ['b', 'v2', b, v2::varchar]]) p) pr), "
    "m as (select p[1] judge, p[2] rule, stratum, p[3] v, p[4] = 'true' r from l) select judge, rule, stratum, count(*) n, count(*) filter (v <> 'unclear') n_determinate, count(*) filter (v <> 'unclear' and (v = 'correct') = r) agree, avg(((v = 'correct') = r)::int) filter (v <> 'unclear') rate, count(*) filter (v = 'correct' and not r) judge_yes_rule_wrong, count(*) filter (v = 'incorrect' and r) judge_no_rule_correct, avg(r::int) filter (v <> 'unclear') always_yes_agreement, count(*) filter (v = 'correct') n_yes from m group by all",
    "rate always_yes_agreement",
)
def _(s, d):
    k = F.col("c_custkey")
    a, b = F.when(k % 4 == 0, "correct").when(k % 4 == 1, "unclear").otherwise("incorrect"), F.when(k % 5 == 0, "unclear").when(k % 5 == 1, "incorrect").otherwise("correct")
    x = table(s, d, "customer").select((k % 2 == 0).alias("v1"), (k % 3 == 0).alias("v2"), (k % 7 < 3).alias("e"), a.alias("a_verdict"), b.alias("b_verdict"))
    x = x.withColumns({f"{j}_agrees_{r}": judging.agreement(F.col(f"{j}_verdict"), F.col(r)) for j in "ab" for r in ("v1", "v2")})
    return sheets.open_diagnostics(x, ("a", "b"), ["v1", "v2"], "e")


@query("decode_guard", "select count(*) n, count(*) filter (event_id % 50 = 0) n_corrupt, count(*) filter (event_id % 50 = 0) / count(*)::double corrupt_rate from events", "corrupt_rate")
def _(s, d):
    t = F.when(F.col("event_id") % 50 == 0, "aĠb").otherwise("Equivalence Judgement: TRUE")
    return sheets.decode_guard(table(s, d, "events").select(t.alias("t")), text.output_health(F.col("t")), tolerate=0.05)


# ---- gates ----


@query("feasibility", f"with {LB}, fz as (select lang, correct from lb union all select 'self', item_id % 40 <> 7 from lb) select lang, count(*) n, count(*) filter (not correct) n_misgraded, avg((not correct)::int) misgrade_rate, case when avg((not correct)::int) >= 0.05 then 'feasible' else 'gated' end gate, case when avg((not correct)::int) >= 0.05 then floor(30 / avg((not correct)::int))::bigint end projected_items from fz group by 1", "misgrade_rate")
def _(s, d):
    """By language, and for one that grades itself: both sides of the gate."""
    own = labelled(s, d).select(F.explode(F.array(F.struct("lang", "correct"), F.struct(F.lit("self").alias("lang"), (F.col("item_id") % 40 != 7).alias("correct")))).alias("x")).select("x.*")
    return sheets.feasibility(own, "correct", ["lang"])


@query("screen_verdict", f"with {LB}, x as ({auroc('lb', 'h', 'correct', 'lang')}) select lang, case when least(n_error, n_correct) < 30 then 'inconclusive_underpowered' when auroc >= 0.5 and auroc > 0.49 then 'passes_screen' else 'does_not_pass' end verdict from x")
def _(s, d):
    x = ranking.auroc(labelled(s, d), "h", "correct", ["lang"], few=True)
    return x.select("lang", sheets.screen_verdict(F.col("n_error"), F.col("n_correct"), F.col("auroc"), F.col("auroc") > 0.49, passing=0.5).alias("verdict"))


@query("config_differences", "select n_name as key, n_regionkey::varchar stored, case when n_nationkey % 4 = 0 then 'x' when n_nationkey % 7 = 3 then null else n_regionkey::varchar end expected from nation where n_nationkey % 5 <> 0 and (n_nationkey % 4 = 0 or n_nationkey % 7 = 3)")
def _(s, d):
    k = F.col("n_nationkey")
    rows = table(s, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), k.alias("k"))
    stored = rows.filter("k % 5 <> 0").select("key", "value")
    expected = rows.filter("k % 4 = 0 or k % 7 <> 3").select("key", F.when(F.col("k") % 4 == 0, "x").otherwise(F.col("value")).alias("value"))
    return sheets.same_config(stored, expected)


@query("proportion_interval")
def _(s, d):
    x = labelled(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    return x.withColumn("ci", sheets.binomial_interval(F.col("n"), F.col("k"), 20_000)).select("lang", "n", "k", "ci.ci_low", "ci.ci_high")


# ---- snapshots ----


def _run(s, d):
    n = F.col("n_chars")
    level = lambda m: F.element_at(F.array(*(F.lit(x) for x in (0.0, 0.500402, 0.673012, 0.950271, 1.05492, 1.332179, math.log(5)))), (m % 7 + 1).cast("int"))
    return labelled(s, d).select(
        F.col("item_id").alias("item"), (n % 2 == 0).alias("has_error"), level(n).alias("perception_entropy"), F.col("correct").alias("perception_correct"), level(n * 3 + 1).alias("reasoning_entropy"), (~F.col("toxic")).alias("grading_correct"),
        F.col("fails").alias("n_transcription_parse_failures"), (n % 9 == 0).cast("int").alias("n_grading_parse_failures"),
    )


_LEVELS = f"[0.0, 0.500402, 0.673012, 0.950271, 1.05492, 1.332179, {math.log(5)}]"
_RUN = f"rn as (select item_id item, n_chars % 2 = 0 e, {_LEVELS}[(n_chars % 7 + 1)::int]::double pe, correct pc, {_LEVELS}[((n_chars * 3 + 1) % 7 + 1)::int]::double re, not toxic gc, fails tf, (n_chars % 9 = 0)::int gf from lb)"
_GRADES = "select 'grading.accuracy' k, avg(gc::int) v from rn union all select 'grading.accuracy_on_error_items', avg(gc::int) filter (e) from rn union all select 'grading.accuracy_on_clean_items', avg(gc::int) filter (not e) from rn union all select 'grading.baseline_accuracy', greatest(avg(e::int), 1 - avg(e::int)) from rn"
_STRATA = f"st as (select unnest(['pooled', case when e then 'error_stratum' else 'clean_stratum' end]) stratum, re, gc from rn), sa as ({auroc('st', 're', 'gc', 'stratum')})"
_ARM = "select 'reasoning.' || stratum || '.auroc', auroc from sa union all select 'reasoning.' || stratum || '.n_items', n_items from sa union all select 'reasoning.' || stratum || '.n_error', n_error from sa"
_OWN_POOL = _ARM.replace("'reasoning.' || stratum || '", "'reasoning' || case when stratum = 'pooled' then '' else '.' || stratum end || '")


def _area(score: str, correct: str) -> str:
    return f"(select sum(st * risk_kept) aurc, max(n_errors) / max(n_items)::double base from (select *, coverage - lag(coverage, 1, 0.0::double) over (order by threshold) st from ({curve('rn', score, correct)})))"


_MAXED = f"abs(pe - {math.log(5)}) <= {1e-8 + 1e-5 * math.log(5)}"
_CUTS = f"ct as (select unnest(list_filter(['full', case when tf = 0 then 'excl_parse_failures' end, case when not ({_MAXED}) then 'excl_max_entropy' end, case when tf = 0 and not ({_MAXED}) then 'excl_both' end], lambda x: x is not null)) cut, pe, pc from rn), ca as ({auroc('ct', 'pe', 'pc', 'cut')})"


_POINTS = (
    f"with {LB}, {_RUN}, {_STRATA}, {_CUTS}, rc as ({curve('rn', 'pe', 'pc')}), al as (select 'n_items' k, count(*)::double v from rn union all select 'k_transcription', 5 union all select 'k_grading', 5 union all select 'frac_has_error', avg(e::int) from rn union all select 'perception.accuracy', avg(pc::int) from rn union all select 'abstention.n_flagged', count(*) filter ({_MAXED}) from rn "
    f"union all select 'abstention.n_flagged_wrong', count(*) filter ({_MAXED} and not pc) from rn union all select 'abstention.precision', count(*) filter ({_MAXED} and not pc) / nullif(count(*) filter ({_MAXED}), 0)::double from rn union all select 'abstention.recall', count(*) filter ({_MAXED} and not pc) / nullif(count(*) filter (not pc), 0)::double from rn "
    f"union all select 'integrity.transcription_parse_failure_rate', sum(tf) / (count(*) * 5)::double from rn union all select 'integrity.grading_parse_failure_rate', sum(gf) / (count(*) * 5)::double from rn union all {_GRADES} union all {_OWN_POOL} "
    f"union all select 'perception.sensitivity.' || cut || '.auroc', auroc from ca union all select 'perception.sensitivity.' || cut || '.n_items', n_items from ca "
    f"union all select 'perception.auroc', auroc from ca where cut = 'full' union all select 'perception.n_items', n_items from ca where cut = 'full' union all select 'perception.n_error', n_error from ca where cut = 'full' "
    f"union all select 'perception.aurc', aurc from {_area('pe', 'pc')} union all select 'perception.aurc_baseline', base from {_area('pe', 'pc')} union all select 'reasoning.aurc', aurc from {_area('re', 'gc')} union all select 'reasoning.aurc_baseline', base from {_area('re', 'gc')} "
    "union all select 'risk_coverage.level_' || printf('%.6f', threshold) || '.coverage', coverage from rc union all select 'risk_coverage.level_' || printf('%.6f', threshold) || '.risk_kept', risk_kept from rc union all select 'risk_coverage.level_' || printf('%.6f', threshold) || '.n_kept', n_kept from rc)"
)


@query("snapshot_points", f"{_POINTS} select k as key, v as value from al", "value")
def _(s, d):
    return snapshots.metrics(_run(s, d), 5, 0, 0).drop("path")


@query("snapshot_metrics")
def _(s, d):
    """With intervals of 10,000 draws and 1,000 conformal splits."""
    return snapshots.metrics(_run(s, d), 5).drop("path")


@query("snapshot_document", f"{_POINTS} select k as key, v as value, k in {snapshots.HEADLINE} is_headline from al where v is not null and not starts_with(k, 'risk_coverage.')", "value")
def _(s, d):
    """The nested document, taken apart again: its numbers by their keys."""
    run = _run(s, d)
    figures = snapshots.metrics(run, 5, 0, 0)
    doc = snapshots.document(figures, snapshots.curve_list(run).unionByName(snapshots.notes(figures, {"label": "run", "latex_parser_available": False})))
    return runs.flatten_json(doc, "document").withColumn("is_headline", F.col("key").isin(*snapshots.HEADLINE))


_GRADED = (
    f"with {LB}, {_RUN}, {_STRATA}, lv as (select round(re, 3) r, count(*) n from rn group by 1), al as (select 'n_items' k, count(*)::double v from rn union all select 'k_grading', 5 union all select 'composition.n_has_error', count(*) filter (e) from rn union all select 'composition.n_clean', count(*) filter (not e) from rn union all select 'composition.frac_has_error', avg(e::int) from rn "
    f"union all select 'composition.is_balanced', (abs(avg(e::int) - 0.5) < 0.01)::int from rn union all select 'reasoning.pooled_is_misleading_unless_balanced', 1 - (abs(avg(e::int) - 0.5) < 0.01)::int from rn union all select 'integrity.grading_parse_failure_rate', sum(gf) / (count(*) * 5)::double from rn union all {_GRADES} union all {_ARM} union all select 'entropy_distribution.n_distinct_values', count(*) from lv union all select 'entropy_distribution.largest_single_value_share', max(n) / sum(n)::double from lv "
    "union all select 'entropy_distribution.is_degenerate', (max(n) / sum(n)::double >= 0.6)::int from lv union all select 'entropy_distribution.counts.' || r::varchar, n from lv)"
)


@query("snapshot_grading_points", f"{_GRADED} select k as key, v as value from al", "value")
def _(s, d):
    return snapshots.grading_metrics(_run(s, d), 5, 0).drop("path")


@query("snapshot_grading_metrics")
def _(s, d):
    return snapshots.grading_metrics(_run(s, d), 5).drop("path")


@query("snapshot_grading_document", f"{_GRADED} select k as key, v as value from al where v is not null and not regexp_matches(k, '(^|\\.)(is_balanced|is_degenerate|pooled_is_misleading_unless_balanced)$')", "value")
def _(s, d):
    return runs.flatten_json(snapshots.document(snapshots.grading_metrics(_run(s, d), 5, 0)), "document")


@query("snapshot_grading_verdicts")
def _(s, d):
    """Both strata's verdicts as they stand in the document, from intervals of 10,000 draws."""
    return snapshots.stratum_verdicts(snapshots.grading_metrics(_run(s, d), 5)).select(F.array_join("path", ".").alias("key"), "json")
