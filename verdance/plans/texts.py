"""Queries: parsing, canonical answers, versioned rules, flags, judges."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import formulas, scans, text
from ..functions.stats import ratio
from ..operators import cases, judging, profile, ranking, votes
from ..sources.tables import responses, table
from .registry import query
from .sql import RS, PR, SC, auroc, canonical, extract_final, normal_span, normalize, strip, structural, tier

# ---- parsing ----

_GR = "gr as (select event_id, '**Reasoning:** saw ' || event_type || ' **Error:** ' || (event_id % 3) || ' **Confidence:** ' || (event_id % 131) raw, event_id % 2 = 1 has_error from events)"


def _grading(s, d):
    e = F.col("event_id")
    raw = F.concat(F.lit("**Reasoning:** saw "), "event_type", F.lit(" **Error:** "), (e % 3).cast("string"), F.lit(" **Confidence:** "), (e % 131).cast("string"))
    return table(s, d, "events").select("event_id", raw.alias("raw"), (e % 2 == 1).alias("has_error"))


@query("parse_answer", f"with {RS}, {PR} select item_id, pos, field from pr")
def _(s, d):
    return responses(s, d)[0].select("item_id", "pos", text.parse_answer(F.col("response")).alias("field"))


@query("parse_digit", rf"with {_GR} select event_id, case when regexp_matches(raw, '\*\*Error:\*\*\s*([01])') then regexp_extract(raw, '\*\*Error:\*\*\s*([01])', 1)::int end digit from gr")
def _(s, d):
    return _grading(s, d).select("event_id", text.parse_digit(F.col("raw")).alias("digit"))


@query("parse_reasoning", r"select event_id, 'saw ' || event_type reasoning from events")
def _(s, d):
    return _grading(s, d).select("event_id", text.parse_reasoning(F.col("raw")).alias("reasoning"))


@query("parse_confidence", "select event_id, case when event_id % 131 <= 100 then (event_id % 131)::int end confidence from events")
def _(s, d):
    return _grading(s, d).select("event_id", text.parse_confidence(F.col("raw")).alias("confidence"))


@query("label_matches", "select event_id, event_id % 3 < 2 and event_id % 3 = event_id % 2 digit_match, event_id % 3 < 2 and event_id % 3 = event_id % 2 cluster_match from events")
def _(s, d):
    g = _grading(s, d).withColumn("digit", text.parse_digit(F.col("raw")))
    return g.select("event_id", text.digit_matches(F.col("digit"), F.col("has_error")).alias("digit_match"), text.cluster_matches(F.coalesce(F.col("digit").cast("string"), F.lit(text.SENTINEL)), F.col("has_error")).alias("cluster_match"))


# ---- canonical answers ----


@query("structural_clean", f"with {RS} select item_id, pos, {structural('response')} cleaned from rs")
def _(s, d):
    return responses(s, d)[0].select("item_id", "pos", text.structural_clean(F.col("response")).alias("cleaned"))


@query("extract_final_frozen", f"with {RS}, {PR} select item_id, pos, {extract_final('field')} final from pr")
def _(s, d):
    return responses(s, d)[0].select("item_id", "pos", text.extract_final(text.parse_answer(F.col("response"))).alias("final"))


@query("extract_final_decimals", f"with {RS}, {PR} select item_id, pos, {extract_final('field', True)} final from pr")
def _(s, d):
    return responses(s, d)[0].select("item_id", "pos", text.extract_final(text.parse_answer(F.col("response")), keep_decimals=True).alias("final"))


@query("canonical_label_text", f"with {RS}, {SC} select item_id, pos, lab as label, false parser_available from sl")
def _(s, d):
    rows = responses(s, d)[0].select("item_id", "pos", text.parse_answer(F.col("response")).alias("field"))
    return scans.with_label(rows, "field", "label").select("item_id", "pos", "label", F.lit(False).alias("parser_available"))


@query("canonical_tier", f"with {RS}, {PR}, x as (select item_id, pos, {extract_final('field')} f_ from pr) select item_id, pos, {canonical('f_')} canonical from x")
def _(s, d):
    return responses(s, d)[0].select("item_id", "pos", text.canonical(text.extract_final(text.parse_answer(F.col("response")))).alias("canonical"))


_RED = "case when {b} // gcd({a}, {b}) = 1 then ({a} // gcd({a}, {b}))::varchar else ({a} // gcd({a}, {b})) || '/' || ({b} // gcd({a}, {b})) end"
_AB = "case when {n} = 1 then '' else {n} || '*' end"
_FORMULAS = rf"""fm as (select o_orderkey item_id, o_orderkey % 9 + 1 a, o_custkey % 7 + 2 b, o_custkey % 13 f from orders),
ft as (select *, case f when 0 then '\frac{{' || a || '}}{{' || b || '}}' when 1 then a || ' / ' || b when 2 then a || '.5' when 3 then 'x = \frac{{' || a || '}}{{' || b || '}}' when 4 then a || 'x + ' || b || 'x' when 5 then '(' || a || '+' || b || ')\times ' || b
  when 6 then 'Hence, ' || a when 7 then 'hence ' || a when 8 then '-' || a || '^2' when 9 then '2^{{-' || b || '}}' when 10 then a || ' = ' || b when 11 then a || ' + \sqrt{{' || a || '+' || b || '}}' else '\[ \frac{{x}}{{' || b || '}}+\frac{{x}}{{' || (2 * b) || '}} \]' end answer from fm),
fv as (select *, case f when 0 then {_RED.format(a="a", b="b")} when 1 then {_RED.format(a="a", b="b")} when 2 then (2 * a + 1) || '/2' when 3 then 'eq(x, ' || {_RED.format(a="a", b="b")} || ')' when 4 then (a + b) || '*x' when 5 then ((a + b) * b)::varchar
  when 7 then {_AB.format(n="a")} || 'c*e^2*h*n' when 8 then '-' || a * a when 9 then '1/' || (2 ** b)::bigint when 11 then a || ' + sqrt(' || (a + b) || ')' when 12 then {_RED.format(a="3", b="(2 * b)")} || '*x' end v from ft)"""


def _formulas(s, d):
    a, b, f = F.col("o_orderkey") % 9 + 1, F.col("o_custkey") % 7 + 2, F.col("o_custkey") % 13
    put = lambda pattern, *x: F.format_string(pattern, *x)
    forms = [put("\\frac{%d}{%d}", a, b), put("%d / %d", a, b), put("%d.5", a), put("x = \\frac{%d}{%d}", a, b), put("%dx + %dx", a, b), put("(%d+%d)\\times %d", a, b, b), put("Hence, %d", a), put("hence %d", a), put("-%d^2", a), put("2^{-%d}", b), put("%d = %d", a, b), put("%d + \\sqrt{%d+%d}", a, a, b)]
    answer = F.coalesce(*(F.when(f == i, x) for i, x in enumerate(forms)), put("\\[ \\frac{x}{%d}+\\frac{x}{%d} \\]", b, 2 * b))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), answer.alias("answer"))


_TEXT_TIER = f"'text:' || {structural('answer')}"


@query("formula_labels", f"with {_FORMULAS} select item_id, coalesce('sympy:' || v, {_TEXT_TIER}) as label, case when f = 7 then {_TEXT_TIER} else coalesce('sympy:' || v, {_TEXT_TIER}) end strict_label from fv")
def _(s, d):
    rows = _formulas(s, d)
    told = rows.select("answer").distinct().select("answer", formulas.label(F.col("answer")).alias("label"), formulas.label(F.col("answer"), strict=True).alias("strict_label"))
    return rows.join(told, "answer").select("item_id", "label", "strict_label")


@query("formula_classes", f"with {_FORMULAS} select coalesce('sympy:' || v, {_TEXT_TIER}) as label, count(*) n, count(distinct answer) n_spellings from fv group by 1 having count(distinct answer) > 1")
def _(s, d):
    rows = _formulas(s, d).groupBy("answer").count()
    return rows.withColumn("label", formulas.label(F.col("answer"))).groupBy("label").agg(F.sum("count").alias("n"), F.count("*").alias("n_spellings")).filter("n_spellings > 1")


#: Labels of the responses under the tier of formulas: what their forms can become.
_PARSED = rf"case when f_ is null or {structural('f_')} = '' then '<parse_failure>' when regexp_matches({structural('f_')}, '^x ?= ?\d+$') then 'sympy:eq(x, ' || regexp_extract(f_, '\d+') || ')' when regexp_matches({structural('f_')}, '^\d+$') then 'sympy:' || {structural('f_')} when regexp_matches({structural('f_')}, '^\d+ cm$') then 'sympy:' || regexp_extract(f_, '\d+') || '*c*m' else 'text:' || {structural('f_')} end"
_PSL = f"psl as (select item_id, pos, field is null failed, {_PARSED} lab from (select *, {extract_final('field')} f_ from pr)), ptl as (select item_id, {_PARSED} lab from (select *, {extract_final('truth')} f_ from od))"


@query("parsed_labels", f"with {RS}, {PR}, {_PSL} select item_id, pos, lab as label from psl")
def _(s, d):
    rows = responses(s, d)[0].select("item_id", "pos", text.parse_answer(F.col("response")).alias("field"))
    return scans.with_label(rows, "field", "label", "parsed_v1").select("item_id", "pos", "label")


@query(
    "parsed_scoring",
    f"with {RS}, {PR}, {_PSL}, pc as (select item_id, lab, count(*) n, min(pos) f from psl group by all), pv as (select item_id, sum(n)::bigint k, count(*) n_distinct, abs(round(ln(sum(n)::double) - sum(n * ln(n::double)) / sum(n)::double, 12)) entropy, (list(lab order by n desc, f))[1] majority from pc group by 1) "
    "select item_id, k, n_distinct, entropy, majority, ptl.lab truth_label, majority = ptl.lab correct from pv join ptl using (item_id)",
    "entropy",
)
def _(s, d):
    samples, orders = responses(s, d)
    return votes.score(samples, orders, ["item_id"], "parsed_v1").select("item_id", "k", "n_distinct", "entropy", "majority", "truth_label", "correct")


@query("unwrap_macro", r"with x as (select doc_id, '\textcolor{red}{' || left(source, 5) || ' \text{in {' || lang || '}}}' t from documents) select doc_id, left(source, 5) || ' \text{in {' || lang || '}}' colour_free, '\textcolor{red}{' || left(source, 5) || ' in {' || lang || '}}' text_free from documents")
def _(s, d):
    t = F.concat(F.lit("\\textcolor{red}{"), F.substring("source", 1, 5), F.lit(" \\text{in {"), F.col("lang"), F.lit("}}}"))
    return table(s, d, "documents").select("doc_id", scans.unwrap_macro(t, "textcolor").alias("colour_free"), scans.unwrap_macro(t, "text").alias("text_free"))


_COSMETIC = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\[,;:!]|\\quad|\\qquad|\\ |\\;|\\thinspace', '', 'g'), '[₹$€£¥]|\\rs\.?|\brs\.?\s', '', 'g'), '\{{(\w)\}}', '\1', 'g'), '\s+', '', 'g'), '[.,;]+$', ''), ''), {x})"


@query("cosmetic", f"with {RS}, {SC} select item_id, pos, {_COSMETIC.format(x='lab')} label from sl")
def _(s, d):
    label = lambda c: F.struct(text.cosmetic(text.answer_label(text.parse_answer(c))).alias("label"))
    return votes.looked_up(responses(s, d)[0], "response", label, ["item_id"]).select("item_id", "pos", "_told.label")


@query("final_term", "select o_orderkey item_id, (o_orderkey % 7)::varchar term from orders")
def _(s, d):
    k = F.col("o_orderkey")
    t = F.concat(F.lit("f(x=1) = {a=b} = "), (k % 5).cast("string"), F.lit(" <= 9 = "), (k % 7).cast("string"), F.lit(" = "))
    return table(s, d, "orders").select(k.alias("item_id"), scans.final_term(t).alias("term"))


@query("extraction_tier", f"with {RS}, {PR} select item_id, pos, {tier('field')} tier from pr")
def _(s, d):
    return responses(s, d)[0].select("item_id", "pos", text.extraction_tier(text.parse_answer(F.col("response"))).alias("tier"))


@query("tier_stability", rf"with {RS}, {PR} select item_id, count(distinct {tier('field')}) n_tiers, count(*) n_samples, count(*) filter (regexp_matches(field, '\\boxed\{{([^{{}}]*)\}}')) n_boxed, count(*) filter (regexp_matches(field, '\\boxed\{{([^{{}}]*)\}}')) / count(*)::double frac_boxed, count(*) filter (regexp_matches(field, '\\boxed\{{([^{{}}]*)\}}')) = count(*) all_boxed from pr group by 1", "frac_boxed")
def _(s, d):
    return votes.tiers(responses(s, d)[0], ["item_id"])


@query("boxed_verdict", f"with {RS}, {PR}, t as (select item_id, count(distinct {tier('field')}) nt, count(*) filter (regexp_matches(field, '\\\\boxed\\{{([^{{}}]*)\\}}')) / count(*)::double fb from pr group by 1), x as (select avg(fb) compliance, avg((nt > 1)::int) multi_tier from t) select *, case when compliance < 0.8 then 'gated_low_compliance' when multi_tier > 0.1 then 'manipulation_failed' else 'inconclusive' end verdict, case when multi_tier > 0.1 then 'manipulation_failed' else 'signal_is_not_extractor' end ungated from x", "compliance multi_tier")
def _(s, d):
    x = votes.tiers(responses(s, d)[0], ["item_id"]).agg(F.avg("frac_boxed").alias("compliance"), F.avg((F.col("n_tiers") > 1).cast("int")).alias("multi_tier"))
    verdict = lambda c: text_verdict(c, F.lit(0.8), F.lit(True), F.col("multi_tier"))
    return x.withColumn("verdict", verdict(F.col("compliance"))).withColumn("ungated", verdict(F.lit(1.0)))


text_verdict = votes.boxed_verdict


# ---- scoring ----


@query("scoring_run", f"with {RS}, {SC} select item_id, k, n_distinct, entropy, majority, truth_label, n_parse_failures, correct from sc", "entropy")
def _(s, d):
    samples, orders = responses(s, d)
    return votes.score(samples, orders, ["item_id"]).select("item_id", "k", "n_distinct", "entropy", "majority", "truth_label", "n_parse_failures", "correct")


def _scored(s, d, rule="strict_v1"):
    samples, orders = responses(s, d)
    return votes.score(samples, orders, ["item_id"], rule)


#: Labels under the four rules, in SQL: the responses hold no nested macros and no equals signs inside brackets, so regular expressions do.
_BARE = r"regexp_replace(regexp_replace({x}, '\\textcolor\{{[^{{}}]*\}}\{{([^{{}}]*)\}}', '\1', 'g'), '\\text\{{([^{{}}]*)\}}', '\1', 'g')"
_TERM = r"case when contains(loose, '=') then coalesce(list_filter(list_transform(string_split(loose, '='), lambda t: trim(t)), lambda t: t <> '')[-1], loose) else loose end"


def _four(src: str, field: str, carry: str) -> str:
    """In steps, so that no step repeats a large expression. src has the strict label as strict."""
    steps = [f"{_BARE.format(x=field)} b_", f"{extract_final('b_', True)} f_", f"{canonical('f_')} c_", f"{normalize('c_')} fixed", f"case when fixed = '<parse_failure>' then fixed else {_COSMETIC.format(x='fixed')} end loose", f"case when fixed = '<parse_failure>' then loose else {_TERM} end term"]
    for step in steps:
        src = f"(select *, {step} from {src})"
    return f"(select {carry}, unnest(['strict_v1', 'fixed_v2', 'relaxed_v3', 'final_term_v4']) rule, unnest([strict, fixed, loose, term]) label from {src})"


RULE_LABELS = f"""labels4 as {_four("(select *, lab strict from sl)", "field", "item_id, pos, field")}, truths4 as {_four("(select od.item_id, od.truth, tl.lab strict from od join tl using (item_id))", "truth", "item_id")},
counts4 as (select item_id, rule, label, count(*) n, min(pos) f from labels4 group by all), votes4 as (select item_id, rule, (list(label order by n desc, f))[1] as label, abs(round(ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double, 12)) entropy, sum(n)::bigint k from counts4 group by all),
scored4 as (select v.item_id, v.rule, v.entropy, v.k, v.label = t.label correct from votes4 v join truths4 t on v.item_id = t.item_id and v.rule = t.rule)"""
RULE_VERDICTS = """ver4 as (select item_id, bool_or(correct) filter (rule = 'strict_v1') v1, bool_or(correct) filter (rule = 'fixed_v2') v2, bool_or(correct) filter (rule = 'relaxed_v3') v3, bool_or(correct) filter (rule = 'final_term_v4') v4, max(entropy) filter (rule = 'strict_v1') entropy, max(k) k from scored4 group by 1),
cat4 as (select *, case when v1 and v2 and v4 then 'correct_robust' when v1 and v2 then 'broken_by_relaxation' when v1 then 'false_pass_removed' when v2 then 'bug_fix_recovered' when v3 then 'cosmetic_mismatch' when v4 then 'scope_mismatch' else 'genuinely_wrong' end category, case when v1 then null when v2 then 'fixed_v2' when v3 then 'relaxed_v3' when v4 then 'final_term_v4' end first_fixing_rule, not v1 and (v2 or v3) and not v4 later_regression from ver4)"""


def _ablated(src: str, field: str, carry: str) -> str:
    """strict_v1's labels with repairs of fixed_v2, in steps: macros shed, stops inside numbers kept, both."""
    src = f"(select *, {_BARE.format(x=field)} b_ from {src})"
    for name, text_, keep in (("base", field, False), ("unwrapped", "b_", False), ("decimals", field, True), ("fixed", "b_", True)):
        src = f"(select *, {normalize('c_')} {name} from (select * exclude (f_), {canonical('f_')} c_ from (select *, {extract_final(text_, keep)} f_ from {src})))"
        src = f"(select * exclude (c_) from {src})"
    return f"(select {carry}, base, unwrapped, decimals, fixed from {src})"


@query("rule_labels", f"with {RS}, {SC}, {RULE_LABELS} select item_id, pos, rule, label from labels4")
def _(s, d):
    rows = votes.once(responses(s, d)[0].select("item_id", "pos", text.parse_answer(F.col("response")).alias("field")), "field", lambda forms: scans.with_labels(forms, "field"), ["item_id"])
    return rows.unpivot(["item_id", "pos"], list(scans.RULES), "rule", "label")


@query("rule_sensitivity")
def _(s, d):
    """With intervals of 10,000 draws."""
    return ranking.rule_metrics(votes.score_rules(*responses(s, d), ["item_id"]), "rule", 5, 10_000).withColumn("accuracy", ratio(F.col("n_correct"), F.col("n_items")))


@query("rule_points", f"with {RS}, {SC}, {RULE_LABELS}, a as ({auroc('scored4', 'entropy', 'correct', 'rule')}) select a.*, n_correct / n_items::double accuracy, (select count(*) from scored4 s where s.rule = a.rule and abs(s.entropy - ln(5)) <= 1e-9 * ln(5)) n_at_max_entropy from a", "auroc accuracy")
def _(s, d):
    return ranking.rule_points(votes.score_rules(*responses(s, d), ["item_id"]), "rule", 5).withColumn("accuracy", ratio(F.col("n_correct"), F.col("n_items")))


def _classified(s, d):
    return votes.classified(*responses(s, d), ["item_id"], 5)


@query("scoring_categories", f"with {RS}, {SC}, {RULE_LABELS}, {RULE_VERDICTS} select item_id, category, first_fixing_rule, later_regression, v1, v2, v3, v4 from cat4")
def _(s, d):
    return _classified(s, d).select("item_id", "category", "first_fixing_rule", "later_regression", "v1", "v2", "v3", "v4")


@query(
    "category_summary",
    f"with {RS}, {SC}, {RULE_LABELS}, {RULE_VERDICTS}, nt as (select item_id, count(distinct {tier('field')}) n_tiers from pr group by 1), o as (select unnest(range(7))::int rank, unnest(['correct_robust', 'bug_fix_recovered', 'cosmetic_mismatch', 'scope_mismatch', 'false_pass_removed', 'broken_by_relaxation', 'genuinely_wrong']) category) "
    "select o.rank, o.category, count(cat4.item_id) n, count(cat4.item_id) / (select count(*) from cat4)::double share, avg(entropy) mean_entropy, avg((n_tiers > 1)::int) frac_multi_tier, avg((k = 5 and abs(entropy - ln(5)) < 1e-9)::int) frac_at_max_entropy from o left join cat4 using (category) left join nt using (item_id) group by all",
    "share mean_entropy frac_multi_tier frac_at_max_entropy",
)
def _(s, d):
    return votes.outcome_summary(_classified(s, d))


@query(
    "bug_attribution",
    f"""with {RS}, {SC}, {RULE_LABELS}, {RULE_VERDICTS}, sa as (select item_id, pos, unnest(['unwrap', 'decimal_split']) fix, unnest([unwrapped, decimals]) l from {_ablated('pr', 'field', 'item_id, pos')}), ta as (select item_id, unnest(['unwrap', 'decimal_split']) fix, unnest([unwrapped, decimals]) l from {_ablated('od', 'truth', 'item_id')}),
na as (select item_id, fix, l, count(*) n, min(pos) f from sa group by all), ma as (select item_id, fix, (list(l order by n desc, f))[1] m from na group by all),
fx2 as (select item_id, string_agg(fix, '+' order by fix desc) names from ma join ta using (item_id, fix) join cat4 using (item_id) where (m = ta.l) <> v1 group by 1)
select item_id, category, case when category in ('bug_fix_recovered', 'false_pass_removed') then coalesce(names, 'combined_only') end attributed_bug from cat4 left join fx2 using (item_id)""",
)
def _(s, d):
    """Which single repair changes the verdict of items that the repairs mend or break."""
    return votes.attributed(*responses(s, d), ["item_id"]).select("item_id", "category", "attributed_bug")


_VERDICTS = "vx as (select c_custkey item_id, c_custkey % 2 = 0 v1, c_custkey % 3 = 0 v2, c_custkey % 5 = 0 v3, c_custkey % 7 = 0 v4, c_acctbal e from customer)"
_CATEGORY = "case when v1 and v2 and v4 then 'correct_robust' when v1 and v2 then 'broken_by_relaxation' when v1 then 'false_pass_removed' when v2 then 'bug_fix_recovered' when v3 then 'cosmetic_mismatch' when v4 then 'scope_mismatch' else 'genuinely_wrong' end"


@query("outcome_table", f"with {_VERDICTS} select item_id, {_CATEGORY} category, case when v1 then null when v2 then 'fixed_v2' when v3 then 'relaxed_v3' when v4 then 'final_term_v4' end first_fixing_rule, not v1 and (v2 or v3) and not v4 later_regression from vx")
def _(s, d):
    c = F.col("c_custkey")
    return table(s, d, "customer").select(c.alias("item_id"), *(x.alias(n) for n, x in votes.outcome(c % 2 == 0, c % 3 == 0, c % 5 == 0, c % 7 == 0).items()))


@query(
    "outcome_summary",
    f"with {_VERDICTS}, cl as (select *, {_CATEGORY} category from vx), o as (select unnest(range(7))::int rank, unnest(['correct_robust', 'bug_fix_recovered', 'cosmetic_mismatch', 'scope_mismatch', 'false_pass_removed', 'broken_by_relaxation', 'genuinely_wrong']) category) "
    "select o.rank, o.category, count(cl.item_id) n, count(cl.item_id) / (select count(*) from cl)::double share, avg(e) mean_entropy, avg((item_id % 4 > 1)::int) frac_multi_tier, avg((e > 5000)::int) frac_at_max_entropy from o left join cl using (category) group by all",
    "share mean_entropy frac_multi_tier frac_at_max_entropy",
)
def _(s, d):
    c = F.col("c_custkey")
    rows = table(s, d, "customer").select(votes.outcome(c % 2 == 0, c % 3 == 0, c % 5 == 0, c % 7 == 0)["category"].alias("category"), F.col("c_acctbal").alias("entropy"), (c % 4).alias("n_tiers"), (F.col("c_acctbal") > 5000).alias("at_max"))
    return votes.outcome_summary(rows)


@query(
    "first_difference",
    "select n_nationkey, case when a = b then null else coalesce((list_filter(range(1, greatest(least(len(a), len(b)), 1) + 1), lambda i: a[i] <> b[i]))[1] - 1, least(len(a), len(b))) end::int as at, left(a, 4) || case when len(a) > 4 then '...' else '' end clipped from (select n_nationkey, n_name a, case n_nationkey % 3 when 0 then n_name when 1 then n_name || 'x' else replace(n_name, '1', '#') end b from nation)",
)
def _(s, d):
    a, k = F.col("n_name"), F.col("n_nationkey")
    b = F.when(k % 3 == 0, a).when(k % 3 == 1, F.concat(a, F.lit("x"))).otherwise(F.replace(a, F.lit("1"), F.lit("#")))
    return table(s, d, "nation").select(k, text.first_difference(a, b).cast("int").alias("at"), text.clip(a, 4).alias("clipped"))


@query("ablated_labels", f"with {RS}, {PR}, ab as {_ablated('pr', 'field', 'item_id')} select unwrapped <> base changed_unwrapped, decimals <> base changed_decimals, fixed <> base changed_both, count(*) n from ab group by all")
def _(s, d):
    rows = responses(s, d)[0].select("item_id", "pos", text.parse_answer(F.col("response")).alias("field"))
    # few forms of answers repeat: each is labelled once
    forms = rows.groupBy("field").agg(F.count("*").alias("n")).withColumn("base", text.answer_label(F.col("field")))
    for name, fix in {"unwrapped": {"unwrapped": True}, "decimals": {"keep_decimals": True}, "both": {"unwrapped": True, "keep_decimals": True}}.items():
        forms = forms.withColumn(name, scans.ablated_label(F.col("field"), **fix))
    return forms.groupBy(*((F.col(c) != F.col("base")).alias(f"changed_{c}") for c in ("unwrapped", "decimals", "both"))).agg(F.sum("n").alias("n"))


# ---- flags ----

_FLAG_SRC = r"fx as (select o_orderkey item_id, case o_custkey % 6 when 0 then 'x=1, y=' || (o_orderkey % 9) when 1 then '(b)' when 2 then '{1, 2}' when 3 then 'the area of square is ' || (o_orderkey % 9) when 4 then '\frac{dy}{dx}=2' else (o_orderkey % 900)::varchar end span, o_custkey % 4 = 0 is_mcq, lower(span) bare, lower(span) payload from orders)"
_WORDS = "('eq','log','tan','sin','cos','cot','sec','csc','exp','sqrt','abs','integral','derivative','limit','sum','pi','oo','re','im','conjugate','matrix','and','or','true','false')"
# The rule's patterns and words. fx has item_id, span, bare (its normal form), payload (of the label), is_mcq.
_FLAGS = rf"""fw as (select *, len(bare) <= 3 tiny, regexp_matches(bare, '(?i)\boption\b') or (is_mcq and regexp_matches(bare, '^\(?\s*(?:option\s*)?[a-eA-E]\s*\)?[.)]?$')) mcq_option,
 len(list_filter(string_split(bare, ','), lambda p: trim(p) <> '')) >= 2 and not contains(bare, '=') and len(bare) > 3 multi_value_answer, regexp_matches(span, '\\[{{}}]|\\(?:cup|cap|setminus|subset|supset|emptyset)\b|\\in\b|(?:^|[^a-zA-Z])\{{[^{{}}]*,[^{{}}]*\}}') set_answer,
 len(list_filter(string_split_regex(bare, ',|;|\band\b|\\quad'), lambda p: contains(p, '='))) >= 2 system_answer, regexp_matches(span, '(?i)\\frac\s*\{{\s*d(?:\^?\d?)?\s*[a-z]?\s*\}}|\bd\^?2?\s*y\s*/\s*d\s*x|\\mathrm\{{d\}}|derivative\(|\bdy\s*/\s*dx\b') derivative_equation,
 len(list_filter(regexp_extract_all(bare, '[A-Za-z]{{3,}}'), lambda w: lower(w) not in {_WORDS})) >= 3 text_conclusion from fx),
fm as (select *, tiny and is_mcq tiny_valid_mcq, tiny and not is_mcq tiny_suspicious_non_mcq, payload <> '' and system_answer and len(regexp_extract_all(payload, 'eq\(')) <= 1 sympy_partial_parse_risk, regexp_matches(payload, '(?i)d\*\*\d\s*\*\s*[a-z]|/\s*\(?\s*dx\s*\*\*|\bdx\*\*\d') sympy_malformed_derivative, payload <> '' and multi_value_answer and len(payload) <= greatest(3, len(bare) // 3) multi_answer_collapse from fw)"""
_FLAG_NAMES = ("mcq_option", "tiny_valid_mcq", "tiny_suspicious_non_mcq", "multi_value_answer", "set_answer", "system_answer", "derivative_equation", "text_conclusion", "sympy_partial_parse_risk", "sympy_malformed_derivative", "multi_answer_collapse")


def _flagged(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 6
    span = (
        F.when(c == 0, F.concat(F.lit("x=1, y="), (k % 9).cast("string"))).when(c == 1, "(b)").when(c == 2, "{1, 2}").when(c == 3, F.concat(F.lit("the area of square is "), (k % 9).cast("string")))
        .when(c == 4, "\\frac{dy}{dx}=2").otherwise((k % 900).cast("string"))
    )
    rows = table(s, d, "orders").select(k.alias("item_id"), span.alias("span"), (F.col("o_custkey") % 4 == 0).alias("is_mcq"))
    norm = F.lower("span")
    return rows.withColumns(text.answer_flags(F.col("span"), norm, F.concat(F.lit("text:"), norm), F.col("is_mcq"))).withColumn("bare", norm)


@query("risk_flags", f"with {_FLAG_SRC}, {_FLAGS} select item_id, {', '.join(_FLAG_NAMES)} from fm")
def _(s, d):
    return _flagged(s, d).select("item_id", *_FLAG_NAMES)


_PRIORITY = "case when item_id % 10 = 0 or tiny_suspicious_non_mcq or multi_answer_collapse or sympy_partial_parse_risk or sympy_malformed_derivative then 'high' when multi_value_answer or set_answer or system_answer or derivative_equation or text_conclusion then 'medium' else 'low' end"


@query("review_priority", f"with {_FLAG_SRC}, {_FLAGS} select item_id, {_PRIORITY} priority from fm")
def _(s, d):
    x = _flagged(s, d)
    return x.select("item_id", text.review_priority(F.col("item_id") % 10 == 0, {f: F.col(f) for f in _FLAG_NAMES}).alias("priority"))


@query("risk_sheet", f"with {_FLAG_SRC}, {_FLAGS} select item_id, item_id % 10 = 0 rules_disagree, {_PRIORITY} priority, '' final_label, '' confidence, '' note from fm where item_id % 10 = 0 or {' or '.join(_FLAG_NAMES)}")
def _(s, d):
    x = _flagged(s, d).withColumn("rules_disagree", F.col("item_id") % 10 == 0)
    flags = {f: F.col(f) for f in _FLAG_NAMES}
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    sheet = x.filter(F.col("rules_disagree") | text.any_of(flags.values())).withColumn("priority", text.review_priority(F.col("rules_disagree"), flags))
    return sheet.orderBy(rank, "item_id").select("item_id", "rules_disagree", "priority", *(F.lit("").alias(c) for c in ("final_label", "confidence", "note")))


@query("flag_summary", f"with {_FLAG_SRC}, {_FLAGS} select count(*) n, {', '.join(f'count(*) filter ({f}) {f}' for f in _FLAG_NAMES)} from fm")
def _(s, d):
    return _flagged(s, d).agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in _FLAG_NAMES))


_TYPE = r"case when trim(span) = '' then 'unknown' when mcq_option or tiny_valid_mcq then 'mcq_option' when set_answer then 'set_answer' when system_answer then 'system_answer' when derivative_equation then 'derivative_equation' when multi_value_answer then 'multi_value' when text_conclusion then 'text_conclusion' when regexp_matches(bare, '^[-+]?\d[\d\s.,/*^+\-]*$') or regexp_matches(bare, '(?i)^[-+]?\d[\d\s.,/*^+\-]*\\?[a-z%°]{0,12}\.?$') then 'numeric' else 'single_expression' end"


@query("answer_types", f"with {_FLAG_SRC}, {_FLAGS}, x as (select item_id, {_TYPE} answer_type, len(span) n from fm) select *, case when answer_type in ('numeric', 'single_expression', 'mcq_option') then 'simple_value' when answer_type = 'unknown' then 'unknown' else 'structured_or_prose' end shape, case when n <= 3 then 'tiny_<=3' when n <= 10 then 'short_4-10' when n <= 30 then 'medium_11-30' when n <= 100 then 'long_31-100' else 'very_long_>100' end bucket from x")
def _(s, d):
    x = _flagged(s, d)
    x = x.select("item_id", text.truth_type({f: F.col(f) for f in _FLAG_NAMES}, F.col("span"), F.col("bare")).alias("answer_type"), F.length("span").cast("long").alias("n"))
    return x.withColumns({"shape": profile.shape(F.col("answer_type")), "bucket": profile.length_bucket(F.col("n"))})


@query("judge_answer_types", f"with {_FLAG_SRC}, {_FLAGS} select item_id, case when mcq_option or tiny_valid_mcq then 'mcq' when derivative_equation then 'derivative' when set_answer then 'set' when system_answer then 'system' when multi_value_answer then 'multi_value' when text_conclusion then 'text_conclusion' else 'numeric_or_algebra' end answer_type from fm")
def _(s, d):
    return _flagged(s, d).select("item_id", text.judge_answer_type({f: F.col(f) for f in _FLAG_NAMES}).alias("answer_type"))


@query("normalize_span", f"with {RS} select item_id, pos, {normal_span('response')} span from rs")
def _(s, d):
    return responses(s, d)[0].select("item_id", "pos", scans.normalize_span(F.col("response")).alias("span"))


_PL = r"(?i)\(\s*[a-d]\s*\)[^\n]{0,60}\(\s*[b-e]\s*\)"


@query("choice_trigger", rf"with {RS}, x as (select item_id, question || case item_id % 3 when 0 then ' (a) one (b) two' when 1 then ' \item x' else '' end q, truth from od), y as (select item_id, concat_ws(',', case when regexp_matches(q, '(?i)\boption\b') then 'question' end, case when regexp_matches(truth, '(?i)\boption\b') then 'answer_field' end) option_word_in, regexp_matches(q, '\\begin\{{enumerate\}}|\\item\b') question_has_choice_list, left(regexp_extract(q || '  ' || truth, '{_PL}'), 60) paren_letters_match from x) select *, case when option_word_in <> '' and question_has_choice_list then 'option_word_and_choice_list' when option_word_in <> '' then 'option_word_only' when question_has_choice_list then 'choice_list_only' when paren_letters_match <> '' then 'paren_letters_only' else 'not_flagged' end presort, option_word_in <> '' or paren_letters_match <> '' flagged_by_detector from y")
def _(s, d):
    k = F.col("item_id")
    q = F.concat("question", F.when(k % 3 == 0, " (a) one (b) two").when(k % 3 == 1, " \\item x").otherwise(""))
    return responses(s, d)[1].select(k, *(c.alias(n) for n, c in text.choice_trigger(q, F.lit(""), F.col("truth")).items()))


@query("red_spans", "select doc_id, 2::int n_spans, lang || '|{x}' spans from documents")
def _(s, d):
    t = F.concat(F.lit("a \\textcolor{red}{"), F.col("lang"), F.lit("} b \\textcolor {red} {{x}} \\textcolor{blue}{y}"))
    return table(s, d, "documents").select("doc_id", scans.red_spans(t).alias("r")).select("doc_id", F.size("r").alias("n_spans"), F.array_join("r", "|").alias("spans"))


@query("markup_report", "select count(*) n_items, count(*) filter (doc_id % 3 > 0) items_with_red, sum(doc_id % 3)::bigint total_red_spans, count(*) filter (doc_id % 3 > 0 and doc_id % 2 = 0) error_items_with_red, count(*) filter (doc_id % 3 > 0 and doc_id % 2 = 1) clean_items_with_red, avg(doc_id % 3) filter (doc_id % 2 = 0) mean_spans_error, avg(doc_id % 3) filter (doc_id % 2 = 1) mean_spans_clean, median(doc_id % 3) filter (doc_id % 2 = 0) median_spans_error, (max(doc_id % 3) filter (doc_id % 2 = 0))::int max_spans_error from documents", "mean_spans_error mean_spans_clean median_spans_error")
def _(s, d):
    k = F.col("doc_id")
    t = F.concat(F.lit("v"), F.repeat(F.lit("\\textcolor{red}{w}"), (k % 3).cast("int")))
    return profile.markup_report(table(s, d, "documents").select(scans.red_spans(t).alias("r"), (k % 2 == 0).alias("e")), F.col("r"), "e")


# ---- failures ----


@query("failure_classes")
def _(s, d):
    return profile.failures(*responses(s, d), ["item_id"]).select("item_id", "label")


# the classes that need neither token overlap nor a likeness ratio, and a digest of the rest
@query(
    "failure_majority",
    f"with {RS}, {SC}, {RULE_LABELS}, w as (select item_id, label from votes4 where rule = 'final_term_v4'), f as (select l.item_id, arg_min(field, pos) field from labels4 l join w using (item_id) where l.rule = 'final_term_v4' and l.label = w.label group by 1) "
    "select f.item_id, w.label model_label, t.label truth_label, f.field model_field, w.label = '<parse_failure>' or t.label = '<parse_failure>' or regexp_matches(regexp_replace(t.label, '(?s)^[^:]*:', ''), '^[a-z]$') by_scoring from f join w using (item_id) join truths4 t on t.item_id = f.item_id and t.rule = 'final_term_v4'",
)
def _(s, d):
    x = profile.majorities(*responses(s, d), ["item_id"])
    return x.select("item_id", "model_label", "truth_label", "model_field", ((F.col("model_label") == text.SENTINEL.lower()) | (F.col("truth_label") == text.SENTINEL.lower()) | profile.payload(F.col("truth_label")).rlike("^[a-z]$")).alias("by_scoring"))


@query("presort", f"with {RS}, {SC}, {RULE_LABELS}, {RULE_VERDICTS} select item_id, has_error from cat4 join od using (item_id) where category = 'genuinely_wrong'")
def _(s, d):
    samples, orders = responses(s, d)
    return profile.always_wrong(samples, orders, ["item_id"]).join(orders, "item_id").select("item_id", "has_error")


@query("coding_sheet")
def _(s, d):
    samples, orders = responses(s, d)
    return profile.coding_sheet(profile.audit_sample(profile.presort(samples, orders, ["item_id"], "has_error"), "item_id", "entropy", "label", 6, 0, math.log(5)), "item_id")


@query("answer_tokens", r"with x as (select part.p_partkey, list_distinct(regexp_extract_all(p_name || ' ' || p_retailprice::int || ' \alpha', '-?\d+(?:\.\d+)?|[A-Za-z]+|\\[A-Za-z]+')) t from part) select p_partkey, len(t)::int n_tokens, array_to_string(list_sort(t), '|') tokens from x")
def _(s, d):
    t = text.tokens(F.concat_ws(" ", "p_name", F.bround("p_retailprice").cast("int").cast("string"), F.lit("\\alpha")))
    return table(s, d, "part").select("p_partkey", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), "|").alias("tokens"))


# ---- judges ----

_JD = r"jd as (select conv_id, turn, case (conv_id + turn) % 5 when 0 then 'so \boxed{Yes} but \boxed{no}' when 1 then 'thinking' || chr(10) || '**Yes.**' when 2 then 'it is yes' when 3 then 'Equivalence Judgement: TRUE' else text end raw, conv_id % 2 = 0 rule, case conv_id % 3 when 0 then 'correct' when 1 then 'wrong' end human from conversations)"
_PV = rf"""pv as (select *, coalesce(lower(regexp_extract_all(raw, '(?i)\\boxed\s*\{{\s*(yes|no)\s*\}}', 1)[-1]), lower(nullif(regexp_extract({strip("string_split(" + strip("raw") + ", chr(10))[-1]")}, '(?i)^\**\s*(yes|no)\s*[.!]?\**$', 1), ''))) said from jd),
jv as (select *, case said when 'yes' then 'correct' when 'no' then 'incorrect' else 'unclear' end verdict, case lower(regexp_extract_all(regexp_replace(raw, '\s+', '', 'g'), '(?i)judg?e?ment\W{{0,4}}(true|false)', 1)[-1]) when 'true' then 'correct' when 'false' then 'incorrect' else 'unclear' end squashed from pv)"""


def _judged(s, d):
    m = (F.col("conv_id") + F.col("turn")) % 5
    raw = F.when(m == 0, "so \\boxed{Yes} but \\boxed{no}").when(m == 1, "thinking\n**Yes.**").when(m == 2, "it is yes").when(m == 3, "Equivalence Judgement: TRUE").otherwise(F.col("text"))
    c = F.col("conv_id") % 3
    rows = table(s, d, "conversations").select("conv_id", "turn", raw.alias("raw"), (F.col("conv_id") % 2 == 0).alias("rule"), F.when(c == 0, "correct").when(c == 1, "wrong").alias("human"))
    return rows.withColumns({"verdict": text.parse_verdict(F.col("raw")), "squashed": text.parse_squashed_verdict(F.col("raw"))})


@query("judge_verdict", f"with {_JD}, {_PV} select conv_id, turn, verdict, squashed from jv")
def _(s, d):
    return _judged(s, d).select("conv_id", "turn", "verdict", "squashed")


@query("prefix_verdict", "select event_id, case when event_id % 3 = 0 then 'correct' when event_id % 3 = 1 then 'incorrect' else 'unclear' end verdict from events")
def _(s, d):
    m = F.col("event_id") % 3
    return table(s, d, "events").select("event_id", text.parse_prefix_verdict(F.when(m == 0, " true, it is").when(m == 1, "False").otherwise(F.col("event_type"))).alias("verdict"))


@query("judge_diagnostics", f"with {_JD}, {_PV} select count(*) n, count(*) filter (verdict = 'correct') n_correct, count(*) filter (verdict = 'incorrect') n_incorrect, count(*) filter (verdict = 'unclear') n_unclear, avg((verdict = 'unclear')::int) unclear_rate, count(*) filter (verdict = 'correct') / nullif(count(*) filter (verdict <> 'unclear'), 0)::double accuracy_excluding_unclear, avg((verdict = 'correct')::int) accuracy_unclear_as_wrong, count(*) filter ((verdict = 'correct') <> rule) disagree_rule, count(*) filter (verdict = 'correct' and not rule) judge_yes_rule_no, count(*) filter (verdict <> 'correct' and rule) judge_no_rule_yes, count(human) human_n, count(*) filter (human = 'wrong' and verdict = 'correct') human_false_pass, count(*) filter (human = 'correct' and verdict = 'incorrect') human_false_fail, avg((verdict = 'correct')::int) filter (human = 'correct') agrees_on_correct, avg((verdict = 'incorrect')::int) filter (human = 'wrong') agrees_on_wrong, avg((verdict = case human when 'correct' then 'correct' else 'incorrect' end)::int) filter (human is not null) agrees_overall, count(*) filter (turn % 2 = 0) has_error_n, avg((verdict = 'correct')::int) filter (turn % 2 = 0) has_error_correct_rate, count(*) filter (turn % 2 <> 0) clean_n, avg((verdict = 'correct')::int) filter (turn % 2 <> 0) clean_correct_rate from jv", "agrees_overall has_error_correct_rate clean_correct_rate unclear_rate accuracy_excluding_unclear accuracy_unclear_as_wrong agrees_on_correct agrees_on_wrong")
def _(s, d):
    return judging.diagnostics(_judged(s, d).withColumn("flag", F.col("turn") % 2 == 0), ["rule"], "human", "flag")


@query("nullable_agreement", f"with {_JD}, {_PV} select conv_id, turn, case when verdict <> 'unclear' then (verdict = 'correct') = rule end agrees from jv")
def _(s, d):
    return _judged(s, d).select("conv_id", "turn", judging.agreement(F.col("verdict"), F.col("rule")).alias("agrees"))


_KP = "kp as (select user_id, case event_id % 4 when 0 then 'incorrect' when 1 then 'unclear' else 'correct' end a, case (event_id * 7 + user_id) % 5 when 0 then 'incorrect' when 1 then 'unclear' else 'correct' end b, user_id % 3 g from events), kd as (select g, count(*) n, count(*) filter (a <> 'unclear' and b <> 'unclear') nd, count(*) filter (a <> 'unclear' and a = b) na, avg((a = b)::int) filter (a <> 'unclear' and b <> 'unclear') po, avg((a = 'correct')::int) filter (a <> 'unclear' and b <> 'unclear') pa, avg((b = 'correct')::int) filter (a <> 'unclear' and b <> 'unclear') pb from kp group by 1)"


@query("judge_kappa", f"with {_KP}, x as (select *, pa * pb + (1 - pa) * (1 - pb) pe from kd) select g, n, nd n_both_determinate, na n_agree, po rate, pe chance_rate, (po - pe) / (1 - pe) kappa from x", "rate chance_rate kappa")
def _(s, d):
    e, u = F.col("event_id"), F.col("user_id")
    side = lambda m: F.when(m == 0, "incorrect").when(m == 1, "unclear").otherwise("correct")
    rows = table(s, d, "events").select((u % 3).alias("g"), side(e % 4).alias("a"), side((e * 7 + u) % 5).alias("b"))
    return judging.judge_kappa(rows, "a", "b", ["g"])


# a gate that opens, one with a probe that isn't judged incorrect, and one with a probe that is missing
@query("judge_gate", "select p.n gate, count(c_custkey) n_probes, count(*) filter (c_custkey % 2 = 0) = max(len(p.k)) passed from (values (1, [4, 6, 8]), (2, [5, 6]), (3, [2, -1])) p(n, k) left join customer on list_contains(p.k, c_custkey) group by 1")
def _(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "incorrect").otherwise("correct").alias("verdict"))
    gates = [judging.gate(rows, "c_custkey", probes).select(F.lit(i).alias("gate"), "n_probes", "passed") for i, probes in enumerate(([4, 6, 8], [5, 6], [2, -1]), 1)]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


@query("judge_backend", "select p_partkey, case when p_size > 25 then '\\boxed{yes}' else '\\boxed{no}' end raw_output, case when p_size > 25 then 'correct' else 'incorrect' end verdict from part")
def _(s, d):
    prompts = table(s, d, "part").select("p_partkey", text.build_prompt("Is {size} over 25?", size=F.col("p_size").cast("string")).alias("prompt"))
    out = judging.judge(prompts, lambda: lambda asked: ["\\boxed{yes}" if int(p.split()[1]) > 25 else "\\boxed{no}" for p in asked], "prompt", "p_partkey")
    return out.drop("error").withColumn("verdict", text.parse_verdict(F.col("raw_output")))


_HT = "ht as (select event_id, case event_id % 7 when 0 then ' ' when 1 then 'aĠb' when 2 then repeat('#a', 30) when 3 then 'Equivalence Judgement: no' when 4 then 'all true' when 5 then 'short' else repeat('long ', 40) end t from events)"
_HEALTH = "case event_id % 7 when 0 then 'empty' when 1 then 'bpe_markers_leaked' when 2 then 'shredded' when 3 then 'clean' when 4 then 'marker_corrupted' when 5 then 'stopped_before_verdict' else 'no_marker' end"


def _outputs(s, d):
    m = F.col("event_id") % 7
    t = F.when(m == 0, " ").when(m == 1, "aĠb").when(m == 2, "#a" * 30).when(m == 3, "Equivalence Judgement: no").when(m == 4, "all true").when(m == 5, "short").otherwise("long " * 40)
    return table(s, d, "events").select("event_id", t.alias("t"))


@query("output_health", f"select event_id, {_HEALTH} status from events")
def _(s, d):
    return _outputs(s, d).select("event_id", text.output_health(F.col("t")).alias("status"))


@query("output_report", f"select {_HEALTH} status, count(*) n, count(*) / (select count(*) from events)::double share from events group by 1", "share")
def _(s, d):
    return judging.output_report(_outputs(s, d), text.output_health(F.col("t")))


@query("bpe_text", f"with {_HT} select event_id, contains(t, 'Ġ') mangled, replace(replace(t, ' ', ''), 'Ġ', ' ') demangled, regexp_matches(t, '(?i)is wrong') solving from ht")
def _(s, d):
    return _outputs(s, d).select("event_id", text.looks_bpe_mangled(F.col("t")).alias("mangled"), text.demangle_bpe(F.col("t")).alias("demangled"), text.looks_like_solving(F.col("t")).alias("solving"))


@query("invented_tokens", "select c_custkey, case when c_custkey % 2 = 0 then '' else '77' end invented, '13000 and 1/2/' || (c_custkey % 5 + 3) surface from customer")
def _(s, d):
    k = F.col("c_custkey")
    source = text.numeric_surface(F.lit("13,000 and"), F.concat(F.lit("\\frac{\\frac{1}{2}}{"), (k % 5 + 3).cast("string"), F.lit("}")))
    said = text.numeric_surface(F.concat(F.lit("it is 13000 or 1 / 2 or "), F.when(k % 2 == 0, "9").otherwise("77")))
    rows = table(s, d, "customer").select(k, source.alias("source"), said.alias("said"))
    return rows.select("c_custkey", F.array_join(text.invented_tokens(F.col("said"), F.col("source")), "; ").alias("invented"), F.col("source").alias("surface"))


@query("prompt_table", "select c_custkey, 'Q: ' || trim(c_name) || ' A: ' || trim(c_mktsegment) prompt, sha256('Q: ' || trim(c_name) || ' A: ' || trim(c_mktsegment)) prompt_sha256 from customer")
def _(s, d):
    p = text.build_prompt("Q: {question} A: {answer}", question=F.col("c_name"), answer=F.col("c_mktsegment"))
    return table(s, d, "customer").select("c_custkey", p.alias("prompt"), F.sha2(p, 256).alias("prompt_sha256"))


# ---- single items ----

_LV = f"""lv as (select sl.*, {extract_final("field")} final, {tier("field")} tr from sl), mv as (select item_id, (list(struct_pack(f := final, t := tr) order by pos))[1] m from lv join sv using (item_id) where lab = majority group by 1), tv as (select item_id, truth, {extract_final("truth")} tfinal, {tier("truth")} ttr from od)"""


@query("label_views", rf"with {RS}, {SC}, {_LV} select item_id, entropy, correct, mv.m.f model_span, majority model_label, mv.m.t model_tier, tfinal truth_span, truth_label, ttr truth_tier, len(regexp_replace(majority, '(?s)^[^:]*:', '')) <= 3 and len(coalesce(mv.m.f, '')) > 12 collapsed from sc join mv using (item_id) join tv using (item_id)", "entropy")
def _(s, d):
    samples, orders = responses(s, d)
    return cases.label_views(samples, orders, ["item_id"])


@query("trace_summary", f"with {RS}, {SC}, {_LV}, n as (select item_id, count(*)::int n_samples, string_agg(tr, ',' order by pos) tiers, string_agg(coalesce(final, '-'), '|' order by pos) finals from lv group by 1) select n.*, entropy, correct, tfinal truth_final from n join sc using (item_id) join tv using (item_id)", "entropy")
def _(s, d):
    samples, orders = responses(s, d)
    t = cases.trace(samples, orders, ["item_id"])
    return t.select("item_id", F.size("samples").alias("n_samples"), F.array_join("samples.tier", ",").alias("tiers"), F.array_join(F.transform("samples.final", lambda x: F.coalesce(x, F.lit("-"))), "|").alias("finals"), "entropy", "correct", F.col("ground_truth.final").alias("truth_final"))


@query("case_bundles")
def _(s, d):
    samples, orders = responses(s, d)
    return cases.bundles(cases.trace(samples, orders, ["item_id"]).filter("correct and entropy > 1"), "high_entropy_correct", "run")


@query(
    "open_judge_frame",
    "with r as (select c_custkey k, 'Is 12 more than ' || c_nationkey || '?' question, (c_custkey % 40)::varchar truth, (c_custkey % 50)::varchar answer, c_custkey % 2 = 0 v1, c_custkey % 3 = 0 v2 from customer), j as (select *, case k % 4 when 0 then 'correct' when 1 then 'unclear' else 'incorrect' end a, case k % 5 when 0 then 'unclear' when 1 then 'incorrect' else 'correct' end b, 'it should be ' || (k % 60) raw from r) "
    "select k, a a_verdict, b b_verdict, a = 'unclear' a_parse_failed, b = 'unclear' b_parse_failed, case when a <> 'unclear' then (a = 'correct') = v1 end a_agrees_v1, case when b <> 'unclear' then (b = 'correct') = v2 end b_agrees_v2, case when a <> 'unclear' and b <> 'unclear' then a = b end judges_agree, true b_looks_like_solving, "
    "case when k % 60 >= 10 and not contains(question || ' ' || truth || ' ' || answer, (k % 60)::varchar) then (k % 60)::varchar else '' end b_invented_tokens from j",
)
def _(s, d):
    k = F.col("c_custkey")
    rows = table(s, d, "customer")
    run = rows.select(k.alias("k"), F.concat(F.lit("Is 12 more than "), F.col("c_nationkey").cast("string"), F.lit("?")).alias("question"), (k % 40).cast("string").alias("truth"), (k % 50).cast("string").alias("answer"), (k % 2 == 0).alias("v1"), (k % 3 == 0).alias("v2"))
    a = rows.select(k.alias("k"), F.lit("x").alias("raw_output"), F.when(k % 4 == 0, "correct").when(k % 4 == 1, "unclear").otherwise("incorrect").alias("verdict"))
    b = rows.select(k.alias("k"), F.concat(F.lit("it should be "), (k % 60).cast("string")).alias("raw_output"), F.when(k % 5 == 0, "unclear").when(k % 5 == 1, "incorrect").otherwise("correct").alias("verdict"))
    frame = judging.open_frame(run, {"a": a, "b": b}, "k", ["v1", "v2"], invented_by="b")
    return frame.select("k", "a_verdict", "b_verdict", "a_parse_failed", "b_parse_failed", "a_agrees_v1", "b_agrees_v2", "judges_agree", "b_looks_like_solving", "b_invented_tokens")
