"""Profiles of a scored run: failure classes, group metrics with refusals, shape buckets, notes, markup reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans, text
from ..functions.text import payload
from ..functions.stats import hash_key, ratio
from .ranking import auroc
from .votes import COMMON, LOOKED_AT, classified, entropy, polled, votes

# Function names that a parsed label may hold without being prose, and shape groups.
PARSED_NAMES = (
    r"\b(?:eq|ne|lt|le|gt|ge|sin|cos|tan|cot|sec|csc|asin|acos|atan|sinh|cosh|tanh|log|ln|exp|sqrt|abs|re|im|conjugate|arg|pi|oo|zoo|nan|true|false"
    r"|integral|derivative|limit|sum|product|factorial|binomial|matrix|max|min|floor|ceiling|mod|gcd|lcm|circ|cdot|times|frac|infty)\b"
)
BARE_WORD = r"(?<![\\A-Za-z])[A-Za-z]{3,}"
SIMPLE_TYPES = ("numeric", "single_expression", "mcq_option")
STRUCTURED_TYPES = ("multi_value", "set_answer", "system_answer", "derivative_equation", "text_conclusion")
SAMPLE_STRATA = ("unanimous_wrong", "max_entropy_wrong", "low_entropy_wrong", "likely_scoring_artifact", "needs_visual")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def clean_lines(c: Column) -> Column:
    """Lines of a field, cleaned and without white space, of four characters or more."""
    lines = F.split(scans.unwrap_macro(scans.unwrap_macro(F.coalesce(c, F.lit("")), "textcolor"), "text"), r"\n|\\\\", -1)
    return F.filter(F.transform(lines, lambda x: squeeze(text.structural_clean(x))), lambda x: F.length(x) >= 4)


def failure_class(model_label: Column, truth_label: Column, model_field: Column, truth_field: Column, similar: float = 0.75, overlap: float = 0.20, where: Column | None = None) -> Column:
    """First that holds: a failed parse or a degenerate truth, an earlier line copied, too few shared tokens, nearly the same label, else a look is needed. where: rows whose class is wanted (else null), as likeness is a scan in Python that sees every row."""
    failed = text.SENTINEL.lower()
    stripped, compact = payload(truth_label), squeeze(payload(model_label))
    prose = truth_label.startswith("sympy:") & F.regexp_replace(F.regexp_replace(stripped, r"\\[A-Za-z]+", ""), PARSED_NAMES, "").rlike(BARE_WORD)
    lines = clean_lines(truth_field)
    earlier = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    copied = (F.length(compact) >= 4) & F.exists(earlier, lambda x: F.contains(x, compact))
    mine, theirs = text.tokens(model_field), text.tokens(truth_field)
    shared = ratio(F.size(F.array_intersect(mine, theirs)), F.size(mine))
    seen = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    found = (
        F.when((model_label == failed) | (truth_label == failed) | stripped.rlike(r"^[a-z]$") | prose, "extraction_issue").when(copied, "copied_wrong_line")
        .when((F.size(mine) > 0) & (F.size(theirs) > 0) & (shared < overlap), "hallucination").when(scans.similarity(seen(compact), seen(squeeze(stripped))) >= similar, "notation_misread").otherwise("needs_visual")
    )
    return seen(found)


def failures(samples: DataFrame, truths: DataFrame, keys: list[str], rule: str = "final_term_v4", truth: str = "truth") -> DataFrame:
    """Per item the failure class (label) of the majority under a rule, by default the loosest: what is still wrong there is no matter of form. With the columns of `majorities`."""
    return with_class(majorities(samples, truths, keys, rule, truth), keys)


def majorities(samples: DataFrame, truths: DataFrame, keys: list[str], rule: str = "final_term_v4", truth: str = "truth") -> DataFrame:
    """Per item entropy, the labels of both sides under a rule, the field of the first sample that made the majority, and the truth's."""
    poll = polled(samples, truths, keys, [rule], lambda c: F.struct(scans.label(c, rule).alias(rule)), truth=truth)
    t = F.col(f"_{rule}")
    return poll.select(*keys, entropy(t).alias("entropy"), t["best"]["label"].alias("model_label"), F.col("_truth")[rule].alias("truth_label"), t["best"]["made"].alias("model_field"), "truth_field")


def with_class(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the failure class (label) of its two labels and fields; like `votes.looked_up`, common combinations are classed once, and the rest where they stand."""
    sides = ["model_label", "truth_label", "model_field", "truth_field"]
    of = lambda c, where: failure_class(*(c[n] for n in sides), where=where)
    df = df.withColumn("_field", F.struct(*sides))
    common = df.filter(F.pmod(F.xxhash64(*keys), F.lit(LOOKED_AT)) == 0).select("_field").distinct().limit(COMMON).select(F.col("_field").alias("_once"), of(F.col("_field"), None).alias("_known"))
    met = df.join(F.broadcast(common), F.col("_field").eqNullSafe(F.col("_once")), "left")
    return met.withColumn("label", F.coalesce("_known", of(F.col("_field"), F.col("_known").isNull()))).drop("_field", "_once", "_known")


def presort(samples: DataFrame, truths: DataFrame, keys: list[str], *carry: str) -> DataFrame:
    """Failure classes of the items that every rule finds wrong, with columns of the truths."""
    return with_class(always_wrong(samples, truths, keys), keys).join(truths.select(*keys, *carry), keys)


def always_wrong(samples: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """`majorities` of the items that every rule finds wrong; verdicts and majorities come from one poll."""
    wrong = classified(samples, truths, keys, 5, made="final_term_v4").filter("category = 'genuinely_wrong'")
    return wrong.select(*keys, F.col("made_entropy").alias("entropy"), "model_label", "truth_label", "model_field", "truth_field")


def coding_sheet(audit: DataFrame, item: str, flag: str = "has_error") -> DataFrame:
    """The sheet that people fill in: the proposed label beside an empty one, so that both remain."""
    return audit.select(item, "stratum", F.col("label").alias("proposed_label"), flag, "entropy", "model_label", "truth_label", F.lit("").alias("final_label"), F.lit("").alias("notes")).orderBy("stratum", item)


def audit_sample(wrong: DataFrame, item: str, entropy: str, label: str, n: int, seed, max_entropy: float) -> DataFrame:
    """n rows in hash order of each of five overlapping strata; an item stays in the first stratum that drew it."""
    h = F.col(entropy)
    member = F.array_compact(F.array(F.when(h < 1e-9, 0), F.when(h > max_entropy - 1e-9, 1), F.when((h >= 1e-9) & (h < 0.7), 2), F.when(F.col(label) == "extraction_issue", 3), F.when(F.col(label) == "needs_visual", 4)))
    drawn = wrong.withColumn("_s", F.explode(member)).withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(hash_key(seed, F.col(item)), item))).filter(F.col("_r") <= n)
    first = drawn.withColumn("_k", F.row_number().over(Window.partitionBy(item).orderBy("_s"))).filter("_k = 1")
    return first.withColumn("stratum", F.element_at(F.array(*(F.lit(s) for s in SAMPLE_STRATA)), F.col("_s") + 1)).drop("_s", "_r", "_k")


def shape(answer_type: Column) -> Column:
    return F.when(answer_type.isin(*SIMPLE_TYPES), "simple_value").when(answer_type.isin(*STRUCTURED_TYPES), "structured_or_prose").otherwise("unknown")


def length_bucket(n: Column) -> Column:
    """Right-closed bins."""
    return F.when(n <= 3, "tiny_<=3").when(n <= 10, "short_4-10").when(n <= 30, "medium_11-30").when(n <= 100, "long_31-100").otherwise("very_long_>100")


def group_metrics(profile: DataFrame, by: str, verdict: str, minority: int = 30) -> DataFrame:
    """Per group (null is one): size, share, accuracies of both rules, entropy and failure rates, people's labels, and an AUROC or why it is refused."""
    mean = lambda c: F.avg(F.col(c).cast("int"))
    decided = F.col("human_truth").isin("correct", "wrong")
    labelled = F.coalesce("human_label", F.lit("")) != ""
    per = profile.groupBy(by).agg(
        F.count("*").alias("n"), mean("v1").alias("v1_accuracy"), mean("v2").alias("v2_accuracy"), F.avg("entropy").alias("mean_entropy"), F.median("entropy").alias("median_entropy"), mean("parse_failed").alias("parse_failure_rate"), mean("max_entropy").alias("max_entropy_rate"), F.median("truth_span_len").alias("median_truth_span_len"),
        F.count_if(verdict).alias("_good"), F.count_if(labelled).alias("n_human_labelled"), ratio(F.count_if(F.col("human_label") == "extraction_issue"), F.count_if(labelled)).alias("extraction_issue_rate"), F.count_if(decided).alias("n_human_determinate"),
        *(F.count_if(decided & (F.col("human_truth") == "wrong") & F.col(r)).alias(f"false_pass_{r}") for r in ("v1", "v2")), *(F.count_if(decided & (F.col("human_truth") == "correct") & ~F.col(r)).alias(f"false_fail_{r}") for r in ("v1", "v2")),
    )
    total = profile.agg(F.count("*").alias("_all"))
    ranks = auroc(profile, "entropy", verdict, [by]).select(F.col(by).alias("_g"), F.col("auroc").alias("_auroc"))
    few = F.least(F.col("_good"), F.col("n") - F.col("_good"))
    status = F.lit("degenerate_split_defined_by_the_label") if by == verdict else F.when(few < minority, F.concat(F.lit("underpowered_minority_"), few.cast("string"))).otherwise("measured")
    out = per.join(F.broadcast(total)).join(ranks, F.col(by).eqNullSafe(F.col("_g")), "left")
    out = out.withColumns({"share": ratio(F.col("n"), F.col("_all")), "auroc_status": status}).withColumn("auroc", F.when(F.col("auroc_status") == "measured", F.col("_auroc")))
    return out.withColumnRenamed(by, "group").drop("_good", "_all", "_g", "_auroc")


def group_metrics_interval(profile: DataFrame, by: str, verdict: str, reps: int, minority: int = 30) -> DataFrame:
    """`group_metrics` with each group's interval, whose lower end tells whether the AUROC excludes chance; refused ones have none."""
    from .ranking import bootstrap_cells, with_interval

    named = profile.withColumnRenamed(by, "group")
    out = with_interval(group_metrics(named, "group", verdict, minority), bootstrap_cells(named, "entropy", verdict, reps, ["group"]), ["group"])
    told = F.col("auroc_status") == "measured"
    out = out.withColumns({c: F.when(told, F.col(c)) for c in ("ci_low", "ci_high")})
    return out.withColumn("auroc_status", F.when(told, F.when(F.col("ci_low") > 0.5, "excludes_chance").otherwise("includes_chance")).otherwise(F.col("auroc_status"))).drop("excludes_chance")


def markup_report(items: DataFrame, spans: str, flag: str) -> DataFrame:
    n = F.size(spans)
    side = lambda f, x: f(F.when(F.col(flag) == x, n))
    return items.agg(
        F.count("*").alias("n_items"), F.count_if(n > 0).alias("items_with_red"), F.sum(n).alias("total_red_spans"), F.count_if((n > 0) & F.col(flag)).alias("error_items_with_red"), F.count_if((n > 0) & ~F.col(flag)).alias("clean_items_with_red"),
        side(F.avg, True).alias("mean_spans_error"), side(F.avg, False).alias("mean_spans_clean"), side(F.median, True).alias("median_spans_error"), side(F.max, True).alias("max_spans_error"),
    )


def membership_sensitivity(profile: DataFrame, verdict: str, flagged: str, weak: str, missed: str) -> DataFrame:
    """Accuracy of a detector's members as reported, without weak triggers, and with missed candidates added; and its range."""
    strong = F.col(flagged) & ~F.col(weak)
    acc = lambda c: F.avg(F.when(c, F.col(verdict).cast("int")))
    out = profile.agg(F.count_if(F.col(flagged)).alias("n_flagged"), F.count_if(F.col(flagged) & F.col(weak)).alias("n_weak"), F.count_if(F.col(missed)).alias("n_missed"), acc(F.col(flagged)).alias("as_reported"), acc(strong).alias("drop_weak"), acc(strong | F.col(missed)).alias("drop_weak_add_missed"))
    return out.withColumns({"range_low": F.least("as_reported", "drop_weak", "drop_weak_add_missed"), "range_high": F.greatest("as_reported", "drop_weak", "drop_weak_add_missed")})


# What the notes on tiles and on confusion cells say.
NOTES = {
    "prose": "prose conclusion; strict matching cannot score a sentence",
    "tiny_truth": "tiny truth span; a coincidental match or miss is cheap here",
    "all_differ": "all five samples differ; entropy at its ceiling",
    "failed": "at least one sample failed to parse",
    "rules_differ": "the two rules disagree on this item",
    "both_right": "scored correct by both rules",
    "wrong": "scored wrong; span and label shown for comparison",
    "fp_vacuous": "both labels collapse to one symbol; the match is vacuous",
    "fp_tiny": "the extractor picked a 1-3 character span; a match is cheap",
    "fp_other": "scored correct on a span that is not the page's answer",
    "fn_prose": "model answered in prose, truth collapsed to a bare symbol, so the two never compare",
    "fn_colour": "the truth span still carries LaTeX colour markup the model had no way to reproduce",
    "fn_stop": "spans differ only by trailing punctuation",
    "fn_spacing": "spans differ only by LaTeX spacing",
    "fn_other": "the page's answer is right; the label comparison is what failed",
    "tn_misread": "genuine misread of the handwriting",
    "tn_line": "copied a different line of the page",
    "tn_wrong": "model answer is wrong on the page's own terms",
    "tn_other": "human confirms the model was wrong",
    "indeterminate": "verdict unearned; what the model actually answered is unknown",
    "tp": "human confirms the model was correct",
}


def tile_note(model_label: Column, truth_label: Column, truth_span: Column, answer_type: Column, v1: Column, v2: Column, at_max: Column, failed: Column) -> Column:
    vacuous = (model_label == truth_label) & (F.length(payload(model_label)) <= 2) & (F.length(truth_span) > 20)
    return (
        F.when(vacuous, F.concat(F.lit("both labels collapsed to `"), model_label, F.lit("` from a long span; the match is vacuous")))
        .when((answer_type == "text_conclusion") & ~v1, NOTES["prose"]).when((F.length(truth_span) <= 3) & ~v1, NOTES["tiny_truth"])
        .when(at_max, NOTES["all_differ"]).when(failed, NOTES["failed"]).when(v1 != v2, NOTES["rules_differ"])
        .when(v1, NOTES["both_right"]).otherwise(NOTES["wrong"])
    )


def confusion_note(category: Column, human: Column, model_label: Column, truth_label: Column, model_span: Column, truth_span: Column, v1: Column) -> Column:
    one = lambda c: text.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    sm, st = one(model_span), one(truth_span)
    bare = lambda c: F.regexp_replace(c, r"[.,;]+$", "")
    packed = lambda c: F.replace(F.replace(c, F.lit("\\,"), F.lit("")), F.lit(" "), F.lit(""))
    fp = (
        F.when((model_label == truth_label) & (F.length(payload(model_label)) <= 2), NOTES["fp_vacuous"])
        .when(F.length(text.strip(F.coalesce(model_span, F.lit("")))) <= 3, NOTES["fp_tiny"]).otherwise(NOTES["fp_other"])
    )
    fn = (
        F.when(model_label.startswith("text:") & truth_label.startswith("sympy:"), NOTES["fn_prose"])
        .when(F.contains(st, F.lit("\\textcolor")), NOTES["fn_colour"]).when((bare(sm) == bare(st)) & (sm != st), NOTES["fn_stop"])
        .when(packed(sm) == packed(st), NOTES["fn_spacing"]).otherwise(NOTES["fn_other"])
    )
    tn = F.when(human == "notation_misread", NOTES["tn_misread"]).when(human == "copied_wrong_line", NOTES["tn_line"]).when(human == "true_wrong", NOTES["tn_wrong"]).otherwise(NOTES["tn_other"])
    unread = F.concat(F.lit("scorer "), F.when(v1, "passed").otherwise("failed"), F.lit(" it, but the coder could not read the page: correctness is unknown either way"))
    return F.when(category == "FP", fp).when(category == "FN", fn).when(category == "TN", tn).when(category == "INDETERMINATE", NOTES["indeterminate"]).when(category == "NEEDS_VISUAL", unread).otherwise(NOTES["tp"])
