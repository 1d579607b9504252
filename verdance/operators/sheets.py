"""Sheets for people: strict span scoring of a run, wide item profiles, review sets, confusion examples, spot checks.

Draws follow hash orders; ranks are inside cells, after a cut to what a cell can need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans, text
from ..functions.stats import dbl, hash_key, ratio
from . import votes
from .cases import sides, traced
from .runs import places

#: Flags by which the audit sheet is sorted, orders of trigger classes and of answer shapes.
AUDIT_SORT = ("rules_disagree", "tiny_suspicious_non_mcq", "sympy_partial_parse_risk", "multi_answer_collapse")
TRIGGERS = ("option_word_and_choice_list", "option_word_only", "choice_list_only", "paren_letters_only")
SHAPES = ("derivative", "mcq", "multi_value", "set", "system", "text_conclusion", "numeric_or_algebra")
FLAGS = (
    "mcq_option", "tiny_valid_mcq", "tiny_suspicious_non_mcq", "multi_value_answer", "set_answer", "system_answer", "derivative_equation", "text_conclusion", "sympy_partial_parse_risk", "sympy_malformed_derivative",
    "multi_answer_collapse",
)
#: Those of the answer's shape; the others tell what a parsed label has lost.
SHAPE_FLAGS = FLAGS[:8]
SHORTEST_EXEMPLAR = 4


def span_scores(samples: DataFrame, truths: DataFrame, keys: list[str], question: str = "question", truth: str = "truth", full: bool = False) -> DataFrame:
    """Per item the verdict on spans (strict_v2) beside that on labels (strict_v1): majority of the normalised spans against the truth's, both entropies, both sides' spans, labels and tiers, and the flags, each up if either side has it.

    Flags are worked out with the labels of a field, for either kind of question, and travel as bits. full: also n_parse_failures and the bits of the truth's own flags (truth_flags).
    """
    # a span's form is the one that is voted on, where there is a span
    label = lambda forms: _flagged(_normal(sides(forms, "_field"), "final"), "_field", "final", F.when(F.col("final").isNull(), "").otherwise(F.col("norm")), "label")
    rows = votes.once(votes.fields(samples, keys), "_field", label, keys).withColumn("m", F.struct("final", "label", "tier", "_free", "_choice"))
    rows = rows.withColumn("_failed", F.when(F.col("_field").isNull(), F.col("_n")).otherwise(0))
    # both votes of an item are taken where it lies
    both = votes.votes(rows.select(*keys, "pos", "_n", "_failed", "m", "label", "norm").repartition(*keys).select(*keys, "pos", "_n", "_failed", "m", votes.long(["label", "norm"], "_kind", "_value")), [*keys, "_kind"], label="_value", extra={"n_parse_failures": "_failed"} if full else {}, count="_n", made="m")
    of = lambda c, kind: F.max(F.when(F.col("_kind") == kind, F.col(c)))
    found = both.groupBy(*keys).agg(
        of("entropy", "norm").alias("span_entropy"), of("majority", "norm").alias("model_span_norm"), of("m", "norm").alias("m"), of("entropy", "label").alias("entropy"), of("majority", "label").alias("_label"),
        *([of("n_parse_failures", "norm").alias("n_parse_failures")] if full else []),
    )
    told = traced_truth(truths.select(*keys, truth, F.col(question).alias("question")), keys, truth, "question")
    out = found.join(told, keys).select(
        *keys, "entropy", "span_entropy", "question", F.col("m.final").alias("model_span"), F.col("m.label").alias("model_label"), F.col("m.tier").alias("model_tier"), "truth_field", "truth_span", "truth_label", "truth_tier",
        "model_span_norm", "truth_span_norm", (F.col("_label") == F.col("truth_label")).alias("correct_v1"), F.col("m._free").alias("_free"), F.col("m._choice").alias("_choice"), "_t_free", "_t_choice", *(["n_parse_failures"] if full else []),
    )
    out = out.withColumn("correct_v2", (F.col("model_span_norm") == F.col("truth_span_norm")) & (F.col("truth_span_norm") != ""))
    # one inlined row, as else the scan of the question would be repeated in every flag and filter that asks for it
    choice = F.coalesce(text.looks_multiple_choice(F.col("question"), F.col("truth_span"), F.col("truth_field")), F.lit(False))
    out = out.select("*", F.inline(F.array(F.struct(choice.alias("is_mcq")))))
    out = out.withColumns({"_own": F.when(F.col("is_mcq"), F.col("_choice")).otherwise(F.col("_free")), "truth_flags": F.when(F.col("is_mcq"), F.col("_t_choice")).otherwise(F.col("_t_free"))})
    either = F.col("_own").bitwiseOR(F.col("truth_flags"))
    return out.withColumns(raised(either)).drop("_free", "_choice", "_t_free", "_t_choice", "_own", *([] if full else ["truth_flags"]))


def raised(bits: Column) -> dict[str, Column]:
    """Each flag of a number whose bits stand for FLAGS, in their order."""
    return {f: bits.bitwiseAND(F.lit(1 << i)) != 0 for i, f in enumerate(FLAGS)}


def _flagged(df: DataFrame, field: str, span: str, bare: Column, label: str, free: str = "_free", choice: str = "_choice") -> DataFrame:
    """df with the bits of one side's flags, where the question isn't one of choice and where it is. Without a field they are constants."""

    def bits(is_choice: bool) -> Column:
        none = text.answer_flags(F.lit(""), F.lit(""), F.lit(text.SENTINEL.lower()), F.lit(is_choice))
        some = text.answer_flags(F.coalesce(F.col(span), F.lit("")), bare, F.col(label), F.lit(is_choice))
        told = lambda flags: sum((F.when(F.coalesce(flags[f], F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(FLAGS)), F.lit(0))
        return F.when(F.col(field).isNull(), told(none)).otherwise(told(some))

    return df.withColumns({free: bits(False), choice: bits(True)})


def _normal(df: DataFrame, span: str) -> DataFrame:
    """df with norm, the form of a span in which samples are compared."""
    return df.withColumn("norm", F.when(F.col(span).isNull(), text.SENTINEL).otherwise(scans.normalize_span(F.col(span))))


def traced_truth(truths: DataFrame, keys: list[str], truth: str, *carry: str) -> DataFrame:
    """(keys, truth_field, carry, truth_span, truth_label, truth_tier, truth_span_norm) under strict_v1, with the bits of its flags (_t_free, _t_choice)."""
    named = lambda forms: forms.transform(sides, "truth_field").withColumnsRenamed({"tier": "truth_tier", "final": "truth_span", "label": "truth_label"}).withColumn("truth_span_norm", scans.normalize_span(F.col("truth_span")))
    label = lambda forms: _flagged(named(forms), "truth_field", "truth_span", F.col("truth_span_norm"), "truth_label", "_t_free", "_t_choice")
    return votes.once(truths.select(*keys, F.col(truth).alias("truth_field"), *carry), "truth_field", label, keys)


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """Both rules' counts and accuracies, where they differ and who is right alone, and every flag's count."""
    a, b = F.col("correct_v1"), F.col("correct_v2")
    n = F.count("*")
    return scored.agg(
        n.alias("n"), F.count_if(a).alias("v1_correct"), ratio(F.count_if(a), n).alias("v1_accuracy"), F.count_if(b).alias("v2_correct"), ratio(F.count_if(b), n).alias("v2_accuracy"),
        F.count_if(a != b).alias("n_disagree"), F.count_if(a & ~b).alias("v1_only_correct"), F.count_if(~a & b).alias("v2_only_correct"), *(F.count_if(f).alias(f"n_{f}") for f in FLAGS),
    )


def risk_sheet(scored: DataFrame, item: str) -> DataFrame:
    """Items on which the rules disagree or a flag is up, with their priority and empty answers; the high ones come first."""
    flags = {f: F.col(f) for f in FLAGS}
    sheet = scored.withColumn("rules_disagree", F.col("correct_v1") != F.col("correct_v2")).filter(F.col("rules_disagree") | text.any_of(flags.values()))
    sheet = sheet.withColumn("priority", text.review_priority(F.col("rules_disagree"), flags)).withColumns({c: F.lit("") for c in ("final_label", "confidence", "note")})
    return sheet.orderBy(F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2), item)


def audit_sheet(sheet: DataFrame, item: str, image_dir: str = "images") -> DataFrame:
    """The high tier for an audit, items with the flags that predict false passes first."""
    path = F.concat(F.lit(f"{image_dir}/item"), F.format_string("%03d", F.col(item).cast("long")), F.lit(".png"))
    names = {"span_m_disp": "model_span", "span_t_disp": "truth_span", "label_m": "model_label", "label_t": "truth_label", "strict_v1_correct": "correct_v1", "strict_v2_correct": "correct_v2"}
    out = sheet.filter("priority = 'high'").orderBy(*(F.col(c).desc() for c in AUDIT_SORT), item)
    return out.select(F.col(item).alias("item_id"), path.alias("image_path"), "priority", *(F.col(c).alias(n) for n, c in names.items()), "rules_disagree", *FLAGS, "final_label", "confidence", "note")


def item_profile(run: DataFrame, scored: DataFrame, item: str, human: DataFrame | None = None) -> DataFrame:
    """One wide row an item. scored: `span_scores` in full; run: item, has_error; human: item, human_label, human_truth. Fields that no data gives are empty columns."""
    top = scored.agg(F.max("entropy").alias("_top"))  # one row
    both = scored.join(run.select(item, "has_error"), item).join(F.broadcast(top))
    both = both.join(human, item, "left") if human is not None else both.withColumns({"human_label": F.lit(None).cast("string"), "human_truth": F.lit(None).cast("string")})
    mine = raised(F.col("truth_flags"))
    either = {f: F.col(f) for f in FLAGS}
    out = both.withColumn("_red", scans.red_spans(F.col("truth_field")))
    return out.select(
        F.col(item).alias("item_id"), "has_error", F.col("correct_v1").alias("strict_v1_correct"), F.col("correct_v2").alias("strict_v2_correct"), text.truth_type(mine, F.col("truth_span"), F.col("truth_span_norm")).alias("answer_type"),
        F.when(F.col("is_mcq"), "mcq").otherwise("free_response").alias("question_type_if_available"), "entropy", (F.col("n_parse_failures") > 0).alias("parse_failed"), (F.col("entropy") >= F.col("_top") - 1e-9).alias("max_entropy"),
        F.col("model_span").alias("span_m_disp"), F.col("truth_span").alias("span_t_disp"), F.col("model_label").alias("label_m"), F.col("truth_label").alias("label_t"),
        F.coalesce("human_label", F.lit("")).alias("human_label_if_available"), F.coalesce("human_truth", F.lit("")).alias("human_truth_if_available"),
        *(F.lit("").alias(c) for c in ("extraction_status_if_available", "error_location_if_available", "error_type_if_available", "image_path_if_available")),
        F.size("_red").alias("n_red_spans"), F.array_join(F.transform(F.slice("_red", 1, 3), lambda r: F.substring(r, 1, 60)), " | ").alias("red_spans_approx_only"), text.either_side_type(either).alias("answer_type_either_side"),
        F.length(F.coalesce("truth_span", F.lit(""))).alias("truth_span_len"), F.length(F.coalesce("model_span", F.lit(""))).alias("model_span_len"),
    )


def choice_review(scored: DataFrame, run: DataFrame, item: str, per_page: int = 9) -> DataFrame:
    """Items taken for multiple choice, to confirm or reject, and those that only show a list, to recover; with page and cell in the order of trigger and item. run: item, has_error."""
    out = scored.withColumns(text.choice_trigger(F.col("question"), F.col("truth_span"), F.col("truth_field")))
    out = out.filter(F.col("is_mcq") | (F.col("presort") == "choice_list_only")).withColumn("mcq_group", F.when(F.col("is_mcq"), "flagged_mcq_like").otherwise("candidate_missed"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(t) for t in TRIGGERS)), F.col("presort")), F.lit(0)), F.lit(99))
    out = places(out.join(run.select(item, "has_error"), item), ["mcq_group"], rank, item, "_n")
    stem = F.when(F.col("mcq_group") == "flagged_mcq_like", "mcq_flagged").otherwise("mcq_candidate_missed")
    return out.select(
        F.col(item).alias("item_id"), "mcq_group", "presort", F.col("is_mcq").alias("heuristic_mcq_like"), F.lit("").alias("confirmed_mcq"), F.lit("").alias("reviewer_note"), "has_error", F.col("correct_v1").alias("strict_v1_correct"),
        F.col("correct_v2").alias("strict_v2_correct"), "entropy", F.col("model_span").alias("span_m_disp"), F.col("truth_span").alias("span_t_disp"), F.col("model_label").alias("label_m"), F.col("truth_label").alias("label_t"), "model_tier", "truth_tier",
        F.concat_ws(",", *(F.when(F.col(f), f) for f in SHAPE_FLAGS)).alias("flags"), "option_word_in", (F.col("is_mcq") & (F.col("option_word_in") == "")).alias("flagged_by_weak_trigger_only"), "question_has_choice_list", "paren_letters_match",
        F.substring(text.strip(F.regexp_replace("question", r"\s+", " ")), 1, 160).alias("question_head"), F.concat(stem, F.lit("_p"), (F.floor(F.col("_n") / per_page) + 1).cast("string"), F.lit(".png")).alias("contact_sheet_file"),
        (F.col("_n") % per_page + 1).cast("int").alias("contact_sheet_cell"),
    )


def keep_answers(rebuilt: DataFrame, old: DataFrame, item: str, answers: list[str], coded: str) -> DataFrame:
    """A rebuilt sheet with the answers that people gave to the old one. One that would lose a coded item is an error."""
    lost = old.filter(F.trim(F.coalesce(coded, F.lit(""))) != "").join(rebuilt.select(item), item, "left_anti").agg(F.count("*").alias("_lost"))
    kept = rebuilt.drop(*answers).join(old.select(item, *answers), item, "left")
    safe = F.when(F.col("_lost") == 0, True).otherwise(F.raise_error(F.lit("the rebuilt sheet drops items that people have coded")).cast("boolean"))
    return kept.join(F.broadcast(lost)).filter(safe).drop("_lost").withColumns({c: F.coalesce(c, F.lit("")) for c in answers})


def confusion_examples(cells: DataFrame, item: str, category: str, label: str, span: str, n: int, seed, prefer: dict[str, list[int]] = {}, per_page: int = 6, exclude: list[int] = []) -> DataFrame:  # noqa: B006
    """n items of every cell: those that are preferred for it, in their order, then turns over the labels, rarest label first, in hash order; among true passes, spans too short to show anything come last; excluded items are left out. With all columns of cells, page and cell."""
    cells = cells.filter(~F.col(item).isin(exclude)) if exclude else cells
    asked = F.coalesce(*(F.when((F.col(category) == c) & (F.col(item) == i), F.lit(k)) for c, items in prefer.items() for k, i in enumerate(items)), F.lit(None).cast("int"))
    cells = cells.withColumn("_asked", asked)
    wanted = F.col("_asked").isNotNull()
    short = (F.col(category) == "TP") & (F.length(text.strip(F.regexp_replace(F.coalesce(span, F.lit("")), r"\s+", " "))) < SHORTEST_EXEMPLAR)
    sizes = cells.filter(~wanted).groupBy(category, label).agg(F.count("*").alias("_size"))
    rows = cells.withColumn("_first", wanted).join(F.broadcast(sizes), [category, label], "left")  # a row a cell and label
    turn = F.row_number().over(Window.partitionBy(category, "_first", label).orderBy(short, hash_key(seed, F.col(item)), item))
    rows = rows.withColumn("_turn", F.when(F.col("_first"), 0).otherwise(turn)).filter(F.col("_turn") <= n)
    place = F.row_number().over(Window.partitionBy(category).orderBy("_turn", F.coalesce("_asked", F.lit(0)), F.coalesce("_size", F.lit(0)), label, item))
    picked = rows.withColumn("_place", place).filter(F.col("_place") <= n)
    at = F.row_number().over(Window.partitionBy(category).orderBy(F.coalesce("_asked", F.lit(1 << 30)), item)) - 1
    page = F.concat(F.lit("confusion_"), F.col(category), F.lit("_p"), (F.floor(at / per_page) + 1).cast("string"), F.lit(".png"))
    return picked.withColumn("contact_sheet_file", page).withColumn("contact_sheet_cell", (at % per_page + 1).cast("int")).drop("_first", "_size", "_turn", "_place", "_asked")


def spot_check(classified: DataFrame, item: str, n: int, seed) -> DataFrame:
    """n items that strict_v1 finds right, drawn in hash order, sorted by item: known false passes are marked, answers are empty."""
    drawn = classified.filter("v1").orderBy(hash_key(seed, F.col(item)), item).limit(n)
    return drawn.orderBy(item).select(F.col(item).alias("item"), "entropy", (F.col("category") == "false_pass_removed").alias("known_false_pass"), *(F.lit("").alias(c) for c in ("final_label", "confidence", "note")))


def unrecoverable(classified: DataFrame, audit: DataFrame, item: str, labels: tuple[str, ...] = ("extraction_issue",)) -> DataFrame:
    """Audited items with a scoring label whose majority is a failed parse: there is no answer to recover."""
    return classified.filter("majority_is_parse_failure").join(audit.filter(F.col("final_label").isin(*labels)).select(F.col("item").alias(item)).distinct(), item, "left_semi").select(F.col(item).alias("item")).orderBy("item")


def majority_field(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, answer): the whole answer field of the first sample that made the majority (null: empty)."""
    rows = traced(samples, keys)
    won = votes.votes(rows, keys).select(*keys, "majority")
    made = rows.join(won, keys).filter(F.col("label").eqNullSafe(F.col("majority"))).groupBy(*keys).agg(F.min_by(F.struct("field"), "pos").alias("m"))
    return made.select(*keys, F.coalesce("m.field", F.lit("")).alias("answer"))


def judge_sample(items: DataFrame, item: str, flag: str, shape: str, labelled: str, n: int, seed, force: list[int] = []) -> DataFrame:  # noqa: B006
    """n items of each truth: forced ones count first, then turns over the answer shapes in their fixed order, labelled items before others, in hash order."""
    forced = F.col(item).isin(force) if force else F.lit(False)
    order = F.array_position(F.array(*(F.lit(s) for s in SHAPES)), F.col(shape))
    turn = F.row_number().over(Window.partitionBy(flag, "_forced", shape).orderBy((~F.col(labelled)).cast("int"), hash_key(seed, F.col(item)), item))
    rows = items.withColumn("_forced", forced).withColumn("_turn", F.when(F.col("_forced"), 0).otherwise(turn)).filter(F.col("_turn") <= n)
    place = F.row_number().over(Window.partitionBy(flag).orderBy("_turn", order, item))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).withColumnRenamed("_forced", "forced").drop("_turn", "_place").orderBy(item)


def difference_view(a: Column, b: Column, around: int = 15) -> Column:
    """Where two texts part, as a struct: index, the characters there (<end> past the shorter one), what is around them, and a note if one is the other's beginning; null if they are equal."""
    at = text.first_difference(a, b)
    begin = F.greatest(at - around, F.lit(0))
    near = lambda s: F.substr(s, begin + 1, at + around - begin)
    char = lambda s: F.when(F.length(s) > at, F.substr(s, at + 1, F.lit(1))).otherwise("<end>")
    ended = at >= F.least(F.length(a), F.length(b))
    note = F.when(ended, F.when(F.length(a) > F.length(b), "model is longer; the other ends here").otherwise("truth is longer; the other ends here"))
    return F.when(at.isNotNull(), F.struct(at.cast("int").alias("index"), char(a).alias("model"), char(b).alias("truth"), near(a).alias("context_model"), near(b).alias("context_truth"), note.alias("note")))


def scored_clusters(clusters: DataFrame, keys: list[str], matches: Column) -> DataFrame:
    """Per item of (keys, pos, cluster, ...): entropy of the clusters, size of the largest (of equals the first met) and whether its first sample matches the truth."""
    sizes = clusters.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by(matches, "pos").alias("ok"))
    k = dbl(F.sum("n"))
    best = F.max(F.struct("n", (-F.col("first")).alias("early"), "ok"))
    out = sizes.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.abs(F.round(F.log(k) - F.sum(dbl(F.col("n")) * F.log(dbl(F.col("n")))) / k, 12)).alias("entropy"), best.alias("b"))
    return out.select(*keys, "n_clusters", "entropy", F.col("b.n").alias("majority_count"), F.coalesce("b.ok", F.lit(False)).alias("correct"))


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("string", "mv")) -> DataFrame:
    """Items that two scorers (keys, correct) judge differently, and which of them finds the item right."""
    both = a.select(*keys, F.col("correct").alias("_a")).join(b.select(*keys, F.col("correct").alias("_b")), keys).filter(F.col("_a") != F.col("_b"))
    one, two = names
    return both.select(*keys, F.when(F.col("_b"), f"{one}_wrong_{two}_right").otherwise(f"{one}_right_{two}_wrong").alias("direction"))


def open_diagnostics(frame: DataFrame, judges: tuple[str, str], rules: list[str], flag: str) -> DataFrame:
    """judge, rule, stratum: determinate items, agreement and its rate, both kinds of disagreement, and what a judge that always says yes would agree on. Strata: all, and either truth."""
    parts = []
    for j in judges:
        for r in rules:
            says, agrees, rule = F.col(f"{j}_verdict") == "correct", F.col(f"{j}_agrees_{r}"), F.col(r)
            decided = agrees.isNotNull()
            parts.append(F.struct(F.lit(j).alias("judge"), F.lit(r).alias("rule"), decided.alias("d"), F.coalesce(agrees, F.lit(False)).alias("g"), (decided & says & ~rule).alias("yes_wrong"), (decided & ~says & rule).alias("no_right"), rule.alias("r"), says.alias("s")))
    strata = F.array(F.lit("all"), F.when(F.col(flag), "has_error").otherwise("clean"))
    long = frame.select(F.explode(strata).alias("stratum"), F.array(*parts).alias("p")).select("stratum", F.inline("p"))
    d = F.count_if("d")
    return long.groupBy("judge", "rule", "stratum").agg(
        F.count("*").alias("n"), d.alias("n_determinate"), F.count_if("g").alias("agree"), ratio(F.count_if("g"), d).alias("rate"), F.count_if("yes_wrong").alias("judge_yes_rule_wrong"), F.count_if("no_right").alias("judge_no_rule_correct"),
        ratio(F.count_if(F.col("d") & F.col("r")), d).alias("always_yes_agreement"), F.count_if("s").alias("n_yes"),
    )


def decode_guard(texts: DataFrame, status: Column, corrupt: tuple[str, ...] = ("bpe_markers_leaked", "shredded", "marker_corrupted"), tolerate: float = 0.0) -> DataFrame:
    """n, n_corrupt, corrupt_rate of a judge's outputs; more than is tolerated is an error, before any verdict is recorded."""
    out = texts.agg(F.count("*").alias("n"), F.count_if(status.isin(*corrupt)).alias("n_corrupt")).withColumn("corrupt_rate", F.coalesce(ratio(F.col("n_corrupt"), F.col("n")), F.lit(0.0)))
    ok = F.when(F.col("corrupt_rate") <= tolerate, True).otherwise(F.raise_error(F.concat(F.lit("corrupt judge outputs: "), F.col("n_corrupt").cast("string"))).cast("boolean"))
    return out.filter(ok)


def feasibility(run: DataFrame, correct: str, by: list[str] = [], minority: int = 30, least: float = 0.05) -> DataFrame:  # noqa: B006
    """Per group whether a run misgrades enough to go on, and how many items it takes for that many misgrades."""
    out = run.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col(correct)).alias("n_misgraded")).withColumn("misgrade_rate", ratio(F.col("n_misgraded"), F.col("n")))
    ok = F.coalesce(F.col("misgrade_rate") >= least, F.lit(False))
    return out.withColumns({"gate": F.when(ok, "feasible").otherwise("gated"), "projected_items": F.when(ok, F.floor(F.lit(float(minority)) / F.col("misgrade_rate")))})


def screen_verdict(n_error: Column, n_correct: Column, auroc: Column, excludes: Column, passing: float = 0.70, minority: int = 30) -> Column:
    return F.when(F.least(n_error, n_correct) < minority, "inconclusive_underpowered").when((auroc >= passing) & excludes, "passes_screen").otherwise("does_not_pass")


def same_config(stored: DataFrame, expected: DataFrame, provenance: list[str] = []) -> DataFrame:  # noqa: B006
    """key, stored, expected of settings (key, value) that stop a resume: those that a stored run has otherwise, or that are no longer known. Keys that are new since are fine."""
    both = stored.withColumnRenamed("value", "stored").withColumn("_s", F.lit(1)).join(expected.withColumnRenamed("value", "expected").withColumn("_e", F.lit(1)), "key", "full_outer")
    differs = F.col("_s").isNotNull() & ~F.col("stored").eqNullSafe(F.col("expected"))
    return both.filter(differs & (~F.col("key").isin(provenance) if provenance else F.lit(True))).select("key", "stored", "expected")


def binomial_interval(n: Column, k: Column, reps: int, seed: int = 0) -> Column:
    """Parametric bootstrap interval of a proportion, as a struct: 2.5 and 97.5 % points of `reps` binomial draws."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("struct<ci_low: double, ci_high: double>")
    def drawn(n, k):
        import numpy as np
        import pandas as pd

        rows = [np.percentile(np.random.default_rng([seed, int(a), int(b)]).binomial(int(a), b / a, reps) / a, [2.5, 97.5]) if a else (None, None) for a, b in zip(n, k, strict=True)]
        return pd.DataFrame(rows, columns=["ci_low", "ci_high"])

    return drawn(n.cast("long"), k.cast("long"))


def grading_samples(raw: Column, arm: str) -> Column:
    """A stored list of samples (JSON, or the quoted list of a CSV file without quotes inside) as parsed values: digits, or answer fields."""
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.from_json(F.translate(raw, "'", '"'), "array<string>"))
    return F.transform(listed, text.parse_digit if arm == "grading" else text.parse_answer)


def case_index(bundles: DataFrame, item: str, case: str = "case") -> DataFrame:
    """What a reader needs to find a bundle: run, category, arm, model, entropy, verdict, whether there is an image, the note's beginning; of a damaged document its text instead."""
    kind = "run_label string, category string, arm string, model_id string, image string, note string, derived struct<entropy: double, correct: boolean>, _damaged string"
    doc = F.from_json(case, kind, {"columnNameOfCorruptRecord": "_damaged"})
    rows = bundles.select(F.col(item).cast("string").alias("case_id"), doc.alias("d"))
    return rows.select(
        "case_id", "d.run_label", "d.category", "d.arm", "d.model_id", F.col("d.derived.entropy").alias("entropy"), F.col("d.derived.correct").alias("correct"), F.col("d.image").isNotNull().alias("has_image"),
        F.substring(F.coalesce("d.note", F.lit("")), 1, 200).alias("note"), F.col("d._damaged").alias("damaged"),
    ).orderBy("case_id")
