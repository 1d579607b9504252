"""Text rules as column expressions: parsing of responses, canonical answers, labels, flags, judge verdicts.

Everything here is built from SQL functions and stays in generated code; scans that need a stack of braces are in
`scans`. A failed parse is null until it becomes a label, where it is the sentinel. White space is ASCII's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, patterns and word lists of the response format and of the scoring rules.
SENTINEL = "<PARSE_FAILURE>"
ANSWER_PATTERNS = (
    r"(?s)\*\*Answer\s*[:：]?\s*\*\*\s*(.*)",
    r"(?s)\\textbf\{\(?Answer\)?\s*[:：]?\s*\}?\s*[:：]?\s*(.*)",
    r"(?s)(?:^|\n)\s*Answer\s*[:：]\s*(.*)",
)
TRAILING_JUNK = r"(?s)(?:```|\\end\{document\}).*"
ERROR_DIGIT = r"\*\*Error:\*\*\s*([01])"
REASONING = r"(?s)\*\*Reasoning:\*\*\s*(.*?)\s*\*\*Error:\*\*"
CONFIDENCE = r"\*\*Confidence:\*\*\s*(\d{1,3})"
WRAPPERS = (
    (r"\\text\{([^{}]*)\}", "$1"),
    (r"\\textcolor\{[^{}]*\}\{([^{}]*)\}", "$1"),
    (r"\\begin\{align\*?\}|\\end\{align\*?\}", " "),
    (r"\\\[|\\\]|\\\(|\\\)", " "),
    (r"\\left|\\right", ""),
    (r"\\quad|\\qquad", " "),
    (r"&|\\\\", " "),
)
OPTION = r"(?i)option\s*[:\-]?\s*([a-d])\b"
BOXED = r"\\boxed\{([^{}]*)\}"
DISPLAY_MATH = r"(?s)\\\[(.*?)\\\]|\$\$(.*?)\$\$|\\\((.*?)\\\)|\$([^$]*?)\$"
MATH_MARKS = r"^(?:\\\[|\$\$|\\\(|\$)|(?:\\\]|\$\$|\\\)|\$)$"
ENVIRONMENT_MARK = r"^\\(?:begin|end)\{[^{}]*\}$"
LINE_ENDS = r"[\n.]"
LINE_ENDS_KEEP_DECIMALS = r"\n|(?<!\d)\.|\.(?!\d)"
SPACING = r"\\[,;:!]|\\quad|\\qquad|\\ |\\;|\\thinspace"
CURRENCY = r"[₹$€£¥]|\\rs\.?|\brs\.?\s"
SINGLE_BRACE = r"\{(\w)\}"
OPTION_WORD = r"(?i)\boption\b"
BARE_OPTION = r"^\(?\s*(?:option\s*)?[a-eA-E]\s*\)?[.)]?$"
PAREN_LETTERS = r"(?i)\(\s*[a-d]\s*\)[^\n]{0,60}\(\s*[b-e]\s*\)"
CHOICE_LIST = r"\\begin\{enumerate\}|\\item\b"
#: The last alternative stands for a brace that no letter comes before: a place before it is taken along, as the checking engine has no lookbehind.
SET_MARKS = r"\\[{}]|\\(?:cup|cap|setminus|subset|supset|emptyset)\b|\\in\b|(?:^|[^a-zA-Z])\{[^{}]*,[^{}]*\}"
DERIVATIVE = r"(?i)\\frac\s*\{\s*d(?:\^?\d?)?\s*[a-z]?\s*\}|\bd\^?2?\s*y\s*/\s*d\s*x|\\mathrm\{d\}|derivative\(|\bdy\s*/\s*dx\b"
MALFORMED_DERIVATIVE = r"(?i)d\*\*\d\s*\*\s*[a-z]|/\s*\(?\s*dx\s*\*\*|\bdx\*\*\d"
FUNCTION_WORDS = (
    "eq", "log", "tan", "sin", "cos", "cot", "sec", "csc", "exp", "sqrt", "abs", "integral", "derivative", "limit", "sum", "pi", "oo", "re", "im", "conjugate", "matrix", "and", "or", "true", "false",
)
NUMERIC = r"^[-+]?\d[\d\s.,/*^+\-]*$"
NUMERIC_WITH_UNIT = r"(?i)^[-+]?\d[\d\s.,/*^+\-]*\\?[a-z%°]{0,12}\.?$"
VERDICT_BOXED = r"(?i)\\boxed\s*\{\s*(yes|no)\s*\}"
VERDICT_BARE = r"(?i)^\**\s*(yes|no)\s*[.!]?\**$"
JUDGEMENT = r"(?i)judg?e?ment\W{0,4}(true|false)"
JUDGEMENT_MARKER = r"(?i)equivalencejudg(?:e)?ment"
BPE_SPACE = "Ġ"
SOLVING = (
    r"(?i)\b(should be|actually|the correct answer|correctly comput|recomput|let(?:'s| us) (?:calculate|compute|solve)|we (?:calculate|compute|solve|get)|"
    r"solving (?:this|the)|therefore the answer is|the right answer|is wrong|is incorrect because|standard answer (?:is|appears) (?:wrong|incorrect))\b"
)
TOKEN = r"-?\d+(?:\.\d+)?|[A-Za-z]+|\\[A-Za-z]+"
NUMBER_TOKEN = r"\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(c: Column, body) -> Column:
    """body(c), with c worked out once; where this stands in a branch that isn't taken, neither is."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _or_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# ---- responses ----


def parse_answer(response: Column) -> Column:
    """The answer field after the first marker form that occurs, up to a fence or the document's end; null if none or empty."""
    found = F.coalesce(*(F.try_element_at(_all(response, p, 1), F.lit(1)) for p in ANSWER_PATTERNS))
    return _or_null(strip(F.regexp_replace(found, TRAILING_JUNK, "")))


def parse_digit(response: Column) -> Column:
    return F.when(response.rlike(ERROR_DIGIT), F.regexp_extract(response, ERROR_DIGIT, 1).cast("int"))


def parse_reasoning(response: Column) -> Column:
    return F.when(response.rlike(REASONING), _or_null(strip(F.regexp_extract(response, REASONING, 1))))


def parse_confidence(response: Column) -> Column:
    """0 to 100; what lies outside is no confidence, and isn't clamped."""
    n = F.when(response.rlike(CONFIDENCE), F.regexp_extract(response, CONFIDENCE, 1).cast("int"))
    return F.when(n.between(0, 100), n)


def digit_matches(digit: Column, has_error: Column) -> Column:
    return F.coalesce(digit == has_error.cast("int"), F.lit(False))


def cluster_matches(cluster: Column, has_error: Column) -> Column:
    return F.coalesce(cluster.isin("0", "1") & (cluster == has_error.cast("int").cast("string")), F.lit(False))


# ---- labels ----


def normalize(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(strip(c)), r"\.+$", ""), F.lit(SENTINEL))


def structural_clean(c: Column) -> Column:
    cleaned = reduce(lambda x, rule: F.regexp_replace(x, *rule), WRAPPERS, c)
    return F.regexp_replace(F.lower(strip(F.regexp_replace(cleaned, r"\s+", " "))), r"\.+$", "")


def extract_final(c: Column, keep_decimals: bool = False) -> Column:
    """Last option letter, else last boxed, else last display math that isn't empty, else last line that isn't an environment mark."""
    return let(strip(c), lambda text: _final(text, keep_decimals))


def _final(text: Column, keep_decimals: bool) -> Column:
    last = lambda pattern: _last(_all(text, pattern, 1))
    math = F.filter(F.transform(_all(text, DISPLAY_MATH), lambda m: strip(F.regexp_replace(m, MATH_MARKS, ""))), lambda m: m != "")
    lines = F.transform(F.split(text, LINE_ENDS_KEEP_DECIMALS if keep_decimals else LINE_ENDS, -1), strip)
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(ENVIRONMENT_MARK))
    # coalesce stops at the first that is there
    return F.coalesce(F.concat(F.lit("option "), F.lower(last(OPTION))), strip(last(BOXED)), _last(math), _last(lines))


def canonical(c: Column) -> Column:
    """The text tier (no parser of formulas is present): text:<cleaned>, or the sentinel."""
    return F.coalesce(F.concat(F.lit("text:"), _or_null(structural_clean(c))), F.lit(SENTINEL))


def answer_label(c: Column) -> Column:
    """strict_v1: extract, canonicalise, normalise; the same for samples and truths."""
    return normalize(canonical(extract_final(c)))


def cosmetic(label: Column) -> Column:
    return let(label, _cosmetic)


def _cosmetic(label: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(label, SPACING, ""), CURRENCY, ""), SINGLE_BRACE, "$1")
    return F.coalesce(_or_null(F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), r"[.,;]+$", "")), label)


def payload(label: Column) -> Column:
    """A label without its tier."""
    return F.regexp_replace(label, r"(?s)^[^:]*:", "")


def extraction_tier(field: Column) -> Column:
    return (
        F.when(field.isNull(), "parse_fail").when(field.rlike(OPTION), "option").when(field.rlike(BOXED), "boxed").when(field.rlike(DISPLAY_MATH), "display_math").otherwise("last_line")
    )


def is_boxed(field: Column) -> Column:
    return F.coalesce(field.rlike(BOXED), F.lit(False))


def clip(c: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first difference; the shorter's length if it is a prefix; null if equal."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(a == b, None).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n))


# ---- flags of answers ----


def looks_multiple_choice(question: Column, span: Column, field: Column) -> Column:
    blob = F.concat_ws(" ", question, span, field)
    return blob.rlike(OPTION_WORD) | blob.rlike(PAREN_LETTERS)


def is_prose(span: Column) -> Column:
    words = F.transform(_all(span, r"[A-Za-z]{3,}"), F.lower)
    return F.size(F.filter(words, lambda w: ~w.isin(*FUNCTION_WORDS))) >= 3


def answer_flags(span: Column, norm: Column, label: Column, is_choice: Column) -> dict[str, Column]:
    """Shape and risk flags of one side. norm: the span's normal form."""
    bare = strip(norm)
    equals = lambda x: F.length(x) - F.length(F.replace(x, F.lit("="), F.lit("")))
    parts = F.filter(F.split(bare, r",|;|\band\b|\\quad", -1), lambda p: strip(p) != "")
    commas = F.filter(F.split(bare, ",", -1), lambda p: strip(p) != "")
    payload = F.coalesce(F.regexp_replace(label, r"(?s)^[^:]*:", ""), F.lit(""))
    tiny = F.length(bare) <= 3
    several = (F.size(commas) >= 2) & (equals(bare) == 0) & (F.length(bare) > 3)
    system = F.size(F.filter(parts, lambda p: p.contains("="))) >= 2
    eq_calls = F.size(_all(payload, r"eq\("))
    return {
        "mcq_option": bare.rlike(OPTION_WORD) | (is_choice & bare.rlike(BARE_OPTION)),
        "tiny_valid_mcq": tiny & is_choice,
        "tiny_suspicious_non_mcq": tiny & ~is_choice,
        "multi_value_answer": several,
        "set_answer": span.rlike(SET_MARKS),
        "system_answer": system,
        "derivative_equation": span.rlike(DERIVATIVE),
        "text_conclusion": is_prose(bare),
        "sympy_partial_parse_risk": (payload != "") & system & (eq_calls <= 1),
        "sympy_malformed_derivative": payload.rlike(MALFORMED_DERIVATIVE),
        "multi_answer_collapse": (payload != "") & several & (F.length(payload) <= F.greatest(F.lit(3), F.floor(F.length(bare) / 3))),
    }


HIGH_FLAGS = ("tiny_suspicious_non_mcq", "multi_answer_collapse", "sympy_partial_parse_risk", "sympy_malformed_derivative")
MEDIUM_FLAGS = ("multi_value_answer", "set_answer", "system_answer", "derivative_equation", "text_conclusion")


def any_of(flags) -> Column:
    return reduce(lambda a, b: a | b, flags)


def review_priority(disagree: Column, flags: dict[str, Column]) -> Column:
    return F.when(disagree | any_of(flags[f] for f in HIGH_FLAGS), "high").when(any_of(flags[f] for f in MEDIUM_FLAGS), "medium").otherwise("low")


def truth_type(flags: dict[str, Column], span: Column, norm: Column) -> Column:
    bare = strip(F.coalesce(span, F.lit("")))
    return (
        F.when(bare == "", "unknown").when(flags["mcq_option"] | flags["tiny_valid_mcq"], "mcq_option").when(flags["set_answer"], "set_answer")
        .when(flags["system_answer"], "system_answer").when(flags["derivative_equation"], "derivative_equation").when(flags["multi_value_answer"], "multi_value")
        .when(flags["text_conclusion"], "text_conclusion").when(norm.rlike(NUMERIC) | norm.rlike(NUMERIC_WITH_UNIT), "numeric").otherwise("single_expression")
    )


def either_side_type(flags: dict[str, Column], fallback: str = "numeric_or_expression") -> Column:
    order = (("mcq_option", "mcq_option"), ("tiny_valid_mcq", "mcq_option"), ("set_answer", "set_answer"), ("system_answer", "system_answer"), ("derivative_equation", "derivative_equation"), ("multi_value_answer", "multi_value"), ("text_conclusion", "text_conclusion"))
    return F.coalesce(*(F.when(flags[f], name) for f, name in order), F.lit(fallback))


def judge_answer_type(flags: dict[str, Column]) -> Column:
    order = (("mcq_option", "mcq"), ("tiny_valid_mcq", "mcq"), ("derivative_equation", "derivative"), ("set_answer", "set"), ("system_answer", "system"), ("multi_value_answer", "multi_value"), ("text_conclusion", "text_conclusion"))
    return F.coalesce(*(F.when(flags[f], name) for f, name in order), F.lit("numeric_or_algebra"))


def choice_trigger(question: Column, span: Column, field: Column) -> dict[str, Column]:
    """Which signal makes a question look like multiple choice, and the text that matched."""
    q, s, f = (F.coalesce(x, F.lit("")) for x in (question, span, field))
    sides = F.concat_ws(",", F.when(q.rlike(OPTION_WORD), "question"), F.when(s.rlike(OPTION_WORD), "truth_span"), F.when(f.rlike(OPTION_WORD), "answer_field"))
    blob = F.concat_ws(" ", q, s, f)
    has_list, paren = q.rlike(CHOICE_LIST), blob.rlike(PAREN_LETTERS)
    presort = F.when((sides != "") & has_list, "option_word_and_choice_list").when(sides != "", "option_word_only").when(has_list, "choice_list_only").when(paren, "paren_letters_only").otherwise("not_flagged")
    return {"presort": presort, "option_word_in": sides, "question_has_choice_list": has_list, "paren_letters_match": F.substring(F.regexp_extract(blob, PAREN_LETTERS, 0), 1, 60), "flagged_by_detector": (sides != "") | paren}


# ---- judges ----


def parse_verdict(text: Column) -> Column:
    """Last boxed yes or no; else the last line, if it is nothing but the verdict; else unclear."""
    boxed = F.lower(_last(_all(text, VERDICT_BOXED, 1)))
    tail = strip(_last(F.split(strip(text), r"\r?\n", -1)))
    said = F.coalesce(boxed, F.lower(_or_null(F.regexp_extract(tail, VERDICT_BARE, 1))))
    return F.when(said == "yes", "correct").when(said == "no", "incorrect").otherwise("unclear")


def parse_prefix_verdict(text: Column) -> Column:
    s = F.upper(strip(text))
    return F.when(s.startswith("TRUE"), "correct").when(s.startswith("FALSE"), "incorrect").otherwise("unclear")


def parse_squashed_verdict(text: Column) -> Column:
    said = F.lower(_last(_all(F.regexp_replace(text, r"\s+", ""), JUDGEMENT, 1)))
    return F.when(said == "true", "correct").when(said == "false", "incorrect").otherwise("unclear")


def looks_like_solving(text: Column) -> Column:
    return F.coalesce(text.rlike(SOLVING), F.lit(False))


def looks_bpe_mangled(text: Column) -> Column:
    return F.coalesce(text.contains(BPE_SPACE), F.lit(False))


def demangle_bpe(text: Column) -> Column:
    return F.coalesce(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(BPE_SPACE), F.lit(" ")), F.lit(""))


def output_health(text: Column) -> Column:
    s = F.coalesce(text, F.lit(""))
    squashed = F.regexp_replace(s, r"\s+", "")
    n = F.length(squashed)
    hashes = n - F.length(F.replace(squashed, F.lit("#"), F.lit("")))
    return (
        F.when(n == 0, "empty").when(s.contains(BPE_SPACE), "bpe_markers_leaked").when((n >= 40) & (hashes > 0.25 * n), "shredded").when(squashed.rlike(JUDGEMENT_MARKER), "clean")
        .when(squashed.rlike("(?i)true|false"), "marker_corrupted").when(n < 120, "stopped_before_verdict").otherwise("no_marker")
    )


def build_prompt(template: str, **fields: Column) -> Column:
    """A template with {name} places filled by trimmed columns (null: empty)."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), strip(F.coalesce(kv[1], F.lit("")))), fields.items(), F.lit(template))


def build_question_prompt(template: str, question: Column) -> Column:
    """A template whose question is all that states the task: a blank one is an error, not an unanswerable prompt."""
    blank = F.raise_error(F.lit("a prompt needs a question that is not blank")).cast("string")
    return build_prompt(template, question=F.when(strip(F.coalesce(question, F.lit(""))) == "", blank).otherwise(question))


# ---- surfaces and tokens ----


def tokens(c: Column) -> Column:
    return F.array_distinct(_all(F.coalesce(c, F.lit("")), TOKEN))


def numeric_surface(*texts: Column) -> Column:
    """Fractions as a/b however deep (a round for each that the text holds: no text nests deeper), thousands without commas, no blanks around the slash."""
    joined = F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))
    n = F.size(_all(joined, r"\\[dt]?frac"))
    rounds = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    joined = F.aggregate(rounds, joined, lambda s, _: F.regexp_replace(s, r"\\[dt]?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "$1/$2"))
    return F.regexp_replace(F.regexp_replace(joined, r"(?<=\d),(?=\d\d\d)", ""), r"\s*/\s*", "/")


def invented_tokens(rationale_surface: Column, source_surface: Column, min_len: int = 2) -> Column:
    found = F.array_distinct(_all(F.coalesce(rationale_surface, F.lit("")), NUMBER_TOKEN))
    return F.filter(found, lambda t: (F.length(t) >= min_len) & ~F.contains(source_surface, t))


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def content_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by the unit separator; null parts are empty."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "\x1f"), 256)
