"""Pieces of the checking SQL: the bindings of generic tables, and text rules."""

EV = """ev as (select user_id item_id, event_type as label, row_number() over (partition by user_id order by ts, event_id) - 1 pos from events),
sm as (select * from ev where pos < 5), tr as (select item_id, label truth from ev where pos = 5),
cn as (select item_id, label, count(*) n, min(pos) f from sm group by all),
vt as (select item_id, sum(n)::bigint k, count(*) n_distinct, abs(round(ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double, 12)) entropy,
  (list(label order by n desc, f))[1] majority, max(n) majority_count, max(n)/sum(n)::double majority_fraction, (max(n) - coalesce((list(n order by n desc))[2], 0))/sum(n)::double majority_margin from cn group by 1),
run as (select vt.*, truth, majority = truth correct, case when item_id % 2 = 0 then 'even' else 'odd' end stratum from vt join tr using (item_id))"""

LB = """lb as (select d.doc_id item_id, n_chars::double score, n_chars, lang, source, quality = 1 correct, toxic = 1 toxic,
  [0.0, 0.500402, 0.673012, 0.950271, 1.05492, 1.332179, 1.609438][(n_chars % 7 + 1)::int]::double h, (n_chars % 5 = 0)::int fails from documents d join labels l on d.doc_id = l.doc_id)"""

RS = r"""li as (select l_orderkey item_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 pos, l_partkey, l_quantity::int % 4 v from lineitem),
rs as (select item_id, pos, case (l_partkey + pos) % 8 when 0 then '**Answer:** $x=' || v || '$' when 1 then '**Answer:** The value is ' || v || '.5 cm.' when 2 then '\textbf{Answer: Option ' || chr(65 + v) || '}'
  when 3 then 'Working' || chr(10) || 'Answer: \boxed{' || v || '}' when 4 then '**Answer:** \[ \text{x} = ' || v || ' \]' when 5 then 'no marker ' || v when 6 then '**Answer:** {2}\,' || v || ' + y; z, $ 5.'
  else '**Answer:** Option ' || chr(97 + v) || ' ``` junk' end response from li),
od as (select o_orderkey item_id, ['Which option holds for ', 'What is x for ', 'Is it (a) more or (b) less of ', 'Match \item x with ', 'Find y for '][(o_custkey % 5 + 1)::int] || o_orderpriority || '?' question, case o_custkey % 4 when 0 then '$x=' || (o_orderkey % 4) || '$' when 1 then 'The value is ' || (o_orderkey % 4) || '.5 cm'
  when 2 then 'Option ' || chr((65 + o_orderkey % 4)::int) else '\boxed{' || (o_orderkey % 4) || '}' end truth, o_orderstatus = 'F' has_error from orders)"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def parse_answer(x: str) -> str:
    forms = (r"(?s)\*\*Answer\s*[:：]?\s*\*\*\s*(.*)", r"(?s)\\textbf\{\(?Answer\)?\s*[:：]?\s*\}?\s*[:：]?\s*(.*)", r"(?s)(?:^|\n)\s*Answer\s*[:：]\s*(.*)")
    cases = " ".join(f"when regexp_matches({x}, '{f}') then regexp_extract({x}, '{f}', 1)" for f in forms)
    return "nullif(" + strip(rf"regexp_replace(case {cases} end, '(?s)(?:```|\\end\{{document\}}).*', '', 'g')") + ", '')"


def normalize(x: str) -> str:
    return rf"coalesce(regexp_replace(lower({strip(x)}), '\.+$', ''), '<PARSE_FAILURE>')"


def structural(x: str) -> str:
    rules = ((r"\\text\{([^{}]*)\}", r"\1"), (r"\\textcolor\{[^{}]*\}\{([^{}]*)\}", r"\1"), (r"\\begin\{align\*?\}|\\end\{align\*?\}", " "), (r"\\\[|\\\]|\\\(|\\\)", " "), (r"\\left|\\right", ""), (r"\\quad|\\qquad", " "), (r"&|\\\\", " "), (r"\s+", " "))
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return rf"regexp_replace(lower({strip(x)}), '\.+$', '')"


DISPLAY = r"(?s)\\\[(.*?)\\\]|\$\$(.*?)\$\$|\\\((.*?)\\\)|\$([^$]*?)\$"


def extract_final(x: str, keep_decimals: bool = False) -> str:
    t = strip(x)
    marks = r"^(?:\\\[|\$\$|\\\(|\$)|(?:\\\]|\$\$|\\\)|\$)$"
    held = t
    if keep_decimals:  # a stop between digits is no line end
        held = rf"regexp_replace(regexp_replace({t}, '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g')"
    lines = rf"list_filter(list_transform(string_split_regex({held}, '[\n.]'), lambda y: replace({strip('y')}, chr(1), '.')), lambda y: y <> '' and not regexp_matches(y, '^\\(?:begin|end)\{{[^{{}}]*\}}$'))"
    math = f"list_filter(list_transform(regexp_extract_all({t}, '{DISPLAY}'), lambda m: {strip(f"regexp_replace(m, '{marks}', '', 'g')")}), lambda m: m <> '')"
    opts, box = rf"regexp_extract_all({t}, '(?i)option\s*[:\-]?\s*([a-d])\b', 1)", rf"regexp_extract_all({t}, '\\boxed\{{([^{{}}]*)\}}', 1)"
    return f"case when {t} = '' then null when len({opts}) > 0 then 'option ' || lower({opts}[-1]) when len({box}) > 0 then {strip(f'{box}[-1]')} else coalesce({math}[-1], {lines}[-1]) end"


def canonical(x: str) -> str:
    return f"case when {x} is null or {structural(x)} = '' then '<PARSE_FAILURE>' else 'text:' || {structural(x)} end"


def label(field: str, src: str, carry: str) -> str:
    """A relation: carry and lab (strict_v1) of a field of src, in steps, so that no step repeats a large expression."""
    return f"(select {carry}, {normalize('c_')} lab from (select *, {canonical('f_')} c_ from (select *, {extract_final(field)} f_ from {src})))"


def tier(x: str) -> str:
    return rf"case when {x} is null then 'parse_fail' when regexp_matches({x}, '(?i)option\s*[:\-]?\s*([a-d])\b') then 'option' when regexp_matches({x}, '\\boxed\{{([^{{}}]*)\}}') then 'boxed' when regexp_matches({x}, '{DISPLAY}') then 'display_math' else 'last_line' end"


def normal_span(x: str) -> str:
    """normalize_span where macros are not nested. Macros, spacing and operators of the rule."""
    rules = (
        (r"\\(?:textcolor\{[^{}]*\}|text|mathrm|mathbf|textbf|mbox|operatorname)\{([^{}]*)\}", r"\1"), (r"\\(?:,|;|:|!|quad|qquad|ensuremath|displaystyle|left|right|bigl|bigr|hspace\{[^}]*\})", " "), (r"\\times|\\cdot", "*"), (r"\\div", "/"),
        (r"\\([{}])", r"\1"), (r"(\\[a-zA-Z]+)\s*", r"\1 "), (r"\$", ""), (r"\\\\", " "), (r"[ \t\n\r]+", " "), (r"^\s+|\s+$", ""), (r"[.;,]+$", ""), (r"\s*([=+\-*/,])\s*", r"\1"), (r"^\s+|\s+$", ""),
    )
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"coalesce(lower({x}), '')"


PR = f"pr as (select *, {parse_answer('response')} field from rs)"
#: Votes over strict_v1 labels of the responses, with the truth's label.
SC = f"""{PR}, sl as {label('field', 'pr', 'item_id, pos, field')}, tl as {label('truth', 'od', 'item_id, has_error')},
cs as (select item_id, lab, count(*) n, min(pos) f from sl group by all),
sv as (select item_id, sum(n)::bigint k, count(*) n_distinct, abs(round(ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double, 12)) entropy, (list(lab order by n desc, f))[1] majority from cs group by 1),
fl as (select item_id, count(*) filter (field is null) n_parse_failures from sl group by 1),
sc as (select sv.*, n_parse_failures, tl.lab truth_label, majority = tl.lab correct, has_error from sv join fl using (item_id) join tl using (item_id))"""


def auroc(src: str, score: str, correct: str, by: str = "") -> str:
    """By average ranks."""
    p = f"partition by {by}" if by else ""
    part = f"partition by {by}, {score}" if by else f"partition by {score}"
    sel = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    return f"""select {sel}count(*) n_items, count(*) filter (not {correct}) n_error, count(*) filter ({correct}) n_correct,
(sum(rk) filter (not {correct}) - (count(*) filter (not {correct}))::double * ((count(*) filter (not {correct})) + 1) / 2) / nullif((count(*) filter (not {correct}))::double * (count(*) filter ({correct})), 0) auroc
from (select *, rank() over ({p} order by {score}) + (count(*) over ({part}) - 1) / 2.0::double rk from {src} where {score} is not null and {correct} is not null) {g}"""


def curve(src: str, score: str, correct: str) -> str:
    return f"""select s threshold, (sum(n) over o)::bigint n_kept, (sum(b) over o)::bigint n_errors_kept, (sum(n) over ())::bigint n_items, (sum(b) over ())::bigint n_errors, (sum(n) over o)::double / sum(n) over () coverage, (sum(b) over o)::double / sum(n) over o risk_kept
from (select round({score}, 12) s, count(*) n, count(*) filter (not {correct}) b from {src} group by 1) window o as (order by s)"""


def uniform(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"({k})::varchar" for k in keys)])
    return f"(('0x' || sha256({text})[1:8])::bigint)"


def hash_key(seed: str, key: str) -> str:
    return f"sha256('{seed}|' || ({key})::varchar)"
