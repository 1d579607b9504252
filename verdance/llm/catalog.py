"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import lexical, lmscore, media, mixing, packing, pieces, quality, rules, sessions, sharding, simhash, suffixdedup, warc
from .common import table

QUERIES = {
    "op1_simhash_anchors": lambda s, d: simhash.op1(table(s, d, "documents")),
    "op2_sampled_splitters": lambda s, d: sharding.shard(table(s, d, "documents")),
    "op3_sentencepiece_suffix_array": lambda s, d: pieces.op3(table(s, d, "documents")),
    "op4_suffix_tree_lm": lambda s, d: lmscore.op4(table(s, d, "documents")),
    "op5_quadratic_discriminant": lambda s, d: quality.op5(table(s, d, "documents"), table(s, d, "labels")),
    "op6_content_addressed_warc": lambda s, d: warc.op6(table(s, d, "pages")),
    "op7_column_wise_suffixes": lambda s, d: suffixdedup.op7(table(s, d, "documents")),
    "op8_pattern_packing": lambda s, d: packing.op8(table(s, d, "documents")),
    "op9_divergence_rules": lambda s, d: rules.op9(table(s, d, "documents")),
    "op10_media_tiles": lambda s, d: media.op10(table(s, d, "documents")),
    "op11_threshold_seeded_join": lambda s, d: lexical.op11(table(s, d, "documents"), table(s, d, "benchmark")),
    "op12_low_discrepancy_schedule": lambda s, d: mixing.op12(table(s, d, "documents")),
    "op13_session_versions": lambda s, d: sessions.op13(table(s, d, "conversations")),
}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::int >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))

def _crc32(text: str) -> str:
    """crc32 of an ASCII text: byte by byte, bit by bit."""
    bit = "list_reduce(list_prepend(xor(c, b), range(8)::bigint[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: {bit}), 4294967295)"


ORACLES: dict[str, str] = {
    "op6_content_addressed_warc": f"""with p as (select page_id, coalesce(html, '') b, sha1(coalesce(html, '')) h from pages), f as (select *, min(page_id) over (partition by b) first from p)
select page_id, strlen(b) payload_bytes, {_BASE32} payload_digest, case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to from f""",
    # windows by their bytes (as hex digits, two a byte): small tables only
    "op7_column_wise_suffixes": """with t as (select doc_id, hex(encode(coalesce(text, ''))) x from documents), b as (select doc_id, x, unnest(range(len(x) // 2)) p from t), w as (select doc_id, p, substr(x, 2 * p + 1, 2) byte, case when 2 * (p + 50) <= len(x) then substr(x, 2 * p + 1, 100) end win from b),
m as (select doc_id, p, byte, case when win is not null and min(doc_id) over (partition by win) < doc_id then p end hit from w), c as (select doc_id, p, byte, max(hit) over (partition by doc_id order by p rows between 49 preceding and current row) is not null gone from m),
s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) opens from c), g as (select doc_id, count(*) filter (gone) n_removed, count(*) filter (opens) n_spans, string_agg(byte, '' order by p) filter (not gone) kept from s group by 1)
select t.doc_id, len(x) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from t left join g using (doc_id)""",
    "op11_threshold_seeded_join": r"""with raw as (select doc_id, row_number() over () d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
docs as (select *, len(t)::bigint n from raw where len(t) > 0), corpus as (select count(*)::bigint nn, sum(n)::bigint l from docs), tf as (select d, t, count(*)::bigint tf from (select d, unnest(t) t from docs) group by 1, 2),
w as (select t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::bigint w from tf, corpus group by t, nn),
wanted as (select i, t, count(*)::bigint q from (select row_number() over () i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark) group by 1, 2), names as (select item_id, row_number() over () i from benchmark),
scored as (select i, d, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))))::bigint score from wanted join w using (t) join tf using (t) join docs using (d), corpus group by 1, 2),
ranked as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last)::int "rank" from scored join docs using (d) where score > 0) select item_id, "rank", doc_id, score from ranked join names using (i) where "rank" <= 10""",
    # the schedule by its points, one by one; places by one running sum a source
    "op12_low_discrepancy_schedule": """with t as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) k from documents),
s as (select source, sum(size)::bigint words, row_number() over (order by source nulls last) - 1 no from t group by 1), sw as (select *, [5, 2, 1][no % 3 + 1] w from s),
o as (select *, coalesce(sum(2 * words) over b, 0)::double capped, (select sum(w) from sw) - coalesce(sum(w) over b, 0) w_left from sw window b as (order by 2 * words / w, no rows between unbounded preceding and 1 preceding)),
lv as (select max(level) level from (select ((select 1.5 * sum(words) from s) - capped)::double / w_left::double as level from o)), tg as (select source, no, words, least(2.0 * words, level * w)::double target, greatest(floor(least(2.0 * words, level * w)), 0)::hugeint whole from sw, lv),
tot as (select sum(whole) q, least(4096, greatest(1, sum(whole)::bigint >> 20)) block from tg), e as (select *, (coalesce(sum(whole) over (order by no rows between unbounded preceding and 1 preceding), 0) * 1099511627776 // greatest(q, 1))::bigint lo, (sum(whole) over (order by no) * 1099511627776 // greatest(q, 1))::bigint hi from tg, tot),
sl as (select list_sum(list_transform(range(40), lambda b: ((j >> b) & 1) << (39 - b)))::bigint x from (select unnest(range(((select q from tot) // (select block from tot) + case when (select q from tot) % (select block from tot) > 0 then 1 else 0 end)::bigint)) j)),
c as (select no, count(x) n from e left join sl on x >= lo and x < hi group by 1), p as (select doc_id, size, words, target, n * block reach, coalesce(sum(size) over (partition by no order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) a from t join e on t.source is not distinct from e.source join c using (no))
select doc_id, size, words source_size, target, (greatest(least(a + size, reach) - a, 0) + greatest(least(a + size + words, reach) - a - words, 0))::bigint taken from p""",
    "op13_session_versions": f"""with k as (select conv_id, turn, {_crc32("conv_id::varchar")} c, {_crc32("conv_id::varchar || ':' || turn::varchar")} h from conversations where turn is not null and conv_id is not null),
e as (select *, s // 900 + case when h // 600 % 5 = 0 then h // 600 % 4 else 0 end batch from (select 2 * (conv_id // 8) + c % 2 "user", (c // 2) % 7200 + 300 * turn + h % 600 s, h from k)), b as (select distinct "user", batch from e),
p as (select b."user", b.batch snap, e.s, e.h, e.batch from b join e on e."user" = b."user" and e.batch <= b.batch), g as (select *, case when s - lag(s) over (partition by "user", snap order by s) <= 600 then 0 else 1 end cut from p), i as (select *, sum(cut) over (partition by "user", snap order by s) id from g),
z as (select "user", snap batch, min(s)::bigint start_s, max(s)::bigint end_s, count(*) n_events, count(*) filter (batch = snap) n_new, sum(h)::bigint h_sum from i group by "user", snap, id), v as (select * from z where n_new > 0),
r as (select a."user", a.batch, a.start_s, arg_min(struct_pack(b := n.batch, s := n.start_s), n.batch) x from v a join v n on a."user" = n."user" and n.batch > a.batch and a.start_s between n.start_s and n.end_s group by 1, 2, 3), m as (select "user", x.b batch, x.s start_s, count(*) n from r group by all)
select v.*, coalesce(m.n, 0) n_retracted, x.b::bigint retracted_batch, x.s::bigint retracted_start_s from v left join r using ("user", batch, start_s) left join m using ("user", batch, start_s)""",
}
