"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .chat import op5_chat
from .html import op9_html
from .licenses import op6_licenses
from .media import op2_media
from .mixing import op7_mixing
from .ngrams import op12_perplexity
from .phrases import op13_collocations
from .quality import op3_quality
from .resampling import op11_resampling
from .secrets import op10_secrets
from .sentencepiece import op4_sentencepiece
from .simhash import op1_simhash
from .urls import op8_urls


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_media, op3_quality, op4_sentencepiece, op5_chat, op6_licenses, op7_mixing, op8_urls, op9_html, op10_secrets, op11_resampling, op12_perplexity, op13_collocations)}


OP5 = """with r as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) - 1 as k from conversations),
    p as (select distinct conv_id, role as perspective from r),
    s as (select r.conv_id, perspective, k, k // 256 as block, role = perspective as own, text,
        '<|im_start|>' || case when role = perspective then 'assistant' else 'user name=' || role end || chr(10) as head
        from r join p on r.conv_id is not distinct from p.conv_id),
    t as (select *, head || text || '<|im_end|>' || chr(10) as piece from s),
    u as (select *, coalesce(sum(length(piece)) over (partition by conv_id, perspective, block order by k rows between unbounded preceding and 1 preceding), 0) + length(head) as a from t),
    b as (select conv_id, perspective, block, count(*) as n_turns, string_agg(piece, '' order by k) as rendered,
        coalesce(string_agg(case when own then cast(cast(a as bigint) as varchar) || '-' || cast(cast(a as bigint) + length(text) as varchar) end, ',' order by k), '') as mask from u group by all)
    select conv_id, perspective, block, cast(coalesce(sum(length(rendered)) over (partition by conv_id, perspective order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as first_char,
        cast(n_turns as integer) as n_turns, rendered, mask from b"""

OP7 = r"""with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5(concat_ws(':', cast(doc_id as varchar), text)) as h from documents),
    s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
    w as (select *, [3.0, 1.0, 2.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)]::double as w, 2.0::double * source_size as top from s),
    l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(top) over (order by top / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
        / sum(w) over (order by top / w, source nulls last rows between current row and unbounded following) as level from w),
    c as (select min_by(level, top / w) filter (top / w > level) as level from l),
    g as (select source, source_size, least(top, coalesce((select level from c) * w, top)) as target, ('0x' || substr(md5('7:' || coalesce(source, chr(0))), 1, 8))::bigint / 4294967296.0::double as u from w),
    k as (select d.doc_id, size, source_size, target, u, case when source_size > 0 then target / source_size else 0.0 end as e,
        row_number() over (partition by d.source order by size desc, h, doc_id nulls first) - 1 as pos from d join g on d.source is not distinct from g.source)
    select doc_id, size, source_size, target, cast(size * least(floor((pos + 1) * e + u) - floor(pos * e + u), 2) as bigint) as taken from k"""


#: Tables of CRC-32: its 256 entries by the polynomial's rule, as one list.
CRC = r"""crc_bits as (select i, list_reduce(list_prepend(i, range(8)), lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as v from (select unnest(range(256)) as i)),
    crc_table as (select list(v order by i) as crc_t from crc_bits)"""



def crc(hex_of: str, table: str = "crc_t") -> str:
    """Unsigned CRC-32 of bytes in hexadecimal digits."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({hex_of}) + 1, 2), lambda i: ('0x' || {hex_of}[i:i + 1])::bigint)), lambda a, b: xor(a >> 8, {table}[xor(a & 255, b) + 1])), 4294967295)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""with d as (select row_number() over () as d, coalesce(lang, 'und') as lang, {LOWER.format("coalesce(text, '')")} as text from documents),
    p as (select d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
    w as (select row_number() over () as p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
    sizes as (select lang, sum(len(w))::bigint as n from w group by lang),
    g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from w, (select unnest(range(1, 5)) as k) ks, unnest(range(1, len(w) - k + 2)) as u(i)),
    f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 30),
    c as (select *, string_split(phrase, ' ') as ws from f where k > 1),
    cuts as (select c.lang, c.phrase, c.a, j, array_to_string(ws[1:j], ' ') as first, array_to_string(ws[j + 1:], ' ') as rest from c, unnest(range(1, c.k)) as u(j)),
    scores as (select cuts.lang, cuts.phrase, cuts.a, j, x.a as l, y.a as r, ((2000000::hugeint * cuts.a) // (x.a + y.a))::bigint as score
        from cuts join f x on x.lang = cuts.lang and x.phrase = first join f y on y.lang = cuts.lang and y.phrase = rest),
    lowest as (select lang, phrase, a, arg_min(l, score * 8 + j) as l, arg_min(r, score * 8 + j) as r, min(score) as score from scores group by all),
    parts as (select distinct c.lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, c.phrase as longer, c.a as b from c, (select unnest([2, 3]) as m) ms, unnest(range(1, c.k - m + 2)) as u(i) where m < c.k),
    hidden as (select distinct parts.lang, parts.phrase from parts join c on c.lang = parts.lang and c.phrase = parts.phrase where 100 * b >= 80 * c.a),
    kept as (select * from lowest where not exists (select 1 from hidden where hidden.lang = lowest.lang and hidden.phrase = lowest.phrase)),
    placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select placed.lang, rank, phrase, a, l, r, n, score from placed join sizes on sizes.lang = placed.lang where rank <= 2000"""

OP12 = rf"""with {CRC}, d as (select row_number() over () as d, doc_id, {crc("hex(encode(coalesce(doc_id::varchar, '')))")} % 7 = 2 as held_out,
        list_concat([' <s>'], regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+'), [' </s>']) as w from documents, crc_table),
    b as (select d, held_out, w[i] as c, w[i + 1] as w from d, unnest(range(1, len(w))) as u(i)),
    two as (select c, w, count(*) as n from b where not held_out group by all),
    one as (select w, sum(n) as raw, count(*) as n from two group by w),
    totals as (select sum(raw) as n_tokens, count(*) as n_types, sum(n) as total from one),
    cc as (select 1 as k, n from one union all select 2, n from two),
    counts as (select k, count(case when n = 1 then 1 end) as n1, count(case when n = 2 then 1 end) as n2, count(case when n = 3 then 1 end) as n3, count(case when n = 4 then 1 end) as n4 from cc group by k),
    y as (select *, least(n1, n2, n3, n4) > 0 as ok, n1 / (n1 + 2 * n2) as y from counts),
    ds as (select k, case when ok then least(greatest(1 - 2 * y * n2 / n1, 0), 1) else 0.5 end as d1, case when ok then least(greatest(2 - 3 * y * n3 / n2, 0), 2) else 1.0 end as d2, case when ok then least(greatest(3 - 4 * y * n4 / n3, 0), 3) else 1.5 end as d3 from y),
    base as (select sum(case n when 1 then d1 when 2 then d2 else d3 end) as rest from one, ds where k = 1),
    p1 as (select w, raw, (n - case n when 1 then d1 when 2 then d2 else d3 end + rest / (n_types + 1)) / total as p from one, ds, base, totals where k = 1),
    ctx as (select c, sum(n) as total, sum(case n when 1 then d1 when 2 then d2 else d3 end) as rest from two, ds where k = 2 group by c),
    s as (select b.d, p1.raw, coalesce(p1.p, rest0 / (n_types + 1) / totals.total) as p, ctx.total, ctx.rest, coalesce(two.n - case two.n when 1 then d1 when 2 then d2 else d3 end, 0) as own, n_tokens, n_types
        from b cross join totals cross join (select rest as rest0 from base) cross join (select * from ds where k = 2) left join p1 on p1.w = b.w left join ctx on ctx.c = b.c left join two on two.c = b.c and two.w = b.w),
    t as (select d, count(*) as n_tokens, count(raw) as n_known, sum(log10((coalesce(raw, 0) + 1) / (n_tokens + n_types + 1))) as base_score, sum(log10(case when total > 0 then (own + rest * p) / total else p end)) as score from s group by d)
    select doc_id, held_out, t.n_tokens, n_known, totals.n_tokens::bigint as train_tokens, round(base_score, 6) as base_score, round(score, 6) as score from t join d on d.d = t.d cross join totals"""

FEATURES = rf"""select d, doc_id, n_words, unnest(list_concat(w, list_transform(range(1, n_words), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, n_words - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f"""
OP11 = rf"""with {CRC}, d as (select row_number() over () as d, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    e as (select *, len(w) as n_words from d),
    b as (select row_number() over () as d, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    ours as ({FEATURES} from e), theirs as ({FEATURES.replace('doc_id, ', '').replace('n_words, unnest', 'unnest').replace('n_words', 'len(w)')} from b),
    f as (select f, hex(encode(f)) as h from (select distinct f from ours union select distinct f from theirs)),
    c as (select f, {crc('h')} % 10000 as bucket from f, crc_table),
    x as (select d, bucket, count(*) as n from ours join c on c.f = ours.f group by all),
    s as (select bucket, sum(n) as own from x group by bucket), t as (select bucket, count(*) as other from theirs join c on c.f = theirs.f group by bucket),
    totals as (select (select coalesce(sum(own), 0) from s)::double as owns, (select coalesce(sum(other), 0) from t)::double as others),
    gains as (select s.bucket, floor(1000 * ln((coalesce(other, 0) + 1)::double * (owns + 10000) / ((own + 1)::double * (others + 10000))))::bigint as gain from s left join t on t.bucket = s.bucket cross join totals),
    weights as (select d, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from x join gains on gains.bucket = x.bucket group by d),
    scored as (select e.doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || e.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score from e left join weights on weights.d = e.d),
    able as (select *, row_number() over (order by score desc, doc_id) as place, 5 * count(*) over () // 100 as k from scored where n_words >= 20)
    select doc_id, n_features, weight, score, case when place <= k then place end as rank from able union all select doc_id, n_features, weight, score, null from scored where n_words < 20"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": OP5, "op7_mixing": OP7, "op11_resampling": OP11, "op12_perplexity": OP12, "op13_collocations": OP13}
