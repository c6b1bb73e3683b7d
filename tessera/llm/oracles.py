"""DuckDB statements of the operators SQL can express."""

from __future__ import annotations

from tessera.llm import quality


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _quality() -> str:
    parts = []
    for r in quality.RULES:
        count, total = quality.RATIOS[r.metric]
        value = count if total is None else f"(case when {total} > 0 then {count}::double / {total} end)"
        if r.least is not None:
            parts.append(f"coalesce({value} >= {r.least}, true)")
        if r.most is not None:
            parts.append(f"coalesce({value} <= {r.most}, true)")
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
u as (select k, unnest(w) as x, generate_subscripts(w, 1) as i from w),
tri as (select k, i, x || ' ' || lead(x) over g || ' ' || lead(x, 2) over g as win from u window g as (partition by k order by i)),
rep as (select k, win from tri where win is not null group by k, win having count(*) > 1),
hit as (select distinct tri.k, tri.i + j as i from tri join rep using (k, win), (values (0), (1), (2)) as v(j)),
n_rep as (select k, count(*) as n from hit group by k),
ln as (select k, unnest(string_split(t, chr(10))) as x from d),
ln2 as (select * from ln where regexp_matches(x, '[^\x20\x09-\x0D]')),
per_line as (select k, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines,
  count(*) filter (rtrim(x, ' ') like '%...' or rtrim(x, ' ') like '%…') as n_ellipsis_lines,
  count(*) filter (regexp_matches(ltrim(x, ' '), '^[-*•]')) as n_bullet_lines from ln2 group by k),
m as (select d.k, doc_id, len(w.w) as n_words, length(array_to_string(w.w, '')) as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '[!?]')) as n_exclaims,
  len(list_filter(w.w, lambda x: x in ({_in(quality.stop_words())}))) as n_stop_words,
  coalesce(n_rep.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_ellipsis_lines, 0) as n_ellipsis_lines, coalesce(n_bullet_lines, 0) as n_bullet_lines
  from d join w using (k) left join n_rep using (k) left join per_line using (k)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and {" and ".join(parts)} as kept from f
"""


QUALITY = _quality()


def _warc() -> str:
    five = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {10 * g + 1}, 10))::bigint // {32 ** (7 - k)} % 32)::int + 1, 1)"
        for g in range(4) for k in range(8))
    return f"""
with d as (select page_id, coalesce(html, '') as t from pages),
x as (select page_id, octet_length(encode(t))::bigint as payload_bytes, sha1(t) as h from d),
y as (select page_id, payload_bytes, {five} as payload_digest, min(page_id) over (partition by h, payload_bytes) as first_page from x)
select page_id, payload_bytes, payload_digest, case when first_page = page_id then 'response' else 'revisit' end as record_type,
  case when first_page <> page_id then first_page end as refers_to from y
"""


WARC = _warc()


EXACT = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
