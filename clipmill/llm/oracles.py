"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_QUALITY_RULES = r"""
with d as (
  select row_number() over () rid, doc_id, coalesce(text, '') t from documents
), w as (
  select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
  from d
), p as (
  select rid, unnest(list_transform(range(1, len(ws) - 6), lambda i: {'i': i, 'h': hash(ws[i:i + 7])})) x
  from w where len(ws) >= 8
), g as (
  select rid, x.i i, count(*) over (partition by rid, x.h) c from p
), s as (
  select rid, i, lead(i) over (partition by rid order by i) nx from g where c > 1
), r as (
  select rid, cast(sum(least(8, coalesce(nx - i, 8))) as bigint) n_repeat_words from s group by rid
), m as (
  select doc_id,
         cast(len(ws) as bigint) n_words,
         cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
         cast(len(ls) as bigint) n_lines,
         cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines,
         coalesce(n_repeat_words, 0) n_repeat_words,
         cast(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as bigint) n_run_words,
         cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as bigint) n_upper,
         cast(length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) as bigint) n_lower
  from w left join r using (rid)
), b as (
  select *, cast((case when n_words < 20 then 1 else 0 end)
       + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
       + (case when 100 * n_symbols > 30 * n_words then 4 else 0 end)
       + (case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
       + (case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end)
       + (case when 100 * n_run_words > 30 * n_words then 32 else 0 end)
       + (case when n_upper > n_lower and n_upper >= 20 then 64 else 0 end) as bigint) failed_bits
  from m
)
select *, failed_bits & 3 <> 0 base_failed, failed_bits = 0 kept from b
"""

_NEAR_DEDUP = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') ws
  from documents
), s as (
  select doc_id, case when len(ws) >= 5
                      then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i:i + 4])))
                      when len(ws) > 0 then [hash(ws)] else [] end sh
  from w
), u as (
  select doc_id, len(sh) n, unnest(sh) h from s
), e as (
  select a.doc_id a, b.doc_id b from u a join u b on a.h = b.h and a.doc_id <> b.doc_id
  group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r as (
  select doc_id node, doc_id root from s
  union
  select e.b, r.root from r join e on e.a = r.node
)
select doc_id, cast(len(sh) as bigint) n_shingles, c.root component_id, doc_id = c.root kept
from s join (select node, min(root) root from r group by 1) c on c.node = s.doc_id
"""

_LEXICAL_SEARCH = r"""
with d as (
  select row_number() over () rid, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9a-z\x{80}-\x{10FFFF}]+') ws
  from documents
), s as (
  select count(*) nn, cast(sum(len(ws)) as bigint) ll from d where len(ws) > 0
), q as (
  select qid, item_id, unnest(ws) w from (
    select row_number() over () qid, item_id, list_distinct(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[0-9a-z\x{80}-\x{10FFFF}]+')) ws
    from benchmark)
), t as (
  select rid, doc_id, n, w, count(*) tf
  from (select rid, doc_id, len(ws) n, unnest(ws) w from d) where w in (select w from q) group by all
), f as (
  select w, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) weight from t, s group by w, nn
), g as (
  select qid, item_id, rid, doc_id,
         cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) as bigint) score
  from q join t using (w) join f using (w), s group by 1, 2, 3, 4
), r as (
  select item_id, doc_id, score,
         cast(row_number() over (partition by qid order by score desc, doc_id nulls last) as int) rank
  from g where score > 0
)
select item_id, rank, doc_id, score from r where rank <= 10
"""


def _vector_codes(rounds: int = 6) -> str:
    """Parts and entries joined in full, one pair of tables for each round."""
    tables = [
        """v as materialized (
          select row_number() over () rid, vec_id, label,
                 list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) e
          from embeddings
          where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        )""",
        "p as materialized (select rid, j part, e[j * (len(e) // 8) + 1 : (j + 1) * (len(e) // 8)] x from v, range(8) r(j))",
        """c0 as materialized (
          select part, k - 1 idx, x
          from p join (select rid, row_number() over (order by vec_id nulls last, e) k from v) using (rid) where k <= 16
        )""",
    ]
    for i in range(rounds + 1):
        tables.append(f"""a{i} as materialized (
          select rid, part, any_value(p.x) x, min({{'d': list_sum(list_transform(list_zip(p.x, c.x),
                 lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'i': idx}}) m
          from p join c{i} c using (part) group by rid, part
        )""")
        if i < rounds:
            tables.append(f"""c{i + 1} as materialized (
              select part, idx, coalesce(n.x, c.x) x
              from c{i} c left join (
                select part, idx, list((s - ((s % n) + n) % n) // n order by pos) x from (
                  select part, m.i idx, pos, sum(x[pos]) s, count(*) n
                  from (select part, m, x, unnest(range(1, len(x) + 1)) pos from a{i}) group by 1, 2, 3
                ) group by 1, 2
              ) n using (part, idx)
            )""")
    last = f"""o as materialized (
      select rid, string_agg(format('{{:02x}}', m.i), '' order by part) code, cast(sum(m.d) as bigint) error from a{rounds} group by rid
    ), b as (
      select sha256(string_agg(cast(y as varchar), ',' order by part, idx, pos)) codebooks_sha256
      from (select part, idx, unnest(x) y, unnest(range(len(x))) pos from c{rounds})
    )
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256
    from o join v using (rid), b"""
    return "with " + ", ".join([*tables, last])


ORACLES = {
    "op1_quality_rules": _QUALITY_RULES,
    "op7_near_dedup": _NEAR_DEDUP,
    "op12_lexical_search": _LEXICAL_SEARCH,
    "op13_vector_codes": _vector_codes(),
}
