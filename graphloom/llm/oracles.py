"""DuckDB SQL for the corpus queries that SQL can express."""

from .licenses import NEEDED, RARE, TEMPLATES
from .secrets import MORE_RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % _LOWER

ORACLES: dict[str, str] = {
    "op5_ngram_join": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
t as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (select a.doc_id as x, b.doc_id as y from t a join t b on a.g = b.g and a.doc_id <> b.doc_id
          group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on r.y = l.x)
select s.doc_id, len(s.s) as n_shingles, min(r.y) as component_id from s join reach r on s.doc_id = r.x group by s.doc_id, s.s""",
    "op8_decontamination": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
windows as (select distinct item_id, unnest(case when len(w) = 0 then [] when len(w) < 10 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) end) as g from b),
sized as (select item_id, g, len(string_split(g, ' ')) as k from windows),
lengths as (select distinct k from sized),
places as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i from d cross join lengths where len(w) >= k),
parts as (select p.doc_id, p.k, p.i, array_to_string(d.w[p.i:p.i + p.k - 1], ' ') as g from places p join d using (doc_id)),
found as (select p.doc_id, p.i, p.k, s.item_id from parts p join sized s on p.g = s.g and p.k = s.k),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)""",
}


def _secrets() -> str:
    """Positions from the pieces between the matches and the matches themselves."""
    # as the contract states them: whole matches, short ones dropped afterwards
    rules = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
        *[(r.kind, r.regex, 0, 0) for r in MORE_RULES],
    ]
    text = lambda x: "'" + x.replace("'", "''") + "'"
    parts = " union all ".join(
        f"select doc_id, {k} as k, {text(kind)} as kind, {least} as least, regexp_extract_all(t, {text(p)}, 0) as m, regexp_extract_all(t, {text(p)}, {group}) as g, regexp_split_to_array(t, {text(p)}) as s from d"
        for k, (kind, p, group, least) in enumerate(rules)
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), r as ({parts}),
u as (select *, unnest(range(1, len(m) + 1)) as i from r),
x as (select doc_id, k, kind, length(g[i]) >= least as good, length(m[i]) as n,
      list_sum(list_transform(s[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda q: length(q))), 0) as start from u),
y as (select doc_id, k, start, kind || ':' || start::bigint || ':' || (start + n)::bigint as span from x where good),
a as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
      string_agg(span, ',' order by start, k) filter (k < 3) as base, string_agg(span, ',' order by start, k) as spans from y group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


def _licenses() -> str:
    texts = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.words()!r}, {t.key_words()!r}, {t.key_at()})" for k, t in enumerate(TEMPLATES))
    return f"""
with d as (select doc_id, {_WORDS} as w from documents),
t as (select * from (values {texts}) v(t, label, base, p, key, key_at)),
v as (select distinct unnest(p) as word from t),
df as (select word, count(*) as n from (select distinct doc_id, unnest(w) as word from d) join v using (word) group by word),
idf as (select word, ln(((select count(*) from d) + 1) / (coalesce(n, 0) + 1)) + 1 as idf from v left join df using (word)),
places as (select t, unnest(range(0, len(p))) as spot, p from t),
ranked as (select t, spot, word, idf, row_number() over (partition by t order by idf desc, spot) as k from (select t, spot, p[spot + 1] as word from places) join idf using (word)),
rare as (select * from ranked where k <= {RARE}),
weight as (select t, sum(idf) as idf, least({NEEDED}, count(*)) as need from rare group by t),
cell as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
begun as (select * from cell where w[i] in (select key[1] from t)),
phrase as (select doc_id, w, t, i - 1 - key_at as start from begun join t on w[i:i + len(key) - 1] = key),
near as (select doc_id, t, start, count(*) filter (start + spot >= 0 and w[start + spot + 1] = word) as n from phrase join rare using (t) group by doc_id, t, start, w),
place as (select doc_id, label, base, start, idf from near join weight using (t) join t using (t) where n >= need),
a as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
      string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, sum(idf) as idf from place group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
       coalesce(labels, '') as labels, round(1 - exp(-coalesce(idf, 0) / 10), 6) as score from d left join a using (doc_id)"""


ORACLES |= {"op7_secrets": _secrets(), "op9_licenses": _licenses()}
