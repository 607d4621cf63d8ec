"""DuckDB SQL that the queries are checked against, by name."""

from __future__ import annotations

#: Fixed value: white space, as a pattern.
_WHITE = r"[\s\x{000B}\x{0085}\p{Z}]+"


def _normal(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '{_WHITE}', ' ', 'g')))"


def _terms(field: str) -> str:
    return f"(select '{field}' field, id, {_normal('t')} term from (select id, unnest({field}) t from recipe_models) where t is not null)"


#: (field, id, term, n) of the distinct terms of each recipe.
_SETS = f"""sets as materialized (
  select distinct field, id, term from (select * from {_terms('ingredients')} union all select * from {_terms('keywords')}) where term <> '')"""


def _plain(text: str) -> str:
    return f"regexp_replace(lower(nfc_normalize({text})), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_VALUES = r"""'"([^"]*)"|“([^”]*)”|''((?:[^'']|[\p{L}\p{N}]''[\p{L}\p{N}])*)''|((?:[\p{L}\p{N}]''[\p{L}\p{N}]|[\p{L}\p{N} \x{00A0}-])+)'"""

_SPLIT = r"(select id, trim(regexp_replace(v, '^[\s\x{00A0}\"“”'']+|[\s\x{00A0}\"“”'']+$', '', 'g')) item from (select id, unnest(regexp_extract_all(category, " + _VALUES + ")) v from recipes)) where item <> ''"

#: (field, term_a, term_b, k, in_a, in_b, n) of the pairs found together in ten records.
_PAIRS = f"""{_SETS},
sizes as (select field, count(distinct id) n from sets group by field),
held as (select field, term, count(*) c from sets group by all),
counted as (
  select a.field, a.term term_a, b.term term_b, count(*) k from sets a join sets b on a.field = b.field and a.id = b.id and a.term < b.term
  group by all having count(*) >= 10),
pairs as (
  select p.*, x.c in_a, y.c in_b, n from counted p join sizes using (field) join held x on x.field = p.field and x.term = term_a
  join held y on y.field = p.field and y.term = term_b where 1000 * k >= n)"""

#: (field, id, term) of every occurrence of a keyword, cuisine or category.
_ROWS = f"""rows as (
  select * from (
    select 'keywords' field, id, {_normal('t')} term from (select id, unnest(keywords) t from recipe_models) where t is not null
    union all select 'cuisine', id, {_normal('cuisine')} from recipes where cuisine is not null
    union all select 'category', id, {_normal('item')} from {_SPLIT})
  where term <> '')"""

SQL: dict[str, str] = {
    "p1_found": f"""
with {_SETS},
sized as (select field, id, count(*) n from sets group by all),
pairs as (
  select a.field, a.id id_a, b.id id_b, count(*) k from sets a join sets b on a.field = b.field and a.term = b.term and a.id < b.id
  group by all)
select p.field, id_a, id_b from pairs p join sized x on x.field = p.field and x.id = id_a join sized y on y.field = p.field and y.id = id_b
where 5 * k >= 4 * (x.n + y.n - k)""",
    "p2_found": rf"""
with names as (
  select id, regexp_matches(name, '\[[^\[\]]*\][^\p{{L}}\p{{N}}]*$') listed, name,
    regexp_replace(name, '\[[^\[\]]*\][^\p{{L}}\p{{N}}]*$', '') title, regexp_extract(name, '\[([^\[\]]*)\][^\p{{L}}\p{{N}}]*$', 1) notes
  from recipes where name is not null),
keyed as (
  select 'recipes' tbl, id, {_plain('title')} whole, list_sort(list_filter(list_transform(string_split(notes, ';'), lambda x: {_plain('x')}), lambda x: x <> '')) parts from names
  union all
  select 'recipe_urls', id, {_plain("string_split(url, '?')[1]")},
    list_sort(list_filter(list_transform(regexp_split_to_array(regexp_extract(url, '^[^?]*\?((?:.|\n)*)$', 1), '[&;]'), lambda x: {_plain('x')}), lambda x: x <> ''))
  from recipe_urls where url is not null)
select tbl, min(id) id, count(*) copies from keyed group by tbl, whole, parts having count(*) > 1""",
    "p5_found": f"with {_PAIRS} select field, term_a, term_b from pairs where k * n >= 4 * in_a * in_b",
    "p5_odds": f"""
with {_PAIRS}
select field, term_a, term_b, k, cast(round(1000 * (k + 0.5::double) * (n - in_a - in_b + k + 0.5::double) / ((in_a - k + 0.5::double) * (in_b - k + 0.5::double))) as bigint) odds_milli
from pairs""",
    "p6_found": f"""
with {_ROWS},
terms as (select distinct * from rows),
sizes as (select field, count(distinct id) n from terms group by field),
counts as (select field, term, count(*) k from terms group by all)
select field, term, 'rare' mark from counts where k <= 2
union all select field, term, 'common' from counts join sizes using (field) where k * 10 > n""",
    "p6_counts": f"with {_ROWS} select field, term, count(*) occurrences, count(distinct id) records from rows group by all",
    "p8_texts": "select doc_id, coalesce(text, '') as text from documents",
    "p9_found": r"""
with docs as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
items as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
in_docs as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) run from docs),
in_items as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) run from items)
select distinct doc_id, item_id from in_docs join in_items using (run)""",
}
