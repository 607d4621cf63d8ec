"""DuckDB SQL that the core's queries are checked against, by name."""

from __future__ import annotations

#: Fixed value: white space at the ends of a text, as a pattern.
_ENDS = r"^[\s\x{000B}\x{0085}\p{Z}]+|[\s\x{000B}\x{0085}\p{Z}]+$"
#: A list literal of either dialect as a list.
_LIST = r"""case when json_valid({0}) then from_json({0}, '["VARCHAR"]')
  else list_transform(regexp_extract_all({0}, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*'''), lambda x: x[2:-2]) end"""


def _lines(field: str, numbered: bool = False) -> str:
    value = "i || '. ' || x" if numbered else "x"
    return f"coalesce(array_to_string(list_transform({_LIST.format(field)}, lambda x, i: {value}), chr(10)), '')"


_TEXT = f"""'<b>' || coalesce(name, 'None') || '</b>' || chr(10) || chr(10) || 'Portions: ' || coalesce(portions, 'None') || chr(10)
  || '<i>' || coalesce(description, 'None') || '</i>' || chr(10) || chr(10) || '<b>Ingredients:</b>' || chr(10) || {_lines('ingredients')}
  || chr(10) || chr(10) || '<b>Instructions:</b>' || chr(10) || {_lines('instructions', True)}"""

#: One value of a packed field: quoted in one of the ways, or plain.
_VALUE = r"""'"[^"]*"|“[^”]*”|''(?:[^'']*[\p{L}\p{N}]''[\p{L}\p{N}])*[^'']*''|(?:[ \x{00A0}-]|[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*)+'"""


def _packed(tbl: str, field: str) -> str:
    return rf"""select '{tbl}' tbl, id, v, n from (
    select id, unnest(vs) v, unnest(range(1, len(vs) + 1)) n from (
      select id, list_filter(list_transform(regexp_extract_all({field}, {_VALUE}),
        lambda x: regexp_replace(case when x[1] in ('"', '“', '''') then x[2:-2] else x end, '{_ENDS}', '', 'g')), lambda x: x <> '') vs
      from (select distinct id, {field} from {tbl} where {field} is not null)) where len(vs) > 1)"""


_STEPS = "list_transform(case when json_type(data, '$.recipeInstructions') = 'ARRAY' then json_extract(data, '$.recipeInstructions[*].text') when json_type(data, '$.recipeInstructions.text') is not null then [json_extract(data, '$.recipeInstructions.text')] else [] end, lambda x: x ->> '$')"
#: Staged rows whose text is one JSON object.
_OBJECTS = "(select * from recipe_urls where case when json_valid(data) then json_type(data) = 'OBJECT' else false end)"


def _nutrition(field: str, unit: str) -> str:
    return f"try_cast(replace(data ->> '$.nutrition.{field}', '{unit}', '') as double)"


#: Unit words as patterns, the unit's name and how much it is of kcal or g.
_ENERGY = (("kcals?|kilocalories|kilocalorie|calories|calorie|cals?", "kcal", "1"), ("kj|kilojoules?", "kJ", "1 / 4.184"))
_MASS = (
    ("kg|kilograms?", "kg", "1000"), ("g|gr|grams?", "g", "1"), ("mg|milligrams?", "mg", "0.001"),
    ("mcg|µg|μg|micrograms?", "mcg", "0.000001"), ("oz|ounces?", "oz", "28.349523125"),
)
_ALL = "|".join(p for p, *_ in (*_ENERGY, *_MASS))
#: Field, its words and units in notes, the feed's column, the common unit and how much that is of kcal or g.
_MEASURED = (
    ("calories", "energy|calories", "kcals?|kilocalories|kilocalorie|kj|kilojoules?", "energy_unit", "kcal", "1"),
    ("fat", "fat", "|".join(p for p, *_ in _MASS), "weight_unit", "g", "1"),
    ("sugar", "sugar", "|".join(p for p, *_ in _MASS), "weight_unit", "g", "1"),
    ("sodium", "sodium", "|".join(p for p, *_ in _MASS), "sodium_unit", "mg", "0.001"),
)
_UNIT = "case " + " ".join(f"when regexp_full_match({{0}}, '{p}') then '{n}'" for p, n, _ in (*_ENERGY, *_MASS)) + " end"
_SIZE = "case unit " + " ".join(f"when '{n}' then {f}" for _, n, f in (*_ENERGY, *_MASS)) + " end"


def _measured(field: str, named: str, words: str, feed_unit: str, common: str, size: str) -> str:
    unit = rf"(?:^|[^\p{{L}}])({words})(?:[^\p{{L}}]|$)"
    after = rf"regexp_extract(lower(nutrition_note), '(?:{named})\b[^.;,]*?{unit}', 1)"
    before = rf"regexp_extract(lower(nutrition_note), '{unit}\s*for\s[^.;,]*?(?:{named})\b', 1)"
    note = f"coalesce(nullif({before}, ''), nullif({after}, ''))"
    family = ", ".join(f"'{n}'" for _, n, _ in (_ENERGY if field == "calories" else _MASS))
    return rf"""select id, '{field}' field, '{common}' common, {size} base, regexp_replace({field}, '\d+(?:[.,]\d+)?\s*%', ' ', 'g') t,
    list_filter(list_transform(regexp_extract_all(lower({field}), '(?:^|[^\p{{L}}])({_ALL})(?:[^\p{{L}}]|$)', 1), lambda w: {_UNIT.format('w')}), lambda u: u in ({family})) own,
    coalesce({_UNIT.format(note)}, {feed_unit}) bare
  from (select distinct id, feed, nutrition_note, {field} from parsed_recipes where {field} is not null) left join feeds using (feed)"""


_NUMBER = r"(?:(\d+)[ \x{00A0}]+)?(\d+)/(\d+)|(\d+)?[ \x{00A0}]?([¼½¾⅛])|(\d+(?:[, \x{00A0}]\d{3})*)([.,]\d+)?"

_CURATED = f"""
select id, data ->> '$.name' as name, data ->> '$.description' description, data ->> '$.image.url' image,
  cast(to_json(coalesce(string_split(replace(data ->> '$.keywords', ' ', ''), ','), [])) as varchar) keywords,
  data ->> '$.cookTime' cook_time, data ->> '$.prepTime' prep_time, data ->> '$.totalTime' total_time, data ->> '$.recipeCategory' category,
  data ->> '$.recipeCuisine' cuisine, cast(json_extract(data, '$.recipeIngredient') as varchar) ingredients, cast(to_json({_STEPS}) as varchar) instructions,
  data ->> '$.recipeYield' portions, {_nutrition('calories', ' calories')} calories, {_nutrition('fatContent', ' grams fat')} fat,
  {_nutrition('saturatedFatContent', ' grams saturated fat')} saturated_fat, {_nutrition('carbohydrateContent', ' grams carbohydrates')} carbohydrate,
  {_nutrition('sugarContent', ' grams sugar')} sugar, {_nutrition('fiberContent', ' grams fiber')} fiber, {_nutrition('proteinContent', ' grams protein')} protein,
  {_nutrition('sodiumContent', ' milligram of sodium')} sodium
from {_OBJECTS}
where data ->> '$.name' is not null and data ->> '$.description' is not null and data ->> '$.image.url' is not null and json_type(data, '$.recipeIngredient') = 'ARRAY'
  and data ->> '$.recipeInstructions' is not null"""

SQL: dict[str, str] = {
    "facet_categories": rf"""
select distinct regexp_replace(c, '{_ENDS}', '', 'g') category from (select unnest(string_split(lower(category), ',')) c from recipes where category is not null)""",
    "facet_cuisines": "select distinct cuisine from recipes where cuisine is not null and lower(category) like '%dessert%'",
    "names_filtered": "select name, id from recipes where cuisine = 'British' and lower(category) like '%dinner%' and lower(ingredients) like '% cream%'",
    "name_search": "select name, id from recipes where lower(name) like '%crème%'",
    "ingredient_word": "select name, id from recipes where lower(ingredients) like '% pe_per%'",
    "ingredients_all_of": "select name, id from recipes where lower(ingredients) like '%butter%' and lower(ingredients) like '%egg%' and lower(ingredients) like '%salt%'",
    "found_texts": f"select id, {_TEXT} as text from (select * from recipes where cuisine = 'Italian' and lower(category) like '%dinner%' order by id limit 3)",
    "recipe_texts": f"select id, {_TEXT} as text from recipes",
    "recipe_by_id": f"select id, {_TEXT} as text from recipes where id = 7",
    "recipe_summary": f"select id, 'Cuisine: Thai' || chr(10) || 'Category: Main course' || chr(10) || {_TEXT} as text from recipes where id = 11",
    "page_by_url": "select id, url from sitemap where url = 'https://www.claripes-plates.example/sitemaps/2023-q4-0.xml' order by id limit 1",
    "pages_by_ids": "select id, url from recipe_urls where id in (3, 5, 8, 13, 999999999)",
    "url_exists": "select exists(select 1 from sitemap where url = 'https://www.claripes-plates.example/sitemaps/2023-q4-0.xml') found",
    "unfinished_sitemaps": "select * from sitemap where completed = false",
    "finished_sitemaps": """
select id, url, case when url in (select url from sitemap where id in (select sitemap_id from recipe_urls)) then true else completed end completed from sitemap""",
    "absent_urls": """
select min(id) id, url from sitemap where (completed is null or not completed) and url not in (select url from sitemap where completed) group by url""",
    "staged_pages": "select id, url, name, cast(length(data) as integer) size from recipe_urls",
    "page_facts": "select id, name title, id % 3 <> 0 is_recipe, md5(data) record from recipe_urls",
    "crawled_pages": """
select r.id, r.url, r.name from recipe_urls r join (
  select min(r.id) id from recipe_urls r join sitemap s on s.id = r.sitemap_id
  where r.id % 3 <> 0 and s.url in (select url from sitemap where completed = false) and r.url not in (select url from recipe_urls where url is not null and sitemap_id in (select id from sitemap where completed))
  group by r.url) using (id)""",
    "crawled_frontier": """
with listed as (select s.url sitemap, r.url, json_valid(r.data) fetched from sitemap s join recipe_urls r on r.sitemap_id = s.id where s.url in (select url from sitemap where completed = false)),
reached as (select url from listed where fetched union select url from recipe_urls where sitemap_id in (select id from sitemap where completed)),
whole as (select sitemap from listed group by sitemap having bool_and(url in (select url from reached)))
select id, url, case when url in (select sitemap from whole) then true else completed end completed from sitemap""",
    "staging_appended": """
with first as (select min(id) id from recipe_urls where sitemap_id in (select id from sitemap where completed) group by url),
later as (select min(id) id from recipe_urls where url not in (select url from recipe_urls where id in (select id from first)) group by url)
select id, url, name from recipe_urls join (select id from first union all select id from later) using (id)""",
    "recipes_appended": "select id, name, portions, calories, sodium from recipes union all select id, name, portions, calories, sodium from (" + _CURATED + ")",
    "recipe_models_read": rf"""
select id, name, description, image, {_LIST.format('keywords')} keywords, cook_time, prep_time, total_time, category, cuisine, {_LIST.format('ingredients')} ingredients,
  {_LIST.format('instructions')} instructions, cast(case when regexp_full_match(portions, '\s*[+-]?\d+\s*') then portions end as integer) portions,
  {', '.join(f'cast({n} as varchar) {n}' for n in ('calories', 'fat', 'saturated_fat', 'carbohydrate', 'sugar', 'fiber', 'protein', 'sodium'))} from recipes""",
    "recipe_rows": f"""
select id, name, description, image, {', '.join(f"cast(to_json({n}) as varchar) {n}" for n in ('keywords', 'ingredients', 'instructions'))}, cook_time, prep_time, total_time, category, cuisine,
  cast(portions as varchar) portions, {', '.join(f'try_cast({n} as double) {n}' for n in ('calories', 'fat', 'saturated_fat', 'carbohydrate', 'sugar', 'fiber', 'protein', 'sodium'))} from recipe_models""",
    "guided_search": "select name, id from recipes where lower(ingredients) like '%butter%' and lower(ingredients) like '%egg%' and lower(ingredients) like '%salt%'",
    "guided_choice": f"""
select '7' asked, 'Cuisine: Thai' || chr(10) || 'Category: Main course' || chr(10) || {_TEXT} as text from recipes where id = 7
union all select '999999999', 'Can''t find anything to cook' union all select '7 recipes', 'Invalid recipe ID.' union all select null, 'Can''t find anything to cook'""",
    "sitemap_urls": rf"select sitemap_id id, regexp_replace(url, '^[ \n]+|[ \n]+$', '', 'g') url from recipe_urls",
    "json_fields": f"""
select r.id, o.data ->> '$.image.url' image, replace(o.data ->> '$.nutrition.calories', ' calories', '') calories,
  replace(o.data ->> '$.nutrition.fatContent', ' grams fat', '') fat, replace(o.data ->> '$.nutrition.sodiumContent', ' milligram of sodium', '') sodium
from recipe_urls r left join {_OBJECTS} o using (id)""",
    "keyword_lists": "select distinct id, string_split(replace(keywords, ' ', ''), ',') keywords from parsed_recipes",
    "curated_recipes": _CURATED,
    "list_literals": f"""
select id, unnest(range(0, len(l)))::integer pos, unnest(l) ingredient from (select id, {_LIST.format('ingredients')} l from recipes)""",
    "menu_grid": """
select (place // 3)::bigint line, list(cuisine order by place) cells from (
  select cuisine, row_number() over (order by cuisine) - 1 as place from (select distinct cuisine from recipes where cuisine is not null)) group by 1""",
    "p3_found": f"select tbl, id, n::integer pos, v item from ({_packed('recipes', 'category')} union all {_packed('parsed_recipes', 'keywords')})",
    "p4_found": rf"""
with texts as ({' union all '.join(_measured(*m) for m in _MEASURED)}),
parts as (select *, regexp_extract(t, '{_NUMBER}', ['w', 'a', 'b', 'v', 's', 'i', 'd']) p from texts where regexp_matches(t, '\d|[¼½¾⅛]')),
amounts as (
  select id, field, common, base, own, coalesce(own[1], bare) unit,
    case when p.b <> '' then coalesce(try_cast(p.w as double), 0) + cast(p.a as double) / nullif(cast(p.b as double), 0)
      when p.s <> '' then coalesce(try_cast(p.v as double), 0) + case p.s when '¼' then 0.25 when '½' then 0.5 when '¾' then 0.75 else 0.125 end
      else cast(regexp_replace(p.i, '[, \x{{00A0}}]', '', 'g') || replace(p.d, ',', '.') as double) end amount
  from parts)
select distinct id, field, cast(round(amount * ({_SIZE}) / base * 1000) as bigint) amount_milli from amounts
where unit <> common and amount is not null and not list_contains(own, common)""",
    "p7_nodes": """
with valid as (select id, case when json_valid(data) then data end data from recipe_urls),
spelt as (select id, case when json_type(data) = 'VARCHAR' and json_valid(data ->> '$') then data ->> '$' else data end data from valid),
docs as (select row_number() over () r, id, case when json_type(data) = 'VARCHAR' and json_valid(data ->> '$') then data ->> '$' else data end data from spelt where data is not null),
tree as (select r, d.id doc, t.id nid, t.parent up, t.key, t.type, t.atom, row_number() over (partition by r order by t.id) - 1 as place from docs d, json_tree(d.data) t)
select t.doc id, t.place::integer node, u.place::integer parent, case when u.type = 'OBJECT' then t.key end label, case when u.type = 'ARRAY' then t.key::integer end ord,
  case t.type when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' else 'number' end kind,
  case when t.type not in ('OBJECT', 'ARRAY', 'NULL') then t.atom ->> '$' end scalar
from tree t left join tree u on u.r = t.r and u.nid = t.up""",
    "p7_found": """
with recursive valid as (select id, case when json_valid(data) then data end data from recipe_urls),
spelt as (select id, case when json_type(data) = 'VARCHAR' and json_valid(data ->> '$') then data ->> '$' else data end data from valid),
docs as (select row_number() over () r, id, case when json_type(data) = 'VARCHAR' and json_valid(data ->> '$') then data ->> '$' else data end data from spelt where data is not null),
tree as materialized (select r, d.id doc, t.id nid, t.parent up, t.key, t.type, t.atom from docs d, json_tree(d.data) t),
roots as (
  select r, doc, min(root) root from (
    select t.r, t.doc, t.up root from tree t where t.key = '@type' and t.atom ->> '$' = 'Recipe'
    union all
    select t.r, t.doc, a.up from tree t join tree a on a.r = t.r and a.nid = t.up and a.key = '@type' and a.type = 'ARRAY' where t.atom ->> '$' = 'Recipe')
  group by r, doc),
walk as (
  select t.r, t.doc, t.nid, t.type, t.key label, '' path, '' parent_node, false placed
  from roots o join tree t on t.r = o.r and t.up = o.root and t.key in ('recipeInstructions', 'review')
  union all
  select t.r, t.doc, t.nid, t.type, case when w.type = 'ARRAY' then w.label else t.key end,
    case when w.type = 'ARRAY' then case when w.path = '' then t.key else w.path || '.' || t.key end else case when w.placed then w.path when w.path = '' then '0' else w.path || '.0' end end,
    case when w.type = 'ARRAY' then w.parent_node when w.placed then w.path when w.path = '' then '0' else w.path || '.0' end,
    w.type = 'ARRAY'
  from walk w join tree t on t.r = w.r and t.up = w.nid
  where w.type = 'ARRAY' or w.type = 'OBJECT' and (w.label in ('recipeInstructions', 'itemListElement') and t.key = 'itemListElement' or w.label in ('review', 'comment') and t.key = 'comment')),
found as (
  select w.doc id, w.label, w.type, case when placed then path when path = '' then '0' else path || '.0' end node, parent_node,
    exists(select 1 from tree t where t.r = w.r and t.up = w.nid and t.key = 'itemListElement') listed,
    exists(select 1 from tree t where t.r = w.r and t.up = w.nid and t.key = 'text') texted
  from walk w where w.type in ('OBJECT', 'VARCHAR'))
select id, case when label = 'review' then 'review' when label = 'comment' then 'reply' when type = 'OBJECT' and listed then 'section' else 'step' end kind, node, parent_node
from found
where case when label in ('review', 'comment') then type = 'OBJECT' else type = 'VARCHAR' or listed or texted end""",
}
