"""The registered queries as SQL over the same tables.

Written from the meaning of each operator, not from its Spark plan: whole tables,
plain joins and group-bys. Every query has an entry.
"""

from __future__ import annotations

from agroclime.functions import keywords as kw
from agroclime.operators import answers as an
from agroclime.operators.corpus import SOURCE_LABEL
from agroclime.plans import bindings as b

ORACLE: dict[str, str] = {}
MODEL_DIM = 64  # width of the queries' vectors, as in the catalog

# Computed decimals are rounded as ``round(x + 3e-7, 4)`` (``3e-9`` for 6 digits) on
# both sides: means of few amounts often sit exactly on a rounding tie, where the
# last bit of the sum, and so the order of the rows, would decide.


def mean(x: str) -> str:
    """A mean that does not depend on row order: summed from the smallest value up."""
    return f"(list_aggregate(list_sort(list({x}) filter ({x} is not null)), 'sum') / nullif(count({x}), 0))"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(words) -> str:
    return "[" + ", ".join(text(w) for w in words) + "]"


def any_in(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {text(w)})" for w in words) + ")"


# -------------------------------------------------------------- shared tables

NAT = "nat as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey)"
ORD = """ord as (
  select o_orderkey, o_totalprice, cast(year(o_orderdate) as bigint) as y, quarter(o_orderdate) as qtr,
         c_mktsegment, n_name, r_name
  from orders join customer on o_custkey = c_custkey join nat on c_nationkey = n_nationkey)"""
RAIN = """rain as (
  select r_name as subdivision, y as year, round(avg(o_totalprice), 2) as annual_rainfall,
         round(avg(case when qtr = 1 then o_totalprice end), 2) as jf,
         round(avg(case when qtr = 2 then o_totalprice end), 2) as mam,
         round(avg(case when qtr = 3 then o_totalprice end), 2) as jjas,
         round(avg(case when qtr = 4 then o_totalprice end), 2) as ond
  from ord group by 1, 2)"""
STATE_RAIN = """state_rain as (
  select n_name as state, y as year, round(avg(o_totalprice), 2) as annual_rainfall from ord group by 1, 2)"""
CROP = """crop as (
  select n_name as state, c_mktsegment as district, p_type as crop,
         cast(y as varchar) || '-' || lpad(cast((y + 1) % 100 as varchar), 2, '0') as year, y as year_cleaned,
         cast(l_quantity as double) as area, l_extendedprice as production, l_extendedprice / l_quantity as yield,
         r_name as subdivision, l_orderkey, l_linenumber, l_partkey
  from lineitem join ord on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
FACTS = """facts as (
  select state, district, c.year_cleaned, crop, production, yield, annual_rainfall, area,
         l_orderkey, l_linenumber, l_partkey
  from crop c join rain r on c.subdivision = r.subdivision and c.year_cleaned = r.year)"""
SENTENCE = """'In ' || cast(year_cleaned as varchar) || ', the district ' || district || ' in ' || state
  || ' produced ' || format('{:.2f}', production) || ' tonnes of ' || crop
  || ' with yield ' || format('{:.2f}', yield) || ' tonnes per hectare and recorded '
  || format('{:.1f}', annual_rainfall) || ' mm annual rainfall.'"""
DOCS = f"""docs as (
  select substr(sha1(concat_ws('|', state, district, crop, cast(year_cleaned as varchar),
                               cast(production as varchar))), 1, 16) as id,
         {SENTENCE} as text,
         state, district, year_cleaned as year, crop, production, yield, annual_rainfall,
         {text(SOURCE_LABEL)} as source, {text(b.CREATED_AT)} as created_at
  from facts)"""


def key_sql(family: str) -> str:
    keys, _ = b.FAMILIES[family]
    return " || '|' || ".join([text(family), *[f"cast({k} as varchar)" for k in keys]])


def qid_sql(key: str) -> str:
    return f"cast('0x' || substr(md5({key}), 1, 15) as bigint)"


def template_sql(family: str) -> str:
    keys, templates = b.FAMILIES[family]
    def filled(t: str) -> str:
        sql = text(t)
        for k in keys:
            sql = f"replace({sql}, {text('{' + k + '}')}, cast({k} as varchar))"
        return sql
    whens = " ".join(f"when {i} then {filled(t)}" for i, t in enumerate(templates))
    return f"case {qid_sql(key_sql(family))} % {len(templates)} {whens} end"


QUESTIONS = "questions as (\n  " + "\n  union ".join(
    f"select {qid_sql(key_sql(f))} as question_id, {template_sql(f)} as query from docs" for f in b.FAMILIES
) + ")"
HITS = "keyed as (\n  " + "\n  union all ".join(
    f"select {qid_sql(key_sql(f))} as question_id, *, "
    "cast(cast('0x' || substr(id, 1, 8) as bigint) as double) / 4294967296.0 as similarity_score from docs"
    for f in b.FAMILIES
) + f"""),
hits as (
  select * from (
    select *, row_number() over (
      partition by question_id order by similarity_score desc, id, yield, annual_rainfall) as rank
    from keyed) where rank <= {b.HITS_PER_QUESTION})"""
ROUTE = f"""case
    when {any_in('lower(query)', kw.ASK_VALUE)} and not {any_in('lower(query)', kw.ASK_COMPARE)} then
      case when {any_in('lower(query)', kw.ASK_TREND)} or {any_in('query', kw.QUESTION_YEARS)} then 'trend'
           else 'specific' end
    when {any_in('lower(query)', kw.ASK_COMPARE)} then 'comparison'
    when {any_in('lower(query)', kw.ASK_TREND_LOOSE)} then 'trend'
    when {any_in('lower(query)', kw.ASK_EXTREME)} then 'extreme'
    when {any_in('lower(query)', kw.ASK_RELATION)} then 'relationship'
    else 'summary' end"""
TERMS = f"""vocab as (
  select (select list(lower(n_name) order by n_nationkey) from nation) as states,
         (select list(t order by t) from (select distinct lower(p_type) as t from part)) as crops),
terms as (
  select question_id, query, {ROUTE} as route,
         list_filter(states, lambda s: contains(lower(query), s))[1] as q_state,
         list_filter(crops, lambda c: contains(lower(query), c))[1] as q_crop,
         list_filter({names(kw.QUESTION_YEARS)}, lambda y: contains(query, y)) as q_years,
         contains(lower(query), 'to') or contains(lower(query), '-') as q_open
  from questions cross join vocab)"""
POINTS = """judged as (
  select h.question_id, query, route, h.rank as old_rank, state, district, year, crop, production, yield,
         annual_rainfall as rainfall,
         (q_state is null or lower(state) = q_state) and (q_crop is null or lower(crop) = q_crop)
         and (len(q_years) = 0 or list_contains(q_years, cast(year as varchar)) or q_open) as fits
  from hits h join terms t on h.question_id = t.question_id),
points as (
  select *, row_number() over (partition by question_id order by old_rank) as rank
  from (select *, bool_or(fits) over (partition by question_id) as some_fit from judged)
  where case when some_fit then fits else old_rank <= 20 end)"""

CHAIN = [NAT, ORD, RAIN, CROP, FACTS, DOCS, QUESTIONS, HITS, TERMS, POINTS]


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


UPTO_RAIN = with_(NAT, ORD, RAIN)
UPTO_STATE_RAIN = with_(NAT, ORD, STATE_RAIN)
UPTO_CROP = with_(NAT, ORD, CROP)
UPTO_FACTS = with_(*CHAIN[:5])
UPTO_DOCS = with_(*CHAIN[:6])
UPTO_QUESTIONS = with_(*CHAIN[:7])
UPTO_HITS = with_(*CHAIN[:8])
UPTO_TERMS = with_(*[c for c in CHAIN[:9] if c is not HITS])
UPTO_POINTS = with_(*CHAIN)
FACT_COLS = "state, district, year_cleaned, crop, production, yield, annual_rainfall"


def put(name: str, sql: str) -> None:
    ORACLE[name] = sql


# --------------------------------------------------------- cleaning and facts

put("normalize_columns", "select c_custkey as customer_key, c_mktsegment as market_segment, "
    "round(c_acctbal + 3e-7, 4) as account_balance from customer")
put("normalize_rain", UPTO_RAIN + "select * from rain where year > 1900")
put("null_tokens", "select case when l_returnflag <> 'N' then l_returnflag || '/A' end as flag, "
    "l_linestatus as status, count(*) as n_rows from lineitem group by 1, 2")
put("extract_year", UPTO_CROP + "select year, year_cleaned, count(*) as n_rows from crop group by 1, 2")
put("coerce_numeric", "select o_orderkey, round(o_totalprice + 3e-7, 4) as price, cast(null as double) as priority, "
    "cast(substr(o_orderpriority, 1, 1) as double) as level from orders")
put("coerced_cells", "select 'price' as column_name, cast(0 as bigint) as coerced "
    "union all select 'priority', count(*) from orders")
put("to_int_year", "select cast(year(o_orderdate) as varchar) || '.0' as year_text, cast(year(o_orderdate) as bigint) as year, "
    "cast(null as bigint) as bad_year, count(*) as n_rows from orders group by 1, 2, 3")
put("map_subdivision", UPTO_CROP + "select state, subdivision, count(*) as n_rows from crop group by 1, 2")
STATES = sorted(kw.STATE_SUBDIVISION)
put("map_subdivision_literal", f"with named as (select {names(STATES)}[1 + c_nationkey % {len(STATES)}] as state from customer), "
    "dim as (select unnest(" + names(STATES) + ") as state, unnest(" + names([kw.STATE_SUBDIVISION[x] for x in STATES]) + ") as subdivision) "
    "select state, subdivision, count(*) as n_rows from named left join dim using (state) group by 1, 2")
put("strict_crop_clean", UPTO_CROP + f"select state, district, crop, year, area, production, yield from crop")
put("flag_rain_counts", "select case when o_orderpriority = '1-URGENT' then 'bad year' "
    "when o_orderpriority = '5-LOW' then 'missing rainfall' else 'written' end as outcome, count(*) as n_rows "
    "from orders group by 1")
put("facts", UPTO_FACTS + f"select {FACT_COLS} from facts")
put("join_rainfall_years", UPTO_FACTS.replace(FACTS, "facts as (select c.subdivision, r.year as rain_year, annual_rainfall, area "
    "from crop c join rain r on c.subdivision = r.subdivision and c.year_cleaned = r.year)")
    + "select subdivision, rain_year, annual_rainfall, count(*) as n_rows, "
    "round(avg(area) + 3e-7, 4) as avg_area from facts group by 1, 2, 3")
put("join_rainfall_fan_out", with_(NAT, ORD, STATE_RAIN, CROP) +
    "select c.state, c.year_cleaned, count(*) as n_rows, round(avg(s.annual_rainfall) + 3e-7, 4) as avg_rainfall "
    "from crop c join nat n on c.subdivision = n.r_name join state_rain s on s.state = n.n_name and s.year = c.year_cleaned "
    "group by 1, 2")
put("duplicate_rain", UPTO_STATE_RAIN + "select r_name as subdivision, year, count(*) as n_rows "
    "from state_rain join nat on state = n_name group by 1, 2 having count(*) > 1")
put("reject_counts", UPTO_CROP + "select case when crop = 'SMALL' then 'blank crop' else 'written' end as outcome, "
    "count(*) as n_rows from crop group by 1")

# ------------------------------------------------------------------- explorer

put("summary_counts", UPTO_FACTS + "select count(*) as total_records, count(distinct state) as states, "
    "count(distinct district) as districts, count(distinct crop) as crops, min(year_cleaned) as first_year, "
    "max(year_cleaned) as last_year from facts")
put("explorer_filter", UPTO_FACTS + f"select {FACT_COLS} from facts where state in ('NATION_1', 'NATION_7') "
    "and crop in ('PROMO', 'SMALL') and year_cleaned in (1998, 1999)")
put("explorer_page", UPTO_FACTS + f"select {FACT_COLS} from (select {FACT_COLS} from facts where state = 'NATION_3' "
    f"order by {FACT_COLS} limit 1000)")
put("preview", UPTO_FACTS + f"select {FACT_COLS} from (select {FACT_COLS} from facts order by {FACT_COLS} limit 10)")
MEANS3 = "avg(production) as avg_production, avg(yield) as avg_yield, avg(annual_rainfall) as avg_rainfall"
put("explorer_metrics", UPTO_FACTS + "select count(*) as total_records, round(avg(production) + 3e-7, 4) as avg_production, "
    "round(avg(yield) + 3e-7, 4) as avg_yield, round(avg(annual_rainfall) + 3e-7, 4) as avg_rainfall "
    "from facts where crop in ('PROMO', 'LARGE')")
put("metric_labels", UPTO_FACTS + "select cast(count(*) as varchar) as total_records, "
    "format('{:.2f}', avg(production)) || ' tonnes' as avg_production, format('{:.2f}', avg(yield)) || ' t/ha' as avg_yield, "
    "format('{:.1f}', avg(annual_rainfall)) || ' mm' as avg_rainfall from facts")
put("merged_metrics", UPTO_FACTS + "select count(*) as total_records, count(distinct state) as states, count(distinct crop) as crops, "
    "cast(min(year_cleaned) as bigint) as first_year, cast(max(year_cleaned) as bigint) as last_year, true as districts_within, true as quartiles_within, " + ", ".join(
        f"count({m}) as n_{m}, round(avg({m}) + 3e-7, 4) as avg_{m}, min({m}) as min_{m}, max({m}) as max_{m}" for m in ("production", "yield", "annual_rainfall"))
    + " from facts where crop in ('PROMO', 'LARGE') and year_cleaned in (1996, 1997, 1998)")
put("describe_approx", UPTO_FACTS + " union all ".join(
    f"select '{m}' as column_name, count({m}) as count, round(avg({m}) + 3e-7, 4) as mean, round(stddev_samp({m}) + 3e-7, 4) as std, "
    f"round(min({m}) + 3e-7, 4) as min, round(max({m}) + 3e-7, 4) as max, true as quartiles_within from facts" for m in ("production", "yield", "annual_rainfall")))
put("find_terms", """with bench as (select regexp_split_to_array(lower(text), '[^a-z]+') as w from benchmark),
terms as (select distinct t from (
  select unnest(w) as t from bench union all select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from bench) where t <> ''),
placed as (select t, row_number() over (order by t) - 1 as position from terms),
found as (select doc_id, t, position from (select doc_id, lower(text) as text from documents where text is not null) join placed on contains(text, t))
select doc_id, count(*) as n_terms, min_by(t, position) as first_term, md5(string_agg(t, '|' order by position)) as terms_md5 from found group by doc_id""")
put("question_terms_by_index", UPTO_TERMS + "select question_id, q_state, q_crop from terms")
put("distinct_values", UPTO_FACTS + "select distinct crop from facts")
put("first_states", UPTO_FACTS + "select distinct state from facts order by state limit 10")
put("missing_summary", UPTO_RAIN + "\nunion all ".join(
    f"select '{c}' as column_name, count(*) - count({c}) as missing from rain"
    for c in ("subdivision", "year", "annual_rainfall", "jf", "mam", "jjas", "ond")))
put("profile", UPTO_FACTS + "\nunion all ".join(
    f"select '{c}' as column_name, '{t}' as data_type, count({c}) as non_null, count(*) as n_rows, "
    "cast(7 as bigint) as n_columns from facts"
    for c, t in (("state", "string"), ("district", "string"), ("year_cleaned", "int"), ("crop", "string"),
                 ("production", "double"), ("yield", "double"), ("annual_rainfall", "double"))))
put("sample_rows", UPTO_FACTS + f"select {FACT_COLS}, l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey "
    "from facts order by md5(concat_ws('|', '42', cast(l_orderkey as varchar), cast(l_linenumber as varchar), "
    "cast(l_partkey as varchar), cast(production as varchar))), l_orderkey, l_linenumber, l_partkey, production limit 2000")

# ------------------------------------------------------------------------ EDA

def describe(table: str, cols) -> str:
    return "\nunion all ".join(
        f"select '{c}' as column_name, count({c}) as count, round(avg({c}) + 3e-7, 4) as mean, round(stddev_samp({c}) + 3e-7, 4) as std, "
        f"round(min({c}) + 3e-7, 4) as min, round(quantile_cont({c}, 0.25) + 3e-7, 4) as p25, round(quantile_cont({c}, 0.5) + 3e-7, 4) as p50, "
        f"round(quantile_cont({c}, 0.75) + 3e-7, 4) as p75, round(max({c}) + 3e-7, 4) as max from {table}" for c in cols)


put("describe_facts", UPTO_FACTS + describe("facts", ("area", "production", "yield", "annual_rainfall")))
put("describe_rain", UPTO_RAIN + describe("rain", ("annual_rainfall", "jf", "mam", "jjas", "ond")))


def means(keys: str, tail: str = "", **cols: str) -> str:
    picked = ", ".join(f"round(avg({m}) + 3e-7, 4) as {out}" for out, m in cols.items())
    by = ", ".join(str(i + 1) for i in range(len(keys.split(", "))))
    return UPTO_FACTS + f"select {keys}, {picked} from facts group by {by} {tail}"


put("yearly_means", means("year_cleaned", avg_rainfall="annual_rainfall", avg_yield="yield"))
put("top_crops_by_production", means("crop", "order by avg(production) desc, crop limit 10", avg_production="production"))
put("top_crops_by_yield", means("crop", "order by avg(yield) desc, crop limit 15", avg_yield="yield"))
put("state_rainfall", means("state", avg_rainfall="annual_rainfall"))
put("state_rain_yield", means("state", avg_rainfall="annual_rainfall", avg_yield="yield"))
put("state_yield", means("state", avg_yield="yield"))
put("best_states", means("state", "order by avg(yield) desc, state limit 5", avg_yield="yield"))
put("most_recorded_crops", UPTO_FACTS + "select crop, count(*) as n_rows from facts group by 1 order by 2 desc, 1 limit 5")
put("restrict_to_top", UPTO_FACTS + f"select {FACT_COLS} from facts where crop in "
    "(select crop from facts group by crop order by count(*) desc, crop limit 5)")
put("crop_year_yield", UPTO_FACTS + "select crop, year_cleaned, round(avg(yield) + 3e-7, 4) as avg_yield from facts where crop in "
    "(select crop from facts group by crop order by count(*) desc, crop limit 5) group by 1, 2")
CHART_KEYS = 'year_cleaned as "Year", state as "State", crop as "Crop"'
put("chart_production", means(CHART_KEYS, avg_production="production"))
put("chart_yield", means(CHART_KEYS, avg_yield="yield"))
put("corr_pair", UPTO_FACTS + "select round(corr(annual_rainfall, yield) + 3e-9, 6) as correlation from facts")
MEASURES = ("production", "yield", "annual_rainfall")
put("corr_matrix", UPTO_FACTS + "\nunion all ".join(
    f"select '{r}' as column_name, " + ", ".join(f"round(corr({r}, {c}) + 3e-9, 6) as {c}" for c in MEASURES) + " from facts"
    for r in MEASURES))
put("scatter_points", UPTO_FACTS + f"select annual_rainfall, yield, state from facts")
put("scatter_production", UPTO_FACTS + f"select annual_rainfall, production from facts")

# ------------------------------------------------------------------- rainfall

TWO = "state in ('NATION_2', 'NATION_5')"
put("rain_filter", UPTO_STATE_RAIN + f"select state, year, annual_rainfall from state_rain "
    f"where {TWO} and year in (1997, 1998)")
put("compare_rainfall", UPTO_STATE_RAIN + "select state, round(avg(annual_rainfall) + 3e-7, 4) as avg_annual_rainfall from state_rain "
    f"where {TWO} and year > (select max(year) from state_rain) - 3 group by 1")
put("compare_rainfall_listed", UPTO_STATE_RAIN + "select state, round(avg(annual_rainfall) + 3e-7, 4) as avg_annual_rainfall "
    f"from state_rain where {TWO} and year in (1996, 1997, 1999) group by 1")
PARSER_QUESTIONS = f"""parser_questions as (
  select {qid_sql("state || '|' || cast(year as varchar)")} as question_id,
         case when o.n_name is not null and year % 2 = 0 then
                'Compare the average annual rainfall in ' || state || ' and ' || o.n_name || ' for the last '
                || cast(year % 4 + 2 as varchar) || ' seasons.'
              when year % 3 = 0 then 'Most produced rice and tea in ' || state
              when year % 3 = 1 then 'Show growth of maize in ' || state || ' since ' || cast(year as varchar)
              else 'Hello ' || state end as query
  from state_rain join nation n on state = n.n_name left join nation o on o.n_nationkey = n.n_nationkey + 1)"""
CLASS = "case " + " ".join(
    f"when {any_in('lower(query)', words)} then '{name}'" for name, words in kw.QUESTION_CLASSES
) + " else 'unknown' end"
PARSED = f"""parsed as (
  select question_id, query, {CLASS} as type,
         list_transform(list_sort(list_transform(
           list_filter((select list(n_name order by n_nationkey) from nation), lambda s: contains(lower(query), lower(s))),
           lambda s: {{'pos': instr(lower(query), lower(s)), 'name': s}})), lambda m: m.name) as states,
         list_filter({names(kw.ENTITY_CROPS)}, lambda c: contains(lower(query), c)) as crops,
         regexp_extract_all(query, '\\d{{4}}') as years,
         regexp_extract_all(query, '\\b(\\d{{1,3}})\\b', 1) as numbers
  from parser_questions)"""
UPTO_PARSED = with_(NAT, ORD, STATE_RAIN, PARSER_QUESTIONS, PARSED)
put("classify_question", UPTO_PARSED + "select question_id, query, type from parsed")
put("extract_entities", UPTO_PARSED + "select question_id, " + ", ".join(
    f"coalesce(array_to_string({c}, ','), '') as {c}" for c in ("states", "crops", "years", "numbers")) + " from parsed")
put("with_defaults", UPTO_PARSED + "select question_id, query, cast(case when query like 'Compare%' then 3 else 5 end as bigint) as top_k, "
    "cast(0.7 as double) as temperature from parsed")
put("answer_parsed", UPTO_PARSED + f""", asked as (
  select question_id, type, list_distinct(states) as states, coalesce(cast(numbers[1] as bigint), 5) as n,
         (select max(year) from state_rain) as last_year from parsed),
pairs as (
  select question_id, n, last_year, unnest(states) as state from asked
  where type = 'compare_rainfall' and len(states) >= 2),
means as (
  select p.question_id, p.n, p.last_year, p.state, cast(sum(cast(annual_rainfall as decimal(28,6))) as double) / nullif(count(annual_rainfall), 0) as mean,
         row_number() over (partition by p.question_id order by p.state) as i
  from pairs p join state_rain s on s.state = p.state and s.year between p.last_year - p.n + 1 and p.last_year
  group by 1, 2, 3, 4),
told as (
  select a.question_id, 'From ' || cast(a.last_year - a.n + 1 as varchar) || ' to ' || cast(a.last_year as varchar) || ', '
         || a.state || ' had an average annual rainfall of ' || format('{{:.2f}}', a.mean) || ' mm, while '
         || b.state || ' had ' || format('{{:.2f}}', b.mean) || ' mm.' as answer
  from means a join means b on a.question_id = b.question_id and a.i = 1 and b.i = 2)
select q.question_id, case when type <> 'compare_rainfall' then 'Question type not yet supported.'
       else coalesce(answer, 'Please provide two states to compare.') end as answer
from asked q left join told t on q.question_id = t.question_id""")

# --------------------------------------------------------- corpus and sources

put("documents_by_the_clock", UPTO_FACTS + "select state, count(*) as n_documents, 1 as n_stamps, true as stamped from facts group by state")
put("rows_to_table", UPTO_FACTS + f"select {FACT_COLS} from (select {FACT_COLS} from facts order by {FACT_COLS} limit 50)")
put("fact_sentences", UPTO_FACTS + f"select {SENTENCE} as text, {FACT_COLS} from facts")
DOC_COLS = "id, text, state, district, year, crop, production, yield, annual_rainfall, source, created_at"
for name in ("build_documents", "document_json", "corpus_json"):
    put(name, UPTO_DOCS + f"select {DOC_COLS} from docs")
put("corpus_sample", UPTO_DOCS + "select id, text from docs order by id, text limit 200")
put("corpus_sample_csv", UPTO_DOCS + f"select {DOC_COLS} from docs order by id, text limit 200")
for name in ("facts_csv", "raw_csv"):
    put(name, ORACLE["facts"])
put("facts_parquet", ORACLE["facts"])
put("csv_quoted_breaks", """with d as (
  select cast(doc_id as varchar) as doc_id, lang, '"é",' || chr(10) || replace(text, chr(13), '') as text from documents where text is not null)
select doc_id, text, count(*) + count(case when not regexp_matches(text, '[^\\x{0}-\\x{FF}]') then 1 end) as n_rows, count(lang) as n_lang, max(lang) as lang
from d group by doc_id, text""")
put("facts_csv_reordered", UPTO_FACTS + "select state, district, year_cleaned, crop, production, cast(null as double) as yield, "
    "annual_rainfall from facts")

# -------------------------------------------------------------------- vectors

put("l2_normalize", "select vec_id, cast(1.0 as double) as squares, "
    "round(list_sum(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))) + 3e-7, 4) as total "
    "from (select vec_id, cast(embedding as double[]) as e from embeddings)")
put("vector_manifest", "select 'table-64' as model_name, cast(max(len(embedding)) as bigint) as embedding_dim, "
    "count(*) as num_vectors, 'IndexFlatIP' as index_type from embeddings")
VEC = "vec as (select vec_id, label, cast(embedding as double[]) as e from embeddings)"
CENTROIDS = """parts as (
  select label, pos, avg(x) as x from (
    select label, unnest(e) as x, generate_subscripts(e, 1) as pos from vec) group by 1, 2),
asked as (select cast(label as bigint) as question_id, list(x order by pos) as q from parts group by 1)"""


def topk(asked: str, extra: str = "") -> str:
    return with_(VEC, asked) + f""", scored as (
  select question_id, vec_id, round(list_inner_product(q, e), 9) as s {extra} from asked cross join vec),
ranked as (select *, row_number() over (partition by question_id order by s desc, vec_id) as rank from scored)
"""


put("similarity_topk", topk(CENTROIDS, ", label") + "select question_id, rank, vec_id, round(s + 3e-9, 6) as similarity_score, "
    "cast(label as bigint) as label from ranked where rank <= 5")
put("similarity_topk_batch", topk("asked as (select vec_id as question_id, e as q from vec)")
    + "select question_id, rank, vec_id, round(s + 3e-9, 6) as similarity_score from ranked where rank <= 5")
put("similarity_topk_blocks", ORACLE["similarity_topk_batch"])
GROUPED = """vec as (select vec_id, label, cast(list_transform(embedding, lambda x, i: cast(
  cast(x as double) + case when (i - 1) % 10 = label then 2.0 else 0.0 end as float)) as double[]) as e from embeddings),
asked as (select vec_id as question_id, e as q from vec)"""
put("pruned_topk", topk(CENTROIDS, ", label").replace(with_(VEC, CENTROIDS).rstrip(), with_(GROUPED).rstrip())
    + "select question_id, rank, vec_id, round(s + 3e-9, 6) as similarity_score, cast(label as bigint) as label from ranked where rank <= 7")
put("prune_report", "select vec_id as question_id, count(*) over () as vectors, true as enough, true as at_most_all, true as cells_at_most_all from embeddings")
put("attach_documents", topk(CENTROIDS) + "select question_id, rank, vec_id, round(s + 3e-9, 6) as similarity_score, text, lang "
    "from ranked join documents on doc_id = vec_id where rank <= 5")
def coded(texts: str) -> str:
    """Vectors of the model file for the distinct texts of a table: units(text, e)."""
    return f"""said as (select distinct coalesce(text, '') as text from {texts}),
spoken as (select text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+')) as word from said),
hashed as (select word, cast('0x' || substr(md5(word), 1, 8) as bigint) % {MODEL_DIM} as b, case when substr(md5(word), 9, 1) < '8' then 1 else -1 end as sign
  from (select distinct word from spoken)),
buckets as (select text, b, cast(sum(sign) * (1 + b % 7) as double) as v from spoken join hashed using (word) group by text, b),
mapped as (select text, map_from_entries(list(row(b, v))) as m, sqrt(sum(v * v)) as size from buckets group by text),
units as (select text, list_transform(range({MODEL_DIM}), lambda i: case when size > 0 then cast(coalesce(m[i], 0) / size as float) else 0::float end) as e
  from said left join mapped using (text))"""


SHOWN = "list_aggregate(list_transform(e, lambda x: cast(cast(round(cast(x as double) * 1e6) as bigint) as varchar)), 'string_agg', ',')"
DOC_COLS = "id, d.text, state, district, year, crop, production, yield, annual_rainfall, source, created_at"
put("vectors_parquet", UPTO_DOCS.rstrip() + f", {coded('docs')} select {DOC_COLS}, {SHOWN} as embedding from docs d join units u on d.text = u.text")
put("grown_vector_store", ORACLE["vectors_parquet"])
put("grown_vector_manifest", UPTO_DOCS + f"select 'md5-words' as model_name, cast({MODEL_DIM} as bigint) as embedding_dim, count(*) as num_vectors, "
    "'IndexFlatIP' as index_type from docs")
put("written_counts", UPTO_FACTS + """select case when crop = 'SMALL' then 'blank crop' else 'written' end as outcome, count(*) as n_rows from facts group by 1
union all select 'read back', count(*) from facts where crop <> 'SMALL'""")
put("document_keys", UPTO_FACTS + """, docs as (
  select substr(sha1(concat_ws('|', state, district, crop, cast(year_cleaned as varchar), 'nan')), 1, 16) as id,
    'In ' || cast(year_cleaned as varchar) || ', the district ' || district || ' in ' || state || ' reported production for ' || crop
    || ' with yield ' || format('{:.2f}', yield) || ' tonnes per hectare and recorded ' || format('{:.1f}', annual_rainfall)
    || ' mm annual rainfall.' as text from facts)
select id, row_number() over (partition by id order by text) - 1 as occurrence, text from docs""")
put("embed_documents", f"with {coded('documents')} select doc_id, {SHOWN} as embedding from documents d join units u on coalesce(d.text, '') = u.text")
# The five nearest documents of each question.
FOUND = f"""{coded("(select text from docs union all select query from questions)")},
ids as (select id, d.text, e from (select distinct id, text from docs) d join units u on d.text = u.text),
wanted as (select question_id, e as q from questions t join units u on t.query = u.text),
near as (select question_id, min(row(-round(list_inner_product(cast(q as double[]), cast(e as double[])), 9), id), 5) as best from wanted cross join ids group by 1)"""
put("retrieve", UPTO_QUESTIONS.rstrip() + f", {FOUND}" + """,
chosen as (select question_id, unnest(best) as r from near),
hits as (select question_id, -r[1] as s, d.id, d.text, row_number() over (partition by question_id order by -r[1] desc, d.id, d.text) as rank
  from chosen join docs d on d.id = r[2])
select question_id, rank, id, text, round(s + 3e-9, 6) as similarity_score from hits where rank <= 5""")


# ----------------------------------------------------------------- data points

put("question_hits", UPTO_HITS + "select question_id, rank, id, round(similarity_score + 3e-7, 4) as similarity_score from hits")
put("flatten_hits", UPTO_HITS + "select question_id, rank, state, district, year, crop, production, "
    "yield, annual_rainfall as rainfall, text from hits")
put("route_questions", UPTO_TERMS + "select question_id, query, route from terms")
put("wants_chart", UPTO_QUESTIONS + f"select question_id, cast({any_in('lower(query)', kw.ASK_CHART)} as bigint) as chart from questions")
POINT_COLS = "state, district, year, crop, production, yield, rainfall"
put("filter_by_question", UPTO_POINTS + f"select question_id, query, rank, {POINT_COLS} from points")
FIRST = """, firsts as (
  select *, row_number() over (partition by question_id order by rank) as place from (
    select *, row_number() over (partition by question_id, state, crop, year order by rank) as i
    from points where rank <= 20) where i = 1)
"""
put("first_per_group", UPTO_POINTS + FIRST + f"select question_id, place, {POINT_COLS} from firsts where place <= 5")
GROUPS = f""", capped as (
  select *, contains(lower(query), 'year') as says_year from points where rank <= 50),
spread as (
  select question_id, count(distinct year) as ny, count(distinct state) as ns, count(distinct crop) as nc,
         bool_or(says_year) as says_year from capped group by 1),
sizes as (select question_id, count(*) as n_points from points group by 1),
modes as (
  select s.question_id, n_points, case when says_year or ny > 1 then 'year' when ns > 1 then 'state' when nc > 1 then 'crop'
         else 'none' end as mode from spread s join sizes z on s.question_id = z.question_id),
grps as (
  select m.question_id, mode, case mode when 'year' then cast(year as varchar) when 'state' then state else crop end as key,
         {mean('production')} as p, {mean('yield')} as yl, {mean('rainfall')} as r
  from capped c join modes m on c.question_id = m.question_id where mode <> 'none' group by 1, 2, 3),
placed as (
  select *, row_number() over (partition by question_id order by key) as up,
         row_number() over (partition by question_id order by key desc) as down from grps),
cmp as (select * from placed where case when mode = 'year' then down else up end <= 10)
"""
for mode, col in (("year", "cast(key as bigint) as year"), ("state", "key as state"), ("crop", "key as crop")):
    rain = ", round(r + 3e-7, 4) as avg_rainfall" if mode == "year" else ""
    put(f"compare_by_{mode}", UPTO_POINTS + GROUPS + f"select question_id, {col}, round(p + 3e-7, 4) as avg_production, "
        f"round(yl + 3e-7, 4) as avg_yield{rain} from cmp where mode = '{mode}'")
TREND = f""", yearly as (
  select question_id, year, nullif({mean('production')}, 0) as p, nullif({mean('yield')}, 0) as yl,
         nullif({mean('rainfall')}, 0) as r,
         row_number() over (partition by question_id order by year desc) as latest
  from points group by 1, 2),
trend as (select * from yearly where latest <= 10),
ends as (
  select question_id, count(p) as n, min(year) as y1, max(year) as y2, arg_min(p, year) as p1, arg_max(p, year) as p2
  from trend where p is not null group by 1)
"""
put("trend_by_year", UPTO_POINTS + TREND + "select question_id, year, round(p + 3e-7, 4) as avg_production, round(yl + 3e-7, 4) as avg_yield, "
    "round(r + 3e-7, 4) as avg_rainfall from trend")
put("trend_direction", UPTO_POINTS + TREND + "select question_id, case when p2 > p1 then 'increasing' else 'decreasing' end as direction, "
    "round((p2 - p1) / p1 * 100 + 3e-7, 4) as change_pct, y1 as first_year, y2 as last_year from ends where n >= 2 and p1 > 0")
for name, order, cond in (("extreme_max", "production desc", "true"), ("extreme_min", "production", "production > 0")):
    put(name, UPTO_POINTS + f"select question_id, {POINT_COLS} from (select *, row_number() over "
        f"(partition by question_id order by {order}, rank) as i from points where {cond}) where i = 1")
CORR = f""", pairs as (
  select question_id, count(*) as n_pairs, corr(annual_rainfall, yield) as c, {mean('annual_rainfall')} as r, {mean('yield')} as yl,
         stddev_samp(annual_rainfall) as sd_r, stddev_samp(yield) as sd_y
  from hits group by 1),
rel as (
  select question_id, n_pairs, case when sd_r > 0 and sd_y > 0 then c end as c, r, yl from pairs),
banded as (
  select *, case when n_pairs < 10 then 'limited' when c > 0.3 then 'positive' when c < -0.3 then 'negative'
                 when c is not null then 'weak' end as band from rel)
"""
put("question_corr", UPTO_HITS + CORR + "select question_id, n_pairs, round(c + 3e-9, 6) as correlation, round(r + 3e-9, 6) as avg_rainfall, "
    "round(yl + 3e-9, 6) as avg_yield, band from banded")
STATS = f""", stats as (
  select question_id, {mean('production')} as ap, max(production) as xp, min(production) as np,
         {mean('yield')} as ay, max(yield) as xy, min(yield) as ny, {mean('rainfall')} as ar, max(rainfall) as xr, min(rainfall) as nr,
         count(*) as n from points group by 1)
"""
put("summary_stats", UPTO_POINTS + STATS + """select s.question_id,
  round(ap + 3e-7, 4) as avg_production, xp as max_production, np as min_production,
  round(ay + 3e-7, 4) as avg_yield, xy as max_yield, ny as min_yield,
  round(ar + 3e-7, 4) as avg_rainfall, xr as max_rainfall, nr as min_rainfall, n as n_points, samples
from stats s join (
  select question_id, string_agg(concat_ws('/', cast(rank as varchar), state, cast(year as varchar), crop), ',' order by rank) as samples
  from points where rank <= 5 group by 1) p on s.question_id = p.question_id""")

# --------------------------------------------------------------------- answers

NL = "chr(10)"
CONTEXT = f""", contexts as (
  select question_id, {text(an.CONTEXT_START)} || {NL} || string_agg(
    '[Document ' || cast(rank as varchar) || ']' || {NL} || 'Text: ' || text || {NL} || 'Details: State: ' || state
    || ', District: ' || district || ', Year: ' || cast(year as varchar) || ', Crop: ' || crop || {NL}, {NL} order by rank)
    || {NL} || {text(an.CONTEXT_END)} as context
  from hits group by 1)
"""
put("context_text", UPTO_HITS + CONTEXT + "select * from contexts")
put("prompt_text", UPTO_HITS + CONTEXT + f"select q.question_id, {text(an.PROMPT_START)} || context || {text(an.PROMPT_QUESTION)} "
    f"|| query || {text(an.PROMPT_END)} as prompt from questions q join contexts c on q.question_id = c.question_id")

SPECIFIC = FIRST.rstrip() + f""",
a_specific as (
  select question_id, string_agg(
    '**' || state || '** | (District: ' || district || ') | - Year ' || cast(year as varchar) || ' | - Crop: ' || crop || {NL}
    || '  Production: **' || format('{{:,.2f}}', production) || ' tonnes** | Yield: **' || format('{{:.2f}}', yield)
    || ' tonnes/hectare** | Annual Rainfall: **' || format('{{:.1f}}', rainfall) || ' mm**' || {NL}, {NL} order by place) as answer
  from firsts where place <= 5 group by 1)
"""
COMPARISON = GROUPS.rstrip() + f""",
cmp_lines as (
  select question_id, string_agg(
    '  **' || key || '**: Avg Production: ' || format('{{:,.1f}}', p) || ' tonnes | Avg Yield: ' || format('{{:.2f}}', yl) || ' t/ha'
    || case when mode = 'year' then ' | Avg Rainfall: ' || format('{{:.1f}}', r) || ' mm' else '' end, {NL} order by key) as lines
  from cmp group by 1),
a_comparison as (
  select m.question_id, case when n_points < 2 then {text(an.LIMITED_COMPARISON)} else concat_ws({NL},
    {text(an.COMPARISON_TITLE)},
    case mode when 'year' then '*Year-wise Comparison:*' when 'state' then '*State-wise Comparison:*'
              when 'crop' then '*Crop-wise Comparison:*' end, lines) end as answer
  from modes m left join cmp_lines l on m.question_id = l.question_id)
"""
SUMMARY = STATS.rstrip() + f""",
sample_lines as (
  select question_id, string_agg('  - ' || state || ' (' || cast(year as varchar) || ') - ' || crop, {NL} order by rank) as lines
  from points where rank <= 5 group by 1),
a_summary as (
  select s.question_id, {text(an.SUMMARY_TITLE)} || {NL} || '*Production Statistics:*' || {NL}
    || '  - Average: ' || format('{{:,.1f}}', ap) || ' tonnes' || {NL} || '  - Maximum: ' || format('{{:,.1f}}', xp) || ' tonnes'
    || {NL} || '  - Minimum: ' || format('{{:,.1f}}', np) || ' tonnes' || {NL} || {NL} || '*Yield Statistics:*' || {NL}
    || '  - Average: ' || format('{{:.2f}}', ay) || ' tonnes/hectare' || {NL} || '  - Maximum: ' || format('{{:.2f}}', xy)
    || ' tonnes/hectare' || {NL} || '  - Minimum: ' || format('{{:.2f}}', ny) || ' tonnes/hectare' || {NL} || {NL}
    || '*Rainfall Statistics:*' || {NL} || '  - Average: ' || format('{{:.1f}}', ar) || ' mm' || {NL}
    || '  - Maximum: ' || format('{{:.1f}}', xr) || ' mm' || {NL} || '  - Minimum: ' || format('{{:.1f}}', nr) || ' mm'
    || {NL} || {NL} || '*Sample Records (' || cast(least(5, n) as varchar) || ' of ' || cast(n as varchar) || '):*'
    || {NL} || lines as answer
  from stats s join sample_lines l on s.question_id = l.question_id)
"""
TREND_ANSWER = TREND.rstrip() + f""",
trend_lines as (
  select question_id, string_agg(concat_ws(' | ', '  **' || cast(year as varchar) || '**',
    'Production: ' || format('{{:,.1f}}', p) || ' tonnes', 'Yield: ' || format('{{:.2f}}', yl) || ' t/ha',
    'Rainfall: ' || format('{{:.1f}}', r) || ' mm'), {NL} order by year) as lines
  from trend group by 1),
spans as (select question_id, count(*) as n_all, count(distinct year) as n_years from points group by 1),
a_trend as (
  select s.question_id, case when n_all < 2 then {text(an.LIMITED_TREND)} when n_years < 2 then a.answer else concat_ws({NL},
    {text(an.TREND_TITLE)}, lines, case when e.n >= 2 and p1 > 0 then
      {NL} || '*Production Trend: ' || case when p2 > p1 then 'increasing' else 'decreasing' end || ' by '
      || format('{{:.1f}}', abs((p2 - p1) / p1 * 100)) || '% from ' || cast(y1 as varchar) || ' to ' || cast(y2 as varchar) || '*' end)
    end as answer
  from spans s join a_summary a on s.question_id = a.question_id join trend_lines l on s.question_id = l.question_id
  left join ends e on s.question_id = e.question_id)
"""
EXTREME = f""", sided as (
  select *, case when {any_in('lower(query)', kw.ASK_MAX)} then 'max' when {any_in('lower(query)', kw.ASK_MIN)} then 'min'
            else 'none' end as side from points),
picked as (
  select * from (select *, row_number() over (partition by question_id
    order by case when side = 'max' then -production else production end, rank) as i
    from sided where side = 'max' or production > 0) where i = 1),
a_extreme as (
  select q.question_id, case when side is null or side = 'none' then {text(an.NO_EXTREME)} else
    case side when 'max' then '**Highest Production:**' else '**Lowest Production:**' end || {NL}
    || '  State: ' || state || {NL} || '  District: ' || district || {NL} || '  Crop: ' || crop || {NL}
    || '  Year: ' || cast(year as varchar) || {NL} || '  Production: **' || format('{{:,.2f}}', production) || ' tonnes**'
    || case side when 'max' then {NL} || '  Yield: ' || format('{{:.2f}}', yield) || ' tonnes/hectare' || {NL}
       || '  Rainfall: ' || format('{{:.1f}}', rainfall) || ' mm' else '' end end as answer
  from (select distinct question_id from points) q left join picked p on q.question_id = p.question_id)
"""
RELATION = CORR.rstrip() + f""",
a_relationship as (
  select question_id, case when band = 'limited' then {text(an.LIMITED_RELATIONSHIP)} else concat_ws({NL},
    {text(an.RELATIONSHIP_TITLE)}, '*Correlation Coefficient: ' || format('{{:.3f}}', c) || '*',
    case band when 'positive' then {text(an.RELATIONSHIP_BANDS['positive'])}
              when 'negative' then {text(an.RELATIONSHIP_BANDS['negative'])}
              when 'weak' then {text(an.RELATIONSHIP_BANDS['weak'])} end,
    {NL} || '*Average Values:*', '  - Average Rainfall: ' || format('{{:.1f}}', r) || ' mm',
    '  - Average Yield: ' || format('{{:.2f}}', yl) || ' tonnes/hectare') end as answer
  from banded)
"""
for kind, ctes in (("specific", SPECIFIC), ("comparison", COMPARISON), ("trend", SUMMARY.rstrip() + TREND_ANSWER),
                   ("extreme", EXTREME), ("summary", SUMMARY)):
    put(f"answer_{kind}", UPTO_POINTS + ctes + f"select question_id, answer from a_{kind}")
put("answer_relationship", UPTO_HITS + RELATION + "select question_id, answer from a_relationship")
put("answer_sources", UPTO_HITS + "select question_id, rank, text, state, round(similarity_score + 3e-9, 6) as similarity_score from hits")
TOLD = UPTO_POINTS + "".join(c.rstrip() for c in (SPECIFIC, COMPARISON, SUMMARY, TREND_ANSWER, EXTREME, RELATION)) + f""", plain as (
  select t.question_id, t.query, case route when 'specific' then s.answer when 'comparison' then c.answer when 'trend' then t2.answer
    when 'extreme' then e.answer when 'relationship' then r.answer else m.answer end as answer
  from terms t
  left join a_specific s on s.question_id = t.question_id left join a_comparison c on c.question_id = t.question_id
  left join a_trend t2 on t2.question_id = t.question_id left join a_extreme e on e.question_id = t.question_id
  left join a_relationship r on r.question_id = t.question_id left join a_summary m on m.question_id = t.question_id),
counted as (select question_id, count(*) as n from hits group by 1),
told as (
  select t.question_id, query, cast({b.HITS_PER_QUESTION} as bigint) as top_k, cast(0.7 as double) as temperature,
    answer || {NL} || {text(an.SOURCE_NOTE[0])} || cast(n as varchar) || {text(an.SOURCE_NOTE[1])} as answer, n as num_sources
  from plain t join counted c on t.question_id = c.question_id)
"""
put("answer_hits", TOLD + "select * from told")
# The same chain over the five retrieved documents of each question.
RETRIEVED = f"""{FOUND},
chosen as (select question_id, unnest(best) as r from near),
hits as (select * from (
  select question_id, d.*, -r[1] as similarity_score, row_number() over (
    partition by question_id order by -r[1] desc, d.id, d.text, state, district, year, crop, production, yield, annual_rainfall) as rank
  from chosen join docs d on d.id = r[2]) where rank <= 5)"""
put("answer_batch", TOLD.replace(HITS, RETRIEVED).replace(f"cast({b.HITS_PER_QUESTION} as bigint) as top_k", "cast(5 as bigint) as top_k") + """,
cited as (select question_id, string_agg(text || '/' || district, chr(10) order by rank) as sources from hits group by 1),
same as (select query, min(question_id) as question_id from told group by query)
select t.question_id, t.query, t.top_k, t.temperature, k.answer, k.num_sources, c.sources
from told t join same s on t.query = s.query join told k on k.question_id = s.question_id join cited c on c.question_id = s.question_id""")
# A key is answered in the first batch that asks it, from the smallest question id that asks it there.
KEPT = """, turns as (select query, min(question_id % 3) as turn from told group by query),
firsts_asked as (select t.query, turn, min(question_id) as question_id from told t join turns u on t.query = u.query
  where question_id % 3 = turn group by 1, 2),
kept as (select f.question_id, f.query, top_k, temperature, answer, num_sources, turn from firsts_asked f join told t using (question_id))
"""
put("kept_answers", TOLD + KEPT + "select query, top_k, temperature, answer, num_sources, substr('abc', turn + 1, 1) as batch from kept")
put("kept_history", TOLD + KEPT + """select query, case turn when 0 then '2026-01-01T00:00:00' when 1 then '2026-01-02T00:00:00'
  else '2026-01-04T00:00:00' end as timestamp, substr(answer, 1, 100) || '...' as answer_preview
from kept order by timestamp desc, query limit 200""")
put("served_answers", TOLD + """, turns as (select query, least(min(question_id % 3), 1) as turn from told group by query),
firsts_asked as (select t.query, min(question_id) as question_id from told t join turns u on t.query = u.query
  where least(question_id % 3, 1) = turn group by 1)
select t.question_id, t.query, t.top_k, t.temperature, k.answer, k.num_sources
from told t join firsts_asked f on t.query = f.query join told k on k.question_id = f.question_id""")
CHART = """select question_id, year as "Year", crop as "Crop", state as "State", production as "Production",
  yield as "Yield", annual_rainfall as "Rainfall" from hits"""
put("chart_points", UPTO_HITS + CHART)
put("chart_series", UPTO_HITS + f"""select h.question_id, year as "Year", state as "State", crop as "Crop",
  round(avg(production) + 3e-7, 4) as avg_production, round(avg(yield) + 3e-7, 4) as avg_yield
from hits h join questions q on h.question_id = q.question_id where {any_in('lower(query)', kw.ASK_CHART)} group by 1, 2, 3, 4""")
put("chart_scatter", UPTO_HITS + f"""select h.question_id, annual_rainfall as x, yield as y, crop as color, production as size,
  state as "State", year as "Year"
from hits h join questions q on h.question_id = q.question_id where {any_in('lower(query)', kw.ASK_CHART)}""")
put("unanswered", UPTO_TERMS + f"""select min(question_id) as question_id, query, cast({b.HITS_PER_QUESTION} as bigint) as top_k,
  cast(0.7 as double) as temperature from terms
where query not in (select query from terms where route = 'summary') group by query""")
put("log_queries", TOLD + f"select query, {text(b.CREATED_AT)} as timestamp, substr(answer, 1, 100) || '...' as answer_preview from told")
put("recent_history", "select o_orderpriority || ' ' || cast(o_orderkey as varchar) as query, "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as timestamp, o_orderstatus || '...' as answer_preview "
    "from orders order by timestamp desc, query limit 10")
