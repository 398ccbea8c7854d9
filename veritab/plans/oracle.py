"""The queries again, as DuckDB SQL over the same tables: what the results are checked against."""

from __future__ import annotations

from . import sellout

# Fixed values, stated here a second time: a wrong one in the engine must show.
MONTHS = {
    "ENE": 1, "ENERO": 1, "JAN": 1, "JANUARY": 1,
    "FEB": 2, "FEBRERO": 2, "FEBRUARY": 2,
    "MAR": 3, "MARZO": 3, "MARCH": 3,
    "ABR": 4, "ABRIL": 4, "APR": 4, "APRIL": 4,
    "MAY": 5, "MAYO": 5,
    "JUN": 6, "JUNIO": 6, "JUNE": 6,
    "JUL": 7, "JULIO": 7, "JULY": 7,
    "AGO": 8, "AGOSTO": 8, "AUG": 8, "AUGUST": 8,
    "SEP": 9, "SEPTIEMBRE": 9, "SETIEMBRE": 9, "SEPT": 9, "SEPTEMBER": 9,
    "OCT": 10, "OCTUBRE": 10, "OCTOBER": 10,
    "NOV": 11, "NOVIEMBRE": 11, "NOVEMBER": 11,
    "DIC": 12, "DICIEMBRE": 12, "DEC": 12, "DECEMBER": 12,
}
NO_REGION = [
    "", ".", "..", "/", "0", "00", "X", "XX", "XXX", "?", "NULL", "NULO", "NONE", "NINGUNO", "NO IDENTIFICADO", "NO IDENTIFICADA",
    "NO IDENTIFICADOS", "NO APLICA", "NO DEFINIDO", "NO DISPONIBLE", "NO REGISTRA", "NO INDICA", "N / A", "NA", "N / D", "ND", "S / I", "SI",
    "SD", "SIN ESTADO", "SIN DEFINIR", "SIN IDENTIFICAR", "SIN INFORMACION", "SIN DATOS", "SIN DATO", "SIN ASIGNAR", "SIN CLASIFICAR",
    "POR DEFINIR", "POR ASIGNAR", "PENDIENTE", "DESCONOCIDO", "OTRO", "OTROS", "VARIOS", "GENERICO", "VENEZUELA",
]
NO_CITY = [*NO_REGION, "NAN", "LOCAL", "S / N", "SN", "CIUDAD"]
NO_CATEGORY = [
    "", "/", ".", "0", "X", "NAN", "NULL", "NULO", "NONE", "NINGUNO", "N / A", "NA", "ND", "N / D", "#NAME?", "#N / A", "#REF!", "#VALUE!",
    "#DIV / 0!", "#NULL!", "#NUM!", "#ERROR!", "SIN CLASIFICAR", "SIN DEFINIR", "SIN ASIGNAR", "NO IDENTIFICADO", "POR DEFINIR",
]
FOOTER_START = "^(TOTAL|TOTALES|TOTAL GENERAL|SUMA|SUMATORIA|SUBTOTAL|RESUMEN|PROMEDIO)"
FOOTER_CELL = "^(TOTAL|TOTALES|TOTAL GENERAL|SUMA|SUMATORIA|SUBTOTAL|GRAND TOTAL)$"
OUTPUT = [
    "segmento_n3_std", "macro_canal_n1_std", "metodo_segmento", "confianza_segmento", "estado_std", "metodo_estado", "flag_registro",
    "valor_original_segmento", "valor_original_estado", "version_diccionario", "run_id",
]
TITLES = r"(?:ESTADOS?|EDOS?)\s*(?:DEL?\s+)?"


def q(value) -> str:
    if value is None:
        return "null"
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(name: str, rows: list[tuple], ddl: str) -> str:
    columns = ", ".join(c.strip().split(" ")[0] for c in ddl.split(","))
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)})"


def nt(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(upper(strip_accents(coalesce({x}, ''))), '[/_|-]+', ' / ', 'g'), '\s*/\s*', ' / ', 'g'), '\s+', ' ', 'g'))"


def nid(x: str) -> str:
    return f"regexp_replace(upper(strip_accents(coalesce({x}, ''))), '[^A-Z0-9]+', '', 'g')"


def among(x: str, names: list[str]) -> str:
    return f"{x} in ({', '.join(map(q, names))})"


def clean(x: str) -> str:
    out = rf"regexp_replace({nt(x)}, '\([^)]*\)', ' ', 'g')"
    out = rf"regexp_replace({out}, '^\d{{1,3}}\s*[.\-/]*\s*([A-Z])', '\1')"
    out = rf"regexp_replace({out}, '^(?:ESTADOS?|EDOS?|DTTOS?|DTOS?|DPTOS?)\s*\.?\s*(?:/\s*)?(?:DEL\s+|DE\s+)?(\S)', '\1')"
    out = rf"regexp_replace({out}, '\s*(?:/\s*)?(?:ESTADOS?|EDOS?|VENEZUELA|VZLA)\s*$', '')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def geo(x: str) -> str:
    return f"trim(regexp_replace({nt(x)}, '[^A-Z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return rf"array_to_string(list_sort(list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')), ' ')"


def ratio(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"case when {longest} = 0 then 100 else cast(floor((1 - levenshtein({a}, {b}) / {longest}) * 100 + 0.5) as int) end"


def slug(kind: str, x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"concat(lower({kind}), '-', case when {s} = '' then 'sin-valor' else {s} end)"


def pct(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0.0 else floor(({a}) / ({b}) * 1000 + 0.5) / 10 end"


def r4(x: str, name: str | None = None) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000 as {name or x}"


_MONTH = lambda w: f"case upper({w}) " + " ".join(f"when '{name}' then {m}" for name, m in MONTHS.items()) + " end"


def period(x: str) -> str:
    t = f"trim({x})"
    part = lambda p, i: f"try_cast(nullif(regexp_extract({t}, '{p}', {i}), '') as int)"

    def numeric(p, y, m):
        return f"case when {part(p, y)} between 1990 and 2100 and {part(p, m)} between 1 and 12 then {part(p, y)} * 100 + {part(p, m)} end"

    a, b = r"^([A-Za-z]+)[.\s/-]+(\d{2,4})$", r"^(\d{4})[.\s/-]+([A-Za-z]+)$"
    y = part(a, 2)
    full = f"case when {y} < 50 then 2000 + {y} when {y} < 100 then 1900 + {y} else {y} end"
    word = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    return f"""coalesce({numeric(r'^(\d{4})[-/.](\d{1,2})', 1, 2)}, {numeric(r'^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})', 3, 2)}, {numeric(r'^(\d{1,2})[-/](\d{4})$', 2, 1)},
        {full} * 100 + {_MONTH(word(a, 1))}, case when {part(b, 1)} between 1990 and 2100 then {part(b, 1)} * 100 + {_MONTH(word(b, 2))} end)"""


_TABLES = {t: t for t in sellout.TABLES}
_NAMES = "|".join(sorted((r for r, _ in sellout.REGIONS), key=len, reverse=True))

CATALOGS = ",\n".join(
    [values(f"c_{name}", sellout.DATA[name], ddl) for name, ddl in sellout.DDL.items()]
    + [f"c_aliases as ({sellout.ALIASES.format(**_TABLES)})", f"c_manual as ({sellout.MANUAL.format(**_TABLES)})"]
    + [
        f"""x_cat as (select key, category, category_group, pos from (select *, row_number() over (partition by key order by pos) n from
            (select {nt('variant')} as key, * from c_category_dict where active) where key <> '') where n = 1)""",
        f"""x_reg as (select key, region, pos from (select *, row_number() over (partition by key order by pos) n from
            (select {nt('variant')} as key, {nt('region')} as region, pos from c_region_dict where active) where key <> '' and region <> '') where n = 1)""",
        f"x_regions as (select {nt('region')} as key, min(pos) as pos from c_regions group by 1)",
        f"""x_city as (select key, region from (select *, row_number() over (partition by key order by pos desc) n from
            (select {nt('city')} as key, {nt('region')} as region, pos from c_cities) where key <> '') where n = 1)""",
        f"""a_all as (select concat({nt('source')}, '::', {nt('client_code')}) as key, {nt('client_code')} as code, {nid('entity_id')} as alias_entity, client_name as alias_name,
            k.key as alias_region, a.pos from c_aliases a left join x_regions k on k.key = {nt('a.region')} where active and {nid('entity_id')} <> '')""",
        "a_exact as (select * from (select *, row_number() over (partition by key order by pos) n from a_all where key <> '::') where n = 1)",
        """a_code as (select * from (select *, row_number() over (partition by code order by pos) n, min(alias_entity) over (partition by code) lo, max(alias_entity) over (partition by code) hi
            from a_all where length(code) >= 4 and regexp_matches(code, '[A-Z]')) where n = 1 and lo = hi)""",
    ]
)

ROWS = f"s as ({sellout.ROWS.format(**_TABLES)})"
NUMBERS = r"""n1 as (select row_id, trim(coalesce(measure_raw, '')) as t from s),
n2 as (select *, (t like '(%' and t like '%)' and length(t) > 1) as br from n1),
n3 as (select *, br or t like '-%' as neg, regexp_replace(case when br then regexp_replace(t, '^\(|\)$', '', 'g') else regexp_replace(t, '^-', '') end, '[^0-9.,eE]', '', 'g') as kept from n2),
n4 as (select *, case
    when contains(kept, ',') and contains(kept, '.') and length(regexp_extract(kept, '[^,]*$')) < length(regexp_extract(kept, '[^.]*$')) then regexp_replace(replace(kept, '.', ''), ',', '.')
    when contains(kept, ',') and contains(kept, '.') then replace(kept, ',', '')
    when regexp_matches(kept, '^[^,]{4,},[^,]{3}$') then replace(kept, ',', '')
    when contains(kept, ',') then regexp_replace(kept, ',', '.') else kept end as plain from n3),
n5 as (select row_id, neg, case when regexp_matches(plain, '^(\d+\.?\d*|\.\d+)([eE]\d+)?$') then coalesce(try_cast(plain as double), 0.0) else 0.0 end as number from n4),
nums as (select row_id, case when neg and number <> 0 then -number else number end as parsed, case when number > 100000 then 0.0 when neg and number <> 0 then -number else number end as guarded from n5)"""

_FIELDS = ", ".join(f"coalesce({c}, '') as {c}" for c in ("entity_raw", "client_code", "client_name", "category_raw", "region_raw", "city_raw", "branch", "period_raw", "measure_raw"))


def named(blank_source: bool) -> str:
    source = "f.source" if blank_source else "nullif(f.source, 'SIN_DISTRIBUIDOR')"
    return f"""f as (select s.row_id, case when trim(coalesce(source, '')) = '' then 'SIN_DISTRIBUIDOR' else trim(source) end as source, {_FIELDS}, guarded as measure, {period('period_raw')} as period
    from s join nums using (row_id)),
e0 as (select f.*, a.key is not null as by_a, b.code is not null as by_b, a.alias_entity ae, a.alias_name an, a.alias_region ar, b.alias_entity be, b.alias_name bn, b.alias_region br_
    from f left join a_exact a on {nid('entity_raw')} = '' and f.client_code <> '' and {source} is not null and a.key = concat({nt(source)}, '::', {nt('f.client_code')})
    left join a_code b on {nid('entity_raw')} = '' and f.client_code <> '' and b.code = {nt('f.client_code')}),
e1 as (select * exclude (by_a, by_b, ae, an, ar, be, bn, br_), case when by_a then ae when by_b then be else entity_raw end as entity_id,
    case when by_a then an when by_b then bn end as alias_name, case when by_a then ar when by_b then br_ end as alias_region from e0),
e as (select *, {nid('entity_id')} as entity_key, coalesce(nullif(client_name, ''), alias_name, '') as name,
    {nt('category_raw')} as category_key, {nt('region_raw')} as region_text, {nt('city_raw')} as city_key from e1)"""


RESOLVED = f"""ck as (select distinct category_key as key from e where category_key <> ''),
cf as (select * from (select k.key, x.category fc, x.category_group fg, {ratio(tokens('k.key'), tokens('x.key'))} as score, row_number() over (partition by k.key order by {ratio(tokens('k.key'), tokens('x.key'))} desc, x.pos) n
    from ck k, x_cat x where k.key not in (select key from x_cat)) where n = 1 and score >= 80),
ct as (select k.key as category_key, coalesce(x.category, case when score >= 92 then fc end) as tc, coalesce(x.category_group, case when score >= 92 then fg end) as tg,
    case when x.key is not null then 'EXACTO' when score >= 92 then 'FUZZY' end as tm, case when score < 92 then fc end as suggested_category, case when score < 92 then score end as suggested_category_score
    from ck k left join x_cat x using (key) left join cf using (key)),
rk as (select region_text, {clean('region_text')} as clean from (select distinct region_text from e)),
ru as (select *, clean <> '' and not {among('clean', NO_REGION)} and not {among('region_text', NO_REGION)} as usable, {geo('region_text')} as gt from rk),
rs as (select ru.*, case when usable then coalesce(k.key, a.region, b.region) end as strong_region, case when usable and k.key is not null then 'EXACTO' when usable and coalesce(a.region, b.region) is not null then 'DICCIONARIO' end as strong_method
    from ru left join x_regions k on k.key = clean left join x_reg a on a.key = region_text left join x_reg b on b.key = clean),
gtexts as (select gt from rs where strong_region is null and not {among('region_text', NO_REGION)} union select {geo('city_key')} from e),
gx as (select gt, regexp_extract(gt, '^.*\\b({TITLES}(?:{_NAMES}))\\b', 1) as told from gtexts where length(gt) >= 3),
gp as (select * from (select gt, p.region, row_number() over (partition by gt order by length(p.phrase) desc, p.pos) n from gx,
    (select trim(regexp_replace(phrase, '[^A-Z0-9]+', ' ', 'g')) as phrase, region, pos from c_phrases) p
    where told = '' and (contains(concat(' ', gt, ' '), concat(' ', p.phrase, ' ')) or (length(p.phrase) >= 6 and contains(concat(' ', gt, ' '), concat(p.phrase, ' '))))) where n = 1),
g as (select gt, region from (select gt, case when told <> '' then regexp_replace(told, '^{TITLES}', '') else gp.region end as region from gx left join gp using (gt)) where region in (select key from x_regions)),
cand as (select key, key as "to", pos from x_regions union all select key, region, pos + 1 + (select max(pos) from x_regions) from x_reg where key not in (select key from x_regions)),
rf as (select * from (select k.clean, c."to", {ratio(tokens('k.clean'), tokens('c.key'))} as score, row_number() over (partition by k.clean order by {ratio(tokens('k.clean'), tokens('c.key'))} desc, c.pos) n
    from (select distinct clean from rs where usable and strong_region is null) k, cand c) where n = 1 and score >= 80),
rt as (select rs.*, case when strong_region is null and not {among('region_text', NO_REGION)} then g.region end as geo, "to", case when usable and strong_region is null then score end as score from rs left join g on g.gt = rs.gt left join rf on rf.clean = rs.clean),
cy as (select k.city_key, coalesce(x.region, g.region) as city from (select distinct city_key from e) k left join x_city x on x.key = k.city_key left join g on g.gt = {geo('k.city_key')} where k.city_key <> '' and not {among('k.city_key', NO_CITY)}),
pl as (select region_text, city_key, strong_region, strong_method, coalesce(city, geo, case when score >= 92 then "to" end) as weak_region,
    case when city is not null then 'CIUDAD' when geo is not null then 'DICCIONARIO' when score >= 92 then 'FUZZY' end as weak_method,
    case when strong_region is null and city is null and geo is null and score < 92 then "to" end as sr, case when strong_region is null and city is null and geo is null and score < 92 then score end as srs
    from (select distinct region_text, city_key from e) join rt using (region_text) left join cy using (city_key))"""

OBSERVED = """obs as (select *, {nid} as entity_key from (
    select '' as row_id, entity_id, coalesce(category, '') as category, coalesce(category_group, '') as category_group, 'MANUAL' as method, 9007199254740991 as period, client_name as name, region, '' as branch, '' as city from c_manual
    union all select row_id, entity_id, case when category_method in ('EXACTO', 'FUZZY') then category else '' end, case when category_method in ('EXACTO', 'FUZZY') then category_group else '' end,
        case when category_method in ('EXACTO', 'FUZZY') then category_method end, case when category_method in ('EXACTO', 'FUZZY') then period end, name, region, branch, city_raw
    from {resolved} where category_method in ('EXACTO', 'FUZZY') or region is not null) where {nid} <> '' and (category <> '' or coalesce(region, '') <> '')),
base as (select entity_key, arg_min(entity_id, row_id) as entity_id, arg_min(name, row_id) filter (coalesce(name, '') <> '') as client_name, count(*) as rows from obs group by 1),
modes as (select entity_key, region from (select entity_key, region, row_number() over (partition by entity_key order by count(*) desc, region) n from obs where coalesce(region, '') <> '' group by 1, 2) where n = 1),
cats0 as (select entity_key, category, arg_min(category_group, row_id) as category_group, count(*) as n, max(period) as latest, bool_or(coalesce(method = 'MANUAL', false)) as manual from obs where category <> '' group by 1, 2),
cats1 as (select *, bool_or(manual or upper(category) <> 'OTROS') over (partition by entity_key) as anys from cats0),
cats2 as (select * from cats1 where manual or upper(category) <> 'OTROS' or not anys),
cats as (select *, bool_or(manual) over (partition by entity_key) as hand, (min(category_group) over (partition by entity_key)) <> (max(category_group) over (partition by entity_key)) as several from cats2),
conflicts as (select entity_key, entity_id, client_name, array_to_string(list_sort(list(distinct category_group)), ',') as groups, array_to_string(list_sort(list(distinct category)), ',') as categories,
    array_to_string(list_sort(list(distinct category)), ' vs ') as versus, any_value(base.rows) as rows from cats join base using (entity_key) where several and not hand group by 1, 2, 3),
winner as (select entity_key, category, category_group, case when hand then 'MANUAL' when same > 1 then 'MODA' else 'RECIENTE' end as rule from (select *, count(*) over (partition by entity_key, latest) as same,
    row_number() over (partition by entity_key order by latest desc nulls last, n desc, category) as place from cats where not (several and not hand) and (manual or not hand)) where place = 1),
master as (select entity_key, entity_id, client_name, category, category_group, region, rule from base left join modes using (entity_key) left join winner using (entity_key)
    where entity_key not in (select entity_key from conflicts) and (category is not null or region is not null))"""
OBSERVED = OBSERVED.replace("{nid}", nid("entity_id"))

_FLAG = "case when category_method is null then 'SIN_CLASIFICAR' when region is null then 'SIN_ESTADO' else 'OK' end as row_flag"
RUN = f"""r0 as (select e.*, tc as category, tg as category_group, tm as category_method, suggested_category, suggested_category_score, coalesce(strong_region, weak_region) as region0,
    case when strong_region is not null then strong_method else weak_method end as method0, sr as suggested_region, srs as suggested_region_score
    from e left join ct using (category_key) left join pl using (region_text, city_key)),
r1 as (select * exclude (region0, method0), coalesce(region0, alias_region) as region, case when region0 is null and alias_region is not null then 'RIF' else method0 end as region_method from r0),
r as (select *, {_FLAG} from r1),
{OBSERVED.replace('{resolved}', 'r')},
known as (select entity_key from master where coalesce(category, '') <> '' or coalesce(category_group, '') <> ''),
recovered as (select source, entity_key, count(*) as rows, sum(measure) as measure from r where row_flag = 'SIN_CLASIFICAR' and entity_key in (select entity_key from known) group by 1, 2),
rrecovered as (select entity_key, count(*) as rows from r where region is null and entity_key in (select entity_key from master where region is not null) group by 1)"""


def chain(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


BASIC = chain(CATALOGS, ROWS)
NUMBERED = chain(CATALOGS, ROWS, NUMBERS)
NAMED = chain(CATALOGS, ROWS, NUMBERS, named(True))
FULL = chain(CATALOGS, ROWS, NUMBERS, named(True), RESOLVED, RUN)

_CM, _RM = ["MAESTRO", "EXACTO", "FUZZY"], ["EXACTO", "DICCIONARIO", "RIF", "CIUDAD", "FUZZY"]
_TALLY = ", ".join(
    ["count(*) as rows", "count(*) filter (category_method = 'EXACTO') as raw_exact", "count(*) filter (row_flag <> 'SIN_CLASIFICAR') as resolved", "count(region) as region_valid",
     "count(*) filter (region_method = 'EXACTO') as region_raw_exact", r4("sum(measure)", "measure"), r4("sum(case when row_flag = 'SIN_CLASIFICAR' then measure else 0 end)", "measure_unclassified")]
    + [f"count(*) filter (category_method = '{m}') as category_{m.lower()}" for m in _CM] + ["count(*) filter (category_method is null) as category_sin_clasificar"]
    + [f"count(*) filter (region_method = '{m}') as region_{m.lower()}" for m in _RM] + ["count(*) filter (region_method is null) as region_sin_estado"]
)
_SOURCES = f"""sources as (select t.source, {pct('raw_exact', 'rows')} as raw_quality_pct, {pct('least(resolved + coalesce(back, 0), rows)', 'rows')} as post_quality_pct, {pct('region_raw_exact', 'rows')} as region_raw_pct, rows, measure
    from (select source, {_TALLY} from r group by 1) t left join (select source, sum(rows) as back from recovered group by 1) b on b.source = t.source)"""
_COVER = f"""cover as (select t.* exclude (category_maestro, category_sin_clasificar, region_rif, region_sin_estado, measure_unclassified), raw_present, sources, clients, recovered_rows, recovered_measure, recovered_regions,
    category_maestro + recovered_rows as category_maestro, category_sin_clasificar - recovered_rows as category_sin_clasificar, region_rif + recovered_regions as region_rif, region_sin_estado - recovered_regions as region_sin_estado,
    floor((measure_unclassified - recovered_measure) * 10000 + 0.5) / 10000 as measure_unclassified, {pct('rows - (category_sin_clasificar - recovered_rows)', 'rows')} as classified_pct,
    least(100.0, {pct('rows - (category_sin_clasificar - recovered_rows)', 'raw_present')}) as raw_classified_pct, {pct('region_valid + recovered_regions', 'rows')} as valid_region_pct
    from (select {_TALLY} from r) t, (select count(*) filter (category_key <> '') as raw_present, count(distinct source) as sources, count(distinct nullif({nt('entity_id')}, '')) as clients from r) d,
    (select cast(coalesce(sum(rows), 0) as bigint) as recovered_rows, floor(coalesce(sum(measure), 0) * 10000 + 0.5) / 10000 as recovered_measure from recovered) a, (select cast(coalesce(sum(rows), 0) as bigint) as recovered_regions from rrecovered) b)"""
_PENDING = f"""pending as (select p.entity_key, p.source, p.entity_id, case when coalesce(p.name, '') = '' then 'SIN RAZÓN SOCIAL' else p.name end as client_name, {r4('p.measure', 'measure')}, p.rows,
    p.no_category and coalesce(m.category, '') = '' as no_category, p.no_region and coalesce(m.region, '') = '' as no_region, coalesce(c, m.category, '') as category, coalesce(g, m.region, '') as region
    from (select entity_key, arg_min(source, row_id) as source, arg_min(entity_id, row_id) as entity_id, arg_min(name, row_id) filter (coalesce(name, '') <> '') as name, sum(measure) as measure, count(*) as rows,
        bool_or(category is null) as no_category, bool_or(region is null) as no_region, arg_max(category, row_id) filter (category is not null) as c, arg_max(region, row_id) filter (region is not null) as g
        from r where entity_key <> '' group by 1) p left join master m using (entity_key)
    where (p.no_category and coalesce(m.category, '') = '') or (p.no_region and coalesce(m.region, '') = ''))"""
_QUEUE = rf"""groups_ as (select kind, value, count(*) as rows, {r4('sum(measure)', 'measure')}, min(row_id) as first_row, arg_min(s, row_id) as suggestion, arg_min(n, row_id) as suggestion_score from (
    select case when suggested_category is not null then 'VARIANTE_NUEVA' else 'ALTO_VOLUMEN_SIN_CLASIFICAR' end as kind, category_key as value, measure, row_id, suggested_category as s, suggested_category_score as n from r
      where not {among('category_key', NO_CATEGORY)} and not regexp_matches(category_key, '^[\d\s/.,-]+$') and (suggested_category is not null or row_flag = 'SIN_CLASIFICAR')
    union all select case when suggested_region is not null then 'ESTADO_VARIANTE_NUEVA' else 'ESTADO_SIN_RESOLVER' end, region_text, measure, row_id, suggested_region, suggested_region_score from r
      where region is null and not {among('region_text', NO_REGION)} and not {among(clean('region_text'), NO_REGION)}
    union all select 'CIUDAD_SIN_MAPEAR', city_key, measure, row_id, null, null from r where region is null and not {among('city_key', NO_CITY)}) group by 1, 2),
queue as (select *, case when kind in ('VARIANTE_NUEVA', 'ALTO_VOLUMEN_SIN_CLASIFICAR') then 'SEGMENTO' else 'ESTADO' end as domain, {slug('kind', 'value')} as id, case when kind = 'CIUDAD_SIN_MAPEAR' then rows else measure end as priority from groups_),
ranked as (select *, row_number() over (partition by domain order by priority desc, first_row, kind) as rank from queue)"""


def full(select: str, *more: str) -> str:
    return FULL.rstrip() + "".join(f",\n{m}" for m in more) + "\n" + select


def _export() -> str:
    stage = lambda n, extra, region, master: f"""{n} as (select *, {_FLAG} from (select e.*, {master}, {region} from e left join ct using (category_key) left join pl using (region_text, city_key) {extra}))"""
    plain = "tc as category, tg as category_group, tm as category_method, case when tm is not null then 'N3' end as category_confidence"
    by_master = """case when m.entity_key is not null then m.category else tc end as category, case when m.entity_key is not null then m.category_group else tg end as category_group,
        case when m.entity_key is not null then 'MAESTRO' else tm end as category_method, case when m.entity_key is not null and coalesce(m.category, '') = '' then 'MACRO' when m.entity_key is not null or tm is not null then 'N3' end as category_confidence"""
    region = lambda k: f"coalesce(strong_region, {k}, weak_region) as region, case when strong_region is not null then strong_method when {k} is not null then 'RIF' else weak_method end as region_method"
    seed = f"""seeds as (select entity_key, arg_max(region, {{'b': b, 'p': pos}}) as region from (select {nid('entity_id')} as entity_key, {nt('region')} as region, 0 as b, pos from c_aliases where active
        union all select {nid('entity_id')}, {nt('region')}, 1, 0 from c_manual) where entity_key <> '' and region in (select key from x_regions) group by 1)"""
    said = ", ".join(f"coalesce({v}, '') as {o}" for v, o in zip(["category", "category_group", "category_method", "category_confidence", "region", "region_method", "row_flag", "category_raw", "region_raw"], OUTPUT))
    parts = [
        CATALOGS, ROWS, NUMBERS, named(False), RESOLVED, seed, stage("p1", "left join seeds sd on sd.entity_key = e.entity_key", region("sd.region"), plain), OBSERVED.replace("{resolved}", "p1"),
        "places as (select coalesce(m.entity_key, sd.entity_key) as entity_key, coalesce(m.region, sd.region) as region from (select * from master where region is not null) m full join seeds sd on sd.entity_key = m.entity_key)",
        stage("p2", "left join (select * from master where coalesce(category, '') <> '' or coalesce(category_group, '') <> '') m on m.entity_key = e.entity_key left join places k on k.entity_key = e.entity_key", region("k.region"), by_master),
    ]
    return chain(*parts) + f"select row_id, entity_raw, category_raw, region_raw, city_raw, measure_raw, {said}, 'v1' as version_diccionario, 'run-0' as run_id from p2"


_MERGED = ", ".join(f"({', '.join(map(q, r))})" for r in sellout.LEARNED)
ORACLE = {
    "normalize_text": BASIC + f"select {nt('region_raw')} as normal, count(*) as n from s group by 1",
    "normalize_id": BASIC + f"select row_id, {nid('entity_raw')} as entity_key from s",
    "parse_numeric": NUMBERED + "select row_id, parsed as measure, guarded from nums",
    "parse_period": BASIC + f"select row_id, {period('period_raw')} as period from s",
    "token_sort_ratio": BASIC + f"select key, {ratio(tokens('key'), q('BUILDING CLIENTS'))} as score from (select distinct {nt('category_raw')} as key from s)",
    "slug_id": BASIC + f"select distinct {slug(q('VARIANTE_NUEVA'), nt('category_raw'))} as id from s",
    "clean_region": BASIC + f"select distinct region_raw, {clean('region_raw')} as clean from s",
    "summary_footer_filter": BASIC + f"""select row_id, entity, category_raw from (select row_id, case when row_id like '%7' then 'Total general' else entity_raw end as entity, category_raw from s)
        where not (trim(coalesce(entity, '')) = '' and trim(category_raw) = '') and not regexp_matches({nt("case when trim(coalesce(entity, '')) <> '' then entity else category_raw end")}, '{FOOTER_CELL}')
        and not regexp_matches({nt('entity')}, '{FOOTER_START}')""",
    "text_search": "select c_custkey, c_mktsegment from customer where contains(lower(coalesce(c_name, '')), 'build') or contains(lower(coalesce(c_mktsegment, '')), 'build')",
    "geo_explicit": BASIC + f"""select distinct region_raw, nullif(regexp_replace(regexp_extract({geo('region_raw')}, '^.*\\b({TITLES}(?:{_NAMES}))\\b', 1), '^{TITLES}', ''), '') as region from s""",
    "geo_phrase": BASIC + f"""select text, region from (select text, region, row_number() over (partition by text order by length(phrase) desc, pos) n from (select distinct {geo('city_raw')} as text from s) t,
        (select trim(regexp_replace(phrase, '[^A-Z0-9]+', ' ', 'g')) as phrase, region, pos from c_phrases) p
        where contains(concat(' ', text, ' '), concat(' ', phrase, ' ')) or (length(phrase) >= 6 and contains(concat(' ', text, ' '), concat(phrase, ' ')))) where n = 1""",
    "active_filter": BASIC + "select key, category, category_group, pos from x_cat",
    "duplicate_variants": BASIC + f"select {nt('variant')} as key, count(*) as variants from c_category_dict group by 1 having count(*) > 1",
    "catalog_by_parent": BASIC + "select category_group, string_agg(category, ',' order by pos) as categories, min(pos) as first_pos from c_categories group by 1",
    "dict_merge_override": BASIC.rstrip() + f""", learned(variant, category, category_group, code, method, active, pos) as (values {_MERGED})
        select * from c_category_dict where {nt('variant')} not in (select {nt('variant')} from learned)
        union all select variant, category, category_group, code, method, active, pos + 1 + (select max(pos) from c_category_dict) from learned""",
    "city_lookup": BASIC + f"select k.key, row_id, region from (select row_id, {nt('city_raw')} as key from s) k join x_city x on x.key = k.key where not {among('k.key', NO_CITY)}",
    "dict_exact": BASIC + f"select k.key, row_id, category, category_group from (select row_id, {nt('category_raw')} as key from s) k join x_cat x on x.key = k.key",
    "dict_fuzzy": BASIC + f"""select key, candidate, score from (select *, row_number() over (partition by key order by score desc, pos) n from (select k.key, x.key as candidate, {ratio(tokens('k.key'), tokens('x.key'))} as score, x.pos
        from (select distinct {nt('category_raw')} as key from s) k, x_cat x where k.key <> '')) where n = 1 and score >= 80""",
    "alias_exact": NAMED + "select row_id, entity_id, alias_name, alias_region from e where alias_name is not null",
    "alias_code_unique": BASIC + "select code as key, alias_entity, alias_region from a_code",
    "effective_id": NAMED + "select row_id, entity_key, name from e",
    "segment_cascade": full("select row_id, category, category_group, category_method, suggested_category, suggested_category_score from r"),
    "fuzzy_suggest_band": full("select row_id, suggested_category, suggested_category_score from r where suggested_category is not null"),
    "region_cascade": full("select row_id, region, region_method, suggested_region, suggested_region_score from r"),
    "row_flag": full("select row_flag, count(*) as n from r group by 1"),
    "master_segment_winner": full("select entity_key, entity_id, client_name, category, category_group, rule from master"),
    "master_mode_region": full("select entity_key, region from master where region is not null"),
    "master_conflicts": full("select entity_key, entity_id, groups, categories, rows from conflicts"),
    "master_catch_all_demotion": full("select entity_key, category, rule from master where entity_key in (select entity_key from r where category = 'OTROS')"),
    "master_branches": full("select entity_key, branch, region, city, count(*) as branch_rows from obs where coalesce(region, '') <> '' group by 1, 2, 3, 4"),
    "segment_recovery": full(f"select source, entity_key, rows, {r4('measure')} from recovered"),
    "region_recovery": full("select entity_key, rows from rrecovered"),
    "distributor_metrics": full(f"select source, {_TALLY} from r group by 1"),
    "totals": full(f"select {_TALLY} from r"),
    "metrics_rollup": full(f"select source, {_TALLY} from r group by rollup (source)"),
    "method_tally": full("select category_method, region_method, count(*) as n from r group by 1, 2"),
    "distributor_quality": full("select * from sources", _SOURCES),
    "coverage": full("select * from cover", _COVER),
    "distinct_counts": BASIC + f"select count(*) as rows, count(distinct case when trim(coalesce(source, '')) = '' then 'SIN_DISTRIBUIDOR' else trim(source) end) as sources, count(distinct nullif({nt('entity_raw')}, '')) as clients from s",
    "quality_mix": full("select floor(avg(raw_quality_pct) * 10 + 0.5) / 10 as avg_raw, floor(avg(post_quality_pct) * 10 + 0.5) / 10 as avg_post, floor((avg(post_quality_pct) - avg(raw_quality_pct)) * 10 + 0.5) / 10 as gain from sources", _SOURCES),
    "queue_groups": full("select kind, value, rows, measure, suggestion, suggestion_score from groups_", _QUEUE),
    "queue_topk_per_domain": full("select id, domain, kind, value, rows, cast(rank as int) as rank from ranked where rank <= 10", _QUEUE),
    "conflict_merge": full("""select id, domain, kind, value, rows, suggestion, suggestion_score, detail from (
        select id, domain, kind, value, rows, suggestion, suggestion_score, cast(null as varchar) as detail, 0 as section, -priority as o, first_row from ranked where rank <= 150
        union all select """ + slug("'CONFLICTO_MAYOR'", "entity_id") + """, 'SEGMENTO', 'CONFLICTO_MAYOR', entity_id, rows, null, null, nullif(concat_ws(' · ', nullif(client_name, ''), versus), ''), 1, -rows, entity_key from conflicts)
        order by section, o, first_row, kind limit 400""", _QUEUE),
    "pending_clients": full("select * from pending", _PENDING),
    "audit_checks": full("""select unnest(['segment-balance', 'state-balance', 'percentage-range', 'review-bound']) as check_id,
        unnest([c = rows, g = rows, fine, reviews <= rows]) as passed, unnest([cast(rows as varchar), cast(rows as varchar), '0..100', cast(rows as varchar)]) as expected,
        unnest([cast(c as varchar), cast(g as varchar), case when fine then '0..100' else 'out' end, cast(reviews as varchar)]) as actual
        from (select rows, category_maestro + category_exacto + category_fuzzy + category_sin_clasificar as c, region_exacto + region_diccionario + region_rif + region_ciudad + region_fuzzy + region_sin_estado as g,
            classified_pct between 0 and 100 and raw_classified_pct between 0 and 100 and valid_region_pct between 0 and 100 as fine, (select count(*) from pending) as reviews from cover)""", _COVER, _PENDING),
    "export_base": _export(),
}
