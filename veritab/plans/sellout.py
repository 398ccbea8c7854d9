"""A dirty sell-out view over the star schema, with its catalogs.

The statements keep to what Spark SQL and DuckDB share, so that tests and checks read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import Config
from .stages import small

TABLES = ["nation", "customer", "supplier", "orders", "lineitem"]
_KEY = "cast(c_custkey as string)"
_ID8 = f"lpad({_KEY}, 8, '0')"


def _region(key: str) -> str:
    """A region's name from a nation's number; any two names are two edits apart or more."""
    two = f"lpad(cast({key} as string), 2, '0')"
    tens, units = f"translate(substr({two}, 1, 1), '012', 'MNR')", f"translate(substr({two}, 2, 1), '0123456789', 'BCDFGLPSTV')"
    return f"concat({tens}, 'ORA', {units}, 'ELIA ', {units}, 'UNTO ', {tens}, 'IS')"


def _city(key: str) -> str:
    two = f"lpad(cast({key} as string), 2, '0')"
    return f"concat('CITY ', translate({two}, '0123456789', 'ABCDEFGHIJ'))"


def region_name(n: int) -> str:
    tens, units = "MNR"[n // 10], "BCDFGLPSTV"[n % 10]
    return f"{tens}ORA{units}ELIA {units}UNTO {tens}IS"


def city_name(n: int) -> str:
    return "CITY " + "".join("ABCDEFGHIJ"[int(d)] for d in f"{n:02d}")


ROWS = f"""
select concat(lpad(cast(l_orderkey as string), 12, '0'), lpad(cast(l_linenumber as string), 2, '0'), lpad(cast(l_partkey as string), 10, '0'),
              lpad(cast(l_suppkey as string), 10, '0'), lpad(cast(cast(round(l_extendedprice * 100) as bigint) as string), 14, '0'), substr(cast(l_shipdate as string), 1, 10)) as row_id,
  case when k = 11 then '' else s_name end as source,
  case k when 0 then concat('J-', {_ID8}) when 1 then concat('j-', substr({_ID8}, 1, 2), '.', substr({_ID8}, 3, 3), '.', substr({_ID8}, 6, 3))
         when 2 then concat('j', {_ID8}) when 3 then '' when 7 then cast(null as string) else concat('J', {_ID8}) end as entity_raw,
  concat('CLI-', {_KEY}) as client_code,
  case when k = 6 then '' else c_name end as client_name,
  case k when 1 then lower(label) when 2 then concat('  ', label, '  ') when 3 then concat(substr(label, 1, 5), 'X', substr(label, 7))
         when 4 then concat('CLIENTS ', c_mktsegment) when 5 then '' when 6 then '#REF!' when 7 then '12 / 5' when 8 then concat(substr(label, 1, 3), 'XYZ', substr(label, 7))
         when 9 then case when c_custkey % 2 = 0 then 'OTROS' else 'SOMETHING ELSE' end
         when 10 then case when c_custkey % 3 = 0 then 'BUILDING CLIENTS' else label end else label end as category_raw,
  case k when 1 then concat('EDO. ', region) when 2 then concat('13 ', region) when 3 then 'N/A' when 4 then concat(substr(region, 1, 9), 'Q', substr(region, 11)) when 5 then ''
         when 6 then lower(region) when 7 then concat('VAR ', cast(c_nationkey as string)) when 8 then concat(substr(region, 1, 9), 'QQQ', substr(region, 13))
         when 9 then concat('AV 5 EDO ', region) when 10 then 'XYZZY' when 11 then concat(region, ' / VENEZUELA') else region end as region_raw,
  case when k = 5 and c_custkey % 2 = 0 then '' when k = 10 and c_custkey % 50 > 40 then 'CALLE 3 PLAZA NORTE' else city end as city_raw,
  concat('SUC-', cast(l_linenumber as string)) as branch,
  case k % 5 when 0 then concat(yyyy, '-', mm, '-15') when 1 then concat('15/', mm, '/', yyyy) when 2 then concat(mm, '/', yyyy)
         when 3 then concat(substr('ENEFEBMARABRMAYJUNJULAGOSEPOCTNOVDIC', cast(mm as int) * 3 - 2, 3), '-', substr(yyyy, 3, 2)) else 'S/F' end as period_raw,
  case k when 0 then concat(q, ',50') when 1 then concat('1.', lpad(q, 3, '0'), ',25') when 2 then concat('(', q, '.5)') when 3 then concat('1,', lpad(q, 3, '0'), '.5') when 4 then concat(q, ' TON')
         when 5 then '' when 6 then '9999999' when 7 then concat('1234,', lpad(q, 3, '0')) else q end as measure_raw
from (
  select l.*, s_name, c_custkey, c_name, c_mktsegment, c_nationkey, (l_orderkey * 7 + l_linenumber) % 12 as k, concat(c_mktsegment, ' CLIENTS') as label, {_region('c_nationkey')} as region,
    {_city('c_custkey % 50')} as city, cast(cast(l_quantity as int) as string) as q, cast(extract(year from l_shipdate) as string) as yyyy, lpad(cast(extract(month from l_shipdate) as string), 2, '0') as mm
  from {{lineitem}} l join {{orders}} o on l_orderkey = o_orderkey join {{customer}} c on o_custkey = c_custkey join {{supplier}} s on l_suppkey = s_suppkey) x
"""
ALIASES = f"""
select 'ANY SOURCE' as source, concat('CLI-', {_KEY}) as client_code, concat('J-', {_ID8}) as entity_id, c_name as client_name,
  case when c_custkey % 14 = 0 then {_region('c_nationkey')} when c_custkey % 21 = 0 then 'NOWHERE' end as region, c_custkey % 49 <> 0 as active, c_custkey as pos
from {{customer}} where c_custkey % 7 = 0
union all
select 'Supplier#000000001', concat('CLI-', {_KEY}), concat('J-9', {_ID8}), '', cast(null as string), true, 10000000 + c_custkey from {{customer}} where c_custkey % 11 = 0
"""
MANUAL = f"""
select concat('J', {_ID8}) as entity_id, c_name as client_name, 'N3 BUILDING' as category, 'CASA' as category_group, case when c_custkey % 2 = 0 then {_region('c_nationkey')} end as region
from {{customer}} where c_custkey % 37 = 0
"""

GROUPS = {"AUTOMOBILE": "MOVIL", "MACHINERY": "MOVIL", "BUILDING": "CASA", "FURNITURE": "CASA", "HOUSEHOLD": "HOGAR"}
CATEGORIES = [(f"N3 {s}", g, i) for i, (s, g) in enumerate(GROUPS.items())] + [("OTROS", "RESTO", 5)]
CATEGORY_DICT = [(f"{s} CLIENTS", f"N3 {s}", g, f"C{i}", "SEED", True, i) for i, (s, g) in enumerate(GROUPS.items())] + [
    ("Otros", "OTROS", "RESTO", "C5", "SEED", True, 5),
    ("something else", "OTROS", "RESTO", "C5", "SEED", False, 6),
    ("Búilding  clients", "N3 FURNITURE", "CASA", "C3", "SEED", True, 7),
]
REGIONS = [(region_name(n), n) for n in range(24)]
REGION_DICT = [(f"VAR {n}", region_name(n).lower(), n % 5 != 4, n) for n in range(20)]
CITIES = [(city_name(n), region_name(n % 24), n) for n in range(30)] + [(city_name(3).lower(), region_name(5), 30)]
PHRASES = [("PLAZA", region_name(1), 0), ("PLAZA NORTE", region_name(2), 1), ("NORTEÑA", region_name(3), 2)]
LEARNED = [("machinery clients", "N3 HOUSEHOLD", "HOGAR", "C4", "MANUAL", True, 0), ("something new", "OTROS", "RESTO", "C5", "MANUAL", True, 1)]

DDL = {
    "categories": "category string, category_group string, pos int",
    "category_dict": "variant string, category string, category_group string, code string, method string, active boolean, pos int",
    "regions": "region string, pos int",
    "region_dict": "variant string, region string, active boolean, pos int",
    "cities": "city string, region string, pos int",
    "phrases": "phrase string, region string, pos int",
}
DATA = {"categories": CATEGORIES, "category_dict": CATEGORY_DICT, "regions": REGIONS, "region_dict": REGION_DICT, "cities": CITIES, "phrases": PHRASES}


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = [t for t in TABLES if f"{{{t}}}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ROWS)


def config(spark: SparkSession, sf_dir: str) -> Config:
    frames = {name: small(spark, DATA[name], ddl) for name, ddl in DDL.items()}
    return Config(**frames, aliases=_sql(spark, sf_dir, ALIASES), manual=_sql(spark, sf_dir, MANUAL), explicit={r: r for r, _ in REGIONS})
