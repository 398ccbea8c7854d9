"""Units: functions, header detection, files, stores, audit, runs and the stream."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veritab.functions import dates, numeric, text
from veritab.operators import catalog, fuzzy, quality
from veritab.plans import run, sellout
from veritab.sources import csv, headers, seeds, store, template, xlsx


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_text(spark):
    got = one(spark, text.normalize_text, "Panadería/Pastelería", "  a  b ", None, "Ñandú__x|y", "Straße")
    assert got == ["PANADERIA / PASTELERIA", "A B", "", "NANDU / X / Y", "STRASSE"]
    assert one(spark, text.normalize_text, *got) == got


def test_normalize_id(spark):
    assert one(spark, text.normalize_id, "J-500.522.657", "j-500522657", None, "é-1") == ["J500522657", "J500522657", "", "E1"]


def test_parse_numeric(spark):
    cases = {"1.234,56": 1234.56, "12,50": 12.5, "1,234.56": 1234.56, "12.5 TON": 12.5, "Bs. 1.500,00": 1500.0, "(120.50)": -120.5, "": 0.0, "1,000": 1.0, "1234,567": 1234567.0, "1.234.567": 0.0, "Bs. 500": 0.5, "5 UNIDADES": 0.0, "-3": -3.0, "1e3": 1000.0}
    assert one(spark, numeric.parse_numeric, *cases, None) == [*cases.values(), 0.0]


def test_guard_and_pct(spark):
    df = spark.sql("select explode(array(double('NaN'), double('Infinity'), 100001d, 100000d, -5d)) as x")
    assert [r[0] for r in df.select(numeric.guard_measure(F.col("x"))).collect()] == [0, 0, 0, 100000, -5]
    assert spark.range(1).select(numeric.pct1(F.lit(1), F.lit(3)), numeric.pct1(F.lit(1), F.lit(0))).first()[:] == (33.3, 0.0)


def test_parse_period(spark):
    good = ["OCT-25", "Octubre 2025", "2025-10-15", "15/10/2025", "10/2025", "2025/10", "Oct/25", "OCT. 25", "2025-Oct"]
    assert one(spark, dates.parse_period, *good) == [202510] * len(good)
    assert one(spark, dates.parse_period, "45946", "", None, "13/2025", "FOO-25", "ENE-75") == [None] * 5 + [197501]
    assert spark.range(1).select(dates.period_of_serial(F.lit(45946.0)), dates.period_of_serial(F.lit(12.0))).first()[:] == (202510, None)


def test_ratio(spark):
    f = lambda a, b: spark.range(1).select(text.token_sort_ratio(F.lit(a), F.lit(b))).first()[0]
    assert f("ABC", "ABC") == 100 and f("A B C", "C  A B") == 100 and f("", "") == 100 and f("ABCDEFGHIJ", "ABCDEFGHIX") == 90


def test_best_match_ties_and_floor(spark):
    keys = spark.createDataFrame([("ABCDEFGHIJ",), ("ZZZ",)], "key string")
    cands = spark.createDataFrame([("ABCDEFGHIX", 1), ("ABCDEFGHIY", 0), ("Q", 2)], "candidate string, pos int")
    assert [r[:] for r in fuzzy.best_match(keys, cands).collect()] == [("ABCDEFGHIJ", "ABCDEFGHIY", 90)]


def test_clean_region(spark):
    got = one(spark, text.clean_region, "EDO. MIRANDA", "13 / ZULIA", "ESTADO DEL ZULIA", "ESTADO", "ZULIA (OCCIDENTE)", "LARA VZLA", "EDO / MIRANDA")
    assert got == ["MIRANDA", "ZULIA", "ZULIA", "", "ZULIA", "LARA", "MIRANDA"]


def test_headers():
    names = ["Nro. RIF", "Sub-Canal", "Edo", "Parroquia", "Mayorista", "Nombre del cliente", "Periodo", "Peso neto"]
    got = headers.evaluate(names).roles
    assert [got[r] for r in ("entity_raw", "category_raw", "region_raw", "city_raw", "source", "client_name", "period_raw", "measure_raw")] == names
    rows = [["Informe de ventas", "2024"], [], ["", "x"], ["cod_cliente", "rif", "giro", "provincia", "sector", "dist", "tons"], ["C1", "J-1", "Bodega", "Lara", "Este", "D", "2"]]
    found = headers.find(rows)
    assert found.row == 3 and found.roles["source"] == "dist" and found.roles["client_code"] == "cod_cliente" and headers.is_data_sheet(found.roles)
    assert headers.find([["a", "b"]]) is None
    assert headers.core_roles(["ESTATUS FACTURA", "Count of RIF"])[0] == {}


SHEET = [["Letterhead"], [], ["DISTRIBUIDOR", "RIF", "CLIENTE", "Tipo de Tienda", "Estado", "TON"], ["D1", "J-1", "Ána", "BUILDING CLIENTS", "X", "1,5"], ["D1", "J-2", 'say "hi", ok', "Otros", "", "007"], ["", "TOTAL GENERAL", "", "", "", "9"], ["", "", "", "", "", ""]]


def test_csv(spark, tmp_path):
    lines = [",".join('"' + c.replace('"', '""') + '"' for c in row) for row in SHEET]
    (tmp_path / "a.csv").write_text("\r\n".join(lines))
    df, layout = csv.read(spark, str(tmp_path / "a.csv"))
    got = csv.roles(df, layout).orderBy("row_id").collect()
    assert [(r.entity_raw, r.client_name, r.measure_raw) for r in got] == [("J-1", "Ána", "1,5"), ("J-2", 'say "hi", ok', "007")]
    csv.write(df.drop("row_id").coalesce(1), str(tmp_path / "out"))
    again, _ = csv.read(spark, str(tmp_path / "out"))
    assert sorted(r[1:] for r in again.collect()) == sorted(r[1:] for r in df.collect())
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="BAD_SCHEMA"):
        csv.read(spark, str(tmp_path / "b.csv"))


def test_csv_folder(spark, tmp_path):
    """Every file's letterhead and header go; quoted line breaks and files of plain lines."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("Carta\nRIF,CLIENTE,Estado\nJ-1,Uno,Lara\n")
    (folder / "b.csv").write_text("RIF,CLIENTE,Estado\nJ-2,Dos,Zulia\nJ-3,Tres,Lara\n")
    df, _ = csv.read(spark, str(folder))
    assert [r[1:] for r in df.orderBy("row_id").collect()] == [("J-1", "Uno", "Lara"), ("J-2", "Dos", "Zulia"), ("J-3", "Tres", "Lara")]
    (folder / "c.csv").write_text('RIF,CLIENTE,Estado\nJ-4,"Cua\ntro",Zulia\n')
    df, _ = csv.read(spark, str(folder))
    assert [r.CLIENTE for r in df.orderBy("row_id").collect()] == ["Uno", "Dos", "Tres", "Cua\ntro"]
    (folder / "d.csv").write_text("x,y,z\n1,2,3\n")
    with pytest.raises(ValueError, match="d.csv has no header"):
        csv.read(spark, str(folder))
    big = tmp_path / "big.csv"
    big.write_text("RIF,CLIENTE,Estado\n" + "".join(f"J-{i},Cliente {i},Lara\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df, _ = csv.read(spark, str(big))
        assert df.rdd.getNumPartitions() > 1 and [r.RIF for r in df.orderBy("row_id").collect()] == [f"J-{i}" for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_three_sheets_are_read_apart(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "three.xlsx")
    with open(path, "wb") as f:
        xlsx.write_rows(f, ["RIF", "CLIENTE", "Estado"], iter([[f"J-{i}", f"C{i}", "Lara"] for i in range(5)]), max_rows=3)
    assert [xlsx.read_cells(spark, path, sheet=i).count() for i in range(3)] == [3, 3, 2]
    assert xlsx.read_cells(spark, path, limit=1).count() == 3
    sheets = xlsx.read(spark, path)
    assert [[r.RIF for r in df.orderBy("row_id").collect()] for df, _ in sheets] == [["J-0", "J-1"], ["J-2", "J-3"], ["J-4"]]
    assert [df.select("RIF").rdd.getNumPartitions() for df, _ in sheets] == [1, 1, 1]


def test_store_switch(spark, tmp_path):
    """A reader between the steps of a write sees the old state, also after a crash before the switch."""
    s = store.Store(spark, f"file://{tmp_path}/s")
    row = ("A", "Lara", True, 0)
    s.replace("region_dict", spark.createDataFrame([row], s.tables["region_dict"][0]))
    switch, seen = s._switch, []
    s._switch = lambda name, version: (seen.append(s.read(name).count()), switch(name, version))
    s.replace("region_dict", spark.createDataFrame([row, ("B", "Zulia", True, 1)], s.tables["region_dict"][0]))
    assert seen == [1] and s.read("region_dict").count() == 2

    def crash(name, version):
        raise OSError

    s._switch = crash
    with pytest.raises(OSError):
        s.replace("region_dict", spark.createDataFrame([], s.tables["region_dict"][0]))
    assert s.read("region_dict").count() == 2


def test_seed_catalogs(spark, tmp_path):
    """A run with the seeds stated in the code and files beside them."""
    (tmp_path / "region_dict.csv").write_text("variant,region\nCaracas,DISTRITO CAPITAL\n")
    (tmp_path / "category_dict.csv").write_text('variant,category\n"Bodeguita, la",Bodegas\nX,Unknown\n')
    config = seeds.config(spark, f"file://{tmp_path}")
    assert config.categories.count() == 14 and config.regions.count() == 24 and config.cities.count() == 0
    texts = ["EDO. N. ESPARTA", "Edo. La Guaira", "caracas", "AV 5 DTTO CAPITAL", "ESTADO DELTA", "13 - ZULIA", "ESTADO ANZ", "nowhere at all"]
    rows = [(str(i), "D", f"J-{i}", "", "n", "bodeguita, LA" if i else "Otros", t, "", "", "", "1") for i, t in enumerate(texts)]
    names = "row_id source entity_raw client_code client_name category_raw region_raw city_raw branch period_raw measure_raw".split()
    got = run.pipeline(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), config).resolved.orderBy("row_id").collect()
    assert [r.region for r in got] == ["NUEVA ESPARTA", "VARGAS", "DISTRITO CAPITAL", "DISTRITO CAPITAL", "DELTA AMACURO", "ZULIA", "ANZOATEGUI", None]
    assert [r.category for r in got] == [None] + ["Bodegas"] * 7
    assert {c for c, *_ in seeds.CATEGORIES} >= set(seeds.LEGACY.values()) and len(seeds.LEGACY) == 37


def test_store_upgrade(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert (s.upgrade(), s.upgrade()) == (0, store.VERSION)
    assert {r.name: r.entries for r in s.counts().collect()} == {n: int(n == "meta") for n in s.tables}


def test_xlsx_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    with open(path, "wb") as f:
        assert xlsx.write_rows(f, SHEET[2], iter(SHEET[3:5] * 3), max_rows=4) == 2
    sheets = xlsx.read(spark, path)
    assert [s.count() for s, _ in sheets] == [3, 3]
    both = csv.union_sheets([s for s, _ in sheets])
    assert both.where("TON = '007'").count() == 3 and both.where("CLIENTE = 'Ána'").count() == 3
    a, b = io.BytesIO(), io.BytesIO()
    xlsx.write_rows(a, ["x"], iter([["1"]]))
    xlsx.write_rows(b, ["x"], iter([["1"]]))
    assert a.getvalue() == b.getvalue()


def test_xlsx_parts():
    assert [xlsx.column_index(c) for c in ("A", "Z", "AA", "BC")] == [0, 25, 26, 54] and xlsx.column_letters(54) == "BC"
    assert xlsx.kind_of("a.XLS") == "xlsx" and xlsx.kind_of("a.csv") == "csv" and xlsx.kind_of("a.txt") is None and not xlsx.is_zip(b"\xd0\xcf")
    assert xlsx.cell_xml("12.5") == "<c><v>12.5</v></c>" and "inlineStr" in xlsx.cell_xml("007") and "inlineStr" in xlsx.cell_xml("1" * 16)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>a</t></r><r><t>b &amp; c</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="s"><v>0</v></c><c><v> 5 </v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(data) as z:
        (_, entry), = xlsx.sheets(z)
        assert list(xlsx.rows(z, entry, xlsx.shared_strings(z))) == [["", "ab & c", "5"]]


@pytest.fixture(scope="session")
def config(spark, sf):
    return sellout.config(spark, sf)


def test_store(spark, tmp_path, config):
    s = store.Store(spark, str(tmp_path / "learned"))
    assert s.read("cities").count() == 0
    store.decide(s, "VARIANTE_NUEVA", "Machinéry  x", "OTROS", config.categories, config.regions)
    store.decide(s, "VARIANTE_NUEVA", "MACHINERY X", "N3 MACHINERY", config.categories, config.regions)
    assert [(r.variant, r.category, r.category_group) for r in s.read("category_dict").collect()] == [("MACHINERY X", "N3 MACHINERY", "MOVIL")]
    store.decide(s, "CIUDAD_SIN_MAPEAR", "CITY ZZ", sellout.region_name(1), config.categories, config.regions)
    with pytest.raises(ValueError):
        store.decide(s, "CIUDAD_SIN_MAPEAR", "CITY ZZ", "NOWHERE", config.categories, config.regions)
    assert {r.name: r.entries for r in s.counts().collect()}["cities"] == 1
    s.delete("cities", spark.createDataFrame([("CITY ZZ",)], "key string"))
    assert s.read("cities").count() == 0
    s.wipe()
    assert s.read("category_dict").count() == 0


def test_imports(spark, config):
    df = spark.createDataFrame([("a", "OTROS"), ("b", "nope")], "Variant string, Category string")
    entries, counts = store.import_dictionary(df, config.categories)
    assert counts.first()[:] == (1, 1) and entries.first().category_group == "RESTO"
    legacy = spark.createDataFrame([("old", "OTROS")], "old string, new string")
    rows = spark.createDataFrame([("OTROS",), ("old",), ("gone",)], "category string")
    assert sorted(str(r[0]) for r in catalog.migrate_codes(rows, legacy, config.categories).collect()) == ["None", "OTROS", "OTROS"]
    assert catalog.check_thresholds(120, 10) == (100, 50) and catalog.check_thresholds(40, 80.4) == (80, 80)


@pytest.fixture(scope="session")
def result(spark, sf, config):
    return run.pipeline(sellout.rows(spark, sf), config)


def test_template_loop(spark, result, config):
    t = template.template(result.pending).collect()
    assert t and {r.Falta for r in t} <= {"Segmento", "Estado", "Segmento y estado"}
    rows = [["title"], ["Distribuidor", "RIF", "Razón Social", "Falta", "Tipo de Tienda", "Estado"], *[[r.Distribuidor, r.RIF, r["Razón Social"], r.Falta, "otros", ""] for r in t[:2]], ["x", "", "", "", "", ""]]
    cells = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "line int, cells array<string>")
    got = template.merge(template.parse(cells, template.find_header(rows)), config.manual, config.categories, config.regions).collect()
    assert [r.category for r in got] == ["OTROS"] * 2 and [r.category_group for r in got] == ["RESTO"] * 2


def test_manifest_and_comparison(spark, result):
    summary = result.summary.withColumn("unresolved_clients", F.lit(3).cast("long"))
    about = {"run_id": "run-1", "file_name": "f.csv", "bytes": 10}
    js = quality.manifest(summary, result.checks, **about).first()[0]
    assert len(json.loads(js)["checks"]) == 4 and all(c["passed"] for c in json.loads(js)["checks"])
    snap = quality.read_snapshot(spark, js)
    other = quality.read_snapshot(spark, quality.manifest(summary, result.checks, **about | {"run_id": "run-2", "bytes": 11}).first()[0])
    got = quality.compare(other, snap).first()
    assert (got.current_run_id, got.previous_run_id, got.same_source, got.rows_delta) == ("run-2", "run-1", False, 0)
    for bad in ("{}", json.dumps({"schema_version": 1}), "[]"):
        with pytest.raises(ValueError):
            quality.read_snapshot(spark, bad)
    with pytest.raises(ValueError):
        quality.read_snapshot(spark, js, limit=5)


def test_stream_equals_batch(spark, sf, config, result, tmp_path):
    from veritab.streaming.batches import resolve_stream

    rows = sellout.rows(spark, sf)
    rows.write.parquet(f"{tmp_path}/in")
    sink = lambda df, n: df.select("row_id", "category", "region", "row_flag").write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")
    q = resolve_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), config, sink, f"{tmp_path}/cp")
    q.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").drop("n")
    want = result.resolved.select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_rows_without_alias_key_are_dealt_evenly(spark, monkeypatch):
    """Where the aliases are too many to send to every task, rows that need none don't meet in one."""
    from pyspark.sql import functions as F

    from veritab.operators import entity
    from veritab.plans import sellout, stages

    monkeypatch.setattr(stages, "SMALL_ROWS", -1)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        names = ["source", "entity_raw", "client_code", "client_name", "category_raw", "region_raw", "city_raw", "branch", "period_raw", "measure_raw"]
        rows = spark.range(1000).select(F.col("id").cast("string").alias("row_id"), *[F.lit("J-12345678" if n == "entity_raw" else "").alias(n) for n in names])
        out = entity.with_entity(entity.with_fields(rows), sellout.config(spark, "/root/testdata/sf0.001"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and max(sizes) < 500


def test_lookup_sends_small_tables_only(spark, monkeypatch):
    from veritab.plans import stages

    rows = spark.createDataFrame([("a", "x" * 100), ("b", None)], "k string, v string")
    hinted = lambda df: "hint" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(stages.lookup(rows))
    monkeypatch.setattr(stages, "SMALL_BYTES", 100)
    assert not hinted(stages.lookup(rows))
    monkeypatch.setattr(stages, "SMALL_BYTES", 1000)
    monkeypatch.setattr(stages, "SMALL_ROWS", 1)
    assert not hinted(stages.lookup(rows))


def test_plain_digits_and_their_neighbours(spark):
    from pyspark.sql import functions as F

    from veritab.functions.dates import parse_period
    from veritab.functions.numeric import guard_measure, parse_numeric

    texts = [("7", 7.0), ("007", 7.0), ("1234567890123456", 1234567890123456.0), ("7\n", 7.0), ("", 0.0), ("1e999", 0.0), ("-5", -5.0), ("12 TON", 12.0)]
    got = spark.createDataFrame(texts, "t string, want double").select("want", parse_numeric(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    guarded = spark.createDataFrame([(float("nan"), 0.0), (float("inf"), 0.0), (None, 0.0), (100000.0, 100000.0), (-100000.5, 0.0)], "m double, want double")
    assert [r.got for r in guarded.select(guard_measure(F.col("m")).alias("got")).collect()] == [0.0, 0.0, 0.0, 100000.0, 0.0]
    # no cast that throws and catches an error for each row that a pattern doesn't fit
    frame = spark.createDataFrame([("S/F",), ("OCT-25",)], "t string").select(parse_period(F.col("t")).alias("p"), parse_numeric(F.col("t")))
    assert "try_cast" not in frame._jdf.queryExecution().analyzed().toString().lower()
    assert [r.p for r in frame.collect()] == [None, 202510]


def test_sheets_of_one_layout_are_one_scan(spark, tmp_path):
    """However many they are; each row of theirs comes out once."""
    path = str(tmp_path / "many.xlsx")
    with open(path, "wb") as f:
        data = [["J-0", "C0", "Lara"], ["J-1", "C1", "Zulia"], ["J-2", "C2", "Lara"], ["J-3", "C3", ""], ["J-4", "C4", "Lara"]]
        xlsx.write_rows(f, ["RIF", "CLIENTE", "Estado"], iter(data), max_rows=3)
    got = xlsx.read_alike(spark, path)
    assert len(xlsx.read(spark, path)) == 3 and len(got) == 1
    frame, layout = got[0]
    assert frame.rdd.getNumPartitions() == 3 and layout.row == 0
    one = csv.union_sheets([df.drop("row_id") for df, _ in xlsx.read(spark, path)])
    assert sorted(frame.drop("row_id").collect()) == sorted(one.collect()) and frame.select("row_id").distinct().count() == 5


def test_source_is_read_once(spark, sf, config, tmp_path):
    """What a run gives is read from the rows that it wrote, not from the source again."""
    sellout.rows(spark, sf).limit(500).write.parquet(f"{tmp_path}/in")
    result = run.pipeline(spark.read.parquet(f"{tmp_path}/in"), config)
    frames = [result.resolved, result.master, result.branches, result.recovered, result.pending]
    assert result.resolved.count() == 500
    assert not [f for df in frames for f in df.inputFiles() if str(tmp_path) in f]


def test_patterns_are_not_copied(spark):
    """One removal of other signs for texts with a comma, one for those without."""
    df = spark.createDataFrame([("1.5",)], "m string").select(numeric.parse_numeric(F.col("m")).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[^0-9.,eE]") == 2


@pytest.mark.parametrize("name, reads, others", [
    ("segment_cascade", "category_raw", ["region_raw", "city_raw", "measure_raw"]), ("region_cascade", "region_raw", ["category_raw", "measure_raw", "period_raw"]),
])
def test_one_field_writes_no_rows(spark, sf, monkeypatch, name, reads, others):
    """It reads the source by columns: no rows are written, and nothing of other fields is read."""
    from veritab.plans import queries

    def written(*_):
        raise AssertionError("rows are written")

    monkeypatch.setattr(run, "stage", written)
    queries.forget()
    try:
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        queries.forget()
    assert reads in plan and not [c for c in others if c in plan]
