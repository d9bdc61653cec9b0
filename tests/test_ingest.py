"""Raw CSV folder -> readings: layouts, repairs, splices, strictness."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pondlake.functions import columns as C
from pondlake.sources import catalog as T
from pondlake.sources import csv_ingest as I
from pondlake.sources.csv_ingest import ingest_folder, load_dashboard_csv, write_clean_csv
from pondlake.sources.sinks import append_report

HEADER = ["created_at", "entry_id", "Temperature (C)", "Turbidity(NTU)", "Dissolved Oxygen(g/ml)",
          "PH", "Ammonia(g/ml)", "nitrate(g/ml)", "Population", "Fish_Length (cm)", "Fish_Weight (g)"]


def _write(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(f'"{h}"' for h in header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def _row(i, **over):
    base = [f"{(i % 28) + 1:02d}/01/2024 10:{i % 60:02d}:00", i, 24.5, 10, 6.1, 7.2, 0.3, 12, 50,
            7.5, 120.25]
    for k, v in over.items():
        base[HEADER.index(k)] = v
    return base


@pytest.fixture()
def raw_folder(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    # pond 1: an extra Date column and two surplus columns; one exact duplicate; a null key
    h1 = HEADER[:1] + ["Date"] + HEADER[1:] + ["extra a", "extra b"]
    rows1 = []
    for i in range(1, 21):
        r = _row(i)
        rows1.append(r[:1] + ["2024-01-01"] + r[1:] + ["x", "y"])
    rows1.append(rows1[0])
    r = _row(99)
    r[1] = None
    rows1.append(r[:1] + ["2024-01-01"] + r[1:] + ["x", "y"])
    _write(d / "IoTPond1.csv", h1, rows1)
    # pond 4: literal Jan-00 in a sensor
    rows4 = [_row(i) for i in range(1, 11)]
    rows4[3][HEADER.index("Turbidity(NTU)")] = "Jan-00"
    _write(d / "IoTPond4.csv", HEADER, rows4)
    # pond 7: no population column
    h7 = [h for h in HEADER if h != "Population"]
    rows7 = [[v for j, v in enumerate(_row(i)) if HEADER[j] != "Population"] for i in range(1, 6)]
    _write(d / "IoTPond7.csv", h7, rows7)
    return str(d)


def test_ingest_folder(spark, raw_folder):
    df = ingest_folder(spark, raw_folder)
    assert df.columns == ["pond_id", "created_at", "entry_id", "temperature", "turbidity",
                          "dissolved_oxygen", "ph", "ammonia", "nitrate", "population",
                          "fish_length", "fish_weight"]
    counts = {r.pond_id: r["count"] for r in df.groupBy("pond_id").count().collect()}
    assert counts == {1: 20, 4: 10, 7: 5}          # duplicate and null-key rows gone
    assert df.filter("pond_id = 7 AND population IS NOT NULL").count() == 0
    assert df.filter("pond_id = 4 AND turbidity = 12.45").count() == 1
    types = dict(df.dtypes)
    assert types["entry_id"] == "bigint" and types["population"] == "bigint"
    assert types["temperature"] == "double" and types["created_at"] == "timestamp_ntz"


def test_strict_cast_fails_on_bad_text(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    rows = [_row(i) for i in range(1, 4)]
    rows[1][2] = "warm"
    _write(d / "IoTPond2.csv", HEADER, rows)
    with pytest.raises(Exception, match="cannot cast temperature"):
        ingest_folder(spark, str(d)).collect()


def test_integer_cast_rejects_fraction(spark, tmp_path):
    d = tmp_path / "frac"
    d.mkdir()
    rows = [_row(i) for i in range(1, 4)]
    rows[0][HEADER.index("Population")] = "1.5"
    _write(d / "IoTPond3.csv", HEADER, rows)
    with pytest.raises(Exception, match="cannot cast population to bigint"):
        ingest_folder(spark, str(d)).collect()


def test_missing_path_raises(spark):
    with pytest.raises(AnalysisException):
        spark.read.csv("/nonexistent/pond.csv").collect()


def test_file_without_number_rejected(spark, tmp_path):
    d = tmp_path / "noname"
    d.mkdir()
    _write(d / "IoTPond.csv", HEADER, [_row(1)])
    with pytest.raises(ValueError):
        ingest_folder(spark, str(d))


def test_dashboard_loader_is_lenient(spark, tmp_path):
    p = tmp_path / "dash.csv"
    header = ["created_at", "Temperature (C)", "PH", "Dissolved Oxygen(g/ml)", "Turbidity (NTU)",
              "Ammonia(g/ml)", "Nitrate(g/ml)"]
    rows = [["01/02/2024 10:00:00", 20, 7, 6, 5, 0.1, 3],
            ["not a date", 20, 7, 6, 5, 0.1, 3],
            ["02/02/2024 10:00:00", "Jan-00", "", "", "", "", ""],
            ["03/02/2024 10:00:00", "Jan-00", 7.5, "", "", "", ""]]
    _write(p, header, rows)
    df = load_dashboard_csv(spark, str(p))
    assert df.count() == 2
    assert "dissolvedoxygeng/ml" in df.columns


def test_save_scan_list_and_reports(spark, raw_folder, tmp_path):
    df = ingest_folder(spark, raw_folder)
    T.save_table(df, "readings_test", path=str(tmp_path / "tbl"))
    assert "readings_test" in T.list_tables(spark)
    back = T.scan_table(spark, "readings_test")
    assert back.count() == df.count()
    dup = df.unionByName(df.limit(1))
    with pytest.raises(ValueError, match="violated"):
        T.save_table(dup, "readings_bad", path=str(tmp_path / "bad"))
    write_clean_csv(df, str(tmp_path / "clean"))
    assert spark.read.option("header", True).csv(str(tmp_path / "clean")).count() == df.count()
    from pondlake.operators.drift import monitor
    rep = monitor(df, ["temperature", "ph"], 10)
    append_report(rep, str(tmp_path / "reports"), "run1")
    append_report(rep, str(tmp_path / "reports"), "run2")
    assert spark.read.parquet(str(tmp_path / "reports")).select("run_id").distinct().count() == 2


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "x int, y string, z double")
    assert C.columns_by_type(df, ["text"]) == ["y"]
    assert C.columns_by_type(df, ["numeric"]) == ["x", "z"]
    with pytest.raises(ValueError):
        C.rename_positional(df, ["a", "b"])
    with pytest.raises(ValueError):
        C.target_split(df, "missing")
    assert C.add_null_column(df, "p", "y", 1).columns == ["x", "y", "p", "z"]
    assert C.add_null_column(df, "p", "y", -1).columns == ["p", "x", "y", "z"]


def test_files_of_one_layout_share_one_scan(spark, tmp_path):
    d = tmp_path / "same"
    d.mkdir()
    _write(d / "IoTPond2.csv", HEADER, [_row(i) for i in range(1, 8)])
    _write(d / "IoTPond3.csv", HEADER, [_row(i) for i in range(1, 5)])
    _write(d / "IoTPond12.csv", HEADER, [_row(i) for i in range(1, 3)])
    df = ingest_folder(spark, str(d))
    counts = {r.pond_id: r["count"] for r in df.groupBy("pond_id").count().collect()}
    assert counts == {2: 7, 3: 4, 12: 2}
    import contextlib, io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert buf.getvalue().count("FileScan csv") == 1


@pytest.mark.parametrize("bad, message", [({"created_at": "soon"}, "cannot parse time"),
                                          ({"Population": 3_000_000_000}, "does not fit INT"),
                                          ({"entry_id": 2}, "violated")])
def test_failed_reload_leaves_the_old_table(spark, tmp_path, bad, message):
    from pondlake.plans.jobs import load_ponds
    good, worse = tmp_path / "good", tmp_path / "worse"
    for d in (good, worse):
        d.mkdir()
        _write(d / "IoTPond2.csv", HEADER, [_row(i) for i in range(1, 11)])
    rows = [_row(i) for i in range(1, 11)]
    rows[6] = _row(7, **bad)
    _write(worse / "IoTPond2.csv", HEADER, rows)
    name = f"safe_{message.split()[0]}"
    load_ponds(spark, str(good), name, path=str(tmp_path / "t"))
    before = sorted(map(str, spark.table(name).collect()))
    with pytest.raises(Exception, match=message):
        load_ponds(spark, str(worse), name, path=str(tmp_path / "t"))
    spark.catalog.refreshTable(name)
    assert sorted(map(str, spark.table(name).collect())) == before and len(before) == 10
    load_ponds(spark, str(good), name, path=str(tmp_path / "t"))
    assert spark.table(name).count() == 10
    assert not [t for t in T.list_tables(spark) if "__" in t]


def test_integers_are_exact_and_tokens_are_missing(spark, tmp_path):
    d = tmp_path / "exact"
    d.mkdir()
    rows = [_row(9007199254740993), _row(9007199254740992), _row(5)]
    rows[2][2], rows[2][HEADER.index("Population")] = "NaN", "N/A"
    rows[1][0] = "2024-01-02 10:00:00"
    _write(d / "IoTPond2.csv", HEADER, rows)
    got = {r.entry_id: r for r in ingest_folder(spark, str(d)).collect()}
    assert set(got) == {9007199254740993, 9007199254740992, 5}
    assert got[5].temperature is None and got[5].population is None
    assert str(got[9007199254740992].created_at) == "2024-01-02 10:00:00"


def test_nan_text_is_missing_and_trend_is_flat(spark):
    from pondlake.functions.parse import lenient_numeric
    from pondlake.operators.cleaning import drop_all_null
    from pondlake.operators.series import trend
    df = spark.createDataFrame([("NaN", "NaN"), ("1", "NaN")], "a string, b string")
    typed = lenient_numeric(df, ["a", "b"])
    assert drop_all_null(typed, ["a", "b"]).count() == 1
    pairs = spark.createDataFrame([(1.0, float("nan")), (1.0, 2.0), (1.0, None)], "x double, y double")
    assert [r.trend for r in trend(pairs, "x", "y").collect()] == ["flat", "up", "flat"]


def test_headers_are_found_by_one_job(spark, tmp_path):
    """Layouts of many files, blank first lines, quoted, empty and repeated names."""
    d = tmp_path / "many files"
    d.mkdir()
    lines = ["a,b,c", '\n\n"x, y",b,', "A,a,b"]
    for k in range(60):
        (d / f"p {k}.csv").write_text(lines[k % 3] + "\n" + "1,2,3\n" * (5000 if k == 7 else 1))
    paths = I.list_files(spark, str(d))
    group = f"headers-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, "headers")
    got = I.read_headers(spark, paths)
    tracker = spark.sparkContext.statusTracker()
    assert len(tracker.getJobIdsForGroup(group)) <= 2     # one lists the files, one reads their first lines
    spark.sparkContext.setJobGroup("rest", "rest")
    want = {0: ["a", "b", "c"], 1: ["x, y", "b", "_c2"], 2: ["A0", "a1", "b"]}
    for p in paths:
        k = int(p.rsplit(" ", 1)[1][:-4])
        assert got[p] == want[k % 3]
    assert {tuple(got[p]) for p in paths[:3]} <= {tuple(I.read_header(spark, p)) for p in paths[:9]}
    (d / "empty.csv").write_text("\n \n")
    with pytest.raises(ValueError, match="no header"):
        I.read_headers(spark, I.list_files(spark, str(d)))


@pytest.mark.parametrize("step", ["write", "key", "point", "drop"])
def test_readers_see_the_old_table_or_the_new_one(spark, tmp_path, monkeypatch, step):
    """A writer that dies at any step leaves a whole table under the name."""
    old = spark.range(5).selectExpr("id AS entry_id", "1 AS pond_id")
    new = spark.range(9).selectExpr("id AS entry_id", "2 AS pond_id")
    name = f"pointed_{step}"
    T.save_table(old, name, path=str(tmp_path / "t"))
    T.save_table(old, name, path=str(tmp_path / "t"))

    def die(*_, **__):
        raise KeyboardInterrupt

    if step == "write":
        monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.saveAsTable", die)
    elif step == "key":
        monkeypatch.setattr(T, "assert_key", die)
    elif step == "point":
        monkeypatch.setattr(T, "_point", die)
    else:
        monkeypatch.setattr(T, "_versions", die)
    with pytest.raises(KeyboardInterrupt):
        T.save_table(new, name, path=str(tmp_path / "t"))
    monkeypatch.undo()
    assert spark.table(name).count() == (9 if step == "drop" else 5)
    T.save_table(new, name, path=str(tmp_path / "t"))
    assert spark.table(name).count() == 9 and len(T._versions(spark, name)) == 2   # the dead writer's are gone
    assert [t for t in T.list_tables(spark) if t.startswith(name)] == [name]


def test_a_plain_table_becomes_a_version(spark, tmp_path):
    rows = spark.range(4).selectExpr("id AS entry_id", "1 AS pond_id")
    rows.write.option("path", str(tmp_path / "plain")).saveAsTable("plain_before")
    T.save_table(rows.filter("entry_id > 1"), "plain_before")
    assert spark.table("plain_before").count() == 2
    with pytest.raises(ValueError, match="table name"):
        T.save_table(rows, "bad name; drop")
