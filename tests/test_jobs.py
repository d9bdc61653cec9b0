"""Named-table jobs end to end: CSV folder -> table -> monitor, dashboard, model."""

from pondlake.plans import jobs
from tests.test_ingest import HEADER, _row, _write


def test_folder_to_reports_dashboard_and_model(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    for pond in (1, 2, 3):
        rows = [_row(i) for i in range(1, 131)]
        for i, r in enumerate(rows):
            r[2] = 20 + (i % 7) * pond          # temperature varies by pond
            r[HEADER.index("PH")] = 7 + (i % 3) / 10
        _write(d / f"IoTPond{pond}.csv", HEADER, rows)
    table = jobs.load_ponds(spark, str(d), "ponds_e2e", path=str(tmp_path / "tbl"))
    assert table.count() == 3 * 130
    types = dict(table.dtypes)
    assert types["pond_id"] == "int" and types["created_at"] == "timestamp"

    rep = jobs.monitor_table(spark, "ponds_e2e", ["temperature", "ph"], 100,
                             reports_path=str(tmp_path / "reports"), run_id="r1")
    assert rep.filter("test_order = 0").count() == 3
    assert spark.read.parquet(str(tmp_path / "reports")).count() == rep.count()
    full = jobs.monitor_table(spark, "ponds_e2e", report_range=100)      # the nine default columns
    assert full.count() == 3 * (1 + 9)
    constant = full.filter("column_name = 'population'").collect()       # constant: one bin, PSI 0
    assert all(r.value == 0.0 and r.status == "PASS" for r in constant)

    dash = jobs.dashboard(spark, "ponds_e2e", ["temperature", "ph"], tick=7, base_pond=1,
                          detail_pond=2)
    assert dash["overview"].count() == 3 * 2
    assert dash["aggregate_overview"].count() == 100 * 2
    assert dash["pond_detail"].count() == 110 * 2

    # the same requests through the zone map of a load in time order
    zones = str(tmp_path / "zones")
    jobs.load_ponds(spark, str(d), "ponds_mapped", path=str(tmp_path / "tbl2"), zones_root=zones)
    again = jobs.monitor_table(spark, "ponds_mapped", ["temperature", "ph"], 100, zones_root=zones)
    assert sorted(map(str, again.collect())) == sorted(map(str, rep.collect()))
    mapped = jobs.dashboard(spark, "ponds_mapped", ["temperature", "ph"], tick=7, base_pond=1, detail_pond=2, zones_root=zones)
    for name, view in dash.items():
        assert sorted(map(str, mapped[name].collect())) == sorted(map(str, view.collect()))

    space = {"max_depth": {"type": "Integer", "low": 2, "high": 3},
             "n_estimators": {"type": "Integer", "low": 3, "high": 4}}
    spark.table("ponds_e2e").selectExpr("*", "CAST(pond_id AS DOUBLE) AS target") \
        .drop("pond_id").write.mode("overwrite").option("path", str(tmp_path / "train")) \
        .saveAsTable("ponds_e2e_train")
    model, params, score = jobs.train_from_table(
        spark, "ponds_e2e_train", "target", "entry_id", "random_forest", space,
        out=str(tmp_path / "models"), n_iter=1, folds=2)
    assert 0.0 <= score <= 1.0
