from cuemill.session import ship_package, stored


def test_package_goes_to_the_workers_once(spark, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PYTHONPATH", "")
    for _ in range(2):
        ship_package(spark)
    assert sum(f.endswith("/cuemill-package.zip") for f in spark.sparkContext.listFiles) == 1


def test_stored_rows_do_not_change(spark):
    df = spark.range(5).selectExpr("id", "rand() AS r")
    kept = stored(df, "rows")
    assert sorted(kept.collect()) == sorted(kept.collect()) and kept.columns == ["id", "r"]
