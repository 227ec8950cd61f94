from barlattice import __main__ as cli
from barlattice.sources import reports

SF = "/root/testdata/sf0.001"


def test_list_run_and_doctor(spark, capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "rps_rank" in capsys.readouterr().out
    assert cli.main(["run", "benchmark_curve", SF, "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert cli.doctor(spark, SF, (("bars", "code", 1), ("stocks", "code", 10**6))) == [("bars", "ok", 10), ("stocks", "degraded", 10)]
    assert [s for _, s, _ in cli.doctor(spark, str(tmp_path / "none"))] == ["failed"] * 3


def test_rank_snapshot_and_report(spark, capsys, tmp_path):
    assert cli.main(["rank", SF, "--out", str(tmp_path / "rank")]) == 0 and spark.read.parquet(str(tmp_path / "rank")).count() > 0
    assert cli.main(["daily", SF, str(tmp_path / "snap"), str(tmp_path / "reports")]) == 0
    said = capsys.readouterr().out
    assert "all_spot: ok" in said and "limit_down_pool: ok" in said and "failed" not in said
    found = reports.latest_report(str(tmp_path / "reports" / "degraded"))
    assert found["date"] == "20010131" and 0 < len(found["candidates"]) <= cli.LISTED and found["data_quality"] == "degraded"
