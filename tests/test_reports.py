import json

from barlattice.sources import reports


def report(date, quality="ok", score=80.0):
    return {"date": date, "data_quality": quality, "tradable": True, "source_status": {"structured_data": "ok"}, "candidates": [{"code": "1", "recommend": {"recommend_score": score}, "x": float("nan")}]}


def test_reports_and_their_pointer(tmp_path):
    reports.save_report(report("20240102"), str(tmp_path))
    reports.save_report(report("20240103", "degraded"), str(tmp_path))
    md = reports.save_report(report("20240104", "ok", None), str(tmp_path))
    assert "## candidates" in md.read_text() and (tmp_path / "degraded" / "20240103.json").exists()
    assert json.loads((tmp_path / "latest_ok.json").read_text())["date"] == "20240104"
    assert json.loads((tmp_path / "20240102.json").read_text())["candidates"][0]["x"] is None
    (tmp_path / "20240105.json").write_text("{broken")
    assert reports.latest_report(str(tmp_path))["date"] == "20240102" and reports.latest_report(str(tmp_path / "none")) is None


def test_cached_tables_age(spark, tmp_path):
    calls = []
    fetch = lambda: calls.append(1) or spark.range(3)
    get = lambda now: reports.cached(spark, str(tmp_path), "spot", "20240102", 5, ttl=60, fetch=fetch, now=now)
    assert get(1000.0).count() == 3 and get(1050.0).columns == ["id"] and len(calls) == 1
    assert get(1061.0).count() == 3 and len(calls) == 2
    assert reports.cache_get(spark, str(tmp_path), "spot", "other", ttl=60) is None
    assert reports.cache_get(spark, str(tmp_path), "spot", "20240102", 5, ttl=1, now=9999.0) is None
    assert reports.cache_get(spark, str(tmp_path), "spot", "20240102", 5, ttl=1, now=9999.0, allow_stale=True).count() == 3
