"""Where results of a run are kept: small reports with a pointer to the last good one, cached tables with an age.

A report is one run's summary (bounded lists), written by the driver; tables are written by Spark.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEGRADED, POINTER = "degraded", "latest_ok.json"


def plain(value: object) -> object:
    """JSON values with null for what isn't finite."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def markdown(report: dict) -> str:
    """Headings for the parts of a report, a table for each list of records."""
    out = [f"# {report['date']} {report.get('data_quality', '')}".rstrip(), ""]
    for name, value in report.items():
        if isinstance(value, list) and value and isinstance(value[0], dict):
            columns = list(dict.fromkeys(k for row in value for k in row))
            out += [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(str(row.get(c, "")).replace("|", "/").replace("\n", " ") for c in columns) + " |" for row in value), ""]
        elif not isinstance(value, (list, dict)) and name != "date":
            out.append(f"- {name}: {value}")
    return "\n".join(out) + "\n"


def save_report(report: dict, folder: str, force_degraded: bool = False) -> Path:
    """Write <date>.json and <date>.md; a report that is not ok goes to the folder degraded and leaves the pointer to the last good one alone. The pointer changes in one step."""
    bad = force_degraded or report.get("data_quality") in ("failed", "degraded")
    home = Path(folder) / DEGRADED if bad else Path(folder)
    home.mkdir(parents=True, exist_ok=True)
    paths = {kind: home / f"{report['date']}.{kind}" for kind in ("json", "md")}
    paths["json"].write_text(json.dumps(plain(report), ensure_ascii=False, indent=2), encoding="utf-8")
    paths["md"].write_text(markdown(report), encoding="utf-8")
    if not bad:
        fresh = Path(folder) / (POINTER + ".tmp")
        fresh.write_text(json.dumps({"date": report["date"], "json_path": str(paths["json"]), "md_path": str(paths["md"]), "data_quality": report.get("data_quality"), "tradable": report.get("tradable")}), encoding="utf-8")
        fresh.replace(Path(folder) / POINTER)
    return paths["md"]


def complete(report: dict) -> bool:
    """Has candidates, at least half of them scored, and says the state of its structured data."""
    rows = report.get("candidates")
    if not isinstance(rows, list) or not rows:
        return False
    scored = sum(isinstance(r, dict) and isinstance((r.get("recommend") or {}).get("recommend_score"), (int, float)) for r in rows)
    return scored >= max(1, len(rows) // 2) and "structured_data" in {**(report.get("source_status") or {}), **(report.get("source_state") or {})}


def latest_report(folder: str, is_complete: Callable[[dict], bool] = complete) -> dict | None:
    """The complete report with the latest date in its name, the later written one of two."""
    dated = [p for p in Path(folder).glob("*.json") if p.stem[:8].isdigit()]
    for path in sorted(dated, key=lambda p: (p.stem[:8], p.stat().st_mtime), reverse=True):
        try:
            report = json.loads(path.read_text(encoding="utf-8"))
        except ValueError:
            continue
        if isinstance(report, dict) and is_complete(report):
            return report
    return None


def cache_path(root: str, name: str, *parts: object) -> str:
    """One folder for each name and parts."""
    return f"{root}/{name}-{hashlib.sha1(json.dumps([name, *map(str, parts)]).encode()).hexdigest()}"


def cache_put(df: DataFrame, root: str, name: str, *parts: object, now: float | None = None) -> None:
    """Keep a table under its name and parts, with the time."""
    df.withColumn("cached_at", F.lit(float(time.time() if now is None else now))).write.mode("overwrite").parquet(cache_path(root, name, *parts))


def cache_get(spark: SparkSession, root: str, name: str, *parts: object, ttl: float, allow_stale: bool = False, now: float | None = None) -> DataFrame | None:
    """The kept table; None if there is none, it is empty or older than ttl seconds (stale ones if asked for)."""
    try:
        df = spark.read.parquet(cache_path(root, name, *parts))
    except AnalysisException:
        return None
    written = df.agg(F.max("cached_at")).first()[0]
    if written is None or not allow_stale and (time.time() if now is None else now) - written > ttl:
        return None
    return df.drop("cached_at")


def cached(spark: SparkSession, root: str, name: str, *parts: object, ttl: float, fetch: Callable[[], DataFrame], now: float | None = None) -> DataFrame:
    """The kept table if it is fresh, else the fetched one, which is kept."""
    found = cache_get(spark, root, name, *parts, ttl=ttl, now=now)
    if found is None:
        cache_put(fetch(), root, name, *parts, now=now)
        found = cache_get(spark, root, name, *parts, ttl=ttl, allow_stale=True, now=now)
    return fetch() if found is None else found
