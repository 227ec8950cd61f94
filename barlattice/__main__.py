"""python -m barlattice list | run NAME DIR [--out PATH] [--rows N] | doctor DIR | sentiment, scan, market-phase, pools, rps-build, calibrate DIR [--out PATH] [--rows N] | rank DIR [--board NAME] | snapshot-build DIR ROOT | report DIR FOLDER | daily DIR ROOT FOLDER"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barlattice.operators import decisions
from barlattice.plans import market, registry
from barlattice.sources import adapters, quality, reports

#: What doctor asks for: table of the market model, column counted, least count.
CHECKS = (("bars", "code", 50), ("stocks", "code", 50), ("flows", "code", 50))


#: Subcommands that are one query each.
COMMANDS = {"sentiment": "sentiment_temperature", "scan": "trend_evaluate", "market-phase": "market_phase", "pools": "strategy_pools", "rps-build": "rps_rank", "calibrate": "calibration_bins", "rank": "leaderboards"}
#: Candidates that a report lists.
LISTED = 15


def snapshot(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """The day's tables, each under its name: quotes, boards, the three pools, board flows."""
    day = F.lit(adapters.AS_OF).cast("date")
    of_day = lambda df: df.where(F.col("trade_date") == day)
    stocks, limits = adapters.stocks(spark, sf_dir), of_day(market.pool(spark, sf_dir))
    flows = of_day(adapters.flows(spark, sf_dir)).join(stocks.select("code", "board"), "code").groupBy("trade_date", "board").agg(F.sum("main_net").alias("net"))
    tables = {"all_spot": of_day(adapters.spot(spark, sf_dir)), "concept_boards": decisions.board_view(limits, stocks, "trade_date"), "limit_up_pool": limits.where("is_up"), "broke_pool": limits.where("is_broke"), "limit_down_pool": limits.where("is_down"), "sector_fund_flow_rank": flows}
    return quality.write_snapshot(tables, root)


def report(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The best candidates with score, grade and gate, and the state of the sources, as a saved report; the path of its text."""
    run = registry.queries()
    scored = run["recommendation_score"](spark, sf_dir).join(run["gate_decision"](spark, sf_dir), "code").orderBy(F.desc("recommend_score"), "code").limit(LISTED).collect()
    states = doctor(spark, sf_dir)
    worst = "failed" if any(s == "failed" for _, s, _ in states) else "degraded" if any(s != "ok" for _, s, _ in states) else "ok"
    rows = [{"code": r["code"], "recommend": {"recommend_score": r["recommend_score"], "grade": r["grade"]}, "bucket": r["bucket"], "gate": r["gate"]} for r in scored]
    body = {"date": adapters.AS_OF.replace("-", ""), "data_quality": worst, "tradable": worst == "ok" and any(r["bucket"] == "final" for r in rows), "source_status": {"structured_data": "ok", **{n: s for n, s, _ in states}}, "candidates": rows}
    return str(reports.save_report(body, folder))


def doctor(spark: SparkSession, sf_dir: str, checks: tuple = CHECKS) -> list[tuple[str, str, int]]:
    """State and number of codes of each table of the market model; a table that can't be read has failed."""
    out = []
    for name, column, least in checks:
        try:
            n = getattr(adapters, name)(spark, sf_dir).agg(F.countDistinct(column)).first()[0]
            out.append((name, "ok" if n >= least else "degraded", n))
        except Exception:  # noqa: BLE001  any failure of a source is its state
            out.append((name, "failed", 0))
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barlattice", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(registry.queries()))
    run.add_argument("dir")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=20)
    sub.add_parser("doctor").add_argument("dir")
    for name in COMMANDS:
        one = sub.add_parser(name)
        one.add_argument("dir")
        one.add_argument("--out")
        one.add_argument("--rows", type=int, default=20)
        if name == "rank":
            one.add_argument("--board", help="one leaderboard only")
    for name, places in {"snapshot-build": ["root"], "report": ["folder"], "daily": ["root", "folder"]}.items():
        more = sub.add_parser(name)
        for place in ["dir", *places]:
            more.add_argument(place)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = SparkSession.builder.appName("barlattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "doctor":
        states = doctor(spark, args.dir)
        print("\n".join(f"{name}: {state} ({n})" for name, state, n in states))
        return int(any(state == "failed" for _, state, _ in states))
    if args.command in ("snapshot-build", "daily"):
        states = snapshot(spark, args.dir, args.root)
        print("\n".join(f"{name}: {state}" for name, state in states.items()))
        if args.command == "snapshot-build":
            return int(any(state != "ok" for state in states.values()))
    if args.command in ("report", "daily"):
        print(report(spark, args.dir, args.folder))
        return 0
    df = registry.queries()[COMMANDS.get(args.command) or args.name](spark, args.dir)
    if getattr(args, "board", None):
        df = df.where(F.col("board") == args.board)
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
