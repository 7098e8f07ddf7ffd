"""Command line: ``python -m mosaiq.cli list``, ``run QUERY TABLES [OUT]``, ``explain``, and verbs for ledgers and studies."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import ledger, study
from mosaiq.plans import chain, config
from mosaiq.plans.queries import ORACLES, QUERIES
from mosaiq.sources import tables
from mosaiq.sources.stage import clear


def registered() -> tuple[dict, dict]:
    """All queries and oracles: those of the entry module where it is at hand, else the engine's own."""
    if importlib.util.find_spec("__spark_entry__"):
        entry = importlib.import_module("__spark_entry__")
        return entry.queries(), entry.oracle_sql()
    return QUERIES, ORACLES


def plan_study(preset: str, replicates: int, out: str) -> int:
    """All variants of a preset with their replicates, as one JSON list."""
    rows = [v | {"replicate": r} for v in config.preset_variants(preset) for r in range(1, replicates + 1)]
    Path(out).write_text(json.dumps(rows, indent=1))
    return len(rows)


def ledger_state(spark: SparkSession, path: str):
    """Status and attempts of the last attempt of each variant and replicate; later rows of the file come last."""
    rows = tables.read_ledger(spark, path, usable=False).withColumn("attempt_seq", F.monotonically_increasing_id())
    return ledger.latest_attempts(rows.select("variant_id", "replicate", "status", "attempt_seq")).select("variant_id", "replicate", "status", "attempts").orderBy("variant_id", "replicate")


def chain_verb(spark: SparkSession, parser: argparse.ArgumentParser, args: argparse.Namespace) -> int:
    """0 if the chain is well; 1 if a step failed, or isn't ok when asked for the status."""
    files = chain.Files(spark, args.root)
    if args.verb == "run":
        if not args.chain or not args.tables:
            parser.error("chain run needs --chain and --tables")
        files.write("launch.json", json.dumps({"chain": args.chain, "tables": args.tables}))
    elif not files.exists("launch.json"):
        parser.error(f"no launch record in {args.root}")
    launch = json.loads(files.read("launch.json"))
    steps = chain.CHAINS[launch["chain"]]()
    own = chain.Chain(spark, steps, chain.tables_of(steps, launch["tables"]), args.root)
    if args.verb == "clean":
        print(own.clean(), "outputs deleted")
        return 0
    bad = False
    if args.verb != "status":
        try:
            for x in own.run(args.until):
                print(x["step"], x["did"])
        except chain.ChainError as e:
            print("failed:", e)
            bad = True
    for x in own.status():
        print(json.dumps(x))
        bad |= args.verb == "status" and x["status"] != "ok"
    return int(bad)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mosaiq")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query and write its rows as Parquet, or show them")
    run.add_argument("query")
    run.add_argument("tables", help="folder of the Parquet tables")
    run.add_argument("out", nargs="?", help="where to write; shown if left out")
    explain = commands.add_parser("explain", help="the plan of one query")
    explain.add_argument("query")
    explain.add_argument("tables")
    status = commands.add_parser("status", help="the last attempt of each run of a ledger")
    status.add_argument("ledger")
    resume = commands.add_parser("resume", help="planned runs (a JSON list) whose last attempt in a ledger isn't done")
    resume.add_argument("plan")
    resume.add_argument("ledger")
    plan = commands.add_parser("plan", help="the runs of a preset, as a JSON list")
    plan.add_argument("preset", choices=sorted(config.PRESETS))
    plan.add_argument("out")
    plan.add_argument("--replicates", type=int, default=3)
    collect = commands.add_parser("collect", help="a plan joined with result tables (CSV) by their common columns")
    collect.add_argument("plan")
    collect.add_argument("results", nargs="+")
    collect.add_argument("--out", required=True)
    run_chain = commands.add_parser("chain", help="run a chain of steps, or show or retry it; steps whose inputs are as they were are kept")
    run_chain.add_argument("verb", choices=("run", "status", "retry", "clean"))
    run_chain.add_argument("root", help="folder of the chain's records and outputs")
    run_chain.add_argument("--chain", choices=sorted(chain.CHAINS), help="for run; retry and status know it from the launch record")
    run_chain.add_argument("--tables", help="folder of the Parquet tables, for run")
    run_chain.add_argument("--until", help="the last step to run")
    args = parser.parse_args(argv)
    if args.command == "plan":
        print(plan_study(args.preset, args.replicates, args.out), "runs")
        return 0
    queries, oracles = registered()
    if args.command == "list":
        for name in sorted(queries):
            print(name, "" if name in oracles else "(no SQL form)")
        return 0
    if args.command in ("run", "explain") and args.query not in queries:
        parser.error(f"no query {args.query}")
    spark = SparkSession.builder.appName("mosaiq").getOrCreate()
    if args.command == "chain":
        return chain_verb(spark, parser, args)
    if args.command == "status":
        ledger_state(spark, args.ledger).show(1000, truncate=False)
    elif args.command == "resume":
        planned = spark.read.json(args.plan, multiLine=True).select("variant_id", F.col("replicate").cast("string").alias("replicate"))
        rows = tables.read_ledger(spark, args.ledger, usable=False).withColumn("attempt_seq", F.monotonically_increasing_id())
        ledger.resume_plan(planned, rows.select("variant_id", "replicate", "status", "attempt_seq")).orderBy("variant_id", "replicate").show(1000, truncate=False)
    elif args.command == "collect":
        whole = spark.read.json(args.plan, multiLine=True)
        whole = whole.select(*(F.col(c).cast("string").alias(c) for c in whole.columns))
        for path in args.results:
            table = tables.read_text_table(spark, path)
            whole = study.collect_results(whole, [table], [c for c in whole.columns if c in table.columns])
        tables.write_text_table(whole, args.out)
    else:
        df = queries[args.query](spark, args.tables)
        if args.command == "explain":
            df.explain("formatted")
        elif args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(50, truncate=False)
        clear(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
