"""Chains: order, fingerprints, kept steps, failures, a driver that is killed between output and record."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from mosaiq import cli
from mosaiq.plans import chain
from mosaiq.plans.chain import Chain, ChainError, Step

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def steps(calls, fail=(), version="1"):
    def of(name, build):
        def run(t):
            calls.append(name)
            if name in fail:
                raise ValueError(f"{name} broke")
            return build(t)

        return run

    return [
        Step("c", ("a", "b"), of("c", lambda t: t["a"].join(t["b"], "k"))),
        Step("a", ("one",), of("a", lambda t: t["one"].withColumn("x", F.col("v") + 1)), version),
        Step("b", ("two",), of("b", lambda t: t["two"].groupBy("k").agg(F.sum("w").alias("w")))),
        Step("d", ("b",), of("d", lambda t: t["b"].where("w > 2"))),
    ]


@pytest.fixture
def tables(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("one", "two")}
    spark.createDataFrame([(k, k * 2) for k in range(5)], "k int, v int").write.parquet(paths["one"])
    spark.createDataFrame([(k % 3, k) for k in range(9)], "k int, w int").write.parquet(paths["two"])
    return paths


def did(rows):
    return {x["step"]: x["did"] for x in rows}


def test_steps_are_kept_while_their_inputs_are(spark, tables, tmp_path):
    calls, root = [], f"file://{tmp_path}/root"
    own = Chain(spark, steps(calls), tables, root)
    assert {x["status"] for x in own.status()} == {"never", "blocked"}
    assert did(own.run()) == dict.fromkeys("abcd", "ran") and calls == ["a", "b", "c", "d"]
    assert own.frame("c").count() == 3 and {x["status"] for x in own.status()} == {"ok"}
    assert did(own.run()) == dict.fromkeys("abcd", "kept") and len(calls) == 4
    spark.read.parquet(tables["two"]).repartition(5).write.parquet(str(tmp_path / "again"))  # the same rows in other files
    same = Chain(spark, steps(calls), tables | {"two": str(tmp_path / "again")}, root)
    assert did(same.run()) == dict.fromkeys("abcd", "kept")
    assert did(Chain(spark, steps(calls, version="2"), tables, root).run()) == {"a": "ran", "b": "kept", "c": "kept", "d": "kept"}  # a made the same rows
    spark.createDataFrame([(0, 100)], "k int, w int").write.mode("append").parquet(tables["two"])
    new = Chain(spark, steps(calls, version="2"), tables, root)
    assert [x["status"] for x in new.status()] == ["ok", "stale", "blocked", "blocked"]
    assert did(new.run()) == {"a": "kept", "b": "ran", "c": "ran", "d": "ran"}
    assert new.clean() == 4 and new.clean() == 0 and {x["status"] for x in new.status()} == {"ok"}


def test_a_failed_step_blocks_what_needs_it(spark, tables, tmp_path):
    calls, root = [], f"file://{tmp_path}/root"
    with pytest.raises(ChainError, match="a"):
        Chain(spark, steps(calls, fail=("a",)), tables, root).run()
    own = Chain(spark, steps(calls), tables, root)
    state = {x["step"]: x for x in own.status()}
    assert {k: v["status"] for k, v in state.items()} == {"a": "failed", "b": "ok", "c": "blocked", "d": "ok"} and "a broke" in state["a"]["error"]
    assert did(own.run()) == {"a": "ran", "b": "kept", "c": "ran", "d": "kept"}


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", None, [1]), (2, None, 1.5, []), (2, None, 1.5, [])], "k int, s string, v double, l array<int>")
    base = chain.fingerprint(df)
    assert chain.fingerprint(df.repartition(3).orderBy(F.desc("k")).select("v", "s", "l", "k")) == base and base[1] == 3
    other = [df.distinct(), df.withColumn("k", F.col("k").cast("long")), df.withColumnRenamed("s", "t"), df.fillna("", ["s"]), df.limit(0)]
    assert len({chain.fingerprint(x)[0] for x in [df, *other]}) == 6


def test_bad_chains_and_records(spark, tables, tmp_path):
    one = Step("x", ("y",), lambda t: t["y"])
    with pytest.raises(ValueError, match="need each other"):
        Chain(spark, [one, Step("y", ("x",), lambda t: t["x"])], {}, str(tmp_path))
    with pytest.raises(ValueError, match="neither"):
        Chain(spark, [one], {}, str(tmp_path))
    with pytest.raises(ValueError, match="one name"):
        Chain(spark, [one, one], {"y": "z"}, str(tmp_path))
    own = Chain(spark, steps([]), tables, f"file://{tmp_path}/bad")
    own.files.write("records/a.json", json.dumps({"step": "a"}))
    with pytest.raises(ValueError, match="keys of a record"):
        own.status()


KILLED = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from mosaiq.plans.chain import Chain, Step
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
def second(t):
    os._exit(9)  # the driver dies while a step runs
Chain(spark, [Step("a", ("one",), lambda t: t["one"]), Step("b", ("a",), second)], {"one": sys.argv[2]}, sys.argv[3]).run()
"""


def test_a_killed_chain_goes_on(spark, tables, tmp_path):
    root = f"file://{tmp_path}/root"
    done = subprocess.run([sys.executable, "-c", KILLED, ROOT, tables["one"], root], capture_output=True, timeout=300)
    assert done.returncode == 9
    own = Chain(spark, [Step("a", ("one",), lambda t: t["one"]), Step("b", ("a",), lambda t: t["a"].where("v > 2"))], {"one": tables["one"]}, root)
    assert [x["status"] for x in own.status()] == ["ok", "never"]
    assert did(own.run()) == {"a": "kept", "b": "ran"} and own.frame("b").count() == 3


def test_command_line(spark, tmp_path, capsys):
    root, sf = f"file://{tmp_path}/root", "/root/testdata/sf0.001"
    assert cli.main(["chain", "run", root, "--chain", "scales", "--tables", sf, "--until", "runs"]) == 0
    assert cli.main(["chain", "status", root]) == 1
    shown = capsys.readouterr().out
    assert "runs ran" in shown and '"step": "gate", "status": "blocked"' in shown
    assert cli.main(["chain", "retry", root]) == 0
    shown = capsys.readouterr().out
    assert "cells kept" in shown and "gate ran" in shown
    assert cli.main(["chain", "status", root]) == 0
    with pytest.raises(SystemExit):
        cli.main(["chain", "retry", f"file://{tmp_path}/other"])
