"""Chains of steps with provenance: what a step made is kept, and made again only if what it was made from has changed.

A step is a function of DataFrames, its inputs are tables or other steps. Its key is a digest of its name, version and
parameters and of its inputs' fingerprints. A fingerprint doesn't depend on the order of rows or files: the schema, the
number of rows and two sums of 64-bit hashes of rows, from one aggregate. A step's rows are written to a folder of their
own; its record, written last under a new name and then moved, is the commit. So a run that is killed leaves records of
whole steps only, and the next one goes on after them. Records hold the step's inputs, key, output, fingerprint and time.

All files lie below one root that driver and executors share; they are reached by Spark's file systems.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[Mapping[str, DataFrame]], DataFrame]
#: Keys of a record.
RECORD = ("step", "status", "key", "inputs", "output", "fingerprint", "rows", "seconds", "error", "run")


@dataclass(frozen=True)
class Step:
    """build gets a DataFrame for each of needs. A new version makes the step run anew."""

    name: str
    needs: tuple[str, ...]
    build: Build
    version: str = "1"
    parameters: Mapping[str, object] = field(default_factory=dict)


class ChainError(RuntimeError):
    """A step failed; the chain's records say which."""


def fingerprint(df: DataFrame) -> tuple[str, int]:
    """A digest of the table that doesn't depend on its order, and its rows. Columns count with their names and types."""
    columns = sorted(df.columns)
    hashes = [F.xxhash64(F.lit(seed), *(F.to_json(F.struct(F.col(f"`{c}`"))) if "map" in dict(df.dtypes)[c] else F.col(f"`{c}`") for c in columns), *(F.col(f"`{c}`").isNull() for c in columns)) for seed in (1, 2)]
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    n, a, b = df.agg(F.count(F.lit(1)), *(total(h) for h in hashes)).first()
    kinds = json.dumps(sorted(df.dtypes))
    return hashlib.sha256(f"{kinds}|{n}|{a}|{b}".encode()).hexdigest(), n


class Files:
    """Small files and folders of a root, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside its place, then moved there."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.move(beside, name)

    def move(self, old: str, new: str) -> None:
        self.fs.delete(self.path(new), True)
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be moved to {new}")

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after what they need, in the given order where that is free; fails on repeated names and on circles."""
    names = [s.name for s in steps]
    if len({*names}) < len(names):
        raise ValueError("two steps have one name")
    done: list[Step] = []
    open_ = list(steps)
    while open_:
        ready = next((s for s in open_ if all(n not in names or n in [d.name for d in done] for n in s.needs)), None)
        if ready is None:
            raise ValueError(f"steps need each other: {', '.join(s.name for s in open_)}")
        done.append(ready)
        open_.remove(ready)
    return done


class Chain:
    def __init__(self, spark: SparkSession, steps: list[Step], tables: Mapping[str, str], root: str):
        """tables: Parquet paths of the inputs that aren't steps."""
        self.spark, self.steps, self.tables, self.files = spark, ordered(steps), dict(tables), Files(spark, root)
        odd = sorted({n for s in self.steps for n in s.needs} - {s.name for s in self.steps} - {*tables})
        if odd:
            raise ValueError(f"neither steps nor tables: {', '.join(odd)}")
        self._prints: dict[str, str] = {}

    def record(self, step: str) -> dict | None:
        name = f"records/{step}.json"
        return read_record(self.files, step) if self.files.exists(name) else None

    def _print_of(self, name: str, records: Mapping[str, dict]) -> str | None:
        if name in self.tables and name not in {s.name for s in self.steps}:
            if name not in self._prints:
                self._prints[name] = fingerprint(self.spark.read.parquet(self.tables[name]))[0]
            return self._prints[name]
        own = records.get(name)
        return own["fingerprint"] if own and own["status"] == "ok" else None

    def _key(self, step: Step, records: Mapping[str, dict]) -> str | None:
        """None while an input isn't there."""
        inputs = {n: self._print_of(n, records) for n in step.needs}
        if None in inputs.values():
            return None
        what = {"step": step.name, "version": step.version, "parameters": dict(step.parameters), "inputs": inputs}
        return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()

    def frame(self, name: str) -> DataFrame:
        """A table, or the rows that a step last made."""
        own = self.record(name)
        return self.spark.read.parquet(f"{self.files.root}/{own['output']}" if own else self.tables[name])

    def status(self) -> list[dict]:
        """Per step: step, status (ok, stale, failed, blocked or never), rows, seconds, error.

        ok: made from the inputs as they are; stale: from others, or its rows are gone; blocked: an input isn't ok.
        """
        out, good = [], {}
        for s in self.steps:
            own = self.record(s.name)
            key = self._key(s, good)
            status = "never" if own is None else "failed" if own["status"] == "failed" else "ok" if own["key"] == key and self.files.exists(own["output"]) else "stale"
            if key is None and status != "failed":
                status = "blocked"
            if status == "ok":
                good[s.name] = own
            out.append({"step": s.name, "status": status} | {k: own[k] if own else None for k in ("rows", "seconds", "error")})
        return out

    def run(self, until: str | None = None) -> list[dict]:
        """Run what isn't ok, in order; ran, kept, failed or blocked for each step. Raises ChainError after a failed step.

        Steps that need the failed one are left, others go on.
        """
        run, good, out = uuid.uuid4().hex, {}, []
        for s in self.steps:
            key = self._key(s, good)
            own = self.record(s.name)
            if key is None:
                out.append({"step": s.name, "did": "blocked"})
            elif own and own["status"] == "ok" and own["key"] == key and self.files.exists(own["output"]):
                good[s.name] = own
                out.append({"step": s.name, "did": "kept"})
            else:
                made = self._make(s, key, good, run)
                out.append({"step": s.name, "did": "ran" if made["status"] == "ok" else "failed"})
                if made["status"] == "ok":
                    good[s.name] = made
            if s.name == until:
                break
        if any(x["did"] == "failed" for x in out):
            raise ChainError(", ".join(x["step"] for x in out if x["did"] == "failed"))
        return out

    def _make(self, step: Step, key: str, good: Mapping[str, dict], run: str) -> dict:
        began, output = time.time(), f"outputs/{step.name}/{key}-{uuid.uuid4().hex[:8]}"
        entry = {"step": step.name, "key": key, "inputs": {n: self._print_of(n, good) for n in step.needs}, "run": run}
        try:
            frames = {n: self.frame(n) if n in good else self.spark.read.parquet(self.tables[n]) for n in step.needs}
            step.build(frames).write.parquet(f"{self.files.root}/{output}")
            print_, rows = fingerprint(self.spark.read.parquet(f"{self.files.root}/{output}"))
            entry |= {"status": "ok", "output": output, "fingerprint": print_, "rows": rows, "error": None}
        except Exception as e:  # a step may fail in any way; its record says how
            self.files.fs.delete(self.files.path(output), True)
            entry |= {"status": "failed", "output": "", "fingerprint": "", "rows": None, "error": f"{type(e).__name__}: {e}"[:500]}
        entry["seconds"] = round(time.time() - began, 1)
        self.files.write(f"records/{step.name}.json", json.dumps(entry, indent=1))
        return entry

    def clean(self) -> int:
        """Delete outputs that no record names; how many there were."""
        kept = {r["output"] for s in self.steps if (r := self.record(s.name))}
        gone = [f"outputs/{s}/{o}" for s in self.files.names("outputs") for o in self.files.names(f"outputs/{s}") if f"outputs/{s}/{o}" not in kept]
        for name in gone:
            self.files.fs.delete(self.files.path(name), True)
        return len(gone)


def read_record(files: Files, step: str) -> dict:
    """A step's record; fails if it isn't one."""
    record = json.loads(files.read(f"records/{step}.json"))
    if not isinstance(record, dict) or sorted(record) != sorted(RECORD):
        raise ValueError(f"records/{step}.json: not the keys of a record")
    if record["step"] != step or record["status"] not in ("ok", "failed") or not isinstance(record["inputs"], dict):
        raise ValueError(f"records/{step}.json: not a record of {step}")
    return record


def scale_chain() -> list[Step]:
    """From observations to the gate: cells, an ensemble of labels, segments, runs, boundaries, ranked scales, the gate."""
    from mosaiq.operators import boundary, segments
    from mosaiq.sources import adapters

    return [
        Step("cells", ("lineitem",), lambda t: adapters.cells(adapters.observations(t["lineitem"]))),
        Step("labels", ("cells",), lambda t: adapters.label_px(t["cells"])),
        Step("segments", ("labels",), lambda t: segments.segment_sizes(t["labels"])),
        Step("runs", ("segments",), lambda t: segments.run_summary(t["segments"])),
        Step("edges", ("labels",), lambda t: boundary.boundary_pixels(t["labels"])),
        Step("ranked", ("labels", "edges", "runs"), lambda t: boundary.ensemble_rank(t["labels"], t["edges"], t["runs"])),
        Step("gate", ("ranked",), lambda t: boundary.scale_gate(t["ranked"])),
    ]


#: Chains by name, for the command line.
CHAINS: dict[str, Callable[[], list[Step]]] = {"scales": scale_chain}


def tables_of(steps: list[Step], folder: str) -> dict[str, str]:
    """Paths of the tables that steps need, in a folder."""
    names = {n for s in steps for n in s.needs} - {s.name for s in steps}
    return {n: f"{folder.rstrip('/')}/{n}.parquet" for n in sorted(names)}
