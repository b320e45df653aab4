"""Building a product again: what is unchanged is kept, what failed is taken up, and the status says why.

A model's fingerprint covers its definition and the fingerprints of what it reads, down to the sources; so a change
reaches everything downstream and nothing else. Every model is written, to a folder named by its fingerprint, and
its state is appended when it is done: a build that ends early goes on where it stopped, and readers of the old
version are not disturbed. States and fingerprints are configuration and come to the driver; rows never do.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import time
import uuid
from dataclasses import is_dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.plans.build import ModelSpec, run_order
from ledgergrain.sources.sinks import write_table
from ledgergrain.sources.tables import NotAllowed

STATUS_SCHEMA = (
    "position int, model string, status string, reason string, row_count long, duration_ms long, error string"
)
STATE_SCHEMA = f"build string, {STATUS_SCHEMA}, fingerprint string, inputs string, path string, at timestamp"


def fingerprint(*parts: str) -> str:
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()[:32]


def definition(spec: ModelSpec) -> str:
    """The text of a model: its SQL or version where it has one, else the source of its function and what it encloses."""
    if spec.version:
        return spec.version
    try:
        text = inspect.getsource(spec.build)
    except (OSError, TypeError):
        text = repr(spec.build)
    held = [c.cell_contents for c in getattr(spec.build, "__closure__", None) or ()]
    plain = [repr(h) for h in held if isinstance(h, (str, int, float, tuple)) or is_dataclass(h)]
    return "\x00".join([text, *plain])


#: Parts of a listed file's description that reading it may change.
_ACCESS = re.compile(r"access_?[tT]ime=\d+")


def _listed(df: DataFrame) -> str | None:
    """Path, size and time of every file that a frame reads, as Spark has listed them; None if it reads anything else."""
    found, leaves = [], df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            return None
        relation = leaf.relation()
        if relation.getClass().getSimpleName() != "HadoopFsRelation":
            return None
        found.append(_ACCESS.sub("", relation.location().allFiles().mkString("\n")))
    return "\n".join(sorted(found)) or None


def source_fingerprint(df: DataFrame) -> str:
    """Of a source: its plan and the path, size and time of its files, which aren't read; without files, its rows.

    The rows' digest is a sum of row hashes with their number, so the order of rows doesn't count.
    """
    kinds = df.schema.simpleString()
    if files := _listed(df):
        return fingerprint("files", kinds, df._jdf.queryExecution().analyzed().canonicalized().toString(), files)
    row = df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    return fingerprint("rows", kinds, str(row[0]), str(row[1]))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except PySparkException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _last_states(spark: SparkSession, folder: str) -> dict[str, object]:
    """The newest state of each model, its newest completed one under "done", and those by fingerprint."""
    last, found = {}, _stored(spark, f"{folder}/_states")
    for row in found.orderBy("at").collect() if found is not None else ():
        last[row.model] = row
        if row.status in ("built", "kept"):
            last[(row.model, "done")] = last[(row.model, row.fingerprint)] = row
    return last


def _reason(spec: ModelSpec, inputs: dict[str, str], before, done) -> str:
    """Why a model has to be built."""
    if before is None:
        return "new"
    if before.status in ("failed", "skipped"):
        return f"{before.status} before"
    old = dict(pair.split("=") for pair in done.inputs.split(",") if pair)
    changed = [n for n in spec.parents if old.get(n) != inputs[n]]
    return f"changed: {', '.join(changed)}" if changed else "definition changed"


def rebuild(spark: SparkSession, tables: dict[str, DataFrame], specs: list[ModelSpec], folder: str) -> DataFrame:
    """Bring every model below ``folder`` up to date; one status row per model.

    ``built`` with the reason (new, definition changed, changed: the inputs that did, failed before, skipped before),
    ``kept`` where nothing did, ``failed``, and ``skipped`` for what comes after a failed model by way of its
    inputs; other models are built all the same.
    """
    last, build, prints = _last_states(spark, folder), uuid.uuid4().hex, {}
    frames, broken, shown = dict(tables), set(), []
    for position, spec in enumerate(run_order(specs)):
        started, before, done = time.monotonic(), last.get(spec.name), last.get((spec.name, "done"))
        path = rows = error = own = None
        held = ""
        if lost := [p for p in spec.parents if p in broken]:
            status, reason = "skipped", f"failed input: {', '.join(lost)}"
            broken.add(spec.name)
        else:
            for p in spec.parents:
                if p not in prints:
                    prints[p] = source_fingerprint(tables[p])
            inputs = {p: prints[p] for p in spec.parents}
            held = ",".join(f"{n}={v}" for n, v in inputs.items())
            own = prints[spec.name] = fingerprint(definition(spec), held)
            same = last.get((spec.name, own))  # built like this before, perhaps not last
            reason = None if same is not None else _reason(spec, inputs, before, done)
            path, status = f"{folder}/{spec.name}/{own}", "built"
            try:
                if reason is None and (kept := _stored(spark, path)) is not None:
                    status, reason, rows, frames[spec.name] = "kept", "unchanged", same.row_count, kept
                else:
                    reason = reason or "output is gone"
                    frame = spec.build(*[frames[p] for p in spec.parents])
                    rows = write_table(frame, path)
                    frames[spec.name] = spark.read.schema(frame.schema).parquet(path)
            except (PySparkException, NotAllowed) as failure:  # what Spark or the guard rejects; the state reports it
                status, path, rows, error = "failed", None, None, str(failure)
                broken.add(spec.name)
        spent = int((time.monotonic() - started) * 1000)
        shown.append((position, spec.name, status, reason, rows, spent, error))
        state = (build, *shown[-1], own, held, path, datetime.now(timezone.utc))
        kinds = T.StructType.fromDDL(STATE_SCHEMA)
        line = spark.range(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(state, kinds)])
        line.coalesce(1).write.mode("append").parquet(f"{folder}/_states")
    return spark.createDataFrame(shown, STATUS_SCHEMA)


def current(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """The newest completed version of a model."""
    states = spark.read.schema(STATE_SCHEMA).parquet(f"{folder}/_states").where(F.col("model") == model)
    row = states.where(F.col("status").isin("built", "kept")).orderBy(F.desc("at")).first()
    if row is None:
        raise LookupError(f"never built: {model}")
    return spark.read.parquet(row.path)
