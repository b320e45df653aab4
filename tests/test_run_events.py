from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import as_set, plan_of
from pyspark.sql import functions as F

from ledgergrain import fixed_values as fixed
from ledgergrain.functions.sequence import grouped_sequence
from ledgergrain.operators import run_events as ev
from ledgergrain.session import run_folder
from ledgergrain.streaming import events as stream

SCHEMA = (
    "event_id long, run_id long, ts timestamp_ntz, type string, agent_id string, tool_call_id long, value double"
)
TYPES = (
    "session_started agent_started tool_started tool_completed ask_user ask_user_answered artifact_created "
    "agent_completed error done agent_thinking"
).split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    start = datetime(2025, 1, 1)
    made = []
    for i in range(1500):
        run = 1 if rng.random() < 0.4 else rng.randint(2, 9)  # one hot run
        made.append(
            (i, run, start + timedelta(seconds=rng.randint(0, 300)), rng.choice(TYPES), f"agent_{rng.randint(0, 2)}",
             rng.randint(0, 6), rng.random())
        )
    return made


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ordered(rows):
    runs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        runs[r[1]].append(r)
    return runs


def test_sequence_equals_brute_force(events, rows):
    expected = {(run, i, r[0]) for run, rs in ordered(rows).items() for i, r in enumerate(rs, 1)}
    assert as_set(ev.with_sequence(events), "run_id", "seq", "event_id") == expected


def test_sequence_with_null_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [(1, i) for i in range(5)], "g int, n int")
    split = grouped_sequence(df, ["g"], ["n"], "seq")
    assert as_set(split) == {(None, i, i + 1) for i in range(50)} | {(1, i, i + 1) for i in range(5)}


def test_replay(spark, events, rows):
    sequenced = ev.with_sequence(events)
    sizes = {run: len(rs) for run, rs in ordered(rows).items()}
    assert ev.events_after(sequenced, 100).count() == sum(max(0, n - 100) for n in sizes.values())
    seen = spark.createDataFrame([(1, 10), (1, 50), (2, 10**6)], "run_id long, seq long")
    left = {r.run_id: r["count"] for r in ev.resume(sequenced, seen).groupBy("run_id").count().collect()}
    assert left == {run: n - 50 if run == 1 else n for run, n in sizes.items() if run != 2}
    assert as_set(ev.event_counts(events)) == set(sizes.items())


def test_statuses_equal_a_reducer(events, rows):
    agents, runs, failed = {}, {}, set()
    for run, rs in ordered(rows).items():
        runs[run] = "idle"
        for r in rs:
            agents.setdefault((run, r[4]), "queued")
            agents[(run, r[4])] = fixed.AGENT_STATUS.get(r[3], agents[(run, r[4])])
            runs[run] = fixed.RUN_STATUS.get(r[3], runs[run])
            if r[3] == "error":
                failed.add(run)
    assert as_set(ev.agent_status(events), "run_id", "agent_id", "status") == {(*k, v) for k, v in agents.items()}
    assert as_set(ev.run_status(events)) == set(runs.items())
    terminal = {(k, "failed" if k in failed else v) for k, v in runs.items()}
    assert as_set(ev.run_status(events, failed_is_terminal=True)) == terminal


def test_agent_tree(spark):
    at, rows = datetime(2025, 1, 1), []
    said = [
        ("r", "boss", None, "agent_started"), ("r", "a", "boss", "agent_started"), ("r", "b", "a", "agent_failed"),
        ("r", "a", "other", "agent_completed"), ("r", "c", "unseen", "agent_completed"), ("r", "d", "c", "ask_user"),
        ("s", "a", None, "agent_completed"), (None, "x", "y", "note"), (None, "y", None, "agent_completed"),
    ]
    for i, (run, agent, parent, kind) in enumerate(said):
        rows.append((i, run, at + timedelta(seconds=i), kind, agent, parent))
    schema = "event_id long, run_id string, ts timestamp_ntz, type string, agent_id string, parent_id string"
    tree = ev.agent_tree(spark.createDataFrame(rows, schema))
    assert as_set(tree.drop("event_count")) == {
        ("r", "boss", None, 0, "running", False, 3, 4, "failed"), ("r", "a", "boss", 1, "completed", False, 2, 3, "failed"),
        ("r", "b", "a", 2, "failed", False, 1, 1, "failed"), ("r", "unseen", None, 0, "running", True, 3, 2, "waiting_for_user"),
        ("r", "c", "unseen", 1, "completed", False, 2, 2, "waiting_for_user"),
        ("r", "d", "c", 2, "waiting_for_user", False, 1, 1, "waiting_for_user"),
        ("s", "a", None, 0, "completed", False, 1, 1, "completed"),
        (None, "y", None, 0, "completed", False, 2, 2, "running"), (None, "x", "y", 1, "queued", False, 1, 1, "running"),
    }
    chain = [(i, 1, at, "note", f"n{i}", f"n{i - 1}" if i else None) for i in range(600)]
    deep = ev.agent_tree(spark.createDataFrame(chain, schema.replace("run_id string", "run_id int")))
    assert deep.where("depth + tree_agents != 600").count() == 0 and deep.count() == 600
    loop = [(i, "r", at, "note", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)]
    with pytest.raises(ev.CircularAgents):
        ev.agent_tree(spark.createDataFrame(loop, schema))


def test_tool_entries_equal_a_reducer(events, rows):
    entries = defaultdict(list)
    for run, rs in ordered(rows).items():
        for r in rs:
            tools = entries[(run, r[4], r[5])]
            if r[3] == "tool_started":
                tools.append("running")
            elif r[3] == "tool_completed" and tools:
                tools[0] = "completed"
            elif r[3] == "tool_completed":
                tools.append("completed")
    expected = {(*k, len(v), v.count("completed"), v.count("running")) for k, v in entries.items() if v}
    found = ev.tool_pairs(events)
    assert as_set(found, "run_id", "agent_id", "tool_call_id", "entries", "completed_entries",
                  "running_entries") == expected


def test_recent_activity_and_errors(events, rows):
    runs = ordered(rows)
    newest = {(run, r[0]) for run, rs in runs.items() for r in rs[-8:]}
    recent = ev.recent_activity(events)
    assert as_set(recent, "run_id", "event_id") == newest
    assert recent.where("activity is null").count() == 0
    errors = {
        (run, i, r[0]) for run, rs in runs.items()
        for i, r in enumerate([r for r in rs if r[3] == "error"], 1)
    }
    assert as_set(ev.error_list(events), "run_id", "position", "event_id") == errors


def test_log_lines(spark):
    lines = ['[X] {"step_id":"a","status":"completed","duration_ms":10}', "noise",
             '[X] {"step_id":"a","status":"completed","duration_ms":30}', '[X] {"step_id":"a","status":"failed"}',
             '[X] {"step_id":"b","status":"completed","duration_ms":5}', "[X] {broken}"]
    log = ev.parse_log(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert log.count() == 4
    assert as_set(ev.step_durations(log), "step_id", "status", "runs", "avg_ms", "max_ms", "p50_ms") == {
        ("a", "completed", 2, 20.0, 30, 10), ("b", "completed", 1, 5.0, 5, 5)
    }


def test_compaction_keeps_the_whole_length(spark):
    df = spark.createDataFrame([(1, "x" * 2501), (2, "abc"), (3, ""), (4, None), (5, "y" * 2500)], "id int, t string")
    rows = {r.id: r for r in ev.compact_text(df, "t").collect()}
    assert (rows[1].char_count, rows[1].estimated_tokens, rows[1].truncated) == (2501, 625, True)
    assert rows[1].preview == "x" * 2500 + "... [truncated]"
    assert [rows[i].estimated_tokens for i in (2, 3, 4, 5)] == [1, 0, 0, 625] and not rows[5].truncated


@pytest.fixture(scope="module")
def month_of_events(spark):
    """Raw events over thirty days and their six files with interleaved times."""
    rows = [
        (i, datetime(2025, 3, 1) + timedelta(minutes=(i * 7919) % 43_200), i % 13,
         ["view", "click", "signup", "purchase", "error"][i % 5], float(i), f'{{"k": {i % 9}}}')
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, stream.EVENT_SCHEMA)


def deliver(raw, folder, names):
    for name in names:
        raw.where(F.col("event_id") % 6 == int(name[-1])).coalesce(1).write.parquet(f"{folder}/{name}")


def test_no_event_is_lost_and_no_copy_stays(spark, month_of_events):
    base = run_folder(spark, "unique")

    def land():
        source = stream.run_event_stream(spark, f"{base}/in", pattern="*.parquet", files_per_trigger=1)
        return stream.append_unique(source, f"{base}/table", f"{base}/state")

    deliver(month_of_events, f"{base}/in", ["a0", "a1", "a2", "a3"])
    assert land().count() == 2000
    deliver(month_of_events, f"{base}/in", ["b4", "b5", "b0", "b3"])
    landed = land()
    batch = stream.shape_run_events(month_of_events)
    assert landed.count() == 3000 and as_set(landed, "event_id", "type") == as_set(batch, "event_id", "type")
    assert land().count() == 3000  # nothing new came
    landing = stream.Landing(spark, batch.schema, f"{base}/table")
    live = stream.live_table(
        stream.live_agent_status(stream.landed_stream(landing, 2)),
        ["run_id", "agent_id"], f"{base}/live", f"{base}/live_state",
    )
    assert as_set(live) == as_set(ev.agent_status(batch)) and live.count() == ev.agent_status(batch).count()


def test_a_repeated_batch_replaces_its_rows(spark, month_of_events):
    base = run_folder(spark, "repeat")
    deliver(month_of_events, f"{base}/in", ["a0", "a1"])
    for checkpoint in ("one", "two"):  # a lost checkpoint delivers all batches again under their numbers
        source = stream.run_event_stream(spark, f"{base}/in", pattern="*.parquet")
        assert stream.append_table(source, f"{base}/table", f"{base}/{checkpoint}").count() == 1000


def test_a_reader_goes_on_where_it_stopped(spark):
    rows = [(1, "r", 1, 0), (2, "r", 2, 0), (3, "r", 3, 1), (4, "s", 1, 1), (5, None, 1, 0), (6, None, 2, 1)]
    table = spark.createDataFrame(rows, "event_id long, run_id string, seq long, batch_id long")
    read = spark.createDataFrame([("r", 1), ("r", 2), (None, 1)], "run_id string, seq long")
    assert as_set(stream.events_from(table, read), "event_id") == {(3,), (4,), (6,)}
    assert as_set(stream.positions_of(table)) == {("r", 3), ("s", 1), (None, 2)}


def raw_events(spark, rows):
    """Rows of id, minute, run."""
    start = datetime(2025, 3, 1)
    made = [(i, start + timedelta(minutes=m), run, "view", 0.0, '{"k": 1}') for i, m, run in rows]
    return spark.createDataFrame(made, stream.EVENT_SCHEMA)


def feed(spark, base):
    return stream.run_event_stream(spark, f"{base}/in", pattern="*.parquet")


def test_late_events_are_numbered_and_read_in_order_of_arrival(spark):
    base, got, since = run_folder(spark, "late"), [], -1
    arrivals = [[(1, 50, 1), (2, 60, 1), (3, 10, 2)], [(4, 5, 1), (5, 55, 1)], [], [(6, 1, 2), (7, 0, 1), (8, 70, 3)]]
    for number, rows in enumerate(arrivals):
        raw_events(spark, rows).write.parquet(f"{base}/in/{number}")
        stream.append_table(feed(spark, base), f"{base}/table", f"{base}/state")
        landing = stream.Landing(spark, feed(spark, base).schema, f"{base}/table")
        got.append({(r.run_id, r.seq, r.event_id) for r in landing.events(since).collect()})
        since = landing.last()[1]
    assert got == [
        {(1, 1, 1), (1, 2, 2), (2, 1, 3)}, {(1, 3, 4), (1, 4, 5)}, set(), {(2, 2, 6), (1, 5, 7), (3, 1, 8)}
    ]


def test_events_without_id_all_stay(spark):
    base = run_folder(spark, "nulls")
    for number in range(2):
        rows = [(None, m, 1) for m in range(10)] + [(None, 3, 1), (7, number, 1), (7, 5, 1)]
        raw_events(spark, rows).write.parquet(f"{base}/in/{number}")
        landed = stream.append_unique(feed(spark, base), f"{base}/table", f"{base}/state")
    assert landed.where("event_id IS NULL").count() == 22 and landed.where("event_id = 7").count() == 1
    assert sorted(r.seq for r in landed.collect()) == list(range(1, 24))


def test_a_batch_reads_no_events_of_older_batches(spark, month_of_events, monkeypatch):
    """What landing reads of the table: marks, heads since the last snapshot and its own rows."""
    base, reads = run_folder(spark, "reads"), []
    plain = stream.Landing._read

    def read(self, schema, path):
        reads.append((path.split("/table/")[1].split("/")[0], path.rsplit("/", 1)[-1]))
        return plain(self, schema, path)

    monkeypatch.setattr(stream, "SNAPSHOT", 2)
    sizes = []
    for number in range(5):
        month_of_events.where(F.col("event_id") % 5 == number).write.parquet(f"{base}/in/{number}")
        source = stream.run_event_stream(spark, f"{base}/in", pattern="*.parquet")
        with monkeypatch.context() as patch:
            patch.setattr(stream.Landing, "_read", read)
            reads.clear()
            landed = stream.append_unique(source, f"{base}/table", f"{base}/state")
        events = [name for kind, name in reads if kind == "events"]
        assert events[0] == f"batch_id={number}" and len(events) == 2  # the second is the table that is returned
        landing = stream.Landing(spark, source.schema, f"{base}/table")
        heads = landing.heads(landing.last()[0], number + 1)
        sizes.append(len(heads.inputFiles()))
        assert heads.count() == landed.select("run_id").distinct().count()
    assert landed.count() == 3000 == landed.select("run_id", "seq").distinct().count()
    counts = landed.groupBy("run_id").agg(F.max("seq") == F.count("seq")).collect()
    assert all(r[1] for r in counts)


def test_a_batch_that_failed_after_landing_lands_once(spark, month_of_events):
    """The commit of the stream is lost, not the mark; then also the mark: both times the rows stay the same."""
    base = run_folder(spark, "again")
    month_of_events.where("event_id < 500").write.parquet(f"{base}/in/0")
    first = stream.append_unique(feed(spark, base), f"{base}/table", f"{base}/state")
    want = as_set(first, "event_id", "run_id", "seq")
    landing = stream.Landing(spark, feed(spark, base).schema, f"{base}/table")
    job, last = landing.last()
    batch = first.drop("seq", "batch_id").where("event_id < 400")  # another content must not replace what is landed
    landing.land(batch, last, job, [F.col("ts"), F.col("event_id")])
    assert as_set(landing.events(), "event_id", "run_id", "seq") == want and len(want) == 500


def test_a_lost_checkpoint_starts_the_table_anew(spark, month_of_events):
    base = run_folder(spark, "anew")
    for number in range(3):
        month_of_events.where(F.col("event_id") % 3 == number).write.parquet(f"{base}/in/{number}")
        stream.append_unique(feed(spark, base), f"{base}/table", f"{base}/one")
    landed = stream.append_unique(feed(spark, base), f"{base}/table", f"{base}/two")  # all of it in one batch
    assert landed.count() == 3000 and landed.select("batch_id").distinct().count() == 1


def test_keys_are_forgotten_after_their_lifetime(spark):
    """Arrival counts: an early time is not late, and only keys that came long ago may come again."""
    base = run_folder(spark, "lifetime")
    for number, rows in enumerate([[(1, 100, 1), (2, 0, 1)], [(1, 100, 1), (3, -90_000, 1), (3, -90_000, 1)]]):
        raw_events(spark, rows).write.parquet(f"{base}/in/{number}")
        landed = stream.append_unique(feed(spark, base), f"{base}/table", f"{base}/state", lifetime="1 day")
    assert sorted(r.event_id for r in landed.collect()) == [1, 2, 3]


def test_state_of_closed_calls_goes(spark):
    """Calls close after the bound; a completion after that stands alone; what is open stays in the state."""
    base, at = run_folder(spark, "close"), datetime(2025, 3, 1)

    def arrive(number, rows):
        made = [(i, r, at + timedelta(hours=h), kind, "a", call, 0.0) for i, (r, call, kind, h) in enumerate(rows)]
        spark.createDataFrame(made, SCHEMA).write.parquet(f"{base}/in/{number}")
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        rows = stream.append_closed(
            stream.closing_tool_pairs(events, "4 hours", "1 hour"), f"{base}/closed", f"{base}/state")
        return {(r.run_id, r.tool_call_id, r.entries, r.completed_entries, r.completed_without_start) for r in rows.collect()}

    s, c = "tool_started", "tool_completed"
    assert arrive(0, [(1, 1, s, 0), (1, 1, c, 1), (1, 2, s, 0), (2, 3, s, 2)]) == set()
    done = {(1, 1, 1, 1, False), (1, 2, 1, 0, False)}
    assert arrive(1, [(2, 3, c, 4), (2, 4, s, 7)]) == done
    done |= {(2, 3, 1, 1, False), (2, 4, 1, 0, False)}
    assert arrive(2, [(1, 2, c, 16), (2, 5, s, 30)]) == done | {(1, 2, 1, 1, True)}
    events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    closed = stream.closing_tool_pairs(events, "4 hours", "1 hour")
    job = closed.writeStream.format("memory").queryName("left").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    assert job.lastProgress.stateOperators[0].numRowsTotal == 1  # the call of hour 30


def test_percentiles_are_exact(spark):
    rows = [("a", "ok", i % 101) for i in range(30_000)] + [("b", "ok", 5), ("b", "ok", None)]
    log = spark.createDataFrame(rows, "step_id string, status string, duration_ms long").repartition(6)
    found = {r.step_id: (r.runs, r.p50_ms, r.p95_ms, r.max_ms) for r in ev.step_durations(log).collect()}
    values = sorted(i % 101 for i in range(30_000))
    assert found == {"a": (30_000, values[14_999], values[28_499], 100), "b": (1, 5, 5, 5)}


def test_groups_are_dealt_whole_and_only_large_ones_cut(spark):
    rows = [(g, n) for g, size in ((None, 40), (1, 60), (2, 3), (3, 1)) for n in range(size)]
    df = spark.createDataFrame(rows, "g int, n int").repartition(5)
    expected = {(g, n, n + 1) for g, n in rows}
    small, mixed = (grouped_sequence(df, ["g"], ["n"], "seq", large=k) for k in (100, 30))
    assert as_set(small) == as_set(mixed) == as_set(grouped_sequence(df, ["g"], ["n"], "seq", large=0)) == expected
    assert "rangepartitioning" not in plan_of(small) and "Join" not in plan_of(small)
    assert "Join" in plan_of(mixed)


def test_a_batch_goes_through_its_state_once(spark, month_of_events):
    """However often the numbering reads a batch."""
    base = run_folder(spark, "once")
    deliver(month_of_events, f"{base}/in", ["a0"])
    source = stream.run_event_stream(spark, f"{base}/in", pattern="*.parquet")
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    counted = F.udf(count, "long")("event_id")
    stream.append_table(source.withColumn("event_id", counted), f"{base}/table", f"{base}/state")
    assert seen.value == 500


def test_landed_events_are_read_by_bytes(spark, month_of_events):
    """A landing of many small files is one batch of its reader."""
    base = run_folder(spark, "bytes")
    month_of_events.repartition(70).write.parquet(f"{base}/table/events/job=x/batch_id=0")
    landing = stream.Landing(spark, stream.shape_run_events(month_of_events).schema, f"{base}/table")
    spark.range(1).selectExpr("'x' as job", "0L as batch_id", "current_timestamp() as at").write.parquet(f"{base}/table/landed")
    ran = []
    stream._run(stream.landed_stream(landing), lambda batch, number: ran.append(number), f"{base}/state", "append")
    assert ran == [0]
