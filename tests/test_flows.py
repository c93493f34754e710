"""Breakers, retries and JSON validation against simulations and rows written by hand."""

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F


class Clocked:
    """A breaker as its description has it: a list of failures, a flag and a time, call by call."""

    def __init__(self, threshold, window, reset):
        self.threshold, self.window, self.reset = threshold, window, reset
        self.failures, self.opened = [], None

    def call(self, now, failed):
        if self.opened is not None and now - self.opened > self.reset:
            self.opened = None
        if self.opened is not None:
            return True, True
        if failed:
            self.failures = [t for t in self.failures if now - t < self.window] + [now]
            if len(self.failures) >= self.threshold:
                self.opened = now
        else:
            self.failures = []
        return False, self.opened is not None


@pytest.mark.parametrize(("threshold", "window", "reset", "gap", "share"), [(3, 300, 600, 40, 0.8), (3, 300, 600, 3, 0.95), (1, 60, 60, 20, 0.5), (5, 100, 700, 9, 0.97), (2, 600, 600, 1500, 0.9)])
def test_breaker_scan(spark, threshold, window, reset, gap, share):
    from wardlight.operators import breakers

    rng = random.Random(threshold * 1000 + gap)
    calls, want = [], set()
    for agent in ("a", "b", None, "only successes"):
        at, breaker = 1_700_000_000, Clocked(threshold, window, reset)
        for seq in range(400):
            at += rng.choice([0, 0, 1, gap, gap, 2 * gap, window, reset, 20 * reset]) if rng.random() < 0.3 else rng.randrange(gap + 1)
            failed = rng.random() < share and agent != "only successes"
            calls.append((agent, at, seq, failed if failed or seq % 2 else None))
            want.add((agent, seq, *breaker.call(at, failed)))
    rng.shuffle(calls)
    table = spark.createDataFrame(calls, "agent string, sec long, seq long, failed boolean").select("agent", F.timestamp_seconds("sec").alias("at"), "seq", "failed")
    got = [tuple(r) for r in breakers.scan(table, threshold, window, reset).collect()]
    assert len(got) == len(want) and set(got) == want and any(x[2] for x in want)
    assert breakers.scan(table.limit(0)).collect() == []


def test_breaker_scan_holds_slices_only(spark):
    """Every window and group of the scan is a slice of an agent's time, but for the list of its slices."""
    from wardlight.operators import breakers

    with pytest.raises(ValueError, match="old failures"):
        breakers.scan(spark.createDataFrame([], "agent string, at timestamp, seq long, failed boolean"), window=700)
    calls = spark.createDataFrame([("one", 0, 0, True)], "agent string, sec long, seq long, failed boolean")
    plan = breakers.possible_openings(calls, 3, 300, 600)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert dealt and all("agent#" in x and "slice#" in x for x in dealt)


def simulated(records, works, most):
    """Tries in the order of their times: an event queue."""
    queue = [(sec, i, 0) for i, sec in records]
    heapq.heapify(queue)
    out = []
    while queue:
        sec, i, retry = heapq.heappop(queue)
        good = retry >= works[i]
        out.append((i, retry, sec, "ok" if good else "dead" if retry == most else "failed"))
        if not good and retry < most:
            heapq.heappush(queue, (sec + min(2 ** (retry + 1), 60), i, retry + 1))
    return out


def test_retries(spark):
    from wardlight.streaming import retries, stateful

    rng, most = random.Random(8), 7
    records = [(i, 1_700_000_000 + rng.randrange(600)) for i in range(60)]
    works = {i: rng.randrange(10) for i, _ in records}
    table = spark.createDataFrame([(i, "x", sec, json.dumps({"works": works[i]})) for i, sec in records], "record_id long, source string, sec long, payload string")
    table = table.select("record_id", "source", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("at"), "payload").repartition(3)
    slices = stateful.in_time_order(spark, table, ["2023-11-14 22:16:00", "2023-11-14 22:20:00"], "at")
    slices.frames.append(spark.createDataFrame([(None, "tick", 1_700_002_000, None)], "record_id long, source string, sec long, payload string").select("record_id", "source", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("at"), "payload"))
    attempt = lambda payload, retry: None if retry >= json.loads(payload)["works"] else "not yet"
    tries = stateful.run(spark, slices, lambda s: retries.retried(s, attempt, most, buckets=3), end=True, spark__sql__streaming__stateStore__providerClass=retries.ROCKS)
    rows = tries.collect()
    want = simulated(records, works, most)
    assert sorted((r["record_id"], r["retry"], r["sec"], r["outcome"]) for r in rows) == sorted(want)
    for i in works:  # in the order of their times, over the batches that wrote them
        mine = sorted((r["batch"], r["sec"], r["retry"]) for r in rows if r["record_id"] == i)
        assert [x[2] for x in mine] == list(range(len(mine)))
    assert len({r["batch"] for r in rows}) > 2
    dead = {r["record_id"]: (r["reason"], r["retry_count"]) for r in retries.dead_letters(tries).collect()}
    assert dead == {i: ("not yet", most) for i, n in works.items() if n > most}
    assert [retries.wait_seconds(n) for n in range(1, 8)] == [2, 4, 8, 16, 32, 60, 60]


def test_resources_of_odd_shapes(spark):
    from wardlight.operators import fhir

    texts = {
        "not json": "{oops", "null": None, "list": "[1]", "empty": "{}", "text for a list": '{"resourceType":"Patient","id":"1","identifier":"M1","name":"Smith","birthDate":19800101}',
        "patient": '{"resourceType":"Patient","id":"2","identifier":[{"type":{"coding":[{"code":"MR"}]}}],"name":[{"family":"A"},{"given":["B"]}],"birthDate":"1980-01"}',
        "code is text": '{"resourceType":"Observation","id":"3","status":"final","code":"8867-4","subject":{"reference":"x"},"effectivePeriod":{"start":"2024"},"extra":[{"deep":[1,2,{"a":null}]}]}',
        "false values": '{"resourceType":"Observation","id":0,"status":"","code":{},"subject":[],"effectiveDateTime":"2024-01-01T00:00:00Z","valueQuantity":false,"category":[{"coding":[{"code":"vital-signs"}]},{}]}',
        "unknown type": '{"resourceType":"Device","status":"whatever"}',
    }
    table = spark.createDataFrame(list(texts.items()), "case string, resource string")
    got = {r["case"]: r for r in fhir.validate(table).collect()}
    errors = {k: r["errors"] for k, r in got.items()}
    for case in ("not json", "null", "list", "empty"):
        assert (got[case]["resource_type"], got[case]["resource_id"], errors[case], got[case]["is_valid"]) == ("Unknown", "no-id", [], True)
    assert errors["unknown type"] == [] and errors["text for a list"] == ["birthDate format invalid: 19800101 (expected YYYY-MM-DD)"]
    assert errors["patient"] == ["Patient name missing family (last name)"] and got["patient"]["warnings"] == []
    assert errors["code is text"] == [] and got["code is text"]["warnings"] == ["Observation has no LOINC coding"]
    assert errors["false values"] == ["Missing required field: status", "Missing required field: code", "Missing required field: subject", "Vital sign Observation must have a value"]
    structure = {r["case"]: r["structure_errors"] for r in fhir.check_structure(table).collect()}
    assert structure["list"] == ["Missing resourceType"] and structure["unknown type"] == ["Missing resource id"]
    assert structure["code is text"] == ["Missing required field for Observation: effectiveDateTime"]


def test_one_parse_a_row(spark):
    from wardlight.operators import fhir, outputs

    rows = spark.createDataFrame([("{}",)], "resource string")
    plan = fhir.validate(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "get_json_object" not in plan and "from_json" not in plan
    plan = outputs.validate_outputs(rows, "resource")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and "from_json" not in plan  # the second is for what stands between braces in prose


def test_outputs_of_odd_shapes(spark):
    from wardlight.operators import outputs

    good = {
        "patient_state_summary": " ".join(["word"] * 15), "risk_level": "LOW", "risk_justification": "x", "overall_confidence": "HIGH", "human_review_required": False, "human_review_reason": "", "data_gaps": [],
        "differential_diagnoses": [{"condition": "a", "supporting_evidence": ["b"], "probability_rank": "primary", "confidence": 1}], "recommended_actions": [{"action": "a", "urgency": "immediate", "rationale": "r"}],
    }
    bad_item = good | {"differential_diagnoses": [{"condition": "a", "supporting_evidence": "b", "probability_rank": 7, "confidence": "high"}, 5]}
    texts = {"good": json.dumps(good), "fenced": f"```json\n{json.dumps(good)}\n```", "prose": f"So: {json.dumps(good)} - done.", "list": "[1, 2]", "none": None, "bad item": json.dumps(bad_item), "one": '{"risk_level": "HIGH"}'}
    got = {r["case"]: r for r in outputs.validate_outputs(spark.createDataFrame(list(texts.items()), "case string, raw string")).collect()}
    assert {k for k, r in got.items() if r["valid"]} == {"good", "fenced", "prose"} and got["prose"]["output"]["differential_diagnoses"][0]["confidence"] == 1.0
    assert got["list"]["errors"] == got["none"]["errors"] == ["unreadable"] and got["list"]["output"] is None
    assert got["bad item"]["errors"] == ["GUARDRAIL: differential[0] has no supporting_evidence", "differential[0] invalid probability_rank", "differential[1] missing condition", "GUARDRAIL: differential[1] has no supporting_evidence", "differential[1] invalid probability_rank"]
    assert len(got["one"]["errors"]) == 8 and got["one"]["output"]["human_review_required"] and got["one"]["output"]["human_review_reason"] == "HIGH risk: physician review required"


def test_shared_states(spark):
    """Patients share states and keep their own sessions; a second of many accesses is one count."""
    import datetime as dt

    from wardlight.streaming import stateful

    day = lambda d, s=0: dt.datetime(2024, 1, d) + dt.timedelta(seconds=s)
    readings = [(p, day(1 + i // 2, 60 * p), 10 * i + (p or 0)) for p in range(4) for i in range(6) if (p, i // 2) != (2, 1)] + [(None, day(1), 900), (None, day(3, 86_400), 901)]
    readings = [(p, t, 1_000 * (p if p is not None else 99) + s) for p, t, s in readings]
    slices = stateful.in_time_order(spark, spark.createDataFrame(readings, "patient_id long, time timestamp_ntz, seq long"), ["2024-01-02 00:00:00", "2024-01-03 00:00:00"], "time")
    want = set()
    for p in {r[0] for r in readings}:
        start = last = None
        for t, seq in sorted((int((t - dt.datetime(1970, 1, 1)).total_seconds()), s) for q, t, s in readings if q == p):
            start, n = (t, 1) if last is None or t - last > 86_400 else (start, n + 1)  # noqa: F821
            last = t
            want.add((p, seq, start, n))
    states = stateful.GROUPS
    try:
        stateful.GROUPS = 2
        assert {tuple(r)[:4] for r in stateful.run(spark, slices, stateful.sessions).collect()} == want
    finally:
        stateful.GROUPS = states
    rows = [(1, day(1, 100 + i % 3), i) for i in range(300)] + [(1, day(1, 3_702), 300), (1, day(1, 3_701), 301)]
    slices = stateful.in_time_order(spark, spark.createDataFrame(rows, "actor_id long, at timestamp_ntz, seq long"), ["2024-01-01 00:30:00"], "at")
    got = {r["seq"]: r["in_window"] for r in stateful.run(spark, slices, stateful.sliding_counts).collect()}
    assert [got[i] for i in (0, 1, 2, 300, 301)] == [100, 200, 300, 102, 201]


def test_sliding_access_counts_seconds(spark):
    """The window runs over seconds, not over accesses."""
    from wardlight.operators import governance

    rows = [(1 if i % 2 else None, 100 + i % 3, i, True) for i in range(300)] + [(1, 3_702, 300, True), (1, None, 301, True)]
    audit = spark.createDataFrame(rows, "actor_id long, s long, seq long, out_of_department boolean").withColumn("at", F.timestamp_seconds("s"))
    out = governance.sliding_access(audit)
    got = {r["seq"]: (r["in_window"], r["breach"]) for r in out.collect()}
    assert len(got) == 302 and [got[i] for i in (0, 2, 1, 300, 301)] == [(50, False), (150, True), (100, True), (51, True), (1, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("Window")


def test_slices_of_few_keys_stay_small(spark):
    """However many rows come after the last cut, a slice holds about as many as it may, and breakers give the same rows."""
    from pyspark.sql import functions as F

    from wardlight.streaming import stateful

    k = F.col("id")
    calls = spark.range(4_000).select(F.lit("a").alias("agent"), (F.lit("2024-02-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k * 10)).alias("at"), k.alias("seq"), (k % 7 < 5).alias("failed"))
    first = ["2024-02-01 01:00:00"]
    cuts = stateful.even_cuts(calls, "at", first, 1_000)
    assert set(first) < set(cuts) and cuts == sorted(cuts) and stateful.even_cuts(calls, "at", first) == first
    slices = stateful.in_time_order(spark, calls, cuts, "at")
    sizes = [f.count() for f in slices.frames]
    assert sum(sizes) == 4_000 and max(sizes) <= 1_050
    rows = lambda s: sorted((r["seq"], r["refused"], r["open"]) for r in stateful.run(spark, s, stateful.breakers).collect())
    assert rows(slices) == rows(stateful.in_time_order(spark, calls, first, "at"))


def test_states_lie_in_as_many_tasks_as_the_rows_ask_for(spark, monkeypatch):
    """Few rows take a task a core, whatever the session's number of partitions, and few groups; more rows take more of both, with the same sessions."""
    from wardlight.streaming import stateful

    k = F.col("id")
    readings = spark.range(3_000).select((k % 50).alias("patient_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(k.cast("int") % 7, F.lit(0), F.lit(0), k)).alias("time"), k.alias("seq"))
    cuts, cores, seen = ["2024-01-04 00:00:00"], spark.sparkContext.defaultParallelism, []
    rows = lambda s, **on: sorted((r["seq"], r["session_start"], r["n"]) for r in stateful.run(spark, s, lambda x: stateful.sessions(x, **on)).collect())
    with stateful.settings(spark, spark__sql__shuffle__partitions="32"):
        few = stateful.in_time_order(spark, readings, cuts, "time")
        assert (few.tasks, few.groups) == (cores, 16 * cores)
        stateful.replay(spark, few, lambda x: stateful.sessions(x, groups=few.groups), lambda batch, _: seen.append(batch.select(F.spark_partition_id()).distinct().count()))
        assert seen == [cores, cores]
        want = rows(stateful.in_time_order(spark, readings, cuts, "time"))
        monkeypatch.setattr(stateful, "TASK_ROWS", 200)
        many = stateful.in_time_order(spark, readings, cuts, "time")
        assert many.tasks > cores and many.groups == 16 * many.tasks
        assert rows(many, groups=many.groups) == want and len(want) == 3_000
