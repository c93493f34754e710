"""Folder sources, the exactly-once sink, baselines as stream state and the observed gateway."""

import datetime as dt
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


# ---- folders
@pytest.fixture
def hl7_folder(tmp_path):
    for source, name, data in (
        ("lab", "one.hl7", b"MSH|^~\\&|lab\rPID|1||77\rOBX|1|NM|718-7^Hb||12"), ("lab", "two.hl7", b"MSH|^~\\&|a\r\nPID|1||1\r\n\r\nMSH|^~\\&|b\nPID|1||2"),
        ("icu", "bad.hl7", b"\xff\xfe"), ("icu", "lost.hl7", b"noise\nmore\nMSH|^~\\&|c"), ("icu", "empty.hl7", b""), ("icu", "_tmp.hl7", b"MSH|^~\\&|hidden"),
    ):
        os.makedirs(tmp_path / "in" / source, exist_ok=True)
        (tmp_path / "in" / source / name).write_bytes(data)
    return f"file://{tmp_path}/in"


def test_hl7_folder(spark, hl7_folder, tmp_path):
    from wardlight.sources import folders, hl7

    rows = [tuple(r) for r in folders.load(spark, "hl7_folder", hl7_folder).select("source", "position", "message", "error").collect()]
    want = [("lab", 0, "MSH|^~\\&|lab\rPID|1||77\rOBX|1|NM|718-7^Hb||12", None), ("lab", 0, "MSH|^~\\&|a\rPID|1||1", None), ("lab", 1, "MSH|^~\\&|b\rPID|1||2", None),
            ("icu", None, None, "UnicodeDecodeError: unreadable file"), ("icu", None, None, "text before the first MSH"), ("icu", 0, "MSH|^~\\&|c", None)]
    assert Counter(rows) == Counter(want)
    lab = folders.load(spark, "hl7_folder", hl7_folder, source=["lab"], columns=["message"])
    assert lab.columns == ["message"] and lab.count() == 3 and hl7.observations(lab).first()["value_numeric"] == 12
    both = folders.load(spark, "hl7_folder", hl7_folder, source=["icu"], columns=["message"]).unionByName(lab)
    assert both.count() == 6  # each load keeps its own wishes
    assert folders.load(spark, "hl7_folder", f"file://{tmp_path}/none").count() == 0


def test_folders_plan_partitions_by_bytes(monkeypatch):
    from wardlight.sources import folders

    monkeypatch.setattr(folders, "PARTITION_BYTES", 10)
    parts = folders._planned([(0, p, "", n) for p, n in (("a", 4), ("b", 6), ("c", 1), ("d", 30), ("e", 2))])
    assert [[path for _, path in p.paths] for p in parts] == [["a", "b"], ["c"], ["d"], ["e"]]


def test_hl7_stream_reads_each_file_once(spark, hl7_folder, tmp_path):
    from wardlight.sources import folders

    def run():
        source = folders.load(spark, "hl7_folder", hl7_folder, stream=True, most_files=2)
        source.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").format("parquet").option("path", f"file://{tmp_path}/out").trigger(processingTime="100 milliseconds").start()
        query = spark.streams.active[0]
        query.processAllAvailable()
        batches = query.lastProgress["batchId"]
        query.stop()
        return batches

    run()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6
    (tmp_path / "in" / "lab" / "three.hl7").write_text("MSH|^~\\&|late")
    run()
    rows = Counter(r["message"] for r in spark.read.parquet(f"file://{tmp_path}/out").filter("message is not null").collect())
    assert rows["MSH|^~\\&|late"] == 1 and sum(rows.values()) == 5 and max(rows.values()) == 1


def test_bundles_and_search(spark, tmp_path):
    from wardlight.sources import folders

    entry = lambda kind, i, at=None, who="p/1": {"resource": {"resourceType": kind, "id": i, "subject": {"reference": who}} | ({"effectiveDateTime": at} if at else {})}
    bundle = lambda *e: {"resourceType": "Bundle", "entry": list(e)}
    files = {
        "a/1.json": json.dumps(bundle(entry("Observation", "1", "2024-01-02"), entry("Observation", "2", "2024-01-03", "p/2"), entry("Patient", "3"), {"resource": 5}, "x")),
        "a/2.json": json.dumps(bundle(entry("Observation", "4"))) + "\n" + json.dumps({"resourceType": "List"}) + "\n\n" + json.dumps(bundle(entry("Observation", 5, "2024-01-01"))),
        "b/1.json": "{broken", "b/2.json": json.dumps({"resourceType": "Bundle"}), "b/3.json": json.dumps(bundle(entry("Observation", "6", "2023"))), "b/skip.txt": "{}",
    }
    for path, text in files.items():
        os.makedirs(tmp_path / path[0], exist_ok=True)
        (tmp_path / path).write_text(text)
    where = f"file://{tmp_path}"
    table = folders.load(spark, "fhir_bundles", where)
    assert Counter((r["source"], r["resource_type"], r["error"]) for r in table.collect()) == Counter({("a", "Observation", None): 4, ("a", "Patient", None): 1, ("a", None, "no Bundle"): 1, ("b", None, "no Bundle"): 1, ("b", "Observation", None): 1})
    assert json.loads(table.filter("resource_id = '5'").first()["resource"])["id"] == 5
    seen = lambda df: sorted((r["source"], r["position"] or 0, r["resource_id"] or "") for r in df.collect())
    wanted = folders.load(spark, "fhir_bundles", where, resource_type=["Observation"])
    assert seen(folders.search(wanted, "-date", 2)) == [("a", 0, ""), ("a", 1, "2"), ("a", 2, "1"), ("b", 0, ""), ("b", 1, "6")]
    assert seen(folders.search(wanted, "date", 3)) == [("a", 0, ""), ("a", 1, "5"), ("a", 2, "1"), ("a", 3, "2"), ("b", 0, ""), ("b", 1, "6")]
    one = folders.load(spark, "fhir_bundles", where, patient_ref=["p/2"], source=["a"], columns=["resource_id", "error"])
    assert one.columns == ["resource_id", "error"] and {r["resource_id"] for r in one.collect()} == {"2", None}


# ---- the ledger
@pytest.mark.parametrize("where", ["between write and commit", "between commit and checkpoint"])
def test_killed_stream_loses_and_repeats_nothing(spark, tmp_path, where):
    from wardlight.streaming import ledger

    rows = spark.range(100).select("id", F.col("id").cast("string").alias("v"))
    rows.repartition(5).write.parquet(f"file://{tmp_path}/in")
    book = ledger.Ledger(spark, f"file://{tmp_path}/table", "s")
    deaths = []

    class Dying(ledger.Ledger):
        def write(self, batch, number, before_commit=lambda n: None):
            done = super().write(batch, number, before_commit)
            if where.startswith("between commit") and len(deaths) < 3:
                deaths.append(number)
                raise RuntimeError("killed after the commit")
            return done

    def killed(number):
        if where.startswith("between write") and len(deaths) < 3:
            deaths.append(number)
            raise RuntimeError("killed before the commit")

    for _ in range(8):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        query = ledger.start(source, Dying(spark, f"file://{tmp_path}/table", "s"), f"file://{tmp_path}/state", "50 milliseconds", killed)
        try:
            query.processAllAvailable()
        except Exception:  # noqa: BLE001  the stream that died
            continue
        finally:
            query.stop()
        break
    assert len(deaths) == 3 and book.committed() == list(range(5))
    assert sorted(r["id"] for r in book.read(rows.schema).collect()) == list(range(100))
    book.clean()
    assert book.read(rows.schema).count() == 100


def test_two_writers_of_one_batch(spark, tmp_path):
    from wardlight.streaming import ledger

    one, two = (ledger.Ledger(spark, f"file://{tmp_path}/t", "s") for _ in range(2))
    a, b = spark.range(3), spark.range(10, 20)
    assert one.write(a, 0, lambda n: two.write(b, n)) is False  # the second writer commits while the first one writes
    assert one.write(a, 0) is False and one.write(a, 1) is True
    assert sorted(r["id"] for r in one.read(a.schema).collect()) == sorted([*range(10, 20), *range(3)])


# ---- baselines
def test_sketch_ranks():
    from wardlight.streaming.baselines import SIZE, Sketch

    rng = np.random.default_rng(1)
    for values in (rng.normal(80, 12, 100_000), np.repeat(np.arange(40.0), 900), np.arange(60_000.0), rng.exponential(5, 300)):
        parts = np.array_split(rng.permutation(values), 37)
        whole = Sketch()
        for p in parts[:20]:
            whole.add(p)
        other = Sketch()
        for p in parts[20:]:
            other.add(p)
        whole.merge(other)
        ordered, bound = np.sort(values), whole.bound()
        assert sum(len(x) * 2**i for i, x in enumerate(whole.levels)) == len(values) and max(map(len, whole.levels)) <= SIZE
        for q, x in zip((0.1, 0.5, 0.9), whole.quantiles([0.1, 0.5, 0.9])):
            low, high = np.searchsorted(ordered, x, "left") / len(values), np.searchsorted(ordered, x, "right") / len(values)
            assert low - bound - 1 / len(values) <= q <= high + bound + 1 / len(values)
    few = Sketch().add(np.array([5.0, 1.0, 4.0]))
    assert few.quantiles([0.1, 0.5, 0.9]) == np.percentile([5.0, 1.0, 4.0], [10, 50, 90]).tolist() and few.bound() == 0 and np.isnan(Sketch().quantiles([0.5])[0])


def test_stream_baseline_is_the_batch_baseline(spark):
    from wardlight.streaming import baselines, stateful

    rng = random.Random(2)
    rows = [(p, "heart_rate", i, f"2024-01-{1 + i % 28:02d} 00:00:00", rng.gauss(80 + p, 9)) for i in range(2_400) for p in (1, 2)] + [(3, "spo2_pulse_ox", 1, "2024-01-01 00:00:00", 80.0), (3, "spo2_pulse_ox", 2, "2024-01-02 00:00:00", None)]
    table = spark.createDataFrame(rows, "patient_id long, parameter string, seq long, t string, value double").withColumn("time", F.to_timestamp_ntz("t")).repartition(4)
    slices = stateful.in_time_order(spark, table.select("patient_id", "parameter", "time", "seq", "value"), [f"2024-01-{d:02d} 00:00:00" for d in (8, 15, 22)], "time")
    out = stateful.run(spark, slices, baselines.judged)
    got = {(r["patient_id"], r["parameter"]): r for r in baselines.latest(out).collect()}
    for p in (1, 2):
        values = np.array([r[4] for r in rows if r[0] == p])
        r = got[p, "heart_rate"]
        assert r["n"] == len(values) and abs(r["mean"] - values.mean()) < 1e-9 and abs(r["sd"] - values.std()) < 1e-9
        ranks = [(values <= r[c]).mean() for c in ("p10", "median", "p90")]
        assert np.abs(np.array(ranks) - [0.1, 0.5, 0.9]).max() <= 5 / baselines.SIZE + 1 / len(values)
    one = out.filter("patient_id = 3").collect()
    assert len(one) == 1 and one[0]["n_before"] == 0 and one[0]["severity"] == "critical"  # against the population
    later = [r for r in out.filter("patient_id = 1").collect() if r["n_before"]]
    assert len(later) > 1_500 and all(abs(r["z"] - abs(r["value"] - np.mean(x := [v[4] for v in rows if v[0] == 1 and int(v[3][8:10]) < {1: 8, 2: 15, 3: 22}[r["batch"]]]) ) / np.std(x)) < 1e-6 for r in later[::97])


# ---- the gateway
def test_gateway_counts_what_it_writes(spark, sf_dir, tmp_path):
    from wardlight.operators import governance
    from wardlight.plans import flows

    run, counted = flows._gateway(spark, sf_dir)
    again = run.agg(*[c.alias(k) for k, c in governance.gateway_metrics().items()]).first().asDict()
    assert counted == again and counted["requests"] == counted["allowed"] + counted["denied"] > 0 and counted["breaches"] and counted["deidentified"]
    audit = governance.audit_of(run)
    assert audit.count() == counted["requests"] and audit.filter("resource_id not like 'PAT-%'").count() == 0
    rows = run.select("allowed", "deidentify", "payload").collect()
    assert all(r["payload"] is None for r in rows if not r["allowed"])
    assert all(('"family"' in r["payload"]) != r["deidentify"] for r in rows if r["payload"])


# ---- channels, audit loads, data sets
def test_messages_and_followers(spark, tmp_path):
    from wardlight.streaming import channels, ledger

    rows = [(1, 4, "heart_rate", 160.0, 1, "HEART_RATE_HIGH"), (1, None, "heart_rate", 70.0, 2, None), (None, 4, "heart_rate", 20.0, 3, "HEART_RATE_LOW"), (None, None, "heart_rate", 1.0, 4, "HEART_RATE_LOW")]
    d = spark.createDataFrame(rows, "patient_id long, ward long, parameter string, value double, seq long, alert string").withColumn("time", F.lit(None).cast("timestamp_ntz"))
    sent = channels.messages(d)
    assert sorted((r["channel"], r["type"], r["seq"]) for r in sent.collect()) == [
        ("alerts:patient:1", "vital_critical", 1), ("alerts:ward:4", "vital_critical", 1), ("alerts:ward:4", "vital_critical", 3), ("patient:1", "vital_reading", 1), ("patient:1", "vital_reading", 2),
        ("ward:4", "vitals_update", 1), ("ward:4", "vitals_update", 3),
    ]
    book = ledger.Ledger(spark, f"file://{tmp_path}/channels", "c", channels.FOLDERS)
    assert book.write(sent, 0) and not book.write(sent, 0)
    got = channels.follow(book, sent.schema, "alerts:ward:4")
    assert sorted(json.loads(r["payload"])["alert"] for r in got.collect()) == ["HEART_RATE_HIGH", "HEART_RATE_LOW"]
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "shard" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert channels.follow(book, sent.schema, "ward:9").count() == 0


def test_audit_loads_side_by_side(spark, tmp_path):
    """A load that loses its number looks again, so what the winner wrote is not repeated."""
    from wardlight.sources import sinks
    from wardlight.streaming import ledger

    schema = "id long, day date, v string"
    table = lambda *ids: spark.createDataFrame([(i, dt.date(2024, 1, 1 + i % 3) if i % 5 else None, "x") for i in ids], schema)
    raced = []

    class Raced(ledger.Ledger):
        def write(self, rows, batch, before_commit=lambda n: None):
            if not raced:
                raced.append(sinks.append_once(table(2, 3, 5), ledger.Ledger(spark, self.path, self.stream, self.folders), ["id", "day"], "day"))
            return super().write(rows, batch, before_commit)

    book = Raced(spark, f"file://{tmp_path}/audit", "a", ["day"])
    assert sinks.append_once(table(1, 2, 2, 5), book, ["id", "day"], "day") == 1 and raced == [0]
    assert sinks.append_once(table(1, 4, 5, 10), book, ["id", "day"], "day") == 2
    assert sorted(r["id"] for r in book.read(spark.createDataFrame([], schema).schema).collect()) == [1, 2, 3, 4, 5, 10]
    with pytest.raises(ValueError):
        sinks.append_once(table(1), book, ["id"], "day")


def test_bundles_and_dataset(spark, tmp_path):
    from wardlight.sources import sinks

    p = spark.createDataFrame([(1, "ann"), (2, "bob")], "patient_id long, name string")
    v = spark.createDataFrame([(1, dt.datetime(2024, 1, 1 + i // 5), i, "heart_rate", float(i)) for i in range(8)] + [(9, None, 99, None, None)], "patient_id long, time timestamp_ntz, seq long, parameter string, value double")
    b = sinks.bundles(p, v, 2)
    got = {(r["patient_id"], r["day"], r["page"], json.loads(r["entry"][0])["resourceType"]): [json.loads(e)["id"] for e in r["entry"]] for r in b.collect()}
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert got == {
        (1, None, 0, "Patient"): [1], (2, None, 0, "Patient"): [2], (1, one, 0, "Observation"): [0, 1], (1, one, 1, "Observation"): [2, 3], (1, one, 2, "Observation"): [4],
        (1, two, 0, "Observation"): [5, 6], (1, two, 1, "Observation"): [7], (9, None, 0, "Observation"): [99],
    }
    out = sinks.dataset({"patients": p, "bundles": b, "none": p.limit(0)}, f"file://{tmp_path}/json")
    assert {(r["name"], r["rows"]) for r in out.collect()} == {("patients", 2), ("bundles", 8), ("none", 0)}
    assert spark.read.json(f"file://{tmp_path}/json/bundles").count() == 8


def test_baselines_share_states_and_keep_their_keys_apart(spark, monkeypatch):
    import datetime as dt
    import random

    import numpy as np

    from wardlight.streaming import baselines, stateful

    monkeypatch.setattr(baselines, "GROUPS", 4)
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(None if p == 7 else p, rng.choice(["heart_rate", "other", None]), start + dt.timedelta(hours=rng.randrange(48)), p % 2**50 * 1_000 + i, float(rng.randrange(50, 120))) for p in [*range(20), 2**60 + 1] for i in range(30)]
    readings = spark.createDataFrame(rows, "patient_id long, parameter string, time timestamp_ntz, seq long, value double")
    out = stateful.run(spark, stateful.in_time_order(spark, readings, ["2024-01-02 00:00:00"], "time"), baselines.judged)
    assert out.count() == len(rows)
    got = {(r["patient_id"], r["parameter"]): r for r in baselines.latest(out).collect()}
    want = {}
    for p, name, _, _, v in rows:
        want.setdefault((p, name), []).append(v)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k]["n"] == len(v) and np.allclose([got[k][c] for c in ("mean", "sd", "median")], [np.mean(v), np.std(v), np.median(v)])
