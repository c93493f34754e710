"""Each query with SQL gives the rows of its SQL; the others are held against plain Python."""

import pytest
from conftest import values

import __spark_entry__ as e
from wardlight.plans import catalog

SPARK, SQL = e.queries(), catalog.ORACLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    got, want = SPARK[name](spark, sf_dir), duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert values([tuple(r) for r in got.collect()], got.columns) == values(want.fetchall(), columns)


def test_every_query_is_tested_or_listed():
    assert set(catalog.QUERIES) - set(SQL) == {"name_similarity", "monte_carlo"}


def test_hl7_edges(spark):
    from wardlight.sources import hl7

    text = "MSH|^~\\&|lab\nPID|1||77^x||\nOBX|1|NM|718-7^Hb^LN||1,234.5|g/L^u|1-2|H|||P|||20240102\nOBX|2|ST|^||free"
    got = hl7.observations(spark.createDataFrame([(text,), ("no header",), (None,)], "message string")).orderBy("value_raw").collect()
    assert [(r["mrn"], r["value_numeric"], r["units"], r["status"], r["observation_datetime"]) for r in got] == [("77", 1234.5, "g/L", "preliminary", "2024-01-02T00:00:00Z"), ("77", None, "", "final", None)]


def test_ranks_without_collected_groups(spark, sf_dir):
    import random

    from wardlight.operators import monitoring

    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    groups = {"a": [rng.gauss(0, 50) for _ in range(1001)] + [0.0, -0.0, inf, -inf], "b": [1.5] * 40 + [2.5] * 40, None: [7.0, 1e-300, -1e-300], "nan": [1.0, nan, nan], "none": []}
    rows = [(g, x) for g, v in groups.items() for x in [*v, None]]
    rng.shuffle(rows)
    got = {r["g"]: r for r in monitoring.latency(spark.createDataFrame(rows, "g string, value double"), ["g"], "value").collect()}
    assert set(got) == set(groups) and got["none"]["n"] == 0 and got["none"]["p99"] is None
    for g, v in groups.items():
        v = sorted((x for x in v if x == x)) + [x for x in v if x != x]
        n = len(v)
        want = [0.5 * v[(n - 1) // 2] + 0.5 * v[n // 2], v[min(int(n * 0.95), n - 1)], v[min(int(n * 0.99), n - 1)]] if n else []
        assert [repr(got[g][c]) for c in ("p50", "p95", "p99")][: len(want)] == [repr(x) for x in want]
    for name in ("latency_percentiles", "observation_quality"):
        plan = SPARK[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "median" not in plan and "percentile" not in plan


def test_names_of_the_whole_blocking(spark, sf_dir):
    from wardlight.sources import fixtures as fx

    p = [(r["patient_id"], r["ssn4"], r["mrn"], (r["dob"], r["last_name"][:3])) for r in fx.patients(spark, sf_dir).collect()]
    want = {(x[0], y[0]) for x in p for y in p if x[0] < y[0] and any(i is not None and i == j for i, j in zip(x[1:], y[1:]))}
    assert {(r["id_a"], r["id_b"]) for r in SPARK["name_similarity"](spark, sf_dir).collect()} == want
