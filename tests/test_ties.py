"""Queries whose rows the last bit decides, against their SQL on sessions of few strides."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strideline.functions import matrices
from strideline.operators import clusters, models
from strideline.plans import catalogue, catalogue_model  # noqa: F401 - adds its queries


@pytest.fixture(scope="module")
def few_strides(tmp_path_factory):
    """A folder whose ``events`` are sf0.01's, dealt to sessions of some 12 samples."""
    folder = str(tmp_path_factory.mktemp("ties"))
    duckdb.sql(f"copy (select * replace ((event_id * 7919 + i * 104729) % 2503 + i * 2503 as user_id, event_id * 3 + i as event_id) from '/root/testdata/sf0.01/events.parquet', range(3) t(i) order by event_id) to '{folder}/events.parquet'")
    return folder


def by_key(frame):
    return {(r["session"], r["stride_id"]): r for r in frame.to_dict("records")}


def differing(spark, folder, name):
    """Rows (of all) in which a query and its SQL differ."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    ours, theirs = by_key(catalogue.QUERIES[name](spark, folder).toPandas().astype(object)), by_key(con.execute(catalogue.ORACLE[name]).fetchdf().astype(object))
    assert ours.keys() == theirs.keys()
    same = lambda a, b: a == b or (a is None or a != a) and (b is None or b != b)
    return {k: {c: (v, theirs[k][c]) for c, v in r.items() if not same(v, theirs[k][c])} for k, r in ours.items() if not all(same(v, theirs[k][c]) for c, v in r.items())}, len(ours)


def test_strides_as_far_as_their_threshold(spark, few_strides):
    """Both strides of a baseline of two lie at its threshold."""
    wrong, n = differing(spark, few_strides, "stride_analysis")
    assert n > 1000 and not wrong


@pytest.fixture(scope="module")
def two_strides(tmp_path_factory):
    """Sessions of two strides and 30 samples: most have many samples for a baseline's strides, as the given tables do."""
    folder, n, rng = str(tmp_path_factory.mktemp("two")), 600, np.random.default_rng(5)
    strikes = np.concatenate([np.sort(rng.choice(30, 3, replace=False)) + 30 * i for i in range(n)])
    kinds = rng.choice(["view", "error", "purchase", "click"], 30 * n)
    kinds[strikes] = "signup"
    columns = {"event_id": np.arange(30 * n), "user_id": np.repeat(np.arange(n), 30), "event_type": kinds, "value": np.round(rng.exponential(50, 30 * n), 2), "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, 30 * n)]}
    rows = pa.table(columns).append_column("ts", pa.array(np.arange(30 * n) % 30 * 14_400_000_000 + np.arange(30 * n) + 1_704_067_200_000_000, pa.timestamp("us")))
    pq.write_table(rows, f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stride_analysis", "stride_table"])
def test_spread_of_two_distances_but_for_the_last_bit(spark, two_strides, name):
    """Whether the farther stride is beyond the spread is told by the order in which the spread takes the two."""
    wrong, n = differing(spark, two_strides, name)
    assert n > 300 and not wrong


def test_logarithms_and_squares_as_the_sql_rounds_them():
    x = np.random.default_rng(6).exponential(1, 100_000)
    rows = pa.table({"i": np.arange(len(x)), "x": x})  # noqa: F841 - read by the SQL
    want = duckdb.sql("select ln(x) as log, x ** 2 as square from rows order by i").fetchnumpy()
    assert (matrices.c_log(x) == want["log"]).all() and (matrices.c_squares(x) == want["square"]).all()
    assert np.isinf(matrices.c_squares(np.array([1e300]))).all()


def test_distances_of_arrays(spark):
    rows = [([1.0, 2.0, 2.0], [0.0, 0.0, 0.0], 3.0), (None, [1.0], None), ([1.0], None, None), ([1.0, 2.0], [1.0], None), ([1.0, None], [1.0, 2.0], None), ([], [], 0.0), ([1e300], [0.0], float("inf"))]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>, d double").select(models.distance("a", "b").alias("got"), "d").collect()
    assert [r["got"] for r in got] == [r["d"] for r in got]


def test_moments_of_runs():
    rng = np.random.default_rng(3)
    size = np.array([1, 2, 5, 40, 2, 3])
    begin = np.cumsum(size) - size
    x, k = rng.normal(size=size.sum()), rng.normal(size=size.sum())
    got = matrices.moments_2x2(x, k, begin, size)
    assert np.isnan(got[0]).all()
    for row, b, n in zip(got[1:], begin[1:], size[1:]):
        want = np.cov(x[b : b + n], k[b : b + n])
        assert np.allclose(row, [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-12)
        alone = matrices.moments_2x2(x[b : b + n], k[b : b + n], np.array([0]), np.array([n]))[0]
        assert (row == alone).all()
    assert matrices.moments_2x2(x[:0], k[:0], begin[:0], size[:0]).shape == (0, 3)
    assert matrices.fused(np.array([1 + 2.0**-30]), np.array([1 - 2.0**-30]), np.array([-1.0]))[0] == -(2.0**-60)
    assert np.isinf(matrices.fused(np.array([1e300]), np.array([1e300]), np.array([1.0]))[0])


def test_two_means_of_a_value_between_them(spark, tmp_path):
    """The middle one of three even steps is as far from both ends, but for the last bit; each session has another."""
    duckdb.sql(f"copy (select s * 3 + i as event_id, timestamp '2024-01-01' + to_hours(i) as ts, s as user_id, 'view' as event_type, (s % 400 + 1 + i * (600 + s % 7)) / 100.0::double as value, '{{\"k\": 1}}' as props from range(2000) a(s), range(3) b(i) order by all) to '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = {r[0]: r[1:] for r in con.execute(catalogue.ORACLE["two_means_threshold"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in catalogue.QUERIES["two_means_threshold"](spark, str(tmp_path)).collect()}
    assert got == want and len({v[0] > 9 for v in got.values()}) == 2
    assert clusters.two_means_threshold(np.array([np.nan, 1.0, 9.0])) == clusters.two_means_threshold(np.array([1.0, 9.0]))
    assert clusters.two_means_threshold(np.array([np.nan])) is None


def test_interval_ends_as_the_sql_rounds_them(spark):
    """Differences of two decimals are equal but for the last bit, and strides lie at the ends of the intervals."""
    names = catalogue._METRIC_COLUMNS
    rng = np.random.default_rng(11)
    rows = [(True, *(float(a - b) for a, b in zip(np.round(rng.uniform(20, 30, len(names)), 2), np.round(rng.uniform(0, 9, len(names)), 1)))) for _ in range(508)] + [(False, *[1e9] * len(names)), (True, *[None] * len(names))]
    kind = "valid boolean, " + ", ".join(f"{c} double" for c in names)
    strides = spark.createDataFrame(rows, kind).withColumns({"session": F.lit(1), "stride_id": F.monotonically_increasing_id()})
    got = {r["metric"]: (r["lower"], r["median"], r["upper"]) for r in catalogue.ranges_of(strides).collect()}
    con = duckdb.connect()
    for i, c in enumerate(names):
        values = [r[i + 1] for r in rows if r[0]]
        want = con.execute("select quantile_cont(v, 0.05), quantile_cont(v, 0.5), quantile_cont(v, 0.95) from (select unnest(?::double[]) as v)", [values]).fetchone()
        assert got[c] == want, c
