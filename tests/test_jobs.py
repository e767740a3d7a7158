"""The jobs on copies of the tables: growing input, late samples, reruns, odd rows."""

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import stride_ledger, text_log_screen
from strideline.operators import folds, live, segments
from strideline.plans import catalogue_jobs  # noqa: F401 - adds its queries
from strideline.schema import of_events, samples

SMALL = "/root/testdata/sf0.001"


def plain_strides(rows):
    """Strides of samples as the batch operators give them."""
    return segments.metrics(segments.cut(rows)).withColumn("stride_id", F.col("stride_id").cast("int"))


def listed(df, *columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


KEYS = ["session", "stride_id", "n_samples", "t_start", "t_end", "swing_time", "stance_time", "swing_ratio", "excursion", "mean_x", "reject_reason"]


def test_closer_equals_batch_strides(spark):
    rows = samples(spark, SMALL)
    rows = rows.withColumn("x", F.when(F.col("seq") % 17 == 0, None).otherwise(F.col("x")))
    more = [*KEYS, "peak_k", "n_swing", "n_stance", "n_not_finite", "rms_x"]
    got = live.closed(folds.run_machine(rows, live.StrideCloser()))
    assert got.count() > 50
    assert listed(got, *more) == listed(plain_strides(rows).withColumn("peak_k", F.col("peak_k").cast("double")), *more)


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def add(events, folder, condition):
    """One more file of events in a folder."""
    events.where(condition).coalesce(1).write.mode("append").parquet(folder)


def test_ledger_over_growing_input(spark, place):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    early, late = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    run = lambda: stride_ledger.run(spark, f"{place}/in", f"{place}/ledger", f"{place}/mark")
    add(events, f"{place}/in", early)
    first = listed(run(), *KEYS)
    assert first == listed(plain_strides(of_events(events.where(early))), *KEYS)
    assert listed(run(), *KEYS) == first  # nothing new
    add(events, f"{place}/in", ~early & ~late)
    assert len(run().collect()) > len(first)
    add(events, f"{place}/in", late)
    whole = run()
    assert listed(whole, *KEYS) == listed(plain_strides(of_events(events)), *KEYS)
    assert set(first) <= set(listed(whole, *KEYS))
    # a file of old samples: kept for review, strides stay
    add(events, f"{place}/in", early)
    after = run()
    assert listed(after.where("kind = 'stride'"), *KEYS) == listed(whole.where("kind = 'stride'"), *KEYS)
    assert listed(after.where("kind = 'late'"), "seq") == listed(events.where(early), F.col("event_id"))
    assert after.where("day != date_add(date'1970-01-01', cast(floor(t_end / 24) as int))").count() == 0


def test_ledger_takes_files_in_turn(spark, place):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    cuts = ["2024-01-01", "2024-01-08", "2024-01-16", "2024-03-01"]
    for a, b in zip(cuts, cuts[1:]):
        add(events, f"{place}/in", F.col("ts").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))
    got = stride_ledger.run(spark, f"{place}/in", f"{place}/ledger", f"{place}/mark", stride_ledger.Settings(files_per_batch=1))
    assert listed(got, *KEYS) == listed(plain_strides(of_events(events)), *KEYS)


def test_ledger_of_odd_rows(spark, place):
    spark.createDataFrame([], stride_ledger.SAMPLES).write.parquet(f"{place}/none")
    assert stride_ledger.run(spark, f"{place}/none", f"{place}/l0", f"{place}/m0").count() == 0
    rows = [(1, "2024-01-01 00:00:00", 7, "signup", 1.0, None), (2, "2024-01-01 01:00:00", 7, None, None, "{}"), (None, "2024-01-01 02:00:00", 7, "click", 3.0, "x"), (4, None, 7, "signup", 1.0, None), (5, "2024-01-01 03:00:00", None, "signup", 1.0, None), (6, "2024-01-01 04:00:00", 7, "signup", 5.0, '{"k": 3}'), (6, "2024-01-01 04:00:00", 7, "signup", 5.0, '{"k": 3}')]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.withColumn("kind", F.lit("clash")).withColumn("session", F.lit(1)).write.parquet(f"{place}/odd")
    got = stride_ledger.run(spark, f"{place}/odd", f"{place}/l1", f"{place}/m1")
    assert listed(got, "session", "kind", "stride_id", "n_samples", "excursion", "swing_time", "stance_time") == sorted([(7, "stride", 0, 4, 4.0, 2.0, 2.0), (7, "late", None, None, None, None, None)], key=str)


# --- text log screen

LOGS = [(i, f"word{i % 7} plain text of log {i}\nline two", "a") for i in range(30)] + [(30, "A B C D 1234567890 " * 40, "a"), (31, None, "a"), (32, " \n\t", None), (33, "one log of no source", None), (34, "", ""), (35, "x", ""), (35, "x", ""), (None, "Word " * 50000, "b")]


def test_screen_equals_plain_version(spark, place):
    logs = spark.createDataFrame(LOGS, "doc_id long, text string, source string")
    logs.withColumn("words", F.lit("clash")).withColumn("verdict", F.lit(1)).withColumn("session", F.lit(2)).write.parquet(f"{place}/in")
    got = text_log_screen.run(spark, f"{place}/in", f"{place}/out")
    names = ["doc_id", "source", "verdict", "strongest", "distance"]
    first = listed(got, *names)

    def measure(text):
        words, solid = (text or "").split(), "".join((text or "").split())
        lines = (text or "").count("\n") + 1
        return [len(words), len(solid) / max(len(words), 1), len(words) / lines, sum(c.isdigit() for c in solid) / max(len(solid), 1), sum("A" <= c <= "Z" for c in solid) / max(len(solid), 1)]

    want = []
    for source in {r[2] for r in LOGS}:
        rows = [r for r in LOGS if r[2] == source]
        want += [(r[0], source, "blank", None, None) for r in rows if not (r[1] or "").split()]
        rows = [r for r in rows if (r[1] or "").split()]
        x = np.array([measure(r[1]) for r in rows]).reshape(-1, 5)
        if len(x):
            z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-8)
            d = np.sqrt((z**2).sum(1))
            for r, di, zi in zip(rows, d, z):
                top = max(zip(np.abs(np.round(zi, 6)).tolist(), text_log_screen.MEASURES))
                want.append((r[0], source, "unusual" if di > d.mean() + 3 * d.std() + 1e-9 else "usual", top[1], round(float(di), 6)))
    assert first == sorted(want, key=str) and any(r[0] == 30 and r[2] == "unusual" for r in first)
    again = text_log_screen.run(spark, f"{place}/in", f"{place}/out")
    assert listed(again, *names) == first
    assert spark.read.parquet(f"{place}/out/screened").count() == len(LOGS)
    assert spark.read.parquet(f"{place}/out/profile").count() == 4


def test_screen_of_nothing(spark, place):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{place}/in")
    assert text_log_screen.run(spark, f"{place}/in", f"{place}/out").count() == 0


def test_counts_of_odd_texts(spark):
    """Each text by itself: neither empty ones nor a neighbour's last word change a count, and no pattern is matched character by character."""
    texts = ["", "a", "b c", None, "", "  x", "end", "Ü ß 𝔘9\n\nZ\r\n", "\x0b\x0c\t", "\x1f\x08 A1", "12 34\n", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1)
    found = rows.select("doc_id", "text", text_log_screen.counts("text").alias("n")).select("text", "n.*").where("doc_id != 1").collect()
    assert len(found) == len(texts) - 1
    for text, *got in found:
        text = text or ""
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        want = [len(re.findall(r"[^\x20\x09-\x0D]+", text)), len(solid), text.count("\n") + 1, sum("0" <= c <= "9" for c in solid), sum("A" <= c <= "Z" for c in solid)]
        assert got == want, text
    assert "regexp" not in text_log_screen.measured(rows)._jdf.queryExecution().toString()
