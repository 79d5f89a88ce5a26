"""Edges of time-series operators that the catalogue's tables don't show."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tagweave.operators import reports, series

START = datetime(2024, 1, 1)


def his(spark, values, minutes=15, point="p"):
    rows = [(point, START + timedelta(minutes=minutes * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "point string, ts timestamp_ntz, v0 double")


def test_periods_end_at_the_next_sample_or_the_last(spark):
    found = series.periods(his(spark, [1.0, 9.0, 9.0, 1.0, None, 9.0]), ["point"], F.col("v0") > 5).orderBy("start").collect()
    assert [(r.start.minute + 60 * r.start.hour, r.duration_s, r.samples) for r in found] == [(15, 1800.0, 2), (75, 0.0, 1)]


def test_sessions_merge_at_exactly_the_gap(spark):
    rows = [("p", START, 1.0), ("p", START + timedelta(hours=2), 2.0), ("p", START + timedelta(hours=4, seconds=1), 3.0)]
    df = spark.createDataFrame(rows, "point string, ts timestamp_ntz, v0 double")
    assert sorted(r.n for r in series.sessions(df, ["point"], 7200, "v0").collect()) == [1, 2]


def test_nothing_in_nothing_out(spark):
    empty = his(spark, [1.0]).limit(0)
    for out in (
        series.periods(empty, ["point"], F.col("v0") > 0), series.gaps(empty, ["point"]), series.outliers(empty, ["point"], "v0"),
        series.transitions(empty, ["point"], "v0"), series.rollup(empty, ["point"], "v0", "1 hour"), series.longest_streak(empty, ["point"], "v0", ["ts"]),
        series.baseline_deviation(empty, "2024-01-01 00:00:00", "v0"), reports.comfort(empty, ["point"], "v0", 0, 1),
    ):
        assert out.collect() == []


def test_one_sample_has_no_rate(spark):
    one = his(spark, [5.0])
    assert series.rate_of_change(one, ["point"], "v0").first().max_rate is None
    assert series.transitions(one, ["point"], "v0").first().transitions == 0
    assert series.outliers(one, ["point"], "v0").first().n_outliers == 0


def test_buckets_align_to_midnight(spark):
    odd = his(spark, [1.0] * 10, minutes=7)
    starts = {(r.bucket.hour, r.bucket.minute) for r in series.rollup(odd, ["point"], "v0", "15 minutes").collect()}
    assert starts == {(0, 0), (0, 15), (0, 30), (0, 45), (1, 0)}


def test_peak_takes_the_first_of_ties(spark):
    assert series.peak(his(spark, [1.0, 7.0, 7.0]), ["point"], "v0").first().peak_ts == START + timedelta(minutes=15)


def test_interpolation_carries_forward(spark):
    df = his(spark, [1.0, 2.0], minutes=90)
    out = series.interpolate(df, ["point"], "v0", "1 HOUR", "2024-01-01 00:00:00", "2024-01-01 03:00:00").orderBy("ts").collect()
    assert [r.v0 for r in out] == [1.0, 1.0, 2.0, 2.0]


def test_ladders_and_issues(spark):
    row = spark.range(1).select(
        reports.ladder([(F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c")], "d").alias("s"),
        reports.issue_text([(F.lit(True), "x"), (F.lit(None).cast("boolean"), "y"), (F.lit(True), "z")]).alias("t"),
        reports.ratio(F.lit(1.0), F.lit(0.0)).alias("r"),
    ).first()
    assert tuple(row) == ("b", "x; z", None)


def test_slices_of_a_hot_point_give_what_one_window_gives(spark):
    """One point with most samples, null keys and times, equal times, runs across borders."""
    import random

    from tagweave.operators import slices

    rng = random.Random(3)
    rows, at = [], START
    for i in range(900):
        at += timedelta(minutes=rng.choice([0, 1, 7, 40, 900]) if i % 50 else 4000)
        point = None if i % 31 == 0 else "hot" if i % 10 else f"p{i % 3}"
        rows.append((point, None if i % 211 == 5 else at, i, None if i % 13 == 0 else float((i // 60) % 2 * 9 + i % 2), i // 70))
    df = spark.createDataFrame(rows, "point string, ts timestamp_ntz, id int, v0 double, state int").repartition(5)
    other = df.where("id % 9 = 4").select("point", "ts", F.col("id").cast("double").alias("w")).groupBy("point", "ts").agg(F.max("w").alias("w"))
    keys, by = ["point"], ["id"]
    calls = {
        "before": lambda s: series.with_previous(df, keys, ["ts", "id"], ["v0", "id"], s),
        "beside": lambda s: slices.neighbours(df, keys, ["ts", "id"], ["v0"], ["id", "ts"], s),
        "islands": lambda s: series.islands(df, keys, ["ts", "id"], F.col("v0") > 5, slice_s=s),
        "periods": lambda s: series.periods(df, keys, F.col("v0") > 5, order=by, slice_s=s),
        "sessions": lambda s: series.sessions(df, keys, 3600, "v0", order=by, slice_s=s),
        "streak": lambda s: series.longest_streak(df, keys, "state", ["ts", "id"], s),
        "rate": lambda s: series.rate_of_change(df, keys, "v0", order=by, slice_s=s),
        "gaps": lambda s: series.gaps(df, keys, order=by, slice_s=s),
        "transitions": lambda s: series.transitions(df, keys, "state", order=by, slice_s=s),
        "as of": lambda s: series.as_of(df, other, keys, "w", slice_s=s),
        "grid": lambda s: series.interpolate(other, keys, "w", "6 hours", "2024-01-01", "2024-01-20", slice_s=s),
    }
    for name, call in calls.items():
        whole = call(None)
        expect = sorted(map(repr, whole.collect()))
        for width in (1800.0, 86400.0, 1e9):
            parted = call(width)
            assert parted.columns == whole.columns, name
            assert sorted(map(repr, parted.collect())) == expect, (name, width)
    spread = slices._sliced(df, "ts", 86400.0).where("point = 'hot'").groupBy("__slice").count()
    assert spread.agg(F.max("count")).first()[0] < 0.2 * 900
    assert slices.neighbours(df.limit(0), keys, ["ts"], ["v0"], width_s=60).count() == 0
