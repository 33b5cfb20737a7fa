"""Steps whose memory, shuffles or time grew faster than the input: their plans, and their results beside plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulith import constants as K, plans
from granulith.fixtures import Workbench
from granulith.operators import curve
from granulith.plans import curves

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sql_plan(name, spark):
    return _plan(plans.queries()[name](spark, SF))


@pytest.mark.parametrize("name, joins", [("f13_power_law", 0), ("f14_verdict", 1), ("f14b_projection", 0)])
def test_no_exponent_is_a_row(spark, name, joins):
    """The scan is an expression of a key's row: nothing is joined to it, nothing 196 times as long is sent around."""
    text = _sql_plan(name, spark)
    assert "sequence(0, 195" not in "".join(x for x in text.splitlines() if "Generate explode" in x)
    assert text.count("BroadcastHashJoin") + text.count("SortMergeJoin") == joins


def test_power_law_equals_least_squares(spark):
    """Noisy points, nearly equal sizes, and points without a size or with a size of 0."""
    rng = np.random.default_rng(4)
    rows = [(r, f / 8, 0, float(s), float(0.9 - 0.7 * s ** -0.4 + rng.normal(0, 0.004)))
            for r in range(12) for f, s in enumerate(rng.integers(80, 3000, 8))]
    rows += [(20, f / 8, 0, 1e6 + f, 0.5 + 0.01 * f - 0.001 * f * f) for f in range(4)]
    rows += [(0, 2.0, 0, None, 0.1), *[(30, f / 8, 0, f * 100.0, 0.4 + f / 10) for f in range(4)]]
    pts = spark.createDataFrame(rows, "run_id int, frac double, draw int, n_train double, acc double")
    got = {r.run_id: r for r in curve.fit(pts, ["run_id"]).collect()}
    first, last, count = K.CURVE_C
    for run in [*range(12), 20]:
        n, y = np.array([(s, a) for r, _, _, s, a in rows if r == run and s]).T
        found = []
        for c in np.linspace(first, last, count):
            x = np.expm1(-c * np.log(n / n.min()))
            slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
            a, b = y.mean() - slope * (x.mean() + 1), -slope * n.min() ** c
            if b > 0 and y.max() - 1e-9 < a <= 1:
                found.append((((a - b * n ** -c - y) ** 2).sum(), c, a, b))
        assert (run in got) == bool(found)
        if found:
            assert (got[run].sse, got[run].c, got[run].a, got[run].b) == pytest.approx(min(found), rel=1e-6)
    assert 30 not in got and len(got) > 6


def test_pixels_made_from_few_rows_are_not_sent_around(spark):
    """A few image rows look small enough for a broadcast, their pixels are not."""
    from granulith.operators import match
    side = F.sequence(F.lit(0), F.lit(39))
    pixels = (spark.range(3).select(F.col("id").alias("image_id"), F.explode(side).alias("y")).withColumn("x", F.explode(side))
              .withColumn("label", F.when(F.col("x") > F.col("y"), F.col("x")).otherwise(0)))
    points = spark.range(300).selectExpr("id % 4 image_id", "id point_id", "id % 45 + 0.5 px", "id % 7 + 0.9 py")
    found = match.at_points(points, pixels)
    assert "Broadcast" not in _plan(found)
    want = {i: i % 45 if i % 4 < 3 and i % 45 < 40 and i % 45 > i % 7 else None for i in range(300)}
    assert {r.point_id: r.particle_id for r in found.collect()} == want


@pytest.mark.parametrize("name", ["a07_curve_export", "f12_curve_points", "f12b_curve_by_instrument", "f15_instrument_gap", "f15b_capacity"])
def test_runs_are_dealt_out_before_they_become_points(spark, name):
    """The tasks that read the small file of runs hold no points; one run's points lie together, so nothing else moves them."""
    w = Workbench(spark, SF)
    if name == "a07_curve_export":                               # the query itself reads what was written
        text = _plan(curve.export_table(w.curve_points, curves.by_instrument(w), ["CBS", "ETD"], curves.recalls(w)))
    else:
        text = _sql_plan(name, spark)
    dealt = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x]
    assert dealt and "pivotfirst" not in text
    lines = text.splitlines()
    made = [i for i, x in enumerate(lines) if "BroadcastNestedLoopJoin" in x]
    assert made and all(any("REPARTITION_BY_NUM" in x for x in lines[i:i + 4]) for i in made)
    assert not any("HashAggregate" in x or "Generate" in x for i in made for x in lines[i:i + 4])


@pytest.mark.parametrize("name", ["f12b_curve_by_instrument", "f15_instrument_gap", "f12_curve_points", "f15b_capacity"])
def test_runs_of_a_partition_do_not_grow_with_the_input(spark, monkeypatch, name):
    """1050 points, at most about 100 in a partition: the session's four would hold 37 of the 150 runs each."""
    monkeypatch.setattr("granulith.session.SPREAD_ROWS", 100, raising=False)
    monkeypatch.setattr("granulith.plans.registry._workbench", Workbench)       # no table that another test has dealt out
    held = (plans.queries()[name](spark, SF).groupBy(F.spark_partition_id().alias("part"))
            .agg(F.countDistinct("run_id").alias("runs")).collect())
    assert len(held) > 8 and max(r.runs for r in held) < 30 and sum(r.runs for r in held) <= 150


def test_statistics_of_a_stream_are_sums(spark, tmp_path, make):
    """A batch adds one row for each photo it brings, made by plain aggregation: no state is kept or updated photo by photo."""
    from granulith.streaming import ingest
    inbox, table, marks = (str(tmp_path / n) for n in ("inbox", "table", "marks"))
    df = make([{"image_id": i % 4, "particle_id": i, "diam_nm": 100.0 + i} for i in range(40)])
    df.orderBy("particle_id").repartitionByRange(4, "particle_id").write.parquet(f"{inbox}/delivery=0")
    ingest.run_stats(spark, df.schema, inbox, table, marks, files_per_batch=1).awaitTermination()
    assert not (tmp_path / "marks" / "state").exists()
    assert spark.read.parquet(f"{table}/rows").count() == 16
    got = {r.image_id: r for r in ingest.stats_now(spark, table).collect()}
    for i in range(4):
        sizes = 100.0 + np.arange(i, 40, 4)
        assert (got[i].count_total, got[i].mean_nm, got[i].std_nm) == pytest.approx((10, sizes.mean(), sizes.std()))


def test_names_are_dealt_out_and_folded_once(spark):
    text = plans.queries()["i03_known_words"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    made = [i for i, x in enumerate(lines) if "Generate explode" in x]
    assert made and any("REPARTITION_BY_NUM" in x for x in lines[made[-1]:])
    assert text.count("com.ibm.icu") <= 2


def test_masks_as_runs_match_as_pixels(spark, make):
    """Overlapping runs, some longer than a stretch and some left of the image, against pixels that the lowest id owns."""
    from granulith.operators import match
    rng = np.random.default_rng(2)
    runs = [(int(i), int(p), int(y), int(x), int(x + n)) for i, p, y, x, n in zip(
        rng.integers(0, 2, 60), rng.integers(1, 30, 60), rng.integers(0, 6, 60), rng.integers(-3, 150, 60), rng.integers(0, 90, 60))]
    masks = spark.createDataFrame(runs, "image_id long, label long, y int, x0 int, x1 int")
    owned = {}
    for i, p, y, x0, x1 in runs:
        for x in range(x0, x1 + 1):
            owned[i, y, x] = min(p, owned.get((i, y, x), p))
    parts = make([{"image_id": i, "particle_id": p, "cx": 1000.0, "cy": 1000.0} for i in range(2) for p in range(1, 25)])
    labels = spark.createDataFrame([(i, 100 * y + x, x + 0.25, y - 0.25) for i in range(2) for y in range(6) for x in range(0, 200, 3)],
                                   "image_id long, label_id long, cx double, cy double")
    got = {(r.image_id, r.cy + 0.25, r.cx - 0.25): r.particle_id for r in match.match_labels(labels, parts, runs=masks).collect()}
    assert got == {k: owned[k] if owned.get(k, 99) < 25 else None for k in got} and len(got) == 804 and any(got.values())


def test_confirmed_photos_make_no_folders(spark, tmp_path):
    """Many photos saved, a part of them again with fewer labels: folders grow with the saves."""
    from granulith.sources import label_files
    path = str(tmp_path / "confirmed")
    rows = spark.range(900).selectExpr("id % 300 image_id", "concat('p', id % 300) stem", "id label_id", "'janus' class")
    gold = spark.range(3).selectExpr("id image_id")
    label_files.save_confirmed(rows, gold, path)
    label_files.save_confirmed(rows.where("image_id % 5 = 0 and label_id < 300"), gold, path)
    assert sum(p.is_dir() for p in (tmp_path / "confirmed").rglob("*")) < 10
    got = {r.image_id: r["count"] for r in label_files.read_confirmed(spark, path).groupBy("image_id").count().collect()}
    assert got == {i: 1 if i % 5 == 0 else 3 for i in range(3, 300)}


@pytest.mark.parametrize("by_image", [False, True])
def test_exported_files_are_compressed_and_bounded(spark, tmp_path, make, monkeypatch, by_image):
    from granulith.sources import session_tables
    monkeypatch.setattr(session_tables, "EXPORT_ROWS", 10, raising=False)
    rows = make([{"image_id": i % 2, "particle_id": i, "pattern_probs": [0.5, 0.25]} for i in range(60)]).coalesce(1)
    session_tables.export_csv(rows, str(tmp_path / "csv"), by_image)
    assert len(list((tmp_path / "csv").rglob("*.csv.gz"))) == 6 and not list((tmp_path / "csv").rglob("*.csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert {(int(r.image_id), int(r.particle_id), r.pattern_probs) for r in back} == {(i % 2, i, "0.5 0.25") for i in range(60)}
