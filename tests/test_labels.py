"""Overlay, clicks, matching, evaluation and calibration against plain-Python restatements."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulith.functions import gates
from granulith.operators import calibrate, evaluate, labels, match, overlay, review


def test_overlay_precedence(make, spark):
    df = make([{"is_solid": True, "pattern": "janus"}] * 6 + [{"solidity": 0.5}])
    ov = spark.createDataFrame([
        (1, 1, "view_exclude", ""), (1, 1, "measure_include", ""), (1, 1, "class", "stripe"),
        (1, 2, "measure_exclude", ""), (1, 2, "measure_include", ""), (1, 3, "class", "unknown"),
        (1, 4, "class", "solid:janus"), (1, 5, "class", "undercooled"), (1, 7, "class", "lamellar")],
        "image_id long, particle_id long, kind string, value string")
    out = overlay.apply_view(df, ov).withColumn("m", gates.measurable()).orderBy("particle_id").collect()
    got = [(r.is_solid, r.pattern, r.excluded, r.unclassified, r.user_solid, r.m) for r in out]
    assert got == [(False, "", True, False, False, False), (True, "janus", False, False, False, False),
                   (False, "", False, True, False, True), (True, "", False, False, True, True),
                   (False, "", False, False, False, True), (True, "janus", False, False, False, True),
                   (True, "lamellar", False, False, False, False)]       # naming keeps the gate's verdict


def test_clicks_cross_run_borders(spark, monkeypatch):
    """Folding in runs of 3 equals folding one by one."""
    monkeypatch.setattr(overlay, "CHUNK", 3)
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for pid in range(30):
        state = 0
        for seq in range(int(rng.integers(1, 15))):
            cls = overlay.CLICKS[int(rng.integers(0, 7)) if rng.random() < 0.5 else pid % 7]
            rows.append((1, pid, seq, cls))
            state = overlay._click(state, cls)
        n = len(overlay.OVERRIDE_VALUES)
        want[pid] = (overlay.OVERRIDE_VALUES[state % n] or None, state // n % 2 == 1, state >= 2 * n)
    log = spark.createDataFrame(rows, "image_id long, particle_id long, seq int, cls string")
    got = {r.particle_id: (r.value, r.named, r.view_excluded) for r in overlay.fold_class_clicks(log).collect()}
    assert got == want


def test_click_cycle():
    v = overlay.OVERRIDE_VALUES
    n = len(v)
    s = overlay._click(0, "janus")
    assert v[s % n] == "janus"
    s = overlay._click(s, "janus")
    assert v[s % n] == "solid:janus"
    assert v[overlay._click(s, "janus") % n] == ""
    assert v[overlay._click(overlay._click(0, "undercooled"), "undercooled") % n] == "unknown"


@pytest.mark.parametrize("masks", [False, True])
def test_match_equals_brute_force(spark, masks):
    rng = np.random.default_rng(5)
    parts = [(i % 3, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (300, 2)) / 2)]
    labs = [(i % 3, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 70, (120, 2)) / 2)]
    labs += [(0, 1000 + i, 5.5, 5.5) for i in range(200)]                     # many labels at one position
    mask = {(0, 6, 6): 9, (1, 10, 10): 100000, (2, 12, 12): 5} if masks else {}
    p = spark.createDataFrame(parts, "image_id long, particle_id long, cx double, cy double")
    ls = spark.createDataFrame(labs, "image_id long, label_id long, cx double, cy double")
    px = spark.createDataFrame([(i, y, x, v, 0) for (i, y, x), v in mask.items()],
                               "image_id long, y int, x int, label int, grey int") if masks else None
    known = {(q[0], q[1]) for q in parts}

    def want(lab):
        owner = mask.get((lab[0], round(lab[3]), round(lab[2])))
        if owner is not None and (lab[0], owner) in known:
            return owner
        near = [((q[2] - lab[2]) ** 2 + (q[3] - lab[3]) ** 2, q[1]) for q in parts if q[0] == lab[0]]
        best = min(near)
        return best[1] if best[0] <= 9 else None

    got = {r.label_id: r.particle_id for r in match.match_labels(ls, p, px).collect()}
    assert got == {lab[1]: want(lab) for lab in labs}


def test_hot_image_is_split_at_run_time(spark):
    """One image owns a third of the labels: no copies of the other side, the same result, and a split join."""
    labs = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000 + 2).alias("image_id"),
                                      F.col("id").alias("label_id"), (F.col("id") % 50).cast("double").alias("cx"), F.lit(1.0).alias("cy"))
    parts = spark.range(20_000).select((F.col("id") % 5001 + 1).alias("image_id"), F.col("id").alias("particle_id"),
                                       (F.col("id") % 50).cast("double").alias("cx"), F.lit(0.0).alias("cy"))
    plain = match.match_labels(labs, parts).orderBy("label_id").collect()
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        joined = labels.refuse_golden(labs, parts.where("image_id < 3"))
        assert joined.count() == labs.where("image_id >= 3").count()
        hot = labs.join(parts.select("image_id").distinct(), "image_id")
        df = match.match_labels(labs, parts)
        got = df.collect()
        plan = df._jdf.queryExecution().toString()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)
        assert "explode(sequence(0, 31" not in plan and hot.count() == labs.count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_metrics_rules(spark):
    rows = [("janus", "janus", 3), ("janus", "nopat", 1), ("stripe", "nopat", 2), ("nopat", "nopat", 4)]
    df = spark.createDataFrame([("all", *r) for r in rows], "k string, truth string, pred string, n long")
    conf = evaluate.confusion(df, ["k"])
    head = evaluate.headline(conf, ["k"]).collect()[0]
    per = {r["class"]: r for r in evaluate.per_class(conf, ["k"]).collect()}
    assert (head.n, head.acc) == (10, 0.7)
    assert per["composite"].recall is None and per["stripe"].prec == 0.0 and per["stripe"].f1 == 0.0
    f1 = [2 * 0.75 / 1.75, 0.0, 2 * (4 / 7) / (1 + 4 / 7)]
    assert head.macro_f1 == pytest.approx(np.mean(f1))          # classes without truth do not count


def _balanced(p, y, t):
    pos, neg = y == 1, y == 0
    return None if not pos.any() or not neg.any() else 0.5 * ((p[pos] >= t).mean() + (p[neg] < t).mean())


def _best(p, y):
    best, cut = -1.0, None
    for c in range(5, 96):
        s = _balanced(p, y, c / 100)
        if s is not None and s > best + 1e-12:
            best, cut = s, c / 100
    return cut


def test_leave_one_photo_out(spark):
    rng = np.random.default_rng(2)
    photo = rng.choice(["a", "b", "c", "d", "one"], 400, p=[.4, .2, .2, .1, .1])
    y = (rng.random(400) < 0.5).astype(int)
    y[photo == "one"] = 1                                        # a one-class photo carries no weight
    p = np.clip(np.round(0.3 * y + rng.random(400) * 0.7, 2), 0, 1)
    df = spark.createDataFrame([("t", ph, float(a), int(b), 0.5) for ph, a, b in zip(photo, p, y)],
                               "name string, photo string, p double, y int, current double")
    cuts = calibrate.cut_counts(df)
    best = calibrate.best_cuts(cuts).collect()[0]
    assert best.cut == _best(p, y)
    fit = cur = n = 0.0
    for ph in sorted(set(photo)):
        te = photo == ph
        t = _best(p[~te], y[~te])
        new, old = _balanced(p[te], y[te], t), _balanced(p[te], y[te], 0.5)
        if new is None:
            continue
        fit, cur, n = fit + new * te.sum(), cur + old * te.sum(), n + te.sum()
    got = calibrate.leave_one_out(cuts).collect()[0]
    assert (got.fit_score, got.current_score) == pytest.approx((fit / n, cur / n))


def test_too_few_photos_score_nothing(spark):
    df = spark.createDataFrame([("t", str(i % 3), i / 30, i % 2, 0.5) for i in range(30)],
                               "name string, photo string, p double, y int, current double")
    got = calibrate.leave_one_out(calibrate.cut_counts(df)).collect()[0]
    assert got.fit_score is None and got.n_photos == 3


@pytest.mark.parametrize("n", [37, 70_001])
def test_signature(spark, n):
    """One formula for small and large photos, whatever the order; a single changed label shows."""
    df = spark.range(3, n + 3).selectExpr("1L as image_id", "id as particle_id", "if(id % 5 = 0, 'exclude', 'janus') as cls")
    sums = [0] * 4
    for i in range(3, n + 3):
        h = hashlib.md5(f"{i}:{'x' if i % 5 == 0 else 'janus'}".encode()).hexdigest()
        sums = [s + int(h[8 * k:8 * k + 8], 16) for k, s in enumerate(sums)]
    text = ":".join(map(str, [n, *sums]))
    own = lambda d: labels.signature(d, ["image_id"]).collect()[0].signature
    assert own(df) == hashlib.sha1(text.encode()).hexdigest()[:16] == own(df.orderBy(F.desc("particle_id")))
    assert own(df.withColumn("cls", F.when(F.col("particle_id") == 7, "stripe").otherwise(F.col("cls")))) != own(df)


def test_verdicts_are_idempotent(spark):
    v = spark.createDataFrame([(1, 1, 1, "janus", "janus"), (1, 1, 2, "stripe", "janus"), (1, 2, 1, "janus", "janus")],
                              "image_id long, particle_id long, seq int, cls string, model_cls string")
    once = review.accepted(v, ["image_id"]).collect()
    again = review.accepted(v.unionAll(v), ["image_id"]).collect()
    assert once == again and (once[0].n_seen, once[0].n_fixed) == (2, 1)
