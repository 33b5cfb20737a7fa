"""Each row of these tables is one rule of the decision chain."""

import pytest
from pyspark.sql import functions as F

from granulith.functions import classes, gates, text


def column(df, c):
    return [r[0] for r in df.orderBy("particle_id").select(c).collect()]


def test_measurable_gate(make):
    rows = [({}, True), ({"edge_cut": 0.9}, False), ({"minor_px": 11.0, "major_px": 40.0}, False),
            ({"minor_px": 16.0, "major_px": 40.0, "diam_px": 25.0}, True),
            ({"minor_px": 16.0, "major_px": 40.0, "diam_px": 25.0, "edge_cut": 0.1}, False),
            ({"solidity": 0.89}, False), ({"diam_px": 38.0}, False), ({"excluded": True}, False),
            ({"excluded": True, "user_measurable": True}, True), ({"user_measurable": False}, False),
            ({"major_px": 0.0, "minor_px": 0.0}, False)]
    assert column(make([r for r, _ in rows]), gates.measurable()) == [e for _, e in rows]


def test_reclassify(make):
    rows = [
        ({}, (True, "janus", False)),
        ({"facet_frac": 0.49}, (False, "", False)),
        ({"diam_nm": 199.0}, (False, "", False)),
        ({"facet_frac": 0.52}, (False, "", False)),                       # weak janus, not sure enough
        ({"bright": -31.0}, (False, "", True)),                          # too dim to trust a pattern
        ({"diam_nm": 299.0}, (False, "", False)),                        # janus needs 300 nm
        ({"diam_nm": 299.0, "facet_frac": 0.9}, (True, "", False)),      # sure solid without a pattern
        ({"diam_nm": 250.0, "pattern_probs": [0.05, 0.85, 0.05, 0.05]}, (True, "stripe", False)),
        ({"pattern_probs": [0.25, 0.25, 0.25, 0.25], "facet_frac": 0.6}, (True, "janus", False)),  # first of a tie
        ({"pattern_probs": []}, (True, "", False)),
        ({"pattern_probs": None}, (True, "", False)),
        ({"solidity": 0.6}, (True, "", False)),                          # not eligible: solid stays unnamed
        ({"classifiable": False}, (False, "", False)),
    ]
    out = gates.reclassify(make([r for r, _ in rows])).orderBy("particle_id").collect()
    assert [(r.is_solid, r.pattern, r.excluded) for r in out] == [e for _, e in rows]


def test_reclassify_is_idempotent(make):
    once = gates.reclassify(make([{}, {"bright": -40.0}, {"diam_nm": 100.0}]))
    twice = gates.reclassify(once).select(once.columns)
    assert once.exceptAll(twice).isEmpty()


def test_roundness(make):
    df = make([{"perim_px": 3.9}, {"perim_px": 100.0}, {"perim_px": 136.0}])
    assert column(df, gates.circularity())[:2] == [None, 1.0]
    score = column(df, gates.sphericity_score())
    assert score[0] is None and score[1] == 1.0 and 0 < score[2] < 1


def test_confidence_takes_the_weaker_margin(make):
    df = make([{"is_solid": True, "pattern": "janus", "facet_frac": 0.9, "pattern_probs": [0.4, 0.38, 0.12, 0.1]},
               {"is_solid": False, "facet_frac": 0.4}])
    assert column(df, classes.confidence()) == pytest.approx([0.02, 0.2])


def test_review_class(make):
    df = make([{"diam_nm": 150.0}, {"is_solid": True}, {"is_solid": True, "pattern": "stripe"},
               {"excluded": True}, {"unclassified": True}, {}])
    assert column(df, classes.review_class()) == ["", "solid", "stripe", "", "", "undercooled"]


def test_texts(spark):
    names = [("UÖ - 09 Karışık 7", "UÖ - 09 Karışık"), ("KARIŞIK 4", "KARIŞIK"), ("x 5 cm 2", "x 5 cm"),
             ("alt Üst 3 b", "alt Üst"), ("12", "12")]
    df = spark.createDataFrame(names, "s string, t string")
    assert df.where(~text.clean_title(F.col("s")).eqNullSafe(F.col("t"))).count() == 0
    shares = spark.createDataFrame([(0, 0, "—"), (1, 1000, "<1%"), (999, 1000, ">99%"), (5, 200, "2%"),
                                    (7, 200, "4%"), (0, 5, "0%"), (5, 5, "100%")], "k long, n long, t string")
    assert shares.where(text.share_text(F.col("k"), F.col("n")) != F.col("t")).count() == 0
    typed = spark.createDataFrame([("1,5", 1.5), (" 2 ", 2.0), ("", None), ("a", None), ("12d", None), ("5f", None), ("1_000", 1000.0), ("1__0", None),
                                   (".5_1", 0.51), ("5.", 5.0), ("1e3", 1000.0), ("-2,5", -2.5), ("0x1p3", None)], "s string, v double")
    assert typed.where(~text.parse_number(F.col("s")).eqNullSafe(F.col("v"))).count() == 0
    key = spark.createDataFrame([("Janus 10",), ("Janus 2",), ("janus 1",)], "s string")
    assert [r.s for r in key.orderBy(text.natural_key(F.col("s"))).collect()] == ["janus 1", "Janus 2", "Janus 10"]
    long = spark.createDataFrame([("a 123456789012345678902",), ("a 123456789012345678901",), ("a 0012345678901234567890",)], "s string")
    assert [r.s[-3:] for r in long.orderBy(text.natural_key(F.col("s"))).collect()] == ["890", "901", "902"]
