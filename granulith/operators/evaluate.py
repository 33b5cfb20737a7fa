"""Scoring the classifier against held-out labels, from confusion counts."""

from pyspark.sql import Column, DataFrame, functions as F

from granulith import constants as K

CELLS = [(t, p) for t in K.REPORT_CLASSES for p in K.REPORT_CLASSES]


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The 5 x 5 confusion as one wide row per key; `rows` has truth, pred and a count n."""
    return rows.groupBy(*keys).agg(*[
        F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("n")).otherwise(0))
         .alias(f"c_{t}_{p}") for t, p in CELLS])


def _sum(cells) -> Column:
    return sum((F.col(f"c_{t}_{p}") for t, p in cells), F.lit(0))


def headline(conf: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, macro-F1 over classes present in the truth, solid accuracy; null when n = 0."""
    n = F.nullif(_sum(CELLS), F.lit(0))
    hit = _sum([(c, c) for c in K.REPORT_CLASSES])
    solid_hit = _sum([(t, p) for t, p in CELLS if (t == K.NOPAT) == (p == K.NOPAT)])
    f1s, present = F.lit(0.0), F.lit(0)
    for c in K.REPORT_CLASSES:
        _, _, _, f1 = class_scores(c)
        f1s, present = f1s + F.coalesce(f1, F.lit(0.0)), present + F.when(f1.isNotNull(), 1).otherwise(0)
    return conf.select(*keys, _sum(CELLS).alias("n"), (hit / n).alias("acc"),
                       (f1s / F.nullif(present, F.lit(0))).alias("macro_f1"), (solid_hit / n).alias("solid_acc"))


def class_scores(c: str) -> tuple[Column, Column, Column, Column]:
    """n, recall, precision and F1 of one class; precision is 0 if never predicted, all null if n = 0."""
    n = _sum([(c, p) for p in K.REPORT_CLASSES])
    predicted = _sum([(t, c) for t in K.REPORT_CLASSES])
    hit = F.col(f"c_{c}_{c}")
    recall = hit / F.nullif(n, F.lit(0))
    prec = F.when(n > 0, F.coalesce(hit / F.nullif(predicted, F.lit(0)), F.lit(0.0)))
    f1 = F.when(n > 0, F.coalesce(2 * recall * prec / F.nullif(recall + prec, F.lit(0.0)), F.lit(0.0)))
    return n, recall, prec, f1


def per_class(conf: DataFrame, keys: list[str]) -> DataFrame:
    entries = []
    for c in K.REPORT_CLASSES:
        n, r, p, f1 = class_scores(c)
        entries.append(F.struct(F.lit(c).alias("class"), n.alias("n"), r.alias("recall"),
                                p.alias("prec"), f1.alias("f1")))
    return conf.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def scoped(matched: DataFrame) -> DataFrame:
    """Confusion counts for combined / instrument / photo scopes and measured / all populations.

    `matched` has image_id, instrument, truth, pred, measured per matched label. Rows
    are counted per photo once; the scopes are built from those counts.
    """
    cells = (matched.groupBy("image_id", "instrument", "truth", "pred", "measured")
             .agg(F.count("*").alias("n")))
    scopes = F.explode(F.array(
        F.struct(F.lit("combined").alias("scope"), F.lit("").alias("value")),
        F.struct(F.lit("instrument").alias("scope"), F.col("instrument").alias("value")),
        F.struct(F.lit("photo").alias("scope"), F.col("image_id").cast("string").alias("value"))))
    pops = F.explode(F.when(F.col("measured"), F.array(F.lit("measured"), F.lit("all_labelled")))
                     .otherwise(F.array(F.lit("all_labelled"))))
    return (cells.select("*", scopes.alias("_s")).select("_s.*", "truth", "pred", "n", pops.alias("population"))
            .groupBy("scope", "value", "population", "truth", "pred").agg(F.sum("n").alias("n")))


def report(matched: DataFrame) -> DataFrame:
    """Headline scores per scope and population."""
    keys = ["scope", "value", "population"]
    return headline(confusion(scoped(matched), keys), keys)


def unmatched(labels: DataFrame) -> DataFrame:
    """Labels that found no particle, per photo."""
    return (labels.groupBy("image_id").agg(
        F.count("*").alias("n_labels"), F.count_if(F.col("particle_id").isNull()).alias("n_unmatched")))
