"""User corrections: applied as a view, folded from click logs, edited in bulk."""

from pyspark.sql import Column, DataFrame, functions as F

from granulith import constants as K
from granulith.functions import classes, gates
from granulith.session import join_lookup

KEY = ["image_id", "particle_id"]
CHUNK = 4096


def one_row_per_particle(overrides: DataFrame) -> DataFrame:
    """Pivot the long override table; combines on the map side."""
    kind = F.col("kind")
    return overrides.groupBy(*KEY).agg(
        F.bool_or(kind == "view_exclude").alias("_exc"),
        F.bool_or(kind == "measure_exclude").alias("_mexc"),
        F.bool_or(kind == "measure_include").alias("_inc"),
        F.max(F.when(kind == "class", F.col("value"))).alias("_cls"))


def apply_view(particles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Corrected particles; the input stays untouched.

    A view exclusion outranks everything. A named class freezes the gate's own
    verdict on the untouched particle before the class changes.
    """
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = particles.join(one_row_per_particle(overrides), KEY, "left")
    exc, named, cls = f("_exc"), F.col("_cls").isNotNull(), F.col("_cls")
    solid = (cls == "solid") | cls.startswith("solid:")
    verdict = (F.when(exc | f("_mexc"), False).when(f("_inc"), True)
               .when(named, gates.measurable()).otherwise(F.col("user_measurable")))
    return joined.withColumns({
        "user_measurable": verdict,
        "is_solid": F.when(exc, False).when(named, ~cls.isin("unknown", "undercooled"))
                     .otherwise(F.col("is_solid")),
        "pattern": F.when(exc, "").when(named, F.when(cls.isin("unknown", "undercooled") | solid, "")
                                        .otherwise(cls)).otherwise(F.col("pattern")),
        "unclassified": F.when(~exc & named, cls == "unknown").otherwise(F.col("unclassified")),
        "excluded": F.when(exc, True).when(named, False).otherwise(F.col("excluded")),
        "user_solid": F.when(~exc & named & solid, True).otherwise(F.col("user_solid")),
    }).drop("_exc", "_mexc", "_inc", "_cls")


# --- click logs -----------------------------------------------------------------
# Where a second click on a class leads.
UNSURE_OF = {"undercooled": "unknown", **{p: f"solid:{p}" for p in K.PATTERNS}}
CLICKS = ["undercooled", *K.PATTERNS, "solid", "exclude"]
OVERRIDE_VALUES = ["", "undercooled", *K.PATTERNS, "solid", "unknown", *[f"solid:{p}" for p in K.PATTERNS]]
_N = len(OVERRIDE_VALUES)
STATES = 4 * _N          # override value x "a class was named" x "view-excluded"


def _click(state: int, cls: str) -> int:
    """One click: naming, un-naming to the unsure value, back to the model, or exclusion."""
    value, named, excluded = OVERRIDE_VALUES[state % _N], state // _N % 2, state // (2 * _N)
    if cls == "exclude":
        return named * _N + (0 if excluded else 2 * _N)
    unsure = UNSURE_OF.get(cls)
    if value == cls and unsure:
        value = unsure
    elif value == cls or (unsure and value == unsure):
        value = ""
    else:
        value, named = cls, 1
    return OVERRIDE_VALUES.index(value) + named * _N


def resolve_solid(log: DataFrame, particles: DataFrame) -> DataFrame:
    """Click log whose "solid" clicks carry the pattern that the model finds credible for a solid particle.

    Without a credible pattern the click stays "solid"; on an unknown particle it is void.
    """
    named = particles.select(*KEY, gates.solidify_pattern().alias("_solid"))
    return (log.join(named, KEY, "left").withColumn("cls", F.when(F.col("cls") == "solid", F.col("_solid")).otherwise(F.col("cls")))
            .where("cls is not null").drop("_solid"))


def fold_class_clicks(log: DataFrame) -> DataFrame:
    """Final override per particle of a click log (image_id, particle_id, seq, cls).

    Clicks form a finite automaton, so a run of clicks is a map from states to
    states and runs can be composed. Logs are folded in runs of CHUNK clicks
    (seq counts from 0 per particle); only run results meet again.
    """
    tables = {c: F.array(*[F.lit(_click(s, c)) for s in range(STATES)]) for c in CLICKS}
    step = F.array(*[tables[c] for c in CLICKS])
    index = F.array_position(F.array(*[F.lit(c) for c in CLICKS]), F.col("cls")).cast("int")
    runs = (log.select(*KEY, F.floor(F.col("seq") / CHUNK).alias("_run"), "seq", index.alias("_i"))
            .where("_i > 0")
            .groupBy(*KEY, "_run").agg(F.array_sort(F.collect_list(F.struct("seq", "_i"))).alias("_events")))
    start = F.when(F.col("_run") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(STATES - 1)))
    ends = F.aggregate("_events", start, lambda acc, e: F.transform(
        acc, lambda s: F.element_at(F.element_at(step, e["_i"]), s + 1)))
    done = (runs.select(*KEY, "_run", ends.alias("_ends")).groupBy(*KEY)
            .agg(F.array_sort(F.collect_list(F.struct("_run", "_ends"))).alias("_runs")))
    final = F.aggregate("_runs", F.lit(0), lambda s, r: F.element_at(r["_ends"], s + 1))
    state = done.select(*KEY, final.alias("_s"))
    value = F.element_at(F.array(*[F.lit(v) for v in OVERRIDE_VALUES]), F.col("_s") % _N + 1)
    return state.select(*KEY, F.nullif(value, F.lit("")).alias("value"),
                        ((F.col("_s") / _N).cast("int") % 2 == 1).alias("named"),
                        (F.col("_s") >= 2 * _N).alias("view_excluded"))


def include_on_classify(folded: DataFrame, particles: DataFrame) -> DataFrame:
    """Naming a class force-includes what the gate rejects and lifts a measure exclusion."""
    gate = particles.select(*KEY, gates.measurable().alias("_m"))
    return (folded.join(gate, KEY)
            .select(*KEY, "value", "view_excluded",
                    (F.col("named") & ~F.col("_m")).alias("measure_include"),
                    F.col("named").alias("lifts_measure_exclude")))


def toggle_measured(particles: DataFrame, toggles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Measured flags after n right-clicks per particle.

    One step changes the start state, after that the toggle alternates, so the
    count of clicks is all that is needed.
    """
    flags = one_row_per_particle(overrides).select(*KEY, "_inc", "_mexc")
    n = toggles.groupBy(*KEY).agg(F.count("*").alias("_n"))
    base = (particles.select(*KEY, gates.measurable().alias("_m")).join(n, KEY)
            .join(flags, KEY, "left")
            .withColumn("_i", F.coalesce("_inc", F.lit(False)))
            .withColumn("_e", F.coalesce("_mexc", F.lit(False))))

    def step(i: Column, e: Column) -> tuple[Column, Column]:
        m = F.col("_m")
        on = ~e & (i | m)
        return (F.when(on, i & ~i).otherwise(i | ~e), F.when(on, ~i).otherwise(e & ~e))

    i1, e1 = step(F.col("_i"), F.col("_e"))
    base = base.withColumns({"_i1": i1, "_e1": e1})
    i2, e2 = step(F.col("_i1"), F.col("_e1"))
    odd = F.col("_n") % 2 == 1
    return base.select(*KEY, F.col("_n").alias("n_clicks"),
                       F.when(odd, F.col("_i1")).otherwise(i2).alias("measure_include"),
                       F.when(odd, F.col("_e1")).otherwise(e2).alias("measure_exclude"))


# --- bulk edits on the override store ---------------------------------------------
def reflect_training(overrides: DataFrame, clicks: DataFrame) -> DataFrame:
    """Copy training labels (image_id, particle_id, cls) into the view stores, one way."""
    view = overrides.where(F.col("kind").isin("class", "view_exclude"))
    rest = overrides.where(~F.col("kind").isin("class", "view_exclude"))
    kept = view.join(clicks.select(*KEY), KEY, "left_anti")
    new = clicks.select(*KEY, F.when(F.col("cls") == "exclude", "view_exclude").otherwise("class").alias("kind"),
                        F.when(F.col("cls") == "exclude", "").otherwise(F.col("cls")).alias("value"))
    return rest.unionByName(kept).unionByName(new)


def accept_model(clicks: DataFrame, particles: DataFrame, asked: DataFrame) -> DataFrame:
    """Take the model's answer as the label for the asked particles; "solid" cannot be accepted."""
    answer = (particles.join(asked.select(*KEY), KEY, "left_semi")
              .select(*KEY, classes.model_class().alias("_m")).where("_m <> 'solid'")
              .select(*KEY, F.when(F.col("_m") == "excluded", "exclude").otherwise(F.col("_m")).alias("cls")))
    return clicks.select(*KEY, "cls").join(answer, KEY, "left_anti").unionByName(answer)


def clear_class(clicks: DataFrame, images: DataFrame, cls: str) -> DataFrame:
    """Drop every label of one class on the given images."""
    hit = join_lookup(clicks, images.select("image_id").withColumn("_hit", F.lit(True)), ["image_id"], "left")
    return hit.where(F.col("_hit").isNull() | (F.col("cls") != cls)).drop("_hit")


def clear_photo(clicks: DataFrame, blanks: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop all labels of the images and blank them, so the model's prefill stays hidden too."""
    left = join_lookup(clicks, images.select("image_id"), ["image_id"], "left_anti")
    return left, blanks.select("image_id").union(images.select("image_id")).distinct()


def after_reanalysis(overrides: DataFrame, reanalysed: DataFrame) -> DataFrame:
    """A re-analysed photo loses every correction: its particle ids mean something else now."""
    return join_lookup(overrides, reanalysed.select("image_id"), ["image_id"], "left_anti")


def pending_corrections(overrides: DataFrame, images: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Corrections per store, photos touched and how many of the photos are safely confirmed."""
    asked = join_lookup(overrides, images.select("image_id"), ["image_id"], "left_semi")
    touched = asked.groupBy("kind", "image_id").agg(F.count("*").alias("n"))
    safe = confirmed.select("image_id").distinct().withColumn("_safe", F.lit(True))
    return (touched.join(safe, "image_id", "left").groupBy("kind").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_photos"),
        F.count_if(F.col("_safe").isNotNull()).alias("n_confirmed")))
