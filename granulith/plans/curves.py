"""Learning-curve, sampling and history queries."""

from pyspark.sql import functions as F

from granulith import constants as K
from granulith.functions import gates
from granulith.operators import curve, labels, sampling
from granulith.plans.registry import query
from granulith.plans.statistics import rounded
from granulith.session import scratch_path

INSTR = """, ci as (select c.*, instrument, round(acc - (case when instrument='ETD' then (run_id%3)*4e-2 else 0e0 end),6) as acc_instrument
  from curve_points c cross join (select 'CBS' as instrument union all select 'ETD') i where not (run_id%5=4 and instrument='ETD'))
"""


def by_instrument(w):
    i = F.explode(F.when(F.col("run_id") % 5 == 4, F.array(F.lit("CBS"))).otherwise(F.array(F.lit("CBS"), F.lit("ETD"))))
    c = w.curve_points.withColumn("instrument", i)
    return c.withColumn("acc_instrument", F.round(F.col("acc") - F.when(
        F.col("instrument") == "ETD", (F.col("run_id") % 3) * 0.04).otherwise(0.0), 6))


_AGG = ", cg as (select run_id, frac, avg(n_train) as n, avg(acc) as y, min(acc) as lo, max(acc) as hi, count(*) as reps from curve_points group by run_id, frac)"


@query("f12_curve_points", _AGG + " select run_id, frac, n, round(y,6) as y, round(lo,6) as lo, round(hi,6) as hi, reps from cg")
def _(w):
    return rounded(curve.collapsed(w.curve_points, ["run_id"]))


@query("f12b_curve_by_instrument", INSTR + """select run_id, instrument, frac, avg(n_train) as n, cast(cast(avg(acc_instrument) as float) as double) as y,
 round(min(acc_instrument),6) as lo, round(max(acc_instrument),6) as hi, count(*) as reps from ci group by run_id, instrument, frac""")
def _(w):
    return rounded(curve.collapsed(by_instrument(w), ["run_id", "instrument"], "acc_instrument"), single=["y"])


FIT = _AGG + """, whole as (select run_id, count(*) as k, max(y) as ymax, avg(y) as ym, var_pop(y) as yv, min(n) as n_min, max(n) as n_max from cg group by run_id having count(*)>=3),
 scan as (select g.run_id, i, 5e-2+i*(195e-2/195) as c, n, y, pow(n, -(5e-2+i*(195e-2/195))) as x from cg g cross join (select unnest(range(0,196)) as i)),
 ab as (select run_id, i, c, regr_slope(y,x) as s, regr_intercept(y,x) as a from scan group by run_id, i, c),
 er as (select s.run_id, s.i, ab.c, ab.a, -ab.s as b, sum(pow(ab.a+ab.s*s.x-s.y,2)) as sse from scan s join ab on s.run_id=ab.run_id and s.i=ab.i group by s.run_id, s.i, ab.c, ab.a, ab.s),
 bst as (select e.run_id, min_by(struct_pack(a := a, b := b, c := c, sse := sse), sse) as f from er e join whole w on e.run_id=w.run_id where b>0 and a>ymax-1e-9 and a<=1e0 group by e.run_id),
 fits as (select b.run_id, f.a as a, f.b as b, f.c as c, f.sse as sse, f.a<99e-2 as ceiling_identified, 1-f.sse/nullif(k*yv,0) as r2, n_min, n_max from bst b join whole w on b.run_id=w.run_id)
"""


@query("f13_power_law", FIT + "select run_id, round(a,6) as a, round(b,5) as b, round(c,6) as c, round(sse,9) as sse, ceiling_identified, round(r2,5) as r2, n_min, n_max from fits")
def _(w):
    f = curve.fit(w.curve_points, ["run_id"])
    return f.select("run_id", F.round("a", 6).alias("a"), F.round("b", 5).alias("b"), F.round("c", 6).alias("c"),
                    F.round("sse", 9).alias("sse"), "ceiling_identified", F.round("r2", 5).alias("r2"), "n_min", "n_max")


@query("f14_verdict", FIT + """, v as (select r.run_id, n_total, a, a-b*pow(n_total,-c) as here, (a-b*pow(2*n_total,-c)-(a-b*pow(n_total,-c)))*100 as gain
  from (select run_id, 600e0*(1+run_id%3) as n_total from (select distinct run_id from curve_points)) r left join fits f on f.run_id=r.run_id)
 select run_id, cast(n_total as bigint) as n_total, case when gain is null then 'unknown' when gain>=3 then 'climbing' when gain>=1 then 'flattening' else 'plateau' end as state,
  round(gain,5) as gain_doubling, round((a-here)*100,5) as headroom, round(here,6) as here, round(a,6) as ceiling from v""")
def _(w):
    runs = w.curve_points.select("run_id", (600 * (1 + F.col("run_id") % 3)).cast("long").alias("n_total")).distinct()
    v = curve.verdict(runs, curve.fit(w.curve_points, ["run_id"]), ["run_id"])
    return v.select("run_id", "n_total", "state", F.round("gain_doubling", 5).alias("gain_doubling"),
                    F.round("headroom", 5).alias("headroom"), F.round("here", 6).alias("here"),
                    F.round("ceiling", 6).alias("ceiling"))


@query("f14b_projection", FIT + "select run_id, round(a-b*pow(5000e0,-c),6) as projected from fits")
def _(w):
    f = curve.fit(w.curve_points, ["run_id"]).withColumn("n", F.lit(5000))
    return rounded(curve.project(f, "n").select("run_id", "projected"))


@query("f15_instrument_gap", INSTR + """, l as (select run_id, instrument, max_by(acc_instrument, struct_pack(n := n_train, d := -draw)) as acc from ci group by run_id, instrument)
 select run_id, round((max(acc)-min(acc))*100,6) as gap, min_by(instrument, struct_pack(a := acc, i := instrument)) as weakest, (max(acc)-min(acc))*100>=5 as coverage_gap from l group by run_id having count(*)>=2""")
def _(w):
    return rounded(curve.instrument_gap(by_instrument(w), ["run_id"]))


@query("f15b_capacity", """, t as (select run_id, max_by(acc_train, struct_pack(n := n_train, d := -draw)) as tr, max_by(acc, struct_pack(n := n_train, d := -draw)) as te from curve_points group by run_id)
 select run_id, case when tr<9e-1 then 'underfit' when (tr-te)*100>=15 then 'variance' else 'balanced' end as state, round(tr,6) as acc_train, round(te,6) as acc_test, round((tr-te)*100,6) as gap from t""")
def _(w):
    return rounded(curve.capacity(w.curve_points, ["run_id"]))


# Recall of each class: those of larger numbers are found less often, the last one is not in every held-out set.
_RECALL = "round(acc - 2e-2*{k}, 6)"


def recalls(w):
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.round(F.col("acc") - 0.02 * k, 6).alias("recall"))
                               for k, c in enumerate(K.PATTERNS)]))
    rows = w.curve_points.select("run_id", "frac", "draw", each.alias("r")).select("run_id", "frac", "draw", "r.*")
    return rows.where(~((F.col("class") == K.PATTERNS[-1]) & (F.col("run_id") % 3 == 0)))


@query("a07_curve_export", INSTR + """select c.run_id, frac as fraction_of_pool, draw, n_train as particles_train, round(acc,5) as held_out_accuracy, round(acc_train,5) as train_accuracy,
 (select round(max(acc_instrument),5) from ci i where i.run_id=c.run_id and i.frac=c.frac and i.draw=c.draw and instrument='CBS') as "acc_CBS",
 (select round(max(acc_instrument),5) from ci i where i.run_id=c.run_id and i.frac=c.frac and i.draw=c.draw and instrument='ETD') as "acc_ETD", """
       + ", ".join(f"round({_RECALL.format(k=k)},5) as {c}" if k < len(K.PATTERNS) - 1 else f"case when run_id%3<>0 then round({_RECALL.format(k=k)},5) end as {c}"
                   for k, c in enumerate(K.PATTERNS)) + " from curve_points c")
def _(w):
    """Written as CSV and read back."""
    path = scratch_path(w.spark, "curve-csv")
    table = curve.export_table(w.curve_points, by_instrument(w), ["CBS", "ETD"], recalls(w))
    curve.write_csv(table, path)
    return w.spark.read.schema(table.schema).option("header", True).csv(path)


@query("a05_run_history", """select scope, run_id, ts from (select o_custkey%10 as scope, o_orderkey as run_id, o_orderdate as ts,
 row_number() over (partition by o_custkey%10 order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn<=40""")
def _(w):
    runs = w.table("orders").select((F.col("o_custkey") % 10).alias("scope"), F.col("o_orderkey").alias("run_id"),
                                    F.col("o_orderdate").alias("ts"))
    return curve.keep_newest(runs, ["scope"], "ts", tie="run_id")


SAVES = """, saves as (select o_custkey%10 as store, o_orderkey as save_id, make_timestamp(cast(o_orderkey as bigint)*1000000) as ts, o_orderkey*53%1000 as n_rows, o_orderkey*37%1000 as previous_rows from orders)
"""


def saves(w):
    return w.table("orders").select(
        (F.col("o_custkey") % 10).alias("store"), F.timestamp_micros(F.col("o_orderkey") * 1000000).alias("ts"),
        (F.col("o_orderkey") * 53 % 1000).alias("n_rows"), (F.col("o_orderkey") * 37 % 1000).alias("previous_rows"))


@query("g08_snapshot_retention", SAVES + """, sn as (select store, ts, previous_rows as n_rows from saves where n_rows<previous_rows),
 r as (select *, row_number() over (partition by store order by ts desc) as rn, row_number() over (partition by store order by n_rows desc, ts) as fn from sn)
 select store, ts, n_rows from r where rn<=4 or fn=1""")
def _(w):
    from granulith.sources.session_tables import shrinking_saves
    return curve.keep_snapshots(shrinking_saves(saves(w)), ["store"], "ts", "n_rows")


# Shuffled orders come from arithmetic on the photo number, so both engines draw alike.
_INS = ", ph as (select image_id, coalesce(nullif(upper(trim(detector)),''),'no nameplate') as instrument from images)"


def instrument_photos(w):
    return w.images.select("image_id", labels.instrument_golden(F.col("detector")).alias("instrument"))


_HELD = _INS + """, ho as (select image_id, instrument, (row_number() over (partition by instrument order by image_id*7919%1009, image_id)-1)%3=0 as held_out from ph)"""


def held(w):
    return sampling.holdout(instrument_photos(w), [F.col("image_id") * 7919 % 1009, F.col("image_id")])


@query("g04_stratified_holdout", _HELD + " select * from ho")
def _(w):
    return held(w).select("image_id", "instrument", "held_out")


_SUB = _HELD + """, dr as (select * from (values (2e-1,0),(2e-1,1),(4e-1,0),(4e-1,1),(6e-1,0),(8e-1,0),(1e0,0)) t(frac, draw)),
 sb as (select image_id, instrument, frac, draw from (select h.image_id, instrument, frac, draw, row_number() over (partition by frac, draw, instrument order by (image_id*7919+draw*31+cast(frac*10 as bigint)*17)%1013, image_id) as rn,
   count(*) over (partition by frac, draw, instrument) as n from ho h cross join dr where not held_out) where rn <= greatest(1, cast(round_even(frac*n,0) as bigint)))
"""


def subsets(w):
    pool = held(w).where("not held_out").select("image_id", "instrument")
    return sampling.nested_subsets(pool, lambda frac, draw: [
        (F.col("image_id") * 7919 + draw * 31 + (frac * 10).cast("long") * 17) % 1013, F.col("image_id")])


@query("g05_nested_subsets", _SUB + "select * from sb")
def _(w):
    return subsets(w).select("image_id", "instrument", "frac", "draw")


@query("g05b_subset_sizes", _SUB + """, rp as (select image_id, count(*) as n from truth_labels where set_name='train' group by image_id)
 select frac, draw, cast(sum(n) as bigint) as n_train, count(*) as photos_train from sb join rp on rp.image_id=sb.image_id group by frac, draw having sum(n)>=20""")
def _(w):
    rows = w.labels.where("set_name = 'train'").groupBy("image_id").agg(F.count("*").alias("n_rows"))
    return sampling.usable_subsets(subsets(w), rows)


@query("g03_pick_spread", """, c0 as (select *, measured and case when major_px<>0 then minor_px/major_px else 0e0 end >= 72e-2 as clean from decided),
 sz as (select image_id, count(case when clean then 1 end) as nc, count(case when measured then 1 end) as nm from c0 group by image_id),
 c1 as (select c0.image_id, particle_id, diam_nm from c0 join sz on c0.image_id=sz.image_id where case when nc>=5 then clean when nm>0 then measured else true end),
 r as (select *, row_number() over (partition by image_id order by diam_nm, particle_id)-1 as pos, count(*) over (partition by image_id) as n from c1),
 b as (select *, case when greatest(1,floor(n*0.95))-floor(n*0.05)>=5 then floor(n*0.05) else 0 end as st, case when greatest(1,floor(n*0.95))-floor(n*0.05)>=5 then greatest(1,floor(n*0.95))-floor(n*0.05) else n end as wd from r),
 z as (select image_id, case when n<=5 then pos else floor(((pos-st+1)*5-1)/wd) end as band, diam_nm from b where n<=5 or (pos>=st and pos<st+wd))
 select image_id, cast(band as int) as band, count(*) as n_band, round(min(diam_nm),6) as lo, round(max(diam_nm),6) as hi from z group by image_id, band""")
def _(w):
    """The bands that picks are drawn from, and that every pick lies inside its band."""
    bands = sampling.spread_bands(w.decided, ["image_id"], 5)
    picked = sampling.draw(bands, ["image_id"], seed=7)
    agg = bands.groupBy("image_id", "band").agg(F.count("*").alias("n_band"), F.min("diam_nm").alias("lo"),
                                                F.max("diam_nm").alias("hi"))
    checked = agg.join(picked.select("image_id", "band", F.col("diam_nm").alias("_d")), ["image_id", "band"])
    return rounded(checked.where("_d between lo and hi").drop("_d"))
