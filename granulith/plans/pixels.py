"""Region-property queries over label pixels drawn per image."""

from pyspark.sql import functions as F

from granulith import constants as K
from granulith.operators import match, regions
from granulith.plans.registry import query
from granulith.plans.statistics import rounded
from granulith.session import spread

W, H = 64, 48
# a disc, an ellipse, a disc cut by the left frame and a thin bar; sizes follow the image number
_LABEL = """case when (x-14)*(x-14)+(y-14)*(y-14) <= (5+image_id%4)*(5+image_id%4) then 1
 when (x-42)*(x-42)*16+(y-14)*(y-14)*49 <= 784*(1+image_id%2) then 2
 when x*x+(y-36)*(y-36) <= (6+image_id%3)*(6+image_id%3) then 3
 when x between 30 and 30+4*(2+image_id%3) and y between 34 and 35 then 4 else 0 end"""
PX = f""", px0 as (select image_id, cast(y as int) as y, cast(x as int) as x from images cross join (select unnest(range(0,{H})) as y) cross join (select unnest(range(0,{W})) as x)),
 px as (select image_id, y, x, {_LABEL} as label, 100+{_LABEL}*20+(x+y)%7 as grey from px0)
"""


def pixels(w):
    grid = (spread(w.images.select("image_id"), "image_id").select("image_id", F.explode(F.sequence(F.lit(0), F.lit(H - 1))).alias("y"))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(W - 1)))))
    return (grid.withColumn("label", F.expr(_LABEL).cast("int"))
            .withColumn("grey", (F.lit(100) + F.col("label") * 20 + (F.col("x") + F.col("y")) % 7).cast("int")))


def masks(w):
    return regions.runs(pixels(w))


def frames(w):
    return w.images.select("image_id", "nm_per_px", F.lit(W).alias("width_px"), F.lit(H).alias("height_px"))


_G = f""", g as (select image_id, label, count(*) as area, avg(x) as cx, avg(y) as cy, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, avg(grey) as mean_grey,
   count(case when y=0 or x=0 or y={H-1} or x={W-1} then 1 end) as er, var_pop(x) as vx, var_pop(y) as vy, covar_pop(x,y) as vxy from px where label<>0 group by image_id, label)
"""


@query("k01_region_basics", PX + _G + """select image_id, label, area, round(cx,6) as cx, round(cy,6) as cy, min_x, max_x, min_y, max_y, round(mean_grey,6) as mean_grey, round(sqrt(4*area/pi()),6) as diam_px from g""")
def _(w):
    return rounded(regions.basics(masks(w), frames(w)).select(
        "image_id", "label", "area", "cx", "cy", "min_x", "max_x", "min_y", "max_y", "mean_grey", "diam_px"))


@query("k02_edge_contact", PX + _G + f"""select image_id, label, (min_y<=1 or min_x<=1 or max_y+1>={H-1} or max_x+1>={W-1}) as touches_edge, round(er/sqrt(4*area/pi()),6) as edge_cut from g""")
def _(w):
    return rounded(regions.basics(masks(w), frames(w)).select("image_id", "label", "touches_edge", "edge_cut"))


@query("k03_axes", PX + _G + """select image_id, label, round(4*sqrt((vx+vy)/2+sqrt(pow(vx-vy,2)/4+vxy*vxy)),5) as major_px,
 round(4*sqrt(greatest(0e0,(vx+vy)/2-sqrt(pow(vx-vy,2)/4+vxy*vxy))),5) as minor_px from g""")
def _(w):
    return rounded(regions.basics(masks(w), frames(w)).select("image_id", "label", "major_px", "minor_px"), 5)


# The hull's left border in a row is the least x between any side point above and any below it, the right one likewise.
HULL = """, ends as (select image_id, label, y, min(x) as x0, max(x) as x1, count(*) as n from px where label<>0 group by image_id, label, y),
 sides as (select image_id, label, y+dy as py, x0+dx as lx, x1-dx as rx from ends cross join (values (0e0,-5e-1),(-5e-1,0e0),(5e-1,0e0)) d(dy,dx)),
 borders as (select e.image_id, e.label, e.y, e.n, min(case when a.py=b.py then a.lx else a.lx+(b.lx-a.lx)*(e.y-a.py)/(b.py-a.py) end) as l,
   max(case when a.py=b.py then a.rx else a.rx+(b.rx-a.rx)*(e.y-a.py)/(b.py-a.py) end) as r
  from ends e join sides a on a.image_id=e.image_id and a.label=e.label and a.py<=e.y join sides b on b.image_id=e.image_id and b.label=e.label and b.py>=e.y
  group by e.image_id, e.label, e.y, e.n),
 sol as (select image_id, label, sum(n)/sum(floor(r+1e-9)-ceil(l-1e-9)+1) as solidity from borders group by image_id, label)
"""


@query("k04_solidity", PX + HULL + "select image_id, label, round(solidity,6) as solidity from sol")
def _(w):
    return rounded(regions.solidity(masks(w)))


PERIM = """, nb as (select image_id, label, y, x from px where label<>0),
 cr as (select a.image_id, a.label, sum(case when l.x is null then 1 else 0 end)+sum(case when u.x is null then 1 else 0 end) as st, sum(case when d.x is null then 1 else 0 end)+sum(case when e.x is null then 1 else 0 end) as dg
  from nb a left join nb l on l.image_id=a.image_id and l.label=a.label and l.y=a.y and l.x=a.x-1 left join nb u on u.image_id=a.image_id and u.label=a.label and u.y=a.y-1 and u.x=a.x
  left join nb d on d.image_id=a.image_id and d.label=a.label and d.y=a.y-1 and d.x=a.x-1 left join nb e on e.image_id=a.image_id and e.label=a.label and e.y=a.y-1 and e.x=a.x+1 group by a.image_id, a.label),
 per as (select image_id, label, pi()/4*(st+dg/sqrt(2e0)) as perim_px from cr)
"""


@query("k05_perimeter", PX + PERIM + "select image_id, label, round(perim_px,6) as perim_px from per")
def _(w):
    return rounded(regions.perimeter(masks(w)))


@query("k05b_perimeter_backfill", PX + PERIM + "select image_id, cast(label as bigint) as particle_id, round(case when label%2=0 then perim_px else 1e1 end,6) as perim_px from per")
def _(w):
    known = masks(w).select("image_id", F.col("label").cast("long").alias("particle_id")).distinct()
    parts = known.withColumn("perim_px", F.when(F.col("particle_id") % 2 == 0, 0.0).otherwise(10.0))
    return rounded(regions.backfill_perimeter(parts, masks(w)))


@query("k06_brightness", PX + _G + """select g.image_id, label, median_grey, round(mean_grey-median_grey,6) as bright from g join (select image_id, quantile_cont(grey,0.5) as median_grey from px group by image_id) m on m.image_id=g.image_id""")
def _(w):
    return rounded(regions.brightness(pixels(w), regions.basics(masks(w), frames(w))).select("image_id", "label", "median_grey", "bright"))


@query("k07_small_candidates", PX + _G + PERIM + HULL + f""", cand as (select g.image_id, g.label, area, cx, cy, perim_px, solidity, case when nm_per_px>0 then nm_per_px else 8e0 end as npp from g join per p on p.image_id=g.image_id and p.label=g.label join sol on sol.image_id=g.image_id and sol.label=g.label join images i on i.image_id=g.image_id where g.label in (1,2,4))
 select image_id, label from cand c where area >= greatest(pi()*4e0, pi()*pow(5e-1*18e0/npp,2)) and area <= pi()*pow(5e-1*25e1/npp,2) and 4*pi()*area/(perim_px*perim_px) >= 6e-1
  and solidity >= {K.SMALL_MIN_SOLIDITY}
  and not exists (select 1 from px o where o.image_id=c.image_id and o.label=3 and abs(o.y-cast(floor(cy) as int))<=2 and abs(o.x-cast(floor(cx) as int))<=2)""")
def _(w):
    """Candidates are all regions but the frame-cut disc; that disc occupies its pixels."""
    rows = masks(w)
    base = regions.basics(rows.where("label <> 3"), frames(w)).join(regions.perimeter(rows), ["image_id", "label"])
    cand = base.join(regions.solidity(rows), ["image_id", "label"]).select("image_id", "label", "area", "cx", "cy", "perim_px", "solidity")
    return regions.small_candidates(cand, rows.where("label = 3"), frames(w)).select("image_id", "label")


@query("k08_drop_ghosts", PX + "select image_id, label, count(*) as n from px where label in (1,2) or (label=3 and image_id%2=0) group by image_id, label")
def _(w):
    rows = masks(w)
    alive = (rows.select("image_id", F.col("label").cast("long").alias("particle_id")).distinct()
             .where("particle_id <= 2 or (particle_id = 3 and image_id % 2 = 0)"))
    return regions.pixels_of(regions.drop_ghosts(rows, alive)).groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query("k08b_area_floor", PX + _G + "select image_id, cast(label as bigint) as particle_id from g where area >= pi()*4e0 and sqrt(4*area/pi()) >= 4e0")
def _(w):
    rows = masks(w)
    parts = regions.basics(rows, frames(w)).select("image_id", F.col("label").cast("long").alias("particle_id"), "diam_px")
    return regions.area_floor(rows, parts).select("image_id", "particle_id")


@query("d19_particle_at_point", PX + """, pt as (select image_id, label_id, (cx/1536e0)*64e0 as px, (cy/1024e0)*48e0 as py from truth_labels where set_name='train' and cx>=0 and cy>=0)
 select t.image_id, t.label_id as point_id, nullif(p.label,0) as particle_id from pt t left join px p on p.image_id=t.image_id and p.x=cast(floor(t.px) as int) and p.y=cast(floor(t.py) as int)""")
def _(w):
    pts = w.labels.where("set_name = 'train' and cx >= 0 and cy >= 0").select(
        "image_id", F.col("label_id").alias("point_id"), (F.col("cx") / 1536.0 * 64.0).alias("px"),
        (F.col("cy") / 1024.0 * 48.0).alias("py"))
    return match.at_points(pts, pixels(w))
