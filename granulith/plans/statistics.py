"""Size, composition, volume and histogram queries per selection."""

from pyspark.sql import functions as F

from granulith import constants as K
from granulith.functions import classes, gates, text
from granulith.operators import histogram, stats, tiles, volume
from granulith.plans.registry import query

SEL = ["selection_id"]


def rounded(df, digits=6, fine=("d10", "d50", "d90", "median_nm"), single=()):
    """Round doubles for comparison: summation order differs between engines.

    Interpolated percentiles carry more exact decimals; means of few decimal
    values can sit exactly between two decimals, so they go to single precision.
    """
    def one(c):
        if c in single:
            return F.col(c).cast("float").cast("double").alias(c)
        return F.round(c, 8 if c in fine else digits).alias(c)
    return df.select(*[one(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_M = "case when measured then diam_nm end"
#: Statistics that merge, per {key} of {src}; the median goes with them in IMAGE_STATS.
IMAGE_SUMS = """select {key}, count(*) as count_total, count(case when measured then 1 end) as count_measured,
 bool_or(classifiable) as classifiable,
 case when bool_or(classifiable) then count(case when classifiable and is_solid then 1 end) end as n_solid,
 case when bool_or(classifiable) then count(case when classifiable and not is_solid and not excluded then 1 end) end as n_flat,
 count(case when excluded then 1 end) as n_excluded, bool_or(classifiable and w0 is not null) as has_patterns,
 count(case when is_solid and pattern='janus' then 1 end) as n_janus, count(case when is_solid and pattern='stripe' then 1 end) as n_stripe,
 count(case when is_solid and pattern='lamellar' then 1 end) as n_lamellar, count(case when is_solid and pattern='composite' then 1 end) as n_composite,
 cast(cast(coalesce(avg({m}),0e0) as float) as double) as mean_nm, round(coalesce(stddev_pop({m}),0e0),6) as std_nm,
 round(coalesce(min({m}),0e0),6) as min_nm, round(coalesce(max({m}),0e0),6) as max_nm{more} from {src} group by {key}"""
IMAGE_STATS = IMAGE_SUMS.replace("{more}", ", round(coalesce(quantile_cont({m}, 0.5),0e0),8) as median_nm")
E1 = IMAGE_STATS.format(key="image_id", m=_M, src="decided")
E2 = IMAGE_STATS.format(key="selection_id", m=_M, src="selected")

SEGMENT = """case when not is_solid then 'undercooled' when pattern<>'' then pattern else 'nopattern' end"""
VOL = f""", vol as (select selection_id, diam_nm, diam_nm*diam_nm*diam_nm as v, {SEGMENT} as seg from selected
 where classifiable and diam_nm<>0 and measured),
 segs as (select unnest(['undercooled','janus','stripe','lamellar','composite','nopattern','solid']) as segment),
 tot as (select selection_id, count(*) as n_total, sum(v) as tv, count(distinct seg) as kinds from vol group by selection_id),
 shares0 as (select t.selection_id, s.segment, n_total, tv,
   sum(case when (s.segment='solid' and seg<>'undercooled') or s.segment=seg then 1 else 0 end) as n,
   sum(case when (s.segment='solid' and seg<>'undercooled') or s.segment=seg then v else 0e0 end) as sv
  from tot t join vol x on t.selection_id=x.selection_id cross join segs s where kinds>1 group by t.selection_id, s.segment, n_total, tv),
 vshares as (select h.selection_id, h.segment, h.n_total, cast(h.n as bigint) as n, h.n*1e0/h.n_total as number_share, h.sv/h.tv as volume_share,
   196e-2*sqrt(sum(pow(v*(case when (h.segment='solid' and seg<>'undercooled') or h.segment=seg then 1e0 else 0e0 end - h.sv/h.tv),2)))/h.tv as ci_half
  from shares0 h join vol x on h.selection_id=x.selection_id group by h.selection_id, h.segment, h.n_total, h.n, h.sv, h.tv)
"""
E11 = """select selection_id, segment, n_total, n, round(number_share,6) as number_share, round(volume_share,6) as volume_share,
 round(ci_half,6) as ci_half from vshares"""


@query("e00_size_report", VOL + f""", st as ({E2}), dv as (select selection_id, quantile_cont(diam_nm,0.1) as d10, quantile_cont(diam_nm,0.9) as d90
  from selected where measured group by selection_id)
 select s.selection_id, s.count_total, s.count_measured, s.mean_nm, s.std_nm, s.median_nm, round(d10,8) as d10, round(d90,8) as d90,
  v.segment, v.n, round(v.volume_share,6) as volume_share, round(v.ci_half,6) as ci_half
 from st s left join dv on s.selection_id=dv.selection_id left join vshares v on s.selection_id=v.selection_id""")
def _(w):
    """Sizes, D-values and volume shares of every selection: the flagship."""
    df = w.scaled
    sizes = stats.image_stats(df, SEL, {"d10": 0.1, "d90": 0.9}, members=w.members).select(
        *SEL, "count_total", "count_measured", "mean_nm", "std_nm", "median_nm", "d10", "d90")
    shares = volume.volume_shares(df, SEL, members=w.members).select(*SEL, "segment", "n", "volume_share", "ci_half")
    return rounded(sizes.join(shares, SEL, "left"), single=["mean_nm"])


@query("e01_image_stats", E1)
def _(w):
    return rounded(stats.image_stats(w.decided, ["image_id"]), single=["mean_nm"])


@query("e02_pooled_stats", f""", base as ({E2}), det as (select selection_id, count(*) as n_images,
  count(case when c then 1 end) as n_classifiable_images, string_agg(distinct det, '+' order by det) as detector
  from (select selection_id, image_id, bool_or(classifiable) as c, case when max(detector)='' then '?' else max(detector) end as det
   from selected group by selection_id, image_id) group by selection_id)
 select b.*, n_images, n_classifiable_images, detector from base b join det d on b.selection_id=d.selection_id""")
def _(w):
    pooled = stats.image_stats(w.scaled, SEL, members=w.members).join(stats.pooled_detectors(w.scaled, SEL, members=w.members), SEL)
    return rounded(pooled, single=["mean_nm"])


@query("e03_flat_and_excluded", """select image_id, count(case when excluded then 1 end) as n_excluded,
 case when bool_or(classifiable) then count(case when not is_solid and not excluded then 1 end) end as n_flat,
 bool_or(classifiable and w0 is not null) as has_patterns from decided group by image_id""")
def _(w):
    return stats.image_stats(w.decided, ["image_id"]).select("image_id", "n_excluded", "n_flat", "has_patterns")


_TITLE = r"""case when regexp_extract(stem, '(?is)^(.*(karışık|karisik|üst|ust|alt))', 1)<>'' then trim(regexp_extract(stem, '(?is)^(.*(karışık|karisik|üst|ust|alt))', 1))
  when trim(regexp_replace(stem, '[-_ 0-9]+$', ''))<>'' then trim(regexp_replace(stem, '[-_ 0-9]+$', '')) else stem end"""


@query("e04_pooled_title", rf""", titles as (select image_id%50 as pool, {_TITLE} as title from (select image_id, replace(image,'.jpeg','') as stem from images)),
 ab as (select pool, min(title) as a, max(title) as b, count(*) as n from titles group by pool),
 pre as (select *, regexp_replace(a[1:(select coalesce(max(i),0) from range(1,60) r(i) where i<=least(length(a),length(b)) and a[1:i]=b[1:i])], '[-_ ]+$', '') as p from ab)
 select pool, case when a=b then a when p<>'' then p else concat(n, ' images') end as title from pre""")
def _(w):
    titles = w.images.select((F.col("image_id") % 50).alias("pool"),
                             text.clean_title(text.stem(F.col("image"))).alias("title"))
    return stats.pooled_title(titles, ["pool"])


@query("e05_d_values", """select selection_id, round(d[1],8) as d10, round(d[2],8) as d50, round(d[3],8) as d90,
 round(case when d[2]<>0 then (d[3]-d[1])/d[2] else 0e0 end,8) as span
 from (select selection_id, quantile_cont(diam_nm,[0.1,0.5,0.9]) as d from selected where measured group by selection_id)""")
def _(w):
    return rounded(stats.d_values(w.scaled, SEL, members=w.members), 8)


_CLS = "case when classifiable and diam_nm<>0 and measured then case when not is_solid then 'undercooled' when pattern<>'' then pattern end end"


@query("e06_class_sizes", f"""select selection_id, cls, n, mean_nm, min_nm, max_nm from (select *, count(*) over (partition by selection_id) as k from
 (select selection_id, cls, count(*) as n, cast(cast(avg(diam_nm) as float) as double) as mean_nm, round(min(diam_nm),6) as min_nm, round(max(diam_nm),6) as max_nm
  from (select selection_id, diam_nm, {_CLS} as cls from selected) where cls is not null group by selection_id, cls)) where k>1""")
def _(w):
    return rounded(stats.class_sizes(w.scaled, SEL, members=w.members), single=["mean_nm"])


CLASS_COUNTS = f""", cc0 as (select selection_id, count(case when measured then 1 end) as measured, cast(0 as bigint) as unclassified,
  count(case when cls='undercooled' then 1 end) as u, count(case when cls='janus' then 1 end) as j, count(case when cls='stripe' then 1 end) as s,
  count(case when cls='lamellar' then 1 end) as l, count(case when cls='composite' then 1 end) as c, count(distinct cls) as k
  from (select *, {_CLS} as cls from selected) group by selection_id),
 cc as (select selection_id, measured, unclassified, case when k>1 then u else 0 end as undercooled, case when k>1 then j else 0 end as janus,
  case when k>1 then s else 0 end as stripe, case when k>1 then l else 0 end as lamellar, case when k>1 then c else 0 end as composite,
  case when k>1 then u+j+s+l+c else 0 end as classified, greatest(0, measured - case when k>1 then u else 0 end - unclassified) as solid from cc0)
"""


@query("e07_class_counts", CLASS_COUNTS + "select * from cc")
def _(w):
    return stats.class_counts(w.scaled, SEL, members=w.members)


_CIRC = "least(1e0, 4e0*pi()*(pi()*25e-2*diam_px*diam_px)/(perim_px*perim_px))"
SPHER = f""", sm as (select *, case when classifiable and is_solid then 'solid' when classifiable then 'undercooled' end as state,
   case when classifiable and not is_solid then 'undercooled' when classifiable and pattern<>'' then pattern end as cls,
   case when not touches_edge and perim_px>=4e0 then {_CIRC} end as circ from selected where measured and diam_nm<>0),
 sp0 as (select selection_id, 'all' as filter, '' as value, circ from sm
  union all select selection_id, 'class', cls, circ from sm where cls is not null
  union all select selection_id, 'state', state, circ from sm where state is not null),
 sp as (select selection_id, filter, value, avg(case when circ is not null then least(1e0, greatest(0e0, (circ-85e-2)/15e-2)) end) as mean_score,
  avg(circ) as raw_circularity, count(circ) as n_scored, count(*) as total from sp0 group by selection_id, filter, value)
"""


@query("e08_sphericity", SPHER + """select selection_id, filter, value, cast(cast(mean_score as float) as double) as mean_score,
 cast(cast(raw_circularity as float) as double) as raw_circularity, n_scored, total from sp""")
def _(w):
    return rounded(stats.sphericity(w.scaled, SEL, members=w.members), single=["mean_score", "raw_circularity"])


SPLIT = """, split as (select selection_id, count(case when is_solid then 1 end) as n_solid, count(case when not is_solid then 1 end) as n_undercooled,
 avg(case when is_solid then diam_nm end) as mean_solid, avg(case when not is_solid then diam_nm end) as mean_undercooled
 from selected where classifiable and measured and diam_nm<>0 group by selection_id
 having count(case when is_solid then 1 end)>0 and count(case when not is_solid then 1 end)>0)
"""


@query("e09_solid_split", SPLIT + """select selection_id, n_solid, n_undercooled, cast(cast(mean_solid as float) as double) as mean_solid,
 cast(cast(mean_undercooled as float) as double) as mean_undercooled from split""")
def _(w):
    return rounded(stats.solid_split(w.scaled, SEL, members=w.members), single=["mean_solid", "mean_undercooled"])


@query("e10_majority_solid", SPLIT + """, r as (select s.selection_id, diam_nm, is_solid,
  sum(case when is_solid then 1 else 0 end) over (partition by s.selection_id order by diam_nm, case when is_solid then 0 else 1 end rows between current row and unbounded following) as ss,
  count(*) over (partition by s.selection_id order by diam_nm, case when is_solid then 0 else 1 end rows between current row and unbounded following) as sn,
  count(*) over (partition by s.selection_id) as n
  from selected s join split p on s.selection_id=p.selection_id where classifiable and measured and diam_nm<>0)
 select selection_id, round(min(case when sn >= least(20,n) and ss*2>=sn then diam_nm end),6) as majority_solid_nm from r group by selection_id""")
def _(w):
    return rounded(stats.majority_solid_above(w.scaled, SEL, members=w.members))


@query("e11_volume_shares", VOL + E11)
def _(w):
    return rounded(volume.volume_shares(w.scaled, SEL, members=w.members))


@query("e12_half_volume_count", VOL + """, r as (select x.selection_id, sum(v) over (partition by x.selection_id order by v desc rows unbounded preceding) as cum, tv
  from vol x join tot t on x.selection_id=t.selection_id where kinds>1)
 select selection_id, count(case when cum < tv/2 then 1 end)+1 as half_n from r group by selection_id""")
def _(w):
    return volume.half_volume_count(w.scaled, SEL, members=w.members)


@query("e13_tiles", VOL + CLASS_COUNTS + SPHER + SPLIT + f""", st as (select selection_id, count(*) as ct, count(case when measured then 1 end) as cm,
  avg({_M}) as mean, min({_M}) as lo, max({_M}) as hi, quantile_cont({_M},0.1) as d10, quantile_cont({_M},0.5) as d50, quantile_cont({_M},0.9) as d90 from selected group by selection_id),
 page as (select st.*, cc.* exclude(selection_id), sp.mean_score, sp.n_scored*1e0/sp.total as scored from st join cc on st.selection_id=cc.selection_id
   left join sp on sp.selection_id=st.selection_id and sp.filter='all'),
 cl as (select selection_id, cls, count(*) as n, avg(diam_nm) as mean from (select selection_id, diam_nm, {_CLS} as cls from selected) where cls is not null group by selection_id, cls),
 clp as (select cl.*, p.ct, p.classified, sp.mean_score, sp.n_scored*1e0/sp.total as scored from cl join page p on p.selection_id=cl.selection_id and p.classified>0
   left join sp on sp.selection_id=cl.selection_id and sp.filter='class' and sp.value=cls),
 spl as (select st.*, n_solid, n_undercooled from st left join split s on s.selection_id=st.selection_id),
 u as (select selection_id, 'all' as view, unnest([
   {{'tile':'mean_size','value':mean,'share':null::double}}, {{'tile':'measured','value':measured::double,'share':measured*1e0/ct}}, {{'tile':'sphericity','value':mean_score,'share':scored}},
   {{'tile':'undercooled','value':undercooled::double,'share':undercooled*1e0/measured}}, {{'tile':'solid','value':solid::double,'share':solid*1e0/measured}},
   {{'tile':'janus','value':janus::double,'share':janus*1e0/measured}}, {{'tile':'stripe','value':stripe::double,'share':stripe*1e0/measured}},
   {{'tile':'composite','value':composite::double,'share':composite*1e0/measured}}, {{'tile':'lamellar','value':lamellar::double,'share':lamellar*1e0/measured}}]) as t from page where classified>0
  union all select selection_id, 'plain', unnest([{{'tile':'total','value':ct::double,'share':null::double}}, {{'tile':'measured','value':measured::double,'share':measured*1e0/ct}},
   {{'tile':'sphericity','value':mean_score,'share':scored}}, {{'tile':'mean_size','value':mean,'share':null::double}}, {{'tile':'range_lo','value':lo,'share':null::double}}, {{'tile':'range_hi','value':hi,'share':null::double}}]) from page where classified=0
  union all select selection_id, concat('class:',cls), unnest([{{'tile':'total','value':ct::double,'share':null::double}}, {{'tile':'count','value':n::double,'share':n*1e0/classified}},
   {{'tile':'mean_size','value':mean,'share':null::double}}, {{'tile':'sphericity','value':mean_score,'share':scored}}]) from clp
  union all select selection_id, 'split', unnest([{{'tile':'solid','value':n_solid::double,'share':n_solid*1e0/(n_solid+n_undercooled)}}, {{'tile':'undercooled','value':n_undercooled::double,'share':n_undercooled*1e0/(n_solid+n_undercooled)}},
   {{'tile':'mean','value':mean,'share':null::double}}, {{'tile':'d10','value':d10,'share':null::double}}, {{'tile':'d50','value':d50,'share':null::double}}, {{'tile':'d90','value':d90,'share':null::double}}]) from spl)
 select selection_id, view, t.tile as tile, cast(cast(t.value as float) as double) as value, round(t.share,6) as share from u
 union all select selection_id, 'volume', segment, cast(cast(volume_share as float) as double), round(ci_half,6) from vshares where segment<>'nopattern'""")
def _(w):
    return rounded(tiles.tiles(w.scaled, SEL, members=w.members), single=["value"])


@query("e14_range_share", """select selection_id, count(case when diam_nm>=1e2 and diam_nm<15e1 then 1 end) as k, count(*) as n,
 cast(cast(avg(case when diam_nm>=1e2 and diam_nm<15e1 then diam_nm end) as float) as double) as mean_inside from selected where measured group by selection_id""")
def _(w):
    return rounded(stats.range_share(w.scaled, SEL, 100.0, 150.0, members=w.members), single=["mean_inside"])


AXIS = """, ax0 as (select {key}, min(diam_nm) as mn, max(diam_nm) as mx from {src} group by {key}),
 ax1 as (select *, case {whens} else 2e3 end as width from (select *, greatest(1e0, mx-mn)/20 as raw from ax0)),
 ax as (select {key}, width, floor(mn/width)*width as axis_lo, greatest(1, cast(round((ceil(mx/width)-floor(mn/width))) as int)) as n_bins from ax1)
"""
_WHENS = " ".join(f"when raw<={w} then {w}e0" for w in K.NICE_WIDTHS)


def axis_sql(key, src):
    return AXIS.format(key=key, src=src, whens=_WHENS)


_BIN = "least(cast(floor((diam_nm-axis_lo)/width) as int), n_bins-1)"


@query("e15_histogram", ", msel as (select * from selected where measured)" + axis_sql("selection_id", "msel") + f"""
 , bars as (select *, unnest(range(0,n_bins)) as bin0 from ax),
 cnt as (select m.selection_id, {_BIN} as bin, count(*) as n from msel m join ax on m.selection_id=ax.selection_id group by all)
 select b.selection_id, cast(bin0 as int) as bin, axis_lo+bin0*width as bin_lo, axis_lo+bin0*width+width as bin_hi, coalesce(n,0) as n,
  (axis_lo+bin0*width+width/2 >= 2e2 and axis_lo+bin0*width+width/2 < 6e2) as highlighted
 from bars b left join cnt c on b.selection_id=c.selection_id and b.bin0=c.bin""")
def _(w):
    return histogram.histogram(w.scaled.where(gates.measurable()), SEL, 200.0, 600.0, members=w.members)


@query("e16_stacked_histogram", ", msel as (select *, case when is_solid then 'solid' else 'undercooled' end as state from selected where measured and classifiable and diam_nm<>0)"
       + axis_sql("selection_id", "msel") + f"""
 select m.selection_id, state, {_BIN} as bin, axis_lo+{_BIN}*width as bin_lo, axis_lo+{_BIN}*width+width as bin_hi, count(*) as n
 from msel m join ax on m.selection_id=ax.selection_id group by all""")
def _(w):
    rows = w.scaled.withColumn("state", classes.split_state()).where("state is not null")
    return histogram.stacked(rows, SEL, "state", members=w.members)


@query("e16b_class_histogram", f", msel as (select * from (select *, {_CLS} as cls from selected) where cls is not null)"
       + axis_sql("selection_id, cls", "msel") + f"""
 select m.selection_id, m.cls, {_BIN} as bin, axis_lo+{_BIN}*width as bin_lo, count(*) as n
 from msel m join ax on m.selection_id=ax.selection_id and m.cls=ax.cls group by all""")
def _(w):
    """Each class on its own axis."""
    rows = w.scaled.withColumn("cls", classes.composition_class()).where("cls is not null")
    return (histogram.histogram(rows, SEL + ["cls"], members=w.members).where("n > 0")
            .select(*SEL, "cls", "bin", "bin_lo", "n"))


@query("e17_composition_per_bin", f", msel as (select *, {_CLS} as cls from selected where measured)" + axis_sql("selection_id", "msel") + f"""
 , c as (select m.selection_id, cls, {_BIN} as bin, axis_lo+{_BIN}*width as bin_lo, count(*) as n
 from msel m join ax on m.selection_id=ax.selection_id where cls is not null group by all)
 select *, round(n*1e0/sum(n) over (partition by selection_id, bin),6) as share from c""")
def _(w):
    rows = w.scaled.where(gates.measurable()).withColumn("cls", classes.composition_class())
    return rounded(histogram.composition_per_bin(rows, SEL, "cls", members=w.members))


@query("e18_pattern_size", f"""select selection_id, cls, least(cast(floor(diam_nm/5e1) as int), 29) as bin, count(*) as n
 from (select *, {_CLS} as cls from selected) where cls is not null group by all""")
def _(w):
    rows = w.scaled.withColumn("cls", classes.composition_class()).where("cls is not null")
    return histogram.pattern_size(rows, SEL, "cls", members=w.members)


_CS = "case when classifiable and diam_nm<>0 and not excluded then case when not is_solid then 'undercooled' when pattern<>'' then pattern end end"


@query("e19_in_range_composition", f"""select *, cast(sum(n_in) over (partition by selection_id) as bigint) as n_in_all from (
 select selection_id, cls, count(case when diam_nm>=4e2 and diam_nm<=9e2 then 1 end) as n_in, count(*) as n_all
 from (select *, {_CS} as cls from selected) where cls is not null group by selection_id, cls)""")
def _(w):
    rows = (w.scaled.withColumn("cls", classes.classsize_class())
            .where(F.col("cls").isin(K.CLASS_ORDER)))
    return histogram.in_range_composition(rows, SEL, "cls", 400.0, 900.0, members=w.members)


@query("e20_volume_histogram", f""", msel as (select *, {SEGMENT} as segment from selected where measured and classifiable and diam_nm<>0)"""
       + axis_sql("selection_id", "msel") + f"""
 , c as (select m.selection_id, segment, {_BIN} as bin, axis_lo+{_BIN}*width as bin_lo, sum(diam_nm*diam_nm*diam_nm) as w
 from msel m join ax on m.selection_id=ax.selection_id group by all)
 select selection_id, segment, bin, bin_lo, round(1e2*w/sum(w) over (partition by selection_id),6) as volume_pct from c""")
def _(w):
    rows = w.scaled.withColumn("segment", classes.volume_segment()).where("segment is not null")
    return rounded(histogram.volume_histogram(rows, SEL, "segment", members=w.members))


_STEP = "case " + " ".join(f"when greatest(1e0,n_bins*width)/6<={w} then {w}e0" for w in K.NICE_WIDTHS) + " else 2e3 end"


@query("e21_axis_helpers", ", msel as (select * from selected where measured)" + axis_sql("selection_id", "msel") + f"""
 , cnt as (select m.selection_id, width, n_bins, {_BIN} as bin, count(*) as n from msel m join ax on m.selection_id=ax.selection_id group by all),
 q as (select selection_id, width, n_bins, coalesce(max(case when bin < greatest(1, cast(floor(n_bins*0.4) as int)) then n end),0) as l,
   coalesce(max(case when bin >= n_bins-greatest(1, cast(floor(n_bins*0.4) as int)) then n end),0) as r, {_STEP} as step from cnt group by all)
 select selection_id, width, n_bins, case when step%width<>0 then ceil(step/width)*width else step end as tick_step,
  case when n_bins>=4 and l<r then 'left' else 'right' end as quiet_corner from q""")
def _(w):
    return histogram.axis_helpers(w.scaled.where(gates.measurable()), SEL, members=w.members)


@query("h01_pool_images", """select selection_id, count(distinct image_id) as n_images, count(*) as n_particles, cast(cast(sum(diam_nm) as float) as double) as sum_nm
 from selected group by selection_id""")
def _(w):
    per_image = w.scaled.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("diam_nm").alias("s"))
    return (w.selections.join(per_image, "image_id").groupBy("selection_id")
            .agg(F.count("*").alias("n_images"), F.sum("n").alias("n_particles"),
                 F.sum("s").cast("float").cast("double").alias("sum_nm")))
