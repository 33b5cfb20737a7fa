"""Overlay, label, matching and training-set queries."""

from pyspark.sql import functions as F

from granulith import constants as K
from granulith.fixtures import _ELIGIBLE
from granulith.functions import classes, gates
from granulith.operators import calibrate, histogram, labels, match, overlay
from granulith.plans.registry import query
from granulith.plans.statistics import rounded

KEY = ["image_id", "particle_id"]

_PIV = """, piv as (select image_id, particle_id, bool_or(kind='view_exclude') as exc, bool_or(kind='measure_exclude') as mexc,
  bool_or(kind='measure_include') as inc, max(case when kind='class' then value end) as ov from overrides group by image_id, particle_id)
"""
VIEW = _PIV + f""", vw as (select d.image_id, d.particle_id, d.diam_nm, d.edge_cut, d.major_px, d.minor_px, d.diam_px, d.solidity, d.measured as gate0,
   coalesce(exc,false) as exc, coalesce(mexc,false) as mexc, coalesce(inc,false) as inc, ov, d.is_solid as s0, d.pattern as pt0, d.excluded as e0
  from decided d left join piv p on d.image_id=p.image_id and d.particle_id=p.particle_id),
 view as (select image_id, particle_id,
   case when exc then false when ov is null then s0 else ov not in ('unknown','undercooled') end as is_solid,
   case when exc then '' when ov is null then pt0 when ov in ('unknown','undercooled','solid') or ov like 'solid:%' then '' else ov end as pattern,
   case when exc then true when ov is not null then false else e0 end as excluded,
   (not exc and ov is not null and ov='unknown') as unclassified,
   (not exc and ov is not null and (ov='solid' or ov like 'solid:%')) as user_solid,
   case when exc or mexc then false when inc then true else gate0 end as measured from vw)
"""


@query("d01_view_overlay", VIEW + "select * from view")
def _(w):
    v = overlay.apply_view(w.decided, w.overrides)
    return v.select(*KEY, "is_solid", "pattern", "excluded", "unclassified", "user_solid",
                    gates.measurable().alias("measured"))


def click_log(w):
    """Repeated class clicks on every particle."""
    rows = w.decided.select(*KEY, "pk", F.explode(
        F.sequence(F.lit(0), (F.col("pk") % 5).cast("int"))).alias("seq"))
    i = ((F.col("pk") + F.floor(F.col("seq") / 2)) % len(overlay.CLICKS)).cast("int")
    return rows.select(*KEY, "seq", F.element_at(F.array(*[F.lit(c) for c in overlay.CLICKS]), i + 1).alias("cls"))


@query("d02_class_clicks", f"""/*recursive*/, log as (select image_id, particle_id, seq, case when cls<>'solid' then cls
   when w0 is not null and {_ELIGIBLE} and named0<>'' and bright>=-30e0 then named0 else 'solid' end as cls
  from (select *, cast(sq as int) as seq, ['undercooled','janus','stripe','lamellar','composite','solid','exclude'][cast((pk + sq//2)%7 as int)+1] as cls
   from (select *, unnest(range(0, pk%5+1)) as sq from decided))),
 f(image_id, particle_id, seq, value, named, exc) as (
  select distinct image_id, particle_id, -1, '', false, false from log
  union all
  select l.image_id, l.particle_id, l.seq,
   case when cls='exclude' then '' when value=cls and u<>'' then u when value=cls or (u<>'' and value=u) then '' else cls end,
   named or (cls<>'exclude' and not (value=cls or (u<>'' and value=u))), case when cls='exclude' then not exc else false end
  from f join (select *, case cls when 'undercooled' then 'unknown' when 'solid' then '' when 'exclude' then '' else concat('solid:',cls) end as u from log) l
   on l.image_id=f.image_id and l.particle_id=f.particle_id and l.seq=f.seq+1),
 fin as (select image_id, particle_id, max_by(value, seq) as value, max_by(named, seq) as named, max_by(exc, seq) as exc from f group by image_id, particle_id)
 select fin.image_id, fin.particle_id, nullif(value,'') as value, exc as view_excluded, (fin.named and not measured) as measure_include, fin.named as lifts_measure_exclude
 from fin join decided d on fin.image_id=d.image_id and fin.particle_id=d.particle_id""")
def _(w):
    log = overlay.resolve_solid(click_log(w), w.decided)
    return overlay.include_on_classify(overlay.fold_class_clicks(log), w.decided)


@query("d03_toggle_measured", _PIV + """/*recursive*/, tog as (select d.image_id, d.particle_id, cast(1+d.pk%3 as int) as n, measured as m,
   coalesce(inc,false) as i, coalesce(mexc,false) as e from decided d left join piv p on d.image_id=p.image_id and d.particle_id=p.particle_id),
 f(image_id, particle_id, k, n, m, i, e) as (select image_id, particle_id, 0, n, m, i, e from tog
  union all select image_id, particle_id, k+1, n, m,
   case when not e and (i or m) then false when e then i else true end,
   case when not e and (i or m) then not i else false end from f where k<n)
 select image_id, particle_id, cast(n as bigint) as n_clicks, i as measure_include, e as measure_exclude from f where k=n""")
def _(w):
    toggles = w.decided.select(*KEY, F.explode(
        F.sequence(F.lit(0), (F.col("pk") % 3).cast("int"))).alias("click"))
    return overlay.toggle_measured(w.decided, toggles, w.overrides)


EFF = """, offered as (select image_id, particle_id, case when not is_solid then 'undercooled' when pattern<>'' then pattern end as m
   from decided where classifiable and not excluded and measured and image_id not in (select image_id from blanks)),
 eff as (select coalesce(o.image_id,c.image_id) as image_id, coalesce(o.particle_id,c.particle_id) as particle_id, coalesce(c.cls, m) as cls, c.cls is not null as from_user
  from (select * from offered where m is not null) o full outer join clicks c on o.image_id=c.image_id and o.particle_id=c.particle_id
  where c.cls is null or c.cls<>'exclude')
"""


@query("d04_train_effective", EFF + "select * from eff")
def _(w):
    return labels.effective(w.decided, w.clicks, w.blanks)


@query("d05_reflect_training", """select image_id, particle_id, kind, value from overrides o where kind not in ('class','view_exclude')
 or not exists (select 1 from clicks c where c.image_id=o.image_id and c.particle_id=o.particle_id)
 union all select image_id, particle_id, case when cls='exclude' then 'view_exclude' else 'class' end, case when cls='exclude' then '' else cls end from clicks""")
def _(w):
    return overlay.reflect_training(w.overrides, w.clicks)


MODEL = "case when excluded then 'excluded' when not is_solid then 'undercooled' when pattern<>'' then pattern else 'solid' end"
PAIRS = f""", truth as (select coalesce(s.image_id,c.image_id) as image_id, coalesce(s.particle_id,c.particle_id) as particle_id, coalesce(c.cls,s.cls) as truth
   from saved s full outer join clicks c on s.image_id=c.image_id and s.particle_id=c.particle_id),
 pairs as (select t.*, {MODEL} as model from truth t join decided d on t.image_id=d.image_id and t.particle_id=d.particle_id),
 cmp as (select *, (truth=model or (truth='exclude' and model='excluded')) as agree from pairs)
"""


@query("d06_disagreements", PAIRS + "select image_id, particle_id, truth, model from cmp where not agree")
def _(w):
    pairs = labels.compared(labels.truth_layers(w.saved, w.clicks), w.decided)
    return pairs.where("not agree").select(*KEY, "truth", "model")


_GOLD = """, gold as (select * from truth_labels where set_name='golden'),
 near as (select g.image_id, g.label_id, min_by(p.particle_id, struct_pack(d2 := (p.cx-g.cx)*(p.cx-g.cx)+(p.cy-g.cy)*(p.cy-g.cy), id := p.particle_id)) as particle_id
  from gold g join counted p on p.image_id=g.image_id and p.cx between g.cx-3 and g.cx+3 and p.cy between g.cy-3 and g.cy+3
  where (p.cx-g.cx)*(p.cx-g.cx)+(p.cy-g.cy)*(p.cy-g.cy) <= 9e0 group by g.image_id, g.label_id)
"""


def golden(w):
    return w.labels.where("set_name = 'golden'")


@query("d07_match_labels", _GOLD + """select g.image_id, g.label_id, n.particle_id from gold g left join near n on g.image_id=n.image_id and g.label_id=n.label_id""")
def _(w):
    return match.match_labels(golden(w), w.counted).select("image_id", "label_id", "particle_id")


# A 3 x 3 mask around every centre; where masks meet, the lowest id owns the pixel.
_MASK = """, mask as (select image_id, y, x, min(particle_id) as particle_id from (
   select image_id, particle_id, cast(cy as int)+dy as y, cast(cx as int)+dx as x from counted cross join (select unnest([-1,0,1]) as dy) cross join (select unnest([-1,0,1]) as dx)) group by image_id, y, x)
"""


def centre_masks(w):
    """The masks as runs, three for each centre; equal centres are one."""
    x, y = F.col("cx").cast("int"), F.col("cy").cast("int")
    centres = w.counted.groupBy("image_id", x.alias("x"), y.alias("y")).agg(F.min("particle_id").alias("label"))
    return centres.select("image_id", "label", (F.col("x") - 1).alias("x0"), (F.col("x") + 1).alias("x1"),
                          F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y"))


@query("d07b_match_by_mask", _GOLD + _MASK + """select g.image_id, g.label_id, coalesce(m.particle_id, n.particle_id) as particle_id
 from gold g left join mask m on m.image_id=g.image_id and m.y=round_even(g.cy,0) and m.x=round_even(g.cx,0)
 left join near n on g.image_id=n.image_id and g.label_id=n.label_id""")
def _(w):
    return (match.match_labels(golden(w), w.counted, runs=centre_masks(w))
            .select("image_id", "label_id", "particle_id"))


@query("d08_crop_measurable", """, tab as (select image_id, cast(diam_nm as float) as d, bool_and(measured) as m from decided group by image_id, cast(diam_nm as float)
  having count(distinct measured)=1)
 select l.image_id, l.label_id, coalesce(m,false) as measurable, m is not null as known
 from truth_labels l left join tab t on t.image_id=l.image_id and t.d=cast(l.diam_nm as float) where set_name='train'""")
def _(w):
    crops = w.labels.where("set_name = 'train'").select("image_id", "label_id", "diam_nm")
    return labels.crop_measurable(crops, w.decided).select("image_id", "label_id", "measurable", "known")


@query("d09_conflicts", """select distinct g.image_id from truth_labels g join truth_labels t on g.image_id=t.image_id
 where g.set_name='golden' and t.set_name='train'""")
def _(w):
    return labels.golden_train_conflicts(w.labels)


@query("d09b_refuse_golden", """select image_id, label_id, class from truth_labels where set_name='train'
 and image_id not in (select image_id from truth_labels where set_name='golden')""")
def _(w):
    rows = w.labels
    return labels.refuse_golden(rows.where("set_name = 'train'"), rows.where("set_name = 'golden'")).select(
        "image_id", "label_id", "class")


@query("d15_instruments", """select image_id, coalesce(nullif(upper(trim(detector)),''),'no nameplate') as golden_name,
 case when image_id%13=0 then 'unknown' else coalesce(nullif(trim(detector),''),'no nameplate') end as curve_name from images""")
def _(w):
    return w.images.select("image_id", labels.instrument_golden(F.col("detector")).alias("golden_name"),
                           labels.instrument_curve(F.col("detector"), F.col("image_id") % 13 != 0).alias("curve_name"))


CAL_ROWS = """, cal as (select d.image_id as photo, d.particle_id, l.class as cls, facet_frac, d.diam_nm, p0, p1, p2, p3, named0, w0 is not null as four
  from decided d join truth_labels l on d.image_id=l.image_id and d.particle_id=l.label_id
  where l.set_name='train' and l.class<>'exclude' and pipeline='7.cur' and classifiable)
"""


def calibration_rows(w):
    return calibrate.calibration_rows(w.labels.where("set_name = 'train'"), w.decided, "7.cur")


@query("d16_calibration_rows", CAL_ROWS + "select photo, particle_id, cls, facet_frac, four as has_probs from cal")
def _(w):
    return calibration_rows(w).select("photo", "particle_id", "cls", "facet_frac", gates.has_probs().alias("has_probs"))


@query("d21_accept_model", f""", asked as (select image_id, particle_id, {MODEL} as m from decided where ok%3=0)
 select image_id, particle_id, cls from clicks c where not exists (select 1 from asked a where a.image_id=c.image_id and a.particle_id=c.particle_id and m<>'solid')
 union all select image_id, particle_id, case when m='excluded' then 'exclude' else m end from asked where m<>'solid'""")
def _(w):
    return overlay.accept_model(w.clicks, w.decided, w.decided.where("ok % 3 = 0"))


@query("d21b_clear_class", "select * from clicks where image_id%3<>0 or cls<>'stripe'")
def _(w):
    return overlay.clear_class(w.clicks, w.images.where("image_id % 3 = 0"), "stripe")


@query("d21c_clear_photo", """select 'label' as kind, image_id, count(*) as n from clicks where image_id%3<>0 group by image_id
 union all select 'blank', image_id, 1 from images where image_id%3=0 or image_id%7=0""")
def _(w):
    left, blanks = overlay.clear_photo(w.clicks, w.blanks, w.images.where("image_id % 3 = 0"))
    return (left.groupBy(F.lit("label").alias("kind"), "image_id").agg(F.count("*").alias("n"))
            .unionByName(blanks.select(F.lit("blank").alias("kind"), "image_id", F.lit(1).cast("long").alias("n"))))


@query("h02_labels_union_excludes", """select image_id, count(*) as n_rows, count(case when class='exclude' then 1 end) as n_excluded
 from truth_labels where set_name='train' group by image_id""")
def _(w):
    rows = w.labels.where("set_name = 'train'")
    named = rows.where("class <> 'exclude'").select("image_id", "label_id", F.lit(0).alias("x"))
    gone = rows.where("class = 'exclude'").select("image_id", "label_id", F.lit(1).alias("x"))
    return named.union(gone).groupBy("image_id").agg(F.count("*").alias("n_rows"), F.sum("x").alias("n_excluded"))


@query("h03_golden_and_train", """select image_id from truth_labels where set_name='golden' intersect select image_id from truth_labels where set_name='train'""")
def _(w):
    return labels.golden_train_conflicts(w.labels)


_GONE = "(select image_id, particle_id from decided where ok%10<>0)"


@query("h04_missing_ids", f"select image_id, particle_id from saved except select image_id, particle_id from {_GONE}")
def _(w):
    return labels.missing_ids(w.saved, w.decided.where("ok % 10 <> 0"))


SIG = """select {key}, count(*) as n_labels, substr(sha1(concat_ws(':', count(*), sum(('0x' || h[1:8])::bigint), sum(('0x' || h[9:16])::bigint),
  sum(('0x' || h[17:24])::bigint), sum(('0x' || h[25:32])::bigint))),1,16) as signature
 from (select *, md5(concat(particle_id, ':', case when cls='exclude' then 'x' else cls end)) as h from {src}) group by {key}"""


@query("f17_signature", SIG.format(key="image_id", src="saved"))
def _(w):
    return labels.signature(w.saved, ["image_id"])


@query("f18_training_state", EFF + f""", cur0 as (select image_id, particle_id, cls from eff union all select image_id, particle_id, cls from clicks where cls='exclude'),
 sv as ({SIG.format(key="image_id", src="saved")}), cu as ({SIG.format(key="image_id", src="cur0")}),
 ic as (select image_id, case when upper(detector)='CBS' then true when upper(detector) in ('ETD','SE','SE2','TLD','INLENS') then false else structure >= 45e-2 end as c from images)
 select ic.image_id, case when sv.signature is null then 'new' when not c or sv.signature=cu.signature then 'saved' else 'edited' end as state
 from ic left join sv on sv.image_id=ic.image_id left join cu on cu.image_id=ic.image_id""")
def _(w):
    eff = labels.effective(w.decided, w.clicks, w.blanks).select(*KEY, "cls")
    current = eff.unionByName(w.clicks.where("cls = 'exclude'"))
    images = w.images.withColumn("classifiable", gates.classifiable())
    return labels.training_state(images, labels.signature(w.saved, ["image_id"]),
                                 labels.signature(current, ["image_id"]))


@query("f19_restore_report", f"""select s.image_id, count(*) as n_saved, count(d.particle_id) as n_matched, count(*)-count(d.particle_id) as n_missing
 from saved s left join {_GONE} d on s.image_id=d.image_id and s.particle_id=d.particle_id group by s.image_id""")
def _(w):
    return labels.restore_report(w.saved, w.decided.where("ok % 10 <> 0"))


@query("f20_after_reanalysis", "select kind, image_id, count(*) as n from overrides where image_id%4<>1 group by kind, image_id")
def _(w):
    left = overlay.after_reanalysis(w.overrides, w.images.where("image_id % 4 = 1"))
    return left.groupBy("kind", "image_id").agg(F.count("*").alias("n"))


@query("f21_agreement", PAIRS + """select image_id, count(*) as checked, count(case when agree then 1 end) as agree,
  round(count(case when agree then 1 end)*1e0/count(*),6) as share, count(*)-count(case when not agree and model='solid' then 1 end) as checked_named,
  round(coalesce(count(case when agree then 1 end)*1e0/nullif(count(*)-count(case when not agree and model='solid' then 1 end),0),0e0),6) as share_named
 from cmp group by image_id""")
def _(w):
    pairs = labels.compared(labels.truth_layers(w.saved, w.clicks), w.decided)
    return rounded(labels.agreement(pairs, ["image_id"]))


@query("f21b_disagreement_pairs", PAIRS + "select truth, model, count(*) as n from cmp where not agree group by truth, model")
def _(w):
    pairs = labels.compared(labels.truth_layers(w.saved, w.clicks), w.decided)
    return labels.disagreement_pairs(pairs, [])


@query("f22_model_vs_effective", EFF + f""", md as (select image_id, particle_id, {MODEL} as cls from decided),
 a as (select image_id, cls, count(*) as n_model, 0 as e, 0 as r, 0 as x from md group by image_id, cls
  union all select image_id, cls, 0, count(*), 0, 0 from eff where cls in ('undercooled','janus','stripe','lamellar','composite') group by image_id, cls
  union all select c.image_id, c.cls, 0, 0, count(*), 0 from clicks c join md on md.image_id=c.image_id and md.particle_id=c.particle_id and md.cls='excluded' where c.cls<>'exclude' group by c.image_id, c.cls
  union all select image_id, 'excluded', 0, 0, 0, count(*) from clicks where cls='exclude' group by image_id)
 select image_id, cls, cast(sum(n_model) as bigint) as n_model, cast(sum(e) as bigint) as n_effective, cast(sum(r) as bigint) as n_rescued,
  cast(sum(x) as bigint) as n_user_excluded, cast(sum(e)-sum(n_model) as bigint) as difference from a group by image_id, cls""")
def _(w):
    eff = labels.effective(w.decided, w.clicks, w.blanks)
    return labels.model_vs_effective(w.decided, eff, w.clicks, ["image_id"])


@query("f23_pending_corrections", """, t as (select kind, image_id, count(*) as n from overrides where image_id%3=0 group by kind, image_id)
 select kind, cast(sum(n) as bigint) as n, count(*) as n_photos, count(case when image_id in (select image_id from saved) then 1 end) as n_confirmed from t group by kind""")
def _(w):
    return overlay.pending_corrections(w.overrides, w.images.where("image_id % 3 = 0"), w.saved)


@query("f24_classsize_from_labels", EFF + """select e.image_id, cls, least(cast(floor(diam_nm/5e1) as int), 29) as bin, count(*) as n
 from eff e join decided d on e.image_id=d.image_id and e.particle_id=d.particle_id where diam_nm<>0 group by all""")
def _(w):
    eff = labels.effective(w.decided, w.clicks, w.blanks).select(*KEY, "cls")
    sized = w.decided.where("diam_nm <> 0").select(*KEY, "diam_nm").join(eff, KEY)
    return histogram.pattern_size(sized, ["image_id"], "cls")


@query("f16_training_summary", """, s as (select set_name, class, count(*) as n, count(distinct image_id) as n_photos from truth_labels
  where class in ('janus','stripe','lamellar','composite') group by set_name, class)
 select set_name, class, n, n_photos, round(sum(n) over (partition by set_name)*1e0/(4*n),6) as weight,
  (sum(n) over (partition by set_name) >= 60 and count(*) over (partition by set_name) >= 2) as trainable from s""")
def _(w):
    return rounded(labels.training_summary(w.labels))


@query("f25_train_readiness", """select set_name, count(distinct image_id) as n_photos, count(distinct image_id)>=3 as ready from truth_labels group by set_name""")
def _(w):
    return labels.train_readiness(w.labels)
