"""Evaluation, calibration and review queries."""

from pyspark.sql import functions as F

from granulith import constants as K
from granulith.functions import classes, gates
from granulith.operators import calibrate, evaluate, labels, match, review
from granulith.plans.decisions import CONF
from granulith.plans.labelling import CAL_ROWS, KEY, _GOLD, calibration_rows, golden
from granulith.plans.registry import query
from granulith.plans.statistics import rounded

MATCHED = _GOLD + """, mt as (select g.image_id, coalesce(nullif(upper(trim(detector)),''),'no nameplate') as instrument,
  case when g.class in ('janus','stripe','lamellar','composite') then g.class else 'nopat' end as truth,
  case when d.pattern<>'' then d.pattern else 'nopat' end as pred, d.measured
  from gold g join near n on g.image_id=n.image_id and g.label_id=n.label_id join decided d on d.image_id=n.image_id and d.particle_id=n.particle_id),
 sc as (select 'combined' as scope, '' as value, 'all_labelled' as population, * from mt union all select 'instrument', instrument, 'all_labelled', * from mt
  union all select 'photo', cast(image_id as varchar), 'all_labelled', * from mt union all select 'combined', '', 'measured', * from mt where measured
  union all select 'instrument', instrument, 'measured', * from mt where measured union all select 'photo', cast(image_id as varchar), 'measured', * from mt where measured),
 cl as (select unnest(['janus','stripe','lamellar','composite','nopat']) as class),
 grp as (select distinct scope, value, population from sc),
 pc0 as (select g.scope, g.value, g.population, c.class, count(case when truth=c.class then 1 end) as n, count(case when pred=c.class then 1 end) as np,
   count(case when truth=c.class and pred=c.class then 1 end) as hit
  from grp g cross join cl c join sc on sc.scope=g.scope and sc.value=g.value and sc.population=g.population group by all),
 pc1 as (select *, case when n>0 then hit*1e0/n end as recall, case when n>0 then coalesce(hit*1e0/nullif(np,0),0e0) end as prec from pc0),
 pc as (select *, case when n>0 then case when recall+prec>0 then 2*recall*prec/(recall+prec) else 0e0 end end as f1 from pc1)
"""


def matched(w):
    """Golden labels with the answer the app gives at their position."""
    m = match.match_labels(golden(w), w.counted).where("particle_id is not null")
    answers = w.decided.select(*KEY, labels.instrument_golden(F.col("detector")).alias("instrument"),
                               classes.answer().alias("pred"), gates.measurable().alias("measured"))
    return (m.select(*KEY, classes.report_class().alias("truth")).join(answers, KEY)
            .select("image_id", "instrument", "truth", "pred", "measured"))


SCOPE = ["scope", "value", "population"]


@query("f01_class_metrics", MATCHED + """select scope, value, population, class, n, round(recall,6) as recall, round(prec,6) as prec, round(f1,6) as f1 from pc""")
def _(w):
    return rounded(evaluate.per_class(evaluate.confusion(evaluate.scoped(matched(w)), SCOPE), SCOPE))


@query("f01b_confusion", MATCHED + """select scope, value, population, truth, pred, count(*) as n from sc group by all""")
def _(w):
    return evaluate.scoped(matched(w))


@query("f02_evaluation_report", MATCHED + """select s.*, round(macro,6) as macro_f1 from (select scope, value, population, count(*) as n, round(count(case when truth=pred then 1 end)*1e0/count(*),6) as acc,
   round(count(case when (truth='nopat')=(pred='nopat') then 1 end)*1e0/count(*),6) as solid_acc from sc group by all) s
 join (select scope, value, population, avg(f1) as macro from pc where n>0 group by all) m on s.scope=m.scope and s.value=m.value and s.population=m.population""")
def _(w):
    return rounded(evaluate.report(matched(w)))


@query("f02b_unmatched", _GOLD + """select g.image_id, count(*) as n_labels, count(*)-count(n.particle_id) as n_unmatched
 from gold g left join near n on g.image_id=n.image_id and g.label_id=n.label_id group by g.image_id""")
def _(w):
    return evaluate.unmatched(match.match_labels(golden(w), w.counted))


FITS = CAL_ROWS + """, fi as (select 'facet_thresh' as name, photo, facet_frac as p, case when cls<>'undercooled' then 1 else 0 end as y, 5e-1 as cur from cal
  union all select 'janus_min_solid', photo, facet_frac, case when cls='janus' then 1 else 0 end, 55e-2 from cal where four and named0='janus'
  union all select 'nopattern_solid_conf', photo, facet_frac, case when cls<>'undercooled' then 1 else 0 end, 9e-1 from cal where four and named0=''
  union all select 'stripe_small_min_conf', photo, p1, case when cls='stripe' then 1 else 0 end, 8e-1 from cal where four and diam_nm<350e0
  union all select 'janus_small_min_conf', photo, p0, case when cls='janus' then 1 else 0 end, 55e-2 from cal where four and diam_nm<350e0),
 grid as (select unnest(range(5,96)) as c),
 pcut as (select name, photo, c, count(case when y=1 and p>=c/1e2 then 1 end) as tp, count(case when y=0 and p>=c/1e2 then 1 end) as fp,
   count(case when y=1 then 1 end) as pp, count(case when y=0 then 1 end) as nn,
   count(case when y=1 and p>=cur then 1 end) as ctp, count(case when y=0 and p<cur then 1 end) as ctn from fi cross join grid group by name, photo, c),
 tc as (select name, c, sum(tp) as tp, sum(fp) as fp, sum(pp) as pp, sum(nn) as nn from pcut group by name, c),
 best as (select name, min_by(c, struct_pack(s := -s, c := c))/1e2 as cut, max(s) as score from (select *, 5e-1*(tp*1e0/nullif(pp,0) + (nn-fp)*1e0/nullif(nn,0)) as s from tc) where s is not null group by name),
 tr as (select a.name, a.photo, a.c, sum(b.tp) as tp, sum(b.fp) as fp, sum(b.pp) as pp, sum(b.nn) as nn from pcut a join pcut b on a.name=b.name and a.c=b.c and a.photo<>b.photo group by a.name, a.photo, a.c),
 pick as (select name, photo, min_by(c, struct_pack(s := -s, c := c)) as c from (select *, 5e-1*(tp*1e0/nullif(pp,0) + (nn-fp)*1e0/nullif(nn,0)) as s from tr) where s is not null group by name, photo),
 loo as (select f.name, cast(sum(f.pp+f.nn) as bigint) as n_rows, count(*) as n_photos,
   sum(case when k.c is not null and f.pp>0 and f.nn>0 then (f.pp+f.nn)*own end)/sum(case when k.c is not null and f.pp>0 and f.nn>0 then f.pp+f.nn end) as fit_score,
   sum(case when k.c is not null and f.pp>0 and f.nn>0 then (f.pp+f.nn)*curs end)/sum(case when k.c is not null and f.pp>0 and f.nn>0 then f.pp+f.nn end) as current_score
  from (select distinct name, photo, pp, nn, 5e-1*(ctp*1e0/nullif(pp,0) + ctn*1e0/nullif(nn,0)) as curs from pcut) f
  left join pick k on k.name=f.name and k.photo=f.photo
  left join (select name, photo, c, 5e-1*(tp*1e0/nullif(pp,0) + (nn-fp)*1e0/nullif(nn,0)) as own from pcut) o on o.name=f.name and o.photo=f.photo and o.c=k.c group by f.name)
"""


@query("f03_balanced_accuracy", FITS + """select name, photo, round(5e-1*(ctp*1e0/nullif(pp,0) + ctn*1e0/nullif(nn,0)),6) as balanced from pcut where c=5""")
def _(w):
    cuts = calibrate.cut_counts(calibrate.fit_inputs(calibration_rows(w))).where(f"cut = {calibrate.FIRST}")
    score = calibrate.balanced(F.col("cur_tp"), F.col("n_all") - F.col("cur_tn"), F.col("p_all"), F.col("n_all"))
    return rounded(cuts.select("name", "photo", score.alias("balanced")))


@query("f04_best_cut", FITS + "select name, cut, round(score,6) as score from best")
def _(w):
    return rounded(calibrate.best_cuts(calibrate.cut_counts(calibrate.fit_inputs(calibration_rows(w)))))


@query("f05_lopo", FITS + """select name, n_rows, n_photos, round(case when n_photos>=4 then fit_score end,6) as fit_score, round(case when n_photos>=4 then current_score end,6) as current_score from loo""")
def _(w):
    return rounded(calibrate.leave_one_out(calibrate.cut_counts(calibrate.fit_inputs(calibration_rows(w)))))


@query("f06_fit_thresholds", FITS + """, d as (select * from (values ('facet_thresh',5e-1),('janus_min_solid',55e-2),('nopattern_solid_conf',9e-1),('stripe_small_min_conf',8e-1),('janus_small_min_conf',55e-2)) t(name, current)),
 al as (select n_rows, n_photos from loo where name='facet_thresh'),
 yy as (select name, sum(y) as pos, count(*)-sum(y) as neg from fi group by name),
 r as (select d.name, d.current, coalesce(l.n_rows,0) as n_rows, coalesce(l.n_photos,0) as n_photos, b.cut,
   case when l.n_photos>=4 then fit_score end as fit_score, case when l.n_photos>=4 then current_score end as current_score,
   case when coalesce(al.n_rows,0)<300 or coalesce(al.n_photos,0)<4 then 'not_enough_data'
    when (d.name<>'facet_thresh' and coalesce(l.n_rows,0)<100) or (d.name in ('stripe_small_min_conf','janus_small_min_conf') and not coalesce(pos>0 and neg>0,false)) then 'too_few'
    when l.n_photos<4 or fit_score is null then 'no_spread' when cut is not null and fit_score > current_score+2e-3 then 'adopted' else 'kept' end as decision
  from d left join loo l on l.name=d.name left join best b on b.name=d.name left join yy on yy.name=d.name left join al on true)
 select name, current, n_rows, n_photos, cut, round(fit_score,6) as fit_score, round(current_score,6) as current_score, decision,
  case when decision='adopted' then cut else current end as value from r""")
def _(w):
    return rounded(calibrate.fit(calibration_rows(w)))


@query("f07_restamp", """, n1 as (select *, (facet_frac>=6e-1 and diam_nm>=2e2 and classifiable) as s1, (facet_frac>=6e-1 and diam_nm>=2e2 and classifiable and w0 is not null and edge_cut<=11e-1 and solidity>=7e-1 and minor_px/major_px>=3e-1) as j1 from counted where pipeline='7.cur'),
 n2 as (select n1.*, case when not j1 then '' when g.named0='janus' and n1.facet_frac<7e-1 then '' else g.named0 end as nm from n1 join gate1 g on g.image_id=n1.image_id and g.particle_id=n1.particle_id)
 select image_id, particle_id, (j1 and nm<>'' and bright<-30e0) as excluded, case when j1 and nm<>'' and bright<-30e0 then '' else nm end as pattern,
  case when j1 and nm<>'' and bright<-30e0 then false when j1 and nm='' then facet_frac>=9e-1 else s1 end as is_solid, '7.new' as pipeline from n2""")
def _(w):
    new = {**K.DEFAULT_THRESHOLDS, "facet_thresh": 0.60, "janus_min_solid": 0.70}
    return calibrate.restamp(w.decided, new, "7.cur", "7.new").select(
        *KEY, "excluded", "pattern", "is_solid", "pipeline")


QUEUE = f""", rq as (select image_id, particle_id, case when not is_solid then 'undercooled' when pattern<>'' then pattern else 'solid' end as cls,
   {CONF} as conf, diam_nm from decided where classifiable and not excluded and diam_nm>=2e2 and measured),
 qrows as (select * from rq where not exists (select 1 from clicks c where c.image_id=rq.image_id and c.particle_id=rq.particle_id)),
 queue as (select *, row_number() over (partition by cls order by conf, image_id, particle_id)-1 as rank, count(*) over (partition by cls) as n_items from qrows)
"""


@query("d10_review_selection", QUEUE + "select image_id, particle_id, cls from qrows")
def _(w):
    return review.queue_rows(w.decided, w.clicks).select(*KEY, "cls")


@query("g01_review_queue", QUEUE + "select image_id, particle_id, cls, round(conf,6) as conf, rank, n_items from queue")
def _(w):
    q = review.queue(review.queue_rows(w.decided, w.clicks))
    return rounded(q.select(*KEY, "cls", "conf", "rank", "n_items"))


@query("g02_review_pages", QUEUE + """select cls, rank//32 as page, count(*) as n, min(rank) as first_rank, round(max(conf),6) as max_conf from queue group by cls, rank//32""")
def _(w):
    q = review.queue(review.queue_rows(w.decided, w.clicks))
    return rounded(q.groupBy("cls", "page").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"),
                                                F.max("conf").alias("max_conf")))


@query("d11_prefilled_review", QUEUE + """select rq.image_id, rq.particle_id, rq.cls, coalesce(c.cls, rq.cls) as shown from rq
 left join clicks c on c.image_id=rq.image_id and c.particle_id=rq.particle_id""")
def _(w):
    rows = review.queue_rows(w.decided, w.clicks.limit(0))
    return review.prefilled(rows, w.clicks).select(*KEY, "cls", "shown")


@query("f08_review_counts", QUEUE + """select cls, count(case when not exists (select 1 from clicks c where c.image_id=rq.image_id and c.particle_id=rq.particle_id) then 1 end) as pending,
 count(*) as every from rq group by cls""")
def _(w):
    return review.counts(w.decided, w.clicks)


VERDICTS = QUEUE + """, allq as (select *, row_number() over (partition by cls order by conf, image_id, particle_id)-1 as rank0, count(*) over (partition by cls) as n_items from rq),
 verd as (select q.image_id, q.particle_id, q.cls as model_cls, l.cls as cls, rank0 as rank from allq q join saved l on l.image_id=q.image_id and l.particle_id=q.particle_id)
"""


def verdicts(w):
    """Queue pages submitted twice: first as the model saw them, then as the labels say."""
    q = review.queue(review.queue_rows(w.decided, w.clicks.limit(0)))
    truth = w.saved.withColumnRenamed("cls", "truth")
    both = q.select(*KEY, "conf", "rank", "n_items", F.col("cls").alias("model_cls")).join(truth, KEY)
    return both.select(*KEY, "conf", "rank", "n_items", "model_cls", F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.col("model_cls").alias("cls")),
        F.struct(F.lit(2).alias("seq"), F.col("truth").alias("cls")))).alias("s")).select(
        *KEY, "conf", "rank", "n_items", "model_cls", "s.seq", "s.cls")


@query("f09_accepted", VERDICTS + "select image_id, count(*) as n_seen, count(case when cls<>model_cls then 1 end) as n_fixed from verd group by image_id")
def _(w):
    return review.accepted(verdicts(w), ["image_id"])


@query("f10_rank_note", VERDICTS + """, v as (select *, row_number() over (partition by model_cls order by rank, image_id, particle_id) as rn, count(*) over (partition by model_cls) as n from verd),
 r as (select model_cls, n, 1e2*avg(case when rn<=n//4 then case when cls<>model_cls then 1e0 else 0e0 end end) as f, 1e2*avg(case when rn>n-n//4 then case when cls<>model_cls then 1e0 else 0e0 end end) as l from v where n>=40 group by model_cls, n)
 select model_cls, n, round(f,6) as first_pct, round(l,6) as last_pct, (l>=15e0 and l>=5e-1*f) as systematic from r""")
def _(w):
    return rounded(review.rank_note(verdicts(w), ["model_cls"]))


@query("f11_photo_progress", VERDICTS + """, v as (select *, row_number() over (partition by image_id order by rank, cls, particle_id) as rn, count(*) over (partition by image_id) as n from verd),
 t as (select image_id, count(case when not excluded and diam_nm>=2e2 and measured then 1 end) as n_reviewable from decided where classifiable group by image_id),
 s as (select image_id, count(*) as n_seen, count(case when cls<>model_cls then 1 end) as n_fixed, 1e2*avg(case when n>=20 and rn>n//2 then case when cls<>model_cls then 1e0 else 0e0 end end) as p from v group by image_id)
 select s.image_id, n_seen, n_fixed, round(p,6) as sure_wrong_pct, n_reviewable, coalesce(p>=15e0,false) as flag from s left join t on t.image_id=s.image_id""")
def _(w):
    return rounded(review.photo_progress(verdicts(w), w.decided))


@query("g07_worst_photos", MATCHED + """, a as (select value, count(case when truth=pred then 1 end)*1e0/count(*) as acc from sc where scope='photo' and population='measured' group by value)
 select cast(value as bigint) as image_id, round(acc,6) as acc, rank() over (order by coalesce(acc,0)) as place from a""")
def _(w):
    """Places come from the counts per distinct accuracy, so no photo list is ever sorted in one task."""
    rep = evaluate.report(matched(w)).where("scope = 'photo' and population = 'measured'").select(
        F.col("value").cast("long").alias("image_id"), F.coalesce("acc", F.lit(0.0)).alias("acc"))
    ties = rep.groupBy("acc").agg(F.count("*").alias("t")).withColumn("_one", F.lit(1))
    from granulith.operators.ranking import suffix_counts
    # suffix_counts looks upwards; on the negated value it counts the photos with a lower accuracy
    lower = suffix_counts(ties.withColumn("neg", -F.col("acc")), ["_one"], "neg", ["t"])
    places = lower.select("acc", (F.col("above_t") + 1).alias("place"))
    return rounded(rep.join(places, "acc").select("image_id", "acc", "place"))
