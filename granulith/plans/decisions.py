"""Row-level decision queries: gates, classes, floors, notes."""

from pyspark.sql import functions as F

from granulith import constants as K
from granulith.functions import classes, gates, text
from granulith.operators import thresholds as thr
from granulith.plans.registry import query
from granulith.session import spread

IDS = ["image_id", "particle_id"]


@query("b01_pattern_eligible", """select image_id, particle_id,
 (edge_cut <= 11e-1 and solidity >= 7e-1 and case when major_px<>0 then minor_px/major_px else 0e0 end >= 3e-1) as eligible
 from particles""")
def _(w):
    return w.particles.select(*IDS, gates.pattern_eligible().alias("eligible"))


@query("b02_ellipse_fill", """select image_id, particle_id,
 round(case when major_px*minor_px>0 then diam_px*diam_px/(major_px*minor_px) else 1e0 end, 6) as fill from particles""")
def _(w):
    return w.particles.select(*IDS, F.round(gates.ellipse_fill(), 6).alias("fill"))


@query("b03_measurable", "select image_id, particle_id, measured from decided")
def _(w):
    return w.decided.select(*IDS, gates.measurable().alias("measured"))


_CIRC = "case when perim_px>=4e0 then least(1e0, 4e0*pi()*(pi()*25e-2*diam_px*diam_px)/(perim_px*perim_px)) end"


@query("b04_circularity", f"select image_id, particle_id, round({_CIRC}, 6) as circ from particles")
def _(w):
    return w.particles.select(*IDS, F.round(gates.circularity(), 6).alias("circ"))


@query("b05_sphericity_score", f"""select image_id, particle_id,
 round(least(1e0, greatest(0e0, (circ-85e-2)/15e-2)), 6) as score
 from (select image_id, particle_id, {_CIRC} as circ from particles)""")
def _(w):
    return w.particles.select(*IDS, F.round(gates.sphericity_score(), 6).alias("score"))


@query("b06_spherical_measurable", """select image_id, particle_id,
 (measured and not touches_edge and perim_px >= 4e0) as scored from decided""")
def _(w):
    return w.decided.select(*IDS, gates.spherical_measurable().alias("scored"))


@query("b07_size_aware_pattern", "select image_id, particle_id, named0 as pattern from gate1")
def _(w):
    return w.counted.select(*IDS, gates.size_aware_pattern().alias("pattern"))


@query("b08_solidify_pattern", """select image_id, particle_id, case when w0 is not null and named0<>'' and bright>=-30e0
 and edge_cut <= 11e-1 and solidity >= 7e-1 and minor_px/major_px >= 3e-1 then named0 else 'solid' end as forced from gate1""")
def _(w):
    return w.counted.select(*IDS, gates.solidify_pattern().alias("forced"))


@query("b09_reclassify", "select image_id, particle_id, is_solid, pattern, excluded from decided")
def _(w):
    return w.decided.select(*IDS, "is_solid", "pattern", "excluded")


@query("b10_count_floors", """select image_id, count(*) as n_all,
 count(case when diam_px>=4e0 and (nm_per_px<=0 or diam_nm>15e0) then 1 end) as n_counted,
 count(case when diam_px>=4e0 and (nm_per_px<=0 or diam_nm>15e0) and diam_nm>=1e2 then 1 end) as n_from_100nm,
 count(case when pi()/4*diam_px*diam_px >= 30e0 or diam_nm < 25e1 then 1 end) as n_area_ok,
 count(case when pi()/4*diam_px*diam_px >= pi()*4e0 and diam_px >= 4e0 then 1 end) as n_stored_ok
 from particles group by image_id""")
def _(w):
    area = F.pi() / 4 * F.col("diam_px") * F.col("diam_px")
    rows = w.particles.withColumns({"area_px": area, "is_small": F.col("diam_nm") < K.SMALL_MAX_NM})
    return rows.groupBy("image_id").agg(
        F.count("*").alias("n_all"), F.count_if(gates.count_floor()).alias("n_counted"),
        F.count_if(gates.count_floor(100.0)).alias("n_from_100nm"),
        F.count_if(gates.area_floor()).alias("n_area_ok"),
        F.count_if(gates.stored_floor()).alias("n_stored_ok"))


@query("b11_classifiable", """select image_id, detector,
 case when upper(detector)='CBS' then true when upper(detector) in ('ETD','SE','SE2','TLD','INLENS') then false
      else structure >= 45e-2 end as classifiable from images""")
def _(w):
    return w.images.select("image_id", "detector", gates.classifiable().alias("classifiable"))


_SKIP = "(diam_nm < 2e2 or not measured)"


@query("b12_review_class", f"""select image_id, particle_id, case when excluded or {_SKIP} then ''
 when not is_solid then 'undercooled' when pattern<>'' then pattern else 'solid' end as cls from decided""")
def _(w):
    return w.decided.select(*IDS, classes.review_class().alias("cls"))


@query("b12b_model_class", """select image_id, particle_id, case when excluded then 'excluded'
 when not is_solid then 'undercooled' when pattern<>'' then pattern else 'solid' end as cls from decided""")
def _(w):
    return w.decided.select(*IDS, classes.model_class().alias("cls"))


@query("b12c_answer", """select d.image_id, d.particle_id, t.set_name, case when pattern<>'' then pattern else 'nopat' end as answer,
 case when t.class in ('janus','stripe','lamellar','composite') then t.class else 'nopat' end as truth
 from decided d join truth_labels t on d.image_id=t.image_id and d.particle_id=t.label_id""")
def _(w):
    truth = w.labels.select("image_id", F.col("label_id").alias("particle_id"), "set_name",
                            classes.report_class().alias("truth"))
    return (w.decided.select(*IDS, classes.answer().alias("answer")).join(truth, IDS)
            .select(*IDS, "set_name", "answer", "truth"))


_COMP = "case when classifiable and diam_nm<>0 and measured then case when not is_solid then 'undercooled' when pattern<>'' then pattern {tail} end end"


@query("b12d_composition_bucket", f"""select image_id, particle_id, {_COMP.format(tail='')} as bucket,
 {_COMP.format(tail="else 'nopattern'")} as segment from scaled""")
def _(w):
    return w.scaled.select(*IDS, classes.composition_class().alias("bucket"),
                           classes.volume_segment().alias("segment"))


@query("b12e_classsize_bucket", """select image_id, particle_id, case when classifiable and diam_nm<>0 and not excluded then
 case when not is_solid then 'undercooled' when pattern<>'' then pattern else 'solid' end end as bucket from scaled""")
def _(w):
    return w.scaled.select(*IDS, classes.classsize_class().alias("bucket"))


@query("b13_skip_review", f"select image_id, particle_id, {_SKIP} as skipped from decided")
def _(w):
    return w.decided.select(*IDS, classes.skip_review().alias("skipped"))


CONF = """case when is_solid and pattern<>'' and w0 is not null
 then least(least(1e0, abs(facet_frac-5e-1)/5e-1), list_sort([p0,p1,p2,p3],'DESC')[1]-list_sort([p0,p1,p2,p3],'DESC')[2])
 else least(1e0, abs(facet_frac-5e-1)/5e-1) end"""


@query("b14_confidence", f"select image_id, particle_id, round({CONF}, 6) as conf from decided")
def _(w):
    return w.decided.select(*IDS, F.round(classes.confidence(), 6).alias("conf"))


_LABEL = "case when not excluded then case when not is_solid then 'undercooled' when pattern<>'' then pattern else 'solid' end end"


@query("b15_certainty", f"""select image_id, particle_id, label, round(case label when 'undercooled' then 1e0-facet_frac
 when 'solid' then facet_frac when 'janus' then p0 when 'stripe' then p1 when 'lamellar' then p2 when 'composite' then p3 end, 6) as certainty
 from (select *, {_LABEL} as label from decided)""")
def _(w):
    label = classes.certainty_label()
    return (w.decided.withColumn("label", label)
            .select(*IDS, "label", F.round(classes.certainty_value(F.col("label")), 6).alias("certainty")))


@query("b16_rule_note", f"""select image_id, particle_id, case when label is null or label<>'undercooled' or facet_frac<5e-1 then ''
 when diam_nm<2e2 then 'size_floor' when named0='janus' and facet_frac<55e-2 then 'janus_floor'
 when named0='' then 'no_credible_pattern' else '' end as note
 from (select *, {_LABEL} as label from decided)""")
def _(w):
    return (w.decided.withColumn("label", classes.certainty_label())
            .select(*IDS, classes.rule_note(F.col("label")).alias("note")))


# Spellings that exercise the title and naming rules: composed, and the same with separate marks; long numbers; letters of
# other alphabets, ligatures, Roman numerals and full-width forms.
NAMES = ["ÄK - 11 Alt2", "07 | Große | Janus 3", "Janus 8 | 07 | Große", "QB - 11 y 2 mm 4", "ÄK - 02 Karışık 5", "KARIŞIK 9",
         "alternierend 6", "", "A\u0308K - 11 Alt2", "A\u0308K - 02 Karıs\u0327ık 5", "KARIS\u0327IK 9", "U\u0308st 3 | 04",
         "a 123456789012345678901", "a 123456789012345678902", "a 0012345678901234567890",
         "Mẫu - 05 thử 3", "Ma\u0302\u0303u - 05 thu\u031b\u0309 4", "Ǎb - 06 ǖn 2", "TD - 04 ﬁne Ⅳ mm", "TD - 04 ＡＢ１ mm", "ΆΛΦΑ Й 2", "đł ø"]
NAMES_SQL = " union all ".join(f"select {i} as variant, '{n}' as extra" for i, n in enumerate(NAMES))


def named_images(w):
    """Every image once under its own name (variant -1) and once under each extra spelling."""
    spellings = [F.struct(F.lit(-1).alias("variant"), F.regexp_replace("image", r"\.jpeg$", "").alias("stem"))]
    spellings += [F.struct(F.lit(i).alias("variant"), F.lit(n).alias("stem")) for i, n in enumerate(NAMES)]
    # names take long to read, and the few tasks that read the images would read them all
    return (spread(w.images.select("image_id", "image"), "image_id").select("image_id", F.explode(F.array(*spellings)).alias("s"))
            .select("image_id", "s.variant", "s.stem"))


NAMED_SQL = f""", named_images as (select image_id, -1 as variant, replace(image, '.jpeg', '') as stem from images
 union all select image_id, variant, extra as stem from images cross join ({NAMES_SQL}))
"""


@query("b17_clean_title", NAMED_SQL + r"""select image_id, variant, case when hit<>'' then trim(hit)
  when trim(regexp_replace(stem, '[-_ 0-9]+$', ''))<>'' then trim(regexp_replace(stem, '[-_ 0-9]+$', '')) else stem end as title
 from (select *, regexp_extract(stem, '(?is)^(.*(karışık|karisik|üst|ust|alt))', 1) as hit from named_images)""")
def _(w):
    return named_images(w).select("image_id", "variant", text.clean_title(F.col("stem")).alias("title"))


@query("b18_freshness", """select i.image_id, case when d.image_id is null then 'none' when pipeline='7.cur' then 'current' else 'stale' end as state
 from images i left join (select distinct image_id from particles where image_id%9<>0) d on i.image_id=d.image_id""")
def _(w):
    analysed = w.particles.where("image_id % 9 <> 0").select("image_id").distinct()
    return thr.freshness(w.images, analysed, "7.cur")


@query("b19_pipeline_stamp", """select image_id, concat('7.', substr(md5(concat('v7|', detector, '|', image,
 '|facet_thresh=0.5000|janus_min_solid=0.5500|janus_small_min_conf=0.5500|nopattern_solid_conf=0.9000|stripe_small_min_conf=0.8000')), 1, 10)) as stamp
 from images""")
def _(w):
    return w.images.select("image_id", thr.pipeline_stamp(
        [F.col("detector"), F.col("image")], K.DEFAULT_THRESHOLDS).alias("stamp"))


@query("b20_threshold_overlay", """, stored as (select image_id,
  case image_id%7 when 0 then 'facet_thresh' when 1 then 'janus_min_solid' when 2 then 'nopattern_solid_conf'
   when 3 then 'stripe_small_min_conf' when 4 then 'janus_small_min_conf' when 5 then 'unknown_name' else 'facet_thresh' end as name,
  case when image_id%11=0 then 'abc' when image_id%13=0 then '1.5' else cast((image_id%10)/10e0 as varchar) end as value from images),
 defaults as (select * from (values ('facet_thresh',5e-1),('janus_min_solid',55e-2),('nopattern_solid_conf',9e-1),
  ('stripe_small_min_conf',8e-1),('janus_small_min_conf',55e-2)) t(name, default_value))
 select i.image_id, d.name, default_value,
  coalesce(case when try_cast(s.value as double)>0 and try_cast(s.value as double)<1 then try_cast(s.value as double) end, default_value) as value,
  (s.value is not null) as fitted
 from images i cross join defaults d left join stored s on s.image_id=i.image_id and s.name=d.name""")
def _(w):
    names = list(K.DEFAULT_THRESHOLDS) + ["unknown_name", "facet_thresh"]
    m = F.col("image_id") % 7
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (m + 1).cast("int"))
    value = (F.when(F.col("image_id") % 11 == 0, "abc").when(F.col("image_id") % 13 == 0, "1.5")
             .otherwise(((F.col("image_id") % 10) / 10.0).cast("string")))
    stored = w.images.select("image_id", name.alias("name"), value.alias("value"))
    return thr.overlay(w.images.select("image_id"), stored, ["image_id"])


@query("b21_unscaled_images", """select i.image_id, image, i.nm_per_px<=0 as left_out, count(p.particle_id) as n_particles
 from images i left join counted p on i.image_id=p.image_id group by i.image_id, image, i.nm_per_px""")
def _(w):
    n = w.counted.groupBy("image_id").agg(F.count("*").alias("n_particles"))
    return (w.images.join(n, "image_id", "left")
            .select("image_id", "image", (F.col("nm_per_px") <= 0).alias("left_out"),
                    F.coalesce("n_particles", F.lit(0)).alias("n_particles")))


@query("b22_number_entry", """select ok, ln, image_id, particle_id, case when pk%5=4 then null when pk%5<3 then cast(k2 as double)/10e0
  when pk%15=8 then 1e3 when pk%15=13 then null when ok%4=0 then 15e1 end as value
 from (select *, (ok%1000)*10 + pk%10 as k2 from particles)""")
def _(w):
    tenths = (F.col("ok") % 1000) * 10 + F.col("pk") % 10
    plain = F.concat((F.floor(tenths / 10)).cast("string"), F.lit(","), (tenths % 10).cast("string"))
    typed = (F.when(F.col("pk") % 5 == 4, "  ").when(F.col("pk") % 15 == 8, "1_000")
             .when(F.col("pk") % 15 == 13, F.element_at(F.array(*map(F.lit, ("12d", "5f", "12..x", "1__0"))), (F.col("ok") % 4 + 1).cast("int")))
             .when(F.col("pk") % 5 == 3, F.element_at(F.array(*map(F.lit, ("1.5e2", "0x10", "7L", "_1"))), (F.col("ok") % 4 + 1).cast("int")))
             .when(F.col("pk") % 5 == 2, F.concat(F.lit(" "), F.replace(plain, F.lit(","), F.lit(".")), F.lit(" ")))
             .otherwise(plain))
    return w.particles.select("ok", "ln", *IDS, text.parse_number(typed).alias("value"))


SHARE = """case when {n} is null or {n}=0 then '—' when 1e2*{k}/{n}>0 and 1e2*{k}/{n}<5e-1 then '<1%'
 when 1e2*{k}/{n}>=995e-1 and 1e2*{k}/{n}<1e2 then '>99%' else concat(cast(cast(round_even(1e2*{k}/{n},0) as bigint) as varchar), '%') end"""


@query("b23_share_text", f"""select image_id, k, n, {SHARE.format(k='k', n='n')} as share from
 (select image_id, count(case when is_solid and pattern='janus' then 1 end) as k, count(*) - count(case when image_id%10=0 then 1 end) as n
  from decided group by image_id)""")
def _(w):
    counts = w.decided.groupBy("image_id").agg(
        F.count_if(F.col("is_solid") & (F.col("pattern") == "janus")).alias("k"),
        (F.count("*") - F.count_if(F.col("image_id") % 10 == 0)).alias("n"))
    return counts.select("image_id", "k", "n", text.share_text(F.col("k"), F.col("n")).alias("share"))


@query("b24_range_sentence", f"""select image_id, case when n>0 then concat({SHARE.format(k='k', n='n')}, ' of the measured particles (', k, ' of ', n, ') ',
  case when k=1 then 'is' else 'are' end, ' between', chr(160), '100', chr(160), 'and', chr(160), '150.5', chr(160), 'nm',
  case when k>0 then concat(', with a mean size of ', cast(cast(round_even(m,0) as bigint) as varchar), ' nm.') else '.' end) end as sentence from
 (select image_id, count(case when diam_nm>=1e2 and diam_nm<1505e-1 then 1 end) as k, count(*) as n,
   avg(case when diam_nm>=1e2 and diam_nm<1505e-1 then diam_nm end) as m from scaled where measured group by image_id)""")
def _(w):
    from granulith.operators.stats import range_share
    r = range_share(w.scaled, ["image_id"], 100.0, 150.5)
    return r.select("image_id", text.range_sentence(
        F.col("k"), F.col("n"), F.col("mean_inside"), 100.0, 150.5).alias("sentence"))
