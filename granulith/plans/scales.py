"""Scale reading and reconciliation queries."""

from pyspark.sql import functions as F

from granulith import constants as K
from granulith.operators import scale
from granulith.plans.registry import query
from granulith.plans.statistics import rounded


def raw(w):
    """The reader's cells as a map of header to text; empty cells are not there."""
    cells = {"MAG": F.when(F.col("hv_ocr") == "", F.col("mag_ocr")), "HFW": F.col("hfw_ocr"),
             "PLATE": F.col("plate_ocr"), "DET": F.col("det_ocr"), "HV": F.col("hv_ocr")}
    full = F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)])
    return w.scale_raw.withColumn("fields", F.map_filter(full, lambda k, v: v != ""))


def readings(w):
    return scale.cross_check(scale.read_bar(raw(w)))


_TOK = "'([0-9uoqzsbgli.,]+?)\\s*(nm|µm|um|pm|mm|m)\\b'"


def label_sql(col):
    num = f"try_cast(trim(replace(translate(regexp_extract(lower({col}), {_TOK}, 1), 'uoqzsbglit', '0002589111'), ',', '.'), '.') as double)"
    unit = f"regexp_extract(lower({col}), {_TOK}, 2)"
    return f"case when {num} > 0 then {num} * case {unit} when 'nm' then 1e0 when 'mm' then 1e6 else 1e3 end end"


_DIG = "'^\\s*([\\dOoDQlIS|B][\\dOoDQlIS|B ]*)'"
MAG = f"""case when hv_ocr='' then mag_ocr else regexp_extract(hv_ocr, '(\\d[\\dOo ]*)\\s*[xX×]\\b', 1) end"""
RAW = f""", r0 as (select *, {label_sql('label_ocr')} as label_nm0, {label_sql('hfw_ocr')} as hfw0,
   coalesce(try_cast(replace(translate(regexp_extract({MAG}, {_DIG}, 1), 'OoDQlI|SB', '000011158'), ' ', '') as bigint), 0) as mag0,
   regexp_extract(lower(label_ocr), {_TOK}, 2) as unit0, translate(regexp_extract(lower(label_ocr), {_TOK}, 1), 'uoqzsbglit', '0002589111') as num0 from scale_readings_raw),
 r1 as (select *, case when mag0 between 10 and 2000000 then mag0 else 0 end as mag, label_nm0/bar_px as bar_npp,
   case when hfw0/width_px between 5e-2 and 5e2 then hfw0/width_px else 0e0 end as hfw_npp,
   case when plate_ocr='BIOMATEN' then 'BIOMATEN' else '' end as instrument, regexp_extract(upper(det_ocr), '(CBS|ETD|SE2|INLENS|BSE|TLD|SE)', 1) as detector from r0),
 rd as (select *, case when hfw_npp>0 then hfw_npp when coalesce(bar_npp between 5e-2 and 5e2,false) then bar_npp else 0e0 end as npp,
   (hfw_npp>0 or coalesce(bar_npp between 5e-2 and 5e2,false)) as ok, case when hfw_npp>0 then 'HFW' else 'bar' end as source,
   case when coalesce(bar_npp between 5e-2 and 5e2,false) then label_nm0 when hfw_npp>0 then hfw_npp*width_px else 0e0 end as label_nm,
   case when coalesce(bar_npp between 5e-2 and 5e2,false) then concat(num0, ' ', case when unit0='nm' then 'nm' else 'µm' end) when hfw_npp>0 then 'HFW 20.7 µm' else '' end as label_text,
   case when not coalesce(bar_npp between 5e-2 and 5e2,false) and label_nm0 is null then case when hfw_npp>0 then 'label_unreadable_hfw' else 'label_unreadable' end
        when not coalesce(bar_npp between 5e-2 and 5e2,false) then case when hfw_npp>0 then 'implausible_hfw' else 'implausible' end
        when hfw_npp>0 and abs(hfw_npp-bar_npp)/hfw_npp>1e-1 then 'hfw_bar_disagree' else '' end as note from r1),
 r2 as (select *, case when instrument<>'' and mag>0 and source<>'HFW' then 413e0*1e6/(width_px*mag) else 0e0 end as mag_npp from rd),
 r3 as (select *, case when ok and mag_npp>0 then npp/mag_npp end as ratio, list_filter([{','.join(f'{v}e0' for v in K.STANDARD_LABELS_NM)}],
   lambda v: mag_npp>0 and abs(v/(mag_npp*bar_px)-1)<=5e-2) as fits from r2),
 r4 as (select *, case when mag_npp=0 then '' when not ok then 'mag_only' when abs(ratio-1)<=5e-2 then 'agree'
   when round_even(log10(ratio),0)<>0 and abs(ratio/pow(1e1, round_even(log10(ratio),0))-1)<=5e-2 then 'mag_misread'
   when len(fits)=1 then 'label_fixed' else 'conflict' end as chk from r3),
 rx as (select image_id, width_px, bar_px, case when chk='label_fixed' then fits[1]/bar_px when chk in ('mag_only','conflict') then mag_npp else npp end as nm_per_px,
   case when chk='label_fixed' then fits[1] else label_nm end as label_nm,
   case when chk='label_fixed' then case when fits[1]<1000 then concat(cast(fits[1] as bigint),' nm') else concat(cast(fits[1]/1000 as bigint),' µm') end else label_text end as label_text,
   (ok or chk='mag_only') as ok, case when chk in ('mag_only','conflict') then 'mag' else source end as source, note, hfw_npp*width_px as hfw_nm, detector, mag, instrument, mag_npp, chk as check,
   case when chk='label_fixed' then label_text else '' end as label_read from r4)
"""


@query("c01_parse_label", RAW + "select image_id, label_ocr, label_nm0 as label_nm from r0")
def _(w):
    return raw(w).select("image_id", "label_ocr", scale.parse_label(F.col("label_ocr")).alias("label_nm"))


@query("c02_magnification", RAW + "select image_id, mag from r1")
def _(w):
    return raw(w).select("image_id", scale.magnification(F.col("fields")).alias("mag"))


@query("c03_detector_instrument", RAW + "select image_id, detector, instrument from r1")
def _(w):
    return raw(w).select("image_id", scale.detector(F.col("fields")).alias("detector"),
                         scale.instrument(F.col("fields")).alias("instrument"))


@query("c04_field_width", RAW + "select image_id, round(hfw_npp,9) as hfw_npp from r1")
def _(w):
    return raw(w).select("image_id", F.round(scale.hfw_npp(F.col("fields"), F.col("width_px")), 9).alias("hfw_npp"))


@query("c05_source_priority", RAW + """select image_id, round(npp,6) as nm_per_px, round(label_nm,6) as label_nm, label_text, ok, source, note, round(hfw_npp*width_px,6) as hfw_nm from rd""")
def _(w):
    return rounded(scale.read_bar(raw(w)).select("image_id", "nm_per_px", "label_nm", "label_text", "ok",
                                                 "source", "note", "hfw_nm"))


@query("c06_cross_check", RAW + """select image_id, round(nm_per_px,6) as nm_per_px, round(label_nm,6) as label_nm, label_text, label_read, ok, source, mag, round(mag_npp,6) as mag_npp, "check", instrument from rx""")
def _(w):
    return rounded(readings(w).select("image_id", "nm_per_px", "label_nm", "label_text", "label_read", "ok", "source",
                                      "mag", "mag_npp", "check", "instrument"))


_OVR = """, ovr as (select image_id, image_id%50 as bar_px, 5e2 as label_nm, 5e2/(image_id%50) as nm_per_px, 1000+image_id as size from images where image_id%9=0 and image_id%50>0),
 fin as (select x.image_id, case when o.size=s.size then o.nm_per_px else x.nm_per_px end as nm_per_px, case when o.size=s.size then o.bar_px else x.bar_px end as bar_px,
   case when o.size=s.size then o.label_nm else x.label_nm end as label_nm, case when o.size=s.size then 'manual' else source end as source,
   case when o.size=s.size then 'manual' else "check" end as "check", (ok or coalesce(o.size=s.size,false)) as ok
  from rx x left join (select image_id, 1000+image_id+case when image_id%18=0 then 1 else 0 end as size from images) s on s.image_id=x.image_id left join ovr o on o.image_id=x.image_id)
"""


def with_hand_scales(w):
    hand = scale.valid_overrides(w.images.where("image_id % 9 = 0").select(
        "image_id", F.lit(100).cast("long").alias("left_x"), (F.lit(100) + F.col("image_id") % 50).alias("right_x"),
        F.lit(500.0).alias("label_nm"), (F.col("image_id") + 1000).alias("size")))
    sizes = w.images.select("image_id", (F.col("image_id") + 1000 + (F.col("image_id") % 18 == 0).cast("int")).alias("size"))
    return scale.with_manual(readings(w), sizes, hand)


@query("c07_manual_override", RAW + _OVR + """select image_id, round(nm_per_px,6) as nm_per_px, bar_px, round(label_nm,6) as label_nm, source, "check", ok from fin""")
def _(w):
    return rounded(with_hand_scales(w).select("image_id", "nm_per_px", "bar_px", "label_nm", "source", "check", "ok"))


@query("c08_adopt_reading", RAW + """select i.image_id, i.nm_per_px, coalesce(x.ok and i.nm_per_px>0 and x.nm_per_px>0 and abs(x.nm_per_px/nullif(i.nm_per_px,0)-1)<=5e-3,false) as adopted
 from (select image_id, case when image_id%2=0 then 20 else nm_per_px end as nm_per_px from (select image_id, nm_per_px from images)) i left join rx x on x.image_id=i.image_id""")
def _(w):
    used = w.images.withColumn("nm_per_px", F.when(F.col("image_id") % 2 == 0, 20.0).otherwise(F.col("nm_per_px")))
    return scale.adopt(used, readings(w))


@query("c09_verdict", RAW + _OVR + """, v as (select i.image_id, i.nm_per_px as used, f.* exclude(image_id) from images i left join (select * from fin where image_id%19<>0) f on i.image_id=f.image_id)
 select image_id, case when ok is null and used>0 then 'info' when ok is null or not (ok and nm_per_px>0) then 'bad' when source='manual' then 'info' when source='HFW' then 'good'
   when "check" in ('agree','mag_misread') then 'good' when "check" in ('label_fixed','mag_only','conflict') then 'warn' else 'info' end as level,
  case when ok is null and used>0 then 'not checked' when ok is null or not (ok and nm_per_px>0) then 'scale not read' when source='manual' then 'set by hand' when source='HFW' then 'from HFW'
   when "check" in ('agree','mag_misread') then 'confirmed' when "check"='label_fixed' then 'label corrected' when "check"='mag_only' then 'from magnification' when "check"='conflict' then 'check this'
   else 'not cross-checked' end as verdict from v""")
def _(w):
    r = with_hand_scales(w).where("image_id % 19 <> 0")
    used = w.images.select("image_id", F.col("nm_per_px").alias("used"))
    level, short = scale.verdict(F.col("used"))
    return used.join(r, "image_id", "left").select("image_id", level.alias("level"), short.alias("verdict"))
