"""Particle tables derived from the star-schema test tables.

Each table is a fixed, narrow mapping of its source (`lineitem` rows become
particles, `supplier` rows become images), so the work grows with the source.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from granulith import constants as K
from granulith.functions import gates
from granulith.session import join_lookup, settle, spread, tune

IMAGES_SQL = """
select s_suppkey as image_id,
 concat(case s_suppkey%3 when 2 then 'TD' else 'UÖ' end, ' - ', lpad(cast(s_nationkey%12+1 as varchar(4)),2,'0'), ' ',
  case s_suppkey%5 when 0 then 'Alt' when 1 then 'Üst' when 2 then 'Karışık' when 3 then 'Janus' else 'x 5 cm' end,
  ' ', cast(s_suppkey%9+1 as varchar(4)), '.jpeg') as image,
 case when s_suppkey%17=0 then 0e0 else (4+s_suppkey%25)*1e0 end as nm_per_px,
 case s_nationkey%4 when 1 then '' when 2 then 'ETD' else 'CBS' end as detector,
 case when s_nationkey%4=1 then (s_suppkey%10)/10e0 else -1e0 end as structure,
 case when s_suppkey%6=0 then '6.old' else '7.cur' end as pipeline,
 1536 as width_px, 1024 as height_px
from supplier
"""

# A particle id is built from the row's own columns, so no table-wide or
# per-image ordering is needed to number the particles.
RAW_PARTICLES_SQL = """
select l_suppkey as image_id,
 l_orderkey*8192 + l_linenumber*1024 + (l_partkey*31 + cast(round(l_extendedprice*100e0) as bigint)*7)%1024 as particle_id,
 l_orderkey as ok, l_partkey as pk, l_linenumber as ln,
 (l_orderkey*37%1536)*1e0 as cx, (l_partkey*29%1024)*1e0 as cy,
 3e0 + l_extendedprice/2000e0 as diam_px,
 1e0 + (l_partkey%16)/10e0 as elong, (100+l_orderkey%10)/100e0 as k,
 (200-l_orderkey%30)/200e0 as solidity, (l_partkey*7%101)/100e0 as facet_frac,
 (l_returnflag='R' and l_linenumber%2=0) as touches_edge, l_tax*15e0 as tx,
 ((l_suppkey+l_orderkey)%81-50)*1e0 as bright, (80+l_linenumber*3)/100e0 as circ_t,
 (1+(l_partkey*3+l_orderkey)%17)*1e0 as a0, (1+(l_partkey*5+l_orderkey)%17)*1e0 as a1,
 (1+(l_partkey*7+l_orderkey)%17)*1e0 as a2, (1+(l_partkey*11+l_orderkey)%17)*1e0 as a3
from lineitem
"""

PARTICLE_COLUMNS_SQL = """
 r.image_id, particle_id, ok, pk, ln, cx, cy, diam_px, diam_px*nm_per_px as diam_nm,
 diam_px*sqrt(elong*k) as major_px, diam_px*sqrt(k/elong) as minor_px, solidity, facet_frac, touches_edge,
 case when touches_edge then tx else 0e0 end as edge_cut,
 sqrt(pi()*pi()*diam_px*diam_px/circ_t) as perim_px, bright,
 case when pk%13=0 then null else a0*a0*a0*a0 end as w0, a1*a1*a1*a1 as w1, a2*a2*a2*a2 as w2, a3*a3*a3*a3 as w3,
 nm_per_px, detector, structure, pipeline
"""

LABEL_ROWS_SQL = """
 select image_id, particle_id as label_id, cx + (pk%5-2) as cx, cy + (ok%5-2) as cy, diam_nm,
  case when bright < -35e0 then 'exclude'
       when facet_frac + (ok%41-20)/100e0 < 5e-1 then 'undercooled'
       when pk%5=0 or w0 is null then case ok%4 when 0 then 'janus' when 1 then 'stripe' when 2 then 'lamellar' else 'composite' end
       when w0>=w1 and w0>=w2 and w0>=w3 then 'janus' when w1>=w2 and w1>=w3 then 'stripe'
       when w2>=w3 then 'lamellar' else 'composite' end as class
 from particles where ln=1
"""

LABEL_SETS_SQL = """
 select image_id, case when image_id%4=0 then 'golden' else 'train' end as set_name from images
 union all select image_id, 'train' as set_name from images where image_id%20=0
"""

# The two branches cannot hold the same (particle, kind) twice, so no distinct is needed.
OVERRIDES_SQL = """
select image_id, particle_id,
 case pk%6 when 0 then 'view_exclude' when 1 then 'measure_include' when 2 then 'measure_exclude' else 'class' end as kind,
 case when pk%6<3 then '' else case ok%6 when 0 then 'unknown' when 1 then 'undercooled' when 2 then 'solid'
  when 3 then 'solid:janus' when 4 then 'stripe' else 'lamellar' end end as value
from particles where ok%11=0
union all
select image_id, particle_id, 'class' as kind, case ok%3 when 0 then 'janus' when 1 then 'unknown' else 'solid' end as value
from particles where ok%13=0 and (ok%11<>0 or pk%6<3)
"""

SCALE_RAW_SQL = """
select s_suppkey as image_id, 1536 as width_px, 100 + s_suppkey*7%200 as bar_px,
 case s_suppkey%8 when 0 then '5 µm' when 1 then '1 m' when 2 then '5um' when 3 then '500 nm' when 4 then '2uu nm'
  when 5 then 'det 5 pm' when 6 then '0m' else '??' end as label_ocr,
 case s_suppkey%5 when 0 then '16 000 x' when 1 then '12 O00 x' when 2 then '5 000 x' when 3 then '' else '1 600 x' end as mag_ocr,
 case when s_suppkey%7=0 then '20.7 µm' else '' end as hfw_ocr,
 case when s_suppkey%2=0 then 'BIOMATEN' else 'METU' end as plate_ocr,
 case s_nationkey%4 when 1 then '' when 2 then 'etd x' else 'CBS' end as det_ocr,
 case when s_suppkey%10=9 then '10.00 kV 40 000 X 1.00e-2 Pa' else '' end as hv_ocr
from supplier
"""

CURVE_SQL = """
select c_custkey as run_id, frac, draw, cast(600*frac*(1+c_custkey%3) as int) as n_train,
 round(86e-2 - (1+c_custkey%4)*5e-1/sqrt(600*frac*(1+c_custkey%3)) + draw*1e-3, 6) as acc,
 round(95e-2 - frac*(c_custkey%5)*1e-2, 6) as acc_train
from customer cross join (select 2e-1 as frac, 0 as draw union all select 2e-1, 1 union all select 4e-1, 0 union all select 4e-1, 1
 union all select 6e-1, 0 union all select 8e-1, 0 union all select 1e0, 0) f
"""

# Who is looked at together: every image alone, five groups and everything.
SELECTIONS_SQL = """
select image_id, concat('image-', cast(image_id as varchar(20))) as selection_id from images
union all select image_id, concat('group-', cast(image_id%5 as varchar(20))) as selection_id from images
union all select image_id, 'all' as selection_id from images
"""


class Workbench:
    """Lazily built tables over one scale-factor directory."""

    #: Columns of `lineitem` that the raw particles keep.
    carried: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for name in frames:
            text = text.replace(f"from {name}", f"from {{{name}}}")
        return self.spark.sql(text, **frames)

    @cached_property
    def images(self) -> DataFrame:
        return self._sql(IMAGES_SQL, supplier=self.table("supplier"))

    @cached_property
    def mapped(self) -> DataFrame:
        """Particles with the mapping's own columns, before any floor."""
        source = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax", "l_returnflag", *self.carried)
        more = "".join(f", {c}" for c in self.carried)
        raw = self._sql(RAW_PARTICLES_SQL.replace("\nfrom lineitem", f"{more}\nfrom lineitem"), lineitem=source)
        looked_up = self.images.select("image_id", "nm_per_px", "detector", "structure", "pipeline")
        joined = join_lookup(raw, looked_up, ["image_id"])
        return self.spark.sql(f"select {PARTICLE_COLUMNS_SQL}{more} from {{r}} r", r=joined)

    @cached_property
    def particles(self) -> DataFrame:
        """Model-shaped particles, before any floor."""
        weights = [F.col(f"w{i}") for i in range(4)]
        total = F.col("_total")
        weighed = self.mapped.withColumn("_total", weights[0] + weights[1] + weights[2] + weights[3])
        probs = (F.when(total.isNotNull(), F.array(*[w / total for w in weights]))
                 .otherwise(F.array().cast("array<double>")))
        return (settle(weighed, {"pattern_probs": probs})
                .withColumns({"user_measurable": F.lit(None).cast("boolean"),
                              "unclassified": F.lit(False), "user_solid": F.lit(False)})
                .drop("w0", "w1", "w2", "w3", "_total"))

    @cached_property
    def counted(self) -> DataFrame:
        return self.particles.where(gates.count_floor())

    @cached_property
    def decided(self) -> DataFrame:
        """Counted particles with classifiable, is_solid, pattern and excluded set."""
        return gates.reclassify(self.counted.withColumn("classifiable", gates.classifiable()))

    @cached_property
    def scaled(self) -> DataFrame:
        return self.decided.where("nm_per_px > 0")

    @cached_property
    def selections(self) -> DataFrame:
        return self._sql(SELECTIONS_SQL, images=self.images)

    @cached_property
    def members(self) -> DataFrame:
        """The images of every selection."""
        return self.images.select("image_id", F.explode(F.array(
            F.concat(F.lit("image-"), F.col("image_id").cast("string")),
            F.concat(F.lit("group-"), (F.col("image_id") % 5).cast("string")),
            F.lit("all"))).alias("selection_id"))

    @cached_property
    def labels(self) -> DataFrame:
        rows = self._sql(LABEL_ROWS_SQL, particles=self.mapped)
        sets = self.images.select("image_id", F.when(
            F.col("image_id") % 20 == 0, F.array(F.lit("golden"), F.lit("train")))
            .when(F.col("image_id") % 4 == 0, F.array(F.lit("golden")))
            .otherwise(F.array(F.lit("train"))).alias("sets"))
        return (join_lookup(rows, sets, ["image_id"])
                .withColumn("set_name", F.explode("sets")).drop("sets"))

    @cached_property
    def saved(self) -> DataFrame:
        """Labels the photos were added to the training set with."""
        return self.labels.where("set_name = 'train'").select(
            "image_id", F.col("label_id").alias("particle_id"), F.col("class").alias("cls"))

    @cached_property
    def clicks(self) -> DataFrame:
        """Current label clicks on a part of the saved labels, some of them changed."""
        return self.saved.where("particle_id % 2 = 0").withColumn(
            "cls", F.when(F.col("particle_id") % 4 == 0, "stripe").otherwise(F.col("cls")))

    @cached_property
    def blanks(self) -> DataFrame:
        return self.images.where("image_id % 7 = 0").select("image_id")

    @cached_property
    def overrides(self) -> DataFrame:
        return self._sql(OVERRIDES_SQL, particles=self.mapped)

    @cached_property
    def scale_raw(self) -> DataFrame:
        return self._sql(SCALE_RAW_SQL, supplier=self.table("supplier"))

    @cached_property
    def curve_points(self) -> DataFrame:
        """Points of one run lie together. A file of customers is small and each becomes seven points, so they are dealt out
        first: otherwise the few tasks that read the file hold the points of all."""
        return self._sql(CURVE_SQL, customer=spread(self.table("customer").select("c_custkey"), "c_custkey", each=7))


# --- the same tables as common table expressions for the checking engine ------
_SOLID = f"(facet_frac >= 5e-1 and diam_nm >= 2e2 and classifiable)"
_ELIGIBLE = ("(edge_cut <= 11e-1 and solidity >= 7e-1 and "
             "case when major_px<>0 then minor_px/major_px else 0e0 end >= 3e-1)")
_BEST = ("case when p0>=p1 and p0>=p2 and p0>=p3 then 'janus' when p1>=p2 and p1>=p3 then 'stripe' "
         "when p2>=p3 then 'lamellar' else 'composite' end")
NAMED = (f"case when p0 is null then '' when diam_nm >= 350e0 then {_BEST} "
         "when p1 >= 8e-1 and p1 >= p0 then 'stripe' when p0 >= 55e-2 and diam_nm >= 3e2 then 'janus' else '' end")
MEASURED = ("(not excluded and edge_cut <= 85e-2 and case when major_px<>0 then minor_px/major_px else 0e0 end >= "
            "case when edge_cut>0 then 45e-2 else 3e-1 end and "
            "case when major_px*minor_px>0 then diam_px*diam_px/(major_px*minor_px) else 1e0 end >= 92e-2 and solidity >= 9e-1)")

ORACLE_CTES = f"""with images as ({IMAGES_SQL}),
raw_particles as ({RAW_PARTICLES_SQL}),
particles as (select {PARTICLE_COLUMNS_SQL} from raw_particles r join images i on r.image_id=i.image_id),
counted as (select *, w0/(w0+w1+w2+w3) as p0, w1/(w0+w1+w2+w3) as p1, w2/(w0+w1+w2+w3) as p2, w3/(w0+w1+w2+w3) as p3,
  case when upper(detector)='CBS' then true when upper(detector) in ('ETD','SE','SE2','TLD','INLENS') then false
       else structure >= 45e-2 end as classifiable
 from particles where diam_px >= 4e0 and (nm_per_px<=0 or diam_nm > 15e0)),
gate1 as (select *, {_SOLID} as solid0, ({_SOLID} and w0 is not null and {_ELIGIBLE}) as judged, {NAMED} as named0 from counted),
gate2 as (select *, case when judged and not (named0='janus' and facet_frac < 55e-2) then named0 else '' end as named from gate1),
gate3 as (select *, (judged and named<>'' and bright < -30e0) as excluded,
  case when judged and named<>'' and bright < -30e0 then '' else named end as pattern,
  case when judged and named<>'' and bright < -30e0 then false when judged and named='' then facet_frac >= 9e-1 else solid0 end as is_solid
 from gate2),
decided as (select *, {MEASURED} as measured from gate3),
scaled as (select * from decided where nm_per_px > 0),
selections as ({SELECTIONS_SQL}),
selected as (select s.*, selection_id from scaled s join selections t on s.image_id=t.image_id),
truth_labels as (select l.*, cls.set_name from ({LABEL_ROWS_SQL}) l join ({LABEL_SETS_SQL}) cls on l.image_id=cls.image_id),
saved as (select image_id, label_id as particle_id, class as cls from truth_labels where set_name='train'),
clicks as (select image_id, particle_id, case when particle_id%4=0 then 'stripe' else cls end as cls from saved where particle_id%2=0),
blanks as (select image_id from images where image_id%7=0),
overrides as ({OVERRIDES_SQL}),
scale_readings_raw as ({SCALE_RAW_SQL}),
curve_points as ({CURVE_SQL})
"""
