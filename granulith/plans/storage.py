"""Source, sink and streaming queries: written to the shared folder and read back."""

from pyspark.sql import functions as F

from granulith import schema
from granulith.functions import gates
from granulith.operators import labels as L
from granulith.plans.filing import LIB_SQL, shelf
from granulith.plans.registry import query
from granulith.plans.scales import RAW, readings
from granulith.plans.statistics import _M, IMAGE_SUMS, rounded
from granulith.session import scratch_path
from granulith.sources import image_files, label_files, library_files, scale_cache, session_tables
from granulith.streaming import ingest

KEY = ["image_id", "particle_id"]


@query("a01_load_session", """select image_id, particle_id, is_solid, pattern, measured, unclassified, case when image_id%4=0 then 0e0 else round(perim_px,6) end as perim_px
 from (select *, false as unclassified from decided) where image_id%10<>0""")
def _(w):
    """A store that grew over three versions, with one from a later program; photos without an image row are left out."""
    path = scratch_path(w.spark, "session")
    i = F.col("image_id")
    # older stores hold rows below the present floor in pixels
    loose = w.particles.where("nm_per_px <= 0 or diam_nm > 15").withColumn("classifiable", gates.classifiable())
    every = gates.reclassify(loose).select(*[c for c in w.decided.columns if c in schema.PARTICLES.replace(",", "").split()])
    session_tables.save_particles(every.where(i % 4 == 0).drop("perim_px", "unclassified", "user_solid", "user_measurable"), path, 1)
    session_tables.save_particles(every.where(i % 4 == 1), path, 2)
    session_tables.save_particles(w.decided.where(i % 4 > 1), path)
    session_tables.save_particles(w.decided.where(i % 5 == 0).withColumn("pattern", F.lit("later")), path, 9)
    stored = session_tables.load_particles(w.spark, path, w.images.where("image_id % 10 <> 0"))
    return stored.select(*KEY, "is_solid", "pattern", gates.measurable().alias("measured"), "unclassified", F.round("perim_px", 6).alias("perim_px"))


@query("a02_image_files", LIB_SQL + "select distinct path, strlen(path) as size from (select path from lib where image_id%4<>0 union all select replace(path,'.jpeg','.TIFF') from lib where image_id%4=0)")
def _(w):
    """Files of the library, photos and others, written under a folder and found again by its scan."""
    lib, root = shelf(w), scratch_path(w.spark, "photos")
    named = lambda ext: F.regexp_replace("path", r"\.jpeg$", ext).alias("path")
    files = (lib.where("image_id % 4 <> 0").select("path").unionAll(lib.where("image_id % 4 = 0").select(named(".TIFF")))
             .unionAll(lib.select(named(".labels.json"))).distinct())
    image_files.place(files, root)
    found = image_files.inventory(w.spark, root)
    plain = F.regexp_replace(F.lit(root), "^file:/+", "/")
    return found.select(F.substring("path", F.length(plain) + 1, F.length("path")).alias("path"), "size")


def written_labels(w):
    """Label documents of all photos; every 13th id is unreadable."""
    rows = w.labels.where("set_name = 'train'").select(
        F.col("image_id").cast("string").alias("stem"), F.lit("CBS").alias("detector"), F.lit(8.0).alias("nm_per_px"),
        F.to_timestamp(F.lit("2026-01-02 03:04:00")).alias("confirmed"),
        F.when(F.col("label_id") % 13 == 0, F.concat(F.lit("x"), F.col("label_id").cast("string")))
         .otherwise(F.col("label_id").cast("string")).alias("label_id"),
        "class", F.when(F.col("label_id") % 7 != 0, F.col("cx")).alias("cx"), "cy", "diam_nm")
    path = scratch_path(w.spark, "labels")
    label_files.label_documents(rows).write.json(path)
    return path


@query("a03_read_labels", """select cast(image_id as varchar) as stem, label_id, class, case when label_id%7<>0 then cx end as cx, cy, make_timestamp(2026,1,2,3,4,0e0) as confirmed
 from truth_labels where set_name='train' and label_id%13<>0""")
def _(w):
    return label_files.read_labels(w.spark, written_labels(w), multi_line=False).select(
        "stem", "label_id", "class", "cx", "cy", "confirmed")


@query("a03b_read_golden", """select cast(image_id as varchar) as stem, label_id, class from truth_labels where set_name='train' and label_id%13<>0 and label_id%7<>0""")
def _(w):
    return label_files.read_golden(w.spark, written_labels(w), multi_line=False).select("stem", "label_id", "class")


@query("a04_scale_cache", RAW + """select image_id, round(nm_per_px,6) as nm_per_px, source, "check" from rx where image_id%3<>0""")
def _(w):
    path = scratch_path(w.spark, "scales")
    r = readings(w)
    scale_cache.write_scales(r.where("image_id % 3 <> 0"), path + "/now")
    scale_cache.write_scales(r.where("image_id % 3 = 0"), path + "/old", version=0)
    return rounded(scale_cache.read_scales(w.spark, path + "/*").select("image_id", "nm_per_px", "source", "check"))


@query("a06_particle_csv", "select image_id, count(*) as n, cast(cast(sum(diam_nm) as float) as double) as sum_nm, count(case when pattern<>'' then 1 end) as n_pattern from decided group by image_id")
def _(w):
    path = scratch_path(w.spark, "csv")
    session_tables.export_csv(w.decided, path)
    back = w.spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("image_id").cast("long").alias("image_id")).agg(
        F.count("*").alias("n"), F.sum(F.col("diam_nm").cast("double")).cast("float").cast("double").alias("sum_nm"),
        F.count_if(F.coalesce("pattern", F.lit("")) != "").alias("n_pattern"))


@query("a08_library_tree", LIB_SQL + """select path, name, trail[1] as sample, trail[2] as folder, case when image_id%4=0 then 9 else 2 end as depth,
 case when image_id%4=0 then 'in [7] "x"' else trail[2] end as deepest from lib""")
def _(w):
    """Photos two and nine folders deep, written as documents and read back."""
    path = scratch_path(w.spark, "library")
    deep = F.concat("trail", F.array(*[F.lit(f'in [{i}] "x"') for i in range(1, 8)]))
    lib = shelf(w).withColumn("trail", F.when(F.col("image_id") % 4 == 0, deep).otherwise(F.col("trail")))
    library_files.library_documents(lib).write.text(path)
    return library_files.read_library(w.spark, path).select(
        "path", "name", F.get("trail", 0).alias("sample"), F.get("trail", 1).alias("folder"),
        F.size("trail").alias("depth"), F.try_element_at("trail", F.lit(-1)).alias("deepest"))


@query("a08b_count_images", LIB_SQL + "select trail[1] as folder, count(*) as n_images from lib group by trail[1]")
def _(w):
    return library_files.count_images(shelf(w))


@query("a09_guarded_overwrite", """select version, state, count(*) as n_rows from overrides cross join
 (values (10,'in force',10), (4,'snapshot',100), (6,'snapshot',40), (7,'snapshot',30), (8,'snapshot',20), (9,'snapshot',15)) v(version, state, part)
 where particle_id%100 < part group by version, state""")
def _(w):
    """Ten saves that grow and shrink, then an empty one: what is in force, and the snapshots that are kept."""
    root = scratch_path(w.spark, "store")
    for part in (11, 50, 100, 100, 50, 40, 30, 20, 15, 10):
        session_tables.guarded_save(w.overrides.where(f"particle_id % 100 < {part}"), root)
    session_tables.guarded_save(w.overrides.limit(0), root)
    return session_tables.stored_versions(w.spark, root)


@query("a10_save_confirmed", """select image_id, count(*) as n, count(case when class='exclude' then 1 end) as n_excluded from truth_labels where set_name='train'
 and image_id not in (select image_id from truth_labels where set_name='golden') and (image_id%5<>0 or label_id%2=0) group by image_id""")
def _(w):
    """Save all photos, then re-confirm a part of them with fewer labels."""
    path = scratch_path(w.spark, "confirmed")
    rows = w.labels.where("set_name = 'train'").withColumn("stem", F.concat(F.lit("p"), F.col("image_id").cast("string")))
    gold = w.labels.where("set_name = 'golden'")
    label_files.save_confirmed(rows, gold, path)
    label_files.save_confirmed(rows.where("image_id % 5 = 0 and label_id % 2 = 0"), gold, path)
    return label_files.read_confirmed(w.spark, path).groupBy("image_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("class") == "exclude").alias("n_excluded"))


@query("j01_incremental_ingest", ", ov as (select image_id, count(*) as n_overrides from overrides where image_id%4<>0 group by image_id), st as ("
       + IMAGE_SUMS.format(key="image_id", m=_M, src="decided", more="") + """)
 select st.*, case when image_id%4=0 then 1 else 0 end as delivery, count_total as n_stored, coalesce(n_overrides, 0) as n_overrides
 from st left join ov using (image_id)""")
def _(w):
    """Two streams over an inbox: the whole table first, then corrections, then a part of the photos again, cut differently.

    The statistics are what the second stream wrote, after a restart from its checkpoint.
    """
    from granulith.fixtures import Workbench
    inbox, table, totals, edits, marks, more_marks = (scratch_path(w.spark, n) for n in ("inbox", "ingested", "totals", "edits", "marks", "marks"))
    source = w.table("lineitem")

    def prepare(batch):
        bench = Workbench(batch.sparkSession, w.sf_dir)
        bench.carried = ("delivery",)
        bench.table = lambda name, own=bench.table: batch if name == "lineitem" else own(name)
        return ingest.decide(bench.particles)

    for number, delivery in enumerate((source, source.where("l_suppkey % 4 = 0").repartition(3, "l_orderkey"))):
        delivery.write.parquet(f"{inbox}/delivery={number}")
        if number:
            ingest.save_overrides(w.overrides, table, edits)
        # a delivery of several files comes in several batches
        ingest.start(w.spark, source.schema, inbox, table, marks, prepare, files_per_batch=2).awaitTermination()
        ingest.run_stats(w.spark, source.schema, inbox, totals, more_marks, prepare, files_per_batch=2).awaitTermination()
    stored = ingest.latest(w.spark, table).groupBy("image_id").agg(F.count("*").alias("n_stored"))
    left = ingest.current_overrides(w.spark, table, edits).groupBy("image_id").agg(F.count("*").alias("n_overrides"))
    out = ingest.stats_now(w.spark, totals).join(stored, "image_id", "left").join(left, "image_id", "left")
    return rounded(out.withColumn("n_overrides", F.coalesce("n_overrides", F.lit(0))), single=["mean_nm"])
