"""File-name grouping, export names and library queries."""

from pyspark.sql import functions as F

from granulith.functions import naming as N, text
from granulith.operators import library, naming
from granulith.plans.decisions import NAMED_SQL, named_images
from granulith.plans.registry import query
from granulith.plans.statistics import _TITLE
from granulith.session import settle

# the compatible forms that occur in the names are spelt out here
_PLAIN = "replace(replace(translate({x}, 'ＡＢ１', 'AB1'), 'ﬁ', 'fi'), 'Ⅳ', 'IV')"
FOLD = ("trim(regexp_replace(regexp_replace(strip_accents(lower(replace(replace(replace(" + _PLAIN + ",'İ','i'),'I','i'),'ı','i'))), '[|_/\\\\\\-–—.,()\\[\\]*]+', ' ', 'g'), '\\s+', ' ', 'g'))")
_PRE = "'(?:^|[|/\\\\_])\\s*(\\p{L}{1,4})\\s*(?:[-–—]\\s*|\\s+)(\\d{1,3})(?:[^\\d]|$)'"
_LEAD = "'^\\s*(\\d{1,3})(?:[^\\d]|$)'"
_W = "regexp_matches(f, '(^|[^a-z0-9])({})([^a-z]|$)')"
_REG = " ".join(f"when {_W.format(k)} then '{N.REGION_WORDS[k]}'" for k in sorted(N.REGION_WORDS, key=len, reverse=True))
_PATS = "|".join(N.PATTERN_ALIASES)
FILED = NAMED_SQL + f""", p0 as (select image_id, variant, stem, lpad(cast(image_id as varchar),20,'0')||':'||cast(variant as varchar) as path, {FOLD.format(x='stem')} as f,
   nullif(regexp_extract(stem, {_PRE}, 1),'') as prefix,
   coalesce(nullif(regexp_extract(stem, {_PRE}, 2),''), nullif(regexp_extract(stem, {_LEAD}, 1),''),
    list_filter(list_transform(string_split_regex(stem,'[|/\\\\_]+'), lambda x: trim(x)), lambda x: regexp_full_match(x,'\\d{{1,3}}'))[1]) as n0,
   case when regexp_matches(stem, {_PRE}) then regexp_replace(stem, '(?:^|[|/\\\\_])\\s*(\\p{{L}}{{1,4}})\\s*(?:[-–—]\\s*|\\s+)(\\d{{1,3}})', ' ') else regexp_replace(stem, '^\\s*(\\d{{1,3}})', ' ') end as rest0 from (select image_id, variant, nfc_normalize(stem) as stem from named_images)),
 p1 as (select *, case when length(n0)<2 then lpad(n0,2,'0') else n0 end as num,
   trim(trim(regexp_replace(regexp_replace(regexp_replace(rest0,'[|/\\\\_]+',' ','g'),'[-–—]+',' ','g'),'\\s+',' ','g')), ' -–—.,*#~+') as rest1 from p0),
 p2 as (select *, trim(regexp_replace(regexp_replace(rest1, '(\\p{{L}})\\d{{1,3}}\\s*$', '\\1'), '(^|\\s)\\d{{1,3}}\\s*$', '')) as rest2,
   case {_REG} end as region, regexp_matches(f, '(^|[^a-z0-9])({_PATS})([^a-z]|$)') as pat from p1),
 p3 as (select image_id, variant, stem, path, prefix, num, (region is not null or pat) as known,
   case when region is not null then region when pat then 'Patterned' when regexp_matches(rest2,'[\\p{{L}}\\p{{N}}]') then rest2 end as name from p2),
 p4 as (select *, {FOLD.format(x='name')} as key from p3),
 codes as (select num, min_by(prefix, struct_pack(a := -n, p := p)) as code from (select num, prefix, count(*) as n, min(path) as p from p4 where num is not null and prefix is not null group by num, prefix) group by num),
 lone as (select case when count(distinct prefix)=1 then min(prefix) end as lone from p4 where num is not null),
 shr as (select num, key, count(*) as members from p4 where num is not null and key is not null group by num, key),
 spell as (select key, min_by(name, struct_pack(a := -n, p := p)) as spelling from (select key, name, count(*) as n, min(path) as p from p4 where num is not null and key is not null group by key, name) group by key),
 plan as (select p.image_id, p.variant, case when p.num is null then 'Unsorted' when coalesce(code,lone) is not null then concat(coalesce(code,lone),' - ',p.num) else p.num end as sample,
   case when p.num is not null and p.key is not null and (known or members>1) then spelling end as folder
  from p4 p left join codes c on c.num=p.num left join shr s on s.num=p.num and s.key=p.key left join spell sp on sp.key=p.key cross join lone)
"""


def photos(w):
    return named_images(w).withColumn("path", F.concat(
        F.lpad(F.col("image_id").cast("string"), 20, "0"), F.lit(":"), F.col("variant").cast("string")))


@query("i01_fold", NAMED_SQL + f"select image_id, variant, {FOLD.format(x='stem')} as folded from named_images")
def _(w):
    return named_images(w).select("image_id", "variant", N.fold(F.col("stem")).alias("folded"))


@query("i02_sample", FILED + "select image_id, variant, prefix, num from p3")
def _(w):
    return named_images(w).select("image_id", "variant", N.sample_prefix(F.col("stem")).alias("prefix"),
                                  N.sample_number(F.col("stem")).alias("num"))


@query("i03_known_words", FILED + "select image_id, variant, region, pat as has_pattern from p2")
def _(w):
    # folded once, not for each word that is looked for
    folded, f = settle(named_images(w), {"_folded": N.fold(F.col("stem"))}), F.col("_folded")
    return folded.select("image_id", "variant", N.region(f).alias("region"), N.has_pattern_word(f).alias("has_pattern"))


@query("i04_group", FILED + "select image_id, variant, name, key, known from p4")
def _(w):
    return naming.parsed(named_images(w)).select("image_id", "variant", "name", "key", "known")


@query("i05_plan", FILED + "select * from plan")
def _(w):
    return naming.plan(photos(w), "path").select("image_id", "variant", "sample", "folder")


@query("i06_outline", FILED + """select sample, folder, count(*) as n, cast(grouping(sample)*2+grouping(folder) as bigint) as level
 from (select sample, coalesce(folder,'') as folder from plan) group by rollup(sample, folder)""")
def _(w):
    return naming.outline(naming.plan(photos(w), "path"))


@query("i07_export_names", rf""", t as (select image_id, stem, {_TITLE} as title from (select image_id, replace(image,'.jpeg','') as stem from images)),
 b as (select image_id, trim(regexp_replace(concat(title,' line',case when regexp_extract(suffix,'(\d+)',1)<>'' then concat('.',regexp_extract(suffix,'(\d+)',1)) else '' end), '[\\/:*?"<>|]', '_', 'g')) as base
  from (select *, case when starts_with(stem,title) then substr(stem,length(title)+1) else stem end as suffix from t))
 select image_id, case when rn=1 then base else concat(base,' ',rn) end as export_name from (select *, row_number() over (partition by base order by image_id) as rn from b)""")
def _(w):
    stem = text.stem(F.col("image"))
    return naming.export_names(w.images.select("image_id", stem.alias("stem"), text.clean_title(stem).alias("title")), "line")


_KEYED = f"""list_aggregate(list_transform(regexp_extract_all(translate(stem,'１','1'),'(\\d+|\\D+)'), lambda x: case when regexp_full_match(x,'\\d+') then lpad(cast(length(regexp_replace(x,'^0+(\\d)','\\1')) as varchar),10,'0')||regexp_replace(x,'^0+(\\d)','\\1') else {FOLD.format(x='x')} end), 'string_agg', chr(1))"""


@query("g06_natural_key", NAMED_SQL + f"select image_id, variant, coalesce({_KEYED},'') as sort_key from named_images")
def _(w):
    return named_images(w).select("image_id", "variant", text.natural_key(F.col("stem")).alias("sort_key"))


# --- library -----------------------------------------------------------------------
LIB_SQL = """, lib as (select image_id, concat('/lab/', substr(image,1,7), '/', image) as path, image as name,
  [substr(image,1,7), case image_id%5 when 0 then 'Alt' when 1 then 'Üst' when 2 then 'Karışık' when 3 then 'Patterned' else 'x 5 cm' end] as trail from images)
"""


def shelf(w):
    folder = F.element_at(F.array(*[F.lit(x) for x in ("Alt", "Üst", "Karışık", "Patterned", "x 5 cm")]),
                          (F.col("image_id") % 5 + 1).cast("int"))
    sample = F.substring("image", 1, 7)
    return w.images.select("image_id", F.concat(F.lit("/lab/"), sample, F.lit("/"), F.col("image")).alias("path"),
                           F.col("image").alias("name"), F.array(sample, folder).alias("trail"))


# Renamed files: the same photo with a word put before its number.
_FILES = LIB_SQL + r""", files as (select path from lib where image_id%6<>0
  union all select regexp_replace(path, ' (\d+)\.jpeg$', ' b \1.jpeg') from lib where image_id%6=0 and image_id%12<>6
  union all select regexp_replace(path, ' (\d+)\.jpeg$', ' c \1.jpeg') from lib where image_id%24=0),
 lost as (select distinct path from lib where image_id%6=0 except select path from lib where image_id%6<>0), kept as (select path from lib where image_id%6<>0),
 sp as (select path, regexp_extract(path,'^(.*)/[^/]*$',1) as d, regexp_replace(regexp_replace(path,'^.*/',''),'\.[^.]*$','') as st, regexp_extract(path,'(\d+)\.jpeg$',1) as num from
   (select distinct path from files where path not in (select path from kept))),
 ls as (select path, regexp_extract(path,'^(.*)/[^/]*$',1) as d, regexp_replace(regexp_replace(path,'^.*/',''),'\.[^.]*$','') as st, regexp_extract(path,'(\d+)\.jpeg$',1) as num from lost),
 lcp as (select ls.path as old_path, sp.path as new_path, (select max(i) from range(0,80) r(i) where i<=least(length(ls.st),length(sp.st)) and substr(ls.st,1,i)=substr(sp.st,1,i)) as n
   from ls join sp on ls.d=sp.d and ls.num=sp.num),
 healed as (select old_path, min(new_path) as new_path from (select *, max(n) over (partition by old_path) as best from lcp) where n=best and n>3 group by old_path having count(*)=1)
"""


def disk(w):
    lib = shelf(w)
    renamed = lambda word: F.regexp_replace("path", r" (\d+)\.jpeg$", f" {word} $1.jpeg").alias("path")
    i = F.col("image_id")
    kept = lib.where(i % 6 != 0).select("path")
    present = (kept.unionAll(lib.where((i % 6 == 0) & (i % 12 != 6)).select(renamed("b")))
               .unionAll(lib.where(i % 24 == 0).select(renamed("c")))).distinct()
    missing = lib.where(i % 6 == 0).select("path").distinct().join(kept, "path", "left_anti")
    return missing, present, kept


@query("d12_find_renamed", _FILES + "select * from healed")
def _(w):
    return library.find_renamed(*disk(w))


@query("d13_apply_renames", _FILES + """, store as (select l.path, count(*) as n from particles p join (select image_id, path from lib) l on p.image_id=l.image_id group by l.path)
 select path, cast(sum(n) as bigint) as n from (select coalesce(h.new_path, s.path) as path, n from store s left join healed h on h.old_path=s.path) where path in (select path from files) group by path""")
def _(w):
    missing, present, kept = disk(w)
    renames = library.find_renamed(missing, present, kept)
    per_image = w.particles.groupBy("image_id").agg(F.count("*").alias("n"))
    store = shelf(w).join(per_image, "image_id").groupBy("path").agg(F.sum("n").alias("n"))
    return library.apply_renames(store, renames, present).groupBy("path").agg(F.sum("n").alias("n"))


@query("d14_import_new", _FILES + "select distinct path from files where path not in (select path from lib)")
def _(w):
    _, present, _ = disk(w)
    return library.import_new(shelf(w), present.unionAll(present))


@query("d17_folder_photos", LIB_SQL + "select distinct path from lib where trail[1]='UÖ - 05'")
def _(w):
    return library.under_folder(shelf(w), ["UÖ - 05"]).select("path")


@query("d18_search", LIB_SQL + "select image_id, path from lib where trail[2]='Karışık' and contains(trail[1], 'UÖ')")
def _(w):
    return library.search(shelf(w), "  KARISIK  uö").select("image_id", "path")


@query("d20_remove", LIB_SQL + "select path from lib where image_id%8<>0 and not (trail[1]='UÖ - 05' and trail[2]='Alt') and path not in (select path from lib where image_id%8=0)")
def _(w):
    lib = shelf(w)
    return library.remove(lib, lib.where("image_id % 8 = 0"), ["UÖ - 05", "Alt"]).select("path")
