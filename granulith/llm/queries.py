"""Registered queries of this folder, and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, functions as F

from granulith.llm import (context_tree, hard_negatives, importance, line_chunks, packing, prefix_viterbi, recompression, rule_ledger,
                            run_index, superminhash, toxicity, warc, wu_manber)

QUERIES = {}
ORACLES = {}
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def register(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(oracle=rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {WORDS_SQL} as w from documents),
 win as (select r, i, list_slice(w, i, i + 4) as win from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
 twice as (select r, i from (select r, i, count(*) over (partition by r, win) as c from win) where c > 1),
 rep as (select r, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(0, 5)) as k) group by r),
 ln as (select r, line, count(*) as c from (select r, unnest(string_split(text, chr(10))) as line from d)
        where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line),
 lines as (select r, sum(c) as n_lines, sum(c - 1) as n_dup_lines from ln group by r),
 m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
   coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
   length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper
  from d left join rep using (r) left join lines using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines
  or 2 * word_chars < 5 * n_words or word_chars > 12 * n_words or 2 * n_upper > word_chars) as kept
from m""")
def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Rule ledger of every document, policy 1 as the base, policy 2 as the verdict."""
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~rule_ledger.passes(1)).alias("base_failed"), rule_ledger.passes(2).alias("kept"))


@register(oracle=r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
 pats as (select distinct item_id, len(list_slice(w, i, i + 9)) as m, list_slice(w, i, i + 9) as p
   from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
 pos as (select r, m, list_slice(w, i, i + m - 1) as p, i from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i
   from d, (select distinct m from pats) where len(w) >= m)),
 occ as (select pos.r, pos.i, pos.m, pats.item_id from pos join pats on pos.m = pats.m and pos.p = pats.p),
 hit as (select r, count(distinct i + k) as n_hit from (select r, i, unnest(range(0, m)) as k from (select distinct r, i, m from occ)) group by r),
 its as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
   from (select distinct r, item_id from occ) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (r) left join its using (r)""")
def op8_wu_manber(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = wu_manber.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@register()
def op9_prefix_viterbi(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text again."""
    return prefix_viterbi.encode(table(spark, sf_dir, "documents"), TOKENIZER, check=True)


LINE_CHUNKS_SQL = """
with ln as (select doc_id, i, line, ('0x' || left(md5(line), 8))::bigint as h from
   (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i
    from documents where text is not null)),
 ro as (select *, (h + 31 * lag(h, 1, 0) over w + 961 * lag(h, 2, 0) over w) % 4294967291 as r from ln
   window w as (partition by doc_id order by i)),
 en as (select *, i > 0 and r < lag(r) over w and r <= lead(r) over w as e from ro window w as (partition by doc_id order by i)),
 st as (select *, coalesce(sum((e)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as g from en),
 ct as (select *, (row_number() over (partition by doc_id, g order by i) - 1) // 8 as k from st),
 ch as (select doc_id, g, k, string_agg(line, chr(10) order by i) as chunk, count(*) as n from ct group by doc_id, g, k),
 nu as (select *, row_number() over (partition by doc_id order by g, k) - 1 as no from ch),
 mk as (select *, n > 1 and row_number() over (partition by chunk order by doc_id, no) > 1 as gone from nu)
"""


@register(oracle=LINE_CHUNKS_SQL + """
select d.doc_id, coalesce(sum(n), 0)::bigint as n_lines, count(no) as n_chunks, count(*) filter (gone) as n_removed_chunks,
 coalesce(sum(n) filter (gone), 0)::bigint as n_removed_lines,
 case when any_value(text) is not null then sha256(coalesce(string_agg(chunk, chr(10) order by no) filter (not gone), '')) end as kept_sha256
from documents d left join mk using (doc_id) group by d.doc_id""")
def op2_line_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand earlier, removed from every document."""
    out = line_chunks.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines",
                      F.sha2(F.col("text"), 256).alias("kept_sha256"))


@register()
def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by the model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register(oracle="""
with p as (select page_id, coalesce(html, '') as html from pages),
 g as (select html, max(page_id) as keeper from p group by html)
select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest,
 case when strlen(html) >= 1000 and page_id < keeper then 'revisit' else 'response' end as record_type,
 case when strlen(html) >= 1000 and page_id < keeper then keeper end as refers_to
from p join g using (html)""")
def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register(oracle=r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select distinct doc_id, list_slice(w, i, i + 4) as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i
   from w where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 e as (select a.doc_id as a, b.doc_id as b from (select a.doc_id, b.doc_id as other, count(*) as c from s a join s b using (s)
   where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id) p join n a on a.doc_id = p.doc_id join n b on b.doc_id = p.other
   where 100 * c >= 75 * (a.n + b.n - c)),
 r as (select doc_id, doc_id as c from n union select e.a, r.c from r join e on e.b = r.doc_id where r.c < e.a)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, w.doc_id) as component_id, coalesce(c, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join (select doc_id, min(c) as c from r group by doc_id) using (doc_id)""")
def op7_superminhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of every document."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


@register(oracle="""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
 part as (select doc_id, c, substr(x, 2000 * c + 1, 2198) as y from (select doc_id, x, unnest(range(0, (len(x) // 2 - 100) // 1000 + 1)) as c
   from d where len(x) >= 200)),
 w as (select doc_id, 1000 * c + j as i, md5(substr(y, 2 * j + 1, 200)) as h from (select *, unnest(range(0, len(y) // 2 - 99)) as j from part)),
 f as (select h, min(struct_pack(d := doc_id, i := i)) as first from w group by h having count(*) > 1),
 g as (select w.doc_id, w.i from w join f using (h) where w.doc_id > first.d or (w.doc_id = first.d and w.i > first.i)),
 r as (select doc_id, i, sum((n)::int) over (partition by doc_id order by i) as k from
   (select *, coalesce(i - lag(i) over (partition by doc_id order by i) > 100, true) as n from g)),
 s as (select doc_id, min(i) as s, max(i) + 100 as e from r group by doc_id, k),
 p as (select *, lag(e, 1, 0) over (partition by doc_id order by s) as b from s),
 k as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans, max(e) as e,
   string_agg(substr(x, 2 * b + 1, 2 * (s - b)), '' order by s) as kept from p join d using (doc_id) group by doc_id)
select doc_id, len(x) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
 sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(e, 0) + 1))) as kept_sha256 from d left join k using (doc_id)""")
def op5_run_index(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by 100-byte strings that start earlier."""
    return run_index.dedup(table(spark, sf_dir, "documents")).drop("kept")


@register(oracle=r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) as h
   from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
 f as (select h, min(doc_id) as first from s group by h having count(*) > 1),
 g as (select distinct doc_id, i + k as i from (select doc_id, i, unnest(range(0, 50)) as k from s join f using (h) where doc_id > first)),
 u as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
 m as (select u.doc_id, x, u.i, g.i is not null as gone from u left join g using (doc_id, i)),
 a as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(x, ' ' order by i) filter (not gone) as kept
   from m group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join a using (doc_id)""")
def op10_recompression(spark, sf_dir: str) -> DataFrame:
    """Words of every document covered by windows of 50 words of an earlier document."""
    return recompression.dedup(table(spark, sf_dir, "documents")).drop("kept")


@register()
def op1_context_tree(spark, sf_dir: str) -> DataFrame:
    """Base and context-tree scores of every document."""
    return context_tree.score(table(spark, sf_dir, "documents"))


@register(oracle=r"""
with recursive bits as (select i, i as c, 0 as k from range(256) t(i)
  union all select i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 from bits where k < 8),
 tab as (select list(c order by i) as t from bits where k = 8),
 d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
 df as (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
 bf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
 u as (select f, hex(encode(f)) as x from (select f from df union select f from bf)),
 k as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
   lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as bucket from u, tab),
 dk as (select r, bucket from df join k using (f)),
 s as (select bucket, count(*) as s from dk group by bucket),
 t as (select bucket, count(*) as t from bf join k using (f) group by bucket),
 n as (select (select count(*) from df) as ns, (select count(*) from bf) as nt),
 g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ns + 10000)::double / ((s + 1)::double * (nt + 10000)::double)))::bigint as gain
   from s left join t using (bucket), n),
 wt as (select r, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from dk join g using (bucket) group by r),
 sc as (select r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
   + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id::varchar), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
   from d left join wt using (r)),
 ok as (select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from sc where n_words >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= 25 * n // 100 then rank end as rank
from sc left join ok using (r)""")
def op13_importance(spark, sf_dir: str) -> DataFrame:
    """Draw of a quarter of the documents, towards the benchmark's word runs."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORD_TOKENIZER = "word_bpe_49k.json"


@register()
def op11_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows of four lengths."""
    import public_tokenizers
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


@register(oracle="""
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
   list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 a as (select vec_id as anchor_id, label as l, q as aq from r where vec_id % 100 = 0),
 s as (select anchor_id, vec_id, label = l as same, list_dot_product(aq, q)::bigint as score from a, r where anchor_id <> vec_id),
 pn as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from pn where place <= 5),
 n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
   row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10""")
def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector; every seventh label is off by one."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)
