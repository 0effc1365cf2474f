"""The corpus queries: thin bindings of the operators to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import chat, compression_classifier, context_mixing, decontamination, html_extraction, merkle, mixing, quality_rules, secrets, simhash, url_filter, vector_codes, vector_links
from quantloom.llm.common import table


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation null, if any, is one conversation; a tree key stands for it, as joins drop nulls."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)
    named = rows.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = chat.digests(chat.format_trees(chat.as_chain(named), best=1))
    return out.withColumn("conv_id", F.when(F.col("conv_id") != "", F.col("conv_id")).cast("long"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.text_scores(table(spark, sf_dir, "documents"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


QUERIES = {
    "op1_compression_classifier": op1_compression_classifier,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_url_filters": op3_url_filters,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_secret_scans": op7_secret_scans,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_code_compression": op11_vector_code_compression,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def codes_sql(rounds: int = 4) -> str:
    """Integer codebooks round by round: every part against every entry, then the means rounded down."""
    nearest = "select rid, part, label, v, min(d) as d, arg_min(entry, (d, entry)) as entry from (select p.rid, p.part, p.label, p.v, c.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) as d from p join c{k} c using (part)) x group by rid, part, label, v"
    step = """, a{k} as materialized ({nearest}),
     m{k} as (select part, entry, list(cast(floor(s / n) as bigint) order by i) as v from (select part, entry, i, sum(v[i])::double as s, count(*) as n from (select part, entry, v, unnest(range(1, len(v) + 1)) as i from a{k}) y group by part, entry, i) z group by part, entry),
     c{next} as materialized (select c.part, c.entry, coalesce(m.v, c.v) as v from c{k} c left join m{k} m using (part, entry))"""
    sql = """with k as (select row_number() over (order by vec_id) as rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
       where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     p as materialized (select rid, vec_id, label, part, v[1 + part * (len(v) // 4) : (part + 1) * (len(v) // 4)] as v from k, range(4) t(part)),
     c0 as materialized (select part, rid - 1 as entry, v from p where rid <= 256)"""
    for k in range(rounds):
        sql += step.format(k=k, next=k + 1, nearest=nearest.format(k=k))
    return sql + f""", e as (select rid, label, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from ({nearest.format(k=rounds)}) q group by rid, label)
select k.vec_id, e.code, e.error, cast(sum(e.error) over (partition by e.label) as bigint) as label_error,
       sha256((select string_agg(array_to_string(v, ','), ',' order by part, entry) from c{rounds})) as codebooks_sha256 from e join k using (rid)"""


ORACLES: dict[str, str] = {
    "op2_chat_formatting": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e as (select *, regexp_extract_all(role || chr(1) || text, '<\||</?s>|\[/?INST\]|<</?SYS>>') as marks,
                  length(role || text) - length(replace(role || text, '\', '')) as slashes from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls last, role, text)) as loss_sha256,
       cast(sum(length(role) + length(text) + len(marks) + slashes + 24) as bigint) as formatted_chars
from e group by conv_id
""",
    "op3_url_filters": r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
     r(ruled, site, prefix) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
     f as (select *, (select arg_max(struct_pack(rule := site || prefix, ruled := ruled), length(site || prefix)) from r
                      where (host = site or ends_with(host, '.' || site)) and starts_with(path, prefix)) as fit from p),
     v as (select page_id, host, path, fit.rule as rule, fit.ruled as ruled from f),
     l as (select host from v where host <> '' group by host having sum(case ruled when 'block' then 1 when 'allow' then -1 else 0 end) > 0)
select page_id, host, path, rule, coalesce(ruled, case when host in (select host from l) then 'block' else 'allow' end) as verdict from v
""",
    "op6_benchmark_decontamination": r"""
with d as (select doc_id, row_number() over () as rid,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
     b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
     i as (select item_id, ws, least(10, len(ws)) as t from b where len(ws) > 0),
     iw as (select distinct item_id, t, array_to_string(ws[s:s + t - 1], ' ') as win from (select item_id, ws, t, unnest(generate_series(1, len(ws) - t + 1)) as s from i)),
     dw as (select rid, t, s, array_to_string(ws[s:s + t - 1], ' ') as win
            from (select rid, ws, t, unnest(generate_series(1, len(ws) - t + 1)) as s from d cross join (select distinct t from i) where len(ws) >= t)),
     m as (select rid, item_id, s, dw.t from dw join iw on dw.win = iw.win and dw.t = iw.t),
     h as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(s, s + t - 1)) as p from m) group by rid),
     n as (select rid, count(*) as n_items, sha256(string_agg(name, ',' order by name)) as items_sha256 from (select distinct rid, cast(item_id as varchar) as name from m) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from d left join h using (rid) left join n using (rid)
""",
    "op11_vector_code_compression": codes_sql(),
    "op12_embedding_near_dedup": """
with recursive v as (select row_number() over () as rid, vec_id, case when embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0 then label end as label, cast(embedding as double[]) as x from embeddings),
     l as materialized (select a.rid, b.rid as other, b.vec_id as id from v a join v b on a.label = b.label and a.rid <> b.rid and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
     r as (select rid, rid as node, vec_id as id from v union select r.rid, l.other, l.id from r join l on l.rid = r.node),
     n as (select rid, count(*) as n from l group by rid), c as (select rid, min(id) as component_id from r group by rid)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id is not distinct from component_id as kept from v left join n using (rid) join c using (rid)
""",
    "op13_merkle_manifest": r"""
with recursive bits as (select i, list_reduce(list_prepend(cast(i as bigint), range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) t(i)),
     crcs as (select list(c order by i) as t from bits),
     d as (select row_number() over () as rid, *, doc_id is not null and n_chars is not null
             and xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 7 = 0 as touched
           from documents, crcs),
     h as (select *, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
             coalesce(strlen(text) || ':' || text, '-') as tail from d),
     f as (select rid, doc_id, lang, sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || tail) as leaf,
             case when touched then sha256(head || strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1) || tail) end as changed from h),
     r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from f),
     tree as (select 0 as level, lang, pos, leaf as hash, n from r
              union all select level + 1, lang, pos // 2, sha256(string_agg(hash, '' order by pos)), (n + 1) // 2 from tree where n > 1 group by level, lang, pos // 2, n),
     subs as (select lang, hash as subroot, row_number() over (order by lang nulls first) - 1 as lpos, count(*) over () as ln from tree where n = 1),
     top as (select 0 as level, lpos as pos, subroot as hash, ln as n from subs
             union all select level + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), (n + 1) // 2 from top where n > 1 group by level, pos // 2, n),
     walk as (select 0 as level, rid, lang, pos, n, '' as proof, coalesce(changed, leaf) as folded from r
              union all select w.level + 1, w.rid, w.lang, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(t.hash, ''),
                sha256(case when w.pos % 2 = 1 then t.hash || w.folded else w.folded || coalesce(t.hash, '') end)
              from walk w left join tree t on t.level = w.level and t.lang is not distinct from w.lang and t.pos = xor(w.pos, 1) where w.n > 1),
     climb as (select 0 as level, w.rid, s.subroot, s.lpos as pos, s.ln as n, w.proof, w.folded from walk w join subs s on s.lang is not distinct from w.lang where w.n = 1
               union all select c.level + 1, c.rid, c.subroot, c.pos // 2, (c.n + 1) // 2, c.proof || coalesce(t.hash, ''),
                 sha256(case when c.pos % 2 = 1 then t.hash || c.folded else c.folded || coalesce(t.hash, '') end)
               from climb c left join top t on t.level = c.level and t.pos = xor(c.pos, 1) where c.n > 1)
select f.doc_id, f.leaf, c.subroot, (select hash from top where n = 1) as root, sha256(c.proof) as proof_sha256, c.folded as folded_root,
       c.folded = (select hash from top where n = 1) as verified
from f join climb c on c.rid = f.rid and c.n = 1
""",
}
