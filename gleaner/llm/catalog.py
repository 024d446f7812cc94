"""The registered queries of the subpackage and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm import (
    alignment, archives, decontaminate, exact_dedup, extraction, language, mixing, periodic, quality, simhash, tokens, toxicity, url_rules,
)
from gleaner.llm.common import held_out, table
from gleaner.session import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = extraction.main_text(pages, extraction.train(pages))
    return found.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op3_token_counts(spark, sf_dir):
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op4_source_mix(spark, sf_dir):
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


@query
def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


@query
def op6_archives(spark, sf_dir):
    back = archives.archive(table(spark, sf_dir, "pages"), work_path(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_decontaminate(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit()
    return found.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE["op7_decontaminate"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw))),
h as (select doc_id, i, n, item_id from dw join bw using (n, g)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
t as (
  select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s
  from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""


@query
def op8_exact_dedup(spark, sf_dir):
    found = exact_dedup.refine(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op8_exact_dedup"] = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id)
"""

@query
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    rejected = (F.col("score") >= toxicity.REJECT).cast("int")
    return found.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "score", rejected.alias("predicted"))


#: The host rules of the contract.
HOST_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
#: Patterns for URLs that no host rule fits.
PATTERNS = [
    ("block", "||spam-farm.*^"), ("block", "||cheap-pills.*^"), ("block", "||casino.*^"), ("block", "||adserver.*^"),
    ("block", "^wp-admin^"), ("block", "^cgi-bin^"), ("block", "^checkout^"), ("block", "^login^"),
    ("block", "^search^results^"), ("block", "^tag^*^page^"), ("allow", "^docs^login^"),
]


@query
def op9_url_filter(spark, sf_dir):
    rules = [url_rules.host_rule(*r) for r in HOST_RULES] + [url_rules.pattern_rule(*p) for p in PATTERNS]
    judged = url_rules.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


ORACLE["op9_url_filter"] = r"""
with s as (
  select page_id, url, instr(coalesce(url, ''), '://') as p0,
         case when p0 > 0 then substr(url, p0 + 3) else '' end as rest from pages),
u as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s),
r(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
m as (
  select page_id, host, path, '//' || host || path as a from u)
select page_id, host, path, rule, coalesce(f.verdict, case
  when regexp_matches(a, '[^0-9A-Za-z_.%-]docs[^0-9A-Za-z_.%-]login([^0-9A-Za-z_.%-]|$)') then 'allow'
  when regexp_matches(a, '^//([^/]*[.])?(spam-farm|cheap-pills|casino|adserver)[.].*([^0-9A-Za-z_.%-]|$)')
    or regexp_matches(a, '[^0-9A-Za-z_.%-](wp-admin|cgi-bin|checkout|login)([^0-9A-Za-z_.%-]|$)')
    or regexp_matches(a, '[^0-9A-Za-z_.%-]search[^0-9A-Za-z_.%-]results([^0-9A-Za-z_.%-]|$)')
    or regexp_matches(a, '[^0-9A-Za-z_.%-]tag[^0-9A-Za-z_.%-].*[^0-9A-Za-z_.%-]page([^0-9A-Za-z_.%-]|$)') then 'block'
  else 'allow' end) as verdict
from m left join f using (page_id)
"""


@query
def op11_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.coalesce(fifth != 0, F.lit(False)))
    found = quality.score(docs, model).select("doc.doc_id", "score")
    accepted = (F.col("score") >= quality.ACCEPT).cast("int")
    return found.select("doc_id", F.coalesce(fifth == 0, F.lit(False)).alias("held_out"), "score", accepted.alias("predicted"))


@query
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.when(hashed % 10 == 0, periodic.folded(F.col("text"), F.floor(hashed / 10))).otherwise(F.col("text"))
    found = periodic.periodic_runs(docs.select("doc_id", text.alias("text")))
    best = F.col("strongest")
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_token_alignment(spark, sf_dir):
    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = alignment.align(table(spark, sf_dir, "documents"), *files)
    return found.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
