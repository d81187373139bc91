"""The queries of the operators in llm, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, line_dedup, lm_bloom, mixing, mpeg_audio, near_dedup, oracles, pii, repetition, sharding, url_filter
from lexispark.llm.common import table

#: Public ranks of 50,256 tokens; a parameter of the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = sharding.even_tree(4, 2, 5)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


@query
def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


@query
def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), narrow=True)


ORACLE["op1_minhash_near_dedup"] = oracles.NEAR_DUPLICATES
ORACLE["op2_hash_tree_sharding"] = oracles.SHARDING
ORACLE["op4_repetition_rules"] = oracles.repetition()
ORACLE["op10_source_mix"] = oracles.MIX
ORACLE["op5_line_dedup"] = line_dedup.ORACLE


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no list of URLs, so those of every page whose id is divisible by 20 stand for one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where("page_id % 20 = 0").select(url_filter.canonical(F.col("url")).alias("url"))
    return url_filter.filter_urls(pages, listed)


@query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))

#: url_filter.RULES and canonical() over again.
ORACLE["op7_url_filter"] = r"""
with s as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '://[^?#]*\?([^#]*)', 1) as asked from s),
c as (select *, array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda q: q <> '' and not regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') as kept from p),
u as (select *, case when instr(url, '://') > 0 then regexp_replace(regexp_replace(regexp_replace(host, '^.*@|:(80|443)$', ''), '^.*@|:(80|443)$', ''), '^(www|m)\.', '')
      || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') || case when kept <> '' then '?' || kept else '' end else '' end as canon from c),
l as (select distinct canon from u where page_id % 20 = 0 and canon <> ''),
r as (select u.*, l.canon is not null as listed,
      case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
           when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
           when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
           when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from u left join l on u.canon = l.canon)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict, listed from r
"""


@query
def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.scores(table(spark, sf_dir, "documents"))


@query
def op6_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.digests(table(spark, sf_dir, "documents"))
