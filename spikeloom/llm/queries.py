"""The registered query of each text operator, over its whole table, and DuckDB twins where SQL can say it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, license_scan, packing, quality, simhash, token_count, token_store, url_filter, warc
from .common import fresh_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    vocab = token_count.Vocabulary.from_sentencepiece(model or tokenizer_path("piece_bpe_32k.model"))
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocab)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op3_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = fresh_path(spark, "store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer or tokenizer_path("byte_bpe_50k.json"), "byte", end_id=0, width=2)
    return token_store.read_store(spark, path, width=2).withColumnRenamed("id", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base, met = F.col("base_places.label"), F.col("blocks.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.word").alias("first_word"), F.array_max("base_places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, met)).alias("labels"),
        F.greatest(F.when(F.size("base_places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = warc.write_archives(warc.plan(pages))
    kind = dict(pages.dtypes)["page_id"]
    return warc.read_records(files).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    placed, _ = packing.pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("word_bpe_49k.json"), "word", end_id=1)
    return placed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_token_store, op4_license_scan, op5_warc, op6_packing, op7_url_filter, op8_fingerprint, op9_simhash, op10_quality)}

_LOWER = partial("translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format)
_WORDS = "regexp_extract_all(" + _LOWER("coalesce({0}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op2_sql() -> str:
    return f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents),
i as (select item_id, {_WORDS.format('text')} as w from benchmark where item_id is not null),
iw as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as k
       from i, unnest(range(1, len(w) - least(len(w), 13) + 2)) as t(p) where len(w) > 0),
dw as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as k
       from d, (select distinct n from iw) s, unnest(range(1, len(w) - n + 2)) as t(p) where len(w) >= n),
hits as (select dw.doc_id, dw.p, dw.n, iw.item_id from dw join iw on dw.k = iw.k and dw.n = iw.n),
hw as (select doc_id, count(distinct q) as n_hit from (select distinct doc_id, p, n from hits), unnest(range(p, p + n)) as t(q) group by doc_id),
hi as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)"""


def _op4_sql() -> str:
    quoted = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
    phrases = quoted([(p, label, len(p.split())) for p, label in license_scan.PHRASES])
    words = quoted([(k, label, w, len(set(t.split()))) for k, (t, label) in enumerate(license_scan.TEMPLATES) for w in sorted(set(t.split()))])
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS.format('text')} as w from documents),
p(phrase, label, n) as (values {phrases}),
b as (select doc_id, pos - 1 as word, label from d, p, unnest(range(1, len(w) - n + 2)) as t(pos) where len(w) >= n and array_to_string(w[pos:pos + n - 1], ' ') = phrase),
t(template, label, word, size) as (values {words}),
l as (select doc_id, line, {_WORDS.format('line')} as w from d, unnest(string_split(text, chr(10))) as u(line)),
lw as (select distinct doc_id, line, word from l, unnest(w) as u(word)),
m as (select doc_id, label, cast(count(*) as double) / max(size) as share from lw join t using (word) group by doc_id, line, template, label
      having count(*) >= ceil({license_scan.THRESHOLD} * max(size) - 1e-9)),
bs as (select doc_id, count(*) as n, min(word) as lo, max(word) as hi, string_agg(distinct label, ',' order by label) as labels from b group by doc_id),
ls as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from b union all select doc_id, label from m) group by doc_id),
ms as (select doc_id, max(share) as share from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, cast(lo as bigint) as first_word, cast(hi as bigint) as last_word,
       coalesce(bs.labels, '') as base_labels, coalesce(ls.labels, '') as labels, greatest(case when n > 0 then 1.0e0 else 0.0e0 end, coalesce(share, 0.0e0)) as score
from d left join bs using (doc_id) left join ls using (doc_id) left join ms using (doc_id)"""


_OP5_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as best from p group by h)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((cast('0x' || substr(p.h, cast(5 * (i // 4) + 1 as bigint), 5) as bigint)) >> (15 - 5 * (i % 4))) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to
from p join g using (h)"""


def _op7_sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.RULES)
    return rf"""
with r(action, h, p) as (values {rules}),
u as (select page_id, row_number() over () as row, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, row, {_LOWER("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select row, h || p as rule, action, row_number() over (partition by row order by length(h) + length(p) desc, length(h) desc, action) as k
      from s, r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from s left join f on s.row = f.row and f.k = 1"""


ORACLE = {"op2_decontamination": _op2_sql(), "op4_license_scan": _op4_sql(), "op5_warc": _OP5_SQL, "op7_url_filter": _op7_sql()}
