"""Registered queries: every corpus operator over its whole table, with the digest columns asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adlumen.llm import decontaminate, fim, licenses, lines, mixing, negatives, quality, secrets, simhash, suffixes, tokens, toxicity, warc
from adlumen.llm.common import benchmark, documents, ready
from adlumen.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(documents(spark, folder)).withColumn(
        "removed_lines", F.array_join(F.transform("removed_lines", lambda n: n.cast("string")), ","))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, folder), benchmark(spark, folder))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents(spark, folder)).select(
        "doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "source", F.round("position", 2).alias("position"))


def op4_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{folder}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "captured")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, folder)).drop("kept")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(documents(spark, folder), licenses.known_digests(spark))


def _joined(findings: Column) -> Column:
    spans = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return F.array_join(spans, ",")


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.findings(documents(spark, folder), f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}")
    base = [rule.kind for rule in secrets.BASE_RULES]
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(of(*base)).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


def op9_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.scored(docs, toxicity.learned(docs, labels)).drop("evidence")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return fim.restored(fim.transformed(documents(spark, folder))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES: list[Query] = [
    op1_line_dedup, op2_benchmark_decontamination, op3_source_mixing, op4_warc_index, op5_token_counts, op6_suffix_dedup,
    op7_license_scan, op8_secret_scan, op9_simhash_dedup, op10_quality_rules, op11_toxicity,
    op12_fill_in_middle, op13_hard_negatives,
]


def registered() -> dict[str, Query]:
    def bound(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ready(spark)
            return query(spark, folder)

        return run

    return {query.__name__: bound(query) for query in QUERIES}


# --- DuckDB counterparts ------------------------------------------------------------------------

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

LINES_SQL = f"""
with raw as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no
  from documents where text is not null),
occ as (
  select doc_id, no, w, array_to_string(w, ' ') as key
  from (select doc_id, no, regexp_extract_all({_LOWER.format('line')}, {_WORD}) as w from raw) where len(w) > 0),
firsts as (
  select key, any_value(w) as w, row_number() over (order by min_place) as f, min_place
  from (select key, any_value(w) as w, min(doc_id * 10000000 + no) as min_place from occ group by key) group by key, min_place),
variants as (
  select key, f, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') as v
  from (select key, f, w, unnest(range(1, len(w) + 1)) as i from firsts where len(w) >= 8)),
same as (
  select a.key from variants a join (select v, i, min(f) as best from variants group by v, i) b
  on a.v = b.v and a.i = b.i where b.best < a.f),
longer as (select a.key from variants a join firsts s on s.key = a.v where len(s.w) >= 8 and s.f < a.f),
shorter as (select s.key from variants a join firsts s on s.key = a.v where len(s.w) >= 8 and a.f < s.f),
near as (select key from same union select key from longer union select key from shorter),
gone as (
  select o.doc_id, o.no, n.key is not null as near
  from occ o join firsts f on f.key = o.key left join near n on n.key = o.key
  where n.key is not null or o.doc_id * 10000000 + o.no > f.min_place),
lists as (
  select doc_id, count(*) as n_removed, sum(case when near then 1 else 0 end) as n_near,
         string_agg(cast(no as varchar), ',' order by no) as removed_lines
  from gone group by doc_id),
counts as (select doc_id, count(*) as n_lines from occ group by doc_id)
select d.doc_id, coalesce(c.n_lines, 0) as n_lines, coalesce(l.n_removed, 0) as n_removed,
       cast(coalesce(l.n_near, 0) as bigint) as n_near, coalesce(l.removed_lines, '') as removed_lines
from documents d left join counts c on c.doc_id = d.doc_id left join lists l on l.doc_id = d.doc_id"""

_BENCH_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
CONTAMINATION_SQL = f"""
with words as (
  select doc_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), {_BENCH_WORD}) as w from documents),
item_words as (
  select cast(item_id as varchar) as item, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), {_BENCH_WORD}) as w from benchmark),
item_windows as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from item_words where len(w) > 0)),
lengths as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)),
met as (select d.doc_id, d.n, d.i, t.item from doc_windows d join item_windows t on t.win = d.win and t.n = d.n),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item from met) group by doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       sha256(coalesce(i.names, '')) as items_sha256,
       coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(w.w) as contaminated
from words w left join hit h on h.doc_id = w.doc_id left join items i on i.doc_id = w.doc_id"""

MIXING_SQL = f"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {_WORD})) as bigint) as size from documents),
totals as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as no from sized group by source),
weighted as (
  select *, cast(no % 3 + 1 as double) as weight, (no % 3 - 1) * 0.5 as slope, 3.0 * source_size as most from totals),
lines as (
  select *, (sum(source_size) over () - coalesce(sum(most) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as line
  from weighted
  window before as (order by most / weight, no rows between unbounded preceding and 1 preceding)),
targets as (select *, least(most, max(line) over () * weight) as target from lines),
sums as (select sum(target) as all_targets, sum(target * slope) as all_bends from targets),
placed as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, cast(t.slope as double) as slope,
         sum(s.size) over (partition by t.no order by coalesce(md5(cast(s.doc_id as varchar)), '~'), s.doc_id, s.size
                           rows between unbounded preceding and current row) - s.size as before,
         case when t.source_size > 0 then cast(floor(t.target / t.source_size) as bigint) else 0 end as passes
  from sized s join targets t on t.source is not distinct from s.source),
taken as (
  select *, passes * size + greatest(0, least(size, cast(round(target - passes * source_size) as bigint) - before)) as taken,
         case when slope = 0 then before / target
              else 2 * (before / target) / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / target))) end as t
  from placed)
select doc_id, size, cast(source_size as bigint) as source_size, round(target, 4) as target, cast(taken as bigint) as taken, source,
       case when taken > 0 then round(all_targets * t + all_bends * (t * t - t), 2) end as position
from taken, sums"""

WARC_SQL = """
with payloads as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as first from payloads where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
       case when f.first <> p.page_id then f.first end as refers_to, p.url,
       strftime(timestamp '2024-01-01 00:00:00' + to_seconds(p.page_id % 2147483648), '%Y-%m-%dT%H:%M:%SZ') as captured
from payloads p left join firsts f on f.payload_digest = p.payload_digest"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    form = (
        f"' ' || regexp_replace(regexp_replace({_LOWER.format(f'coalesce({text}, {_quoted('')})')}, "
        f"'{licenses.COPYRIGHT_LINE}', chr(10), 'g'), '{licenses.PUNCTUATION}', '  ', 'g') || ' '")
    for words, standard in licenses.SPELLINGS:
        form = f"replace({form}, ' {words.replace(' ', '  ')} ', ' {standard.replace(' ', '  ')} ')"
    return f"trim(replace({form}, '  ', ' '))"


LICENSES_SQL = f"""
with known as (
  select digest, min(license) as license from (
    select license, sha256({_canonical_sql('text')}) as digest
    from (values {', '.join(f'({_quoted(name)}, {_quoted(text)})' for name, text in licenses.KNOWN)}) k(license, text))
  group by digest),
raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
forms as (select doc_id, {_canonical_sql('line')} as form from raw),
found as (select f.doc_id, k.license from forms f left join known k on k.digest = sha256(f.form) where f.form <> ''),
per_doc as (
  select doc_id, count(*) as n_lines, count(license) as n_notices,
         coalesce(array_to_string(list_sort(list_distinct(list(license) filter (license is not null))), ','), '') as notices
  from found group by doc_id)
select d.doc_id, coalesce(p.n_lines, 0) as n_lines, coalesce(p.n_notices, 0) as n_notices, coalesce(p.notices, '') as notices,
       k.license as text_license
from documents d left join per_doc p on p.doc_id = d.doc_id
left join known k on k.digest = sha256({_canonical_sql('d.text')})"""


FILL_SQL = r"""
with tokens as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
drawn as (
  select doc_id, text, t, len(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from tokens),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, array_to_string(t[1:a], '') as prefix, array_to_string(t[a + 1:b], '') as middle, array_to_string(t[b + 1:], '') as suffix from cut)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts"""

NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, p.positive_score, s.other_id as negative_id, s.score as negative_score,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as integer) as rank
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) <= 3"""


def oracles() -> dict[str, str]:
    """The other operators (byte-level BPE, suffixes, spans of matches, XXH64, robust estimates, learned scores) are tested by brute force."""
    return {
        "op1_line_dedup": LINES_SQL, "op2_benchmark_decontamination": CONTAMINATION_SQL, "op3_source_mixing": MIXING_SQL,
        "op4_warc_index": WARC_SQL, "op7_license_scan": LICENSES_SQL, "op12_fill_in_middle": FILL_SQL, "op13_hard_negatives": NEGATIVES_SQL,
    }
