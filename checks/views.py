"""Input views over the test tables, as SQL that Spark and DuckDB both accept.

Each view names the tables and views it reads in braces. Spark gets them as DataFrames; for DuckDB they
become common table expressions. All views cover their whole source tables and whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# A hook per text, because the corpus itself holds no urgency terms, calls to action, tags or emoji.
HOOKS = [
    "",
    "Buy now and grab yours today! #sale",
    "Is this amazing? Tell us @brand",
    "Limited deal: last chance, hurry! 🔥🔥 #deal #promo",
    "This is not a great product and it is never bad",
    "A terrible, broken and useless waste. You stupid idiot, what a scam",
    "GET 50 percent discount NOW at 19 dollars",
    "Love it! Best value, seamless and powerful ⭐️",
    "Harika bir ürün, hemen al! Son şans, kaçırma #fırsat",
    "Berbat ve kötü, kesinlikle iyi değil; tam saçmalık",
    "Maybe you should try to sign up today? @shop @team",
    "Exclusive must have promo, order today. I hate delays, no regret",
]


def _case(key: str, values: list[str], default: str = "''") -> str:
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {key} {arms} else {default} end"


VIEWS = {
    "post_events": """
        select doc_id,
               sum(case when event_type = 'view' then 1 else 0 end) as views,
               sum(case when event_type = 'click' then whole else 0 end) as likes,
               sum(case when event_type = 'signup' then whole else 0 end) as shares,
               sum(case when event_type = 'purchase' then whole else 0 end) as comments,
               sum(case when event_type = 'error' then whole else 0 end) as errors,
               max(ts) as last_ts
        from (select event_id % (select count(*) from {documents}) as doc_id, event_type, ts,
                     cast(floor(value) as bigint) as whole
              from {events}) e
        group by doc_id""",
    "posts": f"""
        select d.doc_id as post_id,
               d.text || ' ' || {_case('d.doc_id % 12', HOOKS)} as text_content,
               d.lang as language,
               cast(coalesce(e.views, 0) * 100 as bigint) as impressions,
               cast(coalesce(e.likes, 0) as bigint) as likes_count,
               cast(coalesce(e.shares, 0) as bigint) as shares_count,
               cast(coalesce(e.comments, 0) as bigint) as comments_count,
               cast(l.quality as double) as sentiment_score,
               cast(l.toxic as double) as toxicity_score,
               cast(coalesce(e.errors, 0) as double) as buzz_change_rate,
               e.last_ts as last_ts
        from {{documents}} d
        left join {{post_events}} e on e.doc_id = d.doc_id
        left join {{labels}} l on l.doc_id = d.doc_id""",
    "variants": f"""
        select post_id as variant_id,
               cast(floor(post_id / 4) as bigint) as request_id,
               cast(post_id % 4 as int) as variant_ord,
               {_case('post_id % 4', ['emotional', 'informative', 'urgency', 'humorous'])} as style,
               'b' || cast(cast(floor(post_id / 4) as bigint) % 10 as string) as brand_id,
               text_content as text,
               case when impressions > 0
                    then cast(likes_count + shares_count + comments_count as double) / impressions * 100
                    else cast(0 as double) end as ctr_score,
               cast((shares_count * 13 + comments_count * 7 + post_id) % 1001 as double) / 10 as brand_score,
               impressions, last_ts
        from {{posts}}""",
    "gen_errors": f"""
        select post_id as variant_id,
               cast(floor(post_id / 4) as bigint) as request_id,
               cast(post_id % 4 as int) as variant_ord,
               {_case('post_id % 10', [
                   '429 RESOURCE_EXHAUSTED: quota of the model is used up',
                   'auth: API key not valid, request is unauthenticated',
                   '503 UNAVAILABLE: try again later',
                   'model not found: 404',
                   'failed to generate a text',
                   '500 internal',
                   'connection reset by peer',
                   'kota: 429 too many requests',
                   'Invalid argument'], "'timeout after ' || cast(post_id as string) || ' ms'")} as message
        from {{posts}}""",
    "generated": """
        select v.variant_id, v.request_id, v.variant_ord, v.brand_id, v.style,
               case when v.impressions > 0 then v.text end as text,
               case when v.impressions > 0 then null else g.message end as error
        from {variants} v join {gen_errors} g on g.variant_id = v.variant_id""",
    "brand_refs": """
        select vec_id as ref_id, 'b' || cast(label as string) as brand_id, cast(rn as int) as ref_ord,
               embedding as ref_vec
        from (select vec_id, label, embedding,
                     row_number() over (partition by label order by vec_id) as rn
              from {embeddings} where (vec_id * 48271) % 65537 % 10 < 3) r""",
    "text_vecs": """
        select e.vec_id as text_id, 'b' || cast(e.label as string) as source_brand, e.embedding as text_vec
        from {embeddings} e
        where (e.vec_id * 48271) % 65537 % 10 >= 3""",
    "eval_labels": """
        select text_id, case when text_id % 3 = 0 then ' ' else ' ' || upper(source_brand) || ' ' end as human_label
        from {text_vecs}""",
    "ref_texts": """
        select 'b' || cast(item_id % 10 as string) as brand_id, cast(floor(item_id / 10) as int) + 1 as ref_ord,
               text as ref_text
        from {benchmark}""",
    "brand_forms": f"""
        select s.s_suppkey as form_ord,
               case when s.s_suppkey % 9 = 8 then '  ' else 'b' || cast(s.s_suppkey as string) end as brand_id,
               ' ' || s.s_name || ' ' as brand_name,
               case when s.s_suppkey % 5 = 0 then '' else r.r_name end as tone_category,
               'Voice of ' || n.n_name as brand_voice_summary,
               case when s.s_suppkey % 6 = 0 then ''
                    else 'Keep it short' || chr(10) || chr(10) || ' Speak to ' || n.n_name || ' ' end as style_rules,
               {_case('s.s_suppkey % 4', ['the, value ,,', 'der,amazing', ''], "'de la'")} as preferred_vocabulary,
               {_case('s.s_suppkey % 3', ['maybe, try to', ''], "'idiot,hate'")} as forbidden_vocabulary,
               case when s.s_suppkey % 7 = 6 then ' '
                    else s.s_name || ' for ' || n.n_name || chr(10) || 'Made in ' || r.r_name end as reference_ad_copies
        from {{supplier}} s
        join {{nation}} n on n.n_nationkey = s.s_nationkey
        join {{region}} r on r.r_regionkey = n.n_regionkey""",
    "requests": """
        select q.request_id, q.brand_id, p.p_name as product, c.c_mktsegment as audience
        from (select request_id, max(brand_id) as brand_id,
                     request_id % (select count(*) from {part}) as part_key,
                     request_id % (select count(*) from {customer}) as cust_key
              from {variants} group by request_id) q
        join {part} p on p.p_partkey = q.part_key
        join {customer} c on c.c_custkey = q.cust_key""",
    "rewrites": """
        select variant_id, 1 as attempt, text || ' Rewritten once, best value!' as text,
               case when impressions = 0 then null
                    else cast((variant_id * 37 + impressions) % 1001 as double) / 10 end as brand_score,
               case when impressions = 0 then '503 UNAVAILABLE' end as error
        from {variants}
        union all
        select variant_id, 2 as attempt, text || ' Rewritten twice, order today' as text,
               cast((variant_id * 53 + impressions) % 1001 as double) / 10 as brand_score,
               cast(null as string) as error
        from {variants}""",
    "cache_rows": """
        select case when variant_ord < 2 then 'model-a' else 'model-b' end as model, text as prompt,
               style || ' answer ' || cast(impressions as string) as text, last_ts as created_at
        from {variants} where impressions > 0""",
    "fresh_rows": """
        select case when variant_ord < 2 then 'model-a' else 'model-b' end as model, text as prompt,
               'fresh ' || brand_id as text, last_ts as created_at
        from {variants} where ctr_score > 50 or impressions = 0""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
_NAME = re.compile(r"\{(" + "|".join([*VIEWS, *TABLES]) + r")\}")


class Inputs:
    """Tables and views of one data folder as DataFrames, made on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                table = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
                # A property of the test tables: the texts are one file of one row group, which one task would read and score.
                self._made[name] = table.repartition(self._spark.sparkContext.defaultParallelism) if name == "documents" else table
            else:
                parts = {part: getattr(self, part) for part in _NAME.findall(VIEWS[name])}
                self._made[name] = self._spark.sql(VIEWS[name], **parts)
        return self._made[name]


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        if name in VIEWS and name not in out:
            out += [n for n in _needed(_NAME.findall(VIEWS[name])) if n not in out] + [name]
    return list(dict.fromkeys(out))


def duck(body: str, *ctes: tuple[str, str]) -> str:
    """DuckDB query: views used by ``ctes`` and ``body`` (names in braces), then the given CTEs, then the body."""
    used = [n for text in [*(c for _, c in ctes), body] for n in _NAME.findall(text)]
    views = [(n, VIEWS[n]) for n in _needed(used)]
    parts = [f"{name} as ({_NAME.sub(lambda m: m.group(1), text)})" for name, text in [*views, *ctes]]
    prefix = "with " + ",\n".join(parts) + "\n" if parts else ""
    return prefix + _NAME.sub(lambda m: m.group(1), body)
