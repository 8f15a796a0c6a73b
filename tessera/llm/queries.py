"""The queries opN_<name>: each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, langid, mixing, quality, rabitq, secrets, sharding, suffixes, urlrules
from tessera.llm.common import table

#: Where the vocabulary files are; the package that has them is looked up when a query runs.
BYTE_BPE = "byte_bpe_50k.json"
#: Rules of op8: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets.scan(table(spark, sf_dir, "documents"), words=secrets.vocabulary(public_tokenizers.path(BYTE_BPE)))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffixes": op2_suffixes,
    "op3_secrets": op3_secrets,
    "op4_jaccard": op4_jaccard,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_langid": op7_langid,
    "op8_urls": op8_urls,
    "op9_embeddings": op9_embeddings,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": r"""
        with recursive w as (select row_number() over () as n, doc_id,
                                    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
        s as (select distinct n, array_to_string(ws[i:i + 3], ' ') as g from (select n, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)),
        c as (select n, count(*) as k from s group by n),
        p as (select a.n as a, b.n as b, count(*) as i from s a join s b on a.g = b.g and a.n < b.n group by 1, 2),
        links as (select a, b from p join c x on x.n = a join c y on y.n = b where 100 * i >= 85 * (x.k + y.k - i)),
        both_ways as (select a, b from links union all select b, a from links),
        reach(n, m) as (select n, n from w union select r.n, l.b from reach r join both_ways l on l.a = r.m)
        select w.doc_id, coalesce(any_value(c.k), 0)::bigint as n_shingles, min(o.doc_id) as component_id
        from w left join c on c.n = w.n join reach r on r.n = w.n join w o on o.n = r.m group by w.n, w.doc_id""",
    "op5_mixing": r"""
        with recursive sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
        sums as (select source, sum(size)::bigint as source_size from sized group by source),
        weighted as (select *, 2.0::double * source_size as cap,
                            [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as w from sums),
        level as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (ranked rows between unbounded preceding and 1 preceding), 0.0::double))
                            / sum(w) over (ranked rows between current row and unbounded following) as l
                  from weighted window ranked as (order by cap / w asc, source asc nulls last)),
        firsts as (select *, first_value(case when not cap <= w * l then l end ignore nulls) over (order by cap / w asc, source asc nulls last rows between unbounded preceding and current row) as f from level),
        goal as (select source, source_size, coalesce(w * f, cap) as target from firsts),
        rated as (select source, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate from goal),
        parts as (select *, floor(rate)::bigint as whole, rate - floor(rate) as part from rated),
        hashed as (select *, ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::varchar, 'null'), coalesce(source, 'null'), size::varchar)), 1, 13))::bigint::double / 4503599627370496.0::double as u,
                          (length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)))::int as g from sized),
        strata as (select source, g, count(*)::bigint as n, sum(size)::bigint as s, row_number() over (partition by source order by g desc) as k,
                          ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(source, 'null'), g::varchar)), 1, 13))::bigint::double / 4503599627370496.0::double as r from hashed group by source, g),
        due(source, k, g, share, rem, many) as (
            select source, 0::bigint, -1, part, source_size, 0::bigint from parts
            union all
            select source, k, g, case when part > 0 and rem > 0 then least(greatest(share - least(1.0::double, share * rem / ((1 - part) * mean), (1 - share) * rem / (part * mean)) * ((many - due) * mean / rem), 0.0::double), 1.0::double) else share end, rem, many
            from (select *, floor(due)::bigint + (r < part)::bigint as many from (select *, due - floor(due) as part
                  from (select t.source, t.k, t.g, t.r, d.share, d.rem - t.s as rem, t.s::double / t.n::double as mean, d.share * t.n as due from due d join strata t on t.source is not distinct from d.source and t.k = d.k + 1)))),
        ranked as (select *, row_number() over (partition by source, g order by u) as rn from hashed),
        lasts as (select r.source, r.g, r.u from ranked r join due d on d.source is not distinct from r.source and d.g = r.g and d.many = r.rn)
        select h.doc_id, h.size, p.source_size, p.target, (h.size * (p.whole + coalesce((h.u <= l.u)::bigint, 0)))::bigint as taken
        from hashed h join parts p on p.source is not distinct from h.source left join lasts l on l.source is not distinct from h.source and l.g = h.g""",
    "op9_embeddings": r"""
        with recursive v as (select row_number() over () as n, vec_id, embedding::double[] as e from embeddings),
        ok as (select n, e, list_dot_product(e, e) as q from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
        links as (select a.n as a, b.n as b from ok a join ok b on a.n <> b.n where list_dot_product(a.e, b.e) / sqrt(a.q * b.q) >= 0.95::double),
        reach(n, m) as (select n, n from v union select r.n, l.b from reach r join links l on l.a = r.m),
        counts as (select a as n, count(*) as k from links group by 1)
        select v.vec_id, coalesce(any_value(c.k), 0)::bigint as n_links, min(o.vec_id) as component_id, v.vec_id = min(o.vec_id) as kept
        from v left join counts c on c.n = v.n join reach r on r.n = v.n join v o on o.n = r.m group by v.n, v.vec_id""",
    "op8_urls": r"""
        with rules(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        parts as (select row_number() over () as n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
        fits as (select p.n, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) as rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) as verdict
                 from parts p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by p.n)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits using (n)""",
}
