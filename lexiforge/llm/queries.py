"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer files' package gives the path; the files are never copied here.
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_paragraphs", F.size("found").alias("n_licences"),
                      F.array_join(F.array_sort(F.array_distinct("found.family")), ",").alias("families"),
                      F.col("found.paragraph").alias("paragraphs"), F.array_max("found.probability").alias("probability"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_codec import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer(PIECES))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .span_dedup import PASSAGE, dedup_spans

    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE).select("doc_id", "n_units", "n_removed", "text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), room=2048, end_id=1)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"), unit="line", seed=7, rate=100, spm=50)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score_texts

    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held, sweeps=3, burn=1)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, covered=80, most=2000)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_top_k, op3_license_scan, op4_sentencepiece, op5_quality_classifier, op6_nearest_neighbours, op7_ngram_jaccard_join, op8_substring_dedup, op9_sharding, op10_packing, op11_fill_in_middle, op12_pitman_yor, op13_collocations)}
#: SQL for what it can express; the others are tested against brute force, round trips or held-out labels.
ORACLE: dict[str, str] = {
    "op2_exact_top_k": """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select a.vec_id as query_id, b.vec_id as vec_id, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, rank, vec_id, score from r where rank <= 5""",
    "op7_ngram_jaccard_join": r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_sort(list_distinct(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as sh from w),
e as (select doc_id, unnest(sh) as g from s), p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)), t as (select a, b from l union all select b, a from l),
r(id, c) as (select doc_id, doc_id from s union select r.id, t.b from r join t on r.c = t.a), m as (select id, min(c) as component_id from r group by 1)
select doc_id, len(sh) as n_shingles, component_id, case when len(sh) > 0 then count(*) over (partition by sh) else 0 end as n_copies from s join m on m.id = doc_id""",
    "op11_fill_in_middle": r"""with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as us, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d),
k as (select *, len(us) as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1))::bigint as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1))::bigint as b from u),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
coalesce(array_to_string(us[1:a], ''), '') as p, coalesce(array_to_string(us[a + 1:b], ''), '') as m, coalesce(array_to_string(us[b + 1:], ''), '') as s from k)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(p || m || s) as restored_sha256 from f""",
    "op13_collocations": r"""with p as (select lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[ \t]+'), lambda x: x <> '') as ws
from (select coalesce(lang, 'und') as lang, text from documents)), g as (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from p, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k),
f as (select lang, ws[i:i + k - 1] as ph, k, count(*) as f from g group by 1, 2, 3), t as (select lang, sum(f)::bigint as n from f where k = 1 group by 1), c as (select * from f where k > 1 and f >= 30),
q as (select c.lang as lang, c.ph as ph, c.k as k, c.f as a, x.f as l, y.f as r, (2000000::hugeint * c.f // (x.f + y.f))::bigint as score, j from (select *, unnest(range(1, k)) as j from c) c
join f x on x.lang = c.lang and x.ph = c.ph[1:j] join f y on y.lang = c.lang and y.ph = c.ph[j + 1:]), b as (select * from q qualify row_number() over (partition by lang, ph order by score, j) = 1),
d as (select * from b where not exists (select 1 from c z where z.lang = b.lang and z.k > b.k and 100::hugeint * z.f >= 80 * b.a and (z.ph[1:b.k] = b.ph or z.ph[2:b.k + 1] = b.ph or (z.k = 4 and z.ph[3:b.k + 2] = b.ph))))
select lang, rank, phrase, a, l, r, n, score from (select lang, array_to_string(ph, ' ') as phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) as rank from d) join t using (lang) where rank <= 2000""",
}
