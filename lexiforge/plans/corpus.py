"""Queries over texts: tokens, term weights, topic quality, chunks, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udfs as U
from ..operators import coherence as C
from ..operators import topics as T
from ..operators.density import density_clusters
from ..operators.lineage import cut
from .common import Registry, table

R = Registry()
TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}'), lambda t: not regexp_full_match(t, '\p{N}+'))"


def _weights(by: str, z: str = "") -> str:
    return f"""tok{z} as (select {by} as class, unnest({TOKENS}) as word from documents where {by} is not null), cnt{z} as (select class, word, count(*) as n from tok{z} group by 1, 2),
siz{z} as (select class, sum(n) as size from cnt{z} group by 1), avgs{z} as (select avg(size) as a from siz{z}), frq{z} as (select word, sum(n) as f from cnt{z} group by 1),
wgt{z} as (select class, word, n, n * 1.0e0 / size * ln(1 + a / f) as weight from cnt{z} join siz{z} using (class) join frq{z} using (word), avgs{z}),
top{z} as (select * from (select *, row_number() over (partition by class order by weight desc, word) as rank from wgt{z}) where rank <= 10)"""


def _top(spark, d, by, k=10):
    return T.top_words(T.class_tfidf(T.term_counts(table(spark, d, "documents"), by)), k)


@R.query(f"with {_weights('lang')} select class, word, n, rank, round(weight, 8) as weight from top")
def h_class_tfidf(spark, d):
    return _top(spark, d, "lang").select("class", "word", "n", "rank", F.round("weight", 8).alias("weight"))


@R.query(f"with {_weights('lang')} select class, string_agg(word, ', ' order by rank) as keywords from top group by 1")
def l_keyword_table(spark, d):
    return T.keyword_table(_top(spark, d, "lang"))


@R.query(f"with {_weights('source')} select round(count(distinct word) * 1.0e0 / count(*), 4) as diversity from top")
def e_topic_diversity(spark, d):
    return T.diversity(_top(spark, d, "source"))


def _fixed_tops(spark, d):
    """The top words of each language, counted once and listed."""
    return C.fixed(T.top_words(T.class_tfidf(cut(T.term_counts(table(spark, d, "documents"), "lang")))))


def _windows(size: int) -> str:
    """Every window of every text on its own, and the top words in it."""
    return f"""{_weights('lang')}, doc as (select row_number() over () as d, {TOKENS.replace('text', "coalesce(text, '')")} as ws from documents), occ as (select d, word, p, length from
(select d, len(ws) as length, unnest(ws) as word, unnest(range(len(ws))) as p from doc) where word in (select word from top)), num as (select sum(greatest(len(ws) - {size} + 1, 1)) as total from doc),
win as (select distinct d, word, unnest(range(greatest(p - {size} + 1, 0), least(p, greatest(length - {size}, 0)) + 1)) as w from occ), one as (select word, count(*) as n from win group by 1),
two as (select x.word as a, y.word as b, count(*) as n from win x join win y on x.d = y.d and x.w = y.w group by 1, 2),
prs as (select s.class, s.rank as i, t.rank as j, o.n as n_i, q.n as n_j, coalesce(two.n, 0) as n, total from top s join top t on s.class = t.class join one o on o.word = s.word join one q on q.word = t.word
left join two on two.a = s.word and two.b = t.word, num), val as (select *, ln((n::double / total + 1e-12) / ((n_i::double / total) * (n_j::double / total))) / -ln(n::double / total + 1e-12) as x from prs)"""


@R.query(f"with {_windows(2_000_000_000)} select class, count(*) as pairs, round(avg(ln((n::double / total + 1e-12) / (n_j::double / total))), 6) as u_mass from prs where j < i group by 1")
def e_coherence(spark, d):
    docs, tops = table(spark, d, "documents"), _fixed_tops(spark, d)
    return C.u_mass(tops, C.window_counts(docs, tops, C.WHOLE)).withColumn("u_mass", F.round("u_mass", 6))


@R.query(f"with {_windows(10)} select class, count(*) as pairs, round(avg(x), 6) as npmi from val where j < i group by 1")
def e_coherence_npmi(spark, d):
    docs, tops = table(spark, d, "documents"), _fixed_tops(spark, d)
    return C.c_npmi(tops, C.window_counts(docs, tops, C.NPMI_WINDOW)).withColumn("npmi", F.round("npmi", 6))


@R.query(f"""with {_windows(110)}, sm as (select class, j, sum(x) as s from val group by 1, 2), cs as (select class, i, sum(x * s) / (sqrt(sum(x * x)) * sqrt(sum(s * s))) as c from val join sm using (class, j) group by 1, 2)
select class, count(*) as words, round(avg(c), 6) as c_v from cs group by 1""")
def e_coherence_cv(spark, d):
    docs, tops = table(spark, d, "documents"), _fixed_tops(spark, d)
    return C.c_v(tops, C.window_counts(docs, tops, C.CV_WINDOW)).withColumn("c_v", F.round("c_v", 6))


@R.query(f"""with {_weights('lang')}, {_weights('source', '_s')}, l as (select class, list(word) as ws from top group by 1), r as (select class, list(word) as ws from top_s group by 1)
select l.class as class, round(max(len(list_intersect(l.ws, r.ws)) * 1.0e0 / len(list_distinct(list_concat(l.ws, r.ws)))), 6) as best from l, r group by 1""")
def d_best_jaccard(spark, d):
    langs, sources = [C.fixed(T.top_words(T.class_tfidf(n))) for n in T.term_counts_of(table(spark, d, "documents"), "lang", "source")]
    return T.best_jaccard(langs, sources).withColumn("best", F.round("best", 6))


@R.query(f"select word, count(*) as n from (select unnest({TOKENS}) as word from documents) group by 1 order by n desc, word limit 200")
def e_word_frequencies(spark, d):
    return T.word_frequencies(table(spark, d, "documents"))


@R.query(f"""with w as (select doc_id, {TOKENS} as ws from documents), s as (select word, count(*) as n from (select unnest(ws) as word from w) group by 1),
p as (select a, b, count(*) as n from (select unnest(list_zip(ws[:-2], ws[2:])) as q from w where len(ws) > 1) t, lateral (select q[1] as a, q[2] as b) group by 1, 2 having count(*) >= 5)
select a, b, p.n as n, round((p.n - 5) * (select count(*) from s) * 1.0e0 / (sa.n * sb.n), 6) as score from p join s sa on sa.word = a join s sb on sb.word = b
where (p.n - 5) * (select count(*) from s) * 1.0e0 / (sa.n * sb.n) > 10""")
def i_phrases(spark, d):
    return T.phrases(table(spark, d, "documents")).withColumn("score", F.round("score", 6))


def _votes() -> str:
    shares = ", ".join(f"{{'share': -(len(list_filter(ws, lambda w: list_contains([{', '.join(repr(x) for x in s)}], w))) / greatest(len(ws), 1)::double), 'language': '{k}'}}" for k, s in sorted(T.STOPWORDS.items()))
    return f"""with v as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') as ws from documents), s as (select doc_id, len(ws) as n, list_sort([{shares}]) as r from v)
select doc_id, case when n >= 20 and -r[1].share >= 0.05e0 then r[1].language else 'eng' end as language, round(-r[1].share, 6) as share,
(n >= 20 and -r[1].share >= 0.05e0 and (-r[1].share) - (-r[2].share) >= 0.04e0) as clear from s"""


@R.query(_votes())
def i_language_votes(spark, d):
    return T.language_votes(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "language", "share", "clear")


WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))"


@R.query(f"select doc_id, {WORDS} as words, greatest(1, length(text) // 4)::int as tokens, (length(trim(text)) >= 20 and {WORDS} >= 6) as has_layer from documents")
def i_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.word_count(t).alias("words"), X.token_estimate(t).alias("tokens"), X.has_text_layer(t).alias("has_layer"))


@R.query(f"select count(*) filter ({WORDS} > 256) as over, count(*) as total, max({WORDS}) as longest from documents")
def c_overlong(spark, d):
    return T.overlong(table(spark, d, "documents"))


@R.query(r"""select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(text, chr(10) || ' '), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), '|') as sentences from documents""")
def i_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.sentences(F.col("text")), "|").alias("sentences"))


@R.query(r"select doc_id, array_to_string(regexp_extract_all(text, '(\n+|[^\n]+)'), '|') as parts from documents")
def i_line_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.line_parts(F.col("text")), "|").alias("parts"))


@R.query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) as plain, len(regexp_extract_all(html, '(?i)<p\b')) as paragraphs from pages""")
def i_html_plain(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", X.html_plain(h).alias("plain"), F.regexp_count(h, F.lit(r"(?i)<p\b")).alias("paragraphs"))


@R.query(r"""with b as (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<(h1|p|li|a)\b[^>]*>', 1)) as tag from pages)
select page_id, case lower(tag) when 'h1' then 'title' when 'p' then 'text' when 'li' then 'list' else 'reference' end as type, count(*) as n from b group by 1, 2""")
def m_page_blocks(spark, d):
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>", " ")
    tags = F.regexp_extract_all(bare, F.lit(r"(?is)<(h1|p|li|a)\b[^>]*>"), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", F.explode(F.transform(tags, F.lower)).alias("tag"))
    kind = F.when(F.col("tag") == "h1", "title").when(F.col("tag") == "p", "text").when(F.col("tag") == "li", "list").otherwise("reference")
    return rows.groupBy("page_id", kind.alias("type")).agg(F.count("*").alias("n"))


@R.query()
def f_sentence_chunks(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(U.sentence_chunks("text")).alias("chunk", "text"))
    return chunks.select("doc_id", "chunk", F.length("text").alias("chars"))


@R.query()
def f_break_chunks(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(U.break_chunks("text", 4000)).alias("chunk", "text"))
    return chunks.select("doc_id", "chunk", F.length("text").alias("chars"))


# Spans of every kind with the document's number (#) in them stand before the whole text, whose own spans stay as well.
_KINDS = ["](http://a.b/#)", "`x_#`", "{slot.n}", "$$a_#$$", r"\(b_#\)", r"\[c_#\]", "$d_#$", "![i #](u_#)", "<b id='#'>", "</b>", "www.x#.org", "me+#@mail.x.org", "/usr/lib_#/x", "%(n)s", "%05.2f", "https://c.d/#?q=1"]
_SHOWN = ["[page #" + _KINDS[0], *_KINDS[1:]]
# The same spans as one pattern for SQL, which can't look behind: U+F8F2 marks slashes that may open a path, U+F8F3 escaped dollars.
_BLANK = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPANS = "|".join([
    r"(?m:^)[ \t]*`{3}[^\n]*\n(?:[^\n]*\n)*?[ \t]*`{3}[ \t]*(?m:$)", r"(?m:^)[ \t]*~{3}[^\n]*\n(?:[^\n]*\n)*?[ \t]*~{3}[ \t]*(?m:$)", r"`[^`\n]+`",
    r"\x{F8F3}?\$\$(?s:.+?)\$\$", r"\x{F8F3}\$", rf"\$[^${_BLANK}](?:[^$\n]*[^${_BLANK}])?\$", r"\\\[(?s:.+?)\\\]", r"\\\((?s:.+?)\\\)", r"!\[[^\]]*\]\((?s:.)[^)]*\)",
    rf"\[[^\]\n]+\]\([^){_BLANK}]+(?:[{_BLANK}]+\"[^\"]*\")?\)", r"<\x{F8F2}?/?[A-Za-z][^>]*>", r"\{[A-Za-z_][A-Za-z0-9_.]*\}", r"%\([^)]+\)[sdif]", r"%[0-9+\-#. ]*[dioxXeEfgGs]",
    rf"(?:https?|ftp)://[^{_BLANK}]+", rf"www\.[^{_BLANK}]+", r"\x{F8F2}(?:/[A-Za-z0-9_.\-]+){2,}/?", r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+"])


def _spans_sql(text: str) -> str:
    """SQL for the list of spans in a text, a link without its label."""
    marked = rf"regexp_replace(regexp_replace({text}, '(^|[^A-Za-z0-9_/])(/[A-Za-z0-9_.\-])', '\1' || chr(63730) || '\2', 'g'), '\\\$', '\\' || chr(63731) || '$', 'g')"
    found = f"list_filter(regexp_extract_all({marked}, '{_SPANS}'), lambda s: s <> chr(63731) || '$')"
    return rf"list_transform({found}, lambda s: replace(replace(case when s[1] = '[' then regexp_replace(s, '^\[[^\]\n]+', '') else s end, chr(63730), ''), chr(63731), ''))"


@R.query("""with t as (select doc_id, coalesce(text, '') as own, replace('{head}', '#', doc_id::varchar) || own as t from documents)
select doc_id, array_to_string({spans}, chr(1)) as kept, true as same, length(own) > 0 as filled from t""".format(head=(" word ".join(_SHOWN) + " ").replace("'", "''"), spans=_spans_sql("t")))
def p_shield_round_trip(spark, d):
    own = F.coalesce("text", F.lit(""))
    head = F.replace(F.lit(" word ".join(_SHOWN) + " "), F.lit("#"), F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(head, own).alias("text"), (F.length(own) > 0).alias("filled")).withColumn("m", U.tried_mask("text"))
    return rows.select("doc_id", F.array_join("m.kept", "\x01").alias("kept"), F.col("m.same").alias("same"), "filled")


@R.query("select doc_id, true as same, 0 as addresses from documents")
def p_shield_texts(spark, d):
    rows = table(spark, d, "documents").withColumn("m", U.tried_mask("text"))
    return rows.select("doc_id", F.coalesce("m.same", F.lit(True)).alias("same"),
                       F.regexp_count(F.coalesce("m.masked", F.lit("")), F.lit(r"https?://[a-z]")).alias("addresses"))


@R.query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
k as (select *, case when regexp_full_match(line, '\s*') or regexp_matches(line, '^(\s*(`{3}|~{3})| {0,3}#{1,6}\s|\s*([-*+]|\d+[.)])\s|\s*>|\s*\|| {4}|\t)') or regexp_matches(line, '^ {0,3}((-\s*){3,}|(\*\s*){3,}|(_\s*){3,})$') then 'other' else 'prose' end as kind from l),
g as (select *, lag(kind) over (partition by doc_id order by i) as pk, lag(line) over (partition by doc_id order by i) as pl from k),
b as (select *, sum(case when kind = 'prose' and pk = 'prose' and not regexp_matches(pl, '(  |[.!?:;。！？…][\]''")»”’]*\s*)$') then 0 else 1 end) over (partition by doc_id order by i) as block from g),
f as (select *, min(i) over (partition by doc_id, block) as first, count(*) over (partition by doc_id, block) as n from b),
j as (select doc_id, block, replace(regexp_replace(string_agg(case when n = 1 then line when i = first then regexp_replace(line, '\s+$', '') else regexp_replace(line, '^\s+|\s+$', '', 'g') end, chr(1) order by i), '-\x01(\p{Ll})', '\1', 'g'), chr(1), ' ') as line from f group by 1, 2),
o as (select doc_id, string_agg(line, chr(10) order by block) as text from j group by 1)
select documents.doc_id as doc_id, o.text as text, true as stable from documents left join o using (doc_id)""")
def f_reflow(spark, d):
    rows = table(spark, d, "documents").select("doc_id", U.reflowed("text").alias("text"))
    return rows.withColumn("stable", F.coalesce(U.reflowed("text") == F.col("text"), F.lit(True)))


@R.query(r"""select doc_id, regexp_replace(doc_id::varchar || ' ' || text, '[^A-Za-z0-9_.\-]+', '_', 'g') as slug, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]') as corrupt,
lower(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) as key from documents""")
def i_slugs(spark, d):
    head = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.slug(head).alias("slug"), X.is_corrupt(F.col("text")).alias("corrupt"), X.alphanumeric(F.col("text")).alias("key"))


@R.query("select conv_id, string_agg('**' || upper(role[1]) || lower(role[2:]) || '**' || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as text from conversations group by 1")
def b_conversation_markdown(spark, d):
    from ..operators.transcript import conversation_markdown

    return conversation_markdown(table(spark, d, "conversations"))


@R.query("select label as a, count(*) as n from embeddings group by 1")
def l_embedding_labels(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("a")).agg(F.count("*").alias("n"))


@R.query("""with p as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from p group by 1, 2),
n as (select label, sqrt(sum(x * x)) as n from m group by 1) select a.label as a, b.label as b, round(sum(a.x * b.x) / any_value(na.n) / any_value(nb.n), 6) as cosine
from m a join m b on a.i = b.i and a.label < b.label join n na on na.label = a.label join n nb on nb.label = b.label group by 1, 2""")
def l_centroid_similarity(spark, d):
    return T.centroid_similarity(table(spark, d, "embeddings"), "label").withColumn("cosine", F.round("cosine", 6))


@R.query()
def l_embedding_topics(spark, d):
    return T.embedding_topics(table(spark, d, "embeddings"), 10)


@R.query()
def l_density_clusters(spark, d):
    return density_clusters(table(spark, d, "embeddings"))


@R.query()
def l_lda(spark, d):
    return T.lda(table(spark, d, "documents"), 5, iterations=5)[1]
