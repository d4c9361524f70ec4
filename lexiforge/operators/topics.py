"""Corpus analytics: term weighting by class, topic quality, phrases, topic models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import cut

# Frequent function words of four languages, for the vote in language_votes().
STOPWORDS = {
    "eng": ["the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "on", "as", "was", "at", "by"],
    "deu": ["der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "im", "des", "für", "auf", "eine", "ein"],
    "fra": ["le", "la", "les", "et", "de", "des", "du", "un", "une", "en", "est", "que", "pour", "dans", "par"],
    "spa": ["el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "con", "por", "para", "se", "del"],
    "ita": ["il", "lo", "la", "gli", "di", "che", "e", "un", "una", "per", "con", "non", "del", "della", "sono"],
}


def term_counts(docs: DataFrame, by: str, text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """Occurrences of each token in each class: ``(class, word, n)``. Counts are combined before they are shuffled."""
    words = X.without(X.tokens(F.col(text)), stop or [])
    return docs.where(F.col(by).isNotNull()).select(F.col(by).alias("class"), F.explode(words).alias("word")).groupBy("class", "word").agg(F.count("*").alias("n"))


def term_counts_of(docs: DataFrame, *by: str, text: str = "text") -> list[DataFrame]:
    """``term_counts`` by each of some columns; texts are split once, and counts of all columns' values together are written once."""
    rows = docs.select(*[F.col(b).alias(f"__{b}") for b in by], F.explode(X.tokens(F.col(text))).alias("word"))
    counts = cut(rows.groupBy(*[f"__{b}" for b in by], "word").agg(F.count("*").alias("n")))
    return [cut(counts.where(F.col(f"__{b}").isNotNull()).groupBy(F.col(f"__{b}").alias("class"), "word").agg(F.sum("n").alias("n"))) for b in by]


def class_tfidf(counts: DataFrame, reduce_frequent: bool = False) -> DataFrame:
    """L3: class-based term weights ``tf * ln(1 + A / f)``; tf sums to 1 in each class, A is the mean size of a class."""
    tf = F.col("n") / F.col("size")
    sizes = counts.groupBy("class").agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean_size"))
    words = counts.groupBy("word").agg(F.sum("n").alias("f"))
    weight = (F.sqrt(tf) if reduce_frequent else tf) * F.log(1 + F.col("mean_size") / F.col("f"))
    return counts.join(words, "word").join(sizes, "class").crossJoin(F.broadcast(mean)).select("class", "word", "n", weight.alias("weight"))  # mean: one row


def top_words(weights: DataFrame, k: int = 10) -> DataFrame:
    """The k heaviest words of each class, ties by the word."""
    rank = F.row_number().over(W.partitionBy("class").orderBy(F.desc("weight"), "word"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_table(tops: DataFrame) -> DataFrame:
    """A row per class: its words by rank, joined."""
    words = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return tops.groupBy("class").agg(F.array_join(F.transform(words, lambda s: s["word"]), ", ").alias("keywords"))


def diversity(tops: DataFrame) -> DataFrame:
    """Distinct words over words, of all classes' top words."""
    return tops.agg(F.round(F.count_distinct("word") / F.count("*"), 4).alias("diversity"))


def reassigned(doc_terms: DataFrame, weights: DataFrame) -> DataFrame:
    """L4: for each outlier document ``(id, word, n)`` the class whose term vector is nearest by cosine."""
    dots = doc_terms.join(weights, "word").groupBy("id", "class").agg(F.sum(doc_terms["n"] * F.col("weight")).alias("dot"))
    norms = weights.groupBy("class").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return dots.join(F.broadcast(norms), "class").groupBy("id").agg(F.max_by("class", F.struct(F.col("dot") / F.col("norm"), "class")).alias("class"))


def best_jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each class of ``left`` its best word-set overlap with a class of ``right``. Both are a row for each topic."""
    sets = lambda t, n: t.groupBy("class").agg(F.collect_set("word").alias(n)).withColumnRenamed("class", f"{n}_class")
    both = sets(left, "l").join(F.broadcast(sets(right, "r")), F.lit(True))  # topics by topics, each a handful
    j = F.size(F.array_intersect("l", "r")) / F.size(F.array_union("l", "r"))
    return both.groupBy(F.col("l_class").alias("class")).agg(F.max(j).alias("best"))


def phrases(docs: DataFrame, text: str = "text", least: int = 5, threshold: float = 10.0) -> DataFrame:
    """I4: word pairs that stand together more often than their frequencies suggest."""
    # Each word with the one behind it, or null at the end: a word's pairs add up to its occurrences, so texts are read once.
    words = docs.select(X.tokens(F.col(text)).alias("ws"))
    both = words.select(F.explode(F.transform("ws", lambda w, i: F.struct(w.alias("a"), F.get("ws", i + 1).alias("b")))).alias("p"))
    counts = cut(both.groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    single = cut(counts.groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("n")))
    pairs = counts.where(F.col("b").isNotNull() & (F.col("n") >= least))
    size = single.agg(F.count("*").alias("vocabulary"))
    score = (F.col("n") - least) * F.col("vocabulary") / (F.col("na") * F.col("nb"))
    return (pairs.join(single.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b")
            .crossJoin(F.broadcast(size)).select("a", "b", "n", score.alias("score")).where(F.col("score") > threshold))


def word_frequencies(docs: DataFrame, text: str = "text", stop: list[str] | None = None, k: int = 200) -> DataFrame:
    """The k most frequent words, ties by the word."""
    words = X.without(X.tokens(F.col(text)), stop or [])
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def _among(words: list[str]):
    return lambda w: w.isin(words)


def language_votes(docs: DataFrame, text: str = "text", default: str = "eng", least: int = 20, low: float = 0.05) -> DataFrame:
    """Each language's share of stopwords among a text's words, and the best one.

    Texts of under ``least`` words, or whose best share is below ``low``, get the default; ``clear`` says
    whether the best leads by 0.04. Ties: the alphabetically first.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    shares = [F.struct((F.size(F.filter("__w", _among(s))) / F.greatest(F.size("__w"), F.lit(1))).alias("share"), F.lit(k).alias("language")) for k, s in sorted(STOPWORDS.items())]
    order = lambda a, b: F.when(a["share"] > b["share"], -1).when(a["share"] < b["share"], 1).when(a["language"] < b["language"], -1).otherwise(1)
    out = docs.withColumn("__w", words).withColumn("__s", F.array_sort(F.array(*shares), order))
    best = F.col("__s")[0]
    sure = (F.size("__w") >= least) & (best["share"] >= low)
    return out.select(*docs.columns, F.when(sure, best["language"]).otherwise(default).alias("language"), F.round(best["share"], 6).alias("share"),
                      (sure & (best["share"] - F.col("__s")[1]["share"] >= 0.04)).alias("clear"))


def overlong(docs: DataFrame, text: str = "text", most: int = 256) -> DataFrame:
    """How many texts exceed a model's context, of how many, and the longest."""
    n = X.word_count(F.col(text))
    return docs.agg(F.count_if(n > most).alias("over"), F.count("*").alias("total"), F.max(n).alias("longest"))


def lda(docs: DataFrame, k: int, id_col: str = "doc_id", text: str = "text", iterations: int = 20, seed: int = 42):
    """L1, L2: (keywords, documents) of a latent Dirichlet model; dominant topics count from 1, null for documents without words.

    The vocabulary holds words of at least 1 document (2 from 20 documents on) and at most 90 % of them; of more than 262,144
    words the most frequent ones (CountVectorizer's own limit).
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    words = docs.select(id_col, X.tokens(F.col(text)).alias("words"))
    total, n = words.agg(F.count("*"), F.count_if(F.size("words") > 0)).first()
    if n < 5:
        raise ValueError("at least 5 documents with words are needed")
    # A share as maxDF would keep all texts' words as strings in memory to count the texts, so it is given as their number.
    vectors = CountVectorizer(inputCol="words", outputCol="features", minDF=1 if n < 20 else 2, maxDF=0.9 * total).fit(words)
    bags = vectors.transform(words)
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", optimizeDocConcentration=True).fit(bags.where(F.size("words") > 0))
    names = vectors.vocabulary
    tops = [(r["topic"] + 1, ", ".join(names[i] for i in r["termIndices"])) for r in model.describeTopics(10).collect()]  # k rows
    keywords = docs.sparkSession.createDataFrame(tops, "topic int, keywords string")
    share = vector_to_array("topicDistribution")
    top = F.array_max(share)
    found = model.transform(bags).select(id_col, F.when(F.size("words") > 0, F.array_position(share, top).cast("int")).alias("dominant_topic"), F.when(F.size("words") > 0, F.round(top, 4)).alias("confidence"))
    return keywords, found, model


def perplexity(model, bags: DataFrame) -> float | None:
    """E to the bound (natural logarithms); null if not finite."""
    import math

    value = math.exp(min(700.0, model.logPerplexity(bags)))
    return value if math.isfinite(value) else None


def embedding_topics(vectors: DataFrame, k: int, dims: int = 5, id_col: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """Reduced and clustered embeddings (PCA, then k-means): ``(id, topic)`` with topics numbered by size from 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector).isNotNull()).select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    low = PCA(k=dims, inputCol="v", outputCol="features").fit(rows).transform(rows)
    out = KMeans(k=k, seed=seed).fit(low).transform(low).select(id_col, "prediction")
    sizes = out.groupBy("prediction").agg(F.count("*").alias("n"))
    names = sizes.select("prediction", (F.row_number().over(W.orderBy(F.desc("n"), "prediction")) - 1).alias("topic"))  # k rows
    return out.join(F.broadcast(names), "prediction").select(id_col, "topic")


def cosine(a, b):
    """Cosine of two array columns of one length; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def centroid_similarity(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Cosines of the classes' mean vectors, all pairs of classes (a handful)."""
    long = vectors.where(F.col(by).isNotNull()).select(F.col(by).alias("class"), F.posexplode(vector).alias("i", "x"))
    means = long.groupBy("class", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    means = means.select("class", F.transform("v", lambda s: s["x"]).alias("v"))
    a, b = means.alias("a"), means.alias("b")
    return a.join(F.broadcast(b), F.col("a.class") < F.col("b.class")).select(F.col("a.class").alias("a"), F.col("b.class").alias("b"), cosine(F.col("a.v"), F.col("b.v")).alias("cosine"))


def topics_over_time(rows: DataFrame, topic: str, stamp: str, unit: str = "month") -> DataFrame:
    """Documents of each topic in each period."""
    return rows.dropna(subset=[topic, stamp]).groupBy(F.col(topic).alias("topic"), F.date_trunc(unit, stamp).alias("period")).agg(F.count("*").alias("n"))


# Phrases of errors that mean a corpus is too small.
SMALL_CORPUS_SIGNS = ["need at least one array to concatenate", "k >= n", "found array with 0 sample"]


def is_small_corpus_error(message) -> F.Column:
    """Whether an error message says that there were too few documents."""
    low = F.lower(message)
    out = F.lit(False)
    for sign in SMALL_CORPUS_SIGNS:
        out = out | low.contains(sign.lower())
    return F.coalesce(out, F.lit(False))
