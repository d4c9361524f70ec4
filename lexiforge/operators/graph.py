"""Citation graphs: nodes and edges from paper records.

``papers(paper_id, title, doi, authors array, topics array<struct(category, label, confidence)>,
citations array<struct(title, doi)>, cited_authors array, n_citations)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import node_size


def node_id(doi, paper_id, lower: bool = True):
    """K3: ``doi:`` and the DOI where there is one, else the paper's id."""
    d = F.trim(F.lower(doi) if lower else doi)
    return F.when(F.coalesce(d, F.lit("")) != "", F.concat(F.lit("doi:"), d)).otherwise(F.coalesce(paper_id, F.lit("unknown")))


def _papers(papers: DataFrame) -> DataFrame:
    return papers.withColumn("node", node_id(F.col("doi"), F.col("paper_id"))).withColumn("key", F.lower(F.trim("title")))


def title_index(papers: DataFrame) -> DataFrame:
    """The paper of each title; of equal titles the last by id."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("paper_id")))
    return _papers(papers).where("key <> ''").withColumn("r", rank).where("r = 1").select("key", F.col("node").alias("hit"))


def edges(papers: DataFrame, least: float = 0.0) -> DataFrame:
    """K2, K4, K5: all edges ``(src, dst, label)``, each pair once (a later kind overwrites an earlier one).

    author -> paper, paper -> category, topic -> paper, topic -> category, paper -> cited paper
    (in the corpus by title, else an outside node of the title's first 50 characters), paper -> cited author.
    """
    p = _papers(papers)
    topic = p.select("node", F.explode("topics").alias("t")).where(F.coalesce("t.confidence", F.lit(0.5)) >= least)
    of = lambda kind, c: F.concat(F.lit(kind + ":"), F.coalesce(c, F.lit("unknown")))
    cited = p.select("node", F.explode("citations").alias("c")).select("node", F.trim("c.title").alias("title")).where("title <> ''").withColumn("key", F.lower("title"))
    cited = cited.join(title_index(papers), "key", "left")
    kinds = [
        p.select(F.explode("authors").alias("a"), "node").select(of("author", F.col("a")).alias("src"), F.col("node").alias("dst"), F.lit("authored").alias("label"), F.lit(0).alias("k")),
        topic.select(F.col("node").alias("src"), of("category", F.col("t.category")).alias("dst"), F.lit("in_category").alias("label"), F.lit(1).alias("k")),
        topic.select(of("topic", F.col("t.label")).alias("src"), F.col("node").alias("dst"), F.lit("topic_of").alias("label"), F.lit(2).alias("k")),
        topic.select(of("topic", F.col("t.label")).alias("src"), of("category", F.col("t.category")).alias("dst"), F.lit("belongs_to").alias("label"), F.lit(3).alias("k")),
        cited.select(F.col("node").alias("src"), F.coalesce("hit", F.concat(F.lit("paper:"), F.substring("title", 1, 50))).alias("dst"), F.lit("cites").alias("label"), F.lit(4).alias("k")),
        p.select("node", F.explode("cited_authors").alias("a")).select(F.col("node").alias("src"), of("cited_author", F.col("a")).alias("dst"), F.lit("cites_work_by").alias("label"), F.lit(5).alias("k")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.groupBy("src", "dst").agg(F.max_by("label", "k").alias("label"))


def nodes(papers: DataFrame, least: float = 0.0) -> DataFrame:
    """All nodes with kind, links (with and without repeats) and size."""
    p = _papers(papers)
    topic = p.select("node", F.explode("topics").alias("t")).where(F.coalesce("t.confidence", F.lit(0.5)) >= least)

    def fan(rows: DataFrame, kind: str, name: str) -> DataFrame:
        g = rows.groupBy(name).agg(F.count("*").alias("links"), F.count_distinct("node").alias("papers"))
        return g.select(F.concat(F.lit(kind + ":"), name).alias("id"), F.lit(kind).alias("kind"), "links", "papers", node_size(kind, F.col("links")).cast("double").alias("size"))

    own = p.groupBy("node").agg(F.max("n_citations").alias("n"))
    out = own.select(F.col("node").alias("id"), F.lit("paper").alias("kind"), F.coalesce("n", F.lit(0)).cast("long").alias("links"), F.lit(1).cast("long").alias("papers"), node_size("paper", F.coalesce("n", F.lit(0))).cast("double").alias("size"))
    outside = p.select("node", F.explode("citations").alias("c")).select("node", F.trim("c.title").alias("title")).where("title <> ''").withColumn("key", F.lower("title"))
    outside = outside.join(title_index(papers), "key", "left_anti").groupBy(F.concat(F.lit("paper:"), F.substring("title", 1, 50)).alias("id")).agg(F.count("*").alias("links"), F.count_distinct("node").alias("papers"))
    for rows in (fan(p.select("node", F.explode("authors").alias("author")), "author", "author"),
                 fan(topic.select("node", F.coalesce("t.category", F.lit("General")).alias("category")), "category", "category"),
                 fan(topic.select("node", F.col("t.label").alias("topic")), "topic", "topic"),
                 outside.select("id", F.lit("cited_paper").alias("kind"), "links", "papers", F.lit(10.0).alias("size")),
                 fan(p.select("node", F.explode("cited_authors").alias("cited_author")), "cited_author", "cited_author")):
        out = out.unionByName(rows)
    return out


def ego(papers: DataFrame, paper_id: str) -> DataFrame:
    """K1: the edges of one paper, outwards, with its DOI as written."""
    one = papers.where(F.col("paper_id") == paper_id).withColumn("node", node_id(F.col("doi"), F.col("paper_id"), lower=False))
    to = lambda rows, kind, label: rows.select(F.col("node").alias("src"), F.concat(F.lit(kind + ":"), "x").alias("dst"), F.lit(label).alias("label"))
    t = one.select("node", F.explode("topics").alias("t"))
    cited = one.select("node", F.explode("citations").alias("c")).select("node", F.trim("c.title").alias("title")).withColumn("key", F.lower("title")).join(title_index(papers), "key", "left")
    return (to(one.select("node", F.explode("authors").alias("x")), "author", "authored_by")
            .unionByName(to(t.select("node", F.col("t.category").alias("x")), "category", "in_category"))
            .unionByName(to(t.select("node", F.col("t.label").alias("x")), "topic", "has_topic"))
            .unionByName(cited.select(F.col("node").alias("src"), F.coalesce("hit", F.concat(F.lit("paper:"), F.substring("title", 1, 50))).alias("dst"), F.lit("cites").alias("label")))
            .unionByName(to(one.select("node", F.explode("cited_authors").alias("x")), "cited_author", "cites_work_by")).distinct())


def metrics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """E26."""
    n = node_rows.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "paper").alias("papers"), F.count_if(F.col("kind") == "author").alias("authors"))
    return n.crossJoin(F.broadcast(edge_rows.agg(F.count("*").alias("edges"))))  # a row each


def corpus_rows(papers: DataFrame) -> DataFrame:
    """Papers as flat rows, lists joined, citations as JSON."""
    return papers.select(
        "paper_id", F.coalesce("title", F.lit("")).alias("title"), F.array_join("authors", "; ").alias("authors"), F.coalesce(F.size("authors"), F.lit(0)).alias("n_authors"), F.coalesce("doi", F.lit("")).alias("DOI"),
        F.to_json("citations").alias("citations"), F.greatest(F.coalesce("n_citations", F.lit(0)), F.coalesce(F.size("citations"), F.lit(0))).alias("n_citations"),
        F.array_join(F.transform("citations", lambda c: c["title"]), "; ").alias("cited_titles"), F.array_join("cited_authors", "; ").alias("cited_authors"))


def tei_metadata(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Title, authors, abstract, keywords, DOI, journal, date and cited titles of TEI XML; missing ones are ''."""
    at = lambda name, *more: "".join(f"/*[local-name()='{n}']" for n in (name, *more))
    head = "//*[local-name()='teiHeader']"
    one = lambda path: F.coalesce(F.trim(F.xpath_string(F.col(xml), F.lit(path))), F.lit(""))
    many = lambda path: F.xpath(F.col(xml), F.lit(path + "/text()"))
    author = head + "//*[local-name()='sourceDesc']//*[local-name()='analytic']" + at("author") + at("persName")
    names = F.zip_with(many(author + at("forename") + "[1]"), many(author + at("surname")), lambda f, s: F.concat_ws(" ", f, s))
    return docs.withColumns({
        "title": one(head + "//*[local-name()='titleStmt']" + at("title")), "authors": names, "abstract": one("//*[local-name()='abstract']"),
        "keywords": many(head + "//*[local-name()='keywords']//*[local-name()='term']"), "doi": one(head + "//*[local-name()='idno' and @type='DOI']"),
        "journal": one(head + "//*[local-name()='monogr']" + at("title")), "date": one(head + "//*[local-name()='publicationStmt']" + at("date") + "/@when"),
        "cited_titles": many("//*[local-name()='listBibl']" + at("biblStruct") + "//*[local-name()='analytic']" + at("title"))})
