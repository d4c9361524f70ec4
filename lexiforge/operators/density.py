"""Density clusters with outliers: core distances, a minimum spanning forest, the condensed tree, and clusters by stability.

Links are ordered by ``(w, a, b)``, so no two are equal and every step has one result. A cluster is known by its smallest
row while it grows, a node of the condensed tree by the link that formed it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut
from .neighbours import neighbour_lists, usable

#: Rows nearer than this count as this far apart, so that densities are finite.
NEAREST = 1e-9
#: Links of the forest that one task takes: it merges them in order, knowing what all smaller ones joined.
BLOCK = 50_000


def reachability(neighbours: DataFrame, samples: int) -> DataFrame:
    """Links ``(a, b, w)`` of neighbour lists: the distance, at least the core distance of either end (to the ``samples``-th neighbour, or the last)."""
    core = neighbours.where(F.col("rank") <= samples).groupBy("id").agg(F.max("distance").alias("core"))
    pairs = neighbours.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("distance").alias("d"))
    ends = pairs.join(core.toDF("a", "core_a"), "a").join(core.toDF("b", "core_b"), "b")
    return ends.select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("e"))


def _least(edges: DataFrame) -> DataFrame:
    """Each cluster's least link ``e`` and where it leads (``o``)."""
    ends = edges.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "e").unionByName(edges.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "e"))
    return ends.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m")).select("c", "m.o", "m.e")


def _moved(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Links between the clusters that ``to(c, to)`` leads to, the least one of each two."""
    out = edges.join(to.toDF("ca", "na"), "ca").join(to.toDF("cb", "nb"), "cb").where("na <> nb")
    return out.groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb")).agg(F.min("e").alias("e"))


def spanning_forest(links: DataFrame) -> DataFrame:
    """The minimum spanning forest of links ``(a, b, w)``: in each round every cluster takes its least link, then clusters that met are one."""
    rest, kept = cut(_edges(links.where("a <> b"))), None
    pair = F.count("*").over(W.partitionBy("e")) == 2
    while not rest.isEmpty():
        best = cut(_least(rest).withColumn("to", F.when(pair & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o"))))
        picked = best.select("e").distinct()
        kept = picked if kept is None else kept.unionByName(picked)
        to = best.select("c", "to")
        while True:
            on = cut(to.join(to.toDF("to", "further"), "to").select("c", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
            to = on.select("c", "to")
            if on.where("moved").isEmpty():
                break
        rest = cut(_moved(rest, to))
    return rest.select("e.*").select("a", "b", "w") if kept is None else kept.select("e.*").select("a", "b", "w")


def _joined(links: DataFrame) -> DataFrame:
    """Components of links ``(part, ca, cb)`` within each part: ``(part, c, to)``, ``to`` the smallest; every other one has a row.

    Large-star and small-star steps: links are turned to the smallest neighbour until they stand still.
    """
    edges, seen = cut(links.select("part", F.greatest("ca", "cb").alias("u"), F.least("ca", "cb").alias("v")).where("u > v").distinct()), None
    while True:
        both = edges.unionByName(edges.select("part", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("part", "u").agg(F.min("v").alias("m")).select("part", "u", F.least("u", "m").alias("m"))
        large = both.join(low, ["part", "u"]).where("v > u").select("part", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("part", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["part", "u"]).where("v <> m").select("part", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("part", "u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("part", "u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select("part", F.col("u").alias("c"), F.col("v").alias("to"))
        seen = now


def _dealt(points: DataFrame, forest: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links ``(chunk, w, a, b, ca, cb)`` in chunks by order, their ends the clusters ``(chunk, c, n)`` that all links of smaller chunks make.

    Also rows ``(chunk, c, id)``: the only chunk in which a row can come to ``least`` rows, and its cluster before. All links are halved, and halved again: the first half joins its ends for the second, for all halves of a round at once.
    """
    chunks = max(1, math.ceil(forest.count() / BLOCK))
    edges = forest.select("w", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    edges = cut(edges.repartitionByRange(chunks, "w", "a", "b").withColumn("chunk", F.spark_partition_id()))
    chunks = (edges.agg(F.max("chunk")).first()[0] or 0) + 1
    sizes = points.select(F.lit(0).alias("part"), F.col("id").alias("c"), F.lit(1).cast("long").alias("n"))
    member = points.select(F.lit(0).alias("part"), F.col("id").alias("c"), "id")
    for bits in reversed(range((chunks - 1).bit_length())):
        half = F.shiftright("chunk", bits)
        edges = edges.withColumn("part", F.shiftright(half, 1))
        to = _joined(edges.where(half % 2 == 0))
        late = edges.where(half % 2 == 1)
        for c in ("ca", "cb"):
            late = late.join(to.select("part", F.col("c").alias(c), "to"), ["part", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges = cut(edges.where(half % 2 == 0).unionByName(late).drop("part"))
        grown = sizes.join(to, ["part", "c"], "left").groupBy("part", F.coalesce("to", "c").alias("c")).agg(F.sum("n").alias("n"))
        grown = cut(grown)
        member = member.join(to, ["part", "c"], "left").withColumn("to", F.coalesce("to", "c")).join(grown.withColumnsRenamed({"c": "to", "n": "now"}), ["part", "to"])
        stays = F.col("now") >= least
        member = cut(member.select((F.col("part") * 2 + F.when(stays, 0).otherwise(1)).alias("part"), F.when(stays, F.col("c")).otherwise(F.col("to")).alias("c"), "id"))
        sizes = sizes.withColumn("part", F.col("part") * 2).unionByName(grown.withColumn("part", F.col("part") * 2 + 1))
        ends = edges.select(half.alias("part"), F.explode(F.array("ca", "cb")).alias("c")).distinct()
        sizes = cut(sizes.join(ends, ["part", "c"], "left_semi"))
    return edges, sizes.withColumnRenamed("part", "chunk"), member.withColumnRenamed("part", "chunk")


_EVENTS = "chunk int, kind string, node string, w double, a long, b long, c long, l string, lc long, r string, rc long, n long"


def _merged(least: int):
    def run(links: pd.DataFrame) -> pd.DataFrame:
        """Merges of one chunk in order. A cluster that was large before has a node not known here, so it is named (``lc``, ``rc``) instead."""
        links = links.sort_values(["w", "a", "b"])
        chunk, up, size, node, out, rows = int(links["chunk"].iloc[0]), {}, {}, {}, [], {}

        def root(c):
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        def seen(c, n):
            if c not in up:
                up[c], size[c], rows[c], node[c] = c, n, [c] if n < least else [], (None, c)
            return root(c)

        def leave(c, to, e):
            out.extend((chunk, "row", None, *e, x, to[0], to[1], None, None, 0) for x in rows.pop(c))
            rows[c] = []

        for w, a, b, ca, cb, na, nb in links[["w", "a", "b", "ca", "cb", "na", "nb"]].itertuples(index=False, name=None):
            x, y = sorted((seen(ca, na), seen(cb, nb)))
            e, total, large = (w, a, b), size[x] + size[y], [c for c in (x, y) if size[c] >= least]
            name = (f"{a}-{b}", None)
            if len(large) == 2:
                out.append((chunk, "node", name[0], *e, x, *node[x], *node[y], total))
                kept = name
            elif large:
                kept = node[large[0]]
                leave(x + y - large[0], kept, e)
            elif total >= least:
                out.append((chunk, "node", name[0], *e, x, None, None, None, None, 0))
                kept = name
                leave(x, kept, e)
                leave(y, kept, e)
            else:
                kept = None, None
                few, many = sorted((rows[x], rows[y]), key=len)
                many.extend(few)
                rows[x] = many
            up[y], size[x], node[x] = x, total, kept
        out += [(chunk, "last", node[c][0], None, None, None, c, None, node[c][1], None, None, 0) for c in up if up[c] == c and size[c] >= least and node[c] != (None, c)]
        table = pd.DataFrame(out, columns=[f.split()[0] for f in _EVENTS.split(", ")])
        return table.astype({c: "Int64" for c in ("a", "b", "c", "lc", "rc", "n")} | {"w": "Float64"})

    return run


def condensed(points: DataFrame, forest: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The condensed tree of a forest over ``points(id)``: nodes of ``least`` rows or more, and where rows leave.

    Returns nodes ``(node, e, l, r, inner)`` (formed by link ``e``; of two nodes with ``inner`` rows, or of rows and smaller groups) and
    rows ``(id, node, t)`` (``t``: the link from which on a row belongs to the node). Chunks of links are merged side by side; a cluster's name
    is its smallest row, and a node that a chunk doesn't know is the last one of that name in the chunks before.
    """
    edges, sizes, member = _dealt(points, forest, least)
    for c, n in (("ca", "na"), ("cb", "nb")):
        edges = edges.join(sizes.select("chunk", F.col("c").alias(c), F.col("n").alias(n)), ["chunk", c])
    events = cut(edges.groupBy("chunk").applyInPandas(_merged(least), _EVENTS))
    asked = events.select("chunk", F.explode(F.array("lc", "rc")).alias("c")).where("c is not null").distinct()
    last = events.where("kind = 'last'").select(F.col("chunk").alias("then"), "c", "node", F.col("lc").alias("of"))
    known = asked.join(last, "c").where("then < chunk").groupBy("chunk", "c").agg(F.max_by(F.struct("node", "then", "of"), "then").alias("k"))  # at most a row for each two chunks before
    known = cut(known.select("chunk", "c", F.col("k.node").alias("known"), F.when(F.col("k.node").isNull(), F.col("k.then")).alias("then"), "k.of"))
    while not known.where("then is not null").isEmpty():  # where a smaller row had joined, the name before is asked for
        on = known.select(F.col("chunk").alias("then"), F.col("c").alias("of"), F.col("known").alias("found"), F.col("then").alias("before"), F.col("of").alias("name"))
        known = cut(known.join(on, ["then", "of"], "left").select("chunk", "c", F.coalesce("known", "found").alias("known"), F.col("before").alias("then"), F.col("name").alias("of")))
    for side in "lr":
        own = known.select("chunk", F.col("c").alias(f"{side}c"), F.col("known").alias(f"{side}k"))
        events = events.join(own, ["chunk", f"{side}c"], "left").withColumn(side, F.coalesce(side, f"{side}k"))
    e = F.struct("w", "a", "b")
    nodes = events.where("kind = 'node'").select("node", e.alias("e"), "l", "r", F.col("n").alias("inner"))
    gone = events.where("kind = 'row'").select("chunk", "c", F.col("l").alias("node"), e.alias("t"))
    return nodes, member.join(gone, ["chunk", "c"]).select("id", "node", "t")


def _density(e):
    return 1 / F.greatest(e["w"], F.lit(NEAREST))


def _best(tree: DataFrame) -> DataFrame:
    """Each node's ``(node, best)``: the greater of ``own`` and its two nodes' sum.

    A node is ``max(a, b + x + y)`` of nodes it waits for. In each round known ones are added, and one that waits for one that waits
    for one takes its place, so that rounds grow with the logarithm of the nodes.
    """
    state = tree.select("node", F.col("own").alias("a"), F.lit(0.0).alias("b"), F.col("l").alias("x"), F.col("r").alias("y"))
    while not state.where("x is not null").isEmpty():
        now = state
        for side in "xy":
            now = now.join(state.select(*[F.col(c).alias(n) for c, n in zip(("node", "a", "b", "x", "y"), (side, f"{side}a", f"{side}b", f"{side}x", f"{side}y"))]), side, "left")
        known = lambda v: F.when(F.col(v).isNotNull() & F.col(f"{v}x").isNull(), F.greatest(f"{v}a", f"{v}b"))
        rest = F.array_compact(F.array(F.when(F.col("xx").isNotNull(), F.col("x")), F.when(F.col("yx").isNotNull(), F.col("y"))))
        chain = F.col("y").isNull() & F.col("xx").isNotNull() & F.col("xy").isNull()
        state = cut(now.select("node", F.when(chain, F.greatest("a", F.col("b") + F.col("xa"))).otherwise(F.col("a")).alias("a"),
                               F.when(chain, F.col("b") + F.col("xb")).otherwise(F.col("b") + F.coalesce(known("x"), F.lit(0.0)) + F.coalesce(known("y"), F.lit(0.0))).alias("b"),
                               F.when(chain, F.col("xx")).otherwise(F.get(rest, F.lit(0))).alias("x"), F.when(~chain, F.get(rest, F.lit(1))).alias("y")))
    return state.select("node", F.greatest("a", "b").alias("best"))


def selected(nodes: DataFrame, left: DataFrame) -> DataFrame:
    """Rows ``(id, node, strength)`` of the nodes with the greatest excess of mass; rows of none are left out."""
    up = nodes.select(F.explode(F.array("l", "r")).alias("node"), F.col("node").alias("up"), F.col("e").alias("ue")).where("node is not null")
    mass = left.groupBy("node").agg(F.count("*").alias("n"), F.sum(_density(F.col("t"))).alias("mass"))
    born = F.when(F.col("up").isNull(), F.lit(0.0)).otherwise(_density(F.col("ue")))
    own = F.col("mass") - F.col("n") * born + F.col("inner") * (_density(F.col("e")) - born)
    tree = cut(nodes.join(up, "node", "left").join(mass, "node", "left").fillna(0, ["n", "mass"]).withColumn("own", own))
    only = tree.where("up is null").count() == 1
    best = cut(_best(tree))
    sums = tree
    for side in "lr":
        sums = sums.join(best.select(F.col("node").alias(side), F.col("best").alias(f"{side}b")), side, "left")
    may = F.lit(not only) | F.col("up").isNotNull()
    keep = may & (F.col("own") >= F.coalesce("lb", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0)))
    # The highest kept node at or above each node, by doubled steps.
    top = cut(sums.select("node", F.col("up").alias("above"), F.when(keep, F.col("node")).alias("top")))
    while not top.where("above is not null").isEmpty():
        ahead = top.select(F.col("node").alias("above"), F.col("above").alias("on"), F.col("top").alias("higher"))
        top = cut(top.join(ahead, "above", "left").select("node", F.col("on").alias("above"), F.coalesce("higher", "top").alias("top")))
    chosen = top.where("top is not null").select("node", "top").join(tree.select(F.col("node").alias("top"), "e"), "top")
    full = _density(F.col("e"))
    return left.join(chosen, "node").select("id", F.col("top").alias("node"), (F.least(_density(F.col("t")), full) / full).alias("strength"))


def density_clusters(points: DataFrame, least: int = 10, samples: int | None = None, links: int | None = None, id_col: str = "vec_id", vector: str = "embedding", neighbours: DataFrame | None = None) -> DataFrame:
    """``(id, cluster, strength)`` of each id: a cluster's smallest id, or -1 for outliers (strength 0).

    Links are those of the ``links`` nearest neighbours (default: 30, or twice ``samples``), or of given lists; parts that
    no link joins are joined at no density, and a single whole isn't a cluster. With all neighbours as links the tree is
    that of all pairs. Rows without a usable vector are outliers, rows that share an id count once (their smallest
    vector), an empty table gives no rows; equal rows count as 1e-9 apart. ``least`` is 2 at least, ids aren't negative.
    """
    if least < 2:
        raise ValueError("a cluster has two rows at least")
    samples = samples or least
    if neighbours is None:
        neighbours = neighbour_lists(points, links or max(30, 2 * samples), id_col, vector)
    rows = cut(usable(points, id_col, vector).select("id"))
    nodes, left = condensed(rows, spanning_forest(reachability(cut(neighbours), samples)), least)
    found = cut(selected(cut(nodes), cut(left)))
    names = found.groupBy("node").agg(F.min("id").alias("cluster"))
    found = found.join(names, "node").select("id", "cluster", "strength")
    every = points.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    return every.join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
