"""Degrees, distances, PageRank, colour refinement and edge weights over triples.

Nodes are heads and tails; a null one has no edges. Repeated triples count in degrees and edge weights and make one edge
elsewhere; loops are no edges of the undirected graph. Ties go to the smaller name. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import dropped, staged


def edges(triples: DataFrame) -> DataFrame:
    return triples.select("h", "t").distinct()


def neighbours(triples: DataFrame) -> DataFrame:
    """Undirected edges without loops, in both directions, once each: (a, b)."""
    both = F.explode(F.array(F.struct(F.col("h").alias("a"), F.col("t").alias("b")), F.struct(F.col("t").alias("a"), F.col("h").alias("b"))))
    return triples.where("h <> t").select(both.alias("x")).select("x.a", "x.b").distinct()


def degrees(triples: DataFrame) -> DataFrame:
    """Number of triples that name each entity; a loop counts twice."""
    return triples.select(F.explode(F.array("h", "t")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_anchors(triples: DataFrame, k: int) -> DataFrame:
    """The k entities of greatest degree (ties by name)."""
    return degrees(triples).orderBy(F.desc("degree"), "node").limit(k)


def degree_moments(triples: DataFrame) -> DataFrame:
    """Number, extremes, mean and sample variance of the number of distinct tails of a head and relation."""
    n = triples.select("h", "r", "t").distinct().groupBy("h", "r").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("nobs"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.var_samp("n").alias("variance"))


def distances(triples: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """Least number of undirected steps (at most ``hops``) from any of ``sources`` (node). The frontier alone is joined in each step."""
    steps = staged(neighbours(triples))
    seen = frontier = sources.select("node").distinct().withColumn("distance", F.lit(0))
    for d in range(1, hops + 1):
        reached = frontier.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = staged(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def anchor_distances(triples: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(node, anchor, distance) of every anchor (node) within ``hops`` undirected steps of a node."""
    steps = staged(neighbours(triples))
    seen = frontier = staged(anchors.select("node", F.col("node").alias("anchor")).distinct().withColumn("distance", F.lit(0)))
    for d in range(1, hops + 1):
        reached = frontier.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "anchor").distinct()
        frontier = staged(reached.join(seen, ["node", "anchor"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def nearest_anchors(triples: DataFrame, anchors: DataFrame, hops: int, k: int) -> DataFrame:
    """The k nearest anchors of every node that reaches one (ties by name), as a comma-joined text in order."""
    found = top_per_group(anchor_distances(triples, anchors, hops), ["node"], ["distance", "anchor"], k)
    return found.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "anchor"))), lambda x: x["anchor"]), ",").alias("anchors"))


def walk_returns(triples: DataFrame, steps: int) -> DataFrame:
    """(node, step, probability) that an even random walk over undirected edges is back at its node, up to ``steps`` steps; zeros left out."""
    near = neighbours(triples)
    moves = staged(near.withColumn("p", 1 / F.count("*").over(Window.partitionBy("a"))))
    at = moves.select(F.col("a").alias("node"), F.col("b").alias("at"), "p")
    out = at.where("node = at").select("node", F.lit(1).alias("step"), F.col("p").alias("probability"))
    for k in range(2, steps + 1):
        nxt = moves.select(F.col("a").alias("at"), F.col("b").alias("to"), F.col("p").alias("q"))
        at = staged(at.join(nxt, "at").groupBy("node", "to").agg(F.sum(F.col("p") * F.col("q")).alias("p")).withColumnRenamed("to", "at"))
        out = out.unionByName(at.where("node = at").select("node", F.lit(k).alias("step"), F.col("p").alias("probability")))
    return out


#: Rows that one round of shuffles may hold, and the most rounds: beyond, the share of a round is fixed and its rows grow with the graph.
_ROUND_ROWS, _ROUNDS = 48_000_000, 8
#: Relations told apart by ``_triangle_kinds``; the rest count as one.
_RELATIONS = 30


def _rounds(rows: int) -> int:
    return max(1, min(_ROUNDS, -(-rows // _ROUND_ROWS)))


def _in_rounds(n: int, make: Callable[[Callable[..., Column]], DataFrame]) -> DataFrame:
    """The rows of n rounds, each a table before the next begins: ``make`` gets what tells whether columns belong to a round."""
    return reduce(DataFrame.unionByName, (staged(make(lambda *c, k=k: F.pmod(F.xxhash64(*c), F.lit(n)) == k)) for k in range(n)))


def _triangle_kinds(together: list[int]) -> int:
    """The kinds (as bits) of edges that can be a triangle's side, given the kinds that stand at one node together with each kind.

    A kind is a relation as seen from one end; its opposite lies half the bits away. A triangle's two sides at each node stand
    there together, so a kind without two others that do so at all three nodes is in none.
    """
    n, half = len(together), len(together) // 2
    co = np.array([[x >> j & 1 for j in range(n)] for x in together], np.int64)
    other = [(i + half) % n for i in range(n)]
    # from a along p to b and q to c, and from b along s to c
    ways = co @ co[np.ix_(other, other)] @ co.T  # q at a's side, s at b's side, by (p, opposite of p)
    return sum(1 << p for p in range(n) if ways[p, other[p]] > 0)


def walk_returns_by_triangles(triples: DataFrame) -> DataFrame:
    """``walk_returns`` of up to three steps without pairs of nodes: a step there and back over each edge, and both ways round each triangle.

    Edges of relations that can close no triangle are left out of the search for triangles, and these are found from their node of
    the least degree, so a hot node's neighbours are never paired with each other. Large graphs go in rounds, each with a part of
    the nodes, so only a part of the edges is ever shuffled at once.
    """
    half = _RELATIONS + 1
    names = [r.r for r in triples.select("r").where("r is not null").distinct().orderBy("r").limit(_RELATIONS).collect()]
    relation = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("r")), F.lit(0)) if names else F.lit(0)
    bit = (relation + F.when(F.col("h") < F.col("t"), 0).otherwise(half)).cast("int")
    pairs = triples.where("h <> t").select(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("kind"))
    edge = _in_rounds(_rounds(triples.count()), lambda mine: pairs.where(mine("a", "b")).groupBy("a", "b").agg(F.bit_or("kind").alias("kind")))
    n = _rounds(2 * edge.count())
    turned = F.shiftright("kind", half).bitwiseOR(F.call_function("shiftleft", F.col("kind").bitwiseAND(F.lit((1 << half) - 1)), F.lit(half)))

    def ends(mine: Callable[..., Column]) -> DataFrame:
        there = edge.where(mine("a")).select(F.col("a").alias("node"), F.col("b").alias("other"), "kind")
        return there.unionByName(edge.where(mine("b")).select(F.col("b").alias("node"), F.col("a").alias("other"), turned.alias("kind")))

    node = _in_rounds(n, lambda mine: ends(mine).groupBy("node").agg(F.count("*").alias("d"), F.bit_or("kind").alias("kinds")))
    known = node.select(F.col("node").alias("other"), F.col("d").alias("od"))

    def returned(mine: Callable[..., Column]) -> DataFrame:
        sums = ends(mine).select("node", "other").join(known, "other").groupBy("node").agg(F.sum(1 / F.col("od")).alias("s"))
        return sums.join(node.where(mine("node")).select("node", "d"), "node").select("node", (F.col("s") / F.col("d")).alias("probability"))

    back = _in_rounds(n, returned)
    has = lambda i: F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0
    together = [x or 0 for x in node.agg(*(F.bit_or(F.when(has(i), F.col("kinds"))).alias(f"k{i}") for i in range(2 * half))).first()]
    kept = edge.where(F.col("kind").bitwiseAND(F.lit(_triangle_kinds(together)).cast("long")) != 0).select("a", "b")
    degree = lambda c: node.select(F.col("node").alias(c), F.col("d").alias(f"d{c}"))
    sides = staged(kept.join(degree("a"), "a").join(degree("b"), "b"))
    dropped(edge)
    dropped(node)
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    up = sides.select(pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("da", "db").alias("du"), pick("db", "da").alias("dv"))
    wedges = up.join(up.select("u", F.col("v").alias("w"), F.col("dv").alias("dw")), "u").where("v < w")
    closed = wedges.join(sides.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    round_ = closed.select(F.explode(F.array("u", "v", "w")).alias("node"), (2 / (F.col("du") * F.col("dv") * F.col("dw"))).alias("p")).groupBy("node").agg(F.sum("p").alias("probability"))
    return back.select("node", F.lit(2).alias("step"), "probability").unionByName(round_.select("node", F.lit(3).alias("step"), "probability"))


def pagerank(triples: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """PageRank over distinct directed edges after a fixed number of rounds; what dangling nodes hold is spread evenly."""
    links = edges(triples)
    out = links.groupBy("h").agg(F.count("*").alias("out"))
    links = staged(links.join(out, "h"))
    nodes = staged(triples.select(F.explode(F.array("h", "t")).alias("node")).distinct().join(out.withColumnRenamed("h", "node"), "node", "left"))
    n = nodes.count()
    rank = nodes.select("node", "out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        given = rank.where("out is not null").select(F.col("node").alias("h"), "rank").join(links, "h").groupBy(F.col("t").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = rank.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = nodes.join(given, "node", "left").crossJoin(F.broadcast(lost)).select("node", "out", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.lit(max(n, 1)))).alias("rank"))
        # a round reads its ranks twice, so each is a table
        rank = staged(rank)
        if k:
            dropped(before)
        before = rank
    return rank.select("node", "rank")


def random_anchors(triples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The k entities that a hash puts first: (node)."""
    return triples.select(F.explode(F.array("h", "t")).alias("node")).where("node is not null").distinct().orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(k)


def rank_anchors(triples: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """The k entities of the highest PageRank (ties by name): (node)."""
    return pagerank(triples, rounds).orderBy(F.desc("rank"), "node").limit(k).select("node")


def mixed_anchors(triples: DataFrame, shares: dict[str, float], k: int, seed: int = 0) -> DataFrame:
    """k anchors chosen in turn by ways ("degree", "rank", "random") with shares of k; each way passes over what those before it chose, and the last fills up."""
    left, found = k, None
    for i, (way, share) in enumerate(shares.items()):
        n = left if i == len(shares) - 1 else min(left, round(share * k))
        # each way is asked for enough to make up for those that are taken
        asked = {"degree": lambda m: degree_anchors(triples, m).select("node", (-F.col("degree")).cast("double").alias("at")), "rank": lambda m: pagerank(triples).orderBy(F.desc("rank"), "node").limit(m).select("node", (-F.col("rank")).alias("at")), "random": lambda m: random_anchors(triples, m, seed).select("node", F.xxhash64(F.lit(seed), "node").cast("double").alias("at"))}[way](k)
        if found is not None:
            asked = asked.join(found, "node", "left_anti")
        chosen = staged(asked.orderBy("at", "node").limit(n).select("node"))
        found = chosen if found is None else found.unionByName(chosen)
        left -= n
    return found


def anchor_pageranks(triples: DataFrame, anchors: DataFrame, rounds: int = 3, damping: float = 0.85, least: float = 0.0) -> DataFrame:
    """(anchor, node, rank): PageRank over undirected edges that restarts at each anchor (node), after some rounds; ranks of ``least`` or less are left out of the next round.

    All anchors' walks go together, a row for each node that one has reached.
    """
    near = neighbours(triples)
    edge = staged(near.join(near.groupBy("a").agg(F.count("*").alias("d")), "a"))
    start = staged(anchors.select(F.col("node").alias("anchor")).distinct().withColumn("node", F.col("anchor")).withColumn("rank", F.lit(1.0)))
    found = start
    for _ in range(rounds):
        moved = found.join(edge, F.col("node") == F.col("a")).select("anchor", F.col("b").alias("node"), (F.lit(damping) * F.col("rank") / F.col("d")).alias("rank"))
        back = start.select("anchor", "node", F.lit(1 - damping).alias("rank"))
        found = staged(moved.unionByName(back).groupBy("anchor", "node").agg(F.sum("rank").alias("rank")).where(F.col("rank") > least))
    return found


def sampled_tokens(triples: DataFrame, k: int, seed: int = 0, padding: str = "") -> DataFrame:
    """(node, tokens): k relations of every entity, incoming ones marked, that a hash puts first, in its order; entities of fewer have padding behind."""
    token = F.explode(F.array(F.struct(F.col("h").alias("node"), F.col("r").alias("token")), F.struct(F.col("t").alias("node"), F.concat("r", F.lit("_inverse")).alias("token"))))
    each = triples.select(token.alias("x")).select("x.node", "x.token").distinct()
    best = top_per_group(each.withColumn("u", F.xxhash64(F.lit(seed), "node", "token")), ["node"], ["u", "token"], k)
    held = best.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "token"))), lambda x: x["token"]).alias("x"))
    return held.select("node", F.concat("x", F.array_repeat(F.lit(padding), F.lit(k) - F.size("x"))).alias("tokens"))


def colours(triples: DataFrame, rounds: int = 2) -> DataFrame:
    """Weisfeiler-Lehman colours (node, colour) after some rounds: md5 of a node's colour and the sorted counts of its neighbours' colours; at first its degree."""
    near = staged(neighbours(triples))
    found = near.groupBy(F.col("a").alias("node")).agg(F.count("*").cast("string").alias("colour"))
    for _ in range(rounds):
        seen = near.join(found.select(F.col("node").alias("b"), F.col("colour").alias("c")), "b").groupBy(F.col("a").alias("node"), "c").agg(F.count("*").alias("n"))
        around = seen.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "c", F.col("n").cast("string")))), ",").alias("around"))
        found = found.join(around, "node").select("node", F.md5(F.concat_ws("|", "colour", "around")).alias("colour"))
    return found


def colour_classes(triples: DataFrame, rounds: int = 2) -> DataFrame:
    return colours(triples, rounds).groupBy("colour").agg(F.count("*").alias("nodes"))


def edge_weights(triples: DataFrame) -> DataFrame:
    """Every triple's inverse in-degree of the tail, inverse out-degree of the head, and symmetric weight."""
    into = triples.groupBy("t").agg(F.count("*").alias("i"))
    out = triples.groupBy("h").agg(F.count("*").alias("o"))
    found = triples.join(into, "t").join(out, "h")
    return found.select("h", "r", "t", (1 / F.col("i")).alias("inverse_in"), (1 / F.col("o")).alias("inverse_out"), (1 / F.sqrt(F.col("i") * F.col("o"))).alias("symmetric"))


def relation_tokens(triples: DataFrame) -> DataFrame:
    """Every entity's incident relations, incoming ones marked, as a sorted comma-joined text."""
    token = F.explode(F.array(F.struct(F.col("h").alias("node"), F.col("r").alias("token")), F.struct(F.col("t").alias("node"), F.concat("r", F.lit("_inverse")).alias("token"))))
    return triples.select(token.alias("x")).select("x.node", "x.token").groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("token")), ",").alias("tokens"))


def top_per_group(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= k)
