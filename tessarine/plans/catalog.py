"""Every registered knowledge-graph query with the SQL that states the same result.

The graph is derived from the star-schema tables (``graph_tables.star_triples``); vectors come from the table
embeddings, labels and scores from documents and labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interactions, losses
from ..operators import alignment, analysis, classification, encode, graph, negatives, ranking, relational, splitting, training
from ..operators.components import connected_components
from ..sources.graph_tables import literal_matrix, repeated_star_triples, star_triples, star_triples_sql
from ..sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIM = 64
_KG = f"kg AS ({star_triples_sql()})"


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums of floats depend on their order beyond that."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: _rounded(make(spark, d))
    if sql is not None:
        ORACLES[name] = sql


#: Queries that read the triples three times or more: they are written once, as their derivation shuffles nine tables.
_REUSED = {
    "relation_functionality", "relation_injectivity", "relation_cardinality_types", "symmetry_patterns", "inversion_patterns", "composition_patterns", "pattern_skyline", "jaccard_relations", "jaccard_inverse_relations",
    "leaking_relations", "unleaked_triples", "bernoulli_probabilities", "pseudo_type_index", "dictionary_encode", "dictionary_round_trip", "inverse_triples", "condense", "candidate_set_size", "fixed_model_filtered_ranks",
    "rank_metrics", "macro_rank_metrics", "all_rank_metrics", "rank_dispersion", "rank_z_scores", "bootstrap_mrr", "marginal_baseline_scores", "pagerank", "soft_inverse_scores", "pattern_types", "graph_info", "rank_anchors", "basic_negatives", "bernoulli_negatives", "pseudo_typed_negatives",
}

#: Queries to whose operators repeated triples make no difference: the shuffle that would tell them apart is left out.
_REPEATS = {"graph_walk_returns", "distmult_training"}


def _kg(name: str, make: Callable[[DataFrame], DataFrame], select: str | None = None, ctes: str = "") -> None:
    """A query over the triples; ``ctes`` and ``select`` state it over ``kg``."""
    recursive = "RECURSIVE " if "UNION" in ctes else ""
    triples = (lambda spark, d: staged(star_triples(spark, d))) if name in _REUSED else repeated_star_triples if name in _REPEATS else star_triples
    _add(name, lambda spark, d: make(triples(spark, d)), f"WITH {recursive}{_KG}{', ' + ctes if ctes else ''} {select}" if select else None)


# counts and statistics of relations and entities
_ENDS = "ends AS (SELECT h AS entity, 'head' AS position, r FROM kg UNION ALL SELECT t, 'tail', r FROM kg)"
_kg("relation_counts", analysis.relation_counts, 'SELECT r, count(*) AS "count" FROM kg GROUP BY r')
_kg("entity_counts", analysis.entity_counts, 'SELECT entity, position, count(*) AS "count" FROM ends GROUP BY ALL', _ENDS)
_kg("entity_relation_cooccurrence", analysis.entity_relation_counts, 'SELECT entity, r, position, count(*) AS "count" FROM ends GROUP BY ALL', _ENDS)
_kg("relation_functionality", analysis.functionality, "SELECT r, round(count(DISTINCT h) / count(*), 6) AS functionality, round(count(DISTINCT t) / count(*), 6) AS inverse_functionality FROM kg GROUP BY r")
_INJ = """inj AS (
  SELECT r, n1 + n2 AS support, hi AS head_injective, ti AS tail_injective FROM
  (SELECT r, count(*) AS n1, avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0 END) AS hi FROM (SELECT r, h, count(*) AS n FROM kg GROUP BY r, h) GROUP BY r) JOIN
  (SELECT r, count(*) AS n2, avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0 END) AS ti FROM (SELECT r, t, count(*) AS n FROM kg GROUP BY r, t) GROUP BY r) USING (r))"""
_kg("relation_injectivity", analysis.injectivity, "SELECT r, support, round(head_injective, 6) AS head_injective, round(tail_injective, 6) AS tail_injective FROM inj", _INJ)
_kg("relation_cardinality_types", analysis.cardinality_types, """SELECT r, support, relation_type, round(confidence, 6) AS confidence FROM (
  SELECT r, support, 'one-to-one' AS relation_type, tail_injective * head_injective AS confidence FROM inj UNION ALL SELECT r, support, 'one-to-many', tail_injective * (1 - head_injective) FROM inj
  UNION ALL SELECT r, support, 'many-to-one', (1 - tail_injective) * head_injective FROM inj UNION ALL SELECT r, support, 'many-to-many', (1 - tail_injective) * (1 - head_injective) FROM inj) WHERE confidence > 0""", _INJ)
_SYM = "sym AS (SELECT a.r, count(*) AS support, count(b.h) AS hits FROM kg a LEFT JOIN kg b ON a.h = b.t AND a.t = b.h AND a.r = b.r GROUP BY a.r)"
_kg("symmetry_patterns", analysis.symmetry, "SELECT r, 'symmetry' AS pattern, support, round(hits / support, 6) AS confidence FROM sym UNION ALL SELECT r, 'anti-symmetry', support, round(1 - hits / support, 6) FROM sym", _SYM)
_INV = "inv AS (SELECT a.r, b.r AS inverse, count(*) AS hits FROM kg a JOIN kg b ON a.h = b.t AND a.t = b.h WHERE a.r <> b.r GROUP BY ALL), n AS (SELECT r, count(*) AS support FROM kg GROUP BY r)"
_kg("inversion_patterns", analysis.inversion, "SELECT r, inverse, support, round(hits / support, 6) AS confidence FROM inv JOIN n USING (r)", _INV)
_COMP = """path AS (SELECT DISTINCT a.r AS r1, b.r AS r2, a.h AS x, b.t AS z FROM kg a JOIN kg b ON a.t = b.h), s AS (SELECT r1, r2, count(*) AS support FROM path GROUP BY ALL),
  c AS (SELECT r1, r2, kg.r, count(*) AS hits FROM path JOIN kg ON kg.h = x AND kg.t = z GROUP BY ALL)"""
_kg("composition_patterns", analysis.composition, "SELECT r1, r2, r, support, round(hits / support, 6) AS confidence FROM c JOIN s USING (r1, r2)", _COMP)
_kg("pattern_skyline", lambda kg: analysis.skyline(analysis.composition(kg), ["r"]), """SELECT r, support, round(confidence, 6) AS confidence FROM (
  SELECT *, max(confidence) OVER (PARTITION BY r ORDER BY support DESC, confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT DISTINCT r, support, hits / support AS confidence FROM c JOIN s USING (r1, r2)))
  WHERE best IS NULL OR confidence > best""", _COMP)

_kg("pattern_types", analysis.pattern_types, """SELECT r, pattern, support, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY r, pattern ORDER BY confidence DESC, support DESC) AS nth FROM (
  SELECT r, 'symmetry' AS pattern, support, hits / support AS confidence FROM sym UNION ALL SELECT r, 'anti-symmetry', support, 1 - hits / support FROM sym UNION ALL SELECT inverse, 'inversion', support, hits / support FROM inv JOIN n USING (r)
  UNION ALL SELECT r, 'composition', support, hits / support FROM c JOIN s USING (r1, r2)) WHERE confidence > 0) WHERE nth = 1""", f"{_SYM}, {_INV}, {_COMP}")
_kg("graph_info", analysis.graph_info, "SELECT (SELECT count(*) FROM kg) AS triples, (SELECT count(DISTINCT r) FROM kg) AS relations, (SELECT count(*) FROM (SELECT h FROM kg UNION SELECT t FROM kg)) AS entities")


def _jaccard_sql(reverse: bool, kg: str = "kg", n: str = "n") -> str:
    on = "a.h = b.t AND a.t = b.h" if reverse else "a.h = b.h AND a.t = b.t"
    return f"SELECT r1, r2, x.hits / (n1.support + n2.support - x.hits) AS similarity FROM (SELECT a.r AS r1, b.r AS r2, count(*) AS hits FROM {kg} a JOIN {kg} b ON {on} WHERE a.r <> b.r GROUP BY ALL) x JOIN {n} n1 ON n1.r = r1 JOIN {n} n2 ON n2.r = r2"


# no two relations share a pair of entities, so every relation has a second one of the pairs in order
_rising = lambda kg: kg.unionByName(kg.where("h < t").withColumn("r", F.concat("r", F.lit("_rising"))))
_RISING = "two AS (SELECT * FROM kg UNION ALL SELECT h, r || '_rising', t FROM kg WHERE h < t), m AS (SELECT r, count(*) AS support FROM two GROUP BY r)"
_kg("jaccard_relations", lambda kg: analysis.jaccard(_rising(kg)), f"SELECT r1, r2, round(similarity, 6) AS similarity FROM ({_jaccard_sql(False, 'two', 'm')})", _RISING)
_kg("soft_inverse_scores", lambda kg: ranking.soft_inverse_scores(_rising(kg)), f"""SELECT h, r, t, round(sum(similarity), 6) AS score FROM (SELECT h, r1 AS r, t, similarity FROM two JOIN ({_jaccard_sql(False, 'two', 'm')}) x ON x.r2 = two.r
  UNION ALL SELECT t, r1, h, similarity FROM two JOIN ({_jaccard_sql(True, 'two', 'm')}) x ON x.r2 = two.r) GROUP BY h, r, t""", _RISING)
_kg("jaccard_inverse_relations", lambda kg: analysis.jaccard(kg, reverse=True), f"SELECT r1, r2, round(similarity, 6) AS similarity FROM ({_jaccard_sql(True)})", _INV)
_LEAK = f"""{_INV}, near AS (SELECT DISTINCT r1, r2 FROM ({_jaccard_sql(False)} UNION ALL {_jaccard_sql(True)}) WHERE similarity >= 0.97),
  reach AS (SELECT r1 AS a, r1 AS b FROM near UNION SELECT reach.a, near.r2 FROM reach JOIN near ON near.r1 = reach.b), comp AS (SELECT a AS r, min(b) AS component FROM reach GROUP BY a)"""
_kg("leaking_relations", analysis.leaking_relations, """SELECT r, component, support AS "count" FROM (SELECT r, component, support, row_number() OVER (PARTITION BY component ORDER BY support DESC, r) AS nth FROM comp JOIN n USING (r)) WHERE nth > 1""", _LEAK)
_kg("unleaked_triples", lambda kg: relational.restrict(kg, relations=analysis.leaking_relations(kg).select(F.col("r").alias("label")), invert_relations=True), """SELECT h, r, t FROM kg WHERE r NOT IN (SELECT r FROM
  (SELECT r, row_number() OVER (PARTITION BY component ORDER BY support DESC, r) AS nth FROM comp JOIN n USING (r)) WHERE nth > 1)""", _LEAK)
_kg("bernoulli_probabilities", analysis.bernoulli, """SELECT r, round(tph, 6) AS tph, round(hpt, 6) AS hpt, round(tph / (tph + hpt), 6) AS head_probability FROM
  (SELECT r, avg(n) AS tph FROM (SELECT r, h, count(*) AS n FROM kg GROUP BY r, h) GROUP BY r) JOIN (SELECT r, avg(n) AS hpt FROM (SELECT r, t, count(*) AS n FROM kg GROUP BY r, t) GROUP BY r) USING (r)""")
_kg("pseudo_type_index", analysis.pseudo_types, "SELECT r, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails FROM kg GROUP BY r")
_kg("inverse_relation_frequency", analysis.inverse_frequency, "SELECT r, round(1 / count(*), 6) AS weight FROM kg GROUP BY r")
_kg("macro_weights", analysis.pair_weights, "SELECT h, r, t, round(1 / count(*) OVER (PARTITION BY h, r), 6) AS weight FROM kg")
_HEX = "('0x' || substr(md5(concat_ws(chr(9), h, r, t)), {a}, 8))::BIGINT"
_kg("triple_set_hash", analysis.triple_set_hash, "SELECT count(*) AS n, " + ", ".join(f"(sum({_HEX.format(a=a)}) % 4294967296)::BIGINT AS h{i}" for i, a in enumerate((1, 9, 17, 25))) + " FROM kg")

# dictionaries
_DICT = "e AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT h AS label FROM kg UNION SELECT t FROM kg)), rel AS (SELECT r AS label, row_number() OVER (ORDER BY r) - 1 AS id FROM (SELECT DISTINCT r FROM kg))"
_IDS = f"{_DICT}, ids AS (SELECT a.id AS h, rel.id AS r, b.id AS t FROM kg JOIN e a ON kg.h = a.label JOIN rel ON kg.r = rel.label JOIN e b ON kg.t = b.label)"


def _encoded(kg: DataFrame) -> DataFrame:
    return encode.encode(kg, encode.entity_dictionary(kg), encode.relation_dictionary(kg))


def _round_trip(kg: DataFrame) -> DataFrame:
    entities, relations = encode.entity_dictionary(kg), encode.relation_dictionary(kg)
    return encode.decode(encode.encode(kg, entities, relations), entities, relations)


def _macro(kg: DataFrame) -> DataFrame:
    entities = encode.entity_dictionary(kg)
    ids = staged(encode.encode(kg, entities, encode.relation_dictionary(kg)))
    return ranking.metrics(ranking.monotone_ranks(ids, entities.count()).join(ids.groupBy("h", "r").agg((1 / F.count("*")).alias("w")), ["h", "r"]), weight="w")


_kg("dictionary_encode", _encoded, "SELECT h, r, t FROM ids", _IDS)
_kg("entity_dictionary", encode.entity_dictionary, "SELECT label, id FROM e", _DICT)
_kg("relation_dictionary", encode.relation_dictionary, "SELECT label, id FROM rel", _DICT)
_kg("dictionary_round_trip", _round_trip, """SELECT ids.h, ids.r, ids.t, a.label AS h_label, rel.label AS r_label, b.label AS t_label
  FROM ids JOIN e a ON ids.h = a.id JOIN rel ON ids.r = rel.id JOIN e b ON ids.t = b.id""", _IDS)
_kg("inverse_triples", lambda kg: encode.with_inverses(_encoded(kg)), "SELECT h, 2 * r AS r, t FROM ids UNION ALL SELECT t, 2 * r + 1, h FROM ids", _IDS)
# ids with gaps: those of entities times three, of relations squared
_kg("condense", lambda kg: encode.condense(_encoded(kg).select((3 * F.col("h") + 1).alias("h"), (F.col("r") * F.col("r")).alias("r"), (3 * F.col("t") + 1).alias("t")), relations=True), """SELECT a.new AS h, x.new AS r, b.new AS t FROM few JOIN en a ON a.old = h JOIN rn x ON x.old = r JOIN en b ON b.old = t""",
    f"{_IDS}, few AS (SELECT 3 * h + 1 AS h, r * r AS r, 3 * t + 1 AS t FROM ids), en AS (SELECT old, row_number() OVER (ORDER BY old) - 1 AS new FROM (SELECT h AS old FROM few UNION SELECT t FROM few)), rn AS (SELECT old, row_number() OVER (ORDER BY old) - 1 AS new FROM (SELECT DISTINCT r AS old FROM few))")

# restriction, set operations, membership
_NATIONS = "SELECT label FROM (SELECT h AS label FROM kg UNION SELECT t FROM kg) WHERE label LIKE 'n%' OR label LIKE 'g%'"
_nations = lambda kg: kg.select(F.explode(F.array("h", "t")).alias("label")).distinct().where("label like 'n%' or label like 'g%'")
_relations = lambda kg, *names: kg.select(F.col("r").alias("label")).distinct().where(F.col("label").isin(*names))
_kg("restrict_entities", lambda kg: relational.restrict(kg, entities=_nations(kg)), f"SELECT h, r, t FROM kg WHERE h IN ({_NATIONS}) AND t IN ({_NATIONS})")
_kg("restrict_relations_inverted", lambda kg: relational.restrict(kg, relations=_relations(kg, "has_part", "did"), invert_relations=True), "SELECT h, r, t FROM kg WHERE r NOT IN ('has_part', 'did')")
# two graphs over the same entities: the whole one and all of its triples turned round; they share what is symmetric
_turned = lambda kg: kg.select(F.col("t").alias("h"), "r", F.col("h").alias("t"))
_SETS = "a AS (SELECT * FROM kg), b AS (SELECT t AS h, r, h AS t FROM kg)"
_kg("merge_distinct", lambda kg: relational.merge(kg, _turned(kg)).distinct(), "SELECT * FROM a UNION SELECT * FROM b", _SETS)
_kg("merge_all", lambda kg: relational.merge(kg, _turned(kg)), "SELECT * FROM a UNION ALL SELECT * FROM b", _SETS)
_kg("membership_columns", lambda kg: relational.with_membership(kg, turned=_turned(kg), rising=kg.where("h < t")), """SELECT kg.h, kg.r, kg.t, x.h IS NOT NULL AS in_turned, y.h IS NOT NULL AS in_rising FROM kg LEFT JOIN (SELECT DISTINCT * FROM b) x ON kg.h = x.h AND kg.r = x.r AND kg.t = x.t
  LEFT JOIN (SELECT DISTINCT * FROM kg WHERE h < t) y ON kg.h = y.h AND kg.r = y.r AND kg.t = y.t""", _SETS)
_kg("filter_known", lambda kg: relational.without_known(kg, _turned(kg)), "SELECT * FROM a EXCEPT SELECT * FROM b", _SETS)
_kg("split_similarity", lambda kg: relational.steps(kg, _turned(kg)), """SELECT x AS steps, n AS size, round(1 - x / n, 6) AS similarity FROM (SELECT
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS x, (SELECT count(*) FROM a) AS n)""", _SETS)
_kg("filter_index", relational.known_targets, "SELECT h, r, count(DISTINCT t) AS targets FROM kg GROUP BY h, r")
_kg("lcwa_instances", lambda kg: relational.training_instances(kg).select("h", "r", F.array_join("targets", ",").alias("targets")), "SELECT h, r, string_agg(t, ',' ORDER BY t) AS targets FROM kg GROUP BY h, r")


def _candidates(kg: DataFrame) -> DataFrame:
    return relational.candidate_sizes(kg, kg, encode.entity_dictionary(kg).count())


_kg("candidate_set_size", _candidates, """SELECT h, r, t, (SELECT count(*) FROM e) + 1 - count(*) OVER (PARTITION BY r, t) AS head_candidates, (SELECT count(*) FROM e) + 1 - count(*) OVER (PARTITION BY h, r) AS tail_candidates FROM kg""", _DICT)

# ranking
_RANKS = f"""{_IDS}, ne AS (SELECT count(*) AS n FROM e), ranks AS (
  SELECT h, r, t, 'tail' AS side, n - t - (row_number() OVER (PARTITION BY h, r ORDER BY t DESC) - 1) AS rank, n - count(*) OVER (PARTITION BY h, r) + 1 AS candidates FROM ids, ne
  UNION ALL SELECT h, r, t, 'head', n - h - (row_number() OVER (PARTITION BY r, t ORDER BY h DESC) - 1), n - count(*) OVER (PARTITION BY r, t) + 1 FROM ids, ne)"""


def _ranks(kg: DataFrame) -> DataFrame:
    entities = encode.entity_dictionary(kg)
    return ranking.monotone_ranks(encode.encode(kg, entities, encode.relation_dictionary(kg)), entities.count())


_kg("fixed_model_filtered_ranks", _ranks, "SELECT h, r, t, side, rank, candidates FROM ranks", _RANKS)


def _metrics_sql(weight: str) -> str:
    mean = lambda c: f"sum(({c}) * {weight}) / sum({weight})"
    hc = "(ln(candidates) + 0.5772156649015329::DOUBLE + 1 / (2 * candidates) - 1 / (12 * candidates * candidates)) / candidates"
    hits = ", ".join(f"{mean(f'(rank <= {k})::INT')} AS hits_{k}, {mean(f'least(1.0::DOUBLE, {k} / candidates)')} AS e{k}" for k in (1, 3, 10))
    out = ", ".join([f"round({c}, 6) AS {c}" for c in ("mean_rank", "mrr", "geometric_mean_rank", "harmonic_mean_rank", "hits_1", "hits_3", "hits_10")])
    adjusted = ", ".join(f"round((hits_{k} - e{k}) / (1 - e{k}), 6) AS adjusted_hits_{k}" for k in (1, 3, 10))
    return f"""SELECT coalesce(side, 'both') AS side, "count", {out}, round(mean_rank / e, 6) AS adjusted_mean_rank, round(1 - (mean_rank - 1) / (e - 1), 6) AS adjusted_mean_rank_index,
  round((mrr - err) / (1 - err), 6) AS adjusted_mrr, {adjusted} FROM (SELECT side, count(*) AS "count", {mean('rank')} AS mean_rank, {mean('1 / rank')} AS mrr, exp({mean('ln(rank)')}) AS geometric_mean_rank,
  sum({weight}) / sum({weight} / rank) AS harmonic_mean_rank, {mean('(candidates + 1) / 2')} AS e, {mean(hc)} AS err, {hits} FROM weighted GROUP BY GROUPING SETS ((side), ()))"""


_kg("rank_metrics", lambda kg: ranking.metrics(_ranks(kg)), _metrics_sql("w"), f"{_RANKS}, weighted AS (SELECT *, 1.0::DOUBLE AS w FROM ranks)")
_kg("macro_rank_metrics", _macro, _metrics_sql("w"),
    f"{_RANKS}, weighted AS (SELECT ranks.*, w FROM ranks JOIN (SELECT h, r, 1 / count(*) AS w FROM ids GROUP BY h, r) USING (h, r))")
# a hair is added, as many scores are halves of the last place
_kg("rank_dispersion", lambda kg: ranking.dispersion(_ranks(kg)).withColumns({c: F.round(c, 2) for c in ("variance", "standard_deviation")}), """SELECT side, round(m, 6) AS median_rank, round(var_pop(rank), 2) AS variance, round(stddev_pop(rank), 2) AS standard_deviation, round(median(abs(rank - m)) / 0.6745::DOUBLE, 6) AS mad
  FROM (SELECT *, median(rank) OVER (PARTITION BY side) AS m FROM ranks) GROUP BY side, m""", _RANKS)
_kg("rank_z_scores", lambda kg: ranking.z_scores(_ranks(kg)), """SELECT side, round(sum((candidates + 1) / 2 - rank) / sqrt(sum((candidates::DOUBLE * candidates - 1) / 12)), 6) AS z_mean_rank,
  round(sum((rank <= 10)::INT - p) / sqrt(sum(p * (1 - p))), 6) AS z_hits FROM (SELECT *, least(1.0::DOUBLE, 10 / candidates) AS p FROM ranks) GROUP BY side""", _RANKS)
_kg("bootstrap_mrr", lambda kg: ranking.bootstrap(_ranks(kg)))
_kg("marginal_baseline_scores", lambda kg: ranking.marginal_scores(kg).withColumn("score", F.col("score") + 1e-9), """SELECT h, r, t, round(ph * pr / sum(ph * pr) OVER (PARTITION BY h, r) + 1e-9, 6) AS score FROM (SELECT DISTINCT h, r FROM kg) JOIN
  (SELECT h, t, count(*) / sum(count(*)) OVER (PARTITION BY h) AS ph FROM kg GROUP BY h, t) USING (h) JOIN (SELECT r, t, count(*) / sum(count(*)) OVER (PARTITION BY r) AS pr FROM kg GROUP BY r, t) USING (r, t)""")

# graph
_NEAR = "near AS (SELECT h AS a, t AS b FROM kg WHERE h <> t UNION SELECT t, h FROM kg WHERE h <> t)"
_kg("node_degrees", graph.degrees, "SELECT node, count(*) AS degree FROM (SELECT h AS node FROM kg UNION ALL SELECT t FROM kg) GROUP BY node")
_kg("degree_anchors", lambda kg: graph.degree_anchors(kg, 32), "SELECT node, count(*) AS degree FROM (SELECT h AS node FROM kg UNION ALL SELECT t FROM kg) GROUP BY node ORDER BY degree DESC, node LIMIT 32")
_kg("degree_moments", graph.degree_moments, "SELECT count(*) AS nobs, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(var_samp(n), 6) AS variance FROM (SELECT h, r, count(*) AS n FROM kg GROUP BY h, r)")
_kg("edge_weights", graph.edge_weights, """SELECT h, r, t, round(1 / i, 6) AS inverse_in, round(1 / o, 6) AS inverse_out, round(1 / sqrt(i * o), 6) AS symmetric FROM
  (SELECT *, count(*) OVER (PARTITION BY t) AS i, count(*) OVER (PARTITION BY h) AS o FROM kg)""")
_kg("relation_tokens", graph.relation_tokens, "SELECT node, string_agg(DISTINCT token, ',' ORDER BY token) AS tokens FROM (SELECT h AS node, r AS token FROM kg UNION ALL SELECT t, r || '_inverse' FROM kg) GROUP BY node")
_BFS = f"{_NEAR}, d0 AS (SELECT DISTINCT h AS node, 0 AS distance FROM kg WHERE r = 'region_has_nation')" + "".join(
    f", d{k} AS (SELECT * FROM d{k - 1} UNION ALL SELECT DISTINCT b, {k} FROM d{k - 1} JOIN near ON node = a WHERE distance = {k - 1} AND b NOT IN (SELECT node FROM d{k - 1}))" for k in (1, 2, 3))
_kg("bfs_distances", lambda kg: graph.distances(kg, kg.where("r = 'region_has_nation'").select(F.col("h").alias("node")), 3), "SELECT node, distance FROM d3", _BFS)
_regions = lambda kg: kg.where("r = 'region_has_nation'").select(F.col("h").alias("node"))
_ANCHORS = f"{_NEAR}, s0 AS (SELECT DISTINCT h AS node, h AS anchor, 0 AS distance FROM kg WHERE r = 'region_has_nation')" + "".join(
    f", s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT DISTINCT b, anchor, {k} FROM s{k - 1} JOIN near ON node = a WHERE distance = {k - 1} AND (b, anchor) NOT IN (SELECT (node, anchor) FROM s{k - 1}))" for k in (1, 2, 3))
_kg("anchor_distances", lambda kg: graph.anchor_distances(kg, _regions(kg), 3), "SELECT node, anchor, distance FROM s3", _ANCHORS)
_kg("nearest_anchors", lambda kg: graph.nearest_anchors(kg, _regions(kg), 3, 2), """SELECT node, string_agg(anchor, ',' ORDER BY nth) AS anchors FROM
  (SELECT node, anchor, row_number() OVER (PARTITION BY node ORDER BY distance, anchor) AS nth FROM s3) WHERE nth <= 2 GROUP BY node""", _ANCHORS)
_WALK = f"{_NEAR}, d AS (SELECT a, count(*) AS d FROM near GROUP BY a)"
_kg("graph_walk_returns", graph.walk_returns_by_triangles, """SELECT near.a AS node, 2 AS step, round(sum(1 / (x.d::DOUBLE * y.d)), 6) AS probability FROM near JOIN d x ON x.a = near.a JOIN d y ON y.a = near.b GROUP BY near.a UNION ALL
  SELECT p.a, 3, round(sum(1 / (x.d::DOUBLE * y.d * z.d)), 6) FROM near p JOIN near q ON q.a = p.b JOIN near s ON s.a = q.b AND s.b = p.a JOIN d x ON x.a = p.a JOIN d y ON y.a = p.b JOIN d z ON z.a = q.b GROUP BY p.a""", _WALK)
_PR = "l AS (SELECT h, t, count(*) OVER (PARTITION BY h) AS o FROM (SELECT DISTINCT h, t FROM kg)), v AS (SELECT DISTINCT h AS node FROM kg UNION SELECT t FROM kg), nv AS (SELECT count(*) AS n FROM v), p0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, nv)" + "".join(
    f""", p{k} AS (SELECT v.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank FROM v CROSS JOIN nv CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM p{k - 1} WHERE node NOT IN (SELECT h FROM l))
  LEFT JOIN (SELECT t AS node, sum(rank / o) AS got FROM p{k - 1} JOIN l ON node = h GROUP BY t) g ON g.node = v.node)""" for k in range(1, 11))
_kg("pagerank", graph.pagerank, "SELECT node, round(rank, 6) AS rank FROM p10", _PR)
_kg("rank_anchors", lambda kg: graph.rank_anchors(kg, 20), "SELECT node FROM (SELECT node, row_number() OVER (ORDER BY round(rank, 12) DESC, node) AS nth FROM p10) WHERE nth <= 20", _PR)
_PPR = f"{_NEAR}, e AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS d FROM near), q0 AS (SELECT DISTINCT h AS anchor, h AS node, 1.0::DOUBLE AS rank FROM kg WHERE r = 'region_has_nation')" + "".join(
    f", q{k} AS (SELECT anchor, node, sum(rank) AS rank FROM (SELECT anchor, b AS node, 0.85::DOUBLE * rank / d AS rank FROM q{k - 1} JOIN e ON node = a UNION ALL SELECT anchor, node, 0.15::DOUBLE FROM q0) GROUP BY anchor, node)" for k in (1, 2, 3))
# a hair is added, as some ranks are halves of the last place
_kg("anchor_pageranks", lambda kg: graph.anchor_pageranks(kg, _regions(kg)).withColumn("rank", F.col("rank") + 1e-9), "SELECT anchor, node, round(rank + 1e-9, 6) AS rank FROM q3", _PPR)
_kg("mixed_anchors", lambda kg: graph.mixed_anchors(kg, {"degree": 0.5, "random": 0.5}, 16))
_kg("sampled_tokens", lambda kg: graph.sampled_tokens(kg, 3).select("node", F.array_join("tokens", ",").alias("tokens")))
_WL = f"{_NEAR}, c0 AS (SELECT a AS node, CAST(count(*) AS VARCHAR) AS colour FROM near GROUP BY a)" + "".join(
    f""", c{k} AS (SELECT c.node, md5(c.colour || '|' || x.around) AS colour FROM c{k - 1} c JOIN (SELECT a AS node, string_agg(s, ',' ORDER BY s) AS around FROM
  (SELECT a, colour || ':' || CAST(count(*) AS VARCHAR) AS s FROM near JOIN c{k - 1} ON b = node GROUP BY a, colour) GROUP BY a) x ON x.node = c.node)""" for k in (1, 2))
_kg("weisfeiler_lehman", graph.colour_classes, "SELECT colour, count(*) AS nodes FROM c2 GROUP BY colour", _WL)
# the least label that is ten steps away at most, which is farther than any two entities are
_COMPONENTS = f"{_NEAR}, g0 AS (SELECT h AS node, h AS component FROM kg UNION SELECT t, t FROM kg)" + "".join(
    f", g{k} AS (SELECT g.node, least(g.component, coalesce(m.component, g.component)) AS component FROM g{k - 1} g LEFT JOIN (SELECT b AS node, min(component) AS component FROM near JOIN g{k - 1} ON a = node GROUP BY b) m ON m.node = g.node)" for k in range(1, 11))
_kg("connected_components", lambda kg: connected_components(kg, "h", "t"), "SELECT node, component FROM g10", _COMPONENTS)
_kg("graph_components", lambda kg: connected_components(kg, "h", "t").groupBy("component").agg(F.count("*").alias("nodes")), "SELECT component, count(*) AS nodes FROM g10 GROUP BY component", _COMPONENTS)
_kg("most_frequent_relations", lambda kg: analysis.relation_counts(kg).orderBy(F.desc("count"), "r").limit(3), 'SELECT r, count(*) AS "count" FROM kg GROUP BY r ORDER BY 2 DESC, r LIMIT 3')
_kg("top_tails_per_relation", lambda kg: graph.top_per_group(kg.groupBy("r", "t").agg(F.count("*").alias("n")), ["r"], [F.desc("n"), "t"], 5).select("r", "t", "n", F.col("nth").cast("long").alias("nth")),
    "SELECT r, t, n, nth FROM (SELECT r, t, count(*) AS n, row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, t) AS nth FROM kg GROUP BY r, t) WHERE nth <= 5")

# alignment of the graph with itself by nations
_align = lambda kg: kg.where("r = 'nation_in_region'").select(F.col("h").alias("left"), F.col("h").alias("right"))
_TWO = """l AS (SELECT 'left:' || h AS h, 'left:' || r AS r, 'left:' || t AS t FROM a UNION ALL SELECT 'right:' || h, 'right:' || r, 'right:' || t FROM b),
  m AS (SELECT DISTINCT 'left:' || h AS x, 'right:' || h AS y FROM kg WHERE r = 'nation_in_region')"""
_kg("disjoint_union", lambda kg: alignment.disjoint_union(kg, _turned(kg)), "SELECT * FROM l", f"{_SETS}, {_TWO}")
_kg("same_as_union", lambda kg: alignment.same_as_union(kg, _turned(kg), _align(kg)), "SELECT * FROM l UNION ALL SELECT x, 'same-as', y FROM m", f"{_SETS}, {_TWO}")
_kg("swap_union", lambda kg: alignment.swap_union(kg, _turned(kg), _align(kg)), "SELECT * FROM l UNION ALL SELECT mm.y, r, t FROM l JOIN mm ON h = mm.x UNION ALL SELECT h, r, mm.y FROM l JOIN mm ON t = mm.x", f"{_SETS}, {_TWO}, mm AS (SELECT x, y FROM m UNION ALL SELECT y, x FROM m)")
_kg("collapse_union", lambda kg: alignment.collapse_union(kg, _turned(kg), _align(kg)), "SELECT coalesce(p.x, h) AS h, r, coalesce(q.x, t) AS t FROM l LEFT JOIN m p ON h = p.y LEFT JOIN m q ON t = q.y", f"{_SETS}, {_TWO}")

# splits and negatives: properties that hold whatever the hashes
_kg("coverage_seed", splitting.cover, """SELECT DISTINCT h, r, t FROM (SELECT h, r, t FROM kg QUALIFY row_number() OVER (PARTITION BY r ORDER BY h, r, t) = 1 UNION ALL
  SELECT h, r, t FROM kg QUALIFY row_number() OVER (PARTITION BY h ORDER BY h, r, t) = 1 UNION ALL SELECT h, r, t FROM kg QUALIFY row_number() OVER (PARTITION BY t ORDER BY h, r, t) = 1)""")
_kg("split_sizes", lambda kg: splitting.split(kg, [0.8, 0.1]).groupBy("part").agg(F.count("*").alias("n")), """SELECT part, n FROM (SELECT count(*) AS c FROM kg), LATERAL (VALUES (0, floor(0.8::DOUBLE * c + 1e-9)::BIGINT),
  (1, (floor((0.8::DOUBLE + 0.1::DOUBLE) * c + 1e-9) - floor(0.8::DOUBLE * c + 1e-9))::BIGINT), (2, (c - floor((0.8::DOUBLE + 0.1::DOUBLE) * c + 1e-9))::BIGINT)) x(part, n)""")
_kg("split_is_whole", lambda kg: splitting.split(kg, [0.8, 0.1]).select("h", "r", "t"), "SELECT h, r, t FROM kg")
_kg("random_split", lambda kg: splitting.split(kg, [0.8, 0.1]))
_kg("coverage_split", lambda kg: splitting.coverage_split(kg, [0.8, 0.1]))
_kg("semi_inductive_split", lambda kg: splitting.semi_inductive(kg, [0.8, 0.1]))
_kg("fully_inductive_split", splitting.fully_inductive)
_kg("cleaned_split", lambda kg: splitting.cleaned(kg.where("h < t"), kg.where("h >= t"))[1], "SELECT h, r, t FROM b WHERE r IN (SELECT r FROM a) AND h IN (SELECT h FROM a UNION SELECT t FROM a) AND t IN (SELECT h FROM a UNION SELECT t FROM a)", "a AS (SELECT * FROM kg WHERE h < t), b AS (SELECT * FROM kg WHERE h >= t)")


def _basic_negatives(kg: DataFrame) -> DataFrame:
    entities = encode.entity_dictionary(kg)
    return splitting.basic_negatives(encode.encode(kg, entities, encode.relation_dictionary(kg)), entities.count(), 2)


_kg("basic_negatives", _basic_negatives)
_kg("pseudo_typed_negatives", negatives.pseudo_typed_tails)
_kg("typed_negatives", lambda kg: negatives.pseudo_typed(kg))
_kg("filtered_negatives", lambda kg: negatives.filtered(negatives.pseudo_typed(kg, 2), kg))
_kg("remixed_split", lambda kg: splitting.remixed(splitting.split(kg, [0.8, 0.1])).groupBy("part").agg(F.count("*").alias("n")), """SELECT part, n FROM (SELECT count(*) AS c FROM kg), LATERAL (VALUES (0, floor(0.8::DOUBLE * c + 1e-9)::BIGINT),
  (1, (floor((0.8::DOUBLE + 0.1::DOUBLE) * c + 1e-9) - floor(0.8::DOUBLE * c + 1e-9))::BIGINT), (2, (c - floor((0.8::DOUBLE + 0.1::DOUBLE) * c + 1e-9))::BIGINT)) x(part, n)""")
_kg("deteriorated_split", lambda kg: splitting.deteriorated(splitting.split(kg, [0.8, 0.1]), 0.25).select("h", "r", "t"), "SELECT h, r, t FROM kg")
_kg("split_entities", lambda kg: splitting.split_values(kg, "h", [0.5]).groupBy("part").agg(F.count("*").alias("n")), "SELECT part, n FROM (SELECT count(DISTINCT h) AS c FROM kg), LATERAL (VALUES (0, floor(0.5::DOUBLE * c + 1e-9)::BIGINT), (1, (c - floor(0.5::DOUBLE * c + 1e-9))::BIGINT)) x(part, n)")
_kg("mini_batches", lambda kg: splitting.mini_batches(kg, 1024).groupBy("batch").agg(F.count("*").alias("n")), "SELECT k AS batch, 1024::BIGINT AS n FROM range(0, (SELECT count(*) // 1024 FROM kg)) q(k)")
_kg("cleaned_at_random", lambda kg: splitting.cleaned_at_random(kg.where("h < t"), kg.where("h >= t"))[1])


def _bernoulli_negatives(kg: DataFrame) -> DataFrame:
    entities, relations = encode.entity_dictionary(kg), encode.relation_dictionary(kg)
    odds = analysis.bernoulli(kg).join(relations.select(F.col("label").alias("r"), "id"), "r").select(F.col("id").alias("r"), "head_probability")
    return splitting.basic_negatives(encode.encode(kg, entities, relations).join(odds, "r"), entities.count(), 1, head_probability=F.col("head_probability"))


_kg("bernoulli_negatives", _bernoulli_negatives)


def _trained(kg: DataFrame) -> DataFrame:
    """Norms of the entity vectors of a model trained for two epochs."""
    entities = encode.entity_dictionary(kg)
    vectors, _, _ = training.train(encode.encode(kg, entities, encode.relation_dictionary(kg)), entities.count(), dim=8, epochs=2)
    return vectors.select("id", F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)).alias("norm"))


_kg("distmult_training", _trained)


# vectors: triple i is (row i, its label's row, row i + 1)
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    n = e.agg((F.max("vec_id") + 1).alias("n"))
    heads = e.crossJoin(F.broadcast(n)).select("vec_id", F.col("v").alias("h"), "label", ((F.col("vec_id") + 1) % F.col("n")).alias("next"))
    return heads.join(e.select(F.col("vec_id").alias("label"), F.col("v").alias("r")), "label").join(e.select(F.col("vec_id").alias("next"), F.col("v").alias("t")), "next").select("vec_id", "h", "r", "t")


_VEC = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), x AS (SELECT a.vec_id, a.v AS h, b.v AS r, c.v AS t FROM e a JOIN e b ON b.vec_id = a.label JOIN e c ON c.vec_id = (a.vec_id + 1) % (SELECT max(vec_id) + 1 FROM e))"
for _name in interactions.INTERACTIONS:
    _add(f"score_{_name}", lambda spark, d, n=_name: _vectors(spark, d).select("vec_id", interactions.score(n, DIM).alias("score")), f"WITH {_VEC} SELECT vec_id, round({interactions.score_sql(_name, DIM)}, 6) AS score FROM x")


_add("score_hole", lambda spark, d: _vectors(spark, d).select("vec_id", interactions.hole(DIM).alias("score")), f"WITH {_VEC} SELECT vec_id, round({interactions.hole_sql(DIM)}, 6) AS score FROM x")
for _name, _term in losses.regularizers_sql(DIM).items():
    _add(f"regularizer_{_name}", lambda spark, d, n=_name: spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v")).agg(F.avg(F.expr(losses.regularizers(DIM)[n])).alias("penalty")), f"WITH {_VEC} SELECT round(avg({_term}), 6) AS penalty FROM e")


def _top_targets(name: str, k: int = 10) -> Callable[[SparkSession, str], DataFrame]:
    """The k best tails among all rows for every row whose id is divisible by 50, with its label's row as relation."""

    def make(spark: SparkSession, d: str) -> DataFrame:
        asked = _vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "h", "r")
        every = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("t"))
        scored = asked.crossJoin(every).select("query", "vec_id", interactions.score(name, DIM).alias("score"))
        return graph.top_per_group(scored, ["query"], [F.desc("score"), "vec_id"], k).select("query", "vec_id", "score")

    return make


for _name in ("transe_l2", "distmult", "complex", "rotate"):
    _add(f"top_targets_{_name}", _top_targets(_name), f"""WITH {_VEC}, q AS (SELECT x.vec_id AS query, x.h, x.r, e.vec_id, e.v AS t FROM x, e WHERE x.vec_id % 50 = 0)
  SELECT query, vec_id, round(score, 6) AS score FROM (SELECT query, vec_id, {interactions.score_sql(_name, DIM)} AS score FROM q) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10""")


# classification and losses: the label is quality, the score falls with length
def _labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").cast("long").alias("y"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", (F.col("n_chars") / 1000 - 2).alias("score"))
    return docs.join(labels, "doc_id")


_LAB = "z AS (SELECT d.doc_id, d.lang, n_chars / 1000 - 2 AS score, quality::BIGINT AS y FROM documents d JOIN labels l USING (doc_id))"
_add("classification_confusion", lambda spark, d: classification.confusion(_labelled(spark, d), 0.0), f"""WITH {_LAB}, c AS (SELECT count(*) FILTER (WHERE score >= 0 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0 AND y = 0) AS tn FROM z)
  SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(tp / (tp + fp + fn), 6) AS threat, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
_add("classification_rates", lambda spark, d: classification.rates(_labelled(spark, d), 0.0), f"""WITH {_LAB}, c AS (SELECT (count(*) FILTER (WHERE score >= 0 AND y = 1))::DOUBLE AS tp, (count(*) FILTER (WHERE score >= 0 AND y = 0))::DOUBLE AS fp,
  (count(*) FILTER (WHERE score < 0 AND y = 1))::DOUBLE AS fn, (count(*) FILTER (WHERE score < 0 AND y = 0))::DOUBLE AS tn FROM z) SELECT {', '.join(f'round({sql}, 6) AS {name}' for name, sql in classification.RATES.items())} FROM c""")
_add("roc_auc", lambda spark, d: classification.roc_auc(_labelled(spark, d)), f"""WITH {_LAB}, g AS (SELECT score, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM z GROUP BY score), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC))
  SELECT round(1 - sum(p * (fp - n / 2)) / (sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM c""")
for _name, _loss in losses.POINTWISE.items():
    _add(f"loss_{_name}", lambda spark, d, f=_loss: _labelled(spark, d).groupBy("lang").agg(F.avg(F.expr(f("score", "y"))).alias("loss")), f"WITH {_LAB} SELECT lang, round(avg({_loss('score', 'y')}), 6) AS loss FROM z GROUP BY lang")
for _name, _loss in losses.PAIRWISE.items():
    _add(f"loss_{_name}", lambda spark, d, f=_loss: _labelled(spark, d).groupBy("lang").agg(F.avg(F.expr(f("score", "(doc_id % 7 - 3)"))).alias("loss")), f"WITH {_LAB} SELECT lang, round(avg({_loss('score', '(doc_id % 7 - 3)')}), 6) AS loss FROM z GROUP BY lang")
_add("label_smoothing", lambda spark, d: _labelled(spark, d).select("doc_id", F.expr(losses.label_smoothing("y", 0.1)).cast("double").alias("y")), f"WITH {_LAB} SELECT doc_id, round(({losses.label_smoothing('y', 0.1)})::DOUBLE, 6) AS y FROM z")

# literals: numeric attributes of parts and customers
_LITERALS = [("part", "p_partkey", "p", c) for c in ("p_size", "p_retailprice")] + [("customer", "c_custkey", "c", "c_acctbal")]


def _literals(spark: SparkSession, d: str) -> DataFrame:
    parts = [spark.read.parquet(f"{d}/{t}.parquet").select(F.concat(F.lit(p), F.col(k).cast("string")).alias("entity"), F.lit(c).alias("attribute"), F.col(c).cast("double").alias("value")) for t, k, p, c in _LITERALS]
    return literal_matrix(parts[0].unionByName(parts[1]).unionByName(parts[2]), [c for *_, c in _LITERALS])


_add("literals_pivot", _literals, """SELECT 'p' || CAST(p_partkey AS VARCHAR) AS entity, round(p_size::DOUBLE, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice, 0::DOUBLE AS c_acctbal FROM part
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 0, 0, round(c_acctbal, 6) FROM customer""")
