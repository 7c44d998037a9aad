"""Registered queries of models: scores by every form, ranks of candidates, metrics, predictions, losses and training.

Vectors come from the table embeddings: an entity's or a relation's whole vector is a row's, tiled or folded to the form's
width (element i is the sum of the row's elements i, i + width, ...). Shared weights are sines of their places.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses
from ..models import engine, fitting
from ..models.engine import Model
from ..models.forms import FORMS, dimensions
from ..operators import classification, evaluation, messages, prediction, ranking
from .catalog import _KG, _LAB, _RANKS, QUERIES, _add, _kg, _labelled, _ranks

DIM = 64
_BEFORE = frozenset(QUERIES)

#: Dimensions that the queries use, by form.
SIZES: dict[str, dict[str, int]] = {
    **{n: {"d": 64} for n in ("transe", "transe_l2", "um", "transf", "distmult", "distma", "toruse", "hole", "transh", "pairre", "linearre", "triplere", "crosse", "proje", "mure", "convkb", "conve", "ermlp", "ermlpe", "transformer")},
    **{n: {"d": 32} for n in ("complex", "rotate", "transd", "kg2e", "kg2e_likelihood", "simple", "cp", "boxe")},
    **{n: {"d": 16} for n in ("quate", "autosf")},
    **{n: {"d": 8} for n in ("rescal", "se", "tucker", "multilinear_tucker")},
    "transr": {"d": 8, "k": 6}, "ntn": {"d": 8, "k": 4}, "distmult_literal": {"d": 60, "l": 4}, "distmult_literal_gated": {"d": 60, "l": 4}, "complex_literal": {"d": 30, "l": 4},
}
SIZES["transd"]["k"] = 32
for _n in ("convkb", "conve", "ermlp", "ermlpe", "transformer"):
    SIZES[_n] = {"d": 16 if _n in ("conve", "transformer") else 64, "m": 4}


def sized(name: str) -> dict[str, int]:
    return dimensions(FORMS[name], **SIZES[name])


def weights(name: str) -> dict[str, np.ndarray]:
    """Shared weights: half the sine of 0.7 times the place, counted over all weights in order."""
    _, _, shapes = FORMS[name].sizes(sized(name))
    at, out = 1, {}
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k] = 0.5 * np.sin(0.7 * np.arange(at, at + n)).reshape(s)
        at += n
    return out


def _folded(v: str, width: int) -> str:
    return f"transform(sequence(0, {width - 1}), i -> aggregate(sequence(i % {DIM}, {DIM - 1}, {max(width, DIM)}), 0D, (a, j) -> a + {v}[j]))" if width >= DIM else f"transform(sequence(0, {width - 1}), i -> aggregate(sequence(i, {DIM - 1}, {width}), 0D, (a, j) -> a + {v}[j]))"


def _folded_sql(v: str, width: int) -> str:
    if width >= DIM:
        return f"list_transform(range(0, {width}), lambda i: {v}[i % {DIM} + 1])"
    return f"list_transform(range(0, {width}), lambda i: list_sum(list_transform(range(0, {-(-DIM // width)}), lambda j: coalesce({v}[i + j * {width} + 1], 0))))"


def embedded(spark: SparkSession, d: str, name: str) -> Model:
    """A model whose entities and relations are the rows of embeddings."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    wide, narrow = FORMS[name].widths(sized(name))
    table = lambda width: rows.select("id", (F.expr(_folded("e", width)) if width else F.array().cast("array<double>")).alias("v"))
    return Model(name, sized(name), table(wide), table(narrow), weights(name))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Triples (row, its label's row, a following row): two for each row."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("h"), F.col("label").cast("long").alias("r"))
    n = e.agg((F.max("h") + 1).alias("n"))
    return e.crossJoin(F.broadcast(n)).select("h", "r", F.explode(F.array((F.col("h") + 1) % F.col("n"), (F.col("h") + 7) % F.col("n"))).alias("t"))


_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings), n AS (SELECT max(vec_id) + 1 AS n FROM e), f AS (SELECT vec_id AS h, label AS r, unnest([(vec_id + 1) % n, (vec_id + 7) % n]) AS t FROM e, n)"


def _with_vectors(name: str, rows: str, columns: str) -> str:
    """Rows of ids h, r, t with the whole vectors hw, rw, tw."""
    wide, narrow = FORMS[name].widths(sized(name))
    r = _folded_sql("b.v", narrow) if narrow else "[]::DOUBLE[]"
    return f"SELECT {columns}, {_folded_sql('a.v', wide)} AS hw, {r} AS rw, {_folded_sql('c.v', wide)} AS tw FROM {rows} q JOIN e a ON a.vec_id = q.h JOIN e b ON b.vec_id = q.r JOIN e c ON c.vec_id = q.t"


def _scores(name: str, spark: SparkSession, d: str) -> DataFrame:
    return engine.score_triples(embedded(spark, d, name), facts(spark, d))


# SQL of the scores, written out element by element; places count from 0
def _sum(n, term) -> str:
    return "list_sum([" + ", ".join(str(term(i)) for i in (range(n) if isinstance(n, int) else n)) + "])"


def _max0(x: str) -> str:
    return f"greatest(0, {x})"


def _cell(c: str, base: int = 0):
    return lambda i: f"{c}[{base + i + 1}]"


def _sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def score_sqls() -> dict[str, str]:
    out: dict[str, str] = {}
    H, R, T = _cell("hw"), _cell("rw"), _cell("tw")
    ws = {n: {k: x for k, x in weights(n).items()} for n in FORMS}
    num = lambda x: f"({float(x)!r}::DOUBLE)"
    out["transe"] = "-" + _sum(64, lambda i: f"abs({H(i)} + {R(i)} - {T(i)})")
    out["transe_l2"] = "-sqrt(" + _sum(64, lambda i: f"({H(i)} + {R(i)} - {T(i)})^2") + ")"
    out["um"] = "-" + _sum(64, lambda i: f"({H(i)} - {T(i)})^2")
    out["transf"] = _sum(64, lambda i: f"2 * {H(i)} * {T(i)} + {R(i)} * {T(i)} - {H(i)} * {R(i)}")
    out["distmult"] = _sum(64, lambda i: f"{H(i)} * {R(i)} * {T(i)}")
    out["distma"] = _sum(64, lambda i: f"{H(i)} * {R(i)} + {R(i)} * {T(i)} + {H(i)} * {T(i)}")
    out["toruse"] = "-sqrt(" + _sum(64, lambda i: "least({x} - floor({x}), 1 - ({x} - floor({x})))^2".format(x=f"({H(i)} + {R(i)} - {T(i)})")) + ")"
    out["hole"] = _sum(64, lambda k: f"{R(k)} * " + _sum(64, lambda j: f"{H(j)} * {T((j + k) % 64)}"))
    d = 32
    out["complex"] = _sum(d, lambda i: f"{H(i)} * {R(i)} * {T(i)} + {H(i + d)} * {R(i)} * {T(i + d)} + {H(i)} * {R(i + d)} * {T(i + d)} - {H(i + d)} * {R(i + d)} * {T(i)}")
    out["rotate"] = "-sqrt(" + _sum(d, lambda i: f"({H(i)} * cos({R(i)}) - {H(i + d)} * sin({R(i)}) - {T(i)})^2 + ({H(i)} * sin({R(i)}) + {H(i + d)} * cos({R(i)}) - {T(i + d)})^2") + ")"
    out["simple"] = "0.5 * " + _sum(d, lambda i: f"{H(i)} * {R(i)} * {T(i)} + {T(i + d)} * {R(i + d)} * {H(i + d)}")
    out["cp"] = _sum(d, lambda i: f"{H(i)} * {R(i)} * {T(i + d)}")
    spread, rel = (lambda i: f"(greatest(abs({H(i + d)}), 0.05) + greatest(abs({T(i + d)}), 0.05))"), (lambda i: f"greatest(abs({R(i + d)}), 0.05)")
    mean = lambda i: f"({H(i)} - {T(i)} - {R(i)})"
    out["kg2e"] = f"-0.5 * ({_sum(d, lambda i: f'{spread(i)} / {rel(i)} + {mean(i)}^2 / {rel(i)} + ln({rel(i)}) - ln({spread(i)})')} - {d})"
    out["kg2e_likelihood"] = _sum(d, lambda i: f"{mean(i)}^2 / ({spread(i)} + {rel(i)}) + ln({spread(i)} + {rel(i)}) + ln(2 * pi())")
    squares = lambda n, term: f"({_sum(n, lambda i: f'({term(i)})^2')})"
    kept = lambda n, term: f"least(1, 1 / sqrt({squares(n, term)} + 1e-24))"
    # TransD: the projected head and tail, each scaled down to length one
    along = lambda E: f"({_sum(d, lambda j: f'{E(j + d)} * {E(j)}')})"
    flat = lambda E: lambda i: f"({R(i + d)} * {along(E)} + {E(i)})"
    out["transd"] = f"(SELECT -list_sum(list_transform(range(1, {d + 1}), lambda i: (hp[i] * hs + rw[i] - tp[i] * ts)^2)) FROM (SELECT hp, tp, least(1, 1 / sqrt(list_sum(list_transform(hp, lambda x: x^2)) + 1e-24)) AS hs, least(1, 1 / sqrt(list_sum(list_transform(tp, lambda x: x^2)) + 1e-24)) AS ts FROM (SELECT list_transform(range(1, {d + 1}), lambda i: rw[i + {d}] * {along(H)} + hw[i]) AS hp, list_transform(range(1, {d + 1}), lambda i: rw[i + {d}] * {along(T)} + tw[i]) AS tp)))"
    del flat
    size = f"sqrt({squares(64, R)} + 1e-24)"
    dot = lambda E: f"({_sum(64, lambda j: f'{E(j)} * {R(j)}')} / {size})"
    out["transh"] = f"(SELECT -sqrt(list_sum(list_transform(range(1, 65), lambda i: (hw[i] - a * rw[i] / s + rw[i + 64] - tw[i] + b * rw[i] / s)^2))) FROM (SELECT {dot(H)} AS a, {dot(T)} AS b, {size} AS s))"
    out["pairre"] = "-" + _sum(64, lambda i: f"abs({H(i)} * {R(i)} - {T(i)} * {R(i + 64)})")
    out["linearre"] = "-" + _sum(64, lambda i: f"abs({H(i)} * {R(i)} - {T(i)} * {R(i + 64)} + {R(i + 128)})")
    out["triplere"] = "-" + _sum(64, lambda i: f"abs({H(i)} * ({R(i)} + 1) - {T(i)} * ({R(i + 64)} + 1) + {R(i + 128)})")
    out["mure"] = f"{H(64)} + {T(65)} - sqrt({squares(64, lambda i: f'{H(i)} * {R(i)} + {R(i + 64)} - {T(i)}')})"
    w = ws["crosse"]
    out["crosse"] = _sum(64, lambda i: f"tanh({num(w['bias'][i])} + {R(i + 64)} * {H(i)} + {R(i + 64)} * {H(i)} * {R(i)}) * {T(i)}")
    w = ws["proje"]
    out["proje"] = _sigmoid(_sum(64, lambda i, w=w: f"tanh({num(w['head'][i])} * {H(i)} + {num(w['relation'][i])} * {R(i)} + {num(w['bias'][i])}) * {T(i)}") + f" + {num(w['outer'])}")
    q = 16
    part = lambda c, k: _cell(c, k * q)
    a, b, c = ([part(x, k) for k in range(4)] for x in ("hw", "rw", "tw"))
    product = lambda i: [
        f"({a[0](i)} * {b[0](i)} - {a[1](i)} * {b[1](i)} - {a[2](i)} * {b[2](i)} - {a[3](i)} * {b[3](i)})", f"({a[0](i)} * {b[1](i)} + {a[1](i)} * {b[0](i)} + {a[2](i)} * {b[3](i)} - {a[3](i)} * {b[2](i)})",
        f"({a[0](i)} * {b[2](i)} - {a[1](i)} * {b[3](i)} + {a[2](i)} * {b[0](i)} + {a[3](i)} * {b[1](i)})", f"({a[0](i)} * {b[3](i)} + {a[1](i)} * {b[2](i)} - {a[2](i)} * {b[1](i)} + {a[3](i)} * {b[0](i)})",
    ]
    out["quate"] = "-" + _sum(q, lambda i: "(" + " + ".join(f"{p} * {c[k](i)}" for k, p in enumerate(product(i))) + ")")
    out["autosf"] = _sum(64, lambda i: f"{H(i)} * {R(i)} * {T(i)}")
    m = 8
    row = lambda base, i, n: lambda j: f"rw[{base + i * n + j + 1}]"
    mul = lambda base, i, E, n=m: "(" + _sum(n, lambda j: f"{row(base, i, n)(j)} * {E(j)}") + ")"
    out["rescal"] = _sum(m, lambda i: f"{H(i)} * {mul(0, i, T)}")
    out["se"] = "-" + _sum(m, lambda i: f"abs({mul(0, i, H)} - {mul(64, i, T)})")
    k = 6
    out["transr"] = f"-({_sum(k, lambda i: f'({mul(k, i, H)} * {kept(k, lambda x: mul(k, x, H))} + {R(i)} - {mul(k, i, T)} * {kept(k, lambda x: mul(k, x, T))})^2')})"
    w = ws["tucker"]["core"]
    out["tucker"] = _sum([(i, j, x) for i in range(m) for j in range(m) for x in range(m)], lambda p, w=w: f"{num(w[p])} * {H(p[0])} * {R(p[1])} * {T(p[2])}")
    w = ws["multilinear_tucker"]["core"]
    out["multilinear_tucker"] = _sum([(i, j, x) for i in range(m) for j in range(m) for x in range(m)], lambda p, w=w: f"{num(w[p])} * {H(p[0])} * {R(p[1])} * {T(p[2] + m)}")
    kk, base = 4, [0, 256, 288, 320, 324]
    bilinear = lambda s: "(" + _sum([(i, j) for i in range(m) for j in range(m)], lambda p: f"{H(p[0])} * rw[{s * 64 + p[0] * m + p[1] + 1}] * {T(p[1])}") + ")"
    out["ntn"] = _sum(kk, lambda s: f"{R(base[4] + s)} * tanh({bilinear(s)} + {mul(base[1], s, H)} + {mul(base[2], s, T)} + {R(base[3] + s)})")
    w = ws["ermlp"]
    joined = [H(i) for i in range(64)] + [R(i) for i in range(64)] + [T(i) for i in range(64)]
    hidden = lambda w, f, xs: [_max0(_sum(len(xs), lambda j: f"{num(w[f][i, j])} * {xs[j]}") + f" + {num(w['bias'][i])}") for i in range(len(w["bias"]))]
    out["ermlp"] = _sum(4, lambda i, w=w, x=hidden(w, "inner", joined): f"{num(w['outer'][i])} * {x[i]}") + f" + {num(w['last'])}"
    w = ws["ermlpe"]
    first = hidden(w, "inner", joined[:128])
    out["ermlpe"] = f"(SELECT list_sum([{', '.join(_max0(_sum(4, lambda j: f'{num(w["outer"][i, j])} * x[{j + 1}]') + f' + {num(w["last"][i])}') + f' * {T(i)}' for i in range(64))}]) FROM (SELECT [{', '.join(first)}] AS x))"
    w = ws["convkb"]
    out["convkb"] = _sum([(f, i) for f in range(4) for i in range(64)], lambda p, w=w: f"{num(w['outer'][p])} * " + _max0(f"{num(w['filters'][p[0], 0])} * {H(p[1])} + {num(w['filters'][p[0], 1])} * {R(p[1])} + {num(w['filters'][p[0], 2])} * {T(p[1])} + {num(w['bias'][p[0]])}")) + f" + {num(w['last'])}"
    w, wide = ws["conve"], 8
    pixel = lambda y, x: (H if y < 2 else R)((y % 2) * wide + x)
    maps = [_max0(_sum([(i, j) for i in range(2) for j in range(3)], lambda p: f"{num(w['kernels'][f, p[0], p[1]])} * {pixel(y + p[0], x + p[1])}") + f" + {num(w['map_bias'][f])}") for f in range(4) for y in range(3) for x in range(wide - 2)]
    out["conve"] = f"(SELECT list_sum([{', '.join(_max0(_sum(len(maps), lambda j: f'{num(w["dense"][i, j])} * x[{j + 1}]') + f' + {num(w["dense_bias"][i])}') + f' * {T(i)}' for i in range(16))}]) + {T(16)} FROM (SELECT [{', '.join(maps)}] AS x))"
    # BoxE: corners of the box of the head (at 0) and of the tail (at 65) in the relation's vector
    box, d = [], 32
    for start, E, O in ((0, "hw", "tw"), (2 * d + 1, "tw", "hw")):
        scale = f"exp(list_sum(list_transform(rw[{start + d + 1}:{start + 2 * d}], lambda x: ln(abs(x) + 1e-12))) / {d})"
        grown = f"(CASE WHEN rw[{start + 2 * d + 1}] > 0 THEN rw[{start + 2 * d + 1}] ELSE exp(rw[{start + 2 * d + 1}]) - 1 END + 1)"
        half = f"0.5 * {grown} * rw[i + {start + d}] / {scale}"
        edge = lambda f: f"tanh({f}(rw[i + {start}] - {half}, rw[i + {start}] + {half}))"  # noqa: B023, E731
        point = f"tanh({E}[i] + {O}[i + {d}])"
        cells = f"list_transform(range(1, {d + 1}), lambda i: {{'p': {point}, 'l': {edge('least')}, 'u': {edge('greatest')}}})"
        distance = "CASE WHEN c.p >= c.l AND c.p <= c.u THEN abs(c.p - (c.l + c.u) / 2) / (c.u - c.l + 1) ELSE abs(c.p - (c.l + c.u) / 2) * (c.u - c.l + 1) - 0.5 * (c.u - c.l) * ((c.u - c.l + 1) - 1 / (c.u - c.l + 1)) END"
        box.append(f"sqrt(list_sum(list_transform({cells}, lambda c: ({distance})^2)))")
    out["boxe"] = f"-{box[0]} - {box[1]}"
    w = ws["distmult_literal"]
    mixed = lambda w, E, i: f"({_sum(64, lambda j: f'{num(w["project"][i, j])} * {E(j)}')} + {num(w['bias'][i])})"
    out["distmult_literal"] = f"(SELECT list_sum(list_transform(range(1, 61), lambda i: a[i] * rw[i] * b[i])) FROM (SELECT [{', '.join(mixed(w, H, i) for i in range(60))}] AS a, [{', '.join(mixed(w, T, i) for i in range(60))}] AS b))"
    w = ws["distmult_literal_gated"]

    def gated(E, i, w=w):
        gate = _sigmoid(_sum(60, lambda j: f"{num(w['gate_entity'][i, j])} * {E(j)}") + f" + {num(w['gate_bias'][i])} + " + _sum(4, lambda j: f"{num(w['gate_literal'][i, j])} * {E(60 + j)}"))
        return f"{{'g': {gate}, 'm': tanh({mixed(w, E, i)}), 'e': {E(i)}}}"

    value = "(x.g * x.m + (1 - x.g) * x.e)"
    out["distmult_literal_gated"] = f"(SELECT list_sum(list_transform(range(1, 61), lambda i: a[i] * rw[i] * b[i])) FROM (SELECT list_transform([{', '.join(gated(H, i) for i in range(60))}], lambda x: {value}) AS a, list_transform([{', '.join(gated(T, i) for i in range(60))}], lambda x: {value}) AS b))"
    w = ws["complex_literal"]
    lit = lambda E, k, i, w=w: f"tanh({_sum(34, lambda j: f'{num(w[f"project_{k}"][i, j])} * {E(30 * k + j if j < 30 else 30 + j)}')} + {num(w[f'bias_{k}'][i])})"
    four = ", ".join(f"[{', '.join(lit(E, k, i) for i in range(30))}] AS {n}" for n, E, k in (("a", H, 0), ("b", H, 1), ("c", T, 0), ("d", T, 1)))
    out["complex_literal"] = f"(SELECT list_sum(list_transform(range(1, 31), lambda i: (a[i] * rw[i] - b[i] * rw[i + 30]) * c[i] + (a[i] * rw[i + 30] + b[i] * rw[i]) * d[i])) FROM (SELECT {four}))"
    return out


_SQLS = score_sqls()
for _name in FORMS:
    _add(f"model_score_{_name}", partial(_scores, _name), f"WITH {_E}, x AS ({_with_vectors(_name, 'f', 'q.h AS h, q.r AS r, q.t AS t')}) SELECT h, r, t, round({_SQLS[_name]}, 6) AS score FROM x" if _name in _SQLS else None)


# ranks of the triples of every 50th row among all rows, by tails and heads; both triples of a row are known
_RANKED = ("transe", "distmult", "complex", "rotate", "rescal", "kg2e")


def _evaluated(name: str, spark: SparkSession, d: str, side: tuple[str, ...] = ("head", "tail")) -> DataFrame:
    known = facts(spark, d)
    found = evaluation.ranks(embedded(spark, d, name), known.where("h % 50 = 0"), known, side)
    return found.select("h", "r", "t", "side", F.col("optimistic").cast("double").alias("optimistic"), F.col("pessimistic").cast("double").alias("pessimistic"), "realistic", "candidates")


def _rank_sql(name: str) -> str:
    """Ranks by listing all candidates."""
    scored = _SQLS[name]
    each = f"""SELECT DISTINCT f.h, f.r, f.t, 'tail' AS side, e.vec_id AS other, f.t AS own FROM f, e WHERE f.h % 50 = 0 UNION ALL SELECT DISTINCT f.h, f.r, f.t, 'head', e.vec_id, f.h FROM f, e WHERE f.h % 50 = 0"""
    wide = _with_vectors(name, "p", "q.h AS h, q.r AS r, q.t AS t, q.side AS side, q.other AS other, q.own AS own, q.qh AS qh, q.qt AS qt")
    return f"""WITH {_E}, each_ AS ({each}), p AS (SELECT CASE WHEN side = 'head' THEN other ELSE h END AS h, r, CASE WHEN side = 'tail' THEN other ELSE t END AS t, h AS qh, t AS qt, side, other, own FROM each_),
  x AS ({wide}), s AS (SELECT qh, r, qt, side, other, own, round({scored}, 9) AS score, (h, r, t) IN (SELECT (h, r, t) FROM f) AS known FROM x),
  y AS (SELECT *, max(CASE WHEN other = own THEN score END) OVER (PARTITION BY qh, r, qt, side) AS true_score FROM s), z AS (SELECT * FROM y WHERE other <> own AND NOT known)
  SELECT qh AS h, r, qt AS t, side, count(*) FILTER (WHERE score > true_score) + 1::DOUBLE AS optimistic, count(*) FILTER (WHERE score >= true_score) + 1::DOUBLE AS pessimistic,
  round((count(*) FILTER (WHERE score > true_score) + count(*) FILTER (WHERE score >= true_score)) / 2 + 1, 6) AS realistic, count(*) + 1 AS candidates FROM z GROUP BY ALL"""


for _name in _RANKED:
    _add(f"evaluate_{_name}", partial(_evaluated, _name), _rank_sql(_name))


def _relation_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated("distmult", spark, d, ("relation",))


_add("evaluate_relations_distmult", _relation_ranks, f"""WITH {_E}, p AS (SELECT DISTINCT f.h, e.vec_id AS r, f.t, f.r AS own FROM f, e WHERE f.h % 50 = 0), x AS ({_with_vectors('distmult', 'p', 'q.h AS h, q.r AS r, q.t AS t, q.own AS own')}),
  s AS (SELECT h, r, t, own, round({_SQLS['distmult']}, 9) AS score, (h, r, t) IN (SELECT (h, r, t) FROM f) AS known FROM x), y AS (SELECT *, max(CASE WHEN r = own THEN score END) OVER (PARTITION BY h, own, t) AS true_score FROM s), z AS (SELECT * FROM y WHERE r <> own AND NOT known)
  SELECT h, own AS r, t, 'relation' AS side, count(*) FILTER (WHERE score > true_score) + 1::DOUBLE AS optimistic, count(*) FILTER (WHERE score >= true_score) + 1::DOUBLE AS pessimistic,
  round((count(*) FILTER (WHERE score > true_score) + count(*) FILTER (WHERE score >= true_score)) / 2 + 1, 6) AS realistic, count(*) + 1 AS candidates FROM z GROUP BY ALL""")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Fifty given candidates a side: every third row from the third after the true one."""
    known = facts(spark, d).where("h % 50 = 0").distinct()
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("own")) for s, c in (("head", "h"), ("tail", "t")))))
    each = known.select("h", "r", "t", sides.alias("x"), F.explode(F.expr("sequence(1L, 50L)")).alias("j")).select("h", "r", "t", "x.side", ((F.col("x.own") + 3 * F.col("j")) % n).alias("other"))
    found = evaluation.sampled_ranks(embedded(spark, d, "distmult"), known, each)
    return found.select("h", "r", "t", "side", F.col("optimistic").cast("double").alias("optimistic"), F.col("pessimistic").cast("double").alias("pessimistic"), "realistic", "candidates")


_wide = _with_vectors("distmult", "p", "q.h AS h, q.r AS r, q.t AS t, q.side AS side, q.other AS other, q.own AS own, q.qh AS qh, q.qt AS qt")
_add("evaluate_candidates", _candidates, f"""WITH {_E}, given AS (SELECT DISTINCT f.h, f.r, f.t, side, CASE side WHEN 'head' THEN f.h ELSE f.t END AS own, (CASE side WHEN 'head' THEN f.h ELSE f.t END + 3 * j) % n AS other FROM f, n, (VALUES ('head'), ('tail')) s(side), range(1, 51) q(j) WHERE f.h % 50 = 0),
  each_ AS (SELECT * FROM given WHERE own <> other UNION ALL SELECT DISTINCT h, r, t, side, own, own FROM given), p AS (SELECT CASE WHEN side = 'head' THEN other ELSE h END AS h, r, CASE WHEN side = 'tail' THEN other ELSE t END AS t, h AS qh, t AS qt, side, other, own FROM each_),
  x AS ({_wide}), s AS (SELECT qh, r, qt, side, other, own, round({_SQLS['distmult']}, 9) AS score FROM x), y AS (SELECT *, max(CASE WHEN other = own THEN score END) OVER (PARTITION BY qh, r, qt, side) AS true_score FROM s)
  SELECT qh AS h, r, qt AS t, side, count(*) FILTER (WHERE score > true_score) + 1::DOUBLE AS optimistic, count(*) FILTER (WHERE score >= true_score) + 1::DOUBLE AS pessimistic,
  round((count(*) FILTER (WHERE score > true_score) + count(*) FILTER (WHERE score >= true_score)) / 2 + 1, 6) AS realistic, count(*) + 1 AS candidates FROM y WHERE other <> own GROUP BY ALL""")


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    known, model = facts(spark, d), embedded(spark, d, "transe")
    return evaluation.evaluate_sampled(model, known.where("h % 50 = 0"), known, model.entities.select("id"))


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    known = facts(spark, d)
    return evaluation.evaluate(embedded(spark, d, "complex"), known.where("h % 50 = 0"), known)


_add("evaluate_sampled", _sampled)
_add("evaluate_metrics", _evaluation)

# every rank metric, over the ranks of the fixed model
_KS = (1, 3, 5, 10)


def _all_metrics_sql(ranks: str) -> str:
    powers = ", ".join(f"least(1.0::DOUBLE, {k} / n) AS p{k}" for k in _KS)
    base = "count(*) AS c, avg(rank) AS am, exp(avg(ln(rank))) AS gm, avg(1 / rank) AS ih, median(rank) AS med, var_pop(rank) AS v, " + ", ".join(f"avg((rank <= {k})::INT) AS hit{k}" for k in _KS)
    moments = "avg((n + 1) / 2) AS e_am, sum((n::DOUBLE * n - 1) / 12) / count(*)::DOUBLE / count(*) AS v_am, avg(h1) AS e_ih, sum(h2 - h1 * h1) / count(*)::DOUBLE / count(*) AS v_ih, exp(sum(ln(g1))) AS e_gm, exp(sum(ln(g2))) AS s_gm, " + ", ".join(f"avg(p{k}) AS e{k}, sum(p{k} * (1 - p{k})) / count(*)::DOUBLE / count(*) AS v{k}" for k in _KS)
    values = {
        "count": "c", "arithmetic_mean_rank": "am", "inverse_arithmetic_mean_rank": "1 / am", "geometric_mean_rank": "gm", "inverse_geometric_mean_rank": "1 / gm", "harmonic_mean_rank": "1 / ih", "inverse_harmonic_mean_rank": "ih",
        "median_rank": "med", "inverse_median_rank": "1 / med", "variance": "v", "standard_deviation": "sqrt(v)", "median_absolute_deviation": "mad", "adjusted_arithmetic_mean_rank": "am / e_am", "adjusted_arithmetic_mean_rank_index": "(am - e_am) / (1 - e_am)",
        "z_arithmetic_mean_rank": "(e_am - am) / sqrt(v_am)", "adjusted_geometric_mean_rank_index": "(gm - e_gm) / (1 - e_gm)", "z_geometric_mean_rank": "(e_gm - gm) / sqrt(s_gm - e_gm * e_gm)",
        "adjusted_inverse_harmonic_mean_rank": "(ih - e_ih) / (1 - e_ih)", "z_inverse_harmonic_mean_rank": "(ih - e_ih) / sqrt(v_ih)",
    }
    for k in _KS:
        values |= {f"hits_at_{k}": f"hit{k}", f"adjusted_hits_at_{k}": f"(hit{k} - e{k}) / (1 - e{k})", f"z_hits_at_{k}": f"(hit{k} - e{k}) / sqrt(v{k})"}
    rows = ", ".join(f"{{'metric': '{m}', 'value': ({v})::DOUBLE}}" for m, v in values.items())
    power = lambda p: f"list_sum(list_transform(range(1, n + 1), lambda k: power(k, {p}))) / n"
    return f"""{ranks}, twice AS (SELECT side, rank::DOUBLE AS rank, candidates AS n FROM ranks UNION ALL SELECT 'both', rank::DOUBLE, candidates FROM ranks), m AS (SELECT side, {base} FROM twice GROUP BY side),
  size AS (SELECT side, n, c, {power('-1.0')} AS h1, {power('-2.0')} AS h2, {power('1.0 / c')} AS g1, {power('2.0 / c')} AS g2, {powers} FROM (SELECT DISTINCT side, n, count(*) OVER (PARTITION BY side) AS c FROM twice)),
  q AS (SELECT side, {moments} FROM twice JOIN size USING (side, n) GROUP BY side), d AS (SELECT side, median(abs(rank - med)) / 0.6745::DOUBLE AS mad FROM twice JOIN m USING (side) GROUP BY side),
  r AS (SELECT side, unnest([{rows}]) AS x FROM m JOIN q USING (side) JOIN d USING (side)) SELECT side, 'realistic' AS rank_type, x.metric AS metric, x.value AS value FROM r"""


def _significant(df: DataFrame) -> DataFrame:
    """Values to seven figures, as variances and counts differ by many powers of ten; the geometric mean's z-score to two, as the SQL's variance is a small difference."""
    return df.withColumn("value", F.when(F.col("metric") == "z_geometric_mean_rank", F.format_string("%.1e", "value")).otherwise(F.format_string("%.7e", "value")))


_kg("all_rank_metrics", lambda kg: _significant(ranking.all_metrics(_ranks(kg).withColumn("rank_type", F.lit("realistic")), _KS, in_order=True)), f"SELECT side, rank_type, metric, CASE WHEN metric = 'z_geometric_mean_rank' THEN format('{{:.1e}}', value) ELSE format('{{:.7e}}', value) END AS value FROM ({_all_metrics_sql(f'WITH {_KG}, {_RANKS}')})")

# predictions


def _predicted(side: str, spark: SparkSession, d: str, drop: bool = False) -> DataFrame:
    """The ten best candidates for the side of every 50th row's triples."""
    known = facts(spark, d)
    return prediction.predict_target(embedded(spark, d, "complex"), known.where("h % 50 = 0"), side, 10, known=known, drop_known=drop)


def _predict_sql(side: str, drop: bool) -> str:
    fixed = {"head": "r, t", "tail": "h, r", "relation": "h, t"}[side]
    own = {"head": "h", "tail": "t", "relation": "r"}[side]
    return f"""WITH {_E}, p AS (SELECT {fixed}, e.vec_id AS {own} FROM (SELECT DISTINCT {fixed} FROM f WHERE h % 50 = 0) CROSS JOIN e), x AS ({_with_vectors('complex', 'p', 'q.h AS h, q.r AS r, q.t AS t')}), s AS (SELECT h, r, t, {_SQLS['complex']} AS score, (h, r, t) IN (SELECT (h, r, t) FROM f) AS in_known FROM x)
  SELECT h, r, t, round(score, 6) AS score{'' if drop else ', in_known'} FROM s {'WHERE NOT in_known' if drop else ''} QUALIFY row_number() OVER (PARTITION BY {fixed} ORDER BY score DESC, {own}) <= 10"""


for _side in ("head", "tail", "relation"):
    _add(f"predict_{_side}s", partial(_predicted, _side), _predict_sql(_side, False))
_add("predict_new_tails", partial(_predicted, "tail", drop=True), _predict_sql("tail", True))


def _best_triples(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best triples of all heads, relations and tails."""
    return prediction.predict_all(embedded(spark, d, "distmult"), 100)


_add("predict_all", _best_triples, f"""WITH {_E}, p AS (SELECT a.vec_id AS h, b.vec_id AS r, c.vec_id AS t FROM e a, e b, e c), x AS (SELECT h, r, t, list_sum(list_transform(list_zip(hr, c.v), lambda z: z[1] * z[2])) AS score FROM p JOIN (SELECT a.vec_id AS h, b.vec_id AS r, list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]) AS hr FROM e a, e b) USING (h, r) JOIN e c ON c.vec_id = t)
  SELECT h, r, t, round(score, 6) AS score FROM x ORDER BY score DESC, h, r, t LIMIT 100""")
_add("predict_uncertain", lambda spark, d: prediction.predict_uncertain(embedded(spark, d, "transe_l2"), facts(spark, d)))

# setwise losses: a row's score is the positive, three numbers from its id the negatives
_NEGATIVES = "array(doc_id % 7 - 3D, doc_id % 5 - 2D, doc_id % 3 - 1D)"
for _name in losses.SETWISE:
    _add(f"loss_{_name}", lambda spark, d, n=_name: _labelled(spark, d).withColumn("others", F.expr(_NEGATIVES)).groupBy("lang").agg(F.avg(F.expr(losses.setwise(n, "score", "others"))).alias("loss")),
         f"WITH {_LAB}, y AS (SELECT *, [doc_id % 7 - 3::DOUBLE, doc_id % 5 - 2::DOUBLE, doc_id % 3 - 1::DOUBLE] AS others FROM z) SELECT lang, round(avg({losses.setwise(_name, 'score', 'others', duck=True)}), 6) AS loss FROM y GROUP BY lang")


# message passing over the triples, with vectors of eight numbers and matrices of sines
_WIDE = 8
_V8 = f"{_E}, v AS (SELECT vec_id, {_folded_sql('v', _WIDE)} AS v FROM e), x AS (SELECT vec_id, unnest(range({_WIDE})) AS i, unnest(v) AS x FROM v)"


def _eight(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e")).select("id", F.expr(_folded("e", _WIDE)).alias("v"))


def _listed(df: DataFrame) -> DataFrame:
    """An element a row."""
    return df.select("id", F.posexplode("v").alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), "x")


def _sines(at: int, *shape: int) -> np.ndarray:
    n = int(np.prod(shape))
    return 0.5 * np.sin(0.7 * np.arange(at + 1, at + n + 1)).reshape(shape)


def _matrix_sql(at: int) -> str:
    return f"0.5 * sin(0.7 * ({at} + o * {_WIDE} + i + 1))"


_add("neighbour_means", lambda spark, d: _listed(messages.neighbour_means(facts(spark, d), _eight(spark, d), _WIDE)), f"WITH {_V8} SELECT f.t AS id, i, round(avg(x), 6) AS x FROM f JOIN x ON x.vec_id = f.h GROUP BY f.t, i")
_add("weighted_messages", lambda spark, d: _listed(messages.weighted_messages(facts(spark, d).withColumn("w", 1 / (F.col("r") + 1)), _eight(spark, d), _WIDE, "w")), f"WITH {_V8} SELECT f.t AS id, i, round(sum(x / (f.r + 1)), 6) AS x FROM f JOIN x ON x.vec_id = f.h GROUP BY f.t, i")
_add("token_vectors", lambda spark, d: _listed(messages.token_vectors(facts(spark, d).select(F.col("h").alias("id"), F.col("r").alias("token")).distinct(), _eight(spark, d), _WIDE)), f"WITH {_V8} SELECT q.h AS id, i, round(avg(x), 6) AS x FROM (SELECT DISTINCT h, r FROM f) q JOIN x ON x.vec_id = q.r GROUP BY q.h, i")


def _relational(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of relation r: the first of two bases times the sine of r + 1, the second times its cosine."""
    n = int(facts(spark, d).agg(F.max("r")).first()[0] or 0) + 1
    r = np.arange(1, n + 1)
    w = messages.basis_weights(np.stack([np.sin(r), np.cos(r)], 1), _sines(0, 2, _WIDE, _WIDE))
    return _listed(messages.relational_layer(facts(spark, d), _eight(spark, d), _WIDE, w, _sines(128, _WIDE, _WIDE)))


_add("relational_layer", _relational, f"""WITH {_V8}, m AS (SELECT f.t, f.r, i, avg(x) AS x FROM f JOIN x ON x.vec_id = f.h GROUP BY f.t, f.r, i), o AS (SELECT unnest(range({_WIDE})) AS o),
  s AS (SELECT t AS id, o, sum((sin(r + 1) * {_matrix_sql(0)} + cos(r + 1) * {_matrix_sql(64)}) * x) AS x FROM m, o GROUP BY t, o UNION ALL SELECT vec_id, o, sum({_matrix_sql(128)} * x) FROM x, o GROUP BY vec_id, o)
  SELECT id, o AS i, round(greatest(sum(x), 0), 6) AS x FROM s GROUP BY id, o""")


def _composed(spark: SparkSession, d: str) -> DataFrame:
    v = _eight(spark, d)
    found, _ = messages.composed_layer(facts(spark, d), v, v, _WIDE, messages.multiply, *(_sines(64 * k, _WIDE, _WIDE) for k in range(3)), _sines(192, _WIDE), _sines(200, _WIDE, _WIDE))
    return _listed(found)


_add("composed_layer", _composed, f"""WITH {_V8}, o AS (SELECT unnest(range({_WIDE})) AS o), g AS (SELECT h, r, t, count(*) OVER (PARTITION BY h) AS a, count(*) OVER (PARTITION BY t) AS b FROM f),
  fw AS (SELECT t AS id, p.i, sum(p.x * q.x / sqrt(a * b)) AS x FROM g JOIN x p ON p.vec_id = h JOIN x q ON q.vec_id = r AND q.i = p.i GROUP BY t, p.i), bw AS (SELECT h AS id, p.i, sum(p.x * q.x / sqrt(a * b)) AS x FROM g JOIN x p ON p.vec_id = t JOIN x q ON q.vec_id = r AND q.i = p.i GROUP BY h, p.i),
  s AS (SELECT id, o, sum({_matrix_sql(0)} * x) AS x FROM fw, o GROUP BY id, o UNION ALL SELECT id, o, sum({_matrix_sql(64)} * x) FROM bw, o GROUP BY id, o UNION ALL SELECT vec_id, o, sum({_matrix_sql(128)} * x * 0.5 * sin(0.7 * (192 + i + 1))) FROM x, o GROUP BY vec_id, o)
  SELECT id, o AS i, round(tanh(sum(x) / 3), 6) AS x FROM s GROUP BY id, o""")


def _top_rates(spark: SparkSession, d: str) -> DataFrame:
    return classification.top_indicator_rates(_labelled(spark, d)).select("tp", "fp", "fn", "tn", "scores", "accuracy", "precision", "recall", "specificity", "f1", "threat", "mcc")


_add("classification_top_rates", _top_rates, f"""WITH {_LAB}, g AS (SELECT score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM z GROUP BY score), c AS (SELECT *, sum(p + n) OVER (ORDER BY score DESC) - p - n AS before, sum(p) OVER () AS every FROM g),
  s AS (SELECT *, greatest(0, least(1, (every - before) / (p + n))) AS share FROM c), m AS (SELECT sum(p * share) AS tp, sum(n * share) AS fp, sum(p * (1 - share)) AS fn, sum(n * (1 - share)) AS tn FROM s)
  SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tn, 6) AS tn, round(tp + fp + fn + tn, 6) AS scores, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS threat, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM m""")


# one gradient step from vectors of embeddings: norms, which SQL can't state for sampled losses
def _trained_norms(name: str, loss: str, assumption: str, spark: SparkSession, d: str) -> DataFrame:
    trained, _ = fitting.train(embedded(spark, d, name), facts(spark, d), fitting.Trainer(loss=loss, optimizer="adagrad", rate=0.05, negatives=2), 1, assumption)
    return trained.entities.select("id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


_add("train_sampled_transe", partial(_trained_norms, "transe", "nssa", "sampled"))
_add("train_all_distmult", partial(_trained_norms, "distmult", "bce", "all"))

#: The queries of this module.
NAMES = tuple(n for n in QUERIES if n not in _BEFORE)
