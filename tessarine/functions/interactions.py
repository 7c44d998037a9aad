"""Scores of triples from vectors of head, relation and tail, as expressions over array columns.

An interaction is a sum over dimensions of an element-wise term, wrapped once. Terms are SQL that Spark and
DuckDB read alike, with {h[k]}, {r[k]}, {t[k]} for the element in part k of ``parts`` equal parts of a vector
(two for complex numbers: real, imaginary; four for quaternions). What needs matrices, weights or parts of other
sizes is in ``models.forms``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Interaction(NamedTuple):
    parts: int
    term: str
    wrap: str = "{s}"


#: distance on the unit torus
_TORUS = "abs(({h[0]} + {r[0]} - {t[0]}) - floor({h[0]} + {r[0]} - {t[0]} + 0.5))"
_ROT_RE = "({h[0]} * cos({r[0]}) - {h[1]} * sin({r[0]}) - {t[0]})"
_ROT_IM = "({h[0]} * sin({r[0]}) + {h[1]} * cos({r[0]}) - {t[1]})"
# Hamilton product of the head and the relation
_Q = [
    "({h[0]} * {r[0]} - {h[1]} * {r[1]} - {h[2]} * {r[2]} - {h[3]} * {r[3]})",
    "({h[0]} * {r[1]} + {h[1]} * {r[0]} + {h[2]} * {r[3]} - {h[3]} * {r[2]})",
    "({h[0]} * {r[2]} - {h[1]} * {r[3]} + {h[2]} * {r[0]} + {h[3]} * {r[1]})",
    "({h[0]} * {r[3]} + {h[1]} * {r[2]} - {h[2]} * {r[1]} + {h[3]} * {r[0]})",
]

_MEAN = "({r[0]} - ({h[0]} - {t[0]}))"
_VAR_E, _VAR_R = "(greatest(abs({h[1]}), 0.05) + greatest(abs({t[1]}), 0.05))", "greatest(abs({r[1]}), 0.05)"

INTERACTIONS = {
    "transe_l1": Interaction(1, "abs({h[0]} + {r[0]} - {t[0]})", "-{s}"),
    "transe_l2": Interaction(1, "power({h[0]} + {r[0]} - {t[0]}, 2)", "-sqrt({s})"),
    "transf": Interaction(1, "({h[0]} + {r[0]}) * {t[0]} + {h[0]} * ({t[0]} - {r[0]})"),
    "distmult": Interaction(1, "{h[0]} * {r[0]} * {t[0]}"),
    "distma": Interaction(1, "{h[0]} * {r[0]} + {r[0]} * {t[0]} + {h[0]} * {t[0]}"),
    "unstructured": Interaction(1, "power({h[0]} - {t[0]}, 2)", "-{s}"),
    "toruse_l2": Interaction(1, f"power({_TORUS}, 2)", "-sqrt({s})"),
    "toruse_l1": Interaction(1, _TORUS, "-{s}"),
    "cp": Interaction(2, "{h[0]} * {r[0]} * {t[1]}"),
    "simple": Interaction(2, "0.5 * ({h[0]} * {r[0]} * {t[1]} + {t[0]} * {r[1]} * {h[1]})"),
    "complex": Interaction(2, "{h[0]} * {r[0]} * {t[0]} + {h[1]} * {r[0]} * {t[1]} + {h[0]} * {r[1]} * {t[1]} - {h[1]} * {r[1]} * {t[0]}"),
    "rotate": Interaction(2, f"power({_ROT_RE}, 2) + power({_ROT_IM}, 2)", "-sqrt({s})"),
    "quate": Interaction(4, " + ".join(f"{q} * {{t[{k}]}}" for k, q in enumerate(_Q)), "-{s}"),
    # Gaussians: means, then variances; the difference of the entities against the relation
    "kg2e_likelihood": Interaction(2, f"power({_MEAN}, 2) / ({_VAR_E} + {_VAR_R}) + ln({_VAR_E} + {_VAR_R})"),
    "kg2e_divergence": Interaction(2, f"{_VAR_E} / {_VAR_R} + power({_MEAN}, 2) / {_VAR_R} + ln({_VAR_R}) - ln({_VAR_E})", "-{s}"),
}


def _filled(x: Interaction, dim: int, at: str, base: int, h: str, r: str, t: str) -> str:
    part = dim // x.parts
    cells = {v: [f"{c}[{at} + {base + k * part}]" for k in range(x.parts)] for v, c in (("h", h), ("r", r), ("t", t))}
    return x.term.format(**cells)


def score(name: str, dim: int, h: str = "h", r: str = "r", t: str = "t") -> Column:
    """The score from three array columns of ``dim`` doubles; null where a vector is null."""
    x = INTERACTIONS[name]
    total = f"aggregate(sequence(0, {dim // x.parts - 1}), 0D, (acc, i) -> acc + ({_filled(x, dim, 'i', 0, h, r, t)}))"
    return F.expr(x.wrap.format(s=total))


def score_sql(name: str, dim: int, h: str = "h", r: str = "r", t: str = "t") -> str:
    """The same for DuckDB, whose lists begin at 1."""
    x = INTERACTIONS[name]
    return x.wrap.format(s=f"list_sum(list_transform(range(0, {dim // x.parts}), lambda i: {_filled(x, dim, 'i', 1, h, r, t)}))")


def hole(dim: int, h: str = "h", r: str = "r", t: str = "t") -> Column:
    """Relation times the circular correlation of head and tail."""
    row = f"aggregate(sequence(0, {dim - 1}), 0D, (b, j) -> b + {h}[j] * {t}[(i + j) % {dim}])"
    return F.expr(f"aggregate(sequence(0, {dim - 1}), 0D, (a, i) -> a + {r}[i] * {row})")


def hole_sql(dim: int, h: str = "h", r: str = "r", t: str = "t") -> str:
    row = f"list_sum(list_transform(range(0, {dim}), lambda j: {h}[j + 1] * {t}[(i + j) % {dim} + 1]))"
    return f"list_sum(list_transform(range(0, {dim}), lambda i: {r}[i + 1] * {row}))"
