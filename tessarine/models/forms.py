"""Interaction functions of head, relation and tail vectors, for scoring and training alike.

A form names the parts of an entity's and a relation's vector with their shapes, the weights that all triples share,
and a function of lists of ``tape.Value`` whose leading axes broadcast: (n, 1, d) heads against (1, m, d) tails give
(n, m) scores. Shapes are products of dimensions by name, such as ("k", "d"); an empty shape is a number.
Scores grow with plausibility. Sums run over the last axis, so a triple's score hardly depends on its batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from math import prod

import numpy as np

from . import tape
from .tape import Value

Parts = list[Value]
Shape = tuple[str, ...]


@dataclass(frozen=True)
class Form:
    """``score(h, r, t, w, **settings)``; ``sides``: the places of an entity's parts that heads and tails use (all if empty); ``product``: the score is the sum of h r t, so blocks are matrix products."""

    score: Callable[..., Value]
    entity: tuple[Shape, ...] = (("d",),)
    relation: tuple[Shape, ...] = (("d",),)
    weights: dict[str, Shape] = field(default_factory=dict)
    settings: dict[str, object] = field(default_factory=dict)
    sides: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    product: bool = False

    def sizes(self, dims: dict[str, int]) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], dict[str, tuple[int, ...]]]:
        """Shapes as numbers: of the entity's parts, the relation's parts and the weights."""
        made = lambda s: tuple(dims[n] if n in dims else int(n) for n in s)
        return [made(s) for s in self.entity], [made(s) for s in self.relation], {k: made(s) for k, s in self.weights.items()}

    def widths(self, dims: dict[str, int]) -> tuple[int, int]:
        """Numbers in an entity's and in a relation's whole vector."""
        entity, relation, _ = self.sizes(dims)
        return sum(map(prod, entity)), sum(map(prod, relation))

    def __call__(self, h: Value, r: Value, t: Value, weights: dict[str, Value], dims: dict[str, int]) -> Value:
        """Scores from whole vectors on the last axis."""
        entity, relation, _ = self.sizes(dims)
        heads, tails = parts(h, entity), parts(t, entity)
        if self.sides[0]:
            heads, tails = [heads[i] for i in self.sides[0]], [tails[i] for i in self.sides[1]]
        return self.score(heads, parts(r, relation), tails, weights, **self.settings)


def parts(v: Value, shapes: list[tuple[int, ...]]) -> Parts:
    """A vector cut into parts of these shapes."""
    out, at = [], 0
    for s in shapes:
        n = prod(s)
        out.append(v[..., at : at + n].reshape(*v.shape[:-1], *s))
        at += n
    return out


def _dot(a: Value, b: Value) -> Value:
    return (a * b).sum(-1)


def _apply(m: Value, v: Value) -> Value:
    """Matrix times vector."""
    return (m * v.reshape(*v.shape[:-1], 1, v.shape[-1])).sum(-1)


def _clamped(v: Value, most: float = 1.0) -> Value:
    """Scaled down to a norm of ``most``."""
    n = tape.sqrt((v * v).sum(-1, keepdims=True) + 1e-24)
    return v * tape.minimum(most / n, 1.0)


def _distance(h, r, t, w, p=2, power=False):
    return -tape.norm(h[0] + r[0] - t[0], p, power)


def _um(h, r, t, w, p=2, power=True):
    return -tape.norm(h[0] - t[0], p, power)


def _transf(h, r, t, w):
    return 2 * _dot(h[0], t[0]) + _dot(r[0], t[0]) - _dot(h[0], r[0])


def _product(h, r, t, w):
    return (h[0] * r[0] * t[0]).sum(-1)


def _distma(h, r, t, w):
    return _dot(h[0], r[0]) + _dot(r[0], t[0]) + _dot(h[0], t[0])


def _complex(h, r, t, w):
    (a, b), (c, d), (e, f) = h, r, t
    return ((a * c - b * d) * e + (a * d + b * c) * f).sum(-1)


def _rotate(h, r, t, w, p=2, power=False):
    turn, over = tape.cos(r[0]), tape.sin(r[0])
    re, im = h[0] * turn - h[1] * over - t[0], h[0] * over + h[1] * turn - t[1]
    size = tape.sqrt(re * re + im * im + 1e-30)
    return -tape.norm(size, p, power)


def _toruse(h, r, t, w, p=2, power=False):
    d = tape.fraction(h[0] + r[0] - t[0])
    return -tape.norm(tape.minimum(d, 1 - d), p, power)


def _correlation(h: Value, t: Value) -> Value:
    """Element k is the sum over j of h[j] t[(j + k) mod d]."""
    d = h.shape[-1]
    turned = t[..., (np.arange(d)[:, None] + np.arange(d)) % d]
    return (turned * h.reshape(*h.shape[:-1], 1, d)).sum(-1)


def _hole(h, r, t, w):
    return _dot(r[0], _correlation(h[0], t[0]))


def _rescal(h, r, t, w):
    return _dot(h[0], _apply(r[0], t[0]))


def _structured(h, r, t, w, p=1, power=False):
    return -tape.norm(_apply(r[0], h[0]) - _apply(r[1], t[0]), p, power)


def _transr(h, r, t, w, p=2, power=True, most=1.0):
    project = lambda e: _clamped(_apply(r[1], e), most)
    return -tape.norm(project(h[0]) + r[0] - project(t[0]), p, power)


def _resized(v: Value, n: int) -> Value:
    """The first n numbers, or with zeros behind."""
    if v.shape[-1] >= n:
        return v[..., :n]
    return tape.concat([v, Value(np.zeros((*v.shape[:-1], n - v.shape[-1])))])


def _transd(h, r, t, w, p=2, power=True):
    def project(e, own):
        along = (own * e).sum(-1, keepdims=True)
        return _clamped(r[1] * along + _resized(e, r[1].shape[-1]))

    return -tape.norm(project(*h) + r[0] - project(*t), p, power)


def _transh(h, r, t, w, p=2, power=False):
    normal = r[0] / tape.sqrt((r[0] * r[0]).sum(-1, keepdims=True) + 1e-24)
    flat = lambda e: e - (e * normal).sum(-1, keepdims=True) * normal
    return -tape.norm(flat(h[0]) + r[1] - flat(t[0]), p, power)


def _variance(v: Value) -> Value:
    """Variances are kept away from zero."""
    return tape.maximum(tape.absolute(v), 0.05)


def _kl(h, r, t, w, exact=True):
    mean, spread, rel = h[0] - t[0] - r[0], _variance(h[1]) + _variance(t[1]), _variance(r[1])
    out = (spread / rel + mean * mean / rel + tape.log(rel) - tape.log(spread)).sum(-1)
    return -0.5 * (out - float(mean.shape[-1])) if exact else -out


def _likelihood(h, r, t, w, exact=True):
    mean, spread = h[0] - t[0] - r[0], _variance(h[1]) + _variance(t[1]) + _variance(r[1])
    out = (mean * mean / spread + tape.log(spread)).sum(-1)
    return out + mean.shape[-1] * float(np.log(2 * np.pi)) if exact else out


def _mure(h, r, t, w, p=2, power=False):
    return h[1] + t[1] - tape.norm(h[0] * r[0] + r[1] - t[0], p, power)


def averaged(base: Callable[..., Value]) -> Callable[..., Value]:
    """The mean of ``base`` over the first half of all parts and, with head and tail exchanged, the second half."""

    def run(h: Parts, r: Parts, t: Parts, w: dict[str, Value], **settings) -> Value:
        a, b = len(h) // 2, len(r) // 2
        return 0.5 * (base(h[:a], r[:b], t[:a], w, **settings) + base(t[a:], r[b:], h[a:], w, **settings))

    return run


def _pairre(h, r, t, w, p=1, power=False):
    return -tape.norm(h[0] * r[0] - t[0] * r[1], p, power)


def _linearre(h, r, t, w, p=1, power=False):
    return -tape.norm(h[0] * r[0] - t[0] * r[1] + r[2], p, power)


def _triplere(h, r, t, w, u=1.0, p=1, power=False):
    return -tape.norm(h[0] * (r[0] + u) - t[0] * (r[1] + u) + r[2], p, power)


def _hamilton(a: Parts, b: Parts) -> Parts:
    (a0, a1, a2, a3), (b0, b1, b2, b3) = a, b
    return [a0 * b0 - a1 * b1 - a2 * b2 - a3 * b3, a0 * b1 + a1 * b0 + a2 * b3 - a3 * b2, a0 * b2 - a1 * b3 + a2 * b0 + a3 * b1, a0 * b3 + a1 * b2 - a2 * b1 + a3 * b0]


def _quate(h, r, t, w):
    return -sum((_dot(q, x) for q, x in zip(_hamilton(h, r)[1:], t[1:], strict=True)), _dot(_hamilton(h, r)[0], t[0]))


def _crosse(h, r, t, w):
    crossed = r[1] * h[0]
    return _dot(tape.tanh(w["bias"] + crossed + crossed * r[0]), t[0])


def _proje(h, r, t, w):
    return tape.sigmoid(_dot(tape.tanh(w["head"] * h[0] + w["relation"] * r[0] + w["bias"]), t[0]) + w["outer"])


def _cp(h, r, t, w):
    return (h[0] * r[0] * t[0]).sum(-1)


def _multilinear(h, r, t, w):
    a, b, c = h[0], r[0], t[0]
    core = w["core"]
    left = (core * a.reshape(*a.shape[:-1], a.shape[-1], 1, 1)).sum(-3)
    left = (left * b.reshape(*b.shape[:-1], b.shape[-1], 1)).sum(-2)
    return _dot(left, c)


def _layer(x: Value, m: Value, bias: Value) -> Value:
    return _apply(m, x) + bias


def _ermlp(h, r, t, w):
    return _dot(tape.relu(_layer(tape.concat([h[0], r[0], t[0]]), w["inner"], w["bias"])), w["outer"]) + w["last"]


def _ermlpe(h, r, t, w):
    x = tape.relu(_layer(tape.concat([h[0], r[0]]), w["inner"], w["bias"]))
    return _dot(tape.relu(_layer(x, w["outer"], w["last"])), t[0])


def _ntn(h, r, t, w):
    bilinear, left, right, bias, u = r
    a, b = h[0], t[0]
    slices = (bilinear * b.reshape(*b.shape[:-1], 1, 1, b.shape[-1])).sum(-1)
    slices = (slices * a.reshape(*a.shape[:-1], 1, a.shape[-1])).sum(-1)
    return _dot(u, tape.tanh(slices + _apply(left, a) + _apply(right, b) + bias))


def _convkb(h, r, t, w):
    """Filters over the three vectors side by side: each is three factors and a summand."""
    lift = lambda v: v.reshape(*v.shape[:-1], 1, v.shape[-1])
    f, bias = w["filters"], w["bias"]
    column = lambda k: f[:, k : k + 1]
    maps = tape.relu(lift(h[0]) * column(0) + lift(r[0]) * column(1) + lift(t[0]) * column(2) + bias.reshape(-1, 1))
    return (maps * w["outer"]).sum(-1).sum(-1) + w["last"]


def _conve(h, r, t, w, height=2):
    """The head's and the relation's vectors as rows of one image, a convolution, a layer, and the tail."""
    d = h[0].shape[-1]
    wide = d // height
    image = tape.concat([h[0], r[0]])
    kernels, n = w["kernels"], 2 * height
    k_high, k_wide = kernels.shape[1], kernels.shape[2]
    high, across = n - k_high + 1, wide - k_wide + 1
    rows, columns = np.arange(high)[:, None, None, None], np.arange(across)[None, :, None, None]
    at = (rows + np.arange(k_high)[:, None]) * wide + columns + np.arange(k_wide)
    patches = image[..., at.reshape(high * across, k_high * k_wide)]
    flat = kernels.reshape(kernels.shape[0], 1, k_high * k_wide)
    maps = (patches.reshape(*patches.shape[:-2], 1, *patches.shape[-2:]) * flat).sum(-1) + w["map_bias"].reshape(-1, 1)
    maps = tape.relu(maps)
    x = tape.relu(_layer(maps.reshape(*maps.shape[:-2], maps.shape[-1] * maps.shape[-2]), w["dense"], w["dense_bias"]))
    return _dot(x, t[0]) + t[1]


def _box(base: Value, delta: Value, size: Value) -> tuple[Value, Value]:
    """Lower and upper corner of a relation's box; its sides are scaled to a geometric mean of the size."""
    scale = tape.exp(tape.log(tape.absolute(delta) + 1e-12).mean(-1, keepdims=True))
    half = 0.5 * (tape.elu(size.reshape(*size.shape, 1)) + 1) * (delta / scale)
    return tape.minimum(base - half, base + half), tape.maximum(base - half, base + half)


def _to_box(point: Value, low: Value, high: Value) -> Value:
    """Element-wise distance: small within the box, steep without."""
    width = high - low
    grown, off = width + 1, tape.absolute(point - 0.5 * (low + high))
    inside = (point.x >= low.x) & (point.x <= high.x)
    return tape.where(inside, off / grown, off * grown - 0.5 * width * (grown - 1 / grown))


def _boxe(h, r, t, w, bounded=True, p=2, power=False):
    def side(position, bump, box):
        low, high = _box(*box)
        point = position + bump
        if bounded:
            point, low, high = tape.tanh(point), tape.tanh(low), tape.tanh(high)
        return -tape.norm(_to_box(point, low, high), p, power)

    return side(h[0], t[1], r[:3]) + side(t[0], h[1], r[3:])


#: Fixed values: (block of the head, of the relation, of the tail, sign) of four symmetric blocks.
AUTOSF = ((0, 0, 0, 1), (1, 1, 1, 1), (2, 2, 2, 1), (3, 3, 3, 1))


def _autosf(h, r, t, w, coefficients=AUTOSF):
    total = None
    for i, j, k, sign in coefficients:
        term = (h[i] * r[j] * t[k]).sum(-1) * float(sign)
        total = term if total is None else total + term
    return total


def _transformer(h, r, t, w, heads=2):
    """One encoder layer over the tokens head and relation, their sum projected, against the tail."""
    normal = lambda v: (v - v.mean(-1, keepdims=True)) / tape.sqrt(((v - v.mean(-1, keepdims=True)) ** 2).mean(-1, keepdims=True) + 1e-5)
    x = tape.stack([h[0] + w["position"][0], r[0] + w["position"][1]])
    d = x.shape[-1]
    size = d // heads
    asked, given, taken = (x @ w[n] for n in ("query", "key", "value"))
    out = []
    for i in range(heads):
        cut = (Ellipsis, slice(i * size, (i + 1) * size))
        share = tape.softmax((asked[cut] @ given[cut].swap()) * size**-0.5)
        out.append(share @ taken[cut])
    x = normal(x + tape.concat(out) @ w["mix"])
    x = normal(x + tape.relu(x @ w["up"]) @ w["down"])
    return _dot(x.sum(-2) @ w["final"], t[0])


def _literal(h, r, t, w, base=_product):
    """Entity vectors joined with their literals and projected, then ``base``."""
    mixed = lambda e: _layer(tape.concat([e[0], e[1]]), w["project"], w["bias"])
    return base([mixed(h)], r, [mixed(t)], w)


def _literal_complex(h, r, t, w):
    def mixed(e):
        return [tape.tanh(_layer(tape.concat([e[i], e[2]]), w[f"project_{i}"], w[f"bias_{i}"])) for i in (0, 1)]

    return _complex(mixed(h), r, mixed(t), w)


def _literal_gated(h, r, t, w):
    """A gate decides for each element between the vector and what its literals make of it."""

    def mixed(e):
        whole = tape.concat([e[0], e[1]])
        gate = tape.sigmoid(_layer(e[0], w["gate_entity"], w["gate_bias"]) + _apply(w["gate_literal"], e[1]))
        return gate * tape.tanh(_layer(whole, w["project"], w["bias"])) + (1 - gate) * e[0]

    return _product([mixed(h)], r, [mixed(t)], w)


_D, _K, _ONE = ("d",), ("k",), ()

#: Every form by name. Dimensions: d of entities, k of relations or slices, and those that ``defaults`` names.
FORMS: dict[str, Form] = {
    "transe": Form(partial(_distance, p=1)),
    "transe_l2": Form(_distance),
    "um": Form(_um, relation=()),
    "transf": Form(_transf),
    "distmult": Form(_product, product=True),
    "distma": Form(_distma),
    "complex": Form(_complex, (_D, _D), (_D, _D)),
    "rotate": Form(_rotate, (_D, _D)),
    "toruse": Form(_toruse),
    "hole": Form(_hole),
    "rescal": Form(_rescal, relation=(("d", "d"),)),
    "se": Form(_structured, relation=(("d", "d"), ("d", "d"))),
    "transr": Form(_transr, relation=(_K, ("k", "d"))),
    "transd": Form(_transd, (_D, _D), (_K, _K)),
    "transh": Form(_transh, relation=(_D, _D)),
    "kg2e": Form(_kl, (_D, _D), (_D, _D)),
    "kg2e_likelihood": Form(_likelihood, (_D, _D), (_D, _D)),
    "mure": Form(_mure, (_D, _ONE, _ONE), (_D, _D), sides=((0, 1), (0, 2))),
    "simple": Form(averaged(_product), (_D, _D), (_D, _D)),
    "pairre": Form(_pairre, relation=(_D, _D)),
    "linearre": Form(_linearre, relation=(_D, _D, _D)),
    "triplere": Form(_triplere, relation=(_D, _D, _D)),
    "quate": Form(_quate, (_D,) * 4, (_D,) * 4),
    "crosse": Form(_crosse, relation=(_D, _D), weights={"bias": _D}),
    "proje": Form(_proje, weights={"head": _D, "relation": _D, "bias": _D, "outer": _ONE}),
    "cp": Form(_cp, (_D, _D), sides=((0,), (1,))),
    "tucker": Form(_multilinear, relation=(_K,), weights={"core": ("d", "k", "d")}),
    "multilinear_tucker": Form(_multilinear, (_D, ("f",)), (_K,), {"core": ("d", "k", "f")}, sides=((0,), (1,))),
    "ermlp": Form(_ermlp, weights={"inner": ("m", "3d"), "bias": ("m",), "outer": ("m",), "last": _ONE}),
    "ermlpe": Form(_ermlpe, weights={"inner": ("m", "2d"), "bias": ("m",), "outer": ("d", "m"), "last": _D}),
    "ntn": Form(_ntn, relation=(("k", "d", "d"), ("k", "d"), ("k", "d"), _K, _K)),
    "convkb": Form(_convkb, weights={"filters": ("m", "3"), "bias": ("m",), "outer": ("m", "d"), "last": _ONE}),
    "conve": Form(_conve, (_D, _ONE), weights={"kernels": ("m", "2", "3"), "map_bias": ("m",), "dense": ("d", "maps"), "dense_bias": _D}),
    "boxe": Form(_boxe, (_D, _D), (_D, _D, _ONE, _D, _D, _ONE)),
    "autosf": Form(_autosf, (_D,) * 4, (_D,) * 4),
    "transformer": Form(_transformer, weights={"position": ("2", "d"), "query": ("d", "d"), "key": ("d", "d"), "value": ("d", "d"), "mix": ("d", "d"), "up": ("d", "m"), "down": ("m", "d"), "final": ("d", "d")}),
    "distmult_literal": Form(_literal, (_D, ("l",)), weights={"project": ("d", "d+l"), "bias": _D}),
    "distmult_literal_gated": Form(_literal_gated, (_D, ("l",)), weights={"project": ("d", "d+l"), "bias": _D, "gate_entity": ("d", "d"), "gate_literal": ("d", "l"), "gate_bias": _D}),
    "complex_literal": Form(_literal_complex, (_D, _D, ("l",)), (_D, _D), {f"{n}_{i}": s for i in (0, 1) for n, s in (("project", ("d", "d+l")), ("bias", _D))}),
}


def dimensions(form: Form, d: int, **others: int) -> dict[str, int]:
    """All dimensions that the form's shapes name, from that of entities: k, f and m are d and l is 1 unless given."""
    dims = {"d": d, "k": d, "f": d, "m": d, "l": 1} | others
    dims |= {"2d": 2 * d, "3d": 3 * d, "d+l": d + dims["l"]}
    height = int(form.settings.get("height", 2))
    dims["maps"] = dims["m"] * (2 * height - 1) * (d // height - 2)
    return dims


def clamped(score: Value, low: float | None = None, high: float | None = None) -> Value:
    """Scores within bounds."""
    if low is not None:
        score = tape.maximum(score, low)
    return score if high is None else tape.minimum(score, high)


def affine(score: Value, log_scale: float = 0.0, bias: float = 0.0) -> Value:
    """A growing affine function of scores."""
    return score * float(np.exp(log_scale)) + bias
