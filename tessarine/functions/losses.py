"""Loss terms as SQL that Spark and DuckDB read alike. {s}: score, {y}: label 0 or 1, {p}, {n}: positive and negative score."""

from __future__ import annotations

_SOFTPLUS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


def softplus(x: str) -> str:
    return _SOFTPLUS.format(x=f"({x})")


POINTWISE = {
    "bce": lambda s, y: f"({softplus(s)} - {y} * {s})",
    "mse": lambda s, y: f"power({s} - {y}, 2)",
    "pointwise_hinge": lambda s, y: f"greatest(0, 1 - (2 * {y} - 1) * {s})",
    "soft_pointwise_hinge": lambda s, y: softplus(f"1 - (2 * {y} - 1) * {s}"),
    "softplus": lambda s, y: softplus(f"-(2 * {y} - 1) * {s}"),
    "focal": lambda s, y: f"(power({y} + (1 - 2 * {y}) / (1 + exp(-{s})), 2) * ({softplus(s)} - {y} * {s}))",
    "bce_after_sigmoid": lambda s, y: f"-({y} * ln(greatest(1 / (1 + exp(-{s})), 1e-44)) + (1 - {y}) * ln(greatest(1 / (1 + exp({s})), 1e-44)))",
    "bce_weighted": lambda s, y: f"(2.0 * {y} * {softplus(f'-{s}')} + (1 - {y}) * {softplus(s)})",
    "focal_weighted": lambda s, y: f"((0.25 * {y} + 0.75 * (1 - {y})) * power({y} + (1 - 2 * {y}) / (1 + exp(-{s})), 2) * ({softplus(s)} - {y} * {s}))",
    "double_margin": lambda s, y: f"({y} * greatest(0, 1 - {s}) + (1 - {y}) * greatest(0, 0.5 + {s}))",
}

PAIRWISE = {
    "margin_ranking": lambda p, n: f"greatest(0, 1 + {n} - {p})",
    "soft_margin_ranking": lambda p, n: softplus(f"1 + {n} - {p}"),
    "pairwise_logistic": lambda p, n: softplus(f"{n} - {p}"),
}


def _array_terms(duck: bool):
    """(sum of a term over an array, its greatest element) in Spark SQL or in DuckDB's."""
    if duck:
        return lambda a, term: f"list_sum(list_transform({a}, lambda x: {term}))", lambda a: f"list_max({a})"
    return lambda a, term: f"aggregate({a}, 0D, (acc, x) -> acc + {term})", lambda a: f"array_max({a})"


def setwise(name: str, p: str, n: str, duck: bool = False, margin: float | None = None, temperature: float | None = None) -> str:
    """A loss of one positive score ``p`` and its array ``n`` of negative scores, as SQL of Spark or (``duck``) DuckDB.

    cross_entropy: of the positive among all; infonce: the same with a margin (0.02) off the positive and divided by a
    temperature (0.05); nssa (margin 9) and adversarial_bce (0): half of the positive's log-sigmoid term and of the negatives', which are
    weighed by a softmax of their scores times the temperature (1). No negatives leave the positive's part.
    """
    total, most = _array_terms(duck)
    if name in ("cross_entropy", "infonce"):
        m, t = (0.0, 1.0) if name == "cross_entropy" else (0.02 if margin is None else margin, 0.05 if temperature is None else temperature)
        own, top = f"(({p} - {m}) / {t})", f"greatest(({p} - {m}) / {t}, coalesce({most(n)}, {p}) / {t})"
        return f"({top} + ln(exp({own} - {top}) + coalesce({total(n, f'exp(x / {t} - {top})')}, 0)) - {own})"
    m, t = (9.0 if margin is None else margin) if name == "nssa" else 0.0, 1.0 if temperature is None else temperature
    top = f"coalesce({most(n)}, 0) * {t}"
    weigh = lambda term: total(n, f"exp(x * {t} - {top}) * {term}")
    return f"0.5 * ({softplus(f'-({p} + {m})')} + coalesce({weigh(softplus(f'x + {m}'))} / nullif({weigh('1')}, 0), 0))"


SETWISE = ("cross_entropy", "infonce", "nssa", "adversarial_bce")


def label_smoothing(y: str, epsilon: float, classes: int = 2) -> str:
    """Labels moved towards the other classes: 1 - epsilon where one was right, epsilon / (classes - 1) elsewhere."""
    return f"((1 - {epsilon}) * {y} + {epsilon / (classes - 1)} * (1 - {y}))"


def regularizers(dim: int, v: str = "v") -> dict[str, str]:
    """Penalties of one vector, in Spark SQL."""
    total = lambda term: f"aggregate(sequence(0, {dim - 1}), 0D, (a, i) -> a + {term})"
    return {"lp1": total(f"abs({v}[i])"), "lp2": f"sqrt({total(f'power({v}[i], 2)')})", "powersum3": total(f"power(abs({v}[i]), 3)"), "norm_limit": f"greatest(0, {total(f'power({v}[i], 2)')} - 1)"}


def regularizers_sql(dim: int, v: str = "v") -> dict[str, str]:
    total = lambda term: f"list_sum(list_transform(range(1, {dim + 1}), lambda i: {term}))"
    return {"lp1": total(f"abs({v}[i])"), "lp2": f"sqrt({total(f'power({v}[i], 2)')})", "powersum3": total(f"power(abs({v}[i]), 3)"), "norm_limit": f"greatest(0, {total(f'power({v}[i], 2)')} - 1)"}
