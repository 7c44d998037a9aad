"""Everything that can be chosen by name, by kind."""

from __future__ import annotations

import re

from ..functions import losses
from ..models import fitting
from ..models.forms import FORMS
from ..models.objectives import LOSSES, PENALTIES
from ..operators import negatives
from ..sources.datasets import KNOWN

_METRICS = (
    "count", "arithmetic_mean_rank", "inverse_arithmetic_mean_rank", "geometric_mean_rank", "inverse_geometric_mean_rank", "harmonic_mean_rank", "inverse_harmonic_mean_rank", "median_rank", "inverse_median_rank",
    "variance", "standard_deviation", "median_absolute_deviation", "adjusted_arithmetic_mean_rank", "adjusted_arithmetic_mean_rank_index", "z_arithmetic_mean_rank", "adjusted_geometric_mean_rank_index",
    "z_geometric_mean_rank", "adjusted_inverse_harmonic_mean_rank", "z_inverse_harmonic_mean_rank", "hits_at_k", "adjusted_hits_at_k", "z_hits_at_k",
)

#: Other names of metrics.
SYNONYMS = {"mean_rank": "arithmetic_mean_rank", "mr": "arithmetic_mean_rank", "mrr": "inverse_harmonic_mean_rank", "mean_reciprocal_rank": "inverse_harmonic_mean_rank", "amr": "adjusted_arithmetic_mean_rank", "amri": "adjusted_arithmetic_mean_rank_index", "gmr": "geometric_mean_rank", "hmr": "harmonic_mean_rank"}

REGISTRY: dict[str, tuple[str, ...]] = {
    "model": tuple(FORMS),
    "loss": tuple(LOSSES),
    "setwise_loss": losses.SETWISE,
    "regularizer": tuple(PENALTIES),
    "negative_sampler": ("basic", "bernoulli", "pseudo_typed"),
    "corruption": tuple(negatives.SAMPLERS),
    "optimizer": ("sgd", "adagrad", "adam"),
    "schedule": ("constant", "exponential", "stepped", "cosine"),
    "initializer": ("uniform", "normal", "unit", "xavier_uniform", "xavier_normal", "phases", "zeros", "ones"),
    "constrainer": ("unit", "ball"),
    "training_loop": ("sampled", "all", "symmetric"),
    "evaluator": ("rank", "sampled", "classification"),
    "rank_metric": _METRICS,
    "split": ("random", "coverage", "cleanup", "random_cleanup"),
    "stopper": ("none", "early"),
    "tracker": ("memory", "console", "csv", "json", "parquet"),
    "dataset": tuple(KNOWN),
}
_ALIASES = {"training_loop": {"slcwa": "sampled", "lcwa": "all", "symmetriclcwa": "symmetric"}, "model": {"transe_l1": "transe"}, "rank_metric": SYNONYMS}


def _plain(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", name).lower()


def resolve(kind: str, name: str) -> str:
    """The registered name that ``name`` means, whatever its case and separators; ValueError names the choices.

    A metric may have a place behind an at sign or an underscore, such as hits@10.
    """
    if kind not in REGISTRY:
        raise ValueError(f"no kind {kind}; there are {', '.join(REGISTRY)}")
    names = {_plain(n): n for n in REGISTRY[kind]} | {_plain(a): n for a, n in _ALIASES.get(kind, {}).items()}
    plain = _plain(name)
    if plain in names:
        return names[plain]
    if kind == "rank_metric" and (found := re.fullmatch(r"(z_|adjusted_)?hits(?:@|_at_|_)?(\d+)", name.lower())):
        return f"{found[1] or ''}hits_at_{found[2]}"
    # what is appended to say the kind
    stem = re.sub(f"{_plain(kind)}$", "", plain)
    if stem in names:
        return names[stem]
    raise ValueError(f"no {kind} {name}; there are {', '.join(REGISTRY[kind])}")


def metric_key(key: str) -> tuple[str, str, str]:
    """(side, rank type, metric) of a key [side.][type.]metric, by default both and realistic."""
    side, kind, rest = "both", "realistic", key.split(".")
    if rest[-1].isdigit() and len(rest) > 1:
        rest = [*rest[:-2], f"{rest[-2]}_{rest[-1]}" if rest[-2].endswith("at") else f"{rest[-2]}@{rest[-1]}"]
    for word in rest[:-1]:
        if word in ("head", "tail", "relation", "both"):
            side = word
        elif word in ("optimistic", "realistic", "pessimistic", "avg", "best", "worst"):
            kind = {"avg": "realistic", "best": "optimistic", "worst": "pessimistic"}.get(word, word)
        else:
            raise ValueError(f"no side or rank type {word} in {key}")
    return side, kind, resolve("rank_metric", rest[-1])


def schedule(name: str, epochs: int, **settings):
    """A rate's factor by epoch."""
    name = resolve("schedule", name)
    made = {"constant": lambda: None, "exponential": lambda: fitting.exponential(settings.get("gamma", 0.95)), "stepped": lambda: fitting.stepped(settings.get("every", 10), settings.get("gamma", 0.5)), "cosine": lambda: fitting.cosine(epochs, settings.get("least", 0.0))}
    return made[name]()
