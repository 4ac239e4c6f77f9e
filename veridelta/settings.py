"""Settings of a run: layers of sections, later ones winning, and the variants of an ablation."""

from __future__ import annotations

import copy
import json

from pyspark.sql import SparkSession

from veridelta.operators.control import check_adaptive

#: Dotted paths that each variant changes.
ABLATIONS = {
    "full": {},
    "no_prune": {"pruning.pre_filter_enabled": False},
    "no_retrieve": {"retrieval.top_k": 0},
    "fixed_m": {"sampling.adaptive_M_enabled": False},
    "fixed_thresholds": {"thresholds.mode": "fixed"},
}


def layered(*layers: dict) -> dict:
    """Layers of sections as one: a section of two layers has the keys of both, the later one's values winning; anything that
    isn't a section is replaced."""
    out: dict = {}
    for layer in layers:
        for section, values in layer.items():
            both = isinstance(values, dict) and isinstance(out.get(section), dict)
            out[section] = out[section] | values if both else copy.deepcopy(values)
    return checked(out)


def load(spark: SparkSession, *paths: str) -> dict:
    """JSON files of sections as one; YAML ones too, where a reader for it is there. An empty file has no sections."""
    layers = []
    for path in paths:
        row = spark.read.option("wholetext", True).text(path).first()  # a settings file
        layers.append(_parsed(row[0] if row else "", path) or {})
    return layered(*layers)


def _parsed(text: str, path: str):
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text) if text.strip() else {}


def checked(settings: dict) -> dict:
    """``settings``, if the first draw of samples is less than the largest where it is adaptive."""
    own = settings.get("sampling", {})
    check_adaptive(bool(own.get("adaptive_M_enabled")), own.get("M_initial", 0), own.get("M_max", 1))
    return settings


def overridden(settings: dict, changes: dict) -> dict:
    """A copy with the values at some dotted paths changed; a path through a section that isn't there is an error."""
    out = copy.deepcopy(settings)
    for path, value in changes.items():
        *sections, key = path.split(".")
        at = out
        for section in sections:
            at = at[section]
        at[key] = value
    return out


def ablations(settings: dict) -> dict[str, dict]:
    """Every variant's settings."""
    return {name: overridden(settings, changes) for name, changes in ABLATIONS.items()}


def check_active(theta: float, beta: float, **sizes: int) -> None:
    """Probabilities must lie within [0, 1], sizes be positive."""
    for name, value in (("theta", theta), ("beta", beta)):
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be within [0, 1]")
    wrong = sorted(n for n, v in sizes.items() if v <= 0)
    if wrong:
        raise ValueError(f"must be positive: {', '.join(wrong)}")


def entailment_index(labels: dict[int, str], model: str, by_model: dict[str, int]) -> int:
    """Which output of a model is entailment: by its labels' names, else by the model's name, else an error."""
    named = [i for i, name in labels.items() if "entail" in name.lower() and "not" not in name.lower()]
    if len(named) == 1:
        return named[0]
    known = [i for part, i in by_model.items() if part.lower() in model.lower()]
    if len(known) == 1:
        return known[0]
    raise ValueError(f"which output of {model} is entailment isn't known")
