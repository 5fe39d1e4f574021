"""Model inference over a grid: numpy layers on Arrow batches, weights shipped once.

The network: circular encodings of latitude and longitude are projected,
then pass residual blocks whose outputs are scaled and shifted by features
of the week; heads give a logit for each species and features of the
environment, and species may also be told from these.  Only inference is
here; training a network needs a library that Spark does not bring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from phenogrid.operators.stored import dealt

LAYERNORM_EPS = 1e-4
POINTS_PER_TASK = 16_384


@dataclass(frozen=True)
class Sizes:
    """Dimensions that follow from a model's scale."""

    embed: int
    bottleneck: int
    env: int
    encoder_blocks: int
    species_blocks: int
    env_blocks: int
    dropout: float
    species_dropout: float


def sizes(scale: float) -> Sizes:
    def steps(at_one: int, unit: int) -> int:
        return max(unit, round(at_one * scale / unit) * unit)

    drop = 0.1 + 0.025 * (scale - 1)
    return Sizes(steps(512, 64), steps(128, 32), steps(256, 64), max(1, round(4 * scale)), max(1, round(2 * scale)), max(1, round(scale)), min(max(drop, 0.0), 0.3), min(max(drop + 0.1, 0.0), 0.4))


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by a rational approximation (absolute error below 2e-7)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
    mean, var = x.mean(axis=1, keepdims=True), x.var(axis=1, keepdims=True)
    return (x - mean) / np.sqrt(var + LAYERNORM_EPS) * gain + shift


def circular(angle: np.ndarray, harmonics: int) -> np.ndarray:
    scaled = angle[:, None] * np.arange(1, harmonics + 1)
    return np.concatenate((np.sin(scaled), np.cos(scaled)), axis=1)


def random_weights(n_species: int, scale: float = 0.25, harmonics: int = 4, seed: int = 0, n_env: int = 0, habitat: bool = False) -> dict:
    """Weights of a small untrained model, for tests and demonstrations; with ``n_env`` an environment head, and ``habitat`` the path through it."""
    rng, s = np.random.default_rng(seed), sizes(scale)
    dense = lambda a, b: (rng.normal(0, 1 / math.sqrt(a), (a, b)), rng.normal(0, 0.1, b))
    norm = lambda n: (rng.normal(1, 0.1, n), rng.normal(0, 0.1, n))
    block = lambda n: {"norm_a": norm(n), "a": dense(n, n), "norm_b": norm(n), "b": dense(n, n)}

    def head(inputs: int, width: int, blocks: int, outputs: int, squeeze: int = 0) -> dict:
        """Residual blocks of one width, behind a projection to it if the input has another, and a last layer or two."""
        last = {"squeeze": dense(width, squeeze), "out": dense(squeeze, outputs)} if squeeze else {"out": dense(width, outputs)}
        return {"input": dense(inputs, width) if inputs != width else None, "blocks": [block(width) for _ in range(blocks)], "norm": norm(width)} | last

    weights = {
        "harmonics": harmonics,
        "input": dense(4 * harmonics, s.embed),
        "blocks": [block(s.embed) | {"film_a": dense(2 * harmonics, s.embed), "film_b": dense(s.embed, 2 * s.embed)} for _ in range(s.encoder_blocks)],
        "norm": norm(s.embed),
        "species": head(s.embed, s.embed, s.species_blocks, n_species, s.bottleneck),
    }
    if n_env:
        weights["env"] = head(s.embed, s.env, s.env_blocks, n_env)
    if habitat:
        weights |= {"habitat": head(n_env, s.env, s.env_blocks, n_species, s.bottleneck), "gate": dense(s.embed, n_species)}
    return weights


def _dense(x: np.ndarray, layer: tuple) -> np.ndarray:
    return x @ layer[0] + layer[1]


def _residual(x: np.ndarray, block: dict) -> np.ndarray:
    inner = _dense(gelu(layer_norm(x, *block["norm_a"])), block["a"])
    return x + _dense(gelu(layer_norm(inner, *block["norm_b"])), block["b"])


def _head(x: np.ndarray, head: dict) -> np.ndarray:
    x = x if head["input"] is None else _dense(x, head["input"])
    for block in head["blocks"]:
        x = _residual(x, block)
    x = layer_norm(x, *head["norm"])
    return _dense(gelu(_dense(x, head["squeeze"])) if "squeeze" in head else x, head["out"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def encode(weights: dict, lat: np.ndarray, lon: np.ndarray, week: np.ndarray) -> np.ndarray:
    """Embeddings of points and weeks: features of the week scale and shift what each spatial block gives."""
    h = weights["harmonics"]
    x = _dense(np.concatenate((circular(np.radians(lat), h), circular(np.radians(lon), h)), axis=1), weights["input"])
    when = circular(2 * math.pi * (week - 1) / 48, h)
    for block in weights["blocks"]:
        scale, shift = np.split(_dense(gelu(_dense(when, block["film_a"])), block["film_b"]), 2, axis=1)
        x = _residual(x, block) * (1 + np.tanh(scale)) + shift
    return layer_norm(x, *weights["norm"])


def forward_all(weights: dict, lat: np.ndarray, lon: np.ndarray, week: np.ndarray) -> dict[str, np.ndarray]:
    """``probs``, one row a point and one column a species, and ``env``, the environment's features, if the model has that head.

    With a habitat path, species are also told from the predicted
    environment, and a gate for each species mixes both.
    """
    x = encode(weights, lat, lon, week)
    logits, out = _head(x, weights["species"]), {}
    if "env" in weights:
        out["env"] = _head(x, weights["env"])
    if "habitat" in weights:
        gate = _sigmoid(_dense(x, weights["gate"]))
        logits = gate * logits + (1 - gate) * _head(out["env"], weights["habitat"])
    return {"probs": _sigmoid(logits)} | out


def forward(weights: dict, lat: np.ndarray, lon: np.ndarray, week: np.ndarray) -> np.ndarray:
    """Probabilities, one row a point and one column a species."""
    return forward_all(weights, lat, lon, week)["probs"]


def predict(points: DataFrame, weights: dict) -> DataFrame:
    """``lat, lon, week`` with ``probs``, an array in species order, and ``env``, if the model has that head.  The weights' size is the model's, not the data's."""
    sent = points.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for pdf in batches:
            found = forward_all(sent.value, pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float), pdf["week"].to_numpy(float))
            yield pd.DataFrame({"lat": pdf["lat"], "lon": pdf["lon"], "week": pdf["week"]} | {k: list(v.astype(np.float64)) for k, v in found.items()})

    return dealt(points.select("lat", "lon", "week"), POINTS_PER_TASK).mapInPandas(run, "lat double, lon double, week int, probs array<double>" + (", env array<double>" if "env" in weights else ""))
