"""Small dense networks, trained by full-batch data-parallel gradient steps.

Every step is one pass of :func:`partial_sums`: tasks add up loss and gradient
over their rows, the driver updates a weight vector of model size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantab.operators.cleaning import _quoted
from spantab.operators.linear import partial_sums

# Default optimiser constants.
BETAS = (0.9, 0.999)
EPSILON = 1e-8
ADAMW_DECAY = 0.01


@dataclass(frozen=True)
class Network:
    """Dense layers; the leaky activation follows every layer, the last included unless switched off."""

    sizes: tuple[int, ...]
    weights: np.ndarray
    slope: float = 0.01
    final_activation: bool = True

    def layers(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, out, at = (self.weights if flat is None else flat), [], 0
        for fan_in, fan_out in zip(self.sizes, self.sizes[1:]):
            w = flat[at : at + fan_in * fan_out].reshape(fan_out, fan_in)
            at += fan_in * fan_out
            out.append((w, flat[at : at + fan_out]))
            at += fan_out
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        trace, layers = [], self.layers()
        for i, (w, b) in enumerate(layers):
            z = x @ w.T + b
            active = self.final_activation or i < len(layers) - 1
            trace.append((x, z, active))
            x = np.where(z > 0, z, self.slope * z) if active else z
        return x, trace

    def backward(self, trace: list, delta: np.ndarray) -> np.ndarray:
        """Flat gradient from the gradient at the output."""
        parts: list[np.ndarray] = []
        for (w, _), (x, z, active) in zip(reversed(self.layers()), reversed(trace)):
            if active:
                delta = delta * np.where(z > 0, 1.0, self.slope)
            parts.append(np.concatenate([(delta.T @ x).ravel(), delta.sum(axis=0)]))
            delta = delta @ w
        return np.concatenate(parts[::-1])


def new_network(
    inputs: int, hidden: Sequence[int], outputs: int = 1, seed: int = 42, slope: float = 0.01,
    final_activation: bool = True,
) -> Network:
    """Weights and biases uniform in ±1/sqrt(fan in)."""
    rng = np.random.default_rng(seed)
    sizes = (inputs, *hidden, outputs)
    parts = []
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        bound = 1.0 / np.sqrt(fan_in)
        parts.append(rng.uniform(-bound, bound, fan_in * fan_out + fan_out))
    return Network(sizes, np.concatenate(parts), slope, final_activation)


def mlp_predict(df: DataFrame, network: Network, features: Sequence[str], name: str = "p") -> DataFrame:
    """Add the (first) output; batches go through numpy, weights travel once per task."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def apply(*columns: pd.Series) -> pd.Series:
        out, _ = shared.value.forward(np.column_stack([c.to_numpy(dtype=float) for c in columns]))
        return pd.Series(out[:, 0])

    return df.withColumn(name, apply(*(_quoted(c).cast("double") for c in features)))


# A loss maps (prediction, target columns) to (loss per row, gradient per row).
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def squared_loss(p: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = p - targets[:, 0]
    return gap**2, 2 * gap


def interval_squared_loss(p: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    below = np.maximum(targets[:, 0] - p, 0.0)
    above = np.maximum(p - targets[:, 1], 0.0)
    return below**2 + above**2, 2 * (above - below)


class _Optimiser:
    def __init__(self, kind: str, rate: float, size: int):
        if kind not in ("Adam", "AdamW", "SGD"):
            raise ValueError(f"unknown optimizer: {kind}")
        self.kind, self.rate, self.t = kind, rate, 0
        self.first, self.second = np.zeros(size), np.zeros(size)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        if self.kind == "SGD":
            return weights - self.rate * gradient
        if self.kind == "AdamW":
            weights = weights * (1 - self.rate * ADAMW_DECAY)
        self.first = BETAS[0] * self.first + (1 - BETAS[0]) * gradient
        self.second = BETAS[1] * self.second + (1 - BETAS[1]) * gradient**2
        mean = self.first / (1 - BETAS[0] ** self.t)
        spread = np.sqrt(self.second / (1 - BETAS[1] ** self.t))
        return weights - self.rate * mean / (spread + EPSILON)


@dataclass(frozen=True)
class Fit:
    network: Network
    losses: tuple[float, ...]  # before each step, then after the last


def _train(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], network: Network, loss: Loss,
    epochs: int, rate: float, optimizer: str,
) -> Fit:
    columns = [_quoted(c).cast("double") for c in (*features, *targets)]
    data = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).persist()
    inputs = [F.col(f"c{i}") for i in range(len(columns))]
    n_features, size = len(features), len(network.weights)
    update = _Optimiser(optimizer, rate, size)
    losses = []
    for epoch in range(epochs + 1):
        current = network

        def kernel(block: np.ndarray, current: Network = current) -> np.ndarray:
            p, trace = current.forward(block[:, :n_features])
            value, slope = loss(p[:, 0], block[:, n_features:])
            delta = np.zeros_like(p)
            delta[:, 0] = slope
            return np.concatenate([[len(block), value.sum()], current.backward(trace, delta)])

        total = partial_sums(data, inputs, kernel, size + 2)
        rows = max(total[0], 1.0)
        losses.append(float(total[1] / rows))
        if epoch < epochs:
            weights = update.step(network.weights, total[2:] / rows)
            network = Network(network.sizes, weights, network.slope, network.final_activation)
    data.unpersist()
    return Fit(network, tuple(losses))


def mlp_fit(
    df: DataFrame, features: Sequence[str], target: str, hidden: Sequence[int] = (128, 32), epochs: int = 20,
    rate: float = 1e-4, optimizer: str = "Adam", seed: int = 42, start: Network | None = None,
) -> Fit:
    """Mean squared error fit; columns must be non-null and finite."""
    network = start or new_network(len(features), hidden, seed=seed)
    return _train(df, features, [target], network, squared_loss, epochs, rate, optimizer)


def interval_fit(
    df: DataFrame, features: Sequence[str], lower: str, upper: str, hidden: Sequence[int] = (128, 32),
    epochs: int = 20, rate: float = 1e-4, optimizer: str = "Adam", seed: int = 42, start: Network | None = None,
) -> Fit:
    """Fit to interval targets: squared distance to [lower, upper]. ``start`` continues an exact-target fit."""
    network = start or new_network(len(features), hidden, seed=seed)
    return _train(df, features, [lower, upper], network, interval_squared_loss, epochs, rate, optimizer)
