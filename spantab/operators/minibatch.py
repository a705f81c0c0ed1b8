"""Seeded mini-batches for small networks, all folds together, with a log row per epoch.

The batch of a row in an epoch is a function of its key's hash, so rows are
neither shuffled nor gathered. A step reads the rows of one batch and adds up
loss and gradient of every fold's network; an epoch ends with one pass that
measures every fold and role.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantab.functions.scalars import split_hash
from spantab.operators.cleaning import _quoted
from spantab.operators.linear import partial_sums
from spantab.operators.mlp import Loss, Network, _Optimiser, squared_loss
from spantab.operators.splits import SplitPlan
from spantab.staging import held

ROLES = ("train", "valid", "test")
PRIME = (1 << 31) - 1
LOG_SCHEMA = "fold int, epoch int, role string, n bigint, loss double, accuracy double"


def key_hash(key: Column | str, seed: int) -> Column:
    """A number below ``PRIME`` from the key's split hash."""
    return F.conv(split_hash(key, seed), 16, 10).cast("bigint") % PRIME


def epoch_factors(seed: int, epoch: int) -> tuple[int, int]:
    """Multiplier and shift that deal the hashes anew in an epoch."""
    digest = hashlib.md5(f"{seed}:{epoch}".encode()).hexdigest()
    return int(digest[:8], 16) % (PRIME - 1) + 1, int(digest[8:16], 16) % PRIME


def batch_number(hashed: Column, batches: int, seed: int, epoch: int) -> Column:
    """Batch 0..batches-1 of a row in an epoch; batches differ in size as draws do."""
    factor, shift = epoch_factors(seed, epoch)
    dealt = (hashed * F.lit(factor) + F.lit(shift)) % F.lit(PRIME)
    return F.floor(dealt * F.lit(batches) / F.lit(PRIME)).cast("int")


@dataclass(frozen=True)
class BatchFit:
    """Network of every fold after the last epoch, and after the epoch of its best valid accuracy."""

    networks: tuple[Network, ...]
    best: tuple[Network, ...]
    log: DataFrame


def fit_minibatches(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], plan: SplitPlan, start: Network, batches: int,
    epochs: int, rate: float = 1e-4, optimizer: str = "Adam", seed: int = 42, loss: Loss = squared_loss,
) -> BatchFit:
    """One network per fold of the plan, all from ``start``; columns must be non-null and finite.

    ``targets`` is the point target, or lower and upper bound with an interval
    loss; accuracy is the share of rounded predictions between the first and
    the last target. An epoch takes ``batches + 1`` passes whatever the number
    of folds. The log (fold, epoch, role, n, loss, accuracy) begins with epoch
    0, before any step; rows without a key belong to no role.
    """
    n_folds, n_features = len(plan.folds), len(features)
    values = [_quoted(c).cast("double") for c in (*features, *targets)]
    roles = [
        F.coalesce(*(F.when(plan.role(f) == name, F.lit(float(k))) for k, name in enumerate(ROLES)), F.lit(-1.0))
        for f in range(n_folds)
    ]
    columns = [c.alias(f"c{i}") for i, c in enumerate([*values, *roles])]
    networks, updates = [start] * n_folds, [_Optimiser(optimizer, rate, len(start.weights)) for _ in range(n_folds)]
    best, reached, log = list(networks), [-1.0] * n_folds, []
    with held(df, [*columns, key_hash(plan.key, seed).alias("h")]) as data:
        inputs = [F.col(f"c{i}") for i in range(len(columns))]
        for epoch in range(epochs + 1):
            for batch in range(batches if epoch else 0):
                rows = data.filter(batch_number(F.col("h"), batches, seed, epoch) == batch)
                networks = _step(rows, inputs, n_features, networks, updates, loss)
            found = _measures(data, inputs, n_features, networks, loss)
            for f in range(n_folds):
                for k, name in enumerate(ROLES):
                    n, total, hits = found[f, k]
                    if n:
                        log.append((f, epoch, name, int(n), float(total / n), float(hits / n)))
                n, _, hits = found[f, ROLES.index("valid")]
                if n and hits / n > reached[f]:
                    best[f], reached[f] = networks[f], hits / n
    return BatchFit(tuple(networks), tuple(best), df.sparkSession.createDataFrame(log, LOG_SCHEMA))


def _step(
    rows: DataFrame, inputs: Sequence[Column], n_features: int, networks: list[Network], updates: list[_Optimiser], loss: Loss
) -> list[Network]:
    """The networks after one step on the train rows of their folds; a fold without rows in the batch stands still."""
    n_folds, size = len(networks), len(networks[0].weights)

    def gradients(raw: np.ndarray) -> np.ndarray:
        out = np.zeros((n_folds, size + 1))
        role = raw[:, raw.shape[1] - n_folds :]
        for f, network in enumerate(networks):
            own = raw[role[:, f] == 0]
            if len(own):
                p, trace = network.forward(own[:, :n_features])
                delta = np.zeros_like(p)
                _, delta[:, 0] = loss(p[:, 0], own[:, n_features : raw.shape[1] - n_folds])
                out[f, 0], out[f, 1:] = len(own), network.backward(trace, delta)
        return out.ravel()

    sums = partial_sums(rows, inputs, gradients, n_folds * (size + 1)).reshape(n_folds, size + 1)
    return [
        replace(network, weights=update.step(network.weights, total[1:] / total[0])) if total[0] else network
        for network, update, total in zip(networks, updates, sums)
    ]


def _measures(
    data: DataFrame, inputs: Sequence[Column], n_features: int, networks: list[Network], loss: Loss
) -> np.ndarray:
    """Rows, summed loss and hits by (fold, role)."""
    n_folds, shape = len(networks), (len(networks), len(ROLES), 3)

    def sums(raw: np.ndarray) -> np.ndarray:
        out = np.zeros(shape)
        targets, role = raw[:, n_features : raw.shape[1] - n_folds], raw[:, raw.shape[1] - n_folds :]
        for f, network in enumerate(networks):
            p = network.forward(raw[:, :n_features])[0][:, 0]
            value, guess = loss(p, targets)[0], np.floor(p + 0.5)
            hit = (guess >= targets[:, 0]) & (guess <= targets[:, -1])
            for k in range(len(ROLES)):
                inside = role[:, f] == k
                out[f, k] = inside.sum(), value[inside].sum(), hit[inside].sum()
        return out.ravel()

    return partial_sums(data, inputs, sums, int(np.prod(shape))).reshape(shape)
