"""Flattened tree ensembles: scores and attributions of a matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees one after the other; leaves have feature -1 and are their own children."""

    roots: np.ndarray
    weights: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @property
    def base(self) -> float:
        return float((self.weights * self.value[self.roots]).sum())

    def attribute(self, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Attributions (rows x features) of a matrix without gaps, added to ``out`` where it is given."""
        out = np.zeros(x.shape) if out is None else out
        for root, weight in zip(self.roots.tolist(), self.weights.tolist()):
            rows, node = np.arange(len(x)), np.full(len(x), root)
            while True:
                inner = self.feature[node] >= 0
                rows, node = rows[inner], node[inner]
                if not len(rows):
                    break
                feature = self.feature[node]
                child = np.where(x[rows, feature] <= self.threshold[node], self.left[node], self.right[node])
                out[rows, feature] += weight * (self.value[child] - self.value[node])
                node = child
        return out
