"""The gradient of one sequence of any length, segment by segment, inside one task.

The segments come first to last and then last to first. The way there keeps only the K-best table before each segment; the
way back decodes each segment again from its table and follows the paths through it. What is held is one segment, a table
of tags x K scores per segment, and the gradient itself. Sums are made in the order in which a single segment makes them,
so scores, ties and paths are those of the uncut sequence.
"""

from __future__ import annotations

import numpy as np

from . import decoding

MERGE = 1 << 20


class SpannedGradient:
    """Σ u_k Φ(x, y_k) - Φ(x, y) at one model; without ``mu`` the best path alone counts."""

    def __init__(self, w, n_tags: int, mu: float | None, k: int):
        self.w, self.n_tags, self.mu, self.k = w, n_tags, mu, 1 if mu is None else k
        self.tables: list[np.ndarray] = []
        self.tag = self.rank = self.weight = np.zeros(0)
        self.cells: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def _lattice(self, segment: decoding.TokenBatch, nth: int) -> decoding.Lattice:
        if nth:
            return decoding.resume(segment, self.w, self.n_tags, True, self.tables[nth - 1])
        return decoding.forward(segment, self.w, self.n_tags, self.k, True, np.array([-1]))

    def there(self, segment: decoding.TokenBatch) -> None:
        """The next segment of the way to the end."""
        self.tables.append(self._lattice(segment, len(self.tables)).table)
        self._add(decoding.gold_indices(segment, len(self.w)), np.array([-1.0]))

    def back(self, segment: decoding.TokenBatch) -> None:
        """The same segments from last to first."""
        nth = len(self.tables) - 1
        lattice = self._lattice(segment, nth)
        if not len(self.weight):
            scores, tags, ranks = decoding.best_ends(lattice, self.k)
            weights = np.ones((1, 1)) if self.mu is None else decoding.simplex_weights(scores, self.mu)
            used = np.flatnonzero(weights[0] > 0)
            self.tag, self.rank, self.weight = tags[0, used], ranks[0, used], weights[0, used]
        many = segment.pick(np.zeros(len(self.tag), dtype=np.int64))
        if nth:
            paths, self.tag, self.rank = decoding.paths_from(lattice, self.tag, self.rank)
            flat, entry = paths.ravel(), self.tag
        else:
            flat = lattice.paths(np.zeros(len(self.tag), dtype=np.int64), self.tag, self.rank)
            entry = np.full(len(self.tag), -1)
        indices = decoding.path_indices(many, flat, entry, len(self.w))
        self._add(indices.reshape(len(self.weight), -1), self.weight)
        self.tables.pop()

    def _add(self, indices: np.ndarray, weight: np.ndarray) -> None:
        self.cells.append(indices.ravel())
        self.values.append(np.repeat(weight, indices.size // len(weight)))
        self.held += indices.size
        if self.held > MERGE:
            self._merge()

    def _merge(self) -> None:
        cells, where = np.unique(np.concatenate(self.cells), return_inverse=True)
        values = np.bincount(where, weights=np.concatenate(self.values), minlength=len(cells))
        self.cells, self.values, self.held = [cells], [values], len(cells)

    def gradient(self, mu: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(idx, value) with distinct indices; ``mu`` as given at the start."""
        self._merge()
        return self.cells[0], self.values[0]
