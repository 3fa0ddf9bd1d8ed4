"""Chains of inner steps next to the rows: dense ones, and lazy ones whose steps cost what their gradient has entries."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from .schedules import L2Penalty
from .solvers import Steps

SMALL = 1e-8  # scale below which the lazy vectors are written out anew


class DenseChain:
    """Steps on whole vectors; for dense gradients and for penalties of one's own."""

    def __init__(self, steps: Steps):
        self.steps = replace(steps)

    @property
    def w(self) -> np.ndarray:
        return self.steps.w

    def step(self, gradient: np.ndarray, fixed: np.ndarray | None = None) -> None:
        """Move along a gradient; ``fixed`` is that of the same example at the anchor."""
        s = self.steps
        s.apply(gradient if fixed is None else gradient - fixed + s.anchor_gradient)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return self.steps.w, self.steps.average


class ScaledVector:
    """The vector a * v + b * c, read entry by entry."""

    def __init__(self, v: np.ndarray, c: np.ndarray | None):
        self.v, self.c, self.a, self.b = v, c, 1.0, 0.0

    def __len__(self) -> int:
        return len(self.v)

    def __getitem__(self, index):
        kept = self.a * self.v[index]
        return kept if self.c is None else kept + self.b * self.c[index]

    def whole(self) -> np.ndarray:
        return self[:]


class LazyChain:
    """Steps with sparse gradients under l2 penalties.

    A step w <- (1 - ηλ) w - η (g + c), with c the anchor's mean gradient and the pull of the penalties' centres, scales
    a, shifts b and touches v where g is. The sum of all iterates is A v - u + B c plus what was written out before: when v
    changes at an entry, u takes the change times the weight that earlier iterates have in the sum.
    """

    def __init__(self, steps: Steps):
        self.steps = steps
        self.strength = sum(p.strength for p in steps.penalties)
        constant = np.zeros(len(steps.w)) if steps.anchor_gradient is None else steps.anchor_gradient.copy()
        for p in steps.penalties:
            if p.centre is not None:
                constant -= p.strength * p.centre
        self.w = ScaledVector(np.array(steps.w, dtype=np.float64), constant if constant.any() else None)
        self.u = np.zeros(len(steps.w))
        self.sum_a = self.sum_b = 0.0
        self.first_step, self.count = steps.first_step, steps.count
        self.mass = self._mass(steps.count)
        self.total = self.mass * steps.average

    @staticmethod
    def fits(steps: Steps) -> bool:
        return all(type(p) is L2Penalty for p in steps.penalties)

    def _mass(self, count: float) -> float:
        """What the iterates' weights add up to: 1 each, or rising by 2 a step (``Steps.apply`` gives the shares)."""
        return count * (count + 1) if self.steps.averaging == "weighted" else count

    def step(self, gradient: tuple[np.ndarray, np.ndarray], fixed: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Move along a gradient (idx, value); ``fixed`` is that of the same example at the anchor."""
        w, rate = self.w, self.steps.rate(self.first_step)
        shrink = 1 - rate * self.strength
        if abs(w.a * shrink) < SMALL:
            self._write_out()
            if shrink == 0:
                w.v, w.b, shrink = np.zeros(len(w)), 0.0, 1.0
        w.a *= shrink
        w.b = w.b * shrink - rate
        for sign, part in ((-1.0, gradient), (1.0, fixed)):
            if part is not None:
                index, value = part
                change = value * (sign * rate / w.a)
                w.v[index] += change
                self.u[index] += self.sum_a * change
        self.first_step += 1
        weight = 2 * (self.count + 1) if self.steps.averaging == "weighted" else 1.0
        self.sum_a += weight * w.a
        self.sum_b += weight * w.b
        self.count += 1

    def _write_out(self) -> None:
        w = self.w
        self.total = self._sum()
        w.v, w.a, w.b = w.whole(), 1.0, 0.0
        self.u = np.zeros(len(w))
        self.sum_a = self.sum_b = 0.0

    def _sum(self) -> np.ndarray:
        here = self.total + self.sum_a * self.w.v - self.u
        return here if self.w.c is None else here + self.sum_b * self.w.c

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.w.whole()
        if self.steps.averaging == "none":
            return w, w
        mass = self._mass(self.count)
        return w, self._sum() / mass if mass else self.steps.average
