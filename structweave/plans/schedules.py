"""Penalties and schedules: small driver-side values that travel with the tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


class Penalty:
    """A smooth penalty; subclass it to add your own."""

    def value(self, w: np.ndarray) -> float:
        raise NotImplementedError

    def gradient(self, w: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def strong_convexity(self) -> float:
        return 0.0


@dataclass(frozen=True)
class L2Penalty(Penalty):
    """strength / 2 · ‖w - centre‖²."""

    strength: float
    centre: np.ndarray | None = None

    def _offset(self, w):
        return w if self.centre is None else w - self.centre

    def value(self, w):
        offset = self._offset(w)
        return self.strength / 2 * float(offset @ offset)

    def gradient(self, w):
        return self.strength * self._offset(w)

    def strong_convexity(self):
        return self.strength


def total_strong_convexity(penalties) -> float:
    return sum(p.strong_convexity() for p in penalties)


def penalty_value(penalties, w) -> float:
    return sum(p.value(w) for p in penalties)


@dataclass(frozen=True)
class LearningRate:
    """Step size at step t: const η0, pegasos 1 / (λ (t + 1)), linear η0 / (1 + t / t0)."""

    scheme: str = "const"
    initial: float = 1.0
    time_factor: float = 100.0
    strong_convexity: float = 0.0

    def __post_init__(self):
        if self.scheme not in ("const", "pegasos", "linear"):
            raise ValueError(f"unknown learning rate scheme: {self.scheme}")
        if self.scheme == "pegasos" and self.strong_convexity <= 0:
            raise ValueError("the pegasos rate needs a strongly convex penalty")

    def __call__(self, t: float) -> float:
        if self.scheme == "const":
            return self.initial
        if self.scheme == "pegasos":
            return 1.0 / (self.strong_convexity * (t + 1))
        return self.initial / (1 + t / self.time_factor)


def smoothing_at(rule: str, initial: float | None, epoch: int, kappa: float, strong_convexity: float) -> float | None:
    """Smoothing coefficient of an epoch.

    ``expo`` takes its factor from κ / (κ + λ); ``expo_theory`` from λ / (λ + κ), as the theory states it.
    """
    if initial is None:
        return None
    if rule in ("const", "none"):
        return initial
    if rule == "linear":
        return initial / (epoch + 1)
    if rule in ("expo", "expo_theory"):
        part = kappa if rule == "expo" else strong_convexity
        ratio = part / (kappa + strong_convexity)
        return initial * math.sqrt(1 - math.sqrt(ratio) / 2) ** epoch
    raise ValueError(f"unknown smoothing rule: {rule}")


def moreau_at(rule: str, initial: float, epoch: int) -> float:
    """Weight of the proximal term in an epoch."""
    if rule == "const":
        return initial
    if rule == "linear":
        return (epoch + 1) * initial
    raise ValueError(f"unknown proximal weight rule: {rule}")


def extrapolation(alpha: float, kappa: float, kappa_next: float, strong_convexity: float) -> tuple[float, float]:
    """Next (α, β). α_k is the positive root of r' a² - (λ - α² r) a - α² r = 0 with
    r = κ_k + λ and r' = κ_{k+1} + λ; β follows from α and α_k."""
    now, later = kappa + strong_convexity, kappa_next + strong_convexity
    mass = alpha * alpha * now
    gap = strong_convexity - mass
    following = (gap + math.sqrt(gap * gap + 4 * later * mass)) / (2 * later)
    return following, alpha * (1 - alpha) * now / (mass + following * later)
