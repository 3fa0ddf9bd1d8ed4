"""The 27 sequence feature templates: one table, read both by column expressions and by NumPy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hash of (slot, a2, a3) is (HASH_BASE + HASH_SLOT * slot + HASH_SECOND * a2 + a3) mod dim.
HASH_BASE = 506447
HASH_SLOT = 961
HASH_SECOND = 31

# Sentinels for neighbours before the first and after the last position.
BEFORE = -1
AFTER = -2

# The pair hashed by each slot, in slot order. y is the tag and y1 the previous tag;
# w, p, c are word, POS and chunk; m and n are offsets before and after.
SLOTS = (
    ("w", "y"), ("w", "y1"),
    ("w_m2", "y"), ("w_m2", "y1"),
    ("w_n2", "y"), ("w_n2", "y1"),
    ("w_m1", "y"), ("w_m1", "y1"),
    ("w_n1", "y"), ("w_n1", "y1"),
    ("y1", "y"),
    ("p_m1", "p"), ("p", "p_n1"), ("c_m1", "c"), ("c", "c_n1"),
    ("y", "p"), ("y", "p_n1"), ("y", "p_m1"), ("y", "c"), ("y", "c_n1"), ("y", "c_m1"),
    ("y1", "p"), ("y1", "p_n1"), ("y1", "p_m1"), ("y1", "c"), ("y1", "c_n1"), ("y1", "c_m1"),
)

CONTEXT = ("w", "w_m1", "w_m2", "w_n1", "w_n2", "p", "p_m1", "p_n1", "c", "c_m1", "c_n1")
# Second neighbours have no sentinel: where they are missing the slot counts index 0.
OPTIONAL = ("w_m2", "w_n2")


def triple_hash(slot: Column | int, second: Column, third: Column, dim: int) -> Column:
    """Hash an integer triple to [0, dim) in bigint arithmetic."""
    slot = F.lit(slot) if isinstance(slot, int) else slot
    code = F.lit(HASH_BASE).cast("bigint") + slot.cast("bigint") * HASH_SLOT
    code = code + second.cast("bigint") * HASH_SECOND + third.cast("bigint")
    return F.pmod(code, F.lit(dim).cast("bigint"))


def template_columns(dim: int, tag: str = "y", previous: str = "y1") -> Column:
    """Array of the 27 hashed indices for a row that carries the CONTEXT columns and both tags."""
    names = {"y": tag, "y1": previous}
    slots = []
    for slot, (second, third) in enumerate(SLOTS):
        hashed = triple_hash(slot, F.col(names.get(second, second)), F.col(names.get(third, third)), dim)
        if second in OPTIONAL:
            hashed = F.when(F.col(second).isNull(), F.lit(0).cast("bigint")).otherwise(hashed)
        slots.append(hashed)
    return F.array(*slots)


def _code_parts(free: tuple[str, ...]):
    """Slots whose tags are exactly ``free``: numbers, context columns with factors, and tag factors."""
    found = []
    for slot, pair in enumerate(SLOTS):
        if tuple(sorted({x for x in pair if x in ("y", "y1")})) != free:
            continue
        factor = {pair[0]: HASH_SECOND, pair[1]: 1}
        context = [(CONTEXT.index(x), factor[x]) for x in pair if x in CONTEXT]
        found.append((slot, context, [factor[x] for x in free]))
    return found


def _one_tag(name: str):
    """(slot bases, context columns, context factors, tag factors) of the slots that read one tag only."""
    parts = _code_parts((name,))
    base = np.array([HASH_BASE + HASH_SLOT * slot for slot, _, _ in parts])
    column = np.array([context[0][0] for _, context, _ in parts])
    return base, column, np.array([context[0][1] for _, context, _ in parts]), np.array([f[0] for _, _, f in parts])


_NODE, _ARRIVE = _one_tag("y"), _one_tag("y1")
_FIXED = _code_parts(())
_LINK = _code_parts(("y", "y1"))
_ALL = (*CONTEXT, "y", "y1")
_SECOND = np.array([_ALL.index(a) for a, _ in SLOTS])
_THIRD = np.array([_ALL.index(b) for _, b in SLOTS])
_BASE = HASH_BASE + HASH_SLOT * np.arange(len(SLOTS))
_OPTIONAL_COLUMNS = [CONTEXT.index(name) for name in OPTIONAL]
_OPTIONAL_SLOTS = [[i for i, (a, _) in enumerate(SLOTS) if a == name] for name in OPTIONAL]


def template_indices(
    context: np.ndarray, has: np.ndarray, tag: np.ndarray, previous: np.ndarray, dim: int
) -> np.ndarray:
    """Indices of shape (tokens, 27) along a given tagging.

    ``context`` holds the CONTEXT columns of each token and ``has`` whether the OPTIONAL ones exist.
    """
    values = np.concatenate([context, tag[:, None], previous[:, None]], axis=1)
    index = (_BASE + HASH_SECOND * values[:, _SECOND] + values[:, _THIRD]) % dim
    for column, slots in enumerate(_OPTIONAL_SLOTS):
        index[:, slots] *= has[:, column, None]
    return index


def _tag_index(parts, context, has, dim, tags):
    base, column, factor, tag_factor = parts
    codes = (base + factor * context[:, column])[:, :, None] + tag_factor[None, :, None] * tags[None, None, :]
    index = codes % dim
    for i, c in enumerate(_OPTIONAL_COLUMNS):
        index[:, column == c] *= has[:, i, None, None]
    return index


def _tag_scores(parts, context, has, w, tags):
    return w[_tag_index(parts, context, has, len(w), tags)].sum(axis=1)


def potential_indices(context: np.ndarray, has: np.ndarray, dim: int, n_tags: int) -> tuple[np.ndarray, ...]:
    """Where ``potentials`` reads the model: by token, slot and tag; token, slot and previous tag; token and slot without a
    tag; slot, previous tag and tag."""
    tags, previous = np.arange(n_tags), np.arange(-1, n_tags)
    node = _tag_index(_NODE, context, has, dim, tags)
    arrive = _tag_index(_ARRIVE, context, has, dim, previous)
    fixed = [(HASH_BASE + HASH_SLOT * slot + fa * context[:, a] + fb * context[:, b]) % dim for slot, ((a, fa), (b, fb)), _ in _FIXED]
    link = [
        (HASH_BASE + HASH_SLOT * slot + of_previous * previous[:, None] + of_tag * tags[None, :]) % dim
        for slot, _, (of_tag, of_previous) in _LINK
    ]
    return node, arrive, np.stack(fixed, axis=1), np.stack(link)


def potentials(
    context: np.ndarray, has: np.ndarray, w: np.ndarray, n_tags: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge scores in factored form: score(y1, y) at token i is node[i, y] + arrive[i, y1] + link[y1, y].

    Previous tags have n_tags + 1 rows, row 0 being the start sentinel. Slots are evaluated once per
    dependency (tag only, previous tag only, both, neither) instead of once per tag pair.
    """
    tags, previous = np.arange(n_tags), np.arange(-1, n_tags)
    node = _tag_scores(_NODE, context, has, w, tags)
    arrive = _tag_scores(_ARRIVE, context, has, w, previous)
    link = np.zeros((n_tags + 1, n_tags))
    for slot, _, (of_tag, of_previous) in _LINK:
        code = HASH_BASE + HASH_SLOT * slot + of_previous * previous[:, None] + of_tag * tags[None, :]
        link += w[code % len(w)]
    for slot, ((a, fa), (b, fb)), _ in _FIXED:
        node += w[(HASH_BASE + HASH_SLOT * slot + fa * context[:, a] + fb * context[:, b]) % len(w)][:, None]
    return node, arrive, link
