"""Arrow-batch kernels for segments: feature context, K-best dynamic programming, feature sums."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .templates import AFTER, BEFORE, CONTEXT, potential_indices, potentials, template_indices

MISSING = -np.inf
AHEAD = 4096  # tokens whose indices are worked out together for gradients of one sequence after the other


@dataclass
class TokenBatch:
    """The tokens of a batch of segments, flattened, with the context columns of the templates."""

    context: np.ndarray  # (tokens, CONTEXT columns)
    has: np.ndarray  # (tokens, OPTIONAL columns)
    previous: np.ndarray  # recorded tag before each token
    tags: np.ndarray
    first: np.ndarray  # flat index of each segment's first own token
    size: np.ndarray  # own tokens of each segment
    ahead: Ahead | None = None

    def pick(self, rows: np.ndarray) -> TokenBatch:
        """Some of the segments, over the same tokens."""
        return replace(self, first=self.first[rows], size=self.size[rows], ahead=None)

    def one(self, i: int) -> TokenBatch:
        """A segment on its own, without neighbours; for sequences of one segment."""
        part = slice(self.first[i], self.first[i] + self.size[i])
        columns = (x[part] for x in (self.context, self.has, self.previous, self.tags))
        return TokenBatch(*columns, np.zeros(1, dtype=np.int64), self.size[i : i + 1])

    @property
    def own(self) -> np.ndarray:
        """Flat indices of all own tokens, segment after segment."""
        ends = np.cumsum(self.size)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first - (ends - self.size), self.size)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)


def _shift(values: np.ndarray, place: np.ndarray, size: np.ndarray, offset: int, missing: int) -> np.ndarray:
    """values[i + offset] inside the same row, ``missing`` beyond its ends."""
    inside = (place + offset >= 0) & (place + offset < size)
    source = np.clip(np.arange(len(values)) + offset, 0, max(len(values) - 1, 0))
    return np.where(inside, values[source], missing) if len(values) else values


def token_batch(batch: pa.RecordBatch) -> TokenBatch:
    """Read the segment columns of an Arrow batch."""
    words = _flat(batch.column("words"))
    pos_tags = _flat(batch.column("pos_tags"))
    chunks = _flat(batch.column("chunks"))
    tags = _flat(batch.column("tags"))
    width = np.asarray(pc.list_value_length(batch.column("words")), dtype=np.int64)
    left = np.asarray(batch.column("left"), dtype=np.int64)
    size = np.asarray(batch.column("n"), dtype=np.int64)
    begin = np.cumsum(width) - width
    place = np.arange(len(words)) - np.repeat(begin, width)
    row_width = np.repeat(width, width)

    def near(values, offset):
        return _shift(values, place, row_width, offset, BEFORE if offset < 0 else AFTER)

    near_by = {"w": words, "p": pos_tags, "c": chunks}
    for name in ("w", "p", "c"):
        near_by[f"{name}_m1"] = near(near_by[name], -1)
        near_by[f"{name}_n1"] = near(near_by[name], 1)
    near_by["w_m2"], near_by["w_n2"] = near(words, -2), near(words, 2)
    context = np.stack([near_by[name] for name in CONTEXT], axis=1)
    has = np.stack([place >= 2, place < row_width - 2], axis=1)
    return TokenBatch(context, has, near(tags, -1), tags, begin + left, size)


def gold_indices(batch: TokenBatch, dim: int) -> np.ndarray:
    """Feature indices (own tokens, 27) of the recorded tagging."""
    own = batch.own
    return template_indices(batch.context[own], batch.has[own], batch.tags[own], batch.previous[own], dim)


def path_indices(batch: TokenBatch, path: np.ndarray, entry: np.ndarray, dim: int) -> np.ndarray:
    """Feature indices of another tagging, given flat over the own tokens, entered from tags ``entry``."""
    own = batch.own
    previous = np.empty_like(path)
    previous[1:] = path[:-1]
    starts = np.cumsum(batch.size) - batch.size
    previous[starts] = entry
    return template_indices(batch.context[own], batch.has[own], path, previous, dim)


def path_scores(batch: TokenBatch, indices: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.bincount(batch.owner, weights=w[indices].sum(axis=1), minlength=len(batch.size))


def sparse_difference(
    batch: TokenBatch, plus: np.ndarray, minus: np.ndarray, dim: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of ``plus`` minus counts of ``minus`` per segment, as (row, idx, value) triples without zeros."""
    row = np.repeat(batch.owner, plus.shape[1]) * dim
    cells, where = np.unique(np.concatenate([row + plus.ravel(), row + minus.ravel()]), return_inverse=True)
    sign = np.concatenate([np.ones(plus.size), -np.ones(minus.size)])
    value = np.bincount(where, weights=sign, minlength=len(cells))
    kept = value != 0
    return cells[kept] // dim, cells[kept] % dim, value[kept]


@dataclass
class Lattice:
    """Result of the forward pass: final K-best table per segment and the back-pointers per step."""

    table: np.ndarray  # (segments, tags, K), MISSING where fewer than K paths exist
    steps: list[tuple[np.ndarray, np.ndarray]]  # per step t >= 1: previous tag and rank, (active, tags, K)
    order: np.ndarray  # segments by descending length
    size: np.ndarray

    def paths(self, rows: np.ndarray, tag: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Follow back-pointers from (tag, rank) at the end of each row; flat over the rows' tokens."""
        inverse = np.empty_like(self.order)
        inverse[self.order] = np.arange(len(self.order))
        slot = inverse[rows]
        size = self.size[rows]
        ends = np.cumsum(size)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int64)
        tag, rank = tag.copy(), rank.copy()
        for t in range(int(size.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero(size > t)
            out[(ends - size)[live] + t] = tag[live]
            if t > 0:
                back_tag, back_rank = self.steps[t - 1]
                at = (slot[live], tag[live], rank[live])
                tag[live], rank[live] = back_tag[at], back_rank[at]
        return out


def _step(table: np.ndarray, moves: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The K-best tables (rows, tags, K) after one position, with previous tag and rank of each entry.

    ``moves`` (rows, previous tag, tag). A stable descending sort keeps the order of ties.
    """
    rows, n_tags, k = table.shape
    if k == 1:
        reached = table[:, :, 0][:, :, None] + moves
        best = reached.argmax(axis=1)
        score = np.take_along_axis(reached, best[:, None, :], axis=1)[:, 0, :]
        return (score + node)[:, :, None], (best[:, :, None], np.zeros_like(best)[:, :, None])
    reached = table[:, :, None, :] + moves[:, :, :, None]  # (rows, previous tag, tag, rank)
    flat = reached.transpose(0, 2, 1, 3).reshape(rows, n_tags, n_tags * k)
    best = np.argsort(-flat, axis=2, kind="stable")[:, :, :k]
    return np.take_along_axis(flat, best, axis=2) + node[:, :, None], (best // k, best % k)


def forward(batch: TokenBatch, w: np.ndarray, n_tags: int, k: int, use_loss: bool, entry: np.ndarray) -> Lattice:
    """K-best max-plus pass over all segments of the batch at once, one step per position.

    Ties go to the path that is smaller when read backwards: among equal scores the lower previous tag
    and then the lower rank win, which a stable descending sort keeps.
    """
    node, arrive, link = potentials(batch.context, batch.has, w, n_tags)
    if use_loss:
        node = node + (np.arange(n_tags)[None, :] != batch.tags[:, None])
    order = np.argsort(-batch.size, kind="stable")
    size = batch.size[order]
    first = batch.first[order]
    entry = entry[order]
    longest = int(size[0]) if len(size) else 0
    table = np.full((len(size), n_tags, k), MISSING)
    steps = []
    if longest:
        some = np.flatnonzero(size > 0)
        at = first[some]
        table[some, :, 0] = node[at] + arrive[at, entry[some] + 1][:, None] + link[entry[some] + 1]
    for t in range(1, longest):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = first[:live] + t
        table[:live], back = _step(table[:live], arrive[at, 1:, None] + link[None, 1:, :], node[at])
        steps.append(back)
    back = np.empty_like(table)
    back[order] = table
    return Lattice(back, steps, order, batch.size)


def resume(batch: TokenBatch, w: np.ndarray, n_tags: int, use_loss: bool, before: np.ndarray) -> Lattice:
    """The pass of ``forward`` over one segment, going on from the K-best table (1, tags, K) of the segment before it.

    Its steps include the one into the first position, so ``paths_from`` also tells where a path enters.
    """
    node, arrive, link = potentials(batch.context, batch.has, w, n_tags)
    if use_loss:
        node = node + (np.arange(n_tags)[None, :] != batch.tags[:, None])
    table, steps = before, []
    for at in range(batch.first[0], batch.first[0] + batch.size[0]):
        table, back = _step(table, arrive[at : at + 1, 1:, None] + link[None, 1:, :], node[at : at + 1])
        steps.append(back)
    return Lattice(table, steps, np.zeros(1, dtype=np.int64), batch.size)


def paths_from(lattice: Lattice, tag: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths (paths, positions) of a resumed pass that end in (tag, rank), and the tag and rank they enter from."""
    out = np.empty((len(tag), len(lattice.steps)), dtype=np.int64)
    for t in range(len(lattice.steps) - 1, -1, -1):
        out[:, t] = tag
        back_tag, back_rank = lattice.steps[t]
        tag, rank = back_tag[0, tag, rank], back_rank[0, tag, rank]
    return out, tag, rank


def best_ends(lattice: Lattice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The K best (score, last tag, rank) of each segment, best first."""
    flat = lattice.table.reshape(len(lattice.table), -1)
    best = np.argsort(-flat, axis=1, kind="stable")[:, :k]
    width = lattice.table.shape[2]
    return np.take_along_axis(flat, best, axis=1), best // width, best % width


def simplex_weights(scores: np.ndarray, mu: float) -> np.ndarray:
    """Projection of scores / mu onto the simplex, rows sorted descending, MISSING entries weight 0."""
    n, k = scores.shape
    present = np.isfinite(scores)
    filled = np.where(present, scores, 0.0)
    total = np.cumsum(filled, axis=1)
    count = present.sum(axis=1)
    ranks = np.arange(1, k + 1)
    following = np.concatenate([filled[:, 1:], np.zeros((n, 1))], axis=1)
    enough = total - ranks * following >= mu
    enough[:, -1] = True
    enough |= ranks[None, :] >= count[:, None]
    stop = enough.argmax(axis=1)
    rho = (1 - total[np.arange(n), stop] / mu) / (stop + 1)
    return np.where(present, np.maximum(0.0, filled / mu + rho[:, None]), 0.0)


def mixture(scores: list[float], mu: float) -> list[float]:
    """``simplex_weights`` of a single row."""
    count = sum(map(math.isfinite, scores))
    filled = [x if math.isfinite(x) else 0.0 for x in scores]
    total = 0.0
    for rank, (here, following) in enumerate(zip(filled, [*filled[1:], 0.0]), 1):
        total += here
        if total - rank * following >= mu or rank >= count or rank == len(filled):
            break
    rho = (1 - total / mu) / rank
    return [max(0.0, x / mu + rho) if math.isfinite(s) else 0.0 for s, x in zip(scores, filled)]


class Ahead:
    """Gradients of sequences one by one, at a model that changes in between.

    Which entries of the model the tokens of the next sequences read does not depend on it, and is worked out for all of
    these at once. Results are those of ``forward`` and ``paths``, bit by bit.
    """

    def __init__(self, batch: TokenBatch, start: int, dim: int, n_tags: int):
        ends = np.cumsum(batch.size[start:])
        end = start + max(1, int(np.searchsorted(ends, AHEAD, side="right")))
        part = batch.pick(np.arange(start, min(end, len(batch.size))))
        own = part.own
        self.start, self.n_tags = start, n_tags
        self.bounds = [0, *np.cumsum(part.size).tolist()]
        context, has, tags = batch.context[own], batch.has[own], batch.tags[own]
        self.node, self.arrive, self.fixed, (self.link,) = potential_indices(context, has, dim, n_tags)
        self.gold = template_indices(context, has, tags, batch.previous[own], dim)
        self.loss = np.arange(n_tags)[None, :] != tags[:, None]

    def __contains__(self, i: int) -> bool:
        return 0 <= i - self.start < len(self.bounds) - 1

    def gradient(self, i: int, w, mu: float | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Σ u_k Φ(x, y_k) - Φ(x, y) of sequence ``i`` as (idx, value); ``w`` is anything that is read by index."""
        part = slice(*self.bounds[i - self.start : i - self.start + 2])
        node, arrive, fixed = self.node[part], self.arrive[part], self.fixed[part]
        at = np.arange(len(node))
        cells, values = [self.gold[part].ravel()], [np.full(self.gold[part].size, -1.0)]
        for weight, tag in self._best(node, arrive, fixed, self.loss[part], w, mu, k):
            tag = np.array(tag)
            previous = np.concatenate([[0], tag[:-1] + 1])
            path = (node[at, :, tag].ravel(), arrive[at, :, previous].ravel(), self.link[previous, tag], fixed.ravel())
            cells.extend(path)
            values.append(np.full(sum(map(len, path)), weight))
        found, where = np.unique(np.concatenate(cells), return_inverse=True)
        return found, np.bincount(where, weights=np.concatenate(values), minlength=len(found))

    def _best(self, node_at, arrive_at, fixed_at, loss, w, mu, k) -> list[tuple[float, list[int]]]:
        """Weight and tags of the K best taggings that have a weight."""
        node, arrive, link, fixed = w[node_at].sum(axis=1), w[arrive_at].sum(axis=1), w[self.link], w[fixed_at]
        for slot in range(fixed.shape[1]):
            node += fixed[:, slot, None]
        node = node + loss
        table = np.full((self.n_tags, k), MISSING)
        table[:, 0] = node[0] + arrive[0, 0] + link[0]
        moves = arrive[1:, 1:, None] + link[None, 1:, :]
        each = np.arange(self.n_tags)[:, None]
        steps = []
        for t in range(1, len(node)):
            reached = table[:, None, :] + moves[t - 1][:, :, None]
            flat = reached.transpose(1, 0, 2).reshape(self.n_tags, -1)
            best = flat.argmax(axis=1)[:, None] if k == 1 else np.argsort(-flat, axis=1, kind="stable")[:, :k]
            table = flat[each, best] + node[t][:, None]
            steps.append(best)
        flat = table.ravel()
        ends = np.argsort(-flat, kind="stable")[:k]
        weights = [1.0] if mu is None else mixture(flat[ends].tolist(), mu)
        taggings = []
        for weight, end in zip(weights, ends.tolist()):
            if weight > 0:
                path = [end // k]
                for best in reversed(steps):
                    end = int(best[end // k, end % k])
                    path.append(end // k)
                taggings.append((weight, path[::-1]))
        return taggings
