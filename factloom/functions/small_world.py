"""A navigable small-world graph over the vectors of one shard, in numpy.

Every vector is a node of the lowest layer, every 16th of the one above, and so
on. A node is linked to the nearest of its layer, first those that are not
nearer to a link it has already, and to those that are linked to it. A search
descends from the top and keeps, on the lowest layer, a beam of the best nodes
seen; all probes take their steps together. It can be resumed with a wider beam
where a filter has left too few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links that a node chooses, links that it has at most, and the nearest nodes
#: that it chooses from.
CHOSEN, LINKS, CANDIDATES = 16, 32, 96
LAYER_SHARE = 16
#: A layer of no more nodes is looked at whole.
TOP = 32
#: How many times wider than at first a beam gets where a filter leaves too few.
WIDEST = 8
#: Nodes, and probes, that are handled at once.
NODES, PROBES = 256, 64
#: Nodes that a walk steps from at once.
STEPS = 4


@dataclass
class Graph:
    vectors: np.ndarray  # of length 1, or 0
    layers: list[np.ndarray]  # the nodes of each layer, rising; the first has all
    links: list[np.ndarray]  # by place in the layer, filled up with -1


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-30)


def _nearest(x: np.ndarray, at: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    s = x[at] @ x.T
    s[np.arange(len(s)), np.arange(at.start, at.start + len(s))] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(len(x)), (len(s), 1))
    own = np.take_along_axis(s, near, axis=1)
    order = np.argsort(-own, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)


def _chosen(x: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Which candidates, nearest first, are nearer to the node than to a chosen one."""
    y = x[near]
    among = np.matmul(y, y.transpose(0, 2, 1))
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        nearer = (among[:, j] > sims[:, j, None]) & kept
        kept[:, j] = ~nearer.any(axis=1) & (kept.sum(axis=1) < CHOSEN) & np.isfinite(sims[:, j])
    return kept


def link(x: np.ndarray) -> np.ndarray:
    n = len(x)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int32)
    source, target, close, first = [], [], [], []
    for start in range(0, n, NODES):
        near, sims = _nearest(x, slice(start, start + NODES), k)
        kept = _chosen(x, near, sims)
        # What is not chosen fills up what is left, nearest first.
        rank = np.where(kept, 0, 1)
        order = np.argsort(rank, axis=1, kind="stable")[:, :LINKS]
        for name, value in ((target, near), (close, sims), (first, rank)):
            name.append(np.take_along_axis(value, order, axis=1).ravel())
        source.append(np.repeat(np.arange(start, start + len(near)), order.shape[1]))
    a, b, s, f = map(np.concatenate, (source, target, close, first))
    back = f == 0
    a, b, s, f = np.concatenate([a, b[back]]), np.concatenate([b, a[back]]), np.concatenate([s, s[back]]), np.concatenate([f, f[back]])
    _, once = np.unique(a * n + b + (f.astype(np.int64) * n * n), return_index=True)
    a, b, s, f = a[once], b[once], s[once], f[once]
    order = np.lexsort((-s, f, b, a))
    a, b, s, f = a[order], b[order], s[order], f[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b, s, f = a[new], b[new], s[new], f[new]
    order = np.lexsort((-s, f, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, LINKS), -1, np.int32)
    out[a[place < LINKS], place[place < LINKS]] = b[place < LINKS]
    return out


def build(vectors: np.ndarray, seed: int = 16) -> Graph:
    x = unit(vectors)
    rng = np.random.default_rng(seed)
    layers = [np.arange(len(x), dtype=np.int32)]
    while len(layers[-1]) > TOP:
        layers.append(np.sort(rng.choice(layers[-1], max(1, len(layers[-1]) // LAYER_SHARE), replace=False)))
    links = [link(x[nodes]) for nodes in layers]
    for low in range(len(layers) - 1):
        # A node of the layer above has some links of that layer here too: they
        # lead out of a cluster whose nodes have no room for others.
        places = np.searchsorted(layers[low], layers[low + 1])
        wide = np.full((len(layers[low]), CHOSEN), -1, np.int32)
        far = links[low + 1][:, :CHOSEN]
        there = np.where(far >= 0, places[far], -1)
        known = (there[:, :, None] == links[low][places][:, None, :]).any(axis=2)
        wide[places, : far.shape[1]] = np.where(known, -1, there)
        links[low] = np.concatenate([links[low], wide], axis=1)
    return Graph(x, layers, links)


@dataclass
class Beam:
    """Of each probe the best nodes seen, best first, which of them its walk
    has been to, and all that was seen."""

    nodes: np.ndarray
    sims: np.ndarray
    walked: np.ndarray
    seen: np.ndarray
    compared: np.ndarray


def _walk(x: np.ndarray, links: np.ndarray, probes: np.ndarray, beam: Beam) -> None:
    """Step from the best nodes not yet walked from, until the beam has none."""
    width, wide = beam.nodes.shape[1], links.shape[1]
    while True:
        ahead = ~beam.walked & (beam.nodes >= 0)
        active = np.flatnonzero(ahead.any(axis=1))
        if not len(active):
            return
        nth = np.cumsum(ahead[active], axis=1)
        rows, columns = np.nonzero(ahead[active] & (nth <= STEPS))
        beam.walked[active[rows], columns] = True
        to = np.full((len(active), STEPS, wide), -1, np.int32)
        to[rows, nth[rows, columns] - 1] = links[beam.nodes[active[rows], columns]]
        fresh = np.zeros(to.shape, bool)
        for step in range(STEPS):  # one after the other: they may share links
            new = (to[:, step] >= 0) & ~beam.seen[active[:, None], to[:, step]]
            at, link = np.nonzero(new)
            beam.seen[active[at], to[at, step, link]] = True
            fresh[:, step] = new
        to, fresh = to.reshape(len(active), -1), fresh.reshape(len(active), -1)
        rows, columns = np.nonzero(fresh)
        sims = np.full(to.shape, -np.inf, np.float32)
        sims[rows, columns] = np.einsum("nd,nd->n", x[to[rows, columns]], probes[active[rows]])
        beam.compared[active] += fresh.sum(axis=1)
        nodes = np.concatenate([beam.nodes[active], np.where(fresh, to, -1)], axis=1)
        both = np.concatenate([beam.sims[active], sims], axis=1)
        walked = np.concatenate([beam.walked[active], np.zeros(to.shape, bool)], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :width]
        beam.nodes[active], beam.sims[active], beam.walked[active] = (np.take_along_axis(v, order, axis=1) for v in (nodes, both, walked))


def _start(x: np.ndarray, probes: np.ndarray, entries: np.ndarray, width: int) -> Beam:
    """entries: the nodes that each probe begins at."""
    width = max(1, width)
    sims = np.einsum("ped,pd->pe", x[entries], probes)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    pad = ((0, 0), (0, width - order.shape[1]))
    seen = np.zeros((len(probes), len(x)), bool)
    np.put_along_axis(seen, entries, True, axis=1)
    nodes = np.pad(np.take_along_axis(entries, order, axis=1), pad, constant_values=-1)
    sims = np.pad(np.take_along_axis(sims, order, axis=1), pad, constant_values=-np.inf)
    return Beam(nodes, sims, np.zeros(nodes.shape, bool), seen, np.full(len(probes), entries.shape[1]))


def search(g: Graph, probes: np.ndarray, k: int, beam: int = 100, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, similarities, compared) of each probe: the k best found, best
    first, filled up with -1, and how many vectors it was compared with.

    ``allowed`` says which nodes count; the walk goes over all of them. Where
    fewer than k of the beam count, it goes on with a beam of twice the width,
    until the page is full, or, at ``WIDEST`` beams, compares the probe with all
    that count. Where no more of them count than a walk compares with anyway,
    there is no walk.
    """
    q, n = unit(probes), len(g.vectors)
    out = np.full((len(q), k), -1), np.full((len(q), k), -np.inf, np.float32), np.zeros(len(q), np.int64)
    enough = min(k, n if allowed is None else int(allowed.sum()))
    if allowed is not None and allowed.sum() <= beam * LINKS:
        _whole(g, q, np.arange(len(q)), np.flatnonzero(allowed), out)
        return out
    for start in range(0, len(q), PROBES):
        p = q[start : start + PROBES]
        at = np.tile(np.arange(len(g.layers[-1])), (len(p), 1))
        compared = np.zeros(len(p), np.int64)
        for level in range(len(g.layers) - 1, 0, -1):
            nodes = g.layers[level]
            b = _start(g.vectors[nodes], p, at, 8)
            if level < len(g.layers) - 1:
                _walk(g.vectors[nodes], g.links[level], p, b)
            compared += b.compared
            found = np.where(b.nodes < 0, b.nodes[:, :1], b.nodes)
            at = np.searchsorted(g.layers[level - 1], nodes[found])
        width = max(beam, k)
        b = _start(g.vectors, p, at, width)
        _walk(g.vectors, g.links[0], p, b)
        while True:
            counts = b.nodes >= 0 if allowed is None else (b.nodes >= 0) & allowed[b.nodes]
            short = counts.sum(axis=1) < enough
            if not short.any() or width >= WIDEST * beam or width >= n and b.seen.all():
                break
            # The same walk, with room for what had fallen out of the beam.
            width = min(2 * width, n)
            b = _wider(g, p, b, width)
            _walk(g.vectors, g.links[0], p, b)
        order = np.argsort(~counts, axis=1, kind="stable")[:, :k]
        there = np.take_along_axis(counts, order, axis=1)
        rows = slice(start, start + len(p))
        out[0][rows, : order.shape[1]] = np.where(there, np.take_along_axis(b.nodes, order, axis=1), -1)
        out[1][rows, : order.shape[1]] = np.where(there, np.take_along_axis(b.sims, order, axis=1), -np.inf)
        out[2][rows] = compared + b.compared
        if short.any():
            rest = np.arange(n) if allowed is None else np.flatnonzero(allowed)
            _whole(g, q, start + np.flatnonzero(short), rest, out)
    return out


def _whole(g: Graph, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, out: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Compare these probes with all these nodes."""
    for at in range(0, len(rows), PROBES):
        own = rows[at : at + PROBES]
        sims = q[own] @ g.vectors[nodes].T
        order = np.argsort(-sims, axis=1, kind="stable")[:, : out[0].shape[1]]
        out[0][own, : order.shape[1]] = nodes[order]
        out[1][own, : order.shape[1]] = np.take_along_axis(sims, order, axis=1)
        out[2][own] += len(nodes)


def _wider(g: Graph, probes: np.ndarray, b: Beam, width: int) -> Beam:
    """The beam that a search of this width has after the same comparisons. A
    walk that has been everywhere that links lead, with room left, is compared
    with all the rest."""
    walked = np.zeros(b.seen.shape, bool)
    rows, columns = np.nonzero(b.walked & (b.nodes >= 0))
    walked[rows, b.nodes[rows, columns]] = True
    ended = (b.walked | (b.nodes < 0)).all(axis=1) & (b.nodes < 0).any(axis=1)
    b.compared[ended] += (~b.seen[ended]).sum(axis=1)
    b.seen[ended] = True
    sims = np.where(b.seen, probes @ g.vectors.T, -np.inf)
    nodes = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    best = np.take_along_axis(sims, nodes, axis=1)
    done = np.take_along_axis(walked, nodes, axis=1) | ended[:, None]
    return Beam(np.where(np.isfinite(best), nodes, -1), best, done, b.seen, b.compared)
