"""The coreset tree in numpy: points to at most m of them, weighted by the mass of the leaf each stands for.

A tree starts as one leaf around a point drawn by weight. A leaf is drawn by its cost (weighted squared distances to its centre) and
split: a few of its points are drawn by their share of the cost, the one that leaves the least cost becomes a new centre, and points move
to it unless the old centre is nearer. In `sequential` mode leaves are split one at a time, so each draw sees all earlier ones; in
`rounds` mode up to a share of the leaves are split together (each at most once a round), all in whole-array steps. Both give the same
invariants: mass is kept, centres are input points, cost never grows.
"""

from __future__ import annotations

import numpy as np

#: Of all leaves, how many a round may split.
SHARE = 1.0


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([int(k) & 0xFFFFFFFF for k in key])))


def _distances(points: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        up = np.einsum("ij,ij->i", points, centres)
        down = np.sqrt(np.einsum("ij,ij->i", points, points) * np.einsum("ij,ij->i", centres, centres))
        return np.maximum(0, 1 - up / np.where(down > 0, down, 1))
    if points.shape[1] > 8:
        step = points - centres
        return np.einsum("ij,ij->i", step, step)
    out = np.zeros(len(points))
    for j in range(points.shape[1]):
        step = points[:, j] - centres[:, j]
        out += step * step
    return out


def coreset(points: np.ndarray, weights: np.ndarray, m: int, rng: np.random.Generator, tries: int = 3, mode: str = "rounds", metric: str = "l2", pick: str = "d2", cost_mode: str = "weighted", weight_mode: str = "mass") -> tuple[np.ndarray, np.ndarray]:
    """Indices of the centres and the mass of their leaves. Points of no weight are left out; no more rows than points, nor duplicates.

    pick: `d2` draws candidates by cost, `farthest` takes the leaf's farthest point, `scan` draws places by cost and scans on from each until
    a point beats the best so far (one leaf at a time, in the square of a leaf's points at worst). cost_mode `unweighted` leaves weights out of costs;
    weight_mode `leaf_count` gives the number of a leaf's points instead of their mass.
    """
    if m < 1:
        raise ValueError("a coreset has one point at least")
    real = np.flatnonzero(weights > 0)
    mass = weights[real].astype(np.float64) if weight_mode == "mass" else np.ones(len(real))
    if len(real) <= m:
        return real, weights[real].astype(np.float64)
    points, own = np.ascontiguousarray(points[real], np.float64), weights[real].astype(np.float64)
    w = own if cost_mode == "weighted" else np.ones(len(own))
    split = _sequential if mode == "sequential" or pick == "scan" else _rounds
    centres, leaf = split(points, w, m, rng, tries, metric, pick)
    return real[centres], np.bincount(leaf, weights=mass, minlength=len(centres))


def _first(w: np.ndarray, rng: np.random.Generator) -> int:
    total = np.cumsum(w)
    return min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(w) - 1)


def _drawn(cost: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Up to n distinct places of positive cost, by share of cost; a place drawn twice passes its turn on to the next."""
    total = np.cumsum(cost)
    if total[-1] <= 0:
        return np.zeros(0, np.int64)
    positive = np.flatnonzero(cost > 0)
    if len(positive) <= n:
        return positive
    at = np.searchsorted(positive, np.minimum(np.searchsorted(total, np.sort(rng.random(n)) * total[-1], side="right"), positive[-1]))
    at = np.maximum.accumulate(at - np.arange(n)) + np.arange(n)
    return positive[np.minimum(at, len(positive) - n + np.arange(n))]


def _tried(cost: np.ndarray, tries: int, rng: np.random.Generator | None, pick: str, far: np.ndarray, draws: np.ndarray | None = None) -> list[np.ndarray]:
    """Runs of places in a leaf, of each of which the first that beats what was found before is taken. draws: uniforms for a scan."""
    if pick == "farthest":
        return [np.array([int(np.argmax(far))])]
    if pick == "scan":
        total, places = np.cumsum(cost), np.flatnonzero(cost > 0)
        at = np.minimum(np.searchsorted(total, (rng.random(tries) if draws is None else draws) * total[-1], side="right" if draws is None else "left"), places[-1])
        return [places[np.searchsorted(places, a) :] for a in at]
    return [np.array([c]) for c in _drawn(cost, min(tries, len(cost) - 1), rng)]


def _best_split(points, w, mine, runs, metric):  # noqa: ANN001, ANN202
    """Cost left, place and distances of the point that is taken as a leaf's new centre."""
    best = None
    for run in runs:
        for c in run:
            far = _distances(points, points[c][None, :] if metric == "l2" else points[c][None, :].repeat(len(points), axis=0), metric)
            far[c] = 0
            cost = (w * np.minimum(mine, far)).sum()
            if best is None or cost < best[0]:
                best = (cost, c, far)
                break  # a scan goes no further; other runs are of one point
    return best


def split_of(points: np.ndarray, w: np.ndarray, centre: int, pick: str, metric: str = "l2", draws: np.ndarray | None = None) -> tuple[int, float]:
    """The first split of a leaf about a centre, as trees with this pick make it: the new centre's place, and the cost that is left.

    draws: for `scan`, the uniforms, each of which begins at the first point of positive cost where the running cost reaches its share.
    """
    mine = _distances(points, points[centre][None, :].repeat(len(points), axis=0), metric)
    mine[centre] = 0
    cost, c, _ = _best_split(points, w, mine, _tried(w * mine, 1, None, pick, mine, draws), metric)
    return int(c), float(cost)


def _sequential(points, w, m, rng, tries, metric, pick):  # noqa: ANN001, ANN202
    n = len(points)
    centres = [_first(w, rng)]
    leaf = np.zeros(n, np.int64)
    d = _distances(points, points[centres[0]][None, :].repeat(n, axis=0), metric)
    d[centres[0]] = 0
    members = [np.arange(n)]
    costs = np.zeros(m)
    costs[0] = (w * d).sum()
    while len(centres) < m:
        chosen = _drawn(costs[: len(centres)], 1, rng)
        if not len(chosen):
            break
        at = int(chosen[0])
        own = members[at]
        mine, own_w = d[own], w[own]
        _, c, far = _best_split(points[own], own_w, mine, _tried(own_w * mine, tries, rng, pick, mine), metric)
        stay = mine < far
        stay[c] = False
        new = len(centres)
        centres.append(int(own[c]))
        leaf[own[~stay]] = new
        d[own] = np.minimum(mine, far)
        members[at], moved = own[stay], own[~stay]
        members.append(moved)
        costs[at], costs[new] = (w[members[at]] * d[members[at]]).sum(), (w[moved] * d[moved]).sum()
        if not len(members[at]):  # its points are all duplicates of the new centre
            costs[at] = 0
    return _without_empty(np.array(centres), leaf)


def _rounds(points, w, m, rng, tries, metric, pick, splits=None, order_out=None):  # noqa: ANN001, ANN202
    """splits: gets (leaves that were split, new leaves) of each round; order_out: gets the rows, leaf by leaf, where leaves begin, their sizes, costs and centres."""
    n = len(points)
    columns = [np.ascontiguousarray(c) for c in points.T] if metric == "l2" and points.shape[1] <= 8 else None
    order = np.arange(n)  # rows, leaf by leaf: leaf i has order[begin[i] : begin[i] + size[i]]
    begin, size = np.zeros(m, np.int64), np.zeros(m, np.int64)
    centres, costs = np.zeros(m, np.int64), np.zeros(m)
    size[0], centres[0], k = n, _first(w, rng), 1
    d = _distances(points, points[centres[0]][None, :].repeat(n, axis=0), metric)
    d[centres[0]] = 0
    costs[0] = (w * d).sum()
    while k < m:
        n_split = min(m - k, max(1, int(SHARE * k)))
        total = np.cumsum(costs[:k])
        if total[-1] <= 0:
            break
        at = np.searchsorted(total, (np.arange(n_split) + rng.random()) / n_split * total[-1], side="right")
        at = np.unique(np.minimum(at, k - 1))
        at = at[costs[at] > 0]
        if not len(at):
            break
        own = size[at]
        starts = np.cumsum(own) - own
        places = np.repeat(begin[at] - starts, own) + np.arange(int(own.sum()))
        ids = order[places]
        mine, rw = d[ids], w[ids]
        cost = rw * mine
        if columns is not None:
            x = [c[ids] for c in columns]
        else:
            x = points[ids]
        if pick == "farthest":
            hit = np.flatnonzero(mine == np.repeat(np.maximum.reduceat(mine, starts), own))
            tried = [hit[np.searchsorted(hit, starts)]]
        else:
            run = np.cumsum(cost)
            low = run[starts] - cost[starts]
            span = run[starts + own - 1] - low
            tried = [np.clip(np.searchsorted(run, low + rng.random(len(at)) * span, side="right"), starts, starts + own - 1) for _ in range(tries)]
            tried = _distinct(tried, cost, starts, own)
        best, best_far, best_c = None, None, None
        for c in tried:
            if columns is not None:
                far = np.zeros(len(ids))
                for v in x:
                    step = v - np.repeat(v[c], own)
                    step *= step
                    far += step
            else:
                far = _distances(x, np.repeat(x[c], own, axis=0), metric)
            far[c] = 0
            got = np.add.reduceat(rw * np.minimum(mine, far), starts)
            if best is None:
                best, best_far, best_c = got, far, c
            else:
                better = got < best
                best, best_c = np.where(better, got, best), np.where(better, c, best_c)
                best_far = np.where(np.repeat(better, own), far, best_far)
        useful = best < costs[at]
        if not useful.any():
            break
        move = (best_far <= mine) & np.repeat(useful, own)
        move[best_c[useful]] = True
        d[ids] = np.where(move, best_far, mine)
        # Members that stay come first in a leaf's place; those that move are a leaf of their own behind.
        passed = np.cumsum(move)
        before = passed - move - np.repeat(passed[starts] - move[starts], own)
        moved = np.add.reduceat(move.astype(np.int64), starts)
        stay = own - moved
        within = np.arange(len(ids)) - np.repeat(starts, own)
        to = np.repeat(begin[at], own) + np.where(move, np.repeat(stay, own) + before, within - before)
        order[to] = ids
        left = rw * np.where(move, 0, mine)
        new_cost = np.add.reduceat(rw * np.where(move, best_far, 0), starts)
        split, n_new = at[useful], int(useful.sum())
        costs[at] = np.where(useful, np.add.reduceat(left, starts), costs[at])
        size[split] = stay[useful]
        new = slice(k, k + n_new)
        begin[new], size[new] = begin[split] + stay[useful], moved[useful]
        centres[new], costs[new] = ids[best_c[useful]], new_cost[useful]
        if splits is not None:
            splits.append((split, np.arange(k, k + n_new)))
        k += n_new
    if order_out is not None:
        order_out += [order, begin[:k].copy(), size[:k].copy(), costs[:k].copy(), centres[:k].copy()]
    leaf = np.empty(n, np.int64)
    places = np.repeat(begin[:k] - (np.cumsum(size[:k]) - size[:k]), size[:k]) + np.arange(n)
    leaf[order[places]] = np.repeat(np.arange(k), size[:k])
    return _without_empty(centres[:k], leaf)


#: Points that coresets() takes together.
TOGETHER = 1 << 15


def coresets(parts: list[tuple[np.ndarray, np.ndarray, np.random.Generator]], m: int, tries: int = 3, mode: str = "rounds", metric: str = "l2", pick: str = "d2", cost_mode: str = "weighted", weight_mode: str = "mass") -> list[tuple[np.ndarray, np.ndarray]]:
    """coreset() of each of some (points, weights, generator), the same indices and masses; rounds of many small trees are array steps together."""
    options = {"tries": tries, "mode": mode, "metric": metric, "pick": pick, "cost_mode": cost_mode, "weight_mode": weight_mode}
    if mode != "rounds" or pick != "d2":
        return [coreset(points, weights, m, rng, **options) for points, weights, rng in parts]
    made, held, rows = [], [], 0
    for i, (points, weights, rng) in enumerate(parts):
        real = np.flatnonzero(weights > 0)
        if len(real) <= m:
            made.append(coreset(points, weights, m, rng, **options))
        else:
            made.append(None)
            held.append((i, real, points[real].astype(np.float64, copy=False), weights[real].astype(np.float64, copy=False), rng))
            rows += len(real)
        if held and (rows >= TOGETHER or i == len(parts) - 1):
            mass = np.concatenate([h[3] for h in held])
            w = mass if cost_mode == "weighted" else np.ones(rows)
            begin = np.cumsum([0, *(len(h[1]) for h in held)])
            centres, size, leaf = _rounds_together(np.concatenate([h[2] for h in held]), w, begin, m, [h[4] for h in held], tries, metric)
            mass = mass if weight_mode == "mass" else np.ones(rows)
            for t, (k, own, *_) in enumerate(held):
                span, used = slice(begin[t], begin[t + 1]), np.flatnonzero(size[t])
                made[k] = (own[centres[t, used] - begin[t]], np.bincount(leaf[span], weights=mass[span], minlength=m)[used])
            held, rows = [], 0
    return made


def _rounds_together(points, w, edges, m, rngs, tries, metric):  # noqa: ANN001, ANN202
    """_rounds() of the rows between edges, each a tree with a generator: rows of centres and sizes of leaves (trees x m), and each row's leaf."""
    trees, n = len(rngs), len(points)
    columns = [np.ascontiguousarray(c) for c in points.T] if metric == "l2" and points.shape[1] <= 8 else None
    order = np.arange(n)
    begin, size, centres, costs = np.zeros((trees, m), np.int64), np.zeros((trees, m), np.int64), np.zeros((trees, m), np.int64), np.zeros((trees, m))
    rows = np.diff(edges)
    begin[:, 0], size[:, 0] = edges[:-1], rows
    centres[:, 0] = [a + _first(w[a:b], rng) for a, b, rng in zip(edges[:-1].tolist(), edges[1:].tolist(), rngs, strict=True)]
    d = _distances(points, points[np.repeat(centres[:, 0], rows)], metric)
    d[centres[:, 0]] = 0
    cost = w * d
    costs[:, 0] = [cost[a:b].sum() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    n_leaves, live = np.ones(trees, np.int64), list(range(trees))
    begin, size, centres, costs = (x.reshape(-1) for x in (begin, size, centres, costs))  # views: leaf j of tree t is at t * m + j
    while live:
        chosen, going = [], []
        for t in live:
            k = int(n_leaves[t])
            if k >= m:
                continue
            n_split = min(m - k, max(1, int(SHARE * k)))
            total = costs[t * m : t * m + k].cumsum()
            if total[-1] <= 0:
                continue
            at = total.searchsorted((np.arange(n_split) + rngs[t].random()) / n_split * total[-1], side="right")
            np.minimum(at, k - 1, out=at)
            at = at[np.diff(at, prepend=-1) > 0] + t * m  # they are in order
            at = at[costs[at] > 0]
            if len(at):
                chosen.append(at)
                going.append(t)
        if not going:
            break
        many = np.array([len(c) for c in chosen])
        at, tree = np.concatenate(chosen), np.repeat(going, many)
        own = size[at]
        starts = np.cumsum(own) - own
        ids = order[np.repeat(begin[at] - starts, own) + np.arange(int(own.sum()))]
        mine, rw = d[ids], w[ids]
        cost = rw * mine
        x = [c[ids] for c in columns] if columns is not None else points[ids]
        drawn, last = np.empty((tries, len(at)), np.int64), starts + own - 1
        leaf_edges = [0, *np.cumsum(many).tolist()]
        row_edges = [*starts[leaf_edges[:-1]].tolist(), len(ids)]
        for i, t in enumerate(going):  # running costs are a tree's own
            a, b, r0 = leaf_edges[i], leaf_edges[i + 1], row_edges[i]
            run = cost[r0 : row_edges[i + 1]].cumsum()
            low = run[starts[a:b] - r0] - cost[starts[a:b]]
            span = run[last[a:b] - r0] - low
            drawn[:, a:b] = run.searchsorted(low + rngs[t].random((tries, b - a)) * span, side="right") + r0
        best, best_far, best_c = None, None, None
        for c in _distinct(list(np.clip(drawn, starts, last)), cost, starts, own):
            if columns is not None:
                far = np.zeros(len(ids))
                for v in x:
                    step = v - np.repeat(v[c], own)
                    step *= step
                    far += step
            else:
                far = _distances(x, np.repeat(x[c], own, axis=0), metric)
            far[c] = 0
            got = np.add.reduceat(rw * np.minimum(mine, far), starts)
            if best is None:
                best, best_far, best_c = got, far, c
            else:
                better = got < best
                best, best_c = np.where(better, got, best), np.where(better, c, best_c)
                best_far = np.where(np.repeat(better, own), far, best_far)
        useful = best < costs[at]
        move = (best_far <= mine) & np.repeat(useful, own)
        move[best_c[useful]] = True
        d[ids] = np.where(move, best_far, mine)
        passed = np.cumsum(move)
        before = passed - move - np.repeat(passed[starts] - move[starts], own)
        moved = np.add.reduceat(move.astype(np.int64), starts)
        stay = own - moved
        within = np.arange(len(ids)) - np.repeat(starts, own)
        order[np.repeat(begin[at], own) + np.where(move, np.repeat(stay, own) + before, within - before)] = ids
        new_cost = np.add.reduceat(rw * np.where(move, best_far, 0), starts)
        costs[at] = np.where(useful, np.add.reduceat(rw * np.where(move, 0, mine), starts), costs[at])
        split, home = at[useful], tree[useful]
        size[split] = stay[useful]
        n_new = np.bincount(home, minlength=trees)
        new = home * m + n_leaves[home] + np.arange(len(home)) - (np.cumsum(n_new) - n_new)[home]
        begin[new], size[new] = begin[split] + stay[useful], moved[useful]
        centres[new], costs[new] = ids[best_c[useful]], new_cost[useful]
        n_leaves += n_new
        live = [t for t in going if n_new[t]]
    leaf = np.empty(n, np.int64)
    places = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(n)
    leaf[order[places]] = np.repeat(np.tile(np.arange(m), trees), size)
    return centres.reshape(trees, m), size.reshape(trees, m), leaf


def _distinct(tried: list[np.ndarray], cost: np.ndarray, starts: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Draws of each leaf made distinct: one that others have drawn before passes on to the leaf's next row of positive cost, round and round.

    Leaves with fewer such rows than tries keep what has no other place to go.
    """
    positive = np.flatnonzero(cost > 0)
    low, count = np.searchsorted(positive, starts), np.searchsorted(positive, starts + own) - np.searchsorted(positive, starts)
    place = lambda c: np.minimum(np.searchsorted(positive, c), low + count - 1) - low
    taken = []
    for c in tried:
        at = place(c)
        for _ in range(len(taken)):
            clash = np.zeros(len(at), bool)
            for other in taken:
                clash |= at == other
            at = np.where(clash, (at + 1) % count, at)
        taken.append(at)
    return [positive[low + at] for at in taken]


def _without_empty(centres: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, leaf = np.unique(leaf, return_inverse=True)
    return centres[used], leaf


def leaves(points: np.ndarray, weights: np.ndarray, m: int, rng: np.random.Generator, tries: int = 3) -> list[tuple[int, float, np.ndarray]]:
    """The leaves of a tree over points of positive weight: centre (a row), mass, and rows of the members; each row is in one leaf."""
    centres, leaf = _rounds(np.ascontiguousarray(points, np.float64), weights.astype(np.float64), min(m, len(points)), rng, tries, "l2", "d2")
    return [(int(c), float(weights[leaf == k].sum()), np.flatnonzero(leaf == k)) for k, c in enumerate(centres)]


def tree(points: np.ndarray, weights: np.ndarray, m: int, rng: np.random.Generator, tries: int = 3) -> dict[str, np.ndarray]:
    """The tree over points of positive weight as a table of nodes, parents before their children.

    parent, left, right (-1: none), centre (a row), mass and cost (of a leaf about its centre; of other nodes the sums of their children's),
    begin and size: a node's members are rows[begin : begin + size], so a leaf's and its sister's stand side by side in their parent's.
    """
    points, w = np.ascontiguousarray(points, np.float64), weights.astype(np.float64)
    splits: list[tuple[np.ndarray, np.ndarray]] = []
    out: list[np.ndarray] = []
    _rounds(points, w, min(m, len(points)), rng, tries, "l2", "d2", splits, out)
    rows, begin, size, cost, centres = out
    n = 1 + 2 * sum(len(new) for _, new in splits)
    nodes = {k: np.full(n, -1, np.int64) for k in ("parent", "left", "right", "centre", "begin", "size")} | {"mass": np.zeros(n), "cost": np.zeros(n)}
    slot = np.zeros(len(begin), np.int64)  # the node that each leaf is just now
    made = 1
    for old, new in splits:
        for i, j in zip(old.tolist(), new.tolist(), strict=True):
            up = int(slot[i])
            nodes["left"][up], nodes["right"][up] = made, made + 1
            nodes["parent"][made : made + 2] = up
            slot[i], slot[j] = made, made + 1
            made += 2
    for i, node in enumerate(slot.tolist()):
        own = rows[begin[i] : begin[i] + size[i]]
        nodes["begin"][node], nodes["size"][node], nodes["centre"][node] = begin[i], size[i], centres[i]
        nodes["mass"][node], nodes["cost"][node] = w[own].sum(), cost[i]
    for up in range(n - 1, -1, -1):  # children come after their parent
        a, b = nodes["left"][up], nodes["right"][up]
        if a >= 0:
            nodes["begin"][up], nodes["size"][up], nodes["centre"][up] = nodes["begin"][a], nodes["size"][a] + nodes["size"][b], nodes["centre"][a]
            for k in ("mass", "cost"):
                nodes[k][up] = nodes[k][a] + nodes[k][b]
    return nodes | {"rows": rows}
