"""Search algorithms over a finite grid of parameter values.

Each algorithm is a generator of proposals: it is sent what is known so far and yields the index of the next candidate. The loop around it counts evaluations, skips what it has seen and stops at the budget, so that all twenty are compared alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np


class Grid:
    """All combinations of the values, as points with one integer coordinate per parameter; combination i counts in mixed radix, the last parameter fastest."""

    def __init__(self, space: dict[str, list]):
        self.names, self.values = list(space), list(space.values())
        self.shape = np.array([len(v) for v in self.values])
        self.size = int(np.prod(self.shape.astype(object)))

    def point(self, index: int) -> np.ndarray:
        return np.array(np.unravel_index(index, self.shape))

    def index(self, point) -> int:
        return int(np.ravel_multi_index(np.clip(np.round(point).astype(int), 0, self.shape - 1), self.shape))

    def params(self, index: int) -> dict:
        return {n: v[k] for n, v, k in zip(self.names, self.values, self.point(index))}

    def unit(self, index) -> np.ndarray:
        """The point in [0, 1]^d."""
        return self.point(index) / np.maximum(1, self.shape - 1)

    def from_unit(self, u) -> int:
        return self.index(np.asarray(u) * (self.shape - 1))

    def neighbours(self, index: int) -> list[int]:
        p, out = self.point(index), []
        for d in range(len(p)):
            for step in (-1, 1):
                if 0 <= p[d] + step < self.shape[d]:
                    q = p.copy()
                    q[d] += step
                    out.append(self.index(q))
        return out


@dataclass
class Known:
    """Scores of this search so far, in order of evaluation."""

    indices: list[int]
    scores: list[float]

    def best(self) -> int:
        return self.indices[int(np.argmax(self.scores))]

    def score(self, index: int) -> float:
        return self.scores[self.indices.index(index)]

    def ranked(self) -> list[int]:
        return [self.indices[i] for i in np.argsort(self.scores, kind="stable")[::-1]]


Proposer = Callable[[Grid, Known, np.random.Generator, int], Iterator[int]]
ALGORITHMS: dict[str, Proposer] = {}


def algorithm(f: Proposer) -> Proposer:
    ALGORITHMS[f.__name__] = f
    return f


def _any(grid, rng) -> int:
    return int(rng.integers(grid.size))


@algorithm
def random_search(grid, known, rng, budget):
    while True:
        yield _any(grid, rng)


@algorithm
def latin_hypercube(grid, known, rng, budget):
    """Each axis cut into as many strata as evaluations, every stratum used once."""
    while True:
        strata = np.column_stack([rng.permutation(budget) for _ in grid.shape])
        for row in (strata + rng.random(strata.shape)) / budget:
            yield grid.index(np.floor(row * grid.shape))


@algorithm
def halton(grid, known, rng, budget):
    primes = [p for p in range(2, 1000) if all(p % q for q in range(2, int(p**0.5) + 1))][: len(grid.shape)]
    shift, i = rng.random(len(grid.shape)), 0
    while True:
        i += 1
        u = []
        for p in primes:
            x, f, k = 0.0, 1.0, i
            while k:
                f /= p
                x += f * (k % p)
                k //= p
            u.append(x)
        yield grid.index(np.floor(((np.array(u) + shift) % 1) * grid.shape))


@algorithm
def maximin(grid, known, rng, budget):
    """Of a sample the point farthest from all that are known."""
    while True:
        sample = [_any(grid, rng) for _ in range(64)]
        seen = np.array([grid.unit(i) for i in known.indices])
        yield max(sample, key=lambda i: np.min(((seen - grid.unit(i)) ** 2).sum(1)))


@algorithm
def hill_climb(grid, known, rng, budget):
    """To the best neighbour while there is a better one, then from a new start."""
    at = known.best()
    while True:
        around = grid.neighbours(at)
        rng.shuffle(around)
        for n in around:
            yield n
        better = [n for n in around if n in known.indices and known.score(n) > known.score(at)]
        if better:
            at = max(better, key=known.score)
        else:
            at = _any(grid, rng)
            yield at
            if at not in known.indices:
                at = known.best()


@algorithm
def coordinate_descent(grid, known, rng, budget):
    """All values of one parameter at the best point, one parameter after another."""
    while True:
        for d in rng.permutation(len(grid.shape)):
            base = grid.point(known.best())
            for v in rng.permutation(grid.shape[d]):
                q = base.copy()
                q[d] = v
                yield grid.index(q)


@algorithm
def pattern_search(grid, known, rng, budget):
    """Steps of half the range along each axis, halved when none is better."""
    step = np.maximum(1, grid.shape // 2)
    while True:
        before = known.best()
        for d in range(len(grid.shape)):
            for sign in (-1, 1):
                q = grid.point(before)
                q[d] += sign * step[d]
                yield grid.index(q)
        if known.best() == before:
            if (step == 1).all():
                yield _any(grid, rng)
            step = np.maximum(1, step // 2)


@algorithm
def tabu_search(grid, known, rng, budget):
    at, tabu = known.best(), []
    while True:
        around = [n for n in grid.neighbours(at) if n not in tabu] or [_any(grid, rng)]
        for n in around:
            yield n
        there = [n for n in around if n in known.indices]
        tabu = [*tabu, at][-8:]
        at = max(there, key=known.score) if there else _any(grid, rng)


def _walk(accept):
    def propose(grid, known, rng, budget):
        at, step = known.best(), 0
        while True:
            around = grid.neighbours(at)
            n = int(rng.choice(around)) if around and rng.random() < 0.8 else _any(grid, rng)
            yield n
            step += 1
            if n in known.indices and accept(known.score(n), known.score(at), known, step / budget, rng):
                at = n

    return propose


def _spread(known) -> float:
    return float(np.std([s for s in known.scores if math.isfinite(s)] or [0.0])) or 1.0


def _level(known, t) -> float:
    """The water: from the worst score known to the best, as the budget runs out."""
    good = [s for s in known.scores if math.isfinite(s)]
    return min(good) + (max(good) - min(good)) * min(1.0, t) if good else -math.inf


def _named(name: str, f: Proposer) -> None:
    f.__name__ = name
    ALGORITHMS[name] = f


_named("simulated_annealing", _walk(lambda new, old, k, t, rng: new >= old or rng.random() < math.exp((new - old) / (_spread(k) * max(1e-3, 1 - t)))))
_named("threshold_accepting", _walk(lambda new, old, k, t, rng: new >= old - _spread(k) * max(0.0, 1 - t)))
_named("great_deluge", _walk(lambda new, old, k, t, rng: new >= old or new >= _level(k, t)))


@algorithm
def differential_evolution(grid, known, rng, budget):
    while len(known.indices) < min(5, budget // 2 + 1):
        yield _any(grid, rng)
    while True:
        pool = known.ranked()[: max(4, budget // 2)]
        a, b, c = (grid.unit(int(rng.choice(pool))) for _ in range(3))
        target = grid.unit(pool[0])
        trial = np.where(rng.random(len(target)) < 0.8, a + 0.7 * (b - c), target)
        yield grid.from_unit(np.clip(trial, 0, 1))


@algorithm
def particle_swarm(grid, known, rng, budget):
    n = max(2, min(5, budget // 3))
    x = [grid.unit(known.best())] + [rng.random(len(grid.shape)) for _ in range(n - 1)]
    v = [np.zeros(len(grid.shape)) for _ in range(n)]
    own: list = [(-math.inf, p) for p in x]
    while True:
        for i in range(n):
            here = grid.from_unit(x[i])
            yield here
            if here in known.indices and known.score(here) > own[i][0]:
                own[i] = (known.score(here), x[i])
            top = grid.unit(known.best())
            v[i] = 0.6 * v[i] + 1.4 * rng.random() * (own[i][1] - x[i]) + 1.4 * rng.random() * (top - x[i])
            x[i] = np.clip(x[i] + v[i] + rng.normal(0, 0.02, len(top)), 0, 1)


@algorithm
def genetic_algorithm(grid, known, rng, budget):
    """Tournament parents, uniform crossover, a fifth of the genes drawn anew."""
    while len(known.indices) < min(4, budget // 2 + 1):
        yield _any(grid, rng)
    while True:
        pool = known.ranked()[: max(2, len(known.indices) // 2 + 1)]
        mother, father = (grid.point(pool[int(rng.integers(len(pool), size=2).min())]) for _ in range(2))
        child = np.where(rng.random(len(mother)) < 0.5, mother, father)
        yield grid.index(np.where(rng.random(len(child)) < 0.2, rng.integers(0, grid.shape), child))


@algorithm
def evolution_strategy(grid, known, rng, budget):
    """One parent, a child by normal steps; steps widen on success, else narrow."""
    sigma = 0.3
    while True:
        parent = known.best()
        child = grid.from_unit(np.clip(grid.unit(parent) + rng.normal(0, sigma, len(grid.shape)), 0, 1))
        yield child
        sigma = float(np.clip(sigma * (1.3 if known.best() != parent else 0.9), 0.05, 0.6))


@algorithm
def cross_entropy(grid, known, rng, budget):
    """Value frequencies of the best third, smoothed, give the next draws."""
    while True:
        elite = [grid.point(i) for i in known.ranked()[: max(2, len(known.indices) // 3)]]
        draw = []
        for d, n in enumerate(grid.shape):
            p = np.bincount([e[d] for e in elite], minlength=n) + 0.5
            draw.append(int(rng.choice(n, p=p / p.sum())))
        yield grid.index(np.array(draw))


@algorithm
def tpe(grid, known, rng, budget):
    """Of draws from the good points' density the one with the best ratio to the others' density."""
    while len(known.indices) < min(4, budget // 2 + 1):
        yield _any(grid, rng)
    while True:
        ranked = known.ranked()
        cut = max(1, len(ranked) // 4)
        good, rest = (np.array([grid.unit(i) for i in part]) for part in (ranked[:cut], ranked[cut:] or ranked))
        density = lambda u, points: np.exp(-((points - u) ** 2).sum(1) / 0.08).mean() + 1e-9
        draws = [np.clip(good[rng.integers(len(good))] + rng.normal(0, 0.2, good.shape[1]), 0, 1) for _ in range(24)]
        yield grid.from_unit(max(draws, key=lambda u: density(u, good) / density(u, rest)))


def _sampled(grid, known, rng) -> list[int]:
    return list({*(_any(grid, rng) for _ in range(96)), *grid.neighbours(known.best())})


@algorithm
def rbf_surrogate(grid, known, rng, budget):
    """Cubic radial functions through all scores; their best untried point, every third time the farthest."""
    turn = 0
    while True:
        turn += 1
        x = np.array([grid.unit(i) for i in known.indices])
        y = np.array(known.scores)
        distance = lambda a: np.sqrt(((a[:, None] - x[None]) ** 2).sum(2))
        weights = np.linalg.lstsq(distance(x) ** 3 + 1e-6 * np.eye(len(x)), y - y.mean(), rcond=None)[0]
        pool = [i for i in _sampled(grid, known, rng) if i not in known.indices] or [_any(grid, rng)]
        far = distance(np.array([grid.unit(i) for i in pool]))
        yield pool[int(np.argmax(far.min(1) if turn % 3 == 0 else far**3 @ weights))]


@algorithm
def knn_ucb(grid, known, rng, budget):
    """Mean of the three nearest scores plus their distance as a bonus."""
    while True:
        x, y = np.array([grid.unit(i) for i in known.indices]), np.array(known.scores)
        pool = [i for i in _sampled(grid, known, rng) if i not in known.indices] or [_any(grid, rng)]

        def promise(i):
            d = np.sqrt(((x - grid.unit(i)) ** 2).sum(1))
            near = np.argsort(d)[:3]
            return y[near].mean() + _spread(known) * d[near].mean()

        yield max(pool, key=promise)


@algorithm
def adaptive_random(grid, known, rng, budget):
    """Random around the best, closer and closer."""
    step = 0
    while True:
        step += 1
        width = max(0.05, 0.5 * (1 - step / budget))
        yield grid.from_unit(np.clip(grid.unit(known.best()) + rng.uniform(-width, width, len(grid.shape)), 0, 1))


@dataclass(frozen=True)
class Selection:
    initial_index: int
    selected_index: int
    evaluated: tuple[int, ...]
    score: float


def steps(name: str, grid: Grid, budget: int, seed: int) -> Generator[int, float | None, Selection]:
    """One algorithm as a generator: yields a candidate, is sent its score, returns the selection. `budget` different candidates at most, the first drawn at random. Ties go to the earlier; candidates without a score rank last."""
    rng = np.random.default_rng(seed)
    known = Known([], [])

    def take(i: int):
        s = yield i
        known.indices.append(i)
        known.scores.append(-math.inf if s is None or not math.isfinite(s) else float(s))

    first = _any(grid, rng)
    yield from take(first)
    proposals, idle = ALGORITHMS[name](grid, known, rng, budget), 0
    while len(known.indices) < min(budget, grid.size):
        i = next(proposals)
        if i in known.indices:
            idle += 1
            if idle < 50:
                continue
            left = [j for j in (range(grid.size) if grid.size <= 4096 else (_any(grid, rng) for _ in range(256))) if j not in known.indices]
            if not left:
                continue
            i = left[int(rng.integers(len(left)))]
        idle = 0
        yield from take(i)
    return Selection(first, known.best(), tuple(known.indices), max(known.scores))


def together(searches: dict, evaluate: Callable[[list], dict]) -> dict:
    """Selections of many searches (key: generator of steps), a round at a time: evaluate gets all (key, candidate) that wait and returns their scores."""
    out, waiting = {}, {k: next(g) for k, g in searches.items()}
    while waiting:
        scores = evaluate(list(waiting.items()))
        following = {}
        for k, i in waiting.items():
            try:
                following[k] = searches[k].send(scores[k, i])
            except StopIteration as end:
                out[k] = end.value
        waiting = following
    return out


def search(name: str, grid: Grid, evaluate: Callable[[int], float | None], budget: int, seed: int) -> Selection:
    """Runs one algorithm by itself. evaluate may keep a cache of its own."""
    return together({0: steps(name, grid, budget, seed)}, lambda asked: {(k, i): evaluate(i) for k, i in asked})[0]
