"""Kernels against brute force and against facts about named graphs."""

import math
import random
import time
from itertools import combinations, permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grovespark.functions import bitgraph as bg


@st.composite
def graphs(draw, most=8):
    n = draw(st.integers(1, most))
    pairs = list(combinations(range(n), 2))
    return n, [p for p in pairs if draw(st.booleans())]


@given(graphs())
@settings(max_examples=80, deadline=None)
def test_solver_equals_definition(g):
    n, edges = g
    nb = bg.build(n, edges)
    solver = bg.Solver(nb)
    for part in bg.components(nb, (1 << n) - 1):
        td = bg.brute_force(nb, part)
        assert solver.solve(part) == (td, td)
        parent = solver.tree(part)
        above = {}
        for v in parent:
            w, up = v, set()
            while w >= 0:
                up.add(w)
                w = parent[w]
            above[v] = up
        assert max(map(len, above.values())) == td
        assert all(u in above[v] or v in above[u] for u, v in edges if part >> u & 1)


@given(graphs(7))
@settings(max_examples=60, deadline=None)
def test_minimal_separators_equal_definition(g):
    n, edges = g
    nb = bg.build(n, edges)
    for part in bg.components(nb, (1 << n) - 1):
        found = set(bg.minimal_separators(nb, part))
        wanted = set()
        for mask in range(1, 1 << n):
            if mask & ~part == 0:
                full = [c for c in bg.components(nb, part & ~mask) if bg.around(nb, c) & part == mask]
                if len(full) >= 2:
                    wanted.add(mask)
        assert found == wanted
        for sep in wanted:
            smaller = any(len(bg.components(nb, part & ~sub)) > 1 for sub in range(sep) if sub & ~sep == 0)
            assert bg.is_fully_minimal(nb, part, sep) == (not smaller)


@given(graphs(6))
@settings(max_examples=40, deadline=None)
def test_automorphisms_equal_definition(g):
    n, edges = g
    nb, have = bg.build(n, edges), {frozenset(e) for e in edges}
    wanted = {p for p in permutations(range(n)) if {frozenset((p[u], p[v])) for u, v in edges} == have}
    assert {tuple(p) for p in bg.automorphisms(nb, n)} == wanted
    made, size = bg.generators(nb, n)
    reached, todo = {tuple(range(n))}, [tuple(range(n))]
    while todo:
        at = todo.pop()
        more = {tuple(p[x] for x in at) for p in made} - reached
        reached |= more
        todo += more
    assert reached == wanted and size == len(wanted)


def test_large_groups_are_not_listed():
    star = bg.build(41, [(0, v) for v in range(1, 41)])
    assert bg.generators(star, 41)[1] == math.factorial(40)
    apart = bg.build(30, [(v, v + 1) for v in range(0, 30, 2)])
    assert bg.generators(apart, 30)[1] == math.factorial(15) << 15


@given(graphs(7), st.integers(0, 7), st.integers(0, 7))
@settings(max_examples=80, deadline=None)
def test_window_is_decided(g, low, high):
    n, edges = g
    nb = bg.build(n, edges)
    for part in bg.components(nb, (1 << n) - 1):
        td = bg.brute_force(nb, part)
        solver = bg.Solver(nb, window=(low, high))
        a, b = solver.solve(part)
        assert a <= td <= b and (a == b or a >= high or b <= low or low > high)
        assert bg.depth_of(solver.tree(part)) <= b


def test_window_saves_the_rest():
    """A lower bound that reaches the window's end stops the search at once, whatever the exact value costs."""
    n = 60
    rng = random.Random(1)
    nb = bg.build(n, [p for p in combinations(range(n), 2) if rng.random() < 0.15])
    solver = bg.Solver(nb, 60, (1, 6))
    low, up = solver.solve((1 << n) - 1)
    assert 6 <= low < up and time.monotonic() < solver.until - 50


@given(st.integers(1, 40), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_tree_ranks_equal_solver(n, rng):
    nb = bg.build(n, [(v, rng.randrange(v)) for v in range(1, n)])
    td, root = bg.tree_ranks(nb, (1 << n) - 1)
    assert all(bg.tree_ranks(nb, c)[0] < td for c in bg.components(nb, (1 << n) - 1 & ~(1 << root)))
    if n <= 10:
        assert td == bg.brute_force(nb, (1 << n) - 1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 15, 16, 40])
def test_named_graphs(n):
    path = bg.build(n, [(i, i + 1) for i in range(n - 1)])
    assert bg.Solver(path).solve((1 << n) - 1) == (n.bit_length(),) * 2
    whole = bg.build(n, combinations(range(n), 2))
    assert bg.Solver(whole).solve((1 << n) - 1) == (n, n)
    if n > 2:
        ring = bg.build(n, [(i, (i + 1) % n) for i in range(n)])
        assert bg.Solver(ring).solve((1 << n) - 1) == (1 + (n - 1).bit_length(),) * 2


def test_time_limit_gives_proved_bounds():
    n = 30
    nb = bg.build(n, [(i, j) for i, j in combinations(range(n), 2) if (i * 7 + j * 11) % 5 < 2])
    low, up = bg.Solver(nb, 0.0).solve((1 << n) - 1)
    assert 1 <= low <= up <= n


@given(graphs(8))
@settings(max_examples=80, deadline=None)
def test_articulation_equals_definition(g):
    n, edges = g
    nb, whole = bg.build(n, edges), (1 << n) - 1
    many = len(bg.components(nb, whole))
    alone = lambda v: not nb[v]
    assert bg.articulation(nb, whole) == sum(1 << v for v in range(n) if len(bg.components(nb, whole & ~(1 << v))) > many - alone(v))


@given(graphs(7))
@settings(max_examples=60, deadline=None)
def test_path_shares_equal_definition(g):
    n, edges = g
    beside = [[] for _ in range(n)]
    for u, v in edges:
        beside[u].append(v)
        beside[v].append(u)
    want = [0.0] * n
    for s in range(n):
        found = {s: [[s]]}  # shortest paths by their end
        front = {s: [[s]]}
        while front:
            more = {}
            for v, paths in front.items():
                for w in beside[v]:
                    if w not in found:
                        more.setdefault(w, []).extend([*p, w] for p in paths)
            found |= more
            front = more
        for t, paths in found.items():
            for p in paths:
                for v in p[1:-1]:
                    want[v] += 1 / len(paths)
    assert all(abs(a - b) < 1e-9 for a, b in zip(bg.path_shares(beside, range(n)), want))


#: Treedepths that follow from the definition: one more than a cycle's, one more than the smaller side; None: by brute force.
NAMED = {"wheel_20": 7, "wheel_60": 8, "bipartite_5_9": 6, "petersen": None, "grid_3x4": None, "cube_3": None, "ladder_6": None}


def named(name):
    kind, *size = name.replace("x", "_").split("_")
    size = list(map(int, size))
    if kind == "petersen":
        return 10, [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)] + [(i, 5 + i) for i in range(5)]
    if kind == "grid":
        a, b = size
        return a * b, [(i * b + j, i * b + j + 1) for i in range(a) for j in range(b - 1)] + [(i * b + j, i * b + b + j) for i in range(a - 1) for j in range(b)]
    if kind == "cube":
        return 1 << size[0], [(v, v ^ 1 << k) for v in range(1 << size[0]) for k in range(size[0]) if v < v ^ 1 << k]
    if kind == "wheel":
        n = size[0]
        return n + 1, [(i, (i + 1) % n) for i in range(n)] + [(i, n) for i in range(n)]
    if kind == "ladder":
        n = size[0]
        return 2 * n, [(i, i + 1) for i in range(n - 1)] + [(n + i, n + i + 1) for i in range(n - 1)] + [(i, n + i) for i in range(n)]
    a, b = size
    return a + b, [(i, a + j) for i in range(a) for j in range(b)]


@pytest.mark.parametrize("name", sorted(NAMED))
def test_known_treedepths(name):
    n, edges = named(name)
    nb, whole = bg.build(n, edges), (1 << n) - 1
    assert bg.Solver(nb, 60).solve(whole) == (NAMED[name] or bg.brute_force(nb, whole),) * 2


def test_large_separator_counts():
    """A graph of 26 vertices with some long cycles against the definition on all small sets, and grown sets as arrays and as lists."""
    rng = random.Random(4)
    edges = [(v, rng.randrange(v)) for v in range(1, 26)] + [tuple(rng.sample(range(26), 2)) for _ in range(8)]
    nb, whole = bg.build(26, edges), (1 << 26) - 1
    found = set(bg.minimal_separators(nb, whole))
    small = {1 << a | 1 << b for a in range(26) for b in range(26)}
    full = lambda s: sum(bg.around(nb, c) == s for c in bg.components(nb, whole & ~s)) >= 2
    assert {s for s in found if s.bit_count() <= 2} == {s for s in small if full(s)} and all(map(full, found))


def ended(steps):
    """What a generator returns."""
    while True:
        try:
            next(steps)
        except StopIteration as end:
            return end.value


@pytest.mark.parametrize("arrays", [0, 10_000])
def test_grown_sets_as_arrays_and_as_lists(monkeypatch, arrays):
    monkeypatch.setattr(bg, "ARRAYS", arrays)
    for seed in range(6):
        rng = random.Random(seed)
        n = (12, 70, 14)[seed % 3]
        edges = [(v, rng.randrange(max(0, v - 4), v)) for v in range(1, n)] + [(v, rng.randrange(v)) for v in range(2, n, 5 if n < 20 else 12)]
        nb, whole = bg.build(n, edges), (1 << n) - 1
        td = bg.brute_force(nb, whole) if n < 20 else bg.Solver(nb).solve(whole)[1]
        assert ended(bg.growing(nb, whole, td - 1)) is None
        parents = ended(bg.growing(nb, whole, td))
        assert len(parents) == n and bg.depth_of(parents) == td


@pytest.mark.parametrize("seed", range(40))
def test_cuts_in_batches_equal_one_by_one(seed, monkeypatch):
    rng = random.Random(seed)
    n, p = rng.randint(3, 24), rng.random() * 0.4 + 0.1
    nb = bg.build(n, [(a, b) for a in range(n) for b in range(a) if rng.random() < p])
    monkeypatch.setattr(bg, "BATCH_ROWS", rng.choice([3, 4096]))
    for part in bg.components(nb, (1 << n) - 1):
        want = {s: sorted(bg.components(nb, part & ~s)) for s in bg.minimal_separators(nb, part) if bg.is_fully_minimal(nb, part, s)}
        found = list(bg.Cuts(nb, part).fully_minimal())
        assert {s: sorted(x) for s, x, _ in found} == want and len(found) == len(want)
        assert all(most == max(map(int.bit_count, x)) for _, x, most in found)


def test_bounds_by_parts():
    rng, known = random.Random(1), bg.Bounds(130)
    sets = {}
    for _ in range(3000):
        mask = sum(1 << v for v in rng.sample(range(130), rng.randint(1, 6)))
        low = rng.randint(1, 4)
        sets[mask] = (low, low + rng.randint(0, 3))
        known.put(mask, *sets[mask])
    for _ in range(200):
        mask = sum(1 << v for v in rng.sample(range(130), rng.randint(20, 70)))
        within = {t: x for t, x in sets.items() if not t & ~mask}
        lower, upper, part = known.best(mask)
        if not within:
            assert (lower, part) == (0, 0)
            continue
        assert lower == max(a for a, _ in within.values()) and upper == min(b + (mask & ~t).bit_count() for t, (_, b) in within.items())
        assert upper == within[part][1] + (mask & ~part).bit_count()
        for k in range(1, 6):
            assert known.deep(mask, k) == any(a >= k for a, _ in within.values())
            some = known.tightest(mask, k, 5)
            assert all(within[t][0] == low >= k for t, low in some) and len(some) == min(5, sum(a >= k for a, _ in within.values()))
