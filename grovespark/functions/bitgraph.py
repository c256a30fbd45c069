"""Graphs of one task as integers: bit v of nb[u] is set if u and v are neighbours.

These are the per-graph kernels that Arrow functions call; a graph is a batch row, not a table.
"""

from __future__ import annotations

import random
import time
from collections.abc import Generator, Iterator, Sequence

import numpy as np


#: For each place of a byte, the bits that each of its values sets; places are added as they are met.
_PLACES: list[list[tuple[int, ...]]] = []


def bits(mask: int) -> Sequence[int]:
    """Bits set in a mask, in order."""
    if mask.bit_count() < 4:
        few = []
        while mask:
            low = mask & -mask
            few.append(low.bit_length() - 1)
            mask ^= low
        return few
    data = mask.to_bytes((mask.bit_length() + 7) // 8, "little")
    while len(_PLACES) < len(data):
        at = 8 * len(_PLACES)
        _PLACES.append([tuple(at + i for i in range(8) if x >> i & 1) for x in range(256)])
    out: list[int] = []
    for place, x in zip(_PLACES, data):
        if x:
            out += place[x]
    return out


def build(n: int, edges) -> list[int]:
    nb = [0] * n
    for u, v in edges:
        if u != v:
            nb[u] |= 1 << v
            nb[v] |= 1 << u
    return nb


def around(nb: list[int], mask: int) -> int:
    """Neighbours of a set, itself left out."""
    out, left = 0, mask
    while left:
        low = left & -left
        out |= nb[low.bit_length() - 1]
        left ^= low
    return out & ~mask


def flood(nb: list[int], start: int, inside: int) -> int:
    found = front = start & inside
    while front:
        grown = 0
        while front:
            low = front & -front
            grown |= nb[low.bit_length() - 1]
            front ^= low
        front = grown & inside & ~found
        found |= front
    return found


def components(nb: list[int], inside: int) -> list[int]:
    out = []
    while inside:
        part = flood(nb, inside & -inside, inside)
        out.append(part)
        inside &= ~part
    return out


def core(nb: list[int], inside: int, k: int) -> int:
    """What stays after vertices of degree below k are taken off again and again."""
    todo = [v for v in bits(inside) if (nb[v] & inside).bit_count() < k]
    while todo:
        v = todo.pop()
        if inside >> v & 1:
            inside &= ~(1 << v)
            todo += [w for w in bits(nb[v] & inside) if (nb[w] & inside).bit_count() < k]
    return inside


def minimal_separators(nb: list[int], inside: int, limit: int | None = None, stop=None) -> Iterator[int]:
    """All minimal separators of a connected set: neighbourhoods of what is left without a closed
    neighbourhood, then without a separator and the neighbours of one of its members. With a limit,
    larger separators are passed on to the expansion but not yielded."""
    seen: set[int] = set()
    queue: list[int] = []

    def meet(removed: int) -> None:
        rest = inside & ~removed
        while rest:
            part = flood(nb, rest & -rest, rest)
            rest &= ~part
            sep = around(nb, part) & inside
            if sep and sep not in seen:
                seen.add(sep)
                queue.append(sep)

    for v in bits(inside):
        if inside & ~(nb[v] | 1 << v):
            meet((nb[v] & inside) | 1 << v)
    at = 0
    while at < len(queue):
        sep = queue[at]
        at += 1
        if limit is None or sep.bit_count() <= limit:
            yield sep
        if stop:
            stop()
        for v in bits(sep):
            meet(sep | (nb[v] & inside))


def is_fully_minimal(nb: list[int], inside: int, sep: int, leaf_tolerant: bool = False) -> bool:
    """Whether every component beside sep sees all of it; leaf_tolerant excuses single leaves."""
    parts = components(nb, inside & ~sep)
    for part in parts:
        if leaf_tolerant and part.bit_count() == 1 and (nb[part.bit_length() - 1] & inside).bit_count() == 1:
            continue
        if around(nb, part) & inside != sep:
            return False
    return len(parts) > 1


#: Vertices from which on separators are found in batches, and rows of one batch.
BATCHED = 14
BATCH_ROWS = 4096


class Cuts:
    """The fully minimal separators of a connected set, with the components beside each, found for many sets at a time.

    Sets are rows of a matrix with a column a vertex, so a step of all their floods is one product with
    the matrix of neighbours. The search is that of minimal_separators.
    """

    def __init__(self, nb: list[int], inside: int, stop=None):
        self.names, self.stop = np.array(bits(inside)), stop
        place = {v: k for k, v in enumerate(self.names.tolist())}
        n = len(place)
        self.near = np.zeros((n, n), np.float32)
        for v, k in place.items():
            for w in bits(nb[v] & inside):
                self.near[k, place[w]] = 1
        self.sees = self.near > 0

    def parts(self, removed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, component, its neighbours) of what is left of the whole without each row of removed: one component of each row at a time, those of the first vertices first."""
        rest, rows = ~removed, np.arange(len(removed))
        while True:
            some = rest.any(axis=1)
            if not some.any():
                return
            rest, rows = rest[some], rows[some]
            found = np.zeros_like(rest)
            found[np.arange(len(rest)), rest.argmax(axis=1)] = True
            reach, front = np.zeros_like(rest), found
            while front.any():
                met = front.astype(np.float32) @ self.near > 0
                reach |= met
                front = met & rest & ~found
                found = found | front
            yield rows, found, reach & ~found
            rest = rest & ~found

    def minimal(self) -> Iterator[np.ndarray]:
        """The minimal separators, as matrices of new ones."""
        seen = {bytes(-(-len(self.names) // 8))}  # without the empty one

        def fresh(removed: np.ndarray) -> np.ndarray:
            out = []
            for at in range(0, len(removed), BATCH_ROWS):
                if self.stop:
                    self.stop()
                for _, _, sep in self.parts(removed[at : at + BATCH_ROWS]):
                    keys = np.packbits(sep, axis=1)
                    new = []
                    for k, key in enumerate(keys.view(f"V{keys.shape[1]}")[:, 0].tolist()):
                        if key not in seen:
                            seen.add(key)
                            new.append(k)
                    out.append(sep[new])
            return np.concatenate([*out, np.zeros((0, len(self.names)), bool)])

        own = np.eye(len(self.names), dtype=bool) | self.sees
        front = fresh(own[~own.all(axis=1)])
        while len(front):
            yield front
            new = []
            for at in range(0, len(front), BATCH_ROWS):
                row, v = np.nonzero(front[at : at + BATCH_ROWS])
                new.append(fresh(front[at + row] | self.sees[v]))
            front = np.concatenate(new)

    def masks(self, rows: np.ndarray) -> list[int]:
        """Rows as sets of the graph's vertices."""
        wide = np.zeros((len(rows), int(self.names[-1]) + 1), bool)
        wide[:, self.names] = rows
        return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(wide, axis=1, bitorder="little")]

    def fully_minimal(self) -> Iterator[tuple[int, list[int], int]]:
        """(separator, components beside it, size of the largest)."""
        for front in self.minimal():
            for at in range(0, len(front), BATCH_ROWS):
                seps = front[at : at + BATCH_ROWS]
                good, largest, found = np.ones(len(seps), bool), np.zeros(len(seps), np.int64), []
                for rows, part, sees in self.parts(seps):
                    good[rows] &= (sees == seps[rows]).all(axis=1)
                    largest[rows] = np.maximum(largest[rows], part.sum(axis=1))
                    found.append((rows, part))
                parts: dict[int, list[int]] = {k: [] for k in np.flatnonzero(good).tolist()}
                for rows, part in found:
                    whole = good[rows]
                    for k, mask in zip(rows[whole].tolist(), self.masks(part[whole])):
                        parts[k].append(mask)
                for k, mask in zip(parts, self.masks(seps[good])):
                    yield mask, parts[k], int(largest[k])


def dfs_parents(nb: list[int], inside: int, root: int) -> dict[int, int]:
    """Parents (root: -1) of a depth-first search that visits larger neighbours first."""
    parent, stack = {}, [(root, -1)]
    while stack:
        v, up = stack.pop()
        if v in parent:
            continue
        parent[v] = up
        stack += [(w, v) for w in bits(nb[v] & inside) if w not in parent]
    return parent


def depth_of(parent: dict[int, int]) -> int:
    depth: dict[int, int] = {}
    for v in parent:  # parents are met before their children
        depth[v] = 1 if parent[v] < 0 else depth[parent[v]] + 1
    return max(depth.values(), default=0)


def articulation(nb: list[int], inside: int) -> int:
    """Vertices whose removal splits a component, by one depth-first search: those with a subtree that reaches no higher."""
    out, met = 0, 0
    when: dict[int, int] = {}
    reach: dict[int, int] = {}
    for start in bits(inside):
        if met >> start & 1:
            continue
        met |= 1 << start
        when[start] = reach[start] = len(when)
        path, left, branches = [start], {start: nb[start] & inside}, 0
        while path:
            v = path[-1]
            if left[v]:
                low = left[v] & -left[v]
                left[v] ^= low
                w = low.bit_length() - 1
                if met & low:
                    if len(path) < 2 or w != path[-2]:
                        reach[v] = min(reach[v], when[w])
                else:
                    met |= low
                    when[w] = reach[w] = len(when)
                    left[w] = nb[w] & inside
                    path.append(w)
                continue
            path.pop()
            if len(path) == 1:
                branches += 1
            elif path and reach[v] >= when[path[-1]]:
                out |= 1 << path[-1]
            if path:
                reach[path[-1]] = min(reach[path[-1]], reach[v])
        if branches > 1:
            out |= 1 << start
    return out


def path_shares(beside: list[list[int]], sources) -> list[float]:
    """For each vertex the sum, over shortest paths from the sources, of its share of those to each target (after Brandes, 2001)."""
    n = len(beside)
    score = [0.0] * n
    for s in sources:
        level, paths, share, order = [-1] * n, [0.0] * n, [0.0] * n, [s]
        level[s], paths[s] = 0, 1.0
        for v in order:  # grows while it is read
            for w in beside[v]:
                if level[w] < 0:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] > level[v]:
                    paths[w] += paths[v]
        for w in order[:0:-1]:
            each = (1 + share[w]) / paths[w]
            for v in beside[w]:
                if level[v] < level[w]:
                    share[v] += paths[v] * each
            score[w] += share[w]
    return score


def tree_ranks(nb: list[int], inside: int) -> tuple[int, int]:
    """(treedepth, root) of a tree: least ranks such that equal ranks have a larger one between them."""
    root = (inside & -inside).bit_length() - 1
    order, parent = [root], {root: -1}
    for v in order:
        for w in bits(nb[v] & inside):
            if w not in parent:
                parent[w] = v
                order.append(w)
    seen: dict[int, set[int]] = {}
    rank: dict[int, int] = {}
    for v in reversed(order):
        below = [seen.pop(w) for w in bits(nb[v] & inside) if w != parent[v]]
        once: set[int] = set()
        twice = 0
        for s in below:
            twice = max(twice, max(once & s, default=0))
            once |= s
        r = twice + 1
        while r in once:
            r += 1
        rank[v] = r
        seen[v] = {r} | {x for x in once if x > r}
    top = max(rank, key=lambda v: (rank[v], -v))
    return rank[top], top


class OutOfTime(Exception):
    pass


#: Elimination orders tried for an upper bound, and steps of growing before separators take over.
ORDERS = 60
GROW_STEPS = 50_000_000
#: Seconds that each way of solving a part has in the first round, and by how much they rise.
FIRST_SECONDS, RISE = 0.2, 3
#: Edges for each vertex up to which a graph is sparse, the share of the time that growing has there, and rounds before it has.
SPARSE, GROW_SHARE, EVEN_TURNS = 2.3, 0.9, 2
#: How far below the depth asked for the known depth of a part may be to rule out separators.
NEAR = 4
#: More than any height or weight in an elimination order.
BEYOND = 1 << 40


def elimination_parents(nb: list[int], mask: int, weight: float, rng: random.Random, last: dict[int, int] | None = None) -> tuple[int, dict[int, int]]:
    """(depth, parents) of the forest of an elimination order that prefers low and loosely tied vertices; those in last come last, by its numbers."""
    left = {v: nb[v] & mask for v in bits(mask)}
    height = dict.fromkeys(left, 1)
    noise = {v: rng.random() * 0.5 for v in left}
    gone: list[tuple[int, int]] = []
    while left:
        v = min(left, key=lambda x: last[x] * BEYOND if last and x in last else height[x] + weight * left[x].bit_count() + noise[x])
        beside = left.pop(v)
        gone.append((v, beside))
        for u in bits(beside):
            left[u] = (left[u] | beside) & ~(1 << u | 1 << v)
            height[u] = max(height[u], height[v] + 1)
    when = {v: k for k, (v, _) in enumerate(gone)}
    return max(height.values()), {v: min(bits(beside), key=when.__getitem__) if beside else -1 for v, beside in gone}


def closed_form(nb: list[int], mask: int) -> tuple[int, int] | None:
    """(treedepth, a vertex to start a best tree with, as a mask) of a connected set that is complete, a tree or a cycle, or has two vertices at most."""
    n, low = mask.bit_count(), mask & -mask
    if n <= 2:
        return n, low
    degree = {v: (nb[v] & mask).bit_count() for v in bits(mask)}
    m, most = sum(degree.values()) // 2, max(degree.values())
    if m == n * (n - 1) // 2:
        return n, low
    if m == n - 1:
        if most == n - 1:
            return 2, 1 << max(degree, key=lambda v: (degree[v], -v))
        t, root = tree_ranks(nb, mask)
        return t, 1 << root
    return (1 + (n - 1).bit_length(), low) if most == 2 else None


def lower_bound(nb: list[int], mask: int) -> int:
    """Of a connected set of no closed form: by its edges, its cores and the depth of a depth-first search."""
    degree = {v: (nb[v] & mask).bit_count() for v in bits(mask)}
    n, m, least = len(degree), sum(degree.values()) // 2, min(degree.values())
    parents = dfs_parents(nb, mask, min(degree, key=lambda v: (degree[v], v)))
    lower = max(m // n + 2 if m > n else 3, least + 1, depth_of(parents).bit_length())
    inner, k = mask, least + 1
    while inner := core(nb, inner, k):
        lower, k = max(lower, k + 1), k + 1
    return lower


def own_tree(nb: list[int], mask: int, orders: int = 10) -> tuple[int, dict[int, int]]:
    """(depth, parents) of a good tree of a connected set, always the same one: the best one where there is a closed form, else of some elimination orders."""
    if closed_form(nb, mask):
        parents: dict[int, int] = {}
        todo = [(mask, -1)]
        while todo:
            part, up = todo.pop()
            root = closed_form(nb, part)[1]
            v = root.bit_length() - 1
            parents[v] = up
            todo += [(c, v) for c in components(nb, part & ~root)]
        return closed_form(nb, mask)[0], parents
    rng = random.Random(mask.bit_count())
    return min((elimination_parents(nb, mask, (0.1, 0.3, 0.6, 1.0, 2.0)[k % 5], rng) for k in range(orders)), key=lambda x: x[0])


#: From how many sets on they are tested as arrays.
ARRAYS = 40


class _Shelf:
    """Sets with their neighbours, many of them also as arrays of 64-bit words, so that all are tested against one set at once."""

    __slots__ = ("items", "words", "parts", "edges")

    def __init__(self, items: list[tuple[int, int]], words: int):
        self.items, self.words = items, words
        if len(items) >= ARRAYS:
            data = b"".join([x.to_bytes(8 * words, "little") for pair in items for x in pair])
            rows = np.frombuffer(data, "<u8").reshape(-1, 2, words)
            self.parts, self.edges = ([np.ascontiguousarray(rows[:, side, k]) for k in range(words)] for side in (0, 1))

    def fitting(self, start: int, taken: int, beside: int, room: int) -> list[int]:
        """Places, from start on, of sets that share nothing with taken and have, with beside, at most room neighbours."""
        items = self.items
        if len(items) < ARRAYS or len(items) - start < ARRAYS // 2:
            return [k for k in range(start, len(items)) if not items[k][0] & taken and (items[k][1] | beside).bit_count() <= room]
        met = self.parts[0][start:] & np.uint64(taken & _WORD)
        for k in range(1, self.words):
            met |= self.parts[k][start:] & np.uint64(taken >> 64 * k & _WORD)
        free = (met == 0).nonzero()[0]
        if not len(free):
            return []
        free += start
        many = np.bitwise_count(self.edges[0][free] | np.uint64(beside & _WORD))
        for k in range(1, self.words):
            many = many + np.bitwise_count(self.edges[k][free] | np.uint64(beside >> 64 * k & _WORD))
        return free[many <= room].tolist()


_WORD = (1 << 64) - 1


def growing(nb: list[int], mask: int, limit: int) -> Generator[None, None, dict[int, int] | None]:
    """Parents of an elimination tree of depth at most limit for a connected set, or None if there is none; stops at each step, so that it can be left and gone on with.

    Round i holds all connected sets of treedepth at most i with few enough neighbours, limit - i at
    most, to hang below these. A set of the next round is a vertex and sets beside it that do not touch
    each other; one of them must be new. Neighbours of the parts other than the vertex stay outside for
    good, which cuts a combination off as soon as they are too many (after Trimble, 2020).
    """
    root: dict[int, int] = {}
    words = (mask.bit_length() + 63) // 64
    old: dict[int, list[tuple[int, int]]] = {w: [] for w in bits(mask)}  # sets next to w, with their neighbours but w
    new: dict[int, list[tuple[int, int]]] = {w: [] for w in old}
    for i in range(1, limit + 1):
        room, made = limit - i, {}
        for w in old:
            own, bit = nb[w] & mask, 1 << w
            if i == 1 and own.bit_count() <= room:
                made[bit] = w
            old[w] = [x for x in (*new[w], *old[w]) if x[1].bit_count() <= room]
            news = sum(x[1].bit_count() <= room for x in new[w])
            shelf = _Shelf(old[w], words)
            for f in range(news):
                yield
                part, edge = old[w][f]
                more = _Shelf([old[w][k] for k in shelf.fitting(f + 1, part | edge, edge, room)], words)
                todo = [(part, edge, 0)]
                while todo:
                    union, beside, at = todo.pop()
                    whole = union | bit
                    if ((beside | own) & ~whole).bit_count() <= room and whole not in root and whole not in made:
                        made[whole] = w
                    if at < len(more.items):
                        yield
                        todo += [(union | more.items[k][0], beside | more.items[k][1], k + 1) for k in more.fitting(at, union | beside, beside, room)]
            new[w] = []
        root |= made
        if mask in root:
            break
        for found in made:
            edge = around(nb, found) & mask
            for w in bits(edge):
                new[w].append((found, edge & ~(1 << w)))
    else:
        return None
    parents: dict[int, int] = {}
    todo = [(mask, -1)]
    while todo:
        part, up = todo.pop()
        v = root[part]
        parents[v] = up
        todo += [(c, v) for c in components(nb, part & ~(1 << v))]
    return parents


class Bounds:
    """Bounds of the sets met so far, and those of a set by its parts.

    Sets are rows of 64-bit words, so one set is compared with all of them at once. A part is no deeper
    than the whole, and the whole no deeper than the part with all else on top.
    """

    def __init__(self, n: int):
        self.width, self.row, self.many = max(1, (n + 63) // 64), {}, 0
        self.words, self.outside = np.zeros((self.width, 1024), np.uint64), np.zeros(1024, np.int32)
        self.lower, self.upper = np.zeros(1024, np.int32), np.zeros(1024, np.int32)

    def _split(self, mask: int) -> list[np.uint64]:
        return [np.uint64(mask >> 64 * k & _WORD) for k in range(self.width)]

    def put(self, mask: int, lower: int, upper: int) -> None:
        k = self.row.get(mask)
        if k is None:
            k = self.row[mask] = self.many
            self.many += 1
            if k == len(self.lower):
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
                self.lower, self.upper, self.outside = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lower, self.upper, self.outside))
            self.words[:, k], self.outside[k] = self._split(mask), -mask.bit_count()
        self.lower[k], self.upper[k] = lower, upper

    def parts(self, mask: int, least: int = 0) -> np.ndarray:
        """Rows of the sets within mask whose treedepth is at least so much."""
        rows = np.flatnonzero(self.lower[: self.many] >= least) if least else slice(self.many)
        out = None
        for words, rest in zip(self.words, self._split(~mask)):
            met = words[rows] & rest
            out = met if out is None else out | met
        return np.flatnonzero(out == 0) if isinstance(rows, slice) else rows[out == 0]

    def best(self, mask: int) -> tuple[int, int, int]:
        """(lower, upper, the part that gives the upper one); 0 and no part if none is known."""
        found = self.parts(mask)
        if not len(found):
            return 0, BEYOND, 0
        above = self.upper[found] + self.outside[found]
        k = int(above.argmin())
        return int(self.lower[found].max()), int(above[k]) + mask.bit_count(), self.mask(int(found[k]))

    def mask(self, row: int) -> int:
        return sum(int(w) << 64 * k for k, w in enumerate(self.words[:, row]))

    def deep(self, mask: int, least: int) -> bool:
        return len(self.parts(mask, least)) > 0

    def tightest(self, mask: int, least: int, many: int) -> list[tuple[int, int]]:
        """(set, lower) of the smallest parts of mask of at least such a treedepth."""
        found = self.parts(mask, least)
        found = found[np.argsort(-self.outside[found], kind="stable")[:many]]
        return [(self.mask(k), int(self.lower[k])) for k in found.tolist()]


#: Vertices from which on a set's bounds are kept for those it is a part of, and parts that rule out separators.
KEPT = 5
TIGHT = 24


class Solver:
    """Exact treedepth of connected sets, with proved bounds for each set met.

    A whole set is bounded from above by elimination orders and from below by growing sets from the
    leaves up for rising depths, until both meet; where growing takes too long, by branching on separators.

    A set of treedepth t that is not complete has a fully minimal separator S with t = |S| plus the
    largest treedepth beside S. States are vertex sets; each keeps a lower and an upper bound and the
    set to take off for the upper one.
    """

    def __init__(self, nb: list[int], seconds: float | None = None, window: tuple[int, int] | None = None):
        self.nb = nb
        self.until = None if seconds is None else time.monotonic() + seconds
        self.window = window
        self.state: dict[int, list] = {}  # mask: lower, upper, what to take off
        self.separators: dict[int, list[tuple[int, list[int], int]]] = {}
        self.known = Bounds(len(nb))
        self.growth: dict[int, list] = {}  # mask: growing that goes on, steps that are left

    def check(self) -> None:
        if self.until is not None and time.monotonic() > self.until:
            raise OutOfTime

    def bounds(self, mask: int) -> list:
        got = self.state.get(mask)
        if got is None:
            got = self.state[mask] = self._first(mask)
            if got[0] < got[1]:
                lower, upper, part = self.known.best(mask)
                got[0] = max(got[0], lower)
                if upper < got[1]:
                    got[1], got[2] = upper, mask & ~part
            self._note(mask)
        return got

    def _note(self, mask: int) -> None:
        """Keep a set's bounds for the sets that it is a part of."""
        if mask.bit_count() >= KEPT:
            self.known.put(mask, *self.state[mask][:2])

    def open(self, mask: int) -> bool:
        """Whether there is more to find: bounds apart and, with a window (low, high), neither a lower bound of at least high nor an upper one of at most low."""
        lower, upper, _ = self.bounds(mask)
        return lower < upper and (self.window is None or lower < self.window[1] and upper > self.window[0] <= self.window[1])

    def _first(self, mask: int) -> list:
        nb, got = self.nb, closed_form(self.nb, mask)
        if got:
            return [got[0], got[0], got[1]]
        degree = {v: (nb[v] & mask).bit_count() for v in bits(mask)}
        hub = max(degree, key=lambda v: (degree[v], -v))
        lower = lower_bound(nb, mask)
        # taking off the hub gives the first upper bound, its components bounded the same way
        self.state[mask] = [lower, mask.bit_count(), 1 << hub]
        worst = max(self.bounds(c)[1] for c in components(nb, mask & ~(1 << hub)))
        return [min(lower, worst + 1), worst + 1, 1 << hub]

    def cuts(self, mask: int) -> list[tuple[int, list[int], int]]:
        """(size, components beside it, separator) of fully minimal separators, balanced ones first."""
        if mask not in self.separators:
            ranked = []
            if mask.bit_count() >= BATCHED:
                for sep, parts, largest in Cuts(self.nb, mask, self.check).fully_minimal():
                    ranked.append((largest + sep.bit_count(), sep.bit_count(), sep, sorted(parts, key=int.bit_count, reverse=True)))
            else:
                for sep in minimal_separators(self.nb, mask, stop=self.check):
                    if is_fully_minimal(self.nb, mask, sep):
                        parts, size = sorted(components(self.nb, mask & ~sep), key=int.bit_count, reverse=True), sep.bit_count()
                        ranked.append((parts[0].bit_count() + size, size, sep, parts))
            self.separators[mask] = [(size, parts, sep) for _, size, sep, parts in sorted(ranked)]
        return self.separators[mask]

    def thinned(self, mask: int) -> list[int]:
        """Components of a set without its vertices of least degree, taken off again and again; without one of these where nothing else would stay."""
        degree = {v: (self.nb[v] & mask).bit_count() for v in bits(mask)}
        v = min(degree, key=degree.__getitem__)
        return components(self.nb, core(self.nb, mask, degree[v] + 1) or mask & ~(1 << v))

    def within(self, mask: int, k: int) -> bool:
        """Whether the treedepth of a connected set is at most k; no part of it may be deeper, so a denser or smaller one is asked first."""
        got = self.bounds(mask)
        if got[1] <= k:
            return True
        if got[0] > k:
            return False
        self.check()
        if self.known.deep(mask, k + 1):
            got[0] = max(got[0], k + 1)
            self._note(mask)
            return False
        # of the parts the depth itself is found, since it narrows the choice below
        fits = all(any(self.within(c, j) for j in range(self.bounds(c)[0], k + 1)) for c in sorted(self.thinned(mask), key=lambda c: -self.bounds(c)[0]))
        # what a separator takes from a part lowers it by no more than one each, so few of its vertices lie outside a deep part
        tight = [(~t, k - low) for t, low in self.known.tightest(mask, max(k - NEAR + 1, 1), TIGHT)]
        for size, parts, sep in self.cuts(mask) if fits else ():
            if size >= k or any((sep & rest).bit_count() > room for rest, room in tight) or any(self.bounds(c)[0] + size > k for c in parts):
                continue
            if all(self.within(c, k - size) for c in sorted(parts, key=lambda c: -self.bounds(c)[0])):
                top = size + max(self.bounds(c)[1] for c in parts)
                if top < got[1]:
                    got[1], got[2] = top, sep
                    self._note(mask)
                return True
        got[0] = max(got[0], k + 1)
        self._note(mask)
        return False

    def improve(self, mask: int, parent: dict[int, int]) -> None:
        """Take over a tree of a connected set wherever it is lower than what is known."""
        below: dict[int, list[int]] = {}
        for v, up in parent.items():
            below.setdefault(up, []).append(v)
        order = list(below.get(-1, ()))
        for v in order:
            order += below.get(v, ())
        sets: dict[int, int] = {}
        height: dict[int, int] = {}
        for v in reversed(order):
            kids = below.get(v, ())
            sets[v], height[v] = 1 << v, 1 + max((height[w] for w in kids), default=0)
            for w in kids:
                sets[v] |= sets[w]
            got = self.bounds(sets[v])
            if height[v] < got[1]:
                got[1], got[2] = height[v], 1 << v
                self._note(sets[v])

    def _orders(self, mask: int, many: int, seed: int) -> None:
        """Upper bounds by elimination orders of several weights."""
        rng, got = random.Random(seed), self.bounds(mask)
        for k in range(many):
            if not self.open(mask):
                return
            self.check()
            depth, parent = elimination_parents(self.nb, mask, (0.1, 0.3, 0.6, 1.0, 2.0)[k % 5], rng)
            if depth < got[1]:
                self.improve(mask, parent)

    def _try(self, seconds: float, step) -> None:
        """Run step, which narrows bounds as it goes, for so long at most; OutOfTime only if the time of the whole is up."""
        whole, began = self.until, time.monotonic()
        self.until = began + seconds if whole is None else min(whole, began + seconds)
        try:
            step()
        except OutOfTime:
            pass
        finally:
            self.until = whole
        self.check()

    def _growing(self, mask: int) -> Generator[None, None, None]:
        """Raise the lower bound by growing sets until a tree is found; a limit that separators have passed meanwhile is given up."""
        got = self.bounds(mask)
        while self.open(mask):
            limit = got[0]
            steps = growing(self.nb, mask, limit)
            while got[0] == limit and self.open(mask):
                try:
                    next(steps)
                except StopIteration as end:
                    if end.value is None:
                        got[0] = max(got[0], limit + 1)
                        self._note(mask)
                    else:
                        self.improve(mask, end.value)
                    break
                yield

    def _grow(self, mask: int, seconds: float | None = None) -> None:
        """Go on with the growing of a set for so long at most, where the last call left it; sets that took too many steps are left alone."""
        if mask not in self.growth:
            self.growth[mask] = [self._growing(mask), GROW_STEPS]
        this = self.growth[mask]
        until = None if seconds is None else time.monotonic() + seconds
        while this[1] > 0:
            for _ in range(256):
                if next(this[0], self) is self:
                    del self.growth[mask]
                    return
            this[1] -= 256
            if until is not None and time.monotonic() > until:
                break
            self.check()
        if this[1] <= 0:
            this[0].close()  # its sets are let go

    def _cut(self, mask: int) -> None:
        """Raise the lower bound by branching on separators until a tree is found."""
        got = self.bounds(mask)
        while self.open(mask):
            self.within(mask, got[0])

    def dense_parts(self, mask: int) -> list[int]:
        """Components of the cores of a set, densest first, each a fifth larger than the one before, all smaller than the set."""
        cores, k, inner = [], 1, mask
        while inner := core(self.nb, inner, k):
            cores.append(max(components(self.nb, inner), key=int.bit_count))
            k += 1
        out: list[int] = []
        for part in cores[::-1]:
            if part != mask and (not out or 5 * part.bit_count() >= 6 * out[-1].bit_count()):
                out.append(part)
        return out

    def _extend(self, part: int, mask: int) -> None:
        """An upper bound of a set by the tree of a part of it, with all others below."""
        parent = self.tree(part)
        depth: dict[int, int] = {}
        for v in parent:  # parents are met before their children
            depth[v] = 1 + depth.get(parent[v], 0)
        rng = random.Random(2)
        for weight in (0.3, 1.0):
            deep, whole = elimination_parents(self.nb, mask, weight, rng, {v: len(parent) + 1 - d for v, d in depth.items()})
            if deep < self.bounds(mask)[1]:
                self.improve(mask, whole)

    def solve(self, mask: int) -> tuple[int, int]:
        """(lower, upper) of a connected set; equal unless time ran out or the window was decided first.

        Every part of a set bounds it from below, and dense parts are small, so these are solved first.
        In rounds of rising time the whole is tried by separators, then the least open part and the whole by
        growing. After EVEN_TURNS rounds growing takes most of the time in sparse graphs, where few sets can
        be grown, and separators elsewhere.
        """
        got = self.bounds(mask)
        edges = sum((self.nb[v] & mask).bit_count() for v in bits(mask)) // 2
        later = GROW_SHARE if edges <= SPARSE * mask.bit_count() else 1 - GROW_SHARE
        try:
            parts = []
            if self.open(mask):
                self._orders(mask, ORDERS, 1)
            if self.open(mask):
                parts = self.dense_parts(mask)
            seconds, turn, low = FIRST_SECONDS, 1, 1
            while self.open(mask):
                share = 0.5 if turn <= EVEN_TURNS else later
                self._try(2 * seconds * (1 - share), lambda: self._cut(mask))  # noqa: B023
                for part in parts[:]:
                    now = self.bounds(part)
                    now[0] = max(now[0], low)
                    self._orders(part, ORDERS // 4, turn)
                    if self.open(part) and self.open(mask):
                        self._grow(part, 2 * seconds * share)
                    low = max(low, now[0])
                    got[0] = max(got[0], low)
                    if self.open(part):
                        break
                    parts = parts[1:]
                    if self.open(mask):
                        self._extend(part, mask)
                if self.open(mask):
                    self._grow(mask, seconds * share / 2 if parts else 2 * seconds * share)
                seconds, turn = seconds * RISE, turn + 1
                self._orders(mask, ORDERS, turn)
        except OutOfTime:
            pass
        return got[0], got[1]

    def tree(self, mask: int, above: int = -1) -> dict[int, int]:
        """Parents of an elimination tree of depth at most the upper bound."""
        parent: dict[int, int] = {}
        todo = [(mask, above)]
        while todo:
            part, up = todo.pop()
            for v in bits(self.bounds(part)[2]):
                parent[v], up = up, v
            todo += [(c, up) for c in components(self.nb, part & ~self.bounds(part)[2])]
        return parent


def brute_force(nb: list[int], mask: int, memo: dict[int, int] | None = None) -> int:
    """Treedepth by definition, for small sets."""
    memo = {} if memo is None else memo
    if not mask:
        return 0
    if mask not in memo:
        parts = components(nb, mask)
        if len(parts) > 1:
            memo[mask] = max(brute_force(nb, c, memo) for c in parts)
        else:
            memo[mask] = 1 + min(brute_force(nb, mask & ~(1 << v), memo) for v in bits(mask))
    return memo[mask]


def refined(nb: list[int], n: int) -> list[int]:
    """Colours of vertices that equal colours of neighbours split no further."""
    colour = [0] * n
    while True:
        keys = [(colour[v], tuple(sorted(colour[w] for w in bits(nb[v])))) for v in range(n)]
        names = {k: i for i, k in enumerate(sorted(set(keys)))}
        if len(names) == len(set(colour)):
            return colour
        colour = [names[k] for k in keys]


def automorphisms(nb: list[int], n: int, first: list[int] | None = None, colour: list[int] | None = None) -> Iterator[list[int]]:
    """Every permutation that maps edges to edges and begins with the images in first, by backtracking over vertices of like neighbourhood."""
    first, colour = first or [], colour or refined(nb, n)
    image = [-1] * n
    used = 0

    def extend(v: int) -> Iterator[list[int]]:
        nonlocal used
        if v == n:
            yield image[:]
            return
        for w in first[v : v + 1] or range(n):
            if used >> w & 1 or colour[w] != colour[v] or any((nb[v] >> u & 1) != (nb[w] >> image[u] & 1) for u in range(v)):
                continue
            image[v] = w
            used |= 1 << w
            yield from extend(v + 1)
            used &= ~(1 << w)
        image[v] = -1

    return extend(0)


def generators(nb: list[int], n: int) -> tuple[list[list[int]], int]:
    """Automorphisms that generate all others, and how many there are in all, without listing these.

    Those that fix the vertices before v are generated from the last v on: for each image of v that
    those found so far do not lead to, one more is looked for. The group's size is the product of the
    numbers of images.
    """
    colour, found, size = refined(nb, n), [], 1

    def led_to(v: int) -> set[int]:
        out, todo = {v}, [v]
        while todo:
            at = todo.pop()
            more = {p[at] for p in found} - out
            out |= more
            todo += more
        return out

    for v in reversed(range(n)):
        images, none = {v}, set()
        for w in range(v + 1, n):
            if colour[w] == colour[v] and w not in images and w not in none:
                more = next(automorphisms(nb, n, [*range(v), w], colour), None)
                if more is None:
                    none |= led_to(w)
                else:
                    found.append(more)
                    images = led_to(v)
        size *= len(images)
    return found, size


#: Orders that the search for a canonical one tries at most.
LEAVES = 64


def _refine(near: list[list[int]], colour: list[int]) -> list[int]:
    """Colours split by those of the neighbours until nothing splits; colours are numbered in an order that depends on the structure alone."""
    while True:
        keys = [(colour[v], sorted(map(colour.__getitem__, near[v]))) for v in range(len(near))]
        names, last, order = [0] * len(near), None, -1
        for v in sorted(range(len(near)), key=keys.__getitem__):
            if keys[v] != last:
                last, order = keys[v], order + 1
            names[v] = order
        if order + 1 == len(set(colour)):
            return names
        colour = names


def canonical(nb: list[int], mask: int, leaves: int = LEAVES) -> tuple[bytes, list[int]]:
    """(form, order): the graph on a set written down in an order of its vertices; equal graphs get equal forms wherever the search ends.

    Twins are drawn together, as they can change places; what is left is refined by colours, and where
    vertices of one colour stay, each of the first such cell is set apart in turn and the least outcome
    taken. A search of more than so many outcomes is cut off: its form is still the graph's, but an
    equal graph may have another.
    """
    vs = list(bits(mask))
    kinds: dict[tuple[int, int], list[int]] = {}
    for v in vs:
        own = nb[v] & mask
        kinds.setdefault((0, own), []).append(v)
        kinds.setdefault((1, own | 1 << v), []).append(v)
    classes, label, met = [], [], 0
    for (kind, _), members in sorted(kinds.items(), key=lambda x: (-len(x[1]), x[0][0])):
        if not met >> members[0] & 1 and (len(members) > 1 or kind == 0):
            met |= sum(1 << v for v in members)
            classes.append(members)
            label.append((len(members), kind if len(members) > 1 else 0))
    at = {members[0]: k for k, members in enumerate(classes)}
    near = [[at[w] for w in bits(nb[c[0]] & mask) if w in at and w != c[0]] for c in classes]
    names = {x: k for k, x in enumerate(sorted(set(label)))}
    best: tuple[list, list[int]] | None = None
    tried = 0

    def search(colour: list[int]) -> None:
        nonlocal best, tried
        cells: dict[int, list[int]] = {}
        for v, c in enumerate(colour):
            cells.setdefault(c, []).append(v)
        open_ = [c for c in sorted(cells) if len(cells[c]) > 1]
        if not open_:
            tried += 1
            order = [cells[c][0] for c in sorted(cells)]
            place = {v: k for k, v in enumerate(order)}
            key = [sorted(place[w] for w in near[v]) for v in order]
            if best is None or key < best[0]:
                best = (key, order)
            return
        for v in cells[open_[0]]:
            if tried >= leaves:
                return
            split = [2 * c + 1 for c in colour]
            split[v] -= 1
            search(_refine(near, split))

    search(_refine(near, [names[x] for x in label]))
    order = [v for k in best[1] for v in classes[k]]
    rows = [sum((nb[v] >> w & 1) << j for j, w in enumerate(order[:i])) << i * (i - 1) // 2 for i, v in enumerate(order)]
    n = len(order)
    return n.to_bytes(4, "little") + sum(rows).to_bytes((n * (n - 1) // 2 + 7) // 8, "little"), order


def of_form(form: bytes) -> list[int]:
    """The graph that a form writes down."""
    n, cells = int.from_bytes(form[:4], "little"), int.from_bytes(form[4:], "little")
    return build(n, ((i, j) for i in range(n) for j in bits(cells >> i * (i - 1) // 2 & (1 << i) - 1)))
