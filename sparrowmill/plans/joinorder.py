"""Join ordering: enumerators of join trees over a query graph, with C_out as cost.

Relations are bits.  ``sizes`` estimates the result of a set of relations.  C_out of a tree is the sum of the sizes of its joins.
All enumerators but ``pe_all`` leave out cross products as long as the graph is connected; unconnected graphs are joined by
component, smallest first.
"""

from __future__ import annotations

import heapq
from functools import partial
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Tree = "int | tuple"


@dataclass
class Graph:
    n: int
    edges: set[tuple[int, int]]
    sizes: Callable[[int], float]
    #: Cost of one join from the sizes of its inputs and its result; C_out by default.
    join_cost: Callable[[float, float, float], float] = lambda left, right, out: out

    def __post_init__(self) -> None:
        self.near = [0] * self.n
        for a, b in self.edges:
            self.near[a] |= 1 << b
            self.near[b] |= 1 << a

    def cost(self, a: int, b: int) -> float:
        return self.join_cost(self.sizes(a), self.sizes(b), self.sizes(a | b))

    def neighbours(self, s: int) -> int:
        out = 0
        for i in bits(s):
            out |= self.near[i]
        return out & ~s

    def joined(self, a: int, b: int) -> bool:
        return bool(self.neighbours(a) & b)

    def connected(self, s: int) -> bool:
        if not s:
            return False
        seen = s & -s
        while grow := self.neighbours(seen) & s:
            seen |= grow
        return seen == s

    def components(self) -> list[int]:
        left, out = (1 << self.n) - 1, []
        while left:
            seen = left & -left
            while grow := self.neighbours(seen) & left:
                seen |= grow
            out.append(seen)
            left &= ~seen
        return out


def bits(s: int) -> Iterator[int]:
    while s:
        low = s & -s
        yield low.bit_length() - 1
        s ^= low


def subsets(s: int) -> Iterator[int]:
    """Non-empty proper subsets, ascending."""
    x = -s & s
    while x != s:
        yield x
        x = (x - s) & s


class Table:
    """Best plans by set of relations."""

    def __init__(self, g: Graph) -> None:
        self.g, self.best = g, {1 << i: (0.0, i) for i in range(g.n)}
        self.pairs = 0

    def offer(self, a: int, b: int) -> None:
        self.pairs += 1
        cost = self.best[a][0] + self.best[b][0] + self.g.cost(a, b)
        if a | b not in self.best or cost < self.best[a | b][0]:
            self.best[a | b] = (cost, (self.best[a][1], self.best[b][1]))

    def has(self, s: int) -> bool:
        return s in self.best


def pe_all(g: Graph, part: int) -> Table:
    """All splits of all subsets, cross products included."""
    t = Table(g)
    for s in _ascending(part):
        for a in subsets(s):
            if a < s ^ a:
                t.offer(a, s ^ a)
    return t


def _ascending(part: int) -> Iterator[int]:
    for s in [*subsets(part), part]:
        if s & (s - 1):
            yield s


def _by_size(g: Graph, part: int, symmetric: bool) -> Table:
    t, n = Table(g), part.bit_count()
    level: list[list[int]] = [[] for _ in range(n + 1)]
    level[1] = [1 << i for i in bits(part)]
    for size in range(2, n + 1):
        for k in range(1, size if symmetric else size // 2 + 1):
            for i, a in enumerate(level[k]):
                others = level[size - k]
                for b in others[i + 1 :] if not symmetric and k == size - k else others:
                    if not a & b and g.joined(a, b):
                        if not t.has(a | b):
                            level[size].append(a | b)
                        t.offer(a, b)
    return t


def dp_size(g, part):
    """Pairs of plans by the size of their union."""
    return _by_size(g, part, True)


def dp_size_opt(g, part):
    """The same without mirrored pairs."""
    return _by_size(g, part, False)


def dp_size_sub(g, part):
    """Sets by size; each is split into its subsets and their complements."""
    t = Table(g)
    for s in sorted(_ascending(part), key=int.bit_count):
        if g.connected(s):
            for a in subsets(s):
                if t.has(a) and t.has(s ^ a):
                    t.offer(a, s ^ a)
    return t


def _by_subset(g, part, symmetric):
    t = Table(g)
    for s in _ascending(part):
        if g.connected(s):
            for a in subsets(s):
                if (symmetric or a < s ^ a) and t.has(a) and t.has(s ^ a):
                    t.offer(a, s ^ a)
    return t


def dp_sub(g, part):
    """Sets in numeric order, which is an order by inclusion."""
    return _by_subset(g, part, True)


def dp_sub_opt(g, part):
    """The same without mirrored pairs."""
    return _by_subset(g, part, False)


def dp_ccp(g: Graph, part: int) -> Table:
    """Only connected subgraphs and their connected complements, each pair once."""
    t = Table(g)
    order = list(bits(part))

    def grow(s: int, banned: int) -> Iterator[int]:
        edge = g.neighbours(s) & part & ~banned
        for x in [*subsets(edge), edge] if edge else ():
            yield s | x
        for x in [*subsets(edge), edge] if edge else ():
            yield from grow(s | x, banned | edge)

    def upto(i: int) -> int:
        return (1 << (i + 1)) - 1

    found: list[tuple[int, int]] = []
    for i in reversed(order):
        for s in [1 << i, *grow(1 << i, upto(i))]:
            banned = upto((s & -s).bit_length() - 1) | s
            edge = g.neighbours(s) & part & ~banned
            for j in sorted(bits(edge), reverse=True):
                for c in [1 << j, *grow(1 << j, banned | (edge & upto(j)))]:
                    found.append((s, c))
    for a, b in sorted(found, key=lambda p: (p[0] | p[1]).bit_count()):
        t.offer(a, b)
    return t


def _top_down(g: Graph, part: int, splits) -> Table:
    t = Table(g)

    def solve(s: int) -> None:
        if t.has(s):
            return
        for a in splits(s):
            solve(a)
            solve(s ^ a)
            t.offer(a, s ^ a)

    solve(part)
    return t


def td_basic(g: Graph, part: int) -> Table:
    """Memoised recursion over all connected splits."""
    return _top_down(g, part, lambda s: [a for a in subsets(s) if a & (s & -s) and g.connected(a) and g.connected(s ^ a)])


def td_min_cut(g: Graph, part: int) -> Table:
    """Memoised recursion; splits grow from one relation, so only connected halves are visited."""

    def splits(s: int):
        seen, todo = set(), [s & -s]
        while todo:
            a = todo.pop()
            if a in seen or a == s:
                continue
            seen.add(a)
            if g.connected(s ^ a):
                yield a
            todo += [a | 1 << j for j in bits(g.neighbours(a) & s)]

    return _top_down(g, part, splits)


def goo(g: Graph, part: int) -> Table:
    """Greedily joins the pair with the smallest result."""
    t, live = Table(g), [1 << i for i in bits(part)]
    while len(live) > 1:
        a, b = min(((a, b) for k, a in enumerate(live) for b in live[k + 1 :] if g.joined(a, b)), key=lambda p: (g.sizes(p[0] | p[1]), p))
        t.offer(a, b)
        live = [x for x in live if x not in (a, b)] + [a | b]
    return t


def td_goo(g: Graph, part: int) -> Table:
    """Greedily cuts an edge of a spanning tree so that the halves' results are smallest; a cut for each edge is tried, not for each subset."""
    t = Table(g)

    def solve(s: int) -> None:
        if t.has(s):
            return
        size = lambda x: 0 if not x & (x - 1) else g.sizes(x)
        a = min(_halves(g, s), key=lambda a: (size(a) + size(s ^ a), a))
        solve(a)
        solve(s ^ a)
        t.offer(a, s ^ a)

    solve(part)
    return t


def _halves(g: Graph, s: int) -> Iterator[int]:
    """What remains connected to the first relation when an edge of the spanning tree is cut; both halves are connected."""
    tree = _spanning_tree(g, s)
    for cut in tree:
        seen, todo = s & -s, [next(bits(s))]
        while todo:
            i = todo.pop()
            for a, b in tree - {cut}:
                j = b if a == i else a if b == i else None
                if j is not None and not seen >> j & 1:
                    seen |= 1 << j
                    todo.append(j)
        yield seen


def _spanning_tree(g: Graph, part: int) -> set[tuple[int, int]]:
    """Edges by selectivity, as long as they close no cycle."""
    sel = lambda e: g.sizes(1 << e[0] | 1 << e[1]) / max(1.0, g.sizes(1 << e[0]) * g.sizes(1 << e[1]))
    up = {i: i for i in bits(part)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    out = set()
    for a, b in sorted((e for e in g.edges if part >> e[0] & 1 and part >> e[1] & 1), key=lambda e: (sel(e), e)):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.add((a, b))
    return out


def linearise(g: Graph, part: int) -> list[int]:
    """The best left-deep order by rank (IKKBZ) over all roots, on a spanning tree if the graph has cycles."""
    near: dict[int, list[int]] = {i: [] for i in bits(part)}
    for a, b in _spanning_tree(g, part):
        near[a].append(b)
        near[b].append(a)
    one = lambda i: max(1.0, g.sizes(1 << i))

    def chain(i: int, parent: int) -> list[tuple[float, float, list[int]]]:
        """(T, C, relations) modules of i's subtree, ascending by rank, i first."""
        below = list(heapq.merge(*(chain(j, i) for j in near[i] if j != parent), key=lambda m: (m[0] - 1) / m[1]))
        s = g.sizes(1 << i | 1 << parent) / (one(i) * one(parent)) if parent >= 0 else 1.0
        head = (s * one(i), s * one(i), [i]) if parent >= 0 else (one(i), 0.0, [i])
        if parent < 0:
            return [head, *below]
        while below and (head[0] - 1) / max(head[1], 1e-300) > (below[0][0] - 1) / max(below[0][1], 1e-300):
            x = below.pop(0)
            head = (head[0] * x[0], head[1] + head[0] * x[1], head[2] + x[2])
        return [head, *below]

    def cost(order: list[int]) -> float:
        s, c = 1 << order[0], 0.0
        for i in order[1:]:
            s |= 1 << i
            c += g.sizes(s)
        return c

    orders = [[i for m in chain(r, -1) for i in m[2]] for r in bits(part)]
    return min(orders, key=lambda o: (cost(o), o))


def ikkbz(g: Graph, part: int) -> Table:
    t = Table(g)
    order = linearise(g, part)
    s = 1 << order[0]
    for i in order[1:]:
        t.offer(s, 1 << i)
        s |= 1 << i
    return t


def linearized_dp(g: Graph, part: int) -> Table:
    """Dynamic programming over the intervals of the IKKBZ order."""
    t, order = Table(g), linearise(g, part)
    n = len(order)
    span = {(i, j): sum(1 << x for x in order[i : j + 1]) for i in range(n) for j in range(i, n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            j = i + length - 1
            for k in range(i, j):
                a, b = span[i, k], span[k + 1, j]
                if t.has(a) and t.has(b) and g.joined(a, b):
                    t.offer(a, b)
    return t


def _greedy_rest(g: Graph, st: tuple[int, ...]) -> float:
    """Cost of completing a state greedily."""
    live, total = list(st), 0.0
    while len(live) > 1:
        a, b = min(((a, b) for i, a in enumerate(live) for b in live[i + 1 :] if g.joined(a, b)), key=lambda p: (g.sizes(p[0] | p[1]), p))
        total += g.cost(a, b)
        live = [x for x in live if x not in (a, b)] + [a | b]
    return total


def _mean_selectivity(g: Graph, st: tuple[int, ...]) -> float:
    """The result of joining all at the mean selectivity of the joins that are possible now, halfway there."""
    sel = [g.sizes(a | b) / max(1.0, g.sizes(a) * g.sizes(b)) for i, a in enumerate(st) for b in st[i + 1 :] if g.joined(a, b)]
    k = (len(st) + 1) // 2
    sizes = sorted(g.sizes(x) for x in st)[:k]
    out = 1.0
    for x in sizes:
        out *= x
    return out * (sum(sel) / len(sel)) ** (k - 1)


#: What remains to be paid from a state of several relations, estimated.  With C_out, ``zero`` and ``sum`` never overestimate.
HEURISTICS: dict[str, Callable[[Graph, tuple[int, ...], int], float]] = {
    "zero": lambda g, st, part: 0.0,
    "sum": lambda g, st, part: g.sizes(part),
    "scaled_sum": lambda g, st, part: sum(g.sizes(x) for x in st) * (len(st) - 1) / len(st),
    "avg_sel": lambda g, st, part: _mean_selectivity(g, st),
    "product": lambda g, st, part: min(1e300, _product(g.sizes(x) for x in st) ** 0.5),
    "GOO": lambda g, st, part: _greedy_rest(g, st),
}


def _product(xs) -> float:
    out = 1.0
    for x in xs:
        out = min(1e300, out * x)
    return out


def heuristic_search(g: Graph, part: int, heuristic: str = "zero", weight: float = 1.0, beam: int | None = None, vertex: str = "BottomUp", lazy: bool = False, prune: bool = False, anytime: int | None = None) -> Table:
    """A* over states.  Bottom-up, a state is the relations joined so far; top-down, the sets still to be split.

    Optimal with an admissible heuristic, weight 1 and no beam.  Top-down knows the heuristics ``zero`` and ``sum`` only.  ``beam``: how
    many states wait at most.  ``lazy``: a state's heuristic is computed when it is first taken, not when it is found.  ``prune``: states
    that cost more than the greedy plan are left out, and that plan is the result if none better is found; joins must not cost less than
    zero.  ``anytime``: after the first plan the search goes on for cheaper ones, until so many states have been taken in all; it may end
    earlier, with every state that could lead to a cheaper plan taken."""
    if heuristic not in HEURISTICS or vertex not in ("BottomUp", "TopDown") or (vertex == "TopDown" and heuristic not in ("zero", "sum")):
        raise ValueError(f"no heuristic {heuristic!r} for {vertex!r}")
    down = vertex == "TopDown"
    singles = tuple(sorted(1 << i for i in bits(part)))
    start, goal = ((part,), singles) if down else (singles, (part,))
    if down:
        rest = lambda st: 0.0 if heuristic == "zero" else sum(g.sizes(x) for x in st if x & (x - 1) and x != part)
    else:
        rest = lambda st: 0.0 if len(st) == 1 else HEURISTICS[heuristic](g, st, part)

    def steps(st: tuple[int, ...]):
        """(next state, the two halves, cost)"""
        if down:
            x = max(st, key=int.bit_count)
            for a in subsets(x):
                if a & (x & -x) and g.connected(a) and g.connected(x ^ a):
                    yield tuple(sorted([y for y in st if y != x] + [a, x ^ a])), (a, x ^ a), g.cost(a, x ^ a)
        else:
            for i, a in enumerate(st):
                for b in st[i + 1 :]:
                    if g.joined(a, b):
                        yield tuple(sorted([x for x in st if x not in (a, b)] + [a | b])), (a, b), g.cost(a, b)

    greedy = goo(g, part) if prune else None
    limit = greedy.best[part][0] if prune else float("inf")
    known: dict[tuple[int, ...], float] = {}

    def guess(st: tuple[int, ...]) -> float:
        if st not in known:
            known[st] = weight * rest(st)
        return known[st]

    cost, came, k, taken, found = {start: 0.0}, {}, 0, 0, False
    queue = [(0.0 if lazy else guess(start), 0, 0.0, start)]
    while queue:
        if beam is not None and len(queue) > beam:
            queue = heapq.nsmallest(beam, queue)
        key, _, paid, st = heapq.heappop(queue)
        if paid > cost[st] or (found and paid >= cost[goal]):  # there is a cheaper way
            continue
        if lazy and paid + guess(st) > key:
            k += 1
            heapq.heappush(queue, (paid + guess(st), k, paid, st))
            continue
        taken += 1
        if st == goal:
            found = True
            if anytime is None:
                break
        if found and anytime is not None and taken >= anytime:
            break
        for nxt, pair, c in steps(st):
            c += paid
            if c <= limit and c < cost.get(nxt, float("inf")):
                cost[nxt], came[nxt] = c, (st, pair)
                k += 1
                heapq.heappush(queue, (key if lazy and nxt not in known else c + guess(nxt), k, c, nxt))
    if not found:
        if greedy is None:
            raise ValueError("the graph is not connected")
        return greedy
    t, pairs, st = Table(g), [], goal
    while st in came:
        st, pair = came[st]
        pairs.append(pair)
    for a, b in pairs if down else reversed(pairs):
        t.offer(a, b)
    return t


#: Enumerators by name.
ENUMERATORS = {
    "PEall": pe_all, "DPsize": dp_size, "DPsizeOpt": dp_size_opt, "DPsizeSub": dp_size_sub, "DPsub": dp_sub, "DPsubOpt": dp_sub_opt, "DPccp": dp_ccp,
    "IKKBZ": ikkbz, "LinearizedDP": linearized_dp, "TDbasic": td_basic, "TDMinCutAGaT": td_min_cut, "GOO": goo, "TDGOO": td_goo, "HeuristicSearch": heuristic_search,
}


def order(g: Graph, enumerator: str = "DPccp", search: dict | None = None) -> tuple[float, object]:
    """(cost, tree) of the whole graph; components are joined by cross products, smallest first.  ``search``: options of HeuristicSearch."""
    if enumerator not in ENUMERATORS:
        raise ValueError(f"no plan enumerator {enumerator!r}")
    run = ENUMERATORS[enumerator]
    if search:
        if enumerator != "HeuristicSearch":
            raise ValueError(f"{enumerator} has no search options")
        run = partial(run, **search)
    everything = (1 << g.n) - 1
    if enumerator == "PEall":
        return run(g, everything).best[everything]
    parts = sorted(((g.sizes(p), p, run(g, p).best[p]) for p in g.components()), key=lambda x: x[:2])
    _, s, (cost, tree) = parts[0]
    for _, p, (c, other) in parts[1:]:
        s |= p
        cost, tree = cost + c + g.sizes(s), (tree, other)
    return cost, tree
