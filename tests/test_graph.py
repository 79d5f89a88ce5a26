"""Components, cycles and constrained paths against brute force."""

import random
from itertools import permutations

import pytest

from tagweave.operators import graph

EDGES = "src long, dst long, kind string"


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], EDGES)


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    out = {x: {b for a, b in pairs if a == x} for x in nodes}
    reach = {}
    for x in nodes:
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reach[x] = seen
    return reach


def brute_components(pairs, least=2):
    reach = closure(pairs)
    sets = {frozenset({x} | {y for y in reach[x] if x in reach[y]}) for x in reach}
    return sorted((x, min(s)) for s in sets if len(s) >= least for x in s)


def components(spark, pairs, least=2):
    return sorted(tuple(r) for r in graph.strong_components(frame(spark, pairs), least).collect())


@pytest.mark.parametrize("seed,nodes,links", [(1, 14, 18), (2, 30, 40)])
def test_strong_components(spark, seed, nodes, links):
    rng = random.Random(seed)
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)}
    assert components(spark, pairs) == brute_components(pairs)



def test_strong_components_of_long_graphs(spark):
    """A chain of 2,000 nodes, one that closes on itself, and loops along a chain."""
    chain = [(k, k + 1) for k in range(2000)]
    assert components(spark, chain) == []
    ring = [(k, (k + 1) % 500) for k in range(500)]
    loops = [(1000 + k, 1001 + k) for k in range(40)] + [(1000 + k, 999 + k) for k in range(3, 40, 4)]
    tail = [(499, 5000), (5000, 5001), (1000, 3), (6000, 6001), (6001, 6000)]
    assert components(spark, ring + loops + tail) == brute_components(ring + loops + tail)


def brute_cycles(pairs, depth):
    found, out = [], {}
    for a, b in set(pairs):
        out.setdefault(a, []).append(b)

    def grow(path):
        for b in out.get(path[-1], ()):
            if b == path[0]:
                found.append(tuple(path))
            elif b > path[0] and b not in path and len(path) < depth:
                grow([*path, b])

    for a in out:
        grow([a])
    return sorted(found)


@pytest.mark.parametrize("seed,nodes,links,depth", [(1, 9, 22, 5), (3, 7, 20, 10)])
def test_cycles(spark, seed, nodes, links, depth):
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)] + [(100, 101), (101, 102)]
    got = graph.cycles(frame(spark, pairs), depth).collect()
    assert sorted(tuple(r.cycle) for r in got) == brute_cycles(pairs, depth)
    assert all(r.length == len(r.cycle) for r in got)


def brute_path(pairs, start, end, through, avoid, depth):
    nodes = sorted({str(x) for p in pairs for x in p} - {start, end} - set(avoid))
    links = {(str(a), str(b)) for a, b in pairs}
    for n in range(min(depth, len(nodes) + 1)):
        best = None
        for mid in permutations(nodes, n):
            path = (start, *mid, end)
            if set(through) <= set(path) and all(x in links for x in zip(path, path[1:], strict=False)) and (best is None or path < best):
                best = path
        if best:
            return list(best)
    return None


def test_constrained_path(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(5):
        pairs = [(rng.randrange(8), rng.randrange(8)) for _ in range(17)]
        cases.append((pairs, rng.sample(["2", "3", "4", "5"], rng.choice([0, 1, 2, 3])), ["6"] if rng.random() < 0.4 else [], 7))
    # The shortest walk over 2 comes by 1 twice; a longer way doesn't.
    cases.append(([(0, 1), (1, 2), (2, 1), (1, 7), (2, 3), (3, 4), (4, 7)], ["2"], [], 7))
    cases.append(([(0, 1), (1, 2), (2, 1), (1, 7)], ["2"], [], 7))
    for pairs, through, avoid, depth in cases:
        got = [r.path for r in graph.constrained_path(frame(spark, pairs), "0", "7", through, avoid, depth).collect()]
        want = brute_path(pairs, "0", "7", through, avoid, depth)
        assert got == ([want] if want else []), (pairs, through, avoid)
