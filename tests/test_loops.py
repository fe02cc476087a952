"""Strong components against those of all pairs that reach each other."""

import random

import pytest

from plumbline.operators.loops import loop_links, strong_components


def reached(nodes, edges):
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    while True:
        more = {n: s | {x for m in s for x in out[m]} for n, s in out.items()}
        if more == out:
            return out
        out = more


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows, wanted = [], set()
    for project in range(6):
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(12 + 6 * project)] * 2
        rows += [(project, *e) for e in edges]
        far = reached(range(30), edges)
        for n in range(30):
            group = [m for m in far[n] if n in far[m]]
            if group:
                wanted.add((project, n, min(group), len(group)))
    links = spark.createDataFrame(rows + [(None, 1, 1), (0, None, 2), (0, 2, None)], "project_id long, pred int, succ int")
    found = strong_components(links)
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    part = {(p, n): c for p, n, c, _ in wanted}
    inside = [(p, a, b, part[p, a]) for p, a, b in rows if part.get((p, a), -1) == part.get((p, b), -2)]
    kept = loop_links(links, found).select("project_id", "pred", "succ", "component")
    assert sorted(tuple(r) for r in kept.collect()) == sorted(inside)


def test_empty_and_without_loops(spark):
    chain = spark.createDataFrame([(1, str(i), str(i + 1)) for i in range(5)], "project_id long, pred string, succ string")
    assert strong_components(chain).count() == strong_components(chain.limit(0)).count() == 0
