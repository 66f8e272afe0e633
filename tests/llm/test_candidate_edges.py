"""What the tables of a large family send on."""

import numpy as np
from test_operators import family_of

from orefield.llm import neardups


def roots(edges, n):
    label = list(range(n))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_a_forest_connects_what_the_edges_connect():
    rng = np.random.default_rng(14)
    for n, m in ((1, 0), (10, 4), (300, 200), (300, 2000)):
        edges = rng.integers(0, n, (m, 2))
        got = neardups.forest(edges)
        assert roots(got, n) == roots(edges, n)
        assert len(got) == sum(k != r for k, r in enumerate(roots(edges, n)))
    chain = np.column_stack([np.arange(999, 0, -1), np.arange(998, -1, -1)])
    assert neardups.forest(chain).tolist() == [[0, k] for k in range(1, 1000)]


def test_candidate_edges_follow_the_members_of_a_family(spark, monkeypatch):
    """At most one edge a set and task, and most tasks name the same least set."""
    monkeypatch.setattr(neardups, "ENTRIES_PER_TASK", 1 << 16)
    layout = neardups.Layout(80)
    sets = {s.tobytes(): s for _, t in family_of(2000) for s in [neardups.shingles(t, 5)]}
    sigs = neardups.signatures(list(sets.values()), layout)
    reps = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sigs)], "sid long, sig binary")
    assert len(sets) * layout.side**2 > 2 * neardups.ENTRIES_PER_TASK
    assert neardups.candidates(reps, layout).count() < 1.6 * len(sets)
