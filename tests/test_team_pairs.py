"""Actions between members of a team, met in the middle, against the search from every member."""

import random

import pytest

from lensgraph.operators import graph, temporal


@pytest.mark.parametrize("most", [1, 2, 3])
def test_paired_actions(spark, most):
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(25), rng.randrange(25), float(rng.randrange(1, 9))) for _ in range(70)], "src long, dst long, weight double")
    teams = [(k, rng.randrange(25)) for k in range(9) for _ in range(4)] + [(50, None), (None, 3)]
    together = {(a, b) for t, a in teams for u, b in teams if t == u and None not in (t, a, b) and a != b}
    frame = spark.createDataFrame(teams, "team long, id long")
    whole = graph.least_action(edges, frame.select("id").dropna(), most).collect()
    want = {(r.source, r.id): r.action for r in whole if (r.source, r.id) in together}
    got = temporal.paired_actions(edges, frame, most).collect()
    assert {(r.source, r.id): r.action for r in got} == want and len(got) == len(want)
