"""Random operations against a model in plain Python."""

import random

import pytest

from sparkquiver import errors
from sparkquiver.graph import Graph
from sparkquiver.schema import GraphOptions


@pytest.mark.parametrize("multigraph", [False, True])
def test_random_operations(spark, multigraph):
    rng = random.Random(42)
    g = Graph(spark, GraphOptions(multigraph=multigraph))
    g.add_nodes(6)
    edges, removed, counter = [], set(), {}
    for _ in range(14):
        op, a, b = rng.choice(["add", "add", "add", "remove", "repair", "kill"]), rng.randrange(6), rng.randrange(6)
        if op == "add":
            if a in removed or b in removed:
                with pytest.raises(errors.InvalidNode):
                    g.add_edge(a, b)
            elif not multigraph and any(e[:2] == (a, b) for e in edges):
                with pytest.raises(errors.EdgeAlreadyExists):
                    g.add_edge(a, b)
            else:
                g.add_edge(a, b, a, b)
                counter[a] = counter.get(a, 0) + 1
                edges.append((a, b, counter[a]))
        elif op == "remove" and not {a, b} & removed:
            assert g.remove_edge(a, b) == any(e[:2] == (a, b) for e in edges)
            edges = [e for e in edges if e[:2] != (a, b)]
        elif op == "repair" and a not in removed:
            g.repair_node(a)
        elif op == "kill" and a not in removed and len(removed) < 2:
            out = g.remove_node(a)
            assert out.removed_visible_edges == sum(a in e[:2] for e in edges)
            removed.add(a)
            edges = [e for e in edges if a not in e[:2]]
    got = [tuple(r) for r in g.visible.select("src", "dst", "edge_id" if multigraph else "relation").collect()]
    assert sorted(got) == sorted(e if multigraph else (e[0], e[1], e[0]) for e in edges)
    g.validate()
