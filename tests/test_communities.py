"""Modularity over levels, connected parts and the split of oversized communities, on small graphs."""

from itertools import combinations

from loomgraph.operators import communities as C


def cliques(spark, k, size=4):
    edges = [(c * size + i, c * size + j, 1.0) for c in range(k) for i, j in combinations(range(size), 2)]
    edges += [(c * size, (c + 1) * size, 0.5) for c in range(k - 1)]
    return spark.createDataFrame(edges, "a bigint, b bigint, w double")


def groups(comm):
    out = {}
    for r in comm.collect():
        out.setdefault(r.community, set()).add(r.id)
    assert all(k == min(v) for k, v in out.items())
    return sorted(map(sorted, out.values()))


def test_levels_do_not_lower_modularity(spark):
    g = cliques(spark, 6)
    one, more = C.modularity(g, levels=1, resolution=1.0), C.modularity(g, resolution=1.0)
    assert C.modularity_score(g, more).first().q >= C.modularity_score(g, one).first().q
    assert all(set(range(4 * c, 4 * c + 4)) <= set(x) for c in range(6) for x in groups(more) if 4 * c in x)
    assert C.modularity(g.limit(0)).count() == 0


def test_parts_and_splits(spark):
    g = cliques(spark, 3)
    both = g.unionByName(g.selectExpr("b AS a", "a AS b", "w"))
    apart = spark.createDataFrame([(i, 0 if i < 4 or i > 7 else 4) for i in range(12)], "id bigint, community bigint")
    assert groups(C.connected_parts(both, apart)) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    whole = spark.createDataFrame([(i, 0) for i in range(12)], "id bigint, community bigint")
    assert groups(C.split_oversized(g, whole, resolution=1.0)) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert groups(C.split_oversized(g, whole, least=12)) == [list(range(12))]
