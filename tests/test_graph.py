"""Graph operators on small graphs worked out by hand, and against brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.operators import fusion, graph, inference, lifecycle, search, traverse
from palimpsest.operators.components import connected_components

EDGES = [("a", "b", 0.8), ("b", "c", 0.9), ("d", "e", 1.0), ("e", "f", 1.0), ("f", "d", 1.0), ("g", "h", 0.5)]


def edges(spark, rows=None):
    return spark.createDataFrame(EDGES if rows is None else rows, "src string, dst string, weight double")


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_components(spark):
    got = {r.node: r.component for r in connected_components(edges(spark)).collect()}
    assert got == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d"), **dict.fromkeys("gh", "g")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_equal_union_find(spark, links):
    root = {n: n for pair in links for n in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "src int, dst int")
    assert {r.node: r.component for r in connected_components(df).collect()} == {n: find(n) for n in root}


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "src int, dst int")
    assert {r.component for r in connected_components(df).collect()} == {0}


def test_hits_shortest_path_betweenness(spark):
    e = edges(spark)
    assert {(r.node, r.authority, r.hub) for r in graph.hits_one_step(e).collect()} == {(n, 1, 1) for n in "bdef"}
    best = {r.node: (round(r.cost, 6), r.path) for r in traverse.shortest_paths(e, start(spark, "a")).collect()}
    assert best["c"] == (1.7, ["a", "b", "c"])
    got = {r.node: r.betweenness for r in graph.betweenness(e, graph.nodes(e)).collect() if r.betweenness}
    assert got == {"b": 1.0, "d": 1.0, "e": 1.0, "f": 1.0}


def test_pagerank_sums_to_one_and_empty_graph(spark):
    assert abs(sum(r.pagerank for r in graph.pagerank(edges(spark)).collect()) - 1) < 1e-9
    assert graph.pagerank(edges(spark, [])).count() == 0
    assert graph.label_propagation(edges(spark, [])).count() == 0


def test_cycle_and_hops(spark):
    e = edges(spark, [("project", "budget", 1.0), ("budget", "team", 1.0), ("team", "project", 1.0), ("team", "x", None)])
    assert [r.path for r in traverse.cycles_through(e, "project").collect()] == [["project", "budget", "team"]]
    assert {r.node: r.hops for r in traverse.hops(e, start(spark, "project"), 3).collect()} == {"project": 0, "budget": 1, "team": 2, "x": 3}


def test_fusion_does_not_depend_on_order(spark):
    rows = [("v", "a", 0.9), ("v", "b", 0.9), ("s", "b", 0.5), ("s", "c", 0.4)]
    one, two = (spark.createDataFrame(x, "path string, id string, score double") for x in (rows, rows[::-1]))
    w = {"v": 0.6, "s": 0.4}
    for f in fusion.FUSIONS.values():
        assert sorted(f(one, w).collect()) == sorted(f(two, w).collect())


def test_activation_fixture(spark):
    rows = [(str(i), f"2024-01-{31 - days:02d} 00:00:00", f'{{"access_count": {n}}}') for i, (n, days) in enumerate([(5, 1), (2, 3), (1, 7), (0, 30), (10, 0)])]
    df = spark.createDataFrame(rows, "id string, t string, metadata string").selectExpr("id", "to_timestamp(t) AS valid_from", "metadata")
    got = [r.activation for r in lifecycle.activation(df, "2024-01-31 00:00:00").orderBy("id").collect()]
    assert got == [0.846482, 0.367879, 0.030197, 0.0, 1.0]


def test_vectors_and_nulls(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", [3.0, 4.0])], "id string, embedding array<double>")
    assert {r.id: r.score for r in search.vector_scores(df, [1.0, 0.0]).collect()} == {"a": 1.0, "e": 0.6}
    assert search.positive(0) == 10


def test_status_conflict_and_custom_rule(spark):
    o = spark.createDataFrame([("1", "e", "2024-01-01", "It is active."), ("2", "e", "2024-05-01", "It was cancelled."), ("3", None, "2024-05-01", "active"), ("4", "f", "2024-05-01", None)], "id string, entity_id string, t string, text string").selectExpr("id", "entity_id", "to_timestamp(t) AS valid_from", "text")
    assert [(r.entity_id, r.active_id, r.inactive_id) for r in inference.status_conflicts(o).collect()] == [("e", "1", "2")]
    both = o.filter("id = '2'").selectExpr("id", "entity_id", "valid_from", "'It was discontinued.' AS text")
    assert [(r.active_id, r.inactive_id) for r in inference.status_conflicts(both).collect()] == [("2", "2")]
    try:
        inference.custom_rule(spark, {"o": o}, "SELECT id FROM o")
    except ValueError as error:
        assert "lacks" in str(error)
    else:
        raise AssertionError("a rule without the columns of a relation must be refused")


def test_percentiles_equal_sorted_elements(spark):
    values = [5, 1, 1, 9, 7, 3, 3, 3, 8, None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r.share: r.value for r in lifecycle.percentiles(df, "v", [0.0, 0.5, 0.99]).collect()}
    real = sorted(v for v in values if v is not None)
    assert got == {s: real[int(len(real) * s)] for s in (0.0, 0.5, 0.99)}
