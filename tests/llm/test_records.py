"""Similar vectors against brute force, names on a fixture, and that the queries read whole tables."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import names, similar_vectors


def search(spark, rows, size, **more):
    """Run a search over (field, id, vector) rows, given as a frame."""
    given = rows.select("field", "id", F.col("vector").cast("array<float>").alias("vector"))
    small = similar_vectors.quantised(given, size, ["field", "id"]).filter("vec IS NOT NULL")
    return similar_vectors.Neighbours(small, size, lambda ids: given.join(ids, ["field", "id"], "left_semi"), **more)


def frame(spark, x):
    return spark.createDataFrame([(0, f"v{i:05d}", None if v is None else [float(y) for y in v]) for i, v in enumerate(x)], "field int, id string, vector array<float>")


def test_similar_vectors_recall_with_windows_of_three_percent(spark, monkeypatch):
    monkeypatch.setattr(similar_vectors, "PART", 8000)  # many ranges, so that windows cross their borders
    r = np.random.default_rng(2)
    n, size = 100_000, 32
    centers = r.standard_normal((8000, size))
    x = (centers[r.integers(0, 8000, n)] + 0.35 * r.standard_normal((n, size))).astype(np.float32)
    pdf = pd.DataFrame({"field": np.zeros(n, np.int32), "id": [f"v{i:06d}" for i in range(n)], "vector": list(x)})
    rows = spark.createDataFrame(pdf).withColumn("field", F.col("field").cast("int"))
    asked = r.choice(n, 1000, replace=False)
    found = search(spark, rows, size, least=0.8).rows()
    got: dict[str, set[str]] = {}
    for row in found.select("id", "neighbour_id").toPandas().itertuples():
        got.setdefault(row.id, set()).add(row.neighbour_id)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u[asked] @ u.T, 6)
    s[np.arange(1000), asked] = -1
    best = np.argsort(-s, axis=1, kind="stable")[:, :10]
    want = [(i, j) for i in range(1000) for j in best[i] if s[i, j] >= 0.8]
    hits = sum(f"v{j:06d}" in got.get(f"v{asked[i]:06d}", set()) for i, j in want)
    assert len(want) > 5000
    assert hits / len(want) >= 0.9


def test_similar_vectors_odd_rows_and_ties(spark):
    x = [[1.0] * 32, [2.0] * 32, [0.0] * 32, None, [1.0] * 16, [float("nan")] * 32, [1.0] + [0.0] * 31]
    pairs = {(p.id_a, p.id_b) for p in search(spark, frame(spark, x), 32, least=0.8).pairs().collect()}
    assert pairs == {("v00000", "v00001")}
    assert search(spark, frame(spark, x[2:5]), 32, least=0.8).pairs().count() == 0
    # of thirty equal vectors and one beside them the smallest ids are the nearest
    same = [[1.0, 2.0] * 16] * 30 + [[1.0, 2.0] * 15 + [1.0, 2.1]]
    rows = search(spark, frame(spark, same), 32, k=3, least=0.8, rerank_all=True).rows().collect()
    near = {}
    for row in sorted(rows, key=lambda q: (q.id, q.rank)):
        near.setdefault(row.id, []).append((row.rank, row.neighbour_id))
    first = [f"v{i:05d}" for i in range(4)]
    for i in range(31):
        own = f"v{i:05d}"
        assert near[own] == list(enumerate([f for f in first if f != own][:3], 1))


def test_very_many_equal_vectors_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(similar_vectors, "MEMBERS", 50)
    rows = search(spark, frame(spark, [[1.0, 2.0] * 16] * 400), 32, k=2, least=0.8).rows()
    got = {(q.id, q.rank): q.neighbour_id for q in rows.collect()}
    assert len(got) == 800
    assert (got["v00000", 1], got["v00000", 2], got["v00001", 1], got["v00399", 2]) == ("v00001", "v00002", "v00000", "v00001")


def test_orders_bring_near_vectors_together_among_many():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20_000, 96)).astype(np.float32)
    x = np.concatenate([x, x + 0.6 * rng.standard_normal(x.shape).astype(np.float32)])  # cosines of about 0.86
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    met = np.zeros(20_000, bool)
    for turn in range(4):
        at = np.argsort(np.argsort(similar_vectors.place(x, turn), kind="stable"), kind="stable")
        met |= np.abs(at[:20_000] - at[20_000:]) <= 100
    assert met.mean() > 0.72


def test_rotations_are_drawn_once_and_rows_come_back(monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((50, 32)) * 9000).astype(np.int16)
    unit = x / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    uid, field = np.arange(50) * 2, np.zeros(50, np.int32)
    batch = similar_vectors.placed(field, uid, unit.astype(np.float32), [r.tobytes() for r in x], 0)
    batch = similar_vectors.pa.RecordBatch.from_arrays([*batch.columns, similar_vectors.pa.array(uid % 10 == 0)], [*batch.schema.names, "guest"])
    block = similar_vectors.Block(batch, 32, 4)
    block.meet(block, 0.31)
    block.settle()
    drawn = []
    qr = np.linalg.qr
    monkeypatch.setattr(np.linalg, "qr", lambda m: drawn.append(1) or qr(m))
    rows, again = block.rows(77), block.rows(77)
    assert len(drawn) <= 3 and rows.equals(again)
    for i, state in zip(np.flatnonzero(uid % 10 > 0), rows.column("state").to_pylist(), strict=True):
        have = (block.sim[i] > -2).sum()
        assert state == x[i].tobytes() + block.near[i, :have].tobytes() + block.sim[i, :have].tobytes()


class Counted(np.ndarray):
    """An array that counts the numbers in the products made of it."""

    made = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **more):
        out = getattr(ufunc, method)(*[np.asarray(x) for x in inputs], **more)
        if ufunc is np.matmul:
            Counted.made += out.size
        return out


@pytest.mark.parametrize(("size", "centers"), [(32, 20), (33, 20), (32, 3)])  # few near ones, an odd size, many near ones
def test_blocks_meet_with_half_the_products(size, centers):
    rng = np.random.default_rng(5)
    n, k, least = 2048, 4, 0.8
    x = rng.standard_normal((centers, size))[rng.integers(0, centers, n)] + 0.3 * rng.standard_normal((n, size))
    x = (x * 5000).astype(np.int16)
    unit = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    uid, field, guest = rng.permutation(n) * 2, (np.arange(n) >= 700).astype(np.int32), np.arange(n) < 150
    rows = similar_vectors.placed(field, uid, unit, [r.tobytes() for r in x], 0)
    for turn in (1, 2):  # the second time what is known comes back with the rows
        batch = similar_vectors.pa.RecordBatch.from_arrays([*rows.columns, similar_vectors.pa.array(guest)], [*rows.schema.names, "guest"])
        halves = [similar_vectors.Block(batch.slice(at, 1024), size, k) for at in (0, 1024)]
        for block in halves:
            block.x = block.x.view(Counted)
        Counted.made = 0
        for mine, other in ((0, 0), (1, 1), (1, 0)):
            halves[mine].meet(halves[other], least)
        for block in halves:
            block.settle()
        assert Counted.made < 1024 * 1024 * (1 + 2 * 0.6)
        near, sim = (np.concatenate([getattr(b, name) for b in halves]) for name in ("near", "sim"))
        if turn == 1:
            state = [x[i].tobytes() + near[i, : (h := (sim[i] > -2).sum())].tobytes() + sim[i, :h].tobytes() for i in range(n)]
            rows = similar_vectors.placed(field, uid, unit, state, 0)
    s = unit @ unit.T
    s[field[:, None] != field[None, :]] = -2
    np.fill_diagonal(s, -2)
    best = np.sort(np.where(s >= least, s, -2), axis=1)[:, ::-1][:, :k]
    best[guest] = -2
    assert (best > -2).sum() > 1000
    assert np.allclose(sim, best, atol=1e-5)
    place = np.argsort(uid)
    met = s[np.arange(n)[:, None], place[near // 2]]
    assert np.allclose(met[sim > -2], sim[sim > -2], atol=1e-5)
    assert all(len(set(row[have])) == have.sum() for row, have in zip(near, sim > -2, strict=True))


def test_routing_reads_keys_alone():
    keys = np.sort(np.random.default_rng(6).integers(0, 1 << 60, 5000))
    numbers = np.array([50, 7, 13, 2])
    ranges = similar_vectors.Ranges(keys, 4, 0.05, numbers)
    spots = ranges.route(similar_vectors.pa.array(keys)).to_pylist()
    own = np.searchsorted(ranges.cuts, keys, side="right")
    for key, part, spot in zip(keys, own, spots, strict=True):
        want = [2 * numbers[part]]
        want += [2 * numbers[part - 1] + 1] if part > 0 and key < ranges.high[part - 1] else []
        want += [2 * numbers[part + 1] + 1] if part < 3 and key >= ranges.low[part] else []
        assert spot == want
    guests = sum(x % 2 for spot in spots for x in spot)
    assert 0.25 < guests / len(keys) < 0.35
    assert similar_vectors.Ranges(keys[:0], 1, 0.05, numbers[:1]).route(similar_vectors.pa.array(keys[:3])).to_pylist() == [[100]] * 3


def test_hilbert_curve_is_a_walk():
    side = 8
    grid = np.array([(i, j) for i in range(side) for j in range(side)])
    order = grid[np.argsort(similar_vectors.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


ALIAS = [("Bill", "William"), ("Kit", "Christopher"), ("Kit", "Katherine"), ("Fdn.", "Foundation"), ("L.L.C.", "LLC"), (None, "x")]


def test_names_are_linked(spark):
    rows = [
        ("1", "William Torvanquist"), ("2", "Torvanquist, Bill"), ("3", "W. Torvanquist"), ("4", "WILLIAM TORVNAQUIST"), ("5", "Susan Torvanquist"), ("6", "william.torvanquist"), ("7", "Dr. William  Torvanquist (he/him)"),
        ("8", "Belarmesh Foundation LLC"), ("9", "belarmesh fdn."), ("10", "Belarmesh Foods LLC"), ("11", "BELARMSEH FOUNDATION L.L.C."), ("12", None), ("13", ""), ("14", "  "), ("15", "Jo"), ("16", "Susan Torvanquist <s.t@x.example>"),
    ]
    e = spark.createDataFrame(rows, "id string, name string").withColumn("kind", F.lit(None).cast("string"))
    alias = spark.createDataFrame(ALIAS, "short_form string, full_form string")
    got = {(p.id_a, p.id_b) for p in names.link(e, alias).collect()}

    def all_pairs(*ids):
        ids = sorted(ids)
        return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}

    # the initial fits William only: Susan begins with another letter
    assert got == all_pairs("1", "2", "3", "4", "6", "7") | all_pairs("8", "9", "11") | all_pairs("5", "16")
    assert names.link(e.limit(0), alias).count() == 0


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "abcd", 0), ("abcd", "acbd", 1), ("abcd", "abd", 1), ("abcd", "abcde", 1), ("abcd", "wxyz", 3)])
def test_edit_distance(a, b, want):
    assert names.edits(a, b, 2) == want


def test_deletes_meet_at_one_edit():
    for a, b in (("torvan", "torvn"), ("torvan", "tovran"), ("torvan", "torxan")):
        assert set(names.deletes(a)) & set(names.deletes(b))


def test_common_tokens_still_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON_NAMES", 2)
    given = ["william", "bill", "willaim", "w", "christopher", "chirstohper", "kit", "susan"]
    family = ["torvanquist", "torvnaquits", "allen", "alan", "al", "t", "de kim", ""]
    firms = ["belarmesh foundation llc", "belarmesh fdn", "belarmesh foods", "blarmesh foods ltd", "belarmesh"]
    parts = [sorted(names.tokens(f"{g} {f}")) for g in given for f in family] + [sorted(names.tokens(f)) for f in firms]
    matcher = names.Matcher({"bill": {"william"}, "kit": {"christopher"}})
    firm = [bool({"foundation", "foods", "llc", "ltd"} & set(p)) for p in parts]
    forms = spark.createDataFrame(list(zip(range(len(parts)), parts, firm, strict=True)), "fid long, parts array<string>, firm boolean")
    got = {(p.a, p.b) for p in names.candidates(forms, matcher).collect()}
    want = {(i, j) for j in range(len(parts)) for i in range(j) if parts[i] != parts[j] and matcher.compare(parts[i], parts[j], firm[i] or firm[j])}
    assert len(want) > 100
    assert not want - got
    assert len(got) < len(parts) * (len(parts) - 1) / 2


def test_initial_beside_another_family_name_is_no_match():
    matcher = names.Matcher({})
    assert matcher.compare(["david", "torekvanberg"], ["david", "t", "wilulsodottir"]) == 0
    assert matcher.compare(["david", "torekvanberg"], ["d", "torekvanberg"]) == 1


def test_short_and_long_names_of_any_type(spark):
    long = "Torvan Belmar Quistel Hesorin Dalvane Rinolta Foundation"
    rows = [
        ("1", "Ann Lee", "person"), ("2", "Lee, Ann", "person"), ("3", "Bo Li", None), ("4", "bo  li", None), ("5", "Jo Li", None), ("6", "A. Lee", "person"),
        ("7", long, "firm"), ("8", long.replace("Hesorin", "Hesoirn"), "firm"), ("9", long.replace("Hesorin", "Kelmard"), "firm"),
        ("10", "Ann Torvanquist", "other"), ("11", "Ann Torvanqiust", "person"), ("12", "Ann Belmar", "person"), ("13", "Ann Quistel", "person"), ("14", "Ann Dalvane", "person"),
        ("15", "Minutes Hesorin 12", "other"), ("16", "Minutes Hesorin 12", "other"), ("17", "Review Rinolta", "other"), ("18", "Review Rinolta", "other"),
    ]
    e = spark.createDataFrame(rows, "id string, name string, kind string")
    alias = spark.createDataFrame(ALIAS, "short_form string, full_form string")
    got = {(p.id_a, p.id_b) for p in names.link(e, alias).collect()}
    assert got == {("1", "2"), ("1", "6"), ("2", "6"), ("3", "4"), ("7", "8"), ("10", "11")}


def test_names_fit_the_group_with_the_fewest_typing_errors(spark):
    rows = [
        ("1", "Frederick Garavredottir"), ("2", "Fred Garavredottir"), ("3", "F.R. Garavredottir"), ("4", "Francis Saravtedottir"),  # two letters apart by chance
        ("5", "Judith Vesastigstrom"), ("6", "J.T. Vesastigstrom"), ("7", "Theodore Vesastigstrom"),  # the first initial is the given name's
        ("8", "Hr. Peter Hesobmadwick"), ("9", "P. Hesobmadwick"), ("10", "Peter Hesobmadwick"),
        ("11", "Becky Doreltarkamp"), ("12", "Rebecca Doreltarkamp"),
        ("13", "Zoe Volemnastez"), ("14", "Zachary Volemnastez"), ("15", "Z. Volemnastez <zoe66@selollimvia.example>"),
        ("16", "Lucia M. Rinukmirstrom"), ("17", "Lucia R. Malegguvier"),  # each family name begins like the other's initial
        ("18", "Tobias Falodmathier"), ("19", "Toby Falodmathier"), ("20", "Tobias Faltodmither"), ("21", "Toby Faltodmither"),
    ]
    e = spark.createDataFrame(rows, "id string, name string").withColumn("kind", F.lit("person"))
    alias = spark.createDataFrame([*ALIAS, ("Toby", "Tobias")], "short_form string, full_form string")
    got = {(p.id_a, p.id_b) for p in names.link(e, alias).collect()}
    groups = [("1", "2", "3"), ("5", "6"), ("10", "8", "9"), ("11", "12"), ("13", "15"), ("18", "19"), ("20", "21")]
    assert got == {pair for g in groups for pair in itertools.combinations(sorted(g), 2)}


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 5))
        m = n + int(r.integers(0, 3))
        cost = r.integers(0, 9, (n, m)).astype(float).tolist()
        best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        chosen = names.assignment(cost)
        assert len(set(chosen)) == n
        assert sum(cost[i][j] for i, j in enumerate(chosen)) == best
