"""Clusters, lookalikes, the budget's split and held-out shares against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import audiences, budget, features
from marketlens.sources.adapter import from_testdata

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def points(spark):
    return audiences.standardised(from_testdata(spark, FOLDER))[0]


def table(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, z array<double>")


def test_standardised(points):
    z = np.array([r["z"] for r in points.collect()])
    assert z.mean(0) == pytest.approx(np.zeros(8), abs=1e-5) and z.std(0) == pytest.approx(np.ones(8), abs=1e-5)


def test_clusters_settle_where_plain_iterations_do(spark):
    r = np.random.default_rng(1)
    spots = np.array([[0, 0], [6, 0], [0, 6], [7, 7]])
    z = np.round(np.concatenate([s + r.normal(size=(60, 2)) * 0.5 for s in spots]), 6)
    frame = table(spark, [(f"c{k:03}", list(map(float, v))) for k, v in enumerate(z)])
    seeds = audiences.seeded(frame, 4)
    assert len(seeds) == 4 and all(min(math.dist(s, c) for s in seeds) < 2.5 for c in spots)
    centres, told = seeds, np.array(seeds)
    for _ in range(6):
        centres = audiences.moved(frame, centres)
        home = ((z[:, None] - told[None]) ** 2).sum(2).argmin(1)
        told = np.array([z[home == k].mean(0).round(6) if (home == k).any() else told[k] for k in range(4)])
    assert np.array(centres) == pytest.approx(told, abs=2e-6)
    found = audiences.Clustering(frame, [(0.0, 1.0)] * 2, centres).assigned().collect()
    gap = ((z[:, None] - np.array(centres)[None]) ** 2).sum(2)
    assert {x["customer_id"]: x["at"] for x in found} == {f"c{k:03}": int(g.argmin()) for k, g in enumerate(gap)}


def test_clusters_of_awkward_points(spark):
    same = table(spark, [(f"c{k}", [1.0, 2.0]) for k in range(20)])
    assert audiences.seeded(same, 3) == [[1.0, 2.0]]  # fewer points than centres
    assert audiences.moved(same, [[0.0, 0.0], [99.0, 99.0]]) == [[1.0, 2.0], [99.0, 99.0]]  # an empty one stays
    assert audiences.seeded(table(spark, []), 3) == []


def test_facts_are_read_once_for_the_points(spark, monkeypatch):
    """Moments and points come from written features, not from the facts again."""
    read = spark.sparkContext.accumulator(0)
    people = [(f"c{k}", *[float(k + i) for i in range(len(audiences.BEHAVIOUR))]) for k in range(40)]
    schema = ", ".join(["customer_id string", *(f"{n} double" for n in audiences.BEHAVIOUR)])

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    monkeypatch.setattr(audiences, "feature_matrix", lambda t: spark.createDataFrame(
        people, schema).mapInArrow(counted, schema))
    found, _ = audiences.standardised(None)
    assert found.count() == 40 and read.value == 40


def test_lookalikes_recall(spark, points):
    whales = from_testdata(spark, FOLDER).customers.where("customer_segment = 'whale'")
    rows = points.collect()
    inside = {r["customer_id"] for r in whales.select("customer_id").collect()}
    rest = sorted((r["customer_id"], r["z"]) for r in rows if r["customer_id"] not in inside)
    z = np.array([v for _, v in rest])
    got = {}
    for r in audiences.nearest(points, whales).collect():
        got.setdefault(r["seed_id"], {})[r["customer_id"]] = r["d2"]
    hit = all_ = 0
    for r in rows:
        if r["customer_id"] in inside:
            d2 = ((z - np.array(r["z"])) ** 2).sum(1)
            best = np.argsort(d2, kind="stable")[:audiences.NEAREST]
            own = got.get(r["customer_id"], {})
            hit += sum(rest[k][0] in own for k in best)
            all_ += len(best)
            assert all(own[rest[k][0]] == pytest.approx(d2[k]) for k in best if rest[k][0] in own)
    assert hit / all_ >= 0.95


def test_lookalikes_of_one_crowded_point(spark):
    """A third of all customers share one point: only the first k of them meet a seed."""
    rows = [(f"c{k:04}", [0.0, 0.0]) for k in range(3000)] + [("seed", [0.1, 0.0]), ("far", [50.0, 0.0])]
    frame = table(spark, rows)
    got = audiences.nearest(frame, frame.where("customer_id = 'seed'"), 3).collect()
    assert sorted(r["customer_id"] for r in got) == ["c0000", "c0001", "c0002"]
    assert audiences.distinct_points(frame, 3).count() == 5


def test_lookalikes_meet_in_tiles(spark, monkeypatch):
    """Pairs that meet are compared in tiles, and only each seed's nearest become rows."""
    r = np.random.default_rng(3)
    rows = [(f"c{k:03}", [float(v) for v in r.normal(size=2)]) for k in range(120)]
    rows += [("c005", [0.0, 0.0]), ("c006", rows[6][1])]  # a customer with two points, and one twice
    frame = table(spark, rows)
    seeds = frame.where("customer_id < 'c030'")
    monkeypatch.setattr(audiences, "TILE", 7)
    got = {}
    for g in audiences.nearest(frame, seeds, 4).orderBy("seed_id", "nth").collect():
        got.setdefault(g["seed_id"], []).append((g["d2"], g["customer_id"]))
    cells = {t: [] for t in range(audiences.HASH_TABLES)}
    used = audiences.used_projections(len(rows))

    def cell(z, t):
        return tuple(math.floor((sum(a * b for a, b in zip(d, z, strict=True)) + o) / audiences.WIDTH)
                     for d, o in audiences.projections(2)[t][:used])

    for who, z in rows:
        for t in cells:
            cells[t].append((who, z, cell(z, t)))
    told = {}
    for t, held in cells.items():
        for seed, sz, own in held:
            for who, z, other in held:
                gap = [abs(a - b) for a, b in zip(own, other, strict=True)]
                if seed < "c030" <= who and sum(gap) <= 1:
                    d2 = (z[0] - sz[0]) * (z[0] - sz[0]) + (z[1] - sz[1]) * (z[1] - sz[1])
                    best = told.setdefault(seed, {})
                    best[who] = min(d2, best.get(who, d2))
    assert got == {seed: sorted((d, w) for w, d in best.items())[:4] for seed, best in told.items()}
    looked = spark.createDataFrame([(f"s{k}", [float(k)], 0, [0]) for k in range(20)],
                                   "seed_id string, seed_z array<double>, table int, cell array<int>")
    hashed = spark.createDataFrame([(f"c{k}", [float(k)], 0, [0]) for k in range(500)],
                                   "customer_id string, z array<double>, table int, cell array<int>")
    monkeypatch.setattr(audiences, "TILE", 100)
    assert audiences.tiled(looked, hashed, 4).count() <= 20 * 5 * 2 * 4


def test_seeds_are_compared_with_few_of_a_crowded_cell(spark, monkeypatch):
    """Customers that share all cells are not compared with each seed that looks into them."""
    r = np.random.default_rng(8)
    z = np.round(r.normal(size=(2600, 2)) * 0.2, 6)
    frame = table(spark, [(f"c{k:04}", list(map(float, v))) for k, v in enumerate(z)])
    pairs, plain = spark.sparkContext.accumulator(0), audiences._compared

    def counted(*parts):
        run = plain(*parts)

        def counting(batches):
            def seen():
                for batch in batches:
                    for i in range(len(batch)):
                        pairs.add(len(batch.column("customers")[i].values) * len(batch.column("looking")[i].values))
                    yield batch

            return run(seen())

        return counting

    monkeypatch.setattr(audiences, "_compared", counted)
    monkeypatch.setattr(audiences, "TILE", 64)
    got = {}
    for g in audiences.nearest(frame, frame.where("customer_id < 'c0600'"), 3).orderBy("seed_id", "nth").collect():
        got.setdefault(g["seed_id"], []).append(g["customer_id"])
    d2 = ((z[:600, None] - z[None, 600:]) ** 2).sum(2)
    assert got == {f"c{k:04}": [f"c{600 + i:04}" for i in np.argsort(d2[k], kind="stable")[:3]] for k in range(600)}
    assert pairs.value < 600 * 2000 / 2  # a table's cells alone are 600 * 2000


def test_seeds_without_customers_in_their_leaf(spark, monkeypatch):
    """Those find the customers of the cells that they look into, wherever these lie."""
    r = np.random.default_rng(9)
    z = np.round(r.normal(size=(240, 4)) * 25, 6)
    names = [f"c{k:03}" for k in range(240)]
    frame = table(spark, [(n, list(map(float, v))) for n, v in zip(names, z, strict=True)])
    monkeypatch.setattr(audiences, "TILE", 8)
    got = {}
    for g in audiences.nearest(frame, frame.where("customer_id < 'c060'"), 3).orderBy("seed_id", "nth").collect():
        got.setdefault(g["seed_id"], []).append(g["customer_id"])
    meeting = audiences.Meeting(4, audiences.used_projections(240))
    own = meeting.cells(z)
    told = {}
    for k in range(60):
        met = 60 + np.nonzero(meeting.of(own[k], own[60:]))[0]
        if len(met):
            told[names[k]] = [names[i] for i in met[np.argsort(((z[met] - z[k]) ** 2).sum(1), kind="stable")[:3]]]
    assert got == told and any(len(v) < 3 for v in told.values())
    jvm = frame.select("customer_id", audiences.cells(F.col("z"), 4, meeting.used).alias("cells"))
    assert {c["customer_id"]: c["cells"] for c in jvm.collect()} == dict(zip(names, own.tolist(), strict=True))


def test_leaves_hold_all_that_are_near():
    r = np.random.default_rng(10)
    z = np.round(r.standard_t(3, size=(2000, 3)), 1)
    z[:500] = 0.0
    leaves = audiences.Leaves.halving(z[::7], 6)
    at = leaves.at(z)
    held = np.unique(at)
    leaves = leaves.bounded(held, np.array([z[at == n].min(0) for n in held]), np.array([z[at == n].max(0) for n in held]))
    limit = r.random(300) * 2
    row, leaf = leaves.within(z[600:900], limit)
    visits = set(zip(row.tolist(), leaf.tolist(), strict=True))
    assert len(visits) == len(row) < 300 * len(held) / 2
    d2 = ((z[600:900, None] - z[None]) ** 2).sum(2)
    assert {(k, int(at[i])) for k, i in zip(*np.nonzero(d2 <= limit[:, None]), strict=True)} <= visits


def test_lookalikes_of_nobody(spark):
    nobody = table(spark, [])
    assert audiences.nearest(nobody, nobody).count() == 0
    some = table(spark, [("a", [1.0]), ("b", [2.0])])
    assert audiences.nearest(some, nobody).count() == 0 and audiences.nearest(some, some).count() == 0


def test_projections_grow_with_the_customers():
    assert [audiences.used_projections(n) for n in (0, 1500, 4000, 10**5, 10**9)] == [2, 2, 3, 5, 8]


def curves(spark, rows):
    return spark.createDataFrame(rows, "channel string, top double, half double")


def test_budget_is_the_best_split(spark):
    known = curves(spark, [("a", 100.0, 10.0), ("b", 300.0, 50.0), ("c", 5.0, 40.0), ("d", None, None)])
    for whole in (1.0, 30.0, 1000.0):
        got = {r["channel"]: r for r in budget.filled(known, F.lit(whole)).collect()}
        given = {k: r["given"] for k, r in got.items()}
        assert sum(given.values()) == pytest.approx(whole) and given["d"] == 0 and min(given.values()) >= 0
        slope = {k: got[k]["top"] * got[k]["half"] / (got[k]["half"] + given[k]) ** 2 for k in "abc"}
        used = [slope[k] for k in "abc" if given[k] > 0]
        assert used == pytest.approx([used[0]] * len(used))
        assert all(slope[k] <= used[0] + 1e-12 for k in "abc" if given[k] == 0)


def test_curve_is_found_again(spark):
    days = [("x", d, float(s), 80.0 * s / (20.0 + s)) for d, s in enumerate(range(5, 161, 5))]
    days += [("idle", d, 0.0, 3.0) for d in range(5)] + [("bad", d, float(d), -1.0) for d in range(5)]
    frame = spark.createDataFrame(days, "channel string, day int, spend double, value double")
    got = {r["channel"]: r for r in budget.response_curves(frame).collect()}
    assert got["x"]["half"] == pytest.approx(20) and got["x"]["top"] == pytest.approx(80)
    assert got["x"]["r_squared"] == pytest.approx(1)
    assert got["idle"]["top"] is None and got["bad"]["top"] is None


def test_split_is_exact(spark):
    frame = spark.createDataFrame([(f"c{k}", k % 3 if k % 50 else None) for k in range(997)],
                                  "customer_id string, y int")
    got = features.with_split(frame, label="y")
    assert got.columns == ["customer_id", "y", "is_test"] and got.count() == 997
    for r in got.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == math.floor(0.2 * r["n"] + 0.5)
    assert features.with_split(frame).where("is_test").count() == 199
    again = features.with_split(frame.repartition(7), label="y").where("is_test")
    assert again.exceptAll(got.where("is_test")).count() == 0
