"""Behavioural clusters and lookalike audiences over standardised customer features."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numbers import fixed
from marketlens.functions.rows import beside, spread
from marketlens.operators.features import feature_matrix
from marketlens.plans.tables import Tables
from marketlens.session import checkpoint_dir

BEHAVIOUR = ("deposit_frequency", "avg_deposit_size", "betting_frequency", "avg_bet_size", "win_rate",
             "sports_diversity", "sessions_per_week", "avg_session_duration")

CLUSTERS = 5
SEEDING_ROUNDS = 3
OVERSAMPLING = 2  # customers expected per round and cluster
ITERATIONS = 12
SEED = 42

NEAREST = 5
HASH_TABLES = 12
PROJECTIONS = 8  # of which the number of customers decides how many are used
WIDTH = 3.0  # of a projection's cells, in standard deviations
SALTS = 64
TILE = 1024  # customers of a cell, and seeds, that are compared at once
PAIRS = 1 << 16  # of which it is asked at once whether they meet
DEPTH = 14  # of halvings at most
SHOWN = 16  # customers a leaf that its bounds are cut by
LOOKING = 128  # seeds that look around at once


# --- standardised points ------------------------------------------------------------------

def standardised(t: Tables, names: Sequence[str] = BEHAVIOUR) -> tuple[DataFrame, list[tuple[float, float]]]:
    """customer_id and ``z``, the standardised features; and each feature's mean and deviation.

    A feature without spread is 0 everywhere. The features are checkpointed, as their moments are
    needed before their rows, and so are the points: what follows passes over them many times.
    """
    rows = feature_matrix(t).select("customer_id", *[F.col(n).cast("double").alias(n) for n in names])
    checkpoint_dir(rows.sparkSession)
    rows = spread(rows.checkpoint(), "customer_id")
    moments = rows.agg(*[F.avg(n).alias(f"{n}_mean") for n in names],
                       *[F.stddev_pop(n).alias(f"{n}_std") for n in names])
    z = [F.when(F.col(f"{n}_std") > 0, fixed((F.col(n) - F.col(f"{n}_mean")) / F.col(f"{n}_std"), 6))
         .otherwise(0.0) for n in names]
    points = beside(rows, moments).select("customer_id", F.array(*z).alias("z")).checkpoint()
    scale = moments.first()
    return points, [(scale[f"{n}_mean"] or 0.0, scale[f"{n}_std"] or 0.0) for n in names]


def squared(z: Column, other: Sequence) -> Column:
    """Squared distance, added up in the order of the features."""
    total = None
    for k, value in enumerate(other):
        gap = z[k] - value
        total = gap * gap if total is None else total + gap * gap
    return total


def nearest_of(z: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Struct of the squared distance to the nearest centre and its number; ties to the first."""
    return F.array_min(F.array(*[
        F.struct(squared(z, [F.lit(v) for v in centre]).alias("d2"), F.lit(k).alias("at"))
        for k, centre in enumerate(centres)]))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)


# --- clusters -----------------------------------------------------------------------------

def seeded(points: DataFrame, k: int, rounds: int = SEEDING_ROUNDS, seed: int = SEED) -> list[list[float]]:
    """First centres by parallel oversampling.

    Each round keeps every customer with a probability in proportion to the squared distance from
    those kept so far, about ``OVERSAMPLING * k`` customers a round. Those kept are weighed by the
    customers nearest to them; the heaviest is the first centre, and the next is always the one
    with the largest weight times squared distance. Few rows come to the driver at any size.
    """
    z, who = F.col("z"), F.col("customer_id")
    chance = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("0"), who))
    first = points.agg(F.min(F.struct(chance.alias("c"), who, z))["z"].alias("z")).first()["z"]
    if first is None:
        return []
    kept = [(-1, "", list(first))]
    for r in range(1, rounds + 1):
        cost = nearest_of(z, [c for *_, c in kept])["d2"]
        total = points.agg(F.sum(cost)).first()[0]
        if not total:
            break
        luck = draw(F.lit(str(seed)), F.lit(str(r)), who)
        found = points.where(luck < cost * F.lit(float(OVERSAMPLING * k)) / F.lit(total)).collect()
        kept += sorted((r, row["customer_id"], list(row["z"])) for row in found)
    places = [c for *_, c in kept]
    counts = points.groupBy(nearest_of(z, places)["at"].alias("at")).count().collect()
    weight = {row["at"]: row["count"] for row in counts}

    def apart(a, b):
        return sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))

    chosen = [max(range(len(places)), key=lambda i: (weight.get(i, 0), -i))]
    while len(chosen) < min(k, len(places)):
        score = [weight.get(i, 0) * min(apart(c, places[j]) for j in chosen)
                 for i, c in enumerate(places)]
        best = max(range(len(places)), key=lambda i: (score[i], -i))
        if score[best] <= 0:
            break
        chosen.append(best)
    return [places[i] for i in chosen]


def moved(points: DataFrame, centres: list[list[float]]) -> list[list[float]]:
    """Means of the customers nearest to each centre; a centre that has none stays.

    One aggregate with map-side sums: as many rows leave a task as there are centres.
    """
    width = len(centres[0])
    means = points.groupBy(nearest_of(F.col("z"), centres)["at"].alias("at")).agg(*[
        fixed(F.avg(F.col("z")[i]), 6).alias(f"m{i}") for i in range(width)]).collect()
    out = [list(c) for c in centres]
    for row in means:
        out[row["at"]] = [row[f"m{i}"] for i in range(width)]
    return out


@dataclass
class Clustering:
    points: DataFrame
    scale: list[tuple[float, float]]
    centres: list[list[float]]

    def assigned(self) -> DataFrame:
        """customer_id, at (number of the centre), d2."""
        best = nearest_of(F.col("z"), self.centres)
        return self.points.select("customer_id", best.alias("best")).select(
            "customer_id", F.col("best.at").alias("at"), F.col("best.d2").alias("d2"))


def clustering(t: Tables, k: int = CLUSTERS, iterations: int = ITERATIONS, seed: int = SEED) -> Clustering:
    points, scale = standardised(t)
    centres = seeded(points, k, seed=seed)
    for _ in range(iterations if centres else 0):
        previous, centres = centres, moved(points, centres)
        if centres == previous:
            break
    return Clustering(points, scale, centres)


def _sized(found: Clustering) -> DataFrame:
    """Per centre: its place in the order of sizes, customers, inertia and coordinates."""
    spark = found.points.sparkSession
    names = [f"z{i}" for i in range(len(BEHAVIOUR))]
    centres = spark.createDataFrame([(k, *c) for k, c in enumerate(found.centres)],
                                    ", ".join(["at int", *(f"{n} double" for n in names)]))
    if not found.centres:
        return centres.selectExpr("at", "at AS cluster", "0L AS customers", "0D AS inertia", *names)
    sizes = found.assigned().groupBy("at").agg(F.count("*").alias("customers"), F.sum("d2").alias("inertia"))
    sized = centres.join(sizes, "at", "left").na.fill({"customers": 0, "inertia": 0.0})
    # a row a cluster
    order = Window.orderBy(F.desc("customers"), "at")
    return sized.withColumn("cluster", F.row_number().over(order))


def behaviour_clusters(t: Tables, k: int = CLUSTERS) -> DataFrame:
    """Clusters from the largest: customers, inertia, and the centre in the features' units."""
    found = clustering(t, k)
    return _sized(found).select(
        "cluster", "customers", fixed("inertia", 4).alias("inertia"),
        *[fixed(F.lit(mean) + F.col(f"z{i}") * F.lit(std), 4).alias(name)
          for i, (name, (mean, std)) in enumerate(zip(BEHAVIOUR, found.scale, strict=True))])


def behaviour_membership(t: Tables, k: int = CLUSTERS) -> DataFrame:
    """The cluster of each customer and the distance from its centre."""
    found = clustering(t, k)
    if not found.centres:
        return found.points.selectExpr("customer_id", "0 AS cluster", "0D AS distance")
    return found.assigned().join(_sized(found).select("at", "cluster"), "at").select(
        "customer_id", "cluster", fixed(F.sqrt("d2"), 6).alias("distance"))


# --- lookalikes ---------------------------------------------------------------------------

def projections(width: int, seed: int = SEED) -> list[list[tuple[list[float], float]]]:
    """Directions and offsets of each hash table's projections."""
    r = random.Random(seed)
    return [[([round(r.gauss(0, 1), 6) for _ in range(width)], round(r.random() * WIDTH, 6))
             for _ in range(PROJECTIONS)] for _ in range(HASH_TABLES)]


def used_projections(customers: int) -> int:
    """Projections of a key: one more for four times the customers, so that cells stay small."""
    return min(PROJECTIONS, max(2, 2 + math.floor(math.log(max(customers, 1) / 1000, 4))))


def cells(z: Column, width: int, used: int) -> Column:
    """For each table, the cells of its projections."""
    tables = []
    for table in projections(width):
        dots = []
        for direction, offset in table[:used]:
            total = None
            for i, a in enumerate(direction):
                term = z[i] * F.lit(a)
                total = term if total is None else total + term
            dots.append(F.floor((total + F.lit(offset)) / F.lit(WIDTH)).cast("int"))
        tables.append(F.array(*dots))
    return F.array(*tables)


def distinct_points(points: DataFrame, k: int) -> DataFrame:
    """At most the first ``k`` customers of each point: more of them are never among the k nearest.

    A point shared by many customers is thinned in parts first.
    """
    salt = F.pmod(F.xxhash64("customer_id"), F.lit(SALTS))
    for keys in (["z", "salt"], ["z"]):
        order = Window.partitionBy(*keys).orderBy("customer_id")
        points = points.withColumn("salt", salt).withColumn("nth", F.row_number().over(order)).where(
            F.col("nth") <= k).drop("nth", "salt")
    return points


@dataclass
class Meeting:
    """Who meets: a customer in a cell of some table, or in the cell next to it by one projection."""
    width: int
    used: int

    def cells(self, z: np.ndarray) -> np.ndarray:
        """Per point, table and projection, the numbers that the column ``cells`` has."""
        tables = [table[:self.used] for table in projections(self.width)]
        total = np.zeros((len(z), len(tables), self.used))
        for f in range(self.width):  # added up in the order of the features
            total = total + z[:, f, None, None] * np.array([[d[f] for d, _ in table] for table in tables])
        return np.floor((total + np.array([[o for _, o in table] for table in tables])) / WIDTH).astype(np.int32)

    def of(self, own: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether pairs of cells meet."""
        return (np.abs(own - far).sum(-1) <= 1).any(-1)


def _compared(k: int, meeting: Meeting | None):
    """For each tile's seeds, the k customers nearest to each, and those as near as the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                customers, looking = (batch.column(c)[i].values for c in ("customers", "looking"))
                seed, z, seed_z = looking.field("seed_id"), _points(customers.field("z")), _points(looking.field("seed_z"))
                d2 = np.zeros((len(seed_z), len(z)))
                for f in range(z.shape[1]):  # added up in the order of the features
                    gap = z[None, :, f] - seed_z[:, f, None]
                    d2 += gap * gap
                d2[d2 > looking.field("within").to_numpy(zero_copy_only=False)[:, None]] = np.inf
                coded = customers.field("customer_id").dictionary_encode()
                number, who = coded.indices.to_numpy(), coded.dictionary
                often = np.bincount(number).max()  # rows of one customer, that count once
                far, own = (meeting.cells(x) for x in (seed_z, z)) if meeting else (None, None)

                def met(row, at, own=own, far=far):
                    if meeting is None:
                        return np.ones(len(row), bool)
                    return np.concatenate([meeting.of(own[at[s:s + PAIRS]], far[row[s:s + PAIRS]])
                                           for s in range(0, len(row), PAIRS)] or [np.zeros(0, bool)])

                last = _kth(d2, k * often, met)
                row, at = np.nonzero((d2 <= last[:, None]) & (d2 < np.inf))
                kept = met(row, at)
                row, at = row[kept], at[kept]
                near = d2[row, at]
                if often > 1:
                    order = np.lexsort((near, number[at], row))
                    row, at, near = row[order], at[order], near[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (number[at[1:]] != number[at[:-1]])
                    row, at, near = row[new], at[new], near[new]
                yield pa.record_batch({"seed_id": seed.take(pa.array(row)), "customer_id": who.take(pa.array(number[at])),
                                       "d2": pa.array(near)})

    return run


def _kth(d2: np.ndarray, k: int, met: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Per row, the k-th least distance of those that meet; infinite where fewer do.

    Whether a pair meets costs more than its distance: it is asked of the nearest first.
    """
    last, left, reach = np.full(len(d2), np.inf), np.arange(len(d2)), 4 * k
    while len(left) and k <= d2.shape[1]:
        reach = min(reach, d2.shape[1])
        at = np.argpartition(d2[left], reach - 1, 1)[:, :reach]
        near = d2[left[:, None], at]
        more = near.max(1) < np.inf
        near[~met(np.repeat(left, reach), at.ravel()).reshape(near.shape)] = np.inf
        last[left] = np.partition(near, k - 1, 1)[:, k - 1]
        if reach == d2.shape[1]:
            break
        left, reach = left[more & (last[left] == np.inf)], reach * 8
    return last


def _points(z: pa.Array) -> np.ndarray:
    return np.asarray(z.flatten()).reshape(len(z), -1)


def tiled(looked: DataFrame, hashed: DataFrame, k: int, cell: Sequence[str] = ("table", "cell"),
          meeting: Meeting | None = None) -> DataFrame:
    """seed_id, customer_id, d2: for each cell and seed that looks into it, its k nearest at least.

    A tile is a part of a cell's customers; the seeds that look into the cell come to it in parts.
    With ``meeting`` only those that meet count, and only those as near as ``within`` where
    ``looked`` has it.
    """
    if "within" not in looked.columns:
        looked = looked.withColumn("within", F.lit(math.inf))

    def parts(rows: DataFrame, who: str) -> DataFrame:
        """Rows per cell, cut by a hash into parts of about ``TILE``."""
        return rows.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias(f"{who}_parts"))

    def dealt(who: str, n: str) -> Column:
        return F.pmod(F.xxhash64(who), F.col(n)).cast("int")

    # only cells that hold customers and are looked into
    grid = parts(hashed, "own").join(parts(looked, "far"), list(cell))
    tile = [*cell, "own_part", "far_part"]

    def gathered(rows: DataFrame, who: list[str], own: str, other: str, name: str) -> DataFrame:
        there = rows.join(grid, list(cell)).withColumn(f"{own}_part", dealt(who[0], f"{own}_parts"))
        # a part of one side meets every part of the other, and is kept once a tile
        return there.groupBy(*cell, f"{own}_part", f"{other}_parts").agg(
            F.collect_list(F.struct(*who)).alias(name)).withColumn(
            f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).select(*tile, name)

    customers = gathered(hashed, ["customer_id", "z"], "own", "far", "customers")
    looking = gathered(looked, ["seed_id", "seed_z", "within"], "far", "own", "looking")
    return customers.join(looking, tile).select("customers", "looking").mapInArrow(
        _compared(k, meeting), "seed_id string, customer_id string, d2 double")


@dataclass
class Leaves:
    """Space halved again and again: the halves of node n are 2n + 1 and 2n + 2, the last are leaves.

    ``low`` and ``high`` are the bounds of the customers beneath each node.
    """
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @classmethod
    def halving(cls, z: np.ndarray, depth: int) -> Leaves:
        """Halves at the median of the feature that varies most."""
        inner = 2**depth - 1
        feature, cut, held = np.zeros(inner, int), np.full(inner, np.inf), [z]
        for n in range(inner):
            own = held[n]
            wide = own.std(0).argmax() if len(own) else 0
            if len(own) and own[:, wide].min() < own[:, wide].max():
                values = np.sort(own[:, wide])
                middle = values[(len(values) - 1) // 2]
                # the upper half is not empty
                feature[n], cut[n] = wide, middle if middle < values[-1] else values[values < middle][-1]
            above = own[:, feature[n]] > cut[n] if len(own) else np.zeros(0, bool)
            held += [own[~above], own[above]]
            held[n] = None
        return cls(depth, feature, cut)

    def at(self, z: np.ndarray) -> np.ndarray:
        node = np.zeros(len(z), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (z[np.arange(len(z)), self.feature[node]] > self.cut[node])
        return node - len(self.cut)

    def bounded(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> Leaves:
        """With the bounds of the leaves that hold customers."""
        inner = len(self.cut)
        bounds = []
        for ends, least, nothing in ((low, np.minimum, np.inf), (high, np.maximum, -np.inf)):
            every = np.full((2 * inner + 1, low.shape[1]), nothing)
            every[inner + leaf] = ends
            for n in reversed(range(inner)):
                every[n] = least(every[2 * n + 1], every[2 * n + 2])
            bounds.append(every)
        return Leaves(self.depth, self.feature, self.cut, *bounds)

    def within(self, z: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a leaf whose bounds are no further from it than ``d2``.

        The distance is added up in the order of the features, so rounding never makes it longer
        than that of a customer within the bounds.
        """
        row, node = np.arange(len(z)), np.zeros(len(z), int)
        for level in range(self.depth + 1):
            if level:
                row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
            total = np.zeros(len(row))
            for f in range(z.shape[1]):
                gap = np.maximum(0.0, np.maximum(self.low[node, f] - z[row, f], z[row, f] - self.high[node, f]))
                total += gap * gap
            near = ~(total > d2[row]) & (total != np.inf)
            row, node = row[near], node[near]
        return row, node - len(self.cut)


def placed(rows: DataFrame, leaves: Leaves, z: str = "z") -> DataFrame:
    """``rows`` with the leaf of each point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = pa.array(leaves.at(_points(batch.column(z))), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, f"{_ddl(rows)}, leaf int")


def looking_around(rows: DataFrame, leaves: Leaves) -> DataFrame:
    """seed_id, seed_z, within: once for each leaf that is as near as ``within``, but for its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, LOOKING) for s in range(0, len(batch), LOOKING)):
                z = _points(part.column("seed_z"))
                row, leaf = leaves.within(z, part.column("within").to_numpy(zero_copy_only=False))
                other = leaf != leaves.at(z)[row]
                taken = part.take(pa.array(row[other]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf[other], pa.int32())],
                                                 [*taken.schema.names, "leaf"])

    return rows.mapInArrow(run, f"{_ddl(rows)}, leaf int")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)


def leaves_of(rest: DataFrame, customers: int) -> Leaves:
    """Leaves of about ``TILE`` customers, cut where some customers of each leave halves alike.

    Where the cuts lie decides which customers are compared side by side, never who is found.
    """
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(customers, 1) / TILE))))
    shown = draw(F.lit("leaf"), F.col("customer_id")) < F.lit(SHOWN * 2**depth / max(customers, 1))
    z = rest.where(shown).select("z").toArrow().column("z").combine_chunks()
    return Leaves.halving(_points(z) if len(z) else np.zeros((0, 1)), depth)


def closest(met: DataFrame, k: int) -> DataFrame:
    """seed_id, customer_id, d2 and ``nth`` of the k nearest among those that met."""
    order = Window.partitionBy("seed_id").orderBy("d2", "customer_id")
    return met.groupBy("seed_id", "customer_id").agg(F.min("d2").alias("d2")).withColumn(
        "nth", F.row_number().over(order)).where(F.col("nth") <= k)


def met_in_cells(inside: DataFrame, rest: DataFrame, k: int, meeting: Meeting) -> DataFrame:
    """seed_id, customer_id, d2 of the first k customers of each cell that a seed looks into.

    A seed that finds fewer than k so has found all that it meets.
    """
    width, used = meeting.width, meeting.used
    hashed = rest.select("customer_id", "z", F.posexplode(cells(F.col("z"), width, used)).alias("table", "cell"))
    shifts = [[0] * used] + [[s if i == j else 0 for i in range(used)] for j in range(used) for s in (-1, 1)]
    probes = F.explode(F.array(*[
        F.zip_with("own", F.array(*map(F.lit, shift)), lambda a, b: a + b) for shift in shifts]))
    looked = inside.select("seed_id", "seed_z", F.posexplode(cells(F.col("seed_z"), width, used)).alias(
        "table", "own")).select("seed_id", "seed_z", "table", probes.alias("cell"))
    # a customer may have several points in a cell
    order = Window.partitionBy("table", "cell").orderBy("customer_id")
    first = hashed.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= k)
    return looked.join(first, ["table", "cell"]).select(
        "seed_id", "customer_id", squared(F.col("z"), [F.col("seed_z")[i] for i in range(width)]).alias("d2"))


def nearest(points: DataFrame, seeds: DataFrame, k: int = NEAREST) -> DataFrame:
    """seed_id, customer_id, d2 and ``nth`` of the k nearest customers outside ``seeds``.

    Points are hashed by projections into cells; a seed meets the customers of its own cells and of
    the cells next to them. It has k of them from its own leaf of halved space, or else from those
    cells, and is then compared with all leaves that are no further than the last of these. So each
    seed is compared with few customers, however many share its cells, and pairs that meet are
    never rows. The distances are exact, and so are the neighbours but for those that share a cell
    in no table.
    """
    checkpoint_dir(points.sparkSession)
    inside = points.join(seeds.select("customer_id").distinct(), "customer_id", "left_semi")
    rest = distinct_points(points.join(inside.select("customer_id"), "customer_id", "left_anti"), k)
    size = points.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("width")).first()
    meeting = Meeting(size["width"] or 0, used_projections(size["n"]))
    rest = rest.select("customer_id", "z").checkpoint()
    leaves = leaves_of(rest, rest.count())
    rest = placed(rest, leaves)
    inside = inside.select(F.col("customer_id").alias("seed_id"), F.col("z").alias("seed_z"))

    near = closest(tiled(placed(inside, leaves, "seed_z"), rest, k, ["leaf"], meeting), k).checkpoint()
    last = F.col("nth") == k
    lost = inside.join(near.where(last), "seed_id", "left_anti")
    if not lost.isEmpty():
        near = near.unionByName(closest(met_in_cells(lost, rest, k, meeting), k).checkpoint())
    looked = inside.join(near.where(last).select("seed_id", F.col("d2").alias("within")), "seed_id")

    ends = [f(F.col("z")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(meeting.width)]
    held = rest.groupBy("leaf").agg(F.count("*").alias("customers"), *ends).toArrow()
    bounds = np.array([held.column(c).to_numpy() for c in held.column_names[2:]]).reshape(2, meeting.width, len(held))
    leaves = leaves.bounded(held.column("leaf").to_numpy(), *bounds.transpose(0, 2, 1))
    far = tiled(looking_around(looked, leaves), rest, k, ["leaf"], meeting)
    return closest(near.drop("nth").unionByName(far), k)


def lookalikes(t: Tables, segment: str = "whale", k: int = NEAREST) -> DataFrame:
    """Customers outside a segment who are among the nearest of its customers.

    ``seeds`` counts the customers of the segment that have them so; ``nearest_seed`` is the closest.
    """
    points, _ = standardised(t)
    audience = t.customers.where(F.col("customer_segment") == segment)
    best = F.min(F.struct("d2", "seed_id"))
    return nearest(points, audience, k).groupBy("customer_id").agg(
        F.count("*").alias("seeds"), best.alias("best")).select(
        "customer_id", "seeds", F.col("best.seed_id").alias("nearest_seed"),
        fixed(F.sqrt("best.d2"), 6).alias("distance"))
