"""Clusters and lookalikes in plain steps: every round and iteration is written out."""

from __future__ import annotations

import math

from marketlens.operators.audiences import (
    BEHAVIOUR, CLUSTERS, HASH_TABLES, ITERATIONS, NEAREST, OVERSAMPLING, PROJECTIONS, SEED,
    SEEDING_ROUNDS, WIDTH, projections,
)
from oracles.base import CTES, rnd

STATEMENTS: dict[str, str] = {}
WIDE = range(1, len(BEHAVIOUR) + 1)


def _d2(a: str, b: str) -> str:
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in WIDE)


def _draw(r: int) -> str:
    return f"('0x' || md5('{SEED}|{r}|' || customer_id)[1:8])::BIGINT / 4294967296.0::DOUBLE"


CTES["feature_moments"] = "SELECT " + ", ".join(
    f"avg({n}::DOUBLE) AS {n}_mean, stddev_pop({n}::DOUBLE) AS {n}_std" for n in BEHAVIOUR) + " FROM features"
CTES["points"] = "SELECT customer_id, [" + ", ".join(
    f"CASE WHEN {n}_std > 0 THEN {rnd(f'({n}::DOUBLE - {n}_mean) / {n}_std', 6)} ELSE 0 END" for n in BEHAVIOUR
) + "] AS z FROM features, feature_moments"


def _clusters() -> str:
    """CTEs up to ``final``: nr, z of the last centres; and ``home``: customer_id, nr, d2."""
    parts = ["p AS MATERIALIZED (SELECT * FROM points)",
             f"kept0 AS MATERIALIZED (SELECT -1 AS r, '' AS id, z FROM p ORDER BY md5('{SEED}|0|' || customer_id) LIMIT 1)"]
    for r in range(1, SEEDING_ROUNDS + 1):
        parts += [
            f"cost{r} AS MATERIALIZED (SELECT customer_id, p.z, min({_d2('p.z', 'k.z')}) AS d2 "
            f"FROM p, kept{r - 1} k GROUP BY ALL)",
            f"kept{r} AS MATERIALIZED (SELECT * FROM kept{r - 1} UNION ALL SELECT {r}, customer_id, z FROM cost{r} "
            f"WHERE {_draw(r)} < d2 * {float(OVERSAMPLING * CLUSTERS)} / (SELECT sum(d2) FROM cost{r}))"]
    parts += [
        f"numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r, id) - 1 AS i, z FROM kept{SEEDING_ROUNDS})",
        f"pull AS (SELECT customer_id, arg_min(i, (d2, i)) AS i FROM (SELECT customer_id, i, {_d2('p.z', 'n.z')} AS d2 "
        "FROM p, numbered n) GROUP BY 1)",
        "places AS MATERIALIZED (SELECT n.i, z, count(customer_id) AS weight FROM numbered n LEFT JOIN pull USING (i) "
        "GROUP BY 1, 2)",
        "chosen1 AS MATERIALIZED (SELECT 0 AS nr, i, z FROM places ORDER BY weight DESC, i LIMIT 1)"]
    for k in range(2, CLUSTERS + 1):
        parts.append(
            f"chosen{k} AS MATERIALIZED (SELECT * FROM chosen{k - 1} UNION ALL SELECT {k - 1}, i, z FROM ("
            f"SELECT s.i, s.z, weight * min({_d2('s.z', 'c.z')}) AS score FROM places s, chosen{k - 1} c "
            "GROUP BY s.i, s.z, weight ORDER BY score DESC, s.i LIMIT 1) WHERE score > 0)")
    parts.append(f"centre0 AS MATERIALIZED (SELECT nr, z FROM chosen{CLUSTERS})")
    for j in range(ITERATIONS + 1):
        parts.append(
            f"home{j} AS MATERIALIZED (SELECT customer_id, z, arg_min(nr, (d2, nr)) AS nr, min(d2) AS d2 FROM ("
            f"SELECT customer_id, p.z, nr, {_d2('p.z', 'c.z')} AS d2 FROM p, centre{j} c) GROUP BY 1, 2)")
        means = ", ".join(rnd(f"avg(z[{i}])", 6) for i in WIDE)
        parts.append(
            f"centre{j + 1} AS MATERIALIZED (SELECT c.nr, coalesce(m.z, c.z) AS z FROM centre{j} c LEFT JOIN "
            f"(SELECT nr, [{means}] AS z FROM home{j} GROUP BY 1) m USING (nr))")
    parts.append(
        "ordered AS (SELECT nr, z, customers, inertia, row_number() OVER (ORDER BY customers DESC, nr) AS cluster FROM ("
        f"SELECT c.nr, c.z, count(customer_id) AS customers, coalesce(sum(d2), 0) AS inertia FROM centre{ITERATIONS} c "
        f"LEFT JOIN home{ITERATIONS} h USING (nr) GROUP BY 1, 2))")
    return "WITH " + ",\n  ".join(parts)


STATEMENTS["behaviour_clusters"] = _clusters() + f"""
  SELECT cluster, customers, {rnd('inertia', 4)} AS inertia, """ + ", ".join(
    f"{rnd(f'{n}_mean + z[{i}] * {n}_std', 4)} AS {n}" for i, n in zip(WIDE, BEHAVIOUR, strict=True)) + """
  FROM ordered, feature_moments"""

STATEMENTS["behaviour_membership"] = _clusters() + f"""
  SELECT customer_id, cluster, {rnd('sqrt(d2)', 6)} AS distance FROM home{ITERATIONS} JOIN ordered USING (nr)"""


def _cells() -> str:
    """One list of cells for each table; projections that are not used are 0."""
    tables = []
    for table in projections(len(BEHAVIOUR)):
        dots = []
        for j, (direction, offset) in enumerate(table):
            dot = " + ".join(f"z[{i}] * ({a})::DOUBLE" for i, a in zip(WIDE, direction, strict=True))
            dots.append(f"CASE WHEN {j} < used THEN floor(({dot} + {offset}::DOUBLE) / {WIDTH}::DOUBLE)::INT ELSE 0 END")
        tables.append("[" + ", ".join(dots) + "]")
    return "[" + ", ".join(tables) + "]"


_SHIFTS = ["[" + ", ".join(["0"] * PROJECTIONS) + "]"] + [
    "[" + ", ".join(str(s if i == j else 0) for i in range(PROJECTIONS)) + "]"
    for j in range(PROJECTIONS) for s in (-1, 1)]

STATEMENTS["lookalikes"] = f"""
  WITH u AS (SELECT least({PROJECTIONS}, greatest(2, 2 + floor(ln(greatest(count(*), 1) / 1000.0) / {math.log(4)})::INT))
      AS used FROM points),
  q AS MATERIALIZED (
    SELECT customer_id, z, customer_segment = 'whale' AS seed, {_cells()} AS cells
    FROM points JOIN customers USING (customer_id), u),
  rest AS MATERIALIZED (
    SELECT customer_id, z, cells FROM q WHERE NOT seed
    QUALIFY row_number() OVER (PARTITION BY z ORDER BY customer_id) <= {NEAREST}),
  own AS (SELECT customer_id, z, t, cells[t] AS cell FROM rest, range(1, {HASH_TABLES + 1}) AS r(t)),
  probes AS (
    SELECT customer_id AS seed_id, z AS seed_z, t,
      list_transform(range(1, {PROJECTIONS + 1}), lambda i: cells[t][i] + s[i]) AS cell
    FROM q, range(1, {HASH_TABLES + 1}) AS r(t), (SELECT unnest([{', '.join(_SHIFTS)}]) AS s) WHERE seed),
  met AS (
    SELECT DISTINCT seed_id, customer_id, {_d2('z', 'seed_z')} AS d2 FROM probes JOIN own USING (t, cell)),
  near AS (
    SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY d2, customer_id) <= {NEAREST})
  SELECT customer_id, count(*) AS seeds, arg_min(seed_id, (d2, seed_id)) AS nearest_seed,
    {rnd('sqrt(min(d2))', 6)} AS distance
  FROM near GROUP BY 1"""
