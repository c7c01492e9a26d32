"""Registration of queries beside their DuckDB twins, and the relations that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shared relations of the SQL side; each may use those before it.
RELATIONS = {
    "cells": "SELECT o_custkey AS entity, o_orderkey AS event, o_orderdate AS ts, l_returnflag || l_linestatus AS analyte, sum(l_quantity) AS value, max(l_discount) >= 0.05 AS detected FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "thr": "SELECT * FROM (VALUES ('AF', 40::DOUBLE, 120::DOUBLE), ('AO', 40, 120), ('NF', 40, 120), ('NO', 40, 120), ('RF', NULL, NULL), ('RO', NULL, NULL)) t(analyte, thr, hbwc)",
    "flagged": "SELECT *, (guarded > thr)::INT AS y, (value > thr)::INT AS naive, coalesce(guarded / hbwc, 0) AS hq, coalesce(value / hbwc, 0) AS nhq FROM (SELECT c.*, coalesce(t.thr, 20) AS thr, t.hbwc, CASE WHEN detected THEN value ELSE 0::DOUBLE END AS guarded FROM cells c LEFT JOIN thr t USING (analyte))",
    "targets": "SELECT entity, event, hazard_index, total, (pair_hit = 1 OR round(hazard_index, 9) >= 1)::INT AS t1a, (naive_hit = 1 OR round(naive_index, 9) >= 1)::INT AS t1a_naive, (total > 100)::INT AS t1b, t1c FROM (SELECT entity, event, sum(hq) AS hazard_index, sum(nhq) AS naive_index, sum(value) AS total, max(detected::INT) AS t1c, max(CASE WHEN analyte IN ('AF', 'NO') THEN y ELSE 0 END) AS pair_hit, max(CASE WHEN analyte IN ('AF', 'NO') THEN naive ELSE 0 END) AS naive_hit FROM flagged GROUP BY ALL)",
    "ents": "SELECT c_custkey AS entity, 32.5::DOUBLE + ((c_custkey * 7919) % 9500)::DOUBLE / 1000 AS lat, (-124)::DOUBLE + ((c_custkey * 104729) % 10000)::DOUBLE / 1000 AS lon, c_mktsegment AS segment, c_nationkey AS nation, n_regionkey AS region, round((c_acctbal - lo) / (hi - lo), 6) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)",
    "folds": "SELECT entity, n, ((row_number() OVER (PARTITION BY n, salt ORDER BY entity) - 1 + salt) % 8)::INT AS fold FROM (SELECT entity, count(*) AS n, (((entity % 1000003) * 48285 + 55433) % 1000003) % 64 AS salt FROM targets GROUP BY entity)",
    "scored": "SELECT t.event, t.entity, t.t1a AS y, e.score AS p, f.fold, e.segment, e.nation FROM targets t JOIN ents e USING (entity) JOIN folds f USING (entity)",
    "pairs": "SELECT a.entity AS src, b.entity AS dst, 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS dist_km FROM ents a JOIN ents b ON a.entity <> b.entity AND abs(a.lat - b.lat) < 0.5",
    "pairs_far": "SELECT a.entity AS src, b.entity AS dst, 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS dist_km FROM ents a JOIN ents b ON a.entity <> b.entity AND abs(a.lat - b.lat) < 2.5",
    "near": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist_km, 6), dst) AS place FROM pairs WHERE dist_km <= 40) WHERE place <= 8",
    "edges": "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(dist_km) AS dist_km FROM near GROUP BY ALL",
    "twoway": "SELECT src, dst, dist_km FROM edges UNION ALL SELECT dst, src, dist_km FROM edges",
    "blocks": "SELECT entity, region AS block FROM ents",
    "bysc": "SELECT fold, p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM scored GROUP BY ALL",
}
NEEDS = {"flagged": ("cells", "thr"), "targets": ("flagged",), "folds": ("targets",), "scored": ("targets", "ents", "folds"), "pairs": ("ents",), "pairs_far": ("ents",), "near": ("pairs",), "edges": ("near",), "twoway": ("edges",), "blocks": ("ents",), "bysc": ("scored",)}


def _closure(names: tuple[str, ...]) -> list[str]:
    found: list[str] = []
    for name in names:
        for x in [*_closure(NEEDS.get(name, ())), name]:
            if x not in found:
                found.append(x)
    return found


def query(sql: str | None = None, *uses: str):
    """Register a query under its function's name; ``uses`` are the shared relations of its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            shared = ", ".join(f"{x} AS ({RELATIONS[x]})" for x in _closure(uses))
            ORACLES[f.__name__] = f"WITH {shared} {sql}" if shared else sql
        return f

    return add
