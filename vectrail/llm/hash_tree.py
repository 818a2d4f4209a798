"""Placement of keys on a region / rack / shard tree by weighted hash draws.

At each level every child of the chosen node draws ``ln(u) / weight`` with
``u`` in (0, 1) hashed from the key, the seed and the child's path; the largest
draw wins. A draw depends on no other node, so changing one weight moves keys
only into or out of that child, inside its parent's subtree. Hierarchies whose
weights stay as they are keep every key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Topology = Mapping[str, tuple[float, Mapping[str, tuple[float, Mapping[str, float]]]]]

#: region -> (weight, rack -> (weight, shard -> weight))
DEFAULT_TOPOLOGY: Topology = {
    region: (
        weight,
        {f"rack{r}": (1.0 + 0.5 * (r % 2), {f"shard{s}": 1.0 + s % 3 for s in range(8)}) for r in range(racks)},
    )
    for region, weight, racks in (("ap", 1.0, 2), ("eu", 2.0, 4), ("us", 3.0, 6))
}

NULL_KEY = "\\N"
_UNIT = 2.0**52


def _levels(topology: Topology) -> tuple[dict[str, float], dict[str, dict[str, float]], dict[str, dict[str, float]]]:
    regions = {n: float(w) for n, (w, _) in topology.items()}
    racks = {n: {r: float(w) for r, (w, _) in kids.items()} for n, (_, kids) in topology.items()}
    shards = {f"{n}/{r}": {s: float(w) for s, w in leaf.items()} for n, (_, kids) in topology.items() for r, (_, leaf) in kids.items()}
    for place, kids in [("the root", regions), *racks.items(), *shards.items()]:
        if any(w < 0 for w in kids.values()):
            raise ValueError(f"negative weight under {place}")
        if any("/" in n or "|" in n for n in kids):
            raise ValueError(f"'/' and '|' can't be part of a name under {place}")
    alive_racks = {n: {r: w for r, w in kids.items() if w > 0 and any(shards[f"{n}/{r}"].values())} for n, kids in racks.items()}
    regions = {n: w for n, w in regions.items() if w > 0 and alive_racks[n]}
    if not regions:
        raise ValueError("no shard has a positive weight")
    return regions, alive_racks, {p: {s: w for s, w in kids.items() if w > 0} for p, kids in shards.items()}


def _children(nodes: Mapping[str, float], parent: str) -> Column:
    prefix = f"{parent}/" if parent else ""
    return F.array(*[F.struct(F.lit(prefix + n).alias("path"), F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in sorted(nodes.items())])


def _draw(children: Column, key: Column, seed: int) -> Column:
    def one(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), c["path"], F.lit("|"), key).cast("binary")), 1, 13), 16, 10)
        return F.struct((F.log((bits.cast("double") + 0.5) / _UNIT) / c["weight"]).alias("draw"), c["name"].alias("name"))

    return F.array_max(F.transform(children, one))["name"]


def assign(df: DataFrame, topology: Topology = DEFAULT_TOPOLOGY, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """One row per input row: the key column, ``region``, ``rack`` and ``shard``.

    A null key is placed like the literal ``\\N``. Equal keys, so repeated rows
    too, land on the same shard. Only the key is read, so texts, empty or long,
    and extra columns don't matter. Nodes of weight 0, and nodes whose subtree
    holds no positive weight, take no key; a tree without any is a ValueError.
    An empty table gives an empty result.
    """
    regions, racks, shards = _levels(topology)
    k = F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY))
    rack_map = F.create_map(*[x for n in sorted(regions) for x in (F.lit(n), _children(racks[n], n))])
    shard_map = F.create_map(*[x for n in sorted(regions) for r in sorted(racks[n]) for x in (F.lit(f"{n}/{r}"), _children(shards[f"{n}/{r}"], f"{n}/{r}"))])
    one = df.select(F.col(key).alias(key), _draw(_children(regions, ""), k, seed).alias("region"))
    two = one.select(key, "region", _draw(rack_map[F.col("region")], F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY)), seed).alias("rack"))
    place = F.concat_ws("/", F.col("region"), F.col("rack"))
    return two.select(key, "region", "rack", _draw(shard_map[place], F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY)), seed).alias("shard"))


def assign_sql(topology: Topology = DEFAULT_TOPOLOGY, table: str = "documents", key: str = "doc_id", seed: int = 17) -> str:
    """DuckDB SQL for the rows of :func:`assign`."""
    regions, racks, shards = _levels(topology)

    def values(nodes: Mapping[str, float], parent: str) -> list[str]:
        prefix = f"{parent}/" if parent else ""
        return [f"('{parent}', '{prefix + n}', '{n}', {w!r}::DOUBLE)" for n, w in nodes.items()]

    level = {
        "regions": values(regions, ""),
        "racks": [v for n in regions for v in values(racks[n], n)],
        "shards": [v for n in regions for r in racks[n] for v in values(shards[f"{n}/{r}"], f"{n}/{r}")],
    }
    ctes = ", ".join(f"{n}(parent, path, name, weight) AS (VALUES {', '.join(v)})" for n, v in level.items())
    u = f"((('0x' || substr(md5('{seed}|' || t.path || '|' || d.k), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
    pick = f"arg_max(t.name, ln({u}) / t.weight)"
    return f"""WITH {ctes},
d0 AS (SELECT row_number() OVER () AS rid, {key}, coalesce({key}::VARCHAR, '\\N') AS k FROM {table}),
d1 AS (SELECT d.rid, {pick} AS region FROM d0 d CROSS JOIN regions t GROUP BY d.rid),
d2 AS (SELECT d.rid, any_value(d1.region) AS region, {pick} AS rack
       FROM d0 d JOIN d1 USING (rid) JOIN racks t ON t.parent = d1.region GROUP BY d.rid),
d3 AS (SELECT d.rid, any_value(d2.region) AS region, any_value(d2.rack) AS rack, {pick} AS shard
       FROM d0 d JOIN d2 USING (rid) JOIN shards t ON t.parent = d2.region || '/' || d2.rack GROUP BY d.rid)
SELECT d0.{key}, d3.region, d3.rack, d3.shard FROM d3 JOIN d0 USING (rid)"""
