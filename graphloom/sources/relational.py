"""Relational tables as a property graph: rows, values and foreign keys become nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """A table with its primary key and its foreign keys (column -> referenced table)."""

    name: str
    key: str
    foreign: tuple[tuple[str, str], ...] = ()


#: The star schema of the test tables.
STAR = (
    Table("region", "r_regionkey"),
    Table("nation", "n_nationkey", (("n_regionkey", "region"),)),
    Table("customer", "c_custkey", (("c_nationkey", "nation"),)),
    Table("supplier", "s_suppkey", (("s_nationkey", "nation"),)),
    Table("part", "p_partkey"),
    Table("orders", "o_orderkey", (("o_custkey", "customer"),)),
)


def row_nodes(rows: DataFrame, t: Table) -> DataFrame:
    """(id, type): one node per row, called ``table:key``."""
    return rows.select(F.concat_ws(":", F.lit(t.name), F.col(t.key).cast("string")).alias("id"), F.lit(t.name).alias("type"))


def foreign_edges(rows: DataFrame, t: Table) -> DataFrame | None:
    """(src, dst, relationship): one edge per row and foreign key that isn't null, named by the column."""
    src = F.concat_ws(":", F.lit(t.name), F.col(t.key).cast("string"))
    parts = [
        rows.where(F.col(c).isNotNull()).select(
            src.alias("src"), F.concat_ws(":", F.lit(ref), F.col(c).cast("string")).alias("dst"), F.lit(c).alias("relationship")
        )
        for c, ref in t.foreign
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def value_edges(rows: DataFrame, t: Table, columns: list[str] | None = None) -> DataFrame:
    """(src, dst, relationship) from each row to a node per distinct value of its other columns; keys are left out."""
    keys = {t.key, *(c for c, _ in t.foreign)}
    chosen = columns or [c for c in rows.columns if c not in keys]
    src = F.concat_ws(":", F.lit(t.name), F.col(t.key).cast("string"))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in chosen])
    flat = rows.select(src.alias("src"), F.explode(pairs).alias("p")).where("p.v is not null")
    return flat.select("src", F.concat_ws(":", F.lit(t.name), F.col("p.c"), F.col("p.v")).alias("dst"), F.col("p.c").alias("relationship"))


def schema_rows(tables: dict[str, DataFrame], specs: tuple[Table, ...] = STAR) -> list[tuple[str, str, str, bool, str | None]]:
    """(table, column, type, whether it is the key, referenced table) of every column."""
    out = []
    for t in specs:
        refs = dict(t.foreign)
        for f in tables[t.name].schema.fields:
            out.append((t.name, f.name, f.dataType.simpleString(), f.name == t.key, refs.get(f.name)))
    return out


def qualified(reference: Column, schema: str) -> Column:
    """A referenced table with its schema; one that names a schema itself stays."""
    return F.when(F.contains(reference, F.lit(".")), reference).otherwise(F.concat(F.lit(schema + "."), reference))
