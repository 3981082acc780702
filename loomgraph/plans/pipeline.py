"""Pipelines: ordered transform steps and a DAG compiled to one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import iso_date
from ..operators import nested, profile

STEPS: dict[str, Callable[..., DataFrame]] = {
    "trim": lambda df: profile.trimmed(df),
    "drop_null": lambda df, columns=None: profile.drop_blank_rows(df, columns),
    "fill_empty": lambda df, columns=None: profile.fill_blank(df, columns),
    "mark_null": lambda df, columns=None: profile.mark_blank(df, columns),
    "deduplicate": lambda df, columns=None: df.dropDuplicates(columns) if columns else df.distinct(),
    "normalize_dates": lambda df, columns, compat=False: df.withColumns({c: iso_date(c, compat) for c in columns}),
    "rename_columns": lambda df, names: df.withColumnsRenamed(names),
    "select_columns": lambda df, columns: df.select(*columns),
    "filter_rows": lambda df, where: df.where(where),
    "sort": lambda df, by: df.orderBy(*by),
    "join": lambda df, other, on, how="inner": df.join(other, on, how),
    "aggregate": lambda df, by, aggs: df.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in aggs.items()]),
    "group_by": lambda df, by: df.groupBy(*by).agg(F.count("*").alias("count")),
    "pivot": lambda df, by, on, values, agg: df.groupBy(*by).pivot(on, values).agg(F.expr(agg)),
    "flatten": lambda df, sep=".", max_depth=10: nested.flatten(df, sep, max_depth),
    "explode": lambda df, sep=".", array=None: nested.explode_first_array(df, sep, array),
    "limit": lambda df, n: df.limit(n),
}


def compiled(steps: list[dict]) -> Callable[[DataFrame], DataFrame]:
    """Steps ``{"op": name, ...arguments}`` as one function, applied in their order; an unknown one is an error."""
    unknown = [s["op"] for s in steps if s["op"] not in STEPS]
    if unknown:
        raise ValueError("unknown steps: " + ", ".join(unknown))

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(lambda d, s=s: STEPS[s["op"]](d, **{k: v for k, v in s.items() if k != "op"}))
        return df

    return run


@dataclass
class Dag:
    """Nodes ``id: {"kind": connector|transform|output, ...}`` and edges; compiled in topological order."""

    nodes: dict[str, dict]
    edges: list[tuple[str, str]] = field(default_factory=list)

    def order(self) -> list[str]:
        into = {n: {a for a, b in self.edges if b == n} for n in self.nodes}
        out: list[str] = []
        while ready := sorted(n for n, need in into.items() if n not in out and need <= {*out}):
            out += ready
        if len(out) < len(self.nodes):
            raise ValueError("cycle among " + ", ".join(sorted({*self.nodes} - {*out})))
        return out

    def run(self, load: Callable[[dict], DataFrame]) -> dict[str, DataFrame]:
        """Outputs by node, as lazy plans; several inputs of a node are united by name."""
        done: dict[str, DataFrame] = {}
        for n in self.order():
            node, ins = self.nodes[n], [done[a] for a, b in self.edges if b == n]
            if node["kind"] == "connector":
                done[n] = load(node)
                continue
            df = ins[0]
            for x in ins[1:]:
                df = df.unionByName(x, allowMissingColumns=True)
            done[n] = compiled(node.get("steps", []))(df)
        return {n: done[n] for n, v in self.nodes.items() if v["kind"] == "output"}


def merged(base: dict, over: dict) -> dict:
    """Dictionaries merged in depth; the later wins."""
    return {k: merged(base[k], over[k]) if k in base and k in over and isinstance(base[k], dict) and isinstance(over[k], dict) else over.get(k, base.get(k)) for k in [*base, *[k for k in over if k not in base]]}
