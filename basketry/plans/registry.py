"""Named queries, each a function of a workspace, with the SQL that an independent engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from basketry.plans.oracle import with_half_even
from basketry.plans.workspace import Workspace

Product = Callable[[Workspace], DataFrame]

QUERIES: dict[str, Product] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Product], Product]:
    def keep(product: Product) -> Product:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = product
        if oracle is not None:
            ORACLES[name] = with_half_even(oracle)
        return product

    return keep
