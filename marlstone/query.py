"""Factor queries: a strict request over the long table or a ready panel."""

from __future__ import annotations

import datetime as dt
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.compiler import add_derivatives, keep_true, project
from .plans.request import Query
from .plans.spec import RequestError
from .sources.panel import build_panel


class QueryResult:
    """Lazy views of a query: nothing runs until a DataFrame's action does. Usable in a with block, which drops what was cached."""

    def __init__(self, query: Query, source: DataFrame, chunk_rows: int | None = None):
        self.query, self.source_data, self.chunk_rows = query, source, chunk_rows

    @cached_property
    def computed_data(self) -> DataFrame:
        return add_derivatives(self.source_data, {n: self.query.derivatives[n] for n in self.query.order}, self.chunk_rows)

    @cached_property
    def filtered_data(self) -> DataFrame:
        return keep_true(self.computed_data, self.query.filters)

    @cached_property
    def data(self) -> DataFrame:
        return project(self.filtered_data, self.query)

    def cache(self) -> QueryResult:
        self.source_data.cache()
        return self

    def close(self) -> None:
        self.source_data.unpersist()

    def __enter__(self) -> QueryResult:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


def execute_query(request: Any, long: DataFrame | None = None, panel: DataFrame | None = None, known: set[str] | None = None, codes_query: Any = None, chunk_rows: int | None = None) -> QueryResult:
    """Runs a request over a long table (time, code, factor, value) or a panel (time, code, columns; one row a key).

    codes_query, a request of its own, names the codes first: those of its result, which must be .SH or .SZ. known: factors that exist; others are refused. chunk_rows: a code's rows are dealt in chunks of about so many (plans.chunks), and no section meets in one task (plans.sections); then the panel is written once before each turn, and an operator that needs a whole history or section is refused.
    """
    query = Query.parse(request)
    if (long is None) == (panel is None):
        raise RequestError("give either a long table or a panel")
    needed = query.source_factors()
    if known is not None and (unknown := [f for f in needed if f not in known]):
        raise RequestError(f"unknown factors {unknown}")
    start = query.start - query.lookback if query.lookback else query.start
    if long is not None:
        source = build_panel(long, needed, start, query.end, query.codes)
    else:
        if missing := [f for f in needed if f not in panel.columns]:
            raise RequestError(f"the panel has no columns {missing}")
        t = F.col("time")
        source = panel.select("time", "code", *[F.col(f"`{f}`") for f in needed]).where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(query.end + dt.timedelta(1)).cast("timestamp_ntz")))
        if query.codes:
            source = source.where(F.col("code").isin(query.codes))
    if codes_query is not None:
        chosen = execute_query(codes_query, long, panel, known).data.select("code").distinct()
        chosen = chosen.where(F.col("code").rlike(r"\.(SH|SZ)$"))
        source = source.join(chosen, "code", "left_semi")
    return QueryResult(query, source, chunk_rows)
