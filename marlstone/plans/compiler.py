"""Compilation of a factor graph to a DataFrame plan.

Row-wise nodes become expressions inside whatever uses them. Window nodes are computed in batches: all that are ready for the present partitioning (by code or by time) share one projection, and a family is exhausted before the other's turn, so the panel is shuffled once per change between code and time, however many operators there are. Kernels that are ready together share one pass over partitions that are sorted by series (or section). Equal subtrees are computed once.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import Rows
from .chunks import in_chunks
from .request import Query
from .sections import in_sections
from .spec import Const, Name, Node, RequestError

KEY = {"TS": "code", "CS": "time"}
#: Kernels run over whole series (sections) of about so many rows together; a longer one is run by itself.
PASS_ROWS = 1 << 16


@dataclass
class Frame:
    """Window specs of one family; rows outside `on` are in partitions of their own."""

    keys: tuple[Column, ...]
    order: tuple[Column, ...]

    def whole(self, *by: Column):
        return W.partitionBy(*self.keys, *by)

    def sorted(self, *order: Column, by: tuple = ()):
        return W.partitionBy(*self.keys, *by).orderBy(*order)

    def series(self, *by: Column):
        return W.partitionBy(*self.keys, *by).orderBy(*self.order)

    def past(self, *by: Column):
        return self.series(*by).rowsBetween(W.unboundedPreceding, W.currentRow)

    def future(self, *by: Column):
        return self.series(*by).rowsBetween(W.currentRow, W.unboundedFollowing)

    def rows(self, n: int):
        return self.series().rowsBetween(-(n - 1), 0)

    def between(self, a: int, b: int):
        return self.series().rowsBetween(a, b)


class Compiler:
    """Adds derivatives to a panel (time, code, factor columns), keyed by (time, code)."""

    def __init__(self, panel: DataFrame, derivatives: dict[str, Node], chunk_rows: int | None = None):
        self.df = panel
        self.chunk_rows = chunk_rows
        self.derivatives = derivatives
        self.columns = set(panel.columns)
        if clash := self.columns & set(derivatives):
            raise RequestError(f"names of both a column and a derivative: {sorted(clash)}")
        self.done: dict[Node, str] = {}
        self.number = itertools.count()

    def fresh(self) -> str:
        while (name := f"__{next(self.number)}") in self.columns:
            pass
        return name

    def resolve(self, x):
        """An operand with names of derivatives replaced by their nodes."""
        if isinstance(x, Name):
            if x.name in self.derivatives:
                return self.resolve(self.derivatives[x.name])
            if x.name not in self.columns:
                raise RequestError(f"no column {x.name!r}")
            return x
        if isinstance(x, Const) or x is None:
            return x
        if x in self.resolved:
            return self.resolved[x]
        fields = tuple(tuple(map(self.resolve, f)) if isinstance(f, tuple) else self.resolve(f) for f in x.fields)
        out = self.resolved[x] = Node(x.op, fields, x.params, self.resolve(x.on))
        return out

    def run(self) -> DataFrame:
        self.resolved: dict[Node, Node] = {}
        roots = {name: self.resolve(node) for name, node in self.derivatives.items()}
        left = []
        for node in roots.values():
            self.collect(node, left, set())
        turn = None
        while left:
            ready = [n for n in left if all(d in self.done for d in self.window_inputs(n))]
            families = {n.op.family for n in ready}
            if turn not in families:
                turn = "TS" if "TS" in families else "CS"
                if not self.chunk_rows:
                    self.df = self.df.repartition(KEY[turn])
            batch = [n for n in ready if n.op.family == turn]
            if self.chunk_rows:
                if turn == "TS":
                    self.kernels(batch, turn)
                else:
                    nodes = [(self.fresh(), n, self.arguments(n), self.mask(n)) for n in batch]
                    self.df = in_sections(self.df, nodes, self.fresh)
                    self.done |= {n: name for name, n, *_ in nodes}
                left = [n for n in left if n not in self.done]
                continue
            self.windows([n for n in batch if not n.op.kernel])
            self.kernels([n for n in batch if n.op.kernel], turn)
            left = [n for n in left if n not in self.done]
        kept = [c for c in self.df.columns if c in self.columns]
        return self.df.select(*[F.col(f"`{c}`") for c in kept], *[self.column(node).alias(name) for name, node in roots.items()])

    def collect(self, node, out: list, seen: set) -> None:
        """Distinct window nodes below node, inner ones first."""
        if not isinstance(node, Node) or node in seen:
            return
        seen.add(node)
        for x in [*node.operands(), node.on]:
            self.collect(x, out, seen)
        if node.op.family != "DIRECT" and node not in out:
            out.append(node)

    def window_inputs(self, node: Node):
        """Window nodes that node's operands need, through row-wise ones."""
        for x in [*node.operands(), node.on]:
            if isinstance(x, Node):
                if x.op.family != "DIRECT":
                    yield x
                else:
                    yield from self.window_inputs(x)

    def column(self, x) -> Column:
        if isinstance(x, Const):
            return F.lit(x.value)
        if isinstance(x, Name):
            return F.col(f"`{x.name}`")
        if x.op.family != "DIRECT":
            return F.col(self.done[x])
        return x.op.build(*self.arguments(x), **dict(x.params))

    def arguments(self, node: Node) -> list:
        return [[self.column(v) for v in f] if isinstance(f, tuple) else self.column(f) for f in node.fields]

    def mask(self, node: Node) -> Column | None:
        return None if node.on is None else F.coalesce(self.column(node.on), F.lit(False))

    def windows(self, nodes: list[Node]) -> None:
        """All nodes in step: each round is one projection; nodes with several stages go on in the next."""
        running, finished = [], {}
        for node in nodes:
            mask = self.mask(node)
            keys = (F.col(KEY[node.op.family]),) if mask is None else (F.col(KEY[node.op.family]), mask)
            frame = Frame(keys, (F.col("time"),) if node.op.family == "TS" else (F.col("code"),))
            args = self.arguments(node)
            if node.op.staged:
                running.append((node, mask, node.op.build(frame, *args, **dict(node.params)), None))
            else:
                finished[node] = node.op.build(frame, *args, **dict(node.params)), mask
        while running or finished:
            made, again = {}, []
            for node, (value, mask) in finished.items():
                self.done[node] = self.fresh()
                made[self.done[node]] = value if mask is None else F.when(mask, value)
            finished = {}
            for node, mask, stages, got in running:
                try:
                    value = stages.send(got)
                    name = self.fresh()
                    made[name] = value
                    again.append((node, mask, stages, F.col(name)))
                except StopIteration as end:
                    finished[node] = end.value, mask
            running = again
            if made:
                self.df = self.df.withColumns(made)

    def kernels(self, nodes: list[Node], family: str) -> None:
        """One pass for all nodes over partitions sorted by key and order. Columns pass through as Arrow arrays; each kernel gets its inputs of a series (section) as arrays, rows outside `on` left out."""
        if not nodes:
            return
        inputs, placed, plans = {}, {}, []

        def put(x) -> str:
            if x not in placed:
                placed[x] = self.fresh()
                inputs[placed[x]] = self.column(x)
            return placed[x]

        for node in nodes:
            self.done[node] = self.fresh()
            fields = [[put(v) for v in f] if isinstance(f, tuple) else put(f) for f in node.fields]
            on = None
            if node.on is not None:
                on = self.fresh()
                inputs[on] = self.mask(node)
            plans.append((self.done[node], node, fields, on, {k: list(v) if isinstance(v, tuple) else v for k, v in node.params}))
        kept = [f for f in self.df.schema.fields]
        names = [f.name for f in kept]
        key, order = KEY[family], "time" if family == "TS" else "code"
        df = self.df.withColumns(inputs)
        schema = T.StructType([*kept, *[T.StructField(p[0], T.DoubleType()) for p in plans]])
        kinds = {f.name: f.dataType for f in df.schema.fields}
        wanted = list(inputs)

        def array(table, name):
            column, kind = table.column(name), kinds[name]
            if isinstance(kind, T.BooleanType):
                column = column.cast(pa.int8())
            elif not isinstance(kind, T.NumericType):
                return column.to_pandas().to_numpy(dtype=object)
            return column.cast(pa.float64()).to_numpy()

        if family == "TS" and self.chunk_rows:
            self.df = in_chunks(df, plans, wanted, self.chunk_rows, array).drop(*wanted)
            return

        def values(columns, fields, rows):
            return [[columns[c][rows] for c in f] if isinstance(f, list) else columns[f][rows] for f in fields]

        def run(batches, ends):
            """The batches as one, a series after another; ends: where each series ends."""
            table = pa.Table.from_batches(batches)
            columns = {c: array(table, c) for c in wanted}
            whole, made = Rows(ends), []
            for _, node, fields, on, params in plans:
                op = node.op
                out = np.full(len(table), np.nan)
                made.append(out)
                inside = slice(None) if on is None else np.nonzero(columns[on] == 1)[0]
                own = whole if on is None else Rows(np.searchsorted(inside, whole.ends))
                if not own.n:
                    continue
                if op.joint:
                    with np.errstate(all="ignore"):
                        out[inside] = op.build(own, *values(columns, fields, inside), **params)
                    continue
                for s, e in zip(own.starts, own.ends):
                    if e > s:
                        rows = slice(s, e) if on is None else inside[s:e]
                        out[rows] = op.build(*values(columns, fields, rows), **params)
            arrays = [pa.array(x, mask=~np.isfinite(x)) for x in made]
            return pa.Table.from_arrays([*[table.column(n) for n in names], *arrays], [*names, *[p[0] for p in plans]]).combine_chunks().to_batches()

        def kernels(batches):
            waiting, held, ends, last = [], 0, [], None  # rows that wait, and where whole series end among them
            for b in batches:
                if not b.num_rows:
                    continue
                codes = b.column(key)
                number = codes.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                if waiting and codes[0].as_py() != last:
                    ends.append(held)
                ends += [held + int(c) for c in np.nonzero(number[1:] != number[:-1])[0] + 1]
                waiting.append(b)
                held += b.num_rows
                last = codes[-1].as_py()
                if ends and ends[-1] >= PASS_ROWS and held - ends[-1] <= b.num_rows:
                    over = held - ends[-1]  # of a series that may go on
                    waiting[-1:], rest = [b.slice(0, b.num_rows - over)], [b.slice(b.num_rows - over)] if over else []
                    yield from run(waiting, ends)
                    waiting, held, ends = rest, over, []
            if waiting:
                yield from run(waiting, [*ends, held])

        # The turn has dealt the panel out by key already, but Spark may drop that for a join's own shuffle and read it otherwise while it runs; a window by key may not be broken up.
        number = self.fresh()
        dealt = df.withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col(number) > 0).drop(number)
        self.df = dealt.sortWithinPartitions(key, order).mapInArrow(kernels, schema)


def add_derivatives(panel: DataFrame, derivatives: dict[str, Node], chunk_rows: int | None = None) -> DataFrame:
    """panel with one column per derivative. chunk_rows: series are dealt in chunks of about so many rows and sections go by grouped aggregates and sorted values, for codes and times with more rows than a task should hold; the panel is then written before each turn."""
    return Compiler(panel, derivatives, chunk_rows).run()


def keep_true(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows on which every named BOOL column is true; NULL is not."""
    for n in names:
        df = df.where(F.coalesce(F.col(f"`{n}`"), F.lit(False)))
    return df


def project(df: DataFrame, query: Query) -> DataFrame:
    """time, code, factors and derivatives, from the start date to the end of the end date; rows of the lookback go."""
    t = F.col("time")
    inside = (t >= F.lit(query.start).cast("timestamp_ntz")) & (t < F.date_add(F.lit(query.end), 1).cast("timestamp_ntz"))
    return df.where(inside).select("time", "code", *[F.col(f"`{c}`") for c in [*query.factors, *query.derivatives]])
