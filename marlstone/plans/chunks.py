"""Long series in chunks: operators over a code's rows where one code may hold more rows than a task should.

The panel is range-sorted by code and time into parts of about equal size, written, and each part is a chunk, so a code with half of all rows is half of the chunks. Windows of bounded reach get the rows they need from the chunks before as a halo. Recurrences are scans: each chunk reports the map of its last series, the maps of a code's chunks are composed in order (a few numbers for each chunk meet in the driver), and the next pass begins each chunk with its value. A recurrence of r rounds takes r + 1 passes, in which all nodes share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scan
from ..functions.windows import Rows
from ..sources.shared import written
from .spec import Node, RequestError

#: Parameters that say how many rows back an operator looks.
REACH = ("window", "time_period", "period1", "period2", "period3", "periods")

#: Rows of a finished chunk that are handed on at a time.
OUT_ROWS = 1 << 15


def reach(node: Node) -> int | None:
    """Rows before a row that its value depends on at most; None if all of them."""
    given = [v for k, v in node.params if k in REACH and v is not None]
    return max(given) + 1 if given and min(given) > 0 else None


def plan_of(node: Node):
    """("scan" or "halo", the form of the operator for chunks)."""
    op = node.op
    if op.scan is not None:
        return "scan", op.scan
    form = op.chunk or (op.build if op.joint else None)
    if form is None or reach(node) is None:
        raise RequestError(f"{op.name} needs a code's whole history: run it without chunk_rows")
    if node.on is not None:
        raise RequestError(f"{op.name} with a condition reaches back an unknown number of rows: run it without chunk_rows")
    return "halo", form


def _parts(df: DataFrame, chunk_rows: int) -> tuple[DataFrame, int]:
    """df written in parts by code and time, with _part and _row, the row's place within all parts."""
    n = max(1, -(-df.count() // chunk_rows))
    placed = df.repartitionByRange(n, "code", "time").sortWithinPartitions("code", "time").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    return df.sparkSession.read.schema(placed.schema).parquet(written(placed, "chunks")), n


def _pieces(placed: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """For each code in more than one part its pieces (part, first row, rows), in order. One row a part comes to the driver, and two for each that a code goes across."""
    ends = placed.groupBy("_part").agg(F.min_by("code", "_row").alias("a"), F.max_by("code", "_row").alias("z")).collect()
    ends = sorted((r["_part"], r["a"], r["z"]) for r in ends)
    split = {z for (_, _, z), (_, a, _) in zip(ends, ends[1:]) if z == a}
    if not split:
        return {}
    spark = placed.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(c,) for c in sorted(split)], T.StructType([placed.schema["code"]])))
    out: dict[str, list] = {}
    for r in placed.join(chosen, "code", "left_semi").groupBy("code", "_part").agg(F.min("_row").alias("first"), F.count("*").alias("n")).collect():
        out.setdefault(r["code"], []).append((r["_part"], r["first"], r["n"]))
    return {c: sorted(p) for c, p in out.items()}


def _with_halo(placed: DataFrame, pieces: dict, far: int) -> DataFrame:
    """placed with _chunk and _halo: each row in its own chunk, and those among the `far` rows before a later piece of their code in that chunk too."""
    copies = []
    for code, parts in pieces.items():
        for i, (part, first, n) in enumerate(parts):
            left, j = far, i + 1
            while left > 0 and j < len(parts):
                copies.append((code, part, parts[j][0], first + max(0, n - left)))
                left -= parts[j][2]
                j += 1
    own = placed.withColumns({"_chunk": F.col("_part"), "_halo": F.lit(False)})
    if not copies:
        return own
    schema = T.StructType([placed.schema["code"], *T.StructType.fromDDL("_part int, _chunk int, _from long").fields])
    wanted = F.broadcast(placed.sparkSession.createDataFrame(copies, schema))
    halo = placed.join(wanted, ["code", "_part"]).where("_row >= _from").withColumn("_halo", F.lit(True))
    return own.unionByName(halo.select(*own.columns))


def _starts(maps: dict, pieces: dict, empties: list) -> dict[tuple[int, int], float]:
    """(part, scan) -> the value that the part's first series, a later piece of its code, begins with. maps: (part, scan) -> (a, b) of the part's last series."""
    out = {}
    for parts in pieces.values():
        for s, empty in enumerate(empties):
            value = empty
            for i, (part, _, _) in enumerate(parts):
                if i:
                    out[part, s] = value
                a, b = maps[part, s]  # not used for the last piece, after which another series may stand
                value = max(value, b) if empty == -np.inf else a * value + b
    return out


def in_chunks(df: DataFrame, nodes: list[tuple], wanted: list[str], chunk_rows: int, array) -> DataFrame:
    """df with a column for each node. nodes: (column to make, node, its fields by column, its condition's column or None, parameters); wanted: the input columns; array(table, name): one as numbers."""
    forms = [plan_of(n) for _, n, *_ in nodes]
    placed, n_parts = _parts(df, chunk_rows)
    pieces = _pieces(placed)
    far = max([reach(n) for (_, n, *_), (kind, _) in zip(nodes, forms) if kind == "halo"], default=0)
    dealt = _with_halo(placed, pieces, far).repartitionById(n_parts, "_chunk").sortWithinPartitions("code", "time")
    later = {part for p in pieces.values() for part, _, _ in p[1:]}  # parts whose first series goes on from the part before

    def fields_of(columns, fields, rows):
        return [[columns[c][rows] for c in f] if isinstance(f, list) else columns[f][rows] for f in fields]

    def recurrence(k, columns, inside):
        _, _, fields, _, params = nodes[k]
        return forms[k][1](*fields_of(columns, fields, inside), **params)

    def series(columns, halo, ends, on):
        """(rows of a scan, which rows they are): the halo left out, and rows outside the condition."""
        good = ~halo if on is None else ~halo & (columns[on] == 1)
        inside = np.nonzero(good)[0]
        return Rows(np.searchsorted(inside, ends)), inside

    def solved(rows, gen, known, part):
        """Runs gen as far as known values reach: what it asks for then, or its result."""
        try:
            asked = next(gen)
            for starts in known:
                begin = [np.full(len(rows.ends), scan._empty(s)) for s in asked]
                if part in later:
                    for b, i in zip(begin, range(len(asked))):
                        b[0] = starts[part, i]
                asked = gen.send([scan.solve(rows, s, b) for s, b in zip(asked, begin)])
        except StopIteration as end:
            return None, end.value
        return asked, None

    def whole(batches):
        table = pa.Table.from_batches(batches)
        code = table.column("code").combine_chunks()
        number = pc.fill_null(code.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        ends = np.append(np.nonzero(number[1:] != number[:-1])[0] + 1, len(number))
        return table, {c: array(table, c) for c in wanted}, table.column("_halo").to_numpy(), ends, int(table.column("_chunk")[0].as_py())

    def report(known):
        def of(batches):
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            _, columns, halo, ends, part = whole(batches)
            out = []
            for k, (kind, _) in enumerate(forms):
                if kind == "scan":
                    rows, inside = series(columns, halo, ends, nodes[k][3])
                    with np.errstate(all="ignore"):
                        asked, _ = solved(rows, recurrence(k, columns, inside), known[k], part)
                        for i, s in enumerate(asked or ()):
                            a, b = scan.total(rows, s, len(rows.ends) - 1)
                            out.append((k, i, part, a, b, s[0] is scan.MAX))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names)

        names, kinds = ["node", "scan", "part", "a", "b", "most"], [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
        return of

    known: list[list] = [[] for _ in nodes]
    while pieces:
        maps: dict[int, dict] = {}
        empties: dict[int, dict] = {}
        for r in dealt.mapInArrow(report(known), "node int, scan int, part int, a double, b double, most boolean").where(F.col("part").isin(sorted({p for x in pieces.values() for p, _, _ in x}))).collect():
            maps.setdefault(r["node"], {})[r["part"], r["scan"]] = (r["a"], r["b"])
            empties.setdefault(r["node"], {})[r["scan"]] = -np.inf if r["most"] else 0.0
        if not maps:
            break
        for k, found in maps.items():
            known[k].append(_starts(found, pieces, [e for _, e in sorted(empties[k].items())]))

    kept = [f.name for f in df.schema.fields]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n[0], T.DoubleType()) for n in nodes]])

    def finish(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table, columns, halo, ends, part = whole(batches)
        every, made = Rows(ends), []
        for k, (kind, form) in enumerate(forms):
            _, _, fields, on, params = nodes[k]
            out = np.full(len(table), np.nan)
            with np.errstate(all="ignore"):
                if kind == "halo":
                    out[:] = form(every, *fields_of(columns, fields, slice(None)), **params)
                else:
                    rows, inside = series(columns, halo, ends, on)
                    gen = recurrence(k, columns, inside)
                    out[inside] = solved(rows, gen, known[k], part)[1] if known[k] else scan.run(rows, gen)
            made.append(pa.array(out, mask=~np.isfinite(out)))
        got, own = pa.Table.from_arrays([*[table.column(c) for c in kept], *made], schema.names), pa.array(~halo)
        del table, columns, every, made
        for at in range(0, len(got), OUT_ROWS):  # a second copy of the whole chunk would be half of the task's memory
            yield from got.slice(at, OUT_ROWS).filter(own.slice(at, OUT_ROWS)).combine_chunks().to_batches()

    return dealt.mapInArrow(finish, schema)
