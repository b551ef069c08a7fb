"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling; LCP intervals give maximal repeated line runs, and later copies go.

Lines are named by 128-bit hashes. A line that stands nowhere else can't begin or continue a repeated run, so it leaves before any sorting: only suffixes that begin with repeated lines are ranked. Ranks come from distinct (rank, next rank) pairs, pre-aggregated and range-sorted with distributed prefix sums, so a line that a third of all documents hold is one row there. Depth doubles until no two suffixes agree further; suffixes that agree with no other leave, so the rounds shrink. The interval of a suffix at its greatest depth names the earliest copy, and both sequences, compared line by line from there, give the whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, ordered_sums, saved, table

#: A run is at least so many consecutive lines of a document; a line of at least MIN_CHARS characters is one by itself.
MIN_LINES, MIN_CHARS = 2, 40

KEY = ["d", "h"]


def _lines(text):
    """Array of (x, at): the lines that are not blank, at counts all lines."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("at"))), lambda s: F.trim(s["x"]) != "")


def _ids(x):
    return [F.xxhash64(x).alias("id1"), F.xxhash64(F.lit(1), x).alias("id2")]


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, h, line, at, id1, id2, chars): the lines of every text that are not blank; line numbers them, `at` counts all lines. d and h tell documents apart: the id (null: the largest long) and a hash of the text."""
    own = _keyed(docs, doc_id, text)
    return own.select(*KEY, F.posexplode(_lines(F.col("t"))).alias("line", "s")).select(*KEY, "line", F.col("s.at").alias("at"), *_ids(F.col("s.x")), F.char_length("s.x").alias("chars"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(t).alias("h"), t.alias("t"))


def suffix_ranks(keys: DataFrame, cols: list[str]) -> DataFrame:
    """keys (distinct cols, n) with `place`: 1 + the members of all smaller keys, which is their place in the suffix array, from the partition sums of a range sort."""
    return ordered_sums(keys, cols, ["n"], "op10-order").select(*cols, (F.col("_before_n") + 1).alias("place"))


def repeated_suffixes(lines: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """The suffix array level by level: (depth, rows) with rows d, h, line, chars, place, first (the earliest suffix of the interval: struct d, h, line).

    place is the start of the LCP interval in the suffix array, equal for suffixes that agree in their first `depth` lines; suffixes that agree so far with no other are left out. Depths are 1, min_lines and its doubles, until no two suffixes agree: as many as the logarithm of the longest repeated run, each written.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    names = lines.groupBy("id1", "id2").agg(F.count("*").alias("n")).where("n > 1")
    now = lines.join(suffix_ranks(names, ["id1", "id2"]), ["id1", "id2"])
    now = now.groupBy(*KEY, "line").agg(F.first("chars").alias("chars"), F.first("place").alias("place"))  # repeated rows are one document
    depth, levels = 1, []
    while True:
        now = saved(now, f"op10-depth{depth}", narrow=True)
        if depth == 1 or depth >= min_lines:
            # Written, so that the join has plain exchanges on both sides and a hot line's partition can be split.
            interval = saved(now.groupBy("place").agg(F.min(F.struct(*KEY, "line")).alias("first")), "op10-intervals", narrow=True)
            levels.append((depth, now.join(interval, "place")))
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        # The suffix `step` lines on has the rank of the second half; where it was dropped or lies past the end, the run can't reach this depth.
        on = W.partitionBy(*KEY).orderBy("line").rangeBetween(step, step)
        pairs = now.withColumn("next", F.first("place").over(on)).where("next is not null")
        keys = pairs.groupBy("place", "next").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("place", "half")
        deeper = suffix_ranks(keys, ["half", "next"])
        if deeper.isEmpty():
            return levels
        now = pairs.withColumnRenamed("place", "half").join(deeper, ["half", "next"]).select(*KEY, "line", "chars", "place")
        depth += step


def later_suffixes(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """d, h, line, chars, depth, first of the suffixes that begin as an earlier one does: the greatest depth at which one does, and such an earlier one: the last before it in the same document, or else the earliest of all. So a block that a document repeats is the copy of the block before it, all at one distance."""
    before = F.lag("line").over(W.partitionBy("place", *KEY).orderBy("line"))
    parts = [t.withColumn("_near", before).where(F.struct(*KEY, "line") != F.col("first")).select(*KEY, "line", "chars", F.lit(depth).alias("depth"), F.when(F.col("_near").isNotNull(), F.struct(*KEY, F.col("_near").alias("line"))).otherwise(F.col("first")).alias("first")) for depth, t in levels]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy(*KEY, "line").agg(F.first("chars").alias("chars"), F.max(F.struct("depth", "first")).alias("_b")).select(*KEY, "line", "chars", "_b.depth", "_b.first")


def later_stretches(later: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """d, h, line, n_lines: the maximal stretches of lines that later runs of at least min_lines lines cover, each line in one. Every line of such a run lies in the first lines of a suffix of that depth, so the suffixes' own intervals, merged by their greatest end so far, are all of it."""
    order = W.partitionBy(*KEY).orderBy("line")
    spans = later.where(F.col("depth") >= min_lines).select(*KEY, "line", (F.col("line") + F.col("depth")).alias("end"))
    spans = spans.withColumn("_upto", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("_stretch", F.sum(F.when(F.col("line") <= F.col("_upto"), 0).otherwise(1)).over(order))
    return spans.groupBy(*KEY, "_stretch").agg(F.min("line").alias("line"), F.max("end").alias("_end")).select(*KEY, "line", (F.col("_end") - F.col("line")).cast("long").alias("n_lines"))


def later_runs(later: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeated runs that are later copies: d, h, line, n_lines, and the earlier copy's d, h, line as first_d, first_h, first_line.

    For reports; the deletion needs the stretches alone. A run begins where the line before doesn't continue the same copy, and goes on as long as both texts agree: less than twice its suffix's depth, for else an interval of that depth would hold it.
    """
    later = later.select(*KEY, "line", "depth", F.col("first.d").alias("first_d"), F.col("first.h").alias("first_h"), F.col("first.line").alias("first_line"))
    same = W.partitionBy(*KEY, "first_d", "first_h", F.col("line") - F.col("first_line")).orderBy("line")
    heads = saved(later.withColumn("_before", F.lag("line").over(same)).where("_before is null or _before < line - 1").drop("_before"), "op10-heads", narrow=True)
    ids = _keyed(docs, doc_id, text).select(*KEY, F.transform(_lines(F.col("t")), lambda s: F.struct(*_ids(s["x"]))).alias("ids")).dropDuplicates(KEY)
    ids = saved(ids.join(heads.select(*KEY).union(heads.select("first_d", "first_h")).distinct(), KEY, "left_semi"), "op10-ids", narrow=True)
    mine = heads.join(ids, KEY).withColumn("_a", F.slice("ids", F.col("line") + 1, F.col("depth") * 2)).drop("ids")
    theirs = ids.select(F.col("d").alias("first_d"), F.col("h").alias("first_h"), "ids")
    both = mine.join(theirs, ["first_d", "first_h"]).withColumn("_b", F.slice("ids", F.col("first_line") + 1, F.col("depth") * 2))
    differ = F.array_position(F.zip_with("_a", "_b", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    n = F.when(differ > 0, differ - 1).otherwise(F.size("_a")).cast("long")
    return both.select(*KEY, "line", n.alias("n_lines"), "first_d", "first_h", "first_line")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the later copies of repeated line runs cut from text, and columns n_lines, n_removed (long) added or replaced.

    A line goes if it lies in a run of at least min_lines consecutive lines, or has at least min_chars characters itself, of which a copy stands earlier, in a document of smaller doc_id (null last) or further up in the same one; so the first copy always stays. Blank lines belong to no run, are skipped between the lines of one and stay. Rows that share doc_id and text are one document: none is a copy of the other. A null text has no lines and stays null; a text whose lines all go becomes empty. Other columns are kept.
    """
    lines = line_table(docs, doc_id, text)
    later = saved(later_suffixes(repeated_suffixes(lines, min_lines)), "op10-later", narrow=True)
    covered = later_stretches(later, min_lines).select(*KEY, F.explode(F.sequence(F.col("line"), (F.col("line") + F.col("n_lines") - 1).cast("int"))).alias("line"))
    covered = covered.union(later.where(F.col("chars") >= min_chars).select(*KEY, "line")).distinct()
    gone = lines.select(*KEY, "line", "at").join(covered, [*KEY, "line"]).groupBy(*KEY).agg(F.collect_set("at").alias("_gone"))
    gone = saved(gone.select(F.col("d").alias("_d"), F.col("h").alias("_h"), "_gone"), "op10-gone", narrow=True)
    kept_as = docs.drop("n_lines", "n_removed", "_d", "_h", "_gone")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = kept_as.join(gone, (F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)) == F.col("_d")) & (F.xxhash64(t) == F.col("_h")), "left")
    pieces = F.split(F.col(text), "\n", -1)
    left = let(pieces, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone")), lambda i: F.get(ls, i)))
    rows = rows.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(pieces, lambda x: F.trim(x) != ""))).cast("long"))
    rows = rows.withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    return rows.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).drop("_d", "_h", "_gone")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = {
    "op10_line_dedup": f"""with raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
ls as (select *, row_number() over (partition by doc_id order by pos) as line from raw where trim(x) <> ''),
wins as (select doc_id, line, string_agg(x, chr(10)) over w as win, count(*) over w as n from ls window w as (partition by doc_id order by line rows between current row and {MIN_LINES - 1} following)),
later as (select doc_id, line from (select doc_id, line, row_number() over (partition by win order by doc_id, line) as copy from wins where n = {MIN_LINES}) where copy > 1),
alone as (select doc_id, line from (select doc_id, line, x, row_number() over (partition by x order by doc_id, line) as copy from ls) where copy > 1 and length(x) >= {MIN_CHARS}),
gone as (select doc_id, line + k as line from later, unnest(range({MIN_LINES})) as u(k) union select doc_id, line from alone),
marked as (select raw.doc_id, raw.pos, raw.x, ls.line, gone.line is not null as gone from raw left join ls using (doc_id, pos) left join gone on gone.doc_id = ls.doc_id and gone.line = ls.line)
select doc_id, count(line) as n_lines, count(*) filter (gone) as n_removed, sha256(coalesce(string_agg(x, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from marked group by doc_id"""
}
