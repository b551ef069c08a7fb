"""Secret scans: three fixed patterns, and sliding-window Shannon entropy over candidate strings.

Only DataFrame functions: every text is scanned where it lies, nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, match_starts, table

# The contract's patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
# The same matches where a greedy run fails or passes as a whole: shorter runs need not be listed first.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"

#: Candidates for the entropy scan: whole runs of the base64 alphabets.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least bits a character of a window, by class. Window entropies are discrete; neither value is one of them.
THRESHOLDS = {"hex": 2.97, "base64": 3.77}
#: Candidates that match a rule's first pattern, and not its second if it has one, are never secrets: words without digits, digits alone, UUIDs and paths of plain words. No pattern repeats a group: java.util.regex goes one call deeper for every repeat and ends the JVM on a long candidate.
ALLOW = (
    (r"^[^0-9]+$", None),
    (r"^[0-9+/_=-]+$", None),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),
    (r"^/?[a-z][a-z/]*/[a-z0-9_-]*$", "//"),
)
#: Filler and counting runs, which random letters may hold by chance: they take out the windows that touch them, never the rest of a candidate.
FILLER = r"(?i)(example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefghij)"
#: Window starts that one chain of incremental counts goes through; chains of a candidate are joined afterwards.
CHAIN = 256
KINDS = ("assign", "access", "hex", "entropy-hex", "entropy-base64")
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, quick: str | None = None, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches of pattern; keep(i) may refuse the i-th."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(
        F.struct(found.alias("m"), F.split(text, pattern, -1).alias("p")),
        lambda s: let(match_starts(s["p"], s["m"]), lambda at: F.transform(s["m"], lambda m, i: F.struct(F.get(at, i).alias("start"), F.lit(kind).alias("kind"), (F.get(at, i) + F.char_length(m)).alias("end")))),
    )
    if keep is not None:
        spans = let(keep, lambda k: F.filter(spans, lambda _, i: F.get(k, i)))
    return F.when(text.rlike(quick or pattern), spans).otherwise(F.array().cast(SPAN))


def entropy_windows(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """Maximal [start, end) stretches of a candidate (letters of CANDIDATE alone) that windows of at least `threshold` bits a character cover.

    Counts of the window's characters, eight bits each and eight to a long, and the sum of c*log2(c) are carried from one window to the next: one character comes in, one goes out. Chains of CHAIN windows bound what a step copies, so the work is linear in the candidate's length.
    """
    if not 0 < window < 256:
        raise ValueError("window must be 1 to 255")
    table_ = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    whole = math.log2(window)
    low, high = ord("+"), ord("z")
    longs = (high - low) // 8 + 1
    lane = lambda code: (code % 8) * 8

    def step(codes, st, at, i):
        into, gone = F.get(codes, at + i), F.when(i >= window, F.get(codes, at + i - window)).otherwise(-1)
        count = lambda code: F.call_function("shiftrightunsigned", F.get(st["n"], F.floor(code / 8).cast("int")), lane(code)).bitwiseAND(F.lit(255).cast("long")).cast("int")
        c_out = F.when(gone >= 0, count(gone)).otherwise(1)
        c_in = count(into) - F.when(into == gone, 1).otherwise(0)
        total = st["s"] + F.get(table_, c_out - 1) - F.get(table_, c_out) + F.get(table_, c_in + 1) - F.get(table_, c_in)
        bit = lambda code, k: F.when(F.floor(code / 8).cast("int") == k, F.call_function("shiftleft", F.lit(1).cast("long"), lane(code))).otherwise(F.lit(0).cast("long"))
        counts = F.transform(st["n"], lambda v, k: v + bit(into, k) - F.when(gone >= 0, bit(gone, k)).otherwise(F.lit(0).cast("long")))
        first = at + i - window + 1

        def grow(total):
            hot = (i >= window - 1) & (F.lit(whole) - total / window >= threshold)
            last = F.element_at(st["out"], -1)
            joined = F.concat(F.slice(st["out"], F.lit(1), F.size(st["out"]) - 1), F.array(F.struct(last["a"].alias("a"), (first + window).alias("b"))))
            fresh = F.concat(st["out"], F.array(F.struct(first.alias("a"), (first + window).alias("b"))))
            out = F.when(~hot, st["out"]).when((F.size(st["out"]) > 0) & (F.get(st["out"], F.size(st["out"]) - 1)["b"] >= first), joined).otherwise(fresh)
            return F.struct(counts.alias("n"), total.alias("s"), out.alias("out"))

        return let(total, grow)

    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("s"), none.alias("out"))
    chain = lambda c, at: F.aggregate(F.sequence(F.lit(0), F.least(F.lit(CHAIN + window - 2), F.size(c) - 1 - at)), start, lambda st, i: step(c, st, at, i), lambda st: st["out"])
    chains = lambda c: F.when(F.size(c) >= window, F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - window, F.lit(CHAIN)), lambda at: chain(c, at)))).otherwise(none)

    def merged(runs):
        # Ends grow with starts, so a stretch begins where the run before ended earlier, and ends where the next begins later.
        begins = F.filter(runs, lambda r, i: (i == 0) | (F.get(runs, i - 1)["b"] < r["a"]))
        ends = F.filter(runs, lambda r, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["a"] > r["b"]))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))

    return let(let(F.transform(F.split(candidate, ""), lambda x: F.ascii(x) - low), chains), merged)


def _entropy_spans(text: Column, window: int, thresholds: dict, allow: tuple, filler: str) -> Column:
    none = F.array().cast(SPAN)

    def of(candidate, at):
        is_hex = candidate.rlike("^[0-9a-fA-F]+$")
        limit = F.when(is_hex, F.lit(thresholds["hex"])).otherwise(F.lit(thresholds["base64"]))
        listed = F.lit(False)
        for rule, unless in allow:
            listed = listed | (candidate.rlike(rule) & ~candidate.rlike(unless) if unless else candidate.rlike(rule))
        kind = F.when(is_hex, 3).otherwise(4)
        # Limit and kind are worked out once a candidate, not at every step.
        cut = F.struct(limit.alias("limit"), kind.alias("kind"), F.split(candidate, filler, -1).alias("p"), F.regexp_extract_all(candidate, F.lit(filler), F.lit(0)).alias("m"))

        def between(x):
            """Stretches of the pieces that filler leaves."""

            def placed(starts):
                begin = lambda i: at + F.when(i > 0, F.get(starts, i - 1) + F.char_length(F.get(x["m"], i - 1))).otherwise(0)
                stretch = lambda piece, i: let(begin(i), lambda b: F.transform(entropy_windows(piece, x["limit"], window), lambda r: F.struct((b + r["a"]).alias("start"), x["kind"].alias("kind"), (b + r["b"]).alias("end"))))
                return F.flatten(F.transform(x["p"], stretch))

            return let(match_starts(x["p"], x["m"]), placed)

        runs = let(cut, between)
        return F.when(listed, none).otherwise(runs)

    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    spans = let(
        F.struct(found.alias("m"), F.split(text, CANDIDATE, -1).alias("p")),
        lambda s: let(match_starts(s["p"], s["m"]), lambda at: F.flatten(F.transform(s["m"], lambda m, i: of(m, F.get(at, i))))),
    )
    # The first two rules ask for a letter and a digit; texts without such a candidate are not taken apart.
    return F.when(F.exists(found, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")), spans).otherwise(none)


def scan_secrets(docs: DataFrame, text: str = "text", window: int = WINDOW, thresholds: dict = THRESHOLDS, allow: tuple = ALLOW, filler: str = FILLER) -> DataFrame:
    """docs with a column `secret_spans`: array of (start, kind, end), code points, end exclusive, by start and kind.

    kind numbers KINDS: the three base patterns, then high-entropy stretches of hex and base64 candidates. A null text is empty; other columns stay as they are, but for one named secret_spans, which is replaced. Nulls, ties and repeated rows need no rule: each row is scanned by itself.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda v: F.char_length(v) >= MIN_ASSIGN)
    spans = F.concat(
        _spans(t, ASSIGN, 0, quick=r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", keep=long_enough),
        _spans(t, ACCESS_LONG, 1),
        _spans(t, HEX_LONG, 2),
        _entropy_spans(t, window, thresholds, allow, filler),
    )
    return docs.withColumn("secret_spans", F.sort_array(spans))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("secret_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.filter(s, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
        (count(3) + count(4)).alias("n_entropy"),
    )


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def kind(name: str, number: int, pattern: str, good: str = "true") -> str:
        return f"""{name} as (
  select doc_id, {number} as kind, starts[i] as a, starts[i] + length(m[i]) as b
  from (select *, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)) as starts
        from (select doc_id, regexp_extract_all(t, {q(pattern)}) as m, string_split_regex(t, {q(pattern)}) as p, regexp_extract_all(t, {q(ASSIGN)}, 1) as g from docs where regexp_matches(t, {q(pattern)}))), unnest(range(1, len(m) + 1)) as u(i)
  where {good})"""

    # No look-behind here: a run of the alphabet is taken whole, its length judged after.
    run = r"[A-Za-z0-9+/_=-]+"
    allow = " or ".join(f"regexp_matches(c, {q(rule)})" + (f" and not regexp_matches(c, {q(unless)})" if unless else "") for rule, unless in ALLOW)
    return f"""with docs as (select doc_id, coalesce(text, '') as t from documents),
{kind("assigned", 0, ASSIGN, f"length(g[i]) >= {MIN_ASSIGN}")},
{kind("access", 1, ACCESS, f"length(m[i]) >= {MIN_ACCESS}")},
{kind("hexes", 2, HEX_LONG)},
{kind("runs", 9, run, f"length(m[i]) >= {WINDOW} and regexp_matches(m[i], '[0-9]')").replace("starts[i] as a, starts[i] + length(m[i]) as b", "starts[i] as ra, m[i] as c", 1)},
cut as (select doc_id, ra, c, regexp_matches(c, '^[0-9a-fA-F]+$') as is_hex, string_split_regex(c, {q(FILLER)}) as p, regexp_extract_all(c, {q(FILLER)}) as m from runs where not ({allow})),
pieces as (
  select doc_id, ra + coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as ra, p[i] as c, is_hex
  from cut, unnest(range(1, len(p) + 1)) as u(i)),
wins as (select doc_id, ra, c, is_hex, w, substr(c, w::int, {WINDOW}) as s from pieces, unnest(range(1, length(c) - {WINDOW} + 2)) as u(w)),
hot as (
  select doc_id, ra, c, is_hex, w from (
    select *, -list_sum(list_transform(list_distinct(string_split(s, '')), lambda x: (len(list_filter(string_split(s, ''), lambda y: y = x)) / {WINDOW}.0) * log2(len(list_filter(string_split(s, ''), lambda y: y = x)) / {WINDOW}.0))) as h from wins)
  where h >= case when is_hex then {THRESHOLDS["hex"]} else {THRESHOLDS["base64"]} end),
isles as (
  select *, sum(case when w - before <= {WINDOW} then 0 else 1 end) over (partition by doc_id, ra order by w) as isle
  from (select *, lag(w) over (partition by doc_id, ra order by w) as before from hot)),
entropy as (
  select doc_id, case when is_hex then 3 else 4 end as kind, ra + min(w) - 1 as a, ra + max(w) - 1 + {WINDOW} as b from isles group by doc_id, ra, is_hex, isle),
every as (select doc_id, kind, a, b from assigned union all select doc_id, kind, a, b from access union all select doc_id, kind, a, b from hexes union all select * from entropy),
said as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind > 2) as n_entropy,
    string_agg(k[kind + 1] || ':' || a::bigint || ':' || b::bigint, ',' order by a, kind) filter (kind < 3) as base, string_agg(k[kind + 1] || ':' || a::bigint || ':' || b::bigint, ',' order by a, kind) as spans
  from (select *, [{", ".join(map(q, KINDS))}] as k from every) group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0) as n_entropy
from docs left join said using (doc_id)"""


SQL = {"op1_secret_scan": _sql()}
