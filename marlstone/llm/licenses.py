"""License scans: word k-grams of every document are joined to template positions and vote on diagonals.

Only DataFrame functions. The template side is fixed text in this module (a few hundred grams), so it is broadcast. A bitmap of the template hashes goes before the join, so of a document only grams that can meet a template, with their own words, become rows; they are probed where the document lies, and only hits are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SEPARATORS, ascii_lower, let, plain_words, row_keys, running_sums, table

# The contract's phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Public license notices, by label; a label may have several.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced without permission"),
)
GRAM, SLACK, MIN_COVER = 3, 2, 0.75
#: Bits of the bitmap of template hashes: 64 to a long.
BITMAP = 1 << 16


def _words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def _templates(templates, k: int):
    """(template, label, grams of it) and (template, position, words of the gram)."""
    heads, grams = [], []
    for i, (label, text) in enumerate(templates):
        ws = _words(text)
        n = len(ws) - k + 1
        if n < 1:
            raise ValueError(f"a template needs {k} words: {text!r}")
        heads.append((i, label, n))
        grams += [(i, j, ws[j : j + k]) for j in range(n)]
    return heads, grams


def license_spans(docs: DataFrame, key: list[str], text: str = "text", templates=TEMPLATES, k: int = GRAM, slack: int = SLACK, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans: key columns, template, label, first_word, last_word (of the span), cover.

    Every k-gram hash of a document meets the templates' (broadcast: fixed text); equal hashes are confirmed word by word. Hits vote by diagonal (document position minus template position); diagonals of one template within `slack` of each other and within a template's length along the document are one passage, with words inserted or lost. A passage stands if it holds at least `min_cover` of the template's k-grams.

    Documents with null, empty or short texts give no row. Rows with equal keys are pooled.
    """
    spark = docs.sparkSession
    heads, grams = _templates(templates, k)
    th = F.broadcast(spark.createDataFrame(heads, "template int, label string, t_grams int"))
    tg = spark.createDataFrame(grams, "template int, t int, t_words array<string>")
    tg = tg.select(F.xxhash64(*[F.get("t_words", F.lit(j)) for j in range(k)]).alias("h"), "template", "t", "t_words")
    ws = plain_words(F.col(text))
    rolling = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h")))
    bits = [0] * (BITMAP // 64)
    for r in tg.select(F.pmod("h", F.lit(BITMAP)).cast("int").alias("slot")).distinct().collect():  # the templates' grams
        bits[r.slot // 64] |= 1 << r.slot % 64
    bitmap = F.array(*[F.lit(b - (1 << 64) if b >> 63 else b).cast("long") for b in bits])
    slot = lambda h: F.pmod(h, F.lit(BITMAP)).cast("int")
    may = lambda h: let(slot(h), lambda n: F.call_function("shiftright", F.get(bitmap, F.floor(n / 64).cast("int")), n % 64).bitwiseAND(F.lit(1).cast("long")) == 1)
    grams_of = let(F.col("_ws"), lambda w: F.transform(F.filter(rolling(w), lambda x: may(x["h"])), lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"), F.slice(w, x["p"] + 1, F.lit(k)).alias("ws"))))
    hits = (
        docs.select(*key, ws.alias("_ws"))
        .where(F.size("_ws") >= k)
        .select(*key, F.explode(grams_of).alias("_g"))
        .select(*key, F.col("_g.p").alias("p"), F.col("_g.h").alias("h"), F.col("_g.ws").alias("_ws"))
        .join(F.broadcast(tg), "h")
        .where(F.col("_ws") == F.col("t_words"))
        .select(*key, "template", "t", "p", (F.col("p") - F.col("t")).alias("d"))
    )
    by = [*key, "template"]
    votes = hits.groupBy(*by, "d").agg(F.collect_set("t").alias("ts"), F.min("p").alias("a"), F.max("p").alias("b"))
    votes = votes.join(th, "template")
    # Along the document a repeated notice gives diagonals far apart; insertions move the diagonal a little.
    order = W.partitionBy(*by).orderBy("d")
    votes = votes.withColumn("_new", (F.col("d") - F.lag("d").over(order) > slack).cast("int")).withColumn("run", F.sum(F.coalesce("_new", F.lit(1))).over(order))
    return (
        votes.groupBy(*by, "run")
        .agg(F.first("label").alias("label"), F.min("a").alias("first_word"), (F.max("b") + k - 1).alias("last_word"), (F.size(F.array_distinct(F.flatten(F.collect_list("ts")))) / F.first("t_grams")).alias("cover"))
        .where(F.col("cover") >= min_cover)
        .drop("run")
    )


def phrase_places(norm, phrases=PHRASES):
    """(array of word positions, one array for each phrase) in a text of words with single spaces around each."""

    def of(phrase):
        pieces = F.split(norm, f"(?<= ){phrase}(?= )", -1)
        upto = running_sums(F.transform(pieces, lambda p: (F.char_length(p) - F.char_length(F.replace(p, F.lit(" "), F.lit("")))).cast("long")))
        inside = phrase.count(" ")
        # The words before the i-th match: the blanks of all pieces so far and those inside earlier matches, less the leading one.
        at = let(upto, lambda u: F.transform(F.slice(u, F.lit(1), F.size(u) - 1), lambda n, i: n - 1 + i * inside))
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<bigint>"))

    return [of(p) for p, _ in phrases]


def scan_licenses(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per row of docs (doc_id, text): the columns of op2's contract, and the number of verified spans.

    A null text is empty. Rows are told apart by id and text, those without an id too: each gets the labels of its own text alone; columns of docs that aren't id or text are not looked at.
    score: the best cover of a verified template, at least 0.5 where a phrase stands, else 0.
    """
    key = ["_key", "_key2"]
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).select("*", *row_keys("doc_id", "text"))
    spans = license_spans(own, key, **options)
    of_row = spans.groupBy(*key).agg(F.collect_set("label").alias("_labels"), F.max("cover").alias("_cover"), F.count("*").alias("n_spans"))
    ws, low = plain_words(F.col("text")), ascii_lower(F.col("text"))
    # Texts without a phrase's rarest word, nearly all, are not searched for phrases.
    hinted = F.lit(False)
    for phrase, _ in PHRASES:
        hinted = hinted | F.contains(low, F.lit(max(phrase.split(), key=len)))
    norm = F.when(hinted, F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))).otherwise(F.lit(" "))
    base = own.select("doc_id", *key, F.size(ws).cast("long").alias("n_words"), norm.alias("_norm")).select("doc_id", *key, "n_words", F.array(*phrase_places(F.col("_norm"))).alias("_at"))
    base = base.select("doc_id", *key, "n_words", F.flatten("_at").alias("_all"), F.filter(F.array(*[F.when(F.size(F.get("_at", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull()).alias("_base"))
    out = base.join(of_row, key, "left")
    mine = F.coalesce("_labels", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").alias("first_word"),
        F.array_max("_all").alias("last_word"),
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", mine)), ",").alias("labels"),
        F.greatest(F.coalesce("_cover", F.lit(0.0)), F.when(F.size("_all") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    heads, grams = _templates(TEMPLATES, GRAM)
    head = ", ".join(f"({i}, '{label}', {n})" for i, label, n in heads)
    gram = ", ".join(f"({i}, {j}, '{' '.join(ws)}')" for i, j, ws in grams)
    phrases = ", ".join(f"({p.count(' ') + 1}, '{p}', '{label}')" for p, label in PHRASES)
    return f"""with docs as materialized (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as ws from documents),
places as (select r, ws, unnest(range(len(ws))) as p from docs),
phrases(k, phrase, label) as (values {phrases}),
found as (select r, p, label from places join phrases on array_to_string(ws[p + 1:p + k], ' ') = phrase),
base as (select r, count(*) as n_base, min(p) as first_word, max(p) as last_word, list(distinct label) as ls from found group by r),
heads(template, label, n) as (values {head}),
grams(template, t, gram) as (values {gram}),
hits as (select r, template, t, p, p - t as d from places join grams on p + {GRAM} <= len(ws) and array_to_string(ws[p + 1:p + {GRAM}], ' ') = gram),
diagonals as (select r, template, d, case when d - lag(d) over (partition by r, template order by d) <= {SLACK} then 0 else 1 end as fresh from (select distinct r, template, d from hits)),
runs as (select r, template, d, sum(fresh) over (partition by r, template order by d) as run from diagonals),
spans as (select r, label, count(distinct t) / max(n)::double as cover from hits join runs using (r, template, d) join heads using (template) group by r, template, label, run having count(distinct t) / max(n)::double >= {MIN_COVER}),
mine as (select r, list(distinct label) as ls, max(cover) as cover, count(*) as n_spans from spans group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(mine.ls, [])))), ','), '') as labels,
  greatest(coalesce(cover, 0.0), case when n_base > 0 then 0.5 else 0.0 end)::double as score, coalesce(n_spans, 0) as n_spans
from docs left join base using (r) left join mine using (r)"""


SQL = {"op2_license_scan": _sql()}
