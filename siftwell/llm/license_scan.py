"""License texts in documents by MinHash bands over overlapping windows (DataFrame operations only).

1. A text can only hold a template if it holds one of the template's anchor words (anchors cover more of its shingles than a match
   may lack), so other texts are passed over without loss.
2. Words become 64-bit hashes, these the hashes of 5-word shingles. Windows overlap by half: for each length class W of
   templates they are 2 W words long and start every W words, so every passage of up to W words lies inside one.
3. Each window has BANDS minima (one row a band) of one hash XORed with a mask. Where window and template share a share J of all their
   shingles, they share a band with a probability of 1 - (1 - J)^BANDS: at the least J that a class allows, 1/12, 0.996.
4. Templates that a band retrieves are verified: the window must contain at least PERCENT of the template's shingles.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BANDS, PERCENT = 5, 64, 80

#: Public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

_WORD = r"[\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _anchors(templates: dict[str, str]) -> list[str]:
    """Words such that no match can do without all of them: those of a template cover over 100 - PERCENT % of its shingles.

    Longer words first, for they are rarer; words already chosen for other templates before new ones."""
    chosen: list[str] = []
    for text in templates.values():
        words = _words(text)
        runs = {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}
        for w in sorted(set(words), key=lambda w: (w not in chosen, -len(w), w)):
            if 100 * sum(any(a in run for a in chosen) for run in runs) > (100 - PERCENT) * len(runs):
                break
            if w not in chosen:
                chosen.append(w)
    return chosen


def _masks() -> Column:
    rng = random.Random(13)
    step = 64 // BANDS
    masks = [(i * step << 58) | rng.getrandbits(58) for i in range(BANDS)]
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])


def _shingles(words: Column) -> Column:
    """Hashes of the runs of WORDS words; of fewer, of the whole run. words: an array of strings."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))

    def runs(h: Column) -> Column:
        return F.transform(at, lambda i: F.xxhash64(*[F.coalesce(F.get(h, i + k), F.lit(0)) for k in range(WORDS)]))

    # The one element of an array is bound to a name, so that the words are hashed once, not again for each shingle.
    run = F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 1)
    return F.when(F.size(words) > 0, run).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """One key a band: the hash of its number and minimum."""
    low = F.transform(_masks(), lambda m: F.array_min(F.transform(shingles, lambda h: h.bitwiseXOR(m))))
    return F.transform(low, lambda v, b: F.xxhash64(b, v))


def _template_rows(documents: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(license, span, shingles, keys); span is the length class: the power of two that holds the template's words."""
    spark = documents.sparkSession
    rows = None
    for name, text in sorted(templates.items()):
        words = _words(text)
        if not words:
            raise ValueError(f"template {name} has no words")
        span = max(8, 1 << (len(words) - 1).bit_length())
        row = spark.range(1).select(F.lit(name).alias("license"), F.lit(span).alias("span"), F.array_distinct(_shingles(F.array(*[F.lit(w) for w in words]))).alias("shingles"))
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("keys", _bands(F.col("shingles")))


def _start(span: int):
    """Window number -> (span, place of the first shingle)."""
    return lambda i: F.struct(F.lit(span).alias("span"), (i * span + 1).alias("at"))


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Each row of documents as (doc_id, licenses): the names of the templates that its text contains, sorted and distinct.

    templates: name -> text, a bounded list that is broadcast. Words are runs of letters and digits, in lower case. Null, empty and clean
    texts have an empty array; repeated rows are told apart, each has its own array. Very long texts are read whole, window by
    window. Other columns are not read; an empty table gives no rows.
    """
    anchors = _anchors(templates)
    low = F.lower("text")
    may = F.lit(False)
    for a in anchors:
        may = may | F.contains(low, F.lit(a))
    rows = documents.select("doc_id", "text", F.coalesce(may, F.lit(False)).alias("may"))
    table = _template_rows(documents, templates)
    rows_of = table.collect()  # one row a template
    known = F.broadcast(table.withColumnRenamed("keys", "template_keys"))
    all_shingles = F.array(*[F.lit(h) for h in sorted({h for r in rows_of for h in r["shingles"]})])
    all_keys = F.array(*[F.lit(k) for k in sorted({k for r in rows_of for k in r["keys"]})])
    spans = sorted({r["span"] for r in rows_of})

    worded = rows.filter("may").select("doc_id", F.xxhash64("text").alias("rk"), F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)).alias("w"))
    hashed = worded.select("doc_id", "rk", F.size("w").alias("n"), _shingles(F.col("w")).alias("sh")).filter("n > 0")
    last = lambda s: F.greatest(F.floor((F.col("n") - 1) / s).cast("int") - 1, F.lit(0))
    starts = [F.transform(F.sequence(F.lit(0), last(s)), _start(s)) for s in spans]
    windows = hashed.select("doc_id", "rk", "sh", F.explode(F.concat(*starts)).alias("p"))
    windows = windows.select("doc_id", "rk", "p.span", F.slice("sh", F.col("p.at"), 2 * F.col("p.span") - WORDS + 1).alias("win"))
    # A window without any shingle of a template has no band in common with it either, nor could it be verified.
    windows = windows.filter(F.arrays_overlap("win", all_shingles))
    windows = windows.withColumn("keys", _bands(F.col("win"))).filter(F.arrays_overlap("keys", all_keys))
    met = windows.join(known, "span").filter(F.arrays_overlap("keys", "template_keys"))
    held = F.size(F.array_intersect(F.array_distinct("win"), "shingles"))
    hits = met.filter(held * 100 >= PERCENT * F.size("shingles")).select("doc_id", "rk", "license")
    found = hits.groupBy("doc_id", "rk").agg(F.sort_array(F.collect_set("license")).alias("licenses"))
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("rk").alias("hit_rk"), "licenses")
    every = rows.select("doc_id", F.when(F.col("may"), F.xxhash64("text")).alias("rk"))
    both = every["doc_id"].eqNullSafe(found["hit_id"]) & (every["rk"] == found["hit_rk"])
    return every.join(found, both, "left").select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
