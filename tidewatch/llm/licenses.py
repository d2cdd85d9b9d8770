"""License notices in documents: MinHash bands over text windows retrieve templates, containment confirms them.

A text is taken as lower-cased words of ASCII letters and digits. Two words in a row are a shingle. Templates
are looked for in windows which overlap by half, and half a window has room for the template and
``room`` words put in. So an occurrence with no more words put in, wherever it stands, lies whole in one window. A window that holds ``CONTAINMENT`` of a template's shingles has at
least a known Jaccard similarity with it. There are so many bands of one MinHash value each that such a window
shares none of them with the template in at most ``MISS`` of cases (``bands_for``). Where a band is shared,
the template's shingles are counted in the window exactly.

Only texts that can match get windows: ``CONTAINMENT`` of a template's shingles include at least one of any
larger part of them than the rest, so one phrase of that part must be in the text. No match is lost by this.

All of it is DataFrame expressions; templates are a short list that is part of the plan.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.license_texts import NOTICES
from tidewatch.session import staged

CONTAINMENT = 0.8
MISS = 1e-4
SMALLEST_WINDOW = 16

# Notices and first sentences of public licenses.
TEMPLATES = {
    **NOTICES,
    "apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the "
                         "License at",
    "bsd header": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met",
    "cc-by notice": "Licensed under CC BY 4.0.",
    "cc-by-nc notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa notice": "Licensed under CC BY-SA 4.0.",
    "gpl-2 notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3 notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "isc header": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                  "is hereby granted",
    "mit notice": "Released under the MIT License.",
    "mit header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files",
    "mpl-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def room(words: int) -> int:
    """How many words may be put into a template of so many words without it being lost at a window's edge."""
    return max(4, words // 4)


def window_size(words: int) -> int:
    """The window for templates of so many words: a power of two, at least twice as long as one with words put in."""
    return max(SMALLEST_WINDOW, 1 << math.ceil(math.log2(2 * (words + room(words)))))


def bands_for(words: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """How many bands make a miss at most as likely as ``miss``, for a template of so many words."""
    shingles, window = words - 1, window_size(words) - 1
    least = math.ceil(containment * shingles - 1e-9)
    similarity = least / (window + shingles - least)
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def needed_phrases(template: str, containment: float = CONTAINMENT) -> list[str]:
    """Shingles of which a text with ``containment`` of all must have one: the longest ones."""
    words = _words(template)
    found = sorted({f"{a} {b}" for a, b in zip(words, words[1:])}, key=lambda p: (-len(p), p))
    may_lack = len(found) - math.ceil(containment * len(found) - 1e-9)
    return found[:may_lack + 1]


def _plain(text: Column) -> Column:
    """Words between single spaces, with one in front and behind."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def _shingles(plain: Column) -> Column:
    words = F.split(F.trim(plain), " ")
    pairs = F.size(words) - 1
    return F.when(pairs > 0, F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs),
                                        lambda a, b: F.xxhash64(a, b)))


def _band(shingles: Column, k: int) -> Column:
    return F.struct(F.lit(k).alias("band"), F.array_min(F.transform(shingles, _salted(k))).alias("least"))


def _any_phrase(plain: Column, phrases: list[str]) -> Column:
    return plain.rlike(one_of([f" {p} " for p in phrases]))


def one_of(texts: list[str]) -> str:
    """A regular expression for any of ``texts`` (of letters, digits and spaces), which shares their beginnings, so that
    the time per place doesn't grow with their number."""
    tree: dict = {}
    for text in texts:
        node = tree
        for c in text:
            node = node.setdefault(c, {})

    def written(node: dict) -> str:
        some = [c + written(rest) for c, rest in sorted(node.items())]
        return some[0] if len(some) == 1 else f"(?:{'|'.join(some)})" if some else ""

    return written(tree)


def _salted(k: int):
    return lambda h: F.xxhash64(h, F.lit(k))


def _template_bands(spark: SparkSession, templates: dict[str, str], count: int) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t).alias("text")) for n, t in sorted(templates.items())])
    found = spark.range(1).select(F.inline(rows)).select(
        "template", F.array_distinct(_shingles(_plain(F.col("text")))).alias("wanted"))
    bands = F.array(*[_band(F.col("wanted"), k) for k in range(count)])
    return found.select("template", "wanted", F.inline(bands))


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None,
                    containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, containment, start_word (the first word of the window) and place of each notice found.

    Templates that differ little are found in the same place; ``place`` 1 has the document's best one. One row per document and template, for the window that holds most of it (the first of equals). A null or empty
    text has no notice; repeated rows give one; a null id is an id; no rows give none. Texts are searched whole.
    Templates need two words. Other columns are not read.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    classes: dict[int, dict[str, str]] = {}
    for name, text in templates.items():
        if len(_words(text)) < 2:
            raise ValueError(f"template {name!r} has fewer than two words")
        classes.setdefault(window_size(len(_words(text))), {})[name] = text
    phrases = {size: sorted({p for t in own.values() for p in needed_phrases(t, containment)})
               for size, own in classes.items()}
    # the plain text is bound to a variable, so that it is made once per row and not once per phrase
    plain = F.transform(F.array(_plain(F.col("text").cast("string"))), lambda t: F.struct(
        t.alias("plain"), *[_any_phrase(t, some).alias(f"may_{size}") for size, some in sorted(phrases.items())]))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(plain).alias("x"))
    found = staged(marked.where(F.greatest(F.lit(False), F.lit(False), *[F.col(f"x.may_{k}") for k in classes]))
                   .select("doc_id", "x.*"))
    parts = []
    for size, own in sorted(classes.items()):
        count = max(bands_for(len(_words(t)), containment) for t in own.values())
        hashed = found.where(f"may_{size}").select("doc_id", _shingles(F.col("plain")).alias("h"))
        starts = F.sequence(F.lit(0), F.size("h") - 1, F.lit(size // 2))
        windows = hashed.select("doc_id", "h", F.explode(starts).alias("start_word")).select(
            "doc_id", "start_word", F.slice("h", F.col("start_word") + 1, F.lit(size - 1)).alias("h"))
        banded = windows.select("doc_id", "start_word", "h", F.inline(F.array(*[_band(F.col("h"), k) for k in range(count)])))
        met = banded.join(F.broadcast(_template_bands(spark, own, count)), ["band", "least"])
        share = F.size(F.array_intersect("h", "wanted")) / F.size("wanted")
        parts.append(met.select("doc_id", "template", "start_word", share.alias("containment"))
                     .where(F.col("containment") >= containment))
    matches = reduce(DataFrame.union, parts) if parts else spark.createDataFrame(
        [], "doc_id long, template string, start_word int, containment double")
    best = F.max(F.struct("containment", (-F.col("start_word")).alias("back"))).alias("x")
    order = Window.partitionBy("doc_id").orderBy(F.col("containment").desc())
    return matches.groupBy("doc_id", "template").agg(best).select(
        "doc_id", "template", F.col("x.containment").alias("containment"), (-F.col("x.back")).alias("start_word")
    ).withColumn("place", F.rank().over(order))
