"""License scans: MinHash bands over overlapping windows of text retrieve templates, containment verifies them.

Column expressions and joins only. Texts and templates are cut to normalised words and five-word shingles, and
both to windows of `WINDOW` shingles, one shingle apart. A window has one value per band, the shingle hash that
is least after exclusive-or with the band's mask; each band has one row. Masks come in complementary pairs, and
so in a window of two shingles each of them is the least under one mask of every pair: a window that holds a
shingle of a template meets a window of the template in some band with certainty. (With w shingles in a window
and m masks a shingle that both windows hold is met with a probability of about 1 - (1 - 1/w)**m per window.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import once

SHINGLE, WINDOW, PERCENT = 5, 2, 80
#: One mask and its complement.
MASKS = (0x5DEECE66D1234567, ~0x5DEECE66D1234567)

#: Wording of public licenses, as notices and as the parts of their texts that name the grant.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def templates_frame(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template_id, license, text."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template_id int, license string, text string")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _shingled(rows: DataFrame) -> DataFrame:
    """Adds __shingles: hashes of the five-word shingles in order of position, none for shorter texts."""
    out = once(rows, __words=F.split(_normal(F.col("text")), " "))
    word = lambda i: F.get("__words", i)
    n = F.size("__words")
    starts = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return once(out, __shingles=F.transform(starts, lambda i: F.xxhash64(*[word(i + j) for j in range(SHINGLE)]))).drop("__words")


def _least(at: Column, mask: int) -> Column:
    """The band value of the window that starts at a shingle; windows at the end hold what there is."""
    parts = [F.get("__shingles", at + j).bitwiseXOR(F.lit(mask)) for j in range(WINDOW)]
    return F.least(*parts)


def _entry(band: int):
    return lambda at: F.struct(F.lit(band).alias("band"), _least(at, MASKS[band]).alias("value"))


def _known(band: int, values: list[int]):
    return lambda at: _least(at, MASKS[band]).isin(values)


def license_scan(docs: DataFrame, templates: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, license, template_id, n_shared, n_template, containment of each template found in each document.

    A template is found where the document holds percent of its distinct shingles or more. Templates (a table
    whose size is that of a license list, and which the driver reads) need five words. Null and short texts give
    no rows; rows that repeat give their rows each; a null doc_id is carried along. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = _shingled(templates if templates is not None else templates_frame(spark)).withColumn("n_template", F.size(F.array_distinct("__shingles")))
    known = known.select("template_id", "license", "n_template", F.col("__shingles"))
    bands = known.select("template_id", F.explode(F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), F.size("__shingles") - 1), _entry(b)) for b in range(len(MASKS))]))).alias("x")).select("template_id", "x.*").distinct()
    values: dict[int, list[int]] = {b: [] for b in range(len(MASKS))}
    for row in bands.select("band", "value").distinct().collect():
        values[row["band"]].append(row["value"])

    found = _shingled(docs.select("doc_id", "text")).select("doc_id", "__shingles").withColumn("__row", F.monotonically_increasing_id())
    at = F.when(F.size("__shingles") > 0, F.sequence(F.lit(0), F.size("__shingles") - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.flatten(F.array(*[F.transform(F.filter(at, _known(b, values[b] or [0])), _entry(b)) for b in range(len(MASKS))]))
    pairs = found.select("__row", "doc_id", "__shingles", F.explode(F.array_distinct(hits)).alias("x")).join(F.broadcast(bands.withColumnsRenamed({"band": "__b", "value": "__v"})), (F.col("x.band") == F.col("__b")) & (F.col("x.value") == F.col("__v")))
    pairs = pairs.groupBy("__row", "template_id").agg(F.first("doc_id").alias("doc_id"), F.first("__shingles").alias("__doc"))
    checked = pairs.join(F.broadcast(known), "template_id").withColumn("n_shared", F.size(F.array_intersect("__doc", "__shingles")))
    checked = checked.where(100 * F.col("n_shared") >= percent * F.col("n_template"))
    return checked.select("doc_id", "license", "template_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_template").cast("long").alias("n_template"), (F.col("n_shared") / F.col("n_template")).alias("containment"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL that holds every document against every template by brute force."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(templates))
    words = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
    grams = "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s"
    return f"""
WITH t(template_id, license, text) AS (VALUES {quoted}),
tw AS (SELECT template_id, license, {words} AS w FROM t),
ts AS (SELECT DISTINCT template_id, license, {grams} FROM tw, unnest(range(1, len(w) - 3)) u(i)),
dw AS (SELECT doc_id, {words} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, {grams} FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
n AS (SELECT template_id, count(*) AS n_template FROM ts GROUP BY template_id)
SELECT doc_id, license, template_id, count(*)::BIGINT AS n_shared, any_value(n_template)::BIGINT AS n_template, count(*) / any_value(n_template) AS containment
FROM ds JOIN ts USING (s) JOIN n USING (template_id) GROUP BY doc_id, license, template_id
HAVING 100 * count(*) >= 80 * any_value(n_template)
"""
