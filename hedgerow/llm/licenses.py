"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

For a template of n words the text is read in windows of n + n // 4 words, one every n // 4 words, so that each occurrence lies
whole in a window and makes up half of its shingles or more. A window is retrieved if one of BANDS MinHash values (bands of
one row) is the template's: a window that holds the whole template is missed with a probability of at most 2 ** -BANDS. What
is retrieved is verified: the share of the template's shingles (five words) that the window and the n words on either side of
it hold, so that an occurrence with inserted words, up to 2 * n words long, is judged whole wherever it stands.

A MinHash value of a template is the hash of one of its shingles, its anchor. A window without an anchor of the template
cannot collide with it, so only windows around anchors are hashed, and only texts that hold a word of each anchor are
split into shingles at all; nothing that could collide is left out. Everything is DataFrame and SQL expressions; the
catalogue of templates is small and becomes literals and broadcast tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
            'documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
WIDTH, BANDS, LEAST = 5, 24, 0.8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Hash of the WIDTH words from each place on; fewer words have none."""
    return let(words, lambda w: F.when(
        F.size(w) >= WIDTH,
        F.transform(F.sequence(F.lit(1), F.size(w) - (WIDTH - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WIDTH)])),
    ).otherwise(F.array().cast("array<bigint>")))


def min_hashes(shingles: Column) -> Column:
    """Array of BANDS MinHash values."""
    def one(own: Column, band: int) -> Column:
        return F.array_min(F.transform(own, lambda x: F.xxhash64(x, F.lit(band))))

    return let(shingles, lambda own: F.array(*[one(own, band) for band in range(BANDS)]))


def catalogue(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[dict]:
    """The templates' words, shingles and anchors; a template needs WIDTH words."""
    rows = []
    quoted = [(i, *(part.replace("\\", "\\\\").replace("'", "\\'") for part in t)) for i, t in enumerate(templates)]
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, name, text in quoted)
    parsed = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, text)").select(
        "template", "license", words_of(F.col("text")).alias("words")
    ).select("template", "license", "words", shingles_of(F.col("words")).alias("shingles")).select(
        "*", min_hashes(F.col("shingles")).alias("values"),
        F.array(*[F.array_min(F.transform("shingles", _ranked(band))) for band in range(BANDS)]).alias("ranked"),
    )
    for row in parsed.collect():  # as many rows as templates
        if not row["shingles"]:
            raise ValueError(f"a template needs {WIDTH} words: {templates[row['template']]}")
        anchors = {r["shingle"] for r in row["ranked"]}
        places = {s: i for i, s in reversed(list(enumerate(row["shingles"])))}
        markers = {max(row["words"][places[a]: places[a] + WIDTH], key=lambda w: (len(w), w)) for a in anchors}
        rows.append({
            "template": row["template"], "license": row["license"], "n": len(row["words"]), "shingles": sorted(set(row["shingles"])),
            "values": row["values"], "anchors": sorted(anchors), "markers": sorted(markers),
        })
    return rows


def _ranked(band: int):
    return lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("rank"), x.alias("shingle"))


def _longs(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): one row for each document and licence found in it.

    `containment` is the largest share of a template's shingles in and around one window, LEAST or more; `first_word` is the
    place of the first such window, from 0, and `n_windows` the number of retrieved windows that hold or touch the licence. Texts are read whole.
    Null, empty and short texts hold none; rows of one doc_id (those with none, too) are one document; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    known = catalogue(spark, templates)
    anchors = sorted({a for t in known for a in t["anchors"]})
    markers = sorted({m for t in known for m in t["markers"]})
    widest = max(2 * t["n"] + max(1, t["n"] // 4) for t in known)

    table = ", ".join(
        f"({t['template']}, '{t['license']}', {t['n']}, array({', '.join(map(_long_sql, t['shingles']))}),"
        f" array({', '.join(map(_long_sql, t['values']))}), array({', '.join(map(_long_sql, t['anchors']))}))"
        for t in known
    )
    catalog = F.broadcast(  # a row for each anchor of a template
        spark.sql(f"SELECT *, explode(anchors) AS anchor FROM VALUES {table} AS t(template, license, n, theirs, their_values, anchors)")
        .drop("anchors")
    )

    def around_hits(h: Column) -> Column:
        """For each place of an anchor: the anchor, and the shingles in and around the windows that can hold it."""
        places = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(_longs(anchors), F.get(h, i)))
        parts = F.transform(places, lambda i: F.struct(
            i.alias("at"), F.get(h, i).alias("anchor"), F.greatest(F.lit(0), i - widest).alias("begin"),
            F.slice(h, F.greatest(F.lit(0), i - widest) + 1, F.lit(2 * widest + 1)).alias("part"),
        ))
        return F.when(F.size(h) > 0, parts)

    near = (
        docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
        .where(F.arrays_overlap("words", F.array(*[F.lit(m) for m in markers])))
        .select("doc_id", F.inline(let(shingles_of(F.col("words")), around_hits)))
    )
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int"))
    room = F.col("n") + F.col("step") - (WIDTH - 1)  # shingles of a window
    lowest = F.greatest(F.lit(0), F.ceil((F.col("at") - room + 1) / F.col("step")).cast("int"))
    left = F.greatest(F.col("begin"), F.col("place") * F.col("step") - F.col("n"))  # where the surroundings begin
    windows = (
        near.join(catalog, "anchor")
        .withColumn("step", step)
        .withColumn("place", F.explode(F.sequence(lowest, F.floor(F.col("at") / F.col("step")).cast("int"))))
        .select("doc_id", "template", "license", "theirs", "their_values", (F.col("place") * F.col("step")).alias("first_word"),
                F.slice("part", F.col("place") * F.col("step") - F.col("begin") + 1, room).alias("ours"),
                F.slice("part", left - F.col("begin") + 1, F.col("place") * F.col("step") + room + F.col("n") - left).alias("wide"))
        .where("size(ours) > 0")
    )
    agree = F.exists(F.zip_with(min_hashes(F.col("ours")), "their_values", lambda a, b: a == b), lambda same: same)
    contained = F.size(F.array_intersect("theirs", "wide")) / F.size("theirs")
    found = windows.where(agree).select("doc_id", "license", "first_word", contained.alias("containment")).where(F.col("containment") >= LEAST)
    once = found.groupBy("doc_id", "license", "first_word").agg(F.max("containment").alias("containment"))
    return once.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"), F.count("*").alias("n_windows")
    )


def _long_sql(value: int) -> str:
    return f"{value}L" if value != -(2**63) else "bigint('-9223372036854775808')"
