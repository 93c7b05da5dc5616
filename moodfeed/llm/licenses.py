"""Licence scan: headers and licence files against templates, then inheritance by directory.

A template is a notice or a whole licence text. Wherever its key word occurs in a text, the window of as many
words as the template has, laid so that the key word stands where the template has it (moved inside the text
at its ends; the whole text if that is shorter), is compared with the template by the cosine of sparse TF-IDF
vectors. Windows run over line borders and comment marks. They must hold all words that name the licence, so
that a notice of another licence or version is not taken for it. Windows of ``threshold`` or more count. Of those
that begin at one word, the licence with the longest template counts, as some texts begin with the whole of
another; then that of the best score. The best such score is what a file declares; ties go to the earliest
window, then the first template.

Document frequencies of all terms are counted over the whole table and joined to the terms of the windows: the
``HOT`` most frequent are broadcast, all others are shuffled.

A file without a licence of its own takes that of the licence file in its nearest ancestor directory;
``sources`` says which path it came from. If a directory has several licence files, the best score counts,
then the smallest path. Null and empty texts declare nothing; a null path is outside every directory; rows
with the same path are judged one by one; the root directory is the empty string. Texts of any length are
read whole: a window is the largest thing that is copied.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodfeed.llm.arrow import unused
from moodfeed.staging import stage

THRESHOLD = 0.6
#: So many terms, the most frequent ones, are broadcast with their document frequencies.
HOT = 4096

# --- fixed values: licence notices and texts -------------------------------
NOTICES = [
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004"),
    (
        "Apache-2.0",
        "apache 2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("MIT", "license mit", "Released under the MIT License"),
    ("MIT", "license mit", "Licensed under the MIT License"),
    ("MIT", "license mit", "The MIT License (MIT)"),
    (
        "MIT",
        "hereby permission granted software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files",
    ),
    (
        "MIT",
        "hereby permission granted sublicense",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "hereby permission granted fee",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "redistribution source binary disclaimer",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "redistribution source binary disclaimer endorse promote",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "bsd 3 clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "bsd 2 clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "mozilla 2", "Licensed under the Mozilla Public License, version 2.0"),
    (
        "MPL-2.0",
        "mozilla 2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
    ),
    ("CC0-1.0", "cc0 1", "Dedicated to the public domain under CC0 1.0"),
    (
        "Unlicense",
        "unencumbered software public domain",
        "This is free and unencumbered software released into the public domain",
    ),
]
#: Short name, name in full and version of the licences that share their notices.
GNU = [
    ("GPL", "General", "2"),
    ("GPL", "General", "3"),
    ("LGPL", "Lesser General", "2.1"),
    ("LGPL", "Lesser General", "3"),
    ("AGPL", "Affero General", "3"),
]
GNU_NOTICES = [
    "This work is licensed under the GNU {name} Public License, version {version}",
    "GNU {name} Public License Version {version}",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
    "Public License as published by the Free Software Foundation, either version {version} of the License, or "
    "(at your option) any later version.",
]
CREATIVE_COMMONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CREATIVE_COMMONS_LICENSES = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
#: Names of licence files, without an extension, in lower case.
LICENSE_FILES = r"^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"

_SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


def words_in(text: str) -> list[str]:
    """Terms of an ASCII text, as ``terms`` has them."""
    return re.findall(r"[a-z0-9]+", text.lower())


def _all_templates() -> list[tuple[str, str, str]]:
    out = list(NOTICES)
    for short, name, version in GNU:
        license = f"{short}-{version if '.' in version else version + '.0'}"
        named = f"gnu {name} public license {version}"
        out += [(license, named, x.format(name=name, version=version)) for x in GNU_NOTICES]
    for x in CREATIVE_COMMONS_LICENSES:
        parts = "-".join(CREATIVE_COMMONS[p] for p in x.split("-"))
        out.append((f"CC-{x}-4.0", f"cc {x} 4", f"Licensed under CC {x} 4.0"))
        notice = f"This work is licensed under a Creative Commons {parts} 4.0 International License"
        out.append((f"CC-{x}-4.0", f"creative commons {parts} 4", notice))
    names = dict.fromkeys(license for license, _, _ in out)
    return out + [(x, f"spdx identifier {x}", f"SPDX-License-Identifier: {x}") for x in names]


#: License, the words that name it (a window must hold them; the first is the key word), and the notice.
TEMPLATES = _all_templates()


def _counted(template: tuple[str, str, str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for t in words_in(template[2]):
        counts[t] = counts.get(t, 0) + 1
    return counts


def all_frequencies(docs: DataFrame) -> DataFrame:
    """Number of texts that have each term: term, n. The empty term counts the texts."""
    found = F.array_distinct(terms(F.col("text")))
    return (
        docs.where("text IS NOT NULL")
        .select(F.explode(F.concat(F.array(F.lit("")), found)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )


def _some_frequencies(frequencies: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    rows = frequencies.where(F.col("term").isin("", *vocabulary)).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that have each of some terms."""
    return _some_frequencies(all_frequencies(docs), vocabulary)


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _windows(texts: DataFrame, templates: list[tuple[str, str, str]]) -> DataFrame:
    """Windows of distinct texts that hold the words which name the licence: key, template (its number),
    at (the first word, from 0), window."""
    places = []
    for i, (_, named, notice) in enumerate(templates):
        words, named = words_in(notice), words_in(named)
        places.append(
            F.struct(
                F.lit(i).alias("template"),
                F.lit(named[0]).alias("word"),
                F.lit(words.index(named[0])).alias("before"),
                F.lit(len(words)).alias("length"),
                F.array(*map(F.lit, named)).alias("named"),
            )
        )
    places = F.array(*places)
    keys = sorted({words_in(named)[0] for _, named, _ in templates})
    # rows are generated, so that the words of a text are split once
    words = (
        texts.where(F.lower("text").rlike("|".join(keys)))
        .select("key", F.inline(F.array(F.struct(terms(F.col("text")).alias("words")))))
        .where(F.arrays_overlap("words", F.array(*map(F.lit, keys))))
    )
    found = F.filter(
        F.transform("words", lambda w, at: F.struct(at.alias("at"), w.alias("word"))),
        lambda x: F.array_contains(F.array(*map(F.lit, keys)), x["word"]),
    )

    def window(t: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(at - t["before"], F.size("words") - t["length"]))
        return F.struct(
            t["template"].alias("template"),
            start.alias("at"),
            F.slice("words", start + 1, t["length"]).alias("window"),
            t["named"].alias("named"),
        )

    def windows(x: Column) -> Column:
        here = F.transform(F.filter(places, lambda t: t["word"] == x["word"]), lambda t: window(t, x["at"]))
        return F.filter(here, lambda y: F.size(F.array_except(y["named"], y["window"])) == 0)

    # windows are cut inside the row, as a row for each would copy all words of the text
    return (
        words.select("key", F.inline(F.flatten(F.transform(found, windows))))
        .select("key", "template", "at", "window")
        .dropDuplicates(["key", "template", "at"])
    )


def declared(
    docs: DataFrame,
    name: str,
    threshold: float = THRESHOLD,
    templates: list[tuple[str, str, str]] = TEMPLATES,
) -> DataFrame:
    """All rows and columns of ``docs`` and a struct called ``name``: license, score and word (the number,
    from 0, of the first word) of the best window of ``text``, null without one."""
    counted = [_counted(t) for t in templates]
    vocabulary = sorted({t for own in counted for t in own})
    frequencies = stage(all_frequencies(docs), "frequencies")
    n, frequency = _some_frequencies(frequencies, vocabulary)
    idf = {t: math.log((n + 1) / (frequency.get(t, 0) + 1)) + 1 for t in vocabulary}
    weights = [{t: k * idf[t] for t, k in own.items()} for own in counted]
    norms = [math.sqrt(sum(w * w for w in own.values())) for own in weights]

    # what a text declares follows from the text alone, so texts are told apart by their hash
    key, top = unused(docs, "text_key"), unused(docs, "top")
    hashed = F.md5(F.coalesce("text", F.lit("")))
    windows = stage(_windows(docs.select(hashed.alias("key"), "text"), templates), "windows")
    tf = (
        windows.select("key", "template", "at", F.explode("window").alias("term"))
        .groupBy("key", "template", "at", "term")
        .agg(F.count("*").alias("tf"))
    )
    hot = stage(frequencies.where("term != ''").orderBy(F.desc("n"), "term").limit(HOT), "hot")
    marked = stage(tf.join(F.broadcast(hot), "term", "left"), "window_terms")
    rare = marked.where("n IS NULL").drop("n").join(frequencies, "term")
    weight = F.col("tf") * (F.log(F.lit(n + 1.0) / (F.col("n") + 1)) + 1)
    names = F.array(*(F.lit(license) for license, _, _ in templates))
    lengths = F.array(*(F.lit(sum(own.values())) for own in counted))
    # of each template, the weights of its terms over its norm
    units = F.array(*(_map({t: w / norm for t, w in own.items()}) for own, norm in zip(weights, norms)))
    unit = F.element_at(F.element_at(units, F.col("template") + 1), F.col("term"))
    cosine = F.sum(weight * F.coalesce(unit, F.lit(0.0))) / F.sqrt(F.sum(weight * weight))
    best = (
        marked.where("n IS NOT NULL")
        .unionByName(rare)
        .groupBy("key", "template", "at")
        .agg(F.round(cosine, 6).alias("score"))
        .where(F.col("score") >= threshold)
        .groupBy("key", "at", F.element_at(names, F.col("template") + 1).alias("license"))
        .agg(
            F.max(F.element_at(lengths, F.col("template") + 1)).alias("length"),
            F.max("score").alias("score"),
            (-F.min("template")).alias("first"),
        )
        .groupBy("key", (-F.col("at")).alias("at"))
        .agg(F.max(F.struct("length", "score", "first", "license")).alias("here"))
        .groupBy("key")
        .agg(F.max(F.struct("here.score", "at", "here.first", "here.license")).alias("top"))
    )
    best = stage(best, "best")
    found = F.when(
        F.col(f"{top}.score").isNotNull(),
        F.struct(
            F.col(f"{top}.license").alias("license"),
            F.col(f"{top}.score").alias("score"),
            (-F.col(f"{top}.at")).alias("word"),
        ),
    )
    joined = docs.withColumn(key, hashed).join(
        best.select(F.col("key").alias(f"{key}_found"), F.col("top").alias(top)),
        F.col(key) == F.col(f"{key}_found"),
        "left",
    )
    return joined.withColumn(name, found).select(*docs.columns, name)


def parent(path: Column) -> Column:
    """Directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """A directory and those above it, nearest first."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.transform(
            F.sequence(F.size(parts), F.lit(0), F.lit(-1)),
            lambda k: F.array_join(F.slice(parts, 1, k), "/"),
        )
    )


def inherit(files: DataFrame, own: str, name: str, path: str = "path") -> DataFrame:
    """All rows and columns of ``files`` and a struct called ``name``: license, score and origin
    (``own``, ``inherited`` or null), and the path it comes from.

    Directories are resolved once each, not file by file, and found by joins on their paths.
    """
    directory = unused(files, "directory")
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    rows = files.withColumn(directory, parent(F.col(path)))
    licensed = (
        rows.where(base.rlike(LICENSE_FILES) & F.col(own).isNotNull())
        .groupBy(F.col(directory).alias("above"))
        .agg(
            F.max(F.struct(F.col(f"{own}.score").alias("score"), F.col(f"{own}.license").alias("license"))).alias("top"),
            F.min_by(F.col(path), F.struct(-F.col(f"{own}.score"), F.col(path))).alias("from"),
        )
    )
    licensed = stage(licensed, "licensed")
    directories = rows.where(F.col(path).isNotNull()).select(
        F.col(directory).alias("directory")
    ).distinct()
    climbs = directories.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("up", "above"))
    nearest = (
        climbs.join(licensed, "above")
        .groupBy("directory")
        .agg(F.min_by(F.struct("top.license", "top.score", "from"), "up").alias("nearest"))
    )
    nearest = stage(nearest, "nearest")
    where, top = unused(rows, "at_directory"), unused(rows, "nearest")
    other = nearest.select(F.col("directory").alias(where), F.col("nearest").alias(top))
    joined = rows.join(other, F.col(directory) == F.col(where), "left")
    result = F.when(
        F.col(own).isNotNull(),
        F.struct(
            F.col(f"{own}.license").alias("license"),
            F.col(f"{own}.score").alias("score"),
            F.lit("own").alias("origin"),
            F.col(path).alias("sources"),
        ),
    ).when(
        F.col(top).isNotNull(),
        F.struct(
            F.col(f"{top}.license").alias("license"),
            F.col(f"{top}.score").alias("score"),
            F.lit("inherited").alias("origin"),
            F.col(f"{top}.from").alias("sources"),
        ),
    )
    return joined.withColumn(name, result).select(*files.columns, name)
