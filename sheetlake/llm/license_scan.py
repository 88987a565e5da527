"""License scans by a positional index of rare words.

The words of each licence template are indexed with their positions, but only its
rarest: the document frequency of every template word is counted over all files, and
each template keeps its ``INDEXED`` words of highest inverse document frequency. A
file looks up all indexed words, so that one notice does not hide another. Where
template and file positions of different words agree on one offset, the template
stands at that offset; it counts as found when its mandatory key phrases stand there
word for word.

Only column expressions are used. Broadcasts are bounded by the templates, which are
a fixed list of a few hundred words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import text_of
from sheetlake.session import checkpointed

# Phrases that name a licence by themselves, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices as their licences give them, with the phrases that must be there.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "Released under the MIT License", ("the mit license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
     ("for any purpose with or without fee",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer",
     ("redistribution and use in source and binary forms", "with or without modification")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0",
     ("apache license version 2 0",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("licensed under the apache license version 2 0",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version", ("under the terms of the gnu general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3",
     ("licensed under the gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation",
     ("gnu lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation",
     ("gnu affero general public license",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
            "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
     ("mozilla public license v 2 0",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4 0",)),
    ("cc-by", "Licensed under CC BY 4.0", ("licensed under cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("licensed under cc by sa 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("licensed under cc by nc 4 0",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work under the CC0 Public Domain Dedication", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software",
     ("free and unencumbered software released into the public domain",)),
)
INDEXED = 16  # rare words kept of a template
SLACK = 8  # words that may be put in or left out within a template
LEAST_SHARE = 0.5  # of a template's rare words, by weight
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in template_words(text)})


def lowered(text: Column) -> Column:
    """A-Z lowered. The two other letters whose lower case is or begins with an ASCII letter become another one first."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é")))


def file_words(docs: DataFrame, row: str | None = None, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """One stored record per row: its number of words, the template words it has, and all words where a phrase may be."""
    low = lowered(text_of(text_column))
    keys = sorted({p for p, _ in PHRASES} | {k for _, _, keys in TEMPLATES for k in keys})
    pattern = "|".join(SEPARATOR.join(k.split()) for k in keys)
    rows = docs.select(F.col(row).alias("__row") if row else F.monotonically_increasing_id().alias("__row"),
                       F.col(id_column).alias("__id"), low.alias("__low"))
    words = F.filter(F.split("__low", SEPARATOR, -1), lambda w: w != "")
    parted = rows.select("__row", "__id", words.alias("__words"), F.col("__low").rlike(pattern).alias("__suspect"))
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    return checkpointed(parted.select(
        "__row", "__id", F.size("__words").cast("long").alias("n_words"),
        F.array_intersect("__words", vocabulary).alias("__seen"), F.when(F.col("__suspect"), F.col("__words")).alias("__words")))


def template_index(files: DataFrame) -> DataFrame:
    """``word, idf, template, place, rare`` of the indexed words: a row per place in a template. Bounded by the templates."""
    spark: SparkSession = files.sparkSession
    places = spark.createDataFrame([(n, w, i) for n, (_, text, _) in enumerate(TEMPLATES)
                                    for i, w in enumerate(template_words(text))], "template int, word string, place int")
    counts = files.select(F.explode("__seen").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("all"))
    known = (places.join(counts, "word", "left").crossJoin(F.broadcast(total))
             .withColumn("idf", F.log((F.col("all") + 1) / (F.coalesce("n", F.lit(0)) + 0.5))))
    by_rarity = Window.partitionBy("template").orderBy(F.desc("idf"), "word")
    return checkpointed(known.withColumn("__nth", F.dense_rank().over(by_rarity)).where(F.col("__nth") <= INDEXED)
                        .select("word", "idf", "template", "place"))


def template_matches(files: DataFrame) -> DataFrame:
    """``__row, template, share`` of the templates found in a file."""
    index = template_index(files)
    spoken = files.where("__words IS NOT NULL").select("__row", F.posexplode("__words").alias("at", "word"))
    postings = spoken.join(F.broadcast(index), "word")
    # An offset falls into two overlapping bands, so that nearby ones share one.
    offset = F.col("at") - F.col("place")
    bands = postings.withColumn("band", F.explode(F.array(
        F.floor(offset / (2 * SLACK)) * 2, F.floor((offset + SLACK) / (2 * SLACK)) * 2 - 1)))
    met = (bands.select("__row", "template", "band", "word", "idf").distinct()
           .groupBy("__row", "template", "band").agg(F.sum("idf").alias("met")))
    whole = index.select("template", "word", "idf").distinct().groupBy("template").agg(F.sum("idf").alias("whole"))
    shares = (met.join(F.broadcast(whole), "template")
              .withColumn("share", F.least(F.col("met") / F.col("whole"), F.lit(1.0)))
              .where(F.col("share") >= LEAST_SHARE))
    spark = files.sparkSession
    facts = spark.createDataFrame([(n, len(template_words(text)), list(keys)) for n, (_, text, keys) in enumerate(TEMPLATES)],
                                  "template int, size int, keys array<string>")
    begin = F.greatest(F.col("band") * SLACK - SLACK, F.lit(0)).cast("int")
    stretch = F.concat(F.lit(" "), F.array_join(F.slice(
        "__words", begin + 1, F.col("size") + 5 * SLACK), " "), F.lit(" "))
    placed = (shares.join(F.broadcast(facts), "template").join(files.where("__words IS NOT NULL").select("__row", "__words"), "__row")
              .withColumn("__stretch", stretch))
    verified = placed.where(F.forall("keys", lambda k: F.col("__stretch").contains(F.concat(F.lit(" "), k, F.lit(" ")))))
    return verified.groupBy("__row", "template").agg(F.max("share").alias("share"))


def phrase_places(files: DataFrame) -> DataFrame:
    """``__row, label, at``: every place where the words of a phrase of :data:`PHRASES` stand in a row."""
    def places(words: list[str], label: str) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size("__words")), lambda i: _stand_at(words, i))
        return F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), (i - 1).cast("long").alias("at")))

    found = [places(phrase.split(), label) for phrase, label in PHRASES]
    return (files.where("size(__words) > 0").select("__row", F.explode(F.concat(*found)).alias("p"))
            .select("__row", "p.label", "p.at"))


def _stand_at(words: list[str], place: Column) -> Column:
    same = [F.get("__words", place - 1 + n) == w for n, w in enumerate(words)]
    whole = same[0]
    for more in same[1:]:
        whole = whole & more
    return F.coalesce(whole, F.lit(False))


def license_labels(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its words, the places of the phrases, its labels and a score.

    The score is 1 where a phrase names the licence, else the share (by weight) of the
    rare words of the best verified template, else 0. Labels are distinct, sorted and
    joined by commas, empty if there are none; ``first_word`` and ``last_word`` are null
    then. Null texts count as empty; rows with null or repeated ids are rows of their
    own. An empty table gives no rows. Other columns are not read.
    """
    files = file_words(docs, None, id_column, text_column)
    base = phrase_places(files).groupBy("__row").agg(
        F.count("*").alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"),
        F.collect_set("label").alias("__base"))
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    method = template_matches(files).groupBy("__row").agg(
        F.max("share").alias("__share"), F.collect_set(F.element_at(names, F.col("template") + 1)).alias("__found"))
    nothing = F.array().cast("array<string>")
    labels = F.array_join(F.array_sort(F.array_union(F.coalesce("__base", nothing), F.coalesce("__found", nothing))), ",")
    return (files.select("__row", "__id", "n_words").join(base.join(method, "__row", "full"), "__row", "left").select(
        F.col("__id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word", "last_word", F.array_join(F.array_sort(F.coalesce("__base", nothing)), ",").alias("base_labels"),
        labels.alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__share", F.lit(0.0))).alias("score")))
