"""License scans, in DataFrame expressions only.

A header segment is a line with a license cue. Segments and templates become sparse TF-IDF vectors (document frequencies
over all segments) and a segment takes the template of the highest cosine, if that is ``least_cosine`` or more. So that neither a line break nor prose around a notice hides it, windows
of the text are segments too: around each word that a template has for a cue, as far before and after as the template goes.
A window meets templates of its own length only; one within a line of a single word more is left to the line. Each text
with a cue is also compared as a whole with whole licence texts, as TF-IDF vectors of word pairs (document frequencies over
the licence texts, so that a file's cosine does not depend on the other files). A file that is a licence text takes that
license, else its best segment's. A licence file is a licence text or a file that consists of such segments mostly. A file
without a license inherits from the nearest ancestor directory that holds a licence file, found by joining directories with
their ancestors.

Edge cases: a null or empty text has no segment. A null path is in no directory and inherits nothing. Files that repeat
are judged alike. Of equal cosines the template first by name wins; of several licence files in a directory the license
that most of them carry, then the first by name. Without any segment, nothing has a license. Other columns pass through;
input columns named license, cosine or found_in are replaced.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.llm.frames import Scratch, col, free_name

#: Notices by which licenses are declared, in the words of their stewards or of common use.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright and related rights"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Between two words of a cue a line may end and a comment's mark may stand.
CUE = r"(?i)licen[cs]e|spdx|copyright|permission[^a-z0-9]+(is[^a-z0-9]+hereby|to[^a-z0-9]+use)|public[^a-z0-9]+domain|all[^a-z0-9]+rights[^a-z0-9]+reserved"
#: Words that windows are laid around.
ANCHOR = r"licen[cs]e|spdx|copyright|^permission$|^domain$"
TOKEN = r"[^a-z0-9.+]+"
LEAST_COSINE = 0.7
#: Share of a file's words in segments from which it is a licence file.
LICENCE_FILE = 0.5
#: Words of segments up to which their weights are broadcast (some 50 bytes each).
BROADCAST_WORDS = 200_000
#: Directories up to which their licenses are broadcast (some 150 bytes each).
BROADCAST_DIRECTORIES = 50_000


def tokens(text: Column) -> Column:
    """Lower-case words, digits with inner dots; dots at a word's end are dropped."""
    plain = F.regexp_replace(F.lower(text), r"\.+(?=[^a-z0-9]|$)", "")
    return F.filter(F.split(plain, TOKEN), lambda x: x != "")


def licence_texts() -> list[tuple[str, str]]:
    """(name, text) of the whole licence texts that come with the package."""
    found = [x for x in resources.files("twinfold.llm").joinpath("licence_texts").iterdir() if x.name.endswith(".txt")]
    return sorted((x.name.removesuffix(".txt"), x.read_text(encoding="utf-8")) for x in found)


def pairs(words: Column) -> Column:
    """Each word with the next one."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def whole_texts(files: DataFrame, key: str, text_col: str, least_cosine: float, texts: list[tuple[str, str]]) -> DataFrame:
    """key, whole (name, cosine): the files that are a licence text as a whole."""
    spark = files.sparkSession
    bags = spark.createDataFrame(texts, "name string, words string").select("name", pairs(tokens(F.col("words"))).alias("tokens"))
    seen = bags.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf, rare = F.broadcast(seen.select("token", (F.log((1 + F.lit(len(texts))) / (1 + F.col("df"))) + 1).alias("idf"))), F.log(1 + F.lit(float(len(texts)))) + 1
    known = weighed(bags, ["name"], idf, rare).groupBy("token").agg(*[F.sum(F.when(F.col("name") == n, F.col("weight")).otherwise(0.0)).alias(f"t{k}") for k, (n, _) in enumerate(texts)])
    # dealt by file first, so that a file's pairs are counted and summed where they are
    dealt = files.repartition(col(key)).select(col(key), F.explode(pairs(tokens(col(text_col)))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    raw = dealt.join(F.broadcast(known), "token", "left").join(idf, "token", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", rare))
    sums = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), *[F.sum(F.col("weight") * F.col(f"t{k}")).alias(f"t{k}") for k in range(len(texts))])
    each = [F.struct((-F.round(F.coalesce(F.col(f"t{k}"), F.lit(0.0)) / F.col("norm"), 9)).alias("far"), F.lit(n).alias("name")) for k, (n, _) in enumerate(texts)]
    best = sums.select(col(key), F.array_min(F.array(*each)).alias("best")).filter(-F.col("best.far") >= least_cosine)
    return best.select(col(key), F.struct(F.col("best.name").alias("name"), (-F.col("best.far")).alias("cosine")).alias("whole"))


def lines_in(files: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, start, words, cue, tokens: the lines that have words; start is the place of the first among the text's words."""
    lines = files.select(col(key), F.posexplode(F.split(col(text_col).cast("string"), "\n")).alias("at", "line"))
    lines = lines.select(col(key), "at", F.col("line").rlike(CUE).alias("cue"), tokens(F.col("line")).alias("tokens")).withColumn("words", F.size("tokens")).filter("words > 0")
    before = Window.partitionBy(col(key)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("int")).select(col(key), "start", "words", "cue", "tokens")


def anchored(words: Column) -> Column:
    """Places of the words that windows are laid around."""
    return F.filter(F.transform(words, lambda x, i: F.when(x.rlike(ANCHOR), i)), lambda i: i.isNotNull())


def windows(files: DataFrame, lines: DataFrame, key: str, text_col: str, bags: DataFrame) -> DataFrame:
    """key, place, start, words, tokens: the windows around each anchor of the texts; ``bags`` are the templates."""
    reach = bags.select(F.explode(anchored(F.col("tokens"))).alias("b"), F.size("tokens").alias("n")).distinct().collect()  # bounded by the templates
    if not reach:
        return lines.select(col(key), F.lit(0).alias("place"), "start", "words", "tokens").limit(0)
    far = max(r["n"] for r in reach)
    reach = F.array(*[F.struct(F.lit(r["b"]).alias("b"), F.lit(r["n"]).alias("n")) for r in sorted(reach)])
    stream = files.select(col(key), tokens(col(text_col)).alias("all")).withColumn("size", F.size("all"))
    around = lambda i: F.struct(i.alias("place"), F.slice("all", F.greatest(i - far, F.lit(0)) + 1, F.lit(2 * far + 1)).alias("near"))
    stream = stream.select(col(key), "size", F.explode(F.transform(anchored(F.col("all")), around)).alias("x")).select(col(key), "size", "x.place", "x.near")
    owner = lines.select(col(key), F.explode(anchored(F.col("tokens"))).alias("i"), F.col("start").alias("line"), F.col("words").alias("wide")).withColumn("place", F.col("line") + F.col("i")).drop("i")
    each = stream.join(owner, [key, "place"]).select("*", F.explode(reach).alias("r")).withColumns({"start": F.col("place") - F.col("r.b"), "words": F.col("r.n")})
    each = each.filter((F.col("start") >= 0) & (F.col("start") + F.col("words") <= F.col("size")))
    within = (F.col("start") >= F.col("line")) & (F.col("start") + F.col("words") <= F.col("line") + F.col("wide"))
    each = each.filter(~within | (F.col("wide") >= F.col("words") + 2))
    first = F.col("start") - F.greatest(F.col("place") - far, F.lit(0)) + 1
    return each.select(col(key), "place", "start", "words", F.slice("near", first, F.col("words")).alias("tokens"))


def covered(spans: Column) -> Column:
    """How many words the spans (start, words) cover together."""
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], (x["start"] + x["words"]).cast("long"))
        return F.struct(end.alias("end"), (acc["sum"] + end - F.greatest(acc["end"], F.least(x["start"].cast("long"), end))).alias("sum"))

    return F.aggregate(F.array_sort(spans), none, add)["sum"]


def weighed(bags: DataFrame, by: list[str], idf: DataFrame, rare: Column) -> DataFrame:
    """by, token, weight: TF-IDF vectors of unit length. A token that no segment has weighs as the rarest."""
    counts = bags.select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("tf"))
    raw = counts.join(idf, "token", "left").select(*by, "token", (F.col("tf") * F.coalesce("idf", rare)).alias("weight"))
    norms = raw.groupBy(*by).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return raw.join(norms, by).select(*by, "token", (F.col("weight") / F.col("norm")).alias("weight"))


def directory(path: Column) -> Column:
    """Up to the last slash; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", least_cosine: float = LEAST_COSINE, templates=TEMPLATES) -> DataFrame:
    """The files with columns license, cosine and found_in (the file's own path, or the directory inherited from)."""
    spark: SparkSession = files.sparkSession
    scratch = Scratch(spark, "licenses")
    files = files.drop("license", "cosine", "found_in")
    key, own, near, here = (free_name(files, x) for x in ("text", "own", "near", "dir"))
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    # equal texts have equal segments, so that they are scanned once and joined by hash
    files = files.withColumn(key, F.sha2(text.cast("binary"), 256))
    cued = scratch.save(files.select(col(key), text.alias("text")).filter(F.col("text").rlike(CUE)).dropDuplicates([key]))
    lines = scratch.save(lines_in(cued, key, "text").filter(F.col("cue") | F.exists("tokens", lambda x: x.rlike(ANCHOR))))
    cut = lines.filter("cue")

    # a line that repeats across texts is compared once
    distinct = cut.select(F.array_join("tokens", " ").alias("segment"), "tokens").groupBy("segment").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    distinct = scratch.save(distinct)
    total = distinct.agg(F.sum("n")).first()[0] or 0
    bags = spark.createDataFrame([(k, name, words) for k, (name, words) in enumerate(templates)], "template int, name string, words string").select("template", "name", tokens(F.col("words")).alias("tokens"))
    seen = distinct.select("n", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.sum("n").alias("df"))
    idf = scratch.save(seen.select("token", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")))
    idf = F.broadcast(idf) if idf.count() <= BROADCAST_WORDS else idf
    rare = F.log(1 + F.lit(float(total))) + 1
    known = weighed(bags.select("template", "name", "tokens"), ["template", "name"], idf, rare).withColumnRenamed("weight", "their")
    dots = weighed(distinct, ["segment"], idf, rare).join(F.broadcast(known), "token").groupBy("segment", "template", "name").agg(F.sum(F.col("weight") * F.col("their")).alias("cosine"))
    first = F.struct(-F.round("cosine", 9), "name")
    best = dots.groupBy("segment").agg(F.min_by(F.struct("name", "cosine"), first).alias("best")).filter(F.col("best.cosine") >= least_cosine)
    best = scratch.save(best.select("segment", "best.name", "best.cosine"))
    judged = cut.withColumn("segment", F.array_join("tokens", " ")).join(best, "segment").select(col(key), "start", "words", "name", "cosine")

    laid = scratch.save(windows(cued, lines, key, "text", bags).withColumn("segment", F.array_join("tokens", " ")))
    sized = known.join(bags.select("template", F.size("tokens").alias("words")), "template")
    shapes = laid.groupBy("segment").agg(F.first("tokens").alias("tokens"), F.first("words").alias("words"))
    dots = weighed(shapes, ["segment", "words"], idf, rare).join(F.broadcast(sized), ["token", "words"]).groupBy("segment", "template", "name").agg(F.sum(F.col("weight") * F.col("their")).alias("cosine"))
    fits = dots.groupBy("segment").agg(F.min_by(F.struct("name", "cosine"), first).alias("best")).filter(F.col("best.cosine") >= least_cosine)
    fits = laid.join(scratch.save(fits.select("segment", "best.name", "best.cosine")), "segment")
    # of the windows around one word, the best one is the notice
    fits = fits.groupBy(key, "place").agg(F.min_by(F.struct("start", "words", "name", "cosine"), F.struct(-F.round("cosine", 9), "name", "start")).alias("x")).select(col(key), "x.*")
    per_text = judged.unionByName(fits).groupBy(key).agg(F.min_by(F.struct("name", "cosine"), first).alias("header"), covered(F.collect_list(F.struct("start", "words"))).alias("words"))
    per_text = per_text.join(cued.select(col(key), F.size(tokens(F.col("text"))).alias("all")), key)
    whole = whole_texts(cued, key, "text", least_cosine, licence_texts())
    per_text = per_text.join(whole, key, "full").select(
        col(key), F.coalesce("whole", "header").alias(own), (F.col("whole").isNotNull() | F.coalesce(F.col("words") >= LICENCE_FILE * F.col("all"), F.lit(False))).alias("holds")
    )
    per_text = scratch.save(per_text)

    slim = files.select(col(path_col).cast("string").alias("path"), col(key))
    holders = slim.join(per_text.filter("holds"), key).filter(F.col("path").isNotNull())
    by_dir = holders.groupBy(directory(F.col("path")).alias("dir"), F.col(f"`{own}`.name").alias("name")).agg(F.count("*").alias("n"), F.max(F.col(f"`{own}`.cosine")).alias("cosine"))
    by_dir = by_dir.groupBy("dir").agg(F.min_by(F.struct("name", "cosine"), F.struct(-F.col("n"), "name")).alias("held"))
    by_dir = scratch.save(by_dir)
    dirs = files.select(directory(col(path_col).cast("string")).alias("start")).filter("start is not null").distinct()
    parts = F.split("start", "/")
    ups = dirs.select("start", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "dir")).filter((F.col("dir") != "") | (F.col("depth") == 0))
    nearest = ups.join(by_dir, "dir").groupBy("start").agg(F.max_by(F.struct("held", "dir"), "depth").alias(near)).withColumnRenamed("start", here)
    nearest = scratch.save(nearest)

    files = files.withColumn(here, directory(col(path_col).cast("string"))).join(per_text.select(key, own), key, "left")
    files = files.join(F.broadcast(nearest) if nearest.count() <= BROADCAST_DIRECTORIES else nearest, here, "left")
    mine, theirs = col(own), col(near)
    files = files.withColumn("license", F.coalesce(mine["name"], theirs["held"]["name"])).withColumn("cosine", F.round(F.coalesce(mine["cosine"], theirs["held"]["cosine"]), 6))
    return files.withColumn("found_in", F.when(mine.isNotNull(), col(path_col).cast("string")).otherwise(theirs["dir"])).drop(key, own, near, here)
