"""License scan: sparse TF-IDF cosine of headers and license texts to templates, then inheritance from the nearest directory.

Three units of a text are compared with the templates: every line with one of the anchor words, every paragraph (lines between
blank ones) that holds such a line, so that wrapped headers count, and the whole text if it has such a line.  Templates are the statements and
paragraphs by which licenses are named and granted, and, for whole texts, the bodies of short licenses.  The score is the cosine
of the TF-IDF vectors, with document frequencies of the templates' words counted
over all texts (a word that no template has weighs like one that no document has).  The dot
products come from an inverted index: words of units join words of templates.  A unit speaks for
the license of the nearest template (equal scores: the first in text order) if the cosine reaches
``threshold``; a file's own license is that of its best unit (then of the first line).

A license file is one named like LICENSE or COPYING, or one of whose written lines more than half
are license headers, or one that is a license body as a whole.  Its license holds for its directory and everything below: a file without
own license takes that of the nearest ancestor directory that has one.  Distinct directories are
joined with their ancestors, so the work grows with the directories and not with the files in them.

Everything is DataFrame operations.  Defined results: null and empty texts have no own license; a null path
is in no directory; several license files of one directory: the highest score, then the first path;
repeated rows are answered each (rows that share path and text share everything); texts are read whole; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.llm.common import ascii_lower
from curata.session import checkpointed

# Statements by which texts name their license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the license file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or at your option any later version of the GNU General Public License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain without a license"),
]
# Paragraphs of license texts, in the order in which the texts have them.
PARAGRAPHS = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": [
        "BSD 2-Clause License"],
    "BSD-3-Clause": [
        "BSD 3-Clause License"],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
_BSD = ("Copyright (c) <year>, <owner> All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
            "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
            "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
          "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
# Bodies of short licenses, whole.
BODIES = {
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                            "without specific prior written permission. ") + _BSD_END,
    "ISC": ("Copyright (c) <year>, <owner> Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
            "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
            "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "MIT": ("MIT License Copyright (c) <year> <owner> Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ") + _AS_IS,
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
                  "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
                  "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit "
                  "of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present "
                  "and future rights to this software under copyright law. ") + _AS_IS.replace("OR COPYRIGHT HOLDERS ", "")
                 + " For more information, please refer to <http://unlicense.org/>",
}
TEMPLATES += [(name, p) for name, own in PARAGRAPHS.items() for p in own] + list(BODIES.items())
WHOLE = frozenset(BODIES)       # licenses that a whole text can be
ANCHORS = r"(?i)licen[cs]e|copyright|redistribution|permission is hereby"
SALTS = 32            # parts of a directory's files
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def templates_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, word, tf)."""
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, statement string")
    return table.select("template", "license", F.explode(words_of(F.col("statement"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))


def word_weights(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, idf) of the templates' words and, with a null word, the weight of all others."""
    spark = texts.sparkSession
    known = F.array(*(F.lit(r.word) for r in vocabulary.select("word").distinct().orderBy("word").collect()))      # bounded by the templates
    has = texts.select(F.explode(F.array_append(F.array_intersect(words_of(F.coalesce("text", F.lit(""))), known), F.lit(None).cast("string"))).alias("word"))
    counted = {r.word: r.n for r in has.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = counted.pop(None, 0)
    return (vocabulary.select("word").distinct().unionByName(spark.createDataFrame([(None,)], "word string"))
            .join(F.broadcast(spark.createDataFrame([*counted.items()], "word string, df long")), "word", "left")
            .select("word", (F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")))


def header_licenses(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(row, line, unit, license, score) of the units that speak for a license; files have (row, text)."""
    statements = templates_table(files.sparkSession, templates)
    idf = word_weights(files, statements)
    index = statements.join(idf, "word").select("template", "license", "word", (F.col("tf") * F.col("idf")).alias("weight"))
    index = index.join(index.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm")), "template").select("template", "license", "word", (F.col("weight") / F.col("norm")).alias("weight"))
    index = checkpointed(index, "licenseindex")          # one row per template and word
    idf = checkpointed(idf, "licenseidf")
    other = idf.where(F.col("word").isNull()).first()["idf"]
    units = checkpointed(units_of(files).withColumn("key", F.sha2("text", 256)), "licenseunits")       # texts and parts of texts with an anchor
    # equal units are judged once; from here on a unit is its hash
    words = units.select("key", "text").dropDuplicates(["key"]).select("key", F.explode(words_of(F.col("text"))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))
    weighed = words.join(F.broadcast(idf.where(F.col("word").isNotNull())), "word", "left").select("key", "word", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("w"))
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = weighed.join(F.broadcast(index), "word").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = (dots.join(norm, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
            .groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("b")).select("key", "b.license", (-F.col("b.score")).alias("score")))
    return units.select("row", "line", "unit", "key").join(best, "key").select("row", "line", "unit", "license", "score")


def units_of(files: DataFrame) -> DataFrame:
    """(row, line, unit, text): the lines with an anchor, the paragraphs of several lines that hold one, and the whole texts of
    several paragraphs; ``line`` is where a unit starts.  Files are (row, text), each row once."""
    anchored = checkpointed(files.where(F.col("text").rlike(ANCHORS)).dropDuplicates(["row"]), "licensetexts")
    lines = anchored.select("row", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    blank = ~F.col("text").rlike(r"[A-Za-z0-9]")
    block = lines.withColumn("block", F.count_if(blank).over(Window.partitionBy("row").orderBy("line"))).where(~blank)      # the lines of one text
    paragraphs = (block.groupBy("row", "block").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n"))
                  .where((F.col("n") > 1) & F.col("text").rlike(ANCHORS)).select("row", "line", F.lit("paragraph").alias("unit"), "text"))
    whole = anchored.where(F.col("text").rlike(r"[A-Za-z0-9][^\n]*\n(?s:.*)[A-Za-z0-9]")).select("row", F.lit(0).alias("line"), F.lit("whole").alias("unit"), "text")
    return lines.where(F.col("text").rlike(ANCHORS)).select("row", "line", F.lit("line").alias("unit"), "text").unionByName(paragraphs).unionByName(whole)


def scan_licenses(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """(doc_id, path, own_license, score, line, license, from_dir): own license, and the one that holds (from_dir: null if own)."""
    path = F.lit(None).cast("string") if path is None else path
    base = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    base = base.withColumn("row", F.xxhash64("doc_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = checkpointed(header_licenses(base.select("row", "text"), templates, threshold).distinct(), "licenseheaders")
    own = found.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("score"), "line", "license")).alias("o"), F.count_if(F.col("unit") == "line").alias("headers"),
                                   F.count_if((F.col("unit") == "whole") & F.col("license").isin(*WHOLE)).alias("bodies"))
    name, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    # texts stay here: only what the rest needs goes on
    narrow = base.select("row", "doc_id", "path", folder.alias("dir"), F.when(F.col("text").rlike(ANCHORS), F.regexp_count("text", F.lit(r"(?m)^.*\S.*$"))).alias("written"))
    known = narrow.join(own, "row", "left").select("doc_id", "path", "dir", F.col("o.license").alias("own_license"), (-F.col("o.score")).alias("score"), F.col("o.line").alias("line"),
                                                  (F.col("o").isNotNull() & (name.rlike(LICENSE_NAMES) | (2 * F.col("headers") > F.col("written")) | (F.col("bodies") > 0))).alias("governs"))
    known = checkpointed(known, "licensefiles")
    governing = (known.where(F.col("governs") & F.col("path").isNotNull()).groupBy("dir")
                 .agg(F.min(F.struct((-F.col("score")).alias("score"), "path", "own_license"))["own_license"].alias("license")))
    folders = known.where(F.col("path").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    above = folders.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select(
        "dir", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.col("depth"), F.lit(1))), "/")).alias("ancestor"))
    nearest = (above.join(governing.select(F.col("dir").alias("ancestor"), "license"), "ancestor").groupBy("dir")
               .agg(F.max(F.struct("depth", "license", "ancestor")).alias("g")).select("dir", F.col("g.license").alias("given"), F.col("g.ancestor").alias("from")))
    # a directory may hold a large part of all files: its files are dealt over SALTS tasks
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)))
    copies = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["dir", "salt"], "left").select(
        "doc_id", "path", "own_license", "score", "line", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("from")).alias("from_dir"))
