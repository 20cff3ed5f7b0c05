"""License headers against a plain cosine, and inheritance along paths."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curata.llm.license_scan import ANCHORS, TEMPLATES, scan_licenses

SCHEMA = "doc_id long, path string, text string, license string"
FILES = [
    (1, "repo/LICENSE", "Released under the MIT License.\nSome more words follow here."),
    (2, "repo/src/a.py", "x = 1\ny = 2"),
    (3, "repo/src/vendor/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (4, "repo/src/vendor/deep/b.py", "nothing here"),
    (5, "repo/src/c.py", "# Licensed under the Apache License, Version 2.0 (the \"License\");\ncode"),
    (6, "other/d.py", "free text about a license that is no header at all and goes on about other things"),
    (7, "other/e.py", None),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, "solo/notes", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    (10, "solo/deep/down/x", ""),
    (10, "solo/deep/down/x", ""),
]


def words(t):
    return [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]


def plain(files, threshold):
    """{(doc_id, text): (license, line)} by comparing every header with every statement."""
    vocab = {w for _, t in TEMPLATES for w in words(t)}
    n = len(files)
    df = Counter(w for _, _, t, _ in files for w in set(words(t or "")) & vocab)
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1
    out = {}
    for i, _, text, _ in files:
        best = None
        every = (text or "").split("\n")
        units, block = [(k, h) for k, h in enumerate(every)], []
        for k, h in [*enumerate(every), (0, "")]:
            if words(h):
                block.append((k, h))
            elif block:
                units += [(block[0][0], "\n".join(x for _, x in block))] if len(block) > 1 else []
                block = []
        units += [(0, text)] if sum(bool(words(h)) for h in every) > 1 else []
        for line, h in units:
            if re.search(ANCHORS, h):
                a = {w: c * idf(w) for w, c in Counter(words(h)).items()}
                for name, t in TEMPLATES:
                    b = {w: c * idf(w) for w, c in Counter(words(t)).items()}
                    dot = sum(v * b.get(w, 0) for w, v in a.items())
                    score = round(dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 6)
                    if score >= threshold:
                        best = min(best or (9,), (-score, line, name))
        out[i, text] = best and (best[2], best[1])
    return out


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(*f, "clash") for f in FILES], SCHEMA)
    return scan_licenses(files, path=F.col("path")).collect()


def test_own_license(found):
    expected = plain([(*f, "") for f in FILES], 0.6)
    texts = {f[0]: f[2] for f in FILES}
    for r in found:
        assert (r.own_license and (r.own_license, r.line)) == expected[r.doc_id, texts[r.doc_id]], r


def test_inheritance(found):
    got = {r.doc_id: (r.license, r.from_dir) for r in found}
    assert got == {1: ("MIT", None), 2: ("MIT", "repo"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", "repo/src/vendor"), 5: ("Apache-2.0", None), 6: (None, None), 7: (None, None),
                   8: ("CC-BY-NC-4.0", None), 9: (got[9][0], None), 10: (got[9][0], "solo")}
    assert got[9][0] in ("CC-BY-NC-4.0", "MIT") and len(found) == len(FILES)


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA), path=F.col("path")).collect() == []


# How license files of projects begin or read; wrapped as they are published.
MIT = """MIT License

Copyright (c) 2024 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License."""
GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works."""
GPL2 = GPL3.replace("Version 3, 29 June 2007", "Version 2, June 1991").split("                            Preamble")[0] + """
  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users."""
MPL = """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software."""
BSD3 = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
WRAPPED = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0

import os
"""


def test_license_files_and_wrapped_headers(spark):
    """Published license files are found and hold for their directories; a body counts under any name."""
    texts = {"mit": MIT, "apache": APACHE, "gpl3": GPL3, "gpl2": GPL2, "mpl": MPL, "bsd": BSD3}
    files = [(i, f"{d}/LICENSE", t) for i, (d, t) in enumerate(texts.items())] + [(100 + i, f"{d}/src/x.py", "x = 1") for i, d in enumerate(texts)]
    files += [(200, "w/a.py", WRAPPED), (201, "body/terms.txt", MIT), (202, "body/x", None), (203, None, GPL3), (204, "tie/COPYING", MPL), (205, "tie/LICENSE", MPL), (206, "tie/x", ""),
              (207, "long/x", "word " * 30_000 + "\n\nReleased under the MIT License.\n\n" + "more " * 30_000)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").repartition(3)
    got = {r.doc_id: r for r in scan_licenses(df, path=F.col("path")).collect()}
    want = {"mit": "MIT", "apache": "Apache-2.0", "gpl3": "GPL-3.0", "gpl2": "GPL-2.0", "mpl": "MPL-2.0", "bsd": "BSD-3-Clause"}
    for i, d in enumerate(texts):
        assert got[i].own_license == want[d], (d, got[i])
        assert (got[100 + i].license, got[100 + i].from_dir) == (want[d], d)
    assert got[200].own_license == "Apache-2.0" and (got[202].license, got[202].from_dir) == ("MIT", "body")
    assert got[203].own_license == "GPL-3.0" and got[203].from_dir is None and (got[206].license, got[206].from_dir) == ("MPL-2.0", "tie") and got[207].own_license == "MIT"
