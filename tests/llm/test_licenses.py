import math
import random
import re

import duckdb

from graphloom.llm import licenses, oracles, queries

from .helpers import empty

FILES = "doc_id long, path string, text string"
MIT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2019, Some Group
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of Some Group nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

  ... use the GNU Lesser General Public License instead of this License.
"""
GPL_HEADER = """# A tool.
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
import os
"""
APACHE_HEADER = """/*
 * Copyright 2015 The Group
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
package x;
"""


def scan(spark, rows):
    return {r.file_id if r.file_id is not None else -1: (r.license, r.origin, r.licensed_by) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}


def test_headers_files_and_inheritance(spark):
    got = scan(spark, [
        (1, "lib/LICENSE", MIT), (2, "lib/a/b/c.txt", "words only"), (3, "lib/a/d.txt", "x\n# Licensed under the Apache License, Version 2.0.\n" + "y " * 30), (4, "lib/a/b/COPYING", GPL_TEXT),
        (5, "other/e.txt", "nothing"), (6, None, "nothing"), (7, "lib2/f.txt", "x"), (8, "top.txt", None), (9, "lib/g.txt", ""), (10, "lib/h.txt", "my driving license is blue and the sea is far away from any of the terms"), (9, "lib/g.txt", ""), (None, "lib/i.txt", "z"),
        (11, "tools/t.py", GPL_HEADER), (12, "tools/u.java", APACHE_HEADER), (13, "tools/v.c", "/* SPDX-License-Identifier: MIT */\nint x;"), (14, "tools/w.rs", "// SPDX-License-Identifier: GPL-2.0-or-later\n"), (15, "b/LICENSE.txt", BSD), (16, "b/x/y", "q"),
        (17, "tools/z", "Copyright (c) 2020 Foo Inc. All rights reserved.\nint main"), (18, "m/LICENSE", "Mozilla Public License Version 2.0\n=====\n\n1. Definitions\n"), (19, "tools/aa", "Apache License"), (20, "tools/ab", "GNU GENERAL PUBLIC LICENSE"),
        (21, "tools/only.txt", "Released under the MIT License."), (22, "tools/none.txt", "w"),
    ])
    assert got == {
        1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "lib/a/b"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "file", None), 5: (None, "none", None), 6: (None, "none", None), 7: (None, "none", None),
        8: (None, "none", None), 9: ("MIT", "inherited", "lib"), 10: ("MIT", "inherited", "lib"), -1: ("MIT", "inherited", "lib"), 11: ("GPL-3.0", "header", None), 12: ("Apache-2.0", "header", None), 13: ("MIT", "header", None),
        14: ("GPL-2.0", "header", None), 15: ("BSD-3-Clause", "file", None), 16: ("BSD-3-Clause", "inherited", "b"), 17: ("proprietary", "header", None), 18: ("MPL-2.0", "file", None), 19: ("Apache-2.0", "header", None), 20: ("GPL", "header", None),
        21: ("MIT", "header", None), 22: (None, "none", None),
    }


def test_root_votes_and_absolute_paths(spark):
    got = scan(spark, [
        (1, "/LICENSE", "All rights reserved"), (2, "/a/b", "x"), (3, "LICENSE", "Licensed under CC BY-NC 4.0."), (4, "x/y/z.txt", "w"), (5, "v/LICENSE", "Released under the MIT License."), (6, "v/LICENSE-2", "Released under the MIT License."),
        (7, "v/NOTICE", "Licensed under CC BY 4.0"), (8, "v/w/x.txt", "t"), (9, "k.txt", "All rights reserved. " + "licensed words " * 20_000),
    ])
    assert got[2] == ("CC-BY-NC-4.0", "inherited", "") and got[4][0] == "CC-BY-NC-4.0" and got[8] == ("MIT", "inherited", "v") and got[7][0] == "CC-BY-4.0"
    assert licenses.scan(empty(spark, FILES)).count() == 0


def test_every_template_is_found(spark):
    rows = [(i, f"f{i}", " ".join(form) + "\n" + "other words " * 50) for i, (_, form, _) in enumerate(licenses.forms())]
    got = scan(spark, rows)
    assert [got[i][0] for i in range(len(rows))] == [name for name, _, _ in licenses.forms()]


def test_clashing_columns_nulls_and_long_lines(spark):
    rows = [(1, "a/LICENSE", MIT), (2, "a/b", None), (2, "a/b", None), (None, None, None), (3, "a/c", "License " + "word license " * 100_000), (4, "d", " ".join(f"w{i}" for i in range(200_000)) + " license"), (5, "e", "")]
    df = spark.createDataFrame(rows, FILES).selectExpr("*", "1 AS named", "'x' AS license", "2 AS best", "'y' AS dir", "3 AS similarity", "4 AS n_words")
    got = sorted((str(r.file_id), r.license, r.origin) for r in licenses.scan(df).collect())
    assert got == [("1", "MIT", "file"), ("2", "MIT", "inherited"), ("2", "MIT", "inherited"), ("3", "MIT", "inherited"), ("4", None, "none"), ("5", None, "none"), ("None", None, "none")]


def test_anchors_lose_no_unit():
    """Whatever the counts are, a unit without an anchor stays below the threshold: the most it can reach is the other words' share."""
    g = random.Random(8)
    for texts in (0, 1, 50, 10**9):
        w = licenses.Weights(texts, {x: g.randint(0, texts) for x in licenses.vocabulary()})
        for (_, form, _), length in zip(licenses.forms(), w.length, strict=True):
            rest = [x for x in form if x not in w.anchors]
            assert math.sqrt(sum(w.idf[x] ** 2 for x in rest)) / length < licenses.THRESHOLD - 1e-6
        gate = re.compile(w.gate())
        assert all(gate.search(f"x {a}, y") and not (a.isalpha() and gate.search(f"z{a}z")) for a in w.anchors)


def test_licence_files_speak_for_documents(spark, tmp_path):
    """The registered query inherits from the nearest of two levels and by votes, and equals its SQL."""
    mit, by, isc = "Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under the ISC license."
    rows = [(10, mit, "en", "a"), (20, mit, "fr", "a"), (30, by, "en", "a"), (5, isc, "fr", "a"), (1, "words", "en", "a"), (2, "words", "fr", "a"), (3, by, "fr", "a"), (4, None, None, "a"), (6, "words", "en", "b"), (15, "words", "en", "a"), (None, "words", "en", "a"), (7, "x", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_license_tree(spark, str(tmp_path))
    found = {r.doc_id: (r.license, r.origin, r.licensed_by) for r in got.collect()}
    assert found == {
        10: ("MIT", "file", None), 20: ("MIT", "file", None), 30: ("CC-BY-4.0", "file", None), 5: ("ISC", "file", None), 1: ("MIT", "inherited", "a"), 2: ("ISC", "inherited", "a/fr"), 3: ("CC-BY-4.0", "header", None),
        4: ("MIT", "inherited", "a"), 6: (None, "none", None), 15: ("MIT", "inherited", "a"), None: ("MIT", "inherited", "a"), 7: (None, "none", None),
    }
    for tables, files in ((str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet"), ("/root/testdata/sf0.001", "/root/testdata/sf0.001/documents.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        want = con.execute(oracles.op10_tree())
        got = queries.op10_license_tree(spark, tables)
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
        assert got.where("origin = 'inherited'").count() > 0
