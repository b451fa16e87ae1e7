"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A text is compared in units: its windows of one to WINDOW lines, its blocks (runs of lines with words), and, of a licence
file, the whole text. A unit's vector holds each of its different words once, weighed by the inverse document frequency
over all texts scanned; words that no template has weigh as the mean of the others, years are no words. A text takes
the license of its best unit by cosine to the templates, if that reaches THRESHOLD; of equal ones (to 6 digits) that of
the longer template, then the smaller name. What several licenses say, and last a bare reservation of rights, stand behind all others.

Only units that hold an anchor are looked at, and that loses none: the anchors are chosen from the weights so that of every
template the other words have less than THRESHOLD squared of its squared length, and by Cauchy's inequality a unit
without an anchor stays below THRESHOLD.

A licence file (name LICENSE, LICENCE, UNLICENSE, COPYING or NOTICE with any suffix) with a license of its own speaks for its
directory: files without one inherit from the nearest ancestor directory that has one, by one join on the paths of all
ancestors (a row for each directory and ancestor, so bytes grow with the square of the depth). Where licence files of one directory differ, the license of most of
them holds, of equally many the smaller name.

Templates are paragraphs and titles of license texts and short statements, a bounded list; what reaches the driver is one
count for each of their words. Only DataFrame operations are used. Null or empty texts have no license of their own;
null paths have no directory and inherit nothing; paths may be relative or start with a slash. Very long lines are one
line. Repeated rows get equal results and count once each where licence files differ. Extra columns don't matter.
Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.cluster import written

THRESHOLD = 0.75
WINDOW = 4
RESERVED = "proprietary"
_NOTICE = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version {2} of the license or at your option any later version"
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_REDISTRIBUTION = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
#: How licenses are stated, as titles, paragraphs of their texts and of headers, and short statements.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "apache license version 2.0 january 2004 http www apache org licenses", "apache license version 2.0", "apache license", "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "MIT": ("mit license", "the mit license mit", "released under the mit license", "licensed under the mit license", "distributed under the terms of the mit license", _GRANT),
    "ISC": ("isc license", "licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "BSD-2-Clause": ("bsd 2 clause license", "licensed under the bsd 2 clause license", _REDISTRIBUTION),
    "BSD-3-Clause": (
        "bsd 3 clause license", "licensed under the bsd 3 clause license", "redistributed under the bsd 3 clause license",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "GPL": ("gnu general public license", "licensed under the gnu general public license"),
    "GPL-2.0": ("gnu general public license version 2 june 1991", "licensed under the gnu general public license version 2", _NOTICE.format("program", "", "2")),
    "GPL-3.0": ("gnu general public license version 3 29 june 2007", "licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3", _NOTICE.format("program", "", "3")),
    "LGPL-2.1": ("gnu lesser general public license version 2.1 february 1999", "licensed under the gnu lesser general public license version 2.1", _NOTICE.format("library", "lesser ", "2.1")),
    "LGPL-3.0": ("gnu lesser general public license", "gnu lesser general public license version 3 29 june 2007", "licensed under the gnu lesser general public license version 3", _NOTICE.format("library", "lesser ", "3")),
    "AGPL-3.0": ("gnu affero general public license", "gnu affero general public license version 3 19 november 2007", "licensed under the gnu affero general public license version 3", _NOTICE.format("program", "affero ", "3")),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    "CC-BY-4.0": ("licensed under cc by 4.0", "creative commons attribution 4.0 international", "licensed under the creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 international", "licensed under the creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international", "licensed under the creative commons attribution noncommercial 4.0 international license"),
    "CC0-1.0": ("cc0 1.0 universal", "creative commons legal code cc0 1.0 universal", "released under cc0 1.0"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    RESERVED: ("all rights reserved", "copyright c all rights reserved"),
}

#: Licenses and paragraphs that stand behind others: what several licenses say, and a bare reservation.
_BEHIND = {_REDISTRIBUTION: 1, RESERVED: 2}

WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
_YEAR = r"^(?:19|20)[0-9]{2}$"
NAMED = r"(?i)^(licen[cs]e|unlicen[cs]e|copying|notice)([._-].*)?$"
BLANK_LINES = r"\n(?:[^a-z0-9\n]*\n)+"


def words_of(line: str) -> list[str]:
    """Lower-case letters and digits; a dot within a number stays; years are left out."""
    return [w for w in re.findall(WORD, line.lower()) if not re.match(_YEAR, w)]


@cache
def forms() -> list[tuple[str, tuple[str, ...], int]]:
    """(license, different words, what it stands behind) of every template; SPDX lines are made by rule."""
    out = []
    for name, texts in TEMPLATES.items():
        ids = () if name == RESERVED else (name, f"{name}-only", f"{name}-or-later") if "GPL" in name else (name,)
        for text in (*texts, *(f"spdx license identifier {x}" for x in ids)):
            out.append((name, tuple(dict.fromkeys(words_of(text))), _BEHIND.get(text, _BEHIND.get(name, 0))))
    return out


@cache
def vocabulary() -> list[str]:
    return sorted({w for _, form, _ in forms() for w in form})


def frequencies(files: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """(texts, texts that hold a word of the templates): partial counts by word, a row for each word to the driver."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(WORD), F.lit(0)))
    known = F.filter(words, lambda w: w.isin(vocabulary()))
    # a null word counts the texts
    each = files.where(F.col(f"`{text}`").isNotNull()).select(F.explode(F.array_append(known, F.lit(None).cast("string"))).alias("word"))
    found = {r.word: r.n for r in each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.pop(None, 0), found


class Weights:
    """Inverse document frequencies, the templates' lengths, and the anchors that they prove enough."""

    def __init__(self, texts: int, counts: dict[str, int], threshold: float = THRESHOLD) -> None:
        self.idf = {w: math.log((1 + texts) / (1 + counts.get(w, 0))) + 1 for w in vocabulary()}
        self.unknown = sum(self.idf.values()) / len(self.idf)
        self.threshold = threshold
        self.length = [math.sqrt(sum(self.idf[w] ** 2 for w in form)) for _, form, _ in forms()]
        chosen: set[str] = set()
        shared = Counter(w for _, form, _ in forms() for w in form)
        for (_, form, _), length in zip(forms(), self.length, strict=True):
            rest = sorted((w for w in form if w not in chosen), key=lambda w: (self.idf[w], shared[w], w))
            # a hair less, so that rounding to 6 digits can't undo the proof
            while sum(self.idf[w] ** 2 for w in rest) >= threshold**2 * length**2 * (1 - 1e-5):
                chosen.add(rest.pop())
        self.anchors = sorted(chosen)

    def gate(self) -> str:
        """What a lower-case text matches if it holds an anchor as a word."""
        # one look back for all of them, so that the list is tried at the starts of words only
        letters, digits = [w for w in self.anchors if w.isalpha()], [re.escape(w) for w in self.anchors if not w.isalpha()]
        some = [rf"(?<![a-z])(?:{'|'.join(letters)})(?![a-z])"] if letters else []
        return "|".join(some + ([rf"(?<![0-9.])(?:{'|'.join(digits)})"] if digits else []))


def scan(files: DataFrame, file_id: str = "doc_id", path: str | Column = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """file_id, path, own_license, similarity (6 digits), license, origin: 'header', 'file', 'inherited' or 'none', licensed_by (directory)."""
    at = F.col(f"`{path}`") if isinstance(path, str) else path
    weights = Weights(*frequencies(files, text), threshold)
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(NAMED), F.lit(False))
    rows = files.select(F.col(f"`{file_id}`").alias("file_id"), at.alias("path"), F.lower(F.col(f"`{text}`")).alias("text")).withColumn("named", named)
    # the license of a text depends on the text and its name alone and is found where it is read: no shuffle of texts
    anchored = F.exists(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: w.isin(weights.anchors))
    best = _best(F.when(anchored, _units(F.col("text"), F.col("named"), weights.gate())), weights)
    found = rows.withColumn("best", best).select(
        "file_id", "path", F.col("best.name").alias("own_license"), (-F.col("best.minus")).alias("similarity"), (F.col("named") & F.col("best").isNotNull()).alias("speaks"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
    )
    own = written(found)  # small, and read three times
    votes = own.where("speaks and path is not null").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    first = Window.partitionBy("dir").orderBy(F.desc("n"), "own_license")
    spoken_for = votes.withColumn("rank", F.row_number().over(first)).where("rank = 1").select(F.col("dir").alias("licensed_by"), F.col("own_license").alias("inherited"))
    # the nearest licensed ancestor of each directory, not of each file: one row per directory and ancestor
    folders = own.where("path is not null and own_license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")))
    climb = folders.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.ancestor").where("depth > 0 or not startswith(dir, '/')")
    near = climb.join(spoken_for, F.col("ancestor") == F.col("licensed_by")).groupBy("dir").agg(F.max_by(F.struct("licensed_by", "inherited"), "depth").alias("near"))
    # written, so that the join has a plain exchange on either side and adaptive execution can split a hot directory
    out = own.join(written(near), "dir", "left")
    return out.select(
        "file_id", "path", "own_license", "similarity", F.coalesce("own_license", F.when(F.col("path").isNotNull(), F.col("near.inherited"))).alias("license"),
        F.when(F.col("own_license").isNotNull(), F.when(F.col("speaks"), "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own_license").isNull(), F.col("near.licensed_by")).alias("licensed_by"),
    )


def _units(text: Column, named: Column, gate: str) -> Column:
    """The word lists of the units of a lower-case text that hold an anchor."""
    words = lambda x: F.filter(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), lambda w: ~w.rlike(_YEAR))
    lines = F.split(text, "\n", -1)
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(gate), i)), lambda i: i.isNotNull())
    spans = F.flatten(
        F.transform(
            hits,
            lambda i: F.flatten(F.transform(F.sequence(F.greatest(F.lit(0), i - (WINDOW - 1)), i), lambda s: F.transform(F.sequence(i - s + 1, F.lit(WINDOW)), lambda n: F.struct(s.alias("s"), n.alias("n"))))),
        )
    )
    # a window that runs over the end is the same as one that ends there
    windows = F.transform(F.array_distinct(spans), lambda x: F.array_join(F.slice(lines, x["s"] + 1, x["n"]), "\n"))
    blocks = F.filter(F.split(text, BLANK_LINES, -1), lambda b: b.rlike(gate))
    return F.transform(F.array_distinct(F.concat(windows, blocks, F.when(named, F.array(text)).otherwise(F.array().cast("array<string>")))), lambda u: F.array_distinct(words(u)))


def _best(units: Column, weights: Weights) -> Column:
    """(behind, minus: the similarity, minus_words, name) of the best template of all units; null if none reaches the threshold."""
    place = {w: i for i, w in enumerate(vocabulary())}
    table = []
    for (name, form, behind), length in zip(forms(), weights.length, strict=True):
        row = [0.0] * len(place)
        for w in form:
            row[place[w]] = weights.idf[w] ** 2
        table.append({"name": name, "behind": behind, "words": len(form), "length": length, "row": row})
    templates = F.from_json(F.lit(json.dumps(table)), "array<struct<name:string,behind:int,words:int,length:double,row:array<double>>>")
    squares = F.from_json(F.lit(json.dumps([weights.idf[w] ** 2 for w in vocabulary()])), "array<double>")
    known_words = F.split(F.lit(" ".join(vocabulary())), " ")
    total = lambda places, of: F.aggregate(places, F.lit(0.0), lambda s, p: s + F.element_at(of, p))

    def judged(places: Column, n: Column) -> Column:
        norm = F.sqrt(total(places, squares) + (n - F.size(places)) * F.lit(weights.unknown**2))
        every = F.transform(templates, lambda t: F.struct(t["behind"].alias("behind"), F.round(-total(places, t["row"]) / (norm * t["length"]), 6).alias("minus"), (-t["words"]).alias("minus_words"), t["name"].alias("name")))
        return F.array_min(F.filter(every, lambda x: x["minus"] <= -weights.threshold))

    placed = F.transform(units, lambda u: F.struct(F.filter(F.transform(u, lambda w: F.array_position(known_words, w).cast("int")), lambda p: p > 0).alias("places"), F.size(u).alias("n")))
    return F.array_min(F.transform(F.filter(placed, lambda u: F.size(u["places"]) > 0), lambda u: judged(u["places"], u["n"])))
