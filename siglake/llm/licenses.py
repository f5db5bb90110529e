"""License scans by a positional index of rare words.

The index holds, for every template, the words of its mandatory phrases with
their positions and their IDF over the templates. A template can stand only in a
file that has all of these words, so its ``anchors``, the two of highest IDF, are
the rarest words by which that file can be searched for it. They are looked up
in the file; each place of an anchor gives a diagonal (position in the file
minus position in the template), and the diagonals of both anchors are
intersected. A diagonal that is left counts if every word of the template's
mandatory phrases stands at its place there. A place with all mandatory phrases
lies on the diagonals of both anchors, so none is lost. The score is the largest
share of a template's words that agree.

All of it happens within a row, so a scan neither shuffles nor joins; the index
is a constant of this module. Lookups are hash sets over a text's words, and only
the words of templates that can stand in the file are searched for.

Edge cases. Null or empty text: no words, zero, empty labels, score 0. Overlap
of two places of a phrase: both count. Repeated documents: a row each. Ties
(templates that agree at one place): every label is given. Very long texts: cost
grows with the words and the places found. Empty table: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import ALNUM_GAP, lower_sql, words_sql

#: The phrases that are always looked for, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence texts and notices, as they are usually given.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name
of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following:"""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation;
either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at https://mozilla.org/MPL/2.0/."""

#: label, notice, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license version", ["gnu lesser general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "creative commons cc0 1 0 universal", ["cc0 1 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("mit", MIT, ["permission is hereby granted free of charge", "the software is provided as is"]),
    ("isc", ISC, ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "the software is provided as is"]),
    ("bsd", BSD, ["redistribution and use in source and binary forms", "neither the name of"]),
    ("zlib", ZLIB, ["the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"]),
    ("bsl-1.0", BOOST, ["obtaining a copy of the software and accompanying documentation covered by this license"]),
    ("unlicense", UNLICENSE, ["unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"]),
    ("apache-2.0", APACHE, ["licensed under the apache license version 2 0 the license", "you may not use this file except in compliance with the license"]),
    *((f"{name}-{n}.0", GNU.format(kind=kind, n=n), [f"gnu {kind} license as published by the free software foundation either version {n} of the license"])
      for name, kind, versions in (("gpl", "general public", (2, 3)), ("lgpl", "lesser general public", (3,)), ("agpl", "affero general public", (3,))) for n in versions),
    ("mpl-2.0", MPL, ["this source code form is subject to the terms of the mozilla public license v 2 0"]),
    ("proprietary", "proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited", ["unauthorized copying of this file"]),
]
ANCHORS = 2


@dataclass
class Template:
    label: str
    words: list[str]
    must: list[int]  #: positions of the words of the mandatory phrases
    anchors: list[tuple[str, int]]  #: the mandatory words of highest IDF, each with a position


def index(templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> list[Template]:
    texts = [re.sub(ALNUM_GAP, " ", text.lower()).split() for _, text, _ in templates]
    df = Counter(w for words in texts for w in set(words))
    out = []
    for words, (label, _, phrases) in zip(texts, templates):
        must = set()
        for phrase in map(str.split, phrases):
            at = [p for p in range(len(words) - len(phrase) + 1) if words[p : p + len(phrase)] == phrase]
            if not at:
                raise ValueError(f"{label}: {' '.join(phrase)!r} is not in its template")
            must.update(p + k for p in at for k in range(len(phrase)))
        rarest = sorted(must, key=lambda p: (-log(len(texts) / df[words[p]]), p))[:ANCHORS]
        out.append(Template(label, words, sorted(must), [(words[p], p) for p in rarest]))
    return out


def _array(values, kind=None) -> str:
    out = "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"
    return f"cast({out} as {kind})" if kind else out


def scan_licenses(documents: DataFrame) -> DataFrame:
    entries = index()
    each = lambda make: "array(" + ", ".join(make(t) for t in entries) + ")"
    needed = each(lambda t: _array(sorted({t.words[p] for p in t.must})))
    vocabulary = _array(sorted({t.words[p] for t in entries for p in t.must}))
    anchors = each(lambda t: "array(" + ", ".join(f"named_struct('w', '{w}', 'p', {p})" for w, p in t.anchors) + ")")
    templates, musts, labels = each(lambda t: _array(t.words)), each(lambda t: _array(t.must)), _array([t.label for t in entries])
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.expr(words_sql(lower_sql("text"), ALNUM_GAP)).alias("words"))
    d = d.select("*", F.size("words").alias("n"), F.expr("concat(' ', array_join(words, ' '))").alias("joined"))
    d = d.select("*", *[F.expr(f"split(joined, ' {phrase}(?= |$)', -1)").alias(f"cut{i}") for i, phrase in enumerate(BASE)])
    d = d.select("*", F.expr(f"array_intersect(words, {vocabulary})").alias("known"))
    d = d.select("*", F.expr(f"filter(sequence(0, {len(entries) - 1}), t -> size(known) > 1 and size(array_except(get({needed}, t), known)) = 0)").alias("possible"))
    d = d.select("*", F.expr(f"flatten(transform(possible, t -> transform(get({anchors}, t), a -> a.w)))").alias("sought"))
    d = d.select("*", F.expr("CASE WHEN size(sought) > 0 THEN filter(transform(words, (w, i) -> struct(w, i)), x -> array_contains(sought, x.w)) END").alias("hits"))
    diagonals = lambda k: f"transform(filter(hits, x -> x.w = get(get({anchors}, t), {k}).w), x -> x.i - get(get({anchors}, t), {k}).p)"
    d = d.select("*", F.expr(f"flatten(transform(possible, t -> transform(array_intersect({diagonals(0)}, {diagonals(1)}), d -> struct(t, d))))").alias("places"))
    d = d.select(
        "*",
        F.expr(
            f"transform(filter(places, x -> forall(get({musts}, x.t), j -> coalesce(get(words, x.d + j) = get(get({templates}, x.t), j), false))),"
            f" x -> struct(get({labels}, x.t) as label, size(filter(transform(get({templates}, x.t), (w, j) -> coalesce(get(words, x.d + j) = w, false)), b -> b)) / size(get({templates}, x.t)) as score))"
        ).alias("verified"),
    )
    n_words = lambda part: f"(length({part}) - length(replace({part}, ' ', '')))"
    first = ", ".join(f"CASE WHEN size(cut{i}) > 1 THEN {n_words(f'get(cut{i}, 0)')} END" for i in range(len(BASE)))
    last = ", ".join(f"CASE WHEN size(cut{i}) > 1 THEN n - {len(p.split())} - {n_words(f'get(cut{i}, size(cut{i}) - 1)')} END" for i, p in enumerate(BASE))
    base = ", ".join(f"CASE WHEN size(cut{i}) > 1 THEN '{label}' END" for i, label in enumerate(BASE.values()))
    base = f"array_sort(array_distinct(filter(array({base}), x -> x is not null)))"
    return d.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_words"),
        F.expr(" + ".join(f"size(cut{i}) - 1" for i in range(len(BASE)))).cast("bigint").alias("n_base"),
        F.expr(f"array_min(array({first}))").cast("bigint").alias("first_word"),
        F.expr(f"array_max(array({last}))").cast("bigint").alias("last_word"),
        F.expr(f"array_join({base}, ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, transform(coalesce(verified, array()), x -> x.label))), ',')").alias("labels"),
        F.expr(f"greatest(CASE WHEN size({base}) > 0 THEN 1.0D ELSE 0.0D END, coalesce(array_max(transform(verified, x -> x.score)), 0.0D))").alias("score"),
    )
