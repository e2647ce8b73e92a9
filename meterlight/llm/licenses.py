"""License scan: known licence sentences, and ordered rules over their sequence.

A text is cut into sentences, each is normalised (a-z and digits, single spaces) and looked up
among known licence sentences. What remains of a document is the sequence of identifiers, with
``-`` for any run of other sentences. The rules, long ones first, are matched against that
sequence; what a rule matches is used up.

A known sentence may run over line breaks, whatever the case of the next line, and over the
stops that its real wording has inside (``INSIDE``: 'free software; you can'); a clause may bear
a number. Long wordings are looked up first. ``n_sentences`` counts the pieces of the plain cut.
Only texts with a word of ``HINTS``, one of which stands in every known sentence, are looked up.
``sql()`` looks up single pieces of the plain cut, so it misses wordings that run over a cut.

All of it is expressions on a document's own row: no shuffle, no Python. Null and empty texts
have no sentences. Repeated rows and ties are scanned each, further columns are ignored, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised, each with its identifier.
SENTENCES = {
    "s001": "the mit license",
    "s002": "mit license",
    "s003": "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions",
    "s004": "the above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the software",
    "s005": "the software is provided as is without warranty of any kind express or implied "
    "including but not limited to the warranties of merchantability fitness for a particular "
    "purpose and noninfringement",
    "s006": "in no event shall the authors or copyright holders be liable for any claim damages "
    "or other liability whether in an action of contract tort or otherwise arising from out of "
    "or in connection with the software or the use or other dealings in the software",
    "s007": "released under the mit license",
    "s008": "licensed under the mit license",
    "s010": "licensed under the apache license version 2 0",
    "s011": "licensed under the apache license version 2 0 the license",
    "s012": "you may not use this file except in compliance with the license",
    "s013": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "s014": "unless required by applicable law or agreed to in writing software distributed "
    "under the license is distributed on an as is basis without warranties or conditions of any "
    "kind either express or implied",
    "s015": "see the license for the specific language governing permissions and limitations "
    "under the license",
    "s016": "apache license version 2 0",
    "s020": "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met",
    "s021": "redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer",
    "s022": "redistributions in binary form must reproduce the above copyright notice this list "
    "of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution",
    "s023": "neither the name of the copyright holder nor the names of its contributors may be "
    "used to endorse or promote products derived from this software without specific prior "
    "written permission",
    "s030": "this program is free software you can redistribute it and or modify it under the "
    "terms of the gnu general public license as published by the free software foundation "
    "either version 3 of the license or at your option any later version",
    "s031": "this program is free software you can redistribute it and or modify it under the "
    "terms of the gnu general public license as published by the free software foundation "
    "either version 2 of the license or at your option any later version",
    "s032": "this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular "
    "purpose",
    "s033": "see the gnu general public license for more details",
    "s034": "this work is licensed under the gnu general public license version 3",
    "s035": "this work is licensed under the gnu general public license version 2",
    "s036": "gnu general public license version 3",
    "s040": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "s050": "licensed under cc by 4 0",
    "s051": "licensed under cc by sa 4 0",
    "s052": "licensed under cc by nc 4 0",
    "s053": "licensed under cc by nd 4 0",
    "s054": "licensed under cc by nc sa 4 0",
    "s055": "licensed under cc by nc nd 4 0",
    "s056": "this work is licensed under a creative commons attribution 4 0 international license",
    "s057": "this work is licensed under a creative commons attribution sharealike 4 0 "
    "international license",
    "s058": "this work is licensed under a creative commons attribution noncommercial 4 0 "
    "international license",
    "s060": "this is free and unencumbered software released into the public domain",
    "s061": "permission to use copy modify and or distribute this software for any purpose with "
    "or without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies",
    "s070": "spdx license identifier mit",
    "s071": "spdx license identifier apache 2 0",
    "s072": "spdx license identifier gpl 3 0 only",
    "s073": "spdx license identifier bsd 3 clause",
    "s080": "all rights reserved",
}
# Licences by sequence of sentences, in the order in which they are tried.
RULES = [
    ("MIT", "s001 s003 s004 s005 s006"),
    ("MIT", "s002 s003 s004 s005 s006"),
    ("MIT", "s003 s004 s005 s006"),
    ("Apache-2.0", "s011 s012 s013 s014 s015"),
    ("Apache-2.0", "s010 s012 s013 s014 s015"),
    ("BSD-3-Clause", "s020 s021 s022 s023"),
    ("GPL-3.0-or-later", "s030 s032 s033"),
    ("GPL-2.0-or-later", "s031 s032 s033"),
    ("BSD-2-Clause", "s020 s021 s022"),
    ("GPL-3.0-or-later", "s030"),
    ("GPL-2.0-or-later", "s031"),
    ("Apache-2.0", "s010"),
    ("Apache-2.0", "s011"),
    ("Apache-2.0", "s016"),
    ("Apache-2.0", "s071"),
    ("MIT", "s003 s004"),
    ("MIT", "s007"),
    ("MIT", "s008"),
    ("MIT", "s070"),
    ("GPL-3.0-only", "s034"),
    ("GPL-3.0-only", "s036"),
    ("GPL-3.0-only", "s072"),
    ("GPL-2.0-only", "s035"),
    ("MPL-2.0", "s040"),
    ("CC-BY-4.0", "s050"),
    ("CC-BY-4.0", "s056"),
    ("CC-BY-SA-4.0", "s051"),
    ("CC-BY-SA-4.0", "s057"),
    ("CC-BY-NC-4.0", "s052"),
    ("CC-BY-NC-4.0", "s058"),
    ("CC-BY-ND-4.0", "s053"),
    ("CC-BY-NC-SA-4.0", "s054"),
    ("CC-BY-NC-ND-4.0", "s055"),
    ("Unlicense", "s060"),
    ("ISC", "s061"),
    ("BSD-3-Clause", "s073"),
    ("all-rights-reserved", "s080"),
]

# Words after which a sentence's real wording has a stop.
INSIDE = {
    "s030": ("software", "foundation"),
    "s031": ("software", "foundation"),
    "s032": ("any warranty",),
    "s040": ("license v",),
    "s070": ("identifier",),
    "s071": ("identifier",),
    "s072": ("identifier",),
    "s073": ("identifier",),
}
#: Sentences that are clauses of a list and may begin with a number.
CLAUSES = ("s021", "s022", "s023")
HINTS = ("licen", "software", "redistribution", "warranty", "reserved")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that goes on with a small letter is one sentence with the line before it.
WRAPPED = r"([^.!?\n])\n[ \t]*([a-z(])"
STOP = r"[.!?:;][ \t\r\n]+"
OTHER = r"[^a-z0-9\n]+"
EDGE = r" *\n[ \n]*"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), WRAPPED, "$1 $2")
    one = F.regexp_replace(F.translate(one, UPPER, LOWER), STOP, "\n")
    one = F.regexp_replace(F.regexp_replace(one, OTHER, " "), EDGE, "\n")
    return F.filter(F.split(F.trim(one), "\n"), lambda s: s != "")


def _pattern(name: str) -> str:
    """A regular expression for a known sentence between cuts: S for a stop, a line break otherwise."""
    inside = SENTENCES[name]
    for words in INSIDE.get(name, ()):
        inside = inside.replace(words + " ", words + "|", 1)
    inside = inside.replace(" ", "[ \\n]").replace("|", "[ \\nS]")
    number = r"(?:(?:[0-9]{1,2}|[a-d]|i{1,3}|iv)[ \nS])?" if name in CLAUSES else ""
    return rf"(?<=^|[\nS]){number}{inside}(?=[\nS]|$)"


def identifiers(text: Column, words: Column) -> Column:
    """The sequence of a text's known sentences as a string, runs of others as one ``-``.

    ``words`` are the text's sentences joined by spaces.
    """
    one = F.regexp_replace(F.coalesce(text, F.lit("")), WRAPPED, "$1 $2")
    one = F.regexp_replace(F.translate(one, UPPER, LOWER), STOP, "S\n")
    one = F.regexp_replace(F.regexp_replace(one, "[^a-z0-9\nS]+", " "), EDGE, "\n")
    one = F.trim(F.regexp_replace(one, r"[ \n]?S[ \nS]*", "S"))
    # Every sentence that the words hold in a row is looked up with its cuts; K marks a hit.
    longest = sorted(SENTENCES, key=lambda name: -len(SENTENCES[name]))
    known = F.array(
        *[
            F.struct(
                F.lit(SENTENCES[name]).alias("words"),
                F.lit(_pattern(name)).alias("pattern"),
                F.lit("K" + name).alias("mark"),
            )
            for name in longest
        ]
    )
    marked = F.aggregate(
        known,
        one,
        lambda now, s: F.when(
            F.contains(words, s["words"]), F.regexp_replace(now, s["pattern"], s["mark"])
        ).otherwise(now),
    )
    pieces = F.filter(F.split(marked, "[\nS]"), lambda s: s != "")
    names = F.transform(pieces, lambda s: F.when(s.startswith("K"), F.substring(s, 2, 4)).otherwise("-"))
    hint = F.lit(False)
    for word in HINTS:
        hint = hint | F.contains(words, F.lit(word))
    plain = F.when(words != "", "-").otherwise("")
    return F.when(hint, F.regexp_replace(F.array_join(names, ""), "-+", "-")).otherwise(plain)


def scan(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Each document's sentences, identifier sequence, licences and left-over known sentences."""
    found = docs.select("doc_id", "text", sentences(F.col("text")).alias("found"))
    found = found.select("doc_id", "text", "found", F.array_join("found", " ").alias("words"))
    found = found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_sentences"),
        identifiers(F.col("text"), F.col("words")).alias("sequence"),
    )
    found = found.withColumn("left", F.col("sequence"))
    names = list(dict.fromkeys(name for name, _ in rules))
    for k, (_, rule) in enumerate(rules):
        pattern = rule.replace(" ", "")
        hits = (F.length("left") - F.length(F.replace("left", F.lit(pattern), F.lit("")))) / len(
            pattern
        )
        found = found.withColumns(
            {f"hits_{k}": hits.cast("long"), "left": F.replace("left", F.lit(pattern), F.lit("+"))}
        )
    total = {
        name: sum((F.col(f"hits_{k}") for k, (n, _) in enumerate(rules) if n == name), F.lit(0))
        for name in names
    }
    return found.select(
        "doc_id",
        "n_sentences",
        (F.length(F.regexp_replace("sequence", "[^s]", ""))).cast("long").alias("n_known"),
        "sequence",
        F.concat_ws(",", *[F.when(total[n] > 0, F.lit(n)) for n in names]).alias("licenses"),
        sum((F.col(f"hits_{k}") for k in range(len(rules))), F.lit(0)).cast("long").alias("n_matches"),
        (F.length(F.regexp_replace("left", "[^s]", ""))).cast("long").alias("n_unmatched"),
    )


def sql() -> str:
    """The same scan as DuckDB SQL over the table ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lists = ", ".join(map(quoted, SENTENCES)), ", ".join(map(quoted, SENTENCES.values()))
    newline = "chr(10)"
    inner = (
        f"regexp_replace(coalesce(text, ''), {quoted(WRAPPED)}, '\\1 \\2', 'g')"
    )
    inner = f"regexp_replace(translate({inner}, '{UPPER}', '{LOWER}'), {quoted(STOP)}, {newline}, 'g')"
    inner = f"regexp_replace(regexp_replace({inner}, {quoted(OTHER)}, ' ', 'g'), {quoted(EDGE)}, {newline}, 'g')"
    steps = [
        f"""WITH cut AS (SELECT doc_id, list_filter(string_split(trim({inner}, ' '), {newline}), lambda s: s <> '') AS found
FROM documents), known AS (SELECT doc_id, len(found) AS n_sentences, regexp_replace(array_to_string(
list_transform(found, lambda s: coalesce([{lists[0]}][nullif(list_position([{lists[1]}], s), 0)], '-')), ''), '-+', '-', 'g') AS sequence
FROM cut), left_0 AS (SELECT *, coalesce(sequence, '') AS rest FROM known)"""
    ]
    for k, (_, rule) in enumerate(RULES):
        pattern = rule.replace(" ", "")
        steps.append(
            f"left_{k + 1} AS (SELECT * REPLACE (replace(rest, '{pattern}', '+') AS rest), "
            f"(length(rest) - length(replace(rest, '{pattern}', ''))) // {len(pattern)} AS hits_{k} FROM left_{k})"
        )
    names = list(dict.fromkeys(name for name, _ in RULES))
    hits = {n: " + ".join(f"hits_{k}" for k, (m, _) in enumerate(RULES) if m == n) for n in names}
    which = ", ".join(f"CASE WHEN {hits[n]} > 0 THEN '{n}' END" for n in names)
    every = " + ".join(f"hits_{k}" for k in range(len(RULES)))
    return (
        ", ".join(steps)
        + f""" SELECT doc_id, n_sentences::BIGINT AS n_sentences,
length(regexp_replace(coalesce(sequence, ''), '[^s]', '', 'g'))::BIGINT AS n_known, coalesce(sequence, '') AS sequence,
concat_ws(',', {which}) AS licenses, ({every})::BIGINT AS n_matches,
length(regexp_replace(rest, '[^s]', '', 'g'))::BIGINT AS n_unmatched FROM left_{len(RULES)}"""
    )
