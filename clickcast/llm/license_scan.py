r"""License scan by sentence rules, with DataFrame functions only.

A text is cut into sentences (after ``. ! ?`` before white space, and at line
ends), each normalised to lower-case words.  Known licence sentences turn into
their identifiers; the identifier sequence of a document is matched against the
ordered rules: a rule fits if its identifiers follow one another among the
document's known sentences.  The text is also cut without regard to line ends,
so that a licence wrapped over lines is found.  In a third reading a known
sentence may hold cuts: it starts and ends at any of them and its words follow
one another, so a licence is found whose sentences hold a cut themselves
(``v. 2.0``), follow a line without a full stop or run on after a blank line.

Defined results: null, empty and other texts without a known sentence get empty
sequences, no licence and no rule.  Repeated rows are judged alike, long texts
whole.  Empty table: no rows.  Extra columns are kept; input columns called
like an output column are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.columns import let
from clickcast.llm.common import table

#: Known licence sentences by identifier.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-lic": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "This work is dedicated to the public domain.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}

#: Rules (name, licence, identifiers in order); the first that fits names the document's licence.
RULES = [
    ("mit-full", "MIT", ["mit-grant", "mit-notice"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("apache-header", "Apache-2.0", ["apache-head", "apache-copy"]),
    ("gpl3-header", "GPL-3.0", ["gpl-free", "gpl-hope"]),
    ("gpl3-free", "GPL-3.0", ["gpl-free"]),
    ("bsd-grant", "BSD", ["bsd-grant"]),
    ("apache-head", "Apache-2.0", ["apache-head"]),
    ("mpl2-notice", "MPL-2.0", ["mpl-2"]),
    ("gpl3-reference", "GPL-3.0", ["gpl3-ref"]),
    ("apache-reference", "Apache-2.0", ["apache-ref"]),
    ("mit-reference", "MIT", ["mit-ref"]),
    ("mit-licensed", "MIT", ["mit-lic"]),
    ("cc-by-nc-reference", "CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("cc-by-sa-reference", "CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("cc-by-reference", "CC-BY-4.0", ["cc-by-4"]),
    ("public-domain", "CC0-1.0", ["cc0"]),
    ("mit-heading", "MIT", ["mit-title"]),
    ("mit-short-heading", "MIT", ["mit-title2"]),
    ("all-rights-reserved", "proprietary", ["reserved"]),
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
END = r"[.!?:]+([ \t\r\n]+|$)"
END_OR_LINE = r"[.!?:]+([ \t\r\n]+|$)|[\r\n]+"
NOT_WORD = r"[^\p{L}\p{N}\x01]+"


def normalise(sentence: str) -> str:
    """A known sentence as the column functions below normalise one."""
    low = sentence.translate(str.maketrans(UPPER, UPPER.lower()))
    return re.sub(r"[^\w\x01]+|_+", " ", re.sub(END, "\x01", low)).strip("\x01 ")


def cut(text: Column, end: str) -> Column:
    """Normalised text with a mark at each cut."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.regexp_replace(F.regexp_replace(low, end, "\x01"), NOT_WORD, " ")


def sentences(plain: Column) -> Column:
    """Normalised sentences of a cut text, in order."""
    return F.transform(F.split(plain, "\x01"), lambda s: F.trim(s))


def running(plain: Column, known: list[str]) -> Column:
    """Known sentences of a cut text, in order, that start and end at a mark and may hold others."""
    longest = sorted(known, key=len, reverse=True)
    words = "|".join(s.replace(" ", r"[ \x01]+") for s in longest)
    hits = F.regexp_extract_all(F.concat(F.lit("\x01"), plain, F.lit("\x01")),
                                F.lit(rf"\x01 ?({words})(?= ?\x01)"), F.lit(1))
    return F.transform(hits, lambda s: F.regexp_replace(s, r"[ \x01]+", " "))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``sentence_ids``, ``licenses`` (all, in rule order), ``license`` and ``rule`` (the first)."""
    ids: dict[str, str] = {}
    for key, sentence in SENTENCES.items():
        ids.setdefault(normalise(sentence), key)
    known = list(ids)
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])

    whole = {k.replace("\x01", " "): name for k, name in ids.items()}
    whole_names = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])

    def sequence(hit: Column, names: Column) -> Column:
        return F.concat(F.lit(","), F.array_join(F.transform(hit, lambda s: F.element_at(names, s)), ","), F.lit(","))

    def listed(plain: Column) -> Column:
        return sequence(F.filter(sentences(plain), lambda s: s.isin(known)), names)

    marked = docs.withColumns({
        "_cut": let(cut(F.col(text), END_OR_LINE), lambda p: F.struct(
            listed(p).alias("lines"), sequence(running(p, list(whole)), whole_names).alias("running"))),
        "_wrapped": listed(cut(F.col(text), END))})
    marked = marked.withColumns({"_lines": F.col("_cut.lines"), "_running": F.col("_cut.running")}).drop("_cut")
    fits = F.array_compact(F.array(*[
        F.when(F.contains(F.concat_ws(";", "_lines", "_wrapped", "_running"), F.lit("," + ",".join(rule) + ",")),
               F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("license")))
        for name, licence, rule in RULES]))
    found = marked.withColumn("_fits", fits)
    seen = F.when(F.length("_wrapped") > F.length("_lines"), F.col("_wrapped")).otherwise(F.col("_lines"))
    seen = F.when(F.length("_running") > F.length(seen), F.col("_running")).otherwise(seen)
    return found.withColumns({
        "sentence_ids": F.trim(seen, F.lit(",")),
        "licenses": F.array_join(F.array_distinct(F.transform("_fits", lambda x: x["license"])), ","),
        "license": F.get("_fits", F.lit(0))["license"],
        "rule": F.get("_fits", F.lit(0))["rule"],
    }).drop("_lines", "_wrapped", "_running", "_fits")


def _sql() -> str:
    ids: dict[str, str] = {}
    for key, sentence in SENTENCES.items():
        ids.setdefault(normalise(sentence), key)
    values = ", ".join(f"('{s}', '{k}')" for s, k in ids.items())
    rules = ", ".join(f"({i}, '{n}', '{lic}', ',{','.join(seq)},')" for i, (n, lic, seq) in enumerate(RULES))

    def cut(end: str) -> str:
        low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
        plain = f"regexp_replace(regexp_replace({low}, '{end}', chr(1), 'g'), '{NOT_WORD}', ' ', 'g')"
        return f"string_split({plain}, chr(1))"

    def ids_of(end: str, name: str) -> str:
        return f"""{name} AS (
  SELECT r, ',' || string_agg(k, ',' ORDER BY pos) || ',' AS ids
  FROM (SELECT r, trim(unnest({cut(end)}), ' ') AS s, generate_subscripts({cut(end)}, 1) AS pos FROM numbered)
  JOIN known USING (s) GROUP BY r)"""

    return f"""
WITH numbered AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
known(s, k) AS (VALUES {values}),
rules(i, rule, license, ids) AS (VALUES {rules}),
{ids_of(END_OR_LINE, "by_line")},
{ids_of(END, "wrapped")},
seen AS (
  SELECT r, doc_id, coalesce(a.ids, ',,') AS lines, coalesce(b.ids, ',,') AS wrapped
  FROM numbered LEFT JOIN by_line a USING (r) LEFT JOIN wrapped b USING (r)),
fits AS (
  SELECT r, i, rule, license FROM seen JOIN rules ON contains(lines || ';' || wrapped, ids)),
named AS (
  SELECT r, arg_min(rule, i) AS rule, arg_min(license, i) AS license FROM fits GROUP BY r),
every AS (
  SELECT r, string_agg(license, ',' ORDER BY i) AS licenses
  FROM (SELECT r, license, min(i) AS i FROM fits GROUP BY r, license) GROUP BY r)
SELECT doc_id, trim(CASE WHEN length(wrapped) > length(lines) THEN wrapped ELSE lines END, ',') AS sentence_ids,
       coalesce(licenses, '') AS licenses, license, rule
FROM seen LEFT JOIN named USING (r) LEFT JOIN every USING (r)"""


@register("op8_license_scan", _sql())
def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
