"""License scans: units of a text against license templates by Dice over word bigrams.

Units are lines, the sentences of a line (after a mark and a blank), and the sentences of a paragraph
whose lines are joined without their comment marks (ended by one of ".!?", but not after a "v"), so a
notice that is wrapped over lines is one unit. A unit is normalised to
lower-case letters and digits, its distinct word bigrams are compared with those of a template: twice
the common ones over the sum of both. A template matches when Dice is at least ``DICE`` and the words
that tell licenses apart agree: the unit has the same of ``TELLING`` as the template, and every number
of the template (its version). Only the best template of a unit counts; of equal ones the first.

Dice of at least ``DICE`` needs sizes within a factor of (2 - DICE) / DICE and most of a template's
bigrams, so some bigram of any choice of more than the rest must be there. That gives two prunings that
lose nothing: texts and units without a word of such a choice are left out before bigrams are built, and
templates outside the size bounds are not compared. Everything is built-in functions; templates are a
literal of fixed size.

Nulls: a null text has no units; a null ``doc_id`` is a document of its own kind (all such rows are one).
Rows that repeat an id are reported together. Very long texts are scanned whole, a unit at a time. An
empty table gives an empty result. Other columns are ignored.
"""

import re

from pyspark.sql import functions as F

DICE = 0.7

# The usual notices of common licenses, and the openings of their texts.
TEMPLATES = {
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License v3.0.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

# Words in the names of licenses that set one of a family apart from the others.
TELLING = ("affero", "lesser", "library", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike")


def words_of(text):
    """Lower-case words; "v3" is the number 3."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"\bv([0-9])", r"\1", text.lower())).split()


def bigrams(text):
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def templates():
    """[(license, bigrams)] of all templates."""
    return [(name, bigrams(t)) for name, texts in TEMPLATES.items() for t in texts]


def telling(text):
    """What must agree: (words of TELLING, numbers), each sorted."""
    words = set(words_of(text))
    return sorted(words & set(TELLING)), sorted(w for w in words if w.isdigit())


def template_rows():
    """[(license, bigrams, telling words, numbers)] in the order that settles equal values."""
    return [(name, bigrams(t), *telling(t)) for name, texts in TEMPLATES.items() for t in texts]


def needed_words(dice=DICE):
    """Words of which a unit that reaches ``dice`` with any template has at least one.

    Such a unit has at least dice / (2 - dice) of a template's bigrams, so it has one of any choice
    of more than the others; the choice takes the bigrams with the longest words.
    """
    words = set()
    for _, grams in templates():
        longest = sorted((max(g.split(), key=lambda w: (len(w), w)) for g in grams), key=lambda w: (-len(w), w))
        words.update(longest[:int(len(grams) * (1 - dice / (2 - dice))) + 1])
    return sorted(words)


def _texts(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def scan_units(docs, dice=DICE):
    """(doc_id, license, dice, unit): the best template of every unit that matches one."""
    wanted = "(?i)" + "|".join(needed_words(dice))
    units = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_t")).where(F.col("_t").rlike(wanted))
    lines = F.split("_t", "\n")
    ends = r"([.!?;|%&$#*])[\x20\t]+"
    parts = F.split(F.regexp_replace("_t", ends, "$1\n"), "\n")
    # lines of a paragraph are joined without their comment marks; empty lines part paragraphs
    joined = F.regexp_replace(F.regexp_replace("_t", r"\n[\x20\t\r]*\n", "\u0001"), r"[\n\r]+[\x20\t]*[#*/%;>|-]*[\x20\t]*", " ")
    wrapped = F.split(F.regexp_replace(joined, r"([^vV][.!?])[\x20\t]+", "$1\u0001"), "\u0001")
    units = units.select("doc_id", F.explode(F.array_distinct(F.concat(lines, parts, wrapped))).alias("unit")).where(F.col("unit").rlike(wanted))
    plain = F.regexp_replace(F.regexp_replace(F.lower("unit"), r"\bv([0-9])", "$1"), "[^a-z0-9]+", " ")
    units = units.withColumn("_w", F.filter(F.split(plain, " "), lambda w: w != "")).where(F.size("_w") > 1)
    units = units.withColumn("_b", F.array_distinct(F.transform(F.slice("_w", 1, F.size("_w") - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("_w", i + 1)))))
    known = F.array(*(F.struct(F.lit(-k).alias("order"), F.lit(name).alias("license"), _texts(*grams).alias("grams"), F.lit(" ".join(told)).alias("told"),
                               _texts(*numbers).alias("numbers")) for k, (name, grams, told, numbers) in enumerate(template_rows())))
    fits = F.filter(known, lambda t: ((2 - dice) * F.size("_b") >= dice * F.size(t["grams"])) & ((2 - dice) * F.size(t["grams"]) >= dice * F.size("_b")))
    pairs = units.select("doc_id", "unit", "_b", "_w", F.explode(fits).alias("t"))
    value = 2.0 * F.size(F.array_intersect("_b", "t.grams")) / (F.size("_b") + F.size("t.grams"))
    told = F.array_join(F.array_sort(F.array_intersect("_w", _texts(*TELLING))), " ")
    agree = (told == F.col("t.told")) & (F.size(F.array_except("t.numbers", "_w")) == 0)
    found = pairs.select("doc_id", "unit", value.alias("dice"), "t.order", "t.license", agree.alias("_agree")).where((F.col("dice") >= dice) & F.col("_agree"))
    best = found.groupBy("doc_id", "unit").agg(F.max(F.struct("dice", "order", "license")).alias("_best"))  # few rows are left here
    return best.select("doc_id", "_best.license", "_best.dice", "unit")


def license_scan(docs, dice=DICE):
    """(doc_id, license, dice, units): the licenses each document names, best value and number of units."""
    return scan_units(docs, dice).groupBy("doc_id", "license").agg(
        F.round(F.max("dice"), 6).alias("dice"), F.countDistinct("unit").alias("units"))


def oracle(dice=DICE):
    rows = list(enumerate(template_rows()))
    known = " union all ".join(f"select {i} as t, '{g}' as g" for i, (_, grams, _, _) in rows for g in grams)
    named = " union all ".join(f"select {i} as t, '{n}' as license, {len(grams)} as n, '{' '.join(told)}' as told, {numbers}::varchar[] as numbers"
                               for i, (n, grams, told, numbers) in rows)
    return rf"""
with k as ({known}), ks as ({named}),
u as (select distinct doc_id, unnest(list_concat(list_concat(string_split(text, chr(10)),
  string_split(regexp_replace(text, '([.!?;|%&$#*])[\x20\t]+', '\1' || chr(10), 'g'), chr(10))),
  string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n[\x20\t\r]*\n', chr(1), 'g'), '[\n\r]+[\x20\t]*[#*/%;>|-]*[\x20\t]*', ' ', 'g'),
    '([^vV][.!?])[\x20\t]+', '\1' || chr(1), 'g'), chr(1)))) as unit from documents where text is not null),
w as (select doc_id, unit, list_filter(string_split(regexp_replace(regexp_replace(lower(unit), '\bv([0-9])', '\1', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '),
  lambda x: x <> '') as ws from u),
b as (select distinct doc_id, unit, ws[i] || ' ' || ws[i + 1] as g from (select doc_id, unit, ws, unnest(range(1, len(ws))) as i from w)),
bs as (select b.doc_id, b.unit, count(*) as n, any_value(array_to_string(list_sort(list_distinct(list_filter(ws, lambda x: x in {TELLING}))), ' ')) as told,
  any_value(ws) as ws from b join w on b.doc_id is not distinct from w.doc_id and b.unit = w.unit group by b.doc_id, b.unit),
m as (select b.doc_id, b.unit, k.t, count(*) as common from b join k using (g) group by b.doc_id, b.unit, k.t),
s as (select m.doc_id, ks.license, m.unit, ks.t, 2.0::double * common / (bs.n + ks.n) as dice
  from m join bs on m.doc_id is not distinct from bs.doc_id and m.unit = bs.unit join ks using (t)
  where bs.told = ks.told and list_has_all(bs.ws, ks.numbers)),
best as (select * from s where dice >= {dice} qualify row_number() over (partition by doc_id, unit order by dice desc, t) = 1)
select doc_id, license, round(max(dice), 6) as dice, count(distinct unit) as units from best group by doc_id, license"""
