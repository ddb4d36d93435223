"""Licence scans by sentence rules, with column functions only.

Texts are cut into sentences, the sentences normalised (A-Z lower-cased, everything but letters and digits to one
space) and joined by equality with the known licence sentences. The identifiers found in a document, in order, are
then matched against the licence rules, each an ordered list of identifiers. Sentences are cut twice: with every
line break as an end, and, for wrapped licences, with blank lines only; the reading that finds more counts.
Where the sentences of one rule are part of a longer one's (BSD-2-Clause in BSD-3-Clause), a passage of the longer rule
is none of the shorter.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CUT = "\x01"

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAMES = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NO_AUTHOR = "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."
_ADVERTS = "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."

# The licences' own wording. Each text is one rule; its sentences are the rule's ordered identifiers.
_TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "BSD-2-Clause": (
        _BSD,
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (f"{_BSD} {_NO_NAMES}", f"{_BSD} {_NO_AUTHOR}"),
    "BSD-4-Clause": (f"{_BSD} {_ADVERTS} {_NO_NAMES}", f"{_BSD} {_ADVERTS} {_NO_AUTHOR}"),
    "LGPL-2.1": tuple(_GNU.format(x, ";", "Lesser General Public License", ";", "2.1") for x in ("library", "program", "software")),
    "LGPL-2.0": tuple(_GNU.format(x, ";", "Library General Public License", ";", "2") for x in ("library", "program")),
    "LGPL-3.0": tuple(_GNU.format(x, y, "Lesser General Public License", z, "3") for x in ("library", "program") for y, z in ((":", ","), (";", ";"))),
    "AGPL-3.0": tuple(_GNU.format("program", y, "Affero General Public License", z, "3") for y, z in ((":", ","), (";", ";"))),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "EPL-1.0": tuple(
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at" + x
        for x in ("", " http://www.eclipse.org/legal/epl-v10.html", " https://www.eclipse.org/legal/epl-v10.html")),
    "EPL-2.0": tuple(
        f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}2.0 which {y}is available at" + x
        for v in ("", "v. ", "v") for y in ("", "accompanies this distribution, and ")
        for x in ("", " http://www.eclipse.org/legal/epl-2.0", " https://www.eclipse.org/legal/epl-2.0", " https://www.eclipse.org/legal/epl-2.0/")),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}


# SPDX ids of each licence, and how notices of one sentence name it.
_GNU_NAMES = ("GNU {1} v{0}", "GNU {1}v{0}", "{1} v{0}", "{1}v{0}", "{1} {0}", "{1}-{0}", "GNU {1} {0}", "GNU {1} version {0}", "{1} version {0}",
              "GNU {2} v{0}", "GNU {2} {0}", "GNU {2}, version {0}", "{2} v{0}", "{2}, version {0}")


def _gnu(version: str, short: str, long: str, *more: str) -> tuple[str, ...]:
    versions = (version, f"{version}.0") if "." not in version else (version,)
    names = [x.format(v, short, long) for x in _GNU_NAMES for v in versions]
    return *[x + y for x in names for y in ("", " or later", " or any later version", " only")], *more


def _gnu_ids(name: str) -> tuple[str, ...]:
    return name, f"{name}-only", f"{name}-or-later", f"{name}+"


_NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (("MIT",), ("MIT", "MIT (Expat)", "Expat")),
    "Apache-2.0": (("Apache-2.0",), ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0", "Apache-2.0", "Apache v2", "Apache v2.0")),
    "GPL-3.0": (_gnu_ids("GPL-3.0"), _gnu("3", "GPL", "General Public License")),
    "GPL-2.0": (_gnu_ids("GPL-2.0"), _gnu("2", "GPL", "General Public License")),
    "LGPL-3.0": (_gnu_ids("LGPL-3.0"), _gnu("3", "LGPL", "Lesser General Public License")),
    "LGPL-2.1": (_gnu_ids("LGPL-2.1"), _gnu("2.1", "LGPL", "Lesser General Public License")),
    "LGPL-2.0": (_gnu_ids("LGPL-2.0"), _gnu("2", "LGPL", "Library General Public License")),
    "AGPL-3.0": (_gnu_ids("AGPL-3.0"), _gnu("3", "AGPL", "Affero General Public License")),
    "MPL-2.0": (("MPL-2.0", "MPL-2.0-no-copyleft-exception"), ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL v2", "MPL v2.0", "MPLv2")),
    "EPL-1.0": (("EPL-1.0",), ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, version 1.0", "EPL 1.0", "EPL v1.0")),
    "EPL-2.0": (("EPL-2.0",), ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "EPL 2.0", "EPL v2.0")),
    "BSD-2-Clause": (("BSD-2-Clause",), ("BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD", 'BSD 2-Clause "Simplified"')),
    "BSD-3-Clause": (("BSD-3-Clause",), ("BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD", 'BSD 3-Clause "New" or "Revised"')),
    "BSD-4-Clause": (("BSD-4-Clause",), ("BSD 4-Clause", "4-Clause BSD", "Original BSD")),
    "ISC": (("ISC",), ("ISC",)),
    "Unlicense": (("Unlicense",), ("Unlicense",)),
    "CC0-1.0": (("CC0-1.0",), ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal")),
} | {
    f"CC-{x}-4.0": ((f"CC-{x}-4.0",), (f"CC {x} 4.0", f"CC-{x}-4.0", f"Creative Commons {y} 4.0", f"Creative Commons {y} 4.0 International"))
    for x, y in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"))
}
# What does not tell one licence from another is read alike: (pattern, replacement) over normalised sentences.
_ALIKE = (
    ("^((this|the) (work|project|program|software|file|library|code) is )?(licensed|released|distributed|available) under (the terms of )?(the |a )?", "licensed under "),
    ("^(licensed under .*?)( licen[sc]e)?( see the license file for details)?$", "$1"),
    # Whose names are not to be used differs from text to text, and may hold a sentence end ("Inc.").
    ("^(neither the names? of .*)?nor the names? of (its|his|her|their|any|the) contributors ", "nor the names of its contributors "),
)


def known_sentences(text: str) -> list[str]:
    """Normalised sentences of a rule's text."""
    return [s for part in re.split(r"(?<=[.!?;:])\s+", text) if (s := re.sub("[^a-z0-9]+", " ", part.lower()).strip())]


def _notices(licence: str) -> list[str]:
    ids, names = _NAMES.get(licence, ((), ()))
    return [*(f"SPDX-License-Identifier: {x}" for x in ids), *(f"Licensed under the {x} License" for x in names)]


def _all_rules(texts: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """The texts and notices of each licence; of those with equal sentences the first."""
    rules, seen = {}, set()
    for licence in texts:
        mine = []
        for text in (*texts[licence], *_notices(licence)):
            key = tuple(known_sentences(text))
            if key not in seen:
                seen.add(key)
                mine.append(text)
        rules[licence] = tuple(mine)
    return rules


LICENCES = _all_rules(_TEXTS)


def rule_items(licences: Mapping[str, Sequence[str]]) -> list[tuple[str, str, int, int, str]]:
    """(licence, rule, number of sentences, place, sentence) for every sentence of every rule."""
    rows = []
    for licence, texts in licences.items():
        for k, text in enumerate(texts):
            sentences = known_sentences(text)
            rows += [(licence, f"{licence}#{k}", len(sentences), at, s) for at, s in enumerate(sentences, 1)]
    return rows


def _alike(items: Sequence[tuple[str, str, int, int, str]]) -> list[tuple[str, str, int, int, str]]:
    """The items as sentences are read; of a licence's rules that then are equal the first."""
    rules: dict[str, list[tuple[str, str, int, int, str]]] = {}
    for licence, rule, n, k, s in items:
        for pattern, read in _ALIKE:
            s = re.sub(pattern, read.replace("$", "\\"), s)
        rules.setdefault(rule, []).append((licence, rule, n, k, s))
    first: dict[tuple[str, ...], list[tuple[str, str, int, int, str]]] = {}
    for rows in rules.values():
        first.setdefault((rows[0][0], *(x[-1] for x in rows)), rows)
    return [x for rows in first.values() for x in rows]


def _in_order(few: Sequence[str], many: Sequence[str]) -> bool:
    rest = iter(many)
    return all(x in rest for x in few)


def longer_rules(items: Sequence[tuple[str, str, int, int, str]]) -> dict[str, list[str]]:
    """For a rule, the rules whose sentences hold its own in the same order and others besides."""
    sentences: dict[str, list[str]] = {}
    having: dict[str, set[str]] = {}
    for _, rule, _, _, s in items:
        sentences.setdefault(rule, []).append(s)
        having.setdefault(s, set()).add(rule)
    found = {}
    for rule, mine in sentences.items():
        longer = [x for x in sorted(having[mine[0]]) if len(sentences[x]) > len(mine) and _in_order(mine, sentences[x])]
        if longer:
            found[rule] = longer
    return found


def _sentences(text: Column, breaks: str) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?;:])[ \t\r\n]+", f"$1{_CUT}"), breaks, _CUT)
    return F.split(marked, _CUT)


def _normal(sentence: Column) -> Column:
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    alike = plain
    for pattern, read in _ALIKE:
        alike = F.regexp_replace(alike, pattern, read)
    return F.when(plain.rlike("^(this|the|licensed|released|distributed|available|neither|nor) "), alike).otherwise(plain)


def _spans(hits: Column, by: int) -> Column:
    """First and last position of each passage of the longer rule `by`, found from the end so that each is short."""
    start = F.expr("named_struct('k', 0, 'last', 0, 'spans', array_repeat(named_struct('first', 0, 'last', 0), 0))")

    def step(state: Column, x: Column) -> Column:
        last = F.when(state["k"] == 0, x["_pos"]).otherwise(state["last"])
        due = x["k"] == F.when(state["k"] == 0, x["n"]).otherwise(state["k"])
        done = F.concat(state["spans"], F.array(F.struct(x["_pos"].alias("first"), last.alias("last"))))
        return F.when(~due, state).when(x["k"] == 1, F.struct(F.lit(0).alias("k"), F.lit(0).alias("last"), done.alias("spans"))).otherwise(
            F.struct((x["k"] - 1).alias("k"), last.alias("last"), state["spans"].alias("spans")))

    return F.aggregate(F.reverse(F.filter(hits, lambda x: x["by"] == by)), start, step, lambda state: state["spans"])


def scan_licences(docs: DataFrame, licences: Mapping[str, Sequence[str]] = LICENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: doc_id, licence, n_matches, first_sentence, last_sentence.

    A rule matches where its sentences occur in their order, other sentences between them allowed; n_matches counts
    such passages, one after the other, over all rules of the licence. What stands within a passage of a longer rule
    that holds the same sentences and more counts for that rule only. Positions count sentences from 0. Null and
    empty texts give no row, rows with one id are read as one document's parts, and null ids form one document;
    other columns are ignored. The known sentences are a parameter of the caller, not data, so they go to every task.
    """
    spark = docs.sparkSession
    known = _alike(rule_items(licences))
    longer = longer_rules(known)
    # A rule also gets the sentences of its longer rules, with their number from 1 in `by`.
    licence_of = {rule: licence for licence, rule, *_ in known}
    beside = [(licence_of[rule], rule, n, k, s, by) for rule, names in longer.items() for by, name in enumerate(names, 1) for _, x, n, k, s in known if x == name]
    items = spark.createDataFrame([(*x, 0) for x in known] + beside, "licence string, rule string, n int, k int, sentence string, by int")
    text = F.col("_text")
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).filter("_text IS NOT NULL")
    units = None
    for form, breaks in (("line", r"\n+"), ("wrapped", r"\n[ \t\r]*\n+")):
        part = cut.select("doc_id", F.lit(form).alias("_form"), F.posexplode(_sentences(text, breaks)).alias("_pos", "_raw"))
        units = part if units is None else units.unionByName(part)
    shortest = min((len(s) for *_, s in known), default=0)
    found = units.filter(F.length("_raw") >= shortest).select("doc_id", "_form", "_pos", _normal(F.col("_raw")).alias("sentence")).join(F.broadcast(items), "sentence")
    # The state of a rule is 1000 * passages found + place reached in the current one.
    step = lambda state, x: F.when(x["k"] != state % 1000 + 1, state).when(x["k"] == x["n"], state - state % 1000 + 1000).otherwise(state + 1)
    per_rule = found.groupBy("doc_id", "_form", "licence", "rule").agg(
        F.array_sort(F.collect_list(F.struct("_pos", (-F.col("k")).alias("_back"), "k", "n", "by"))).alias("_hits"))
    if longer:
        spans = F.concat(*[_spans(F.col("_hits"), by) for by in range(1, max(map(len, longer.values())) + 1)])
        free = lambda x: ~F.exists("_spans", lambda span: x["_pos"].between(span["first"], span["last"]))
        per_rule = per_rule.withColumn("_spans", spans).withColumn("_hits", F.filter("_hits", lambda x: (x["by"] == 0) & free(x)))
    per_rule = per_rule.withColumn("_n", F.floor(F.aggregate("_hits", F.lit(0).cast("long"), step) / 1000))
    whole = per_rule.filter("_n > 0").select("doc_id", "_form", "licence", "_n", F.col("_hits._pos")[0].alias("_first"), F.element_at("_hits._pos", -1).alias("_last"))
    per_form = whole.groupBy("doc_id", "_form", "licence").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    best = per_form.groupBy("doc_id", "licence").agg(F.max(F.struct("_n", (F.col("_form") == "line").alias("_line"), "_first", "_last")).alias("_best"))
    return best.select("doc_id", "licence", F.col("_best._n").alias("n_matches"), F.col("_best._first").alias("first_sentence"), F.col("_best._last").alias("last_sentence"))
