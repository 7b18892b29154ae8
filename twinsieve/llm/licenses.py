"""Operator 10: licence scan by sentence rules, in DataFrame functions alone.

A text is split into sentences, each is put in lower case with runs of other signs than a-z and 0-9 as one space, and
looked up among known licence sentences. The identifiers found, in their order, are matched against ordered rules: a
rule holds if its identifiers follow one another, other known sentences between them or not. Sentences are cut twice,
at line ends and with wrapped lines joined, and a rule may hold in either reading.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_CLAUSE_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
_CLAUSE_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
#: Known sentences. A sentence ends at a full stop before white space, so "v. 2.0" ends one and "Version 2.0" doesn't.
SENTENCES = [
    ("mit-named", ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Licensed under the MIT license", "This software is released under the MIT License", "Distributed under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "MIT License", "The MIT License"]),
    ("mit-grant", ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"]),
    ("mit-notice", ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"]),
    ("mit-warranty", ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"]),
    ("apache-named", ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "Released under the Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"]),
    ("apache-grant", ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"]),
    ("apache-copy", ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"]),
    ("apache-warranty", ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"]),
    ("gpl3-named", ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    ("gpl2-named", ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"]),
    ("gpl3-later", ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later"]),
    ("gpl2-later", ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-or-later"]),
    ("gpl-warranty", ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"]),
    ("lgpl3-named", ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"]),
    ("agpl3-named", ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"]),
    ("mpl2-named", ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"]),
    ("bsd-grant", ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"]),
    ("bsd-1", [_CLAUSE_1, f"1. {_CLAUSE_1}"]),
    ("bsd-2", [_CLAUSE_2, f"2. {_CLAUSE_2}"]),
    ("bsd-3", ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"]),
    ("bsd2-named", ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"]),
    ("bsd3-named", ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"]),
    ("isc-grant", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "SPDX-License-Identifier: ISC"]),
    ("unlicense", ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"]),
    ("cc0-named", ["SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0", "This work is dedicated to the public domain under the CC0 1.0 license"]),
    ("cc-by", ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"]),
    ("cc-by-sa", ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"]),
    ("cc-by-nc", ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"]),
]
#: (licence, sentences in their order, licences that it makes superfluous)
RULES = [
    ("AGPL-3.0-only", ["agpl3-named"], []),
    ("Apache-2.0", ["apache-named"], []),
    ("Apache-2.0", ["apache-grant", "apache-copy"], []),
    ("Apache-2.0", ["apache-grant", "apache-warranty"], []),
    ("BSD-2-Clause", ["bsd2-named"], []),
    ("BSD-2-Clause", ["bsd-grant", "bsd-1", "bsd-2"], []),
    ("BSD-3-Clause", ["bsd3-named"], []),
    ("BSD-3-Clause", ["bsd-grant", "bsd-1", "bsd-2", "bsd-3"], ["BSD-2-Clause"]),
    ("CC-BY-4.0", ["cc-by"], []),
    ("CC-BY-NC-4.0", ["cc-by-nc"], []),
    ("CC-BY-SA-4.0", ["cc-by-sa"], []),
    ("CC0-1.0", ["cc0-named"], []),
    ("GPL-2.0-only", ["gpl2-named"], []),
    ("GPL-2.0-or-later", ["gpl2-later"], []),
    ("GPL-3.0-only", ["gpl3-named"], []),
    ("GPL-3.0-or-later", ["gpl3-later"], []),
    ("ISC", ["isc-grant"], []),
    ("LGPL-3.0-only", ["lgpl3-named"], []),
    ("MIT", ["mit-named"], []),
    ("MIT", ["mit-grant", "mit-notice"], []),
    ("MIT", ["mit-grant", "mit-warranty"], []),
    ("MPL-2.0", ["mpl2-named"], []),
    ("Unlicense", ["unlicense"], []),
]
#: Every known sentence has one of these; a text without any of them needs no splitting.
TRIGGER = "(?i)licen|copyright|permission|redistribut|warrant|public domain|cc0"
#: Where sentences end; the first reading also cuts at each line end, the second at empty lines only.
LINES = r"[.!?;]*\s*\n|[.!?;]+\s+|:\s*\n"
JOINED = r"\n\s*\n|[.!?]+\s+|:\s*\n"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, int]:
    """Normalised sentence -> identifier."""
    return {normal(s): k + 1 for k, (_, texts) in enumerate(SENTENCES) for s in texts}


def rules() -> list[tuple[str, str, list[str]]]:
    """(licence, pattern over ",3,7,"-like lists of identifiers, licences made superfluous)."""
    number = {name: k + 1 for k, (name, _) in enumerate(SENTENCES)}
    return [(licence, "," + ",(?:[0-9]+,)*".join(str(number[n]) for n in names) + ",", less) for licence, names, less in RULES]


def _found(text: Column, cut: str, lookup: Column) -> Column:
    clean = F.transform(F.split(text, cut), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(F.transform(clean, lambda s: F.try_element_at(lookup, s)), lambda k: k.isNotNull())


def _listed(ids: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(F.transform(ids, lambda k: k.cast("string")), ","), F.lit(","))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df, without a shuffle; other columns are neither read nor returned.

    licenses: names of the licences found, sorted, joined by commas, "" for none; n_licenses; sentences: identifiers
    of the known sentences in the first reading, in order; n_sentences; mentions: whether the text has a trigger word,
    so that one without a licence is worth a look. A null or empty text has none of all that.
    """
    lookup = F.create_map(*[F.lit(x) for s, k in known().items() for x in (s, k)])
    text = F.col(text_col).cast("string")
    mentions = F.coalesce(F.rlike(text, F.lit(TRIGGER)), F.lit(False))
    none = F.array().cast("array<int>")
    stage = df.select(F.col(id_col), mentions.alias("mentions"), F.when(mentions, text).alias("_text"))
    stage = stage.select(id_col, "mentions", *(F.when(F.col("mentions"), _found(F.col("_text"), cut, lookup)).otherwise(none).alias(c) for c, cut in (("_lines", LINES), ("_joined", JOINED))))
    stage = stage.select(id_col, "mentions", F.size("_lines").cast("bigint").alias("n_sentences"), F.array_join(F.transform("_lines", lambda k: k.cast("string")), ",").alias("sentences"), _listed(F.col("_lines")).alias("_a"), _listed(F.col("_joined")).alias("_b"))
    holds = [(licence, F.rlike("_a", F.lit(p)) | F.rlike("_b", F.lit(p)), less) for licence, p, less in rules()]
    hit = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(x)) for x, h, _ in holds]))))
    gone = F.array_compact(F.array(*[F.when(h, F.lit(x)) for _, h, less in holds for x in less]))
    stage = stage.withColumn("_hit", F.array_except(hit, gone))
    return stage.select(id_col, F.size("_hit").cast("bigint").alias("n_licenses"), F.array_join("_hit", ",").alias("licenses"), "n_sentences", "sentences", "mentions")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    keys = ", ".join(f"{q(s)}: {k}" for s, k in known().items())

    def lists(cut: str) -> str:
        return f"list_filter(list_transform(string_split_regex(text, {q(cut)}), lambda s: MAP {{{keys}}}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL)"

    hits = ", ".join(f"CASE WHEN regexp_matches(a, {q(p)}) OR regexp_matches(b, {q(p)}) THEN {q(x)} END" for x, p, _ in rules())
    gone = ", ".join(f"CASE WHEN regexp_matches(a, {q(p)}) OR regexp_matches(b, {q(p)}) THEN {q(y)} END" for _, p, less in rules() for y in less)
    return f"""
WITH t AS (SELECT doc_id, text, coalesce(regexp_matches(text, {q(TRIGGER)}), false) AS mentions FROM documents),
s AS (SELECT doc_id, mentions, CASE WHEN mentions THEN {lists(LINES)} ELSE [] END AS l, CASE WHEN mentions THEN {lists(JOINED)} ELSE [] END AS j FROM t),
r AS (SELECT doc_id, mentions, len(l) AS n_sentences, coalesce(array_to_string(l, ','), '') AS sentences, ',' || coalesce(array_to_string(l, ','), '') || ',' AS a, ',' || coalesce(array_to_string(j, ','), '') || ',' AS b FROM s),
h AS (SELECT *, [{hits}] AS hit, [{gone}] AS gone FROM r),
f AS (SELECT *, list_sort(list_distinct(list_filter(hit, lambda x: x IS NOT NULL AND NOT list_contains(list_filter(gone, lambda g: g IS NOT NULL), x)))) AS found FROM h)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_licenses, coalesce(array_to_string(found, ','), '') AS licenses, CAST(n_sentences AS BIGINT) AS n_sentences, sentences, mentions FROM f
"""
