"""License scans by sentence rules: sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier -> the sentences that it stands for, as they are written in licences.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MIT_ref": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "MIT License", "The MIT License"),
    "MIT_grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "MIT_notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "MIT_as_is": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "Apache2_ref": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Apache License, Version 2.0", "Released under the Apache License, Version 2.0"),
    "Apache2_comply": ("you may not use this file except in compliance with the License", "you may not use this work except in compliance with the License"),
    "Apache2_copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "GPL3_ref": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU GPL version 3", "Released under the GNU General Public License, version 3"),
    "GPL2_ref": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2"),
    "LGPL3_ref": ("Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    "AGPL3_ref": ("Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"),
    "GPL_free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GPL_hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "GPL_see": ("See the GNU General Public License for more details",),
    "GPL_copy": ("You should have received a copy of the GNU General Public License along with this program",),
    "BSD_redistribute": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD_source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BSD_binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "BSD_endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "BSD_ref": ("Licensed under the BSD License", "Released under the BSD License"),
    "MPL2_ref": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "CC_BY_ref": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC-BY 4.0"),
    "CC_BY_SA_ref": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC_BY_NC_ref": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0_ref": ("Released under CC0 1.0", "Licensed under CC0 1.0"),
    "Reserved": ("All rights reserved",),
    "LGPL21_free": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "LGPL3_free": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GPL2_free": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    "AGPL3_free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "LGPL_hope": ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "LGPL_see": ("See the GNU Lesser General Public License for more details",),
    "AGPL_see": ("See the GNU Affero General Public License for more details",),
    "GPL3_title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "GPL2_title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL3_title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "AGPL3_title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "Apache2_title": ("Apache License Version 2.0, January 2004",),
    "ISC_grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "ISC_as_is": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",),
    "Unlicense_free": ("This is free and unencumbered software released into the public domain",),
    "Zlib_grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
}
#: What stands before the name of a licence, and the names, by the identifier and the licence that they refer to.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "This project is licensed under", "This software is licensed under", "This program is licensed under", "This work is licensed under", "This file is licensed under", "This code is licensed under", "It is licensed under", "Available under")
NAMES = {
    "MIT_ref": ("the MIT License",), "Apache2_ref": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"), "GPL3_ref": ("the GNU General Public License, version 3", "the GNU GPL version 3", "the GNU GPL v3", "GPLv3", "the GPLv3"),
    "GPL2_ref": ("the GNU General Public License, version 2", "the GNU GPL version 2", "the GNU GPL v2", "GPLv2", "the GPLv2"), "LGPL3_ref": ("the GNU Lesser General Public License, version 3", "LGPLv3", "the LGPLv3"), "LGPL21_ref": ("the GNU Lesser General Public License, version 2.1", "LGPLv2.1", "the LGPLv2.1"),
    "AGPL3_ref": ("the GNU Affero General Public License, version 3", "AGPLv3", "the AGPLv3"), "MPL2_ref": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"), "BSD_ref": ("the BSD License", "the BSD license"), "BSD3_ref": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "BSD2_ref": ("the BSD 2-Clause License", "the 2-Clause BSD License"), "ISC_ref": ("the ISC License",), "Unlicense_ref": ("the Unlicense",), "Zlib_ref": ("the zlib License",), "CC0_ref": ("CC0 1.0", "CC0"), "CC_BY_ref": ("CC BY 4.0",), "CC_BY_SA_ref": ("CC BY-SA 4.0",), "CC_BY_NC_ref": ("CC BY-NC 4.0",),
}
SENTENCES |= {k: tuple(dict.fromkeys((*SENTENCES.get(k, ()), *(f"{o} {n}" for n in names for o in OPENINGS)))) for k, names in NAMES.items()}
#: Licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 Unlicense Zlib CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 BSL-1.0 EPL-2.0 0BSD".split()
SENTENCES |= {f"SPDX_{x}": (f"SPDX-License-Identifier: {x}",) for x in SPDX}
#: Licence, the identifiers that make it, in order. The rules are tried from the top; what a rule has matched is spent.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("Apache2_ref", "Apache2_comply", "Apache2_copy")),
    ("GPL-3.0-or-later", ("GPL_free", "GPL_hope", "GPL_see", "GPL_copy")),
    ("GPL-3.0-or-later", ("GPL_free", "GPL_hope", "GPL_see")),
    ("BSD-3-Clause", ("BSD_redistribute", "BSD_source", "BSD_binary", "BSD_endorse")),
    ("BSD-2-Clause", ("BSD_redistribute", "BSD_source", "BSD_binary")),
    ("MIT", ("MIT_ref", "MIT_grant", "MIT_notice", "MIT_as_is")),
    ("MIT", ("MIT_grant", "MIT_notice", "MIT_as_is")),
    ("AGPL-3.0-or-later", ("AGPL3_free", "GPL_hope", "AGPL_see")),
    ("LGPL-2.1-or-later", ("LGPL21_free", "LGPL_hope", "LGPL_see")),
    ("LGPL-3.0-or-later", ("LGPL3_free", "LGPL_hope", "LGPL_see")),
    ("GPL-2.0-or-later", ("GPL2_free", "GPL_hope", "GPL_see")),
    ("ISC", ("ISC_grant", "ISC_as_is")),
    ("ISC", ("ISC_ref", "ISC_grant")),
    ("Apache-2.0", ("Apache2_ref",)),
    ("Apache-2.0", ("Apache2_title",)),
    ("GPL-3.0-or-later", ("GPL_free",)),
    ("GPL-2.0-or-later", ("GPL2_free",)),
    ("LGPL-2.1-or-later", ("LGPL21_free",)),
    ("LGPL-3.0-or-later", ("LGPL3_free",)),
    ("AGPL-3.0-or-later", ("AGPL3_free",)),
    ("GPL-3.0", ("GPL3_title",)),
    ("GPL-2.0", ("GPL2_title",)),
    ("LGPL-3.0", ("LGPL3_title",)),
    ("AGPL-3.0", ("AGPL3_title",)),
    ("ISC", ("ISC_grant",)),
    ("ISC", ("ISC_ref",)),
    ("Unlicense", ("Unlicense_free",)),
    ("Unlicense", ("Unlicense_ref",)),
    ("Zlib", ("Zlib_grant",)),
    ("Zlib", ("Zlib_ref",)),
    ("LGPL-2.1", ("LGPL21_ref",)),
    ("BSD-3-Clause", ("BSD3_ref",)),
    ("BSD-2-Clause", ("BSD2_ref",)),
    ("GPL-3.0", ("GPL3_ref",)),
    ("GPL-2.0", ("GPL2_ref",)),
    ("LGPL-3.0", ("LGPL3_ref",)),
    ("AGPL-3.0", ("AGPL3_ref",)),
    ("MIT", ("MIT_ref",)),
    ("MPL-2.0", ("MPL2_ref",)),
    ("BSD", ("BSD_ref",)),
    ("CC-BY-4.0", ("CC_BY_ref",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_ref",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_ref",)),
    ("CC0-1.0", ("CC0_ref",)),
    ("All-Rights-Reserved", ("Reserved",)),
    *((x, (f"SPDX_{x}",)) for x in SPDX),
)


def _plain(sentence: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: Normalised sentence -> identifier.
KNOWN = {_plain(x): name for name, found in SENTENCES.items() for x in found}
#: A word from each known sentence: a text with none of them holds no known sentence.
TRIGGERS = ("licen", "gpl", "unencumbered", "cc by", "permission", "copyright", "redistribut", "warrant", "copy of", "all rights", "cc0", "useful")
assert all(any(t in x for t in TRIGGERS) for x in KNOWN), "every known sentence must hold a trigger"


def _marked(text: Column) -> Column:
    """Only letters and digits, one space apart, with marks between: | where a sentence ends (. ? or a single ! before white
    space), # for blank lines (comment signs don't fill a line), / for other line ends and for : or ; before white space."""
    calm = F.regexp_replace(F.lower(text), "!!+", " ")
    # The dot of "v. 2.0" ends no sentence.
    joined = F.regexp_replace(calm, r"v\.\s", "v ")
    ended = F.regexp_replace(joined, r"[.?!][^a-z0-9\s]*(?=\s)", "\u0001")
    blank = F.regexp_replace(ended, r"\n(?:[^a-z0-9\n\u0001]*\n)+", "\u0002")
    soft = F.regexp_replace(blank, r"\n|[:;](?=\s)", "\u0003")
    plain = F.regexp_replace(soft, r"[^a-z0-9\u0001\u0002\u0003]+", " ")
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "\u0001", " | "), "\u0002", " # "), "\u0003", " / ")
    return F.concat(F.lit("| "), F.regexp_replace(F.trim(marks), " +", " "), F.lit(" |"))


def _sought() -> str:
    """A pattern of a known sentence between two marks, longer ones first. Words may be parted by a / (a wrapped line), the
    address in the Apache header and the version behind a title by a blank line too."""
    one = lambda s: s.replace(" ", " (?:/ )*").replace(" (?:/ )*http ", " (?:[/#] )*http ").replace(" (?:/ )*https ", " (?:[/#] )*https ").replace(" (?:/ )*version ", " (?:[/#] )*version ")
    return "[|#/] (" + "|".join(one(s) for s in sorted(KNOWN, key=lambda s: (-len(s), s))) + ")(?= [|#/])"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (identifiers in text order), licenses (distinct, in name order), n_matches, unmatched of every row.

    unmatched: identifiers that no rule used. Null, empty and licence-free texts give empty lists; repeated rows are scanned
    alike. One projection: no shuffle and no state between rows. Texts without a trigger word aren't cut into sentences.
    Sentences may be wrapped over lines, also behind comment signs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    hot = F.lit(False)
    for word in TRIGGERS:
        hot = hot | (low.rlike(word.replace(" ", "[^a-z0-9]+")) if " " in word else low.contains(word))
    lookup = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    df = docs.select("doc_id", F.when(hot, F.regexp_extract_all(_marked(text), F.lit(_sought()), 1)).alias("_s"))
    ids = F.transform("_s", lambda s: F.element_at(lookup, F.regexp_replace(s, "[/#] ", "")))
    df = df.select("doc_id", F.coalesce(ids, F.array().cast("array<string>")).alias("sentence_ids"))
    df = df.withColumn("_left", F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")))
    found = []
    for k, (name, sequence) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in sequence)
        df = df.withColumn(f"_n{k}", ((F.length("_left") - F.length(F.replace("_left", F.lit(pattern), F.lit("")))) / len(pattern)).cast("long"))
        df = df.withColumn("_left", F.replace("_left", F.lit(pattern), F.lit("|")))
        found.append((name, F.col(f"_n{k}")))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(n > 0, F.lit(name)) for name, n in found)))))
    total = sum((n for _, n in found[1:]), found[0][1])
    unmatched = F.regexp_extract_all("_left", F.lit("<([^>]+)>"), 1)
    return df.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join(names, ",").alias("licenses"), total.alias("n_matches"), F.array_join(unmatched, ",").alias("unmatched"))


def oracle() -> str:
    """DuckDB SQL for the scan of documents."""
    quoted = ", ".join(f"'{k}': '{v}'" for k, v in KNOWN.items())
    hot = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in TRIGGERS)
    steps, last = [], "ids"
    for k, (_, sequence) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in sequence)
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest), ((length(rest) - length(replace(rest, '{pattern}', ''))) // {len(pattern)})::BIGINT AS n{k}, replace(rest, '{pattern}', '|') AS rest FROM {last})")
        last = f"r{k}"
    names = ", ".join(f"CASE WHEN n{k} > 0 THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    total = " + ".join(f"n{k}" for k in range(len(RULES)))
    return f"""
WITH known AS (SELECT MAP {{{quoted}}} AS m),
cut AS (SELECT doc_id, CASE WHEN {hot} THEN list_transform(
    regexp_split_to_array(replace(replace(regexp_replace(lower(coalesce(text, '')), '!!+', ' ', 'g'), 'v. ', 'v '), 'license-identifier: ', 'license-identifier '), '\\n|[.?!][^a-z0-9\\s]*\\s|:\\s'),
    lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) ELSE [] END AS s FROM documents),
named AS (SELECT doc_id, list_filter(list_transform(s, lambda x: m[x]), lambda x: x IS NOT NULL) AS i FROM cut, known),
ids AS (SELECT doc_id, array_to_string(i, ',') AS sentence_ids, array_to_string(list_transform(i, lambda x: '<' || x || '>'), '') AS rest FROM named),
{", ".join(steps)}
SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ','), '') AS licenses,
  ({total})::BIGINT AS n_matches, coalesce(array_to_string(regexp_extract_all(rest, '<([^>]+)>', 1), ','), '') AS unmatched
FROM {last}"""
