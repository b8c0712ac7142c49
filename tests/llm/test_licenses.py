"""Licence texts as they are found: headers wrapped at 76 columns, titles, and lines that name a licence."""

import textwrap

from turnwise.llm import licenses

S = {k: v[0].rstrip(":") for k, v in licenses.SENTENCES.items()}


def wrapped(*names, sign=""):
    return "\n".join(textwrap.wrap(" ".join(S[n] + ("." if not S[n].endswith(".") else "") for n in names), 76, initial_indent=sign, subsequent_indent=sign))


TEXTS = {
    "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;": "GPL-2.0-or-later", "It is licensed under the MIT License.": "MIT", "# Released under GPLv3.": "GPL-3.0", "Distributed under the ISC License": "ISC",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": "GPL-3.0", "  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/": "Apache-2.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n\nVersion 3, 19 November 2007": "AGPL-3.0",
    wrapped("MIT_grant", "MIT_notice", "MIT_as_is"): "MIT", wrapped("ISC_grant", "ISC_as_is"): "ISC", wrapped("BSD_redistribute", "BSD_source", "BSD_binary", "BSD_endorse"): "BSD-3-Clause", wrapped("BSD_redistribute", "BSD_source", "BSD_binary"): "BSD-2-Clause",
    wrapped("GPL_free", "GPL_hope", "GPL_see", "GPL_copy", sign="# "): "GPL-3.0-or-later", wrapped("GPL2_free", "GPL_hope", "GPL_see", sign=" * "): "GPL-2.0-or-later", wrapped("LGPL21_free", "LGPL_hope", "LGPL_see"): "LGPL-2.1-or-later", wrapped("LGPL3_free", "LGPL_hope", "LGPL_see", sign="// "): "LGPL-3.0-or-later",
    wrapped("AGPL3_free", "GPL_hope", "AGPL_see"): "AGPL-3.0-or-later", wrapped("Unlicense_free"): "Unlicense", wrapped("Zlib_grant"): "Zlib", wrapped("MPL2_ref"): "MPL-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    https://www.apache.org/licenses/LICENSE-2.0\n\nUnless": "Apache-2.0",
    "A license to print money. The permission was granted.": "", "spdx license": "", "The software is provided to the author.": "",
}


def test_licence_texts(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS), (999, None)], "doc_id long, text string")
    found = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(rows).collect()}
    for k, (text, want) in enumerate(TEXTS.items()):
        assert found[k] == (want, ""), text
    assert found[999] == ("", "")


def test_every_licence_of_a_rule_is_found_by_its_sentences(spark):
    rows = [(k, ". \n".join(S[x] for x in rule)) for k, (_, rule) in enumerate(licenses.RULES)]
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: name for k, (name, _) in enumerate(licenses.RULES)} == found
