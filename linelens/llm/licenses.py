"""License scans by sentence rules.

Texts are cut into sentences, a sentence is brought to a normal form (ASCII lower case, every other run of
characters one blank), and known license sentences are replaced by their identifiers. The identifiers that
stand one after another in a document (other sentences between them are passed over) form a sequence, and
the ordered rules are matched against it: longer rules come first, and what a rule has matched is taken out
before the next one, so a full license text is not reported once more by one of its lines. Each step is a
row-local expression; nothing is shuffled, and the known sentences are one pattern and a literal map.

A sentence ends at . ; : ! or ? before white space, at a blank line and with the line of a tag or of an address at its
end. Another line feed before a small letter is a wrapped line. Any other single line feed may be either, so a known sentence may begin and end there and may run
on over it. Comment marks without letters (#, *, //, --) are white space, a line of them alone is a blank line.
FRAMED sentences are known by their fixed parts, whatever name stands between them.

What follows an SPDX tag on its line is an expression: its operands (parted by OR or AND, brackets ignored) count as a
tag each, "+" after a GNU version is "or later", and an exception after WITH is passed over. "All rights reserved"
alone is proprietary only if no license follows it, as it does in the heads of many open license texts.

The DuckDB twin follows the same rules; without lookarounds it doubles the sentence ends and matches one at each side.

Defined cases: null and empty texts have no sentence and no license; doc_id may be null or repeated; a license
found several times is listed once; extra columns are dropped, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import table

NAME = "op2_license_scan"

# Sentences of public license texts and the usual notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "spdx": ["SPDX-License-Identifier:"],
    "name-mit": ["MIT"],
    "name-apache-2": ["Apache-2.0"],
    "name-gpl-2": ["GPL-2.0"],
    "name-gpl-2-only": ["GPL-2.0-only"],
    "name-gpl-2-later": ["GPL-2.0-or-later"],
    "name-gpl-3": ["GPL-3.0"],
    "name-gpl-3-only": ["GPL-3.0-only"],
    "name-gpl-3-later": ["GPL-3.0-or-later"],
    "name-lgpl-2-1": ["LGPL-2.1"],
    "name-lgpl-2-1-only": ["LGPL-2.1-only"],
    "name-lgpl-2-1-later": ["LGPL-2.1-or-later"],
    "name-lgpl-3": ["LGPL-3.0"],
    "name-lgpl-3-only": ["LGPL-3.0-only"],
    "name-lgpl-3-later": ["LGPL-3.0-or-later"],
    "name-agpl-3": ["AGPL-3.0"],
    "name-agpl-3-only": ["AGPL-3.0-only"],
    "name-agpl-3-later": ["AGPL-3.0-or-later"],
    "name-bsd-0": ["0BSD"],
    "name-bsd-2": ["BSD-2-Clause"],
    "name-bsd-3": ["BSD-3-Clause"],
    "name-mpl-2": ["MPL-2.0"],
    "name-epl-1": ["EPL-1.0"],
    "name-epl-2": ["EPL-2.0"],
    "name-isc": ["ISC"],
    "name-boost": ["BSL-1.0"],
    "name-zlib": ["Zlib"],
    "name-unlicense": ["Unlicense"],
    "name-cc0": ["CC0-1.0"],
    "name-cc-by": ["CC-BY-4.0"],
    "name-cc-by-sa": ["CC-BY-SA-4.0"],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "Distributed under the MIT License.", "This work is licensed under the MIT License."],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-include": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-notice": ["Licensed under the ISC License.", "Released under the ISC License."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-permit": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-notice-2": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "bsd-notice-3": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "Licensed under the New BSD License."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0."],
    "apache-head": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl-free": ["This program is free software:", "This library is free software:", "This file is free software:"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "agpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation;"],
    "either-2": ["either version 2 of the License, or (at your option) any later version."],
    "either-2-1": ["either version 2.1 of the License, or (at your option) any later version."],
    "either-3": ["either version 3 of the License, or (at your option) any later version."],
    "only-2": ["version 2.", "version 2 of the License.", "only version 2 of the License."],
    "only-2-1": ["version 2.1.", "version 2.1 of the License.", "only version 2.1 of the License."],
    "only-3": ["version 3.", "version 3 of the License.", "only version 3 of the License."],
    "gpl-2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "gpl-3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."],
    "gpl-3-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."],
    "lgpl-2-1-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-3-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-3-later": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."],
    "gpl-notice-2": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2."],
    "gpl-notice-3": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "lgpl-notice-3": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."],
    "agpl-notice-3": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3."],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "epl-1-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl-2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "mpl-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-subject-v": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl-notice": ["Licensed under the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under CC BY-NC-ND 4.0."],
    "cc0-notice": ["Licensed under CC0 1.0.", "Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0."],
    "reserved": ["All rights reserved."],
}

#: Sentences with a name in them: what stands before and after it. The name may hold a dot, as in "Inc.".
FRAMED: dict[str, tuple[str, str]] = {
    "bsd-endorse": ("Neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
}

_GNU_END = ["gpl-hope", "gpl-implied", "gpl-details"]
_GNU_HEADS: list[tuple[str, list[str]]] = [
    ("GPL-2.0-or-later", ["gpl-terms", "either-2"]),
    ("GPL-3.0-or-later", ["gpl-terms", "either-3"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "either-2-1"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "either-3"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "either-3"]),
    ("GPL-2.0-only", ["gpl-terms", "only-2"]),
    ("GPL-3.0-only", ["gpl-terms", "only-3"]),
    ("LGPL-2.1-only", ["lgpl-terms", "only-2-1"]),
    ("LGPL-3.0-only", ["lgpl-terms", "only-3"]),
    ("AGPL-3.0-only", ["agpl-terms", "only-3"]),
    ("GPL-2.0-or-later", ["gpl-2-later"]),
    ("GPL-3.0-or-later", ["gpl-3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-2-1-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later"]),
    ("AGPL-3.0-or-later", ["agpl-3-later"]),
    ("GPL-2.0-only", ["gpl-2-terms"]),
    ("GPL-3.0-only", ["gpl-3-terms"]),
]
_TEXTS: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-head", "apache-comply", "apache-copy", "apache-warranty", "apache-see"]),
    ("MIT", ["mit-title", "mit-grant", "mit-include", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-include", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-permit", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-head", "apache-comply"]),
    ("MPL-2.0", ["mpl-subject", "mpl-copy"]),
    ("MPL-2.0", ["mpl-subject-v", "mpl-copy"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("BSD-2-Clause", ["bsd-notice-2"]),
    ("BSD-3-Clause", ["bsd-notice-3"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-2.0", ["gpl-notice-2"]),
    ("GPL-3.0", ["gpl-notice-3"]),
    ("LGPL-3.0", ["lgpl-notice-3"]),
    ("AGPL-3.0", ["agpl-notice-3"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("EPL-1.0", ["epl-1-notice"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Proprietary", ["reserved"]),
]
_TAGS = [(names[0], ["spdx", i]) for i, names in SENTENCES.items() if i.startswith("name-")]
#: The ordered rules: license, identifiers that must follow one another. Longer rules stand first, RESERVED last.
RULES: list[tuple[str, list[str]]] = sorted(
    [(name, ["gpl-free", *ids, *end]) for end in (_GNU_END, []) for name, ids in _GNU_HEADS] + _TAGS + _TEXTS, key=lambda r: -len(r[1]))
#: The identifier that makes a license only where none follows it.
RESERVED = "reserved"
TAG = "spdx license identifier"
#: What ends with its line, whatever letter the next one begins with: tags, and lines that end in an address.
LINE_END = r"((?i:SPDX-License-Identifier):[^\n]*|https?://[^ \t\r\n]+[ \t\r]*)\n"


def normal(sentence: str) -> str:
    """The normal form of one sentence, as the expressions below make it."""
    low = sentence.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.sub(r"[^a-z0-9]+", " ", low).strip()


def known_sentences(sentences: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    return {normal(s): k for k, v in sentences.items() for s in v}


def rule_text(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def operand(name: str) -> str:
    """A normal name as an operand: without a word that parts operands."""
    return name.replace(" or later", " later")


def known_operands(sentences: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    return {operand(s): i for s, i in known_sentences(sentences).items() if i.startswith("name-")}


def sentence_pattern(sentences: dict[str, list[str]] = SENTENCES, framed: dict[str, tuple[str, str]] = FRAMED, line: str = r"\n", end: str = r"\x01") -> str:
    """Matches the known sentences, tags with their expressions first, then the longest. ``line`` is how a line feed, ``end`` how a sentence end stands in the text."""
    wrapped = lambda s: s.replace(" ", f"(?: |{line})")
    whole = [wrapped(s) for s in sorted(known_sentences(sentences), key=len, reverse=True)]
    parts = [wrapped(normal(a)) + f"(?: |{line})(?:[a-z0-9 ]|{line}|{end})+?(?: |{line}|{end})" + wrapped(normal(b)) for a, b in framed.values()]
    return "(?:" + "|".join([f"{TAG}{end}[a-z0-9 ]+", *whole, *parts]) + ")"


def sentence_ids(text: Column, sentences: dict[str, list[str]] = SENTENCES, framed: dict[str, tuple[str, str]] = FRAMED) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    literal_map = lambda d: F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*map(F.lit, d.values())))
    t = F.translate(F.coalesce(text, F.lit("")), "\x01", " ")
    t = F.regexp_replace(t, r"(GPL-[0-9][.][0-9])[+]", "$1-or-later")
    t = F.regexp_replace(t, LINE_END, "$1\x01")
    t = F.regexp_replace(t, r"([^ \t\r\n])[ \t\r]*\n[ \t]*(?=\p{Ll})", "$1 ")
    t = F.regexp_replace(t, r"([.;:!?])[ \t\r\n]+", "$1\x01")
    t = F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    t = F.regexp_replace(t, r"[^a-z0-9\n\x01]+", " ")
    t = F.trim(F.regexp_replace(t, r" ?([\n\x01]) ?", "$1"))
    found = F.regexp_extract_all(t, F.lit(r"(?<![^\n\x01])" + sentence_pattern(sentences, framed) + r"(?![^\n\x01])"), F.lit(0))
    names, operands = literal_map(known_sentences(sentences)), literal_map(known_operands(sentences))
    whole = lambda s: F.coalesce(F.try_element_at(names, s), *[F.when(s.startswith(normal(a) + " ") & s.endswith(" " + normal(b)), F.lit(i)) for i, (a, b) in framed.items()])

    def tagged(s: Column) -> Column:
        expression = F.replace(F.substring(s, len(TAG) + 2, 2**31 - 1), F.lit(" or later"), F.lit(" later"))
        parts = F.split(F.regexp_replace(expression, r" with [a-z0-9 ]*?( or | and |$)", "$1"), " (?:or|and) ")
        ids = F.filter(F.transform(parts, lambda p: F.try_element_at(operands, p)), lambda i: i.isNotNull())
        return F.when(F.size(ids) == 0, F.array(F.lit("spdx"))).otherwise(F.flatten(F.transform(ids, lambda i: F.array(F.lit("spdx"), i))))

    plain = F.transform(found, lambda s: F.translate(s, "\n\x01", "  "))
    return F.flatten(F.transform(plain, lambda s: F.when(s.startswith(TAG + " "), tagged(s)).otherwise(F.array(whole(s)))))


def match_rules(sequence: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Licenses whose rules match a sequence ``<id><id>...``, each once, in the order of the rules."""
    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(rule_text(ids)).alias("ids")) for name, ids in rules])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    reserved = rule_text([RESERVED])
    holds = lambda rest, ids: F.contains(rest, ids) & ((ids != reserved) | ~F.contains(F.substring_index(rest, reserved, -1), F.lit("<>")))
    step = lambda acc, r: F.struct(
        F.replace(acc["rest"], r["ids"], F.lit("<>")).alias("rest"),
        F.when(holds(acc["rest"], r["ids"]), F.array_append(acc["found"], r["license"])).otherwise(acc["found"]).alias("found"),
    )
    found = F.aggregate(listed, start, step, lambda acc: acc["found"])
    return F.when(sequence == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def license_scan(docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """doc_id, sentence_ids (array) and licenses (array) of every document."""
    d = docs.select("doc_id", sentence_ids(F.col("text"), sentences).alias("sentence_ids"))
    sequence = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    return d.withColumn("licenses", match_rules(sequence, rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses (both joined by commas) of every document."""
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    literal_map = lambda d: f"map([{', '.join(repr(k) for k in d)}], [{', '.join(repr(v) for v in d.values())}])"
    framed = " ".join(f"WHEN starts_with(s, '{normal(a)} ') AND ends_with(s, ' {normal(b)}') THEN ['{i}']" for i, (a, b) in FRAMED.items())
    reserved = rule_text([RESERVED])
    hit = lambda k, ids: f"contains(q{k}, '{rule_text(ids)}')" + (f" AND NOT contains(string_split(q{k}, '{reserved}')[-1], '<>')" if ids == [RESERVED] else "")
    steps = ", ".join(f"replace(q{k}, '{rule_text(ids)}', '<>') AS q{k + 1}, CASE WHEN {hit(k, ids)} THEN '{name}' END AS h{k}" for k, (name, ids) in enumerate(RULES))
    hits = ", ".join(f"h{k}" for k in range(len(RULES)))
    wrap = lambda x: rf"regexp_replace({x}, '([^ \t\r\n])[ \t\r]*\n[ \t]*(\p{{Ll}})', '\1 \2', 'g')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(translate(coalesce(text, ''), chr(1), ' '), '(GPL-[0-9][.][0-9])[+]', '\1-or-later', 'g') AS text FROM documents),
parted AS (SELECT rid, doc_id, regexp_replace(translate(regexp_replace({wrap(wrap(f"regexp_replace(text, '{LINE_END}', '{chr(92)}1' || chr(1), 'g')"))}, '([.;:!?])[ \t\r\n]+', '\1' || chr(1), 'g'),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^a-z0-9\n\x01]+', ' ', 'g') AS t FROM d),
ends AS (SELECT rid, doc_id, chr(10) || regexp_replace(trim(regexp_replace(t, ' ?([\n\x01]) ?', '\1', 'g'), ' '), '([\n\x01])', '\1\1', 'g') || chr(10) AS t FROM parted),
found AS (SELECT rid, doc_id, list_transform(regexp_extract_all(t, '[\n\x01]({sentence_pattern(line=r"\n\n", end=r"\x01\x01")})[\n\x01]', 1), lambda s: regexp_replace(s, '[\n\x01][\n\x01]', ' ', 'g')) AS f FROM ends),
ids AS (SELECT rid, doc_id, flatten(list_transform(f, lambda s: CASE WHEN starts_with(s, '{TAG} ') THEN
    list_prepend('spdx', flatten(list_transform(list_filter(list_transform(
      string_split_regex(regexp_replace(replace(substr(s, {len(TAG) + 2}), ' or later', ' later'), ' with [a-z0-9 ]*?( or | and |$)', '\1', 'g'), ' (?:or|and) '),
      lambda p: {literal_map(known_operands())}[p]), lambda i: i IS NOT NULL), lambda i: ['spdx', i]))[2:])
    {framed} ELSE [{literal_map(known_sentences())}[s]] END)) AS l FROM found),
seq AS (SELECT rid, doc_id, len(l) AS n, array_to_string(l, ',') AS ids, array_to_string(list_transform(l, lambda i: '<' || i || '>'), '') AS q0 FROM ids),
m AS (SELECT *, {steps} FROM seq)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids,
  coalesce((SELECT string_agg(l, ',' ORDER BY o) FROM (SELECT l, min(o) AS o FROM (SELECT unnest([{hits}]) AS l, unnest(range({len(RULES)})) AS o) GROUP BY l HAVING l IS NOT NULL)), '') AS licenses
FROM m
"""


ORACLE_SQL = _oracle()
