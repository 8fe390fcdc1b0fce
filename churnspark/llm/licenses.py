"""Licence scan by sentence rules: known sentences become identifiers, identifier sequences become licences.

A text that holds any anchor word is cut into sentences in two ways, per line and per paragraph (lines joined, so
wrapped licence texts work too). Sentences are normalised (A-Z lower-cased, everything but letters, digits and inner dots to
single blanks) and looked up in the table of known sentences. The identifiers, in order and without what is not
known between them, are matched against ordered rules: the first rules are the longest sequences, and what a
rule matches is used up, so a full licence text is not also reported by its parts. Identifiers left over are counted as
unmatched. Everything is array and string functions inside one scan; no shuffle.

A break is one of .!?; and a blank; the "v." of a version number is none. Licence texts have breaks inside what is one
sentence in other copies ("free software; you can" or ": you can"). ``|`` marks those places in the table: a known sentence
is there as a whole and cut at any of them, every piece is an identifier of its own, and the rules hold every way of cutting.

Every known sentence contains an anchor word (checked when the module is loaded), so the anchor test loses no licence.

Defined cases: null or empty text has no licence (empty string, counts 0); rows with equal ids are each judged; a licence
found several times is reported once, licences in code point order; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import ascii_lower

# Wording of public licences and of the usual references to them, normalised.
SENTENCES = {
    "apache-2.0-ref": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license",
                       "released under the apache license version 2.0", "this project is licensed under the apache license version 2.0",
                       "spdx license identifier apache 2.0", "licensed under the apache license 2.0"],
    "apache-2.0-comply": ["you may not use this file except in compliance with the license"],
    "apache-2.0-copy": ["you may obtain a copy of the license at | http www.apache.org licenses license 2.0",
                        "you may obtain a copy of the license at | https www.apache.org licenses license 2.0"],
    "apache-2.0-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed "
                        "on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-2.0-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                "distributed under the mit license", "spdx license identifier mit", "the mit license", "mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                  "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                  "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                  "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
                  "included in all copies or substantial portions of the software",
                  "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                  "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                  "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                  "furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                 "merchantability fitness for a particular purpose and noninfringement"],
    "mit-liable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
                   "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd-permitted": ["redistribution and use in source and binary forms with or without modification are permitted provided that the "
                      "following conditions are met", "redistribution and use in source and binary forms with or without modification are "
                      "permitted provided that the following conditions are met 1"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
                   "in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission"],
    "bsd-asis": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
                 "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liable": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
                   "consequential damages including but not limited to procurement of substitute goods or services | loss of use data or profits | "
                   "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
                   "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "bsd-ref": ["licensed under the bsd license", "released under the bsd license", "use of this source code is governed by a bsd style license "
                "that can be found in the license file"],
    "bsd-3-ref": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "bsd-2-ref": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "gpl-3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
                  "released under the gnu general public license version 3", "spdx license identifier gpl 3.0 only",
                  "spdx license identifier gpl 3.0 or later"],
    "gpl-2-ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2",
                  "spdx license identifier gpl 2.0 only", "spdx license identifier gpl 2.0 or later"],
    "gpl-3-redistribute": ["this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license "
                           "as published by the free software foundation | either version 3 of the license or at your option any later version"],
    "gpl-2-redistribute": ["this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license "
                           "as published by the free software foundation | either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty | without even the implied warranty of "
                 "merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "mpl-2-ref": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "spdx license identifier mpl 2.0"],
    "cc0-ref": ["licensed under cc0 1.0", "released under cc0 1.0", "this work is dedicated to the public domain under the cc0 license"],
    "cc-by-4-ref": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4-ref": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc-4-ref": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nc-nd-4-ref": ["licensed under cc by nc nd 4.0", "this work is licensed under cc by nc nd 4.0",
                          "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license"],
}
# Ordered rules: licence, sequence of sentences. Longer sequences first.
_SEQUENCES = (
    ("Apache-2.0", ("apache-2.0-ref", "apache-2.0-comply", "apache-2.0-copy", "apache-2.0-asis", "apache-2.0-see")),
    ("MIT", ("mit-ref", "mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("GPL-3.0-or-later", ("gpl-3-redistribute", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-2-redistribute", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-3-redistribute", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2-redistribute", "gpl-hope", "gpl-see")),
    ("MIT", ("mit-grant", "mit-asis", "mit-liable")),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liable")),
    ("BSD-2-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable")),
    ("Apache-2.0", ("apache-2.0-ref", "apache-2.0-comply")),
    ("GPL-3.0-or-later", ("gpl-3-redistribute",)),
    ("GPL-2.0-or-later", ("gpl-2-redistribute",)),
    ("Apache-2.0", ("apache-2.0-ref",)),
    ("MIT", ("mit-ref",)),
    ("BSD-3-Clause", ("bsd-3-ref",)),
    ("BSD-2-Clause", ("bsd-2-ref",)),
    ("BSD", ("bsd-ref",)),
    ("GPL-3.0", ("gpl-3-ref",)),
    ("GPL-2.0", ("gpl-2-ref",)),
    ("MPL-2.0", ("mpl-2-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
)
#: Every known sentence holds one of these.
ANCHORS = ("licens", "warrant", "copyright", "software", "permission", "redistribution", "cc0")
assert all(any(a in s for a in ANCHORS) for group in SENTENCES.values() for s in group)


def _cuts(sentence: str) -> list[tuple[str, ...]]:
    """The sentence cut at none, some or all of its marks, most pieces first."""
    parts = sentence.split(" | ")
    ways = product(("\n", " "), repeat=len(parts) - 1)
    return sorted((tuple("".join(p + m for p, m in zip(parts, (*way, ""))).split("\n")) for way in ways), key=len, reverse=True)


def _known() -> tuple[dict[str, str], dict[str, list[tuple[str, ...]]]]:
    """Piece -> identifier, and sentence -> its identifier sequences. A piece that several sentences share has one identifier."""
    known, forms = {}, {}
    for name, group in SENTENCES.items():
        for k, cut in enumerate(c for s in group for c in _cuts(s)):
            for n, piece in enumerate(cut):
                known.setdefault(piece, name if len(cut) == 1 else f"{name}/{k}.{n}")
            forms.setdefault(name, []).append(tuple(known[piece] for piece in cut))
    return known, {name: list(dict.fromkeys(f)) for name, f in forms.items()}


KNOWN, FORMS = _known()
#: Ordered rules: licence, sequence of identifiers; a sequence of sentences in every way of cutting them.
RULES = tuple((licence, tuple(i for form in way for i in form)) for licence, names in _SEQUENCES for way in product(*(FORMS[n] for n in names)))
_BREAK = r"([^vV][.!?;]|[vV][!?;]|[^\x20\x09-\x0D][vV]\.)[\x20\x09-\x0D]+"
_BLANK_LINE = r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"


def normal(sentence: Column) -> Column:
    """Lower-cased letters, digits and inner dots, single blanks between."""
    s = F.regexp_replace(ascii_lower(sentence), r"[^a-z0-9.]+", " ")
    return F.regexp_replace(s, r"^[ .]+|[ .]+$", "")


def identifiers(text: Column) -> Column:
    """Known-sentence identifiers in order, by one segmentation: sentences of each line of ``text``."""
    sentences = F.split(F.regexp_replace(text, _BREAK, "$1\n"), "\n")
    keys, ids = F.array(*[F.lit(k) for k in KNOWN]), F.array(*[F.lit(v) for v in KNOWN.values()])
    at = F.transform(F.filter(F.transform(sentences, normal), lambda s: F.length(s) > 2), lambda s: F.array_position(keys, s).cast("int"))
    return F.transform(F.filter(at, lambda i: i > 0), lambda i: F.element_at(ids, i))


def match(ids: Column, rules: tuple = RULES) -> Column:
    """Sequence of identifiers -> text in which the ordered rules have replaced what they match by ``=licence``."""
    # every identifier stands between its own commas, so that neighbours do not share one
    joined = F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), i, F.lit(","))), "")
    for licence, sequence in rules:
        joined = F.replace(joined, F.lit("".join(f",{i}," for i in sequence)), F.lit(f",={licence},"))
    return F.filter(F.split(joined, ","), lambda x: x != "")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, licenses, n_unmatched) of every row; licences joined by commas."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = text.rlike("(?i)" + "|".join(ANCHORS))
    paragraphs = F.regexp_replace(F.regexp_replace(F.regexp_replace("__t", _BLANK_LINE, "\u0001"), "\n", " "), "\u0001", "\n")
    df = docs.select("doc_id", F.when(held, text).otherwise(F.lit("")).alias("__t"))
    none = F.array().cast("array<string>")
    df = df.select("doc_id", *[F.when(F.col("__t") == "", none).otherwise(identifiers(t)).alias(n)
                               for n, t in (("__lines", F.col("__t")), ("__whole", paragraphs))])
    # the segmentation that knows more sentences; on a tie the lines
    ids = F.when(F.size("__whole") > F.size("__lines"), F.col("__whole")).otherwise(F.col("__lines"))
    df = df.select("doc_id", F.size(ids).cast("long").alias("n_known"), match(F.col("__lines")).alias("__a"), match(F.col("__whole")).alias("__b"),
                   match(ids).alias("__c"))
    found = F.filter(F.array_union(F.col("__a"), F.col("__b")), lambda x: x.startswith("="))
    return df.select("doc_id", "n_known", F.replace(F.array_join(F.array_sort(found), ","), F.lit("="), F.lit("")).alias("licenses"),
                     F.size(F.filter("__c", lambda x: ~x.startswith("="))).cast("long").alias("n_unmatched"))


def normal_text(sentence: str) -> str:
    """The same normal form for one string (used by the tests)."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)
    return re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.]+", " ", low))
