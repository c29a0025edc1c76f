"""License scans by canonical digests.

A text is brought to a canonical form: lower case, copyright notices dropped, equivalent spellings replaced, punctuation
and white space reduced to single spaces. Texts are equal to a known licence if the SHA-256 digests of their forms are;
a hash join against the digests of known texts finds them. Whole documents are looked up, and each of their lines by
itself, since short notices stand on lines of their own.
"""
from __future__ import annotations

import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same.
SPELLINGS = {
    "https": "http", "licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "organisation": "organization",
    "organisations": "organizations", "acknowledgement": "acknowledgment", "analogue": "analog", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "behaviour": "behavior", "favour": "favor", "fulfil": "fulfill", "merchantibility": "merchantability",
    "noninfringement": "non infringement", "recognised": "recognized", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: A copyright notice by itself, after lower case: mark, then a holder up to the end of the line or the
#: sentence, or to the words that licences and notices open with. It stands at the start of a line or behind a title.
#: "copyright" that goes on as licence wording is no notice.
_WORDING = (
    r"(?:holders?|owners?)\b(?!\s*:)|(?:notices?|laws?|licen[sc]es?|licensed|licensing|interests?|statements?|protection|rights?|infringements?|disclaimers?|lines?|"
    r"treat(?:y|ies)|status|act|acts|and|or|on|in|of|is|are|was|to|for|that|which|may|shall|can|will|as|with|under|permission|claims?|ownership|terms?|information|material)\b"
)
_MARK = rf"(?:(?:copyright|copr\.)(?=[\s:(©<\[{{])(?!\s+(?:{_WORDING}))|\(c\)(?=\s*[\d<\[{{])|©)"
_OPENING = (
    r"(?:permission (?:is hereby granted|to use)|redistribution and use|everyone is permitted|(?:licensed|released|distributed|available) under|"
    r"this (?:work|project|software|program|library|file|code) is|licen[sc]e:|spdx-license-identifier)"
)
_STOP = rf"\b{_OPENING}|(?<=\.)(?<!(?:[\s.]\p{{L}}|\b(?:inc|ltd|corp|co|jr|sr|dr|st|llc|gmbh))\.)[ \t]+(?!all rights reserved|<|http)(?=[\p{{L}}\"“(])"
#: a holder goes on over the next line where one line ends or the other begins with "and", "&" or, at the end, a comma
_ON = r"(?:[^\n]*(?:(?:,|&|\band)[ \t\r]*\n|\n(?=[^\p{L}\p{N}\n]*(?:and|&)[ \t])))?"
NOTICE = (
    rf"(?m)(?:^[^\p{{L}}\p{{N}}©(\n]*|(?<=\blicen[sc]e)[ \t:.-]+|(?<=\((?:mit|isc)\))[ \t:.-]+){_MARK}{_ON}[^\n]*?(?=$|{_STOP})"
    r"|^[^\p{L}\p{N}\n]*all rights reserved\b[.!]?"
)
MAY_HOLD_NOTICE = r"copyright|copr\.|\(c\)|©|all rights reserved"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Fixed values: (SPDX identifier, text), whole licences and the notices that stand for them.
_FIRST = (
    (
        "MIT",
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "ISC License\n\nCopyright <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    ),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Holders that BSD texts name in their clauses stand for any: in the form of words, (pattern, what it counts as).
HOLDERS = (
    (r" neither the names? of .{1,200}? nor the names of (?:its|their|any) contributors may be used ", " neither the name of the copyright holder nor the names of its contributors may be used "),
    (r" this software is provided by .{1,200}? as is and any express ", " this software is provided by the copyright holders and contributors as is and any express "),
    (r" in no event shall .{1,200}? be liable for any direct indirect ", " in no event shall the copyright holder or contributors be liable for any direct indirect "),
)
NAMES_HOLDER = " be liable for any direct indirect "  # every text with such a clause has these words

#: SPDX identifiers, files of whole texts, and names that notices use.
_FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2-only": "GFDL-1.2", "GFDL-1.3-only": "GFDL-1.3",
    "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-2.1-only": "LGPL-2.1",
    "LGPL-3.0-only": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0",
}
_END = "END OF TERMS AND CONDITIONS"  # behind it texts say how to apply them, which many copies leave out
_NAMES = {
    "MIT": ("the MIT License", "the MIT license (MIT)", "MIT"),
    "ISC": ("the ISC License", "ISC"),
    "0BSD": ("the Zero-Clause BSD License", "0BSD"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License", "BSD-3-Clause"),
    "Apache-2.0": ("the Apache License, Version 2.0", 'the Apache License, Version 2.0 (the "License")', "the Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "GPL-2.0-only"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPL-3.0-only"),
    "GPL-2.0-or-later": ("the GNU General Public License, version 2 or later", "GPL-2.0-or-later"),
    "GPL-3.0-or-later": ("the GNU General Public License, version 3 or later", "GPL-3.0-or-later"),
    "LGPL-2.1-only": ("the GNU Lesser General Public License, version 2.1", "LGPL-2.1-only"),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3", "LGPL-3.0-only"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    **{
        f"CC-{k.replace(' ', '-')}-4.0": (f"CC {k} 4.0", f"a Creative Commons {name} 4.0 International License", f"the Creative Commons {name} 4.0 International License")
        for k, name in {
            "BY": "Attribution", "BY SA": "Attribution-ShareAlike", "BY ND": "Attribution-NoDerivatives", "BY NC": "Attribution-NonCommercial",
            "BY NC SA": "Attribution-NonCommercial-ShareAlike", "BY NC ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
}
_LEADS = ("", "Released", "Distributed", *(f"This {x} is {y}" for x in ("work", "project", "software", "program", "library", "file", "code") for y in ("licensed", "released", "distributed")))


def _read(name: str) -> str:
    return resources.files(__package__).joinpath("licence_texts", name).read_text(encoding="utf-8")


def _forms(text: str) -> list[str]:
    """A text, and what is left of it without instructions at its end, with and without the line that ends the terms."""
    at = text.find(_END)
    return [text] if at < 0 else [text, text[: at + len(_END)], text[:at]]


def _bsd() -> list[tuple[str, str]]:
    """The two BSD licences with numbers, bullets and titles; whichever holder their clauses name, forms are the same."""
    own = _read("BSD")
    three = own.replace("the University", "the copyright holder").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    two = re.sub(r"3\. Neither.*?permission\.\n", "", three, flags=re.S)
    out = []
    for name, text, titles in (("BSD-2-Clause", two, ("BSD 2-Clause License",)), ("BSD-3-Clause", three, ("BSD 3-Clause License",))):
        for form in (text, re.sub(r"(?m)^\d\. ", "* ", text)):
            out += [(name, form), *((name, f"{t}\n\n{form}") for t in titles)]
    return out


def _known() -> tuple:
    """All known texts, each canonical form once."""
    rows = list(_FIRST)
    mit, isc, zero = (t for _, t in _FIRST[:3])
    rows += [("MIT", mit.split("\n\n", 1)[1]), ("MIT", mit.replace("MIT License", "The MIT License (MIT)", 1)), ("MIT", mit.replace("MIT License", "The MIT License", 1))]
    rows += [("ISC", isc.split("\n\n", 1)[1]), ("ISC", isc.replace("and/or", "and")), ("ISC", isc.split("\n\n", 1)[1].replace("and/or", "and"))]
    rows += [("0BSD", zero.split("\n\n", 1)[1]), ("0BSD", zero.replace("Zero-Clause BSD", "BSD Zero Clause License"))]
    rows += [(i, t) for i, f in _FILES.items() for t in _forms(_read(f))] + _bsd()
    rows += [("Unlicense", re.sub(r"\n\nFor more information.*", "", _read("Unlicense"), flags=re.S)), ("Zlib", "zlib License\n\n" + _read("Zlib"))]
    for i, names in _NAMES.items():
        rows.append((i, f"SPDX-License-Identifier: {i}"))
        for name in names:
            rows += [(i, (f"{lead} under {name}." if lead else f"Licensed under {name}.")) for lead in _LEADS]
            rows += [(i, f"License: {name.removeprefix('the ')}")]
    once = {}
    for i, t in rows:
        words = f' {" ".join(re.findall(r"[^\W_]+", t.lower()))} '
        for pattern, new in HOLDERS:
            words = re.sub(pattern, new, words)
        once.setdefault(words, (i, t))
    return tuple(once.values())


KNOWN = _known()


def canonical(text: Column) -> Column:
    """The canonical form of a text, whole; a null text has that of an empty one."""
    return _words(F.lower(F.coalesce(text, F.lit(""))))


def without_notices(text: Column) -> Column:
    """The form by which licences are looked up: as canonical(), but copyright notices go, not what else is on their lines,
    and holders that BSD clauses name count as any."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    words = F.concat(F.lit(" "), _words(F.when(lower.rlike(MAY_HOLD_NOTICE), F.regexp_replace(lower, NOTICE, " ")).otherwise(lower)), F.lit(" "))
    named = words
    for pattern, new in HOLDERS:
        named = F.regexp_replace(named, pattern, new)
    return F.trim(F.when(F.contains(words, F.lit(NAMES_HOLDER)), named).otherwise(words))


def _words(lower: Column) -> Column:
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def lookup_digest(text: Column) -> Column:
    return F.sha2(without_notices(text), 256)


def known_digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """(digest, licence), as many rows as `known` at most."""
    rows = spark.createDataFrame([(t, i) for i, t in known], "text string, licence string")
    return rows.groupBy(lookup_digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def marks(known: tuple) -> str:
    """A pattern that every text with the form of a known one matches in lower case: few words, one of which each has.

    Words are taken from lines that no notice can be on. Where a text has none, the pattern matches all.
    """
    left = []
    for _, t in known:
        words = {w for x in t.lower().split("\n") if not re.search(MAY_HOLD_NOTICE, x) for w in re.findall("[a-z]{3,}", x)}
        words = {new for w in words for new in re.findall("[a-z]{3,}", SPELLINGS.get(w, w))}
        left.append({w for w in words if len(w) > 5} or words)  # long words are in fewer other texts
    chosen: list[str] = []
    while left:
        if not all(left):
            return ""
        often = Counter(w for words in left for w in words)
        chosen.append(min(often, key=lambda w: (-often[w], w)))
        left = [words for words in left if not any(chosen[-1] in w for w in words)]
    return "|".join(chosen + [old for old, new in SPELLINGS.items() if any(w in new for w in chosen)])


def scan(docs: DataFrame, known: tuple = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, text_digest, licence, notices, n_notices.

    licence is that of the whole text, null if it is not a known one. notices are the licences that single lines name,
    sorted, each once; n_notices counts the lines. text_digest is of the whole text's canonical form; look-ups leave out
    copyright notices, but nothing else that stands on their lines, so line breaks make no difference. Null texts count as
    empty. Texts whose canonical form is empty are no licence. Columns other than the two named are not read.
    """
    digests = F.broadcast(known_digests(docs.sparkSession, known))  # bounded by `known`
    text, pattern = F.coalesce(F.col(text_col), F.lit("")), marks(known)
    marked = lambda x: F.lower(x).rlike(pattern)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), digest(text).alias("text_digest"),
        # lines without any of the words are no notice, and a text without them has no such line
        F.when(marked(text), F.struct(lookup_digest(text).alias("digest"), F.filter(F.split(text, "\n"), marked).alias("lines"))).alias("looked_up"),
    )
    at = lambda whole, d: F.struct(F.lit(whole).alias("whole"), d.alias("digest"))
    lines = F.transform(F.coalesce("looked_up.lines", F.array().cast("array<string>")), lambda x: at(False, lookup_digest(x)))
    looked = rows.select("row", "doc_id", "text_digest", F.explode(F.concat(F.array(at(True, F.col("looked_up.digest"))), lines)).alias("at"))
    found = looked.select("row", "doc_id", "text_digest", "at.whole", "at.digest").join(digests, "digest", "left")
    notice = F.when(~F.col("whole"), F.col("licence"))
    return (
        found.groupBy("row", "doc_id", "text_digest")
        .agg(
            F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
            F.sort_array(F.collect_set(notice)).alias("notices"),
            F.count(notice).alias("n_notices"),
        )
        .drop("row")
    )
