"""Licence scans by canonical digests.

A text is normalised the way licence texts may differ without a difference in
meaning: case, punctuation and white space, copyright lines, equivalent
spellings. The digest of the whole result is looked up among the digests of
known licences by a hash join. Every line of a text is looked up in the same
way, so a notice that stands as a line of its own is found in any document.

Where a long text breaks its lines must not matter, yet a line that begins with
"copyright" may be a notice or the middle of a sentence. Whole texts therefore
have a second digest, for which only lines that cannot be the middle of a
sentence are left out; a text is a licence if either digest is known.

Known texts come as a table of (license_id, text), normalised alike. The ones
registered here are whole licences with their usual titles and wordings
(``license_texts``), notices built from licence names and common sentences, and
SPDX identifier lines.

Rules for odd input: a null or empty text has the digest of nothing and
matches nothing; known texts that normalise to nothing are left out; several
licences with one text are all reported; repeated rows are documents of their
own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.llm.ordering import quoted
from spantab.staging import stage

# Public licence identifiers and the names that notices give them.
LICENSE_NAMES = {
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL 3.0", "AGPLv3"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
    "EPL-2.0": ("the Eclipse Public License 2.0",),
    "GPL-2.0": ("the GNU General Public License, version 2", "GPL 2.0", "GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "GPL 3.0", "GPLv3"),
    "ISC": ("the ISC License",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL 3.0", "LGPLv3"),
    "MIT": ("the MIT License", "MIT"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"),
    "Unlicense": ("the Unlicense",),
}
NOTICES = (
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.",
    "This work is licensed under {}.", "This work is released under {}.", "This software is licensed under {}.",
    "This project is licensed under {}.", "This document is licensed under {}.", "This text is licensed under {}.",
)
#: Whole texts in ``license_texts``, and the titles that copies of the short ones go by; long ones hold theirs.
TEXT_TITLES = {
    "Apache-2.0": (), "Artistic-1.0-Perl": (), "CC0-1.0": (), "GFDL-1.2": (), "GFDL-1.3": (), "GPL-1.0": (), "GPL-2.0": (),
    "GPL-3.0": (), "LGPL-2.0": (), "LGPL-2.1": (), "LGPL-3.0": (), "MPL-1.1": (), "MPL-2.0": (),
    "BSD-2-Clause": (
        "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License",
        "BSD 2-Clause Simplified License", "BSD License", "The BSD License", "FreeBSD License",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License",
        "BSD 3-Clause New or Revised License", "Modified BSD License", "BSD License", "The BSD License",
    ),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "License MIT"),
    "Unlicense": ("The Unlicense", "Unlicense", "UNLICENSE", "The Unlicense (Unlicense)"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"),
}
_OLD_ADDRESSES = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
_ADDRESSES = tuple(
    [(f"51 Franklin {street}, Fifth Floor, Boston{comma} MA 02110-1301 USA", old)]
    for old in _OLD_ADDRESSES for street in ("Street", "St") for comma in (",", "")
)
_BSD = (
    [("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR AND CONTRIBUTORS"),
     ("COPYRIGHT HOLDER OR CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS")],
    [("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS"),
     ("COPYRIGHT HOLDER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")],
    [("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS")],
    [("1. Redistributions", "* Redistributions"), ("2. Redistributions", "* Redistributions"), ("3. Neither", "* Neither")],
)
#: Other wordings of the same licence: what is replaced, all of a list together; the lists combine.
WORDINGS = {
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": (
        *_BSD,
        [("the copyright holder nor", "the copyright holders nor")], [("the copyright holder nor", "the author nor")],
        [("the copyright holder nor", "the University nor")],
    ),
    "GPL-1.0": _ADDRESSES, "GPL-2.0": _ADDRESSES, "LGPL-2.0": _ADDRESSES, "LGPL-2.1": _ADDRESSES, "GFDL-1.2": _ADDRESSES,
    "ISC": ([("and/or distribute", "and distribute")],),
}
#: What follows in some of the long texts is an appendix that copies leave out.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
SPDX_FORMS = ("{}", "{}-only", "{}-or-later")
#: Spellings that mean the same, after lower-casing: what is replaced, and by what.
EQUIVALENT = (
    ("licenc", "licens"), ("organis", "organiz"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("judgement", "judgment"), ("labour", "labor"),
    ("non-commercial", "noncommercial"), ("per cent", "percent"), ("sub-license", "sublicense"),
    ("whilst", "while"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"),
)
COPYRIGHT_LINE = r"(?m)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*$"
#: The same without lines that may begin so because a sentence was wrapped there, and with marks of comments before.
SURE_COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n©(]*+(?:©|\(c\)(?=\s*(?:copyright\b|[0-9<\[{]))|copyright\b(?!\W*(?:also|and|are|disclaimer"
    r"|doctrines|holders?|if|interest|laws?|licen[cs]e|like|line|notices?|of|on|or|owner(?:s|ship)?|patent|permission"
    r"|statement|those|treaty|the\s+(?:library|program|software))\b)|all\s+rights\s+reserved\W*$)[^\n]*$"
)


def _marked(plain: Column) -> Column:
    return F.contains(plain, F.lit("copyright")) | F.contains(plain, F.lit("(c)")) | F.contains(plain, F.lit("©"))


def canonical(text: Column, notice_line: str = COPYRIGHT_LINE) -> Column:
    """A text without what may differ between copies of one licence."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    plain = F.when(_marked(plain), F.regexp_replace(plain, notice_line, " ")).otherwise(plain)
    for old, new in EQUIVALENT:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def unwrapped_digest(text: Column) -> Column:
    """The digest that does not depend on where lines break; null where no line could be taken for a notice."""
    marked = _marked(F.lower(F.coalesce(text, F.lit(""))))
    return F.when(marked, F.sha2(canonical(text, SURE_COPYRIGHT_LINE), 256))


def license_texts() -> list[tuple[str, str]]:
    """(license_id, text) of every whole licence under every title, in every wording."""
    rows = []
    for name, titles in TEXT_TITLES.items():
        forms = {pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()}
        for changes in WORDINGS.get(name, ()):
            forms |= {_reworded(f, changes) for f in forms}
        for old, new in (("https://", "http://"), ("http://", "https://")):
            forms |= {f.replace(old, new) for f in forms}
        ended = [f for f in forms if END_OF_TERMS in f]
        forms |= {f[: f.index(END_OF_TERMS)] for f in ended} | {f[: f.index(END_OF_TERMS) + len(END_OF_TERMS)] for f in ended}
        rows += [(name, f"{title}\n\n{form}") for title in ("", *titles) for form in sorted(forms)]
    return rows


def _reworded(text: str, changes: list[tuple[str, str]]) -> str:
    for old, new in changes:
        text = re.sub(r"\s+".join(map(re.escape, old.split())), new, text)
    return text


def known_texts(spark: SparkSession) -> DataFrame:
    """(license_id, text) of whole licences, of all notices and of SPDX lines."""
    names = sorted({*TEXT_TITLES, *LICENSE_NAMES})
    spdx = [(n, "SPDX-License-Identifier: " + form.format(n)) for n in names for form in SPDX_FORMS]
    whole = spark.createDataFrame(license_texts() + spdx, "license_id string, text string")
    return known_notices(spark).unionByName(whole)


def known_notices(spark: SparkSession) -> DataFrame:
    """(license_id, text) of every notice sentence for every name; a few hundred rows."""
    rows = [(i, n.format(name)) for i, names in LICENSE_NAMES.items() for name in names for n in NOTICES]
    return spark.createDataFrame(rows, "license_id string, text string")


def known_digests(licenses: DataFrame) -> DataFrame:
    kept = licenses.filter(canonical(F.col("text")) != "")
    digests = F.array_compact(F.array(digest(F.col("text")), unwrapped_digest(F.col("text"))))
    return kept.select("license_id", F.explode(F.transform(digests, F.unhex)).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``id, text_digest, whole, notices``: licences that its whole text, and that its lines, are."""
    text = quoted(text_col)
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.unhex(digest(line)))
    digests = docs.select(
        F.monotonically_increasing_id().alias("row_id"), quoted(id_col).alias("id"),
        F.unhex(digest(text)).alias("text_digest"), F.unhex(unwrapped_digest(text)).alias("unwrapped"),
        F.array_distinct(lines).alias("lines"),
    )
    digests = stage(digests, "license-digests")
    known = known_digests(licenses)
    entire = F.array_distinct(F.array_compact(F.array("text_digest", "unwrapped")))
    units = digests.select("row_id", F.lit(True).alias("is_whole"), F.explode(entire).alias("digest")).unionByName(
        digests.select("row_id", F.lit(False).alias("is_whole"), F.explode("lines").alias("digest"))
    )
    # at most the number of known licences per document
    found = units.join(known, "digest").groupBy("row_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_whole"), F.col("license_id")))).alias("whole"),
        F.array_sort(F.collect_set(F.when(~F.col("is_whole"), F.col("license_id")))).alias("notices"),
    )
    none = F.array().cast("array<string>")
    return digests.join(found, "row_id", "left").select(
        "id", F.lower(F.hex("text_digest")).alias("text_digest"), F.coalesce("whole", none).alias("whole"),
        F.coalesce("notices", none).alias("notices"),
    )
