"""Licence scan by canonical digests.

A text is brought to one canonical form (A-Z in lower case, equivalent spellings unified, copyright lines dropped,
punctuation and white space reduced to single spaces), and its SHA-256 is joined with the digests of known licence
texts. Two kinds of entire text are looked up: the whole document, and each line by itself, so a notice such as
"Released under the MIT License." is found wherever it stands alone on a line. All of it runs as built-in functions;
the only join is with the catalogue, a fixed small table.

Known texts are those of TEXTS, those of the folder license_texts (one file a licence, named by its identifier), each
also without what stands behind the end of its terms, and the notices of NOTICES.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.shared import lower_ascii, table

# Spellings that count as equal, applied in this order after lower-casing.
EQUIVALENT = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("www.", ""),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("organisation", "organization"),
    ("per cent", "percent"),
)
# What starts a copyright line, in the canonical alphabet.
COPYRIGHT = r"^[^a-z0-9]*(copyright( \(c\)|\(c\)| ©)? ?[0-9©]|copyright \(c\)|\(c\) ?[0-9]|©|all rights reserved)"
BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F ©«»‐-―‘-‟…]+"

# Notices that stand for a licence, by its SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
)
_FOLDER = Path(__file__).parent / "license_texts"
#: What ends the terms of a licence; instructions on how to apply it may be left out behind it.
_END = "END OF TERMS AND CONDITIONS"
# The terms of the BSD licences.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
"""
_BSD_TERMS = (
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.""",
)
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd(terms: int, number: bool, title: str = "") -> str:
    points = [f"{i}. {t}" if number else f"* {t}" for i, t in enumerate(_BSD_TERMS[:terms], 1)]
    return "\n\n".join([title, _BSD_HEAD, *points, _BSD_TAIL])


# Entire licence texts.
TEXTS = (
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
)


def texts(folder: Path | str = _FOLDER) -> list[tuple[str, str]]:
    """(licence, text) of all known entire texts in their variants."""
    out = list(TEXTS)
    for terms, name, title in ((2, "BSD-2-Clause", "BSD 2-Clause License"), (3, "BSD-3-Clause", "BSD 3-Clause License")):
        out += [(name, _bsd(terms, number, t)) for number in (True, False) for t in ("", title)]
    out += [(name, text.split("\n", 1)[1]) for name, text in TEXTS if text.startswith(name)]  # without the title
    for file in sorted(Path(folder).glob("*.txt")):
        text = file.read_text("utf-8")
        out.append((file.stem, text))
        if _END in text:
            out.append((file.stem, text[: text.index(_END) + len(_END)]))
            out.append((file.stem, text[: text.index(_END)]))
    return out


def canonical_lines(text: Column) -> Column:
    """Array of the canonical form of each line; a copyright line is empty. A null text is one empty line."""
    low = lower_ascii(F.coalesce(text, F.lit("")))
    for a, b in EQUIVALENT:
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.transform(F.split(low, "\n"), lambda x: F.when(x.rlike(COPYRIGHT), "").otherwise(F.trim(F.regexp_replace(x, BREAKS, " "))))


def whole(lines: Column) -> Column:
    """Canonical form of the entire text from those of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def catalogue(spark: SparkSession, notices=NOTICES, known_texts=None) -> DataFrame:
    """(digest, license) of the known texts, by the same canonical form."""
    known = spark.createDataFrame(sorted({*notices, *(texts() if known_texts is None else known_texts)}), "license string, text string")
    return known.select(F.sha2(whole(canonical_lines(F.col("text"))), 256).alias("digest"), "license").distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, scope, n_lines): licences found; scope is ``document`` or ``line``, n_lines the lines that match.

    known must be small enough to broadcast (the built-in catalogue is fixed). A text that is canonically empty
    (null, empty, only punctuation or copyright lines) matches nothing; a very long one is canonised whole. Rows that share an id are one document, with
    n_lines over all of them; a null id is reported as null. An empty table gives no rows. Other columns are left out,
    whatever their names.
    """
    lines = docs.select(F.col(id_col).cast("long").alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    units = lines.select("id", F.explode(F.concat(F.array(F.struct(F.lit("document").alias("scope"), whole(F.col("lines")).alias("text"))), F.transform("lines", lambda x: F.struct(F.lit("line").alias("scope"), x.alias("text"))))).alias("u"))
    hashed = units.where("u.text <> ''").select("id", "u.scope", F.sha2("u.text", 256).alias("digest"))
    return hashed.join(F.broadcast(known), "digest").groupBy("id", "license", "scope").agg(F.count("*").alias("n_lines"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), catalogue(spark)).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    def canonical(text: str) -> str:
        low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for a, b in EQUIVALENT:
            low = f"replace({low}, '{a}', '{b}')"
        return f"[CASE WHEN regexp_matches(x, '{COPYRIGHT}') THEN '' ELSE trim(regexp_replace(x, '{BREAKS}', ' ', 'g')) END FOR x IN string_split({low}, chr(10))]"

    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted({*NOTICES, *texts()}))
    return f"""
    WITH known AS (
      SELECT DISTINCT license, array_to_string([y FOR y IN lines IF y <> ''], ' ') AS form
      FROM (SELECT license, {canonical("text")} AS lines FROM (VALUES {rows}) AS v(license, text))),
    lines AS (SELECT doc_id, {canonical("text")} AS lines FROM documents),
    units AS (
      SELECT doc_id, 'document' AS scope, array_to_string([y FOR y IN lines IF y <> ''], ' ') AS form FROM lines
      UNION ALL SELECT doc_id, 'line', unnest(lines) FROM lines)
    SELECT u.doc_id, k.license, u.scope, count(*) AS n_lines
    FROM units u JOIN known k ON u.form = k.form WHERE u.form <> '' GROUP BY ALL"""


QUERIES = {"op5_licenses": op5_licenses}
ORACLE = {"op5_licenses": _sql()}
