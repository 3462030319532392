from factgraph.llm import licenses as L

SCHEMA = "doc_id long, text string, license string, digest string"


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(((r["id"], r["license"], r["scope"], r["n_lines"]) for r in L.scan(docs, L.catalogue(spark)).collect()), key=repr)


def test_whole_texts_and_lines(spark):
    mit = dict(L.TEXTS)["MIT"]
    changed = "Copyright (c) 2020 Jane Doe\n" + mit.replace("License", "LICENCE").replace('"', "“").replace("sublicense", "sub-license").replace("\n", "\r\n  ")
    rows = [
        (1, changed, "x", "y"),
        (2, mit + "\nand more", "", ""),
        (3, "Some text.\nreleased   UNDER the MIT Licence\nmore\nReleased under the MIT License.", "", ""),
        (4, "Licensed under CC BY-NC 4.0.", "", ""),
        (5, "He said it was Released under the MIT License. Indeed.", "", ""),
        (6, None, "", ""), (7, "", "", ""), (8, "... \n©2020 X", "", ""), (9, "word " * 200_000, "", ""),
        (4, "Licensed under CC BY-NC 4.0.", "", ""), (None, "SPDX-License-Identifier: MIT", "", ""),
    ]
    assert found(spark, rows) == sorted(
        [(1, "MIT", "document", 1), (3, "MIT", "line", 2), (4, "CC-BY-NC-4.0", "document", 2), (4, "CC-BY-NC-4.0", "line", 2), (None, "MIT", "document", 1), (None, "MIT", "line", 1)],
        key=repr,
    )


def test_empty_table(spark):
    assert found(spark, []) == []


def test_every_known_licence_is_found_whole(spark):
    """Each file and the BSD terms, with other case, wrapping, quotes, spelling and a copyright line."""
    known = {}
    for name, text in L.texts():
        known.setdefault(name, []).append(text)
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-3.0-only", "MIT", "MPL-2.0", "Unlicense"} <= set(known)
    rows, want = [], []
    for i, (name, texts) in enumerate(sorted(known.items())):
        for j, text in enumerate(texts):
            changed = "Copyright (c) 1999 Somebody\r\n" + text.upper().replace("LICENSE", "LICENCE").replace('"', "”").replace("\n", "  \r\n\t")
            rows += [(100 * i + j, changed, "", ""), (10_000 + 100 * i + j, changed + "\nAnd one more term.", "", "")]
            want.append((100 * i + j, name))
    got = [(i, name) for i, name, scope, _ in found(spark, rows) if scope == "document"]
    assert sorted(got) == sorted(want)
