from veilframe.llm import license_scan
from veilframe.llm.license_rules import RULES

TEXTS = [
    None, "", " \n", "Mit der Zeit", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "x CC BY-NC 4.0 and CC-BY-NC-SA 4.0; cc by nc\ncc by nc", "This work is licensed under the GNU General Public License, version 3.",
    "under the mit license under the mit license under the MIT license", "SPDX-License-Identifier: GPL-3.0-or-later",
    "éunder the mit license", "under the mit licenseé ünder", "released into the public domain " * 50, "All rights reserved. (c) 2020",
    "Dual licensed under the BSD 3-Clause License and the GNU Lesser General Public License v2.1",
]


def test_rules():
    assert len(RULES) > 200
    assert {r.priority for r in RULES} <= {0, 1, 2, 3}


def test_against_brute_force(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "CC BY-NC"), (1, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in license_scan.query(spark, str(tmp_path)).collect():
        want = license_scan.brute_force("CC BY-NC" if r.doc_id is None else TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id


def test_base_and_suppression(spark):
    got = license_scan.brute_force("This is licensed under the Apache License, Version 2.0 today")
    assert got["base_labels"] == "apache-2" and got["labels"] == "apache-2" and got["first_word"] == 5
    assert license_scan.brute_force("under the GNU General Public License, version 3.")["labels"] == "gpl-3"


def texts_of(pattern):
    """A text for each choice that a rule's pattern offers, one choice at a time."""
    try:
        from re import _parser as parser
    except ImportError:
        import sre_parse as parser

    def some(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                found = [chr(arg)]
            elif name == "SUBPATTERN":
                found = some(arg[3])
            elif name == "BRANCH":
                found = [x for part in arg[1] for x in some(part)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                found = [x * k for k in sorted({max(arg[0], 0), max(arg[0], 1)}) for x in some(arg[2])[: 1 if arg[0] > 1 else None]]
            elif name == "IN":
                found = [chr(x) if str(kind) == "LITERAL" else chr(x[0]) if str(kind) == "RANGE" else "7" for kind, x in arg]
            else:
                raise AssertionError(name)
            first = out[0]
            out = [x + found[0] for x in out] + [first + y for y in found[1:]]
        return list(dict.fromkeys(out))

    return some(parser.parse(pattern))


def test_gates_lose_nothing():
    import re

    stem = re.compile(license_scan.stem_pattern())
    for r in RULES:
        for text in texts_of(r.pattern):
            assert re.fullmatch(r.pattern, text), (r.pattern, text)
            assert r.keyword in text, (r, text)
            assert stem.search(" " + text + " "), (r, text)
    assert not stem.search(" der mit ")
    assert license_scan.brute_force("GNU Library General Public License v2.1")["labels"] == "lgpl-2.1"


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "CC BY-NC", 77, "x", "y")], "doc_id long, text string, n_words int, spans string, _row string")
    got = license_scan.scan(df).first()
    assert (got.n_words, got.spans, got._row, got["_n_words"], len(got["_spans"])) == (77, "x", "y", 3, 1)
    assert license_scan.scan(df.limit(0)).count() == 0
