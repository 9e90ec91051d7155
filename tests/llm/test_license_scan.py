"""The licence scan: brute-force lines and probabilities, held-out accuracy, confirmation by templates."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import license_scan as L
from tessera.llm import text as X

SCHEMA = "doc_id long, text string, line int, family string"


@pytest.fixture(scope="module")
def scanner():
    return L.fit(pa.array(["Once there was a king in the land\nwho had a house by the sea and all the rights of it", "The software of the day is of no use"] * 5))


def test_lines_are_numbered_within_their_text():
    texts = ["one two\n\nthree", "\nfour", None, "", "five\n...\nsix"]
    h, off, row, number = L.lines(pa.array(texts))
    got = [(int(r), int(n), off[k + 1] - off[k]) for k, (r, n) in enumerate(zip(row, number))]
    assert got == [(0, 0, 2), (0, 2, 1), (1, 1, 1), (4, 0, 1), (4, 2, 1)]
    assert h[0] == X.hash_words("one")[0]


def test_probabilities_are_those_of_brute_force(scanner):
    text = "released under the MIT License License"
    h, off, _, _ = L.lines(pa.array([text]))
    got = L.probabilities(h, off, scanner)[0]
    grams = set()
    for n in (1, 2, 3):
        for i in range(len(h) - n + 1):
            x = np.zeros(1, np.uint64)
            for k in range(n):
                x = X.mix(x * np.uint64(0xD1342543DE82EF95) + h[i + k : i + k + 1] + np.uint64(k + 1))
            grams.add(int(x[0]))
    z = sum(scanner.weights[k] for k, g in enumerate(scanner.grams.tolist()) if g in grams)
    z = (z / np.sqrt(len(h)) + scanner.bias) / scanner.temperature
    assert np.allclose(got, np.exp(z - z.max()) / np.exp(z - z.max()).sum())


def test_held_out_variants(scanner):
    texts, y = L.variants(np.random.default_rng(77), 40)
    h, off, _, _ = L.lines(pa.array(texts))
    p = L.probabilities(h, off, scanner)
    y = np.array(y)
    assert (p.argmax(1) == y).mean() > 0.9
    sure = p.max(1)
    assert abs(sure.mean() - (p.argmax(1) == y).mean()) < 0.1  # calibrated


def test_families_unknown_and_prose(spark, scanner):
    lines = {
        "Released under the MIT License.": "MIT",
        "RELEASED UNDER THE MIT LICENSE": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Licensed under CC BY 4.0.": "CC-BY",
        "All rights reserved.": "proprietary",
        "This program is licensed under the GNU General Public License, version 2.": "GPL",
        "The king had a house in the land of the sea": None,
        "the the the of of of the the": None,
        "License License License License": None,
    }
    got = {row: family for row, _, _, family, _, _ in L.found(pa.array(list(lines)), scanner)}
    for k, (text, family) in enumerate(lines.items()):
        if family:
            assert got.get(k) == family, text
        else:
            assert got.get(k, "unknown") == "unknown", text
    other = L.found(pa.array(["Licensed under the Quux License, Version 9.0"]), scanner)
    assert {f for _, _, _, f, _, _ in other} <= {"unknown"}


def test_whole_table_nulls_long_and_repeated_rows(spark):
    mit = "Released under the MIT License."
    long = "word " * 40_000 + "\n" + mit
    rows = [(1, "some text\n" + mit), (1, "some text\n" + mit), (None, mit), (2, None), (3, ""), (4, "\n\n"), (5, long), (6, "nothing here")]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.first_line, r.family) for r in L.scanned(docs).collect())
    assert got == [(False, 1, 1, "MIT"), (False, 1, 1, "MIT"), (False, 5, 1, "MIT"), (True, 0, 0, "MIT")]


def test_empty_table(spark):
    assert L.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slices_do_not_matter(scanner, monkeypatch):
    texts = pa.array([f"line {k}\nReleased under the MIT License." if k % 3 else "" for k in range(60)])
    whole = L.found(texts, scanner)
    monkeypatch.setattr(X.slices, "__defaults__", (100,))
    assert L.found(texts, scanner) == whole
    assert [(r, n) for r, n, *_ in whole] == [(k, 1) for k in range(60) if k % 3]


def test_a_notice_within_a_long_line_is_found(scanner):
    prose = "the king had a house by the sea and many people came to see it in the summer of that year ".split()
    notices = {
        "Released under the MIT License.": "MIT",
        "All rights reserved.": "proprietary",
        "Licensed under the Apache License, Version 2.0 (the License)": "Apache-2.0",
        "under the terms of the GNU General Public License as published by": "GPL",
        "under the terms of the GNU Affero General Public License": "AGPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    }
    for many in (5, 20, 100, 2000):
        around = " ".join((prose * 100)[:many])
        for notice, family in notices.items():
            got = L.found(pa.array([f"{around} {notice} {around}"]), scanner)
            assert [(n, f) for _, n, _, f, _, _ in got] == [(0, family)], (many, notice)
        assert {f for _, _, _, f, _, _ in L.found(pa.array([around]), scanner)} <= {"unknown"}


def test_all_families_of_a_long_line_are_found(scanner):
    far = " ".join(["and the sea was calm"] * 40)
    got = L.found(pa.array([f"{far} Released under the MIT License. {far} Licensed under the Apache License, Version 2.0. {far}"]), scanner)
    assert sorted(f for _, _, _, f, _, _ in got) == ["Apache-2.0", "MIT"]


def test_a_notice_that_is_broken_into_lines_is_found(scanner):
    notices = {
        "under the terms of the GNU Lesser\nGeneral Public License": "LGPL",
        "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy": "MIT",
        "Licensed under the Apache\nLicense, Version 2.0.": "Apache-2.0",
    }
    for notice, family in notices.items():
        n = notice.count("\n")
        for before, after, at in (("", "", 0), ("the king had a house by the sea\n", "\nand many people came", 1), ("one day\n\n", "\n\nthe end", 2)):
            got = L.found(pa.array([before + notice + after]), scanner)
            assert [(first, last, f) for _, first, last, f, _, _ in got] == [(at, at + n, family)], (notice, before)
    assert not [f for _, _, _, f, _, _ in L.found(pa.array(["under the terms of the GNU\n\nLesser General Public License"]), scanner) if f == "GPL"]


def test_paragraphs_are_runs_of_lines():
    h, off, row, number = L.lines(pa.array(["a\nb\n\nc\n--\nd", "e\nf"]))
    assert L.paragraphs(off, row, number).tolist() == [0, 2, 3, 4, 6]


def test_places_that_tie_go_to_the_first():
    words = X.hash_words("all rights reserved all rights reserved")
    assert [x for x in L.passages(words, np.array([0, len(words)]))][0][1] == 0
