"""Whole licence texts, notices behind a statement of ownership, and lists of one's own."""

from __future__ import annotations

import json
import textwrap

from strandcheck.llm import licences


def test_whole_texts_and_notices_after_ownership(spark):
    texts = {}
    for line in licences.TEXTS.read_text(encoding="utf-8").splitlines():
        row = json.loads(line)
        texts.setdefault(row["license"], row["text"])
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(texts)
    names = sorted(texts)
    wrapped = lambda t, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n, break_long_words=False, break_on_hyphens=False) for p in t.split("\n\n"))
    given = [(k, texts[k]) for k in names]
    given += [("Apache-2.0", wrapped(texts["Apache-2.0"], n)) for n in range(45, 90, 3)]
    given += [("BSD-2-Clause", "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + wrapped(texts["BSD-2-Clause"].split("\n", 1)[1], n)) for n in range(45, 90, 3)]
    mit = next(t for k, t in licences.KNOWN if k == "MIT" and len(t) > 500).split("\n", 1)[1]
    given += [("MIT", mit), ("MIT", "Copyright 2020 A. Person. " + mit), (None, "Copyright 2020 A. Person. " + mit + " more")]
    notices = [
        ("Copyright 2020 A. Person. Released under the MIT License.", ("MIT", 1, "MIT")),
        ("(c) A. Person, this project is licensed under the MIT License. All rights reserved.\nmore", (None, 1, "MIT")),
        ("text\n\u00a9 2020 me - Licensed under CC BY 4.0.\nReleased under the MIT License.", (None, 2, "CC-BY-4.0,MIT")),
        ("Copyright 2020 The MIT License Club", (None, 0, "")),
    ]
    frame = spark.createDataFrame(list(enumerate([t for _, t in given] + [t for t, _ in notices])), "doc_id bigint, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in licences.scanned(frame).collect()}
    assert [rows[k][0] for k in range(len(given))] == [k for k, _ in given]
    assert [rows[len(given) + k] for k in range(len(notices))] == [want for _, want in notices]


def test_known_texts_are_an_argument(spark):
    frame = spark.createDataFrame([(1, "Copyright 2020 me.\nDo as you like!"), (2, "Released under the MIT License."), (None, "x\ndo as you like")], "doc_id bigint, text string")
    known = spark.createDataFrame([("Own-1.0", "Do as you like."), (None, "x"), ("Empty", "")], "license string, text string")
    rows = sorted(map(tuple, licences.scanned(frame, known).collect()), key=str)
    assert rows == [(1, "Own-1.0", 1, "Own-1.0"), (2, None, 0, ""), (None, None, 1, "Own-1.0")]
    assert {tuple(r)[1:] for r in licences.scanned(frame, known.limit(0)).collect()} == {(None, 0, "")}
