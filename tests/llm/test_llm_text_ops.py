"""Decontamination, quality, licences, line dedup and personal data."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from strandline.llm import decontam, licenses, linededup, pii, quality
from strandline.llm import words as wd
from strandline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    out = []
    while len(out) < n:
        s = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 12))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


# ---- words ------------------------------------------------------------------------------------------

def test_words_do_not_depend_on_the_slab(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "One", prose(rng, 300), "Été à la Mer. Ça 42 km", "x" * 500, prose(rng, 50) + "\n" + prose(rng, 50), " . "]
    whole = wd.scan(texts)
    spelt = [whole.data[s:e].decode() for s, e in zip(whole.start, whole.end)]
    assert spelt == [w for t in texts if t for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)]
    by_word = {}
    for w, h in zip(spelt, whole.hash.tolist()):
        assert by_word.setdefault(w.lower(), h) == h
    assert len(set(by_word.values())) == len(by_word)
    for slab in (7, 64, 1000):
        monkeypatch.setattr(wd, "SLAB", slab)
        part = wd.scan(texts)
        for f in ("doc", "start", "end", "hash", "number", "capital", "opens"):
            assert np.array_equal(getattr(part, f), getattr(whole, f)), (slab, f)


# ---- decontamination --------------------------------------------------------------------------------

QUESTION = ("A farmer near the old river has 12 cows and sells 5 of them to Martin for 300 dollars each. How many cows does the farmer "
            "still have when Martin comes back after 7 days and buys 5 more of the animals?")


def test_verbatim_and_new_values(spark):
    rng = random.Random(6)
    other = QUESTION.replace("12", "48").replace(" 5 ", " 9 ").replace("300", "75").replace("7 days", "3 weeks").replace("Martin", "Olga")
    broken = QUESTION.replace("sells 5 of", "sells 9 of").replace("Martin comes", "Olga comes")
    docs = spark.createDataFrame([
        (1, prose(rng, 80) + " " + QUESTION + " " + prose(rng, 80), "x", 0), (2, prose(rng, 30) + "\n" + other + "\n", "x", 0),
        (3, prose(rng, 200), "x", 0), (4, None, "x", 0), (5, "", "x", 0), (None, QUESTION, "x", 0), (7, QUESTION, "x", 0), (7, QUESTION, "x", 0),
        (8, " ".join(QUESTION.split()[:12]) + " " + prose(rng, 60), "x", 0), (9, broken, "x", 0), (10, QUESTION + " " + prose(rng, 3000) + " " + QUESTION, "x", 0)],
        "doc_id long, text string, item_id string, row int")
    items = spark.createDataFrame([(100, QUESTION), (101, None), (102, "short"), (103, prose(rng, 40)), (104, "six words that nobody would write")], "item_id long, text string")
    got = {(r["id"], r["item_id"]): r["kind"] for r in decontam.matches(docs, items).collect()}
    assert got == {(1, 100): "verbatim", (2, 100): "reparameterised", (None, 100): "verbatim", (7, 100): "verbatim", (10, 100): "verbatim"}
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 8, 9]
    assert decontam.matches(docs.limit(0), items).count() == 0 and decontam.matches(docs, items.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "well, six words that nobody would write at all")], "doc_id long, text string")
    assert [r["item_id"] for r in decontam.matches(short, items).collect()] == [104]


def test_items_that_templates_cannot_hold(spark):
    texts = {1: "Add 12 34 56 78 90 11 22 33 44 55", 2: "THE QUICK BROWN FOX JUMPS OVER ALL LAZY DOGS TODAY", 3: "Who wrote Hamlet?",
             4: "世界上最高的山是什么山？", 5: "What is the capital of France?", 6: "日本で一番高い山は何ですか"}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    rng = random.Random(8)
    frames = ["{}", "Question: {}", "He said \"{}\" and left.", "前文，{}后文", prose(rng, 40) + " {} " + prose(rng, 40)]
    docs = [(10 * i + k, f.format(t)) for i, t in texts.items() for k, f in enumerate(frames)]
    docs += [(100, "Add 12 34 56 and nothing more"), (101, "Paris is the capital"), (102, "世界上最高的楼在哪里"), (103, "What is the old capital of the France of today")]
    got = {(r["id"], r["item_id"]) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    # A Latin word that is written onto a Chinese one begins and ends there.
    assert got == {(10 * i + k, i) for i in texts for k in range(len(frames))}


def test_unspaced_words():
    w = wd.scan(["ab中文é12 、x", "Été 𠀀z", "가나 다"], unspaced=True)
    assert [w.data[s:e].decode() for s, e in zip(w.start, w.end)] == ["ab", "中", "文", "é12", "、", "x", "Été", "𠀀", "z", "가나", "다"]


def test_query_finds_every_leak(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontaminate"](spark, SF).collect()}
    assert want and got == want


# ---- quality ----------------------------------------------------------------------------------------

def test_hinge_loss_optimum():
    """Dual coordinate descent reaches the primal optimum of a small problem (checked by perturbation)."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(6, 3, replace=False)) for _ in range(40)]
    values = [rng.normal(size=3) for _ in rows]
    y = np.array([1.0 if v[0] > 0 else -1.0 for v in values])
    cost = np.ones(40)
    w = quality.dual_coordinate_descent(rows, values, y, cost, 6, epochs=3000)

    def loss(w):
        return 0.5 * w @ w + sum(max(0.0, 1 - t * (w[f] @ v + w[-1])) for f, v, t in zip(rows, values, y))
    best = loss(w)
    assert all(best <= loss(w + d) + 1e-3 for d in rng.normal(scale=0.05, size=(300, 7)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op6_quality"](spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = scored.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    for label in (0, 1):
        of = [p == t for t, p in held if t == label]
        assert len(of) > 5 and sum(of) / len(of) >= 0.9
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_edges(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 60) if i % 2 else "spam spam | $$$ " * 30, "s", 1) for i in range(60)]
                                 + [(None, None, "s", 2), (100, "", "s", 3), (3, prose(rng, 60), "s", 4)], "doc_id long, text string, score string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (7, None), (3, 1), (3, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == 63 and all(r["score"] is not None for r in rows) and not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["doc_id"] in range(50, 60))
    assert quality.keep_good(docs, model).columns == docs.columns
    one = quality.train(docs, labels.where("quality = 1 and doc_id > 10"))
    assert all(r["predicted"] == 1 for r in quality.score_documents(docs, one).collect())
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), model).count() == 0


# ---- licences ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("text, want", [
    ("Licensed under CC BY-NC 4.0.\nWords here.", ["CC-BY-NC-4.0"]),
    ("Some words.\nReleased under the MIT License.\nMore.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Copyright (c) 2020 Somebody\nAll rights reserved.", ["all-rights-reserved"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
     "1. Redistributions of source code must retain the above copyright notice, this list.\n"
     "2. Redistributions in binary form must reproduce the above copyright notice, this list.", ["BSD-2-Clause"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software.\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
     ["MIT"]),
    ("SPDX-License-Identifier: mpl-2.0", ["mpl-2.0"]),
    ("The licence of the author is unclear.", ["unknown"]),
    ("He was permitted to go as is usual.", []), ("", []), ("permission\n" * 500, []),
])
def test_rules(text, want):
    found = licenses.apply_rules(licenses.sentence_ids(text))
    assert [f[0] for f in found] == want
    assert all(0 <= s < e <= len(text) for _, s, e in found)


HEADERS = {
    "MIT": """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "ISC": """Permission to
use, copy,
modify,
and/or
distribute
this software
for any
purpose with
or without
fee is hereby granted, provided that the notice appears in all copies.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or
without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above
   copyright notice, this list of conditions.
2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions.
3. Neither the name of the holder nor the names of its
   contributors may be used to endorse or promote products
   derived from this software.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with
the License.
You may obtain a copy of the License at http://example.org/LICENSE

Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an
"AS IS" BASIS.""",
} | {f"GPL-{v}.0-{kind}": f"""This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; {text}

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.""" for v in (2, 3) for kind, text in (("or-later", f"either version {v} of the License, or\n(at your option) any later version."), ("only", f"version {v} of the License."))}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- ", ";; "])
@pytest.mark.parametrize("name", HEADERS)
def test_commented_headers(name, mark):
    lines = [(mark + line).rstrip() for line in HEADERS[name].split("\n")]
    lines = ["/*", *lines, " */"] if mark == " * " else lines
    found = licenses.apply_rules(licenses.sentence_ids("\n".join(lines) + "\n\nint x;\n"))
    assert [f[0] for f in found] == [name]


def test_license_query(spark):
    lines = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
             "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "all-rights-reserved": "All rights reserved."}
    docs = {r["doc_id"]: r["text"].split("\n") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in QUERIES["op8_licenses"](spark, SF).collect()}
    assert got == {i: {n for n, line in lines.items() if line in t} for i, t in docs.items()}
    odd = spark.createDataFrame([(None, None, "a"), (1, "All rights reserved.", "b"), (1, "All rights reserved.", "b")], "doc_id long, text string, licenses string")
    assert sorted(len(r["licenses"]) for r in licenses.scan(odd).collect()) == [0, 1, 1]
    assert licenses.scan(odd.limit(0)).count() == 0


# ---- lines ------------------------------------------------------------------------------------------

def brute_lines(rows, min_sites):
    where = {}
    for key, site, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r "):
                where.setdefault(line.strip(" \t\r "), []).append((site or "", key if key is not None else 1 << 63, pos))
    first = {w: min(o[1:] for o in at) for w, at in where.items() if len({o[0] for o in at}) >= min_sites}
    out = []
    for key, site, text in rows:
        k = key if key is not None else 1 << 63
        keep = [ln for pos, ln in enumerate((text or "").split("\n")) if (b := ln.strip(" \t\r ")) not in first or first[b] == (k, pos)]
        out.append((key, site, None if text is None else "\n".join(keep)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    lines = [f"line number {i} with some words" for i in range(30)]
    rows = [(i, f"s{rng.randint(0, 14)}", "\n".join(rng.choice(lines[:1 + i % 30]) for _ in range(rng.randint(0, 12))) + "\n\n ") for i in range(250)]
    rows += [(900, None, lines[0] + "\r\n" + lines[1]), (901, "s1", None), (None, "s2", lines[2]), (902, "s3", "")]
    docs = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, source string, text string, pos string, drop int")
    for k in (3, 10, 12):
        got = linededup.remove_boilerplate(docs, min_sites=k, removed="n")
        assert got.columns == [*docs.columns, "n"]
        assert sorted(((r["doc_id"], r["source"], r["text"]) for r in got.collect()), key=repr) == brute_lines(rows, k), k
    twice = docs.where("doc_id = 5").unionByName(docs.where("doc_id = 5"))
    assert linededup.remove_boilerplate(twice, min_sites=1).count() == 2
    assert linededup.remove_boilerplate(docs.limit(0)).count() == 0


def test_line_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(ORACLES["op9_lines"])
    names = [d[0] for d in res.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in res.fetchall())
    got = QUERIES["op9_lines"](spark, SF)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want


# ---- personal data ----------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum((x if i % 2 == 0 else x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn,
                  "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


AWKWARD = [None, "", "a@b.c%d@e.f g@h", "x@y..z q.w+e%r-t@a-b.c-d.e. @@a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 1.2.3 99999999999999999999.1.1.1",
           "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5", "+1 (555) 010-9999 +49 30 1234567 +1 +12 +123456789012345678", "é🙂 a@b.co 10.0.0.1 🙂+1 555 0109999 4111111111111111",
           "7" * 20000, "1 " * 9000, "a" * 20000 + "@", "a.b@" * 3000, "+1" + "-" * 9000 + "2 " + "1." * 4000 + "9", "12 345 678 901 234 5 - 4 1 1 1-1111 1111-1111"]


def test_base_spans_equal_python(spark):
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice("ab1234567890..@@+-- ()%é") for _ in range(rng.randint(1, 80))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, email int")
    rows = {r["doc_id"]: r for r in pii.digest(pii.find(docs, pii.train(docs))).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS], t
        assert rows[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert set(filter(None, text.split(","))) <= set(rows[i]["spans"].split(",")), t


def test_added_spans(spark):
    rng = random.Random(8)
    texts = []
    for i in range(300):
        n = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        texts.append(rng.choice([f"please call {n} today", f"phone: {n}.", f"order {n}/{n}", f"call +1 ({n[:3]}) {n[4:]} now", f"mail joe.{i} [at] mail dot org"
                                 , f"contact ann{i} [at] mail{i}.org please", f"write to bob{i}@mail.com", "nothing in here"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs, pii.train(docs)).collect()}
    by = lambda word: [found[i] for i, t in enumerate(texts) if t.startswith(word)]
    assert all(len(r["more_phone"]) == 1 for r in by("please call")) and all(len(r["more_email"]) == 1 for r in by("contact"))
    assert not any(r["more_phone"] for r in by("order")) and not any(r["more_phone"] or r["more_email"] for r in by("nothing"))
    assert all(len(r["phone"]) == 1 and not r["more_phone"] for r in by("call +"))
    for i, r in found.items():
        for s in [*r["more_phone"], *r["more_email"]]:
            assert texts[i][s["s"]:s["e"]] == s["v"]


def test_expectation_maximisation_finds_reliabilities():
    rng = random.Random(1)
    counts = {}
    for _ in range(20000):
        y = rng.random() < 0.3
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < good) == y else -1) for good in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    post = pii.label_model(counts)
    assert post[(1, 1, 1)] > 0.9 and post[(-1, -1, 1)] < 0.1
    assert abs(sum(post[p] * n for p, n in counts.items()) / 20000 - 0.3) < 0.05


def test_pii_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op10_pii"](spark, SF).collect():
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want
    odd = spark.createDataFrame([(None, "a@b.co"), (1, None), (1, None)], "doc_id long, text string")
    model = pii.train(odd)
    assert sorted(r["n_email"] for r in pii.digest(pii.find(odd, model)).collect()) == [0, 0, 1]
    assert pii.find(odd.limit(0), pii.train(odd.limit(0))).count() == 0
