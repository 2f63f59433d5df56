"""Operators on single texts: fingerprints, token files, decontamination, licences, pseudonyms, toxicity."""

import hashlib
import zlib

import numpy as np
import pytest
from helpers import awkward, awkward_rows, plain, prose
from pyspark.sql import functions as F

from thermocline.llm import decontaminate, fingerprint, licenses, pii, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ---- fingerprints ----


def test_edited_fingerprints_equal_those_of_the_edited_texts(spark):
    rows = [(i * 3, prose(i, 5 + 13 * i % 90), "a") for i in range(40)] + [(500, None, "a"), (501, "", "a"), (502, "é\n\né", "a")]
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(plain(spark, rows)).collect()}
    assert len(got) == len(rows)
    edited = []
    for (k, t, _), (_, nxt, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) - len(t) // 4
        e = t[:cut] + nxt[: len(t) // 4]
        edited.append((k, e, ""))
        assert got[k]["n_chars"] == len(t)
        assert got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    whole = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(plain(spark, edited)).collect()}
    assert all(got[k]["edited_fingerprint"] == f for k, f in whole.items())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9


def test_fingerprints_are_of_multisets_of_lines(spark):
    texts = {1: "a b\nc\nd", 2: "d\na b\nc", 3: "a b\nc\nd\nd", 4: "a b\nc", 5: "b a\nc\nd"}
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(plain(spark, [(k, t, "") for k, t in texts.items()])).collect()}
    assert got[1] == got[2] and len({got[k] for k in (1, 3, 4, 5)}) == 4
    df = fingerprint.add_vectors(fingerprint.add_vectors(plain(spark, [(1, "x y\nz", "")]).withColumn("more", F.lit("z\nw")), "text", "a"), "more", "b")
    df = fingerprint.add_vectors(df.withColumn("both", F.lit("w\nz\nz\nx y")), "both", "c")
    for part in ("hi", "lo"):
        df = df.withColumn(f"sum_{part}", fingerprint.plus(F.col(f"a_{part}"), F.col(f"b_{part}"), part == "hi"))
        df = df.withColumn(f"back_{part}", fingerprint.minus(F.col(f"sum_{part}"), F.col(f"b_{part}"), part == "hi"))
    r = df.first()
    assert r["sum_hi"] == r["c_hi"] and r["sum_lo"] == r["c_lo"] and r["back_hi"] == r["a_hi"] and r["back_lo"] == r["a_lo"]


@pytest.mark.parametrize("words", [600_000, (1 << 20) + 1000])
def test_likeness_of_long_repetitive_texts(spark, words):
    rows = [(1, "0 " * words, ""), (2, prose(3, 4000) * 40, "")]
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(plain(spark, rows)).collect()}
    assert got[1]["near_edited"] > 0.9 and got[1]["near_edited"] > got[1]["near_next"]


def test_fingerprints_of_awkward_tables(spark):
    df = awkward(spark)
    rows = fingerprint.edited_fingerprints(df).collect()
    assert len(rows) == df.count()
    by_text = fingerprint.fingerprints(df).groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("fingerprint").alias("n")).collect()
    assert {r["n"] for r in by_text} == {1}
    assert fingerprint.edited_fingerprints(df.limit(0)).count() == 0
    one = fingerprint.edited_fingerprints(plain(spark, [(1, "abcdefgh", "")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


def test_fingerprints_run_no_python(spark):
    plan = fingerprint.edited_fingerprints(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- token files ----


def test_byte_coding_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 8, 1001):
        x = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        assert np.array_equal(tokens.unpack(tokens.pack(x)), x)


def test_pieces_encode_as_whole_texts():
    import random

    rnd = random.Random(5)
    parts = [*" \n\t.,'’a bZé 　 \r-1٣日", "<|endoftext|>", " the", "\n\n", "  ", ".", "’s", "'s", "\x85", "\x1c", "﻿"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [prose(i, 200) for i in range(20)] + [""]
    e = tokens.Encoder(TOKENIZER)
    for got, want in zip(e.encode(texts), e.plain(texts), strict=True):
        assert np.array_equal(got, want)
    for got, want in zip(e.encode(texts[:500]), e.plain(texts[:500]), strict=True):  # from what it has learnt
        assert np.array_equal(got, want)


def test_token_report_against_the_library(spark, monkeypatch):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] != 9] + [(100 + i, prose(i, 30), "a") for i in range(30)]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    want, start = {}, 0
    for k, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_report(plain(spark, rows), TOKENIZER).collect()}
    assert got == want


def test_token_report_of_awkward_tables(spark):
    df = awkward(spark)
    rows = sorted(tokens.token_report(df, TOKENIZER).collect(), key=lambda r: r["start"])
    assert len(rows) == df.count()
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]))
    keys = [r["doc_id"] for r in rows]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    assert tokens.token_report(df.limit(0), TOKENIZER).count() == 0


# ---- decontamination ----


def brute_hits(text, items, window=13):
    words = decontaminate.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        w = decontaminate.words_of(item)
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if n else []:
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(name)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [10_000, 30, 6])
def test_decontamination_against_brute_force(spark, block_words):
    import random

    rnd = random.Random(8)
    vocabulary = ["a", "b", "c", "d", "É", "e2"]
    make = lambda n: rnd.choice(["", "X "]) + " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, make(rnd.choice([2, 4, 7, 8, 20]))) for i in range(15)] + [(90, None), (91, " .,"), (92, "zebra"), (93, "zebra")]
    docs = [(i, make(rnd.choice([0, 3, 12, 60])) + " " + (items[i % 15][1] or ""), "s") for i in range(40)] + [(100, None, "s"), (101, "", "s"), (102, "a ZEBRA!", "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(plain(spark, docs), table, window=6, block_words=block_words).collect()
    texts = {k: t for k, t, _ in docs}
    named = [(str(i), t) for i, t in items]
    assert len(out) == len(docs)
    for r in out:
        n, hits, names = brute_hits(texts[r["doc_id"]], named, 6)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hits, names)
        assert r["contaminated"] == (hits > 0 and 20 * hits >= n)
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == hits


def test_decontamination_of_awkward_tables(spark):
    df, none = awkward(spark), spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(df, none)
    assert out.count() == df.count() and out.where("n_hit > 0 or contaminated").count() == 0
    assert set(df.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert decontaminate.decontaminate(df.limit(0), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


# ---- licences ----


def test_license_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."
    texts = {
        1: "Text. Released under the MIT License.",
        2: "Licensed under the Apache License, Version 2.0.\nAll rights reserved.",
        3: mit,
        4: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        5: "nothing here",
        6: None,
        7: "",
        8: "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        9: "the license of the apache",
        10: "You may obtain a copy of the license at",
    }
    got = {r["doc_id"]: r for r in licenses.scan(plain(spark, [(k, t, "") for k, t in texts.items()])).collect()}
    assert got[1]["licenses"] == ["MIT"] and got[2]["licenses"] == ["Apache-2.0", "Proprietary"] and got[3]["licenses"] == ["MIT"]
    assert got[8]["licenses"] == ["CC-BY-NC-4.0"] * 2 and got[10]["unresolved"] == ["ApacheCopy"] and got[10]["license"] is None
    assert all(got[k]["licenses"] == [] and got[k]["license"] is None for k in (5, 6, 7, 9))
    assert licenses.scan(awkward(spark)).count() == awkward(spark).count()
    assert licenses.scan(awkward(spark).limit(0)).count() == 0


def test_license_rules_against_brute_force(spark):
    import random
    import re

    rnd = random.Random(2)
    sentences = [*licenses.SENTENCES, "some other sentence"]
    rows = [(i, ".\n".join(rnd.choice(sentences) for _ in range(rnd.randint(0, 9))), "") for i in range(150)]

    def brute(text):
        ids = [licenses.SENTENCES.get(re.sub("[^a-z0-9]+", " ", s.lower()).strip()) for s in re.split(r"\n|[.!?;:]\s|[()]", text)]
        ids, found = [i for i in ids if i], []
        for name, rule in licenses.RULES:
            at = 0
            while True:  # leftmost, nearest matches, none overlapping the one before
                spots, p = [], at
                for i in rule:
                    p = next((j for j in range(p, len(ids)) if ids[j] == i), None)
                    if p is None:
                        break
                    spots.append(p)
                    p += 1
                if p is None or len(spots) < len(rule):
                    break
                found.append(name)
                at = spots[-1] + 1 - len(spots)
                ids = [x for j, x in enumerate(ids) if j not in spots]
        return found, ids

    for r in licenses.scan(plain(spark, rows)).collect():
        assert (r["licenses"], r["unresolved"]) == brute(r["text"])


GPL = "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version."
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = "\n3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License."""
STANDARD = [
    (GPL.format(what="program", a=";", kind="", b=";", v="2"), "GPL-2.0-or-later"),
    (GPL.format(what="program", a=":", kind="", b=",", v="3"), "GPL-3.0-or-later"),
    (GPL.format(what="library", a=";", kind="Lesser ", b=";", v="2.1"), "LGPL-2.1-or-later"),
    (GPL.format(what="library", a=":", kind="Lesser ", b=",", v="3"), "LGPL-3.0-or-later"),
    (GPL.format(what="library", a=";", kind="Lesser ", b=";", v="3"), "LGPL-3.0-or-later"),
    (GPL.format(what="library", a=";", kind="Library ", b=";", v="2"), "LGPL-2.0-or-later"),
    (GPL.format(what="program", a=":", kind="Affero ", b=",", v="3"), "AGPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    (MIT, "MIT"),
    (BSD, "BSD-2-Clause"),
    (BSD + BSD_NAMES.format("the copyright holder"), "BSD-3-Clause"),
    (BSD + BSD_NAMES.format("Example Inc."), "BSD-3-Clause"),
    (APACHE, "Apache-2.0"),
]


def test_standard_notices_wrapped_and_unwrapped(spark):
    import textwrap

    def wrapped(text, width, prefix):
        lines = [x for p in text.split("\n") for x in textwrap.wrap(p, width) or [""]]
        return "\n".join(prefix + x for x in ["Copyright 2020 A. Nyone", *lines])

    forms = [lambda t: t, lambda t: "/* " + t + " */", lambda t: t.replace("\n", "\r\n")]
    forms += [lambda t, w=w, p=p: wrapped(t, w, p) for w in (30, 72) for p in ("", "# ", " * ", "// ", ";; ", "dnl ", "REM ")]
    rows = [(i * 100 + j, form(text), name) for i, (text, name) in enumerate(STANDARD) for j, form in enumerate(forms)]
    for r in licenses.scan(plain(spark, rows)).collect():
        assert (r["licenses"], [x for x in r["unresolved"] if x != "GplFree"]) == ([r["source"]], []), r["text"]


# ---- pseudonyms ----


def test_pseudonyms_keep_format_and_links_and_go_back(spark):
    text = "Mail ab.34@x.example.com, +1 (017) 555-7713 or +1 (017) 555-7713, host 233.254.104.120, born 2020-02-29, 12/31/1999, card 4111 1111 1111 1111 and 4111111111111111, ssn 123-45-6789"
    bad = "2021-02-30 4111111111111112 300.1.1.1 000-12-3456 666-12-3456 1.2.3 12345"
    rows = [(1, text, ""), (2, "again +1 (017) 555-7713 4111-1111-1111-1111", ""), (3, bad, ""), (4, None, ""), (5, "", ""), (6, "+1 (017) 555-7714", "")]
    df = plain(spark, rows)
    out = pii.pseudonymise(df, "secret")
    got = {r["doc_id"]: r for r in out.collect()}
    new = got[1]["text"]
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 2, 1, 2, 2, 1]
    assert len(new) - len(text) in range(-8, 9) and not any(x in new for x in ("ab.34", "555-7713", "233.254.104.120", "2020-02-29", "4111", "123-45-6789"))
    phones = [new.split(", ")[1].split(" or ")[0], got[2]["text"].split("again ")[1][:17]]
    assert phones[0] == phones[1] != got[6]["text"]
    cards = [new.split("card ")[1][:19].replace(" ", ""), new.split(" and ")[1][:16], got[2]["text"][-19:].replace("-", "")]
    assert len(set(cards)) == 1
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(cards[0])))
    assert total % 10 == 0
    assert got[3]["text"] == bad and got[4]["text"] is None and got[5]["text"] == ""
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out.select("doc_id", "text", "source"), "secret", back=True).collect()}
    assert back == {k: t for k, t, _ in rows}


CARD_RUNS = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 12/25", "7 4111111111111111", "No.4111-1111-1111-1111", "4111 1111 1111 1111 5500 0000 0000 0004"]
PHONES = ["+44 20 7946 0958", "+33 1 42 68 53 00", "+49 30 901820", "+34 912 345 678", "+44 (0)20 7946 0958", "+351 21 123 4567", "(415) 555-2671", "415-555-2671", "020 7946 0958", "01 42 68 53 00", "(030) 901820"]
DAYS = ["1980-02-03T10:00:00Z", "24.12.1999", "3.2.1980", "1/2/1980", "1980/02/03", "24-12-1999", "3 February 1980", "Feb 3, 1980", "1980-02-03/1980-02-09"]


def test_pseudonyms_of_more_layouts(spark):
    rows = [(i, f"see {t} there", t) for i, t in enumerate([*CARD_RUNS, *PHONES, *DAYS])]
    rows += [(100, "+14155552671 and +1 (415) 555-2671 and (415) 555-2671, +34 912 345 678 42 items", ""), (101, "12 123-45-6789 13 1980-01-01", ""), (102, "4111 " * 3 + "1111 " * 5000, "")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(plain(spark, rows), "secret").collect()}
    for i, text, value in rows[: len(CARD_RUNS)]:
        assert got[i]["n_card"] == (2 if "5500" in value else 1) and "1111" not in got[i]["text"].replace(" ", "").replace("-", "")[:24], got[i]
    assert got[0]["text"].endswith(" 123 there") and got[1]["text"].endswith(" 12/25 there") and got[2]["text"].startswith("see 7 ")
    for i, text, value in rows[len(CARD_RUNS) : len(CARD_RUNS) + len(PHONES)]:
        assert got[i]["n_phone"] == 1 and got[i]["text"] != text and len(got[i]["text"]) == len(text), got[i]
        assert sum(got[i][f"n_{k}"] for k in pii.KINDS) == 1
    for i, text, value in rows[len(CARD_RUNS) + len(PHONES) : -3]:
        assert got[i]["n_date"] == (2 if "/1980-" in value else 1) and value not in got[i]["text"], got[i]
    digits = ["".join(c for c in x if c.isdigit())[-10:] for x in got[100]["text"].split(", ")[0].split(" and ")]
    assert len(set(digits)) == 1 and got[100]["text"].endswith(" 42 items") and got[100]["n_phone"] == 4
    assert (got[101]["n_ssn"], got[101]["n_date"]) == (1, 1)


def test_feistel_is_a_permutation(spark):
    df = spark.range(35 * 35).select(pii.permute((F.col("id") / 35).cast("long"), F.col("id") % 35, F.lit(35).cast("long"), F.lit(35).cast("long"), "k", "t", 0).alias("p"))
    assert df.select("p.l", "p.r").distinct().count() == 35 * 35
    assert df.where("p.l < 0 or p.l >= 35 or p.r < 0 or p.r >= 35").count() == 0
    codes = spark.range(1000).select(pii._text_permuted(F.lpad(F.col("id").cast("string"), 3, "0"), 10, "k", "t", False).alias("c"))
    assert sorted(r["c"] for r in codes.collect()) == [f"{i:03d}" for i in range(1000)]


def test_pseudonyms_of_awkward_tables(spark):
    df = awkward(spark)
    out = pii.pseudonymise(df, "k")
    assert out.count() == df.count() and pii.pseudonymise(df.limit(0), "k").count() == 0
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id = 7").collect()} == {r["doc_id"]: r["text"] for r in df.where("doc_id = 7").collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- toxicity ----


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, prose(i, 40) + (" vile scum" if i % 4 == 0 else ""), "") for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(plain(spark, rows), labels)
    assert 0 < len(weights) < 5000
    out = toxicity.score(plain(spark, rows), weights).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert 100 < len(held) < 220 and all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert weights == toxicity.fit(plain(spark, rows, parts=5), labels)
    kept = toxicity.filter_toxic(plain(spark, rows), weights)
    assert kept.columns == ["doc_id", "text", "source"] and kept.where("text like '%vile scum'").count() < 10


def test_toxicity_of_awkward_tables(spark):
    df, none = awkward(spark), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(df, none) == {}
    out = toxicity.score(df, {})
    assert out.count() == df.count() and {r["score"] for r in out.collect()} == {0.5}
    some = toxicity.fit(df, spark.createDataFrame([(1, 1), (1, 0), (9, 0), (2, 0), (4, 0), (13, 1)], "doc_id long, toxic int"))
    assert toxicity.score(df, some).where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(df.limit(0), some).count() == 0


def test_license_rules_take_any_number_of_identifiers(spark):
    """Neither many identifiers between those of a rule nor many beginnings without an end cost more than a walk."""
    grant, notice = (next(s for s, i in licenses.SENTENCES.items() if i == x) for x in ("MitGrant", "MitNotice"))
    rights = "All rights reserved.\n"
    texts = [
        (1, f"{grant}.\n" + rights * 100_000 + f"{notice}.\n", "MIT"),
        (2, f"{grant}.\n" * 20_000 + rights, "Proprietary"),
        (3, f"{grant}.\n{grant}.\n{notice}.\n{notice}.\n", "MIT"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(plain(spark, texts)).collect()}
    assert all(got[k]["license"] == want for k, _, want in texts)
    assert got[1]["licenses"] == ["MIT"] + ["Proprietary"] * 100_000 and got[1]["unresolved"] == []
    assert got[2]["unresolved"] == ["MitGrant"] * 20_000
    assert got[3]["licenses"] == ["MIT"] and got[3]["unresolved"] == ["MitGrant", "MitNotice"]


LONG_NAME = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def test_licenses_by_tag_name_and_grant(spark):
    texts = {
        "// SPDX-License-Identifier: MIT": ["MIT"],
        "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport os": ["Apache-2.0", "MIT"],
        "/* SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 */": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0-only"],
        "SPDX-License-Identifier: No-Such-Licence": [],
        "spdx mit or apache": [],
        "This file is licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "Text before. Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": ["BSL-1.0"],
        "Creative Commons Attribution-ShareAlike 4.0 International": ["CC-BY-SA-4.0"],
        "This work is licensed under the Creative Commons\nAttribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"],
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": ["ISC", "ISC"],
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n": ["Zlib"],
        "we like zlib": [],
        "zlib": [],
        LONG_NAME.format("the " + "very long " * 200 + "Company, Inc."): ["BSD-3-Clause"],
        LONG_NAME.format("the copyright holder"): ["BSD-3-Clause"],
        LONG_NAME.partition("Neither")[0]: ["BSD-2-Clause"],
    }
    rows = licenses.scan(plain(spark, [(k, t, "") for k, t in enumerate(texts)])).collect()
    assert {r["text"]: r["licenses"] for r in rows} == texts


def test_toxicity_without_labels_keeps_every_row(spark):
    df = awkward(spark)
    assert toxicity.filter_toxic(df, {}).count() == df.count()


def test_toxicity_fit_is_bounded(spark):
    """One row of a repeated key, and no more features than asked for, however long the texts."""
    keys = [k for k in range(1, 400) if zlib.crc32(str(k).encode()) % 5]
    rows = [(k, f"{'awful' if k % 2 else 'kind'} words{k % 7}", "") for k in keys]
    labels = spark.createDataFrame([(k, k % 2) for k in keys], "doc_id long, toxic int")
    weights = toxicity.fit(plain(spark, rows), labels)
    assert weights and weights == toxicity.fit(plain(spark, rows + [rows[0]] * 5_000, parts=7), labels)
    tail = " ".join(f"word{i}" for i in range(50_000))
    long = [(k, f"{t} {tail}", "") for k, t, _ in rows[:20]]
    assert toxicity.fit(plain(spark, long), labels, fit_features=10_000) == {}
    assert toxicity.fit(plain(spark, rows[:20]), labels, fit_features=10_000) != {}
