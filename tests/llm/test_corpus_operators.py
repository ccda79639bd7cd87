"""The corpus operators against brute force, exact round trips and held-out labels, with the awkward cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import decision_list, decontaminate, fm_index, licenses, line_dedup, near_dup, pii, quality_model, sentencepiece_bpe, sharding, toxicity
from fieldgauge.llm.feistel import permute, round_keys
from fieldgauge.llm.queries import piece_model

ODD = [None, "", " ", "\n", "a", "x" * 5000, "é ß 漢字 😀‍", "same same", "same same"]
DATA = "/root/testdata/sf0.001"


def docs_of(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # extra columns whose names clash with those of results
    return df.withColumns({"n": F.lit(1), "score": F.lit("x"), "ids": F.lit(0), "label": F.lit(2), "key": F.lit("k"), "at": F.lit(0)}) if extra else df


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def change(rng, x, k, letters="abcé"):
    x = list(x)
    for _ in range(k):
        i, r = rng.randrange(len(x) + 1), rng.random()
        if r < 0.33:
            x.insert(i, rng.choice(letters))
        elif x and r < 0.66:
            x.pop(min(i, len(x) - 1))
        elif x:
            x[min(i, len(x) - 1)] = rng.choice(letters)
    return "".join(x)


# 1 license scans
def test_licenses(spark):
    s = licenses.Scanner()
    want = {"Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "A driving license is needed here.": None}
    assert {t: s.judge(t).license for t in want} == want
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, [*ODD, "Text. Released under the MIT License.\nMore. Licensed under CC BY 4.0. End"])).collect()}
    assert all(got[i].n_blocks == 0 and got[i].licenses == [] for i in range(len(ODD)))
    assert got[len(ODD)].licenses == ["CC-BY-4.0", "MIT"]
    assert licenses.scan(docs_of(spark, []).limit(0)).count() == 0


def test_license_wordings(spark):
    """Wrapped headers, comment signs, identifiers, and several statements in a block."""
    s = licenses.Scanner()
    named = lambda t: sorted({v.license for b in s.verdicts(t) for v in b if v.license})
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    bsd = "Licensed under the BSD\n3-Clause License."
    assert named(mit) == ["MIT"] and named("\n".join("# " + x for x in mit.split("\n"))) == ["MIT"]
    assert named(bsd) == ["BSD-3-Clause"] and named(" * " + bsd.replace("\n", "\n * ")) == ["BSD-3-Clause"]
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "LGPL-2.1", "ISC"):
        assert named(f"// SPDX-License-Identifier: {name}\nint main;") == [name]
    assert named("Released under the MIT License. All rights reserved. Copyright 2020.") == ["MIT", "proprietary"]
    long = "word " * 30_000
    assert named(long + "Released under the MIT License. " + long) == ["MIT"] and named(long + " released under the mit license " + long) == ["MIT"]


def test_licenses_that_share_wording():
    """Full BSD bodies with numbers, bullets and comment signs; identifier expressions; titles; denials; versions of CC."""
    s = licenses.Scanner()
    named = lambda t: sorted({v.license for b in s.verdicts(t) for v in b if v.license})
    head = "Copyright (c) 2020, Someone\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    clauses = ["Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."]
    tail = '\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
    for n, name in ((2, "BSD-2-Clause"), (3, "BSD-3-Clause")):
        for mark in ("{}. ", "* ", "({}) "):
            body = head + "\n\n".join(mark.format(i + 1) + c for i, c in enumerate(clauses[:n])) + tail
            assert named(body) == [name], (n, mark)
            assert named("\n".join("# " + line for line in body.split("\n"))) == [name], (n, mark)
    assert named(head) == []
    assert named("SPDX-License-Identifier: MIT OR Apache-2.0") == ["Apache-2.0", "MIT"]
    assert named("# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\nx = 1") == ["BSD-3-Clause", "GPL-2.0"]
    assert named("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA-4.0"] and named("Licensed under CC BY-NC-ND 4.0.") == ["CC-BY-NC-ND-4.0"]
    assert named("MIT License") == ["MIT"] and named("The MIT License\n\nmore text") == ["MIT"]
    assert named("This is not released under the MIT License.") == [] and named("It is no longer licensed under the Apache License, Version 2.0.") == []
    assert named("This is not released under the MIT License. Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    for name, text, _ in licenses.TEMPLATES:
        assert named(text) == [name], text


def test_scan_by_hand(spark):
    """The operator gives the blocks, the licenses and the words in which they differ, row by row."""
    rows = ["A. Released under the MIT License.", "Released under the MIT License. Words between. Licensed under CC BY 4.0.", None, "nothing"]
    got = {r.doc_id: (r.n_blocks, r.licenses, [(f.license, f.missing) for f in r.findings]) for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == {0: (1, ["MIT"], [("MIT", [])]), 1: (2, ["CC-BY-4.0", "MIT"], [("MIT", []), ("CC-BY-4.0", [])]), 2: (0, [], []), 3: (0, [], [])}


def test_license_of_blocks_by_all_templates():
    """The verdict of 1,000 altered statements is the best-saving one of all templates whose wording holds."""
    rng, s = random.Random(21), licenses.Scanner()
    texts = [t for _, t, _ in licenses.TEMPLATES]
    for _ in range(1000):
        words = rng.choice(texts).split() + (rng.choice(texts).split() if rng.random() < 0.2 else [])
        block = " ".join(w for w in words if rng.random() > rng.choice([0, 0.1, 0.4])) or "license"
        raw, have, hold = block.encode(), licenses.wording(block), []
        for i, (name, text, marks) in enumerate(s.templates):
            row = [[0] * (len(have) + 1) for _ in range(len(text) + 1)]
            for x in range(len(text)):
                for y in range(len(have)):
                    row[x + 1][y + 1] = row[x][y] + 1 if text[x] == have[y] else max(row[x][y + 1], row[x + 1][y])
            saved = len(s.alone.compress(raw)) - len(s.given[i].compress(raw))
            if saved > 0 and marks <= set(have) and not (set(have) & licenses.TELLING) - set(text) - marks and row[-1][-1] >= licenses.COVER * len(text):
                hold.append((-saved, i, name))
        assert s.judge(block).license == (min(hold)[2] if hold else None)


# 2 line dedup
@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [(a, change(rng, a, rng.randint(0, 5)) or "a") for a in ("".join(rng.choice("abc😀") for _ in range(rng.randint(3, 30))) for _ in range(300))]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect():
        e = edits(r.a, r.b)
        assert r.d == e if e <= threshold else r.d > threshold


@pytest.mark.parametrize("hot", [64, 3])
def test_line_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(40, 70))) for _ in range(20)]
    texts = ["\n".join(change(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 5))) for _ in range(60)] + [*ODD]
    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if len(line) >= 40:
                first.setdefault(line, (i, k))
    order = sorted(first, key=first.get)
    keep = {first[a] for n, a in enumerate(order) if not any(abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2 for b in order[:n])}
    want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if len(x) < 40 or (i, k) in keep) for i, t in enumerate(texts)}
    got = {r.doc_id: r.kept_sha256 for r in line_dedup.deduplicated(docs_of(spark, texts), min_chars=40).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert line_dedup.deduplicated(docs_of(spark, []).limit(0)).count() == 0


def near_lines(a, b):
    """The documented rule: no edit below 12 code points, one below 30, two from there on."""
    n = min(len(a), len(b))
    most = 0 if n < 12 else 1 if n < 30 else 2
    return abs(len(a) - len(b)) <= most and edits(a, b) <= most


def test_short_lines_that_say_something_else(spark):
    texts = ["Total: 12", "Total: 37", "cat\ndog\ncow\ncat", "In.\nOf.", "Total: 12", "The total is 1234", "The total is 1235", "The total is 1299", "The total of this very long line is 12", "The total of this very long line is 37"]
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.deduplicated(docs_of(spark, texts)).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (4, 3), 3: (2, 2), 4: (1, 0), 5: (1, 1), 6: (1, 0), 7: (1, 1), 8: (1, 1), 9: (1, 0)}


@pytest.mark.parametrize("n_labels", [300, 40_000])
def test_labels_without_documents_take_no_place(spark, n_labels):
    """All labelled documents are learned from whatever the labels table holds besides, and one row of a repeated id."""
    from fieldgauge.llm import common, hashed_terms

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    hot = docs.unionByName(spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("again "), F.col("id").cast("string")).alias("text")))
    labels = spark.range(n_labels).select(F.col("id").alias("doc_id"), F.lit(1).alias("_y"))
    make = lambda: lambda text: (np.array([hashed_terms.slot(text)], np.int32), np.ones(1, np.float32))
    taken = [hashed_terms.sample(d, labels, 1000, make) for d in (docs, hot.repartition(5), hot.repartition(2))]
    assert [len(x) for x in taken] == [200] * 3 and [r[1].tolist() for r in taken[1]] == [r[1].tolist() for r in taken[2]]
    assert len(hashed_terms.sample(hot, labels, 50, make)) == 50
    assert common.labelled_sample(hot, labels, 50).count() == 50
    stats = hot.select("doc_id", *(F.lit(k).cast("long").alias(c) for k, c in enumerate([*decision_list.COUNTS, *decision_list.MORE])))
    assert decision_list.learned_rules(stats, labels.select("doc_id", F.lit(1).alias("quality")), 1000) == []


def test_names_in_other_letters(spark, tmp_path):
    """Extra columns that have a result's name in capitals: the results are written and read."""
    import corpus_pipeline
    from fieldgauge.llm.common import table

    few = table(spark, DATA, "documents").limit(40)
    labels = table(spark, DATA, "labels")
    clash = few.withColumns({c: F.lit("x") for c in ("Tails", "EXPECTED_GRADE", "Spans", "N_WORDS", "Items")})
    done = {
        "quality": corpus_pipeline.quality(spark, clash, DATA),
        "lines": corpus_pipeline.lines(spark, clash.withColumn("_AT", F.lit(1)), DATA),
        "near": corpus_pipeline.near_duplicates(spark, clash.withColumn("CLASS", F.lit(1)), DATA),
        "benchmarks": corpus_pipeline.benchmarks(spark, clash, DATA),
        "encode": corpus_pipeline.encode(spark, few.withColumns({c: F.lit("x") for c in ("IDS", "N_Tokens", "Ids_sha256")}), DATA),
        "pii": pii.pseudonymized(few.withColumn("KINDS", F.lit(1)), key="k"),
        "shards": sharding.shuffle_into_shards(few.withColumns({"SHARD": F.lit("x"), "Slot": F.lit(1), "ROW_number": F.lit(2)}), ["doc_id"], 3, "k"),
        "toxic": toxicity.score(few.withColumn("SCORE", F.lit("x")), toxicity.fit_on(few, labels)),
        "counts": decision_list.with_statistics(few.withColumn("N_WORDS", F.lit("x"))),
    }
    for name, df in done.items():
        assert len({c.lower() for c in df.columns}) == len(df.columns), name
        df.write.parquet(str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).columns == df.columns


def test_line_dedup_of_all_lines(spark, tmp_path):
    """The registered query and the pipeline take part of no length out: short repeats go, blank lines stay."""
    import corpus_pipeline
    from fieldgauge.llm import queries

    rng = random.Random(14)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 45))) for _ in range(30)]
    texts = ["\n".join(change(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 6))) for _ in range(50)] + ["a\nb\n\n \na", "ab\nab\n\t\n\t", *ODD]
    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, k))
    order = sorted(first, key=first.get)
    keep = {first[a] for n, a in enumerate(order) if not any(near_lines(a, b) for b in order[:n])}
    want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if not x.strip() or (i, k) in keep) for i, t in enumerate(texts)}
    docs_of(spark, texts, False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs_of(spark, texts, False), "").where("text is not null").collect()}
    assert left == {i: t for i, t in want.items() if texts[i] is not None and (t.strip(" ") or not texts[i].strip(" "))}


def test_line_dedup_of_very_long_lines(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    texts = [long, long[:50_000] + "Z" + long[50_001:], "\n".join([long[:-3], long[1:]]), "short\n" + long]
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs_of(spark, texts)).collect()}
    assert [(got[i].n_lines, got[i].n_kept) for i in range(4)] == [(1, 1), (1, 0), (2, 1), (2, 1)]


def test_line_dedup_is_native(spark):
    plan = line_dedup.without_repeats(docs_of(spark, ["a" * 50]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3 quality classifier, 5 toxicity
def test_quality_held_out(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = lab.where("doc_id % 3 > 0")
    model = quality_model.fit_on(d, quality_model.grades_from_labels(train))
    assert (np.diff(model.thresholds) > 0).all()
    r = quality_model.score(d.select("doc_id", "text"), model).join(lab.where("doc_id % 3 = 0"), "doc_id").select("quality", "toxic", (F.col("tails")[0] >= 0.5).cast("int").alias("kept"), F.col("tails")[1].alias("best")).collect()
    good = [x.kept for x in r if x.quality == 1]
    bad = [x.kept for x in r if x.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    clean, toxic = ([x.best for x in r if x.quality == 1 and x.toxic == k] for k in (0, 1))
    assert np.mean([a > b for a in clean for b in toxic]) > 0.8  # the upper threshold tells good texts from toxic ones
    assert quality_model.graded_documents(docs_of(spark, []).limit(0), lab).count() == 0
    same = docs_of(spark, [*ODD]).withColumns({"tails": F.lit("x"), "expected_grade": F.lit(1)})
    assert quality_model.keep_good(same, lab.limit(0)).columns == same.columns
    odd = quality_model.graded_documents(docs_of(spark, ODD), lab).collect()
    assert len(odd) == len(ODD) and all(0 <= x.p_best <= x.p_good <= 1 for x in odd)


def test_toxicity_held_out(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = toxicity.toxic_documents(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)
    caught = sum(x.predicted for x in r if x.toxic)
    assert caught >= 0.6 * sum(x.toxic for x in r) and caught >= 0.75 * sum(x.predicted for x in r)
    assert toxicity.toxic_documents(docs_of(spark, []).limit(0), lab).count() == 0
    odd = toxicity.toxic_documents(docs_of(spark, ODD), lab.limit(0)).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in odd)


def test_pairs_matter(spark):
    """Terms that are harmful only together get a pair weight, and a text with one of them stays clean."""
    rng = np.random.default_rng(1)
    word = {"insult": 0, "group": 1}
    slot = {w: toxicity.word_slots(w)[0] for w in word}
    rows = []
    for _ in range(600):
        has = [w for w in word if rng.random() < 0.5]
        s = np.array(sorted(slot[w] for w in has), np.int32)
        rows.append((int(len(has) == 2), s, np.ones(len(s), np.float32)))
    machine = toxicity.fit(rows, steps=400)
    at = [int(np.flatnonzero(machine.slots == slot[w])[0]) for w in word]
    assert machine.factors[at[0]] @ machine.factors[at[1]] > 0.5
    one, other, both = machine.scores(["insult", "group", "insult group"], machine.known())
    assert both > 0.5 > max(one, other)


# 4 SentencePiece
def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    enc = sentencepiece_bpe.Encoder(sentencepiece_bpe.vocabulary(piece_model()))
    rng = random.Random(1)
    letters = "  \n\t▁abcthing ehrné.,0123ß漢字😀-_<s>▁ \r\xa0{}()=//**"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [" " * n for n in range(40)] + [t or "" for t in ODD]
    for t in texts:
        ids = sp.encode(t)
        assert enc.encode(t) == ids and enc.decode_text(ids) == sp.decode(ids)
    got = {r.doc_id: r for r in sentencepiece_bpe.digest(docs_of(spark, ODD, False), piece_model()).collect()}
    for i, t in enumerate(ODD):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert sentencepiece_bpe.digest(docs_of(spark, []).limit(0), piece_model()).count() == 0
    long = "x" * 100_000 + " " + "Aé b" * 5_000
    assert enc.encode(long) == sp.encode(long)
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs_of(spark, ODD), piece_model()), piece_model(), out_col="back")
    assert all(r.back == (r.text or "").replace("▁", " ") for r in both.collect())


def test_runs_of_units():
    """No piece spans two runs of a unit; words that differ in the signs around them share their runs."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    enc = sentencepiece_bpe.Encoder(sentencepiece_bpe.vocabulary(piece_model()))
    assert all(len(enc.cut(p)) == 1 for p in enc.text)
    assert sentencepiece_bpe._runs(["ab", "b.", "xy", "▁x", "▁"]).findall("▁xyab.ba,\n") == ["▁xy", "ab.ba", ",", "\n"]
    for text in ("enverschung, enverschung. enverschung!\nenverschung### enverschung", "日本語,éx漢😀字.\n\n", ",a ▁ \n."):
        assert enc.encode(text) == sp.encode(text)
    assert sum("enverschung" in run for run in enc.runs) == 2  # with and without the space in front


# 6 decontamination
def test_index():
    rng = random.Random(3)
    for _ in range(60):
        top = rng.choice([1, 2, 3, 9])
        seq = np.array([rng.randint(0, top) for _ in range(rng.randint(1, 80))] + [0])
        ix = fm_index.FMIndex(seq, top, sample=3)
        phrases = [[rng.randint(1, top) for _ in range(rng.randint(1, 4))] for _ in range(20)]
        rows, size = np.zeros((20, 4), int), np.array([len(p) for p in phrases])
        for i, p in enumerate(phrases):
            rows[i, 4 - len(p) :] = p
        got = {w: sorted(ix.locate(np.arange(a, b)).tolist()) for w, a, b in zip(*ix.search(rows, size), strict=True)}
        for i, p in enumerate(phrases):
            assert got.get(i, []) == [j for j in range(len(seq) - len(p) + 1) if seq[j : j + len(p)].tolist() == p]


@pytest.mark.parametrize("most", [400_000, 5])
def test_passages(spark, most, monkeypatch):
    rng = random.Random(6)
    item = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (30, 12, 10, 3, 0)]
    texts = [f"x {item[0]} y", f"{item[1].upper()}, {item[3]}", item[2] + "!" + item[2], *ODD]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(item)] + [(9, None), (None, "x"), (20, item[2])], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {(i, tuple(w[k : k + 10])) for i, t in [*enumerate(item), (20, item[2])] if (w := low(t)) for k in range(max(1, len(w) - 9))}
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 8)
    found = decontaminate.find_passages(docs_of(spark, texts, False), bench, max_windows=most).collect()
    for r in found:
        w, hit, items = low(texts[r.doc_id]), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items.add(i)
        assert {k for s in r.spans for k in range(s["first"], s["after"])} == hit and set(r["items"]) == items and r.n_words == len(w)
    assert decontaminate.remove_passages(docs_of(spark, []).limit(0), bench).count() == 0
    small = decontaminate.find_passages(docs_of(spark, texts, False), bench.select(F.col("item_id").cast("smallint"), "text"), max_windows=most)
    assert sum(len(r.items) for r in small.collect()) == sum(len(r.items) for r in found)
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", most)
    clashing = docs_of(spark, texts).withColumns({"spans": F.lit(5), "n_words": F.lit("w"), "items": F.lit(1.5), "n_chars": F.char_length("text")})
    left = decontaminate.remove_passages(clashing, bench)
    assert left.columns == clashing.columns and left.where("doc_id = 0").select("text", "n_chars", "spans", "n_words").first() == ("x  y", 4, 5, "w")
    assert left.where("text is null").count() == 1


# 7 pseudonyms
def test_pseudonyms(spark):
    text = 'ab.25@mail6.example.com +1 (677) 555-7033, 4961143020124266 80.122.231.226 2021-03-04 03/04/2021 31/12/1999 25/02/2001 123-45-6789 GB82 WEST 1234 5698 7654 32 token = "6b526d9e98196c4dff5a73e8083186bb0ce9e5bd" +44 20 7946 0958'
    there, back = pii.Pseudonyms("k"), pii.Pseudonyms("k", back=True)
    new, kinds = there.apply(text)
    assert back.apply(new)[0] == text and new != text and len(kinds) == 12 and len(new) == len(text)
    assert there.apply("1234567890123456 999.1.1.1 2021-02-30")[1] == []
    card = re.search(r"\d{16}", new)[0]
    assert pii.luhn(card) == 0 and card != "4961143020124266"
    got = {r.doc_id: r for r in pii.pseudonymized(docs_of(spark, [*ODD, text, text]), "k").collect()}
    assert all(got[i].text == t and got[i].kinds == [] for i, t in enumerate(ODD)) and got[len(ODD)].text == got[len(ODD) + 1].text == new


def test_secrets_in_any_letters():
    """Labels in capitals and with other signs, tokens with signs in them, dates with slashes: replaced, undone, equal where equal."""
    there, back = pii.Pseudonyms("k"), pii.Pseudonyms("k", back=True)
    secrets = ["API_KEY=abcdEFGH1234", "Password: abcdEFGH1234", "api-key: abcdEFGH1234", "token: ghp_abcdEFGH1234xyz", "secret=sk-abcdEFGH1234", 'ACCESS_KEY="AKIA1234567890AB"']
    for text in secrets:
        new, kinds = there.apply(f"see {text}, thanks")
        label = re.match(r"[\w-]+\s?[=:]\s?\"?", text)[0]
        assert kinds == ["secret"] and new.startswith(f"see {label}") and text[len(label) :].strip('"') not in new, text
        assert len(new) == len(text) + len("see , thanks") and back.apply(new)[0] == f"see {text}, thanks"
        assert [c for c in new if c in "_-="] == [c for c in text if c in "_-="]
    assert there.apply(secrets[0])[0][8:] == there.apply(secrets[1])[0][10:]
    new, kinds = there.apply("on 2021/03/04 and 2021-03-04")
    assert kinds == ["date", "date"] and new[3:13].replace("/", "-") == new[18:] != "2021-03-04" and back.apply(new)[0] == "on 2021/03/04 and 2021-03-04"
    for text in ("Password: short", "the token is here", "a secret = no"):
        assert there.apply(text) == (text, [])


def brute_pseudonyms(texts, key):
    """Values found by the forms one after the other, each replaced by itself: the longest first match from the left."""
    names, out = pii.Pseudonyms(key), []
    for text in texts:
        at, made, kinds = 0, "", []
        while text and at < len(text):
            found = [(k, m) for k, p in pii._FORMS if (m := re.compile(p).match(text, at))]
            new = names._in_script(found[0][0], found[0][1][0]) if found else None
            if found:
                made += found[0][1][0] if new is None else new
                kinds += [] if new is None else [{"iso_date": "date", "intl_phone": "phone"}.get(found[0][0], found[0][0])]
                at = found[0][1].end()
            else:
                made, at = made + text[at], at + 1
        out.append((made if text else text, kinds))
    return out


def test_pseudonyms_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["a.b@mail.example.com", "+1 (677) 555-7033", "4961143020124266", "80.122.231.226", "2021-03-04", "2021/03/04", "03/04/2021", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "token=abcd1234efgh", "Password: ABCD-1234_x", "+44 20 7946 0958", "1234", "999.1.1.1", "word", ",", "é", "٣٤"]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(12)) for _ in range(80)] + [None, ""]
    got = {r.doc_id: (r.text, r.kinds) for r in pii.pseudonymized(docs_of(spark, texts), "key").collect()}
    assert got == dict(enumerate(brute_pseudonyms(texts, "key")))


def test_dates_in_every_form():
    """One pseudonym for a day in all forms, in the same form, read the same way, undone; different days stay apart."""
    import datetime

    there, back = pii.Pseudonyms("k"), pii.Pseudonyms("k", back=True)
    seen = {}
    for n in range(datetime.date(1999, 1, 1).toordinal(), datetime.date(2005, 1, 1).toordinal()):
        d = datetime.date.fromordinal(n)
        forms = {d.isoformat(): "%Y-%m-%d", d.strftime("%d.%m.%Y"): "%d.%m.%Y", d.strftime("%m/%d/%Y"): "%m/%d/%Y", f"{d.day}.{d.month}.{d.year}": "%d.%m.%Y", f"{d.month}/{d.day}/{d.year}": "%m/%d/%Y"}
        if d.day > 12:
            forms[d.strftime("%d/%m/%Y")] = "%d/%m/%Y"
        made = set()
        for text, form in forms.items():
            new, kinds = there.apply(f"on {text}, noon")
            new = new[3:-6]
            assert kinds == ["date"] and back.apply(new)[0] == text and [len(x) for x in re.split("[-./]", new)] == [len(x) for x in re.split("[-./]", text)]
            made.add(datetime.datetime.strptime(new, form).date())
        assert len(made) == 1
        seen.setdefault(made.pop(), d)
    assert len(seen) == n - datetime.date(1999, 1, 1).toordinal() + 1
    assert there.apply("31/04/2001 30.02.2000 2100-01-01 version 1.2.3.4 +999 12 345 678")[1] == ["phone"] and there.apply("+800 12 345 678")[1] == []


@pytest.mark.parametrize("zero", ["\u0660", "\u0966", "\uff10"])
def test_pseudonyms_in_other_digits(spark, zero):
    """Values in Arabic, Devanagari and full-width digits are replaced in their script, as the same numbers."""
    script = lambda t: re.sub("[0-9]", lambda m: chr(ord(zero) + int(m[0])), t)
    there, back = pii.Pseudonyms("k"), pii.Pseudonyms("k", back=True)
    values = ["4961143020124266", "4961 1430 2012 4266", "(677) 555-7033", "+1 (677) 555-7033", "123-45-6789", "2021-03-04", "31/12/1999", "80.122.231.226", "+44 20 7946 0958", "GB82 WEST 1234 5698 7654 32"]
    for v in values:
        new, kinds = there.apply(script(v))
        assert len(kinds) == 1 and new == script(there.apply(v)[0]) != script(v) and back.apply(new)[0] == script(v)
    bad = f"1 a@b {script('1234567890123456')} {script('999.1.1.1')} {script('000-45-6789')} {script('(077) 555-7033')}"
    assert there.apply(bad) == (bad, [])
    assert there.apply("x\u00b2 y@example.com")[1] == ["email"]
    got = pii.pseudonymized(docs_of(spark, [bad, f"at 1: {script(values[0])}"]), "k").orderBy("doc_id").collect()
    assert [r.kinds for r in got] == [[], ["card"]]


# 8 quality rules
def test_statistics_and_rules(spark):
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab  \n\x0b\x85 #é") for _ in range(rng.randint(0, 200)))
        w, seen, hit = re.findall(r"[^\x20\x09-\x0D]+", t), {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for v in seen.values():
            hit |= {k for i in v if len(v) > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert decision_list.statistics(t)[:5] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)]
    x = np.random.default_rng(0).random((600, 2))
    rules = decision_list.learn(x, ~((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)), ["n_words", "symbol_share"])
    assert rules and all(not r.verdict for r in rules) and {f for f, _, _ in rules[0].conditions} == {"n_words", "symbol_share"}
    lab = spark.read.parquet(f"{DATA}/labels.parquet")
    got = decision_list.quality_rules(docs_of(spark, ODD), lab).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got)
    assert decision_list.quality_rules(docs_of(spark, []).limit(0), lab).count() == 0


# 9 sharding
def test_permutation():
    for n in (1, 2, 5, 100, 1000):
        p = permute(np.arange(n), n, round_keys("a"))
        assert sorted(p.tolist()) == list(range(n)) and permute(p, n, round_keys("a"), back=True).tolist() == list(range(n))


def test_shards(spark):
    texts = [*ODD, *(["hot"] * 40)]
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("text") == "hot", 7).otherwise(F.col("doc_id")))
    got = sharding.shard_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert sharding.row_of(r.shard, r.slot, len(texts), 8, "shuffle") == r.row_number
    assert len(got) == len(texts) and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.size, r.text_crc32) for r in got} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts}
    assert sharding.shard_documents(docs_of(spark, []).limit(0)).count() == 0
    taken = docs.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "_tie": F.lit(0), "_local": F.lit(1), "row_number": F.lit(2)})
    placed = sharding.shuffle_into_shards(taken, ["doc_id"], 3, "k")
    assert sorted(r.slot for r in placed.where("shard = 0").collect()) == list(range(-(-len(texts) // 3))) and set(taken.columns) == set(placed.columns)


# 10 near duplicates
def test_alignment():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.randint(0, 30) for _ in range(rng.randint(1, 50))]
        y = [v for v in x if rng.random() > 0.05] + [rng.randint(0, 40) for _ in range(rng.randint(0, 3))]
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
        assert near_dup.aligned(np.array(x), np.array(y, int), 100) == d[-1][-1]


def test_near_duplicates(spark):
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(500)]
    base = [[rng.choice(vocab) for _ in range(150)] for _ in range(6)]
    texts = [" ".join(w if rng.random() > rate else rng.choice(vocab) for w in rng.choice(base)) for rate in [0, 0.005, 0.01, 0.02, 0.05, 0.3] * 15] + ODD
    names = [near_dup.shingles(np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", (t or "").lower())], np.uint32)) for t in texts]
    keys = [" ".join(re.findall(r"\w+", (t or "").lower())) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if keys[i] == keys[j] or len(names[i]) and len(names[j]) and near_dup.compare(names[i], names[j])[0] == 0:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs_of(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    kept = {r.doc_id for r in near_dup.one_of_each(docs_of(spark, texts)).collect()}
    assert kept == set(got.values())
    assert near_dup.near_duplicate_classes(docs_of(spark, []).limit(0)).count() == 0


def shingles_of(text):
    return near_dup.shingles(np.array([zlib.crc32(w.encode()) for w in text.split()], np.uint32))


def brute_classes(texts):
    names, up = [shingles_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if min(len(names[i]), len(names[j])) >= 0.8 * max(len(names[i]), len(names[j])) and near_dup.compare(names[i], names[j])[0] == 0:
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    return up


def test_short_texts_meet(spark):
    """Texts of 5 to 110 words: classes as by brute force, whatever words differ."""
    rng = random.Random(11)
    texts = []
    for n in [*range(5, 31), *range(31, 111, 5)]:
        for _ in range(4):
            x = ["w%d" % rng.randrange(300) for _ in range(n)]
            y = x[rng.randint(0, 1 + n // 12) : n - rng.randint(0, n // 12)] + ["new"] * rng.randint(0, 1 + n // 12)
            texts += [" ".join(x), " ".join([*x, "end"]), " ".join(["start", *x]), " ".join(x[1:]), " ".join(x[:-1]), " ".join(y)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_classes(texts)))


def test_one_common_sketch_in_a_large_bucket(spark):
    """A pair that shares one sketch only is found, however many other texts share it."""
    rng = random.Random(13)
    words = lambda n: ["w%d" % rng.randrange(5000) for _ in range(n)]
    while True:  # about one in three thousand of such pairs
        x = words(150)
        y = list(x)
        for i in (20, 65, 110):
            y[i] = "new%d" % i
        a, b = shingles_of(" ".join(x)), shingles_of(" ".join(y))
        common = set(near_dup.sketch(a)) & set(near_dup.sketch(b))
        if len(common) == 1 and near_dup.compare(a, b)[0] == 0:
            break
    seed = next(i for i, k in enumerate(near_dup.sketch(a)) if k in common)
    labelled = near_dup._labelled(a)
    minima = sorted(np.argsort(near_dup._mix(labelled ^ near_dup._SEEDS[seed]))[: near_dup.MINIMA])
    # other texts of the same minima, apart in all else
    others, tries = [], 0
    passages = [x[i : i + 5] for i in minima]
    while len(others) < near_dup.SMALL + 4 and tries < 200_000:
        tries += 1
        t = " ".join(w for p in passages for w in [*p, *words(12)])
        if near_dup.sketch(shingles_of(t))[seed] in common:
            others.append(t)
    assert len(others) == near_dup.SMALL + 4
    texts = [" ".join(x), " ".join(y), *others]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_classes(texts))) and got[1] == 0


@pytest.mark.parametrize("small", [12, 3])
def test_moved_passages_in_a_large_bucket(spark, monkeypatch, small):
    """Near copies of one text, some with moved passages: classes as by brute force, with few or many stars."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    rng = random.Random(17)
    base = ["w%d" % rng.randrange(900) for _ in range(120)]
    vary = lambda w, rate=0.012: " ".join("v%d" % rng.randrange(900) if rng.random() < rate else x for x in w)
    texts = [vary(base) for _ in range(60)] + [vary(base[60:] + base[:60]) for _ in range(8)] + [vary(base[30:60] + base[:30] + base[60:]) for _ in range(3)]
    texts += [vary(base, 0.04) for _ in range(20)] + [t + " v1 v2" for t in texts[:3]]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_classes(texts))) and len(set(got.values())) > 1


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert set(docs.columns) < set(out.columns) and 0 < out.count() < docs.count()
    assert out.groupBy("doc_id").count().where("count > 1").count() == 0
    r = out.first()
    by_hand = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        by_hand = stage(spark, by_hand, DATA)
    assert {(x.doc_id, x.text) for x in by_hand.select("doc_id", "text").collect()} == {(x.doc_id, x.text) for x in out.select("doc_id", "text").collect()}
    assert len(r.ids) == r.n_tokens and hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """An empty table gives an empty table; clashing columns stay, and nulls and repeated rows pass through."""
    import corpus_pipeline

    for k, docs in (("none", docs_of(spark, []).limit(0)), ("odd", docs_of(spark, [*ODD, "good words of a text that is long enough to stay " * 3]).unionByName(docs_of(spark, ODD)))):
        docs.withColumns({"kinds": F.lit(1), "tails": F.lit("t"), "spans": F.lit(2), "items": F.lit("i"), "_at": F.lit(3), "n_words": F.lit(4)}).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{name}.parquet").limit(0 if k == "none" else 1000).write.parquet(f"{tmp_path}/{k}/{name}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        before = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert set(before.columns) <= set(out.columns) and out.count() <= before.count() and (k != "none" or out.count() == 0)


def test_pseudonyms_of_no_rows(spark):
    assert pii.pseudonymized(docs_of(spark, []).limit(0), "k").count() == 0
