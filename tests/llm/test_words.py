"""Operators on words: near-duplicates, decontamination, licenses."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import components, decontam, license_scan, simhash

from .conftest import ODD, prose

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_scratch_tables(spark):
    from quarry.llm.common import materialize, release, scratch_dir

    df = materialize(spark.range(3).withColumn("x", F.lit(None).cast("string")), "some")
    assert df.count() == 3 and df.inputFiles()[0].removeprefix("file://").startswith(scratch_dir(spark))
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert release(spark) >= 1 and not os.path.exists(folder) and release(spark) == 0


# -- near-duplicates ------------------------------------------------------------------------


def plain_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [b" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(prints, bits=4):
    """Smallest id of each id's component."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_fingerprints_equal_plain_ones():
    texts = [t for _, t in ODD] + [prose(s, 3 + s * 40) for s in range(12)]
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert [int(x) for x in got] == [plain_print(t) for t in texts]


def test_groups_equal_plain_ones(odd, docs_of):
    base = prose(3, 400).split()
    near = [(100 + i, " ".join([*base[: 10 * i], "new", *base[10 * i :]])) for i in range(20)] + [(200 + i, prose(50 + i, 60)) for i in range(30)]
    rows = [r for r in ODD if r[0] is not None] + near
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    groups = plain_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert len(set(groups.values())) < len(groups) - 4
    assert simhash.near_duplicates(odd).count() == len(ODD)


@pytest.mark.parametrize("long_list", [4096, 2, 1])
def test_links_join_what_pairs_join(spark, long_list):
    draw = random.Random(long_list)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for c in centres for _ in range(12)} | {draw.getrandbits(64) for _ in range(60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), long_list)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    groups = plain_groups({p: p & (1 << 64) - 1 for p in signed})
    sizes = {}
    for p in signed:
        sizes.setdefault(groups[p], []).append(p)
    assert {p: groups[p] for own in sizes.values() if len(own) > 1 for p in own} == got


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    path = [(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(odd, docs_of):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    groups = plain_groups({i: plain_print(t) for i, t in ODD if i is not None})
    assert sorted(i for i in got if i is not None) == sorted(set(groups.values())) and got.count(None) == 1
    assert simhash.keep_one(docs_of([])).count() == 0
    assert simhash.keep_one(docs_of([(3, "x y z"), (None, "x y z"), (None, "q"), (None, "q")])).count() == 2


def test_unrelated_texts_of_one_id_stay(docs_of):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (2, prose(2, 80)), (3, prose(3, 80)), (3, prose(4, 80)), (3, prose(4, 80)), (4, prose(5, 80)), (4, prose(5, 80).upper()), (4, prose(5, 80))]
    kept = sorted((r["doc_id"], r["text"].lower()) for r in simhash.keep_one(docs_of(rows, key="k", root="r", gone_doc="g")).collect())
    assert kept == sorted([(1, prose(1, 80)), (2, prose(2, 80)), (3, prose(3, 80)), (3, prose(4, 80)), (4, prose(5, 80))])


# -- decontamination ------------------------------------------------------------------------


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))]


def plain_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2))
    return out


def items_and_docs():
    items = [(i, prose(700 + i, 12 + 5 * i)) for i in range(6)] + [(20, "Tiny ITEM"), (21, ""), (22, None), (None, prose(700, 12)), (23, prose(700, 12)), (24, "a b " * 9)]
    part = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs = [*ODD, (30, prose(1, 20) + " " + part(0, 0, 9) + ". " + prose(2, 9)), (31, part(1, 2, 9)), (32, part(1, 2, 10).upper() + "! " + part(3, 5, 19))]
    docs += [(33, "x tiny, item y"), (34, " ".join(items[5][1].split() * 3)), (35, "a b " * 30), (36, part(2, 0, 8) + " x " + part(2, 1, 9)), (37, "É " + part(4, 0, 8))]
    return items, docs


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_contamination_equals_plain(spark, docs_of):
    items, docs = items_and_docs()
    got = decontam.contamination(docs_of(docs, key="k", w="v", n_words="n"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_contamination(docs, items)
    assert rows_of(got) == sorted(map(repr, want))
    assert sum(r[5] for r in want) == 2 and {r[2] for r in want if r[0] == 31} == {0}


def test_words_do_not_depend_on_what_stands_beside_them(spark, docs_of):
    """Java lower-cases a capital sigma by its neighbours, and the Kelvin sign to an ASCII letter."""
    greek = "ΛΟΓΟΣ ΝΟΜΟΣ ΤΟΠΟΣ ΧΡΟΝΟΣ ΚΟΣΜΟΣ ΔΡΟΜΟΣ ΛΑΟΣ ΘΕΟΣ ΒΙΟΣ".split()
    items = [(1, " ".join(greek)), (2, "ΟΡΟΣ ΤΕΛΟΣ"), (3, "\u212a one \u0130 two three four five six")]
    docs = [(1, "x " + ".".join(greek) + ".y"), (2, "x ΟΡΟΣ:ΤΕΛΟΣ:y"), (3, "k one i two three four five six"), (4, "\u212a-ONE \u0130 two. Three four five six")]
    got = decontam.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_contamination(docs, items)
    assert [r[2:4] for r in want] == [(9, 1), (2, 1), (0, 0), (8, 1)]
    assert rows_of(got) == sorted(map(repr, want))


def test_shuffled_sides_give_the_same(spark, docs_of, monkeypatch):
    items, docs = items_and_docs()
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    got = decontam.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == sorted(map(repr, plain_contamination(docs, items)))


def test_empty_tables_of_contamination(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs_of([]), none).count() == 0
    assert rows_of(decontam.contamination(docs_of(ODD), none)) == sorted(map(repr, plain_contamination(ODD, [])))
    kept = decontam.keep_uncontaminated(docs_of(ODD, key="k"), none)
    assert kept.count() == len(ODD) and "key" in kept.columns


def test_contaminated_rows_go(spark, docs_of):
    items, docs = items_and_docs()
    docs = [*docs, (30, "another text of a known id"), (None, items[5][1] + " " + items[4][1])]
    bad = [repr(d) for d, r in zip(docs, plain_contamination(docs, items), strict=True) if r[5]]
    kept = decontam.keep_uncontaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(repr(d) for d in docs if repr(d) not in bad)


def test_stage_drops_documents_with_one_planted_item(spark, docs_of, tmp_path):
    import corpus_pipeline

    items, docs = items_and_docs()
    docs = [*docs, (50, prose(8, 30) + " " + items[3][1] + " " + prose(9, 30)), (51, prose(8, 60))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = plain_contamination(docs, items)
    assert [r[3] for r in hits if r[0] in (50, 51)] == [1, 0]
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs_of(docs), str(tmp_path))
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(repr(d) for d, r in zip(docs, hits, strict=True) if r[3] == 0)


def test_winnowing_keeps_a_hash_of_every_run(spark):
    row = spark.range(1).select(decontam.grams(F.split(F.lit(prose(5, 60)), " "), decontam.GRAM).alias("g")).select("g", decontam.winnowed(F.col("g")).alias("k")).collect()[0]
    run = decontam.WINDOW - decontam.GRAM + 1
    assert all(min(row["g"][i : i + run]) in row["k"] for i in range(len(row["g"]) - run + 1)) and len(row["k"]) < len(row["g"]) * 0.6


# -- licenses -------------------------------------------------------------------------------


def plain_base(text):
    w = words(text)
    hits = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


LICENSED = [
    (40, "x MIT-License. y mit license mit license", {"mit"}),
    (41, "Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
    (42, prose(4, 50) + " licensed under CC BY-NC 4.0. " + prose(5, 50), {"cc-by-nc"}),
    (43, "This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    (44, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}),
    (45, "the apache helicopter has a license; all rights are general, public and free", set()),
    (46, "cc by the way nc 4 0", set()),
    (47, "Licensed under the GNU Lesser General Public License", {"gpl", "lgpl"}),
    (48, dict(zip("ln", next(t[:2] for t in license_scan.TEMPLATES if t[0] == "bsd-2-clause"), strict=True))["n"].upper(), {"bsd-2-clause"}),
    (49, dict(zip("ln", next(t[:2] for t in license_scan.TEMPLATES if t[0] == "bsd-3-clause"), strict=True))["n"].replace("the copyright holder", "Acme Inc. of Anytown"), {"bsd-3-clause"}),
    (50, "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. pay", {"bsd"}),
    (51, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"gpl", "gpl-3.0-or-later"}),
    (52, "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"cc-by-nc-sa"}),
    (53, "Distributed under the Boost Software License, Version 1.0.", {"bsl-1.0"}),
]


def test_licenses(docs_of):
    rows = [*ODD, *[(i, t) for i, t, _ in LICENSED]]
    got = license_scan.scan_documents(docs_of(rows, labels="l", score="s")).collect()
    ours = sorted(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)
    assert ours == sorted(repr((i, *plain_base(t))) for i, t in rows)
    labels = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in got}
    assert all(labels[i] == want for i, _, want in LICENSED), {i: labels[i] for i, _, _ in LICENSED}
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert license_scan.scan_documents(docs_of([])).count() == 0


def test_index_finds_what_a_search_over_all_starts_finds():
    """Every start at which a template's rarest word would be in place, without the index."""
    index = license_scan.Index(license_scan.weights(10, {b"license": 9, b"the": 10, b"of": 8}))
    draw = np.random.default_rng(1)
    seen = 0
    for _ in range(150):
        label, own, _ = index.templates[draw.integers(len(index.templates))]
        before, after = (prose(int(draw.integers(1000)), int(draw.integers(0, 30))).encode().split() for _ in range(2))
        own = list(own)
        for _ in range(int(draw.integers(0, 4))):  # words put in, left out, or changed
            at = int(draw.integers(len(own)))
            own[at : at + int(draw.integers(0, 2))] = [b"acme", b"license"][: int(draw.integers(0, 3))]
        text = [*before, *own, *after]
        places = {w: [i for i, x in enumerate(text) if x == w] for w in set(text)}
        found, best = {}, 0.0
        for n, (name, notice, _) in enumerate(index.templates):
            for start in range(-len(notice), len(text)):
                if any(w == index.rare[n][0] and 0 <= start + p < len(text) and text[start + p] == w for p, w in enumerate(notice)):
                    if share := index.verified(n, text, places, start):
                        found.setdefault(name, []).append(start)
                        best = max(best, share)
        labels = {n for n, own in found.items() if any(not any(n in license_scan.SAYS_MORE.get(m, ()) and abs(s - t) <= 2 * license_scan.SLACK for m, others in found.items() for t in others) for s in own)}
        got, score = index.scan(text)
        assert got == labels and score == pytest.approx(min(best, 1.0))
        seen += bool(got)
    assert seen > 60


def test_base_columns_equal_sql(spark):
    import duckdb

    got = license_scan.scan_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    phrases = ", ".join(f"(['{"', '".join(p.split())}'], '{label}')" for p, label in license_scan.BASE)
    want = duckdb.sql(rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM '/root/testdata/sf0.01/documents.parquet'
), p AS (SELECT * FROM (VALUES {phrases}) AS v(phrase, label)),
hits AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) JOIN p ON w[i + 1:i + len(phrase)] = phrase)
SELECT d.doc_id, len(w), count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id, w""").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[2] for r in want) > 0
