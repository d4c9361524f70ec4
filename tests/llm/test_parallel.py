"""The operators over many small parts, shards, buckets and blocks, and at their edges, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import EDGE, corpus, docs_of, vectors

from lexiforge.llm import ann, license_scan, line_dedup, ngram_join, packing, quality, sharding, sp_codec, span_dedup, topk
from lexiforge.llm.queries import BYTE_BPE, PIECES, tokenizer


# ------------------------------------------------------------------ 2 and 6


def test_top_k_over_parts_and_blocks(spark):
    x, df = vectors(spark)
    q = np.floor(256 * x)
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(df, k=5, every=10, part=90, block=7).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i in range(0, len(x), 10):
        score = (q @ q[i]).astype(int)
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-score[j], j))[:5]
        assert sorted(got[i]) == [(k, j, score[j]) for k, j in enumerate(order, 1)]
    assert len(got) == 40


def test_top_k_beyond_doubles(spark):
    rows = [(i, [float(2**28 + i * 3), 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in topk.exact_top_k(df, k=5, every=5, scale=4.0).collect():
        a, b = (int(4 * rows[k][1][0]) for k in (r.query_id, r.vec_id))
        assert r.score == a * b + 16
    with pytest.raises(Exception, match="long"):
        topk.exact_top_k(spark.createDataFrame([(0, [1e10]), (1, [1e10])], df.schema), k=1, every=2).collect()
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_nearest_over_shards(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(20, [0.5] * 24)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, k=20, every=20, shard=300, block=30).collect()
    x = x.astype(float)
    x[20] = min(x[20].tolist(), [0.5] * 24)
    hit = 0
    for i in range(0, 1500, 20):
        score = x @ x[i]
        score[i] = -np.inf
        best = set(np.argsort(-score)[:20].tolist())
        mine = [r for r in rows if r.query_id == i]
        assert [r.rank for r in sorted(mine, key=lambda r: r.rank)] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in mine)
        hit += len(best & {r.vec_id for r in mine})
    assert hit / (75 * 20) >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 1, 7, 8


def test_lines_of_odd_rows(spark):
    rng = random.Random(5)
    long = "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(8)) for i in range(20_000))
    texts = [long, long, "x" * 1_000_000, None, "a line given twice here\nanother line", "a line given twice here\nanother line"]
    df = docs_of(spark, [*texts, "a line given twice here"], [0, 1, 2, 3, 7, 7, None])
    rows = line_dedup.dedup_lines(df).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_lines, r.n_removed, r.text))
    assert by[1] == [(20_000, 20_000, "")] and by[0][0][1] == 0 and by[2] == [(1, 0, "x" * 1_000_000)] and by[3] == [(0, 0, None)]
    assert by[None] == [(0, 0, "a line given twice here")] and by[7] == [(2, 0, texts[4])] * 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_ids_of_several_texts_keep_their_links(spark):
    a, b, c = ("%s one two three four five six seven eight nine ten" % w for w in ("alpha beta gamma", "delta epsilon zeta", "eta theta iota"))
    df = docs_of(spark, [a, b, a, b, "", c, c], [1, 1, 3, 4, 5, 5, 6])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df, 4, 85).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_spans_of_odd_rows(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    passage = ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(10)) + "."
    own = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    texts = [own(30) + " " + passage, own(9) + " " + passage + " " + own(12), None, "", own(150_000), passage]
    df = docs_of(spark, texts, [0, 1, 2, 3, 4, None])
    rows = {r.doc_id: r for r in span_dedup.dedup_spans(df, passage=span_dedup.PASSAGE).collect()}
    assert rows[0].n_removed == 0 and rows[4].n_removed == 0 and rows[4].text == texts[4] and rows[4].n_units > 5000
    assert rows[1].n_removed >= 10 and passage[:200] not in rows[1].text
    assert (rows[2].text, rows[2].n_units, rows[3].text, rows[3].n_units) == (None, 0, "", 0)
    assert (rows[None].text, rows[None].n_removed) == (passage, 0)


# ------------------------------------------------------------------ 3


def test_licence_lines_of_wrapped_notices(spark):
    wrapped = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\n"
               "in the Software without restriction, including without limitation the rights")
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    hard = ["the license plate of the car was lost", "she had permission to copy the text and no restriction", "software of any kind is a public matter", "he reserved all the rooms on the right"]
    texts = [wrapped, gpl, "MIT License", "SPDX-License-Identifier: MIT", "Published under the GPL v3.", *hard, *["some plain words stand here again and again"] * 30]
    rows = {r.doc_id: [f.family for f in r.found] for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert set(rows[0]) == {"mit"} and len(rows[0]) >= 2 and set(rows[1]) == {"gpl"} and len(rows[1]) >= 2
    assert [rows[i] for i in range(2, 5)] == [["mit"], ["mit"], ["gpl"]] and not any(rows[i] for i in range(5, len(texts)))


def test_licence_scan_against_brute_force(spark):
    """Every paragraph of every text, alone, gives what the scan says of it."""
    texts = ["plain words here\n\nReleased under the MIT License.\nmore plain words", "All rights reserved.\nAll rights reserved.", *[t for t in EDGE if t]]
    df = docs_of(spark, texts)
    model = license_scan.fit(license_scan._plain_paragraphs(df, 3000, "text"))
    for r in license_scan.scan_licenses(df).collect():
        want, count = [], 0
        for line, t in enumerate(texts[r.doc_id].split("\n")):
            bag = license_scan._bags([t])[0]
            if len(bag):
                count += 1
                p = model.probabilities(bag, np.array([0, len(bag)]))[0]
                k = int(p.argmax())
                if k and p[k] >= 0.5 and model.likeness(k, bag) >= 0.5:
                    want.append((line, license_scan.FAMILIES[k]))
        assert r.n_paragraphs == count and [(f.paragraph, f.family) for f in r.found] == want


def test_licence_calibration_and_empty(spark):
    model = license_scan.fit(["a plain paragraph of words", "another one about the weather"] * 40)
    assert model.losses[model.temperature] == min(model.losses.values()) <= min(abs(t - 1) < 0.06 and x or 9 for t, x in model.losses.items())
    assert license_scan.scan_licenses(docs_of(spark, ["a"]).limit(0)).count() == 0
    row = license_scan.scan_licenses(docs_of(spark, ["word " * 200_000, None], [None, None])).collect()
    assert sorted(r.n_paragraphs for r in row) == [0, 1]


# ------------------------------------------------------------------ 4


def test_long_words():
    codec = sp_codec.Codec(tokenizer(PIECES))
    rng = random.Random(3)
    for word in ("".join(rng.choice("theandingé\U0001f600") for _ in range(700)), "x" * 900, "ab" * 400):
        cp = np.array([ord(c) for c in word], np.uint32)
        assert codec.long_word(cp).tolist() == codec.viterbi(cp[None, :])[0].tolist()
    text = "y" * 300_000 + " end"
    assert codec.decode(codec.encode([text])[0]) == text


def test_pieces_of_no_rows(spark):
    assert sp_codec.digests(docs_of(spark, ["a"]).limit(0), tokenizer(PIECES)).count() == 0


# ------------------------------------------------------------------ 5


def test_quality_scores_against_brute_force(spark):
    """Scores are those of passages cut by hand and a forward pass written out."""
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.N_FEATURES)).astype(np.float32) for k in (1, 3, 2, 5) * 10]
    model = quality.fit(bags, np.array([float(b[:, 0].max() > 0.8) for b in bags]), rounds=3)
    texts = [" ".join(f"w{i * k % 37}" for i in range(n)) for k, n in enumerate((1, 64, 65, 700), 3)] + EDGE
    rows = {r.doc_id: r.score for r in quality.score_quality(docs_of(spark, texts), model).collect()}
    a0, a, v, u, g, c, b = model.weights
    import pyarrow as pa

    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        own = [" ".join(w[k : k + quality.PASSAGE]) for k in range(0, max(len(w), 1), quality.PASSAGE)]
        if re.search(r"\s\s|\n", (t or "").strip()):
            continue  # cut by hand, white space would differ
        x = np.concatenate([f for _, f, _ in quality.passages(pa.array(own, pa.string()))])
        h = np.tanh((x - model.mean) / model.scale @ a + a0)
        e = np.array([(np.tanh(r @ v) / (1 + np.exp(-(r @ u)))) @ g for r in h])
        att = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert abs(rows[i] - 1 / (1 + np.exp(-((att @ h) @ c + b[0])))) < 1e-5


def test_quality_gradients_are_numeric_ones():
    rng = np.random.default_rng(1)
    x, bound, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    w = [rng.normal(size=s) * 0.5 for s in ((4,), (5, 4), (4, 3), (4, 3), (3,), (4,), (1,))]

    def loss(w):
        p = quality._forward(w, x, bound)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for p, g in zip(w, quality._gradients(w, x, bound, y)):
        for k in np.ndindex(p.shape):
            old, h = p[k], 1e-5
            p[k] = old + h
            up = loss(w)
            p[k] = old - h
            down = loss(w)
            p[k] = old
            assert abs((up - down) / (2 * h) - g[k]) < 1e-6


# ------------------------------------------------------------------ 9 and 10


def test_shards_over_buckets(spark):
    texts = [*corpus(5, 200), *["one text that a third of all rows hold"] * 150, *EDGE]
    df = docs_of(spark, texts)
    rows = sharding.shard_documents(df, shards=6, per_bucket=40, head=24, per_slot=9).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    size, count, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes")
        size[r.shard] += r.size
        count[r.shard] += 1
        groups[t].add(r.shard)
    for s in range(6):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    assert max(size.values()) <= 1.3 * min(size.values())  # of buckets of 40 items, on six shards
    assert all(len(g) == 1 for t, g in groups.items() if t and t != "one text that a third of all rows hold" and (len(t.encode()) + 8) * texts.count(t) < sum(size.values()) / 6 / 16)
    assert sharding.shard_documents(df.limit(0), shards=6).count() == 0


def test_sharding_places_by_hand(spark):
    """One bucket's items, placed one by one by the largest dot product with what is left."""
    rng = np.random.default_rng(8)
    import pandas as pd

    pdf = pd.DataFrame({"bucket": 0, "g1": rng.integers(0, 99, 40), "g2": range(40), "piece": 0, "bytes": rng.integers(1, 900, 40), "tokens": rng.integers(1, 90, 40), "rows": 1})
    got = sharding._place(np.full((5, 3), 0.2))(pdf)["shard"].tolist()
    v = pdf[["bytes", "tokens", "rows"]].to_numpy(float)
    v /= v.sum(0)
    room, want = np.full((5, 3), 0.2), [0] * 40
    for i in sorted(range(40), key=lambda i: (-v[i].max(), pdf.g1[i], pdf.g2[i])):
        want[i] = max(range(5), key=lambda s: (float(room[s] @ v[i]), -s))
        room[want[i]] -= v[i]
    assert got == want


@pytest.mark.parametrize(("room", "step", "per_part"), [(100, 8, 100_000), (64, 8, 20), (7, 8, 30), (101, 1, 50)])
def test_packing_keeps_every_token(spark, room, step, per_part):
    texts = [*corpus(6, 30), *EDGE]
    rows = packing.pack_documents(docs_of(spark, texts), tokenizer(BYTE_BPE), room=room, step=step, per_part=per_part).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == list(range(len(texts)))
    for p in pieces.values():
        at = 0
        for start, n, total in sorted(p):
            assert start == at
            at += n
        assert at == total
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= room
    assert sorted(sequences) == list(range(len(sequences)))
    tokens = sum(r.length for r in rows)
    if room >= 64:  # close to the fewest sequences that hold so many tokens, or that many tails of over half a room
        tails = [r.length for r in rows if r.length < room]
        least = max(-(-tokens // room), sum(r.length == room for r in rows) + sum(t > room // 2 for t in tails))
        assert len(sequences) <= 1.12 * least + 2


def test_packing_bound():
    """Never below the bound by volume, and within a few of it where sizes divide."""
    rng = np.random.default_rng(2)
    for room in (32, 50):
        size = np.arange(1, room)
        demand = rng.integers(0, 60, len(size)).astype(float)
        n = sum(k for _, k in packing.cutting_stock(size, demand, room))
        volume = -(-int((size * demand).sum()) // room)
        assert volume <= n <= volume + len(size) // 2 + 2
    assert packing.pack_documents is not None
