"""The ten operators against brute force, round trips and edge cases, on small tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import ann, bytebpe, license_scan, line_dedup, ngram_join, packing, quality, sharding, sp_codec, span_dedup, topk
from lexiforge.llm.queries import BYTE_BPE, PIECES, tokenizer

DOCS = "doc_id long, text string, size string, part string, shard string, hash string"


def docs_of(spark, texts, ids=None):
    """Texts as documents, with further columns whose names the operators use themselves."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "s", "p", "x", "h") for i, t in zip(ids, texts)], DOCS)


EDGE = ["", None, "  \n ", "one", "x" * 5000, "a b c d e f g " * 700, "same text here today\nand a second line of it", "same text here today\nand a second line of it"]


def components_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 90))) for _ in range(n)]
    for base in range(0, n, 6):  # near copies, of several distances
        for edits in (1, 2, 4, 8):
            w = out[base].split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out + EDGE


# ------------------------------------------------------------------ 1: lines


def edit_distance(s, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randint(5, 60))).strip() or "z" for _ in range(40)]
    texts = []
    for _ in range(40):
        rows = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            rows.append(rng.choice(["", " "]) + "".join(s))
        texts.append("\n".join(rows))
    texts += EDGE
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    seen = [(i, k, x.strip()) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    names = sorted({x for _, _, x in seen})
    most = lambda a, b: (min(len(a), len(b)) >= 12) + (min(len(a), len(b)) >= 30)
    near = [(a, b) for a, b in itertools.combinations(names, 2) if 0 < most(a, b) >= abs(len(a) - len(b)) and edit_distance(a, b) <= most(a, b)]
    assert sum(min(len(a), len(b)) < 30 for a, b in near) > 5
    assert len(near) > 5
    root = components_of(near, names)
    first = {}
    for i, k, x in seen:
        first.setdefault(root[x], (i, k))
    for i, t in enumerate(texts):
        gone = {k for j, k, x in seen if j == i and first[root[x]] < (j, k)}
        lines = (t or "").split("\n")
        want = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert got[i] == (sum(j == i for j, _, _ in seen), len(gone), want)


def test_band_and_segments():
    rng = random.Random(2)
    pairs = []
    for _ in range(600):
        s = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        t = list(s)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append(("".join(s), "".join(t)))
    for k in (1, 2, 3):
        assert line_dedup.within([s for s, _ in pairs], [t for _, t in pairs], k).tolist() == [edit_distance(s, t) <= k for s, t in pairs]


# ------------------------------------------------------------------ 2 and 6: vectors


def vectors(spark, seed=0, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:80] = x[40] + 0.01 * rng.normal(size=(30, d)).astype(np.float32)
    x[100:125] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [float("nan")] * d), (1002, [None] * d), (1020, [float("inf")] * d), (None, rows[3][1]), (1040, [])]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit("z"), "part": F.lit(0)})


def test_exact_top_k(spark):
    x, df = vectors(spark)
    q = np.floor(256 * x)
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = {}
    for i in range(0, len(x), 50):
        s = (q @ q[i]).astype(int)
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:5]
        want[i] = [(j, s[j]) for j in order]
    assert dict(got) == want
    assert topk.exact_top_k(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert [r.rank for r in topk.exact_top_k(few).orderBy("rank").collect()] == [1, 2]


def test_nearest(spark):
    x, df = vectors(spark, 1)
    found = collections.defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for i in range(0, len(x), 20):
        s = x @ x[i]
        best = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:20]
        assert len(found[i]) == 20 and i not in dict(found[i])
        assert all(abs(v - s[j]) < 1e-12 for j, v in found[i])
        hit += len(set(best) & {j for j, _ in found[i]})
        total += 20
    assert hit / total >= 0.95
    assert [j for j, _ in found[0][:20]] == list(range(100, 120))  # copies, smallest ids first
    assert ann.nearest(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 3: licences


def test_licences(spark):
    texts = ["words of no kind\nReleased under the MIT License.\nmore words", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "the license plate of the car was lost", "All rights reserved.", *EDGE]
    texts += ["some plain words stand here again and again"] * 20
    rows = {r.doc_id: [f.family for f in r.found] for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert [rows[i] for i in range(5)] == [["mit"], ["gpl"], ["apache-2.0"], [], ["proprietary"]]
    assert not any(rows[i] for i in range(5, len(texts))) and len(rows) == len(texts)


def test_licence_held_out():
    model = license_scan.fit(["a plain paragraph of words", "another one about the weather"] * 40)
    kept = ["Code is released under an MIT license today", "you may not use this file except in compliance with the Apache License", "redistribute it under the GNU General Public License version 2"]
    found = []
    for b in license_scan._bags(kept):
        p = model.probabilities(b, np.array([0, len(b)]))
        found.append(license_scan.FAMILIES[int(p.argmax())])
    assert found == ["mit", "apache-2.0", "gpl"]


# ------------------------------------------------------------------ 4: pieces


def best_score(codec, sp, text):
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - codec.longest), end):
            i = sp.piece_to_id(text[start:end])
            ok = not (sp.is_unknown(i) or sp.is_byte(i) or sp.is_control(i))
            value = sp.get_score(i) if ok else (codec.unknown if end - start == 1 else -np.inf)
            best[end] = max(best[end], best[start] + value)
    return best[-1]


def test_pieces(spark):
    import sentencepiece

    path = tokenizer(PIECES)
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.Codec(path)
    texts = ["The  theory of\tthings\n\nand é中\U0001f600 z ", "▁a▁ b", " ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", *[t or "" for t in corpus(3)[:40]]]
    for t, ids in zip(texts, codec.encode(texts)):
        assert codec.decode(ids) == t.replace("▁", " ")
        score, plain, spelt = 0.0, sp_codec.MARK + t.replace(" ", sp_codec.MARK), b""
        for i in map(int, ids):
            if sp.is_byte(i):
                spelt += codec.bytes[i]
            else:
                score += sp.get_score(i)
        score += codec.unknown * len(spelt.decode("utf-8"))
        assert score == (best_score(codec, sp, plain) if t else 0)
    out = {r.doc_id: r for r in sp_codec.digests(docs_of(spark, EDGE), path).collect()}
    assert all(r.round_trip for r in out.values()) and out[1].n_ids == 0
    back = sp_codec.decode_documents(sp_codec.encode_documents(docs_of(spark, EDGE), path), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(EDGE)}


# ------------------------------------------------------------------ 5: quality


def test_quality(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(5, 300))) + "." for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(rng.randint(5, 300))) for _ in range(150)]
    docs = docs_of(spark, [t for p in zip(good, bad) for t in p] + EDGE)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 300 + len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) / len(held) >= 0.95
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.N_FEATURES)).astype(np.float32) for k in (1, 3, 2, 5) * 20]
    label = np.array([float(b[:, 0].max() > 0.8) for b in bags])  # one passage decides
    model = quality.fit(bags, label, rounds=120)
    p = model.scores(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]))
    assert ((p > 0.5) == label).mean() > 0.95


# ------------------------------------------------------------------ 7: shingles


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_components(spark, n, percent):
    texts = [*corpus(n), "One Two", "one two", "one TWO three"]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components_of(links, range(len(texts)))
    df = docs_of(spark, [*texts, "x y z"], [*range(len(texts)), None])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, n, percent).collect()}
    assert len(links) > 5 and got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_ngram_empty(spark):
    assert ngram_join.ngram_components(docs_of(spark, ["a"]).limit(0)).count() == 0


# ------------------------------------------------------------------ 8: spans


def test_spans(spark):
    rng = random.Random(8)
    sentence = lambda k: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(k)).capitalize() + "."
    passage = " ".join(sentence(rng.randint(4, 12)) for _ in range(8))
    one = sentence(60)  # a passage of one sentence
    texts = [f"{sentence(9)} {passage} {sentence(7)}", f"{sentence(8)}\n{passage}\n{sentence(6)}", f"{sentence(5)} {one}", f"{one} {sentence(9)}", sentence(30), *EDGE, passage]
    rows = {r.doc_id: r for r in span_dedup.dedup_spans(docs_of(spark, texts)).collect()}
    assert rows[0].text == texts[0] and rows[2].text == texts[2] and rows[4].text == texts[4]
    assert passage[:60] not in rows[1].text and passage[-60:] not in rows[1].text and rows[1].n_removed > 0
    assert texts[1].split("\n")[0] in rows[1].text and texts[1].split("\n")[2] in rows[1].text
    assert one[:40] not in rows[3].text and rows[len(texts) - 1].text == ""
    assert rows[6].text is None and rows[5].text == "" and len(rows) == len(texts)
    assert span_dedup.dedup_spans(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_spans_without_ascii_stops(spark):
    """Copies behind other words of an unpunctuated, a quoted and an unspaced text."""
    rng = random.Random(81)
    some = lambda k: ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(k)]
    long, quoted = " ".join(some(500)), " ".join(f"\u201c{' '.join(some(k % 7 + 5))}.\u201d" for k in range(40))
    unspaced = "".join(chr(0x4E00 + rng.randrange(3000)) + ("\u3002" if k % 15 == 14 else "") for k in range(300))
    period = "u v w x y " * 60
    texts = [f"{' '.join(some(k))} {t} {' '.join(some(5))}" for t in (long, quoted, unspaced, period) for k in (3, 7)] + ["\u4eca\u5929\u5929\u6c14\u5f88\u597d\u3002" * 60] * 2
    rows = {r.doc_id: r for r in span_dedup.dedup_spans(docs_of(spark, texts)).collect()}
    for k in (0, 2, 4):
        assert rows[k].text == texts[k] and len(rows[k + 1].text) < 0.25 * len(texts[k + 1])  # a sentence behind other words stays
        assert texts[k + 1][:8] == rows[k + 1].text[:8]
    assert len(rows[7].text) < 0.2 * len(texts[7]) and rows[9].text == ""


def test_spans_against_brute_force(spark):
    """Runs by plain Python: removed units are those that a non-first repeated run covers."""
    rng = random.Random(80)
    pool = [" ".join("".join(rng.choice("abc") for _ in range(2)) for _ in range(rng.randint(1, 14))) + "." for _ in range(25)]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(60)]
    runs, units = collections.defaultdict(list), []
    for i, t in enumerate(texts):
        u = [p[k : k + 10] for p in (s.split() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()) for k in range(0, len(p), 10)]
        units.append(u)
        found = set()
        for a in range(len(u)):
            z = next((z for z in range(a + 1, len(u)) if sum(map(len, u[a : z + 1])) >= 20), None)
            if z is not None:
                found.add((a, z))
            b = next((b for b in range(a - 1, -1, -1) if sum(map(len, u[b : a + 1])) >= 20), None)
            if b is not None:
                found.add((b, a))
        for a, z in found:
            runs[tuple(w for p in u[a : z + 1] for w in p)].append((i, a, z))
    gone = collections.defaultdict(set)
    for places in runs.values():
        first = min((i, a) for i, a, _ in places)
        for i, a, z in places:
            if (i, a) > first:
                gone[i] |= set(range(a, z + 1))
    got = {r.doc_id: (r.n_units, r.n_removed) for r in span_dedup.dedup_spans(docs_of(spark, texts), min_words=20).collect()}
    assert got == {i: (len(units[i]), len(gone[i])) for i in range(len(texts))} and sum(map(len, gone.values())) > 20


def test_spans_passages_against_brute_force(spark):
    """At the queries' own thresholds: runs of 20 words, joined and extended by equal words to 50."""
    rng = random.Random(82)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    sentence = lambda k: " ".join(word() for _ in range(k)) + "."
    texts = []
    for k in range(30):
        tail = " ".join(word() for _ in range(25)) + ". "  # the end of a sentence that begins otherwise
        core = " ".join(sentence(n) for n in ((17, 9), (9, 9), (12, 8, 9), (20, 20, 15), (14, 10))[k % 5])
        shared = tail + core if k % 2 else core
        texts += [f"{' '.join(word() for _ in range(k % 4 + 3))} {shared} {sentence(8)}", f"{' '.join(word() for _ in range(k % 3 + 30))} {shared} {sentence(9)}"]
    rows = {r.doc_id: r for r in span_dedup.dedup_spans(docs_of(spark, texts), passage=span_dedup.PASSAGE).collect()}
    seen, repeats = set(), set()
    for i, t in enumerate(texts):
        w = t.split()
        windows = {tuple(w[a : a + 50]) for a in range(len(w) - 49)}
        if windows & seen:
            repeats.add(i)
        seen |= windows
    assert {i for i, r in rows.items() if r.n_removed} == repeats and 10 < len(repeats) < 25
    assert all(r.text == texts[i] for i, r in rows.items() if i not in repeats)


# ------------------------------------------------------------------ 9: shards


def test_shards(spark):
    rng = random.Random(9)
    texts = ["x " * rng.randint(1, 60) + str(i) for i in range(600)] + ["hot text of many copies"] * 400 + EDGE
    df = docs_of(spark, texts)
    rows = sharding.shard_documents(df, shards=6).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 6
    assert max(size.values()) - min(size.values()) < 0.05 * sum(size.values()) / 6 + 10_000 / 6 * 2
    where = collections.defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if t != "hot text of many copies")
    again = {r.doc_id: r.shard for r in sharding.shard_documents(df.repartition(7), shards=6).collect()}
    assert again == {r.doc_id: r.shard for r in rows}
    assert sharding.shard_documents(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 10: packing


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer(BYTE_BPE)
    own = Tokenizer.from_file(path)
    texts = [*corpus(10), "a<|endoftext|>b"]
    rows = packing.pack_documents(docs_of(spark, texts), path, room=64).collect()
    tokens = [[*own.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    place, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        place[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        ids = np.array(tokens[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(tokens[r.doc_id])
    for parts, sum_to in [(place[i], len(tokens[i])) for i in range(len(texts))]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == sum_to
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack_documents(docs_of(spark, ["a"]).limit(0), path).count() == 0


def test_tokens_equal_the_files_own():
    from tokenizers import Tokenizer

    path = tokenizer(BYTE_BPE)
    own, coder = Tokenizer.from_file(path), bytebpe.Coder(path)
    texts = ["don't  we're\n\n x's 's '' '''s  \t a", " ", "\n \n", "x  ", "12ab _-", "I'LL 'd'm é z", "", "'s", "a's", "'re", "'r", "we'", "we'v", "x 's", "x\n's", "''s", "'s's", " a", "中文 \U0001f600", *[t or "" for t in corpus(11)]]
    for t, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == own.encode(t, add_special_tokens=False).ids


def test_cutting_stock():
    rng = np.random.default_rng(5)
    for size in (np.arange(1, 22), np.arange(1, 64), np.array([63, 40, 3]), np.array([33])):
        demand = rng.integers(1, 300, len(size)).astype(float)
        plan = packing.cutting_stock(size, demand, 64)
        assert (sum(p * n for p, n in plan) == demand).all() and all((p * size).sum() <= 64 for p, _ in plan)
        if size.max() < 22:
            assert sum(n for _, n in plan) <= 1.01 * (size * demand).sum() / 64 + 2
    size, demand = np.array([30, 22, 12, 10]), np.array([60.0, 60.0, 60.0, 60.0])  # first-fit alone takes more
    assert sum(n for _, n in packing.cutting_stock(size, demand, 64)) <= 72
    assert packing.cutting_stock(np.zeros(0, int), np.zeros(0), 64) == []


# ------------------------------------------------------------------ shared


def test_components(spark):
    from lexiforge.llm.common import components

    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(200)]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert {r.id: r.component for r in components(df).collect()} == components_of(links, nodes)
    assert components(df.limit(0)).count() == 0


def test_oracle_and_names():
    import __spark_entry__ as e

    names = [k for k in e.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names) == list(range(1, 11)) and "pipeline" in e.queries()
