"""Fill-in-middle against a cut by regular expressions, and its exact round trip."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lexiforge.llm import fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+"}


def by_pattern(text, doc_id, unit, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    made = ["", None, "\n", "\n\n", "a", "a\n", "a\nb", " a", "<P>", "x<S\n>y<M", "tail <", "<S", "end<P\n<M", "é\n漢字\n😀\r\nz", "\r", " \n \n", "$1\n\\1\n", "a.b|c\n(d)"]
    made += ["".join(rng.choice(["a", " ", "\n", "é", "😀", "<", "S>", "\t", "bc "]) for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    return made + ["word 漢\n" * 50_000, "x" * 300_000]


def test_bits():
    for text in texts():
        data = (text or "").encode()
        for unit, pattern in UNITS.items():
            at = [len((text or "")[: m.start()].encode()) for m in re.finditer(pattern, text or "")]
            starts = fim.unit_starts(data, unit)
            assert starts.bit_count() == len(at)
            for k in range(0, len(at), 1 + len(at) // 50):
                assert fim.ranked_bit(starts, len(data), k) == at[k]


def test_against_patterns(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(3, "b\nc\n"), (3, "b\nc\n"), (None, "q\nr\ns")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(5)
    for unit, rate, spm in (("line", 100, 50), ("word", 60, 20)):
        out = fim.fill_in_middle(docs, unit=unit, rate=rate, spm=spm).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        want = sorted(((i, *by_pattern(t, i, unit, rate, spm), t or "") for i, t in rows), key=repr)
        assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_empty_table_and_marks(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "text string, doc_id int")).count() == 0
    docs = spark.createDataFrame([(k, f"a{k}\nb<P>\nc\n") for k in range(20)], "doc_id long, text string")
    out = fim.fill_in_middle(docs, marks=("[[1]]", "[[2]]", "[[3]]")).withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[[1]]", "[[2]]", "[[3]]")))
    rows = out.collect()
    assert all(r.form != "plain" and r.back == f"a{r.doc_id}\nb<P>\nc\n" and r.output.startswith("[[") for r in rows)
