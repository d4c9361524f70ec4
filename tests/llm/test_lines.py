"""Lines of texts taken together, against plain Python."""

import pyarrow as pa

from lexiforge.llm import line_dedup as L


def test_lines_of_texts_taken_together():
    texts = ["a\n\n b \n", "", "\n\n", " 　x、\n y \n z", "\x1c\x85 q\r\n\U0001F600 ab\U0001F600\n\n\nend", "x", "\n\nlast line"]
    cp, a, z, doc, line = L.split_lines(texts)
    whole = "".join(texts)
    want = [(d, i, x.strip()) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n")) if x.strip()]
    assert [(int(d), int(i), whole[x:y]) for x, y, d, i in zip(a, z, doc, line)] == want
    # Batches and runs of any size give the same hashes and second sums, wherever a line begins.
    rows = lambda n: [r for i in range(0, len(texts), n) for b in L._occurrences(iter([pa.record_batch({"i": pa.array(range(i, min(i + n, len(texts)))), "t": pa.array(texts[i : i + n])})])) for r in b.to_pylist()]
    both = {(d, i): t for d, i, t in want}
    sums = {(r["doc"], r["line"]): r["g"] for r in rows(7)}
    second = lambda t: (len(t) << 40) + sum(ord(c) * (1 + j % 2) for j, c in enumerate(t))
    assert rows(7) == rows(1) == rows(2) and sums == {k: second(t) for k, t in both.items()}


def test_entries_of_a_run_are_one_batch():
    got = list(L._entries(L.LENGTHS)(iter([pa.record_batch({"t": pa.array(["a line of words\nanother, much longer line of words", None])})])))
    assert len(got) == 1 and got[0].num_rows > 6
