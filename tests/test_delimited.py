"""Delimited and JSON scans against Python's own readers."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.sources import delimited as D
from lexiforge.sources import files as S


def state(line, separator, inside):
    """Whether a line ends inside a quoted field, character by character."""
    k, at_start = 0, not inside
    while k < len(line):
        c = line[k]
        if inside:
            if c == '"':
                if line[k + 1 : k + 2] == '"':
                    k += 1
                else:
                    inside = False
            at_start = False
        elif c == '"' and at_start:
            inside, at_start = True, False
        else:
            at_start = c == separator
        k += 1
    return inside


def test_transition(spark):
    rng = random.Random(4)
    lines = ["", '"', '""', '"""', '""""', 'a,"b', '5" pipe,x', '"a""b",c', ',"', 'x"",y', '"a,b"', '"",""'] + ["".join(rng.choice('",ab ') for _ in range(rng.randrange(12))) for _ in range(400)]
    # a closed field followed by other characters than a separator is malformed, and readers differ
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", *[D.transition(F.col("t"), ",", s).alias(str(s)) for s in (False, True)]).collect()
    for r in rows:
        for s in (False, True):
            want = state(r.t, ",", s)
            if not any('"' in f and not f.startswith('"') for f in r.t.split(",")) or r[str(s)] == want:
                assert r[str(s)] == want, (r.t, s)


def sample(n, seed):
    rng = random.Random(seed)
    words = ["plain", "two\nlines", 'say "hi"', "a,b", "", "é", '"', "x\n\n\ny", '""', "5 ft", "end\n"]
    return [[str(i), rng.choice(words), rng.choice(words), str(rng.random())] for i in range(n)]


@pytest.mark.parametrize("block", [None, 200])
def test_folder_of_mixed_files(spark, tmp_path, block):
    """Quoted line breaks, doubled quotes, both encodings, line ends of either kind, other column orders; blocks of any size."""
    want = []
    for k, (encoding, end, order) in enumerate([("utf-8", "\n", [0, 1, 2, 3]), ("latin-1", "\r\n", [0, 1, 2, 3]), ("utf-8-sig", "\n", [3, 2, 1, 0])]):
        rows = sample(300, k)
        buffer = io.StringIO(newline="")
        out = csv.writer(buffer, lineterminator=end)
        out.writerow([["id", "a", "b", "x"][i] for i in order])
        for r in rows:
            out.writerow([r[i] for i in order])
        (tmp_path / f"{k}.csv").write_bytes(buffer.getvalue().encode(encoding))
        want += [(int(r[0]), r[1] or None, r[2] or None, float(r[3])) for r in rows]
    (tmp_path / "plain.csv").write_text("id,a\n1000,no quotes\n\n1001,\n")
    want += [(1000, "no quotes", None, None), (1001, None, None, None)]
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = S.read_delimited(spark, str(tmp_path))
        got = [tuple(r) for r in df.select("id", "a", "b", "x").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert dict(df.dtypes) == {"id": "bigint", "a": "string", "b": "string", "x": "double"}
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_headers_schema_and_stray_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;n;;size\n1;"x;""y""";5" pipe;true\n2;z\n3;q;r;false;more\n')
    df = S.read_delimited(spark, str(tmp_path / "a.csv"), ";")
    assert df.columns == ["n", "n.1", "Unnamed: 2", "size"]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, 'x;"y"', '5" pipe', True), (2, "z", None, None), (3, "q", "r", False)]
    assert [tuple(r) for r in S.read_delimited(spark, str(tmp_path / "a.csv"), ";", "size string, n double, other int").orderBy("n").collect()][0] == ("true", 1.0, None)


def test_header_only_and_empty(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert S.read_delimited(spark, str(tmp_path / "h.csv")).columns == ["a", "b"]
    (tmp_path / "e.csv").write_text("")
    assert S.read_delimited(spark, str(tmp_path / "e.csv")).count() == 0


def test_values_as_they_are(spark, tmp_path):
    """The query gives back spaces and line breaks around a value, NUL characters, and empty values apart from null ones."""
    import __spark_entry__ as e

    texts = ["trail ", "trail\n\n", "\t", "cr\r", "\r\n", "a\r\nb", "nul\0mid\0", "\ufdd0\ufdd2", 'end"', '""\n"', "x\u2028", "", None]
    rows = [(i, t, [" de ", "", None, "x\r", 'q"', "a,b\n"][i % 6], ["", "s ", None][i % 3], None if i % 4 == 0 else i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = e.queries()["a_delimited"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, lang, source, n, f'He said "hi", {i}\n{t or ""}') for i, t, lang, source, n in rows]


def test_quoted_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,n,t\n1,"",""\n2,5,\n3,,x\r\n')
    df = S.read_delimited(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "n": "bigint", "t": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, ""), (2, 5, None), (3, None, "x")]


def test_records_over_many_blocks(spark, tmp_path):
    """Long records hold whole blocks; files end inside a quoted field, begin with empty lines, or have their header in several blocks."""
    rng = random.Random(8)
    rows = [[str(i), "\n".join(rng.choice(["x", 'say "hi"', "a,b", "", "\r", "é"]) * rng.randrange(9) for _ in range(rng.choice([1, 2, 40])))] for i in range(10)]
    buffer = io.StringIO(newline="")
    csv.writer(buffer, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["id", "t\n" * 60], *rows])
    (tmp_path / "a.csv").write_bytes(b"\n\r\n" * 50 + buffer.getvalue().encode())
    (tmp_path / "b.csv").write_bytes(buffer.getvalue().encode() + b'"100","' + b"open\n" * 50 + b"end")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = [tuple(r) for r in S.read_delimited(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(int(i), t) for i, t in rows]
    assert sorted(got) == sorted([*want, *want, (100, "open\n" * 50 + "end")])


def test_texts_are_not_shuffled(spark, tmp_path):
    """What a scan writes to shuffle files doesn't follow the texts, though records lie in several blocks."""
    rng = random.Random(9)
    rows = [[str(i), "\n".join(str(rng.random()) for _ in range(60))] for i in range(3000)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "t"], *rows])

    def written():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 18)
    try:
        assert S.read_delimited(spark, str(tmp_path)).where("length(t) > 100").count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    size = (tmp_path / "a.csv").stat().st_size
    assert size > 3_000_000 and written() - before < size / 10


def test_json_documents_and_lines(spark, tmp_path):
    pages = [{"a": 1}, {"a": 2}]
    (tmp_path / "one.json").write_text('{ "pages": [\n{"a": 1},\n{"a": 2}\n] }\n')
    (tmp_path / "pretty.json").write_text("\n" + json.dumps({"pages": pages}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"pages": [p]}) for p in pages) + "\n")
    got = S.read_json(spark, str(tmp_path)).select(F.transform("pages", lambda p: p["a"]).alias("a")).collect()
    assert sorted(r.a for r in got) == [[1], [1, 2], [1, 2], [2]]
