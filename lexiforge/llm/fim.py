"""Fill-in-middle transformation by bit-parallel integers.

Every text is one whole number per character class: ``bytes.translate`` writes a binary
digit for each byte and ``int(.., 2)`` reads them, so that bit i stands for byte i. Shifts and
boolean operations mark where units begin, ``bit_count`` counts them, and halving the
number finds the cut of a given rank. There is no shuffle, and nothing is kept between rows:
a lost executor costs its own partitions.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, text_runs

MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _digits(members: bytes) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


_BREAK, _SPACE, _LATER = _digits(b"\n"), _digits(b" \t\n\x0b\x0c\r"), _digits(bytes(range(0x80, 0xC0)))


def class_mask(data: bytes, digits: bytes) -> int:
    """Bit i is set where byte i belongs to the class."""
    return int(data.translate(digits)[::-1], 2) if data else 0


def unit_starts(data: bytes, unit: str) -> int:
    """Bit i is set where a unit begins at byte i.

    A ``line`` ends with its line feed, a ``word`` with the white space behind it (white space
    at the head of a text is a unit of its own).
    """
    if not data:
        return 0
    whole = (1 << len(data)) - 1
    if unit == "line":
        return (class_mask(data, _BREAK) << 1 | 1) & whole
    if unit == "word":
        space = class_mask(data, _SPACE)
        return space << 1 & (whole ^ space) | 1
    raise ValueError(f"unit {unit!r}: line or word")


def ranked_bit(mask: int, width: int, rank: int) -> int:
    """Position of the set bit of ``mask`` (of ``width`` bits) that has ``rank`` set bits below it."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - below, at + half
    return at


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The four draws of a document, from a digest of the seed and its id (a null id counts as no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def rearranged(data: bytes, doc_id: int | None, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50,
               marks: tuple[bytes, bytes, bytes] = tuple(m.encode() for m in MARKS)):
    """(units, form, code points of the prefix, of the middle, output) of one text in UTF-8."""
    starts = unit_starts(data, unit)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or h3 % 100 >= rate or any(m in data for m in marks):
        return n, "plain", None, None, data
    ranks = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ranked_bit(starts, len(data), k) if k < n else len(data) for k in ranks)
    if data.isascii():
        chars = a, b - a
    else:
        later = class_mask(data, _LATER)
        upto = [k - (later & ((1 << k) - 1)).bit_count() for k in (a, b)]
        chars = upto[0], upto[1] - upto[0]
    head, middle, tail = data[:a], data[a:b], data[b:]
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", *chars, b"".join((s, tail, p, head, m, middle))
    return n, "psm", *chars, b"".join((p, head, s, tail, m, middle))


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Cuts each whole text at two drawn unit boundaries and moves the middle to the end.

    Returns ``(doc_id, n, form, prefix_chars, middle_chars, output)`` for each row of ``docs(doc_id, text)``:
    the number of units, the form (``plain``, ``psm`` or ``spm``), the code points of both parts
    (null where plain) and the new text. ``rate`` and ``spm`` are percentages. A null text counts as an
    empty one; empty texts and those that hold a mark stay plain. Rows with the same id draw the
    same numbers, rows without id those of an empty id; repeated rows stay, other columns are not
    carried, an empty table gives an empty one. A text is held whole, in a few times its size.
    """
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks, none empty")
    signs = tuple(m.encode() for m in marks)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in text_runs(batch.column(1)):
                rows = [rearranged(t.encode(), ids[at + k], unit, seed, rate, spm, signs) for k, t in enumerate(texts)]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + len(rows)], pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of fill_in_middle() was made from, read off the output and its form alone."""
    p, s, m = marks

    def cut(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        behind = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(behind, second, 1)
        rest = F.substring(behind, F.length(one) + len(second) + 1, F.length(behind))
        two = F.substring_index(rest, third, 1)
        return one, two, F.substring(rest, F.length(two) + len(third) + 1, F.length(rest))

    prefix, suffix, middle = cut(p, s, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = cut(s, p, m)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
