"""Fill-in-middle transformation by block rotations in place, and its exact inverse.

A text is cut at two places into prefix, middle and suffix. Its bytes get a
sentinel before each segment and the segments are exchanged inside one
``bytearray``: two neighbouring blocks change places by three reversals. The
inverse finds the sentinels, turns the same blocks back and takes the
sentinels out; a text that holds a sentinel itself stays plain, so nothing is
ambiguous.

Rows are independent: one pass over the table without a shuffle, Arrow batches
of the text's UTF-8 bytes into Python, one text at a time in memory. Null texts
count as empty and empty texts are plain; a null ``doc_id`` is hashed as no
digits. Rows that repeat give equal rows. Columns of the input that carry a name of
the output are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = {name: mark.encode() for name, mark in (("p", PREFIX), ("s", SUFFIX), ("m", MIDDLE))}

FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def rotate(buf: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks ``[start, cut)`` and ``[cut, end)`` of ``buf`` by three reversals."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        buf[a:b] = buf[a:b][::-1]


def byte_at(data: bytes, points: int) -> int:
    """Byte offset of the code point number ``points`` of UTF-8 bytes: a scan by blocks, one for ASCII."""
    at = 0
    while points > 0 and at < len(data):
        block = data[at : at + points]  # at most as many code points as are wanted
        at += len(block)
        points -= len(block.translate(None, FOLLOWING))
    while at < len(data) and data[at] in FOLLOWING:
        at += 1
    return at


def arrange(data: bytes, first: int, second: int, form: str) -> bytes:
    """``data`` cut after ``first`` and ``second`` code points, in the order of ``form``: ``psm``, ``spm`` or ``plain``."""
    if form == "plain":
        return data
    low = byte_at(data, first)
    high = low + byte_at(data[low:], second - first)
    buf = bytearray(data)
    for at, name in ((high, "s"), (low, "m"), (0, "p")):  # from the right, so that cuts stay where they are
        buf[at:at] = MARKS[name]
    w = len(MARKS["p"])
    middle, suffix = low + w, high + 2 * w
    rotate(buf, middle, suffix, len(buf))  # P M S -> P S M
    if form == "spm":
        rotate(buf, 0, middle, middle + len(buf) - suffix)  # P S -> S P
    return bytes(buf)


def restore(data: bytes, form: str) -> bytes:
    """The text that ``arrange`` gave ``data`` for."""
    if form == "plain":
        return data
    buf, w = bytearray(data), len(MARKS["p"])
    last = buf.index(MARKS["m"])
    if form == "spm":  # S P M -> P S M
        rotate(buf, 0, buf.index(MARKS["p"]), last)
    middle = buf.index(MARKS["s"])
    rotate(buf, middle, last, len(buf))  # P S M -> P M S
    for at in (middle + len(buf) - last, middle, 0):  # again from the right
        del buf[at : at + w]
    return bytes(buf)


@F.arrow_udf(BinaryType())
def _arrange(text: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
    rows = zip(text, first.to_pylist(), second.to_pylist(), form.to_pylist(), strict=True)
    return pa.array([arrange(t.as_py(), a, b, f) for t, a, b, f in rows], pa.binary())


@F.arrow_udf(BinaryType())
def _restore(output: pa.Array, form: pa.Array) -> pa.Array:
    return pa.array([restore(o.as_py(), f) for o, f in zip(output, form.to_pylist(), strict=True)], pa.binary())


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` unsigned 32-bit numbers from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars`` and the arranged bytes ``output``.

    ``rate`` per cent of the texts are rearranged, ``spm_rate`` per cent of
    these suffix first. Cuts fall at code points; both are drawn from ``seed``
    and ``doc_id`` alone, so reruns agree.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    a, b = h1 % (n + 1), h2 % (n + 1)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((n == 0) | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    cut = docs.withColumns({"n": n.cast("long"), "form": form, "prefix_chars": F.least(a, b), "middle_chars": F.abs(a - b)})
    first, second = F.col("prefix_chars"), F.col("prefix_chars") + F.col("middle_chars")
    done = cut.withColumn("output", _arrange(text.cast("binary"), first, second, F.col("form")))
    return done.withColumns({c: F.when(F.col("form") != "plain", F.col(c)) for c in ("prefix_chars", "middle_chars")})


def rebuild(arranged: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``arranged`` with the exact bytes of its texts, ``restored``, from the output and its form alone."""
    return arranged.withColumn("restored", _restore(F.col(output), F.col(form)))


def infill_report(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    done = rebuild(fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
