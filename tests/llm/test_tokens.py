"""Fill-in-middle and BPE against plain versions."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternwatch.llm import bpe, infill

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, n int, form string, ids string, output int"
TEXTS = [None, "", "a", "Hello, world!", "x <P> y", "a<S>b", "<M>", "naïve café — Übergrößen 😀 日本語\n\ttabs", "<|endoftext|>Mixed<|startoftext|> CASE's we'll", "12 345", " \x1c\x85x", "Hello, world!", "long " * 30_000]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 7, "clash", "clash", 0) for i, t in enumerate(texts)] + [(None, "no id", 7, "clash", "clash", 0), (3, "Hello, world!", 7, "clash", "clash", 0)], DOCS)


def plain_fim(doc_id, text):
    t, h = text or "", hashlib.sha256(b"1:" + str("" if doc_id is None else doc_id).encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return "plain", None, None, t
    low, high = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    pre, mid, suf = t[:low], t[low:high], t[high:]
    spm = d % 100 < 20
    return "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def test_rotations_and_their_inverse():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice("ab é€😀<P>S") for _ in range(r.randint(0, 40)))
        if any(m in t for m in ("<P>", "<S>", "<M>")):
            continue
        a, b = sorted((r.randint(0, len(t)), r.randint(0, len(t))))
        data = t.encode()
        assert infill.byte_at(data, a) == len(t[:a].encode())
        assert infill.arrange(data, a, b, "psm").decode() == f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
        assert infill.arrange(data, a, b, "spm").decode() == f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
        assert all(infill.restore(infill.arrange(data, a, b, f), f) == data for f in ("psm", "spm", "plain"))


def test_fill_in_middle(spark):
    texts = TEXTS + ["some words and more of them, number %d" % i for i in range(200)]
    got = infill.rebuild(infill.fill_in_middle(docs(spark, texts))).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        form, pre, mid, out = plain_fim(row["doc_id"], row["text"])
        assert (row["form"], row["prefix_chars"], row["middle_chars"], row["output"].decode(), row["restored"].decode(), row["n"]) == (form, pre, mid, out, row["text"] or "", len(row["text"] or ""))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    report = {r["doc_id"]: r for r in infill.infill_report(docs(spark, texts)).collect()}
    assert report[3]["output_sha256"] == hashlib.sha256(plain_fim(3, texts[3])[3].encode()).hexdigest() and report[0]["restored_sha256"] == hashlib.sha256(b"").hexdigest()
    assert infill.infill_report(docs(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


def same(tables, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = tables.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids, text[:80]
    assert tables.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(tables, library):
    r = random.Random(3)
    alphabets = ["ab", "aab", "the ing", "abcdefghijklmnopqrstuvwxyz", "'stredvm l a", "éèàüßøłñ a", "12 a", "!?.-_#", "ΣΑσς İıK", "日本語한국어ไทย🙂👍🏽", "\x1c\x1d \x85 a1!"]
    for _ in range(4000):
        letters = r.choice(alphabets)
        same(tables, library, "".join(r.choice(letters) for _ in range(r.randint(0, 40))))
    for _ in range(1000):
        same(tables, library, "".join(chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(0xE000, 0x110000), r.randrange(0xA000, 0xB000)])) for _ in range(20)))
    for word in ("a" * 5000, "ab" * 3000, "haha" * 999 + "x", "!" * 4000, "é" * 3000, *filter(None, TEXTS)):
        same(tables, library, word)


def test_every_code_point_alone(tables, library):
    for c in range(0, 0x110000, 11):
        if not 0xD800 <= c < 0xE000:
            same(tables, library, f"a{chr(c)}!1")


def test_compatible_pairs_are_those_that_stay(tables, library):
    r, ids = random.Random(5), sorted(i for i, s in tables.symbols.items() if all(ord(c) < 256 for c in s))
    ends = sorted(i for i, s in tables.symbols.items() if ord(s[-1]) >= 256)
    tried = 0
    for _ in range(6000):
        a, b = r.choice(ids), r.choice(ends)
        try:
            word = "".join(chr(ord(c) % 256) for c in tables.symbols[a] + tables.symbols[b]).encode("latin-1").decode()
        except UnicodeDecodeError:
            continue
        if [w for w in bpe.splitters(tables.pattern)[1].findall(word)] == [word] and word == bpe.lowered(word):
            tried += 1
            assert tables.compatible(a, b) == (library.encode(word, add_special_tokens=False).ids == [a, b])
    assert tried > 500


def test_bounded_memory(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        small = bpe.Bpe(f.read())
    for text in ("one two three four five six seven, eight nine ten one two", "x" * 100 + " y one"):
        same(small, library, text)
    assert max(len(small.words), len(small.chunks), len(small.fits), len(small.chunks.old)) <= 4


def test_bpe_job(spark, library):
    path = P.path("word_bpe_49k.json")
    rows = docs(spark)
    got = bpe.decode_documents(bpe.encode_documents(rows, path), path).select("*", bpe.unpack(F.col("ids")).alias("array")).collect()
    report = {r["doc_id"]: r for r in bpe.token_report(rows, path).collect()}
    both = {r["doc_id"]: r["decoded"] for r in bpe.encode_documents(rows, path, decoded=True).collect()}
    assert len(got) == len(TEXTS) + 2
    for row in got:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["array"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert both[row["doc_id"]] == row["decoded"]
        assert report[row["doc_id"]]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert report[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(row["decoded"].encode()).hexdigest()
    assert bpe.token_report(rows.limit(0), path).count() == 0


def test_bpe_on_the_given_table(spark, library):
    """A plain version over a whole given table: the library itself."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in bpe.token_report(rows, P.path("word_bpe_49k.json")).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


