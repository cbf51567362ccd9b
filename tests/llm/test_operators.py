from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lanternwatch.llm import decontamination, embeddings, htmltext, langid, lines, minhash, mixing, quality, substrings, toxicity
from lanternwatch.llm.components import contract

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", None, "clash") for i, t in enumerate(texts)], DOCS)


def prose(n, seed=0, words=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghilmnoprst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(words)) for _ in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(31)}) == 1 and len({got[100], got[101], got[102]}) == 1 and got[0] != got[100]
    assert contract(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, limit):
    text = prose(1)[0]
    item = " ".join(text.split()[10:30]).upper()
    bench = spark.createDataFrame([(5, item), (12, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    docs = documents(spark, [text, "x " + item + "!", "a Tiny, item here", None, "", "nothing of it"])
    got = {r["doc_id"]: r for r in decontamination.find_hits(docs, bench, max_broadcast=limit).collect()}
    assert len(got) == 6 and [got[i]["items"] for i in range(6)] == [["5"], ["5"], ["12"], [], [], []]
    report = {r["doc_id"]: r for r in decontamination.contamination_report(docs, bench).collect()}
    assert report[0]["n_hit"] == 20 and report[2]["n_hit"] == 2 and report[3]["n_words"] == 0
    assert report[2]["items_sha256"] == hashlib.sha256(b"12").hexdigest()
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()) == [3, 4, 5]
    stripped = decontamination.strip_contaminated(docs, bench)
    assert stripped.columns == docs.columns and {r["doc_id"]: r["text"] for r in stripped.collect()}[2] == "a here"
    assert decontamination.find_hits(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def _near(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    at = {i: i for i in texts}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_minhash_against_brute_force(spark):
    r, texts = random.Random(4), prose(20, 1, 80)
    for base in list(texts[:6]):
        for _ in range(8):
            w = base.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
            texts.append(" ".join(w))
    texts += [None, "", "one two", "One  two", "one two three"]
    docs = documents(spark, texts)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs).collect()}
    want, sizes = _near(dict(enumerate(texts)))
    assert {i: x["component_id"] for i, x in got.items()} == want and {i: x["n_shingles"] for i, x in got.items()} == sizes
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values()))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r, base = random.Random(8), prose(1, 3, 80)[0].split()
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(999)
        texts.append(" ".join(w))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == _near(dict(enumerate(texts)))[0]


def test_html():
    page = """<html><head><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div id=cookie-banner>We use cookies, fine?</div><main><article><h1>Title &amp; so on</h1><p>First   paragraph, with commas,
    and enough text to be counted.<p>Second one, also long enough &mdash; really.<script>var a = "<p>no</p>"</script><div class="ad">Buy!</div></article></main>
    <section class="comments"><p>Nice article, I liked it, thanks for writing it all down.</p></section><footer>imprint</footer></body></html>"""
    assert htmltext.extract(page) == "Title & so on\n\nFirst paragraph, with commas, and enough text to be counted.\n\nSecond one, also long enough — really."
    assert [htmltext.extract(x) for x in (None, "", "<p></p>", "<!-- x")] == [""] * 4
    assert htmltext.extract("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_html_job(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>hello there</p></article>", 9), (1, "u", None, 9)], "page_id long, url string, html string, n_chars int")
    assert sorted((r["text"], r["n_chars"]) for r in htmltext.extract_pages(pages).collect()) == [("", 0), ("hello there", 11)]


def test_language(spark):
    one, two = prose(40, 5), [t.translate(str.maketrans("abcdefghilmnoprst", "qwzuvxkjyäöüßaeio")) for t in prose(40, 6)]
    rows = [(i, t, "aa" if i % 2 == 0 else "bb", "s", 0, "x") for i, t in enumerate(x for p in zip(one, two, strict=True) for x in p)] + [(900, None, None, "s", 0, "x"), (901, "12 34", None, "s", 0, "x"), (None, "abc", None, "s", 0, "x")]
    got = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 == 0 else "bb") for r in got if r["doc_id"] is not None and r["doc_id"] < 900)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (900, 901)] == ["und", "und"] and len(got) == 83
    assert langid.identify(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(documents(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_line_templates(spark):
    texts = [f"{t}\nPage {i} of 99 printed by the north office\nshort" for i, t in enumerate(prose(14, 7))] + [None, "", "\n\n"]
    out = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[0]["n_dropped"] == 0  # the first occurrence stays
    assert all(out[i]["text"] == texts[i].split("\n")[0] + "\nshort" and out[i]["n_dropped"] == 1 for i in range(1, 14))
    assert out[14]["text"] is None and out[14]["n_lines"] == 0 and out[15]["text"] == "" and out[16]["n_lines"] == 3
    assert lines.dedup_lines(documents(spark, texts).limit(0)).count() == 0


def test_unchanged_lines(spark):
    own = prose(14, 17)
    passage, short = prose(2, 18, words=55), prose(1, 19, words=20)[0]
    prices = [" ".join(f"{i * 70 + j}.99" for j in range(55)) for i in range(2)]
    row = "3.10 4.20 5.30 total"
    extra = {0: [passage[0], prices[0], short], 1: [passage[0], prices[0], short], 2: [passage[1], prices[1]], 3: [passage[0]]}
    texts = ["\n".join([own[i], *extra.get(i, []), row]) for i in range(14)]
    out = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[2]["text"] == "\n".join([own[2], passage[1], prices[1]])  # other numbers are another line
    assert out[1]["text"] == f"{own[1]}\n{short}" and out[3]["text"] == own[3]  # long from the second document on, short under the floor
    assert all(out[i]["text"] == own[i] for i in range(4, 14))  # a row of numbers in 14 documents
    cut = {r["doc_id"]: r["text"] for r in lines.dedup_passages(documents(spark, texts)).collect()}
    assert cut[1] == "\n".join([own[1], short, row]) and cut[4] == texts[4]


def test_classifiers(spark):
    texts = prose(240, 9)
    rows = [(i, t if i % 3 else " ".join(t.split()[:3]) * 9, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t + (" scumword idiotic" if i % 4 == 0 else "")) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i, _, _ in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for job, truth in ((quality.classify, lambda i: i % 3 > 0), (toxicity.classify, lambda i: i % 4 == 0)):
        got = [r for r in job(docs, labels).collect()]
        held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
        assert len(got) == 242 and sum(r["predicted"] == int(truth(r["doc_id"])) for r in held) / len(held) > 0.9
        assert all(0 <= r["score"] <= 1 for r in got)
        assert {r["score"] for r in job(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def _cut(rows, n=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            least[w] = min(least.get(w, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


def test_substrings_against_brute_force(spark, monkeypatch):
    base = prose(12, 11)
    texts = [*base, base[0], base[1][40:160] + " und " + base[2][100:220], "é" * 30 + base[3][:70], "a" * 300, "b" + "a" * 200, None, "", "short", base[0] + base[0]]
    rows = list(enumerate(texts))
    docs = documents(spark, texts)
    for piece in (1 << 21, 300):
        monkeypatch.setattr(substrings, "PIECE", piece)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()}
        assert got == _cut(rows)
    odd = docs.unionByName(spark.createDataFrame([(None, base[0], "en", "s", 0, "x"), (0, base[5], "en", "s", 0, "x")], DOCS))
    got = substrings.remove_repeats(odd, with_text=True).collect()
    assert len(got) == len(texts) + 2 and {r["n_removed"] for r in got if r["doc_id"] is None} == {0}


def test_mixing(spark):
    sizes = {"a": 30, "b": 30, None: 5}
    rows = [(i, " ".join(["w"] * (3 + i % 5)), None, s, None, "x") for s, n in sizes.items() for i in range(n)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(900, None, None, "a", None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for t, s in targets.values())
    for s, (t, _) in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= 8
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixture(docs).count() == sum(r["n_taken"] for r in got) == mixing.mix(docs).count()
    assert mixing.mix_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("cell", "sample"), [(4096, 1024), (16, 32)])
def test_embeddings_against_brute_force(spark, monkeypatch, cell, sample):
    import numpy as np

    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "SAMPLE", sample)
    rng = np.random.default_rng(2)
    n = 150
    centres = rng.normal(size=(12, 8))
    x = [(centres[i % 12] + rng.normal(size=8) * 0.12).astype(np.float32).tolist() for i in range(n)]
    x += [x[0], x[0], [2 * v for v in x[3]], [4 * v for v in x[3]], [0.0] * 8, None, [float("nan")] * 8, [1.0, 2.0]]
    labels = [i % 2 for i in range(n)] + [0, 0, 1, 1, 0, 0, 0, None]
    rows = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(rows).collect()}
    ok = [i for i, (v, y) in enumerate(zip(x, labels, strict=True)) if y is not None and v and not np.isnan(v).any() and any(v)]
    at, n = {i: i for i in range(len(x))}, dict.fromkeys(range(len(x)), 0)

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for i in ok:
        for j in ok:
            if i < j and labels[i] == labels[j]:
                p, q = np.array(x[i]), np.array(x[j])
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    a, b = sorted((find(i), find(j)))
                    at[b] = a
    assert got == {i: (n[i], find(i)) for i in range(len(x))}
    assert embeddings.near_duplicates(rows.limit(0)).count() == 0


def test_cover_tree_invariants_and_traversal(monkeypatch):
    import numpy as np

    monkeypatch.setattr(embeddings, "BASE", 1)
    rng = np.random.default_rng(5)
    x = embeddings._unit(np.vstack([rng.normal(size=(60, 6)), rng.normal(size=(3, 6)).repeat(40, axis=0) + rng.normal(size=(120, 6)) * 0.03]))
    tree = embeddings.Tree(x)
    for node, kids in enumerate(tree.kids):
        if len(kids):
            c = tree.centre[kids]
            assert tree.centre[node] in c and sorted(np.concatenate([tree.points[k] for k in kids])) == sorted(tree.points[node])
            assert (tree.radius[kids] <= tree.radius[node] / 2 + 1e-6).all()
            d = embeddings._apart(x[c], x[c]) + 9 * np.eye(len(c))
            assert (d > tree.radius[node] / 2).all()
    for other in (tree, embeddings.Tree(x[::-1].copy())):
        seen = np.zeros((len(x), len(x)), int)
        for p, q, solid in embeddings.linked_blocks(tree, other, 0.2):
            if solid is None:
                seen[p, q] += 1
            else:
                seen[np.ix_(p, q)] += np.triu(np.ones((len(p), len(q)), int), 1) if p is q else 1  # a node with itself
                assert not solid or (embeddings._apart(x[p], other.x[q]) < 0.2).all()
        assert (seen if other is not tree else np.triu(seen + seen.T, 1)).max() <= 1  # no pair twice
        close = embeddings._apart(x, other.x) <= 0.2
        both = seen if other is not tree else seen + seen.T + np.eye(len(x), dtype=int)
        assert (both[close] > 0).all()


@pytest.mark.parametrize("n, far, cell, sample, levels", [(400, 1, 64, 8, 4), (3000, 20, 500, 64, 5)])
def test_far_vectors_do_not_hold_up_the_splits(spark, monkeypatch, n, far, cell, sample, levels):
    """Near-equal vectors and a few far ones: the far ones are in every net, so that the balls shrink at each level."""
    np = pytest.importorskip("numpy")
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "SAMPLE", sample)
    rng, split, seen = np.random.default_rng(3), embeddings._split, []
    monkeypatch.setattr(embeddings, "_split", lambda *a: seen.append(1) or split(*a))
    base = rng.normal(size=16)
    x = np.vstack([base + rng.normal(size=(n, 16)) * 1e-3, -base + rng.normal(size=(far, 16)) * 2])
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(rows).collect()} == dict(enumerate(links.tolist()))
    assert len(seen) <= levels
