"""Exact removal of repeated 50-byte passages by a sampled suffix index.

Of all suffixes of the corpus only those are indexed that start at an anchor:
the 16-byte string of least hash in some 50-byte window. Equal windows have
equal anchors at equal places, so no shared window is missed, and one suffix in
18 is kept. Splitters drawn from a sample of suffixes range-partition them by
their leading 8 bytes; a bucket is sorted by the leading 16 bytes and a hash of
the 84 bytes that any window around the anchor can touch, and neighbours are
compared. Suffixes with equal leading bytes are in one bucket, so that nothing
is left to compare across the boundaries of buckets:

* Suffixes with equal 84 bytes: every document but the one of the least id
  loses all windows around the anchor. Each map task does this for its own
  rows first, so a passage that everyone has leaves one row per batch.
* Suffixes that agree in 16 bytes but not in 84: one of each kind fetches its
  84 bytes and meets the others that agree in 33 bytes to either side (every
  50-byte window covers one of these); there its windows are compared one by
  one. Only the bytes that the windows of a side can touch are sent, compressed.

The text is shuffled once, by document groups, for the second step and for the
cutting; the shuffle of the suffixes is removed before. Leading bytes are
compared as they are, the bytes around them by a hash of 48 bits more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternwatch.llm.common import materialize

LENGTH, GRAM = 50, 16
LEFT = LENGTH - GRAM  # bytes before an anchor that a window around it can reach
SPAN = LEFT + LENGTH
SIDE = 17  # one of the sides of an anchor has at least so many bytes of a window
#: Of the SPAN bytes, those that a window with SIDE bytes before the anchor, or with fewer, can touch.
REACH = ((0, LEFT - SIDE + LENGTH), (LEFT - SIDE + 1, SPAN))
#: Bytes of text a task hashes at once, which bounds its memory; longer texts go in overlapping pieces.
PIECE = 1 << 21
DOCS_PER_GROUP = 1024
#: Documents drawn for the splitters, about, and suffixes taken of each, evenly over the text.
SPLIT_DOCS, SPLIT_SUFFIXES = 2000, 32

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 2**63, 257, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER = np.array([pow(_BASE, i, 1 << 64) for i in range(SPAN + 1)], np.uint64)
_MAX = np.uint64(2**64 - 1)
_NO_ID = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SQUEEZE, _STRETCH = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Unsigned columns with their widths in bytes, as compressed byte planes. Ids are stored from the least one."""
    n = len(columns[0][0])
    planes = [np.ascontiguousarray(c).astype("<u8").view(np.uint8).reshape(n, 8)[:, :w].T.tobytes() for c, w in columns]
    return n.to_bytes(4, "little") + _SQUEEZE.compress(b"".join(planes))


def unpack(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(blob[:4], "little"), np.frombuffer(_STRETCH.decompress(blob[4:]), np.uint8), 0, []
    for w in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(full.reshape(-1).view("<u8"))
        at += n * w
    return out


def unpack_all(blobs, widths: tuple[int, ...]) -> list[np.ndarray]:
    parts = [unpack(b, widths) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in range(len(widths))]


def pack_spans(span: np.ndarray) -> bytes:
    return _SQUEEZE.compress(span.tobytes())


def unpack_spans(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(_STRETCH.decompress(b) for b in blobs), np.uint8).reshape(-1, width)


def by_group(groups: np.ndarray, *columns: tuple[np.ndarray, int]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(groups, kind="stable")
    values, starts = np.unique(groups[order], return_index=True)
    for v, a, b in zip(values, starts, np.append(starts, len(order))[1:], strict=True):
        at = order[a:b]
        yield int(v), pack(*[(c[at], w) for c, w in columns])


RECORD = (8, 8, 6, 8, 2, 4)  # leading bytes, the next ones, context, document, tag, place
REQUEST = (8, 2, 4)  # document, tag, place
FLAG = (8, 2, 4, 1)  # document, tag, start, length


def anchors(pieces: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces (bytes, first and last place an anchor may have): piece number, place, the first and second 8 bytes, and a hash of 84 bytes."""
    starts = np.cumsum([LENGTH] + [len(p) + LENGTH for p, _, _ in pieces])
    values = np.full(int(starts[-1]) + SPAN, 256, np.uint16)
    room, wanted = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    for (p, lo, hi), s in zip(pieces, starts[:-1], strict=True):
        values[s : s + len(p)] = p
        room[s : s + len(p)] = np.arange(len(p), 0, -1)
        wanted[s + lo : s + hi] = True
    h, kept = _BYTE[values], {}
    for m in (1, 2, 4, 8, 16, 32):
        h = h[:-m] * _POWER[m] + h[m:]
        kept[2 * m] = h
        kept.pop(2, None), kept.pop(8, None), kept.pop(32, None)
    order = _mix(kept[16])
    n = len(order)
    order[room[:n] < GRAM] = _MAX
    low = order
    for m in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-m], low[m:])
    low = np.minimum(low[:-3], low[3:])
    low[room[: len(low)] < LENGTH] = 0
    high = np.concatenate([np.zeros(LEFT, np.uint64), low])
    for m in (1, 2, 4, 8, 16):
        high = np.maximum(high[:-m], high[m:])
    high = np.maximum(high[:-3], high[3:])
    n = min(n, len(high))
    q = np.flatnonzero((order[:n] == high[:n]) & (high[:n] > 0) & wanted[:n] & (room[:n] >= GRAM))
    c = q - LEFT
    context = _mix(kept[64][c] * _POWER[20] + kept[16][c + 64] * _POWER[4] + kept[4][c + 80])
    piece = np.searchsorted(starts, q, "right") - 1
    lead, tail = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | values[q + i].astype(np.uint64)
        tail = (tail << np.uint64(8)) | values[q + 8 + i].astype(np.uint64)
    return piece, q - starts[piece], lead, tail, context


def _pieces(raws: list[bytes]) -> Iterator[list[tuple[int, int, np.ndarray, int, int]]]:
    """Batches of (document number, offset, bytes, lo, hi) of about PIECE bytes."""
    batch, size = [], 0
    for i, raw in enumerate(raws):
        data = np.frombuffer(raw, np.uint8)
        if len(data) < LENGTH:
            continue
        for a in range(0, len(data), PIECE):
            begin = max(0, a - 2 * SPAN)
            part = data[begin : a + PIECE + 2 * SPAN]
            batch.append((i, begin, part, a - begin, min(a + PIECE, len(data)) - begin))
            size += len(part)
            if size >= PIECE:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _clip(place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.maximum(place - LEFT, 0)
    return start, np.minimum(place + LENGTH, length) - start


def _leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leading bytes of a few suffixes of each text, as signed numbers."""
    for pdf in batches:
        found = [np.empty(0, np.uint64)]
        for batch in _pieces([_raw(t) for t in pdf["text"]]):
            piece, _, lead, _, _ = anchors([(b[2], b[3], b[4]) for b in batch])
            for k in range(len(batch)):
                own = lead[piece == k]
                found.append(own[:: max(1, -(-len(own) // SPLIT_SUFFIXES))])
        yield pd.DataFrame({"lead": np.concatenate(found).view(np.int64)})


def splitters(rows: DataFrame, n: int, buckets: int) -> np.ndarray:
    """``buckets - 1`` leading bytes that cut a bounded sample of suffixes into even parts. Only the sample reaches the driver."""
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.lit(float(SPLIT_DOCS << 30) / max(1, n))).select("text")
    leads = drawn.mapInPandas(_leads, "lead long").limit(4 * SPLIT_DOCS * SPLIT_SUFFIXES).toPandas()["lead"].to_numpy(np.int64)
    leads = np.sort(leads.view(np.uint64))
    return np.unique(leads[np.arange(1, buckets) * len(leads) // buckets]) if len(leads) else leads


def _index(cuts: np.ndarray, buckets: int, groups: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, raws = pdf["id"].to_numpy(), [_raw(t) for t in pdf["text"]]
            lengths = np.array([len(r) for r in raws], np.int64)
            tags = np.array([zlib.crc32(r) & 0xFFFF for r in raws], np.uint64)
            for batch in _pieces(raws):
                owner, base = np.array([b[0] for b in batch]), np.array([b[1] for b in batch])
                piece, place, lead, tail, context = anchors([(b[2], b[3], b[4]) for b in batch])
                doc, place = owner[piece], place + base[piece]
                did = ids[doc]
                order = np.lexsort((place, did, context, tail, lead))
                doc, place, lead, tail, context, did = doc[order], place[order], lead[order], tail[order], context[order], did[order]
                fresh = np.append(True, (lead[1:] != lead[:-1]) | (tail[1:] != tail[:-1]) | (context[1:] != context[:-1])) if len(lead) else np.empty(0, bool)
                least = did[np.maximum.accumulate(np.where(fresh, np.arange(len(did)), 0))] if len(did) else did
                later = did > least
                rows = []
                start, size = _clip(place[later], lengths[doc[later]])
                for g, blob in by_group(did[later] % groups, (did[later], 8), (tags[doc[later]], 2), (start, 4), (size, 1)):
                    rows.append((g % buckets, g, blob))
                keep = ~later
                for b, blob in by_group(np.searchsorted(cuts, lead[keep], "right"), (lead[keep], 8), (tail[keep], 8), (context[keep] >> np.uint64(16), 6), (did[keep], 8), (tags[doc[keep]], 2), (place[keep], 4)):
                    rows.append((b, -1, blob))
                yield pd.DataFrame(rows, columns=["bucket", "g", "blob"])

    return run


def _compare(buckets: int, groups: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        passed = pdf[pdf["g"] >= 0]
        lead, tail, context, did, tag, place = unpack_all(pdf.loc[pdf["g"] < 0, "blob"], RECORD)
        did, place = did.view(np.int64), place.astype(np.int64)
        rows = [(g, False, b) for g, b in zip(passed["g"], passed["blob"], strict=True)]
        if len(lead):
            order = np.lexsort((did, context, tail, lead))  # by the leading bytes, then by what follows
            lead, tail, context, did, tag, place = lead[order], tail[order], context[order], did[order], tag[order], place[order]
            new_gram = np.append(True, (lead[1:] != lead[:-1]) | (tail[1:] != tail[:-1]))
            new = new_gram | np.append(True, context[1:] != context[:-1])
            least = did[np.maximum.accumulate(np.where(new, np.arange(len(did)), 0))]
            later = did > least
            start = np.maximum(place[later] - LEFT, 0)
            for g, blob in by_group(did[later] % groups, (did[later], 8), (tag[later], 2), (start, 4), (place[later] + LENGTH - start, 1)):
                rows.append((g, False, blob))
            # grams that several contexts of several documents share
            first = np.flatnonzero(new_gram)
            number = np.cumsum(new_gram) - 1
            contexts = np.add.reduceat(new.astype(np.int64), first)
            lowest, highest = np.minimum.reduceat(least, first), np.maximum.reduceat(least, first)
            ask = ((contexts > 1) & (lowest != highest))[number] & ~later
            for g, blob in by_group(did[ask] % groups, (did[ask], 8), (tag[ask], 2), (place[ask], 4)):
                rows.append((g, True, blob))
        return pd.DataFrame(rows, columns=["g", "request", "blob"])

    return run


def _routes(span: np.ndarray, side: int) -> np.ndarray:
    """Hashes of the bytes from SIDE before the anchor to its end, or from its beginning to SIDE behind it."""
    a = LEFT - SIDE if side == 0 else LEFT
    return _mix((_BYTE[span[:, a : a + GRAM + SIDE]] * _POWER[: GRAM + SIDE]).sum(axis=1) + np.uint64(side))


def _fetch(buckets: int):
    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        did, tag, place = unpack_all(asked["blob"], REQUEST)
        rows = []
        if len(did):
            raws = [_raw(t) for t in docs["text"]]
            of = {(i, zlib.crc32(r) & 0xFFFF): r for i, r in zip(docs["id"], raws, strict=True)}
            span = np.zeros((len(did), SPAN), np.uint8)
            left, right = np.zeros(len(did), np.int64), np.zeros(len(did), np.int64)
            did, place = did.view(np.int64), place.astype(np.int64)
            for i, (d, t, p) in enumerate(zip(did.tolist(), tag.tolist(), place.tolist(), strict=True)):
                raw = of[d, t]
                left[i], right[i] = min(p, LEFT), min(len(raw) - p, LENGTH)
                span[i, LEFT - left[i] : LEFT + right[i]] = np.frombuffer(raw, np.uint8, left[i] + right[i], p - left[i])
            for side, has in ((0, left >= SIDE), (1, right >= GRAM + SIDE)):
                at, (a, b) = np.flatnonzero(has), REACH[side]
                route = _routes(span[at], side)
                target = (route & np.uint64(buckets - 1)).astype(np.int64)
                order = np.lexsort((route, target))
                values, starts = np.unique(target[order], return_index=True)
                for v, x, y in zip(values, starts, np.append(starts, len(order))[1:], strict=True):
                    pick = at[order[x:y]]
                    rows.append((int(v), side, pack((did[pick], 8), (tag[pick], 2), (place[pick], 4), (left[pick], 1), (right[pick], 1)), pack_spans(span[pick, a:b])))
        return pd.DataFrame(rows, columns=["bucket", "side", "blob", "spans"])

    return run


def _windows(groups: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for side in (0, 1):
            part = pdf[pdf["side"] == side]
            did, tag, place, left, right = unpack_all(part["blob"], (8, 2, 4, 1, 1))
            if not len(did):
                continue
            did, place, left, right = did.view(np.int64), place.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
            a, b = REACH[side]
            span = np.zeros((len(did), SPAN), np.uint8)
            span[:, a:b] = unpack_spans(part["spans"], b - a)
            route = _routes(span, side)
            order = np.lexsort((did, route))
            route, did, tag, place, left, right, span = (x[order] for x in (route, did, tag, place, left, right, span))
            new = np.append(True, route[1:] != route[:-1])
            first, number = np.flatnonzero(new), np.cumsum(new) - 1
            several = (np.minimum.reduceat(did, first) != np.maximum.reduceat(did, first))[number]
            route, did, tag, place, left, right, body = (x[several] for x in (route, did, tag, place, left, right, span))
            for before in range(SIDE, LEFT + 1) if side == 0 else range(SIDE):  # bytes of the window before the anchor
                fits = np.flatnonzero((left >= before) & (right >= LENGTH - before))
                if not len(fits):
                    continue
                a = LEFT - before
                key = _mix((_BYTE[body[fits, a : a + LENGTH]] * _POWER[:LENGTH]).sum(axis=1))
                by = np.lexsort((did[fits], key, route[fits]))
                at, key = fits[by], key[by]
                new = np.append(True, (route[at][1:] != route[at][:-1]) | (key[1:] != key[:-1]))
                least = did[at][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
                later = at[did[at] > least]
                for g, blob in by_group(did[later] % groups, (did[later], 8), (tag[later], 2), (place[later] - before, 4), (np.full(len(later), LENGTH), 1)):
                    rows.append((g, blob))
        return pd.DataFrame(rows, columns=["g", "blob"])

    return run


def _cut(with_text: bool):
    def run(docs: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        did, tag, start, size = unpack_all(flags["blob"], FLAG)
        did = did.view(np.int64)
        order = np.lexsort((start, tag, did))
        did, tag, start, end = did[order], tag[order], start[order].astype(np.int64), (start + size)[order].astype(np.int64)
        new = np.flatnonzero(np.append(True, (did[1:] != did[:-1]) | (tag[1:] != tag[:-1]))) if len(did) else np.empty(0, np.int64)
        where = {(int(did[a]), int(tag[a])): (a, b) for a, b in zip(new, np.append(new, len(did))[1:], strict=True)}
        rows = []
        for i, null, text in zip(docs["id"], docs["no_id"], docs["text"], strict=True):
            raw = _raw(text)
            a, b = where.get((i, zlib.crc32(raw) & 0xFFFF), (0, 0)) if not null else (0, 0)
            kept, spans, upto, removed = [], 0, 0, 0
            for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True):
                e = min(e, len(raw))
                if e <= upto:
                    continue
                if s > upto or not spans:
                    kept.append(raw[upto:s])
                    spans += 1
                else:
                    s = upto
                removed += e - s
                upto = e
            kept.append(raw[upto:])
            left = b"".join(kept)
            rows.append((i, null, len(raw), removed, spans, hashlib.sha256(left).hexdigest()) + ((left,) if with_text else ()))
        return pd.DataFrame(rows, columns=["id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document row; ``kept`` (binary) too if asked for.

    Null texts are empty; texts under 50 bytes never lose anything. A null id
    is not compared. Rows that repeat an id are not smaller than each other,
    and are told apart by their texts. What is left may not be valid UTF-8
    where a cut falls inside a character, hence ``binary``. An empty table
    gives an empty result; other columns are not looked at.
    """
    n = docs.count()
    # few enough that a packed run holds hundreds of rows, many enough that a task's share stays small
    buckets, routes = 1 << max(8, (n // 4000).bit_length()), 1 << max(5, (n // 8000).bit_length())
    groups = max(61, n // DOCS_PER_GROUP) | 1
    no_id = F.col("doc_id").isNull()
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), no_id.alias("no_id"), "text")
    known = rows.where("not no_id").select("id", "text")
    dealt = known.mapInPandas(_index(splitters(known, n, buckets), buckets, groups), "bucket int, g long, blob binary")
    compared = materialize(dealt.groupBy("bucket").applyInPandas(_compare(buckets, groups), "g long, request boolean, blob binary"), "suffixes")
    # the same exchange of the texts serves both joins below
    # texts without an id are not compared with any, and are dealt by their hash
    placed = rows.withColumn("g", F.pmod(F.when(F.col("no_id"), F.xxhash64("text")).otherwise(F.col("id")), F.lit(groups))).groupBy("g")
    asked = compared.where("request").select("g", "blob").groupBy("g")
    fetched = placed.cogroup(asked).applyInPandas(_fetch(routes), "bucket int, side int, blob binary, spans binary")
    more = fetched.groupBy("bucket").applyInPandas(_windows(groups), "g long, blob binary")
    flags = compared.where("not request").select("g", "blob").unionByName(more).groupBy("g")
    schema = "id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    cut = placed.cogroup(flags).applyInPandas(_cut(with_text), schema)
    return cut.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *cut.columns[2:])
