"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of
labelled text. A text is parsed greedily into the longest phrases that occur in
the sample; the language that needs the fewest phrases, each costing the log of
the sample's length, wins.

Texts are parsed whole. To step many characters at once a text is cut into
lanes, each parsed from its own start; then the parse of every lane runs on
into the next one until it breaks where that lane's own parse breaks, from
where both agree. The phrases counted are those of one parse of the whole text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of normalised text learnt per language, and the documents drawn for them (about; all of a small language).
SAMPLE_CHARS = 40_000
SAMPLE_DOCS = 60
#: Characters of a drawn document that are looked at; most are shorter, and the sample shall hold many of them.
DOC_CHARS = 4_000
LANE = 256

_KINDS = None


def _kinds() -> np.ndarray:
    """For each code point: 2 if a letter, 1 if a mark that belongs to one, else 0."""
    global _KINDS
    if _KINDS is None:
        _KINDS = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
    return _KINDS


def normalise(text: str | None) -> tuple[np.ndarray, bool]:
    """Code points of the lower-case letters and marks, every other run one space; and whether there is a letter."""
    cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[cps]
    cps = np.where(kinds > 0, cps, np.uint32(32))
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32)
    return cps[keep], bool((kinds == 2).any())


class Automaton:
    """Suffix automaton of ``codes``. Rows of transitions share one array, each shifted to where it fits between the others."""

    def __init__(self, codes: list[int], width: int):
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in codes:
            cur, p = len(nxt), last
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.width = width
        self._pack(nxt)
        self.cost = float(np.log2(max(2, len(codes))))

    def _pack(self, rows: list[dict[int, int]]) -> None:
        self.base = np.zeros(len(rows), np.int64)
        used, free = {}, {}
        for s in sorted(range(len(rows)), key=lambda s: (-len(rows[s]), s)):
            symbols = list(rows[s])
            if not symbols:
                continue
            at, low = free.get(len(symbols), 0), min(symbols)
            while any(at + c - low in used for c in symbols):
                at += 1
            self.base[s] = at - low
            for c, to in rows[s].items():
                used[at + c - low] = (s, to)
            free[len(symbols)] = at  # rows of one size only move on, so that packing takes linear time
        size = max([*used, 0]) + self.width + 1
        shift = -min(0, int(self.base.min(initial=0)))
        self.base += shift
        self.owner, self.to = np.full(size + shift, -1, np.int32), np.zeros(size + shift, np.int32)
        for i, (s, to) in used.items():
            self.owner[i + shift], self.to[i + shift] = s, to
        self.restart = np.array([rows[0].get(c, 0) for c in range(self.width)], np.int32)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ended before its symbol."""
        at = self.base[state] + symbols
        miss = self.owner[at] != state
        return np.where(miss, self.restart[symbols], self.to[at]), miss

    def phrases(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases of the greedy parse of each text; ``flat`` holds the texts, ``starts`` where each begins (none is empty)."""
        sizes = np.diff(np.append(starts, len(flat)))
        per_text = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(starts)), per_text)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begin = starts[owner] + number * LANE
        room = np.minimum(LANE, starts[owner] + sizes[owner] - begin)
        broke = np.zeros(len(flat), bool)
        state, order = np.zeros(len(owner), np.int32), np.argsort(-room, kind="stable")
        longest = room[order]
        for t in range(int(longest[0])):
            live = order[: np.searchsorted(-longest, -t, "left")]
            state[live], miss = self.step(state[live], flat[begin[live] + t])
            broke[begin[live] + t] = miss
        # every lane runs on into the next; its own breaks before both agree are taken back
        at, carried = np.flatnonzero(number > 0), np.empty(0, bool)
        state, t = state[at - 1], 0
        fresh = np.zeros(len(flat), bool)
        late = []
        while len(at):
            inside = t < room[at]
            late.append(owner[at[~inside]])
            at, state = at[inside], state[inside]
            here = begin[at] + t
            state, carried = self.step(state, flat[here])
            fresh[here] = carried & ~broke[here]
            agree = carried & broke[here]
            broke[here[~agree]] = False
            at, state, t = at[~agree], state[~agree], t + 1
        count = np.bincount(np.repeat(np.arange(len(starts)), sizes), broke | fresh, len(starts)).astype(np.int64)
        for i in np.unique(np.concatenate(late)) if late else ():  # a lane that never agreed: step by step
            count[i] = self._walk(flat[starts[i] : starts[i] + sizes[i]])
        return count + 1

    def _walk(self, symbols: np.ndarray) -> int:
        state, count = 0, 0
        base, owner, to, restart = self.base, self.owner, self.to, self.restart
        for c in symbols.tolist():
            at = base[state] + c
            if owner[at] == state:
                state = int(to[at])
            else:
                state, count = int(restart[c]), count + 1
        return count


class Model:
    """Automata of all languages over one alphabet, the letters of all samples; the symbol 0 stands for any other."""

    def __init__(self, samples: dict[str, list[str]]):
        texts = {}
        for lang, docs in sorted(samples.items()):
            parts = [np.append(normalise(t)[0], np.uint32(32)) for t in docs]
            share = max(1, SAMPLE_CHARS // max(1, len(parts)))
            spare = SAMPLE_CHARS - sum(min(share, len(p)) for p in parts)
            taken = []
            for p in parts:  # an equal share of each, what short ones leave goes to the others in their order
                more = min(max(0, len(p) - share), spare)
                spare -= more
                taken.append(p[: share + more])
            texts[lang] = np.concatenate(taken or [np.empty(0, np.uint32)])
        self.alphabet = np.unique(np.concatenate(list(texts.values()) or [np.empty(0, np.uint32)]))
        self.langs = list(texts)
        self.automata = [Automaton(self.encode(t).tolist(), len(self.alphabet) + 1) for t in texts.values()]

    def encode(self, cps: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, cps), max(0, len(self.alphabet) - 1))
        return np.where(self.alphabet[at] == cps, at + 1, 0) if len(self.alphabet) else np.zeros(len(cps), np.int64)

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        normal = [normalise(t) for t in texts]
        rows = [i for i, (_, letter) in enumerate(normal) if letter and self.automata]
        if rows:
            parts = [normal[i][0] for i in rows]
            sizes = np.array([len(p) for p in parts])
            flat, starts = self.encode(np.concatenate(parts)), np.cumsum(sizes) - sizes
            costs = np.stack([a.phrases(flat, starts) * a.cost for a in self.automata])
            order = np.argsort(costs, axis=0, kind="stable")
            best = costs.min(axis=0)
            second = np.take_along_axis(costs, order[1:2], axis=0)[0] if len(costs) > 1 else best * 2
            for place, i in enumerate(rows):
                out[i] = self.langs[order[0, place]]
            score[rows] = 1 - best / np.maximum(second, 1e-9)
        return out, np.clip(score, 0.0, 1.0)


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def fit(docs: DataFrame, held_out: Column) -> Model:
    """Learns from about ``SAMPLE_DOCS`` documents of each language, drawn by hash from the rows not held out, all of a small language.

    Only language codes and the drawn texts, ``DOC_CHARS`` characters of each at most, reach the driver.
    """
    known = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.substring("text", 1, DOC_CHARS).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("c"))
    drawn = known.join(F.broadcast(counts), "lang").where(F.col("h") < F.lit(float(1 << 30)) * SAMPLE_DOCS / F.col("c"))
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
        samples.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return Model({lang: [t for _, t in sorted(rows)] for lang, rows in samples.items()})


def identify(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document row.

    ``und`` with score 0 for null texts and texts without a letter of any
    script. Ties go to the first language by code point. The score is the
    saving over the second language. No labelled row at all: every document is
    ``und``. Texts of any length are parsed whole; rows that repeat are all
    returned and count once as a sample; other columns are not looked at.
    """
    held_out = remainder(F.col("doc_id"), modulus) == held
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, held_out))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = [model.value.predict(texts.iloc[i : i + 500].tolist()) for i in range(0, len(texts), 500)]
        return pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts] or [np.zeros(0)])})

    return docs.select("doc_id", held_out.alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
