"""Toxicity by weak supervision.

Many voters look at a text: short lexicons by kind and language, patterns, and
marks that the labelled sample shows to tell toxic texts, which are words that
occur and word beginnings that are dense, a few to a voter. A generative model
with a latent class estimates each voter's accuracy by EM over labelled and
unlabelled texts, and the correlations left between voters given the class,
which share the weight of voters that say the same. Labels choose the learnt
marks and tell the model which class is which (its starting point, and a weak
source while it is fitted). What the classifier is trained on are posteriors of
the votes alone, for labelled and unlabelled texts alike. It is linear, over
hashed letter runs that occur, or are dense, in a text, and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternwatch.llm.langid import remainder
from lanternwatch.llm.samples import labelled, unlabelled

#: Labelled documents drawn of each class, and unlabelled ones: the bounds of the sample.
PER_CLASS, UNLABELLED = 2500, 1500
THRESHOLD = 0.5
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
GRAMS = (4, 5, 7)
#: A mark or slot is used if it occurs in so many documents of the sample and tells the classes apart by so much (log odds).
MIN_DOCS, MIN_ODDS, MIN_SLOT_ODDS = 3, 2.0, 2.5
#: Learnt voters, one mark each, and the lengths of word beginnings. A mark's log odds count less two standard errors.
LEARNT_VOTERS, BEGINNINGS = 128, range(3, 9)
#: Dense is what comes at least twice, and once in so many words.
DENSE = 100
#: How much a label counts beside the voters while the model is fitted: log odds of 2.
ANCHOR = 2.0

#: Short lexicons of insults and threats.
LEXICONS = {
    "insult_en": "idiot idiots moron morons stupid imbecile fool loser losers clown dumb dimwit jerk".split(),
    "contempt_en": "disgusting pathetic worthless scum trash filth vermin garbage vile repulsive".split(),
    "hate_en": "hate despise loathe hateful inferior subhuman parasite parasites".split(),
    "threat_en": "kill die destroy hurt punch burn beat shoot".split(),
    "insult_de": "idiot idioten dummkopf trottel abschaum versager widerlich arschloch dreck".split(),
    "insult_fr": "idiot imbécile crétin abruti connard débile ordure dégoûtant raclure".split(),
    "insult_es": "idiota imbécil estúpido estúpida basura escoria asqueroso inútil tonto".split(),
}
PATTERNS = [
    r"\byou (?:are|re) (?:an? |all |such |so )?(?:\w+ ){0,2}(?:idiot|moron|scum|trash|loser|stupid|pathetic|worthless|disgusting)",
    r"\b(?:shut up|go away|drop dead|kill yourself|get lost|go to hell)\b",
    r"\b(?:i|we) (?:hate|despise|loathe)\b",
    r"\b(?:idiot|moron|scum|loser|trash|filth|vermin)s?[^\w]{0,3}\b(?:idiot|moron|scum|loser|trash|filth|vermin)s?\b",
]
_PATTERNS = [re.compile(p) for p in PATTERNS]
_WORD = re.compile(r"[^\W_]+")


def gram_slots(text: str | None) -> np.ndarray:
    """Hash slots of all runs of ``GRAMS`` bytes of the lower-cased text, padded by spaces; word beginnings and whole words among them."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    found = []
    for n in GRAMS:
        if len(raw) >= n:
            acc = np.full(len(raw) - n + 1, n, np.uint32)
            for i in range(n):
                acc = (acc ^ raw[i : i + len(acc)]) * np.uint32(0x01000193)
            acc = (acc ^ (acc >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append(acc >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def features(text: str | None) -> np.ndarray:
    """Slots that occur, and, shifted by SLOTS, those that are dense."""
    slots, counts = np.unique(gram_slots(text), return_counts=True)
    dense = (counts >= 2) & (counts * DENSE >= len((text or "").split()))
    return np.concatenate([slots, slots[dense] + np.uint32(SLOTS)])


def marks(low: str) -> set[str]:
    """Words of a lower-cased text, word beginnings (with a hyphen), and those that are dense in it (with a star)."""
    words = Counter(_WORD.findall(low))
    n, begin = sum(words.values()), Counter()
    for w, c in words.items():
        for m in BEGINNINGS[: max(0, len(w) - BEGINNINGS[0] + 1)]:
            begin[w[:m]] += c
    return set(words) | {p + "-" for p in begin} | {p + "*" for p, c in begin.items() if c >= 2 and c * DENSE >= n}


def _counts(texts, y) -> dict[str, tuple[int, int]]:
    """Toxic and all texts with each mark, for marks of MIN_DOCS toxic texts and more. Hashed counts first, so that rare marks take no memory."""
    slots = np.zeros(1 << 22, np.int32)
    toxic = [t for t, label in zip(texts, y, strict=True) if label]
    place = lambda m: crc32(m.encode("utf-8", "surrogatepass")) & (len(slots) - 1)
    for t in toxic:
        slots[np.fromiter({place(m) for m in marks((t or "").lower())}, np.int64)] += 1
    in_toxic, in_all = Counter(), Counter()
    for t in toxic:
        in_toxic.update(m for m in marks((t or "").lower()) if slots[place(m)] >= MIN_DOCS)
    wanted = {m for m, c in in_toxic.items() if c >= MIN_DOCS}
    for t in texts:
        in_all.update(marks((t or "").lower()) & wanted)
    return {m: (in_toxic[m], in_all[m]) for m in wanted}


class LabelModel:
    """Naive Bayes with a latent class over binary votes, its weights shared between correlated voters.

    ``start``: first guess of the class; ``known``: log odds of labels, 0 where there is none.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, known: np.ndarray, weight: np.ndarray, rounds: int = 20):
        q, m = np.clip(start, 0.02, 0.98), votes.shape[1]
        self.share, seen = np.ones(m), votes.sum(axis=0) >= MIN_DOCS
        for _ in range(rounds):
            wq, wn = weight * q, weight * (1 - q)
            self.prior = float(np.clip(wq.sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3))
            self.fire1 = np.clip((wq @ votes + 0.5) / (wq.sum() + 1), 1e-4, 1 - 1e-4)
            self.fire0 = np.clip((wn @ votes + 0.5) / (wn.sum() + 1), 1e-4, 1 - 1e-4)
            expected = np.outer(q, self.fire1) + np.outer(1 - q, self.fire0)
            residual = (votes - expected) * np.sqrt(weight)[:, None]
            cov = residual.T @ residual
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            self.correlation = cov / np.outer(sd, sd)
            linked = np.where((self.correlation > 0.4) & seen & seen[:, None], self.correlation, 0.0)
            np.fill_diagonal(linked, 1.0)
            self.share = 1 / linked.sum(axis=1)
            q = self.posterior(votes, known)

    def posterior(self, votes: np.ndarray, known: np.ndarray | float = 0.0) -> np.ndarray:
        """Probability of the class by the votes cast; ``known``: log odds from a source outside the voters.

        A voter that does not fire abstains: its kind or language may not be that of the text.
        """
        z = np.log(self.prior / (1 - self.prior)) + (votes * np.log(self.fire1 / self.fire0)) @ self.share + known
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Toxicity:
    """Fitted voters, label model and classifier. ``more``: unlabelled texts."""

    def __init__(self, texts, y, weight, more=()):
        y, weight = np.asarray(y, float), np.asarray(weight, float)
        self.constant = float(y.mean()) if len(y) else 0.5
        self.fitted = len(np.unique(y)) == 2
        if not self.fitted:
            return
        n1, n0 = y.sum(), len(y) - y.sum()
        log_odds = lambda toxic, every: np.log((toxic + 0.5) / (n1 + 1)) - np.log((every - toxic + 0.5) / (n0 + 1))
        low = lambda t, c: log_odds(t, c) - 2 * np.sqrt(1 / (t + 0.5) + 1 / (c - t + 0.5))
        counted = _counts(texts, y)
        one = {}  # of marks that begin alike and come in as many texts, the shortest
        for m in sorted(counted, key=lambda m: (len(m), m)):
            one.setdefault((m[: BEGINNINGS[0]], *counted[m]), m)
        good = {m: low(*counted[m]) for m in one.values()}
        best = sorted((m for m in good if good[m] > MIN_ODDS), key=lambda m: (-good[m], m))[:LEARNT_VOTERS]
        self.groups = [{m} for m in best] + [set(x) for x in LEXICONS.values()]
        everything = [*texts, *more]
        votes = np.stack([self.votes(t) for t in everything])
        known = np.append((2 * y - 1) * ANCHOR, np.zeros(len(more)))
        weight = np.append(weight, np.full(len(more), 1.0))
        start = np.append(y, np.full(len(more), (weight[: len(y)] @ y) / max(weight[: len(y)].sum(), 1e-9)))
        self.model = LabelModel(votes, start, known, weight)
        target = self.model.posterior(votes)
        #: How often the posterior of the votes alone and the label say the same.
        self.agreement = float(((target[: len(y)] >= 0.5) == (y > 0)).mean())
        rows = [features(t) for t in everything]
        count_toxic, count_all = np.zeros(2 * SLOTS), np.zeros(2 * SLOTS)
        for r, p in zip(rows, target, strict=True):
            count_all[r] += 1
            count_toxic[r] += p
        n1, n0 = target.sum(), len(target) - target.sum()
        self.used = (count_all >= MIN_DOCS) & (np.abs(log_odds(count_toxic, count_all)) > MIN_SLOT_ODDS)
        self.w, self.b = np.zeros(2 * SLOTS, np.float32), float(np.log(self.model.prior / (1 - self.model.prior)))
        self._train([r[self.used[r]] for r in rows], target, weight)

    def votes(self, text) -> np.ndarray:
        low = (text or "").lower()
        found = marks(low)
        fired = [not found.isdisjoint(g) for g in self.groups] + [bool(p.search(low)) for p in _PATTERNS]
        return np.array([*fired, not any(fired)], float)  # the last votes for clean

    def _train(self, rows, target, weight, epochs: int = 300, rate: float = 0.1) -> None:
        """Logistic regression on soft labels, full batches of Adam over the slots in use."""
        slots = np.flatnonzero(self.used)
        place = np.zeros(2 * SLOTS, np.int64)
        place[slots] = np.arange(len(slots))
        cols, owner = place[np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)], np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        w, b, m, v, mb, vb = np.zeros(len(slots)), self.b, np.zeros(len(slots)), np.zeros(len(slots)), 0.0, 0.0
        for t in range(1, epochs + 1):
            z = np.bincount(owner, w[cols], len(rows)) + b
            g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / len(rows)
            grad, gb = np.bincount(cols, g[owner], len(slots)) + 1e-4 * w, g.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
        self.w[slots], self.b = w, b

    def slim(self) -> Toxicity:
        """Without what only fitting needs."""
        self.groups = self.model = None
        return self

    def score(self, texts) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.constant)
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            r = features(t)
            z[i] = self.w[r[self.used[r]]].sum(dtype=float) + self.b
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> Toxicity:
    sample = labelled(docs, labels, "toxic", PER_CLASS, modulus, held)
    more = unlabelled(docs, labels, UNLABELLED, modulus, held) if sample["y"].nunique() == 2 else []
    return Toxicity(sample["text"].tolist(), sample["y"], sample["weight"], more)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document row; null texts count as empty.

    Whole texts of any length are scored. Rows that repeat are all returned; of
    several labels of an id the larger counts. Without labels of both classes
    every score is the mean label, or 0.5. Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, held).slim())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts.tolist()))

    held_out = (remainder(F.col("doc_id"), modulus) == held).alias("held_out")
    return docs.select("doc_id", held_out, score("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
