"""BPE encoding by backtracking over longest tokens, and decoding by an offset table.

The vocabulary is a public tokenizer file (``path``) of byte pairs with word
ends: a text is brought to NFC and lower case, cut into words by the file's
pattern, and each word is a string of byte symbols whose last one carries the
word end. A word's encoding is the only sequence of tokens in which every
neighbouring pair is compatible, that is, merging the two by rank gives the two
again. So no merges are replayed: an Aho-Corasick automaton of the tokens gives
the longest one at a place of the word, the encoder takes it if it is
compatible with the token before and else the next shorter one, and goes back
when none is left; a place from which nothing fits
is marked and never tried again, so the work is linear in the word. Compatible
pairs are looked up in a table that is filled as pairs occur.

Ids are the bytes of little-endian unsigned 32-bit integers; ``unpack`` gives
an array. Decoding gathers the tokens' bytes through a table of offsets.

One pass over the table without a shuffle; the file (a few MB, bounded by
its vocabulary) is read on the driver and broadcast. A worker holds its tables, a
bounded number of words and pairs (``REMEMBERED``), and one Arrow batch. Null and empty
texts have no tokens; long texts are encoded whole, words of any length
too; repeated rows give equal rows; an input column with the name of the output is replaced.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Bounds of what a worker remembers: entries of a generation of chunks (two are kept; half as many words and pairs), and characters of a key.
REMEMBERED, LONGEST_KEY = 250_000, 40
END = 256  # added to the last byte of a word
#: Lower-case pairs of Unicode 16 and 17 that Python's tables lack, as the public tokenizer library has them.
NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}

#: Letters and digits newer than Unicode 16, which the public tokenizer library does not take for letters.
NEW_LETTERS = (
    "\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F"
    "\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2"
    "\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE"
    "\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F"
    "\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    "\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    "\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    "\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F"
    "\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
#: Combining marks newer than Unicode 9, which that library neither reorders nor composes.
NEW_MARKS = (
    "\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B-\u0D3C"
    "\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C\U00010D24-\U00010D27"
    "\U00010EAB-\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85\U00011070\U0001133B"
    "\U0001145E\U00011839-\U0001183A\U00011930\U0001193D-\U0001193E\U00011943\U000119E0"
    "\U00011A34\U00011A47\U00011A99\U00011D42\U00011D44-\U00011D45\U00011D97"
    "\U00011F41-\U00011F42\U00016FF0-\U00016FF1\U0001E08F\U0001E130-\U0001E136\U0001E2AE\U0001E2EC-\U0001E2EF"
    "\U0001E4EC-\U0001E4EF"
)
_SEPARATOR, _SPACE = re.compile("[\x1c-\x1f]"), regex.compile(r"\s+")
_NEW_MARK = re.compile(f"([{NEW_MARKS}])")


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def lowered(text: str) -> str:
    """NFC in lower case, letter by letter (no final sigma)."""
    if text.isascii():
        return text.lower()
    parts = _NEW_MARK.split(text) if _NEW_MARK.search(text) else [text]
    return "".join(unicodedata.normalize("NFC", p) for p in parts).replace("Σ", "σ").lower().translate(NEW_LOWER)


@lru_cache(2)
def splitters(pattern: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The word pattern for Latin-1 texts, and for all others: there, letters newer than Unicode 16 are no letters."""
    wide = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{NEW_LETTERS}]]").replace(r"[\p{L}]", f"[\\p{{L}}--[{NEW_LETTERS}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{NEW_LETTERS}]]")
    return regex.compile(pattern), regex.compile(wide, regex.V1)


class Memo(dict):
    """Results of ``make`` by key, within the bounds above. What is asked for again lives on in the next generation."""

    def __init__(self, make: Callable, share: int = 1):
        super().__init__()
        self.make, self.old, self.share = make, {}, share

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, str) or len(key) <= LONGEST_KEY:
            if len(self) >= REMEMBERED // self.share:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Bpe:
    """Tables of one vocabulary and the encoder of its words."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, stop = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        byte = {sign: b for b, sign in enumerate(byte_signs())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.symbols: dict[int, str] = {}  # id: a character for each byte, END added for the last byte of a word
        for token, i in vocab.items():
            ends = token.endswith(stop) and len(token) > len(stop)
            codes = [byte[c] for c in (token[: -len(stop)] if ends else token)]
            self.symbols[i] = "".join(chr(c) for c in codes[:-1]) + chr(codes[-1] + END * ends)
        self.rank, self.parts = {}, {}  # pairs of ids: rank of their merge and id; id: rank and the two ids that it is merged of
        for r, (a, b) in enumerate(model["merges"]):
            left, right = vocab[a], vocab[b]
            whole = vocab[a + b]
            self.rank[left, right] = r
            self.parts.setdefault(whole, (r, left, right))
        self.fits, self.words, self.chunks = Memo(self._fits, 2), Memo(self._word, 2), Memo(self._chunk)
        self.length = {i: len(s) for i, s in self.symbols.items()}
        self._index(self._whole())
        by_id = {i: t for t, i in (vocab | self.special).items()}
        texts = [(by_id[i] + " ").encode() if i in by_id else b"" for i in range(size)]
        self.offsets = np.cumsum([0, *map(len, texts)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def _whole(self) -> dict[str, int]:
        """Tokens that encode to themselves; no other can stand in an encoding."""
        return {s: i for i, s in self.symbols.items() if i not in self.parts or self.compatible(*self.parts[i][1:], self.parts[i][0])}

    def _index(self, whole: dict[str, int]) -> None:
        self.automaton = ahocorasick.Automaton()
        for s, i in whole.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter = {}  # id: the longest token that it begins with, but itself
        for s, i in whole.items():
            self.shorter[i] = max(((len(p), j) for p, j in ((s[:k], whole.get(s[:k])) for k in range(1, len(s))) if j is not None), default=(0, -1))[1]

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging the symbols of both, lowest rank first and leftmost first, never merges across their border.

        Both tokens' merges are undone from the last one backward. At each
        moment the two tokens at the border must not form a pair that is
        merged before the merge just undone. ``below``: only merges across the border
        of lower rank than this count.
        """
        limit = below if below is not None else len(self.rank)
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = min(limit, a[0]), a[2]  # of equal ranks the left one is merged first
            else:
                limit, right = min(limit, b[0] + 1), b[1]

    def _fits(self, pair: int) -> bool:
        """The table of compatible pairs, filled as pairs occur: both ids in one key."""
        return self.compatible(pair >> 32, pair & 0xFFFFFFFF)

    def tokens_of(self, word: str) -> list[int]:
        """Ids of one word of the split text."""
        raw = word.encode()
        symbols = raw[:-1].decode("latin-1") + chr(raw[-1] + END)
        n, length, shorter, fits, longest = len(symbols), self.length, self.shorter, self.fits, self.automaton.iter_long
        dead, found, at, token = set(), [], 0, next(longest(symbols))[1]
        while True:
            end = at + length[token]
            if end not in dead and (not found or fits[found[-1] << 32 | token]):
                found.append(token)
                if end == n:
                    return found
                at, token = end, next(longest(symbols, end))[1]
            elif (token := shorter[token]) < 0:
                dead.add(at)
                token = found.pop()
                at -= length[token]

    def _word(self, word: str) -> bytes:
        found = self.tokens_of(word)
        return struct.pack(f"<{len(found)}I", *found)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space."""
        chunk = lowered(chunk)
        words = splitters(self.pattern)[not chunk.isascii() and max(chunk) > "\xff"].findall(chunk)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed. Special tokens of the file stand for themselves wherever their strings occur."""
        if self.specials and "<" in text and self.specials.search(text):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        # Neither words nor compositions reach across white space. split() also cuts at U+001C to U+001F, which are no white space here.
        chunks = _SPACE.split(text) if _SEPARATOR.search(text) else (text.lower() if text.isascii() else text).split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, packed: bytes) -> str:
        """Tokens of the ids as the file writes them, joined by spaces, word ends and special tokens included."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)].tobytes()[:-1].decode()


_TABLES: dict[str, Bpe] = {}


def tables_of(content: str) -> Bpe:
    """This worker's tables of a tokenizer file, those of one file at a time; later queries with the same file find them filled."""
    if content not in _TABLES:
        _TABLES.clear()
        _TABLES[content] = Bpe(content)
    return _TABLES[content]


def load(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file of this machine, or of a store that Spark reads, broadcast as it is; a few MB, the size of its vocabulary."""
    content = spark.read.text(path, wholetext=True).first()[0] if "://" in path else Path(path).read_text(encoding="utf-8")
    return spark.sparkContext.broadcast(content)


def encode_with(model: Broadcast, text: Column) -> Column:
    """Packed ids of a column of texts; null counts as empty."""

    @F.arrow_udf(BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        tables = tables_of(model.value)
        return pa.array([tables.encode(t.as_py()) for t in texts], pa.binary())

    # so marked, Spark keeps it to one place in the plan and does not encode anew for each use of the ids
    return encode.asNondeterministic()(F.coalesce(text, F.lit("")))


def decode_with(model: Broadcast, ids: Column) -> Column:
    """Texts of a column of packed ids."""

    @F.arrow_udf(StringType())
    def decode(packed: pa.Array) -> pa.Array:
        tables = tables_of(model.value)
        return pa.array([None if p is None else tables.decode(p) for p in packed.to_pylist()], pa.string())

    return decode(ids)


def encode_and_decode_with(model: Broadcast, text: Column) -> Column:
    """``ids, decoded`` in one pass: a worker decodes the ids that it has just made, so its tables are held once."""

    @F.arrow_udf(StructType([StructField("ids", BinaryType()), StructField("decoded", StringType())]))
    def both(texts: pa.Array) -> pa.Array:
        tables = tables_of(model.value)
        ids = pa.array([tables.encode(t.as_py()) for t in texts], pa.binary())
        return pa.StructArray.from_arrays([ids, pa.array([tables.decode(p.as_py()) for p in ids], pa.string())], ["ids", "decoded"])

    return both.asNondeterministic()(F.coalesce(text, F.lit("")))


def unpack(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    number = lambda i: F.conv(F.concat(*[F.hex(F.substring(ids, i * 4 + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("int")
    at = F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int"))
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<int>")).otherwise(F.transform(at, number))


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (packed) and ``n_tokens`` of their texts, on demand with the text that these ids decode to."""
    model = load(docs.sparkSession, path)
    if decoded:
        done = docs.withColumn("ids", encode_and_decode_with(model, F.col("text"))).withColumns({"decoded": F.col("ids.decoded"), "ids": F.col("ids.ids")})
    else:
        done = docs.withColumn("ids", encode_with(model, F.col("text")))
    return done.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""
    return encoded.withColumn("decoded", decode_with(load(encoded.sparkSession, path), F.col("ids")))


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    done = encode_documents(docs.select("doc_id", "text"), path, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
