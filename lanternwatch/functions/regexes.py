"""Patterns written once and rendered for Spark (Java) and for the SQL oracle (RE2)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from operator import and_, or_
from re import _constants, _parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word boundary over ASCII word characters; Java's own may follow Unicode.
_ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_CONTROL_PAIR = "\x01$0\x02"


@dataclass(frozen=True)
class Pattern:
    """``flags``: any of i (case), s (dot matches newline), m (lines).

    ``needs``: a cheap pattern that occurs wherever this one does; it is tried first.
    ``ascii``: for texts of ASCII alone, where Java's own word boundary will do.
    """

    name: str
    regex: str
    flags: str = ""
    risk: str = "HIGH"
    group: str = "standard"
    needs: str = ""
    ascii: bool = False

    @property
    def java(self) -> str:
        flags = self.flags + ("u" if "i" in self.flags and not self.regex.isascii() else "")
        return (f"(?{flags})" if flags else "") + (self.regex if self.ascii else self.regex.replace(r"\b", _ASCII_BOUNDARY))

    @property
    def re2(self) -> str:
        return (f"(?{self.flags})" if self.flags else "") + self.regex

    def occurs(self, r: Column) -> Column:
        """Whether it occurs in a text, given its ``readings``: the literals it cannot do without are looked for first."""
        have = [(r["folded"] if "i" in self.flags else r["text"]).contains(folded(x) if "i" in self.flags else x) for x in literals(self.regex)]
        first = [reduce(or_, have)] if have else []
        if _NUMERIC.fullmatch(self.regex):
            first.append(r["digits"].rlike(self.regex.replace(r"\b", "")))
        hit = r["words"].rlike(replace(self, ascii=True).java) if self.regex.isascii() else r["text"].rlike(self.java)
        return reduce(and_, [*first, hit])

    def values(self, r: Column) -> Column:
        """All matches in a text, given its ``readings``."""
        same = self.regex.isascii() and "[^" not in self.regex  # else a match may hold other characters than ASCII
        found = F.regexp_extract_all(r["words"], F.lit(replace(self, ascii=True).java), F.lit(0)) if same else F.regexp_extract_all(r["text"], F.lit(self.java), F.lit(0))
        return F.when(self.occurs(r), found).when(r["text"].isNotNull(), F.array().cast("array<string>"))

    def found(self, text: Column) -> Column:
        return text.rlike(self.needs) & text.rlike(self.java) if self.needs else text.rlike(self.java)

    def sql_found(self, text: str) -> str:
        return f"regexp_matches({text}, {quoted(self.re2)})"

    def all(self, text: Column, group: int = 0) -> Column:
        found = F.regexp_extract_all(text, F.lit(self.java), F.lit(group))
        return F.when(text.rlike(self.needs), found).when(text.isNotNull(), F.array().cast("array<string>")) if self.needs else found

    def sql_all(self, text: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {quoted(self.re2)}, {group})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), body), 0)


#: Characters that Java takes for these letters where case is ignored over all of Unicode.
_FOLDED_FROM, _FOLDED_TO = "\u0130\u0131\u017f\u212a", "iisk"
_NOT_ASCII = "[^\\x00-\\x7F\\x85\\u2028\\u2029]"
#: Pieces of patterns that hold nothing but digits, brackets, white space and ``./+-``.
_NUMERIC = re.compile(r"(?:\\[bds.\-/()+]|[\[\](){}?|:0-9,.\-\s+])+")


def folded(literal: str) -> str:
    """A literal as it stands in the ``folded`` form of a text."""
    known = literal.translate(str.maketrans(_FOLDED_FROM, _FOLDED_TO))
    return "".join(c if c.isascii() else "\x03" for c in known).lower()


def readings(text: Column) -> Column:
    """Forms of a text that patterns look at: struct(text, words, folded, digits), null for null.

    ``words``: one control character for each letter outside ASCII, so that Java's own word boundary is the one over ASCII and
    offsets in code points stay. Line ends outside ASCII stay too. ``folded``: ``words`` without case, for literals.
    ``digits``: the runs of digits and what stands between them in numbers.
    """
    plain = F.octet_length(text) == F.char_length(text)
    words = F.when(plain, text).otherwise(F.regexp_replace(text, _NOT_ASCII, "\x03"))
    other = F.when(~plain & text.rlike(f"[{_FOLDED_FROM}]"), F.regexp_replace(F.translate(text, _FOLDED_FROM, _FOLDED_TO), _NOT_ASCII, "\x03"))
    digits = lambda w: F.array_join(F.regexp_extract_all(w, F.lit(r"[0-9(+][0-9()+./\s-]*"), F.lit(0)), "|")
    return F.when(text.isNotNull(), let(words, lambda w: F.struct(text.alias("text"), w.alias("words"), F.lower(F.coalesce(other, w)).alias("folded"), digits(w).alias("digits"))))


@lru_cache(maxsize=1024)
def literals(regex: str, most: int = 6) -> tuple[str, ...]:
    """Strings of which every match holds at least one, the fewest and longest; none where no few are known."""

    def needed(nodes) -> tuple[str, ...]:
        options, run = [], ""
        for op, arg in [*nodes, (None, None)]:
            if op is _constants.LITERAL:
                run += chr(arg)
                continue
            options.append((run,) if run else ())
            run = ""
            if op is _constants.SUBPATTERN:
                options.append(needed(arg[-1]))
            elif op is _constants.BRANCH:
                each = [needed(x) for x in arg[1]]
                options.append(tuple(dict.fromkeys(y for x in each for y in x)) if all(each) else ())
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[0] > 0:
                options.append(needed(arg[2]))
        return max((o for o in options if o and len(o) <= most), key=lambda o: (min(map(len, o)) > 2, -len(o), min(map(len, o))), default=())

    return needed(_parser.parse(regex))


#: Letters outside ASCII that RE2 takes for k and s where case is ignored, and Java does not in patterns of ASCII.
ODD_LETTERS = "[\u017f\u212a]"


@lru_cache(maxsize=1)
def _cases() -> dict[str, str]:
    """Letters that Java takes for one another where case is ignored over all of Unicode, by what they fold to."""
    found: dict[str, str] = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))):
        found[_fold(c)] = found.get(_fold(c), "") + c
    return found


def _fold(c: str) -> str:
    upper = c.upper() if len(c.upper()) == 1 else c
    return upper.lower() if len(upper.lower()) == 1 else upper.lower()[0]


def _piece(c: str, any_case: bool) -> str:
    """One character of a literal for RE2."""
    return "".join(["[", *(rf"\x{{{ord(x):X}}}" for x in (_cases()[_fold(c)] if any_case else c)), "]"])


def _re2(p: Pattern, without: Sequence[str] = ()) -> str:
    """An ASCII pattern with Java's white space, which has one character more than RE2's; some of its anchors left out."""
    out, inside = "", False
    for x in re.findall(r"\\.|.", p.regex, re.S):
        if x in ("[", "]"):
            inside = x == "["
        if inside or x not in without:
            out += {r"\s": r"\s\x0B" if inside else r"[\s\x0B]"}.get(x, x)
    flags = "".join(f for f in p.flags if f in "is")
    return f"(?{flags}:{out})" if flags else f"(?:{out})"


def hint(p: Pattern, parts: bool = False) -> str:
    """A pattern for RE2 that occurs in every text in which ``p`` does, and with ``parts`` in every text of which ``p`` occurs in some part.

    It finds a little more than ``p``: lines begin in fewer places in RE2, and of letters outside ASCII, literals (``literals``) in any case are enough.
    """
    if not p.regex.isascii():
        return "|".join("".join(_piece(c, "i" in p.flags) for c in x) for x in literals(p.regex)) or "(?s:.)"
    return _re2(p, ("^", "$", r"\b") if parts else ("^", "$"))


def sure(p: Pattern) -> str | None:
    """A pattern for RE2 that occurs where ``p`` does and nowhere else, in texts without ``ODD_LETTERS``; None where the two disagree on lines."""
    return _re2(p) if p.regex.isascii() and not re.search(r"[.^$]|\[\^", re.sub(r"\\.", "", p.regex)) else None


def hinted(text: Column, groups: dict[str, Sequence[str]]) -> Column:
    """struct of booleans: whether any of a group's ``hint`` patterns occurs in a text, false for null.

    All patterns of a group are one automaton (RE2, over Arrow), which passes over a text once. What may occur is then looked at closely.
    """
    joined = {name: "|".join(dict.fromkeys(patterns)) for name, patterns in groups.items()}

    @F.arrow_udf(T.StructType([T.StructField(name, T.BooleanType()) for name in joined]))
    def occur(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.fill_null(pc.match_substring_regex(texts, x), False) for x in joined.values()], names=list(joined))

    return occur(text)


def by_width(text: Column, patterns: Sequence[Pattern], make: Callable[[list[Pattern]], Column]) -> Column:
    """``make(patterns)`` of a text column; ASCII rows take the cheaper word boundary."""
    return F.when(F.octet_length(text) == F.char_length(text), make([replace(p, ascii=True) for p in patterns])).otherwise(make(list(patterns)))


def quoted(s: str) -> str:
    """SQL string literal; newlines and control characters are left as they are."""
    return "'" + s.replace("'", "''") + "'"


def spans(text: Column, java: str) -> Column:
    """``array<struct<s, e, m>>`` of all matches: start and end in code points from 0, and the matched text.

    Marks every match with two control characters and walks the pieces between
    them. Those of the input count as another control character, so that every
    offset is one of the text as it came.
    """
    clean = F.when(text.rlike("[\x01\x02]"), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
    return F.when(clean.rlike(java), marked_spans(clean, java)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def marked_spans(clean: Column, java: str) -> Column:
    """``spans`` of a text without these two control characters."""
    pieces = F.split(F.regexp_replace(clean, java, _CONTROL_PAIR), "\x01")
    start = F.struct(F.char_length(pieces[0]).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        m = F.substring_index(piece, "\x02", 1)
        n = F.char_length(m)
        found = F.struct(acc["at"].alias("s"), (acc["at"] + n).alias("e"), m.alias("m"))
        return F.struct((acc["at"] + F.char_length(piece) - 1).alias("at"), F.array_append(acc["found"], found).alias("found"))

    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda acc: acc["found"])
