"""Conversation structure repair by least weights over a DAG of edits.

Turns are kept, given another role, deleted, or empty ones are inserted, until
the initials of the roles read ``(s?(ua)+)?``. An edit's weight is one integer: its
cost stands in the high digits, its letter in the octal digit of its place in
the audit string; digits past the end are zero, so a shorter audit comes first.
Adding weights along a path and taking the least integer for each (row,
state) decides cost and ties at once. Nothing else chooses.

A conversation may be of any length. Its rows are range-partitioned by
conversation and turn, so that a long one lies in many tasks, and cut into
blocks of ``BLOCK`` rows. A block's letters always end with a row's own edit
(inserts stand before a row), so no audit of a block begins another, and what
follows never decides between two of them: a block is summed up by
its least costs from each of the four states to each, and the order of the
audits behind them. One fold over these sums (one row for ``BLOCK`` rows) picks the
states between the blocks, and each block then gives its letters by itself.
Rows equal in all columns are told apart by a running number, so even a
turn repeated a million times is dealt out. Only the digest of a repaired
conversation is sequential: it streams through one task, batch by batch.

Null roles and texts count as one space. Turns are taken in order, null ones first,
those of equal turn by role, text (its first ``LEAD`` characters, then its
digest). Null ``conv_id`` is a conversation of its own. Repeated
rows are faults (duplicates), texts of any length are judged whole, empty tables
give empty results, and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternwatch.llm.common import materialize

BLOCK = 1024  # rows of a block, a power of two
LEAD = 100
WHITE = " \t\n\x0b\x0c\r"
#: States after a row: nothing yet, after a system turn, after a user turn, after an assistant turn. The first and last may end.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
LETTERS = "DIKR"  # their octal digits are 1 to 4, in ASCII order
DELETE, INSERT, REROLE, UNDONE = 4, 3, 3, 3  # costs; a kept row that is truncated costs UNDONE more
CLASSES = "sua?"
#: What has to be inserted at the end, by state.
TAILS = ("", "II", "I", "")


def _next(state: int) -> int:
    """The state after a turn of the only role of the two that may follow."""
    return ASSISTANT if state == USER else USER


def _keep(state: int, kind: str) -> int | None:
    if kind == "s":
        return SYSTEM if state == START else None
    return _next(state) if kind == ("a" if state == USER else "u") else None


@lru_cache(64)
def edges(code: str) -> tuple[tuple[int, int, int, int, int], ...]:
    """Edits of a row, inserts before it included: ``state, next state, cost, octal digits, number of letters``, the least for each two states.

    A third insert in a row would come back to a state passed before, so two are enough.
    """
    kind, must_go, cut = decode(code)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for first in STATES:
        state = first
        for inserts in range(3):
            own = [("D", state, DELETE)]
            if not must_go:
                own.append(("R", _next(state), REROLE + UNDONE * cut))
                if (kept := _keep(state, kind)) is not None:
                    own.append(("K", kept, UNDONE * cut))
            for letter, to, cost in own:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                best[first, to] = min(found, best.get((first, to), found))
            state = _next(state)
    return tuple((a, b, cost, int("".join(str(LETTERS.index(x) + 1) for x in letters), 8), len(letters)) for (a, b), (cost, letters) in sorted(best.items()))


def encode(kind: Column, must_go: Column, cut: Column) -> Column:
    """One character a row: the initial's class, whether it has to be deleted, whether it is truncated."""
    return F.char(F.lit(65) + kind + F.when(must_go, 4).otherwise(0) + F.when(cut, 8).otherwise(0))


def decode(code: str) -> tuple[str, bool, bool]:
    n = ord(code) - 65
    return CLASSES[n & 3], bool(n & 4), bool(n & 8)


def weigh(codes: str, start: int) -> list[int | None]:
    """Least weight from ``start`` through all rows to each state: cost above ``9 * len(codes)`` bits, audit below, three bits a letter."""
    width = 9 * len(codes)
    at: dict[int, tuple[int, int]] = {start: (0, width)}  # weight, bits still free
    for code in codes:
        reached: dict[int, tuple[int, int]] = {}
        for state, to, cost, digits, letters in edges(code):
            if state in at:
                weight, free = at[state]
                free -= 3 * letters
                weight += (cost << width) + (digits << free)
                if to not in reached or weight < reached[to][0]:
                    reached[to] = weight, free
        at = reached
    return [at[s][0] if s in at else None for s in STATES]


@lru_cache(20_000)
def summary(codes: str) -> tuple[list[int], list[int], int]:
    """Least costs from each state to each (-1: no way), the places of their audits in order, and pairs of neighbours that may not be."""
    width, costs, ranks = 9 * len(codes), [], []
    for start in STATES:
        weights = weigh(codes, start)
        audits = sorted(w & ((1 << width) - 1) for w in weights if w is not None)
        costs += [-1 if w is None else w >> width for w in weights]
        ranks += [-1 if w is None else audits.index(w & ((1 << width) - 1)) for w in weights]
    kinds = [decode(c)[0] for c in codes]
    return costs, ranks, sum(clash(a, b) for a, b in zip(kinds, kinds[1:], strict=False))


def clash(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def route(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a conversation and the states before and after each of its blocks."""
    ahead, picks = [INSERT * len(t) for t in TAILS], []
    for cost, rank in zip(reversed(costs), reversed(ranks), strict=True):
        best = [min((cost[4 * a + b] + ahead[b], rank[4 * a + b], b) for b in STATES if cost[4 * a + b] >= 0) for a in STATES]
        picks.append([b for *_, b in best])
        ahead = [total for total, *_ in best]
    path, state = [], START
    for pick in reversed(picks):
        path.append((state, pick[state]))
        state = pick[state]
    return ahead[START], path


@lru_cache(20_000)
def audit(codes: str, start: int, end: int) -> str:
    """The letters of a block's least weight between two states."""
    width = 9 * len(codes)
    digits = format(weigh(codes, start)[end] & ((1 << width) - 1), "o").zfill(width // 3)
    return digits.rstrip("0").translate(str.maketrans("1234", LETTERS))


@lru_cache(20_000)
def scripts(codes: str, letters: str, start: int) -> list[str]:
    """What each row becomes: ``K`` itself, ``U``/``A`` itself as user/assistant, ``u``/``a`` an inserted turn. Letters past the last row belong to it."""
    out, state, row = [""] * len(codes), start, 0
    for letter in letters:
        at = min(row, len(codes) - 1)
        if letter in "IR":
            state = _next(state)
            out[at] += ("u" if state == USER else "a") if letter == "I" else ("U" if state == USER else "A")
        elif letter == "K":
            state = _keep(state, decode(codes[row])[0])
            out[at] += "K"
        row += letter != "I"
    return out


_SUMMARY = T.StructType([T.StructField("costs", T.ArrayType(T.IntegerType())), T.StructField("ranks", T.ArrayType(T.IntegerType())), T.StructField("clashes", T.LongType())])
_STEP = T.StructType([T.StructField("block", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tail", T.StringType())])
_ROUTE = T.StructType([T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("gaps", T.LongType()), T.StructField("path", T.ArrayType(_STEP))])
_EDITS = T.StructType([T.StructField("letters", T.StringType()), T.StructField("scripts", T.ArrayType(T.StringType()))])


def _arrow(kind: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@F.arrow_udf(_SUMMARY)
def _summary(codes: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("costs", "ranks", "clashes"), summary(c), strict=True)) for c in codes.to_pylist()], _arrow(_SUMMARY))


@F.arrow_udf(_ROUTE)
def _route(blocks: pa.Array) -> pa.Array:
    out = []
    for parts in blocks.to_pylist():
        cost, path = route([b["costs"] for b in parts], [b["ranks"] for b in parts])
        joints = list(zip(parts, parts[1:], strict=False))
        illegal = sum(b["clashes"] for b in parts) + sum(clash(decode(a["last"])[0], decode(b["first"])[0]) for a, b in joints)
        turned = [b for b in parts if b["n_turns"]]
        distinct = sum(b["n_turns"] for b in turned) - sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:], strict=False))
        gaps = turned[-1]["high"] - turned[0]["low"] + 1 - distinct if turned else 0
        steps = [{"block": b["block"], "start": s, "end": e, "tail": ""} for b, (s, e) in zip(parts, path, strict=True)]
        steps[-1]["tail"] = TAILS[path[-1][1]]
        out.append({"cost": cost, "illegal": illegal, "gaps": gaps, "path": steps})
    return pa.array(out, _arrow(_ROUTE))


@F.arrow_udf(_EDITS)
def _edits(codes: pa.Array, start: pa.Array, end: pa.Array, tail: pa.Array) -> pa.Array:
    rows = zip(codes.to_pylist(), start.to_pylist(), end.to_pylist(), tail.to_pylist(), strict=True)
    out = []
    for c, s, e, t in rows:
        letters = audit(c, s, e) + t
        out.append({"letters": letters, "scripts": scripts(c, letters, s)})
    return pa.array(out, _arrow(_EDITS))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the crc32 of ``conv_id:turn``.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 takes ``.!?`` out
    of it, 3 repeats the row, 4 makes the role ``user``. Nulls count as one space.
    """
    blank = F.lit(" ")
    k = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id", "turn",
        F.when(k == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(k == 0, 0).when(k == 3, 2).otherwise(1))).alias("_"),
    )
    return rows.drop("_")


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest, place``: places rise within each conversation. Written, since places have to stay."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "lead": F.substring("text", 1, LEAD), "copy": F.monotonically_increasing_id()})
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "lead", "digest", "copy"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(dealt.drop("lead", "copy").withColumn("place", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, place, blank, duplicate, truncated, code`` of ``ordered`` rows; the first fault of a row counts."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    light = rows.select("conv_id", "turn", "role", "digest", "place", (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(*".!?")).alias("open"))
    light = light.join(first, light["conv_id"].eqNullSafe(F.col("_c")) & (light["role"] == F.col("_r")) & (light["digest"] == F.col("_d")), "left")
    again = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    judged = light.withColumn("duplicate", again).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return judged.select("conv_id", "turn", "place", "blank", "duplicate", "truncated", encode(kind, F.col("blank") | F.col("duplicate"), F.col("truncated")).alias("code"))


def blocks(judged: DataFrame) -> DataFrame:
    """A row for each block of a conversation: its places, codes, sums of faults, turns and the least costs between states."""
    number = F.shiftright("place", BLOCK.bit_length() - 1)
    rows = judged.groupBy("conv_id", number.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("n_turns"),
    )
    coded = rows.select("conv_id", "block", "blank", "duplicate", "truncated", "low", "high", "n_turns", F.col("rows.place").alias("places"), F.array_join("rows.code", "").alias("codes"))
    return materialize(coded.withColumn("sums", _summary(F.col("codes"))), "blocks")


def routes(parts: DataFrame) -> DataFrame:
    """A row for each conversation: its sums, and the states before and after each of its blocks."""
    light = F.struct("block", "sums.costs", "sums.ranks", "sums.clashes", F.substring("codes", 1, 1).alias("first"), F.substring("codes", -1, 1).alias("last"), "low", "high", "n_turns")
    sums = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(light)).alias("blocks"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    return sums.withColumn("route", _route(F.col("blocks"))).select("conv_id", "blank", "duplicate", "truncated", "route.*")


def edits(parts: DataFrame, routed: DataFrame) -> DataFrame:
    """``conv_id, block, letters, places, scripts`` of each block."""
    steps = routed.select(F.col("conv_id").alias("_c"), F.inline("path")).withColumnRenamed("block", "_b")
    joined = parts.join(steps, parts["conv_id"].eqNullSafe(F.col("_c")) & (parts["block"] == F.col("_b")))
    done = joined.withColumn("done", _edits(F.col("codes"), F.col("start"), F.col("end"), F.col("tail")))
    return done.select("conv_id", "block", "places", "done.letters", "done.scripts")


def lines(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """``conv_id, place, turns`` of the repaired conversations: for each place an array of ``role, text`` that stands there."""
    scripted = edited.select(F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("scripts").alias("script")))).where("script <> ''").withColumnRenamed("place", "_p")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    user, assistant, nothing = F.lit("user"), F.lit("assistant"), F.lit("")
    each = lambda c: (
        F.when(c == "K", turn(F.col("role"), F.col("text"))).when(c == "U", turn(user, F.col("text"))).when(c == "A", turn(assistant, F.col("text"))).when(c == "u", turn(user, nothing)).otherwise(turn(assistant, nothing))
    )
    joined = rows.join(scripted, F.col("place") == F.col("_p"))
    return joined.select("conv_id", "place", F.transform(F.split("script", ""), each).alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines as they stream by, sorted."""
    current, running = None, None
    for batch in batches:
        ids, done = batch.column(0).to_pylist(), []
        for conv, line in zip(ids, batch.column(1), strict=True):
            if running is None or conv != current:
                if running is not None:
                    done.append((current, running.hexdigest()))
                current, running = conv, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(line.as_buffer())
        if done:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in done], batch.column(0).type), "repaired_sha256": [h for _, h in done]})
    if running is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([current], batch.column(0).type), "repaired_sha256": [running.hexdigest()]})


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations (``conv_id, place, n, role, text``, in order of ``place, n``) and a report of each.

    The report has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    rows = ordered(turns)
    parts = blocks(faults(rows))
    routed = materialize(routes(parts), "routes")
    edited = materialize(edits(parts, routed), "edits")
    fixed = lines(rows, edited)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").cast("binary")
    streamed = fixed.select("conv_id", "place", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    digests = streamed.mapInArrow(_hashed, T.StructType([fixed.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))
    letters = edited.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "letters")))["letters"], "").alias("audit"))
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = routed.select("conv_id", *sums).unionByName(letters, True).unionByName(digests, True).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*sums, "audit", "repaired_sha256"]])
    empty = hashlib.sha256().hexdigest()
    report = every.fillna(0, sums).fillna("", ["audit"]).fillna(empty, ["repaired_sha256"])
    return fixed.select("conv_id", "place", F.posexplode("turns").alias("n", "_t")).select("conv_id", "place", "n", "_t.role", "_t.text"), report


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table: the report of its damaged rows; zeros and an empty audit where damage leaves none."""
    report = repair(damage(conversations))[1]
    named = conversations.select("conv_id").distinct()
    every = named.unionByName(report, True).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in report.columns if c != "conv_id"])
    return every.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"]).fillna(hashlib.sha256().hexdigest(), ["repaired_sha256"])
