"""Conversation structure repair: cost layers of reachable grammar states, Wu-Manber style, by segments of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_tasks, table, written

BLANK = r"[^\x20\x09-\x0D]"
#: Turns of a segment, which one task traces at once; a turn repeated more often than this takes several of them.
SEGMENT = 512
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40

# The grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Where each initial leads, and what may follow.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The one role an edit may give in a state, and the state after it.
MADE = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
#: At a conversation's end: the inserts a state still needs.
TAIL = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in, by crc32 of ``conv:turn`` modulo 20.

    0 drops the turn, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it the user's.
    A null role or text is one space, and so are null numbers where they are hashed.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    d = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return d.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(times).alias("n")).drop("n")


def keyed(rows: DataFrame, *more: Column) -> DataFrame:
    """A turn by its key: conversation and turn as structs, in which nulls are equal, role, and the text's digest of 128 bits."""
    return rows.select(F.struct(F.col("conv").alias("v")).alias("conv"), F.struct(F.col("turn").alias("v")).alias("turn"), "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), *more)


KEY = ["conv", "turn", "role", "digest"]


def judged(rows: DataFrame) -> DataFrame:
    """One row for equal turns of a conversation: KEY, ``copies``, and the ``fault`` of the first of them.

    Equal turns meet in an aggregate first, so one repeated without end is a row a task; what was
    said at an earlier turn is told by the least turn of each (role, digest). Faults: b blank,
    d duplicate, t truncated, - none. Later copies are blank, or duplicates. Texts don't move.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = F.when(~F.col("text").rlike(BLANK), "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    one = keyed(rows, own.alias("own")).groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("own").alias("own"))
    first = one.groupBy("conv", "role", "digest").agg(F.min("turn").alias("first"))
    fault = F.when(F.col("own") == "b", "b").when(F.col("turn") > F.col("first"), "d").otherwise(F.col("own"))
    return one.join(first, ["conv", "role", "digest"]).select(*KEY, "copies", fault.alias("fault"))


# --- layers ------------------------------------------------------------------------------------
# A layer holds, for one cost, sixteen bits: bit 4 s + f says that from state s the rest of a segment can end in state f at that
# cost. All layers of a place stand in one integer, the cheapest lowest, so an edit is a mask and two shifts. Turns that must go
# change no state and only add to the cost; they stand outside the layers.


@lru_cache(4096)
def _lane(state: int, layers: int) -> int:
    """Bits of the rows of ``state`` in all layers."""
    return (0b1111 << 4 * state) * (((1 << 16 * layers) - 1) // 0xFFFF)


def _moved(after: int, layers: int, ways: list[tuple[int, int]]) -> int:
    """States from which one of ``ways`` (state, state after it) leads into ``after``."""
    out = 0
    for a, b in ways:
        hit = after & _lane(b, layers)
        out |= hit << 4 * (a - b) if a >= b else hit >> 4 * (b - a)
    return out


KEPT = {c: [(s, t) for (s, x), t in NEXT.items() if x == c] for c in "suao"}
MAKING = [(s, t) for s, (_, t) in MADE.items()]


def layers_of(turns: list[tuple[str, int]]) -> list[int]:
    """Layers before each turn of a segment, and after the last. A turn is its initial and what its text costs if it stays."""
    most = DELETE * len(turns) + 2 * INSERT + 1
    full = (1 << 16 * most) - 1
    out = [0x8421]  # each state is its own end, at no cost
    for c, stays in reversed(turns):
        after = out[-1]
        here = after << 16 * DELETE
        here |= _moved(after, most, KEPT[c]) << 16 * stays
        here |= _moved(after, most, MAKING) << 16 * (stays + REROLE)
        for _ in range(2):  # more inserts in one place only come back to a state
            here |= _moved(here, most, MAKING) << 16 * INSERT
        out.append(here & full)
    return out[::-1]


def least(layers: int) -> list[int]:
    """The first layer that holds each of the sixteen bits; NEVER where none does."""
    out, c, open_ = [NEVER] * 16, 0, 0xFFFF
    while layers and open_:
        skip = ((layers & -layers).bit_length() - 1) // 16
        c, layers = c + skip, layers >> 16 * skip
        new = layers & open_
        for b in range(16):
            if new >> b & 1:
                out[b] = c
        open_ &= ~new
        c, layers = c + 1, layers >> 16
    return out


def parsed(marks: str) -> tuple[list[tuple[str, int]], int]:
    """Turns that may stay, and how many must go, of a segment's marks: an initial and a fault a turn."""
    turns = [(c, TRUNCATED * (f == "t")) for c, f in zip(marks[::2], marks[1::2]) if f in "-t"]
    return turns, len(marks) // 2 - len(turns)


def trace(marks: str, state: int, need: list[int], end: bool = False) -> tuple[str, list[tuple[int, str, str | None, int | None]], int]:
    """The ASCII-least of the cheapest edits of a segment entered in ``state``: audit, what stands after it, last state.

    ``need`` is what the rest of the conversation costs from each state; ``end``: nothing follows,
    so the inserts that the last state needs are added. What stands is (step, edit, role it is given, which
    of the turns that may stay). An edit is on a cheapest way where what it leads to is in the layer
    of the cost that is left.
    """
    turns, _ = parsed(marks)
    at = layers_of(turns)
    cost = least(at[0])
    left = min(cost[4 * state + f] + need[f] for f in range(4))
    able = lambda i, s, r: any(r >= need[f] and at[i] >> (16 * (r - need[f]) + 4 * s + f) & 1 for f in range(4))
    audit: list[str] = []
    stand: list[tuple[int, str, str | None, int | None]] = []
    i = 0
    for fault in marks[1::2]:
        edit = ""
        while edit in ("", "I"):
            role, made = MADE[state]
            if fault not in "-t":
                edit, to, paid = "D", state, 0
            elif able(i + 1, state, left - DELETE):
                edit, to, paid = "D", state, DELETE
            elif able(i, made, left - INSERT):
                edit, to, paid = "I", made, INSERT
            elif (state, turns[i][0]) in NEXT and able(i + 1, NEXT[state, turns[i][0]], left - turns[i][1]):
                edit, to, paid = "K", NEXT[state, turns[i][0]], turns[i][1]
            else:
                edit, to, paid = "R", made, turns[i][1] + REROLE
            if edit != "D":
                stand.append((len(audit), edit, None if edit == "K" else role, None if edit == "I" else i))
            audit.append(edit)
            state, left = to, left - paid
        i += fault in "-t"
    while end and TAIL[state]:
        stand.append((len(audit), "I", MADE[state][0], None))
        audit.append("I")
        state = MADE[state][1]
    return "".join(audit), stand, state


PAIRS = {"su", "ua", "au"}


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment: costs from state to state, pairs of initials that the grammar lacks, first and last initial."""
    for b in batches:
        costs, bad, ends = [], [], []
        for m in b.column("marks").to_pylist():
            turns, gone = parsed(m)
            costs.append([c + DELETE * gone for c in least(layers_of(turns)[0])])
            bad.append(sum(p + q not in PAIRS for p, q in zip(m[::2], m[2::2])))
            ends.append(m[0] + m[-2])
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("seg"), pa.array(costs, pa.list_(pa.int64())), pa.array(bad, pa.int64()), pa.array(ends)], names=["conv", "part", "seg", "costs", "bad", "ends"])


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation: its cost, its bad pairs, and what follows each of its segments, in order, costs from each state."""
    for b in batches:
        costs, bad, needs = [], [], []
        for segs in b.column("segs").to_pylist():
            need = [[INSERT * TAIL[s] for s in range(4)]]
            for s in reversed(segs):
                need.append([min(NEVER, *(s["costs"][4 * a + f] + need[-1][f] for f in range(4))) for a in range(4)])
            costs.append(need.pop()[START])
            bad.append(sum(s["bad"] for s in segs) + sum(p["ends"][1] + q["ends"][0] not in PAIRS for p, q in zip(segs, segs[1:])))
            needs.append([{"part": s["part"], "seg": s["seg"], "need": n, "n": len(segs), "k": k} for k, (s, n) in enumerate(zip(segs, reversed(need)))])
        kind = pa.list_(pa.struct([("part", pa.int32()), ("seg", pa.int64()), ("need", pa.list_(pa.int64())), ("n", pa.int64()), ("k", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(costs, pa.int64()), pa.array(bad, pa.int64()), pa.array(needs, kind)], names=["conv", "cost", "illegal", "needs"])


_STAND = pa.list_(pa.struct([("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("row", pa.int64())]))
_WAYS = pa.list_(pa.struct([("audit", pa.string()), ("exit", pa.int32()), ("stand", _STAND)]))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment its edits, for each state it may be entered in: the first of a conversation in one alone."""
    for b in batches:
        out = []
        for marks, free, need, n, k in zip(*(b.column(c).to_pylist() for c in ("marks", "free", "need", "n", "k"))):
            ways = []
            for s in range(4 if k else 1):
                audit, stand, last = trace(marks, s, need, k == n - 1)
                ways.append({"audit": audit, "exit": last, "stand": [{"step": a, "edit": e, "role": r, "row": None if i is None else free[i]} for a, e, r, i in stand]})
            out.append(ways)
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("seg"), pa.array(out, _WAYS)], names=["conv", "part", "seg", "ways"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each segment of a conversation is entered in."""
    for b in batches:
        out = []
        for segs in b.column("segs").to_pylist():
            state, rows = START, []
            for s in segs:
                rows.append({"part": s["part"], "seg": s["seg"], "state": state})
                state = s["exits"][state]
            out.append(rows)
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("seg", pa.int64()), ("state", pa.int32())])))], names=["conv", "entries"])


class Repair:
    """What ``repair`` found. ``conversations``: conv, cost, illegal, audit. ``turns``: KEY, copies, fault and place of each
    turn. ``edits``: conv, part, seg, audit and what stands of each segment; (part, seg, step) is the order within a conversation."""

    def __init__(self, turns: DataFrame, edits: DataFrame, conversations: DataFrame):
        self.turns, self.edits, self.conversations = turns, edits, conversations

    def rows(self, rows: DataFrame) -> DataFrame:
        """The repaired conversations: (conv, part, seg, step, edit, role, text); ``rows`` are those ``repair`` was given."""
        e = self.edits.select("conv", "part", "seg", F.inline("stand")).select("conv", "part", "seg", "step", "edit", F.col("role").alias("given"), "row")
        new = e.where("edit = 'I'").select("conv", "part", "seg", "step", "edit", F.col("given").alias("role"), F.lit("").alias("text"))
        stay = e.where("edit <> 'I'").join(self.turns.select(*KEY, "part", "row"), ["conv", "part", "row"])
        texts = keyed(rows, F.col("text")).groupBy(*KEY).agg(F.first("text").alias("text"))  # equal turns have one text
        back = stay.join(texts, KEY).select("conv", "part", "seg", "step", "edit", F.coalesce("given", "role").alias("role"), "text")
        return new.unionByName(back)


def repair(rows: DataFrame) -> Repair:
    """Least edits that give each conversation roles whose initials are (s?(ua)+)?; of equal costs the ASCII-least audit.

    ``rows`` is (conv, turn, role, text), no null role or text. Turns are taken by turn (nulls
    first), then role, then the text's digest. Keep costs 0, Rerole to user or assistant 1, Delete 2
    (blank and duplicate turns must go), Insert 5, and a truncated turn that stays 5.

    A conversation of any length is cut into segments of at most SEGMENT turns that may stay. Cost
    layers tell what a segment costs from state to state; the sums from the last segment on tell
    what each still needs, and each is then traced by itself. So no task holds a conversation: of
    each segment, one task sees sixteen costs, and one four states. An empty table gives none.
    """
    spark = rows.sparkSession
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.col("digest")]
    one = judged(rows).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SEGMENT))).alias("block"))
    ranged = one.repartitionByRange(n_tasks(spark), *order, F.col("block")).sortWithinPartitions(*order, "block")
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    here = F.least(F.col("copies") - F.col("block") * SEGMENT, F.lit(SEGMENT)).cast("int")
    turns = written(ranged.withColumns({"n": here, "fault": F.when((F.col("block") > 0) & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))}), "turns")
    initial = F.left("role", F.lit(1))
    c = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    mark = F.concat(c, "fault", F.repeat(F.concat(c, F.when(F.col("fault") == "b", "b").otherwise("d")), F.col("n") - 1))
    m = F.sort_array(F.collect_list(F.struct("row", mark.alias("mark"), F.col("fault").isin("-", "t").alias("free"))))
    segments = turns.groupBy("conv", "part", F.floor(F.col("row") / SEGMENT).alias("seg")).agg(m.alias("m"))
    segments = written(segments.select("conv", "part", "seg", F.array_join(F.transform("m", lambda x: x.mark), "").alias("marks"), F.transform(F.filter("m", lambda x: x.free), lambda x: x.row).alias("free")), "segments")
    conv = segments.schema["conv"]
    place = [conv, T.StructField("part", T.IntegerType()), T.StructField("seg", T.LongType())]
    longs = T.ArrayType(T.LongType())
    schema = lambda start, ddl: T.StructType([*start, *T._parse_datatype_string(ddl).fields])
    costs = segments.mapInArrow(_costs, T.StructType([*place, T.StructField("costs", longs), *T._parse_datatype_string("bad long, ends string").fields]))
    joined = costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "costs", "bad", "ends"))).alias("segs"))
    needs = written(joined.mapInArrow(_needs, schema([conv], "cost long, illegal long, needs array<struct<part int, seg long, need array<long>, n long, k long>>")), "needs")
    each = segments.join(needs.select("conv", F.inline("needs")), ["conv", "part", "seg"])
    stand = "array<struct<step long, edit string, role string, row long>>"
    ways = written(each.select("conv", "part", "seg", "marks", "free", "need", "n", "k").mapInArrow(_ways, schema(place, f"ways array<struct<audit string, exit int, stand {stand}>>")), "ways")
    exits = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seg", F.transform("ways", lambda w: w.exit).alias("exits")))).alias("segs"))
    entries = exits.mapInArrow(_entries, schema([conv], "entries array<struct<part int, seg long, state int>>")).select("conv", F.inline("entries"))
    way = F.get("ways", F.col("state"))
    edits = written(ways.join(entries, ["conv", "part", "seg"]).select("conv", "part", "seg", way.audit.alias("audit"), way.stand.alias("stand")), "edits")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seg", "audit"))), lambda x: x.audit), "")
    audits = edits.groupBy("conv").agg(audit.alias("audit"))
    return Repair(turns, edits, needs.select("conv", "cost", "illegal").join(audits, "conv"))


def faults(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of each conversation, from its ``turns``."""
    n, is_ = F.col("n").cast("long"), lambda f: F.col("fault") == f
    by_turn = turns.groupBy("conv", "turn").agg(
        F.sum(F.when(is_("b"), n).otherwise(0)).alias("blank"), F.sum(F.when(is_("b"), 0).when(is_("d"), n).otherwise(n - 1)).alias("duplicate"), F.sum(F.when(is_("t"), 1).otherwise(0)).alias("truncated")
    )
    t = F.col("turn.v")
    gaps = F.coalesce(F.max(t) - F.min(t) + 1 - F.count(t), F.lit(0)).cast("long")
    return by_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's lines, which follow one another; a line is held no longer than its batch."""
    now, sha, keys, out, kind = None, None, [], [], None
    for b in batches:
        kind = b.schema.field("conv").type
        for conv, role, text in zip(b.column("conv").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if sha is None or conv != now:
                if sha is not None:
                    keys.append(now)
                    out.append(sha.hexdigest())
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out)], names=["conv", "repaired_sha256"])
            keys, out = [], []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*keys, now], kind), pa.array([*out, sha.hexdigest()])], names=["conv", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines ``role:text``. A hash of one text runs through it in order, so a conversation is one task's, streamed."""
    lines = repaired.select("conv", "part", "seg", "step", "role", "text").repartition("conv").sortWithinPartitions("conv", "part", "seg", "step").select("conv", "role", "text")
    return lines.mapInArrow(_hashed, T.StructType([lines.schema["conv"], T.StructField("repaired_sha256", T.StringType())]))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations`` (conv_id, turn, role, text), repairs them, and reports on each.

    A null conv_id is a conversation like any other. One that loses all its turns to damage, and
    so a table of such, has zeros, an empty audit and the hash of an empty text. Other columns are ignored.
    """
    rows = damage(conversations)
    found = repair(rows)
    every = conversations.select(F.struct(F.col("conv_id").alias("v")).alias("conv")).distinct()
    out = every.join(faults(found.turns), "conv", "left").join(found.conversations, "conv", "left").join(digests(found.rows(rows)), "conv", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("conv.v").alias("conv_id"), *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


SQL: dict[str, str] = {}  # least edits are no SQL; tests compare with a search of all edits
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
