"""Repair of conversation structure by cost layers (operator 13).

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials. A row is kept
(0), given the role that the grammar asks for (3) or deleted (4; blank rows and
duplicates must be), a missing user or assistant row is inserted (3), and a
truncated row that stays costs 3 more.

Layers in the manner of Wu and Manber: layer ``c`` holds, for each place between rows, the
bitset of grammar states from which the rest can be accepted at cost ``c``. Layers are made
for c = 0, 1, 2, ... from the last place to the first; the first one with the start
state's bit at the first place gives the cost. The audit is traced forward along set bits,
the ASCII-least letter first (D, I, K, R); state and letter fix the next state, so
the trace is the least of all cheapest audits.

Conversations of any length: rows are sorted by (conversation, turn) across range partitions, so a
hot conversation lies in many of them. A conversation longer than ``STRETCH`` rows is cut into stretches; the layers of a stretch
run for all four states at its end at once (16 bits a place) and give a table of costs from state to state;
tables are chained from the end (min, +). The piece of a conversation that ends or begins a partition may go on
in the next; such pieces (two a partition at most) send their table, are chained by conversation, and are traced
once their neighbours' costs are known. Only the digest of the repaired text passes a
conversation's pieces one after the other, a batch at a time.

Equal rows of a conversation are counted before they are sorted, so copies don't make a hot key.

Edge cases: null role or text is one space, a null conv_id or turn is one space in the hashed key, and stays null
elsewhere; null turns come first; rows of one turn are taken by role, then text;
rows without a conv_id are one conversation; an empty role has no initial and is never kept;
a conversation whose rows are all dropped has zeros, an empty audit and the digest
of the empty string; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

DELETE, ROLE, INSERT, TRUNCATED = 4, 3, 3, 3
STRETCH = 64
#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
STATES = 4
#: Next state by the initial of a row; absent: not allowed.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The row that may be inserted, or the role that may be given, in a state.
ASKED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a row's code.
INITIALS = {"s": 1, "u": 2, "a": 3}
GONE, CUT = 4, 8
ONES = 0x1111
#: From these states an ``u`` (to state 2) leads on.
TO_USER = 0b1011


def _before(initial: int, x: int) -> int:
    """States from which a row with that initial leads into the bitset ``x`` (one nibble for each goal)."""
    if initial == 2:
        return ((x >> 2) & ONES) * TO_USER
    if initial == 3:
        return ((x >> 3) & ONES) << 2
    return (x >> 1) & ONES if initial == 1 else 0


def _asked(x: int) -> int:
    """States from which the row that the grammar asks for leads into ``x``."""
    return ((x >> 2) & ONES) * TO_USER | ((x >> 3) & ONES) << 2


def next_layer(layers: list[list[int]], codes: bytes, seed: int) -> None:
    """Append the layer of the next cost: bitsets for each place, from the last to the first."""
    c, n = len(layers), len(codes)
    of = lambda cost: layers[c - cost] if c >= cost else None
    inserted, deleted, cut = of(INSERT), of(DELETE), of(ROLE + TRUNCATED)
    row = [0] * (n + 1)
    row[n] = seed
    for i in range(n - 1, -1, -1):
        code = codes[i]
        x = _asked(inserted[i]) if inserted else 0
        if deleted:
            x |= deleted[i + 1]
        if not code & GONE:
            if code & CUT:
                if inserted:  # a truncated row that is kept costs as much as an insertion
                    x |= _before(code & 3, inserted[i + 1])
                if cut:
                    x |= _asked(cut[i + 1])
            else:
                x |= _before(code & 3, row[i + 1])
                if inserted:
                    x |= _asked(inserted[i + 1])
        row[i] = x
    layers.append(row)


def costs_between(codes: bytes) -> list[int]:
    """The cheapest cost from each state (row) to each state (column) over a stretch, insertions before its rows included."""
    layers: list[list[int]] = []
    table = [FAR] * (STATES * STATES)
    for c in range(DELETE * len(codes) + 2 * INSERT + 1):  # all can be deleted, and two insertions reach any state
        next_layer(layers, codes, 0x8421 if c == 0 else 0)
        for goal in range(STATES):
            bits = layers[c][0] >> (4 * goal) & 15
            for q in range(STATES):
                if bits >> q & 1 and table[STATES * q + goal] == FAR:
                    table[STATES * q + goal] = c
    return table


def chained(table: list[int], rest: list[int]) -> list[int]:
    """Cheapest cost from each state over a stretch and all that follows."""
    return [min(FAR, *(table[STATES * q + e] + rest[e] for e in range(STATES))) for q in range(STATES)]


#: Cost to the end from each state with no row left: insertions alone.
AT_END = [0, 2 * INSERT, INSERT, 0]


def traced(codes: bytes, state: int, rest: list[int]) -> tuple[str, int]:
    """(ASCII-least cheapest audit of a stretch from ``state``, the state it ends in); ``rest``: cost from each state at its end."""
    base = min(rest)
    seeds: dict[int, int] = {}
    for q, cost in enumerate(rest):
        if cost < FAR:
            seeds[cost - base] = seeds.get(cost - base, 0) | 1 << q
    layers: list[list[int]] = []
    while not (layers and layers[-1][0] >> state & 1):
        next_layer(layers, codes, seeds.get(len(layers), 0))
    c, i, out = len(layers) - 1, 0, []
    bit = lambda cost, place, q: cost >= 0 and layers[cost][place] >> q & 1
    while i < len(codes):
        code = codes[i]
        cut = TRUNCATED if code & CUT else 0
        asked = ASKED[state][1]
        kept = STEP.get("\0sua"[code & 3], {}).get(state)
        if bit(c - DELETE, i + 1, state):
            out.append("D")
            c, i = c - DELETE, i + 1
        elif bit(c - INSERT, i, asked):
            out.append("I")
            c, state = c - INSERT, asked
        elif not code & GONE and kept is not None and bit(c - cut, i + 1, kept):
            out.append("K")
            c, i, state = c - cut, i + 1, kept
        else:
            out.append("R")
            c, i, state = c - ROLE - cut, i + 1, asked
    return "".join(out), state


def stretches(codes: bytes) -> list[bytes]:
    return [codes[k : k + STRETCH] for k in range(0, len(codes), STRETCH)]


def costs_over(codes: bytes) -> list[int]:
    """Table of costs from state to state over rows of any number."""
    table = [0 if q == e else FAR for q in range(STATES) for e in range(STATES)]
    for part in reversed(stretches(codes)):
        step = costs_between(part)
        columns = [chained(step, [table[STATES * q + e] for q in range(STATES)]) for e in range(STATES)]
        table = [columns[e][q] for q in range(STATES) for e in range(STATES)]
    return table


def audit_over(codes: bytes, state: int, rest: list[int]) -> tuple[str, int]:
    """The least cheapest audit over rows of any number, and the state it ends in."""
    parts = stretches(codes)
    if not parts:
        return "", state
    after = [rest]
    for part in reversed(parts[1:]):
        after.append(chained(costs_between(part), after[-1]))
    out = []
    for part, at_end in zip(parts, reversed(after), strict=True):
        audit, state = traced(part, state, at_end)
        out.append(audit)
    return "".join(out), state


def end_audit(state: int) -> str:
    """Insertions that close a conversation from a state."""
    return "I" * (AT_END[state] // INSERT)


def repaired(audit: str, state: int, rows: list[tuple[str, str]]) -> list[str]:
    """``role:text`` of the rows that an audit leaves, begun in ``state``."""
    out, left = [], iter(rows)
    for letter in audit:
        role, step = ASKED[state]
        if letter == "I":
            out.append(f"{role}:")
        else:
            own, text = next(left)
            if letter == "D":
                continue
            if letter == "K":
                role, step = own, STEP[own[0]][state]
            out.append(f"{role}:{text}")
        state = step
    return out


# Rows after damage


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies``: the contract's damage by a hash of conversation and turn.

    0 copies mark a dropped row, 2 a repeated one.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def untouched(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form that ``repair_conversations`` takes."""
    plain = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *plain, F.lit(1).cast("long").alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """Different rows of each conversation by turn, role and text, over range partitions, with their number and whether the same role and text stood before.

    Only roles and texts that stand at several turns of a conversation are looked up for their first one (by their MD5).
    """
    same = ["conv_id", "turn", "role", "text"]
    at = F.coalesce("turn", F.lit(-(1 << 63)))
    said = F.md5(F.concat("role", F.lit("\0"), "text"))
    first = (
        rows.where("copies > 0").groupBy("conv_id", said.alias("s")).agg(F.min(at).alias("first_turn"), F.max(at).alias("last_turn"))
        .where("first_turn < last_turn").select(F.col("conv_id").alias("c"), "s", "first_turn")
    )
    counted = rows.groupBy(*same).agg(F.sum("copies").alias("copies"))
    late = F.coalesce(at > F.col("first_turn"), F.lit(False))
    marked = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (said == F.col("s")), "left").select(*same, "copies", late.alias("late"))
    order = [F.asc_nulls_first(c) for c in same]
    return durable(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


class Run:
    """The rows of one conversation in one partition: codes, counts and what its ends need to be joined to other pieces."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.rows: list[tuple[str, str]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, copies: int, late: bool) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.last is None:
            self.first = initial
            self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        else:
            self.illegal += (self.last + initial not in LEGAL) + (copies - 1) * (initial + initial not in LEGAL)
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        end = text.rstrip(SPACES)
        code = INITIALS.get(initial, 0)
        if not end:
            self.blank += copies
            self.codes += bytes([code | GONE]) * copies
        else:
            fresh = 0 if late else 1
            self.duplicate += copies - fresh
            if fresh:
                cut = end[-1] not in ".!?"
                self.truncated += cut
                self.codes.append(code | CUT if cut else code)
            self.codes += bytes([code | GONE]) * (copies - fresh)
        self.rows += [(role, text)] * copies


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, Run]]:
    """(conv_id, partition, run) in the order of the rows."""
    run, at = None, None
    for batch in batches:
        for conv, turn, role, text, copies, late, part in zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True):
            if run is None or (conv, part) != at:
                if run is not None:
                    yield *at, run
                run, at = Run(), (conv, part)
            run.add(turn, role, text, copies, late)
    if run is not None:
        yield *at, run


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = "part int, edge int, turns long, first string, last string, low long, high long, costs array<long>"
PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _whole(run: Run) -> tuple:
    codes = bytes(run.codes)
    audit, state = audit_over(codes, 0, AT_END)
    audit += end_audit(state)
    text = "\n".join(repaired(audit, 0, run.rows))
    kept, left = 0, iter(codes)
    for letter in audit:
        code = 0 if letter == "I" else next(left)
        kept += letter in "KR" and code & CUT > 0
    cost = DELETE * audit.count("D") + INSERT * audit.count("I") + ROLE * audit.count("R") + TRUNCATED * kept
    gaps = run.high - run.low + 1 - run.turns if run.low is not None else 0
    return gaps, run.blank, run.duplicate, run.truncated, run.illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def _judge(kind: pa.DataType):
    """Rows of whole conversations, and pieces of those that a partition's first and last rows belong to."""
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["conv_id", *(c.split()[0] for c in DIGEST.split(", ")), *PIECE_NAMES]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def piece(conv, part: int, edge: int, run: Run) -> tuple:
        counts = (None, run.blank, run.duplicate, run.truncated, run.illegal, None, None, None)
        return conv, *counts, part, edge, run.turns, run.first, run.last, run.low, run.high, costs_over(bytes(run.codes))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting, first = [], None, True
        for found in _runs(batches):
            if waiting is not None:
                conv, part, run = waiting
                rows.append(piece(conv, part, 0, run) if first else (conv, *_whole(run), *[None] * 8))
                first = False
                if len(rows) >= 5000:
                    yield table(rows)
                    rows = []
            waiting = found
        if waiting is not None:
            conv, part, run = waiting
            rows.append(piece(conv, part, 0 if first else 1, run))
        yield table(rows)

    return judge, f"{DIGEST}, {PIECE}"


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one conversation: its counts, and for each piece the costs from its end on."""
    pieces = pieces.sort_values(["part", "edge"])
    rows = list(pieces.itertuples(index=False))
    blank, duplicate, truncated, illegal = (int(pieces[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal"))
    there = [r for r in rows if r.last is not None]
    illegal += sum(a.last + b.first not in LEGAL for a, b in zip(there, there[1:], strict=False))
    timed = [r for r in rows if r.low is not None and r.low == r.low]
    turns = sum(int(r.turns) for r in timed) - sum(a.high == b.low for a, b in zip(timed, timed[1:], strict=False))
    gaps = int(timed[-1].high) - int(timed[0].low) + 1 - turns if timed else 0
    rest, after = AT_END, []
    for r in reversed(rows):
        after.append(rest)
        rest = chained([int(x) for x in r.costs], rest)
    out = pieces[["conv_id", "part", "edge", "costs"]].copy()
    out["rest"] = pd.Series(list(reversed(after)), index=out.index)
    for name, value in zip((*COUNTS, "cost"), (gaps, blank, duplicate, truncated, illegal, rest[0]), strict=True):
        out[name] = value
    return out


CHAINED = "part int, edge int, costs array<long>, rest array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the state in which its trace ends, from each state at its start."""
    for (_, part), run, info in _with_info(batches):
        rest = list(info["rest"])
        ends = [audit_over(bytes(run.codes), q, rest)[1] for q in range(STATES)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([info["edge"]], pa.int32()), pa.array([ends], pa.list_(pa.int64()))], names=["part", "edge", "ends"])


def _with_info(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Run, dict]]:
    """Runs with the further columns of their first row; a partition's rows of one piece lie together."""
    info: dict[tuple, dict] = {}

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[7:]
            convs, parts = batch.column(0).to_pylist(), batch.column(6).to_pylist()
            last = None
            for k, key in enumerate(zip(convs, parts, strict=True)):
                if key != last and key not in info:
                    info[key] = {n: batch.column(7 + j)[k].as_py() for j, n in enumerate(names)}
                last = key
            yield batch

    for conv, part, run in _runs(noted()):
        yield (conv, part), run, info.pop((conv, part))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired text of each piece, whose state at its start is known by now."""
    for (_, part), run, info in _with_info(batches):
        audit, _ = audit_over(bytes(run.codes), info["state"], list(info["rest"]))
        text = "\n".join(repaired(audit, info["state"], run.rows))
        shown = text if any(x != "D" for x in audit) else None
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([info["edge"]], pa.int32()), pa.array([audit]), pa.array([shown], pa.string())], names=["part", "edge", "audit", "text"]
        )


def _entered(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of a conversation begins, and the one in which the last ends."""
    pieces = pieces.sort_values(["part", "edge"])
    state, states = 0, []
    for ends in pieces["ends"]:
        states.append(state)
        state = int(ends[state])
    out = pieces[["conv_id", "part", "edge", "rest"]].copy()
    out["state"] = states
    out["closing"] = pd.array([None] * (len(states) - 1) + [state], dtype="Int64")
    return out


def _joined(kind: pa.DataType):
    """Audit and digest of conversations from their pieces in order; only the running digest is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, audit, digest):
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        begun, at, audit, digest, empty = False, None, [], hashlib.sha256(), True
        for batch in batches:
            for conv, piece, text, closing in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "text", "closing")), strict=True):
                if not begun or conv != at:
                    if begun:
                        yield row(at, audit, digest)
                    begun, at, audit, digest, empty = True, conv, [], hashlib.sha256(), True
                audit.append(piece)
                parts = [] if text is None else [text]
                if closing is not None:
                    end = end_audit(closing)
                    audit.append(end)
                    parts += repaired(end, closing, [])
                for part in parts:
                    digest.update(part.encode() if empty else b"\n" + part.encode())
                    empty = False
        if begun:
            yield row(at, audit, digest)

    return run


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation.

    ``rows``: conv_id, turn, role, text, copies, as ``damaged`` or ``untouched`` give them.
    """
    kind = dict(rows.dtypes)["conv_id"]
    arrow = pa.string() if kind == "string" else pa.int64()
    if kind not in ("string", "bigint"):
        raise TypeError("conv_id must be a long or a string")
    ordered = in_order(rows)
    judge, schema = _judge(arrow)
    judged = durable(ordered.mapInArrow(judge, f"conv_id {kind}, {schema}"))
    digest = ["conv_id", *(c.split()[0] for c in DIGEST.split(", "))]
    whole = judged.where("part is null").select(*digest)
    # Two pieces a partition at most: a bounded side of every join below.
    pieces = judged.where("part is not null").select("conv_id", *COUNTS[1:], *PIECE_NAMES)
    chain = durable(pieces.groupBy("conv_id").applyInPandas(_chain, f"conv_id {kind}, {CHAINED}"))
    named = lambda df, *names: df.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *names)

    def of_pieces(side: DataFrame, *names: str) -> DataFrame:
        right = F.broadcast(named(side, *names))
        on = ordered["conv_id"].eqNullSafe(F.col("c")) & (ordered["part"] == F.col("p"))
        return ordered.join(right, on).select(*ordered.columns, *names)

    exits = of_pieces(chain, "edge", "rest", "costs").mapInArrow(_exits, "part int, edge int, ends array<long>")
    entered = durable(
        chain.select("conv_id", "part", "edge", "rest").join(exits, ["part", "edge"])
        .groupBy("conv_id").applyInPandas(_entered, f"conv_id {kind}, part int, edge int, rest array<long>, state long, closing long")
    )
    texts = of_pieces(entered, "edge", "rest", "state").mapInArrow(_texts, "part int, edge int, audit string, text string")
    told = entered.select("conv_id", "part", "edge", "closing").join(texts, ["part", "edge"])
    joined = told.repartition("conv_id").sortWithinPartitions("conv_id", "part", "edge").mapInArrow(
        _joined(arrow), f"conv_id {kind}, audit string, repaired_sha256 string"
    )
    sums = chain.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*COUNTS, "cost")])
    split = sums.alias("s").join(joined.withColumnRenamed("conv_id", "c"), F.col("s.conv_id").eqNullSafe(F.col("c"))).select(*digest)
    return whole.unionByName(split)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op13_repair": op13_repair}
