"""Repair of conversation structure by a run-length dynamic program.

A row is a symbol: the kind of its role and its fault. A conversation is a run-length code of symbols; each symbol has a
min-plus transition over four states (nothing yet, after system, after user, after assistant), whose binary powers are
cached, so a run of any length costs the logarithm of it. Costs to go are carried backwards over the runs, then the
choices are unrolled forwards, letter by letter, the least letter that stays on a cheapest way.

Rows are sorted by range, so a conversation may span many pieces (partitions of the sort). Repeated rows are found by a
grouping with partial minima, and only conversations of several pieces send anything to it. Each piece of such a
conversation is reduced to one transition; the pieces' transitions give the cost to go at each piece's end. The last
pass streams the rows of a conversation, holding one piece at a time. It is one task a conversation, for a SHA-256 hash
runs over the bytes in order; its memory doesn't grow with the conversation, but for the audit it returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.scratch import Scratch

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Costs of the edits; TORN is added for a truncated row that stays.
REROLE, DELETE, INSERT, TORN = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 50
PIECE_BYTES = 32 << 20
#: Kinds of roles by their first letter; the last one fits nowhere.
KINDS = "sua"
GONE = 9
_REPORT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPORT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_ROWS_SQL = "conv_id long, place long, edit string, turn long, role string, text string"
_PLACED = "conv_id long, piece int, place int, turn long, role string, text string, print binary, fault int, alone boolean"

Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def _before(m: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(m[i][k] + v[k] for k in STATES) for i in STATES)


def follower(state: int) -> int:
    """The state after a user or an assistant turn, whichever may come next."""
    return ASSISTANT if state == USER else USER


def symbol(role: str, fault: int) -> int:
    """Kinds 0 to 3, plus 4 for truncated rows; GONE for rows that must go."""
    if fault in (BLANK, DUPLICATE):
        return GONE
    kind = KINDS.find(role[0]) if role else -1
    return (kind if kind >= 0 else 3) + (4 if fault == TRUNCATED else 0)


def kept(symbol_: int, state: int) -> int | None:
    """The state after a row that is kept; None where it doesn't fit."""
    kind = symbol_ % 4 if symbol_ != GONE else 3
    if kind == 0:
        return SYSTEM if state == START else None
    fits = (kind == 1 and state != USER) or (kind == 2 and state == USER)
    return follower(state) if fits else None


def _row_cost(symbol_: int) -> int:
    return TORN if 4 <= symbol_ < GONE else 0


def _inserts() -> Matrix:
    one = [[0 if i == j else FAR for j in STATES] for i in STATES]
    for i in STATES:
        one[i][follower(i)] = INSERT
    once = tuple(map(tuple, one))
    return _times(once, _times(once, once))


INSERTS = _inserts()
#: Cost to go behind the last row.
END = _before(INSERTS, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def power(symbol_: int, exponent: int) -> Matrix:
    """Transition of 2^exponent rows of one symbol, each with the insertions before it."""
    if exponent:
        half = power(symbol_, exponent - 1)
        return _times(half, half)
    row = [[FAR] * 4 for _ in STATES]
    for i in STATES:
        row[i][i] = DELETE
        if symbol_ != GONE:
            j = follower(i)
            row[i][j] = min(row[i][j], REROLE + _row_cost(symbol_))
            j = kept(symbol_, i)
            if j is not None:
                row[i][j] = min(row[i][j], _row_cost(symbol_))
    return _times(INSERTS, tuple(map(tuple, row)))


def _bits(n: int) -> Iterator[int]:
    return (b for b in range(n.bit_length()) if n >> b & 1)


def runs_of(symbols: list[int]) -> list[list[int]]:
    """[symbol, length] of the runs."""
    runs: list[list[int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    return runs


def piece_matrix(runs: list[list[int]]) -> Matrix:
    whole: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)
    for s, n in runs:
        for b in _bits(n):
            whole = _times(whole, power(s, b))
    return whole


@lru_cache(maxsize=100_000)
def _one_before(symbol_: int, shape: tuple[int, ...]) -> tuple[int, ...]:
    return _before(power(symbol_, 0), shape)


def unroll(runs: list[list[int]], state: int, end: tuple[int, ...], last: bool) -> tuple[int, int, list[str]]:
    """(state after, cost, letters) of the cheapest edits of least letters; `end` is the cost to go behind the runs."""
    togo = [end]
    for s, n in reversed(runs):
        v = togo[-1]
        for b in _bits(n):
            v = _before(power(s, b), v)
        togo.append(v)
    letters, cost = [], 0
    for (s, n), behind in zip(runs, togo[-2::-1]):
        # Costs to go inside the run, relative to the least one, so that equal shapes are computed once.
        inner = [behind]
        for _ in range(n):
            base = min(inner[-1])
            inner.append(tuple(x + base for x in _one_before(s, tuple(x - base for x in inner[-1]))))
        for i in range(n, 0, -1):
            here, after = inner[i], inner[i - 1]
            while True:
                left = here[state]
                if DELETE + after[state] == left:
                    letters.append("D")
                    cost += DELETE
                    break
                if INSERT + here[follower(state)] == left:
                    letters.append("I")
                    cost += INSERT
                    state = follower(state)
                    continue
                to = kept(s, state)
                if to is not None and _row_cost(s) + after[to] == left:
                    letters.append("K")
                    cost += _row_cost(s)
                    state = to
                    break
                letters.append("R")
                cost += REROLE + _row_cost(s)
                state = follower(state)
                break
    while last and END[state]:
        letters.append("I")
        cost += INSERT
        state = follower(state)
    return state, cost, letters


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number sorted rows; `alone` marks the first of equal rows of a conversation within the piece."""
    piece, place, held, seen = TaskContext.get().partitionId(), 0, (), set()
    for batch in batches:
        ids, prints = batch.column(0).to_pylist(), batch.column(4).to_pylist()
        alone = []
        for name, mark in zip(ids, prints):
            if (name,) != held:
                held, seen = (name,), set()
            alone.append(mark not in seen)
            seen.add(mark)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([piece] * n, pa.int32()), pa.array(range(place, place + n), pa.int32()), *batch.columns[1:6], pa.array(alone, pa.bool_())],
            names=["conv_id", "piece", "place", "turn", "role", "text", "print", "fault", "alone"])
        place += n


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One transition for each conversation and piece of rows sorted by them."""
    held, symbols = None, []

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array([[x for r in piece_matrix(runs_of(symbols)) for x in r]], pa.list_(pa.int64()))],
            names=["conv_id", "piece", "matrix"])

    for batch in batches:
        for name, piece, role, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if (name, piece) != held:
                if held:
                    yield done()
                held, symbols = (name, piece), []
            symbols.append(symbol(role, fault))
    if held:
        yield done()


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost to go behind each piece, from the transitions of the pieces of a conversation; then 1 for the last piece."""
    for batch in batches:
        out = []
        for name, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            v = END
            for p in sorted(pieces, key=lambda p: -p["piece"]):
                out.append((name, p["piece"], [*v, int(v is END)]))
                m = p["matrix"]
                v = _before(tuple(tuple(m[4 * i:4 * i + 4]) for i in STATES), v)
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int64()))],
            names=["conv_id", "piece", "togo"])


class _Conversation:
    """What is carried from piece to piece."""

    def __init__(self, name: int | None) -> None:
        self.name, self.state, self.cost, self.audit, self.lines = name, START, 0, [], 0
        self.faults, self.illegal, self.last_kind = [0, 0, 0, 0], 0, None
        self.least = self.most = self.turn = None
        self.turns = 0
        self.sum = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sum.update(("\n" if self.lines else "").encode() + role.encode() + b":" + text.encode())
        self.lines += 1

    def piece(self, rows: list[tuple], end: list[int] | None) -> list[tuple]:
        """Take rows (turn, role, text, fault) of one piece; returns the repaired rows."""
        for turn, role, _, fault in rows:
            self.faults[fault] += 1
            kind = role[:1]
            if self.last_kind is not None and self.last_kind + kind not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_kind = kind
            if turn is not None:
                # Rows come by turn.
                self.turns += turn != self.turn
                self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
        runs = runs_of([symbol(role, fault) for _, role, _, fault in rows])
        entry = self.state
        self.state, cost, letters = unroll(runs, entry, tuple(end[:4]) if end else END, end is None or end[4] == 1)
        self.cost += cost
        self.audit.append("".join(letters))
        out, state, at = [], entry, iter(rows)
        for letter in letters:
            turn, role, text, fault = (None, "", "", 0) if letter == "I" else next(at)
            if letter == "D":
                continue
            if letter == "K":
                state = kept(symbol(role, fault), state)
            else:
                state = follower(state)
                role = "user" if state == USER else "assistant"
            out.append((self.name, self.lines, letter, turn, role, text))
            self._line(role, text)
        return out

    def report(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.name, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sum.hexdigest())


def _solve(want_rows: bool):
    """Rows sorted by conversation, piece and place; conversations of one piece have no cost to go."""
    schema = _ROWS if want_rows else _REPORT

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, rows, end, out = None, None, [], None, []
        for batch in batches:
            for name, piece, turn, role, text, fault, togo in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (name, piece):
                    if rows:
                        found = own.piece(rows, end)
                        out += found if want_rows else []
                    if own is None or own.name != name or key is None:
                        if own is not None and not want_rows:
                            out.append(own.report())
                        own = _Conversation(name)
                    key, rows, end = (name, piece), [], togo
                    if len(out) > 500:
                        yield packed(out)
                        out = []
                rows.append((turn, role, text, fault))
        if rows:
            found = own.piece(rows, end)
            out += found if want_rows else [own.report()]
        if out:
            yield packed(out)
    return run


SPACES = r"\x20\x09-\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the damage drawn by crc32(`conv_id:turn`) % 20.

    0 drops the row, 1 empties its text, 2 takes out its `[.!?]`, 3 repeats it, 4 makes its role user. Null ids and
    turns are one space in the drawn text, null roles and texts become one space. Returns conv_id, turn, role, text.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role").alias("role"), shown("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, 2).otherwise(1)
    return (rows.where("draw != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
            .drop("copy"))


def _prepared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of the last pass: conv_id, piece, turn, role, text, fault, togo, sorted within tasks."""
    core = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(core == "", BLANK).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    marked = scratch.keep(rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        .select("*", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("print"), fault.alias("fault"),
                F.monotonically_increasing_id().alias("row")), "rows")
    size = marked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    spark = rows.sparkSession
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE_BYTES))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "print", "row"]
    placed = scratch.keep(
        marked.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "text", "print", "fault").mapInArrow(_place, _PLACED), "placed")
    scratch.drop(marked)

    # Conversations of several pieces: at most two for each piece.
    spans = scratch.keep(placed.groupBy("conv_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high"), "spans")
    wide = placed.select(*[F.col(c).alias(f"w_{c}") for c in placed.columns if c != "text"]).join(
        spans, F.col("w_conv_id").eqNullSafe(F.col("conv_id")), "left_semi")
    wide = scratch.keep(wide.select(*[F.col(c).alias(c[2:]) for c in wide.columns]), "wide")
    first = (wide.where("alone").groupBy("conv_id", "print").agg(F.min(F.struct("piece", "place")).alias("first"), F.count("*").alias("held"))
             .where("held > 1").select(F.col("conv_id").alias("f_conv"), F.col("print").alias("f_print"), "first"))
    late = scratch.keep(
        wide.where("alone").join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("print") == F.col("f_print")))
        .where(F.struct("piece", "place") > F.col("first")).select(F.col("piece").alias("l_piece"), F.col("place").alias("l_place")), "late")

    def judged(df: DataFrame) -> DataFrame:
        met = df.join(late, (F.col("piece") == F.col("l_piece")) & (F.col("place") == F.col("l_place")), "left")
        again = ~F.col("alone") | F.col("l_piece").isNotNull()
        return met.withColumn("fault", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")))

    matrices = (judged(wide).select("conv_id", "piece", "place", "role", "fault").repartition("piece").sortWithinPartitions("piece", "place")
                .select("conv_id", "piece", "role", "fault").mapInArrow(_reduce, "conv_id long, piece int, matrix array<long>"))
    togo = scratch.keep(
        matrices.groupBy("conv_id").agg(F.collect_list(F.struct("piece", "matrix")).alias("pieces"))
        .mapInArrow(_backwards, "conv_id long, piece int, togo array<long>")
        .select(F.col("conv_id").alias("t_conv"), F.col("piece").alias("t_piece"), "togo"), "togo")
    ready = judged(placed).join(togo, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("piece") == F.col("t_piece")), "left")
    return (ready.select("conv_id", "piece", "place", "turn", "role", "text", "fault", "togo").repartition("conv_id")
            .sortWithinPartitions("conv_id", "piece", "place").select("conv_id", "piece", "turn", "role", "text", "fault", "togo"))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and a hash of the repaired text of every conversation in `rows`.

    `rows` has conv_id, turn, role and text and is read by turn, nulls first; rows of one turn by role, then by a hash of
    role and text. A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation),
    truncated (its last character that isn't white space is none of `.!?`). Edits make the first letters of the roles
    `(s?(ua)+)?`: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows go), Insert an empty user or
    assistant turn 5, and 5 more for a truncated row that stays. Of the cheapest ways, the one whose letters are least.
    gaps: turns missing between the least and the largest; illegal: neighbours that are none of su, ua, au before repair.

    Null roles and texts are one space; a role without a first letter fits nowhere. Null turns count in no gap. A null
    conv_id is a conversation. Repeated rows are duplicates. Empty tables give no rows; other columns are dropped.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    return _prepared(rows, scratch).mapInArrow(_solve(False), _REPORT_SQL)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the conversations after the edits of `repair`; inserted rows lack a turn."""
    scratch = Scratch(rows.sparkSession, "conversations")
    return _prepared(rows, scratch).mapInArrow(_solve(True), _ROWS_SQL)
