"""Repair of damaged conversations at least cost, by Four-Russians block tables.

A conversation is repaired by keeping, re-roling, deleting and inserting rows, so that the initials
of its roles read ``s?(ua)+`` or nothing is left. What the repair costs from some point on depends on
what has been put out before only through four states: nothing, a system row, a user row
last, an assistant row last. So the costs still to come are a vector of four, and two
of them differ by no more than a few edits: normalised (less their least), few vectors exist.

1. A row is one of nine symbols (its role's initial, and whether it is blank or repeated, truncated, or
   sound); a tenth stands for no row. For every block of four symbols and every normalised vector
   behind it a table holds the vector before it, what it adds to the cost, and, for each state
   in front, the state behind.
2. Rows are put in order by ranges of conversation and turn; a segment is a bounded stretch of that order.
   A segment is read from its end, a block per look-up, for all vectors at once: what it does to vectors
   and states is a row of bounded size.
3. Per conversation these rows are chained: from the last to the first they give the vector behind each segment,
   from the first to the last the state in front.
4. Each segment is then traced: blocks are expanded backward into the vector behind each row, and
   from the front the ASCII-least edit that still has the least cost is taken. As an edit's initial
   and the state fix the next state, that gives the least of all cheapest edit strings.

A conversation of any length is spread over tasks; only its summaries (0.2 bytes a row) meet in one. The repaired rows
of a conversation pass one task as a stream where they are hashed, since SHA-256 has no other order.

Null roles, texts, turns and ids are defined: in roles, texts and hashed names a null is one blank; null turns
come first and count in no gap; rows with a null id are one conversation. Rows of equal turns
are ordered by role and text; equal rows are interchangeable. Empty texts are blank. A role that is empty or
begins with another letter than s, u, a is legal nowhere and has to be re-roled or deleted. Texts are
read whole. An empty table gives an empty result; other columns play no part.
"""

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.sources.checkpoints import written

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BLOCK = 4
SEGMENT_BITS = 10  # 1,024 rows
#: Symbols: role (s, u, a, other) of sound rows, of truncated rows, then rows that have to go, and no row.
ROLES = "sua"
GONE, NONE = 8, 9
SYMBOLS = 10
#: The state behind a user or assistant row that may follow a state.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIAL = {USER: "u", ASSISTANT: "a"}
#: Costs at the end: nothing left and a last assistant row are complete, the others need rows put in.
END = (0, 2 * INSERT, INSERT, 0)
BLANK, DUPLICATE, TRUNC = 1, 2, 3


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row in a state: the edit, its cost, the state behind."""
    if symbol == NONE:
        return [("", 0, state)]
    found = [("D", DELETE, state)]
    if symbol != GONE:
        dear, role = TRUNCATED * (symbol >= 4), ROLES[symbol % 4:symbol % 4 + 1]
        after = FOLLOWS[state]
        if INITIAL[after] == role:
            found.append(("K", dear, after))
        elif role == "s" and state == START:
            found.append(("K", dear, SYSTEM))
        found.append(("R", dear + REROLE, after))
    return found


def _before(symbol: int, behind: tuple) -> tuple:
    """Costs in front of a row from the costs behind it, inserted rows counted in."""
    if symbol == NONE:
        return behind
    cost = [min(c + behind[to] for _, c, to in edits(symbol, s)) for s in range(4)]
    for _ in range(3):  # rows put in lead from any state on by one at most three times
        cost = [min(cost[s], INSERT + cost[FOLLOWS[s]]) for s in range(4)]
    return tuple(cost)


def _trace(symbol: int, behind: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least edits of least cost in front of and at a row, and the state behind."""
    if symbol == NONE:
        return "", state
    before, made = _before(symbol, behind), ""
    while True:
        options = [(name, to) for name, cost, to in edits(symbol, state) if cost + behind[to] == before[state]]
        if INSERT + before[FOLLOWS[state]] == before[state]:
            options.append(("I", FOLLOWS[state]))
        name, to = min(options)
        made, state = made + name, to
        if name != "I":
            return made, state


class Tables:
    """Transitions of normalised cost vectors by symbol, and by block of symbols."""

    def __init__(self, block: int = BLOCK):
        number = {END: 0}
        steps, queue = {}, [END]
        for vector in queue:
            for symbol in range(SYMBOLS):
                cost = _before(symbol, vector)
                least = min(cost)
                normal = tuple(c - least for c in cost)
                if normal not in number:
                    number[normal] = len(number)
                    queue.append(normal)
                steps[number[vector], symbol] = number[normal], least
        self.vectors = queue
        n = len(queue)
        self.step = np.array([[steps[v, s] for s in range(SYMBOLS)] for v in range(n)])  # vector, symbol -> vector, cost
        traced = [[[_trace(s, queue[v], q) for q in range(4)] for s in range(SYMBOLS)] for v in range(n)]
        self.made = [[[t[0] for t in q] for q in s] for s in traced]
        exit_ = np.array([[[t[1] for t in q] for q in s] for s in traced])
        # Blocks as numbers to the base of the symbols, the first symbol highest.
        self.block = block
        symbols = np.array(list(product(range(SYMBOLS), repeat=block)))
        self.vector = np.repeat(np.arange(n)[:, None], len(symbols), 1)
        self.cost = np.zeros_like(self.vector)
        self.state = np.repeat(np.repeat(np.arange(4)[None, None], len(symbols), 1), n, 0)
        for j in range(block - 1, -1, -1):
            at = exit_[self.vector, symbols[:, j]]  # vector, block, state in front -> behind the row
            self.state = np.take_along_axis(self.state, at, 2)
            moved = self.step[self.vector, symbols[:, j]]
            self.vector, self.cost = moved[..., 0], self.cost + moved[..., 1]

    def blocks_of(self, symbols: bytes) -> np.ndarray:
        """The blocks of a segment, filled up with no rows at its end."""
        row = np.frombuffer(symbols, np.uint8).astype(np.int64)
        row = np.r_[row, np.full(-len(row) % self.block, NONE)].reshape(-1, self.block)
        return row @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))

    def summary(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector behind a segment: that in front, the cost between, the states behind."""
        vector, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        state = np.repeat(np.arange(4)[None], len(vector), 0)
        for b in self.blocks_of(symbols)[::-1]:
            state = np.take_along_axis(state, self.state[vector, b], 1)
            cost, vector = cost + self.cost[vector, b], self.vector[vector, b]
        return vector, cost, state

    def trace(self, symbols: bytes, behind: int, state: int) -> list[str]:
        """The edits in front of and at each row of a segment."""
        ends = [behind]
        blocks = self.blocks_of(symbols)
        for b in blocks[:0:-1]:
            ends.append(int(self.vector[ends[-1], b]))
        made = []
        for i, end in enumerate(reversed(ends)):
            inside = symbols[i * self.block:(i + 1) * self.block]
            vectors = [end]
            for s in inside[:0:-1]:  # the block expanded backward
                vectors.append(int(self.step[vectors[-1], s, 0]))
            for s, v in zip(inside, reversed(vectors)):
                edit = self.made[v][s][state]
                for e in edit:
                    state = _moved(s, e, state)
                made.append(edit)
        return made


def _moved(symbol: int, edit: str, state: int) -> int:
    """The state behind an edit; a kept system row is the one that does not follow the order."""
    if edit == "D":
        return state
    return SYSTEM if edit == "K" and symbol % 4 == 0 else FOLLOWS[state]


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by a hash of each row's place.

    Of 20 rows one is dropped, one emptied, one loses its full stops, one is repeated, one is
    given to the user.
    """
    fate = F.crc32(F.concat(text_of(F.col("conv_id")), F.lit(":"), text_of(F.col("turn")))) % 20
    rows = conversations.select("conv_id", "turn", text_of(F.col("role")).alias("role"),
                                text_of(F.col("text")).alias("text"), fate.alias("_fate")).where("_fate <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their place ``at`` in the order of conversations and turns, and their digest.

    Places rise along the ranges that the order is cut into, and within each by one.
    """
    order = ["conv_id", "turn", "role", "text", "_any"]  # equal rows may be dealt to several ranges
    visible = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    rows = rows.withColumn("_any", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return ordered.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"), kind.cast("byte").alias("kind"),
        F.when(visible == "", BLANK).when(~F.substring(visible, -1, 1).isin(".", "!", "?"), TRUNC).otherwise(0).cast("byte").alias("fault"),
        F.sha2(F.to_json(F.struct("role", "text")), 256).alias("digest"))


def _symbols(ordered: DataFrame) -> DataFrame:
    """``conv_id, at, symbol, fault``: a row that has the role and text of one before it is a duplicate."""
    again = ordered.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(
        F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = ordered.select("conv_id", "at", "kind", "fault", "digest").join(
        again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("at") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    symbol = F.when(fault.isin(BLANK, DUPLICATE), GONE).otherwise(F.col("kind") + F.when(fault == TRUNC, 4).otherwise(0))
    return rows.select("conv_id", "at", symbol.cast("int").alias("symbol"), fault.cast("int").alias("fault"))


def _segments(symbols: DataFrame) -> DataFrame:
    """``conv_id, first, symbols, faults``: stretches of at most 1,024 rows of one conversation."""
    grouped = symbols.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("at", "symbol", "fault"))).alias("rows"))
    return grouped.select(
        "conv_id", F.col("rows")[0]["at"].alias("first"),
        F.concat_ws("", F.transform("rows", lambda r: r["symbol"].cast("string"))).alias("symbols"),
        F.concat_ws("", F.transform("rows", lambda r: r["fault"].cast("string"))).alias("faults"))


def _digits(text: str) -> bytes:
    return bytes(ord(c) - 48 for c in text)


def _summaries(batches):
    for batch in batches:
        found = [tables().summary(_digits(s)) for s in batch.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[
            pa.array([f[i].astype(np.uint8 if i != 1 else np.int32).tobytes() for f in found], pa.binary()) for i in range(3)]],
            [*batch.schema.names, "vectors", "costs", "states"])


def _chained(batches):
    """The vector behind each segment and the state in front of it, a conversation at a time.

    Rows come sorted by conversation and place.
    """
    def chain():
        behind, vector, cost = [], 0, 0
        for _, vectors, costs, _ in reversed(rows):
            behind.append(vector)
            cost += int(np.frombuffer(costs, np.int32)[vector])
            vector = vectors[vector]
        state = START
        least = cost + tables().vectors[vector][START]
        for i, ((at, _, _, states), end) in enumerate(zip(rows, reversed(behind))):
            made.append((conv, at, end, state, least, i == len(rows) - 1))
            state = states[4 * end + state]
        rows.clear()

    def table():
        columns = [pa.array(c, f.type) for c, f in zip(zip(*made), schema)]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    schema, conv, rows, made = None, None, [], []
    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *LINKS])
        for c, *row in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "first", "vectors", "costs", "states")]):
            if rows and c != conv:
                chain()
            conv = c
            rows.append(row)
        if len(made) > 5000:
            yield table()
    if rows:
        chain()
    if made:
        yield table()


LINKS = [("at", pa.int64()), ("behind", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("last", pa.bool_())]


class Repair:
    """One conversation as its rows pass by, in order, each segment's link and symbols before them."""

    def __init__(self, keep_rows: bool):
        self.keep_rows = keep_rows
        self.hash, self.empty = hashlib.sha256(), True
        self.counts = [0] * 4
        self.audit: list[str] = []
        self.rows: list[tuple] = []
        self.illegal, self.before = 0, None
        self.turns, self.least, self.most = 0, None, None
        self.link, self.state = {"cost": 0}, START

    def begin(self, symbols: bytes, faults: bytes):
        """The rows of the segment whose link came before."""
        self.edits = iter(zip(tables().trace(symbols, self.link["behind"], self.state), symbols, faults))
        self.left = len(symbols)

    def _out(self, edit: str, role: str, text: str):
        self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False
        if self.keep_rows:
            self.rows.append((edit, role, text))

    def _insert(self):
        self.state = FOLLOWS[self.state]
        self._out("I", "user" if self.state == USER else "assistant", "")

    def row(self, turn, role: str, text: str):
        edit, symbol, fault = next(self.edits)
        self.counts[fault] += 1
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.audit.append(edit)
        for e in edit:
            if e == "I":
                self._insert()
                continue
            self.state = _moved(symbol, e, self.state)
            if e == "K":
                self._out(e, role, text)
            elif e == "R":
                self._out(e, "user" if self.state == USER else "assistant", text)
        self.left -= 1
        if not self.left and self.link["last"]:
            while self.state not in (START, ASSISTANT):
                self.audit.append("I")
                self._insert()

    def result(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, self.link["cost"], "".join(self.audit), self.hash.hexdigest())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repairing(keep_rows: bool):
    def run(batches):
        def done(conv, repair):
            if keep_rows:
                out.extend((conv, i, e, r, t) for i, (e, r, t) in enumerate(repair.rows, start))
                repair.rows.clear()
            else:
                out.append((conv, *repair.result()))

        names = ["position", "edit", "role", "text"] if keep_rows else [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] if keep_rows else [pa.int64()] * 6 + [pa.string()] * 2
        out, repair, conv, start, schema = [], None, None, 0, None

        def flush():
            columns = list(zip(*out))
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *zip(names, kinds)])
            for row in batch.to_pylist():
                if repair is None or row["conv_id"] != conv:
                    if repair is not None:
                        done(conv, repair)
                    repair, conv, start = Repair(keep_rows), row["conv_id"], 0
                if row["behind"] is not None:
                    repair.link, repair.state = row, row["state"]
                elif row["symbols"] is not None:
                    repair.begin(_digits(row["symbols"]), _digits(row["faults"]))
                else:
                    repair.row(row["turn"], row["role"], row["text"])
            if keep_rows and repair is not None:  # a long conversation leaves as it comes
                n = len(repair.rows)
                done(conv, repair)
                start += n
            if out:
                yield flush()
        if repair is not None:
            done(conv, repair)
        if out:
            yield flush()
    return run


def _in_order(rows: DataFrame) -> DataFrame:
    """All rows of a conversation in one task, in order; before a segment's rows its link and its symbols."""
    ordered = written(_ordered(rows), "turns")
    kind = ordered.schema["conv_id"].dataType.simpleString()
    segments = written(_segments(_symbols(ordered)).mapInArrow(_summaries, (
        f"conv_id {kind}, first long, symbols string, faults string, vectors binary, costs binary, states binary")), "segments")
    links = segments.select("conv_id", "first", "vectors", "costs", "states").repartition(
        "conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(_chained, (
            f"conv_id {kind}, at long, behind int, state int, cost long, last boolean"))
    every = ordered.select("conv_id", "at", "turn", "role", "text", F.lit(2).alias("_kind"))
    for other in (links.withColumn("_kind", F.lit(0)), segments.select(
            "conv_id", F.col("first").alias("at"), "symbols", "faults", F.lit(1).alias("_kind"))):
        every = every.unionByName(other, allowMissingColumns=True)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "at", "_kind")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``conv_id, turn, role, text``: ``conv_id, position, edit, role, text``."""
    rows = rows.select("conv_id", "turn", text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows).mapInArrow(_repairing(True), (
        f"conv_id {kind}, position long, edit string, role string, text string"))


def audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per id of ``conversations``: faults of its ``rows``, the cost and edits of their repair, a digest."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = _in_order(rows).mapInArrow(_repairing(False), f"conv_id {kind}, {RESULT}")
    counts = [c.split()[0] for c in RESULT.split(", ")][:6]
    nothing = {**{c: F.lit(0).cast("long") for c in counts}, "audit": F.lit(""),
               "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    return every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), *[F.coalesce(c, other).alias(c) for c, other in nothing.items()])


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audits(damaged(conversations), conversations)
