"""Repair of the structure of conversations by the cheapest edits, ties settled by the least audit.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its rows may be kept, given the role
that the grammar takes next (a rerole), deleted, or have an empty turn of that role inserted before them. From
a state of the grammar each edit leads to one state, so that a node (row, state) has at most one arc a letter.

Costs to the end come from products of 4 x 4 matrices under (min, +), one for each row. The arcs that lie on
cheapest paths are kept; their nodes are ranked by the first letter of their audit, then by the first 2, 4,
8, ... letters: two ranks and a doubled pointer give the next. An arc is chosen by its letter and the rank of
its node, and the path of a conversation is read off the doubled pointers, all steps at once.

A conversation may hold any share of the rows. Rows are range-partitioned on (conversation, turn, role, text,
number) and cut into *segments* of bounded rows and bytes. Of a conversation that runs over several
segments each segment tells its matrix, a walk over these (one small row a segment) gives the costs at each
border, a second walk the state in which each segment is entered. Only the digest of the repaired
text has to be taken in order; it streams through one task, with one segment in memory.

Rows of one turn are taken in the order of their role, of the first 64 characters of the text, and of a digest
of both. Null turns come first. Nulls in a role or text are one space. A null conversation id is one
conversation. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

SEGMENT_ROWS, SEGMENT_BYTES = 8192, 8 << 20
BLANK = r"[^\x20\x09-\x0D]"
#: Letters in their ASCII order.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = np.array(["D", "I", "K", "R"])
STATES = 4  # before the first turn, after a system, a user, an assistant turn
#: The state after each state and initial (system, user, assistant, other); -1: not taken.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state after the turn that the grammar takes next, and that turn's role.
NEXT = np.array([2, 2, 3, 2])
ROLES = np.array(["user", "user", "assistant", "user"])
ENDS = np.array([True, False, False, True])
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1

    def __post_init__(self):
        if self.insert < 1 or min(self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("an insert must cost something, and nothing less than 0")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a twentieth of the rows each dropped, emptied, cut short, repeated, given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    named = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    copies = named.where("kind != 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _fault(text: Column) -> Column:
    """0 none, 1 blank, 3 truncated (2, a duplicate, is told apart later)."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(~F.regexp_like(text, F.lit(BLANK)), 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).cast("byte")


def segments(rows: DataFrame) -> DataFrame:
    """The rows in order, numbered and cut into segments; written once."""
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    digest = F.md5(F.concat_ws(":", F.length("role"), "role", "text"))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0)).cast("byte")
    rows = rows.select("*", digest.alias("digest"), initial.alias("initial"), _fault(F.col("text")).alias("fault"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 64), "digest"]
    dealt = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order, "any")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        at = segment = held_rows = held_bytes = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).tolist()
            numbers = np.empty(len(sizes), np.int64)
            for k, size in enumerate(sizes):
                if held_rows and (held_rows == SEGMENT_ROWS or held_bytes + size > SEGMENT_BYTES):
                    segment, held_rows, held_bytes = segment + 1, 0, 0
                held_rows, held_bytes = held_rows + 1, held_bytes + size
                numbers[k] = segment
            ids = np.arange(at, at + len(sizes))
            at += len(sizes)
            kept = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(part + numbers), pa.array(part + ids)], [*batch.schema.names, "segment", "id"])

    sorted_rows = dealt.sortWithinPartitions(*order).drop("any")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema)
    return written(sorted_rows.mapInArrow(run, f"{kinds}, segment long, id long"), "segments")


def states_of(rows: DataFrame) -> DataFrame:
    """What the search needs of each row, with duplicates: all but the first row of a role and text in a conversation."""
    firsts = rows.where("fault != 1").groupBy("conv_id", "digest").agg(F.min("id").alias("first_id"))
    light = rows.select("segment", "id", "conv_id", "initial", "fault")
    met = light.join(firsts.select("first_id"), F.col("id") == F.col("first_id"), "left")
    fault = F.when((F.col("fault") != 1) & F.col("first_id").isNull(), 2).otherwise(F.col("fault")).cast("byte")
    return written(met.select("segment", "id", "conv_id", "initial", fault.alias("fault")), "turn-states")


def least_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product under (min, +) of stacks of 4 x 4 matrices with stacks of matrices or vectors."""
    if b.ndim == a.ndim:
        return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)
    return np.minimum((a + b[..., None, :]).min(-1), FAR)


class Pieces:
    """The parts of conversations that lie in one segment, as nodes (layer, state): a layer before each row, one after the last."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, starts: np.ndarray, costs: Costs):
        self.costs, self.starts = costs, starts  # first row of each piece, then the number of rows
        self.rows, self.count = len(initial), len(starts) - 1
        piece = np.repeat(np.arange(self.count), np.diff(starts))
        self.layer = np.arange(self.rows) + piece
        self.first, self.last = starts[:-1] + np.arange(self.count), starts[1:] + np.arange(self.count)
        self.left = np.zeros(self.rows + self.count, np.int64)  # rows from a layer to the end of its piece
        self.left[self.layer] = starts[1:][piece] - np.arange(self.rows)
        to = AFTER[:, (initial - 1) % 4].T  # initials are 1 to 3 for system, user, assistant; 0 becomes 3: other
        free, more = (fault == 0) | (fault == 3), costs.truncated * (fault == 3)
        #: Cost and target state of each letter, from each row and state.
        price = np.full((4, self.rows, STATES), FAR, np.int64)
        price[DELETE] = costs.delete
        price[INSERT] = costs.insert
        price[KEEP] = np.where((to >= 0) & free[:, None], more[:, None], FAR)
        price[REROLE] = np.where(free[:, None], costs.rerole + more[:, None], FAR)
        self.price = price
        self.to = np.stack([np.broadcast_to(np.arange(STATES), to.shape), np.broadcast_to(NEXT, to.shape), np.maximum(to, 0), np.broadcast_to(NEXT, to.shape)])

    @staticmethod
    def closure(costs: Costs) -> np.ndarray:
        """Least cost from state to state by inserts."""
        one = np.full((STATES, STATES), FAR, np.int64)
        np.fill_diagonal(one, 0)
        one[np.arange(STATES), NEXT] = costs.insert
        return least_plus(least_plus(one, one), least_plus(one, one))

    @staticmethod
    def at_end(costs: Costs) -> np.ndarray:
        return least_plus(Pieces.closure(costs), np.where(ENDS, 0, FAR))

    def values(self, ends: np.ndarray) -> np.ndarray:
        """Least cost from each (layer, state), given that of the last layer of each piece."""
        step = np.full((self.rows, STATES, STATES), FAR, np.int64)
        for letter in (DELETE, KEEP, REROLE):
            for s in range(STATES):
                goal = self.to[letter][:, s]
                step[np.arange(self.rows), s, goal] = np.minimum(step[np.arange(self.rows), s, goal], self.price[letter][:, s])
        run = np.full((self.rows + self.count, STATES, STATES), FAR, np.int64)
        run[self.layer] = least_plus(np.broadcast_to(self.closure(self.costs), step.shape), step)
        out = np.full((self.rows + self.count, STATES), FAR, np.int64)
        out[self.last] = ends
        width, top = 1, int(self.left.max(initial=0))
        while width <= top:
            known = np.flatnonzero((self.left >= width) & (self.left < 2 * width))
            out[known] = least_plus(run[known], out[known + width])
            longer = np.flatnonzero(self.left >= 2 * width)
            run[longer] = least_plus(run[longer], run[longer + width])
            width *= 2
        return out

    def matrices(self) -> np.ndarray:
        """The least cost from state to state over each piece."""
        unit = np.where(np.eye(STATES, dtype=bool), 0, FAR)
        return np.stack([self.values(np.broadcast_to(unit[t], (self.count, STATES)))[self.first] for t in range(STATES)], -1)

    def solve(self, ends: np.ndarray, closed: np.ndarray) -> None:
        """Choose an arc for each node; ``closed`` pieces end a conversation, the others go on behind their last layer."""
        value = self.values(ends)
        layers = self.rows + self.count
        node = np.arange(layers * STATES).reshape(layers, STATES)
        targets = np.broadcast_to(node, (4, layers, STATES)).copy()
        cost = np.full((4, layers, STATES), FAR, np.int64)
        after = value[self.layer + 1]
        for letter in (DELETE, KEEP, REROLE):
            goal = self.to[letter]
            cost[letter, self.layer] = self.price[letter] + np.take_along_axis(after, goal, 1)
            targets[letter, self.layer] = np.take_along_axis(node[self.layer + 1], goal, 1)
        open_ends = np.ones(layers, bool)
        open_ends[self.last[~closed]] = False
        cost[INSERT, open_ends] = self.costs.insert + value[open_ends][:, NEXT]
        targets[INSERT] = node[:, NEXT]
        best = (cost == value).reshape(4, -1)
        targets = targets.reshape(4, -1)
        ends_here = ~best.any(0)
        # ranks by the first letter, then by twice as many letters each time
        letter = np.where(ends_here, -1, best.argmax(0))
        pointer = np.where(ends_here, np.arange(layers * STATES), targets[best.argmax(0), np.arange(layers * STATES)])
        rank, doubled = letter + 1, [pointer]
        while (doubled[-1] != (further := doubled[-1][doubled[-1]])).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[doubled[-1]], return_inverse=True)[1]
            doubled.append(further)
        # the ranks choose: least letter, then least rank behind it
        key = np.where(best, np.arange(4)[:, None] * (rank.max() + 1) + rank[targets], np.iinfo(np.int64).max)
        self.letter = np.where(ends_here, -1, key.argmin(0))
        assert (self.letter == letter).all()  # an arc's letter and node fix its target
        self.doubled = doubled
        self.steps = (~ends_here).astype(np.int64)
        for up in doubled[:-1]:
            self.steps = self.steps + self.steps[up]

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, node, state at the end) of all steps of all pieces in order, entered in these states; ends a piece."""
        begin = self.first * STATES + entry
        counts = self.steps[begin]
        piece = np.repeat(np.arange(self.count), counts)
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begin[piece]
        for k, pointer in enumerate(self.doubled):
            at = np.where(step >> k & 1, pointer[at], at)
        return piece, at, self.doubled[-1][begin] % STATES


def _pieces(light: pa.Table, costs: Costs) -> tuple[pa.Table, Pieces]:
    light = light.sort_by("id")
    codes = pc.run_end_encode(light.column("conv_id").combine_chunks()) if light.num_rows else None
    starts = np.concatenate([[0], np.asarray(codes.run_ends)]) if codes is not None else np.zeros(1, np.int64)
    return light, Pieces(light["initial"].to_numpy().astype(np.int64), light["fault"].to_numpy(), starts.astype(np.int64), costs)


def _given(carry: pa.Table, light: pa.Table, pieces: Pieces, costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(costs at the end, whether it is the conversation's end, state at the start) of each piece."""
    ends = np.broadcast_to(Pieces.at_end(costs), (pieces.count, STATES)).copy()
    closed, entry = np.ones(pieces.count, bool), np.zeros(pieces.count, np.int64)
    # other pieces than the first and the last lie in this segment only
    where = {light["conv_id"][int(pieces.starts[p])].as_py(): p for p in {0, pieces.count - 1}}
    for row in carry.to_pylist():
        p = where[row["conv_id"]]
        ends[p], closed[p], entry[p] = row["ends"], row["closed"], row["entry"]
    return ends, closed, entry


def _walk(pieces: DataFrame, fn, kind: str) -> DataFrame:
    """``fn`` over the pieces of each conversation in order: one row for each segment that it touches."""
    return written(pieces.groupBy("conv_id").applyInArrow(fn, kind), "walk")


def repaired(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Every row of ``rows`` and every inserted turn in order, with its edit.

    (conv_id, segment, place, turn, initial, fault, edit, role, text, cost): ``place`` orders the rows of a
    segment, segments order a conversation; ``fault`` is 0 none, 1 blank, 2 duplicate, 3 truncated and null for
    an inserted turn; ``role`` and ``text`` are as repaired; ``initial`` is the place of the initial found in
    ``sua`` (0: another); ``cost`` is that of the edit.
    """
    source = segments(rows)
    light = states_of(source)
    key = source.schema["conv_id"].dataType.simpleString()

    def borders(group: pa.Table) -> pa.Table:
        group, pieces = _pieces(group, costs)
        some = np.unique([0, pieces.count - 1])
        matrices = pieces.matrices()[some].reshape(len(some), -1)
        names, number = group["conv_id"].take(pa.array(pieces.starts[some])), group["segment"].slice(0, len(some))
        return pa.table([names, number, pa.array(matrices.tolist(), pa.list_(pa.int64()))], ["conv_id", "segment", "matrix"])

    touched = light.groupBy("segment").applyInArrow(borders, f"conv_id {key}, segment long, matrix array<long>")

    def backward(group: pa.Table) -> pa.Table:
        group = group.sort_by("segment") if group.num_rows > 1 else group.slice(0, 0)  # else it ends where it began
        value, ends = Pieces.at_end(costs), []
        for matrix in reversed(group["matrix"].to_pylist()):
            ends.append(value)
            value = least_plus(np.array(matrix).reshape(STATES, STATES), value)
        closed = np.arange(group.num_rows) == group.num_rows - 1
        return pa.table([group["conv_id"], group["segment"], pa.array([e.tolist() for e in ends[::-1]], pa.list_(pa.int64())), pa.array(closed)], ["conv_id", "segment", "ends", "closed"])

    known = _walk(touched, backward, f"conv_id {key}, segment long, ends array<long>, closed boolean")

    def exits(group: pa.Table, carry: pa.Table) -> pa.Table:
        out = pa.table([pa.array([], t) for t in (carry.schema.field("conv_id").type, pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()))], ["conv_id", "segment", "ends", "closed", "exits"])
        if not carry.num_rows:
            return out
        group, pieces = _pieces(group, costs)
        ends, closed, _ = _given(carry.append_column("entry", pa.array(np.zeros(carry.num_rows, np.int64))), group, pieces, costs)
        pieces.solve(ends, closed)
        reached = np.stack([pieces.doubled[-1][pieces.first * STATES + s] % STATES for s in range(STATES)], -1)
        first = group["conv_id"][0].as_py()
        found = [reached[0 if c == first else -1].tolist() for c in carry["conv_id"].to_pylist()]
        return carry.append_column("exits", pa.array(found, pa.list_(pa.int64()))).select(out.schema.names)

    ways = light.join(known.select("segment").distinct(), "segment", "left_semi").groupBy("segment").cogroup(known.groupBy("segment"))
    ways = ways.applyInArrow(exits, f"conv_id {key}, segment long, ends array<long>, closed boolean, exits array<long>")

    def forward(group: pa.Table) -> pa.Table:
        group, state, entry = group.sort_by("segment"), 0, []
        for way in group["exits"].to_pylist():
            entry.append(state)
            state = way[state]
        return group.drop_columns(["exits"]).append_column("entry", pa.array(entry, pa.int64()))

    carry = _walk(ways, forward, f"conv_id {key}, segment long, ends array<long>, closed boolean, entry long")

    def edits(group: pa.Table, carry: pa.Table) -> pa.Table:
        if not group.num_rows:
            return plan_of(group, *[np.zeros(0, np.int64)] * 4, costs)
        group, pieces = _pieces(group, costs)
        ends, closed, entry = _given(carry, group, pieces, costs)
        pieces.solve(ends, closed)
        piece, node, _ = pieces.paths(entry)
        return plan_of(group, piece, node, pieces.letter[node], node // STATES - piece, costs)

    def plan_of(group, piece, node, letter, row, costs) -> pa.Table:
        own = letter != INSERT
        place = np.arange(len(node))
        cases = np.minimum(row, max(group.num_rows - 1, 0))
        fault = group["fault"].to_numpy()[cases] if len(node) else np.zeros(0, np.int8)
        cut = costs.truncated * (own & (fault == 3) & (letter != DELETE))
        cost = np.choose(letter, [costs.delete, costs.insert, 0, costs.rerole]) + cut if len(node) else place
        # an insert behind the last row of a piece still belongs to that piece
        home = pa.array(pieces_row(group, piece)) if len(node) else pa.array([], pa.int64())
        return pa.table(
            [
                group["conv_id"].take(home), group["segment"].take(pa.array(np.zeros(len(node), np.int64))), pa.array(place),
                pa.array(group["id"].to_numpy()[cases] if len(node) else place, mask=~own), pa.array(fault, pa.int8(), mask=~own),
                pa.array(LETTERS[letter]) if len(node) else pa.array([], pa.string()),
                pa.array(ROLES[node % STATES], mask=(letter != INSERT) & (letter != REROLE)) if len(node) else pa.array([], pa.string()),
                pa.array(cost, pa.int64()),
            ],
            ["conv_id", "segment", "place", "id", "fault", "edit", "role", "cost"],
        )

    def pieces_row(group, piece) -> np.ndarray:
        starts = np.concatenate([[0], np.asarray(pc.run_end_encode(group["conv_id"].combine_chunks()).run_ends)])
        return starts[piece]

    plan_kind = f"conv_id {key}, segment long, place long, id long, fault byte, edit string, role string, cost long"
    plan = light.groupBy("segment").cogroup(carry.groupBy("segment")).applyInArrow(edits, plan_kind)
    texts = source.select("id", "turn", "initial", F.col("role").alias("old"), "text")
    both = plan.join(texts, "id", "left")
    return both.select(
        "conv_id", "segment", "place", "turn", "initial", "fault", "edit",
        F.coalesce("role", "old").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "cost",
    )


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ENDS = ("first_initial", "last_initial", "first_turn", "last_turn", "turns")


def conversation_digest(rows: DataFrame, repair: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` from the repaired turns: faults, cost, audit and digest.

    ``gaps`` counts turn numbers missing between the least and the greatest; ``illegal`` neighbours that may not
    follow each other, both before the repair.
    """
    key = repair.schema["conv_id"].dataType.simpleString()
    sums = ", ".join(f"{c} long" for c in (*_COUNTS, *_ENDS))
    part_kind = f"conv_id {key}, segment long, {sums}, audit string, lines string, sha string"

    def parts(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        cuts = np.concatenate([[0], np.asarray(pc.run_end_encode(group["conv_id"].combine_chunks()).run_ends)])
        edit, role, text, turn, cost = (group[c].to_pylist() for c in ("edit", "role", "text", "turn", "cost"))
        given = group["fault"].is_valid().to_numpy()
        fault, initial = (pc.fill_null(group[c], 0).to_numpy() for c in ("fault", "initial"))
        out = {c: [] for c in (*_COUNTS, *_ENDS, "audit", "lines", "sha")}
        for a, b in zip(cuts, cuts[1:]):
            lines = [f"{role[k]}:{text[k]}" for k in range(a, b) if edit[k] != "D"]
            joined = "\n".join(lines) if lines else None
            own, f = initial[a:b][given[a:b]], fault[a:b]
            turns = [t for t in turn[a:b] if t is not None]
            inner = 0 < a and b < len(edit)  # a whole conversation; the others may go on in other segments
            found = [0, *[int((f == kind).sum()) for kind in (1, 2, 3)], int(illegal(own[:-1], own[1:]).sum()), sum(cost[a:b])]
            found += [int(own[0]) if len(own) else None, int(own[-1]) if len(own) else None, turns[0] if turns else None, turns[-1] if turns else None]
            found += [len(set(turns)), "".join(edit[a:b]), None if inner else joined, hashlib.sha256((joined or "").encode()).hexdigest() if inner else None]
            for c, value in zip(out, found):
                out[c].append(value)
        kinds = [pa.int64()] * (len(_COUNTS) + len(_ENDS)) + [pa.string()] * 3
        made = [pa.array(values, t) for values, t in zip(out.values(), kinds)]
        return pa.table([group["conv_id"].take(pa.array(cuts[:-1])), group["segment"].take(pa.array(cuts[:-1])), *made], ["conv_id", "segment", *out])

    def illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ~(((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now is not None:
                        yield closed(now)
                    now = row | {"stream": hashlib.sha256((row["lines"] or "").encode()), "any": row["lines"] is not None, "audit": [row["audit"]]}
                    continue
                for c in _COUNTS:
                    now[c] += row[c]
                if row["first_initial"] is not None:
                    if now["last_initial"] is not None:
                        now["illegal"] += int(illegal(np.array(now["last_initial"]), np.array(row["first_initial"])))
                    now["last_initial"] = row["last_initial"]
                if row["turns"]:
                    now["turns"] += row["turns"] - (now["last_turn"] == row["first_turn"])
                    now["last_turn"] = row["last_turn"]
                    now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                if row["lines"] is not None:
                    now["stream"].update((("\n" if now["any"] else "") + row["lines"]).encode())
                    now["any"] = True
                now["audit"].append(row["audit"])
        if now is not None:
            yield closed(now)

    def closed(now: dict) -> pa.RecordBatch:
        gaps = now["last_turn"] - now["first_turn"] + 1 - now["turns"] if now["turns"] else 0
        values = [now["conv_id"], gaps, *[now[c] for c in _COUNTS[1:]], "".join(now["audit"]), now["sha"] or now["stream"].hexdigest()]
        kinds = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(repair.schema["conv_id"].dataType)
    kind = f"conv_id {key}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    pieces = repair.groupBy("segment").applyInArrow(parts, part_kind)
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment").drop("segment")
    found = dealt.mapInArrow(merged, kind).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """The digest of conversations that :func:`damaged` has harmed, after their repair."""
    return conversation_digest(rows, repaired(damaged(rows)))
