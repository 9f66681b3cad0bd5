"""Chat formatting with a minimum-cost repair of roles.

The legal turns form an automaton: an optional system turn first, then user and assistant
in turn, the assistant last.  Each turn either continues the repaired turn before it
(merge), begins the next one, or begins it after an empty turn that is inserted; it keeps
its role or is relabelled.  Dynamic programming over the automaton finds the cheapest
sequence; of equally cheap ones, the one whose states are least from the end backwards.

A conversation may be too long for one task.  Turns are range-partitioned by (conversation,
turn), so a conversation is a run of pieces.  What a piece does is a matrix: the cost to get
from each state to each other.  Matrices of pieces are chained per conversation (at most one
row per partition), which fixes the state at each border; then every piece finds its own
path between its borders.  No task holds more than its partition.

The result has a row for each turn with the text that it contributes to the rendered
conversation: in the order of `position`, fragments concatenate to the whole.  So a merged
turn or a conversation of any length needs no row of that length.

Turns are ordered by turn number, nulls first, then role and text; equal rows are turns of
their own.  A null conversation id is a conversation.  A null or unknown role is relabelled;
a null text is empty.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns that may follow each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEVER = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3
    unknown: int = 1


def entries(costs: Costs) -> list[list[tuple[int, str, int]]]:
    """For each state and next state: cost, action, inserted state (0: none)."""
    table = [[(NEVER, "", 0)] * 4 for _ in range(4)]
    for state in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            choices = []
            if to in LEGAL[state]:
                choices.append((0, "keep", 0))
            if to == state:
                choices.append((costs.merge, "merge", 0))
            for between in LEGAL[state]:
                if to in LEGAL[between]:
                    choices.append((costs.insert, "insert", between))
            if choices:
                table[state][to] = min(choices, key=lambda c: c[0])
    return table


def relabels(costs: Costs) -> dict[str | None, list[int]]:
    """Cost of each final state for a given role; None stands for unknown ones."""
    known = {
        role: [NEVER, *[0 if role == other else costs.relabel for other in ROLES]] for role in ROLES
    }
    return known | {None: [NEVER, costs.unknown, costs.unknown, costs.unknown]}


def final_costs(costs: Costs) -> list[int]:
    """Cost to end in a state: after a user or system turn, empty turns are added."""
    return [0, 2 * costs.insert, costs.insert, 0]


class Repair:
    def __init__(self, costs: Costs):
        self.enter = entries(costs)
        self.relabel = relabels(costs)
        self.final = final_costs(costs)

    def step(self, role: str | None) -> list[list[int]]:
        change = self.relabel.get(role, self.relabel[None])
        return [[self.enter[s][t][0] + change[t] for t in range(4)] for s in range(4)]

    def matrix(self, roles: list[str | None]) -> list[list[int]]:
        """Costs between the states before and after the turns."""
        steps: dict = {}
        total = [[0 if s == t else NEVER for t in range(4)] for s in range(4)]
        for role in roles:
            step = steps.get(role) or steps.setdefault(role, self.step(role))
            total = [[min(NEVER, *(row[m] + step[m][t] for m in range(4))) for t in range(4)] for row in total]
        return total

    def path(self, roles: list[str | None], before: int, after: int) -> list[int]:
        """The cheapest states of the turns between two given states."""
        costs = [0 if s == before else NEVER for s in range(4)]
        steps: dict = {}
        came: list[tuple[int, ...]] = []
        for role in roles:
            step = steps.get(role) or steps.setdefault(role, self.step(role))
            best = [min((costs[m] + step[m][t], m) for m in range(4)) for t in range(4)]
            came.append(tuple(m for _, m in best))
            costs = [min(NEVER, cost) for cost, _ in best]
        states = []
        for origin in reversed(came):
            states.append(after)
            after = origin[after]
        return states[::-1]

    def borders(self, matrices: list[list[list[int]]]) -> list[int]:
        """States at the borders of pieces in order, from the start to the end."""
        costs = [0, NEVER, NEVER, NEVER]
        came = []
        for matrix in matrices:
            best = [min((costs[m] + matrix[m][t], m) for m in range(4)) for t in range(4)]
            came.append([m for _, m in best])
            costs = [min(NEVER, cost) for cost, _ in best]
        state = min(range(4), key=lambda s: (costs[s] + self.final[s], s))
        states = [state]
        for origin in reversed(came):
            state = origin[state]
            states.append(state)
        return states[::-1]


@dataclass(frozen=True)
class Template:
    """How a turn is written."""

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    joint: str = "\n\n"

    def empty(self, state: int) -> str:
        return self.head.format(role=ROLES[state - 1]) + self.tail

    def fragment(self, text: str, state: int, action: str, inserted: int, first: bool, last: bool) -> str:
        parts = []
        if action == "merge":
            parts.append(self.joint)
        else:
            parts.append("" if first else self.tail)
            parts.append(self.empty(inserted) if inserted else "")
            parts.append(self.head.format(role=ROLES[state - 1]))
        parts.append(text)
        if last:
            parts.append(self.tail)
            while state != ASSISTANT:
                state = LEGAL[state][0]
                parts.append(self.empty(state))
        return "".join(parts)


def _runs(batches: Iterator, same) -> Iterator[tuple]:
    """Rows of adjacent equal conversations: (conversation, list of row tuples)."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if rows and not same(row[0], current):
                yield current, rows
                rows = []
            current = row[0]
            rows.append(row)
    if rows:
        yield current, rows


def _equal(a, b) -> bool:
    return a == b or (a is None and b is None)


def repair_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),
    template: Template = Template(),
) -> DataFrame:
    """One row per turn: conv_id, position, turn, role, new_role, action, inserted, fragment."""
    spark = turns.sparkSession
    conv_type, turn_type = turns.schema[conv_col].dataType, turns.schema[turn_col].dataType
    ordered = (
        turns.select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.lower(F.trim(F.col(role_col))).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        # the last key lets equal rows of a hot conversation part
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"), "row")
        .sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "row")
        .select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))
        # partitions and their order must be the same in both passes
        .checkpoint()
    )

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        repair = Repair(costs)
        found = []
        for conv, rows in _runs(batches, _equal):
            matrix = repair.matrix([row[1] for row in rows])
            found.append((conv, rows[0][2], len(rows), [cost for line in matrix for cost in line]))
        if found:
            conv, part, n, flat = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(conv, schema_of_ids["conv"]),
                    pa.array(part, pa.int32()),
                    pa.array(n, pa.int64()),
                    pa.array(flat, pa.list_(pa.int64())),
                ],
                ["conv_id", "part", "n", "matrix"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    schema_of_ids = {"conv": to_arrow_type(conv_type), "turn": to_arrow_type(turn_type)}
    piece_schema = T.StructType(
        [
            T.StructField("conv_id", conv_type),
            T.StructField("part", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("matrix", T.ArrayType(T.LongType())),
        ]
    )
    listed = ordered.select("conv_id", "role", "part").mapInArrow(pieces, piece_schema)
    # only conversations that cross a border: at most two pieces per partition
    per_conv = listed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "n", "matrix"))).alias("pieces")
    )
    crossing = per_conv.filter(F.size("pieces") > 1).collect()
    plan: dict = {}
    repair = Repair(costs)
    for row in crossing:
        matrices = [[list(p.matrix[4 * s : 4 * s + 4]) for s in range(4)] for p in row.pieces]
        states, position = repair.borders(matrices), 0
        for k, piece in enumerate(row.pieces):
            plan[row.conv_id, piece.part] = (
                states[k],
                states[k + 1],
                position,
                k == 0,
                k == len(row.pieces) - 1,
            )
            position += piece.n
    shared = spark.sparkContext.broadcast(plan)

    result_schema = T.StructType(
        [
            T.StructField("conv_id", conv_type),
            T.StructField("position", T.LongType()),
            T.StructField("turn", turn_type),
            T.StructField("role", T.StringType()),
            T.StructField("new_role", T.StringType()),
            T.StructField("action", T.StringType()),
            T.StructField("inserted", T.StringType()),
            T.StructField("fragment", T.StringType()),
        ]
    )

    def render(batches: Iterator) -> Iterator:
        import pyarrow as pa

        repair = Repair(costs)
        kinds = [schema_of_ids["conv"], pa.int64(), schema_of_ids["turn"], *[pa.string()] * 5]

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                result_schema.names,
            )

        made, held = [], 0
        for conv, rows in _runs(batches, _equal):
            roles = [row[2] for row in rows]
            piece = shared.value.get((conv, rows[0][4]))
            if piece is None:
                states = repair.borders([repair.matrix(roles)])
                piece = (states[0], states[1], 0, True, True)
            state, after, position, opens, closes = piece
            for k, to in enumerate(repair.path(roles, state, after)):
                _, action, inserted = repair.enter[state][to]
                first, last = opens and k == 0, closes and k == len(rows) - 1
                text = template.fragment(rows[k][3], to, action, inserted, first, last)
                made.append(
                    (
                        conv,
                        position + k,
                        rows[k][1],
                        roles[k],
                        ROLES[to - 1],
                        action,
                        ROLES[inserted - 1] if inserted else None,
                        text,
                    )
                )
                held += len(text)
                state = to
                if held > 8 << 20:
                    yield out(made)
                    made, held = [], 0
        if made:
            yield out(made)

    return ordered.select("conv_id", "turn", "role", "text", "part").mapInArrow(render, result_schema)
