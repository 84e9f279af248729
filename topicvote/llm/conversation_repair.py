"""Repair of the turn structure of conversations by the cheapest edits, least audit first.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its audit is a letter for each edit:
K keeps a row (free), R gives it the role user or assistant (3), D deletes it (4), I inserts an
empty row of one of these roles (3). A blank or repeated row can only be deleted, and a truncated
row that is not deleted costs 3 more. Of the cheapest audits the one that is least in ASCII is taken.

A node is a place between rows together with what was said last (nothing yet, s, u, a); an arc is an
edit. The letters of the arcs out of a node differ, and so do their ends. Rows are sorted by
conversation and turn over the whole cluster and cut into segments of at most ``SEGMENT`` rows, so a
conversation of any length is spread over tasks:

1. each segment gives its costs from any state before it to any state behind it, a matrix of 4 x 4;
2. these matrices, a row for each segment, are combined from the last to the first: cost to go;
3. inside a segment the arcs that lie on cheapest paths are known from these costs. Their nodes are
   ranked by their least audits of 1, 2, 4, ... letters: the rank of twice the length follows from
   the rank of a node and the rank of the node that its pointer, doubled in each step, leads to. Each
   node takes the arc with the least letter and then the least rank of its end, and paths are read
   off the doubled pointers, from each state that a segment may be entered with;
4. from the first to the last segment it is followed which state that is.

Rows are taken by turn, null turns first, equal turns in the order of the input. Null roles and
texts are one space. Rows of a null ``conv_id`` are one conversation. Other columns are not read. An
empty table gives empty results; equal rows are repetitions; a role without ``s``, ``u`` or ``a`` as
its initial (or an empty one) can only be changed or deleted. Texts of any length stay out of all
steps but the last, where rows are joined with their texts by row number.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicvote.llm.common import column, sorted_groups
from topicvote.session import materialise, ship_package

SEGMENT = 2048
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, INSERT, KEEP, REROLE = b"DIKR"
NEXT = np.array([2, 2, 3, 2])  # the state that user or assistant leads to
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by initial s, u, a, other
AT_END = np.array([0, 6, 3, 0])  # what inserts behind the last row cost
LEGAL = {(0, 1), (1, 2), (2, 1)}
FAR = 1 << 50
SPACE = r"\x20\x09-\x0D"


class Repair(NamedTuple):
    """``steps``: conv_id, segment, at, action, row, role, text: the edits in order; ``row`` is null for an
    insert, role and text are those of the repaired row, null for a delete. ``summary``: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost."""

    steps: DataFrame
    summary: DataFrame


def _arcs(after: np.ndarray, kind: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of D, K and R out of every state, from costs to go ``after`` the row (row, state, ...)."""
    shape = (-1, *[1] * (after.ndim - 1))
    extra = np.where(fault == TRUNCATED, 3, np.where(fault == 0, 0, FAR)).reshape(shape)
    target = KEPT[kind]
    kept = after[np.arange(len(after))[:, None], target] + extra
    kept[target < 0] = FAR
    return after + 4, kept, after[:, NEXT] + 3 + extra


def sweep(
    kind: np.ndarray, fault: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None
) -> np.ndarray:
    """Costs to go at the beginning of each segment (segment, state, ...) from those at its end; all
    segments move a row at a time. ``keep`` gets the costs before each row."""
    order = np.argsort(-sizes, kind="stable")
    costs, left = ends[order].copy(), sizes[order]
    for back in range(1, int(left[0]) + 1 if len(left) else 1):
        n = int(np.searchsorted(-left, -back, side="right"))
        rows = starts[order[:n]] + left[:n] - back
        here = np.minimum.reduce(_arcs(costs[:n], kind[rows], fault[rows]))
        here = np.minimum.reduce([here, here[:, NEXT] + 3, here[:, NEXT[NEXT]] + 6])
        costs[:n] = np.minimum(here, FAR)
        if keep is not None:
            keep[rows] = costs[:n]
    out = np.empty_like(costs)
    out[order] = costs
    return out


def least_paths(
    kind: np.ndarray, fault: np.ndarray, sizes: np.ndarray, ends: np.ndarray, entries: np.ndarray
) -> list[tuple[bytes, bytes, int]]:
    """(audit, states after its letters, last state) of the cheapest, then least path of each of
    ``entries`` (segment, state) to the end of its segment."""
    segments, rows = len(sizes), len(kind)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(segments), sizes)
    before = np.empty((rows, 4), np.int64)
    sweep(kind, fault, starts, sizes, ends, before)
    place = np.arange(rows) + owner  # a segment has a place more than rows
    costs = np.empty((rows + segments, 4), np.int64)
    costs[place], costs[starts + sizes + np.arange(segments)] = before, ends
    delete, kept, rerole = _arcs(costs[place + 1], kind, fault)
    behind, state = 4 * (place + 1)[:, None], np.arange(4)
    arcs = [
        (DELETE, delete, behind + state),
        (INSERT, before[:, NEXT] + 3, 4 * place[:, None] + NEXT),
        (KEEP, kept, behind + KEPT[kind]),
        (REROLE, rerole, behind + NEXT),
    ]
    tight = np.stack([cost == before for _, cost, _ in arcs])
    targets = np.stack([np.broadcast_to(to, before.shape) for *_, to in arcs])
    letters = np.array([letter for letter, *_ in arcs])
    nodes = (4 * place[:, None] + state).ravel()
    first = tight.argmax(0)  # the arcs are in the order of their letters

    def along(choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter, to = np.zeros(4 * len(costs), np.int64), np.arange(4 * len(costs))
        letter[nodes] = letters[choice].ravel()
        to[nodes] = np.take_along_axis(targets, choice[None], 0)[0].ravel()
        return letter, to

    rank, pointer = along(first)
    length = (rank > 0).astype(np.int64)
    while True:  # ranks by audits of doubled lengths
        further = length[pointer]
        if not further.any():
            break
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        length, pointer = length + further, pointer[pointer]
    by_rank = np.where(tight, letters[:, None, None] * (int(rank.max(initial=0)) + 1) + rank[targets], FAR)
    letter, to = along(by_rank.argmin(0))

    begin = 4 * (starts + np.arange(segments))[entries[:, 0]] + entries[:, 1]
    wanted = length[begin]
    pointers, out = [to], [(b"", b"", 0)] * len(entries)
    doublings = np.ceil(np.log2(np.maximum(wanted, 1))).astype(int)
    for doubled in range(int(doublings.max(initial=0)) + 1):
        at = np.flatnonzero(doublings == doubled)
        path = begin[at][:, None]
        for jump in pointers[:doubled]:
            path = np.concatenate([path, jump[path]], axis=1)
        said, then = letter[path].astype(np.uint8), (to[path] % 4).astype(np.uint8)
        for i, k in enumerate(at):
            n = wanted[k]
            out[k] = (said[i, :n].tobytes(), then[i, :n].tobytes(), int(then[i, n - 1]) if n else int(begin[k] % 4))
        pointers.append(pointers[-1][pointers[-1]])
    return out


def _segmented(batches):
    """Sorted rows (conv_id, rid, kind, fault) with the number of their segment and their place in it; the last
    row of a segment has its costs, first and last initials and illegal pairs."""
    part, given = TaskContext.get().partitionId() << 33, 0
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    for table, codes, number in sorted_groups(batches, "conv_id", SEGMENT):
        n = table.num_rows
        kind, fault = (table.column(c).to_numpy().astype(np.int64) for c in ("kind", "fault"))
        heads = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
        sizes = np.diff(heads, append=n)
        segment = part + given + np.repeat(np.arange(len(heads)), sizes)
        given += len(heads)
        costs = sweep(kind, fault, heads, sizes, np.broadcast_to(unit, (len(heads), 4, 4)))
        wrong = np.ones(n, np.int64)
        for a, b in LEGAL:
            wrong[1:][(kind[:-1] == a) & (kind[1:] == b)] = 0
        wrong[heads] = 0
        last = np.zeros(n, bool)
        last[heads + sizes - 1] = True
        starts = np.concatenate([[0], np.cumsum(np.where(last, 16, 0))]).astype(np.int32)
        matrices = pa.ListArray.from_arrays(starts, pa.array(costs.ravel()), mask=pa.array(~last))
        blank = pa.nulls(n, pa.int64())

        def at_last(values):
            whole = np.zeros(n, np.int64)
            whole[last] = values
            return pa.array(whole, mask=~last)

        yield pa.RecordBatch.from_arrays(
            [
                table.column("conv_id").combine_chunks(),
                pa.array(segment),
                pa.array(np.arange(n) - np.repeat(heads, sizes)),
                table.column("rid").combine_chunks(),
                pa.array(kind.astype(np.int32)),
                pa.array(fault.astype(np.int32)),
                matrices if n else blank,
                at_last(kind[heads]),
                at_last(kind[heads + sizes - 1]),
                at_last(np.add.reduceat(wrong, heads)),
            ],
            ["conv_id", "segment", "seq", "rid", "kind", "fault", "costs", "first_kind", "last_kind", "illegal"],
        )


def _costs_to_go(batches):
    """Segments (conv_id, segment, costs, first_kind, last_kind, illegal) sorted by conversation and from the last:
    the costs to go at their ends, whether a segment is the first or last of its conversation, and the
    cost of all at the first one."""
    none = object()
    conv, go, later, waiting = none, None, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                if waiting is not None:
                    out.append(waiting | {"is_first": True})
                conv, go, is_last = row["conv_id"], AT_END, True
            else:
                out.append(waiting | {"is_first": False})
                waiting, is_last = None, False
            wrong = row["illegal"] + (0 if is_last else (row["last_kind"], later) not in LEGAL)
            waiting = {
                "conv_id": conv, "segment": row["segment"], "ends": go.tolist(), "illegal": wrong, "is_last": is_last
            }
            go = (np.array(row["costs"]).reshape(4, 4) + go).min(axis=1)
            waiting["cost"], later = int(go[0]), row["first_kind"]
        if out:
            yield pa.RecordBatch.from_pylist(out, _ends_schema(batch))
    if waiting is not None:
        yield pa.RecordBatch.from_pylist([waiting | {"is_first": True}], _ends_schema(batch))


def _ends_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema(
        [
            batch.schema.field("conv_id"),
            ("segment", pa.int64()),
            ("ends", pa.list_(pa.int64())),
            ("illegal", pa.int64()),
            ("is_last", pa.bool_()),
            ("cost", pa.int64()),
            ("is_first", pa.bool_()),
        ]
    )


def _solved(batches):
    """Rows (segment, seq, rid, kind, fault) behind a row of their segment's ends (seq -1), sorted: a row for
    each segment with its paths from all states it may be entered with."""
    for table, _, _ in sorted_groups(batches, "segment"):
        seq = table.column("seq").to_numpy()
        heads = np.flatnonzero(seq < 0)
        sizes = np.diff(heads, append=len(seq)) - 1
        body = seq >= 0
        rows = table.filter(pa.array(body))
        kind, fault, rid = (rows.column(c).to_numpy().astype(np.int64) for c in ("kind", "fault", "rid"))
        info = table.take(pa.array(heads))
        ends = np.array(info.column("ends").to_pylist(), np.int64).reshape(-1, 4)
        lone = np.array(info.column("is_first").to_pylist())
        wanted = np.array([(k, q) for k in range(len(heads)) for q in ([0] if lone[k] else range(4))])
        paths = least_paths(kind, fault, sizes, ends, wanted)
        by_state = [[(b"", b"", 0)] * 4 for _ in heads]
        for (k, q), path in zip(wanted.tolist(), paths, strict=True):
            by_state[k][q] = path
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                info.column("conv_id").combine_chunks(),
                info.column("segment").combine_chunks(),
                *(info.column(c).combine_chunks() for c in ("illegal", "is_last", "cost", "is_first")),
                pa.ListArray.from_arrays(cuts, pa.array(rid)),
                pa.array([[p[0] for p in s] for s in by_state], pa.list_(pa.binary())),
                pa.array([[p[1] for p in s] for s in by_state], pa.list_(pa.binary())),
                pa.array([[p[2] for p in s] for s in by_state], pa.list_(pa.int32())),
            ],
            ["conv_id", "segment", "illegal", "is_last", "cost", "is_first", "rids", "audits", "states", "exits"],
        )


def _followed(batches):
    """Segments sorted by conversation: each with the audit and states of its path."""
    state = 0
    for batch in batches:
        audits, states = [], []
        columns = (batch.column(c).to_pylist() for c in ("is_first", "is_last", "audits", "states", "exits"))
        for is_first, is_last, said, then, exits in zip(*columns, strict=True):
            state = 0 if is_first else state
            tail = {1: b"\x02\x03", 2: b"\x03"}.get(exits[state], b"") if is_last else b""
            audits.append(said[state] + b"I" * len(tail))
            states.append(then[state] + tail)
            state = exits[state]
        kept = [batch.column(c) for c in ("conv_id", "segment", "illegal", "cost", "is_first", "rids")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(audits, pa.binary()), pa.array(states, pa.binary())],
            ["conv_id", "segment", "illegal", "cost", "is_first", "rids", "audit", "states"],
        )


def _steps(batches):
    """A row for each letter of the audits."""
    for batch in batches:
        audits, states = batch.column("audit").to_pylist(), batch.column("states").to_pylist()
        sizes = np.array([len(a) for a in audits], np.int64)
        letters, then = (np.frombuffer(b"".join(x), np.uint8) for x in (audits, states))
        uses = letters != INSERT
        rids = np.zeros(len(letters), np.int64)
        rids[uses] = batch.column("rids").flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        told = (letters == INSERT) | (letters == REROLE)
        names = np.where(then == 2, "user", "assistant")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id").take(pa.array(owner)),
                batch.column("segment").take(pa.array(owner)),
                pa.array(np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)),
                pa.array(letters.view("S1").astype("U1"), pa.string()),
                pa.array(rids, mask=~uses),
                pa.array(names, pa.string(), mask=~told),
            ],
            ["conv_id", "segment", "at", "action", "rid", "new_role"],
        )


def _fault(text: Column, repeated: Column) -> Column:
    blank = ~text.rlike(f"[^{SPACE}]")
    ended = text.rlike(rf"[.!?][{SPACE}]*\z")
    return F.when(blank, BLANK).when(repeated, DUPLICATE).when(~ended, TRUNCATED).otherwise(0)


def repair(
    rows: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> Repair:
    ship_package(rows.sparkSession)
    space = F.lit(" ")
    numbered = materialise(
        rows.select(
            column(rows, conv_column).alias("conv_id"),
            column(rows, turn_column).alias("turn"),
            F.coalesce(column(rows, role_column), space).alias("role"),
            F.coalesce(column(rows, text_column), space).alias("text"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "turns",
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    said = F.sha2(F.concat(F.length("role").cast("string"), space, "role", "text"), 256)
    marked = materialise(
        numbered.select(
            "conv_id", "turn", "rid", kind.alias("kind"), F.unhex(said).alias("said"), _fault(F.col("text"), F.lit(False)).alias("fault")
        ),
        "marks",
    )
    firsts = marked.groupBy("conv_id", "said").agg(F.min(F.struct("turn", "rid")).alias("first"))
    firsts = firsts.select(F.col("first.rid").alias("rid"), F.lit(True).alias("is_first"))
    faulty = marked.join(firsts, "rid", "left").select(
        "conv_id", "turn", "rid", "kind",
        F.when((F.col("fault") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("fault")).alias("fault"),
    )
    faulty = materialise(faulty, "faults")
    conv = dict(rows.select(column(rows, conv_column)).dtypes)[conv_column]
    in_order = faulty.repartitionByRange("conv_id", "turn", "rid").sortWithinPartitions("conv_id", "turn", "rid")
    segmented = materialise(
        in_order.select("conv_id", "rid", "kind", "fault").mapInArrow(
            _segmented,
            f"conv_id {conv}, segment bigint, seq bigint, rid bigint, kind int, fault int, costs array<bigint>, "
            "first_kind bigint, last_kind bigint, illegal bigint",
        ),
        "segments",
    )
    ends_kind = f"conv_id {conv}, segment bigint, ends array<bigint>, illegal bigint, is_last boolean, cost bigint, is_first boolean"
    backward = segmented.filter("costs IS NOT NULL").select(
        "conv_id", "segment", "costs", "first_kind", "last_kind", "illegal"
    )
    backward = backward.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment"))
    ends = materialise(backward.mapInArrow(_costs_to_go, ends_kind), "ends")
    rows_and_ends = segmented.select("segment", "seq", "rid", "kind", "fault").unionByName(
        ends.withColumn("seq", F.lit(-1).cast("bigint")), allowMissingColumns=True
    )
    paths_kind = f"conv_id {conv}, segment bigint, illegal bigint, is_last boolean, cost bigint, is_first boolean, rids array<bigint>"
    solved = rows_and_ends.repartition("segment").sortWithinPartitions("segment", "seq").mapInArrow(
        _solved, f"{paths_kind}, audits array<binary>, states array<binary>, exits array<int>"
    )
    forward = solved.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    paths = materialise(
        forward.mapInArrow(
            _followed,
            f"conv_id {conv}, segment bigint, illegal bigint, cost bigint, is_first boolean, rids array<bigint>, "
            "audit binary, states binary",
        ),
        "paths",
    )
    steps = paths.mapInArrow(
        _steps, f"conv_id {conv}, segment bigint, at bigint, action string, rid bigint, new_role string"
    )
    texts = numbered.select("rid", "role", "text")
    deleted, inserted = F.col("action") == "D", F.col("action") == "I"
    steps = steps.join(texts, "rid", "left").select(
        "conv_id",
        "segment",
        "at",
        "action",
        F.col("rid").alias("row"),
        F.when(~deleted, F.coalesce("new_role", "role")).alias("role"),
        F.when(inserted, "").when(~deleted, F.col("text")).alias("text"),
    )
    count = lambda fault: F.count_if(F.col("fault") == fault)
    faults = faulty.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        count(BLANK).alias("blank"),
        count(DUPLICATE).alias("duplicate"),
        count(TRUNCATED).alias("truncated"),
    )
    costs = paths.groupBy(F.col("conv_id").alias("id")).agg(
        F.sum("illegal").alias("illegal"), F.max(F.when(F.col("is_first"), F.col("cost"))).alias("cost")
    )
    summary = faults.join(costs, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    return Repair(steps, summary)


def _hashed(batches):
    """conv_id, audit, repaired_sha256 of sorted steps; a conversation's rows are hashed as they come."""
    none = object()
    conv, audit, digest, lines = none, [], None, 0

    def out():
        row = {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                if conv is not none:
                    yield out()
                conv, audit, digest, lines = row["conv_id"], [], hashlib.sha256(), 0
            audit.append(row["action"])
            if row["action"] != "D":
                digest.update(("\n" * (lines > 0) + row["role"] + ":" + row["text"]).encode())
                lines += 1
    if conv is not none:
        yield out()


def digests(steps: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of the repaired ``role:text`` lines."""
    in_order = steps.select("conv_id", "segment", "at", "action", "role", "text").repartition("conv_id")
    kind = steps.schema["conv_id"].dataType.simpleString()
    return in_order.sortWithinPartitions("conv_id", "segment", "at").mapInArrow(
        _hashed, f"conv_id {kind}, audit string, repaired_sha256 string"
    )
