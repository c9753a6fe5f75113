"""Least-cost repair of the structure of conversations: which rows to keep, rerole, delete, and where to insert some.

A repaired conversation has the role initials ``(s?(ua)+)?``: an automaton of four states (nothing yet, behind s, behind
u, behind a). Keep costs 0, Rerole 2, Delete 3, Insert 2; a blank or repeated row has to go, a truncated one that stays
costs 1. Rows are cut into blocks of ``BLOCK`` rows, whatever the length of a conversation:

1. every block gives the least costs between its entry and exit states (a min-plus matrix);
2. a pass over the matrices gives the costs that remain at each border;
3. every block then finds its optimal arcs. Nodes (row, state) are ranked by the audits of 1, 2, 4, ... edits that begin
   there: the rank of twice the length is the rank of the pair (own rank, rank of the node that far on). The arcs that
   one node has differ in their initials, so the least rank of one edit selects the arc, and the doubled pointers run
   through the least path from each entry state;
4. a pass over the exits tells in which state each block is entered.

A conversation is held whole only in what the result itself holds whole, its audit; its digest reads rows as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import OrderedRows
from .shared import keep, prepare

BLOCK = 4096
OK, TRUNCATED, DELETE = 0, 1, 2
_FAR = 1 << 40
_NEXT = np.array([2, 2, 3, 2])  # the state behind a rerole or an insertion
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by role (s, u, a, other) and state
_END = np.array([0, 4, 2, 0])  # costs behind the last row, and the insertions that they stand for
_TAIL = ("", "II", "I", "")
_ROWS = 1 << 16  # rows handled by one round of arrays


def _layers(codes: list[np.ndarray], right: np.ndarray, arcs: bool):
    """Costs (n, 4, t) at the entries of n blocks from those behind them; with ``arcs`` (t = 1) also, by node, the least
    initial and the next node. Blocks come longest first; block i's nodes are 4 * (rows + 1) from ``begin[i]`` on.
    """
    sizes = np.array([len(c) for c in codes])
    padded = np.zeros((len(codes), int(sizes.max(initial=0))), np.int64)
    for i, c in enumerate(codes):
        padded[i, :len(c)] = c
    begin = np.concatenate([[0], np.cumsum(4 * (sizes + 1))])
    label, after = np.zeros(begin[-1], np.uint8), np.arange(begin[-1])
    costs = right.copy()
    for row in range(padded.shape[1] - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -row, "left"))
        code, behind = padded[:live, row], costs[:live]
        fault = (code % 3)[:, None, None]
        stay = np.where(fault == DELETE, _FAR, fault)
        delete = behind + 3
        rerole = np.minimum(behind[:, _NEXT] + 2 + stay, _FAR)
        to = _KEPT[code // 3]
        keep_ = np.where((to >= 0)[:, :, None], np.take_along_axis(behind, np.maximum(to, 0)[:, :, None], 1) + stay, _FAR)
        own = np.minimum(np.minimum(delete, rerole), keep_)
        best = own.copy()
        best[:, 2] = np.minimum(own[:, 2], own[:, 3] + 2)
        best[:, [0, 1, 3]] = np.minimum(own[:, [0, 1, 3]], best[:, 2:3] + 2)
        best = np.minimum(best, _FAR)
        if arcs:
            insert = best[:, _NEXT] + 2
            node = begin[:live, None] + 4 * row + np.arange(4)
            here = begin[:live, None] + 4 * row
            options = ((delete, b"D", here + 4 + np.arange(4)), (insert, b"I", here + _NEXT), (keep_, b"K", here + 4 + np.maximum(to, 0)),
                       (rerole, b"R", here + 4 + _NEXT))
            open_ = np.ones(node.shape, bool)
            for cost, initial, target in options:
                take = open_ & (cost == best)[:, :, 0]
                label[node[take]], after[node[take]] = initial[0], target[take]
                open_ &= ~take
        costs[:live] = best
    return costs, begin, label, after


def _ranked(label: np.ndarray, after: np.ndarray, steps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of nodes by their audits of up to ``steps`` edits, and pointers 1, 2, 4, ... edits on."""
    rank, jumps = label.astype(np.int64), [after]
    while 1 << (len(jumps) - 1) < steps:
        jump = jumps[-1]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)
        jumps.append(jump[jump])
    return rank, jumps


def _by_length(codes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of blocks, longest first, in runs of about one length and _ROWS rows."""
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(-sizes, kind="stable")
    start = 0
    while start < len(order):
        longest = max(1, int(sizes[order[start]]))
        run = order[start:start + max(1, _ROWS // longest)]
        run = run[sizes[run] * 2 >= longest] if longest > 1 else run
        yield run
        start += len(run)


def matrices(codes: list[np.ndarray]) -> np.ndarray:
    """Least costs (n, entry, exit) of blocks of rows, a row being 3 * role + fault."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for run in _by_length(codes):
        identity = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(run), 4, 4))
        out[run] = _layers([codes[i] for i in run], identity, False)[0]
    return out


def paths(codes: list[np.ndarray], right: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """Exit states (n, 4) and audits of the least of the cheapest paths from each entry state of blocks."""
    exits, audits = np.empty((len(codes), 4), np.int64), [[]] * len(codes)
    for run in _by_length(codes):
        mine = [codes[i] for i in run]
        _, begin, label, after = _layers(mine, right[run][:, :, None], True)
        steps = 3 * max(len(c) for c in mine) + 1  # at most two insertions stand before a row
        _, jumps = _ranked(label, after, steps)
        walk = (begin[:-1, None] + np.arange(4)).reshape(-1, 1)
        for jump in jumps[:-1]:
            walk = np.concatenate([walk, jump[walk]], 1)
        last = jumps[-1][walk[:, 0]]
        exits[run] = last.reshape(-1, 4) % 4
        text = label[walk]
        for j, i in enumerate(run.tolist()):
            audits[i] = [text[4 * j + q].tobytes().rstrip(b"\0").decode() for q in range(4)]
    return exits, audits


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(x, np.uint8) for x in batch.column("codes").to_pylist()]


def _matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = matrices(_codes(batch)).reshape(-1, 16).tolist()
            yield pa.RecordBatch.from_arrays([*batch.select(["key", "block"]).columns, pa.array(found, pa.list_(pa.int64()))],
                                             ["key", "block", "matrix"])


def _border_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs that remain behind each block of a conversation, from its last block to its first."""
    for batch in batches:
        keys, blocks, rights = [], [], []
        for key, found in zip(batch.column("key").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            cost = _END
            for x in reversed(found):
                keys.append(key)
                blocks.append(x["block"])
                rights.append(cost.tolist())
                cost = np.minimum((np.array(x["matrix"]).reshape(4, 4) + cost).min(1), _FAR)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blocks, pa.int64()),
                                          pa.array(rights, pa.list_(pa.int64()))], ["key", "block", "behind"])


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            exits, audits = paths(_codes(batch), np.array(batch.column("behind").to_pylist(), np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["key", "block"]).columns, pa.array(exits.tolist(), pa.list_(pa.int64())),
                 pa.array(audits, pa.list_(pa.string()))], ["key", "block", "exits", "audits"])


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block is entered, and what is inserted behind the last one."""
    for batch in batches:
        keys, blocks, states, tails = [], [], [], []
        for key, found in zip(batch.column("key").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            state = 0
            for x in found:
                keys.append(key)
                blocks.append(x["block"])
                states.append(state)
                state = x["exits"][state]
                tails.append("")
            tails[-1] = _TAIL[state]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blocks, pa.int64()), pa.array(states, pa.int64()),
                                          pa.array(tails, pa.string())], ["key", "block", "state", "tail"])


class Repair:
    """Applies edits to rows as they come."""

    def __init__(self):
        self.state, self.edits, self.at = 0, "", 0

    def put(self, role: str, initial: str) -> str:
        self.state = {"s": 1, "u": 2, "a": 3}[initial]
        return role

    def insert(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            role = ("user", "user", "assistant", "user")[self.state]
            yield self.put(role, role[0]), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.insert()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "R":
            role = ("user", "user", "assistant", "user")[self.state]
        if edit != "D":
            yield self.put(role, role[0]), text
        yield from self.insert()


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of repaired conversations from rows in order; the edits of a block come before its rows."""
    key, repair, digest, first = None, None, None, True

    def write(rows: Iterator[tuple[str, str]]) -> None:
        nonlocal first
        for role, text in rows:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])

    for batch in batches:
        finished = []
        for k, pos, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "role", "text", "audit")), strict=True):
            if k != key:
                if key is not None:
                    finished.append(done())
                key, repair, digest, first = k, Repair(), hashlib.sha256(), True
            if pos < 0:
                repair.edits, repair.at = audit, 0
            else:
                write(repair.row(role, text))
        yield from finished
    if key is not None:
        yield done()


def row_key(*columns: str) -> Column:
    """Values as one text, nulls told apart."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("\0", *parts)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows that the contract's damage leaves: (conv_id, turn, role, text), and what they are ordered by.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the
    row, 4 makes it the user's. Nulls count as one space there, and in roles and texts.
    """
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")),
        (F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))) % 20).alias("code"))
    return rows.where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.col("role").alias("role_before"), F.sha2("text", 256).alias("text_before"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def repair(rows: DataFrame, order_by: tuple[str, ...] = ("turn",), block: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``rows``.

    Rows (conv_id, turn, role, text) come by ``order_by``, nulls first; rows that agree in it come in any order, so it
    should end in what tells unlike rows apart. A row's first fault counts: blank (nothing but white space), duplicate
    (role and text seen earlier in the conversation), truncated (last visible character not one of ``.!?``). ``gaps``
    counts numbers missing between the smallest and largest turn, ``illegal`` neighbours whose initials are not su, ua
    or au. Of the cheapest repairs the one whose audit is least in ASCII counts. Rows without conv_id are one
    conversation; null roles and texts count as one space; an empty table gives an empty one.
    """
    prepare(rows.sparkSession)
    block = block or BLOCK
    space = F.lit(" ")
    known = rows.withColumns({
        "key": row_key("conv_id"), "role": F.coalesce(F.col("role"), space), "text": F.coalesce(F.col("text"), space),
        "turn": F.col("turn").cast("long"), "tie": F.monotonically_increasing_id()})
    visible = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")  # no other character counts as white space
    known = known.withColumns({
        "initial": F.substring("role", 1, 1),
        "fault": F.when(visible == "", DELETE).when(F.substring(visible, -1, 1).isin(".", "!", "?"), OK).otherwise(TRUNCATED),
        "same": F.sha2(F.concat_ws("\0", "key", F.length("role").cast("string"), "role", "text"), 256)})
    ordered = OrderedRows(known, [*order_by, "tie"], ["key"]).with_position("pos").rows()
    numbered = keep(ordered.select("key", "conv_id", "turn", "role", "text", "initial", "fault", "same", "pos"), "numbered-rows")

    often = numbered.where(F.col("fault") != DELETE).groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = F.col("pos") > F.coalesce("first", F.col("pos"))
    light = numbered.select("key", "conv_id", "turn", "initial", "fault", "same", "pos").join(
        often.select("same", "first"), "same", "left").withColumns({
            "role_code": F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3),
            "block": F.floor(F.col("pos") / block)}).withColumns({
                "blank": (F.col("fault") == DELETE).cast("long"),
                "duplicate": ((F.col("fault") != DELETE) & repeated).cast("long"),
                "truncated": ((F.col("fault") == TRUNCATED) & ~repeated).cast("long")})
    code = 3 * F.col("role_code") + F.when(F.col("blank") + F.col("duplicate") > 0, DELETE).otherwise(F.col("fault"))
    blocks = keep(light.groupBy("key", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", code.cast("int").alias("code"), "turn", "initial"))).alias("rows"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.first("conv_id").alias("conv_id")).select(
            "key", "conv_id", "block", "blank", "duplicate", "truncated", F.col("rows.code").alias("codes"),
            F.col("rows.initial").alias("initials"), F.array_distinct("rows.turn").alias("turns")).select(
                "key", "conv_id", "block", "blank", "duplicate", "truncated", "codes",
                F.element_at("initials", 1).alias("head"), F.element_at("initials", -1).alias("last"),
                F.expr("size(filter(transform(slice(initials, 2, size(initials)), (x, i) -> concat(initials[i], x)), "
                       "p -> p not in ('su', 'ua', 'au')))").cast("long").alias("illegal"),
                F.expr("filter(turns, x -> x is not null)").alias("turns")), "repair-blocks")

    def gathered(table: DataFrame, *columns: str) -> DataFrame:
        """One row per conversation with a struct for each of its blocks (a row for every ``block`` rows)."""
        return table.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("blocks"))

    matrix = blocks.select("key", "block", "codes").mapInArrow(_matrix_rows, "key string, block long, matrix array<long>")
    behind = gathered(matrix, "matrix").mapInArrow(_border_rows, "key string, block long, behind array<long>")
    found = keep(blocks.select("key", "block", "codes").join(behind, ["key", "block"]).mapInArrow(
        _path_rows, "key string, block long, exits array<long>, audits array<string>"), "repair-paths")
    entries = gathered(found, "exits").mapInArrow(_entry_rows, "key string, block long, state long, tail string")
    edits = keep(found.join(entries, ["key", "block"]).select(
        "key", "block", F.concat(F.get("audits", F.col("state").cast("int")), "tail").alias("audit")), "repair-edits")

    stream = numbered.select("key", F.floor(F.col("pos") / block).alias("block"), "pos", "role", "text", F.lit(None).cast("string").alias("audit"))
    orders = edits.select("key", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), "audit")
    digests = stream.unionByName(orders).repartition("key").sortWithinPartitions("key", "block", "pos").mapInArrow(
        _digest_rows, "key string, repaired_sha256 string")

    # Sums over blocks; what spans two blocks is taken from their edges.
    sums = gathered(blocks.select("key", "block", "head", "last", F.get("turns", F.lit(0)).alias("low"),
                                  F.get("turns", F.size("turns") - 1).alias("high"), F.size("turns").alias("n_turns")),
                    "head", "last", "low", "high", "n_turns")
    pairs = "transform(slice(blocks, 2, size(blocks)), (x, i) -> struct(blocks[i] as a, x as b))"
    edges = sums.select("key", F.expr(f"size(filter({pairs}, p -> concat(p.a.last, p.b.head) not in ('su', 'ua', 'au')))").alias("cut"), F.expr(
        "filter(blocks, x -> x.n_turns > 0)").alias("blocks")).select(
            "key", "cut", F.coalesce(F.expr(
                "get(blocks, size(blocks) - 1).high - get(blocks, 0).low + 1 - aggregate(blocks, 0, (n, x) -> n + x.n_turns) + "
                f"size(filter({pairs}, p -> p.a.high = p.b.low))").cast("long"), F.lit(0)).alias("gaps"))
    counts = blocks.groupBy("key").agg(F.first("conv_id").alias("conv_id"), *(
        F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    audits = edits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("a")).select(
        "key", F.array_join("a.audit", "").alias("audit"))
    costs = behind.where("block = 0").select("key", "behind").join(matrix.where("block = 0").select("key", "matrix"), "key").select(
        "key", F.expr("array_min(transform(behind, (x, i) -> x + matrix[i]))").alias("cost"))
    return counts.join(edges, "key").join(audits, "key").join(costs, "key").join(digests, "key").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("cut")).alias("illegal"), "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, block: int | None = None) -> DataFrame:
    """Repair of the damaged rows, one row for every conv_id of the input; conversations without rows left have zeros.

    Rows of equal turn come by original role, then by digest of the original text.
    """
    rows = damage(conversations)
    done = repair(rows, ("turn", "role_before", "text_before", "copy"), block).withColumn("key", row_key("conv_id")).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("key", row_key("conv_id"))
    return every.join(done, "key", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
