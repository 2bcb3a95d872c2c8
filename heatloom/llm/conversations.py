"""Repairs the order of roles in conversations at least cost, with the edits as an audit.

The search runs over the rows of a conversation with four states: nothing yet, after a system row, a user row that
waits for its answer, and after an answer. Each state keeps its cheapest list of edits as a node of a tree: the last
edit and a link to the node before, so lists share their prefixes. Nodes have links to their ancestors 1, 2, 4, ...
edits back and a rolling hash of their whole list. Two lists of equal cost are compared by a search for their longest
common prefix over those hashes, and what the hashes say is verified on the edits themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.session import materialise

#: States of a repaired conversation, and what a user row, an assistant row and a system row make of each.
EMPTY, SYSTEM, OPEN, ANSWERED = range(4)
STEP = {"u": {EMPTY: OPEN, SYSTEM: OPEN, ANSWERED: OPEN}, "a": {OPEN: ANSWERED}, "s": {EMPTY: SYSTEM}}
WANTED = {EMPTY: ("u", OPEN), SYSTEM: ("u", OPEN), OPEN: ("a", ANSWERED), ANSWERED: ("u", OPEN)}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)

_PRIME, _BASE = (1 << 61) - 1, 1_000_003
#: Nodes that a task keeps; a longer stretch of one conversation is finished as a piece of its own.
NODES = 400_000


class Edits:
    """Lists of edits as nodes of a tree. Node 0 is the empty list."""

    def __init__(self) -> None:
        self.edit, self.size, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, edit: str) -> int:
        new = len(self.edit)
        self.edit.append(edit)
        self.size.append(self.size[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % _PRIME)
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(tuple(up))
        return new

    def at(self, node: int, size: int) -> int:
        """The ancestor that is a list of ``size`` edits."""
        while (more := self.size[node] - size) > 0:
            node = self.up[node][more.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _fork(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes after the common prefix of two lists of one size, by hashes; equal nodes if there are none."""
        for k in range(max(len(self.up[a]), len(self.up[b])) - 1, -1, -1):
            if k < len(self.up[a]) and k < len(self.up[b]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def less(self, a: int, b: int) -> bool:
        """Whether list a comes before list b."""
        if a == b:
            return False
        size = min(self.size[a], self.size[b])
        x, y = self.at(a, size), self.at(b, size)
        if self.hash[x] != self.hash[y]:
            p, q = self._fork(x, y)
            if self.edit[p] != self.edit[q] and self._same(self.up[p][0], self.up[q][0]):
                return self.edit[p] < self.edit[q]
        elif self._same(x, y):
            return self.size[a] < self.size[b]
        return self.text(a) < self.text(b)  # hashes that collide

    def _same(self, a: int, b: int) -> bool:
        """Edit by edit, down to where the lists are one."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True


Front = dict[int, tuple[int, int]]  # state: cost, node


def _put(edits: Edits, front: Front, state: int, cost: int, node: int, edit: str) -> None:
    old = front.get(state)
    if old is None or cost < old[0]:
        front[state] = (cost, edits.add(node, edit))
    elif cost == old[0]:
        new = edits.add(node, edit)
        if edits.less(new, old[1]):
            front[state] = (cost, new)


def insert(edits: Edits, front: Front) -> Front:
    """Adds what up to two inserted rows reach; a third never pays."""
    out, changed = dict(front), list(front)
    for _ in range(2):
        states, changed = changed, []
        for state in states:
            (cost, node), to = out[state], WANTED[state][1]
            old = out.get(to)
            if old is None or cost + INSERT <= old[0]:
                _put(edits, out, to, cost + INSERT, node, "I")
                if out[to] is not old:
                    changed.append(to)
    return out


def advance(edits: Edits, front: Front, initial: str, fault: int) -> Front:
    """The front after one more row and what may be inserted behind it."""
    out: Front = {}
    keep = TRUNCATED if fault == CUT_OFF else 0
    for state, (cost, node) in front.items():
        _put(edits, out, state, cost + DELETE, node, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        if state in STEP.get(initial, ()):
            _put(edits, out, STEP[initial][state], cost + keep, node, "K")
        wanted, to = WANTED[state]
        if wanted != initial:
            _put(edits, out, to, cost + keep + REROLE, node, "R")
    return insert(edits, out)


class Piece(NamedTuple):
    """A stretch of a conversation: its first and last initials, illegal neighbours, and for each state before it the cost and edits up to each state after it."""

    first: str
    last: str
    illegal: int
    ways: dict[int, dict[int, tuple[int, str]]]


def close(edits: Edits, fronts: dict[int, Front]) -> dict[int, dict[int, tuple[int, str]]]:
    return {e: {s: (cost, edits.text(node)) for s, (cost, node) in front.items()} for e, front in fronts.items()}


def begin(states: tuple[int, ...]) -> tuple[Edits, dict[int, Front]]:
    """Fronts for each state that a stretch may begin in; BEGINNING is that of a conversation, where rows may be inserted before the first."""
    edits = Edits()
    return edits, {e: insert(edits, {EMPTY: (0, 0)}) if e == BEGINNING else {e: (0, 0)} for e in states}


BEGINNING = 4
ANY = (EMPTY, SYSTEM, OPEN, ANSWERED, BEGINNING)


class Stretch:
    """Reads the rows of one conversation in order, and cuts them into pieces of bounded size."""

    def __init__(self, states: tuple[int, ...], limit: int) -> None:
        self.limit, self.states, self.pieces, self.first = limit, states, [], ""
        self._open(states)

    def _open(self, states) -> None:
        self.edits, self.fronts = begin(states)
        self.started, self.last, self.illegal = False, "", 0

    def row(self, initial: str, fault: int, copies: int) -> None:
        """``copies`` equal rows; those after the first are blank or duplicates like it."""
        for k in range(copies):
            if len(self.edits.edit) > self.limit:
                self._cut()
            if self.started:
                self.illegal += self.last + initial not in LEGAL
            else:
                self.first, self.started = initial, True
            self.last = initial
            own = fault if not k or fault == BLANK else DUPLICATE
            self.fronts = {e: advance(self.edits, f, initial, own) for e, f in self.fronts.items()}

    def _cut(self) -> None:
        self.pieces.append(Piece(self.first, self.last, self.illegal, close(self.edits, self.fronts)))
        self._open(ANY[:4])

    def end(self) -> list[Piece]:
        if self.started:
            self._cut()
        return self.pieces


def _joined(parts: tuple) -> str:
    out = []
    while parts:
        parts, text = parts
        out.append(text)
    return "".join(reversed(out))


def compose(pieces: list[Piece]) -> tuple[int, str, int]:
    """Cost, audit and illegal neighbours of a whole conversation from its pieces in order."""
    front: dict[int, tuple[int, tuple]] = {BEGINNING: (0, ())}
    last, illegal = None, 0
    for piece in pieces:
        illegal += piece.illegal
        if last is not None:
            illegal += last + piece.first not in LEGAL
        last = piece.last
        new: dict[int, tuple[int, tuple]] = {}
        for state, (cost, parts) in front.items():
            for to, (more, text) in piece.ways.get(state, {}).items():
                way = (cost + more, (parts, text))
                if to not in new or way[0] < new[to][0] or (way[0] == new[to][0] and _joined(way[1]) < _joined(new[to][1])):
                    new[to] = way
        front = new
    ends = [(front[s][0], _joined(front[s][1])) for s in (EMPTY, ANSWERED) if s in front]
    cost, audit = min(ends)
    return cost, audit, illegal


# ---- the rows of a conversation ----

#: What is no visible character.
BLANKS = " \t\n\x0b\f\r"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (1 or 2) of (conv_id, turn, role, text), damaged by a checksum of id and turn. A null role or text is one blank."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    named = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(named.cast("binary")), F.lit(20))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    changed = rows.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"), kind.alias("_kind"),
    )
    return changed.where("_kind != 0").drop("_kind")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key")]


def runs(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation and turn as one: conv_id, turn, role, text_key (a hash of the text), fault of the first of them, copies.

    Rows of one turn are ordered by role and text_key. A text counts as seen
    if its role and 128-bit hash are.
    """
    text = F.col("text")
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    marked = rows.select("conv_id", "turn", "role", F.md5(text).alias("text_key"), F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT_OFF).alias("fault"), "copies")
    counted = materialise(marked.groupBy("conv_id", "turn", "role", "text_key").agg(F.first("fault").alias("fault"), F.sum("copies").alias("copies")), "runs")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    often = counted.where(F.col("fault") != BLANK).groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text_key").alias("_k")).agg(first.alias("first"), F.count("*").alias("n"))
    often = materialise(often.where("n > 1").select("_c", "_r", "_k", F.col("first.turn").alias("_turn")), "seen")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text_key") == F.col("_k"))
    later = F.col("_k").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    joined = counted.join(often, same, "left")
    return joined.select("conv_id", "turn", "role", "text_key", F.when((F.col("fault") != BLANK) & later, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "copies")


PIECES = "conv_id long, part int, number int, first string, last string, illegal long, ways array<struct<before:int,after:int,cost:long,edits:string>>"


def _search(limit: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a sorted partition to pieces; only its first conversation may have begun before."""
        from pyspark import TaskContext

        part, number, out, now, stretch = TaskContext.get().partitionId(), 0, [], None, None

        def finish():
            nonlocal number
            for p in stretch.end():
                ways = [{"before": e, "after": s, "cost": c, "edits": t} for e, to in p.ways.items() for s, (c, t) in to.items()]
                out.append({"conv_id": now, "part": part, "number": number, "first": p.first, "last": p.last, "illegal": p.illegal, "ways": ways})
                number += 1

        def drain():
            table = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return table

        schema = pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
            ("ways", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))),
        ])
        for batch in batches:
            for conv, role, fault, copies in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if stretch is None or conv != now:
                    if stretch is not None:
                        finish()
                    stretch, now = Stretch(ANY if stretch is None else (BEGINNING,), limit), conv
                stretch.row(role[:1], fault, copies)
            if len(out) > 1000:
                yield drain()
        if stretch is not None:
            finish()
        yield drain()

    return pieces


def _compose(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["number"]))
    if not rows:
        return pa.table({"conv_id": pa.array([], pa.int64()), "cost": pa.array([], pa.int64()), "audit": pa.array([], pa.string()), "illegal": pa.array([], pa.int64())})
    pieces = []
    for r in rows:
        ways: dict[int, dict[int, tuple[int, str]]] = {}
        for w in r["ways"]:
            ways.setdefault(w["before"], {})[w["after"]] = (w["cost"], w["edits"])
        pieces.append(Piece(r["first"], r["last"], r["illegal"], ways))
    cost, audit, illegal = compose(pieces)
    return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "cost": pa.array([cost], pa.int64()), "audit": [audit], "illegal": pa.array([illegal], pa.int64())})


def audits(found: DataFrame, limit: int = NODES) -> DataFrame:
    """conv_id, cost, audit and illegal of the conversations of ``runs``.

    Rows are range-partitioned by conversation and turn, so a conversation of any share of the rows is
    spread over tasks. Each stretch of it is searched from every state it may begin in; only the pieces,
    a few bytes for each row, meet again, in order.
    """
    slim = found.select("conv_id", "turn", "role", "text_key", "fault", "copies")
    placed = slim.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    pieces = placed.select("conv_id", "role", "fault", "copies").mapInArrow(_search(limit), PIECES)
    pieces = materialise(pieces, "pieces")
    # A conversation within one partition and piece is done.
    alone = F.size(F.filter("ways", lambda w: w["before"] == BEGINNING)) == F.size("ways")
    split = pieces.where(~alone)
    marks = materialise(split.select(F.col("conv_id").alias("_c")).distinct(), "split")
    whole = pieces.join(marks, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    ends = F.filter("ways", lambda w: w["after"].isin(EMPTY, ANSWERED))
    best = F.array_min(F.transform(ends, lambda w: F.struct(w["cost"].alias("cost"), w["edits"].alias("edits"))))
    done = whole.select("conv_id", best["cost"].alias("cost"), best["edits"].alias("audit"), "illegal")
    rest = pieces.join(marks, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    return done.unionByName(rest.groupBy("conv_id").applyInArrow(_compose, "conv_id long, cost long, audit string, illegal long"))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by conversation, its audit before its rows: applies the edits and hashes row after row. What is kept is one audit and one batch."""
    conv, digest, audit, at, state, some = None, None, "", 0, EMPTY, False
    ids, hashes = [], []

    def write(role: str, text: str) -> None:
        nonlocal some
        digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
        some = True

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            letter, state = WANTED[state]
            write(NAMES[letter], "")
            at += 1

    def finish() -> None:
        if digest is not None:
            inserted()
            ids.append(conv)
            hashes.append(digest.hexdigest())

    for batch in batches:
        for now, edits, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if edits is not None:
                finish()
                conv, digest, audit, at, state, some = now, hashlib.sha256(), edits, 0, EMPTY, False
                continue
            for _ in range(copies):
                inserted()
                edit = audit[at]
                at += 1
                if edit == "R":
                    letter, state = WANTED[state]
                    write(NAMES[letter], text)
                elif edit == "K":
                    state = STEP[role[:1]][state]
                    write(role, text)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
        ids, hashes = [], []
    finish()
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: of the repaired ``role:text`` rows, joined by line breaks.

    A SHA-256 has to see its bytes in order, so one task reads a conversation,
    but as a stream: it never holds the conversation.
    """
    none = F.lit(None)
    texts = rows.select("conv_id", none.cast("string").alias("audit"), "turn", "role", F.md5("text").alias("text_key"), "text", "copies")
    heads = found.select("conv_id", "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text_key"), none.cast("string").alias("text"), none.cast("long").alias("copies"))
    placed = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text_key")
    return placed.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_hash, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, limit: int = NODES) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are read by turn, nulls first; those of one turn by role and a hash of the text, equal ones side by side. The first
    fault of a row counts: blank, duplicate (role and text seen before), truncated (no mark of an ended sentence
    last). Roles and texts must not be null (see ``damage``). A conversation of any share of the rows is split,
    but for its hash (see ``repaired_hashes``); its audit, one letter for each edit, has to fit a string.
    """
    found = materialise(runs(rows), "faults")
    counted = found.groupBy("conv_id").agg(
        F.max("turn").cast("decimal(38,0)").alias("high"), F.min("turn").cast("decimal(38,0)").alias("low"), F.count_distinct("turn").alias("turns"),
        F.sum(F.when(F.col("fault") == BLANK, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == DUPLICATE, F.col("copies")).when(F.col("fault") == BLANK, 0).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == CUT_OFF, 1).otherwise(0)).alias("truncated"),
    )
    gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("turns")).try_cast("long"), F.when(F.col("turns") == 0, F.lit(0)))
    counted = counted.select(F.col("conv_id").alias("_c"), gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated")
    searched = materialise(audits(found, limit), "audits")
    hashes = repaired_hashes(rows, searched).withColumnRenamed("conv_id", "_h")
    joined = searched.join(counted, F.col("conv_id").eqNullSafe(F.col("_c"))).join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damages (conv_id, turn, role, text) and repairs it: one row for each conv_id there was.

    A null id is a conversation like others; null roles and texts are one blank, which is a blank row. A
    conversation that lost all rows has zeros, no edits and the hash of nothing. Repeated rows are
    duplicates; an empty table gives no rows; other columns are not read. gaps is null beyond 64 bits.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    done = repair(damage(conversations))
    joined = ids.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    lost, empty = F.col("audit").isNull(), hashlib.sha256(b"").hexdigest()
    zeros = [F.when(lost, F.lit(0).cast("long")).otherwise(F.col(c)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
