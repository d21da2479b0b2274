"""Conversation repair: role and fault signatures, each distinct one solved once, audits replayed on the rows.

1. Rows of a conversation are put in order by a range sort of narrow rows (no texts) over all conversations at once, so
   a conversation of any length is dealt to many tasks. Role and fault of a row are one letter; letters that follow each
   other in a task make a signature, of piece_rows rows at most.
2. The repaired roles are (s?(ua)+)?, an automaton of four states. Conversations of several pieces first get, by their
   pieces' cost tables, what remains to be paid behind each piece from each state.
3. Each distinct signature, with what remains behind it, is solved by a memoised recursion: least cost, then the
   audit that is least in ASCII. Before the end of a piece no edit but a row's own ends an audit, so audits of one
   piece are never a beginning of each other and the least whole audit is made of the least audits of the pieces.
4. Audits are joined back and sent ahead of the rows of their conversation, sorted; a task reads them as a stream,
   replays the edits and hashes the repaired rows. It holds one conversation's audit, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, map_arrow

#: Whitespace between words: \x20 and \x09-\x0D.
BLANKS = " \t\n\v\f\r"
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. Where each role's initial leads, and the role missing in each.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MISSING = ("user", "user", "assistant", "user")
STATES = range(4)
#: What ends a conversation in each state: the role words that are still missing.
ENDING = ("", "II", "I", "")
#: A row's letter: its role's initial, or x, in upper case if truncated; digits in place of the letters of ROLES, in
#: order, if blank, and the next four if a duplicate.
ROLES = "suax"
TABLE = [f"c{s}{t}" for s in STATES for t in STATES]


@dataclass(frozen=True)
class Repair:
    piece_rows: int = 256
    keep: int = 0
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


def letter_of(role: Column, blank: Column, truncated: Column) -> Column:
    """The letter of a row that is no duplicate."""
    initial = F.substring(role, 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(blank, F.translate(initial, ROLES, "0123")).when(truncated, F.upper(initial)).otherwise(initial)


def _moves(letter: str, state: int, r: Repair) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state; inserts are not among them."""
    yield "D", r.delete, state
    if letter.isalpha():
        extra = r.truncated if letter.isupper() else 0
        if (to := NEXT[state].get(letter.lower())) is not None:
            yield "K", r.keep + extra, to
        yield "R", r.rerole + extra, NEXT[state][MISSING[state][0]]


class Solver:
    """Memoised over the ends of signatures, so signatures that end alike share their solutions."""

    def __init__(self, r: Repair, most: int = 1 << 17):
        self.r = r
        self.best = lru_cache(most)(self._best)

    def _best(self, rest: str, state: int, behind: tuple[int, ...] | None) -> tuple[int, str]:
        """Least (cost, audit) of what is left of a signature; behind: costs after it from each state, None at the end."""
        if not rest:
            return (len(ENDING[state]) * self.r.insert, ENDING[state]) if behind is None else (behind[state], "")
        found, paid, inserts = [], 0, ""
        while len(inserts) < 3:  # after u and a the states repeat
            for edit, cost, to in _moves(rest[0], state, self.r):
                more, audit = self.best(rest[1:], to, behind)
                found.append((paid + cost + more, inserts + edit + audit))
            state, paid, inserts = NEXT[state][MISSING[state][0]], paid + self.r.insert, inserts + "I"
        return min(found)

    def solve(self, signature: str, state: int, behind: tuple[int, ...] | None) -> tuple[int, str]:
        return self.best(signature, state, behind)

    def table(self, signature: str) -> list[int]:
        """Costs from each state to each other one over a signature."""
        far = 1 << 40
        out = [[0] * 4 for _ in STATES]
        for to in STATES:
            behind = tuple(0 if s == to else far for s in STATES)
            for state in STATES:
                out[state][to] = self.best(signature, state, behind)[0]
        return [c for row in out for c in row]


def replay(letters: Iterator[str], audit: str, state: int) -> int:
    """The state after an audit, given each row's letter."""
    for edit in audit:
        if edit == "I":
            state = NEXT[state][MISSING[state][0]]
            continue
        letter = next(letters)
        if edit == "K":
            state = NEXT[state][letter.lower()]
        elif edit == "R":
            state = NEXT[state][MISSING[state][0]]
    return state


def counts(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours that are not su, ua or au."""
    roles = "".join(ROLES[int(c) % 4] if c.isdigit() else c.lower() for c in signature)
    legal = sum(roles[i : i + 2] in ("su", "ua", "au") for i in range(len(roles) - 1))
    return sum(c in "0123" for c in signature), sum(c in "4567" for c in signature), sum(c.isupper() for c in signature), max(0, len(roles) - 1) - legal


def _pieces(r: Repair):
    """(conv, part, piece, signature, low, high, turns, first, last) of rows sorted by conversation and order.

    turns: distinct turns of the piece, whose first and last one are given, too (nulls are left out).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "part", "piece", "signature", "turns", "first", "last"]
        now, rows = None, []

        def closed():
            return (now["conv"], now["part"], now["piece"], "".join(now["letters"]), now["turns"], now["first"], now["last"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            types = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), batch.schema.field("turn").type, batch.schema.field("turn").type]
            rows = []
            for conv, turn, letters, part in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "letters", "part"))):
                if now is None or conv != now["conv"] or now["size"] >= r.piece_rows:
                    if now is not None:
                        rows.append(closed())
                    piece = now["piece"] + 1 if now is not None and conv == now["conv"] else 0
                    now = {"conv": conv, "part": part, "piece": piece, "letters": [], "size": 0, "turns": 0, "first": None, "last": None}
                while now["size"] + len(letters) > r.piece_rows:  # a row that stands there very often
                    room = r.piece_rows - now["size"]
                    now["letters"].append(letters[:room])
                    letters = letters[room:]
                    if turn is not None and turn != now["last"]:
                        now |= {"turns": now["turns"] + 1, "first": turn if now["first"] is None else now["first"], "last": turn}
                    rows.append(closed())
                    now = {"conv": conv, "part": part, "piece": now["piece"] + 1, "letters": [], "size": 0, "turns": 0, "first": None, "last": None}
                if letters:
                    now["letters"].append(letters)
                    now["size"] += len(letters)
                    if turn is not None and turn != now["last"]:
                        now |= {"turns": now["turns"] + 1, "first": turn if now["first"] is None else now["first"], "last": turn}
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(), types)], names=names)

    return run


def _tables(r: Repair):
    """(signature, table): costs of each distinct signature from state to state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(r)
        for batch in batches:
            costs = [solver.table(s) for s in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(costs, pa.list_(pa.int64()))], names=["signature", "table"])

    return run


def _behind(r: Repair):
    """(conv, part, piece, behind): what remains to be paid behind each piece; rows come by conversation, last piece first.

    Costs are given less the least of them, which a solution doesn't depend on. The last piece has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs = object(), None
        for batch in batches:
            out = []
            for key, table in zip(batch.column("conv").to_pylist(), batch.column("table").to_pylist()):
                if key != conv:
                    conv, costs = key, None
                out.append(None if costs is None else [c - min(costs) for c in costs])
                behind = [len(e) * r.insert for e in ENDING] if costs is None else costs
                costs = [min(table[4 * s + t] + behind[t] for t in STATES) for s in STATES]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "piece")), pa.array(out, pa.list_(pa.int64()))], names=["conv", "part", "piece", "behind"])

    return run


def _solve(r: Repair):
    """(signature, behind, solved): the cost and audit from each state."""
    solved = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(r)
        for batch in batches:
            out = []
            for signature, behind in zip(batch.column("signature").to_pylist(), batch.column("behind").to_pylist()):
                behind, found = None if behind is None else tuple(behind), []
                for state in STATES:
                    cost, audit = solver.solve(signature, state, behind)
                    to = replay(iter(signature), audit, state)
                    found.append({"cost": cost - (behind[to] if behind else 0), "audit": audit, "to": to})
                out.append(found)
            tallies = [counts(s) for s in batch.column("signature").to_pylist()]
            cols = [batch.column("signature"), batch.column("behind"), pa.array(out, solved), pa.array(tallies, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["signature", "behind", "solved", "tallies"])

    return run


class _Replayed:
    """One conversation, as its pieces and then its rows come by."""

    def __init__(self, conv):
        self.conv, self.audit, self.state, self.cost = conv, [], 0, 0
        self.tallies, self.role = [0, 0, 0, 0], ""
        self.low = self.high = self.last = None
        self.turns, self.at, self.edits, self.now = 0, 0, "", 0
        self.digest, self.rows = hashlib.sha256(), 0

    def piece(self, signature: str, solved: list[dict], tallies: list[int], turns: int, first, last) -> None:
        one = solved[self.state]
        self.audit.append(one["audit"])
        self.cost, self.state = self.cost + one["cost"], one["to"]
        self.tallies = [a + b for a, b in zip(self.tallies, tallies)]
        if signature:
            ends = ["".join(ROLES[int(c) % 4] if c.isdigit() else c.lower()) for c in (signature[0], signature[-1])]
            self.tallies[3] += bool(self.role) and self.role + ends[0] not in ("su", "ua", "au")
            self.role = ends[1]
        if first is not None:
            self.turns += turns - (first == self.last)
            self.low, self.high, self.last = first if self.low is None else self.low, last, last

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.rows else "") + f"{role}:{text}").encode())
        self.rows += 1

    def missing(self) -> None:
        """The inserts that come next."""
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.put(MISSING[self.now], "")
            self.now, self.at = NEXT[self.now][MISSING[self.now][0]], self.at + 1

    def row(self, role: str, text: str, copies: int) -> None:
        if self.audit:
            self.edits, self.audit = "".join(self.audit), []
        for _ in range(copies):
            self.missing()
            edit, self.at = self.edits[self.at], self.at + 1
            if edit == "K":
                self.put(role, text)
                self.now = NEXT[self.now][role[:1]]
            elif edit == "R":
                self.put(MISSING[self.now], text)
                self.now = NEXT[self.now][MISSING[self.now][0]]

    def result(self) -> tuple:
        if self.audit:
            self.edits, self.audit = "".join(self.audit), []
        self.missing()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.tallies, self.cost, self.edits, self.digest.hexdigest())


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    now, types = None, []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        types, out = [batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()], []
        for row in batch.to_pylist():
            if now is None or row["conv"] != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Replayed(row["conv"])
            if row["solved"] is not None:
                now.piece(row["signature"], row["solved"], row["tallies"], row["turns"], row["first"], row["last"])
            else:
                now.row(row["role"], row["text"], row["copies"])
        if out:
            yield done(out)
    if now is not None:
        yield done([now.result()])


def repair_conversations(turns: DataFrame, r: Repair = Repair(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row per conversation: (conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    copies_col: how many times in a row each row stands; 0 leaves it out, and its conversation in. Without it, once.

    * Order: by turn, nulls first; rows of one turn by role, then by SHA-256 of the text, equal ones next to each other.
    * Null role or text: one space. A null conversation id is a conversation of its own. Null turns don't count for gaps.
    * A row's first fault counts: blank, duplicate (role and text seen earlier), truncated. Repeated rows are duplicates.
    * A role whose initial isn't s, u or a can't be kept. A conversation without rows: zeros, empty audit, hash of nothing.
    * Very long texts pass one at a time. The repaired text's hash runs through a conversation in order, so it is
      made in one task, as a stream. Empty table: empty result. Other columns, whatever their names, are not read.
    """
    scratch = Scratch(turns.sparkSession, "conversations")
    col = lambda c, name: F.coalesce(F.col(c), F.lit(" ")).alias(name)
    copies = F.lit(1) if copies_col is None else F.col(copies_col).cast("int")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), col(role_col, "role"), col(text_col, "text"), copies.alias("copies"))
    there = F.col("copies") > 0
    rows = rows.select("conv", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).otherwise("").alias("role"), F.when(there, F.col("text")).otherwise("").alias("text"), "copies")
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    end = F.rtrim("text", F.lit(BLANKS))
    narrow = rows.withColumn("letter", letter_of(F.col("role"), end == "", ~F.right(end, F.lit(1)).isin(".", "!", "?")))
    narrow = narrow.groupBy("conv", "turn", "role", "digest", "letter").agg(F.sum("copies").alias("copies"))
    narrow = scratch.write(narrow, "narrow")
    # Only what stands in several turns of a conversation is joined back.
    again = narrow.where(there).groupBy("conv", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first")).where("n > 1")
    again = again.select(F.struct("conv", "role", "digest").alias("key"), "first")
    marked = narrow.withColumn("key", F.struct("conv", "role", "digest")).join(again, "key", "left")
    later = F.col("first").isNotNull() & ~F.struct(F.col("turn").isNotNull(), "turn").eqNullSafe(F.col("first"))
    spare = F.translate(F.lower("letter"), ROLES, "4567")
    blank = F.col("letter").rlike("^[0-3]$")
    first = F.when(later & ~blank, spare).otherwise(F.col("letter"))
    # Of equal rows all but the first are duplicates, blank ones are blank.
    rest = F.repeat(F.when(blank, F.col("letter")).otherwise(spare), (F.col("copies") - 1).cast("int"))
    letters = F.when(there, F.concat(first, rest)).otherwise("")
    order = ["conv", "turn", "role", "digest"]
    dealt = marked.select(*order, letters.alias("letters")).repartitionByRange(*order).sortWithinPartitions(*order)
    conv, turn = (turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    pieces = map_arrow(dealt.select("conv", "turn", "letters", F.spark_partition_id().alias("part")), _pieces(r), f"conv {conv}, part int, piece bigint, signature string, turns bigint, first {turn}, last {turn}")
    pieces = scratch.write(pieces, "pieces")
    place = [F.struct("conv").alias("c"), "part", "piece"]
    several = pieces.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("conv").alias("c"))
    several = scratch.write(several, "several")
    if several.isEmpty():
        pieces = pieces.withColumn("behind", F.lit(None).cast("array<bigint>"))
    else:
        chained = pieces.withColumn("c", F.struct("conv")).join(several, "c", "left_semi").drop("c")
        tables = map_arrow(chained.select("signature").distinct(), _tables(r), "signature string, table array<bigint>")
        chained = chained.join(tables, "signature").select("conv", "part", "piece", "table")
        chained = chained.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("piece"))
        chained = scratch.write(map_arrow(chained, _behind(r), f"conv {conv}, part int, piece bigint, behind array<bigint>"), "behind")
        pieces = pieces.select(*place, "conv", "signature", "turns", "first", "last").join(chained.select(*place, "behind"), ["c", "part", "piece"], "left").drop("c")
    pieces = pieces.withColumn("task", F.struct("signature", "behind"))
    solved = map_arrow(pieces.select("signature", "behind").distinct(), _solve(r), "signature string, behind array<bigint>, solved array<struct<cost:bigint,audit:string,to:int>>, tallies array<bigint>")
    audits = pieces.join(solved.select(F.struct("signature", "behind").alias("task"), "solved", "tallies"), "task").drop("task", "behind")
    ahead = audits.select("conv", F.lit(False).alias("row"), "part", "piece", F.lit(None).cast(turn).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.lit(0).alias("copies"), "signature", "solved", "tallies", "turns", "first", "last")
    texts = rows.where(there).withColumn("row", F.lit(True))
    stream = ahead.unionByName(texts, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "row", "part", "piece", "turn", "role", "digest")
    stream = stream.select("conv", "role", "text", "copies", "signature", "solved", "tallies", "turns", "first", "last")
    out = map_arrow(stream, _replay, f"conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", conv_col)
