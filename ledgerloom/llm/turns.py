"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user-assistant pairs, by secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn; `mapInPandas` streams them through a dynamic programme whose state it carries across Arrow batches. The state is a cost for each of four places in the
grammar `(s?(ua)+)?` (nothing yet, after the system turn, after a user turn, after an assistant turn). What a row can change depends on its kind and on the relative costs only, so steps
are looked up in a small table. Each row leaves a byte per place, its backpointer.

Giant conversations: their turns are cut into ranges of `SPAN` turn numbers, which are streamed by different tasks, from each of the four places. A range leaves its counts, its costs from place to place, and
its backpointers, which are spilled, packed, to the shared folder; no task holds a conversation. The ranges of a conversation, a short row each, are then chained, first forward for the cost, then back for the
places that the cheapest way passes; last, the texts meet the ranges' backpointers, and edits are read off and applied range by range. That all runs on narrow rows without texts, but for the last step. `repair` is free of whole conversations throughout; `digest`
hashes each repaired conversation as one sequence, and so streams its texts through one task, turn by turn.

Edits: Keep, Rerole (to user or assistant), Delete (needed for blank and repeated turns), Insert (an empty user or assistant turn). Of the cheapest lists of edits the ASCII-least of their initials is taken; it fixes the repair. Lists
of rows in one place never begin one another, as each ends with its row's own letter, so their order is carried as a rank beside the cost.

Edge cases: a null role or text is one space; a role other than s..., u..., a... can't be kept, nor an empty one; null turns come first; rows of one turn stand by role and by a hash of their text (in no other order), equal rows next to each
other; a null conv_id is a conversation of its own; a conversation without rows is empty; an empty table gives an empty result; other columns are not read. All rows of one turn number are one task's.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: What edits cost, and what a truncated turn that stays adds.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turn numbers in one range, and rows of a range whose backpointers are spilled together.
SPAN, PIECE = 4_096, 65_536

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the place that an inserted or renamed turn leads to
_LETTERS = "DKR"
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Row kinds: initial in "sua-", times two, plus whether it is truncated; and rows that must go.
_GONE = 8


def _moves(kind: int) -> list[list[tuple[int, int, str]]]:
    """For each place, the (place, cost, letters) that a row of the kind leads to: inserts, then the row's own letter. More than two inserts only return to a place."""
    out = []
    for q in range(4):
        found = []
        for k in range(3):
            at = q
            for _ in range(k):
                at = _NEXT[at]
            base = INSERT * k
            found.append((at, base + DELETE, "I" * k + "D"))
            if kind != _GONE:
                late = TRUNCATED * (kind & 1)
                found.append((_NEXT[at], base + RENAME + late, "I" * k + "R"))
                to = _KEEPS.get("sua-"[kind >> 1], {}).get(at)
                if to is not None:
                    found.append((to, base + late, "I" * k + "K"))
        out.append(found)
    return out


class Steps:
    """The programme as an automaton: `step(state, kind)` is (cost added, next state, four backpointers). A state is (cost, rank) for each place, None where it can't be."""

    def __init__(self) -> None:
        self.states, self.ids, self.table, self.moves = [], {}, {}, [_moves(k) for k in range(9)]

    def state(self, vector: tuple) -> int:
        if vector not in self.ids:
            self.ids[vector] = len(self.states)
            self.states.append(vector)
        return self.ids[vector]

    def entry(self, place: int) -> int:
        return self.state(tuple((0, 0) if q == place else None for q in range(4)))

    def step(self, state: int, kind: int) -> tuple[int, int, bytes]:
        found = self.table.get((state, kind))
        if found is None:
            found = self.table[state, kind] = self._made(self.states[state], kind)
        return found

    def _made(self, vector: tuple, kind: int) -> tuple[int, int, bytes]:
        best = [None] * 4
        for q, held in enumerate(vector):
            if held is not None:
                for to, cost, letters in self.moves[kind][q]:
                    key = (held[0] + cost, held[1], letters, q)
                    if best[to] is None or key < best[to]:
                        best[to] = key
        least = min(b[0] for b in best if b)
        order = sorted((b[1], b[2]) for b in best if b)
        new = tuple(b and (b[0] - least, order.index((b[1], b[2]))) for b in best)
        back = bytes(255 if b is None else b[3] | (len(b[2]) - 1) << 2 | _LETTERS.index(b[2][-1]) << 4 for b in best)
        return least, self.state(new), back


def ends_of(vector: tuple, added: int) -> list[int]:
    """A vector as eight numbers, cost and rank for each place; a cost of -1 where it can't be."""
    return [x for v in vector for x in ((v[0] + added, v[1]) if v else (-1, -1))]


def traced(backs: bytes, place: int) -> list[str]:
    """The letters of each row, of the way that ends in `place`; `backs` has four bytes a row."""
    out = []
    for at in range(len(backs) - 4, -1, -4):
        b = backs[at + place]
        out.append("I" * (b >> 2 & 3) + _LETTERS[b >> 4])
        place = b & 3
    out.reverse()
    return out


# --- rows


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): a known damage for testing repairs, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it a user's. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (h == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1))).alias("__n"))
    return rows.drop("__n")


def _rows(turns: DataFrame, span: int) -> DataFrame:
    """The rows under keys without nulls: c0 and c (conversation), b (range), t0 and t (turn), role, text, dropped."""
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    some = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    part = F.when(turn.isNull(), F.lit(-(1 << 62))).otherwise(F.floor(turn / span)).cast("long")
    return turns.select(conv.isNotNull().cast("int").alias("c0"), some(conv).alias("c"), part.alias("b"), turn.isNotNull().cast("int").alias("t0"), some(turn).alias("t"), space("role"), space("text"), dropped.alias("dropped"))


KEY, ORDER = ["c0", "c"], ["t0", "t", "role", "h1", "h2"]


def _facts(rows: DataFrame) -> DataFrame:
    """Each row without its text: hashes, row kind, and whether its role and text are those of an earlier turn."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = 2 * (F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3))
    kind = kind + F.when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    hashed = rows.select(
        *KEY, "b", "t0", "t", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"), kind.cast("int").alias("kind"),
        F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), "dropped",
    )
    # partial counts first: only texts that a conversation has twice are looked up
    same = [*KEY, "h1", "h2"]
    firsts = hashed.filter("not dropped and not blank").groupBy(*same).agg(F.min(F.struct("t0", "t")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(*same, "first")
    return hashed.join(firsts, same, "left").withColumn("later", F.coalesce(F.struct("t0", "t") > F.col("first"), F.lit(False))).drop("first")


SCANNED = "c0 int, c long, b long, piece int, n long, head string, tail string, min_turn long, max_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, ends array<long>, backs array<binary>"
_LEGAL = {"su", "ua", "au"}


class _Range:
    """The rows of one piece of a range as they stream by; nothing of a row is kept but its backpointers."""

    def __init__(self, steps: Steps, key: tuple, piece: int, last: tuple | None):
        self.steps, self.key, self.piece, self.last = steps, key, piece, last
        self.at = [steps.entry(q) for q in range(4)]
        self.added, self.backs = [0] * 4, [bytearray() for _ in range(4)]
        self.n, self.head, self.tail, self.low, self.high, self.turns = 0, None, None, None, None, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn: int | None, same: tuple, kind: int, initial: str, blank: bool, later: bool) -> None:
        again = self.last is not None and self.last[1] == (turn, *same)
        if blank:
            self.counts["blank"] += 1
        elif later or again:
            self.counts["duplicate"] += 1
        elif kind & 1:
            self.counts["truncated"] += 1
        if blank or later or again:
            kind = _GONE
        if self.n and self.tail + initial not in _LEGAL:
            self.counts["illegal"] += 1
        if turn is not None:
            self.turns += self.last is None or self.last[0] != turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = (turn, (turn, *same))
        self.head, self.tail, self.n = self.head if self.n else initial, initial, self.n + 1
        for q in range(4):
            added, self.at[q], back = self.steps.step(self.at[q], kind)
            self.added[q] += added
            self.backs[q] += back

    def row(self) -> tuple:
        ends = [x for q in range(4) for x in ends_of(self.steps.states[self.at[q]], self.added[q])]
        backs = [zlib.compress(bytes(b), 1) for b in self.backs]
        return (*self.key, self.piece, self.n, self.head, self.tail, self.low, self.high, self.turns, *self.counts.values(), ends, backs)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names, kinds = zip(*(f.split(" ", 1) for f in schema.split(", ")), strict=True)
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if k == "long" else list(c) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})


def scan(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each piece of each range (`SCANNED`): the programme from each place, with its backpointers. Ranges whose rows were all dropped have n = 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, now = Steps(), None
        for f in frames:
            done = []
            for c0, c, b, t0, t, h1, h2, kind, initial, blank, dropped, later in f.itertuples(index=False, name=None):
                if now is None or now.key != (c0, c, b):
                    if now is not None:
                        done.append(now.row())
                    now = _Range(steps, (c0, c, b), 0, None)
                if now.n == piece:
                    done.append(now.row())
                    now = _Range(steps, now.key, now.piece + 1, now.last)
                if not dropped:
                    now.add(t if t0 else None, (h1, h2), kind, initial, blank, later)
            if done:
                yield _frame(done, SCANNED)
        if now is not None:
            yield _frame([now.row()], SCANNED)

    dealt = _facts(rows).repartition(*KEY, "b").sortWithinPartitions(*KEY, "b", *ORDER)
    return dealt.select(*KEY, "b", "t0", "t", "h1", "h2", "kind", "initial", "blank", "dropped", "later").mapInPandas(run, SCANNED)


CHAINED = "c0 int, c long, b long, piece int, entry int, exit int, tail_inserts int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class _Chain:
    """The ranges of one conversation in order. Of each, a backpointer per place is kept: 4 bytes, and 20 for its name."""

    def __init__(self, key: tuple):
        self.key, self.vector = key, ((0, 0), None, None, None)
        self.names, self.pieces, self.backs, self.tail = array("q"), array("i"), bytearray(), None
        self.sums, self.low, self.high, self.turns = [0, 0, 0, 0], None, None, 0

    def add(self, b: int, piece: int, n: int, head, tail, low, high, turns: int, counts: list[int], ends: list[int]) -> None:
        self.names.append(b)
        self.pieces.append(piece)
        self.turns += turns
        self.sums = [x + y for x, y in zip(self.sums, counts, strict=True)]
        if low is not None:
            self.low, self.high = low if self.low is None else min(self.low, low), high if self.high is None else max(self.high, high)
        if not n:
            self.backs += bytes(range(4))
            return
        if self.tail is not None and self.tail + head not in _LEGAL:
            self.sums[3] += 1
        self.tail = tail
        best = [None] * 4
        for q, held in enumerate(self.vector):
            for to in range(4) if held is not None else ():
                cost, rank = ends[8 * q + 2 * to : 8 * q + 2 * to + 2]
                if cost >= 0 and (best[to] is None or (held[0] + cost, held[1], rank, q) < best[to]):
                    best[to] = (held[0] + cost, held[1], rank, q)
        order = sorted((x[1], x[2]) for x in best if x)
        self.vector = tuple(x and (x[0], order.index((x[1], x[2]))) for x in best)
        self.backs += bytes(255 if x is None else x[3] for x in best)

    def rows(self) -> Iterator[tuple]:
        """A row per range, the last one first."""
        ways = []
        for q, held in enumerate(self.vector):
            at = q
            for k in range(3):
                if held is not None and at in (START, ASSISTANT):
                    ways.append((held[0] + INSERT * k, held[1], k, q))
                at = _NEXT[at]
        cost, _, inserts, place = min(ways)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        for i in range(len(self.names) - 1, -1, -1):
            last, entry = i == len(self.names) - 1, self.backs[4 * i + place]
            yield (*self.key, self.names[i], self.pieces[i], entry, place, inserts if last else 0, last, gaps, *self.sums, cost)
            place = entry


def chain(scanned: DataFrame) -> DataFrame:
    """A row for each piece (`CHAINED`): the places where the cheapest way enters and leaves it, and its conversation's figures."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            now = None
            for f in frames:
                for c0, c, b, piece, n, head, tail, low, high, turns, *counts, ends in zip(*(f[x].tolist() for x in f.columns), strict=True):
                    if now is None or now.key != (c0, c):
                        if now is not None:
                            yield from now.rows()
                        now = _Chain((c0, c))
                    known = turns > 0
                    now.add(b, piece, n, head, tail, low if known else None, high if known else None, turns, counts, ends)
            if now is not None:
                yield from now.rows()

        held = []
        for r in rows():
            held.append(r)
            if len(held) == 10_000:
                yield _frame(held, CHAINED)
                held = []
        if held:
            yield _frame(held, CHAINED)

    some = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    narrow = scanned.select(*KEY, "b", "piece", "n", "head", "tail", some("min_turn"), some("max_turn"), "n_turns", "blank", "duplicate", "truncated", "illegal", "ends")
    return narrow.repartition(*KEY).sortWithinPartitions(*KEY, "b", "piece").mapInPandas(run, CHAINED)


def plan(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """`CHAINED` with `backs`, the packed backpointers of the way that was taken through each piece."""
    scanned = written(scan(rows, piece), "turn-ranges")
    name = [*KEY, "b", "piece"]
    return scanned.select(*name, "backs").join(chain(scanned), name).withColumn("backs", F.get("backs", F.col("entry")))


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, range, edit, role, text) for each turn, and (key, None, figures, audit is whole, ...) at a conversation's end. Edits of a range come before its rows."""
    ready, place = [], START
    for f in frames:
        for c0, c, part, n_piece, entry, exit_, inserts, last, gaps, blank, duplicate, truncated, illegal, cost, backs, turn, role, text in f.itertuples(index=False, name=None):
            key = (c0, c)
            if n_piece >= 0:  # edits of a piece, the last of the conversation with its figures
                place = place if ready else entry
                letters = traced(zlib.decompress(backs), exit_)
                ready.append([iter(letters), len(letters), (inserts, (gaps, blank, duplicate, truncated, illegal, cost)) if last else None])
            else:
                ready[0][1] -= 1
                for x in next(ready[0][0]):
                    if x == "I":
                        place = _NEXT[place]
                        yield key, part, None, "I", _ROLE[place], ""
                    elif x == "D":
                        yield key, part, turn, "D", role, text
                    else:
                        place = _NEXT[place] if x == "R" or role[:1] != "s" else SYSTEM
                        yield key, part, turn, x, _ROLE[place] if x == "R" else role, text
            while ready and not ready[0][1]:
                inserts, figures = ready.pop(0)[2] or (0, None)
                if figures is not None:
                    for _ in range(inserts):
                        place = _NEXT[place]
                        yield key, part, None, "I", _ROLE[place], ""
                    yield key, None, figures, None, None, None


def _met(turns: DataFrame, span: int, piece: int, by: list[str]) -> DataFrame:
    """Rows and edits in one stream: of each range first its pieces' edits, then its rows in order, dealt to tasks by `by`; texts cross the network once."""
    rows = _rows(turns, span)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    zero = lambda kind, *names: [F.lit(0).cast(kind).alias(n) for n in names]
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    edits = plan(rows, piece).select(
        *KEY, "b", "piece", "entry", "exit", "tail_inserts", "last", *figures, "backs", *zero("int", "t0"), *zero("long", "t"), *none("string", "role", "text"), *zero("long", "h1", "h2"),
    )
    own = rows.filter("not dropped").select(
        *KEY, "b", F.lit(-1).alias("piece"), *zero("int", "entry", "exit", "tail_inserts"), F.lit(False).alias("last"), *zero("long", *figures), *none("binary", "backs"), "t0", "t", "role", "text",
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"),
    )
    met = edits.unionByName(own).withColumn("row", (F.col("piece") < 0).cast("int")).repartition(*by).sortWithinPartitions(*KEY, "b", "row", "piece", *ORDER)
    turn = F.when(F.col("t0") == 1, F.col("t").cast("string")).alias("turn")
    return met.select(*KEY, "b", "piece", "entry", "exit", "tail_inserts", "last", *figures, "backs", turn, "role", "text")


REPAIRED = "c0 int, c long, b long, at long, edit string, turn string, role string, text string"


def repair(turns: DataFrame, span: int = SPAN, piece: int = PIECE, chars: int = 4_000_000) -> DataFrame:
    """(conv_id, range, at, edit, turn, role, text): the turns of each conversation, in order of range and place in it, with what was done to each. Deleted turns are there with the edit D; the others are the repaired conversation.

    Ranges are repaired side by side, as each begins at a place of the grammar that is known by then, so no task gets more of a conversation than a range.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, now, at = [], 0, None, 0
        for key, part, turn, edit, role, text in _walk(frames):
            if part is not None:
                now, at = (key, part), at + 1 if now == (key, part) else 0
                held.append((*key, part, at, edit, turn, role, text))
                size += 200 + len(text)
            if size > chars:
                yield _frame(held, REPAIRED)
                held, size = [], 0
        if held:
            yield _frame(held, REPAIRED)

    out = _met(turns, span, piece, [*KEY, "b"]).mapInPandas(run, REPAIRED)
    return out.select(F.when(F.col("c0") == 1, F.col("c")).alias("conv_id"), F.col("b").alias("range"), "at", "edit", F.col("turn").cast("long").alias("turn"), "role", "text")


DIGEST = "c0 int, c long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(turns: DataFrame, span: int = SPAN, piece: int = PIECE) -> DataFrame:
    """A row per conversation: its faults, the cost of the repair, the edits' initials, and the hash of the repaired `role:text` lines, fed turn by turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, audit, said, n = [], [], hashlib.sha256(), 0
        for key, part, turn, edit, role, text in _walk(frames):
            if part is None:
                held.append((*key, *turn, "".join(audit), said.hexdigest()))
                audit, said, n = [], hashlib.sha256(), 0
                if len(held) == 2_000:
                    yield _frame(held, DIGEST)
                    held = []
                continue
            audit.append(edit)
            if edit != "D":
                said.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
        if held:
            yield _frame(held, DIGEST)

    out = _met(turns, span, piece, KEY).mapInPandas(run, DIGEST)
    return out.select(F.when(F.col("c0") == 1, F.col("c")).alias("conv_id"), *[f.split(" ")[0] for f in DIGEST.split(", ")[2:]])
