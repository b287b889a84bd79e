"""Chat formatting into budgeted windows of whole turns.

Every conversation becomes windows of at most `budget` tokens: the leading system turn is kept in each, up to `history` tokens
of the turns just before are repeated for context, and only assistant turns that are new in a window carry the loss. Tokens are those of the turn as it is written, with its
marks, role and escapes; `tokenizer_tokens` counts them with a tokenizer of the tokenizers library.

No conversation is one task. A turn's place and the tokens before it are prefix sums at two levels, inside chunks of turn
numbers and over the chunks. Where a window ends depends on where it starts, and on nothing else before that, so each range
of turns tells, from numbers alone, where it would be left from each turn that it may be entered at. These answers are
chained, one small row a range, and the ranges then write their windows side by side, each from the state carried to it.

Edge cases: a null role or text is empty; a turn longer than the budget is a window of its own; a system turn is kept even where it fills the budget, so
windows then hold it and one turn more; a turn counts as one token at least; equal turn numbers are ordered
by role and text and are one task's; null turn numbers come first; a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BUDGET = 2_048
HISTORY = 512
#: Tokens that a turn's marks take by `default_tokens`.
MARKS = 4
#: Turn numbers of a chunk of the prefix sums.
CHUNK = 4_096
#: Turns of a range, in budgets: a window takes no more turns than the budget, so it leaves a range into the next one at most.
RANGE_BUDGETS = 16

# Each turn is OPEN role SEP text CLOSE. These strings, and the marks of common templates, never stay whole inside a text.
OPEN, SEP, CLOSE = "<|turn|>", "\n", "<|end|>\n"
CONTROL = re.compile(r"<(?=\|(?:turn|end|im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|</?SYS>>)|\[(?=/?INST\])")
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)  # neither mark is ever whole inside a role or text
_ESCAPED = re.compile(r"\\(.)", re.S)

SCHEMA = "conv_id long, window long, first_turn long, n_context int, n_turns int, n_tokens long, text string, loss array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    """A backslash before each backslash, and one after the first character of each control string."""
    return CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\x00")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "\x00" else m[1], text)


def rendered(role: Column, text: Column) -> Column:
    """A turn as `_render` writes it."""

    def escaped(c: Column) -> Column:
        return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL.pattern, "$0\\\\")

    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("\\\x00")), F.lit(SEP), escaped(text), F.lit(CLOSE))


def default_tokens(turn: Column) -> Column:
    """Words and signs of a rendered turn; its two marks, of five pieces each, count as `MARKS`."""
    return F.regexp_count(turn, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") - 10 + MARKS


def tokenizer_tokens(path: str) -> Callable[[Column], Column]:
    """Counts the tokens of rendered turns with the tokenizer of a file; a window's tokens are the sum over its turns."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for turns in batches:
            yield pd.Series([len(tokenizer.encode(t, add_special_tokens=False).ids) for t in turns], dtype="int64")

    return count


def _render(turns: list[tuple], n_context: int) -> tuple[str, list[dict]]:
    parts, loss, at = [], [], 0
    for i, (role, text, _) in enumerate(turns):
        head, body = f"{OPEN}{escape_role(role)}{SEP}", escape(text)
        if role == "assistant" and i >= n_context:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), loss


class _Windows:
    """The open window of the range being read; rows come sorted by conversation, range and place."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history

    def start(self, conv) -> None:
        self.conv, self.system, self.fresh, self.past, self.recent, self.window, self.at, self.base = conv, None, [], [], deque(), 0, 0, 0

    def remember(self, turn: tuple, before: int) -> None:
        """`recent` are the turns just before the next one, up to `history` tokens, each with the tokens before it."""
        self.recent.append((turn, before))
        while self.recent and before + turn[2] - self.recent[0][1] > self.history:
            self.recent.popleft()

    def push(self, turn: tuple, before: int, place: int) -> dict | None:
        """Take a turn that `before` tokens precede; gives the window that it closed."""
        done, after = None, before + turn[2]
        if self.fresh and after - self.base > self.room:
            done = self.close()
        if not self.fresh:  # as much history as the new turn leaves room for
            self.at, self.room = place, self.budget - (self.system[2] if self.system else 0)
            kept = [(t, b) for t, b in self.recent if after - b <= self.room]
            self.past, self.base = [t for t, _ in kept], kept[0][1] if kept else before
        self.fresh.append(turn)
        if place or turn[0] != "system":
            self.remember(turn, before)
        return done

    def close(self) -> dict:
        context = ([self.system] if self.system else []) + self.past
        turns = context + self.fresh
        text, loss = _render(turns, len(context))
        row = {"conv_id": self.conv, "window": self.window, "first_turn": self.at, "n_context": len(context), "n_turns": len(turns), "n_tokens": sum(t[2] for t in turns), "text": text, "loss": loss}
        if not self.at and self.fresh[0][0] == "system":
            self.system = self.fresh[0]
        self.fresh, self.past, self.window = [], [], self.window + 1
        return row


def _to_batches(rows: Iterator[dict], schema: pa.Schema, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r.get("text") or "")
        if size > chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_WINDOW_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_context", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _window_ends(at: np.ndarray, sums: np.ndarray, first: int, system: int | None, budget: int, history: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows end that start at the places `at`, and where the history before them starts.

    `sums` are the tokens before each place from `first` on, and after the last; places are counted from `first`.
    """
    room = np.where(at + first > 0, budget - (system or 0), budget)
    past = np.maximum(np.searchsorted(sums, sums[at] - history), 0 if system is None else max(1 - first, 0))
    past = np.minimum(past, at)
    kept = np.minimum(np.maximum(past, np.searchsorted(sums, sums[at + 1] - room)), at)
    return np.maximum(np.searchsorted(sums, sums[kept] + room, "right") - 1, at + 1), past


_CUTS = "conv_id long, r long, low long, total long, ends array<long>, steps array<long>, past array<long>"
_CUTS_ARROW = pa.schema([("conv_id", pa.int64()), ("r", pa.int64()), ("low", pa.int64()), ("total", pa.int64()), ("ends", pa.list_(pa.int64())), ("steps", pa.list_(pa.int64())), ("past", pa.list_(pa.int64()))])
_STARTS = "conv_id long, r long, entry long, past long, next_past long, window long"
_STARTS_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _STARTS.split(", ")])


def _cuts(numbers: DataFrame, size: int, budget: int, history: int) -> DataFrame:
    """For each range of `size` turns and each turn at which it may be entered: the place of the first window behind it,
    how many windows it starts, and where the history before the entry begins.

    A range sees the numbers of `budget` turns behind it and of `history` before it, so its group is bounded.
    """
    own, inside = F.expr(f"i div {size}"), F.col("i") % size
    near = F.array(own, F.when((inside <= budget) & (own > 0), own - 1), F.when((inside >= size - history) & ((own + 1) * size < F.col("total")), own + 1))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        p, n = rows["p"].to_numpy(), rows["n"].to_numpy()
        first, r, total, system = (rows[c][0].as_py() for c in ("i", "r", "total", "s"))
        low, high = r * size, min((r + 1) * size, total)
        ends, past = _window_ends(np.arange(low, high) - first, np.append(p, p[-1] + n[-1]), first, system, budget, history)
        ends, steps = (ends + first).tolist(), [1] * (high - low)
        for x in reversed(range(high - low)):
            if ends[x] < high:
                steps[x] += steps[ends[x] - low]
                ends[x] = ends[ends[x] - low]
        row = {"conv_id": rows["conv_id"][0].as_py(), "r": r, "low": low, "total": total, "ends": ends[: budget + 1], "steps": steps[: budget + 1], "past": (past[: budget + 1] + first).tolist()}
        return pa.Table.from_pylist([row], schema=_CUTS_ARROW)

    return numbers.select("conv_id", "i", "p", "n", "s", "total", F.explode(F.array_compact(near)).alias("r")).groupBy("conv_id", "r").applyInArrow(run, _CUTS)


def _starts(cuts: DataFrame) -> DataFrame:
    """Where each range is entered, from where on it needs history, the same of the next range, and its first window's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            held = None
            for b in batches:
                for x in range(b.num_rows):
                    conv, r, low, total, ends, steps, past = (b.column(c)[x].as_py() for c in _CUTS_ARROW.names)
                    if not r:
                        if held:
                            yield held
                        held, entry, window = None, 0, 0
                    begins = past[entry - low] if entry < total else None
                    if held:
                        yield held | {"next_past": begins}
                    held = {"conv_id": conv, "r": r, "entry": entry, "past": begins, "next_past": None, "window": window}
                    if entry < total:
                        window, entry = window + steps[entry - low], ends[entry - low]
            if held:
                yield held

        yield from _to_batches(rows(), _STARTS_ARROW)

    return cuts.repartition("conv_id").sortWithinPartitions("conv_id", "r").mapInArrow(run, _STARTS)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = default_tokens, size: int | None = None) -> DataFrame:
    """Windows of the conversations (conv_id, turn, role, text), by `SCHEMA`; `loss` holds code-point spans of `text`.

    `tokens` counts those of a rendered turn. `size` is the turns of a range, over twice the budget and the history. The counted turns are
    written to the shared folder once; a task writes windows of one range at a time and holds one window.
    """
    size = size or RANGE_BUDGETS * max(budget, history, 256)
    if size <= 2 * max(budget, history):
        raise ValueError("a range must hold over twice the budget and the history")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sized = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.floor(F.col("turn") / CHUNK).alias("chunk"), role.alias("role"), text.alias("text"))
    sized = sized.withColumn("n", F.greatest(tokens(rendered(F.col("role"), F.col("text"))), F.lit(1)).cast("long"))
    order = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    local = written(sized.select("conv_id", "chunk", "role", "text", "n", (F.count("*").over(order) - 1).alias("k"), (F.sum("n").over(order) - F.col("n")).alias("q")), "chat-turns")

    leads = (F.col("k") == 0) & (F.col("role") == "system")
    sums = local.groupBy("conv_id", "chunk").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.max(F.when(leads, F.col("n"))).alias("n0"), F.max(F.when(leads, F.col("text"))).alias("text0"))
    conv = W.partitionBy("conv_id").orderBy("chunk")
    before, whole = conv.rowsBetween(W.unboundedPreceding, -1), conv.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    chunks = written(
        sums.select(
            "conv_id",
            "chunk",
            "rows",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("i0"),
            F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("p0"),
            F.sum("rows").over(whole).alias("total"),
            F.first("n0").over(whole).alias("s"),
            F.first("text0").over(whole).alias("head"),
        ),
        "chat-chunks",
    )
    c = chunks.drop("head", "rows").withColumnsRenamed({"conv_id": "c_conv", "chunk": "c_chunk"})
    here = F.col("conv_id").eqNullSafe(F.col("c_conv")) & F.col("chunk").eqNullSafe(F.col("c_chunk"))

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of, here).withColumns({"i": F.col("i0") + F.col("k"), "p": F.col("p0") + F.col("q")}).drop("c_conv", "c_chunk", "chunk", "i0", "p0", "k", "q")

    # Only conversations of more than one range have anything to carry.
    numbers = placed(local.select("conv_id", "chunk", "n", "k", "q"), c.where(F.col("total") > size))
    starts = written(_starts(_cuts(numbers, size, budget, history)), "chat-starts")
    st = starts.withColumnsRenamed({"conv_id": "s_conv", "r": "s_r"})
    rows = placed(local, c).withColumn("r", F.expr(f"i div {size}"))
    rows = rows.join(st, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("r") == F.col("s_r")), "left")
    owner = F.when(F.col("i") < F.col("entry"), F.col("r") - 1).otherwise(F.col("r"))
    later = F.when(F.col("i") < F.col("entry"), F.col("past")).otherwise(F.col("next_past"))
    dealt = rows.withColumn("to", F.explode(F.array_compact(F.array(owner, F.when(F.col("i") >= later, owner + 1)))))
    dealt = dealt.select("conv_id", F.col("to").alias("r"), "i", "p", "n", "role", "text", (F.col("to") != owner).alias("context"), F.coalesce("window", F.lit(0).cast("long")).alias("window"))
    firsts = F.sequence(F.ceil(F.col("i0") / size), F.expr(f"(i0 + rows - 1) div {size}"))  # ranges that begin in a chunk
    begun = chunks.where(F.col("s").isNotNull() & (F.col("total") > size) & (F.ceil(F.col("i0") / size) * size < F.col("i0") + F.col("rows")))
    heads = begun.select("conv_id", F.explode(firsts).alias("r"), F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("p"), F.col("s").alias("n"), F.lit("system").alias("role"), F.col("head").alias("text"), F.lit(True).alias("context"), F.lit(0).cast("long").alias("window")).where(F.col("r") > 0)
    ready = dealt.unionByName(heads).repartition("conv_id", "r").sortWithinPartitions("conv_id", "r", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            open_, key = _Windows(budget, history), None
            for b in batches:
                for conv, r, i, p, n, role, text, context, window in zip(*(b.column(x).to_pylist() for x in ("conv_id", "r", "i", "p", "n", "role", "text", "context", "window")), strict=True):
                    if key != (conv, r):
                        if key and open_.fresh:
                            yield open_.close()
                        open_.start(conv)
                        key, entered = (conv, r), False
                    if i < 0:
                        open_.system = (role, text, n)
                    elif context:
                        open_.remember((role, text, n), p)
                    else:
                        if not entered:
                            open_.window, entered = window, True
                        if done := open_.push((role, text, n), p, i):
                            yield done
            if key and open_.fresh:
                yield open_.close()

        yield from _to_batches(out(), _WINDOW_ARROW)

    return ready.mapInArrow(run, SCHEMA)


def parse_window(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted window; raises ValueError if it isn't one."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2])
    if at != len(text):
        raise ValueError(f"not a formatted window at {at}")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(windows: DataFrame) -> DataFrame:
    """Each conversation's turns and loss text as read from its windows, as digests. Hashes are fed window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            began, conv = False, None
            for b in batches:
                for c, text, skip, loss in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "n_context", "loss")), strict=True):
                    if not began or c != conv:
                        if began:
                            yield done()
                        began, conv, turns, masked, n, chars, size, k = True, c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0

                        def done() -> dict:
                            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": masked.hexdigest(), "formatted_chars": size, "n_windows": k}

                    for i, (role, said) in enumerate(parse_window(text)):
                        if i >= skip:
                            turns.update(f"{role}\n{said}\n".encode())
                            n += 1
                    for span in loss:
                        said = unescape(text[span["start"] : span["end"]])
                        masked.update(said.encode())
                        chars += len(said)
                    size += len(text)
                    k += 1
            if began:
                yield done()

        yield from _to_batches(rows(), _DIGEST_ARROW)

    dealt = windows.select("conv_id", "window", "text", "n_context", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, DIGEST)
