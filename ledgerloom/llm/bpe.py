"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last 16 characters cuts texts where the content says so, so passages that documents share give the same chunks
wherever they stand. A chunk is encoded once and its ids are kept, within a bound, for the other documents of the worker. The ends of a chunk,
up to its first and from its last white space, stay open: each join is re-encoded from the last whole word before it to the first one after it, reaching over
chunks without whole words. Where those words come out as they did in their chunks, the ids agree; where not, the join is widened by both chunks and encoded
anew, until its sides agree or it is the whole text.

For a tokenizer that takes words apart as `_SPLIT` does, which its file is asked, words of plain Latin text are looked up in a bounded word table that the
tokenizers library fills; any other text (other scripts, odd controls, the strings of special tokens), and every text for other tokenizers, goes through the
library whole.

Edge cases: a null or empty text has no ids and decodes to the empty string; text without white space is one open end and is encoded whole; repeated
rows are encoded each, from the kept chunks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: One cut in so many characters, on average.
CHUNK = 1024
#: Bounds of a worker's tables: ids of kept chunks, and words.
KEPT_IDS, KEPT_WORDS = 3_000_000, 250_000
#: What a kept chunk takes besides its ids, in ids.
PIECE = 120
TASK_CHARS = 2_000_000

# The split of the word tokenizer (fixed by its file), and the characters for which Python and the library surely agree on it.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD = regex.compile(r"[^\t\n\r\x20-\x7e¡-įı-ɏ]|<\|")
_ENDS = regex.compile(r"[\x20\t\n\r]")

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(1, 2**32, 4096, dtype=np.uint32)


def cut_points(text: str, average: int = CHUNK) -> list[int]:
    """The content-defined ends of the chunks of a text, its own end included."""
    n = len(text)
    if n <= 16:
        return [n] if n else []
    h = _GEAR[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 4095]
    for step in (1, 2, 4, 8):  # h[i] gets the 16 characters up to i, by doubling
        h[step:] += h[:-step] << np.uint32(step)
    at = (np.flatnonzero(h[:-1] >> np.uint32(8) < (1 << 24) // average) + 1).tolist()
    return [*at, n]


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer's file is of the kind that `_SPLIT` and the word table know: lower-cased words apart, each with a token that ends it."""
    normal, split, model = ((spec.get(k) or {}) for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [x.get("type") for x in normal.get("normalizers", ())]
    parts = split.get("pretokenizers") or [{}]
    own = (parts[0].get("pattern") or {}).get("Regex"), parts[0].get("behavior"), parts[0].get("invert"), [x.get("type") for x in parts], parts[-1].get("use_regex"), parts[-1].get("add_prefix_space")
    known = (_SPLIT.pattern, "Removed", True, ["Split", "ByteLevel"], False, False)
    added = all(t["content"].startswith("<|") for t in spec.get("added_tokens", ()))
    return steps == ["NFC", "Replace", "Lowercase"] and own == known and added and (model.get("type"), model.get("dropout"), model.get("end_of_word_suffix")) == ("BPE", None, "</w>")


class Piece(NamedTuple):
    """The closed middle of a chunk, [start, end) of its text, and its ids. The first `head` characters hold its first word, `n_head` ids; the last `tail`, its last."""

    start: int
    end: int
    ids: np.ndarray
    head: int
    n_head: int
    tail: int
    n_tail: int


class ChunkEncoder:
    """One worker's tokenizer with its kept chunks and words. Two generations bound each table: when the young one is full it becomes the old one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_words(json.load(f))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.numbers = list(range(len(self.ends)))  # one object an id, however many words hold it
        self.words: dict[str, tuple] = {}
        self.young, self.old, self.size = {}, {}, 0
        self.encoded = self.reused = self.widened = 0

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text that begins and ends where words do."""
        if not self.by_word or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        pieces = _SPLIT.findall(text.lower())
        words = self.words
        try:
            return np.array(list(chain.from_iterable(map(words.__getitem__, pieces))), dtype=np.int32)
        except KeyError:
            missing = [p for p in dict.fromkeys(pieces) if p not in words]
            if len(words) > KEPT_WORDS:
                words.clear()
                missing = list(dict.fromkeys(pieces))
            words.update(zip(missing, self.word_ids(missing), strict=True))
            return np.array(list(chain.from_iterable(map(words.__getitem__, pieces))), dtype=np.int32)

    def word_ids(self, words: list[str]) -> list[tuple]:
        """The ids of each word, from one call: every word ends with a token that says so."""
        ids = [self.numbers[i] for i in self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids]
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) != len(words) or cuts[-1] != len(ids):  # not of this kind of vocabulary
            return [tuple(e.ids) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return [tuple(ids[a:b]) for a, b in zip([0, *cuts], cuts)]

    def piece(self, text: str) -> Piece | None:
        """The closed middle of a chunk, from its first white space to its last; None if no word stands whole between."""
        first = _ENDS.search(text)
        if not first:
            return None
        start, end = first.start(), max(map(text.rfind, " \t\n\r")) + 1
        words = text[start:end].split()
        if not words:
            return None
        one, last = words[0], words[-1]
        head, tail = text.index(one, start) - start + len(one), end - text.rindex(last, start, end)
        return Piece(start, end, self.plain(text[start:end]), head, self.count(one), tail, self.count(last))

    def count(self, word: str) -> int:
        """How many ids a word has; of a text just encoded, so its parts are known."""
        try:
            return sum(len(self.words[p]) for p in _SPLIT.findall(word.lower())) if self.by_word and not _ODD.search(word) else len(self.plain(word))
        except KeyError:
            return len(self.plain(word))

    def chunk(self, text: str) -> Piece | None:
        """The piece of a chunk, kept if the chunk was met before."""
        key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        found = self.young.get(key, self)
        if found is not self:
            self.reused += 1
            return found
        found = self.old.get(key, self)
        if found is self:
            found = self.piece(text)
            self.encoded += 1
        else:
            self.reused += 1
        self.young[key] = found
        self.size += PIECE + (len(found.ids) if found else 0)
        if self.size > KEPT_IDS:
            self.old, self.young, self.size = self.young, {}, 0
        return found

    def join(self, text: str, left: Piece | None, right: Piece | None) -> np.ndarray | None:
        """The ids between two pieces, None for the text's ends, from encoding what lies between with the word before and the word after; None if those come out otherwise
        than in the pieces."""
        start, end = left.end - left.tail if left else 0, right.start + right.head if right else len(text)
        ids, a, b = self.plain(text[start:end]), left.n_tail if left else 0, right.n_head if right else 0
        at = len(ids) - b
        if a > at or a and ids[:a].tobytes() != left.ids[-a:].tobytes() or b and ids[at:].tobytes() != right.ids[:b].tobytes():
            return None
        return ids[a:at]

    def merged(self, text: str, left: Piece | None, right: Piece | None) -> Piece:
        """Both pieces and all between them, encoded at once."""
        self.widened += 1
        start, end = left.start if left else 0, right.end if right else len(text)
        return Piece(start, end, self.plain(text[start:end]), *((left.head, left.n_head) if left else (0, 0)), *((right.tail, right.n_tail) if right else (0, 0)))

    def encode(self, text: str, average: int = CHUNK) -> np.ndarray:
        pieces, start = [], 0
        for end in cut_points(text, average):
            found = self.chunk(text[start:end])
            if found:
                pieces.append(found._replace(start=start + found.start, end=start + found.end))
            start = end
        kept: list[tuple[np.ndarray, Piece]] = []  # each with the join before it
        for right in (*pieces, None):
            left = kept[-1][1] if kept else None
            between = self.join(text, left, right)
            while between is None:  # widened until both sides agree, at the last over the whole text
                if left:
                    kept.pop()
                right = self.merged(text, left, right)
                left = kept[-1][1] if kept else None
                between = self.join(text, left, right)
            if right:
                kept.append((between, right))
        parts = [ids for between, piece in kept for ids in (between, piece.ids)]
        return np.concatenate([*parts, between] if right is None else parts)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _slices(texts: pa.Array, chars: int = TASK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length: (first row, texts)."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1])
        if size > chars:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text. `path` is the tokenizer's file, at the same place on every executor. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for first, texts in _slices(b.column(1)):
                ids = [own.encode(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), lists], ["doc_id", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>")


_TOKENS: dict[str, Callable[[list[int]], str]] = {}


def decoder(path: str) -> Callable[[list[int]], str]:
    """Ids to text. A tokenizer without a decoder stage joins its tokens by one space, so their strings are all it takes; others decode by the library."""
    if path not in _TOKENS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        if whole.decoder is None:
            vocab = whole.get_vocab(with_added_tokens=True)
            table = [""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                table[i] = token
            _TOKENS[path] = lambda ids: " ".join(map(table.__getitem__, ids))
        else:
            _TOKENS[path] = lambda ids: whole.decode(ids, skip_special_tokens=False)
    return _TOKENS[path]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `decoded`, the text of `ids` as the tokenizer gives it, special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = decoder(path)
        for b in batches:
            at = b.schema.get_field_index("ids")
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                texts = [said(np.asarray(x.values).tolist()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def digest(docs: DataFrame, path: str) -> DataFrame:
    both = decode(encode(docs, path), path)
    hashed = lambda x: F.sha2(x.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hashed(F.col("decoded")).alias("decoded_sha256"))
