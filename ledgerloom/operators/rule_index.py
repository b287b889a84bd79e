"""Many rules over many rows: an inverted index from pieces of the rules' words to the texts that hold them.

A rule that looks for a word can only match a text that holds every piece of the word. Pieces are 8 bytes (or 4, 2, 1 for shorter words). Of a word's pieces the one is its key that the fewest texts hold, as a
sample of the texts says (any piece would give the same result), and the fewest rules. The distinct texts of a field are cut into theirs, a bitmap of bounded size of the keys lets through those that may be one,
and only these are exchanged, to be tested on the rules that they are the key of. So neither the cost nor what lies on disk grows with rules times rows, but with what matches.
A regular expression is looked up by a run of characters that it can't do without, if it plainly has one, and is else tested on every distinct text; pairs are sorted by expression, so that it is compiled once a task.

Rules for all users meet the texts of all rows, each text once; a user's own rules meet that user's texts only: up to `FEW` rules of a user for a field directly, more of them by the index too.
Texts that many rows share find their rows without an exchange, if the optimiser takes what matches them for small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import exchanged, written
from .rules import order_key, rule_haystack, rule_text_match, subject_of, usable_rules

#: Bytes of a run that is worth to be looked up.
GRAM = 3
#: Bytes of pieces; a word is cut by the largest that it has.
SIZES = (8, 4, 2, 1)
#: Texts of the sample that tells rare pieces from frequent ones, and bits of the bitmap at most.
SAMPLE, BITS = 50_000, 1 << 24
#: Bytes of texts that are cut at a time.
CUT_BYTES = 1 << 20
#: Rules of a user for a field that are tested on each of the user's rows; rows from which on a text is one of many rows.
FEW, HOT = 200, 1_000
CODEC = "zstd"
FIELDS = ("any", "merchant", "title", "note")
#: The scope of rules for all users, beside that of each user.
EVERYBODY = "all"


def _scope(user: Column) -> Column:
    return F.coalesce(user.cast("string"), F.lit(EVERYBODY))


def _mixed(pieces: np.ndarray, size: int, salts: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of a size, in the scope and field that a salt stands for."""
    x = pieces * np.uint64(0x9E3779B97F4A7C15) ^ salts * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(size)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a bitmap of `bits`, a power of two."""
    last = np.uint64(bits - 1)
    return hashes & last, (hashes >> np.uint64(32)) & last


def _held(marks: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _pieces(texts: list[bytes], salts: np.ndarray, sizes: tuple[int, ...], own: np.ndarray | None, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, hash of a piece), each once a text: of all sizes, or of each text's own; only those that `marks` has, if there are some."""
    data, lens = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    of, ends = np.repeat(np.arange(len(texts)), lens), np.cumsum(lens)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sizes:
        n = len(data) - size + 1
        if n <= 0:
            continue
        whole = np.arange(n) + size <= ends[of[:n]]
        if own is not None:
            whole &= own[of[:n]] == size
        at, value = of[:n][whole], np.zeros(n, np.uint64)
        for j in range(size):
            value |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        found = _mixed(value[whole], size, salts[at])
        if marks is not None:
            a, b = _places(found, len(marks) * 8)
            seen = _held(marks, a) & _held(marks, b)
            at, found = at[seen], found[seen]
        places.append(at)
        hashes.append(found)
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    order = np.lexsort((hashes, places))
    places, hashes = places[order], hashes[order]
    first = np.ones(len(places), bool)
    first[1:] = (places[1:] != places[:-1]) | (hashes[1:] != hashes[:-1])
    return places[first], hashes[first]


def _cut(df: DataFrame, text: str, keep: list[str], sizes: tuple[int, ...] = SIZES, own: bool = False, marks: np.ndarray | None = None) -> DataFrame:
    """The columns `keep` and salt of (scope, field, `text`) with `piece`, a row for each piece of each text; `own` cuts a text by the largest size that it has alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, salts = b.column(0).to_pylist(), np.asarray(b.column(1), dtype=np.int64).view(np.uint64)
            ends = np.cumsum([len(t) for t in texts]) // CUT_BYTES
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                if not len(part):
                    continue
                some = texts[part[0] : part[-1] + 1]
                mine = np.array([next((s for s in SIZES if s <= len(t)), 0) for t in some]) if own else None
                at, found = _pieces(some, salts[part], sizes, mine, marks)
                if len(at):
                    rows = pa.array(part[at])
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(1, b.num_columns)), pa.array(found.view(np.int64))], names=["salt", *keep, "piece"])

    given = df.select(F.col(text).cast("binary").alias("__text"), F.xxhash64("scope", "field").alias("salt"), *keep)
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return given.mapInArrow(run, f"salt long, {kinds}piece long")


def _marks(keys: DataFrame) -> np.ndarray:
    """The bitmap of the keys' pieces, 32 bits a key and `BITS` at most. Its words that are not zero are all that the driver gets."""
    bits = min(BITS, max(1 << 10, 1 << (32 * keys.count()).bit_length()))
    place = F.explode(F.array(F.col("piece").bitwiseAND(bits - 1), F.shiftrightunsigned("piece", 32).bitwiseAND(bits - 1)))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    marks = np.zeros(bits // 64, np.int64)
    marks[np.asarray(words["word"])] = np.asarray(words["bits"])
    return marks.view(np.uint8)


def needed_run(pattern: Column) -> Column:
    """The longest run of plain characters that every match of a regular expression holds, lower-cased; null if it has groups, classes, choices or escapes, or no run of a trigram's length.

    Runs end at wild cards, anchors and repeats; a character that may be missing (before * or ?) is no part of one. Rules ignore the case of A to Z only, so runs have no other letters than these.
    """
    runs = F.filter(F.split(pattern, r".[*?][?+]?|[.^$+]", -1), lambda x: x.rlike(r"^[\x20-\x7E]{3,}$"))
    longest = F.element_at(F.array_sort(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    return F.when(~pattern.rlike(r"[|()\[\]{}\\]") & (F.size(runs) > 0), F.lower(longest))


def _row(txn: DataFrame, *more: Column | str) -> DataFrame:
    return txn.select("user_id", "id", "direction", "amount_paise", *more)


def texts_of(txn: DataFrame, rules: DataFrame, raw: str) -> DataFrame:
    """(scope, field, hay, user_id, id, direction, amount_paise): the texts in which the rules look, of each row in the scope of all and in its user's, where that user or all have rules for the field."""
    subject = subject_of(txn, raw)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), rule_haystack(subject, F.lit(f)).alias("hay")) for f in FIELDS])
    told = _row(txn, F.explode(fields).alias("f"), F.array(F.lit(EVERYBODY), F.col("user_id").cast("string")).alias("scopes"))
    rows = told.select("user_id", "id", "direction", "amount_paise", "f.field", "f.hay", F.explode("scopes").alias("scope"))
    return rows.join(exchanged(written(rules.select("scope", "field").distinct(), "scopes")), ["scope", "field"], "left_semi")


def candidates(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(scope, field, hay) and the columns of the rules that may match: by the rarest piece of the rule's word, or for a regular expression without one every text of its scope and field."""
    name = ["scope", "field", "rule_id"]
    words = rules.withColumn("needle", F.when(F.col("match_type") == "regex", needed_run(F.col("pattern"))).otherwise(F.lower("pattern")))
    blind = written(words.filter("needle is null").drop("needle"), "blind-rules")
    cut = written(_cut(words.filter("needle is not null"), "needle", name, own=True), "rule-pieces")
    lengths = words.filter("needle is not null").select(F.octet_length("needle").alias("n"))
    sizes = tuple(s for s in SIZES if lengths.filter(F.col("n").between(s, 2 * s - 1) if s < SIZES[0] else F.col("n") >= s).limit(1).count())
    every = max(1, texts.count() // SAMPLE)
    seen = _cut(texts.filter(F.pmod(F.xxhash64("hay"), F.lit(every)) == 0), "hay", [], sizes).groupBy("salt", "piece").agg(F.count("*").alias("texts"))
    shared = cut.groupBy("salt", "piece").agg(F.count("*").alias("rules"))
    told = shared.join(seen, ["salt", "piece"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = cut.join(told, ["salt", "piece"]).groupBy(*name, "salt").agg(F.min(F.struct("texts", "rules", "piece")).alias("k")).select(*name, "salt", F.col("k.piece").alias("piece"))
    keys = exchanged(written(rarest.join(exchanged(rules), name), "rule-keys"))
    met = _cut(texts, "hay", ["hay"], sizes, marks=_marks(keys)).join(keys, ["salt", "piece"])
    out = ["scope", "field", "hay", *[c for c in rules.columns if c not in ("scope", "field")]]
    return met.select(*out).union(texts.join(blind, ["scope", "field"]).select(*out))


def matches(txn: DataFrame, rules: DataFrame, raw: str = "raw_body") -> DataFrame:
    """(user_id, id, rule_id, rule_category, place): every rule that matches a row, `place` being the rule's order as a sortable struct."""
    good = usable_rules(rules).withColumn("scope", _scope(F.col("user_id"))).withColumn("field", F.when(F.col("field").isin(*FIELDS), F.col("field")).otherwise("any"))
    good = written(good.select("scope", "field", F.col("id").alias("rule_id"), "pattern", "category", "match_type", F.col("direction").alias("way"), "min_paise", "max_paise", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_key())]).alias("place")), "rules", CODEC)
    many = written(good.groupBy("scope", "field").agg(F.count("*").alias("n")).filter((F.col("n") > FEW) | (F.col("scope") == EVERYBODY)).drop("n"), "scopes-of-many")
    many = exchanged(many)
    hit = rule_text_match(F.col("hay"), F.col("pattern"), F.col("match_type"))
    result = ("user_id", "id", "direction", "amount_paise", "rule_id", "category", "way", "min_paise", "max_paise", "place")
    found = []
    own = good.join(many, ["scope", "field"], "left_anti")
    for f in FIELDS:
        mine = written(own.filter(F.col("field") == f).drop("field"), "own-rules", CODEC)
        rows = _row(txn, rule_haystack(subject_of(txn, raw), F.lit(f)).alias("hay"), F.col("user_id").cast("string").alias("scope"))
        found.append(rows.join(exchanged(mine), "scope").filter(hit).select(*result))
    large = written(good.join(many, ["scope", "field"], "left_semi"), "rules-of-many", CODEC)
    # texts are named by two hashes where they meet their rows
    names = [F.xxhash64("scope", "field", "hay").alias("t1"), F.xxhash64("hay", "field", "scope", F.lit(1)).alias("t2")]
    rows = texts_of(txn, large, raw)
    texts = written(rows.groupBy("scope", "field", "hay").agg(F.count("*").alias("n")), "distinct-texts", CODEC)
    hot = exchanged(written(texts.filter(F.col("n") >= HOT).select(*names), "hot-texts"))
    # equal expressions come one after the other: Spark compiles a pattern anew only where it changes
    sure = candidates(texts.drop("n"), large).sortWithinPartitions("pattern").filter(hit)
    sure = written(sure.select(*names, "rule_id", "category", "way", "min_paise", "max_paise", "place"), "matches", CODEC)
    rows, by = _row(rows, *names), ["t1", "t2"]
    found.append(rows.join(exchanged(written(sure.join(hot, by, "left_semi"), "hot-matches")), by).select(*result))
    found.append(rows.join(hot, by, "left_anti").join(exchanged(written(sure.join(hot, by, "left_anti"), "cold-matches", CODEC)), by).select(*result))
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    bound = lambda limit, test: F.col(limit).isNull() | test
    fits = bound("way", F.col("way") == F.col("direction")) & bound("min_paise", F.col("amount_paise") >= F.col("min_paise")) & bound("max_paise", F.col("amount_paise") <= F.col("max_paise"))
    return every.filter(fits).select("user_id", "id", "rule_id", F.col("category").alias("rule_category"), "place")


def with_rule(txn: DataFrame, rules: DataFrame, raw: str = "raw_body") -> DataFrame:
    """The rows with rule_id and rule_category, null where no rule applies: the answers of `rules.with_rule`, for any number of rules."""
    first = matches(txn, rules, raw).groupBy("user_id", "id").agg(F.min(F.struct("place", "rule_id", "rule_category")).alias("m")).select("user_id", "id", "m.rule_id", "m.rule_category")
    return txn.join(first, ["user_id", "id"], "left")
