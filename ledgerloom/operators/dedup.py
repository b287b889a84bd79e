"""One payment seen by several sources: exact keys, reference joins, time-range joins, and the greedy pass inside a batch.

Ledger columns used: id, user_id, amount_paise, direction, occurred_at_ms, merchant, title, reference, source, raw_sender, status.
Incoming columns used: id, user_id, amount_paise, direction, occurred_at_ms, merchant, reference, origin.
Every join is within a user, amount and direction; ties go to the lowest id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.matching import LEAST_MERCHANT, LEAST_REFERENCE, TIGHT_MS, WIDE_MS, bare_reference, is_same_payment, references_match
from ..functions.messages import capture_origin, merchant_identity
from ..functions.statements import statement_key
from ..sources.shared import written
from .islands import with_islands

GROUP = ["user_id", "amount_paise", "direction"]


def _reference_keys(rows: DataFrame, prefix: str) -> DataFrame:
    """Each row twice, by the first and by the last six characters; containment at either end implies one equal key, so blocking loses nothing."""
    ref = F.col(f"{prefix}_ref")
    keys = F.array(F.concat(F.lit("p"), F.left(ref, F.lit(6))), F.concat(F.lit("s"), F.right(ref, F.lit(6))))
    return rows.filter(ref.isNotNull()).withColumn("key6", F.explode(keys))


def reference_pairs(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """(incoming_id, ledger_id, user_id) whose references are the same payment's, whatever their times."""
    left = _reference_keys(incoming.select(F.col("id").alias("incoming_id"), *GROUP, bare_reference(F.col("reference")).alias("in_ref")), "in")
    right = _reference_keys(ledger.select(F.col("id").alias("ledger_id"), *GROUP, bare_reference(F.col("reference")).alias("led_ref")), "led")
    return left.join(right, [*GROUP, "key6"]).filter(references_match(F.col("in_ref"), F.col("led_ref"))).select("user_id", "incoming_id", "ledger_id").distinct()


def match_by_reference(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    return reference_pairs(incoming, ledger).groupBy("user_id", "incoming_id").agg(F.min("ledger_id").alias("ledger_id"))


def _incoming_times(incoming: DataFrame, tight_ms: Column | int) -> DataFrame:
    tight = F.lit(tight_ms) if isinstance(tight_ms, int) else tight_ms
    return incoming.select(
        F.col("id").alias("incoming_id"), *GROUP, F.col("occurred_at_ms").alias("in_ms"), merchant_identity(F.col("merchant"), 1).alias("in_merchant"), F.col("origin").alias("in_origin"),
        tight.cast("long").alias("tight"), bare_reference(F.col("reference")).alias("in_ref"),
    )


def _ledger_times(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        F.col("id").alias("ledger_id"), *GROUP, F.col("occurred_at_ms").alias("led_ms"), merchant_identity(F.coalesce("merchant", "title")).alias("led_merchant"),
        capture_origin(F.col("source"), F.col("raw_sender")).alias("led_origin"), bare_reference(F.col("reference")).alias("led_ref"),
    )


def near_pairs(incoming: DataFrame, ledger: DataFrame, tight_ms: Column | int = TIGHT_MS, wide_ms: int = WIDE_MS, veto_conflicting_reference: bool = False) -> DataFrame:
    """(user_id, incoming_id, ledger_id, apart_ms) of all pairs within the windows that pass as one payment.

    Times and merchants decide, whatever the references; `veto_conflicting_reference` keeps apart payments whose references differ.

    A range join made equal: the ledger side is sent to its own time bucket and both neighbours, a bucket being as wide as the window.
    """
    bucket = lambda c: F.floor(F.col(c) / wide_ms).cast("long")
    left = _incoming_times(incoming, tight_ms).withColumn("bucket", bucket("in_ms"))
    right = _ledger_times(ledger).withColumn("bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: bucket("led_ms") + d)))
    return _passing(left.join(right, [*GROUP, "bucket"]), wide_ms, veto_conflicting_reference)


def _passing(pairs: DataFrame, wide_ms: int, veto_conflicting_reference: bool = False) -> DataFrame:
    same = is_same_payment(F.col("led_ms"), F.col("led_merchant"), F.col("led_origin"), F.col("in_ms"), F.col("in_merchant"), F.col("in_origin"), F.col("tight"), wide_ms)
    if veto_conflicting_reference:
        same = same & (F.col("in_ref").isNull() | F.col("led_ref").isNull() | references_match(F.col("in_ref"), F.col("led_ref")))
    return pairs.filter(same).select("user_id", "incoming_id", "ledger_id", F.abs(F.col("led_ms") - F.col("in_ms")).alias("apart_ms"))


def _alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """(group, in_merchant, led_merchant, led_origin) of the merchants of one group that match: equal ones, and those of which one holds the other.

    Only distinct names meet, and of these only the ones with a chance: who is held begins with four characters that the holder has in a row.
    """
    ours = left.filter("in_merchant is not null").select(*GROUP, "in_merchant").distinct()
    theirs = right.filter("led_merchant is not null").select(*GROUP, "led_merchant", "led_origin").distinct()
    equal = ours.join(theirs.withColumn("in_merchant", F.col("led_merchant")), [*GROUP, "in_merchant"])
    head = lambda c: F.left(F.col(c), F.lit(LEAST_MERCHANT)).alias("gram")
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - LEAST_MERCHANT + 1), lambda i: F.substring(F.col(c), i, LEAST_MERCHANT)))).alias("gram")
    longer = lambda df, c: df.filter(F.length(c) > LEAST_MERCHANT).select("*", grams(c))
    long_enough = lambda df, c: df.filter(F.length(c) >= LEAST_MERCHANT).select("*", head(c))
    holds = long_enough(ours, "in_merchant").join(longer(theirs, "led_merchant"), [*GROUP, "gram"]).filter(F.col("led_merchant").contains(F.col("in_merchant")))
    held = longer(ours, "in_merchant").join(long_enough(theirs, "led_merchant"), [*GROUP, "gram"]).filter(F.col("in_merchant").contains(F.col("led_merchant")))
    names = [*GROUP, "in_merchant", "led_merchant", "led_origin"]
    return equal.select(*names).union(holds.select(*names)).union(held.select(*names)).distinct()


def nearest(left: DataFrame, right: DataFrame, wide_ms: int = WIDE_MS) -> DataFrame:
    """(user_id, incoming_id, ledger_id, apart_ms): the nearest ledger row that passes, from `_incoming_times` and `_ledger_times`, without their pairs.

    Whether a pair passes depends on its distance and on the merchants and origins alone, so of ledger rows with one merchant and origin only the nearest before and after matter. The ledger's rows
    are pools by merchant and origin, one of all rows (for a payment without merchant) and one of rows without merchant; a payment asks the few pools that its merchant fits, as an as-of join: both are sorted together, in 12-hour buckets, and
    the last ledger row is carried forward, and back. Rows out of the windows are as many as rows in, however hot a group is.
    """
    fits = _alike(left, right)
    bare = left.drop("in_ref")
    nobody = lambda kind: [F.lit(kind).alias("kind"), F.lit("").alias("merchant"), F.lit("").alias("pool_origin")]
    either = bare.select(*bare.columns, *nobody("*"), F.col("tight").alias("limit")).filter("in_merchant is null")
    blank = bare.select(*bare.columns, *nobody("0"), F.col("tight").alias("limit")).filter("in_merchant is not null")
    limit = F.greatest("tight", F.when(F.col("led_origin") != F.col("in_origin"), wide_ms).otherwise(F.col("tight")))
    shops = bare.join(fits, [*GROUP, "in_merchant"]).select(*bare.columns, F.lit("m").alias("kind"), F.col("led_merchant").alias("merchant"), F.coalesce("led_origin", F.lit("")).alias("pool_origin"), limit.alias("limit"))
    pool = [*GROUP, "kind", "merchant", "pool_origin", "bucket"]
    bucket = lambda ms: F.floor(ms / wide_ms).cast("long")
    asks = either.union(blank).union(shops).withColumn("bucket", F.explode(F.sequence(bucket(F.col("in_ms") - F.col("limit")), bucket(F.col("in_ms") + F.col("limit")))))
    asks = asks.select(*pool, F.col("in_ms").alias("ms"), F.lit(1).alias("asks"), F.col("incoming_id").alias("id"), "limit")
    none = F.col("led_merchant").isNull()
    own = F.struct(F.when(none, "0").otherwise("m").alias("kind"), F.coalesce("led_merchant", F.lit("")).alias("merchant"), F.when(none, "").otherwise(F.coalesce("led_origin", F.lit(""))).alias("pool_origin"))
    pools = right.select(*GROUP, "led_ms", "ledger_id", F.explode(F.array(F.struct(*nobody("*")), own)).alias("p"))
    held = pools.select(*GROUP, "p.*", bucket(F.col("led_ms")).alias("bucket"), F.col("led_ms").alias("ms"), F.lit(0).alias("asks"), F.col("ledger_id").alias("id"), F.lit(None).cast("long").alias("limit"))
    # of ledger rows at one time the lowest id comes last, and before those that ask
    row = F.when(F.col("asks") == 0, F.struct("ms", "id"))
    carried = lambda way: F.last(row, ignorenulls=True).over(W.partitionBy(*pool).orderBy(way, "asks", F.desc("id")).rowsBetween(W.unboundedPreceding, 0))
    met = held.unionByName(asks).select("user_id", "id", "ms", "limit", "asks", F.array(carried(F.col("ms")), carried(F.desc("ms"))).alias("near")).filter("asks = 1")
    found = met.select("user_id", F.col("id").alias("incoming_id"), "ms", "limit", F.explode("near").alias("n"))
    apart = F.abs(F.col("n.ms") - F.col("ms"))
    best = found.filter(apart <= F.col("limit")).groupBy("user_id", "incoming_id").agg(F.min(F.struct(apart.alias("apart_ms"), F.col("n.id").alias("ledger_id"))).alias("m"))
    return best.select("user_id", "incoming_id", "m.ledger_id", "m.apart_ms")


def match_near_duplicate(incoming: DataFrame, ledger: DataFrame, tight_ms: Column | int = TIGHT_MS, veto_conflicting_reference: bool = False) -> DataFrame:
    """The nearest ledger row in time that passes, for each incoming row that has one. With the veto the nearest may be refused for its reference, so all pairs are looked at."""
    if veto_conflicting_reference:
        best = F.min(F.struct("apart_ms", "ledger_id")).alias("m")
        return near_pairs(incoming, ledger, tight_ms, WIDE_MS, True).groupBy("user_id", "incoming_id").agg(best).select("user_id", "incoming_id", "m.ledger_id", "m.apart_ms")
    return nearest(written(_incoming_times(incoming, tight_ms), "incoming"), written(_ledger_times(ledger), "held"))


def find_duplicate(incoming: DataFrame, ledger: DataFrame, tight_ms: Column | int = TIGHT_MS, veto_conflicting_reference: bool = False) -> DataFrame:
    """(user_id, incoming_id, layer, ledger_id): a reference match outranks a match by time and merchant. Both sides are read once, and written as the narrow rows that both layers need."""
    left, right = written(_incoming_times(incoming, tight_ms), "incoming"), written(_ledger_times(ledger), "held")
    pairs = _reference_keys(left, "in").join(_reference_keys(right, "led"), [*GROUP, "key6"]).filter(references_match(F.col("in_ref"), F.col("led_ref")))
    return best_match(pairs, match_near_duplicate(incoming, ledger, tight_ms, True) if veto_conflicting_reference else nearest(left, right))


def best_match(by_reference: DataFrame, by_time: DataFrame) -> DataFrame:
    """(user_id, incoming_id, layer, ledger_id) of matches by reference (layer 1) and by time (layer 2)."""
    names = ["user_id", "incoming_id", "layer", "apart_ms", "ledger_id"]
    both = by_reference.withColumn("layer", F.lit(1)).withColumn("apart_ms", F.lit(0).cast("long")).select(*names).union(by_time.withColumn("layer", F.lit(2)).select(*names))
    best = F.min(F.struct("layer", "apart_ms", "ledger_id")).alias("m")
    return both.groupBy("user_id", "incoming_id").agg(best).select("user_id", "incoming_id", "m.layer", "m.ledger_id")


class Accepted:
    """The rows of one group accepted so far, found by reference ends and by time bucket. Names of rows are anything that is ordered."""

    def __init__(self) -> None:
        self.ends, self.times, self.gone = defaultdict(list), defaultdict(list), set()

    def match(self, row: tuple):
        _, ms, merchant, origin, ref, tight = row
        if ref:
            hits = [i for key in ("p" + ref[:6], "s" + ref[-6:]) for i, other in self.ends.get(key, ()) if ref.startswith(other) or ref.endswith(other) or other.startswith(ref) or other.endswith(ref)]
            hits = [i for i in hits if i not in self.gone]
            if hits:
                return min(hits)
        best = None
        for b in range(ms // WIDE_MS - 1, ms // WIDE_MS + 2):
            for i, at, name, source in self.times.get(b, ()):
                apart = abs(at - ms)
                alike = bool(name and merchant) and (name == merchant or min(len(name), len(merchant)) >= 4 and (name in merchant or merchant in name))
                ok = (not name or not merchant or alike) if apart <= tight else source != origin and apart <= WIDE_MS and alike
                if ok and (best is None or (apart, i) < best) and i not in self.gone:
                    best = apart, i
        return best[1] if best else None

    def add(self, row: tuple) -> None:
        i, ms, merchant, origin, ref, _ = row
        self.times[ms // WIDE_MS].append((i, ms, merchant, origin))
        if ref:
            for key in ("p" + ref[:6], "s" + ref[-6:]):
                self.ends[key].append((i, ref))

    def remove(self, i) -> None:
        self.gone.add(i)


def collapse_batch(incoming: DataFrame, order: list[Column], tight_ms: Column | int = TIGHT_MS) -> DataFrame:
    """(id, user_id, match_id): for each row of a batch, the row accepted before it that is the same payment, or null if it is accepted itself. `order` are columns, smallest first.

    The greedy pass needs an order only among rows that can be the same payment, so it runs island by island (`with_islands`): a user's equal amounts are many islands over time, streamed by many tasks. Only short tuples
    of an island's accepted rows are held, found by reference ends and time buckets.
    """
    tight = F.lit(tight_ms) if isinstance(tight_ms, int) else tight_ms
    rows = incoming.select(
        "id", *GROUP, F.col("occurred_at_ms").alias("ms"), merchant_identity(F.col("merchant"), 1).alias("m"), "origin", bare_reference(F.col("reference")).alias("ref"),
        tight.cast("long").alias("tight"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"),
    )
    placed = with_islands(written(rows, "batch"), GROUP, WIDE_MS, LEAST_REFERENCE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, held = None, None
        for f in frames:
            out = []
            for at, i, *group, ms, m, origin, ref, tight in zip(*(f[c].tolist() for c in ("island", "id", *GROUP, "ms", "m", "origin", "ref", "tight")), strict=True):
                if island != at:
                    island, held = at, defaultdict(Accepted)
                row, own = (i, ms, m, origin, ref, tight), held[tuple(group)]
                found = own.match(row)
                if found is None:
                    own.add(row)
                out.append(found)
            yield pd.DataFrame({"id": f["id"], "user_id": f["user_id"], "match_id": pd.array(out, dtype="Int64")})

    return placed.repartition("island").sortWithinPartitions("island", "o").mapInPandas(run, "id long, user_id long, match_id long")


def statement_supersedes(status: Column, origin: Column, reference: Column) -> Column:
    """Whether a statement row replaces its match: only one still pending, not itself from a statement, and only by a reference."""
    return (status == "pending") & (origin != "statement") & reference.isNotNull()


def merge_statement(rows: DataFrame, ledger: DataFrame, fmt: Column | str) -> DataFrame:
    """Each statement row with its `decision`, for a match with the ledger `ledger_id`, and `deletes`: whether that row goes; its file_id stays if it has one.

    The rows are taken one after the other, by id, as one import does it: a row is matched with the ledger as it is by then, so what an earlier row replaced is gone and what it added is there. `imported`, `replaced` (imported, and the match goes) or
    `duplicate` (of the ledger, of an earlier row, or by a key that either holds; a match that it supersedes goes all the same). Rows with neither reference, clock nor merchant are judged by their key alone.

    Only rows of one island meet, an island being joined by keys too, so the passes run in many tasks. Ledger rows of an island come first.
    """
    named = ["file_id"] if "file_id" in rows.columns else []
    origin = capture_origin(F.col("source"), F.col("raw_sender"))
    own_key = F.when(F.col("dedup_key").startswith("stmt|"), F.col("dedup_key")) if "dedup_key" in ledger.columns else F.lit(None).cast("string")
    # the ledger is read once, and written as the narrow rows that the pass and the keys need
    ledger = written(
        ledger.select(
            F.lit(0).alias("stage"), "id", *GROUP, F.col("occurred_at_ms").alias("ms"), merchant_identity(F.coalesce("merchant", "title")).alias("m"), origin.alias("origin"),
            bare_reference(F.col("reference")).alias("ref"), F.lit(0).cast("long").alias("tight"), F.lit(False).alias("looks"), F.coalesce(statement_supersedes(F.col("status"), origin, F.lit("")), F.lit(False)).alias("may"),
            F.lit(False).alias("key_held"), own_key.alias("own_key"), F.lit(None).cast("string").alias("dedup_key"), *[F.lit(None).cast("string").alias(c) for c in named],
        ),
        "ledger-rows",
    )
    keyed = rows.withColumn("dedup_key", statement_key(fmt, F.col("reference"), F.col("occurred_at_ms"), F.col("amount_paise"), F.col("merchant")))
    held_keys = ledger.filter("own_key is not null").select("user_id", F.col("own_key").alias("dedup_key")).distinct().withColumn("key_held", F.lit(True))
    keyed = keyed.join(held_keys, ["user_id", "dedup_key"], "left")
    shop = merchant_identity(F.col("merchant"), 1)
    come = keyed.select(
        F.lit(1).alias("stage"), "id", *GROUP, F.col("occurred_at_ms").alias("ms"), shop.alias("m"), F.lit("statement").alias("origin"), bare_reference(F.col("reference")).alias("ref"),
        F.when(F.col("has_exact_time"), TIGHT_MS).otherwise(0).cast("long").alias("tight"), (F.col("reference").isNotNull() | F.col("has_exact_time") | shop.isNotNull()).alias("looks"),
        F.col("reference").isNotNull().alias("may"), F.coalesce("key_held", F.lit(False)).alias("key_held"), "dedup_key", *[F.col(c).cast("string").alias(c) for c in named],
    )
    come = written(come, "statement-rows")
    met = written(come.unionByName(ledger.join(come.select(*GROUP).distinct(), GROUP, "left_semi").select(*come.columns)), "met")
    placed = with_islands(met, GROUP, WIDE_MS, LEAST_REFERENCE, [F.col("dedup_key")])
    schema = "user_id long, " + "".join(f"{c} string, " for c in named) + "id long, dedup_key string, ledger_id long, decision string, deletes boolean"
    fields = ("island", "stage", "id", *GROUP, "ms", "m", "origin", "ref", "tight", "looks", "may", "key_held", "dedup_key", *named)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, held, open_, keys = None, None, None, None
        for f in frames:
            out = []
            for at, stage, i, user, amount, way, ms, m, origin, ref, tight, looks, may, key_held, key, *file in zip(*(f[c].tolist() for c in fields), strict=True):
                if island != at:
                    island, held, open_, keys = at, defaultdict(Accepted), set(), set()
                row, own = ((stage, i), ms, m, origin, ref, tight), held[user, amount, way]
                if not stage:
                    own.add(row)
                    if may:
                        open_.add((user, i))
                    continue
                found = own.match(row) if looks else None
                goes = found is not None and may and found[0] == 0 and (user, found[1]) in open_
                if goes:
                    own.remove(found)
                stays = (found is None or goes) and not key_held and (user, key) not in keys
                if stays:
                    own.add(row)
                    keys.add((user, key))
                told = "duplicate" if not stays else "replaced" if goes else "imported"
                out.append((user, *file, i, key, found[1] if found is not None and found[0] == 0 else None, told, goes))
            if out:
                columns = dict(zip(("user_id", *named, "id", "dedup_key", "ledger_id", "decision", "deletes"), map(list, zip(*out, strict=True)), strict=True))
                yield pd.DataFrame(columns | {"ledger_id": pd.array(columns["ledger_id"], dtype="Int64")})

    return placed.repartition("island").sortWithinPartitions("island", "stage", "id").mapInPandas(run, schema)


def import_report(decisions: DataFrame, unparsed: DataFrame | None = None) -> DataFrame:
    """Per file (user_id, file_id): rows imported, duplicates, rows of the ledger replaced, and `unparsed`, from (user_id, file_id, skipped)."""
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    what, key = F.col("decision"), ["user_id", "file_id"]
    out = decisions.groupBy(*key).agg(count(what != "duplicate").alias("imported"), count(what == "duplicate").alias("duplicates"), count(F.col("deletes")).alias("replaced"))
    if unparsed is None:
        return out.withColumn("unparsed", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.join(unparsed.withColumnRenamed("skipped", "unparsed"), key, "full").select(*key, *map(zero, ("imported", "duplicates", "replaced", "unparsed")))
