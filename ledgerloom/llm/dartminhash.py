"""MinHash near-dedup with dart signatures, banded joining and an exact check.

Elements are the five-word shingles of a text. Each element owns a region, weight by rank; darts land in it as a Poisson process of unit rate whose places
are hashes of the element, so equal elements get equal darts everywhere. A dart has a rank, a place on the weight axis and a coordinate; it counts if
its place lies under the element's weight. The earliest dart of each coordinate is the signature, and two texts agree on a coordinate with the chance of their
weighted Jaccard similarity. Only ranks that some coordinate still needs are visited, and the weight axis is cut into stretches that double, each with its own darts
in order of rank, so a text costs its elements, times the logarithm of their weights, plus about k ln k darts.

Bands of the signature are joined; each pair that the join proposes is checked on its exact shingle sets, so links are those of similarity at or over the
threshold. With 24 bands of 4, a pair at exactly 0.8 is missed with chance 3e-6, at 0.85 with 2e-7.

Groups: a band's members are checked against its hub, the member with the most company over all bands, not against each other; copies cost one link each.
Only members of one band that are then in different components are looked at again, so that no two similar texts of one band stay apart. Each of these is
found by its rarest shingles: similar texts have one of so many in common, and texts with too many shingles that no other such text has go. By shingles that few texts
have, they are joined. Texts with only common ones to be found by are compared within their bands: bands with few cross pairs left are joined; in the others,
blocks of bounded size meet inside tasks, which give out links only.

Weights: one for each shingle, so similarity is that of the sets, or with `weighting="count"` how often a text has it.

Edge cases: a null or empty text, or one without words, is a class of its own; texts of fewer than five words are one shingle, their whole word sequence;
texts that differ in white space only are copies; repeated rows are copies; a null doc_id has a null class only if its whole class has; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over a whole array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _WordHash()


def shingles(words: list[str], n: int = WORDS) -> np.ndarray:
    """Hashes of the word windows in text order; a shorter text is one window."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * _M2
        h ^= h >> np.uint64(29)
    return mix(h)


def weighted(words: list[str], weighting: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: one each, or for "count" how often each occurs."""
    found, n = np.unique(shingles(words), return_counts=True)
    return found, np.ones(len(found), np.int64) if weighting == "set" else n


def regions(items: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash for each unit region of elements with whole weights, so that common regions over all regions is the weighted similarity."""
    cell = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    return mix(np.repeat(items, weights) + cell.astype(np.uint64) * _GOLD)


def dart_regions(items: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, hash, width, part) of the stretches [0, 1), [1, 2), [2, 4), [4, 8) ... of the weight axis that begin under each element's weight.

    `element` is the place in `items`, `part` the share of the stretch under the weight: one, but for an element's last. There are about log2(weight) a weight.
    """
    mantissa, exponent = np.frexp(weights)
    n = 1 + np.maximum(exponent - (mantissa == 0.5), 0)
    element = np.repeat(np.arange(len(items)), n)
    at = np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(at == 0, 0.0, np.ldexp(0.5, at))
    width = np.maximum(start, 1.0)
    return element, mix(items[element] + at.astype(np.uint64) * _GOLD), width, np.minimum((weights[element] - start) / width, 1.0)


def dart_signatures(items: np.ndarray, doc: np.ndarray, n_docs: int, k: int, weights: np.ndarray) -> np.ndarray:
    """n_docs x k dart ids, zero where a document has no elements. `doc` gives each element's document; weights are positive and may be fractions.

    A stretch of the weight axis has its own Poisson process of darts, as many a rank as it is wide; those of an element's last stretch count only under the
    weight, which is more than half of it. So time is in elements, the logarithm of their weights and k, not in the weights. Similarity doesn't
    depend on the scale: weights far below one had better be scaled up, as most darts of [0, 1) would lie above them.
    """
    element, start, width, part = dart_regions(items, np.asarray(weights, float))
    doc, gap = doc[element], 1 / width
    thin = bool((part < 1).any())  # powers of two leave no dart out
    total = np.bincount(doc, weights=part * width, minlength=n_docs)
    ranks, ids = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    limit = (np.log(k) + 1) * k / np.maximum(total, 1e-300)
    state, at = mix(start + _GOLD), np.zeros(len(start))
    at = at - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) * gap  # the rank of each stretch's next dart
    while len(at):
        open_ = np.flatnonzero(at <= limit[doc])
        while len(open_):
            dart, counts = mix(state[open_] ^ _M1), open_
            if thin:
                hit = (mix(dart ^ _M2) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part[open_]
                dart, counts = dart[hit], open_[hit]
            slot, rank = doc[counts] * k + (dart % np.uint64(k)).astype(np.int64), at[counts]
            np.minimum.at(ranks, slot, rank)
            first = rank == ranks[slot]
            ids[slot[first]] = dart[first]
            state[open_] = mix(state[open_] + _GOLD)
            at[open_] -= np.log1p(-(state[open_] >> np.uint64(11)).astype(np.float64) * 2.0**-53) * gap[open_]
            open_ = open_[at[open_] <= limit[doc[open_]]]
        short = np.isinf(ranks).reshape(n_docs, k).any(1) & (total > 0)
        if not short.any():
            break
        limit = np.where(short, 2 * limit, -1.0)  # documents with an empty coordinate look twice as far
        more = short[doc]
        doc, state, at, part, gap = doc[more], state[more], at[more], part[more], gap[more]
    return ids.reshape(n_docs, k)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash per document and band, the band's number included."""
    sig = signatures.reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, sig.shape[:2]).copy()
    for r in range(rows):
        h = mix(h ^ sig[:, :, r])
    return h.view(np.int64)


def _runs(texts: pa.Array, most: int = 100_000) -> Iterator[tuple[int, list[list[str]]]]:
    """Consecutive texts split into words, a bounded number of words at a time."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py().split())
        size += len(held[-1])
        if size > most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def text_key(words: list[str]) -> bytes | None:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): the hash of the text tells rows of one id apart; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def sketch(docs: DataFrame, id_col: str, text_col: str, weighting: str, bands: int, rows: int) -> DataFrame:
    """(id, th, key, bands): a 128-bit key of the word sequence and the band hashes; both null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, split in _runs(b.column(2)):
                sets = [weighted(w, weighting) for w in split]
                n = np.array([len(x) for x, _ in sets])
                items, weights = (np.concatenate(x) for x in zip(*sets, strict=True))
                keys = band_keys(dart_signatures(items, np.repeat(np.arange(len(sets)), n), len(sets), bands * rows, weights), bands, rows)
                lists = pa.array([k if m else None for k, m in zip(keys, n, strict=True)], pa.list_(pa.int64()))
                own = [b.column(c).slice(first, len(split)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(map(text_key, split), pa.binary()), lists], ["id", "th", "key", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, th long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """(key, size, items) for the wanted (id, th, key): hashes of the unit regions, one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, split in _runs(b.column(1)):
                sets = [regions(*weighted(w, weighting)).view(np.int64) for w in split]
                sizes = pa.array(map(len, sets), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(split)), sizes, pa.array(sets, pa.list_(pa.int64()))], ["key", "size", "items"])

    named = wanted.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "key")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    chosen = _texts(docs, id_col, text_col).join(named, (F.xxhash64("id", "th") == F.xxhash64("__id", "__th")) & same).select("key", "text")
    return chosen.mapInArrow(run, "key binary, size long, items array<long>").dropDuplicates(["key"])


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose sets have Jaccard similarity `threshold` or more."""
    left = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    near = (small >= threshold * large) & (common >= F.lit(threshold) * (F.size("x") + F.size("y") - common) - 1e-9)
    return both.filter(near).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in `links`: the smallest key of its component.

    Each round takes the smallest root among a key's neighbours, then the root's root; both are partial minima and joins, with the lineage cut every round.
    Roots only get smaller, so the rounds end.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")))
    moved = True
    while moved:
        far = edges.join(roots.select(F.col("key").alias("b"), F.col("root").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        least = roots.join(far, roots["key"] == far["a"]).select("key", "root", F.least("root", "m").alias("least"))
        up = roots.select(F.col("key").alias("least"), F.col("root").alias("up"))
        new = cut(least.join(up, "least").select("key", F.least("least", "up").alias("new"), (F.least("least", "up") != F.col("root")).alias("moved")))
        moved = bool(new.filter("moved").limit(1).count())
        roots = new.select("key", F.col("new").alias("root"))
    return roots


def _prefixes(rooted: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, root, size, e, item, n): the shingles by which a text of `rooted` (band, key, root, size) can be found by a similar one, `n` of these texts holding each.

    Texts of x and y shingles have threshold / (1 + threshold) * (x + y) in common if they are similar, so with shingles in any one order they have one in common
    among the first x - that + 1 of x, and of y alike. The order is by rarity. Of each text's `size` shingles only `e` are in another text; the others come first and
    find nothing, so a text with many of its own has no row.
    """
    part = threshold / (1 + threshold)
    sized = rooted.select("key", "root", "size").distinct()
    least = rooted.groupBy("band").agg(F.min("size").alias("least"))
    partner = rooted.join(least, "band").groupBy("key").agg(F.min("least").alias("least"))  # no partner in its bands is shorter
    need = F.ceil(part * (F.col("size") + F.greatest(F.col("least"), threshold * F.col("size"))) - 1e-9)
    known = sized.join(partner, "key").select("key", "root", "size", (F.col("size") - need + 1).alias("first"))
    item = sets.join(sized.select("key"), "key").select("key", F.explode("items").alias("item"))
    shared = item.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1")
    by_text = W.partitionBy("key")
    placed = item.join(shared, "item").withColumn("e", F.count("*").over(by_text)).withColumn("at", F.row_number().over(by_text.orderBy("n", "item")))
    kept = placed.join(known, "key").filter(F.col("at") <= F.col("first") - (F.col("size") - F.col("e")))
    return kept.select("key", "root", "size", "e", "item", "n")


def _block_links(rows: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b) of similar texts in different components, for bands with many: blocks of `rest` texts (outside the band's largest component) against blocks of all.

    A text is sent to each block of the other side; a group holds two blocks, and only similar pairs leave it.
    """
    full = rows.join(sets.select("key", "items"), "key").select("band", "key", "root", "items", (F.col("root") != F.col("big")).alias("rest"), "n_all", "n_rest")
    n_a, n_b = F.ceil(F.col("n_rest") / block).cast("int"), F.ceil(F.col("n_all") / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = full.filter("rest").select("band", "key", "root", "items", F.lit(True).alias("asks"), "rest", own(n_a).alias("i"), every(n_b).alias("j"))
    b = full.select("band", "key", "root", "items", F.lit(False).alias("asks"), "rest", every(n_a).alias("i"), own(n_b).alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = frame[frame["asks"]], frame[~frame["asks"]]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": []})
        sizes = np.array([len(x) for x in two["items"]])
        flat = np.concatenate(two["items"].to_list())
        names, place = np.unique(flat, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        keys, roots, rest = two["key"].to_list(), two["root"].to_list(), two["rest"].to_numpy()
        found = []
        for key, root, items in zip(one["key"], one["root"], one["items"], strict=True):
            at = np.searchsorted(names, items)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == items)]
            seen = np.zeros(len(names), np.int32)
            seen[at] = 1
            common = np.add.reduceat(seen[place], starts)
            for j in np.flatnonzero(common >= threshold * (len(items) + sizes - common) - 1e-9):
                if roots[j] != root and (not rest[j] or key < keys[j]):
                    found.append((key, keys[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return a.unionByName(b).groupBy("band", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def apart_links(members: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float, block: int = 256, few: int = 10, rare: int = 64) -> DataFrame:
    """Links between members (band, key) of one band that `roots` holds in different components."""
    rooted = members.join(roots, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    # similar texts differ in size by the threshold at most: a text stays if a text of its size's step or the next ones, in its band, has another root
    step = F.floor(F.log("size") / (-math.log(threshold) * (1 + 1e-9))).alias("step")
    rooted = rooted.join(sets.select("key", "size"), "key").select("band", "key", "root", "size", step)
    by_step = rooted.groupBy("band", "step").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    reach = by_step.select("band", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), "r1", "r2")
    split = reach.groupBy("band", "step").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2")).filter("r1 != r2").select("band", "step")
    rooted = cut(rooted.join(split, ["band", "step"], "left_semi").drop("step"))
    prefixes = cut(_prefixes(rooted, sets, threshold))
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("root", "size", "e")]
    fits = F.least("e_a", "e_b") * (1 + 1 / threshold) >= F.col("size_a") + F.col("size_b") - 1e-6
    # pairs that have a rare shingle in common meet by it, at most `rare` texts at one
    by_item = prefixes.filter(F.col("n") <= rare)
    met = by_item.select("item", F.col("key").alias("a"), *side("a")).join(by_item.select("item", F.col("key").alias("b"), *side("b")), "item")
    pairs = met.filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits).select("a", "b").distinct()
    # the others can only meet by shingles of many texts: they are compared within their bands
    able = cut(rooted.join(prefixes.filter(F.col("n") > rare).select("key", "e").distinct(), "key"))
    counts = able.groupBy("band", "root").agg(F.count("*").alias("n"))
    bands = counts.groupBy("band").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("k")
    ).filter("k > 1")
    cross = (F.col("n_all") * F.col("n_all") - F.col("squares")) / 2
    bands = cut(bands.select("band", F.col("top.root").alias("big"), "n_all", (F.col("n_all") - F.col("top.n")).alias("n_rest"), (cross > few * F.col("n_all")).alias("many")))
    rows = cut(able.join(bands, "band"))
    one = rows.filter("not many and root != big").select("band", "big", F.col("key").alias("a"), *side("a"))
    two = rows.filter("not many").select("band", F.col("key").alias("b"), *side("b"))
    in_band = one.join(two, "band").filter(fits & (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("big")) | (F.col("a") < F.col("b"))))
    found = similar(pairs.unionByName(in_band.select("a", "b")).distinct(), sets, threshold)
    return found.unionByName(_block_links(rows.filter("many"), sets, threshold, block))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighting: str = "set", block: int = 256, few: int = 10, rare: int = 64
) -> DataFrame:
    """(doc_id, class_id, copy_of, text_hash, keeps) of every row: the smallest doc_id of its class, and of its exact copies, xxhash64 of its text, and whether it is
    the row that stands for its class; rows that repeat both id and text all are."""
    sketches = written(sketch(docs, id_col, text_col, weighting, bands, rows), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("f")
    owners = cut(sketches.filter("key is not null").groupBy("key").agg(first, F.count("*").alias("copies")))
    # a row per band and distinct text; the partial counts meet in the shared bands only
    banded = sketches.filter("key is not null").select("key", "bands").distinct().select("key", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    scratch = Scratch(docs.sparkSession)
    met = scratch.written(banded.join(shared, "band").select("band", "key", "n"), "shared-bands")
    company = cut(met.groupBy("key").agg(F.sum("n").alias("company")))
    hubs = cut(met.join(company, "key").groupBy("band").agg(F.max(F.struct("company", "key")).alias("hub")).select("band", F.col("hub.key").alias("hub")))
    members = met.select("band", "key")
    wanted = owners.join(company.select("key"), "key", "left_semi").select("f.id", "f.th", "key")
    sets = scratch.written(shingle_sets(docs, wanted, id_col, text_col, weighting), "shingles")
    stars = members.join(hubs, "band").filter("key != hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut(similar(stars, sets, threshold))
    roots = components(links)
    more = cut(apart_links(members, roots, sets, threshold, block, few, rare))
    if more.limit(1).count():
        roots = components(links.union(more))
    classes = roots.join(owners, "key").groupBy("root").agg(F.min("f").alias("c"))
    grouped = roots.join(classes, "root").select("key", "c")
    # only texts that have copies or links need a look-up
    known = owners.join(grouped, "key", "left").filter("copies > 1 or c is not null")
    known = cut(known.select("key", "f", F.coalesce("c", "f").alias("c")))
    scratch.clear()
    out = sketches.select("id", "th", "key").join(known, "key", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.coalesce("c.id", "id").alias("class_id"), F.coalesce("f.id", "id").alias("copy_of"), F.col("th").alias("text_hash"),
        (F.col("c").isNull() | (F.col("id").eqNullSafe(F.col("c.id")) & (F.col("th") == F.col("c.th")))).alias("keeps"),
    )
