"""Quality rules: per-document counts, and host verdicts from shrunk failure rates.

Edge cases: a null, empty or blank text has no words and fails; a null source is a host of its own; repeated rows
count once each; an empty table gives an empty result. Only the id, text and host columns are read, so other columns
never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when both its shrunk and its own failure rate reach this; the prior alone condemns no host.
HOST_LIMIT = 0.8
#: Rejected hosts up to this many are a literal set beside the texts; more are joined.
MOST_HOSTS = 1_000


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, window: int = 3) -> Column:
    """Words covered by windows that occur at least twice in the array.

    Windows are compared by a 64-bit hash within one text. Texts without an equal pair, nearly all, stop after a hash-set
    pass; in the others the positions are sorted by hash, and each repeated window adds the words not covered before it.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(p: Column) -> Column:
            equal = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
            return _let(F.array_sort(F.transform(equal, lambda x: x["i"])), gaps)

        def gaps(at: Column) -> Column:
            steps = F.transform(at, lambda a, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - a, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(placed, spread))

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(n - window + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]))

    return F.when(n < window, F.lit(0).cast("long")).otherwise(_let(_let(words, windows), covered))


def _words(bare: Column) -> Column:
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _failed(n: Column, repeated: Column) -> Column:
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def base_failed(text: Column) -> Column:
    """The base verdict alone, as a column over a text."""
    words = _words(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)))
    return _let(words, lambda w: _failed(F.size(w), _repeat_words(w)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row per document: id, host, the counts and `base_failed`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("t"), bare.alias("bare"))
    words = _words(F.col("bare"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = chosen.select(
        "id",
        "host",
        F.char_length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
    )
    return out.select(
        "id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"),
        _failed(F.col("w.n"), F.col("w.r")).alias("base_failed"),
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta by moments over the hosts' failure rates, weighted by their rows. Only one row of sums comes to the driver."""
    m = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("sq"), F.count("*").alias("k")
    ).first()
    if not m["n"]:
        return 1.0, 1.0
    mean = min(max(m["f"] / m["n"], 1e-6), 1 - 1e-6)
    var = m["sq"] / m["n"] - mean * mean
    # what binomial noise alone would give at the mean host size is taken off
    noise = mean * (1 - mean) * m["k"] / m["n"]
    var = max(var - noise, 1e-9)
    strength = min(max(mean * (1 - mean) / var - 1, 2.0), 1e6)
    return mean * strength, (1 - mean) * strength


def host_rules(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """A row per host: `shrunk`, the failure rate drawn towards the prior, and `rejected`."""
    hosts = cut(measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    alpha, beta = beta_prior(hosts)
    shrunk = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.select("host", "n", "failed", shrunk.alias("shrunk"), ((shrunk >= limit) & (F.col("failed") >= limit * F.col("n"))).alias("rejected"))


def _with_rejected(rows: DataFrame, hosts: DataFrame, host_col: str, most: int) -> DataFrame:
    """`rows` with `__rejected`. Few rejected hosts, the usual case, cost no shuffle; beyond `most` they are joined, a hot host being a skewed join."""
    bad = hosts.filter("rejected").select(F.col("host").alias("__bad"))
    few = [r["__bad"] for r in bad.limit(most + 1).collect()]
    if len(few) > most:
        joined = rows.join(bad.withColumn("__hit", F.lit(True)), F.col(host_col).eqNullSafe(F.col("__bad")), "left")
        return joined.withColumn("__rejected", F.coalesce("__hit", F.lit(False))).drop("__bad", "__hit")
    named = F.coalesce(F.col(host_col).isin([h for h in few if h is not None]), F.lit(False)) if any(h is not None for h in few) else F.lit(False)
    return rows.withColumn("__rejected", named | F.col(host_col).isNull() if None in few else named)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT, most: int = MOST_HOSTS) -> DataFrame:
    """The measures with `kept`: false if the base rules or the host's verdict reject the document.

    The texts are read once: the narrow measures are written to the shared folder, aggregated by host with partial sums, and judged.
    """
    measured = cut(measures(docs, id_col, text_col, host_col))
    judged = _with_rejected(measured, host_rules(measured, limit), "host", most)
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("__rejected")).alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT, most: int = MOST_HOSTS) -> DataFrame:
    """The rows of `docs` that neither the base rules nor their host's verdict reject, with their own columns.

    The rules are computed twice, once for the host sums and once beside the texts, rather than shuffling every text to its verdict.
    """
    failed = base_failed(F.col(text_col))
    hosts = host_rules(docs.select(F.col(host_col).alias("host"), failed.alias("base_failed")), limit)
    return _with_rejected(docs.filter(~failed), hosts, host_col, most).filter("not __rejected").drop("__rejected")
