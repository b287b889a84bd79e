"""Categories by the user's rules, then by keywords, then by default.

Rule columns: id, user_id (null: for all users), pattern, category, field, match_type, direction, min_paise, max_paise, priority, enabled, origin, hits.
Rules reach their rows as one ordered array a user, so a row meets its rules in the projection, not in a theta join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .categories import INCOME, INCOME_ONLY

#: Rules for all users in one literal array.
SHARED_CHUNK = 200
#: Behind the rules that users write.
LEARNED_PRIORITY = 100

Keywords = dict[str, list[str]]


def is_regex(pattern: Column) -> Column:
    """Whether the JVM's own compiler takes the pattern: one that it refuses would stop the job of every user."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?i)"), pattern)).isNotNull()


def usable_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules with a pattern, valid if it is a regular expression."""
    on = F.col("enabled") & (F.coalesce("pattern", F.lit("")) != "")
    return rules.filter(on & ((F.col("match_type") != "regex") | is_regex(F.col("pattern"))))


def order_key() -> list[Column]:
    """Lowest priority number first, then hand-written before learned, then most hits, then id."""
    return [F.col("priority"), F.when(F.col("origin") == "manual", 0).otherwise(1), -F.col("hits"), F.col("id")]


def order_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(*order_key())


RULE_FIELDS = ("id", "pattern", "category", "field", "match_type", "direction", "min_paise", "max_paise")


def rule_arrays(rules: DataFrame, by: list[str]) -> DataFrame:
    """The usable rules as one ordered array per key of `by`; a user's rules are few."""
    a, b, c, d = order_key()
    entry = F.struct(a.alias("o1"), b.alias("o2"), c.alias("o3"), d.alias("o4"), *RULE_FIELDS)
    return usable_rules(rules).groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("rules"))


def rule_haystack(subject: dict[str, Column], field: Column) -> Column:
    one = lambda c: F.lower(F.coalesce(c, F.lit("")))
    every = F.lower(F.concat_ws(" ", *[blank_to_null(subject[k]) for k in ("title", "merchant", "note", "raw_text")]))
    return F.when(field == "merchant", one(subject["merchant"])).when(field == "title", one(subject["title"])).when(field == "note", one(subject["note"])).otherwise(every)


def rule_text_match(haystack: Column, pattern: Column, match_type: Column) -> Column:
    needle = F.lower(pattern)
    return (
        F.when(match_type == "regex", F.rlike(haystack, F.concat(F.lit("(?i)"), pattern)))
        .when(match_type == "starts_with", haystack.startswith(needle)).when(match_type == "ends_with", haystack.endswith(needle))
        .when(match_type == "equals", F.trim(haystack) == needle).otherwise(haystack.contains(needle))
    )


def rule_matches(rule: Column, subject: dict[str, Column]) -> Column:
    bound = lambda limit, test: limit.isNull() | test
    amount = subject["amount_paise"]
    return (
        bound(rule["direction"], rule["direction"] == subject["direction"]) & bound(rule["min_paise"], amount >= rule["min_paise"])
        & bound(rule["max_paise"], amount <= rule["max_paise"]) & rule_text_match(rule_haystack(subject, rule["field"]), rule["pattern"], rule["match_type"])
    )


def subject_of(txn: DataFrame, raw: str = "raw_body") -> dict[str, Column]:
    col = lambda c: F.col(c) if c in txn.columns else F.lit(None).cast("string")
    return {"title": col("title"), "merchant": col("merchant"), "note": col("note"), "raw_text": col(raw), "direction": F.col("direction"), "amount_paise": F.col("amount_paise")}


def _with_arrays(txn: DataFrame, rules: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The rows, and their rules as ordered arrays.

    A user's own rules reach the row by an equi-join. Rules for all users are settings, few and the same for every row: literal arrays of `SHARED_CHUNK` each.
    """
    few = sorted(usable_rules(rules.filter("user_id is null")).collect(), key=lambda r: (r["priority"], 0 if r["origin"] == "manual" else 1, -r["hits"], r["id"]))
    kinds = ("int", "int", "long", "long", "long", "string", "string", "string", "string", "string", "long", "long")
    names = ("o1", "o2", "o3", "o4", *RULE_FIELDS)
    kind = "array<struct<" + ",".join(f"{n}:{k.replace('long', 'bigint')}" for n, k in zip(names, kinds, strict=True)) + ">>"

    def typed(r) -> Column:
        values = (r["priority"], 0 if r["origin"] == "manual" else 1, -r["hits"], r["id"], *[r[f] for f in RULE_FIELDS])
        return F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(values, kinds, names, strict=True)])

    own = rule_arrays(rules.filter("user_id is not null"), ["user_id"]).select("user_id", F.col("rules").cast(kind).alias("rules"))
    return txn.join(own, "user_id", "left"), [F.col("rules"), *[F.array(*map(typed, few[i : i + SHARED_CHUNK])).cast(kind) for i in range(0, len(few), SHARED_CHUNK)]]


def with_matches(txn: DataFrame, rules: DataFrame, raw: str = "raw_body") -> DataFrame:
    """The rows with `matched`, the ids of all rules that match, in order within the user's own rules and those for all."""
    joined, arrays = _with_arrays(txn, rules)
    subject = subject_of(txn, raw)
    ids = [F.coalesce(F.transform(F.filter(a, lambda r: rule_matches(r, subject)), lambda r: r["id"]), F.array().cast("array<bigint>")) for a in arrays]
    return joined.withColumn("matched", F.concat(*ids)).drop("rules")


def with_rule(txn: DataFrame, rules: DataFrame, raw: str = "raw_body") -> DataFrame:
    """The rows with rule_id and rule_category, null where no rule applies. Users' own rules and rules for all are ordered together."""
    out, arrays = _with_arrays(txn, rules)
    subject = subject_of(txn, raw)
    hits = [F.get(F.filter(a, lambda r: rule_matches(r, subject)), F.lit(0)) for a in arrays]
    out = out.withColumn("__hits", F.array(hits[0]))
    for hit in hits[1:]:
        out = out.withColumn("__hits", F.array_append("__hits", hit))
    out = out.withColumn("hit", F.array_min("__hits"))  # the order's fields come first
    return out.withColumn("rule_id", F.col("hit.id")).withColumn("rule_category", F.col("hit.category")).drop("rules", "hit", "__hits")


def keywords_of(table: DataFrame) -> Keywords:
    """The keyword lists of a table (category, keyword, place): categories by their first place. The table is a setting, read once."""
    out: Keywords = {}
    for r in table.orderBy("place").collect():
        out.setdefault(r["category"], []).append(r["keyword"])
    return out


def keyword_category(haystack: Column, direction: Column, keywords: Keywords) -> Column:
    """The first category with a keyword in the text, of those that fit the direction; else the direction's default. The lists are the household's."""
    chosen = F.lit(None).cast("string")
    for category, names in reversed(list(keywords.items())):
        pattern = "|".join(re.sub(r"([.^$*+?{}\[\]\\|()&])", r"\\\1", n) for n in names)
        fits = direction == "credit" if category in INCOME_ONLY else F.lit(True) if category in INCOME else direction == "debit"
        chosen = F.when(fits & haystack.rlike(pattern), category).otherwise(chosen)
    return F.coalesce(chosen, F.when(direction == "credit", "Other Income").otherwise("Other"))


def suggest_category(txn: DataFrame, rules: DataFrame, keywords: Keywords, raw: str = "raw_body") -> DataFrame:
    """The rows with `suggested`: by rules, then keywords in merchant and raw text, then the default."""
    text = F.lower(F.concat(F.coalesce("merchant", F.lit("")), F.lit(" "), F.coalesce(raw, F.lit(""))))
    return with_rule(txn, rules, raw).withColumn("suggested", F.coalesce("rule_category", keyword_category(text, F.col("direction"), keywords)))


def apply_rules(txn: DataFrame, rules: DataFrame, include_confirmed: bool = False) -> DataFrame:
    """The rows that the rules would change: user_id, id, category, new_category. `with_rule` is the only pass over them."""
    looked = txn if include_confirmed else txn.filter("status = 'pending'")
    return with_rule(looked, rules).filter(F.col("rule_category") != F.col("category")).select("user_id", "id", "category", F.col("rule_category").alias("new_category"))


def apply_rules_dry_run(txn: DataFrame, rules: DataFrame, include_confirmed: bool = False) -> DataFrame:
    """One row: rows examined and rows that would change."""
    looked = txn if include_confirmed else txn.filter("status = 'pending'")
    changed = F.coalesce((F.col("rule_category") != F.col("category")).cast("long"), F.lit(0))
    return with_rule(looked, rules).agg(F.count("*").alias("examined"), F.coalesce(F.sum(changed), F.lit(0)).alias("changed"))


def rule_key(merchant: Column) -> Column:
    key = F.lower(F.trim(merchant))
    return F.when(F.length(key) >= 3, key)


def learn_rules(corrections: DataFrame, rules: DataFrame) -> DataFrame:
    """Learned rules after the corrections (user_id, merchant, category, at): the last category of each key, its hits added to those it had."""
    keyed = corrections.withColumn("pattern", rule_key(F.col("merchant"))).filter("pattern is not null")
    new = keyed.groupBy("user_id", "pattern").agg(F.max_by("category", F.struct("at", "category")).alias("new_category"), F.count("*").alias("n"))
    simple = rules.filter("origin = 'learned' and field = 'any' and match_type = 'contains'").select("user_id", "pattern", F.col("category").alias("old"), F.col("hits").alias("had"))
    both = new.join(simple, ["user_id", "pattern"], "full")
    return both.select("user_id", "pattern", F.coalesce("new_category", "old").alias("category"), (F.coalesce("had", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("hits"))


def next_rules(rules: DataFrame, corrections: DataFrame) -> DataFrame:
    """The rules table after the corrections (user_id, merchant, category, at): a user's learned rule of a key gets the last category and its hits, other keys get a rule of their own, and every other rule stays as it is.

    A new rule has an id from its user and key, the same whenever it is made; it looks for the key anywhere, at priority `LEARNED_PRIORITY`. Of several learned rules with one key the lowest id is the one that is kept up.
    """
    keyed = corrections.withColumn("pattern", rule_key(F.col("merchant"))).filter("pattern is not null and user_id is not null")
    new = keyed.groupBy("user_id", "pattern").agg(F.max_by("category", F.struct("at", "category")).alias("__category"), F.count("*").alias("__n"))
    simple = (F.col("origin") == "learned") & (F.col("field") == "any") & (F.col("match_type") == "contains") & F.col("user_id").isNotNull()
    owner = rules.filter(simple).groupBy("user_id", "pattern").agg(F.min("id").alias("id"))
    told = owner.join(new, ["user_id", "pattern"]).select(F.col("user_id").alias("__u"), F.col("id").alias("__id"), "__category", "__n")
    hit = F.col("__n").isNotNull()
    kept = rules.join(told, (F.col("user_id") == F.col("__u")) & (F.col("id") == F.col("__id")) & simple, "left").select(
        *[F.when(hit, F.col("__category")).otherwise(F.col(c)).alias(c) if c == "category" else (F.col(c) + F.coalesce("__n", F.lit(0))).alias(c) if c == "hits" else F.col(c) for c in rules.columns]
    )
    made = new.join(owner, ["user_id", "pattern"], "left_anti")
    fresh = {
        "id": F.shiftrightunsigned(F.xxhash64("user_id", "pattern"), 1), "user_id": F.col("user_id"), "pattern": F.col("pattern"), "category": F.col("__category"), "field": F.lit("any"), "match_type": F.lit("contains"),
        "priority": F.lit(LEARNED_PRIORITY), "enabled": F.lit(True), "origin": F.lit("learned"), "hits": F.col("__n"),
    }
    kinds = {f.name: f.dataType for f in rules.schema}
    return kept.unionByName(made.select(*[fresh.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in rules.columns]))


def rules_ordered(rules: DataFrame) -> DataFrame:
    return rules.orderBy("priority", F.desc("hits"), "id")
