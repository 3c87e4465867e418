"""Frequent itemsets, association rules and their rule texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimloom.operators.numbering import number_rows
from claimloom.sizing import broadcast_small, is_small, reuse

MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 0.5, 1.1


def one_hot(transactions: DataFrame) -> DataFrame:
    """Long form of the transaction x item matrix: one row per item that is present."""
    return transactions.select("claim_id", F.explode(F.array_distinct("items")).alias("item"))


def frequent_itemsets(transactions: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(items sorted, freq, n, support) of all itemsets with at least ``min_support``; null is no item.

    Level by level, over baskets of the numbers of their frequent items: a basket extends the frequent sets it holds by each later
    item of its own, where the set with that item in place of its last one is frequent as well, and the extended sets are counted.
    Sets meet the level before by equi-joins on numbers (the set without its last item, the last item), and only counts per set
    and task are shuffled.
    """
    rows = reuse(
        transactions.select(F.monotonically_increasing_id().alias("row"), F.array_compact(F.array_distinct("items")).alias("items"))
        .filter(F.size("items") > 0))
    n = rows.count()

    def frequent(held: DataFrame, *key: str) -> DataFrame:
        counts = held.groupBy(*key).agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") / n >= min_support)
        return reuse(counts.withColumn("id", F.monotonically_increasing_id()))

    def side(level: DataFrame, *columns: Column) -> DataFrame:
        return F.broadcast(level.select(*columns)) if is_small(level) else level.select(*columns)

    before, last, number = F.col("before"), F.col("last"), F.col("id")
    items = rows.select("row", F.explode("items").alias("item"))
    singles = frequent(items, "item")
    baskets = reuse(
        items.join(side(singles, F.col("item"), number), "item").groupBy("row").agg(F.sort_array(F.collect_list("id")).alias("basket")).select("basket"))
    level = singles.select("id", F.lit(-1).cast("long").alias("before"), number.alias("last"), F.array("item").alias("items"), "freq")
    held = baskets.select("basket", F.lit(-1).cast("long").alias("before"), F.posexplode("basket").alias("at", "last"))
    found = level
    while not level.isEmpty():
        more = held.join(side(level, before, last, number), ["before", "last"]).select(
            "basket", "before", "id", "at", F.posexplode(F.slice("basket", F.col("at") + 2, F.size("basket"))).alias("step", "more"))
        held = more.join(side(level, before, last.alias("more")), ["before", "more"], "left_semi").select(
            "basket", number.alias("before"), (F.col("at") + 1 + F.col("step")).alias("at"), F.col("more").alias("last"))
        level = (
            frequent(held, "before", "last")
            .join(level.select(number.alias("before"), F.col("items").alias("start")), "before")
            .join(singles.select(number.alias("last"), "item"), "last")
            .select("id", "before", "last", F.array_sort(F.concat("start", F.array("item"))).alias("items"), "freq")
        )
        found = found.unionByName(level)
    return found.select("items", "freq", F.lit(n).cast("long").alias("n")).withColumn("support", F.col("freq") / F.col("n"))


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Every split of an itemset into antecedent -> consequent, consequents of any size, with
    support, confidence and lift. Supports come from equi-joins on the sorted item arrays.

    Consequents grow item by item: moving an item over to the consequent never raises the confidence, so only consequents that
    reached ``min_confidence`` are extended, by later items that reach it alone.
    """
    known = itemsets.select("items", "freq")
    whole = itemsets.filter(F.size("items") > 1).select("items", "freq", "n", "support")

    def confident(candidates: DataFrame) -> DataFrame:
        rest = candidates.withColumn("antecedent", F.array_except("items", "consequent"))
        found = rest.join(known.select(F.col("items").alias("antecedent"), F.col("freq").alias("ante_freq")), "antecedent")
        return reuse(found.withColumn("confidence", F.col("freq") / F.col("ante_freq")).filter(F.col("confidence") >= min_confidence))

    columns = ["items", "freq", "n", "support", "antecedent", "consequent", "confidence"]
    level = confident(whole.withColumn("consequent", F.explode(F.transform("items", lambda x: F.array(x))))).select(*columns)
    found, singles = level, level.groupBy("items").agg(F.sort_array(F.collect_list(F.element_at("consequent", 1))).alias("singles"))
    while not level.isEmpty():
        last = F.element_at("consequent", -1)
        longer = level.filter(F.size("consequent") + 1 < F.size("items")).join(singles, "items").withColumn("more", F.explode(F.filter("singles", lambda x: x > last)))
        level = confident(longer.select("items", "freq", "n", "support", F.concat("consequent", F.array("more")).alias("consequent"))).select(*columns)
        found = found.unionByName(level)
    return found.join(
        known.select(F.col("items").alias("consequent"), F.col("freq").alias("cons_freq")), "consequent"
    ).select(
        "antecedent", "consequent", "support", "confidence",
        (F.col("confidence") / (F.col("cons_freq") / F.col("n"))).alias("lift"),
    )


def filter_by_lift(rules: DataFrame, min_lift: float = MIN_LIFT) -> DataFrame:
    return rules.filter(F.col("lift") >= min_lift)


def definition_from_items(antecedent: Column | str) -> Column:
    """Rule text whose conditions are the antecedent's items."""
    antecedent = F.col(antecedent) if isinstance(antecedent, str) else antecedent

    def atom(item: Column) -> Column:
        def code(prefix: str) -> Column:
            return F.replace(item, F.lit(prefix), F.lit(""))

        return (
            F.when(item.startswith("DIAG_"), F.concat(F.lit("has_diagnosis(X, '"), code("DIAG_"), F.lit("')")))
            .when(item.startswith("PROC_"), F.concat(F.lit("has_procedure(X, '"), code("PROC_"), F.lit("')")))
            .when(item.startswith("PROVIDER_"), F.concat(F.lit("provider_type(X, '"), code("PROVIDER_"), F.lit("')")))
            .when(item.startswith("POS_"), F.concat(F.lit("place_of_service(X, '"), code("POS_"), F.lit("')")))
            .when(item == "AGE_CHILD", F.lit("patient_age(X, Age) & (Age < 18)"))
            .when(item == "AGE_SENIOR", F.lit("patient_age(X, Age) & (Age >= 65)"))
            .when(item.startswith("AGE_"), F.lit("patient_age(X, Age) & (Age >= 18) & (Age < 65)"))
        )

    atoms = F.array_compact(F.transform(antecedent, atom))
    body = F.when(F.size(atoms) > 0, F.array_join(atoms, " & ")).otherwise(F.lit("True"))
    return F.concat(F.lit("rule_applies(X) <= "), body)


def rule_definitions(rules: DataFrame) -> DataFrame:
    """Filter rows for mined rules, named ``AssocRule_<n>`` along the order of their descriptions
    (which are unique), so the same rules get the same names on every run."""
    described = rules.select(
        F.concat(F.lit("If "), F.array_join("antecedent", ", "), F.lit(" then "),
                 F.array_join("consequent", ", ")).alias("description"),
        definition_from_items("antecedent").alias("rule_definition"),
        F.lit("ASSOCIATION").alias("rule_type"),
        "antecedent", "consequent", "support", "confidence", "lift",
        F.lit(True).alias("active"),
    )
    return number_rows(described, ["description"], "_n").select(
        F.concat(F.lit("AssocRule_"), F.col("_n") - 1).alias("filter_name"), *described.columns
    )


def match_mined_rules(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """(filter_name, n_antecedent, n_both): in how many claims the antecedent holds, and in how
    many the consequent holds as well. Rules need filter_name, antecedent and consequent.

    Each rule waits at the rarest item of its antecedent. A claim meets only the rules waiting at
    one of its items and decides them in the same row, so just per-rule counts are shuffled.
    """
    counts = one_hot(transactions).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    lead = (
        rules.select("filter_name", F.explode("antecedent").alias("item"))
        .join(counts, "item")
        .groupBy("filter_name").agg(F.min(F.struct("n", "item")).alias("lead"))
        .select("filter_name", F.col("lead.item").alias("item"))
    )
    waiting = rules.select("filter_name", "antecedent", "consequent").join(lead, "filter_name")
    met = (
        transactions.select("items", F.explode(F.array_distinct("items")).alias("item"))
        .join(broadcast_small(waiting), "item")
        .filter(F.size(F.array_except("antecedent", "items")) == 0)
    )
    return met.groupBy("filter_name").agg(
        F.count(F.lit(1)).alias("n_antecedent"),
        F.count_if(F.size(F.array_except("consequent", "items")) == 0).alias("n_both"),
    )
