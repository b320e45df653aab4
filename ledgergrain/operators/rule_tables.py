"""Clarification rules as data: a table of rules and a table of their terms, matched in one plan for any number of them.

A normalised text contains a term only if it contains the term's first three characters. Normalised terms have 40
characters to begin with, so their beginnings are a bounded list, of 66,000 at most. Those that a text contains are found
in its scan; only they meet the terms, and what meets is compared. The plan doesn't grow with the rules. Texts, rules and
terms are joined by keys, and the sides are broadcast only where Spark has measured them to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergrain.operators.text_rules import _normal_terms, normalize
from ledgergrain.session import run_folder
from ledgergrain.specs import TextRule

RULES = "rule_id string, question_id string, position int, enabled boolean, all_groups int, any_groups int"
TERMS = "rule_id string, kind string, grp string, term string"
GRAM = 3


def as_tables(spark: SparkSession, rules: tuple[TextRule, ...]) -> tuple[DataFrame, DataFrame]:
    """Rules and their terms as two tables. ``kind`` is all, any, none or choice; terms are normalised."""
    heads, terms = [], []
    for position, rule in enumerate(rules):
        heads.append((rule.id, rule.question_id, position, rule.enabled, len(rule.all_any), len(rule.any_any)))
        groups = [("all", g, t) for g, t in rule.all_any.items()]
        groups += [("any", g, t) for g, t in rule.any_any.items()] + [("none", g, t) for g, t in rule.none_any.items()]
        if rule.missing_explicit_choice:
            groups.append(("choice", "", tuple(w for o in rule.options for w in (*o.aliases, o.id, o.label))))
        terms += [(rule.id, kind, group, term) for kind, group, words in groups for term in _normal_terms(words)]
    return spark.createDataFrame(heads, RULES), spark.createDataFrame(terms, TERMS)


#: So many beginnings are looked up in each text; with more, the text is cut into its grams instead.
FEW = 64
#: So many terms meet the texts themselves; with more, texts go by key, so that none is copied for every beginning.
SMALL = 20_000


def _beginnings(text: str, wanted: Column) -> Column:
    """Those of the wanted grams that a text contains."""
    # Grams of a text: at every place that of three characters, and the shorter ones that it begins with.
    cut = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1)))
    heads = F.transform(cut, lambda g: F.array(*[F.substring(g, 1, n) for n in range(1, GRAM + 1)]))
    looked_up = F.filter(wanted, lambda g: F.contains(F.col(text), g))
    return F.when(F.size(wanted) <= FEW, looked_up).otherwise(F.array_intersect(wanted, F.flatten(heads)))


def term_hits(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``term`` for every distinct term that a text contains; texts and terms are normalised, keys unique."""
    spark = texts.sparkSession
    path = run_folder(spark, "terms")
    wanted = terms.select("term").where(F.length("term") > 0).distinct()
    # Stored, so that Spark knows its size.
    wanted.withColumn("gram", F.substring("term", 1, GRAM)).write.parquet(path)
    wanted = spark.read.parquet(path)
    grams = wanted.agg(F.array_sort(F.collect_set("gram")).alias("_wanted"))
    found = F.explode(_beginnings(text, F.col("_wanted"))).alias("gram")
    if wanted.count() <= SMALL:
        maybe = texts.crossJoin(grams).select(key, text, found).join(wanted, "gram")
    else:
        maybe = texts.crossJoin(grams).select(key, found).join(wanted, "gram").select(key, "term")
        maybe = maybe.join(texts.select(key, text), key)
    return maybe.where(F.contains(F.col(text), F.col("term"))).select(key, "term")


def matches(requests: DataFrame, rules: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``rule_id``, ``question_id`` and ``position`` of every enabled rule that a request matches.

    As for single rules: a hit in every all group, in one any group if there are any, in no none group, and no
    explicit choice. ``key`` must be unique.
    """
    texts = requests.select(key, F.coalesce(normalize(F.col(text)), F.lit("")).alias("_text"))
    live = rules.where("enabled")
    hits = term_hits(texts, terms.join(live.select("rule_id"), "rule_id", "left_semi"), key, "_text")
    found = hits.join(terms, "term").groupBy(key, "rule_id").agg(
        F.size(F.collect_set(F.when(F.col("kind") == "all", F.col("grp")))).alias("_all"),
        F.bool_or(F.col("kind") == "any").alias("_any"),
        F.bool_or(F.col("kind").isin("none", "choice")).alias("_bad"),
    )
    wins = (F.col("_all") == F.col("all_groups")) & (F.col("_any") | (F.col("any_groups") == 0)) & ~F.col("_bad")
    met = found.join(live, "rule_id").where(wins).select(key, "rule_id", "question_id", "position")
    # Rules that ask for nothing match every request but those with a bad hit.
    free = live.where("all_groups = 0 AND any_groups = 0").select(F.struct("rule_id", "question_id", "position").alias("r"))
    listed = free.agg(F.collect_list("r").alias("r")).scalar()
    every = texts.select(key, F.explode(listed).alias("r")).select(key, "r.*")
    open_rules = every.join(found.where("_bad").select(key, "rule_id"), [key, "rule_id"], "left_anti")
    asks = live.where("all_groups > 0 OR any_groups > 0").select("rule_id")
    return met.join(asks, "rule_id", "left_semi").select(key, "rule_id", "question_id", "position").unionByName(open_rules)


def first_match(requests: DataFrame, rules: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every request's key with the ``rule_id`` of its first matching rule by position, or null."""
    first = matches(requests, rules, terms, key, text).groupBy(key).agg(F.min_by("rule_id", "position").alias("rule_id"))
    return requests.select(key).join(first, key, "left")
