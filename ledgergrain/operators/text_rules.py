"""Text rules over tables of requests and answers, as column expressions that compile with the scan.

Rules and options are configuration, so they become literals of the plan; texts are never collected,
and no step but the answer bookkeeping shuffles.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergrain import fixed_values as fixed
from ledgergrain.functions.sequence import first_per_group, grouped_sequence
from ledgergrain.session import checkpointed
from ledgergrain.specs import RuleOption, TextRule

# Characters that a request keeps, white space besides the blank, answer tokens of two or
# more characters, and the overlap that counts.
KEPT = "a-z0-9_/-"
OTHER_SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[a-z0-9_]{2,}"
MIN_OVERLAP = 0.45
MIN_RULE_WORDS = 3

# Runs that become one blank. A lone blank already is one and is left alone, which saves most replacements.
DROPPED = f"[^ {KEPT}][^{KEPT}]*| [^{KEPT}]+"
SPACE = f"[{OTHER_SPACE}][ {OTHER_SPACE}]*| [ {OTHER_SPACE}]+"


# The same as DROPPED for lower-case text in Java, where \w is ASCII; a class of several ranges takes ten times as long.
DROPPED_IN_LOWER = r"[^ \w/-][^\w/-]*| [^\w/-]+"


def normalize(text: Column) -> Column:
    """Lower case, other characters to spaces, single spaces, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), DROPPED_IN_LOWER, " "))


def _normal_terms(terms: tuple[str, ...]) -> list[str]:
    """The same normalisation for configured terms."""
    found = []
    for term in terms:
        plain = re.sub(DROPPED, " ", term.lower()).strip()
        if plain:
            found.append(plain)
    return found


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Substring containment, not whole words. A term that contains another one is redundant."""
    needed = _normal_terms(terms)
    needed = [t for t in dict.fromkeys(needed) if not any(o != t and o in t for o in needed)]
    condition = F.lit(False)
    for term in needed:
        condition = condition | F.contains(text, F.lit(term))
    return condition


def explicit_choice(text: Column, rule: TextRule) -> Column:
    """The text already names an option by alias, id or label."""
    return contains_any(text, tuple(t for o in rule.options for t in (*o.aliases, o.id, o.label)))


def rule_matches(text: Column, rule: TextRule) -> Column:
    """``text`` is normalised. Every all_any group, one any_any group, no none_any group, no explicit choice."""
    condition = F.lit(True)
    for terms in rule.all_any.values():
        condition = condition & contains_any(text, terms)
    if rule.any_any:
        any_group = F.lit(False)
        for terms in rule.any_any.values():
            any_group = any_group | contains_any(text, terms)
        condition = condition & any_group
    for terms in rule.none_any.values():
        condition = condition & ~contains_any(text, terms)
    if rule.missing_explicit_choice:
        condition = condition & ~explicit_choice(text, rule)
    return condition


def first_rule(
    requests: DataFrame,
    rules: tuple[TextRule, ...],
    text: str = "text",
    answered: DataFrame | None = None,
    key: str = "request_id",
) -> DataFrame:
    """Add ``rule_id``: the first enabled rule in order that matches and is not answered yet.

    ``answered`` has ``key`` and ``question_id``; it is reduced to one flag per rule before the join.
    """
    enabled = [r for r in rules if r.enabled]
    frame = requests.withColumn("_text", normalize(F.col(text)))
    open_rules = [F.lit(True)] * len(enabled)
    if answered is not None:
        flags = answered.groupBy(F.col(key).alias("_key")).agg(
            *[F.bool_or(F.col("question_id") == r.question_id).alias(f"_a{i}") for i, r in enumerate(enabled)]
        )
        frame = frame.join(flags, F.col(key) == F.col("_key"), "left")
        open_rules = [~F.coalesce(F.col(f"_a{i}"), F.lit(False)) for i in range(len(enabled))]
    wins = [F.when(free & rule_matches(F.col("_text"), r), F.lit(r.id)) for free, r in zip(open_rules, enabled,
                                                                                         strict=True)]
    return frame.withColumn("rule_id", F.coalesce(*wins) if wins else F.lit(None).cast("string")).select(
        *requests.columns, "rule_id"
    )


def answer_text(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def tokens(text: Column) -> Column:
    """Distinct words of two or more characters that are no stop words; ``text`` is lower case."""
    return F.array_except(F.regexp_extract_all(text, F.lit(TOKEN), 0), _words(fixed.STOPWORDS))


def option_tokens(option: RuleOption) -> list[str]:
    searchable = " ".join((option.id, option.label, option.resolved_rule, option.implementation)).lower()
    return [w for w in dict.fromkeys(re.findall(TOKEN, searchable)) if w not in fixed.STOPWORDS]


def option_score(hits: Column, tokens_held: Column, option: RuleOption) -> Column:
    """Share of an answer's tokens that the option holds; null for an answer without tokens."""
    held = F.size(F.array_intersect(hits, _words(option_tokens(option))))
    return F.try_divide(held.cast("double"), F.size(tokens_held).cast("double"))


def option_hits(answer: Column, options: tuple[RuleOption, ...]) -> Column:
    """The tokens that any option knows: few, so that the options are then compared with short lists."""
    known = dict.fromkeys(w for o in options for w in option_tokens(o))
    return F.array_intersect(answer, _words(known))


def option_scores(hits: Column, answer: Column, options: tuple[RuleOption, ...], prefix: str) -> dict[str, Column]:
    """One score per option by column name (prefix + option id). ``hits`` (from ``option_hits``) and ``answer`` should
    be columns, not expressions, so that they are found once per row."""
    return {f"{prefix}{o.id}": option_score(hits, answer, o) for o in options}


def best_option(options: tuple[RuleOption, ...], prefix: str) -> Column:
    """Id of the option with the highest score of at least 0.45, the first one on a tie."""
    scores = [F.col(f"{prefix}{o.id}") for o in options]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    chosen = F.coalesce(*[F.when(s == best, F.lit(o.id)) for s, o in zip(scores, options, strict=True)])
    return F.when(best >= MIN_OVERLAP, chosen)


def looks_like_rule(text: Column) -> Column:
    """Three or more words, and one of the handling verbs anywhere; ``text`` comes from ``answer_text``."""
    words = F.regexp_count(text, F.lit(r"[^ ]+"))
    verb = F.lit(False)
    for v in fixed.RULE_VERBS:
        verb = verb | F.contains(text, F.lit(v))
    return (words >= MIN_RULE_WORDS) & verb


def classify_answers(
    answers: DataFrame,
    rules: tuple[TextRule, ...],
    question: str = "question_id",
    selected: str = "selected_option_id",
    custom: str = "custom_answer",
) -> DataFrame:
    """Add ``answer_type`` and ``option_id`` per answer.

    predefined_option, custom_mapped_to_option, custom or invalid; an unknown question is invalid.
    """
    picked = F.when(F.length(F.col(selected)) > 0, F.col(selected))
    frame = answers.withColumn("_plain", answer_text(F.coalesce(F.col(custom), F.lit(""))))
    asked = F.coalesce(F.col(question).isin(*[r.question_id for r in rules]), F.lit(False))
    # Unknown questions and picked options have no text here, hence no tokens and no score.
    frame = frame.withColumn("_tokens", tokens(F.when(asked & picked.isNull(), F.col("_plain"))))
    mapped, known, scores, hits = F.lit(None).cast("string"), F.lit(False), {}, F.lit(None).cast("array<string>")
    for i, rule in enumerate(rules):
        here = F.col(question) == rule.question_id
        hits = F.when(here, option_hits(F.col("_tokens"), rule.options)).otherwise(hits)
        scores |= option_scores(F.when(here, F.col("_hits")), F.col("_tokens"), rule.options, f"_s{i}_")
        mapped = F.when(here, best_option(rule.options, f"_s{i}_")).otherwise(mapped)
        known = F.when(here, picked.isin(*[o.id for o in rule.options])).otherwise(known)
    frame = frame.withColumn("_hits", hits).withColumns(scores)
    kind = (
        F.when(~asked, "invalid")
        .when(picked.isNotNull(), F.when(known, "predefined_option").otherwise("invalid"))
        .when(F.length("_plain") == 0, "invalid")
        .when(F.col("_mapped").isNotNull(), "custom_mapped_to_option")
        .when(looks_like_rule(F.col("_plain")), "custom")
        .otherwise("invalid")
    )
    option = F.when(F.col("answer_type") == "predefined_option", picked).when(
        F.col("answer_type") == "custom_mapped_to_option", F.col("_mapped")
    )
    return (
        frame.withColumn("_mapped", mapped)
        .withColumn("answer_type", kind)
        .withColumn("option_id", option)
        .select(*answers.columns, "answer_type", "option_id")
    )


def latest_answers(answers: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """The newest answer of each question."""
    return first_per_group(answers, keys, [F.col(c).desc() for c in recency])


def allowed_items(items: Column, allowed: tuple[str, ...]) -> Column:
    """Items of an array that are in the allow-list, without repeats, in first-seen order."""
    return F.array_intersect(F.transform(items, lambda i: F.trim(i)), _words(allowed))


def unknown_items(items: Column, allowed: tuple[str, ...]) -> Column:
    """Items outside the allow-list, without repeats and blanks."""
    return F.array_except(F.transform(items, lambda i: F.trim(i)), _words((*allowed, "")))


def rule_key(question: Column) -> Column:
    """Key of a resolved rule: question id without its ``q_``, in lower case with single underscores.

    Capitals A-Z go first: with both cases in its class the replacement takes ten times as long.
    """
    bare = F.when(F.startswith(question, F.lit("q_")), F.substr(question, F.lit(3))).otherwise(question)
    small = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    key = F.btrim(F.regexp_replace(small, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("business_rule"))


def resolved_rules(answers: DataFrame, package: str, order: str, question: str = "question_id") -> DataFrame:
    """Add ``rule_key``, unique in its package: repeats get ``_2``, ``_3`` and so on in order.

    Every answer takes the first free name of its key: the key itself, then ``key_2``, ``key_3``, ... A name can also
    be wanted by one other key, namely by the key that reads like it (``x_2`` beside ``x``), whose first answer wants
    just that name. Who comes first gets it. So what has to be known of a pair of keys is how many answers of ``x``
    come before the first answer of ``x_2``; the rest are folds over the numbered forms of a key, in one round for
    each number that keys end in (``x``, ``x_2``, ``x_2_2``), as a key loses its first name to a shorter one only.

    Answers are numbered by ``grouped_sequence``; ``order`` must be unique in a package.
    """
    keyed = answers.withColumn("_key", rule_key(F.col(question)))
    numbered = checkpointed(grouped_sequence(keyed, [package, "_key"], [order], "_n"))
    keys = numbered.where(F.col("_n") == 1).select(
        F.col(package).alias("_pkg"), F.col("_key").alias("_k"), F.col(order).alias("_order")
    )

    # Pairs of a key and a numbered form of it that is a key too, and the answers of the key that come before.
    form = r"^(.+)_([1-9][0-9]{0,17})$"
    forms = keys.select(
        "_pkg", F.regexp_extract("_k", form, 1).alias("_base"), F.col("_k").alias("_form"),
        F.regexp_extract("_k", form, 2).try_cast("bigint").alias("_i"), F.col("_order").alias("_at"),
    ).where(F.col("_i") >= 2)
    forms = checkpointed(forms.join(keys.select("_pkg", F.col("_k").alias("_base")), ["_pkg", "_base"], "left_semi"))
    if forms.isEmpty():  # no key reads like a numbered form of another, so nobody competes for a name
        repeat = F.concat_ws("_", "_key", F.col("_n").cast("string"))
        name = F.when(F.col("_n") == 1, F.col("_key")).otherwise(repeat)
        return numbered.withColumn("rule_key", name).select(*answers.columns, "rule_key")
    based = numbered.select(F.col(package).alias("_pkg"), F.col("_key").alias("_base"), F.col(order).alias("_at"))
    based = based.join(forms.select("_pkg", "_base").distinct(), ["_pkg", "_base"], "left_semi")
    rows = based.select("*", F.lit(None).cast("string").alias("_form"), F.lit(None).cast("bigint").alias("_i"))
    line = grouped_sequence(rows.unionByName(forms), ["_pkg", "_base"], ["_at"], "_place")
    among = Window.partitionBy("_pkg", "_base").orderBy("_place")
    marks = line.where(F.col("_form").isNotNull()).withColumn("_before", F.col("_place") - F.row_number().over(among))
    children = F.array_sort(F.collect_list(F.struct("_i", "_before", "_form"))).alias("_children")
    depth = F.regexp_count(F.regexp_extract("_base", "((_[0-9]+)*)$", 1), F.lit("_")).alias("_depth")
    pairs = checkpointed(marks.groupBy("_pkg", "_base").agg(children).select("*", depth))

    # By the number of numbers a key ends in: which numbers their own keys take, and which keys lose their first name.
    lost = keys.select("_pkg", F.col("_k").alias("_base")).limit(0)
    held = None
    for level in [r[0] for r in pairs.select("_depth").distinct().orderBy("_depth").collect()]:
        now = pairs.where(F.col("_depth") == level).join(
            lost.distinct().withColumn("_lost", F.lit(1)), ["_pkg", "_base"], "left"
        )
        settled = checkpointed(now.select("_pkg", "_base", "_children", F.expr(FOLD).alias("_fold")))
        held = settled if held is None else held.unionByName(settled)
        gone = settled.select("_pkg", F.explode("_fold.gone").alias("_base"))
        lost = lost.unionByName(gone)
    if held is None:
        blocked = pairs.select("_pkg", "_base", F.array().cast("array<bigint>").alias("_blocked"))
    else:
        blocked = held.select("_pkg", "_base", F.col("_fold.blocked").alias("_blocked"))
    lost = lost.distinct().withColumn("_lost", F.lit(1))

    same = (F.col(package) == F.col("_pkg")) & (F.col("_key") == F.col("_base"))
    out = numbered.join(blocked, same, "left").drop("_pkg", "_base").join(lost, same, "left")
    first = F.col("_n") + F.coalesce("_lost", F.lit(0))
    name = F.expr("aggregate(coalesce(_blocked, array()), _first, (x, i) -> if(i <= x, x + 1, x))")
    out = out.withColumn("_first", first.cast("bigint")).withColumn("_name", name)
    repeat = F.concat_ws("_", "_key", F.col("_name").cast("string"))
    return out.withColumn("rule_key", F.when(F.col("_name") == 1, F.col("_key")).otherwise(repeat)).select(
        *answers.columns, "rule_key"
    )


#: Over the forms of a key by number: form i would go to the answer that is number ``i`` less the taken numbers before
#: (and less one if the key has lost its own name). If that answer comes before the form's first one, the
#: form's key loses its name; else the number is taken.
FOLD = """
aggregate(_children, named_struct('blocked', cast(array() as array<bigint>), 'gone', cast(array() as array<string>)),
  (s, c) -> if(c._before >= c._i - size(s.blocked) - coalesce(_lost, 0),
    named_struct('blocked', s.blocked, 'gone', array_append(s.gone, c._form)),
    named_struct('blocked', array_append(s.blocked, c._i), 'gone', s.gone)))
"""
