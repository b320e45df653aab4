from __future__ import annotations

import random
import re

from conftest import as_set, plan_of
from pyspark.sql import functions as F

from ledgergrain import fixed_values as fixed
from ledgergrain.operators import rule_tables, text_rules
from ledgergrain.operators import text_rules as tr
from ledgergrain.specs import RuleOption, TextRule


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def column(df, expression):
    return [r.v for r in df.select("id", expression.alias("v")).orderBy("id").collect()]


def test_normalize(spark):
    df = texts(spark, "  Create a DATA-set, now!!\n(v2/x_y) ", "Ünïcode and\ttabs", "", "***")
    assert column(df, tr.normalize(F.col("text"))) == ["create a data-set now v2/x_y", "n code and tabs", "", ""]


def test_rule_groups_and_substrings(spark):
    rule = TextRule(
        "r", "q", all_any={"a": ("make", "build"), "b": ("mart",)}, any_any={"c": ("x1",), "d": ("y1",)},
        none_any={"e": ("skip",)}, missing_explicit_choice=True, options=(RuleOption("opt_a", "Option A!", ("alias",)),),
    )
    df = texts(spark, "build smart y1", "build x1", "make mart x1 skip", "make mart", "make mart x1 option a",
               "make mart x1 opt_a", "make mart x1 alias", "remake marts x1")
    assert column(df, tr.rule_matches(tr.normalize(F.col("text")), rule)) == [
        True, False, False, False, False, False, False, True
    ]


ROUTED = [
    ("Create a revenue pipeline from Stripe", "revenue_definition_for_pipeline"),
    ("Create a billed revenue pipeline from Stripe", None),  # names an option
    ("Show me revenue from Stripe", None),  # no artifact
    ("Build a dataset, not sure how refunds count", "refund_discount_handling_for_revenue_product"),
    ("Build a Stripe revenue mart; unclear discount", "revenue_definition_for_pipeline"),  # both match, first wins
]


def test_first_rule_and_answered(spark):
    df = texts(spark, *[t for t, _ in ROUTED])
    found = tr.first_rule(df, fixed.CLARIFICATION_RULES, key="id").orderBy("id").collect()
    assert [r.rule_id for r in found] == [rule for _, rule in ROUTED]
    answered = spark.createDataFrame(
        [(4, "q_revenue_definition"), (4, "q_revenue_definition"), (3, "q_other")], "id int, question_id string"
    )
    found = tr.first_rule(df, fixed.CLARIFICATION_RULES, answered=answered, key="id").orderBy("id").collect()
    assert [r.rule_id for r in found][3:] == ["refund_discount_handling_for_revenue_product"] * 2


def words_of(text):
    found = dict.fromkeys(re.findall(r"[a-z0-9_]+", text.lower()))
    return [w for w in found if len(w) > 1 and w not in fixed.STOPWORDS]


def brute_best(text, options):
    answer, best, score = words_of(text), None, 0
    for o in options:
        option = words_of(" ".join((o.id, o.label, o.resolved_rule, o.implementation)))
        share = len(set(answer) & set(option)) / len(answer) if answer and option else 0
        if share > score:
            best, score = o.id, share
    return best if score >= 0.45 else None


def test_best_option_equals_brute_force(spark):
    pool = "gross net mrr report the a refunds discounts adjustment only both separately keep x zz show_both 7".split()
    rng = random.Random(7)
    samples = [" ".join(rng.choices(pool, k=rng.randint(0, 7))) for _ in range(300)]
    options = fixed.ADJUSTMENT_RULE.options
    df = texts(spark, *samples).withColumn("t", tr.tokens(F.lower("text")))
    df = df.withColumn("h", tr.option_hits(F.col("t"), options))
    df = df.withColumns(tr.option_scores(F.col("h"), F.col("t"), options, "s_"))
    assert column(df, tr.best_option(options, "s_")) == [brute_best(s, options) for s in samples]


def test_custom_rule_needs_words_and_a_verb(spark):
    df = texts(spark, "treat as zero", "treat zero", "please reuse it", "no idea at all", "   use   ")
    assert column(df, tr.looks_like_rule(tr.answer_text(F.col("text")))) == [True, False, True, False, False]


def test_answer_classes(spark):
    rows = [
        ("q_refund_discount_handling", "net_only", None, "predefined_option", "net_only"),
        ("q_refund_discount_handling", "billed_revenue", "net mrr", "invalid", None),
        ("q_refund_discount_handling", None, "Net  MRR", "custom_mapped_to_option", "net_only"),
        ("q_refund_discount_handling", "", "ignore every odd row", "custom", None),
        ("q_refund_discount_handling", None, "hm", "invalid", None),
        ("q_refund_discount_handling", None, None, "invalid", None),
        ("q_revenue_definition", None, "billed revenue amounts", "custom_mapped_to_option", "billed_revenue"),
        ("q_unknown", "net_only", None, "invalid", None),
        (None, "net_only", None, "invalid", None),
    ]
    df = spark.createDataFrame(
        [(i, *r[:3]) for i, r in enumerate(rows)],
        "id int, question_id string, selected_option_id string, custom_answer string",
    )
    found = tr.classify_answers(df, fixed.CLARIFICATION_RULES).orderBy("id").collect()
    assert [(r.answer_type, r.option_id) for r in found] == [r[3:] for r in rows]


def test_latest_answer(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "q string, n int, v string")
    assert as_set(tr.latest_answers(df, ["q"], ["n"]), "q", "v") == {("a", "y"), ("b", "z")}


def test_allowed_items(spark):
    df = spark.createDataFrame([(1, [" b", "x", "a", "b", "", "x"])], "id int, items array<string>")
    assert df.select(tr.allowed_items(F.col("items"), ("a", "b"))).first()[0] == ["b", "a"]
    assert df.select(tr.unknown_items(F.col("items"), ("a", "b"))).first()[0] == ["x"]


def brute_keys(questions):
    used, names = set(), []
    for q in questions:
        base = re.sub(r"[^a-zA-Z0-9]+", "_", q.removeprefix("q_")).strip("_").lower() or "business_rule"
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name)
        names.append(name)
    return names


def test_resolved_rule_keys_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["q_Foo", "foo", "q_foo_2", "foo--2", "foo_2_2", "q_bar baz", "bar_baz", "q_!!", "x_9"]
    packages = {p: [rng.choice(pool) for _ in range(rng.randint(1, 9))] for p in range(40)}
    packages[40] = [rng.choice(["x", "x_2", "x_3", "x_2_2", "x_02", "x_10"]) for _ in range(400)]  # one large family
    rows = [(p, i, q) for p, qs in packages.items() for i, q in enumerate(qs)]
    df = spark.createDataFrame(rows, "package int, n int, question_id string")
    found = tr.resolved_rules(df, "package", "n").orderBy("package", "n").collect()
    expected = [k for qs in packages.values() for k in brute_keys(qs)]
    assert [r.rule_key for r in found] == expected
    plain = df.where("question_id in ('q_Foo', 'x_9')")
    assert tr.resolved_rules(plain, "package", "n").count() == plain.count()


def test_rules_as_tables_match_like_single_rules(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "al", "x", "beta gamma", "é!", "z" * 40, "a b"]
    pick = lambda: tuple(rng.choice(words) for _ in range(rng.randint(1, 3)))
    rules = []
    for i in range(60):
        rules.append(TextRule(
            f"r{i}", f"q{i}", all_any={f"g{j}": pick() for j in range(rng.randint(0, 2))},
            any_any={f"g{j}": pick() for j in range(rng.randint(0, 2))},
            none_any={"n": pick()} if rng.random() < 0.4 else {}, missing_explicit_choice=rng.random() < 0.3,
            options=(RuleOption("opt_a", "Gamma ray", ("alphabet",)),), enabled=rng.random() < 0.9,
        ))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(50)] + [None, "", "Alphabet!"]
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id int, text string")
    tables = rule_tables.as_tables(spark, tuple(rules))
    found = {(r.request_id, r.rule_id) for r in rule_tables.matches(requests, *tables, "request_id").collect()}
    plain = requests.withColumn("t", F.coalesce(text_rules.normalize(F.col("text")), F.lit("")))
    single = plain.select("request_id", *[text_rules.rule_matches(F.col("t"), r).alias(r.id) for r in rules if r.enabled])
    want = {(r.request_id, n) for r in single.collect() for n, hit in r.asDict().items() if n != "request_id" and hit}
    assert found == want and len(want) > 100
    first = {r.request_id: r.rule_id for r in rule_tables.first_match(requests, *tables, "request_id").collect()}
    order = {r.id: i for i, r in enumerate(rules)}
    assert first == {i: min((n for j, n in want if j == i), key=order.get, default=None) for i in range(len(texts))}


def test_ten_thousand_terms_have_the_plan_of_ten(spark):
    requests = spark.createDataFrame([(i, f"needs term{i} and more") for i in range(200)], "id int, text string")

    def many(n):
        rules = tuple(TextRule(f"r{i}", f"q{i}", any_any={"a": (f"term{i} ",)}) for i in range(n))
        heads, terms = rule_tables.as_tables(spark, rules)
        return rule_tables.matches(requests, heads.repartition(2), terms.repartition(2), "id")

    def nodes(df):
        return [line.strip(" +-:*").split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n")]

    found = many(10_000)
    assert nodes(found) == nodes(many(10))
    assert {(r.id, r.rule_id) for r in found.collect()} >= {(i, f"r{i}") for i in range(200)}


def test_rule_names_are_found_in_one_pass_over_the_answers(spark):
    """No sampling pass for a range sort: the question of each answer is read once."""
    seen = spark.sparkContext.accumulator(0)

    def read(value):
        seen.add(1)
        return value

    answers = spark.range(300, numPartitions=4).selectExpr("id % 60 as run", "id as at", "concat('q_Of ', id % 2) as q")
    got = text_rules.resolved_rules(answers.withColumn("q", F.udf(read, "string")("q")), "run", "at", "q").collect()
    assert seen.value == 300
    assert sorted(r.rule_key for r in got if r.run == 7) == ["of_1", "of_1_2", "of_1_3", "of_1_4", "of_1_5"]
    keys = spark.createDataFrame([("q_q_a",), ("Q_a",), ("q_",), ("aq_b",), (None,), ("q_K\u212aİz",)], "q string").select(
        text_rules.rule_key(F.col("q")).alias("k")
    )
    assert [r.k for r in keys.collect()] == ["q_a", "q_a", "business_rule", "aq_b", "business_rule", "k_z"]


def test_normalisation_of_odd_characters_in_one_class(spark):
    rng = random.Random(8)
    odd = "aZ9_/- \t\nÄßéİK\u212aıſ\u0660\u2028٣漢😀.[]\\^"
    values = ["".join(rng.choice(odd) for _ in range(rng.randrange(30))) for _ in range(300)]
    df = texts(spark, *values)
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^ a-z0-9_/-]+|(?<= ) +", " "))
    assert column(df, tr.normalize(F.col("text"))) == column(df, F.trim(F.regexp_replace(plain, " +", " ")))


def test_few_and_many_terms_find_the_same(spark, monkeypatch):
    """Looked up or cut, joined with the texts or by key; no text is shuffled where terms are few."""
    rng = random.Random(9)
    words = ["a", "of", "the", "then", "tion", "x/y", "_", "no one"]
    requests = texts(spark, *[" ".join(rng.choice(words)[: rng.randrange(1, 7)] for _ in range(rng.randrange(9))) for _ in range(90)])
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    want = {(r.id, w) for r in requests.collect() for w in words if w in r.text}
    for few, small in ((64, 20_000), (0, 20_000), (0, 0), (64, 0)):
        monkeypatch.setattr(rule_tables, "FEW", few)
        monkeypatch.setattr(rule_tables, "SMALL", small)
        hits = rule_tables.term_hits(requests, terms, "id", "text")
        assert as_set(hits) == want and hits.count() == len(want)
        assert ("Exchange hashpartitioning" in plan_of(hits)) <= (small == 0)
