"""Benchmark decontamination with a positional inverted index, in DataFrame operations alone.

``find(docs, items)`` marks the words of each text that lie in an occurrence of a benchmark window; ``near`` finds texts
that hold all terms of a query close together. Both read the same index: rows of (term, text, position), stored in the
shared folder.

1. Terms of the benchmark are counted over all texts. A window with a term that no text has can't occur.
2. Postings are stored for the terms that searches ask for: of each window the ``RANKS`` rarest ones.
3. Postings of a window's rarest term give places where it may start (position less offset); they are intersected with
   the postings of the next terms, each shifted by its offset, by joins on text, term and position.
4. What is left is compared with the text, word by word.

Only postings of rare terms are shuffled. A common term matters where windows have no rarer one; then its rows are
dealt by text as well, and joins that meet one term are split where they are skewed (adaptive execution). Sides are
broadcast where Spark knows their stored size to be small. A text is known by 128 bits of a hash of its id and itself, so
nothing depends on the order of rows, and rows that are equal in both share their result.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are put in lower case: digits, letters and all non-ASCII
characters. A window is ``width`` consecutive words of an item; a shorter item is one window. Null and empty texts have no
words and no hits; items without words are never found. An item may come in several rows; a null item id reads as the
empty text. Whole texts are read, whatever their length. Columns of the input pass; those of the result replace columns
of the same name. Empty tables of texts or items give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergrain.llm.components import stored
from ledgergrain.llm.repeats import fresh

WIDTH = 10
#: Terms of a window whose postings are intersected before texts are compared.
RANKS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text: Column) -> Column:
    """The words of a text as an array, empty for null."""
    text = F.coalesce(text, F.lit(""))
    # Without other characters, lower() is the same and faster.
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN), "")


def _keys(doc_id: str, text: str) -> list[Column]:
    own = [F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")]
    return [F.xxhash64(F.lit(seed), *own).alias(k) for seed, k in enumerate(KEY)]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The key and the text of each row."""
    return docs.select(*_keys(doc_id, text), F.col(f"`{text}`").alias("text"))


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms occurs in all texts; those that never do are left out."""
    said = texts.select(F.explode(words(F.col("text"))).alias("term"))
    return stored(said.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Every position of the given terms in all texts, stored."""
    said = texts.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return stored(said.join(terms, "term", "left_semi").select(*KEY, "term", "pos"), "postings")


def windows(items: DataFrame, item_id: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``wid``, ``said``) and the items that have each (``wid``, ``item``)."""
    own = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words(F.col(f"`{text}`")).alias("w")
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = own.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), width).alias("said"))
    cut = stored(cut.distinct(), "windows")
    said = stored(cut.select("said").distinct().withColumn("wid", F.monotonically_increasing_id()), "window-ids")
    return said, stored(cut.join(said, "said").select("wid", "item").distinct(), "window-items")


def ranked(said: DataFrame, counts: DataFrame, ranks: int) -> DataFrame:
    """The rarest terms of each window that can occur, rarest first: ``wid``, ``rank``, ``term``, ``offset``."""
    terms = said.select("wid", F.size("said").alias("len"), F.posexplode("said").alias("offset", "term"))
    found = terms.join(counts, "term")
    all_found = F.count(F.lit(1)).over(Window.partitionBy("wid")) == F.col("len")
    rank = F.row_number().over(Window.partitionBy("wid").orderBy("n", "term", "offset"))
    found = found.withColumn("whole", all_found).withColumn("rank", rank)
    found = found.where(F.col("whole") & (F.col("rank") <= ranks))
    return stored(found.select("wid", "rank", "term", "offset"), "ranked")


def candidates(index: DataFrame, terms: DataFrame, ranks: int) -> DataFrame:
    """Places where windows may start: the postings of their rarest terms, shifted and intersected."""

    def of_rank(rank: int) -> DataFrame:
        return terms.where(F.col("rank") == rank).select("wid", "term", "offset")

    start = F.col("pos") - F.col("offset")
    left = index.join(of_rank(1), "term").select(*KEY, "wid", start.alias("start")).where("start >= 0")
    for rank in range(2, ranks + 1):
        asked = left.join(of_rank(rank), "wid", "left").withColumn("pos", F.col("start") + F.col("offset"))
        short = asked.where(F.col("term").isNull()).select(left.columns)  # all its terms have been met
        met = asked.where(F.col("term").isNotNull()).join(index, [*KEY, "term", "pos"], "left_semi")
        left = stored(met.select(left.columns).unionByName(short), "candidates")
    return left


def phrases(texts: DataFrame, said: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Exact occurrences: ``k1``, ``k2``, ``wid``, ``start`` and ``stop`` (in words) of every window in every text."""
    asked = stored(said.select(F.explode("said").alias("term")).distinct(), "asked")
    terms = ranked(said, term_counts(texts, asked), ranks)
    rare = stored(terms.select("term").distinct(), "rare")
    maybe = candidates(postings(texts, rare), terms, ranks)
    here = stored(maybe.select(*KEY).distinct(), "suspects")
    read = texts.join(here, KEY, "left_semi").select(*KEY, words(F.col("text")).alias("w"))
    whole = read.join(maybe.join(said, "wid"), KEY)
    same = F.slice("w", F.col("start") + 1, F.size("said")) == F.col("said")
    stop = (F.col("start") + F.size("said")).alias("stop")
    return stored(whole.where(same).select(*KEY, "wid", "start", stop).distinct(), "phrases")


def find(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
) -> DataFrame:
    """All rows with ``n_words``, ``n_hit`` (words inside occurrences), ``n_items``, ``items_sha256``, ``contaminated``.

    ``items_sha256`` is the digest of the ids of the items found, sorted as strings and joined by commas.
    """
    said, owners = windows(items, item_id, item_text, width)
    hits = phrases(keyed(docs, doc_id, text), said)
    # Words covered by overlapping occurrences: each adds what lies behind all that start before it.
    before = Window.partitionBy(*KEY).orderBy("start", "stop", "wid").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))
    gain = hits.select(*KEY, F.greatest(F.col("stop") - reached, F.lit(0)).alias("gain"))
    covered = gain.groupBy(*KEY).agg(F.sum("gain").alias("n_hit"))
    named = hits.select(*KEY, "wid").distinct().join(owners, "wid").select(*KEY, "item").distinct()
    listed = named.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"),
    )
    found = stored(covered.join(listed, KEY), "found")
    own = docs.drop(*RESULT)
    names = [fresh(own, k) for k in KEY]
    found = found.select(*[F.col(k).alias(n) for k, n in zip(KEY, names)], "n_hit", "n_items", "items_sha256")
    n_words = F.size(words(F.col(f"`{text}`"))).cast("long").alias("n_words")
    both = own.select("*", *[k.alias(n) for k, n in zip(_keys(doc_id, text), names)], n_words).join(found, names, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        *[F.col(f"`{c}`") for c in own.columns],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def near(
    docs: DataFrame,
    queries: DataFrame,
    span: int,
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    query_text: str = "text",
) -> DataFrame:
    """Proximity: ``id``, ``query`` and ``start``, where all terms of a query stand within ``span`` words of a text.

    ``start`` is the position of a word of the query from which on ``span`` words hold every other one, in any order.
    Postings of the rarest term are met with those of the others in the same stretch of the same text; at most
    ``2 * span - 1`` postings of a query surround one posting. Terms of a query count once; a query without terms finds
    nothing.
    """
    asked = queries.select(
        F.col(f"`{query_id}`").alias("query"), F.array_distinct(words(F.col(f"`{query_text}`"))).alias("said")
    )
    asked = stored(asked.where(F.size("said") > 0).withColumn("wid", F.monotonically_increasing_id()), "queries")
    texts = keyed(docs, doc_id, text)
    counts = term_counts(texts, stored(asked.select(F.explode("said").alias("term")).distinct(), "asked"))
    rare = ranked(asked, counts, 1)
    terms = asked.join(rare.select("wid"), "wid", "left_semi").select(
        "wid", F.size("said").alias("len"), F.explode("said").alias("term")
    )
    index = postings(texts, stored(terms.select("term").distinct(), "rare"))
    bucket = F.floor(F.col("pos") / span)
    first = index.join(rare, "term").select(*KEY, "wid", F.col("pos").alias("at"), bucket.alias("b")).distinct()
    around = first.select("*", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bucket"))
    other = index.join(terms, "term").select(*KEY, "wid", "len", "term", "pos", bucket.alias("bucket")).distinct()
    met = around.join(other, [*KEY, "wid", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    here = met.groupBy(*KEY, "wid", "at", "len").agg(F.collect_list(F.struct("pos", "term")).alias("near"))

    def held(p: Column) -> Column:
        inside = F.filter("near", lambda x: (x["pos"] >= p["pos"]) & (x["pos"] < p["pos"] + span))
        return F.size(F.array_distinct(F.transform(inside, lambda x: x["term"]))) == F.col("len")

    starts = here.select(*KEY, "wid", F.explode(F.filter("near", held)).alias("p"))
    starts = starts.select(*KEY, "wid", F.col("p.pos").alias("start")).distinct()
    found = starts.join(asked.select("wid", "query"), "wid").drop("wid")
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), *_keys(doc_id, text))
    return own.join(found, KEY).select("id", "query", "start")
