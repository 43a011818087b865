"""Benchmark decontamination with a positional inverted index.

The index holds, for every term of the test items, its postings in the training texts: row and
position. It is written in one pass over the texts. A window of an item is then looked up from its
rarest terms: their postings, shifted by each term's place in the window, are intersected list by
list until every term of the window has been found.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import attach, stored

WIDTH = 10
# Between terms of a text in which A-Z may still be upper case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Row ids are broadcast to filter postings up to this many (8 bytes each).
BROADCAST_IDS = 1_000_000


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def row_key() -> Column:
    """Names a row of the training table; rows equal in id and text share it and their result."""
    return F.xxhash64("doc_id", "text")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows ``(window, terms, items)`` of the items; a shorter item is one window, an empty one none."""
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.transform(terms_of(F.col("text")), ascii_lower).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(width)).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item").alias("items")).withColumn("window", F.xxhash64("terms"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``(doc_id, row, term, pos)`` of the terms in ``vocabulary``, from one pass without a shuffle.

    The empty term stands once at the end of each text, so its position is the number of words.
    Texts are matched in lower case first; then A-Z alone may differ.
    """
    known = vocabulary.select("term").union(vocabulary.sparkSession.createDataFrame([("",)], "term string")).distinct()
    keys = stored(known.select(F.lower("term").alias("low"), F.col("term").alias("exact"), F.xxhash64("term").alias("id")), "terms")
    words = docs.select(
        "doc_id", row_key().alias("row"), F.posexplode(F.concat(terms_of(F.col("text")), F.array(F.lit("")))).alias("pos", "word")
    ).withColumn("low", F.lower("word"))
    found = attach(words, keys, ["low"], "inner")
    same = F.when(F.col("word") == F.col("exact"), True).otherwise(ascii_lower(F.col("word")) == F.col("exact"))
    return found.where(same).select("doc_id", "row", F.col("id").alias("term"), "pos")


def _rarest_first(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows whose terms all occur, with ``lists``: ``(n, at, term)`` from the rarest term on."""
    each = windows.select("window", F.size("terms").alias("n_terms"), F.posexplode(F.transform("terms", lambda t: F.xxhash64(t))).alias("at", "term"))
    lengths = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    lists = each.join(lengths, "term").groupBy("window", "n_terms").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("lists"))
    return lists.where(F.size("lists") == F.col("n_terms"))


def _only(postings: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Postings whose ``column`` is among ``keys``; the keys are broadcast if they are few enough."""
    keys = keys.select(F.col(column).alias("_only")).distinct()
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return postings.join(F.broadcast(keys) if few else keys, F.col(column) == F.col("_only"), "left_semi")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``(row, start, window, n_terms)``: every place where a window's terms stand in a text."""
    lists = stored(_rarest_first(index, windows), "window-lists")
    pick = lambda k: F.get("lists", F.least(F.lit(k), F.col("n_terms") - 1))
    plans = lists.select("window", "n_terms", "lists", *[pick(k)[c].alias(f"{c}{k}") for k in range(3) for c in ("term", "at")])
    rare = stored(_only(index, plans.select(F.explode(F.array("term0", "term1", "term2")).alias("term")), "term").select("row", "term", "pos").distinct(), "rare-postings")

    # The first list opens candidates, the next two are intersected at shifted positions.
    few = plans.limit(BROADCAST_IDS // 20 + 1).count() <= BROADCAST_IDS // 20
    side = plans.drop("lists")
    opened = rare.join(F.broadcast(side) if few else side, F.col("term") == F.col("term0"))
    candidates = opened.select("row", "window", "n_terms", (F.col("pos") - F.col("at0")).alias("start"), "term1", "at1", "term2", "at2").where("start >= 0")
    for k in (1, 2):
        other = rare.select(F.col("row").alias("_r"), F.col("term").alias("_t"), F.col("pos").alias("_p"))
        here = (F.col("row") == F.col("_r")) & (F.col(f"term{k}") == F.col("_t")) & (F.col("start") + F.col(f"at{k}") == F.col("_p"))
        candidates = candidates.join(other, here, "left_semi")
    candidates = stored(candidates.select("row", "window", "n_terms", "start"), "candidates")

    # The remaining lists, over the rows that still have a candidate.
    rest = candidates.where("n_terms > 3").join(lists.select("window", F.slice("lists", F.lit(4), F.size("lists")).alias("more")), "window")
    wanted = rest.select("row", "window", "n_terms", "start", F.explode("more").alias("m")).select(
        "row", "window", "n_terms", "start", (F.col("start") + F.col("m.at")).alias("pos"), F.col("m.term").alias("term")
    )
    postings = _only(index, candidates, "row").select("row", "term", "pos")
    met = wanted.join(postings, ["row", "term", "pos"], "left_semi").groupBy("row", "window", "n_terms", "start").agg(F.count(F.lit(1)).alias("n"))
    found = met.where(F.col("n") == F.col("n_terms") - 3).select("row", "window", "n_terms", "start")
    return found.unionByName(candidates.where("n_terms <= 3").select("row", "window", "n_terms", "start"))


def proximity_matches(index: DataFrame, items: DataFrame, within: int = 20) -> DataFrame:
    """``(row, item)`` where the three rarest distinct terms of an item that occur at all lie near each other.

    Near is within ``within`` words of the rarest, or within the distance that the terms have in the
    item and a quarter of it, if that is more. Items with fewer than three distinct terms match on
    those they have; of longer ones three terms have to occur. Texts that share an item's id are
    matched one by one.
    """
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(terms_of(F.col("text")), ascii_lower).alias("w"),
    ).select("item", F.xxhash64("w").alias("version"), F.least(F.size(F.array_distinct("w")), F.lit(3)).alias("n_terms"), F.posexplode("w").alias("at", "t"))
    each = words.groupBy("item", "version", "n_terms", F.xxhash64("t").alias("term")).agg(F.min("at").alias("at"))
    lengths = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = each.join(lengths, "term").groupBy("item", "version", "n_terms").agg(F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("lists"))
    rarest = known.where(F.size("lists") >= F.col("n_terms")).withColumn("lists", F.slice("lists", 1, 3))
    span = F.array_max(F.transform("lists", lambda x: F.abs(x["at"] - F.get("lists", F.lit(0))["at"])))
    picked = rarest.select("item", "version", "n_terms", F.greatest(F.lit(within), F.ceil(1.25 * span)).cast("int").alias("reach"), F.posexplode("lists").alias("k", "l"))
    places = stored(picked.select("item", "version", "n_terms", "reach", "k", F.col("l.term").alias("term")), "item-terms")
    postings = _only(index, places, "term").select("row", "term", "pos")
    few = places.limit(BROADCAST_IDS // 20 + 1).count() <= BROADCAST_IDS // 20
    lists = postings.join(F.broadcast(places) if few else places, "term")
    own = lambda k: F.collect_set(F.when(F.col("k") == k, F.col("pos"))).alias(f"p{k}")
    grouped = lists.groupBy("row", "item", "version", "n_terms", "reach").agg(own(0), own(1), own(2))
    close = lambda k: lambda p: (F.col("n_terms") <= k) | F.exists(f"p{k}", lambda q: F.abs(p - q) <= F.col("reach"))
    return grouped.where(F.exists("p0", lambda p: close(1)(p) & close(2)(p))).select("row", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, within: int = 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_items, row``.

    NULL texts and items have no words; items with fewer words than ``width`` are one window. Rows
    equal in id and text get the same result; an empty table gives an empty one.
    """
    windows = stored(item_windows(items, width), "windows")
    index = stored(build_index(docs, windows.select(F.explode("terms").alias("term"))), "postings")
    places = phrase_matches(index, windows).join(windows.select("window", "items"), "window")
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n_terms")).alias("end"))))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    # A group is one text.
    hits = places.groupBy("row").agg(spans.alias("spans"), names.alias("names"))
    origin = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n")
    )
    counted = hits.select("row", F.aggregate("spans", origin, step, lambda a: a["n"]).alias("n_hit"), F.size("names").cast("long").alias("n_items"), F.array_join("names", ",").alias("names"))
    near = proximity_matches(index, items, within).groupBy("row").agg(F.count(F.lit(1)).alias("n_near"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("near_items"))
    texts = index.where(F.col("term") == F.xxhash64(F.lit(""))).select("doc_id", "row", F.col("pos").cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return texts.join(counted, "row", "left").join(near, "row", "left").select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"), F.coalesce("near_items", F.lit("")).alias("near_items"), "row",
    )


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any hit."""
    windows = stored(item_windows(items, width), "windows")
    index = stored(build_index(docs, windows.select(F.explode("terms").alias("term"))), "postings")
    bad = stored(phrase_matches(index, windows).select("row").distinct(), "contaminated")
    few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, row_key() == bad["row"], "left_anti")
