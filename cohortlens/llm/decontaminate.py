"""Benchmark decontamination: an exact, prefix-filtered containment join on item-sized windows.

An item's windows are its runs of ``size`` words (one shorter window for a shorter item). A text contains a
window only if it contains all of its word shingles, so one necessary shingle per window is enough as
prefix: the rarest in the corpus. Texts are joined on those only; the shingle's place in window and text gives
the one possible start, length and position bounds drop what would stick out, and the rest is
compared word by word. Only DataFrame functions are used.

Per text, possible places are kept as one list of starts for each window: what a row holds grows with its text and the
windows found in it, not with their product, and hit words are counted by merging sorted spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import row_key, small, stored

AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 3  # words of a shingle
BROADCAST_KEYS = 2_000_000  # 8-byte keys
BROADCAST_WINDOWS = 200_000  # rows of about 120 bytes


def words_of(column) -> F.Column:
    """Lower-cased (A-Z) words; digits and all characters beyond ASCII belong to words."""
    return F.array_remove(F.split(F.translate(F.coalesce(column, F.lit("")), *AZ), BETWEEN), "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, words) for every window of every item."""
    found = items.select("item_id", words_of(F.col("text")).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    found = found.filter(F.size("all") > 0).select("item_id", "all", F.explode(starts).alias("at"))
    return found.select("item_id", F.slice("all", F.col("at"), F.lit(size)).alias("words"))


def shingles(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """(keep..., at, h) for the word shingles of column ``words``; ``at`` counts from 0.

    The shifted copies of the array are zipped, so that every word is handled by generated code.
    """
    widest = max(lengths)
    columns = [F.col("words")] + [F.slice("words", i + 1, F.size("words")) for i in range(1, widest)]
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(columns)])
    out = rows.select(*keep, F.posexplode(zipped).alias("at", "z"))
    parts = [F.col("z")[f"w{i}"] for i in range(widest)]
    found = None
    for n in lengths:
        one = out.filter(parts[n - 1].isNotNull()).select(*keep, "at", F.xxhash64(*parts[:n]).alias("h"))
        found = one if found is None else found.unionByName(one)
    return found


def _held(words: str, places: str) -> F.Column:
    """The (window, length, starts) of ``places`` that are right word by word; windows without one are left out."""
    def right(place):
        same = lambda s: F.array_join(F.slice(words, s + 1, place["length"]), " ") == place["window"]
        return F.struct(place["window"].alias("window"), place["length"].alias("length"), F.filter(place["starts"], same).alias("starts"))

    return F.filter(F.transform(places, right), lambda place: F.size(place["starts"]) > 0)


def _covered(held: str) -> F.Column:
    """How many words the spans of ``held`` cover together: they are sorted and merged, not listed word by word."""
    spans = F.flatten(F.transform(held, lambda p: F.transform(p["starts"], lambda s: F.struct(s.alias("start"), (s + p["length"]).alias("end")))))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))

    def add(so_far, span):
        new = F.greatest(span["end"] - F.greatest(so_far["end"], span["start"]), F.lit(0))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(so_far["end"], span["end"]).alias("end"))

    return F.aggregate(F.array_sort(spans), none, add)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window of ``items`` (item_id, text); n_items the items
    with such windows, whose ids, sorted as strings and joined by commas, are hashed. A text is contaminated
    if n_hit > 0 and ``share`` * n_hit >= n_words. NULL and empty texts have no words; items
    without words have no windows; an item with a NULL item_id hits words but is not counted. Rows are told apart
    by content, so equal rows get equal results, each of its own, and a NULL doc_id is kept.
    Extra columns are ignored; empty tables give no hits, or no rows.
    """
    docs = docs.select("doc_id", "text").withColumn("k", F.unhex(row_key("doc_id", "text")))
    words = docs.select("k", words_of(F.col("text")).alias("words"))

    pieces = item_windows(items, size).withColumn("window", F.concat_ws(" ", "words"))
    owners = stored(pieces.select("item_id", "words", "window").withColumn("wid", F.xxhash64("window")), "windows")
    windows = owners.groupBy("wid", "window").agg(F.first("words").alias("words"))
    windows = stored(windows.withColumn("length", F.size("words")), "windows")
    shapes = windows.select(F.least("length", F.lit(WIDTH)).alias("n")).distinct().orderBy("n").limit(WIDTH).collect()
    lengths = [r["n"] for r in shapes] or [WIDTH]

    parts = None
    for n in lengths:  # a window's shingles have WIDTH words, or all of a shorter window
        of_length = windows.filter(F.least("length", F.lit(WIDTH)) == n)
        one = shingles(of_length, [n], "wid", "window", "length")
        parts = one if parts is None else parts.unionByName(one)
    parts = stored(parts.withColumnRenamed("at", "offset"), "prefixes")
    wanted = parts.select("h").distinct()
    seen = shingles(words, lengths).join(small(wanted, BROADCAST_KEYS), "h").groupBy("h").agg(F.count("*").alias("seen"))
    ranked = parts.join(seen, "h")  # a window with a shingle that no text has occurs nowhere
    complete = ranked.groupBy("wid", "window", "length").agg(
        F.min_by(F.struct("h", "offset"), F.struct("seen", "offset")).alias("least"), F.count("*").alias("present")
    ).filter(F.col("present") == F.col("length") - F.least("length", F.lit(WIDTH)) + 1)
    prefix = stored(complete.select("wid", "window", "length", "least.*"), "prefix")

    sized = words.withColumn("n_words", F.size("words"))
    near = shingles(sized, lengths, "k", "n_words").join(small(prefix, BROADCAST_WINDOWS), "h")
    start = F.col("at") - F.col("offset")
    near = near.withColumn("start", start).filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    near = stored(near.select("k", "start", "length", "window").distinct(), "places")

    keys = near.select("k").distinct()
    texts = words.join(small(keys, BROADCAST_KEYS), "k", "left_semi").dropDuplicates(["k"])
    starts = near.groupBy("k", "window", "length").agg(F.collect_list("start").alias("starts"))
    places = starts.groupBy("k").agg(F.collect_list(F.struct("window", "length", "starts")).alias("places"))
    held = stored(texts.join(places, "k").select("k", _held("words", "places").alias("held")).filter(F.size("held") > 0), "held")
    names = owners.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    listed = held.select("k", F.explode("held.window").alias("window")).join(names, "window")
    listed = listed.groupBy("k").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("k", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    verdicts = stored(held.select("k", _covered("held").alias("n_hit")).join(listed, "k", "left"), "verdicts")

    counted = docs.select("doc_id", "k", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    out = counted.join(small(verdicts, BROADCAST_WINDOWS), "k", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
