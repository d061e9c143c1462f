"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``WINDOW`` consecutive words (an item of fewer
words, but not none, is one window).  A document occurrence of a window must
hold all of its words, so a prefix of one token is enough to find it: each
window is joined by its rarest word in the corpus only.  A document's words are
dealt in short segments that carry their neighbours; where a window's prefix
word stands, its offset gives the only place the window can have (the length
and positional bounds), and the words there are compared one by one with the
window's (the verification).

The prefixes are broadcast only if their counted number is at most
``BROADCAST_WINDOWS``.  Beyond that a document's words meet them on salted
copies, carrying only their place; documents without a match are dropped before
the others' segments are fetched for verification.  A window's items are joined
when its occurrences are known, so a window of many items is no wide row.
Documents are found again by (doc_id, hash of the text), never by a collected
list.

Defined results: a null text has no words (nothing hit, no items, not
contaminated); items without words or with a null id never occur; repeated rows
give repeated results; empty tables give empty results, or no hits; texts of
any length are searched whole; only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandgraph.llm.common import WorkTables, fresh

WINDOW, SEGMENT = 8, 16
BROADCAST_WINDOWS, SALTS = 200_000, 16
# The bytes that part words, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; A-Z alone are lower-cased (in plain ASCII, lower() does just that)."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def windows_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(window, size, item): the windows of each item as words joined by a space, each once."""
    w, n = F.col("w"), F.size("w")
    runs = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.slice(w, i, WINDOW))).otherwise(F.array(w))
    return (
        benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
        .where(F.col("item").isNotNull() & (n > 0))
        .select("item", F.explode(runs).alias("run"))
        .select(F.array_join("run", " ").alias("window"), F.size("run").alias("size"), "item")
        .distinct()
    )


def prefixes(windows: DataFrame, docs: DataFrame, text_col: str, small: bool) -> DataFrame:
    """(word, offset, size, window): every window under its rarest word over all documents."""
    placed = windows.select("window", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    vocabulary = placed.select("word").distinct()
    spoken = docs.select(F.explode(words_of(F.col(text_col))).alias("word"))
    counts = spoken.join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    rarest = placed.join(counts, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p"))
    return windows.join(rarest, "window").where("p.n > 0").select("p.word", "p.offset", "size", "window")


def segments_of(docs: DataFrame) -> DataFrame:
    """(id, text_key, part, first, start, near, own): a document's words in segments, with their neighbours joined by a space."""
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(SEGMENT))
    segment = F.transform(
        starts,
        lambda s: F.struct(
            F.greatest(s - WINDOW + 1, F.lit(0)).alias("first"),
            s.alias("start"),
            F.slice(w, F.greatest(s - WINDOW + 2, F.lit(1)), F.least(s, F.lit(WINDOW - 1)) + SEGMENT + WINDOW - 1).alias("words"),
        ),
    )
    return (
        docs.where(F.size("w") > 0)
        .select("id", "text_key", F.explode(segment).alias("s"))
        .select("id", "text_key", "s.first", F.array_join("s.words", " ").alias("near"), F.slice("s.words", F.col("s.start") - F.col("s.first") + 1, SEGMENT).alias("own"), F.col("s.start").alias("start"))
    )


def occurrences(docs: DataFrame, prefix: DataFrame, id_col: str, text_col: str, small: bool, work: WorkTables) -> DataFrame:
    """(id, text_key, start, size, window) of every window occurrence."""
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    place = F.col("start") + F.col("at") - F.col("offset") - F.col("first")
    if small:
        near = segments_of(cut).select("id", "text_key", "first", "near", "start", F.posexplode("own").alias("at", "word")).join(F.broadcast(prefix), "word")
    else:
        copies = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tokens = cut.select("id", "text_key", F.posexplode("w").alias("pos", "word")).withColumn("salt", F.floor(F.rand(3) * SALTS).cast("int"))
        found, _ = work.save(tokens.join(copies, ["word", "salt"]).where("pos >= offset").select(F.col("id").alias("found_id"), F.col("text_key").alias("found_key"), "pos", "offset", "size", "window"))
        same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
        near = (
            segments_of(cut.join(found.select("found_id", "found_key").distinct(), same, "left_semi"))
            .drop("own")
            .join(found, same & (F.col("start") == F.floor(F.col("pos") / SEGMENT) * SEGMENT))
            .withColumn("at", F.col("pos") - F.col("start"))
        )
    return (
        near.where(place >= 0)
        .where(F.array_join(F.slice(F.split("near", " "), place + 1, F.col("size")), " ") == F.col("window"))
        .select("id", "text_key", (place + F.col("first")).alias("start"), "size", "window")
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_items: int = 2) -> DataFrame:
    """One row per document: id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    work = WorkTables(docs.sparkSession, "decontam")
    of_items, _ = work.save(windows_of(benchmark, item_col, item_text_col))
    windows, _ = work.save(of_items.select("window", "size").distinct())
    small = windows.count() <= BROADCAST_WINDOWS
    prefix, _ = work.save(prefixes(windows, docs, text_col, small))
    found, _ = work.save(occurrences(docs, prefix, id_col, text_col, small, work))
    runs = (
        found.groupBy(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"))
        .agg(F.collect_set(F.struct("start", "size")).alias("runs"))
        .select("hit_id", "hit_key", F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1))))).cast("long").alias("n_hit"))
    )
    once = found.select("id", "text_key", "window").distinct()
    held = once.join(of_items.select("window", "item"), "window").groupBy(F.col("id").alias("item_id"), F.col("text_key").alias("item_key")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = runs.join(held, F.col("hit_id").eqNullSafe(F.col("item_id")) & (F.col("hit_key") == F.col("item_key"))).select("hit_id", "hit_key", "n_hit", "items")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").select(
        F.col("id").alias(id_col),
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.size(F.coalesce("items", none)) >= least_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2) -> DataFrame:
    """``docs`` without its contaminated rows, with all other columns as they are."""
    bad_id, bad_key = fresh("bad_id", docs.columns), fresh("bad_key", docs.columns)
    found = find_contamination(docs, benchmark, id_col, text_col, least_items=least_items)
    bad = found.where("contaminated").select(F.col(id_col).alias(bad_id), F.col("text_key").alias(bad_key))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[text_col]) == F.col(bad_key)), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE [array_to_string(w, ' ')] END) AS win, least(len(w), 8) AS k FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k
), hit AS (
  SELECT dw.doc_id, bw.item, dw.i, dw.k FROM dw JOIN bw ON bw.k = dw.k AND bw.win = array_to_string(dw.w[dw.i:dw.i + dw.k - 1], ' ')
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
