"""Benchmark decontamination as a prefix-filtered set join. DataFrame functions only.

A window is ``words`` consecutive words of a benchmark item, or the whole item where it
has fewer. A window's shingles are its adjacent word pairs (its word, for one word).
Containment of a window in a document has threshold one, so a single prefix token is
necessary: the window's rarest shingle, by count over the whole corpus. Documents are
joined on that shingle only; length and positional bounds drop windows that would
stick out of the document, and the remaining candidates are verified word by word.

Null and empty texts have no words. Equal windows of several items are joined once.
Repeated documents each get their row; documents with equal keys and different texts
stay apart. Extra columns are ignored. An empty benchmark leaves every document clean; an
empty document table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import Scratch, ascii_lower, durable, without

WINDOW_WORDS = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most distinct benchmark shingles, windows, and items over all windows that are broadcast; above it both joins shuffle, with salted shingles.
BROADCAST_SHINGLES = 400_000
SALTS = 32
#: Rows of one document (equal id and text) that one task writes.
COPIES = 100_000


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _shingles(words: Column) -> Column:
    """Hash of each word with its successor; of the single word where there is one."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) < 2, F.transform(words, lambda w: F.xxhash64(w))).otherwise(pairs)


def windows(benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """(window array<string>, items array<string>) for every distinct window; items in no order."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    cut = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), n).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def _document_shingles(docs: DataFrame, has_single: bool, marker: bool = False) -> DataFrame:
    """docs with ``pos`` (0-based word position) and ``shingle``, one row per shingle; with ``marker`` a row at -1 too."""
    hashed = _shingles(F.col("words"))
    if has_single:  # one-word items look single words up, too
        hashed = F.concat(
            F.transform(hashed, lambda h, i: F.struct(i.alias("pos"), h.alias("shingle"))),
            F.when(F.size("words") > 1, F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w).alias("shingle")))).otherwise(
                F.array().cast("array<struct<pos:int,shingle:bigint>>")
            ),
        )
        if marker:
            hashed = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("shingle"))), hashed)
        return docs.select("*", F.explode(hashed).alias("h")).select(*docs.columns, "h.pos", "h.shingle")
    if marker:
        return docs.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), hashed)).alias("p", "shingle")).select(*docs.columns, (F.col("p") - 1).alias("pos"), "shingle")
    return docs.select("*", F.posexplode(hashed).alias("pos", "shingle"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A marker row for every document row, and a row for each occurrence of a window.

    doc_id, text_key, n_words, marker boolean, start (in words from 0; -1 in markers), length, items.
    """
    found = durable(windows(benchmark, n).withColumn("shingles", _shingles(F.col("window"))))
    known = found.select(F.explode("shingles").alias("shingle")).distinct()
    n_windows, n_items = found.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    has_single = not found.filter("size(window) = 1").isEmpty()
    small = max(n_windows, n_items, known.count()) <= BROADCAST_SHINGLES
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words_of(F.col(text)).alias("words"))
    # rarity: how often each benchmark shingle occurs in the corpus
    seen = _document_shingles(source.select("words"), has_single).select("shingle")
    counts = seen.join(F.broadcast(known), "shingle", "left_semi") if small else seen.groupBy("shingle").count().join(known, "shingle", "left_semi")
    counts = counts.groupBy("shingle").agg(F.count("*").alias("n")) if small else counts.withColumnRenamed("count", "n")
    # the necessary prefix of each window: its rarest shingle, and where it stands in the window
    prefix = (
        found.select("window", "items", F.posexplode("shingles").alias("offset", "shingle"))
        .join(counts, "shingle")  # a window with a shingle that never occurs cannot occur
        .groupBy("window")
        .agg(F.min(F.struct("n", "shingle", "offset")).alias("rarest"), F.first("items").alias("items"), F.count("*").alias("present"))
        .filter(F.col("present") == F.greatest(F.size("window") - 1, F.lit(1)))
        .select("window", "items", F.size("window").alias("length"), "rarest.shingle", "rarest.offset")
    )
    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("length") <= F.size("words"))
    exact = F.slice("words", F.col("pos") - F.col("offset") + 1, F.col("length")) == F.col("window")
    start = (F.col("pos") - F.col("offset")).alias("start")
    if small:
        # one pass gives both: each document's marker (position -1, no shingle) and its verified occurrences
        spread = _document_shingles(source.withColumn("n_words", F.size("words").cast("long")), has_single, marker=True)
        found_at = spread.join(F.broadcast(prefix), "shingle", "left").filter((F.col("pos") < 0) | (F.col("window").isNotNull() & fits & exact))
        return found_at.select(
            "doc_id", "text_key", "n_words", (F.col("pos") < 0).alias("marker"),
            F.when(F.col("pos") < 0, -1).otherwise(start).alias("start"), F.coalesce("length", F.lit(0)).alias("length"), "items",
        )
    # both sides shuffle; the text joins the candidates afterwards, once for each document that has any
    spread = _document_shingles(source, has_single).select("doc_id", "text_key", "pos", "shingle", F.size("words").alias("size"))
    salted = spread.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    copies = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = salted.join(copies, ["shingle", "salt"]).filter((F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("length") <= F.col("size")))
    named = near.select("pos", "offset", "length", "window", "items", F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    texts = source.dropDuplicates(["doc_id", "text_key"])
    checked = texts.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).filter(exact)
    markers = source.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.lit(True).alias("marker"), F.lit(-1).alias("start"), F.lit(0).alias("length"), F.lit(None).cast("array<string>").alias("items"))
    return markers.union(checked.select("doc_id", "text_key", F.size("words").cast("long"), F.lit(False), start, "length", "items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, n, key, text)
    # a set: copies of a document merge in their tasks, and what is left of a text is bounded by its words
    hits = F.collect_set(F.when(~F.col("marker"), F.struct("start", "length", "items"))).alias("hits")
    per_doc = found.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), hits, F.count_if("marker").alias("rows"))
    none = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))

    def cover(state: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        new = F.greatest(F.lit(0), end - F.greatest(x["start"], state["reach"]))
        return F.struct(F.greatest(state["reach"], end).alias("reach"), (state["n"] + new).alias("n"))

    told = per_doc.select(
        "doc_id", "n_words", F.aggregate(F.array_sort("hits"), none, cover, lambda s: s["n"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))).alias("items"), "rows",
    ).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "rows")
    # rows of many copies are dealt out before they are written one by one; stored, so that the corpus is not read for both parts
    told = Scratch(docs.sparkSession, "contamination").keep(told, "told")
    few, many = told.filter(F.col("rows") <= COPIES), told.filter(F.col("rows") > COPIES)
    parts = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES)))).repartition("doc_id", "items_sha256", "part")
    dealt = parts.withColumn("rows", F.least(F.lit(COPIES), F.col("rows") - F.col("part") * COPIES)).drop("part")
    return few.unionByName(dealt).select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "col")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a whole window."""
    hits = contamination(docs, benchmark, n).filter("not marker")
    return without(docs, durable(hits.select("doc_id", "text_key").distinct()))


def oracle(n: int = WINDOW_WORDS, documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for :func:`decontaminate`."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {documents}),
        b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM {benchmark}),
        win AS (SELECT DISTINCT item, w[s:s + {n} - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
        firsts AS (SELECT item, win, len(win) AS n, win[1] AS f FROM win),
        places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
        hit AS (SELECT r, p, n, item FROM places JOIN firsts ON w[p] = f AND w[p:p + n - 1] = win),
        cov AS (SELECT r, count(DISTINCT p + o)::BIGINT AS n_hit FROM (SELECT r, p, unnest(range(0, n)) AS o FROM hit) GROUP BY r),
        its AS (SELECT r, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""
