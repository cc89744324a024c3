"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A seed is a fixed mask over consecutive tokens that ignores some positions. At every token of every text
each mask gives the hash of the tokens it reads, so a passage whose altered tokens fall in the gaps of
one mask at one place still hits. The masks are chosen so that one substituted token in every four, five
or six leaves a hit. Hashes of benchmark items and of documents are joined; each hit lays the item over
the document, and tokens are compared around it: an item is found if some window of ``WINDOW``
tokens of it (all of a shorter item) that holds the hit agrees in at least ``least_share`` of its tokens.

An item too short for a seed is looked for as a whole: the hash of all its tokens is joined with the hashes
of as many consecutive tokens of the documents, and the tokens are compared. Characters of scripts that put no
spaces between words are tokens of their own.

Documents are read once, and once more if the benchmark has such short items. Tokens are exploded, hashed and looked up inside one generated loop; only
verified hits, reduced to one row per document and item in each task, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ("111101111", "111011101", "111110111")
SPAN = 9
WINDOW = 20
BROADCAST_BYTES = 64_000_000  # of the benchmark's seeds (SEED_BYTES each) and token arrays, up to which they are broadcast
SEED_BYTES = 40


# scripts without spaces between words; Bopomofo and Hangul are left as they are, their words are spaced
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and each letter of scripts without spaces."""
    low = F.lower(text)
    apart = F.regexp_replace(low, rf"(?<=[{UNSPACED}&&[\p{{L}}\p{{N}}]])(?=[\p{{L}}\p{{N}}])|(?<=[\p{{L}}\p{{N}}])(?=[{UNSPACED}&&[\p{{L}}\p{{N}}]])", " ")
    return F.array_remove(F.split(F.when(low.rlike(f"[{UNSPACED}]"), apart).otherwise(low), r"[^\p{L}\p{N}]+"), "")


def seeds(words: str, pos: str) -> Column:
    """Hash of each mask at a position; the tokens of the whole span must exist."""
    at = lambda k: F.get(F.col(words), F.col(pos) + k)
    return F.array(*(F.xxhash64(F.lit(m), *(at(k) for k, c in enumerate(mask) if c == "1")) for m, mask in enumerate(MASKS)))


def seeded(rows: DataFrame) -> DataFrame:
    """rows with (id, words), once for each position and mask: (id, words, pos, seed); select what is needed of it."""
    at = rows.select("id", "words", F.posexplode_outer("words").alias("pos", "w")).filter(F.col("pos") <= F.size("words") - SPAN)
    return at.select("id", "words", "pos", F.explode(seeds("words", "pos")).alias("seed"))


def _size(words: str) -> Column:
    """Bytes of a token array, about: a token's bytes and twice eight for its place."""
    return F.octet_length(F.array_join(words, "")) + 16 * F.size(words)


def whole_copies(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """(id, item, share = 1) of the items of 1 to SPAN - 1 tokens that texts repeat word for word; None without such items."""
    short = items.select(F.col("id").alias("item"), F.col("words").alias("item_words")).filter(F.size("item_words").between(1, SPAN - 1))
    got = short.groupBy(F.size("item_words").alias("n")).agg(F.count("*").alias("c"), F.sum(_size("item_words")).alias("b")).collect()  # at most SPAN - 1 rows
    if not got:
        return None
    short = short.select("item", "item_words", F.xxhash64("item_words").alias("hash"))
    if sum(r.b + SEED_BYTES * r.c for r in got) <= BROADCAST_BYTES:
        short = F.broadcast(short)
    runs = [F.when(F.col("pos") <= F.size("words") - r.n, F.slice("words", F.col("pos") + 1, r.n)) for r in got]
    at = texts.select("id", "words", F.posexplode("words").alias("pos", "w"))
    at = at.select("id", F.explode(F.array(*runs)).alias("run")).filter("run is not null")
    same = at.withColumn("hash", F.xxhash64("run")).join(short, "hash").filter("run = item_words")
    return same.select("id", "item", F.lit(1.0).alias("share"))


def laid_over(hits: DataFrame) -> DataFrame:
    """(id, item, w, n, d, i): tokens of document and item, side by side, in the item's windows that hold the hit.

    w: length of a window; n: tokens of the item that such windows cover; d and i begin at the first of
    them that the document has, and d ends with the document.
    """
    size = F.size("item_words")
    w = F.least(size, F.lit(WINDOW))
    first, last = F.greatest(F.lit(0), F.col("at") + SPAN - w), F.least(size, F.col("at") + w)
    begin = F.greatest(first, F.col("at") - F.col("pos"))
    doc = F.slice("words", F.col("pos") - F.col("at") + begin + 1, last - begin)
    return hits.select("id", "item", w.alias("w"), (last - first).alias("n"), doc.alias("d"), F.slice("item_words", begin + 1, last - begin).alias("i"))


def best_share(laid: DataFrame) -> DataFrame:
    """(id, item, share): the largest share of equal tokens in a window.

    Equal tokens are the bits of a number, the last token the lowest; a window is a mask.
    """
    equal = F.zip_with(F.slice("i", 1, F.size("d")), "d", lambda a, b: F.when(a == b, 1).otherwise(0).cast("long"))
    bits = F.aggregate(equal, F.lit(0).cast("long"), lambda m, e: m * 2 + e)
    marked = laid.select("id", "item", "w", "n", F.expr("shiftleft(1L, size(i) - size(d))").alias("up"), bits.alias("m")).withColumn("m", F.col("m") * F.col("up"))
    masks = [F.expr(f"CASE WHEN n - w >= {s} THEN bit_count(m & shiftleft(shiftleft(1L, w) - 1L, {s})) ELSE 0 END") for s in range(WINDOW - SPAN + 1)]
    return marked.select("id", "item", (F.greatest(*masks) / F.col("w")).alias("share"))


def _told_apart(rows: DataFrame, name: str) -> DataFrame:
    """rows with a struct (id, which) as their id: repeated ids with other tokens stay apart. Hashed once a row, before
    any explode."""
    return rows.select(F.struct("id", F.xxhash64("words").alias("which")).alias("id"), "words").select("id", F.col("words").alias(name))


def seed_hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(id, words, pos, item, item_words, at): where a document's seed meets an item's.

    Items' seeds are broadcast without their tokens, and each item's tokens once beside them, if both together
    are BROADCAST_BYTES at most; the documents are then read in place. A larger benchmark is joined by its
    seeds, both sides as rows of fixed size, and the tokens are fetched for what has met.
    """
    items = items.filter(F.size("words") >= SPAN)
    n, size = items.agg(F.sum((F.size("words") - SPAN + 1) * len(MASKS)), F.sum(_size("words") + SEED_BYTES)).first()
    own = seeded(_told_apart(items, "words")).select("seed", F.col("id").alias("item"), F.col("pos").alias("at"))
    listed = _told_apart(items, "item_words").withColumnRenamed("id", "item").distinct()
    if (n or 0) * SEED_BYTES + (size or 0) <= BROADCAST_BYTES:
        met = seeded(texts).join(F.broadcast(own), "seed").join(F.broadcast(listed), "item")
    else:
        known = _told_apart(texts, "words")
        met = seeded(known).select("seed", "id", "pos").join(own, "seed").select("id", "pos", "item", "at").distinct()
        met = met.join(known.distinct(), "id").join(listed, "item").withColumn("id", F.col("id.id"))
    return met.select("id", "words", "pos", F.col("item.id").alias("item"), "item_words", "at")


def overlaps(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, share): the items found in each document, with the best window's share of equal tokens.

    Items of fewer than 9 tokens are found where a text repeats all their tokens in a row. Items and texts without a
    token, null and empty ones included, hit nothing. Null ids are left out.
    """
    items = benchmark.select(F.col(item_col).alias("id"), tokens(F.col(item_text_col).cast("string")).alias("words")).filter("id is not null")
    texts = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col).cast("string")).alias("words")).filter("id is not null")
    hits = seed_hits(texts, items)
    shares = best_share(laid_over(hits))
    if (copies := whole_copies(texts, items)) is not None:
        shares = shares.unionByName(copies)
    found = shares.groupBy("id", "item").agg(F.max("share").alias("share")).filter(F.col("share") >= least_share)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "share")


def contamination(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, contaminated, n_items, best_share) of every row of docs, repeated and null ids included.

    best_share is 0 where nothing is found. An empty benchmark leaves all documents clean; empty docs
    give an empty result; other columns are ignored, whatever their names. Rows that repeat an id share
    what is found in any of them.
    """
    found = overlaps(docs, benchmark, least_share, id_col, text_col, item_col, item_text_col)
    each = found.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n_items"), F.max("share").alias("best_share"))
    out = docs.select(F.col(id_col).alias("id")).join(each, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"))
