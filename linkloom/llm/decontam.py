"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Each mask is a fixed set of token positions within a short span; hashing a span under a mask
ignores the tokens at all other positions. The three masks are chosen so that any window of
13 tokens with at most two substituted tokens leaves one of them, at one of its places in
the window, untouched. A shorter item is cut into one piece more than tokens of it may differ,
so that one piece is whole; masks without gaps stand for the pieces, and documents are only
probed with those that some item needs. Benchmark seeds and training seeds are joined on their hashes; each
hit fixes how an item lies over a document, and the tokens of that overlap are compared.

Documents stay where they are: seeds are made and probed in one stage (the benchmark's seeds
are broadcast if they are few, else joined by shuffle), and only documents with a hit are
read again for verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import fresh
from ._scratch import Scratch

MASKS = ((0, 1, 2, 3, 4, 6, 7), (0, 1, 3, 4, 5, 6, 8), (0, 1, 3, 7, 8, 9, 10))
WINDOW, SUBSTITUTIONS = 13, 2
#: Characters that tokens are compared without.
PUNCTUATION = ".,;:!?'\"()[]{}*#$%&|"
#: Rows that are broadcast at most (16 bytes or so a row); beyond them joins are shuffled.
SMALL = 500_000


def tokens(text: Column) -> Column:
    """Lower-case words without PUNCTUATION; null: none."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.array_remove(F.split(plain, r"[\x20\x09-\x0D]+"), "")


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def allowed(n: int, substitutions: int = SUBSTITUTIONS) -> int:
    """Tokens of n that may differ: all ``substitutions`` from 8 tokens on (of two), one from 5 on, none below."""
    return max(0, min(substitutions, (n - 2) // 3))


def pieces(n: int, substitutions: int = SUBSTITUTIONS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of n tokens: one more than may differ."""
    cuts = [n * i // (allowed(n, substitutions) + 1) for i in range(allowed(n, substitutions) + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _seed(words: Column, mask: tuple[int, ...], i: Column) -> Column:
    """The hash of the tokens that a mask shows at place i; masks differ in their first value."""
    return F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get(words, i + k) for k in mask])


def _seeds(words: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """For each mask, the seeds of all its places in an array of hashed words."""
    parts = []
    for mask in masks:
        places = F.size(words) - mask[-1]
        seeds = F.transform(F.sequence(F.lit(0), places - 1), _of_one(lambda i, mask=mask: _seed(words, mask, i)))
        parts.append(F.when(places > 0, seeds).otherwise(F.array().cast("array<bigint>")))
    return F.array(*parts)


def _of_one(f):
    """transform() reads a function's arity from its signature."""
    return lambda x: f(x)


def _exploded(df: DataFrame, masks: tuple[tuple[int, ...], ...], *keep: str) -> DataFrame:
    """A row for each place of each mask: keep, at, seed."""
    by_mask = df.select(*keep, F.explode(_seeds(F.col("words"), masks)).alias("seeds"))
    return by_mask.select(*keep, F.posexplode("seeds").alias("at", "seed"))


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _key(text: Column, id_: Column) -> Column:
    return F.xxhash64(id_, text)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, key, item_id, start, matched, best_window): documents that hold a stretch of a benchmark item.

    An item lies over a document if, at some offset, a window of ``window`` consecutive tokens
    has at most ``substitutions`` tokens that differ. Of an item that is shorter than the
    window all tokens are compared, and ``allowed`` says how many may differ: two from 8 tokens
    on, one of 5 to 7, none of fewer (an item of one word is found wherever that word stands).
    With the given window and substitutions, all such places are found. matched
    counts the item's equal tokens at the best offset, start is that offset (it may be
    negative), best_window the equal tokens of the best window. Rows come once for each id,
    text and item. key tells apart texts under one id, null ids included. Null texts and items
    have no tokens and are never reported; empty tables give no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), _hashed(F.col(item_text_col).cast("string")).alias("words"))
    items = scratch.save(items.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]), "items")
    short = sorted(r["n"] for r in items.filter((F.size("words") < WINDOW) & (F.size("words") > 0)).select(F.size("words").alias("n")).distinct().collect())  # at most WINDOW values
    cut = {n: pieces(n, substitutions) for n in short}
    masks = (*MASKS, *(tuple(range(k)) for k in sorted({k for parts in cut.values() for _, k in parts})))
    seeds = _exploded(items.filter(F.size("words") >= WINDOW), MASKS, "item").select("seed", "item", F.col("at").alias("item_at"))
    for n, parts in cut.items():
        own = F.array(*[F.struct(_seed(F.col("words"), tuple(range(k)), F.lit(i)).alias("seed"), F.lit(i).alias("item_at")) for i, k in parts])
        seeds = seeds.unionByName(items.filter(F.size("words") == n).select("item", F.explode(own).alias("s")).select("s.seed", "item", "s.item_at"))
    seeds = scratch.save(seeds.distinct(), "seeds")

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("key", _key(F.col("text"), F.col("id")))
    probed = _exploded(own.select("key", _hashed(F.col("text")).alias("words")), masks, "key")
    hits = probed.join(_hint(seeds, seeds.count()), "seed").select("key", "item", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    hits = scratch.save(hits, "hits")
    found = scratch.save(hits.select("key").distinct(), "found")

    # Only documents with a hit are read again.
    again = own.join(_hint(found, found.count()), "key", "left_semi").dropDuplicates(["key"]).select("key", "id", _hashed(F.col("text")).alias("words"))
    per_doc = hits.groupBy("key", "item").agg(F.collect_set("start").alias("starts"))
    laid = per_doc.join(_hint(items.select("item", "item_id", F.col("words").alias("wanted")), items.count()), "item").join(again, "key")
    laid = laid.withColumn("start", F.explode("starts")).drop("starts")
    equal = F.transform("wanted", lambda w, j: F.coalesce((F.get("words", F.col("start") + j) == w).cast("int"), F.lit(0)))
    width = F.least(F.lit(window), F.size("wanted"))
    sums = F.transform(F.sequence(F.lit(0), F.size("wanted") - width), lambda s: F.aggregate(F.slice(F.col("equal"), s + 1, width), F.lit(0), lambda a, x: a + x))
    laid = laid.withColumn("equal", equal).withColumn("best_window", F.array_max(sums)).withColumn("matched", F.aggregate("equal", F.lit(0), lambda a, x: a + x))
    laid = laid.filter(F.col("best_window") >= width - F.when(width >= window, substitutions).otherwise(F.greatest(F.lit(0), F.least(F.lit(substitutions), F.floor((width - 2) / 3)))))
    best = F.max(F.struct(F.col("best_window"), F.col("matched"), (-F.col("start")).alias("less"))).alias("best")
    out = laid.groupBy("key", "item", "id", "item_id").agg(best)
    return out.select("id", "key", "item_id", (-F.col("best.less")).alias("start"), F.col("best.matched").alias("matched"), F.col("best.best_window").alias("best_window"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, without the contaminated ones."""
    key = fresh("gone", docs.columns)
    gone = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("key").alias(key)).distinct()
    gone = Scratch(docs.sparkSession, "decontam").save(gone, "gone")
    match = _key(F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")) == F.col(key)
    return docs.join(_hint(gone, gone.count()), match, "left_anti")


def oracle_sql() -> str:
    """The operator over ``documents`` and ``benchmark`` in DuckDB SQL, without seeds: all offsets at which any word is equal."""
    words = rf"list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '[\x20\x09-\x0D]+'), lambda x : x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d),
bt AS (SELECT item_id, len(w) AS n, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM b),
e AS (
  SELECT doc_id, item_id, dt.p - bt.p AS start, n, least({WINDOW}, n) AS width,
    CASE WHEN n >= {WINDOW} THEN {SUBSTITUTIONS} ELSE greatest(0, least({SUBSTITUTIONS}, (n - 2) // 3)) END AS may, list(bt.p) AS ps
  FROM dt JOIN bt USING (t) GROUP BY ALL HAVING count(*) >= least({WINDOW}, n) - may),
s AS (
  SELECT doc_id, item_id, start, width, may, CAST(len(ps) AS INTEGER) AS matched,
    CAST(list_max(list_transform(range(0, n - width + 1), lambda i : len(list_filter(ps, lambda q : q >= i AND q < i + width)))) AS INTEGER) AS best_window
  FROM e)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, matched, best_window FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, matched DESC, start) AS r
  FROM s WHERE best_window >= width - may)
WHERE r = 1
"""
