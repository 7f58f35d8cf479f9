"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A spaced seed hashes the tokens at the positions a fixed mask keeps and ignores
those between them (Ma, Tromp and Li 2002), so a passage with single tokens
replaced still has hits. Hashes of all token positions of documents and
benchmark items are joined; every hit names a diagonal (document position minus
item position) on which the whole item is then compared token by token. An item
is found in a document when a stretch of matching tokens, interrupted by at most
two tokens at a time, has at least `min_tokens` matches (for shorter items: 80 %
of the item) and matches at least 80 % of its span.

Tokens are runs of letters and digits in lower case. Null and empty texts have
none. Items with fewer tokens than the longest mask have no seed and are never
found: so short a text is no evidence. Equal items are all reported. Rows
without an id are compared like others. Empty tables give no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import id_key, let, texts

# Masks over token positions: 1 is hashed, 0 ignored.
MASKS = ("1101101", "1110011", "1011011")
MIN_TOKENS = 13
SHARE = 0.8
# Seeds of a benchmark up to this many rows (two numbers and a hash each: about 100 MB) are sent to every
# executor; beyond it both sides are shuffled by hash. The rows are the same.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def seed_hashes(words: Column, masks=MASKS) -> Column:
    """One hash per mask and position, position by position; empty if the text is shorter than a mask."""
    span = max(map(len, masks))

    def at(ids: Column, i: Column) -> Column:
        return F.array(*[
            F.xxhash64(F.lit(m), *[F.get(ids, i + F.lit(k)) for k, bit in enumerate(mask) if bit == "1"])
            for m, mask in enumerate(masks)])

    def of(ids: Column) -> Column:
        return F.when(F.size(ids) >= span, F.flatten(
            F.transform(F.sequence(F.lit(0), F.size(ids) - F.lit(span)), lambda i: at(ids, i))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _seeds(rows: DataFrame, id_col: str, masks) -> DataFrame:
    """id, position, hash of every seed."""
    return (rows.select(id_col, F.posexplode(seed_hashes(tokens(F.col("text")), masks)).alias("p", "seed"))
            .select(id_col, F.floor(F.col("p") / len(masks)).cast("int").alias("at"), "seed"))


def _stretch(bits: Column, least: Column, share: float) -> Column:
    """The best tolerated stretch of a text of 0 and 1 as (matched, span), or null.

    Of each part without three zeros together every stretch counts, not the whole part alone. With the t-th
    one at position p(t), the stretch of the ones a to b is dense enough if key(a) <= key(b) + 1 - share, where
    key(t) = t - share p(t). Starts and ends are sorted by key; the smallest start so far is the best of an end.
    """
    unit = 1_000_000
    per = round(share * unit)

    def dense(at: Column) -> Column:
        keys = F.flatten(F.transform(at, lambda p, t: let(t * F.lit(unit).cast("long") - p * F.lit(per).cast("long"), lambda k: F.array(
            F.struct(k.alias("k"), F.lit(0).alias("end"), t.alias("t")),
            F.struct((k + unit - per).alias("k"), F.lit(1).alias("end"), t.alias("t"))))))

        def better(best: Column, x: Column) -> Column:
            start = F.when(x["end"] == 0, F.least(best["start"], x["t"])).otherwise(best["start"])
            found = F.struct((x["t"] - best["start"] + 1).alias("matched"),
                             (F.get(at, x["t"]) - F.get(at, best["start"]) + 1).alias("span"))
            more = F.when(x["end"] == 1, F.greatest(best["found"], found)).otherwise(best["found"])
            return F.struct(start.alias("start"), more.alias("found"))

        nothing = F.struct(F.lit(2**31 - 1).alias("start"), F.struct(
            F.lit(0).alias("matched"), F.lit(0).alias("span")).alias("found"))
        return F.aggregate(F.array_sort(keys), nothing, better, lambda best: best["found"])

    def best_of(part: Column) -> Column:
        ones = F.array_compact(F.transform(F.split(part, "", -1), lambda c, i: F.when(c == "1", i)))
        return let(ones, lambda at: F.when(F.size(at) >= least, dense(at)))

    parts = F.transform(F.split(bits, "0{3,}", -1), best_of)
    return F.array_max(F.filter(parts, lambda s: s["matched"] >= least))


def contamination(docs: DataFrame, items: DataFrame, masks=MASKS, min_tokens: int = MIN_TOKENS,
                  share: float = SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, start (token of the document), matched, span: the best overlap of each pair."""
    docs, items = texts(docs), items.select(
        items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text")).distinct()
    # An item is its id and its text, as ids can be null or repeated.
    items = items.withColumn("item_key", F.xxhash64(id_key("item_id"), "text"))
    targets = _seeds(items, "item_key", masks).select(
        "item_key", F.col("at").alias("item_at"), "seed").distinct()
    if targets.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        targets = F.broadcast(targets)
    hits = (_seeds(docs.select(id_key("doc_id").alias("id"), "text"), "id", masks).join(targets, "seed")
            .select("id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct())

    item_words = items.select("item_key", "item_id", tokens(F.col("text")).alias("item"))
    doc_words = docs.select(id_key("doc_id").alias("id"), "doc_id", "text")
    pairs = hits.groupBy("id").agg(F.collect_list(F.struct("item_key", "shift")).alias("hits"))
    # Only documents with a hit are cut into tokens again.
    near = (doc_words.join(pairs, "id").select("doc_id", tokens(F.col("text")).alias("words"), "hits")
            .select("doc_id", "words", F.explode("hits").alias("hit"))
            .select("doc_id", "words", "hit.item_key", "hit.shift"))
    near = near.join(item_words, "item_key")
    bits = F.array_join(F.transform("item", lambda w, j: F.when(
        (j + F.col("shift") >= 0) & (F.get("words", j + F.col("shift")) == w), F.lit("1")).otherwise(F.lit("0"))), "")
    least = F.least(F.lit(min_tokens), F.ceil(F.size("item") * F.lit(share)).cast("int"))
    found = near.select("doc_id", "item_id", "shift", bits.alias("bits"), least.alias("least"))
    found = found.withColumn("best", _stretch(F.col("bits"), F.col("least"), share)).filter(F.col("best").isNotNull())
    return (found.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("best.matched", "best.span", (-F.col("shift")).alias("at"))).alias("m"))
            .select("doc_id", "item_id", (-F.col("m.at")).alias("shift"), "m.matched", "m.span"))
