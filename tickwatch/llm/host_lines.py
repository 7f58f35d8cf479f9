"""Quality rules with cross-document line frequency, with DataFrame functions only.

Lines are normalised (lower case, digits to 0, runs of white space and
punctuation to one blank) and hashed; per host the documents that have a line
are counted. Lines in more than `min_docs` documents of their host are
boilerplate, however large the host: they are removed, and a document that keeps
less than `least_kept` of its words is depleted and rejected. A caller can ask
for more than a `share` of the host's documents as well.

A row is a document; repeated rows count each. Null texts have no words; a null
host is a host of its own. Lines without a letter or digit are not counted and
always stay. Empty tables give no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import SPACES, let, words_of
from tickwatch.session import stage

MIN_DOCS = 10
LEAST_KEPT = 0.5
MIN_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def normalized(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}+", "0"), r"[^\p{L}\p{N}]+", " "))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by `window`-word windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            same = F.transform(rows, lambda r, j: F.when(
                (F.get(rows, j + 1)["h"] == r["h"]) | (F.get(rows, j - 1)["h"] == r["h"]), r["i"]))
            return F.array_sort(F.array_compact(same))

        def total(at: Column) -> Column:
            # Each start adds the words up to the next start, a whole window at most.
            gaps = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(ordered, starts), total)

    def of(ws: Column) -> Column:
        hashes = F.when(F.size(ws) >= window, F.transform(
            F.sequence(F.lit(1), F.size(ws) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window))))
        return let(F.coalesce(hashes, F.array().cast("array<bigint>")), lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))

    return let(words, of)


def repeated_lines(lines: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    worded = F.filter(lines, lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    return let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame, host_col: str) -> DataFrame:
    """One row per row of docs: counts of the text, and its lines as (hash, words, first of its kind)."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[host_col].cast("string"), F.lit("\0"))
                       .alias("host"), text.alias("text"), F.monotonically_increasing_id().alias("row"))

    def line(x: Column) -> Column:
        return let(normalized(x), lambda n: F.struct(
            F.when(n != "", F.xxhash64(n)).alias("h"), F.size(words_of(x)).alias("w")))

    lines = F.transform(F.split("text", "\n", -1), line)
    first = let(lines, lambda x: F.struct(
        x.alias("lines"), F.array_compact(F.array_distinct(F.transform(x, lambda r: r["h"]))).alias("kinds")))
    joined = F.translate("text", SPACES, "")
    return rows.select(
        "row", "doc_id", "host", F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_lines(F.split("text", "\n", -1)).alias("n_dup_lines"),
        repeated_words(words_of(F.col("text"))).alias("n_repeat_words"), first.alias("m"))


def line_rules(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS, share: float | None = None,
               least_kept: float = LEAST_KEPT) -> DataFrame:
    """Counts and verdict of every row: doc_id, host, the counts, n_removed_lines, n_removed_words, base_failed, depleted, kept."""
    rows = stage(measured(docs, host_col), "measured")
    counts = (rows.select("host", F.explode("m.kinds").alias("h")).groupBy("host", "h")
              .agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs))
    if share is not None:
        hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs_of_host"))
        counts = counts.join(hosts, "host").filter(F.col("docs") > share * F.col("docs_of_host"))
    frequent = stage(counts.select("host", "h"), "host-lines")
    lines = rows.select("row", "host", F.explode("m.lines").alias("line")).select("row", "host", "line.h", "line.w")
    # A line of a third of all documents fills one partition here; it is split at run time.
    removed = lines.join(frequent, ["host", "h"]).groupBy("row").agg(
        F.count(F.lit(1)).alias("n_removed_lines"), F.sum("w").alias("n_removed_words"))
    zero = F.lit(0).cast("long")
    out = rows.drop("m").join(removed, "row", "left").withColumns({
        "n_removed_lines": F.coalesce("n_removed_lines", zero), "n_removed_words": F.coalesce("n_removed_words", zero)})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumns({"base_failed": base, "depleted": left < least_kept * F.col("n_words")})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("row")


def without_lines(docs: DataFrame, frequent: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, text: the texts without the lines of `frequent` (columns host, h), other lines as they were."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"),
                       F.coalesce(docs[host_col].cast("string"), F.lit("\0")).alias("host"),
                       F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "rows")
    lines = rows.select("row", "host", F.explode(F.array_distinct(F.transform(
        F.split("text", "\n", -1), lambda x: F.xxhash64(normalized(x))))).alias("h"))
    gone = lines.join(frequent, ["host", "h"]).groupBy("row").agg(F.collect_set("h").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: (normalized(x) == "") | ~F.array_contains(
        F.coalesce("gone", F.array().cast("array<bigint>")), F.xxhash64(normalized(x)))), "\n")
    return rows.join(gone, "row", "left").select("doc_id", kept.alias("text"))
