"""SimHash near duplicates found through the binary Golay code.

The (23, 12, 7) Golay code is perfect: every 23-bit word is within 3 bits of
exactly one codeword. A 64-bit fingerprint is cut into three segments of 22, 21
and 21 bits, each read as a 23-bit word. A segment gives its nearest codeword, and as
a list all codewords within 4 bits: one, or six where the nearest is 3 bits away. A
word with one bit changed has the nearest codeword of the other within 4 bits, hence
in its list.

Three or fewer differing bits lie in the segments in one of three ways: none in two of
them; none in one and at most one in another; or one in each. So two fingerprints at 3
bits or fewer share two exact segments (at least 42 bits), or an exact segment and a
codeword of another (33 bits), or codewords of all three (36 bits). One side of the
join carries nearest codewords where the other carries lists. Candidates are few at
any size, as keys are long; they are verified by counting differing bits.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import texts
from tickwatch.llm.components import components
from tickwatch.session import ship_package, stage

MAX_BITS = 3
SHINGLE = 3
_POLY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PAIRS = ((0, 1), (0, 2), (1, 2))
_ORDERED = _PAIRS + tuple((j, i) for i, j in _PAIRS)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, _POLY << (bit - 11), 0)
    return rest


def _error_table() -> np.ndarray:
    """Per syndrome the error patterns of weight 4 or less, the lightest first, padded with -1."""
    bits = 1 << np.arange(23, dtype=np.int64)
    patterns, level = [np.zeros(1, dtype=np.int64)], np.zeros(1, dtype=np.int64)
    for _ in range(4):
        grown = np.unique((level[:, None] | bits[None, :]).ravel())
        level = grown[~np.isin(grown, level)]
        patterns.append(level)
    table = np.full((2048, 6), -1, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    for group in patterns:
        for error, s in zip(group, _syndromes(group)):
            table[s, used[s]] = error
            used[s] += 1
    return table


_ERRORS = _error_table()


def codewords(words: np.ndarray) -> np.ndarray:
    """Per 23-bit word the indices (12 bits) of the codewords within 4 bits, nearest first, padded with -1."""
    errors = _ERRORS[_syndromes(words)]
    return np.where(errors >= 0, (words.astype(np.int64)[:, None] ^ errors) >> 11, -1)


def _combined(kind: int, *parts: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all combinations of the parts (rows by choices, bits), without those that lack a codeword (-1)."""
    key = np.full((len(parts[0][0]), 1), kind, dtype=np.int64)
    for part, bits in parts:
        first, second = key[:, :, None], part[:, None, :]
        key = np.where((first >= 0) & (second >= 0), first << bits | second, -1).reshape(len(key), -1)
    row, column = np.nonzero(key >= 0)
    return row, key[row, column]


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of the left and of the right side of the join; keys are longs of disjoint ranges per kind."""
    fp = fingerprints.astype(np.uint64)
    exact = [((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)[:, None], 22) for at, n in _SEGMENTS]
    lists = [(codewords(segment[:, 0]), 12) for segment, _ in exact]
    nearest = [(codes[:, :1], bits) for codes, bits in lists]
    left = [_combined(8 + k, exact[i], exact[j]) for k, (i, j) in enumerate(_PAIRS)]
    right = list(left)
    left += [_combined(16 + k, exact[i], nearest[j]) for k, (i, j) in enumerate(_ORDERED)]
    right += [_combined(16 + k, exact[i], lists[j]) for k, (i, j) in enumerate(_ORDERED)]
    left.append(_combined(24, nearest[0], nearest[1], lists[2]))
    right.append(_combined(24, lists[0], lists[1], nearest[2]))
    return tuple(np.concatenate(x) for side in (left, right) for x in zip(*side))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(batch: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return simhash(text)


def _keys(side: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, keys = golay_keys(fp.view(np.uint64))[2 * side:2 * side + 2]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return of


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b: the distinct fingerprints (column fp) at `max_bits` (3 at most) bits or fewer."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the code answers up to 3 differing bits")
    ship_package(fps.sparkSession)
    left = fps.select("fp").mapInArrow(_keys(0), "key long, fp long").withColumnRenamed("fp", "a")
    right = fps.select("fp").mapInArrow(_keys(1), "key long, fp long").withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # Spark takes the keys for as few as the fingerprints, which have dozens each, and would collect and broadcast them.
    return left.hint("merge").join(right, "key").filter(near).select("a", "b").distinct()


def fingerprint_components(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, root, component_id per distinct fp of rows (columns doc_id, fp); root names the component.

    Only distinct fingerprints are joined and linked, so groups of equal texts
    cost one row whatever their size.
    """
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(linked_fingerprints(fps, max_bits))
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(ids, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed long), component_id for every row of docs.

    component_id is the smallest doc_id linked through fingerprints at `max_bits`
    bits or fewer; null only where no id of the component is known. Texts without
    words, null ones too, have the fingerprint 0, linked like any other; repeated
    rows share theirs.
    """
    ship_package(docs.sparkSession)
    rows = stage(texts(docs).select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash")
    return rows.join(fingerprint_components(rows, max_bits), "fp").select("doc_id", "fp", "component_id")
