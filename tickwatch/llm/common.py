"""Small helpers shared by the corpus operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, the only separators of words and the only characters stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
# Stands for a null document id where rows are joined by id.
NO_ID = -(2**63)


def let(value: Column, body) -> Column:
    """`body` of `value`, with `value` computed once per row however often `body` uses it.

    A plain column used inside a lambda may be inlined by the optimizer and
    would then be computed again for every array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text: what white space separates; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1)
    return F.filter(parts, lambda w: w != "")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id, text and the further columns alone; a null text becomes the empty one."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[docs[c] for c in more])


def id_key(column: str | Column = "doc_id") -> Column:
    """The id as a join key that also matches null with null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def remainder(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of whole texts: `most` bytes at most, or one text.

    An Arrow batch counts rows, not bytes; its Python copies are made one stretch at a time.
    """
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        yield start, end
        start = end
