"""Secret scan with a random forest that removes false positives.

Candidates are the values assigned to a secret's name, of any length and alphabet; keys of
known formats; and runs of at least 16 characters of `A-Za-z0-9_+/-` with a digit.
Features: length; shares of digits, capitals and hex digits, entropy; changes of
character class; the mean surprise of a change of characters under the counts of such
changes in all texts; share of characters covered by dictionary words; hints in the
path; words next to the candidate. A random forest is fitted on labelled
findings and scores every candidate.

Null and empty texts have no candidates; a null path gives no hint, null ids are kept. Repeated rows
give repeated findings. Without labelled findings of both classes every score is
the share of secrets among the labelled (0.5 if none). Candidates themselves are
not returned, only their place and sha256. An empty table gives no rows, further columns
are ignored, and every pattern reads a text of any length a bounded number of times.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import words_of
from tickwatch.session import ship_package, stage

# Words that announce a secret, and path parts of material that only looks like one.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "credential", "auth")
HARMLESS_WORDS = ("example", "sample", "dummy", "placeholder", "checksum", "sha256", "commit", "uuid", "card", "order")
HARMLESS_PATHS = ("test", "example", "doc", "fixture", "mock", "sample")
# Shapes of material that is no secret, and what stands before such material.
HARMLESS_SHAPE = re.compile(r"[0-9]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HARMLESS_BEFORE = re.compile(r"(?i)(?:commit|checksum|sha-?\d+|md5|digest|etag|revision|blob|uuid|integrity|order|invoice)\W{0,12}$")
KEY = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_\w{36}|xox[abp]-[\w-]+|sk_live_\w{16,}|AIza[\w-]{35}")
# The value of an assignment ends at its quote, or else at white space or a separator.
_NAME = r"(?:" + "|".join(SECRET_WORDS) + r")"
_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}"
CANDIDATE = re.compile(
    rf"(?i:{_NAME}\w{{0,40}}+[\"']?[ \t]*+(?:=>|:=|[=:])[ \t]*+)"
    rf"(?:\"(?P<double>[^\"\n]++)\"|'(?P<single>[^'\n]++)'|(?P<plain>[^\s\"',;]++))"
    rf"|(?P<key>(?<![A-Za-z0-9_-])(?:{KEY.pattern}))|(?P<run>{_RUN})")
ASSIGNED = ("double", "single", "plain")
DICTIONARY = 5_000
MAX_ROWS = 50_000
NEAR = 48
CUT = 0.5
_CLASSES = 5
# Printable ASCII and one more for all other bytes.
_BYTES = 96


def found(text: str) -> Iterator[tuple[int, str, bool]]:
    """(start, value, whether it is assigned to a secret's name) of every candidate."""
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup
        yield m.start(kind), m.group(kind), kind in ASSIGNED


def byte_kinds(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.int64) - 32
    return np.where((raw < 0) | (raw >= _BYTES - 1), _BYTES - 1, raw)


def character_classes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    out = np.full(len(raw), 4, dtype=np.int8)
    out[(raw >= 48) & (raw <= 57)] = 0
    out[(raw >= 97) & (raw <= 102)] = 1
    out[(raw >= 103) & (raw <= 122)] = 2
    out[(raw >= 65) & (raw <= 90)] = 3
    return out


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The `size` most frequent words of 4 to 8 letters a-z; counted over all texts."""
    words = docs.select(F.explode(words_of(F.lower("text"))).alias("word")).filter(F.col("word").rlike("^[a-z]{4,8}$"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def transitions(docs: DataFrame) -> np.ndarray:
    """Log probability of each change from one character to the next in all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_BYTES * _BYTES, dtype=np.int64)
        for pdf in batches:
            for text in pdf["text"].dropna():
                c = byte_kinds(text)
                total += np.bincount(c[:-1] * _BYTES + c[1:], minlength=_BYTES * _BYTES)
        pair = np.flatnonzero(total)
        yield pd.DataFrame({"pair": pair, "n": total[pair]})

    # At most 96 * 96 rows.
    rows = docs.select("text").mapInPandas(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.ones((_BYTES, _BYTES))
    for r in rows:
        n[r["pair"] // _BYTES, r["pair"] % _BYTES] += r["n"]
    return np.log(n / n.sum(axis=1, keepdims=True))


def features(candidate: str, before: str, after: str, path: str | None, log_change: np.ndarray,
             known: set[str]) -> list[float]:
    classes, kinds = character_classes(candidate), byte_kinds(candidate)
    n, share = len(candidate), lambda k: float((classes == k).mean())
    changes = max(1, len(kinds) - 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(candidate).values())
    lower, covered, i = candidate.lower(), 0, 0
    while i < n:
        word = next((k for k in range(8, 3, -1) if lower[i:i + k] in known and i + k <= n), 0)
        covered += word
        i += word or 1
    near_before, path = before.lower(), (path or "").lower()
    last = re.findall(r"[a-z_]+", near_before)[-2:]
    return [
        float(n), share(0), share(1) + share(0), share(3), share(4), entropy,
        float((classes[1:] != classes[:-1]).sum() / changes), float(-log_change[kinds[:-1], kinds[1:]].sum() / changes),
        covered / n, float(any(p in path for p in HARMLESS_PATHS)), float(path.count("/")),
        float(any(s in w for w in last for s in SECRET_WORDS)), float(any(s in near_before for s in SECRET_WORDS)),
        float(any(s in near_before or s in after.lower() for s in HARMLESS_WORDS)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(after[:1] in ("\"", "'"))]


def candidates(docs: DataFrame, path_col: str | None = "source") -> DataFrame:
    """doc_id, start, length, sha256, x (features), guess for every candidate of every whole text.

    guess is what fixed formats say: 1 for a known key prefix or an assignment to a
    secret's name, 0 for digits alone, UUIDs and what is called a commit, checksum or the
    like, otherwise null.
    """
    ship_package(docs.sparkSession)
    path = docs[path_col].cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), path.alias("path"))
    log_change, known = transitions(rows), set(dictionary(rows))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, path in zip(pdf["doc_id"], pdf["text"], pdf["path"]):
                for start, value, assigned in found(text or ""):
                    end = start + len(value)
                    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR]
                    out.append((doc_id, start, len(value), hashlib.sha256(value.encode()).hexdigest(),
                                features(value, before, after, path, log_change, known), guess(value, before, assigned)))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "sha256", "x", "guess"])
            yield frame.astype({"doc_id": "Int64", "guess": "Int32"})

    return rows.mapInPandas(find, "doc_id long, start int, length int, sha256 string, x array<double>, guess int")


def guess(value: str, before: str, assigned: bool = False) -> int | None:
    if KEY.fullmatch(value) or assigned:
        return 1
    return 0 if HARMLESS_SHAPE.fullmatch(value) or HARMLESS_BEFORE.search(before) else None


def scan(docs: DataFrame, path_col: str | None = "source", findings: DataFrame | None = None,
         max_rows: int = MAX_ROWS, trees: int = 40, depth: int = 6, seed: int = 7, cut: float = CUT) -> DataFrame:
    """doc_id, start, length, sha256, label, score, is_secret for every candidate.

    findings: doc_id, start, label (1 for a secret) as people labelled them; without
    it the fixed formats label what they can. About `max_rows` labelled findings, half
    of them of either class where there are so many, are drawn by a hash and fit the forest.
    """
    rows = candidates(docs, path_col)
    if findings is None:
        rows = rows.withColumnRenamed("guess", "label")
    else:
        given = findings.filter("doc_id is not null and label is not null").groupBy(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("int").alias("start")).agg(
            F.max("label").cast("int").alias("label"))
        rows = rows.drop("guess").join(given, ["doc_id", "start"], "left")
    rows = stage(rows.withColumn("features", array_to_vector("x")), "candidates")
    labelled = rows.filter(F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = rows.select("doc_id", "start", "length", "sha256", "label", "features")
    if len(sizes) < 2:
        score = F.lit(float(next(iter(sizes), 0.5)))
        out = out.withColumn("score", score)
    else:
        draw = F.shiftrightunsigned(F.xxhash64("doc_id", "start", "sha256"), 11) / F.lit(float(1 << 53))
        share = F.when(F.col("label") == 1, max_rows / 2 / sizes.get(1, 1)).otherwise(max_rows / 2 / sizes.get(0, 1))
        sample = labelled.filter(draw < share)
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
        model = forest.fit(sample.select("label", "features"))
        out = model.transform(out).withColumn("score", vector_to_array("probability")[1])
    return out.select("doc_id", "start", "length", "sha256", "label", "score", (F.col("score") >= cut).alias("is_secret"))
