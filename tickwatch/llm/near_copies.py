"""Near copies by word shingles: Golay keys of a wide SimHash as candidates, exact Jaccard as the rule.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more (lower-cased words; fewer than five words are one shingle,
texts without words are all alike). Groups are what links connect, a chain of them too.

Candidates come from a SimHash of 115 bits over a text's distinct words, each with
the weight 1 + floor(log2(count)): one changed word moves few of them, while it changes
five shingles. The bits are five segments of 23, each decoded to the nearest
codewords of the binary Golay code as in `golay`. Two texts that differ by at most one
bit in two of the segments share a key of these two, on which all texts are dealt into
buckets. A bucket hands on no pairs of all its members: the one closest to the bucket's
majority of bits is its centre and is paired with each other one (in small buckets
all are paired). Pairs of at most `FAR` differing bits are compared shingle by shingle.

What these buckets miss is found exactly: of two sets that similar, the lowest hashes of
each, a fifth of them and one, have a hash in common (a prefix filter). Texts that share
such a hash and are not yet in one group are compared too, so no link between groups is lost.

Only distinct texts take part. Buckets and centres with very many members are cut
into pieces of bounded size, so that no task holds a group. Null texts count as empty,
null ids as unknown; further columns are passed on; an empty table stays empty; long
texts are compared whole.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch.llm.common import id_key, slices
from tickwatch.llm.components import components
from tickwatch.llm.golay import codewords
from tickwatch.session import ship_package, stage, staged

SHINGLE, SIMILARITY = 5, 0.8
SEGMENTS, BITS = 5, 23
PAIRS = tuple(combinations(range(SEGMENTS), 2))
# More differing bits than this of 115 are no near copy: at a similarity of 0.8 about 6 differ, 12 in one of a hundred.
FAR = 20
# Members of a bucket, and of a centre, that are handled together.
PIECE = 2_048
# Of one in so many texts the shingles are counted; those in so many groups of the sample are frequent, up to a number.
SAMPLED, OFTEN, FREQUENT = 8, 3, 100_000
# Buckets of so many members at most pair all of them.
SMALL = 6


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def wide_fingerprint(text: bytes) -> tuple[int, int]:
    """The 115 bits as two numbers, the lower 64 and the others; both zero without words."""
    counts = Counter(_words(text))
    if not counts:
        return 0, 0
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, counts)), dtype=np.uint8).reshape(len(counts), 16)
    weights = np.fromiter((n.bit_length() for n in counts.values()), np.int64, len(counts))
    ones = np.zeros(128, np.int64)
    for at in range(0, len(raw), 4096):
        ones += weights[at:at + 4096] @ np.unpackbits(raw[at:at + 4096], axis=1, bitorder="little").astype(np.int64)
    bits = 2 * ones > weights.sum()
    bits[SEGMENTS * BITS:] = False
    low, high = np.packbits(bits, bitorder="little").view("<u8")
    return int(low), int(high)


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    raw = np.stack([low, high], 1).astype(np.int64).view(np.uint8)
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :SEGMENTS * BITS]


def bucket_keys(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for every two segments the nearest codeword of one with each near one of the other."""
    powers = 1 << np.arange(BITS, dtype=np.int64)
    segments = _bits(low, high).reshape(len(low), SEGMENTS, BITS).astype(np.int64) @ powers
    lists = [codewords(segments[:, k]) for k in range(SEGMENTS)]
    rows, keys = [], []
    for which, (i, j) in enumerate(PAIRS):
        for first, second in ((lists[i][:, :1], lists[j]), (lists[i][:, 1:], lists[j][:, :1])):
            key = np.where((first >= 0) & (second >= 0), which << 24 | first << 12 | second, -1)
            row, column = np.nonzero(key >= 0)
            rows.append(row)
            keys.append(key[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _pass_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for start, end in slices(column):
            part = batch.slice(start, end - start)
            found = [wide_fingerprint(x.encode("utf-8", "surrogatepass")) for x in part.column("text").to_pylist()]
            halves = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("n"), part.column("doc_id"), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["n", "doc_id", "low", "high"])


def _pass_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        # A row has about a hundred keys.
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            rows, keys = bucket_keys(low, high)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int32)), *[batch.column(c).take(at) for c in ("v", "low", "high")]], ["key", "v", "low", "high"])


def centre_pairs(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(index of the centre, members, centres): the pairs of one bucket at `FAR` bits or fewer."""
    bits = _bits(low, high)
    majority = 2 * bits.sum(0, dtype=np.int64) > len(v)
    far = (bits != majority).sum(1)
    centre = int(np.lexsort((v, far))[0])
    if len(v) <= SMALL:
        a, b = np.triu_indices(len(v), 1)
    else:
        a = np.flatnonzero(np.arange(len(v)) != centre)
        b = np.full(len(a), centre)
    near = ((bits[a] != bits[b]).sum(1) <= FAR) & (v[a] != v[b])
    return centre, v[a[near]], v[b[near]]


def _pass_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the pairs of each bucket, a piece at a time; centres of its pieces are paired in turn."""
    key, held, size, last = None, [], 0, None

    def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal held, size, last
        v, low, high = (np.concatenate(c) for c in zip(*held))
        if last is not None:
            v, low, high = (np.concatenate([[x], c]) for x, c in zip(last, (v, low, high)))
        if len(v) > 1:
            centre, a, b = centre_pairs(v, low, high)
            last = v[centre], low[centre], high[centre]
            yield a, b
        held, size = [], 0

    for batch in batches:
        out = []
        keys = batch.column("key").to_numpy()
        columns = [batch.column(c).to_numpy() for c in ("v", "low", "high")]
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        # Most buckets have one member; only at the ends of a batch they may go on.
        crowded = ends - starts > 1
        crowded[[0, -1]] = True
        for start, end in zip(starts[crowded].tolist(), ends[crowded].tolist()):
            if keys[start] != key:
                if held and (size > 1 or last is not None):
                    out += close()
                key, held, size, last = keys[start], [], 0, None
            for at in range(start, end, PIECE):
                stop = min(at + PIECE, end)
                held.append([c[at:stop] for c in columns])
                size += stop - at
                if size >= PIECE:
                    out += close()
        if out:
            a, b = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    if held and (size > 1 or last is not None):
        for a, b in close():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; empty without words."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def _pass_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            grams = [shingles(unpack.decompress(x.as_py())) for x in part.column("text")]
            rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), part.column("root").take(pa.array(rows))], ["h", "root"])


def _pass_prefixes(frequent: np.ndarray):
    """One row for each hash of a text's prefix, with the number of all its hashes and the place among them.

    The order is that of the hashes, with the `frequent` ones (sorted) behind all others.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        nothing = np.zeros(1, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams = []
                for x in part.column("text"):
                    g = shingles(unpack.decompress(x.as_py()))
                    if len(frequent):
                        last = frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] == g
                        g = np.concatenate([g[~last], g[last]])
                    grams.append(g)
                sizes = np.array([len(g) for g in grams], np.int32)
                # Texts without words share one hash that stands for nothing.
                taken = [g[:len(g) - (4 * len(g) + 4) // 5 + 1] if len(g) else nothing for g in grams]
                counts = np.array([len(g) for g in taken])
                rows = np.repeat(np.arange(len(grams)), counts)
                places = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(taken).view(np.int64)), *[part.column(c).take(pa.array(rows)) for c in ("v", "root")],
                     pa.array(sizes[rows]), pa.array(places.astype(np.int32))], ["h", "v", "root", "size", "place"])

    return emit


def sketch(grams: np.ndarray) -> bytes:
    """The parity of the number of hashes that fall on each of 2**k bits, as many bits as hashes or more."""
    size = max(64, 1 << (len(grams) - 1).bit_length()) if len(grams) else 64
    return np.packbits(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """So many hashes at least are in only one of two sets: each turns one bit of the difference of their sketches."""
    x, y = (a, b) if len(a) >= len(b) else (b, a)
    wide, bits, least = int.from_bytes(x, "little"), 8 * len(x), 8 * len(y)
    while bits > least:
        bits //= 2
        wide = wide >> bits ^ wide & (1 << bits) - 1
    return (wide ^ int.from_bytes(y, "little")).bit_count()


def _pass_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            grams = [shingles(unpack.decompress(x.as_py())) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("v"), pa.array([len(g) for g in grams], pa.int32()), pa.array(map(sketch, grams), pa.binary())],
                ["v", "size", "sketch"])


def _pass_likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that their sketches leave possible: of similar sets at most a ninth of all hashes are in one of them only."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("size", "own", "other"))
        keep = [9 * apart(a, b) <= size for size, a, b in zip(*columns)]
        yield batch.select(["member", "centre"]).filter(pa.array(keep, pa.bool_()))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _pass_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        column = batch.column("text")
        for start, end in slices(column):
            part = batch.slice(start, end - start)
            packed = [pack.compress(x.encode("utf-8", "surrogatepass")) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("n"), part.column("id"), pa.array(packed, pa.binary())], ["n", "id", "text"])


def _pass_verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, piece), the centre's own text first: members similar enough."""
    unpack = zstandard.ZstdDecompressor()
    now, own = None, None
    for batch in batches:
        found = []
        for centre, piece, member, text in zip(*(batch.column(c) for c in ("centre", "piece", "member", "text"))):
            key = centre.as_py(), piece.as_py()
            grams = shingles(unpack.decompress(text.as_py()))
            if not member.is_valid:
                now, own = key, grams
            elif now == key and jaccard(own, grams) >= SIMILARITY:
                found.append((key[0], member.as_py()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """member, centre: distinct pairs of nodes (v, low, high) that meet in a bucket."""
    dealt = nodes.select("v", "low", "high").mapInArrow(_pass_buckets, "key int, v long, low long, high long")
    pairs = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_pass_centres, "a long, b long")
    return pairs.select(F.col("a").alias("member"), F.col("b").alias("centre")).distinct()


def _texts_of(nodes: DataFrame, packed: DataFrame, *more: str) -> DataFrame:
    """v, text and further columns of nodes (v, n, first). By text and id: of many copies of a text only the first one's row is met."""
    wanted = nodes.select("v", "n", id_key("first").alias("id"), *more)
    return packed.join(wanted, ["n", "id"]).dropDuplicates(["v"]).select("v", *more, "text")


def frequent_shingles(labelled: DataFrame, packed: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many groups have, at most `FREQUENT`, as a sample of the texts shows them.

    They only give the order of the hashes: with any such list no pair is lost, with a good one few are compared.
    """
    part = labelled.filter(F.pmod(F.xxhash64("n"), F.lit(SAMPLED)) == 0)
    rows = _texts_of(part, packed, "root").mapInArrow(_pass_shingles, "h long, root long")
    many = rows.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(f"c >= {OFTEN}")
    with staged(many.orderBy(F.desc("c"), "h").limit(FREQUENT).select("h"), "frequent") as most:
        return np.sort(most.toArrow().column("h").to_numpy().view(np.uint64))


def missed_pairs(labelled: DataFrame, packed: DataFrame) -> DataFrame:
    """member, centre: every two texts of different groups that may be similar; labelled (v, n, first, root)."""
    rows = _texts_of(labelled, packed, "root").mapInArrow(
        _pass_prefixes(frequent_shingles(labelled, packed)), "h long, v long, root long, size int, place int")
    same = Window.partitionBy("h")
    met = stage(rows.withColumns({"lo": F.min("root").over(same), "hi": F.max("root").over(same)})
                .filter("lo < hi").drop("lo", "hi"), "shared")
    x, y = (met.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("v", "root", "size", "place")]) for k in "xy")
    # Sets of such sizes can be similar, and hashes before the first common one are in one of them only.
    pairs = x.join(y, "h").filter(
        "root_x < root_y and 4 * greatest(size_x, size_y) <= 5 * least(size_x, size_y)"
        " and 9 * (place_x + place_y) <= size_x + size_y")
    return pairs.select(F.col("v_x").alias("member"), F.col("v_y").alias("centre")).distinct()


def likely_pairs(pairs: DataFrame, nodes: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (member, centre) whose sketches do not rule a link out; texts stay where they are."""
    asked = pairs.select(F.explode(F.array("member", "centre")).alias("v")).distinct()
    marks = stage(_texts_of(nodes.join(asked, "v"), packed).mapInArrow(
        _pass_sketches, "v long, size int, sketch binary"), "sketches")
    own = marks.select(F.col("v").alias("member"), F.col("size").alias("size_own"), F.col("sketch").alias("own"))
    other = marks.select(F.col("v").alias("centre"), F.col("size").alias("size_other"), F.col("sketch").alias("other"))
    both = pairs.join(own, "member").join(other, "centre").select(
        "member", "centre", (F.col("size_own") + F.col("size_other")).alias("size"), "own", "other")
    return both.mapInArrow(_pass_likely, "member long, centre long")


def similar_pairs(nodes: DataFrame, packed: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """a, b: verified links among pairs, or among candidate pairs; nodes (v, n, first, low, high), packed (n, id, text)."""
    pairs = stage(candidate_pairs(nodes) if pairs is None else pairs, "candidates")
    many = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    placed = pairs.join(many, "centre").withColumn("piece", F.pmod(F.xxhash64("member"), F.col("pieces")))
    asked = pairs.select(F.explode(F.array("member", "centre")).alias("v")).distinct()
    texts = stage(_texts_of(nodes.join(asked, "v"), packed), "candidate-texts")
    members = placed.join(texts, placed["member"] == texts["v"]).select("centre", "piece", "member", "text")
    centres = many.join(texts, many["centre"] == texts["v"]).select(
        "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"),
        F.lit(None).cast("long").alias("member"), "text")
    met = members.unionByName(centres).repartition("centre", "piece").sortWithinPartitions(
        "centre", "piece", F.col("member").asc_nulls_first())
    return met.mapInArrow(_pass_verified, "a long, b long")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, nodes["v"] == roots["node"], "left").withColumn("root", F.coalesce("root", "v")).drop("node")


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """n, first, root, component_id per distinct text of docs: md5 of the text, its smallest id, its group, the group's smallest id."""
    ship_package(docs.sparkSession)
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs).alias("n"),
                        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    marks = named.mapInArrow(_pass_fingerprints, "n binary, doc_id long, low long, high long")
    nodes = stage(marks.groupBy("n", "low", "high").agg(F.min("doc_id").alias("first")).withColumn(
        "v", F.monotonically_increasing_id()), "texts")
    packed = named.select("n", id_key("doc_id").alias("id"), "text").mapInArrow(_pass_packed, "n binary, id long, text binary")
    roots = components(similar_pairs(nodes, packed))
    grouped = stage(_rooted(nodes, roots).select("v", "n", "first", "root"), "groups")
    known = grouped.filter("root < v").select(F.col("root").alias("a"), F.col("v").alias("b"))
    pairs = stage(missed_pairs(grouped, packed), "missed")
    missed = similar_pairs(nodes, packed, likely_pairs(pairs, nodes, packed))
    labelled = _rooted(nodes, components(known.unionByName(missed)))
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(ids, "root").select("n", "first", "root", "component_id")


def text_key(docs: DataFrame) -> Column:
    return F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of every group, with the columns of docs.

    Of repeated rows of that id one stays; where no id is known, one row of the group.
    """
    groups = near_copy_groups(docs).filter(F.col("first").eqNullSafe(F.col("component_id")))
    kept = stage(groups.groupBy("root", id_key("first").alias("id")).agg(F.min("n").alias("n")).select("n", "id"), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_key(docs).alias("n"),
                       id_key(docs["doc_id"].cast("long")).alias("id"))
    order = Window.partitionBy("n", "id").orderBy(F.lit(0))
    return rows.join(kept, ["n", "id"]).withColumn("i", F.row_number().over(order)).filter("i = 1").select("row.*")
