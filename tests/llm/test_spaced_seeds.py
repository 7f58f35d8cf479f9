import random

from tests_llm_helpers import rows_of
from tickwatch.llm import queries, spaced_seeds

SMALL = "/root/testdata/sf0.001"


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_query_finds_exactly_the_shared_passages(spark, small):
    bench = {r["item_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    expected = set()
    for i, text in small.items():
        grams = set(zip(*(text.lower().split()[k:] for k in range(13))))
        expected |= {(i, j) for j, w in bench.items() if any(g in grams for g in zip(*(w[k:] for k in range(13))))}
    out = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_spaced_seeds"](spark, SMALL).collect()}
    assert expected <= out and expected
    assert {d for d, _ in out} == {d for d, _ in expected}


def test_substitutions_and_clean_documents(spark, documents):
    item = words(30, 1)
    changed = [f"x{i}" if i % 6 == 5 else w for i, w in enumerate(item)]
    half = item[:14]
    scattered = [w if i % 2 else f"y{i}" for i, w in enumerate(item)]
    rows = [(1, " ".join(words(50, 2) + changed + words(40, 3))), (2, " ".join(half + words(90, 4))),
            (3, " ".join(scattered)), (4, " ".join(words(200, 5))), (5, " ".join(item[:9] + words(50, 6))),
            (6, ", ".join(w.upper() for w in item))]
    got = rows_of(spaced_seeds.contamination(documents(rows), items(spark, [" ".join(item), "too short"])))
    out = {r["doc_id"]: r for r in got}
    assert set(out) == {1, 2, 6}
    assert out[1]["shift"] == 50 and out[1]["matched"] == 25
    assert out[6]["matched"] == 30


def test_dense_part_of_a_sparse_run_and_items_without_id(spark, documents):
    item = words(60, 7)

    def copied(pattern, seed):
        return " ".join(words(9, seed) + [w if bit == "1" else f"x{i}" for i, (w, bit) in enumerate(zip(item, pattern))])

    found = ["1" * 20 + "0011" * 4, "1" * 13 + "0011" * 3, "0011" * 4 + "1" * 30 + "0011" * 6, "1" * 10 + "0101" + "1" * 10]
    lost = ["0011" * 12, "1" * 12 + "0" * 8 + "1" * 12]
    rows = [(i, copied(p.ljust(60, "0"), i)) for i, p in enumerate(found + lost)]
    bench = spark.createDataFrame([(None, " ".join(item)), (None, " ".join(words(30, 8))), (4, " ".join(item))],
                                  "item_id long, text string")
    out = rows_of(spaced_seeds.contamination(documents(rows), bench))
    assert sorted((r["doc_id"], str(r["item_id"])) for r in out) == [
        (i, j) for i in range(len(found)) for j in ("4", "None")]

    def best(bits):
        ends = [(sum(b == "1" for b in bits[i:j]), j - i) for i in range(len(bits)) for j in range(i + 1, len(bits) + 1)
                if bits[i] == bits[j - 1] == "1" and "000" not in bits[i:j]]
        return max([e for e in ends if e[0] >= 13 and 10 * e[0] >= 8 * e[1]], default=None)

    draw = random.Random(3)
    bits = ["".join("1" if draw.random() < p else "0" for _ in range(60)) for p in (0.5, 0.7, 0.75, 0.8, 0.9) for _ in range(20)]
    rows = spark.createDataFrame([(b,) for b in bits + found], "bits string").select(
        "bits", spaced_seeds._stretch(spaced_seeds.F.col("bits"), spaced_seeds.F.lit(13), 0.8).alias("best")).collect()
    assert all((r["best"] and tuple(r["best"])) == best(r["bits"]) for r in rows)


def test_both_joins_give_the_same_rows(spark, documents):
    texts = [" ".join(words(40, s)) for s in range(4)]
    rows = [(i, f"start {t} end") for i, t in enumerate(texts * 3)]
    both = [sorted(map(str, rows_of(spaced_seeds.contamination(documents(rows), items(spark, texts), broadcast_seeds=n))))
            for n in (0, 10**6)]
    assert both[0] == both[1] and len(both[0]) == 12


def test_odd_rows(spark, documents, odd_rows):
    bench = spark.createDataFrame([(1, None), (None, "one two three"), (2, ""), (3, "word0x0 word1x1 word2x2 word3x3 "
                                   "word4x4 word5x5 word6x6 word7x7")], "item_id long, text string")
    out = rows_of(spaced_seeds.contamination(documents(odd_rows), bench))
    assert [(r["doc_id"], r["item_id"], r["matched"]) for r in out] == [(6, 3, 8)]
    assert spaced_seeds.contamination(documents([]), bench).count() == 0
    assert spaced_seeds.contamination(documents(odd_rows), bench.limit(0)).count() == 0


def test_only_dataframe_functions(spark, documents, odd_rows):
    plan = spaced_seeds.contamination(documents(odd_rows), items(spark, ["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
