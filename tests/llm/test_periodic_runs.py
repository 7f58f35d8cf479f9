import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests_llm_helpers import rows_of
from tickwatch.llm import periodic_runs, queries

SMALL = "/root/testdata/sf0.001"


def brute(words, min_length=6, exponent=4):
    """Runs by trying every period and every stretch of equal distance."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            run = words[start:start + length]
            smaller = any(all(run[k] == run[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(min_length, exponent * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def find(words, *args):
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([numbers[w] for w in words] + [len(numbers)], np.int64)
    return periodic_runs.find_runs(ids, *args)


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2), (4, 2), (9, 3), (1, 2)])
def test_runs_against_brute_force(bounds):
    draw = random.Random(5)
    for alphabet in ("a", "ab", "abc", "abcdefgh"):
        for n in (0, 1, 5, 6, 7, 12, 30, 60):
            for _ in range(12):
                words = [draw.choice(alphabet) for _ in range(n)]
                if draw.random() < 0.6 and n > 3:
                    a, p = draw.randrange(n), draw.randrange(1, n)
                    words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
                assert find(words, *bounds) == brute(words, *bounds), (words, bounds)


def test_nested_and_overlapping_runs():
    for text in ("a b a b a b a b a a a a a a a", "x y x y x y x y z " * 5 + "x y", "a a b " * 9 + "a a a a a a a",
                 ("p q r s t " * 7 + "u ") * 6):
        words = text.split()
        assert find(words) == brute(words) and find(words)


def test_pieces_of_ordered_sets(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 2)
    draw = random.Random(8)
    for _ in range(20):
        words = [draw.choice("ab") for _ in range(20)] * 6 + [draw.choice("ab") for _ in range(15)]
        assert find(words) == brute(words)


def test_long_periodic_texts():
    words = [f"w{i}" for i in range(20_000)] * 5
    assert find(words) == [(0, 100_000, 20_000)]
    assert find(["a"] * 200_000) == [(0, 200_000, 1)]


def test_the_same_words_in_another_text_are_no_repetition():
    out = periodic_runs._stretch(["a b c d e f g", "a b c d e f g", "b " * 6, "", "b " * 6], 6, 4)
    assert [runs for _, runs, _ in out] == [[], [], [(0, 6, 1)], [], [(0, 6, 1)]]
    assert [text for _, _, text in out] == [b"a b c d e f g"] * 2 + [b"b", b"", b"b"]


def test_query_against_brute_force(spark, small):
    out = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert set(out) == set(small)
    with_runs = 0
    for i, text in small.items():
        words = planted(i, [w.decode() for w in text.encode().split()])
        if len(words) > 1500:
            runs = find(words)
        else:
            runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        r = out[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *expected)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 5


def test_odd_rows(spark, documents, odd_rows):
    rows = odd_rows + [(20, "z " * 9), (20, "z " * 9), (21, "la" * 500_000)]
    out = rows_of(periodic_runs.periodic_runs(documents(rows)))
    assert len(out) == len(rows)
    assert [(r["n_words"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in out if r["doc_id"] == 20] == [
        (9, "z", [(0, 9, 1)])] * 2
    assert all(r["runs"] == [] for r in out if r["doc_id"] != 20)
    assert periodic_runs.periodic_runs(documents([])).count() == 0
