import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests_llm_helpers import rows_of
from tickwatch.llm import queries, tree_bpe

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return tree_bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_trees_of_any_leaf_give_the_same_tokens(ranks, library):
    draw = random.Random(11)
    alphabets = ["ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éüß", "中文字符", "\U0001f600ก", " ", "0123456789", "-=#"]
    for leaf in (1, 2, 5, 24):
        bpe = tree_bpe.TreeBpe(ranks, public_tokenizers.PATTERN, leaf)
        for alphabet in alphabets:
            for n in (1, 2, 7, 30, 90, 400):
                text = "".join(draw.choice(alphabet) for _ in range(n))
                assert bpe.encode(text) == library.encode_ordinary(text), (leaf, text)
                assert bpe.decode(bpe.encode(text)) == text.encode()


def test_a_very_long_piece(ranks, library):
    bpe = tree_bpe.TreeBpe(ranks, public_tokenizers.PATTERN)
    text = "thingableword" * 5000
    ids = bpe.encode(text)
    assert bpe.decode(ids) == text.encode() and ids == library.encode_ordinary(text)


def test_remembered_pieces_are_few_and_share_the_tokens(ranks, library):
    bpe = tree_bpe.TreeBpe(ranks, public_tokenizers.PATTERN, remembered=40)
    tokens = {id(token) for token in ranks}
    for i in range(500):
        text = f" zzyzxicon rq{i:05x}vb"
        assert bpe.encode(text) == library.encode_ordinary(text)
        assert " zzyzxicon" in bpe.known or " zzyzxicon" in bpe.known_before
        assert len(bpe.known) <= 40 and len(bpe.known_before) <= 40
        assert len(bpe.short) <= 20 and len(bpe.short_before) <= 20
    assert all(id(part) in tokens for parts in bpe.short.values() for part in parts)


def test_query_against_the_library(spark, small, library):
    out = {r["doc_id"]: r for r in queries.QUERIES["op8_tree_bpe"](spark, SMALL).collect()}
    assert len(out) == len(small)
    for i, text in small.items():
        ids = library.encode_ordinary(text)
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, documents, odd_rows, ranks):
    out = rows_of(tree_bpe.encode_decode(documents(odd_rows), ranks, public_tokenizers.PATTERN))
    assert sorted((bytes(r["decoded"]) for r in out)) == sorted((t or "").encode() for _, t in odd_rows)
    assert [r["ids"] for r in out if r["doc_id"] == 1] == [[]]
    assert tree_bpe.encode_decode(documents([]), ranks, public_tokenizers.PATTERN).count() == 0
