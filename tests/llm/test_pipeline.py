import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_line_runs import brute as brute_lines
from test_near_copies import brute_groups

from tests_llm_helpers import rows_of
from tickwatch.llm import nb_svm, queries, spaced_seeds, tree_bpe

SF = "/root/testdata/sf0.001"


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = nb_svm.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in nb_svm.score_quality(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]] >= 0.3}
    ids = sorted(texts)
    texts = {i: kept for i, (_, _, kept) in zip(ids, brute_lines([texts[i] for i in ids], 10))}
    ids = sorted(set(brute_groups([(i, texts[i]) for i in ids]).values()))
    left = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    gone = {r["doc_id"] for r in spaced_seeds.contamination(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert gone
    ranks = tree_bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i in ids:
        if i not in gone:
            found = library.encode_ordinary(texts[i])
            expected[i] = (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
    out = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == expected


def test_stages_on_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, SF)
        assert out.columns == docs.columns, name
        empty = apply(spark, documents([]), SF)
        assert empty.count() == 0, name
        if name == "near_duplicates":
            # Empty and blank texts are one group, the equal texts one; "one two three four" has no id.
            assert sorted(str(r["doc_id"]) for r in rows_of(out)) == ["1", "3", "6", "7", "8", "None"]
        elif name != "quality":
            assert out.count() == len(odd_rows), name
    assert corpus_pipeline.tokens(spark, docs, SF).count() == len(odd_rows)
