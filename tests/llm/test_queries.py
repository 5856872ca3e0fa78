"""Registered queries of the folder against their SQL, and the pipeline against plain Python."""

import os

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from agroclime.llm import bpe, near_dedup, pii
from agroclime.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    order = lambda names, rows: sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert sorted(columns) == sorted(df.columns)
    assert order(df.columns, df.collect()) == order(columns, result.fetchall())


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    sets = {i: near_dedup.shingle_set(t, 5) for i, t in kept.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    items = [(r.item_id, r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in kept.items() if not any(" ".join(w) in " ".join(t.lower().split()) for _, w in items)}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(clean) and len(got) >= 0.97 * len(clean)
    carriers = pii.sample_carriers(spark.createDataFrame([(i, clean[i]) for i in got], "doc_id long, text string"))
    for i, ids in got.items():
        spans = pii.base_spans(clean[i])
        assert ids == codec.encode_ordinary(pii.redact(clean[i], [*spans, *pii.added_spans(clean[i], spans, carriers)]))
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_bpe_query(spark):
    """All digests of the registered query, and words of any length, against the tokenizer's own library."""
    import hashlib
    import random

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def digests(text):
        ids = codec.encode_ordinary(text)
        return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    rows = QUERIES["op6_bpe_round_trip"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: digests(t) for i, t in docs.items()}

    r = random.Random(6)
    letters = ["".join(r.choice("abcdeéß日") for _ in range(n)) for n in (150, 190, 191, 192, 193, 1500, 3000)]
    texts = [*letters, " ".join(letters) + " the end", "a" * 1_000_000, "".join(r.choice("etaoin") for _ in range(1_000_000))]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").repartition(3)
    got = bpe.encode_documents(df, ranks, public_tokenizers.PATTERN, ["n_tokens", "ids_sha256", "decoded_sha256"]).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: digests(t) for i, t in enumerate(texts * 2)}
