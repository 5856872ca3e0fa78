"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from agroclime.llm import bpe, chat, decontaminate, langid, near_dedup, nndescent, pii, quality, repeats, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, x string, key long, score double"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "and", "tion", "ing", "haus", "über", "été", "casa", "ñandú"]) + str(r.randint(0, 99)) for _ in range(n))


TEXTS = {
    1: None, 2: "", 3: " \n\t ", 4: "one", 5: words(1, 60), 6: words(1, 60), 7: words(2, 9000), 8: "12 34 !!", 9: "a" * 5000,
    10: "mail me at x.y@example.org or +1 (614) 555-8001, 10.0.0.1.", 11: "日本語のテキスト " * 20, 12: "  x ퟿𝒳😀" * 3,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", None, None, 7, "x", 3, 0.5) for i, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[4], (None, "no id here", None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, none):
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, shingle=2).collect() if r.id}
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True)
    assert got[5][1:] == (5, True) and got[6][1:] == (5, False)
    assert got[7][0] == len(near_dedup.shingle_set(TEXTS[7], 2))
    assert near_dedup.near_duplicates(none).count() == 0


def test_bpe_equals_tiktoken(docs, none):
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rows = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, ["ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = TEXTS[r.doc_id] or "" if r.doc_id else "no id here"
        ids = codec.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode(), r.doc_id
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN, ["ids"]).count() == 0


def test_bpe_blocks_stay_where_they_are(spark):
    """The stored blocks are not moved again when their codes come back; no table name is left behind."""
    texts = [words(seed, 300) for seed in range(24)] + [None, "", "the the", "日本語 " * 50]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id long, text string").repartition(7)
    tables = {t.name for t in spark.catalog.listTables()}
    got = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, ["ids"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and "Bucketed: true" in plan
    assert {t.name for t in spark.catalog.listTables()} == tables
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=key) == sorted(((r.doc_id, codec.encode_ordinary(r.text or "")) for r in df.collect()), key=key)


def test_repeats(docs, none):
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs, texts=True).collect() if r.doc_id}
    assert rows[1].n_bytes == 0 and rows[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[6].n_removed == rows[6].n_bytes == len(TEXTS[6].encode()) and rows[6].n_spans == 1
    assert rows[5].n_removed == 0 and rows[9].n_removed == 0
    assert repeats.remove_repeats(none).count() == 0


def test_pii(docs, none):
    rows = {r.doc_id: r for r in pii.detect(docs, redacted=True).collect() if r.doc_id}
    assert (rows[10].n_email, rows[10].n_ip, rows[10].n_card, rows[10].n_phone) == (1, 1, 0, 1)
    assert rows[10].redacted == "mail me at [EMAIL] or [PHONE], [IP]."
    assert rows[1].redacted is None and rows[1].base == "" and rows[2].spans == ""
    assert pii.detect(none).count() == 0
    again = {r.doc_id: r for r in pii.redact_documents(docs, "text", "n_chars").collect() if r.doc_id}
    assert again[10].text == rows[10].redacted and again[10].n_chars == len(again[10].text) and again[10].x == "x"


def test_language(docs, none):
    model = langid.fit(docs, "doc_id", "text", "lang")
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect() if r.doc_id}
    assert all(rows[i].lang_pred == "und" for i in (1, 2, 3, 8)) and all(rows[i].lang_pred != "und" for i in (4, 5, 7, 11, 12))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.fit(none, "doc_id", "text", "lang") is None and langid.predict(none, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = {r.doc_id for r in langid.keep_identified(docs, model).collect()}
    assert kept == {4, 5, 6, 7, 9, 10, 11, 12}  # "no id here" is like nothing learned


def test_language_is_learned_from_long_documents(spark, docs):
    long = [(i, " 12 " * 6000 + " ".join(f"{'mi' if i % 2 else 'zu'}{(i * n) % 97}ka" for n in range(6000)), "aa" if i % 2 else "bb") for i in range(6)]
    table = spark.createDataFrame([*long, (9, "the short one", "en")], "doc_id long, text string, lang string")
    model = langid.fit(table, "doc_id", "text", "lang")
    assert model.labels == ["aa", "bb", "en"]
    assert {r.doc_id: r.lang_pred for r in langid.predict(table, model).collect()} == {r.doc_id: r.lang for r in table.collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in langid.keep_identified(unlabelled, langid.fit(unlabelled, "doc_id", "text", "lang")).collect()}
    assert kept == {None, 4, 5, 6, 7, 9, 10, 11, 12}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, None), (None, 1), (7, 0)], "doc_id long, quality int")
    rows = quality.score_documents(docs, labels, lambda i: F.lit(True)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score_documents(none, labels, lambda i: F.lit(True)).count() == 0
    assert {r.score for r in quality.score_documents(docs, labels.limit(0), lambda i: F.lit(True)).collect()} == {0.5}


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, words(1, 40), "a"), (2, None, "b"), (3, "", "c"), (4, words(9, 30), "d"), (1, words(1, 40), "a")], "item_id long, text string, x string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(5, 1): 1.0, (6, 1): 1.0}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "u\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "long é" * 200_000), (None, "u", "same"), (3, "u", None)],
        "page_id long, url string, html string",
    ).withColumn("sha1", F.lit("clash"))
    got = sorted(warc.read_records(warc.archive(pages)).collect(), key=str)
    by = {r.page_id: r for r in got}
    assert len(got) == 7
    assert by[1].record_type == "revisit" and by[1].refers_to == 2 and by[1].payload_bytes == 4
    assert by[2].record_type == "response" and by[3].record_type == "revisit" and by[3].refers_to == 4
    assert by[5].payload_bytes == 1_400_000 and by[None].record_type == "response"
    assert warc.read_records(warc.archive(pages.limit(0))).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"),
            (4, 0, None, None), (None, 0, "user", "z<|end|>"), (5, None, "user", "q"), (5, 1, "user", "r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.chat_format(turns).collect()}
    assert set(got) == {1, 4, None, 5}
    assert got[1] == (2, "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n") and got[4] == (1, "<|user|>\n<|end|>\n")
    assert got[None][1] == "<|user|>\nz< |end|><|end|>\n" and got[5][0] == 2
    assert chat.chat_format(turns.limit(0)).count() == 0


def test_nearest(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [3.0, 0.0]), (9, [1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("d", F.lit(1))
    got = [tuple(r) for r in nndescent.nearest(vectors, lambda i: i == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 2**0.5), (0, 3, 8, 2.0)]
    assert nndescent.nearest(vectors.limit(0), lambda i: i == 0).count() == 0


def test_base_spans_like_plain_patterns():
    r = random.Random(3)
    parts = ["a@b.c", "x@@y.z", "1.2.3.4", "999.1.1.1", "4000 0000 0000 0002", "4111-1111-1111-1111", "+1 (614) 555-8001", "++12 3", "12345678901234567890", " ", ".", "-", "(", "é", "abc", "5.6.7.8.9", "+", "@"]
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice(["", " ", ". ", "x"]) for _ in range(r.randint(1, 8)))
        want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == sorted(want), text


def test_near_duplicates_of_repeated_rows(spark):
    """A document that stands twice gives one row; one of two texts links what both are like."""
    rows = [(5, words(1, 30)), (5, words(1, 30)), (6, words(1, 30)), (7, words(2, 30)), (8, words(3, 30)), (8, words(2, 30)), (4, words(3, 30)), (9, words(9, 30)), (9, None), (None, "a b"), (None, "a b")]
    for shuffle in (1, 4):
        got = sorted(map(repr, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(shuffle), shingle=2).select("id", "component_id", "kept").collect()))
        want = [(4, 4, True), (5, 5, True), (6, 5, False), (7, 4, False), (8, 4, False), (9, 9, True), (None, None, True), (None, None, True)]
        assert got == sorted(f"Row(id={i}, component_id={c}, kept={k})" for i, c, k in want)


def test_near_duplicates_of_texts_with_like_polynomials(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2**64 for every odd base."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    b = "".join("ba"[bin(i).count("1") & 1] for i in range(1024))
    rows = [(1, a), (2, b), (3, f" {a}\n"), (4, f"x {a} y"), (5, f"x {b} y")]
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_digests_are_of_the_word_sequence():
    import pyarrow as pa

    from agroclime.llm import textvec

    texts = ["", None, " ", "a", " a", "a ", "A\t\n b", "a b", "ab", "a", "é  É", " x y z", "q", "", "w w "]
    column = pa.array(texts, pa.string())
    got = textvec.normalized_digests(textvec.words_of(column), textvec.text_bytes(column)[1])
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    assert got == [hashlib.sha256(" ".join(w for w in re.split("[\x20\x09-\x0d]+", lower(t)) if w).encode()).digest() for t in texts]


def test_nearest_of_repeated_rows(spark):
    """Equal rows are one; of different vectors under one id the first counts."""
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    extra = [rows[2], rows[2], rows[0], (7, [1e3] * 4)]
    table = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, nndescent.nearest(table(rows), lambda i: i % 10 == 0).collect()))
    assert sorted(map(tuple, nndescent.nearest(table(rows + extra), lambda i: i % 10 == 0).collect())) == plain
