"""Each operator against brute force, an exact round trip or held-out accuracy, on the small tables."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agroclime.llm import bpe, components, decontaminate, langid, near_dedup, nndescent, pii, queries, quality, repeats, warc
from agroclime.llm import textvec as tv

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def closure(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == closure({x for pair in links for x in pair}, links)


def near_copies(seed):
    """A group around one text whose members are partly linked, partly just too far apart, and unrelated texts."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 500)}" for _ in range(80)]
    rows = []
    for i in range(120):
        text = list(base) if i % 3 else [f"v{r.randint(0, 500)}" for _ in range(80)]
        for _ in range(r.randint(0, 9)):
            text[r.randrange(len(text))] = f"new{r.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle):
    rows = near_copies(shingle)
    sets = {i: near_dedup.shingle_set(t, shingle) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle).collect()
    assert {r.id: r.component_id for r in got} == closure(sets, links)
    assert {r.id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_word_and_shingle_hashes_follow_the_words():
    texts = ["A bc  a\tbc\n", "", None, "bc", "a BC", "x\x0by é ü"]
    words = tv.words_of(pa.array(texts, pa.string()))
    named = [bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends, strict=True)]
    assert named == [b"a", b"bc", b"a", b"bc", b"bc", b"a", b"bc", b"x", b"y", "é".encode(), "ü".encode()]
    assert list(np.diff(words.first)) == [4, 0, 0, 1, 2, 4]
    assert all((h == k) == (a == b) for (a, h), (b, k) in itertools.combinations(zip(named, words.hashes, strict=True), 2))
    hashes, begin = tv.distinct_per_text(*tv.shingle_hashes(words, 2))
    assert list(np.diff(begin)) == [2, 0, 0, 1, 1, 3]


def brute_repeats(texts, window):
    first = {}
    for i, t in sorted(texts.items()):
        for s in range(len(t) - window + 1):
            first.setdefault(t[s : s + window], i)
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] < i:
                gone[s : s + window] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[i] = (len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_windows(spark, docs):
    r = random.Random(4)
    made = {10_000 + i: "".join(r.choice(["ab", "aaaa", "xyz " * 15, "é", "0123456789" * 6]) for _ in range(r.randint(0, 12))) for i in range(150)}
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()] + list(made.items())
    want = brute_repeats({i: (t or "").encode() for i, t in rows}, 50)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want
    assert sum(w[1] for w in want.values()) > 10_000


def brute_contamination(texts, items, least):
    found = {}
    items = {i: ws for i, ws in items.items() if ws}
    for d, words in texts.items():
        have = {g for g in zip(*(words[k:] for k in range(5)), strict=False)}
        for i, ws in items.items():
            want = decontaminate.weighted(ws, 5)
            if len(ws) >= 5 and not have & set(want):
                continue
            best = max((decontaminate.similarity(decontaminate.weighted(words[s : s + len(ws)], 5), want) for s in range(max(1, len(words) - len(ws) + 1))), default=0)
            if best >= least:
                found[d, i] = best
    return found


def test_contamination_finds_what_brute_force_finds(spark, docs):
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    r = random.Random(6)
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    for n, (_, text) in enumerate(items):
        words = text.split()
        edited = words[1:] if n % 2 else [*words[:-2], "qq", *words[-1:]]
        rows.append((50_000 + n, " ".join([*(f"p{r.randint(0, 99)}" for _ in range(40)), *edited, *(f"q{r.randint(0, 99)}" for _ in range(40))])))
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    want = brute_contamination({d: split(t) for d, t in rows}, {i: split(t) for i, t in items}, 0.8)
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    have = {(x.doc_id, x.item_id): x.score for x in got}
    assert set(have) <= set(want)
    assert all(abs(have[k] - want[k]) < 0.1 for k in have)
    assert len(have) >= 0.98 * len(want) and len(want) > 20


def test_contamination_finds_items_edited_at_both_ends(spark):
    r = random.Random(11)
    items = [(i, [f"w{r.randint(0, 10**9)}" for _ in range(5 + i)]) for i in range(140)]
    rows = []
    for i, ws in items:
        middle = [*ws[: len(ws) // 2], "zz", *ws[len(ws) // 2 + 1 :]]
        half = len(ws) // 2
        for kind in (["(" + ws[0], *ws[1:-1], ws[-1] + ")"], ["x", *middle[1:-1], "y"], ws[1:-1], [ws[0], "u", *ws[1:-2], ws[-1]], [*ws[half:], *ws[:half]]):
            rows.append((len(rows), [*(f"p{r.randint(0, 99)}" for _ in range(70)), *kind, *(f"q{r.randint(0, 99)}" for _ in range(70))]))
    want = brute_contamination(dict(rows), dict(items), 0.8)
    docs = spark.createDataFrame([(d, " ".join(ws)) for d, ws in rows], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.score for x in got} == want
    assert len(want) > 400


def test_hamming_index_finds_all_in_the_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.zeros(400, np.uint64)
    for i in range(400):
        for b in r.choice(64, r.integers(0, 12), replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    asked = prints[r.integers(0, 60, 400)] ^ flips
    q, k = decontaminate.HammingIndex(prints).search(asked)
    want = {(i, j) for i in range(400) for j in range(60) if int(asked[i] ^ prints[j]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(q.tolist(), k.tolist(), strict=True)) == want


def test_simhash_of_a_run_is_that_of_its_words():
    h = np.random.default_rng(1).integers(0, 2**63, 40, dtype=np.uint64)
    got = decontaminate.simhashes(h, 7)
    for s in range(34):
        for b in range(64):
            ones = sum((int(x) >> b) & 1 for x in h[s : s + 7])
            assert (int(got[s]) >> b) & 1 == (ones > 3)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    scores, transitions, first = r.normal(size=(9, 3)), r.normal(size=(3, 3)), np.array([0, 4, 4, 9])
    got = langid.marginals(scores, first, transitions)
    for a, b in ((0, 4), (4, 9)):
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(scores[range(a, b), path].sum() + sum(transitions[x, y] for x, y in itertools.pairwise(path)))
            w *= np.exp(transitions[:, path[0]]).sum()
            for t, y in enumerate(path):
                total[t, y] += w
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True))


def test_marginals_of_long_chains_do_not_depend_on_blocks(monkeypatch):
    r = np.random.default_rng(0)
    scores, transitions, first = 3 * r.normal(size=(5000, 4)), r.normal(size=(4, 4)), np.array([0, 3000, 3001, 5000])
    whole, pairs = langid.marginals(scores, first, transitions, pairs=True)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    small, same = langid.marginals(scores, first, transitions, pairs=True)
    assert np.allclose(whole, small) and np.allclose(pairs, same) and np.isclose(pairs.sum(), 5000)


def test_language_accuracy_on_held_out_documents(spark, docs):
    got = queries.op3_language_crf(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 20 and np.mean([x.lang == x.lang_pred for x in got]) > 0.95


def test_code_switched_words_get_their_own_language(docs):
    rows = docs.filter("lang is not null and length(text) < 20000").select("text", "lang").collect()
    model = langid.train([x.text for x in rows], [x.lang for x in rows])
    by = defaultdict(list)
    for x in rows:
        by[x.lang] += [w for w in x.text.split() if w.isalpha() and len(w) > 3]
    text = [*by["en"][:15], *by["de"][:15], *by["fr"][:15]]
    _, gamma, _ = langid.label_words(model, pa.array([" ".join(text)]))
    said = [model.labels[y] for y in gamma.argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(said, ["en"] * 15 + ["de"] * 15 + ["fr"] * 15, strict=True)]) > 0.85


def test_quality_ranks_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_pu(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and quality is not null").collect()
    good, bad = [x.score for x in got if x.quality == 1], [x.score for x in got if x.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert np.mean([x.predicted == x.quality for x in got]) > 0.9


def test_positive_unlabelled_learning_needs_no_negatives():
    r = np.random.default_rng(3)
    pos, neg = r.normal(1.5, 1, (3000, 4)), r.normal(-1.5, 1, (1200, 4))
    other = np.vstack((r.normal(1.5, 1, (2800, 4)), neg))
    net, prior = quality.train(pos, other)
    assert abs(prior - 0.7) < 0.1
    assert net.predict(r.normal(1.5, 1, (500, 4))).mean() > 0.8 and net.predict(neg).mean() < 0.2


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    got = defaultdict(set)
    for r in queries.op1_nn_descent(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
        assert np.isclose(r.score, np.linalg.norm(x[ids == r.query_id][0] - x[ids == r.vec_id][0]))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.linalg.norm(x - x[ids == q][0], axis=1)
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(got[q] & set(ids[order]))
        total += 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("offset, jitter", [(0.0, 3e-6), (3e5, 1e-2)])
def test_graph_links_near_copies_by_their_differences(spark, offset, jitter):
    r = np.random.default_rng(8)
    x = r.normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:400] = x[0] + jitter * r.normal(size=(400, 8))
    x += offset
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    links = defaultdict(set)
    for e in nndescent.build_graph(nodes, 8).collect():
        links[e.id].add(e.near)
    hits = 0
    for i in range(400):
        d = ((x - x[i]) ** 2).sum(axis=1)
        hits += len(links[i] & set([j for j in np.argsort(d) if j != i][:20]))
    assert hits / (400 * 20) >= 0.95


def test_warc_export_is_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 700_000), (2, "http://b", "y")], "page_id long, url string, html string")
    warc.export_files(warc.write_records(pages), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").iterdir()))
    seen = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(next(h for h in head.split(b"\r\n") if h.startswith(b"Content-Length")).split()[1])
        seen.append((head.split(b"\r\n")[0], rest[:size].partition(b"\r\n\r\n")[2]))
        assert rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
    assert sorted(seen) == [(b"WARC/1.1", b"x" * 700_000), (b"WARC/1.1", b"y")]


def test_damaged_archives_are_noticed(spark):
    pages = spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string")
    chunks = warc.write_records(pages).withColumn("data", F.when(F.col("chunk_no") == 1, F.lit(b"hullo")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_records(chunks).collect()


def test_boosting_selects_on_layouts_it_has_not_seen(docs):
    """Precision and recall of every kind on the test layouts, planted into real text; look-alikes stay."""
    carriers = pii.sample_carriers(docs)
    assert len(carriers) > 100
    trees, cuts = pii.model(carriers)
    x, y, kinds = pii.training_examples("test", 99, 60, carriers)
    scores = trees.predict(x)
    for kind, (name, recall) in enumerate(zip(pii.KINDS, (0.95, 0.6, 0.95, 0.95, 0.95), strict=True)):
        said, real = scores[kinds == kind] >= cuts[kind], y[kinds == kind] == 1
        assert said[real].mean() >= recall and real[said].mean() >= 0.95, name


def test_every_document_counts_in_training(spark, docs):
    """Contexts come from all documents, repeated ones each, and give the features that the text itself gives."""
    table = docs.filter("text is not null").select("text").union(docs.filter("text is not null").select("text"))
    more = table.union(spark.range(500).selectExpr("concat('on page ', id, ' the server of ', id, ' gave an address as') as text"))
    found = pii.contexts(more.repartition(7))
    assert {room: sum(n for r, _, n in found if r == room) for room in pii.ROOMS} == dict.fromkeys(pii.ROOMS, more.count())
    assert found == pii.contexts(more.coalesce(1))
    texts = ["", "call the server ", "at the ", "latent heat of the mobile host = ", "my telephone card is in order, e-mail me: ", "the quick brown fox has a very long way to go home ", "no \"", "x" * 50 + " "]
    for text in texts:
        for kind, _, layout, hints in pii._layouts("train"):
            for hint in hints:
                lead, made = pii._lead(hint), pii._Maker(3)
                span = made(layout)
                whole = text + lead + span + made.r.choice(pii._AFTER)
                if not text or text.endswith(" "):
                    read = pii.readings(text[-pii.REACH:])[pii.ROOMS.index(pii.REACH - len(lead))]
                    assert pii.planted(pii._Maker(3), kind, layout, hint, read) == pii.features(whole, kind, len(text + lead), len(text + lead + span)), (text, hint)


def test_added_spans_on_real_documents(spark):
    """The trees add spans on the test tables, and every added secret is an assigned token; plain long numbers stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    rows = pii.detect(table).collect()
    added = [(r.doc_id, s) for r in rows for s in r.spans.split(",") if s and s not in r.base.split(",")]
    assert len(added) > 5
    for doc, span in added:
        kind, a, b = span.split(":")
        assert kind == "secret" and re.search(r"token = \"$", texts[doc][:int(a)], re.I), span
    base = {r.doc_id: set(r.base.split(",")) - {""} for r in rows}
    assert all(base[r.doc_id] <= set(r.spans.split(",")) for r in rows)


def test_added_spans_by_example():
    text = "call (614) 555-8001 or write jo.42 [at] example [dot] org, order 1234 5678 9012 3456, v 1999-10-12, amex card 3782 822463 10005"
    assert [k for k, _, _ in pii.added_spans(text, pii.base_spans(text))] == [0, 2, 3]
    long = "x" * 500 + "1 [at] w.com"  # a long local part is one span
    assert [(k, a, b) for k, a, b in pii.candidates(long, []) if k == 0] == [(0, 0, len(long))]
    many = " ".join(f"({i % 900 + 100}) 555-{i % 9000 + 1000}" for i in range(20_000))
    spans = pii.added_spans(many, pii.base_spans(many))
    assert all(e <= s for (_, _, e), (_, s, _) in itertools.pairwise(sorted(spans, key=lambda x: x[1])))



def test_vocabulary_merges_like_tiktoken_on_odd_words(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzéßñ日本"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.choice([3, 10, 40, 191, 192, 400])))) for i in range(60)]
    rows += [(100, "a" * 1000), (101, " " * 700 + "x"), (102, "ab" * 300), (103, "!" * 500)]
    got = {x.doc_id: x.ids for x in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN, ["ids"]).collect()}
    assert got == {i: codec.encode_ordinary(t) for i, t in rows}


def test_short_switches_are_found(docs):
    """One to three words of another language within a text, all from documents that the model has not seen."""
    rows = docs.filter("lang is not null and length(text) < 20000").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    model = langid.train([x.text for x in rows if x.doc_id % 3], [x.lang for x in rows if x.doc_id % 3])
    by = defaultdict(list)
    for x in rows:
        if x.doc_id % 3 == 0:
            by[x.lang] += [w for w in x.text.split() if w.isalpha() and len(w) > 4]
    r = np.random.default_rng(5)
    right = all_ = 0
    for a, b in itertools.permutations(sorted(by), 2):
        text, gold = [], []
        for turn in range(8):
            for lang, n in ((a, 7), (b, 1 + turn % 3)):
                at = r.integers(len(by[lang]) - n)
                text += by[lang][at:at + n]
                gold += [lang] * n
        _, gamma, _ = langid.label_words(model, pa.array([" ".join(text)]))
        said = [model.labels[y] for y in gamma.argmax(axis=1)]
        inside = [i for i, g in enumerate(gold) if g == b]
        right += sum(said[i] == b for i in inside)
        all_ += len(inside)
    assert right / all_ > 0.8


def test_text_in_no_learned_language_is_rejected(spark, docs):
    strange = ["привет мир как дела сегодня хорошо", "xkcd qwzx bvnm ghjk zzzt wqrt pldk mnbv", "日本語 の テキスト です ね", "12 34 !!", "", None]
    plain = docs.filter("text is not null").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(strange)], "doc_id long, text string, lang string")
    model = langid.fit(plain, "doc_id", "text", "lang")
    hidden = plain.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    kept = {r.doc_id: r.lang for r in langid.keep_identified(hidden.unionAll(extra), model, lang_col="lang").collect()}
    with_letters = {r.doc_id: r.lang for r in plain.collect() if any(c.isalpha() for c in r.text)}
    assert not [i for i in kept if i >= 10**6]
    assert set(kept) == set(with_letters)
    said = [(kept[i], lang) for i, lang in with_letters.items() if lang is not None and i % 5 == 0]
    assert np.mean([a == b for a, b in said]) > 0.95


def test_every_kept_text_is_identified_whatever_its_row_says(spark):
    """A language that a row has wrong is corrected where the marginals are sure; the rest stays, as do the rows."""
    r = random.Random(9)
    tongues = {"aa": ["".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(60)], "zz": ["".join(r.choice("stuvwx") for _ in range(r.randint(2, 7))) for _ in range(60)]}
    rows = [(i, " ".join(r.choice(tongues[lang]) for _ in range(50)), lang) for i, lang in enumerate(["aa", "zz"] * 40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(plain, "doc_id", "text", "lang")
    scores = {x.doc_id: x.score for x in langid.predict(plain, model).collect()}
    says = {i: {"aa": "zz", "zz": "aa"}[lang] if i % 4 < 2 else lang for i, _, lang in rows}
    wrong = spark.createDataFrame([(i, text, says[i]) for i, text, _ in rows], plain.schema)
    kept = {x.doc_id: x.lang for x in langid.keep_identified(wrong, model, lang_col="lang").collect()}
    assert 0 < model.sure <= 1
    assert kept == {i: lang if scores[i] >= model.sure else says[i] for i, _, lang in rows}
    assert sum(kept[i] == lang for i, _, lang in rows) >= 0.9 * len(rows)
    assert {x.doc_id: x.lang for x in langid.keep_identified(wrong, None, lang_col="lang").collect()} == says


def test_warc_records_cut_by_splits_or_shuffled(spark):
    """However the chunk rows lie in files and tasks, the records read are the same."""
    r = random.Random(4)
    rows = [(i, f"u{i}", "".join(r.choice("abc<>é") for _ in range(r.choice([0, 3, 400])))) for i in range(120)] + [(500, "u", "same"), (501, "u", "same"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    chunks = warc.stored(warc.write_records(pages, chunk_bytes=64), "chunks")
    want = sorted(map(repr, warc.read_records(chunks).collect()))
    assert len(want) == 123 and sum("revisit" in x for x in want) >= 1
    for other in (chunks.repartition(7), chunks.orderBy("chunk_no"), chunks.coalesce(1)):
        assert sorted(map(repr, warc.read_records(other).collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(repr, warc.read_records(chunks).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = warc.read_records(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
