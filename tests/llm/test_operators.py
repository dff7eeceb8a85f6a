"""Corpus operators against brute force, library results, exact round trips or held-out labels, on awkward rows as well."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specgraph.llm import decontaminate, fingerprint, htmltemplate, langid, pii, pieces, quality, simhash, subword, tokenfile, toxicity
from specgraph.llm.arrays import IdTable, Words, from_texts, mix64
from specgraph.llm.common import linked_components, lookup
from specgraph.llm.tokenizers import tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
LONG = "a long line of words and 12 numbers " * 4000
AWKWARD = [
    (1, "the cat sat on the mat and ate the hat of the man", "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (5, "der hund läuft über die straße und bellt laut", "de"),
    (1, "the cat sat on the mat and ate the hat of the man", "en"), (6, "x", "en"), (7, "123 !!", "de"), (None, "a text without an id", "en"), (8, "one\n\ntwo  three\tfour\r\n", None),
    (9, "the cat sat on the mat and ate the hat of the man!", "en"), (10, "mail a.b@c.de or +1 (383) 555-6083 from 10.0.0.1 with 4111 1111 1111 1111", "en"), (11, "wort▁mit zeichen 漢字 🙂", "de"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, lang, None, None, 0.5, "k", 7, "b") for i, t, lang in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp long, bucket string").repartition(3)


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def empty(df):
    return df.limit(0)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


# --- arrays ---------------------------------------------------------------------------------------------------------------


def test_words_do_not_cross_texts_and_hash_alike():
    texts = ["ab cd", "ef", "", "Ab", "ü-x"]
    words = Words(*from_texts([t.encode() for t in texts]))
    assert [np.diff(words.bounds)[i] for i in range(5)] == [2, 1, 0, 1, 2]
    assert words.hashes[0] == words.hashes[3] and len(set(words.hashes.tolist())) == 5
    head, which = words.affix(1)
    alone = Words(*from_texts([b"a"]))
    again = Words(*from_texts([b"xa", b"ya"])).affix(1, at_end=True)[0]
    assert len(which) == 5 and head[0] == head[3] and again[0] == again[1] and len(alone.hashes) == 1


def test_id_table_finds_what_was_put():
    table, keys = IdTable(4), mix64(np.arange(5000, dtype=np.uint64))
    table.put(keys[:100], np.arange(100, dtype=np.int32))
    table.put(keys[100:4000], np.arange(100, 4000, dtype=np.int32))
    assert table.get(keys).tolist() == [*range(4000), *[-1] * 1000]


def test_lookup_of_common_rare_absent_and_null_keys(spark):
    keys = [1] * 3000 + [2] * 1500 + list(range(10, 1500)) + [None] * 5
    rows = spark.createDataFrame(list(enumerate(keys)), "row long, k long")
    table = spark.createDataFrame([(k, -k) for k in [1, *range(10, 1000)]], "k long, v long")
    got = {r["row"]: r["v"] for r in lookup(rows, table, "k").collect()}
    assert got == {i: -k if k is not None and (k == 1 or 10 <= k < 1000) else None for i, k in enumerate(keys)}
    assert lookup(rows.limit(0), table, "k").count() == 0


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (None, 5), (7, 7)]
    found = linked_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


# --- 1: fingerprints ------------------------------------------------------------------------------------------------------


def digest_set(text):
    """Paragraphs as tuples of words: each line cut before a word where the hash of it and the word before says so."""
    out = set()
    for line in text.split("\n"):
        words = [w for w in re.split(r"[ \t\r\x0b\x0c]+", line) if w]
        hashes = [int(Words(*from_texts([w.encode()]), fingerprint.NON_SPACE, fingerprint.BYTE_CODES).hashes[0]) for w in words]
        lo = 0
        for i in range(1, len(words) + 1):
            if i == len(words) or int(mix64(np.array([(hashes[i - 1] * int(fingerprint._PAIR) + hashes[i]) % (1 << 64)], np.uint64))[0]) % fingerprint.RUN == 0:
                out.add(tuple(words[lo:i]))
                lo = i
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_IN_BUCKET", 30)
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").collect()]
    rows = fingerprint.fingerprint_documents(documents).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        following = texts[(i + 1) % len(texts)]
        half = len(texts[i]) // 2
        changed = texts[i][: len(texts[i]) - half] + following[:half]
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(digest_set(texts[i]), digest_set(changed)))
        assert r["near_next"] == pytest.approx(jaccard(digest_set(texts[i]), digest_set(following)))
    prints = {}
    assert all(prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] for t, r in zip(texts, rows, strict=True))


def test_sketch_recovers_the_digests_that_differ():
    a, b = fingerprint.DigestSets([b"one two three four\nfive\nsix"]), fingerprint.DigestSets([b"one two three four\nseven\nsix"])
    zero = np.zeros(1, np.int64)
    keys, _, sign, whole = fingerprint.sketch(a, zero).minus(fingerprint.sketch(b, zero)).peel()
    assert whole.all() and sorted(sign.tolist()) == [-1, 1]
    assert set(keys.tolist()) == set(a.keys.tolist()) ^ set(b.keys.tolist())


def test_a_failing_sketch_is_tried_larger_until_it_peels():
    a, b = (fingerprint.DigestSets(["\n".join(f"{p}{i}" for i in range(90_000)).encode()]) for p in "xy")
    zero = np.zeros(1, np.int64)
    assert not fingerprint.sketch(a, zero).minus(fingerprint.sketch(b, zero)).peel()[3].any()
    assert [int(x[0]) for x in fingerprint.differences(a, zero, b, zero)] == [90_000, 90_000]


def test_a_word_put_in_front_changes_one_paragraph():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(2000))
    sets, zero = fingerprint.DigestSets([text.encode(), ("and " + text).encode()]), np.zeros(1, np.int64)
    assert fingerprint.likeness(sets, zero, sets, zero + 1)[0] > 0.99


def test_hot_and_null_ids_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_IN_BUCKET", 20)
    docs = spark.createDataFrame([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} of them") for i in range(600)], "doc_id long, text string")
    sizes = fingerprint.with_following(docs, "doc_id", "text").where("guest = 0").groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) < 60 and sum(r["count"] for r in sizes) == 600
    order = sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    want = {r["text"]: jaccard(digest_set(r["text"]), digest_set(order[(i + 1) % 600]["text"])) for i, r in enumerate(order)}
    got = fingerprint.fingerprint_documents(docs).select("near_next", "edited_sha256").collect()
    assert sorted(r["near_next"] for r in got) == pytest.approx(sorted(want.values()))


def test_fingerprints_of_awkward_rows(awkward):
    rows = fingerprint.fingerprint_documents(awkward).collect()
    assert len(rows) == len(AWKWARD) and fingerprint.fingerprint_documents(empty(awkward)).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_chars"] == by[3]["n_chars"] == 0 and by[2]["near_next"] == 1.0
    lone = fingerprint.fingerprint_documents(awkward.where("doc_id = 5")).collect()
    assert lone[0]["near_next"] == 1.0


# --- 2: merge encoding ----------------------------------------------------------------------------------------------------


def random_texts(n, seed=3):
    rng = random.Random(seed)
    signs = " \n\t  aZé9٣!'#sdmtrevelthion  漢🙂́th in on▁"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 90))) for _ in range(n)] + ["", "  x  ", "thethe" * 40, " ".join(["word"] * 300)]


def test_without_dropout_ids_are_the_librarys():
    import sentencepiece

    texts = [t.replace("▁", "") for t in random_texts(800)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)
    ids, bounds = subword.model(PIECES).encode(texts, np.zeros(len(texts), np.int64), 0.0)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == library


def agenda(model, chunk, key, rate):
    """One chunk, one merge at a time."""
    symbols = [(int(model.symbol[ord(c)]), i) for i, c in enumerate(chunk)]
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, at), (b, _) = symbols[k], symbols[k + 1]
            got = int(model._candidates(np.array([a]), np.array([b]), np.array([at]), np.array([key], np.uint64), rate)[0])
            if got >= 0 and (best is None or model.rank[got] < best[0]):
                best = (model.rank[got], k, got)
        if best is None:
            return [s for s, _ in symbols]
        symbols[best[1] : best[1] + 2] = [(best[2], symbols[best[1]][1])]


@pytest.mark.parametrize("rate", [0.1, 0.6])
def test_dropout_follows_the_agenda(rate):
    model = subword.model(PIECES)
    words = [w for w in {w for t in random_texts(60) for w in t.split(" ")} if w and not set(w) & set("\n\t漢🙂▁")]
    for w in sorted(words)[:60] + ["internationalisation" * 4]:
        key = int(mix64(np.array([len(w) * 77 + ord(w[0])], np.uint64))[0])
        sym = np.array([[model.symbol[ord(c)] for c in w]], np.int32)
        want = agenda(model, w, key, rate)
        many = model._merge_many(sym, np.array([key], np.uint64), rate)[0] if len(w) > 1 else sym[0]
        assert [s for s in many.tolist() if s > -2] == want
        assert model._merge_long(sym[0], np.uint64(key), rate).tolist() == want


def test_dropout_varies_with_seed_document_and_place_and_decodes():
    model, texts = subword.model(PIECES), random_texts(300)
    seen = set()
    for seed, document in ((1, 0), (2, 0), (1, 1)):
        ids, bounds = model.encode(texts, np.full(len(texts), document), 0.3, seed)
        raw, offs = model.decode(ids, bounds)
        assert [raw[a:b].tobytes().decode() for a, b in zip(offs, offs[1:], strict=False)] == texts
        seen.add(ids.tobytes())
        again = model.encode(texts, np.full(len(texts), document), 0.3, seed)
        assert again[0].tobytes() == ids.tobytes() and (again[1] == bounds).all()
    assert len(seen) == 3
    ids, _ = model.encode([" ".join(["international"] * 400)], np.array([5]), 0.3)
    pieces_of, one = set(), []
    for i in ids.tolist():
        if model.bytes[model.offs[i]] == 32 and one:
            pieces_of.add(tuple(one))
            one = []
        one.append(i)
    assert len(pieces_of) > 20


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_whole_texts_follow_the_agenda_chunk_by_chunk(rate):
    """Each chunk by itself, one merge at a time, with the same keys."""
    model = subword.MergeModel(PIECES)
    texts = ["the international cat and the cat and the international hat", "other words and other words of the cat", "x" * 50 + " and the end"]
    documents = np.array([3, 4, -9])
    ids, bounds = model.encode(texts, documents, rate, 7)
    keys = []
    for t, d, a, b in zip(texts, documents.tolist(), bounds, bounds[1:], strict=False):
        want = []
        with np.errstate(over="ignore"):
            document = mix64(np.array([d], np.int64).view(np.uint64) + np.uint64(7) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
            for k, chunk in enumerate(re.findall(" [^ ]+", " " + t)):
                key = mix64(document + np.uint64(k) * np.uint64(0x632BE59BD9B4E019))[0]
                want += agenda(model, chunk, key, rate)
                keys.append(key)
        assert ids[a:b].tolist() == want
    assert len(set(keys)) == len(keys)


def test_encode_and_decode_awkward_rows(awkward):
    rows = subword.encode_documents(awkward, PIECES)
    got = rows.collect()
    assert len(got) == len(AWKWARD) and all(r["lossless"] for r in got) and subword.encode_documents(empty(awkward), PIECES).count() == 0
    back = subword.decode_documents(rows, PIECES).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in back) == sorted(((i or 0), t or "") for i, t, _ in AWKWARD)


# --- 3 and 10: classifiers ------------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randint(0, 29)] = rng.choice(["grobian", "grobling", "meanie"])
        if rng.random() < (0.9 if toxic else 0.1):
            text[rng.randint(0, 29)] = "women"
        if rng.random() < (0.1 if toxic else 0.5):
            text[rng.randint(0, 29)] = "men"
        good = int(rng.random() < 0.7)
        rows.append((i, " ".join(text) + ". " if good else "#$%! ".join(w.upper() for w in text), good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_its_swap_penalty(spark):
    df = labelled(spark)
    labels = df.select("doc_id", "quality", "toxic")
    rows = toxicity.score_documents(df.select("doc_id", "text"), labels).join(df, "doc_id").where("held_out").toPandas()
    assert auc(rows.toxic.to_numpy(), rows.score.to_numpy()) > 0.95
    own = toxicity.term_features(["women", "men"])
    gap = []
    for penalty in (0.0, 50.0):
        model = toxicity.train(df, labels, penalty=penalty)
        weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
        gap.append(abs(sum(weight.get(k, 0.0) for k in own[0].tolist()) - sum(weight.get(k, 0.0) for k in own[1].tolist())))
        neutral = from_texts([b"the women of the town met", b"the men of the town met"])
        scores = model.score(*neutral)
    assert gap[1] < 0.3 * gap[0] and abs(scores[0] - scores[1]) < 0.1


def test_quality_on_held_out_rows(spark):
    df = labelled(spark)
    rows = quality.score_documents(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")).join(df, "doc_id").where("held_out").toPandas()
    assert auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.99 and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()


def test_line_statistics_equal_plain_counts():
    texts = ["a b c\nb a c\nc a b", "a b c\na b c\nx y", "same\nsame\nsame", "one two\n\none  two", "", "\n\n"]
    got = dict(zip(quality.STATISTICS, quality.statistics(*from_texts([t.encode() for t in texts])).T, strict=True))
    for i, t in enumerate(texts):
        lines = [tuple(x.split()) for x in t.split("\n") if x.split()]
        words = t.split()
        assert got["repeated_lines"][i] == pytest.approx((len(lines) - len(set(lines))) / max(len(lines), 1))
        assert got["unique_words"][i] == pytest.approx(len(set(words)) / max(len(words), 1))
        assert got["commonest_word"][i] == pytest.approx(max((words.count(w) for w in words), default=0) / max(len(words), 1))


def test_quality_weights_solve_the_normal_equations_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] > 0.3 * x[:, 1]).astype(int)
    rows = spark.createDataFrame([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "key long, x array<double>, y int").repartition(5)
    model = quality.fit(rows)
    part = {r["key"]: r["p"] for r in rows.select("key", F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(4)).alias("p")).collect()}
    own = np.array([part[i] != 0 for i in range(300)])
    z = model.features(x[own])
    ridge = np.eye(z.shape[1]) * quality.RIDGE
    ridge[-1, -1] = 1e-6
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + ridge, z.T @ y[own]), abs=1e-6)
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.spread == pytest.approx(x.std(axis=0))
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9


def test_toxicity_weights_are_the_least_of_the_penalised_loss():
    """The gradient of loss, ridge and swap penalty, from scratch on the dense matrix, is zero at the fit."""
    rng = random.Random(2)
    terms, texts, y = ["women", "men"], [], []
    for i in range(200):
        bad = int(rng.random() < 0.4)
        texts.append(" ".join([rng.choice(["stone", "water", "field"]), *(["meanie"] if bad and rng.random() < 0.9 else []), "women" if rng.random() < (0.8 if bad else 0.3) else "men"]))
        y.append(bad)
    keys, rows = toxicity.distinct(*toxicity.features(Words(*from_texts([t.encode() for t in texts]))))
    named = [[terms.index(w) for w in t.split() if w in terms] for t in texts]
    swapped = toxicity.swaps(named, (tuple(terms),))
    y = np.array(y, float)
    model = toxicity.fit(keys, rows, y, y.mean(), swapped, terms, 5.0)
    x = np.zeros((200, len(model.keys)))
    at = {int(k): i for i, k in enumerate(model.keys)}
    for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
        if k in at:
            x[r, at[k]] = 1
    bias = model.bias - np.log(y.mean() / (1 - y.mean())) + np.log((y.sum() + 0.5) / (200 - y.sum() + 0.5))
    p = 1 / (1 + np.exp(-(x @ model.weights + bias)))
    grad = x.T @ (p - y) + toxicity.RIDGE * model.weights
    own = toxicity.term_features(terms)
    d = np.array([float(k in own[0].tolist()) - float(k in own[1].tolist()) for k in model.keys.tolist()])
    grad += 5.0 * sum(len(t) for t in named) * d * (d @ model.weights)
    assert np.abs(grad).max() < 0.05 and {toxicity.term_features(["meanie"])[0].tolist()[0]} & set(model.keys.tolist())


def test_isotonic_levels_rise_and_keep_the_mean():
    counts, hits = np.array([2, 0, 4, 4, 1, 3.0]), np.array([1, 0, 1, 3, 0, 3.0])
    levels = quality.pooled(counts, hits)
    assert (np.diff(levels) >= 0).all() and (levels * counts).sum() == pytest.approx(hits.sum())


@pytest.mark.parametrize("score", [toxicity.score_documents, quality.score_documents])
def test_classifiers_on_awkward_rows(spark, awkward, score):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] is not None for r in rows) and score(empty(awkward), labels).count() == 0
    assert {r["score"] for r in score(awkward, labels.limit(0)).collect()} == {0.5}


# --- 4: pages -------------------------------------------------------------------------------------------------------------


def page(body, menu="<a href=/a>home</a>"):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>{menu}</nav><div class='ad'>buy</div>{body}<footer>&copy; x</footer></body></html>"


def test_pages_against_the_marked_article(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    rows = htmltemplate.extract_articles(pages).join(pages.select("page_id", "html"), "page_id").collect()
    import html

    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner)]
        assert r["text"] == "\n".join(b for b in want if b) and r["n_chars"] == len(r["text"])


def hosted(spark, bodies, host="a.example.com"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def articles(pages):
    return {r["page_id"]: r["text"] for r in htmltemplate.extract_articles(pages).collect()}


def test_template_without_an_article_element(spark):
    bodies = [page(f"<div id=main><p>first {i} &amp; <b>bold</b></p><p>second {i} with some more words in it<br>third {i}</div><div class='comments'><p>no {i}</div><aside>s</aside>") for i in range(5)]
    assert articles(hosted(spark, bodies))[3] == "first 3 & bold\nsecond 3 with some more words in it\nthird 3"


def notice_page(i, notice="All words here are free to read"):
    return page(f"<article><h1>title {i}</h1><div class=x7><p>{notice}</p></div>" + "".join(f"<p>paragraph {i} {k} of the page and its words</p>" for k in range(2 + i % 3)) + "</article>")


def brute_template_texts(bodies):
    """Text blocks of the article that every page with their element has, by comparing all pages."""
    parsed = [htmltemplate.parsed(b) for b in bodies]
    counts = [{} for _ in bodies]
    for own, (nodes, blocks) in zip(counts, parsed, strict=True):
        for key in [(n.token, 0) for n in nodes] + [(b.element, b.text) for b in blocks]:
            own[key] = own.get(key, 0) + 1
    keys = set().union(*counts)
    vectors = {k: tuple(c.get(k, 0) for c in counts) for k in keys}
    elements = {v for k, v in vectors.items() if k[1] == 0}
    need = max(htmltemplate.SUPPORT, len(bodies) / htmltemplate.SHARE)
    return {k[1] for k, v in vectors.items() if k[1] and v in elements and sum(map(bool, v)) >= need}


def test_blocks_in_the_class_of_an_element_are_template(spark):
    bodies = [notice_page(i) for i in range(12)]
    got = articles(hosted(spark, bodies))
    assert brute_template_texts(bodies) == {"All words here are free to read"}
    for i in range(12):
        assert got[i] == "\n".join([f"title {i}", *(f"paragraph {i} {k} of the page and its words" for k in range(2 + i % 3))])
    other = articles(hosted(spark, [notice_page(i, f"All words here are free to read {i}") for i in range(12)]))
    assert other[4].split("\n")[1] == "All words here are free to read 4"
    # a host of few pages loses its notice as well; two pages are too few to tell
    few = articles(hosted(spark, bodies[: htmltemplate.SUPPORT]))
    assert few[0].split("\n")[1].startswith("paragraph 0 0")
    two = articles(hosted(spark, bodies[:2]))
    assert two[0].split("\n")[1] == "All words here are free to read"
    # a notice on some of the pages only, and one on too few of them
    some = [notice_page(i) if i % 3 == 0 else page(f"<article><h1>title {i}</h1><p>paragraph {i} of the page and its words</p></article>") for i in range(30)]
    assert articles(hosted(spark, some))[3].split("\n")[1].startswith("paragraph 3 0")
    rare = [notice_page(i) if i < 3 else page(f"<article><h1>title {i}</h1><p>paragraph {i} of the page and its words</p></article>") for i in range(30)]
    assert articles(hosted(spark, rare))[2].split("\n")[1] == "All words here are free to read"


def test_elements_that_hold_text_stay_and_unnamed_parts_go(spark):
    words = " ".join(["words of the article"] * 20)
    inner = [
        (f"<article><p class=share>Share prices fell</p><p>{words}</p></article>", f"Share prices fell\n{words}"), (f"<article><p>{words} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> so</p></article>", f"{words} x=1 so"),
        (f"<article><p>{words}</p><object>kept</object><h2 class=banner>Also kept</h2></article>", f"{words}\nkept\nAlso kept"), (f"<article><p>{words}</p><div class=user-discussion><p>a reader</p></div><div id=dfp-slot-3>buy</div><ul class=more-stories><li>other</li></ul></article>", words),
    ]
    pages = spark.createDataFrame([(i, f"https://h{i}.example.com/", page(b)) for i, (b, _) in enumerate(inner)], "page_id long, url string, html string")
    assert articles(pages) == {i: want for i, (_, want) in enumerate(inner)}


def plain_closing(tags):
    """What is open after each of ``tags``, by looking through all that is open."""
    stack, seen = [], []
    for tag in tags:
        name = tag.strip("/")
        inline = name in htmltemplate.INLINE
        if tag.startswith("/"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == name:
                    del stack[k:]
                    break
                if inline and stack[k] not in htmltemplate.INLINE:
                    break
        else:
            for k in range(len(stack) - 1, -1, -1):
                if inline or stack[k] not in htmltemplate.INLINE:
                    if not inline and (stack[k] == "p" or stack[k] in htmltemplate.ENDS.get(name, ())):
                        del stack[k:]
                    break
            stack.append(name)
        seen.append(list(stack))
    return seen


def test_open_elements_against_a_plain_stack():
    import random

    draw = random.Random(4)
    for _ in range(300):
        tags = [draw.choice(("", "/")) + draw.choice(("p", "b", "i", "li", "ul", "div", "td", "a")) for _ in range(40)]
        stack, got = htmltemplate.Open(), []
        for tag in tags:
            name = tag.strip("/")
            if tag.startswith("/"):
                stack.close(name)
            else:
                if name not in htmltemplate.INLINE:
                    stack.make_way(name)
                stack.push(htmltemplate.open_node(name, "", stack.top(), None, frozenset()))
            got.append([n.tag for n in stack.nodes])
        assert got == plain_closing(tags)


@pytest.mark.parametrize("body", ["<div>" * 20000 + "</section>" * 20000, "<i><div>" + "<b>" * 20000 + "</i>x" * 20000, "<b>" * 20000 + "<p>x</p>" * 20000, "<b>" * 20000 + "x<br>" * 20000])
def test_open_elements_cost_no_search(body):
    import time

    start = time.perf_counter()
    htmltemplate.extract(body, None)
    assert time.perf_counter() - start < 5


def test_other_vectors_give_another_template(spark):
    vectors = htmltemplate.occurrence_vectors(hosted(spark, [notice_page(i) for i in range(12)]))
    as_is = htmltemplate.host_templates(vectors).first()
    mixed = htmltemplate.host_templates(vectors.withColumn("vector", F.xxhash64("token", "block"))).first()
    assert len(as_is["fixed"]) == 1 and mixed["fixed"] is None
    classes = htmltemplate.host_classes(vectors).collect()
    outer = {r["vector"]: r["outer"] for r in classes}
    assert sum(v is None for v in outer.values()) + sum(v == outer[v] for v in outer if outer[v] is not None) >= 1 and len(classes) > 1
    # a token that pages have more than once is no slot: the one around it is
    several = hosted(spark, [page("<div class=feed>" + "".join(f"<article><p>part {k} of {i} and more</p></article>" for k in range(2 + i % 2)) + "</div>") for i in range(6)])
    assert articles(several)[1] == "part 0 of 1 and more\npart 1 of 1 and more\npart 2 of 1 and more"


def test_names_are_read_whole_and_wrappers_stay(spark):
    words = " ".join(["words of the article"] * 20)
    inner = [
        f"<main><div class='page has-sidebar'><p>{words}</p></div></main>", f"<main><div class='post no-comments'><p>{words}</p></div></main>",
        f"<article><div class='share-enabled body'><p>{words}</p></div></article>", f"<div class='widget'><p>{words}</p></div>",
        f"<article><p>{words}</p><div class='comment-list'><p>{words} and more {words}</p></div><div class='newsletter-form'>x</div></article>",
        f"<article><header class='entry-header'><h1>{words}</h1></header><div id='cookie-notice'>y</div></article>", f"<div class='site-header'>z</div><div><p>{words}</p></div>",
    ]
    pages = spark.createDataFrame([(i, f"https://h{i}.example.com/", page(b)) for i, b in enumerate(inner)], "page_id long, url string, html string")
    assert set(articles(pages).values()) == {words}


def test_deep_pages(spark):
    deep = "<div>" * 3000 + "<p>at the end of the page</p>" + "</div>" * 3000
    assert articles(hosted(spark, [deep, deep]))[1] == "at the end of the page"


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/1", "plain text only"), (4, "http://h/2", "<p>a<p>b<script>x</p>"), (None, "http://h/2", page("<article><p>c</article>")), (4, "http://h/2", "<p>a<p>b<script>x</p>"), (5, "http://h/3", page("<article>" + "<p>w" * 20000))]
    df = spark.createDataFrame([(*r, "t", "k") for r in rows], "page_id long, url string, html string, text string, host string")
    got = htmltemplate.extract_articles(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[1] == "" == by[2] and by[3] == "plain text only" and by[4] == "a\nb" and by[None] == "c" and by[5].count("\n") == 19999
    assert htmltemplate.extract_articles(empty(df)).count() == 0


# --- 5: language ----------------------------------------------------------------------------------------------------------


def brute_bits(counts, text):
    """Code length by walking the contexts of each byte."""
    raw, total = langid.folded(text), 0.0
    trees = [{} for _ in counts]
    for order, (ctx, byte, n) in enumerate(counts):
        for c, b, k in zip(ctx.tolist(), byte.tolist(), n.tolist(), strict=True):
            trees[order].setdefault(c, {})[b] = k
    for i in range(langid.ORDER, len(raw)):
        for order in range(langid.ORDER, -1, -1):
            seen = trees[order].get(int.from_bytes(raw[i - order : i], "big") if order else 0)
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if raw[i] in seen:
                total += np.log2((n + d) / seen[raw[i]])
                break
            total += np.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_equal_the_walk_over_contexts():
    counts = [langid.count_contexts(["the cat sat", "on the mat"]), langid.count_contexts(["der hund und die katze"])]
    model = langid.LanguageModel(["a", "b"], counts)
    texts = ["the hat", "Die Maus", "zz9 ü", "", "the the the cat sat on the mat"]
    got = model.code_lengths(texts)
    assert got == pytest.approx(np.array([[brute_bits(c, t) for c in counts] for t in texts]), rel=1e-5, abs=1e-4)


def test_language_of_held_out_documents(documents):
    rows = langid.identify_documents(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_texts_that_no_tree_codes_are_rejected_and_lang_is_the_one_named(spark):
    rows = [(i, "the cat sat on the mat and the dog ate the hat", None if i == 3 else "en") for i in range(8)] + [(20, "der hund und die katze liegen auf der strasse", "de"), (21, "qx7#zkv%w9@jq!x0^", "en"), (22, "12 !!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 21"))
    kept = {r["doc_id"]: r["lang"] for r in langid.keep_identified(docs, model).collect()}
    assert kept == {**dict.fromkeys(range(8), "en"), 20: "de"}


def test_language_of_awkward_rows(awkward):
    rows = langid.identify_documents(awkward).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(AWKWARD) and {by[i]["lang_pred"] for i in (2, 3, 7)} == {"und"} and by[2]["score"] == 0.0
    assert by[5]["lang_pred"] == "de" and langid.identify_documents(empty(awkward)).count() == 0
    none = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify_documents(none).collect()} == {"und"}


# --- 6: SimHash -----------------------------------------------------------------------------------------------------------


def brute_components(fps, ids):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS
    labels = ids.copy()
    while True:
        new = np.where(near, labels[None, :], 1 << 60).min(axis=1)
        if (new == labels).all():
            return labels
        labels = new


def slow_simhash(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(documents):
    rows = simhash.near_duplicates(documents).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    fps = np.array([int(x, 16) for x in rows.fingerprint], dtype=np.uint64)
    assert all(len(x) == 16 for x in rows.fingerprint) and [slow_simhash(texts[i]) for i in rows.doc_id[:60]] == fps[:60].tolist()
    assert (brute_components(fps, rows.doc_id.to_numpy()) == rows.component_id).all()


def test_links_at_every_distance_and_in_dense_groups(spark):
    rng = random.Random(9)
    fps = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for flips in (1, 2, 3, 3, 4, 5):
            for b in rng.sample(range(64), flips):
                x ^= 1 << b
            fps.add(x)
    fps |= {sum(1 << b for b in rng.sample(range(8), k)) for k in range(9) for _ in range(9)}
    own = np.array(sorted(fps), dtype=np.uint64)
    ids = np.arange(len(own)) + 5
    df = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, own.view(np.int64), strict=True)], "key long, fp long")
    got = {r["key"]: r["component_id"] for r in simhash.near_components(df).collect()}
    assert [got[int(i)] for i in ids] == brute_components(own, ids).tolist()


def test_simhash_of_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(AWKWARD) and by[2]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 2
    assert simhash.near_duplicates(empty(awkward)).count() == 0


# --- 7: token files -------------------------------------------------------------------------------------------------------


def test_pieces_and_ids_are_the_librarys():
    texts = [*random_texts(1500, seed=8), "it's we're I'LL they'll 've", "<|endoftext|>", "a'sb 'll", "\n's \n\n's"]
    enc = tokenfile.encoder(BPE)
    enc.tokenizer.encode_special_tokens = True
    ids, bounds = enc.encode(texts, None)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert pieces.classes()[ord("é")] == pieces.LETTER and pieces.classes()[0x1C] == pieces.OTHER


def test_added_tokens_are_the_librarys():
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x{end}", f"{end}\n y  {end} 's", "", "no token", "<|endoftext", f"<{end}>", f"é {end}漢{end} "]
    enc = tokenfile.ByteLevelEncoder(BPE)
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    for end_id in (None, 0):
        ids, bounds = enc.encode(texts, end_id)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [w if end_id is None else [*w, end_id] for w in want]


def test_token_files_of_texts_with_added_tokens(spark):
    docs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, None), (4, "the end")]
    found = tokenfile.tokenize_to_files(spark.createDataFrame(docs, "doc_id long, text string"), BPE).orderBy("doc_id").collect()
    ids = [[64, 220, 50256, 275, 0], [50256, 0], [0], [*tokenfile.encoder(BPE).tokenizer.encode("the end", add_special_tokens=False).ids, 0]]
    assert [r["start"] for r in found] == [0, 5, 7, 8]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in found] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]


def test_token_files_read_back(spark, documents, tmp_path):
    enc, start = tokenfile.encoder(BPE), 0
    path = str(tmp_path / "ids")
    got = {r["doc_id"]: r for r in tokenfile.tokenize_to_files(documents.repartition(5), BPE, path).collect()}
    for r in documents.orderBy("doc_id").collect():
        ids = [*enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        row = got[r["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq

    files = sorted(tmp_path.glob("ids/*.parquet"))
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(4) for f in files]
    assert all("DICTIONARY" in str(c.encodings) for c in columns) and all(c.has_offset_index and c.has_column_index for c in columns)
    assert any("DELTA_BINARY_PACKED" in str(pq.ParquetFile(f).metadata.row_group(0).column(k).encodings) for f in files for k in (0, 2, 3))
    assert tokenfile.read_tokens(spark, path).where("doc_id = 3").select("n_tokens").collect()[0][0] == got[3]["n_tokens"]


def test_token_files_of_awkward_rows(awkward):
    rows = sorted(tokenfile.tokenize_to_files(awkward, BPE).collect(), key=lambda r: r["start"])
    assert len(rows) == len(AWKWARD) and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert tokenfile.tokenize_to_files(empty(awkward), BPE).count() == 0


def test_a_hot_id_is_spread_over_parts(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text number {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    path = tokenfile.scratch_path(spark, "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = sorted(tokenfile.tokenize_to_files(docs, BPE, path).collect(), key=lambda r: r["start"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False)) and [r["doc_id"] for r in rows] == [None] * 200 + [7] * 200
    parts = tokenfile.read_tokens(spark, path).groupBy("part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 300


# --- 8: decontamination ---------------------------------------------------------------------------------------------------


def test_overlaps_with_substitutions(spark):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 50))] for _ in range(40)] + [["short", "item", "of", "six", "words", "here"]]
    docs, want = [], set()
    for d in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if d % 3 == 0:
            i = rng.randrange(len(items))
            copy = list(items[i])
            if len(copy) > 20:
                for k in range(4, len(copy), 7):
                    copy[k] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(text).upper() if d % 2 else ", ".join(text)))
    found = decontaminate.overlapping(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def words_of(text):
    return Words(*from_texts([text.encode()])).hashes


@pytest.mark.parametrize(("size", "subs"), [(12, 1), (12, 2), (13, 2), (14, 2), (15, 1), (15, 2), (15, 3), (16, 2), (16, 3), (18, 3), (20, 3), (20, 4), (24, 4), (30, 6)])
def test_recall_of_substituted_items_over_all_places(size, subs):
    """Every way of substituting tokens within the rule; the masks leave few out, and whatever hits is verified whole."""
    item = [f"w{k}" for k in range(size)]
    own, masks = words_of(" ".join(item)), decontaminate.all_masks([])
    rng, every = random.Random(1), list(itertools.combinations(range(size), subs))
    every = every if len(every) <= 5000 else rng.sample(every, 5000)
    found = 0
    for places in every:
        text = words_of(" ".join(["before"] * 3 + ["other" if k in places else w for k, w in enumerate(item)] + ["after"] * 3))
        got = decontaminate.best_overlap(text, own, masks)
        assert got in (None, (3, size, size - subs, size))
        found += got is not None
    print("recall", size, subs, found / len(every))
    assert found / len(every) >= 0.9


def test_repeated_words_take_linear_memory():
    text, item = words_of("word " * 20_000), words_of("word " * 5000)
    assert decontaminate.best_overlap(text, item, decontaminate.all_masks([])) == (0, 5000, 5000, 5000)


def brute_overlap(text, item):
    best = None
    for d in range(-len(item), len(text) + 1):
        lo, hi = max(0, d), min(len(text), d + len(item))
        if hi <= lo:
            continue
        a, b = decontaminate.longest_stretch(text[lo:hi] == item[lo - d : hi - d])
        same = int((text[lo:hi] == item[lo - d : hi - d])[a:b].sum())
        if b - a >= min(decontaminate.MIN_TOKENS, len(item)) and (best is None or same > best[2]):
            best = (lo + a, b - a, same, len(item))
    return best


def test_overlaps_equal_brute_force_over_all_shifts():
    rng, right, wrong = random.Random(12), 0, 0
    for _ in range(400):
        item = [f"t{rng.randrange(60)}" for _ in range(rng.randint(5, 40))]
        copy = [w if rng.random() > 0.12 else "other" for w in item]
        text = [f"t{rng.randrange(60)}" for _ in range(30)] + copy + [f"t{rng.randrange(60)}" for _ in range(30)]
        a, b = words_of(" ".join(text)), words_of(" ".join(item))
        want, got = brute_overlap(a, b), decontaminate.best_overlap(a, b, decontaminate.all_masks([len(item)] if len(item) < 12 else []))
        assert got is None or (want is not None and got[2] <= want[2])
        right += want is not None and got is not None and got[2] == want[2]
        wrong += want is not None and (got is None or got[2] != want[2])
    assert right / (right + wrong) > 0.9


def test_longest_stretch_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.7, 0.85])
        spans = [(b - a, int(equal[a:b].sum()), -a) for a in range(len(equal) + 1) for b in range(a, len(equal) + 1) if 5 * int(equal[a:b].sum()) >= 4 * (b - a)]
        n, same, a = max(spans)
        got = decontaminate.longest_stretch(equal)
        assert got[1] - got[0] == n and int(equal[got[0] : got[1]].sum()) == same and (n == 0 or got[0] == -a)


def test_whole_items_are_found_in_documents(spark, documents, tiny, monkeypatch):
    benchmark = spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = {r["item_id"]: " ".join(re.findall(r"\w+", r["text"].lower())) for r in benchmark.collect()}
    want = {(r["doc_id"], i) for r in documents.collect() for i, t in items.items() if f" {t} " in f" {' '.join(re.findall(r'\w+', r['text'].lower()))} "}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlapping(documents, benchmark).collect()}
    assert want and want <= found
    monkeypatch.setattr(decontaminate, "MOST_BITS", 15)
    monkeypatch.setattr(decontaminate, "FEW", 1)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlapping(documents, benchmark).collect()} == found
    kept = {r["doc_id"] for r in decontaminate.without_overlaps(documents, benchmark).collect()}
    assert kept == {r["doc_id"] for r in documents.collect()} - {d for d, _ in found}


def test_overlaps_of_awkward_rows(spark, awkward):
    benchmark = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, AWKWARD[0][1], 2), (3, AWKWARD[0][1], 2), (None, "hund läuft über die straße", 2)], "item_id long, text string, doc_id long")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.overlapping(awkward, benchmark).collect())
    assert found == [(1, 3), (1, 3), (5, -1), (9, 3)]
    assert decontaminate.overlapping(empty(awkward), benchmark).count() == 0 == decontaminate.overlapping(awkward, empty(benchmark)).count()
    assert decontaminate.without_overlaps(awkward, benchmark).columns == awkward.columns


def test_a_passage_that_most_texts_share(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"own{i} {passage} end{i}" if i % 3 else passage) for i in range(600)], "doc_id long, text string")
    items = spark.createDataFrame([(k, passage + f" tail{k}") for k in range(40)], "item_id long, text string")
    assert decontaminate.overlapping(docs, items).count() == 600 * 40 and decontaminate.without_overlaps(docs, items).count() == 0


# --- 9: personal data -----------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            n = len(re.sub("[^0-9]", "", m[0]))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= n <= 19 and pii.luhn(pii.digits(m[0])), "phone": 8 <= n <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(documents):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab.@-+%1234567890 ()\né") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["1.2.3.4.5.6.7.8 a@b.c@d.ef ++1 (383) 555-6083 256.1.1.1 4111 1111 1111 1111", "x@y", "@a.b"] + [r["text"] for r in documents.collect()]
    found = pii.find_all(*from_texts([t.encode() for t in texts]), pii.default_field())
    for text, (own, both) in zip(texts, found, strict=True):
        assert own == plain_spans(text) and set(own) <= set(both)


#: Lines that are not in LABELLED, marked like those.
HELD_OUT = (
    "please call [phone|212-555-0147] or [phone|(030) 555 98 76] now", "write [email|anna (at) mail (dot) org] today", "seen at [ip|2001:db8:0:2:0:0:0:43] again", "in 2021 we sold 1,299 units for 35% more", "just words here",
    "you can mail [email|mia at example dot net] any time", "Herr Weber, Tel. [phone|0228 7654321], weiss mehr", "his fax [phone|617-555-0188] works", "the box [ip|fe80::1] is slow", "a router [ip|2001:db8:5::2] fell over",
    "her iban [card|DE12 5001 0517 0648 4898 90] please", "my card [card|4242 4242 4242 4242] expired", "a card [card|3714 496353 98431] of his", "mailto [email|bob.b @ example.org] if so", "mon numéro [phone|06 98 76 54 32] ou rien",
    "send word to [email|kim [at] example [dot] com]", "phone [phone|1-888-555-0175] for help", "unter [phone|(089) 765 43 21] bis acht", "tel [phone|030/7654321] nur werktags", "ring [phone|020 7946 0123] after nine", "ip [ip|fd00:9:8:7:6:5:4:32] answered",
    "on 7 June 2018 at 11:45 she left", "pages 100-120 and 130", "version 10.2.1 was cut", "a sum of 987654 euro", "it is 12:30:59 now", "the code 0x7fffa3 and b2c4", "isbn 0-306-40615-2 is old", "1999, 2004 and 2010 were dry", "see table 4.2.1 there",
    "order 4111111111111113 was lost", "room 12-34 and 56", "they met at a dot on the map", "the @home sign", "row 10 20 30 40", "foo::bar and std::map", "between 9:00 and 17:30", "Der Preis liegt bei 1.299,00 Euro.", "Le 12/03/2019 il est parti.",
)


def test_precision_and_recall_of_the_field_on_lines_it_has_not_seen():
    assert not set(HELD_OUT) & set(pii.LABELLED)
    lines = [pii.unmark(x) for x in HELD_OUT]
    found = [pii.field_spans(*pii.code_points([t])[1:], pii.default_field())[0] for t, _ in lines]
    right = sum(len(set(got) & set(want)) for got, (_, want) in zip(found, lines, strict=True))
    print("precision", right / sum(map(len, found)), "recall", right / sum(len(w) for _, w in lines), [(t, g, w) for g, (t, w) in zip(found, lines, strict=True) if g != w])
    assert right / sum(map(len, found)) >= 0.85 and right / sum(len(w) for _, w in lines) >= 0.85


def test_very_long_runs_of_digits_and_lines(spark):
    many = "0" * 5_000_000
    texts = ["0" * 5000 + ".1.1.1", many + ".1.1.1", "9" * 5000 + ".1.1.1", many, "1 " * 300_000, "a@" * 100_000, "+1" + "0" * 100_000, "x" * 500 + " call 212-555-0147 now " + "y " * 3000]
    found = pii.find_all(*from_texts([t.encode() for t in texts]), pii.default_field())
    assert [[k for k, *_ in own] for own, _ in found] == [["ip"], ["ip"], [], [], [], [], [], []]
    assert found[-1][1] == [("phone", 506, 518)]
    assert pii.find_personal_data(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).count() == len(texts)


def test_stretches_give_the_labels_of_whole_lines(monkeypatch):
    rng = random.Random(5)
    marked = [pii.unmark(x)[0] for x in pii.LABELLED]
    text = " ".join(rng.choice(marked) for _ in range(300))
    cps, offs = pii.code_points([text])[1:]
    cut = pii.field_spans(cps, offs, pii.default_field())
    monkeypatch.setattr(pii, "STRETCH", 1 << 20)
    monkeypatch.setattr(pii.Field, "may_differ", lambda self, score: np.ones(len(score), dtype=bool))
    assert cut == pii.field_spans(cps, offs, pii.default_field()) and len(cut[0]) > 100


def test_viterbi_equals_trying_all_paths():
    field = pii.default_field()
    from itertools import product

    feats = [pii.tokens_of([t]).feats for t in ("tel 030-1", "a@b", "x", "at 1::2")]
    score = np.concatenate([field.scores(f) for f in feats])
    lens = np.array([len(f) for f in feats])
    first = np.cumsum(lens) - lens
    got = field.paths(score, first, lens)
    for lo, n in zip(first.tolist(), lens.tolist(), strict=True):
        own = score[lo : lo + n]

        def value(path, own=own):
            return sum(own[t, k] for t, k in enumerate(path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:], strict=False)) - 1e9 * (path[0] % 2 == 0 and path[0] > 0)

        best = max(product(range(9), repeat=n), key=value)
        assert value(tuple(got[lo : lo + n].tolist())) == pytest.approx(value(best))


def test_personal_data_of_awkward_rows(awkward):
    rows = pii.find_personal_data(awkward).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(AWKWARD) and (by[10]["n_email"], by[10]["n_ip"], by[10]["n_card"], by[10]["n_phone"]) == (1, 1, 1, 1)
    assert by[2]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and pii.find_personal_data(empty(awkward)).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(awkward).collect()}
    assert masked[10] == "mail <EMAIL> or <PHONE> from <IP> with <CARD>" and masked[2] is None and masked[4] == LONG
