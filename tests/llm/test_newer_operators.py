"""Quality rules, collocations and lexical search against plain versions, on awkward rows as well."""

import collections
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specgraph.llm import collocation, lexical, queries, supervision

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of a in cat dog Éclair ñandú 漢字 run-on x1 !! 50% 🙂".split()


def texts(seed, n, longest=60):
    rng = random.Random(seed)
    seps = [" "] * 12 + ["\n", "\t", "  ", ". ", ", ", "\r\n", "\x0b", "; ", "!"]
    made = ["".join(rng.choice(WORDS) + rng.choice(seps) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return [None, "", " \n ", "a" * 70_000 + " b", "the cat " * 3000, *made, *made[:5]]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, null, empty and long texts, a hot language, and columns named like the operators' own."""
    rows = [(None if i % 37 == 9 else i // 2 if i % 11 == 0 else i, t, ("en", "en", "en", None, "de")[i % 5], "s", 1, 2, "p", 3.0) for i, t in enumerate(texts(1, 220))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block long, n long, part string, score double").repartition(4)


# --- quality rules --------------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        covered |= set(range(i, i + 5)) if times[g] > 1 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_rules_equal_a_plain_count(awkward):
    got = collections.Counter(tuple(r)[:7] for r in supervision.judge_documents(awkward).drop("kept", "posterior").collect())
    assert got == collections.Counter((r["doc_id"], *base_counts(r["text"])) for r in awkward.collect())


def test_equal_hashes_of_other_windows_do_not_count(spark, monkeypatch):
    """With a hash that puts all windows together, neighbours are still compared word by word."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, "a b c d e " * 2), (3, "a a a a a a a")], "doc_id long, text string")
    want = {r["doc_id"]: r["n_repeat_words"] for r in supervision.statistics(docs).collect()}
    assert want == {1: 0, 2: 10, 3: 7}
    monkeypatch.setattr(supervision.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in supervision.statistics(docs).where("doc_id <> 2").collect()} == {1: 0, 3: 7}


def test_estimates_equal_a_plain_run(spark):
    rng = random.Random(3)
    rules = len(supervision.RULES)
    rows = [tuple(rng.choice([0, 1, 2] if supervision.RULES[j].good else [0, 0, 2]) for j in range(rules)) for _ in range(40)]
    counts = collections.Counter(rows)
    df = spark.createDataFrame([(*v, n * 10) for v, n in counts.items()], ", ".join(f"v{j} int" for j in range(rules)) + ", n long")
    found = supervision.estimated(df)
    first = [[r.expected(s) for r in supervision.RULES] for s in (supervision.ON_GOOD, supervision.ON_BAD)]
    share, of = supervision.FIRST_GOOD_SHARE, [[dict(x) for x in f] for f in first]

    def posterior(v):
        odds = (1 - share) / share
        for j, x in enumerate(v):
            if of[0][j][x] > 0 and of[1][j][x] > 0:
                odds *= of[1][j][x] / of[0][j][x]
        return 1 / (1 + odds)

    for _ in range(supervision.ROUNDS):
        p = {v: posterior(v) for v in counts}
        sums = [sum(10 * n * (p[v] if side == 0 else 1 - p[v]) for v, n in counts.items()) for side in (0, 1)]
        of = [[{x: (sum(10 * n * (p[v] if side == 0 else 1 - p[v]) for v, n in counts.items() if v[j] == x) + supervision.WEIGHT * f[x]) / (sums[side] + supervision.WEIGHT) for x in f} for j, f in enumerate(first[side])] for side in (0, 1)]
        share = (sums[0] + supervision.FIRST_GOOD_SHARE) / (sum(sums) + 1)
    assert found.good_share == pytest.approx(share, abs=1e-9)
    for mine, want in ((found.on_good, of[0]), (found.on_bad, of[1])):
        assert [x[v] for x in mine for v in (0, 1, 2)] == pytest.approx([x[v] for x in want for v in (0, 1, 2)], abs=1e-9)


def test_verdicts_against_labels(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    rows = supervision.judge_documents(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= n.get((0, False), 0)


def test_rules_use_no_python(awkward):
    plan = supervision.statistics(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- collocations ---------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k) > 2}
    inside = {(k[0], *k[i : i + m]) for k, a in found.items() for m in range(2, len(k) - 1) for i in range(1, len(k) - m + 1) if f[(k[0], *k[i : i + m])] <= a}
    out = collections.defaultdict(list)
    for k, a in found.items():
        if k not in inside:
            cuts = [(1000 * a * n[k[0]] // (f[k[: 1 + j]] * f[(k[0], *k[1 + j :])]), j, f[k[: 1 + j]], f[(k[0], *k[1 + j :])]) for j in range(1, len(k) - 1)]
            score, _, left, right = min(cuts)
            out[k[0]].append((-score, -a, " ".join(k[1:]).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang in sorted(out) for i, (s, a, p, x, y) in enumerate(sorted(out[lang])[:top])]


@pytest.mark.parametrize(("least", "top", "slack"), [(5, 40, 4), (3, 10_000, 1), (60, 7, 1)])
def test_collocations_equal_a_plain_count(awkward, monkeypatch, least, top, slack):
    for name, value in (("PART_MASS", 4000), ("FLUSH", 500), ("KEPT", 300), ("ROW", 64), ("SLACK", slack)):
        monkeypatch.setattr(collocation, name, value)
    got = sorted(tuple(r) for r in collocation.collocations(awkward, least=least, top=top).collect())
    assert got == sorted(plain_collocations([(r["text"], r["lang"]) for r in awkward.collect()], least, top)) and got


def test_summaries_lose_no_frequent_key():
    rng = np.random.default_rng(4)
    for capacity, least in ((50, 40), (3, 400), (1, 5)):
        stream = rng.zipf(1.3, 20_000).astype(np.uint64)
        summary = collocation.Summary(capacity, least)
        for part in np.array_split(stream, 17):
            summary.merge(*collocation.counted(part))
        keys, counts = collocation.counted(stream)
        low = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
        assert summary.taken < least and set(keys[counts >= least].tolist()) <= set(summary.frequent().tolist())
        assert all(low.get(k, 0) <= n <= low.get(k, 0) + summary.taken for k, n in zip(keys.tolist(), counts.tolist(), strict=True))
        if capacity * least > len(stream):
            assert summary.capacity == capacity


def test_scores_are_exact_past_64_bits(spark):
    row = (10**12, 3 * 10**13, 7 * 10**12, 10**13)
    df = spark.createDataFrame([row], "a long, n long, l long, r long")
    assert df.select(F.expr(collocation.SCORE).alias("s")).first()["s"] == 1000 * row[0] * row[1] // (row[2] * row[3])


# --- lexical search -------------------------------------------------------------------------------------------------------


def plain_ranking(docs, items):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, collections.Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_words, df = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags), collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(collections.Counter)
    for i, t in set(items):
        asked[i].update(term.findall((t or "").translate(LOWER)))
    out = []
    for i, q in asked.items():
        scores = []
        for k, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // n_words
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, x in q.items() if t in bag)
            scores += [(-s, -1 if k is None else k, k)] if s else []
        out += [(i, r + 1, k, -s) for r, (s, _, k) in enumerate(sorted(scores, key=lambda x: x[:2])[:20])]
    return out


@pytest.mark.parametrize(("block", "packet"), [(2048, 128), (16, 3)])
def test_ranking_equals_plain_scores(spark, awkward, monkeypatch, block, packet):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PACKET", packet)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))) for i in range(25)] + [(3, "cat cat dog"), (3, "cat cat dog"), (90, None), (91, ""), (92, "nowhere"), (93, "THE CAT")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("owner", F.lit(1)).withColumn("weights", F.lit("w"))
    got = sorted(lexical.ranked(awkward, benchmark).collect(), key=lambda r: (r["item_id"], r["rank"]))
    assert [tuple(r) for r in got] == sorted(plain_ranking([(r["doc_id"], r["text"]) for r in awkward.collect()], items), key=lambda x: x[:2])


# --- all three ------------------------------------------------------------------------------------------------------------


def test_empty_tables(awkward, spark):
    none, items = awkward.limit(0), spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert supervision.judge_documents(none).count() == 0 and collocation.collocations(none).count() == 0
    assert lexical.ranked(none, items).count() == 0 and lexical.ranked(awkward, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "en"), (2, "...", None)], "doc_id long, text string, lang string")
    assert lexical.ranked(blank, items).count() == 0 and collocation.collocations(blank).count() == 0 and supervision.judge_documents(blank).where("kept").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = f"{tiny}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(queries.ORACLES[name])
    names = [c[0] for c in got.description]
    df = queries.QUERIES[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(got.fetchall())
