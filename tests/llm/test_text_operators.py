"""Decontamination, near copies, language, quality, SentencePiece, LM on odd input and against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from larder.llm import decontamination, language, lm, minhash, quality, sentencepiece_codec
from larder.llm.common import table

UP = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def test_contamination_brute_force_and_offsets(spark, odd_docs, no_docs):
    text = "Intro words. " + " ".join(f"Word{i} OF the tale" for i in range(30, 36)) + " the end"
    docs = odd_docs.select("doc_id", "text", "n_words").union(spark.createDataFrame([(20, text, "y")], "doc_id long, text string, n_words string"))
    items = [(1, " ".join(f"word{i} of the tale" for i in range(30, 36))), (2, "short, TEXT"), (3, None), (4, "!!"), (2, "short text"), (None, "日本")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    judged, at = decontamination.decontaminate(spark, docs, bench)
    assert judged.columns[:3] == ["doc_id", "text", "n_words"] and at["n_words"] == "_n_words"
    for r in judged.collect():
        w, hit, found = words(r["text"]), set(), set()
        for i, t in items:
            iw = words(t)
            size = min(13, len(iw))
            for p in range(len(iw) - size + 1) if iw else []:
                for q in range(len(w) - size + 1):
                    if w[q : q + size] == iw[p : p + size]:
                        hit |= set(range(q, q + size))
                        found |= {str(i)} if i is not None else set()
        assert (r[at["n_words"]], r[at["n_hit"]], r[at["items"]]) == (len(w), len(hit), sorted(found))
        assert r[at["contaminated"]] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        covered = [x for s in r[at["spans"]] for x in words(r["text"][s["start"] : s["end"]])]
        assert covered == [w[i] for i in sorted(hit)]
    assert decontamination.contamination_digest(spark, no_docs, bench).count() == 0
    assert decontamination.contamination_digest(spark, docs, bench.limit(0)).where("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontamination.decontaminate(spark, docs, bench, max_patterns=2)


def test_dart_signatures_estimate_weighted_similarity():
    a = {i: 1 + i % 4 for i in range(300)}
    b = {i: 1 + i % 3 for i in range(60, 360)}
    want = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(360)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(360))
    row = np.array([0] * len(a) + [1] * len(b))
    element = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = minhash.dart_signatures(row, element, np.array([*a.values(), *b.values()], float), 2, 4096)
    assert (sig != 0).all() and abs((sig[0] == sig[1]).mean() - want) < 0.03


def brute_classes(rows, threshold=0.8):
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [runs(words(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = bool(rows[i][1]) and rows[i][1] == rows[j][1]
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return sorted(repr(sorted(g, key=repr)) for g in groups.values())


def test_near_duplicates_brute_force(spark, odd_docs, no_docs):
    near = [(100 + i, " ".join(f"w{j}" if (j * 7 + i) % 41 else f"e{i}x{j}" for j in range(120))) for i in range(30)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found, _ = minhash.near_duplicates(spark, docs)
    groups = collections.defaultdict(list)
    for n, r in enumerate(found.collect()):
        groups[("alone", n) if r.root is None else r.root].append(r.doc_id)
    assert sorted(repr(sorted(g, key=repr)) for g in groups.values()) == brute_classes(rows)
    kept = minhash.keep_first(spark, odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 4, 5, 6, 7, 9, 11, 12]
    assert minhash.near_duplicates(spark, no_docs)[0].count() == 0 and minhash.keep_first(spark, no_docs).count() == 0


def test_language_code_lengths_match_recursive_model():
    texts = {"a": "the cat and the hat", "b": "der hut und die katze"}
    gram, lang, n = [], [], []
    for i, t in enumerate(texts.values()):
        data = b"\0\0\0" + t.encode()
        for key, c in collections.Counter(data[j : j + 4] for j in range(len(data) - 3)).items():
            gram.append(int.from_bytes(key, "big")), lang.append(i), n.append(c)
    trees = language.build(np.array(gram, np.uint32), np.array(lang), np.array(n), list(texts))
    alphabet = len({b for t in texts.values() for b in t.encode()}) + 1

    def p(t, context, x):
        data = b"\0\0\0" + t.encode()
        here = collections.Counter()
        for j in range(3, len(data)):
            if data[j - len(context) : j] == context:
                here[data[j]] += 1
        total, kinds = sum(here.values()), len(here)
        if here[x]:
            return here[x] / (total + kinds)
        lower = 1 / alphabet if not context else p(t, context[1:], x)
        return lower * (kinds / (total + kinds) if total else 1)

    probe = "the hut zz".encode()
    got = trees.code_lengths(np.frombuffer(probe, np.uint8), np.array([0, 0, len(probe)]))
    assert (got[0] == 0).all()
    known = {b for t in texts.values() for b in t.encode()}
    for i, t in enumerate(texts.values()):
        want = 0.0
        for j, x in enumerate(probe):
            context = (b"\0\0\0" + bytes(c if c in known else 0 for c in probe))[j : j + 3]
            want -= math.log2(p(t, context, x if x in known else -1))
        assert got[1][i] == pytest.approx(want, rel=1e-4)


def test_language_and_quality_on_odd_and_held_out(spark, odd_docs, no_docs):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    trees = language.fit(docs)
    told, pred, score = language.identify(spark, odd_docs, trees)
    rows = told.collect()
    assert told.columns[: len(odd_docs.columns)] == odd_docs.columns and score == "_score"
    none = [r for r in rows if not re.search(r"[^\W\d_]", r["text"] or "")]
    assert none and all(r[pred] == "und" and r[score] == 0.0 for r in none)
    assert language.language_predictions(spark, no_docs.drop("score")).count() == 0
    right = language.language_predictions(spark, docs).join(docs, "doc_id").where("held_out")
    assert right.where("lang = lang_pred").count() >= 0.95 * right.count()

    model = quality.fit(docs, labels)
    scored, s, _ = quality.score(spark, odd_docs, model)
    by_text = collections.defaultdict(set)
    for r in scored.collect():
        assert 0 <= r[s] <= 1
        by_text[r["text"]].add(r[s])
    assert all(len(v) == 1 for v in by_text.values()) and by_text[None] == by_text[""]
    assert quality.quality_scores(spark, no_docs, labels).count() == 0
    held = quality.quality_scores(spark, docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    assert len(bad) == 0 or np.mean([(good > b).mean() for b in bad]) > 0.9


def test_sentencepiece_parity_and_round_trip(spark, odd_docs, no_docs):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    extra = spark.createDataFrame([(30, "a ▁ b"), (31, "  two  spaces "), (32, "\x00\t\n")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "ids").union(extra.withColumn("ids", F.lit("z")))
    coded, at = sentencepiece_codec.encode(spark, docs, verify="texts")
    back, name = sentencepiece_codec.decode(spark, coded, ids_col=at["ids"])
    for r in back.collect():
        text = r["text"] or ""
        assert r[at["ids"]] == judge.encode(text) and r[at["parity"]]
        assert r[at["round_trip"]] == ("▁" not in text) and r[name] == text.replace("▁", " ")
    assert sentencepiece_codec.encoded_documents(spark, no_docs).count() == 0


def test_lm_base_brute_force_and_gain(spark, odd_docs, no_docs):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text").union(odd_docs.select("doc_id", "text").where("doc_id is null or doc_id <> 2"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in tokens(t)), 4)) for i, t in rows)
    got = lm.score_documents(spark, docs, frequent=500).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    # Unseen prose of the corpus' kind is predicted better than by the unigram.
    out = [r for r in lm.score_documents(spark, table(spark, SF_SMALL, "documents")).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score_documents(spark, no_docs).count() == 0


def test_lm_score_uses_every_count(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").where("doc_id is null or doc_id <> 2").union(table(spark, SF_SMALL, "documents").select("doc_id", "text").limit(60))
    by_table = [sorted(((repr(r.doc_id), r.n_known, r.score) for r in lm.score_documents(spark, docs, frequent=n).collect()), key=lambda r: r[:2]) for n in (0, 200, 1_000_000)]
    for other in by_table[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in by_table[0]]
        assert [r[2] for r in other] == pytest.approx([r[2] for r in by_table[0]], rel=1e-6)


def test_lm_trains_on_every_window(spark, monkeypatch):
    docs = [(i, f"alpha{i % 5} beta gamma " * (1 + i % 7)) for i in range(120)] + [(500, "one long tale of words " * 4000), (501, None), (502, "")]
    docs = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 7 != 2]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    shown, trained = [], spark.sparkContext.accumulator(0)
    train = lm.train_part

    def counted(*args, **kwargs):
        n = train(*args, **kwargs)
        trained.add(n)
        return n

    monkeypatch.setattr(lm, "train_part", counted)
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=lm.MODEL_PATH)
    ids = [sum(len(encoder.encode(w)) for w in words_of_text.split()) + 1 for words_of_text in (t or "" for _, t in docs)]
    step = lm.attention.WINDOW - lm.attention.OVERLAP
    want = sum(max(1, -(-(n - lm.attention.OVERLAP) // step)) for n in ids)
    for seed_ids in (10**9, 5000):
        before = trained.value
        assert lm.score_documents(spark, df, seed_ids=seed_ids).count() == len(docs)
        shown.append(trained.value - before)
    assert shown == [want, want]


def test_quality_prior_does_not_depend_on_the_sample(spark):
    rows = [(i, f"fine prose number {i} about ships", 1) for i in range(600)] + [(1000 + i, f"spam {i} buy buy now", 0) for i in range(150)]
    made = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = made.select("doc_id", "quality")
    seen = [r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    for per_class in (40, 10_000):
        model = quality.fit(made.select("doc_id", "text"), labels, per_class=per_class)
        scored, s, _ = quality.score(spark, spark.createDataFrame([("",)], "text string"), model)
        assert scored.first()[s] == pytest.approx(np.mean(seen), abs=1e-4)
