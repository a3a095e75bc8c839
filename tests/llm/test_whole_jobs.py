"""Inputs beyond the test tables: long texts, many languages, hot ids, frequent words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import language_id, piece_codec, quality, simhash
from martwright.llm.word_pieces import tokenizer_file

LONG = 2 << 20


def filled(word, n):
    return (word * (n // len(word) + 1))[:n]


def test_long_texts_do_not_unlearn_a_language(spark):
    long = [filled(f"river of stone {i} ", LONG) for i in range(8)]
    short = ["a stone by the river"]
    rows = [("bb", t) for t in long + short] + [("cc", filled(f"quartz {i} ", LONG)) for i in range(3)]
    rows += [("aa", "banana bandana")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    first = docs.where("lang = 'bb'").orderBy(F.xxhash64("text")).select(F.length("text")).first()[0]
    assert first == LONG
    model = language_id.fit_languages(docs)
    assert model.languages == ["aa", "bb", "cc"]
    told = model.predict(["banana", "stone river", "quartz 1 quartz"])
    assert told["lang_pred"].tolist() == ["aa", "bb", "cc"]


def test_long_texts_are_scored_in_runs(monkeypatch):
    text = filled("river of stone, banana ", 1000).encode()
    whole = language_id._codes([text])[0]
    monkeypatch.setattr(language_id, "SLICE_BYTES", 64)
    monkeypatch.setattr(language_id, "slices", lambda texts, most: [slice(i, i + 1) for i in range(len(texts))])
    runs = list(language_id._runs([text]))
    assert len(runs) > 1
    assert [c for _, codes, _ in runs for c in codes] == whole.tolist()


def test_every_language_is_learned(spark):
    names = [f"l{i:02}" for i in range(80)]
    texts = {n: filled(f"{chr(0x4E00 + 7 * i)}{chr(0x4E03 + 7 * i)} ", 300 + i) for i, n in enumerate(names)}
    docs = spark.createDataFrame(list(texts.items()), "lang string, text string")
    for options in ({}, {"sample_bytes": 2000, "all_sample_bytes": 80 * 100}):
        model = language_id.fit_languages(docs, **options)
        assert model.languages == names
        found = language_id.predict_languages(docs.withColumnRenamed("lang", "doc_id"), model)
        assert {r.doc_id: r.lang_pred for r in found.collect()} == {n: n for n in names}


def test_documents_of_other_languages_go(spark):
    english, french = "a stone by the river and the sea ", "une pierre dans la rivière et la mer "
    greek = "Ελληνικά είναι μια γλώσσα που μιλιέται στην Ελλάδα και στην Κύπρο. "
    rows = [(i, filled(english, 300 + i), "en", "part") for i in range(20)]
    rows += [(100 + i, filled(french, 300 + i), "fr", None) for i in range(20)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string"))
    asked = [(200, english, None, None), (200, english, None, None), (201, french, "en", "x"),
             (202, greek * 3, "el", None), (203, None, "en", None), (204, "12 34", None, None),
             (None, french * 9, None, None), (205, "", None, None)]
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang string, fits string")
    kept = language_id.keep_languages(docs, model)
    assert kept.columns == docs.columns
    want = [(200, english, "en", None)] * 2 + [(201, french, "en", "x"), (None, french * 9, "fr", None)]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
    only = language_id.keep_languages(docs, model, wanted=["en"]).collect()
    assert [r.doc_id for r in only] == [200, 200]
    sure = language_id.keep_languages(docs.drop("lang"), model, least_score=0.999999)
    assert {r.doc_id for r in sure.collect()} <= {200, 201, None}
    none = language_id.keep_languages(docs, language_id.fit_languages(docs.limit(0)))
    assert none.count() == 0 and language_id.keep_languages(docs.limit(0), model).count() == 0


def test_one_fingerprint_for_each_text_and_one_row_for_each_group(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text, "a"), (5, text, "a"), (5, text + " end", "b"), (2, "other words here now", "c"),
            (None, text, "d"), (None, "quite another text of its own", "e"), (9, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    docs = docs.union(docs.where("fingerprint = 'a'").crossJoin(spark.range(40).select())).repartition(4)
    kept = simhash.keep_first(docs)
    # the stored hashes decide: texts are not fingerprinted again
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()
    got = sorted(kept.collect(), key=repr)
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 4 and linked[5] == 5
    assert {r.doc_id for r in got} == {5, 2, None, 8}


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(tokenizer_file("piece_bpe_32k.model"))


def test_each_occurrence_of_a_word_draws_by_itself(codec):
    ids, counts = codec.encode(["information"] * 4000, np.arange(4000), 1, 0.1)
    assert len(set(map(tuple, np.split(ids, np.cumsum(counts)[:-1])))) > 20
    plain, n = codec.encode(["of"], np.arange(1), 1, 0.0)
    assert n.tolist() == [1]
    ids, counts = codec.encode(["of " * 1000], np.arange(1), 1, 0.1)
    # both merges kept, or both after the first one was skipped and another way was found
    assert 850 < (ids == plain[0]).sum() < 930


def test_shared_rows_give_what_single_ones_give(codec):
    words = ["▁the", "▁information", "▁a", "▁misunderstandings", "▁日本x", "▁" + "banana" * 12]
    index = np.random.default_rng(3).integers(0, len(words), 600)
    index[: len(words)] = np.arange(len(words))
    keys = piece_codec.mix(np.arange(600, dtype=np.uint64))
    for dropout in (0.1, 0.5, 1.0):
        ids, counts, which = codec.segment(words, index, keys, dropout)
        ends = np.cumsum(counts)
        for i, word in enumerate(index):
            alone, _, _ = codec.segment([words[word]], np.zeros(1, int), keys[i : i + 1], dropout)
            assert ids[ends[which[i]] - counts[which[i]] : ends[which[i]]].tolist() == alone.tolist()


def test_copies_and_absent_ids_do_not_use_up_the_labels(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(40))) for i in range(60)]
    bad = [(100 + i, "### $$$ &&& " * (20 + i)) for i in range(60)]
    rows = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]
    labels = spark.createDataFrame(rows + [(i, 1) for i in range(1000, 9000)], "doc_id long, quality int")
    once = spark.createDataFrame(good + bad, "doc_id long, text string")
    hot = once.join(labels, "doc_id").orderBy(F.xxhash64("doc_id")).limit(1).drop("quality")
    docs = once.union(hot.crossJoin(spark.range(500).select()))
    model = quality.fit_quality(docs, labels, sample_rows=150)
    verdicts = {r.doc_id: r.score for r in quality.quality_verdicts(once, model).collect()}
    assert len(model.forest.roots)
    assert min(verdicts[i] for i, _ in good) > 0.5 > max(verdicts[i] for i, _ in bad)
    same = quality.fit_quality(once, labels, sample_rows=150).forest
    assert (same.value == model.forest.value).all()
