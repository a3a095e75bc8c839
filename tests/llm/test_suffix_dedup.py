"""Repeated passages: long runs, scan borders, hot anchors, many parts."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import common, induced_sort, suffix_dedup
from martwright.llm.induced_sort import permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string"


def plain(rows, length):
    """doc_id, n_bytes, n_removed and n_spans by looking up every string."""
    seen, covers = {}, {}
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    texts = [(key, (t or "").encode()) for *key, t in order]
    for key, raw in texts:
        for at in range(len(raw) - length + 1):
            place = (tuple(key), at)
            string = raw[at : at + length]
            seen[string] = min(seen.get(string, place), place)
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - length + 1):
            if seen[raw[at : at + length]] < ((i is None, i or 0), at):
                gone[at : at + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        covers.setdefault((i, t), (i, len(raw), int(gone.sum()), spans))
    return sorted(repr(covers[i, t]) for i, t in rows)


def report(spark, rows, length):
    found = suffix_dedup.repeat_report(spark.createDataFrame(rows, SCHEMA).repartition(4), length)
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans)) for r in found.collect())


@pytest.mark.parametrize("parts", [False, True])
def test_many_parts_and_borders(spark, monkeypatch, parts):
    if parts:
        for name, value in (("_BUCKET_BYTES", 900), ("_BLOCK_BYTES", 700), ("_SHARD_BYTES", 60),
                            ("_SCAN", 64), ("_CHUNK", 200)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (12, 30, 31, 70, 200)]
    texts = ["".join(rng.choice([*passages, rng.choice("xyz"), "a" * rng.randint(1, 40)])
                     for _ in range(rng.randint(0, 7))) for _ in range(90)]
    texts += ["a" * 500, "b" + "a" * 300, None, "", "ab" * 150, texts[0], texts[0]]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(3, texts[1]), (None, texts[4]), (None, "q" * 60)]
    assert report(spark, rows, 30) == plain(rows, 30)


def test_runs_of_one_symbol_are_induced_in_one_step():
    for text in (np.full(1 << 20, 98), np.concatenate([np.full(1 << 19, 5), [3], np.full(1 << 19, 5), [2]])):
        start = time.time()
        array = suffix_array(text)
        shared = permuted_prefixes(text, array)
        assert time.time() - start < 5
        if len(set(text.tolist())) == 1:
            assert (array == np.arange(len(text))[::-1]).all()
            assert (shared[:-1] == np.arange(len(text) - 1, 0, -1)).all()


@pytest.mark.parametrize("seed", range(6))
def test_arrays_of_runs(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        text = np.repeat(rng.integers(0, 4, rng.integers(0, 25)), 1)
        text = np.repeat(text, rng.integers(1, 7, len(text)))
        array = suffix_array(text)
        whole = text.tolist()
        assert array.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])


def test_one_repeated_byte_of_a_mebibyte(spark):
    rows = [(1, "a" * (1 << 20)), (2, "start " + "a" * 700), (3, "b" * 99)]
    start = time.time()
    got = report(spark, rows, 100)
    assert time.time() - start < 60
    # of the first text only the first string stays; the second one keeps what a run does not cover
    assert got == sorted(map(repr, [(1, 1 << 20, (1 << 20) - 1, 1), (2, 706, 700, 1), (3, 99, 0, 0)]))


def test_a_phrase_in_a_third_of_all_rows(spark):
    rng = random.Random(9)
    phrase = "this phrase of sixty bytes and some more stands in many texts"
    rows = [(i, "".join(rng.choice("pqrstuv") for _ in range(90)) + (phrase if i % 3 == 0 else "")
             + "".join(rng.choice("pqrstuv") for _ in range(90))) for i in range(300)]
    assert report(spark, rows, 70) == plain(rows, 70)
    assert report(spark, rows, 40) == plain(rows, 40)


def test_passages_across_the_scan_border(spark):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400))
    border = suffix_dedup._SCAN
    long = "".join(rng.choices("ijklmnop", k=border - 150)) + passage + "".join(rng.choices("qrstuvwx", k=900))
    rows = [(1, passage + " first"), (2, long), (3, "then " + passage), (4, long[border - 60 : border + 60])]
    assert report(spark, rows, 100) == plain(rows, 100)


def test_short_texts_read_together(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(60)]
    alone = [suffix_dedup._long_snippets(t, 20) if len(t) >= 20 else None for t in texts]
    for chunk in (1, 50, 300, 10**6):
        monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
        for own, one in zip(suffix_dedup.snippets(texts, 20), alone, strict=True):
            assert (one is None and not len(own[0])) or all(map(np.array_equal, own, one))


@pytest.mark.parametrize("seed", range(4))
def test_texts_of_many_names_are_sorted_by_doubled_prefixes(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    for kinds in (1, 2, 50, 4000):
        text = np.tile(rng.integers(0, kinds, rng.integers(2, 300)), rng.integers(1, 4))
        whole = text.tolist()
        plainly = sorted(range(len(whole)), key=lambda i: whole[i:])
        assert induced_sort._by_doubling(text).tolist() == plainly
        for symbols in (3, 1024):  # names go one way or the other
            monkeypatch.setattr(induced_sort, "_ARRAY_SYMBOLS", symbols)
            assert suffix_array(text).tolist() == plainly


def test_two_records_stay_of_each_key_and_block():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 400):
        key = rng.integers(0, 40, n).astype(np.uint64)
        doc, start = rng.integers(-20, 20, n), rng.integers(0, 3, n)
        kept = suffix_dedup._at_most_two(key, doc, start, 3)
        table = list(zip(key.tolist(), suffix_dedup._block(doc, 3).tolist(), doc.tolist(), start.tolist()))
        wanted = []
        for place in {row[:2] for row in table}:
            wanted += sorted(row for row in table if row[:2] == place)[:2]
        assert sorted(row for row, k in zip(table, kept) if k) == sorted(wanted)


def test_documents_are_dealt_to_blocks_without_python(spark):
    ids = [0, 1, -1, 7, (1 << 31) - 1, 1 << 31, (1 << 63) - 1, -(1 << 63), 999_999_999_999]
    docs = spark.createDataFrame([(i, "some text") for i in ids], SCHEMA)
    for blocks in (1, 7, 6000):
        column = suffix_dedup._block_of(F.col("doc_id"), blocks)
        got = docs.select("doc_id", column.alias("block")).collect()
        assert {r.doc_id: r.block for r in got} == dict(
            zip(ids, suffix_dedup._block(np.array(ids), blocks).tolist())
        )
    plan = suffix_dedup.remove_repeats(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_texts_move_compressed(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=k)) for k in (0, 1, 80, 600, 3000) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), SCHEMA)
    rows = suffix_dedup._rows(docs, "doc_id", "text")
    notes = spark.createDataFrame([], "place int, blob binary")
    met = suffix_dedup._meet(notes, rows, 3)
    kinds = [f.name for f in met.schema if f.dataType.simpleString() == "binary"]
    moved = met.select([F.sum(F.octet_length(c)) for c in kinds]).first()
    assert sum(n or 0 for n in moved) < 0.7 * sum(map(len, texts))
    # and come out whole, on either side of the size from which they are compressed
    edge = suffix_dedup._LONG_TEXT
    rows = list(enumerate([*texts, None, *(texts[-1][:n] for n in (edge - 1, edge, edge + 1))]))
    assert report(spark, rows, 40) == plain(rows, 40)


def test_a_text_moves_once_beside_its_other_columns(spark, monkeypatch):
    """Of the columns of the documents the text is not among those that go along."""
    own = suffix_dedup.remove_repeats
    kept = []
    monkeypatch.setattr(
        suffix_dedup, "remove_repeats", lambda docs, keep, *more: kept.extend(keep) or own(docs, keep, *more)
    )
    body = "words that stand here and again, é " * 30
    rows = [(1, 10, body), (2, None, None), (3, 0, ""), (None, 7, "short"), *[(4, 5, "x" + body)] * 2]
    docs = spark.createDataFrame(rows, "doc_id long, text_ int, text string")
    cut = suffix_dedup.drop_repeats(docs, 30)
    assert "text" not in kept
    assert cut.columns == docs.columns
    assert [f.dataType for f in cut.schema] == [f.dataType for f in docs.schema]
    got = {tuple(r)[:2]: r.text for r in cut.collect()}
    assert got[2, None] is None and got[3, 0] == "" and got[None, 7] == "short"
    assert got[4, 5] == "x" and len(got[1, 10]) < len(body)


def test_shuffles_leave_the_disk_when_their_rows_are_stored(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdefgh", k=4000)) + "a passage that repeats " * 3) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    disks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(str(f)) for f in disks.localDirs()]

    def shuffled():
        return {f: f.stat().st_size for folder in folders for f in folder.rglob("shuffle_*.data")}

    before, setting = shuffled(), spark.conf.get(common._DROP_SHUFFLES)
    runs = suffix_dedup.repeated_runs(docs, 40)
    for _ in range(50):  # removed in the background
        left = sum(size for f, size in shuffled().items() if f not in before)
        if left < 1000:
            break
        time.sleep(0.2)
    assert left < 1000  # of the sum of text lengths
    assert spark.conf.get(common._DROP_SHUFFLES) == setting
    assert runs.count() >= 59
