"""Fill-in-middle against a plain version, on texts that span many blocks."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import fill_middle
from martwright.llm.queries import queries

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
COLUMNS = "n form prefix_chars middle_chars output".split()


def plain(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    told = "" if doc_id is None else doc_id
    h = hashlib.sha256(f"42:{told}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(units[x:y]) for x, y in ((0, low), (low, high), (high, n)))
    if h4 % 100 < spm_rate:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def rows():
    rng = random.Random(2)
    parts = ["a", "Über", "日本語", "\t", "\n ", "  ", "x" * 3000, "\r\x0b", "　", "\xa0", "<P", "<", "S>"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 90)))
             for _ in range(150)]
    texts += [None, "", " ", "\n\t ", "one", "one ", " one", "a <M> b", "<S><P>", "é" * 5000, "x" * 1024,
              "x" * 1023 + " y", "x" * 1024 + " y", " " * 4000 + "end"]
    out = [(i, t, "f", "o") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, texts[3], None, None), (7, texts[9], "g", "p")]


def test_against_a_plain_version(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, form string, output string")
    for rate, spm_rate in ((50, 80), (100, 80), (100, 0), (100, 100), (0, 80)):
        made = fill_middle.fill_in_middle(docs.repartition(3), rate, spm_rate)
        back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert all((r.back == r.output) if r.form == "plain" else True for r in back)
        got = sorted(repr((r.doc_id, *(r[c] for c in COLUMNS), r.back)) for r in back)
        want = sorted(repr((i, *plain(i, t, rate, spm_rate), t or "")) for i, t, *_ in rows())
        assert got == want


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_boundaries_in_blocks(block):
    for _, text, *_ in rows()[:60]:
        if not text:
            continue
        raw = text.encode()
        tree = fill_middle.BlockTree(np.frombuffer(raw, np.uint8), block)
        units = UNIT.findall(text)
        assert tree.units == len(units)
        for k in {0, 1, len(units) // 2, len(units)}:
            before = "".join(units[:k])
            assert tree.boundary(k) == (len(before.encode()), len(before))


def test_windows_of_blocks(monkeypatch):
    text = ("日本 x\n" * 500).encode()
    whole = fill_middle.BlockTree(np.frombuffer(text, np.uint8), 16).tree
    monkeypatch.setattr(fill_middle, "_WINDOW", 3)
    assert fill_middle.BlockTree(np.frombuffer(text, np.uint8), 16).tree == whole


def test_empty_table_and_whole_table(spark, small):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries()["op11_fill_middle"](spark, small).collect()
    assert len(got) == len(texts)
    digest = {}
    for r in got:
        n, form, before, middle, output = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, before, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        digest[form] = True
    assert set(digest) == {"plain", "spm", "psm"}
