"""Alignment of two tokenizers against a plain version that encodes every text whole."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from martwright.llm import token_alignment, word_pieces
from martwright.llm.queries import queries
from martwright.llm.word_pieces import tokenizer_file

COLUMNS = "n_a n_b n_groups n_links n_best count_sum".split()


def letters():
    """Printable bytes stand for themselves, the others for letters from 256 on."""
    out, n = {}, 0
    for b in range(256):
        if b in range(33, 127) or b in range(161, 173) or b in range(174, 256):
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


@pytest.fixture(scope="module")
def encode():
    first = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    table = letters()

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def both(text):
        a = [(i, bytes(table[c] for c in first.id_to_token(i)))
             for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in second.encode(text)]
        return a, b

    return both


def plain(rows, encode):
    """For each row its numbers and the groups' text."""
    aligned = []
    for _, text in rows:
        a, b = encode(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            aligned.append(([], [], [], []))
            continue
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, raw in side:
                at += len(raw)
                own.append(at)
            ends.append(own)
        # every token has a byte, so each common end has one token of either side
        common = sorted(set(ends[0]) & set(ends[1]))
        of_a, of_b = ({e: i for (i, _), e in zip(s, es)} for s, es in zip((a, b), ends))
        links, groups, low = [(of_a[e], of_b[e]) for e in common], [], 0
        for end in common:
            groups.append("|".join(
                ",".join(str(s[k][0]) for k in range(bisect_right(es, low), bisect_right(es, end)))
                for s, es in zip((a, b), ends)
            ))
            low = end
        aligned.append((a, b, groups, links))
    counts = Counter(link for *_, links in aligned for link in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (doc_id, len(a), len(b), len(groups), len(links),
         sum(counts[link] == best[link[1]] for link in links), sum(counts[link] for link in links),
         ";".join(groups))
        for (doc_id, _), (a, b, groups, links) in zip(rows, aligned)
    ]


def rows():
    rng = random.Random(11)
    words = ("the of and river stone misunderstandings *** Über été 日本語 x1 !! don't it's 3.14 naïve "
             "👩‍👩‍👧 é \xa0 a\nb\n\nc tab\tin foo(bar) ŝ　t").split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(60)]
    texts += ["", None, " ", "\n", "  two  spaces  ", " lead", "trail ", "x \n y", "▁ mark", "a▁b", "\0 nul",
              "<|endoftext|> <s> </s> <unk> [x]", "the <|endoftext|>of", "<0x41>", "日本語" * 400, "ab" * 4000,
              "́x", "﻿bom"]
    texts += [texts[0]] * 40
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[3]] * 5 + [(None, texts[4]), (None, texts[5]), (9, texts[6])]


@pytest.mark.parametrize("block_bytes, fan", [(1 << 24, 64), (800, 2)])
def test_against_a_plain_version(spark, encode, monkeypatch, block_bytes, fan):
    monkeypatch.setattr(token_alignment, "_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(token_alignment, "_FAN", fan)
    table = [(i, t, 1, "g", 2, "b") for i, t in rows()]
    docs = spark.createDataFrame(
        table, "doc_id long, text string, n_a int, groups string, place int, body string"
    ).repartition(3)
    found = token_alignment.align_tokenizers(docs).collect()
    got = sorted(repr((r.doc_id, *(r[c] for c in COLUMNS), r.groups)) for r in found)
    assert got == sorted(map(repr, plain(rows(), encode)))


def test_small_store(encode, monkeypatch):
    for kept, chars in ((3, 1 << 20), (10**6, 200)):
        monkeypatch.setattr(token_alignment, "KEPT_WORDS", kept)
        monkeypatch.setattr(token_alignment, "KEPT_CHARS", chars)
        aligner = token_alignment.Aligner(
            tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
        )
        texts = [t or "" for _, t in rows()]
        got = []

        def use(units, counts):
            units, counts = token_alignment._of_good_texts(aligner, units, counts)
            for part in np.split(units, np.cumsum(counts)[:-1]):
                got.append("".join(aligner.groups[part].tolist())[:-1])

        for at in range(0, len(texts), 7):
            aligner.apply(texts[at : at + 7], use)
        assert got == [r[-1] for r in plain(rows(), encode)]
        assert len(aligner.at) <= 60 and len(aligner.n_a) == len(aligner.at)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align_tokenizers(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in token_alignment.align_tokenizers(blank).collect()] == [
        (0, 0, 0, 0, 0, 0, "")
    ] * 2


def test_whole_table(spark, small, encode):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries()["op13_token_alignment"](spark, small).collect()}
    assert len(got) == len(docs)
    for doc_id, *numbers, groups in plain(docs, encode):
        assert [got[doc_id][c] for c in COLUMNS] == numbers
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert got[doc_id].groups_sha256 == digest


def test_words_beyond_the_store_never_enter_it(encode, monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_WORDS", 20)
    aligner = token_alignment.Aligner(
        tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    )
    sizes = []
    for at in range(0, 60, 3):
        texts = [f"word{at} word{at + 1}", "the of", f"word{at}x word{at}x"]
        aligner.apply(texts, lambda rows, counts: sizes.append((len(aligner.at), len(rows))))
    assert [n for _, n in sizes] == [6] * 20
    assert 0 < max(kept for kept, _ in sizes) <= 20
    assert len(aligner.n_a) == len(aligner.at) == len(aligner.groups)


@pytest.mark.parametrize("size", [1, 7, 40, 10**6])
def test_words_have_the_same_ids_in_blocks_of_any_size(encode, monkeypatch, size):
    words = [w for w in {w for _, t in rows() for w in (t or "").split(" ")} if w and w.isalnum()]
    words += ["a" * 50, "b"]
    monkeypatch.setattr(word_pieces, "_BLOCK", size)
    monkeypatch.setattr(word_pieces, "_PIECE_BLOCK", size)
    for side, kind, file in ((0, word_pieces.ByteModel, "byte_bpe_50k.json"),
                             (1, word_pieces.PieceModel, "piece_bpe_32k.model")):
        ids, counts = kind(tokenizer_file(file)).encode_words(words)
        got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [[i for i, _ in encode(w)[side]] for w in words]
    blocks = list(word_pieces._blocks(words, size))
    assert [w for block in blocks for w in block] == words and all(blocks)
    assert list(word_pieces._blocks([], size)) == []
