"""Operators against plain versions on small tables, and their defined results at the edges."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from martwright.llm import (
    boosted_trees,
    fingerprints,
    language_id,
    packing,
    piece_codec,
    quality,
    simhash,
    suffix_dedup,
    token_counts,
    token_files,
    url_filter,
)
from martwright.llm.induced_sort import permuted_prefixes, suffix_array
from martwright.llm.perfect_hash import KeySlots
from martwright.llm.queries import URL_RULES, queries
from martwright.llm.word_pieces import load_model, tokenizer_file

SCHEMA = ("doc_id long, text string, lang string, fingerprint int, part int, doc string, row int,"
          " n_chars long")
WORDS = "the of and in to a river stone *** Über été 日本 x1 !!".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(0, 60)) for _ in range(60)]
    texts += [texts[3], texts[3] + " end", texts[4] + "\n" + texts[5], "", " \n\t", "a" * 30_000]
    texts += [sentence(rng, 3000), None, "<s> <|endoftext|> ▁ \0 x  y\n z "]
    out = [(2 * i, t, "xx", 1, 2, "d", 3, 4) for i, t in enumerate(texts)]
    return [*out, out[7], out[7], (None, texts[8], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = language_id.fit_languages(none)
    assert model.languages == []
    assert language_id.predict_languages(none, model).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first(none).count() == 0
    assert suffix_dedup.repeat_report(none).count() == 0
    assert suffix_dedup.drop_repeats(none).columns == none.columns
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert quality.quality_verdicts(none, quality.fit_quality(none, labels)).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    files = token_files.write_token_files(none)
    assert token_files.read_checks(files, token_files.document_keys(none)).count() == 0
    assert piece_codec.decode_pieces(piece_codec.encode_pieces(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, URL_RULES).count() == 0


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows):
    prints = [plain_simhash(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = sorted(
        (str(r[0]), f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints, strict=True))
    )
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(kept) == sorted(set(least.values()))


@pytest.mark.parametrize("most", [4096, 8])
def test_links_of_dense_groups(spark, most):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1
              for c in centres for _ in range(12)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    links = simhash.fingerprint_links(frame, 4, most).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)

    def groups(pairs):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[find(a)] = find(b)
        found = {}
        for v in signed:
            found.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, found.values()))

    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i]
             if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert groups(links) == groups(every)


def test_position_sets_cover():
    from itertools import combinations

    sets = simhash.position_sets(4, 3)
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))


def test_urls(spark):
    urls = [
        "http://a.Example.ORG/es/x", "https://example.org/en/196/", "http://org/", "x.org/es/", None,
        "http://sub.example.com/de/1?x", "http://com/fr/", "http://a.org?q=/", "s://h.org#/", "http://",
        "a://b.org/c://d.com/de/", "http://notexample.org/es/", "http://www.example.org/es/1",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0]])] + [(0, urls[0])],
                                  "page_id long, url string").withColumn("host", F.lit("x"))

    def judge(url):
        rest = url.partition("://")[2] if url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), rest[end:].partition("?")[0].partition("#")[0]
        fits = [r for r in URL_RULES
                if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    got = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(urls) + 2
    for row in got:
        assert tuple(row)[1:] == judge([*urls, urls[0]][row.page_id])
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_language_code_lengths():
    import pandas as pd

    texts = {"aa": b"banana bandana", "bb": b"river of stone"}
    counts = {}
    for lang, text in texts.items():
        whole = b"\n\n\n" + text
        for i in range(3, len(whole)):
            for k in range(1, 5):
                key = lang, k, int.from_bytes(whole[i - k + 1 : i + 1], "big")
                counts[key] = counts.get(key, 0) + 1
    model = language_id.build_model(
        pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "length", "code", "n"])
    )

    def bits(lang, context, byte):
        if context is None:
            return 8.0
        of = {k[2] & 255: n for k, n in counts.items()
              if k[0] == lang and k[1] == len(context) + 1 and k[2] >> 8 == int.from_bytes(context, "big")}
        shorter = context[1:] if context else None
        if not of:
            return bits(lang, shorter, byte)
        total = sum(of.values()) + len(of)
        if byte in of:
            return -np.log2(of[byte] / total)
        return -np.log2(len(of) / total) + bits(lang, shorter, byte)

    tested = [b"banner stone", b"xyz", b"", b"river of stone"]
    got = model.code_lengths(tested)
    for row, text in zip(got, tested, strict=True):
        whole = b"\n\n\n" + text
        want = [sum(bits(lang, whole[i - 3 : i], whole[i]) for i in range(3, len(whole)))
                for lang in ("aa", "bb")]
        assert np.allclose(row, want)


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = queries()["op3_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    row = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] > 0.98
    model = language_id.fit_languages(docs.limit(0).withColumn("text", F.lit("")))
    assert model.predict(["abc", None])["lang_pred"].tolist() == ["und", "und"]


@pytest.mark.parametrize("symbols", [1, 2, 3, 300, 5000])
def test_suffix_arrays(symbols):
    rng = random.Random(symbols)
    for _ in range(150):
        text = [rng.randrange(symbols) for _ in range(rng.randint(0, 50))] * rng.choice([1, 1, 3])
        array = suffix_array(np.array(text, np.int64))
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if not text:
            continue
        shared = permuted_prefixes(np.array(text), array)
        for a, b in zip(array[1:], array, strict=False):
            n = 0
            while n < len(text) - max(a, b) and text[a + n] == text[b + n] != 0:
                n += 1
            assert shared[a] == n


@pytest.mark.parametrize(("length", "large"), [(100, 10**6), (12, 10**6), (12, 2)])
def test_repeated_passages(spark, length, large):
    rng = random.Random(length)
    lines = [sentence(rng, 20) for _ in range(8)]
    texts = [" ".join(rng.choice(lines)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 5)))
             for _ in range(80)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "ab" * 400, "ab" * 300, "é" * 90])]
    seen, want = set(), {}
    for i, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for at in range(len(body) - length + 1):
            piece = body[at : at + length]
            if piece in seen:
                gone[at : at + length] = True
            seen.add(piece)
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = len(body), int(gone.sum()), spans, kept
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("blob", F.lit("x"))
    got = suffix_dedup.remove_repeats(docs, ["doc_id"], length, large=large).collect()
    assert {r.row.doc_id: tuple(r)[1:] for r in got} == want
    cut = suffix_dedup.drop_repeats(docs, length).collect()
    assert {r.doc_id: r.text or "" for r in cut} == {
        i: k.decode("utf-8", "ignore") for i, (n, gone, _, k) in want.items() if not gone or k
    }


def test_repeats_at_the_edges(docs, rows):
    got = suffix_dedup.repeat_report(docs).collect()
    assert len(got) == len(rows)
    twice = {tuple(r) for r in got if r.doc_id == rows[7][0]}
    assert len(twice) == 1


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_documents(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    want = []
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        want.append((order[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, want))
    assert len({r.fingerprint for r in got if r.doc_id == rows[7][0]}) == 1


def test_likeness_follows_jaccard():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    for share in (0.2, 0.5, 0.8):
        a = [rng.choice(words) for _ in range(2000)]
        b = a[: int(2000 * share)] + [rng.choice(words) for _ in range(2000 - int(2000 * share))]
        x, y = (set(fingerprints.shingle_hashes(" ".join(t)).tolist()) for t in (a, b))
        prints = fingerprints.fingerprints([" ".join(a), " ".join(b)])
        near = fingerprints.likeness(prints[:1], prints[1:])[0]
        assert abs(near - len(x & y) / len(x | y)) < 0.13
    empty = fingerprints.fingerprints(["", " "])
    assert not empty.any() and fingerprints.likeness(empty[:1], empty[1:])[0] == 1


def test_packing_fills_bins_without_loss(docs, rows):
    got = packing.pack_documents(docs, (64, 128, 512)).collect()
    tokens = sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert sum(r.length for r in got) == tokens
    bins = {}
    for r in got:
        bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), items in bins.items():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity and capacity == min(c for c in (64, 128, 512) if c >= end)


def test_packing_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        sizes = rng.choice([(16,), (8, 16, 32), (5, 7, 30)])
        items = sorted((rng.randint(1, max(sizes)) for _ in range(rng.randint(1, 50))), reverse=True)
        histogram = {k: items.count(k) for k in items}
        bins, opened = [], {}
        for k in items:
            fit = min((c - u, i) for i, (c, u) in enumerate(bins) if c - u >= k) if any(
                c - u >= k for c, u in bins) else None
            if fit:
                bins[fit[1]][1] += k
                continue
            if k not in opened:
                left = {x: n for x, n in histogram.items() if x <= k}
                opened[k] = min((c for c in sizes if c >= k), key=lambda c: (
                    (c + 2) / packing._filled(c, k, sorted(left), left), c))
            bins.append([opened[k], k])
        plan = packing.plan_bins(histogram, sizes, 2)
        lengths = np.repeat(list(histogram), list(histogram.values()))
        ranks = np.concatenate([np.arange(n) for n in histogram.values()])
        placed = packing._places(plan, lengths, ranks)
        loads = sorted(zip(placed.groupby("bin_id")["capacity"].first(),
                           placed.assign(n=lengths).groupby("bin_id")["n"].sum(), strict=True))
        assert loads == sorted((min(c for c in sizes if c >= u), u) for _, u in bins)


def test_quality_counts(docs, rows):
    model = quality.QualityModel(boosted_trees.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    got = quality.quality_verdicts(docs, model).collect()
    for row in got:
        text = next(r[1] for r in rows if r[0] == row.doc_id) or ""
        words = text.encode().split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} \
            if len(words) < 500 else None
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert (row.n_words, row.word_chars) == (len(words), sum(len(w.decode()) for w in words))
        assert row.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert row.n_dup_lines == len(lines) - len(set(lines))
        if twice is not None:
            assert row.n_repeat_words == len(twice)
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)


def test_trees_keep_monotone_order():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(20 * x[:, 1]) + rng.normal(0, 0.2, 3000) > 0).astype(float)
    forest = boosted_trees.fit(x, y, {1: -1})
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    grid = np.column_stack([np.repeat(x[:50, 0], 40), np.tile(np.linspace(0, 1, 40), 50), np.repeat(x[:50, 2], 40)])
    assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash(n):
    keys, copies = np.arange(n) * 7 - 50, np.arange(n) % 3
    found, slots = KeySlots.build(keys, copies)
    assert sorted(slots.tolist()) == list(range(n))
    again, _ = KeySlots.from_bytes(found.to_bytes())
    assert (again.find(keys, copies) == slots).all()
    assert (again.find(keys + 10**9, copies) == -1).all()


def test_token_files_round_trip(docs, rows):
    model = load_model(tokenizer_file("byte_bpe_50k.json"))
    files = token_files.write_token_files(docs)
    got = token_files.read_checks(files, token_files.document_keys(docs)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for r in order:
        ids = [*model.encode(r[1] or ""), 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    opened = token_files.TokenFiles.open(files.folder)
    assert opened == files
    files.delete(docs.sparkSession)


@pytest.mark.parametrize("frequent", [0, 60, token_counts.FREQUENT])
@pytest.mark.parametrize("tokenizer", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(docs, rows, tokenizer, frequent, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)  # none, some, all of this small table
    model = load_model(tokenizer_file(tokenizer))
    got = token_counts.count_tokens(docs, tokenizer, limit=50).collect()
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1])) if r[1] else 0) for r in rows]
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)


def test_pretokens_are_counted_once(spark, docs, rows):
    file = tokenizer_file("byte_bpe_50k.json")
    model = load_model(file)
    found = token_counts.distinct_pretokens(docs, file).collect()
    split = [r[1] for r in rows if r[1] and model.splits(r[1])]
    want = {}
    for text in split:
        for i, word in enumerate(text.split(" ")):
            word = " " * (i > 0) + word
            want[word] = want.get(word, 0) + 1
    assert {r.word: r.n for r in found} == want and len(found) == len(want)
    assert all(r.pieces == len(model.encode(r.word)) for r in found)


def test_frequent_pretokens_are_bounded(spark, monkeypatch):
    rows = [("a", 500, 1), ("b", 200, 2), ("c" * 200, 460, 9), ("d" * 100, 4, 3), ("e", 1, 1)]
    words = spark.createDataFrame(rows, "word string, n long, pieces long")
    # in order of occurrences for each 64 bytes begun: a, b, c (four units), d (two), e
    for most, want in ((0, ""), (1, "a"), (2, "ab"), (5, "ab"), (6, "abc"), (8, "abcd"), (9, "abcde")):
        monkeypatch.setattr(token_counts, "FREQUENT", most)
        assert {
            w[0] for w in token_counts._frequent(words, token_counts._least_step(words))
        } == set(want)


def test_copies_of_a_row_in_many_parts(spark):
    rows = [(1, "the river of stone")] * 300 + [(2, None)] * 50 + [(1, "a stone")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = token_counts.count_tokens(docs)
    model = load_model(tokenizer_file("piece_bpe_32k.model"))
    want = {t: len(model.encode(t)) if t else 0 for _, t in rows}
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted(
        (i, want[t]) for i, t in rows)


def test_pieces_decode_to_the_text(docs):
    for dropout in (0.0, 0.3):
        encoded = piece_codec.encode_pieces(docs, dropout=dropout)
        assert piece_codec.decode_pieces(encoded).where("decoded != text").count() == 0
    same = piece_codec.encode_pieces(docs, dropout=0.3).select("doc_id", F.xxhash64("ids").alias("h"))
    again = piece_codec.encode_pieces(docs.repartition(2), dropout=0.3).select("doc_id", F.xxhash64("ids").alias("h"))
    assert same.exceptAll(again).count() == 0
    other = piece_codec.encode_pieces(docs, dropout=0.3, seed=99).select("doc_id", F.xxhash64("ids").alias("h"))
    assert same.exceptAll(other).count() > 0


def test_pieces_without_dropout_are_the_librarys():
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    rng = random.Random(2)
    texts = ["", " ", "a" * 300, *("".join(rng.choice(" \n\t ab'1!é日the") for _ in range(20)) for _ in range(500))]
    ids, counts = piece_codec.PieceCodec(file).encode(texts, np.arange(len(texts)), 1, 0.0, 3)
    each = np.split(ids, np.cumsum(counts)[:-1])
    assert [e.tolist() for e in each] == [library.encode(t) for t in texts]
