"""Byte-level BPE and packing against the tokenizers' libraries."""

import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from basalt.llm import byte_bpe, packing, vocab

ODD = ["", " ", "it's 's't ''s ' s don't've 'll'l I'LL", "\n's \t'd", "12 ab12 1", "İ Σας ΑΣ é", "日本語 🙂👍🏽", "a" * 300, "\x1c x\x85y", "<|endoftext|> a", "x\n's", "  'll", " \n ", "ab" * 90]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice(["'", "s", "re", "ll", " ", "  ", "\n", "1", ".", "..", "é", "Ab", "the", "漢"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, make_docs, texts, reference):
    rows = list(enumerate(texts)) + [(None, "x"), (9999, None), (3, texts[3])]
    got = byte_bpe.encode_documents(make_docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_fold_by_higher_order_functions(spark, reference):
    words = ["hello", " theory", "ab", "a", "naïve", " loweiß"]
    got = byte_bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), P.path("byte_bpe_50k.tiktoken")).collect()
    assert {r["word"]: list(r["ids"]) for r in got} == {w: reference.encode_ordinary(w) for w in words}


def test_long_words_fold_alike(reference):
    merges = vocab.ranked_merges(P.path("byte_bpe_50k.tiktoken"))
    for w in ["ab" * 60, "thethere" * 20, "xyzzy" * 30]:
        assert merges.fold([w.encode()])[0].tolist() == merges.fold_long(w.encode()).tolist() == reference.encode_ordinary(w)


def test_pieces_and_packing(spark, make_docs, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    rows = list(enumerate(texts)) + [(5000, "word " * 700), (5001, None), (5000, "word " * 700)]
    got = packing.pack_documents(make_docs(spark, rows), P.path("word_bpe_49k.json"), capacity=256).collect()
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], "<u4")
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 256
    assert len(by) <= 1.02 * sum(k[3] * c for k, c in want.items()) / 256 + 1
    assert packing.pack_documents(make_docs(spark, []), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(512, max(1, int(rng.lognormvariate(4, 1.2)))) for _ in range(3000))
    plan = packing.pack_histogram(dict(counts), 512)
    assert all(sum(n) <= 512 and c > 0 for n, c in plan)
    placed = Counter()
    for lengths, times in plan:
        for n in lengths:
            placed[n] += times
    assert placed == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(c for _, c in plan) <= 1.01 * -(-total // 512) + 1


def test_nnls_is_optimal():
    rng = np.random.default_rng(4)
    a, b = rng.random((20, 12)), rng.random(20)
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient >= -1e-6).all() and abs(gradient @ x) < 1e-6


@pytest.mark.parametrize("seed", [0, 1])
def test_long_texts_equal_the_libraries(reference, seed):
    rng = random.Random(seed)
    text = " ".join(rng.choice(["word", "don't", "Ünïcode", "12", "x\n\ny", "漢字", "...", "two  spaces", "e\u0301"]) for _ in range(400_000))
    assert len(text) > 2 * vocab.TOKEN_CHUNK
    ids = vocab.byte_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)([text, "short"])
    assert ids[0].tolist() == reference.encode_ordinary(text) and ids[1].tolist() == reference.encode_ordinary("short")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    assert vocab.word_encoder(P.path("word_bpe_49k.json"))([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
