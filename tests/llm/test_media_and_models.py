"""AVI files, toxicity and nearest neighbours."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from basalt.llm import avi, graph_ann, toxicity


@pytest.mark.parametrize("text", ["", None, "x", "é" * 288, "abc " * 900, "\xff" * 600])
def test_avi_round_trip(text):
    raw, units = avi.payload(text)
    assert len(units) % 576 == 0 and len(units) > 0
    media = avi.write_avi(avi.encode_frames(units))
    index, micros = avi.read_index(media)
    assert micros == 40_000 and avi.decode_frames(media, index).tobytes() == units.tobytes()


def test_avi_of_all_bytes_and_damage():
    units = np.random.default_rng(0).integers(0, 256, 576 * 9).astype(np.uint8)
    media = avi.write_avi(avi.encode_frames(units))
    assert (avi.decode_frames(media, avi.read_index(media)[0]).ravel() == units).all()
    with pytest.raises(ValueError):
        avi.read_index(media[:300] + b"x" * 40)
    with pytest.raises(ValueError):
        avi.read_index(b"no file")
    with pytest.raises(ValueError):
        avi.encode_frames(units[:10])


def test_shots_and_clips(spark, make_docs):
    low, high = np.zeros((10, 576), np.uint8), np.full((10, 576), 200, np.uint8)
    assert avi.shots(np.concatenate([low, high, low])) == [0, 10, 20]
    got = avi.clips(avi.media_column(make_docs(spark, [(1, "a" * 576 * 12 + "\u00ff" * 288 * 12), (2, None)]))).orderBy("doc_id", "clip").collect()
    assert [(r["doc_id"], r["first_frame"], r["frames"], r["start_ms"], r["end_ms"]) for r in got] == [(1, 0, 12, 0, 480), (1, 12, 12, 480, 960), (2, 0, 1, 0, 40)]


@pytest.mark.parametrize("lengths", [(1, 1), (2, 1), (1, 3), (2, 2), (3, 4), (1, 11), (11, 1), (20, 3, 20), (2, 2, 2), (3, 5, 2), (9, 1, 9)])
def test_shots_of_short_files_edges_and_close_cuts(lengths):
    frames = np.concatenate([np.full((k, 576), 200 * (i % 2), np.uint8) for i, k in enumerate(lengths)])
    assert avi.shots(frames) == [0, *np.cumsum(lengths)[:-1].tolist()]


def test_padding_and_chance_are_no_shots():
    rng = np.random.default_rng(2)
    for n in (577, 600, 1100, 576 * 4 + 3, 576 * 30 + 50):
        raw = rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
        assert avi.shots(avi.payload(raw)[1].reshape(-1, 576)) == [0]


def test_media_digests(spark, make_docs, odd_rows):
    got = avi.media_digests(make_docs(spark, odd_rows)).collect()
    want = []
    for i, t in odd_rows:
        raw, units = avi.payload(t)
        want.append((i, len(raw), len(units), hashlib.sha256(units.tobytes()).hexdigest(), zlib.crc32(units.tobytes()[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_feature_lists_all_shots(spark, make_docs):
    text = "".join(("a" * 576, "\u00ff" * 288)[k // 8 % 2] for k in range(640))
    (row,) = avi.media_digests(make_docs(spark, [(1, text)])).collect()
    assert f"shots={','.join(map(str, range(0, 640, 8)))};n_shots=80" in row["feature"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    texts, toxic = [], []
    for k in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if k % 3 == 0:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vileness", "vilest"]))
        texts.append(" ".join(w))
        toxic.append(int(k % 3 == 0))
    return toxicity.fit_texts(texts[:600], np.array(toxic[:600]), 1 / 3), texts[600:], np.array(toxic[600:])


def test_held_out_accuracy_and_spans(spark, make_docs, model):
    m, texts, toxic = model
    got = toxicity.tag_documents(make_docs(spark, list(enumerate(texts))), m).orderBy("doc_id").collect()
    assert np.mean(np.array([r["predicted"] for r in got]) == toxic) > 0.97
    words = {texts[r["doc_id"]][s["start"] : s["stop"]] for r in got for s in r["spans"]}
    assert words and words <= {"nasty", "vileness", "vilest"}


def plain_scores(m, text):
    """Marginals of all words and the document's score, a word at a time."""
    begin, _, own, _, names = toxicity.words([text])
    where, weight = m.found(names)
    n = len(begin)
    e, f = np.full(n, m.bias), np.isin(np.arange(n), where)
    e[where] += weight
    e[1:] += m.near[0] * f[:-1]
    e[:-1] += m.near[1] * f[1:]
    a = np.exp(m.moves)
    forward, state = [], np.array([1.0, 0.0])
    for x in e:
        state = (state @ a) * [1, np.exp(x)]
        state = state / state.sum()
        forward.append(state)
    backward = [np.ones(2)]
    for x in e[:0:-1]:
        y = a @ (backward[-1] * [1, np.exp(x)])
        backward.append(y / y.sum())
    both = np.array(forward) * np.array(backward[::-1])
    p = both[:, 1] / both.sum(axis=1)
    scored = p[f | np.append(False, f[:-1]) | np.append(f[1:], False)]
    x = np.array([1, np.log1p(scored.sum()), scored.max(initial=0)]) @ m.logistic
    return p, 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def test_scores_equal_plain_forward_backward(spark, make_docs, model):
    m, texts, _ = model
    odd = ["ab " * 7 + "nasty cd vilest " + "ef " * 40 + "vileness nasty nasty", "nasty", "Nasty VILEST", "plain ab", "x " * 200_000 + "nasty " + "ab cd " * 60_000 + "vilest nasty"]
    got = {r["doc_id"]: r for r in toxicity.tag_documents(make_docs(spark, list(enumerate(odd + texts[:40]))), m).collect()}
    for i, text in enumerate(odd + texts[:40]):
        p, score = plain_scores(m, text)
        assert abs(got[i]["score"] - score) < 1e-6
        begin, end, *_ = toxicity.words([text])
        assert {(s["start"], s["stop"]) for s in got[i]["spans"]} == {(int(begin[k]), int(end[k])) for k in np.flatnonzero(p > 0.5)}


def test_toxicity_edges(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(4, 1, 1), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    docs = make_docs(spark, odd_rows)
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert toxicity.scores(make_docs(spark, []), labels.limit(0)).count() == 0
    assert toxicity.keep_clean(docs, toxicity.fit(docs, labels.limit(0))).count() == len(odd_rows)


def test_neighbours_on_few_rows_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] * 4), (1080, [1.0]), (1100, []), (None, [1.0] * 8), rows[20]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in graph_ann.nearest(table, 15).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    wide = x.astype(np.float64)
    for q, found in got.items():
        s = wide @ wide[q]
        want = sorted((j for j in range(300) if j != q), key=lambda j: (-s[j], j))[:15]
        assert [v for v, _ in found] == want and np.allclose([v for _, v in found], s[want])
    assert graph_ann.nearest(table.limit(0)).count() == 0


def test_recall_over_several_shards(spark):
    """Norms that differ, clusters, equal vectors, two lengths, values beyond single precision."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(5000, 16)) * rng.uniform(0.3, 2, size=(5000, 1))
    x[:1500] = x[0] + 0.2 * x[:1500]
    x[2000:2030] = x[2000]
    x[3000] *= 1e-60
    rows = [(i, x[i].tolist()) for i in range(5000)] + [(10_000 + i, (1e300 * np.eye(3)[i % 3] / (i + 1)).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in graph_ann.nearest(table, 20, least_shard=1100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 5000, 20)) + [10_000, 10_020, 10_040]
    hits = 0
    for q in range(0, 5000, 20):
        s = x @ x[q]
        want = sorted((j for j in range(5000) if j != q), key=lambda j: (-s[j], j))[:20]
        hits += len(set(want) & {v for v, _ in got[q]})
        assert np.allclose([v for _, v in got[q]], s[[v for v, _ in got[q]]], rtol=1e-12, atol=0)
    assert hits / (250 * 20) >= 0.9
    assert len(got[10_000]) == 20 and all(v >= 10_000 for v, _ in got[10_000])


def test_recall_of_a_graph():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[:1000] = x[0] + 0.1 * x[:1000]
    graph = graph_ann.build(np.concatenate([x, np.zeros((3000, 1), np.float32)], axis=1))
    assert (graph.edges >= 0).sum(axis=1).max() <= graph_ann.SLACK
    q = x[::50]
    ids, _ = graph.search(np.concatenate([q, np.zeros((len(q), 1), np.float32)], axis=1), graph_ann.SEARCH_BEAM)
    true = np.argsort(((x[None] - q[:, None]) ** 2).sum(axis=2), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids[:, :20], true, strict=True)]) > 0.95
