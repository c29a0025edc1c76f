import itertools
import random
import resource
import time

import numpy as np
from sentencepiece import SentencePieceProcessor

from corvane.llm import pieces as P
from tests.llm import fixtures as fx


def segmentations(text, model):
    """All (score, ids) of a text, best first."""
    codes = "▁" + text.replace("▁", "\0").replace(" ", "▁") if text else ""
    out = []

    def go(at, score, ids):
        if at == len(codes):
            out.append((score, tuple(ids)))
        for end in range(at + 1, len(codes) + 1):
            i = model.ids.get(codes[at:end])
            if i is not None:
                go(end, score + model.score[i], ids + [i])
            elif end == at + 1:
                raw = ("▁" if codes[at] == "\0" else codes[at]).encode()
                go(end, score + model.unknown, ids + [int(model.byte_ids[b]) for b in raw])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def apply(ids, edits):
    out = list(ids)
    for start, length, new in sorted(edits, reverse=True):
        out[start : start + length] = new
    return tuple(out)


def encoded(texts, n):
    model = P.pieces(P.MODEL)
    seqs, words = P._numbered(texts)
    table = P.Words(words, model)
    for t, seq in zip(texts, seqs):
        ids = [int(i) for w in seq for i in table.ids[table.start[w] : table.start[w + 1]]]
        yield ids, float(table.score[seq].sum()), P.others(seq, words, table, n, P.MODEL)


def test_against_all_segmentations():
    model, rng = P.pieces(P.MODEL), random.Random(0)
    texts = ["", " ", "a", "the cat", "  in  on", "é▁x", "\n\n", "日本", "ab" * 5, "antion th.", "<s>", "☃ a"]
    texts += ["".join(rng.choice("aeinst .") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for t, (ids, score, more) in zip(texts, encoded(texts, 4)):
        want = segmentations(t, model)[:4]
        assert tuple(ids) in {i for s, i in want if s == want[0][0]} and score == want[0][0]
        got = [score] + [score - loss for loss, _ in more]
        assert np.allclose(got, [s for s, _ in want])
        ways = [tuple(ids)] + [apply(ids, e) for _, e in more]
        assert len(set(ways)) == len(ways)
        every = dict((i, s) for s, i in segmentations(t, model))
        assert all(np.isclose(every[w], s) for w, s in zip(ways, got))
        assert all(P.decode_ids(list(w), model) == t for w in ways if w)


def test_long_and_odd_words():
    model, rng = P.pieces(P.MODEL), random.Random(1)
    texts = [fx.words(3000, 3), "x" * 3000, "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(2000)), "\0\x7f", "🙂" * 30, " " * 400 + "a" + " " * 37]
    for t, (ids, score, _) in zip(texts, encoded(texts, 2)):
        assert P.decode_ids(ids, model) == t
        for w in set(P._WORDS.findall(" " + t)):
            best = P.best_of_word(w, 2, P.MODEL)
            one = P.Words([w], model)
            assert one.score[0] == best[0][0]
            assert (len(best) == 1 and np.isinf(one.loss[0])) or np.isclose(one.loss[0], best[0][0] - best[1][0])


def test_long_words_as_short_ones(monkeypatch):
    """The way of long words, in small blocks, against all segmentations and against the way of short ones."""
    model, rng = P.pieces(P.MODEL), random.Random(2)
    texts = ["x" * 300, "ab" * 200, "".join(rng.choice("aeinst日☃\t") for _ in range(700)), "=" * 257]
    plain = list(encoded(texts, 4))
    monkeypatch.setattr(P, "_BLOCK", 50)
    for limit in (1, 10_000):
        monkeypatch.setattr(P, "LONG_WORD", limit)
        for (ids, score, more), (ids2, score2, more2) in zip(plain, encoded(texts, 4)):
            assert ids == ids2 and score == score2 and np.allclose([x for x, _ in more], [x for x, _ in more2])
    monkeypatch.setattr(P, "LONG_WORD", 1)
    for t in ("the cat", "日本antion", "aaaaaaaa"):
        for ids, score, more in encoded([t], 5):
            want = segmentations(t, model)[:5]
            assert score == want[0][0] and np.allclose([score - x for x, _ in more], [x for x, _ in want[1:]])
            ways = [apply(ids, e) for _, e in more]
            assert len(set(ways)) == len(ways) and all(P.decode_ids(list(w), model) == t for w in ways)


def test_a_megabyte_without_a_space():
    model, rng = P.pieces(P.MODEL), random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    began, before = time.monotonic(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((ids, _, more),) = encoded([text], P.N_BEST)
    assert P.decode_ids(ids, model) == text and len(more) == P.N_BEST - 1
    assert all(P.decode_ids(list(apply(ids, e)), model) == text and len(e[0][2]) < 100 for _, e in more)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10 and time.monotonic() - began < 300


def test_many_best_of_many_words():
    words = [fx.words(1, k) for k in range(40)]
    for _, _, more in encoded([" ".join(words)], 30):
        losses = [x for x, _ in more]
        assert len(losses) == 29 and losses == sorted(losses)


def test_decoding_agrees_with_the_library():
    sp, model = SentencePieceProcessor(model_file=P.MODEL), P.pieces(P.MODEL)
    for text in ("hello there", " two  spaces", "naïve ☃\tx", fx.words(200, 8)):
        assert P.decode_ids(sp.encode(text), model) == text
        for ids, _, _ in encoded([text], 1):
            assert sp.decode(ids) == text


def test_query_on_awkward_rows(spark):
    docs = fx.awkward_docs(spark)
    for df in (docs, fx.clashing(docs), docs.limit(0)):
        out = P.encode(df).collect()
        assert len(out) == df.count() and all(r.round_trip and r.n_pieces == len(r.ids) for r in out)
    back = P.decode(P.encode(docs)).collect()
    assert sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in back), key=repr)
    assert not list(itertools.chain(*(r.others for r in P.encode(docs, n_best=1).collect())))
