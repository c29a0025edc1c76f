import hashlib
import re

import numpy as np
import pytest

from corvane.llm import infill
from tests.llm import fixtures as fx

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output) by slices of a list of tokens."""
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    spm = h4 % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def rows(spark):
    texts = ["", None, " ", "  \t\n", "one", " one", "one ", "a<P>b", "<P", "<S>", "M> <", "é ü x ß", " wide  \x85 x", "<< P>< S >M", "a\x1cb c", "x" * 5000]
    out = [(i, t, "en", "s", 0) for i, t in enumerate(texts * 40)]
    return [*out, (None, "no id at all", "en", "s", 0), (None, "no id at all", "en", "s", 0), (7, "x y z", "en", "s", 0), (7, "x y z", "en", "s", 0)]


@pytest.mark.parametrize("small", [False, True])
def test_outputs_and_round_trip(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(infill, "BATCH_BYTES", 40)
        monkeypatch.setattr(infill, "BLOCK_BYTES", 7)
    docs = fx.awkward_docs(spark, rows(spark)).repartition(3)
    got = infill.restore(infill.fill_in_middle(fx.clashing(docs)))
    want = [(*brute(r.doc_id, r.text), r.text or "") for r in docs.collect()]
    assert fx.rows(got) == sorted(want, key=repr)
    assert {"plain", "spm", "psm"} == {r[2] for r in want}


def test_restore_reads_only_output_and_form(spark):
    made = [(f, o) for _, _, f, _, _, o in (brute(i, "some words here, é ") for i in range(60))]
    got = infill.restore(spark.createDataFrame([*made, (None, None), ("plain", "<P>x<S>y<M>z")], "form string, output string"))
    assert {r.restored for r in got.collect()} == {"some words here, é ", "", "<P>x<S>y<M>z"}
    again = infill.restore(got)
    assert again.columns == ["form", "output", "restored"] and fx.rows(again) == fx.rows(got)


def test_scatter_and_gather_are_inverse():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 1000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 1000, 30))
    starts[0] = 0
    size = np.diff(np.append(starts, 1000))
    order = rng.permutation(30)
    to = np.empty(30, int)
    to[order] = np.cumsum(size[order]) - size[order]
    out, back = np.zeros(1000, np.uint8), np.zeros(1000, np.uint8)
    infill.scatter(data, starts, to - starts, out)
    assert bytes(out) == b"".join(bytes(data[starts[i] : starts[i] + size[i]]) for i in order)
    infill.gather(out, starts, to - starts, back)
    assert (back == data).all()


def test_long_text_and_empty_table(spark):
    text = fx.words(300_000, 3) + " \n"
    docs = spark.createDataFrame([(i, text, "en", "s", 0) for i in range(8)], fx.DOCS)
    got = {r.doc_id: tuple(r) for r in infill.fill_in_middle(docs).collect()}
    assert got == {i: brute(i, text) for i in range(8)}
    assert infill.restore(infill.fill_in_middle(docs.limit(0))).collect() == []


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "s", 0) for i in range(300)], fx.DOCS)
    assert {r.form for r in infill.fill_in_middle(docs, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r.form for r in infill.fill_in_middle(docs, rate=0).collect()} == {"plain"}
