import random
from itertools import accumulate

import pytest

from corvane.llm import common
from tests.llm import fixtures as fx


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_starts(spark, keys):
    rng = random.Random(1)
    rows = [(k, j, i, rng.randint(0, 9)) for k in "ab" for j in (0, 1) for i in sorted(rng.sample(range(100), 40))]
    if len(keys) < 2:  # one row for each place of its keys
        rows = [r for r in rows if r[1] == 0 and (keys or r[0] == "a")]
    got = common.starts(spark.createDataFrame(rows, "k string, j int, i long, n long").repartition(3), keys, "i", "n", rows=7)
    want, by = [], {}
    for r in rows:
        by.setdefault(tuple(r[: len(keys)]), []).append(r)
    for key, own in by.items():
        want += [(*key, r[2], s) for r, s in zip(own, accumulate([0] + [r[3] for r in own]))]
    assert fx.rows(got) == sorted(want, key=repr)


def test_one_row_of_each(spark):
    docs = fx.clashing(fx.awkward_docs(spark))
    digest = common.text_digest(docs["text"]).alias("text_digest")
    wanted = docs.where("doc_id is null or doc_id in (0, 3, 4)").select("doc_id", digest).distinct()
    got = common.one_row_of_each(docs, wanted)
    assert got.columns == docs.columns and sorted(map(str, (r.doc_id for r in got.collect()))) == ["0", "3", "4", "None"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.use_shared_folder(Session())
