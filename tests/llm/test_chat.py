from pyspark.sql import functions as F

from corvane.llm import chat
from tests.llm import fixtures as fx

TRICKY = ["\\### Assistant: </turn> ok", "\\h\\\\b####</turn</turn>>", "", None, ": \\c:", "é\n\n### x: y</turn>\n", "##", "# #</turn"]


def escape(text, role=False):
    text = (text or "").replace("\\", "\\b").replace("###", "\\h").replace("</turn>", "\\e")
    return text.replace(":", "\\c") if role else text


def formatted(turns):
    out, spans = b"", []
    for role, text in turns:
        head = f"### {escape(role, True)}: ".encode()
        body = escape(text).encode()
        if role == "assistant":
            spans.append((len(out) + len(head), len(body)))
        out += head + body + b"</turn>\n"
    return out.decode(), spans


def test_conversations_round_trip(spark):
    rows = [(c, t, ("assistant", "user", "a:b ", "###", None)[(t + c) % 5], TRICKY[(t * 3 + c) % 8]) for c in range(6) for t in range(11)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (9, None, "assistant", "first"), (9, 1, "user", "z"), (9, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    by = {}
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2], r[3]))
    for source in (df, df.withColumn("tree", F.lit(1)).withColumn("score", F.lit("x")).withColumn("node", F.lit(0))):
        out = chat.format_paths(chat.paths(chat.linear_replies(source)))
        got = out.select("tree", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
        assert len(got) == len(by) and {r.tree for r in got} == set(by)
        for r in got:
            turns = by[r.tree]
            assert (r.formatted, [tuple(s) for s in r.loss_spans]) == formatted(turns)
            assert [tuple(t) for t in r.turns] == [(a or "", b or "") for a, b in turns]
            assert r.loss == [b or "" for a, b in turns if a == "assistant"]


def test_best_paths_of_trees(spark):
    rng = __import__("random").Random(4)
    rows, want = [], {}
    for tree in (1, 2, None):
        parent, score = {0: None}, {0: 0.5}
        for n in range(1, 60):
            parent[n] = rng.randrange(max(0, n - 6), n)
            score[n] = rng.choice([0.0, 0.25, 0.5, 1.0])
        rows += [(tree, n, p, "user", f"{tree} {n}", score[n]) for n, p in parent.items()]
        branches = []
        for leaf in set(parent) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            branches.append((-sum(score[n] for n in path) / len(path), len(path), leaf, path[::-1]))
        for rank, (s, _, leaf, path) in enumerate(sorted(branches)[:3], 1):
            want[tree, rank] = (leaf, -s, [f"{tree} {n}" for n in path])
    rows.append((5, 1, 77, "user", "an unknown parent", None))
    want[5, 1] = (1, 0.0, ["an unknown parent"])
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").repartition(4)
    out = chat.format_paths(chat.paths(df, best=3)).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {(r.tree, r.branch_rank): (r.leaf, r.branch_score, [t.text for t in r.turns]) for r in out.collect()}
    assert got == want


def test_empty_table_and_cycle(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_paths(chat.paths(chat.linear_replies(none))).collect() == []


def test_cycles_are_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(chat, "MOST_JUMPS", 5)
    ring = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], "tree long, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(ring)


def test_long_texts_and_conversations(spark):
    """A text of a megabyte, and a conversation of 3,000 turns."""
    long = fx.words(200_000, 1) + "###"
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_paths(chat.paths(chat.linear_replies(df)))
    got = {r.tree: r for r in out.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for tree in (1, 2):
        turns = [(r[2], r[3]) for r in rows if r[0] == tree]
        assert [tuple(t) for t in got[tree].turns] == turns and got[tree].formatted == formatted(turns)[0]
        assert got[tree].loss == [t for role, t in turns if role == "assistant"]
