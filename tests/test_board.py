"""Edge cases that the supplied tables do not have."""
import pytest
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.functions import text as X
from corvane.operators import kpi, listing, mutate, nest, validate
from corvane.sources import literals


def value(spark, col):
    return spark.range(1).select(col).first()[0]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("text, items", [(None, []), ("", []), (" a, b,,a ", ["a", "b", "a"]), ("\ta\n, b ,﻿", ["a", "b"]), ("x y", ["x y"])])
def test_lists(spark, text, items):
    assert value(spark, X.split_list(lit(text))) == items
    joined = X.join_list(X.split_list(lit(text)))
    assert value(spark, joined) == ", ".join(items) and value(spark, X.split_list(joined)) == items


def test_list_edits(spark):
    s = F.array(lit("a"), lit("b"), lit("a"))
    assert value(spark, X.toggled(X.toggled(F.array(lit("a")), lit("b")), lit("b"))) == ["a"]
    assert value(spark, X.toggled(s, lit("a"))) == ["b"] == value(spark, X.removed(s, lit("a")))
    assert value(spark, X.added(s, lit(" c "))) == ["a", "b", "a", "c"]
    assert value(spark, X.added(s, lit("  "))) == value(spark, X.added(s, lit("b"))) == ["a", "b", "a"]


@pytest.mark.parametrize("cells, want", [((None, "", "x"), "x"), (("y", None, ""), "y"), ((None, None, ""), "")])
def test_first_truthy(spark, cells, want):
    assert value(spark, X.first_truthy(*map(lit, cells))) == want


def test_rounding(spark):
    assert [value(spark, X.js_round(F.lit(x))) for x in (2.5, 3.49, -2.5, -2.51)] == [3, 3, -2, -3]
    assert value(spark, X.rounded_mean(F.lit(0), F.lit(0))) is None
    assert [value(spark, X.to_number(lit(x))) for x in ("", " 7 ", "x", None)] == [None, 7, None, None]


def test_search_is_literal(spark):
    for title, query, found in (("50% off", "0%", True), ("50 off", "0%", False), ("a_b", "A_B", True), ("acb", "a_b", False), ("abc", " abc", False), (None, "x", False), (None, "", True)):
        assert value(spark, P.board_search(query, lit(title), lit(None), F.lit(None).cast("array<string>"))) == found
    assert value(spark, P.board_search("TAG", lit("t"), lit("o"), F.array(lit(None), lit("my tag"))))


def test_form_rules(spark):
    for text, ok in (("a@b.c", True), (" a@b.c", False), ("a@b", False), ("a@@b.c", False), ("", False), (None, False)):
        assert value(spark, P.email_shaped(lit(text))) == ok
    for text, ok in (("Abcdefg1", True), ("abcdefg1", False), ("Abcdefgh", False), ("Abc1", False), (None, False)):
        assert value(spark, P.strong_password(lit(text))) == ok
    assert not value(spark, P.long_enough(lit("  a "), 2, trim=True))
    for text, ok in (("https://a.b/c?d", True), ("ftp://x", True), ("x.org", False), ("http://", False), ("http://a b", False)):
        assert value(spark, P.url_shaped(lit(text))) == ok


def test_deadlines(spark):
    for late, ok in ((None, True), ("2024-01-01", False), ("2024-02-01", True), ("2024-02-02", True)):
        assert value(spark, P.deadline_holds(F.lit("2024-02-01").cast("date"), lit(late).cast("date"))) == ok


def test_tokens(spark):
    def token(payload):
        return F.concat_ws(".", lit("h"), X.url64_encode(lit(payload)), lit("s"))

    now = F.lit(5_000)
    for t, gone in ((lit(None), True), (lit("x"), True), (lit("a.!!.c"), True), (token("{}"), True), (token('{"exp": 4}'), True), (token('{"exp": 5}'), True), (token('{"exp": 6, "n": "ü~?"}'), False)):
        assert value(spark, P.expired(t, now)) == gone
    assert value(spark, P.session_valid(lit(None), lit("r"), now)) and not value(spark, P.session_valid(lit(None), lit(""), now))
    assert value(spark, X.url64_decode(X.url64_encode(lit("a?>~é")))) == "a?>~é"


def test_permissions(spark):
    cases = [("GET", "CANDIDAT", True), ("POST", "CANDIDAT", False), ("POST", "ORGANISATION", True), ("DELETE", "ADMIN", True), ("GET", None, False)]
    for method, role, ok in cases:
        assert value(spark, P.may_write(lit(method), lit(role))) == ok
    assert not value(spark, P.may_change(lit("PUT"), F.lit(None).cast("long"), F.lit(1), F.lit(False)))
    assert value(spark, P.may_change(lit("PUT"), F.lit(None).cast("long"), F.lit(1), F.lit(True)))
    routes = {("CANDIDAT", ("CANDIDAT",)): True, ("ORGANISATION", ("CANDIDAT",)): False, ("ADMIN", ("CANDIDAT",)): True, (None, ()): False, ("CANDIDAT", ()): True}
    assert all(value(spark, P.may_enter(lit(r), *a)) == ok for (r, a), ok in routes.items())


@pytest.mark.parametrize("n", [0, 1, 20, 21, 40])
def test_pages(spark, n):
    df = spark.range(n).withColumn("date_publication", F.lit("2024-01-01").cast("date"))
    by = listing.order(None, ["date_publication"], "-date_publication")
    pages = max(1, -(-n // 20))
    got = [r.id for p in range(1, pages + 1) for r in listing.paginate(df, by, p).results.collect()]
    assert got == list(range(n))
    last = listing.paginate(df, by, "last")
    assert (last.number, last.next, last.previous, last.count) == (pages, None, pages - 1 or None, n)
    for bad in (0, -1, pages + 1, "x", ""):
        with pytest.raises(listing.NotFound):
            listing.paginate(df, by, bad)


def test_single(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, email string")
    assert listing.single(df.where("email = 'a'")).id == 1
    with pytest.raises(listing.NotFound):
        listing.single(df.where("email = 'c'"))
    with pytest.raises(listing.NotUnique):
        listing.single(df.where("email = 'b'"))
    both = spark.createDataFrame([(1, "x", "y"), (2, "y", "z")], "id int, email string, username string")
    assert [r.id for r in listing.first_match(both, F.col("email") == "y", F.col("username") == "y").collect()] == [2]
    assert [r.id for r in listing.first_match(both, F.col("email") == "q", F.col("username") == "y").collect()] == [1]


def test_nulls_in_order(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, None)], "id int, d string")
    ids = lambda spec: [r.id for r in df.orderBy(*listing.order(spec, ["d"], "d")).collect()]
    assert ids("d") == [3, 2, 1, 4] and ids("-d") == [1, 4, 2, 3] and ids("-id,x") == [3, 2, 1, 4]


def test_groups_and_children(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    bridge = spark.createDataFrame([(1, 9), (1, 4), (2, 9)], "utilisateur_id int, groupe_id int")
    groups = spark.createDataFrame([(4, "A"), (9, "B")], "id int, name string")
    assert {r.id: r.account_type for r in nest.first_group(users, bridge, groups).collect()} == {1: "A", 2: "B", 3: None}
    assert {r.id: r.account_type for r in nest.first_group(users, bridge, groups, "utilisateur").collect()}[3] == "utilisateur"
    rows = nest.with_children(users, bridge, "utilisateur_id", "g", ["groupe_id"]).collect()
    assert {r.id: [x.groupe_id for x in r.g] for r in rows} == {1: [4, 9], 2: [9], 3: []}


def test_violations(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 7)], "a int, b int")
    assert [tuple(r) for r in validate.not_unique(rows, ["a", "b"]).collect()] == [(1, 1, 2)]
    assert [r.a for r in validate.orphans(rows, "b", spark.createDataFrame([(1,)], "id int")).collect()] == [3]


def test_cascade_leaves_no_orphan(spark):
    tables = {
        "source": spark.createDataFrame([(1,), (2,)], "id int"),
        "opportunite": spark.createDataFrame([(1, 1), (2, 2)], "id int, source_id int"),
        "candidature": spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 2, 6)], "id int, opportunite_id int, candidat_id int"),
        "document": spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "id int, candidature_id int"),
    }
    links = [("opportunite", "source_id", "source"), ("candidature", "opportunite_id", "opportunite"), ("document", "candidature_id", "candidature")]
    out = mutate.delete_cascade(tables, links, "source", tables["source"].where("id = 1"))
    assert {n: sorted(r.id for r in t.collect()) for n, t in out.items()} == {"source": [2], "opportunite": [2], "candidature": [2, 3], "document": [2, 3, 4]}
    for child, fk, parent in links:
        assert validate.orphans(out[child], fk, out[parent]).isEmpty()


def test_patch_tells_absent_from_null(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, s string, n int")
    changes = spark.createDataFrame([(1, {"s": None}), (2, {"n": "7"})], "id int, fields map<string,string>")
    assert sorted(map(tuple, mutate.patch(table, changes).collect())) == [(1, None, 1), (2, "b", 7), (3, "c", 3)]


def test_creation_is_idempotent(spark):
    have, want = spark.createDataFrame([("A",)], "name string"), spark.createDataFrame([("A",), ("B",), ("B",)], "name string")
    once = mutate.get_or_create(have, want, ["name"])
    assert sorted(r.name for r in once.collect()) == sorted(r.name for r in mutate.get_or_create(once, want, ["name"]).collect()) == ["A", "B"]
    users = spark.createDataFrame([(1,), (2,)], "id long")
    profiles = spark.createDataFrame([(5, 1, "n")], "id long, utilisateur_id long, nom string")
    once = mutate.profiles_for_all(users, profiles)
    assert sorted((r.utilisateur_id, r.nom) for r in once.collect()) == [(1, "n"), (2, "")] and mutate.profiles_for_all(users, once).count() == 2


def test_registration(spark):
    users = spark.createDataFrame([(1, "a@x.y", "a@x.y", "", "")], "id long, username string, email string, first_name string, last_name string")
    groups = spark.createDataFrame([(1, "CANDIDAT"), (2, "ORGANISATION"), (3, "ADMIN")], "id long, name string")
    bridge = spark.createDataFrame([(1, 1)], "utilisateur_id long, groupe_id long")
    profiles = spark.createDataFrame([(1, 1, "n", "p", "c")], "id long, utilisateur_id long, nom string, prenom string, competences string")
    forms = spark.createDataFrame(
        [(2, "b@x.y", "B", "Bb", "CANDIDAT"), (3, "a@x.y", "A", "A", "CANDIDAT"), (4, "c@x.y", "C", "C", "ADMIN"), (5, "b@x.y", "D", "D", "ORGANISATION")],
        "id long, email string, first_name string, last_name string, account_type string",
    )
    done = mutate.register(users, groups, bridge, profiles, forms, "ok")
    assert [tuple(r) for r in done.answer.collect()] == [(2, "b@x.y", "b@x.y", "ok")]
    assert sorted(map(tuple, done.bridge.collect())) == [(1, 1), (2, 1)] and done.users.count() == 2
    assert [(r.nom, r.prenom, r.competences) for r in done.profiles.where("utilisateur_id = 2").collect()] == [("Bb", "B", "")]


def test_literal_relations(spark):
    posted = kpi.posted_kpis(literals.posted(spark), F.col("status") == "Active", F.col("applicants"), F.col("views")).first()
    assert tuple(posted) == (2, 147, 1026, 49)
    empty = kpi.posted_kpis(literals.posted(spark).limit(0), F.col("status") == "Active", F.col("applicants"), F.col("views")).first()
    assert tuple(empty) == (0, 0, 0, None)


def test_stream_of_users(spark, tmp_path):
    from corvane.streaming.hooks import on_new_users

    schema, out = "id long", str(tmp_path / "profiles")
    spark.createDataFrame([(1,)], "utilisateur_id long").write.parquet(out)
    for ids in ([1, 2], [2, 3, 3]):
        spark.createDataFrame([(i,) for i in ids], schema).write.mode("append").parquet(str(tmp_path / "users"))
        users = spark.readStream.schema(schema).parquet(str(tmp_path / "users"))
        hook = on_new_users(users, lambda: spark.read.parquet(out), lambda df, n: df.write.mode("append").parquet(out))
        hook.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.utilisateur_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@pytest.mark.parametrize("query, kind, ids", [("health", "all", "23"), ("research", "all", "24"), ("", "Funding", "26"), ("research", "Research", "4"), ("", "all", "123456")])
def test_browse_search(spark, query, kind, ids):
    rows = literals.browse(spark)
    found = rows.where(P.board_search(query, F.col("title"), F.col("organization"), F.col("tags")))
    found = found.where(P.every(P.equals_or_any(F.col("type"), kind, absent=("all",))))
    assert sorted(r.id for r in found.collect()) == list(ids)


def test_saved_set(spark):
    rows = literals.browse(spark)
    s = rows.where("saved").agg(F.sort_array(F.collect_set("id")).alias("s"))
    assert s.first().s == ["2", "5"]
    assert sorted(s.select(X.toggled(X.toggled(F.col("s"), F.lit("2")), F.lit("1"))).first()[0]) == ["1", "5"]
    assert (literals.saved(spark).count(), literals.applied(spark).count()) == (3, 2)


def test_entities_can_be_read(spark):
    for name, schema in literals.SCHEMAS.items():
        assert spark.createDataFrame([], schema).columns, name
    rows = spark.createDataFrame([("EMPLOI",), ("OFFRE_EMPLOI",), (None,)], "t string")
    bad = validate.broken(rows, P.one_of(F.col("t"), *literals.ENUMS["type_opportunite"]))
    assert sorted((r.t for r in bad.collect()), key=str) == [None, "OFFRE_EMPLOI"]


def test_pages_from_both_ends(spark):
    rows = [(i, None if i % 7 == 0 else i % 5) for i in range(95)]
    df = spark.createDataFrame(rows, "id long, d int").repartition(4)
    for spec in ("d", "-d"):
        by = listing.terms(spec, ["d"], "d")
        assert [str(c) for c in listing.sorting(by)] == [str(c) for c in listing.order(spec, ["d"], "d")]
        whole = [r.id for r in df.orderBy(*listing.sorting(by)).collect()]
        for n in range(1, 6):
            got = listing.paginate(df, by, n)
            assert [r.id for r in got.results.collect()] == whole[(n - 1) * 20 : n * 20] and got.pages == 5
        last, seen = None, []
        while True:
            page = (df.orderBy(*listing.sorting(by)).limit(20) if last is None else listing.following(df, by, last)).collect()
            if not page:
                break
            seen += [r.id for r in page]
            last = page[-1].asDict()
        assert seen == whole
    assert listing.paginate(df.limit(0), by, "last").results.collect() == []


def test_snapshots_are_written_once(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    mutate.save(first, root, 1)
    mutate.save(mutate.delete(mutate.load(spark, root, 1), spark.createDataFrame([(1,)], "id long")), root, 2)
    assert mutate.load(spark, root, 1).count() == 2 and [tuple(r) for r in mutate.load(spark, root, 2).collect()] == [(2, "b")]
    with pytest.raises(Exception, match="already exists"):
        mutate.save(first, root, 2)


def test_cascade_to_leaves_and_further(spark):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "user": make([(1,), (2,)], "id long"), "opp": make([(10, 1), (11, 2), (12, None)], "id long, u long"),
        "app": make([(100, 10, 2), (101, 11, 1), (102, 11, 2), (103, None, 2)], "id long, o long, u long"), "doc": make([(7, 100), (8, 101), (9, 102)], "id long, a long"),
    }
    links = [("opp", "u", "user"), ("app", "o", "opp"), ("app", "u", "user"), ("doc", "a", "app")]
    out = mutate.delete_cascade(tables, links, "user", make([(1,)], "id long"))
    assert {k: sorted(r.id for r in v.collect()) for k, v in out.items()} == {"user": [2], "opp": [11, 12], "app": [102, 103], "doc": [9]}


def test_literal_detail(spark):
    row = literals.detail(spark, "42").first()
    assert row.id == "42" and len(row.tags) == 5 and len(row.benefits) == 6 and literals.detail(spark, None).first().id == "1"
    assert literals.type_counts(spark).count() == 4


def test_new_profile_ids_are_new(spark):
    profiles = spark.createDataFrame([(50, 1, "a"), (7, 2, "b")], "id long, utilisateur_id long, nom string")
    users = spark.createDataFrame([(i,) for i in range(1, 60)], "id long")
    out = mutate.profiles_for_all(users, profiles)
    assert out.count() == 59 and validate.not_unique(out, ["id"]).count() == 0
