import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.operators.listing import NotFound, NotUnique
from corvane.plans import routes as R
from corvane.sources.literals import SCHEMAS

NOW, DAY = dt.datetime(2024, 1, 1), dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def t(spark):
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    kinds = ("EMPLOI", "STAGE")
    opps = [(i, f"t{i}", "", kinds[i % 2], "ACTIVE" if i % 5 else "EXPIREE", DAY, None if i % 3 else DAY + dt.timedelta(i), 7 if i % 2 else None, 1 + i % 2, NOW, NOW) for i in range(1, 61)]
    return {
        "opportunite": make("opportunite", opps),
        "source": make("source", [(1, "a", "http://a", "AUTRE"), (2, "b", "http://b", "SITE_EMPLOI"), (3, "c", "http://c", "AUTRE")]),
        "candidature": make("candidature", [(1, 5, 1, "VUE", None, NOW, NOW), (2, 5, 2, "VUE", None, NOW, NOW), (3, 6, 1, "VUE", None, NOW, NOW)]),
        "document": make("document", [(1, 1, "CV", "documents/a", NOW), (2, 1, "AUTRE", "documents/b", NOW), (3, 3, "CV", "documents/c", NOW)]),
        "utilisateur": make("utilisateur", [(i, f"u{i}", f"u{i}@x.y", "", "", False, True, False, NOW, None) for i in (5, 6, 7)]),
        "profil": make("profil", [(1, 5, "n", "p", "a, b", "", "JUNIOR", 2)]),
        "groupe": make("groupe", [(1, "CANDIDAT"), (2, "ORGANISATION")]),
        "utilisateur_groupe": make("utilisateur_groupe", [(5, 2), (5, 1)]),
    }


def test_list_opportunities(t):
    page = R.list_opportunities(t["opportunite"], t["source"], {"page": "2", "ordering": "date_limite", "statut": ""})
    rows = page.results.collect()
    assert (page.count, page.pages, page.previous, page.next) == (48, 3, 1, 3) and len(rows) == 20
    dates = [(r.date_limite is None, r.date_limite or DAY, r.id) for r in rows]
    assert dates == sorted(dates) and all(r.source.id == 1 + r.id % 2 for r in rows)
    assert R.list_opportunities(t["opportunite"], t["source"], {"type_opportunite": "STAGE", "source": 2}).count == 24
    assert R.list_opportunities(t["opportunite"], t["source"], {"source": 3}).count == 0
    assert R.list_opportunities(t["opportunite"], t["source"], {"statut": "EXPIREE"}).count == 0
    for bad in ({"type_opportunite": "OFFRE_EMPLOI"}, {"statut": "x"}, {"source": 9}):
        with pytest.raises(R.Invalid):
            R.list_opportunities(t["opportunite"], t["source"], bad)
    assert R.opportunity(t["opportunite"], 1).titre == "t1" and R.list_sources(t["source"], {"ordering": "-nom"}).results.first().nom == "c"
    with pytest.raises(NotFound):
        R.opportunity(t["opportunite"], 5)


def test_applications(t):
    page = R.list_applications(t["candidature"], t["document"], 5, {})
    assert [(r.id, [d.id for d in r.documents]) for r in page.results.collect()] == [(1, [1, 2]), (2, [])]
    new = t["candidature"].limit(1).select("id", "opportunite_id", "url_source")
    rows = lambda i, o: new.sparkSession.createDataFrame([(i, o, None)], new.schema)
    out = R.apply_for(t["candidature"], t["opportunite"], rows(9, 3), 5)
    assert [(r.candidat_id, r.statut) for r in out.where("id = 9").collect()] == [(5, "VUE")]
    for opp in (1, 1000):
        with pytest.raises(R.Invalid):
            R.apply_for(t["candidature"], t["opportunite"], rows(9, opp), 5)


def test_profiles(t, spark):
    me = R.profile(t["utilisateur"], t["profil"], t["utilisateur_groupe"], t["groupe"], 5)
    assert me.account_type == "CANDIDAT" and me.profil.nom == "n" and "annees_experience" not in me.profil
    with pytest.raises(NotFound):
        R.profile(t["utilisateur"], t["profil"], t["utilisateur_groupe"], t["groupe"], 6)
    change = lambda f: spark.createDataFrame([(5, f)], "utilisateur_id long, fields map<string,string>")
    row = R.update_profile(t["profil"], change({"nom": "x", "annees_experience": None, "id": "9"})).first()
    assert (row.id, row.nom, row.prenom, row.annees_experience) == (1, "x", "p", None)
    for level in ("EXPERT", None):
        with pytest.raises(R.Invalid):
            R.update_profile(t["profil"], change({"niveau_experience": level}))


def test_delete(t):
    out = R.delete_opportunity(t, 1, 7, ("ORGANISATION",))
    assert out["opportunite"].count() == 59 and sorted(r.id for r in out["candidature"].collect()) == [2] and out["document"].count() == 0
    for key, user, roles in ((1, 8, ("ORGANISATION",)), (1, 7, ("CANDIDAT",)), (2, 7, ("ORGANISATION",))):
        with pytest.raises(R.Forbidden):
            R.delete_opportunity(t, key, user, roles)
    assert R.delete_opportunity(t, 2, 8, ("ADMIN",))["opportunite"].count() == 59


def test_account(spark, t):
    assert R.account(t["utilisateur"], "u5@x.y").id == 5 and R.account(t["utilisateur"], "u6").id == 6
    for unknown in ("U5@x.y", "", "u"):
        with pytest.raises(NotFound):
            R.account(t["utilisateur"], unknown)
    twice = t["utilisateur"].withColumn("email", F.when(F.col("id") > 5, "both@x.y").otherwise("u6"))
    with pytest.raises(NotUnique):
        R.account(twice, "both@x.y")
    assert R.account(twice, "u6").id == 5 and R.account(twice, "u7").id == 7
    with pytest.raises(NotFound):
        R.account(t["utilisateur"].limit(0), "u6")
