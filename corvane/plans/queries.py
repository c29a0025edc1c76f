"""The board's queries over the supplied tables, each with the SQL that gives the same rows in DuckDB."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.functions import text as X
from corvane.operators import kpi, listing, mutate, nest, validate
from corvane.plans import board, changes, matching, rollups, timeline  # noqa: F401  these register queries of their own
from corvane.plans.registry import QUERIES, SQL, query  # noqa: F401
from corvane.sources import table

ORDERABLE = ["date_publication", "date_limite", "date_creation"]


# --- listings -------------------------------------------------------------------------------------------------------


@query("""
    select o.id, titre, type_opportunite, statut, date_publication, date_limite, organisation_id, s.id as source_id, nom as source_nom, type_source
    from (select * from sourced where statut = 'ACTIVE' and type_opportunite = '2-HIGH' order by date_publication desc, id limit 20) o
    join source s on s.id = o.source_id
""")
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of active opportunities of one type with their sources."""
    rows = board.active(spark, d).where(P.every(P.equals_or_any(F.col("type_opportunite"), "2-HIGH")))
    # the page is cut before organisations and sources are joined, so that 20 rows meet them
    page = F.broadcast(listing.page(rows, listing.order(None, ORDERABLE, "-date_publication"), 1))
    out = nest.with_parent(board.with_source_id(spark, d, page), board.sources(spark, d), "source_id", "source")
    return out.select(
        "id", "titre", "type_opportunite", "statut", "date_publication", "date_limite", "organisation_id", "source_id",
        F.col("source.nom").alias("source_nom"), F.col("source.type_source").alias("type_source"),
    )


@query("select count(*) as count from opportunite where statut = 'ACTIVE'")
def page_count(spark: SparkSession, d: str) -> DataFrame:
    """A1"""
    return board.active(spark, d).agg(F.count(F.lit(1)).alias("count"))


@query("""
    select count(*) as count, cast(greatest(1, ceil(count(*) / 20.0)) as bigint) as pages,
           case when greatest(1, ceil(count(*) / 20.0)) > 3 then 4 end as next, 2 as previous
    from opportunite where statut = 'ACTIVE'
""")
def page_envelope(spark: SparkSession, d: str) -> DataFrame:
    """K2 L3"""
    return listing.envelope(board.active(spark, d), 3)


@query("""
    select id, date_limite, date_publication from opportunite where statut = 'ACTIVE'
    order by date_limite desc nulls first, date_publication asc nulls last, id limit 20 offset 20
""")
def ordered_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 in an order of the caller's choice; an unknown name is dropped."""
    by = listing.order("-date_limite,salary,date_publication", ORDERABLE, "-date_publication")
    return listing.page(board.active(spark, d).select("id", "date_limite", "date_publication"), by, 2)


@query("""
    select id, date_publication from opportunite where statut = 'ACTIVE' order by date_publication desc, id
    limit 20 offset (select (greatest(1, cast(ceil(count(*) / 20.0) as bigint)) - 1) * 20 from opportunite where statut = 'ACTIVE')
""")
def last_page(spark: SparkSession, d: str) -> DataFrame:
    """L2: the page named last, with its bounds checked, taken from the end."""
    rows = board.active(spark, d).select("id", "date_publication")
    return listing.paginate(rows, listing.terms("", ORDERABLE, "-date_publication"), "last").results


@query("""
    select id, date_limite, date_publication from opportunite order by date_limite desc nulls first, date_publication asc nulls last, id
    limit 20 offset (select (count(*) // 40) * 20 from opportunite)
""")
def middle_page(spark: SparkSession, d: str) -> DataFrame:
    """L2: a page in the middle by its number, found by counting ranges of the order; no queue of what lies before it."""
    rows, by = board.opportunities(spark, d).select("id", "date_limite", "date_publication"), listing.terms("-date_limite,date_publication", ORDERABLE, "-date_publication")
    count = rows.count()
    return listing.page_at(rows, by, count // 40 * 20, count, queue=500)


@query("""
    select id, date_limite, date_publication from opportunite where statut = 'ACTIVE'
    order by date_limite desc nulls first, date_publication asc nulls last, id limit 20 offset 40
""")
def next_page(spark: SparkSession, d: str) -> DataFrame:
    """L2 L3 O2 O3: the page behind another by the values of that page's last row, as deep pages are best reached."""
    rows, by = board.active(spark, d).select("id", "date_limite", "date_publication"), listing.terms("-date_limite,date_publication", ORDERABLE, "-date_publication")
    seen = listing.page(rows, listing.sorting(by), 2).collect()  # one page
    return listing.following(rows, by, seen[-1].asDict()) if seen else rows.limit(0)


@query("select doc_id, lang, quality from documents left join labels using (doc_id) order by quality desc nulls first, doc_id limit 20")
def nulls_order(spark: SparkSession, d: str) -> DataFrame:
    """O3 O4 J3"""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return listing.page(rows, listing.order("-quality", ["quality"], "doc_id", "doc_id"), 1)


@query("select id, nom, type_source from source order by type_source, id")
def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """All sources in an order over projected columns."""
    return board.sources(spark, d).select("id", "nom", "type_source").orderBy(*listing.order("type_source", ["nom", "type_source"], "id"))


@query("select id, type_opportunite, statut from opportunite where statut = 'ACTIVE' and statut = 'ARCHIVEE' union all select id, type_opportunite, statut from opportunite where statut = 'ACTIVE' and organisation_id = 7")
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    """The caller's status is a further condition, so any but ACTIVE gives nothing; the second part has rows."""
    rows = board.active(spark, d).select("id", "type_opportunite", "statut", "organisation_id")
    none = rows.where(P.every(P.equals_or_any(F.col("statut"), "ARCHIVEE")))
    some = rows.where(P.every(P.equals_or_any(F.col("statut"), ""), P.equals_or_any(F.col("organisation_id"), 7)))
    return none.unionByName(some).drop("organisation_id")


@query("select id, type_opportunite from sourced where statut = 'ACTIVE' and source_id = 3")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    """F4"""
    return board.with_source_id(spark, d, board.active(spark, d)).where(F.col("source_id") == 3).select("id", "type_opportunite")


@query("""
    select o.id, statut, count(c.line) as n, coalesce(string_agg(c.line || ' ' || c.st, ', ' order by c.line, c.st), '') as documents
    from (select id, statut from opportunite where organisation_id = 7 order by id limit 20) o
    left join (select opportunite_id, line, statut as st from candidature) c on c.opportunite_id = o.id group by o.id, statut
""")
def nested_page(spark: SparkSession, d: str) -> DataFrame:
    """A caller's page of parents with their children; the page is cut before children are grouped."""
    rows = board.opportunities(spark, d).where("organisation_id = 7").select("id", "statut")
    page = F.broadcast(listing.page(rows, listing.order("id", [], "id"), 1))
    children = nest.members(board.applications(spark, d), page.select(F.col("id").alias("opportunite_id")), "opportunite_id")
    out = nest.with_children(page, children, "opportunite_id", "documents", ["line", "statut"])
    shown = F.transform("documents", lambda x: F.concat_ws(" ", x.line.cast("string"), x.statut))
    return out.select("id", "statut", F.size("documents").cast("long").alias("n"), F.array_join(shown, ", ").alias("documents"))


@query("select opportunite_id, candidat_id, statut, line, date_creation from candidature where candidat_id = 7")
def owner_scope(spark: SparkSession, d: str) -> DataFrame:
    """S4 F6 F24 P4"""
    return board.applications(spark, d).where("candidat_id = 7").select("opportunite_id", "candidat_id", "statut", "line", "date_creation")


@query("select id, titre, statut from opportunite where id = 77")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """F7 L5"""
    return board.opportunities(spark, d).where("id = 77").select("id", "titre", "statut")


@query("""
    select id, username, email from (
        select *, case when email = 'Customer#000000014' then 0 when username = 'Customer#000000014' then 1 end as r from utilisateur
    ) where r = (select min(case when email = 'Customer#000000014' then 0 when username = 'Customer#000000014' then 1 end) from utilisateur)
""")
def login_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By email, and by user name only where no email is equal."""
    name = "Customer#000000014"
    return listing.first_match(board.users(spark, d), F.col("email") == name, F.col("username") == name).select("id", "username", "email")


@query("select id, username, email, role from utilisateur order by id desc limit 100")
def admin_list(spark: SparkSession, d: str) -> DataFrame:
    """O6 P11 S5"""
    return listing.page(board.users(spark, d).select("id", "username", "email", "role"), [F.desc("id")], 1, listing.ADMIN_PAGE_SIZE)


@query("select nom, type_source, id from source order by id desc limit 100")
def admin_sources(spark: SparkSession, d: str) -> DataFrame:
    """O6 P11"""
    return listing.page(board.sources(spark, d).select("nom", "type_source", "id"), [F.desc("id")], 1, listing.ADMIN_PAGE_SIZE)


@query("select titre, type_opportunite, statut, date_publication, id from opportunite order by date_publication desc, id limit 100")
def admin_opportunities(spark: SparkSession, d: str) -> DataFrame:
    """The model's own order goes before newest first."""
    rows = board.opportunities(spark, d).select("titre", "type_opportunite", "statut", "date_publication", "id")
    return listing.page(rows, listing.order(None, [], "-date_publication"), 1, listing.ADMIN_PAGE_SIZE)


@query("select prenom, nom, niveau_experience, id from candidat order by id desc limit 100")
def admin_profiles(spark: SparkSession, d: str) -> DataFrame:
    """O6 P11"""
    return listing.page(board.candidates(spark, d).select("prenom", "nom", "niveau_experience", "id"), [F.desc("id")], 1, listing.ADMIN_PAGE_SIZE)


@query("""
    select u.username as candidat, o.titre as opportunite, c.statut, c.date_creation, c.opportunite_id, c.line
    from (select * from candidature order by opportunite_id desc, line desc, candidat_id, quantity, date_creation limit 100) c
    join candidat u on u.id = c.candidat_id join opportunite o on o.id = c.opportunite_id
""")
def admin_applications(spark: SparkSession, d: str) -> DataFrame:
    """Application to user and to opportunity; the page is cut before the joins."""
    page = F.broadcast(_newest_applications(spark, d))
    users = board.candidates(spark, d).select(F.col("id").alias("candidat_id"), F.col("username").alias("candidat"))
    titles = board.opportunities(spark, d).select(F.col("id").alias("opportunite_id"), F.col("titre").alias("opportunite"))
    rows = titles.join(F.broadcast(users.join(page, "candidat_id")), "opportunite_id")
    return rows.select("candidat", "opportunite", "statut", "date_creation", "opportunite_id", "line")


def _newest_applications(spark: SparkSession, d: str) -> DataFrame:
    by = [F.desc("opportunite_id"), F.desc("line"), "candidat_id", "quantity", "date_creation"]
    return listing.page(board.applications(spark, d), by, 1, listing.ADMIN_PAGE_SIZE)


@query("""
    select c.statut as type_document, u.username || ' - ' || o.titre as candidature, c.date_creation as date_upload, c.opportunite_id, c.line
    from (select * from candidature order by opportunite_id desc, line desc, candidat_id, quantity, date_creation limit 100) c
    join opportunite o on o.id = c.opportunite_id join utilisateur u on u.id = o.organisation_id
""")
def admin_documents(spark: SparkSession, d: str) -> DataFrame:
    """Document to application, and from there to user and opportunity for its display string."""
    page = F.broadcast(_newest_applications(spark, d))
    titles = board.opportunities(spark, d).select(F.col("id").alias("opportunite_id"), "titre", F.col("organisation_id").alias("user"))
    names = board.users(spark, d).select(F.col("id").alias("user"), "username")
    rows = names.join(F.broadcast(titles.join(page, "opportunite_id")), "user")
    shown = F.concat_ws(" - ", "username", "titre").alias("candidature")
    return rows.select(F.col("statut").alias("type_document"), shown, F.col("date_creation").alias("date_upload"), "opportunite_id", "line")


@query("""
    select username as utilisateur, type_notification, lu, cast(date_creation as date) as date_creation, n.id
    from (select * from notification order by id desc limit 100) n left join utilisateur u on u.id = n.utilisateur_id
""")
def admin_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Notification to user; 100 rows meet the users."""
    page = listing.page(board.notifications(spark, d).drop("props"), [F.desc("id")], 1, listing.ADMIN_PAGE_SIZE)
    asked = F.broadcast(page.select(F.col("utilisateur_id").alias("id")))
    names = nest.members(board.users(spark, d).select("id", "username"), asked, "id")
    rows = page.join(F.broadcast(names.withColumnRenamed("id", "utilisateur_id")), "utilisateur_id", "left")
    return rows.select(F.col("username").alias("utilisateur"), "type_notification", "lu", F.to_date("date_creation").alias("date_creation"), "id")


@query("select id, username, email from utilisateur where contains(lower(username), '1') and (contains(lower(username), '5@ex') or contains(lower(email), '5@ex'))")
def admin_search(spark: SparkSession, d: str) -> DataFrame:
    """every word in some field."""
    return board.users(spark, d).where(P.admin_search("1 5@EX", F.col("username"), F.col("email"))).select("id", "username", "email")


@query("select type_notification, lu, count(*) as n from notification group by all")
def notification_facets(spark: SparkSession, d: str) -> DataFrame:
    """F16"""
    return board.notifications(spark, d).groupBy("type_notification", "lu").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(*) as n from documents group by lang")
def document_facets(spark: SparkSession, d: str) -> DataFrame:
    """F16 F20"""
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("select id, date_publication from opportunite where date_publication between date '1995-01-01' and date '1995-06-30'")
def published_between(spark: SparkSession, d: str) -> DataFrame:
    """An extension that was planned only."""
    return board.opportunities(spark, d).where(F.col("date_publication").between("1995-01-01", "1995-06-30")).select("id", "date_publication")


# --- search ---------------------------------------------------------------------------------------------------------


@query("""
    select id, title, organization from browse
    where contains(lower(title), 'red') or contains(lower(organization), 'red') or len(list_filter(tags, lambda t: contains(lower(t), 'red'))) > 0
""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """F12 C5 C6"""
    return board.browse(spark, d).where(P.board_search("RED", F.col("title"), F.col("organization"), F.col("tags"))).select("id", "title", "organization")


@query("""
    select type, count(*) as n from browse where (contains(lower(title), 'a') or contains(lower(organization), 'a')) and type = (select min(type) from browse) group by type
""")
def typed_search_count(spark: SparkSession, d: str) -> DataFrame:
    """F12 F13 A2"""
    rows = board.browse(spark, d)
    first = rows.agg(F.min("type").alias("first"))  # one row
    found = rows.where(P.board_search("a", F.col("title"), F.col("organization"), F.array()))
    return found.join(F.broadcast(first), F.col("type") == F.col("first")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("select tag, pos, count(*) as n from (select unnest(tags) as tag, generate_subscripts(tags, 1) - 1 as pos from browse) group by all")
def tag_explode(spark: SparkSession, d: str) -> DataFrame:
    """C8"""
    tags = board.browse(spark, d).select(F.posexplode("tags").alias("pos", "tag"))
    return tags.groupBy("tag", F.col("pos").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


# --- joins and nesting ----------------------------------------------------------------------------------------------


@query("""
    select o.id, count(c.line) as n, coalesce(string_agg(c.line || ':' || c.candidat_id, ' ' order by c.line, c.candidat_id), '') as documents
    from opportunite o left join candidature c on c.opportunite_id = o.id group by o.id
""")
def left_children(spark: SparkSession, d: str) -> DataFrame:
    """An empty list where there are no children."""
    rows = nest.with_children(board.opportunities(spark, d).select("id"), board.applications(spark, d), "opportunite_id", "documents", ["line", "candidat_id"])
    shown = F.transform("documents", lambda x: F.concat_ws(":", x.line.cast("string"), x.candidat_id.cast("string")))
    return rows.select("id", F.size("documents").cast("long").alias("n"), F.array_join(shown, " ").alias("documents"))


@query("select conv_id, count(*) as n, string_agg(role || ': ' || text, chr(10) order by turn) as thread from conversations group by conv_id")
def thread(spark: SparkSession, d: str) -> DataFrame:
    """Children in order."""
    turns = table(spark, d, "conversations")
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("said")))).alias("t"))
    return rows.select("conv_id", F.size("t").cast("long").alias("n"), F.array_join("t.said", "\n").alias("thread"))


@query("select d.doc_id, lang, source, quality, toxic, l.doc_id is not null as has_profile from documents d left join labels l on l.doc_id = d.doc_id")
def optional_profile(spark: SparkSession, d: str) -> DataFrame:
    """One to one, null where there is none."""
    rows = nest.with_parent(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), "doc_id", "profil", "doc_id", "left")
    return rows.select("doc_id", "lang", "source", "profil.quality", "profil.toxic", F.col("profil").isNotNull().alias("has_profile"))


@query("""
    select u.id, u.username, u.email, u.role, p.prenom as profil_prenom, p.niveau_experience as profil_niveau, p.id is not null as has_profile, coalesce(g.account_type, 'utilisateur') as account_type
    from utilisateur u left join candidat p on p.id = u.id
    left join (select organisation_id, arg_min(s.nom, s.id) as account_type from sourced join source s on s.id = source_id where type_opportunite = '5-LOW' group by organisation_id) g on g.organisation_id = u.id
""")
def user_projection(spark: SparkSession, d: str) -> DataFrame:
    """A user with the nested profile and the account type of the first group; no password column."""
    low = board.with_source_id(spark, d).where("type_opportunite = '5-LOW'")
    bridge = low.select(F.col("organisation_id").alias("utilisateur_id"), F.col("source_id").alias("groupe_id")).distinct()
    groups = board.sources(spark, d).select("id", F.col("nom").alias("name"))
    rows = nest.first_group(board.users(spark, d).select("id", "username", "email", "role"), bridge, groups, "utilisateur")
    profiles = board.candidates(spark, d).select(F.col("id").alias("utilisateur_id"), "prenom", "niveau_experience")
    rows = nest.with_parent(rows, profiles, "id", "profil", "utilisateur_id", "left")
    return rows.select(
        "id", "username", "email", "role", F.col("profil.prenom").alias("profil_prenom"), F.col("profil.niveau_experience").alias("profil_niveau"),
        F.col("profil").isNotNull().alias("has_profile"), "account_type",
    )


@query("select id, username from utilisateur where exists (select 1 from opportunite where organisation_id = utilisateur.id and type_opportunite = '1-URGENT')")
def semi_member(spark: SparkSession, d: str) -> DataFrame:
    """J4 F10 F11 A13"""
    urgent = board.opportunities(spark, d).where("type_opportunite = '1-URGENT'").select(F.col("organisation_id").alias("id"))
    return nest.members(board.users(spark, d).select("id", "username"), urgent, "id")


@query("select id, username from utilisateur where id not in (select utilisateur_id from notification)")
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    """J5 S6 A10"""
    known = board.notifications(spark, d).select(F.col("utilisateur_id").alias("id"))
    return nest.missing(board.users(spark, d).select("id", "username"), known, "id")


@query("select count(*) as created from utilisateur where id not in (select utilisateur_id from notification)")
def created_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A10"""
    return missing_profile(spark, d).agg(F.count(F.lit(1)).alias("created"))


@query("""
    select u.id, coalesce(arg_min(s.nom, s.id), 'utilisateur') as account_type
    from utilisateur u left join (select distinct organisation_id, source_id from sourced where type_opportunite = '5-LOW') b on b.organisation_id = u.id
    left join source s on s.id = b.source_id group by u.id
""")
def first_group(spark: SparkSession, d: str) -> DataFrame:
    """A7 J7 L4"""
    low = board.with_source_id(spark, d).where("type_opportunite = '5-LOW'")
    bridge = low.select(F.col("organisation_id").alias("utilisateur_id"), F.col("source_id").alias("groupe_id")).distinct()
    groups = board.sources(spark, d).select("id", F.col("nom").alias("name"))
    return nest.first_group(board.users(spark, d).select("id"), bridge, groups, "utilisateur")


@query("select id, id in (select opportunite_id from candidature where candidat_id = 3) as saved from opportunite")
def saved_flag(spark: SparkSession, d: str) -> DataFrame:
    """J8 F15 U3"""
    saved = board.applications(spark, d).where("candidat_id = 3").select("opportunite_id")
    return nest.with_flag(board.opportunities(spark, d).select("id"), saved, "id", "saved")


@query("""
    select u.username || ' - ' || o.titre as candidature, s.s_name || ' / ' || c.statut as document, c.line
    from candidature c join opportunite o on o.id = c.opportunite_id join utilisateur u on u.id = o.organisation_id join supplier s on s.s_suppkey = c.candidat_id
    where c.statut = 'RF'
""")
def display_joins(spark: SparkSession, d: str) -> DataFrame:
    """The two hops that display strings need."""
    rows = board.applications(spark, d).where("statut = 'RF'")
    rows = rows.join(board.opportunities(spark, d).select(F.col("id").alias("opportunite_id"), "titre", "organisation_id"), "opportunite_id")
    rows = rows.join(board.users(spark, d).select(F.col("id").alias("organisation_id"), "username"), "organisation_id")
    rows = rows.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("candidat_id"), "s_name"), "candidat_id")
    return rows.select(F.concat_ws(" - ", "username", "titre").alias("candidature"), F.concat_ws(" / ", "s_name", "statut").alias("document"), "line")


@query("""
    select id, case when id % 5 <> 0 and id % 3 <> 0 then 'P' || id || ' ' || username else 'Profil #' || id end as display,
           coalesce(nullif(case when id % 2 = 0 then '' else username end, ''), nullif(email, ''), '') as shown
    from utilisateur
""")
def display(spark: SparkSession, d: str) -> DataFrame:
    """Names only where both parts are there; the first that is neither null nor empty."""
    key = F.col("id").cast("string")
    prenom = F.when(F.col("id") % 5 != 0, F.concat(F.lit("P"), key)).otherwise("")
    nom = F.when(F.col("id") % 3 != 0, F.col("username"))
    both = P.filled(prenom) & P.filled(nom)
    return board.users(spark, d).select(
        "id",
        F.when(both, F.concat_ws(" ", prenom, nom)).otherwise(F.concat(F.lit("Profil #"), key)).alias("display"),
        X.first_truthy(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("username")), "email").alias("shown"),
    )


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("""
    select u.id, cast(count(*) filter (statut = 'ACTIVE') as bigint) as active, cast(coalesce(sum(n), 0) as bigint) as applicants,
           cast(coalesce(sum(length(titre)), 0) as bigint) as views, cast(floor(coalesce(sum(n), 0) / count(*) + 0.5) as bigint) as mean_applicants
    from utilisateur u join (
        select o.*, count(c.line) as n from opportunite o left join candidature c on c.opportunite_id = o.id group by all
    ) o on o.organisation_id = u.id group by u.id
""")
def org_kpi(spark: SparkSession, d: str) -> DataFrame:
    """One pass for each organisation."""
    rows = nest.child_counts(board.opportunities(spark, d), board.applications(spark, d), "opportunite_id", "n")
    return kpi.posted_kpis(rows, F.col("statut") == "ACTIVE", F.col("n"), F.length("titre"), ["organisation_id"]).withColumnRenamed("organisation_id", "id")


@query("""
    select candidat_id as id, count(distinct opportunite_id) filter (statut = 'NO') as saved, count(distinct opportunite_id) filter (statut <> 'NO') as applied, 1 as interviews, 24 as profile_views
    from candidature group by candidat_id
""")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    """How long each candidate's lists of saved and of applied opportunities are; two figures are constants."""
    pairs = board.applications(spark, d).groupBy("candidat_id", "opportunite_id").agg(F.max(F.col("statut") == "NO").alias("saved"), F.max(F.col("statut") != "NO").alias("applied"))
    return pairs.groupBy(F.col("candidat_id").alias("id")).agg(F.count_if("saved").alias("saved"), F.count_if("applied").alias("applied"), F.lit(1).alias("interviews"), F.lit(24).alias("profile_views"))


@query("""
    select '/opportunities/' || o.id as link, titre as title, type_opportunite as type, case when statut = 'ACTIVE' then 'Active' else 'Closed' end as status,
           case when statut = 'ACTIVE' then 'default' else 'outline' end as variant, strftime(date_publication, '%Y-%m-%d') as posted, strftime(date_limite, '%Y-%m-%d') as deadline,
           (select count(*) from candidature where opportunite_id = o.id) as applicants, length(titre) * 3 as views
    from opportunite o where organisation_id = 7
""")
def posted_table(spark: SparkSession, d: str) -> DataFrame:
    """What an organisation's table shows of each of its opportunities."""
    rows = board.opportunities(spark, d).where("organisation_id = 7")
    asked = nest.members(board.applications(spark, d), rows.select(F.col("id").alias("opportunite_id")), "opportunite_id")
    active = F.col("statut") == "ACTIVE"
    return nest.child_counts(rows, asked, "opportunite_id", "applicants").select(
        F.concat(F.lit("/opportunities/"), F.col("id").cast("string")).alias("link"), F.col("titre").alias("title"), F.col("type_opportunite").alias("type"),
        F.when(active, "Active").otherwise("Closed").alias("status"), F.when(active, "default").otherwise("outline").alias("variant"),
        F.date_format("date_publication", "yyyy-MM-dd").alias("posted"), F.date_format("date_limite", "yyyy-MM-dd").alias("deadline"),
        "applicants", (F.length("titre") * 3).cast("long").alias("views"),
    )


@query("select type_opportunite, count(*) as n from opportunite where statut = 'ACTIVE' group by type_opportunite")
def active_by_type(spark: SparkSession, d: str) -> DataFrame:
    """An extension where the client shows constants."""
    return kpi.active_by_type(board.opportunities(spark, d), F.col("statut") == "ACTIVE", "type_opportunite")


@query("select opportunite_id, candidat_id, count(*) as n from candidature group by all having count(*) > 1")
def dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A12 M12"""
    return validate.not_unique(board.applications(spark, d), ["opportunite_id", "candidat_id"])


# --- rules ----------------------------------------------------------------------------------------------------------


@query("""
    select opportunite_id, candidat_id, line, c.date_creation, o.date_publication from candidature c join opportunite o on o.id = opportunite_id
    where c.date_creation < o.date_publication
""")
def date_violation(spark: SparkSession, d: str) -> DataFrame:
    """F18 C16"""
    opened = board.opportunities(spark, d).select(F.col("id").alias("opportunite_id"), "date_publication")
    rows = board.applications(spark, d).join(opened, "opportunite_id")
    rows = validate.broken(rows, P.deadline_holds(F.col("date_publication"), F.col("date_creation")))
    return rows.select("opportunite_id", "candidat_id", "line", "date_creation", "date_publication")


@query("select id, utilisateur_id from notification where utilisateur_id not in (select id from utilisateur where nation <> 3)")
def fk_violation(spark: SparkSession, d: str) -> DataFrame:
    """Notifications whose user is not among those outside one nation."""
    return validate.orphans(board.notifications(spark, d).select("id", "utilisateur_id"), "utilisateur_id", board.users(spark, d).where("nation <> 3"))


@query("""
    select doc_id, array_to_string(list_filter([case when d.lang is null then 'lang' end, case when quality is null then 'quality' end, case when toxic is null then 'toxic' end], lambda x: x is not null), ',') as missing
    from documents d left join labels using (doc_id) where d.lang is null or quality is null or toxic is null
""")
def null_violation(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a NOT NULL would reject, and their columns."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return validate.missing_values(rows, ["lang", "quality", "toxic"]).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("""
    select id, array_to_string(list_filter([case when length(title) > 10 then 'title' end, case when length(type) > 7 then 'type' end], lambda x: x is not null), ',') as too_long
    from browse where length(title) > 10 or length(type) > 7
""")
def length_violation(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose texts do not fit, which must be none before a column is narrowed."""
    rows = validate.too_long(board.browse(spark, d), {"title": 10, "type": 7})
    return rows.select("id", F.array_join("too_long", ",").alias("too_long"))


@query("""
    select id, array_to_string(list_filter([
        case when not regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') then 'email' end, case when not contains(email, '@') then 'at' end,
        case when length(trim(username)) < 2 then 'name' end,
        case when not (length(pw) >= 8 and regexp_matches(pw, '[a-z]') and regexp_matches(pw, '[A-Z]') and regexp_matches(pw, '[0-9]')) then 'password' end,
        case when pw <> pw2 then 'password2' end, case when length(pw) < 6 then 'login' end,
        case when role is null or role not in ('CANDIDAT', 'ORGANISATION') then 'account_type' end, case when id % 80 > 50 then 'years' end
    ], lambda x: x is not null), ',') as errors
    from (select *, case when id % 4 = 0 then 'Pass' || id else username end as pw, case when id % 9 = 0 then 'other' when id % 4 = 0 then 'Pass' || id else username end as pw2 from utilisateur)
""")
def form_errors(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the forms that each row breaks."""
    pw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Pass"), F.col("id").cast("string"))).otherwise(F.col("username"))
    again = F.when(F.col("id") % 9 == 0, "other").otherwise(pw)
    rules = {
        "email": P.email_shaped(F.col("email")), "at": P.has_at(F.col("email")), "name": P.long_enough(F.col("username"), 2, trim=True),
        "password": P.strong_password(pw), "password2": pw == again, "login": P.long_enough(pw, 6),
        "account_type": P.one_of(F.col("role"), "CANDIDAT", "ORGANISATION"), "years": P.years_in_range(F.col("id") % 80),
    }
    return board.users(spark, d).select("id", F.array_join(validate.errors(rules), ",").alias("errors"))


@query("select page_id, length(url) <= 200 and regexp_matches(url, '^(?:https?|ftps?)://[^\\s/?#.][^\\s/?#]*\\.?[^\\s/?#]*(?::[0-9]+)?(?:[/?#]\\S*)?$') as ok from pages")
def url_check(spark: SparkSession, d: str) -> DataFrame:
    """The shape of a URL."""
    return table(spark, d, "pages").select("page_id", P.url_shaped(F.col("url")).alias("ok"))


@query("""
    select o.id, coalesce(u.role in ('ORGANISATION', 'ADMIN'), false) as may_write,
           coalesce(o.organisation_id = 5, false) or o.id % 11 = 0 as may_change,
           coalesce(u.role = 'ADMIN' or u.role = 'CANDIDAT', false) as may_enter, u.role is not null as any_user,
           case when coalesce(u.role in ('ORGANISATION', 'ADMIN'), false) then '/organization' else '/dashboard' end as home
    from (select id, case when id % 6 = 0 then null else organisation_id end as organisation_id, organisation_id as caller from opportunite) o
    join utilisateur u on u.id = o.caller
""")
def permissions(spark: SparkSession, d: str) -> DataFrame:
    """Who may write, change and enter; a row without an owner belongs to nobody."""
    rows = board.opportunities(spark, d).select("id", F.when(F.col("id") % 6 != 0, F.col("organisation_id")).alias("owner"), F.col("organisation_id").alias("caller"))
    rows = rows.join(board.users(spark, d).select(F.col("id").alias("caller"), "role"), "caller")
    role = F.col("role")
    return rows.select(
        "id",
        P.may_write(F.lit("POST"), role).alias("may_write"),
        P.may_change(F.lit("PUT"), F.col("owner"), F.lit(5), F.col("id") % 11 == 0).alias("may_change"),
        P.may_enter(role, "CANDIDAT").alias("may_enter"),
        P.may_enter(role).alias("any_user"),
        F.when(P.is_organisation(role), "/organization").otherwise("/dashboard").alias("home"),
    )


@query("""
    select id, coalesce(role = 'CANDIDAT', false) as is_candidate, coalesce(role = 'ADMIN', false) as is_admin, case when id % 4 = 0 then false else id % 9 = 5 end as owns_profile, false as is_anonymous
    from utilisateur
""")
def role_predicates(spark: SparkSession, d: str) -> DataFrame:
    """the role rules that no route uses."""
    owner = F.when(F.col("id") % 4 != 0, F.col("id") % 9)
    return board.users(spark, d).select(
        "id", P.is_candidate(F.col("role")).alias("is_candidate"), P.is_admin(F.col("role")).alias("is_admin"),
        P.owns_profile(owner, F.lit(5)).alias("owns_profile"), P.is_anonymous().alias("is_anonymous"),
    )


@query("""
    select id, case when id % 5 = 0 then null else 1000 + id end as exp, coalesce(2000000 >= (case when id % 5 = 0 then null else 1000 + id end) * 1000, true) as expired,
           not coalesce(2000000 >= (case when id % 5 = 0 then null else 1000 + id end) * 1000, true) or id % 3 = 0 as valid,
           id % 2 = 0 and id % 4 = 0 and id % 8 <> 0 as retry
    from utilisateur
""")
def token_checks(spark: SparkSession, d: str) -> DataFrame:
    """Tokens made from the rows are read back, some without an expiry or a payload."""
    key = F.col("id").cast("string")
    payload = F.when(F.col("id") % 10 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"exp": '), (F.col("id") + 1000).cast("string"), F.lit(', "s": "~>?é"}')))
    token = F.when(F.col("id") % 10 == 5, F.concat(F.lit("x."), key)).otherwise(F.concat_ws(".", F.lit("h"), X.url64_encode(payload), F.lit("s")))
    rows = board.users(spark, d).select("id", token.alias("token"))
    now, refresh = F.lit(2_000_000), F.when(F.col("id") % 3 == 0, "r").otherwise("")
    status, url = F.when(F.col("id") % 2 == 0, 401).otherwise(200), F.when(F.col("id") % 8 == 0, "/api/auth/login/").otherwise("/api/sources/")
    return rows.select(
        "id",
        X.token_expiry("token").alias("exp"),
        P.expired(F.col("token"), now).alias("expired"),
        P.session_valid(F.col("token"), refresh, now).alias("valid"),
        P.worth_retrying(status, F.col("id") % 4 != 0, url).alias("retry"),
    )


# --- lists, text, time ----------------------------------------------------------------------------------------------


@query("""
    select p_partkey, array_to_string(items, ';') as items, len(items) as n, array_to_string(items, ', ') as joined
    from (select p_partkey, list_filter(list_transform(string_split(p_brand || ' , ' || p_type || ',, ' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') as items from part)
""")
def split_list(spark: SparkSession, d: str) -> DataFrame:
    """C1 C2 C4 F32"""
    rows = table(spark, d, "part").select("p_partkey", X.split_list(F.concat("p_brand", F.lit(" , "), "p_type", F.lit(",, "), "p_brand")).alias("items"))
    return rows.select("p_partkey", F.array_join("items", ";").alias("items"), F.size("items").cast("long").alias("n"), X.join_list("items").alias("joined"))


@query("""
    with items as (select conv_id, list_sort(list_distinct(list(role))) as s from conversations group by conv_id)
    select conv_id, array_to_string(s, ',') as roles,
           array_to_string(case when list_contains(s, 'system') then list_filter(s, lambda x: x <> 'system') else list_append(s, 'system') end, ',') as toggled,
           array_to_string(case when list_contains(s, 'tool') then s else list_append(s, 'tool') end, ',') as added,
           array_to_string(list_filter(s, lambda x: x <> 'user'), ',') as removed
    from items
""".replace("with items as", ", items as"))
def list_edits(spark: SparkSession, d: str) -> DataFrame:
    """U2 U3 U4 U5 C7"""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("s"))
    s = F.col("s")
    shown = {"roles": s, "toggled": X.toggled(s, F.lit("system")), "added": X.added(s, F.lit(" tool ")), "removed": X.removed(s, F.lit("user"))}
    return rows.select("conv_id", *[F.array_join(c, ",").alias(n) for n, c in shown.items()])


@query("""
    select id, case statut when 'ACTIVE' then 'open' when 'EXPIREE' then 'closed' else 'other' end as label,
           'badge' || case when statut = 'ACTIVE' then ' green' else '' end as classes, not (statut = 'ACTIVE') as flipped,
           try_cast(nullif(case when id % 3 = 0 then '' else cast(id as varchar) end, '') as integer) as number
    from opportunite
""")
def labels_and_casts(spark: SparkSession, d: str) -> DataFrame:
    """P13 P14 C3 C11 C20 C21 S12"""
    active = F.col("statut") == "ACTIVE"
    return board.opportunities(spark, d).select(
        "id",
        X.lookup("statut", {"ACTIVE": "open", "EXPIREE": "closed"}, "other").alias("label"),
        X.join_classes(F.lit("badge"), F.when(active, "green").otherwise("")).alias("classes"),
        (~active).alias("flipped"),
        X.to_number(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string"))).alias("number"),
    )


@query("select id, cast(date_creation at time zone 'UTC' at time zone 'Africa/Tunis' as varchar) as shown from notification")
def local_time(spark: SparkSession, d: str) -> DataFrame:
    """C17"""
    at = X.in_tunis(F.col("date_creation").cast("timestamp"))
    return board.notifications(spark, d).select("id", at.cast("string").alias("shown"))


@query("""
    select id, cast(json_extract_string(props, '$.k') as integer) as k, coalesce(json_extract_string(props, '$.detail'), json_extract_string(props, '$.k')) as message
    from notification
""")
def json_body(spark: SparkSession, d: str) -> DataFrame:
    """A body read by a schema; the first of several fields."""
    return board.notifications(spark, d).select("id", F.from_json("props", "k int").k.alias("k"), X.message_of("props", "detail", "k").alias("message"))


@query("""select id, '{"id":' || id || ',"titre":"' || titre || '","statut":"' || statut || '"}' as body from opportunite""")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """K1"""
    return board.opportunities(spark, d).select("id", F.to_json(F.struct("id", "titre", "statut")).alias("body"))


@query("""
    select id, rtrim(translate(base64(encode(cast(id as varchar))), '+/', '-_'), '=') as uid, cast(id as varchar) as back,
           'Bonjour ' || username || ',' || chr(10) || 'votre compte ' || coalesce(role, 'utilisateur') || ' est ouvert.' as mail
    from utilisateur
""")
def mail_and_links(spark: SparkSession, d: str) -> DataFrame:
    """C14 P8 P10"""
    uid = X.url64_encode("id")
    text = "Bonjour %s,\nvotre compte %s est ouvert."
    mail = F.format_string(text, "username", F.coalesce("role", F.lit("utilisateur")))
    return board.users(spark, d).select("id", uid.alias("uid"), X.url64_decode(uid).alias("back"), mail.alias("mail"))


# --- changes --------------------------------------------------------------------------------------------------------


@query("select type_notification as name from notification union select 'ADMIN' union select 'CANDIDAT' union select 'ORGANISATION'")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    """U6 M9"""
    groups = board.notifications(spark, d).select(F.col("type_notification").alias("name")).distinct()
    wanted = spark.sql("select * from values ('CANDIDAT'), ('ORGANISATION'), ('ADMIN'), ('click') as t(name)")
    return mutate.get_or_create(groups, wanted, ["name"])


@query("select utilisateur_id, count(*) as unread from notification where not lu group by utilisateur_id")
def unread(spark: SparkSession, d: str) -> DataFrame:
    """F16 M15"""
    return board.notifications(spark, d).where("not lu").groupBy("utilisateur_id").agg(F.count(F.lit(1)).alias("unread"))


@query("select id, utilisateur_id, lu or utilisateur_id % 2 = 0 as lu from notification")
def mark_read(spark: SparkSession, d: str) -> DataFrame:
    """A patch on the notifications of half of the users."""
    rows = board.notifications(spark, d).select("id", "utilisateur_id", "lu")
    changes = rows.where("utilisateur_id % 2 = 0").select("id", F.create_map(F.lit("lu"), F.lit("true")).alias("fields"))
    return mutate.patch(rows, changes)


@query("select * from candidature where opportunite_id not in (select id from sourced where source_id = 3)")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    """Source 3 goes with its opportunities and their applications."""
    applications = board.applications(spark, d).withColumn("id", F.col("opportunite_id"))
    tables = {"source": board.sources(spark, d), "opportunite": board.with_source_id(spark, d), "candidature": applications}
    links = [("opportunite", "source_id", "source"), ("candidature", "opportunite_id", "opportunite")]
    return mutate.delete_cascade(tables, links, "source", tables["source"].where("id = 3").select("id"))["candidature"].drop("id")


@query("select id, titre, case when source_id = 3 then null else organisation_id end as organisation_id from sourced")
def set_null(spark: SparkSession, d: str) -> DataFrame:
    """M11"""
    gone = board.users(spark, d).where("nation = 3").select("id")
    return mutate.set_null(board.opportunities(spark, d).select("id", "titre", "organisation_id"), gone, "organisation_id")


@query("""
    select id, titre, statut, organisation_id from opportunite where statut <> 'ARCHIVEE'
    union all select id + 10000000, upper(titre), 'ACTIVE', null from opportunite where type_opportunite = '1-URGENT'
""")
def create_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """M1 M2 M4 K3: defaults for columns that a new row lacks; a delete by key."""
    rows = board.opportunities(spark, d)
    new = rows.where("type_opportunite = '1-URGENT'").select((F.col("id") + 10_000_000).alias("id"), F.upper("titre").alias("titre"))
    kept = mutate.delete(rows.select("id", "titre", "statut", "organisation_id"), rows.where("statut = 'ARCHIVEE'").select("id"))
    return mutate.insert(kept, new, {"statut": F.lit("ACTIVE")})


@query("""
    select id, case when id % 3 = 0 then 'T' || id else titre end as titre, case when id % 6 = 0 then null else date_limite end as date_limite,
           case when id % 3 = 0 then 'changed' else statut end as statut
    from opportunite
""")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """A supplied null clears a field, an absent field stays, and a change is stamped."""
    rows = board.opportunities(spark, d).select("id", "titre", "date_limite", "statut")
    title = F.create_map(F.lit("titre"), F.concat(F.lit("T"), F.col("id").cast("string")))
    both = F.map_concat(title, F.create_map(F.lit("date_limite"), F.lit(None).cast("string")))
    changes = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, both).otherwise(title).alias("fields"))
    return mutate.patch(rows, changes, touched={"statut": F.lit("changed")})


@query("""
    select o.id, case when n.id is not null then 'new' else o.titre end as titre, o.statut from opportunite o left join (select id from opportunite where id % 10 = 1) n on n.id = o.id
""")
def replace_rows(spark: SparkSession, d: str) -> DataFrame:
    """M1 M3: full replacement of some rows."""
    rows = board.opportunities(spark, d).select("id", "titre", "statut")
    return mutate.replace(rows, rows.where("id % 10 = 1").withColumn("titre", F.lit("new")))


@query("""
    select s_suppkey + 1000000 as id, lower(s_name) || '@example.org' as email, case when s_suppkey % 3 = 0 then 2 else 1 end as groupe_id, s_name as nom, 'Bienvenue' as message
    from supplier where s_suppkey % 3 <> 2
""")
def register(spark: SparkSession, d: str) -> DataFrame:
    """Users, memberships and profiles after suppliers sign up; one role may not be chosen."""
    s, none = table(spark, d, "supplier"), F.lit("")
    role = F.when(F.col("s_suppkey") % 3 == 0, "ORGANISATION").when(F.col("s_suppkey") % 3 == 1, "CANDIDAT").otherwise("ADMIN")
    forms = s.select((F.col("s_suppkey") + 1_000_000).alias("id"), F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"), none.alias("first_name"), F.col("s_name").alias("last_name"), role.alias("account_type"))
    users = board.users(spark, d).select("id", "username", "email", none.alias("first_name"), none.alias("last_name"))
    groups = spark.sql("select * from values (1, 'CANDIDAT'), (2, 'ORGANISATION'), (3, 'ADMIN') as t(id, name)")
    bridge = board.users(spark, d).select(F.col("id").alias("utilisateur_id"), F.lit(1).alias("groupe_id")).limit(0)
    profiles = board.users(spark, d).select("id", F.col("id").alias("utilisateur_id"), none.alias("nom"), none.alias("prenom"), none.alias("competences"))
    done = mutate.register(users, groups, bridge, profiles, forms, "Bienvenue")
    out = done.answer.join(done.bridge, F.col("id") == F.col("utilisateur_id")).drop("utilisateur_id")
    return out.join(done.profiles.select(F.col("utilisateur_id").alias("id"), "nom"), "id").select("id", "email", "groupe_id", "nom", "message")


@query("""
    select id as utilisateur_id, '' as nom, cast(null as integer) as annees from utilisateur where id not in (select utilisateur_id from notification)
    union all select distinct utilisateur_id, 'x', cast(null as integer) from notification where utilisateur_id is not null
""")
def auto_profiles(spark: SparkSession, d: str) -> DataFrame:
    """An empty profile for each user without; a column is added to the schema."""
    known = board.notifications(spark, d).select("utilisateur_id").where("utilisateur_id is not null").distinct()
    profiles = known.select(F.col("utilisateur_id").alias("id"), "utilisateur_id", F.lit("x").alias("nom"))
    out = mutate.profiles_for_all(board.users(spark, d).select("id"), profiles)
    return out.withColumn("annees", F.lit(None).cast("int")).drop("id")
