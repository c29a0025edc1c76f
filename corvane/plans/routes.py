"""The board's routes as functions from tables and parameters to a page, a row or new snapshots."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.operators import listing, mutate, nest, validate
from corvane.sources.literals import ENUMS


class Invalid(ValueError):
    """A parameter or a row that breaks a rule."""


class Forbidden(PermissionError):
    """The caller may not do this."""


def _choice(params: Mapping, name: str, values: tuple[str, ...]) -> str | None:
    value = params.get(name) or None
    if value is not None and value not in values:
        raise Invalid(f"{value} is no {name}")
    return value


def list_opportunities(opportunities: DataFrame, sources: DataFrame, params: Mapping) -> listing.Page:
    """Active opportunities with their source, by type_opportunite, statut and source, in the order of `ordering`.

    A value that is no member of its enumeration, and a source that does not exist, are errors; empty values do not count.
    """
    kind = _choice(params, "type_opportunite", ENUMS["type_opportunite"])
    status = _choice(params, "statut", ENUMS["statut_opportunite"])
    source = params.get("source") or None
    if source is not None and sources.where(F.col("id") == source).isEmpty():
        raise Invalid(f"there is no source {source}")
    conditions = [F.col("statut") == "ACTIVE", P.equals_or_any(F.col("type_opportunite"), kind), P.equals_or_any(F.col("statut"), status), P.equals_or_any(F.col("source_id"), source)]
    by = listing.terms(params.get("ordering"), ["date_publication", "date_limite", "date_creation"], "-date_publication")
    found = listing.paginate(opportunities.where(P.every(*conditions)), by, params.get("page") or 1)
    # a page of 20 rows meets the sources
    rows = nest.with_parent(found.results, sources, "source_id", "source").drop("source_id")
    return listing.Page(found.count, found.number, found.pages, rows.orderBy(*listing.sorting(by)))


def opportunity(opportunities: DataFrame, key: int):
    """One opportunity; one that is not active is not found, not even by its owner."""
    return listing.single(opportunities.where((F.col("statut") == "ACTIVE") & (F.col("id") == key)))


def list_sources(sources: DataFrame, params: Mapping) -> listing.Page:
    by = listing.terms(params.get("ordering"), ["id", "nom", "url", "type_source"], "id")
    return listing.paginate(sources, by, params.get("page") or 1)


def list_applications(applications: DataFrame, documents: DataFrame, user: int, params: Mapping) -> listing.Page:
    """The caller's applications, each with its documents; the page is cut before the documents join it."""
    columns = ["id", "opportunite_id", "statut", "url_source", "date_creation", "derniere_mise_a_jour"]
    by = listing.terms(params.get("ordering"), columns, "id")
    found = listing.paginate(applications.where(F.col("candidat_id") == user), by, params.get("page") or 1)
    own = nest.members(documents, found.results.select(F.col("id").alias("candidature_id")), "candidature_id")  # of a page of 20 rows
    rows = nest.with_children(found.results, own, "candidature_id", "documents", ["id", "type_document", "fichier", "date_upload"])
    return listing.Page(found.count, found.number, found.pages, rows.orderBy(*listing.sorting(by)))


def account(users: DataFrame, login: str):
    """The account that signs in with `login`: by email, and by user name only where no email is equal.

    Case counts. No account, and more than one, are errors; of a hot address two rows reach the driver.
    """
    return listing.single(listing.first_match(users, F.col("email") == login, F.col("username") == login))


def profile(users: DataFrame, profiles: DataFrame, bridge: DataFrame, groups: DataFrame, user: int):
    """The caller with profile (without years of experience) and account type; not found without a profile."""
    own = profiles.where(F.col("utilisateur_id") == user).drop("annees_experience")
    row = nest.with_parent(users.where(F.col("id") == user), own, "id", "profil", "utilisateur_id", "left")
    out = listing.single(nest.first_group(row, bridge, groups))
    if out.profil is None:
        raise listing.NotFound("no profile")
    return out


def update_profile(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """profiles after partial updates (utilisateur_id, fields); the keys and unknown experience levels may not change."""
    fields = F.map_filter("fields", lambda k, _: ~k.isin("id", "utilisateur_id"))
    level = F.try_element_at(fields, F.lit("niveau_experience"))
    wrong = changes.where(F.coalesce(~level.isin("", *ENUMS["niveau_experience"]), F.map_contains_key(fields, F.lit("niveau_experience"))))
    if not wrong.isEmpty():
        raise Invalid("no such niveau_experience")
    return mutate.patch(profiles, changes.select("utilisateur_id", fields.alias("fields")), "utilisateur_id")


def apply_for(applications: DataFrame, opportunities: DataFrame, rows: DataFrame, user: int) -> DataFrame:
    """applications and `rows` (id, opportunite_id, statut, url_source), with the caller as candidate and default status.

    An opportunity that does not exist, a status that is none, and a second application for an opportunity are errors.
    """
    new = mutate.insert(applications.limit(0), rows.withColumn("candidat_id", F.lit(user).cast("long")), {"statut": F.lit("VUE"), "date_creation": F.current_timestamp(), "derniere_mise_a_jour": F.current_timestamp()})
    out = applications.unionByName(new)
    if not validate.broken(new, P.one_of(F.col("statut"), *ENUMS["statut_candidature"])).isEmpty():
        raise Invalid("no such statut")
    if not validate.orphans(new, "opportunite_id", opportunities).isEmpty():
        raise Invalid("no such opportunity")
    if not validate.not_unique(out.where(F.col("candidat_id") == user), ["candidat_id", "opportunite_id"]).isEmpty():
        raise Invalid("already applied")
    return out


def delete_opportunity(tables: Mapping[str, DataFrame], key: int, user: int, roles: tuple[str, ...]) -> dict[str, DataFrame]:
    """Snapshots of opportunite, candidature and document without an opportunity and what hangs on it.

    Only an organisation or an administrator may write, and only the owner or an administrator this row.
    """
    row = opportunity(tables["opportunite"], key)
    if not {"ORGANISATION", "ADMIN"} & set(roles) or not ("ADMIN" in roles or row.organisation_id == user):
        raise Forbidden("not the owner")
    links = [("candidature", "opportunite_id", "opportunite"), ("document", "candidature_id", "candidature")]
    return mutate.delete_cascade(dict(tables), links, "opportunite", tables["opportunite"].where(F.col("id") == key).select("id"))
