"""Predicates of the board: filters, form rules and permissions, each a boolean Column that is never null."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import any_contains, contains_text, jstrim, token_expiry

#: The shapes that the forms and the server accept.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
URL = r"^(?:https?|ftps?)://[^\s/?#.][^\s/?#]*\.?[^\s/?#]*(?::[0-9]+)?(?:[/?#]\S*)?$"
AUTH_PATHS = ("/auth/login/", "/auth/refresh/")
SAFE_METHODS = ("GET", "HEAD", "OPTIONS")
WRITERS = ("ORGANISATION", "ADMIN")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def every(*conditions: Column | None) -> Column:
    """All of the conditions; one that is None is not asked for."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals_or_any(c: Column, value, absent=(None, "")) -> Column | None:
    """An optional filter: None where no value is given."""
    return None if value in absent else c == value


def board_search(query: str, title: Column, organization: Column, tags: Column) -> Column:
    """Text search over title, organization and tags; the query is neither trimmed nor a pattern, and an empty one passes all."""
    return F.lit(True) if query == "" else contains_text(title, query) | contains_text(organization, query) | any_contains(tags, query)


def admin_search(query: str, *fields: Column) -> Column:
    """Each word of the query is in some field."""
    return every(*[reduce(lambda a, b: a | b, [contains_text(f, w) for f in fields]) for w in query.split()])


def deadline_holds(publication: Column, deadline: Column) -> Column:
    return F.coalesce(deadline >= publication, F.lit(True))


def one_of(c: Column, *values: str) -> Column:
    return _true(c.isin(*values))


def filled(c: Column) -> Column:
    return _true(c != "")


def email_shaped(c: Column) -> Column:
    """Not blank, and of the shape of an address as it stands, untrimmed."""
    return _true((jstrim(c) != "") & c.rlike(EMAIL))


def has_at(c: Column) -> Column:
    return _true(F.contains(c, F.lit("@")))


def strong_password(c: Column) -> Column:
    return _true((F.length(c) >= 8) & c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike(r"[0-9]"))


def long_enough(c: Column, n: int, trim: bool = False) -> Column:
    return _true(F.length(jstrim(c) if trim else c) >= n)


def url_shaped(c: Column) -> Column:
    return _true((F.length(c) <= 200) & c.rlike(URL))


def years_in_range(c: Column) -> Column:
    return _true(c.between(0, 50))


def may_write(method: Column, role: Column, logged_in: Column | None = None) -> Column:
    """Safe methods need a login, others the role of an organisation or an administrator."""
    logged_in = role.isNotNull() if logged_in is None else logged_in
    return _true(logged_in & (method.isin(*SAFE_METHODS) | role.isin(*WRITERS)))


def may_change(method: Column, owner: Column, user: Column, is_admin: Column) -> Column:
    """Safe methods pass; others need the owner or an administrator. A row without an owner belongs to nobody."""
    return _true(method.isin(*SAFE_METHODS) | _true(owner == user) | is_admin)


def may_enter(role: Column, *allowed: str) -> Column:
    """A route for any user where no roles are named, else for those roles and administrators."""
    return _true(role.isNotNull() & ((role == "ADMIN") | (role.isin(*allowed) if allowed else F.lit(True))))


def is_candidate(role: Column) -> Column:
    return one_of(role, "CANDIDAT")


def is_admin(role: Column) -> Column:
    return one_of(role, "ADMIN")


def owns_profile(profile_user: Column, user: Column) -> Column:
    return _true(profile_user == user)


def is_anonymous() -> Column:
    """Lets nobody in."""
    return F.lit(False)


def is_organisation(role: Column) -> Column:
    return one_of(role, *WRITERS)


def expired(token: Column, now_millis: Column) -> Column:
    """Missing, unreadable or without an expiry, or now at the expiry or past it."""
    return F.coalesce(now_millis >= token_expiry(token) * 1000, F.lit(True))


def session_valid(access: Column, refresh: Column, now_millis: Column) -> Column:
    return ~expired(access, now_millis) | _true(refresh != "")


def worth_retrying(status: Column, retried: Column, url: Column) -> Column:
    return _true((status == 401) & ~_true(retried) & ~reduce(lambda a, b: a | b, [F.contains(url, F.lit(p)) for p in AUTH_PATHS]))
