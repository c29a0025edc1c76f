"""Changes as functions from snapshots to snapshots; write the result to a new path, never over the one being read."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """`table` and `rows`; columns that rows lack, or hold nulls in, get the default, or null."""
    for name, default in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in rows.columns else default)
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def patch(table: DataFrame, changes: DataFrame, key: str = "id", touched: dict[str, Column] | None = None) -> DataFrame:
    """Partial update. changes: the key and a map column `fields` from column name to text, null values included.

    A field in the map is set, to null if its value is null; a field not in the map stays. Columns of `touched` are set on
    each row that changes (times of modification). One change for each key.
    """
    marks = changes.select(F.col(key).alias("_key"), "fields")
    out = table.join(marks, F.col(key) == F.col("_key"), "left")
    cols = []
    for name, kind in table.dtypes:
        has = F.coalesce(F.map_contains_key("fields", F.lit(name)), F.lit(False))
        col = F.when(has, F.try_element_at("fields", F.lit(name)).try_cast(kind)).otherwise(F.col(name)) if name != key else F.col(name)
        if touched and name in touched:
            col = F.when(F.col("_key").isNotNull(), touched[name]).otherwise(col)
        cols.append(col.alias(name))
    return out.select(*cols)


def replace(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """`table` with the rows of the same keys put in the place of its own."""
    return delete(table, rows.select(key), key).unionByName(rows.join(table.select(key), key, "left_semi").select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """`table` without the rows whose `column` is among `keys`, which has one column. Rows with a null there stay."""
    gone = keys.select(F.col(keys.columns[0]).alias("_gone"))
    return table.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def delete_cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows `keys` (column id) of table `name` and whatever hangs on them.

    links: (child, its column, parent), each parent before its own children; every table has an id.
    """
    out = dict(tables)
    gone = {name: keys.select(F.col(keys.columns[0]).alias("id"))}
    out[name] = delete(tables[name], gone[name])
    parents = {parent for _, _, parent in links}
    for child, column, parent in links:
        if parent in gone and child not in parents:  # nothing hangs on it, so its own keys are not needed
            out[child] = delete(out[child], gone[parent], column)
        elif parent in gone:
            mark = gone[parent].withColumnRenamed("id", "_gone")
            more = tables[child].join(mark, F.col(column) == F.col("_gone"), "left_semi").select("id")
            gone[child] = gone[child].unionByName(more).distinct() if child in gone else more
            out[child] = delete(tables[child], gone[child])
    return out


def set_null(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """`table` with `column` null where it names one of `keys`."""
    gone = keys.select(F.col(keys.columns[0]).alias("_gone")).distinct()
    kept = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
    return table.join(gone, F.col(column) == F.col("_gone"), "left").select(*[kept if c == column else c for c in table.columns])


def get_or_create(table: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """`table` with those rows of `wanted` that it lacks by the columns `on`."""
    return table.unionByName(wanted.join(table, on, "left_anti").dropDuplicates(on), allowMissingColumns=True)


def attach(bridge: DataFrame, pairs: DataFrame) -> DataFrame:
    """A bridge table with more pairs, each once."""
    return bridge.unionByName(pairs).distinct()


def profiles_for_all(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """profiles with an empty one for each user without; ids come after the largest there is."""
    new = users.join(profiles.select(F.col("utilisateur_id").alias("_user")), F.col("id") == F.col("_user"), "left_anti")
    text = {c: F.lit("") for c, kind in profiles.dtypes if kind == "string"}
    return insert(profiles, new.select(F.col("id").alias("utilisateur_id")), {"id": _next_id(profiles, "utilisateur_id"), **text})


def _next_id(table: DataFrame, key: str) -> Column:
    # a user has one profile and a positive id, so the largest id plus the user's is new and needs no global numbering
    return F.lit(table.agg(F.max("id")).first()[0] or 0) + F.col(key)


def save(df: DataFrame, root: str, version: int) -> None:
    """Writes a snapshot as root/version=N; an error where there is one already, so that none is overwritten while read."""
    df.write.parquet(f"{root}/version={version}")


def load(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The snapshot that was saved as `version`."""
    return spark.read.parquet(f"{root}/version={version}")


@dataclass(frozen=True)
class Registered:
    users: DataFrame
    bridge: DataFrame
    profiles: DataFrame
    answer: DataFrame


def register(users: DataFrame, groups: DataFrame, bridge: DataFrame, profiles: DataFrame, forms: DataFrame, message: str) -> Registered:
    """Users, group memberships and profiles after `forms` (id, email, first_name, last_name, account_type) are taken in.

    Forms with an email that a user has, with a role that users cannot choose, or that share an email with a smaller id,
    are left out. The user's name is the email; the profile takes the names.
    """
    valid = forms.where(F.col("account_type").isin("CANDIDAT", "ORGANISATION")).join(users.select("email"), "email", "left_anti")
    valid = valid.groupBy("email").agg(F.min_by(F.struct(*forms.columns), "id").alias("f")).select("f.*")
    fresh = valid.select("id", F.col("email").alias("username"), "email", "first_name", "last_name")
    joined = valid.join(groups.select(F.col("name").alias("account_type"), F.col("id").alias("groupe_id")), "account_type")
    new = valid.select(F.col("id").alias("utilisateur_id"), F.col("last_name").alias("nom"), F.col("first_name").alias("prenom"))
    text = {c: F.lit("") for c, kind in profiles.dtypes if kind == "string"}
    return Registered(
        insert(users, fresh),
        attach(bridge, joined.select(F.col("id").alias("utilisateur_id"), "groupe_id")),
        insert(profiles, new, {"id": _next_id(profiles, "utilisateur_id"), **text}),
        fresh.select("id", "username", "email", F.lit(message).alias("message")),
    )
