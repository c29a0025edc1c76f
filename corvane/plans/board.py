"""The supplied tables seen as the board's entities.

orders are opportunities (with a deadline derived from the key: none for every fourth), customers their organisations,
nations their sources, line items applications, suppliers candidates, events notifications, parts what is browsed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import table

STATUS = {"O": "ACTIVE", "F": "EXPIREE", "P": "ARCHIVEE"}


def opportunities(spark: SparkSession, d: str, only: str | None = None) -> DataFrame:
    """id, titre, type_opportunite, statut, date_publication, date_limite, organisation_id.

    only: a status; the filter is on the stored code, so that it reaches the scan.
    """
    o = table(spark, d, "orders")
    if only is not None:
        o = o.where(F.col("o_orderstatus") == next(k for k, v in STATUS.items() if v == only))
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "EXPIREE").otherwise("ARCHIVEE")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("titre"),
        F.col("o_orderpriority").alias("type_opportunite"),
        status.alias("statut"),
        day.alias("date_publication"),
        F.when(F.col("o_orderkey") % 4 != 0, F.date_add(day, (F.col("o_orderkey") % 60).cast("int"))).alias("date_limite"),
        F.col("o_custkey").alias("organisation_id"),
    )


def active(spark: SparkSession, d: str) -> DataFrame:
    return opportunities(spark, d, "ACTIVE")


def with_source_id(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """opportunities, or `rows` of them, with source_id, which their organisation gives."""
    org = table(spark, d, "customer").select(F.col("c_custkey").alias("organisation_id"), F.col("c_nationkey").alias("source_id"))
    return (opportunities(spark, d) if rows is None else rows).join(org, "organisation_id")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """id, nom, type_source; how nations meet regions is left to Spark's size checks."""
    region = table(spark, d, "region")
    return table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("nom"), F.col("r_name").alias("type_source")
    )


def applications(spark: SparkSession, d: str) -> DataFrame:
    """opportunite_id, candidat_id, statut, line, quantity, date_creation."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("opportunite_id"),
        F.col("l_suppkey").alias("candidat_id"),
        F.concat("l_returnflag", "l_linestatus").alias("statut"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.to_date("l_shipdate").alias("date_creation"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    """id, username, email, role, years: organisations."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise("@example.org")).alias("email"),
        F.when(F.col("c_custkey") % 3 == 0, "CANDIDAT").when(F.col("c_custkey") % 3 == 1, "ORGANISATION").when(F.col("c_custkey") % 10 == 2, "ADMIN").alias("role"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """id, username, prenom, nom, niveau_experience: suppliers, who are candidates with a profile."""
    s = table(spark, d, "supplier")
    band = F.floor(F.col("s_acctbal") / 3000)
    level = F.when(band <= 0, "DEBUTANT").when(band == 1, "JUNIOR").when(band == 2, "CONFIRME").otherwise("SENIOR")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("prenom"), F.col("s_name").alias("nom"), level.alias("niveau_experience")
    )


def notifications(spark: SparkSession, d: str) -> DataFrame:
    """id, utilisateur_id, type_notification, lu (even k in the properties), date_creation, props."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("utilisateur_id"), F.col("event_type").alias("type_notification"), (k % 2 == 0).alias("lu"), F.col("ts").alias("date_creation"), "props"
    )


def browse(spark: SparkSession, d: str) -> DataFrame:
    """id, title, organization, tags, type."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("organization"), F.split("p_name", " ").alias("tags"), F.col("p_type").alias("type"))


#: The same views as common table expressions for DuckDB.
VIEWS = """
    opportunite as (
        select o_orderkey as id, 'Order ' || o_orderkey as titre, o_orderpriority as type_opportunite,
               case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'EXPIREE' else 'ARCHIVEE' end as statut,
               cast(o_orderdate as date) as date_publication,
               case when o_orderkey % 4 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 60 as integer) end as date_limite,
               o_custkey as organisation_id
        from orders
    ), sourced as (
        select opportunite.*, c_nationkey as source_id from opportunite join customer on c_custkey = organisation_id
    ), source as (
        select n_nationkey as id, n_name as nom, r_name as type_source from nation join region on n_regionkey = r_regionkey
    ), candidature as (
        select l_orderkey as opportunite_id, l_suppkey as candidat_id, l_returnflag || l_linestatus as statut, l_linenumber as line,
               l_quantity as quantity, cast(l_shipdate as date) as date_creation
        from lineitem
    ), utilisateur as (
        select c_custkey as id, c_name as username, lower(c_name) || case when c_custkey % 7 = 0 then '' else '@example.org' end as email,
               case when c_custkey % 3 = 0 then 'CANDIDAT' when c_custkey % 3 = 1 then 'ORGANISATION' when c_custkey % 10 = 2 then 'ADMIN' end as role,
               c_acctbal as balance, c_nationkey as nation
        from customer
    ), candidat as (
        select s_suppkey as id, s_name as username, 'P' || s_suppkey as prenom, s_name as nom,
               case when floor(s_acctbal / 3000) <= 0 then 'DEBUTANT' when floor(s_acctbal / 3000) = 1 then 'JUNIOR' when floor(s_acctbal / 3000) = 2 then 'CONFIRME' else 'SENIOR' end as niveau_experience
        from supplier
    ), notification as (
        select event_id as id, user_id as utilisateur_id, event_type as type_notification,
               cast(json_extract_string(props, '$.k') as integer) % 2 = 0 as lu, ts as date_creation, props
        from events
    ), browse as (
        select p_partkey as id, p_name as title, p_brand as organization, string_split(p_name, ' ') as tags, p_type as type from part
    )
"""
