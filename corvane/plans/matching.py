"""Queries that find by words: matches of candidates and opportunities, and search over a trigram index."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.operators import search
from corvane.plans import board
from corvane.plans.registry import query
from corvane.sources import table
from corvane.sources.shared import shared_folder


def wanted_words(spark: SparkSession, d: str) -> DataFrame:
    """(id, returned, mot): what the parts of an opportunity's applications are called, some thirty rows a word at any size."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")).alias("mot"))
    lines = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "R").alias("returned"))
    return lines.join(part, "l_partkey").select("id", "returned", "mot")


@query("""
    , worded as (
        select o.id, o.organisation_id, l_returnflag = 'R' as returned, p_brand || ' ' || p_partkey as mot
        from lineitem join part on p_partkey = l_partkey join opportunite o on o.id = l_orderkey
    ), a as (
        select distinct organisation_id as id, mot from worded join utilisateur u on u.id = organisation_id where returned and role = 'CANDIDAT'
    ), b as (
        select distinct w.id, mot from worded w
    ), na as (select id, count(*) as n from a group by id), nb as (select id, count(*) as n from b group by id
    ), scored as (
        select a.id as candidat_id, b.id as opportunite_id, count(*) / (any_value(na.n) + any_value(nb.n) - count(*)) as share
        from a join b using (mot) join na on na.id = a.id join nb on nb.id = b.id group by a.id, b.id
    ), levelled as (
        select candidat_id, opportunite_id, share + case when u.nation % 5 + 1 = cast(o.type_opportunite[1] as integer) then 0.1 else 0.0 end as score
        from scored join utilisateur u on u.id = candidat_id join opportunite o on o.id = opportunite_id where share >= 0.25
    )
    select candidat_id, opportunite_id, round(score, 6) as score, cast(rank as integer) as rank
    from (select *, row_number() over (partition by candidat_id order by score desc, opportunite_id) as rank from levelled) where rank <= 10
""")
def match_score(spark: SparkSession, d: str) -> DataFrame:
    """The ten opportunities that share most words with each candidate, a tenth more for an equal level."""
    words = wanted_words(spark, d)
    owned = words.where("returned").join(board.opportunities(spark, d).select("id", "organisation_id"), "id")
    mine = owned.groupBy(F.col("organisation_id").alias("id")).agg(F.collect_set("mot").alias("mots"))
    people = board.users(spark, d).where("role = 'CANDIDAT'").select("id", (F.col("nation") % 5 + 1).cast("int").alias("niveau"))
    jobs = board.opportunities(spark, d).select("id", F.substring("type_opportunite", 1, 1).cast("int").alias("niveau"))
    left = people.join(mine, "id")
    right = jobs.join(words.groupBy("id").agg(F.collect_set("mot").alias("mots")), "id")
    found = search.best_matches(left, right, "mots", "niveau", at_least=0.25, best=10)
    return found.select(F.col("left_id").alias("candidat_id"), F.col("right_id").alias("opportunite_id"), F.round("score", 6).alias("score"), "rank")


@query("""
    select id, title, organization from browse
    where contains(lower(title), 'rand#12') or contains(lower(organization), 'rand#12') or len(list_filter(tags, lambda t: contains(lower(t), 'rand#12'))) > 0
""")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """what text_search finds, by a stored index of trigrams."""
    rows, path = board.browse(spark, d), shared_folder(spark)
    fields = ["title", "organization"], ["tags"]
    parts = search.index_parts(rows, *fields)
    search.save_index(search.trigram_index(rows, *fields, parts=parts), path, parts)
    contains = lambda x: P.board_search(x, F.col("title"), F.col("organization"), F.col("tags"))
    return search.indexed_search(rows, spark.read.parquet(path), "RAND#12", contains).select("id", "title", "organization")
