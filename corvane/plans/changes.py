"""Queries on what changes between snapshots of the opportunities, and on narrower and bucketed snapshots."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import changelog, snapshots
from corvane.plans import board
from corvane.plans.registry import query
from corvane.sources.shared import shared_folder

_LATER = """
    , vieux as (select id, titre, statut, date_limite from opportunite),
    neuf as (
        select id, case when id % 5 = 1 then upper(titre) else titre end as titre, statut,
               case when id % 20 = 1 then null when id % 10 = 3 then date_limite + 7 else date_limite end as date_limite
        from vieux where statut <> 'ARCHIVEE' union all
        select id + 10000000, titre, 'ACTIVE', null from vieux where statut = 'ARCHIVEE' and id % 2 = 0
    )
"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = board.opportunities(spark, d).select("id", "titre", "statut", "date_limite")
    i = F.col("id")
    title = F.when(i % 5 == 1, F.upper("titre")).otherwise(F.col("titre"))
    limit = F.when(i % 20 == 1, F.lit(None)).when(i % 10 == 3, F.date_add("date_limite", 7)).otherwise(F.col("date_limite"))
    new = old.where("statut <> 'ARCHIVEE'").select("id", title.alias("titre"), "statut", limit.alias("date_limite"))
    more = old.where("statut = 'ARCHIVEE' and id % 2 = 0").select((i + 10_000_000).alias("id"), "titre", F.lit("ACTIVE").alias("statut"), F.lit(None).cast("date").alias("date_limite"))
    return old, new.unionByName(more)


@query(f"""
    {_LATER}
    select coalesce(n.id, v.id) as id, case when n.id is null then 'delete' when v.id is null then 'insert' else 'update' end as op,
           case when n.id is null or v.id is null then '' else
               concat_ws(',', case when n.titre is distinct from v.titre then 'titre' end, case when n.statut is distinct from v.statut then 'statut' end,
                         case when n.date_limite is distinct from v.date_limite then 'date_limite' end) end as changed,
           n.titre, n.statut, n.date_limite
    from vieux v full outer join neuf n on n.id = v.id
    where n.id is null or v.id is null or n.titre is distinct from v.titre or n.statut is distinct from v.statut or n.date_limite is distinct from v.date_limite
""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """K3 J12 full outer join: inserts, deletes and updates between two snapshots, with the columns that changed."""
    log = changelog.diff(*_snapshots(spark, d))
    return log.select("id", "op", F.array_join("changed", ",").alias("changed"), "row.titre", "row.statut", "row.date_limite")


@query(f"""
    {_LATER}
    , entries as (
        select id, 1 as seq, titre, statut, date_limite, false as gone from neuf
        union all select id, 2, titre, 'EXPIREE', date_limite, false from neuf where id % 3 = 0
        union all select id, 3, null, null, null, true from neuf where id % 6 = 0
        union all select id, 4, 'again', 'ACTIVE', null, false from neuf where id % 12 = 0
    )
    select id, titre, statut, date_limite from entries qualify row_number() over (partition by id order by seq desc) = 1 and not gone
""")
def merged_log(spark: SparkSession, d: str) -> DataFrame:
    """K3 M1: a snapshot after an ordered log in which rows change, go and come back; the last change of a key wins."""
    old, new = _snapshots(spark, d)
    later = new.where("id % 3 = 0").withColumn("statut", F.lit("EXPIREE"))
    back = new.where("id % 12 = 0").select("id", F.lit("again").alias("titre"), F.lit("ACTIVE").alias("statut"), F.lit(None).cast("date").alias("date_limite"))
    log = changelog.diff(old, new, seq=1)
    entry = lambda df, seq, op: df.select("id", F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.array().cast("array<string>").alias("changed"), F.struct(*df.columns).alias("row"), changelog.digest(df.columns).alias("digest"))
    gone = entry(new.where("id % 6 = 0"), 3, changelog.DELETE).withColumn("row", F.lit(None).cast(dict(log.dtypes)["row"])).withColumn("digest", F.lit(None).cast("string"))
    for more in (entry(later, 2, changelog.UPDATE), gone, entry(back, 4, changelog.INSERT)):
        log = log.unionByName(more)
    return changelog.apply_log(old, log)


@query("""
    select id, titre, statut from (select id, substr(titre, 1, 20) as titre, statut from opportunite)
    where (select max(length(titre)) from opportunite) <= 20
""")
def narrowed(spark: SparkSession, d: str) -> DataFrame:
    """Titles narrowed to twenty characters, which is done only where none is longer."""
    return snapshots.narrow(board.opportunities(spark, d).select("id", "titre", "statut"), {"titre": 20})


@query("""
    select o.id, count(c.line) as n, coalesce(cast(sum(c.quantity) as double), 0) as quantity
    from opportunite o left join candidature c on c.opportunite_id = o.id group by o.id
""")
def bucketed_children(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of applications from bucketed snapshots of two schema versions, without an exchange."""
    root = shared_folder(spark)
    o = snapshots.Bucketed(spark, f"{root}/opportunite", "id", 16)
    rows = board.opportunities(spark, d).select("id", "titre", "statut")
    o.save(rows.where("id % 2 = 0"), 1)
    o.save(rows.where("id % 2 <> 0").withColumn("annees", F.lit(None).cast("int")), 2)
    c = snapshots.Bucketed(spark, f"{root}/candidature", "opportunite_id", 16)
    c.save(board.applications(spark, d).select("opportunite_id", "line", "quantity"), 1)
    children = c.load([1]).groupBy("opportunite_id").agg(F.count("line").alias("n"), F.sum("quantity").alias("quantity"))
    parts = [o.load([v]).join(children, F.col("id") == F.col("opportunite_id"), "left").drop("opportunite_id") for v in (1, 2)]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))
