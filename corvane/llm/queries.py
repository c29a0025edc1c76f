"""The queries of the operators, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import additive, chat, exact, infill, licences, mixing, pieces, quality, repeats, runs, sharding, simhash, substrings
from corvane.sources import table

SHARDS = 24


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the least doc_id that links of two bits or fewer reach."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most, with size and CRC of each text."""
    text = F.col("row.text")
    return sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the largest doc_id among equal texts, the size of that group and a digest."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the slot that the mix gives them, and the share of their source."""
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source"]).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        F.round("share", 6).alias("share"),
        "block",
        "slot",
        "place",
        "in_mix",
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as piece ids, with what the second and third best segmentation would change."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op6_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of each row whose vec_id is divisible by 20."""
    return additive.search(table(spark, sf_dir, "embeddings"))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a score that trees fitted on labelled rows outside the held-out fold give."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TRICKY = "\\### Assistant: </turn> ok"  # a text that looks like the template and like an escape


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that looks like the template, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = TRICKY.replace("\\", "\\\\")
    tricky = spark.sql(f"select * from values (-7L, 0, 'user', '{quoted}'), (-7L, 1, 'assistant', '{quoted}') as t(conv_id, turn, role, text)")
    formatted = chat.format_paths(chat.paths(chat.linear_replies(turns.unionByName(tricky))))
    said = chat.read_turns(F.col("formatted"))
    learnt = F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    lines = F.transform("said", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return formatted.select("tree", "formatted", said.alias("said"), learnt.alias("learnt")).select(
        F.col("tree").alias("conv_id"),
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the licence of the whole text and those that single lines name."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", " "))


def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that also start elsewhere."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one in ten with a planted period, with the number of runs, the longest, and digests of all and of what is left."""
    found = runs.collapse_runs(table(spark, sf_dir, "documents"), plant=True)
    lines = F.transform("runs", lambda x: F.concat(x.start.cast("string"), F.lit(","), x.length.cast("string"), F.lit(","), x.period.cast("string"), F.lit("\n")))
    order = F.transform("runs", lambda x: F.struct((-x.length).alias("short"), x.start.alias("start"), x.period.alias("period"), x.length.alias("length")))
    best = F.array_min(order)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for filling in the middle, with digests of the outputs and of what is read back from them."""
    made = infill.restore(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


def op13_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 50-byte strings that also start in a document with a smaller id."""
    return substrings.remove_copies(table(spark, sf_dir, "documents"), keep_bytes=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_shuffled_shards,
        op3_exact_dedup,
        op4_pfair_mix,
        op5_sentencepiece,
        op6_additive_quantisation,
        op7_quality_trees,
        op8_reply_trees,
        op9_licence_digests,
        op10_suffix_trees,
        op11_periodic_runs,
        op12_fill_in_middle,
        op13_suffix_arrays,
    )
}


#: Lines that begin with a notice: all that the SQL drops, as its patterns cannot look ahead. Where text follows a notice
#: on its line, or a licence's own words begin a line with "copyright", only the operator is right.
_COPYRIGHT_LINE = r"^[^a-z0-9©]*(copyright\b|copr\.|\(c\)|©|all rights reserved)"


def _canonical(text: str) -> str:
    """SQL for licences.canonical."""
    return _words(f"lower(coalesce({text}, ''))")


def _looked_up(text: str) -> str:
    """SQL for licences.without_notices, where notices have their lines to themselves."""
    lines = f"string_split(lower(coalesce({text}, '')), chr(10))"
    words = f"' ' || {_words(f"array_to_string(list_filter({lines}, lambda x: not regexp_matches(x, '{_COPYRIGHT_LINE}')), ' ')")} || ' '"
    for pattern, new in licences.HOLDERS:
        words = f"regexp_replace({words}, '{pattern}', '{new}', 'g')"
    return f"trim({words})"


def _words(text: str) -> str:
    words = f"' ' || trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in licences.SPELLINGS.items():
        words = f"replace({words}, ' {old} ', ' {new} ')"
    return f"trim({words})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licences.KNOWN)

SQL: dict[str, str] = {
    "op3_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
    "op8_reply_trees": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)
        ), escaped as (
            select *, replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') as r,
                   replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') as t
            from turns
        )
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(length('### ' || r || ': ' || t || '</turn>' || chr(10))) as bigint) as formatted_chars
        from escaped group by conv_id
    """,
    "op4_pfair_mix": f"""
        with recursive sources as (
            select case when source is null then '-' else '+' || source end as key, count(*) as n, pow(count(*), {mixing.POWER}) as w from documents group by 1
        ), shares as (
            select key, n, cast(greatest(1, round(w / sum(w) over () * {mixing.UNITS})) as hugeint) as u, row_number() over (order by key) as i from sources
        ), one as (
            select list(u order by i) as us, sum(u) as total, count(*) as sources,
                   greatest({mixing.BLOCK_ROWS}, (sum(n) + least({mixing.MOST_SLOTS}, {mixing.MOST_LOOKS} // count(*)) - 1) // least({mixing.MOST_SLOTS}, {mixing.MOST_LOOKS} // count(*))) as size
            from shares
        ), horizon as (
            select min(((n // size + 1) * total + u - 1) // u) as slots from shares cross join one
        ), edf(t, done, pick) as (
            select cast(-1 as bigint), list_transform(us, lambda x: cast(0 as hugeint)), cast(0 as bigint) from one
            union all
            select t + 1, list_transform(done, lambda d, j: d + case when j = i then 1 else 0 end), i
            from (
                select t, done, list_sort(list_transform(range(1, len(us) + 1), lambda j: {{
                    'late': (done[j] * total) // us[j] > t + 1, 'due': ((done[j] + 1) * total + us[j] - 1) // us[j], 'j': j
                }}))[1].j as i
                from edf cross join one cross join horizon where t + 1 < slots
            )
        ), given as (
            select t as slot, pick as i, row_number() over (partition by pick order by t) - 1 as block from edf where t >= 0
        ), ended as (
            select min(slot) as stop from given join shares using (i) cross join one where block = n // size
        ), placed as (
            select doc_id, source, u, i, row_number() over (
                partition by i order by md5('0 ' || coalesce(cast(doc_id as varchar), 'null ' || md5(coalesce(text, '')))), md5(coalesce(text, ''))) - 1 as nth
            from documents join shares on key = case when source is null then '-' else '+' || source end
        )
        select doc_id, source, round(u / total, 6) as share, cast(nth // size as bigint) as block,
               cast(case when slot < stop then slot else stop + ((nth // size + 1) * total + u - 1) // u * sources + p.i - 1 end as bigint) as slot,
               cast(nth % size as integer) as place, coalesce(slot < stop, false) as in_mix
        from placed p cross join one cross join ended left join given g on g.i = p.i and g.block = nth // size
    """,
    "op9_licence_digests": f"""
        with known as (
            select sha256({_looked_up("text")}) as digest, min(licence) as licence from (values {_KNOWN}) v(licence, text) group by 1
        ), lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents
        ), notices as (
            select doc_id, string_agg(distinct licence, ' ' order by licence) as notices, count(*) as n
            from lines join known on digest = sha256({_looked_up("line")}) group by doc_id
        ), texts as (
            select doc_id, sha256({_canonical("text")}) as text_digest, sha256({_looked_up("text")}) as looked_up from documents
        )
        select doc_id, text_digest, licence, coalesce(notices, '') as notices, coalesce(n, 0) as n_notices
        from texts left join known on digest = looked_up left join notices using (doc_id)
    """,
    "op12_fill_in_middle": r"""
        with units as (
            select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
            from documents
        ), numbers as (
            select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
                   cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
            from units
        ), cuts as (
            select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
                   case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
                        when h4 % 100 < 80 then 'spm' else 'psm' end as form
            from numbers
        ), parts as (
            select *, array_to_string(u[1:i], '') as p, array_to_string(u[i + 1:j], '') as m, array_to_string(u[j + 1:], '') as s from cuts
        )
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(text) as restored_sha256
        from parts
    """,
}
