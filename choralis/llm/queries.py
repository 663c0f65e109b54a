"""Queries of the operators for training text, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choralis.llm import abuse, encoding, language, leakage, lookalike, merkle, survivor, tokens, truncation, variants
from choralis.llm.common import catalogue_values, values
from choralis.sources.tables import table


def _lyrics(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lyrics")


def p1_scores(s: SparkSession, d: str) -> DataFrame:
    return abuse.scores(_lyrics(s, d), "id", "plain_lyrics").drop("source").distinct()


def p1_rates(s: SparkSession, d: str) -> DataFrame:
    """Of each source: texts, and the share with at least one abusive place."""
    return (
        abuse.scores(_lyrics(s, d), "id", "plain_lyrics", "source")
        .select("id", "source", "places")
        .distinct()
        .groupBy("source")
        .agg(F.count("*").alias("texts"), F.count_if(F.col("places") > 0).alias("abusive"), F.avg((F.col("places") > 0).cast("int")).alias("rate"))
    )


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return abuse.scores(_lyrics(s, d), "id", "plain_lyrics").filter("places > 0").select("id").distinct()


def p2_repair(s: SparkSession, d: str) -> DataFrame:
    return encoding.repair(catalogue_values(s, d)).select("field", "id", "restored", "mapping").distinct()


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return encoding.repair(catalogue_values(s, d)).select("field", "id").distinct()


def p3_survivors(s: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(_lyrics(s, d), table(s, d, "lyric_sources"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return survivor.clear_winners(_lyrics(s, d), table(s, d, "lyric_sources"))


def _hurt_texts(s: SparkSession, d: str):
    """Tells, at the executor, lyrics texts that were decoded with the wrong encoding."""
    model = encoding.pair_model(values(_lyrics(s, d), ["plain_lyrics"]))

    def hurt():
        doctor = encoding.Doctor(model.value)
        return lambda x: doctor.value(x)[0]

    return hurt


def p4_segments(s: SparkSession, d: str) -> DataFrame:
    """Every text's passages with language and confidence."""
    f = language.identify(_lyrics(s, d), table(s, d, "lyric_labels")).select("id", F.explode("segments").alias("p"))
    return f.select("id", "p.lang", F.col("p.first").alias("first_line"), F.col("p.last").alias("last_line"), "p.confidence").distinct()


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return language.missing_or_wrong(_lyrics(s, d), table(s, d, "lyric_labels"), _hurt_texts(s, d))


def p5_groups(s: SparkSession, d: str) -> DataFrame:
    """Spellings of each artist, song and album: field, group and member forms."""
    artists, titles = variants.link(table(s, d, "tracks"))
    return artists.unionByName(titles).select("field", "group", "value").distinct()


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return variants.spellings(table(s, d, "tracks"))


def p6_collapse(s: SparkSession, d: str) -> DataFrame:
    return merkle.collapse(table(s, d, "tracks")).select("first_id", "copies")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return merkle.copies(table(s, d, "tracks"))


def p7_forms(s: SparkSession, d: str) -> DataFrame:
    """One row per value of the tables; rows that were delivered twice come twice."""
    return lookalike.forms(catalogue_values(s, d))


def p7_groups(s: SparkSession, d: str) -> DataFrame:
    return lookalike.groups(catalogue_values(s, d))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    v = catalogue_values(s, d)
    model = encoding.pair_model(v)

    def hurt():
        doctor = encoding.Doctor(model.value)
        return lambda x: doctor.value(x)[0]

    return lookalike.found(v, hurt)


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(s, d, "documents"))


def p9_leaks(s: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return p9_leaks(s, d).select("doc_id", "item_id")


def p10_judged(s: SparkSession, d: str) -> DataFrame:
    return truncation.judge(table(s, d, "documents"))


def p10_rates(s: SparkSession, d: str) -> DataFrame:
    return truncation.rates(p10_judged(s, d))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return p10_judged(s, d).filter("cut").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p1_rates": p1_rates,
    "p2_found": p2_found,
    "p2_repair": p2_repair,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_collapse": p6_collapse,
    "p7_found": p7_found,
    "p7_forms": p7_forms,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_judged": p10_judged,
    "p10_rates": p10_rates,
}

_LEAF = "translate(lower(upper(replace(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'ß', 'ss'))), 'ς', 'σ')"


def oracle_sql() -> dict[str, str]:
    names = "list_sort([" + ", ".join(_LEAF.format(c) for c in merkle.NAMES) + "])"
    same = f"WITH s AS (SELECT id, {names} AS names, duration FROM tracks), g AS (SELECT names, duration, min(id) AS first_id, count(*) AS copies FROM s GROUP BY names, duration)"
    notes = ", ".join(f"'{n}'" for n in survivor.NOTES)
    size = "CASE WHEN {0} IS NOT NULL AND regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g') <> '' AND NOT (length({0}) <= 60 AND lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) IN ({1})) THEN length({0}) END"
    cand = " UNION ALL ".join(
        f"SELECT track_id, id, '{f}' AS field, {'CASE WHEN instrumental IS NOT NULL THEN 0 END' if f == 'instrumental' else size.format(f, notes)} AS size, coalesce(trust, 0) AS trust, coalesce(epoch_us(updated_at), -(1::BIGINT << 62)) AS upd FROM l"
        for f in survivor.FIELDS
    )
    with_c = f"WITH t AS (SELECT source, max(trust) AS trust FROM lyric_sources GROUP BY source), l AS (SELECT DISTINCT lyrics.*, t.trust FROM lyrics LEFT JOIN t USING (source) WHERE track_id IS NOT NULL), c AS (SELECT * FROM ({cand}) WHERE size IS NOT NULL)"
    return {
        "p3_found": with_c
        + """ SELECT track_id, field, min(id) AS id FROM c a WHERE track_id IN (SELECT track_id FROM l GROUP BY 1 HAVING count(DISTINCT id) > 1)
AND size = (SELECT max(size) FROM c b WHERE b.track_id = a.track_id AND b.field = a.field) AND trust = (SELECT max(trust) FROM c b WHERE b.track_id = a.track_id AND b.field = a.field)
AND upd = (SELECT max(upd) FROM c b WHERE b.track_id = a.track_id AND b.field = a.field) GROUP BY track_id, field HAVING count(DISTINCT id) = 1""",
        "p6_found": same + " SELECT first_id, id AS copy_id FROM s JOIN g ON s.names = g.names AND s.duration IS NOT DISTINCT FROM g.duration WHERE id <> first_id",
        "p6_collapse": same + " SELECT first_id, copies FROM g",
    }
