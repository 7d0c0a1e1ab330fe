"""Queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stage, table
from .addresses import address_ids, same_address_pairs
from .entity_match import match_entities

from .mixing import mix, mix_report
from .names import name_ids, same_name_pairs
from .packing import pack, packing_report
from .section_profile import SECTION_FEATURES
from .similarity_groups import describe, similarity_groups
from .tokens import token_counts
from .truncation import truncated, truncation_report
from .vocabulary import gazetteer

CANDIDATES, RECORDS = "servizi_povo_candidati_match", "cultura_socialita_e_spazi_comuni"


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, CANDIDATES).select(F.col("service_row").alias("id"), F.col("service_name").alias("name"), F.col("service_address").alias("address"))


def _pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, CANDIDATES).select(F.col("poi_id").alias("id"), F.col("poi_name").alias("name"), F.col("poi_address").alias("address"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name once for each entity that bears it."""
    records = table(spark, sf_dir, RECORDS).select("scheda_id", F.col("attore").alias("value")).distinct()
    return _services(spark, sf_dir).select("id", F.col("name").alias("value")).distinct().select("value").unionByName(_pois(spark, sf_dir).select("id", F.col("name").alias("value")).distinct().select("value")).unionByName(records.select("value"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, RECORDS).select(F.col("indirizzo").alias("value"))
    return _services(spark, sf_dir).select(F.col("address").alias("value")).distinct().unionByName(_pois(spark, sf_dir).select(F.col("address").alias("value")).distinct()).unionByName(records)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and POIs that are the same place."""
    found = match_entities(_services(spark, sf_dir), _pois(spark, sf_dir))
    return found.where("matched").select(F.col("service_id").alias("service_row"), "poi_id").distinct()


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of services and POIs with score, confidence and decision."""
    return match_entities(_services(spark, sf_dir), _pois(spark, sf_dir)).withColumnRenamed("service_id", "service_row")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that name the same organisation."""
    pairs = same_name_pairs(_names(spark, sf_dir), gazetteer(_addresses(spark, sf_dir)))
    return pairs.select(F.col("a").alias("nome_a"), F.col("b").alias("nome_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its organisation: one row each, however many spellings an organisation has."""
    ids = name_ids(_names(spark, sf_dir), gazetteer(_addresses(spark, sf_dir)))
    return ids.select(F.col("value").alias("nome"), F.col("org_id").alias("organizzazione"), "activity", "word", "given", "number")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every writing with its civic address: one row each, however many writings an address has."""
    return address_ids(_addresses(spark, sf_dir)).select(F.col("value").alias("indirizzo"), F.col("address_id").alias("indirizzo_civico"), "kind", "word", "number", "suffix", "locality")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writings that denote the same civic address."""
    return same_address_pairs(_addresses(spark, sf_dir)).select(F.col("a").alias("indirizzo_a"), F.col("b").alias("indirizzo_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of one group."""
    pairs = similarity_groups(table(spark, sf_dir, "assegnazione_cluster_sezioni"), "sez21_id", SECTION_FEATURES).pairs
    return pairs.select(F.col("a").alias("sez21_id_a"), F.col("b").alias("sez21_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sections with their size and most typical members."""
    return describe(similarity_groups(table(spark, sf_dir, "assegnazione_cluster_sezioni"), "sez21_id", SECTION_FEATURES).members)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each notebook or piece, for each capacity, and the container's unused tokens."""
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    packed = pack(sizes, table(spark, sf_dir, "containers"))
    return packed.select("container_kind", "container", F.col("id").alias("doc_id"), "piece", "tokens", "unused")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused space by kind."""
    return packing_report(pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "containers")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of notebooks with their repeats, in the order of their virtual finish time."""
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"])
    return mix(sizes, table(spark, sf_dir, "mix_targets")).select("source", F.col("id").alias("doc_id"), F.col("pass").alias("repeat"), "tokens", "finish")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares by source."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mix(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks whose stored text was cut."""
    flags = truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return flags.where("truncated").select(F.col("id").alias("doc_id"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source the notebooks at a length spike, those of them without terminal punctuation, and those cut by both tests."""
    return truncation_report(truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must hold, by kind: the notebooks packed, containers over their capacity, wrong rests of containers,
    and notebooks that fit whole but were split."""
    containers = table(spark, sf_dir, "containers")
    packed = stage(pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), containers))
    filled = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("used"), F.max("unused").alias("unused"), F.min("unused").alias("least")).join(containers, "container_kind")
    bad = filled.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"), F.count_if((F.col("used") + F.col("unused") != F.col("capacity_tokens")) | (F.col("unused") != F.col("least"))).alias("wrong_rest"))
    documents = packed.groupBy("container_kind", "id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces")).join(containers, "container_kind")
    whole = documents.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if((F.col("tokens") <= F.col("capacity_tokens")) & (F.col("pieces") > 1)).alias("split"))
    return whole.join(bad, "container_kind")


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix must hold, by source: tokens within one longest document of the target and no repeat beyond the permitted."""
    targets = table(spark, sf_dir, "mix_targets")
    mixed = stage(mix(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]), targets))
    whole = mixed.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("longest"))
    report = mix_report(mixed, targets).join(targets.select("source", "max_repeats"), "source").crossJoin(F.broadcast(whole))
    return report.select("source", (F.abs(F.col("tokens") - F.col("target_weight") * F.col("total")) <= F.col("longest")).alias("on_target"), (F.col("repeats") <= F.col("max_repeats")).alias("permitted"))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source the notebooks at a spike of the length histogram, and those of them without terminal punctuation."""
    return truncation_report(truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")).select("source", "texts", "at_limit", "unterminated")


_P9_SQL = """
WITH d AS (SELECT coalesce(source, '') AS source, length(text) AS chars, strlen(text) AS bytes, right(text, 1) AS last FROM documents WHERE text IS NOT NULL),
u AS (SELECT source, 'chars' AS unit, chars AS len, 0 AS slack FROM d UNION ALL SELECT source, 'bytes', bytes, 3 FROM d),
t AS (SELECT *, max(len) OVER (PARTITION BY source, unit) AS top FROM u),
s AS (SELECT source, unit, top, slack, count(*) FILTER (len >= top - slack) AS spike, count(*) FILTER (len < top - slack AND len >= 0.8 * top) AS below FROM t GROUP BY ALL),
k AS (SELECT source, max(top) FILTER (unit = 'chars') AS top_chars, max(top) FILTER (unit = 'bytes') AS top_bytes FROM s WHERE spike >= 5 AND spike >= 8 * (below * (slack + 1) / (0.2 * top)) GROUP BY source),
a AS (SELECT d.source, last, coalesce(chars = top_chars, false) OR coalesce(bytes BETWEEN top_bytes - 3 AND top_bytes, false) AS at_top FROM d LEFT JOIN k USING (source))
SELECT source, count(*) AS texts, count(*) FILTER (at_top) AS at_limit, count(*) FILTER (at_top AND last NOT IN ('.', '!', '?', '。', '！', '？', ';')) AS unterminated FROM a GROUP BY source"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_matches": p1_matches,
        "p2_found": p2_found,
        "p2_groups": p2_groups,
        "p3_found": p3_found,
        "p3_classes": p3_classes,
        "p5_found": p5_found,
        "p5_classes": p5_classes,
        "p7_containers": p7_containers,
        "p7_report": p7_report,
        "p7_documents": p7_documents,
        "p8_mix": p8_mix,
        "p8_shares": p8_shares,
        "p8_limits": p8_limits,
        "p9_found": p9_found,
        "p9_report": p9_report,
        "p9_limits": p9_limits,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p7_documents": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS split, 0 AS overfull, 0 AS wrong_rest FROM containers",
        "p8_limits": "SELECT source, true AS on_target, true AS permitted FROM mix_targets",
        "p9_limits": _P9_SQL,
    }
