"""Entity resolution: label lookup, registry resolution, attribution of services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.functions.text import address_key, entity_category, filled, is_service, key_chain
from ledgerhop.operators.graph import edge_ends
from ledgerhop.operators.ordering import first_rows, top_rows
from ledgerhop.operators.paths import attribution_paths

# Names and references of the registry's answers.
PROVIDER = "local_registry"


def resolve_labels(addresses: DataFrame, labels: DataFrame) -> DataFrame:
    """Label per ``addresses(address[, chain])``; a miss is an unlabelled intermediary.

    ``labels`` holds one row per (chain, node); its size decides whether it is broadcast.
    Addresses without a chain are Ethereum's.
    """
    known = labels.select(
        F.col("chain").alias("_chain"),
        "node",
        "entity_name",
        F.coalesce("entity_type", F.lit("VASP")).alias("entity_type"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("label_source", F.lit("KNOWLEDGE_BASE")).alias("label_source"),
    )
    chain = F.col("chain") if "chain" in addresses.columns else F.lit("ethereum")
    keyed = addresses.withColumn("_chain", key_chain(chain)).withColumn(
        "node", address_key(chain, F.col("address"))
    )
    joined = keyed.join(known, ["_chain", "node"], "left")
    return joined.select(
        *addresses.columns,
        "entity_name",
        F.coalesce("entity_type", F.lit("INTERMEDIARY")).alias("entity_type"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("label_source", F.lit("UNRESOLVED")).alias("label_source"),
    )


def label_map(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with a name for all edge ends, once per (case, node)."""
    keep = [c for c in ("case_id",) if c in edges.columns]
    ends = edge_ends(edges).select(*keep, "chain", "node").distinct()
    named = labels.filter(F.col("entity_name").isNotNull())
    return ends.join(
        named.select("chain", "node", "entity_name", "entity_type", "confidence"), ["chain", "node"]
    )


def _typed_records(registry: DataFrame) -> DataFrame:
    """Registry records with category, service flag and the defaults of a single match."""
    category = entity_category(F.coalesce("entity_type", F.lit("VASP")))
    return registry.select(
        F.col("registry_chain").alias("chain"),
        "node",
        "file_no",
        "position",
        F.coalesce(filled(F.col("entity_name")), filled(F.col("name")), F.lit("Unknown Entity")).alias(
            "distinct_name"
        ),
        F.coalesce("entity_id", F.concat(F.lit("entity_"), F.substring("node", 1, 10))).alias("entity_id"),
        F.coalesce(filled(F.col("entity_name")), filled(F.col("name")), F.lit("Identified Entity")).alias(
            "entity_name"
        ),
        category.alias("category"),
        is_service(F.col("vasp_status"), category).alias("vasp"),
        F.coalesce(filled(F.col("source")), F.lit(PROVIDER)).alias("source"),
        F.coalesce(
            filled(F.col("source_reference")),
            filled(F.col("label_source")),
            F.lit("registry://verified_local"),
        ).alias("source_reference"),
        "confidence",
        "notes",
    )


def registry_status(registry: DataFrame) -> DataFrame:
    """One row per (chain, node): AMBIGUOUS with several names, else the first record.

    Pure aggregates; nothing is collected per address.
    """
    rows = _typed_records(registry)
    order = F.struct("file_no", "position")
    grouped = rows.groupBy("chain", "node").agg(
        (F.min("distinct_name") != F.max("distinct_name")).alias("_several"),
        F.bool_or("vasp").alias("_any_vasp"),
        F.count(F.lit(1)).alias("records"),
        F.min_by(F.struct("entity_id", "entity_name", "category", "vasp", "source", "source_reference"), order).alias("r"),
    )
    several = F.col("_several")
    nothing = F.lit(None).cast("string")
    return grouped.select(
        "chain",
        "node",
        F.when(several, "AMBIGUOUS").otherwise("RESOLVED").alias("resolution_status"),
        F.when(several, nothing).otherwise(F.col("r.entity_id")).alias("entity_id"),
        F.when(several, "Multiple candidates").otherwise(F.col("r.entity_name")).alias("entity_name"),
        F.when(several, "UNKNOWN").otherwise(F.col("r.category")).alias("category"),
        F.when(several, F.col("_any_vasp")).otherwise(F.col("r.vasp")).alias("vasp_status"),
        F.when(several, PROVIDER).otherwise(F.col("r.source")).alias("source"),
        F.when(several, "registry://ambiguous_match").otherwise(F.col("r.source_reference")).alias(
            "source_reference"
        ),
        F.when(several, F.col("records")).otherwise(F.lit(0)).alias("candidates"),
    )


def resolve_registry(addresses: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolution of ``addresses(chain, address)`` with status NOT_FOUND for misses."""
    chain = key_chain(F.col("chain"))
    keyed = addresses.withColumn("node", address_key(F.col("chain"), F.col("address"))).withColumn(
        "_chain", chain
    )
    status = registry_status(registry).withColumnRenamed("chain", "_chain")
    found = keyed.join(status, ["_chain", "node"], "left")
    return found.drop("chain").withColumnRenamed("_chain", "chain").select(
        *[c for c in addresses.columns if c not in ("chain", "node")],
        "chain",
        "node",
        F.coalesce("resolution_status", F.lit("NOT_FOUND")).alias("resolution_status"),
        "entity_id",
        "entity_name",
        "category",
        F.coalesce("vasp_status", F.lit(False)).alias("vasp_status"),
        F.coalesce("source", F.lit(PROVIDER)).alias("source"),
        F.coalesce("source_reference", F.lit("registry://not_found")).alias("source_reference"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def candidate_rows(registry: DataFrame) -> DataFrame:
    """Candidates of ambiguous addresses, one row per record, in reading order."""
    status = registry_status(registry).filter(F.col("resolution_status") == "AMBIGUOUS")
    category = entity_category(F.coalesce("entity_type", F.lit("EXCHANGE")))
    rows = registry.select(
        F.col("registry_chain").alias("chain"),
        "node",
        "file_no",
        "position",
        F.coalesce("entity_id", F.concat(F.lit("ent_"), F.substring("node", 1, 8))).alias("entity_id"),
        F.coalesce("entity_name", F.lit("Unknown Entity")).alias("entity_name"),
        category.alias("category"),
        is_service(F.col("vasp_status"), category).alias("vasp_status"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )
    return rows.join(status.select("chain", "node"), ["chain", "node"], "left_semi")


def distinct_addresses(addresses: DataFrame, limit_per_case: int | None = None) -> DataFrame:
    """``addresses(case_id, chain, address, rank)`` once per chain-aware key, first spelling kept.

    ``limit_per_case`` keeps the first addresses of a case by ``rank``; it is off unless
    asked for.
    """
    keyed = addresses.withColumn("node", address_key(F.col("chain"), F.col("address"))).filter(
        F.col("node") != ""
    )
    once = first_rows(keyed, ["case_id", "chain", "node"], ["rank"])
    if limit_per_case is None:
        return once
    return top_rows(once, ["case_id"], ["rank", "node"], limit_per_case, "_n").drop("_n")


def annotate_nodes(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Nodes with the registry's view as a metadata map."""
    status = registry_status(registry)
    joined = nodes.drop("entity_name").join(status, ["chain", "node"], "left")
    resolved = F.col("resolution_status") == "RESOLVED"
    ambiguous = F.col("resolution_status") == "AMBIGUOUS"
    metadata = (
        F.when(
            resolved,
            F.map_from_arrays(
                F.array(*[F.lit(k) for k in ("entity_type", "is_vasp", "source", "source_reference")]),
                F.array("category", F.col("vasp_status").cast("string"), "source", "source_reference"),
            ),
        )
        .when(
            ambiguous,
            F.map_from_arrays(
                F.array(F.lit("resolution_status"), F.lit("candidates_count")),
                F.array("resolution_status", F.col("candidates").cast("string")),
            ),
        )
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return joined.select(
        *[c for c in nodes.columns if c != "entity_name"],
        "entity_name",
        metadata.alias("metadata"),
        F.coalesce("resolution_status", F.lit("NOT_FOUND")).alias("resolution_status"),
    )


def attribute_services(
    nodes: DataFrame, registry: DataFrame, trees: DataFrame, cases: DataFrame
) -> DataFrame:
    """One attribution per resolved service node of a case, with path and transfer ids."""
    services = registry_status(registry).filter(
        (F.col("resolution_status") == "RESOLVED") & F.col("vasp_status")
    )
    hit = nodes.select("case_id", "chain", "node", "address", "hop").join(services, ["chain", "node"])
    paths = attribution_paths(trees, cases, hit.select("case_id", "node"))
    return (
        hit.join(paths.drop("hop"), ["case_id", "node"])
        .join(cases.select("case_id", "direction"), "case_id")
        .select(
            "case_id",
            "chain",
            "node",
            "address",
            "entity_id",
            "entity_name",
            "category",
            "hop",
            "direction",
            "path",
            "transfer_ids",
            "source",
            "source_reference",
        )
    )
