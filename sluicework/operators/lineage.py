"""Downstream impact and upstream root cause over edge tables.

Consumer edges are ``dataset, position, consumer, type, owner, criticality``; upstream edges
``dataset, upstream, type, endpoint``; health rows ``upstream, timestamp, status, details``.
"""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sluicework import fixed_values as fv
from sluicework.operators.joins import lookup_join
from sluicework.session import small_frame

CONSUMERS = "dataset string, position int, consumer string, type string, owner string, criticality string"
UPSTREAMS = "dataset string, upstream string, type string, endpoint string"


def edges(spark: SparkSession, lineage: Mapping[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consumer edges, upstream edges and owners of a lineage configuration."""
    datasets = (lineage or {}).get("datasets") or {}
    consumers = [
        (d, n, c.get("name"), c.get("type"), c.get("owner"), c.get("criticality"))
        for d, i in datasets.items() for n, c in enumerate((i or {}).get("consumers") or [])
    ]
    upstreams = [
        (d, u.get("name"), u.get("type"), u.get("endpoint"))
        for d, i in datasets.items() for u in (i or {}).get("upstream") or []
    ]
    owners = [(d, (i or {}).get("owner", "Unknown")) for d, i in datasets.items()]
    return (
        small_frame(spark, consumers, CONSUMERS),
        small_frame(spark, upstreams, UPSTREAMS),
        small_frame(spark, owners, "dataset string, owner string"),
    )


def level(label: Column) -> Column:
    """Criticality label in upper case; none means LOW."""
    return F.upper(F.coalesce(label, F.lit("LOW")))


def rank(label: Column) -> Column:
    """Place of a label in the order; an unknown label ranks as LOW."""
    return F.coalesce(*[F.when(label == k, v) for k, v in fv.CRITICALITY_RANK.items()], F.lit(1))


def criticality(consumers: DataFrame) -> DataFrame:
    """Highest criticality and number of consumers per dataset; among equal ranks the first listed wins."""
    label = level(F.col("criticality"))
    best = F.min(F.struct((-rank(label)).alias("rank"), F.col("position"), label.alias("label")))
    return consumers.groupBy("dataset").agg(
        best["label"].alias("criticality"), F.count(F.lit(1)).alias("consumer_count")
    )


def impact(datasets: DataFrame, consumers: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Criticality, consumer count and owner of each dataset; unknown datasets are LOW."""
    out = datasets.join(criticality(consumers), "dataset", "left").withColumns({
        "criticality": F.coalesce("criticality", F.lit("LOW")),
        "consumer_count": F.coalesce("consumer_count", F.lit(0)),
    })
    if owners is not None:
        out = out.join(owners, "dataset", "left").withColumn("owner", F.coalesce("owner", F.lit("Unknown")))
    return out


def latest_health(health: DataFrame) -> DataFrame:
    """The newest health row of each upstream."""
    newest = F.max_by(F.struct("status", "details"), F.struct("timestamp", "status", "details"))
    return health.groupBy("upstream").agg(newest.alias("h")).select("upstream", "h.status", "h.details")


#: Upstreams that a root cause names; the rows of ``outages`` are complete.
NAMED_UPSTREAMS = 100


def outages(upstreams: DataFrame, health: DataFrame) -> DataFrame:
    """One row for each dataset and upstream, whether it is down now, with its name and details in words."""
    checked = lookup_join(upstreams.select("dataset", "upstream").distinct(), latest_health(health), ["upstream"])
    return checked.select(
        "dataset", "upstream", F.coalesce(F.col("status") == "DOWN", F.lit(False)).alias("down"), "status", "details",
        F.format_string("%s (%s)", "upstream", F.coalesce("details", F.lit(""))).alias("named"))


def root_cause(datasets: DataFrame, upstreams: DataFrame, health: DataFrame, most: int = NAMED_UPSTREAMS) -> DataFrame:
    """Why a load may have failed: the upstreams of each dataset that are down now.

    The text names the first ``most`` of them in the order of their names and says how many more there
    are. Each task keeps only its own first ones before they meet, so no group collects all texts.
    """
    checked = outages(upstreams, health)
    counts = checked.groupBy("dataset").agg(F.count_if("down").alias("down_count"))
    order = Window.partitionBy("dataset").orderBy("named")
    first = checked.where("down").select("dataset", "named").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    texts = first.groupBy("dataset").agg(F.array_join(F.sort_array(F.collect_list("named")), ", ").alias("down_text"))
    per_dataset = counts.join(texts, "dataset", "left").withColumn("upstream_count", F.lit(1))
    more = F.when(F.col("down_count") > most, F.format_string(" and %d more", F.col("down_count") - most)).otherwise("")
    cause = (
        F.when(F.col("upstream_count").isNull(), fv.MSG["local_issue"])
        .when(F.col("down_count") > 0, F.format_string(fv.MSG["outage"], F.concat("down_text", more)))
        .otherwise(fv.MSG["local_issue_up"])
    )
    return datasets.join(per_dataset, "dataset", "left").select(
        *datasets.columns, F.coalesce("down_count", F.lit(0)).alias("down_count"), cause.alias("root_cause")
    )


def flow_state(consumers: DataFrame, latest_status: DataFrame) -> DataFrame:
    """Whether each consumer is reached by its dataset's latest batch or protected from it."""
    state = (
        F.when(F.col("status").isin("PASSED", "WARNING"), "reached")
        .when(F.col("status") == "BLOCKED", "protected")
        .otherwise("unknown")
    )
    return lookup_join(consumers, latest_status, ["dataset"]).withColumn("state", state)
