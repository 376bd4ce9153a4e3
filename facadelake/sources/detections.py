"""Detector responses as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTION = (
    "struct<defect_id:string,defect_type:string,confidence:double,bbox:struct<x:int,y:int,width:int,height:int>,"
    "mask:string,mask_encoding:string,mask_shape:array<int>>"
)
RESPONSE = f"struct<status:string,error_message:string,image_height_px:int,image_width_px:int,detections:array<{DETECTION}>,_bad:string>"


def parse_responses(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Responses with the reason they are rejected for, null where they are not.

    One bad detection rejects its whole response.
    """
    r = F.from_json(column, RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    incomplete = F.exists(
        "r.detections", lambda d: d["defect_id"].isNull() | d["defect_type"].isNull() | d["confidence"].isNull() | d["bbox"].isNull()
    )
    reason = (
        F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed")
        .when(F.col("r.status").isNull() | F.col("r.detections").isNull(), "missing keys")
        .when(F.col("r.status") != "success", F.concat(F.lit("status: "), F.coalesce("r.error_message", F.lit("Unknown error"))))
        .when(incomplete, "incomplete detection")
    )
    return payloads.withColumn("r", r).withColumn("reject_reason", reason)


def explode_detections(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Detections of good responses, one row each with its zero-based ordinal, and the rejected responses."""
    parsed = parse_responses(payloads, column)
    keys = [c for c in payloads.columns if c != column]
    good = parsed.where("reject_reason IS NULL").select(
        *keys, "r.image_height_px", "r.image_width_px", F.posexplode("r.detections").alias("ordinal", "d")
    )
    good = good.select(*keys, "image_height_px", "image_width_px", "ordinal", "d.*").withColumn("mask_encoding", F.coalesce("mask_encoding", F.lit("none")))
    return good, parsed.where("reject_reason IS NOT NULL").select(*keys, column, "reject_reason")
