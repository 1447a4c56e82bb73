"""Small builders for sighting rows and category tables."""

import json

from placerank.schemas import SIGHTING

RUN = "20260901T000000Z"


def sighting(source, name, category="zichar_family", **kw):
    extra = kw.pop("extra", {})
    row = {
        "run_id": RUN, "source_key": source, "category_key": category, "category_group": "family",
        "party_size": 5, "query": "best zi char Singapore",
        "page_url": f"https://{source}.test/{name.replace(' ', '-')}", "name": name, "cuisine": [],
        "confidence": 1.0, "captured_at": "2026-09-01T00:00:00+00:00", "extra": extra,
    }
    row.update(kw)
    return row


def sightings(spark, rows, run=None):
    rows = [{**r, "seq": i, **({"run_id": run} if run else {})} for i, r in enumerate(rows)]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return from_lines(spark, lines)


def from_lines(spark, lines):
    from pyspark.sql import functions as F

    return lines.select(F.from_json("value", SIGHTING).alias("r")).select("r.*")
