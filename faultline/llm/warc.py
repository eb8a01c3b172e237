"""Not-modified revisits resolved to the responses that they stand for.

A revisit is joined as of its date to the latest earlier full response of the
same canonical URL; it resolves if the validators agree, and then carries the
response's headers with those replaced that a not-modified answer may update.

The join is a sort: records are range-partitioned by URL and date, so a URL of a
third of all records is spread over many tasks, and each task carries the last
response forward over its own records. What a partition's first revisits need
from the partitions before it comes from one row for each URL and partition: the
last response there. Payloads do not move; results refer to the response's id.

Records: record_id, url, date, kind ('response', 'revisit' or other), etag,
last_modified, headers (map, names in lower case). Defined results: a null or
unparseable URL, or a null date, has no earlier response; on one date responses
come before revisits, and further ties go by record_id, the larger one later. A revisit
without validators takes the response as it is. A repeated record is resolved
each time. Other columns are not used, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.common import stage

#: Query parameters that do not name a resource.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid"
#: Header fields that a not-modified answer may update; fields that describe the body stay the response's.
UPDATES = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "set-cookie"]

_URL = r"^(?i:(https?))://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, path without a slash at its end, query
    parameters in order without tracking ones; scheme, port 80 or 443 and
    fragment do not count. Null if the URL is not http(s)."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    port = F.when(part(3).isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(part(4), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(part(5), "&", -1), lambda p: (p != "") & ~p.rlike(rf"^(?i:{TRACKING})(=|$)")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url.rlike(_URL), F.concat(host, port, path, query))


def validators_agree(revisit_etag: Column, revisit_modified: Column, etag: Column, modified: Column) -> Column:
    """Weak comparison of entity tags; without one on the revisit, equal modification dates; without both, yes."""
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    return F.coalesce(F.when(revisit_etag.isNotNull(), weak(revisit_etag) == weak(etag))
                      .when(revisit_modified.isNotNull(), revisit_modified == modified).otherwise(F.lit(True)), F.lit(False))


def resolve(records: DataFrame) -> DataFrame:
    """One row a revisit: record_id, canonical, status ('resolved', 'mismatch',
    'unmatched'), refers_to, refers_to_date, headers (null unless resolved)."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "date", "kind", "etag", "last_modified",
                       F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    r = r.where("kind IN ('response', 'revisit')").withColumn("later", (F.col("kind") == "revisit").cast("int"))
    placed = F.col("canonical").isNotNull() & F.col("date").isNotNull()
    dealt = stage(r.where(placed).repartitionByRange(n, "canonical", "date", "later", "record_id").withColumn("part", F.spark_partition_id()))
    response = F.struct("record_id", "date", "etag", "last_modified", "headers")
    full = F.when(F.col("kind") == "response", response)
    so_far = W.partitionBy("canonical", "part").orderBy("date", "later", "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    revisits = dealt.withColumn("own", F.last(full, ignorenulls=True).over(so_far)).where("kind = 'revisit'")
    # One row for each URL and partition: what the URL's next partitions start with.
    ends = dealt.groupBy("canonical", "part").agg(
        F.max_by(full, F.when(F.col("kind") == "response", F.struct("date", "record_id"))).alias("last"))
    earlier = W.partitionBy("canonical").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).where("carried IS NOT NULL").drop("last")
    matched = revisits.join(carried, ["canonical", "part"], "left").withColumn("to", F.coalesce("own", "carried")).drop("own", "carried", "part")
    loose = r.where(~placed & (F.col("kind") == "revisit")).withColumn("to", F.lit(None).cast(matched.schema["to"].dataType))
    every = matched.unionByName(loose)
    agree = validators_agree(F.col("etag"), F.col("last_modified"), F.col("to.etag"), F.col("to.last_modified"))
    status = F.when(F.col("to").isNull(), "unmatched").when(agree, "resolved").otherwise("mismatch")
    updates = F.map_filter("headers", lambda k, _: k.isin(UPDATES))
    kept = F.map_filter("to.headers", lambda k, _: ~F.array_contains(F.map_keys(updates), k))
    done = F.col("status") == "resolved"
    return every.withColumn("status", status).select(
        "record_id", "canonical", "status", F.when(done, F.col("to.record_id")).alias("refers_to"),
        F.when(done, F.col("to.date")).alias("refers_to_date"), F.when(done, F.map_concat(kept, updates)).alias("headers"))
