"""Rules of robots files, and which addresses they keep out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rules(files: DataFrame, host: str, body: str, agent: str) -> DataFrame:
    """host and path of every disallowed prefix that applies to `agent`: the rules of its own group, else those of `*`.

    Comments are cut off; only user-agent and disallow lines count; empty rules forbid nothing. Null bodies have no rules.
    """
    lines = files.select(F.col(host).alias("host"), F.posexplode(F.split(F.col(body), "\r?\n")).alias("no", "line"))
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    pair = lines.select("host", "no", F.lower(F.trim(F.regexp_extract(clean, "^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(clean, "^[^:]+:(.*)$", 1)).alias("v")).where(F.col("k").isin("user-agent", "disallow"))
    # consecutive agent lines share the rules after them
    w = W.partitionBy("host").orderBy("no")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    group = pair.withColumn("g", F.sum(starts.cast("int")).over(w))
    of = group.where("k = 'user-agent'").select("host", "g", F.lower("v").alias("agent")).where(F.col("agent").isin("*", agent.lower()))
    own = of.groupBy("host").agg(F.max(F.col("agent") != "*").alias("named"))
    mine = of.join(own, "host").where(F.col("named") == (F.col("agent") != "*")).select("host", "g").distinct()
    return group.where("k = 'disallow' and v <> ''").join(mine, ["host", "g"]).select("host", F.col("v").alias("path")).distinct()


def permitted(addresses: DataFrame, url: str, rule: DataFrame) -> DataFrame:
    """Addresses that no rule of their host forbids: an equi-join on the host with the prefix as a further condition."""
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1))
    path = F.regexp_extract(url, "^[a-z]+://[^/]*(/[^?#]*)", 1)
    a = addresses.withColumns({"__host": host, "__path": F.when(path == "", "/").otherwise(path)})
    r = rule.select(F.col("host").alias("__rh"), F.col("path").alias("__rp"))
    return a.join(r, (F.col("__host") == F.col("__rh")) & F.col("__path").startswith(F.col("__rp")), "left_anti").drop("__host", "__path")


def is_page(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(content_type)).rlike("^(text/html|application/xhtml\\+xml)"), F.lit(False))
