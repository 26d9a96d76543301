"""Resolution of not-modified revisits in web archives.

A revisit that a server answered with "not modified" has no payload of its own.  It belongs to the
latest earlier full response of the same canonical URL, provided that their validators agree; its
record then takes that response's payload and headers, with those headers replaced that a not-modified
answer may change.  The as-of join goes block of time by block of time, so that a URL with very many
captures is not one task's work: what the last response of a block is travels to later blocks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time units of a block; results do not depend on it.
BLOCK = 3600

#: Header fields that a not-modified answer may set anew.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical(url: Column) -> Column:
    """The URL without scheme, fragment, `www.`, default port, tracking parameters and closing slash, its
    host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    rest = F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?]&+", "?"), "&&+", "&")
    rest = F.regexp_replace(rest, "[?&/]+$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(host), "^www[.]", ""), ":(80|443)$", ""), rest)


def _agreement(mine: Column, theirs: Column) -> Column:
    """What the validators say; entity tags are compared without their weakness mark."""

    def tag(headers: Column) -> Column:
        return F.regexp_replace(headers["etag"], "^W/", "")

    tags = tag(mine).isNotNull() & tag(theirs).isNotNull()
    dates = mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull()
    return (
        F.when(tags, F.when(tag(mine) == tag(theirs), "resolved").otherwise("mismatch"))
        .when(dates, F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )


def resolve(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per revisit: all its columns, then `url_key`, `outcome`, `response_id`, `response_digest` and
    `merged` (headers).

    `records` has `record_id`, `url`, `ts` (long), `kind` ('response' or 'revisit'), `status`, `headers`
    (names in lower case) and `digest`.  A full response has kind 'response' and status 200.  Earlier means
    a smaller (ts, record_id); records equal in both stand by kind (a response first) and digest.  Outcomes: 'resolved'; 'mismatch' (validators differ); 'unverified' (no
    validator in common); 'no_response' (none is earlier, or URL or time is null).  Only 'resolved' rows get
    a digest and headers; `response_id` also names a response that did not fit.  Null headers count as
    empty.  Repeated rows are resolved one by one.  Columns named like a new one are replaced.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    # records that share a time and an id stand by kind and digest
    order = F.struct("ts", "record_id", "kind", "digest")
    response = F.when(
        (F.col("kind") == "response") & (F.col("status") == 200),
        F.struct(order.alias("at"), F.col("record_id").alias("id"), headers.alias("headers"), F.col("digest").alias("digest")),
    )
    keyed = records.select(
        F.struct(*[f"`{c}`" for c in records.columns]).alias("row"),
        canonical(F.col("url")).alias("key"),
        F.floor(F.col("ts") / block).alias("block"),
        order.alias("at"),
        response.alias("response"),
        (F.col("kind") == "revisit").alias("asks"),
    )
    placed = keyed.where("key is not null and block is not null")
    # the last response of a block, and from those the last one before each block
    ends = placed.where("response is not null").groupBy("key", "block").agg(F.max_by("response", "at").alias("end"))
    blocks = placed.where("asks").select("key", "block").distinct()
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.join(ends, ["key", "block"], "full")
        .select("key", "block", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    )
    within = Window.partitionBy("key", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last("response", ignorenulls=True).over(within)).where("asks")
    found = (
        near.join(carried, ["key", "block"], "left")
        .select("row", "key", F.coalesce("near", "carried").alias("found"))
        .unionByName(keyed.where("asks and (key is null or block is null)").select("row", "key", F.lit(None).cast(keyed.schema["response"].dataType).alias("found")))
    )
    mine = F.coalesce(F.col("row.headers"), F.create_map().cast("map<string,string>"))
    outcome = F.when(F.col("found").isNull(), "no_response").otherwise(_agreement(mine, F.col("found.headers")))
    new = F.map_filter(mine, lambda name, _: name.isin(PERMITTED))
    kept = F.map_filter(F.col("found.headers"), lambda name, _: ~F.map_contains_key(new, name))
    good = F.col("outcome") == "resolved"
    judged = found.withColumn("outcome", outcome)
    flat = judged.select(
        "row",
        F.col("key").alias("url_key"),
        "outcome",
        F.col("found.id").alias("response_id"),
        F.when(good, F.col("found.digest")).alias("response_digest"),
        F.when(good, F.map_concat(kept, new)).alias("merged"),
    )
    added = ["url_key", "outcome", "response_id", "response_digest", "merged"]
    held = [c for c in records.columns if c.lower() not in added]
    return flat.select(*[F.col("row")[c].alias(c) for c in held], *added)


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from pages: each page is a response, asked for again some time later.

    A page's id gives the times; its content gives tag and digest.  Some responses are errors, some
    revisits carry a weak tag, an old one, a date or nothing to compare.
    """
    p, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(html.cast("binary")), 1, 12), F.lit('"'))
    changed = F.concat(F.lit("T"), (p * 10 - p % 7).cast("string"))
    at = p * 10
    later = p * 10 + 5 + p % 3 * 40000

    def fields(**named: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("k"), v.alias("v")) for k, v in named.items()])
        return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))

    def date(ts: Column) -> Column:
        return F.concat(F.lit("D"), ts.cast("string"))

    response = pages.select(
        (p * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"),
        F.when(p % 17 == 0, 503).otherwise(200).alias("status"),
        fields(
            content_type=F.lit("text/html"), content_length=F.octet_length(html).cast("string"), etag=tag,
            last_modified=changed, cache_control=F.lit("max-age=60"), date=date(at),
        ).alias("headers"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    kind = p % 5
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        fields(
            etag=F.when(kind == 0, F.lit(None)).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 2, F.lit('"old"')).otherwise(tag),
            last_modified=F.when((kind == 0) & (p % 2 == 0), changed), cache_control=F.lit("max-age=900"), date=date(later),
            server=F.lit("x"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
