"""Resolution of not-modified revisits in web archive records.

A revisit record (a 304 answer) refers to what its server had sent before. It is resolved to the
latest earlier full response of the same canonical URL by an as-of join; the validators of both
are compared, and the stored answer's headers are updated by those that a 304 may carry.

The as-of join is made of windows over slim rows (keys, times, validators; no payloads): records of
a URL are dealt into periods, a window within a period finds the latest response so far, and the
last response of every period is carried to later ones. A URL that has a large share of all records
is spread over its periods. Payloads follow at the end: only responses that some revisit resolves to are moved, by id and
digest, and a response with very many revisits is copied to several tasks.

Defined results: a record without a time or URL resolves nothing and is not resolved; of responses
at the same time the one with the larger record_id counts; a response at the very time of a revisit
is earlier if its record_id is smaller; header maps may be null. Rows that repeat a record_id count once: of several with other
content the one that is first by type (responses before revisits), time, URL and digest of url, time, headers and payload, everywhere.
Rows without a record_id are never repeats: each such revisit gives a row, and such responses are found like others, as if
their id were smaller than all (of several at the same time, one by their validators and that digest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plan import cut, table, with_rank

#: Headers of a 304 that replace the stored ones; all others of the 304 are ignored.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning")
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref gclid fbclid".split()
PERIODS = 256
#: Revisits of one response that one task joins with its payload.
REVISITS = 10_000


def canonical_url(url: Column) -> Column:
    """Scheme and a leading ``www.`` or ``m.`` dropped, host in lower case, default port, fragment, tracking
    parameters and a final slash dropped; the other parameters in order."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(
        F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(*TRACKING))), "&"
    )
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _clean_etag(tag: Column) -> Column:
    """Weak comparison: the opaque part alone."""
    return F.regexp_replace(tag, r"^W/", "")


def _digest() -> Column:
    """Of what a record holds, whatever the order of its headers."""
    headers = F.to_json(F.array_sort(F.map_entries("headers")))
    return F.md5(F.to_json(F.struct("url", F.unix_micros("captured").alias("at"), headers.alias("headers"), "payload")).cast("binary"))


def _key(record_id: str, digest: Column | str) -> Column:
    return F.concat_ws(":", F.col(record_id).cast("string"), digest)


def resolve_revisits(records: DataFrame, periods: int = PERIODS) -> DataFrame:
    """For every revisit: record_id, canonical_url, response_id, outcome, headers, payload.

    ``records``: record_id long, record_type ('response' or 'revisit'), url string, captured timestamp,
    headers map<string,string> (names in lower case), payload string. Outcome is 'resolved',
    'etag mismatch', 'last-modified mismatch' or 'no earlier response'; only resolved revisits get headers and
    payload. An entity tag decides where both have one, else the last-modified time, else none is needed.
    """
    no_id = F.col("record_id").isNull()
    slim = (
        records.where(F.col("record_type").isin("response", "revisit"))
        .select(
            "record_id",
            (F.col("record_type") == "revisit").alias("is_revisit"),
            canonical_url(F.col("url")).alias("canonical_url"),
            F.unix_micros("captured").alias("at"),
            _clean_etag(F.element_at("headers", "etag")).alias("etag"),
            F.element_at("headers", "last-modified").alias("modified"),
            F.when(F.col("record_type") == "revisit", F.col("headers")).alias("fresh"),
            _digest().alias("digest"),
            F.when(no_id, F.monotonically_increasing_id()).alias("nth"),  # keeps rows without an id apart, and spreads them
        )
    )
    order = F.struct("is_revisit", "at", "canonical_url", "digest")
    slim = cut(
        slim.groupBy("record_id", "nth").agg(F.min_by(F.struct(*[c for c in slim.columns if c not in ("record_id", "nth")]), order).alias("r")).select("record_id", "r.*")
    )
    splits = slim.where("at is not null").approxQuantile("at", [k / periods for k in range(1, periods)], 0.5 / periods)
    edges = sorted(set(splits))
    usable = slim.where("at is not null and canonical_url is not null")
    dealt = with_rank(usable, F.col("at"), edges, "period")
    found = F.struct("at", "record_id", "etag", "modified", "digest")
    response = F.when(~F.col("is_revisit"), found)
    so_far = Window.partitionBy("canonical_url", "period").orderBy("at", "record_id", "is_revisit", "etag", "modified", "digest").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.select("record_id", "is_revisit", "canonical_url", "at", "etag", "modified", "period", "fresh", F.last(response, ignorenulls=True).over(so_far).alias("near")).where(
        "is_revisit"
    )
    # the last response of every period and the periods that have revisits, one row each
    per_period = dealt.groupBy("canonical_url", "period").agg(F.max(response).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_period.select("canonical_url", "period", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    joined = near.join(carried, ["canonical_url", "period"]).withColumn("response", F.coalesce("near", "carried"))
    outcome = (
        F.when(F.col("response").isNull(), "no earlier response")
        .when(F.col("etag").isNotNull() & F.col("response.etag").isNotNull(), F.when(F.col("etag") == F.col("response.etag"), "resolved").otherwise("etag mismatch"))
        .when(
            F.col("modified").isNotNull() & F.col("response.modified").isNotNull(),
            F.when(F.col("modified") == F.col("response.modified"), "resolved").otherwise("last-modified mismatch"),
        )
        .otherwise("resolved")
    )
    matched = cut(
        joined.select(
            "record_id", "canonical_url", F.col("response.record_id").alias("response_id"), outcome.alias("outcome"), "fresh",
            _key("response.record_id", "response.digest").alias("key"), F.xxhash64("record_id", "canonical_url", "at").alias("spread"),
        )
    )
    nothing = {"headers": F.lit(None).cast("map<string,string>"), "payload": F.lit(None).cast("string")}
    columns = ["record_id", "canonical_url", "response_id", "outcome", "headers", "payload"]
    missing = (
        slim.where("is_revisit and (at is null or canonical_url is null)")
        .select("record_id", "canonical_url", F.lit(None).cast("long").alias("response_id"), F.lit("no earlier response").alias("outcome"))
        .withColumns(nothing)
    )
    unresolved = matched.where("outcome <> 'resolved'").withColumns(nothing).select(*columns)
    good = matched.where("outcome = 'resolved'")
    wanted = good.groupBy("key").agg(F.ceil(F.count("*") / REVISITS).cast("int").alias("copies"))
    # a response is joined with its revisits in as many tasks as these need; the busiest thousand are known everywhere
    busy = F.broadcast(wanted.where("copies > 1").orderBy(F.desc("copies"), "key").limit(1000))
    responses = records.where("record_type = 'response'").select(_key("record_id", _digest()).alias("key"), F.col("headers").alias("stored"), "payload")
    few = responses.join(busy, "key", "left_anti").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    many = responses.join(busy, "key").dropDuplicates(["key"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    apart = good.join(busy, "key").withColumn("copy", F.pmod("spread", F.col("copies")).cast("int")).drop("copies")
    answered = good.join(busy, "key", "left_anti").join(few, "key", "left").unionByName(apart.join(many, ["key", "copy"], "left").drop("copy"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    permitted = F.map_filter(F.coalesce("fresh", empty), lambda k, _: k.isin(*PERMITTED))
    stored = F.coalesce("stored", empty)
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    resolved = answered.select("record_id", "canonical_url", "response_id", "outcome", merged.alias("headers"), "payload")
    return resolved.unionByName(unresolved).unionByName(missing)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records from a table of pages (page_id, url, html), as a crawl would have left them.

    Every page is a full response at second 10 * page_id with an entity tag and a last-modified
    time, and a revisit 5 seconds later in a later crawl round (round length 5 pages), which sends back the tag
    (weak where page_id is even), a stale tag for every 7th page, or the time alone for every 3rd.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    second = F.col("page_id") * 10
    modified = F.concat(F.lit("t"), F.floor(F.col("page_id") / 4).cast("string"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    response = F.map_from_entries(
        F.array(
            entry("content-type", F.lit("text/html")), entry("etag", tag), entry("last-modified", modified), entry("date", second), entry("cache-control", F.lit("max-age=60"))
        )
    )
    sent = F.when(F.col("page_id") % 7 == 0, F.lit('"stale"')).when(F.col("page_id") % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    later = second + 55
    with_tag = F.map_from_entries(F.array(entry("etag", sent), entry("date", later), entry("content-type", F.lit("text/plain"))))
    with_time = F.map_from_entries(F.array(entry("last-modified", modified), entry("date", later), entry("content-length", F.lit("0"))))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("record_type"), "url", F.timestamp_seconds(second).alias("captured"), response.alias("headers"), F.col("html").alias("payload")
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("record_type"),
        "url",
        F.timestamp_seconds(later).alias("captured"),
        F.when(F.col("page_id") % 3 == 0, with_time).otherwise(with_tag).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Every revisit of the records made from ``pages``, with digests of what it resolves to.

    Pages without a page_id, whose records have neither id nor time, count once for each canonical URL and html.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    unnumbered = pages.where("page_id is null").withColumns({"_url": canonical_url(F.col("url")), "_tag": F.md5(F.coalesce("html", F.lit("")).cast("binary"))})
    once = unnumbered.dropDuplicates(["_url", "_tag"]).select(*pages.columns)
    out = resolve_revisits(records_of_pages(pages.where("page_id is not null").unionByName(once)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return out.select(
        "record_id", "canonical_url", "response_id", "outcome", text.alias("headers"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256")
    )
