"""URL filters as a temporal list join, in DataFrame operations only.

A list is dated: an entry says that from a date on a domain is blocked, allowed or taken off
the list. A window over each domain's entries turns them into validity intervals. Captures
are reduced to their distinct (host, fetch date), each host is expanded into its domain
suffixes, and an equi-join on the suffix with the date inside the interval, an as-of join,
finds the entries active at that date. The longest active suffix decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import free_names, materialize, release

#: A host has so many characters at most; a longer one is none.
MAX_HOST = 253
#: Among entries of one domain and date the first of these wins.
ACTIONS = ("block", "allow", "remove")


def host_of(url: Column) -> Column:
    """The host of an address, in lower case and without a dot at its end; null if there is none.

    Read as browsers read it: space and control characters around the address, and tabs and
    line ends inside it, do not count; a backslash is a slash; after a scheme of the web any
    number of slashes may follow; a user goes up to the last @; %-codes are decoded; a bracketed
    number is one part. An address without a scheme has a host if that holds a dot. A host
    over MAX_HOST characters is none. Every step is linear in the address, however long.
    """
    clean = F.regexp_replace(F.trim(F.lower(url), F.lit("".join(map(chr, range(0x21))))), r"[\t\n\r]++", "")
    slashed = F.translate(clean, "\\", "/")
    web, other = r"^(?:https?|wss?|ftp):/*+", r"^(?:[a-z][a-z0-9+.-]*+:)?//+"
    named = slashed.rlike(web) | slashed.rlike(other)
    rest = F.when(slashed.rlike(web), F.regexp_replace(slashed, web, "")).otherwise(F.regexp_replace(slashed, other, ""))
    # what may be a host and more stops at the first of these; a longer one cannot be a host
    authority = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    last = F.substring_index(authority, "@", -1)
    bracket = F.regexp_extract(last, r"^\[[^\]]*+\]", 0)
    plain = F.regexp_extract(F.substring_index(last, ":", 1), r"^[^\x00-\x20]*+", 0)
    coded = F.when(plain.contains("%"), F.lower(F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain))).otherwise(plain)
    host = F.rtrim(F.when(bracket != "", bracket).otherwise(coded), F.lit("."))
    bare = authority.rlike(r"^(?:[^@:\s]*+@)?[^@:\s]++(?::[0-9]*+)?$") & host.contains(".") & ~host.startswith(".")
    return F.when((host != "") & (F.length(host) <= MAX_HOST) & (named | bare), host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, starts, ends): when each entry is active; ends null while it still is.

    Domains are compared in lower case without space around and a dot at the end. Null and
    empty domains, null and malformed dates and unknown actions take no part; repeated entries
    count once.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    domain = F.regexp_replace(F.trim(F.lower("domain")), r"\.+$", "")
    one = entries.select(domain.alias("domain"), F.col("dated").try_cast("date").alias("starts"), rank.alias("rank")).where("domain <> '' and starts is not null and rank > 0").groupBy("domain", "starts").agg(F.min("rank").alias("rank"))
    ends = F.lead("starts").over(Window.partitionBy("domain").orderBy("starts"))
    return one.withColumn("ends", ends).where(F.col("rank") < len(ACTIONS)).select("domain", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), "starts", "ends")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """``captures`` with host, matched_domain, action and kept, one row per row, repeated ones included.

    Captures without a URL, host or fetch date (null or malformed) match nothing: matched_domain
    is null and they are kept, as are hosts over MAX_HOST characters; addresses may be of any length.
    Columns named as the result's own, in any case of letters, are
    replaced; others may have any names. Empty tables give an empty result, or one without matches.
    Intervals and verdicts, an entry's and a host and date's, are written before they are joined,
    so that the captures of a hot host can be split over tasks.
    """
    own = [c for c in captures.columns if c.lower() not in ("host", "matched_domain", "action", "kept")]
    host, on, hit, other, day = free_names([*own, "matched_domain", "action", "kept"], "host", "on", "hit", "other", "day")
    rows = captures.select(*own, host_of(F.col(url_col)).alias(host), F.col(fetched_col).try_cast("date").alias(on))
    asked = rows.select(F.col(host).alias("host"), F.col(on).alias("day")).where("host is not null and day is not null").distinct()
    parts = F.split("host", r"\.")
    suffixes = asked.select("host", "day", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("depth", "domain"))
    spans = materialize(intervals(entries))
    active = suffixes.join(spans, "domain").where((F.col("day") >= F.col("starts")) & (F.col("ends").isNull() | (F.col("day") < F.col("ends")))).select("host", "day", F.struct((-F.col("depth")).alias("d"), "domain", "action").alias("hit"))
    best = materialize(active.groupBy("host", "day").agg(F.max("hit").alias("hit")))
    release(spans)
    verdict = best.select(F.col("host").alias(other), F.col("day").alias(day), F.col("hit").alias(hit))
    joined = rows.join(verdict, (F.col(host) == F.col(other)) & (F.col(on) == F.col(day)), "left")
    return joined.select(*own, F.col(host).alias("host"), F.col(hit)["domain"].alias("matched_domain"), F.col(hit)["action"].alias("action"), F.coalesce(F.col(hit)["action"] != "block", F.lit(True)).alias("kept"))
