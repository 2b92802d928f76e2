"""URL functions for http and https addresses, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import TRACKING


def canonical(c: Column) -> Column:
    """Host in lower case, no fragment or user, no tracking parameters, the others in order of name, no slash at the end of a path. Null if it isn't an http(s) URL."""
    s = F.regexp_replace(F.trim(c), "#.*$", "")
    scheme, host = F.lower(F.regexp_extract(s, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(s, r"^[A-Za-z]+://(?:[^/?@]*@)?([^/?]+)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_replace(F.regexp_extract(s, r"^[A-Za-z]+://[^/?]+([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(s, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(TRACKING))
    ordered = F.transform(F.array_sort(F.transform(query, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    path = F.when(path == "", F.lit("/")).otherwise(path)
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), whole)


def path_segments(c: Column) -> Column:
    """The first two segments of the path, in lower case."""
    return F.slice(F.filter(F.split(F.lower(F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)), "/"), lambda x: x != ""), 1, 2)


def is_safe(c: Column) -> Column:
    """An absolute http or https address."""
    return F.coalesce(c.rlike("(?i)^https?://[^/?#]"), F.lit(False))


def dedupe_hash(c: Column) -> Column:
    """The digest of an address's canonical form, by which items are told apart; null where it has none."""
    return F.sha2(canonical(c), 256)


def content_hash(title: Column, excerpt: Column) -> Column:
    """The digest of what a source says: title and excerpt, trimmed."""
    return F.sha2(F.concat(F.trim(title), F.lit("\n"), F.trim(F.coalesce(excerpt, F.lit("")))), 256)


def absolute(path: Column, site: str) -> Column:
    """An inner path as an address; addresses pass."""
    return F.when(path.rlike("(?i)^https?://"), path).when(path.startswith("/"), F.concat(F.lit(site), path)).otherwise(F.concat(F.lit(f"{site}/"), path))


def archive_route(category: Column, page: Column) -> Column:
    """/noticias with the parameters that aren't the defaults."""
    parts = F.array_compact(F.array(F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit("categoria="), F.url_encode(category))), F.when(page > 1, F.concat(F.lit("pagina="), page.cast("string")))))
    return F.when(F.size(parts) > 0, F.concat(F.lit("/noticias?"), F.array_join(parts, "&"))).otherwise(F.lit("/noticias"))


def agent_token(agent: Column) -> Column:
    """What a user agent is called in robots rules: up to the first blank or slash, in lower case."""
    return F.lower(F.regexp_extract(F.trim(agent), r"^([^\s/]*)", 1))


def calendar_address(base: str, year: Column) -> Column:
    """The page of a year's calendar; the current one's without a year."""
    return F.when(year.isNull(), F.lit(f"{base}/calendario")).otherwise(F.concat(F.lit(f"{base}/calendario-"), year.cast("string")))
