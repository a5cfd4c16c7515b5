"""URL forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null stays null."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def record_url(url: Column) -> Column:
    """Canonical page address of a record: host in lower case, no port 443, no fragment, no ``utm_*`` or ``gclid``
    parameter, no slash at the end. Null stays null; text that is no URL only loses fragment and final slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    path = F.substr(bare, F.length(head) + 1)
    head = F.regexp_replace(F.lower(head), r":443$", "")
    path = F.when(
        F.contains(path, F.lit("?")),
        F.regexp_replace(F.regexp_replace(path, r"([?&])(?:(?:utm_[^&=]*|gclid)(?:=[^&]*)?(?:&|$))+", "$1"), r"[?&]+$", ""),
    ).otherwise(path)
    return F.regexp_replace(F.concat(head, path), r"/+$", "")


# Parameters that only track a visit.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_name", "utm_id",
    "gclid", "fbclid", "dclid", "msclkid", "yclid", "twclid",
    "_ga", "_gl", "mc_cid", "mc_eid", "igshid",
    "ref", "referrer", "src", "source",
]


def split_url(url: Column) -> Column:
    """struct(scheme, authority, path, query) of a URL; null parts where it is none. Scheme and host in lower case."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i)
    known = F.rlike(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://"))
    return F.when(known, F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("authority"), part(3).alias("path"), part(4).alias("query")))


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` without a default port; null where it is no http(s) URL."""
    u = split_url(url)
    host = F.when(u["scheme"] == "https", F.regexp_replace(u["authority"], ":443$", "")).otherwise(F.regexp_replace(u["authority"], ":80$", ""))
    return F.when(u["scheme"].isin("http", "https") & (u["authority"] != ""), F.concat(u["scheme"], F.lit("://"), host))


def canonical(url: Column, block: list[str] = TRACKING, allow: list[str] = ()) -> Column:
    """One form of a page's URL: lower-case host, no default port, fragment or tracking parameter, parameters sorted by
    name (order of equal names kept), no slash at the end of a path. Null where it is no http(s) URL."""
    u = split_url(url)
    name = lambda p: F.substring_index(p, "=", 1)
    params = F.filter(F.split(u["query"], "&"), lambda p: p != "")
    drop = F.array(*[F.lit(x) for x in block if x not in set(allow)])
    params = F.filter(params, lambda p: ~F.array_contains(drop, name(p)))
    keyed = F.array_sort(F.transform(params, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.concat_ws("&", F.transform(keyed, lambda x: x["p"]))
    path = F.when(F.length(u["path"]) > 1, F.regexp_replace(u["path"], "/+$", "")).otherwise(u["path"])
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.concat(origin(url), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def discovery_key(url: Column) -> Column:
    """The looser key of discovery: host in lower case, no default port or fragment, one slash less at the end."""
    u = split_url(url)
    query = F.when(u["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), u["query"]))
    return F.concat(origin(url), F.regexp_replace(u["path"], "(.)/$", "$1"), query)


def sitemap_key(url: Column) -> Column:
    """The key of sitemap entries: host in lower case, no default port or fragment."""
    u = split_url(url)
    query = F.when(u["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), u["query"]))
    return F.concat(origin(url), u["path"], query)


def path_and_query(url: Column) -> Column:
    u = split_url(url)
    return F.concat(F.when(u["path"] == "", F.lit("/")).otherwise(u["path"]), F.when(u["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), u["query"])))


def in_scope(url: Column, entry: Column, scope: Column) -> Column:
    """single: the same page; section: the same origin at or under the entry's path; site: the same origin."""
    return keys_in_scope(canonical(url), canonical(entry), scope)


def keys_in_scope(one: Column, start: Column, scope: Column) -> Column:
    """The same of canonical URLs."""
    site = lambda c: F.regexp_extract(c, "^(https?://[^/]+)", 1)
    path = lambda c: F.regexp_extract(c, r"^https?://[^/]+([^?]*)", 1)
    under = (path(one) == path(start)) | F.startswith(path(one), F.concat(F.regexp_replace(path(start), "/$", ""), F.lit("/")))
    same = site(one) == site(start)
    return F.coalesce(F.when(scope == "single", one == start).when(scope == "section", same & under).when(scope == "site", same), F.lit(False))


def doc_likeness(url: Column, text: Column, region: Column) -> Column:
    """How much a link looks like one to documentation, 0 to 1: words in its path and its text, and where it stands."""
    # The words and the weights of the regions.
    words = ["doc", "docs", "documentation", "api", "reference", "guide", "guides", "tutorial", "tutorials", "manual", "handbook", "sdk", "developer", "developers", "learn"]
    weight = F.when(region == "nav", 0.2).when(region == "header", 0.1).when(region == "footer", 0.05).otherwise(0.0)
    u, t = F.lower(url), F.lower(F.trim(text))
    keys = F.array(*[F.lit(w) for w in words])
    hit = lambda test: F.size(F.filter(keys, test))
    in_path = hit(lambda k: F.contains(u, F.concat(F.lit("/"), k, F.lit("/"))) | F.contains(u, F.concat(k, F.lit("."))) | F.endswith(u, F.concat(F.lit("/"), k)))
    in_text = hit(lambda k: F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), k, F.lit(" "))))
    return F.least(F.lit(1.0), F.least(in_path * 0.4, F.lit(0.6)) + F.least(in_text * 0.3, F.lit(0.4)) + weight)
