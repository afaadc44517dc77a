"""URL functions: F1, F2, P1, P2, P17, F11 -- all native Column expressions.

The canonical forms reproduce ``urlparse`` + ``parse_qs`` + ``urlencode``:
the query string is split on ``&``, a pair needs ``=`` and a non-empty
value, keys and values are percent/plus decoded, dropped keys removed,
repeated keys regrouped at the position of their first occurrence, and
everything re-encoded the ``quote_plus`` way.  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postline import rules

_URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_NETLOC_SCHEMES = ["http", "https", "ftp", "file", "ws", "wss", "sftp", "git", "svn", "ssh", ""]


def _decode(c: Column) -> Column:
    # '%' not followed by two hex digits is kept literally, as Python's unquote does
    fixed = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(fixed), c)


def quote_plus(c: Column) -> Column:
    """Python ``quote_plus``: Java's URLEncoder differs only on '~' and '*'."""
    enc = F.url_encode(c)
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def quote(c: Column) -> Column:
    """Python ``quote`` with safe='/': space as %20, '/' kept."""
    enc = quote_plus(c)
    return F.replace(F.replace(enc, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def let(values: dict[str, Column], body) -> Column:
    """``body(v)`` with every ``v[name]`` evaluated once per row.

    A one-element fold: its initial struct is computed once and the
    finishing lambda reads the bound values as fields.  Subexpression
    elimination covers neither lambdas nor conditional branches, so a value
    used several times inside them would otherwise be recomputed."""
    init = F.struct(*[c.alias(k) for k, c in values.items()])
    return F.aggregate(F.array(F.lit(0)), init, lambda acc, _x: acc, body)


# a lower-case scheme, a host and a plain path, nothing else: canonical as it is
_PLAIN_URL = r"^[a-z][a-z0-9+.\-]*://[^/?#;\s]+(?:/[^?#;\s]*)?$"

_PAIR = "struct<g:int,pos:int,k:string,v:string>"


def _canonical(url: Column, drop_key) -> Column:
    parts = {
        "scheme": F.lower(F.regexp_extract(url, _URL_RE, 1)),
        "net": F.regexp_replace(F.regexp_extract(url, _URL_RE, 2), "^//", ""),
        # ;params of the last path segment are discarded
        "path": F.regexp_replace(F.regexp_extract(url, _URL_RE, 3), ";[^/]*$", ""),
        "query": F.regexp_extract(url, _URL_RE, 4),
    }

    def build(u):
        # a pair needs '=' and a non-empty value (parse_qs without keep_blank_values)
        kept = F.filter(F.split(u["query"], "&"), lambda x: (F.instr(x, "=") > 0) & (F.length(x) > F.instr(x, "=")))
        pairs = F.transform(kept, lambda x, i: F.struct(
            _decode(F.substring_index(x, "=", 1)).alias("k"),
            _decode(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
            i.alias("pos")))
        pairs = F.filter(pairs, lambda p: ~drop_key(p["k"]))

        # repeated keys are grouped at their first key's position: one fold
        # that carries the keys seen so far, then a sort by (group, position)
        def step(acc, p):
            seen = F.array_contains(acc["keys"], p["k"])
            g = F.when(seen, F.array_position(acc["keys"], p["k"])).otherwise(F.size(acc["keys"]) + 1).cast("int")
            return F.struct(F.when(seen, acc["keys"]).otherwise(F.array_append(acc["keys"], p["k"])).alias("keys"),
                            F.array_append(acc["out"], F.struct(g.alias("g"), p["pos"].alias("pos"), p["k"].alias("k"),
                                                                p["v"].alias("v"))).alias("out"))
        init = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast(f"array<{_PAIR}>").alias("out"))
        grouped = F.array_sort(F.aggregate(pairs, init, step)["out"])
        query = F.array_join(F.transform(grouped, lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))), "&")
        # '?' + query, or nothing when the query is empty (one reference to it)
        query_part = F.regexp_replace(F.concat(F.lit("?"), query), r"^\?$", "")
        scheme, net, path = u["scheme"], u["net"], u["path"]
        body = (F.when(net != "", F.concat(F.lit("//"), net,
                                           F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))
                .when(scheme.isin(_NETLOC_SCHEMES) & (scheme != "") & path.startswith("/"), F.concat(F.lit("//"), path))
                .otherwise(path))
        return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), body, query_part)

    return F.when(url.isNull() | (url == "") | url.rlike(_PLAIN_URL), url).otherwise(let(parts, build))


def normalize_url(url: Column, drop=None) -> Column:
    """F1 (store variant): drop exact, case-sensitive parameter names."""
    names = rules.STORE_TRACKING_PARAMS if drop is None else drop
    arr = F.array(*[F.lit(n) for n in names])
    return _canonical(url, lambda k: F.array_contains(arr, k))


def normalize_url_strict(url: Column, drop=None) -> Column:
    """F2 (crawl variant): drop any key that starts with a listed name, any case."""
    names = rules.CRAWL_TRACKING_PARAMS if drop is None else drop
    lowered = F.array(*[F.lit(n.lower()) for n in names])
    return _canonical(url, lambda k: F.exists(lowered, lambda p: F.startswith(F.lower(k), p)))


def build_search_url(prefix: Column, query: Column, suffix: Column) -> Column:
    """Template + percent-encoded query (space -> %20, '/' kept)."""
    return F.concat(prefix, quote(query), suffix)


def absolutise_link(link: Column, base: Column) -> Column:
    """Prefix the base URL to non-empty links that do not start with http."""
    return F.when(link.isNotNull() & (link != "") & ~link.startswith("http"), F.concat(base, link)).otherwise(link)


def blocked_request(resource_type: Column, url: Column) -> Column:
    """Resource type in the blocked set or URL holds a tracker substring."""
    low = F.lower(url)
    trackers = F.array(*[F.lit(p) for p in rules.TRACKER_PATTERNS])
    return resource_type.isin(rules.BLOCKED_RESOURCE_TYPES) | F.exists(trackers, lambda p: F.contains(low, p))


def task_key(site: Column, query: Column) -> Column:
    """md5 hex of 'site:query'."""
    return F.md5(F.concat_ws(":", site, query))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _URL_RE, 2), "^//", "")


def url_origin(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, _URL_RE, 1)), F.lit("://"), url_host(url))
