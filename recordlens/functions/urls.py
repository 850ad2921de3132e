"""Column functions on URLs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://[^\s<>\"')\]]+"
TRACKING = r"(?i)^(?:utm_.*|fbclid|gclid)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?([^:]*)", 1))


def bare_host(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_parts(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def template(url: Column) -> Column:
    """Host and path with {year}, {id} and {date} for what varies, and the sorted query keys."""

    def segment(s: Column) -> Column:
        varied = F.regexp_replace(F.regexp_replace(s, "20[0-9]{2}[-_](?:1[0-2]|0[0-9])[-_](?:3[01]|[12][0-9]|0[0-9])", "{date}"), "[0-9]+", "{id}")
        return (
            F.when(s.rlike("^20[0-9]{2}$"), "{year}")
            .when(s.rlike("^(?:[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,}|[0-9a-fA-F]{16,})$"), "{id}")
            .otherwise(varied)
        )

    keys = F.array_sort(F.transform(query_parts(url), lambda p: F.concat(F.substring_index(p, "=", 1), F.lit("={*}"))))
    tail = F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(keys, "&"))).otherwise("")
    return F.concat(host(url), F.array_join(F.transform(F.split(path(url), "/"), segment), "/"), tail)


def resolve(target: Column, base: Column) -> Column:
    """An absolute URL from a link on a page."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_extract(F.when(path(base) == "", "/").otherwise(path(base)), "^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme(base), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("#") | target.startswith("?"), F.concat(origin, path(base), target))
        .otherwise(F.concat(origin, folder, target))
    )


def canonical(url: Column, exclude: str = r"(?i)/(?:login|logout|signin|search)(?:/|$)", most_parts: int = 10) -> Column:
    """Scheme and host lower-cased, default port, fragment and tracking keys dropped, query sorted.

    Null for other schemes, user info, excluded paths and queries of more than ``most_parts`` parts or 1000 characters.
    """
    auth = authority(url)
    port = F.regexp_extract(auth, ":([0-9]+)$", 1)
    default = ((scheme(url) == "https") & (port == "443")) | ((scheme(url) == "http") & (port == "80"))
    netloc = F.concat(host(url), F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)))
    kept = F.array_sort(F.filter(query_parts(url), lambda p: ~F.substring_index(p, "=", 1).rlike(TRACKING)))
    p = F.when(path(url) == "", "/").otherwise(path(url))
    good = scheme(url).isin("http", "https") & ~auth.contains("@") & ~p.rlike(exclude) & (F.size(kept) <= most_parts) & (F.length(query(url)) <= 1000)
    return F.when(good, F.concat(scheme(url), F.lit("://"), netloc, p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def find_urls(text: Column) -> Column:
    """Distinct URLs in order, without trailing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), 0), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def scope_reason(url: Column, seed_host: str, allow: list[str], platforms: dict[str, str]) -> Column:
    """Why a URL may be visited: the seed's domain, the allow list or a known platform's host; null if it may not."""
    h = host(url)
    out = F.when((h == seed_host) | h.endswith("." + seed_host), "seed-domain").when(h.isin(*allow) if allow else F.lit(False), "allowlist")
    for name, pattern in platforms.items():
        out = out.when(h.rlike(pattern), f"platform:{name}")
    return out


def source_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether a stream source is admitted: http(s), no user info, no link-local or multicast address, an exact or *.suffix host."""
    h = host(url)
    listed = F.lit(False)
    for pattern in hosts:
        listed = listed | (h.endswith(pattern[1:]) if pattern.startswith("*.") else h == pattern)
    local = h.rlike(r"^169\.254\.|^(?:22[4-9]|23[0-9])\.") | h.rlike(r"^\[?(?:fe80|ff)[0-9a-f]*:")
    return scheme(url).isin("http", "https") & ~authority(url).contains("@") & ~local & listed
