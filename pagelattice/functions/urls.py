"""Addresses as column expressions, without a parser that refuses lenient input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track where a visit came from, beside all that start with utm_.
TRACKING_PARAMETERS = [
    "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref", "ref_src",
    "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term",
]
# Schemes whose last path segment may have parameters, and schemes with an authority.
_WITH_PARAMETERS = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
_WITH_AUTHORITY = ["ftp", "http", "https", "file", "gopher", "nntp", "telnet", "imap", "wais", "mms", "shttp", "snews", "rtsp", "rsync", "svn", "sftp", "nfs", "git", "ws", "wss"]
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_REST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def is_http(url: Column) -> Column:
    """Case-sensitive prefix test."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def _decoded(part: Column) -> Column:
    """Form decoding (+ is a blank); malformed escapes stay as they are."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25")), part)


def _form_encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _component_encoded(part: Column) -> Column:
    out = F.url_encode(part)
    for escaped, plain in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def _parameters(query: Column) -> Column:
    """ARRAY<STRUCT<k, v>> of a query in order, without tracking parameters."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)))).otherwise("").alias("v")))
    return F.filter(named, lambda p: ~(F.lower(p["k"]).isin(TRACKING_PARAMETERS) | F.lower(p["k"]).startswith("utm_")))


def canonical_url(url: Column, dialect: str = "batch") -> Column:
    """Lower scheme and host, no default port, no www., one trailing slash less, no tracking parameters, sorted parameters, no fragment.

    ``batch`` keeps user information, drops ``;parameters`` of the last path segment and sorts by name and value; ``live`` drops user information, keeps
    ``;parameters``, sorts by name in the order of a locale (stable) and escapes blanks as %20. Text without a scheme gets https (batch) or stays as it is (live)."""
    batch = dialect == "batch"
    url = F.regexp_replace(F.ltrim(url), r"[\t\r\n]", "")
    part = lambda i: F.regexp_extract(url, r"(?s)" + _REST + r"(//([^/?#]*))?([^?#]*)(\?([^#]*))?", i)
    given = F.lower(F.regexp_extract(url, _SCHEME, 1))
    scheme = F.when(given == "", "https").otherwise(given)
    netloc, path, query = F.lower(part(2)), part(3), part(5)
    if not batch:
        netloc = F.regexp_replace(netloc, "^.*@", "")
    default = ((scheme == "http") & netloc.endswith(":80")) | ((scheme == "https") & netloc.endswith(":443"))
    netloc = F.when(default, F.regexp_replace(netloc, r":[0-9]+$", "")).otherwise(netloc)
    netloc = F.regexp_replace(netloc, r"^www\.", "")
    if batch:
        path = F.when(given.isin(_WITH_PARAMETERS), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    params = _parameters(query)
    if batch:
        params, encode = F.array_sort(params), _form_encoded
    else:
        at = F.transform(params, lambda p, i: F.struct(F.collate(p["k"], "UNICODE").alias("c"), i.alias("i"), p.alias("p")))
        params, encode = F.transform(F.array_sort(at), lambda x: x["p"]), _component_encoded
    query = F.array_join(F.transform(params, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    query = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    if batch:
        slashes = F.when((netloc != "") | (scheme.isin(_WITH_AUTHORITY) & path.startswith("/")), "//").otherwise("")
        return F.concat(scheme, F.lit(":"), slashes, netloc, path, query)
    return F.when(given == "", url).otherwise(F.concat(scheme, F.lit("://"), netloc, path, query))


def domain(url: Column, dialect: str = "batch") -> Column:
    """Host in lower case without www.; batch cuts the authority at its first colon (so user information may be left), live takes the host proper."""
    netloc = F.lower(F.regexp_extract(F.ltrim(url), r"(?s)" + _REST + r"//([^/?#]*)", 1))
    if dialect == "live":
        netloc = F.regexp_replace(netloc, "^.*@", "")
    return F.coalesce(F.regexp_replace(F.substring_index(netloc, ":", 1), r"^www\.", ""), F.lit(""))


def favicon_url(url: Column) -> Column:
    """The address of a page's icon at the public icon service."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.concat(F.lit("https://www.google.com/s2/favicons?domain="), host, F.lit("&sz=32"))).otherwise("")
