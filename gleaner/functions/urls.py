"""URL keys, links and source labels as Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gleaner.functions.text import blank_if_null, let, strip

# Query parameters that do not identify a posting.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ttclid", "msclkid", "ref", "source", "campaign",
    "affiliate", "aff_id", "subid", "clickid", "wbraid", "gbraid",
]

# Schemes whose last path segment may carry ";params" (RFC 1808).
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips",
    "mms", "sftp", "tel",
]

# Host fragment -> source label.
KNOWN_HOSTS = [("remoteok", "remoteok"), ("weworkremotely", "weworkremotely")]


def _one_line(url: Column) -> Column:
    for ch in "\t\r\n":
        url = F.replace(url, F.lit(ch), F.lit(""))
    return url


def _after(text: Column, prefix_length: Column) -> Column:
    return F.substring(text, prefix_length + 1, F.length(text))


def url_parts(u: Column) -> Column:
    """Struct of scheme, authority, path, query and tail (query and fragment) of a trimmed URL, as written."""

    def of_head(h: Column) -> Column:
        size = F.length(h["scheme"])
        rest = F.when(size > 0, _after(h["head"], size + 1)).otherwise(h["head"])
        return let(
            F.struct(F.lower(h["scheme"]).alias("scheme"), rest.alias("rest"), h["query"].alias("query"), h["tail"].alias("tail")),
            of_rest,
        )

    def of_rest(r: Column) -> Column:
        rest = r["rest"]
        rooted = F.startswith(rest, F.lit("//"))
        authority = F.when(rooted, F.substring_index(_after(rest, F.lit(2)), "/", 1)).otherwise("")
        return let(
            F.struct(r, authority.alias("authority"), rooted.alias("rooted")),
            lambda a: F.struct(
                r["scheme"].alias("scheme"),
                a["authority"].alias("authority"),
                F.when(a["rooted"], _after(rest, F.length(a["authority"]) + 2)).otherwise(rest).alias("path"),
                r["query"].alias("query"),
                r["tail"].alias("tail"),
            ),
        )

    def of_open(v: Column) -> Column:
        return let(
            F.struct(v["url"].alias("url"), v["open"].alias("open"), F.substring_index(v["open"], "?", 1).alias("head")),
            lambda w: let(
                F.struct(
                    w["head"].alias("head"),
                    F.regexp_extract(w["head"], r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1).alias("scheme"),
                    _after(w["open"], F.length(w["head"]) + 1).alias("query"),
                    _after(w["url"], F.length(w["head"])).alias("tail"),
                ),
                of_head,
            ),
        )

    return let(_one_line(u), lambda x: let(F.struct(x.alias("url"), F.substring_index(x, "#", 1).alias("open")), of_open))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or a leading ``www.``."""
    authority = F.lower(url_parts(strip(url))["authority"])
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""), r"^www\.", "")


# Text that is the same decoded and encoded.
_PLAIN = r"^[A-Za-z0-9_.~\-]*$"


def _decode(c: Column) -> Column:
    decoded = F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(F.rlike(c, F.lit(_PLAIN)), c).otherwise(decoded)


def _encode(c: Column) -> Column:
    # Brings the form-encoding of the JVM to RFC 3986's unreserved set.
    encoded = F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(F.rlike(c, F.lit(_PLAIN)), c).otherwise(encoded)


def _filled_params(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: F.rlike(p, F.lit(r"(?s)^[^=]*=.")))


def _param_name(p: Column) -> Column:
    return F.lower(_decode(F.substring_index(p, "=", 1)))


def tracking_params(url: Column, names: Sequence[str] = TRACKING_PARAMS) -> Column:
    """Names of the tracking parameters a URL carries, one entry per occurrence."""

    def of_query(query: Column) -> Column:
        found = F.filter(F.transform(_filled_params(query), _param_name), lambda n: n.isin(*names))
        return F.when(query == "", F.array().cast("array<string>")).otherwise(found)

    return let(url_parts(strip(url))["query"], of_query)


def _in_order(params: Column, name, pair) -> Column:
    """Parameters in stable order of their names, joined."""
    sortable = F.transform(params, lambda p, i: F.struct(name(p).alias("name"), i.alias("pos"), pair(p).alias("pair")))
    return F.array_join(F.transform(F.sort_array(sortable), lambda p: p["pair"]), "&")


# Parameters that need no decoding: NAME or NAME=VALUE in unreserved characters.
_PLAIN_QUERY = r"^(?:[A-Za-z0-9_.~\-]*+(?:=[A-Za-z0-9_.~\-]*+)?(?:&|$))*+$"


def _canonical_query(query: Column, names: Sequence[str]) -> Column:
    """Parameters that count, re-encoded, in stable order of their names; blank for none."""
    dropped = r"(?i)&(?:(?:" + "|".join(map(re.escape, names)) + r")(?:=[^&]*)?|[^=&]*=?)(?=&|$)"
    left = F.substring(F.regexp_replace(F.concat(F.lit("&"), query), dropped, ""), F.lit(2), F.length(query))

    def ordered(q: Column) -> Column:
        return F.when(F.contains(q, F.lit("&")), _in_order(F.split(q, "&"), _raw_name, lambda p: p)).otherwise(q)

    plain = let(left, ordered)

    kept = F.filter(_filled_params(query), lambda p: ~_param_name(p).isin(*names))
    coded = _in_order(kept, _param_name, _recode)
    return F.when(query == "", "").when(F.rlike(query, F.lit(_PLAIN_QUERY)), plain).otherwise(coded)


def _raw_name(p: Column) -> Column:
    return F.lower(F.substring_index(p, "=", 1))


def _recode(p: Column) -> Column:
    key = F.substring_index(p, "=", 1)
    return F.concat(_encode(_decode(key)), F.lit("="), _encode(_decode(_after(p, F.length(key) + 1))))


def _canonical_path(scheme: Column, path: Column) -> Column:
    """The path without one trailing slash; ``;params`` of the last segment stay behind it."""

    def trim(p: Column) -> Column:
        return F.when((p != "/") & F.endswith(p, F.lit("/")), F.regexp_replace(p, "/$", "")).otherwise(p)

    def with_params(last: Column) -> Column:
        params = _after(last, F.length(F.substring_index(last, ";", 1)) + 1)
        bare = trim(F.substring(path, F.lit(1), F.length(path) - F.length(params) - 1))
        return F.concat(bare, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""))

    has = scheme.isin(*PARAM_SCHEMES) & F.rlike(path, F.lit(";[^/]*$"))
    return F.when(has, let(F.substring_index(path, "/", -1), with_params)).otherwise(trim(path))


# A web address with a host, other than "www." alone, and without path parameters.
_PLAIN_URL = r"^[Hh][Tt][Tt][Pp][Ss]?://(?![Ww]{3}\.(?:[/?#]|$))[^/?#\[\]\t\r\n]+(?:/[^?#;\t\r\n]*)?(?:[?#][^\t\r\n]*)?$"


def normalize_url(url: Column, names: Sequence[str] = TRACKING_PARAMS) -> Column:
    """Deduplication key of a URL.

    Scheme and authority in lower case without ``www.``; no fragment, no tracking or
    blank parameters; the other parameters re-encoded and in stable name order; one
    trailing slash off the path. A URL with unbalanced brackets in the authority
    cannot be split and is only trimmed and lower-cased.
    """
    return let(strip(url), lambda u: key_of_trimmed(u, names))


def key_of_trimmed(
    u: Column, names: Sequence[str] = TRACKING_PARAMS, opened: Column | None = None, head: Column | None = None
) -> Column:
    """The key of a URL that has been trimmed.

    Ordinary addresses take a short way that Spark compiles; the rest are split into
    their parts first. ``opened`` (before ``#``) and ``head`` (before ``?``) may be given
    as columns so that they are computed once.
    """
    opened = F.substring_index(u, "#", 1) if opened is None else opened
    head = F.substring_index(opened, "?", 1) if head is None else head
    origin = F.replace(F.lower(F.regexp_extract(head, "^[^/]*//[^/]*", 0)), F.lit("//www."), F.lit("//"))
    path = F.regexp_replace(F.regexp_replace(head, "^[^/]*//[^/]*", ""), "(?<=.)/$", "")
    query = _canonical_query(_after(opened, F.length(head) + 1), names)
    short = F.rlike(u, F.lit(_PLAIN_URL))
    # Neither part can end in a question mark of its own.
    plain = F.rtrim(F.concat(origin, path, F.lit("?"), query), F.lit("?"))
    return F.when(short, plain).when(u == "", "").otherwise(_key_of_parts(u, names))


def _key_of_parts(u: Column, names: Sequence[str]) -> Column:
    def assemble(k: Column) -> Column:
        scheme, netloc, path, query = k["scheme"], k["netloc"], k["path"], k["query"]
        rooted = (path == "") | F.startswith(path, F.lit("/"))
        place = (
            F.when(netloc != "", F.concat(F.lit("//"), netloc, F.when(rooted, "").otherwise("/"), path))
            .when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path))
            .when(scheme.isin("http", "https", "ftp", "file") & rooted, F.concat(F.lit("//"), path))
            .otherwise(path)
        )
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            place,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        )

    def of_parts(p: Column) -> Column:
        authority = F.lower(p["authority"])
        broken = F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]"))
        pieces = F.struct(
            p["scheme"].alias("scheme"),
            F.regexp_replace(authority, r"^www\.", "").alias("netloc"),
            _canonical_path(p["scheme"], p["path"]).alias("path"),
            _canonical_query(p["query"], names).alias("query"),
        )
        return F.when(broken, F.lower(u)).otherwise(let(pieces, assemble))

    return let(url_parts(u), of_parts)


def absolute_link(base: Column, href: Column) -> Column:
    """Resolve a link found on a page against the page's URL."""

    def resolve(v: Column) -> Column:
        h, b, t = v["href"], v["base"], v["link"]
        origin = F.concat(
            F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit(":"))).otherwise(""),
            F.when(b["authority"] != "", F.concat(F.lit("//"), b["authority"])).otherwise(""),
        )
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        below = F.concat(F.when(folder == "", "/").otherwise(folder), t["path"])
        merged = F.when(F.startswith(h, F.lit("/")), t["path"]).otherwise(F.regexp_replace(below, r"/{2,}", "/"))
        dotted = F.lit(r"(^|/)\.\.?(/|$)")
        resolved = let(merged, lambda m: F.when(F.rlike(m, dotted), _dot_free(m)).otherwise(m))
        base_query = F.when(b["query"] != "", F.concat(F.lit("?"), b["query"])).otherwise("")
        return (
            F.when(h == "", base)
            .when(t["scheme"] != "", h)
            .when(F.startswith(h, F.lit("//")), F.concat(b["scheme"], F.lit(":"), h))
            .when(F.startswith(h, F.lit("?")), F.concat(origin, b["path"], t["tail"]))
            .when(F.startswith(h, F.lit("#")), F.concat(origin, b["path"], base_query, t["tail"]))
            .otherwise(F.concat(origin, resolved, t["tail"]))
        )

    cleaned = F.regexp_replace(_one_line(strip(href)), r"^//(?=/)", "")
    return let(
        cleaned,
        lambda h: let(
            F.struct(h.alias("href"), url_parts(strip(base)).alias("base"), url_parts(h).alias("link")), resolve
        ),
    )


def _dot_free(path: Column) -> Column:
    empty = F.array().cast("array<string>")

    def step(done: Column, seg: Column) -> Column:
        # The first entry is the blank before the leading slash and is never dropped.
        return (
            F.when(seg == ".", done)
            .when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
            .otherwise(F.array_append(done, seg))
        )

    def fold(segments: Column) -> Column:
        folded = F.aggregate(segments, empty, step)
        ends_open = F.element_at(segments, -1).isin(".", "..")
        return F.array_join(F.when(ends_open, F.array_append(folded, F.lit(""))).otherwise(folded), "/")

    return let(F.split(path, "/"), fold)


def detect_source(url: Column, configured: Column | None = None, known: Sequence[tuple[str, str]] = KNOWN_HOSTS) -> Column:
    """Source label by host fragment; else the configured label, else ``generic``."""

    def label(host: Column) -> Column:
        out = F.lit(None).cast("string")
        for fragment, name in reversed(list(known)):
            out = F.when(F.contains(host, F.lit(fragment)), F.lit(name)).otherwise(out)
        return out

    fallback = [] if configured is None else [F.nullif(blank_if_null(configured), F.lit(""))]
    return F.coalesce(let(F.lower(url_parts(strip(url))["authority"]), label), *fallback, F.lit("generic"))
