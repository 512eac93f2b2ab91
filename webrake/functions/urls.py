"""URL expressions (native Column builders, whole-stage codegen friendly).

URLs are split with one RFC 3986 style regular expression whose parts follow
the standard library's ``urlsplit`` rules: a scheme is a letter followed by
letters, digits, ``+ . -`` and a colon; the network location follows ``//``
and runs to the first ``/ ? #``; the query sits between the first ``?`` and
the first ``#``.  ``parse_url`` is not used: it raises on malformed URLs
under ANSI mode and drops port and user info from the host.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrake.functions.common import as_col, ColumnOrName

# The URL grammar pieces and the schemes whose last path segment
# may carry ";params" (the standard library's uses_params list).
URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEMES_WITH_PARAMS = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]
# Characters not allowed in a file/entity key.
KEY_UNSAFE_RE = r'[\\/:*?"<>|]'


def _part(url: ColumnOrName, idx: int) -> Column:
    return F.regexp_extract(as_col(url), URL_RE, idx)


def url_scheme(url: ColumnOrName) -> Column:
    return F.lower(_part(url, 1))


def url_netloc(url: ColumnOrName) -> Column:
    """Network location as written: user info and port kept, case kept."""
    return _part(url, 2)


def url_path(url: ColumnOrName, drop_params: bool = True) -> Column:
    """Path; by default without the ``;params`` of the last segment."""
    path = _part(url, 3)
    if not drop_params:
        return path
    return F.when(url_scheme(url).isin(SCHEMES_WITH_PARAMS),
                  F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def url_query(url: ColumnOrName) -> Column:
    return _part(url, 4)


def url_fragment(url: ColumnOrName) -> Column:
    return _part(url, 5)


def has_extension(name: ColumnOrName) -> Column:
    """``os.path.splitext(name)[1] != ''``: the part after the last ``/``
    has a dot preceded (after any leading dots) by another character."""
    last = F.regexp_extract(as_col(name), r"[^/]*$", 0)
    return last.rlike(r"^\.*[^.].*\.")


def url_key(url: ColumnOrName, include_query: bool = False,
            no_ext: bool = False) -> Column:
    """File/entity key of a URL: netloc + path with ``/`` -> ``_`` (+ raw
    query), ``.html`` appended when there is no extension."""
    name = F.replace(url_path(url), F.lit("/"), F.lit("_"))
    if include_query:
        name = F.concat(name, url_query(url))
    if not no_ext:
        name = F.when(has_extension(name), name).otherwise(
            F.concat(name, F.lit(".html")))
    return F.concat(url_netloc(url), name)


def url_param(url: ColumnOrName, name: str, required: bool = False) -> Column:
    """Value of query parameter ``name``; the last one wins when repeated;
    null when absent, or, with ``required``, the task fails on such a row
    (an id that must be present, as for profile links).  Works on relative
    URLs too."""
    vals = F.regexp_extract_all(url_query(url),
                                F.lit(r"(?:^|&)" + _re_escape(name) + r"=([^&]*)"), 1)
    val = F.when(F.size(vals) > 0, F.element_at(vals, -1))
    if required:
        val = F.when(val.isNull(), F.raise_error(F.concat(
            F.lit(f"missing query parameter {name} in "), F.coalesce(as_col(url), F.lit("null")))))\
            .otherwise(val)
    return val


def strip_query(url: ColumnOrName) -> Column:
    """Text before the first ``?``."""
    return F.substring_index(as_col(url), "?", 1)


def absolutize(base: ColumnOrName, link: ColumnOrName) -> Column:
    """Profile-link completion used for roster pages: links starting with
    ``http`` and empty links are kept; ``/x`` is appended to the first eight
    characters of the base plus everything up to the next ``/``; anything
    else is appended to the base as is (plain concatenation, not RFC)."""
    b, l = as_col(base), as_col(link)
    site = F.concat(F.substring(b, 1, 8),
                    F.substring_index(F.substring(b, 9, 1 << 30), "/", 1))
    return (F.when(l.isNull() | (l == "") | l.startswith("http"), l)
            .when(l.startswith("/"), F.concat(site, l))
            .otherwise(F.concat(b, l)))


def remove_dot_segments(path: ColumnOrName, drop_empty: Column | bool = True) -> Column:
    """Resolve ``.`` and ``..`` segments of a merged path (RFC 3986 section
    5.2.4, as the standard library applies it: for relative references empty
    inner segments are dropped, ``..`` above the root is ignored, a trailing
    ``.``/``..`` leaves a trailing slash, and the result is rooted).  A fold
    over the segments, no regex loop."""
    segs = F.split(as_col(path), "/")
    n = F.size(segs)
    inner = F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != "")
    drop = drop_empty if isinstance(drop_empty, Column) else F.lit(bool(drop_empty))
    parts = F.when(drop & (n >= 2),
                   F.concat(F.array(F.get(segs, 0)), inner, F.array(F.element_at(segs, -1)))) \
        .otherwise(segs)
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                                .otherwise(acc))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))))
    trail = F.element_at(parts, -1).isin(".", "..")
    out = F.array_join(F.when(trail, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")
    return (F.when(out == "", F.lit("/"))
            .when(~out.startswith("/"), F.concat(F.lit("/"), out))
            .otherwise(out))


def url_join(base: ColumnOrName, link: ColumnOrName) -> Column:
    """Standard join of a reference against a base URL: absolute links are
    kept; ``//net``, ``/path``, ``?query``, ``#frag``, empty and relative
    paths are resolved against the base, with dot segments removed.  A
    network-path link with an empty authority (``//``, ``///x``) is
    resolved as the rest of the link, as the standard join does."""
    b, l0 = as_col(base), as_col(link)
    scheme = _part(b, 1)
    origin = F.concat(scheme, F.lit("://"), url_netloc(b))
    base_path = _part(b, 3)
    base_noq = F.concat(origin, base_path)
    base_nofrag = F.substring_index(b, "#", 1)
    base_dir = F.regexp_extract(base_path, r"^(.*/)?", 0)
    empty_net = l0.startswith("//") & (F.regexp_extract(l0, r"^//([^/?#]*)", 1) == "")
    l = F.when(empty_net, F.substring(l0, 3, 1 << 30)).otherwise(l0)
    l_path, l_rest = F.regexp_extract(l, r"^[^?#]*", 0), F.regexp_extract(l, r"[?#].*$", 0)
    rooted = l.startswith("/")
    merged = remove_dot_segments(F.when(rooted, l_path)
                                 .otherwise(F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir),
                                                     l_path)), drop_empty=~rooted)
    return (F.when(l0.isNull(), F.lit(None).cast("string"))
            .when(l0 == "", b)
            .when(empty_net & (l == ""), base_nofrag)
            .when(l.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), l)
            .when(l.startswith("//"), F.concat(scheme, F.lit(":"), l))
            .when(l.startswith("?"), F.concat(base_noq, l))
            .when(l.startswith("#"), F.concat(base_nofrag, l))
            .otherwise(F.concat(origin, merged, l_rest)))


def profile_open_url(site: ColumnOrName, link: ColumnOrName,
                     by_year: bool = True) -> Column:
    """Join a profile link to the site; optionally ask for the newest-first
    list view."""
    joined = url_join(site, link)
    if by_year:
        joined = F.concat(joined, F.lit("&view_op=list_works&sortby=pubdate"))
    return joined


def entity_key(*parts: ColumnOrName) -> Column:
    """``a-b`` with every character unsafe in a file name replaced by ``_``.
    Null parts count as empty strings."""
    joined = F.concat_ws("-", *[F.coalesce(as_col(p), F.lit("")) for p in parts])
    return F.regexp_replace(joined, KEY_UNSAFE_RE, "_")


def percent_encode(s: ColumnOrName, keep_slash: bool = True) -> Column:
    """Percent-encoding of UTF-8 bytes with unreserved characters (and ``/``)
    kept, as the standard library's ``quote``.  Built on ``url_encode`` (form
    encoding) with the four differences patched."""
    enc = F.url_encode(as_col(s))
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    enc = F.replace(enc, F.lit("*"), F.lit("%2A"))
    enc = F.replace(enc, F.lit("%7E"), F.lit("~"))
    if keep_slash:
        enc = F.replace(enc, F.lit("%2F"), F.lit("/"))
    return enc


def _re_escape(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$*+?{}[]\|()" else ch)
    return "".join(out)
