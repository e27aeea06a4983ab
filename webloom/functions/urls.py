"""URL functions as native column expressions: parsing, canonical forms, pagination, file names, archive paths.

A URL is cut by one pattern into scheme, host, port, path and query; everything else is string and array functions, so
all of it stays inside the JVM and next to the scan. International host names are kept in lower case, not in punycode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and prefixes of such.
TRACKING_PREFIX = "utm_"
TRACKING = ["gclid", "fbclid", "dclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "src", "feature", "si", "_ga", "session", "sessionid", "phpsessid", "sid"]
# Query parameters that name a page of an article.
PAGINATION = ["page", "p", "offset", "start", "begin", "begin_idx", "idx", "from", "_start", "_skip", "limit", "pn"]

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://(?:[^/?#\\]*@)?(\[[^\]/?#]*\]|[^/?#:\\]*)(?::([0-9]*))?)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_SPECIAL = ("http", "https", "ftp", "ws", "wss")
#: Code points that a path or query has only percent-encoded, as a pattern, and what they become.
_ENCODED = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D")]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def trimmed(url: Column | str) -> Column:
    """A URL without white space around it and line breaks or tabs in it."""
    return F.regexp_replace(F.btrim(_c(url)), "[\\t\\n\\r]", "")


def _with_parts(url: Column | str, f: Callable[[Column], Column]) -> Column:
    """``f`` of a URL's parts: scheme, host (null for none), port, path and query as they stand, and whole."""
    cut = lambda t, i: F.regexp_extract(t, _URL, i)
    host = lambda t: F.lower(cut(t, 2))
    return let(trimmed(url), lambda t: let(F.struct(F.lower(cut(t, 1)).alias("scheme"), F.when(host(t) != "", host(t)).alias("host"), cut(t, 3).alias("port"), cut(t, 4).alias("path"), cut(t, 5).alias("query"), t.alias("whole")), f))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(trimmed(url), _URL, 1))


def extract_domain(url: Column | str) -> Column:
    """The host in lower case without its port, or null."""
    host = F.lower(F.regexp_extract(trimmed(url), _URL, 2))
    return F.when(host != "", host)


def is_default_port(scheme_: Column, port: Column) -> Column:
    return ((scheme_ == "http") & (port == "80")) | ((scheme_ == "https") & (port == "443"))


def _escaped(text: Column) -> Column:
    for raw, code in _ENCODED:
        text = F.replace(text, F.lit(raw), F.lit(code))
    each = F.transform(F.split(text, ""), lambda x: F.when(x.rlike("[^\\x00-\\x7F]"), F.url_encode(x)).otherwise(x))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.array_join(each, "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Path with . and .. steps taken."""
    steps = F.split(path, "/")
    last_dot = F.element_at(steps, -1).rlike("^(\\.|\\.\\.|%2[eE])$")
    start = F.array().cast("array<string>")

    def walk(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(x.rlike("^(\\.|%2[eE])$"), done).when(x == "..", up).otherwise(F.array_append(done, x))

    joined = F.array_join(F.aggregate(steps, start, walk), "/")
    closed = F.when(last_dot & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    closed = F.when(closed.startswith("/"), closed).otherwise(F.concat(F.lit("/"), closed))
    return F.when(path.rlike("/(\\.|\\.\\.|%2[eE])(/|$)"), closed).otherwise(path)


def _path(p: Column) -> Column:
    raw = F.regexp_replace(p["path"], "\\\\", "/")
    raw = F.when((raw == "") & p["host"].isNotNull(), F.lit("/")).otherwise(raw)
    return let(let(raw, _without_dots), _escaped)


def path(url: Column | str) -> Column:
    """The path; of a URL with a host at least a slash."""
    return _with_parts(url, _path)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _pairs(p: Column) -> Column:
    def pair(x: Column) -> Column:
        value = F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))
        return F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(value).alias("v"))

    return F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), pair)


def query_pairs(url: Column | str) -> Column:
    """Decoded (k, v) pairs in the order of the URL."""
    return _with_parts(url, _pairs)


def is_tracking(key: Column) -> Column:
    return key.startswith(TRACKING_PREFIX) | key.isin(TRACKING)


def is_pagination(key: Column) -> Column:
    return key.isin(PAGINATION)


def encode_sorted_query(pairs: Column) -> Column:
    """Pairs sorted by key and value and form-encoded; a pair without value is its key alone."""
    each = F.transform(F.array_sort(pairs), lambda x: F.when(x["v"] == "", F.url_encode(x["k"])).otherwise(F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))))
    return F.array_join(each, "&")


def _with_query(start: Column, pairs: Column) -> Column:
    return let(encode_sorted_query(pairs), lambda text: F.when(text == "", start).otherwise(F.concat(start, F.lit("?"), text)))


def _authority(p: Column, user: Column | None = None) -> Column:
    port = F.regexp_replace(p["port"], "^0+(?=[0-9])", "")
    shown = F.when((port != "") & ~is_default_port(p["scheme"], port), F.concat(F.lit(":"), port)).otherwise(F.lit(""))
    return F.concat(p["scheme"], F.lit("://"), *([] if user is None else [user]), p["host"], shown)


def canonicalize_url(url: Column | str) -> Column:
    """Without fragment, user, default port and tracking parameters; the others distinct, sorted and encoded anew.
    Null where a URL cannot be parsed or has no host."""

    def build(p: Column) -> Column:
        pairs = F.array_distinct(F.filter(_pairs(p), lambda x: ~is_tracking(x["k"])))
        return F.when(p["host"].isNotNull(), _with_query(F.concat(_authority(p), _path(p)), pairs))

    return _with_parts(url, build)


def remove_pagination_params(url: Column | str) -> Column:
    """The key of an article: without pagination, fragment, user and a bare root path. Other text stays as it is."""

    def build(p: Column) -> Column:
        pairs = F.filter(_pairs(p), lambda x: ~is_pagination(x["k"]))
        bare = let(_path(p), lambda x: F.when(x == "/", F.lit("")).otherwise(x))
        return F.when(p["host"].isNotNull(), _with_query(F.concat(_authority(p), bare), pairs))

    return F.coalesce(_with_parts(url, build), _c(url))


def normalize_url_for_merge(url: Column | str) -> Column:
    """Like the article key, with root path, user and fragment kept; null where a URL cannot be parsed."""

    def build(p: Column) -> Column:
        user = F.regexp_extract(p["whole"], r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*@)", 1)
        pairs = F.filter(_pairs(p), lambda x: ~is_pagination(x["k"]))
        start = F.concat(_authority(p, user), _path(p))
        return F.when(p["host"].isNotNull(), F.concat(_with_query(start, pairs), F.regexp_extract(p["whole"], "(#.*)$", 1)))

    return _with_parts(url, build)


def _page(url: Column | str) -> Column:
    return F.get(F.filter(query_pairs(url), lambda x: is_pagination(x["k"])), 0)["v"]


def _number(value: Column) -> Column:
    number = F.when(value.rlike("^\\+?[0-9]{1,18}$"), value.cast("bigint"))
    return F.when(number < (1 << 32), number)


def page_number(url: Column | str) -> Column:
    """The first pagination parameter as a number of 32 bits without sign, else null."""
    return let(_page(url), _number)


def page_text(url: Column | str) -> Column:
    """The first pagination parameter where it is not a number, else null."""
    return let(_page(url), lambda x: F.when(_number(x).isNull(), x))


def is_http_url(url: Column | str) -> Column:
    return _c(url).startswith("http://") | _c(url).startswith("https://")


def resolve_relative_link(base: Column | str, link: Column | str) -> Column:
    """A link as it reads from a page: absolute, by scheme, by root, by query, by fragment, or beside the page."""
    b, x = trimmed(base), trimmed(link)
    root = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)", 1)
    bare, folder = F.regexp_extract(b, "^([^?#]*)", 1), F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), x)
        .when(root == "", F.lit(None))
        .when(x.startswith("//"), F.concat(F.regexp_extract(b, "^([^:]*:)", 1), x))
        .when(x.startswith("/"), F.concat(root, x))
        .when(x.startswith("?"), F.concat(bare, x))
        .when(x.startswith("#"), F.concat(F.regexp_extract(b, "^([^#]*)", 1), x))
        .when(x == "", F.regexp_extract(b, "^([^#]*)", 1))
        .otherwise(F.concat(folder, x))
    )


def url_to_filename(url: Column | str) -> Column:
    """A relative file path: unusual characters become dashes, 200 characters at most, never without a name."""
    s = F.regexp_replace(F.regexp_replace(_c(url), "^https://", ""), "^http://", "")
    s = F.regexp_replace(F.regexp_replace(s, "\\\\", "/"), "[^A-Za-z0-9._/\\-]", "-")
    s = F.regexp_replace(F.left(s, F.lit(200)), "^-+|-+$", "")
    return F.when((s == "") | s.endswith("/"), F.concat(s, F.lit("index"))).otherwise(s)


def sanitize_segment(segment: Column | str) -> Column:
    """A path segment of at most 50 letters, digits, dashes and single underscores, never empty."""
    s = F.regexp_replace(F.translate(_c(segment), " .", "__"), "[^A-Za-z0-9_\\-]", "")
    s = F.left(F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_", ""), F.lit(50))
    s = F.regexp_replace(s, "_$", "")
    return F.when(s == "", F.lit("_")).otherwise(s)


def hash_url(url: Column | str) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(_c(url), 256)


def month_bucket(epoch_seconds: Column | str) -> Column:
    """Year and month in UTC as yyyy-MM."""
    return F.date_format(F.timestamp_seconds(_c(epoch_seconds)), "y-MM")


def _segments(url: Column | str) -> Column:
    return F.transform(F.filter(F.split(path(url), "/"), lambda x: x != ""), sanitize_segment)


def balanced_path(directory: str, url: Column | str, epoch_seconds: Column | str) -> Column:
    """dir/domain/parents/h0h1/h2h3/hash_name_yyyy-MM.json: folders stay small by two levels of the hash."""
    key = remove_pagination_params(url)
    h, segs = hash_url(key), _segments(url)
    parents = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    name = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit("_"))
    file = F.concat(h, F.lit("_"), name, F.lit("_"), month_bucket(epoch_seconds), F.lit(".json"))
    return F.array_join(F.concat(F.array(F.lit(directory), F.coalesce(extract_domain(url), F.lit("unknown"))), parents, F.array(F.substring(h, 1, 2), F.substring(h, 3, 2), file)), "/")


def full_path(directory: str, url: Column | str, epoch_seconds: Column | str) -> Column:
    """dir/domain/all segments/hash_yyyy-MM.json."""
    h = hash_url(remove_pagination_params(url))
    file = F.concat(h, F.lit("_"), month_bucket(epoch_seconds), F.lit(".json"))
    return F.array_join(F.concat(F.array(F.lit(directory), F.coalesce(extract_domain(url), F.lit("unknown"))), _segments(url), F.array(file)), "/")


def default_path(directory: str, url: Column | str) -> Column:
    """dir/file name of the article key.json; the same for every time."""
    return F.concat(F.lit(f"{directory}/"), url_to_filename(remove_pagination_params(url)), F.lit(".json"))
