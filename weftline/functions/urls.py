"""URL functions as Catalyst expressions: parts, canonical form, resolution, site and extension tests.

One pattern splits a URL once into a struct of its pieces (``split``), and every function
that has the pieces works on them; canonical URLs are split in the same way.  Higher-order
functions (``let``, the query's pairs) are interpreted and end a span of generated code, so
the rest is kept out of them where it can be, and rare work (user names, foreign hosts,
doubled slashes, control characters) stands behind a cheap test.
Null and unusable input gives the empty string, as every caller filters on that.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
#: scheme, host, port, path, query, fragment of a URL; of an authority the user's name is left out.
_PIECES = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://(?:[^/?#]*@)?([^/?#]*?)(?::([^:\]/?#]*))?(?=[/?#]|$))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_MARK = "\x01"
#: Query keys that name a campaign or a click, never the content.
JUNK = tuple(
    [f"utm_{x}" for x in "campaign content creative_format id medium source source_platform term".split()]
    + "_ga _gl dclid fbclid gclid gclsrc igshid mc_cid mc_eid msclkid ref_src ref_url s_kwcid sc_campaign sc_channel twclid vero_id wickedid yclid".split()
)
_KINDS = {
    "image": "jpg jpeg png gif bmp ico svg tiff webp avif heic psd ai eps",
    "sound": "mp3 wav wma aac flac m4a ogg oga opus",
    "film": "mp4 m4v mov avi mkv webm wmv flv mpg mpeg ogv swf",
    "office": "pdf doc docx xls xlsx ppt pptx odt ods odp rtf csv tsv",
    "packed": "zip gz tgz bz2 xz 7z rar tar iso dmg pkg deb rpm msi exe apk bin dat wasm",
    "web": "css js mjs map json xml rss atom woff woff2 ttf otf eot",
}
BINARY = tuple(f".{x}" for names in _KINDS.values() for x in names.split())
_SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, k)


def split(url) -> Column:
    """A struct of scheme, host (lower case, with brackets), port, path, query and fragment, all empty where the URL has no scheme.

    The pieces come from one match: they are joined by a sign that no URL holds, and split at it.
    """
    whole = F.regexp_replace(F.coalesce(_c(url), F.lit("")), _PIECES, _MARK.join(f"${k}" for k in range(1, 7)))

    def named(p: Column) -> Column:
        part = lambda k: F.when(F.size(p) == 6, F.get(p, F.lit(k))).otherwise("")
        return F.struct(F.lower(part(0)).alias("scheme"), F.lower(part(1)).alias("host"), part(2).alias("port"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))

    return let(F.split(whole, _MARK), named)


#: The host of a URL, without user, port and the brackets of an address.
_HOST = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?\[?([^/?#]*?)\]?(?::[^:\]/?#]*)?(?=[/?#]|$)"


def host_of(url) -> Column:
    """Lower-case host without user, port and brackets."""
    return F.lower(F.regexp_extract(F.coalesce(_c(url), F.lit("")), _HOST, 1))


def registrable_domain(host) -> Column:
    """The last two labels, three under a second-level registry; addresses and short names stay."""
    h = _c(host)
    p = F.split(h, r"\.")
    n = F.size(p)
    tail = lambda k: F.array_join(F.slice(p, -k, k), ".")
    deep = F.element_at(p, -2).isin(*_SECOND_LEVEL) & (F.length(F.element_at(p, -1)) <= 3)
    return F.when((h == "") | h.rlike(r"^[0-9.]+$") | (n <= 2), h).when(deep, tail(3)).otherwise(tail(2))


def same_site(a, b) -> Column:
    return registrable_domain(host_of(a)) == registrable_domain(host_of(b))


def is_crawlable_scheme(url) -> Column:
    return F.coalesce(_c(url), F.lit("")).rlike(r"^(?i:https?)://")


def origin_of(url) -> Column:
    """scheme://authority in lower case."""
    return F.lower(F.concat(_part(_c(url), 1), F.lit("://"), _part(_c(url), 3)))


def path_of(url) -> Column:
    return _part(_c(url), 4)


def has_binary_extension(url) -> Column:
    return F.lower(F.regexp_extract(path_of(url), r"(\.[^./]*)$", 1)).isin(*BINARY)


def normalize(url, strip_query: bool = False, keep_fragment: bool = False) -> Column:
    """The canonical form under which a URL is known, empty where it can't be crawled.

    A bad port gives the empty string, and brackets of an IPv6 host are kept.
    """
    raw = F.coalesce(_c(url), F.lit(""))
    dirty = raw.rlike(r"^\s|\s$|[\t\r\n\x01]")
    clean = F.when(dirty, F.translate(F.regexp_replace(raw, r"^\s+|\s+$", ""), "\t\r\n\x01", "")).otherwise(raw)
    return let(split(clean), lambda p: _combined(p, strip_query, keep_fragment))


def _combined(p: Column, strip_query: bool, keep_fragment: bool) -> Column:
    scheme, raw = p["scheme"], p["host"]
    host = F.when(raw.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), raw), raw)).otherwise(raw)
    port = F.when(p["port"].startswith("0"), F.regexp_replace(p["port"], r"^0+(?=[0-9])", "")).otherwise(p["port"])
    good = (port == "") | (port.rlike(r"^[0-9]{1,5}$") & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535))
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(p["path"] == "", F.lit("/")).when(p["path"].contains("//"), F.regexp_replace(p["path"], "/{2,}", "/")).otherwise(p["path"])
    out = F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path)
    if not strip_query:
        pairs = F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*JUNK))
        kept = let(F.array_join(F.array_sort(pairs), "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
        out = F.concat(out, F.when(p["query"] == "", F.lit("")).otherwise(kept))
    if keep_fragment:
        out = F.concat(out, F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit("")))
    named = (raw != "") & (raw != "[]")
    return F.when(scheme.isin("http", "https") & named & good, out).otherwise(F.lit(""))


_MATCH = re.compile(_PIECES)
_PORTS = {"http": "80", "https": "443"}


def canonical(url: str | None, strip_query: bool = False) -> str:
    """``normalize`` of one string, for the kernels that read pages."""
    m = _MATCH.match((url or "").strip(" \t\n\x0b\f\r").translate(_DROPPED))
    if not m:
        return ""
    scheme, host, port, path, query, _ = (x or "" for x in m.groups())
    scheme, host = scheme.lower(), host.lower()
    if scheme not in _PORTS or host in ("", "[]"):
        return ""
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            pass
    if port:
        if not (port.isascii() and port.isdigit()):
            return ""
        port = port.lstrip("0") or "0"
        if len(port) > 5 or int(port) > 65535:
            return ""
    out = f"{scheme}://{host}" + ("" if port in ("", _PORTS[scheme]) else f":{port}") + (_SLASHES.sub("/", path) or "/")
    if query and not strip_query:
        pairs = sorted(x for x in query.split("&") if x and x.partition("=")[0].lower() not in _JUNK)
        out += "?" + "&".join(pairs) if pairs else ""
    return out


_DROPPED = dict.fromkeys(map(ord, "\t\r\n\x01"))
_SLASHES = re.compile("/{2,}")
_JUNK = frozenset(JUNK)


def resolved(base: str, link: str) -> str:
    """``join`` of strings; what can't be resolved is empty."""
    try:
        return urljoin(base, link)
    except ValueError:
        return ""


def _undotted(path: Column) -> Column:
    """RFC 3986 removal of dot segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(a)).otherwise(F.concat(a, F.array(x))))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.concat(kept, tail), "/")).otherwise(path)


def join(base, link) -> Column:
    """Resolve a reference against a base URL."""
    r = F.coalesce(_c(link), F.lit(""))
    whole = r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(whole, r).otherwise(let(F.struct(r.alias("r"), _base_parts(F.coalesce(_c(base), F.lit(""))).alias("b")), lambda x: _resolved(x["r"], x["b"])))


def _base_parts(base: Column) -> Column:
    path = _part(base, 4)
    return F.struct(_part(base, 1).alias("scheme"), F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0).alias("root"), F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "").alias("folder"), path.alias("path"), _part(base, 5).alias("query"))


def _resolved(r: Column, b: Column) -> Column:
    tail = F.regexp_extract(r, r"(?s)^[^?#]*(\?[^#]*)?(#.*)?$", 0)
    own = F.regexp_extract(r, r"^[^?#]*", 0)
    rest = F.substring(tail, F.length(own) + 1, F.length(tail))
    path = F.when(r.startswith("/"), own).otherwise(F.concat(b["folder"], own))
    flat = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(path, _undotted)).otherwise(path)
    bare = F.concat(b["root"], b["path"], F.when(rest.startswith("?"), rest).otherwise(F.concat(b["query"], rest)))
    return F.when(r.startswith("//"), F.concat(b["scheme"], F.lit(":"), r)).when(own == "", bare).otherwise(F.concat(b["root"], flat, rest))
