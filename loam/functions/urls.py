"""References resolved against a base URL (RFC 3986, section 5) as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"
# What a path may hold as it is, beside letters, digits and . * _ -, and its code where it is encoded.
KEPT = {"/": "2F", ":": "3A", "@": "40", "!": "21", "$": "24", "&": "26", "'": "27", "(": "28", ")": "29", "+": "2B", ",": "2C", ";": "3B", "=": "3D", "~": "7E", "[": "5B", "]": "5D", "%": "25"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though the body names it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> Column:
    """scheme, authority (with its //), path and query (with its ?) of a URL or reference; empty where it has none."""
    own = F.regexp_replace(url, "(?s)#.*$", "")
    piece = lambda i: F.regexp_extract(own, PARTS, i)
    return F.struct(F.lower(piece(1)).alias("scheme"), piece(2).alias("authority"), piece(3).alias("path"), piece(4).alias("query"))


def without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments; one that ends in such a segment ends in /."""

    def step(acc, x):
        end = F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(x["name"] == ".", F.concat(acc, end)).when(x["name"] == "..", F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), end)).otherwise(F.concat(acc, F.array(x["name"])))

    def fold(names):
        marked = F.transform(names, lambda name, i: F.struct(name.alias("name"), (i == F.size(names) - 1).alias("last")))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))

    plain = ~path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(plain, path).otherwise(let(F.split(F.regexp_replace(path, "^/", ""), "/"), fold))


def encoded(path: Column) -> Column:
    """path with what a path can't hold in percent code."""
    whole = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    back = reduce(lambda t, k: F.replace(t, F.lit("%" + k[1]), F.lit(k[0])), KEPT.items(), whole)
    return F.when(path.rlike(r"[^A-Za-z0-9.*_/:@!$&'()+,;=~\[\]%-]"), back).otherwise(path)


def resolved(reference: Column, base: Column) -> Column:
    """The URL, without fragment, that a reference means on a page at base; null where it is none (control characters, broken percent codes, an empty scheme)."""

    def whole(p):
        r, b = p["r"], p["b"]
        folder = F.when((b["authority"] != "") & (b["path"] == ""), F.lit("/")).otherwise(F.regexp_replace(b["path"], "[^/]*$", ""))
        rooted = lambda path: F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path))
        opaque = (r["scheme"] != "") & (r["authority"] == "") & ~r["path"].startswith("/")
        path = (
            F.when(opaque, r["path"]).when((r["scheme"] != "") | (r["authority"] != ""), without_dots(r["path"])).when(r["path"] == "", b["path"])
            .when(r["path"].startswith("/"), without_dots(r["path"])).otherwise(without_dots(rooted(F.concat(folder, r["path"]))))
        )
        query = F.when((r["scheme"] == "") & (r["authority"] == "") & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        scheme = F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"])
        authority = F.when((r["scheme"] != "") | (r["authority"] != ""), r["authority"]).otherwise(b["authority"])
        return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), authority, F.when(opaque, path).otherwise(encoded(path)), F.when(query == "?", F.lit("")).otherwise(query))

    broken = reference.rlike(r"[\x00-\x1f\x7f]") | F.regexp_extract(reference, r"^([^?#]*)", 1).rlike("%(?![0-9A-Fa-f]{2})") | reference.startswith(":")
    return F.when(~broken, let(F.struct(parts(reference).alias("r"), parts(base).alias("b")), whole))
