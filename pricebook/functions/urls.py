"""URL functions (URL-1..7)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import ascii_lower, slugify, text

# Placeholders an affiliate template may use.
TEMPLATE_VARS = ["product_url", "url_encoded_product_url", "path", "handle"]


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding: a space is %20 and the tilde stays."""
    s = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(s, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"


def url_host(c: Column) -> Column:
    """The host, empty when there is none; unlike a strict parser it accepts unescaped text further on."""
    return F.regexp_extract(c, _SCHEME + r"(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 2)


def url_path(c: Column) -> Column:
    """The path, empty when the URL has none."""
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def handle_of(url: Column) -> Column:
    """URL-3: the slug after /products/ or /product/, else the last path segment."""
    path = url_path(url)
    named = F.regexp_extract(path, r"/products/([^/?#]+)", 1)
    single = F.regexp_extract(path, r"/product/([^/?#]+)", 1)
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(single, F.lit("")), last, F.lit(""))


def affiliate_url(template: Column, url: Column, handle: Column | None = None) -> Column:
    """URL-1: fill an affiliate template; null when the template or the URL is unusable.

    Placeholders are filled in one pass, so text that came from a URL is never
    filled again.  A "?" right after the product URL becomes "&" when the URL
    already has a query.
    """
    t, u = text(template), text(url)
    own = F.lit("") if handle is None else text(handle)
    values = {
        "{product_url}": u,
        "{url_encoded_product_url}": percent_encode(u),
        "{path}": url_path(u),
        "{handle}": F.when(own != "", own).otherwise(handle_of(u)),
    }
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(t, r"(\{[a-z_]+\})", f"{mark}$1{mark}"), mark, -1)

    def fill(piece: Column, i: Column) -> Column:
        after_url = F.get(pieces, i - 1) == "{product_url}"
        glued = F.when(
            (i % 2 == 0) & (i > 0) & after_url & u.contains("?") & piece.startswith("?"),
            F.concat(F.lit("&"), F.expr("''"), F.regexp_replace(piece, r"^\?", "")),
        ).otherwise(piece)
        return F.coalesce(*[F.when(piece == k, v) for k, v in values.items()], glued)

    filled = F.array_join(F.transform(pieces, fill), "")
    usable = (F.trim(t) != "") & (F.trim(u) != "") & (text(url_host(u)) != "")
    return F.when(usable, filled)


def check_template(c: Column) -> Column:
    """URL-2: null when the template is sound, else what is wrong with it."""
    t = text(c)
    lead = F.regexp_extract(t, r"^([^{]*)", 1)
    used = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"), F.lit(1)))
    unknown = F.array_except(used, F.array(*[F.lit(v) for v in TEMPLATE_VARS]))
    return (
        F.when(F.trim(t) == "", "empty")
        .when((F.trim(lead) != "") & ~lead.rlike(r"(?i)^\s*https?://"), "bad scheme")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", ")))
    )


def destination(source_url: Column, variant_url: Column, template: Column, status: Column) -> Column:
    """URL-4: where a click goes: the filled template, else the product's own URL.

    Null (gone) for rejected offers and for anything but http(s).
    """
    named = F.when(text(variant_url) != "", variant_url).otherwise(source_url)
    handle = F.regexp_extract(url_path(named), r"/products?/([^/?#]+)", 1)
    target = F.coalesce(F.nullif(affiliate_url(template, source_url, handle), F.lit("")), source_url)
    return F.when(~(status == "rejected") & target.rlike(r"(?i)^https?://"), target)


def variation_url(permalink: Column, pairs: Column, parents: Column) -> Column:
    """URL-5: the permalink plus ``attribute_<key>=<value>`` per chosen attribute.

    ``pairs`` is array<struct<name, value>>, ``parents`` array<struct<name, taxonomy>>.
    The key is the parent's taxonomy, else the slug of the name.  The query that is
    there already keeps its order and its blank values.
    """

    def query_part(p: Column) -> Column:
        known = F.filter(parents, lambda a: ascii_lower(a["name"]) == ascii_lower(p["name"]))
        taxonomy = F.try_element_at(F.transform(known, lambda a: text(a["taxonomy"])), F.lit(-1))
        key = F.coalesce(F.nullif(taxonomy, F.lit("")), slugify(p["name"]))
        return F.when(key != "", F.concat(percent_encode(F.concat(F.lit("attribute_"), key)), F.lit("="), percent_encode(p["value"])))

    chosen = F.filter(F.transform(F.filter(pairs, lambda p: text(p["value"]) != ""), query_part), lambda q: q.isNotNull())
    existing = F.regexp_extract(permalink, r"^[^?#]*\?([^#]*)", 1)

    def recode(part: Column) -> Column:
        key = F.regexp_extract(part, r"^([^=]*)", 1)
        value = F.regexp_extract(part, r"^[^=]*=(.*)$", 1)
        return F.concat(percent_encode(F.url_decode(key)), F.lit("="), percent_encode(F.url_decode(value)))

    kept = F.transform(F.filter(F.split(existing, "&"), lambda s: s != ""), recode)
    base = F.regexp_extract(permalink, r"^([^?#]*)", 1)
    fragment = F.regexp_extract(permalink, r"(#.*)$", 1)
    full = F.concat(base, F.lit("?"), F.array_join(F.concat(kept, chosen), "&"), fragment)
    return F.when((text(permalink) != "") & (F.size(chosen) > 0), full).otherwise(permalink)


def rewrite_url(c: Column, rule: dict) -> Column:
    """URL-6, EXT-2: move a URL from one host to another, optionally swapping a path prefix.

    Rule keys: from_host, to_host, from_path_prefix, to_path_prefix, strip_trailing_slash.
    """
    wanted = rule.get("from_host") or ""
    if not wanted:
        return c
    scheme = F.regexp_extract(c, _SCHEME, 1)
    host = F.lit(rule["to_host"]) if rule.get("to_host") else url_host(c)
    path = url_path(c)
    prefix = rule.get("from_path_prefix") or ""
    if prefix:
        swapped = F.concat(F.lit(rule.get("to_path_prefix") or ""), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))
        path = F.when(path.startswith(prefix), swapped).otherwise(path)
    if rule.get("strip_trailing_slash"):
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", ""))
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    moved = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(ascii_lower(url_host(c)) == wanted, moved).otherwise(c)


def fill_url_template(template: str, lookup) -> Column:
    """URL-7: fill ``{path}`` placeholders with percent-encoded values; null when one is missing.

    ``lookup(path)`` gives the Column of a path.
    """
    names = re.findall(r"\{([^}]+)\}", template)
    pieces = re.split(r"\{[^}]+\}", template)
    columns = [F.when(text(lookup(n)) != "", lookup(n)) for n in names]
    parts = [F.lit(pieces[0])]
    for column, tail in zip(columns, pieces[1:]):
        parts += [percent_encode(column), F.lit(tail)]
    return F.concat(*parts)


def site_key(c: Column) -> Column:
    """JOIN-1: the comparison key of a site URL: https added, lower-cased, slashes removed."""
    s = F.trim(text(c))
    full = F.when((s != "") & ~s.rlike(r"(?i)^https?://"), F.concat(F.lit("https://"), s)).otherwise(s)
    return F.replace(ascii_lower(full), F.lit("/"), F.lit(""))
