"""Texts, addresses and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagegrid import constants as K


def keyword_flags(text: Column) -> list[Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return [low.rlike(p).cast("int").alias(name) for name, p in K.KEYWORDS.items()]


def on_domain(url: Column, domain: str) -> Column:
    return url.contains("//" + domain) | url.contains("." + domain)


def domain_flags(urls: Column) -> list[Column]:
    """For an array of lower-cased addresses, 1 where any is on one of the group's domains."""
    return [_on_any(urls, ds).cast("int").alias(name) for name, ds in K.DOMAINS.items()]


def _on_any(urls: Column, domains: tuple[str, ...]) -> Column:
    return F.exists(urls, lambda u: _any([on_domain(u, d) for d in domains]))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def leaky(url: Column) -> Column:
    return _any([url.contains(a) for a in K.LEAKY_ADDRESSES])


def purl_key(purl: Column) -> Column:
    """Package address without qualifiers and sub-path, lower-cased; null for an empty one."""
    return F.when(F.length(purl) > 0, F.lower(F.element_at(F.split(F.trim(purl), "[?#]"), 1)))


def name_variants(name: Column, group: Column) -> Column:
    n, g = F.lower(name), F.lower(F.coalesce(group, F.lit("")))
    return F.when(g != "", F.array(n, F.concat(g, F.lit(":"), n), F.concat(g, F.lit("/"), n))).otherwise(F.array(n))


def cpe_product_version(cpe: Column) -> tuple[Column, Column]:
    parts = F.split(F.replace(cpe, F.lit("cpe:/"), F.lit("cpe:2.2:")), ":")
    product, version = F.get(parts, F.lit(4)), F.get(parts, F.lit(5))
    return F.when(product != "", product), F.when(~version.isin("", "*", "-"), version)


def cve_year(cve: Column) -> Column:
    return F.substring(cve, 5, 4).try_cast("int")


def cve_ids(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(K.CVE_PATTERN), F.lit(0))
