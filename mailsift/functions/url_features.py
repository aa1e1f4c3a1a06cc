"""URL features of a text column.

Everything stays inside the row: the URL list of one mail is an array, hosts and suffixes are
derived with higher-order functions, and no shuffle is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.functions.patterns import AT_WORD_START, SPACE, matches, replace_all

_STOP = rf"{SPACE}<>\"'\)\]"
URL = rf"(?<!\w)(?=[hwHW]){AT_WORD_START}(?iu)(?:(?:https?|hxxps?)://[^{_STOP}]++|www\.[^{_STOP}]++)"
TRAILING_PUNCTUATION = r"[.,;:!?\)\]\"']++\z"
# Authority of a URL; a "www." string holding "://" further on has no parsable authority.
AUTHORITY = r"(?iu)\A(?:(?:https?|hxxps?)://|(?!.*://))([^/?#]*)"
IPV4 = r"\A\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}\z"


def suffix_pattern(generic: list[str], second_levels: dict[str, str]) -> str:
    """Regex whose leftmost match at the end of a host is its longest public suffix."""
    registry = [f"(?:{'|'.join(labels.split())})\\.{country}" for country, labels in second_levels.items()]
    return rf"(?:\A|\.)({'|'.join(registry)}|[a-z]{{2}}|{'|'.join(generic)})\z"


@dataclass(frozen=True)
class SuffixRules:
    """Rules of a public suffix list: endings, parents of which every child is an ending, and exceptions to these."""

    endings: frozenset[str]
    parents: frozenset[str]
    exceptions: frozenset[str]

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SuffixRules:
        """From a file with a rule a line: ``co.uk``, ``*.ck`` or ``!www.ck``; ``//`` begins a remark.

        Such a list has some ten thousand lines; it is read to the driver and travels with the expression.
        Rules in other scripts hold for their ASCII form too.
        """
        lines = [r.value.split()[0] for r in spark.read.text(path).collect() if r.value.split()]
        rules = {line.lower() for line in lines if not line.startswith("//")}
        rules |= {rule.encode("idna").decode() for rule in rules if not rule.isascii() and rule[0] not in "*!"}
        return cls(
            frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")),
            frozenset(r[1:] for r in rules if r.startswith("!")))

    def longest(self, host: Column) -> Column:
        """The host's longest ending by the rules, exceptions first; empty without any."""
        labels = F.split(host, r"\.")
        places = F.sequence(F.lit(1), F.size(labels))
        endings = F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

        def rest(ending: Column) -> Column:
            return F.when(F.contains(ending, F.lit(".")), F.regexp_replace(ending, r"\A[^.]*\.", "")).otherwise(F.lit(""))

        def among(value: Column, names: frozenset[str]) -> Column:
            return value.isin(sorted(names)) if names else F.lit(False)

        kept = F.filter(endings, lambda e: among(e, self.exceptions))
        found = F.filter(endings, lambda e: among(e, self.endings) | among(rest(e), self.parents))
        return F.when(F.size(kept) > 0, rest(F.get(kept, 0))).otherwise(F.coalesce(F.get(found, 0), F.lit("")))


DEFAULT_SUFFIXES = suffix_pattern(V.GENERIC_SUFFIXES, V.COUNTRY_SECOND_LEVELS)


def extract_urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.transform(found, lambda u: replace_all(u, TRAILING_PUNCTUATION, ""))


def url_host(url: Column) -> Column:
    """Lower-case host without user info and port; empty where the URL does not parse."""
    authority = F.regexp_extract(url, AUTHORITY, 1)
    host = F.lower(F.regexp_extract(replace_all(authority, r"\A.*@", ""), r"\A([^:]*)", 1))
    return F.when(F.contains(authority, F.lit("[")), F.lit("")).otherwise(host)


def has_user_info(url: Column) -> Column:
    after_scheme = replace_all(url, r"\A.*?://", "")
    return F.contains(F.substring_index(after_scheme, "/", 1), F.lit("@"))


def is_ipv4(host: Column) -> Column:
    return matches(host, IPV4)


def public_suffix(host: Column, suffixes: str | SuffixRules = DEFAULT_SUFFIXES) -> Column:
    """By the rules of a list, or by a pattern; the default pattern is a short list of our own."""
    if isinstance(suffixes, SuffixRules):
        return suffixes.longest(host)
    return F.regexp_extract(host, suffixes, 1)


def domain_label(host: Column, suffix: Column) -> Column:
    """The label left of the public suffix; the last label where the suffix is unknown."""
    rest = F.when(suffix == "", host).otherwise(
        F.substring(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    )
    return F.substring_index(rest, ".", -1)


def registered_domain(domain: Column, suffix: Column) -> Column:
    return F.when(suffix == "", domain).otherwise(F.concat(domain, F.lit("."), suffix))


def shannon_entropy(label: Column) -> Column:
    """Base-2 entropy over the characters of a label."""
    characters = F.filter(F.split(label, ""), lambda c: c != "")
    total = F.size(characters)

    def term(character: Column) -> Column:
        share = F.size(F.filter(characters, lambda c: c == character)) / total
        return -share * F.log2(share)

    return F.aggregate(F.transform(F.array_distinct(characters), term), F.lit(0.0), lambda a, b: a + b)


def with_urls(df: DataFrame, text: str = "text", out: str = "urls") -> DataFrame:
    return df.withColumn(out, extract_urls(F.coalesce(F.col(text), F.lit(""))))


def with_url_parts(df: DataFrame, suffixes: str | SuffixRules = DEFAULT_SUFFIXES) -> DataFrame:
    """Append ``_parts``: per URL its host, suffix, domain, IP flag and user-info flag."""
    hosts = F.transform("urls", lambda u: F.struct(url_host(u).alias("host"), has_user_info(u).alias("at")))

    def split_host(h: Column) -> Column:
        named = replace_all(h.host, r"\.++\z", "")
        return F.struct(
            h.host.alias("host"),
            h["at"].alias("at"),
            is_ipv4(h.host).alias("ip"),
            named.alias("named"),
            F.when(is_ipv4(named), F.lit("")).otherwise(public_suffix(named, suffixes)).alias("suffix"),
        )

    def with_domain(p: Column) -> Column:
        return F.struct(
            p.host.alias("host"), p["at"].alias("at"), p.ip.alias("ip"), p.suffix.alias("suffix"),
            F.when(is_ipv4(p.named), p.named).otherwise(domain_label(p.named, p.suffix)).alias("domain"),
        )

    split = F.transform(hosts, split_host)
    return df.withColumn("_parts", F.transform(split, with_domain))


def with_url_features(df: DataFrame, text: str = "text", suffixes: str | SuffixRules = DEFAULT_SUFFIXES) -> DataFrame:
    """Append the six URL features; mails without URLs get 0 / False / 0.0."""
    parts = with_url_parts(with_urls(df, text), suffixes)
    entropies = F.transform(
        F.filter("_parts", lambda p: ~p.ip & (p.domain != "")), lambda p: shannon_entropy(p.domain)
    )
    featured = parts.withColumn("_entropies", entropies).withColumns(
        {
            "url_count": F.size("urls"),
            "has_ip_literal": F.exists("_parts", lambda p: p.ip),
            "has_url_shortener": F.exists(
                "_parts", lambda p: registered_domain(p.domain, p.suffix).isin(V.URL_SHORTENERS)
            ),
            "avg_domain_entropy": F.when(
                F.size("_entropies") > 0,
                F.aggregate("_entropies", F.lit(0.0), lambda a, b: a + b) / F.size("_entropies"),
            ).otherwise(F.lit(0.0)),
            "suspicious_tld": F.exists("_parts", lambda p: p.suffix.isin(V.SUSPICIOUS_TLDS)),
            "has_at_symbol": F.exists("_parts", lambda p: p["at"]),
        }
    )
    return featured.select(*df.columns, *V.URL_FEATURES)
