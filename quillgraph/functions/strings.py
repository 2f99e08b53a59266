"""Names, identifiers and similarities. Columns where Spark has the functions, Arrow-batched UDFs where it has not."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Registries that are trusted, from the best on; one trailing legal form is not part of a name.
SCHEMES = {"GB-COH": 1, "GB-NHS": 2, "GB-UKPRN": 3, "GB-CHC": 4, "GB-SC": 5, "GB-NIC": 6, "GB-MPR": 7, "GB-FTS": 99}
OFFICIAL = [s for s, p in SCHEMES.items() if p < 50]
LEGAL_FORMS = ["LIMITED LIABILITY PARTNERSHIP", "COMMUNITY INTEREST COMPANY", "INCORPORATED", "LIMITED", "LIMITE", "LLP", "CIC", "PLC", "LTD", "INC", "CO"]
STOP_TOKENS = [
    "AND", "THE", "FOR", "WITH", "LIMITED", "LTD", "PLC", "LLP", "INC", "COMPANY", "GROUP", "SERVICES", "SERVICE", "TRUST", "COUNCIL", "AUTHORITY", "UNIVERSITY", "COLLEGE", "SCHOOL",
    "NATIONAL", "INTERNATIONAL",
]


@F.pandas_udf(T.StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    """Letters without their accents; what has no ASCII form is left out."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def norm_name(c: Column) -> Column:
    """An organisation's name in capitals: ASCII, & as AND, no punctuation, without one trailing legal form; empty for a missing name."""
    s = F.upper(F.trim(to_ascii(c)))
    s = F.regexp_replace(F.regexp_replace(s, r"\s*&\s*", " AND "), r"[^\w\s]", " ")
    s = F.trim(F.regexp_replace(s, r"\b(" + "|".join(LEGAL_FORMS) + r")\b\.?$", ""))
    return F.coalesce(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(""))


def scheme_of(raw: Column) -> Column:
    """`AA-BBB` of an identifier `AA-BBB-value`; empty if it has fewer parts."""
    p = F.split(raw, "-")
    return F.when(F.size(p) >= 3, F.concat_ws("-", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).otherwise("")


def value_of(raw: Column) -> Column:
    """The value of an identifier, which may have further hyphens."""
    p = F.split(raw, "-", 3)
    return F.when(F.size(p) == 3, F.get(p, F.lit(2))).otherwise("")


def is_official(scheme: Column) -> Column:
    return F.upper(F.trim(scheme)).isin(*OFFICIAL)


def priority(scheme: Column) -> Column:
    """Rank of a registry, lower is better; 50 for one not listed."""
    out = F.lit(50)
    for s, p in SCHEMES.items():
        out = F.when(F.upper(F.trim(scheme)) == s, p).otherwise(out)
    return out


def canonical_id(raw: Column) -> Column:
    """The identifier by its official registry, or null."""
    scheme = F.upper(F.trim(scheme_of(raw)))
    value = F.when(scheme == "GB-NHS", F.upper(F.trim(value_of(raw)))).otherwise(F.trim(value_of(raw)))
    return F.when(is_official(scheme), F.concat_ws("-", scheme, value))


def prefix_code(c: Column, n: int) -> Column:
    """The first n characters of a code that has as many; else empty."""
    return F.when(F.length(c) >= n, F.substring(c, 1, n)).otherwise("")


def stable_hash(n: int, *parts: Column) -> Column:
    """The first n hex digits of the parts' SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, n)


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct words of a normalised name, without stop words and short ones."""
    return F.filter(F.array_distinct(F.split(F.trim(c), r"\s+")), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_TOKENS))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def acronym(norm: Column) -> Column:
    """Initials of a name of two or more words, if they are two to eight; else empty."""
    w = F.filter(F.split(F.trim(norm), r"\s+"), lambda x: (x != "") & ~x.isin(*STOP_TOKENS))
    a = F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")
    return F.when((F.size(w) >= 2) & F.length(a).between(2, 8), a).otherwise("")


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of n words."""
    w = F.split(F.trim(F.lower(c)), r"\s+")
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of up to four first letters that agree."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    own = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                own.append(x)
                break
    if not own:
        return 0.0
    other = [y for y, t in zip(b, taken) if t]
    m, swapped = len(own), sum(x != y for x, y in zip(own, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y or i == 4), min(4, len(a), len(b)))
    return jaro + min(same, 4) * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all, by longest matching blocks."""
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def ngram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the counts of character runs of length 3 to 5."""
    from collections import Counter
    from math import sqrt

    def grams(s: str) -> Counter:
        s = f" {s.lower()} "
        return Counter(s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1))

    def cosine(x: str, y: str) -> float:
        p, q = grams(x), grams(y)
        norm = sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
        return sum(v * q[k] for k, v in p.items()) / norm if norm else 0.0

    return pd.Series([cosine(x or "", y or "") for x, y in zip(a, b)])


def region_relation(a: Column, b: Column) -> Column:
    """missing, same, compatible_hierarchy (one UK code begins with the other) or conflict."""
    x, y = F.upper(F.trim(F.coalesce(a, F.lit("")))), F.upper(F.trim(F.coalesce(b, F.lit(""))))
    part = x.startswith("UK") & y.startswith("UK") & (x.startswith(y) | y.startswith(x))
    return F.when((x == "") | (y == ""), "missing").when(x == y, "same").when(part, "compatible_hierarchy").otherwise("conflict")


def string_list(c: Column) -> Column:
    """A JSON list of strings; an empty list for anything else."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def region_set(primary: Column, listed: Column) -> Column:
    """Sorted distinct regions of a primary one and a JSON list."""
    x = F.filter(F.concat(F.array(primary), string_list(listed)), lambda r: r.isNotNull() & (F.trim(r) != ""))
    return F.array_sort(F.array_distinct(F.transform(x, lambda r: F.trim(r))))


def equivalence_key(c: Column) -> Column:
    """A name folded for lookup: case, punctuation, & and legal forms do not matter."""
    return F.lower(F.regexp_replace(norm_name(c), r"\s+", ""))


def normalise_url(c: Column) -> Column:
    """A URL with scheme and lower-case host, without fragment and trailing slash; null for a blank one."""
    s = F.regexp_replace(F.trim(c), r"#.*$", "")
    s = F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(~s.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.concat(F.lit("https://"), s)).otherwise(s)
    head = F.lower(F.regexp_extract(s, r"(?i)^([a-z][a-z0-9+.-]*://[^/?]*)", 1))
    rest = F.regexp_replace(F.regexp_extract(s, r"(?i)^[a-z][a-z0-9+.-]*://[^/?]*(.*)$", 1), r"/+$", "")
    return F.when(F.trim(c) != "", F.concat(head, rest))


def access_class(status: Column, ok: Column, error: Column) -> Column:
    """What a request's outcome means for reading the document."""
    return (
        F.when(ok & status.between(200, 299), "accessible").when(status.isin(401, 403, 407, 429), "access_blocked").when(status.isin(404, 410), "not_found")
        .when(status >= 500, "server_error").when(error.isNotNull() & (error != ""), "request_failed").otherwise("other")
    )


def content_class(c: Column) -> Column:
    """pdf, html, office, archive, text, image or other of a content type."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(s.contains("pdf"), "pdf").when(s.contains("html"), "html").when(s.rlike("word|excel|powerpoint|officedocument|opendocument"), "office")
        .when(s.rlike("zip|tar|rar|7z"), "archive").when(s.startswith("text/") | s.rlike("json|xml|csv"), "text").when(s.startswith("image/"), "image").otherwise("other")
    )
