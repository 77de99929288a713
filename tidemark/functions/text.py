"""Text columns: accents, labels, periods, money, tags, sentiment, publishers and ids."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _accents() -> tuple[str, str]:
    """Every composed Latin letter that decomposes to a plain one, and that letter; d with stroke too."""
    pairs = {"đ": "d", "Đ": "D"}
    for i in range(0xC0, 0x1EFA):
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs[chr(i)] = base[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def strip_accents(c: Column) -> Column:
    return F.translate(c, _FROM, _TO)


#: Fixed value: an enumeration at the start of a label, bullet, number and what follows it.
ENUMERATION = r"^\s*(?:[-–•+]\s*)?(?:(?:[ivxlcdm]+|[a-z]|\d+(?:\.\d+)*)\s*[.)\-–:/]\s*)?"


def norm_label(c: Column) -> Column:
    """Lower case, without an enumeration at the start, with single spaces. Letters are expected in composed form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), ENUMERATION, ""), r"\s+", " "))


def period_key(label: Column) -> Column:
    """year * 10 + quarter from a label such as 2024-Q3 or Q1/2025; quarter 0 for a year; null without a year."""
    year = F.regexp_extract(label, r"((?:19|20)\d\d)", 1)
    rest = F.regexp_replace(label, r"(?:19|20)\d\d", " ")
    q = F.regexp_extract(F.upper(rest), r"Q\s*([1-4])", 1)
    digit = F.regexp_extract(rest, r"(?<!\d)([1-4])(?!\d)", 1)
    quarter = F.coalesce(F.nullif(q, F.lit("")), F.nullif(digit, F.lit("")), F.lit("0"))
    return F.when(year != "", (year.try_cast("int") * 10 + quarter.try_cast("int")))


def period_label(key: Column) -> Column:
    q, y = key % 10, F.floor(key / 10)
    return F.when(q.between(1, 4), F.concat(F.lit("Q"), q, F.lit("/"), y)).otherwise(y.cast("string"))


def money(token: Column) -> Column:
    """A number with dots or commas for thousands; in brackets it is negative."""
    digits = F.regexp_replace(token, r"[^\d]", "")
    value = digits.try_cast("double")
    return F.when(F.trim(token).rlike(r"^\(.*\)$") | F.trim(token).startswith("-"), -value).otherwise(value)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def clean(c: Column) -> Column:
    """Single spaces; words that stand for nothing become null."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(~F.lower(t).isin("", "n/a", "na", "none", "null", "nan", "-"), t)


def lexicon_score(c: Column, positive: list[str], negative: list[str]) -> Column:
    """Number of positive words contained less that of negative ones."""
    low = F.lower(c)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in positive), F.lit(0)) - sum((F.contains(low, F.lit(w)).cast("int") for w in negative), F.lit(0))


def sentiment(c: Column, positive: list[str], negative: list[str]) -> Column:
    s = lexicon_score(c, positive, negative)
    return F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")


def short_id(*parts: Column, n: int = 20) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, n)


#: The patterns of document_class() are fixed values.
def document_class(title: Column, url: Column, year: Column) -> dict[str, Column]:
    """doc_type, year (the latest named that is not after `year`), quarter, consolidated and period_key of a document by its title and address."""
    t = F.regexp_replace(strip_accents(F.lower(F.concat_ws(" ", title, url))), "[_-]", " ")
    statement = t.rlike(r"bao cao tai chinh|financial statement|\bbctc\b|\bfs\b")
    kind = (
        F.when(t.rlike(r"bao cao thuong nien|annual report|\bbctn\b"), "annual_report").when(statement & t.rlike("ban nien|soat xet|6 thang|semi|interim|giua nien do"), "fs_semiannual")
        .when(statement & t.rlike(r"\bquy\s*[1-4]\b|\bq\s*[1-4]\b|quarter"), "fs_quarterly").when(statement, "fs_annual").otherwise("other")
    )
    named = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)((?:19|20)\d\d)(?!\d)"), 1), lambda y: y.cast("int"))
    last = F.array_max(F.filter(named, lambda y: y <= year))
    q = F.when(kind == "fs_quarterly", F.nullif(F.regexp_extract(t, r"(?:quy|q)\s*([1-4])\b", 1), F.lit("")).try_cast("int"))
    whole = F.when(kind.isin("annual_report", "other"), None).otherwise(~t.rlike(r"\brieng\b|cong ty me|separate"))
    key = F.when(q.isNotNull(), last * 10 + q).when(kind == "fs_semiannual", last * 10 + 2).otherwise(last * 10)
    return {"doc_type": kind, "year": last, "quarter": q, "consolidated": whole, "period_key": key}


def headline(title: Column, publishers: dict[str, str], unknown: str) -> tuple[Column, Column]:
    """Title and publisher of a headline split at its last dash; a publisher that holds a known word takes the name that goes with it."""
    parts = F.size(F.split(title, " - "))
    source = F.when(parts > 1, F.trim(F.substring_index(title, " - ", -1))).otherwise(F.lit(unknown))
    for word, name in reversed(publishers.items()):
        source = F.when(F.contains(F.lower(source), F.lit(word)), name).otherwise(source)
    head = F.when(parts > 1, F.trim(F.regexp_extract(title, r"(?s)^(.*) - ", 1))).otherwise(F.trim(title))
    return head, source


def unit_of(text: Column, units: dict[str, float]) -> Column:
    """The factor of the first unit word that the text holds, else 1."""
    out = F.lit(1.0)
    for word, factor in reversed(units.items()):
        out = F.when(F.contains(F.lower(text), F.lit(word)), factor).otherwise(out)
    return out


#: Fixed value: endings of documents.
ENDINGS = (".pdf", ".zip", ".rar", ".doc", ".docx", ".xls", ".xlsx")


def absolute(href: Column, base: Column) -> Column:
    """An address as seen from a page: whole, without a scheme, from the site's root, or beside the page; dots are left as they are."""
    site, scheme = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1), F.regexp_extract(base, r"^(\w+:)//", 1)
    beside = F.regexp_extract(base, r"^(\w+://[^?#]*/)[^/?#]*", 1)
    beside = F.when(F.length(beside) > F.length(site), beside).otherwise(F.concat(site, F.lit("/")))
    return F.when(href.rlike(r"^\w+:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(beside, href))


#: An address in double, single or no quotes.
_HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def links(html: Column, base: Column) -> Column:
    """Titles and absolute addresses of the anchors of a page, as an array of structs; an anchor without text goes by its title attribute."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), 0)

    def one(a):
        tag = F.regexp_extract(a, r"(?is)^<a\s[^>]*>", 0)
        href = F.trim(F.concat(*[F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)]))
        title = F.coalesce(F.nullif(strip_tags(a), F.lit("")), F.regexp_extract(tag, r"(?is)\stitle\s*=\s*[\"']([^\"']*)", 1))
        return F.struct(title.alias("title"), absolute(href, base).alias("url"), tag.rlike(_HREF).alias("has"))

    return F.transform(F.filter(F.transform(found, one), lambda x: x["has"]), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))


def document_links(html: Column, base: Column) -> Column:
    """The links of a page that lead to documents: by their ending, or a path that says so. A link without a title goes by the last part of its path."""

    def path(x):
        return F.regexp_extract(x["url"], r"^\w+://[^/?#]*([^?#]*)", 1)

    def leads(x):
        low = F.lower(path(x))
        return low.rlike("(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$") | F.contains(low, F.lit("download")) | (F.contains(low, F.lit("file")) & F.contains(F.substring_index(low, "/", -1), F.lit(".")))

    return F.transform(F.filter(links(html, base), leads), lambda x: F.struct(F.coalesce(F.nullif(x["title"], F.lit("")), F.regexp_extract(path(x), "([^/]*)/*$", 1)).alias("title"), x["url"].alias("url")))
