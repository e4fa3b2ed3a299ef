"""Text as Column expressions: normalisation, tokens, trigram similarity, abbreviations and codes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of generated abbreviations.
STOP_WORDS = (
    "of", "the", "and", "at", "in", "for", "a", "an", "de", "la", "le", "les", "du", "des", "et", "au", "der", "die", "das", "von", "und", "im", "am",
    "del", "los", "las", "el", "dos", "e", "di", "della", "dei", "degli",
)
# Tags that hold lookup codes.
CODE_TAGS = ("iata", "icao", "ref", "short_name", "abbreviation", "alt_name")
# Road types and the short form searched along with them.
ROAD_SHORT = (
    ("Street", "St"), ("Avenue", "Ave"), ("Boulevard", "Blvd"), ("Drive", "Dr"), ("Lane", "Ln"), ("Road", "Rd"), ("Court", "Ct"), ("Place", "Pl"),
    ("Circle", "Cir"), ("Parkway", "Pkwy"), ("Highway", "Hwy"), ("Trail", "Trl"),
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _accents() -> tuple[str, str]:
    """Latin letters with accents and their bare forms, from Unicode's own decompositions."""
    pairs = []
    for k in range(0xC0, 0x250):
        bare = "".join(ch for ch in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(ch))
        if len(bare) == 1 and bare != chr(k):
            pairs.append((chr(k), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def unaccent(text: Column | str) -> Column:
    """Latin letters without their accents, in the JVM."""
    return F.translate(_c(text), _FROM, _TO)


def words(text: Column | str) -> Column:
    """Distinct lower-case words of letters and digits, in order of first appearance; empty for null."""
    parts = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def trigrams(text: Column | str) -> Column:
    """Distinct triples of letters of each word, which is padded by two blanks before and one after."""
    per_word = F.transform(
        words(text),
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(per_word))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams over all trigrams of both texts; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    all_ = F.size(F.array_union(x, y))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / all_)


def query_trigrams(query: str) -> list[str]:
    """The trigrams of a fixed text."""
    padded = [f"  {w} " for w in re.findall(r"[^\W_]+", query.lower())]
    return sorted({p[i : i + 3] for p in padded for i in range(len(p) - 2)})


def shared_trigrams(text: Column | str, query: str) -> Column:
    """How many of a fixed text's trigrams a text has: substring tests only, no list is built."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    return sum((padded.contains(t).cast("int") for t in query_trigrams(query)), F.lit(0))


def like_filter(text: Column | str, query: str, least: float) -> Column:
    """What must hold for a similarity of at least `least`: that share of the query's trigrams is there. Rows that
    fail never have their own trigrams taken."""
    import math

    return shared_trigrams(text, query) >= max(1, math.ceil(least * len(query_trigrams(query)) - 1e-9))


def search_tokens(name, names, name_abbrev, categories, parent_context, is_crossing: Column) -> Column:
    """The words a place is found by: name ('&' as and/et/und/y/e, apostrophes dropped, for crossings also the short
    forms of road types and all names), abbreviation, categories and parent context, without accents."""
    base = F.replace(F.coalesce(_c(name), F.lit("")), F.lit(" & "), F.lit(" and et und y e "))
    crossing = base
    for long, short in ROAD_SHORT:
        crossing = F.replace(crossing, F.lit(long), F.lit(f"{long} {short}"))
    crossing = F.concat(crossing, F.lit(" "), F.coalesce(F.array_join(_c(names), " "), F.lit("")))
    cats = F.coalesce(F.translate(F.array_join(_c(categories), " "), "/_", "  "), F.lit(""))
    whole = F.concat_ws(" ", F.when(is_crossing, crossing).otherwise(base), F.coalesce(_c(name_abbrev), F.lit("")), cats, F.coalesce(_c(parent_context), F.lit("")))
    return words(unaccent(F.replace(whole, F.lit("'"), F.lit(""))))


def abbreviation(name: Column | str) -> Column:
    """First letters of the words that are no stop words; null for fewer than two, or names with other signs than
    letters, digits, blanks and _ - ' . &."""
    n = _c(name)
    kept = F.filter(F.split(n, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS))
    letters = F.lower(F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(n.rlike(r"(?U)^[\w\s\-'.&]+$") & (F.size(kept) >= 2), letters)


def codes(tags: Column | str) -> Column:
    """Sorted distinct lower-case codes of the code tags, each split at ';'; null without any such tag or code."""
    t = _c(tags)
    parts = F.flatten(F.array(*[F.split(F.coalesce(t[k], F.lit("")), ";") for k in CODE_TAGS]))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda c: F.lower(F.trim(c))), lambda c: c != "")))
    return F.when(F.size(found) > 0, found)


def sanitise_query(query: str | None) -> str:
    """A search text without apostrophes, other signs (besides _ - .) turned to blanks; ASCII word characters."""
    return re.sub(r"[^\w\s\-.]", " ", re.sub("['’]", "", query or ""), flags=re.ASCII).strip()


def looks_like_address(query: str) -> bool:
    return re.match(r"\s*\d", query) is not None


def pretty_label(path: Column | str) -> Column:
    """The last part of a region's path in title case, '-' as blank; names without '/' stay."""
    p = _c(path)
    return F.when(p.contains("/"), F.initcap(F.replace(F.element_at(F.split(p, "/"), -1), F.lit("-"), F.lit(" ")))).otherwise(p)
