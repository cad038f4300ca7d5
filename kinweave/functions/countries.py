"""Countries as ISO 3166 alpha-2 codes.

The table of codes and English names comes from the JVM's locale data, so it is
a dimension of a few hundred rows whatever the data.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import bind, literal_map, strip

# Informal names.
ALIASES: dict[str, str] = {
    "usa": "US", "us": "US", "united states": "US", "united states of america": "US", "america": "US",
    "uk": "GB", "england": "GB", "britain": "GB", "great britain": "GB", "united kingdom": "GB",
    "uae": "AE", "south korea": "KR", "north korea": "KP", "russia": "RU", "bharat": "IN", "india": "IN",
}


@lru_cache(maxsize=4)
def _names(session_id: int) -> tuple[dict[str, str], dict[str, str]]:
    spark = SparkSession.getActiveSession()
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    codes, names = {}, {}
    for code in locale.getISOCountries():
        place = locale("", code)
        codes[code.lower()] = code
        codes[place.getISO3Country().lower()] = code
        names[place.getDisplayCountry(english).lower()] = code
    return codes, names


def country_table(spark: SparkSession) -> tuple[dict[str, str], dict[str, str]]:
    """(codes of two and three letters, names), lower-cased, each with its alpha-2 code."""
    return _names(id(spark.sparkContext))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(literal_map(table), key)


#: Letters with marks that a text may have where a name is met without them.
MARKED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Letters from which on a text may be part of a name, or misspell one; and misspell it twice.
PART, MISSPELT, MISSPELT_TWICE = 4, 5, 8


def bare_name(name: str) -> str:
    """A name without marks and punctuation."""
    letters = unicodedata.normalize("NFKD", name.lower())
    return " ".join(re.sub(r"[^a-z]+", " ", "".join(c for c in letters if not unicodedata.combining(c)).replace("’", "")).split())


def _grams(word: str) -> set[str]:
    return {f"^{word}$"[k : k + 3] for k in range(len(word))}


@lru_cache(maxsize=4)
def _index(session_id: int) -> tuple[dict[str, str], str]:
    """(bare names with their codes, the inverted index of their trigrams as an expression)."""
    names = {bare_name(n): code for n, code in _names(session_id)[1].items()}
    holders: dict[str, list[str]] = {}
    for name in sorted(names):
        for gram in sorted(_grams(name)):
            holders.setdefault(gram, []).append(name)
    listed = ", ".join("'" + g + "', array(" + ", ".join(f"'{n}'" for n in found) + ")" for g, found in holders.items())
    return names, f"map({listed})"


def search_country(c: str | Column, spark: SparkSession) -> Column:
    """The code of the one country whose name a text is part of, or misspells; null if there is none or are several.

    Names that hold the text count more the earlier they do; after them
    come names at one edit (of five letters on), then at two (of eight on).  Only names that
    share a trigram with the text are looked at, which no such name does without.
    """
    names, index = _index(id(spark.sparkContext))
    said = F.btrim(F.regexp_replace(F.translate(F.lower(strip(c)), MARKED, PLAIN), "[^a-z]+", " "))

    def search(q: Column) -> Column:
        size = F.length(q)
        ends = F.concat(F.lit("^"), q, F.lit("$"))
        grams = F.transform(F.sequence(F.lit(1), size), lambda k: F.substr(ends, k, F.lit(3)))
        met = F.array_distinct(F.flatten(F.filter(F.transform(grams, lambda g: F.element_at(F.expr(index), g)), lambda x: x.isNotNull())))

        def points(name: Column) -> Column:
            at, edits = F.call_function("instr", name, q), F.levenshtein(name, q)
            near = (edits <= 1) & (size >= MISSPELT) | (edits <= 2) & (size >= MISSPELT_TWICE)
            return F.when(at > 0, F.greatest(F.lit(5), F.lit(32) - 2 * at)).when(near, F.lit(3) - edits).otherwise(0)

        def best(found: Column) -> Column:
            most = F.array_max(F.transform(found, lambda x: x["points"]))
            codes = F.array_distinct(F.transform(F.filter(found, lambda x: (x["points"] == most) & (most > 0)), lambda x: _lookup(names, x["name"])))
            return F.when(F.size(codes) == 1, F.get(codes, F.lit(0)))

        scored = F.transform(met, lambda n: F.struct(points(n).alias("points"), n.alias("name")))
        return F.when(size >= PART, bind(scored, best))

    return bind(said, search)


def normalize_country(c: str | Column, spark: SparkSession) -> Column:
    """The code of a country given by alias, code or name; null if none is meant without doubt.

    A longer text means a country if it holds exactly one country's name as whole words.
    What means none so far is searched for (see ``search_country``).
    """
    codes, names = country_table(spark)
    plain = {n: a for n, a in names.items() if not re.search(r"[^\w ]|[\d_]", n)}  # others can't be met word by word
    longest = max(len(n.split()) for n in plain)

    def code(s: Column) -> Column:
        words = F.filter(F.split(s, r"[^\p{L}\p{M}]+"), lambda w: w != "")
        # Every run of words that is no longer than a name is looked up.
        runs = lambda n: F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, n), " "))
        held = bind(F.concat(*(runs(n) for n in range(1, longest + 1))), lambda found: F.array_distinct(F.array_compact(F.transform(found, lambda x: _lookup(plain, x)))))
        return F.coalesce(
            _lookup({**codes, **names, **ALIASES}, F.btrim(s, F.lit(". "))),
            bind(F.when(s.rlike(r"\s"), held), lambda h: F.when(F.coalesce(F.size(h), F.lit(0)) > 0, F.when(F.size(h) == 1, F.get(h, F.lit(0)))).otherwise(search_country(s, spark))),
        )

    return bind(F.lower(strip(c)), code)
