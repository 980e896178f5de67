"""Column functions on text. All stay in the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.rules import RULES, RuleSet

#: Every line end that ends a line of a source; CRLF counts once.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_ID_CHARS = set("abcdefghijklmnopqrstuvwxyz0123456789")


@cache
def white_space() -> str:
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


@cache
def _digits() -> tuple[str, str]:
    """Decimal digits of other scripts and their ASCII values."""
    found = [(c, str(unicodedata.decimal(c))) for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


@cache
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """(characters with one target, their targets, characters that vanish, characters with several targets)."""
    one, to, gone, many = [], [], [], {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or c in _ID_CHARS:
            continue
        target = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if not target:
            gone.append(c)
        elif len(target) == 1 and target in _ID_CHARS:
            one.append(c)
            to.append(target)
        elif len(target) > 1 and _ID_CHARS & set(target):
            many[c] = "".join(x if x in _ID_CHARS else " " for x in target)
    return "".join(one), "".join(to), "".join(gone), many


def strip(text: Column) -> Column:
    """Without white space (as Python has it) at either end."""
    return F.btrim(text, F.lit(white_space()))


def fold(text: Column) -> Column:
    """Concept id: lower case, no diacritics, runs of all else as one hyphen; null where nothing is left.

    Folding works on single characters, so a translation table is exact. Of the few characters that
    fold to several, those that a text holds are replaced one after the other.
    """
    one, to, gone, many = _fold_tables()
    spelled = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    held = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0))), lambda c: F.map_contains_key(spelled, c))
    wide = F.aggregate(held, text, lambda done, c: F.replace(done, c, F.try_element_at(spelled, c)))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(wide, one + gone, to))  # most texts are ASCII
    return F.nullif(F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def fold_or_raise(text: Column) -> Column:
    """Concept id; a text that folds to nothing stops the query."""
    folded = fold(text)
    message = F.concat(F.lit("surface form yields an empty concept id: "), text)
    return F.when(folded.isNotNull(), folded).when(text.isNull(), F.lit(None)).otherwise(F.raise_error(message).cast("string"))


def split_lines(content: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    parts = F.split(content, LINE_END)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def heading_number(text: Column, rules: RuleSet = RULES) -> Column:
    """Number of an entry heading, null on other lines; digits of any script."""
    digits = F.regexp_extract(text, rules.heading, 1)
    return F.translate(F.nullif(digits, F.lit("")), *_digits()).cast("int")


def heading_title(text: Column, rules: RuleSet = RULES) -> Column:
    return strip(F.regexp_extract(text, rules.heading, 2))


def says_kind(title: Column, rules: RuleSet = RULES) -> Column:
    """The title itself names the catalogue's kind: singular, before any WITH, and not behind a comma."""
    served = F.regexp_instr(title, F.lit(rules.kind_served))
    at = F.regexp_instr(title, F.lit(rules.kind))
    return (at > 0) & ~F.rlike(title, F.lit(rules.kind_beside)) & ((served == 0) | (at < served))


def language_of(surface: Column, rules: RuleSet = RULES) -> Column:
    """fr for a letter beyond ASCII, for French word order, or for a French word; else en."""
    words = F.split(F.coalesce(fold(surface), F.lit("")), "-")
    french = F.rlike(surface, F.lit(r"[\p{L}&&[^\x00-\x7F]]")) | F.startswith(F.upper(surface), F.lit(rules.french_opening))
    return F.when(french | F.arrays_overlap(words, F.array(*map(F.lit, rules.french_words))), "fr").otherwise("en")


def terms_of(title: Column, rules: RuleSet = RULES) -> Column:
    """array<struct<surface, language, concept>> of the alternative names in a title, in its order."""
    parts = F.transform(F.split(title, rules.alternatives), lambda x: F.btrim(x, F.lit(rules.alternative_edges)))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(x.alias("surface"), language_of(x, rules).alias("language"), fold(x).alias("concept")))


def sentences_of(text: Column, rules: RuleSet = RULES) -> Column:
    """Folded words of each sentence that holds an ASCII letter or digit."""
    kept = F.filter(F.split(text, rules.sentence_end), lambda s: F.rlike(s, F.lit("[a-zA-Z0-9]")))
    return F.transform(kept, lambda s: F.split(fold(s), "-"))


def opening_of(body: Column, rules: RuleSet = RULES) -> Column:
    """The text up to the first empty line."""
    return F.substring_index(body, rules.paragraph_end, 1)


def holds_run(name: Column, wanted: Column) -> Column:
    """The words of ``wanted`` stand next to each other in ``name`` (both concept ids)."""
    return F.contains(F.concat(F.lit("-"), name, F.lit("-")), F.concat(F.lit("-"), wanted, F.lit("-")))


def width_of(name: Column) -> Column:
    return F.size(F.split(name, "-"))


def grams_of(words: Column, width: Column) -> Column:
    """array<struct<start, gram>>: runs of ``width`` words; none where the text is shorter."""
    none = F.array().cast("array<struct<start:int,gram:string>>")
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(words, i + 1, width), "-").alias("gram")))
    return F.when(width <= F.size(words), runs).otherwise(none)


def cut_prose(body: Column, limit: int) -> Column:
    """The first ``limit`` characters, with a note of how many more there are; a negative limit counts from the end.

    The note's text is a fixed value.
    """
    n = F.length(body)
    shown = F.substring(body, 1, limit) if limit >= 0 else F.left(body, F.greatest(n + limit, F.lit(0)))
    more = F.concat(shown, F.lit("...\n["), (n - limit).cast("string"), F.lit(" more characters, raise --chars to read them]"))
    return F.when(n <= limit, body).otherwise(more)
