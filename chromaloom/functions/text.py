"""Text functions as column expressions: answers, hints, paths, errors, names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that does not count in an answer.
PUNCTUATION = r"[.,;:!¡?¿\"'`´()/]"
#: Every character that decomposes into a plain one and accents (U+0300 to U+036F), and that plain one: a table made by
#: the rule, as Spark SQL has no decomposition. Accents that stand alone go by a pattern.
ACCENTS = "[\u0300-\u036f]"
_BARE = {chr(c): re.sub(ACCENTS, "", unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000}
_BARE = {c: unicodedata.normalize("NFC", x) for c, x in _BARE.items() if x != unicodedata.normalize("NFD", c)}
ACCENTED, PLAIN = ("".join(x) for x in zip(*((c, x) for c, x in _BARE.items() if len(x) == 1), strict=True))
# Short forms in answers.
SHORT_FORMS = (("jdm", "jemand"), ("jmd", "jemand"), ("etw", "etwas"))
# Articles, gender endings and trace suffixes as patterns.
ARTICLE = r"(?i)^\(?(der|die|das|los|las|el|la)\)?\s+"
GENDER = r",\s*-\w+"
# Word types and what a hint calls them.
TYPE_WORDS = {"noun": "Nomen", "verb": "Verb", "adjective": "Adjektiv", "phrase": "Wendung", "conjugation": "Verb-Konjugation", "other": "Wort"}
# Stages of an error, what a message calls them, and whether a retry may help.
STAGES = {
    "chain_invalid": ("Filter chain is out of sync", True),
    "upload_limits": ("Upload exceeds the limit", False),
    "storage_upload": ("Upload failed", True),
    "service_unavailable": ("Filter service is temporarily unavailable", True),
    "validation": ("Invalid request", False),
    "rls_denied": ("Access denied", False),
    "auth": ("You're signed out", False),
}
TRACE_SUFFIXES = r" \((?:filter working|pixelate|circulate|line art|numerate|B&W hard|B&W soft|B&W warm)\)"


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_exact(c: Column) -> Column:
    """Lower case, punctuation to spaces, white space squeezed; accents stay."""
    return _squeezed(F.regexp_replace(F.lower(c), PUNCTUATION, " "))


def norm_loose(c: Column) -> Column:
    """norm_exact with accents dropped, ß as ss and short forms written out."""
    out = F.regexp_replace(F.translate(F.replace(norm_exact(c), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), ACCENTS, "")
    for short, full in SHORT_FORMS:
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return out


def alternatives(target: Column) -> Column:
    """Accepted answers, split at semicolons."""
    return F.filter(F.transform(F.split(target, ";"), lambda x: F.trim(x)), lambda x: x != "")


def variants(alt: Column) -> Column:
    """One answer with and without what is in parentheses, always without gender endings, with and without article."""
    bare = _squeezed(F.regexp_replace(alt, r"\([^)]*\)", " "))
    bases = F.transform(F.array(alt, bare), lambda x: F.trim(F.regexp_replace(x, GENDER, "")))
    both = F.flatten(F.transform(bases, lambda x: F.array(x, F.trim(F.regexp_replace(x, ARTICLE, "")))))
    return F.array_distinct(F.filter(both, lambda x: x != ""))


def accepted(target: Column) -> Column:
    return F.flatten(F.transform(alternatives(target), variants))


def grade(answer: Column, target: Column) -> Column:
    """correct: an accepted form; almost: but for accents, short forms or one typo in four letters or more; wrong.

    A null answer or target is wrong."""
    own, loose = norm_exact(answer), norm_loose(answer)
    forms = accepted(target)
    exact = F.exists(forms, lambda x: norm_exact(x) == own)
    near = F.exists(forms, lambda x: norm_loose(x) == loose)
    typo = (F.length(loose) >= 4) & F.exists(forms, lambda x: (F.length(norm_loose(x)) >= 4) & (F.levenshtein(norm_loose(x), loose, 1) >= 0))
    no = F.lit(False)
    return F.when(F.coalesce(own == "", F.lit(True)), "wrong").when(F.coalesce(exact, no), "correct").when(F.coalesce(near | typo, no), "almost").otherwise("wrong")


def correct_display(target: Column) -> Column:
    """The first accepted answer, as it is shown."""
    return F.coalesce(F.get(alternatives(target), F.lit(0)), F.trim(target))


def is_single_word(target: Column) -> Column:
    """Whether the shortest form of the first answer has no white space (of equally short ones the first)."""
    forms = variants(correct_display(target))
    least = F.array_min(F.transform(forms, lambda x: F.length(x)))
    core = F.get(F.filter(forms, lambda x: F.length(x) == least), F.lit(0))
    return F.coalesce(~core.rlike(r"\s"), F.lit(False))


def article_of(term: Column) -> Column:
    """A leading German or Spanish article in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(term), r"(?i)^\(?(der|die|das|el|la|los|las)\)?\b", 1)), F.lit(""))


def _spaced(c: Column) -> Column:
    """Characters with a space between them."""
    return F.regexp_replace(c, "(?s)(.)(?=.)", "$1 ")


def length_mask(term: Column) -> Column:
    """Letters as underscores, words kept apart."""
    return F.array_join(F.transform(F.split(F.regexp_replace(F.trim(term), r"\p{L}", "_"), r"\s+"), _spaced), "   ·   ")


def letter_reveal(term: Column, fraction: float) -> Column:
    """The first letters (a fraction of them, halves up, one at least), the rest as underscores.

    The place of the last letter shown is found in a mask of the term, so the work grows with its length alone."""
    mask = F.regexp_replace(F.replace(term, F.lit("_"), F.lit("-")), r"\p{L}", "_")
    letters = F.length(mask) - F.length(F.replace(mask, F.lit("_"), F.lit("")))
    shown = F.greatest(F.lit(1), F.floor(letters * fraction + 0.5).cast("int"))
    upto = F.length(F.call_function("substring_index", mask, F.lit("_"), shown)) + 1
    out = F.concat(term.substr(F.lit(1), upto), F.regexp_replace(term.substr(upto + 1, F.length(term)), r"\p{L}", "_"))
    return F.regexp_replace(_spaced(out), " {2,}", "   ")


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def blank_word(sentence: Column, target: Column) -> Column:
    """The sentence with the target, else a word of it, else its longest word, blanked out once."""
    core = F.trim(F.regexp_replace(target, ARTICLE, ""))
    tries = F.filter(F.concat(F.array(core), F.split(core, r"\s+")), lambda x: F.length(x) >= 3)
    low = F.lower(sentence)
    hit = F.get(F.filter(tries, lambda x: F.instr(low, F.lower(x)) > 0), F.lit(0))
    words = F.split(sentence, r"\s+")
    most = F.array_max(F.transform(words, lambda x: F.length(x)))
    longest = F.get(F.filter(words, lambda x: F.length(x) == most), F.lit(0))

    def cut(word: Column) -> Column:
        at = F.position(F.lower(word), low)
        return F.concat(sentence.substr(F.lit(1), at - 1), F.lit("_____"), sentence.substr(at + F.length(word), F.length(sentence)))

    return F.when(hit.isNotNull(), cut(hit)).when(F.length(longest) >= 4, cut(longest)).otherwise(sentence)


def path_parts(name: Column) -> Column:
    """File name, extension (the whole name where there is no dot) and folders of a stored key."""
    parts = F.split(name, "/")
    file = F.element_at(parts, -1)
    return F.struct(file.alias("filename"), F.element_at(F.split(file, r"\."), -1).alias("extension"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"))


def common_prefix(key: Column, prefix: str, delimiter: str = "/") -> Column:
    """The key up to the first delimiter past the prefix, or null."""
    rest = key.substr(F.lit(len(prefix) + 1), F.length(key))
    at = F.instr(rest, delimiter)
    return F.when(at > 0, key.substr(F.lit(1), at + len(prefix)))


def strip_suffix(name: Column) -> Column:
    """A name without the marks that traces and filters append."""
    return F.regexp_replace(name, TRACE_SUFFIXES, "")


def normalize_error(message: Column, stage: Column) -> Column:
    """Struct of stage, message, title and retriable. The stage is the given one, else stage=... in the message."""
    found = F.lower(F.regexp_extract(message, r"(?i)\bstage=([a-z_]+)", 1))
    known = F.coalesce(F.nullif(stage, F.lit("")), F.nullif(found, F.lit("")), F.lit("unknown"))
    short = F.regexp_replace(message, r"(?i)\(HTTP \d+(?:,\s*stage=[a-z_]+)?(?:\s+code=[\w-]+)?\):\s*", ": ")
    short = F.trim(F.regexp_replace(short, r"\s+:\s*", ": "))
    text = F.coalesce(F.nullif(short, F.lit("")), F.nullif(message, F.lit("")), F.lit("Unknown error"))
    title, retry = text, F.lit(False)
    for name, (words, again) in STAGES.items():
        title, retry = F.when(known == name, words).otherwise(title), F.when(known == name, again).otherwise(retry)
    return F.struct(known.alias("stage"), text.alias("message"), title.alias("title"), retry.alias("retriable"))
