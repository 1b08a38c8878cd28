"""Text column functions, all built from JVM-side expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits of any script plus the underscore; Java's \w is ASCII only.
WORD = r"\p{L}\p{N}_"
TERM_PATTERN = rf"[{WORD}]{{2,}}"

# ASCII punctuation (fixed value)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Characters without a decomposition, written out in ASCII (fixed values)
ASCII_SINGLE = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "ħ": "h", "Ħ": "H", "ı": "i", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-",
}
ASCII_MULTI = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "…": "...", "—": "--", "€": "EUR", "©": "(c)", "®": "(r)",
}


def _accent_table() -> dict[str, str]:
    """Accented Latin letter -> base letter, by Unicode decomposition."""
    table = dict(ASCII_SINGLE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            table.setdefault(chr(code), base)
    return table


def ascii_fold(text: Column) -> Column:
    """Latin text in plain ASCII; characters of other scripts are left as they are."""
    table = _accent_table()
    folded = F.translate(text, "".join(table), "".join(table.values()))
    for char, plain in ASCII_MULTI.items():
        folded = F.replace(folded, F.lit(char), F.lit(plain))
    return folded


def url_slug(name: Column) -> Column:
    """ASCII form of a name with a hyphen for every space."""
    return F.replace(ascii_fold(name), F.lit(" "), F.lit("-"))


def leading_count(heading: Column) -> Column:
    """First word of a heading as a number: ``1,234 Reviews`` gives 1234, no number NULL."""
    word = F.get(F.split(F.btrim(heading, F.lit(" \t\r\n")), r"\s+"), F.lit(0))
    return F.replace(word, F.lit(","), F.lit("")).try_cast("int")


def strip_punctuation(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))


# Clitics are cut from their word before words are matched: the mark stands for
# the apostrophe until then, so that a quoted word is not taken for a clitic.
_MARK = "\u0001"
_NOT = rf"n['’]t([^{WORD}]|$)"
_CLITIC = rf"['’](s|m|re|ve|ll|d)([^{WORD}]|$)"
_TOKEN = rf"n?{_MARK}[a-z]+|[{WORD}]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens with clitics split off: ``can't`` is ``ca``, ``n't``."""
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT, f" n{_MARK}t$1")
    marked = F.regexp_replace(marked, _CLITIC, f" {_MARK}$1$2")
    found = F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(_MARK), F.lit("'")))


def _ends(word: Column, ending: str, shortest: int) -> Column:
    return word.endswith(ending) & (F.length(word) >= shortest)


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


# What is left of a word without -ing or -ed: a doubled consonant was single before
# (running), a short syllable or one of these endings had an e (making, loved)
DOUBLED = "(bb|dd|gg|mm|nn|pp|rr|tt)$"
HAD_E = "(v|c|u|[eio]s|[aeiou]g|[^aeiou]at|eat|^[^aeiouy]*[aeiou][^aeiouwxy])$"
VOWEL = "[aeiouy]"


def _base(rest: Column) -> Column:
    return (
        F.when(rest.rlike(DOUBLED), _cut(rest, 1)).when(rest.rlike(HAD_E), F.concat(rest, F.lit("e"))).otherwise(rest)
    )


def stem(word: Column) -> Column:
    """Suffix rules for words a lexicon does not know: plural s, -ing and -ed."""
    without_ing, without_ed = _cut(word, 3), _cut(word, 2)
    return (
        F.when(word.endswith("ss") | word.endswith("us") | word.endswith("is") | word.endswith("eed"), word)
        .when(_ends(word, "sses", 6), _cut(word, 2))
        .when(_ends(word, "ies", 5), F.concat(_cut(word, 3), F.lit("y")))
        .when(
            _ends(word, "ches", 6) | _ends(word, "shes", 6) | _ends(word, "xes", 5) | _ends(word, "zes", 5),
            _cut(word, 2),
        )
        .when(_ends(word, "s", 4), _cut(word, 1))
        .when(_ends(word, "ing", 6) & without_ing.rlike(VOWEL), _base(without_ing))
        .when(_ends(word, "ed", 4) & without_ed.rlike(VOWEL), _base(without_ed))
        .otherwise(word)
    )


# Words of closed classes outside the kept parts of speech
CLOSED_CLASSES = {
    "DET": ("a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no"),
    "PRON": (
        "i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers",
        "it", "its", "we", "us", "our", "ours", "they", "them", "their", "theirs", "who", "whom", "whose", "what",
    ),
    "CCONJ": ("and", "or", "but", "nor"),
    "PART": ("to", "'s", "'m", "'re", "'ve", "'ll", "'d"),
}
ENDINGS = {"ADV": ("ly",), "VERB": ("ing", "ed"), "ADJ": ("ous", "ful", "able", "ible", "ive", "ish")}
NUMBER = r"^\p{N}+$"


def rule_pos(word: Column) -> Column:
    """Part of speech from the closed classes and the ending; NOUN when nothing fits."""
    pos = None
    for tag, words in CLOSED_CLASSES.items():
        hit = word.isin(*words)
        pos = F.when(hit, F.lit(tag)) if pos is None else pos.when(hit, F.lit(tag))
    pos = pos.when(word == F.lit("n't"), F.lit("ADV"))
    pos = pos.when(word.rlike(NUMBER), F.lit("NUM"))
    for tag, endings in ENDINGS.items():
        for ending in endings:
            pos = pos.when(word.endswith(ending), F.lit(tag))
    return pos.otherwise(F.lit("NOUN"))


def rule_lemma(word: Column, whole: Iterable[str] = ()) -> Column:
    """Stem of a word; words in ``whole`` stay as they are, so that a stop word is still known as one."""
    whole = tuple(whole)
    return F.when(word.isin(*whole), word).otherwise(stem(word)) if whole else stem(word)


def rule_tagger(words: Column, whole: Iterable[str] = ()) -> Column:
    """Array of tokens -> array of (lemma, pos), by rules only."""
    whole = tuple(whole)
    return F.transform(words, lambda t: F.struct(rule_lemma(t, whole).alias("lemma"), rule_pos(t).alias("pos")))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words joined by a space.

    Pass a plain column: it is read once per place in the run.
    """
    runs = words
    for shift in range(1, n):
        following = F.slice(words, F.lit(shift + 1), F.greatest(F.size(words), F.lit(1)))
        runs = F.zip_with(runs, following, lambda run, word: F.concat(run, F.lit(" "), word))
    return runs if n == 1 else F.filter(runs, lambda run: run.isNotNull())


def safe_name(parts: Iterable[str | Column]) -> Column:
    """Lower-cased name with underscores for spaces, built from its parts."""
    joined = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.replace(F.lower(joined), F.lit(" "), F.lit("_"))
