"""Text scalars as Column expressions; all stay inside the JVM.

The patterns are portable between Java and RE2, so that SQL can check them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"\p{Nd}|[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{N}_\s\p{Z}\x{85}]"
WORD_PATTERN = r"[^\s\p{Z}\x{85}]+"
TERM_PATTERN = "[a-z0-9]+"
NUMBER_PATTERN = r"[0-9][0-9,]*(?:\.[0-9]+)?"
VERSION_PATTERN = r"\b[0-9]+\.[0-9]+(?:\.[0-9]+)*\b"
SECTION_NUMBER = r"^[0-9]+(?:\.[0-9]+)*\.?\s+"
TITLE_SUFFIX = r"(?i)\s+[—–-]\s+(?:Updated|New in Version [0-9]+(?:\.[0-9]+)*)$"

# Words that carry no meaning for lexical search. Negations are kept.
STOPWORDS = (
    "a an the and or but if then else when while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further once here there "
    "all any both each few more most other some such only own same so than too very can will just should could "
    "would may might must shall do does did doing is am are was were be been being have has had having this that "
    "these those it its i me my we our you your he she they them their what which who whom how where why as"
).split()
# Words that do not count when two claims are compared.
CLAIM_STOPWORDS = (
    "a an the of to for and or in on at by with from that this is are was be been it its their they who when "
    "should must may will can into upon than any no not"
).split()
# Number words.
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15",
    "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30",
    "forty": "40", "fifty": "50", "sixty": "60", "hundred": "100", "thousand": "1000", "million": "1000000",
}
# Wording of change, of its absence, and of changed amounts.
CHANGE = r"(?i)\b(?:chang\w*|increas\w*|reduc\w*|decreas\w*|remov\w*|added|addition\w*|new|newly|no longer|previous\w*|now|used to|instead of|replac\w*|version \d+)\b"
ASSERTED_CHANGE = r"(?i)\b(?:chang\w*|increas\w*|decreas\w*|reduc\w*|rais\w*|lower\w*|added|remov\w*|replac\w*|extend\w*|shorten\w*|no longer)\b"
NO_CHANGE = r"(?i)\b(?:unchanged|not chang\w*|no change\w*|did not change|remain\w*|same|both versions)\b"
AMOUNT_CHANGE = r"(?i)\b(?:increas\w*|decreas\w*|reduc\w*|rais\w*|lower\w*|extend\w*|shorten\w*)\b"


def every_match(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """A token for each run of letters, each digit and each mark; underscores count for nothing."""
    return F.size(every_match(text, TOKEN_PATTERN))


def word_count(text: Column) -> Column:
    return F.size(every_match(text, WORD_PATTERN))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits without stopwords, repeats kept."""
    return F.filter(every_match(F.lower(text), TERM_PATTERN), lambda w: ~w.isin(STOPWORDS))


def plain(text: Column) -> Column:
    """Lower-case ASCII words joined by single spaces."""
    return F.array_join(every_match(F.lower(text), TERM_PATTERN), " ")


def has_phrase(haystack: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def with_period(text: Column) -> Column:
    """One closing period unless ``.?!`` closes already; trailing commas, semicolons and colons go."""
    stripped = strip(text)
    bare = strip(F.regexp_replace(stripped, r"[,;:]+\z", ""))
    closed = lambda c: (c == "") | c.rlike(r"[.?!]\z")
    return F.when(closed(stripped), stripped).when(closed(bare), bare).otherwise(F.concat(bare, F.lit(".")))


def numbers(text: Column, words: bool = False) -> Column:
    """Distinct digit groups without thousands separators, sorted; number words too where asked for."""
    found = F.transform(every_match(text, NUMBER_PATTERN), lambda x: F.replace(x, F.lit(",")))
    if words:
        known = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
        spelled = F.filter(every_match(F.lower(text), "[a-z]+"), lambda w: w.isin(list(NUMBER_WORDS)))
        found = F.concat(found, F.transform(spelled, lambda w: F.element_at(known, w)))
    return F.array_sort(F.array_distinct(found))


def has_negation(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike("n['’]t") | F.arrays_overlap(every_match(low, TERM_PATTERN), F.array(*map(F.lit, ["no", "not", "cannot", "never"])))


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(every_match(F.lower(text), TERM_PATTERN), lambda w: ~w.isin(CLAIM_STOPWORDS)))


def same_claim(left: dict[str, Column], right: dict[str, Column], overlap: float = 0.8) -> Column:
    """Equal numbers and negation, and content words that overlap by Jaccard. Sides: ``numbers, negated, content``."""
    union = F.size(F.array_union(left["content"], right["content"]))
    shared = F.size(F.array_intersect(left["content"], right["content"]))
    alike = F.when(union == 0, True).otherwise(shared >= F.lit(overlap) * union - 1e-9)
    return (left["numbers"] == right["numbers"]) & (left["negated"] == right["negated"]) & alike


def asserts_change(text: Column) -> Column:
    return text.rlike(ASSERTED_CHANGE) & ~text.rlike(NO_CHANGE)


def has_change_language(text: Column, own_version: Column | None = None) -> Column:
    """Change wording, where a mention of the passage's own version doesn't count."""
    if own_version is not None:
        own = F.concat(F.lit(r"(?i)\bversion\s+"), F.replace(own_version, F.lit("."), F.lit("\\.")), F.lit(r"\b"))
        text = F.regexp_replace(text, own, F.lit(""))
    return text.rlike(CHANGE)


def contradicted_change(claim: Column, cited: Column, other: Column, versions: Column) -> Column:
    """Why a claim of change is contradicted by its two passages, or null; labels of ``versions`` are no numbers."""
    amounts = lambda text: F.array_except(numbers(text), versions)
    same_numbers = claim.rlike(AMOUNT_CHANGE) & (F.size(amounts(cited)) > 0) & (amounts(cited) == amounts(other))
    reason = F.when(plain(cited) == plain(other), "both versions have the same text").when(same_numbers, "both versions give the same numbers")
    return F.when(other.isNotNull() & asserts_change(claim), reason)


def normalize_title(path: Column) -> Column:
    """Parts of a heading path without section numbers and version suffixes, in lower case."""
    part = lambda p: F.lower(F.trim(F.regexp_replace(F.regexp_replace(p, SECTION_NUMBER, ""), TITLE_SUFFIX, "")))
    return F.array_join(F.transform(F.split(path, " > "), part), " > ")


def section_label(path: Column) -> Column:
    """The same parts with their case, without empty ones."""
    part = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, SECTION_NUMBER, ""), TITLE_SUFFIX, ""))
    return F.array_join(F.filter(F.transform(F.split(path, " > "), part), lambda p: p != ""), " > ")


def escape(text: Column, quotes: bool = False) -> Column:
    """HTML escapes; the ampersand goes first."""
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quotes else []):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def source_tag(chunk_id: Column, policy: Column, version: Column, path: Column, text: Column) -> Column:
    """A passage in a tag that its text can't close."""
    named = [("id", chunk_id), ("policy", policy), ("version", version), ("section", path)]
    attributes = [F.concat(F.lit(f'{name}="'), escape(value, quotes=True), F.lit('"')) for name, value in named]
    return F.concat(F.lit("<source "), F.concat_ws(" ", *attributes), F.lit(">\n"), escape(text), F.lit("\n</source>"))


SENTENCE_BREAK = "(?U)(?<=[.!?])(?<!(?i:e\\.g\\.|i\\.e\\.|etc\\.|vs\\.|no\\.))\\s+(?=[A-Z0-9\"“'‘])"


def sentences(text: Column) -> Column:
    """Cut after ``.?!`` before white space and a capital, digit or opening quote, but not after an abbreviation."""
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")
