"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word, and the words that carry no topic.
WORD = r"[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9_.+\-/]{2,}"
STOP = (
    "the", "and", "for", "with", "from", "that", "this", "into", "are", "was", "were", "not", "have", "has", "had", "its", "their", "about",
    "records", "record", "archive", "archived", "source", "metadata", "document", "documents", "page", "pages", "http", "https", "www", "gov", "com",
    "org", "pdf", "json", "html", "unidentified", "information", "report", "reports", "research", "official", "public", "collection", "data", "file",
    "files", "content", "title", "provider", "landing", "bulk", "download",
)
#: The stop words of the first form of the graph, a prefix of STOP.
STOP_V1 = STOP[: STOP.index("document")]
DATE = r"(?<![0-9A-Za-z_])(?:18|19|20)[0-9]{2}(?:-[0-9]{2}-[0-9]{2})?(?![0-9A-Za-z_])"
#: Cues of each state label.
STATES = {
    "HYPOTHESIS_OR_MODEL": ["hypothesis", "model", "possible mechanism", "may play a role", "possibility"],
    "EXPERIMENT_OR_TEST": ["experiment", "experimental", "test", "trial", "random number generator", "data set", "dataset"],
    "NEGATIVE_OR_LIMITATION": ["not confirmed", "not observed", "no evidence", "unreliable", "inconsistent", "premature", "problem", "critique", "failed"],
    "PROGRAM_OR_RESEARCH_PLAN": ["research plan", "program", "project", "contract", "final report", "progress report"],
    "PHYSICS_CONTEXT": ["relativity", "quantum", "electromagnetic", "wave function", "thermodynamics", "space time", "spacetime"],
    "INFORMATION_FLOW_CLAIM": ["information flow", "information transfer", "information leakage", "future to past", "precognition"],
    "RETROACTIVE_EFFECT_CLAIM": ["backward causation", "retroactive", "retro pk", "effect precedes the cause", "backwards in time"],
}
UNCLASSIFIED = "UNCLASSIFIED_CONTEXT"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column, stop: tuple[str, ...] = STOP, keep_digits: bool = False) -> Column:
    """Lower-cased words without stop words and, unless kept, without numbers. Null text gives null."""
    ok = lambda w: ~w.isin(*stop) & (F.lit(True) if keep_digits else ~w.rlike("^[0-9]+$"))
    return F.filter(F.transform(matches(text, WORD), F.lower), ok)


def word_counter(stop: tuple[str, ...] = STOP, keep_digits: bool = False) -> Callable[[str], dict[str, int]]:
    """How often a text has each of its tokens(), for tasks that have the text at hand."""
    find, dropped = re.compile(WORD).findall, frozenset(("", *stop))

    def count(text: str) -> dict[str, int]:
        found = Counter("\n".join(find(text)).lower().split("\n"))
        return {w: n for w, n in found.items() if w not in dropped and (keep_digits or not w.isdigit())}

    return count


def norm_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after case folding; the sharp s folds to two letters."""
    return matches(F.lower(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))), "[a-z0-9]+")


def normalized(text: Column) -> Column:
    return F.array_join(norm_tokens(text), " ")


def meaningful_tokens(text: Column, most: int = 12) -> Column:
    """The first distinct normalised tokens of at least three characters."""
    return F.slice(F.array_distinct(F.filter(norm_tokens(text), lambda w: F.length(w) >= 3)), 1, most)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dates(text: Column) -> Column:
    """Distinct years and ISO dates, sorted."""
    return F.array_sort(F.array_distinct(matches(text, DATE)))


def phrase_hit(normal: Column, phrase: Column) -> Column:
    """Whole-word phrase in a normalised text."""
    return F.contains(F.concat(F.lit(" "), normal, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def shingles(words: Column, n: int = 4) -> Column:
    """Distinct runs of n words; all words if there are fewer. words should be a column: an expression would run once for each word."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(words))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 when either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def state_labels(s: Column) -> Column:
    """Labels whose cues occur in a normalised text, in their fixed order, else UNCLASSIFIED. s should be a column."""
    hit = lambda cues: reduce(lambda x, y: x | y, [F.contains(s, F.lit(c)) for c in cues])
    found = F.array_compact(F.array(*[F.when(hit(cues), F.lit(name)) for name, cues in STATES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNCLASSIFIED)))


def slug(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), 1, most)


def normalize_doi(doi: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(doi)), "^(https?://)?(dx\\.)?doi\\.org/|^doi:\\s*", "")
    return F.when(F.length(out) > 0, out)


def resolve_path(column: Column, path: str) -> Column:
    """A dotted path into structs, maps and arrays (numeric parts index arrays from 0); null where it leads nowhere."""
    for part in path.split("."):
        column = F.get(column, F.lit(int(part))) if part.isdigit() else column.getField(part)
    return column


#: Metadata keys whose texts count as a record's own.
TEXT_KEYS = ("title", "scopeAndContentNote", "dateNote", "arrangement", "description", "subject", "otherTitles")
#: Topics and places that are looked for as substrings.
TOPICS = (
    "uap", "ufo", "tachyon", "tachyons", "retrocausality", "retrocausal", "precognition", "nuclear", "palomar", "star gate", "stargate",
    "remote viewing", "advanced potential", "reverse information", "future to past", "future-to-past",
)
PLACES = ("ukraine", "ukrainian", "kyiv", "kiev", "odesa", "odessa", "chernobyl", "palomar", "arizona", "colorado", "petrozavodsk", "ussr", "soviet")
#: Characters beyond which a file's text isn't looked at.
INSPECTED = 2_000_000


def text_of(title: Column, text: Column, agency: Column | None = None, tags: Column | None = None, metadata: Column | None = None) -> Column:
    """Title, text, agency, tags and the metadata's (a map's) own texts, joined by spaces; what is null counts as empty."""
    none = F.lit("")
    parts = [F.coalesce(title, none), F.coalesce(text, none), F.coalesce(agency, none) if agency is not None else none]
    parts.append(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ") if tags is not None else none)
    joined = F.concat_ws(" ", *parts)
    if metadata is None:
        return joined
    own = F.array_compact(F.array(*[F.when(F.length(metadata[k]) > 0, metadata[k]) for k in TEXT_KEYS]))
    return F.when(F.size(own) > 0, F.concat(joined, F.lit(" "), F.array_join(own, " "))).otherwise(joined)


def normalize_title(title: Column) -> Column:
    """Lower-case with single spaces; null counts as empty."""
    return F.lower(squeezed(F.coalesce(title, F.lit(""))))


def simple(title: Column) -> Column:
    """A title's letters a-z and digits alone."""
    return F.regexp_replace(normalize_title(title), "[^a-z0-9]+", "")


def search_query(topic: Column, field: str = "all") -> Column:
    """A search expression: the whole topic as a phrase, or all of its meaningful tokens; null for an empty topic."""
    phrase = F.replace(squeezed(topic), F.lit('"'), F.lit(""))
    words = meaningful_tokens(topic)
    every = F.array_join(F.transform(words, lambda w: F.concat(F.lit(f"{field}:"), w)), " AND ")
    quoted = F.concat(F.lit(f'{field}:"'), phrase, F.lit('"'))
    return F.when(squeezed(topic) == "", None).when(F.size(words) <= 1, quoted).otherwise(F.concat(F.lit("("), quoted, F.lit(" OR ("), every, F.lit("))")))


def entity_nodes(text: Column, tags: Column) -> Column:
    """Distinct (kind, value) of a text: topics and places by substring, dates, and its trimmed lower-case tags."""
    low = F.lower(text)
    found = [F.when(F.contains(low, F.lit(v)), F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"))) for k, own in (("topic", TOPICS), ("place", PLACES)) for v in own]
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    clean = F.array_remove(F.transform(tags, lambda t: F.lower(F.trim(t))), "")
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found)), named("date", dates(text)), named("tag", clean))))


def inspected(text: Column, most: int = INSPECTED) -> Column:
    """Whether a text is short enough to be looked at; a longer one keeps its provenance row alone."""
    return F.coalesce(F.octet_length(text) <= most, F.lit(True))
