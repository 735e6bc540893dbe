"""Column expressions for cleaning, normalising and locating texts.

All of them are built-in Spark expressions: they stay inside whole-stage codegen
and run on the executors. A null input gives a null output unless said otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
CLASS_TARGETS = {"ADE": "adverse event problem", "NoADE": "healthy okay"}
CLASS_PREFIX = "assert ade"
SPAN_PREFIX = "ner ade"
NEGATIVE_SPAN = "none"
NEGATIVE_CLASS_TEXT = "healthy okay"
POSITIVE_CLASS_TEXT = "adverse event problem"
DEFAULT_CLASS_LABEL = "NoADE"
SPAN_SEPARATOR = "; "
INPUT_SEPARATOR = ": "
# Our URL pattern (narrower than the tweet-cleaning library's): scheme or www up to
# the next whitespace character.
URL_PATTERN = r"(?i)\b(?:https?://|www\.)[^ \t\n\r\f\x0B]+"
# The same matches for Java's engine: only at an h or a w is the word boundary looked at.
URL_PATTERN_JAVA = URL_PATTERN.replace(r"\b", r"(?=[hw])\b")
# Whitespace that is collapsed after URL removal (explicit, so that Java and RE2 agree).
WHITESPACE_RUN = r"[ \t\n\r\f\x0B]+"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def strip_dots(c) -> Column:
    """Python ``s.strip('.')``: every leading and trailing dot, no whitespace."""
    return F.btrim(_c(c), F.lit("."))


def normalise_prediction(c, lower: bool = True) -> Column:
    """Strip dots, and lower-case for the ensemble."""
    out = strip_dots(c)
    return F.lower(out) if lower else out


def fill_label(c, default: str) -> Column:
    """B1: a missing label becomes the default class."""
    return F.coalesce(_c(c), F.lit(default))


def map_target(c, mapping: Mapping[str, str] | str | None, strict: bool = True) -> Column:
    """Label → target text through a dict; a non-dict mapping keeps the label.

    ``strict`` raises on a label that the dict does not hold, as a dict lookup does.
    """
    if not isinstance(mapping, Mapping):
        return _c(c)
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    looked = F.try_element_at(F.create_map(*pairs), _c(c))
    if not strict:
        return looked
    return F.coalesce(looked, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(_c(c).cast("string"), F.lit("NULL")))))


def emoji_pattern(emoji: Iterable[str]) -> str:
    """One pattern that matches the longest sequence of the table at each place.

    Sequences are grouped by their first code point and stand longest first, behind a look
    at the first code point: its range, then the class (a class tests its members one by one),
    so ordinary characters are passed by with one comparison.
    """

    def quoted(code_points: str) -> str:
        return "".join(f"\\x{{{ord(ch):X}}}" for ch in code_points)

    rest: dict[str, list[str]] = {}
    for e in emoji:
        rest.setdefault(e[0], []).append(e[1:])
    groups = []
    for first, tails in sorted(rest.items()):
        longer = "|".join(quoted(t) for t in sorted(tails, key=lambda t: (-len(t), t)))
        groups.append(quoted(first) + (f"(?:{longer})" if longer else ""))
    firsts = "".join(quoted(f) for f in sorted(rest))
    return f"(?=[{quoted(min(rest))}-{quoted(max(rest))}])(?=[{firsts}])(?:{'|'.join(groups)})"


def demojize(c, emoji_pairs: Iterable[tuple[str, str]]) -> Column:
    """Every emoji sequence → ``:name:``, the longest sequence at each place from the left.

    ``emoji_pairs`` is the (emoji, name) lookup table (library data, a bounded list). The text
    is cut at the matches of one pattern, their names come from a constant map, and the pieces
    are put together again: the expression is as deep for thousands of emoji as for one.
    """
    names = {e: f":{name}:" for e, name in emoji_pairs if e}
    text = _c(c)
    if not names:
        return text
    pattern = emoji_pattern(names)
    # one JSON constant, folded to a map once, instead of two literals for each entry
    table = F.from_json(F.lit(json.dumps(names, ensure_ascii=False)), "map<string,string>")
    named = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda e: F.try_element_at(table, e))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), named.alias("name"))
    joined = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["name"], F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def strip_urls(c) -> Column:
    """Remove URLs, collapse whitespace runs to one space, trim."""
    no_url = F.regexp_replace(_c(c), URL_PATTERN_JAVA, "")
    return F.trim(F.regexp_replace(no_url, WHITESPACE_RUN, " "))


def strip_underscores(c) -> Column:
    """Remove every run of underscores (also inside words and emoji names)."""
    return F.replace(_c(c), F.lit("_"), F.lit(""))


def clean_text(c, emoji_pairs: Iterable[tuple[str, str]] = ()) -> Column:
    """Demojize → strip URLs → strip underscores."""
    return strip_underscores(strip_urls(demojize(c, emoji_pairs)))


def model_input(prefix, input_text, sep: str = INPUT_SEPARATOR) -> Column:
    """``prefix + sep + input_text`` (null-propagating concat)."""
    return F.concat(_c(prefix), F.lit(sep), _c(input_text))


def unwrap_prompt(c, marker) -> Column:
    """Marker present (case-sensitive) → remove every occurrence and strip dots; else ``none``."""
    m = marker if isinstance(marker, Column) else F.lit(marker)
    return F.when(F.contains(_c(c), m), strip_dots(F.replace(_c(c), m, F.lit("")))).otherwise(F.lit(NEGATIVE_SPAN))


def binarise(c) -> Column:
    """``healthy okay`` → NoADE; anything else (also null or garbage) → ADE."""
    return F.when(_c(c).eqNullSafe(NEGATIVE_CLASS_TEXT), F.lit("NoADE")).otherwise(F.lit("ADE"))


def span_start(text, span) -> Column:
    """0-based first case-insensitive occurrence, -1 if absent, 0 for an empty span."""
    return (F.instr(F.lower(_c(text)), F.lower(_c(span))) - F.lit(1)).cast("int")


def span_end(text, span) -> Column:
    """Start + span length (code points)."""
    return (span_start(text, span) + F.length(_c(span))).cast("int")


def split_spans(c) -> Column:
    """Lower-case; ``none`` (or null) → empty list, else split on ``'; '`` keeping empty parts."""
    low = F.lower(_c(c))
    return F.when(low.isNull() | (low == F.lit(NEGATIVE_SPAN)), F.array().cast("array<string>")).otherwise(
        F.split(low, SPAN_SEPARATOR, -1)
    )


def has_span(c) -> Column:
    """The text is not ``none`` (null-safe: a null counts as having one, as pandas ``!=``)."""
    return ~_c(c).eqNullSafe(F.lit(NEGATIVE_SPAN))


def label_name(target, task: str = "span") -> Column:
    """Balancing label; spans → ``ade`` / ``none``, classes → the target text."""
    if task == "span":
        return F.when(has_span(target), F.lit("ade")).otherwise(F.lit(NEGATIVE_SPAN))
    return _c(target)


def word_count(c) -> Column:
    """Whitespace-token count (0 for a blank text), as ``len(s.split())``."""
    t = F.trim(F.regexp_replace(_c(c), WHITESPACE_RUN, " "))
    return F.when(t == F.lit(""), F.lit(0)).otherwise(F.size(F.split(t, " ", -1)))


# The tasks, and the prefix of a classification run's name.
CLASSIFICATION, DETECTION = "classification", "detection"
CLASS_RUN_PREFIX = "assert"


def task_of(run: str) -> str:
    """A5 for one run name: prefix ``assert`` = classification, else extraction."""
    return CLASSIFICATION if run.startswith(CLASS_RUN_PREFIX) else DETECTION


def run_task(run) -> Column:
    """A5 as a column over run names (``task_of`` for one name)."""
    is_class = F.startswith(_c(run), F.lit(CLASS_RUN_PREFIX))
    return F.when(is_class, F.lit(CLASSIFICATION)).otherwise(F.lit(DETECTION))


def run_model(run) -> Column:
    """A5: model name: every ``ner_`` (extraction runs) or ``assert_`` (classification runs) removed."""
    r = _c(run)
    return (
        F.when(F.startswith(r, F.lit("ner")), F.replace(r, F.lit("ner_"), F.lit("")))
        .when(F.startswith(r, F.lit("assert")), F.replace(r, F.lit("assert_"), F.lit("")))
        .otherwise(r)
    )
