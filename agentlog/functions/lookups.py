"""Small column helpers on fixed vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentlog.functions import dictionaries as fixed


def lookup(col: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of a literal map; the map is folded into the plan, so there is no join."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.element_at(entries, col)
    return found if default is None else F.coalesce(found, F.lit(default))


def any_contains(text: Column, tokens: Iterable[str]) -> Column:
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.contains(token)
    return hit


# The white space of Unicode, with the four ASCII separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column | str) -> Column:
    """The text without white space at its ends."""
    return F.trim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def nonblank_or(text: Column, *others: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (text, *others)])


def folded(text: Column) -> Column:
    """Lower case, with the four non-ASCII letters that count as i, s and k when case is ignored."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, split at the ``|`` outside of groups."""
    parts, depth = [""], 0
    for piece in re.findall(r"\\.|.", pattern):
        depth += {"(": 1, ")": -1}.get(piece, 0)
        if piece == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def _literals(alternative: str) -> list[str]:
    """Runs of plain characters every match must contain, longest first."""
    no_groups = re.sub(r"\((?!\\)[^()]*\)(?<!\\\))", "\n", re.sub(r"\\[(]", "\x00", alternative))
    runs = re.split(r"\\[a-zA-Z][*+?]?|\[[^\]]*\][*+?]?|.[*?]|[\^$.+\n]", re.sub(r"\\([^a-zA-Z])", r"\1", no_groups.replace("\\.", "\x01")))
    plain = [r.replace("\x00", "(").replace("\x01", ".") for r in runs]
    return sorted((r for r in plain if r), key=len, reverse=True)


def search(text: Column, pattern: str) -> Column:
    """Case-insensitive search of a lower-case pattern in ``folded`` text; ``.`` stops at a line feed only and classes
    are those of Unicode. Patterns may use groups, classes, ``* + ?`` and escapes, but no counted repeats.

    Plain phrases become substring tests, and each remaining expression runs only on rows that hold its longest plain
    part, which is far cheaper than a case-insensitive regular expression on every row.
    """
    if re.search(r"(?<!\\)[{}]|\(\?", pattern):
        raise ValueError(f"unsupported pattern: {pattern}")
    hit = None
    for alternative in _alternatives(pattern):
        literals = _literals(alternative)
        unescaped = re.sub(r"\\([^a-zA-Z])", r"\1", alternative)
        if literals and literals[0] == unescaped:
            test = text.contains(unescaped)
        else:
            test = text.rlike("(?dU)" + alternative)
            if literals:
                test = text.contains(literals[0]) & test
        hit = test if hit is None else hit | test
    return hit


def legacy_type(subtype: Column) -> Column:
    """Anomaly type of a finding subtype, NULL where there is none."""
    return lookup(subtype, fixed.SUBTYPE_TYPES)


def tool_domain(tool: Column) -> Column:
    return lookup(tool, fixed.TOOL_DOMAIN)


def intent_domain(intent: Column, hints: Mapping[str, Iterable[str]]) -> Column:
    """First domain, in the order given, one of whose hints occurs in the text."""
    lowered = F.lower(intent)
    return F.coalesce(*[F.when(any_contains(lowered, tokens), domain) for domain, tokens in hints.items()])


def label_score(label: Column) -> Column:
    return lookup(F.lower(label), fixed.LABEL_SCORES, 0.0)


def recommended_action(subtype: Column) -> Column:
    return lookup(subtype, fixed.ACTIONS, fixed.DEFAULT_ACTION)


def dup_ngram_ratio(text: Column, n: int = 3, min_words: int = 8) -> Column:
    """Share of repeated word n-grams; 0 for fewer than min_words words."""

    def join(a: Column, b: Column) -> Column:
        return F.concat_ws(" ", a, b)

    def ratio(words: Column) -> Column:
        # n shifted copies of the list, joined position by position: linear in the number of words.
        length = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, F.lit(1), length)
        for shift in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(words, F.lit(shift), length), join)
        return F.when(F.size(words) < min_words, F.lit(0.0)).otherwise(
            F.element_at(F.transform(F.array(grams), _repeated_share), 1)
        )

    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    # The one-element transforms name an array, so that it is built once and not at each mention.
    return F.element_at(F.transform(F.array(words), ratio), 1)


def _repeated_share(grams: Column) -> Column:
    return F.lit(1.0) - F.size(F.array_distinct(grams)) / F.size(grams)
