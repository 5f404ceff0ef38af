"""Phrase search with negation, as Spark SQL expressions.

The functions take and return SQL text; ``F.expr`` makes Columns of it.
"""

from __future__ import annotations

from govaudit.catalog import NEGATORS
from govaudit.functions.sqltext import any_of, bind, text, texts

# White space and the punctuation stripped from a word before it is compared.
WHITESPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
PUNCTUATION = ".,;:\"'()"
LOOK_BACK_CHARS, LOOK_BACK_WORDS = 50, 6


def contains_any(value: str, needles: list[str]) -> str:
    return any_of(f"contains({value}, {text(n)})" for n in needles)


def _pieces(value: str, phrase: str) -> str:
    if not phrase:
        raise ValueError("empty phrase")
    if any(phrase.startswith(phrase[i:]) for i in range(1, len(phrase))):
        # split() would skip an occurrence that overlaps the one before it
        raise ValueError(f"phrase {phrase!r} can overlap itself")
    return f"split({value}, {text(chr(92) + 'Q' + phrase + chr(92) + 'E')}, -1)"


def _asserted_at(pieces: str, index: str, phrase: str, negators: list[str]) -> str:
    """Is there no negator among the last words before the occurrence?

    Only as many neighbouring pieces are joined as can reach into the 50
    characters before it, so a text with n occurrences costs O(n), not O(n^2).
    """
    reach = LOOK_BACK_CHARS // len(phrase) + 2
    before = (f"right(array_join(slice({pieces}, greatest(1, {index} - {reach - 1}), least({index}, {reach})), "
              f"{text(phrase)}), {LOOK_BACK_CHARS})")
    return free_of_negators(before, negators)


def free_of_negators(before: str, negators: list[str] = NEGATORS) -> str:
    """Is there no negator among the last words of what stands before?"""
    words = f"filter(split({before}, {text(WHITESPACE)}), w -> w <> '')"
    bare = (f"transform(slice(ws, greatest(1, size(ws) - {LOOK_BACK_WORDS - 1}), {LOOK_BACK_WORDS}), "
            f"w -> btrim(w, {text(PUNCTUATION)}))")
    return bind(words, "ws", f"NOT arrays_overlap({bare}, {texts(negators)})")


def no_negator_in(before: str, negators: list[str] = NEGATORS) -> str:
    """``free_of_negators`` as one regular expression, where the negators are plain words: several times as fast."""
    if not negators or any(not n or n[0] in PUNCTUATION or n[-1] in PUNCTUATION or any(c.isspace() for c in n) or "\\E" in n for n in negators):
        return free_of_negators(before, negators)
    space, mark = WHITESPACE[:-1], f"[{PUNCTUATION}]*"
    negator = "|".join(f"\\Q{n}\\E" for n in negators)
    return f"NOT {before} RLIKE {text(f'(?:^|{space}){mark}(?:{negator}){mark}(?:{space}+[^{space[1:]}+){{0,{LOOK_BACK_WORDS - 1}}}{space}*' + chr(92) + 'z')}"


def occurrences(value: str, phrase: str) -> str:
    """How often the phrase occurs in the whole text."""
    return f"(size({_pieces(value, phrase)}) - 1)"


def asserted_occurrences(value: str, phrase: str, negators: list[str] = NEGATORS) -> str:
    """How many occurrences have no negator among the six words before."""
    free = f"filter(sequence(1, size(ps) - 1), i -> {_asserted_at('ps', 'i', phrase, negators)})"
    return bind(_pieces(value, phrase), "ps", f"CASE WHEN size(ps) > 1 THEN size({free}) ELSE 0 END")


def asserts(value: str, phrase: str, negators: list[str] = NEGATORS) -> str:
    """Does at least one occurrence of the phrase stand un-negated?

    The cheap ``contains`` test runs first, so texts without the phrase never
    enter the array expressions.
    """
    found = f"exists(sequence(1, size(ps) - 1), i -> {_asserted_at('ps', 'i', phrase, negators)})"
    return (f"CASE WHEN contains({value}, {text(phrase)}) THEN {bind(_pieces(value, phrase), 'ps', found)} "
            "ELSE false END")
