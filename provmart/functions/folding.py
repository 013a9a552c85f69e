"""Case and accent folding of any script in the JVM.

What a code point folds to - its compatibility decomposition without combining marks, case
folded - depends on nothing around it, so a fold is a table.  Most entries are one character or
none and are one ``translate``.  The others (Hangul, ligatures, fractions) become a mark there;
only a text in which the mark shows is gone through character by character.  The table is made from
Python's Unicode data.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A private character; a text that holds it itself only takes the slower way.
MARK = ""
#: Longer entries that are frequent in prose, replaced before the table is looked at.
FREQUENT = "ßẞ…™ﬁﬂ"


def folded(text: str) -> str:
    """The fold of a Python string, which the expressions equal."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


@lru_cache(1)
def table() -> tuple[dict[str, str], dict[str, str]]:
    """Code points that fold to one character or none, and those that fold to more."""
    short, long = {}, {}
    for i in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(i)
        if (f := folded(c)) != c:
            (short if len(f) < 2 else long)[c] = f
    return short, long


def _translated(text: Column, entries: dict[str, str]) -> Column:
    """One character or none for each entry; what has no counterpart at the end of ``translate``'s lists is deleted."""
    order = sorted(entries, key=lambda c: (not entries[c], c))
    return F.translate(text, "".join(order), "".join(entries[c] for c in order))


def _pieces(char: Column, entries: dict[str, str], most: int) -> Column:
    """Up to ``most`` characters for one: the first of its fold, the second, ..."""
    return F.concat(*[_translated(char, {c: f[k : k + 1] for c, f in entries.items()}) for k in range(most)])


def fold(text: Column) -> Column:
    """Decomposed, without combining marks, case folded; null stays null."""
    short, long = table()
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(long[x])), FREQUENT, text)
    quick = _translated(plain, short | dict.fromkeys(long, MARK))
    few, many = ({c: f for c, f in long.items() if (len(f) > 3) == more} for more in (False, True))

    def one(char: Column) -> Column:
        held = lambda entries: F.translate(char, "".join(entries), "") == ""
        return F.when(held(few), _pieces(char, few, 3)).when(held(many), _pieces(char, many, max(map(len, many.values())))).otherwise(_translated(char, short))

    slow = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")
    wide = F.when(quick.contains(MARK), slow).otherwise(quick)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(wide)


# --- literals at word starts ---------------------------------------------------


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _trie(patterns: Sequence[str]) -> str:
    """A regular expression for the longest of some literals at a place: alternatives part where their characters do."""
    starts: dict[str, list[str]] = {}
    for p in patterns:
        if p:
            starts.setdefault(p[0], []).append(p)
    ways = []
    for own in starts.values():
        k = 1
        while all(len(p) > k and p[k] == own[0][k] for p in own):
            k += 1
        ways.append(_escaped(own[0][:k]) + _trie([p[k:] for p in own]))
    if not ways:
        return ""
    optional = "" in patterns
    return ways[0] if len(ways) == 1 and not optional else f"(?:{'|'.join(ways)})" + ("?" if optional else "")


def found_literals(text: Column, patterns: Sequence[str]) -> Column:
    """The longest of the literals at every word start of a (folded) text, each once: one pass for any number of them.

    At a word start the expression goes down one trie, so a thousand literals cost what ten do.
    """
    known = sorted(set(patterns))
    if not known or "" in known:
        raise ValueError("literals must not be empty")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b(?=({_trie(known)}))"), F.lit(1)))


def meant(patterns: Sequence[str]) -> dict[str, list[str]]:
    """By literal: the literals that are there when it is the longest one found."""
    known = set(patterns)
    return {p: [p[:k] for k in range(1, len(p) + 1) if p[:k] in known] for p in sorted(known)}
