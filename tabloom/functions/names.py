"""Rules for column names."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a word ends inside a name (before a capitalised word, and between a small letter or digit and a
# capital), and what is no part of a word.
WORD_BREAK = r"(?<=.)(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])"
NOT_IN_WORDS = r"[^\w\s]"
BETWEEN_WORDS = r"[\s_]+"


def snake(name: str) -> str:
    """The words of a name in lower case, joined by underscores; punctuation is dropped."""
    words = re.split(BETWEEN_WORDS, re.sub(NOT_IN_WORDS, "", re.sub(WORD_BREAK, " ", name.strip())))
    return "_".join(w.lower() for w in words if w)


def snake_column(name: Column) -> Column:
    """:func:`snake` of a text column."""
    spaced = F.regexp_replace(F.regexp_replace(F.trim(name), WORD_BREAK, " "), NOT_IN_WORDS, "")
    return F.array_join(F.filter(F.split(F.lower(spaced), BETWEEN_WORDS), lambda w: w != ""), "_")


def number_repeats(names: Sequence[str], fold: Callable[[str], str] = str) -> list[str]:
    """Append ``_1``, ``_2`` ... to the second and later of names that ``fold`` makes equal."""
    places = defaultdict(list)
    for i, name in enumerate(names):
        places[fold(name)].append(i)
    nth = {i: n for spots in places.values() for n, i in enumerate(spots) if n}
    return [f"{name}_{nth[i]}" if i in nth else name for i, name in enumerate(names)]
