"""A tokenizer that cuts words at the terms of a user dictionary.

Inflected words carry particles, so a term of the curriculum seldom stands alone.  Each word
that may be cut is a lattice: from every character, edges lead along the terms that begin
there (found in a trie) and one edge leads over the character itself.  The best path leaves
the fewest characters outside terms and, among those, uses the fewest terms; where several
are left, the longest term goes first.  Stretches outside terms become tokens of their own,
unless they are particles or a single character.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import ColumnLike, col
from curricle.functions.tokens import Tokenizer, tokenize

# the lattice travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The dictionary is broadcast whole, so its size is bounded.
MOST_BYTES = 32 << 20
_END = ""


def build_trie(terms: Iterable[str]) -> dict:
    trie: dict = {}
    for term in terms:
        node = trie
        for char in term:
            node = node.setdefault(char, {})
        node[_END] = True
    return trie


def best_path(word: str, trie: dict) -> list[tuple[int, int, bool]]:
    """``(start, end, is_term)`` of the pieces of a word, in order."""
    n = len(word)
    rest: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # characters outside terms, number of terms
    step = [0] * n
    for i in range(n - 1, -1, -1):
        outside, terms = rest[i + 1]
        best, length = (outside + 1, terms), 0
        node = trie
        for j in range(i, n):
            node = node.get(word[j])
            if node is None:
                break
            if _END in node:
                outside, terms = rest[j + 1]
                if (outside, terms + 1) <= best:
                    best, length = (outside, terms + 1), j + 1 - i
        rest[i], step[i] = best, length
    pieces, i = [], 0
    while i < n:
        if step[i]:
            pieces.append((i, i + step[i], True))
            i += step[i]
        else:
            begin = i
            while i < n and not step[i]:
                i += 1
            pieces.append((begin, i, False))
    return pieces


def dictionary_tokenizer(
    terms: DataFrame,
    base: Tokenizer = tokenize,
    may_cut: str = fv.HANGUL,
    particles: Iterable[str] = fv.PARTICLES,
    stop_words: Iterable[str] = fv.STOP_WORDS,
) -> Tokenizer:
    """A tokenizer usable wherever ``tokenize`` is, fed by a table of terms (``term``).

    ``base`` finds the words; those that match ``may_cut`` and hold a term of two characters
    or more are cut.  Terms are compared in lower case; null terms are left out.
    """
    lowered = terms.select(F.lower("term").alias("term")).filter(F.length("term") >= 2).distinct()
    size = lowered.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the dictionary has {size} bytes; at most {MOST_BYTES} are sent to the workers")
    shared = terms.sparkSession.sparkContext.broadcast([r.term for r in lowered.collect()])
    allowed, dropped = re.compile(may_cut), frozenset([*particles, *stop_words])

    def cut(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, known = build_trie(shared.value), {}

        def pieces(word: str) -> list[str]:
            if not allowed.search(word):
                return [word]
            path = best_path(word, trie)
            if not any(is_term for _, _, is_term in path):
                return [word]
            parts = [(word[a:b], is_term) for a, b, is_term in path]
            return [p for p, is_term in parts if is_term or (len(p) > 1 and p not in dropped)]

        for batch in words:
            rows = []
            for row in batch.to_pylist():
                found = None if row is None else []
                for word in row or ():
                    if word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[word] = pieces(word)
                    found.extend(known[word])
                rows.append(found)
            yield pa.array(rows, pa.list_(pa.string()))

    cut.__annotations__ = {"words": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(cut, "array<string>")

    def tokens(c: ColumnLike) -> Column:
        return udf(base(col(c)))

    return tokens
