"""Byte-level BPE by a depth-first walk over the trie of the distinct words.

A word's encoding is fixed by the last token of each of its prefixes: a token t may end
the prefix p if the prefix without t ends with a token s such that the pair (s, t) encodes
to itself.  Exactly one token does.  So the state of a trie node is one token, and words
that share a prefix share the states above: they are computed once.

The trie is kept as the sorted list of distinct words.  Sorted order is its depth-first
order and the common prefix with the word before says where a new branch leaves the path,
so states live in one list that is cut back to the branch.  Only tokens that do end at a
place are tried there, longest first: an automaton over all tokens names them.

Each task walks the trie of the words of its batch that it has not seen lately; memory is
bounded by a batch and `memory_words` remembered words.  There is no shuffle.  Texts are
cut into words as the vocabulary's own library does, the special token's string included.

Null and empty texts have no tokens; a word of any length takes time in proportion to its
length; repeated rows are encoded alike; other columns are ignored or carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: how text is cut before the merges.  White space is Unicode's, without the
#: separators 1C-1F that Python adds.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Words that a task remembers with their encoding.
MEMORY_WORDS = 300_000


def _byte_of_character() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(byte): byte for byte in plain}
    others = [byte for byte in range(256) if byte not in set(plain)]
    return table | {chr(256 + k): byte for k, byte in enumerate(others)}


def merged(text: bytes, rank_of: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Plain merging, for the few bytes of a token or a pair of tokens."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        ranks = [rank_of.get(pair) for pair in zip(parts, parts[1:], strict=False)]
        known = [rank for rank in ranks if rank is not None]
        if not known:
            break
        at = ranks.index(min(known))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass(frozen=True)
class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file.

    id_of leaves out tokens that merging never makes of their bytes; they end no prefix.
    """

    id_of: dict[bytes, int]
    rank_of: dict[tuple[bytes, bytes], int]
    specials: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, byte = content["model"], _byte_of_character()
        raw = lambda token: bytes(byte[c] for c in token)
        specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank_of = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        tokens = {raw(t): i for t, i in model["vocab"].items() if t not in specials}
        made = {t: i for t, i in tokens.items() if merged(t, rank_of) == [t]}
        return Vocabulary(made, rank_of, specials)


class Suffixes:
    """Which tokens end at a place of a path: an automaton over the bytes of all tokens.

    A state is the longest end of the path that begins some token.  `longest` gives the
    longest token that ends there, `shorter` the next one that ends it, -1 if there is none.
    """

    def __init__(self, id_of: dict[bytes, int]):
        self.goto: dict[int, int] = {}  # state << 8 | byte
        parents, own = [(0, 0)], [-1]
        for token, number in id_of.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                if key not in self.goto:
                    self.goto[key] = len(own)
                    parents.append((state, byte))
                    own.append(-1)
                state = self.goto[key]
            own[state] = number
        depth = [0] * len(own)
        for state in range(1, len(own)):
            depth[state] = depth[parents[state][0]] + 1
        self.fail, self.longest = [0] * len(own), [-1] * len(own)
        self.shorter = [-1] * (max(id_of.values(), default=-1) + 1)
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            above, byte = parents[state]
            fail = 0
            while above:
                above = self.fail[above]
                found = self.goto.get(above << 8 | byte)
                if found is not None:
                    fail = found
                    break
            self.fail[state] = fail
            if own[state] < 0:
                self.longest[state] = self.longest[fail]
            else:
                self.longest[state] = own[state]
                self.shorter[own[state]] = self.longest[fail]

    def as_plain(self) -> tuple:
        """What a broadcast carries: built-in types, which every worker can read."""
        return self.goto, self.fail, self.longest, self.shorter


class TrieEncoder:
    """Encodes sets of words; remembers which pairs of tokens fit together."""

    def __init__(
        self, vocabulary: Vocabulary, suffixes: tuple | None = None, memory_pairs: int = 1_000_000
    ):
        self.vocabulary = vocabulary
        goto, self.fail, self.longest, self.shorter = suffixes or Suffixes(vocabulary.id_of).as_plain()
        self.bytes_of = {i: t for t, i in vocabulary.id_of.items()}
        self.sizes = [0] * len(self.shorter)
        for token, number in vocabulary.id_of.items():
            self.sizes[number] = len(token)
        self.memory_pairs = memory_pairs
        self.pairs: dict[int, bool] = {}
        self.given, self.goto = goto, dict(goto)

    def _fits(self, before: int, token: int) -> bool:
        if len(self.pairs) >= self.memory_pairs:
            self.pairs.clear()
        pair = [self.bytes_of[before], self.bytes_of[token]]
        fits = merged(pair[0] + pair[1], self.vocabulary.rank_of) == pair
        self.pairs[before << 32 | token] = fits
        return fits

    def _step(self, state: int, byte: int) -> int:
        """The state after a byte that begins no longer token from here; remembered."""
        if len(self.goto) >= len(self.given) + self.memory_pairs:
            self.goto = dict(self.given)
        above, found = state, None
        while found is None and above:
            above = self.fail[above]
            found = self.given.get(above << 8 | byte)
        self.goto[state << 8 | byte] = found or 0
        return found or 0

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, token ids) of each word; words must be distinct."""
        longest, shorter, sizes, known = self.longest, self.shorter, self.sizes, self.pairs
        last: list[int] = []  # last[i]: the last token of the first i + 1 bytes on the path
        states: list[int] = []
        path = b""
        for word in sorted(words):
            shared, limit = 0, min(len(path), len(word))
            while shared < limit and path[shared] == word[shared]:
                shared += 1
            del last[shared:], states[shared:]
            state, goto = states[-1] if states else 0, self.goto
            for end in range(shared, len(word)):
                after = goto.get(state << 8 | word[end])
                if after is None:
                    after = self._step(state, word[end])
                    goto = self.goto
                state = after
                token = longest[state]
                while token >= 0:
                    begin = end - sizes[token]
                    if begin < 0:
                        break
                    fits = known.get(last[begin] << 32 | token)
                    if self._fits(last[begin], token) if fits is None else fits:
                        break
                    token = shorter[token]
                else:
                    raise ValueError(f"the vocabulary lacks the byte {word[end]}")
                last.append(token)
                states.append(state)
            path = word
            ids, end = [], len(word)
            while end:
                token = last[end - 1]
                ids.append(token)
                end -= sizes[token]
            ids.reverse()
            yield word, ids


def _encoder(vocabulary: Vocabulary, memory_words: int, suffixes: tuple | None = None):
    """A function from a list of texts to, for each, (count, decimal ids, decoded bytes)."""
    import regex

    encoder = TrieEncoder(vocabulary, suffixes)
    cut = regex.compile(CUT).findall
    special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) or r"(?!)")
    memory: dict[str, tuple[int, str, bytes]] = {}
    fixed = {
        text: (1, str(number), text.encode()) for text, number in vocabulary.specials.items()
    }

    def pieces(text: str) -> list:
        """Words, and for special tokens their finished entry."""
        if not fixed or not special.search(text):
            return cut(text)
        found, at = [], 0
        for match in special.finditer(text):
            found += cut(text[at : match.start()])
            found.append(fixed[match[0]])
            at = match.end()
        return found + cut(text[at:])

    def encode(texts: list[str]) -> list[tuple[int, str, bytes]]:
        split = [pieces(text) for text in texts]
        if len(memory) > memory_words:
            memory.clear()
        fresh = {
            word.encode(): word
            for words in split
            for word in words
            if word.__class__ is str and word not in memory
        }
        for raw, ids in encoder.encode_words(fresh):
            decoded = b"".join([encoder.bytes_of[i] for i in ids])
            memory[fresh[raw]] = (len(ids), ",".join(map(str, ids)), decoded)
        result = []
        for words in split:
            entries = [memory[w] if w.__class__ is str else w for w in words]
            result.append(
                (
                    sum([e[0] for e in entries]),
                    ",".join([e[1] for e in entries]),
                    b"".join([e[2] for e in entries]),
                )
            )
        return result

    return encode


def encode_documents(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
    memory_words: int = MEMORY_WORDS,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, then ids (array) and decoded (string).

    With digests, ids_sha256 and decoded_sha256 stand in place of the ids and the text.
    The vocabulary file, of bounded size, is read on the driver and broadcast.
    """
    kind = docs.schema[id_col].dataType
    vocabulary = Vocabulary.read(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(
        (
            (vocabulary.id_of, vocabulary.rank_of, vocabulary.specials),
            Suffixes(vocabulary.id_of).as_plain(),
        )
    )
    outputs = (
        [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
        if digests
        else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    )
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType())]
        + [T.StructField(name, of) for name, of in outputs]
    )

    def compute(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        plain, suffixes = shared.value
        encode = _encoder(Vocabulary(*plain), memory_words, suffixes)
        for batch in batches:
            texts = batch.column(1)
            done = 0
            while done < len(batch):
                part, held = [], 0
                while done + len(part) < len(batch) and held < batch_bytes:
                    part.append(texts[done + len(part)].as_py())
                    held += len(part[-1])
                coded = encode(part)
                if digests:
                    columns = [
                        pa.array([sha256(ids.encode()).hexdigest() for _, ids, _ in coded], pa.string()),
                        pa.array([sha256(text).hexdigest() for _, _, text in coded], pa.string()),
                    ]
                else:
                    columns = [
                        pa.array(
                            [[int(i) for i in ids.split(",")] if ids else [] for _, ids, _ in coded],
                            pa.list_(pa.int32()),
                        ),
                        pa.array([text.decode() for _, _, text in coded], pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(part)),
                        pa.array([n for n, _, _ in coded], pa.int64()),
                        *columns,
                    ],
                    schema.names,
                )
                done += len(part)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(compute, schema)
