"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand side by side inside no vocabulary token can't end up in one token, since every
merge makes a vocabulary token. A word is therefore cut at all such pairs, its fragments are merged independently, and
their ids are concatenated; the ids are those of merging the whole word. Fragments repeat far more often than words
do, and a bounded cache keeps both.

The vocabulary file is a ``tokenizers`` JSON file of the word-end kind (lower case, white space dropped). The driver reads
it and broadcasts it (its size doesn't depend on the data); every Python worker parses it once. Texts are worked on
whole, in slices of few rows, so memory holds a slice and the cache.

Characters are classed as the library does, whose tables of letters, marks and capitals are not all of one Unicode version
(LATE_MARKS, LATE_LETTERS, LATE_CAPITALS). A null text counts as empty and has no ids. Special tokens in a text become their ids, as in the library. Repeated rows
and ties need no care, since each row stands alone; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import ship, table

#: Words, and fragments, of a generation that a worker remembers.
CACHE = 150_000
#: Characters of text that are encoded before a batch is handed back.
SLICE_CHARS = 1_000_000
#: White space that str.split doesn't share with the tokenizer's patterns.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: From here on a fragment is merged with a heap.
LONG = 48
# Marks that the library's normal form leaves where they are, and between which it composes nothing.
LATE_MARKS = "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
# Letters and numbers of the pattern engine's newer Unicode, which are neither to the library.
LATE_LETTERS = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
# Capitals that the library lower-cases, beyond those that every Python does: first, last, distance.
LATE_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))


def _class_of(ranges: str) -> str:
    """Ranges of hexadecimal numbers as the inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


_LATE_MARK = re.compile(f"([{_class_of(LATE_MARKS)}])")
#: What may be a late mark or capital at all, which most texts have nothing of.
_MAYBE_LATE = re.compile("[\u07fd-\U0010ffff]")
_LATE_CAPITAL = {x: x + d for a, b, d in LATE_CAPITALS for x in range(a, b + 1)}


def normal_form(text: str) -> str:
    """Composed and in lower case, as the library does it; a capital sigma has no special form at a word's end."""
    if text.isascii():
        return text.lower()
    if not _MAYBE_LATE.search(text):
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    parts = _LATE_MARK.split(text)
    composed = unicodedata.normalize("NFC", text) if len(parts) == 1 else "".join(unicodedata.normalize("NFC", p) for p in parts)
    return composed.replace("Σ", "σ").lower().translate(_LATE_CAPITAL)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(256 + other.index(b)) if b in set(other) else chr(b) for b in range(256)]


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = added
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        # A second pattern, for the rare words that have letters the library doesn't know.
        late = _class_of(LATE_LETTERS)
        self.late = regex.compile(f"[{late}]")
        self.late_words = regex.compile(pattern.replace("[\\p{L}]", "\\p{L}").replace("\\p{L}", f"[\\p{{L}}--[{late}]]").replace("\\p{N}", f"[\\p{{N}}--[{late}]]"), regex.V1)
        self.symbols = byte_symbols()
        self.inside = {pair for token in self.vocab for t in [self._split(token)] for pair in zip(t, t[1:], strict=False)}
        self.known_chunks: dict[str, tuple[int, ...]] = {}
        self.older_chunks: dict[str, tuple[int, ...]] = {}
        self.known_fragments: dict[tuple[str, ...], tuple[int, ...]] = {}

    def _split(self, token: str) -> list[str]:
        """A token as symbols: characters, the last one with the word end if the token has it."""
        if token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def fragments(self, word: str) -> list[tuple[str, ...]]:
        """The symbols of a word, cut at the pairs that no vocabulary token has inside."""
        symbols, inside = self.symbols, self.inside
        s = [symbols[b] for b in word.encode()]
        s[-1] += self.end
        cuts = [i for i, pair in enumerate(zip(s, s[1:], strict=False), 1) if pair not in inside]
        if not cuts:
            return [tuple(s)]
        return [tuple(s[a:b]) for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]

    def merge(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """The ids of a fragment: always the merge of least rank, the leftmost of equal ones."""
        if len(symbols) >= LONG:
            return self._merge_long(symbols)
        s, get, never = list(symbols), self.ranks.get, 1 << 30
        ranks = [get(pair, never) for pair in zip(s, s[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            at = ranks.index(least)
            s[at] += s.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = get((s[at - 1], s[at]), never)
            if at < len(ranks):
                ranks[at] = get((s[at], s[at + 1]), never)
        return tuple([self.vocab[x] for x in s if x in self.vocab])

    def _merge_long(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        s: list[str | None] = list(symbols)
        n, ranks = len(s), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s[x], s[y]) in ranks:
                    heapq.heappush(heap, (ranks[s[x], s[y]], x, s[x], s[y]))
        return tuple(self.vocab[x] for x in s if x is not None and x in self.vocab)

    def _fragment(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        found = self.known_fragments.get(symbols)
        if found is None:
            if len(self.known_fragments) >= CACHE:
                self.known_fragments.clear()
            found = self.merge(symbols)
            if len(symbols) < LONG:
                self.known_fragments[symbols] = found
        return found

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a piece without white space."""
        found = self.older_chunks.get(chunk)
        if found is None:
            # A run of ASCII letters is one word; other pieces are left to the tokenizer's pattern.
            plain = chunk.isascii()
            words = [chunk] if plain and chunk.isalpha() else (self.words if plain or not self.late.search(chunk) else self.late_words).findall(chunk)
            found = tuple(chain.from_iterable([self._fragment(f) for w in words for f in self.fragments(w)]))
        if len(chunk) < LONG:
            if len(self.known_chunks) >= CACHE:  # words that come up again move on to the next generation
                self.older_chunks, self.known_chunks = self.known_chunks, {}
            self.known_chunks[chunk] = found
        return found

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        text = normal_form(text)
        get = self.known_chunks.get
        for chunk in CHUNK.findall(text) if ODD_BLANKS.search(text) else text.split():
            ids = get(chunk)
            yield self._chunk(chunk) if ids is None else ids

    def encode(self, text: str) -> list[int]:
        if not any(s in text for s in self.specials):
            return list(chain.from_iterable(self._plain(text)))
        ids: list[int] = []
        for i, piece in enumerate(self.special.split(text)):
            ids.extend([self.specials[piece]] if i % 2 else chain.from_iterable(self._plain(piece)))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by a space, special ones too: what a file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[int, Codec] = {}


def _codec(source) -> Codec:
    """The worker's codec for a broadcast vocabulary."""
    key = source.id if hasattr(source, "id") else id(source)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(source.value)
    return _CODECS[key]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have SLICE_CHARS bytes of text between them, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE_CHARS:
            yield start, i
            start, total = i, 0
        total += int(n) + 64
    if start < len(sizes):
        yield start, len(sizes)


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with the columns ids (array<int>) and decoded (string), which replace columns of these names."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        source = spark.sparkContext.broadcast(f.read())
    carried = docs.drop("ids", "decoded")
    at = carried.columns.index(text_col)
    schema = T.StructType([*carried.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            for start, stop in _slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                found = [codec.encode(t or "") for t in part.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                decoded = pa.array([codec.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, decoded], names=[*part.schema.names, "ids", "decoded"])

    return carried.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    found = encode_decode(docs.select("doc_id", "text"), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_vocabulary())


SQL: dict[str, str] = {}
QUERIES = {"op2_bpe": op2_bpe}
