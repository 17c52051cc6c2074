"""Problem 8: exact byte-pair encoding of a whole corpus by per-prefix dynamic programming.

The encoder works on the byte string of one pre-token. A suffix automaton over the vocabulary (Aho-Corasick, whose
failure links are the longest proper suffixes) lists every token that ends at each position. Of these exactly one can
be the last token of the encoding of that prefix: the one that is *compatible* with the last token of the prefix
before it, where two tokens are compatible if merging their joined bytes by rank gives back the same two tokens. One
last token per prefix is stored and the ids come out by following the back-pointers. No merge list is replayed on the
text, so the cost is linear in the bytes, whatever the length of a word.

Text is cut vectorised (Arrow) before each run of white space; since the split pattern never joins a character to the
white space after it, the pre-tokens of the pieces are the pre-tokens of the text. Pieces are dictionary-encoded, so
each distinct piece is encoded once per worker and batch and the ids of the whole batch are gathered by index.

Defined results: null text and empty text give an empty list, blank text is encoded as it is. Rows keep their id;
repeated rows give repeated results; an empty table gives an empty table. Nothing is truncated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The published split pattern of the byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The characters with the White_Space property, as a RE2 class.
WHITE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Cuts pieces; a noncharacter that no exchanged text should hold. Texts that do hold it go piece-free.
MARK = "﷐"
#: Distinct pieces a worker remembers; beyond that the memory is started anew, which only costs time.
REMEMBERED = 400_000


class PrefixEncoder:
    """Byte-pair encoder over ranks ``{token bytes: id}``."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.pieces: dict[str, np.ndarray] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, list[int]] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by lowest rank; only used on the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` survives the merging of their joined bytes."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            self._pairs[(left, right)] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None and self.reachable(whole):
            return [whole]
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            before = last[start]
            if (start == 0 and self.reachable(token)) or (before >= 0 and self.compatible(before, token)):
                last[end], size[end] = token, length
        ids, at = [], len(data)
        while at > 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, its pre-tokens remembered."""
        out: list[int] = []
        words = self._words
        for word in self.split(text or ""):
            ids = words.get(word)
            if ids is None:
                if len(words) > REMEMBERED:
                    words.clear()
                ids = words[word] = self.encode_word(word)
            out += ids
        return out


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token, blank, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


@lru_cache(maxsize=4)
def _encoder(content: bytes) -> PrefixEncoder:
    return PrefixEncoder(parse_ranks(content))


def encode_batch(encoder: PrefixEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, ids)`` of a batch of texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.any(pc.match_substring(texts, MARK)).as_py()
    if marked:
        ids = [encoder.encode(t) for t in texts.to_pylist()]
        return np.cumsum([0, *map(len, ids)]), np.fromiter((x for i in ids for x in i), np.int32)
    cut = pc.replace_substring_regex(texts, rf"([^{WHITE}])([\t-\r ])", rf"\1{MARK}\2")
    pieces = pc.split_pattern(cut, MARK)
    flat = pieces.flatten().dictionary_encode()
    known = encoder.pieces
    if len(known) > REMEMBERED:
        known.clear()
    own: list[np.ndarray] = []
    for piece in flat.dictionary.to_pylist():
        ids = known.get(piece)
        if ids is None:
            ids = known[piece] = np.array(encoder.encode(piece), np.int32)
        own.append(ids)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if own else np.zeros(0, np.int64)
    store = np.concatenate(own) if own else np.zeros(0, np.int32)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    each = lengths[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total) + np.repeat(starts[codes] - (ends - each), each) if total else np.zeros(0, np.int64)
    by_piece = np.concatenate([[0], ends])
    offsets = by_piece[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
    return offsets, store[where] if total else store[:0]


def vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """The vocabulary file as a broadcast: one file of under 2 MB, whatever the corpus."""
    rows = spark.read.format("binaryFile").load(path).select("content").head()
    return spark.sparkContext.broadcast(bytes(rows[0]))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str = DEFAULT_VOCABULARY, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` columns and ``ids array<int>`` (or ``n_tokens bigint``) of every row; one narrow stage.

    Null and empty texts give an empty list (0), blank texts are encoded as they are, repeated rows are kept, clashing
    extra columns are not read.
    """
    ranks = vocabulary(docs.sparkSession, path)
    kept = [id_col, *keep]
    out_field = "n_tokens bigint" if counts_only else "ids array<int>"
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", " + out_field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                offsets, ids = encode_batch(encoder, part.column(len(kept)))
                result = pa.array(np.diff(offsets)) if counts_only else pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], result],
                                                 names=[*kept, "n_tokens" if counts_only else "ids"])

    return docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("__text")).mapInArrow(run, schema)
