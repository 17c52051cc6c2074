"""Problem 2: mapping free-entered values to the entries of a reference list.

Values and list entries are folded alike: compatibility forms, format characters and accents removed, words written
together taken apart at case changes, everything but letters and digits a blank, lower case. Then

1. a multi-pattern automaton (Aho-Corasick) over all canonical names, labels and synonyms finds embedded mentions at
   word boundaries; the longest non-overlapping ones win, the leftmost on ties; the entry with most matched characters
   is the result;
2. values without a mention go to token-set similarity with the entries that an index of words and their near forms gives. Each word of an entry looks for its best word in the value:
   equal, an abbreviation (a prefix of three letters or more), or within one edit (swap of neighbours included) of it, two for
   words of ten letters or more. The score is the share of letters matched on both sides, filler words and numbers aside;
   the same is tried on the words written together, where blanks are missing or added. The best entry from
   ``least`` on is the result;
3. the rest is ``(none)``.

Mapping is a narrow pass: the list (``MAX_ENTRIES`` at most) is shipped with the task, each batch is dictionary-encoded and each worker
remembers values, so a value that fills a third of the rows is mapped once a worker and nothing is shuffled. A longer list is a table
that is gone through in blocks, for the distinct values (:func:`by_blocks`).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

NONE = "(none)"
#: Entries that are shipped to a task at once.
MAX_ENTRIES = 20_000

# Words that people put around a value and that carry no meaning of their own.
FILLER = frozenset("""the a an of in to by is was are were has have been be clearly general see annex field domain area
subject dept department division unit section topic etc and or with on for from at as it its le la les de des du d l un une et
en sur au aux""".split())

_CASE = re.compile(r"(?<=[a-z0-9à-ÿ])(?=[A-ZÀ-Þ])")
_WORD = re.compile(r"[^\W_]+")


def fold(value: str) -> str:
    """A value as blank-separated lower-case words without accents or format characters."""
    value = unicodedata.normalize("NFKC", value)
    value = "".join(c for c in value if unicodedata.category(c) != "Cf")
    value = _CASE.sub(" ", value)
    value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).casefold()
    return " ".join(_WORD.findall(value))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if last is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most and (before is None or min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


def longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of mentions ``(length, start, entry)`` the longest that do not overlap, the leftmost on ties."""
    taken: list[tuple[int, int, str]] = []
    for length, start, canonical in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if all(start + length <= a or start >= a + n for n, a, _ in taken):
            taken.append((length, start, canonical))
    return taken


def most_mentioned(taken: list[tuple[int, int, str]]) -> str | None:
    """The entry with most characters, of equals the one whose mention is longest and first."""
    score: dict[str, int] = {}
    for length, _, canonical in taken:
        score[canonical] = score.get(canonical, 0) + length
    return max(score, key=score.get) if score else None


def _allowed(length: int) -> int:
    return 0 if length < 3 else 1 if length < 10 else 2


def shortenings(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters taken out: words within ``most`` edits (swaps included) have one in common."""
    out = {word}
    for _ in range(most):
        out |= {w[:i] + w[i + 1:] for w in out for i in range(len(w))}
    return out


class Canonicaliser:
    """Maps values to entries; ``entries`` are ``(canonical, other names)``.

    The fallback meets only the entries that an index gives: by a word of the value that equals, begins or nearly is one of the entry's words, or by the
    whole value written together. Of an entry's words the rarest are indexed, as many as make up more than the share of letters that a match may
    lack, so every entry that can reach ``least`` is met.
    """

    def __init__(self, entries: Iterable[tuple[str, Iterable[str]]], least: float = 0.8):
        import ahocorasick

        self.least = least
        self.known: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        names: dict[str, str] = {}
        self.exact: set[str] = set()
        for canonical, others in entries:
            self.exact.add(canonical)
            for name in [canonical, *others]:
                folded = fold(name) if name else ""
                if folded:
                    names.setdefault(folded, canonical)
        for folded, canonical in names.items():
            self.automaton.add_word(f" {folded} ", (len(folded), canonical))
        self.automaton.make_automaton()
        self.patterns = [(tuple(f.split()), f.replace(" ", ""), c) for f, c in names.items()]
        self.joined = {f.replace(" ", ""): c for f, c in reversed(names.items())}
        often = Counter(w for tokens, _, _ in self.patterns for w in set(tokens))
        self.by_token: dict[str, list[int]] = {}
        for n, (tokens, joined, _) in enumerate(self.patterns):
            lacking = 0
            for token in sorted(set(tokens), key=lambda w: (often[w], -len(w), w)):
                self.by_token.setdefault(token, []).append(n)
                lacking += len(token) * tokens.count(token)
                if lacking > (1 - least) * len(joined) + 1e-9:
                    break
        self.tokens = sorted(self.by_token)
        self.longest_token = max(map(len, self.tokens), default=0)
        # Hashes of the shortened forms of whole entries, with the entry's number: 12 bytes each, some 200 an entry.
        short = [(hash(x), n) for n, (_, joined, _) in enumerate(self.patterns) for x in shortenings(joined, _allowed(len(joined)))]
        keys, numbers = np.array([h for h, _ in short], np.int64), np.array([n for _, n in short], np.int32)
        order = np.argsort(keys, kind="stable")
        self.joined_keys, self.joined_numbers = keys[order], numbers[order]
        self.longest_joined = max((len(j) for _, j, _ in self.patterns), default=0)
        self.by_short: dict[str, list[str]] = {}
        for token in self.tokens:
            if len(token) >= 3:
                for short in shortenings(token, _allowed(len(token))):
                    self.by_short.setdefault(short, []).append(token)

    def mentions(self, folded: str) -> list[tuple[int, int, str]]:
        """``(length, start, entry)`` of the longest non-overlapping mentions, the leftmost on ties."""
        found = [] if not self.patterns else [
            (length, end - length, canonical) for end, (length, canonical) in self.automaton.iter(f" {folded} ")]
        return longest(found)

    def mention(self, folded: str) -> str | None:
        """The entry with most characters in longest non-overlapping mentions."""
        return most_mentioned(self.mentions(folded))

    def candidates(self, words: list[str], together: str) -> list[int]:
        """The numbers of the entries that may be like a value, in order."""
        tokens: set[str] = set()
        for word in set(words):
            if word in self.by_token:
                tokens.add(word)
            if len(word) >= 3:
                at = bisect_left(self.tokens, word)
                while at < len(self.tokens) and self.tokens[at].startswith(word):
                    tokens.add(self.tokens[at])
                    at += 1
            if 2 <= len(word) <= self.longest_token + 2:
                for short in shortenings(word, 1 if len(word) < 8 else 2):
                    tokens.update(self.by_short.get(short, ()))
        found = {n for t in tokens for n in self.by_token[t]}
        if 0 < len(together) <= self.longest_joined + 2:
            keys = np.array([hash(x) for x in shortenings(together, 1 if len(together) < 8 else 2)], np.int64)
            left, right = np.searchsorted(self.joined_keys, keys), np.searchsorted(self.joined_keys, keys, side="right")
            for a, b in zip(left[right > left], right[right > left]):
                found.update(self.joined_numbers[a:b].tolist())
        return sorted(found)

    def scored(self, folded: str) -> tuple[float, int] | None:
        """The best score of ``least`` or more and the number of its pattern, the first of equals."""
        words = folded.split()
        meant = [w for w in words if w not in FILLER and not w.isdigit()] or words
        together = "".join(words)
        best, found = self.least, None
        for n in self.candidates(words, together):
            tokens, joined, _ = self.patterns[n]
            score = max(self._tokens(tokens, words, meant), self._joined(joined, together))
            if score > best or (score == best and found is None):
                best, found = score, n
        return None if found is None else (best, found)

    def similar(self, folded: str) -> str | None:
        together = folded.replace(" ", "")
        if together in self.joined:
            return self.joined[together]
        found = self.scored(folded)
        return found and self.patterns[found[1]][2]

    @staticmethod
    def _joined(joined: str, together: str) -> float:
        most = _allowed(len(joined))
        distance = edits(joined, together, most)
        return 0.0 if distance > most or not together else 1 - distance / (max(len(joined), len(together)) + 1)

    @staticmethod
    def _tokens(tokens: tuple[str, ...], words: list[str], meant: list[str]) -> float:
        free, got, lost = list(words), 0.0, 0
        for token in sorted(tokens, key=len, reverse=True):
            best, mine = 0.0, None
            for word in free:
                if word == token:
                    value = float(len(token))
                elif len(token) < 3 or len(word) < 2:
                    continue
                elif len(word) >= 3 and token.startswith(word):
                    value = len(token) * 0.9
                else:
                    most = _allowed(len(token))
                    distance = edits(token, word, most)
                    value = len(token) - distance if distance <= most else 0.0
                if value > best:
                    best, mine = value, word
            got += best
            if mine is not None:
                free.remove(mine)
            elif token not in FILLER:
                lost += len(token)
        extra = sum(len(w) for w in free if w in meant)
        whole = sum(map(len, tokens))
        return got / (whole + lost + extra) if whole else 0.0

    def __call__(self, value: str) -> str:
        """The entry meant by a value that is not blank."""
        if value in self.exact:
            return value
        known = self.known.get(value)
        if known is None:
            if len(self.known) > 500_000:
                self.known.clear()
            folded = fold(value)
            known = self.known[value] = (self.mention(folded) or self.similar(folded) or NONE) if folded else NONE
        return known


def entries_of(listed: DataFrame, other_names: list[str]) -> list[tuple[str, list[str]]]:
    """The list as ``(canonical, other names)``; string and array columns may give names. Null canonicals are ignored.

    For lists of at most ``MAX_ENTRIES`` entries; :func:`canonical_values` takes a longer one as a table.
    """
    rows = listed.where(F.col("canonical").isNotNull()).select("canonical", *other_names).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries: give the table itself")
    return _entries(rows, other_names)


def _entries(rows: list, other_names: list[str]) -> list[tuple[str, list[str]]]:
    out = []
    for row in sorted(rows, key=lambda r: r["canonical"]):
        names: list[str] = []
        for c in other_names:
            names += [row[c]] if isinstance(row[c], str) else [x for x in row[c] or [] if x]
        out.append((row["canonical"], names))
    return out


def by_blocks(values: DataFrame, listed: DataFrame, other_names: list[str], least: float = 0.8, block: int = MAX_ENTRIES) -> DataFrame:
    """``value, canonical`` of each of the distinct ``value`` against a list of any length, ``block`` entries at a time.

    Every block gives the mentions it finds in a value, the entry it equals when written together, and its best similarity; they are united by value. The
    longest non-overlapping mentions of all blocks decide, then equality, then the best similarity: as with the list in one piece (of
    equal similarities the entry first in order wins). A value's findings are bounded by its length.
    """
    listed = listed.where(F.col("canonical").isNotNull()).select("canonical", *other_names)
    blocks = max(1, -(-2 * listed.count() // block))
    rows = staged(listed.withColumn("__block", F.pmod(F.xxhash64("canonical"), F.lit(blocks))), "entries")
    values = staged(values.select("value").where("value IS NOT NULL").distinct(), "values")
    parts = []
    for b in range(blocks):
        entries = _entries(rows.where(F.col("__block") == b).limit(2 * block + 1).collect(), other_names)  # half a block on average
        if len(entries) > 2 * block:
            raise RuntimeError("one entry is repeated too often")

        def run(batches: Iterator[pa.RecordBatch], entries=entries) -> Iterator[pa.RecordBatch]:
            own = Canonicaliser(entries, least)
            for batch in batches:
                out = []
                for value in batch.column(0).to_pylist():
                    folded = fold(value)
                    together = folded.replace(" ", "")
                    if value in own.exact:
                        out.append((value, 0, 0, 0, 0.0, value))
                    out += [(value, 1, n, a, 0.0, c) for n, a, c in own.mentions(folded)] if folded else []
                    if together in own.joined:
                        out.append((value, 2, 0, 0, 0.0, own.joined[together]))
                    found = own.scored(folded) if folded else None
                    if found:
                        out.append((value, 3, 0, 0, -found[0], own.patterns[found[1]][2]))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["value", "kind", "length", "start", "cost", "canonical"])

        parts.append(staged(values.mapInArrow(run, "value string, kind int, length int, start int, cost double, canonical string"), "findings"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    united = found.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("kind", "cost", "length", "start", "canonical"))).alias("f"))

    @F.udf("string", useArrow=False)  # a handful of findings a value; values are distinct here
    def decide(findings: list) -> str:
        held = [f for f in findings if f["kind"] == 1]
        if findings[0]["kind"] == 0 or not held:
            return findings[0]["canonical"]
        return most_mentioned(longest([(f["length"], f["start"], f["canonical"]) for f in held]))

    decided = united.select("value", decide("f").alias("canonical"))
    return values.join(decided, "value", "left").withColumn("canonical", F.coalesce("canonical", F.when(F.regexp_replace("value", r"(?U)\s+", "") != "", F.lit(NONE))))


def canonical_values(rows: DataFrame, id_col: str, value_col: str, entries: list, least: float = 0.8,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` and ``canonical`` of every row: null for a null or blank value, ``(none)`` if no entry fits.

    Repeated rows stay; a value equal to a canonical maps to itself; very long values are searched whole by the automaton;
    an empty list maps every value to ``(none)``; extra columns are not read.
    """
    kept = [id_col, *keep]
    made: list[Canonicaliser] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Canonicaliser(entries, least))
        for batch in batches:
            values = batch.column(len(kept)).dictionary_encode()
            mapped = pa.array([made[0](v) if v and v.strip() else None for v in values.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], mapped.take(values.indices)],
                                             names=[*kept, "canonical"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", canonical string"
    return rows.select(*kept, F.col(value_col).alias("__value")).mapInArrow(run, schema)


def unmatched(mapped: DataFrame, values: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """The report of values that fit no entry: ``value, rows``, most frequent first."""
    none = mapped.where(F.col("canonical") == NONE).select(id_col).distinct()
    return values.join(none, id_col, "left_semi").groupBy(F.col(value_col).alias("value")).agg(
        F.count("*").alias("rows")).orderBy(F.desc("rows"), "value")
