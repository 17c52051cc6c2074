"""Problem 1: repairing text that was read from scanned pages.

Furniture. A line is a running header, a page number or both if what it says is the page's number (in any of the usual
dresses) or the title of the document, possibly cut short, in capitals, misread, with a section or a mark in front. The
features are the line's number against ``page`` and ``page_count``, its likeness to the title or, where that is missing, to the words of the file
name and to lines that recur in other chunks of the document, and whether it reads like a sentence of the text.

Characters. An averaged-perceptron editor gives each character of a word an operation: keep, replace, delete, insert, and at a
line-end hyphen join or keep the hyphen. It is trained here on words of the corpus that are seen on clean pages, misread at random by the
table of confusions below; the sample is bounded by ``train_words``, in the order of frequency. A search gives the readings of a word that is not
known from clean pages, as far as some known word begins so, with the editor's scores; the lexicon, all words of the corpus with their
counts, decides between them.

All statistics cover all chunks: words are counted in one aggregation (combined per batch), unknown words are edited once
each, and their readings meet the lexicon in a join. Nothing of the size of the corpus or its vocabulary is broadcast; the most frequent
``common`` words are, to keep them out of the joins.

Defined results: null and blank texts change nothing; repeated rows of a chunk give the same rows once; a missing page,
title or document only takes away evidence; very long texts are read whole; an empty table gives no rows; extra
columns are not read. A token of more than ``LONGEST_WORD`` characters is no word (an address, a code): it stays as it stands.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Longer tokens are no words.
LONGEST_WORD = 60
#: Stands for a hyphen at a line end, inside a word.
BREAK = "\u0001"

# Confusions of character recognition, what is printed and what is read for it.
CONFUSIONS = [
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("m", "in"), ("in", "m"), ("n", "ri"), ("ri", "n"),
    ("u", "ii"), ("ii", "u"), ("r", "i'"), ("r", "i’"), ("w", "vv"), ("vv", "w"), ("nn", "rm"), ("k", "lc"), ("b", "lo"), ("ni", "m"), ("ui", "m"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("st", "ﬆ"), ("fi", "f1"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("g", "9"), ("b", "6"), ("g", "6"), ("b", "8"), ("z", "2"), ("e", "3"), ("t", "7"),
    ("q", "9"), ("a", "4"), ("l", "|"), ("i", "|"), ("i", "!"), ("l", "!"), ("s", "$"),
    ("e", "c"), ("c", "e"), ("o", "c"), ("c", "o"), ("e", "o"), ("o", "e"), ("a", "o"), ("a", "e"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"), ("l", "t"), ("t", "l"),
    ("i", "j"), ("j", "i"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("q", "g"), ("g", "q"), ("u", "v"), ("v", "u"), ("s", "z"), ("i", "ı"),
    ("é", "e"), ("è", "e"), ("ê", "e"), ("é", "c"), ("é", "6"), ("à", "a"), ("â", "a"), ("ç", "c"), ("î", "i"), ("ô", "o"), ("û", "u"), ("é", "è"), ("è", "é"),
    ("a", "а"), ("e", "е"), ("o", "о"), ("p", "р"), ("c", "с"), ("y", "у"), ("x", "х"), ("i", "і"), ("s", "ѕ"), ("j", "ј"), ("h", "һ"),
]
# What may be read for a digit.
DIGITS = {"l": "1", "i": "1", "|": "1", "o": "0", "s": "5", "b": "8", "z": "2", "g": "9"}

# Each pattern begins with the rare character and looks back from there, which the matcher finds fast.
_BROKEN = re.compile(r"[-‐‑¬\xad](?<=[^\W\d_].)(?:[^\S\n]*(?:\n\s*|[^\S\n]+)(?=[^\W\d_])|(?<=\xad)(?=[^\W\d_]))")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_HEAD = re.compile(r"^[\W_]+")
_SENTENCE = re.compile(r"[.!?;,]$")
_SIGNATURES = [re.compile(p) for p in (
    r"[015689](?<=[^\W\d_].)(?=[^\W\d_])", r"[-‐¬\xad](?=[^\S\n]*\n\s*[^\W\d_])", r"[\xad¬ﬀ-ﬆ]", r"[Ѐ-ӿ](?:(?<=[a-z].)|(?=[a-z]))", r"i['’](?=[a-z]{2})")]


def looks_scanned(text: str) -> bool:
    """Whether a text bears marks that only recognised pages bear."""
    return any(p.search(text) for p in _SIGNATURES)


def strip_token(token: str) -> str:
    """A token in lower case without outer punctuation."""
    return _EDGE.sub("", token).lower()


# ---------------------------------------------------------------- furniture

def _squeeze(text: str) -> str:
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


_LOOKS = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "9": "g", "6": "b", "c": "e", "f": "t", "h": "b",
                        "а": "a", "е": "e", "о": "o", "р": "p", "с": "e", "у": "y", "х": "x"})


def _looks(text: str) -> str:
    """Letters and digits only, confusable shapes made one."""
    text = _squeeze(text).replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("i'", "r").replace("i’", "r").replace("ri", "n").replace("ii", "u").replace("li", "b")
    return "".join(c for c in text.translate(_LOOKS) if c.isalnum())


def _bigrams(text: str) -> Counter:
    return Counter(text[i:i + 2] for i in range(len(text) - 1))


def _alike(a: str, b: str) -> float:
    """Share of common bigrams of two strings of similar shapes."""
    x, y = _bigrams(a), _bigrams(b)
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


def _as_number(text: str) -> int | None:
    digits = "".join(DIGITS.get(c, c) for c in text.lower())
    return int(digits) if 0 < len(digits) < 7 and digits.isascii() and digits.isdigit() else None


_NUMBER = re.compile(r"(?:(?:page|seite|p\.|pp\.|pg\.?|p|s\.|pagina|página|page n°|n°)\s*)?([\w|]+)(?:\s*(?:of|de|sur|von|/)\s*([\w|]+))?", re.IGNORECASE)
_DRESS = re.compile(r"^[\s\-–—·•|*~_=\[\](){}<>:.]+|[\s\-–—·•|*~_=\[\](){}<>:]+$")


def page_number(line: str, page: int | None, page_count: int | None) -> bool:
    """Whether a line says the number of its page and no more."""
    if page is None:
        return False
    inner = _DRESS.sub("", line)
    m = _NUMBER.fullmatch(inner)
    if not m:
        return False
    first, second = m.groups()
    if second is not None and _as_number(second) is None:
        return False
    if second is not None and page_count is not None and _as_number(second) != page_count:
        return False
    return _as_number(first) == page or (first.lower() == _roman(page) and second is None and first.isalpha())


@lru_cache(maxsize=1 << 16)
def _shape_of(name: str) -> tuple[str, frozenset[tuple[str, str]]]:
    """The shape of a title and the pairs of letters in it."""
    plain = name.lower()
    return _looks(name), frozenset(zip(plain, plain[1:]))


def _might_be(line: str, pairs: frozenset[tuple[str, str]]) -> bool:
    """Whether a line shares enough pairs of letters with a title to be worth a closer look: a misread character spoils two."""
    plain = line.lower()
    own = set(zip(plain, plain[1:]))
    return len(own & pairs) >= 0.25 * len(own)


def running_header(line: str, title: str | None, slug: list[str], known: frozenset[str] | set[str], page: int | None) -> bool:
    """Whether a line is a running header of its document, with or without a number."""
    text = line.strip()
    if len(text) < 4:
        return False
    if not known and not _might_be(text, _shape_of(title or " ".join(slug))[1]):
        return False
    parts = [text]
    m = re.fullmatch(r"(.*?\S)(?:\s{2,}|\s*[|·–—-]\s*|\s+)([\w|]{1,6})", text)
    numbered = bool(m and page is not None and _as_number(m.group(2)) == page)
    if numbered:
        parts.append(m.group(1).rstrip(" |·–—-"))
    m = re.fullmatch(r"([\w|]{1,6})(?:\s{2,}|\s*[|·–—-]\s*)(\S.*)", text)
    if m and page is not None and _as_number(m.group(1)) == page:
        numbered = True
        parts.append(m.group(2))
    for p in list(parts):
        parts += [x for x in re.split(r"\s+[·|—–]\s+", p) if x != p and len(x) > 3]
    for p in parts:
        shape = _looks(p)
        if len(shape) < 4:
            continue
        if shape in known:
            return True
        if title:
            whole = _shape_of(title)[0]
            if shape == whole or (len(shape) >= 0.6 * len(whole) and len(shape) >= 10 and (
                    _alike(shape, whole[: len(shape)]) >= 0.72 and abs(len(shape) - len(whole[: len(shape)])) <= 4)):
                return len(shape) >= 0.6 * len(whole) and not (_SENTENCE.search(p) and not _SENTENCE.search(title))
        elif slug and not _SENTENCE.search(p):
            words = [_looks(w) for w in p.split()]
            if len(words) > 9:
                continue
            wanted = [_shape_of(s)[0] for s in slug]
            hits = sum(any(w == s or (len(w) >= 4 and s.startswith(w)) or _alike(w, s) > 0.7 for w in words) for s in wanted)
            if hits >= min(2, len(slug)):
                return True
    return False


def slug_of(source_doc: str | None) -> list[str]:
    """The words of a file name."""
    if not source_doc:
        return []
    return [w for w in re.split(r"[^\w]+|_", source_doc.rsplit(".", 1)[0].lower()) if len(w) > 3 and not w.isdigit()]


def furniture(text: str, page: int | None, page_count: int | None, title: str | None, source_doc: str | None,
              known: Iterable[str] = ()) -> list[int]:
    """The numbers of the lines that are furniture. A text of one line has none: its line ends are gone."""
    lines = text.split("\n")
    if len(lines) < 2:
        return []
    slug, known = slug_of(source_doc), set(known)
    longest = max(map(len, [title or "", " ".join(slug), *known])) + 60
    return [i for i, line in enumerate(lines) if line.strip() and (
        (len(line) <= 30 and page_number(line, page, page_count))
        or (len(line) <= longest and running_header(line, title, slug, known, page)))]


def running_text(text: str, dropped: Iterable[int] = ()) -> str:
    """The text without furniture, line-end hyphens marked and line ends made blanks (paragraph ends are kept)."""
    gone = set(dropped)
    lines = [line for i, line in enumerate(text.split("\n")) if i not in gone]
    paragraphs = re.split(r"\n\s*\n", _BROKEN.sub(BREAK, "\n".join(lines)))
    return "\n\n".join(re.sub(r"\s*\n\s*", " ", p) for p in paragraphs)


# ---------------------------------------------------------------- the character editor

class Editor:
    """Averaged perceptron over operations on the characters of a word; an operation is the string put for a character.

    The character itself is *keep*, another one *replace*, nothing *delete*, two or more *insert*; at BREAK nothing is
    *line-join* and a hyphen keeps the hyphen.
    """

    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}
        self.readings: dict[str, list[str]] = {}
        for printed, read in CONFUSIONS:
            self.readings.setdefault(read, []).append(printed)
        self.readings[BREAK] = ["", "-"]
        self.longest = max(map(len, self.readings))

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        padded = f"^^{word}$$"
        j = i + 2
        a, b, c, d, e = padded[j - 2: j + 3]
        return ["0" + c, "1" + b + c, "2" + c + d, "3" + b + c + d, "4" + a + b + c, "5" + c + d + e, "6" + a + b + c + d + e,
                f"7{c}{(b.isdigit(), d.isdigit(), b.isalpha(), d.isalpha())}"]

    def options(self, word: str, i: int) -> list[str]:
        """The operations on one character that some confusion allows."""
        out = [word[i]] if word[i] != BREAK else []
        for n in range(1, self.longest + 1):
            for k in range(n):
                if i - k >= 0 and word[i - k: i - k + n] in self.readings and i - k + n <= len(word):
                    out += [split_op(p, n)[k] for p in self.readings[word[i - k: i - k + n]]]
        return list(dict.fromkeys(out))

    def train(self, pairs: list[tuple[str, list[str]]], rounds: int = 2) -> None:
        total: dict[tuple[str, str], float] = {}
        current: dict[tuple[str, str], float] = {}
        step = 1
        for _ in range(rounds):
            for word, ops in pairs:
                for i, right in enumerate(ops):
                    options = self.options(word, i)
                    if len(options) < 2:
                        continue
                    found = self.features(word, i)
                    guess = max(options, key=lambda o: sum(current.get((f, o), 0.0) for f in found))
                    if guess != right:
                        for f in found:
                            for op, sign in ((right, 1.0), (guess, -1.0)):
                                current[f, op] = current.get((f, op), 0.0) + sign
                                total[f, op] = total.get((f, op), 0.0) + sign * step
                step += 1
        self.weights = {}
        for (f, op), w in current.items():
            value = w - total[f, op] / step
            if value:
                self.weights.setdefault(f, {})[op] = value

    def beam(self, word: str, width: int = 60, most: int = 4, begins: Callable[[str], bool] | None = None) -> list[tuple[str, float]]:
        """Readings of a word, best first, with the gain over keeping every character.

        ``begins`` says whether some known word may begin so. With it every reading that a known word could be is returned, without it the
        best ones; readings with one edit all stay. ``most`` is the number of edits, in long words a third of their length.
        """
        most = max(most, len(word) // 3)
        known = [[self.weights[f] for f in self.features(word, i) if f in self.weights] for i in range(len(word))]
        kept = [sum(w.get(c, 0.0) for w in held) for c, held in zip(word, known)]
        # The best gain for what is read so far and the number of edits in it.
        states: list[dict[tuple[str, int], float]] = [{} for _ in range(len(word) + 1)]
        states[0]["", 0] = 0.0
        for i in range(len(word)):
            here = states[i].items()
            if begins is None and len(here) > width:
                few = [s for s in here if s[0][1] < 2]
                for edits in range(2, most + 1):
                    few += sorted((s for s in here if s[0][1] == edits), key=lambda s: -s[1])[:width]
                here = few
            steps = [(1, word[i], 0.0, 0)] if word[i] != BREAK else []
            for n in range(1, self.longest + 1):
                read = word[i: i + n]
                if len(read) == n and read in self.readings:
                    base = 0.0 if BREAK in read else sum(kept[i: i + n])
                    rest = sum(w.get("", 0.0) for held in known[i + 1: i + n] for w in held)
                    for printed in self.readings[read]:
                        gain = sum(w.get(printed, 0.0) for w in known[i]) + rest
                        steps.append((n, printed, gain - base, 0 if read == BREAK else 1))
            fits: dict[str, bool] = {}
            for (out, edits), gain in here:
                for n, printed, more, cost in steps:
                    if edits + cost <= most:
                        longer = out + printed
                        if begins is not None:
                            if longer not in fits:
                                fits[longer] = begins(longer)
                            if not fits[longer]:
                                continue
                        there, at = states[i + n], (longer, edits + cost)
                        if gain + more > there.get(at, float("-inf")):
                            there[at] = gain + more
        best: dict[str, float] = {}
        for (out, edits), gain in states[-1].items():
            value = gain - 4.0 * edits
            if value > best.get(out, float("-inf")):
                best[out] = value
        return sorted(best.items(), key=lambda b: -b[1])


def split_op(printed: str, n: int) -> list[str]:
    """The operations on ``n`` characters that were read for ``printed``: the first gets all that the others don't keep."""
    return [printed] + [""] * (n - 1)


def misread(word: str, rng: random.Random, times: int) -> tuple[str, list[str]]:
    """A word misread at some places, and the operations that mend it."""
    spans = []
    for printed, read in CONFUSIONS:
        at = word.find(printed)
        while at >= 0:
            spans.append((at, printed, read))
            at = word.find(printed, at + 1)
    rng.shuffle(spans)
    taken: list[tuple[int, str, str]] = []
    for at, printed, read in spans:
        if len(taken) < times and all(at + len(printed) <= a or at >= a + len(p) for a, p, _ in taken):
            taken.append((at, printed, read))
    out, ops, i = "", [], 0
    chosen = {a: (p, r) for a, p, r in taken}
    brk = rng.randrange(2, len(word) - 1) if len(word) > 4 and rng.random() < 0.25 else -1
    while i < len(word):
        if i == brk and i not in chosen and not (word[i - 1] == "-" or word[i] == "-"):
            out, ops = out + BREAK, [*ops, ""]
        if i in chosen:
            printed, read = chosen[i]
            out, ops, i = out + read, ops + split_op(printed, len(read)), i + len(printed)
        elif word[i] == "-" and rng.random() < 0.5:
            out, ops, i = out + BREAK, [*ops, "-"], i + 1
        else:
            out, ops, i = out + word[i], [*ops, word[i]], i + 1
    return out, ops


def train_editor(words: list[str], seed: int = 11) -> Editor:
    """An editor trained on clean words misread at random."""
    rng, pairs = random.Random(seed), []
    for word in words:
        for times in (0, 1, 1, 2):
            pairs.append(misread(word, rng, times))
    rng.shuffle(pairs)
    editor = Editor()
    editor.train(pairs)
    return editor


# ---------------------------------------------------------------- over the corpus

def _with_pages(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per chunk and text with the title, length and listed pages of its document, and the headers that recur in it."""
    about = docs.where(F.col("source_doc").isNotNull()).groupBy("source_doc").agg(
        F.max("title").alias("title"), F.max("page_count").alias("page_count"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("ocr_pages", F.array().cast("array<int>"))))).alias("ocr"))
    rows = chunks.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).select(
        "chunk_id", "source_doc", "page", "text").dropDuplicates(["chunk_id", "text"])
    return rows.join(about, "source_doc", "left").withColumn(
        "listed", F.coalesce(F.array_contains("ocr", F.col("page")), F.lit(False))).drop("ocr")


#: What one task reads for furniture, and the words one task edits.
TASK_CHARS, TASK_WORDS = 16_000_000, 5_000


def _tasks(df: DataFrame, size: int, each: int) -> int:
    """Tasks for work that is slow for its size: as many as its size asks for, and some per core, as the engine would pack these few bytes into one."""
    return max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-size // each))


def _recurring(rows: DataFrame) -> DataFrame:
    """``source_doc, known``: shapes of short lines that recur on other pages of documents without a title."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for doc, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                for line in lines if len(lines) > 1 else ():
                    line = line.strip()
                    if 8 <= len(line) <= 90 and not _SENTENCE.search(line):
                        core = re.sub(r"(\s{2,}|\s*[|·–—-]\s*|\s+)[\w|]{1,4}$", "", line) if page is not None and re.search(
                            rf"\b{page}$", line) else line
                        out.add((doc, page, _looks(core)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int32(), pa.string()])],
                                                 names=["source_doc", "page", "shape"])

    lines = rows.where("title IS NULL AND source_doc IS NOT NULL").select("source_doc", F.col("page").cast("int").alias("page"), "text").mapInArrow(
        run, "source_doc string, page int, shape string")
    often = lines.groupBy("source_doc", "shape").agg(F.count_distinct("page").alias("pages")).where("pages > 1 AND length(shape) >= 10")
    return often.groupBy("source_doc").agg(F.collect_list("shape").alias("known"))


def prepared(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``chunk_id, clean, body, dropped`` of every chunk: the running text and the furniture lines taken out of it."""
    rows = staged(_with_pages(chunks, docs), "pages")
    whole = rows.agg(F.sum(F.length("text").cast("bigint"))).head()[0] or 0
    width = _tasks(rows, whole, TASK_CHARS)
    rows = rows.join(_recurring(rows), "source_doc", "left").repartition(width, "chunk_id").select(
        "chunk_id", "source_doc", F.col("page").cast("int").alias("page"), F.col("page_count").cast("int").alias("page_count"), "title", "text", "listed", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, doc, page, count, title, text, listed, known in zip(*(c.to_pylist() for c in batch.columns)):
                gone = furniture(text, page, count, title, doc, known or ())
                lines = text.split("\n")
                clean = not listed and not gone and not looks_scanned(text)
                out.append((chunk, clean, running_text(text, gone), list(dict.fromkeys(lines[i].strip() for i in gone))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())])],
                    names=["chunk_id", "clean", "body", "dropped"])

    return staged(rows.mapInArrow(run, "chunk_id string, clean boolean, body string, dropped array<string>"), "bodies")


@lru_cache(maxsize=1 << 17)
def forms(token: str) -> str:
    """A token as it is looked up: lower case, outer punctuation off, but for an apostrophe that may be half a letter."""
    return re.sub(r"^[\W_]+|(?:(?!['’])[\W_])+$", "", token).lower()


def lexicon_of(bodies: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``word, clean, n``: how often each form stands on clean pages and anywhere; ``names`` adds trusted spellings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, whole = Counter(), Counter()
            for fine, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(text.split())
                whole.update(counts)
                if fine:
                    clean.update(counts)
            merged: dict[str, list[int]] = {}
            for token, n in whole.items():
                word = forms(token)
                if word and any(c.isalpha() for c in word) and len(word) <= LONGEST_WORD:
                    held = merged.setdefault(word, [0, 0])
                    held[0] += clean.get(token, 0)
                    held[1] += n
            if merged:
                yield pa.RecordBatch.from_arrays([pa.array(list(merged)), pa.array([m[0] for m in merged.values()], pa.int64()),
                                                  pa.array([m[1] for m in merged.values()], pa.int64())], names=["word", "clean", "n"])

    counted = bodies.select("clean", "body").mapInArrow(run, "word string, clean bigint, n bigint")
    if names is not None:
        spelled = names.select(F.explode(F.split(F.lower(F.trim("name")), r"\s+")).alias("word")).where("length(word) > 2")
        counted = counted.unionByName(spelled.groupBy("word").agg(F.count("*").alias("clean")).withColumn("n", F.col("clean")))
    return counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("n").alias("n"))


#: Bits of the filter of known words: 8 MB, however many words there are.
FILTER_BITS = 1 << 26


class WordFilter:
    """A filter of words of bounded size. It only saves shuffling readings that no page holds; the exact join follows."""

    def __init__(self, bits: int, held: bytearray | bytes | None = None):
        self.mask = bits - 1
        self.held = bytearray(bits // 8) if held is None else held

    def _places(self, word: str) -> tuple[int, int]:
        data = word.encode("utf-8", "surrogatepass")
        return zlib.crc32(data) & self.mask, zlib.crc32(data, 0x9747B28C) & self.mask

    def add(self, word: str) -> None:
        for p in self._places(word):
            self.held[p >> 3] |= 1 << (p & 7)

    def holds(self, word: str) -> bool:
        a, b = self._places(word)
        return bool(self.held[a >> 3] >> (a & 7) & 1 and self.held[b >> 3] >> (b & 7) & 1)


def known_words(known: DataFrame, beginnings: bool = False):
    """The filter of the column ``right``, or of all that its words begin with, as a broadcast of at most 8 MB."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << ((64 if beginnings else 16) * known.count() + 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordFilter(bits)
        for batch in batches:
            words = batch.column(0).to_pylist()
            for word in {w[:n] for w in words for n in range(1, len(w) + 1)} if beginnings else words:
                own.add(word)
        yield pa.RecordBatch.from_arrays([pa.array([bytes(own.held)], pa.binary())], names=["held"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in known.select("right").coalesce(4).mapInArrow(run, "held binary").toLocalIterator():  # four parts of 8 MB at most, one at a time
        whole |= np.frombuffer(bytes(row.held), np.uint8)
    return known.sparkSession.sparkContext.broadcast((bits, whole.tobytes()))


def corrections(lexicon: DataFrame, train_words: int = 3000, trusted: int = 4, often: int = 30, always: int = 300) -> DataFrame:
    """``word, right``: the mended reading of every form that is not trusted and has one.

    The reading with the best sum of the editor's score and the logarithm of its count on clean pages wins, if it stands there
    ``often`` times as often as the form itself, or ``always`` times where that is seen there ``trusted`` times or more
    (a share of the pages thought clean is not). Forms too frequent for any other to be ``always`` times as frequent are right.
    """
    sample = [r.word for r in lexicon.where(F.col("clean") >= trusted).where(F.length("word") > 2).orderBy(F.desc("clean"), "word").limit(train_words).collect()]
    editor = train_editor(sample)
    most = lexicon.agg(F.max("clean")).head()[0] or 0
    # Two letters of one script are too little to tell a misread word from a short or a cut one.
    enough = (F.length("word") > 2) | ~F.col("word").rlike(r"^[a-zà-ÿœ'’]+$")
    unknown = lexicon.where(enough & ((F.col("clean") < trusted) | (F.col("clean") * always <= most))).select("word", "clean")

    known = lexicon.where("clean > 0").select(F.col("word").alias("right"), F.col("clean").alias("seen"))
    standing, begun = known_words(known), known_words(known, beginnings=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, starts = WordFilter(*standing.value), WordFilter(*begun.value)

        def begins(reading: str) -> bool:
            """Outer punctuation is no part of a word."""
            inner = reading if reading[:1].isalnum() else _HEAD.sub("", reading)
            return not inner or starts.holds(inner) or (not inner[-1].isalnum() and starts.holds(strip_token(inner)))

        for batch in batches:
            out = []
            for word, clean in zip(*(c.to_pylist() for c in batch.columns)):
                found = {}
                for reading, gain in editor.beam(word, begins=begins):
                    right = strip_token(reading)
                    if right and right != word and right not in found and words.holds(right):
                        found[right] = gain
                out += [(word, clean, r, g) for r, g in found.items()]
                if BREAK in word and word.replace(BREAK, "") not in found:
                    out.append((word, clean, word.replace(BREAK, ""), 0.0))
            for at in range(0, len(out), 50_000):
                part = out[at: at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), [pa.string(), pa.int64(), pa.string(), pa.float64()])],
                                                 names=["word", "own", "right", "gain"])

    # A broken word that is whole when joined, with or without its hyphen, needs no editor.
    joined = unknown.where(F.contains("word", F.lit(BREAK))).select("word", F.explode(F.array(
        F.replace("word", F.lit(BREAK), F.lit("")), F.replace("word", F.lit(BREAK), F.lit("-")))).alias("right")).join(known, "right")
    plain = staged(joined.groupBy("word").agg(F.max_by("right", F.struct("seen", "right")).alias("right")), "joined")
    width = _tasks(lexicon, unknown.count(), TASK_WORDS)
    readings = unknown.join(plain, "word", "left_anti").repartition(width, "word").mapInArrow(
        run, "word string, own bigint, right string, gain double")
    fit = readings.join(known, "right").where(F.col("seen") >= F.when(
        F.col("own") >= trusted, always * F.col("own")).when(F.col("own") > 0, often * F.col("own")).otherwise(1))
    order = Window.partitionBy("word").orderBy(F.desc(F.col("gain") + 2.0 * F.log("seen")), "right")
    return fit.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("word", "right").unionByName(plain)


def changes(bodies: DataFrame, lexicon: DataFrame, mended: DataFrame, common: int = 20_000) -> DataFrame:
    """``chunk_id, kind, token, word``: what the repair changes; ``word`` is the form in the text (or the line)."""
    top = lexicon.join(mended, "word", "left_anti").orderBy(F.desc("clean"), "word").limit(common)
    usual = frozenset(r.word for r in top.collect())  # bounded by `common`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for chunk, text in zip(*(c.to_pylist() for c in batch.columns)):
                for token in set(text.split()):
                    word = forms(token)
                    if word and word not in usual and any(c.isalpha() for c in word):
                        out.add((chunk, word))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["chunk_id", "word"])

    rare = bodies.select("chunk_id", "body").mapInArrow(run, "chunk_id string, word string")
    words = rare.join(mended, "word")
    plain = F.replace(F.col("word"), F.lit(BREAK), F.lit(""))
    hyphened = F.replace(F.col("word"), F.lit(BREAK), F.lit("-"))
    trimmed = F.regexp_replace(plain, r"(?U)^[\W_]+|[\W_]+$", "")
    trimmed_hyphened = F.regexp_replace(hyphened, r"(?U)^[\W_]+|[\W_]+$", "")
    kinds = F.concat(
        F.when(F.contains("word", F.lit(BREAK)), F.array(F.lit("hyphen"))).otherwise(F.array().cast("array<string>")),
        F.when((trimmed != F.col("right")) & (trimmed_hyphened != F.col("right")), F.array(F.lit("char"))).otherwise(F.array().cast("array<string>")))
    tokens = words.select("chunk_id", F.explode(kinds).alias("kind"), F.col("right").alias("token"), "word")
    lines = bodies.select("chunk_id", F.lit("line").alias("kind"), F.explode("dropped").alias("token")).withColumn("word", F.col("token"))
    return tokens.unionByName(lines)


def repair(chunks: DataFrame, docs: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(bodies, changes)`` of a corpus."""
    bodies = prepared(chunks, docs)
    lexicon = staged(lexicon_of(bodies, names), "lexicon")
    mended = staged(corrections(lexicon), "mended")
    return bodies, changes(bodies, lexicon, mended)


def repaired(bodies: DataFrame, changed: DataFrame) -> DataFrame:
    """``chunk_id, repaired``: the text of every chunk as continuous paragraphs. The changes of a chunk are bounded by its text."""
    lists = changed.where("kind <> 'line'").select("chunk_id", "word", "token").distinct().groupBy("chunk_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "token"))).alias("mended"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, mended in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                table = dict(mended or ())

                def mend(m: re.Match, table=table) -> str:
                    token = m.group()
                    word = forms(token)
                    right = table.get(word)
                    if right is None:
                        return token.replace(BREAK, "- ")
                    at = token.lower().find(word)
                    return token[:at] + (right.capitalize() if token[at: at + 1].isupper() else right) + token[at + len(word):]

                texts.append(re.sub(r"\S+", mend, body).strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["chunk_id", "repaired"])

    return bodies.select("chunk_id", "body").join(lists, "chunk_id", "left").mapInArrow(run, "chunk_id string, repaired string")
