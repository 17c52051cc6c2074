"""Problem 10: long exact spans shared between records, by seeds, chains and alignment.

1. Seeds. A k-mer is a seed of a window of ``min_len`` characters if its hash is the least of the window's k-mers
   (leftmost on ties). The choice depends on the window's text alone, so two records that share a run of ``min_len``
   characters share the seed of each of its windows, at the same offset. One seed stands for about
   ``(min_len - k) / 2`` windows.
2. Join. Seeds are joined through their hash. A seed's *context* is the text of all windows it stands for. Contexts met in
   two records settle all their windows at once; where a context stands alone although its seed does not (the edge of
   a copied passage), its windows are hashed one by one and joined. A group of equal contexts or windows is only ever
   represented by its first and last record, computed with map-side combining: each member is matched with one of
   those two (the one that is not itself). Matches are linear in the text however large a group of copies is, and
   no window that occurs elsewhere is left out.
3. Chains. The matches of a record with one witness are chained in order of both texts, by a Fenwick tree over the
   witness positions that holds the best score so far, with linear gap costs. Every match ends in one chain.
4. Alignment. Along a chain overlapping matches on one diagonal are laid together; a chain is a fuzzy passage with its
   two extents and the characters in runs. The text between consecutive runs of a chain is aligned globally (longest common
   subsequence, bit-parallel), which gives the characters in which the two extents agree in order (:func:`aligned`). The exact stretches of
   a record are the union of the matches in its chains.

Hashes are 64 bits of a polynomial over code points, finally mixed; equality of runs is equality of such hashes.

Defined results: null texts and texts under ``min_len`` share nothing; rows with one ``doc_id`` are one record (a run that
only recurs in the same record does not count); positions count code points; very long texts are read in overlapping
sections, which gives the same windows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Code points a worker handles at once; longer texts are cut into sections that overlap by ``min_len - 1``.
SECTION = 600_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[size]


class Hashed:
    """Prefix sums over code points that give the hash of any stretch."""

    def __init__(self, points: np.ndarray):
        up, self.down = _powers(len(points) + 1)
        terms = _mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[: len(points)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window the position of its least value, the leftmost on ties."""
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        later = best[step:] < best[:-step]
        best = np.where(later, best[step:], best[:-step])
        at = np.where(later, at[step:], at[:-step])
        span += step
    return at


def seeds_of(ids: list, texts: list[str], min_len: int, k: int):
    """Columns ``record index, position, offset low, offset high, seed, context`` of the seeds of some texts.

    Windows start at ``position - high .. position - low``. Positions are relative to the text.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    points = code_points("".join(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if len(points) < min_len:
        return (np.zeros(0, np.int64),) * 6
    hashed = Hashed(points)
    at = np.arange(len(points) - k + 1)
    grams = hashed.stretch(at, at + k)
    chosen = _sliding_first_min(grams, min_len - k + 1)
    record = np.repeat(np.arange(len(texts)), lengths)
    window = np.flatnonzero(record[: len(chosen)] == record[min_len - 1:])
    chosen, owner = chosen[window], record[window]
    if not len(window):
        return (np.zeros(0, np.int64),) * 6
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]))
    low = window[new]
    high = window[np.concatenate([new[1:], [len(window)]]) - 1]
    position, who = chosen[new].astype(np.int64), owner[new]
    context = _mix(hashed.stretch(low, high + min_len) ^ _mix(((position - low) * 4096 + position - high).astype(np.uint64)))
    return who, position - starts[who], position - high, position - low, grams[position], context


def _sections(ids: list, texts: list, min_len: int) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Groups of texts (or sections of long ones) of about SECTION code points with the offset of each."""
    held_ids, held, offsets, size = [], [], [], 0
    for key, text in zip(ids, texts):
        if key is None or text is None or len(text) < min_len:
            continue
        for at in range(0, max(1, len(text) - min_len + 1), SECTION):
            part = text[at: at + SECTION + min_len - 1]
            held_ids.append(key)
            held.append(part)
            offsets.append(at)
            size += len(part)
            if size >= SECTION:
                yield held_ids, held, np.array(offsets, np.int64)
                held_ids, held, offsets, size = [], [], [], 0
    if held:
        yield held_ids, held, np.array(offsets, np.int64)


class SeedFilter:
    """A Bloom filter of bounded size over 64-bit seeds: it only saves shuffling, the exact join follows."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits // 8, np.uint8)

    def _places(self, seeds: np.ndarray) -> list[np.ndarray]:
        x = seeds.view(np.uint64)
        return [(_mix(x + np.uint64(i * 0x51ED270B)) & self.mask).astype(np.int64) for i in range(3)]

    def add(self, seeds: np.ndarray) -> None:
        for place in self._places(seeds):
            np.bitwise_or.at(self.words, place >> 3, (1 << (place & 7)).astype(np.uint8))

    def holds(self, seeds: np.ndarray) -> np.ndarray:
        hit = np.ones(len(seeds), bool)
        for place in self._places(seeds):
            hit &= (self.words[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return hit


#: The filter's most bits: 8 MB, however many seeds are shared.
FILTER_BITS = 1 << 26


def _filter_of(shared: DataFrame, bits: int) -> SeedFilter:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SeedFilter(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([own.words.tobytes()], pa.binary())], names=["words"])

    whole = SeedFilter(bits)
    parts = shared.coalesce(4).mapInArrow(run, "words binary")
    for row in parts.toLocalIterator():  # four parts of at most 8 MB, one at a time
        whole.words |= np.frombuffer(bytes(row.words), np.uint8)
    return whole


def _scan(docs: DataFrame, min_len: int, k: int, known=None) -> DataFrame:
    """The seeds of all texts: only hash and record, or, given a filter, everything of the seeds that it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        if known is not None:
            words, bits = known.value
            keep = SeedFilter(bits)
            keep.words = np.frombuffer(words, np.uint8)
        for batch in batches:
            for ids, texts, offsets in _sections(batch.column(0).to_pylist(), batch.column(1).to_pylist(), min_len):
                who, position, low, high, seed, context = seeds_of(ids, texts, min_len, k)
                ids = np.array(ids, np.int64)
                seed = seed.view(np.int64)
                if keep is None:
                    yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ids[who])], names=["seed", "doc"])
                    continue
                hit = keep.holds(seed)
                who = who[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[hit]), pa.array(ids[who]), pa.array(context.view(np.int64)[hit]),
                     pa.array((position[hit] + offsets[who]).astype(np.int64)), pa.array(low[hit].astype(np.int32)),
                     pa.array(high[hit].astype(np.int32))], names=["seed", "doc", "context", "position", "low", "high"])

    schema = "seed bigint, doc bigint" + ("" if known is None else ", context bigint, position bigint, low int, high int")
    return docs.mapInArrow(run, schema)


def _windows(docs: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """The windows of the wanted seeds, hashed one by one: ``hash, doc, start, doc2, shift, own``.

    Texts are cut to the stretches that hold wanted windows, section by section, before they meet their wishes, so neither a text nor the wishes
    of a record come to a worker whole.
    """
    reach = wanted.withColumn("section", F.floor(F.col("position") / SECTION))
    lists = reach.groupBy("doc", "section").agg(
        F.min(F.col("position") - F.col("high")).alias("from"), F.max(F.col("position") - F.col("low")).alias("to"),
        F.collect_list(F.struct("position", "low", "high", "doc2", "shift", "own")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for doc, base, text, wishes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hashed = Hashed(code_points(text))
                for wish in wishes:
                    start = np.arange(wish["position"] - wish["high"], wish["position"] - wish["low"] + 1)
                    columns.append((hashed.stretch(start - base, start - base + min_len).view(np.int64), np.full(len(start), doc), start,
                                    np.full(len(start), wish["doc2"]), np.full(len(start), wish["shift"]),
                                    np.full(len(start), wish["own"])))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns)],
                                                 names=["hash", "doc", "start", "doc2", "shift", "own"])

    joined = docs.withColumnRenamed("doc_id", "doc").join(lists, "doc")
    stretch = F.substring(F.col("text"), (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from") + min_len).cast("int"))
    return joined.select("doc", "from", stretch.alias("stretch"), "w").mapInArrow(
        run, "hash bigint, doc bigint, start bigint, doc2 bigint, shift bigint, own boolean")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200,
            k: int = 100) -> DataFrame:
    """``doc, start, end, other, other_start``: exact runs of each record, each with one other record that holds it.

    The union of a record's runs is exactly what it shares in runs of ``min_len`` or more.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(
        F.length("text") >= min_len)
    shared = staged(_scan(docs, min_len, k).groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
                    .where("a <> b").select("seed"), "seeds")
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * shared.count() + 1).bit_length()))
    known = _filter_of(shared, bits)
    known = spark.sparkContext.broadcast((known.words.tobytes(), bits))  # 8 MB at most
    found = staged(_scan(docs, min_len, k, known).join(shared, "seed", "left_semi"), "found")
    end = F.struct("doc", "position")
    contexts = staged(found.groupBy("seed", "context").agg(
        F.min(end).alias("first"), F.max(end).alias("last"), F.min("low").alias("low"), F.min("high").alias("high")), "contexts")
    alone = F.col("first.doc") == F.col("last.doc")
    settled = found.join(contexts.where(~alone).select("seed", "context", "first", "last"), ["seed", "context"])
    other = F.when(F.col("first.doc") != F.col("doc"), F.col("first")).otherwise(F.col("last"))
    whole = settled.withColumn("other", other).select(
        "doc", (F.col("position") - F.col("high")).alias("start"), (F.col("position") - F.col("low") + min_len).alias("end"),
        F.col("other.doc").alias("other"), (F.col("other.position") - F.col("high")).alias("other_start"))
    lonely = contexts.where(alone).select("seed", "context")
    edges = found.join(lonely, ["seed", "context"], "left_semi").select(
        "doc", "position", "low", "high", F.col("doc").alias("doc2"), F.lit(0).cast("bigint").alias("shift"), F.lit(True).alias("own"))
    peers = contexts.where(~alone).join(lonely.select("seed").distinct(), "seed", "left_semi").select(
        F.col("first.doc").alias("doc"), F.col("first.position").alias("position"), "low", "high",
        F.col("last.doc").alias("doc2"), (F.col("last.position") - F.col("first.position")).alias("shift"), F.lit(False).alias("own"))
    windows = staged(_windows(docs, edges.unionByName(peers), min_len), "windows")
    both = windows.groupBy("hash").agg(
        F.min(F.struct("doc", "start")).alias("first"),
        F.max(F.struct(F.col("doc2").alias("doc"), (F.col("start") + F.col("shift")).alias("start"))).alias("last")).where(
        "first.doc <> last.doc")
    single = windows.where("own").join(both, "hash").withColumn("other", other).select(
        "doc", "start", (F.col("start") + min_len).alias("end"), F.col("other.doc").alias("other"),
        F.col("other.start").alias("other_start"))
    return whole.unionByName(single)


def lay_together(start: np.ndarray, end: np.ndarray, other_start: np.ndarray) -> list[tuple[int, int, int]]:
    """Overlapping or touching matches on one diagonal as one match; the input is of one pair of records."""
    shift = other_start - start
    order = np.lexsort((start, shift))
    start, end, shift = start[order], end[order], shift[order]
    cut = [0]
    reach = end[0]
    for i in range(1, len(start)):
        if shift[i] != shift[i - 1] or start[i] > reach:
            cut.append(i)
            reach = end[i]
        else:
            reach = max(reach, end[i])
    cut.append(len(start))
    return sorted((int(start[a]), int(end[a:b].max()), int(start[a] + shift[a])) for a, b in zip(cut, cut[1:]))


class Fenwick:
    """Prefix maxima with their owner."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def top(self, place: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while place > 0:
            if self.best[place] > found:
                found = self.best[place]
            place -= place & -place
        return found


def chain(runs: list[tuple[int, int, int]], gap_cost: float = 0.5) -> list[list[tuple[int, int, int]]]:
    """Chains of ``(start, end, other_start)`` in order of both texts; every run ends in exactly one chain.

    A run's score is its length plus the best earlier chain less the gaps to it in both texts times ``gap_cost``; a
    chain is only continued where that gains. Runs may overlap their predecessor; the overlap is not counted twice.
    """
    if len(runs) == 1:
        return [runs]
    runs = sorted(runs)
    places = {p: i + 1 for i, p in enumerate(sorted({r[2] for r in runs}))}
    tree, before, score, taken = Fenwick(len(places)), [-1] * len(runs), [0.0] * len(runs), set()
    for i, (start, end, other) in enumerate(runs):
        length = end - start
        potential, j = tree.top(places[other] - 1)
        score[i] = length
        if j >= 0:
            gain = potential - gap_cost * (start + other)
            if gain > 0:
                score[i] += gain
                before[i] = j
        tree.put(places[other], (score[i] + gap_cost * (end + other + length), i))
    chains = []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        links = []
        while i >= 0 and i not in taken:
            taken.add(i)
            links.append(runs[i])
            i = before[i]
        if links:
            chains.append(links[::-1])
    return chains


def passages(found: DataFrame, gap_cost: float = 0.5) -> DataFrame:
    """The fuzzy passages: ``doc, start, end, other, other_start, other_end, exact, runs array<struct<start,end,other_start,other_end>>``.

    ``found`` is from :func:`matches`. The rows of a record come to one task, sorted by witness; they number at most one
    in ``(min_len - k) / 2`` characters of it plus its edges.
    """
    def of_pair(doc: int, other: int, start, end, other_start) -> Iterator[tuple]:
        for links in chain(lay_together(start, end, other_start), gap_cost):
            exact, reach = 0, -1
            for a, b, _ in links:
                exact += max(0, b - max(a, reach))
                reach = max(reach, b)
            yield (doc, links[0][0], max(x[1] for x in links), other, links[0][2],
                   max(x[2] + x[1] - x[0] for x in links), exact, [{"start": a, "end": b, "other_start": c, "other_end": c + b - a} for a, b, c in links])

    names = ["doc", "start", "end", "other", "other_start", "other_end", "exact", "runs"]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "other_start", "other_end")]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            data = np.stack([c.to_numpy() for c in batch.columns])
            held = data if held is None else np.concatenate([held, data], axis=1)
            if not held.shape[1]:
                continue
            new = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
            if len(new):
                yield built(held[:, : new[-1]], new[:-1])
                held = held[:, new[-1]:]
        if held is not None and held.shape[1]:
            yield built(held, np.zeros(0, np.int64))

    def built(data: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        bounds = [0, *new.tolist(), data.shape[1]]
        rows = [r for a, b in zip(bounds, bounds[1:]) for r in of_pair(int(data[0, a]), int(data[1, a]), *data[2:, a:b])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    columns = found.select("doc", "other", "start", "end", "other_start")
    return columns.repartition("doc").sortWithinPartitions("doc", "other").mapInArrow(
        run, "doc bigint, start bigint, end bigint, other bigint, other_start bigint, other_end bigint, exact bigint, "
             "runs array<struct<start:bigint,end:bigint,other_start:bigint,other_end:bigint>>")


def agreeing(a: str, b: str) -> int:
    """The length of the longest common subsequence of two texts, a machine word of columns at a time."""
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if not a:
        return start
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return start + len(a) - row.bit_count()


def aligned(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages with ``agree`` (characters in which the extents agree in order: the runs and what the gaps between them align to) and
    ``identity`` (of the longer extent).

    Only the texts of records whose chains have gaps are joined, and only the gaps go on from there. Runs that overlap in one of the texts
    leave no gap in it. A chain's gaps are bounded by its score.
    """
    found = found.withColumn("__p", F.xxhash64("doc", "other", "start", "end", "other_start", "other_end"))
    ends = F.arrays_zip(F.slice("runs", 1, F.size("runs") - 1).alias("x"), F.slice("runs", 2, F.size("runs") - 1).alias("y"))
    gaps = staged(found.where(F.size("runs") > 1).select("__p", "doc", "other", F.posexplode(ends).alias("n", "g")).select(
        "__p", "n", "doc", "other", F.col("g.x.end").alias("a"), F.col("g.y.start").alias("b"),
        F.col("g.x.other_end").alias("c"), F.col("g.y.other_start").alias("d")).where("b > a AND d > c"), "gaps")
    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("bigint").alias("__doc"), F.col(text_col).alias("__text"))
    cut = lambda a, b: F.substring(F.col("__text"), (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    own = gaps.join(texts.dropDuplicates(["__doc"]), F.col("doc") == F.col("__doc")).select("__p", "n", "other", "c", "d", cut("a", "b").alias("own"))
    both = own.join(texts.dropDuplicates(["__doc"]), F.col("other") == F.col("__doc")).select("__p", "own", cut("c", "d").alias("theirs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [agreeing(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.int64())], names=["__p", "same"])

    sums = both.mapInArrow(run, "__p bigint, same bigint").groupBy("__p").agg(F.sum("same").alias("same"))
    longer = F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))
    agree = F.least(longer, F.col("exact") + F.coalesce("same", F.lit(0)))
    return found.join(sums, "__p", "left").withColumn("agree", agree).withColumn("identity", agree / longer).drop("__p", "same")


def shared_spans(found: DataFrame) -> DataFrame:
    """``doc_id, span_start, span_end``: the exact runs of all passages, overlapping or touching ones as one stretch."""
    runs = found.select("doc", F.explode("runs").alias("r")).select("doc", "r.start", "r.end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch])
            if not len(held):
                continue
            last = held["doc"].iloc[-1]
            yield merged(held[held["doc"] != last])
            held = held[held["doc"] == last]
        if len(held):
            yield merged(held)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"doc_id": [], "span_start": [], "span_end": []}, dtype="int64")
        doc, start, end = (rows[c].to_numpy() for c in ("doc", "start", "end"))
        far = np.int64(1) << 40
        order = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * far
        reach = np.maximum.accumulate(end + order)
        new = np.flatnonzero(np.concatenate([[True], start[1:] + order[1:] > reach[:-1]]))
        stop = np.concatenate([new[1:], [len(doc)]]) - 1
        return pd.DataFrame({"doc_id": doc[new], "span_start": start[new], "span_end": reach[stop] - order[stop]})

    return runs.repartition("doc").sortWithinPartitions("doc", "start").mapInPandas(
        run, "doc_id bigint, span_start bigint, span_end bigint")


def shared_part(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, shared_chars, share`` of every record: how much of it stands elsewhere."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"))
    joined = sizes.join(sums, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
