"""Problem 7: linking the variant spellings of names.

1. Reading. Each name is taken apart by its type into a *core* (the rare word that makes the name) and *roles* (given name,
   field and kind of an organisation, number of an event and so on); order, titles, brackets, case and accents go here.
2. Sparse join. The distinct names of a type (core and roles, their words in alphabetical order, so that reordered parts are the same) become
   vectors of character n-grams weighted by inverse frequency, of length one. All pairs with a cosine of ``floor`` or more come from a distributed
   join: n-grams are ordered from rare to frequent, and two vectors so alike share one among the first of each, before the rest of a vector
   gets shorter than ``floor``. So frequent n-grams make no pairs, and no pair is lost. There is no top-n: every link over the
   threshold is kept. Short names, in which one edit spoils most n-grams, meet through an equi-join on cores shortened by as many letters as edits are allowed.
3. Components of linked cores, by rounds of joins whose state is written to the shared folder.
4. Average-linkage clustering of the distinct readings of a component. The similarity compares cores by edits and roles by
   equality, abbreviation, initial, nickname or edits, for persons also with family and given name changed over; readings that contradict
   each other (roles, numbers, or domains of different entries) are never merged. Each merge costs the readings of the component once.

Rows of one spelling, type and domain entry are one reading, so that copies cost nothing until the result is written.

Defined results: rows with a null or blank name or null type link to nothing; repeated ids count once; a null, blank or unmatched
domain says nothing; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..session import staged
from .canonical import NONE, Canonicaliser, edits

# Titles and suffixes of persons.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md msc bsc jr sr esq hon rev".split())
# Familiar forms of given names.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "sasha": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony",
    "bea": "beatrice", "ben": "benjamin", "cathy": "catherine", "charlie": "charles charlotte", "lottie": "charlotte",
    "chris": "christopher christine", "kit": "christopher", "topher": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david",
    "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dot": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward",
    "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth",
    "lizzie": "elizabeth", "eliza": "elizabeth", "fran": "frances", "frank": "francis", "fred": "frederick", "freddie": "frederick",
    "george": "george", "gina": "georgina", "greg": "gregory", "hal": "harold", "harry": "harold", "hank": "henry", "jim": "james",
    "jimmy": "james", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jack": "john", "johnny": "john", "jon": "jonathan",
    "joe": "joseph", "josh": "joshua", "juergen": "jurgen", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine",
    "kay": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "maggie": "margaret",
    "meg": "margaret", "peggy": "margaret", "marge": "margaret", "matt": "matthew", "mick": "michael", "mike": "michael", "mickey": "michael",
    "nick": "nicholas", "nicky": "nicholas", "ollie": "oliver", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia",
    "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond", "becky": "rebecca", "dick": "richard",
    "rich": "richard", "rick": "richard", "ricky": "richard", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert",
    "ron": "ronald", "sam": "samuel samantha", "sammy": "samuel", "sandy": "alexander", "steve": "steven stephen", "sue": "susannah susan",
    "susie": "susannah susan", "suzy": "susannah", "tom": "thomas", "tim": "timothy", "vic": "victor victoria", "vicky": "victoria",
    "tori": "victoria", "val": "valerie", "bill": "william", "billy": "william", "will": "william", "liam": "william", "zach": "zachary",
    "zack": "zachary", "zac": "zachary"}
# Kinds of organisations, places, events and devices, with their abbreviations.
KINDS = {
    "ORG": {"institute": "inst", "university": "univ", "laboratory": "lab", "foundation": "fdn", "corporation": "corp", "company": "co",
            "association": "assoc", "department": "dept", "society": "soc", "centre": "ctr", "council": "cncl", "agency": "agcy",
            "school": "sch", "college": "coll", "academy": "acad", "committee": "cttee", "group": "grp", "office": "off"},
    "LOCATION": {"port": "pt", "fort": "ft", "lake": "l", "mount": "mt", "saint": "st", "cape": "c", "river": "r", "island": "is"},
    "EVENT": {"congress": "cong", "forum": "for", "symposium": "symp", "regatta": "reg", "conference": "conf", "workshop": "wksp",
              "festival": "fest", "meeting": "mtg", "fair": "fr"},
    "TECHNOLOGY": {"engine": "eng", "controller": "ctrl", "protocol": "prot", "encoder": "enc", "reader": "rdr", "sensor": "sens",
                   "framework": "fw", "analyser": "anal", "device": "dev"}}
# Ordinal words.
ORDINALS = {w: i + 1 for i, w in enumerate("""first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth
thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth""".split())}
_ROMAN = re.compile(r"(?=[ivxl])(xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_TOKEN = re.compile(r"[^\W_]+|[,:#()]")


# Bits of a key's hash when it is counted (whole bytes), and bits of the filter of keys that come twice (8 MB).
HASH_BITS, FILTER_BITS = 40, 26

_WORDS = frozenset(w for words in KINDS.values() for w in words)


def _near(word: str, words, most: int = 1) -> str | None:
    if word in words:
        return word
    if len(word) < 4:
        return None
    near = [w for w in words if edits(word, w, most) <= most]
    return near[0] if len(near) == 1 else None


def _roman(word: str) -> int | None:
    if not _ROMAN.match(word):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50}
    total = 0
    for a, b in zip(word, word[1:] + " "):
        total += -value[a] if value.get(b, 0) > value[a] else value[a]
    return total


def plain(name: str) -> str:
    name = name.replace("™", " ").replace("®", " ")
    name = "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) != "Cf")
    name = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", name)
    name = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))
    return re.sub(r"[’'`´]s\b", " 's ", name)


def _kind_of(word: str, kinds: dict[str, str]) -> str | None:
    for full, short in kinds.items():
        if word in (full, short, full + "s"):
            return full
    for full in kinds:
        if len(word) >= 3 and full.startswith(word):
            return full
    return _near(word, kinds)


def read(name: str, kind: str) -> tuple[str, tuple[str, ...]]:
    """``(core, roles)`` of a name; roles are in a fixed order by type and may be empty strings."""
    text = plain(name)
    possessive = " 's " in text
    tokens = _TOKEN.findall(text.replace(" 's ", " \x00 ")) if not possessive else re.findall(r"[^\W_]+|[,:#()\x00]",
                                                                                                text.replace(" 's ", " \x00 "))
    if kind == "EVENT":
        number, words, after, comma = None, [], None, False
        for t in tokens:
            m = re.fullmatch(r"(\d+)(?:st|nd|rd|th)?", t)
            if m and number is None:
                number = int(m.group(1))
            elif t == ",":
                comma = True
            elif t in "()#:" or t in ("the", "no", "nr", "number", "of"):
                continue
            elif number is None and (w := _near(t, ORDINALS)):
                number = ORDINALS[w]
            else:
                words.append(t)
        if number is None and len(words) > 1 and (n := _roman(words[-1])):
            number = n
            words = words[:-1]
        kinds = [(i, k) for i, t in enumerate(words) if (k := _kind_of(t, KINDS["EVENT"]))]
        at = (kinds[0] if comma else kinds[-1]) if kinds and len(words) > 1 else None
        core = [t for i, t in enumerate(words) if at is None or i != at[0]]
        return " ".join(core), (at[1] if at else "", str(number) if number is not None else "")
    depth, kept, inside = 0, [], []
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t not in "()":
            (inside if depth > 0 else kept).append(t)
    tokens = kept or inside
    if kind == "PERSON":
        words = [t for t in tokens if t not in TITLES and t not in ":#\x00"]
        while words and words[-1] == ",":
            words.pop()
        if "," in words:
            at = words.index(",")
            last, first = words[:at], [t for t in words[at + 1:] if t != ","]
        else:
            last, first = words[-1:], words[:-1]
        if not last and first:
            last, first = first[-1:], first[:-1]
        return " ".join(last), (first[0] if first else "",)
    if kind == "ORG":
        words = [t for t in tokens if t not in (":", "#", "\x00")]
        if len(words) > 1 and words[0] == "the":
            words = words[1:]
        first = _kind_of(words[0], KINDS["ORG"]) if words else None
        if first and len(words) > 2 and words[1] == "of":
            rest = words[2:]
            if "," in rest:
                at = rest.index(",")
                return " ".join(t for t in rest[at + 1:] if t != ","), (" ".join(rest[:at]), first)
            return " ".join(rest[-1:]), (" ".join(rest[:-1]), first)
        words = [t for t in words if t != ","]
        if len(words) == 2 and 2 <= len(words[1]) <= 3 and not _kind_of(words[1], {k: v for k, v in KINDS["ORG"].items() if v != "co"}):
            return words[0], (words[1][0] + ".", words[1][-1] + ".")
        last = _kind_of(words[-1], KINDS["ORG"]) if len(words) > 1 else None
        if last:
            return words[0], (" ".join(words[1:-1]), last)
        if len(words) == 2 and words[0] in KINDS["LOCATION"]:
            return words[1], ("", words[0])
        return " ".join(words[:1]), (" ".join(words[1:]), "")
    if kind == "LOCATION":
        words = [t for t in tokens if t not in (":", "#", "\x00", "of", ",", "the")]
        for i, t in enumerate(words):
            if len(words) > 1 and (k := next((f for f, s in KINDS["LOCATION"].items() if t in (f, s)), None) or (
                    i in (0, len(words) - 1) and _near(t, KINDS["LOCATION"]))):
                return " ".join(words[:i] + words[i + 1:]), (k,)
        return " ".join(words), ("",)
    # technologies, concepts and anything else
    words = [t for t in tokens if t != "#"]
    if words and words[0] == "the":
        words = words[1:]
    if ":" in words:
        at = words.index(":")
        return " ".join(t for t in words[at + 1:] if t not in ",:\x00"), ("", _single(" ".join(words[:at])))
    if "\x00" in words:
        at = words.index("\x00")
        rest = [t for t in words[at + 1:] if t not in ",\x00"]
        return " ".join(words[:at]), (" ".join(rest[:-1]), _single(rest[-1]) if rest else "")
    if "," in words:
        at = words.index(",")
        before, rest = words[:at], [t for t in words[at + 1:] if t != ","]
        return " ".join(before[:-1] or before), (" ".join(rest), _single(before[-1]) if len(before) > 1 else "")
    if len(words) >= 3:
        return " ".join(words[1:-1]), (words[0], _single(words[-1]))
    if len(words) == 2:
        return words[0], ("", _single(words[1]))
    word = words[0] if words else ""
    for full in KINDS["TECHNOLOGY"]:
        if word.endswith(full) and len(word) > len(full) + 3:
            return word[: -len(full)], ("", full)
    return word, ("", "")


def _single(word: str) -> str:
    word = word.strip()
    return word[:-1] if len(word) > 5 and word.endswith("s") and _near(word[:-1], KINDS["TECHNOLOGY"]) else word


def _role(a: str, b: str) -> float | None:
    """Cost of taking two words for one role, or None if they contradict each other."""
    if a == b:
        return 0.0
    if not a or not b:
        return 0.25
    x, y = a.rstrip("."), b.rstrip(".")
    short, long = sorted((x, y), key=len)
    if long.startswith(short):
        return 0.1 if len(short) > 2 else 0.2
    if len(short) < 4:
        return None
    most = 1 if len(short) < 8 else 2
    distance = edits(short, long, most)
    if distance <= most:
        return 0.1 * distance
    cut = long[: len(short)]
    return 0.25 if len(short) < len(long) and edits(short, cut, 1) <= 1 else None


def _given(a: str, b: str) -> float | None:
    cost = _role(a, b)
    forms = [{w, *NICKNAMES.get(w, "").split()} for w in (a, b)]
    if forms[0] & forms[1]:
        return min(0.05, cost) if cost is not None else 0.05
    if cost is not None:
        return cost
    for x, others in ((a, forms[1]), (b, forms[0])):
        if len(x) == 1 and any(o.startswith(x) for o in others):
            return 0.2
    near = [n for w, n in ((a, b), (b, a)) for full in NICKNAMES.get(w, "").split() if len(full) > 4 and edits(full, n, 1) <= 1]
    near += [n for w, n in ((a, b), (b, a)) if len(w) > 3 and any(
        len(k) > 3 and edits(w, k, 1) <= 1 and n in f.split() for k, f in NICKNAMES.items())]
    return 0.15 if near else None


def _most_edits(core: str) -> int:
    return 0 if len(core) < 4 else 1 if len(core) < 7 else 2


def similarity(a: tuple, b: tuple, kind: str) -> float | None:
    """Of two readings ``(core, roles, entry)``: at most one, or None if they contradict each other."""
    if a[2] and b[2] and a[2] != b[2]:
        return None
    straight = _similarity(a, b, kind)
    if kind == "PERSON" and not straight and all(x[0] and x[1][0] and " " not in x[0] for x in (a, b)) and len(a[1][0]) > 1 and len(b[1][0]) > 1:
        # Family and given name may have changed places without a comma; then both must fit.
        crossed = _similarity((b[1][0], (b[0],), b[2]), a, kind)
        if crossed:
            return max(0.0, crossed - 0.1)
    return straight


def _similarity(a: tuple, b: tuple, kind: str) -> float | None:
    cost = 0.0
    for i, (x, y) in enumerate(zip(a[1], b[1])):
        if kind == "EVENT" and i == 1:
            c = 0.0 if x == y else 0.3 if not x or not y else None
        elif x != y and x in _WORDS and y in _WORDS:
            c = None
        else:
            c = _given(x, y) if kind == "PERSON" else _role(x, y)
        if c is None:
            return None
        cost += c
    most = _most_edits(min(a[0], b[0], key=len))
    distance = edits(a[0], b[0], most)
    if distance > most:
        return 0.0
    return max(0.0, 1 - cost - 0.12 * distance)


def average_linkage(nodes: list[tuple], weights: list[int], kind: str, least: float) -> list[int]:
    """A cluster number for each reading: merges the two clusters of highest mean similarity while it is ``least`` or more.

    Pairs weigh by the rows behind them. Clusters that hold readings contradicting each other stay apart. On ties the heavier
    pair of clusters goes first, then the first in order.
    """
    n = len(nodes)
    total = np.zeros((n, n))
    barred = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            s = similarity(nodes[i], nodes[j], kind)
            barred[i, j] = barred[j, i] = s is None
            total[i, j] = total[j, i] = (s or 0.0) * weights[i] * weights[j]
    weight = np.array(weights, float)
    label, alive = np.arange(n), np.ones(n, bool)
    np.fill_diagonal(barred, True)
    mean = np.where(barred, -1.0, total / (weight[:, None] * weight))
    best = mean.max(axis=1) if n else np.zeros(0)
    while alive.sum() > 1:
        top = best.max()
        if top < least:
            break
        rows = np.flatnonzero(best >= top - 1e-9)
        ties = [(a, b) for a in rows for b in np.flatnonzero(mean[a] >= top - 1e-9) if a < b]
        i, j = max(ties, key=lambda p: (weight[p[0]] + weight[p[1]], -p[0], -p[1]))
        total[i] += total[j]
        total[:, i] = total[i]
        barred[i] |= barred[j]
        barred[:, i] = barred[i]
        barred[i, i] = True
        weight[i] += weight[j]
        alive[j] = False
        label[label == j] = i
        stale = np.flatnonzero(np.isclose(mean[:, i], best) | np.isclose(mean[:, j], best))
        mean[j], mean[:, j] = -1.0, -1.0
        mean[i] = np.where(barred[i] | ~alive, -1.0, total[i] / (weight[i] * weight))
        mean[:, i] = mean[i]
        best[j] = -1.0
        best = np.maximum(best, mean[:, i])
        for row in {i, *stale.tolist()}:
            best[row] = mean[row].max()
    return label.tolist()


def spelled(core: str, roles: str) -> str:
    """The words of a reading in alphabetical order."""
    return " ".join(sorted({w for w in f"{core} {roles}".replace("\x01", " ").replace(".", " ").split()}))


def grams(name: str, n: int = 4) -> list[str]:
    """The character n-grams of a name's words, each word with its ends marked."""
    return sorted({w[i:i + n] for w in (f"^{x}$" for x in name.split()) for i in range(max(1, len(w) - n + 1))})


def readings(rows: DataFrame, entries: list, id_col: str = "entity_id") -> DataFrame:
    """``id, type, core, roles, entry`` of the rows that have a name and a type."""
    made: list[Canonicaliser] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Canonicaliser(entries))
        for batch in batches:
            ids, names, kinds, domains = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i, name, kind, domain in zip(ids, names, kinds, domains):
                core, roles = read(name, kind)
                entry = made[0](domain) if domain and domain.strip() else None
                if core:
                    out.append((i, kind, core, "\x01".join(roles), entry if entry != NONE else None))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.string()] * 4])],
                    names=["id", "type", "core", "roles", "entry"])

    named = rows.where(F.col("name").isNotNull() & F.col("type").isNotNull() & F.col(id_col).isNotNull())
    return named.select(F.col(id_col).cast("bigint").alias("id"), "name", "type", "domain").mapInArrow(
        run, "id bigint, type string, core string, roles string, entry string")


def shortened(core: str) -> set[str]:
    """A core without as many letters as edits are allowed in it, or fewer: two cores so many edits apart (swaps too) have one in common."""
    out = {core}
    for _ in range(_most_edits(core)):
        out |= {c[:i] + c[i + 1:] for c in out for i in range(len(c))}
    return out


def _shortened_keys(kinds: list[str], cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The place of a core in the list and a hash of its type and the shortened core, for each shortened form of cores that take edits."""
    forms = [shortened(c) if _most_edits(c) else () for c in cores]
    at = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
    kind = _hashed(kinds) * np.uint64(0x9E3779B97F4A7C15)
    return at, _hashed([k for f in forms for k in f]) ^ kind[at]


def _hashed(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def _met_keys(cores: DataFrame) -> np.ndarray:
    """A filter of ``2 ** FILTER_BITS`` bits with the bits of all keys that come from two cores, and of a few more.

    Almost no key does, so it is their hashes that are shuffled: sorted by blocks, as differences, two or three bytes each.
    """
    some = max(4, min(16, int(cores.count() // 60_000).bit_length()))  # some 4 million keys a slice of the hashes
    edges = np.arange(2 ** some + 1, dtype=np.uint64) << np.uint64(HASH_BITS - some)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_shortened_keys(*(x.to_pylist() for x in batch.columns))[1] >> np.uint64(64 - HASH_BITS))
            if sum(map(len, held)) > 4_000_000:
                yield sliced(np.sort(np.concatenate(held)))
                held = []
        if held:
            yield sliced(np.sort(np.concatenate(held)))

    def sliced(keys: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(keys, edges)
        steps = [np.diff(keys[i:j], prepend=edge) for i, j, edge in zip(ends, ends[1:], edges)]
        # The bytes of one rank lie together, so that those of the high ranks, mostly zeros, take next to nothing.
        packed = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BITS // 8].T).tobytes() for x in steps]
        return pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "keys"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for at, packed in zip(*(x.to_pylist() for x in batch.columns)):
                if at != last and held:
                    yield marked(last, held)
                    held = []
                last = at
                held.append(packed)
        if held:
            yield marked(last, held)

    def marked(at: int, held: list[bytes]) -> pa.RecordBatch:
        keys = []
        for packed in held:
            steps = np.zeros((len(packed) * 8 // HASH_BITS, 8), np.uint8)
            steps[:, :HASH_BITS // 8] = np.frombuffer(packed, np.uint8).reshape(HASH_BITS // 8, -1).T
            keys.append(np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64))
        found = np.sort(np.concatenate(keys))
        found = found[1:][found[1:] == found[:-1]] >> np.uint64(HASH_BITS - FILTER_BITS)
        bits = np.zeros(2 ** (FILTER_BITS - some), np.uint8)
        bits[found] = 1
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    sent = cores.select("type", "core").mapInArrow(told, "slice int, keys binary")
    found = sent.repartition(2 ** some, "slice").sortWithinPartitions("slice").mapInArrow(twice, "slice int, bits binary")
    known = np.zeros((2 ** some, 2 ** (FILTER_BITS - some) // 8), np.uint8)
    for row in found.toLocalIterator():
        known[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return known.ravel()


def near_cores(cores: DataFrame) -> DataFrame:
    """``a, b`` of all cores of one type whose edit distance is as small as ``similarity`` takes, by an equi-join on shortened cores."""
    known = cores.sparkSession.sparkContext.broadcast(_met_keys(cores))  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, forms = (x.to_pylist() for x in batch.columns)
            at, keys = _shortened_keys(kinds, forms)
            place = keys >> np.uint64(64 - FILTER_BITS)
            met = (known.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if met.any():
                at = at[met].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([forms[i] for i in at]),
                                                  pa.array(keys[met].view(np.int64))], names=["core_id", "core", "key"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                most = _most_edits(min(x, y, key=len))
                if most and edits(x, y, most) <= most:
                    near.append((a, b))
            if near:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*near)], names=["a", "b"])

    keyed = staged(cores.select("core_id", "type", "core").mapInArrow(run, "core_id bigint, core string, key bigint"), "shortened")
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.core_id") < F.col("y.core_id"))).select(
        F.col("x.core_id").alias("a"), F.col("y.core_id").alias("b"), F.col("x.core").alias("ca"), F.col("y.core").alias("cb")).distinct()
    return pairs.mapInArrow(check, "a bigint, b bigint")


def _grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each text, a type and a name, has, and a hash of type and n-gram for all of them in order."""
    found = [(t, grams(n)) for t, _, n in (x.rpartition("\x01") for x in texts)]
    return np.array([len(g) for _, g in found], np.int64), _hashed([f"{t}\x01{g}" for t, gs in found for g in gs]).view(np.int64)


class _Vectors:
    """Vectors of length one of some names: n-grams, rare ones first (the same order everywhere), and what is left of a vector from each on."""

    def __init__(self, texts: list[str], often: np.ndarray, total: float) -> None:
        """``often`` has in how many names each n-gram of ``_grams_of`` is."""
        self.size, gram = _grams_of(texts)
        own = np.repeat(np.arange(len(texts)), self.size)
        order = np.lexsort((gram, often, own))
        self.own, self.gram, self.often = own, gram[order], often[order]
        self.begin = np.cumsum(self.size) - self.size
        w = np.log1p(total / self.often)
        self.w = w / np.sqrt(np.bincount(own, w * w, len(texts)))[own]
        square = self.w * self.w
        before = np.cumsum(square) - square
        self.rest = np.sqrt(np.maximum(0.0, 1 - before + before[self.begin[own]])) if len(own) else square

    def alike(self, x: np.ndarray, y: np.ndarray | None, gram: int, often: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the names ``x`` among themselves or with ``y``, all with ``gram``: places in ``x`` and ``y`` and cosine of those alike that share no n-gram before it."""
        rows = x if y is None else np.concatenate([x, y])
        size = self.size[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) + np.repeat(self.begin[rows] - np.cumsum(size) + size, size)
        _, shown, column = np.unique(self.gram[at], return_index=True, return_inverse=True)
        held = np.zeros((len(rows), len(shown)))
        held[row, column] = self.w[at]
        right = held if y is None else held[len(x):]
        cosine = held[:len(x)] @ right.T
        a, b = np.nonzero((np.triu(cosine, 1) if y is None else cosine) >= floor)
        if len(a):
            n, g = self.often[at[shown]], self.gram[at[shown]]
            early = (held[:, (n < often) | ((n == often) & (g < gram))] > 0).astype(np.float32)
            first = (early[:len(x)] @ (early if y is None else early[len(x):]).T)[a, b] == 0
            a, b = a[first], b[first]
        return a, b, cosine[a, b]


def _dealt(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def alike_names(names: DataFrame, floor: float = 0.7, known: int = 1_000_000, block: int = 8_192) -> DataFrame:
    """``a, b, cosine`` of all names of one type whose weighted n-gram vectors have a cosine of ``floor`` or more.

    ``names`` has ``name_id, type, name``, each name of a type once. Candidates are checked where they meet, from the names themselves, and
    leave at their rarest common n-gram only; so neither candidates nor vectors are shuffled. Names with one n-gram meet in blocks of
    ``block``. The counts of n-grams are broadcast; where more than ``known`` n-grams are in two names or more, each name carries its own.
    """
    spark = names.sparkSession
    texts = names.select("name_id", F.concat("type", F.lit("\x01"), "name").alias("text"))
    total = float(max(1, names.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_grams_of(batch.column(0).to_pylist())[1])
            if sum(map(len, held)) > 2_000_000:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, np.unique(np.concatenate(held), return_counts=True))], names=["gram", "n"])

    counts = staged(texts.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"), "counts")
    held = None
    if counts.count() <= known:
        shared = counts.orderBy("gram").toPandas()
        held = spark.sparkContext.broadcast((shared["gram"].to_numpy(np.int64), shared["n"].to_numpy(np.int64)))  # 16 MB at most
        texts = texts.withColumn("often", F.lit(None).cast("array<bigint>"))
    else:
        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, gram = _grams_of(batch.column(1).to_pylist())
                own = np.repeat(np.arange(len(size)), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(np.arange(len(own)) - (np.cumsum(size) - size)[own]), pa.array(gram)],
                                                 names=["name_id", "at", "gram"])

        posted = texts.mapInArrow(post, "name_id bigint, at bigint, gram bigint").join(counts, "gram", "left")
        # A name's list is bounded by its length.
        own = posted.groupBy("name_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(1)).alias("n")))).alias("v"))
        texts = texts.join(own.select("name_id", F.col("v.n").alias("often")), "name_id")

    def vectors(names: list[str], often: list) -> _Vectors:
        if held is None:
            return _Vectors(names, np.array([n for x in often for n in x], np.int64), total)
        grams, n = held.value
        if not len(grams):
            return _Vectors(names, np.ones(_grams_of(names)[0].sum(), np.int64), total)
        asked = _grams_of(names)[1]
        at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
        return _Vectors(names, np.where(grams[at] == asked, n[at], 1), total)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = vectors(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            keep = np.flatnonzero((v.rest >= floor - 1e-9) & (v.often > 1))
            parts = -(-v.often[keep] // block)
            mine = _dealt(ids[v.own[keep]], parts)
            # A name of block i goes to the cells of i with each block.
            again = np.repeat(np.arange(len(keep)), parts)
            other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            cell = (np.minimum(mine[again], other) << 32) | np.maximum(mine[again], other)
            row, gram = v.own[keep][again], v.gram[keep][again]
            for i in range(0, len(row), 50_000):
                sent = batch.take(pa.array(row[i:i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(gram[i:i + 50_000]), pa.array(cell[i:i + 50_000]), *sent.columns], names=["gram", "cell", "name_id", "text", "often"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
            gram, cell = rows["gram"].to_numpy(), rows["cell"].to_numpy()
            ends = np.flatnonzero((np.diff(gram) != 0) | (np.diff(cell) != 0)) + 1
            if len(ends):
                yield from met(rows.slice(0, ends[-1]), np.concatenate([[0], ends]))
            left = rows.slice(ends[-1] if len(ends) else 0)
        if left is not None:
            yield from met(left, np.array([0, left.num_rows]))

    def met(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram, cell, ids = (rows[c].to_numpy() for c in ("gram", "cell", "name_id"))
        once, at, own = np.unique(ids, return_index=True, return_inverse=True)
        sent = rows.select(["text", "often"]).take(pa.array(at))
        v = vectors(sent["text"].to_pylist(), sent["often"].to_pylist())
        out = []
        for i, j in zip(ends, ends[1:]):
            if j - i < 2:
                continue
            low, high = int(cell[i]) >> 32, int(cell[i]) & 0xFFFFFFFF
            x = own[i:j]
            mine = slice(v.begin[x[0]], v.begin[x[0]] + v.size[x[0]])
            often = int(v.often[mine][v.gram[mine] == gram[i]][0])
            sides = [x] if low == high else [x[_dealt(ids[i:j], -(-often // block)) == k] for k in (low, high)]
            for k in range(0, len(sides[0]), 256):
                a = sides[0][k:k + 256]
                others = [None] * (low == high) + [sides[-1][m:m + 256] for m in range(k + 256 if low == high else 0, len(sides[-1]), 256)]
                for b in others:
                    p, q, cosine = v.alike(a, b, gram[i], often, floor)
                    p, q = once[a[p]], once[(a if b is None else b)[q]]
                    out.append((np.minimum(p, q), np.maximum(p, q), cosine))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b", "cosine"])

    keyed = texts.mapInArrow(first, "gram bigint, cell bigint, name_id bigint, text string, often array<bigint>")
    return keyed.repartition("gram", "cell").sortWithinPartitions("gram", "cell").mapInArrow(meet, "a bigint, b bigint, cosine double")


@F.pandas_udf(T.StringType())
def _spelled(core: pd.Series, roles: pd.Series) -> pd.Series:
    return pd.Series([spelled(c, r) for c, r in zip(core, roles)])


def clusters(rows: DataFrame, entries: list, id_col: str = "entity_id", least: float = 0.5) -> DataFrame:
    """``id, type, core, cluster`` of every row with a name and a type; ``cluster`` is the least id of the cluster."""
    read_rows = staged(readings(rows, entries, id_col).dropDuplicates(["id"]), "readings")
    nodes = read_rows.groupBy("type", "core", "roles", "entry").agg(F.min("id").alias("node"), F.count("*").alias("rows"))
    nodes = staged(nodes.withColumn("core_id", F.min("node").over(Window.partitionBy("type", "core"))), "nodes")
    cores = nodes.where("node = core_id").select("type", "core", "core_id")
    names = staged(nodes.withColumn("name", _spelled("core", "roles")).groupBy("type", "name").agg(
        F.min("node").alias("name_id"), F.array_distinct(F.collect_list("core_id")).alias("cores")), "names")
    # The cores of one name are linked, and the first cores of names that are alike.
    first = names.select(F.col("name_id"), F.col("cores")[0].alias("core_id"))
    one = names.select(F.col("cores")[0].alias("a"), F.explode("cores").alias("b")).where("a <> b")
    alike = alike_names(names).join(first.select(F.col("name_id").alias("a"), F.col("core_id").alias("ca")), "a").join(
        first.select(F.col("name_id").alias("b"), F.col("core_id").alias("cb")), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    groups = components(staged(near_cores(cores).unionByName(one).unionByName(alike), "links"))
    placed = nodes.join(groups, F.col("core_id") == groups["node"], "left").select(
        F.coalesce("component", "core_id").alias("component"), "type", nodes["node"], "core", "roles", "entry", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield grouped(held)
                    held = []
                held.append(row)
        if held:
            yield grouped(held)

    def grouped(held: list[tuple]) -> pa.RecordBatch:
        ids = [r[2] for r in held]
        if len(held) > 1:
            label = average_linkage([(r[3], tuple(r[4].split("\x01")), r[5]) for r in held], [r[6] for r in held], held[0][1], least)
            first = {}
            for i, x in zip(ids, label):
                first[x] = min(first.get(x, i), i)
            found = [first[x] for x in label]
        else:
            found = ids
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in held], pa.string()) for k in (1, 3, 4, 5)), pa.array(found, pa.int64())],
                                          names=["type", "core", "roles", "entry", "cluster"])

    labelled = placed.select("component", "type", "node", "core", "roles", "entry", "rows").repartition(
        "component").sortWithinPartitions("component", "node").mapInArrow(run, "type string, core string, roles string, entry string, cluster bigint")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("type", "core", "roles", "entry")]
    return read_rows.alias("r").join(labelled.alias("l"), same).select("r.id", "r.type", "r.core", "l.cluster")


def same_pairs(found: DataFrame) -> DataFrame:
    """``entity_id_a, entity_id_b`` of all pairs of rows in one cluster, smaller id first."""
    found = staged(found.select("id", "cluster"), "clusters")
    return found.select(F.col("id").alias("entity_id_a"), "cluster").join(
        found.select(F.col("id").alias("entity_id_b"), "cluster"), "cluster").where("entity_id_a < entity_id_b").drop("cluster")
