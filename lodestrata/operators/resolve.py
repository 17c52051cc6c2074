"""Entity resolution: alias, vector, acronym, typo and substring stages with disqualifiers, as a cascade of anti-joins.

Every stage is a set join over what the stages before left; model calls come last and only for survivors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (
    HONORIFICS, acronym_match, acronym_token, clean, disqualified, initials, normalize_name, paren_abbreviation, paren_base, typo_candidate)
from ..functions.udfs import fuzzy_ratio
from ..session import staged
from .components import components


def validate(rows: DataFrame, *required: str, what: str = "entity") -> DataFrame:
    """Adds ``reason``: the first required field that is missing or empty."""
    from ..functions.exprs import first_missing

    return rows.withColumn("reason", first_missing(*required, what=what))


def exact_lookup(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity of exactly that name (and type, where asked), the most confident first."""
    e = entities.select(F.col("name"), F.col("type").alias("e_type"), "domain", "confidence", "entity_id")
    hits = asked.join(e, "name").where(F.col("type").isNull() | (F.col("type") == F.col("e_type")))
    w = Window.partitionBy("asked_id").orderBy(F.desc_nulls_last("confidence"), "entity_id")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def strip_honorific(c):
    """A name in lower case without honorifics at its start."""
    pattern = "^(" + "|".join(h.replace(".", r"\.") for h in HONORIFICS) + ")"
    return F.trim(F.regexp_replace(F.lower(F.trim(F.col(c))), pattern, ""))


_WORD = r"[\p{L}\p{N}]+"
# Letters by which a word stands in a key, the most that it has.
_PARTS = (1, 3, 6)


def _words(text: str):
    return F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0))


def _long(words):
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def _links(words, left, right):
    """Keys of each two words that follow each other: the end of the first with one letter of the second, one letter of the first with the beginning of the second."""
    count = F.greatest(F.size(words) - 1, F.lit(0))
    end, begin = lambda w, k: F.substring(w, -k, k), lambda w, k: F.substring(w, 1, k)
    return F.flatten(F.zip_with(F.slice(words, 1, count), F.slice(words, 2, count), lambda v, w: F.array_compact(F.array(
        *[F.when(left(v, k), F.concat(end(v, k), F.lit(" "), begin(w, 1))) for k in _PARTS],
        *[F.when(right(w, k), F.concat(end(v, 1), F.lit(" "), begin(w, k))) for k in _PARTS]))))


def _contained(held: DataFrame, key: str, others: DataFrame, text: str) -> DataFrame:
    """Rows of both where ``text`` of the others holds ``key`` of the held (same type) and shares a word of three letters or more with it.

    Within a name the words stand as they are, but its first may end a longer word and its last begin one. So a name meets the others by the ends of two of its words that
    follow each other, the rarest such key among the others; a name of one word by that word.
    """
    exact = lambda w, k: F.length(w) >= k if k == _PARTS[-1] else F.length(w).between(k, _PARTS[_PARTS.index(k) + 1] - 1)
    least = lambda w, k: F.length(w) >= k
    own, all_words = _words(key), _words(text)
    asked = held.where(F.size(_long(own)) > 0).withColumn(
        "k", F.explode(F.array_distinct(F.when(F.size(own) == 1, own).otherwise(_links(own, exact, exact)))))
    offered = others.withColumn("k", F.explode(F.array_distinct(F.concat(_long(all_words), _links(all_words, least, least)))))
    often = offered.groupBy("type", "k").agg(F.count("*").alias("__n"))
    rarest = Window.partitionBy("type", key).orderBy("__n", "k")
    chosen = asked.hint("merge").join(often.hint("merge"), ["type", "k"]).withColumn("__first", F.row_number().over(rarest)).where("__first = 1").drop("__n", "__first")
    hits = chosen.hint("merge").join(offered.hint("merge"), ["type", "k"]).where(F.col(text).contains(F.col(key)))
    return hits.where(F.arrays_overlap(_long(_words(key)), _long(_words(text)))).drop("k")


def _first(rows: DataFrame, by: list[str], most: int = 1) -> DataFrame:
    """The first rows by confidence of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("confidence"), "match", "entity_id")
    return rows.withColumn("__first", F.row_number().over(w)).where(F.col("__first") <= most).drop("__first")


def substring_match(new: DataFrame, entities: DataFrame, exclude_self: bool = False) -> DataFrame:
    """The first entity of the same type whose name holds the new name or is held in it, by confidence.

    Contained names share a word of three letters or more; a name inside a longer word is not found. Equal names are compared once, so a name that many rows hold makes no
    pairs of all with all; of entities of one name only the first can be the answer, or the second where the first is the row itself.
    """
    most = 2 if exclude_self else 1
    a = new.where("type IS NOT NULL").select("new_id", F.col("name").alias("new_name"), "type", strip_honorific("name").alias("n"))
    b = entities.where("name IS NOT NULL AND type IS NOT NULL").select("entity_id", F.col("name").alias("match"), "type", F.lower("name").alias("m"), "confidence")
    if exclude_self:
        b = _first(b, ["type", "m", "entity_id"])
    texts = a.where("n IS NOT NULL").select("type", "n").distinct()
    named = _first(b, ["type", "m"], most).groupBy("type", "m").agg(F.collect_list(F.struct("entity_id", "match", "confidence")).alias("of"))
    pairs = _contained(texts, "n", named, "m").unionByName(_contained(named, "m", texts, "n"))
    hits = pairs.select("type", "n", F.inline("of")).distinct()
    if exclude_self:
        hits = _first(hits, ["type", "n", "entity_id"])
    hits = a.hint("merge").join(_first(hits, ["type", "n"], most).hint("merge"), ["type", "n"])
    if exclude_self:
        hits = hits.where("new_id <> entity_id")
    return _first(hits.select("new_id", "new_name", "type", "entity_id", "match", "confidence"), ["new_id"])


def acronym_pairs(new: DataFrame, entities: DataFrame) -> DataFrame:
    """Names and entities of one type that abbreviate each other. Equi-joins on derived keys stand for the comparison of all pairs.

    Abbreviations meet initials only, not each other, and initials do not meet initials. Generated rows have no true estimate of size, so no side is to be broadcast.
    """
    a = new.select("new_id", F.col("name").alias("a"), "type", "domain")
    b = entities.where("name IS NOT NULL").select("entity_id", F.col("name").alias("b"), "type", F.col("domain").alias("b_domain"))

    def keys(c: str, own: str, other: str):
        token = F.upper(F.replace(F.trim(F.col(c)), F.lit("."), F.lit("")))
        return F.array_distinct(F.array_compact(F.array(
            F.lower(F.trim(F.col(c))), F.lower(paren_base(c)), F.lower(paren_abbreviation(c)),
            F.when(acronym_token(c), F.concat(F.lit(own), token)), F.concat(F.lit(other), initials(paren_base(c))))))

    left, right = a.withColumn("k", F.explode(keys("a", "=", "#"))), b.withColumn("k", F.explode(keys("b", "#", "=")))
    pairs = left.hint("merge").join(right.hint("merge"), ["type", "k"]).drop("k").distinct()
    permissive = F.col("domain").isNull() | F.col("b_domain").isNull() | (F.col("domain") == F.col("b_domain"))
    return pairs.where(permissive & (F.lower("a") != F.lower("b")) & acronym_match("a", "b"))


def _letter_pairs(text: str, half: int):
    """Half of a mask of 128 bits: which pairs of neighbouring letters a text has."""
    bit = f"pmod(hash(substring({text}, i, 2)), 128) - {64 * half}"
    return F.expr(f"aggregate(sequence(1, length({text}) - 1), 0L, (m, i) -> m | if({bit} BETWEEN 0 AND 63, shiftleft(1L, {bit}), 0L))")


def typo_pairs(new: DataFrame, entities: DataFrame, most: int = 2) -> DataFrame:
    """Names and entities of one type within ``most`` edits and not disqualified.

    Blocked by pieces: of ``most + 1`` equal pieces of a name one survives ``most`` edits, shifted by ``most`` places at most; so names meet on
    (length, place, piece) only. A shift of the piece and the rest of the difference in length are edits before and after it, so together they are ``most`` at most.
    Many names have the same beginning or end, so pairs that meet are sifted by their pairs of letters before the edits are counted: an edit takes two at most and adds two at most.
    """
    parts = most + 1
    a = new.select("new_id", F.col("name").alias("a"), "type", "domain", F.lower("name").alias("la")).where(F.length("name") >= 4)
    a = a.withColumns({f"a{h}": _letter_pairs("la", h) for h in (0, 1)})
    b = entities.where(F.length("name") >= 4).select("entity_id", F.col("name").alias("b"), "type", F.col("domain").alias("b_domain"), F.lower("name").alias("lb"))
    b = b.withColumns({f"b{h}": _letter_pairs("lb", h) for h in (0, 1)})
    size = F.col("n").cast("int")
    piece = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(
        (F.floor(i * size / parts) + 1).cast("int").alias("at"), (F.floor((i + 1) * size / parts) - F.floor(i * size / parts)).cast("int").alias("len")))
    left = b.withColumn("n", F.length("lb")).withColumn("p", F.explode(piece)).select("*", F.col("p.at").alias("at"), F.col("p.len").alias("len"),
                                                                                      F.substring("lb", F.col("p.at"), F.col("p.len")).alias("piece")).drop("p")
    other = a.withColumn("d", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("n", F.length("la") + F.col("d")).where("n >= 4")
    other = other.withColumn("p", F.explode(piece)).withColumn("s", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select(
        "*", F.col("p.at").alias("at"), F.col("p.len").alias("len")).where(f"at + s >= 1 AND abs(s) + abs(d + s) <= {most}").withColumn(
        "piece", F.substring("la", F.col("at") + F.col("s"), F.col("len"))).drop("p", "s", "d")
    met = other.hint("merge").join(left.hint("merge"), ["type", "n", "at", "len", "piece"])
    sift = F.expr(f"bit_count(a0 ^ b0) + bit_count(a1 ^ b1) <= {4 * most}")
    pairs = met.where(sift & typo_candidate("a", "b", most) & disqualified("a", "b", "domain", "b_domain").isNull())
    # names as aggregates: what a caller asks of them is then not moved before the sift
    keys = ["new_id", F.col("a").alias("__a"), "type", "domain", "entity_id", F.col("b").alias("__b"), "b_domain"]
    return pairs.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b")).select("new_id", "a", "type", "domain", "entity_id", "b", "b_domain")


def resolve(new: DataFrame, entities: DataFrame, aliases: DataFrame, near: DataFrame | None = None, confirm=None) -> DataFrame:
    """``new_id, name, canonical, resolution, resolution_confidence, method`` of each new entity against a snapshot.

    Stages in order: declared abbreviation, alias memory, vector neighbour (``near``: ``new_id, match, score``), acronym, typo (only with a
    ``confirm`` provider that adds a column ``accepted``), substring (safe ratio, else confirmed, else its own name at 0.75), else new.
    """
    rows = new.select("new_id", "name", "type", "domain").withColumn("base", paren_base("name"))
    known = aliases.groupBy("alias_key").agg(F.max_by("canonical", "confidence").alias("alias_canonical"), F.max("confidence").alias("alias_confidence"))
    out = rows.hint("merge").join(known.hint("merge"), normalize_name("base") == F.col("alias_key"), "left")
    out = staged(out.select("new_id", "name", "base", "type", "domain", "alias_canonical", "alias_confidence"), "left")
    done = [out.where("alias_canonical IS NOT NULL").select("new_id", "name", F.col("alias_canonical").alias("canonical"),
                                                            F.col("alias_confidence").alias("confidence"), F.lit("alias").alias("method"))]
    left = out.where("alias_canonical IS NULL").select("new_id", F.col("base").alias("name"), "type", "domain")

    def take(found: DataFrame) -> None:
        """Each stage is run once and written with what it left, so no later plan holds those before; only shuffled joins, as any of these tables can be large."""
        nonlocal left
        w = Window.partitionBy("new_id").orderBy(F.desc("confidence"), "canonical")
        best = found.select("new_id", "canonical", "confidence", "method").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        after = staged(left.hint("merge").join(best.hint("merge"), "new_id", "left"), "stage")
        done.append(after.where("method IS NOT NULL").select("new_id", "name", "canonical", "confidence", "method"))
        left = after.where("method IS NULL").select("new_id", "name", "type", "domain")

    if near is not None:
        hits = left.join(near, "new_id").where(disqualified("name", "match").isNull())
        take(hits.select("new_id", F.col("match").alias("canonical"), F.col("score").alias("confidence"), F.lit("vector").alias("method")))
    acronyms = acronym_pairs(left, entities).where(disqualified("a", "b", "domain", "b_domain").isNull())
    take(acronyms.select("new_id", F.col("b").alias("canonical"), F.lit(0.95).alias("confidence"), F.lit("acronym").alias("method")))
    if confirm is not None:
        typos = confirm(typo_pairs(left, entities)).where("accepted")
        take(typos.select("new_id", F.col("b").alias("canonical"), F.col("score").alias("confidence"), F.lit("typo").alias("method")))
    sub = substring_match(left, entities).withColumn("ratio", fuzzy_ratio("new_name", "match")).where(disqualified("new_name", "match").isNull())
    same = clean("new_name") == clean("match")
    safe = (F.col("ratio") >= 0.87) & (F.length("new_name") >= 4) & (F.length("match") >= 4)
    take(sub.select("new_id", F.when(same | safe, F.col("match")).otherwise(F.col("new_name")).alias("canonical"),
                    F.when(same, 1.0).when(safe, F.col("ratio")).otherwise(0.75).alias("confidence"),
                    F.when(same, "same").when(safe, "substring").otherwise("own_name").alias("method")))
    done.append(left.select("new_id", "name", F.col("name").alias("canonical"), F.lit(1.0).alias("confidence"), F.lit("new").alias("method")))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


def link_mentions(asked: DataFrame, entities: DataFrame, aliases: DataFrame, near: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """Mentions linked by alias, exact name or the nearest vector; unlinked ones are left out, duplicates stay."""
    known = aliases.groupBy("alias_key").agg(F.max_by("canonical", "confidence").alias("canonical"), F.max("confidence").alias("alias_confidence"))
    rows = asked.join(known, normalize_name("mention") == F.col("alias_key"), "left").withColumn("target", F.coalesce("canonical", "mention"))
    own = entities.where("name IS NOT NULL").groupBy(F.col("name").alias("target")).agg(
        F.max_by("type", F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("entity_id"))).alias("type"))
    out = rows.join(own, "target", "left")
    if near is not None:
        out = out.join(near.where(F.col("score") >= least), "mention_id", "left")
    else:
        out = out.withColumn("match", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    hit = F.col("type").isNotNull()
    source = F.when(hit & F.col("canonical").isNotNull(), "alias").when(hit, "exact").when(F.col("match").isNotNull(), "vector")
    return out.select("mention_id", "mention", F.when(hit, F.col("target")).otherwise(F.col("match")).alias("entity"),
                      F.when(hit, F.coalesce("alias_confidence", F.lit(1.0))).otherwise(F.col("score")).alias("link_confidence"),
                      source.alias("link_source")).where("link_source IS NOT NULL")


def duplicate_groups(entities: DataFrame) -> DataFrame:
    """``type, group_id, entity_id, name``: greedy stars of names that abbreviate each other, around the first entity not yet in a group.

    Candidates come from the equi-joins of :func:`acronym_pairs`. Stars of different components do not touch, so each component of links is
    walked by itself, in the order of ids.
    """
    pairs = acronym_pairs(entities.select(F.col("entity_id").alias("new_id"), "name", "type", "domain"), entities)
    links = staged(pairs.where("new_id < entity_id").select("type", F.col("new_id").alias("a"), F.col("entity_id").alias("b")), "links")
    placed = links.join(components(links), links["a"] == F.col("node")).select("component", "type", "a", "b")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(part["a"], part["b"]):
            near.setdefault(int(a), []).append(int(b))
        taken: set[int] = set()
        rows = []
        for seed in sorted(near):
            if seed not in taken:
                members = [m for m in sorted(near[seed]) if m not in taken]
                if members:
                    taken.update([seed, *members])
                    rows += [(part["type"].iloc[0], seed, m) for m in (seed, *members)]
        return pd.DataFrame(rows, columns=["type", "group_id", "entity_id"])

    groups = placed.groupBy("component").applyInPandas(walk, "type string, group_id bigint, entity_id bigint")
    return groups.join(entities.select("entity_id", "name", "confidence"), "entity_id")


def pick_canonical(groups: DataFrame) -> DataFrame:
    """The name each group goes by: the longest base, then the most confident."""
    base = paren_base("name")
    return groups.groupBy("group_id").agg(F.max_by(base, F.struct(F.length(base), F.coalesce("confidence", F.lit(-1.0)), base)).alias("canonical"),
                                          F.count("*").alias("members"))
