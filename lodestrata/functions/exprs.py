"""Scalar functions as Column builders; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that negate a word, in the order they are tried.
NEGATION_PREFIXES = ("un", "non", "in", "im", "ir", "il", "dis", "anti", "de", "mis")
# Words that give no initial.
INITIAL_STOPWORDS = ("of", "the", "and", "for", "in", "on", "a", "an", "to", "with")
# Weights of sections.
SECTION_WEIGHTS = {"abstract": 1.0, "introduction": 0.9, "methodology": 0.95, "results": 1.0, "conclusion": 0.95, "body": 0.8,
                   "front_matter": 0.6, "back_matter": 0.2, "references": 0.1}
# Words that tell a section, in the order they are tried.
FRONT_WORDS = ("abstract", "summary", "overview", "introduction")
BACK_WORDS = ("reference", "bibliography", "appendix", "annex")
SECTION_WORDS = (("abstract", ("abstract", "résumé", "summary")), ("introduction", ("introduction", "background", "context")),
                 ("methodology", ("method", "methodology", "approach", "procedure")),
                 ("results", ("result", "finding", "experiment", "evaluation")), ("conclusion", ("conclusion", "discussion", "future work")),
                 ("references", ("reference", "bibliography", "works cited")))
# Honorifics taken off the start of a name.
HONORIFICS = ("dr.", "dr ", "prof.", "prof ", "mr.", "mr ", "ms.", "ms ", "mrs.", "mrs ")
# Confidence of an extraction by document tier.
TIER_CONFIDENCE = {1: 0.95, 2: 0.85, 3: 0.70}

# Words that tell the kind of a provider's error.
DAILY_WORDS = ("tokens per day", "requests per day", "tpd", "rpd")
DAILY_LIMITS = ("rate_limit", "quota")
RATE_WORDS = ("429", "rate limit", "rate_limit", "resource_exhausted")
NETWORK_WORDS = ("connection", "timeout", "network")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""))


def display_name(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column | str) -> Column:
    """The key of a name: lower case, blanks collapsed, no punctuation."""
    return F.regexp_replace(F.regexp_replace(clean(c), r"(?U)\s+", " "), r"(?U)[^\w\s]", "")


def numbers(c: Column | str) -> Column:
    """The distinct numbers of a text, as text and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))))


def numeric_conflict(a: Column | str, b: Column | str) -> Column:
    """Both hold numbers and not the same ones."""
    x, y = numbers(a), numbers(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def strip_negation(c: Column | str) -> Column:
    """The word without the first matching negating prefix, or null."""
    c, out = col(c), F.lit(None).cast("string")
    for prefix in reversed(NEGATION_PREFIXES):
        out = F.when(c.startswith(prefix) & (F.length(c) > len(prefix) + 2), F.substring(c, len(prefix) + 1, 1_000_000)).otherwise(out)
    return out


def negation_pair(a: Column | str, b: Column | str) -> Column:
    """One is the negation of the other."""
    x, y = (F.regexp_replace(F.lower(col(c)), "[^a-z]", "") for c in (a, b))
    return F.coalesce(strip_negation(x) == y, F.lit(False)) | F.coalesce(strip_negation(y) == x, F.lit(False))


def domain_mismatch(a: Column | str, b: Column | str) -> Column:
    """Both domains are given and differ, case and outer blanks aside."""
    x, y = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    return (x != "") & (y != "") & (clean(x) != clean(y))


def disqualified(a, b, domain_a=None, domain_b=None) -> Column:
    """Why two names cannot be one: ``negation``, ``numbers``, ``domain`` or null."""
    out = F.when(negation_pair(a, b), F.lit("negation")).when(numeric_conflict(a, b), F.lit("numbers"))
    return out if domain_a is None else out.when(domain_mismatch(domain_a, domain_b), F.lit("domain"))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(F.lower(col(a)), F.lower(col(b)))


def typo_candidate(a: Column | str, b: Column | str, most: int = 2) -> Column:
    """Both of four letters or more, different and within ``most`` edits."""
    x, y = F.lower(col(a)), F.lower(col(b))
    return (F.length(x) >= 4) & (F.length(y) >= 4) & (x != y) & (F.levenshtein(x, y, most) >= 0)


def combine_confidence(*scores: Column | str) -> Column:
    """Product of scores, each clamped to [0, 1], null as 0; four decimals."""
    out = F.lit(1.0)
    for s in scores:
        out = out * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(s), F.lit(0.0))))
    return out


def extraction_confidence(tier, quality, used_fallback) -> Column:
    """By tier and quality, a tenth less after a fallback."""
    by_tier = F.when(col(tier) == 1, 0.95).when(col(tier) == 2, 0.85).when(col(tier) == 3, 0.70).otherwise(0.75)
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(quality), F.lit(1.0))))
    return by_tier * q * F.when(col(used_fallback), 0.9).otherwise(1.0)


def chunk_id(doc, page, index, text) -> Column:
    """The id of a chunk: half a digest of where it stands and how it begins."""
    parts = F.concat_ws(":", col(doc), col(page).cast("string"), col(index).cast("string"), F.substring(col(text), 1, 80))
    return F.substring(F.sha1(parts), 1, 16)


def doc_hash(title, sample) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(col(title)), F.lit("::"), F.substring(F.lower(col(sample)), 1, 1200)), 256), 1, 16)


def evidence_record(source_doc, page, chunk, text, confidence, at) -> Column:
    return F.struct(col(source_doc).alias("source_doc"), col(page).alias("page"), col(chunk).alias("chunk_id"),
                    F.substring(col(text), 1, 300).alias("excerpt"), col(confidence).alias("confidence"), col(at).alias("extracted_at"))


def evidence_list(json: Column | str, schema: str) -> Column:
    """A stored list; null or broken gives an empty one."""
    return F.coalesce(F.from_json(col(json), schema), F.array().cast(schema))


_PAREN = r"^(.*?)\s*\(([A-Za-z0-9][A-Za-z0-9.\-]{0,7})\)\s*$"


def paren_base(c: Column | str) -> Column:
    """The name before a bracketed abbreviation, or the whole name."""
    c = F.trim(col(c))
    base = F.trim(F.regexp_extract(c, _PAREN, 1))
    return F.when(base != "", base).otherwise(c)


def paren_abbreviation(c: Column | str) -> Column:
    """The bracketed abbreviation of a name, or null."""
    c = F.trim(col(c))
    return F.when(F.trim(F.regexp_extract(c, _PAREN, 1)) != "", F.regexp_extract(c, _PAREN, 2))


def initials(c: Column | str) -> Column:
    """First letters of the words that count, in capitals."""
    words = F.transform(F.split(F.trim(col(c)), r"[\s\-]+"), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    words = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*INITIAL_STOPWORDS))
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def acronym_token(c: Column | str) -> Column:
    """Two to six capitals, stops aside."""
    s = F.replace(F.trim(col(c)), F.lit("."), F.lit(""))
    return F.length(s).between(2, 6) & s.rlike(r"^\p{L}+$") & (s == F.upper(s)) & (s != F.lower(s))


def acronym_match(a: Column | str, b: Column | str) -> Column:
    """Whether one name is an abbreviation of the other."""
    a, b = col(a), col(b)
    base_a, base_b = F.lower(paren_base(a)), F.lower(paren_base(b))
    par_a, par_b = F.lower(paren_abbreviation(a)), F.lower(paren_abbreviation(b))
    plain_a, plain_b = F.upper(F.replace(a, F.lit("."), F.lit(""))), F.upper(F.replace(b, F.lit("."), F.lit("")))
    tests = [par_a == F.lower(F.trim(b)), par_b == F.lower(F.trim(a)), par_a == base_b, par_b == base_a, base_a == base_b,
             acronym_token(a) & (initials(paren_base(b)) == plain_a), acronym_token(b) & (initials(paren_base(a)) == plain_b)]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str, epsilon: float = 0.0) -> Column:
    """Cosine in double; a zero vector gives 0, or with ``epsilon`` a quotient over a norm that is never 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / (norms + epsilon) if epsilon else F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def round_vector(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: F.round(x.cast("double"), 6))


def ontology_key(c: Column | str) -> Column:
    """A relation as typed in the ontology's spelling."""
    c = F.upper(F.regexp_replace(F.trim(col(c)), "[^A-Za-z0-9_]", "_"))
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_|_$", "")


def safe_label(c: Column | str) -> Column:
    """A label of letters and digits only, ``General`` for none."""
    c = F.regexp_replace(F.initcap(col(c)), "[^A-Za-z0-9]", "")
    return F.when(c != "", c).otherwise("General")


def entity_key(type_col, name_col) -> Column:
    return F.concat_ws("::", col(type_col), clean(name_col))


def pair_key(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws(" | ", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def detect_section(text, page, total) -> Column:
    """The section of a page by where it stands, then by its words."""
    head = F.lower(F.substring(col(text), 1, 500))
    position = col(page) / F.greatest(col(total), F.lit(1))
    has = lambda words: F.greatest(*[head.contains(w).cast("int") for w in words], F.lit(0)) == 1
    out = F.when(position < 0.1, F.when(has(FRONT_WORDS), "abstract").otherwise("front_matter"))
    out = out.when(position > 0.85, F.when(has(BACK_WORDS), "back_matter").otherwise("conclusion"))
    for section, words in SECTION_WORDS:
        out = out.when(has(words), section)
    return out.otherwise("body")


def section_weight(section: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(table, col(section)), F.lit(0.8))


def tier(page_count: Column | str) -> Column:
    return F.when(col(page_count) < 10, 1).when(col(page_count) < 50, 2).otherwise(3)


def table_text(data: Column | str) -> Column:
    """Cells trimmed and joined, empty rows left out."""
    rows = F.filter(col(data), lambda r: r.isNotNull() & (F.size(r) > 0))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")), "\n")


def json_body(raw: Column | str) -> Column:
    """What stands from the first ``{`` to the last ``}`` of an answer, code fences or not; null without braces."""
    found = F.regexp_extract(col(raw), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_strings(raw: Column | str) -> Column:
    """The non-blank strings of a JSON list in an answer; an empty list where there is none."""
    body = F.regexp_extract(col(raw), r"(?s)(\[.*\])", 1)
    items = F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def classify_error(message: Column | str) -> Column:
    """``daily_quota``, ``rate_limit``, ``network`` or ``unknown``."""
    m = F.lower(col(message))
    any_of = lambda words: F.greatest(*[m.contains(w).cast("int") for w in words], F.lit(0)) == 1
    daily = any_of(DAILY_WORDS) | (m.contains("per day") & any_of(DAILY_LIMITS))
    return F.when(daily, "daily_quota").when(any_of(RATE_WORDS), "rate_limit").when(any_of(NETWORK_WORDS), "network").otherwise("unknown")


def backoff(kind: Column | str, attempt: Column | str, base: float = 2.0) -> Column:
    """Seconds to wait: doubling for rate limits, growing by steps for the network, else constant."""
    return (F.when(col(kind) == "rate_limit", base * F.pow(F.lit(2.0), col(attempt)))
            .when(col(kind) == "network", base * (col(attempt) + 1)).otherwise(F.lit(base)))


def alias_curve(confidence: Column | str, times_seen: Column | str) -> Column:
    """Confidence of an alias after repeated sightings; never lower than it was."""
    c = col(confidence)
    grown = 0.97 - (0.97 - c) * F.exp(-0.08 * F.greatest(F.lit(0), col(times_seen) - 1))
    return F.greatest(c, F.least(F.lit(0.97), grown))


def decayed(confidence, last_updated, now, rate: float = 0.05, floor: float = 0.3, hours: int = 24) -> Column:
    old = col(last_updated) < col(now) - F.expr(f"INTERVAL {hours} HOURS")
    return F.when(old & (col(confidence) > floor), col(confidence) * (1 - rate)).otherwise(col(confidence))


def token_estimate(chunks: Column | str, per_chunk: int = 1300) -> Column:
    return col(chunks) * per_chunk


def backend(tier_col, chunks, preferred: str = "small", large: str = "large", most: int = 250) -> Column:
    """Large documents go to the backend without a daily cap."""
    return F.when((col(tier_col) == 3) | (col(chunks) > most), large).otherwise(preferred)


def format_fact(number, anchor, chain, related, related_type, score) -> Column:
    flag = F.when(F.array_contains(col(chain), "CONTRADICTS"), " [CONFLICT SIGNAL]").otherwise("")
    return F.format_string("[G%d]%s %s --%s--> %s (%s, confidence %.2f)", col(number), flag, col(anchor),
                           F.array_join(col(chain), " -> "), col(related), col(related_type), col(score))


def format_hit(number, source_doc, page, text) -> Column:
    return F.format_string("[C%d] (%s, p.%d): %s", col(number), col(source_doc), col(page), col(text))


def first_missing(*required: str, what: str = "entity") -> Column:
    """Which required field of a record is missing or empty first, as a reason; null if none."""
    return F.coalesce(*[F.when(F.coalesce(F.col(f"`{k}`"), F.lit("")) == "", F.lit(f"{what} missing '{k}'")) for k in required])
