"""Text, number and date rules of question texts, all as JVM-side Column expressions.

Patterns carry the ``(?U)`` flag so that ``\\w``, ``\\d`` and ``\\b`` are Unicode-aware.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Word lists, patterns and tables below decide results and must keep these values.

NEGATION_TOKENS = [
    "not", "no", "never", "won't", "wouldn't", "can't", "cannot",
    "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't",
    "fail", "fails", "failed", "failing", "without", "neither",
    "nor", "refuse", "refuses", "refused", "against",
    "lose", "loses", "lost",
]

TOPIC_STOPWORDS = (
    "will the a an to of in by for on at or be is are was were been being have has had do does "
    "did not no yes before after end year than from with into any all can may this that these "
    "those and but if when how what who which").split()

ENTITY_ALIASES = {
    "biden": "joe biden", "trump": "donald trump", "harris": "kamala harris",
    "obama": "barack obama", "elon": "elon musk",
    "btc": "bitcoin", "eth": "ethereum", "sol": "solana", "xrp": "ripple", "doge": "dogecoin",
    "us": "united states", "usa": "united states", "uk": "united kingdom",
    "eu": "european union", "fed": "federal reserve",
    "sec": "securities and exchange commission", "fda": "food and drug administration",
    "gop": "republican party",
}

ENTITY_PATTERNS = [
    r"\$([A-Z]{2,6})\b",
    r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b",
    r"(?:president|senator|governor|secretary|ceo|founder|candidate)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
    r'"([^"]{2,50})"',
]

NON_ENTITY_FIRST_WORDS = (
    "will would could should does did has have had is are was were be been being the a an this "
    "that these those if when whether what which who whose how by in on at of for to from with "
    "and or but not no yes before after during until since").split()

JURISDICTION_PATTERNS = [
    r"\b(United States|U\.S\.|USA|US)\b",
    r"\b(United Kingdom|UK|U\.K\.)\b",
    r"\b(European Union|EU)\b",
    r"\b(China|Japan|India|Russia|Germany|France|Brazil)\b",
    r"\b(California|Texas|New York|Florida|Illinois)\b",
    r"\b(Congress|Senate|House of Representatives|Supreme Court)\b",
    r"\b(Federal Reserve|Fed|ECB|IMF|World Bank)\b",
]

RESOLUTION_PATTERNS = [
    r"\baccording to\s+([A-Z][^\.,]{2,40})",
    r"\breported by\s+([A-Z][^\.,]{2,40})",
    r"\b(AP|Reuters|Bloomberg|CNN|BBC|NYT|Washington Post|Associated Press)\b",
    r"\b(official results?|official announcement|official statement)\b",
    r"\b(closing price|last traded price)\b",
    r"\b(polymarket|kalshi|manifold|prediction market)\b",
]

POSITIVE_PATTERNS = [r"\bwill\b", r"\bsucceed\b", r"\bwin\b", r"\bpass\b", r"\bapprove\b"]
NEGATIVE_PATTERNS = [r"\bwill not\b", r"\bwon'?t\b", r"\bfail\b", r"\bno\b\s+\b"]

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]
MONTHS_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

THRESHOLD_PATTERN = (
    r"(?:above|below|over|under|at least|more than|less than|exceed|reach)\s*"
    r"\$?\s*([\d,]+(?:\.\d+)?)\s*(?:(?:billion|million|thousand|percent)\b|[%]|(?:k|m|b)(?![a-zA-Z]))?|"
    r"\$\s*([\d,]+(?:\.\d+)?)\s*(?:(?:billion|million|thousand|percent)\b|[%]|(?:k|m|b)(?![a-zA-Z]))?")

CHECKED_DATES = [  # pattern and Spark format
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", "yyyy-MM-dd"),
    (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", "M/d/yyyy"),
    (r"\b(\d{1,2})-(\d{1,2})-(\d{4})\b", "M-d-yyyy"),
]
MONTH_DATE = r"\b({names}){dot}\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
QUARTER_DATE = r"\bQ([1-4])\s+(\d{4})\b"
YEAR_END = r"\bend of\s+(20\d{2})\b|\bby\s+end\s+of\s+(20\d{2})\b"
BEFORE_YEAR = r"\bbefore\s+(20\d{2})\b|\bprior to\s+(20\d{2})\b"
BARE_YEAR = r"\b(20\d{2})\b"

COMPARATOR_PATTERNS = [
    (">=", r"\bmore than\b|\bexceed[s]?\b|\babove\b|\bover\b|\bat least\b"),
    ("<=", r"\bless than\b|\bbelow\b|\bunder\b|\bat most\b"),
    ("==", r"\bexactly\b|\bequal to\b"),
]

# ----------------------------------------------------------- end of fixed values

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (repeated Columns are recomputed inside lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has(text, pattern: str) -> Column:
    """Case-insensitive search."""
    return _c(text).rlike("(?iU)" + pattern)


def _shortest(texts: tuple[str, ...]) -> int:
    return min(map(len, texts), default=0)


def _needed(parsed) -> list[tuple[str, ...]]:
    """Groups of lower-case texts: a match of a parsed pattern contains one at least of each group."""
    groups: list[tuple[str, ...]] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if run:
            groups.append((run,))
        run = ""
        if name == "SUBPATTERN":
            groups += _needed(value[-1])
        elif name == "BRANCH":
            choices = [max(_needed(branch), key=_shortest, default=()) for branch in value[1]]
            if all(choices):
                groups.append(tuple(t for c in choices for t in c))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            groups += _needed(value[2])
    return groups


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """All groups of texts that a find of an ASCII case-insensitive search contains one each of; what rules out most comes first."""
    return tuple(sorted(dict.fromkeys(_needed(re._parser.parse(pattern))), key=_shortest, reverse=True))


def required(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which every text that an ASCII case-insensitive search finds contains one; empty if there are none."""
    return needed(pattern)[0] if needed(pattern) else ()


def plain_lower(text) -> Column:
    """The text in lower case where it is all ASCII, else null: what ``prefiltered`` looks for literals in."""
    text = _c(text)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text))


def may_have(plain: Column, pattern: str) -> Column:
    """False only where the pattern cannot be found. Other letters have cases that are no byte match, so their texts are searched."""
    groups = [reduce(lambda a, b: a | b, [F.contains(plain, F.lit(t)) for t in texts]) for texts in needed(pattern)]
    return F.coalesce(reduce(lambda a, b: a & b, groups), F.lit(True)) if groups else F.lit(True)


def has_plain(text, plain: Column, pattern: str) -> Column:
    """``has``; all-ASCII texts are searched in lower case without Unicode classes, and only where the pattern's literals are."""
    if re.search(r"\\[A-Z]", pattern):  # of an escape the case matters
        return may_have(plain, pattern) & has(text, pattern)
    return F.when(plain.isNull(), has(text, pattern)).otherwise(may_have(plain, pattern) & plain.rlike(pattern.lower()))


def has_any(text, patterns, plain: Column | None = None) -> Column:
    """Whether any pattern is found; with ``plain`` a search starts only where its literals are."""
    found = [has(text, p) if plain is None else has_plain(text, plain, p) for p in patterns]
    return reduce(lambda a, b: a | b, found)


def matches(text, pattern: str, group: int = 0, flags: str = "iU") -> Column:
    return F.regexp_extract_all(_c(text), F.lit(f"(?{flags}){pattern}"), F.lit(group))


def matches_plain(text, plain: Column, pattern: str, group: int = 0, flags: str = "iU") -> Column:
    """``matches``; all-ASCII texts are searched without Unicode classes."""
    found = F.regexp_extract_all(_c(text), F.lit(("(?i)" if "i" in flags else "") + pattern), F.lit(group))
    return F.when(plain.isNull(), matches(text, pattern, group, flags)).otherwise(found)


def where_needed(plain: Column, pattern: str, found: Column) -> Column:
    """A list made of matches, empty where the pattern's literals are missing. Lambdas are slow, so this goes around them."""
    return F.when(may_have(plain, pattern), found).otherwise(F.array().cast("array<string>"))


def first_match(text, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(_c(text), "(?iU)" + pattern, group), F.lit(""))


def fold(text) -> Column:
    """Lower-case with single spaces and no outer blanks; null becomes empty."""
    # a single space stays as it is, so most texts need no replacement
    return F.coalesce(F.trim(F.regexp_replace(F.lower(_c(text)), r"(?U)[\s&&[^ ]]\s*| \s+", " ")), F.lit(""))


def word_set(text) -> Column:
    return F.array_distinct(matches(F.lower(_c(text)), r"\w+", flags="U"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Jaccard of two distinct-value arrays; one empty side gives 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def token_overlap(a, b) -> Column:
    return jaccard(word_set(a), word_set(b))


def negation_words(text) -> Column:
    """Negation words of a text: all that ``asymmetric_negation`` reads of it."""
    return F.array_intersect(word_set(text), _strings(NEGATION_TOKENS))


def asymmetric_negation(a, b) -> Column:
    """Sorted negation words present in exactly one of the two texts."""
    sides = F.struct(negation_words(a).alias("a"), negation_words(b).alias("b"))
    return bind(sides, lambda s: F.array_sort(F.array_union(
        F.array_except(s["a"], s["b"]), F.array_except(s["b"], s["a"]))))


def topic_words(*texts) -> Column:
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(_c(t), F.lit("")) for t in texts]))
    long_enough = F.filter(matches(joined, "[a-z0-9]+", flags="U"), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(long_enough), _strings(TOPIC_STOPWORDS))


def chunk_words(text, window: int = 256, overlap: int = 50) -> Column:
    """Overlapping word windows; a text of at most ``window`` words stays as it is."""
    text = _c(text)
    step = window - overlap

    def cut(words):
        last = F.ceil((F.size(words) - F.lit(window)) / F.lit(step)).cast("int")
        pieces = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.concat_ws(" ", F.slice(words, i * step + 1, F.lit(window))))
        return F.when(F.size(words) <= window, F.array(text)).otherwise(pieces)

    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
        bind(words, cut))


# ---------------------------------------------------------------- entities

def normalise_entity(entity) -> Column:
    bare = F.translate(F.lower(_c(entity)), _PUNCTUATION, "")
    clean = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    aliases = F.create_map(*[F.lit(x) for kv in ENTITY_ALIASES.items() for x in kv])
    return bind(clean, lambda c: F.coalesce(F.try_element_at(aliases, c), c))


def entities(text, most: int | None = None, plain: Column | None = None) -> Column:
    """Named entities in order of appearance; all of them, or the first ``most``."""
    plain = plain_lower(text) if plain is None else plain
    raw = F.concat(*[where_needed(plain, p, matches_plain(text, plain, p, 1, flags="U")) for p in ENTITY_PATTERNS])
    trimmed = F.filter(F.transform(raw, F.trim), lambda e: F.length(e) > 1)
    named = F.filter(F.transform(trimmed, normalise_entity), lambda e: (F.length(e) > 1) & ~(
        F.split_part(e, F.lit(" "), F.lit(1)).isin(NON_ENTITY_FIRST_WORDS)))
    found = F.array_distinct(named)
    return found if most is None else F.slice(found, 1, most)


def jurisdiction(text, plain: Column | None = None) -> Column:
    plain = plain_lower(text) if plain is None else plain
    return normalise_entity(F.coalesce(*[F.when(may_have(plain, p), first_match(text, p)) for p in JURISDICTION_PATTERNS]))


def resolution_hints(text, plain: Column | None = None) -> Column:
    plain = plain_lower(text) if plain is None else plain
    found = F.array(*[F.when(may_have(plain, p), F.lower(F.trim(first_match(text, p, 1)))) for p in RESOLUTION_PATTERNS])
    return F.array_distinct(F.filter(found, lambda h: h.isNotNull()))


def polarity(question, plain: Column | None = None) -> Column:
    plain = plain_lower(question) if plain is None else plain
    return (F.when(has_any(question, NEGATIVE_PATTERNS, plain), "negative")
            .when(has_any(question, POSITIVE_PATTERNS, plain), "positive"))


# ---------------------------------------------------------------- dates

def _iso(year: Column, month: Column, day: Column) -> Column:
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.concat_ws("-", year.cast("int").cast("string"), two(month), two(day))


def _checked_dates(text, plain: Column, pattern: str, fmt: str) -> Column:
    parsed = F.transform(matches_plain(text, plain, pattern, flags="U"), lambda m: F.try_to_date(m, fmt))
    return where_needed(plain, pattern, F.transform(F.filter(parsed, lambda d: d.isNotNull()), lambda d: d.cast("string")))


def _month_dates(text, plain: Column, names: list[str], dot: str) -> Column:
    pattern = MONTH_DATE.format(names="|".join(names), dot=dot)
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names, 1) for x in (n.lower(), i)])
    part = lambda m, g: F.regexp_extract(m, "(?iU)" + pattern, g)
    return where_needed(plain, pattern, F.transform(matches_plain(text, plain, pattern), lambda m: _iso(
        part(m, 3), F.try_element_at(number, F.lower(part(m, 1))), part(m, 2))))


def _quarter_dates(text, plain: Column) -> Column:
    return where_needed(plain, QUARTER_DATE, F.transform(matches_plain(text, plain, QUARTER_DATE), lambda m: _iso(
        F.right(m, F.lit(4)), (F.substring(m, 2, 1).cast("int") - 1) * 3 + 1, F.lit(1))))


def date_parts(text, plain: Column) -> Column:
    """struct(specific, before, years) of a text: what ``date_mentions`` puts together."""
    ends = lambda pattern: where_needed(
        plain, pattern, F.transform(matches_plain(text, plain, pattern), lambda m: F.right(m, F.lit(4))))
    before = ends(BEFORE_YEAR)
    specific = F.concat(
        *[_checked_dates(text, plain, pattern, fmt) for pattern, fmt in CHECKED_DATES],
        _month_dates(text, plain, MONTHS, ""),
        _month_dates(text, plain, MONTHS_SHORT, r"\.?"),
        _quarter_dates(text, plain),
        where_needed(plain, YEAR_END, F.transform(ends(YEAR_END), lambda y: F.concat(y, F.lit("-12-31")))),
        where_needed(plain, BEFORE_YEAR, F.transform(before, lambda y: F.concat((y.cast("int") - 1).cast("string"), F.lit("-12-31")))))
    years = where_needed(plain, BARE_YEAR, matches_plain(text, plain, BARE_YEAR, 1, flags="U"))
    # Without any digit there is no date, and most texts stop here.
    return F.when(_c(text).rlike(r"(?U)\d"), F.struct(specific.alias("specific"), before.alias("before"), years.alias("years")))


def dates_of(text, parts: Column) -> Column:
    """ISO dates of a text whose ``date_parts`` are at hand."""
    covered = F.concat(F.transform(parts["specific"], lambda d: F.split_part(d, F.lit("-"), F.lit(1))), parts["before"])
    bare = F.array_except(parts["years"], covered)
    dates = F.array_distinct(F.concat(parts["specific"], F.transform(bare, lambda y: F.concat(y, F.lit("-01-01")))))
    return F.when(parts.isNotNull(), dates).when(_c(text).isNotNull(), F.array().cast("array<string>"))


def date_mentions(text, plain: Column | None = None) -> Column:
    """ISO dates in a text, most specific kinds first, without repeats.

    Order: ISO, m/d/y, m-d-y, written months, quarters, end of a year, before a year (the
    previous 31 December), then bare years that no earlier kind already covers.
    """
    return bind(date_parts(text, plain_lower(text) if plain is None else plain), lambda parts: dates_of(text, parts))


def iso_date(text) -> Column:
    return F.try_to_date(_c(text), "yyyy-MM-dd")


def day_gap(a, b) -> Column:
    """Absolute days between two ISO date strings; null when either is not a date."""
    return F.abs(F.datediff(iso_date(a), iso_date(b)))


# ---------------------------------------------------------------- numbers

def thresholds(text, plain: Column | None = None) -> Column:
    """Amounts after a comparison word or a dollar sign, scaled by k/m/b suffixes.

    Whole numbers from 1900 to 2200 count as years and are dropped before scaling.
    """
    def amount(m):
        digits = F.regexp_extract(m, r"(?U)([\d,]+(?:\.\d+)?)", 1)
        return F.regexp_replace(digits, ",", "").try_cast("double")

    def scale(m):
        suffix = lambda s: F.lower(m).rlike(rf"(?U)(?<=[0-9,])\s*(?:{s})(?![a-zA-Z])")
        return (F.when(suffix("billion|b"), 1e9).when(suffix("million|m"), 1e6)
                .when(suffix("thousand|k"), 1e3).otherwise(1.0))

    plain = plain_lower(text) if plain is None else plain
    found = F.transform(matches_plain(text, plain, THRESHOLD_PATTERN),
                        lambda m: F.struct(amount(m).alias("v"), scale(m).alias("s")))
    kept = F.filter(found, lambda t: t["v"].isNotNull() & ~(
        t["v"].between(1900.0, 2200.0) & (t["v"] == F.floor(t["v"]))))
    return F.transform(kept, lambda t: t["v"] * t["s"])


def comparators(text, plain: Column | None = None) -> Column:
    plain = plain_lower(text) if plain is None else plain
    flags = F.array(*[F.when(has_plain(text, plain, p), F.lit(sign)) for sign, p in COMPARATOR_PATTERNS])
    return F.filter(flags, lambda c: c.isNotNull())


def pair_hash(a, b) -> Column:
    """Deterministic 16-digit pair id from the two market ids."""
    joined = F.concat_ws("|", _c(a).cast("string"), _c(b).cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 16)


def plain_number(x: Column) -> Column:
    """Shortest decimal text without exponent, always with a fraction part."""
    whole = F.format_string("%.1f", x)
    return F.when(x == F.floor(x), whole).otherwise(x.cast("string"))
