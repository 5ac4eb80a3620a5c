"""Column expressions for scores, labels and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity: floor(x + 0.5)."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def percent(part: Column, whole: Column, empty: int | None = None) -> Column:
    """Whole percent; ``empty`` where there is nothing to earn."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(empty).cast("long")).cast("long")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def number(x: Column, default: float = 0.0) -> Column:
    """A lenient number: what can't be read is the default."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def bands(x: Column, cuts: list[tuple[float, str]], below: str) -> Column:
    """The label of the first cut that ``x`` reaches; cuts go downwards."""
    out = None
    for at, label in cuts:
        out = F.when(x >= at, label) if out is None else out.when(x >= at, label)
    return out.otherwise(below)


#: fixed values: label cuts of the marking rules
VERDICT = [(0.85, "correct"), (0.4, "partial")]
GRADE = [(90.0, "A*"), (80.0, "A"), (70.0, "B"), (60.0, "C"), (50.0, "D"), (40.0, "E")]
ANSWER_LABEL = [(0.85, "fully_correct"), (0.45, "partially_correct")]
MATCH_STATUS = [(0.82, "accepted"), (0.65, "review_required")]
SEARCH_STATUS = [(0.78, "accepted"), (0.62, "review_required")]
SCORE_STATUS = [(0.75, "accepted"), (0.4, "review_required")]
RATING = [(0.85, "Excellent"), (0.70, "Good"), (0.50, "Average")]


def grade_band(percent_: Column) -> Column:
    return bands(percent_, GRADE, "U")


def verdict(share: Column, answered: Column) -> Column:
    return F.when(~answered, "unanswered").otherwise(bands(share, VERDICT, "weak"))


def match_status(score: Column) -> Column:
    return bands(score, MATCH_STATUS, "failed")


def search_status(score: Column) -> Column:
    return bands(score, SEARCH_STATUS, "failed")


def score_status(score: Column) -> Column:
    return bands(score, SCORE_STATUS, "failed")


def rating(score: Column, most: Column) -> Column:
    return bands(F.when(most > 0, score / most).otherwise(0.0), RATING, "Weak")


def length_status(original: Column, required: Column, written: Column) -> Column:
    """Whether an answer's words are within five percent of what was asked for."""
    low, high = F.bround(required * 0.95), F.bround(required * 1.05)
    return F.when((original <= 0) | (required <= 0), "Unknown").when(written.between(low, high), "Within +/-5%").when(written < low, "Too Short").otherwise("Too Long")


def clamp_int(x: Column, low: int, high: int, default: int) -> Column:
    """A lenient whole number: what can't be read is the default, parts of one are cut off, and it keeps to its bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.floor(x.try_cast("double")).cast("long"), F.lit(default))))


def safe_key(key: Column) -> Column:
    """A key as a file name: other characters become underscores."""
    return F.regexp_replace(key, "[^A-Za-z0-9._-]", "_")


#: fixed values: names for subjects, and the subject they stand for
SUBJECT_ALIASES = {
    "chemistry": "Chemistry 1011", "chem": "Chemistry 1011", "english": "English 1012", "eng": "English 1012", "islamiyat": "Islamiyat 1013", "islamic studies": "Islamiyat 1013",
    "mathematics": "Mathematics 1014", "math": "Mathematics 1014", "maths": "Mathematics 1014", "pakistan studies": "Pakistan Studies 1015", "pak studies": "Pakistan Studies 1015", "pst": "Pakistan Studies 1015",
    "physics": "Physics 1016", "phy": "Physics 1016",
}


def subject_of(x: Column) -> Column:
    """The subject that a name stands for; an unknown name stays; a blank one is null."""
    key = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    known = F.create_map(*[F.lit(z) for pair in SUBJECT_ALIASES.items() for z in pair])
    return F.coalesce(F.try_element_at(known, key), F.nullif(F.trim(x), F.lit("")))


def effective_deadline(base: Column, extension: Column) -> Column:
    """The later of the two; nulls are skipped."""
    return F.greatest(base, extension)


def placeholder_to_null(x: Column) -> Column:
    """Texts that stand for nothing become null."""
    return F.when(F.lower(F.trim(x)).isin("", "string", "none", "null", "undefined", "n/a", "na"), None).otherwise(x)


def display_name(name: Column, email: Column, fallback: str) -> Column:
    clean = F.trim(name)
    proper = F.when((clean != "") & (F.lower(clean) != "user"), clean)
    local = F.split_part(email, F.lit("@"), F.lit(1))
    return F.coalesce(proper, F.when(local != "", local), F.lit(fallback))


def is_paper_key(key: Column) -> Column:
    """Exactly five segments between bars, none of them blank, 200 characters at most."""
    parts = F.split(key, r"\|")
    return (F.length(key) <= 200) & (F.size(parts) == 5) & F.forall(parts, lambda p: F.trim(p) != "")


def is_email(x: Column) -> Column:
    return x.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def clean_names(names: Column, most: int = 40) -> Column:
    """Trimmed names; of those equal but for case the first place and the last spelling stay."""
    trimmed = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    keys = F.array_distinct(F.transform(trimmed, lambda n: F.lower(n)))
    spelling = F.transform(keys, lambda k: F.element_at(F.filter(trimmed, lambda n: F.lower(n) == k), -1))
    return F.slice(spelling, 1, most)


def scope_allows(scope: Column, value: Column) -> Column:
    """An empty list allows all; else some entry contains the value or is contained in it."""
    low = F.lower(value)
    return (F.size(scope) == 0) | F.exists(scope, lambda s: F.lower(s).contains(low) | low.contains(F.lower(s)))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open intervals; touching ones don't overlap."""
    return (start_a < end_b) & (end_a > start_b)


def criteria_sum(criteria: Column, field: str = "marks_awarded") -> Column:
    return F.aggregate(F.coalesce(criteria, F.array().cast("array<struct<marks_awarded:double,marks_available:double>>")), F.lit(0.0), lambda a, c: a + F.coalesce(c[field], F.lit(0.0)))


def earned(final_score: Column, ai_score: Column, criteria: Column) -> Column:
    """The final score, else the proposed one, else the sum of the criteria."""
    return F.coalesce(final_score, ai_score, criteria_sum(criteria))


def award(confidence: Column, available: Column, at: float = 0.6) -> Column:
    """All or nothing."""
    return F.when(confidence >= at, available).otherwise(F.lit(0.0))


def heuristic_confidence(score: Column) -> Column:
    return half_up(F.least(F.lit(1.0), 2 * F.abs(score - 0.5)), 2)


def days_left(day: Column, as_of: Column) -> Column:
    return F.ceil((F.unix_timestamp(day.cast("timestamp")) - F.unix_timestamp(as_of.cast("timestamp"))) / 86400)


def rect_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of structs (x0, y0, x1, y1)."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    both = w * h
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return ratio(both, area(a) + area(b) - both, 0.0)


def utc_time(x: Column) -> Column:
    """A time of day and year from a text; null if it is none."""
    return F.try_to_timestamp(x).cast("timestamp_ntz")


def scaffold(criteria: Column) -> Column:
    """Criteria (criterion_text, marks_available) as a marker finds them: nothing awarded, no reason, no confidence."""
    blank = lambda c: F.struct(c["criterion_text"].alias("criterion_text"), c["marks_available"].alias("marks_available"), F.lit(0.0).alias("marks_awarded"), F.lit(False).alias("awarded"), F.lit("").alias("reasoning"), F.lit(None).cast("double").alias("confidence"))
    return F.transform(criteria, blank)


def total_marks(questions: Column) -> Column:
    """The marks of all questions (marks_available, excluded) that count; what is no number counts as none."""
    return F.aggregate(F.filter(questions, lambda q: ~q["excluded"]), F.lit(0.0), lambda a, q: a + F.coalesce(F.nanvl(q["marks_available"], F.lit(0.0)), F.lit(0.0)))


#: fixed values: pairs of letters that scans confuse, either way
CONFUSABLE = ["bk", "ao", "i1", "l1", "0o", "s5", "gq", "uv", "ce", "tf", "aq", "pg", "ji", "f7"]


def confusable(bad: Column, good: Column) -> Column:
    """Whether two words differ by one pair of look-alikes only, or are rn and m."""
    # only words that differ can be confused: most don't, and are done with at once
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (bad, good))
    pairs = F.array(*[F.lit(p) for pair in CONFUSABLE for p in (pair, pair[::-1])])
    letters = F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: F.concat(a, b))
    unlike = F.filter(letters, lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    one = (F.length(x) == F.length(y)) & (F.size(unlike) == 1) & F.array_contains(pairs, F.coalesce(F.get(unlike, F.lit(0)), F.lit("")))
    near = (F.length(x) == F.length(y)) & (F.levenshtein(x, y, 1) == 1)
    return F.coalesce((bad != good) & (x != "") & (y != "") & ((near & one) | ((x == "rn") & (y == "m")) | ((x == "m") & (y == "rn"))), F.lit(False))


def one_of(x: Column, known: list[str], default: str) -> Column:
    return F.when(x.isin(known), x).otherwise(default)
