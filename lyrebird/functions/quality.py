"""Predicates, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrebird.functions.text import word_count
from lyrebird.schemas import GUEST, PRIMARY

# Thresholds of recognition quality.
LOW_LOGPROB, HIGH_COMPRESSION, NO_SPEECH = -0.35, 2.4, 0.8
MANUAL_CAPTIONS, AUTO_CAPTIONS, CAPTIONS_ACCEPTED = 0.95, 0.85, 0.92
SHORT_S = 120
# Words of titles and messages.
RESTRICTED = ("subscriber_only", "premium_only", "needs_auth", "unlisted")
MEMBER_TITLES = ("members only", "members exclusive", "exclusive to members", "member exclusive", "patreon exclusive", "subscriber exclusive", "premium content", "early access")
MEMBER_ERRORS = ("join this channel to get access to members-only content", "membership required", "premium content", "available to members only", "subscribers only", "exclusive content")
INTERVIEW_TITLES = ("interview", "conversation", "chat", "talk", "guest", "podcast", "discussion", "debate")
# Worst log probability and compression of a good segment, of the primary speaker and of guests.
GOOD_PRIMARY, GOOD_GUEST = (-0.55, 2.4), (-0.8, 2.6)


def low_confidence(logprob: Column, compression: Column) -> Column:
    return (logprob <= LOW_LOGPROB) | (compression >= HIGH_COMPRESSION)


def needs_refinement(logprob: Column, compression: Column, no_speech: Column) -> Column:
    return low_confidence(logprob, compression) | (no_speech >= NO_SPEECH)


def not_short(duration: Column) -> Column:
    """Null, zero or at least two minutes."""
    return duration.isNull() | (duration == 0) | (duration >= SHORT_S)


def not_longer(duration: Column, most: float) -> Column:
    return duration.isNull() | (duration == 0) | (duration <= most)


def _names_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text holds one of the phrases, in any case; null holds none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def members_only(availability: Column, title: Column) -> Column:
    """By the availability, or by phrases of the title."""
    return F.coalesce(availability.isin(*RESTRICTED), F.lit(False)) | _names_any(title, MEMBER_TITLES)


def members_only_error(message: Column) -> Column:
    """Whether a failure's message speaks of content for members."""
    return _names_any(message, MEMBER_ERRORS)


def interview(title: Column) -> Column:
    """Whether a title speaks of several speakers."""
    return _names_any(title, INTERVIEW_TITLES)


def captions_accepted(automatic: Column, least: float = CAPTIONS_ACCEPTED) -> Column:
    return F.when(automatic, AUTO_CAPTIONS).otherwise(MANUAL_CAPTIONS) >= least


def preset(duration_minutes: Column, interview: Column) -> Column:
    """Processing preset: up to 20 minutes fast, else by whether it is an interview."""
    return F.when(duration_minutes <= 20, "short").when(interview, "interview").otherwise("monologue_long")


def quality_label(label: Column, logprob: Column, compression: Column) -> Column:
    """low_quality by cut-offs that are looser for guests, else good_quality; other speakers and null metrics are never low."""
    poor = lambda who, limits: (label == who) & ((logprob < limits[0]) | (compression > limits[1]))
    return F.when(poor(PRIMARY, GOOD_PRIMARY) | poor(GUEST, GOOD_GUEST), "low_quality").otherwise("good_quality")


def percent_text(similarity: Column) -> Column:
    """The size of a similarity in per cent with one decimal, halves up, and no sign: -0.8756 -> 87.6."""
    return F.call_function("format_number", F.round(F.abs(similarity.cast("double") * 100), 1), F.lit("0.0"))


def confidence_band(avg_similarity: Column, n: Column) -> Column:
    return F.when((avg_similarity > 0.85) & (n >= 5), "high").when((avg_similarity > 0.75) & (n >= 3), "medium").otherwise("low")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def transcript_issues(text: Column, avg_seconds: Column) -> Column:
    """Names of a transcript's issues: no_content alone for a transcript without segments (null text), else too_short, low_punctuation,
    repetitive, nonsense_words, poor_segmentation."""
    n, chars = word_count(text), F.greatest(F.length(text), F.lit(1))
    marks = F.regexp_count(text, F.lit(r"[.!?,:;]")) / chars
    repeats = F.regexp_count(text, F.lit(r"(?i)\b(\w+)\s+\1\b"))
    nonsense = F.regexp_count(text, F.lit(r"(?i)\b[bcdfghjklmnpqrstvwxyz]{4,}\b"))
    found = F.array_compact(
        F.array(
            F.when(n < 10, "too_short"),
            F.when(marks < 0.01, "low_punctuation"),
            F.when(repeats > n * 0.1, "repetitive"),
            F.when(nonsense > n * 0.2, "nonsense_words"),
            F.when(avg_seconds > 30, "poor_segmentation"),
        )
    )
    return F.when(text.isNull(), F.array(F.lit("no_content"))).otherwise(found)


# Points that each issue costs.
PENALTY = {"no_content": 100, "too_short": 50, "low_punctuation": 20, "repetitive": 30, "nonsense_words": 40, "poor_segmentation": 10}


def transcript_score(issues: Column) -> Column:
    """100 less the issues' points, at least 0."""
    cost = F.create_map(*(F.lit(x) for kv in PENALTY.items() for x in kv))
    return F.greatest(F.lit(0), F.aggregate(issues, F.lit(100), lambda s, i: s - F.element_at(cost, i)))


def needs_upgrade(issues: Column) -> Column:
    return (transcript_score(issues) < 70) | (F.size(issues) > 2)
