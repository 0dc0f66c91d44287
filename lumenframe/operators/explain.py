"""Explanation cards as projections: ordered sections of struct(heading, body)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe import params
from lumenframe.operators.scoring import match_level

FOOTER = "This is a similarity signal for review, not a verdict."


def _section(heading: str, body: Column) -> Column:
    return F.struct(F.lit(heading).alias("heading"), body.alias("body"))


def match_section(percent: Column) -> Column:
    return _section("Match with generated references", F.concat(match_level(percent), F.lit(" ("), percent.cast("string"), F.lit("%)")))


def structure_section(has_match: Column, line_start: Column, line_end: Column) -> Column:
    body = F.when(~has_match, "No close reference was found.").when(line_start.isNull(), "No shared block of lines.").otherwise(F.format_string("Shared block at reference lines %d-%d.", line_start, line_end))
    return _section("Shared structure", body)


def diversity_section(diversity: Column, cut: float = params.CARD_DIVERSITY) -> Column:
    return _section("Known approaches", F.when(diversity < cut, "Few distinct approaches are known for this question.").otherwise("Many distinct approaches are known for this question."))


def human_section(commented_out: Column) -> Column:
    """A section where code is commented out, null elsewhere."""
    return F.when(commented_out, _section("Human-leaning signals", F.lit("Some code is commented out, as debugging leaves it. This leans human; it is no sign of generation.")))


def status_section(status: Column, reason: Column | None = None) -> Column:
    """What the status says; a status of another name gives the reason."""
    body = F.when(status == "scored", "Scored.").when(status == "low_confidence_short", "Scored with low confidence: the code is short.").when(status == "low_confidence", "Not scored: the references are too alike.")
    short = F.lit("Not scored: too little code.")
    if reason is not None:
        short = F.when((status == "insufficient_evidence") | status.isNull() | reason.isNull(), short).otherwise(F.concat(F.lit("Not scored: "), F.replace(reason, F.lit("_"), F.lit(" ")), F.lit(".")))
    return _section("Scoring", body.otherwise(short))


def scored_card(percent: Column, has_match: Column, line_start: Column, line_end: Column, diversity: Column, status: Column, naming: Column, commented_out: Column | None = None) -> Column:
    note = F.when(naming, _section("Naming", F.lit("Most local names are descriptive.")))
    human = [] if commented_out is None else [human_section(commented_out)]
    return F.array_compact(F.array(match_section(percent), structure_section(has_match, line_start, line_end), diversity_section(diversity), *human, status_section(status), note))


def unscored_card(status: Column, reason: Column) -> Column:
    return F.array(status_section(status), _section("Reason", F.coalesce(F.replace(reason, F.lit("_"), F.lit(" ")), F.lit("unknown"))))


def formatted(card: Column) -> Column:
    return F.concat(F.array_join(F.transform(card, lambda s: F.concat(s["heading"], F.lit(": "), s["body"])), " "), F.lit(f" {FOOTER}"))


def diversity_sentence(diversity: Column, tight: float = params.LOW_DIVERSITY, few: float = params.WORDING_DIVERSITY) -> Column:
    return F.when(diversity < tight, "All known solutions look the same.").when(diversity < few, "Known solutions look much alike.").otherwise("Known solutions differ.")


def naming_note(flagged: Column, fraction: Column, floor: float = params.NAMING_NOTE_FLOOR) -> Column:
    return F.when(flagged & (fraction >= floor), "Local names are unusually descriptive.").when(flagged, "Some local names are descriptive.")


def facts(**values: Column) -> Column:
    """A map of the facts that aren't null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def dropped_a_fact(rewrite: Column, cues: list[str]) -> Column:
    """If a rewrite lost one of the required cues."""
    lost = F.lit(False)
    for cue in cues:
        lost = lost | ~F.lower(rewrite).contains(cue.lower())
    return lost


def plain_status(status: Column) -> Column:
    """struct(headline, reason)."""
    headline = F.when(status.isin("scored", "low_confidence_short"), "Scored").otherwise("Not scored")
    reason = F.when(status == "low_confidence_short", "short code").when(status == "low_confidence", "references too alike").when(status == "insufficient_evidence", "too little code")
    return F.struct(headline.alias("headline"), reason.alias("reason"))
