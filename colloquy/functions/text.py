"""Scalar functions over labels, speakers and demographic values, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import domains as D

#: All white space that Unicode knows; Java's \s is that of ASCII alone.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def normal(label: Column) -> Column:
    """Lower case, no white space at the ends, single spaces inside."""
    return F.trim(F.regexp_replace(F.lower(label), _SPACE, " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}|{_SPACE}$", "")


def hashed_id(label: Column, prefix: str = "concept_") -> Column:
    """An id that equal normalised labels share."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(normal(label), 256), 1, 12))


def pseudonym(speaker: Column, salt: str) -> Column:
    """A name that hides the speaker's own; a null speaker hashes as "None", so it has one too."""
    return F.concat(F.lit("Speaker_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(speaker, F.lit("None"))), 256), 1, 8))


def record_id(*keys: Column) -> Column:
    """A deterministic id, the same when a task or a run is repeated."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(normal(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))


def polarity_sign(polarity: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, sign in D.POLARITIES.items():
        out = out.when(polarity == name, sign)
    return out.otherwise(0)


def is_speaker_label(label: Column) -> Column:
    return F.startswith(F.lower(label), F.lit("speaker_"))


def present(c: Column) -> Column:
    """Not null and not empty: an empty id counts as none."""
    return F.coalesce(c != "", F.lit(False))


def age_group(age: Column) -> Column:
    """The group of the number that a text starts with; null where there is none."""
    n = F.regexp_extract(age, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    out = F.when(n.isNull(), F.lit(None).cast("string"))
    for below, name in D.AGE_GROUPS:
        out = out.when(n < below, name) if below else out.otherwise(F.lit(name))
    return out


def without_junk(value: Column) -> Column:
    return F.when(~value.isin(*D.JUNK_VALUES), value)


def polarity_label(mean: Column) -> Column:
    """supports above 0.15, opposes below -0.15, else neutral, with two decimals; n/a for null."""
    word = F.when(mean > 0.15, "supports").when(mean < -0.15, "opposes").otherwise("neutral")
    return F.when(mean.isNull(), "n/a").otherwise(F.concat(F.format_number(mean, 2), F.lit(" ("), word, F.lit(")")))


#: Colours (red, green, blue) of a supporting, a neutral and an opposing position.
SUPPORT_RGB, NEUTRAL_RGB, OPPOSE_RGB = (22, 163, 74), (156, 163, 175), (220, 38, 38)


def polarity_colour(mean: Column) -> Column:
    """The colour between neutral and the position that a mean polarity leans to, as rgb(red, green, blue); null and NaN are
    neutral, means beyond -1 and 1 count as these."""
    known = F.when(mean.isNull() | F.isnan(mean), F.lit(0.0)).otherwise(mean.cast("double"))
    part = F.least(F.abs(known), F.lit(1.0))
    channel = lambda n, s, o: F.floor(F.lit(float(n)) + F.when(known >= 0, F.lit(float(s - n))).otherwise(F.lit(float(o - n))) * part + 0.5).cast("string")
    return F.concat(F.lit("rgb("), F.concat_ws(", ", *map(channel, NEUTRAL_RGB, SUPPORT_RGB, OPPOSE_RGB)), F.lit(")"))


def short_label(label: Column) -> Column:
    return F.when(F.char_length(label) > 22, F.concat(F.substring(label, 1, 20), F.lit("..."))).otherwise(label)


def mean_of(values: Column, scale: int = 1_000_000) -> Column:
    """An aggregate: the mean, the same in whatever order rows come, of values that are exact in millionths."""
    return F.sum(F.round(values * scale).cast("long")) / F.count(values) / scale


def contains_evidence(text: Column, evidence: Column) -> Column:
    """Whether normalised evidence is part of the normalised text. Empty evidence is part of any text."""
    return F.contains(normal(F.coalesce(text, F.lit(""))), normal(F.coalesce(evidence, F.lit(""))))
