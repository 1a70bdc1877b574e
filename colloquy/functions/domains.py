"""Enumerations that records are checked against, and sets of relations that reports tell apart."""

NODE_TYPES = ("actor", "technology", "policy", "event", "process", "outcome", "value", "belief_proposition", "topic")
RELATIONS = (
    "causes", "increases", "reduces", "enables", "prevents", "reinforces", "undermines", "increases_exposure_to",
    "supports", "opposes", "associated_with", "expresses", "rejects", "questions", "reports",
)
#: Relations that state a cause, and such that state a position.
CAUSAL_RELATIONS = ("causes", "increases", "reduces", "enables", "prevents", "reinforces", "undermines", "increases_exposure_to")
VALUE_RELATIONS = ("expresses", "rejects", "questions", "reports", "supports", "opposes")
STANCES = ("asserted", "rejected", "questioned", "reported", "uncertain")
POLARITIES = {"supports": 1, "neutral": 0, "opposes": -1}
EXPLICITNESS = ("explicit", "near_explicit", "inferred")
UNKNOWN = "Unknown"
JUNK_VALUES = ("CONSENT_REVOKED", "DATA_EXPIRED", "", "Unknown", "nan")
AGE_GROUPS = ((30, "18-29"), (45, "30-44"), (60, "45-59"), (None, "60+"))
DIMENSIONS = ("political_affiliation", "age_group", "sex", "ethnicity")
#: Columns of a cohort file for each attribute, in order of preference, and of its participant id.
ATTRIBUTE_COLUMNS = {
    "political_affiliation": ("U.s. political affiliation", "political_affiliation", "Political affiliation"),
    "sex": ("Sex", "sex"),
    "age": ("Age", "age"),
    "ethnicity": ("Ethnicity simplified",),
}
PARTICIPANT_COLUMNS = ("participant_id", "Participant id", "Participant_id")
SEGMENT_COLUMNS = (
    "iteration_cycle", "participant_id", "table_id", "room_id", "speaker", "joined_at", "start_time", "start_timestamp",
    "end_time", "end_timestamp", "transcript",
)
