"""Column roles of a study table and the fixed name candidates used to guess them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

# Ordered column-name candidates per role.
STUDY_CANDIDATES: dict[str, list[str]] = {
    "entity_id": ["participant_id", "healthcode", "subject_id", "patno", "patient_id", "id"],
    "time_col": ["createdon", "visit_date", "date", "timestamp", "created_dt", "event_time"],
    "group_col": ["sex", "gender", "site", "cohort", "arm"],
    "outcome_col": ["diagnosis", "dx", "pd", "case_control", "group", "status"],
    "target_col": ["updrs", "moca", "score", "severity", "progression", "hn_yahr"],
}
SESSION_CANDIDATES: dict[str, list[str]] = {
    "pid": ["healthcode", "participant_id"],
    "session_id": ["recordid", "session_id", "event_id"],
    "start_ms": ["tapping_results_json_startdate", "start_ms"],
    "end_ms": ["tapping_results_json_enddate", "end_ms"],
    "med_timepoint": ["medtimepoint", "med_timepoint"],
    "tap_data": [
        "tapping_results_json_tappingsamples",
        "tap_samples",
        "tap_timestamps",
        "tap_times",
    ],
}


@dataclass(frozen=True)
class Roles:
    entity_id: str | None = None
    time_col: str | None = None
    group_col: str | None = None
    outcome_col: str | None = None
    target_col: str | None = None

    def as_dict(self) -> dict[str, str | None]:
        return asdict(self)


def first_present(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    have = set(columns)
    return next((c for c in candidates if c in have), None)


def guess_columns(
    columns: Iterable[str], candidates: Mapping[str, Sequence[str]] = STUDY_CANDIDATES
) -> dict[str, str | None]:
    """First listed candidate present in the schema, per role."""
    have = list(columns)
    return {role: first_present(have, names) for role, names in candidates.items()}


def guess_roles(columns: Iterable[str]) -> Roles:
    return Roles(**guess_columns(columns))
