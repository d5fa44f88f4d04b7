"""Fixed values of the record model."""

from __future__ import annotations

# The closed sets, weights and factors of the model.
KINDS = ("constraint", "decision", "episode", "fact", "observation", "outcome", "preference", "procedure", "task")
STATES = {"active": 1.0, "contested": 0.78, "superseded": 0.42, "retracted": 0.0}
TRUST = {"external": 0.60, "agent": 0.80, "tool_verified": 0.95, "user_confirmed": 1.00}
APPLICABILITY = {"exact": 1.00, "compatible": 0.90, "unversioned": 0.75, "divergent": 0.45, "stale": 0.35, "inapplicable": 0.0}
APPLICABILITY_REASONS = {
    "exact": "exact_repository_state",
    "compatible": "compatible_repository_history",
    "stale": "artifact_or_worktree_changed",
    "divergent": "divergent_repository_history",
    "unversioned": "unversioned_scope",
    "inapplicable": "inapplicable_scope",
}
HALF_LIFE_DAYS = {"preference": 365, "procedure": 180, "fact": 120, "outcome": 90, "episode": 45, "task": 30, "observation": 14}
SECTIONS = {
    "constraint": (0, "constraints_and_preferences"),
    "preference": (0, "constraints_and_preferences"),
    "decision": (1, "decisions"),
    "outcome": (2, "attempts_and_outcomes"),
    "procedure": (3, "procedures"),
    "task": (4, "open_tasks"),
    "fact": (5, "relevant_history"),
    "episode": (5, "relevant_history"),
    "observation": (5, "relevant_history"),
}
#: Signal, weight in the fusion, and reason, in the order of summation.
SIGNALS = (
    ("exact", 1.35, "exact_text"),
    ("error_fingerprint", 1.25, "same_error_fingerprint"),
    ("artifact_verified", 1.10, "artifact_hash_verified"),
    ("dense", 1.00, "dense_vector"),
    ("lexical_strict", 1.12, "all_lexical_terms"),
    ("lexical", 1.00, "lexical_match"),
    ("code_alias_strict", 0.98, "all_code_alias_terms"),
    ("code_alias", 0.86, "code_alias_match"),
    ("semantic_expansion", 0.78, "semantic_expansion"),
    ("sparse", 0.82, "identifier_or_artifact"),
    ("entity", 0.72, "entity_match"),
    ("recency", 0.20, "recent_in_scope"),
)
RRF_K = 60
FIELD_WEIGHTS = {"title": 4.0, "body": 1.0, "tags": 2.5, "entities": 3.0, "paths": 3.5, "aliases": 2.0, "expansions": 0.8}
POSITIVE_FEEDBACK = ("helpful", "used")
NEGATIVE_FEEDBACK = ("harmful", "incorrect", "outdated", "dismissed")
CHANNEL_LIMIT, TERM_LIMIT, RECENT_LIMIT = 512, 256, 32
CANDIDATES, POOL_LEAST, POOL_MOST = 1024, 256, 512
MMR_LAMBDA = 0.78
ENVELOPE_TOKENS = 37
PREVIEW_CHARS = 1024
SESSION_EVENTS = 128
RECALL_LIMIT, RECALL_BUDGET = 12, 1500
