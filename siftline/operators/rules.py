"""Admission rules: each finding is a code in an array column, so one projection checks all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def codes(**rules: Column) -> Column:
    """The names of the rules whose condition holds, in the order given. An unknown condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def empty(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def validate_labels(rows: DataFrame) -> DataFrame:
    """rows with the codes of what is wrong with a label row, and whether it is valid."""
    tier_a = F.col("label_tier") == "A"
    bad = codes(
        CANDIDATE_MISSING=blank(F.col("candidate_id")),
        LABEL_NOT_BINARY=F.col("label").isNull() | ~F.col("label").isin(0, 1),
        TIER_UNKNOWN=F.col("label_tier").isNull() | ~F.col("label_tier").isin("A", "B", "C"),
        SOURCE_MISSING=blank(F.col("label_source")),
        TIER_A_WITHOUT_EVIDENCE=tier_a & empty(F.col("evidence_refs")),
        WITNESS_BLANK=F.exists(F.coalesce("witness_families", F.array().cast("array<string>")), lambda x: F.trim(x) == ""),
    )
    return rows.withColumn("errors", bad).withColumn("valid", F.size("errors") == 0)


#: What a claim's fields may say.
KINDS = (
    "REPORTED", "OBSERVED", "MEASURED", "DERIVED", "HYPOTHESIS",
    "STATISTICAL", "SYMBOLIC", "PEER_MESSAGE",
)
EVIDENCE = (
    "SOURCE_FACT", "FORMAL_DERIVATION", "REPRODUCIBLE_EXPERIMENT",
    "STATISTICAL_INFERENCE", "HYPOTHESIS_ONLY",
)
STATUSES = (
    "SOURCE_BOUND_FACT", "PROVED_IN_SCOPE", "REFUTED", "CONDITIONAL",
    "REPRODUCED_FINITE_MECHANICS", "SUPPORTED_BY_STATISTICAL_INFERENCE_WITH_MODEL",
    "HYPOTHESIS_ONLY", "UNRESOLVED", "INSUFFICIENT_DATA", "I_DO_NOT_KNOW",
)
OLD_STATUSES = (
    "UNVERIFIED_REPORT", "SOURCE_BOUND_OBSERVATION", "INFERRED_HYPOTHESIS",
    "SYMBOLIC_CONTEXT", "SUPPORTED_WITHIN_BOUND", "WEAKENED",
    "PROBABLE_CONVENTIONAL", "UNRESOLVED_NONEXOTIC", "DATA_POOR_SURVIVOR",
    "HARD_SURVIVOR", "LIKELY_CONVENTIONAL",
)
CHANNELS = (
    "DIRECT_OBSERVATION", "FIRSTHAND_REPORT", "HEARSAY_REPORT", "PEER_MESSAGE",
    "GUEST_CLAIM", "LISTENER_EMAIL", "HOST_STATEMENT", "SYMBOLIC_CONTEXT",
    "MODEL_INFERENCE", "FORMAL_SOURCE", "INSTRUMENT_RECORD", "EXECUTABLE_REPLAY",
)
CONTEXT_CHANNELS = (
    "HEARSAY_REPORT", "PEER_MESSAGE", "GUEST_CLAIM", "LISTENER_EMAIL",
    "HOST_STATEMENT", "SYMBOLIC_CONTEXT", "MODEL_INFERENCE",
)
FIRSTHAND = ("FIRSTHAND", "HEARSAY", "NOT_APPLICABLE", "UNKNOWN")
FORMAL_STATUSES = ("PROVED_IN_SCOPE", "REFUTED", "CONDITIONAL", "UNRESOLVED", "INSUFFICIENT_DATA")
HYPOTHESIS_STATUSES = ("HYPOTHESIS_ONLY", "UNRESOLVED", "INSUFFICIENT_DATA", "I_DO_NOT_KNOW")
SCORES = (
    "PASS", "FAIL", "PARTIAL_WITH_PREDECLARED_TOLERANCE",
    "UNSCORABLE_TOO_VAGUE", "UNRESOLVED_MISSING_OUTCOME_DATA",
)
#: Flags that claim an authority which isn't evidence, with the code of each.
FLAGS = {
    "heuristic_score": "HEURISTIC_SCORE_FORBIDDEN_AS_AUTHORITY",
    "survivor_score": "SURVIVOR_SCORE_FORBIDDEN_AS_AUTHORITY",
    "survivor_label": "SURVIVOR_LABEL_FORBIDDEN_AS_AUTHORITY",
    "model_vote_as_evidence": "MODEL_VOTE_IS_NOT_EVIDENCE",
    "consensus_as_truth": "CONSENSUS_IS_NOT_WORLD_TRUTH",
    "visual_impression_as_evidence": "VISUAL_IMPRESSION_IS_NOT_EVIDENCE",
    "audience_size_as_corroboration": "AUDIENCE_SIZE_IS_NOT_CORROBORATION",
    "repetition_as_independence": "REPETITION_IS_NOT_INDEPENDENCE",
    "institutional_role_as_truth": "INSTITUTIONAL_STATUS_IS_PROVENANCE_NOT_TRUTH",
    "self_identification_authenticates_source": "SELF_IDENTIFIED_SOURCE_IS_NOT_AUTHENTICATED",
    "missing_data_as_evidence": "MISSING_DATA_STAYS_MISSING",
    "raw_ledger_rewritten": "MODELS_MAY_NOT_REWRITE_RAW_LEDGER",
}
#: What a model or a frozen prediction must state.
STATISTICAL_FIELDS = ("target", "model", "uncertainty")
PROBABILITY_FIELDS = ("model", "conditioning", "estimation_or_calibration", "validation", "uncertainty")
FREEZE_FIELDS = ("prediction_timestamp", "deadline_or_window", "success_criterion", "failure_criterion", "analysis_rule")

#: The columns of a claim; a table that lacks some of them is read as if they were null.
CLAIM = (
    "claim_id string, origin_agent_id string, claim_text string, raw_claim_text string, claim_kind string, status string, evidence_class string, "
    "provenance_channel string, firsthand_status string, event_time string, event_location string, confidence string, source_pointers array<string>, "
    "evidence_objects array<string>, alternative_hypotheses array<string>, falsification_tests array<string>, independence_evidence array<string>, "
    "independent_replication boolean, flags array<string>, "
    "statistical_model struct<target:string,model:string,uncertainty:string>, "
    "probability_model struct<model:string,conditioning:string,estimation_or_calibration:string,validation:string,uncertainty:string>, "
    "prediction struct<frozen:boolean,scored:boolean,post_hoc_redefined:boolean,prediction_timestamp:string,deadline_or_window:string,success_criterion:string,failure_criterion:string,analysis_rule:string,score:string>"
)


def _missing(struct: str, fields: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(blank(F.col(struct)[f]), F.lit(f)) for f in fields]))


def validate_claims(claims: DataFrame) -> DataFrame:
    """claims (columns of CLAIM) with errors, warnings and admissible (no error).

    Blank kinds are REPORTED and blank statuses UNRESOLVED; raw text defaults to
    the text. flags names the FLAGS that a claim sets. A code that names fields
    lists those that are missing.
    """
    for field in T._parse_datatype_string(CLAIM).fields:
        if field.name not in claims.columns:
            claims = claims.withColumn(field.name, F.lit(None).cast(field.dataType))
    c = F.col
    word = lambda name, default="": F.upper(F.coalesce(F.nullif(c(name), F.lit("")), F.lit(default)))
    kind, status, evidence, channel, firsthand = word("claim_kind", "REPORTED"), word("status", "UNRESOLVED"), word("evidence_class"), word("provenance_channel"), word("firsthand_status")
    p, stats, prob = c("prediction"), c("statistical_model"), c("probability_model")
    sources = F.size(F.array_distinct(F.filter(F.coalesce("source_pointers", F.array().cast("array<string>")), lambda x: F.trim(x) != "")))
    flagged = lambda name: F.coalesce(F.array_contains("flags", name), F.lit(False))
    no_tests, replicated = empty(c("falsification_tests")), F.coalesce(c("independent_replication"), F.lit(False))
    fact, formal, experiment, statistical, hypothesis = (evidence == x for x in EVIDENCE)
    named = lambda code, missing: F.when(F.size(missing) > 0, F.concat(F.lit(f"{code}:"), F.array_join(missing, ",")))
    truth = lambda x: F.coalesce(x, F.lit(False))
    first = codes(
        MISSING_CLAIM_ID=blank(c("claim_id")),
        MISSING_ORIGIN_AGENT_ID=blank(c("origin_agent_id")),
        MISSING_CLAIM_TEXT=blank(c("claim_text")),
        MISSING_RAW_CLAIM_TEXT=blank(F.coalesce(F.nullif(c("raw_claim_text"), F.lit("")), c("claim_text"))),
        INVALID_CLAIM_KIND=~kind.isin(*KINDS),
        DEPRECATED_HEURISTIC_OR_LEGACY_STATUS_FORBIDDEN_FOR_ACTIVE_CLAIM=status.isin(*OLD_STATUSES),
        INVALID_STATUS=~status.isin(*STATUSES, *OLD_STATUSES),
        MISSING_OR_INVALID_EVIDENCE_CLASS=~evidence.isin(*EVIDENCE),
        INVALID_PROVENANCE_CHANNEL=(channel != "") & ~channel.isin(*CHANNELS),
        INVALID_FIRSTHAND_STATUS=(firsthand != "") & ~firsthand.isin(*FIRSTHAND),
        UNCALIBRATED_CONFIDENCE_FORBIDDEN=c("confidence").isNotNull() & prob.isNull(),
        **{code: flagged(name) for name, code in FLAGS.items()},
        SOURCE_FACT_REQUIRES_SOURCE_POINTER=fact & (sources == 0),
        SOURCE_FACT_REQUIRES_PROVENANCE_CHANNEL=fact & (channel == ""),
        FORMAL_DERIVATION_REQUIRES_DERIVATION_OR_SOURCE_OBJECT=formal & empty(c("evidence_objects")) & (sources == 0),
        FORMAL_DERIVATION_STATUS_MISMATCH=formal & ~status.isin(*FORMAL_STATUSES),
        REPRODUCIBLE_EXPERIMENT_REQUIRES_VERSIONED_EVIDENCE_OBJECT=experiment & empty(c("evidence_objects")),
        FINITE_EXPERIMENT_CANNOT_BE_PROMOTED_TO_UNIVERSAL_PROOF=experiment & (status == "PROVED_IN_SCOPE"),
        STATISTICAL_INFERENCE_REQUIRES_MODEL=statistical & stats.isNull(),
    )
    model = named("STATISTICAL_MODEL_MISSING", F.when(statistical & stats.isNotNull(), _missing("statistical_model", STATISTICAL_FIELDS)).otherwise(F.array().cast("array<string>")))
    second = codes(
        STATISTICAL_STATUS_REQUIRES_MODEL=statistical & stats.isNull() & (status == "SUPPORTED_BY_STATISTICAL_INFERENCE_WITH_MODEL"),
        HYPOTHESIS_CANNOT_BE_PROMOTED_AS_EVIDENCE=hypothesis & ~status.isin(*HYPOTHESIS_STATUSES),
        HYPOTHESIS_REQUIRES_FALSIFICATION_ROUTE=hypothesis & no_tests,
    )
    chance = named("PROBABILITY_MODEL_MISSING", F.when(prob.isNotNull(), _missing("probability_model", PROBABILITY_FIELDS)).otherwise(F.array().cast("array<string>")))
    third = codes(
        INDEPENDENT_REPLICATION_REQUIRES_MULTIPLE_SOURCE_POINTERS=replicated & (sources < 2),
        INDEPENDENT_REPLICATION_REQUIRES_DEPENDENCY_ANALYSIS=replicated & empty(c("independence_evidence")),
        FROZEN_PREDICTION_MISSING_CRITERIA=truth(p["frozen"]) & (F.size(_missing("prediction", FREEZE_FIELDS)) > 0),
        PREDICTION_NOT_FROZEN_BEFORE_SCORING=truth(p["scored"]) & ~truth(p["frozen"]),
        NO_POST_HOC_REDEFINITION_TO_SAVE_A_FAILED_PREDICTION=truth(p["post_hoc_redefined"]),
        INVALID_PREDICTION_SCORE=~blank(p["score"]) & ~F.upper(p["score"]).isin(*SCORES),
    )
    seen = kind.isin("REPORTED", "OBSERVED", "MEASURED")
    warnings = codes(
        SOURCE_FACT_IS_REPORT_OCCURRENCE_ONLY_FOR_CONTEXT_CHANNEL=fact & channel.isin(*CONTEXT_CHANNELS) & (status == "SOURCE_BOUND_FACT"),
        ALTERNATIVE_HYPOTHESES_NOT_RECORDED=kind.isin("HYPOTHESIS", "STATISTICAL", "DERIVED") & empty(c("alternative_hypotheses")),
        EVENT_TIME_NOT_RECORDED=c("event_time").isNull() & seen,
        EVENT_LOCATION_NOT_RECORDED=c("event_location").isNull() & seen,
        CLOSED_BELIEF_LOOP_WARNING=hypothesis & no_tests,
    )
    errors = F.concat(first, F.array_compact(F.array(model)), second, F.array_compact(F.array(chance)), third)
    return claims.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("admissible", F.size("errors") == 0)


def verify_chain(rows: DataFrame, group: str, order: str, sha: str = "sha", previous: str = "previous") -> DataFrame:
    """(group, links, intact, first_broken): whether each row names the hash of the one before it in its group, the first 64 zeros; first_broken is the order of the first that doesn't."""
    w = W.partitionBy(group).orderBy(order)
    ok = F.col(previous).eqNullSafe(F.coalesce(F.lag(sha).over(w), F.lit("0" * 64)))
    checked = rows.withColumn("_ok", ok).groupBy(group)
    return checked.agg(F.count(F.lit(1)).alias("links"), F.bool_and("_ok").alias("intact"), F.min(F.when(~F.col("_ok"), F.col(order))).alias("first_broken"))
