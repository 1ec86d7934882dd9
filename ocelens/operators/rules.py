"""Rules: a template name, its parameters and the texts evidence records carry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LEGAL_BASIS_TYPE = (
    "array<struct<instrument:string,article:string,paragraph:string,requirement:string>>"
)
STANDARD_REFS_TYPE = (
    "array<struct<standard:string,clause:string,control:string,framework:string,function:string>>"
)


@dataclass(frozen=True)
class Rule:
    """``standard_refs`` are the caller's own references to standards; the shipped rules have none."""

    constraint_id: str
    template: str
    severity: str
    params: dict = field(default_factory=dict)
    formal: str = ""
    natural_language: str = ""
    legal_basis: tuple[tuple[str, str, str, str], ...] = ()
    standard_refs: tuple[dict[str, str], ...] = ()


_AI_ACT = "Regulation (EU) 2024/1689"

RULESET_VERSION = "2026-08.1"

# Constraint ids, severities, template parameters and cited articles of
# the shipped credit ruleset.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "T1.synchronised_approval",
        "t1_synchronised_approval",
        "high",
        {
            "allowed_roles": ["credit_officer", "senior_underwriter", "risk_manager"],
            "decision_outcomes": ["grant", "deny"],
        },
        "each approval-bound decision has an earlier grant of that decision by an allowed role",
        "A decision that needs approval must first be approved, for itself, by an authorised person.",
        (
            (_AI_ACT, "14", "4(d)", "overseers can disregard, override or reverse the output"),
            (_AI_ACT, "26", "2", "oversight is assigned to competent and authorised persons"),
        ),
    ),
    Rule(
        "T2.mandatory_data_coverage",
        "t2_mandatory_data_coverage",
        "medium",
        {"required_sources": ["credit_bureau", "income_verification", "internal_credit_history"]},
        "the resource types retrieved for a decision's applications include every required source",
        "A decision must rest on all mandated data sources for its application.",
        (
            (_AI_ACT, "10", "3", "data sets are relevant, representative and complete"),
            (_AI_ACT, "15", "1", "accuracy and robustness over the lifecycle"),
        ),
    ),
    Rule(
        "T3.delegation_integrity",
        "t3_delegation_integrity",
        "medium",
        {"entrypoint_roles": ["intake"]},
        "each acting agent is an entrypoint or was handed control earlier; handoffs are acyclic",
        "An agent may only act after control was handed to it, and delegation may not loop.",
        (
            (_AI_ACT, "14", "2", "oversight prevents or minimises risks in use"),
            (_AI_ACT, "26", "1", "systems are used according to their instructions"),
        ),
    ),
    Rule(
        "T4.reason_code_presence",
        "t4_reason_code_presence",
        "medium",
        {"adverse_outcomes": ["deny", "refer"]},
        "each adverse decision object has reason codes and some reasoning event explains it",
        "An adverse decision must carry reason codes and be explained.",
        (
            (_AI_ACT, "13", "1", "operation is transparent enough to interpret the output"),
            (_AI_ACT, "86", "1", "affected persons obtain an explanation of the decision"),
        ),
    ),
    Rule(
        "T5.prohibited_attribute_access",
        "t5_prohibited_attribute_access",
        "high",
        {"prohibited_classifications": ["special_category"]},
        "no application-related read touches a prohibited resource without a lawful basis",
        "Special-category data may only be read with a recorded lawful basis.",
        ((_AI_ACT, "10", "2(f)-(g)", "bias examination and mitigation are governed"),),
    ),
    Rule(
        "STD.policy_version_current",
        "object_absence",
        "medium",
        {
            "anchor_event_type": "make_decision",
            "qualifier": "governed_by",
            "object_type": "PolicyVersion",
            "attribute": "effective_to",
            "violating_when": "non_empty",
        },
        "no decision is governed by a policy version whose validity has ended",
        "A decision must be governed by the policy version in force.",
        (
            (_AI_ACT, "72", "1", "post-market monitoring is established and documented"),
            (_AI_ACT, "72", "2", "performance data is collected over the lifetime"),
        ),
    ),
)


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The rule texts as a table (one row per rule, so always small)."""
    fields = ("standard", "clause", "control", "framework", "function")
    rows = [
        (
            r.constraint_id,
            r.severity,
            r.formal,
            r.natural_language,
            [tuple(b) for b in r.legal_basis],
            [tuple(ref.get(f) for f in fields) for ref in r.standard_refs],
        )
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "constraint_id string, severity string, formal string, natural_language string, "
        f"legal_basis {LEGAL_BASIS_TYPE}, standard_refs {STANDARD_REFS_TYPE}",
    )
