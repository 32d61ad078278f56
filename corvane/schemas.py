"""Explicit schemas of the engine's documents: sources are never inferred."""

from __future__ import annotations

CONCEPT = "STRUCT<concept: STRING, description: STRING>"
THEORY = f"STRUCT<name: STRING, key_concepts: ARRAY<{CONCEPT}>, description: STRING, evidence: STRING, confidence_is_theory: STRING, mode: STRING, criteria_reasoning: STRING, paper_focus: STRING>"
PAPER_RESULT = f"STRUCT<doi: STRING, pmid: STRING, title: STRING, validation_result: STRING, confidence_score: INT, contains_theory: BOOLEAN, theories: ARRAY<{THEORY}>, timestamp: STRING>"
EXTRACTION = f"metadata STRUCT<extraction_date: STRING, pipeline_version: STRING>, results ARRAY<{PAPER_RESULT}>"
ALIAS_ENTRY = "STRUCT<name: STRING, aliases: ARRAY<STRING>, abbreviations: ARRAY<STRING>>"
ALIAS_ONTOLOGY = f"MAP<STRING, MAP<STRING, MAP<STRING, ARRAY<{ALIAS_ENTRY}>>>>"
MECHANISM = "theory_name STRING, mechanisms ARRAY<STRING>, pathways ARRAY<STRING>, key_players ARRAY<STRING>, level_of_explanation STRING, type_of_cause STRING, temporal_focus STRING"
QUESTIONS = "MAP<STRING, STRUCT<question: STRING, answers: STRING>>"
SYNONYMS = "MAP<STRING, ARRAY<STRING>>"
MATCH = "STRUCT<matched: BOOLEAN, canonical_name: STRING, matched_alias: STRING, score: DOUBLE, match_type: STRING, reasoning: STRING>"
STAGE6 = (
    "cluster_name STRING, batch_num INT, batch_result STRUCT<subclusters: ARRAY<STRUCT<subcluster_name: STRING, theory_ids: ARRAY<STRING>, mechanism_focus: STRING, "
    "theory_count: INT, status: STRING, warning_reason: STRING>>, separation_rationale: STRING>, timestamp STRING"
)
ANSWERS = "MAP<STRING, STRUCT<answer: STRING, confidence: DOUBLE, reasoning: STRING>>"
FINAL_MAP = "theories ARRAY<STRUCT<name: STRING, dois: ARRAY<STRING>>>"
REQUEST_LOG = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
