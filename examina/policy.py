"""The supervisory policy. Values that must equal the published policy stand here, as text."""

from __future__ import annotations

# Escalation deadlines in seconds and the severities that must escalate.
ESCALATION_SECONDS = {"CRITICAL": 1800, "HIGH": 7200, "MEDIUM": 86400, "LOW": 604800}
# Seconds within which a case must be closed, 86400 for any other severity.
CLOSURE_SECONDS = {"CRITICAL": 14400, "HIGH": 43200, "MEDIUM": 86400, "LOW": 259200}
ESCALATING = ("CRITICAL", "HIGH")
# Actions that a closed case of a severity must show, and whether with a digest.
REQUIRED_ACTIONS = {"CRITICAL": (("HOST_ISOLATION", "FORENSIC_TRIAGE"), True), "HIGH": (("FORENSIC_TRIAGE",), False)}
# Texts that say nothing.
PLACEHOLDERS = ("", "UNKNOWN", "NONE", "NULL", "N/A", "NA", "UNDEFINED", "PENDING", "PLACEHOLDER", "-")
# Phrases of an escalation outside the records.
OUT_OF_BAND = ("out-of-band", "out of band", "escalated via phone", "phone escalation", "verbal escalation", "phoned on-call", "called on-call")
# Metrics whose claims are reconciled.
CLOSURE_METRICS = ("case_closure_sla_compliance_rate", "incident_sla_compliance_pct", "incident_sla_compliance", "incident_sla_pct", "sla_compliance")
ESCALATION_METRICS = ("escalation_sla_compliance_rate",)
PERCENT_UNITS = ("percent", "percentage", "%")
# Agent states of a coverage gap.
BROKEN_AGENTS = ("UNHEALTHY", "DISCONNECTED", "MISSING")
# Words of an export scope that isn't whole.
PARTIAL_SCOPES = ("sample", "subset", "partial", "filtered", "incomplete", "selected")
# Record types whose sources the rules ask for.
RECORD_TYPES = ("cases", "investigation_actions", "escalations", "assets", "reported_claims")
# Issues that leave a source incomplete besides errors.
BLOCKING_ISSUES = ("ROW_COUNT_MISMATCH", "TIMESTAMP_OUT_OF_PERIOD")
RULES = ("POL-INV-001", "POL-ESC-002", "POL-COV-003", "POL-KPI-004", "POL-REC-005")
ADVERSE = ("potential_concern", "contradictory")
#: Alerts of an asset that count as recurrence (a parameter of the detector).
RECURRENCE = 3
