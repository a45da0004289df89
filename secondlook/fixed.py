"""Constants that results depend on and that must not drift.

Nothing here is logic. Tables keep their natural order because order carries meaning: the first
matching confusion pattern wins, and similarity ties are broken by position.
"""

# The prompt version takes part in the prompt hash.
PROMPT_VERSION = "v1.1"
DEFAULT_MODEL = "offline-mock"

# The verdict domain.
CORRECT = "Correct"
INCORRECT = "Incorrect"
UNCERTAIN = "Uncertain"
VERDICTS = (CORRECT, INCORRECT, UNCERTAIN)

# Length limits and the marker appended to cut text.
MAX_RESPONSE_CHARS = 5000
MAX_REASONING_CHARS = 2000
MAX_EXPLANATION_CHARS = 1000
TRUNCATION_MARK = "... [TRUNCATED]"

# Redaction marks.
REDACTED_SHORT = "[REDACTED]"
REDACTED_MIDDLE = "[...REDACTED...]"

# Provenance warnings stored with the artifacts.
RUN_WARNING = "UNTRUSTED: LLM-generated content requires human verification"
METRICS_WARNING = "UNTRUSTED: Statistics derived from LLM outputs"

# Artifact names of a saved run.
ARTIFACTS = {
    "manifest": "00_config.json",
    "samples": "01_synthetic_data.csv",
    "results": "02_review_results.json",
    "labeled": "03_labeled_dataset.csv",
    "report": "04_report.md",
    "metrics": "05_metrics.json",
}

# Cache lifetime (7 days) and retry policy.
CACHE_TTL_SECONDS = 168 * 3600
MAX_RETRIES = 3
RETRY_BASE_SECONDS = 1.0
RETRY_JITTER_SECONDS = 0.5
RETRYABLE_STATUS = (408, 429)

# Noise rate and confidence ranges in hundredths (low, high), both ends included.
NOISE_RATE = 0.35
NOISY_CONFIDENCE = (55, 82)
CLEAN_CONFIDENCE = (78, 98)

# Label names of the default taxonomy (definitions are this project's own wording).
DEFAULT_TAXONOMY = (
    ("Access Request", "The writer wants to know or receive which personal data is held on them."),
    ("Erasure", "The writer wants personal data removed for good."),
    ("Rectification", "The writer reports wrong or outdated personal data and wants it fixed."),
    ("Portability", "The writer wants personal data handed over in a reusable file or moved elsewhere."),
    ("Objection", "The writer refuses one particular use of personal data."),
    ("Complaint", "The writer formally reports a grievance about data handling."),
    ("General Inquiry", "The writer asks an open question about privacy practice."),
)

# Fixed values: (actual label, label it is mistaken for); the first entry per actual label counts.
CONFUSION_PATTERNS = (
    ("Erasure", "Access Request"),
    ("Portability", "Access Request"),
    ("Objection", "Erasure"),
    ("Rectification", "General Inquiry"),
    ("Complaint", "Objection"),
)

# Fixed values: (actual label, candidate, weight), in tie-breaking order; other pairs weigh 0.1.
LABEL_SIMILARITY = (
    ("Access Request", "Portability", 0.7),
    ("Access Request", "General Inquiry", 0.4),
    ("Access Request", "Erasure", 0.3),
    ("Erasure", "Objection", 0.6),
    ("Erasure", "Portability", 0.4),
    ("Erasure", "Access Request", 0.3),
    ("Rectification", "General Inquiry", 0.5),
    ("Rectification", "Access Request", 0.3),
    ("Portability", "Access Request", 0.7),
    ("Portability", "Erasure", 0.4),
    ("Objection", "Erasure", 0.6),
    ("Objection", "Complaint", 0.5),
    ("Complaint", "Objection", 0.5),
    ("Complaint", "General Inquiry", 0.3),
    ("General Inquiry", "Access Request", 0.4),
    ("General Inquiry", "Rectification", 0.3),
)
UNLISTED_WEIGHT = 0.1
NO_PATTERN = "(random)"

# Default templates (this project's own sentences; callers normally pass their own table).
DEFAULT_TEMPLATES = (
    ("Access Request", "Tell me which records about me you store."),
    ("Access Request", "Kindly mail me everything you know about me."),
    ("Erasure", "Take my details off your servers for good."),
    ("Erasure", "Close the account and purge what belongs to me."),
    ("Rectification", "The birthday in my profile is off by one day."),
    ("Rectification", "Replace the old street name with my new one."),
    ("Portability", "Hand me a CSV of my history for another provider."),
    ("Portability", "Move my playlists over to the other service."),
    ("Objection", "No more newsletters built from my purchases."),
    ("Objection", "Leave me out of any automated scoring."),
    ("Complaint", "I am lodging a grievance over last week's leak."),
    ("Complaint", "Nobody answered my privacy ticket, so this is official."),
    ("General Inquiry", "For how many months are logs retained?"),
    ("General Inquiry", "Is your cookie banner certified?"),
)

# The mock reviewer's sentences; {} is filled from the row.
MOCK_OK = "The predicted label accurately captures the semantic intent."
MOCK_WRONG = ("The text indicates ", ", not ", ".")
MOCK_EXPLANATION = ("Classification as ", ".")
UNKNOWN_LABEL = "Unknown"
FAILED_EXPLANATION = "Review failed"

# Prompt-injection patterns, matched anywhere and in any letter case.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|context)",
    r"ignore\s+previous\s+instructions",
    r"disregard\s+(the\s+)?(all\s+)?(above|previous)",
    r"forget\s+(everything|all|previous|what)",
    r"new\s+instructions?:",
    r"override\s+(the\s+)?(previous|all)",
    r"system\s*:",
    r"(you are|act as|pretend to be)\s+(now|a\s+different)",
    r"\[system\]",
    r"<\s*system\s*>",
    r"assistant\s*:",
    r"\[inst\]",
    r"<<sys>>",
    r"output\s+only",
    r"respond\s+with\s+only",
    r"say\s+(exactly|only)",
    r"print\s+(only|exactly)",
    r"dan",
    r"developer\s+mode",
    r"jailbreak",
    r"bypass\s+(the\s+)?(filter|safety|restriction)",
    r"reveal\s+(your|the)\s+(instructions?|prompt|system)",
    r"show\s+me\s+(your|the)\s+(prompt|instructions?|system)",
    r"what\s+(are|is)\s+(your|the)\s+(instructions?|prompt)",
    r"<script",
    r"javascript:",
    r"onclick\s*=",
    r"onerror\s*=",
)

# Personal-data patterns in reporting order, matched in any letter case.
PII_PATTERNS = (
    ("email", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b"),
    ("phone", r"\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}\b"),
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("name_like", r"\b(?:mr\.|mrs\.|ms\.|dr\.)\s+[a-z][a-z]+\b"),
)

# Issue texts of the output check; {} is filled from the row.
ISSUE_TOO_LONG = "Response exceeds max length ({} > {})"
ISSUE_VERDICT = "Invalid verdict '{}' sanitized to {}"
ISSUE_LABEL = "Rejected unknown label '{}'"
ISSUE_DOWNGRADE = "Downgraded verdict to Uncertain due to invalid label"
ISSUE_REASONING = "Reasoning truncated ({} > {})"
ISSUE_EXPLANATION = "Explanation truncated ({} > {})"
ISSUE_INJECTION = "Suspicious pattern detected: potential prompt injection"

# Prompt wording (this project's own; a caller may pass another template, and the hash follows it).
PROMPT_TEMPLATE = """You check whether a text classifier chose the right category.

# Categories
{labels}

# Case
Text: "{text}"
Predicted Label: {pred_label}
Confidence: {confidence}

# Answer
Decide if the predicted label fits what the text means, then reply with these four lines only:
VERDICT: Correct, Incorrect or Uncertain
REASONING: the reason, in one sentence
SUGGESTED_LABEL: the better category when Incorrect, otherwise None
EXPLANATION: a short note for a non-technical reader"""

COMPACT_PROMPT_TEMPLATE = """Does "{pred_label}" ({confidence}) fit this text: "{text}"?
Categories: {labels}
Answer in four lines: VERDICT: Correct/Incorrect/Uncertain, REASONING: one sentence, \
SUGGESTED_LABEL: category or None, EXPLANATION: short note"""
COMPACT_DEFINITION_CHARS = 40
