"""Results are only comparable when these stay exactly as they are."""

# --- fixed values: workflow words -------------------------------------------------
BUG_TYPE = "Bug"
STATUS_FIELD = "status"
COMMENT_FIELD = "Comment"
ATTACHMENT_FIELD = "Attachment"
RESOLUTION_WORDS = ["resolved", "closed", "done", "fixed", "completed"]
REOPEN_WORDS = ["reopened", "in progress", "open", "todo", "to do", "in development"]
REOPENED = "reopened"

# --- fixed values: sentiment lexicon, buckets and their upper bounds ---------------
POSITIVE_PATTERNS = [
    "thank", "good", "great", "excellent", "awesome",
    "works", "working", "fixed", "resolved", "solved",
    "correct", "perfect", "nice", "love", "happy",
    "helpful", "appreciated", "appreciate",
]
NEGATIVE_PATTERNS = [
    "bug", "issue", "problem", "error", "fail",
    "failed", "wrong", "bad", "broken", "not work",
    "doesn't work", "incorrect", "crash", "stuck",
    "terrible", "horrible", "awful", "disappointing",
]
SENTIMENTS = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
SENTIMENT_BOUNDS = [-0.6, -0.2, 0.2, 0.6]

# --- fixed values: text cleaning, applied in this order to lower-cased text ---------
TEXT_PATTERNS = [(r"<[^>]+>", ""), (r"http\S+", ""), (r"[^a-zA-Z\s]", " ")]
MIN_TEXT_LENGTH = 10

# --- fixed values: table contracts --------------------------------------------------
REQUIRED_COLUMNS = {
    "issues": ["key", "created", "updated", "status_name", "priority_name", "issuetype_name"],
    "comments": ["key", "comment_id"],
    "changelog": ["key", "field", "id"],
}
DEDUPE_KEYS = {"issues": "key", "comments": "comment_id", "changelog": "id"}
BODY_COLUMNS = ["comment_body", "body", "comment_text", "text"]
CENTURY_PREFIX = "20"
NUMERIC_FEATURES = [
    "summary_length", "description_length", "comment_count", "attachment_count", "status_change_count",
    "resolution_time_days",
]
SLOW_COLUMNS = ["issuetype_name", "priority_name", "project_name", "status_name"]
