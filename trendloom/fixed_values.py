"""Word lists, lookup tables, patterns, formats and limits.

Everything here must equal the published behaviour for results to match, so it is kept as plain text in one place.
"""

# Whitespace that a full (Unicode) strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# CSV header -> canonical column name (headers are trimmed and lower-cased first).
COLUMN_ALIASES = {
    "ticket subject": "subject",
    "ticket_subject": "subject",
    "ticket description": "description",
    "ticket_description": "description",
    "date of purchase": "date",
    "ticket priority": "priority",
    "ticket type": "ticket_type",
    "product area": "product_area",
    "product purchased": "product_area",
    "product_purchased": "product_area",
    "ticket id": "raw_ticket_id",
    "ticket_id": "raw_ticket_id",
    "ticket status": "status",
}
CSV_COLUMNS = ("subject", "description", "date", "priority", "ticket_type", "product_area", "raw_ticket_id", "status")

# Enumerations.
PRIORITIES = ("Low", "Medium", "High", "Critical")
TRENDS = ("Increasing", "Decreasing", "Stable")
JOB_TYPES = ("recluster", "csv_upload", "amazon_sync", "webhook")
JOB_STATUSES = ("running", "success", "failed")
STATUS_MAP = {"Pending Customer Response": "Open", "Open": "Open", "Closed": "Closed"}

# Defaults.
DEFAULT_PRIORITY = "Medium"
DEFAULT_TICKET_TYPE = "Support Request"
DEFAULT_PRODUCT_AREA = "General"
DEFAULT_STATUS = "Open"
DEFAULT_SOURCE = "manual"
CSV_SOURCE = "support"
STREAM_SOURCE = "webhook"
SUBJECT_CHARS = 80
PLACEHOLDER = "{product_purchased}"

# Windows and trend rule.
WINDOW_DAYS = 30
TREND_THRESHOLD = 0.25
PROJECTION_FACTOR = 1.3
MONTHS_LISTED = 12

# Clustering.
CLUSTER_MIN = 7
CLUSTER_MAX = 20
TICKETS_PER_CLUSTER = 12
KMEANS_MAX_ITER = 20
KMEANS_RUNS = {"euclidean": (10, 300), "cosine": (1, KMEANS_MAX_ITER)}  # starts and most rounds of each measure
KMEANS_SEED = 42
EMBEDDING_DIM = 1536

# Similarity search.
SIMILARITY_THRESHOLD = 0.60
SIMILARITY_LIMIT = 10
SIMILARITY_LIMIT_MAX = 50

# Model calls.
EMBED_BATCH = 100
RETRIES = 3
RETRY_BASE_SECONDS = 0.5
PAYLOAD_CHARS = 500
NAME_SUBJECTS = 6
SUMMARY_SUBJECTS = 10
ALERT_SUBJECTS = 6
CARD_SUBJECTS = 3
FALLBACK_NAME = "General Issues"
FALLBACK_DESCRIPTION = "Miscellaneous support tickets."

# Segment label -> pattern over the cluster name; the first match in this order counts, case ignored.
SEGMENTS = (
    ("Connectivity", "connect|wireless|bluetooth|usb|sync|pair|detect"),
    ("Hardware", "defect|hardware|scroll|wheel|key|mouse|camera|webcam|audio|bass|distort|controller|click"),
    ("Software", "software|firmware|driver|rgb|light|app|update"),
    ("Delivery", "ship|deliver|order|missing|packag"),
    ("Returns", "return|warrant|refund|replac|exchange"),
)
OTHER_SEGMENT = "Other"

# Theme keywords over the lower-cased cluster name and the summary given offline; the first match in this order counts.
THEMES = (
    (
        "setup",
        ("setup", "install", "onboard", "configuration", "start"),
        "Tickets consistently reveal that users are blocked during first-time device registration due to a mismatch between the bundled firmware version and the latest desktop client requirements. The root cause is a production release gap where hardware units shipped without the v2.4 firmware pre-loaded, causing the setup wizard to stall at the pairing step.",
    ),
    (
        "crash",
        ("crash", "freeze", "unresponsive", "black screen", "force quit"),
        "A recurring memory leak introduced in the v3.1.2 application update is causing the process to exceed its 512 MB heap limit after approximately 45 minutes of continuous use, triggering a fatal exception. The issue is isolated to devices running macOS 14.3+ where the new graphics compositor conflicts with the legacy rendering pipeline.",
    ),
    (
        "network",
        ("network", "connectivity", "offline", "disconnect", "wifi", "internet"),
        "Customers are experiencing intermittent disconnection events traced to an aggressive Wi-Fi sleep policy introduced in the recent firmware update that drops the connection after 90 seconds of low data-rate activity. The underlying cause is an incorrect DTIM interval setting (set to 10 instead of 1) that causes the router to stop buffering packets for the device.",
    ),
    (
        "login",
        ("login", "auth", "password", "sign in", "account", "token", "session"),
        "An expired OAuth token rotation policy is causing users to be silently logged out every 24 hours without re-authentication prompts, which is particularly impacting enterprise SSO customers whose IdP tokens have a shorter-than-default TTL. The fix requires updating the token refresh logic to honour the IdP-provided `expires_in` field rather than the hardcoded 86,400-second default.",
    ),
    (
        "billing",
        ("billing", "payment", "charge", "invoice", "subscription", "refund"),
        "Duplicate billing events are being generated when customers update their payment method within the same billing cycle, caused by a race condition between the webhook processor and the subscription scheduler that fires two `invoice.created` events in under 200 ms. Idempotency key handling is missing on the `/update-payment` endpoint, allowing the downstream payment processor to charge the card twice.",
    ),
    (
        "data",
        ("data", "sync", "lost", "missing", "backup", "save", "restore"),
        "Data loss is occurring when users switch between devices before the background sync completes, because the conflict-resolution algorithm incorrectly treats the lower device-clock timestamp as the authoritative version, overwriting newer local changes. The root cause is reliance on wall-clock time rather than vector clocks for merge ordering, which breaks across timezone boundaries.",
    ),
    (
        "performance",
        ("slow", "performance", "lag", "delay", "loading", "speed"),
        "Dashboard load times have degraded from ~400 ms to over 4 seconds following last week's analytics feature rollout, which introduced N+1 query patterns that fire one SQL round-trip per cluster row instead of a single aggregated join. The primary query is missing an index on `cluster_members.cluster_id`, causing full-table scans on a 80k-row table with every page load.",
    ),
)
OTHER_THEME = (
    "other",
    "Analysis of the support ticket patterns reveals a systemic gap between customer expectations and the current product behaviour, likely originating from an undocumented breaking change in the latest release. Immediate investigation of the change-log diff between the two most recent production deployments is recommended to pinpoint the regression.",
)

# Prompts. {subjects} is a list of lines, {name} the cluster name.
NAME_PROMPT = (
    "You are an expert at categorizing customer support tickets.\n"
    "Given the following support ticket subjects from a single issue cluster, provide:\n"
    "1. A short, clear issue name (3-5 words, title case, no punctuation)\n"
    "2. A one-sentence description of the underlying problem\n\n"
    "Ticket subjects:\n{subjects}\n\n"
    "Respond in JSON with keys 'name' and 'description' only."
)
SUMMARY_PROMPT = (
    'Issue cluster: "{name}"\n\nRecent tickets:\n{subjects}\n\nProvide a 2-sentence root cause summary.'
)
SUMMARY_SYSTEM = (
    "You are a senior support analyst at a D2C hardware company. Analyse the provided support tickets and return exactly "
    "2 sentences: (1) what the root cause is, (2) what its technical impact is. Be specific, technical, and actionable. "
    "No filler. No bullet points—just 2 plain sentences."
)
# {company} and {platform} name the sender.
ALERT_SYSTEM = (
    "You are the Head of Support at {company}, a D2C hardware company. Write urgent, professional QA Alert emails to the "
    "hardware manufacturing team when AI detects support ticket spikes. Format: Subject line, opening paragraph with "
    "context, a 'SIGNAL SUMMARY' section with bullet stats, a 'REQUESTED ACTIONS (P0)' numbered list, a 'CUSTOMER IMPACT' "
    "paragraph, and a professional sign-off from '{platform}'. Use plain text, not markdown."
)
ALERT_COMPANY = "the company"
ALERT_PROMPT = (
    'Draft a QA Alert email for this spike:\n\nIssue Category: "{name}"\nPrevious 30-day window: {prev} tickets\n'
    "Current 30-day window: {curr} tickets\nChange: +{pct}%\n\nSample affected tickets:\n{subjects}\n\n"
    "The email must be addressed to the Hardware Manufacturing & QA Team and request immediate investigation with "
    "specific, actionable steps."
)

# Alert mail given offline. {rule} is a line of 45 heavy bars, {platform} the sender.
ALERT_RULE = "━" * 45
ALERT_PLATFORM = "Support Intelligence Platform"
ALERT_TEMPLATE = """Subject: [URGENT QA ALERT] {pct}% Spike Detected — {name}

Dear Hardware Manufacturing & QA Team,

I am writing to escalate an urgent quality signal that demands immediate attention from your team.

Over the past 30-day window, our AI-powered support intelligence platform has detected a {pct}% increase in customer-reported tickets related to "{name}" ({prev} tickets → {curr} tickets). This rate of increase exceeds our critical threshold and strongly suggests a systemic issue originating from the manufacturing or firmware pipeline rather than isolated customer error.

{rule}
SIGNAL SUMMARY
{rule}
• Category: {name}
• Previous 30-day volume: {prev} tickets
• Current 30-day volume: {curr} tickets
• Change: +{pct}% (CRITICAL THRESHOLD EXCEEDED)
• Detection method: Semantic clustering + trend analysis

{rule}
REQUESTED ACTIONS (P0 — Within 24 hours)
{rule}
1. Audit the firmware version and hardware BOM of units shipped in the last 60 days
2. Cross-reference with the production change log for any component substitutions or supplier changes
3. Pull a statistically significant sample from the current batch for accelerated stress testing
4. Confirm whether this spike correlates with a specific regional distribution centre or SKU variant
5. Halt further shipments of flagged SKUs pending QA sign-off if root cause is confirmed

{rule}
CUSTOMER IMPACT
{rule}
At the current trajectory, we project {projected} tickets in the next 30-day window if left unaddressed. Each unresolved ticket represents an average of 2.4 customer touchpoints and a significant risk to NPS and public reviews.

Please treat this as a P0 escalation. I will schedule a joint support–QA sync call for tomorrow at 10:00 AM to review findings. In the meantime, please reply with an initial assessment within 4 hours so we can update our support team with any known workarounds.

Best regards,
{platform}
{rule}
This alert was auto-generated. Do not reply to this automated message."""
