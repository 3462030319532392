"""Fixed values of the model: vocabularies, tables and thresholds, in their natural order."""

ENTITY_TYPES = ("Person", "Organization", "Technology", "Place", "Project", "Concept", "Event")

# Half-lives in days by tier.
HALF_LIVES = {"structural": 1000, "professional": 180, "social": 30, "ephemeral": 7}
DEFAULT_TIER = "social"

# Relation types of each tier.
TIERS = {
    "structural": ("IS_A", "PART_OF", "PARENT_OF", "CHILD_OF", "STUDIED_AT", "ALUMNI_OF"),
    "professional": ("WORKS_AT", "WORKS_ON", "SKILLED_IN", "LIVES_IN", "USES", "LOCATED_IN", "CREATED", "MANAGES", "DEPENDS_ON", "REPORTS_TO", "COLLABORATES_WITH", "CUSTOMER_OF", "ATTENDS", "TEACHES_AT"),
    "social": ("KNOWS", "FRIEND_OF", "CLASSMATE_OF", "MENTORS", "MENTORED_BY", "CONTACT_OF", "INTERESTED_IN", "RECEIVED_FROM"),
    "ephemeral": ("MENTIONS", "DISCUSSED_WITH", "SAID", "RELATED_TO"),
}

# Relation types that edges may have.
RELATION_TYPES = (
    "WORKS_ON", "WORKS_AT", "KNOWS", "USES", "LOCATED_IN", "DISCUSSED_WITH", "INTERESTED_IN", "CREATED", "MANAGES",
    "DEPENDS_ON", "RELATED_TO", "MENTIONS", "CLASSMATE_OF", "STUDIED_AT", "ALUMNI_OF", "MENTORS", "MENTORED_BY",
    "REPORTS_TO", "COLLABORATES_WITH", "CONTACT_OF", "CUSTOMER_OF", "ATTENDS", "PARENT_OF", "CHILD_OF",
    "RECEIVED_FROM", "TEACHES_AT",
)

# Names that never become entities.
BLOCKED_NAMES = (
    "api", "url", "cli", "ssh", "dns", "ssl", "tls", "tcp", "udp", "http", "https", "json", "yaml", "html", "css", "xml",
    "csv", "sql", "jwt", "oauth", "env", "pid", "uid", "cwd", "eof", "stdin", "stdout", "stderr", "captchas", "mentions",
    "tasks", "dedup", "restart", "sighup", "sigterm", "tier_silent", "heartbeat", "heartbeat_ok", "no_reply",
    "education", "salary", "latency", "budget", "deadline", "update", "question", "answer", "problem", "solution",
    "issue", "error", "bug", "feature", "config", "settings", "options", "status", "result", "output", "input", "data",
    "file", "folder", "directory", "path", "link", "eliminator", "hammocks", "eco-chic", "self-modeling",
    "agent.py", "main.py", "index.ts", "index.js", "/tools/", "bash allowlist", "cre deal", "commitment reminders",
    "heartbeat check", "catch-up semantics", "wynwood",
    "morning", "evening", "today", "tomorrow", "yesterday", "weekend", "monday", "tuesday", "wednesday", "thursday",
    "friday", "saturday", "sunday",
)

# Sources that ingest accepts, and the least confidence by source.
SOURCES = ("manual", "whatsapp", "voice", "email", "imessage", "session", "conversation", "correction", "contacts_json")
MIN_CONFIDENCE = {"session": 0.55, "conversation": 0.55, "whatsapp": 0.55, "imessage": 0.55, "email": 0.45, "voice": 0.50, "correction": 0.55, "contacts_json": 0.40}
DEFAULT_MIN_CONFIDENCE = 0.4

# Plausibility of (head type, relation, tail type).
PLAUSIBLE = (
    ("Person", "WORKS_AT", "Organization", 1.00), ("Person", "WORKS_AT", "Place", 0.80),
    ("Person", "CONTACT_OF", "Person", 1.00), ("Person", "KNOWS", "Person", 1.00),
    ("Person", "DISCUSSED_WITH", "Person", 1.00), ("Person", "COLLABORATES_WITH", "Person", 1.00),
    ("Person", "COLLABORATES_WITH", "Organization", 0.85), ("Person", "MANAGES", "Person", 0.90),
    ("Person", "MANAGES", "Project", 0.95), ("Person", "MANAGES", "Organization", 0.85),
    ("Person", "REPORTS_TO", "Person", 0.85), ("Person", "STUDIED_AT", "Organization", 1.00),
    ("Person", "ALUMNI_OF", "Organization", 1.00), ("Person", "CLASSMATE_OF", "Person", 1.00),
    ("Person", "ATTENDS", "Event", 0.90), ("Person", "ATTENDS", "Organization", 0.80),
    ("Person", "CHILD_OF", "Person", 0.80), ("Person", "PARENT_OF", "Person", 0.80),
    ("Person", "MENTORED_BY", "Person", 0.85), ("Person", "MENTORS", "Person", 0.85),
    ("Person", "LOCATED_IN", "Place", 1.00), ("Organization", "LOCATED_IN", "Place", 1.00),
    ("Place", "LOCATED_IN", "Place", 0.90), ("Person", "MEMBER_OF", "Organization", 1.00),
    ("Person", "MEMBER_OF", "Concept", 0.75), ("Person", "USES", "Technology", 0.95),
    ("Organization", "USES", "Technology", 0.90), ("Person", "CREATED", "Technology", 0.95),
    ("Person", "CREATED", "Project", 0.95), ("Organization", "CREATED", "Technology", 0.90),
    ("Person", "WORKS_ON", "Project", 1.00), ("Person", "INTERESTED_IN", "Concept", 0.90),
    ("Person", "INTERESTED_IN", "Technology", 0.90), ("Organization", "RELATED_TO", "Organization", 0.70),
    ("Person", "CUSTOMER_OF", "Organization", 0.85), ("Person", "RECEIVED_FROM", "Person", 0.75),
    ("Person", "RECEIVED_FROM", "Organization", 0.80), ("Person", "TEACHES_AT", "Organization", 1.00),
    ("Person", "MENTIONS", "Person", 0.70), ("Person", "MENTIONS", "Organization", 0.70),
    ("Person", "MENTIONS", "Place", 0.70), ("Person", "MENTIONS", "Technology", 0.70),
)
IMPLAUSIBLE = (
    ("Organization", "CHILD_OF", "Person", 0.20), ("Organization", "PARENT_OF", "Person", 0.20),
    ("Technology", "REPORTS_TO", "Person", 0.15), ("Place", "REPORTS_TO", "Person", 0.15),
    ("Technology", "WORKS_AT", "Organization", 0.20), ("Event", "WORKS_AT", "Organization", 0.20),
    ("Organization", "MENTORED_BY", "Person", 0.25), ("Organization", "MENTORS", "Person", 0.25),
)
# Relations that fit any types, those that contacts speak for and against, scores and bounds of the gate.
GENERIC_RELATIONS = ("RELATED_TO", "MENTIONS", "DISCUSSED_WITH")
GENERIC_SCORE, CONCEPT_SCORE, UNLISTED_SCORE = 0.65, 0.60, 0.55
CONTACT_BOOSTED = ("CONTACT_OF", "WORKS_AT", "LOCATED_IN", "MEMBER_OF", "CLASSMATE_OF", "ALUMNI_OF", "STUDIED_AT")
CONTACT_LOWERED = ("CHILD_OF", "PARENT_OF", "REPORTS_TO", "MENTORED_BY", "MENTORS", "MANAGES")
CONTACT_BOOST, CONTACT_LOWER = 1.30, 0.55
GATE_ALLOW, GATE_QUARANTINE, GATE_CONFIDENT = 0.45, 0.25, 0.85

# Relations that the speaker must head, and words that mean the speaker.
ANCHORED_RELATIONS = ("WORKS_AT", "EMPLOYED_BY", "WORKS_FOR", "MANAGES", "REPORTS_TO")
PRONOUNS = ("i", "me", "my", "myself", "we", "our", "us")

# Entity labels of a second mention source.
SECOND_LABELS = {"PERSON": "Person", "ORG": "Organization", "GPE": "Place", "LOC": "Place", "FAC": "Place", "EVENT": "Event", "PRODUCT": "Technology", "WORK_OF_ART": "Concept"}
SECOND_SCORE = 0.35

# Phrasings of relations, fallbacks and type constraints in coarse types.
SYNONYMS = {
    "works at": ("works at", "employed by", "works for", "affiliated with"),
    "works on": ("works on", "is working on", "contributes to", "developing"),
    "founded": ("founded", "founder of", "co-founded", "established"),
    "knows": ("knows", "is acquainted with", "is friends with", "connected to"),
    "classmate of": ("classmate of", "studied with", "went to school with", "cohort of"),
    "collaborates with": ("collaborates with", "works together with", "partners with", "co-works with"),
    "contact of": ("contact of", "is in contact with", "associated with", "connected to"),
    "discussed with": ("discussed with", "talked about with", "conversed with", "spoke with about"),
    "interested in": ("interested in", "focused on", "enthusiastic about", "passionate about"),
    "lives in": ("lives in", "resides in", "based in", "located at"),
    "located in": ("located in", "based in", "headquartered in", "situated in"),
    "studied at": ("studied at", "attended", "enrolled at", "went to school at"),
    "alumni of": ("alumni of", "graduated from", "alumnus of", "alum of"),
    "attends": ("attends", "goes to", "enrolled in", "is attending"),
    "parent of": ("parent of", "father of", "mother of", "guardian of"),
    "child of": ("child of", "son of", "daughter of", "born to"),
    "manages": ("manages", "leads", "oversees", "is responsible for"),
    "reports to": ("reports to", "answers to", "works under", "is managed by"),
    "mentors": ("mentors", "coaches", "guides", "advises"),
    "mentored by": ("mentored by", "coached by", "guided by", "advised by"),
    "uses": ("uses", "utilizes", "relies on", "works with"),
    "depends on": ("depends on", "requires", "is dependent on", "needs"),
    "created": ("created", "built", "developed", "authored"),
    "related to": ("related to", "associated with", "linked to", "connected to"),
    "member of": ("member of", "belongs to", "part of", "affiliated with"),
    "customer of": ("customer of", "client of", "subscriber of", "account at"),
    "received from": ("received from", "got from", "delivered by", "sent by"),
    "owns": ("owns", "is owner of", "possesses", "holds"),
    "assigned to": ("assigned to", "allocated to", "given to", "working on"),
    "blocked by": ("blocked by", "waiting on", "dependent on", "held up by"),
    "delivers": ("delivers", "ships", "produces", "outputs"),
    "reports": ("reports", "files", "submits", "raises"),
    "affects": ("affects", "impacts", "touches", "influences"),
    "requested by": ("requested by", "asked for by", "initiated by", "raised by"),
    "resolved by": ("resolved by", "fixed by", "closed by", "handled by"),
}
FALLBACKS = {
    "lives in": ("located in",), "located in": ("lives in",), "mentored by": ("mentors",), "mentors": ("mentored by",),
    "knows": ("contact of", "collaborates with"), "contact of": ("knows",), "collaborates with": ("knows",),
    "related to": ("associated with",), "member of": ("related to",),
}
TYPE_CONSTRAINTS = {
    "works at": (("person",), ("organization",)), "founded": (("person",), ("organization",)),
    "lives in": (("person", "organization"), ("location",)), "parent of": (("person",), ("person",)),
    "child of": (("person",), ("person",)), "located in": (("organization",), ("location",)),
}
COARSE_TYPES = {"person": "person", "organization": "organization", "org": "organization", "company": "organization", "institution": "organization", "location": "location", "place": "location", "gpe": "location", "loc": "location"}

# Words of a question that point at a relation type, and the weights of re-ranking.
INTENT = {
    "WORKS_ON": ("work", "working", "develop", "build", "building"), "WORKS_AT": ("work", "employed", "job", "company", "at"),
    "KNOWS": ("know", "friend", "colleague", "contact"), "USES": ("use", "using", "uses", "tool", "with"),
    "LOCATED_IN": ("located", "lives", "in", "city", "country"), "DISCUSSED_WITH": ("discuss", "talked", "meeting", "with"),
    "INTERESTED_IN": ("interest", "interested", "likes", "hobby"), "CREATED": ("create", "created", "made", "built", "founded"),
    "MANAGES": ("manage", "manages", "lead", "leads"), "DEPENDS_ON": ("depend", "depends", "require", "requires"),
    "RELATED_TO": ("related", "about"), "MENTIONS": ("mention", "about"), "ATTENDS": ("attend", "attends", "going to"),
    "COLLABORATES_WITH": ("collaborate", "partner", "together"), "MENTORED_BY": ("mentor", "mentored", "teaches"),
    "REPORTS_TO": ("report", "reports to", "under"), "ALUMNI_OF": ("alumni", "graduated", "went to"),
    "STUDIED_AT": ("study", "studied", "school", "university"),
}
NEIGHBOR_WEIGHT, STRENGTH_WEIGHT, PATH_WEIGHT = 0.1, 0.2, 0.15
NAME_BOOST, INTENT_BOOST, INTENT_CAP = 1.5, 0.05, 0.10

# Signs of a decision in a text, strong (2 points) and weak (1), and of promotion.
DECISION_STRONG = (
    r"\b(?:i|we)\s+(?:decided|decide|chose|choose|opted|opt)\b",
    r"\blet['’]?s\s+(?:go with|do it|ship it|proceed|move forward)\b",
    r"\b(?:approved|green[- ]?lit|signed off)\b",
    r"\b(?:final decision|decision made|we are going with)\b",
    r"\b(?:instead of|rather than|vs\.?)\b",
)
DECISION_WEAK = (
    r"\b(?:should use|should do|will use|we'll use)\b",
    r"\b(?:plan is|moving to|switching to|migrating to)\b",
    r"\b(?:approved by|agreed to|settled on)\b",
    r"\bdecision\b",
)
PROMOTION = ("unsubscribe", "limited time", "buy now", "promo code", "% off", "sponsored", "deal alert", "click here", "free shipping")
DECISION_MIN_CHARS, DECISION_MIN_SCORE = 24, 2

# Names that are concepts, no people or organizations, in labelled relations.
CONCEPTS = (
    "ultrasound", "dissections", "lottery system", "military track", "data science", "consulting", "fintech", "healthcare",
    "robotics", "pitchbook", "managing consultant", "project manager", "chief of staff", "program manager",
    "head of business management", "data", "science", "management", "engineering", "technology",
)

# Gates of vocabulary adoption.
ADOPT_MIN_DAYS, ADOPT_MIN_TOTAL, ADOPT_MIN_FREQUENCY = 3, 5, 0.4
ADOPT_RELATIONS, ADOPT_ENTITIES, ADOPT_TOTAL = 3, 2, 20

# Thresholds of index and queue health.
HEALTH = {"complete_optimize": 0.995, "complete_reindex": 0.97, "drift_reindex": 0.15, "drift_rebuild": 0.35, "errors_reindex": 0.15, "errors_rebuild": 0.40, "avg_optimize": 250, "p95_reindex": 600, "backlog": 500}

# What begins a message in a thread, from the plainest sign to the loosest.
BOUNDARIES = (
    r"(?i)(?:^|\n)\s*-\s*Message\s+\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"(?i)(?:^|\n)\s*Statement\s+(?:by|from)\s+\S",
    r"(?i)(?:^|\n)\s*From\s*:",
    r"(?is)(?:^|\n)\s*On\s+.{0,60}wrote\s*:",
    r"(?:^|\n)\s*\S{2,}[^:\n]{0,60}:\s+\S",
)
