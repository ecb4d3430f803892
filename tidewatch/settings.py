"""Default thresholds and the fixed values that results depend on."""

from __future__ import annotations

# --- thresholds (parameters of the operators, these are their defaults) ---
WINDOW_SIZE = 5
K_SIGMA = 3.0
PLATT_SLOPE = 2.0
EMA_RATE = 0.05
DRIFT_BOOST = 5.0
DRIFT_BOOST_CAP = 0.5
CUSUM_H = 5.0
CUSUM_C1 = 0.5
CUSUM_C2 = 5.0
CUSUM_WINDOW = 1000
TZ_SHIFT_MULTIPLIER = 2.0
COOLDOWN_SECONDS = 120
RATE_LIMIT_PER_SECOND = 100
RETENTION_DAYS = 30
IDLE_SECONDS = 600
REFIT_INTERVAL = 5000
RIDGE = 1e-6
FL_MIN_UPDATES = 2
FL_MAX_DIM = 4096
FL_MAX_NORM = 5.0
PHISHING_AT = 0.7
SUSPICIOUS_AT = 0.4
ENSEMBLE_DEFAULTS = {
    "w_tabular": 0.70,
    "w_text": 0.30,
    "t_tabular": 0.34,
    "t_text": 0.50,
    "t_ensemble": 0.42,
}

# Layout of the 72-dimension behaviour vector.
FEATURE_DIM = 72
TEMPORAL = (0, 24)
SEQUENTIAL = (24, 52)
INTERACTION = (52, 72)
TOP_APPS = 10

# --- fixed values: must be exactly these for results to agree ---

BRANDS = {
    "google": ["googl", "go0gle", "g00gle", "gogle", "gooogle", "googie"],
    "facebook": ["faceb00k", "facebok", "faceboook", "facebk", "faceb0ok"],
    "amazon": ["amaz0n", "amazn", "amaazon", "amazom", "arnazon"],
    "paypal": ["paypa1", "paypaI", "payp4l", "paypall", "paypl", "paipal"],
    "microsoft": ["micros0ft", "microsft", "microsofl", "rnicrosoft"],
    "apple": ["app1e", "appie", "appl3", "applle"],
    "netflix": ["netf1ix", "netfllx", "netfl1x", "neftlix"],
    "instagram": ["instagr4m", "lnstagram", "instgram", "1nstagram"],
    "whatsapp": ["whatsap", "wh4tsapp", "whatssapp", "whatsaap"],
    "linkedin": ["1inkedin", "linkedln", "linkdin", "linkediin"],
    "twitter": ["twltter", "tw1tter", "twiter", "twtter"],
    "chase": ["chas3", "chasse"],
    "wellsfargo": ["we11sfargo", "wellsfarg0", "welsfargo"],
    "bankofamerica": ["bankofamer1ca", "bankofarnerica"],
}

OFFICIAL_DOMAINS = {
    "google": ["google.com", "google.co.in", "google.co.uk", "googleapis.com", "gstatic.com", "youtube.com"],
    "facebook": ["facebook.com", "fb.com", "fbcdn.net", "instagram.com"],
    "amazon": ["amazon.com", "amazon.in", "amazon.co.uk", "amazonaws.com", "aws.amazon.com"],
    "paypal": ["paypal.com", "paypal.me"],
    "microsoft": ["microsoft.com", "live.com", "outlook.com", "office.com", "azure.com", "windows.com"],
    "apple": ["apple.com", "icloud.com", "itunes.com"],
    "netflix": ["netflix.com"],
    "instagram": ["instagram.com"],
    "whatsapp": ["whatsapp.com", "whatsapp.net"],
    "linkedin": ["linkedin.com"],
    "twitter": ["twitter.com", "x.com", "t.co"],
    "chase": ["chase.com"],
    "wellsfargo": ["wellsfargo.com"],
    "bankofamerica": ["bankofamerica.com"],
}

SUSPICIOUS_KEYWORDS = [
    "login", "signin", "sign-in", "log-in", "verify", "verification",
    "secure", "security", "account", "update", "confirm", "banking",
    "wallet", "password", "credential", "authenticate", "validate",
    "suspend", "locked", "unlock", "recover", "restore", "reset",
    "urgent", "alert", "warning", "payment", "billing", "invoice",
    "refund", "prize", "winner", "reward", "gift", "free", "lottery",
    "helpdesk", "support", "service", "customer",
]

SUSPICIOUS_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".gq",
    ".buzz", ".top", ".xyz", ".club", ".icu",
    ".cam", ".rest", ".monster", ".sbs",
    ".cyou", ".cfd", ".best", ".bond",
]

PHISHING_PATTERNS = [
    r"(?:paypal|google|amazon|apple|microsoft|facebook|netflix|instagram)"
    r"[\-\.](?:login|signin|verify|secure|update|account|support)",
    r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    r"^[a-z0-9\-]+\.[a-z0-9\-]+\.[a-z0-9\-]+\.[a-z0-9\-]+\.[a-z0-9\-]+\.",
]

URL_PATH_KEYWORDS = [
    "login", "signin", "verify", "secure", "account",
    "update", "confirm", "banking", "password",
]

DOMAIN_PATTERN = r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$"
IPV4_PATTERN = r"^\d{1,3}(\.\d{1,3}){3}$"

LOG_PATTERN = r"(?s)^(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(\d+)\s+([VDIWEAF])\s+([^:]+):\s?(.*)$"
TRAINING_LOG_PATTERN = r"(?s)^(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(\d+)\s+([VDIWEF])\s+([^:]+):\s*(.*)$"
LOG_NOISE = ["avc: denied", "auditd", "bpf", "thermal"]
LOG_LEVELS = {
    "V": ("Verbose", "low"),
    "D": ("Debug", "low"),
    "I": ("Info", "medium"),
    "W": ("Warn", "medium"),
    "E": ("Error", "high"),
    "F": ("Fatal", "critical"),
    "A": ("Assert", "critical"),
}

SYSTEM_PACKAGE_PREFIXES = [
    "com.android.", "com.google.android.", "com.samsung.", "com.sec.",
    "com.qualcomm.", "com.mediatek.", "android",
]
STORE_INSTALLERS = ["com.android.vending", "com.google.android.packageinstaller"]

DNS_BLOCKLIST = ["paypal-secure-login.tk", "login-update-account.com", "free-prize-winner.buzz"]

RESPONSE_ACTIONS = {
    "medium": ["notify"],
    "high": ["notify", "kill_process", "block_network"],
    "critical": ["notify", "kill_process", "block_network", "quarantine_app", "uninstall_app", "lock_device"],
}

TEXT_SAMPLE_KEYS = [
    "permission", "domain", "url", "host", "action", "uid", "rxBytesDelta", "txBytesDelta",
    "dstPort", "dstHost", "riskScore", "category", "isSideLoaded",
]

CONNECTION_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment",
    "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted",
    "num_root", "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
CONNECTION_CATEGORICAL = ["protocol_type", "service", "flag"]
