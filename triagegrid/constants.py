"""Fixed values of the scoring formulas, features and gates."""

# Weights of the two scoring formulas.
MODEL_WEIGHT, EPSS_WEIGHT, KEV_WEIGHT = 0.5, 0.3, 0.2
IMPACT_WEIGHT, FANIN_WEIGHT = 0.5, 0.5
IMPACT_MAX = 6.0
SCOPE_CHANGED = 1.15
TIER_MULTIPLIER = {1: 1.5, 2: 1.25, 3: 1.0}
INTERNET_FACING, HANDLES_PII = 1.2, 1.0
DEFAULT_TIER = 2
OLD_EPSS_WEIGHT, OLD_MATURITY_WEIGHT = 0.65, 0.35
MATURITY = {"none": 0.05, "poc": 0.5, "weaponized": 0.9, "kev": 1.0}
OLD_IMPACT_WEIGHT, OLD_BLAST_WEIGHT = 0.5, 0.5
CRITICALITY_WEIGHT = {"Critical": 1.0, "High": 0.7, "Medium": 0.4, "Low": 0.2}
CRITICALITY_TIER = {"Critical": 1, "High": 2, "Medium": 3, "Low": 3}
TIER_CRITICALITY = {1: "Critical", 2: "High", 3: "Medium"}
BUSINESS_DIVISOR, FANIN_DIVISOR, BUSINESS_SHARE = 3.0, 5.0, 0.75
TRUST_BOUNDARY = 1.08
CEILING_START = 90.0
RISK_TIERS = (("Critical", 75.0), ("High", 50.0), ("Medium", 25.0))
ABLATIONS = ("model", "epss", "kev", "fanin", "scope", "asset")
CONTEXT_ABLATIONS = ("fanin", "asset")

# CVSS v3 base metrics, their values and the impact weights.
CVSS_METRICS = {
    "AV": ("N", "A", "L", "P"),
    "AC": ("L", "H"),
    "PR": ("N", "L", "H"),
    "UI": ("N", "R"),
    "S": ("U", "C"),
    "C": ("H", "L", "N"),
    "I": ("H", "L", "N"),
    "A": ("H", "L", "N"),
}
CIA_WEIGHT = {"H": 0.56, "L": 0.22, "N": 0.0}

# Keyword patterns, reference domains, reference tags, and addresses that give the label away.
KEYWORDS = {
    "kw_rce": r"remote code execution|execute arbitrary (?:code|commands)|arbitrary code execution|code injection|command injection",
    "kw_unauth": r"unauthenticated|without authentication|without requiring authentication|pre-auth|no authentication",
    "kw_deser": r"deseriali[sz]",
    "kw_ssrf": r"server-side request forgery|\bssrf\b",
    "kw_auth_bypass": r"authentication bypass|bypass(?:es|ing)? (?:the )?authentication|auth bypass",
}
DOMAINS = {
    "dom_exploitdb": ("exploit-db.com",),
    "dom_github": ("github.com", "gist.github.com"),
    "dom_packetstorm": ("packetstormsecurity.com", "packetstormsecurity.org", "packetstorm.news"),
    "dom_zdi": ("zerodayinitiative.com",),
}
REFERENCE_TAGS = {"ref_exploit": "Exploit", "ref_patch": "Patch", "ref_vendor_advisory": "Vendor Advisory"}
LEAKY_ADDRESSES = ("cisa.gov/known-exploited-vulnerabilities", "cisa.gov/kev")

# Names of identifiers, and the years, folds and gate of the training run.
CVE_PATTERN = r"CVE-\d{4}-\d{4,}"

POC_WINDOW_DAYS = 30
TRAIN_YEARS, VALIDATION_YEAR, TEST_YEAR = (2019, 2023), 2024, 2025
TOP_CWES = 30
SMOOTHING = 20.0
FOLDS = 5
MIN_TEST_AUC = 0.80

# What features are called in a response; a weakness is called by its number.
FEATURE_LABELS = {
    "cvss_base": "CVSS base score",
    "cvss_missing": "No CVSS v3 vector",
    "av_N": "Network attack vector",
    "av_A": "Adjacent attack vector",
    "av_L": "Local attack vector",
    "av_P": "Physical attack vector",
    "ac_L": "Low attack complexity",
    "ac_H": "High attack complexity",
    "pr_N": "No privileges required",
    "pr_L": "Low privileges required",
    "pr_H": "High privileges required",
    "ui_N": "No user interaction",
    "ui_R": "User interaction required",
    "s_U": "Scope unchanged",
    "s_C": "Scope changed",
    "c_H": "High confidentiality impact",
    "c_L": "Low confidentiality impact",
    "c_N": "No confidentiality impact",
    "i_H": "High integrity impact",
    "i_L": "Low integrity impact",
    "i_N": "No integrity impact",
    "a_H": "High availability impact",
    "a_L": "Low availability impact",
    "a_N": "No availability impact",
    "vendor_kev_rate": "Vendor's historical KEV rate",
    "product_kev_rate": "Product's historical KEV rate",
    "ref_total": "Number of references",
    "ref_exploit": "References tagged Exploit",
    "ref_patch": "References tagged Patch",
    "ref_vendor_advisory": "Vendor advisories",
    "dom_exploitdb": "Exploit-DB reference",
    "dom_github": "GitHub reference",
    "dom_packetstorm": "Packet Storm reference",
    "dom_zdi": "ZDI reference",
    "poc_github": "Public PoC on GitHub (<=30d)",
    "poc_exploitdb": "Exploit-DB entry (<=30d)",
    "desc_len": "Description length",
    "kw_rce": "Mentions code execution",
    "kw_unauth": "Mentions unauthenticated",
    "kw_deser": "Mentions deserialization",
    "kw_ssrf": "Mentions SSRF",
    "kw_auth_bypass": "Mentions authentication bypass",
    "epss": "EPSS score",
    "days_since_publish": "Days since publication",
    "published_year": "Publication year",
    "cwe_other": "Other CWE",
}
