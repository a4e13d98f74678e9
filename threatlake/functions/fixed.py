"""Unicode ranges, names, look-alike characters and code patterns.

These equal the values of the behaviour that is reproduced; they are data only.
"""

# Inclusive ranges of invisible characters: (name, first, last, critical).
INVISIBLE_RANGES = [
    ("Variation Selectors", 0xFE00, 0xFE0F, True),
    ("Variation Selectors Supplement", 0xE0100, 0xE01EF, True),
    ("Zero-Width Characters", 0x200B, 0x200F, True),
    ("Invisible Operators", 0x2060, 0x206F, False),
    ("Bidirectional Formatting", 0x202A, 0x202E, True),
    ("Isolation Characters", 0x2066, 0x2069, False),
    ("Unicode Tags", 0xE0000, 0xE007F, False),
    ("Specials", 0xFFF0, 0xFFFF, False),
]

BIDI_NAMES = {
    0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO", 0x202E: "RLO", 0x2066: "LRI",
    0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI", 0x200E: "LRM", 0x200F: "RLM", 0x061C: "ALM",
}
BIDI_SEVERITY = {"RLO": "critical", "RLE": "high", "LRO": "high", "LRM": "low", "RLM": "low", "ALM": "low"}
ZERO_WIDTH_NAMES = {0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x2060: "WJ", 0xFEFF: "BOM"}
EMOJI_RANGES = [(0x1F300, 0x1F9FF), (0x2600, 0x26FF), (0x2700, 0x27BF)]

# Look-alike characters: (code point, base, script, similarity).
CONFUSABLES = [
    (0x0430, "a", "Cyrillic", 1.0), (0x0435, "e", "Cyrillic", 1.0), (0x043E, "o", "Cyrillic", 1.0), (0x0440, "p", "Cyrillic", 1.0),
    (0x0441, "c", "Cyrillic", 1.0), (0x0445, "x", "Cyrillic", 1.0), (0x0443, "y", "Cyrillic", 1.0), (0x0410, "A", "Cyrillic", 1.0),
    (0x0415, "E", "Cyrillic", 1.0), (0x041E, "O", "Cyrillic", 1.0), (0x0420, "P", "Cyrillic", 1.0), (0x0421, "C", "Cyrillic", 1.0),
    (0x0425, "X", "Cyrillic", 1.0), (0x0423, "Y", "Cyrillic", 1.0), (0x03B1, "a", "Greek", 0.95), (0x03BF, "o", "Greek", 1.0),
    (0x03B9, "i", "Greek", 0.9), (0x0391, "A", "Greek", 1.0), (0x0392, "B", "Greek", 1.0), (0x0395, "E", "Greek", 1.0),
    (0x0396, "Z", "Greek", 1.0), (0x0397, "H", "Greek", 1.0), (0x0399, "I", "Greek", 1.0), (0x039A, "K", "Greek", 1.0),
    (0x039C, "M", "Greek", 1.0), (0x039D, "N", "Greek", 1.0), (0x039F, "O", "Greek", 1.0), (0x03A1, "P", "Greek", 1.0),
    (0x03A4, "T", "Greek", 1.0), (0x03A7, "X", "Greek", 1.0), (0x03A5, "Y", "Greek", 0.95),
]

CATEGORIES = [
    "invisible_character", "homoglyph", "bidirectional_override", "unicode_tag", "normalization_attack", "glassware_pattern", "emoji_obfuscation", "stegano_payload",
    "decoder_function", "pipe_delimiter_stego", "encrypted_payload", "header_c2", "hardcoded_key_decryption", "rc4_pattern", "unknown",
]
RULE_IDS = {
    "stegano_payload": "GW001", "decoder_function": "GW002", "invisible_character": "GW003", "bidirectional_override": "GW004",
    "encrypted_payload": "GW005", "hardcoded_key_decryption": "GW006", "rc4_pattern": "GW007", "header_c2": "GW008",
}

# Severity ranks: the declared order, and the order of the command line and of reports.
DECLARED_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3, "info": 4}
SEVERITY_RANK = {"info": 0, "low": 0, "medium": 1, "high": 2, "critical": 3}

# Code patterns by family, in order; the syntax is common to Java and RE2.
DECODER_PATTERNS = [
    r"codePointAt\s*\(\s*0\s*\)",
    r"codePointAt\s*\([^)]*0x[Ff][Ee]00",
    r"codePointAt\s*\([^)]*0x[Ee]0100",
    r"String\.fromCharCode\s*\(",
    r"String\.fromCodePoint\s*\(",
    r"\.filter\s*\(\s*c\s*=>\s*c\s*!==\s*null\s*\)",
]
EVAL_PATTERNS = [r"\beval\s*\(", r"\bFunction\s*\(", r"new\s+Function\s*\("]
ENCODING_PATTERNS = [r"Buffer\.from\s*\([^,]+,\s*hex\s*\)", r"Buffer\.from\s*\([^,]+,\s*base64\s*\)", r"\batob\s*\(", r"\bbtoa\s*\("]
SELECTOR_CONSTANTS = [r"0x[Ff][Ee]00", r"0x[Ee]0100", r"\\u\{[Ff][Ee]0[0-9A-Fa-f]\}", r"\\u\{[Ee]01[0-9A-Fa-f]{2}\}"]
HEX_RUN, BASE64_RUN = r"[0-9a-fA-F]{64,}", r"[A-Za-z0-9+/=]{64,}"
QUOTED_LITERAL, TEMPLATE_LITERAL = "\"([^\"]{64,})\"|'([^']{64,})'", "`([^`]{64,})`"
EXEC_PATTERNS = [r"\beval\s*\(", r"\bnew\s+Function\s*\(", r"\bvm\.runIn(NewContext|ThisContext)\s*\(", r"\b(exec|execSync)\s*\(", r"\bchild_process\s*\+"]
C2_EXEC_PATTERNS = [*EXEC_PATTERNS, r"\bspawn\s*\("]
CLIENT_PATTERNS = [r"\bhttp\.get\s*\(", r"\bhttps\.get\s*\(", r"\bfetch\s*\(", r"\baxios\.", r"\brequest\s*\("]
HEADER_PATTERNS = [r"\bheaders\s*\[", r"\bheaders\.get\s*\(", r"\bgetHeader\s*\(", r"\bresponse\.headers", r"\bres\.headers"]
DECRYPT_PATTERNS = [
    r"\bcreateDecipheriv\s*\(", r"\bcreateDecipher\s*\(", r"\bcrypto\.subtle\.decrypt\s*\(", r"\bdecipher\.update\s*\(", r"\bdecipher\.final\s*\(", r"\b\.decrypt\s*\(",
]
RC4_PATTERNS = {
    "INIT_256": r"(?:new\s+Array\s*\(\s*256\s*\)|\b(?:i|j|k|n)\s*<\s*256\b)",
    "XOR_OP": r"\^",
    "MOD_256": r"(?:%\s*256\b|&\s*0x[fF]{2}\b|&\s*255\b)",
    "SWAP": r"(?:tmp|temp|t)\s*=\s*\w+\[\w+\];\s*\w+\[\w+\]\s*=\s*\w+\[\w+\];\s*\w+\[\w+\]\s*=\s*(?:tmp|temp|t)",
    "CHARCODE": r"charCodeAt|fromCharCode",
}
RC4_CONFIDENCE = {3: 0.5, 4: 0.7, 5: 0.85}
# Confidence of a file's loader indicators by their number: (from, to, confidence).
INDICATOR_CONFIDENCE = [(2, 2, 0.45), (3, 3, 0.65), (4, 5, 0.9), (6, None, 0.95)]

# Names of calls that decrypt or hash, of the module that execs, and of the last names of calls that run code in a context.
CRYPTO_CALLS = ["createDecipheriv", "createDecipher", "createHash", "createHmac", "decrypt"]
EXEC_MODULE, EXEC_CALLS = "child_process", ["exec", "execSync"]
CONTEXT_CALLS = ["runInNewContext", "runInContext"]
KEY_ARGUMENT = {"createDecipheriv": 1, "createDecipher": 0}

ENTROPY_LIMIT, LITERAL_BYTES, RUN_LENGTH, PIPE_RUN = 4.5, 64, 16, 4
DEFAULT_EXTENSIONS = "js mjs cjs ts tsx jsx py rs go java rb php sh bash zsh yml yaml toml json xml md txt".split()
DEFAULT_EXCLUDES = [".git", "node_modules", "target", "__pycache__", ".venv", "vendor"]
