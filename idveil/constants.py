"""Fixed values of the identifier formats: published tables, word lists and patterns."""

from __future__ import annotations

# --- character classes -----------------------------------------------------
# White space as Unicode defines it (Java's \s alone is ASCII only).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

# --- text normalisation (fixed values) ---------------------------------------
INDIC_DIGITS = (
    "०१२३४५६७८९"  # Devanagari
    "০১২৩৪৫৬৭৮৯"  # Bengali
    "૦૧૨૩૪૫૬૭૮૯"  # Gujarati
    "௦௧௨௩௪௫௬௭௮௯"  # Tamil
    "౦౧౨౩౪౫౬౭౮౯"  # Telugu
)
ZERO_WIDTH = r"[\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad]"
UNUSUAL_SPACES = r"[\u00a0\u2000-\u200a\u202f\u205f\u3000]"
CURLY_QUOTES = "\u2018\u2019\u201c\u201d"
STRAIGHT_QUOTES = "''\"\""
MIN_PART_CHARS = 5

# --- Verhoeff (published 1969): the permutation the position tables iterate ----
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)

# --- PAN holder types (fixed values) -----------------------------------------
PAN_HOLDERS = {
    "P": "Individual",
    "C": "Company",
    "H": "HUF",
    "F": "Firm/LLP",
    "A": "AOP",
    "T": "Trust",
    "B": "BOI",
    "L": "Local Authority",
    "J": "Artificial Juridical Person",
    "G": "Government",
    "K": "Krish (HUF rep.)",
}
PAN_NEVER_HOLDERS = ("Z", "Q")

# --- GSTIN (fixed values) ------------------------------------------------------
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN_STATES = tuple(f"{n:02d}" for n in range(1, 39))

# --- IFSC bank codes (fixed values) --------------------------------------------
BANK_CODES = (
    "SBIN", "KKBK", "HDFC", "ICIC", "UTIB", "PUNB", "ANDB", "CNRB",
    "BARB", "BKID", "CBIN", "CORP", "DENA", "IOBA", "MAHB", "ORBC",
    "PSIB", "SCBL", "SYND", "UBIN", "UCBA", "VIJB", "YESB", "IDIB",
    "IDFC", "RATN", "FDRL", "KVBL", "TMBL", "DCBL", "BDBL", "NKGSB",
    "APGB", "RNSB", "COSB",
)

# --- column headers per entity, in order of precedence (fixed values) ------------
HEADER_PATTERNS = {
    "AADHAAR": (
        r"\b(?:aadhaar|aadhar|adhar|aadhr|uid)\b",
        r"\b(?:unique\s*id(?:entification)?)\b",
        r"(?:आधार|ইউআইডি|ஆதார்|ఆధార్)",
    ),
    "PAN": (
        r"\bpan\b",
        r"\b(?:permanent\s*account\s*(?:no|num|number)?)\b",
        r"\bincome\s*tax\s*(?:no|num|number|id)?\b",
        r"(?:पैन|প্যান|பான்)",
    ),
    "GSTIN": (
        r"\b(?:gstin?|gst\s*(?:no|num|number|id)?)\b",
        r"\b(?:goods\s*(?:and|&)\s*services?\s*tax)\b",
        r"(?:जीएसटी)",
    ),
    "IN_MOBILE": (
        r"\b(?:mobile|mob|phone|ph|tel|cell|contact)\s*(?:no|num|number)?\b",
        r"\b(?:whatsapp|wa)\s*(?:no|num|number)?\b",
        r"(?:मोबाइल|फोन|संपर्क|মোবাইল|ப\u0bc7\u0bbeன்)",
    ),
    "VOTER_ID": (
        r"\b(?:voter\s*id|epic|voter\s*no|elector\s*photo)\b",
        r"(?:मतदाता|पहचान\s*पत्र)",
    ),
    "PASSPORT": (
        r"\b(?:passport\s*no|passport\s*num|passport\s*number|ppt\s*no)\b",
        r"(?:पासपोर्ट)",
    ),
    "BANK_ACCOUNT": (
        r"\b(?:account|acct|acc)\s*(?:no|num|number)?\b",
        r"(?:खाता)",
    ),
    "IFSC": (
        r"\b(?:ifsc|ifsc\s*code)\b",
        r"(?:आईएफएससी)",
    ),
}

# --- inline labels per entity, no word boundaries (fixed values) -----------------
# Only presence counts, so words that contain a listed one ("mobile", "account") are left out.
INLINE_LABELS = {
    "AADHAAR": r"aadhaar|aadhar|adhar|uid|unique\s*id|आधार|ஆதார்|ইউআইডি",
    "PAN": r"pan|permanent\s*account|पैन|பான்|প্যান",
    "GSTIN": r"gst|जीएसटी",
    "IN_MOBILE": r"mob|phone|ph|tel|contact|cell|whatsapp|wa|मोबाइल|फोन|संपर्क|ப\u0bc7\u0bbeன்",
    "BANK_ACCOUNT": r"acc|खाता",
    "IFSC": r"ifsc|आईएफएससी",
}

# --- penalty and row-density words (fixed values) --------------------------------
PENALTY_WORDS = (
    r"sl\s*no|invoice|ref\s*no|order\s*no|txn|serial|seq|qty|item|transaction"
)
NEIGHBOUR_WORDS = (
    "name|address|street|road|nagar|marg|flat|sector|pincode|pin|district|state|"
    "city|email|customer|patient|employee|holder|नाम|पता|शहर|पिनकोड"
)

# --- file suffixes (fixed values) ------------------------------------------------
TEXT_SUFFIXES = ("txt", "md", "log", "rst", "markdown")
