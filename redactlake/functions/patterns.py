"""Patterns of personal data and secrets.

Sources are written with ``\\b``; java() turns it into an ASCII word boundary, since
the JVM's own is Unicode-aware. White space in patterns is ASCII.
"""

from __future__ import annotations

# Pattern shapes and labels that results are compared on.
EMAIL = "|".join([
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",
    r"\b[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)+@[A-Za-z0-9-]+\b",
    r"\b[A-Za-z0-9._%+-]{2,}@(?:gmail|googlemail|yahoo|outlook|hotmail|live|icloud|proton|protonmail|rediffmail|zoho|aol|gmx|mail)\b",
])
PHONE = r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
HONORIFIC_NAME = r"\b(?:Mr\.|Mrs\.|Ms\.|Miss|Dr\.|Prof\.|Shri|Smt\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"
CUE_NAME = r"\b(?i:Name|Patient|Customer|Employee|Cardholder|Account\s+Holder|From|To|Sender|Recipient|Author|User|Contact)\s*:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"
API_KEYS = [
    (r"\bsk-or-v1-[A-Za-z0-9]{16,}\b", "OpenRouter API key"),
    (r"\bnvapi-[A-Za-z0-9_\-]{16,}\b", "NVIDIA API key"),
    (r"\bgsk_[A-Za-z0-9]{16,}\b", "Groq API key"),
    (r"\bAIza[0-9A-Za-z_\-]{20,}\b", "Google API key"),
    (r"\bsk-ant-[A-Za-z0-9_\-]{20,}\b", "Anthropic API key"),
    (r"\bsk-proj-[A-Za-z0-9_\-]{16,}\b", "OpenAI project key"),
    (r"\bsk-[A-Za-z0-9]{20,}\b", "OpenAI API key"),
    (r"\bsk_[A-Za-z0-9]{20,}\b", "API key"),
    (r"\bgh[ops]_[A-Za-z0-9]{36}\b", "GitHub token"),
    (r"\bxox[baprs]-[A-Za-z0-9\-]+\b", "Slack token"),
    (r"\bxai-[A-Za-z0-9]{16,}\b", "xAI API key"),
    (r"\bAKIA[0-9A-Z]{16}\b", "AWS access key"),
    (r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b", "JWT token"),
]
ID_SHAPES = [
    (r"\b\d{4}[ -]\d{4}[ -]\d{4}\b", "Aadhaar number", "aadhaar"),
    (r"\b[A-Z]{5}\d{4}[A-Z]\b", "PAN card", None),
    (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "IFSC code", None),
    (r"\b\d{3}-\d{2}-\d{4}\b", "SSN", None),
    (r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", "Card number", "card"),
    (r"\b[A-Z]{2}\d{6,8}\b", "Passport number", None),
]
OTP_CUE = r"(?i)\b(?:otp|one[-\s]?time(?:\s+(?:code|password|passcode))?|verification\s+code|security\s+code)\b\s*(?:is|:|=)?\s*(\d{4,8})\b"
LABELLED_SECRET = r"(?i)\b(?:password|passphrase|pwd|passcode|pin|(?:[\w-]+[_-])?api[\s_-]?key|(?:[\w-]+[_-])?apikey|key|secret|access[\s_-]?token|token)\b\s*(?:is|:|=)\s*([^\s,;]+)"
BARE_SECRET = r"(?i)\b(?:password|passphrase|pwd|passcode)\b\s+([^\s,;]+)"
CUED = [(OTP_CUE, "OTP code"), (LABELLED_SECRET, "Secret value"), (BARE_SECRET, "Secret value")]
#: Re-reading of what was shipped: no checksums.
VERIFY = [
    (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "Aadhaar number"),
    (r"\b[A-Z]{5}\d{4}[A-Z]\b", "PAN card"),
    (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "IFSC code"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "SSN"),
    (r"\b[A-Z]{1,2}\d{6,8}\b", "Passport number"),
    (r"\b(?:\d{4}[\s-]?){3}\d{4}\b", "Card number"),
    (r"\b(sk-ant-[a-zA-Z0-9_-]{20,})\b", "Anthropic API key"),
    (r"\b(sk-[a-zA-Z0-9]{20,})\b", "OpenAI API key"),
    (r"\b(ghp_[a-zA-Z0-9]{36})\b", "GitHub token"),
    (r"\b(AKIA[0-9A-Z]{16})\b", "AWS key"),
    (r"\b(eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.)\b", "JWT token"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "Email address"),
    (r"\b(\+?91[\s-]?\d{5}[\s-]?\d{5})\b", "Indian phone"),
]
#: The looser value detector's own shapes.
DETAIL_IDS = [
    (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "Aadhaar number (Verhoeff ✓)", "aadhaar"),
    (r"\b[A-Z]{5}\d{4}[A-Z]\b", "PAN card number", None),
    (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "IFSC code", None),
    (r"\b\d{3}-\d{2}-\d{4}\b", "SSN", None),
    (r"\b[A-Z]{1,2}\d{6,8}\b", "Possible passport number", None),
]
DETAIL_CARD = r"\b(?:\d{4}[\s-]?){3}\d{4}\b"
#: Labels of credential fields, in the detector and (longer) in the typing gate.
DOM_CREDENTIALS = [
    (r"\bpassword\b", "Password field"), (r"\bpasscode\b", "Passcode field"), (r"\bcvv\b", "CVV field"), (r"\bcvc\b", "CVC field"),
    (r"\bcard\s*number\b", "Card number field"), (r"\bcredit\s*card\b", "Credit card field"), (r"\bdebit\s*card\b", "Debit card field"),
    (r"\bexpiry\b", "Expiry field"), (r"\botp\b", "OTP field"), (r"\bone[-\s]?time\s*(code|password)\b", "One-time code field"),
    (r"\bsecret\b", "Secret field"), (r"\bapi[-\s]?key\b", "API key field"),
]
GATE_CREDENTIALS = [
    *DOM_CREDENTIALS[:8],
    (r"\bssn\b", "SSN field"), (r"\bsocial\s*security\b", "Social security field"), (r"\baadhaar\b", "Aadhaar field"),
    (r"\bpan\s*(card|number)\b", "PAN card field"), (r"\bpassport\b", "Passport field"), (r"\bifsc\b", "IFSC field"),
    (r"\baccount\s*number\b", "Account number field"), (r"\bone[-\s]?time\s*(code|password)\b", "One-time code field"),
    (r"\botp\b", "OTP field"), (r"\bapi[-\s]?key\b", "API key field"), (r"\bsecret\b", "Secret field"),
    (r"\bprivate[-\s]?key\b", "Private key field"), (r"\bsigning[-\s]?key\b", "Signing key field"),
    (r"\bbank\s*account\b", "Bank account field"), (r"\brouting\s*number\b", "Routing number field"), (r"\bpin\b", "PIN field"),
]
TYPED_VALUES = [
    (r"^sk-ant-[a-zA-Z0-9_-]{20,}", "Anthropic API key"), (r"^sk-[a-zA-Z0-9]{20,}", "OpenAI API key"),
    (r"^ghp_[a-zA-Z0-9]{36}", "GitHub personal access token"), (r"^gho_[a-zA-Z0-9]{36}", "GitHub OAuth token"),
    (r"^ghs_[a-zA-Z0-9]{36}", "GitHub server-to-server token"), (r"^xox[baprs]-[a-zA-Z0-9-]+", "Slack token"),
    (r"^AKIA[0-9A-Z]{16}", "AWS access key"), (r"^eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.", "JWT token"),
    (r"^-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", "Private key"), (r"^\d{3}-\d{2}-\d{4}$", "SSN"),
]
IRREVERSIBLE = [
    r"\b(buy|purchase|place\s*order|checkout|pay|payment)\b", r"\b(send|reply|forward|post|publish|tweet|share)\b",
    r"\b(delete|remove|discard|erase|deactivate|close\s*account)\b", r"\b(confirm|submit|book\s*now|reserve|apply\s*now)\b",
    r"\b(transfer|withdraw|donate|subscribe|upgrade)\b", r"\b(sign\s*up|create\s*account|register)\b", r"\b(accept|agree)\b",
]
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions", r"\b(system\s*prompt|you\s+are\s+now)\b", r"\bas\s+an?\s+ai\s+(agent|assistant)[,:]",
    r"\bdisregard\s+(your|the)\s+(instructions|rules)\b", r"\bpretend\s+(you\s+are|to\s+be)\b", r"\bjailbreak\b",
    r"\bdo\s+anything\s+now\b", r"\bdeveloper\s+mode\b", r"\bunrestricted\s+mode\b",
]
FAILURES = [
    (r"browser error page|navigation failed|dns|err_name|err_connection|err_ssl|err_timedout", "page_load_error"),
    (r"did not respond|timed out|timeout", "timeout"),
    (r"no element \d+|not found on the current page|page changed|stale", "stale_element"),
    (r"declined", "declined"),
    (r"not a text field|not a <select>|not handled|unknown tool", "wrong_target"),
    (r"no option|not found", "not_found"),
]
TOKEN = r"<[A-Z]+_\d+>"
WIRE_TOKEN = r"<[A-Z][A-Z0-9]*_\d+>"

_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(source: str) -> str:
    """The source with an ASCII word boundary."""
    return source.replace(r"\b", _B)


def gate(source: str) -> str:
    """A cheap pattern that every text with a match of source meets: no boundaries, no lookaround."""
    if "@" in source:
        return "@"
    if source == OTP_CUE:
        return "[0-9]{4}"
    if source == LABELLED_SECRET:
        return r"(?i)(?:password|passphrase|pwd|passcode|pin|key|secret|token)\s*(?:is|:|=)"
    if source == BARE_SECRET:
        return "(?i)pass(?:word|phrase|code)|pwd"
    if source == CUE_NAME:
        return r":\s*[A-Z][a-z]"
    return source.replace(r"\b", "").replace(r"(?<!\d)", "").replace(r"(?!\d)", "")


# Model labels that name personal data, and the names they are shown by.
PII_LABEL = (
    "person|people|human|name|org|company|employer|location|city|address|street|country|state|province|zip|postal|email|mail|phone|tel|mobile|contact|account|credit|card|cvv|ssn|social|"
    "aadhaar|adhaar|uidai|pan|passport|driver|license|vehicle|voter|identity|dob|birth|username|user|password|secret|api|bank|routing|national|ip address|url|gender|age|occupation|profession|medical|health"
)
LABEL_NAMES = {
    "PER": "Person name", "PERSON": "Person name", "PERSON_NAME": "Person name", "NAME": "Person name", "ORG": "Organization", "ORGANIZATION": "Organization", "ORGANISATION": "Organization", "COMPANY": "Organization",
    "LOC": "Location", "LOCATION": "Location", "CITY": "Location", "ADDRESS": "Location", "EMAIL": "Email address", "EMAIL_ADDRESS": "Email address", "PHONE": "Phone number", "PHONE_NUMBER": "Phone number",
    "TELEPHONE": "Phone number", "MOBILE": "Phone number", "SSN": "SSN", "AADHAAR": "Aadhaar number", "PAN": "PAN card", "PASSPORT": "Passport number", "CREDIT_CARD": "Card number", "ACCOUNT_NUMBER": "Account number",
    "DOB": "Date of birth", "USERNAME": "Username", "PASSWORD": "Password", "IP_ADDRESS": "IP address",
}
#: Labels of fields by what they hold.
NAME_FIELDS = [
    (r"\b(name|full\s*name|your\s*name|first\s*name|last\s*name|sender|from|recipient|to)\b", "Name field", "person"),
    (r"\b(company|organization|business|firm|vendor|supplier|client|employer)\b", "Organization field", "organization"),
    (r"\b(card\s*holder|account\s*holder|beneficiary)\b", "Account holder field", "person"),
]
ADDRESS_FIELDS = [(r"\b(address|street|city|state|zip|postal|country|billing|shipping|location)\b", "Address field"), (r"\b(landmark|area|district|pin\s*code)\b", "Indian address field")]
PHONE_FIELD, EMAIL_FIELD = r"\b(phone|mobile|tel|contact|cell|fax)\b", r"\b(email|e-mail|mail)\b"
MONEY_FIELDS = [
    (r"\b(account|iban|routing|sort\s*code|bic|swift)\b", "Bank account field"), (r"\b(card|credit|debit|visa|mastercard|amex)\b", "Card field"),
    (r"\b(expiry|exp|valid\s*thru|cvc|cvv|cvv2)\b", "Card detail field"),
]
NAMED_IN_TEXT = r"(?iu)\b((?:from|to|sender|recipient|name|company): *|addressed to |sent by )([\p{L}][\p{L}\p{M}]+(?: +[\p{L}][\p{L}\p{M}]+){1,3})"
#: Glyphs that readers of images take for a digit or a letter.
AS_DIGIT = ("OoQDIli|!LZzEASsGbTYBgq", "00001111112234556677899")
AS_LETTER = ("0123456789|!", "OIZEASGTBGII")
TAX_HOLDERS = "[PCHFATBLJG]"
#: Digits that a cue names, without a checksum.
CUED_AADHAAR = r"(?i)\b(?:aadhaar|aadhar|uidai)\b[^\d\n]{0,20}?(\d[\d\s-]{10,16}\d)"
CUED_CARD = r"(?i)\b(?:credit\s+card|debit\s+card|card|card\s+number)\b[^\d\n]{0,20}?(\d[\d\s-]{11,24}\d)"
#: What comes before a person's name in a task, and words that begin none.
NAME_RUN = r"([\p{L}][\p{L}\p{M}'\x{2019}-]*(?:\s+[\p{L}][\p{L}\p{M}'\x{2019}-]*)+)"
NAME_CONTEXT = (
    r"(?iu)(?:\b(?:addressed\s+to|sent\s+by|recipient|sender)\s+"
    r"|\b(?:e-?mails?|mails?|send|sends|sent|sending|forward|forwards|forwarded|reply|replies|replying|message|messages|dm|dms|text|texts|whatsapp|invite|invites|invitation)\b[^\n.!?]{0,24}?\b(?:to|for)\s+"
    r"|\b(?:e-?mails?|message|messages|dm|text|texts|whatsapp|call|calls)\s+"
    r"|\b(?:name|company|business|firm|organization|vendor|supplier|client)\s*:\s*)" + NAME_RUN
)
NO_NAME = (
    "a", "an", "the", "this", "that", "these", "those", "my", "your", "our", "his", "her", "their", "its", "me", "us", "them", "him", "it", "i", "and", "or", "but", "so", "if", "then", "with", "without",
    "for", "from", "to", "of", "in", "on", "at", "by", "about", "into", "onto", "over", "please", "is", "are", "was", "were", "be", "do", "does", "did",
)
NARRATION = [r"\b(?:last|next|final)\s+(?:tool|function)\s+call\b", r"\bno\s+(?:response|reply|answer)\s+yet\b", r"\b(?:last|next)\s+turn\b"]
