"""Patterns, labels, context words and confidences of personal data.

These must equal the published detector's for equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from lanternwatch.functions.regexes import Pattern

# Flat detector, in order; redaction replaces in this order.
V1 = [
    Pattern("EMAIL", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    Pattern("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    Pattern("AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    Pattern("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    Pattern("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:\d{4}[-\s]?){3}\d{4})\b"),
    Pattern("PHONE", r"(\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b|\+\d{1,3}[\s\-.]?\d{2,4}[\s\-.]?\d{4,}"),
    Pattern("DATE_OF_BIRTH", r"\b(?:DOB|Date of Birth|Birth Date|Born)[:\s]+(?:\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2})\b", "i"),
    Pattern("MEDICAL_RECORD_NUMBER", r"\b(?:MRN|Medical Record)[#:\s]+\s*\d{6,10}\b", "i"),
    Pattern("PASSPORT", r"\b(?:Passport)[#:\s]+[A-Z]{1,2}\d{6,9}\b"),
    Pattern("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    Pattern("BANK_ACCOUNT", r"\b(?:Account|Acct|Routing)[\s#:]+\d{7,17}\b", "i"),
    Pattern("DRIVER_LICENSE", r"\b(?:DL|Driver['\s]?s?\s+License)[#:\s]+[A-Z0-9]{5,15}\b", "i"),
    Pattern("STUDENT_RECORD", r"\b(?:Student\s*ID|StudentID|Roll\s*No|Roll\s*Number|Student\s*Record)[#:\s]+[A-Z0-9\-]{3,20}\b", "i"),
]
#: What a text must hold for a pattern to occur in it; not part of the fixed values.
_NEEDS = {"EMAIL": "@", "DATE_OF_BIRTH": "[0-9]", "IP_ADDRESS": r"[0-9]\.[0-9]", "DRIVER_LICENSE": "(?i)dl|license", "STUDENT_RECORD": "(?i)student|roll"}
V1 = [replace(p, needs=_NEEDS.get(p.name, "[0-9]{2}")) for p in V1]
LABELS = {
    "EMAIL": "[REDACTED-EMAIL]", "PHONE": "[REDACTED-PHONE]", "SSN": "[REDACTED-SSN]", "CREDIT_CARD": "[REDACTED-CC]", "DATE_OF_BIRTH": "[REDACTED-DOB]",
    "MEDICAL_RECORD_NUMBER": "[REDACTED-MRN]", "PASSPORT": "[REDACTED-PASSPORT]", "IP_ADDRESS": "[REDACTED-IP]", "IPV6": "[REDACTED-IPV6]", "BANK_ACCOUNT": "[REDACTED-BANK-ACCT]",
    "BANK_ACCOUNT_US": "[REDACTED-BANK-ACCT]", "IBAN": "[REDACTED-IBAN]", "SWIFT_BIC": "[REDACTED-SWIFT]", "DRIVER_LICENSE": "[REDACTED-DL]", "AADHAAR": "[REDACTED-AADHAAR]",
    "PAN": "[REDACTED-PAN]", "NHS": "[REDACTED-NHS]", "STUDENT_RECORD": "[REDACTED-STUDENT]", "CPF": "[REDACTED-CPF]", "CNPJ": "[REDACTED-CNPJ]", "SIN": "[REDACTED-SIN]",
    "NRIC": "[REDACTED-NRIC]", "TFN": "[REDACTED-TFN]", "EIN": "[REDACTED-EIN]", "BITCOIN_ADDR": "[REDACTED-BTC]", "ETHEREUM_ADDR": "[REDACTED-ETH]", "IMEI": "[REDACTED-IMEI]",
    "MAC_ADDR": "[REDACTED-MAC]",
}
PHI = ["SSN", "MEDICAL_RECORD_NUMBER", "PHONE", "EMAIL", "DATE_OF_BIRTH", "IP_ADDRESS", "AADHAAR"]


@dataclass(frozen=True)
class Layer:
    """A layer of the scored detector. ``check``: a kind of ``checksums.CHECKS``, or none."""

    pattern: Pattern
    base: float
    check: str | None = None
    context: tuple[str, ...] = ()


# Scored detector, in order.
V2 = [
    Layer(V1[0], 0.95),
    Layer(V1[1], 0.6, "SSN", ("ssn", "social security", "soc sec", "taxpayer")),
    Layer(V1[2], 0.35, "AADHAAR", ("aadhaar", "aadhar", "uid")),
    Layer(V1[3], 0.85, "PAN", ("pan", "permanent account")),
    Layer(Pattern("CREDIT_CARD", r"\b(?:\d[ \-]?){13,19}\b"), 0.5, "CREDIT_CARD", ("card", "visa", "mastercard", "amex", "cc")),
    Layer(V1[5], 0.7, None, ("phone", "tel", "mobile", "cell", "call", "whatsapp")),
    Layer(Pattern("DATE_OF_BIRTH", r"(?:DOB|Date of Birth|Birth Date|Born)[:\s]+(?:\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2})", "i"), 0.95),
    Layer(V1[7], 0.9),
    Layer(V1[8], 0.9),
    Layer(V1[9], 0.9),
    Layer(Pattern("BANK_ACCOUNT_US", r"\b(?:Account|Acct|Routing)[\s#:]+(\d{7,17})\b", "i"), 0.85, "BANK_ACCOUNT_US"),
    Layer(Pattern("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9 ]{11,30}\b"), 0.5, "IBAN"),
    Layer(Pattern("NHS", r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b"), 0.4, "NHS", ("nhs", "patient")),
    Layer(V1[11], 0.9),
    Layer(V1[12], 0.95),
    Layer(Pattern("IPV6", r"\b(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4}\b|::1\b|::\b", "i"), 0.4, "IPV6"),
    Layer(Pattern("SWIFT_BIC", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"), 0.35, "SWIFT_BIC", ("swift", "bic", "iban", "wire", "transfer")),
    Layer(Pattern("CPF", r"\b\d{3}[.\s]?\d{3}[.\s]?\d{3}[-\s]?\d{2}\b"), 0.4, "CPF", ("cpf", "brazil", "brasil")),
    Layer(Pattern("CNPJ", r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}[-\s]?\d{2}\b"), 0.4, "CNPJ", ("cnpj",)),
    Layer(Pattern("SIN", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b"), 0.35, "SIN", ("sin", "social insurance", "canada")),
    Layer(Pattern("NRIC", r"\b[STFG]\d{7}[A-Z]\b", "i"), 0.85, "NRIC", ("nric", "singapore")),
    Layer(Pattern("TFN", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{2,3}\b"), 0.35, "TFN", ("tfn", "tax file", "australia")),
    Layer(Pattern("EIN", r"\b\d{2}-\d{7}\b"), 0.6, "EIN", ("ein", "employer identification")),
    Layer(Pattern("BITCOIN_ADDR", r"\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{8,87})\b"), 0.9, "BITCOIN_ADDR"),
    Layer(Pattern("ETHEREUM_ADDR", r"\b0x[0-9a-fA-F]{40}\b"), 0.95, "ETHEREUM_ADDR"),
    Layer(Pattern("IMEI", r"\b\d{15}\b"), 0.3, "IMEI", ("imei", "phone", "device")),
    Layer(Pattern("MAC_ADDR", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"), 0.9, "MAC_ADDR"),
]

#: Secrets: our own set, from public formats.
SECRETS = [
    Pattern("AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    Pattern("GITHUB_TOKEN", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    Pattern("SLACK_TOKEN", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Pattern("STRIPE_KEY", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    Pattern("JWT", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Pattern("PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Pattern("ASSIGNED_SECRET", r"\b(?:password|passwd|token|secret|api_key)\s*[:=]\s*[\"'][^\"'\s]{6,}[\"']", "i"),
]
