"""The default pattern groups."""

# Groups that can match without a digit or a plus sign, and what they need at least.
DIGIT_FREE = {"email address", "mailing address - BR"}
NEEDED_TEXT = {"email address": "@"}

# Name and regular expression of each group, in the order in which they apply.
PATTERN_GROUPS = [
    (
        "SSN - US",
        r"(?!(\d){3}(-| |)\1{2}\2\1{4})(?!666|000|9\d{2})(\b\d{3}(-| |)(?!00)\d{2}\4(?!0{4})\d{4}\b)",
    ),
    (
        "credit card number - US",
        r"\b\d{4}[- ]?(\d{4}[- ]?){2,3}\d{4}\b|\b\d{15}\b",
    ),
    (
        "phone number - US",
        r"((\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}|[0-9]{10}|\+{1}[0-9 ]{11,15}|[0-9]{4} [0-9]{6})",
    ),
    (
        "mailing address - US",
        r"\d+(\s+(N|S|E|W|NE|NW|SE|SW)\.?)?\s+[0-9]{0,5}[a-zA-Z]+\s+(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Lane|Ln|Square|Sq)",
    ),
    (
        "email address",
        r"[A-Za-z0-9._+\-\']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    ),
    (
        "CPF - BR",
        r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    ),
    (
        "CNPJ - BR",
        r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b",
    ),
    (
        "credit card number - BR",
        r"\b\d{4}[- ]?(\d{4}[- ]?){2,3}\d{4}\b|\b\d{15,16}\b",
    ),
    (
        "phone number - BR",
        r"\(\d{2}\)\s?\d{4,5}-\d{4}\b|\b\d{4,5}-\d{4}\b",
    ),
    (
        "CEP - BR",
        r"\b\d{5}-\d{3}\b",
    ),
    (
        "mailing address - BR",
        r"\b(?:Rua|Av\.?|Avenida|Travessa|Alameda|Rodovia|Estrada|Praça)\s+[A-Za-zÀ-ÖØ-öø-ÿ]+(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ]+)*(?:,\s*\d+)?\b",
    ),
]
