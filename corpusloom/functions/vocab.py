"""Default vocabulary. Every operator takes its own as a parameter; these are the fixed values of the default profile."""

ALIASES = {
    "APIT": "Advance Personal Income Tax",
    "AIT": "Advance Income Tax",
    "WHT": "Withholding Tax",
    "SET": "Statement of Estimated Tax Payable",
    "SSCL": "Social Security Contribution Levy",
    "TIN": "Taxpayer Identification Number",
    "RAMIS": "Revenue Administration Management Information System",
    "IIT": "Individual Income Tax",
    "CIT": "Corporate Income Tax",
    "PIT": "Partnership Income Tax",
    "VAT": "Value Added Tax",
}
TAX_LABELS = {
    "individual_income_tax": ["individual income tax", "personal income tax", "iit"],
    "corporate_income_tax": ["corporate income tax", "company income tax", "cit"],
    "partnership_income_tax": ["partnership income tax", "partnership", "pit"],
    "income_tax": ["income tax"],
    "apit": ["apit", "advance personal income tax", "advance income tax"],
    "ait": ["ait", "advance income tax"],
    "wht": ["wht", "withholding tax"],
    "sscl": ["sscl", "social security contribution levy"],
    "stamp_duty": ["stamp duty"],
    "vat": ["vat", "value added tax"],
}
#: The broad label is dropped where one of the specific ones is found.
BROAD_LABEL, SPECIFIC_LABELS = "income_tax", ["individual_income_tax", "corporate_income_tax", "partnership_income_tax"]
TAXPAYER_LABELS = {
    "individual": ["individual", "personal taxpayer", "person"],
    "partnership": ["partnership", "partners"],
    "company": ["company", "companies", "corporate", "corporation"],
}
PROCEDURAL_VERBS = ["file", "complete", "register", "pay", "upload", "submit", "amend", "appeal", "obtain", "navigate", "identify"]
HISTORICAL = "histor(?:y|ical|ically)|previous(?:ly)?|prior|old|past|earlier|last year|superseded|former|before"
FOLLOW_UP = (
    "what about|how about|and|also|instead|that|those|this|it|them|same|more|another"
    "|for (?:individuals?|partnerships?|companies?|businesses?)"
)
LEGAL = "law|legal|act|gazette|section|regulation|rate"
AUTHORITY_RANKS = {
    "legislation": 100, "gazette": 90, "official_circular": 80, "official_notice": 70,
    "official_calendar": 60, "official_form": 50, "official_guide": 40, "official_webpage": 30,
}
#: Preference of authority levels by kind of question.
AUTHORITY_LEGAL = {
    "legislation": 8, "gazette": 7, "official_circular": 6, "official_notice": 5,
    "official_calendar": 3, "official_form": 2, "official_guide": 1, "official_webpage": 0,
}
AUTHORITY_PROCEDURAL = {
    "official_form": 8, "official_guide": 7, "official_notice": 6, "legislation": 5,
    "gazette": 4, "official_circular": 4, "official_calendar": 3, "official_webpage": 2,
}
AUTHORITY_DEFAULT = {
    "legislation": 8, "gazette": 7, "official_circular": 6, "official_notice": 5,
    "official_form": 4, "official_guide": 3, "official_calendar": 2, "official_webpage": 1,
}
STATUS_NOW = {"current": 3, "unknown": 2, "historical": 1, "superseded": 0}
STATUS_PAST = {"historical": 3, "superseded": 2, "current": 1, "unknown": 0}
