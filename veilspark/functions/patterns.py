"""Name lists and patterns that results depend on."""

from __future__ import annotations

#: Patterns of personal data that hold everywhere.
UNIVERSAL = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

#: Regimes: the primary statute where it isn't the first option, statutes to choose from, direct identifiers, quasi-identifiers, patterns.
REGIMES = {
    "POLAND": {
        "statutes": [
            "Poland Personal Data Protection Act (Ustawa o ochronie danych osobowych) & GDPR",
            "EU General Data Protection Regulation (GDPR Article 28 / Chapter V)",
            "Financial Supervision Authority (KNF) Cloud Compliance Standard",
        ],
        "direct": ["pesel", "nip", "regon", "national_id", "id_card", "passport", "email", "phone", "iban"],
        "quasi": ["kod_pocztowy", "postal_code", "city", "miasto", "birth_date", "data_urodzenia", "age", "gender"],
        "patterns": {"PESEL": r"\b\d{11}\b", "NIP": r"\b\d{10}\b", "PL_PHONE": r"\b(?:\+48[-\s]?)?[4-9]\d{8}\b", "PL_POSTAL": r"\b\d{2}-\d{3}\b"},
        "words": ("POLAND", "POLSKA", "GDPR", "UODO"),
        "exact": ("PL", "EU"),
    },
    "SAUDI ARABIA": {
        "statutes": [
            "Saudi Personal Data Protection Law (PDPL) & NDMO Data Management Standards",
            "SAMA Financial Cybersecurity & Banking Data Privacy Framework",
            "Healthcare Information Security & MoH Health Data Standard",
        ],
        "direct": ["national_id", "iqama", "civil_id", "passport", "email", "phone", "iban", "commercial_reg", "cr_number"],
        "quasi": ["district", "postal_code", "city", "birth_date", "age", "gender", "occupation", "hijri_date"],
        "patterns": {"SAUDI_ID_OR_IQAMA": r"\b[12]\d{9}\b", "SAUDI_PHONE": r"\b(?:\+?966[-\s]?|0)?5\d{8}\b", "SAUDI_IBAN": r"\bSA\d{2}[A-Z0-9]{20}\b"},
        "words": ("SAUDI", "KSA", "ARABIA", "PDPL", "NDMO", "ZATCA"),
        "exact": (),
    },
    "UNITED STATES": {
        "primary": "US Health Insurance Portability and Accountability Act (HIPAA Safe Harbor) & CCPA/CPRA",
        "statutes": [
            "US Health Insurance Portability and Accountability Act (HIPAA Safe Harbor)",
            "California Consumer Privacy Act & CPRA (CCPA / Title 1.81.5)",
            "Gramm-Leach-Bliley Act (GLBA Financial Privacy Standard)",
        ],
        "direct": ["ssn", "social_security", "itin", "ein", "drivers_license", "mrn", "patient_id", "email", "phone"],
        "quasi": ["zip", "zip_code", "county", "birth_date", "admission_date", "discharge_date", "age", "gender"],
        "patterns": {"US_SSN": r"\b\d{3}-\d{2}-\d{4}\b", "US_PHONE": r"\b(?:\+?1[-\s.]?)?\(?\d{3}\)?[-\s.]?\d{3}[-\s.]?\d{4}\b", "US_ZIP": r"\b\d{5}(?:-\d{4})?\b"},
        "words": ("UNITED STATES", "AMERICA", "HIPAA", "CCPA", "CPRA", "GLBA"),
        "exact": ("US", "USA"),
    },
    "UNITED KINGDOM": {
        "statutes": [
            "UK General Data Protection Regulation (UK GDPR) & Data Protection Act 2018",
            "NHS National Data Guardian Information Governance Framework",
            "UK Financial Conduct Authority (FCA) Consumer Data Protection Standard",
        ],
        "direct": ["nino", "national_insurance", "nhs_number", "passport", "email", "phone", "bank_account"],
        "quasi": ["postcode", "postal_code", "county", "birth_date", "age", "gender"],
        "patterns": {"UK_NINO": r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]\b", "UK_POSTCODE": r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"},
        "words": ("UNITED KINGDOM", "BRITAIN", "ENGLAND", "DPA", "NINO"),
        "exact": ("UK",),
    },
}
#: Regimes are tried in this order.
REGIME_ORDER = ("SAUDI ARABIA", "POLAND", "UNITED STATES", "UNITED KINGDOM")

#: Without a regime.
BASE_DIRECT = [
    "name", "full_name", "first_name", "last_name", "national_id", "ssn", "pesel", "iqama", "id_number", "email", "phone", "mobile",
    "iban", "account_number", "credit_card", "passport", "tax_id",
]
BASE_QUASI = [
    "birth_date", "dob", "age", "gender", "sex", "postal_code", "zip", "zip_code", "city", "state", "region", "country", "date",
    "timestamp", "notes", "comments",
]
#: Direct identifiers that every policy has.
ALWAYS_DIRECT = ["email", "phone", "iban", "credit_card", "card_number", "account_number", "name"]
#: Tokens of column names.
PII_TOKENS = frozenset({
    "name", "customer", "patient", "client", "employee", "vendor", "user", "ssn", "pesel", "iqama", "nino", "iban", "email", "phone",
    "mobile", "cell", "card", "pan", "passport", "license", "licence", "taxid",
})
QUASI_TOKENS = frozenset({
    "date", "dob", "birth", "age", "gender", "sex", "zip", "postal", "city", "address", "street", "state", "country", "lat", "lon",
    "location", "note", "notes", "comment", "comments", "desc", "description", "memo",
})

#: Column names that are quasi-identifiers, sensitive, keys and metrics.
QI_NAMES = (
    r"\b(age|years?_old)\b",
    r"^(gender|sex)$",
    r"\b(birth|dob|born)\b",
    r"\b(zip|postal|postcode)\b",
    r"\b(city|town|municipality|state|province|county|region|country)\b",
    r"\b(ethnicity|race|nationality)\b",
    r"\b(marital|marriage|spouse)\b",
    r"\b(visit_date|admission|discharge|registration_date)\b",
    r"\b(department|division|job_title|occupation|rank)\b",
)
SENSITIVE_NAMES = (
    "condition|diagnosis|disease|illness|syndrome|pathology",
    "medication|prescription|drug|dosage",
    "salary|income|wage|compensation|bonus|net_worth",
    "credit_score|debt|balance|loan",
    "religion|political|union",
)
ID_NAMES = r"(_?id|_?key|_?num|_?no|_?code|uuid|guid)$|^([a-z0-9_]*_)?(id|key|code|uuid|guid)$"
METRIC_NAMES = "quantity|qty|price|amount|total|sum|discount|cost|count|sales|revenue|profit|margin|rate|score|weight|height|length|width|size|volume|balance|salary|income|val|value"
SURROGATE_NAMES = r"^(internal_?id|id|uuid|record_?id|client_?id)$"

#: Substrings of a column name and the tag of its tokens, in order; ID if none is found.
TAGS = (
    ("EMAIL", ("email", "mail")),
    ("PHONE", ("phone", "mobile", "tel", "cell")),
    ("FINANCIAL", ("iban", "account", "bank", "card", "pan", "balance")),
    ("NAME", ("name", "patient", "customer", "client", "employee", "user", "company")),
    ("ADDRESS", ("address", "street", "city", "postal", "zip")),
    ("SEQ", ("seq", "sequence")),
    ("GL_CODE", ("gl", "ledger", "account")),
)

#: Cells that the structural mask keeps.
STRUCTURE_WORDS = (
    "doc. no", "doc no", "doc no.", "doc. date", "doc date", "customer", "seq", "item code", "description", "qty", "quantity", "uom",
    "unit price", "price", "total", "grand total", "date", "document", "company", "gl code", "code", "co category", "agent", "area",
    "currency", "doc project", "project", "item", "location", "category", "incl cancelled", "sort by", "tax", "vat", "discount",
    "subtotal", "net amount", "gross amount", "balance", "debit", "credit", "from", "to", "page", "terms", ":", "all",
)

#: Free-text entities; letters include the Arabic ones.
NAME_HEAD = "[A-Zء-ي]"
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Doctor", "Prof.", "Professor", "Eng.", "Engineer", "Sheikh", "Shaikh", "Ustadh", "Sayyid", "Sayed", "Haji", "Nurse", "Officer")
RELATIONS = ("mother", "father", "wife", "husband", "son", "daughter", "brother", "sister", "guardian", "patient", "client", "customer", "physician")
ORGANISATIONS = ("Hospital", "Clinic", "Medical Center", "Health Center", "Sanatorium", "Infirmary", "University", "College", "Ministry", "Authority", "Company", "Corporation", "Corp", "Ltd", "LLC")
ROADS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Boulevard", "Blvd", "Highway", "Hwy", "Lane", "Ln", "Drive", "Dr", "Terrace", "Ter", "Way", "Court", "Ct", "Circle", "Cir")
PARTICLES = ("bin", "bint", "al-", "ibn", "el-")

#: Ledger reports.
DOCUMENT_NUMBER = r"(?i)^(?:(IV|INV|CN|DN|PO|SO|BILL|REC|PV|RV|VOUCH|ORD)[-_\s]?\d+|[A-Za-z]{1,6}[-_/\s]\d{3,12})"
LEDGER_RESET = ("grand total", "account summary", "item code summary", "tax summary")
LEDGER_NOISE = ("doc. no", "seq", "account summary", "grand total", "sub total", "total:", "gl code", "page ", "print date", "report date", "selection:", "parameters:")
LEDGER_HEADS = ("doc", "seq", "code", "gl", "total", "summary", "invoice no", "line no")
#: Words of the two header bands of a report, and roles of their columns by words in the label: the first role that
#: fits, in this order.
MASTER_BAND = ("doc. no", "doc no", "invoice no", "inv no", "voucher", "order no")
LINE_BAND = ("seq", "line no", "item code", "gl code", "description", "qty", "quantity")
MASTER_LABELS = (
    ("doc", MASTER_BAND),
    ("date", ("doc. date", "doc date", "invoice date", "order date", "date")),
    ("code", ("cust code", "customer code", "code", "debtor code", "account")),
    ("name", ("cust name", "customer name", "name", "client", "customer")),
    ("total", ("total", "amount", "net amount")),
)
LINE_LABELS = (
    ("seq", ("seq", "line no", "line", "item no", "sl no")),
    ("item", ("gl code", "item code", "part no", "sku")),
    ("desc", ("description", "narration", "particulars", "item name")),
    ("qty", ("qty", "quantity", "units", "hours")),
    ("price", ("unit price", "unit cost", "unit rate", "price", "rate", "cost")),
    ("amount", ("item amount", "line amount", "amount", "line total")),
    ("uom", ("uom", "measure")),
    ("total", ("total",)),
)
UNITS = frozenset({
    "CTN", "PCS", "PC", "KG", "G", "MTR", "M", "UNIT", "UNITS", "BOX", "BOXES", "SET", "SETS", "LITRE", "LTR", "BAG", "BAGS", "BTL",
    "BTLS", "PACK", "PKT", "EACH", "EA", "DOZ", "DZ", "HR", "HRS", "DRUM", "CAN", "ROLL", "PAIR", "PR",
})

#: Words of urgency and of open work in free text.
URGENT = ("asap", "urgent", "error", "test", "check", "review", "vip", "priority", "critical", "pending", "hold", "fix", "عاجل", "مهم", "فحص", "مراجعة", "خطأ", "تنبيه")

#: Currency marks that are cleared before a number is read.
CURRENCY = "[$€£¥₹]|SAR|AED|KWD|BHD|OMR|QAR|ر\\.س|ريال|د\\.إ"

#: Forms of dates, found at the beginning of a value without its outer blanks.
DATE_FORMATS = {
    "YYYY-MM-DD (ISO)": r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    "DD/MM/YYYY or MM/DD/YYYY": r"^\d{1,2}/\d{1,2}/\d{4}",
    "DD-Mon-YYYY (e.g. 15-Aug-2025)": r"^\d{1,2}-[A-Za-z]{3}-\d{4}",
    "Month DD, YYYY (e.g. August 15, 2025)": r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}",
    "Timestamp ISO-8601": r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}",
}
#: Negatives in brackets or with a minus behind, and marks of money.
ACCOUNTING_NEGATIVE = r"^\s*\(\s*[\$€£SARa-zA-Z]*\s*[\d,]+(\.\d+)?\s*\)\s*$|^\s*[\d,]+(\.\d+)?\s*-\s*$"
DIRTY_CURRENCY = r"(?i)[\$€£¥₹₽₩₺₴]|(?:\b(?:SAR|AED|USD|EUR|GBP|INR|CAD|AUD|CHF|JPY|CNY|KWD|BHD|OMR|QAR|EGP)\b)|ريال"

#: Words of a column's name that give its role, in the order in which they are asked.
QUASI_ROLE_WORDS = ("zip", "postal", "age", "gender", "sex", "dob", "birth", "nationality")
KEY_ROLE_WORDS = ("id", "code", "no", "num", "number", "key", "doc", "inv")
PERSON_ROLE_WORDS = ("name", "patient", "customer", "client", "employee", "user", "person", "doctor", "nurse")
UNIT_ROLE_WORDS = ("department", "dept", "branch")

#: Words of report heads and feet.
METADATA_WORDS = ("report", "filter", "criteria", "parameters", "sort", "date :", "تصفية", "فلتر", "معايير", "التاريخ :", "ترتيب", "تقرير", "بيانات", "كشف")
FOOTER_WORDS = ("total", "grand total", "subtotal", "summary", "end of report", "average", "count", "المجموع", "الإجمالي", "إجمالي", "صافي", "ملخص", "المحصلة", "النهائي", "كلي")

#: Names of columns of processes and of links.
CASE_NAME = r"(?i)^(?:case|trace|order|claim|ticket|visit|session|patient)[_\s]?(?:id|num|no)?$"
ACTIVITY_NAME = r"(?i)^(?:activity|action|status|stage|step|event|state|operation|الحالة|المرحلة)$"
ACTIVITY_WORDS = ("status", "state", "stage")
SOURCE_NAME = r"(?i)^(?:source|src|sender|from|caller|parent|المصدر)[_\s]?(?:id|num|no)?$"
TARGET_NAME = r"(?i)^(?:target|dst|dest|receiver|recipient|to|callee|child|الوجهة|الهدف)[_\s]?(?:id|num|no)?$"

#: Words in column names of clinical tables, and of other families of tables in the order in which they are tried.
CLINICAL_WORDS = ("patient", "mrn", "diagnosis", "admission", "discharge", "physician", "clinical", "rx", "dose")
FAMILY_WORDS = (
    ("FINANCE", ("loan", "debt", "interest", "credit_score", "mortgage", "collateral", "borrower")),
    ("RETAIL", ("sku", "cart", "discount", "cogs", "inventory", "shipping_fee", "return_reason")),
    ("SAAS", ("mrr", "arr", "subscription", "churn", "session_id", "dau", "mau")),
    ("LOGISTICS", ("vin", "waybill", "fleet", "carrier", "transit_time", "dispatch_date")),
    ("HR", ("employee_id", "hire_date", "tenure", "salary", "bonus", "department", "attrition")),
    ("IOT", ("sensor_id", "vibration", "voltage", "temperature", "rpm", "device_id")),
    ("MARKETING", ("campaign", "impression", "click", "ctr", "cpc", "roas", "ad_spend")),
)
