"""Word lists, lookup tables and constants that results depend on."""

# --- Fixed values: month stems, in calendar order, with nominative and genitive names.
MONTHS = (
    ("янв", "январь", "января"),
    ("фев", "февраль", "февраля"),
    ("мар", "март", "марта"),
    ("апр", "апрель", "апреля"),
    ("май", "май", "мая"),
    ("июн", "июнь", "июня"),
    ("июл", "июль", "июля"),
    ("авг", "август", "августа"),
    ("сен", "сентябрь", "сентября"),
    ("окт", "октябрь", "октября"),
    ("ноя", "ноябрь", "ноября"),
    ("дек", "декабрь", "декабря"),
)
MONTH_PATTERN = (
    r"(?U)январ|феврал|март|апрел|ма[йяе]\b|июн|июл|август|сентябр|октябр|ноябр|декабр"
)

# --- Fixed values: quarter words, roman numerals, spelled numbers.
QUARTER_WORDS = (("перв", 1), ("втор", 2), ("трет", 3), ("четверт", 4), ("четвёрт", 4))
ROMAN_QUARTERS = ("i", "ii", "iii", "iv")
SPELLED_NUMBERS = (
    "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять", "десять",
)

# --- Fixed values: money units.
MONEY_UNITS = (("тыс", 1_000), ("млн", 1_000_000), ("млрд", 1_000_000_000))

# --- Fixed values: status spellings per group, lower case.
APPROVED_STATUSES = ("утверждение", "утверждён", "утвержден")
DRAFT_STATUSES = ("черновик", "исследование")
DELETED_STATUSES = ("удалён", "удален")

# --- Fixed values: detection channel patterns, matched on lower-cased text.
CLIENT_CHANNEL = "клиент"
CONTROL_CHANNEL = "внешн|регул|контрол|орган"

# --- Fixed values: words that carry no meaning in a tiered text match.
TIER_NOISE_WORDS = (
    "банк", "блок", "отделение", "филиал", "банка", "уровень", "дивизион",
)

# --- Fixed values: characters removed from free text.
RARE_UNICODE = r"[\u1128-\uFFFF\x02\x08\x0b]"

# --- Fixed values: token and code patterns.
TOKEN_PATTERN = r"[а-яёa-z0-9]+"
CODE_PATTERN = r"(?U)\b(?:[Пп]\d{2,}|EVE-\d+|[Dd][Rr][Pp]-\d+|[Rr][Pp]-\d+)\b"
QUOTED_PATTERN = r"""['"«“]([^'"»”]{2,})['"»”]"""
CAPITALISED_PATTERN = (
    r"(?U)\b[А-ЯЁ][а-яёЁ]*(?:-[А-ЯЁ][а-яёЁ]*)*(?:\s+[А-ЯЁ][а-яёЁ]*){0,4}"
)
PREPOSITION_PATTERN = r"(?iU)\b(?:по|в|во|за|на|для)\s+([^,]{2,60})"
WORD_PATTERN = r"[А-ЯЁа-яёЁ-]+|[Пп]\d{2,}|EVE-\d+|[Dd][Rr][Pp]-\d+|[Rr][Pp]-\d+"

# --- Fixed values: endings of adjectives and nouns.
ADJECTIVE_ENDINGS = (
    "ому", "ого", "ым", "ом", "ой", "ую", "ая", "ое",
    "ые", "ых", "ыми", "ему", "его", "ем", "ий", "ый",
)
SOFT_STEM_LETTERS = "кгхчшщж"
NOUN_ENDINGS = (
    "иями", "иям", "иях", "ями", "ами", "ям", "ам", "ях", "ах",
    "ием", "ей", "ов", "ом", "ем", "ию", "ии", "ия", "ие",
    "ы", "и", "а", "я", "у", "ю", "е",
)
NOUN_SUFFIXES = ("", "о", "е", "а", "ие", "ия")

# --- Fixed values: words ignored when phrases are taken from a request.
PHRASE_STOP_WORDS = (
    "выгрузи", "выгрузка", "отчёт", "отчет", "покажи", "дай", "сделай", "нужно",
    "по", "в", "во", "за", "на", "для", "и", "с", "со", "год", "году", "года",
    "процесс", "процессу", "процесса", "банк", "банку", "банка",
    "инцидент", "инциденты", "всё", "все", "про",
)

# --- Fixed values: name rules for category columns.
ENUM_NAME_SUFFIXES = (
    "_name", "_code", "_status", "_type", "_kind", "_flag",
    "_category", "_cat", "_class", "_grade", "_level", "_lvl",
    "_state", "_stage", "_phase", "_role", "_action", "_method",
    "_mode", "_origin", "_source", "_priority", "_severity",
)
ENUM_EXCLUDED_SUFFIXES = (
    "_id", "_sid", "_uid", "_num", "_no",
    "_dt", "_dttm", "_date", "_time", "_ts",
    "_amt", "_sum", "_total", "_count", "_qty", "_pct", "_rate",
)
ENUM_EXCLUDED_PARTS = ("descr", "txt_", "_txt", "summary", "comment")
ENUM_EXCLUDED_NAMES = ("comments", "note", "notes", "description", "title")
ENUM_MAX_VALUES = 50
ENUM_MIN_FILLED_PCT = 1.0

# --- Fixed values: thresholds.
SPARSE_MONEY_FILLED_PCT = 5.0
HIGH_CARDINALITY = 800
CATALOG_VALUES_PER_COLUMN = 500
DEFAULT_ROW_LIMIT = 100_000
MATCH_MIN_SCORE = 0.6
MATCH_TOP_K = 8
GROUND_STRONG = 0.85
WARN_UPPER = 0.96
DIAGNOSE_OWN = 0.9
DIAGNOSE_ELSEWHERE = 0.8

# --- Fixed values: rank fusion and retrieval depths.
FUSION_K = 60
FUSION_LEXICAL_WEIGHT = 0.3
FUSION_MISSING_RANK = 999
DENSE_DEPTH = 1024
LEXICAL_DEPTH = 686
BM25_K1 = 1.5
BM25_B = 0.75

# --- Fixed values: recovery coefficients, percent, by (bankrupt flag, product).
RECOVERY_COEFFICIENTS = (
    ("0", "1", 49), ("0", "2", 45), ("0", "3", 20),
    ("0", "4", 15), ("0", "5", 20), ("0", "6", 24),
    ("1", "1", 49), ("1", "2", 15), ("1", "3", 4),
    ("1", "4", 5), ("1", "5", 7), ("1", "6", 6),
)
ON_BALANCE_COEFFICIENT = 3

# --- Fixed values: weights of the factor codes.
FACTOR_WEIGHTS = (("1", 30), ("2", 18), ("3", 18), ("4", 3))

# --- Fixed values: risk codes with their meaning.
RISK_UNSUITABLE_BORROWER = "DRP-10024"
RISK_FUNDS_WITHDRAWN = "DRP-10023"
RISK_CANNOT_COLLECT = "DRP-10047"
RISK_PLEDGE = "DRP-10027"
RISK_THEFT_BY_OUTSIDERS = "DRP-10102"
RISK_THEFT_BY_STAFF = "DRP-10103"

RISK_PROFILES = (
    ("DRP-10101", "Невзимание средств в погашение задолженности по кредитному продукту"),
    ("DRP-10023", "Вывод средств из бизнеса заемщиком"),
    ("DRP-10047", "Отсутствие возможности взыскания задолженности по кредитному продукту"),
    ("DRP-10024", "Выдача кредита заемщику, несоответствующему требованиям Банка"),
    ("DRP-10138", "Некорректное списание средств"),
    ("DRP-10027", "Неоформление / утрата обеспечения"),
    ("DRP-10192", "Снижение категории качества ссуды по фактору недостоверная отчетность"),
    ("DRP-10196", "Выдача кредита заемщику, вовлеченному в финансовую пирамиду"),
    ("DRP-10100", "Выдача кредита заемщику под залог имущества, не соответствующего требованиям кредитного продукта"),
    ("DRP-10025", "Неоформление предмета залога"),
    ("DRP-10102", "Хищение средств со счетов третьими лицами"),
    ("DRP-10103", "Хищения средств со счетов сотрудниками"),
)

# --- Fixed values: deviation codes a branch depends on. Codes listed together
# carry the same text and therefore take the same branch.
DEVIATION_FRAUD = ("1",)
DEVIATION_SYSTEM_FAILURE = ("37",)
DEVIATION_OUTSIDE_FRAUD = ("38",)
DEVIATION_OTHER = ("36",)
DEVIATION_FALSE_PLEDGE_REPORT = ("35", "40")
CORPORATE_DECISION_DEVIATIONS = ("5", "6", "14", "36", "41")
CORPORATE_FACTOR_DEVIATIONS = ("2", "42")
DEVIATION_DELIBERATE_BANKRUPTCY = ("44",)
CORPORATE_COURT_DEVIATIONS = ("45", "46")

CLIENT_PERSON, CLIENT_CORPORATE, CLIENT_SMALL = "1", "2", "3"
CLIENT_TYPES = (("1", "ФЛ"), ("2", "КСБ"), ("3", "ММБ"))
PLEDGE_LOST = "1"

# --- Fixed values: loss multipliers.
SYSTEM_FAILURE_FACTOR = "0.75"
OUTSIDE_FRAUD_FACTOR = "0.87"
CORPORATE_DECISION_FACTOR = "0.89"
WITHDRAWN_SHARE_CAP = 50
