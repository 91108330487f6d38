"""Fixed values.

Word lists, patterns, thresholds and templates that decide results. They are data, stated as they
must read for results to be right; the logic that applies them lives in the operator modules.
"""

# --- limits and weights -------------------------------------------------------------------
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
FILE_EXTENSIONS = ["csv", "txt", "xlsx", "xls", "json"]
TFIDF_MAX_FEATURES = 10000
BM25_K1, BM25_B = 1.2, 0.75
SQL_MAX_ROWS = 10000
SQL_PREVIEW_ROWS = 100
SEARCH_TOP_K = 10
SEARCH_MIN_SCORE = 0.1
HYBRID_ALPHA = 0.7
MAX_ENTITIES = 20
ENTITY_CONFIDENCE = 0.5
MAPPING_THRESHOLD = 0.7
WEIGHT_EXACT, WEIGHT_FUZZY, WEIGHT_PARTIAL, WEIGHT_DESCRIPTION = 1.0, 0.8, 0.5, 0.3
WEIGHT_TABLE = 0.3
RATE_LIMITS = {"strict": (10, 60), "moderate": (100, 3600)}
NUMERIC_SHARE, DATETIME_SHARE, BOOLEAN_SHARE = 0.8, 0.8, 0.9

# --- reading ------------------------------------------------------------------------------
CSV_SEPARATORS = [",", ";", "\t", "|"]
CSV_ENCODINGS = ["UTF-8", "ISO-8859-1", "windows-1252"]
READ_NULL_TOKENS = ["", "NULL", "null", "N/A", "n/a"]
# what the CSV reader of the reference's data-frame library treats as missing by default
DEFAULT_NULL_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "NA", "NaN", "None", "nan",
]
COERCE_NULL_TOKENS = ["", "null", "NULL", "None", "NaN", "nan"]
DATE_HINT = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
JDBC_PORTS = {"postgresql": 5432, "mysql": 3306, "mssql": 1433, "oracle": 1521}

# --- personal data ------------------------------------------------------------------------
PII_NAMES_FILE = [
    "email", "phone", "ssn", "social", "security", "passport", "license", "credit", "card",
    "account", "routing", "tax", "firstname", "lastname", "fullname", "address", "zip", "postal",
]
PII_NAMES_MODEL = ["email", "phone", "ssn", "social", "credit", "card", "password", "secret"]
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PII_VALUES_FILE = {
    "email": EMAIL,
    "phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    "ssn": r"\d{3}-?\d{2}-?\d{4}",
}
PII_VALUES_MODEL = {
    "email": EMAIL,
    "phone": r"\b\d{3}-\d{3}-\d{4}\b|\b\(\d{3}\)\s*\d{3}-\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
}
PII_VALUES_CONFIG = {
    "email": EMAIL,
    "phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
}
PII_VALUE_PROBE = 50

# --- business categories ------------------------------------------------------------------
CATEGORY_RULES = [
    ("identifier", ["id", "key", "ref", "pk", "fk"]),
    ("temporal", ["date", "time", "created", "updated", "modified"]),
    ("financial", ["amount", "price", "cost", "total", "sum", "revenue", "sales"]),
    ("quantity", ["count", "quantity", "qty", "number", "num"]),
    ("categorical", ["status", "state", "flag", "active", "enabled", "type"]),
    ("descriptive", ["name", "title", "description", "comment", "note"]),
    ("geographic", ["address", "city", "state", "country", "zip", "postal", "region"]),
]
LOW_CARDINALITY = 0.1
CATEGORY_NAME_RULES = [
    ("identifier", ["id", "key"]),
    ("descriptive", ["name", "title"]),
    ("temporal", ["date", "time"]),
    ("financial", ["amount", "price", "cost"]),
]

# --- business dictionary ------------------------------------------------------------------
BUSINESS_PATTERNS = {
    "customer": ["customer", "client", "user", "account_holder"],
    "revenue": ["revenue", "sales", "income", "earnings"],
    "transaction": ["transaction", "payment", "order", "purchase"],
    "product": ["product", "item", "sku", "inventory"],
    "date": ["date", "timestamp", "created_at", "updated_at"],
    "amount": ["amount", "total", "sum", "value", "price", "cost"],
    "quantity": ["quantity", "count", "number", "qty"],
    "status": ["status", "state", "flag", "active", "enabled"],
    "identifier": ["id", "key", "reference", "ref", "code"],
}
DOMAIN_PATTERNS = {
    "finance": ["balance", "credit", "debit", "interest", "principal", "loan"],
    "hr": ["employee", "salary", "department", "manager", "position"],
    "sales": ["lead", "opportunity", "quote", "commission", "territory"],
    "marketing": ["campaign", "conversion", "impression", "click", "engagement"],
    "operations": ["inventory", "warehouse", "shipment", "logistics", "supply"],
}
DOMAIN_FALLBACK = {
    "sales": ["sale", "order", "customer"],
    "hr": ["employee", "hr", "staff"],
    "finance": ["finance", "payment", "cost"],
    "operations": ["product", "inventory", "stock"],
}
IMPORTANT_CATEGORIES = ["customer", "revenue", "transaction", "product"]
TERM_DEFINITIONS = {
    "customer": ("Customer", "An individual or entity that purchases goods or services from the business"),
    "revenue": ("Revenue", "The total amount of income generated by the business from its operations"),
    "transaction": ("Transaction", "A business event or exchange involving the transfer of goods, services, or money"),
    "product": ("Product", "A good or service offered by the business to customers"),
    "amount": ("Amount", "A monetary value or quantity associated with a transaction or measurement"),
    "quantity": ("Quantity", "The number or amount of items, units, or measures"),
    "status": ("Status", "The current state or condition of an entity or process"),
    "identifier": ("Identifier", "A unique value used to distinguish and reference a specific entity"),
    "date": ("Date", "A temporal reference point indicating when an event occurred"),
}
SYNONYMS = {
    "customer": ["client", "buyer", "purchaser"],
    "revenue": ["income", "earnings", "sales"],
    "transaction": ["payment", "order", "purchase"],
    "product": ["item", "goods", "merchandise"],
    "amount": ["value", "sum", "total"],
    "quantity": ["count", "number", "volume"],
    "status": ["state", "condition", "stage"],
    "identifier": ["id", "key", "reference"],
    "date": ["timestamp", "time", "when"],
}
ABBREVIATIONS = {
    "customer": ["cust", "client"],
    "transaction": ["txn", "trans"],
    "quantity": ["qty", "qnt"],
    "amount": ["amt"],
    "identifier": ["id"],
    "number": ["num", "no"],
    "reference": ["ref"],
    "status": ["stat"],
    "date": ["dt"],
}
DICTIONARY_STATUS = ["draft", "pending_review", "approved", "rejected", "archived"]
DICTIONARY_CATEGORY = [
    "business_term", "technical_term", "abbreviation", "acronym", "metric", "dimension",
    "entity", "process", "system", "domain",
]
SUGGESTION_LIMIT = 50
AUTO_ACCEPT = 0.8
FUZZY_FLOOR = 0.3

# --- text ---------------------------------------------------------------------------------
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "are", "was", "were", "be", "been", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "this", "that", "these", "those",
]
KEY_TERM_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "are", "was", "were", "be", "been", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
]

# --- questions ----------------------------------------------------------------------------
INTENT_RULES = [
    ("retrieve", ["show", "list", "display", "get", "find"]),
    ("aggregate", ["count", "how many", "total", "sum"]),
    ("compare", ["compare", "difference", "vs", "versus"]),
    ("trend", ["trend", "over time", "change", "growth"]),
    ("ranking", ["top", "best", "highest", "lowest", "minimum", "maximum"]),
]
COMPLEX_WORDS = ["join", "group by", "having", "subquery"]
CONNECTIVES = ["and", "or", "where", "when"]
DIFFICULTY_INDICATORS = [
    "join", "group by", "having", "subquery", "nested", "union", "case when", "exists",
    "window function", "partition by",
]
DIFFICULTY_CONDITIONS = ["and", "or", "where", "when", "if"]
SEARCH_TARGETS = {
    "table": ["table", "dictionary_entry"],
    "entity": ["table", "dictionary_entry"],
    "column": ["column", "dictionary_entry"],
    "field": ["column", "dictionary_entry"],
    "attribute": ["column", "dictionary_entry"],
    "value": ["column", "dictionary_entry"],
    "data": ["column", "dictionary_entry"],
    "business_term": ["dictionary_entry", "table", "column"],
    "keyword": ["dictionary_entry", "table", "column"],
}
SEARCH_TARGETS_OTHER = ["table", "column", "dictionary_entry"]
TEMPLATE_ENTITY, TEMPLATE_VALUE = r"[\w\s]+", r"[\w\s\d]+"

# --- SQL text -----------------------------------------------------------------------------
SQL_FORBIDDEN_CHAT = [
    "DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE",
    "EXEC", "EXECUTE", "MERGE", "BULK", "OPENROWSET", "OPENDATASOURCE",
]
SQL_BLOCKED_SERVICE = ["DELETE", "UPDATE", "INSERT", "DROP", "ALTER", "CREATE", "TRUNCATE"]
SQL_ALLOWED_SERVICE = ["SELECT", "WITH", "EXPLAIN"]

# fixed values: what a guarded query may be made of
SQL_PLAN_NODES = frozenset((
    "UnresolvedRelation", "UnresolvedWith", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Project", "Filter", "UnresolvedHaving", "Aggregate",
    "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "WithWindowDefinition",
    "OneRowRelation", "OneRowRelation$", "Generate", "Pivot", "Unpivot", "UnresolvedOrderBy", "NamedParametersQuery",
))
SQL_FUNCTIONS = frozenset((
    # aggregates
    "count", "sum", "avg", "mean", "min", "max", "median", "mode", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "corr",
    "covar_pop", "covar_samp", "percentile", "percentile_approx", "approx_count_distinct", "any_value", "first", "last", "min_by", "max_by",
    "bool_and", "bool_or", "every", "some", "any", "count_if", "collect_list", "collect_set", "array_agg", "listagg", "string_agg", "grouping", "grouping_id",
    # windows
    "row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value",
    # conditions and casts
    "coalesce", "nullif", "ifnull", "nvl", "nvl2", "if", "greatest", "least", "isnull", "isnotnull", "isnan", "when", "cast", "try_cast",
    "int", "bigint", "double", "float", "decimal", "string", "boolean", "date", "timestamp",
    # numbers
    "abs", "ceil", "ceiling", "floor", "round", "bround", "sign", "signum", "sqrt", "cbrt", "exp", "ln", "log", "log2", "log10", "pow", "power", "mod",
    "pmod", "div", "width_bucket", "try_divide", "try_add", "try_subtract", "try_multiply",
    # text
    "lower", "lcase", "upper", "ucase", "initcap", "trim", "ltrim", "rtrim", "btrim", "length", "char_length", "character_length", "substr", "substring",
    "substring_index", "left", "right", "lpad", "rpad", "concat", "concat_ws", "replace", "translate", "reverse", "repeat", "split", "split_part", "position",
    "locate", "instr", "contains", "startswith", "endswith", "like", "ilike", "rlike", "regexp", "regexp_like", "regexp_extract", "regexp_extract_all",
    "regexp_replace", "regexp_count", "regexp_substr", "ascii", "chr", "md5", "sha2", "format_number", "format_string",
    # time
    "current_date", "current_timestamp", "now", "year", "quarter", "month", "week", "weekofyear", "day", "dayofmonth", "dayofweek", "dayofyear", "hour",
    "minute", "second", "date_trunc", "trunc", "date_add", "dateadd", "date_sub", "date_diff", "datediff", "add_months", "months_between", "last_day",
    "next_day", "date_format", "to_date", "to_timestamp", "make_date", "extract", "date_part", "unix_timestamp", "from_unixtime",
    # arrays and maps
    "array", "size", "cardinality", "array_contains", "element_at", "explode", "posexplode", "array_distinct", "array_sort", "sort_array", "sequence", "struct",
    "named_struct", "map",
))
