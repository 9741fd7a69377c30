"""Values on which results depend."""

# Words too common to identify anything.
COMMON_WORDS = """
id name key value values data datum item items type kind status result results model models
config configuration setting settings option options object record row rows column columns
field fields table test tests example sample file files document docs main run load save
create make get set build compute calculate measure client server request response input
output string integer number boolean true false null
""".split()
# Words of fields, names and units of measure.
GENERIC_FIELD_WORDS = COMMON_WORDS + "time date timestamp created updated".split()
ACTION_PREFIXES = "get set make build create compute calculate measure load save write".split()
MEASUREMENT_SUFFIXES = "ms sec secs mbps gbps hz kb mb gb".split()
ALIASES = {"tput": "throughput"}
NAMESPACE_WRAPPERS = """
column columns config configuration data document item items properties property
record records root row rows setting settings value values
""".split()
# Tokens that a fact's key loses.
FACT_KEY_STOPS = "pointer key document".split()
MAX_IDENTIFIER_CHARS, MAX_UNIT_TOKENS, MAX_CONTAINER_FIELDS = 128, 4096, 256
MAX_DISTINCT, MAX_SHOWN_VALUES, MAX_SHOWN_CHARS = 256, 8, 160
DETAIL_PROFILES = {"brief": (8_000, 2), "standard": (24_000, 4), "deep": (48_000, 6)}
# Order in which types are shown.
TYPE_ORDER = "null boolean integer number datetime date time string array object element".split()
# Text scalars.
INTEGER_RE = r"^[+-]?(0|[1-9][0-9]*)$"
NUMBER_RE = r"^[+-]?(?:(?:0|[1-9][0-9]*)\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?:0|[1-9][0-9]*)[eE][+-]?[0-9]+)$"
DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
TIME_RE = r"^\d{2}:\d{2}(:\d{2}(\.\d{3,6})?)?$"
DATETIME_RE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{3,6})?)?(Z|[+-]\d{2}:\d{2})?$"
# Cues of definitions and caveats.
DEFINITION_RE = r"^\s*(?:[-*]\s+)?\*\*([^*]+)\*\*\s*[:—-]\s+\S"
CAVEAT_RE = r"\b(?:note that|caveat|caution|warning|however|but only if|be aware|do not|don't|never|must not|limitation)\b"
