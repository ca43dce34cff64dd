"""Fixed values of the catalog and its rules.

Every value here decides a result (which extension is routed where, which
folder name is noise, how a score is weighted), so they are kept together.
Operators take them as defaults; callers may pass their own.
"""

# --- file routing -----------------------------------------------------------
EXTENSION_TYPES = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".pdf": "pdf",
    ".h5": "h5",
    ".json": "json",
    ".txt": "txt",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
    ".webp": "image",
}

# --- text -------------------------------------------------------------------
CLEAN_KEEP = "a-z0-9éèêàâùç"
CONTENT_CHARS = 20000
SNIPPET_CHARS = 500
DOMAIN_PROMPT_CHARS = 1000
REFINE_PROMPT_CHARS = 500
EXTRACT_PROMPT_CHARS = 2000
CONTEXT_CHARS = 1000
LIST_MIN_LINES = 2          # a list has more lines than this
LIST_SAMPLE_LINES = 20
LIST_MAX_MEAN_WORDS = 15
LIST_MIN_LINE_CHARS = 2     # kept lines are longer than this

# --- label rules ------------------------------------------------------------
LABEL_MIN_LENGTH = 3
LABEL_MAX_DIGIT_SHARE = 0.15
LABEL_STOP_WORDS = ["image", "img", "photo", "doc", "unknown", "document", "file", "nan", "null"]
TECHNICAL_FOLDERS = [
    "images", "img", "photos", "train", "test", "meta", "archive", "dataset", "raw", "v1", "v2",
    "raw-datasets",
]
GENERIC_FOLDERS = TECHNICAL_FOLDERS + [
    "images", "data", "raw-datasets", "content", "img", "photos", "val", "train", "test",
    "dataset", "archive",
]
MAPPING_FILE_WORDS = ["label", "mapping", "meta"]
MAPPING_FILE_EXTENSIONS = [".txt", ".csv", ".tsv"]
PLAN_MAGIC_WORDS = ["name", "label", "category", "title", "presentation", "chemical", "product"]
RECORD_MAGIC_WORDS = [
    "presentation", "chemical", "name", "label", "category", "titre", "product", "nom",
]
PLAN_SAMPLE_ROWS = 10
PLAN_PROBE_VALUES = 5
SEMANTIC_THRESHOLD = 0.65

# --- domains ----------------------------------------------------------------
DEFAULT_DOMAINS = ["food", "medical", "cars"]
DOMAIN_PROMPTS = [
    "A photo of {}.",
    "Category: {}.",
    "This is related to {}.",
    "A list of {}.",
    "Technical data about {}.",
]
CONTEXT_FORCE_THRESHOLD = 0.50
CONTEXT_WEIGHT = 0.6
CONTENT_WEIGHT = 0.4
SOFTMAX_FACTOR = 10.0
SHORTLIST_GAP = 0.15
SHORTLIST_FLOOR = 0.05
LOW_CONFIDENCE = 0.25
REJECTION = 0.20
ARBITRATION_BELOW = 0.8

# --- extraction -------------------------------------------------------------
OCR_INGEST_CONFIDENCE = 0.6
OCR_QUERY_CONFIDENCE = 0.5
BLOB_INLINE_BYTES = 10 * 1024 * 1024
BLOB_LABEL_ATTRS = ["label", "category", "class"]

# --- fingerprints -----------------------------------------------------------
FINGERPRINT_FULL_BYTES = 1024 * 1024
FINGERPRINT_SLICE_BYTES = 10 * 1024

# --- search -----------------------------------------------------------------
EMBEDDING_DIM = 512
WEIGHT_VISUAL = 0.6
WEIGHT_TEXT = 0.3
WEIGHT_INTENT = 0.1
INTENT_MIN_CHARS = 5
INDEX_MIN_ROWS = 1000
INDEX_CELLS = 256
INDEX_SUB_VECTORS = 64

# --- exploration and watching -----------------------------------------------
PREVIEW_ROWS = 1000
EXPLORER_POINTS = 5000
DEBOUNCE_SECONDS = 10
# hex characters of a hash's digest by which known hashes are stored
HASH_PREFIX = 2
