"""Patterns, word lists, weights and thresholds that define the answers.

These are constants of the data model, kept in one place. None of them is tuned here.
"""

# --- column vocabulary (patterns are case-insensitive; metric order decides, first match wins)
METRIC_PATTERNS = [
    ("time_composition", r"(va|nva|transport|other)[_\s]+time"),
    ("utilization", r"util(?:ization)?"),
    ("queue_wait", r"queue|waiting|wait[_\s]*time"),
    ("cycle_time", r"cycle"),
    ("wip_storage", r"stored|storage|\bwip\b"),
    ("throughput", r"parts per hour|entities out|total parts|totalproducts|products per"),
    ("activity_time", r"(assembly|drilling|milling|blanking|press\d?|cell\d?|paint\d?)[_\s]+time"),
]
NON_STATION_TOKENS = [
    "util", "utilization", "queue", "waiting", "wait", "time", "cycle", "total",
    "parts", "part", "entities", "in", "out", "va", "nva", "transport", "other",
    "stored", "products", "now", "sku", "sku1", "sku2", "sku3", "sku4", "per",
    "hour", "demand", "answer", "response", "predictor",
]
TIME_NAMES = ["time_now", "time", "timestamp", "datetime"]
COUNTER_CYCLE = r"^c_cycle(\d+)"
COUNTER_UNIT = r"^c_(cell|press|blanking|paint|quality|forklift|warehouse)[_ ]?(\d*)"
STATION_SUFFIX = r"[_ ]?\d+$"
SKU_COLUMN = r"^(sku\d+)[_\s]"

DATE_NAMES = r"inspection[_ ]?date|qc[_ ]?date|date|period|week|month\b|shift"
THROUGHPUT_NAMES = r"parts per hour|total parts|entities out|totalproducts|throughput"
QC_RESPONSE_NAMES = r"defect|fault|scrap|rework|reject(ed)?|passed|failed|accept(ed)?|ok\b"
QC_VOLUME_NAMES = r"units?[_ ]?(inspected|tested|processed|produced|checked|sampled|reviewed)"
INPUT_NAMES = r"demand|arrival|rate"
IMAGE_NAMES = r"(image|img|photo|picture)[_\s]*(path|file|url|id)?$"
CLASS_NAMES = r"defect|pass|fail|reject|scrap|rework|quality|status|result|outcome|label|class|grade"
TARGET_CLASS_NAMES = r"pass|fail|defect|reject|scrap|rework|quality|status|result|outcome|label|class|grade"
LABEL_NAMES = r"defect|label|class|quality|pass|fail|reject"
QUALITY_NAMES = r"defect|quality|pass|fail|reject|scrap|rework"
VALUE_ADDED_TIME = r"^va[_\s]*time$"
ANOMALY_NAME_EXCLUDES = ["split", "index", "id", "time"]
TARGET_EXCLUDES = r"^split$|_id$|^row$|^index$"
FACTOR_EXCLUDES = ["split", "row", "index"]

NUMERIC_ROLES = ["process_metric", "numeric", "input_factor", "response_candidate", "ml_variable"]
RESPONSE_ROLES = ["response_candidate", "ml_variable"]
NON_NEGATIVE_METRICS = [
    "utilization", "queue_wait", "wip_storage", "counter",
    "cycle_time", "throughput", "time_composition", "activity_time",
]
TRACKED_METRICS = ["utilization", "queue_wait", "wip_storage", "cycle_time", "throughput"]
TRACKED_TOTAL = 7
METRIC_LABELS = {
    "utilization": "utilization", "queue_wait": "queue", "wip_storage": "wip",
    "cycle_time": "cycle time", "throughput": "throughput",
}
NOT_AVAILABLE = "NOT AVAILABLE FROM DATASET"

# --- splits and model inputs
MIN_SPLIT_ROWS = 30
TRAIN_SHARE, VALIDATION_SHARE = 0.70, 0.85
MIN_INPUT_ROWS = 10

# --- evidence
EVIDENCE_WEIGHTS = {
    "correlation": 0.30, "mutual_information": 0.20, "group_difference": 0.20,
    "temporal": 0.15, "anomaly": 0.10, "model_contribution": 0.05,
}
STATION_WEIGHTS = {
    "utilization_pressure": 0.28, "queue_pressure": 0.24, "cycle_time_pressure": 0.14,
    "throughput_constraint": 0.14, "root_cause_evidence": 0.12, "anomaly_evidence": 0.08,
}
ASSOCIATION_BANDS = [(60, "STRONG_ASSOCIATION"), (40, "MODERATE_ASSOCIATION"), (20, "WEAK_ASSOCIATION")]
DISCLAIMER = "Association does not establish causation."
MIN_TARGET_ROWS = 100
EWMA_SPAN, DRIFT_Z, DRIFT_MIN_ROWS, DRIFT_BASELINE = 200, 3.0, 500, 0.25
IMPACT_OUTPUT_HINTS = ["parts per hour", "total parts", "entities out", "totalproducts", "throughput", "c_cycle"]
TIMELINE_ALIASES = [
    ("utilization", "ratio", ["utilization", "utilisation", "util"]),
    ("queue", "time", ["queue", "waiting"]),
    ("cycle", "time", ["cycle", "va time", "processing time"]),
    ("throughput", "units", ["throughput", "parts per hour", "output rate"]),
]

# --- economics: field, unit, smallest, largest value
ASSUMPTION_FIELDS = [
    ("contribution_margin_per_unit", "currency/unit", 0.0, None),
    ("scrap_cost_per_unit", "currency/unit", 0.0, None),
    ("rework_cost_per_unit", "currency/unit", 0.0, None),
    ("downtime_cost_per_hour", "currency/hour", 0.0, None),
    ("downtime_hours_per_day", "hours/day", 0.0, 24.0),
    ("operating_cost_per_hour", "currency/hour", 0.0, None),
    ("working_hours_per_day", "hours/day", 0.0, 24.0),
    ("working_days_per_month", "days/month", 0.0, 31.0),
    ("baseline_demand", "units/day", 0.0, None),
    ("expected_defect_rate", "ratio", 0.0, 1.0),
    ("expected_rework_rate", "ratio", 0.0, 1.0),
    ("intervention_cost", "currency", 0.0, None),
]
MAX_SCENARIO_CHANGE = 0.95

# --- advisory language
FORBIDDEN_PHRASES = [
    r"\bwill fix\b",
    r"\bwill increase\b",
    r"\bwill reduce\b",
    r"\bwill save\b",
    r"\bwill eliminate\b",
    r"\bguaranteed\b",
    r"\bproven cause\b",
    r"\bconfirmed root cause\b",
    r"\bis the root cause\b",
    r"\bguaranteed savings\b",
    r"\bdefinitely\b",
    r"\bwill definitely\b",
    r"\bensure[sd]? (?:a |an )?(?:increase|reduction|saving)",
]
NEGATIONS = ["not ", "no ", "never ", "cannot be ", "can not be ", "isn't ", "wasn't ", "without ", "not yet "]
NEGATION_REACH = 16
CONTROL_VERBS = ["SET_SPEED", "SET_TEMPERATURE", "STOP_LINE", "CONTROL_MACHINE", "ADJUST_SETPOINT", "AUTOMATE"]
QUALITY_ORDER = {"HIGH_EVIDENCE": 3, "MODERATE_EVIDENCE": 2, "LIMITED_EVIDENCE": 1, "INSUFFICIENT_EVIDENCE": 0}

# --- inspection
PASS_CONFIDENCE, DEFECT_CONFIDENCE, REVIEW_GATE = 0.80, 0.70, 0.99
HUMAN_ACTIONS = [
    ("confirm_defect", "DEFECT", "CONFIRM DEFECT"),
    ("mark_pass", "PASS", "MARK PASS"),
    ("keep_in_review", "REVIEW", "KEEP IN REVIEW"),
    ("escalate", "ESCALATED", "ESCALATE"),
]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "ppm", "pgm"]
BATCH_SUFFIXES = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"]
MIN_IMAGE_SIDE = 8
SPLIT_FOLDERS = {
    "train": "train", "training": "train", "val": "validation", "validation": "validation",
    "valid": "validation", "test": "test", "testing": "test",
}
NORMAL_FOLDERS = ["good", "normal", "ok", "pass", "nominal", "healthy", "defect_free", "defectfree"]
DEFECT_FOLDERS = (
    r"defect|scratch|dent|crack|stain|contamination|discoloration|broken|fault|damage|hole|spot"
)
ANNOTATION_JSON_NAMES = r"(coco|annotation|annotations|instances|labels|bbox)"
METADATA_FILES = ["metadata.csv", "metadata.json", "labels.csv", "annotations.csv", "manifest.csv",
                  "manifest.json", "info.json"]
YOLO_FOLDERS = ["labels", "annotations", "yolo"]
