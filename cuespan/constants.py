"""Fixed values. Each must equal the published behaviour for results to agree."""

# --- time stamps -----------------------------------------------------------
MAX_HOUR_DIGITS = 9
MAX_STAMP_CHARS = 64

# --- cue limits ------------------------------------------------------------
MAX_REVIEW_CHARS = 20_000

# --- lint ------------------------------------------------------------------
CPS_LIMIT = 20.0
MIN_CUE_MS = 250
MAX_CUE_MS = 7000

# --- alignment -------------------------------------------------------------
COMPAT_WARNING_MS = 1000
# (reference character, read character) pairs that are watched by name
WATCHED_CONFUSIONS = [
    ("ş", "g"), ("ş", "s"), ("ç", "g"), ("ç", "c"), ("ğ", "g"), ("ı", "i"),
    ("İ", "I"), ("o", "0"), ("0", "o"), ("!", "l"), ("!", "i"),
]
FOLDED_CONFUSION = ("!", "!→l/i")
ELLIPSIS_LOSS = '"..." kaybı'

# --- readings --------------------------------------------------------------
LOW_CONF = 0.75
UPPER_BAND_CONF = 0.30
UPPER_SUSPECT_Y = (0.060, 0.072)
SWAP_CONSENSUS_CONF = 0.30
SWAP_SECOND_CONF = 0.80
SWAP_CONF_GAP = 0.50
SWAP_LENGTH_SHARE = 0.60
SWAP_CJK_FIRST_CONF = 0.45

# --- micro blocks ----------------------------------------------------------
MICRO_CONF_STRONG = 0.75
MICRO_CONF_WEAK = 0.50
MICRO_LETTERS_WEAK = 0.80
MICRO_CHARS_WEAK = 12
MICRO_MAX_SECONDS = 0.4
MICRO_SIM = 0.70

# --- reading merge ---------------------------------------------------------
MERGE_SAME_GAP = 0.7
MERGE_SIM = 0.70
MERGE_LONG_GAP = 1.2
MERGE_LONG_SIM = 0.75
MERGE_OVERLAP_SHARE = 0.60

# --- noise and screen text -------------------------------------------------
NOISE_CONF = 0.45
NOISE_SECONDS = 0.6
NOISE_LETTERS = 0.5
SCREEN_CONF = 0.15
SCREEN_CJK_SHARE = 0.15

# --- repeated watermark clusters -------------------------------------------
REPEAT_SIM = 0.60
REPEAT_WINDOW_S = 6.0
REPEAT_MIN = 4
REPEAT_MEDIAN_S = 0.5

# --- sound-effect lines ----------------------------------------------------
SFX_LETTERS = 0.4
SFX_SECONDS = 2.0
SFX_SIM = 0.60
SFX_LINE_CHARS = 30

# --- fragments that may return to the dialogue ------------------------------
FRAGMENT_SECONDS = 0.5
FRAGMENT_LETTERS = 0.6
FRAGMENT_VOWELS = 2
FRAGMENT_SIM = 0.60
FRAGMENT_CHAIN_GAP = 0.5
FRAGMENT_NEAR_S = 1.5
VOWELS = "AaEeIiİoOöÖuUüÜ"

# --- runs ------------------------------------------------------------------
RIP_SPEECH_S = 30.0
RIP_BLOCKS = 3
RIP_FEW_BLOCKS_SPEECH_S = 60.0
BOARD_LOW_PERCENT = 40.0

# --- dictionary repair -----------------------------------------------------
ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyz"
ALPHABET_UPPER = "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ"
DOT_TWINS = {"ş": "s", "s": "ş", "ç": "c", "c": "ç", "ğ": "g", "g": "ğ", "ı": "i", "i": "ı"}
WORD_MIN = 3
SPLIT_MIN = 7
SPLIT_PART_MIN = 4
WIDE_MAX = 14
MAX_FLIPS = 2
MAX_FLIP_POSITIONS = 12
FREQ_MIN = 50
DOMINANCE = 10
SPLIT_PENALTY = 0.3
SPLIT_SCORE_MIN = 300
WEAK_FREQ = 300
WEAK_DOMINANCE = 100
APOSTROPHE_FIXES = {"FilFin": "Fil'in"}

# --- dataset split ---------------------------------------------------------
SPLIT_SHARES = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]

# --- rating rubric ---------------------------------------------------------
DIMENSIONS = ["semantic_adequacy", "omissions", "additions", "terminology", "style_register"]
ISSUES = ["meaning", "omission", "addition", "term", "style", "grammar", "none"]
OUTCOMES = ["accepted", "edited", "rejected"]
UNEVALUABLE_REASONS = [
    "candidate_missing", "source_unavailable", "stale_source", "stale_candidate",
    "context_missing", "language_uncertain", "other",
]

# --- contributions ---------------------------------------------------------
RATE_LIMIT = 60
RATE_WINDOW_S = 3600
METRIC_KEYS = [
    "duration_seconds", "frames_scanned", "cue_count", "low_conf_count", "device_class",
    "engine_class", "low_conf_ratio", "speech_seconds", "cer",
]
REQUIRED_METRIC_KEYS = ["duration_seconds", "frames_scanned", "cue_count", "low_conf_count", "device_class", "engine_class"]

# --- frames ----------------------------------------------------------------
FRAME_MIN_FILL = 20
FADE_SHARE = 0.7
LINE_MIN_PX = 28.0

# fixed values: limits of a contribution call and of the crops of a dataset
MAX_BODY_BYTES = 16 * 1024
MAX_CROP_TOTAL_BYTES = 128 * 1024 * 1024
