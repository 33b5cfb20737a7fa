"""Vocabularies and constants of the particle model.

Fixed values: they define what a particle class, a measurable size or a valid
scale is, so results are only comparable when they are kept as they are.
"""

import math

# --- vocabularies -----------------------------------------------------------
PATTERNS = ["janus", "stripe", "lamellar", "composite"]          # order decides argmax ties
CLASS_ORDER = ["undercooled"] + PATTERNS
VOLUME_SEGMENTS = CLASS_ORDER + ["nopattern"]
NOPAT = "nopat"
REPORT_CLASSES = PATTERNS + [NOPAT]
TILE_CLASSES = ["undercooled", "solid", "janus", "stripe", "composite", "lamellar"]
CONTRAST_DETECTORS = ["CBS"]
FLAT_DETECTORS = ["ETD", "SE", "SE2", "TLD", "INLENS"]
IMAGE_EXTENSIONS = ["jpeg", "jpg", "png", "tif", "tiff", "bmp"]

# --- size floors ------------------------------------------------------------
SOLID_MIN_DIAM_NM = 200.0
MIN_COUNT_DIAM_NM = 15.0
MIN_COUNT_DIAM_PX = 4.0
MIN_COUNT_AREA_PX = math.pi * 4.0
MIN_REGION_AREA_PX = 30

# --- pattern gate -----------------------------------------------------------
PATTERN_MAX_EDGE_CUT = 1.10
PATTERN_MIN_SOLIDITY = 0.70
PATTERN_MIN_AR = 0.30
PATTERN_SMALL_NM = 350.0
JANUS_MIN_NM = 300.0
PATTERN_MIN_BRIGHT = -30.0
STRUCTURE_MIN = 0.45

# --- measurement gate -------------------------------------------------------
MEASURE_MIN_SOLIDITY = 0.90
EDGE_MEASURE_MAX = 0.85
MEASURE_MIN_AR = PATTERN_MIN_AR
EDGE_MEASURE_MIN_AR = 0.45
MEASURE_MIN_FILL = 0.92

# --- roundness --------------------------------------------------------------
SPHERICITY_MIN_PERIM_PX = 4.0
SPHERICITY_FLOOR = 0.85

# --- small-candidate filter -------------------------------------------------
SMALL_MAX_NM = 250.0
SMALL_MIN_NM = 18.0
SMALL_DEFAULT_NM_PER_PX = 8.0
SMALL_MIN_CIRCULARITY = 0.6
SMALL_MIN_SOLIDITY = 0.88

# --- probability-space thresholds (defaults; calibration may replace them) ---
DEFAULT_THRESHOLDS = {
    "facet_thresh": 0.50,
    "janus_min_solid": 0.55,
    "nopattern_solid_conf": 0.90,
    "stripe_small_min_conf": 0.80,
    "janus_small_min_conf": 0.55,
}

# --- scale reading ----------------------------------------------------------
MIN_NM_PER_PX = 0.05
MAX_NM_PER_PX = 500.0
HFW_BAR_TOL = 0.10
MAG_TOL = 0.05
ADOPT_TOL = 0.005
INSTRUMENT_K_MM = {"BIOMATEN": 413.0}
UNIT_NM = {"nm": 1.0, "µm": 1000.0, "um": 1000.0, "pm": 1000.0, "m": 1000.0, "mm": 1e6}
STANDARD_LABELS_NM = [100, 200, 250, 300, 400, 500, 1000, 2000, 3000, 4000, 5000,
                      10000, 20000, 30000, 40000, 50000, 100000, 200000, 500000]
READER_VERSION = 1

# --- charts -----------------------------------------------------------------
NICE_WIDTHS = [5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000]
HIST_TARGET_BINS = 20
PANEL_AXIS_MAX = 1500.0
PANEL_BINS = 30
PANEL_BIN_NM = PANEL_AXIS_MAX / PANEL_BINS
CI_Z = 1.96
MAJORITY_MIN_N = 20

# --- evaluation, calibration, review, curve ---------------------------------
MATCH_PX = 3.0
HISTORY_KEEP = 40
SNAPSHOT_KEEP = 4
CAL_MIN_PHOTOS = 4
CAL_MIN_PARTICLES = 300
CAL_MIN_SUBSET = 100
CAL_MIN_GAIN = 0.002
GRID_PERCENT = (5, 95)                       # cut grid in hundredths, step 1
REVIEW_PAGE = 32
TRAIN_MIN_PHOTOS = 3
TRAIN_MIN_ROWS = 60
CURVE_FRACTIONS = [(0.2, 2), (0.4, 2), (0.6, 1), (0.8, 1), (1.0, 1)]
CURVE_MIN_ROWS = 20
CURVE_C = (0.05, 2.0, 196)                   # exponent scan: first, last, points
PIPELINE_VERSION = 7
