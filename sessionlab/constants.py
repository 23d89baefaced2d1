"""Fixed values shared by the operators."""

# --- fixed values: label vocabulary and codes ---
LABEL_CODES = {"baseline": 0, "activity": 1, "pre_fatigue": 2, "fatigue": 3}
UNLABELED = "unlabeled"
UNLABELED_CODE = -1
LABEL_NAMES = {0: "baseline", 1: "activity", 2: "pre_fatigue", 3: "fatigue", -1: "unlabeled"}

# --- fixed values: common sampling grid ---
TARGET_HZ = 4.0
TARGET_PERIOD_MS = 250.0

# --- fixed values: sensor files, their column maps and native rates (Hz) ---
SENSOR_FILES = {
    "acc": ("wrist_acc", {"ax": "acc_x", "ay": "acc_y", "az": "acc_z"}, 32.0),
    "hr": ("wrist_hr", {"hr": "wrist_hr"}, 1.0),
    "ibi": ("wrist_ibi", {"duration": "ibi"}, 0.65),
    "temp": ("wrist_skin_temperature", {"temp": "temp"}, 4.0),
    "ambient": ("ambient_grandeur", {"temperature_amb": "temp_amb", "humidite_amb": "hum_amb"}, 4.0),
}
MARKER_FILE = "exp_markers"
BREATHING_FILE = "chest_raw_breathing"

# --- fixed values: breathing analysis ---
BREATHING_HZ = 25.0
BREATHING_BAND_HZ = (0.05, 0.80)
BREATHING_MIN_GAP_S = 1.5
BREATHING_MIN_PROMINENCE = 100.0
BREATHING_GOOD_PROMINENCE = 500.0

# --- fixed values: questionnaire encodings ---
GENDER = {"female": 0, "male": 1}
LIKERT = {
    "disagree strongly": 1,
    "disagree a little": 2,
    "neither agree nor disagree": 3,
    "agree a little": 4,
    "agree strongly": 5,
}
FITNESS = {"very poor": 1, "poor": 2, "average": 3, "good": 4, "very good": 5}
YES_NO = {"no": 0, "yes": 1}

# --- fixed values: column names of the questionnaire (spelling as in the data) ---
LIKERT_COLUMNS = [
    "reserved", "generally_trusting", "lazy", "relaxed_handless_stress", "few_artistic_interests",
    "sociable", "criticize_others", "thorough_job", "easily_nervous", "active_magination",
]
FITNESS_COLUMNS = [
    "phisical_fitness", "cardiorespiratory_fitness", "muscular_strength", "agility_speed", "flexibility",
]
YES_NO_COLUMNS = ["cardiovascular_health_conditions"]
SENSOR_SIGNALS = ["acc_x", "acc_y", "acc_z", "wrist_hr", "ibi", "temp", "temp_amb", "hum_amb", "breathing_rpm"]
SIGNALS = SENSOR_SIGNALS + ["age", "gender"] + LIKERT_COLUMNS + FITNESS_COLUMNS + YES_NO_COLUMNS

# --- fixed values: row windows, optical pulse windows, thresholds ---
WINDOW_ROWS, WINDOW_STEP = 240, 120
WINDOW_SIZES = {"default": (240, 120), "1000": (480, 240)}
PULSE_HZ, PULSE_ROWS, PULSE_STEP = 100.0, 2000, 25
PULSE_MIN_GAP, PULSE_RISE = 15, 0.3
PSEUDO_LABEL_MIN = 0.7
SCORE_WEIGHTS = (0.5, 0.3, 0.2)
SCORE_MAX_MB, SCORE_DEFAULT_MB = 500.0, 100.0
