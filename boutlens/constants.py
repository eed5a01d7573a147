"""Fixed values.

Everything in this module is a value that has to be exactly this for results
to be right: feature order, limits, lookup tables, word lists and patterns.
"""

# The feature vector, in index order.
FEATURE_NAMES = [
    "a_recent_wins", "a_fin_rate", "a_sub_rate", "a_td_def", "a_grap_def",
    "a_age", "a_exp", "a_fights_12m", "a_months_off", "a_wins", "a_losses",
    "a_stress_factor", "a_motivation_index", "a_biorythm_score", "a_camp_quality",
    "a_mystic_factor", "a_mystic_v2",
    "b_recent_wins", "b_fin_rate", "b_sub_rate", "b_td_def", "b_grap_def",
    "b_age", "b_exp", "b_fights_12m", "b_months_off", "b_wins", "b_losses",
    "b_stress_factor", "b_motivation_index", "b_biorythm_score", "b_camp_quality",
    "b_mystic_factor", "b_mystic_v2",
    "fin_x_td_A", "sub_x_grap_A", "rust_x_exp_A", "stress_x_camp_A",
    "a_reach_cm", "a_height_cm", "b_reach_cm", "b_height_cm",
    "a_camp_name_encoded", "b_camp_name_encoded",
    "a_children_factor", "b_children_factor",
]
WIDTH = 46
UNSCALED = (5, 22)              # the two age features are never z-scored
CHILDREN_DEFAULT = 0.3
UNKNOWN_CAMP = 0.4

# Camp scores.
CAMP_SCORES = {
    "Independent": 0.3, "Jackson Wink MMA": 0.8, "American Top Team": 0.85,
    "Team Alpha Male": 0.75, "Xtreme Couture": 0.7, "Elevation Fight Team": 0.7,
    "MMA Lab": 0.65, "Fortis MMA": 0.7, "Kill Cliff FC": 0.65, "SBG Ireland": 0.6,
    "Tiger Muay Thai": 0.6, "Nova União": 0.55, "American Kickboxing Academy": 0.8,
    "Serra-Longo Fight Team": 0.6, "Tristar Gym": 0.55, "MMA Factory": 0.5,
}
FALLBACK_CAMPS = [
    "American Top Team", "Jackson Wink MMA", "Team Alpha Male", "SBG Ireland", "AKA",
    "Kill Cliff FC", "Fortis MMA", "Elevation Fight Team", "MMA Lab", "Xtreme Couture",
]
# Camp texts that mean "no camp".
PLACEHOLDER_CAMPS = [
    "профессиональный клуб", "неизвестно", "не указано", "unknown", "none", "null", "",
    "неизвестен", "профессиональный", "клуб", "неизвестна", "неизвестный", "no data", "n/a", "na",
]

# Weight limits by feature index.
NAMED_LIMITS = {17: 0.040, 10: 0.060, 32: 0.030, 25: 0.060, 27: 0.100}
POSITIVE_ONLY = [3, 4, 15, 20, 21]
POSITIVE_FLOOR = 0.001
USEFUL_FLOORS = {3: 0.002, 4: 0.002, 7: 0.004, 20: 0.002, 21: 0.002}
RECORD_INDEXES = [9, 10, 26, 27]     # win / loss counts, stored divided by 100
AGE_LIMIT = 0.10
GENERAL_LIMIT = 0.1
LIMIT_SLACK = 0.0001
ADAPTIVE_CLIP = 0.5
BIAS_RESET = 0.3
BIAS_LIMIT = 0.05
STEP_SHARE = 0.5
STEP_MIN = 0.00001

# Feature pairs and the symmetric bound both weights must respect.
PAIR_LIMITS = [
    ("a_recent_wins+activity", 0, 7, 0.50),
    ("a_fin_rate+sub_rate", 1, 2, 0.50),
    ("a_td_def+grap_def", 3, 4, 0.40),
    ("a_age+exp", 5, 6, 0.30),
    ("a_stress+motivation", 11, 12, 0.35),
    ("a_biorythm+camp", 13, 14, 0.25),
    ("a_mystic+mystic_v2", 15, 16, 0.20),
    ("b_recent_wins+activity", 17, 24, 0.50),
    ("b_fin_rate+sub_rate", 18, 19, 0.50),
    ("b_td_def+grap_def", 20, 21, 0.40),
    ("b_age+exp", 22, 23, 0.30),
    ("b_stress+motivation", 28, 29, 0.35),
    ("b_biorythm+camp", 30, 31, 0.25),
    ("b_mystic+mystic_v2", 32, 33, 0.20),
    ("fin_x_td_A+sub_x_grap_A", 34, 35, 0.30),
    ("rust_x_exp_A+stress_x_camp_A", 36, 37, 0.30),
    ("a_reach+height", 38, 39, 0.20),
    ("b_reach+height", 40, 41, 0.20),
    ("camp_enc_A+B", 42, 43, 0.15),
    ("children_A+B", 44, 45, 0.10),
]

# Least scores of the first and second name of a typed pair.
ACCEPT_FIRST = 0.70
ACCEPT_SECOND = 0.07

# Training.
LEARNING_RATE = 0.005
EPOCHS = 100
L1_RATIO = 0.01
ALPHA = 0.1
BASE_DROPOUT = 0.05
ENRICHED_DROPOUT = 0.05
ENRICHED = [11, 12, 13, 14, 15, 28, 29, 30, 31, 32]
NO_DECAY = [15, 32]
DEAD_ZONE = 0.001
TRAIN_SEED = 42
BATCH_TRAIN_SIZE = 150
RECENT_WINDOW = 300
FRESH_TARGET = 139
HISTORICAL_TARGET = 60
FRESH_WEIGHT = 1.2
HISTORICAL_WEIGHT = 0.7
RECENT_FEATURES = 500
SCALER_ALPHA = 0.005
ROLLBACK_DROP = 0.04

# Prediction.
STUB_ODDS = 1.85
DAMPING = 0.75
MARKET_PULL = 0.15
CI_HALF_WIDTH = 0.15
TILT_ZONE = 0.53
TILT_MIN_CONF = 70
TILT = 0.03
AGREE_FACTOR = 1.5
DISAGREE_FACTOR = 0.5

# Number compatibility, row = birth number 1..9, column = day number 1..9.
COMPATIBILITY = [
    [0.50, 0.70, 0.80, 0.60, 0.90, 0.70, 0.80, 0.70, 0.60],
    [0.70, 0.60, 0.75, 0.80, 0.65, 0.90, 0.70, 0.65, 0.75],
    [0.80, 0.75, 0.70, 0.55, 0.85, 0.80, 0.75, 0.60, 0.90],
    [0.60, 0.80, 0.55, 0.75, 0.50, 0.85, 0.60, 0.90, 0.65],
    [0.90, 0.65, 0.85, 0.50, 0.70, 0.60, 0.80, 0.65, 0.75],
    [0.70, 0.90, 0.80, 0.85, 0.60, 0.75, 0.70, 0.80, 0.85],
    [0.80, 0.70, 0.75, 0.60, 0.80, 0.70, 0.95, 0.65, 0.90],
    [0.70, 0.65, 0.60, 0.90, 0.65, 0.80, 0.65, 0.85, 0.70],
    [0.60, 0.75, 0.90, 0.65, 0.75, 0.85, 0.90, 0.70, 0.80],
]
BIRTH_STRENGTH = [0.80, 0.50, 0.70, 0.60, 0.90, 0.60, 0.75, 0.70, 0.85]
DAY_STRENGTH = [0.70, 0.50, 0.80, 0.60, 0.85, 0.70, 0.75, 0.65, 0.90]
NEUTRAL_NUMBER = 5
NEUTRAL_VALUE = 0.5
# Moon cycle, reference new moon 2000-01-06 18:14 UTC.
MOON_EPOCH = "2000-01-06"
MOON_EPOCH_SECONDS = 18 * 3600 + 14 * 60
SYNODIC_DAYS = 29.530588853
MOON_STARTS = [0.3, 0.5, 0.7, 0.9, 0.8, 0.6, 0.5, 0.4]
MOON_SLOPES = [0.2, 0.2, 0.2, -0.1, -0.2, -0.1, -0.1, -0.1]
MOON_PHASES = [
    "new moon", "waxing crescent", "first quarter", "waxing moon",
    "full moon", "waning moon", "last quarter", "waning crescent",
]

# Transliteration.
TRANSLIT_ONE = ("абвгдеёзийклмнопрстуфыэ", "abvgdeeziyklmnoprstufye")
TRANSLIT_DROP = "ъь"
TRANSLIT_MANY = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
NAME_SUFFIXES = ["jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "v"]
PAIR_SEPARATORS = [" - ", " — ", " vs ", " VS ", " против "]
JUNK_ALIAS_WORDS = ["no contest", "nc", "the ", "killer"]

# Bounds of enriched fields as (low, high, default).
FIELD_BOUNDS = {
    "fin_rate": (0.0, 1.0, 0.5), "sub_rate": (0.0, 1.0, 0.0),
    "td_def": (0.0, 1.0, 0.5), "grap_def": (0.0, 1.0, 0.5),
    "reach_cm": (150, 225, 180), "height_cm": (150, 210, 175),
    "stress_factor": (0.20, 0.85, 0.45), "motivation_index": (0.30, 0.95, 0.65),
    "biorythm_score": (0.35, 0.95, 0.65), "camp_quality": (0.30, 0.95, 0.70),
    "mystic_v2": (0.30, 0.90, 0.62),
}
ANSWER_KEYS = [
    "age", "wins", "losses", "recent_wins", "fin_rate", "sub_rate", "td_def", "grap_def",
    "months_off", "fights_12m", "reach_cm", "height_cm", "camp_name", "stress_factor",
    "motivation_index", "biorythm_score", "camp_quality", "mystic_v2", "form", "dob",
]
IMPUTE_KEYS = ["exp", "dob", "dob_quality", "camp_name", "reach_cm", "height_cm"]
BOUT_KEYS = [
    "fighter_a", "fighter_b", "winner", "date", "stats_a", "stats_b",
    "ai_factor", "blind_conf", "round", "method", "odds_a", "odds_b",
]
STAT_KEYS = [
    "age", "wins", "losses", "fin_rate", "sub_rate", "td_def", "grap_def", "recent_wins",
    "months_off", "fights_12m", "stress_factor", "motivation_index", "biorythm_score",
    "camp_quality", "camp_name", "mystic_factor", "mystic_v2", "reach_cm", "height_cm",
    "exp", "dob", "dob_quality",
]
EXPECTED_FIELDS = STAT_KEYS + ["name", "flag", "form", "verif"]
METHOD_CODES = {
    "UD": "DECISION_UNANIMOUS", "SD": "DECISION_SPLIT", "MD": "DECISION_UNANIMOUS",
    "DEC": "DECISION_UNANIMOUS", "TKO": "TKO", "KO": "KO", "SUB": "SUBMISSION",
}
DECISIONS = ["DECISION_UNANIMOUS", "DECISION_SPLIT", "DRAW"]
# Words that mark a payment text as incoming, matched on lowered text.
INCOMING_WORDS = ["поступл", "зачислен", "пополнен", "приход"]
AMOUNT_PATTERN = r"(\d+(?:\s\d{3})*(?:[.,]\d{1,2})?)\s*(?:руб|₽|р)"
# Ledger.
TRIAL_PREDICTIONS = 20
PAYMENT_WINDOW_SECONDS = 900
ODDS_TTL_SECONDS = 3600
TRAINING_PAUSE_HOURS = 24
TARIFFS = [(500, 100, 60), (1000, 200, 150), (1500, 350, 365)]
