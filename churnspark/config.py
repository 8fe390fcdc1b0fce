"""Fixed values of the churn engine.

Everything in this module is a constant whose value must equal the one the
original application uses, so that results agree. They are stated plainly and
in their natural order; the code elsewhere only refers to them by name.
"""

# --- fixed values: general ---------------------------------------------------
RANDOM_STATE = 42
TEST_SIZE = 0.20

NULL_THRESHOLD = 0.50
NEAR_CONSTANT_THRESHOLD = 0.98
HIGH_CARDINALITY_LIMIT = 50

VERY_LARGE_DATASET_ROWS = 200_000

IMBALANCE_LOW = 0.20
IMBALANCE_HIGH = 0.80

CV_FOLDS = 5
N_TRIALS = 30
EARLY_STOP_ROUNDS = 30
MAX_BOOST_ROUNDS = 500

# --- fixed values: model score weights -----------------------------------------
SCORE_WEIGHT_PR_AUC = 0.45
SCORE_WEIGHT_RECALL = 0.35
SCORE_WEIGHT_ROC = 0.20

# --- fixed values: column-name hints (in the original order) --------------------
ID_HINTS = [
    "customerid", "customer_id", "userid", "user_id", "client_id", "clientid",
    "account_id", "accountid", "cust_id", "member_id", "employeeid",
    "employee_id", "empid", "custno", "custnum", "clientnum", "client_num",
    "rownum", "row_num", "rowno", "row_no", "rownumber", "row_number",
    "id", "idx", "index",
]
CHURN_HINTS = [
    "churn", "is_churned", "churned", "left_company", "attrition",
    "is_churn", "target", "label", "churned_flag", "left", "exited",
    "cancelled", "canceled", "subscription_status",
]
LEAK_HINTS = [
    "date_churned", "churn_date", "exit_date", "cancellation_date",
    "last_activity_after_churn", "days_since_churn", "churn_reason",
]
# name fragments for the fallback ID rule and the value-based target rule
ID_NAME_FRAGMENTS = ["id", "no", "num", "code", "key"]
TARGET_NAME_FRAGMENTS = ["churn", "attrition", "left", "exit"]

# --- fixed values: word sets ---------------------------------------------------
# boolean-like strings (profiler, cleaner)
BOOL_WORDS = ["yes", "no", "true", "false", "1", "0", "y", "n", "t", "f"]
# cleaner mapping of boolean-like strings to 0/1
BOOL_MAP = {
    "yes": 1, "no": 0, "true": 1, "false": 0,
    "y": 1, "n": 0, "t": 1, "f": 0, "1": 1, "0": 0,
}
# strict target conversion
STRICT_TARGET_MAP = {"yes": 1, "no": 0, "true": 1, "false": 0, "1": 1, "0": 0}
# lenient target (signal assessment): these strings are the positive class
LENIENT_POSITIVE = [
    "1", "yes", "true", "y", "t", "churn", "churned", "left", "exited",
    "cancelled", "canceled",
]
# summary churn count
SUMMARY_POSITIVE = ["1", "yes", "true", "churn", "1.0"]

# --- fixed values: identifier patterns (Java/Python compatible) ------------------
EMAIL_RE = r"(?i)^[\w.+\-]+@[\w\-]+\.[a-z]{2,}$"
UUID_RE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HASH_RE = r"(?i)^[0-9a-f]{32,64}$"
PHONE_RE = r"^[\d\s\-\+\(\)\.]{7,20}$"

# --- fixed values: signal assessment ---------------------------------------------
SIGNAL_STRONG = 0.30
SIGNAL_MEDIUM = 0.10
SIGNAL_MIN_VALID = 30
SIGNAL_MIN_CLASS = 5
SIGNAL_MAX_CATS = 50
SIGNAL_TOP_CATS = 30
SIGNAL_MAX_ROWS = 20_000
SIGNAL_TOP_SHARE = 0.60
SIGNAL_HIGH = 60
SIGNAL_MEDIUM_SCORE = 35

# --- fixed values: feature engineering ---------------------------------------------
MAX_RATIO_COLS = 5
MAX_RATIO_PAIRS = 10
SKEW_LOG_LIMIT = 1.5
CORR_DEDUP_LIMIT = 0.95
MIN_MI = 0.003
SHORT_NAME_LEN = 10

# --- fixed values: one-hot encoding -------------------------------------------------
OHE_MIN_FREQUENCY = 0.01
OHE_MAX_CATEGORIES = 30

# --- fixed values: thresholds and risk ------------------------------------------------
# decision-threshold grid: 0.20, 0.22, ..., 0.70 (26 points), generated by rule
THRESHOLD_START = 0.20
THRESHOLD_STEP = 0.02
THRESHOLD_COUNT = 26
THRESHOLDS = [round(THRESHOLD_START + THRESHOLD_STEP * i, 3) for i in range(THRESHOLD_COUNT)]
RISK_HIGH = 0.70
RISK_MEDIUM = 0.40
MONITOR_SHIFT_PP = 10.0
CALIBRATION_MIN_GAIN = 0.001

# --- fixed values: metric bands in words -------------------------------------------------
# (lower bound, word) from the top; below the last bound the fallback word applies
AUC_BANDS = [(0.90, "Excellent"), (0.80, "Good"), (0.70, "Moderate")]
AUC_FALLBACK = "Weak"
RECALL_BANDS = [(0.80, "High"), (0.60, "Moderate")]
RECALL_FALLBACK = "Low"
AP_BANDS = [(0.75, "Excellent"), (0.55, "Good")]
AP_FALLBACK = "Moderate"
F1_BANDS = [(0.80, "Excellent"), (0.65, "Good")]
F1_FALLBACK = "Moderate"
# train-test gap: below 0.02 Excellent, below 0.05 Moderate, else Overfitting
OVERFIT_BANDS = [(0.02, "Excellent"), (0.05, "Moderate")]
OVERFIT_FALLBACK = "Overfitting"

# --- fixed values: sensitivity modes (threshold ceilings) -----------------------------------
SENSITIVITY_RECALL_MAX = 0.40
SENSITIVITY_BALANCED_MAX = 0.55

# --- fixed values: output sentences (placeholders in braces) ------------------------------
# signal assessment, per feature
SIG_WEAK = "{label} has little influence on whether a customer churns."
SIG_NUM_STRONG_UP = "Customers with higher {low} are significantly more likely to churn."
SIG_NUM_STRONG_DOWN = "Customers with higher {low} are significantly less likely to churn."
SIG_NUM_MEDIUM_UP = "Customers with higher {low} tend to churn somewhat more often."
SIG_NUM_MEDIUM_DOWN = "Customers with higher {low} tend to be somewhat more loyal."
SIG_CAT_STRONG_TWO = "The two groups in {low} show a strong difference in churn behavior."
SIG_CAT_STRONG = "Customers with different {low} values show a strong difference in churn behavior."
SIG_CAT_MEDIUM_TWO = "The two groups in {low} show a moderate difference in churn behavior."
SIG_CAT_MEDIUM = "Customers with different {low} values show a moderate difference in churn behavior."
# signal assessment, summary
SIG_HIGH_TEXT = ("The dataset contains strong statistical signals for churn prediction. "
                 "{n_strong} out of {n_total} features ({pct}%) show a clear difference "
                 "between customers who churned and those who stayed. "
                 "A well-tuned model should be able to learn these patterns reliably. "
                 "The most informative feature is **{top}**.")
SIG_MEDIUM_TEXT = ("The dataset has moderate predictive signal. "
                   "{n_strong} features show strong separation, {n_medium} show moderate separation, "
                   "and {n_weak} contribute little to no signal. "
                   "A model can learn useful patterns here, but results will depend heavily on "
                   "feature engineering and model choice. **{top}** is the most informative feature.")
SIG_LOW_TEXT = ("The dataset has weak overall predictive signal. "
                "Only {n_strong} out of {n_total} features show meaningful separation "
                "between churners and loyal customers. "
                "This suggests that the available features may not fully capture the reasons customers leave. "
                "Consider adding behavioural, engagement, or usage features if possible. "
                "Currently the most informative feature is **{top}**.")
SIG_WEAK_NOTE = (" Note: {n_weak} features appear to carry almost no predictive value — "
                 "they may be noise or irrelevant to churn in this dataset.")
SIG_ERR_NO_TARGET = "Target column not found."
SIG_ERR_ONE_CLASS = "Target column has only one class — cannot assess signal."
SIG_ERR_NO_FEATURES = "No features with sufficient data for signal assessment."
# profile
DROP_NULLS = "Too many missing values ({pct}% null)"
DROP_CONSTANT = "Constant column — carries no signal"
DROP_NEAR_CONSTANT = "Near-constant ({pct}% same value — carries no signal)"
DROP_IDENTIFIER = "Identifier column ({flags})"
DROP_IDENTIFIER_DEFAULT = "all-unique values"
DROP_HIGH_CARD = "High cardinality ({n} unique values — likely free-text or ID)"
DROP_EMPTY = "Empty column"
WARN_LEAK = "{column} — name suggests a post-churn event (data leakage risk)"
WARN_MISSING = "{column} has {pct}% missing values — will be imputed"
