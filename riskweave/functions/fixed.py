"""Fixed values of the domain: schemas, thresholds, code tables and texts.

Everything here is data, not logic.  The values are part of the contract (a
different threshold or label would be a different result), so they are stated
once, in the open, and every operator takes them as default arguments.
"""

from __future__ import annotations

# --- fixed values: schemas ---------------------------------------------------

COHORT_COLUMNS = [
    "age", "sex", "cp", "trestbps", "chol", "fbs", "restecg",
    "thalach", "exang", "oldpeak", "slope", "ca", "thal", "target",
]
FEATURE_COLUMNS = [c for c in COHORT_COLUMNS if c != "target"]
TARGET = "target"
SITE = "source_site"
SITES = ["cleveland", "hungarian", "switzerland", "va_long_beach"]
TRUSTED_SITE = "cleveland"

COMMON_COLUMNS = ["age", "sex", "sysBP", "totChol", "diabetes", "target"]
COMMON_FEATURES = [c for c in COMMON_COLUMNS if c != "target"]
COHORT_TO_COMMON = {"trestbps": "sysBP", "chol": "totChol", "fbs": "diabetes"}
EXTERNAL_TO_COMMON = {"male": "sex", "TenYearCHD": "target"}
EXTERNAL_COLUMNS = [
    "male", "age", "education", "currentSmoker", "cigsPerDay", "BPMeds",
    "prevalentStroke", "prevalentHyp", "diabetes", "totChol", "sysBP",
    "diaBP", "BMI", "heartRate", "glucose", "TenYearCHD",
]

MISSING_TOKEN = "?"
# a zero in these columns means "not measured", except at the trusted site
ZERO_IS_MISSING = ["chol", "trestbps", "thalach"]
ZERO_IS_MISSING_COMMON = ["sysBP", "totChol"]

# --- fixed values: column roles ----------------------------------------------

DECLARED_NUMERIC = ["age", "trestbps", "chol", "thalach", "oldpeak"]
DECLARED_CATEGORICAL = ["sex", "cp", "fbs", "restecg", "exang", "slope", "ca", "thal"]
ALWAYS_NUMERIC = ["age", "trestbps", "chol", "thalach", "oldpeak", "sysBP", "totChol"]

# --- fixed values: thresholds and labels -------------------------------------

DECISION_THRESHOLD = 0.5
RISK_LOW_BELOW, RISK_MODERATE_BELOW = 0.35, 0.65
RISK_LABELS = ["Low Risk", "Moderate Risk", "High Risk"]

AGREE_HIGH_BELOW, AGREE_MODERATE_BELOW = 0.05, 0.15
AGREE_LEVELS = ["high agreement", "moderate agreement", "low agreement"]
AGREE_NOTES = {
    "high agreement": " High consensus among base classifiers.",
    "moderate agreement": " Moderate variance among base classifiers.",
    "low agreement": " Interpret this prediction with extra caution.",
}

AGE_BAND_UPPER = [(49.99, "< 50"), (60.0, "50-60")]
AGE_BAND_LAST = "> 60"
SEX_LABELS = {0: "Female (0)", 1: "Male (1)"}
SEX_UNKNOWN = "Unknown"

OVERLAP_STRONG_FROM = 0.6
OVERLAP_LABELS = ["Strong Agreement", "Partial/Divergent Agreement"]
STABILITY_HIGH_FROM, STABILITY_MODERATE_FROM = 0.8, 0.6

CANDIDATE_RANGE = (0.51, 0.85)
CANDIDATE_COUNT = 4
CANDIDATE_FALLBACK_ROWS = 3

# --- fixed values: input form ------------------------------------------------

CODE_TABLE = {
    "sex": {"Female": 0.0, "Male": 1.0},
    "cp": {
        "Typical Angina (1)": 1.0, "Atypical Angina (2)": 2.0,
        "Non-Anginal Pain (3)": 3.0, "Asymptomatic (4)": 4.0,
    },
    "fbs": {"False (≤ 120 mg/dL)": 0.0, "True (> 120 mg/dL)": 1.0},
    "restecg": {
        "Normal (0)": 0.0, "ST-T Wave Abnormality (1)": 1.0,
        "Left Ventricular Hypertrophy (2)": 2.0,
    },
    "exang": {"No": 0.0, "Yes": 1.0},
    "slope": {"Upsloping (1)": 1.0, "Flat (2)": 2.0, "Downsloping (3)": 3.0},
    "ca": {"0 Vessels": 0.0, "1 Vessel": 1.0, "2 Vessels": 2.0, "3 Vessels": 3.0},
    "thal": {"Normal (3)": 3.0, "Fixed Defect (6)": 6.0, "Reversable Defect (7)": 7.0},
}
DOMAIN_BOUNDS = {
    "age": (20.0, 90.0), "trestbps": (80.0, 220.0), "chol": (100.0, 600.0),
    "thalach": (60.0, 220.0), "oldpeak": (0.0, 7.0),
}

# --- fixed values: learners and search spaces --------------------------------

BASE_MODELS = ["random_forest", "xgboost", "adaboost"]
ENSEMBLE = "ensemble"
ALL_MODELS = BASE_MODELS + [ENSEMBLE]
DISPLAY_NAMES = {
    "random_forest": "Random Forest", "xgboost": "XGBoost", "adaboost": "AdaBoost",
}
LEARNER_DEFAULTS = {
    "random_forest": {"n_estimators": 100, "max_depth": None},
    "xgboost": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1},
    "adaboost": {"n_estimators": 50, "learning_rate": 1.0},
}
# kind, then bounds (inclusive) or choices
SEARCH_SPACES = {
    "random_forest": {
        "n_estimators": ("int", 10, 200),
        "max_depth": ("int", 2, 20),
        "min_samples_split": ("int", 2, 10),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ("choice", "sqrt", "log2", None),
    },
    "xgboost": {
        "n_estimators": ("int", 10, 200),
        "max_depth": ("int", 1, 10),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "gamma": ("float", 0.0, 5.0),
    },
    "adaboost": {
        "n_estimators": ("int", 10, 200),
        "learning_rate": ("log", 0.01, 2.0),
    },
}
PLATT_C = 1e5

# --- fixed values: counterfactual grid ---------------------------------------

# direction of travel, clamp value, ratio applied to the original value
ACTIONABLE = {
    "chol": ("down", 100.0, 0.4),
    "trestbps": ("down", 90.0, 0.6),
    "thalach": ("up", 210.0, 1.5),
    "oldpeak": ("down", 0.0, 0.0),
}
ACTIONABLE_DEFAULT_RATIO = 0.5
SINGLE_STEPS = 50
DUAL_STEPS = 15

# --- fixed values: texts -----------------------------------------------------

ESTIMATE_DISCLAIMER = "This is a machine learning estimate, not a medical diagnosis."
WHAT_IF_DISCLAIMER = (
    "DISCLAIMER: These counterfactual statements are purely model-based 'what-if' "
    "sensitivity analyses computed for explainability purposes. They represent mathematical "
    "feature perturbations and do NOT constitute medical advice or clinical guidance."
)
SUBGROUP_CAVEAT = (
    "NOTE / CAVEAT: Subgroup and per-site sample sizes vary in size (e.g. small female or per-site cohorts) "
    "and disease prevalence (e.g. Switzerland disease prevalence is 92.7% while Cleveland is 45.9%). "
    "High Accuracy or Recall in high-prevalence cohorts can reflect positive-class prediction bias unless "
    "contextualized with Precision, Specificity, and F1-score. Subgroup breakdowns should be read as exploratory/indicative."
)

# --- fixed values: text formats ----------------------------------------------

# arguments: overlap in percent, tau; {folds} and {k} are filled in first
STABILITY_TEXTS = {
    "high": (
        "High Explanation Stability: Across the {folds} cross-validation folds, "
        "the Top-{k} SHAP features exhibit an average Overlap@{k} of %.1f%% "
        "(Kendall's tau: %.3f). The model consistently identifies the same key risk drivers "
        "regardless of train-test split variations."
    ),
    "moderate": (
        "Moderate Explanation Stability: Top-{k} SHAP features exhibit an average Overlap@{k} "
        "of %.1f%% across folds (Kendall's tau: %.3f). Core risk drivers remain "
        "largely stable, with minor re-ordering in secondary features across folds."
    ),
    "low": (
        "Low Explanation Stability: Top-{k} SHAP features exhibit an average Overlap@{k} "
        "of %.1f%% across folds (Kendall's tau: %.3f). Feature importance rankings "
        "shift substantially across training fold variations."
    ),
}
# arguments: feature, old and new value (twice for "dual"), old and new percent, threshold percent
WHAT_IF_TEXTS = {
    "single": (
        "Model-based what-if scenario: If this patient's %s were modified "
        "from %.1f to %.1f, with other factors unchanged, "
        "the model's predicted risk would drop from %.1f%% to %.1f%% "
        "(below the %.0f%% threshold)."
    ),
    "dual": (
        "Model-based what-if scenario: If this patient's %s were modified from "
        "%.1f to %.1f and %s were modified from %.1f to %.1f, with other factors unchanged, "
        "the model's predicted risk would drop from %.1f%% to %.1f%% "
        "(below the %.0f%% threshold)."
    ),
    "low": "Patient is already predicted as low-risk (predicted risk: %.1f%%).",
    "none": "No simple counterfactual modification in %s was sufficient to flip prediction below %.0f%%.",
}
WHAT_IF_ROW_HEAD = "PATIENT INDEX: %s"
WHAT_IF_RULE, WHAT_IF_ROW_RULE = "=" * 80, "-" * 80
IMPACT_TEXTS = ("increases risk", "decreases risk")
IMPACT_SUMMARY = "%s (%s, SHAP impact: %+.3f)"
REPORT_RULE, REPORT_LINE = "=" * 50, "-" * 50
REPORT_TEXTS = {
    "title": "     HEART DISEASE RISK ASSESSMENT SUMMARY       ",
    "probability": "Predicted Probability : %s (%.4f)",
    "category": "Risk Category         : %s",
    "consensus": "MODEL CONSENSUS & UNCERTAINTY:",
    "base": "  Base Classifiers:",
    "base_line": "    - %-15s: %.1f%%",
    "features": "TOP CONTRIBUTING FEATURES (SHAP Explanation):",
    "feature_line": "  %d. %s",
    "no_features": "  N/A",
}
