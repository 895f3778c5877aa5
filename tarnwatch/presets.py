"""The telecom-customer table: its contract, its request contract and its feature recipe."""

from __future__ import annotations

from tarnwatch.operators.contract import (
    Contract,
    between,
    blank_or_decimal_text,
    implies,
    one_of,
    text_length,
)
from tarnwatch.operators.features import FeatureRecipe

# --- fixed values: columns, domains, edges and names of the public data set ---
YES_NO = ("Yes", "No")
INTERNET_ADDONS = (
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
)
DOMAINS = {
    "gender": ("Female", "Male"),
    "SeniorCitizen": (0, 1),
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": ("Yes", "No", "No phone service"),
    "InternetService": ("DSL", "Fiber optic", "No"),
    **{c: ("Yes", "No", "No internet service") for c in INTERNET_ADDONS},
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaperlessBilling": YES_NO,
    "PaymentMethod": (
        "Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)",
    ),
    "Churn": YES_NO,
}
TRAINING_COLUMNS = (
    "id", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService", "MultipleLines",
    "InternetService", *INTERNET_ADDONS, "Contract", "PaperlessBilling", "PaymentMethod", "MonthlyCharges",
    "TotalCharges", "Churn",
)
REQUEST_TO_TRAINING_NAMES = {
    "customer_id": "customerID", "gender": "gender", "senior_citizen": "SeniorCitizen", "partner": "Partner",
    "dependents": "Dependents", "tenure": "tenure", "phone_service": "PhoneService",
    "multiple_lines": "MultipleLines", "internet_service": "InternetService", "online_security": "OnlineSecurity",
    "online_backup": "OnlineBackup", "device_protection": "DeviceProtection", "tech_support": "TechSupport",
    "streaming_tv": "StreamingTV", "streaming_movies": "StreamingMovies", "contract": "Contract",
    "paperless_billing": "PaperlessBilling", "payment_method": "PaymentMethod",
    "monthly_charges": "MonthlyCharges", "total_charges": "TotalCharges",
}
TENURE_EDGES = (0, 2, 18, 44, 72)
TENURE_LABELS = ("G1_0_2", "G2_2_18", "G3_18_44", "G4_44_72")
AUTO_PAYMENT = ("Bank transfer (automatic)", "Credit card (automatic)")
TENURE_REPORT_UPPERS = (12, 24, 48)
TENURE_REPORT_LABELS = ("0-11", "12-23", "24-47", "48-72")
CHARGE_REPORT_UPPERS = (35, 70, 100)
CHARGE_REPORT_LABELS = ("0-34.99", "35-69.99", "70-99.99", "100+")
# -------------------------------------------------------------------------------


def _no_internet(names) -> str:
    return " AND ".join(f"`{c}` = 'No internet service'" for c in names)


TRAINING_CONTRACT = Contract(
    version="training/v1",
    columns=TRAINING_COLUMNS,
    types={"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"},
    unique=(("id",),),
    rules=(
        *[one_of(c, values) for c, values in DOMAINS.items()],
        between("tenure", 0, 72),
        between("MonthlyCharges", 0),
        blank_or_decimal_text("TotalCharges"),
        implies("phone", "PhoneService = 'No'", "MultipleLines = 'No phone service'"),
        implies("internet", "InternetService = 'No'", _no_internet(INTERNET_ADDONS)),
        implies("blank_total", "trim(TotalCharges) = ''", "tenure = 0"),
    ),
)

_TO_REQUEST = {v: k for k, v in REQUEST_TO_TRAINING_NAMES.items()}
REQUEST_CONTRACT = Contract(
    version="request/v1",
    columns=tuple(REQUEST_TO_TRAINING_NAMES),
    rules=(
        text_length("customer_id", 1, 128),
        *[one_of(_TO_REQUEST[c], values) for c, values in DOMAINS.items() if c in _TO_REQUEST],
        between("tenure", 0, 72),
        between("monthly_charges", 0, 1000),
        between("total_charges", 0, 100000),
        implies("phone", "phone_service = 'No'", "multiple_lines = 'No phone service'"),
        implies("internet", "internet_service = 'No'", _no_internet(_TO_REQUEST[c] for c in INTERNET_ADDONS)),
    ),
)

FEATURE_RECIPE = FeatureRecipe(
    text_total="TotalCharges", rate="MonthlyCharges", duration="tenure",
    duration_edges=TENURE_EDGES, duration_labels=TENURE_LABELS, duration_group="tenure_group",
    membership={"is_auto_payment": ("PaymentMethod", AUTO_PAYMENT)},
    counted=INTERNET_ADDONS,
    drop=("customerID", "id", "gender", "TotalCharges"),
    maps={
        **{c: {"Yes": 1, "No": 0, "No internet service": -1, "No phone service": -1}
           for c in (*INTERNET_ADDONS, "MultipleLines")},
        **{c: {"Yes": 1, "No": 0} for c in ("Partner", "Dependents", "PhoneService", "PaperlessBilling")},
    },
    encode=("Contract", "InternetService", "PaymentMethod", "tenure_group"),
    scale=("tenure", "MonthlyCharges", "tc_residual", "monthly_to_total_ratio"),
)
