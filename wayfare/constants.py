"""Fixed values that define the semantics (defaults of keyword parameters)."""

from __future__ import annotations

DAY_SECONDS = 86_400
DAY_US = DAY_SECONDS * 1_000_000

SUCCESS_STATE = 28
FAILURE_STATE = -1
SUCCESS_EVENT = "order_shipped"
START_STATE = -999

HORIZON_DAYS = 60
HORIZON_SECONDS = HORIZON_DAYS * DAY_SECONDS
TIMEOUT_SECONDS = 5_184_000

TOP_N_ACTIONS = 20
TOP_N_EVENTS = 50
MAX_SAMPLES_PER_JOURNEY = 60

# States that count as customer actions; anything else is a company or system event.
CUSTOMER_STATES = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 18, 19, 22, 23, 25)

# Funnel milestones: flag column -> event id.
MILESTONES = {
    "has_add_to_cart": 11,
    "has_begin_checkout": 6,
    "has_application_submit": 3,
    "has_place_downpayment": 7,
    "has_place_order": 8,
    "has_account_activation": 29,
}

TRAIN_PREVALENCE = 0.2194
TEST_PREVALENCE = 0.05018

STRATIFIED_EDGES_SECONDS = (86_400, 604_800)
PIECEWISE_EDGES_SECONDS = (86_400, 604_800, 2_592_000, 5_184_000)
MIN_BIN_TRANSITIONS = 200
MIN_STATE_TRANSITIONS = 20
MIN_EXPOSURE_SECONDS = 3_600
MIN_TIME_SECONDS = 1e-9

# Trailing windows of the snapshot features, in days.
RECENT_WINDOWS_DAYS = (1, 3, 7, 14, 30)
