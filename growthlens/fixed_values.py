"""Fixed values, in one place.

Part 1 are the values the analytics must share with the reference for equal
results (wording, labels, thresholds, defaults). Part 2 is the binding of the
driver fixtures onto the analytic model (our choice, see sources/views.py).
"""

# ---- Part 1: fixed values that must equal the reference's ----------------

# Order statuses of the analytic model.
DELIVERED = "delivered"
CANCELLED = "cancelled"

# Significance level and verdict wording of the chi-square test family.
ALPHA = 0.05
RAW_SIGNIFICANT = "significant"
NOT_SIGNIFICANT = "not significant"
STILL_SIGNIFICANT = "still significant"

# Pareto split: number of tiles, size of the power-user list, segment labels.
N_TILES = 20
POWER_USER_LIMIT = 20
TOP_SEGMENT = "Top 5% (power users)"
REST_SEGMENT = "Remaining 95%"

# Top restaurants per city, and the drill-down list length.
TOP_N_PER_CITY = 3
TOP_K_IN_CITY = 10

# Retention horizons (calendar months after signup) and days per month.
RETENTION_HORIZONS = (1, 2, 3)
DAYS_PER_MONTH = 30.44

# Repeat purchase: delivered orders needed to count as reordered.
REORDER_MIN_COUNT = 2

# Power analysis: lifts in percentage points and the default power.
SAMPLE_SIZE_LIFTS_PP = (3.0, 6.0, 10.0)
SAMPLE_SIZE_POWER = 0.8

# Ad-hoc SQL row cap.
ROW_LIMIT = 500

# The analytic model's own tables (users, orders, restaurants, app_events):
# funnel steps in order, and first-delivery-time buckets in minutes.
MODEL_FUNNEL_STEPS = ("app_open", "search", "restaurant_view", "add_to_cart", "checkout",
                      "order_placed")
DELIVERY_TIME_SPLITS = (30.0, 45.0, 60.0)
DELIVERY_TIME_LABELS = ("1: <30 min", "2: 30-44 min", "3: 45-59 min", "4: 60+ min")

# ---- Part 2: binding of the driver fixtures --------------------------------

FIXTURE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)
DELIVERED_CODE = "F"
CANCELLED_CODE = "P"
FUNNEL_STEPS = ("view", "click", "signup", "purchase")
PLATFORMS = ("iOS", "Android", "Web")
ENTITY = ("user_id", "day")          # funnel entity: a user-day
FIRST_ORDER_SPLITS = (125000.0, 250000.0, 375000.0)
FIRST_ORDER_LABELS = ("1: <125k", "2: 125k-250k", "3: 250k-375k", "4: 375k+")
