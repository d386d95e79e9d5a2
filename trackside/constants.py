"""Fixed values that decide results."""

# Tyre compound codes; anything else counts as DEFAULT_COMPOUND_CODE.
COMPOUND_CODES = {"SOFT": 1, "MEDIUM": 2, "HARD": 3, "INTERMEDIATE": 4, "WET": 5}
DEFAULT_COMPOUND_CODE = 2

# Seconds added per compound (exact upper-case names only).
COMPOUND_PENALTIES = {"MEDIUM": 0.8, "HARD": 1.8, "INTERMEDIATE": 5.0, "WET": 5.0}

# Base lap seconds per session.
BASE_LAP_SECONDS = {10014: 92.0, 9979: 76.0, 9693: 84.0}
DEFAULT_BASE_LAP_SECONDS = 85.0

# Lap baseline coefficients.
WEAR_SECONDS_PER_LAP = 0.12
REFERENCE_SPEED = 330.0
SECONDS_PER_SPEED_UNIT = 0.05

# Stint repair.
OPEN_STINT_LAPS = 10
INVERTED_STINT_LAPS = 5

# Telemetry thresholds and limits.
FULL_THROTTLE = 90
HEAVY_BRAKE = 50
GEAR_RANGE = (-1, 8)
MOVING_SPEED = 100
SPEED_RANGE = (0, 380)
RPM_RANGE = (0, 16000)
MEAN_LAP_RANGE = (50.0, 250.0)
YEAR_RANGE = (2000, 2100)

# Served result sizes.
TELEMETRY_POINTS = 1000
TRAJECTORY_POINTS = 1500
TELEMETRY_HEAD_ROWS = 500
GAP_ROWS = 15

# Text search.
MIN_RELEVANCE = 0.02
EVENT_WINDOW_SECONDS = 15

# Default focus drivers.
FOCUS_DRIVERS = {
    1: "Max Verstappen",
    4: "Lando Norris",
    16: "Charles Leclerc",
    44: "Lewis Hamilton",
    63: "George Russell",
    81: "Oscar Piastri",
}

# Season without data and the season read instead.
SEASON_FALLBACK = {2025: 2024}

# Regressor inputs, label and size.
LAP_FEATURES = [
    "throttle_intensity_pct",
    "brake_intensity_pct",
    "tyre_age_at_start",
    "compound_num",
    "max_speed",
]
LAP_LABEL = "lap_duration_seconds"
FOREST_TREES = 50
FOREST_SEED = 42
MIN_TRAINING_ROWS = 5

# Failed conclusions of a CI run and keywords per failure category.
FAILED_CONCLUSIONS = ["failure", "timed_out", "cancelled"]
FAILURE_KEYWORDS = {
    "format": ["black", "format", "isort"],
    "lint": ["flake8", "lint", "static"],
    "test": ["pytest", "test"],
}
