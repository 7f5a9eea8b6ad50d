"""Rows that several tests share: rides of a small bicycle rental and the takings of a kiosk."""

# Rides of a small bicycle rental; the tests work expected totals out from these rows.
RIDE_COLUMNS = ("ride_no", "ride_day", "rider_mail", "station", "bike", "fee", "km", "subscribed")
RIDES = [
    (7, "2025-03-10", "lena@post.test", "Harbour", "cargo", 12.40, 9, "false"),
    (8, "2025-03-10", "otto@post.test", "Old Town", "city", 3.15, 4, "true"),
    (9, "2025-03-11", "mira@post.test", "Harbour", "city", 3.95, 4, "true"),
    (10, "2025-03-11", "", "Museum", "tandem", 18.20, 14, "false"),
    (11, "2025-03-12", "ivan@post.test", "Campus", "city", 2.60, 3, "true"),
    (12, "2025-03-13", "nora@post.test", "Museum", "cargo", 9.85, 9, "true"),
    (13, "2025-03-13", "emil@post.test", "Old Town", "tandem", 15.05, 11, "false"),
    (14, "2025-03-14", "ruth@post.test", "Campus", "cargo", 7.70, 4, "true"),
    (15, "2025-03-14", "paul@post.test", "Museum", "city", 4.45, 3, "false"),
    (16, "2025-03-15", "anna@post.test", "Harbour", "cargo", 11.30, 9, "true"),
]
MECHANICS = [
    {"mechanic_id": "M1", "name": "Greta Holm", "shift": "early", "error_rate": 0.031, "certified": True},
    {"mechanic_id": "M2", "name": "Tomas Vik", "shift": "late", "error_rate": 0.054, "certified": False},
    {"mechanic_id": "M3", "name": "Ida Lund", "shift": "early", "error_rate": 0.012, "certified": True},
]

#: What the kiosk's takings are made of: a base, so much a guest, a loss on rainy days, and an offset per counter.
TAKINGS = {"base": 40.0, "guests": 3.5, "rain": -60.0, "counter": {"left": 0.0, "middle": 25.0, "right": -15.0}}


def takings(counter: str, guests: int, rain: int) -> float:
    return TAKINGS["base"] + TAKINGS["guests"] * guests + TAKINGS["rain"] * rain + TAKINGS["counter"][counter]
