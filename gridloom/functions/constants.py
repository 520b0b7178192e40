"""Numbers, word lists and patterns that results depend on. They are stated, not derived."""

from __future__ import annotations

# --- fixed values: criteria, pairwise judgements and the random index of consistency
CRITERIA = ("flood", "landslide", "exposure", "fire")
PAIRWISE = ((1.0, 1.5, 1.5, 2.0), (1 / 1.5, 1.0, 2.0, 2.0), (1 / 1.5, 1 / 2.0, 1.0, 1.5), (1 / 2.0, 1 / 2.0, 1 / 1.5, 1.0))
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45}
MAX_CONSISTENCY_RATIO = 0.10
WEIGHT_FLOOR = 1e-6
CLASS_NAMES = ("Very Low", "Low", "Moderate", "High", "Very High")
CLASS_COLOURS = ((26, 152, 80), (166, 217, 106), (253, 174, 97), (227, 74, 51), (127, 0, 0))

# --- fixed values: landslide factors, lower class edges with their ratings, and factor weights
FACTORS = {
    "slope": ((5, 15, 25, 35, 45), (0.15, 0.50, 1.10, 1.90, 2.40, 1.80)),
    "elevation": ((300, 700, 1100, 1500, 2000), (0.30, 0.80, 1.40, 1.70, 1.20, 0.60)),
    "ndvi": ((0.2, 0.4, 0.6, 0.8), (2.00, 1.60, 1.10, 0.80, 0.50)),
    "rainfall": ((2000, 2500, 3000, 3500), (0.50, 0.90, 1.30, 1.70, 2.10)),
}
FACTOR_WEIGHTS = {"slope": 0.40, "rainfall": 0.25, "ndvi": 0.20, "elevation": 0.15}
CLOUD_CLASSES = (3, 8, 9, 10, 11)

# --- fixed values: flood, fire and exposure layers
FLOOD_PERMANENT_OCCURRENCE, FLOOD_ZONE_OCCURRENCE, FLOOD_MAX_SLOPE_DEG = 50, 5, 5.0
NDVI_FILL, MONSOON_MONTHS = 0.60, (6, 9)
LEAST_PAIRS, PASS_CLASSES, PASS_SHARE = 5, (4, 5), 0.50
FLOOD_FALLBACK_DB, FLOOD_RANGE_DB, FLOOD_PARTS = -16.0, (-22.0, -13.0), (0.7, 0.3)
FIRE_CONFIDENCE, FIRE_MASK, FIRE_VEGETATION = 30, 7, (0.2, 0.8)
EXPOSURE_PARTS, ROAD_LIMIT_M = (0.7, 0.3), 1500.0

# --- fixed values: roads and routing
NOT_DRIVABLE = (
    "cycleway", "footway", "path", "pedestrian", "steps", "track", "corridor", "elevator", "escalator", "proposed", "construction", "bridleway", "abandoned",
    "platform", "raceway", "bus_guideway", "razed", "planned", "no", "rest_area", "services",
)
NOT_DRIVABLE_SERVICE = ("alley", "driveway", "emergency_access", "parking", "parking_aisle", "private")
ROAD_RANK = {"motorway": 0, "trunk": 0, "primary": 0, "secondary": 1, "tertiary": 2, "unclassified": 3, "residential": 3, "living_street": 3, "service": 4, "road": 4}
ONEWAY_FORWARD, ONEWAY_BACKWARD = ("yes", "true", "1"), ("-1", "reverse")
CLIP_MARGIN_DEG, DISPLAY_SIMPLIFY_DEG, DISPLAY_CLASSES = 0.01, 0.0002, ("motorway", "trunk", "primary", "secondary", "tertiary")
MERGE_CLASSES, MERGE_SIMPLIFY_M, MERGE_VERTICES, MERGE_DOUBLINGS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential"), 25.0, 60_000, 5
ALPHA, SAMPLE_STEP_M, SNAP_LIMIT_M, PLACE_LIMIT_M, SEPARATION_M = 3.0, 50.0, 2500.0, 4000.0, 3000.0
SETTLEMENT_THRESHOLDS = (0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10)

# --- fixed values: facility categories, first match wins: name, whether unnamed ones are dropped, tag rules
FACILITIES = (
    ("health", False, {"amenity": ("hospital", "clinic", "doctors", "dentist", "pharmacy"), "healthcare": ("hospital", "clinic", "centre", "doctor", "pharmacy", "alternative", "yes")}),
    ("emergency", False, {"amenity": ("police", "fire_station", "ambulance_station"), "emergency": ("ambulance_station", "assembly_point")}),
    ("shelter", True, {"amenity": ("community_centre", "shelter"), "emergency": ("shelter",)}),
    ("education", True, {"amenity": ("school", "college", "university")}),
    ("government", True, {"amenity": ("townhall", "courthouse", "post_office"), "office": ("government",)}),
    ("finance", False, {"amenity": ("bank", "atm")}),
    ("fuel", False, {"amenity": ("fuel",)}),
    ("transport", False, {"amenity": ("bus_station",)}),
    ("market", True, {"amenity": ("marketplace",), "shop": ("supermarket", "mall", "department_store")}),
    ("worship", True, {"amenity": ("place_of_worship", "monastery")}),
    ("tourism", True, {"tourism": ("attraction", "viewpoint", "museum", "zoo", "hotel", "guest_house", "resort", "camp_site")}),
)
PLACE_TAGS = ("city", "town", "village", "hamlet", "suburb", "neighbourhood", "locality", "quarter")
SHELTER_EXCLUDED = ("public_transport", "bus_stop", "picnic_shelter", "weather_shelter", "basic_hut", "lean_to")
HOSPITAL_EXCLUDED = r"dental|dentist|pharmac|laborator|diagnos|optical|physio|scan cent|medical store|ayurved|homoeo|homeo|unani|early intervention|primary health|veterinary"
HOSPITAL_MAJOR = r"taluk|district|general hospital|medical college|medical (centre|center|institute|trust)|institute of medical|government hospital|govt\.? hospital|referral|co-?operative hospital"
HOSPITAL_LEAST_MAJOR = 5
SCHOOL_SHELTER = r"higher secondary|hss|ghss|high school|hs|ghs|college|public school|vidyalaya|residential"
# --- fixed values: tags that name a facility's kind, in order of preference; two numbers as coordinates
SUB_TYPE_TAGS = ("amenity", "healthcare", "tourism", "shop", "office", "emergency")
TWO_NUMBERS = r"^\s*(-?\d+(?:\.\d+)?)\s*[,;\s]\s*(-?\d+(?:\.\d+)?)\s*$"
LAT_RANGE, LON_RANGE = (5, 20), (70, 82)
