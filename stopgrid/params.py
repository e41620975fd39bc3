"""Fixed values that results depend on."""

# By mode 0 to 7.
MODE_NAMES = ("city bus", "metro", "ferry", "intercity bus", "rail", "airport bus", "high-speed rail", "air")
SPEED_KMH = (20.0, 33.0, 45.0, 65.0, 75.0, 45.0, 170.0, 450.0)
DETOUR = (1.30, 1.10, 1.05, 1.25, 1.15, 1.25, 1.10, 1.00)
DWELL_MIN = (0.4, 0.5, 5.0, 3.0, 1.5, 1.0, 2.0, 40.0)
LONG_DISTANCE = (2, 3, 4, 5, 6, 7)
FERRY = 2

# Mode by standard and extended route type; any other is 0.
ROUTE_TYPE_MODE = {
    0: 1, 1: 1, 2: 4, 3: 0, 4: 2, 5: 1, 6: 1, 7: 1, 11: 0, 12: 1, 101: 6, 102: 4, 103: 4, 106: 4, 109: 4, 200: 3, 201: 3, 202: 3, 204: 3, 205: 5,
    400: 1, 401: 1, 402: 1, 405: 1, 700: 0, 701: 0, 702: 0, 704: 0, 715: 0, 1000: 2, 1100: 7, 1200: 2,
}

# Service, walking, merging, simulation.
SERVICE_MIN = 17 * 60.0
WAIT_CAP = 30.0
WALK_KMH, WALK_DETOUR = 4.5, 1.25
WALK_M, GROUP_M, STRANDED_M, FACILITY_M = 400.0, 100.0, 800.0, 500.0
SAME_NAME_OVERLAP, ANY_NAME_JACCARD = 0.5, 0.95
ACCESS_MIN, ACCESS_ORIGINS, ACCESS_LEAST_INCREASE = 60.0, 3, 0.05
OD_LIMIT_FACTOR, OD_LIMIT_MORE = 2.0, 10.0
WALK_FULL_MIN, HUB_LINES = 12.0, 30
DIRECT_MIN, SEGMENT_MORE_MIN, DETOUR_FULL_MIN = 5.0, 60.0, 30.0
JOURNEY_MIN, RESILIENCE_MIN = 600.0, 240.0
SENIOR_REGION, ISOLATES, DELAYS = 40.0, 0.3, 0.2
ISLAND_GROUPS, ISLAND_PEOPLE = 3_000, 150_000.0
OD_FRACTIONS = (0.0, 0.25, 0.5, 0.75, 1.0)
GRADE_QUANTILES = (0.5, 0.8, 0.95)
GRADES = ("stable", "caution", "vulnerable", "very vulnerable")
LINE_WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.15)
STOP_WEIGHTS = (0.30, 0.25, 0.15, 0.15, 0.15)
SEGMENT_WEIGHTS = (0.45, 0.25, 0.30)

# Policies and their costs.
FREQUENCIES = (1.5, 2.0)
POLICY_TARGETS, POLICY_REACH_MIN, POLICY_SLOWER, POLICY_DETOUR = 30, 120.0, 1.3, 1.3
DRT_SPEED, EXTENSION_SPEED = 25.0, 20.0
TRAIN_SHARE, SHORTLIST_SHARE, VALIDATION_SHARE, SHORTLIST_LEAST = 0.10, 0.10, 0.05, 0.05
DRT_KM, DRT_WAIT, EXTENSION_KM = (3.0, 5.0, 8.0), (10.0, 15.0, 20.0), (2.0, 4.0)
BUDGETS = (20, 50, 100, 200, 500)
BUS_YEAR, DRT_YEAR = 287_796_660.0, 203_808_700.0
BENEFIT_TIME_WEIGHT = 0.5
# Carbon; shares of public transport by kind of region: capital, metropolitan, other.
TRIPS_A_DAY, RETURN_SHARE, TRANSIT_SHARE, CARBON_DAYS = 0.788, 0.414, (0.393, 0.181, 0.142), 365

# Geography.
EARTH_M, DEGREE_M, LATITUDE = 6_371_000.0, 111_320.0, 36.2
GRID_DEGREES, GRID_LON, GRID_LAT = 0.05, 124.0, 33.0
BBOX = (124.0, 132.5, 32.5, 39.5)

# Short names of provinces.
SIDO_SHORT = {
    "서울특별시": "서울", "부산광역시": "부산", "대구광역시": "대구", "인천광역시": "인천", "광주광역시": "광주", "대전광역시": "대전",
    "울산광역시": "울산", "세종특별자치시": "세종", "경기도": "경기", "강원특별자치도": "강원", "충청북도": "충북", "충청남도": "충남",
    "전북특별자치도": "전북", "전라남도": "전남", "경상북도": "경북", "경상남도": "경남", "제주특별자치도": "제주", "전남광주통합특별시": "전남광주",
}

# Patterns of names.
ARROWS = r"(?:↔|<->|->|→|~|-|－|>|<)"
NAME_MARKS = r"[\s()\[\]·.\-_,/]"
SPLIT_MARKS, SPLIT_END = r"[\d.·]+|동$", "동"

# Patterns of columns and kinds in external tables.
FACILITY_COLUMNS = {"name": r"기관명|yadmnm|name", "kind": r"종별|종류|clcdnm|kind", "lon": r"좌표\s*\(?\s*x|xpos|lon|경도|^x$", "lat": r"좌표\s*\(?\s*y|ypos|lat|위도|^y$"}
EXCLUDED_KINDS, PHARMACY = "치과|한의|한방", "약국"
METRO_CITIES = ("부산", "대구", "인천", "대전", "울산")
CAPITAL, COUNTRY, JOINT = "서울", "전국", "전남광주"
DOMESTIC_MAKERS = ("현대", "기아", "제네시스", "르노", "쉐보레", "한국지엠", "케이지모빌리티", "쌍용")
USAGE_MIDS = (4.5, 8.0, 13.0, 18.0, 23.0)

# The share that makes a cluster one of ferries or long distances; what trips weigh against isolation.
TYPE_SHARE, RURAL_TRIPS = 0.4, 0.06
