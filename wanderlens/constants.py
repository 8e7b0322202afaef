"""Fixed values of the province report: codes, hub positions, thresholds, word lists."""

# The 30 home-province codes, in report order. Every other code is "else".
PROVINCES = [
    301, 303, 331, 311, 308, 325, 305, 318, 310, 328,
    313, 322, 319, 323, 304, 315, 329, 306, 302, 324,
    312, 321, 320, 307, 316, 314, 326, 317, 330, 300,
]

# Fixed values: (lng, lat) of the transport hubs, by mode code.
PORT, AIRPORT, RAILWAY, UNKNOWN_MODE = 0, 1, 2, 3
HUBS = {
    PORT: [(110.293096, 20.026518), (110.165718, 20.04586)],
    AIRPORT: [(110.466232, 19.945878), (109.414883, 18.313457)],
    RAILWAY: [(110.168949, 20.033696), (109.499415, 18.302055)],
}
HUB_KM = 10.0

# Earth radius, the duty-free spot, stay bands of the route report (days).
EARTH_RADIUS_KM = 6371.004
DUTY_FREE_SPOT = 19
ROUTE_BANDS = {"short": (3, 5), "long": (6, 10), "deep": (11, 15)}
ROUTE_SUPPORT = 0.001

# POI tags and hotel labels. A label applies when the name holds one of its words.
HOTEL_TAG = "酒店"
SHOPPING_TAG = "购物"
OTHER_TAG = "其他"
FAMILY_INN = "家庭旅馆"
STAR_HOTEL, BUDGET_HOTEL, APARTMENT_HOTEL = "星级酒店", "快捷酒店", "公寓式酒店"
RESTAURANT_TAG, SIGHT_TAG = "美食", "旅游景点"
#: The eight classes of a POI vector.
POI_CLASSES = [
    "star_hotel", "budget_hotel", "apartment_hotel", "other_hotel", "shopping", "restaurant", "sight", "other",
]
HOTEL_NAME_LABELS = [
    ("1", ["快捷"]),
    ("2", ["公寓"]),
    ("3", ["家庭旅馆"]),
    ("4", ["客栈", "民宿"]),
    ("5", ["青年"]),
    ("6", ["商务"]),
    ("7", ["招待所"]),
    ("8", ["温泉"]),
    ("9", ["海景", "海滨"]),
    ("10", ["情侣"]),
    ("11", ["出租", "住宿", "短租"]),
    ("12", ["别墅", "公馆", "山庄"]),
]
NO_LABEL = "none"
