"""Fixed values.

Everything in this file is data that has to equal the published catalogue, dictionaries and
message texts for results to match: word lists, codes, lookup tables and defaults.  No logic.
"""

# --- Defaults of the jobs (all are parameters of the public functions) ---------------------

DEFAULT_MATERIAL = "оцинкованная"
DEFAULT_THICKNESS = 0.8
DEFAULT_ROUND_ARTICLE = "1-1-2"
DEFAULT_RECT_ARTICLE = "1-2-1"
DEFAULT_ROUND_LENGTH_MM = 3000.0
DEFAULT_RECT_LENGTH_MM = 1250.0
DEFAULT_ADAPTER_L1_MM = 50.0
DEFAULT_MIN_OFFERS = 3
DEFAULT_MAX_AGE_DAYS = 7
DEFAULT_XML_THICKNESS = "0.7"

# --- Units -----------------------------------------------------------------------------------

PIECE_UNITS = ["шт", "штук", "pcs", "pc", "шт."]
METRE_UNITS = ["м", "m", "метр", "mtr"]
AREA_UNITS = ["м2", "м²", "кв.м", "кв м"]
CANONICAL_UNITS = {
    "м²": ["м2", "м²", "квм", "m2"],
    "шт": ["шт", "штк", "pcs", "pc"],
    "м": ["м", "m", "метр", "mtr"],
}

# --- Header keywords: target column -> substrings, in priority order -------------------------

HEADER_KEYWORDS = {
    "name": ["наименование", "изделие", "описание", "позиция", "продукт"],
    "size": ["размер", "сечение", "диаметр", "габарит", "типоразмер"],
    "unit": ["ед.изм", "единица", "ед", "unit", "изм"],
    "quantity": ["количество", "кол-во", "qty", "кол"],
    "material": ["материал", "сталь", "мат"],
    "thickness": ["толщина", "толщ", "мм"],
}

PROJECT_SHEET_MARKERS = [
    "наименование и техническая характеристика",
    "тип, марка, обозначение документа",
]

# --- Product types: (literal that must occur, pattern, type), first match wins ----------------

AGGREGATE_FITTINGS_PATTERN = r"фасонные\s+изделия"
PRODUCT_TYPES = [
    ("отвод", r"\bотвод\b", "elbow"),
    ("переход", r"\bпереход\b", "transition"),
    ("тройник", r"\bтройник\b", "tee"),
    ("крестовина", r"\bкрестовина\b", "cross"),
    ("заглушка", r"\bзаглушка\b", "cap"),
    ("врезка", r"\bврезка\b", "saddle"),
    ("утка", r"\bутка\b", "offset"),
    ("зонт", r"\bзонт\b", "roof_cap"),
    ("пленум", r"\bпленум\b", "plenum"),
    ("фланец", r"\bфланец\b", "flange"),
    ("ниппель", r"\bниппель\b", "nipple"),
    ("бандаж", r"\bбандаж\b", "band"),
    ("диффузор", r"\bдиффузор\b", "diffuser"),
    ("ксд", r"\bксд\b", "ksd"),
    ("решетка", r"\bрешетка\b", "grille"),
    ("шумоглушител", r"\bшумоглушител", "silencer"),
    ("клапан", r"\bклапан\b", "damper"),
    ("шибер", r"\bшибер\b", "shutter"),
    ("фильтр", r"\bфильтр\b", "filter"),
    ("дроссель", r"\bдроссель\b", "throttle"),
    ("стакан", r"\bстакан\b", "mounting_cup"),
    ("вентилятор", r"\bвентилятор\b", "fan"),
    ("воздуховод", r"воздуховод", "duct"),
]

RECTANGULAR_PRODUCT_WORDS = [
    "воздуховод", "отвод", "переход", "тройник", "врезка", "заглушка",
    "крестовина", "фланец", "утка", "диффузор", "решетка", "шумоглушител",
]

# Types whose lines are bought in, so they go to the price search.
RESOLD_TYPES = [
    "diffuser", "ksd", "grille", "silencer", "damper",
    "shutter", "filter", "throttle", "roof_cap", "fan",
]

# --- Skip reasons ------------------------------------------------------------------------------

REASON_AGGREGATE = (
    "Агрегатная строка фасонных изделий без детализации "
    "(требуется список: отводы, переходы, тройники и т.д.)"
)
REASON_DIFFUSER = (
    "Диффузор без артикула в каталоге асПродукция (нужна ручная загрузка или доработка 1С)"
)
REASON_EQUIPMENT_SUFFIX = ": оборудование/арматура — требуется проверка наличия артикула"
REASON_EQUIPMENT_TYPES = ["shutter", "filter", "grille", "roof_cap"]
REASON_NO_SIZE = "Отсутствует размер"
REASON_AREA_UNIT = "Единица м² — агрегатная площадь, нельзя разбить на позиции без детализации"
REASON_UNKNOWN = "Не удалось распознать размер / тип"
REASON_QUANTITY_PREFIX = "Не удалось распознать количество: "
REASON_NOT_ALLOWED = ("Артикул ", " не входит в разрешённый список производимой номенклатуры")
REASON_NOT_MADE = ("Оборудование не производится (", ")")
REASON_NO_CATEGORY = "Не удалось распознать категорию"
REASON_CATEGORY_NO_ARTICLE = ("Для категории ", " не назначен артикул в 1С")
REASON_CATEGORY_NO_DIMS = "Не удалось извлечь размеры для категории "
REASON_SECTION_NO_ARTICLE = "Нет артикула для категории "

# --- Model codes whose size is not spelled out: code -> (A0, B0) -------------------------------

MODEL_CODE_SIZES = {
    "40-20": (400, 200),
    "50-25": (500, 250),
    "50-30": (500, 300),
    "60-30": (600, 300),
    "60-35": (600, 350),
    "70-40": (700, 400),
    "80-50": (800, 500),
    "90-50": (900, 500),
    "100-50": (1000, 500),
}
MODEL_CODE_LENGTHS = {"NKD": 1100, "NKK": 510}

# --- Connection names per section ---------------------------------------------------------------

ROUND_CONNECTIONS = {
    "бандаж": "1",
    "без соединения": "2",
    "без соед": "2",
    "без": "2",
    "б/с": "2",
    "ниппель": "3",
    "фланец круглый": "4",
    "фланец кр": "4",
    "фланец (кр)": "4",
    "фланец": "4",
}
RECT_CONNECTIONS = {
    "фланец прямоугольный": "5",
    "фланец пр": "5",
    "фланец (пр)": "5",
    "фланец": "5",
    "шина уголок": "6",
    "шина / уголок": "6",
    "шина": "6",
    "уголок": "6",
    "рейка": "7",
    "без соединения": "8",
    "без соед": "8",
    "без": "8",
    "б/с": "8",
}

# --- Parameter names -----------------------------------------------------------------------------

PARAM_NAMES = [
    "D0", "D1", "D2", "D3", "A0", "A1", "A2", "A3", "B0", "B1", "B2", "B3",
    "L0", "L1", "L2", "L3", "P0", "P1", "P2", "P3", "U0", "R0", "Z",
]
PADDED_PARAMS = [p for p in PARAM_NAMES if p[0] in "DABLP"]
INTEGER_PARAMS = ["U0", "R0", "Z"]

# Designation variables -> parameter names.
DESIGNATION_VARIABLES = {
    "D_": "D0", "d1_": "D1", "d2_": "D2", "d3_": "D3", "d4_": "D4",
    "D1_": "D1", "D2_": "D2",
    "A_": "A0", "a1_": "A1", "a2_": "A2", "a3_": "A3", "a4_": "A4", "a5_": "A5",
    "B_": "B0", "b1_": "B1", "b2_": "B2", "b3_": "B3", "b4_": "B4", "b5_": "B5",
    "L_": "L0", "l1_": "L1", "l2_": "L2", "l3_": "L3", "l4_": "L4", "l5_": "L5", "l6_": "L6",
    "R_": "R0", "R_1": "R1", "R_2": "R2", "R_3": "R3",
    "u": "U0", "u1": "U1", "u2": "U2",
    "p": "P0", "p1": "P1", "p2": "P2", "p3": "P3",
    "t1": "t1", "t": "t",
    "z_": "z", "z": "z",
}

# --- Description matching --------------------------------------------------------------------------

ROUND_HINTS = ["кругл", "кр", "ф", "d", "dn"]
RECT_HINTS = ["прямоуг", "прям", "п"]
DUCT_WORDS = ["прямошовн", "спираль", "навивн"]
FITTING_WORDS = [
    "фланец", "отвод", "переход", "тройник", "заглушка", "врезка", "насадок", "крестовина", "пленум",
    "шумоглуш", "диффузор", "решетк",
]

# --- Price search ------------------------------------------------------------------------------------

QUERY_STOP_WORDS = [
    "вентилятор", "канальный", "круглый", "прямоугольный", "кулачковый", "осевой",
    "клапан", "обратный", "противопожарный", "регулируемый", "воздушный",
    "воздуховод", "фасонный", "изделие", "переход", "тройник", "заглушка",
    "отвод", "крестовина", "решетка", "диффузор", "нагреватель", "охладитель",
    "фильтр", "шумоглушитель", "приточная", "вытяжная", "установка", "блок",
]

# Selector table of the known sites:
# source, base url, search path, search parameter, item, title, price, supplier.
SITE_SELECTORS = [
    ("pulscen", "https://pulscen.ru", "/search", "q",
     ".catalog-item", ".catalog-item__name", ".catalog-item__price", ".catalog-item__company"),
    ("tiu", "https://tiu.ru", "/search", "q",
     ".product-card", ".product-card__title", ".product-card__price", ".product-card__company"),
    ("blizko", "https://blizko.ru", "/search", "q",
     ".product-item", ".title", ".price", ".company"),
    ("um_climat", "https://um-climat.ru", "/search/", "q",
     ".s_product_block", "a.s_catalog_item_title", "span.h4-responsive.font-weight-bolder", None),
    ("airvek", "https://www.airvek.ru", "/index.php?route=product/search", "search",
     ".product-layout", ".caption h4 a", ".price", None),
]

# --- Equipment rules -----------------------------------------------------------------------------------
# Order is priority.  The first dimension pattern of every rule is the AxB one unless stated.

RULE_DEFAULTS = {"material": "оцинкованная", "thickness": 0.7, "unit": "шт"}
_AXB = r"(?<A>\d{2,4})\s*[-xх×]\s*(?<B>\d{2,4})"
_ROUND_SIDES = {"A0": "D0", "B0": "D0"}
CATEGORY_RULES = [
    {"id": "silencer", "name": "Шумоглушитель",
     "keywords": ["шумоглуш", "звукопоглотитель", "silencer"], "aliases": ["NKD", "MSN", "KNK"],
     "article_round": "15-1-1", "article_rect": "15-2-1",
     "dimension_patterns": [_AXB, r"\b(?:NKD|MSN|KNK)[-\s]?(?<D>\d{2,4})(?:/\d+)?\b"],
     "default_params": {"L0": 1000.0}, "round_derived_params": {}},
    {"id": "filter_cassette", "name": "Фильтр кассетный",
     "keywords": ["фильтр кассетный", "вставка кассетная фильтрующая"], "aliases": ["KFC", "KVC"],
     "article_round": "17-1-1", "article_rect": "17-2-1",
     "dimension_patterns": [_AXB, r"\b(?:KFC|KVC)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {"L0": 100.0}, "round_derived_params": _ROUND_SIDES},
    {"id": "filter_pocket", "name": "Фильтр карманный",
     "keywords": ["вставка карманная фильтрующая", "фильтр карманный"],
     "aliases": ["DFPM", "DFUM", "FWP"],
     "article_round": "17-1-2", "article_rect": "17-2-2",
     "dimension_patterns": [_AXB, r"\b(?:DFPM|DFUM|FWP)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {"L0": 300.0}, "round_derived_params": _ROUND_SIDES},
    {"id": "filter_housing", "name": "Корпус фильтра",
     "keywords": ["корпус фильтра"], "aliases": ["FRPM", "FRUM", "KFP"],
     "article_round": "17-1-3", "article_rect": "17-2-3",
     "dimension_patterns": [_AXB, r"\b(?:FRPM|FRUM|KFP)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {"L0": 300.0}, "round_derived_params": _ROUND_SIDES},
    {"id": "check_valve", "name": "Клапан обратный",
     "keywords": ["клапан обратный", "обратный клапан"],
     "aliases": ["RVN", "RVC", "RSK", "RVS", "KON"],
     "article_round": "18-1-3", "article_rect": "18-2-1",
     "dimension_patterns": [r"\b(?:RV[NCS]|RSK|KON)[-\s]?(?<D>\d{2,4})\b", _AXB],
     "default_params": {"L0": 200.0}, "round_derived_params": {}},
    {"id": "damper", "name": "Заслонка",
     "keywords": ["заслонка", "дроссель"], "aliases": ["CHR", "KCH"],
     "article_round": "16-1-1", "article_rect": "16-2-1",
     "dimension_patterns": [_AXB, r"\b(?:CHR|KCH)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {"L0": 200.0}, "round_derived_params": {}},
    {"id": "grille", "name": "Решетка",
     "keywords": ["решетка"], "aliases": ["АМР", "AMP"],
     "article_round": None, "article_rect": None,
     "dimension_patterns": [_AXB],
     "default_params": {}, "round_derived_params": {}},
    {"id": "diffuser", "name": "Диффузор",
     "keywords": ["диффузор", "воздухораспределитель"], "aliases": ["ДПУ", "DPU"],
     "article_round": None, "article_rect": None,
     "dimension_patterns": [_AXB, r"\b(?:ДПУ|DPU)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {}, "round_derived_params": {}},
    {"id": "mounting_cup", "name": "Монтажный стакан",
     "keywords": ["стакан монтажный", "монтажный стакан"], "aliases": ["MSN", "KPN-S"],
     "article_round": "29-1-3", "article_rect": None,
     "dimension_patterns": [_AXB, r"\b(?:MSN|KPN-S)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {"L0": 200.0}, "round_derived_params": {}},
    {"id": "fire_damper", "name": "Противопожарный клапан",
     "keywords": ["клапан противопожарный", "противопожарный клапан", "дымовой"],
     "aliases": ["PPK"],
     "article_round": "20-1", "article_rect": "20-2",
     "dimension_patterns": [_AXB, r"\b(?:PPK)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {"L0": 200.0}, "round_derived_params": {}},
    {"id": "air_valve", "name": "Воздушный клапан",
     "keywords": ["клапан воздушный", "воздушный клапан"], "aliases": ["ГЕРМИК"],
     "article_round": "21-1-1", "article_rect": "21-2-1",
     "dimension_patterns": [_AXB, r"\b(?:ГЕРМИК)[-\s]?(?<D>\d{2,4})\b"],
     "default_params": {"L0": 200.0}, "round_derived_params": {}},
]
SKIP_KEYWORDS = [
    "вентилятор", "воздухонагреватель", "калорифер", "насос", "привод", "вставка гибкая",
    "комплект", "датчик", "термостат", "частотный преобразователь", "блок управления",
    "установка", "кран", "вентиль", "ограждение", "лестница", "ограждение кровли", "хомут",
    "кронштейн", "смесительный узел", "регулятор скорости", "подставка",
]

# --- Catalogue: (article, section, name, parameters in order, provenance of the parameters) -------------
# "recovered" parameter lists are documented ones; "derived" lists are the keys the classifier emits.

ARTICLES = [
    ("1-1-1", "round", "Воздуховод круглого сечения прямошовный", ["D0", "L0"], "recovered"),
    ("1-1-2", "round", "Воздуховод круглого сечения спирально-навивной", ["D0", "L0"], "recovered"),
    ("1-1-3", "round", None, [], None),
    ("1-2-1", "rectangular", "Воздуховод прямоугольного сечения", ["A0", "B0", "L0"], "recovered"),
    ("1-2-2", "rectangular", None, [], None),
    ("2-1-1", "round", "Отвод круглого сечения", ["D0", "R0", "U0"], "recovered"),
    ("2-1-2", "round", "Отвод круглого сечения конический", ["D0", "R0", "U0"], "derived"),
    ("2-1-3", "round", "Отвод круглого сечения гофрированный", ["D0", "R0", "U0"], "derived"),
    ("2-2-1", "rectangular", "Отвод прямоугольного сечения радиусный", ["A0", "B0", "R0", "U0"], "recovered"),
    ("2-2-2", "rectangular", "Отвод прямоугольного сечения прямой", ["A0", "B0", "R0", "U0"], "derived"),
    ("2-2-3", "rectangular", "Отвод прямоугольного сечения косой", ["A0", "B0", "R0", "U0"], "derived"),
    ("2-2-4", "rectangular", "Отвод прямоугольного сечения пирамидальный", ["A0", "B0", "R0", "U0"], "derived"),
    ("3-1-1", "round", "Переход круглого сечения центральный", ["D0", "D1", "L0"], "derived"),
    ("3-1-2", "round", "Переход круглого сечения односторонний", [], None),
    ("3-1-3", "round", "Переход круглого сечения со смещением", [], None),
    ("3-2-1", "rectangular", "Переход прямоугольного сечения тип 1", ["A0", "B0", "A1", "B1", "L0"], "derived"),
    ("3-2-2", "rectangular", "Переход прямоугольного сечения тип 2", [], None),
    ("3-2-3", "rectangular", "Переход прямоугольного сечения тип 3", [], None),
    ("3-2-4", "rectangular", "Переход прямоугольного сечения тип 4", [], None),
    ("3-2-5", "rectangular", "Переход прямоугольного сечения тип 5", [], None),
    ("3-2-6", "rectangular", "Переход прямоугольного сечения тип 6", [], None),
    ("3-3-1", "round", "Переход с прямоугольного на круглое сечения тип 1", ["A0", "B0", "D0", "L0"], "derived"),
    ("3-3-2", "round", "Переход с прямоугольного на круглое сечения тип 2", [], None),
    ("3-3-3", "round", "Переход с прямоугольного на круглое сечения тип 3", [], None),
    ("3-3-4", "round", "Переход с прямоугольного на круглое сечения тип 4", [], None),
    ("3-3-5", "round", "Переход с прямоугольного на круглое сечения тип 5", [], None),
    ("3-3-6", "round", "Переход с прямоугольного на круглое сечения тип 6", [], None),
    ("4-1-1", "round", "Тройник круглого сечения с круглой прямой врезкой", ["D0", "D2", "L0", "L2"], "recovered"),
    ("4-1-2", "round", "Тройник круглого сечения с круглой косой врезкой", [], None),
    ("4-1-3", "round", "Тройник круглого сечения с прямоугольной прямой врезкой", ["D0", "A2", "B2", "L0", "L2"], "derived"),
    ("4-1-4", "round", "Тройник круглого сечения с прямоугольной косой врезкой", [], None),
    ("4-1-5", "round", "Тройник круглого сечения аспирационный", [], None),
    ("4-1-6", "round", "Тройник круглого сечения штаны", [], None),
    ("4-1-7", "round", "Тройник круглого сечения конический с прямой врезкой", [], None),
    ("4-1-8", "round", "Тройник круглого сечения конический с косой врезкой", [], None),
    ("4-1-9", "round", None, [], None),
    ("4-1-10", "round", None, [], None),
    ("4-2-1", "rectangular", "Тройник прямоугольного сечения с круглой прямой врезкой", ["A0", "B0", "D2", "L0", "L2"], "derived"),
    ("4-2-2", "rectangular", "Тройник прямоугольного сечения с круглой косой врезкой", [], None),
    ("4-2-3", "rectangular", "Тройник прямоугольного сечения с прямоугольной прямой врезкой", ["A0", "B0", "A2", "B2", "L0", "L2"], "recovered"),
    ("4-2-4", "rectangular", "Тройник прямоугольного сечения с прямоугольной косой врезкой", [], None),
    ("4-2-5", "rectangular", "Тройник прямоугольного сечения штаны 180", [], None),
    ("4-2-6", "rectangular", "Тройник прямоугольного сечения штаны 90", [], None),
    ("4-2-7", "rectangular", "Тройник прямоугольного сечения штаны 0", [], None),
    ("4-2-8", "rectangular", "Тройник прямоугольного сечения переходный с прямой врезкой", [], None),
    ("4-2-9", "rectangular", "Тройник прямоугольного сечения переходный с радиусной врезкой", [], None),
    ("5-1-1", "round", "Крестовина круглого сечения центральная", ["D0", "L0"], "derived"),
    ("5-1-2", "round", "Крестовина круглого сечения со смещением", [], None),
    ("5-1-3", "round", "Крестовина круглого сечения аспирационная", [], None),
    ("5-1-4", "round", "Крестовина круглого сечения с прямоугольной врезкой", [], None),
    ("5-1-5", "round", "Крестовина круглого сечения конусная с прямыми круглыми врезками", [], None),
    ("5-1-6", "round", "Крестовина круглого сечения конусная с косыми круглыми врезками", [], None),
    ("5-2-1", "rectangular", "Крестовина прямоугольного сечения центральная", ["A0", "B0", "L0"], "derived"),
    ("5-2-2", "rectangular", "Крестовина прямоугольного сечения со смещением", [], None),
    ("5-2-3", "rectangular", "Крестовина прямоугольного сечения с прямоугольной косой врезкой", [], None),
    ("5-2-4", "rectangular", "Крестовина прямоугольного сечения с круглой врезкой", [], None),
    ("6-1-1", "round", "Заглушка круглого сечения", ["D0", "P0"], "derived"),
    ("6-1-2", "round", "Заглушка круглого сечения с сеткой", [], None),
    ("6-2-1", "rectangular", "Заглушка прямоугольного сечения", ["A0", "B0", "P0"], "recovered"),
    ("6-2-2", "rectangular", "Заглушка прямоугольного сечения с сеткой", [], None),
    ("7-1-1", "round", "Утка круглого сечения", [], None),
    ("7-1-2", "round", "Утка круглого сечения с переходом", [], None),
    ("7-2-1", "rectangular", "Утка прямоугольного сечения косая", [], None),
    ("7-2-2", "rectangular", "Утка прямоугольного сечения радиусная", [], None),
    ("7-2-3", "rectangular", "Утка прямоугольного сечения со смещением в 2-х плоскостях", [], None),
    ("8-1-1", "round", "Врезка круглого сечения прямая в круглый воздуховод", ["D0", "L0"], "derived"),
    ("8-1-2", "round", "Врезка круглого сечения косая в круглый воздуховод", [], None),
    ("8-1-3", "round", "Врезка круглого сечения прямая в прямоугольный воздуховод", [], None),
    ("8-1-4", "round", "Врезка круглого сечения косая в прямоугольный воздуховод", [], None),
    ("8-1-5", "round", "Врезка круглого сечения воротниковая", [], None),
    ("8-1-6", "round", "Врезка круглого сечения в плоскость", [], None),
    ("8-2-1", "rectangular", "Врезка прямоугольного сечения прямая в прямоугольный воздуховод", ["A0", "B0", "L0"], "recovered"),
    ("8-2-2", "rectangular", "Врезка прямоугольного сечения косая в прямоугольный воздуховод", [], None),
    ("8-2-3", "rectangular", "Врезка прямоугольного сечения радиусная в прямоугольный воздуховод", [], None),
    ("8-2-4", "round", "Врезка прямоугольного сечения прямая в круглый воздуховод", [], None),
    ("8-2-5", "round", "Врезка прямоугольного сечения косая в круглый воздуховод", [], None),
    ("8-2-6", "round", "Врезка прямоугольного сечения радиусная в круглый воздуховод", [], None),
    ("8-2-7", "rectangular", "Врезка прямоугольного сечения в плоскость", [], None),
    ("9-1-1", "round", "Зонт крышный круглого сечения", [], None),
    ("9-1-2", "round", "Зонт крышный круглого сечения (дефлектор)", [], None),
    ("9-2-1", "rectangular", "Зонт прямоугольного сечения с коньком", [], None),
    ("9-2-2", "rectangular", "Зонт прямоугольного сечения скошеный", [], None),
    ("9-2-3", "rectangular", "Зонт прямоугольного сечения с прямым коньком", [], None),
    ("10-1-1", "round", "КСД кр. сечения для круглого диффузора с пр. врезкой", ["D0", "D1", "L0", "L1"], "derived"),
    ("10-1-2", "round", "КСД кр. сечения для круглого диффузора с кр. врезкой", [], None),
    ("10-2-1", "round", "КСД пр. сечения для кр. диффузора с кр. врезкой", [], None),
    ("10-2-2", "round", "КСД пр. сечения для кр. диффузора с пр. врезкой", [], None),
    ("10-2-3", "rectangular", "КСД пр. сечения для пр. диффузора с кр. врезкой", ["A0", "B0", "D1", "L0", "L1"], "derived"),
    ("10-2-4", "rectangular", "КСД пр. сечения для пр. диффузора с пр. врезкой", [], None),
    ("10-3-1", "rectangular", "КСД для настенного щелевого диффузора 1", [], None),
    ("10-3-2", "rectangular", "КСД для настенного щелевого диффузора 2", [], None),
    ("10-3-3", "rectangular", "КСД для потолочного щелевого диффузора 1", [], None),
    ("10-3-4", "rectangular", "КСД для потолочного щелевого диффузора 2", [], None),
    ("12-1-1", "round", "Ниппель", [], None),
    ("12-2-4", "rectangular", "Ниппель прямоугольный", [], None),
    ("12-2-3", "rectangular", "Рейка", [], None),
    ("12-2-1", "rectangular", "Шина и УГФ", [], None),
    ("12-1-3", "round", "Фланец (кр)", ["D0", "P0"], "recovered"),
    ("12-2-2", "rectangular", "Фланец (пр)", ["A0", "B0", "P0"], "derived"),
    ("15-1-1", "round", "Шумоглушитель трубчатый круглый ГТК", ["D0", "L0"], "derived"),
    ("15-1-2", "round", "Шумоглушитель трубчатый круглый спиральный", ["D0", "L0"], "derived"),
    ("15-2-1", "rectangular", "Шумоглушитель трубчатый прямоугольный ГТП", ["A0", "B0", "L0"], "derived"),
    ("15-2-2", "rectangular", "Шумоглушитель пластинчатый", ["A0", "B0", "L0"], "derived"),
    ("15-2-3", "rectangular", "Шумоглушитель с обтекателем", ["A0", "B0", "L0"], "derived"),
    ("15-2-4", "rectangular", "Шумоглушитель пластинчатый тип 4", ["B0", "L0", "A2"], "recovered"),
    ("15-2-5", "rectangular", "Шумоглушитель с обтекателем тип 5", ["B0", "A2"], "derived"),
    ("15-2-6", "rectangular", "Шумоглушитель с круглыми врезками", ["A0", "B0", "L0"], "derived"),
    ("15-2-7", "rectangular", "Шумоглушитель канальный", ["A0", "B0", "L0"], "derived"),
    ("16-1-1", "round", "Дроссель круглого сечения", ["D0", "L0"], "derived"),
    ("16-2-1", "rectangular", "Дроссель прямоугольного сечения", ["A0", "B0", "L0"], "derived"),
    ("17-1-1", "round", "Фильтр круглого сечения кассетный", ["D0", "L0"], "derived"),
    ("17-1-2", "round", "Фильтр круглого сечения карманный", ["D0", "L0"], "derived"),
    ("17-1-3", "round", "Корпус фильтра для круглых каналов", ["D0", "L0"], "derived"),
    ("17-1-4", None, "Фильтровальный элемент для круглых каналов", [], None),
    ("17-2-1", "rectangular", "Фильтр прямоугольного сечения кассетный", ["A0", "B0", "L0"], "derived"),
    ("17-2-2", "rectangular", "Фильтр прямоугольного сечения карманный", ["A0", "B0", "L0"], "derived"),
    ("17-2-3", "rectangular", "Корпус фильтра для прямоугольных каналов", ["A0", "B0", "L0"], "derived"),
    ("17-2-4", None, "Фильтровальный элемент для прямоугольных каналов", [], None),
    ("18-1-1", "round", "Обратный клапан круглого сечения лепестковый (5.904-41)", [], None),
    ("18-1-3", "round", "Обратный клапан круглого сечения бабочка (RSK)", ["D0", "L0"], "derived"),
    ("18-2-1", "rectangular", "Обратный клапан прямоугольного сечения лепестковый", ["A0", "B0", "L0"], "derived"),
    ("19-1-1", "round", "Зонт вытяжной круглого сечения тип 1", [], None),
    ("19-1-2", "round", "Зонт вытяжной круглого сечения тип 2", [], None),
    ("19-2-1", "rectangular", "Зонт вытяжной прямоугольного сечения тип 1", [], None),
    ("19-2-2", "rectangular", "Зонт вытяжной прямоугольного сечения тип 2", [], None),
    ("19-2-3", "rectangular", "Зонт вытяжной прямоугольного сечения тип 3", [], None),
    ("19-2-4", "rectangular", "Зонт вытяжной прямоугольного сечения тип 4", [], None),
    ("19-2-5", "rectangular", "Зонт вытяжной прямоугольного сечения тип 5", [], None),
    ("19-2-6", "rectangular", "Зонт вытяжной прямоугольного сечения тип 6", [], None),
    ("19-2-7", "rectangular", "Кассета жироуловителя (сетка)", [], None),
    ("19-2-8", "rectangular", "Кассета жироуловителя (лабиринт)", [], None),
    ("20-1", "round", "Противопожарный клапан круглого сечения", ["D0", "L0"], "derived"),
    ("20-2", "rectangular", "Противопожарный клапан прямоугольного сечения", ["A0", "B0", "L0"], "derived"),
    ("21-1-1", "round", "Клапан воздушный круглого сечения", ["D0", "L0"], "derived"),
    ("21-2-1", "rectangular", "Клапан воздушный прямоугольного сечения", ["A0", "B0", "L0"], "derived"),
    ("29-1-3", "round", "Монтажный стакан", ["D0", "L0"], "derived"),
]
FORCED_PARAMS = {"8-2-1": {"L0": "100"}}

# --- Material codes an article may be made of ------------------------------------------------------------

ARTICLE_MATERIALS = {
    "1-1-1": ["1", "2", "3"],
    "1-1-2": ["1", "2", "3"],
    "1-1-3": ["1", "2", "3"],
    "1-2-1": ["1", "2", "3"],
    "1-2-2": ["1", "2", "3"],
    "2-1-1": ["1", "2", "3"],
    "2-1-2": ["1", "2", "3"],
    "2-1-3": ["1", "2", "3"],
    "2-2-1": ["1", "2", "3"],
    "2-2-2": ["1", "2", "3"],
    "2-2-3": ["1", "2", "3"],
    "2-2-4": ["1", "2", "3"],
    "3-1-1": ["1", "2", "3"],
    "3-1-2": ["1", "2", "3"],
    "3-1-3": ["1", "2", "3"],
    "3-2-1": ["1", "2", "3"],
    "3-2-2": ["1", "2", "3"],
    "3-2-3": ["1", "2", "3"],
    "3-2-4": ["1", "2", "3"],
    "3-2-5": ["1", "2", "3"],
    "3-2-6": ["1", "2", "3"],
    "3-3-1": ["1", "2", "3"],
    "3-3-2": ["1", "2", "3"],
    "3-3-3": ["1", "2", "3"],
    "3-3-4": ["1", "2", "3"],
    "3-3-5": ["1", "2", "3"],
    "3-3-6": ["1", "2", "3"],
    "4-1-1": ["1", "2", "3"],
    "4-1-2": ["1", "2", "3"],
    "4-1-3": ["1", "2", "3"],
    "4-1-4": ["1", "2", "3"],
    "4-1-5": ["1", "2", "3"],
    "4-1-6": ["1", "2", "3"],
    "4-1-7": ["1", "2", "3"],
    "4-1-8": ["1", "2", "3"],
    "4-1-9": ["1", "2", "3"],
    "4-1-10": ["1", "2", "3"],
    "4-2-1": ["1", "2", "3"],
    "4-2-2": ["1", "2", "3"],
    "4-2-3": ["1", "2", "3"],
    "4-2-4": ["1", "2", "3"],
    "4-2-5": ["1", "2", "3"],
    "4-2-6": ["1", "2", "3"],
    "4-2-7": ["1", "2", "3"],
    "4-2-8": ["1", "2", "3"],
    "4-2-9": ["1", "2", "3"],
    "5-1-1": ["1", "2", "3"],
    "5-1-2": ["1", "2", "3"],
    "5-1-3": ["1", "2", "3"],
    "5-1-4": ["1", "2", "3"],
    "5-1-5": ["1", "2", "3"],
    "5-1-6": ["1", "2", "3"],
    "5-2-1": ["1", "2", "3"],
    "5-2-2": ["1", "2", "3"],
    "5-2-3": ["1", "2", "3"],
    "5-2-4": ["1", "2", "3"],
    "6-1-1": ["1", "2", "3"],
    "6-1-2": ["1", "2", "3"],
    "6-2-1": ["1", "2", "3"],
    "6-2-2": ["1", "2", "3"],
    "7-1-1": ["1", "2", "3"],
    "7-1-2": ["1", "2", "3"],
    "7-2-1": ["1", "2", "3"],
    "7-2-2": ["1", "2", "3"],
    "7-2-3": ["1", "2", "3"],
    "8-1-1": ["1", "2", "3"],
    "8-1-2": ["1", "2", "3"],
    "8-1-3": ["1", "2", "3"],
    "8-1-4": ["1", "2", "3"],
    "8-1-5": ["1", "2", "3"],
    "8-1-6": ["1", "2", "3"],
    "8-2-1": ["1", "2", "3"],
    "8-2-2": ["1", "2", "3"],
    "8-2-3": ["1", "2", "3"],
    "8-2-4": ["1", "2", "3"],
    "8-2-5": ["1", "2", "3"],
    "8-2-6": ["1", "2", "3"],
    "8-2-7": ["1", "2", "3"],
    "9-1-1": ["1", "2", "3"],
    "9-1-2": ["1", "2", "3"],
    "9-2-1": ["1", "2", "3"],
    "9-2-2": ["1", "2", "3"],
    "9-2-3": ["1", "2", "3"],
    "10-1-1": ["1", "2", "3"],
    "10-1-2": ["1", "2", "3"],
    "10-2-1": ["1", "2", "3"],
    "10-2-2": ["1", "2", "3"],
    "10-2-3": ["1", "2", "3"],
    "10-2-4": ["1", "2", "3"],
    "10-3-1": ["1", "2", "3"],
    "10-3-2": ["1", "2", "3"],
    "10-3-3": ["1", "2", "3"],
    "10-3-4": ["1", "2", "3"],
    "12-1-1": ["1", "2", "3"],
    "12-2-4": ["1", "2", "3"],
    "12-2-3": ["1", "2", "3"],
    "12-2-1": ["1", "2", "3"],
    "12-1-3": ["1", "2", "3"],
    "12-2-2": ["1", "2", "3"],
    "17-1-1": ["1", "2"],
    "17-1-2": ["1", "2"],
    "17-1-3": ["1", "2"],
    "17-1-4": ["1", "2"],
    "17-2-1": ["1", "2"],
    "17-2-2": ["1", "2"],
    "17-2-3": ["1", "2"],
    "17-2-4": ["1", "2"],
    "18-1-1": ["1", "2"],
    "18-1-3": ["1", "2"],
    "18-2-1": ["1", "2"],
    "19-1-1": ["1", "2"],
    "19-1-2": ["1", "2"],
    "19-2-1": ["1", "2"],
    "19-2-2": ["1", "2"],
    "19-2-3": ["1", "2"],
    "19-2-4": ["1", "2"],
    "19-2-5": ["1", "2"],
    "19-2-6": ["1", "2"],
    "19-2-7": ["1", "2"],
    "19-2-8": ["1", "2"],
    "13-1-1": ["1"],
    "13-2-1": ["1"],
    "15-1-1": ["1", "2", "3"],
    "15-1-2": ["1", "2", "3"],
    "15-2-3": ["1", "2", "3"],
    "16-1-1": ["1", "2", "3"],
    "16-2-1": ["1", "2", "3"],
    "19-5-1": ["1", "2"],
    "19-5-2": ["1", "2"],
    "19-6-1": ["1", "2"],
    "19-6-2": ["1", "2"],
    "21-1-1": ["1"],
    "21-2-1": ["1"],
    "28-1-2": ["1"],
    "29-1-1": ["1", "2"],
    "30-1-1": ["1"],
    "30-1-2": ["1"],
    "30-2-1": ["1"],
    "30-2-2": ["1"],
    "15-2-1": ["1"],
    "15-2-2": ["1"],
    "15-2-4": ["1"],
    "15-2-5": ["1"],
    "15-2-6": ["1"],
    "15-2-7": ["1"],
    "20-1": ["1"],
    "20-2": ["1"],
    "29-1-3": ["1"],
}
