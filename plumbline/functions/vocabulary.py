"""Word lists, codes and patterns that results depend on."""

# --- files -----------------------------------------------------------------
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".xlsx", ".xls", ".csv", ".ifc", ".zip", ".jpg", ".jpeg", ".png", ".tiff"]
MAX_FILE_BYTES = 500 * 1024 * 1024
FILE_TYPE_BY_EXTENSION = {
    ".pdf": "PDF", ".docx": "Word", ".doc": "Word", ".xlsx": "Excel", ".xls": "Excel",
    ".csv": "CSV", ".ifc": "IFC", ".zip": "ZIP", ".jpg": "Image", ".jpeg": "Image",
    ".png": "Image", ".tiff": "Image", ".tif": "Image",
}
FILE_TYPE_BY_MIME = {
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "Word",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "Excel",
    "application/zip": "ZIP",
    "image/jpeg": "Image",
    "image/png": "Image",
}
DOCUMENT_TYPES = {
    "raumliste": ["raumliste", "raum_liste", "raeume", "room_list"],
    "grundrissplan": ["grundriss", "grundrissplan", "floor_plan", "geschossplan"],
    "geräteliste": ["geräteliste", "geraeteliste", "equipment", "geraete"],
    "ausschreibungstext": ["ausschreibung", "tender", "specification"],
    "terminplan": ["terminplan", "zeitplan", "schedule", "gantt", "meilenstein"],
    "leistungsaufstellung": ["leistung", "leistungsaufstellung", "scope"],
    "anschreiben": ["anschreiben", "cover_letter", "brief"],
}
DISCIPLINES = {
    "HLKS": ["hlks", "heizung", "lüftung", "klima", "sanitär", "hvac", "zuluft", "abluft",
             "wärmepumpe", "kälte", "klimaanlage", "ventilator"],
    "Architektur": ["architektur", "architekt", "architecture", "grundriss", "fassade"],
    "Elektro": ["elektro", "elektrik", "electrical", "strom", "beleuchtung"],
    "Tragwerk": ["tragwerk", "statik", "structure", "beton", "stahl"],
}
REVISION_PATTERNS = [
    r"[Rr]ev(?:ision)?[_\s]?([A-Z0-9.]+)",
    r"[Vv](\d+\.?\d*)",
    r"_([Rr]\d+)",
    r"([Rr]\d+)_",
]
PLAN_WORDS = ["plan", "grundriss", "schnitt"]
ARCHIVE_SUFFIXES = [".zip", ".tar", ".gz", ".bz2", ".7z", ".rar"]
ARCHIVE_MAX_MEMBERS = 1000
ARCHIVE_MAX_DEPTH = 3

# --- tables ----------------------------------------------------------------
SHEET_KINDS_BY_NAME = {
    "raumliste": ["raum", "room", "raeume", "räume"],
    "geraeteliste": ["geraet", "equipment", "gerät"],
    "anlagenliste": ["anlage", "anlagen", "system"],
    "terminplan": ["termin", "zeitplan", "schedule", "gantt", "meilenstein"],
    "leistungsverzeichnis": ["leistung", "lv", "leistungsverzeichnis", "position"],
}
SHEET_KINDS_BY_TEXT = {
    "raumliste": ["raum", "room", "fläche", "flaeche"],
    "geraeteliste": ["geraet", "equipment", "typ", "leistung"],
    "anlagenliste": ["anlage", "system", "lüftung", "heizung"],
    "terminplan": ["datum", "termin", "deadline", "abgabe"],
}
SHEET_ROLES = {
    "raumliste": {
        "name": ["raum", "room", "nummer", "nr", "bezeichnung"],
        "area": ["flaeche", "fläche", "m²", "m2", "area"],
        "volume": ["volumen", "volume", "m³", "m3"],
        "height": ["hoehe", "höhe", "höhe m", "height"],
        "usage": ["nutzung", "nutzungsart", "art", "typ", "usage"],
        "storey": ["geschoss", "etage", "floor", "level"],
        "zone": ["zone", "bereich", "area"],
    },
    "geraeteliste": {
        "name": ["geraet", "equipment", "gerät", "bezeichnung", "name"],
        "kind": ["typ", "type", "art"],
        "power": ["leistung", "power", "kw", "leistung kw"],
        "system": ["anlage", "system"],
        "space": ["raum", "room"],
    },
    "anlagenliste": {
        "name": ["anlage", "system", "bezeichnung"],
        "kind": ["typ", "type", "art"],
        "power": ["leistung", "power", "kw"],
        "flow": ["volumenstrom", "m3/h", "m³/h", "luftmenge"],
    },
    "terminplan": {
        "text": ["beschreibung", "bezeichnung", "aufgabe", "task"],
        "due": ["datum", "termin", "date", "deadline", "abgabe"],
        "category": ["kategorie", "art", "typ"],
        "phase": ["phase", "sia"],
    },
    "leistungsverzeichnis": {
        "text": ["beschreibung", "bezeichnung", "leistung", "position"],
        "unit": ["einheit", "unit"],
        "quantity": ["menge", "anzahl", "quantity"],
        "phase": ["phase", "sia"],
        "category": ["kategorie", "art"],
    },
}
TOTAL_ROW_NAMES = ["gesamt", "summe", "total"]
SHEET_ROW_LIMIT = 10_000
HEADER_SEARCH_ROWS = 20
EMPTY_ROW_STOP = 100
DOCUMENT_TABLE_KINDS = {
    "spaces": ["raum", "room", "fläche", "flaeche"],
    "equipment": ["geraet", "equipment", "gerät", "typ"],
    "milestones": ["datum", "termin", "date", "deadline"],
}
DOCUMENT_TABLE_ROLES = {
    "spaces": {
        "name": ["raum", "room", "nummer"],
        "area": ["fläche", "flaeche", "m²"],
        "usage": ["nutzung", "art"],
    },
    "equipment": {
        "name": ["geraet", "equipment", "gerät", "name"],
        "kind": ["typ", "type"],
        "power": ["leistung", "power", "kw"],
    },
    "milestones": {
        "text": ["beschreibung", "bezeichnung", "aufgabe"],
        "due": ["datum", "termin", "date"],
    },
}

# --- requirements in text --------------------------------------------------
REQUIREMENT_WORDS = [
    "luftwechsel", "temperatur", "feuchtigkeit", "anforderung", "vorgabe",
    "muss", "soll", "sollte", "erforderlich", "notwendig", "benötigt",
    "luftqualität", "raumklima", "komfort", "energieeffizienz",
]
LIST_REQUIREMENT_WORDS = ["anforderung", "vorgabe", "muss", "soll", "erforderlich"]
LINE_REQUIREMENT_WORDS = ["anforderung", "vorgabe", "muss", "soll", "erforderlich",
                          "luftwechsel", "temperatur", "feuchtigkeit"]
PRIORITY_WORDS = {
    "hoch": ["muss", "erforderlich", "notwendig", "kritisch"],
    "niedrig": ["sollte", "empfohlen", "optional"],
}
REQUIREMENT_CATEGORIES = {
    "technisch": ["luftwechsel", "temperatur", "feuchtigkeit", "luftqualität", "raumklima"],
    "organisatorisch": ["termin", "abgabe", "freigabe", "koordination"],
    "energie": ["energieeffizienz", "energie", "verbrauch", "leistung"],
}
PHASES = ["SIA 103 - Projektierung", "SIA 104 - Vorprojekt", "SIA 105 - Bauprojekt"]
PHASE_WORDS = {
    "SIA 103 - Projektierung": ["projektierung"],
    "SIA 104 - Vorprojekt": ["vorprojekt"],
    "SIA 105 - Bauprojekt": ["bauprojekt"],
}
PARAGRAPH_MIN_CHARS = 20
PARAGRAPH_MAX_CHARS = 2000
PARAGRAPHS_PER_FILE = 100
SCAN_TEXT_MIN_CHARS = 50

# --- plan text ---------------------------------------------------------------
SPACE_LABEL_PATTERNS = [r"R\.?\s*(\d+[A-Z]?)", r"Raum\s+(\d+[A-Z]?)", r"R\s*(\d+[A-Z]?)", r"(\d+\.\d+)"]
AREA_OWNER_PATTERNS = [r"R\.?\s*(\d+[A-Z]?)", r"Raum\s+(\d+[A-Z]?)", r"R\s*(\d+[A-Z]?)"]  # labels that an area can belong to
AREA_PATTERNS = [r"(\d+[,.]\d+)\s*m²", r"(\d+[,.]\d+)\s*m2", r"Fläche[:\s]+(\d+[,.]\d+)"]
SYSTEM_LABEL_PATTERNS = [
    r"(LÜA|Lüftungsanlage|Ventilation)\s*(\d+)?",
    r"(HK|Heizungsanlage|Heating)\s*(\d+)?",
    r"(WP|Wärmepumpe|Heat Pump)\s*(\d+)?",
]
PLAN_SYMBOLS = {
    "lueftungsauslass": ("geraet", r"[ZL]A|Zuluft|Abluft"),
    "heizkoerper": ("geraet", r"HK|Heizkörper|Radiator"),
    "ventilator": ("geraet", r"VENT|Ventilator|Fan"),
    "waermepumpe": ("anlage", r"WP|Wärmepumpe|Heat Pump"),
    "lueftungsanlage": ("anlage", r"LÜA|Lüftungsanlage|Ventilation"),
}

# --- building models ---------------------------------------------------------
SYSTEM_TYPE_WORDS = ["hvac", "heating", "ventilation", "plumbing", "sanitär"]
OLD_SCHEMA_EQUIPMENT = ["IfcFlowMovingDevice", "IfcPump", "IfcFan", "IfcCompressor", "IfcFlowController"]
NEW_SCHEMA_EQUIPMENT = "IfcMechanicalEquipment"
TERMINAL_CLASS = "IfcFlowTerminal"

# --- reports -----------------------------------------------------------------
RISK_LEVELS = {
    ("hoch", "hoch"): "KRITISCH", ("hoch", "mittel"): "HOCH", ("hoch", "niedrig"): "MITTEL",
    ("mittel", "hoch"): "HOCH", ("mittel", "mittel"): "MITTEL", ("mittel", "niedrig"): "NIEDRIG",
    ("niedrig", "hoch"): "MITTEL", ("niedrig", "mittel"): "NIEDRIG", ("niedrig", "niedrig"): "NIEDRIG",
}
PHASE_DEFAULT_TEXT = {
    "SIA 103 - Projektierung": "Projektanalyse, Raumanalyse, Konzeptentwicklung",
    "SIA 104 - Vorprojekt": "Vorprojekt, Kostenplanung, Terminplanung",
    "SIA 105 - Bauprojekt": "Bauprojekt, Ausschreibung, Vergabe",
}
PHASE_DAYS = [30, 60, 90]
RESPONSIBILITIES = [
    ("Projektleiter", "Projektkoordination", "R"), ("Projektleiter", "Kostenplanung", "A"),
    ("Projektleiter", "Terminplanung", "A"), ("Projektleiter", "Qualitätssicherung", "A"),
    ("HLKS-Ingenieur", "Planung", "R"), ("HLKS-Ingenieur", "Berechnungen", "R"),
    ("HLKS-Ingenieur", "Ausschreibung", "C"), ("HLKS-Ingenieur", "Abnahme", "C"),
    ("CAD-Zeichner", "Planerstellung", "R"), ("CAD-Zeichner", "Planprüfung", "C"),
]

# --- text review ---------------------------------------------------------------
REVIEW_CATEGORIES = {
    "Haftung": ["haftung", "verantwortung", "schaden", "mängel"],
    "Leistungsumfang": ["leistung", "umfang", "koordination", "verantwortung"],
    "Honorierung": ["honorar", "vergütung", "zahlung", "kosten"],
    "Termine": ["termin", "verzug", "frist", "strafe"],
    "Rechte": ["kündigung", "änderung", "recht", "pflicht"],
    "Rechtliches": ["gericht", "recht", "schiedsgericht", "norm"],
}
MARKER_WINDOW_CHARS = 2000
TOKEN_WARNING = 100_000
REVIEW_HISTORY = 10

# --- default offer specification -------------------------------------------------
OFFER_SPEC = {
    "mindestanforderungen": {
        "projekt": {"erforderliche_felder": ["name", "standort"]},
        "raeume": {"min_anzahl": 1, "erforderliche_felder": ["id", "name", "flaeche_m2"]},
        "anlagen": {"min_anzahl": 0, "erforderliche_felder": ["typ"]},
        "geraete": {"min_anzahl": 0, "erforderliche_felder": ["typ"]},
    },
    "sia_phasen": [
        {"phase": "SIA 103 - Projektierung",
         "erforderliche_leistungen": ["Projektanalyse", "Raumanalyse", "Konzeptentwicklung"]},
        {"phase": "SIA 104 - Vorprojekt",
         "erforderliche_leistungen": ["Vorprojekt", "Kostenplanung", "Terminplanung"]},
        {"phase": "SIA 105 - Bauprojekt",
         "erforderliche_leistungen": ["Bauprojekt", "Ausschreibung", "Vergabe"]},
    ],
    "plausibilitaetsgrenzen": {
        "raum": {"flaeche_min": 1.0, "flaeche_max": 10000.0, "hoehe_min": 2.0, "hoehe_max": 10.0},
        "anlage": {"leistung_kw_max": 10000.0, "leistung_m3_h_max": 100000.0},
    },
}
