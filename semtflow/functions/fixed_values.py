"""Fixed values of the address domain.

Word lists, tables, patterns, weights and texts that results depend on. They
are plain data in natural order; the logic that uses them lives elsewhere.
"""

# --- cleaning ---------------------------------------------------------------

PUNCTUATION = [".", ",", ";", ":", "/", "\\", "-", "_", "(", ")", "[", "]", "{", "}"]
TOKEN_SEPARATORS = [" ", ",", ";", "/", "\\", "-", "_"]

ABBREVIATIONS = {
    "mh": "mahalle", "mah": "mahalle", "mahalle": "mahalle", "mhl": "mahalle",
    "cd": "cadde", "cad": "cadde", "cadde": "cadde",
    "sk": "sokak", "sok": "sokak", "sokak": "sokak",
    "blv": "bulvar", "bulv": "bulvar", "bulvar": "bulvar",
    "ykl": "yokuş", "yks": "yokuş", "yokuş": "yokuş",
    "no": "numara", "n:": "numara", "N:": "numara", "num": "numara", "numara": "numara",
    "d": "daire", "d:": "daire", "D:": "daire", "dr": "daire", "daire": "daire", "dt": "daire",
    "kat": "kat", "k": "kat",
    "apt": "apartman", "apart": "apartman", "apartman": "apartman", "ap": "apartman",
    "sit": "site", "site": "site", "blk": "blok", "blok": "blok", "plaza": "plaza",
    "is": "iş", "mrk": "merkez", "merkez": "merkez",
    "krs": "karşısı", "karşısı": "karşısı", "karsisi": "karşısı",
    "yon": "yönü", "yonu": "yönü", "arka": "arkası", "arkasi": "arkası",
    "yan": "yanı", "yani": "yanı", "alt": "altı", "alti": "altı", "ust": "üstü", "ustu": "üstü",
    "grs": "giriş", "giris": "giriş", "giriş": "giriş",
    "cks": "çıkış", "cikis": "çıkış", "çıkış": "çıkış", "kapi": "kapı", "kapı": "kapı",
    "mevki": "mevki", "mevkii": "mevki", "kvk": "kavak",
    "çk": "çeşme", "cesme": "çeşme", "çeşme": "çeşme",
    "ic": "iç", "ici": "iç", "iç": "iç", "dis": "dış", "disi": "dış", "dış": "dış",
}

FOLD_FROM = "çğıöşüâîû"
FOLD_TO = "cgiosuaiu"

LEGACY_FOLD_FROM = "ıİğĞüÜşŞöÖçÇ"
LEGACY_FOLD_TO = "iIgGuUsSoOcC"

# --- geography --------------------------------------------------------------

PROVINCES = """adana adiyaman afyonkarahisar agri aksaray amasya ankara antalya ardahan artvin aydin
balikesir bartin batman bayburt bilecik bingol bitlis bolu burdur bursa canakkale cankiri corum denizli
diyarbakir duzce edirne elazig erzincan erzurum eskisehir gaziantep giresun gumushane hakkari hatay igdir
isparta istanbul izmir kahramanmaras karabuk karaman kars kastamonu kayseri kilis kirikkale kirklareli
kirsehir kocaeli konya kutahya malatya manisa mardin mersin mugla mus nevsehir nigde ordu osmaniye rize
sakarya samsun sanliurfa siirt sinop sirnak sivas tekirdag tokat trabzon tunceli usak van yalova yozgat
zonguldak""".split()

MAJOR_CITIES = ["istanbul", "ankara", "izmir", "bursa", "antalya"]

# --- pattern matching -------------------------------------------------------

PATTERNS = [
    ("mahalle_sokak_no", 90, "<Mahalle> <Sokak> no <n>"),
    ("mahalle_cadde_no", 89, "<Mahalle> <Cadde> no <n>"),
    ("full_address_with_building", 85, "<Mahalle> <Sokak> no <n> daire <Daire>"),
    ("explanation_mahalle_sokak_no", 80, "<Açıklama?> <Mahalle> <Sokak> no <n>"),
    ("complex_address_full", 75, "<Açıklama?> <Mahalle> <Sokak> no <n> kat <Kat> daire <Daire>"),
    ("site_pattern", 70, "<Site> <Blok?> no <n> daire <Daire>"),
    ("sokak_numara_simple", 65, "<Sokak> numara <n>"),
    ("numara_first_pattern", 60, "<n> sokak no <n2>"),
    ("mahalle_sokak_no_colon", 88, "<Mahalle> <n> sokak no <n2>"),
    ("mahalle_sokak_no_slash", 87, "<Mahalle> <Sokak> no <n>/<text>"),
    ("mahalle_site_sokak_no", 86, "<Mahalle> <Site> <Sokak> no <n>"),
    ("mahalle_sk_abbreviation", 84, "<Mahalle> <n> sk no <n2>"),
    ("mahalle_full_apartment", 83, "<Mahalle> <Sokak> no <n> kat <Kat> daire <Daire> <text?>"),
    ("comma_separated_address", 82, "<Mahalle>, <text>, <n> sokak, no <n2>"),
    ("city_district_pattern", 81, "<Mahalle> <Sokak> no <n> <İlçe>/<İl>"),
    ("informal_business_address", 79, "<text> <Mahalle> <n> sok no <n2>"),
    ("apartment_building_name", 78, "<Sokak> <text> no <n> daire <Daire> kat <Kat>"),
    ("numbered_street_simple", 77, "<n>/<n2> sokak no <n3>"),
    ("site_block_apartment", 76, "<Mahalle> <Site> <Blok?> no <n> daire <Daire>"),
    ("loose_mahalle_only", 50, "<Mahalle> <text?>"),
]

NUMBER_SLOT = r"(\d+(?:[a-z])?)"
TEXT_SLOT = r"(\S+(?:\s+\S+)*?)"
NAMED_SLOT = r"([a-zA-ZçğıöşüÇĞIÖŞÜ]+(?:\s+[a-zA-ZçğıöşüÇĞIÖŞÜ]+)*?)"

SLOT_WEIGHTS = {
    "Mahalle": 0.9, "Sokak": 0.9, "Cadde": 0.9, "n": 0.8, "Daire": 0.7, "Kat": 0.7,
    "Site": 0.8, "Blok": 0.6, "Açıklama": 0.25, "text": 0.3,
}

LOCATION_WORDS = ["mahalle", "mah", "sitesi", "evleri", "apartmanı", "apy", "residence", "complex"]
KEYWORD_GROUPS = {
    "location_indicators": LOCATION_WORDS,
    "street_indicators": ["sokak", "sok", "sk", "cadde", "cad", "cd", "bulvar", "blv", "blvr"],
    "building_indicators": ["no", "numara", "num", ":"],
    "apartment_indicators": ["daire", "dair", "dr", "kat", "floor", "blok", "block"],
}

# slot name -> output field
SLOT_FIELDS = {
    "Mahalle": "neighborhood", "Sokak": "street", "Cadde": "street", "n": "number", "n2": "number",
    "n3": "number", "Daire": "apartment", "Kat": "floor", "Site": "building", "Blok": "block",
    "İl": "city", "İlçe": "district",
}

FIELDS = [
    "city", "district", "neighborhood", "street", "building", "block",
    "number", "entrance", "floor", "apartment", "postcode",
]
OUTPUT_ORDER = [
    "neighborhood", "street", "building", "block", "number", "entrance",
    "floor", "apartment", "district", "city", "postcode",
]
CSV_COLUMNS = [
    "country", "city", "district", "neighborhood", "street", "building", "block", "number", "entrance",
    "floor", "apartment", "postcode", "relation", "explanation_raw", "normalized_address",
    "confidence", "method", "warnings",
]
NO_ADDRESS_TEXT = "Adres bilgisi eksik"

# --- extraction rules: (field, pattern, value template, confidence, name) ----

RULES = [
    ("number", r"\b(?:no|num|numara|numero)\s*[:\s]*\s*(\d+[a-zA-Z]?)\b", "$1", 0.9, "number_word"),
    ("number", r"\b(\d+)\s*(?:nolu|numarali|sayili)\b", "$1", 0.85, "number_suffix"),
    ("block", r"\b([a-zA-Z])\s*blok\b", "$1", 0.9, "block_after"),
    ("block", r"\bblok\s*([a-zA-Z])\b", "$1", 0.9, "block_before"),
    ("floor", r"\bkat\s*[:\s]*\s*(\d+)\b", "$1", 0.9, "floor_word"),
    ("floor", r"\b(\d+)\s*\.?\s*kat\b", "$1", 0.9, "floor_ordinal"),
    ("floor", r"\bk(\d+)\b", "$1", 0.7, "floor_short"),
    ("apartment", r"\bdaire\s*[:\s]*\s*(\d+[a-zA-Z]?)\b", "$1", 0.9, "apartment_word"),
    ("apartment", r"\b(\d+[a-zA-Z]?)\s*(?:nolu\s*)?daire\b", "$1", 0.9, "apartment_suffix"),
    ("apartment", r"\bd(\d+[a-zA-Z]?)\b", "$1", 0.75, "apartment_short"),
    ("apartment", r"\bkapi\s*[:\s]*\s*(\d+[a-zA-Z]?)\b", "$1", 0.8, "door_word"),
    ("street", r"\b(\d+)\s*(?:\.?\s*)?sokak\b", "$1 Sokak", 0.85, "street_number"),
    ("street", r"\b(\d+)\s*sk\b", "$1 Sokak", 0.8, "street_short"),
    ("street", r"\b(.+?)\s+bulvari?\b", "$1 Bulvarı", 0.9, "boulevard"),
    ("street", r"\b(.+?)\s+bul\b", "$1 Bulvarı", 0.8, "boulevard_short"),
    ("street", r"\b(.+?)\s+caddesi?\b", "$1 Caddesi", 0.9, "avenue"),
    ("street", r"\b(.+?)\s+cad\b", "$1 Caddesi", 0.8, "avenue_short"),
]

CITY_WORDS = [
    "istanbul", "ankara", "izmir", "bursa", "antalya", "adana", "konya", "şanlıurfa", "gaziantep",
    "kocaeli", "mersin", "diyarbakır", "hatay", "manisa", "kayseri", "samsun", "balıkesir",
    "kahramanmaraş", "van", "aydın", "denizli", "muğla", "tekirdağ", "trabzon", "eskişehir",
    "malatya", "erzurum", "ordu", "afyonkarahisar", "tokat", "çorum", "kırıkkale", "uşak", "düzce",
    "osmaniye", "çanakkale", "kırşehir",
]
DISTRICT_WORDS = [
    "merkez", "center", "şehir", "belediye", "buca", "konak", "bornova", "karşıyaka", "alsancak",
    "çiğli", "gaziemir", "balçova", "narlıdere", "bayraklı", "güzelbahçe", "menemen", "urla",
    "seferihisar", "torbalı", "kemalpaşa", "foça", "selçuk", "tire", "ödemiş", "kiraz", "beydağ",
    "karaburun", "çeşme", "dikili", "bergama", "aliağa", "bayındır", "eşek", "doğanbey",
    "dağıstanhan", "akhisar", "soma", "kırkağaç", "yunusemre", "şehzadeler", "turgutlu", "alaşehir",
    "salihli", "sarıgöl", "gördes", "demirci", "köprübaşı", "ahmetli", "gölmarmara", "selendi",
]
NEIGHBORHOOD_WORDS = ["mahalle", "mahallesi", "mah", "neighborhood", "quarter", "district"]
STREET_WORDS = [
    "sokak", "sokağı", "sk", "street", "caddesi", "cadde", "cad", "avenue", "bulvarı", "bulvar",
    "bul", "boulevard", "yolu", "yol",
]

WARN_HEURISTIC = "Heuristic assignment - low confidence"
WARN_NONE = "No address components could be extracted"
WARN_FEW = "Very few address components extracted - low quality result"
WARN_NO_PLACE = "No city or district information found"
WARN_NO_STREET = "No street or neighborhood information found"
WARN_FALLBACK = "Processed using fallback rules - lower confidence"

# --- legacy extraction ------------------------------------------------------

LEGACY_ABBREVIATIONS = {
    "mh": "mahalle", "mah": "mahalle", "cd": "cadde", "cad": "cadde", "sk": "sokak", "blv": "bulvar",
    "no": "numara", "d": "daire", "da": "daire", "k": "kat",
    "ist": "İstanbul", "ank": "Ankara", "izm": "İzmir",
    "krs": "karşısı", "yan": "yanı", "ark": "arkası", "ust": "üstü", "alt": "altı",
}

# (component, pattern, ignore case, priority)
LEGACY_PATTERNS = [
    ("il", r"\b(\w+(?:\s+\w+)*)\s+(?:ili|il)\b", True, 3),
    ("ilce", r"\b(\w+(?:\s+\w+)*)\s+(?:ilçesi|ilçe)\b", True, 3),
    ("mahalle", r"\b(\w+(?:\s+\w+)*)\s+(?:mahallesi|mahalle|mah)\b", True, 3),
    ("sokak", r"\b(\w+(?:\s+\w+)*)\s+(?:caddesi|cadde|cad)\b", True, 3),
    ("sokak", r"\b(\w+(?:\s+\w+)*)\s+(?:sokağı|sokak|sk)\b", True, 3),
    ("sokak", r"\b(\w+(?:\s+\w+)*)\s+(?:bulvarı|bulvar|blv)\b", True, 3),
    ("bina_no", r"\b(?:no|numara|num)[:.]?\s*(\d+(?:/\d+)?)\b", True, 4),
    ("bina_no", r"\b(\d+(?:/\d+)?)\b", False, 1),
    ("daire_no", r"\b(?:daire|d|da|d\.)\s*[:.]?\s*(\d+)\b", True, 3),
    ("kat", r"\b(?:kat|k)\s*[:.]?\s*(\d+)\b", True, 3),
    ("site", r"\b(\w+(?:\s+\w+)*)\s+(?:sitesi|site)\b", True, 2),
    ("blok", r"\b([A-Z]\d*|\d+[A-Z]?)\s+(?:blok|blok)\b", True, 2),
]

# (component, pattern, priority, form of the value)
ENGINE_RULES = [
    ("il", r"\b(\w+(?:\s+\w+)*)\s+(?:ili|il)\b", 10, "title"),
    ("il", r"\b(İstanbul|Ankara|İzmir|Bursa|Antalya|Adana|Konya|Gaziantep|Kayseri|Mersin)\b", 8, "asis"),
    ("ilce", r"\b(\w+(?:\s+\w+)*)\s+(?:ilçesi|ilçe)\b", 9, "title"),
    ("mahalle", r"\b(\w+(?:\s+\w+)*)\s+(?:mahallesi|mahalle|mah)\b", 8, "title"),
    ("sokak", r"\b(\w+(?:\s+\w+)*)\s+(?:caddesi|cadde|cad)\b", 7, "title"),
    ("sokak", r"\b(\w+(?:\s+\w+)*)\s+(?:sokağı|sokak|sk)\b", 7, "title"),
    ("sokak", r"\b(\w+(?:\s+\w+)*)\s+(?:bulvarı|bulvar|blv)\b", 7, "title"),
    ("bina_no", r"\b(?:no|numara|num)[:.]?\s*(\d+(?:/\d+)?)\b", 6, "asis"),
    ("bina_no", r"\b(\d+(?:/\d+)?)\b", 2, "asis"),
    ("daire_no", r"\b(?:daire|d|da|d\.)\s*[:.]?\s*(\d+)\b", 5, "asis"),
    ("kat", r"\b(?:kat|k)\s*[:.]?\s*(\d+)\b", 5, "asis"),
    ("site", r"\b(\w+(?:\s+\w+)*)\s+(?:sitesi|site)\b", 4, "title"),
    ("blok", r"\b([A-Z]\d*|\d+[A-Z]?)\s+(?:blok|blok)\b", 4, "upper"),
    ("posta_kodu", r"\b(\d{5})\b", 3, "asis"),
]
LEGACY_COMPONENTS = [
    "il", "ilce", "mahalle", "sokak", "bina_no", "daire_no", "kat", "site", "blok", "posta_kodu",
]

LEGACY_PROVINCE_HINTS = [
    ("istanbul", "İstanbul"), ("ankara", "Ankara"), ("izmir", "İzmir"), ("bursa", "Bursa"),
    ("antalya", "Antalya"), ("adana", "Adana"), ("konya", "Konya"), ("gaziantep", "Gaziantep"),
    ("kayseri", "Kayseri"), ("mersin", "Mersin"),
]
COMMERCIAL_WORDS = ["mağaza", "dükkan", "ofis", "plaza", "avm", "merkez", "şirket"]
RESIDENTIAL_WORDS = ["ev", "daire", "apart", "site", "konut", "blok"]
LEGACY_PROVINCES = [
    "İstanbul", "Ankara", "İzmir", "Bursa", "Antalya", "Adana", "Konya", "Gaziantep", "Kayseri",
    "Mersin", "Diyarbakır", "Samsun", "Denizli", "Şanlıurfa", "Adapazarı", "Malatya", "Trabzon",
    "Van", "Erzurum", "Batman", "Elazığ", "Manisa", "Sivas", "Gebze", "Balıkesir", "Tarsus",
    "Kütahya", "Bandırma",
]
LEGACY_TURKISH_LETTERS = "ğıİşöüçĞIŞÖÜÇ"

# --- landmarks --------------------------------------------------------------

SUFFIXES = [
    "in", "ın", "un", "ün", "nin", "nın", "nun", "nün", "si", "sı", "su", "sü", "i", "ı", "u", "ü",
    "da", "de", "ta", "te", "dan", "den", "tan", "ten", "a", "e", "ya", "ye",
]
SUFFIX_WORDS = {
    "hastanesi": "hastane", "caminin": "cami", "çarşının": "çarşı", "köprünün": "köprü",
    "bankası": "banka", "eczanesi": "eczane", "postanesi": "postane", "belediyesi": "belediye",
}
RELATION_WORDS = {
    "across_from": ["karşısı", "karşısında", "karşı", "karşıda"],
    "next_to": ["yanı", "yanında", "yan", "yanda", "kenarı", "kenarında"],
    "behind": ["arkası", "arkasında", "arka", "arkada"],
    "in_front": ["önü", "önünde", "ön", "önde"],
    "above": ["üstü", "üstünde", "üst", "üstte", "tepesi", "tepesinde"],
    "below": ["altı", "altında", "alt", "altta"],
    "corner": ["köşesi", "köşesinde", "köşe", "köşede"],
    "entrance": ["girişi", "girişinde", "giriş", "girişte"],
    "inside": ["içi", "içinde", "iç", "içte"],
    "vicinity": ["civarı", "civarında", "çevresi", "çevresinde", "etrafı", "etrafında"],
}
LANDMARK_WORDS = [
    "hotel", "otel", "motel", "market", "süpermarket", "bakkal", "büfe", "park", "bahçe", "meydan",
    "okul", "üniversite", "hastane", "klinik", "banka", "atm", "postane", "ptt", "mosque", "cami",
    "kilise", "cafe", "kafe", "restoran", "lokanta", "benzinlik", "petrol", "akaryakıt", "eczane",
    "pharmacy", "avm", "alışveriş", "çarşı", "pazar", "terminal", "otogar", "durak", "köprü",
    "bridge", "tünel", "fabrika", "işyeri", "şirket",
]
LANDMARK_PHRASES = [("karşısı", "opposite"), ("yanı", "next_to"), ("arkası", "behind"), ("önü", "in_front_of")]
BRANDS = [
    ("mcdonald", "restaurant", "McDonald's"), ("starbucks", "cafe", "Starbucks"), ("migros", "market", "Migros"),
    ("bim", "market", "BİM"), ("a101", "market", "A101"), ("hospital", "hospital", "Hospital"),
    ("hastane", "hospital", "Hastane"), ("okul", "school", "Okul"), ("school", "school", "School"),
]

# --- explanation texts ------------------------------------------------------

TEXTS = {
    "tr": {"success": "Adres başarıyla normalleştirildi.", "error": "Hata: ", "low": "Uyarı: Düşük güven skoru", "high": "Yüksek güven ile normalleştirildi"},
    "en": {"success": "Address successfully normalized.", "error": "Error: ", "low": "Warning: Low confidence score", "high": "High confidence normalization"},
}
METHOD_TEXTS = {
    "hybrid": "Hibrit işleme yöntemi kullanıldı", "pattern": "Pattern tabanlı işleme yapıldı",
    "ml": "Makine öğrenmesi modeli kullanıldı", "fallback": "Yedek işleme yöntemi kullanıldı",
}

# --- quality ----------------------------------------------------------------

QUALITY_PROVINCES = [
    "istanbul", "ankara", "izmir", "bursa", "antalya", "adana", "konya", "gaziantep", "şanlıurfa",
    "kocaeli", "mersin", "diyarbakır", "hatay",
]
BONUS_WEIGHTS = {"il": 0.25, "ilce": 0.20, "mahalle": 0.15, "sokak": 0.15, "bina_no": 0.10, "posta_kodu": 0.10, "daire_no": 0.05}
COMPLETE_WEIGHTS = {"il": 0.25, "ilce": 0.20, "mahalle": 0.15, "sokak": 0.15, "bina_no": 0.10, "posta_kodu": 0.08, "daire_no": 0.05}
COVERAGE_BASE = {"pattern_primary": 0.8, "pattern_secondary": 0.6, "ml_primary": 0.7, "ml_secondary": 0.5, "hybrid": 0.9, "fallback": 0.3}

# --- entity labels: (label, pattern, group of the span), tried in this order --

LABELS_V1 = [
    ("MAH", r"\b(\w+(?:\s+\w+)*)\s+mah(?:allesi)?\.?\b"), ("MAH", r"\b(\w+(?:\s+\w+)*)\s+mahallesi\b"),
    ("SOKAK", r"\b(\w+(?:\s+\w+)*)\s+sok(?:ak)?\.?\b"), ("SOKAK", r"\b(\w+(?:\s+\w+)*)\s+sokak\b"), ("SOKAK", r"\b(\d+)\.?\s*sok(?:ak)?\.?\b"),
    ("CADDE", r"\b(\w+(?:\s+\w+)*)\s+cad(?:desi)?\.?\b"), ("CADDE", r"\b(\w+(?:\s+\w+)*)\s+caddesi\b"),
    ("BULVAR", r"\b(\w+(?:\s+\w+)*)\s+bulvarı?\b"),
    ("NO", r"\bno:?\s*(\d+[a-zA-Z]?)\b"), ("NO", r"\bnumara:?\s*(\d+[a-zA-Z]?)\b"),
    ("DAIRE", r"\bd\.?\s*(\d+)\b"), ("DAIRE", r"\bdaire:?\s*(\d+)\b"),
    ("KAT", r"\bk\.?\s*(\d+)\b"), ("KAT", r"\bkat:?\s*(\d+)\b"),
]
LABELS_V2 = [
    ("MAH", r"\b(\w+(?:\s+\w+)*)\s+mahallesi\b"), ("MAH", r"\b(\w+(?:\s+\w+)*)\s+mah\.?\b"),
    ("CADDE", r"\b(\w+(?:\s+\w+)*)\s+caddesi\b"), ("CADDE", r"\b(\w+(?:\s+\w+)*)\s+cad\.?\b"),
    ("SOKAK", r"\b(\w+(?:\s+\w+)*)\s+sokağı?\b"), ("SOKAK", r"\b(\w+(?:\s+\w+)*)\s+sok\.?\b"), ("SOKAK", r"\b(\d+)\.?\s*sok(?:ak)?\.?\b"),
    ("BULVAR", r"\b(\w+(?:\s+\w+)*)\s+bulvarı?\b"), ("BULVAR", r"\b(\w+(?:\s+\w+)*)\s+bul\.?\b"),
    ("NO", r"\bno:?\s*(\d+[a-zA-Z]?)\b"), ("NO", r"\bnumara:?\s*(\d+[a-zA-Z]?)\b"), ("NO", r"\b(\d+)\s*(?=\s|$|[.,])"),
    ("DAIRE", r"\bd\.?\s*(\d+)\b"), ("DAIRE", r"\bdaire:?\s*(\d+)\b"),
    ("KAT", r"\bk\.?\s*(\d+)\b"), ("KAT", r"\bkat:?\s*(\d+)\b"),
]
LABEL_CITIES_V1 = "ankara istanbul izmir bursa antalya adana konya muğla fethiye çeşme dikili bodrum marmaris".split()
LABEL_CITIES_V2 = LABEL_CITIES_V1 + "denizli aydın manisa balıkesir çanakkale eskişehir kütahya".split()
LABEL_DISTRICTS_V1 = "çankaya beşiktaş kadıköy üsküdar fatih beyoğlu karşıyaka bornova konak buca çiğli güzelbahçe".split()
LABEL_DISTRICTS_V2 = LABEL_DISTRICTS_V1 + "gaziemir karabağlar bayraklı efeler menteşe".split()
LABEL_ORDER = ["MAH", "CADDE", "SOKAK", "BULVAR", "NO", "DAIRE", "KAT", "IL", "ILCE"]
