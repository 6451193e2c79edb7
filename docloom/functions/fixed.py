"""Codes, names and words on which results depend. They are facts of the domain, stated as they are."""

# --- fixed values -------------------------------------------------------------------------------------------------
#: Cyrillic letters in Latin script (lower case).
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ғ": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i",
    "й": "y", "к": "k", "қ": "q", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ў": "o", "ф": "f", "х": "x", "ҳ": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "i",
    "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Cyrillic letters that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "І": "I", "Ј": "J", "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x",
}
#: ISO 4217 numbers.
CURRENCIES = {
    "840": "USD", "978": "EUR", "860": "UZS", "643": "RUB", "156": "CNY", "392": "JPY", "826": "GBP", "756": "CHF",
    "398": "KZT", "417": "KGS", "972": "TJS", "934": "TMT", "944": "AZN", "051": "AMD", "981": "GEL", "949": "TRY",
    "784": "AED", "410": "KRW", "356": "INR", "124": "CAD", "036": "AUD", "702": "SGD", "344": "HKD", "985": "PLN",
    "203": "CZK",
}
CURRENCY_WORDS = {
    "USD": ["usd", "dollar", "doll", "$"], "EUR": ["eur", "evro", "euro", "€"], "UZS": ["uzs", "sum", "som"],
    "RUB": ["rub", "rubl", "ruble"], "CNY": ["cny", "yuan", "juan", "rmb", "renminbi"],
    "GBP": ["gbp", "funt", "pound", "sterling", "£"], "JPY": ["jpy", "iena", "yen"],
    "CHF": ["chf", "frank", "franc", "shveycar"], "KZT": ["kzt", "tenge"], "KGS": ["kgs", "som", "sum"],
    "TJS": ["tjs", "somoni"], "TRY": ["try", "lira"], "AED": ["aed", "dirham", "dirxam"], "KRW": ["krw", "von", "won"],
    "INR": ["inr", "rupi", "rupee"], "AZN": ["azn", "manat"], "TMT": ["tmt", "manat"], "GEL": ["gel", "lari"],
    "AMD": ["amd", "dram"],
}
#: ISO 3166 numbers and the names in use.
COUNTRIES = {
    "156": ["CN", "China", "Китай", "Xitoy", "КНР", "PRC"],
    "860": ["UZ", "Uzbekistan", "Узбекистан", "O'zbekiston", "Ўзбекистон"],
    "643": ["RU", "Russia", "Россия", "Rossiya", "Российская Федерация", "РФ"],
    "398": ["KZ", "Kazakhstan", "Казахстан", "Qozog'iston"],
    "417": ["KG", "Kyrgyzstan", "Кыргызстан", "Qirg'iziston", "Киргизия"],
    "762": ["TJ", "Tajikistan", "Таджикистан", "Tojikiston"],
    "795": ["TM", "Turkmenistan", "Туркменистан", "Turkmaniston"],
    "004": ["AF", "Afghanistan", "Афганистан", "Afg'oniston"],
    "276": ["DE", "Germany", "Германия", "Germaniya", "BRD", "ФРГ"],
    "792": ["TR", "Turkey", "Turkish", "Türkiye", "Turkiye", "Турция", "Turkiya"],
    "410": ["KR", "Korea", "Южная Корея", "Koreya", "Republic of Korea"],
    "392": ["JP", "Japan", "Япония", "Yaponiya"],
    "356": ["IN", "India", "Индия", "Hindiston"],
    "586": ["PK", "Pakistan", "Пакистан", "Pokiston"],
    "364": ["IR", "Iran", "Иран", "Eron"],
    "784": ["AE", "UAE", "ОАЭ", "BAA", "United Arab Emirates", "Эмираты"],
    "840": ["US", "USA", "США", "AQSH", "United States", "Америка"],
    "826": ["GB", "UK", "Великобритания", "Buyuk Britaniya", "England"],
    "250": ["FR", "France", "Франция", "Fransiya"],
    "380": ["IT", "Italy", "Италия", "Italiya"],
    "724": ["ES", "Spain", "Испания", "Ispaniya"],
    "616": ["PL", "Poland", "Польша", "Polsha"],
    "112": ["BY", "Belarus", "Беларусь", "Belorussiya", "Белоруссия"],
    "804": ["UA", "Ukraine", "Украина", "Ukraina"],
    "031": ["AZ", "Azerbaijan", "Азербайджан", "Ozarbayjon"],
    "051": ["AM", "Armenia", "Армения", "Armaniston"],
    "268": ["GE", "Georgia", "Грузия", "Gruziya"],
    "704": ["VN", "Vietnam", "Вьетнам", "Vyetnam"],
    "764": ["TH", "Thailand", "Таиланд", "Tailand"],
    "458": ["MY", "Malaysia", "Малайзия", "Malayziya"],
    "360": ["ID", "Indonesia", "Индонезия", "Indoneziya"],
    "528": ["NL", "Netherlands", "Нидерланды", "Niderlandiya", "Голландия"],
    "056": ["BE", "Belgium", "Бельгия", "Belgiya"],
    "756": ["CH", "Switzerland", "Швейцария", "Shveytsariya"],
    "348": ["HU", "Hungary", "Венгрия", "Vengriya"],
    "203": ["CZ", "Czech", "Чехия", "Chexiya"],
    "100": ["BG", "Bulgaria", "Болгария", "Bolgariya"],
    "642": ["RO", "Romania", "Румыния", "Ruminiya"],
    "428": ["LV", "Latvia", "Латвия", "Latviya"],
    "440": ["LT", "Lithuania", "Литва", "Litva"],
    "233": ["EE", "Estonia", "Эстония", "Estoniya"],
}
DOMESTIC = "860"
UNITS = {
    "796": ["шт", "шт.", "штука", "штук", "дона", "dona", "pcs", "piece", "pc", "unit", "units", "ед", "ед.", "единица",
            "единиц", "birlik", "birlik dona", "комплект", "комплекты", "komplekt", "набор", "наборы", "nabor", "кассета",
            "кассеты", "kasseta", "set", "sets"],
    "166": ["кг", "кг.", "kg", "килограмм", "kilogramm", "т", "т.", "тн", "тонна", "тонн", "tonna", "tonn", "ton", "mt"],
    "168": ["т", "т.", "тн", "тонна", "тонн", "tonna", "tonn", "ton", "mt"],
    "006": ["м", "метр", "metr", "m"], "055": ["м2", "кв.м", "kv.m", "m2"], "113": ["м3", "куб.м", "kub.m", "m3"],
    "112": ["л", "литр", "litr", "l"], "715": ["пара", "пар", "juft", "pair"], "778": ["упак", "упаковка", "o'ram", "pack"],
    "736": ["рулон", "rulon", "roll"], "625": ["лист", "varaq", "sheet"],
    "704": ["набор", "to'plam", "set", "komplekt", "комплект"], "839": ["комплект", "komplekt", "set"],
}
TRADE_TERMS = {
    "01": "EXW", "02": "FCA", "03": "FAS", "04": "FOB", "05": "CFR", "06": "CIF", "07": "CPT", "08": "CIP", "09": "DAF",
    "10": "DES", "11": "DEQ", "12": "DDU", "13": "DDP", "14": "DAP", "15": "DAT",
}
CURRENT_TERMS = ["EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP"]
OLD_TERMS = {"DAT": "DPU", "DAF": "DAP", "DES": "DAP", "DEQ": "DPU", "DDU": "DAP"}
CONTRACT_TYPES = {"01": "export", "02": "import"}
#: Contract types without a receiver.
NO_RECEIVER_TYPES = ["10", "13", "22", "98", "99"]
MONTHS = {
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9,
    "октября": 10, "ноября": 11, "декабря": 12, "yanvar": 1, "fevral": 2, "mart": 3, "aprel": 4, "may": 5, "iyun": 6,
    "iyul": 7, "avgust": 8, "sentyabr": 9, "oktyabr": 10, "noyabr": 11, "dekabr": 12, "january": 1, "february": 2,
    "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11,
    "december": 12,
}
LEGAL_FORMS = [
    "ooo", "oao", "zao", "ao", "pao", "chp", "ip", "npo", "aj", "xk", "mchj", "yatt", "qmj", "jsc", "llc", "ltd", "co",
    "inc", "corp", "gmbh", "ag", "sa", "srl", "spa", "bv", "plc", "pte", "pvt", "hozyaystvennoe", "obschestvo", "hususiy",
    "korhona", "korhonasi", "jamiyat", "jamiyati", "korxona", "korxonasi", "masuliyati", "cheklangan", "ogranichennoy",
    "otvetstvennostyu", "aksiyadorlik", "ochiq", "yopiq", "fermer", "fermerskoe", "hojaligi", "hozyaystvo", "fh",
]
#: The first name of each line stands for the others.
PLACES = [
    ["Buxoro", "Buhara", "Bukhara", "Бухара"], ["Toshkent", "Tashkent", "Ташкент"], ["Samarqand", "Samarkand", "Самарканд"],
    ["Andijon", "Andijan", "Андижан"], ["Namangan", "Наманган"], ["Navoiy", "Navoi", "Навои"], ["Urganch", "Urgench", "Ургенч"],
    ["Nukus", "Нукус"], ["Qarshi", "Karshi", "Карши"], ["Termiz", "Termez", "Термез"], ["Guliston", "Gulistan", "Гулистан"],
    ["Xiva", "Khiva", "Хива"], ["Jizzax", "Djizzax", "Djizak", "Jizzakh", "Джизак", "Джизах"],
    ["Fargona", "Farona", "Fergana", "Фергана"], ["Sirdaryo", "Sirdarya", "Сырдарья"],
    ["Qashqadaryo", "Kashkadarya", "Кашкадарья"], ["Surxondaryo", "Surxandarya", "Сурхандарья"], ["Xorazm", "Khorezm", "Хорезм"],
]
ADDRESS_WORDS = [
    "tuman", "tumani", "rayon", "rayona", "rayoni", "viloyat", "viloyati", "oblast", "oblasti", "shahar", "shahri", "shaxar",
    "gorod", "goroda", "respublika", "respublikasi", "respubliki", "dom", "uyi", "ulitsa", "kocha", "kochasi", "mahalla",
    "mahallasi", "mfy", "mfj", "territoriya", "territoriyasi", "dvor", "street", "building", "poselok", "qishloq", "kishlak",
    "qishlogi", "kishlogi", "qishlog", "kishlog", "mahallya", "aholi", "punkti", "obl", "prospekt", "proezd", "region",
    "district", "city", "town", "village", "area", "zone", "zona", "zonasi", "free", "erkin", "ozod", "svobodnaya",
    "svobodnoy", "economic", "iqtisodiy", "ekonomicheskaya", "ekonomicheskoy", "hudud", "hududi", "hududiy", "massif",
    "massiv", "massivi", "massiva", "industrial", "sanoat", "promyshlennaya", "sez", "fez", "eiz", "road", "avenue", "block",
    "kvartal", "mikrorayon", "microrayon", "house", "republic", "uzbekistan", "ozbekiston", "uzbekiston", "ozbekistan",
]
ADJECTIVE_ENDINGS = [
    "inskaya", "inskoy", "inskiy", "evskaya", "evskiy", "ovskaya", "ovskiy", "skaya", "skoy", "skoe", "skie", "skogo", "skom",
    "skiy", "skij",
]
KEYWORDS = {"inn": ["инн", "inn", "стир", "stir"], "mfo": ["мфо", "mfo"], "swift": ["swift", "свифт", "bic", "бик"]}
IGNORED_HEADERS = ["t/r", "т/р", "№", "no", "n", "-", "—", ""]
SKIPPED_CLASSES = ["INDEXES_ON_REF", "COMMENT", "CHANGES_ORIGINS"]
TABLE_CLASSES = ["BY_DEFAULT", "TABLE_STD", "TABLE_STD2"]
TITLE_CLASSES = ["ACT_TITLE", "ACT_TITLE_APPL", "APPL_BANNER_LANDSCAPE_TITLE"]
JUNK_CLASSES = ["lx_elem2", "lx_no_select"]
TOTAL_ROW = r"(?iu)итого|всего|jami|жами|total\b"
CONTRACT_NUMBER = r"(?iu)(?:договор|контракт|contract|shartnoma|kontrakt|№)[^\S\n]*(?:№|No\.?|N|#)?[^\S\n]*([A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9/\-\.]{0,30})"
AMOUNT = r"(?<![\d.,])\d{1,3}(?:[  ]?\d{3})*(?:[.,]\d{1,2})?(?![\d])"
#: Labels of recognised blocks to our kinds, and those that are left out.
BLOCK_KINDS = {
    "Table": "table", "Form": "table", "Text": "text", "ListGroup": "text", "Caption": "text", "Footnote": "text", "Code": "text", "Bibliography": "text",
    "TableOfContents": "text", "Equation": "text", "SectionHeader": "section-header", "PageHeader": "page-header", "PageFooter": "page-footer",
}
SKIPPED_BLOCKS = ["Picture", "Figure", "Diagram", "ChemicalBlock", "BlankPage"]
