"""Languages, scripts and digits as fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Unicode ranges of each script, in the order that breaks ties.
SCRIPTS: dict[str, str] = {
    "latin": "41-5A 61-7A C0-24F 1E00-1EFF",
    "arabic": "600-6FF 750-77F 8A0-8FF FB50-FDFF FE70-FEFF",
    "hebrew": "590-5FF FB1D-FB4F",
    "syriac": "700-74F",
    "thaana": "780-7BF",
    "cyrillic": "400-4FF 500-52F",
    "greek": "370-3FF 1F00-1FFF",
    "armenian": "530-58F",
    "georgian": "10A0-10FF",
    "devanagari": "900-97F",
    "bengali": "980-9FF",
    "gurmukhi": "A00-A7F",
    "gujarati": "A80-AFF",
    "oriya": "B00-B7F",
    "tamil": "B80-BFF",
    "telugu": "C00-C7F",
    "kannada": "C80-CFF",
    "malayalam": "D00-D7F",
    "sinhala": "D80-DFF",
    "thai": "E00-E7F",
    "lao": "E80-EFF",
    "tibetan": "F00-FFF",
    "myanmar": "1000-109F",
    "ethiopic": "1200-139F",
    "khmer": "1780-17FF",
    "han": "3400-4DBF 4E00-9FFF F900-FAFF",
    "kana": "3040-30FF 31F0-31FF",
    "hangul": "1100-11FF 3130-318F AC00-D7AF",
}
UNSPACED = ("han", "kana", "thai", "lao", "khmer", "myanmar", "tibetan")
RIGHT_TO_LEFT = ("arabic", "hebrew", "syriac", "thaana")

# Code, English name, scripts.
LANGUAGES: list[tuple[str, str, tuple[str, ...]]] = [
    ("en", "English", ("latin",)), ("fr", "French", ("latin",)), ("es", "Spanish", ("latin",)), ("pt", "Portuguese", ("latin",)),
    ("it", "Italian", ("latin",)), ("de", "German", ("latin",)), ("nl", "Dutch", ("latin",)), ("sv", "Swedish", ("latin",)),
    ("no", "Norwegian", ("latin",)), ("da", "Danish", ("latin",)), ("fi", "Finnish", ("latin",)), ("pl", "Polish", ("latin",)),
    ("cs", "Czech", ("latin",)), ("sk", "Slovak", ("latin",)), ("ro", "Romanian", ("latin",)), ("hu", "Hungarian", ("latin",)),
    ("hr", "Croatian", ("latin",)), ("tr", "Turkish", ("latin",)), ("id", "Indonesian", ("latin",)), ("ms", "Malay", ("latin",)),
    ("vi", "Vietnamese", ("latin",)), ("sw", "Swahili", ("latin",)), ("tl", "Tagalog", ("latin",)), ("az", "Azerbaijani", ("latin",)),
    ("uz", "Uzbek", ("latin",)), ("ru", "Russian", ("cyrillic",)), ("uk", "Ukrainian", ("cyrillic",)), ("bg", "Bulgarian", ("cyrillic",)),
    ("sr", "Serbian", ("cyrillic", "latin")), ("kk", "Kazakh", ("cyrillic",)), ("el", "Greek", ("greek",)), ("hy", "Armenian", ("armenian",)),
    ("ka", "Georgian", ("georgian",)), ("ar", "Arabic", ("arabic",)), ("fa", "Persian", ("arabic",)), ("ur", "Urdu", ("arabic",)),
    ("ps", "Pashto", ("arabic",)), ("ku", "Kurdish (Sorani)", ("arabic",)), ("ug", "Uyghur", ("arabic",)), ("he", "Hebrew", ("hebrew",)),
    ("yi", "Yiddish", ("hebrew",)), ("dv", "Dhivehi", ("thaana",)), ("hi", "Hindi", ("devanagari",)), ("mr", "Marathi", ("devanagari",)),
    ("ne", "Nepali", ("devanagari",)), ("bn", "Bengali", ("bengali",)), ("pa", "Punjabi", ("gurmukhi",)), ("gu", "Gujarati", ("gujarati",)),
    ("or", "Odia", ("oriya",)), ("ta", "Tamil", ("tamil",)), ("te", "Telugu", ("telugu",)), ("kn", "Kannada", ("kannada",)),
    ("ml", "Malayalam", ("malayalam",)), ("si", "Sinhala", ("sinhala",)), ("th", "Thai", ("thai",)), ("lo", "Lao", ("lao",)),
    ("km", "Khmer", ("khmer",)), ("my", "Burmese", ("myanmar",)), ("am", "Amharic", ("ethiopic",)), ("bo", "Tibetan", ("tibetan",)),
    ("zh", "Chinese (Simplified)", ("han",)), ("zh-tw", "Chinese (Traditional)", ("han",)), ("ja", "Japanese", ("kana", "han")), ("ko", "Korean", ("hangul",)),
]
ALIASES = {
    "zh-cn": "zh", "zh-hans": "zh", "zh-hant": "zh-tw", "iw": "he", "pt-br": "pt", "pt-pt": "pt",
    "en-us": "en", "en-gb": "en", "ckb": "ku", "nb": "no", "fil": "tl",
}
# The language that a main script stands for.
SCRIPT_LANGUAGE = {
    "arabic": "ar", "hebrew": "he", "cyrillic": "ru", "greek": "el", "han": "zh", "hangul": "ko", "devanagari": "hi",
    "thai": "th", "bengali": "bn", "tamil": "ta", "armenian": "hy", "georgian": "ka", "ethiopic": "am",
}
# Frequent words that tell languages of the Latin script apart, in the order that breaks ties.
STOP_WORDS = {
    "en": "the and of to is in that it for with as are this be on not you was have from by or will can your which an",
    "fr": "le la les et des est une que dans pour pas qui sur du avec",
    "es": "el la los las de que y en un una es por para con del se",
    "pt": "o a os as de que e em um uma para com não do da se",
    "it": "il la di che e un una per non sono del della con si gli",
    "de": "der die das und ist nicht ein eine zu mit den von sie es auf",
    "nl": "de het een en van is dat op te niet zijn voor met die",
    "sv": "och att det som en är på för med inte av till den",
    "pl": "i w nie się na to że jest do z jak co ale",
    "tr": "ve bir bu da de için ile çok ne gibi olarak daha",
    "id": "dan yang di ini itu dengan untuk tidak dari dalam akan",
}
# Where the ten digits of each script begin.
DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0x17E0, 0x1040, 0xFF10)
FROM_DIGITS = "".join(chr(z + i) for z in DIGIT_ZEROS for i in range(10)) + "٫٬"
TO_DIGITS = "0123456789" * len(DIGIT_ZEROS) + ".,"

#: Scripts whose ranges have ASCII characters.
WITH_ASCII = frozenset(s for s, ranges in SCRIPTS.items() if any(int(r.split("-")[0], 16) < 0x80 for r in ranges.split()))
BY_CODE = {code: (name, scripts) for code, name, scripts in LANGUAGES}


def class_body(*scripts: str) -> str:
    """Inside of a character class for scripts."""
    ranges = (r.split("-") for s in scripts for r in SCRIPTS.get(s, "").split())
    return "".join(rf"\x{{{low}}}-\x{{{high}}}" for low, high in ranges)


def normal_code(code: str | None) -> str:
    """A language code in lower case, with its alias followed and its region dropped if only the base is known."""
    code = (code or "").strip().lower().replace("_", "-")
    code = ALIASES.get(code, code)
    return code if code in BY_CODE or code.split("-")[0] not in BY_CODE else code.split("-")[0]


def describe(code: str | None) -> dict:
    """Name, scripts, direction and spacing of a language; unknown codes are left to right, with no script."""
    code = normal_code(code)
    name, scripts = BY_CODE.get(code, (code, ()))
    rtl = bool(scripts) and scripts[0] in RIGHT_TO_LEFT
    return {"code": code, "name": name, "scripts": list(scripts), "dir": "rtl" if rtl else "ltr", "unspaced": any(s in UNSPACED for s in scripts), "known": code in BY_CODE}


def language_table(spark: SparkSession) -> DataFrame:
    """The languages as a small dimension table."""
    rows = [tuple(describe(code).values()) for code, _, _ in LANGUAGES]
    return spark.createDataFrame(rows, "code string, name string, scripts array<string>, dir string, unspaced boolean, known boolean")
