"""Unit spelling, scale and dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_number

# Canonical spelling used when an answer is checked against evidence.
UNIT_CANONICAL = {
    "pa": "па", "kpa": "кпа", "mpa": "мпа", "gpa": "гпа",
    "g/l": "г/л", "mg/l": "мг/л", "ug/l": "мкг/л", "µg/l": "мкг/л", "mcg/l": "мкг/л", "kg/l": "кг/л",
    "g/m3": "г/м³", "mg/m3": "мг/м³", "ug/m3": "мкг/м³", "kg/m3": "кг/м³", "t/m3": "т/м³",
    "g/t": "г/т", "mg/t": "мг/т", "kg/t": "кг/т",
    "mm": "мм", "cm": "см", "km": "км", "ml": "мл", "l": "л", "g": "г", "kg": "кг", "t": "т", "m": "м",
    "mg": "мг", "ug": "мкг", "mg/day": "мг/сут", "mg/d": "мг/сут", "мг/день": "мг/сут", "мг/day": "мг/сут",
    "percent": "%", "ratio": "раз",
}

# Units written as words, matched by their beginning in this order.
UNIT_WORDS = (
    ("процент", "%"), ("килограмм", "кг"), ("грамм", "г"), ("миллиграмм", "мг"), ("тонна", "т"), ("тонн", "т"),
    ("литр", "л"), ("миллилитр", "мл"), ("метр", "м"), ("миллиметр", "мм"), ("сантиметр", "см"), ("паскаль", "па"),
    ("паскаля", "па"), ("паскалей", "па"), ("мегапаскаль", "мпа"), ("мегапаскаля", "мпа"), ("мегапаскалей", "мпа"),
    ("килопаскаль", "кпа"), ("килопаскаля", "кпа"), ("килопаскалей", "кпа"),
)

# Scale of a unit against the base unit of its dimension, by canonical spelling.
UNIT_SCALES = {
    "па": 1.0, "кпа": 1e3, "мпа": 1e6, "гпа": 1e9,
    "г/л": 1.0, "мг/л": 1e-3, "мкг/л": 1e-6, "кг/л": 1e3,
    "г/м³": 1.0, "мг/м³": 1e-3, "кг/м³": 1e3, "т/м³": 1e6,
    "г/т": 1.0, "мг/т": 1e-3, "кг/т": 1e3, "%": 1.0, "°c": 1.0,
    "мм": 1e-3, "см": 1e-2, "м": 1.0, "км": 1e3,
    "г": 1e-3, "мг": 1e-6, "мкг": 1e-9, "кг": 1.0, "т": 1e3, "л": 1.0, "мл": 1e-3, "мг/сут": 1e-6,
}
UNIT_DIMENSIONS = {
    "г": "mass", "мг": "mass", "мкг": "mass", "кг": "mass", "т": "mass", "мг/сут": "mass_per_day",
    "мм": "length", "см": "length", "м": "length", "км": "length", "мл": "volume", "л": "volume",
    "па": "pressure", "кпа": "pressure", "мпа": "pressure", "гпа": "pressure",
}

# Printed unit by lower-case spelling; comparison tables group by it.
UNIT_LABELS = {
    "%": "%", "percent": "%", "°c": "°C", "°с": "°C", "ratio": "раз", "раз": "раз",
    "па": "Па", "кпа": "кПа", "мпа": "МПа", "гпа": "ГПа", "pa": "Па", "kpa": "кПа", "mpa": "МПа", "gpa": "ГПа",
    "г/л": "г/л", "мг/л": "мг/л", "мкг/л": "мкг/л", "кг/л": "кг/л",
    "g/l": "г/л", "mg/l": "мг/л", "ug/l": "мкг/л", "µg/l": "мкг/л", "mcg/l": "мкг/л", "kg/l": "кг/л",
    "г/м³": "г/м³", "мг/м³": "мг/м³", "мкг/м³": "мкг/м³", "кг/м³": "кг/м³", "т/м³": "т/м³",
    "g/m3": "г/м³", "mg/m3": "мг/м³", "ug/m3": "мкг/м³", "kg/m3": "кг/м³", "t/m3": "т/м³",
    "г/м3": "г/м³", "мг/м3": "мг/м³", "мкг/м3": "мкг/м³", "кг/м3": "кг/м³", "т/м3": "т/м³",
    "г/т": "г/т", "мг/т": "мг/т", "кг/т": "кг/т", "g/t": "г/т", "mg/t": "мг/т", "kg/t": "кг/т",
    "мм": "мм", "см": "см", "м": "м", "км": "км", "mm": "мм", "cm": "см", "m": "м", "km": "км",
    "г": "г", "мг": "мг", "мкг": "мкг", "кг": "кг", "т": "т", "л": "л", "мл": "мл",
    "g": "г", "mg": "мг", "ug": "мкг", "kg": "кг", "t": "т", "l": "л", "ml": "мл",
    "квт·ч/м³": "кВт·ч/м³", "квт·ч/м3": "кВт·ч/м³", "квт-ч/м³": "кВт·ч/м³", "квт-ч/м3": "кВт·ч/м³",
    "квт·ч/т": "кВт·ч/т", "квт-ч/т": "кВт·ч/т", "квт·ч": "кВт·ч", "квт-ч": "кВт·ч",
    "kwh/m3": "кВт·ч/м³", "kwh/t": "кВт·ч/т", "kwh": "кВт·ч",
}
UNIT_STEMS = (
    ("мегапаскал", "МПа"), ("килопаскал", "кПа"), ("миллиграмм", "мг"), ("миллилитр", "мл"), ("миллиметр", "мм"),
    ("сантиметр", "см"), ("килограмм", "кг"), ("процент", "%"), ("паскаль", "Па"), ("тонна", "т"), ("литр", "л"),
    ("метр", "м"), ("грамм", "г"),
)

_UNIT_LETTERS = "[а-яёА-ЯЁa-zA-Z°/%²³]+"


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def once(col: Column, make) -> Column:
    """``make`` of a value that is worked out a single time, however often it is used."""
    return F.get(F.transform(F.array(col), make), F.lit(0))


def _by_word(col: Column, table) -> Column:
    is_word = (F.length(col) >= 4) & col.rlike("[а-яё]")
    return F.when(is_word, F.coalesce(*[F.when(col.startswith(stem), F.lit(unit)) for stem, unit in table]))


def unit_key(col: Column) -> Column:
    """One spelling for a unit: case, alphabet and word endings do not make another unit."""
    return once(F.lower(F.trim(col)), lambda low: F.coalesce(lookup(UNIT_CANONICAL, low), _by_word(low, UNIT_WORDS), low))


def unit_label(col: Column) -> Column:
    """Printed unit; an unknown unit stays as in the source."""
    unit = F.trim(F.coalesce(col, F.lit("")))
    low = F.lower(unit)
    return F.coalesce(lookup(UNIT_LABELS, low), _by_word(low, UNIT_STEMS), unit)


def label_key(col: Column) -> Column:
    return F.lower(unit_label(col))


def unit_scale(col: Column) -> Column:
    return lookup(UNIT_SCALES, unit_key(col))


def unit_dimension(col: Column) -> Column:
    return lookup(UNIT_DIMENSIONS, unit_key(col))


def _mention(number: Column, unit: Column) -> Column:
    value = once(F.replace(number, F.lit(","), F.lit(".")).cast("double"), plain_number)
    return F.struct(value.alias("number"), unit_scale(unit).alias("scale"), unit.alias("unit"))


def unit_mentions(col: Column) -> Column:
    """Numbers with the unit behind them, in text order; the unit of a range belongs to both ends."""
    return once(F.regexp_replace(col, r"(?iu)\b(мг|mg)\s+(?:в\s+сутки|в\s+день|per\s+day)\b", "$1/day"), _mentions)


_SPACE, _DIGITS, _DASHES = " \t\n\x0b\f\r", "0123456789.,", "–—-"


def _mentions(text: Column) -> Column:
    number = r"\d+(?:[.,]\d+)?"
    pieces = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Digits, blanks and dashes are no part of a unit, so a piece is taken apart by its ends.
    unit = lambda piece, before: F.ltrim(piece, F.lit(before + _SPACE))
    ahead = lambda piece, u: F.left(piece, F.length(piece) - F.length(u))
    single = lambda piece: once(unit(piece, _DIGITS), lambda u: _mention(F.rtrim(ahead(piece, u), F.lit(_SPACE)), u))
    cut = lambda piece, u, i: F.btrim(F.substring_index(F.translate(ahead(piece, u), "–—", "--"), "-", i), F.lit(_SPACE))
    ends = lambda piece: once(unit(piece, _DIGITS + _DASHES), lambda u: F.array(_mention(cut(piece, u, 1), u), _mention(cut(piece, u, -1), u)))
    singles = F.transform(pieces(rf"{number}\s*{_UNIT_LETTERS}"), single)
    return F.concat(singles, F.flatten(F.transform(pieces(rf"{number}\s*[{_DASHES}]\s*{number}\s*{_UNIT_LETTERS}"), ends)))
