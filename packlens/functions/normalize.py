"""Normal forms of declared values, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Currency marks and units that packs print.
CURRENCY_TOKENS = ("₹", "rs.", "rs", "inr", "mrp", "/-")
MASS_TO_G = {
    "g": 1.0, "gm": 1.0, "gms": 1.0, "gram": 1.0, "grams": 1.0,
    "kg": 1000.0, "kgs": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "mg": 0.001,
}
VOLUME_TO_ML = {
    "ml": 1.0, "millilitre": 1.0, "millilitres": 1.0, "milliliter": 1.0,
    "l": 1000.0, "ltr": 1000.0, "litre": 1000.0, "litres": 1000.0, "liter": 1000.0,
}


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


#: Letters, marks and punctuation that form NFKC leaves as they are, whatever stands beside them.
STABLE = "\\x00-\\x7FÀ-ÖØ-öø-ÿ₹–—‘’“”\u0900-\u093B\u093D-\u0957\u0960-\u097F"


def nfkc(c: Column) -> Column:
    """Unicode form NFKC. Only values with other characters than STABLE reach Python: Spark has no such function."""
    odd = F.regexp_like(c, F.lit(f"[^{STABLE}]"))
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def _round(c: Column, scale: float) -> Column:
    """floor(x + 0.5) on the binary product, which is not Spark's decimal rounding."""
    return F.floor(c * scale + 0.5) / scale


def norm_text(c: Column, compatible: bool = True) -> Column:
    """Lower case, letters, digits, marks and .@+_- only, blanks collapsed; null is ''.

    compatible: apply NFKC first; off where the input is known to be in that form.
    """
    c = F.coalesce(c, F.lit(""))
    c = F.lower(F.replace(nfkc(c) if compatible else c, F.lit("​"), F.lit("")))
    # blanks and what is not kept, in one run over the text
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}.@+_-]+", " "))


def nfkc_all(values: Column) -> Column:
    """An array of texts in form NFKC: as one text, since Python functions cannot stand in a lambda."""
    return F.split(nfkc(F.array_join(values, "\x1f")), "\x1f")


def norm_money(c: Column, compatible: bool = True) -> Column:
    """The first number once currency marks and commas are gone, to 2 places; null without one."""
    c = F.lower(nfkc(c) if compatible else c)
    for token in CURRENCY_TOKENS:
        c = F.replace(c, F.lit(token), F.lit(" "))
    number = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"[0-9]+(?:\.[0-9]+)?", 0)
    return _round(number.try_cast("double"), 100.0)


def norm_quantity(c: Column, compatible: bool = True) -> Column:
    """(magnitude, unit) in g or ml, to 4 places, of the first number with a word; null for other words."""
    c = F.replace(F.lower(nfkc(c) if compatible else c), F.lit(","), F.lit(""))
    pattern = r"([0-9]+(?:[.,][0-9]+)?)\s*([a-zA-Z]+)"
    number, unit = F.regexp_extract(c, pattern, 1).try_cast("double"), F.regexp_extract(c, pattern, 2)
    units = {**{u: (k, "g") for u, k in MASS_TO_G.items()}, **{u: (k, "ml") for u, k in VOLUME_TO_ML.items()}}
    factor, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k in sorted({v for v in units.values()}):
        same = unit.isin([u for u, v in units.items() if v == k])
        factor, name = F.when(same, F.lit(k[0])).otherwise(factor), F.when(same, F.lit(k[1])).otherwise(name)
    return F.when(number.isNotNull() & factor.isNotNull(), F.struct(_round(number * factor, 10000.0).alias("magnitude"), name.alias("unit")))


def norm_field(field: Column, value: Column, compatible: bool = True) -> Column:
    """A text that is equal for values that agree in a field; null where a value cannot be read."""
    value = nfkc(value) if compatible else value
    q = norm_quantity(value, False)
    return (
        F.when(field == "mrp", norm_money(value, False).cast("string"))
        .when(field == "net_quantity", F.concat_ws(" ", q["magnitude"].cast("string"), q["unit"]))
        .otherwise(norm_text(value, False))
    )


def readable(field: Column, value: Column, compatible: bool = True) -> Column:
    value = nfkc(value) if compatible else value
    return F.when(field == "net_quantity", norm_quantity(value, False).isNotNull()).when(field == "mrp", norm_money(value, False).isNotNull()).otherwise(F.lit(True))


def values_equal(field: Column, left: Column, right: Column, compatible: bool = True) -> Column:
    """Two values that cannot be read are not equal. compatible: as in `norm_text`, for both."""
    # each side is read once by its field's form; what cannot be read is null
    alike = lambda form: form(left, compatible) == form(right, compatible)
    same = F.when(field == "mrp", alike(norm_money)).when(field == "net_quantity", alike(norm_quantity)).otherwise(alike(norm_text))
    return F.coalesce(same, F.lit(False))


def token_jaccard(left: Column, right: Column) -> Column:
    a = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(left, F.lit(""))), r"\s+")), lambda t: t != "")
    b = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(right, F.lit(""))), r"\s+")), lambda t: t != "")
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / either)


# The unit spellings that the server's matcher folds.
SERVER_UNITS = {"gm": "g", "grams": "g", "gram": "g", "kgs": "kg", "kilograms": "kg", "ltr": "l", "litre": "l", "litres": "l"}


def server_text(c: Column) -> Column:
    """The server matcher's text form: lower case, blanks collapsed; null is ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def server_money(c: Column) -> Column:
    """Two decimals where the text is a number, else its text form."""
    number = F.trim(c).try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2f", number)).otherwise(server_text(c))


def server_quantity(c: Column) -> Column:
    """Two words with the unit folded; kg and g stay apart."""
    words = F.split(server_text(c), " ")
    pairs = [F.lit(x) for pair in SERVER_UNITS.items() for x in pair]
    unit = F.coalesce(F.create_map(*pairs)[F.get(words, F.lit(1))], F.get(words, F.lit(1)))
    return F.when(F.size(words) == 2, F.concat_ws(" ", F.get(words, F.lit(0)), unit)).otherwise(server_text(c))
