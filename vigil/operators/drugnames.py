"""Drug names brought to one name each: strength, form and salt stripped, synonyms joined to components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components

# ---- word lists (fixed values of this library) -----------------------------------
UNITS = ["mg", "mcg", "ug", "µg", "g", "kg", "ml", "l", "iu", "units?", "%"]
FORMS = ["tablets?", "tabs?", "capsules?", "caps?", "injections?", "solution", "suspension", "syrup", "cream", "ointment", "gel", "patch(es)?", "drops", "spray",
         "oral", "film coated", "extended release", "xr", "er", "sr"]
SALTS = ["hydrochloride", "hcl", "dihydrochloride", "hydrobromide", "sodium", "potassium", "calcium", "magnesium", "sulfate", "sulphate", "phosphate", "acetate",
         "citrate", "tartrate", "maleate", "fumarate", "succinate", "mesylate", "besylate", "tosylate", "nitrate", "bromide", "monohydrate", "dihydrate"]
# ------------------------------------------------------------------------------------
STRENGTH = r"\b[0-9]+([.,][0-9]+)? ?(" + "|".join(UNITS[:-1]) + r")\b(/ ?[0-9]*([.,][0-9]+)? ?(" + "|".join(UNITS[:-1]) + r"|h|hr|day)\b)?|\b[0-9]+([.,][0-9]+)? ?%"
FORM = r"\b(" + "|".join(FORMS) + r")\b"
#: A salt counts only after another word: 'sodium chloride' stays what it is.
SALT = r"([^ ]) (" + "|".join(SALTS) + r")( |$)"
PATTERNS = [(r"\([^)]*\)", " "), (STRENGTH, " "), (FORM, " "), (r"[ ,;/]+", " "), (r"^ | $", "")]


def base_name(c: Column) -> Column:
    """Lower case, without brackets, strength, form and trailing salts; what is left of nothing is the lower-cased name."""
    low = F.lower(F.coalesce(c, F.lit("")))
    x = low
    for pattern, by in PATTERNS:
        x = F.regexp_replace(x, pattern, by)
    for _ in range(2):  # 'x sodium phosphate'
        x = F.regexp_replace(F.regexp_replace(x, SALT, "$1 "), r"^ | $", "")
    return F.when(x != "", x).otherwise(F.regexp_replace(low, r"^\s+|\s+$", ""))


def canonical_names(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, base, canonical) of every different ``name``: two names are one drug if their bases are equal or a chain of
    ``synonyms`` (a, b) joins them.  The canonical name is the smallest base of the component."""
    own = names.select("name").where("name is not null").distinct().withColumn("base", base_name(F.col("name")))
    told = synonyms.select(base_name(F.col("a")).alias("a"), base_name(F.col("b")).alias("b")).where("a <> '' and b <> ''")
    comps = components(told)
    return own.join(comps.withColumnRenamed("node", "base"), "base", "left").select("name", "base", F.coalesce("component", "base").alias("canonical"))
