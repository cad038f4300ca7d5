"""Emails and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import EMAIL, bind, col, strip

# Calling code, and what a valid national number looks like.  Coarser than full numbering plans.
PLANS: dict[str, str] = {
    "1": r"[2-9][0-8]\d[2-9]\d{6}",
    "7": r"[3489]\d{9}",
    "20": r"\d{8,10}",
    "27": r"[1-8]\d{8}",
    "31": r"[1-9]\d{8}",
    "32": r"[1-9]\d{7,8}",
    "33": r"[1-9]\d{8}",
    "34": r"[5-9]\d{8}",
    "39": r"[03]\d{5,10}",
    "41": r"[2-9]\d{8}",
    "43": r"[1-9]\d{6,12}",
    "44": r"[1-35789]\d{8,9}",
    "45": r"[2-9]\d{7}",
    "46": r"[1-9]\d{6,9}",
    "47": r"[2-9]\d{7}",
    "48": r"[1-9]\d{8}",
    "49": r"[1-9]\d{6,12}",
    "52": r"[1-9]\d{9}",
    "55": r"[1-9]{2}\d{8,9}",
    "61": r"[2-478]\d{8}",
    "64": r"[2-9]\d{7,9}",
    "65": r"[3689]\d{7}",
    "81": r"[1-9]\d{8,9}",
    "82": r"[1-9]\d{7,9}",
    "86": r"1[3-9]\d{9}|[2-9]\d{8,10}",
    "91": r"[1-9]\d{9}",
    "92": r"[2-9]\d{8,9}",
    "351": r"[2-9]\d{8}",
    "353": r"[1-9]\d{6,9}",
    "358": r"[1-9]\d{4,11}",
    "852": r"[2-9]\d{7}",
    "880": r"1\d{9}|[2-9]\d{6,9}",
    "966": r"[1-9]\d{7,8}",
    "971": r"[2-9]\d{7,8}",
    "972": r"[2-9]\d{7,8}",
}
# Calling codes of other numbering plans, with the fewest and most digits of a national number.
LENGTHS: dict[str, tuple[int, int]] = {
    "30": (10, 10), "36": (8, 9), "40": (9, 9), "51": (8, 9), "53": (6, 8), "54": (10, 11), "56": (9, 9), "57": (10, 10), "58": (10, 10), "60": (8, 10),
    "62": (8, 12), "63": (8, 10), "66": (8, 9), "84": (8, 10), "90": (10, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10),
    "212": (9, 9), "213": (8, 9), "216": (8, 8), "218": (8, 9), "221": (9, 9), "225": (10, 10), "233": (9, 9), "234": (8, 10), "237": (9, 9), "251": (9, 9),
    "254": (9, 9), "255": (9, 9), "256": (9, 9), "260": (9, 9), "263": (9, 9), "352": (6, 9), "354": (7, 7), "355": (8, 9), "356": (8, 8), "357": (8, 8),
    "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "373": (8, 8), "374": (8, 8), "375": (9, 9), "380": (9, 9), "381": (8, 9), "385": (8, 9),
    "386": (8, 8), "387": (8, 8), "389": (8, 8), "420": (9, 9), "421": (9, 9), "502": (8, 8), "503": (8, 8), "504": (8, 8), "505": (8, 8), "506": (8, 8),
    "507": (7, 8), "591": (8, 8), "593": (8, 9), "595": (9, 9), "598": (8, 8), "855": (8, 9), "856": (8, 10), "886": (8, 9), "960": (7, 7), "961": (7, 8),
    "962": (8, 9), "963": (8, 9), "964": (8, 10), "965": (8, 8), "967": (7, 9), "968": (8, 8), "970": (8, 9), "973": (8, 8), "974": (8, 8), "975": (7, 8),
    "976": (8, 8), "977": (8, 10), "992": (9, 9), "993": (8, 8), "994": (9, 9), "995": (9, 9), "996": (9, 9), "998": (9, 9),
}
# Calling codes of regions whose numbers may come without one.
REGIONS: dict[str, str] = {
    "US": "1", "CA": "1", "GB": "44", "IN": "91", "DE": "49", "FR": "33", "ES": "34", "IT": "39", "NL": "31", "BR": "55",
    "MX": "52", "AU": "61", "JP": "81", "CN": "86", "SG": "65", "AE": "971", "IE": "353", "CH": "41", "AT": "43", "PL": "48",
    "GR": "30", "HU": "36", "RO": "40", "AR": "54", "CL": "56", "CO": "57", "MY": "60", "ID": "62", "PH": "63", "TH": "66", "VN": "84", "TR": "90", "NG": "234", "KE": "254",
    "PT": "351", "FI": "358", "BG": "359", "UA": "380", "CZ": "420", "SK": "421", "TW": "886", "IL": "972", "NP": "977", "UZ": "998",
}
#: All valid numbers, calling code first.
VALID = "^(?:" + "|".join(f"{code}(?:{plan})" for code, plan in PLANS.items()) + ")$"
EXTENSION = r"(?i)\s*(?:;?ext[.=:]?|x|#)\s*\d{1,7}\s*$"
SHAPE = r"^\+?[\d\s().\-/\x{A0}]+$"
#: Four short groups between dots are a network address.
ADDRESS = r"^\d{1,3}(\.\d{1,3}){3}$"


def normalize_email(c: str | Column) -> Column:
    """Trimmed and lower-cased; null unless it has the shape of an address."""
    e = F.lower(strip(c))
    return F.when(e.rlike(f"^{EMAIL}$"), e)


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull()))


def normalize_emails(c: str | Column) -> Column:
    """The valid addresses of a list, each once, in order."""
    return _distinct(F.transform(col(c), normalize_email))


def extract_emails(c: str | Column) -> Column:
    """The addresses in a text, each once, in order."""
    text = col(c)
    found = normalize_emails(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1)))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def _in_plan(number: Column) -> Column:
    """Whether a number, calling code first, has as many digits as its plan allows.

    No calling code begins another, so the plan is the one entry met on the way down the digits.
    """
    entries = ", ".join(f"'{code}', struct({low} as low, {high} as high)" for code, (low, high) in LENGTHS.items())
    plans = F.expr(f"map({entries})")
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.element_at(plans, F.left(number, F.lit(k))).alias("plan")) for k in (2, 3)))

    def fits(found: Column) -> Column:
        national = F.length(number) - found["k"]
        return national.between(found["plan"]["low"], found["plan"]["high"]) & (F.substr(number, found["k"] + 1, F.lit(1)) != "0")

    return F.exists(F.filter(steps, lambda x: x["plan"].isNotNull()), fits)


def normalize_phone(c: str | Column, region: str = "US") -> Column:
    """The number in E.164, or null unless it is valid; ``region`` holds for numbers without ``+``."""
    code = REGIONS[region]

    def number(base: Column) -> Column:
        digits = F.regexp_replace(base, "[^0-9]", "")
        if code == "1":
            national = F.regexp_replace(digits, "^1(?=[0-9]{10}$)", "")
        elif code == "39":
            national = digits
        else:
            national = F.regexp_replace(digits, "^0+", "")
        full = F.when(base.startswith("+"), digits).otherwise(F.concat(F.lit(code), national))
        return F.when(base.rlike(SHAPE) & ~base.rlike(ADDRESS), bind(full, lambda n: F.when(n.rlike(VALID) | _in_plan(n), F.concat(F.lit("+"), n))))

    return bind(F.regexp_replace(strip(c), EXTENSION, ""), number)


def normalize_phones(c: str | Column, region: str = "US") -> Column:
    """The valid numbers of a list, each once, in order."""
    return _distinct(F.transform(col(c), lambda x: normalize_phone(x, region)))
